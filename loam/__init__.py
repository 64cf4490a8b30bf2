"""loam: a Spark-first engine for searching and cleaning web corpora."""
