"""Session helpers: the shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Rows of texts or pages that go to a Python worker at once.
TEXT_ROWS = 1000


def build_session(app: str = "loam", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for; the cluster's own win where they are set."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor can reach.

    Only where the session names none and has one machine (tests) a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loam-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loam-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loam_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what materialise wrote for df; only for a df that nothing unwritten still reads."""
    drop_folder(df.sparkSession, df._loam_path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit, else df as it is.

    df should be materialised: the count is then read from Parquet footers.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def text_batches(spark: SparkSession) -> None:
    """From here on in the session Arrow batches have TEXT_ROWS rows at most, so that long texts fit a worker; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)
