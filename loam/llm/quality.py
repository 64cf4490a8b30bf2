"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; a failed rule sets its bit.  Policies are versioned masks over
those bits, so a new policy and its ablations need no second look at the text: ``judge`` and
``quality_ablation`` take a ledger made before, and any policies.

Defined results: a null or blank text has no words and fails ``no_words`` only; ratios of an empty
denominator are 0; rules judge each row alone, so ties, repeated rows and null ids change nothing; empty
tables give empty ledgers.  Columns whose names begin with ``__loam_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name, SQL over the measurements (valid in Spark and DuckDB); a rule's place is its bit.
RULES: list[tuple[str, str]] = [
    ("no_words", "n_words = 0"),
    ("symbols", "n_words >= 5 AND n_symbols > 0.3 * n_words"),
    ("shouting", "n_letters >= 20 AND n_upper > 0.6 * n_letters"),
    ("repeated_words", "n_words >= 10 AND n_repeats > 0.3 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND n_distinct_lines < 0.5 * n_lines"),
    ("exclamations", "n_words >= 10 AND n_exclaims > 0.3 * n_words"),
    ("digits", "n_chars >= 20 AND n_digits > 0.4 * n_chars"),
    ("broken_encoding", "n_broken > 0.01 * n_chars"),
    ("tiny_words", "n_words >= 10 AND n_chars < 2 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: version: the rules that reject.
POLICIES: dict[str, list[str]] = {
    "v1": ["no_words", "symbols", "shouting", "repeated_words"],
    "v2": [name for name, _ in RULES],
}
MEASURES = ["n_chars", "n_words", "n_symbols", "n_letters", "n_upper", "n_digits", "n_exclaims", "n_broken", "n_repeats", "n_lines", "n_distinct_lines"]


def policy_mask(version: str, policies: dict[str, list[str]] | None = None) -> int:
    rules = (POLICIES if policies is None else policies)[version]
    return sum(BIT[r] for r in set(rules))


def _without(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, signs, ""))


def _measured(docs: DataFrame) -> DataFrame:
    """docs with the reserved columns __loam_<measure>."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumns({
        "__loam_words": F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != ""),
        "__loam_lines": F.filter(F.split(text, "\\n"), lambda x: F.trim(x) != ""),
        # all that is counted by character but lower-case letters, which are most of a text
        "__loam_rest": F.regexp_replace(text, "\\p{Ll}+", ""),
    })
    docs = docs.withColumn("__loam_signs", F.regexp_replace("__loam_rest", "\\p{L}+", ""))
    words, lines, rest, signs = (F.col(f"__loam_{c}") for c in ("words", "lines", "rest", "signs"))
    repeats = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))
    values = {
        "n_chars": F.length(text),
        "n_words": F.size(words),
        "n_symbols": _without(signs, "[#%*&$|~^<>{}=\\\\]+"),
        "n_letters": F.length(text) - F.length(signs),
        "n_upper": _without(rest, "\\p{Lu}+"),
        "n_digits": _without(signs, "[0-9]+"),
        "n_exclaims": _without(signs, "!+"),
        "n_broken": _without(signs, "\ufffd+"),
        "n_repeats": repeats,
        "n_lines": F.size(lines),
        "n_distinct_lines": F.size(F.array_distinct(lines)),
    }
    docs = docs.withColumns({f"__loam_{k}": v.cast("long") for k, v in values.items()})
    return docs.drop("__loam_words", "__loam_lines", "__loam_rest", "__loam_signs")


def _failed() -> Column:
    def rule(sql: str) -> Column:
        for m in sorted(MEASURES, key=len, reverse=True):
            sql = sql.replace(m, f"`__loam_{m}`") if f"`__loam_{m}" not in sql else sql
        return F.expr(sql)

    bits = F.lit(0).cast("long")
    for name, sql in RULES:
        bits = bits.bitwiseOR(F.when(rule(sql), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def quality_ledger(docs: DataFrame) -> DataFrame:
    """doc_id, failed (bits), the measurements, and for each policy whether it keeps the document."""
    out = _measured(docs.select("doc_id", "text")).withColumn("__loam_failed", _failed())
    return judge(out.select("doc_id", F.col("__loam_failed").alias("failed"), *[F.col(f"__loam_{m}").alias(m) for m in MEASURES]))


def judge(ledger: DataFrame, policies: dict[str, list[str]] | None = None) -> DataFrame:
    """The ledger with whether each of the policies (by default all of POLICIES) keeps the document, from its bits alone."""
    versions = POLICIES if policies is None else policies
    return ledger.withColumns({f"keep_{v}": F.col("failed").bitwiseAND(F.lit(policy_mask(v, versions)).cast("long")) == 0 for v in versions}) if versions else ledger


def quality_filter(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The rows of docs that the policy keeps, with docs's own columns."""
    own = docs.columns
    # no filter moves past the row number; else each rule would measure the text again
    out = _measured(docs).withColumns({"__loam_failed": _failed(), "__loam_row": F.monotonically_increasing_id()})
    return out.where((F.col("__loam_failed").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0) & (F.col("__loam_row") >= 0)).select(*[F.col(f"`{c}`") for c in own])


def quality_ablation(ledger: DataFrame, policies: dict[str, list[str]] | None = None) -> DataFrame:
    """For each of the policies (by default all of POLICIES) and rule of it: documents that fail the rule, that only it rejects, and that stay without it.

    One pass counts the distinct bit patterns (at most 2**rules); all else is bit arithmetic on those counts.
    """
    spark, versions = ledger.sparkSession, POLICIES if policies is None else policies
    patterns = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    rules = spark.createDataFrame([(v, r, BIT[r], policy_mask(v, versions)) for v in versions for r in dict.fromkeys(versions[v])], "policy string, rule string, bit long, mask long")
    of = F.col("failed").bitwiseAND(F.col("mask"))
    return (
        patterns.crossJoin(F.broadcast(rules))
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(of == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(of.bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def _ledger_sql() -> str:
    gone = lambda signs: f"length(t) - length(regexp_replace(t, '{signs}', '', 'g'))"
    bits = " | ".join(f"(CASE WHEN {sql} THEN {BIT[name]} ELSE 0 END)" for name, sql in RULES)
    keeps = ", ".join(f"(failed & {policy_mask(v)}) = 0 AS keep_{v}" for v in POLICIES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[ \\t\\n\\r]+'), lambda w: w <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '') AS lines FROM d),
m AS (SELECT doc_id, length(t)::BIGINT AS n_chars, len(words)::BIGINT AS n_words,
    ({gone('[#%*&$|~^<>{}=\\\\]')})::BIGINT AS n_symbols, ({gone('\\p{L}+')})::BIGINT AS n_letters,
    ({gone('\\p{Lu}+')})::BIGINT AS n_upper, ({gone('[0-9]+')})::BIGINT AS n_digits,
    ({gone('!')})::BIGINT AS n_exclaims, (length(t) - length(replace(t, chr(65533), '')))::BIGINT AS n_broken,
    len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1]))::BIGINT AS n_repeats,
    len(lines)::BIGINT AS n_lines, len(list_distinct(lines))::BIGINT AS n_distinct_lines FROM a),
f AS (SELECT *, ({bits})::BIGINT AS failed FROM m)
SELECT doc_id, failed, {', '.join(MEASURES)}, {keeps} FROM f"""


LEDGER_SQL = _ledger_sql()


def _ablation_sql() -> str:
    rules = ", ".join(f"('{v}', '{r}', {BIT[r]}, {policy_mask(v)})" for v in POLICIES for r in POLICIES[v])
    return f"""
WITH l AS ({LEDGER_SQL}), r(policy, rule, bit, mask) AS (VALUES {rules})
SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_only,
       count(*) FILTER (failed & mask & ~bit = 0) AS n_kept_without
FROM l CROSS JOIN r GROUP BY policy, rule"""


ABLATION_SQL = _ablation_sql()
