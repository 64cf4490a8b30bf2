"""Line dedup by a sharded minimal perfect hash over the distinct lines' hashes.

Lines are compared trimmed of spaces; blank lines are never judged.  The documents' distinct line hashes are counted,
sharded by SHARD_LINES, and each shard is turned into a minimal perfect hash (levels of bit arrays with a rank
directory) that indexes an array of 16-bit fingerprints and one of 16-bit counts of documents, about 4.5 bytes a
distinct line; for lines of two documents or more two further arrays name the document that keeps the line, the one
of least doc_id (null first), and its size.  Documents then probe the arrays.

A line is repeated if MIN_DOCS documents have it, or, where it is long (LONG_WORDS words, or LONG_CHARS characters for
scripts without blanks), if two have.  A repeated line stays in the document that keeps it and goes from all others,
whatever share of them it is, so nothing vanishes from the corpus.  Only where a document is a copy of another as a
whole, all but the lines that third documents keep, are the lines that this other one keeps left to it: copies are the
near-duplicate stage's matter, and a copy without its lines would be a shred that no stage knows again.  A copy: by
characters of lines, a similarity (shared / all) of COPY or more to the other document, less what goes of either.

While all arrays are within LOCAL_BYTES each worker reads them once from the shared folder and documents are not
shuffled.  Beyond, hashes of documents' lines travel to the shards (salted, so that no hot line makes a hot task),
each worker holds one shard at a time, and only lines of two documents or more travel back.

Defined results: a null text stays null and has no lines; a repeated row counts as one more document; rows of one
doc_id, or of null ids, count as one document when it is decided which keeps a line, so repeated rows stay alike; a
line repeated within one document counts once and is not taken from itself; very long texts and lines are judged
whole; empty tables give empty results; columns whose names begin with __loam_ are reserved, others may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.words import mix
from loam.runtime import materialise, release, shared_dir, small_side

MIN_DOCS, LONG_WORDS, LONG_CHARS = 5, 20, 100
#: The least similarity of a copy, as a fraction; near-dedup finds 99 of 100 pairs from there on.
COPY = (3, 5)
LOCAL_BYTES, SHARD_LINES = 64 << 20, 1 << 20
SALTS = 16
_U = np.uint64
_GAMMA, _LEVELS = 2, 48


class PerfectHash:
    """Of distinct 64-bit keys: each key's own number below their count."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.placed = int(ones.sum())

    @staticmethod
    def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + _U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(keys) and len(sizes) < _LEVELS:
            size = -(-_GAMMA * len(keys) // 64) * 64
            at = cls._spot(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").view(_U))
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, _U), np.sort(keys))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys; of keys it was not built over, any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.offsets[level] + self._spot(keys[left], level, int(size))
            word, bit = self.bits[at >> 6], (at & 63).astype(_U)
            hit = (word >> bit) & _U(1) == 1
            below = word[hit] & ((_U(1) << bit[hit]) - _U(1))
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            out[left] = np.where(self.rest[at] == keys[left], self.placed + at, -1)
        return out


def _print(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _U(0xA5A5A5A5A5A5A5A5)) >> _U(48)).astype(np.uint16)


class Shard:
    def __init__(self, row: dict):
        array = lambda k, t: np.frombuffer(row[k], t)
        self.hash = PerfectHash(np.array(row["sizes"], np.int64), array("bits", _U), array("rest", _U))
        self.prints, self.counts = array("prints", np.uint16), array("counts", np.uint16)
        self.keepers, self.keeper_sizes = array("keepers", np.uint32), array("keeper_sizes", np.uint32)
        # lines of two documents or more, in order of their numbers, have a keeper
        self.turn = np.cumsum(self.counts >= 2) - 1

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each key's line how many documents have it, 0 where its fingerprint is not the indexed one, which keeps it, and that one's size."""
        n, keeper, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = self.hash(keys)
        ok = np.flatnonzero(at >= 0)
        ok = ok[self.prints[at[ok]] == _print(keys[ok])]
        n[ok] = self.counts[at[ok]]
        some = np.flatnonzero(n >= 2)
        turn = self.turn[at[some]]
        keeper[some], size[some] = self.keepers[turn], self.keeper_sizes[turn]
        return n, keeper, size


def build_shard(table: pa.Table) -> dict:
    keys = table["h"].to_numpy().view(_U)
    counts = np.minimum(table["n"].to_numpy(), 65535).astype(np.uint16)
    h = PerfectHash.build(keys)
    at = h(keys)
    prints, values, order = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.int64)
    prints[at], values[at], order[at] = _print(keys), counts, np.arange(len(keys))
    order = order[values >= 2]
    keepers = _short_name(table["keeper"].to_numpy()[order]).astype(np.uint32)
    sizes = np.minimum(table["keeper_size"].to_numpy()[order], 2**32 - 1).astype(np.uint32)
    return {"sizes": h.sizes.tolist(), "bits": h.bits.tobytes(), "prints": prints.tobytes(), "counts": values.tobytes(), "rest": h.rest.tobytes(), "keepers": keepers.tobytes(), "keeper_sizes": sizes.tobytes()}


def _short_name(ids: np.ndarray) -> np.ndarray:
    """32 bits of a document's 64-bit name."""
    return (ids.view(_U) >> _U(32)).astype(np.int64)


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


_loaded: dict[tuple[str, int], Shard] = {}


def _load(path: str, shard: int, keep: int) -> Shard:
    """A shard from the shared folder; at most keep of them stay in the worker."""
    if (path, shard) not in _loaded:
        while len(_loaded) >= keep:
            _loaded.pop(next(iter(_loaded)))
        fs, p = _place(f"{path}/{shard}.parquet")
        with fs.open_input_file(p) as f:
            (row,) = pq.read_table(f).to_pylist()
        _loaded[path, shard] = Shard(row)
    return _loaded[path, shard]


def probe(keys: np.ndarray, path: str, shards: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, keeper and its size for signed 64-bit hashes of lines that the index was built over."""
    which = (keys % shards).astype(np.int64)
    out = tuple(np.zeros(len(keys), np.int64) for _ in range(3))
    order = np.argsort(which, kind="stable")
    edges = np.flatnonzero(np.diff(which[order])) + 1
    for part in np.split(order, edges) if len(order) else []:
        for have, found in zip(out, _load(path, int(which[part[0]]), keep).find(keys[part].view(_U))):
            have[part] = found
    return out


def line_keys(text: Column) -> Column:
    """For each line of a text its hash, null for a blank one."""
    return F.transform(F.split(text, "\\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def _size(text: Column) -> Column:
    """Characters of lines that aren't blank."""
    return F.aggregate(F.split(text, "\\n"), F.lit(0).cast("long"), lambda a, x: a + F.when(F.trim(x) != "", F.length(x)).otherwise(0))


def build_index(docs: DataFrame, shard_lines: int = SHARD_LINES) -> tuple[str, int, int]:
    """Writes the sharded arrays: their folder, the number of shards, and the bytes of all."""
    spark = docs.sparkSession
    # both are columns before lines are put in rows, else a document's size is summed once a line
    doc = F.named_struct(F.lit("doc_id"), F.col("doc_id"), F.lit("size"), _size(F.col("text")))
    lines = docs.select(doc.alias("doc"), F.array_distinct(F.array_compact(line_keys(F.col("text")))).alias("keys")).select("doc", F.explode("keys").alias("h"))
    counted = lines.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("doc"))
    counted = materialise(counted.select("h", "n", F.xxhash64("doc.doc_id").alias("keeper"), F.col("doc.size").alias("keeper_size")))
    shards = max(1, -(-counted.count() // shard_lines))
    path = shared_dir(spark)

    def build(key, table):
        row = build_shard(table)
        fs, p = _place(f"{path}/{key[0].as_py()}.parquet")
        fs.create_dir(p.rpartition("/")[0], recursive=True)
        # a task that runs again writes the same; a file appears whole
        part = f"{p}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(part) as f:
            pq.write_table(pa.Table.from_pylist([row]), f)
        fs.move(part, p)
        return pa.table({"bytes": [sum(len(v) for v in row.values() if isinstance(v, bytes))]})

    built = counted.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, "bytes long")
    size = built.agg(F.sum("bytes")).first()[0] or 0
    release(counted)
    return path, shards, size


def _judge(keys: pa.Array, lengths: pa.Array, long: pa.Array, names: pa.Array, found: tuple[np.ndarray, np.ndarray, np.ndarray], min_docs: int) -> pa.Array:
    """For each line of each text 0, 1 if it is repeated and stays, or 2 if it goes."""
    n, keeper, keeper_size = found
    row = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
    length, long = lengths.flatten().to_numpy(), long.flatten().to_numpy(zero_copy_only=False)
    own = _short_name(names.to_numpy())
    repeated = (n >= min_docs) | (long & (n >= 2))
    other = (n >= 2) & (keeper != own[row])
    out = repeated.astype(np.int8)
    goes = np.flatnonzero(repeated & other)
    if len(goes):
        size = np.bincount(row, length * (keys.flatten().to_numpy() != 0), minlength=len(keys)).astype(np.int64)
        at = np.flatnonzero(other)
        order = at[np.lexsort((keeper_size[at], keeper[at], row[at]))]
        r, k, z = row[order], keeper[order], keeper_size[order]
        head = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]) | (z[1:] != z[:-1])])
        shared, taken = np.add.reduceat(length[order], head), np.add.reduceat(length[order] * repeated[order], head)
        r, k, z = r[head], k[head], z[head]
        third = np.bincount(r, taken, minlength=len(keys)).astype(np.int64)[r] - taken
        either = size[r] - third + np.maximum(z - third, shared) - shared
        copy = COPY[1] * shared >= COPY[0] * either
        copies = set(zip(r[copy].tolist(), k[copy].tolist(), z[copy].tolist()))
        stays = np.array([x in copies for x in zip(row[goes].tolist(), keeper[goes].tolist(), keeper_size[goes].tolist())], bool) if copies else np.zeros(len(goes), bool)
        out[goes[~stays]] = 2
    return pa.ListArray.from_arrays(pa.array(keys.offsets.to_numpy() - keys.offsets[0].as_py(), pa.int32()), pa.array(out))


_LINES = ["__loam_keys", "__loam_lengths", "__loam_long", "__loam_name"]


def _with_lines(docs: DataFrame) -> DataFrame:
    """docs with each text's lines: hashes (0 for a blank one), lengths, whether long; and the document's name."""
    lines = F.split(F.coalesce("text", F.lit("")), "\\n")
    trimmed = F.transform(lines, lambda x: F.trim(x))
    return docs.withColumns({
        "__loam_keys": F.transform(trimmed, lambda x: F.when(x != "", F.xxhash64(x)).otherwise(0)),
        "__loam_lengths": F.transform(lines, lambda x: F.length(x)),
        "__loam_long": F.transform(trimmed, lambda x: (F.length(x) >= LONG_CHARS) | (F.size(F.split(x, "[ \\t]+")) >= LONG_WORDS)),
        "__loam_name": F.xxhash64("doc_id"),
    })


_FLAGS = T.ArrayType(T.ByteType())


def _flags_local(path: str, shards: int, min_docs: int):
    def flags(keys: pa.Array, lengths: pa.Array, long: pa.Array, names: pa.Array) -> pa.Array:
        flat = keys.flatten().to_numpy()
        filled = np.flatnonzero(flat)
        found = tuple(np.zeros(len(flat), np.int64) for _ in range(3))
        for have, x in zip(found, probe(flat[filled], path, shards, shards)):
            have[filled] = x
        return _judge(keys, lengths, long, names, found, min_docs)

    return F.arrow_udf(flags, _FLAGS)


def _found_routed(docs: DataFrame, path: str, shards: int) -> DataFrame:
    """k1, k2 (the text's key) and found: what the index has of its lines that are in two documents or more."""

    def seek(batches):
        for b in batches:
            n, keeper, size = probe(b["h"].to_numpy(), path, shards, 1)
            some = np.flatnonzero(n >= 2)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(some)).columns, *[pa.array(x[some]) for x in (n, keeper, size)]], [*b.schema.names, "n", "keeper", "size"])

    lines = docs.select(*_text_key(), F.array_distinct(F.array_compact(line_keys(F.col("text")))).alias("keys")).select("k1", "k2", F.explode("keys").alias("h"))
    lines = lines.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).withColumn("salt", F.pmod("k1", F.lit(SALTS)))
    lines = lines.repartition("shard", "salt").sortWithinPartitions("shard").select("k1", "k2", "h")
    back = lines.mapInArrow(seek, "k1 long, k2 long, h long, n long, keeper long, size long")
    return back.groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "n", "keeper", "size")).alias("found"))


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("k2"), "text").alias("k2")]


def _flags_of_found(min_docs: int):
    def flags(keys: pa.Array, lengths: pa.Array, long: pa.Array, names: pa.Array, known: pa.Array) -> pa.Array:
        flat = keys.flatten().to_numpy()
        row = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
        found = tuple(np.zeros(len(flat), np.int64) for _ in range(3))
        have = known.flatten()
        if len(have):
            # a text's lines are told apart by hash, texts by number
            of = np.repeat(np.arange(len(known)), known.value_lengths().fill_null(0).to_numpy())
            h, *values = (have.field(i).to_numpy() for i in range(4))
            want = mix(flat.view(_U) ^ mix(row.astype(_U)))
            there = mix(h.view(_U) ^ mix(of.astype(_U)))
            order = np.argsort(there)
            at = np.minimum(np.searchsorted(there[order], want), len(order) - 1)
            ok = np.flatnonzero((there[order][at] == want) & (flat != 0))
            for x, v in zip(found, values):
                x[ok] = v[order][at[ok]]
        return _judge(keys, lengths, long, names, found, min_docs)

    return F.arrow_udf(flags, _FLAGS)


def flag_lines(docs: DataFrame, min_docs: int = MIN_DOCS, local_bytes: int = LOCAL_BYTES, shard_lines: int = SHARD_LINES) -> DataFrame:
    """docs with __loam_flags: for each line 0, 1 if it is repeated and stays, or 2 if it goes."""
    if not 2 <= min_docs <= 65535:
        raise ValueError("counts are kept up to 65535, and a line of one document is not repeated")
    path, shards, size = build_index(docs, shard_lines)
    if size <= local_bytes:
        return _with_lines(docs).withColumn("__loam_flags", _flags_local(path, shards, min_docs)(*_LINES)).drop(*_LINES)
    found = materialise(_found_routed(docs, path, shards))
    found = found.select(F.col("k1").alias("__loam_k1"), F.col("k2").alias("__loam_k2"), F.col("found").alias("__loam_found"))
    k1, k2 = _text_key()
    keyed = docs.withColumn("__loam_k1", k1).withColumn("__loam_k2", k2).join(small_side(found, 400), ["__loam_k1", "__loam_k2"], "left")
    return _with_lines(keyed).withColumn("__loam_flags", _flags_of_found(min_docs)(*_LINES, "__loam_found")).drop(*_LINES, "__loam_k1", "__loam_k2", "__loam_found")


def _judged(docs: DataFrame, min_docs: int, local_bytes: int, shard_lines: int) -> DataFrame:
    """docs with __loam_text, the new text, __loam_n, __loam_hit and __loam_gone: lines not blank, repeated, removed."""
    d = flag_lines(docs, min_docs, local_bytes, shard_lines).withColumn("__loam_lines", F.split("text", "\\n"))
    some = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    d = d.withColumns({
        "__loam_n": some(F.filter("__loam_lines", lambda x: F.trim(x) != "")),
        "__loam_hit": some(F.filter("__loam_flags", lambda x: x > 0)),
        "__loam_gone": some(F.filter("__loam_flags", lambda x: x == 2)),
    })
    left = F.array_join(F.filter("__loam_lines", lambda x, i: F.get("__loam_flags", i) != 2), "\n")
    return d.withColumn("__loam_text", F.when(F.col("__loam_gone") > 0, left).otherwise(F.col("text")))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, local_bytes: int = LOCAL_BYTES, shard_lines: int = SHARD_LINES) -> DataFrame:
    """doc_id, text (without the repeated lines that other documents keep), n_lines, n_repeated, n_removed: one row a document."""
    d = _judged(docs.select("doc_id", "text"), min_docs, local_bytes, shard_lines)
    return d.select("doc_id", F.col("__loam_text").alias("text"), F.col("__loam_n").alias("n_lines"), F.col("__loam_hit").alias("n_repeated"), F.col("__loam_gone").alias("n_removed"))


def dedup_lines_in_place(docs: DataFrame, min_docs: int = MIN_DOCS, local_bytes: int = LOCAL_BYTES, shard_lines: int = SHARD_LINES) -> DataFrame:
    """docs with its own columns, text without the repeated lines that other documents keep, and n_chars, if there is
    one, of the new text; documents of which every line went are left out."""
    d = _judged(docs, min_docs, local_bytes, shard_lines).where((F.col("__loam_gone") == 0) | (F.col("__loam_gone") < F.col("__loam_n")))
    new = {"text": F.col("__loam_text"), "n_chars": F.length("__loam_text").cast("long")}
    return d.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


DEDUP_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
k AS (SELECT *, trim(x, ' ') AS k FROM l),
z AS (SELECT r, sum(CASE WHEN k <> '' THEN length(x) ELSE 0 END)::BIGINT AS size FROM k GROUP BY r),
c AS (SELECT k, count(DISTINCT r) AS n, min({{'given': doc_id IS NOT NULL, 'id': coalesce(doc_id, 0), 'size': size}}) AS keeper FROM k JOIN z USING (r) WHERE k <> '' GROUP BY k),
j AS (SELECT r, i, x, k.k <> '' AS filled, keeper, coalesce(n >= 2 AND (keeper.given, keeper.id) <> (doc_id IS NOT NULL, coalesce(doc_id, 0)), false) AS other,
             coalesce(n >= {MIN_DOCS} OR (n >= 2 AND (length(k.k) >= {LONG_CHARS} OR len(string_split_regex(k.k, '[ \t]+')) >= {LONG_WORDS})), false) AS bad FROM k LEFT JOIN c ON k.k = c.k),
f AS (SELECT r, keeper, sum(length(x))::BIGINT AS shared, coalesce(sum(length(x)) FILTER (bad), 0)::BIGINT AS taken FROM j WHERE other GROUP BY r, keeper),
g AS (SELECT r, keeper, shared, (sum(taken) OVER (PARTITION BY r) - taken)::BIGINT AS third FROM f),
y AS (SELECT r, keeper, true AS copied FROM g JOIN z USING (r) WHERE {COPY[1]} * shared >= {COPY[0]} * (size - third + greatest(keeper.size - third, shared) - shared)),
v AS (SELECT r, i, x, filled, bad, bad AND other AND NOT coalesce(copied, false) AS goes FROM j LEFT JOIN y USING (r, keeper)),
s AS (SELECT r, count(*) FILTER (filled) AS n_lines, count(*) FILTER (bad) AS n_repeated, count(*) FILTER (goes) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT goes), '') AS rest FROM v GROUP BY r)
SELECT doc_id, CASE WHEN n_removed > 0 THEN rest ELSE text END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines,
       coalesce(n_repeated, 0)::BIGINT AS n_repeated, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM d LEFT JOIN s USING (r)"""
