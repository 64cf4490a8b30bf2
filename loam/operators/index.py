"""Inverted index: tokens, postings, term dictionary, document lengths and corpus statistics."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.porter2 import stem, stem_terms
from loam.functions.text import title_admitted, tokens
from loam.functions.urls import host, registrable_domain
from loam.runtime import materialise, shared_dir, small_side, text_batches


#: Page ids that one block of a posting list covers.
BLOCK_PAGES = 1 << 16
#: Postings that a Python worker gives back at once.
POSTING_ROWS = 1 << 16


@dataclass
class Index:
    postings: DataFrame
    terms: DataFrame
    doc_stats: DataFrame
    meta: DataFrame


def field_tokens(pages: DataFrame, stemmed: bool = True, with_domain: bool = True) -> DataFrame:
    """page_id, field ('body', 'title', 'domain'), pos, term of pages(page_id, title, text [, final_url]) whose title is admitted."""
    p = pages.where(title_admitted(F.col("title")))
    fields = [("body", tokens(F.col("text"))), ("title", tokens(F.col("title")))]
    if with_domain and "final_url" in pages.columns:
        fields.append(("domain", tokens(registrable_domain(host(F.col("final_url"))))))
    every = F.flatten(F.array(*[_placed(f, t) for f, t in fields]))
    out = p.select("page_id", F.explode(every).alias("t")).select("page_id", "t.*")
    return stem_terms(out) if stemmed else out


def _placed(field: str, terms: Column) -> Column:
    return F.transform(terms, lambda x, i: F.struct(F.lit(field).alias("field"), i.alias("pos"), x.alias("term")))


def postings(toks: DataFrame) -> DataFrame:
    """term, page_id, freq, in_title, in_domain; a domain token never adds to a frequency, but is one by itself."""
    return toks.groupBy("term", "page_id").agg(
        F.greatest(F.count_if(F.col("field") != "domain"), F.lit(1)).cast("long").alias("freq"), F.max(F.col("field") == "title").alias("in_title"), F.max(F.col("field") == "domain").alias("in_domain")
    )


def page_postings(pages: DataFrame, stemmed: bool = True, with_domain: bool = True, only: Collection[str] | None = None) -> DataFrame:
    """What postings(field_tokens(pages)) gives, of the terms in only if it is given, counted page by page: nothing is shuffled.

    Only rows whose page id comes more than once, if there are any, are grouped.
    """
    text_batches(pages.sparkSession)
    fields = {"body": tokens(F.col("text")), "title": tokens(F.col("title"))}
    if with_domain and "final_url" in pages.columns:
        fields["domain"] = tokens(registrable_domain(host(F.col("final_url"))))
    if only is not None and not stemmed:
        wanted = list(only)
        fields = {f: F.filter(t, lambda x: x.isin(wanted)) for f, t in fields.items()}
    toks = pages.where(title_admitted(F.col("title"))).select("page_id", *[t.alias(f) for f, t in fields.items()])
    kind = T.StructType([T.StructField("term", T.StringType()), T.StructField("page_id", toks.schema["page_id"].dataType), *[T.StructField(n, t) for n, t in (("freq", T.LongType()), ("in_title", T.BooleanType()), ("in_domain", T.BooleanType()))]])

    def run(batches):
        for b in batches:
            yield from _counted(b, stemmed, only)

    posts = toks.mapInArrow(run, kind)
    ids = materialise(pages.groupBy("page_id").count().where("count > 1").select(F.col("page_id").alias("__id")))
    if not ids.take(1):
        return posts
    several = pages.join(small_side(ids, 24), F.col("page_id").eqNullSafe(F.col("__id")), "left_semi")
    once = posts.join(small_side(ids, 24), F.col("page_id").eqNullSafe(F.col("__id")), "left_anti")
    repeated = postings(field_tokens(several, stemmed, with_domain))
    return once.unionByName(repeated.where(F.col("term").isin(list(only))) if only is not None else repeated)


def _counted(b: pa.RecordBatch, stemmed: bool, only: Collection[str] | None) -> Iterator[pa.RecordBatch]:
    """A batch of pages' tokens as postings; its columns are page_id and the fields' lists."""
    rows, words, kinds = [], [], []
    for k, field in enumerate(b.schema.names[1:]):
        lists = b[field]
        rows.append(pc.list_parent_indices(lists).to_numpy())
        words.append(pc.list_flatten(lists))
        kinds.append(np.full(len(words[-1]), {"body": 0, "title": 1, "domain": 2}[field], np.int8))
    row, field = np.concatenate(rows).astype(np.int64), np.concatenate(kinds)
    coded = pa.chunked_array(words, words[0].type).combine_chunks().dictionary_encode()
    code, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    if stemmed:
        spelled = pa.array([stem(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
        code, terms = spelled.indices.to_numpy().astype(np.int64)[code], spelled.dictionary
    if only is not None:
        hit = pc.is_in(terms, pa.array(list(only), terms.type)).to_numpy(zero_copy_only=False)[code]
        row, field, code = row[hit], field[hit], code[hit]
    pairs, at = np.unique(row * max(1, len(terms)) + code, return_inverse=True)
    n = lambda mask: np.bincount(at[mask], minlength=len(pairs))
    freq = np.maximum(n(field != 2), 1)
    row, code = np.divmod(pairs, max(1, len(terms)))
    columns = [terms.take(pa.array(code)), b["page_id"].take(pa.array(row)), freq, n(field == 1) > 0, n(field == 2) > 0]
    out = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["term", "page_id", "freq", "in_title", "in_domain"])
    for start in range(0, out.num_rows, POSTING_ROWS):
        yield out.slice(start, POSTING_ROWS)


def term_dictionary(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def document_lengths(pages: DataFrame) -> DataFrame:
    """page_id, token_count: title and body tokens of the pages whose title is admitted."""
    return pages.where(title_admitted(F.col("title"))).select("page_id", (F.size(tokens(F.col("text"))) + F.size(tokens(F.col("title")))).cast("long").alias("token_count"))


def corpus_statistics(doc_stats: DataFrame, floor_average: bool = True) -> DataFrame:
    """document_count, total_token_count, average_doc_length (whole, as the stored form is, or exact); 0 for no documents."""
    avg = F.when(F.count("*") == 0, F.lit(0.0)).otherwise(F.sum("token_count") / F.count("*"))
    return doc_stats.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_token_count"), (F.floor(avg).cast("double") if floor_average else avg).alias("average_doc_length"))


def build_index(pages: DataFrame, stemmed: bool = True, with_domain: bool = True, floor_average: bool = True) -> Index:
    posts = page_postings(pages, stemmed, with_domain)
    stats = document_lengths(pages)
    return Index(posts, term_dictionary(posts), stats, corpus_statistics(stats, floor_average))


def query_index(pages: DataFrame, terms: Collection[str], stemmed: bool = True, with_domain: bool = True, floor_average: bool = True) -> Index:
    """What a query of these terms reads of the pages' index: their postings alone, and every page's length."""
    posts, stats = materialise(page_postings(pages, stemmed, with_domain, terms)), materialise(document_lengths(pages))
    return Index(posts, term_dictionary(posts), stats, corpus_statistics(stats, floor_average))


def posting_offsets(terms: DataFrame, record: int = 10) -> DataFrame:
    """term, df, byte_offset of its records when postings lie in order of term.

    Terms are ranged into spark.sql.shuffle.partitions parts whose sizes are summed first, so no task sees all of them.
    """
    n = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written with its part's number, so that terms are made once and parts are joined by equality
    parted = materialise(terms.repartitionByRange(n, "term").withColumn("__part", F.spark_partition_id()))
    sizes = parted.groupBy("__part").agg(F.sum("df").alias("size"))
    base = sizes.select("__part", F.coalesce(F.sum("size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    keyed = parted.join(F.broadcast(base), "__part")
    inside = Window.partitionBy("__part").orderBy("term").rowsBetween(Window.unboundedPreceding, -1)
    return keyed.select("term", "df", ((F.col("base") + F.coalesce(F.sum("df").over(inside), F.lit(0))) * record).cast("long").alias("byte_offset"))


def write_index(index: Index, path: str) -> None:
    """Postings in ranges of (term, page), sorted, so that a term's row groups are found by their statistics and a hot term has many."""
    index.postings.repartitionByRange("term", "page_id").sortWithinPartitions("term", "page_id").write.mode("overwrite").parquet(f"{path}/postings")
    spark = index.postings.sparkSession
    term_dictionary(spark.read.parquet(f"{path}/postings")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    index.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
    index.meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def stored(index: Index) -> Index:
    """The index as written to the shared folder: every posting is made once, whatever is asked of it afterwards."""
    path = shared_dir(index.postings.sparkSession)
    write_index(index, path)
    return read_index(index.postings.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "doc_stats", "meta")])


def postings_bytes(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """term, block, df, byte_offset and records of a block of pages: each posting's 10 little-endian bytes (page_id and freq in 4 each, in_title, in_domain), by page.

    The terms' records, one after another in order of term, are the bytes that the offsets point into.
    Ids and frequencies beyond 32 bits don't fit the form and fail.
    """

    def pack(lists: pa.Array) -> pa.Array:
        kind = np.dtype([("page", "<u4"), ("freq", "<u4"), ("title", "u1"), ("domain", "u1")])
        out = []
        for ps in lists.to_pylist():
            if any(max(p["page_id"], p["freq"]) >= 1 << 32 or p["page_id"] < 0 for p in ps):
                raise ValueError("a page id or frequency doesn't fit 32 bits")
            out.append(np.array([(p["page_id"], p["freq"], p["in_title"], p["in_domain"]) for p in ps], kind).tobytes())
        return pa.array(out, pa.binary())

    lists = materialise(posting_lists(posts.where("page_id IS NOT NULL")))
    before = F.sum(F.size("postings")).over(Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = lists.select("term", "block", (10 * F.coalesce(before, F.lit(0))).alias("__start"))
    placed = posting_offsets(terms).join(starts, "term").join(lists, ["term", "block"])
    return placed.select("term", "block", "df", (F.col("byte_offset") + F.col("__start")).alias("byte_offset"), F.arrow_udf(pack, "binary")("postings").alias("records"))


def posting_lists(posts: DataFrame, pages: int = BLOCK_PAGES) -> DataFrame:
    """term, block and the term's postings of a block of pages as one array, by page: no row holds all of a hot term."""
    entry = F.struct("page_id", "freq", "in_title", "in_domain")
    return posts.groupBy("term", F.floor(F.col("page_id") / pages).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("postings"))
