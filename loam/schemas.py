"""Schemas of the engine's tables."""

from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PAGE = _struct(
    page_id=L, request_url=S, final_url=S, host=S, title=S, og_title=S, favicon=S, description=S, text=S, links=T.ArrayType(S), status_code=I,
    crawled_at=T.TimestampType(), content_hash=L, found_canonical=S, in_english=B, has_been_crawled=B, resolved_canonical=B, duplicate_of=L,
)
POSTING = _struct(term=S, page_id=L, freq=L, in_title=B, in_domain=B)
DOC_STATS = _struct(page_id=L, token_count=L)
INDEX_META = _struct(id=L, document_count=L, total_token_count=L, average_doc_length=L, created_at=T.TimestampType())
PARSED = _struct(title=S, og_title=S, favicon=S, description=S, text=S, links=T.ArrayType(S), found_canonical=S, in_english=B, has_been_crawled=B)
