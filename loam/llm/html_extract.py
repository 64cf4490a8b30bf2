"""Main text of web pages by line-block distribution.

Markup is stripped so that block elements end lines; the text lengths of WINDOW lines from each line on
are summed; a line whose sum reaches SURGE opens a region, one whose sum is at most DIVE closes it, and
the lines of text inside regions are the page's text.  All of it is built-in expressions: pages never
leave the JVM and nothing is shuffled.

Comments and what is in title, script, style, noscript, template and iframe elements are no text; all other text of a
page is, whichever optional tags it leaves out.  A tag ends at the first > outside of quoted attribute values.
Character references are decoded once: numbers, and every HTML5 name (those that need no semicolon also without, where
no letter or digit follows).

Defined results: null or empty html gives an empty text and 0 lines; a page without a surge gives an empty
text; rows are treated each alone, so null or repeated ids and ties change nothing; an empty table gives an empty
result; other columns, whatever their names, are not read; pages of any length are read whole; unclosed comments,
scripts, titles and tags run to the end of the page; references to no character give U+FFFD; references to line ends,
tabs and no-break spaces give spaces; unknown names stay as they are.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE, DIVE = 3, 86, 20

#: The rest of a tag after its name, up to the > outside quotes; of two spellings, the first never goes back on what it took.
_REST = "(?:[^>=]++|= *+(?:\"[^\"]*+\"|'[^']*+')|=)*+(?:>|\\z)"
_RAW = ("title", "script", "style", "noscript", "template", "iframe")
_GONE = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(f"<{t}\\b{_REST}.*?(?:</{t}\\b[^>]*(?:>|\\z)|\\z)" for t in _RAW)
_BLOCK = (
    "(?i)</?(?:p|div|li|tr|td|th|h[1-6]|br|hr|ul|ol|dl|dt|dd|table|thead|tbody|tfoot|caption|article|section|header|footer|nav|aside|main|body|head|html|"
    "blockquote|pre|form|fieldset|figure|figcaption|details|summary|dialog|select|option|textarea|button|center|address)\\b" + _REST
)
_TAG = "<[a-zA-Z/!?]" + _REST
_SPACES = str.maketrans("\n\r\t\f\u00a0", " " * 5)
#: Characters by reference name, with its semicolon if it has one.
_NAMES = {name: sign.translate(_SPACES) for name, sign in html5.items()}
_COMMON = ["amp;", "nbsp;", "lt;", "gt;", "quot;", "apos;", "copy;", "middot;"]
#: What numbers in a range that holds no characters stand for.
_OLD = {n: bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}
_REFERENCE = "^(#[0-9]{1,18}|#[xX][0-9a-fA-F]{1,15}|[A-Za-z][A-Za-z0-9]{1,31});?"


def _decoded(pieces: Column) -> Column:
    """Of a text split at & what its character references, each once, make of it; what a reference gives is not looked at again."""
    # maps are searched entry by entry, so the commonest names have one of their own
    table = lambda names: F.str_to_map(F.lit("\x01".join(f"{k}\x02{_NAMES[k]}" for k in names)), F.lit("\x01"), F.lit("\x02"))
    common, names = table(_COMMON), table(_NAMES)
    old = F.create_map(*[F.lit(x) for pair in _OLD.items() for x in pair])

    def sign(code: Column) -> Column:
        right = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        text = F.when(code.isin(9, 10, 12, 13, 160), " ").when(code.between(128, 159), F.element_at(old, code.cast("int")))
        return text.when(right, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def head(piece: Column) -> Column:
        return F.named_struct(F.lit("p"), piece, F.lit("w"), F.regexp_extract(piece, _REFERENCE, 0))

    def one(x: Column) -> Column:
        piece, w = x["p"], x["w"]
        digits = F.rtrim(w, F.lit(";"))
        number = F.when(F.lower(F.substring(w, 2, 1)) == "x", F.conv(F.substring(digits, 3, 15), 16, 10)).otherwise(F.substring(digits, 2, 18)).cast("long")
        found = F.when(w == "", None).when(w.startswith("#"), F.element_at(F.transform(F.array(number), sign), 1)).otherwise(F.coalesce(F.try_element_at(common, w), F.try_element_at(names, w)))
        return F.coalesce(F.concat(found, F.substr(piece, F.length(w) + 1)), F.concat(F.lit("&"), piece))

    rest = F.transform(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), head), one)
    return F.when(F.size(pieces) > 1, F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))).otherwise(F.element_at(pieces, 1))


def extract_text(pages: DataFrame, window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> DataFrame:
    """page_id, text, n_lines (lines of text in the page), n_kept (those inside regions)."""
    if window < 1 or dive >= surge:
        raise ValueError("a window has a line at least, and dive must be below surge")
    s = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), "[\r\n\t\f\u00a0]+", " ")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, _GONE, ""), _BLOCK, "\n"), _TAG, "")
    out = pages.select("page_id", F.split(s, "&").alias("pieces"))
    s = F.regexp_replace(F.regexp_replace(_decoded(F.col("pieces")), " +", " "), " ?\n ?", "\n")
    out = out.select("page_id", F.transform(F.split(s, "\\n"), lambda x: F.trim(x)).alias("lines"))
    out = out.withColumn("sizes", F.transform("lines", lambda x: F.length(x)))
    sums = F.transform("sizes", lambda _, i: sum((F.coalesce(F.get("sizes", i + k), F.lit(0)) for k in range(1, window)), F.get("sizes", i)))
    out = out.withColumn("states", F.array_join(F.transform(sums, lambda b: F.when(b >= surge, "S").when(b <= dive, "D").otherwise("-")), ""))
    # between dives, all from the first surge on is inside
    opened = F.transform(F.split("states", "D"), lambda p: F.concat(
        F.repeat(F.lit("-"), F.when(F.instr(p, "S") == 0, F.length(p)).otherwise(F.instr(p, "S") - 1)),
        F.repeat(F.lit("K"), F.when(F.instr(p, "S") == 0, F.lit(0)).otherwise(F.length(p) - F.instr(p, "S") + 1)),
    ))
    out = out.withColumn("inside", F.split(F.array_join(opened, "D"), ""))
    # zipped: as an index into it, all of inside would be made again for every line
    zipped = F.arrays_zip("lines", "inside")
    kept = F.transform(F.filter(zipped, lambda x: (x["lines"] != "") & (x["inside"] == "K")), lambda x: x["lines"])
    out = out.withColumn("kept", kept)
    return out.select(
        "page_id",
        F.array_join("kept", "\n").alias("text"),
        F.size(F.filter("lines", lambda x: x != "")).cast("long").alias("n_lines"),
        F.size("kept").cast("long").alias("n_kept"),
    )


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    re2 = lambda p: q(p.replace("++", "+").replace("*+", "*"))
    s = f"regexp_replace(regexp_replace(coalesce(html, ''), '[\\r\\n\\t\\f\\x{{a0}}]+', ' ', 'g'), '{re2(_GONE)}', '', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '{re2(_BLOCK)}', chr(10), 'g'), '{re2(_TAG)}', '', 'g')"
    names = "MAP {" + ", ".join(f"'{k}': '{q(v)}'" for k, v in _NAMES.items()) + "}"
    old = "[" + ", ".join(f"'{v}'" for v in _OLD.values()) + "]"
    number = "(CASE WHEN lower(n[2]) = 'x' THEN ('0x' || n[3:])::BIGINT ELSE n[2:]::BIGINT END)"
    sign = f"CASE WHEN {number} IN (9, 10, 12, 13, 160) THEN ' ' WHEN {number} BETWEEN 128 AND 159 THEN {old}[{number} - 127] WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN chr({number}::INT) ELSE chr(65533) END"
    found = f"CASE WHEN n[1] = '#' THEN {sign} WHEN n <> '' THEN {names}[w] END"
    return f"""
WITH h AS (SELECT row_number() OVER () AS r, page_id, {s} AS s FROM pages),
e AS (SELECT r, unnest(string_split(s, '&')) AS piece, unnest(range(len(string_split(s, '&')))) AS i FROM h),
f AS (SELECT *, regexp_extract(piece, '{_REFERENCE}', 0) AS w, regexp_extract(piece, '{_REFERENCE}', 1) AS n FROM e),
g AS (SELECT r, string_agg(CASE WHEN i = 0 THEN piece ELSE coalesce(({found}) || piece[len(w) + 1:], '&' || piece) END, '' ORDER BY i) AS s FROM f GROUP BY r),
a AS (SELECT r, page_id, list_transform(string_split(regexp_replace(regexp_replace(g.s, ' +', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')) AS lines FROM h JOIN g USING (r)),
b AS (SELECT r, page_id, unnest(lines) AS x, unnest(range(1, len(lines) + 1)) AS i FROM a),
c AS (SELECT *, length(x) + {' + '.join(f'coalesce(lead(length(x), {k}) OVER w, 0)' for k in range(1, WINDOW))} AS s FROM b WINDOW w AS (PARTITION BY r ORDER BY i)),
d AS (SELECT *, last_value(CASE WHEN s >= {SURGE} THEN 1 WHEN s <= {DIVE} THEN 0 END IGNORE NULLS)
      OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inside FROM c)
SELECT page_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (inside = 1 AND x <> ''), '') AS text,
       count(*) FILTER (x <> '') AS n_lines, count(*) FILTER (inside = 1 AND x <> '') AS n_kept
FROM d GROUP BY r, page_id"""


EXTRACT_SQL = _sql()
