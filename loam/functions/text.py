"""Text expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.let import let


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and numbers, in order; combining marks split words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def collapse(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, "[\\s\\x{85}\\p{Z}]+", " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(collapse(text) == "", F.lit(True))


def first_words(text: Column, n: int) -> Column:
    """The first n words joined by one space; the text as it is if it has no more."""
    words = F.filter(F.split(text, "[\\s\\x{85}\\p{Z}]+"), lambda w: w != "")
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(text)


def snippet(description: Column, limit: int = 300, words: int = 40) -> Column:
    """A description of more than limit bytes is cut to its first words and ends in an ellipsis."""
    cut = first_words(description, words)
    return F.when(F.octet_length(description) > limit, F.when(cut.endswith("."), F.concat(cut, F.lit(".."))).otherwise(F.concat(cut, F.lit("...")))).otherwise(description)


def title_admitted(title: Column, limit: int = 100) -> Column:
    """Pages with longer titles, in bytes, are not indexed."""
    return F.octet_length(F.coalesce(title, F.lit(""))) <= limit


def description_unless_title(description: Column, title: Column) -> Column:
    return F.when(description == title, "").otherwise(description)


def status_class(code: Column) -> Column:
    """'success', 'client_error', 'server_error' or 'other'."""
    return F.when(code.between(200, 299), "success").when(code.between(400, 499), "client_error").when(code.between(500, 599), "server_error").otherwise("other")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def chunk(fingerprint: Column, band: int, width: int = 16) -> Column:
    """The band-th run of width bits, from the least."""
    return F.shiftrightunsigned(fingerprint, band * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def bit_list(fingerprint: Column) -> Column:
    """64 zeros and ones, the most significant first."""
    return F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), lambda i: F.getbit(fingerprint, i).cast("int"))


def to_flag(b: Column) -> Column:
    return b.cast("long")


def shingles(text: Column, n: int = 8) -> Column:
    """Runs of n parts between single spaces, an empty part after a final space included; none of fewer."""

    def runs(parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(parts) - n + 1, F.lit(1)))
        return F.when(F.size(parts) < n, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(parts, i, F.lit(n)), " ")))

    return let(F.split(text, " "), runs)
