"""Text and URL column expressions (all built-in, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickgap.config import UNPARSED_CHARS, URL_STOP_TOKENS

# sklearn-style word tokens: two or more word characters.
WORD_TOKEN = r"\b\w\w+\b"
# scheme, authority, then the path up to query or fragment.
_URL_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_URL_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def normalize_query(c: Column) -> Column:
    """lower, strip, drop apostrophes, non [a-z0-9 whitespace -] -> space,
    collapse whitespace, strip. A missing query becomes "nan"."""
    s = F.lower(F.coalesce(c.cast("string"), F.lit("nan")))
    s = F.when(F.contains(s, F.lit("'")) | F.contains(s, F.lit("’")), F.regexp_replace(s, "[’']", "")).otherwise(s)
    # what becomes a space and the whitespace beside it, in one; listed letters match faster than ranges
    s = F.regexp_replace(s, r"[^abcdefghijklmnopqrstuvwxyz0123456789\-]+", " ")
    return F.trim(s)


def split_words(c: Column) -> Column:
    """Whitespace tokens of a normalised string (hyphens stay inside)."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams of an array<string>, joined by a space, in order."""
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(0), F.size(tokens) - n),
                    lambda i: F.array_join(F.slice(tokens, i + 1, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def ngrams_indexed(tokens: Column, n: int) -> Column:
    """array<struct<pos:int, n:int, gram:string>> of the n-grams of ``tokens``."""
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(0), F.size(tokens) - n),
                    lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"),
                                       F.array_join(F.slice(tokens, i + 1, n), " ").alias("gram"))),
    ).otherwise(F.array().cast("array<struct<pos:int,n:int,gram:string>>"))


def word_tokens(c: Column) -> Column:
    """Tokens of two or more word characters (the vectoriser's default)."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_TOKEN), 0)


def url_path(c: Column) -> Column:
    """Path component of a URL; ``;params`` of the last segment cut off. A
    missing URL reads "nan"; a URL whose authority has an unbalanced
    bracket cannot be parsed and stands for its path with its first
    UNPARSED_CHARS characters."""
    whole = F.coalesce(c.cast("string"), F.lit("nan"))
    u = F.regexp_replace(whole, r"[\t\r\n]", "")
    u = F.regexp_replace(u, r"^[\x00-\x20]+", "")
    path = F.regexp_extract(u, _URL_PATH, 1)
    # params start at the first ';' after the last '/'
    path = F.regexp_replace(path, r";[^/]*$", "")
    authority = F.regexp_extract(u, _URL_AUTHORITY, 1)
    broken = authority.contains("[") != authority.contains("]")
    return F.when(broken, F.left(whole, F.lit(UNPARSED_CHARS))).otherwise(path)


def _outer_path(c: Column) -> Column:
    return F.regexp_replace(url_path(c), r"^/+|/+$", "")


def url_slug(c: Column) -> Column:
    """Path without outer slashes; empty -> "home"."""
    s = _outer_path(c)
    return F.when(s == "", F.lit("home")).otherwise(s)


def url_tokens(c: Column) -> Column:
    """Path split on / - _, lower-cased, non [a-z0-9] removed, stop tokens and
    empties dropped; an empty path gives ["home"]."""
    path = _outer_path(c)
    parts = F.split(path, r"[/\-_]+")
    cleaned = F.transform(parts, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", ""))
    stop = F.array(*[F.lit(s) for s in URL_STOP_TOKENS])
    kept = F.filter(cleaned, lambda t: (t != "") & ~F.array_contains(stop, t))
    return F.when(path == "", F.array(F.lit("home"))).otherwise(kept)
