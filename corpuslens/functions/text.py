"""Text columns: tokens, shingles, numbers, versions, overlaps, names. All stay in the JVM.

Null texts count as empty. Classes are spelled out (letters and numbers of any script), so that
they mean the same in every engine; decimal digits of any script count as digits.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number, a version and white space.
NUMBER = r"(?<![\p{L}\p{N}_])[0-9]+(?:[.,][0-9]+)?(?![\p{L}\p{N}_])"
VERSION = r"(?i)v?([0-9]+\.[0-9]+(?:\.[0-9]+)*)(?![\p{L}\p{N}_])"
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_DIGITS = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd"]
DIGITS, PLAIN_DIGITS = "".join(_DIGITS), "".join(str(unicodedata.decimal(c)) for c in _DIGITS)
_EMPTY = "array<string>"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _digits(c: Column | str) -> Column:
    """The text with the decimal digits of other scripts as 0 to 9."""
    t = _text(c)
    return F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, DIGITS, PLAIN_DIGITS)).otherwise(t)


def words(c: Column | str) -> Column:
    """Runs of letters, digits and _, lower-cased."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def word_line(c: Column | str) -> Column:
    """The words of ``words`` with one space between."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), r"[^\p{L}\p{N}_]+", " "))


def shingles_of(w: Column, k: int = 3) -> Column:
    """Distinct k-word shingles of a word list; short lists give one shingle of all their words."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
    return F.when(n < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))


def numbers(c: Column | str) -> Column:
    """Distinct numbers; a comma is deleted, so 2,5 is 25."""
    found = F.regexp_extract_all(_digits(c), F.lit(NUMBER), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))))


def versions(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_digits(c), F.lit(VERSION), F.lit(1))))


def mask_numbers(c: Column | str) -> Column:
    return F.regexp_replace(_digits(c), NUMBER, "__NUM__")


def mask_versions(c: Column | str) -> Column:
    return F.regexp_replace(_digits(c), VERSION, "__VER__")


def word_set(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(_text(c)), SPACE + "+"), lambda x: x != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """Two empty sets have 1."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def numeric_contradiction(na: Column, nb: Column, ca: Column, cb: Column) -> Column:
    """Score of a numeric contradiction, null if there is none; na, nb: numbers, ca, cb: masked word sets."""
    hit = (F.size(na) > 0) & (F.size(nb) > 0) & (na != nb) & (set_jaccard(ca, cb) >= 0.5)
    return F.when(hit, F.round(1 - set_jaccard(na, nb), 4))


def version_contradiction(va: Column, vb: Column, ca: Column, cb: Column) -> Column:
    hit = (F.size(va) > 0) & (F.size(vb) > 0) & (va != vb) & (set_jaccard(ca, cb) >= 0.5)
    return F.when(hit, F.lit(1.0))


def preview(c: Column | str, n: int) -> Column:
    return F.substring(_text(c), 1, n)


def clean_spaces(c: Column | str) -> Column:
    """Drops NUL and zero-width signs, collapses white space (NFKC: see operators.chunking)."""
    t = F.regexp_replace(_text(c), "[\\x00\\u200B\\u200C\\u200D\\uFEFF]", "")
    return F.trim(F.regexp_replace(t, SPACE + "+", " "))


def slug(c: Column | str) -> Column:
    """Collection name of a text in NFKC form: lower case, other signs to -, runs collapsed, 60 characters.

    Fixed values of the name format: names under 3 characters get ``doc-`` in front (``doc-pdf`` if
    nothing is left), and ``documents`` stands for what is still too short.
    """
    t = F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9_-]", "-")
    t = F.regexp_replace(F.regexp_replace(t, "-{2,}", "-"), "^[-_]+|[-_]+$", "")
    t = F.substring(t, 1, 60)
    t = F.when(F.length(t) < 3, F.concat(F.lit("doc-"), F.when(t == "", "pdf").otherwise(t))).otherwise(t)
    t = F.regexp_replace(t, "^[^a-z0-9]+|[^a-z0-9]+$", "")
    return F.when(F.length(t) < 3, "documents").otherwise(t)


#: Fixed value: the format of chunk names.
CHUNK_NAME = "%s-p%03d-c%03d-%s"


def chunk_name(collection: Column, page: Column, chunk: Column, text: Column) -> Column:
    return F.format_string(CHUNK_NAME, collection, page, chunk, F.substring(F.sha1(text), 1, 8))
