"""Text helpers with Python ``str`` semantics, as native Spark expressions.

Spark's ``trim`` removes spaces only and Java's ``\\s`` is ASCII, while the
reference uses ``str.strip()`` / ``str.split()`` which treat every Unicode
whitespace code point as a separator.  We spell that class out once; the same
pattern text works in Java regex (Spark) and RE2 (DuckDB oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points for which Python's str.isspace() is true, as ranges.
WS_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
             (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
WS_CHARS = "".join(chr(c) for lo, hi in WS_RANGES for c in range(lo, hi + 1))
# the same set as a regex class (Java regex in Spark, RE2 in the DuckDB oracle)
WS_CLASS = "[" + "".join(f"\\x{{{lo:02X}}}" if lo == hi else f"\\x{{{lo:02X}}}-\\x{{{hi:02X}}}"
                         for lo, hi in WS_RANGES) + "]"
WS_RUN = WS_CLASS + "+"

# Fixed value: token rule of the public rouge-score package (lower-case, then
# every run of characters outside [a-z0-9] is a separator).
ROUGE_SEPARATOR = r"[^a-z0-9]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ustrip(col) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace.

    ``trim(str, chars)`` walks in from both ends over the character set; no
    regex scan of the whole text.
    """
    return F.trim(_c(col), F.lit(WS_CHARS))


def is_missing(col) -> Column:
    """Null, or blank after ``str(v).strip()``."""
    c = _c(col)
    return c.isNull() | (ustrip(c.cast("string")) == F.lit(""))


def tokens(col) -> Column:
    """``str.split()``: split on Unicode whitespace runs, drop empty pieces.

    Every whitespace code point is first mapped to ' ' (``translate``, one pass),
    then split on the single character, which avoids a regex per row.
    """
    spaced = F.translate(F.coalesce(_c(col), F.lit("")), WS_CHARS, " " * len(WS_CHARS))
    return F.filter(F.split(spaced, " "), lambda t: t != F.lit(""))


def lower_tokens(col) -> Column:
    """``s.strip().lower().split()`` used by BLEU-1 and ROUGE-L of the reference."""
    return tokens(F.lower(_c(col)))


def rouge_tokens(col) -> Column:
    """Token rule of the rouge-score package, without stemming."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(_c(col), F.lit(""))), ROUGE_SEPARATOR, " ")
    return F.filter(F.split(cleaned, " "), lambda t: t != F.lit(""))


def word_count(col) -> Column:
    return F.size(tokens(col))


def estimate_tokens(col) -> Column:
    """Heuristic token count: ``max(1, int(words * 1.3))``, 0 for blank text.

    Integer arithmetic (floor(words * 13 / 10)) equals Python's float truncation
    for every realistic word count and keeps the expression exact.
    """
    n = F.size(tokens(col)).cast("long")
    est = F.greatest(F.lit(1).cast("long"), F.floor(n * 13 / 10).cast("long"))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(est)


def round_exact(col, digits: int) -> Column:
    """Python's ``round(x, digits)``: the decimal nearest to the binary value, real ties to even.

    Where the double product ``x * 10^d`` lands on .5, the sign of its rounding error says on which
    side the exact product lies.  The error comes from splitting ``x`` in two halves
    whose products with ``10^d`` are exact.  The DuckDB oracle computes the same (``sqlfrag.rnd``).
    """
    scale = float(10 ** digits)
    x = _c(col).cast("double")
    product = x * F.lit(scale)
    low = F.floor(product).cast("double")
    rest = product - low
    big = x * F.lit(134217729.0)                 # 2^27 + 1
    head = big - (big - x)
    error = (head * F.lit(scale) - product) + (x - head) * F.lit(scale)
    up = (F.when(rest > 0.5, 1.0).when(rest < 0.5, 0.0).when(error > 0, 1.0).when(error < 0, 0.0)
          .otherwise(F.pmod(low, F.lit(2.0))))
    return (low + up) / F.lit(scale)


def round4(col) -> Column:
    return round_exact(col, 4)


def round2(col) -> Column:
    return round_exact(col, 2)
