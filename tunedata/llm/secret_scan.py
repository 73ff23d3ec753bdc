"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

One pass over the text keeps, per row, only lengths of matches and of the pieces
between them, and the candidate strings; the text itself is not shuffled.
Positions are running sums of those lengths.

Entropy: a candidate is a long run of key characters.  For a window of ``window``
characters the entropy is ``log2(w) - sum(c * log2(c)) / w`` over the character
counts ``c``.  The sum is kept by increments: a character that enters raises its count
from ``c - 1`` to ``c``, one that leaves lowers it, and both counts come from range
frames over the positions of that character.  The increments are integers
(millionths of a bit), so the running sum is exact and the same in any order of work.
A window is hot when its entropy reaches the bits asked for the candidate's
character class.  Candidates are cut into pieces that overlap by ``window - 1`` characters, so a run of any
length is many small groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunedata.llm.common import staged, text_of

ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: kind -> (pattern, group whose length counts, least length); in the order of ties
KINDS = {"assign": (ASSIGN, 2, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]{32,}", 0, 32)}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: candidates that look like words or paths (``WORDS`` without ``HUMP``: no letter before a capital) ...
WORDS, HUMP = r"[A-Za-z_/+-]+", r"[A-Za-z][A-Z]"
#: ... or like capitals, numbers or identifiers rather than keys.  No pattern repeats a group: Java would recurse for each repetition.
ALLOW = (r"[A-Z_-]+", r"[0-9]+", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
#: placeholders count as a run of one character, which leaves the windows around them cold
PLACEHOLDER, FILLER = r"EXAMPLE|example", "xxxxxxx"
#: windows of a candidate that are examined together
PIECE = 4096
WINDOW = 20
#: character class -> least bits for each character (at most log2(20) = 4.32)
BITS = {"hex": 3.0, "base64": 3.6}


def _micro(window: int) -> list[int]:
    """c * log2(c) in millionths for counts up to ``window``."""
    return [0] + [round(c * math.log2(c) * 1_000_000) for c in range(1, window + 1)]


def _most(window: int, bits: float) -> int:
    """Largest sum of c * log2(c) (millionths) at which a window has the bits asked for."""
    return math.floor(1_000_000 * window * (math.log2(window) - bits))


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Per match: length of the piece before it, its length, whether it is long enough."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("len"),
                          F.transform(sized, lambda x: F.length(x) >= least).alias("ok"))
    none = F.array().cast("array<struct<gap:int,len:int,ok:boolean>>")
    return F.when(F.size(found) > 0, zipped).otherwise(none)


def scan_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One small row per input row: row number, id, match lengths by kind, candidates."""
    text = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    found = F.regexp_extract_all("_t", F.lit(CANDIDATE), F.lit(0))
    cands = F.when(F.size(found) > 0, F.arrays_zip(F.transform(F.split("_t", CANDIDATE, -1), F.length).alias("gap"), found.alias("str")))
    return text.select("_id", F.monotonically_increasing_id().alias("_rid"),
                       *[_matches(F.col("_t"), *spec).alias(k) for k, spec in KINDS.items()],
                       F.coalesce(cands, F.array().cast("array<struct<gap:int,str:string>>")).alias("cand"))


def _starts(rows: DataFrame, length: Column) -> DataFrame:
    """Add ``start`` and ``end`` from the lengths before: running sums by row and kind (``_k`` numbers the matches)."""
    w = Window.partitionBy("_rid", "kind").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap").cast("long") + length).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - length)


def base_spans(scan: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the pattern matches that are long enough."""
    each = [scan.select("_rid", F.lit(k).alias("kind"), F.posexplode(k).alias("_k", "x")) for k in KINDS]
    rows = each[0].unionByName(each[1]).unionByName(each[2]).where(F.col("x.len").isNotNull())
    return _starts(rows, F.col("x.len").cast("long")).where("x.ok").select("_rid", "kind", "start", "end")


def entropy_spans(scan: DataFrame, window: int = WINDOW, bits: dict[str, float] | None = None,
                  allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(row, 'entropy', start, end): from the first to the last hot window of each candidate."""
    bits = bits or BITS
    rows = scan.select("_rid", F.lit("entropy").alias("kind"), F.posexplode("cand").alias("_k", "x")).where(F.col("x.str").isNotNull())
    cands = _starts(rows, F.length("x.str").cast("long")).select("_rid", "_k", "start", F.col("x.str").alias("_s"))
    wordlike = F.col("_s").rlike(f"^{WORDS}$") & ~F.col("_s").rlike(HUMP)
    cands = cands.where(~wordlike & ~F.col("_s").rlike("^(?:" + "|".join(allow) + ")$"))
    cands = cands.withColumn("_class", F.when(F.col("_s").rlike("^[0-9a-fA-F]+$"), "hex").otherwise("base64"))
    # pieces are spread before their characters are: the exchange carries strings, not characters (all ASCII, cut as bytes)
    plain = F.regexp_replace("_s", PLACEHOLDER, FILLER).cast("binary")
    last = F.greatest(F.lit(0), F.octet_length("_b") - window)
    pieces = cands.withColumn("_b", plain).select("_rid", "_k", "start", "_class", "_b", F.explode(F.sequence(F.lit(0), last, F.lit(PIECE))).alias("_a"))
    pieces = pieces.withColumns({"_b": F.substring("_b", F.col("_a") + 1, F.lit(PIECE + window - 1)).cast("string"), "start": F.col("start") + F.col("_a")})
    chars = pieces.repartition("_rid", "_k", "_a").select("_rid", "_k", "_a", "start", "_class", F.posexplode(F.split("_b", "")).alias("_p", "_c"))
    same = Window.partitionBy("_rid", "_k", "_a", "_c").orderBy("_p")
    micro = F.array(*[F.lit(x).cast("long") for x in _micro(window)])

    def rise(count: Column) -> Column:
        return F.get(micro, count.cast("int")) - F.get(micro, count.cast("int") - 1)
    chars = chars.withColumns({"_in": rise(F.count(F.lit(1)).over(same.rangeBetween(1 - window, 0))),
                               "_out": rise(F.count(F.lit(1)).over(same.rangeBetween(0, window - 1)))})
    run = Window.partitionBy("_rid", "_k", "_a").orderBy("_p")
    total = (F.sum("_in").over(run.rowsBetween(Window.unboundedPreceding, 0))
             - F.coalesce(F.sum("_out").over(run.rowsBetween(Window.unboundedPreceding, -window)), F.lit(0).cast("long")))
    most = F.when(F.col("_class") == "hex", F.lit(_most(window, bits["hex"]))).otherwise(F.lit(_most(window, bits["base64"])))
    hot = chars.withColumn("_sum", total).where((F.col("_p") >= window - 1) & (F.col("_sum") <= most))
    return hot.groupBy("_rid", "_k").agg(
        F.lit("entropy").alias("kind"), F.min(F.col("start") + F.col("_p") - (window - 1)).alias("start"),
        F.max(F.col("start") + F.col("_p") + 1).alias("end")).select("_rid", "kind", "start", "end")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 bits: dict[str, float] | None = None, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Per input row: id and ``spans``, an array of (start, rank, kind, end) sorted by start, then kind.

    Positions are code points, ends exclusive.  Kinds: ``assign``, ``access``, ``hex``
    (pattern matches, leftmost and not overlapping within a kind, kept when long
    enough) and ``entropy``.  Spans of different kinds may overlap; an entropy span
    never removes another.  Null text counts as empty and has no span (an empty
    array).  Texts and runs of any length are scanned whole.  Repeated rows have a result each.  Other columns are not looked at.  An
    empty table gives an empty result.
    """
    scan = staged(scan_rows(docs, id_col, text_col), "secret-scan")
    spans = base_spans(scan).unionByName(entropy_spans(scan, window, bits, allow))
    rank = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "entropy")]), F.col("kind")).cast("int")
    spans = spans.withColumn("rank", rank).groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return (scan.select("_rid", "_id").join(spans, "_rid", "left")
            .select(F.col("_id").alias(id_col), F.coalesce("spans", empty).alias("spans")))
