"""Order-dependent building blocks that never put one group in one task.

``Window.partitionBy(key)`` sends every row of a key to one task; if one key
holds a third of the table, that task does a third of the work.  Here a global
order is computed with a range shuffle (which splits a hot key across many
partitions), per-partition positions, and a tiny broadcast table of partition
offsets.  "Row number within group", "next row" and "previous row" then become
equi-joins on unique keys, which spread evenly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunedata.session import ensure_checkpoint_dir, staged


def _order_cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_rank(df: DataFrame, order_cols, rank_col: str = "_rank",
                num_partitions: int | None = None, total_col: str | None = None) -> DataFrame:
    """Add a 0-based global position by ``order_cols`` (which must be a total order).

    Plan: range exchange -> local sort -> (partition id, position) in the same
    codegen stage, checkpointed; the per-partition row counts are broadcast --
    one row per partition, a proven size bound.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = _order_cols(order_cols)
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    # Range bounds are sampled per exchange and the ids are positional, so the
    # tagged rows are materialised once (reliable checkpoint in the shared
    # checkpoint folder): every later branch and every task retry then sees the
    # same partitions and positions.  (The checkpoint's write job re-reads the
    # range shuffle's map output rather than recomputing it, so no persist.)
    ensure_checkpoint_dir(spark)
    tagged = (ranged
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("long"), 33))
              .checkpoint(eager=True))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a global window over it is bounded by the partition count
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(Window.partitionBy(F.lit(0))).alias(total_col)] if total_col else []
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"), *extra)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(rank_col, (F.col("_off") + F.col("_pos")).cast("long"))
            .drop("_pid", "_pos", "_off"))


def row_number_in_group(df: DataFrame, group_cols: list[str], order_cols,
                        out_col: str = "rn") -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order)`` without a per-key task.

    Group start = min global rank of the group (partial aggregation, skew-safe);
    joining it back is an equi-join that AQE's skew handling can split.
    """
    ranked = global_rank(df, list(group_cols) + list(order_cols), "_grank")
    starts = ranked.groupBy(*group_cols).agg(F.min("_grank").alias("_gstart"))
    return (ranked.join(starts, list(group_cols))
            .withColumn(out_col, (F.col("_grank") - F.col("_gstart") + 1).cast("long"))
            .drop("_grank", "_gstart"))


def neighbour_in_group(df: DataFrame, group_cols: list[str], order_cols, value_cols: list[str],
                       offset: int = 1, prefix: str = "next_") -> DataFrame:
    """``lead``/``lag`` (offset +1 / -1) of ``value_cols`` within a group.

    The neighbour is found by an equi-join on global rank +- offset and kept only
    when it belongs to the same group.
    """
    ranked = global_rank(df, list(group_cols) + list(order_cols), "_grank")
    other = ranked.select(
        (F.col("_grank") - offset).alias("_grank"),
        *[F.col(g).alias(f"_ng_{g}") for g in group_cols],
        *[F.col(v).alias(f"_nv_{v}") for v in value_cols])
    joined = ranked.join(other, "_grank", "left")
    same = F.lit(True)
    for g in group_cols:
        same = same & F.col(g).eqNullSafe(F.col(f"_ng_{g}"))
    for v in value_cols:
        joined = joined.withColumn(prefix + v, F.when(same, F.col(f"_nv_{v}")))
    return joined.drop("_grank", *[f"_ng_{g}" for g in group_cols], *[f"_nv_{v}" for v in value_cols])


def neighbour_by_stretch(df: DataFrame, group_cols: list[str], order_cols: list[str], value_cols: list[str],
                         stretch: Column, offset: int = 1, prefix: str = "next_") -> DataFrame:
    """``lead`` (offset 1) / ``lag`` (offset -1) of ``value_cols`` by a total order, without a global rank.

    ``stretch`` cuts a group into runs of bounded length (it must not decrease along the order, e.g. the
    hour of a time or ``floor(n / 1024)`` of a number).  The window runs inside a stretch, so a hot group is
    many small windows; the last row of a stretch gets the edge row of the next stretch that has rows,
    and only these edge rows (one for each stretch) are ordered per group.  Nothing is stored.  Null keys are a group, and rows
    without an order (null stretch) a stretch of it, before the others.  Where stretches can't be bounded by a number, use
    ``neighbour_by_rows``.
    """
    def sort(c) -> Column:
        return F.col(c).asc() if offset > 0 else F.col(c).desc()
    cut = df.withColumn("_cut", stretch)
    w = Window.partitionBy(*group_cols, "_cut").orderBy(*map(sort, order_cols))
    led = cut.withColumns({"_near": F.lead(F.struct(*value_cols)).over(w), "_edge": F.row_number().over(w) == 1})
    along = Window.partitionBy(*group_cols).orderBy(sort("_cut"))
    # the struct tells a null stretch (rows without an order) from no stretch at all
    edges = (led.where("_edge").select(*group_cols, F.lag(F.struct("_cut")).over(along).alias("_to"), F.struct(*value_cols).alias("_far"))
             .where(F.col("_to").isNotNull()))
    keys = [F.col(g).alias(f"_e_{g}") for g in group_cols]
    edges = edges.select(*keys, F.col("_to._cut").alias("_e__cut"), "_far")
    out = led.join(edges, _same([*group_cols, "_cut"], "_e_"), "left")
    near = F.coalesce("_near", "_far")
    return out.select(*df.columns, *[near[c].alias(prefix + c) for c in value_cols])


def _same(cols: list[str], prefix: str) -> Column:
    """Null-safe equality of ``cols`` and their prefixed counterparts."""
    both = [F.col(c).eqNullSafe(F.col(prefix + c)) for c in cols]
    return reduce(lambda a, b: a & b, both, F.lit(True))


# ------------------------------------------------------- runs of equal numbers of rows
#: rows of a run (a power of two)
RUN_BITS = 10


def in_order(df: DataFrame, cols: list[str]) -> DataFrame:
    """Stored rows with ``_at``, a number that grows along ``cols`` (nulls first); ``_at >> RUN_BITS`` names runs of at most
    2^RUN_BITS rows.

    The bounds of the range exchange are quantiles that Spark samples, so parts hold about as many rows each, whatever the
    values: a group or an instant with a third of all rows is spread like any other, and so are rows that are equal in all columns.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in cols]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(n, *order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie"))
    return staged(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "in-order")


def neighbour_by_rows(df: DataFrame, group_cols: list[str], order_cols: list[str], value_cols: list[str],
                      offset: int = 1, prefix: str = "next_") -> DataFrame:
    """``lead`` (offset 1) / ``lag`` (offset -1) by a total order (nulls first) inside groups; null keys are a group.

    No window holds more than 2^RUN_BITS rows: rows are stored in order and cut into runs by number.  The row beyond the
    end of a run comes from the run beside it (one row per run); runs are ordered per task, and tasks among each other (one row per task).
    """
    run, part = F.shiftright("_at", RUN_BITS), F.shiftright("_at", 33)
    rows = in_order(df, [*group_cols, *order_cols]).withColumns({"_run": run, "_g": F.struct(*group_cols)})
    along = Window.partitionBy("_run").orderBy(F.col("_at") if offset > 0 else F.col("_at").desc())
    both = F.struct("_g", F.struct(*value_cols).alias("v"))
    led = rows.withColumns({"_near": F.lead(both).over(along), "_last": F.lead("_at").over(along).isNull()})
    pick = F.min_by if offset > 0 else F.max_by
    ends = rows.groupBy("_run", part.alias("_part")).agg(pick(both, F.col("_at")).alias("_far"))          # the row that a neighbouring run sees
    step = F.col("_run") if offset > 0 else F.col("_run").desc()
    task = F.col("_part") if offset > 0 else F.col("_part").desc()
    tasks = ends.groupBy("_part").agg((F.max if offset > 0 else F.min)("_run").alias("_edge"))             # one row per task
    tasks = tasks.select("_part", F.lag("_edge").over(Window.orderBy(task)).alias("_edge"))
    to = F.coalesce(F.lag("_run").over(Window.partitionBy("_part").orderBy(step)), "_edge")
    seen = ends.join(F.broadcast(tasks), "_part").select(to.alias("_to"), "_far").where(F.col("_to").isNotNull())
    out = led.join(seen, (F.col("_run") == F.col("_to")) & F.col("_last"), "left")
    near = F.coalesce("_near", "_far")
    same = near["_g"].eqNullSafe(F.col("_g"))
    return out.select(*df.columns, *[F.when(same, near["v"][c]).alias(prefix + c) for c in value_cols])


def position_by_rows(df: DataFrame, group_cols: list[str], order_cols: list[str], out_col: str) -> DataFrame:
    """0-based position of a row in its group by a total order (nulls first); null keys are a group.

    A row's number in the whole order is its place in its task plus the rows of earlier tasks (one broadcast row per task); its
    group starts at the least of its numbers, a pre-aggregated minimum.
    """
    part = F.shiftright("_at", 33)
    rows = in_order(df, [*group_cols, *order_cols])
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    number = F.col("_before") + F.col("_at") - F.shiftleft(part, 33)
    ranked = rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_no", number)
    first = ranked.groupBy(*[F.col(g).alias(f"_s_{g}") for g in group_cols]).agg(F.min("_no").alias("_start"))
    out = ranked.join(first, _same(group_cols, "_s_"))
    return out.select(*df.columns, (F.col("_no") - F.col("_start")).cast("long").alias(out_col))


def sums_by_rows(df: DataFrame, group_cols: list[str], order_cols: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums over the earlier rows of a group, by a total order (nulls first): ``sums`` names a non-negative long per result column
    (null counts as 0).  Null keys are a group.

    The sum before a row is that of its run (a window of at most 2^RUN_BITS rows), of the earlier runs of its task and of the earlier
    tasks (one broadcast row per task); a group starts at the least of its sums, a pre-aggregated minimum.
    """
    names = {c: f"_s{i}" for i, c in enumerate(sums)}
    part, run = F.shiftright("_at", 33), F.shiftright("_at", RUN_BITS)
    rows = in_order(df.withColumns({names[c]: F.coalesce(v, F.lit(0)).cast("long") for c, v in sums.items()}), [*group_cols, *order_cols])
    rows = rows.withColumns({"_run": run, "_part": part})

    def before(c: str, w) -> Column:
        return F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = list(names.values())
    runs = rows.groupBy("_part", "_run").agg(*[F.sum(c).alias(c) for c in own])
    tasks = runs.groupBy("_part").agg(*[F.sum(c).alias(c) for c in own])
    tasks = tasks.select("_part", *[before(c, Window.orderBy("_part")).alias(f"_t{c}") for c in own])
    runs = runs.join(F.broadcast(tasks), "_part")
    runs = runs.select("_run", *[(F.col(f"_t{c}") + before(c, Window.partitionBy("_part").orderBy("_run"))).alias(f"_r{c}") for c in own])
    inside = rows.withColumns({f"_i{c}": before(c, Window.partitionBy("_run").orderBy("_at")) for c in own}).join(runs, "_run")
    summed = inside.withColumns({f"_n{c}": F.col(f"_i{c}") + F.col(f"_r{c}") for c in own})
    first = summed.groupBy(*[F.col(g).alias(f"_s_{g}") for g in group_cols]).agg(*[F.min(f"_n{c}").alias(f"_g{c}") for c in own])
    out = summed.join(first, _same(group_cols, "_s_"))
    return out.select(*df.columns, *[(F.col(f"_n{names[c]}") - F.col(f"_g{names[c]}")).alias(c) for c in sums])


def rank_by_counting(df: DataFrame, group_cols: list[str], levels: list[list[str]], order_cols: list[str], out_col: str) -> DataFrame:
    """1-based rank of a row in its group by ``order_cols`` (ascending, nulls first), from counts.

    ``levels`` refine the order step by step: all rows of a smaller key of a level lie before all of a greater one.  The rows of a key
    are counted (pre-aggregated), prefix sums over the keys inside the key above say how many rows lie before, and only rows that agree in all
    levels are numbered by a window.  Nothing is sorted as a whole, stored or run while the plan is built; a window holds the different keys of
    one level inside one key, or the rows of one last key.
    """
    out, keys, before = df, list(group_cols), F.lit(0)
    for k, level in enumerate(levels):
        counts = df.groupBy(*keys, *level).agg(F.count(F.lit(1)).alias("_n"))
        along = Window.partitionBy(*keys).orderBy(*level).rowsBetween(Window.unboundedPreceding, -1)
        keys = keys + level
        offset = counts.select(*[F.col(c).alias(f"_k{k}_{c}") for c in keys], F.coalesce(F.sum("_n").over(along), F.lit(0)).alias(f"_b{k}"))
        out = out.join(offset, _same(keys, f"_k{k}_")).drop(*[f"_k{k}_{c}" for c in keys])
        before = before + F.col(f"_b{k}")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_cols))
    return out.select(*df.columns, (before + inside).cast("long").alias(out_col))


# ----------------------------------------------------------- places without ranks
class Cut(NamedTuple):
    """The key that covers a place of an order: ``before`` places lie before it, and it takes ``weight`` of them."""
    key: str
    id: object
    before: int
    weight: int


def select_places(keys: DataFrame, places: Callable[[int], list[int]], digits: int = 4) -> tuple[int, list[Cut | None]]:
    """Total weight, and for each wanted 0-based place the key that covers it (None: beyond the last).

    ``keys``: ``key`` (lowercase hex of 32 digits, uniformly distributed), ``id`` and ``weight``, in the order (key, id).
    Order-statistic selection by histograms: weights are counted by the first ``digits`` digits (65,536 rows at most), prefix sums name the
    bucket of each place, and only those buckets are counted by the next digits; the last step looks at the keys of the buckets
    that share ``2 * digits`` digits with a place (a 2^32nd of the different keys for four digits).  No row is moved or ranked;
    the driver gets the counts.  ``keys`` is read three times and should be stored.
    """
    def counted(rows: DataFrame, n: int) -> dict[str, int]:
        found = rows.groupBy(F.substring("key", 1, n).alias("p")).agg(F.sum("weight").alias("w")).collect()
        return {r.p: r.w for r in sorted(found)}

    def narrowed(hist: dict[str, int], inside: str, before: int, place: int) -> tuple[str, int]:
        for p, w in hist.items():
            if p.startswith(inside):
                if place < before + w:
                    return p, before
                before += w
        raise ValueError("the keys changed while they were counted")
    hist = counted(keys, digits)
    total = sum(hist.values())
    wanted = places(total)
    at = {p: narrowed(hist, "", 0, p) for p in wanted if 0 <= p < total}
    if at:
        hist = counted(keys.where(F.substring("key", 1, digits).isin(sorted({b for b, _ in at.values()}))), 2 * digits)
        at = {p: narrowed(hist, b, n, p) for p, (b, n) in at.items()}
    cuts: dict[int, Cut] = {}
    if at:
        inside = keys.where(F.substring("key", 1, 2 * digits).isin(sorted({b for b, _ in at.values()})))
        rows = inside.groupBy("key", "id").agg(F.sum("weight").alias("w")).orderBy("key", F.col("id").asc_nulls_first()).collect()
        for p, (b, before) in at.items():
            for r in rows:
                if r.key.startswith(b):
                    if p < before + r.w:
                        cuts[p] = Cut(r.key, r.id, before, r.w)
                        break
                    before += r.w
    return total, [cuts.get(p) for p in wanted]


def before_cut(key: Column, id_col: Column, cut: Cut | None, id_type) -> Column:
    """Whether (key, id) lies before the cut's key (nulls first)."""
    if cut is None:
        return F.lit(True)
    return F.struct(key.alias("k"), id_col.alias("i")) < F.struct(F.lit(cut.key).alias("k"), F.lit(cut.id).cast(id_type).alias("i"))


def at_cut(key: Column, id_col: Column, cut: Cut, id_type) -> Column:
    return (key == cut.key) & id_col.eqNullSafe(F.lit(cut.id).cast(id_type))


def numbered(df: DataFrame, col: str) -> DataFrame:
    """Stored rows with a 0-based number: position in the task, after all rows of earlier tasks (one broadcast row each)."""
    tagged = staged(df.withColumn(col, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col(col), 33)
    sizes = tagged.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_pid", before.alias("_off"))
    own = F.col(col) - F.shiftleft(part, 33)
    return tagged.withColumn("_pid", part).join(F.broadcast(starts), "_pid").withColumn(col, (F.col("_off") + own).cast("long")).drop("_pid", "_off")
