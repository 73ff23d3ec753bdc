"""Catalog tables (R1-R15) as append-only versions plus derived views.

The reference keeps five SQLite tables updated in place.  On Spark a catalog
is an append-only table of versions; "the current row" is the latest version
per key, computed with an aggregate (``max_by``) that reduces map-side, so a
key with a huge number of versions does not become one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.functions.text import round4
from tunedata.plans.ordered import neighbour_by_rows, neighbour_by_stretch, rank_by_counting

READY = "ready"
# The dataset lifecycle, in order (uploaded first, ready last).
LIFECYCLE = ["uploaded", "validated", "profiled", "split", "registered", "ready"]


def latest_per_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """Last write wins -- the row with the greatest ``order_cols`` per key."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order_cols)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """Keyed upsert = union of versions, then latest per key (idempotent)."""
    return latest_per_key(current.unionByName(updates, allowMissingColumns=True), keys, order_cols)


def lookup(df: DataFrame, key_set: DataFrame, keys: list[str]) -> DataFrame:
    """R2: rows whose key is in ``key_set`` (set form of a point lookup)."""
    return df.join(key_set.select(*keys).distinct(), keys, "left_semi")


def list_recent(df: DataFrame, ts_col: str, key: str, pos_col: str | None = None) -> DataFrame:
    """Newest first (a range sort); with ``pos_col`` also the 0-based position, by counts per day, minute and instant."""
    if pos_col is None:
        return df.orderBy(F.col(ts_col).desc(), F.col(key).asc())
    late = F.unix_micros(F.col(ts_col).cast("timestamp"))
    keyed = df.withColumns({"_us": -late, "_min": -F.floor(late / 60_000_000), "_day": -F.floor(late / 86_400_000_000)})
    ranked = rank_by_counting(keyed, [], [["_day"], ["_min"], ["_us"]], [key], pos_col)
    return ranked.withColumn(pos_col, F.col(pos_col) - 1).drop("_us", "_min", "_day")


def parse_json_column(df: DataFrame, col: str, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Parse a JSON text column; rows that do not parse go to a quarantine frame."""
    v = F.try_parse_json(F.col(col))
    parsed = df.withColumn("_v", v)
    good = parsed.filter(F.col("_v").isNotNull())
    for name, typ in fields.items():
        good = good.withColumn(name, F.try_variant_get(F.col("_v"), f"$.{name}", typ))
    bad = parsed.filter(F.col("_v").isNull() & F.col(col).isNotNull()).drop("_v")
    return good.drop("_v"), bad


def typed_json_columns(df: DataFrame, schemas: dict) -> DataFrame:
    """JSON-in-text columns (tags, hyperparameters, metrics...) to native arrays / maps /
    structs with ``from_json``; ``to_json`` is the way back."""
    for col, schema in schemas.items():
        df = df.withColumn(col, F.from_json(F.col(col), schema))
    return df


def delete_keys(df: DataFrame, doomed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Table without the doomed keys, and which doomed keys existed."""
    remaining = df.join(doomed.select(*keys), keys, "left_anti")
    existed = doomed.select(*keys).distinct().join(df.select(*keys), keys, "left_semi")
    return remaining, existed


def ready_only(datasets: DataFrame, state_col: str = "state") -> DataFrame:
    """Only READY datasets."""
    return datasets.filter(F.col(state_col) == READY)


def tag_search(checkpoints: DataFrame, tag: str) -> DataFrame:
    """Checkpoints carrying ``tag``."""
    return checkpoints.filter(F.array_contains("tags", tag))


def tag_counts(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints per tag (counted, never collected into lists)."""
    return (checkpoints.select(F.explode(F.array_distinct("tags")).alias("tag"))
            .groupBy("tag").agg(F.count(F.lit(1)).alias("n_checkpoints")))


def promote(entries: DataFrame, promotions: DataFrame, type_col: str = "base_model",
            key: str = "checkpoint_id", seq_col: str = "registered_seq") -> DataFrame:
    """Production flag per entry type.

    The last promotion of a type wins (the reference clears the flag on the
    other entries of the type and sets it on the promoted one).  A type that was
    never promoted keeps its first registered entry as production.
    """
    promo = (promotions.join(entries.select(key, type_col), key)
             .groupBy(type_col).agg(F.max_by(key, F.struct("promoted_at", key)).alias("_promoted")))
    first = entries.groupBy(type_col).agg(F.min_by(key, F.struct(seq_col, key)).alias("_first"))
    prod = first.join(promo, type_col, "left").select(
        type_col, F.coalesce("_promoted", "_first").alias("_prod"))
    return entries.join(prod, type_col, "left").withColumn(
        "is_production", F.col(key) == F.col("_prod")).drop("_prod")


def production_entry(flagged: DataFrame, type_col: str = "base_model", key: str = "checkpoint_id") -> DataFrame:
    """The production entry of each type (first by name if several are flagged)."""
    return (flagged.filter("is_production").groupBy(type_col)
            .agg(F.min_by(key, F.struct("model_name", key)).alias(key)))


def lifecycle_audit(log: DataFrame, key: str = "dataset_id", ts_col: str = "ts",
                    tie_col: str = "event_id", ord_col: str = "ord", seq_col: str | None = None,
                    span: int = 1 << 16) -> DataFrame:
    """Transitions checked against the lifecycle order, and the current state.

    The log is ordered by ``seq_col`` (a number that grows along the log, dense or not), else by time and
    ``tie_col``.  The previous state of each event is a ``lag`` inside stretches of ``span`` sequence numbers, or, by time, inside
    runs of equal numbers of rows (``neighbour_by_rows``), so a dataset with a third of all events, or an hour with all of
    them, is many small windows.  Events without a dataset are audited as one.  A step is legal when it moves
    exactly one state forward.
    """
    order = [seq_col] if seq_col else [ts_col, tie_col]
    if seq_col:
        prev = neighbour_by_stretch(log, [key], order, [ord_col], F.floor(F.col(seq_col) / span), offset=-1, prefix="prev_")
    else:
        prev = neighbour_by_rows(log.select(key, *order, ord_col), [key], order, [ord_col], offset=-1, prefix="prev_")
    p, o = F.col(f"prev_{ord_col}"), F.col(ord_col)
    kind = (F.when(p.isNull(), F.when(o == 0, "start").otherwise("bad_start"))
            .when(o == p + 1, "forward").when(o == p, "repeat").when(o < p, "reversed").otherwise("skipped"))
    flagged = prev.withColumn("transition", kind)
    states = F.array(*[F.lit(s) for s in LIFECYCLE])
    return flagged.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("transition") == "forward").alias("n_forward"),
        F.count_if(F.col("transition") == "repeat").alias("n_repeat"),
        F.count_if(F.col("transition") == "reversed").alias("n_reversed"),
        F.count_if(F.col("transition") == "skipped").alias("n_skipped"),
        F.element_at(states, (F.max_by(o, F.struct(*order)) + 1).cast("int")).alias("current_state"))


def current_state(log: DataFrame, key: str = "dataset_id", ts_col: str = "ts", tie_col: str = "event_id") -> DataFrame:
    """Latest lifecycle state per dataset."""
    return log.groupBy(key).agg(F.max_by("state", F.struct(ts_col, tie_col)).alias("state"))


def status_overlay(stored: DataFrame, progress: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Stored status overlaid field by field with the newer progress values."""
    p = progress.select(key, *[F.col(f).alias(f"_p_{f}") for f in fields])
    j = stored.join(p, key, "left")
    for f in fields:
        j = j.withColumn(f, F.coalesce(F.col(f"_p_{f}"), F.col(f))).drop(f"_p_{f}")
    return j


def history_view(jobs: DataFrame) -> DataFrame:
    """Display projection (short id, upper state, formatted time, N/A for no loss)."""
    return jobs.select(
        F.substring("job_id", 1, 8).alias("short_id"), F.upper("state").alias("state"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated"),
        F.when(F.col("loss").isNull(), F.lit("N/A"))
        .otherwise(F.format_string("%.4f", round4("loss"))).alias("loss"))


def readiness_audit(jobs: DataFrame, datasets: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Jobs whose dataset is absent or not READY, with the reason."""
    j = jobs.join(datasets.select(key, F.col("state").alias("dataset_state")), key, "left")
    reason = (F.when(F.col("dataset_state").isNull(), "dataset_missing")
              .when(F.col("dataset_state") != READY, "dataset_not_ready").otherwise("ok"))
    return j.withColumn("reason", reason)
