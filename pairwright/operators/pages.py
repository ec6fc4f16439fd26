"""Captured pages: dedupe and merge (U1, U2), alignment, timeouts, tiers, retries, registry (W3-W10) in batch form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MERGE_CAP = 1000
#: Rows that one task sorts, about, where the number of rows is known.
TASK_ROWS = 500_000


def listing_key() -> Column:
    """Id, or else url, or else site:title:price."""
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return F.coalesce(blank("id"), blank("url"), F.concat_ws(":", F.coalesce("site", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce(F.col("price").cast("string"), F.lit(""))))


def dealt(rows: DataFrame, known: int | None, *by: str) -> DataFrame:
    """rows by some columns over as many tasks as `known` rows take, so that no task's memory grows with the table; as they are if it is None."""
    if known is None:
        return rows
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // TASK_ROWS)), *by)


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], known: int | None = None) -> DataFrame:
    """Of the rows with one listing key, the first by `order`, within groups by keys. known: about how many rows there are, if that is known."""
    w = Window.partitionBy(*keys, "_key").orderBy(*order)
    rows = dealt(rows.withColumn("_key", listing_key()), known, *keys, "_key")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_key")


def merged(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int | None = MERGE_CAP, known: int | None = None) -> DataFrame:
    """First of each id, rows without id all kept, the first `most` of a group (a cap that the reference has; None: all).
    known: about how many rows there are, if that is known."""
    w, g = Window.partitionBy(*keys, "id").orderBy(*order), Window.partitionBy(*keys).orderBy(*order)
    kept = dealt(rows, known, *keys, "id").withColumn("_r", F.row_number().over(w)).where(F.col("id").isNull() | (F.col("_r") == 1))
    if most is None:
        return kept.drop("_r")
    return kept.withColumn("position", F.row_number().over(g)).where(F.col("position") <= most).drop("_r")


def aligned(events: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """A payload is accepted if its page is the next one that its run waits for; repeats and stale pages are not.

    A page is fresh when it is above every page before it. Adds accepted.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("accepted", F.col("page") > F.coalesce(F.max("page").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def timeouts(events: DataFrame, keys: Sequence[str], seconds: int = 45) -> DataFrame:
    """The gap to the event before in seconds, and whether it is beyond the limit; stages number the runs between timeouts."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / F.lit(1_000_000.0)
    out = events.withColumn("gap_s", gap).withColumn("timed_out", F.coalesce(F.col("gap_s") > seconds, F.lit(False)))
    return out.withColumn("stage", F.sum(F.col("timed_out").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def first_tier_with_rows(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the query tiers, the first that brought rows. results: keys, tier, rows."""
    return results.where("rows > 0").groupBy(*keys).agg(F.min_by(F.struct("tier", "rows"), "tier").alias("b")).select(*keys, "b.tier", "b.rows")


def retries(events: DataFrame, keys: Sequence[str], most: int = 4) -> DataFrame:
    """Errors in a row up to each event, and whether the budget is used up. events: is_error."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    good = F.sum((~F.col("is_error")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = events.withColumn("_good", good)
    inside = Window.partitionBy(*keys, "_good").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("errors_in_row", F.sum(F.col("is_error").cast("int")).over(inside)).withColumn("exhausted", F.col("errors_in_row") >= most).drop("_good")


def orphans(registered: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Registered resources that are no longer live."""
    return registered.join(live.select(key).distinct(), key, "left_anti")


def newest_runs(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The events of each key's latest run."""
    last = events.groupBy(*keys).agg(F.max("run_id").alias("run_id"))
    return events.join(last, [*keys, "run_id"], "left_semi")


# Error codes by stage and reason.
ERROR_CODES = {"fetching:blocked": "SOURCE_BLOCKED", "fetching:timeout": "FETCH_TIMEOUT", "searching:blocked": "SEARCH_BLOCKED", "searching:empty": "NO_AMAZON_RESULTS", "searching:timeout": "SEARCH_TIMEOUT", "matching:low": "LOW_CONFIDENCE", "matching:pack": "QUANTITY_MISMATCH", "parsing:title": "PARSE_FAILED"}


def error_code(stage: Column, reason: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, code in ERROR_CODES.items():
        out = out.when(F.concat_ws(":", stage, reason) == k, F.lit(code))
    return out.otherwise("UNKNOWN")
