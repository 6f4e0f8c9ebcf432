"""Review state, upserts, incremental skips and series rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ["success", "no_change", "skipped", "ignored"]


def review_rollup(reviews: DataFrame) -> DataFrame:
    """(review_status, n, first_item, last_item)."""
    return reviews.groupBy("review_status").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"), F.max("item_id").alias("last_item"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """(dimension, value, n) of each key in one pass (grouping sets)."""
    sets = rows.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    full = (1 << len(keys)) - 1
    for k, key in enumerate(keys):
        here = F.col("g") == full - (1 << (len(keys) - 1 - k))
        name, value = F.when(here, key).otherwise(name), F.when(here, F.col(key).cast("string")).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


def derived_status(statuses: Column) -> Column:
    """The status of an item from its fields' statuses."""
    s = F.array_distinct(statuses)

    def only(*names: str) -> Column:
        return (F.size(F.array_except(s, F.array(*map(F.lit, names)))) == 0) & (F.size(s) > 0)

    return (
        F.when(only("applied"), "applied").when(only("no_op"), "no_op").when(only("rejected", "no_op"), "rejected").when(only("approved", "no_op"), "approved")
        .when(F.array_contains(s, "applied"), "partially_applied").when(F.array_contains(s, "approved"), "partially_approved").otherwise("pending")
    )


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of new, and those of current whose key new doesn't have; columns of current, new's nulls included."""
    kept = current.join(new.select(F.col(key).alias("__k")).distinct(), F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    return kept.unionByName(new.select(current.columns))


def change_counts(current: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(outcome, n): inserted, updated, unchanged and kept rows of an upsert, by null-safe comparison."""
    a = current.select(F.col(key).alias("__a"), F.struct(*columns).alias("old"))
    b = new.select(F.col(key).alias("__b"), F.struct(*columns).alias("new"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full")
    same = F.col("old").eqNullSafe(F.col("new"))
    outcome = F.when(F.col("__a").isNull(), "inserted").when(F.col("__b").isNull(), "kept").when(same, "unchanged").otherwise("updated")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def pending(files: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """Files without a finished state of the same keys (stage, path, size, time, rule version): an anti join."""
    done = states.where(F.col("status").isin(TERMINAL)).select(*[F.col(k).alias(f"__{k}") for k in keys])
    test = None
    for k in keys:
        each = F.col(k).eqNullSafe(F.col(f"__{k}"))
        test = each if test is None else test & each
    return files.join(done, test, "left_anti")


def quiet_gaps(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """(key, session, begin, end, n): runs of events without a gap of more than `seconds`."""
    w = Window.partitionBy(key).orderBy(at, "id")
    gap = F.col(at).cast("timestamp").cast("double") - F.lag(at).over(w).cast("timestamp").cast("double")
    rows = events.withColumn("__new", F.when(gap.isNull() | (gap > seconds), 1).otherwise(0))
    rows = rows.withColumn("session", F.sum("__new").over(w))
    return rows.groupBy(key, "session").agg(F.min(at).alias("begin"), F.max(at).alias("end"), F.count("*").alias("n"))


def moving_average(rows: DataFrame, key: str, at: list[str], value: str, width: int) -> DataFrame:
    """rows with `smooth`: the mean of the width values around each; beyond an end its last value goes on. width is odd."""
    half, order = width // 2, Window.partitionBy(key).orderBy(*at)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(order)
    before, after = F.greatest(F.lit(0), half + 1 - place), F.greatest(F.lit(0), place + half - F.count("*").over(whole))
    total = F.sum(value).over(order.rowsBetween(-half, half)) + before * F.first(value).over(whole) + after * F.last(value).over(whole)
    return rows.withColumn("smooth", total / width)


def runs_above(rows: DataFrame, key: str, at: str, value: str, least: float, length: int = 2) -> DataFrame:
    """(key, start, n): runs of at least `length` consecutive values of at least `least` (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(at)
    numbered = rows.withColumn("__all", F.row_number().over(w)).where(F.col(value) >= least)
    numbered = numbered.withColumn("__run", F.col("__all") - F.row_number().over(w))
    return numbered.groupBy(key, "__run").agg(F.min(at).alias("start"), F.count("*").alias("n")).where(F.col("n") >= length).drop("__run")


def peak_and_flux(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """rows with `share` (of the key's largest value) and `rise` (the positive part of the first difference)."""
    w = Window.partitionBy(key)
    rise = F.greatest(F.lit(0.0), F.col(value) - F.lag(value).over(w.orderBy(at)))
    return rows.withColumns({"share": F.col(value) / F.max(value).over(w), "rise": F.coalesce(rise, F.lit(0.0))})
