"""Review queues: what is proposed, what people decided, and what may be applied. Decisions of people are never overwritten."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.functions import parsing

#: States of a review, and those that a person has set.
STATES = ["pending", "approved", "rejected", "deferred", "applied", "no_op"]
DECIDED = ["approved", "rejected", "applied", "no_op"]
HELD = ["reviewed", "ignored", "requeued"]


def blank(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit(""))) == ""


def queue_summary(queue: DataFrame, confidences: tuple[str, ...] = ("HIGH", "MEDIUM", "LOW")) -> DataFrame:
    """One row: total, a count for each state and confidence, decided, and pending as the rest, at least 0."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATES if s != "pending"] + [F.count_if(F.upper("confidence") == c).alias(f"n_{c.lower()}") for c in confidences]
    rows = queue.agg(F.count("*").alias("total"), *counts, F.count_if(F.col("status").isin(DECIDED)).alias("decided"))
    return rows.withColumn("pending", F.greatest(F.col("total") - F.col("decided"), F.lit(0)))


def review_counts(reviews: DataFrame) -> DataFrame:
    """(dimension, value, n): items by status, the HIGH and MEDIUM ones by confidence, and the rejected ones by reason."""
    parts = [
        ("status", reviews, F.col("review_status")), ("confidence", reviews.where(F.upper("confidence").isin("HIGH", "MEDIUM")), F.upper("confidence")),
        ("rejected", reviews.where("review_status = 'rejected'"), F.coalesce("reason", F.lit("unspecified"))),
    ]
    return reduce(DataFrame.unionByName, [df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("dimension"), "value", "n") for name, df, value in parts])


def queue_view(queue: DataFrame, tracks: DataFrame, reviews: DataFrame, root: str = "") -> DataFrame:
    """(item_id, track_id, artist, title, proposed_artist, proposed_title, review_status) of every queue entry.

    An entry's track is found by its path as written, else by the path below root; its review by the track's id, pending
    if there is none. What is proposed as it is already is no_op.
    """
    t = tracks.select(F.col("id").alias("track_id"), "filepath", "artist", "title")
    raw = t.select("filepath", F.struct("track_id", "artist", "title").alias("raw"))
    below = t.select(F.col("filepath").alias("__full"), F.struct("track_id", "artist", "title").alias("below"))
    q = queue.withColumn("__full", F.concat(F.lit(root), "filepath"))
    found = q.join(raw, "filepath", "left").join(below, "__full", "left").withColumn("t", F.coalesce("raw", "below"))
    r = reviews.select(F.col("item_id").alias("__item"), "review_status")
    rows = found.join(r, F.col("t.track_id") == F.col("__item"), "left")
    same = F.col("t.artist").eqNullSafe(F.col("proposed_artist")) & F.col("t.title").eqNullSafe(F.col("proposed_title"))
    status = F.when(same & F.col("t").isNotNull(), "no_op").otherwise(F.coalesce("review_status", F.lit("pending")))
    return rows.select(F.col("item_id"), "t.track_id", "t.artist", "t.title", "proposed_artist", "proposed_title", status.alias("review_status"))


def fill_blank(current: dict[str, Column], proposed: dict[str, Column]) -> Column:
    """array<struct<field, before, after>> of the fields that are blank now and have a proposal."""
    each = [F.when(blank(current[f]) & ~blank(proposed[f]), F.struct(F.lit(f).alias("field"), current[f].cast("string").alias("before"), proposed[f].cast("string").alias("after"))) for f in current]
    return F.array_compact(F.array(*each))


def apply_plan(reviews: DataFrame, tracks: DataFrame, fields: list[str]) -> DataFrame:
    """(item_id, track_id, outcome, changes) of approved reviews (item_id, track_id, filepath, confidence, match struct).

    The track is the one with the id, else the one with the path. The first check that fails names the outcome:
    missing_filepath, missing_best_match, confidence_not_high, empty_best_match, suspicious_mismatch (invalid names),
    track_missing_from_tracks, suspicious_mismatch (another path or id), no_missing_fields; else apply, with the blank
    fields that the match fills.
    """
    t = F.struct(*[F.col(c) for c in dict.fromkeys(["id", "filepath", *fields])])
    by_id, by_path = tracks.select(F.col("id").alias("__id"), t.alias("by_id")), tracks.select(F.col("filepath").alias("__path"), t.alias("by_path"))
    rows = reviews.where("lower(review_status) = 'approved'").join(by_id, F.col("track_id") == F.col("__id"), "left").join(by_path, F.col("filepath") == F.col("__path"), "left")
    rows = rows.withColumn("t", F.coalesce("by_id", "by_path"))
    match, found = F.col("match"), F.col("t")
    changes = fill_blank({f: found[f] for f in fields}, {f: match[f] for f in fields})
    names_ok = parsing.is_valid_artist(match["artist"]) & parsing.is_valid_title(match["title"])
    other = (found["filepath"] != F.col("filepath")) | F.coalesce(found["id"] != F.col("track_id"), F.lit(False))
    outcome = (
        F.when(blank(F.col("filepath")), "missing_filepath").when(match.isNull(), "missing_best_match").when(F.upper(F.coalesce("confidence", F.lit(""))) != "HIGH", "confidence_not_high")
        .when(blank(match["artist"]) | blank(match["title"]), "empty_best_match").when(~names_ok, "suspicious_mismatch").when(found.isNull(), "track_missing_from_tracks")
        .when(other, "suspicious_mismatch").when(F.size(changes) == 0, "no_missing_fields").otherwise("apply")
    )
    return rows.select("item_id", found["id"].alias("track_id"), outcome.alias("outcome"), F.when(outcome == "apply", changes).otherwise(F.slice(changes, 1, 0)).alias("changes"))


def keep_decisions(stored: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The stored findings (key, columns, review_status) after a new scan (key, columns), with `change`.

    New findings are pending. Found again: the columns are refreshed, a decision of HELD stays, anything else, resolved
    too, is pending. Not found any more: resolved, unless reviewed or ignored.
    """
    a = stored.select(F.col(key).alias("__a"), F.struct(*columns).alias("old"), F.col("review_status").alias("status"))
    b = found.select(F.col(key).alias("__b"), F.struct(*columns).alias("new"))
    rows = a.join(b, F.col("__a") == F.col("__b"), "full")
    there = F.col("__b").isNotNull()
    status = F.when(there, F.when(F.col("status").isin(HELD), F.col("status")).otherwise("pending")).when(F.col("status").isin("reviewed", "ignored"), F.col("status")).otherwise("resolved")
    change = F.when(F.col("__a").isNull(), "new").when(there, "refreshed").when((status == "resolved") & (F.col("status") != "resolved"), "resolved").otherwise("kept")
    return rows.select(F.coalesce("__a", "__b").alias(key), F.coalesce("new", "old").alias("row"), status.alias("review_status"), change.alias("change")).select(key, "row.*", "review_status", "change")


def path_updates(tracks: DataFrame, updates: DataFrame) -> DataFrame:
    """(id, outcome) of updates (id, new_path): not_found, stale, collision with another row's path or another update's, unchanged, or updated."""
    t = tracks.select(F.col("id").alias("__id"), F.col("filepath").alias("__old"), "status")
    used = tracks.select(F.col("filepath").alias("__path"), F.col("id").alias("__owner")).groupBy("__path").agg(F.min("__owner").alias("__owner"))
    several = updates.groupBy("new_path").agg(F.count("*").alias("__n"))
    rows = updates.join(t, F.col("id") == F.col("__id"), "left").join(used, F.col("new_path") == F.col("__path"), "left").join(several, "new_path")
    outcome = (
        F.when(F.col("__id").isNull(), "not_found").when(F.col("status") == "stale", "stale").when(F.col("new_path") == F.col("__old"), "unchanged")
        .when(F.col("__owner").isNotNull() | (F.col("__n") > 1), "collision").otherwise("updated")
    )
    return rows.select("id", outcome.alias("outcome"))


def all_or_nothing(outcomes: DataFrame, fatal: list[str]) -> DataFrame:
    """outcomes with `applied`: an update is applied unless any row of the batch has a fatal outcome."""
    bad = outcomes.agg(F.count_if(F.col("outcome").isin(fatal)).alias("__bad"))
    rows = outcomes.join(F.broadcast(bad))  # one row
    return rows.withColumn("applied", (F.col("outcome") == "updated") & (F.col("__bad") == 0)).drop("__bad")


#: States that a state may change to.
MOVES = {"pending": ["approved", "rejected", "deferred"], "deferred": ["approved", "rejected", "pending"], "approved": ["applied", "rejected", "pending"], "rejected": ["pending", "approved"], "applied": [], "no_op": []}


def mutated(reviews: DataFrame, changes: DataFrame) -> DataFrame:
    """(item_id, review_status, outcome) of reviews after changes (item_id, wanted): changed, unknown_state, not_allowed or kept."""
    rows = reviews.select("item_id", F.col("review_status").alias("now")).join(changes.select("item_id", "wanted"), "item_id", "left")
    allowed = reduce(lambda a, b: a | b, [(F.col("now") == s) & F.col("wanted").isin(to) for s, to in MOVES.items() if to])
    outcome = F.when(F.col("wanted").isNull(), "kept").when(~F.col("wanted").isin(STATES), "unknown_state").when(allowed, "changed").otherwise("not_allowed")
    return rows.select("item_id", F.when(outcome == "changed", F.col("wanted")).otherwise(F.col("now")).alias("review_status"), outcome.alias("outcome"))


def latest_of_path(history: DataFrame, path: str = "track_id") -> DataFrame:
    """(path, id, n): the largest id of each path, the row that an update of the path changes."""
    return history.groupBy(path).agg(F.max("id").alias("id"), F.count("*").alias("n"))


def rollback_plan(history: DataFrame, path: str = "track_id") -> DataFrame:
    """(path, id, before): the values of the latest row of each path that isn't rolled back."""
    return history.where("NOT rolled_back").groupBy(path).agg(F.max("id").alias("id"), F.max_by("before", "id").alias("before"))


def outdated(states: DataFrame, version: str) -> DataFrame:
    """States whose reason was given by another version of the rules than `version` (a prefix), or by none."""
    return states.where(~F.coalesce(F.col("reason").startswith(version), F.lit(False)))


#: The order of a job's states; a job is in the last that its log reaches.
JOB_STATES = ["pending", "running", "succeeded", "failed", "cancelled"]


def job_states(log: DataFrame) -> DataFrame:
    """(job, state, begun, ended) from a log (job, state, since, id): the latest state; ended only in one of the last three."""
    last = log.where(F.col("state").isin(JOB_STATES)).groupBy("job").agg(F.max_by("state", F.struct("since", "id")).alias("state"), F.min("since").alias("begun"), F.max("since").alias("__last"))
    return last.select("job", "state", "begun", F.when(F.col("state").isin(JOB_STATES[2:]), F.col("__last")).alias("ended"))
