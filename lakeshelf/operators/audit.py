"""Audits of paths: stale rows, orphans, replacements, and the plan of actions they lead to."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeshelf.functions import audit, scoring, text
from lakeshelf.operators import resolution


def stale_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose filepath isn't among files' paths, nor its lower-case name anywhere among their names: two anti joins."""
    gone = rows.join(files.select(F.col("filepath").alias("__path")), F.col("filepath") == F.col("__path"), "left_anti")
    names = files.select(F.lower(text.file_name(F.col("filepath"))).alias("__name")).distinct()
    return gone.join(names, F.lower(text.file_name(F.col("filepath"))) == F.col("__name"), "left_anti")


def size_matches(orphans: DataFrame, files: DataFrame, within: float = 0.1) -> DataFrame:
    """(id, exact, near): whether a file has the same size, and one within a share of it.

    Sizes are put into classes of that step; each class keeps its least and greatest size, which is all that an interval
    over a few classes needs to know, so neither pairs nor many rows meet.
    """
    step = math.log1p(within) / 2
    rows = orphans.select("id", F.col("filesize_bytes").cast("double").alias("size")).where("size > 0")
    sizes = files.select(F.col("filesize_bytes").cast("double").alias("size")).where("size > 0")

    def size_class(size: Column) -> Column:
        return F.floor(F.log(size) / step)

    exact = rows.join(sizes.distinct(), "size", "left_semi").select("id", F.lit(True).alias("exact"))
    classes = sizes.groupBy(size_class(F.col("size")).alias("class")).agg(F.min("size").alias("least"), F.max("size").alias("greatest"))
    low, high = F.col("size") * (1 - within), F.col("size") * (1 + within)
    each = rows.select("id", "size", F.explode(F.sequence(size_class(low) - 1, size_class(high) + 1)).alias("class")).join(classes, "class")
    edge = [F.abs(F.col(c) - F.col("size")) / F.col("size") < within for c in ("least", "greatest")]
    near = each.groupBy("id").agg(F.max(edge[0] | edge[1]).alias("near")).where("near")  # a class is narrower than the interval, so one of its ends lies in it
    out = orphans.select("id").distinct().join(exact, "id", "left").join(near, "id", "left")
    return out.select("id", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("near", F.lit(False)).alias("near"))


def orphan_histograms(orphans: DataFrame, states: DataFrame, root: str, top: int = 30) -> DataFrame:
    """(dimension, value, n): orphans by top folder, by stage and status of their states, and by parent folder (the `top` largest)."""
    status = F.coalesce("status", F.lit("unknown"))
    stages = orphans.select("id", status.alias("__status")).join(states.select(F.col("track_id").alias("id"), "stage"), "id", "left")
    folders = orphans.groupBy(audit.top_folder(F.col("filepath"), root).alias("value")).agg(F.count("*").alias("n"))
    by_stage = stages.groupBy(F.concat_ws("/", F.coalesce("stage", F.lit("unknown")), "__status").alias("value")).agg(F.count("*").alias("n"))
    parents = orphans.groupBy(text.folder(F.col("filepath")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)
    parts = [df.select(F.lit(name).alias("dimension"), "value", "n") for name, df in (("top_folder", folders), ("stage_status", by_stage), ("parent", parents))]
    return reduce(DataFrame.unionByName, parts)


def superseded(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(id, stage, old_path, replacement_path) of rows whose file is gone but has an auto-safe replacement of the same compared name.

    Rows with status stale and those whose file is there don't count. Of several replacements the best score, then the
    least path is taken. Names and sizes decide, so each distinct pair of them is judged once, after a join on the compared
    name and a class of sizes, and has the least path of its files.
    """
    live = rows.where(F.lower(F.coalesce("status", F.lit(""))) != "stale")
    gone = live.join(files.select(F.col("filepath").alias("__path")), F.col("filepath") == F.col("__path"), "left_anti")
    gone = gone.withColumns({"__file": text.file_name(F.col("filepath")), "__size": F.col("filesize_bytes").cast("double")})

    def kinds(df: DataFrame, name: str) -> DataFrame:
        """The distinct names and sizes with the compared name and size class; sizes that fit lie in the same or the next class."""
        df = df.where("__size > 0").withColumn("__name", text.audit_name(F.col("__file"))).where("__name <> ''").withColumn("__class", F.floor(F.ln("__size") / (audit.SAFE_OFF * 1.1)))
        return df.withColumnsRenamed({"__file": f"{name}_file", "__size": f"{name}_size"})

    places = files.select(text.file_name(F.col("filepath")).alias("__file"), F.col("filesize_bytes").cast("double").alias("__size"), F.col("filepath").alias("new_path"))
    places = kinds(places.groupBy("__file", "__size").agg(F.min("new_path").alias("new_path")), "new")
    sought = kinds(gone.select("__file", "__size").distinct(), "old").withColumn("__class", F.explode(F.array(*[F.col("__class") + d for d in (-1, 0, 1)])))
    old, new = F.col("old_file"), F.col("new_file")
    off = scoring.size_difference(F.col("old_size"), F.col("new_size"))
    same, overlap = text.extension(old) == text.extension(new), text.token_overlap(old, new)
    score = 0.6 * overlap + 0.3 * F.greatest(F.lit(0.0), 1 - F.coalesce(off, F.lit(1.0))) + F.when(same, 0.1).otherwise(0.0)
    pairs = resolution.spread(sought.join(places, ["__name", "__class"]).where((off < audit.SAFE_OFF) & same), "old_file", "old_size").withColumn("__score", score)
    pairs = pairs.where(audit.tier(F.col("__score"), overlap, off, same, old, new) == audit.TIERS[0])
    best = pairs.groupBy("old_file", "old_size").agg(F.min(F.struct((-F.col("__score")).alias("by"), "new_path")).alias("__best"))
    found = gone.join(best, (F.col("__file") == F.col("old_file")) & (F.col("__size") == F.col("old_size")))
    return found.groupBy("id", "stage", F.col("filepath").alias("old_path")).agg(F.min("__best")["new_path"].alias("replacement_path"))


def tiered(candidates: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Candidates (old_id, new_id, overlap, score, ...) with review_tier; several that would be safe for one file are for review."""
    o = old.select(F.col("id").alias("old_id"), F.col("filepath").alias("__old"), F.col("filesize_bytes").alias("__old_size"))
    n = new.select(F.col("id").alias("new_id"), F.col("filepath").alias("__new"), F.col("filesize_bytes").alias("__new_size"))
    rows = candidates.join(o, "old_id").join(n, "new_id")
    same = text.extension(F.col("__old")) == text.extension(F.col("__new"))
    off = scoring.size_difference(F.col("__old_size"), F.col("__new_size"))
    rows = rows.withColumn("review_tier", audit.tier(F.col("score"), F.col("overlap"), off, same, F.col("__old"), F.col("__new")))
    safe = F.count_if(F.col("review_tier") == audit.TIERS[0]).over(Window.partitionBy("old_id"))  # of a few candidates each
    rows = rows.withColumn("__safe", safe).withColumn("review_tier", F.when((F.col("review_tier") == audit.TIERS[0]) & (F.col("__safe") > 1), audit.TIERS[1]).otherwise(F.col("review_tier")))
    return rows.drop("__old", "__new", "__old_size", "__new_size", "__safe")


def overlap_counts(overlaps: DataFrame, least: tuple[float, ...] = (0.5, 0.6, 0.7)) -> DataFrame:
    """(least, n): how many files have a best overlap (old_id, overlap) of at least each bound."""
    counts = overlaps.agg(*[F.count_if(F.col("overlap") >= x).alias(str(x)) for x in least])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(x).alias("least"), F.col(f"`{x}`").alias("n")) for x in least])).alias("x")).select("x.*")


def counts_of(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(value, n) of given values, 0 where there is no row, in one aggregation."""
    counts = rows.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"`{v}`").alias("n")) for v in values])).alias("x")).select("x.*")


#: What a finding leads to, and its risk; findings of other kinds are left for review.
ACTIONS = {
    "stale_state": ("mark_stale", "low"), "moved_auto_safe": ("update_path", "low"), "moved_review": ("review_move", "medium"), "duplicate_row": ("merge_rows", "medium"),
    "missing_file": ("mark_missing", "medium"), "untracked_file": ("import_file", "low"), "stale_reference": ("update_reference", "low"), "unresolved_reference": ("review_reference", "high"),
}


def actions(findings: dict[str, DataFrame]) -> DataFrame:
    """(action, risk, kind, id, old_path, new_path) of all findings (id, old_path, new_path) by kind."""
    parts = []
    for kind, rows in findings.items():
        action, risk = ACTIONS.get(kind, ("review", "high"))
        parts.append(rows.select(F.lit(action).alias("action"), F.lit(risk).alias("risk"), F.lit(kind).alias("kind"), "id", "old_path", "new_path"))
    return reduce(DataFrame.unionByName, parts)


def planned(rows: DataFrame, kind: Column) -> DataFrame:
    """The actions of findings (id, old_path, new_path) by their kind, in one pass over them; other kinds are left for review."""
    table = F.create_map(*[x for k, (action, risk) in ACTIONS.items() for x in (F.lit(k), F.struct(F.lit(action).alias("action"), F.lit(risk).alias("risk")))])
    found = rows.withColumn("kind", kind).withColumn("__what", F.coalesce(table[F.col("kind")], F.struct(F.lit("review").alias("action"), F.lit("high").alias("risk"))))
    return found.select("__what.action", "__what.risk", "kind", "id", "old_path", "new_path")


def references(refs: DataFrame, renames: DataFrame) -> DataFrame:
    """refs (id, filepath) with the new_path of a rename (old_path, new_path) and `resolved`; of several renames the least path."""
    one = renames.groupBy("old_path").agg(F.min("new_path").alias("new_path"))
    return refs.join(one, F.col("filepath") == F.col("old_path"), "left").select("id", F.col("filepath").alias("old_path"), "new_path", F.col("new_path").isNotNull().alias("resolved"))


def checked_plan(plan: DataFrame, files: DataFrame) -> DataFrame:
    """The plan's rows with `issues` (array, in fixed order) and `verdict`: ok, warning or blocked.

    Blocking: no old path, a move without a new path, a new path that is no file, a new path that is another action's
    too. A warning: high risk, or a new path equal to the old one. plan is read twice, once for its new paths alone; what
    these don't depend on is worked out once.
    """
    known = files.select(F.col("filepath").alias("__file")).distinct().withColumn("__there", F.lit(True))
    uses = plan.where("new_path IS NOT NULL").groupBy(F.col("new_path").alias("__new")).agg(F.count("*").alias("__uses"))
    rows = plan.join(known, F.col("new_path") == F.col("__file"), "left").join(uses, F.col("new_path") == F.col("__new"), "left")
    moves, new = F.col("action").isin("update_path", "update_reference"), F.col("new_path")
    blocking = [
        (F.coalesce("old_path", F.lit("")) == "", "missing_old_path"), (moves & new.isNull(), "missing_new_path"), (new.isNotNull() & F.col("__there").isNull(), "new_path_not_found"),
        (moves & (F.coalesce("__uses", F.lit(0)) > 1), "new_path_used_twice"),
    ]
    warnings = [(F.col("risk") == "high", "high_risk"), (F.coalesce(new == F.col("old_path"), F.lit(False)), "same_path")]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in (*blocking, *warnings)]))
    blocked = reduce(lambda a, b: a | b, [test for test, _ in blocking])
    verdict = F.when(blocked, "blocked").when(F.size(found) > 0, "warning").otherwise("ok")
    return rows.select(*plan.columns, found.alias("issues"), verdict.alias("verdict"))


def reasons(rows: DataFrame, column: str = "issues") -> DataFrame:
    """(reason, n) of an array column, the most frequent first, then by name."""
    return rows.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def canonical_paths(*tables: DataFrame, root: str) -> DataFrame:
    """(path): the distinct paths of the tables' filepath columns, as they are and with a relative one put below root."""
    every = reduce(DataFrame.unionByName, [t.select("filepath") for t in tables]).where("filepath IS NOT NULL")
    absolute = F.when(F.col("filepath").startswith("/"), F.col("filepath")).otherwise(F.concat(F.lit(root + "/"), "filepath"))
    plain = F.regexp_replace(F.regexp_replace(absolute, r"/(?:\./)+", "/"), r"/+", "/")
    return every.select(F.explode(F.array("filepath", plain)).alias("path")).distinct()
