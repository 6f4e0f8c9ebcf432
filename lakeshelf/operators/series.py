"""Series of frames and windows, ordered groups, look-ups and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeshelf.functions import text


def look_up(rows: DataFrame, column: str, value) -> DataFrame:
    """The one row whose column has a value, or none; the filter reaches the scan."""
    return rows.where(F.col(column) == F.lit(value)).limit(1)


def bars(frames: DataFrame, key: str, at: str, value: str, bpm: str) -> DataFrame:
    """(key, bar, mean, n): frames averaged per bar of four beats; frames without a positive tempo have no bars."""
    bar = F.floor(F.col(at) / (240.0 / F.col(bpm))).cast("long")
    return frames.where(F.col(bpm) > 0).groupBy(key, bar.alias("bar")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def quietest_after(frames: DataFrame, key: str, at: str, value: str, start: Column, end: Column) -> DataFrame:
    """(key, at, value): the frame with the least value from start to before end; of equal ones the first."""
    inside = frames.where((F.col(at) >= start) & (F.col(at) < end))
    return inside.groupBy(key).agg(F.min_by(at, F.struct(value, at)).alias(at), F.min(value).alias(value))


def median_tempo(windows: DataFrame, key: str, line: str) -> DataFrame:
    """(key, bpm, n): the median of the first number of each line, of those over 20 and below 400."""
    number = F.regexp_extract(line, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    rows = windows.select(key, number.alias("__x")).where((F.col("__x") > 20) & (F.col("__x") < 400))
    return rows.groupBy(key).agg(F.median("__x").alias("bpm"), F.count("*").alias("n"))


def mean_duration(tracks: DataFrame, fallback: float = 360.0) -> DataFrame:
    """(mean): of the durations that aren't zero, or the fallback."""
    return tracks.agg(F.coalesce(F.avg(F.when(F.col("duration_sec") != 0, F.col("duration_sec"))), F.lit(fallback)).alias("mean"))


def placed(rows: DataFrame, name: str, first: list[str]) -> DataFrame:
    """rows with `place`: named groups in the given order, then the others by name. The groups are few, one row each."""
    rank = F.coalesce(F.array_position(F.lit(first), F.col(name)), F.lit(0))
    order = Window.orderBy(F.when(rank == 0, len(first) + 1).otherwise(rank), name)
    groups = rows.select(name).distinct().withColumn("place", F.row_number().over(order))
    return rows.join(F.broadcast(groups), name)


def last_lines(log: DataFrame, n: int, at: str = "id") -> DataFrame:
    """The last n rows of a log in their order, merged from each task's own."""
    return log.orderBy(F.desc(at)).limit(n).orderBy(at)


def matching_tracks(tracks: DataFrame, part: str, least_sec: float = 30, n: int | None = None) -> DataFrame:
    """Tracks long enough whose artist, title or file name holds a text, in any case, by id."""
    fields = (F.col("artist"), F.col("title"), text.stem(F.col("filepath")))
    holds = F.lit(False)
    for f in fields:
        holds = holds | F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(part.lower()))
    rows = tracks.where(holds & (F.col("duration_sec") >= least_sec)).orderBy("id")
    return rows.limit(n) if n is not None else rows


def genre_exports(tracks: DataFrame) -> DataFrame:
    """(kind, genre, n): tracks by normalised genre, and by genre as written, trimmed."""
    normal = tracks.groupBy(text.genre_name(F.col("genre")).alias("genre")).agg(F.count("*").alias("n")).where("genre <> ''")
    raw = tracks.groupBy(F.trim("genre").alias("genre")).agg(F.count("*").alias("n")).where("genre <> ''")
    return normal.select(F.lit("normalised").alias("kind"), "genre", "n").unionByName(raw.select(F.lit("raw").alias("kind"), "genre", "n"))


def run_counters(states: DataFrame, run: Column, statuses: list[str]) -> DataFrame:
    """(run, total, a count for each status, other) of each run."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    return states.groupBy(run.alias("run")).agg(F.count("*").alias("total"), *counts, F.count_if(~F.coalesce(F.col("status").isin(statuses), F.lit(False))).alias("other"))


#: What to do about a library, by which count, in order of urgency.
RECOMMENDED = [("analyze-missing", "missing_bpm"), ("harmonic-keys", "missing_key"), ("parse-filenames", "missing_artist"), ("repair-metadata", "missing_title"), ("review-queue", "needs_review"), ("quality-audit", "low_quality")]


def recommended(counts: DataFrame, most: int = 4) -> DataFrame:
    """(place, action, n) of the first `most` actions whose count in the one row of counts isn't 0."""
    each = F.array(*[F.struct(F.lit(a).alias("action"), F.col(c).cast("long").alias("n")) for a, c in RECOMMENDED])
    some = F.slice(F.filter(each, lambda x: x["n"] > 0), 1, most)
    return counts.select(F.posexplode(some).alias("place", "x")).select((F.col("place") + 1).alias("place"), "x.*")
