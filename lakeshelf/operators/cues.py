"""Cue points of tracks from series of frames, or estimates from tempo and duration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least shares of a track's peak by feature, largest shares of valleys, and where the end begins.
MIX_LEVEL, MIX_BASS = 0.22, 0.15
GROOVE_LEVEL, GROOVE_BASS = 0.48, 0.30
DIP_BELOW, DROP_LEVEL, DROP_NOVELTY, PEAK_LEVEL, DROP_FROM = 0.65, 0.55, 0.45, 0.52, 4
VALLEY_BELOW, END_BELOW, END_FROM = 0.40, 0.58, 0.78
DEFAULT_BPM = 128.0
TYPES = ["intro_start", "mix_in", "groove_start", "drop", "breakdown", "outro_start"]

CUE = "struct<cue_type:string,time_sec:double,bar:int,confidence:double,source:string>"
FEATURES = ("level", "bass", "flux")


def bar_seconds(bpm: Column) -> Column:
    return F.lit(240.0) / F.when(bpm > 0, bpm).otherwise(DEFAULT_BPM)


def held_average(rows: DataFrame, key: str, at: str, values: dict[str, int]) -> DataFrame:
    """rows with each value as its mean over a width of rows around it; near an end, the nearest full mean goes on.

    Keys with fewer rows than a width have nulls there.
    """
    order = Window.partitionBy(key).orderBy(at)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, means = F.row_number().over(order), {}
    for name, width in values.items():
        near = order.rowsBetween(-((width - 1) // 2), width // 2)
        means[name] = F.when(F.count("*").over(near) == width, F.avg(name).over(near))
    rows = rows.withColumns({"__place": place} | {f"__{name}": mean for name, mean in means.items()})
    held = {name: F.coalesce(f"__{name}", F.when(F.col("__place") <= width, F.first(f"__{name}", True).over(whole)).otherwise(F.last(f"__{name}", True).over(whole))) for name, width in values.items()}
    return rows.withColumns(held).drop("__place", *[f"__{name}" for name in values])


def bar_profile(frames: DataFrame, tracks: DataFrame, hop: float = 0.1, smooth: float = 4.0) -> DataFrame:
    """(id, bar, level, bass, flux): shares of the track's peak, averaged per bar of four beats, bars from 0.

    frames: (id, frame, level, bass, flux), frames from 0 at every `hop` seconds; tracks: (id, bpm, duration_sec). Frames
    are averaged over `smooth` seconds first, flux over half of that. A bar beyond the last frame has that frame's values, one
    between two frames 0.
    Shares are rounded to 6 digits. Tracks without a duration or with too few frames to average have no bars.
    """
    return bar_runs(frames, tracks, hop, smooth).select("id", F.explode(F.sequence("bar", "until")).alias("bar"), *FEATURES)


def bar_runs(frames: DataFrame, tracks: DataFrame, hop: float = 0.1, smooth: float = 4.0) -> DataFrame:
    """(id, bar, until, level, bass, flux): the bars of `bar_profile`, where all beyond the last frame but the first and the last are one row.

    However long a track is, it has no more rows than frames, bars between frames, and three.
    """
    width = max(1, int(smooth / hop + 1e-9))
    even = held_average(frames.select("id", "frame", *FEATURES), "id", "frame", {"level": width, "bass": width, "flux": max(1, width // 2)})
    long = bar_seconds(F.col("bpm"))
    timed = even.join(tracks.select("id", long.alias("__long"), "duration_sec"), "id").where("level IS NOT NULL")
    timed = timed.withColumn("__bars", F.ceil(F.round(F.col("duration_sec") / F.col("__long") - 0.5, 9)).cast("int")).where("__bars > 0")
    bar = F.least(F.col("__bars"), F.ceil(F.round((F.col("frame") + 1) * hop / F.col("__long"), 9)).cast("int")) - 1
    whole = Window.partitionBy("id")
    last = F.col("frame") == F.max("frame").over(whole)
    timed = timed.withColumn("__bar", bar).withColumns({"__last": last, "__after": F.coalesce(F.lag("__bar").over(whole.orderBy("frame")), F.lit(-1))})

    def run(first: Column, until: Column, held: bool = True) -> Column:
        return F.struct(first.alias("bar"), until.alias("until"), F.lit(held).alias("held"))

    own, end = F.col("__bar"), F.col("__bars") - 1
    skipped = F.when(own > F.col("__after") + 1, F.sequence(F.col("__after") + 1, own - 1)).otherwise(F.array().cast("array<int>"))
    beyond = F.array(run(own + 1, F.least(own + 1, end)), run(own + 2, end - 1), run(F.greatest(own + 2, end), end))
    beyond = F.filter(beyond, lambda r: F.col("__last") & (r["bar"] <= r["until"]))
    runs = timed.select("id", *FEATURES, F.inline(F.concat(F.transform(skipped, lambda b: run(b, b, False)), F.array(run(own, own)), beyond)))
    means = runs.groupBy("id", "bar", "until").agg(*[F.coalesce(F.avg(F.when(F.col("held"), F.col(c))), F.lit(0.0)).alias(c) for c in FEATURES])
    peak = {c: F.max(c).over(Window.partitionBy("id")) for c in FEATURES}
    return means.select("id", "bar", "until", *[F.when(peak[c] > 1e-9, F.round(F.col(c) / peak[c], 6)).otherwise(0.0).alias(c) for c in FEATURES])


def marks(profile: DataFrame) -> DataFrame:
    """One row a track of at least four bars: the bar of each cue with its values, or null.

    profile: as `bar_profile` or `bar_runs` gives it. Of a row of several bars the first that a search may take stands for all,
    since they and the bars around them have the same values. All is found by windows and one aggregate over the same
    partitioning: the profile is shuffled once.
    """
    if "until" not in profile.columns:
        profile = profile.withColumn("until", F.col("bar"))
    whole = Window.partitionBy("id")
    order = whole.orderBy("bar")
    level, bass, bar, until, n = (F.col(c) for c in ("level", "bass", "bar", "until", "n"))
    bars, following = until - bar + 1, order.rowsBetween(0, Window.unboundedFollowing)
    rows = profile.withColumns({
        "n": F.sum(bars).over(whole), "next_level": F.lead("level").over(order), "next_bass": F.lead("bass").over(order), "jump": F.greatest(F.lit(0.0), F.round(bass - F.coalesce(F.lag("bass").over(order), F.lit(0.0)), 6)),
        "rest": F.round(F.sum(level * bars).over(following) / F.sum(bars).over(following), 9),
        "dipped": F.coalesce(F.min(F.when(until >= DROP_FROM, level)).over(order.rowsBetween(Window.unboundedPreceding, 0)) < DIP_BELOW, F.lit(False)),
    }).where("n >= 4")

    def least(by: list[Column], values: list[str], low: Column, below: Column, test: Column) -> Column:
        """The least (by, bar, values) of the bars from low to below that pass the test."""
        at = F.greatest(bar, low.cast("int"))
        return F.min(F.when((at <= until) & (at < below) & test, F.struct(*by, at.alias("bar"), *values)))

    def first(low: Column, below: Column, test: Column) -> Column:
        return least([], ["level", "bass", "flux", "jump", "next_level", "dipped"], low, below, test)

    novelty = F.round(0.6 * F.col("flux") + 0.4 * F.col("jump"), 9)
    searched = (F.lit(DROP_FROM), F.greatest(F.lit(DROP_FROM + 2), F.floor(n * 0.75)))
    mixed = first(F.lit(2), F.floor(n * 0.45) + 2, (level >= MIX_LEVEL) & (bass >= MIX_BASS))
    dropped = first(*searched, F.col("dipped") & (novelty > DROP_NOVELTY) & (level > DROP_LEVEL))
    newest = least([(-novelty).alias("by")], ["level", "bass", "flux", "jump", "next_level", "dipped"], *searched, level > PEAK_LEVEL)
    rows = rows.withColumns({
        "mix": F.coalesce(mixed.over(whole), first(F.lit(2), n, level >= MIX_LEVEL).over(whole)), "found_drop": dropped.over(whole), "newest": newest.over(whole),
        "any_dip": F.coalesce(least([level], [], *searched, F.lit(True)).over(whole)["level"] < DIP_BELOW, F.lit(False)),
    })
    rows = rows.withColumns({"drop": F.coalesce("found_drop", F.col("newest").dropFields("by")), "found_drop": F.col("found_drop").isNotNull()}).drop("newest")
    start = F.coalesce(F.col("mix.bar"), F.lit(2))
    loud = (level >= GROOVE_LEVEL) & (F.col("next_level") >= GROOVE_LEVEL)
    low_from = F.coalesce(F.col("drop.bar") + 4, F.floor(n / 3))
    end_from = F.greatest(F.lit(1), F.floor(n * END_FROM))
    at_end = least([level], ["bass"], end_from, n, F.lit(True))
    return rows.groupBy("id").agg(
        F.max("n").alias("n"), F.max("mix").alias("mix"), F.max("drop").alias("drop"), F.max(F.when(F.col("found_drop"), True).otherwise(F.col("any_dip"))).alias("had_dip"),
        F.coalesce(first(start, n, loud & (bass >= GROOVE_BASS) & (F.col("next_bass") >= GROOVE_BASS)), first(start, n, loud)).alias("groove"),
        least([level], ["bass"], low_from, F.greatest(low_from + 4, F.floor(n * 0.85)), low_from < n - 4).alias("valley"),
        F.coalesce(least([], ["bass"], end_from, n - 1, (level < END_BELOW) & (F.col("rest") < END_BELOW)), F.struct(at_end["bar"].alias("bar"), at_end["bass"].alias("bass"))).alias("end"),
    )


def scored(found: DataFrame) -> Column:
    """array<CUE> of a row of marks; a cue's confidence grows with the features that agree, times come from `long`."""
    mix, groove, drop, valley, end = (found[c] for c in ("mix", "groove", "drop", "valley", "end"))

    def more(test: Column, by: float) -> Column:
        return F.when(test, by).otherwise(0.0)

    at = {"intro_start": F.lit(0), "mix_in": mix["bar"], "groove_start": groove["bar"], "drop": drop["bar"], "breakdown": F.when(valley["level"] < VALLEY_BELOW, valley["bar"]), "outro_start": end["bar"]}
    sure = {
        "intro_start": F.lit(1.0),
        "mix_in": F.when(mix["bass"] >= MIX_BASS, 0.72).otherwise(0.55) + more(mix["next_level"] >= MIX_LEVEL, 0.08),
        "groove_start": F.when(groove["bass"] >= GROOVE_BASS, 0.75).otherwise(0.60),
        "drop": F.least(F.lit(0.90), 0.65 + more(drop["flux"] > 0.50, 0.12) + more(drop["jump"] > 0.28, 0.08) + more(found["had_dip"], 0.05)),
        "breakdown": F.least(F.lit(0.82), 0.60 + more(valley["bass"] < 0.25, 0.10) + more(valley["level"] < 0.30, 0.08)),
        "outro_start": F.least(F.lit(0.82), 0.68 + more(end["bass"] < 0.35, 0.07) + more(end["bar"] >= F.floor(found["n"] * 0.82), 0.05)),
    }
    cues = [F.struct(F.lit(k).alias("cue_type"), F.round(at[k] * F.col("long"), 2).alias("time_sec"), (at[k] + 1).cast("int").alias("bar"), F.round(sure[k], 3).alias("confidence"), F.lit("energy_analysis").alias("source")) for k in TYPES]
    return F.filter(F.array(*cues), lambda c: c["bar"].isNotNull()).cast(f"array<{CUE}>")


def estimated(duration: Column, long: Column) -> Column:
    """array<CUE> from tempo and duration alone, in the usual places; cues in the last half bar are left out."""
    drop = F.greatest(F.lit(25), F.floor(duration * 0.26 / long) + 1)
    valley = F.greatest(drop + 8, F.floor(duration * 0.58 / long) + 1)
    end = F.greatest(duration - 110.0, duration * 0.80)
    bars = [F.lit(1), F.lit(9), F.lit(17), drop, valley, F.greatest(valley + 4, F.floor(end / long) + 1)]
    times = [*[(b - 1) * long for b in bars[:-1]], end]
    sure = [1.0, 0.50, 0.40, 0.35, 0.30, 0.45]
    cues = [F.struct(F.lit(k).alias("cue_type"), t.alias("time_sec"), b.cast("int").alias("bar"), F.lit(c).alias("confidence"), F.lit("bpm_estimate").alias("source")) for k, t, b, c in zip(TYPES, times, bars, sure, strict=True)]
    kept = F.filter(F.array(*cues), lambda c: c["time_sec"] < duration - long * 0.5)
    return F.transform(kept, lambda c: c.withField("time_sec", F.round(c["time_sec"], 2))).cast(f"array<{CUE}>")


def cue_points(profile: DataFrame, tracks: DataFrame) -> DataFrame:
    """(id, cue_type, time_sec, bar, confidence, source): up to six cues for each track with a duration; bars from 1.

    Tracks whose profile has fewer than four bars, or none, get estimates. Tracks without a tempo count as 128, those
    without a duration have no cues. tracks has one row an id: (id, bpm, duration_sec); profile is as `marks` takes it.
    """
    rows = tracks.where("duration_sec > 0").select("id", bar_seconds(F.col("bpm")).alias("long"), "duration_sec").join(marks(profile), "id", "left")
    cues = F.when(F.col("n").isNotNull(), scored(rows)).otherwise(estimated(F.col("duration_sec"), F.col("long")))
    return rows.select("id", F.inline(cues))


def cue_master(cues: DataFrame, tracks: DataFrame) -> DataFrame:
    """(id, artist, title, bpm, key, duration_sec, cues): each known track that has cues, with a map of its cues by type."""
    value = F.struct("cue_type", F.struct("time_sec", "bar", "confidence", "source").alias("cue"))
    by_track = cues.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_set(value))).alias("cues"))
    name = F.regexp_extract("filepath", r"([^/]*?)(?:\.[^./]*)?$", 1)
    named = tracks.select(
        "id", F.coalesce(F.nullif("artist", F.lit("")), F.lit("Unknown")).alias("artist"), F.coalesce(F.nullif("title", F.lit("")), name).alias("title"), F.round(F.coalesce("bpm", F.lit(0.0)), 2).alias("bpm"),
        F.coalesce("key_camelot", F.lit("")).alias("key"), F.round(F.coalesce("duration_sec", F.lit(0.0)), 1).alias("duration_sec"),
    )
    return named.join(by_track, "id")
