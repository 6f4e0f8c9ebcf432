"""Suggestions of what to play next, and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeshelf.functions import scoring, text
from lakeshelf.operators import resolution
from lakeshelf.operators.resolution import kept

# Each vibe's shares of a set's time by phase, the phases of a structure, genres that the deep vibe prefers.
VIBES = {
    "warm": {"warmup": 0.30, "build": 0.30, "peak": 0.15, "release": 0.15, "outro": 0.10},
    "peak": {"warmup": 0.12, "build": 0.20, "peak": 0.40, "release": 0.18, "outro": 0.10},
    "deep": {"warmup": 0.25, "build": 0.30, "peak": 0.15, "release": 0.20, "outro": 0.10},
    "driving": {"warmup": 0.15, "build": 0.25, "peak": 0.35, "release": 0.15, "outro": 0.10},
}
STRUCTURES = {"full": ["warmup", "build", "peak", "release", "outro"], "simple": ["build", "peak", "outro"], "peak_only": ["peak"]}
DEEP_GENRES = ["deep house", "organic house", "melodic house", "afro house", "melodic techno", "melodic", "organic"]
#: Words of a genre or title that mark a track as no song of its own.
TOOLS = "acapella|a cappella|dj tool|drum tool|fx tool|percussion tool"

STRATEGIES = ("safest", "smooth", "warmup", "late", "lift", "total")


def sides(prefix: str = "") -> dict:
    bpm, genre = F.col(f"{prefix}bpm"), F.col(f"{prefix}genre")
    return {"key": F.col(f"{prefix}key_camelot"), "bpm": bpm, "energy": scoring.energy_of(bpm, genre, mixing=True), "genre": genre}


def suggestions(tracks: DataFrame, current: DataFrame, strategy: str = "safest", n: int = 10, exclude: DataFrame | None = None, weights: dict | None = None) -> DataFrame:
    """(id, score): the n best tracks after the one row of current; its id and those of exclude are left out.

    The single row is a broadcast of known size; the top n are merged from each task's own. Ties by artist, title, id.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    now = current.limit(1).select(*[F.col(c).alias(f"now_{c}") for c in ("id", "bpm", "genre", "key_camelot")])
    rows = tracks.where("status = 'ok'").join(F.broadcast(now), F.col("id") != F.col("now_id"))
    if exclude is not None:
        rows = rows.join(exclude.select(F.col("id").alias("__out")), F.col("id") == F.col("__out"), "left_anti")
    score = scoring.transition(sides("now_"), sides(), weights)[strategy]
    return rows.withColumn("score", score).orderBy(F.desc("score"), F.asc_nulls_first("artist"), F.asc_nulls_first("title"), "id").limit(n).select("id", "score")


def by_key_and_tempo(tracks: DataFrame, key: str, bpm: float, genre: str | None = None, strategy: str = "safest", n: int = 10) -> DataFrame:
    spark = tracks.sparkSession
    now = spark.range(1).select(F.lit(-1).alias("id"), F.lit(float(bpm)).alias("bpm"), F.lit(genre).cast("string").alias("genre"), F.lit(key).alias("key_camelot"))
    return suggestions(tracks, now, strategy, n)


def set_tracks(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """Every entry of every set with its track's columns, null where the track is missing."""
    t = tracks.select(F.col("id").alias("track_id"), "artist", "title", "bpm", "genre", "key_camelot")
    return entries.join(t, "track_id", "left")


def transitions(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """(set_id, position, total): the score of each step of a set after its first."""
    rows = set_tracks(entries, tracks)
    w = Window.partitionBy("set_id").orderBy("position")
    before = {f"now_{c}": F.lag(c).over(w) for c in ("bpm", "genre", "key_camelot")}
    rows = rows.withColumns(before | {"step": F.row_number().over(w)}).where("step > 1")
    return rows.select("set_id", "position", scoring.transition(sides("now_"), sides())["total"].alias("total"))


def repeats(entries: DataFrame, tracks: DataFrame, window: int = 3) -> DataFrame:
    """(set_id, position): entries whose artist is among the last `window` ones."""
    w = Window.partitionBy("set_id").orderBy("position").rowsBetween(-window, -1)
    rows = set_tracks(entries, tracks).withColumn("recent", F.collect_list("artist").over(w))
    return rows.where(F.array_contains("recent", F.col("artist"))).select("set_id", "position")


#: Up to so many groups the last picks are broadcast; more are shuffled.
MOST_BROADCAST = 10_000


def build_sets(tracks: DataFrame, group: str, minutes: float = 60, strategy: str = "safest", max_jump: float = 3.0, window: int = 3) -> DataFrame:
    """(group, position, id): one greedy set a group, from all of its tracks.

    Each pick has the best score after the last one, keeps the tempo step within max_jump and the artist out of the last
    `window`; if none fits, the limits are dropped for that pick. The first pick and ties go by artist, title, id. A track
    without a positive duration counts as six minutes. Picks depend on each other, so each is one pass over the tracks of
    all unfinished groups, merged from each task's own best.
    """
    base, _ = text.version_parts(F.coalesce("title", F.lit("")))
    artist = F.coalesce(text.primary_artist(F.col("artist")), F.lit(""))
    name = F.concat_ws("\0", artist, F.coalesce(text.compare_name(base), F.lit("")))
    seconds = F.when(F.col("duration_sec") > 0, F.col("duration_sec")).otherwise(360.0)
    rows = tracks.where("status = 'ok' AND bpm > 0 AND key_camelot IS NOT NULL").select(F.col(group).alias("__group"), "id", "artist", "title", "bpm", "genre", "key_camelot", artist.alias("__artist"), name.alias("__name"), seconds.alias("__seconds"))
    rows = kept(rows)
    order = [F.col("artist").isNull(), F.col("artist"), F.col("title").isNull(), F.col("title"), F.col("id")]
    pick = F.struct("id", "bpm", "genre", "key_camelot", "__artist", "__name", "__seconds")
    state = rows.groupBy("__group").agg(F.min_by(pick, F.struct(*order)).alias("p"))
    state = state.select("__group", "p", F.array("p.id").alias("ids"), F.array("p.__artist").alias("artists"), F.array("p.__name").alias("names"), F.col("p.__seconds").alias("played"), F.lit(False).alias("ended"))
    state = kept(state)
    few = state.count() <= MOST_BROADCAST
    done = []
    while True:
        over = F.col("ended") | (F.col("played") >= minutes * 60)
        done.append(state.where(over).select("__group", "ids"))
        state = state.where(~over)
        if state.isEmpty():
            break
        last = state.select("__group", *[F.col(f"p.{c}").alias(f"now_{c}") for c in ("bpm", "genre", "key_camelot")], F.slice(F.reverse("artists"), 1, window).alias("recent"), "names")
        new = rows.join(F.broadcast(last) if few else last, rows["__group"].eqNullSafe(last["__group"])).drop(last["__group"]).where(~F.array_contains("names", F.col("__name")))
        fits = (F.abs(F.col("bpm") - F.col("now_bpm")) <= max_jump) & ~F.array_contains("recent", F.col("__artist"))
        score = scoring.transition(sides("now_"), sides())[strategy]
        best = new.groupBy("__group").agg(F.min_by(pick, F.struct(~fits, -score, *order)).alias("q")).withColumnRenamed("__group", "__of")
        found, none = F.col("q.id"), F.col("q").isNull()
        state = state.join(F.broadcast(best) if few else best, F.col("__group").eqNullSafe(F.col("__of")), "left").select(
            "__group", F.coalesce("q", "p").alias("p"), F.when(none, F.col("ids")).otherwise(F.array_append("ids", found)).alias("ids"),
            F.when(none, F.col("artists")).otherwise(F.array_append("artists", F.col("q.__artist"))).alias("artists"), F.when(none, F.col("names")).otherwise(F.array_append("names", F.col("q.__name"))).alias("names"),
            (F.col("played") + F.coalesce("q.__seconds", F.lit(0.0))).alias("played"), none.alias("ended"))
        state = kept(state)
    sets = reduce(DataFrame.unionByName, done)
    return sets.select(F.col("__group").alias(group), F.posexplode("ids").alias("at", "id")).select(group, (F.col("at") + 1).cast("int").alias("position"), "id")


def phase_times(vibe: str, structure: str, minutes: float) -> list[tuple[str, float]]:
    """(phase, seconds) of a set: the vibe's shares, spread over the phases of the structure."""
    phases = STRUCTURES[structure]
    whole = sum(VIBES[vibe][p] for p in phases)
    return [(p, 60 * minutes * VIBES[vibe][p] / whole) for p in phases]


def phased_sets(tracks: DataFrame, group: str, minutes: float = 60, vibe: str = "peak", structure: str = "full", strategy: str = "safest", max_jump: float = 3.0, window: int = 3) -> DataFrame:
    """(group, position, phase, id): one set a group that goes through the phases of a structure.

    A set begins with the track that suits its first phase best. Each later pick is the best by the strategy's score, less
    for a large tempo step and for an artist of the set, among those that keep the tempo within max_jump, the key at the
    same number or next to it in the same mode, and the artist out of the last `window`. Where none does, any artist may
    come, then any tempo and key. A phase ends when its time is played, the set with its last phase or its last track.
    Ties go by how well a track suits the phase, then artist, title, id. Tracks that are tools, have no known artist, no
    tempo or no key, copies of a better file and second tracks of one artist and title don't come; null groups form one.

    Sets of all groups grow together: a pick is one pass over the tracks of unfinished groups, so jobs grow with the
    longest set, not with groups or tracks. A track without a duration counts as long as the mean of all.
    """
    if strategy not in STRATEGIES or vibe not in VIBES or structure not in STRUCTURES:
        raise ValueError(f"unknown strategy, vibe or structure: {strategy}, {vibe}, {structure}")
    times = phase_times(vibe, structure, minutes)
    rows = tracks.where("status = 'ok'").where(~F.lower(F.concat_ws(" ", F.coalesce("genre", F.lit("")), F.coalesce("title", F.lit("")))).rlike(TOOLS))
    rows = rows.join(resolution.near_copies(rows).select("id"), "id", "left_semi")
    mean = rows.agg(F.coalesce(F.avg(F.when(F.col("duration_sec") != 0, F.col("duration_sec"))), F.lit(360.0)).alias("__mean"))
    rows = rows.crossJoin(F.broadcast(mean)).where("bpm > 0 AND key_camelot <> ''").where(~text.is_unknown_artist(F.col("artist")))

    def plain(name: str):
        return F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s*\(\d+\)\s*$", ""))

    energy, deep = sides()["energy"], F.lower("genre").rlike("|".join(DEEP_GENRES)) if vibe == "deep" else F.lit(False)
    fits = F.array(*[F.least(F.lit(1.0), scoring.phase_fit(p, energy, F.col("bpm"))) + F.when(deep, 0.2).otherwise(0.0) for p, _ in times])
    rows = kept(rows.select(
        F.col(group).alias("__group"), "id", "artist", "title", "bpm", "genre", "key_camelot", text.primary_artist(F.col("artist")).alias("__artist"), F.concat_ws("\0", plain("artist"), plain("title")).alias("__name"),
        F.when(F.col("duration_sec") > 0, F.col("duration_sec")).otherwise(F.col("__mean")).alias("__seconds"), fits.alias("__fits"),
    ))
    order = [F.col("artist").isNull(), F.col("artist"), F.col("title").isNull(), F.col("title"), F.col("id")]
    pick = F.struct("id", "bpm", "genre", "key_camelot", "__artist", "__name", "__seconds")
    limits, names = F.array(*[F.lit(float(t)) for _, t in times]), F.array(*[F.lit(p) for p, _ in times])

    def advanced(state: DataFrame, q) -> DataFrame:
        """States after a pick q, or ended where there is none: (__group, p, at, played, ended, picks, artists, names)."""
        played, none = F.col("played") + q["__seconds"], q.isNull()
        over = ~none & (played >= F.get(limits, F.col("at")))
        return state.select(
            "__group", F.coalesce(q, F.col("p")).alias("p"), F.when(over, F.col("at") + 1).otherwise(F.col("at")).alias("at"), F.when(over, 0.0).otherwise(F.coalesce(played, F.col("played"))).alias("played"),
            (none | (over & (F.col("at") + 1 >= len(times)))).alias("ended"),
            *[F.when(none, F.col(c)).otherwise(F.array_append(c, new)).alias(c) for c, new in (("picks", F.struct(F.get(names, F.col("at")).alias("phase"), q["id"].alias("id"))), ("artists", q["__artist"]), ("names", q["__name"]))],
        )

    id_type = rows.schema["id"].dataType.simpleString()
    first = rows.groupBy("__group").agg(F.min_by(pick, F.struct(-F.col("__fits")[0], *order)).alias("q"))
    empty = {"at": "0", "played": "0.0D", "picks": f"CAST(array() AS array<struct<phase:string,id:{id_type}>>)", "artists": "CAST(array() AS array<string>)", "names": "CAST(array() AS array<string>)"}
    state = kept(advanced(first.select("__group", "q", F.col("q").alias("p"), *[F.expr(e).alias(c) for c, e in empty.items()]), F.col("q")))
    few = state.count() <= MOST_BROADCAST
    # the same expressions serve every pick
    apart = scoring.wheel_distance(F.col("now_key_camelot"), F.col("key_camelot"))
    in_key = (apart == 0) | ((apart == 1) & (scoring.wheel_mode(F.col("now_key_camelot")) == scoring.wheel_mode(F.col("key_camelot"))))
    near = in_key & (F.abs(F.col("bpm") - F.col("now_bpm")) <= max_jump if max_jump > 0 else F.lit(True))
    recent = (F.col("__artist") != "") & F.array_contains(F.slice(F.reverse("artists"), 1, window) if window > 0 else F.array().cast("array<string>"), F.col("__artist"))
    stage = F.when(near & ~recent, 0).when(near, 1).otherwise(2)
    score = scoring.transition(sides("now_"), sides())[strategy] * scoring.tempo_step_penalty(F.col("now_bpm"), F.col("bpm"))
    score = score * F.when((F.col("__artist") != "") & F.array_contains("artists", F.col("__artist")), 0.35).otherwise(1.0)
    best_pick = F.min_by(pick, F.struct(stage, -F.round(score, 9), -F.get("__fits", F.col("at")), *order)).alias("q")
    done = []
    while True:
        done.append(state.where("ended").select("__group", "picks"))
        state = state.where("NOT ended")
        if state.isEmpty():
            break
        last = state.select("__group", "at", "names", "artists", *[F.col(f"p.{c}").alias(f"now_{c}") for c in ("bpm", "genre", "key_camelot")])
        new = rows.join(F.broadcast(last) if few else last, rows["__group"].eqNullSafe(last["__group"])).drop(last["__group"]).where(~F.array_contains("names", F.col("__name")))
        best = new.groupBy("__group").agg(best_pick).withColumnRenamed("__group", "__of")
        state = kept(advanced(state.join(F.broadcast(best) if few else best, F.col("__group").eqNullSafe(F.col("__of")), "left"), F.col("q")))
    sets = reduce(DataFrame.unionByName, done)
    return sets.select(F.col("__group").alias(group), F.posexplode("picks").alias("__at", "pick")).select(group, (F.col("__at") + 1).cast("int").alias("position"), "pick.phase", "pick.id")
