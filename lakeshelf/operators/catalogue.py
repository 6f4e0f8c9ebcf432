"""Filters, paging and aggregates over a track catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.functions import scoring, text

#: Allowed sort keys; nulls come first ascending and last descending.
SORT_KEYS = ["artist", "title", "bpm", "genre", "id"]
SEVERITY = ["error", "missing_bpm", "missing_key", "missing_artist", "missing_title", "needs_review", "weak_filename_parse", "suspicious_artist", "suspicious_title"]


def with_issues(tracks: DataFrame) -> DataFrame:
    names = {"bpm": "bpm", "key": "key_camelot", "artist": "artist", "title": "title", "status": "status", "parse_confidence": "parse_confidence"}
    return tracks.withColumn("issues", text.issues({k: F.col(v) for k, v in names.items()}))


def under(path: Column, *roots: str) -> Column:
    """Below one of several equivalent roots."""
    return reduce(lambda a, b: a | b, [path.startswith(r.rstrip("/") + "/") for r in roots])


def hidden_or_maintenance(path: Column, skipped: tuple[str, ...] = ("_quarantine", "_rejected", "logs")) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.isin(*skipped) | p.startswith("."))


def filtered(tracks: DataFrame, *, path=None, q=None, status=None, artist=None, genre=None, key=None, bpm_min=None, bpm_max=None, has_key=None, issue=None, parse_confidence=None) -> DataFrame:
    """The conjunction of the given predicates; texts are searched without regard to case."""
    tests = {
        path: lambda: under(F.col("filepath"), path),
        q: lambda: reduce(lambda a, b: a | b, [F.lower(c).contains(q.lower()) for c in ("artist", "title", "filepath")]),
        status: lambda: F.col("status") == status,
        artist: lambda: F.lower("artist") == artist.lower(),
        genre: lambda: F.lower("genre") == genre.lower(),
        key: lambda: F.upper("key_camelot") == key.upper(),
        parse_confidence: lambda: F.upper("parse_confidence") == parse_confidence.upper(),
    }
    found = [test() for value, test in tests.items() if value is not None]
    found += [F.col("bpm") >= bpm_min] if bpm_min is not None else []
    found += [F.col("bpm") <= bpm_max] if bpm_max is not None else []
    found += [F.col("key_camelot").isNotNull() if has_key else F.col("key_camelot").isNull()] if has_key is not None else []
    rows = tracks.where(reduce(lambda a, b: a & b, found)) if found else tracks
    return with_issues(rows).where(F.array_contains("issues", issue)) if issue else rows


def page(rows: DataFrame, sort: str = "artist", descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page under an allowed key; ties by title, then id; the limit is held to 1 to 500."""
    if sort not in SORT_KEYS:
        raise ValueError(f"sort must be one of {SORT_KEYS}")
    first = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_first()
    return rows.orderBy(first, F.asc_nulls_first("title"), "id").offset(max(0, offset)).limit(min(500, max(1, limit)))


def overview(tracks: DataFrame) -> DataFrame:
    return tracks.agg(
        F.count("*").alias("total_tracks"),
        F.count("bpm").alias("tracks_with_bpm"),
        F.count_if(~scoring.blank(F.col("key_camelot"))).alias("tracks_with_camelot_key"),
        F.count_if(scoring.blank(F.col("artist"))).alias("tracks_missing_artist"),
        F.count_if(scoring.blank(F.col("title"))).alias("tracks_missing_title"),
    )


def counted(rows: DataFrame, key: Column, name: str, missing: str = "UNKNOWN") -> DataFrame:
    """(name, n): rows by a trimmed key, blank ones under `missing`."""
    return rows.groupBy(F.coalesce(F.nullif(F.trim(key), F.lit("")), F.lit(missing)).alias(name)).agg(F.count("*").alias("n"))


def issue_counts(tracks: DataFrame) -> DataFrame:
    return with_issues(tracks).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def issues_ranked(tracks: DataFrame, limit: int = 200) -> DataFrame:
    """(id, issue), the severest first, then by artist in lower case and id."""
    rank = reduce(lambda c, k: c.when(F.col("issue") == SEVERITY[k], k), range(1, len(SEVERITY)), F.when(F.col("issue") == SEVERITY[0], 0))
    rows = with_issues(tracks).select("id", "artist", F.explode("issues").alias("issue"))
    return rows.orderBy(rank, F.lower("artist").asc_nulls_first(), "id").limit(limit).select("id", "issue")


def folder_stats(tracks: DataFrame) -> DataFrame:
    return with_issues(tracks).groupBy(text.folder(F.col("filepath")).alias("folder")).agg(F.count("*").alias("track_count"), F.count_if(F.size("issues") > 0).alias("issue_count"))


def coverage(tracks: DataFrame) -> DataFrame:
    """Percentages of tracks with tempo, key, artist and title, and the score of the whole, in one pass."""
    counts = {
        "total": F.count("*"), "bpm": F.count("bpm"), "key": F.count_if(~scoring.blank(F.col("key_camelot"))), "artist": F.count_if(~scoring.blank(F.col("artist"))), "title": F.count_if(~scoring.blank(F.col("title"))),
        "weak": F.count_if(F.upper("parse_confidence").isin("MEDIUM", "LOW")), "suspicious": F.count_if(text.is_unknown_artist(F.col("artist")) & ~scoring.blank(F.col("artist"))),
    }
    rows, total = tracks.agg(*[c.alias(n) for n, c in counts.items()]), F.col("total")
    missing = (total - F.col("bpm")) + (total - F.col("key"))
    lost = 8 * scoring.percent(missing, 2 * total) / 10 + 4 * scoring.percent(F.col("suspicious"), total) / 10 + 2 * scoring.percent(F.col("weak"), total) / 10
    parts = [scoring.percent(F.col(c), total).alias(f"{c}_pct") for c in ("bpm", "key", "artist", "title")]
    return rows.select(*parts, F.greatest(F.lit(0), F.least(F.lit(100), F.round(100 - lost))).cast("int").alias("score"))


def quality_gate(tracks: DataFrame, least_kbps: int = 128, least_sec: float = 30, most_sec: float = 7200) -> DataFrame:
    """(id, reason): the first failure of each file, null if it passes; an unknown bit rate (0) passes."""
    lossy = text.extension(F.col("filepath")).isin("mp3", "m4a", "ogg", "opus")
    return tracks.select(
        "id",
        F.when(F.coalesce("filesize_bytes", F.lit(0)) <= 0, "empty")
        .when(F.col("duration_sec") < least_sec, "too_short").when(F.col("duration_sec") > most_sec, "too_long")
        .when(lossy & (F.col("bitrate_kbps") > 0) & (F.col("bitrate_kbps") < least_kbps), "low_bitrate").alias("reason"),
    )


def tempo_anomalies(tracks: DataFrame) -> DataFrame:
    reason = scoring.tempo_anomaly(F.col("bpm"), F.col("genre"))
    return tracks.select("id", "bpm", reason.alias("reason")).where("reason IS NOT NULL").withColumn("suggested", scoring.tempo_suggestion(F.col("bpm"), F.col("reason")))


def distribution(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, pct of all rows)."""
    from pyspark.sql import Window

    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a group


def export_checks(tracks: DataFrame) -> DataFrame:
    """(id, reasons, category): what keeps a track from an export, and the first of it."""
    bad_key = scoring.wheel_number(F.col("key_camelot")).isNull()
    reasons = F.array_compact(
        F.array(
            F.when(text.file_name(F.col("filepath")).startswith(".") | ~F.col("filepath").startswith("/"), F.lit("BAD_PATH")),
            F.when(F.col("status") == "stale", F.lit("STALE")),
            F.when(scoring.blank(F.col("artist")) | scoring.blank(F.col("title")), F.lit("MISSING_METADATA")),
            F.when(F.coalesce("bpm", F.lit(0.0)) <= 0, F.lit("MISSING_BPM")).when(~F.col("bpm").between(50, 220), F.lit("BAD_BPM")),
            F.when(F.col("key_camelot").isNull(), F.lit("MISSING_KEY")).when(bad_key, F.lit("BAD_KEY")),
            F.when(text.is_junk_genre(F.col("genre")), F.lit("JUNK_GENRE")),
        )
    )
    return tracks.select("id", reasons.alias("reasons")).withColumn("category", F.coalesce(F.get("reasons", F.lit(0)), F.lit("VALID")))


def playlists(tracks: DataFrame, least: int = 2) -> DataFrame:
    """(family, playlist, id): genre, energy, combined and key playlists with at least `least` tracks.

    Acapella and tool routes are left out of all families.
    """
    from pyspark.sql import Window

    genre, energy = text.genre_name(F.col("genre")), scoring.energy_of(F.col("bpm"), F.col("genre"))
    key = F.when(scoring.wheel_number(F.col("key_camelot")).isNotNull(), F.upper(F.trim("key_camelot")))
    named = F.when(~text.is_junk_genre(genre), genre)
    rows = tracks.where((F.col("status") == "ok") & ~F.lower(F.concat_ws(" ", "genre", "title")).rlike("acapella|\\btools?\\b"))
    families = F.array(
        F.struct(F.lit("genre").alias("family"), named.alias("playlist")),
        F.struct(F.lit("energy").alias("family"), energy.alias("playlist")),
        F.struct(F.lit("combined").alias("family"), F.concat(energy, F.lit(" "), named).alias("playlist")),
        F.struct(F.lit("key").alias("family"), key.alias("playlist")),
    )
    each = rows.select("id", F.explode(families).alias("f")).select("f.family", "f.playlist", "id").where("playlist IS NOT NULL")
    sizes = each.groupBy("family", "playlist").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return each.join(sizes.drop("n"), ["family", "playlist"])
