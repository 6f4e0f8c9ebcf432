"""Names run together or joined by odd signs, repaired by the names that are known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidences by how many parts are known, names whose sign is their own, and the shortest part.
ALL_KNOWN, SOME_KNOWN, NONE_KNOWN = 0.85, 0.65, 0.45
OWN_SIGNS, SHORTEST_PART = ("ac/dc",), 3
#: Separators of a credit, and of names joined by a slash, a pipe or a backslash.
CREDIT, SIGNS = r"(?i)\s*[,/&]\s*|\s+feat\.?\s+|\s+ft\.?\s+|\s+vs\.?\s+", r"\s*[/|\\]\s*"


def lookup_keys(name: Column) -> Column:
    """The forms by which a name is known: lower case, and that without signs; none for a single character."""
    lower = F.lower(F.trim(name))
    return F.when(F.length(lower) >= 2, F.filter(F.array_distinct(F.array(lower, F.trim(F.regexp_replace(lower, r"[^a-z0-9\s]", "")))), lambda k: k != "")).otherwise(F.array().cast("array<string>"))


def known_artists(folders: DataFrame | None = None, credits: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(key): the distinct forms of all known names, from folders (name), credits (artist) of any number, and aliases (alias, canonical).

    Credits are parted before; null names have no form.
    """
    names = []
    if folders is not None:
        names.append(folders.select("name"))
    if credits is not None:
        names.append(credits.select(F.explode(F.split("artist", CREDIT)).alias("name")))
    if aliases is not None:
        names.append(aliases.select(F.explode(F.array("alias", "canonical")).alias("name")))
    if not names:
        raise ValueError("known artists need a source")
    return reduce(DataFrame.unionByName, names).where("name IS NOT NULL").distinct().select(F.explode(lookup_keys(F.col("name"))).alias("key")).distinct()


def merge_places(name: Column) -> Column:
    """Places after which a small letter meets a capital that may start another name.

    Not in the first three letters of a word, not in the first word of a name, and not before a lone capital at a word's
    end. A place is the number of characters before it.
    """
    places = F.filter(
        F.sequence(F.lit(1), F.length(name)),
        lambda k: F.substring(name, 1, k).rlike(r"[^,/&; ] +[^ ]{3,}[a-z]$") & F.substring(name, k + 1, F.lit(2)).rlike(r"^[A-Z]\p{L}$"),
    )
    return F.when(name.rlike(r"[a-z][A-Z]\p{L}"), places).otherwise(F.array().cast("array<int>"))


def _candidates(rows: DataFrame, key: str, artist: str) -> DataFrame:
    """(key, kind, place, parts, suffix, signs): ways to part an artist; kind 0 by a change of case, 1 by signs."""
    rows = rows.select(key, F.col(artist).alias("__artist")).where("__artist IS NOT NULL")
    suffix = F.regexp_extract("__artist", r"\s*(\([A-Z][a-zA-Z]{0,2}\))\s*$", 1)
    clean = rows.withColumns({"suffix": suffix, "__clean": F.rtrim(F.regexp_replace("__artist", r"\s*\([A-Z][a-zA-Z]{0,2}\)\s*$", ""))})
    cut = clean.withColumn("place", F.explode(merge_places(F.col("__clean"))))
    halves = F.array(F.trim(F.substring(F.col("__clean"), 1, F.col("place"))), F.trim(F.substring(F.col("__clean"), F.col("place") + 1, F.length("__clean"))))
    by_case = cut.select(key, F.lit(0).alias("kind"), "place", halves.alias("parts"), "suffix", F.lit("").alias("signs"))
    parts = F.filter(F.transform(F.split("__artist", SIGNS), lambda p: F.trim(p)), lambda p: p != "")
    signs = F.concat_ws("; ", F.when(F.col("__artist").rlike(r"[/\\]"), "slash_separator_repair"), F.when(F.col("__artist").contains("|"), "pipe_separator_repair"))
    signed = rows.where(F.col("__artist").rlike(r"[/|\\]") & ~F.lower(F.trim("__artist")).isin(*OWN_SIGNS))
    by_signs = signed.select(key, F.lit(1).alias("kind"), F.lit(0).alias("place"), parts.alias("parts"), F.lit("").alias("suffix"), signs.alias("signs"))
    by_signs = by_signs.where((F.size("parts") > 1) & ~F.exists("parts", lambda p: F.length(p) < SHORTEST_PART))
    return by_case.where(~F.exists("parts", lambda p: F.length(p) < 2)).unionByName(by_signs)


def with_known(parts: DataFrame, known: DataFrame, name: str = "part") -> DataFrame:
    """parts with `is_known`: whether one of the forms of `name` is among known (key). Each distinct name is looked up once."""
    names = parts.select(name).distinct()
    found = names.select(name, F.explode(lookup_keys(F.col(name))).alias("key")).join(known, "key", "left_semi").select(name).distinct()
    return parts.join(found.withColumn("is_known", F.lit(True)), name, "left").fillna(False, ["is_known"])


def repairs(rows: DataFrame, known: DataFrame, key: str = "id", artist: str = "artist") -> DataFrame:
    """(key, artist, proposed, confidence, reason, blocked): the best way to part each artist that looks like several, if there is one.

    Names that a change of case or a slash, pipe or backslash may join are parted there; how many parts are among the
    known names (key) decides the confidence, and all but full confidence is blocked for review. Of several ways the most
    confident is proposed, among equals a change of case before signs and the first place. Keys have to be unique; null
    and empty artists have no proposal. Known names are joined, never collected, and each distinct part is joined once.
    """
    ways = _candidates(rows, key, artist)
    parts = ways.select(key, "kind", "place", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part"))
    judged = with_known(parts, known).groupBy(key, "kind", "place", "n").agg(F.count_if("is_known").alias("n_known"), F.max(F.when(F.col("is_known"), F.col("at"))).alias("last_known"))
    confidence = F.when(F.col("n_known") == F.col("n"), ALL_KNOWN).when(F.col("n_known") > 0, SOME_KNOWN).otherwise(NONE_KNOWN)
    judged = judged.withColumn("confidence", confidence)
    best = judged.groupBy(key).agg(F.min(F.struct(-F.col("confidence"), "kind", "place", "confidence", "n", "n_known", "last_known")).alias("best")).select(key, "best.kind", "best.place", "best.confidence", "best.n", "best.n_known", "best.last_known")
    found = ways.join(best, [key, "kind", "place"])
    sides = F.when(F.col("n_known") == F.col("n"), F.when(F.col("kind") == 0, "both").otherwise("all")).when(F.col("n_known") == 0, "none")
    sides = sides.when(F.col("kind") == 1, "some").when(F.col("last_known") == 0, "left").otherwise("right")
    reason = F.concat(F.when(F.col("kind") == 0, "camelcase_merge_detected").otherwise(F.col("signs")), F.lit("; known_sides="), sides)
    proposed = F.concat_ws(" ", F.array_join("parts", ", "), F.when(F.col("suffix") != "", F.col("suffix")))
    out = found.select(key, proposed.alias("proposed"), "confidence", reason.alias("reason"), (F.col("n_known") < F.col("n")).alias("blocked"))
    return rows.select(key, F.col(artist).alias("artist")).join(out, key)


def repair_counts(found: DataFrame) -> DataFrame:
    """One row: proposals in all, those that may be applied, and those for review."""
    return found.agg(F.count("*").alias("flagged"), F.count_if(~F.col("blocked")).alias("applicable"), F.count_if("blocked").alias("for_review"))
