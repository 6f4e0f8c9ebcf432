"""Which tracks an export takes: their genres in a controlled set, their files where they are now, and why others stay out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.functions import parsing, scoring, text

#: Names of each genre of the controlled set.
ALIASES = {
    "Acapella": ("acapella", "a cappella", "accapella", "a capella"),
    "Afro House": ("afro house", "afrohouse", "afro deep house", "deep afro house", "afro house amapiano", "amapiano afro house", "afrohouse amapiano", "tribal house", "afro tribal house"),
    "Afro Tech": ("afro tech", "afrotech", "afro tech house"),
    "Amapiano": ("amapiano", "ama piano"),
    "Deep House": ("deep house", "deephouse", "uk deep house", "deep soulful house"),
    "Tech House": ("tech house", "techhouse", "minimal tech house"),
    "Melodic House": ("melodic house", "melodic house techno", "melodic techno"),
    "Organic House": ("organic house",),
    "Soulful House": ("soulful house", "latin house", "gospel house"),
    "Funky House": ("funky house", "jackin house", "jackin' house"),
    "Garage House": ("garage house", "uk garage"),
    "Progressive House": ("progressive house", "prog house"),
    "Nu Disco": ("nu disco", "nu-disco", "afro disco"),
    "Disco": ("disco", "classic disco"),
    "Techno": ("techno", "hard techno", "industrial techno", "peak time techno", "afro techno"),
    "Dance": ("dance", "edm", "pop dance", "electronic dance music"),
    "R&B": ("r&b", "rnb", "r 'n' b", "rhythm and blues", "contemporary r&b"),
    "Hip Hop": ("hip hop", "hip-hop", "rap", "trap"),
}
#: Phrases that tell a genre, the first that a name holds decides.
PHRASES = (
    ("progressive house", "Progressive House"), ("afro deep house", "Afro House"), ("deep afro house", "Afro House"), ("afro tech house", "Afro Tech"), ("afro tech", "Afro Tech"),
    ("afro house", "Afro House"), ("melodic house", "Melodic House"), ("melodic techno", "Melodic House"), ("organic house", "Organic House"), ("soulful house", "Soulful House"),
    ("funky house", "Funky House"), ("garage house", "Garage House"), ("deep house", "Deep House"), ("tech house", "Tech House"), ("nu disco", "Nu Disco"), ("nu-disco", "Nu Disco"),
    ("afro disco", "Nu Disco"), ("amapiano", "Amapiano"), ("hip hop", "Hip Hop"), ("hip-hop", "Hip Hop"), ("r&b", "R&B"), ("techno", "Techno"), ("disco", "Disco"), ("dance", "Dance"), ("house", "Deep House"),
)
#: Words that don't change a genre.
MODIFIERS = (
    "classic", "classics", "gospel", "reprise", "trendy", "underground", "old", "school", "oldskool", "modern", "vintage", "collection", "selection", "sessions", "special", "edition",
    "revisited", "reissue", "presents", "feat", "featuring", "volume", "vol",
)
SLOWEST, FASTEST, UNMAPPED = 50.0, 220.0, "Other"


@dataclass(frozen=True)
class Genres:
    """A controlled set: (name, genre) pairs, ordered (phrase, genre) pairs, and words to leave out."""

    aliases: tuple[tuple[str, str], ...] = tuple((name, genre) for genre, names in ALIASES.items() for name in names)
    phrases: tuple[tuple[str, str], ...] = PHRASES
    modifiers: tuple[str, ...] = MODIFIERS


def canonical_genre(genre: Column, known: Genres = Genres()) -> Column:
    """A genre of the controlled set: by name, by name without modifiers, by the first phrase held, else Other; '' for junk or none."""
    names = F.create_map(*[F.lit(x) for pair in known.aliases for x in pair])
    phrases = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(g).alias("genre")) for p, g in known.phrases])

    def held(name: Column) -> Column:
        return F.get(F.filter(phrases, lambda p: F.contains(name, p["phrase"])), F.lit(0))["genre"]

    def forms(base: Column) -> Column:
        kept = lambda key: F.array_join(F.filter(F.split(key, " "), lambda w: ~w.isin(*known.modifiers)), " ")
        return parsing.bound(F.lower(base), lambda key: F.struct(base.alias("base"), key.alias("key"), F.coalesce(F.nullif(kept(key), F.lit("")), key).alias("plain")))

    def decided(x: Column) -> Column:
        found = F.coalesce(names[x["key"]], names[x["plain"]], held(x["plain"]), held(x["key"]), F.lit(UNMAPPED))
        return F.when((x["base"] == "") | text.is_junk_genre(x["base"]), "").otherwise(found)

    return parsing.bound(parsing.bound(text.genre_name(genre), forms), decided)


def located(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """tracks with place (the path where the file is now; null if nowhere) and found: ok, recovered by file name, unresolved.

    files (filepath) are those that exist. Of several files of one name, in any case, the smallest path is taken.
    """
    there = files.select(F.col("filepath").alias("__there")).distinct()
    named = files.groupBy(F.lower(text.file_name(F.col("filepath"))).alias("__name")).agg(F.min("filepath").alias("__named"))
    rows = tracks.join(there, F.col("filepath") == F.col("__there"), "left")
    rows = rows.join(named, F.when(F.col("__there").isNull(), F.lower(text.file_name(F.col("filepath")))) == F.col("__name"), "left")
    found = F.when(F.col("__there").isNotNull(), "ok").when(F.col("__named").isNotNull(), "recovered").otherwise("unresolved")
    return rows.withColumns({"found": found, "place": F.coalesce("__there", "__named")}).drop("__there", "__name", "__named")


def resolved(tracks: DataFrame, files: DataFrame, known: Genres = Genres()) -> DataFrame:
    """(id, filepath, found, artist, title, genre, reasons) of every track; those without reasons are exported.

    Artist and title fall back to a file name `Artist - Title`; a missing or unknown artist, a missing title, a tempo
    out of range, a bad key and a junk genre keep a track out. A placeholder's name and a file that is nowhere are the
    only reason then. Every reason has its kind in front: what an analysis could mend is named so as a whole.
    """
    artist, title = F.trim(F.coalesce("artist", F.lit(""))), F.trim(F.coalesce("title", F.lit("")))
    rows = located(tracks.withColumns({"__artist": artist, "__title": title, "__junk": parsing.is_placeholder(F.col("filepath"))}), files)
    parts = F.split(text.stem(F.coalesce("place", "filepath")), r"\s+-\s+", 2)
    sides = F.struct(F.trim(F.get(parts, F.lit(0))).alias("artist"), F.trim(F.get(parts, F.lit(1))).alias("title"))
    rows = rows.withColumn("__sides", F.when(F.size(parts) == 2, sides))
    usable = F.coalesce((F.col("__sides.artist") != "") & (F.col("__sides.title") != ""), F.lit(False))
    rows = rows.withColumns({
        "__artist": F.when(text.is_unknown_artist(F.col("__artist")) & usable, F.col("__sides.artist")).otherwise(F.col("__artist")),
        "__title": F.when((F.col("__title") == "") & usable, F.col("__sides.title")).otherwise(F.col("__title")),
        "__genre": canonical_genre(F.col("genre"), known), "__key": F.trim(F.coalesce("key_camelot", F.lit(""))),
    })
    no_tempo, bad_key = F.coalesce("bpm", F.lit(0.0)) == 0, scoring.wheel_number(F.col("__key")).isNull()
    issues = [
        (F.col("__title") == "", F.lit("missing title (filename fallback failed)"), "MISSING_METADATA"),
        (text.is_unknown_artist(F.col("__artist")), F.concat(F.lit("missing/unknown artist: '"), F.col("__artist"), F.lit("' (filename fallback failed)")), "MISSING_METADATA"),
        (no_tempo, F.lit("missing BPM"), "MISSING_ANALYSIS"),
        (~no_tempo & ~F.col("bpm").between(SLOWEST, FASTEST), F.format_string("BPM out of range: %.1f", F.col("bpm").cast("double")), "BAD_PATH"),
        (bad_key, F.concat(F.lit("missing/invalid Camelot key: '"), F.col("__key"), F.lit("'")), "MISSING_ANALYSIS"),
        (F.col("__genre") == "", F.concat(F.lit("junk/missing genre: '"), F.coalesce("genre", F.lit("")), F.lit("'")), "MISSING_METADATA"),
    ]
    unanalysed = no_tempo | bad_key
    listed = F.array_compact(F.array(*[F.when(test, F.concat(F.when(unanalysed, "[MISSING_ANALYSIS] ").otherwise(f"[{kind}] "), said)) for test, said, kind in issues]))
    alone = F.when(F.col("__junk"), F.array(F.lit("[JUNK_PLACEHOLDER] filename matches known junk pattern"))).when(F.col("found") == "unresolved", F.array(F.lit("[STALE_DB] file not found")))
    return rows.select(
        "id", F.coalesce("place", "filepath").alias("filepath"), F.when(F.col("__junk"), "junk").otherwise(F.col("found")).alias("found"), F.col("__artist").alias("artist"), F.col("__title").alias("title"),
        F.col("__genre").alias("genre"), F.coalesce(alone, listed).alias("reasons"),
    )


def export_counts(rows: DataFrame) -> DataFrame:
    """One row over `resolved` tracks: valid, recovered, stale_db, junk and needs_analysis."""
    out = F.size("reasons") > 0
    return rows.agg(
        F.count_if(~out).alias("valid"), F.count_if(~out & (F.col("found") == "recovered")).alias("recovered"), F.count_if(F.col("found") == "unresolved").alias("stale_db"),
        F.count_if(F.col("found") == "junk").alias("junk"), F.count_if(F.coalesce(F.get("reasons", F.lit(0)).startswith("[MISSING_ANALYSIS]"), F.lit(False))).alias("needs_analysis"),
    )
