"""Record labels of tracks: the best field that names one, why others don't, and one spelling for each label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.functions import parsing, text

#: Values that mean no label, genres that stand in for one, and words that a label's name may end in.
NO_LABELS = ("", "unknown", "n/a", "na", "none", "null", "test", "promo", "various", "various artists", "va", "-", "--", "?", "??", "tbc", "tba", "untitled")
GENRES = (
    "house", "techno", "deep house", "tech house", "afro house", "drum and bass", "dnb", "jungle", "garage", "uk garage", "trance", "progressive", "melodic house", "organic house",
    "amapiano", "afrobeats", "electronic", "dance", "edm",
)
ENDINGS = (
    "records", "recordings", "record", "recording", "music", "audio", "sounds", "sound", "label", "labels", "group", "trax", "digital", "worldwide", "international", "collective", "entertainment",
)
#: Codes and signs that are no name, and words that show a label.
NO_NAMES = r"(?i)^(?:[^a-z0-9]{1,3}|[a-z]{2,6}[-_]?\d{3,7}|[a-z]\d+|0+)$"
SHOWN = r"(?i)\b(?:records?|recordings?|music|audio|label|trax|sounds?|group|collective|entertainment|publishing|digital)\b"
#: Fixed values: (field, source, confidence, what was done, whether the value has to show a label), in order of preference.
FIELDS = (
    ("organization", "embedded_tag", 0.95, "kept", False),
    ("grouping", "fallback_tag", 0.75, "filled", False),
    ("comment", "fallback_tag", 0.60, "filled", False),
    ("albumartist", "fallback_tag", 0.50, "filled", True),
    ("album", "fallback_tag", 0.45, "filled", True),
)
LABEL_END = r"(?:records?|recordings?|music|audio|label|trax|sounds?)"
#: Fixed values: (pattern of a file's name whose group is the label, confidence), in order; and the least confidence to write.
NAMED = (
    (r"^\[([^\[\]]{2,50})\]\s+.{5,}", 0.70),
    (r"^\(([^()]{2,50})\)\s+.{5,}", 0.70),
    (rf"(?i)^.{{5,}}\s+\(([^()]{{2,50}}{LABEL_END})\)\s*$", 0.65),
    (r"^([A-Za-z][A-Za-z0-9 &'.\-]{1,49})__\S", 0.60),
    (rf"(?i)^.{{5,}}\s+\[([^\[\]]{{2,50}}{LABEL_END})\]\s*$", 0.60),
)
WRITABLE = 0.85


def junk_reason(value: Column, config: parsing.Advertising = parsing.DEFAULT) -> Column:
    """Why a value is no label's name; null if it may be one."""
    ends = "|".join(config.domain_ends)
    bare = lambda raw: F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"^[\[\]()\s]+|[\[\]()\s]+$", ""), r"[\s\-|_]{2,}", " "), r"^\s+|\s+$", "")

    def judged(x: Column) -> Column:
        raw, low, name = x["raw"], F.lower(x["raw"]), F.lower(x["name"])
        source = F.get(F.filter(F.array(*map(F.lit, config.source_parts)), lambda s: F.contains(low, s)), F.lit(0))
        return (
            F.when(raw == "", "empty")
            .when(raw.rlike(r"(?i)^(?:1[0-2]|[1-9])[AB]\s*[-|_]*\s*$"), "Camelot/musical key")
            .when(low.rlike(r"https?://|www\."), "URL or domain prefix")
            .when(low.rlike(rf"\.(?:{ends})(?:\s|/|$)"), "domain name")
            .when(source.isNotNull(), F.concat(F.lit("source junk ('"), source, F.lit("')")))
            .when(name == "", "empty after normalization")
            .when(F.length(name) == 1, "single character")
            .when(name.isin(*NO_LABELS), "exact junk value")
            .when(name.isin(*GENRES), "genre word")
            .when(name.rlike(NO_NAMES), "junk pattern")
        )

    raw = F.trim(F.coalesce(value, F.lit("")))
    forms = parsing.bound(raw, lambda r: F.struct(r.alias("raw"), F.trim(F.regexp_replace(bare(r), r"^[.\-_|,;:!?]+|[.\-_|,;:!?]+$", "")).alias("name")))
    return parsing.bound(forms, judged)


def label_key(label: Column) -> Column:
    """The form in which spellings of one label agree: lower-case words without signs and without what labels end in."""
    words = text.squeezed(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[‘’'´`\-_.,!?&]", " "))
    return F.regexp_replace(words, rf"(?:(?:^|\s)(?:{'|'.join(ENDINGS)}))+$", "")


def named_in_file(stem: Column) -> Column:
    """struct<label, confidence> of the first pattern of a file's name that holds a label; null if none does."""

    def tried(s: Column) -> Column:
        found = F.array(*[F.struct(F.trim(F.regexp_extract(s, p, 1)).alias("label"), F.lit(c).alias("confidence")) for p, c in NAMED])
        return F.get(F.filter(found, lambda f: F.length(f["label"]).between(2, 60) & f["label"].rlike("[A-Za-z]")), F.lit(0))

    return parsing.bound(F.trim(stem), tried)


def detected(tracks: DataFrame) -> DataFrame:
    """(id, label, key, source, confidence, action, junk_count, writable) of tracks with a column for each of FIELDS and a filepath.

    The first field that holds a name, of albums and their artists one that shows a label, decides, then the file's
    name; junk_count tells how many values before it were junk. Without any the source is unresolved, its label null.
    """
    in_file = named_in_file(text.stem(F.col("filepath")))
    tried = [F.struct(F.trim(F.coalesce(f, F.lit(""))).alias("value"), F.lit(s).alias("source"), F.lit(c).alias("confidence"), F.lit(a).alias("action"), F.lit(n).alias("shown")) for f, s, c, a, n in FIELDS]
    tried.append(parsing.bound(in_file, lambda x: F.struct(F.coalesce(x["label"], F.lit("")).alias("value"), F.lit("filename").alias("source"), F.coalesce(x["confidence"], F.lit(0.0)).alias("confidence"), F.lit("filled").alias("action"), F.lit(False).alias("shown"))))
    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit("unresolved").alias("source"), F.lit(0.0).alias("confidence"), F.lit("unresolved").alias("action"), F.lit(False).alias("shown"))

    def judged(c: Column) -> Column:
        why = F.when(c["value"] != "", junk_reason(c["value"]))
        return parsing.bound(why, lambda w: F.struct(w.isNotNull().alias("junk"), ((c["value"] != "") & w.isNull() & (~c["shown"] | c["value"].rlike(SHOWN))).alias("good")))

    def answer(so_far: Column, c: Column) -> Column:
        """What is known after one more value; after a good one no other is judged."""
        step = parsing.bound(judged(c), lambda x: F.struct(F.when(x["good"], c).otherwise(so_far["c"]).alias("c"), (so_far["junk_count"] + x["junk"].cast("int")).alias("junk_count"), x["good"].alias("done")))
        return F.when(so_far["done"], so_far).otherwise(step)

    start = F.struct(none.alias("c"), F.lit(0).alias("junk_count"), F.lit(False).alias("done"))
    rows = tracks.select("id", F.aggregate(F.array(*tried), start, answer).alias("x"))
    named = F.struct(F.col("x.c.value").alias("label"), label_key(F.col("x.c.value")).alias("key"), "x.c.source", "x.c.confidence", "x.c.action", "x.junk_count")
    rows = rows.select("id", F.inline(F.array(named)))  # as generated rows, so that no filter by a result runs the rules again
    return rows.withColumn("writable", F.col("label").isNotNull() & (F.col("confidence") >= WRITABLE))


def spelled(found: DataFrame, *keys: Column) -> DataFrame:
    """(key, keys, canonical, n_spellings, n): of each key's labels one that isn't all capitals, then the longest, then that of the smallest id; n counts rows."""
    each = found.groupBy("key", "label").agg(F.min("id").alias("first"), F.count("label").alias("n")).where("n > 0")
    shouted = (F.upper("label") == F.col("label")) & F.col("label").rlike(r"\p{Lu}")
    return each.groupBy("key", *keys).agg(F.max_by("label", F.struct(~shouted, F.length("label"), -F.col("first"))).alias("canonical"), F.count("*").alias("n_spellings"), F.sum("n").alias("n"))


def spellings(found: DataFrame) -> DataFrame:
    """(key, canonical, n_spellings): the spelling of each label that the whole corpus prefers."""
    return spelled(found).where("key <> ''").drop("n")


def with_canonical(found: DataFrame) -> DataFrame:
    """Detected labels with canonical, the spelling that the whole corpus prefers; a label of ending words only keeps its own."""
    return found.join(spellings(found).drop("n_spellings"), "key", "left").withColumn("canonical", F.coalesce("canonical", "label"))


def label_summary(found: DataFrame) -> DataFrame:
    """One row: tracks, embedded, filled, unresolved, junk values, tracks with junk, and those that may be written."""
    return found.agg(
        F.count("*").alias("total"), F.count_if(F.col("source") == "embedded_tag").alias("embedded"), F.count_if(F.col("source").isin("fallback_tag", "filename")).alias("filled"),
        F.count_if(F.col("source") == "unresolved").alias("unresolved"), F.coalesce(F.sum("junk_count"), F.lit(0)).alias("junk_values"), F.count_if(F.col("junk_count") > 0).alias("junk_tracks"), F.count_if("writable").alias("writable"),
    )


def top_labels(found: DataFrame, k: int = 15) -> DataFrame:
    """(canonical, n) of the k labels of the most tracks; ties by name. found, as `detected` gives it, is read once."""
    alone = F.when(F.col("key") == "", F.col("label")).alias("__alone")  # labels of ending words only keep their own spelling
    return spelled(found, alone).select("canonical", "n").orderBy(F.desc("n"), "canonical").limit(k)
