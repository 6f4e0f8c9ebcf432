"""Artist credits as Column expressions: spelling, parts, guests, and two names without a separator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.functions import parsing, text

#: Signs that are written as others, capital words that stay, and brackets that name a version.
WRITTEN = ("–—―‒−‘’‹›“”", "-----''''\"\"")
CAPITAL_WORDS = ("DJ", "MC", "NY", "UK", "US", "EP", "LP", "B2B")
VERSIONS = ("Original Mix", "Extended Mix", "Radio Edit", "Dub Mix", "Instrumental", "Remix", "Rework", "VIP Mix", "Club Mix", "Short Mix", "Intro Mix", "Outro Mix", "Edit", "Re-Edit")
#: A single word in capitals of so many letters may be an acronym; confidences of splits.
LONGEST_ACRONYM, X_PENALTY, AND_PENALTY, LEAST_OF_SEVERAL, PERSONS = 6, 0.05, 0.10, 0.70, 0.90
#: Words that are no part of a person's name.
NO_NAMES = (
    "presents", "featuring", "feat", "ft", "the", "a", "an", "and", "or", "vs", "with", "from", "prod", "production", "productions", "remix", "remixed", "original", "radio", "extended", "edit", "mix",
)
GUEST = "feat(?:uring)?|ft"


def cased(name: Column) -> Column:
    """A name all in capitals with each word capitalised, but for acronyms, initials and a country in brackets at the end."""
    parts = F.struct(F.trim(F.regexp_replace(name, r"\s*\([A-Z]{2,4}\)\s*$", "")).alias("body"), F.regexp_extract(name, r"(\([A-Z]{2,4}\))\s*$", 1).alias("country"))

    def word(w: Column) -> Column:
        kept = ~w.rlike("[A-Za-z]") | w.isin(*CAPITAL_WORDS) | w.rlike(r"^[A-Z](?:\.[A-Z])+\.?$") | (F.upper(w) != w)
        return F.when(kept, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))

    def whole(p: Column) -> Column:
        words, letters = F.split(p["body"], r"\s+"), F.length(F.regexp_replace(p["body"], "[^A-Za-z]", ""))
        short = (F.size(words) == 1) & (letters <= LONGEST_ACRONYM)
        one = F.concat(F.upper(F.substring(p["body"], 1, 1)), F.lower(F.substring(p["body"], 2, 1_000_000)))
        spelt = F.when(F.size(words) == 1, one).otherwise(F.array_join(F.transform(words, word), " "))
        return F.when(short | (p["body"] == ""), name).otherwise(F.trim(F.concat_ws(" ", spelt, p["country"])))

    shouted = ~name.rlike("[a-z]") & name.rlike("[A-Z][^A-Z]*[A-Z]")
    return F.when(shouted, F.element_at(F.transform(F.array(parts), whole), 1)).otherwise(name)


def spelt(name: Column) -> Column:
    """One spelling of dashes, quotes and guest marks, without a tempo or a version's bracket, single spaces."""
    rules = [
        (rf"(?iU)(?:\b(?:{GUEST})\b\.*\s*)+", "feat. "),
        (r"(?iU)\s*@?\s*\b\d+\s*bpm\b\s*", " "),
        (rf"(?i)\s*[\[(](?:{'|'.join(VERSIONS)})[^\])]*[\])]", ""),
    ]
    return text.squeezed(text.folded(F.translate(name, *WRITTEN), *rules))


def normalised(name: Column) -> Column:
    """A name in its usual spelling; null stays null. Letters and marks should be `text.composed` before."""
    return F.element_at(F.transform(F.transform(F.array(name), spelt), cased), 1)


def with_parts(rows: DataFrame, artist: str = "artist", title: str = "title", name: str = "parsed") -> DataFrame:
    """rows with a struct `name` of an artist credit: parts and main (normalised parts), guest, separator, confidence.

    A guest at the end is taken out unless the title names one in brackets. Commas part first and & within them, then
    &, x, vs; `and` only where all its sides are valid names. Each step is bound to a column of its own. Null and blank
    credits have no parts and confidence 0; a credit is parsed whole, however long; repeated rows are parsed alike.
    """
    given = F.trim(F.coalesce(F.col(artist), F.lit("")))
    in_title = F.coalesce(F.col(title).rlike(r"(?i)\(feat"), F.lit(False))
    guest = F.trim(F.regexp_replace(F.regexp_extract("__given", rf"(?iU)\s(?:{GUEST})\.?\s+(.+)$", 1), rf"(?iU)^(?:{GUEST})\.?\s+", ""))
    rows = rows.withColumn("__given", given)
    rows = rows.withColumn("__guest", F.when(~in_title, guest).otherwise(""))
    rows = rows.withColumn("__main", F.when(F.col("__guest") != "", F.trim(F.regexp_replace("__given", rf"(?iU)\s+(?:{GUEST})\.?\s+.+$", ""))).otherwise(F.col("__given")))
    main, present = F.col("__main"), lambda parts: F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    signs = {"ampersand": r"(?U)\s+&\s+", "x": r"(?iU)\s+x\s+", "vs": r"(?iU)\s+vs\.?\s+", "and": r"(?iU)\s+and\s+"}
    sign = F.when(main.contains(","), "comma")
    for label in ("ampersand", "x", "vs", "and"):
        sign = sign.when(main.rlike(signs[label]), label)
    rows = rows.withColumn("__sign", sign.otherwise("none"))
    by_comma = F.flatten(F.transform(present(F.split(main, r"(?U)\s*,\s*")), lambda p: present(F.split(p, signs["ampersand"]))))
    parts = F.when(F.col("__sign") == "comma", by_comma)
    for label, pattern in signs.items():
        parts = parts.when(F.col("__sign") == label, present(F.split(main, pattern)))
    rows = rows.withColumn("__parts", parts.otherwise(F.when(main == "", F.array().cast("array<string>")).otherwise(F.array(main))))
    unsure = (F.col("__sign") == "and") & ~(F.forall("__parts", lambda p: parsing.is_valid_artist(p)) & (F.size("__parts") > 1))
    rows = rows.withColumn("__parts", F.when(unsure, F.array(main)).otherwise(F.col("__parts")))
    nested = (F.col("__sign") == "comma") & F.exists(F.split(main, r"(?U)\s*,\s*"), lambda p: F.trim(p).rlike(signs["ampersand"]))
    label = F.when(unsure, "none").when(nested, "nested").otherwise(F.col("__sign"))
    several = F.size("__parts") > 1
    points = F.when(several & (label == "x"), 1 - X_PENALTY).when(several & (label == "and"), 1 - AND_PENALTY).otherwise(1.0)
    confidence = F.when(F.col("__given") == "", 0.0).otherwise(F.greatest(F.lit(LEAST_OF_SEVERAL), points))
    main_names = F.transform(F.transform("__parts", spelt), cased)
    found = F.struct(F.col("__parts").alias("parts"), main_names.alias("main"), F.col("__guest").alias("guest"), label.alias("separator"), confidence.alias("confidence"))
    return rows.withColumn(name, found).drop("__given", "__guest", "__main", "__sign", "__parts")


#: A person's two or three words with an initial between them, or one word that is no short acronym.
_NAME, _ONE = "[A-Z][a-z]{1,11}", r"(?:[A-Z][A-Za-z]*[a-z][A-Za-z]*\.?|[A-Z]{5,}\.?|[A-Z]{4}\.)"
PERSON = rf"^(?:{_NAME} (?:[A-Z]\.? )?{_NAME}|{_ONE})$"


def persons(name: Column) -> Column:
    """struct<left, right, confidence> of two persons' names without a separator, by the first place that parts them; null if none does.

    Names of four to six words are tried, as a person has three at most.
    """

    def tried(words: Column) -> Column:
        def side(k: Column, left: bool) -> Column:
            return F.array_join(F.slice(words, 1, k) if left else F.slice(words, k + 1, F.size(words) - k), " ")

        plain = (F.size(words) >= 4) & (F.size(words) <= 6) & ~F.exists(words, lambda w: F.lower(w).isin(*NO_NAMES))
        places = F.filter(F.sequence(F.lit(1), F.lit(5)), lambda k: (k < F.size(words)) & side(k, True).rlike(PERSON) & side(k, False).rlike(PERSON))
        first = F.get(F.when(plain, places), F.lit(0))
        return F.when(first.isNotNull(), F.struct(side(first, True).alias("left"), side(first, False).alias("right"), F.lit(PERSONS).alias("confidence")))

    return F.element_at(F.transform(F.array(F.split(F.trim(F.coalesce(name, F.lit(""))), r"(?U)\s+")), tried), 1)
