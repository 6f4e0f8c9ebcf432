"""Text rules of the catalogue as Column expressions (Java regular expressions)."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Names that say no artist is known.
UNKNOWN_ARTISTS = ["", "unknown", "unknown artist", "va", "various artists", "various", "n/a", "none", "-", "--"]
#: Words that make a bracket or a last part a version.
VERSION_WORDS = [
    "remix", "remixed", "edit", "edited", "extended", "mix", "version", "vip", "dub", "instrumental", "acapella", "a cappella", "radio", "club", "original",
    "reprise", "rework", "bootleg", "mashup", "flip", "remaster", "remastered", "live", "acoustic", "unplugged", "stripped", "demo", "session", "intro", "outro", "short",
]
#: Name tokens that say little about which recording a file is.
WEAK_TOKENS = ["remix", "mix", "original", "feat", "ft", "featuring", "extended"]
#: Genre fields that name a source or nothing.
JUNK_GENRES = ["beatport", "other", "unknown", "none", "n/a", "genre", "traxsource", "juno"]


def folded(value: Column, *rules: tuple[str, str]) -> Column:
    """regexp_replace by each (pattern, replacement) in turn."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, value)


def squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


@F.pandas_udf(StringType())
def composed(values: pd.Series) -> pd.Series:
    """Texts with each letter and its marks as one character where there is one (NFC); nulls stay."""
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def is_unknown_artist(artist: Column) -> Column:
    return F.lower(F.trim(F.coalesce(artist, F.lit("")))).isin(UNKNOWN_ARTISTS)


def is_junk_genre(name: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return (F.length(text) <= 1) | text.isin(JUNK_GENRES) | text.rlike(r"^\d{1,2}[ab]$") | text.rlike(r"https?:|www\.|\.com")


def genre_name(genre: Column) -> Column:
    """The first of several genres, with spaces for hyphens and each word capitalised; empty for none."""
    first = F.split(F.trim(F.coalesce(genre, F.lit(""))), r"[,;/|]", 2)[0]
    return F.initcap(squeezed(F.regexp_replace(first, "[-_]+", " ")))


def primary_artist(artist: Column) -> Column:
    """Lower-case name before any credit of a guest or a second artist."""
    alone = F.regexp_replace(F.coalesce(artist, F.lit("")), r"(?iU)\s*[(\[]?\b(?:feat\.?|ft\.?|featuring)\s.*$", "")
    return F.lower(F.trim(F.split(alone, r"(?iU)\s*(?:,|&|\bvs\.?\b|\bx\b|\bwith\b)\s*", 2)[0]))


def version_parts(title: Column) -> tuple[Column, Column]:
    """(base title, version): the last bracket if it ends the title, else what follows the first dash, if it holds a version word.

    Both are found by the place of their sign, so a title is scanned from its ends only.
    """
    words, whole = "|".join(VERSION_WORDS), F.rtrim(title)
    opened = F.length(whole) - F.least(*[F.when(F.instr(F.reverse(whole), sign) == 0, F.length(whole) + 1).otherwise(F.instr(F.reverse(whole), sign)) for sign in "(["]) + 1
    in_bracket = F.when(whole.rlike(r"[)\]]$") & (opened > 0), F.trim(whole.substr(opened + 1, F.length(whole) - opened - 1)))
    dash = F.least(*[F.when(F.instr(title, sign) == 0, F.length(title) + 1).otherwise(F.instr(title, sign)) for sign in "-–"])
    after_dash = F.when(dash <= F.length(title), F.trim(title.substr(dash + 1, F.length(title))))
    has_bracket, has_dash = (F.coalesce(F.lower(part).rlike(words), F.lit(False)) for part in (in_bracket, after_dash))
    base = F.when(has_bracket, F.trim(whole.substr(F.lit(1), opened - 1))).when(has_dash, F.trim(title.substr(F.lit(1), dash - 1))).otherwise(title)
    return base, F.when(has_bracket, in_bracket).when(has_dash, after_dash).otherwise("")


def compare_name(value: Column) -> Column:
    return squeezed(F.lower(F.coalesce(value, F.lit(""))))


#: Ends of a name that say nothing about it: copy numbers, and a key and a tempo in either order.
AUDIT_ENDS = [(r"\s*\(\d+\)\s*$", ""), (r"\s*-\s*[0-9]{1,2}[ab]\s*-\s*\d{2,3}\s*$", ""), (r"\s*-\s*\d{2,3}\s*-\s*[0-9]{1,2}[ab]\s*$", "")]


def audit_name(path: Column) -> Column:
    """A file's name for comparison: without copy numbers and key or tempo suffixes, letters and digits only."""
    return F.trim(folded(F.lower(stem(path)), *AUDIT_ENDS, (r"[^a-z0-9]+", " ")))


def audit_words(name: Column) -> Column:
    """The words of `audit_name`, of a name without an extension."""
    return F.regexp_extract_all(folded(F.lower(name), *AUDIT_ENDS), F.lit("[a-z0-9]+"), F.lit(0))


def audit_tokens(path: Column) -> Column:
    return F.filter(F.array_distinct(F.split(audit_name(path), " ")), lambda t: (F.length(t) > 1) & ~t.isin(WEAK_TOKENS))


def token_overlap(old: Column, new: Column) -> Column:
    """The share of old's tokens that new has too; 0 if old has none."""
    a, b = audit_tokens(old), audit_tokens(new)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def same_separators(value: Column) -> Column:
    """Any dash as -, a pipe as a spaced dash, single spaces."""
    return squeezed(F.regexp_replace(F.regexp_replace(value, r"[‐‑–—−]", "-"), r"\s*\|\s*", " - "))


def artist_and_title(name: Column) -> tuple[Column, Column]:
    """Split at the first spaced dash; without one all is title."""
    split = name.contains(" - ")
    return F.when(split, F.trim(F.substring_index(name, " - ", 1))).otherwise(""), F.when(split, F.trim(F.split(name, " - ", 2)[1])).otherwise(F.trim(name))


def label_key(label: Column) -> Column:
    """A record label's name for comparison, without words that all labels have."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin("records", "recordings", "record", "music", "label", "ltd", "inc", "llc")), " ")


def index_letter(artist: Column) -> Column:
    first = F.upper(F.substring(F.regexp_replace(F.trim(F.coalesce(artist, F.lit(""))), r"(?i)^(?:the|a|an)\s+", ""), 1, 1))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("#")


def safe_name(value: Column) -> Column:
    return F.regexp_replace(squeezed(F.regexp_replace(value, r'[<>:"/\\|?*\x00-\x1f]', "_")), r"[. ]+$", "")


def windows_location(path: Column, root: str, drive: str) -> Column:
    """A path below root as a file URL on a drive, each part percent-encoded."""
    parts = F.split(F.substring(path, len(root) + 2, 1_000_000), "/")
    encoded = F.transform(parts, lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.concat(F.lit(f"file://localhost/{drive}:/"), F.array_join(encoded, "/"))


def minutes_seconds(sec: Column) -> Column:
    return F.format_string("%d:%04.1f", F.floor(sec / 60), sec % 60)


def issues(t: dict[str, Column]) -> Column:
    """Flags of a track, in fixed order; t has bpm, key, artist, title, status, parse_confidence."""

    def empty(c: Column) -> Column:
        return F.trim(F.coalesce(c, F.lit(""))) == ""

    flags = [
        (t["bpm"].isNull(), "missing_bpm"),
        (t["key"].isNull(), "missing_key"),
        (empty(t["artist"]), "missing_artist"),
        (empty(t["title"]), "missing_title"),
        (t["status"] == "error", "error"),
        (t["status"] == "needs_review", "needs_review"),
        (F.upper(t["parse_confidence"]).isin("MEDIUM", "LOW"), "weak_filename_parse"),
        (is_unknown_artist(t["artist"]) & ~empty(t["artist"]), "suspicious_artist"),
        (F.lower(t["title"]).rlike(r"https?:|www\.|\.(?:com|net|org)\b"), "suspicious_title"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in flags]))
