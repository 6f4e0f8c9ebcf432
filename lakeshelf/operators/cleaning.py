"""Cleaning of tag fields by ordered rules, and what they propose.

A rule is data: where its pattern matches, it replaces, names its reason and lowers the confidence. A chain folds a
column through its rules once; the steps that changed something tell all reasons, flags, and the least confidence. Fields lie side by side in a row, so cleaning
and collecting a row's changes needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.functions import parsing

LEVELS = ("LOW", "MEDIUM", "HIGH")


@dataclass(frozen=True)
class Rule:
    """Replaces each pattern by `new` in turn. trims: white space at the ends goes too; keeps: a value never becomes empty."""

    reason: str
    patterns: tuple[str, ...]
    new: str = ""
    flag: str = ""
    confidence: str = "HIGH"
    trims: bool = False
    keeps: bool = False


def any_of(words: tuple[str, ...]) -> str:
    """A pattern of any of the words between characters that are no ASCII letters."""
    return rf"(?<![A-Za-z])(?:{'|'.join(words)})(?![A-Za-z])"


#: Words after which a number is part of a title, words that keep or remove a bracket at its end, bad labels.
COUNTED = ("you", "me", "us", "them", "minutes", "hours", "days", "seconds", "years", "love", "life", "one", "two")
VERSION_BRACKET = (
    "mix", "edit", "version", "remix", "dub", "vocal", "club", "rework", "reprise", "instrumental", "radio", "extended", "original", "short", "vip", "acapella", "acoustic", "live", "bootleg",
    "reconstruction", "refix", "remaster", "remastered", "retro", "intro", "outro", "cut", "flip", "mashup", "blend", "snippet", "preview", "interlude",
)
LABEL_BRACKET = ("records", "recordings", "music", "entertainment", "digital", "audio", "sound", "sounds", "label", "labels", "group", "media", "distrokid", "publishing", "productions", "distribution")
LABELS = ("shockit", "techno and chill")
NO_LABELS = ("unknown", "n/a", "na", "none", "not available", "unavailable", "-", "–", "—", "?", "??", "???", "various", "various artists", "va", "promo", "white label", "white lbl")
PIRATES = r"\.com|\.net|\.org|blogspot|hulkshare|zippyshare|fordjonly|djonly|mp3(?:[\s.)]|$)"
EMAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
SOURCES = "fordjonly|djcity|zipdj|zippy|blogspot|soundcloud"

#: The rules of a title, an artist, a label and a code, in order. Lead numbers need a separator or a small number and a word.
TITLE = (
    Rule("title_prefix_removed", (r"(?U)^\*{0,5}\s*\d{1,3}\s*(?:[|.–—]|-{1,2})\s+",)),
    Rule("title_bare_number_stripped", (rf"(?U)^0{{0,2}}\d\s+(?=[A-Za-z(])(?!(?i:{'|'.join(COUNTED)})(?:\s|$))(?=\S.*\S)(.*?)\s*$",), "$1"),
    Rule("title_domain_token_stripped", (rf"(?i)\s*\([^)]*(?:{PIRATES})[^)]*\)",), trims=True),
    Rule("title_trailing_bpm_stripped", (r"(?U)\s*(?<=[\s)])(?:0?[89]\d|1[0-5]\d|160)\s*$",), keeps=True),
    Rule("title_label_suffix_stripped", (rf"(?U)\s*\((?![^)]*(?i:{any_of(VERSION_BRACKET)}))(?:(?=[^)]*(?i:{any_of(LABEL_BRACKET)}))[^)]*|\s*(?i:{'|'.join(LABELS)})\s*)\)\s*$",), keeps=True),
    Rule("title_feat_normalized", (r"\(Feat\.",), "(feat."),
    Rule("title_separator_fixed", (r"(?U)\s*[-–—]\s*(?:[-–—]\s*)+",), " - "),
    Rule("title_spacing_fixed", (r"(?U)[\[(]\s*[\])]",)),
    Rule("title_parentheses_fixed", (r"(?U)\s*\([^)]*$",)),
    Rule("title_spacing_fixed", (r"(?U)(\S)\(",), "$1 ("),
    Rule("title_spacing_fixed", (" {2,}",), " ", trims=True),
)
ARTIST = (
    Rule("artist_url_removed", (r"(?iU)\bhttps?://\S+|\bwww\.\S+|(?<!\w)[a-z0-9\-]{2,}\.(?:com|net|org)\b",), trims=True),
    Rule("artist_feat_normalized", (r"(?iU)\bft\.(?!\s*$)|\bfeaturing\b",), "feat."),
    Rule("artist_spacing_fixed", (r"(?U)(?:\s*[,/]\s*){2,}",), ", "),
    Rule("artist_spacing_fixed", (" {2,}",), " ", trims=True),
)
LABEL = (
    Rule("label_junk_email", (rf"(?s)^.*{EMAIL}.*$",)),
    Rule("label_junk_placeholder", (rf"(?iU)^\s*(?:{'|'.join(w.replace('?', '[?]') for w in NO_LABELS)})\s*$",)),
    Rule("label_spacing_fixed", (" {2,}",), " ", trims=True),
)
CODE = (Rule("invalid_isrc", (r"(?is)^(?!\s*(?:[- ]*[A-Z]){2}(?:[- ]*[A-Z0-9]){3}(?:[- ]*[0-9]){7}[- ]*\s*$).+$",)),)

#: The rules of a sanitation proposal, in order.
SANITATION = (
    Rule("whitespace corruption normalized", (r"(?U)\s+",), " ", trims=True),
    Rule("malformed separators normalized", (r"(?U)\s*(?:[-_/|]{2,}|[|])\s*",), " - "),
    Rule("source token removed", (rf"(?iU)\s*[(\[][^)\]]*(?:{SOURCES}|\.com)[^)\]]*[)\]]\s*", rf"(?iU)\b(?:{SOURCES})(?:\.com)?\b|(?:^|\s)[\w-]+\.com\b|\.com\b"), " ", "source_token_removed", "LOW"),
    Rule("ambiguous version cleanup", (r"(?iU)(?:\s+|(?<=[a-z]))AlbumVersion\s*$",), "", "ambiguous_version_cleanup", "LOW"),
    Rule("junk suffix removed", (r"(?iU)(?:\s+|(?<=[a-z]))(?:Macia)?Downloads\s*$",), "", "junk_suffix_removed"),
    Rule("duplicated word cleanup", (r"(?iU)\b([a-z][\w']{2,})\b(?:\s+\1\b){2,}",), "$1", "duplicated_word_cleanup", "MEDIUM"),
)
#: Which flag gives a proposal its reason, the first that it has.
WHY = (
    ("ambiguous_version_cleanup", "manual review required; ambiguous version cleanup"), ("source_token_removed", "source/piracy token removed"),
    ("duplicated_word_cleanup", "duplicated word cleanup"), ("junk_suffix_removed", "junk suffix removed safely"),
)


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def changed_by(rule: Rule, value: Column) -> Column:
    """A value that is not empty after one rule."""
    new = value
    for pattern in rule.patterns:
        new = F.regexp_replace(new, pattern, rule.new)
    if rule.keeps:
        new = F.regexp_replace(new, r"(?U)\s+$", "")
        return F.when(value.rlike(rule.patterns[0]), F.coalesce(F.nullif(new, F.lit("")), value)).otherwise(value)
    return F.when(value == "", value).otherwise(stripped(new) if rule.trims else new)


def chained(column: Column, rules: tuple[Rule, ...]) -> Column:
    """struct<value, reasons, flags, confidence> of a column after all rules; reasons and flags in order, each once.

    Every step stands once in the next, bound by a lambda, so a filter over the result doesn't multiply the chain. A
    null or empty value passes as an empty one, without reasons.
    """
    none, top = F.array().cast("array<string>"), len(LEVELS) - 1
    state = F.struct(F.coalesce(column, F.lit("")).alias("value"), none.alias("reasons"), none.alias("flags"), F.lit(top).alias("rank"))

    def step(state: Column, rule: Rule) -> Column:
        def told(before: Column, new: Column) -> Column:
            changed, rank = new != before["value"], LEVELS.index(rule.confidence)
            return F.struct(
                new.alias("value"),
                F.when(changed, F.array_append(before["reasons"], F.lit(rule.reason))).otherwise(before["reasons"]).alias("reasons"),
                (F.when(changed, F.array_append(before["flags"], F.lit(rule.flag))).otherwise(before["flags"]) if rule.flag else before["flags"]).alias("flags"),
                F.when(changed, F.least(before["rank"], F.lit(rank))).otherwise(before["rank"]).alias("rank"),
            )

        def applied(before: Column) -> Column:
            return F.element_at(F.transform(F.array(changed_by(rule, before["value"])), lambda new: told(before, new)), 1)

        return F.element_at(F.transform(F.array(state), applied), 1)

    for rule in rules:
        state = step(state, rule)
    last = lambda s: F.struct(s["value"].alias("value"), F.array_distinct(s["reasons"]).alias("reasons"), F.array_distinct(s["flags"]).alias("flags"), level(s["rank"]).alias("confidence"))
    return F.element_at(F.transform(F.array(state), last), 1)


def level(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), rank + 1)


def clean_album(column: Column, config: parsing.Advertising = parsing.DEFAULT) -> Column:
    """struct<value, reasons> of an album. The first fault decides: what is junk as a whole is emptied."""

    def judged(row: Column) -> Column:
        value, clean = row["value"], row["clean"]
        url, empty = value.rlike(r"(?i)https?://|www\."), clean == ""
        why = (
            F.when(value == "", None)
            .when(value.rlike(EMAIL), "album_junk_email")
            .when(url, F.when(empty, "album_junk_url").otherwise("album_url_stripped"))
            .when(value.rlike(r"^[/\\]|[A-Za-z]:[/\\]"), "album_junk_path_fragment")
            .when(value.rlike(r"\.{5,}"), "album_junk_excessive_dots")
            .when(clean == value, None)
            .when(empty, F.when(value.rlike(r"(?i)\b[a-z0-9\-]+\.[a-z]{2,4}\b"), "album_junk_domain").otherwise("album_junk_promo"))
            .otherwise("album_promo_stripped")
        )
        return F.struct(value.alias("value"), clean.alias("clean"), why.alias("why"))

    def answer(row: Column) -> Column:
        new = F.when(row["why"].isNull(), row["value"]).when(row["why"].startswith("album_junk"), "").otherwise(row["clean"])
        return F.struct(new.alias("value"), F.array_compact(F.array(row["why"])).alias("reasons"))

    given = F.transform(F.array(F.coalesce(column, F.lit(""))), lambda v: F.struct(v.alias("value"), parsing.sanitised(v, config).alias("clean")))
    return F.element_at(F.transform(F.transform(given, judged), answer), 1)


#: Fields in the order in which their changes are listed.
FIELDS = ("album", "isrc", "title", "artist", "organization")


def with_clean_fields(rows: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """rows with a struct clean_<field> of value and reasons for each field; columns: field to column, by default the same name."""
    columns = columns or {f: f for f in FIELDS}
    chains = {"isrc": CODE, "title": TITLE, "artist": ARTIST, "organization": LABEL}
    return rows.withColumns({"clean_album": clean_album(F.col(columns["album"])), **{f"clean_{f}": chained(F.col(columns[f]), rules) for f, rules in chains.items()}})


def tag_changes(tags: DataFrame, key: str) -> DataFrame:
    """(key, changes, skipped) for files that need either; tags has a key and an array of values for each of FIELDS.

    A change is (field, old, new, reason, reasons), its reason the first that applied; fields of several values are
    skipped and named. Null and empty arrays and values are left alone. One row of tags gives one row at most.
    """
    several = {f: F.coalesce(F.size(f) > 1, F.lit(False)) for f in FIELDS}
    rows = tags.select(key, *[F.when(~several[f], F.coalesce(F.get(f, F.lit(0)), F.lit(""))).otherwise("").alias(f) for f in FIELDS], *[several[f].alias(f"__{f}_many") for f in FIELDS])
    rows = with_clean_fields(rows)
    def change(field: str) -> Column:
        told = lambda c: F.struct(F.lit(field).alias("field"), F.col(field).alias("old"), c["value"].alias("new"), F.get(c["reasons"], F.lit(0)).alias("reason"), c["reasons"].alias("reasons"))
        return parsing.bound(F.col(f"clean_{field}"), lambda c: F.when(c["value"] != F.col(field), told(c)))

    changes = [change(f) for f in FIELDS]
    skipped = [F.when(F.col(f"__{f}_many"), F.lit(f"{f}: skipped_multi_value{'_artist' if f == 'artist' else ''}")) for f in FIELDS]
    out = rows.select(key, F.array_compact(F.array(*changes)).alias("changes"), F.array_compact(F.array(*skipped)).alias("skipped"))
    return out.where((F.size("changes") > 0) | (F.size("skipped") > 0))


def change_counts(changes: DataFrame) -> DataFrame:
    """(field, reason, n) over all files' changes."""
    return changes.select(F.explode("changes").alias("c")).groupBy("c.field", "c.reason").agg(F.count("*").alias("n"))


def field_state(current: Column, proposed: Column, status: Column | None = None, edited: Column | None = None) -> Column:
    """A field under review: its status (pending unless it is a known one), current, proposed and first proposed value, and whether it was edited."""
    known = ("pending", "approved", "rejected", "deferred", "applied", "no_op")
    status = F.lit("pending") if status is None else F.when(F.lower(status).isin(*known), F.lower(status)).otherwise("pending")
    edited = F.lit(False) if edited is None else F.coalesce(edited, F.lit(False))
    return F.struct(status.alias("status"), current.alias("current"), proposed.alias("proposed"), proposed.alias("original_proposed"), edited.alias("edited"))


def sanitation_proposals(tracks: DataFrame, key: str = "id") -> DataFrame:
    """(key, artist, title, fields, confidence, reason, flags, reasons): proposals for rows of which an artist or a title changes.

    artist and title are field states; the confidence is the least of both fields' rules, flags and reasons those of both
    in order. Null and blank values are left alone; a value that would become empty is not changed.
    """
    none, edges = F.array().cast("array<string>"), r"(?U)^[\s\-_/|.,]+|[\s\-_/|.,]+$"

    def judged(column: str) -> Column:
        """struct<new, changed, flags, reasons, rank> of a column."""

        def ended(old: Column, c: Column) -> Column:
            new = F.regexp_replace(F.regexp_replace(c["value"], r"(?U)\s+", " "), edges, "")
            return parsing.bound(new, lambda n: told(old, c, n, (n != "") & (n != old)))

        def told(old: Column, c: Column, new: Column, changed: Column) -> Column:
            rank = F.array_position(F.array(*map(F.lit, LEVELS)), c["confidence"])
            return F.struct(F.when(changed, new).otherwise(old).alias("new"), changed.alias("changed"), *[F.when(changed, c[k]).otherwise(none).alias(k) for k in ("flags", "reasons")], rank.alias("rank"))

        return parsing.bound(stripped(F.coalesce(F.col(column), F.lit(""))), lambda old: parsing.bound(chained(old, SANITATION), lambda c: ended(old, c)))

    def proposal(row: Column) -> Column:
        artist, title = row["artist"], row["title"]
        both = [F.array_distinct(F.concat(artist[k], title[k])).alias(k) for k in ("flags", "reasons")]
        said = F.struct(*both, level(F.least(artist["rank"], title["rank"]).cast("int") - 1).alias("confidence"))
        return parsing.bound(said, lambda x: F.when((artist["changed"] | title["changed"]) & (F.size(x["reasons"]) > 0), answer(x, artist["new"], title["new"])))

    def answer(x: Column, artist: Column, title: Column) -> Column:
        reason = F.coalesce(*[F.when(F.array_contains(x["flags"], flag), F.lit(why)) for flag, why in WHY], F.array_join(x["reasons"], "; "))
        states = [field_state(F.col(c), new).alias(c) for c, new in (("artist", artist), ("title", title))]
        return F.struct(*states, x["confidence"].alias("confidence"), reason.alias("reason"), x["flags"].alias("flags"), x["reasons"].alias("reasons"))

    fields = F.struct(judged("artist").alias("artist"), judged("title").alias("title"))
    return tracks.select(key, parsing.bound(fields, proposal).alias("__proposal")).where("__proposal IS NOT NULL").select(key, "__proposal.*")
