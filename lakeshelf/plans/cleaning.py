"""Queries of cleaned tags and proposals with SQL that gives the same rows; RE2 has no look-around, so conditions stand apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshelf.operators import cleaning
from lakeshelf.plans.catalogue import query
from lakeshelf.plans.parsing import each, quoted, replaced, sanitised_sql
from lakeshelf.plans.views import view


def tags(spark, sf_dir):
    return view(spark, sf_dir, "tags")


def steps(source: str, column: str, name: str, changes: list[tuple[str, str]]) -> str:
    """CTEs that end in `name`: source's rows with `v`, and the reasons of changes (reason, SQL over v) that made a difference."""
    out, last = [f"{name}0 AS (SELECT *, coalesce({column}, '') AS v, CAST([] AS VARCHAR[]) AS why FROM {source})"], f"{name}0"
    for k, (reason, change) in enumerate(changes):
        here = name if k + 1 == len(changes) else f"{name}{k + 1}"
        out.append(f"{here} AS (SELECT * EXCLUDE (v, why, w), CASE WHEN v = '' THEN v ELSE w END AS v, CASE WHEN v <> '' AND w <> v AND NOT list_contains(why, '{reason}') THEN list_append(why, '{reason}') ELSE why END AS why FROM (SELECT *, {change} AS w FROM {last}))")
        last = here
    return ", ".join(out)


def strip(x: str) -> str:
    return replaced(x, r"^\s+|\s+$")


FIRST = "string_split_regex(trim(regexp_replace(v, '^0{0,2}\\d\\s+', '')), '\\s+')[1]"
CONTENT = "regexp_extract(v, '\\s*\\(([^)]*)\\)\\s*$', 1)"
WORDS = f"string_split(regexp_replace(lower({CONTENT}), '[^a-z\\s]', ' ', 'g'), ' ')"
WITHOUT_BRACKET = "rtrim(regexp_replace(v, '\\s*\\([^)]*\\)\\s*$', ''))"
WITHOUT_BPM = "rtrim(regexp_replace(v, '([\\s)])(?:0?[89]\\d|1[0-5]\\d|160)\\s*$', '\\1'))"
SAME_WORD = "lower(ws[k]) = lower(ws[k-1]) AND (lower(ws[k]) = lower(ws[k-2]) OR lower(ws[k]) = lower(ws[k+1])) AND regexp_matches(lower(ws[k]), '^[a-z][\\w'']{2,}$')"
BY_FIELD = {
    "title": [
        ("title_prefix_removed", replaced("v", r"^\*{0,5}\s*\d{1,3}\s*(?:[|.–—]|-{1,2})\s+")),
        ("title_bare_number_stripped", f"CASE WHEN regexp_matches(v, '^0{{0,2}}\\d\\s+[A-Za-z(]') AND lower({FIRST}) NOT IN ({each(cleaning.COUNTED)}) AND length(trim(regexp_replace(v, '^0{{0,2}}\\d\\s+', ''))) >= 2 THEN trim(regexp_replace(v, '^0{{0,2}}\\d\\s+', '')) ELSE v END"),
        ("title_domain_token_stripped", strip(replaced("v", rf"(?i)\s*\([^)]*(?:{cleaning.PIRATES})[^)]*\)"))),
        ("title_trailing_bpm_stripped", f"CASE WHEN regexp_matches(v, '[\\s)](?:0?[89]\\d|1[0-5]\\d|160)\\s*$') AND {WITHOUT_BPM} <> '' THEN {WITHOUT_BPM} ELSE v END"),
        ("title_label_suffix_stripped", f"CASE WHEN regexp_matches(v, '\\([^)]*\\)\\s*$') AND NOT list_has_any({WORDS}, [{each(cleaning.VERSION_BRACKET)}]) AND (list_has_any({WORDS}, [{each(cleaning.LABEL_BRACKET)}]) OR lower(trim({CONTENT})) IN ({each(cleaning.LABELS)})) AND {WITHOUT_BRACKET} <> '' THEN {WITHOUT_BRACKET} ELSE v END"),
        ("title_feat_normalized", "replace(v, '(Feat.', '(feat.')"),
        ("title_separator_fixed", replaced("v", r"\s*[-–—]\s*(?:[-–—]\s*)+", " - ")),
        ("title_spacing_fixed", replaced("v", r"[\[(]\s*[\])]")),
        ("title_parentheses_fixed", replaced("v", r"\s*\([^)]*$")),
        ("title_spacing_fixed", replaced("v", r"(\S)\(", r"\1 (")),
        ("title_spacing_fixed", strip(replaced("v", " {2,}", " "))),
    ],
    "artist": [
        ("artist_url_removed", strip(replaced("v", r"(?i)\bhttps?://\S+|\bwww\.\S+|\b[a-z0-9\-]{2,}\.(?:com|net|org)\b"))),
        ("artist_feat_normalized", replaced(replaced("v", r"(?i)\bft\.(\s*\S)", r"feat.\1"), r"(?i)\bfeaturing\b", "feat.")),
        ("artist_spacing_fixed", replaced("v", r"(?:\s*[,/]\s*){2,}", ", ")),
        ("artist_spacing_fixed", strip(replaced("v", " {2,}", " "))),
    ],
    "organization": [
        ("label_junk_email", f"CASE WHEN regexp_matches(v, {quoted(cleaning.EMAIL)}) THEN '' ELSE v END"),
        ("label_junk_placeholder", f"CASE WHEN lower(trim(v)) IN ({each(cleaning.NO_LABELS)}) THEN '' ELSE v END"),
        ("label_spacing_fixed", strip(replaced("v", " {2,}", " "))),
    ],
    "isrc": [("invalid_isrc", "CASE WHEN regexp_matches(replace(replace(upper(trim(v)), '-', ''), ' ', ''), '^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$') THEN v ELSE '' END")],
}
ALBUM_WHY = f"""CASE WHEN v = '' THEN NULL WHEN regexp_matches(v, {quoted(cleaning.EMAIL)}) THEN 'album_junk_email' WHEN regexp_matches(v, '(?i)https?://|www\\.') THEN CASE WHEN clean = '' THEN 'album_junk_url' ELSE 'album_url_stripped' END
  WHEN regexp_matches(v, '^[/\\\\]|[A-Za-z]:[/\\\\]') THEN 'album_junk_path_fragment' WHEN regexp_matches(v, '\\.{{5,}}') THEN 'album_junk_excessive_dots' WHEN clean = v THEN NULL
  WHEN clean = '' THEN CASE WHEN regexp_matches(v, '(?i)\\b[a-z0-9\\-]+\\.[a-z]{{2,4}}\\b') THEN 'album_junk_domain' ELSE 'album_junk_promo' END ELSE 'album_promo_stripped' END"""
LONG = f"""g AS (SELECT *, several AS multi FROM v_tags), {', '.join(steps('g', f, f'x_{f}', c) for f, c in BY_FIELD.items())}, a0 AS (SELECT id, coalesce(album, '') AS v FROM v_tags), {sanitised_sql('a0', 'v', 'a1')}, a2 AS (SELECT *, {ALBUM_WHY} AS w FROM a1),
  changed AS (SELECT id, 'album' AS field, v AS old, CASE WHEN w IS NULL THEN v WHEN starts_with(w, 'album_junk') THEN '' ELSE clean END AS new, CASE WHEN w IS NULL THEN CAST([] AS VARCHAR[]) ELSE [w] END AS why, false AS multi FROM a2
    UNION ALL {' UNION ALL '.join(f"SELECT id, '{f}', coalesce({f}, ''), v, why, {'multi' if f == 'artist' else 'false'} FROM x_{f}" for f in BY_FIELD)})"""


@query(f"+ {LONG} SELECT id, field, new AS value, coalesce(why[1], '') AS reason, array_to_string(why, ',') AS reasons FROM changed", "tags")
def clean_fields(spark, sf_dir):
    rows = cleaning.with_clean_fields(tags(spark, sf_dir))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"clean_{f}.value").alias("value"), F.col(f"clean_{f}.reasons").alias("reasons")) for f in cleaning.FIELDS])
    rows = rows.select("id", F.explode(fields).alias("f"))
    return rows.select("id", "f.field", "f.value", F.coalesce(F.get("f.reasons", F.lit(0)), F.lit("")).alias("reason"), F.array_join("f.reasons", ",").alias("reasons"))


def changes(spark, sf_dir):
    rows = tags(spark, sf_dir)
    values = {f: F.when(F.col(f).isNotNull(), F.array(f)) for f in cleaning.FIELDS}
    return cleaning.tag_changes(rows.withColumns(values | {"artist": F.when(F.col("several"), F.array("artist", F.lit("Bo"))).otherwise(values["artist"])}), "id")


KEPT = "NOT multi AND new <> old"
LISTED = f"""string_agg(field || ':' || old || '>' || new || ':' || why[1], chr(10) ORDER BY list_position([{each(cleaning.FIELDS)}], field)) FILTER ({KEPT})"""


@query(f"+ {LONG} SELECT id, coalesce({LISTED}, '') AS changes, CASE WHEN bool_or(multi) THEN 'artist: skipped_multi_value_artist' ELSE '' END AS skipped FROM changed GROUP BY id HAVING bool_or(multi) OR bool_or({KEPT})", "tags")
def tag_changes(spark, sf_dir):
    listed = F.transform("changes", lambda c: F.concat(c["field"], F.lit(":"), c["old"], F.lit(">"), c["new"], F.lit(":"), c["reason"]))
    return changes(spark, sf_dir).select("id", F.array_join(listed, "\n").alias("changes"), F.array_join("skipped", ",").alias("skipped"))


@query(f"+ {LONG} SELECT field, why[1] AS reason, count(*) AS n FROM changed WHERE {KEPT} GROUP BY 1, 2", "tags")
def tag_change_counts(spark, sf_dir):
    return cleaning.change_counts(changes(spark, sf_dir))


def proposed_sql(column: str) -> str:
    spaced = strip(replaced("v", r"\s+", " "))
    sources = replaced(replaced("v", rf"(?i)\s*[(\[][^)\]]*(?:{cleaning.SOURCES}|\.com)[^)\]]*[)\]]\s*", " "), rf"(?i)\b(?:{cleaning.SOURCES})(?:\.com)?\b|(?:^|\s)[\w-]+\.com\b|\.com\b", " ")
    words = "array_to_string(list_filter(list_transform(range(1, len(string_split(v, ' ')) + 1), lambda k: CASE WHEN " + SAME_WORD.replace("ws", "string_split(v, ' ')") + " THEN NULL ELSE string_split(v, ' ')[k] END), lambda w: w IS NOT NULL), ' ')"
    changes = [
        ("whitespace corruption normalized", spaced), ("malformed separators normalized", replaced("v", r"\s*(?:[-_/|]{2,}|[|])\s*", " - ")), ("source token removed", sources),
        ("ambiguous version cleanup", replaced("v", r"(?i)(?:\s+AlbumVersion|([a-z])AlbumVersion)\s*$", r"\1")), ("junk suffix removed", replaced("v", r"(?i)(?:\s+(?:Macia)?Downloads|([a-z])(?:Macia)?Downloads)\s*$", r"\1")), ("duplicated word cleanup", words),
    ]
    edges = replaced(replaced("v", r"\s+", " "), r"^[\s\-_/|.,]+|[\s\-_/|.,]+$")
    return f"{steps('g', f'trim({column})', f's_{column}', changes)}, p_{column} AS (SELECT id, trim(coalesce({column}, '')) AS old, {edges} AS new, why, new <> '' AND new <> old AS changed FROM s_{column})"


MEET = "CASE WHEN list_has_any(aw || tw, ['source token removed', 'ambiguous version cleanup']) THEN 'LOW' WHEN list_contains(aw || tw, 'duplicated word cleanup') THEN 'MEDIUM' ELSE 'HIGH' END"
REASON = {"ambiguous_version_cleanup": "ambiguous version cleanup", "source_token_removed": "source token removed", "duplicated_word_cleanup": "duplicated word cleanup", "junk_suffix_removed": "junk suffix removed"}


@query(f"""+ g AS (SELECT id, artist, title FROM v_tags), {proposed_sql('artist')}, {proposed_sql('title')},
  b AS (SELECT a.id, CASE WHEN a.changed THEN a.new ELSE a.old END AS artist, CASE WHEN t.changed THEN t.new ELSE t.old END AS title, a.why AS aw, t.why AS tw, CASE WHEN a.changed THEN a.why ELSE CAST([] AS VARCHAR[]) END || list_filter(CASE WHEN t.changed THEN t.why ELSE CAST([] AS VARCHAR[]) END, lambda w: NOT (a.changed AND list_contains(a.why, w))) AS why FROM p_artist a JOIN p_title t USING (id) WHERE a.changed OR t.changed)
  SELECT id, artist, title, {MEET} AS confidence, CASE {' '.join(f"WHEN list_contains(why, '{REASON[flag]}') THEN '{text}'" for flag, text in cleaning.WHY)} ELSE array_to_string(why, '; ') END AS reason, array_to_string(why, ',') AS reasons FROM b WHERE len(why) > 0""", "tags")  # fmt: skip
def sanitation_proposals(spark, sf_dir):
    rows = cleaning.sanitation_proposals(tags(spark, sf_dir))
    return rows.select("id", F.col("artist.proposed").alias("artist"), F.col("title.proposed").alias("title"), "confidence", "reason", F.array_join("reasons", ",").alias("reasons"))
