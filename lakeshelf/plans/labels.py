"""Queries of record labels with the SQL that gives the same rows."""

from __future__ import annotations

from lakeshelf.operators import labels
from lakeshelf.plans.catalogue import query
from lakeshelf.plans.parsing import ADS, ENDS, each, quoted, replaced
from lakeshelf.plans.views import view

RAW = "trim(value)"
NAME = f"lower(trim({replaced(replaced(replaced(replaced(RAW, r'^[\[\]()\s]+|[\[\]()\s]+$'), r'[\s\-|_]{2,}', ' '), r'^\s+|\s+$'), r'^[.\-_|,;:!?]+|[.\-_|,;:!?]+$')}))"
SOURCE = f"list_filter([{each(ADS.source_parts)}], lambda s: contains(lower({RAW}), s))[1]"
WHY = f"""CASE WHEN {RAW} = '' THEN 'empty' WHEN regexp_matches({RAW}, '(?i)^(?:1[0-2]|[1-9])[AB]\\s*[-|_]*\\s*$') THEN 'Camelot/musical key' WHEN regexp_matches(lower({RAW}), 'https?://|www\\.') THEN 'URL or domain prefix'
  WHEN regexp_matches(lower({RAW}), '\\.(?:{ENDS})(?:\\s|/|$)') THEN 'domain name' WHEN {SOURCE} IS NOT NULL THEN 'source junk (''' || {SOURCE} || ''')' WHEN {NAME} = '' THEN 'empty after normalization' WHEN length({NAME}) = 1 THEN 'single character'
  WHEN {NAME} IN ({each(labels.NO_LABELS)}) THEN 'exact junk value' WHEN {NAME} IN ({each(labels.GENRES)}) THEN 'genre word' WHEN regexp_matches({NAME}, {quoted(labels.NO_NAMES)}) THEN 'junk pattern' END"""
KEY = f"array_to_string(list_slice(w, 1, coalesce(list_max(list_filter(range(1, len(w) + 1), lambda k: w[k] NOT IN ({each(labels.ENDINGS)}))), 0)), ' ')"
STEM = "trim(regexp_extract(filepath, '([^/]*)\\.[^.]*$', 1))"


def in_file(answers: list[str]) -> str:
    """CASE over the patterns of a file's name with an answer for each."""
    found = [f"regexp_extract({STEM}, {quoted(p)}, 1)" for p, _ in labels.NAMED]
    return "CASE " + " ".join(f"WHEN length(trim({f})) BETWEEN 2 AND 60 AND regexp_matches({f}, '[A-Za-z]') THEN {answer}" for f, answer in zip(found, answers, strict=True)) + " END"


FILE_LABEL, FILE_SCORE = in_file([f"trim(regexp_extract({STEM}, {quoted(p)}, 1))" for p, _ in labels.NAMED]), in_file([f"{c}e0" for _, c in labels.NAMED])
TRIED = " UNION ALL ".join(f"SELECT id, {k} AS k, trim(coalesce({f}, '')) AS value, '{s}' AS source, {c}e0 AS confidence, '{a}' AS action, {str(n).lower()} AS shown FROM v_labelled" for k, (f, s, c, a, n) in enumerate(labels.FIELDS))
FOUND = f"""+ c AS ({TRIED} UNION ALL SELECT id, 9, coalesce({FILE_LABEL}, ''), 'filename', coalesce({FILE_SCORE}, 0e0), 'filled', false FROM v_labelled), j AS (SELECT *, {WHY} AS why FROM c),
  g AS (SELECT *, value <> '' AND why IS NOT NULL AS junk, value <> '' AND why IS NULL AND (NOT shown OR regexp_matches(value, {quoted(labels.SHOWN)})) AS good FROM j), f AS (SELECT id, min(k) FILTER (good) AS k FROM g GROUP BY id),
  n AS (SELECT f.id, count(*) FILTER (junk AND g.k < coalesce(f.k, 99)) AS junk_count FROM f JOIN g USING (id) GROUP BY 1),
  l AS (SELECT f.id, g.value AS label, coalesce(g.source, 'unresolved') AS source, coalesce(g.confidence, 0e0) AS confidence, coalesce(g.action, 'unresolved') AS action, junk_count, g.value IS NOT NULL AND g.confidence >= {labels.WRITABLE}e0 AS writable,
    list_filter(string_split_regex(regexp_replace(lower(coalesce(g.value, '')), '[‘’''´`\\-_.,!?&]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM f LEFT JOIN g ON g.id = f.id AND g.k = f.k JOIN n ON n.id = f.id),
  found AS (SELECT * EXCLUDE (w), {KEY} AS key FROM l), s AS (SELECT key, label, min(id) AS first, upper(label) = label AND regexp_matches(label, '\\p{{Lu}}') AS shouted FROM found WHERE label IS NOT NULL AND key <> '' GROUP BY key, label),
  b AS (SELECT key, label AS canonical FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY shouted, length(label) DESC, first) = 1), named AS (SELECT found.*, coalesce(canonical, label) AS canonical FROM found LEFT JOIN b ON b.key = found.key)"""


def found(spark, sf_dir):
    return labels.detected(view(spark, sf_dir, "labelled"))


@query(f"{FOUND} SELECT id, label, key, source, confidence, action, junk_count, writable, canonical FROM named", "labelled")
def detected_labels(spark, sf_dir):
    return labels.with_canonical(found(spark, sf_dir))


@query(f"{FOUND} SELECT count(*) AS total, count(*) FILTER (source = 'embedded_tag') AS embedded, count(*) FILTER (source IN ('fallback_tag', 'filename')) AS filled, count(*) FILTER (source = 'unresolved') AS unresolved, sum(junk_count) AS junk_values, count(*) FILTER (junk_count > 0) AS junk_tracks, count(*) FILTER (writable) AS writable FROM found", "labelled")
def label_summary(spark, sf_dir):
    return labels.label_summary(found(spark, sf_dir))


@query(f"{FOUND} SELECT canonical, count(*) AS n FROM named WHERE canonical IS NOT NULL GROUP BY 1 ORDER BY n DESC, canonical LIMIT 15", "labelled")
def top_labels(spark, sf_dir):
    return labels.top_labels(found(spark, sf_dir))
