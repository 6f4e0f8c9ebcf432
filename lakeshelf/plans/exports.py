"""Queries of exports with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshelf.functions import text
from lakeshelf.operators import exports
from lakeshelf.plans.catalogue import ORACLE_SQL, query
from lakeshelf.plans.parsing import each, quoted
from lakeshelf.plans.views import view


def pairs(rows) -> str:
    return ", ".join(f"({quoted(a)}, {quoted(b)}, {k})" for k, (a, b) in enumerate(rows))


BASE = "trim(regexp_replace(regexp_replace(string_split_regex(trim(coalesce(genre, '')), '[,;/|]')[1], '[-_]+', ' ', 'g'), '\\s+', ' ', 'g'))"
JUNK = f"length(key) <= 1 OR key IN ({each(text.JUNK_GENRES)}) OR regexp_matches(key, '^\\d{{1,2}}[ab]$') OR regexp_matches(key, 'https?:|www\\.|\\.com')"
HELD = "(SELECT g FROM phrases WHERE contains({0}, phrase) ORDER BY k LIMIT 1)"
GENRES = f"""names(name, g, k) AS (VALUES {pairs(exports.Genres().aliases)}), phrases(phrase, g, k) AS (VALUES {pairs(exports.PHRASES)}),
  gb AS (SELECT id, lower({BASE}) AS key FROM v_exports), gp AS (SELECT id, key, array_to_string(list_filter(string_split(key, ' '), lambda w: w NOT IN ({each(exports.MODIFIERS)})), ' ') AS cut FROM gb), gc AS (SELECT id, key, CASE WHEN cut = '' THEN key ELSE cut END AS plain FROM gp),
  genres AS (SELECT id, CASE WHEN {JUNK} THEN '' ELSE coalesce((SELECT g FROM names WHERE name = key), (SELECT g FROM names WHERE name = plain), {HELD.format('plain')}, {HELD.format('key')}, 'Other') END AS canonical FROM gc)"""


def tracks(spark, sf_dir):
    return view(spark, sf_dir, "exports")


@query(f"+ {GENRES} SELECT id, canonical FROM genres", "exports")
def canonical_genres(spark, sf_dir):
    return tracks(spark, sf_dir).select("id", exports.canonical_genre(F.col("genre")).alias("canonical"))


UNKNOWN = f"lower(trim({{0}})) IN ({each(text.UNKNOWN_ARTISTS)})"
RESOLVED = f"""+ {GENRES}, files AS (SELECT CASE WHEN id % 3 = 0 THEN '/ssd/' || upper(substr(filepath, 6)) WHEN id % 9 = 1 THEN '/gone/' || id ELSE filepath END AS path FROM v_exports),
  named AS (SELECT lower(regexp_extract(path, '([^/]*)$', 1)) AS name, min(path) AS path FROM files GROUP BY 1), there AS (SELECT DISTINCT path FROM files),
  l AS (SELECT e.*, canonical, coalesce(t.path, n.path) AS place, CASE WHEN t.path IS NOT NULL THEN 'ok' WHEN n.path IS NOT NULL THEN 'recovered' ELSE 'unresolved' END AS found, regexp_matches(e.filepath, '(?i)/(?:\\.[^/]*|unknown(?:\\s*\\(\\d+\\))?\\.mp3)$') AS junk
    FROM v_exports e JOIN genres USING (id) LEFT JOIN there t ON t.path = e.filepath LEFT JOIN named n ON t.path IS NULL AND n.name = lower(regexp_extract(e.filepath, '([^/]*)$', 1))),
  s AS (SELECT *, string_split_regex(regexp_extract(coalesce(place, filepath), '([^/]*)\\.[^.]*$', 1), '\\s+-\\s+') AS parts, trim(coalesce(artist, '')) AS a0, trim(coalesce(title, '')) AS t0, trim(coalesce(key_camelot, '')) AS k0 FROM l),
  r AS (SELECT *, CASE WHEN {UNKNOWN.format('a0')} AND len(parts) = 2 THEN trim(parts[1]) ELSE a0 END AS a1, CASE WHEN t0 = '' AND len(parts) = 2 THEN trim(parts[2]) ELSE t0 END AS t1, coalesce(bpm, 0) = 0 AS none, NOT regexp_matches(k0, '(?i)^(1[0-2]|[1-9])[AB]$') AS bad FROM s),
  w AS (SELECT *, list_filter([CASE WHEN t1 = '' THEN ['MISSING_METADATA', 'missing title (filename fallback failed)'] END, CASE WHEN {UNKNOWN.format('a1')} THEN ['MISSING_METADATA', 'missing/unknown artist: ''' || a1 || ''' (filename fallback failed)'] END, CASE WHEN none THEN ['MISSING_ANALYSIS', 'missing BPM'] END,
    CASE WHEN NOT none AND NOT bpm BETWEEN 50 AND 220 THEN ['BAD_PATH', 'BPM out of range: ' || printf('%.1f', bpm)] END, CASE WHEN bad THEN ['MISSING_ANALYSIS', 'missing/invalid Camelot key: ''' || k0 || ''''] END, CASE WHEN canonical = '' THEN ['MISSING_METADATA', 'junk/missing genre: ''' || coalesce(genre, '') || ''''] END], lambda x: x IS NOT NULL) AS why FROM r)
  SELECT id, coalesce(place, filepath) AS filepath, CASE WHEN junk THEN 'junk' ELSE found END AS found, a1 AS artist, t1 AS title, canonical AS genre,
    CASE WHEN junk THEN '[JUNK_PLACEHOLDER] filename matches known junk pattern' WHEN found = 'unresolved' THEN '[STALE_DB] file not found' ELSE array_to_string(list_transform(why, lambda x: '[' || CASE WHEN none OR bad THEN 'MISSING_ANALYSIS' ELSE x[1] END || '] ' || x[2]), '; ') END AS reasons FROM w"""


def resolved(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    path = F.when(F.col("id") % 3 == 0, F.concat(F.lit("/ssd/"), F.upper(F.substring("filepath", 6, 1000)))).when(F.col("id") % 9 == 1, F.concat(F.lit("/gone/"), "id")).otherwise(F.col("filepath"))
    return exports.resolved(rows, rows.select(path.alias("filepath")))


@query(RESOLVED, "exports")
def export_resolved(spark, sf_dir):
    return resolved(spark, sf_dir).withColumn("reasons", F.array_join("reasons", "; "))


@query("WITH x AS ({0}) SELECT count(*) FILTER (reasons = '') AS valid, count(*) FILTER (reasons = '' AND found = 'recovered') AS recovered, count(*) FILTER (found = 'unresolved') AS stale_db, count(*) FILTER (found = 'junk') AS junk, count(*) FILTER (starts_with(reasons, '[MISSING_ANALYSIS]')) AS needs_analysis FROM x".replace("{0}", ORACLE_SQL["export_resolved"]))
def export_counts(spark, sf_dir):
    return exports.export_counts(resolved(spark, sf_dir))
