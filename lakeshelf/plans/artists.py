"""Queries of artist credits and their repair with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshelf.functions import artists
from lakeshelf.operators import artists as repairing
from lakeshelf.plans.catalogue import ORACLE_SQL, query
from lakeshelf.plans.parsing import VALID_ARTIST, Template, each, quoted, replaced
from lakeshelf.plans.views import view

NAME = Template("upper(§[1]) || lower(§[2:])")
WORD = f"CASE WHEN NOT regexp_matches(w, '[A-Za-z]') OR w IN ({each(artists.CAPITAL_WORDS)}) OR regexp_matches(w, '^[A-Z](?:\\.[A-Z])+\\.?$') OR upper(w) <> w THEN w ELSE {NAME.of('w')} END"
SPELT = Template("trim(" + replaced(replaced(replaced(replaced(f"translate(§, {quoted(artists.WRITTEN[0])}, {quoted(artists.WRITTEN[1])})", rf"(?i)(?:\b(?:{artists.GUEST})\b\.*\s*)+", "feat. "), r"(?i)\s*@?\s*\b\d+\s*bpm\b\s*", " "), rf"(?i)\s*[\[(](?:{'|'.join(artists.VERSIONS)})[^\])]*[\])]"), r"\s+", " ") + ")")
COUNTRY, BODY = "regexp_extract(§, '(\\([A-Z]{2,4}\\))\\s*$', 1)", "trim(regexp_replace(§, '\\s*\\([A-Z]{2,4}\\)\\s*$', ''))"
CASED = Template(f"""CASE WHEN regexp_matches(§, '[a-z]') OR NOT regexp_matches(§, '[A-Z][^A-Z]*[A-Z]') OR {BODY} = '' THEN § WHEN NOT contains({BODY}, ' ') AND length(regexp_replace({BODY}, '[^A-Za-z]', '', 'g')) <= {artists.LONGEST_ACRONYM} THEN §
  WHEN NOT contains({BODY}, ' ') THEN trim({NAME.of(f'({BODY})')} || ' ' || {COUNTRY}) ELSE trim(array_to_string(list_transform(string_split({BODY}, ' '), lambda w: {WORD}), ' ') || ' ' || {COUNTRY}) END""")


def credits(spark, sf_dir):
    return view(spark, sf_dir, "credits")


@query(f"+ s AS (SELECT id, {SPELT.of('artist')} AS v FROM v_credits) SELECT id, {CASED.of('v')} AS artist FROM s", "credits")
def normalised_artists(spark, sf_dir):
    return credits(spark, sf_dir).select("id", artists.normalised(F.col("artist")).alias("artist"))


LEAD = rf"(?i)^(?:{artists.GUEST})\.?\s+"
PARTED = f"""+ g AS (SELECT id, trim(coalesce(artist, '')) AS given, CASE WHEN coalesce(regexp_matches(title, '(?i)\\(feat'), false) THEN '' ELSE trim(regexp_replace(regexp_extract(trim(artist), '(?i)\\s(?:{artists.GUEST})\\.?\\s+(.+)$', 1), '{LEAD}', '')) END AS guest FROM v_credits),
  m AS (SELECT id, given, coalesce(guest, '') AS guest, CASE WHEN guest <> '' THEN trim(regexp_replace(given, '(?i)\\s+(?:{artists.GUEST})\\.?\\s+.+$', '')) ELSE given END AS main FROM g),
  s AS (SELECT *, CASE WHEN contains(main, ',') THEN ',' WHEN regexp_matches(main, '\\s&\\s') THEN '&' WHEN regexp_matches(main, '(?i)\\sx\\s') THEN 'x' WHEN regexp_matches(main, '(?i)\\svs\\.?\\s') THEN 'vs' WHEN regexp_matches(main, '(?i)\\sand\\s') THEN 'and' ELSE '' END AS sign FROM m),
  p AS (SELECT *, list_filter(list_transform(CASE sign WHEN ',' THEN string_split_regex(main, ',|\\s&\\s') WHEN '&' THEN string_split_regex(main, '\\s&\\s') WHEN 'x' THEN string_split_regex(main, '(?i)\\sx\\s') WHEN 'vs' THEN string_split_regex(main, '(?i)\\svs\\.?\\s') WHEN 'and' THEN string_split_regex(main, '(?i)\\sand\\s') ELSE [main] END, lambda v: trim(v)), lambda v: v <> '') AS tried FROM s),
  u AS (SELECT *, sign = 'and' AND NOT coalesce(len(list_filter(tried, lambda v: NOT coalesce({VALID_ARTIST.of('v')}, false))) = 0 AND len(tried) > 1, false) AS unsure FROM p),
  f AS (SELECT *, CASE WHEN unsure THEN [main] ELSE tried END AS parts, CASE WHEN sign = '' OR unsure THEN 'none' WHEN sign = ',' THEN CASE WHEN regexp_matches(main, '\\s&\\s') THEN 'nested' ELSE 'comma' END WHEN sign = '&' THEN 'ampersand' ELSE sign END AS separator FROM u),
  e AS (SELECT id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS k FROM f), n AS (SELECT id, k, {SPELT.of('part')} AS v FROM e), c AS (SELECT id, string_agg({CASED.of('v')}, '|' ORDER BY k) AS names FROM n GROUP BY id)
  SELECT f.id, array_to_string(parts, '|') AS parts, coalesce(names, '') AS names, guest, separator, CASE WHEN given = '' THEN 0e0 WHEN len(parts) > 1 AND separator = 'x' THEN 0.95e0 WHEN len(parts) > 1 AND separator = 'and' THEN 0.9e0 ELSE 1e0 END AS confidence FROM f LEFT JOIN c ON f.id = c.id"""


@query(PARTED, "credits")
def parsed_artists(spark, sf_dir):
    rows = artists.with_parts(credits(spark, sf_dir)).select("id", "parsed.*")
    return rows.select("id", F.array_join("parts", "|").alias("parts"), F.array_join("main", "|").alias("names"), "guest", "separator", "confidence")


@query(f"""+ w AS (SELECT id, string_split(trim(artist), ' ') AS words FROM v_credits WHERE artist IS NOT NULL), k AS (SELECT id, words, unnest(range(1, 6)) AS k FROM w WHERE len(words) BETWEEN 4 AND 6 AND NOT list_has_any(list_transform(words, lambda x: lower(x)), [{each(artists.NO_NAMES)}])),
  s AS (SELECT id, k, array_to_string(words[:k], ' ') AS l, array_to_string(words[k+1:], ' ') AS r FROM k WHERE k < len(words)), t AS (SELECT id, min(k) AS k FROM s WHERE regexp_matches(l, {quoted(artists.PERSON)}) AND regexp_matches(r, {quoted(artists.PERSON)}) GROUP BY id)
  SELECT t.id, l AS "left", r AS "right", {artists.PERSONS}e0 AS confidence FROM t JOIN s USING (id, k)""", "credits")  # fmt: skip
def joined_persons(spark, sf_dir):
    return credits(spark, sf_dir).select("id", artists.persons(F.col("artist")).alias("x")).where("x IS NOT NULL").select("id", "x.*")


KEYS = Template("list_filter(list_distinct([lower(trim(§)), trim(regexp_replace(lower(trim(§)), '[^a-z0-9\\s]', '', 'g'))]), lambda k: k <> '' AND length(trim(§)) >= 2)")
KNOWN = f"""aliases AS (SELECT n_name AS alias, concat(n_name, ' Lee') AS canonical FROM nation), names AS (SELECT p_brand AS name FROM part UNION SELECT unnest(string_split_regex(artist, {quoted(repairing.CREDIT)})) FROM v_credits WHERE id % 3 = 0 UNION SELECT alias FROM aliases UNION SELECT canonical FROM aliases),
  known AS (SELECT DISTINCT unnest({KEYS.of('name')}) AS key FROM names WHERE name IS NOT NULL)"""


def known(spark, sf_dir):
    part, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "nation"))
    aliases = nation.select(F.col("n_name").alias("alias"), F.concat("n_name", F.lit(" Lee")).alias("canonical"))
    return repairing.known_artists(part.select(F.col("p_brand").alias("name")), credits(spark, sf_dir).where("id % 3 = 0"), aliases)


@query(f"+ {KNOWN} SELECT key FROM known", "credits")
def known_names(spark, sf_dir):
    return known(spark, sf_dir)


CLEAN = "rtrim(regexp_replace(artist, '\\s*\\([A-Z][a-zA-Z]{0,2}\\)\\s*$', ''))"
REPAIRED = f"""+ {KNOWN}, b AS (SELECT id, artist, {CLEAN} AS c, regexp_extract(artist, '\\s*(\\([A-Z][a-zA-Z]{{0,2}}\\))\\s*$', 1) AS suffix FROM v_credits WHERE artist IS NOT NULL),
  q AS (SELECT *, unnest(range(1, length(c) + 1)) AS place FROM b),
  h AS (SELECT id, artist, suffix, 0 AS kind, place, [trim(c[:place]), trim(c[place+1:])] AS parts, 'camelcase_merge_detected' AS why FROM q WHERE regexp_matches(c[:place], '[^,/&; ] +[^ ]{{3,}}[a-z]$') AND regexp_matches(c[place+1:place+2], '^[A-Z]\\p{{L}}$')
    UNION ALL SELECT id, artist, '', 1, 0, list_filter(list_transform(string_split_regex(artist, '\\s*[/|\\\\]\\s*'), lambda v: trim(v)), lambda v: v <> ''), array_to_string(list_filter([CASE WHEN regexp_matches(artist, '[/\\\\]') THEN 'slash_separator_repair' END, CASE WHEN contains(artist, '|') THEN 'pipe_separator_repair' END], lambda v: v IS NOT NULL), '; ')
      FROM b WHERE regexp_matches(artist, '[/|\\\\]') AND lower(trim(artist)) <> 'ac/dc'),
  o AS (SELECT * FROM h WHERE len(parts) > 1 AND list_min(list_transform(parts, lambda v: length(v))) >= CASE kind WHEN 0 THEN 2 ELSE 3 END),
  e AS (SELECT id, kind, place, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM o),
  t AS (SELECT id, kind, place, count(*) AS n, count(*) FILTER (hit) AS n_known, max(pos) FILTER (hit) AS last FROM (SELECT *, EXISTS (SELECT 1 FROM known WHERE list_contains({KEYS.of('part')}, key)) AS hit FROM e) GROUP BY 1, 2, 3),
  z AS (SELECT *, CASE WHEN n_known = n THEN 0.85e0 WHEN n_known > 0 THEN 0.65e0 ELSE 0.45e0 END AS confidence FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, kind, place) AS k FROM z)
  SELECT o.id, o.artist, array_to_string(parts, ', ') || CASE WHEN suffix <> '' THEN ' ' || suffix ELSE '' END AS proposed, confidence, why || '; known_sides=' || CASE WHEN n_known = n THEN CASE kind WHEN 0 THEN 'both' ELSE 'all' END WHEN n_known = 0 THEN 'none' WHEN kind = 1 THEN 'some' WHEN last = 0 THEN 'left' ELSE 'right' END AS reason,
    n_known < n AS blocked FROM r JOIN o USING (id, kind, place) WHERE k = 1"""


def repaired(spark, sf_dir):
    return repairing.repairs(credits(spark, sf_dir), known(spark, sf_dir))


@query(REPAIRED, "credits")
def artist_repairs(spark, sf_dir):
    return repaired(spark, sf_dir)


@query("WITH found AS ({0}) SELECT count(*) AS flagged, count(*) FILTER (NOT blocked) AS applicable, count(*) FILTER (blocked) AS for_review FROM found".format(ORACLE_SQL["artist_repairs"]))
def artist_repair_counts(spark, sf_dir):
    return repairing.repair_counts(repaired(spark, sf_dir))
