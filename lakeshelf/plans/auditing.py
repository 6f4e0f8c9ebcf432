"""Queries of path audits with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshelf.functions import audit as rules
from lakeshelf.functions import text
from lakeshelf.operators import audit, resolution
from lakeshelf.plans.catalogue import AUDIT, PAIRED, SCORE, TOKENS, query, tracks
from lakeshelf.plans.parsing import Template, each
from lakeshelf.plans.views import view

NAME = "lower(regexp_extract(filepath, '([^/]*)$', 1))"


@query(f"""+ f AS (SELECT CASE WHEN id % 7 = 0 THEN '/moved' || filepath ELSE filepath END AS filepath FROM v_tracks WHERE id % 3 <> 0)
  SELECT id FROM v_tracks t WHERE filepath NOT IN (SELECT filepath FROM f) AND {NAME} NOT IN (SELECT {NAME} FROM f)""", "tracks")  # fmt: skip
def stale_tolerant(spark, sf_dir):
    files = tracks(spark, sf_dir).where("id % 3 <> 0").select(F.when(F.col("id") % 7 == 0, F.concat(F.lit("/moved"), "filepath")).otherwise(F.col("filepath")).alias("filepath"))
    return audit.stale_rows(tracks(spark, sf_dir), files).select("id")


@query("""+ o AS (SELECT id, filesize_bytes AS size FROM v_tracks WHERE id % 20 = 0), f AS (SELECT filesize_bytes + id % 3 * 400000 AS size FROM v_tracks WHERE id % 20 <> 0)
  SELECT id, EXISTS (SELECT 1 FROM f WHERE f.size = o.size AND o.size > 0) AS exact, EXISTS (SELECT 1 FROM f WHERE f.size > 0 AND abs(f.size - o.size) / CAST(o.size AS DOUBLE) < 0.1) AS near FROM o""", "tracks")
def orphan_sizes(spark, sf_dir):
    files = tracks(spark, sf_dir).where("id % 20 <> 0").withColumn("filesize_bytes", F.col("filesize_bytes") + F.col("id") % 3 * 400000)
    return audit.size_matches(tracks(spark, sf_dir).where("id % 20 = 0"), files)


@query("""+ o AS (SELECT id, filepath, coalesce(status, 'unknown') AS status FROM v_tracks WHERE id % 20 = 0)
  SELECT 'top_folder' AS dimension, split_part(filepath, '/', 3) AS value, count(*) AS n FROM o GROUP BY 2
  UNION ALL SELECT 'stage_status', coalesce(stage, 'unknown') || '/' || o.status, count(*) FROM o LEFT JOIN v_states s ON s.track_id = o.id GROUP BY 2
  UNION ALL (SELECT 'parent', regexp_extract(filepath, '^(.*)/[^/]*$', 1) AS p, count(*) AS n FROM o GROUP BY 2 ORDER BY n DESC, p LIMIT 30)""", "tracks", "states")
def orphan_histograms(spark, sf_dir):
    return audit.orphan_histograms(tracks(spark, sf_dir).where("id % 20 = 0"), view(spark, sf_dir, "states"), "/lib")


@query(f"""+ k AS (SELECT *, regexp_extract(filepath,'\\.([a-z0-9]+)$',1) AS ext, {AUDIT} AS name, {TOKENS} AS tok FROM v_tracks), o AS (SELECT id, '/old' || filepath AS old_path, coalesce(status,'') AS status, name, tok, ext, CASE WHEN id % 40 = 0 THEN filesize_bytes * 1.02e0 ELSE filesize_bytes END AS size FROM k WHERE id % 20 = 0)
  SELECT o.id, 'audit' AS stage, old_path, filepath AS replacement_path FROM o JOIN k USING (name) WHERE o.status <> 'stale' AND name <> '' AND o.ext = k.ext AND abs(o.size - filesize_bytes) / o.size < 0.01
    AND len(o.tok) > 0 AND len(list_intersect(o.tok, k.tok)) / CAST(len(o.tok) AS DOUBLE) >= 0.9
    AND 0.6e0 * len(list_intersect(o.tok, k.tok)) / CAST(len(o.tok) AS DOUBLE) + 0.3e0 * greatest(0e0, 1 - abs(o.size - filesize_bytes) / o.size) + 0.1e0 >= 0.95e0
    QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY abs(o.size - filesize_bytes) / o.size, filepath) = 1""", "tracks")  # fmt: skip
def superseded_states(spark, sf_dir):
    rows = tracks(spark, sf_dir).where("id % 20 = 0").select("id", F.lit("audit").alias("stage"), F.concat(F.lit("/old"), "filepath").alias("filepath"), "status",
        F.when(F.col("id") % 40 == 0, F.col("filesize_bytes") * 1.02).otherwise(F.col("filesize_bytes")).alias("filesize_bytes"))
    return audit.superseded(rows, tracks(spark, sf_dir))


STEM = Template("regexp_extract(§, '([^/]*)\\.[^.]*$', 1)")
WORDS = Template("list_filter(string_split(trim(regexp_replace(regexp_replace(lower(§), '\\s*\\(\\d+\\)\\s*$', ''), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')")
FOUND = Template(f"list_filter(list_distinct({WORDS.of(STEM)}), lambda w: w IN ({each(rules.VERSION_TOKENS)}))")
VERSIONS = Template(f"list_sort(CASE WHEN regexp_matches(lower({STEM}), '\\bre[\\s-]*edit\\b') THEN list_distinct(list_append(list_filter({FOUND}, lambda w: w <> 'edit'), 're-edit')) ELSE {FOUND} END)")
ARTISTS = Template(f"list_filter(list_distinct({WORDS.of(f'''split_part({STEM}, ' - ', 1)''')}), lambda w: length(w) > 1 AND w NOT IN ({each(rules.CONNECTORS)}))")
TITLE = Template(WORDS.of(f"regexp_replace({STEM}, '^.*? - ', '')"))
DIGITS, REST = Template(f"regexp_matches({TITLE}[1], '^\\d+$')"), Template(f"CASE WHEN regexp_matches({TITLE}[1], '^\\d+$') THEN {TITLE}[2:] ELSE {TITLE} END")
TIERED = f"""r AS (SELECT *, {VERSIONS.of('old_path')} <> {VERSIONS.of('new_path')} AS version, {DIGITS.of('old_path')} <> {DIGITS.of('new_path')} AND {REST.of('old_path')} = {REST.of('new_path')} AS number,
    len({ARTISTS.of('old_path')}) > 0 AND len(list_filter({ARTISTS.of('new_path')}, lambda w: NOT list_contains({ARTISTS.of('old_path')}, w))) >= 2 AS artists,
    regexp_extract(old_path, '\\.([^.]*)$', 1) = regexp_extract(new_path, '\\.([^.]*)$', 1) AS same FROM v_pairs),
  t AS (SELECT *, CASE WHEN score >= 0.95 AND overlap >= 0.9 AND coalesce(off < 0.01, false) AND same THEN CASE WHEN version OR number OR artists THEN 'REVIEW_CAREFULLY' ELSE 'AUTO_SAFE_CANDIDATE' END WHEN score >= 0.8 THEN 'REVIEW_CAREFULLY' ELSE 'WEAK_MATCH' END AS tier FROM r)"""


def pairs(spark, sf_dir):
    """Pairs with what tells their names apart, judged once a row, and their tier; `weak` is known without it."""
    old, new, score = F.col("old_path"), F.col("new_path"), F.col("score")
    rows = view(spark, sf_dir, "pairs").select("*", rules.differences(old, new).alias("d"))
    sure = rules.is_sure(score, F.col("overlap"), F.col("off"), text.extension(old) == text.extension(new))
    return rows.select("*", "d.versions", "d.version", "d.number", "d.artists", rules.graded(sure, score, rules.is_risky(F.col("d"))).alias("tier"), rules.is_weak(sure, score).alias("weak")).drop("d")


@query(f"+ {TIERED} SELECT id, array_to_string({VERSIONS.of('old_path')}, ',') AS versions, version, number, artists, tier FROM t", "pairs")
def candidate_tiers(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", F.array_join("versions", ",").alias("versions"), "version", "number", "artists", "tier")


@query(f"+ {TIERED} SELECT v AS value, count(*) FILTER (tier = v) AS n FROM t, (SELECT unnest([{each(rules.TIERS)}]) AS v) WHERE NOT artists GROUP BY 1", "pairs")
def tier_counts(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(F.inline(F.array(F.struct("artists", "tier"))))  # as generated rows, so that the filter doesn't judge names again
    return audit.counts_of(rows.where("NOT artists"), "tier", rules.TIERS)


KINDS = """CASE WHEN tier = 'AUTO_SAFE_CANDIDATE' THEN 'moved_auto_safe' WHEN tier = 'WEAK_MATCH' THEN 'missing_file' WHEN number THEN 'unresolved_reference' ELSE 'moved_review' END"""
PLAN = f"""{TIERED}, k AS (SELECT *, {KINDS} AS kind FROM t), p AS (SELECT CASE kind WHEN 'moved_auto_safe' THEN 'update_path' WHEN 'missing_file' THEN 'mark_missing' WHEN 'unresolved_reference' THEN 'review_reference' ELSE 'review_move' END AS action,
    CASE kind WHEN 'moved_auto_safe' THEN 'low' WHEN 'unresolved_reference' THEN 'high' ELSE 'medium' END AS risk, id, CASE WHEN id % 50 = 0 THEN '' ELSE old_path END AS old_path, CASE WHEN kind = 'missing_file' OR id % 30 = 0 THEN NULL ELSE new_path END AS new_path FROM k),
  f AS (SELECT DISTINCT new_path FROM v_pairs WHERE id % 10 <> 3), u AS (SELECT new_path, count(*) AS uses FROM p WHERE new_path IS NOT NULL GROUP BY 1),
  q AS (SELECT p.*, f.new_path IS NOT NULL AS there, coalesce(uses, 0) AS uses FROM p LEFT JOIN f USING (new_path) LEFT JOIN u USING (new_path)),
  c AS (SELECT *, list_filter([CASE WHEN coalesce(old_path, '') = '' THEN 'missing_old_path' END, CASE WHEN action = 'update_path' AND new_path IS NULL THEN 'missing_new_path' END, CASE WHEN new_path IS NOT NULL AND NOT there THEN 'new_path_not_found' END,
    CASE WHEN action = 'update_path' AND uses > 1 THEN 'new_path_used_twice' END, CASE WHEN risk = 'high' THEN 'high_risk' END], lambda x: x IS NOT NULL) AS issues FROM q)"""


def plan(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("old_path", F.when(F.col("id") % 50 == 0, "").otherwise(F.col("old_path"))).withColumn("new_path", F.when(F.col("id") % 30 != 0, F.col("new_path")))
    kind = F.when(F.col("tier") == rules.TIERS[0], "moved_auto_safe").when(F.col("tier") == rules.TIERS[2], "missing_file").when(F.col("number"), "unresolved_reference").otherwise("moved_review")
    return audit.planned(rows.withColumn("new_path", F.when(~F.col("weak"), F.col("new_path"))), kind)  # a weak match is the missing file


@query(f"+ {PLAN} SELECT action, risk, count(*) AS n FROM p GROUP BY 1, 2", "pairs")
def action_counts(spark, sf_dir):
    return plan(spark, sf_dir).groupBy("action", "risk").agg(F.count("*").alias("n"))


def checked(spark, sf_dir):
    return audit.checked_plan(plan(spark, sf_dir), view(spark, sf_dir, "pairs").where("id % 10 <> 3").select(F.col("new_path").alias("filepath")))


@query(f"+ {PLAN} SELECT id, action, array_to_string(issues, ',') AS issues, CASE WHEN len(list_intersect(issues, ['missing_old_path','missing_new_path','new_path_not_found','new_path_used_twice'])) > 0 THEN 'blocked' WHEN len(issues) > 0 THEN 'warning' ELSE 'ok' END AS verdict FROM c", "pairs")
def checked_plan(spark, sf_dir):
    return checked(spark, sf_dir).select("id", "action", F.array_join("issues", ",").alias("issues"), "verdict")


@query(f"+ {PLAN} SELECT reason, count(*) AS n FROM (SELECT unnest(issues) AS reason FROM c) GROUP BY 1", "pairs")
def plan_reasons(spark, sf_dir):
    return audit.reasons(checked(spark, sf_dir))


@query("+ m AS (SELECT old_path, min(new_path) AS new_path FROM v_pairs WHERE id % 2 = 0 GROUP BY 1) SELECT id, r.old_path, m.new_path, m.new_path IS NOT NULL AS resolved FROM v_pairs r LEFT JOIN m USING (old_path)", "pairs")
def reference_renames(spark, sf_dir):
    rows = view(spark, sf_dir, "pairs")
    return audit.references(rows.select("id", F.col("old_path").alias("filepath")), rows.where("id % 2 = 0"))


@query("""+ e AS (SELECT filepath FROM v_tracks UNION ALL SELECT CASE WHEN id % 2 = 0 THEN substr(old_path, 2) ELSE replace(old_path, '/lib/', '/lib/./') END FROM v_pairs)
  SELECT DISTINCT unnest([filepath, replace(CASE WHEN starts_with(filepath, '/') THEN filepath ELSE '/top/' || filepath END, '/./', '/')]) AS path FROM e""", "tracks", "pairs")
def canonical_paths(spark, sf_dir):
    p = F.when(F.col("id") % 2 == 0, F.col("old_path").substr(2, 1000)).otherwise(F.replace("old_path", F.lit("/lib/"), F.lit("/lib/./")))
    return audit.canonical_paths(tracks(spark, sf_dir), view(spark, sf_dir, "pairs").select(p.alias("filepath")), root="/top")


#: Files that were moved as they are, every second of them to two places, and files without a token or of another size.
PLACED = f"""+ f AS (SELECT id, filepath, filesize_bytes AS size FROM v_tracks UNION ALL SELECT id + 100000000, '/bak' || filepath, filesize_bytes FROM v_tracks WHERE id % 40 = 0),
  old AS (SELECT id, CASE WHEN id % 60 = 0 THEN '/old/x.mp3' ELSE '/old' || filepath END AS filepath, CASE id % 100 WHEN 0 THEN NULL WHEN 20 THEN filesize_bytes * 2 ELSE filesize_bytes END AS size FROM v_tracks WHERE id % 20 = 0),
  o AS (SELECT *, regexp_extract(filepath,'\\.([a-z0-9]+)$',1) AS ext, {TOKENS} AS tok FROM old), n AS (SELECT *, regexp_extract(filepath,'\\.([a-z0-9]+)$',1) AS ext, {TOKENS} AS tok FROM f),
  p AS (SELECT o.id AS old_id, n.id AS new_id, o.filepath AS old_path, n.filepath AS new_path, o.ext = n.ext AS same, {PAIRED} FROM o JOIN n ON o.filepath <> n.filepath)"""


def placed(spark, sf_dir):
    rows = tracks(spark, sf_dir).select("id", "filepath", "filesize_bytes")
    new = rows.unionByName(rows.where("id % 40 = 0").select((F.col("id") + 100000000).alias("id"), F.concat(F.lit("/bak"), "filepath").alias("filepath"), "filesize_bytes"))
    size = F.when(F.col("id") % 100 == 0, None).when(F.col("id") % 100 == 20, F.col("filesize_bytes") * 2).otherwise(F.col("filesize_bytes"))
    path = F.when(F.col("id") % 60 == 0, "/old/x.mp3").otherwise(F.concat(F.lit("/old"), "filepath"))
    return rows.where("id % 20 = 0").withColumns({"filepath": path, "filesize_bytes": size}), new


@query(f"""{PLACED}, v_pairs AS (SELECT old_id, new_id, old_path, new_path, overlap, off, {SCORE} AS score FROM p WHERE {SCORE} > 0 QUALIFY row_number() OVER (PARTITION BY old_id ORDER BY {SCORE} DESC, new_path, new_id) <= 5), {TIERED}
  SELECT old_id, new_id, score, CASE WHEN tier = 'AUTO_SAFE_CANDIDATE' AND count(*) FILTER (tier = 'AUTO_SAFE_CANDIDATE') OVER (PARTITION BY old_id) > 1 THEN 'REVIEW_CAREFULLY' ELSE tier END AS review_tier FROM t""", "tracks")  # fmt: skip
def orphan_tiers(spark, sf_dir):
    old, new = placed(spark, sf_dir)
    return audit.tiered(resolution.moved_candidates(old, new), old, new).select("old_id", "new_id", "score", "review_tier")


@query(f"{PLACED}, b AS (SELECT old_id, max(overlap) AS overlap FROM p WHERE same GROUP BY 1) SELECT least, (SELECT count(*) FROM b WHERE overlap >= least) AS n FROM (VALUES (0.5e0), (0.6e0), (0.7e0)) AS x(least)", "tracks")
def orphan_overlaps(spark, sf_dir):
    return audit.overlap_counts(resolution.best_overlaps(*placed(spark, sf_dir)))


@query("""+ m AS (SELECT old_path, min(new_path) AS new_path FROM v_pairs WHERE id % 2 = 0 GROUP BY 1), r AS (SELECT id, r.old_path, m.new_path FROM v_pairs r LEFT JOIN m USING (old_path)),
  a AS (SELECT 'stale_state' AS kind, 'mark_stale' AS action, 'low' AS risk, id, filepath AS old_path, CAST(NULL AS VARCHAR) AS new_path FROM v_tracks WHERE status = 'stale' UNION ALL SELECT 'stale_reference', 'update_reference', 'low', id, old_path, new_path FROM r WHERE new_path IS NOT NULL
    UNION ALL SELECT 'unresolved_reference', 'review_reference', 'high', id, old_path, new_path FROM r WHERE new_path IS NULL UNION ALL SELECT 'odd', 'review', 'high', id, filepath, NULL FROM v_tracks WHERE status = 'error')
  SELECT * FROM a""", "tracks", "pairs")  # fmt: skip
def joined_actions(spark, sf_dir):
    rows, found = tracks(spark, sf_dir), reference_renames(spark, sf_dir)
    states = {status: rows.where(F.col("status") == status).select("id", F.col("filepath").alias("old_path"), F.lit(None).cast("string").alias("new_path")) for status in ("stale", "error")}
    return audit.actions({"stale_state": states["stale"], "stale_reference": found.where("resolved"), "unresolved_reference": found.where("NOT resolved"), "odd": states["error"]})
