"""Queries of review queues, candidate matching and names with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshelf.functions import text
from lakeshelf.operators import matching, review
from lakeshelf.plans.catalogue import query, tracks
from lakeshelf.plans.parsing import COMPARED, VALID_ARTIST, VALID_TITLE, Template, quoted
from lakeshelf.plans.views import view


@query("""SELECT count(*) AS total, count(*) FILTER (status = 'approved') AS n_approved, count(*) FILTER (status = 'rejected') AS n_rejected, count(*) FILTER (status = 'deferred') AS n_deferred, count(*) FILTER (status = 'applied') AS n_applied,
  count(*) FILTER (status = 'no_op') AS n_no_op, count(*) FILTER (upper(confidence) = 'HIGH') AS n_high, count(*) FILTER (upper(confidence) = 'MEDIUM') AS n_medium, count(*) FILTER (upper(confidence) = 'LOW') AS n_low,
  count(*) FILTER (status IN ('approved','rejected','applied','no_op')) AS decided, greatest(0, count(*) - count(*) FILTER (status IN ('approved','rejected','applied','no_op'))) AS pending FROM v_queue""", "queue")
def queue_summary(spark, sf_dir):
    return review.queue_summary(view(spark, sf_dir, "queue"))


@query("""SELECT 'status' AS dimension, status AS value, count(*) AS n FROM v_queue GROUP BY 2 UNION ALL SELECT 'confidence', upper(confidence), count(*) FROM v_queue WHERE upper(confidence) IN ('HIGH','MEDIUM') GROUP BY 2
  UNION ALL SELECT 'rejected', coalesce(reason, 'unspecified'), count(*) FROM v_queue WHERE status = 'rejected' GROUP BY 2""", "queue")
def review_counts(spark, sf_dir):
    return review.review_counts(view(spark, sf_dir, "queue").withColumnRenamed("status", "review_status"))


@query("""+ q AS (SELECT *, coalesce((SELECT min(id) FROM v_tracks t WHERE t.filepath = q.filepath), (SELECT min(id) FROM v_tracks t WHERE t.filepath = '/lib' || q.filepath)) AS tid FROM v_queue q)
  SELECT q.item_id, t.id AS track_id, t.artist, t.title, proposed_artist, proposed_title, CASE WHEN t.id IS NOT NULL AND t.artist IS NOT DISTINCT FROM proposed_artist AND t.title IS NOT DISTINCT FROM proposed_title THEN 'no_op' ELSE coalesce(review_status, 'pending') END AS review_status
  FROM q LEFT JOIN v_tracks t ON t.id = q.tid LEFT JOIN v_reviews r ON r.item_id = t.id""", "queue", "tracks", "reviews")
def queue_view(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    one = rows.groupBy("filepath").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "filepath"]), "id").alias("t")).select("filepath", "t.*")
    return review.queue_view(view(spark, sf_dir, "queue"), one, view(spark, sf_dir, "reviews"), "/lib")


PLANNED = f"""+ u AS (SELECT * FROM v_tracks QUALIFY count(*) OVER (PARTITION BY filepath) = 1), q AS (SELECT * FROM v_queue WHERE status = 'approved'), j AS (SELECT q.*, CASE WHEN a.id IS NOT NULL THEN a.id ELSE b.id END AS tid, a.id IS NOT NULL OR b.id IS NOT NULL AS found FROM q LEFT JOIN u a ON a.id = q.track_id LEFT JOIN u b ON b.filepath = q.filepath),
  k AS (SELECT j.*, t.filepath AS t_path, t.artist AS t_artist, t.title AS t_title, t.genre AS t_genre FROM j LEFT JOIN u t ON t.id = j.tid),
  c AS (SELECT *, list_filter([CASE WHEN trim(coalesce(t_artist,'')) = '' AND trim(proposed_artist) <> '' THEN 'artist' END, CASE WHEN trim(coalesce(t_title,'')) = '' THEN 'title' END, CASE WHEN trim(coalesce(t_genre,'')) = '' AND proposed_genre IS NOT NULL THEN 'genre' END], lambda x: x IS NOT NULL) AS fields FROM k),
  o AS (SELECT *, CASE WHEN filepath = '' THEN 'missing_filepath' WHEN item_id % 370 = 0 THEN 'missing_best_match' WHEN upper(confidence) <> 'HIGH' THEN 'confidence_not_high' WHEN trim(proposed_artist) = '' THEN 'empty_best_match'
    WHEN NOT ({VALID_ARTIST.of('proposed_artist')} AND {VALID_TITLE.of('proposed_title')}) THEN 'suspicious_mismatch' WHEN NOT found THEN 'track_missing_from_tracks' WHEN t_path <> filepath OR coalesce(tid <> track_id, false) THEN 'suspicious_mismatch' WHEN len(fields) = 0 THEN 'no_missing_fields' ELSE 'apply' END AS outcome FROM c)
  SELECT item_id, tid AS track_id, outcome, CASE WHEN outcome = 'apply' THEN array_to_string(fields, ',') ELSE '' END AS fields FROM o"""


@query(PLANNED, "queue", "tracks")
def apply_plan(spark, sf_dir):
    rows, q = tracks(spark, sf_dir), view(spark, sf_dir, "queue").withColumnRenamed("status", "review_status")
    unique = rows.join(rows.groupBy("filepath").agg(F.count("*").alias("n")).where("n = 1").drop("n"), "filepath")
    match = F.when(F.col("item_id") % 370 != 0, F.struct(*[F.col(f"proposed_{c}").alias(c) for c in ("artist", "title", "genre")]))
    plan = review.apply_plan(q.withColumn("match", match), unique, ["artist", "title", "genre"])
    return plan.select("item_id", "track_id", "outcome", F.array_join(F.transform("changes", lambda x: x["field"]), ",").alias("fields"))


@query("""+ a AS (SELECT id, bpm, CASE id % 5 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'ignored' WHEN 2 THEN 'requeued' WHEN 3 THEN 'resolved' ELSE 'pending' END AS st FROM v_tracks WHERE id % 2 = 0), b AS (SELECT id, bpm * 2 AS bpm FROM v_tracks WHERE id % 3 = 0)
  SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.bpm ELSE a.bpm END AS bpm, CASE WHEN b.id IS NOT NULL THEN CASE WHEN st IN ('reviewed','ignored','requeued') THEN st ELSE 'pending' END WHEN st IN ('reviewed','ignored') THEN st ELSE 'resolved' END AS review_status,
    CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NOT NULL THEN 'refreshed' WHEN st IN ('requeued','pending') THEN 'resolved' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.id = b.id""", "tracks")
def kept_decisions(spark, sf_dir):
    rows, k = tracks(spark, sf_dir), F.col("id") % 5
    status = F.when(k == 0, "reviewed").when(k == 1, "ignored").when(k == 2, "requeued").when(k == 3, "resolved").otherwise("pending")
    return review.keep_decisions(rows.where("id % 2 = 0").select("id", "bpm", status.alias("review_status")), rows.where("id % 3 = 0").select("id", (F.col("bpm") * 2).alias("bpm")), "id", ["bpm"])


UPDATES = """+ u AS (SELECT CASE WHEN id % 44 = 0 THEN id + 100000000 ELSE id END AS id, CASE WHEN id % 8 = 0 THEN filepath WHEN id % 12 = 0 THEN '/same' WHEN id % 20 = 0 THEN (SELECT min(filepath) FROM v_tracks) ELSE '/new' || filepath || id END AS new_path FROM v_tracks WHERE id % 4 = 0),
  n AS (SELECT new_path, count(*) AS n FROM u GROUP BY 1), o AS (SELECT u.id, CASE WHEN t.id IS NULL THEN 'not_found' WHEN t.status = 'stale' THEN 'stale' WHEN u.new_path = t.filepath THEN 'unchanged' WHEN u.new_path IN (SELECT filepath FROM v_tracks) OR n > 1 THEN 'collision' ELSE 'updated' END AS outcome FROM u JOIN n USING (new_path) LEFT JOIN v_tracks t ON t.id = u.id)"""


def outcomes(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    first = rows.agg(F.min("filepath").alias("first"))  # one row
    k = F.col("id")
    path = F.when(k % 8 == 0, F.col("filepath")).when(k % 12 == 0, "/same").when(k % 20 == 0, F.col("first")).otherwise(F.concat(F.lit("/new"), "filepath", k.cast("string")))
    return review.path_updates(rows, rows.where("id % 4 = 0").join(F.broadcast(first)).select(F.when(k % 44 == 0, k + 100000000).otherwise(k).alias("id"), path.alias("new_path")))


@query(UPDATES + "SELECT id, outcome FROM o", "tracks")
def path_updates(spark, sf_dir):
    return outcomes(spark, sf_dir)


@query(UPDATES + "SELECT id, outcome, outcome = 'updated' AND NOT EXISTS (SELECT 1 FROM o WHERE outcome = 'not_found' AND id < 0) AS applied FROM o WHERE outcome <> 'not_found' UNION ALL SELECT -id, outcome, false FROM o", "tracks")
def batch_apply(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    whole = review.all_or_nothing(rows, ["not_found"]).withColumn("id", -F.col("id"))
    return review.all_or_nothing(rows.where("outcome <> 'not_found'"), ["not_found"]).unionByName(whole)


@query("""+ m AS (SELECT item_id, status AS now, CASE item_id % 70 WHEN 0 THEN 'approved' WHEN 10 THEN 'pending' WHEN 20 THEN 'nonsense' WHEN 30 THEN 'applied' WHEN 40 THEN 'deferred' WHEN 50 THEN 'rejected' END AS wanted FROM v_queue),
  o AS (SELECT *, CASE WHEN wanted IS NULL THEN 'kept' WHEN wanted = 'nonsense' THEN 'unknown_state' WHEN (now, wanted) IN (('pending','approved'),('pending','rejected'),('pending','deferred'),('deferred','approved'),('deferred','rejected'),('deferred','pending'),('approved','applied'),('approved','rejected'),('approved','pending'),('rejected','pending'),('rejected','approved')) THEN 'changed' ELSE 'not_allowed' END AS outcome FROM m)
  SELECT item_id, CASE WHEN outcome = 'changed' THEN wanted ELSE now END AS review_status, outcome FROM o""", "queue")
def mutated_reviews(spark, sf_dir):
    rows, k = view(spark, sf_dir, "queue"), F.col("item_id") % 70
    wanted = F.when(k == 0, "approved").when(k == 10, "pending").when(k == 20, "nonsense").when(k == 30, "applied").when(k == 40, "deferred").when(k == 50, "rejected")
    return review.mutated(rows.withColumnRenamed("status", "review_status"), rows.select("item_id", wanted.alias("wanted")).where("wanted IS NOT NULL"))


@query("SELECT track_id, max(id) AS id, count(*) AS n FROM v_states GROUP BY 1", "states")
def latest_history(spark, sf_dir):
    return review.latest_of_path(view(spark, sf_dir, "states"))


@query("SELECT track_id, id, stage AS before FROM v_states WHERE status <> 'stale' QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY id DESC) = 1", "states")
def rollback_plan(spark, sf_dir):
    rows = view(spark, sf_dir, "states").withColumn("rolled_back", F.col("status") == "stale").withColumnRenamed("stage", "before")
    return review.rollback_plan(rows)


@query("SELECT id FROM v_states WHERE NOT coalesce(CASE id % 3 WHEN 0 THEN 'rules:v6 ok' WHEN 1 THEN 'rules:v5' END LIKE 'rules:v6%', false)", "states")
def outdated_rules(spark, sf_dir):
    reason = F.when(F.col("id") % 3 == 0, "rules:v6 ok").when(F.col("id") % 3 == 1, "rules:v5")
    return review.outdated(view(spark, sf_dir, "states").withColumn("reason", reason), "rules:v6").select("id")


@query("SELECT job, arg_max(state, (since, id)) AS state, min(since) AS begun, CASE WHEN arg_max(state, (since, id)) IN ('succeeded','failed','cancelled') THEN max(since) END AS ended FROM v_jobs WHERE state <> 'other' GROUP BY 1", "jobs")
def job_states(spark, sf_dir):
    return review.job_states(view(spark, sf_dir, "jobs"))


TERM = Template(f"lower(regexp_extract(§, {quoted(matching.BRACKET)}, 1))")
DECIDED = f"""+ s AS (SELECT *, coalesce(upper(trim(isrc)) = upper(trim(c_isrc)) AND isrc <> '', false) AS code, {TERM.of('title')} AS v, {TERM.of('c_title')} AS cv FROM v_candidates),
  w AS (SELECT *, CASE WHEN version_sim = 0 AND (v = '') <> (cv = '') AND title_sim >= 0.95 AND artist_sim >= 0.85 THEN 0.7e0 ELSE version_sim END AS vs FROM s),
  c AS (SELECT *, CASE WHEN code THEN 0.98e0 ELSE least(1e0, title_sim * 0.5e0 + artist_sim * 0.3e0 + vs * 0.2e0 + (CASE WHEN label_sim >= 0.7 THEN 0.05e0 ELSE 0e0 END + CASE WHEN same_alias THEN 0.05e0 ELSE 0e0 END)) END AS conf FROM w),
  a AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY code DESC, conf DESC, candidate) = 1),
  g AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY code DESC, conf DESC, candidate) AS k FROM c WHERE title_sim >= 0.92),
  r AS (SELECT track_id, max(conf) AS runner_up FROM g WHERE k > 1 GROUP BY 1),
  d AS (SELECT a.track_id, a.code AS sure, a.candidate AS ac, a.conf AS aconf, g.candidate AS gc, g.conf AS gconf, runner_up, CASE WHEN a.code THEN 'ready' WHEN g.candidate IS NULL THEN 'skipped_low_score' WHEN g.artist_sim < 0.85 THEN 'skipped_artist_mismatch' WHEN g.v <> '' AND g.cv <> '' AND g.v <> g.cv THEN 'skipped_version_conflict'
    WHEN g.conf - runner_up < 0.05 AND g.conf >= 0.75 THEN 'review_ambiguous' WHEN g.conf < 0.75 THEN 'skipped_low_score' WHEN g.conf >= 0.9 THEN 'ready' ELSE 'review' END AS decision FROM a LEFT JOIN g ON g.track_id = a.track_id AND g.k = 1 LEFT JOIN r ON r.track_id = a.track_id),
  f AS (SELECT *, CASE WHEN sure OR gc IS NULL THEN ac ELSE gc END AS candidate, CASE WHEN sure OR gc IS NULL THEN aconf ELSE gconf END AS conf FROM d)
  SELECT track_id, candidate, round(CASE WHEN decision IN ('skipped_artist_mismatch','skipped_version_conflict') THEN least(conf, 0.74e0) ELSE conf END, 9) AS confidence, round(runner_up, 9) AS runner_up, decision FROM f"""


@query(DECIDED, "candidates")
def match_decisions(spark, sf_dir):
    rows = matching.decisions(matching.scored(view(spark, sf_dir, "candidates")))
    return rows.withColumns({c: F.round(c, 9) for c in ("confidence", "runner_up")})


ALIASES = "a AS (SELECT DISTINCT CASE id % 3 WHEN 0 THEN artist WHEN 1 THEN upper(artist) ELSE 'The ' || artist || '!' END AS alias, 'C' || artist AS canonical FROM v_names WHERE artist IS NOT NULL AND id % 4 <> 0)"


@query(f"""+ {ALIASES}, e AS (SELECT alias, min(canonical) AS c FROM a GROUP BY 1), n AS (SELECT {COMPARED.of('alias')} AS k, min(canonical) AS c FROM a GROUP BY 1 HAVING k <> ''), l AS (SELECT lower(alias) AS k, min(canonical) AS c FROM a GROUP BY 1)
  SELECT id, artist AS name, coalesce(e.c, n.c, l.c, artist) AS canonical, CASE WHEN e.c IS NOT NULL THEN 'exact' WHEN n.c IS NOT NULL THEN 'normalised' WHEN l.c IS NOT NULL THEN 'case' ELSE 'none' END AS method
  FROM v_names LEFT JOIN e ON e.alias = artist LEFT JOIN n ON n.k = {COMPARED.of('artist')} LEFT JOIN l ON l.k = lower(artist) WHERE artist IS NOT NULL""", "names")  # fmt: skip
def aliases_resolved(spark, sf_dir):
    rows, artist, k = view(spark, sf_dir, "names").where("artist IS NOT NULL"), F.col("artist"), F.col("id") % 3
    alias = F.when(k == 0, artist).when(k == 1, F.upper(artist)).otherwise(F.concat(F.lit("The "), artist, F.lit("!")))
    aliases = rows.where("id % 4 <> 0").select(alias.alias("alias"), F.concat(F.lit("C"), artist).alias("canonical")).distinct()
    return matching.aliases_resolved(rows.select("id", artist.alias("name")), aliases)


@query(f"""+ x AS (SELECT id, replace({COMPARED.of('artist')}, ' ', '') AS v FROM v_names WHERE id % 20 = 0), y AS (SELECT id, replace({COMPARED.of("CASE id % 2 WHEN 0 THEN artist ELSE 'DJ ' || artist || ' Records' END")}, ' ', '') AS v FROM v_names)
  SELECT x.id AS left_id, y.id AS right_id FROM x, y WHERE x.v <> '' AND y.v <> '' AND (contains(x.v, y.v) OR contains(y.v, x.v))""", "names")  # fmt: skip
def containing_names(spark, sf_dir):
    rows, artist = view(spark, sf_dir, "names"), F.col("artist")
    other = F.when(F.col("id") % 2 == 0, artist).otherwise(F.concat(F.lit("DJ "), artist, F.lit(" Records")))
    return matching.containing(rows.where("id % 20 = 0").select("id", artist.alias("name")), rows.select("id", other.alias("name")))


@query("""+ f AS (SELECT artist, genre, min(id) AS first_id FROM v_tracks WHERE coalesce(genre, '') <> '' AND artist IS NOT NULL GROUP BY 1, 2) SELECT artist, string_agg(genre, '|' ORDER BY first_id) AS merged FROM f GROUP BY 1""", "tracks")
def merged_genres(spark, sf_dir):
    rows = matching.merged_values(tracks(spark, sf_dir).where("artist IS NOT NULL"), "artist", "id", "genre")
    return rows.select("artist", F.array_join("merged", "|").alias("merged"))


@query("""+ n AS (SELECT id, CASE id % 3 WHEN 0 THEN upper(title) ELSE title END AS name FROM v_tracks WHERE title IS NOT NULL), k AS (SELECT *, lower(split_part(name, ' ', 1)) AS key FROM n)
  SELECT key, arg_min(name, (CASE WHEN name = upper(name) AND name <> lower(name) THEN 1 ELSE 0 END, -length(name), id)) AS best, count(DISTINCT name) AS n FROM k GROUP BY 1""", "tracks")
def best_names(spark, sf_dir):
    name = F.when(F.col("id") % 3 == 0, F.upper("title")).otherwise(F.col("title"))
    rows = tracks(spark, sf_dir).where("title IS NOT NULL").select("id", name.alias("name"))
    return matching.best_names(rows, F.lower(F.split("name", " ")[0]), "name", "id")


HINT = "CASE " + " ".join(f"WHEN contains(g, '{g}') THEN {{{k}}}" for k, g in enumerate(x[0] for x in matching.HINTS)) + " END"
LEAST, GREATEST = (HINT.format(*(x[k] for x in matching.HINTS)) for k in (1, 2))


@query(f"""+ h AS (SELECT id, lower(concat_ws(' ', replace(genre, '-', ' '), 'x')) AS g FROM v_tracks), r AS (SELECT *, {LEAST} AS least, {GREATEST} AS greatest FROM h), m AS (SELECT *, (coalesce(least,0)+coalesce(greatest,0))/2.0 AS mean, contains(g,'organic house') OR contains(g,'deep house') AS calm FROM r)
  SELECT id, least, greatest, CASE WHEN least IS NULL THEN NULL WHEN calm AND mean <= 118 THEN 'warmup' WHEN calm AND mean <= 122 THEN 'groove' WHEN mean >= 126 THEN 'peak' WHEN mean >= 122 THEN 'groove' ELSE 'closing' END AS energy FROM m""", "tracks")  # fmt: skip
def genre_hints(spark, sf_dir):
    genres = F.array_compact(F.array(F.replace("genre", F.lit("-"), F.lit(" ")), F.lit("x")))
    rows = tracks(spark, sf_dir).select("id", genres.alias("g"), matching.tempo_hint(genres).alias("h"))
    return rows.select("id", "h.least", "h.greatest", matching.energy_profile(F.col("g"), F.col("h.least"), F.col("h.greatest")).alias("energy"))


@query()
def match_scores(spark, sf_dir):
    rows = view(spark, sf_dir, "names").where("artist IS NOT NULL").select("id", "stem", "artist", F.col("stem").alias("title"), F.lit("Pool Records").alias("label"))
    other = F.when(F.col("id") % 3 == 0, text.squeezed(F.concat(F.lit("The "), "stem"))).otherwise(F.concat("stem", F.lit(" II")))
    return matching.compared(rows.select("*", F.concat("artist", F.lit(" & Ann")).alias("c_artist"), other.alias("c_title"), F.lit("Pool Recordings").alias("c_label"))).select("id", "title_sim", "artist_sim", "version_sim", "label_sim")

