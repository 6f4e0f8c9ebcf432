"""Queries of series, ordered groups, look-ups and exports with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeshelf.functions import scoring
from lakeshelf.operators import series
from lakeshelf.plans.catalogue import energy_sql, query, rank_sql, tracks
from lakeshelf.plans.views import view
from lakeshelf.sources import files


@query("SELECT id, filepath FROM v_tracks WHERE id = 77", "tracks")
def track_by_id(spark, sf_dir):
    return series.look_up(tracks(spark, sf_dir), "id", 77).select("id", "filepath")


@query("SELECT id, filepath, CAST(NULL AS VARCHAR) AS album, artist AS performer FROM v_tracks", "tracks")
def tolerant_rows(spark, sf_dir):
    schema = StructType.fromDDL("id long, filepath string, album string, performer string")
    return files.tolerant(tracks(spark, sf_dir), schema, {"performer": "artist"})


FRAMES = "f AS (SELECT s.set_id AS id, s.position * 0.7e0 AS sec, s.play_sec AS level, 100e0 + s.set_id % 60 AS bpm, count(*) OVER (PARTITION BY s.set_id) AS n FROM v_set_tracks s)"


def frames(spark, sf_dir):
    rows = view(spark, sf_dir, "set_tracks")
    n = rows.groupBy("set_id").agg(F.count("*").alias("n"))
    return rows.join(n, "set_id").select(F.col("set_id").alias("id"), (F.col("position") * 0.7).alias("sec"), F.col("play_sec").alias("level"), (100.0 + F.col("set_id") % 60).alias("bpm"), "n")


@query(f"+ {FRAMES} SELECT id, CAST(floor(sec / (240e0 / bpm)) AS BIGINT) AS bar, round(avg(level), 9) AS mean, count(*) AS n FROM f GROUP BY 1, 2", "set_tracks")
def bar_means(spark, sf_dir):
    return series.bars(frames(spark, sf_dir), "id", "sec", "level", "bpm").withColumn("mean", F.round("mean", 9))


@query(f"+ {FRAMES} SELECT id, round(sec, 9) AS sec, level FROM f WHERE sec >= 1 AND sec < 0.85e0 * n * 0.7e0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY level, sec) = 1", "set_tracks")
def quietest_frames(spark, sf_dir):
    rows = series.quietest_after(frames(spark, sf_dir), "id", "sec", "level", F.lit(1.0), 0.85 * F.col("n") * 0.7)
    return rows.withColumn("sec", F.round("sec", 9))


@query("""+ w AS (SELECT id % 50 AS song, CASE id % 4 WHEN 0 THEN 'no tempo' WHEN 1 THEN 'bpm ' || CAST(bpm AS VARCHAR) ELSE CAST(bpm AS VARCHAR) || ' at 3' END AS line FROM v_tracks WHERE bpm IS NOT NULL), n AS (SELECT song, try_cast(regexp_extract(line, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS x FROM w)
  SELECT song, median(x) AS bpm, count(*) AS n FROM n WHERE x > 20 AND x < 400 GROUP BY 1""", "tracks")
def median_tempos(spark, sf_dir):
    k, bpm = F.col("id") % 4, F.col("bpm").cast("string")
    line = F.when(k == 0, "no tempo").when(k == 1, F.concat(F.lit("bpm "), bpm)).otherwise(F.concat(bpm, F.lit(" at 3")))
    return series.median_tempo(tracks(spark, sf_dir).where("bpm IS NOT NULL").select((F.col("id") % 50).alias("song"), line.alias("line")), "song", "line")


@query("SELECT coalesce(avg(CASE WHEN duration_sec <> 0 THEN duration_sec END), 360) AS mean FROM v_tracks", "tracks")
def mean_duration(spark, sf_dir):
    return series.mean_duration(tracks(spark, sf_dir))


@query("+ g AS (SELECT genre, count(*) AS n FROM v_tracks WHERE genre IS NOT NULL GROUP BY 1) SELECT genre, n, CAST(row_number() OVER (ORDER BY CASE genre WHEN 'Tech House' THEN 1 WHEN 'Amapiano' THEN 2 ELSE 3 END, genre) AS INT) AS place FROM g", "tracks")
def genre_order(spark, sf_dir):
    rows = tracks(spark, sf_dir).where("genre IS NOT NULL").groupBy("genre").agg(F.count("*").alias("n"))
    return series.placed(rows, "genre", ["Tech House", "Amapiano"])


@query("SELECT id, state FROM v_jobs ORDER BY id DESC LIMIT 40", "jobs")
def log_tail(spark, sf_dir):
    return series.last_lines(view(spark, sf_dir, "jobs").select("id", "state"), 40)


@query("SELECT id FROM v_tracks WHERE duration_sec >= 30 AND (contains(lower(coalesce(artist,'')), 'brand#1') OR contains(lower(coalesce(title,'')), 'brand#1') OR contains(lower(regexp_extract(filepath, '([^/]*)\\.[^.]*$', 1)), 'brand#1')) ORDER BY id LIMIT 60", "tracks")
def text_filter(spark, sf_dir):
    return series.matching_tracks(tracks(spark, sf_dir), "Brand#1", n=60).select("id")


GENRE = "array_to_string(list_transform(string_split(lower(trim(regexp_replace(regexp_replace(regexp_extract(trim(coalesce(genre,'')), '^([^,;/|]*)', 1), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g'))), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(f"SELECT 'normalised' AS kind, {GENRE} AS genre, count(*) AS n FROM v_tracks GROUP BY 2 HAVING {GENRE} <> '' UNION ALL SELECT 'raw', trim(genre), count(*) FROM v_tracks WHERE trim(genre) <> '' GROUP BY 2", "tracks")
def genre_exports(spark, sf_dir):
    return series.genre_exports(tracks(spark, sf_dir))


@query("SELECT substr(CAST(processed_at AS VARCHAR), 1, 10) AS run, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status NOT IN ('success', 'error') OR status IS NULL) AS other FROM v_states GROUP BY 1", "states")
def run_counters(spark, sf_dir):
    return series.run_counters(view(spark, sf_dir, "states"), F.substring(F.col("processed_at").cast("string"), 1, 10), ["success", "error"])


@query("""+ c AS (SELECT count(*) FILTER (bpm IS NULL) AS a, count(*) FILTER (key_camelot IS NULL) AS b, 0 AS c, count(*) FILTER (title IS NULL) AS d, count(*) FILTER (status = 'needs_review') AS e, count(*) FILTER (bitrate_kbps < 128) AS f FROM v_tracks),
  l AS (SELECT unnest([{'k': 1, 'action': 'analyze-missing', 'n': a}, {'k': 2, 'action': 'harmonic-keys', 'n': b}, {'k': 3, 'action': 'parse-filenames', 'n': c}, {'k': 4, 'action': 'repair-metadata', 'n': d}, {'k': 5, 'action': 'review-queue', 'n': e}, {'k': 6, 'action': 'quality-audit', 'n': f}]) AS x FROM c)
  SELECT CAST(row_number() OVER (ORDER BY x.k) AS INT) AS place, x.action AS action, x.n AS n FROM l WHERE x.n > 0 ORDER BY 1 LIMIT 4""", "tracks")
def recommended_actions(spark, sf_dir):
    counts = tracks(spark, sf_dir).agg(
        F.count_if(F.col("bpm").isNull()).alias("missing_bpm"), F.count_if(F.col("key_camelot").isNull()).alias("missing_key"), F.lit(0).alias("missing_artist"), F.count_if(F.col("title").isNull()).alias("missing_title"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"), F.count_if(F.col("bitrate_kbps") < 128).alias("low_quality"),
    )
    return series.recommended(counts)


ENERGY = energy_sql("bpm", "genre", True)


@query(f"""+ e AS (SELECT id, bpm, {rank_sql(ENERGY)} AS r FROM v_tracks) SELECT id, CASE WHEN r <= 1 THEN 0.6e0 ELSE 1e0 END AS up, CASE WHEN r >= 1 THEN 0.6e0 ELSE 1e0 END AS down, CASE WHEN r <> 1 THEN 0.7e0 ELSE 1e0 END AS maintain,
  CASE WHEN bpm > 0 AND id % 3 = 0 THEN bpm WHEN id % 2 = 0 THEN 90e0 ELSE bpm END AS value, CASE WHEN bpm > 0 AND id % 3 = 0 THEN 'stored' WHEN id % 2 = 0 THEN 'tag' WHEN bpm > 0 THEN 'detected' END AS origin, CASE WHEN bpm IS NULL THEN 0e0 ELSE least(1e0, greatest(0e0, bpm / 100)) END AS clamped FROM e""", "tracks")  # fmt: skip
def biased_scores(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    energy = scoring.energy_of(F.col("bpm"), F.col("genre"), mixing=True)
    rank = F.when(energy == "Chill", 0).when(energy == "Peak", 2).otherwise(1)
    known = scoring.first_known(F.when(F.col("id") % 3 == 0, F.col("bpm")), F.when(F.col("id") % 2 == 0, 90.0), F.col("bpm"))
    biased = [scoring.direction_bias(F.lit(1.0), F.lit(1), rank, d).alias(d) for d in ("up", "down", "maintain")]
    return rows.select("id", *biased, known["value"].alias("value"), known["origin"].alias("origin"), scoring.clamped((F.col("bpm") / 100).cast("string")).alias("clamped"))
