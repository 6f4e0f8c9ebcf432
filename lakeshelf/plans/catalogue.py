"""Queries over the catalogue views with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshelf.functions import scoring, text
from lakeshelf.operators import catalogue as cat
from lakeshelf.operators import mixing, resolution, state
from lakeshelf.plans.views import view, with_views
from lakeshelf.sources import web

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name, with DuckDB SQL over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


BLANK = "trim(coalesce({0}, '')) = ''"
ISSUES = """list_filter([CASE WHEN bpm IS NULL THEN 'missing_bpm' END, CASE WHEN key_camelot IS NULL THEN 'missing_key' END,
  CASE WHEN trim(coalesce(artist,''))='' THEN 'missing_artist' END, CASE WHEN trim(coalesce(title,''))='' THEN 'missing_title' END,
  CASE WHEN status='error' THEN 'error' END, CASE WHEN status='needs_review' THEN 'needs_review' END,
  CASE WHEN upper(parse_confidence) IN ('MEDIUM','LOW') THEN 'weak_filename_parse' END,
  CASE WHEN lower(trim(artist)) IN ('unknown','unknown artist','va','various artists','various','n/a','none','-','--') THEN 'suspicious_artist' END,
  CASE WHEN regexp_matches(lower(title), 'https?:|www\\.|\\.(?:com|net|org)\\b') THEN 'suspicious_title' END], lambda x: x IS NOT NULL)"""
WHEEL = "try_cast(regexp_extract(upper(trim({0})), '^(1[0-2]|[1-9])[AB]$', 1) AS INT)"
FAST = "regexp_matches(lower(coalesce(genre,'')), 'drum and bass|dnb|jungle|hardcore|gabber|speedcore')"
REASON = f"""CASE WHEN bpm IS NULL OR bpm <= 0 THEN 'missing_bpm' WHEN bpm < 20 THEN 'too_low_10x' WHEN bpm < 90 THEN 'likely_halved'
  WHEN bpm > 240 THEN 'too_high' WHEN bpm > 160 AND NOT {FAST} THEN 'likely_doubled' END"""


def energy_sql(bpm: str, genre: str, mixing_: bool = False) -> str:
    peak = "afro tech|techno|hard techno|rave" if mixing_ else "afro tech|techno|hard techno|industrial techno|peak time techno|rave"
    chill = "deep house|organic house|melodic|downtempo" if mixing_ else "deep house|organic house|melodic house|melodic techno|downtempo|ambient|lo-fi|nu-disco"
    g = f"lower(trim(coalesce({genre},'')))"
    return f"CASE WHEN regexp_matches({g}, '{peak}') THEN 'Peak' WHEN regexp_matches({g}, '{chill}') THEN 'Chill' WHEN coalesce({bpm},0) >= 126 THEN 'Peak' WHEN coalesce({bpm},0) >= 118 THEN 'Mid' WHEN coalesce({bpm},0) > 0 THEN 'Chill' ELSE 'Mid' END"


def key_sql(a: str, b: str) -> str:
    x, y = WHEEL.format(a), WHEEL.format(b)
    d = f"coalesce(least(abs({x}-{y}), 12-abs({x}-{y})), 99)"
    same = f"(right(upper(trim({a})),1) = right(upper(trim({b})),1))"
    return f"CASE WHEN {d}=0 THEN CASE WHEN {same} THEN 1e0 ELSE 0.85e0 END WHEN {d}=1 THEN CASE WHEN {same} THEN 0.9e0 ELSE 0.8e0 END WHEN {d}=2 THEN CASE WHEN {same} THEN 0.55e0 ELSE 0.45e0 END WHEN {d}=3 THEN 0.25e0 ELSE 0.1e0 END"


def tempo_sql(a: str, b: str) -> str:
    off = f"least(abs({b}/{a}-1), abs({b}/{a}*2-1), abs({b}/{a}/2-1))"
    return f"CASE WHEN coalesce({a},0)=0 OR coalesce({b},0)=0 THEN 0.5e0 WHEN {off}<=0.02e0 THEN 0.95e0 WHEN {off}<=0.05e0 THEN 0.82e0 WHEN {off}<=0.08e0 THEN 0.65e0 WHEN {off}<=0.12e0 THEN 0.45e0 WHEN {off}<=0.2e0 THEN 0.25e0 ELSE 0.1e0 END"


def rank_sql(e: str) -> str:
    return f"(CASE {e} WHEN 'Chill' THEN 0 WHEN 'Peak' THEN 2 ELSE 1 END)"


def genre_sql(a: str, b: str) -> str:
    pairs = ", ".join(f"'{p}|{q}'" for p, q in scoring.RELATED_GENRES)
    x, y = (f"lower(trim(coalesce({g},'')))" for g in (a, b))
    return f"CASE WHEN {x}='' OR {y}='' THEN 0.5e0 WHEN {x}={y} THEN 1e0 WHEN concat({x},'|',{y}) IN ({pairs}) OR concat({y},'|',{x}) IN ({pairs}) THEN 0.8e0 ELSE 0.5e0 END"


PAIRED = f"""+ c AS (SELECT *, {energy_sql('bpm', 'genre', True)} AS energy FROM v_tracks),
  n AS (SELECT * FROM c WHERE id = 100),
  p AS (SELECT c.id, c.artist, c.title, c.bpm, c.energy AS e, {key_sql('n.key_camelot', 'c.key_camelot')} AS k, {tempo_sql('n.bpm', 'c.bpm')} AS t,
    CASE abs({rank_sql('n.energy')}-{rank_sql('c.energy')}) WHEN 0 THEN 1e0 WHEN 1 THEN 0.7e0 ELSE 0.35e0 END AS es, {genre_sql('n.genre', 'c.genre')} AS g,
    CASE WHEN coalesce(n.bpm,0)=0 OR c.bpm IS NULL THEN 0e0 ELSE (c.bpm-n.bpm)/n.bpm*100 END AS delta, {rank_sql('c.energy')} > {rank_sql('n.energy')} AS rise
    FROM c, n WHERE c.id <> n.id AND c.status = 'ok')"""
STRATEGY_SQL = {
    "safest": "0.55e0*k+0.45e0*t", "smooth": "0.5e0*k+0.5e0*t", "total": "0.35e0*k+0.3e0*t+0.2e0*es+0.15e0*g",
    "warmup": "least(1e0, 0.4e0*k+0.3e0*t+CASE WHEN e IN ('Chill','Mid') THEN 0.3e0 ELSE 0e0 END)",
    "late": "least(1e0, 0.35e0*k+0.3e0*t+CASE WHEN e='Peak' THEN 0.25e0 ELSE 0e0 END+CASE WHEN coalesce(bpm,0)>=126 THEN 0.1e0 ELSE 0e0 END)",
    "lift": "least(1e0, CASE WHEN k<=0.15e0 THEN least(l,0.25e0) WHEN k<=0.25e0 THEN least(l,0.45e0) ELSE l END)",
}


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tracks")


@query("SELECT count(*) AS total_tracks, count(bpm) AS tracks_with_bpm, count(*) FILTER (trim(coalesce(key_camelot,'')) <> '') AS tracks_with_camelot_key, count(*) FILTER (trim(coalesce(artist,''))='') AS tracks_missing_artist, count(*) FILTER (trim(coalesce(title,''))='') AS tracks_missing_title FROM v_tracks", "tracks")
def overview(spark, sf_dir):
    return cat.overview(tracks(spark, sf_dir))


@query("SELECT coalesce(nullif(trim(parse_confidence),''),'UNKNOWN') AS confidence, count(*) AS n FROM v_tracks GROUP BY 1", "tracks")
def confidence_breakdown(spark, sf_dir):
    rank = F.when(F.col("confidence") == "HIGH", 0).when(F.col("confidence") == "MEDIUM", 1).when(F.col("confidence") == "LOW", 2).otherwise(3)
    return cat.counted(tracks(spark, sf_dir), F.col("parse_confidence"), "confidence").orderBy(rank)


@query("SELECT * FROM (SELECT coalesce(nullif(trim(genre),''),'UNKNOWN') AS genre, count(*) AS n FROM v_tracks GROUP BY 1) ORDER BY n DESC, lower(genre) LIMIT 10", "tracks")
def top_genres(spark, sf_dir):
    return cat.counted(tracks(spark, sf_dir), F.col("genre"), "genre").orderBy(F.desc("n"), F.lower("genre")).limit(10)


@query("SELECT status, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM v_tracks GROUP BY 1", "tracks")
def stats_by_status(spark, sf_dir):
    return cat.distribution(tracks(spark, sf_dir), "status")


@query(f"SELECT issue, count(*) AS n FROM (SELECT unnest({ISSUES}) AS issue FROM v_tracks) GROUP BY 1", "tracks")
def issue_counts(spark, sf_dir):
    return cat.issue_counts(tracks(spark, sf_dir))


SEVERITY_SQL = "list_position(['error','missing_bpm','missing_key','missing_artist','missing_title','needs_review','weak_filename_parse','suspicious_artist','suspicious_title'], issue)"


@query(f"SELECT id, issue FROM (SELECT id, artist, unnest({ISSUES}) AS issue FROM v_tracks) ORDER BY {SEVERITY_SQL}, lower(artist) NULLS FIRST, id LIMIT 200", "tracks")
def issues_ranked(spark, sf_dir):
    return cat.issues_ranked(tracks(spark, sf_dir))


@query("SELECT id, artist, title, bpm FROM v_tracks WHERE status='ok' AND bpm >= 100 AND bpm <= 130 AND key_camelot IS NOT NULL ORDER BY bpm DESC NULLS LAST, title NULLS FIRST, id LIMIT 50 OFFSET 10", "tracks")
def track_page_filtered(spark, sf_dir):
    rows = cat.filtered(tracks(spark, sf_dir), status="ok", bpm_min=100, bpm_max=130, has_key=True)
    return cat.page(rows, "bpm", descending=True, offset=10).select("id", "artist", "title", "bpm")


@query("SELECT id, filepath FROM v_tracks WHERE lower(artist) LIKE '%brand#1%' OR lower(title) LIKE '%brand#1%' OR lower(filepath) LIKE '%brand#1%' ORDER BY artist NULLS FIRST, title NULLS FIRST, id LIMIT 100", "tracks")
def track_page_search(spark, sf_dir):
    return cat.page(cat.filtered(tracks(spark, sf_dir), q="Brand#1"), limit=100).select("id", "filepath")


@query(f"SELECT id, array_to_string({ISSUES}, ',') AS issues FROM v_tracks WHERE list_contains({ISSUES}, 'missing_key') ORDER BY artist NULLS FIRST, title NULLS FIRST, id LIMIT 50", "tracks")
def track_page_issue(spark, sf_dir):
    return cat.page(cat.filtered(tracks(spark, sf_dir), issue="missing_key")).select("id", F.array_join("issues", ",").alias("issues"))


@query("SELECT id FROM v_tracks WHERE starts_with(filepath, '/lib/1/') OR starts_with(filepath, '/lib/2/')", "tracks")
def tracks_under_roots(spark, sf_dir):
    return tracks(spark, sf_dir).where(cat.under(F.col("filepath"), "/lib/1", "/lib/2/")).select("id")


@query(f"SELECT regexp_extract(filepath, '^(.*)/[^/]*$', 1) AS folder, count(*) AS track_count, count(*) FILTER (len({ISSUES}) > 0) AS issue_count FROM v_tracks GROUP BY 1", "tracks")
def folder_stats(spark, sf_dir):
    return cat.folder_stats(tracks(spark, sf_dir))


@query("""+ o AS (SELECT count(*) AS t, count(bpm) AS b, count(*) FILTER (trim(coalesce(key_camelot,''))<>'') AS k, count(*) FILTER (trim(coalesce(artist,''))='') AS a, count(*) FILTER (trim(coalesce(title,''))='') AS i,
  count(*) FILTER (upper(parse_confidence) IN ('MEDIUM','LOW')) AS w, count(*) FILTER (lower(trim(artist)) IN ('unknown','unknown artist','va','various artists','various','n/a','none','-','--')) AS s FROM v_tracks),
  p AS (SELECT CAST(round(100.0*b/t) AS INT) AS bpm_pct, CAST(round(100.0*k/t) AS INT) AS key_pct, CAST(round(100.0*(t-a)/t) AS INT) AS artist_pct, CAST(round(100.0*(t-i)/t) AS INT) AS title_pct,
  100 - (8*CAST(round(100.0*((t-b)+(t-k))/(2*t)) AS INT)/10.0 + 4*CAST(round(100.0*s/t) AS INT)/10.0 + 2*CAST(round(100.0*w/t) AS INT)/10.0) AS z FROM o)
  SELECT bpm_pct, key_pct, artist_pct, title_pct, CAST(greatest(0, least(100, round(z))) AS INT) AS score FROM p""", "tracks")
def coverage(spark, sf_dir):
    return cat.coverage(tracks(spark, sf_dir))


@query(f"SELECT id, bpm, {REASON} AS reason, round(CASE {REASON} WHEN 'too_low_10x' THEN bpm*10 WHEN 'likely_halved' THEN bpm*2 WHEN 'likely_doubled' THEN bpm/2 WHEN 'too_high' THEN bpm/2 END, 1) AS suggested FROM v_tracks WHERE {REASON} IS NOT NULL", "tracks")
def bpm_anomalies(spark, sf_dir):
    return cat.tempo_anomalies(tracks(spark, sf_dir))


@query(f"SELECT {REASON} AS reason, count(*) AS n FROM v_tracks WHERE {REASON} IS NOT NULL GROUP BY 1", "tracks")
def anomaly_summary(spark, sf_dir):
    return cat.tempo_anomalies(tracks(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT id, CASE WHEN m BETWEEN 60 AND 200 THEN m END AS corrected FROM (SELECT id, CASE WHEN bpm < 90 THEN bpm*2 WHEN bpm > 160 AND NOT {FAST} THEN bpm/2 ELSE bpm END AS m FROM v_tracks)", "tracks")
def bpm_corrected(spark, sf_dir):
    return tracks(spark, sf_dir).select("id", scoring.tempo_corrected(F.col("bpm"), F.col("genre")).alias("corrected"))


CODEC_SQL = "CASE regexp_extract(filepath, '\\.([a-z0-9]+)$', 1) WHEN 'm4a' THEN 'aac' WHEN 'wav' THEN 'pcm_s16le' ELSE regexp_extract(filepath, '\\.([a-z0-9]+)$', 1) END"


@query(f"SELECT tier, count(*) AS n, 100.0*count(*)/sum(count(*)) OVER () AS pct FROM (SELECT CASE WHEN c='flac' OR starts_with(c,'pcm_') THEN 'LOSSLESS' WHEN c IN ('mp3','aac') THEN CASE WHEN bitrate_kbps>=256 THEN 'HIGH' WHEN bitrate_kbps>=192 THEN 'MEDIUM' ELSE 'LOW' END ELSE 'UNKNOWN' END AS tier FROM (SELECT *, {CODEC_SQL} AS c FROM v_tracks)) GROUP BY 1", "tracks")
def quality_tiers(spark, sf_dir):
    kind = text.extension(F.col("filepath"))
    codec = F.when(kind == "m4a", "aac").when(kind == "wav", "pcm_s16le").otherwise(kind)
    return cat.distribution(tracks(spark, sf_dir).select(scoring.quality_tier(codec, F.col("bitrate_kbps")).alias("tier")), "tier")


POINTS_SQL = "CASE regexp_extract(filepath, '\\.([a-z0-9]+)$', 1) WHEN 'wav' THEN 100 WHEN 'flac' THEN 90 WHEN 'm4a' THEN 70 WHEN 'mp3' THEN CASE WHEN bitrate_kbps>=320 THEN 80 WHEN bitrate_kbps>=256 THEN 70 WHEN bitrate_kbps>=192 THEN 60 WHEN bitrate_kbps>=128 THEN 50 ELSE 30 END ELSE 50 END"


@query(f"SELECT id, {POINTS_SQL} AS points FROM v_tracks", "tracks")
def quality_rank(spark, sf_dir):
    return tracks(spark, sf_dir).select("id", scoring.quality_points(F.col("filepath"), F.col("bitrate_kbps")).alias("points"))


@query("SELECT id, CASE WHEN coalesce(filesize_bytes,0)<=0 THEN 'empty' WHEN duration_sec<30 THEN 'too_short' WHEN duration_sec>7200 THEN 'too_long' WHEN regexp_extract(filepath,'\\.([a-z0-9]+)$',1) IN ('mp3','m4a','ogg','opus') AND bitrate_kbps>0 AND bitrate_kbps<128 THEN 'low_bitrate' END AS reason FROM v_tracks", "tracks")
def qc_gate(spark, sf_dir):
    return cat.quality_gate(tracks(spark, sf_dir))


def _pairs(spark, sf_dir) -> DataFrame:
    """Each track with the one 7 ids on."""
    rows = tracks(spark, sf_dir)
    other = rows.select((F.col("id") - 7).alias("id"), *[F.col(c).alias(f"b_{c}") for c in ("bpm", "genre", "key_camelot")])
    return rows.join(other, "id")


PAIRS = "+ p AS (SELECT a.*, b.bpm AS b_bpm, b.genre AS b_genre, b.key_camelot AS b_key_camelot FROM v_tracks a JOIN v_tracks b ON b.id = a.id + 7) "


@query(PAIRS + f"SELECT id, {key_sql('key_camelot', 'b_key_camelot')} AS score FROM p", "tracks")
def key_scores(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", scoring.key_score(F.col("key_camelot"), F.col("b_key_camelot")).alias("score"))


@query(PAIRS + f"SELECT id, {tempo_sql('bpm', 'b_bpm')} AS score, CASE WHEN coalesce(bpm,0)=0 OR b_bpm IS NULL THEN 0e0 ELSE (b_bpm-bpm)/bpm*100 END AS delta, CASE WHEN b_bpm IS NULL OR bpm IS NULL OR bpm<=0 OR b_bpm<=0 OR abs(b_bpm-bpm)<=3 THEN 1e0 WHEN abs(b_bpm-bpm)<=6 THEN round(1-0.6e0*(abs(b_bpm-bpm)-3e0)/3e0, 3) ELSE 0.1e0 END AS penalty FROM p", "tracks")
def tempo_scores(spark, sf_dir):
    a, b = F.col("bpm"), F.col("b_bpm")
    return _pairs(spark, sf_dir).select("id", scoring.tempo_score(a, b).alias("score"), scoring.tempo_delta_pct(a, b).alias("delta"), scoring.tempo_step_penalty(a, b).alias("penalty"))


@query(PAIRS + f"SELECT id, CASE abs({rank_sql(energy_sql('bpm', 'genre', True))}-{rank_sql(energy_sql('b_bpm', 'b_genre', True))}) WHEN 0 THEN 1e0 WHEN 1 THEN 0.7e0 ELSE 0.35e0 END AS score FROM p", "tracks")
def energy_pairs(spark, sf_dir):
    a, b = (scoring.energy_of(F.col(f"{p}bpm"), F.col(f"{p}genre"), mixing=True) for p in ("", "b_"))
    return _pairs(spark, sf_dir).select("id", scoring.energy_score(a, b).alias("score"))


@query(PAIRS + f"SELECT id, {genre_sql('genre', 'b_genre')} AS score FROM p", "tracks")
def genre_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", scoring.genre_score(F.col("genre"), F.col("b_genre")).alias("score"))


def _suggest(strategy: str) -> None:
    def suggest(spark, sf_dir):
        rows = tracks(spark, sf_dir)
        return mixing.suggestions(rows, rows.where("id = 100"), strategy).select("id", F.round("score", 9).alias("score"))

    lift = ", x AS (SELECT *, 0.35e0*k+0.30e0*t+0.20e0*es+CASE WHEN delta>1 THEN least(delta/10,0.15e0) ELSE 0e0 END+CASE WHEN rise THEN 0.15e0 ELSE 0e0 END AS l FROM p)"
    suggest.__name__ = f"suggest_next_{strategy}"
    query(f"{PAIRED}{lift} SELECT id, round({STRATEGY_SQL[strategy]}, 9) AS score FROM x ORDER BY {STRATEGY_SQL[strategy]} DESC, artist NULLS FIRST, title NULLS FIRST, id LIMIT 10", "tracks")(suggest)


for _name in STRATEGY_SQL:
    _suggest(_name)


@query(f"""+ c AS (SELECT *, {key_sql("'8A'", 'key_camelot')} AS k, {tempo_sql('124e0', 'bpm')} AS t FROM v_tracks WHERE status='ok')
  SELECT id, round(0.55e0*k+0.45e0*t, 9) AS score FROM c ORDER BY 0.55e0*k+0.45e0*t DESC, artist NULLS FIRST, title NULLS FIRST, id LIMIT 10""", "tracks")
def suggest_by_key(spark, sf_dir):
    return mixing.by_key_and_tempo(tracks(spark, sf_dir), "8A", 124.0).select("id", F.round("score", 9).alias("score"))


ALONE = "lower(trim(regexp_replace(regexp_replace(coalesce(artist,''), '(?i)\\s*[(\\[]?\\b(?:feat\\.?|ft\\.?|featuring)\\s.*$', ''), '(?i)\\s*(?:,|&|\\bvs\\.?\\b|\\bx\\b|\\bwith\\b).*$', '')))"
WORDS_SQL = "|".join(text.VERSION_WORDS)
PARTS = f"""regexp_extract(coalesce(title,''), '(?s)^(.*?)\\s*[(\\[]\\s*(.+?)\\s*[)\\]]\\s*$', 1) AS b1, regexp_extract(coalesce(title,''), '(?s)^(.*?)\\s*[(\\[]\\s*(.+?)\\s*[)\\]]\\s*$', 2) AS w1,
  regexp_extract(coalesce(title,''), '(?s)^(.*?)\\s*[-–]\\s*(.+)$', 1) AS b2, regexp_extract(coalesce(title,''), '(?s)^(.*?)\\s*[-–]\\s*(.+)$', 2) AS w2"""
BASED = f"""+ q AS (SELECT *, {PARTS} FROM v_tracks), b AS (SELECT *, lower(trim(CASE WHEN regexp_matches(lower(w1), '{WORDS_SQL}') THEN b1 WHEN regexp_matches(lower(w2), '{WORDS_SQL}') THEN b2 ELSE coalesce(title,'') END)) AS base_key,
  lower(trim(CASE WHEN regexp_matches(lower(w1), '{WORDS_SQL}') THEN w1 WHEN regexp_matches(lower(w2), '{WORDS_SQL}') THEN w2 ELSE '' END)) AS version_key, lower(trim(coalesce(artist,''))) AS artist_key, {POINTS_SQL} AS points FROM q) """


@query(BASED + f"SELECT {ALONE} AS artist_key, base_key AS title_key, CAST(arg_max(id, (CASE WHEN regexp_extract(filepath,'\\.([a-z0-9]+)$',1) IN ('wav','flac') THEN 1 ELSE 0 END, (bpm IS NOT NULL)::INT+(key_camelot IS NOT NULL)::INT+(genre IS NOT NULL)::INT, -length(filepath), -id)) AS BIGINT) AS id, count(*) AS n FROM b GROUP BY 1, 2", "tracks")
def near_dup_collapse(spark, sf_dir):
    return resolution.near_copies(tracks(spark, sf_dir))


@query(BASED + "SELECT artist_key, base_key, version_key, count(*) AS n, CAST(arg_max(id, (points, filesize_bytes, -id)) AS BIGINT) AS keep_id FROM b WHERE artist_key<>'' AND base_key<>'' GROUP BY 1,2,3 HAVING count(*)>1 AND max(points)>min(points) AND coalesce(max(CASE WHEN duration_sec>0 THEN duration_sec END)-min(CASE WHEN duration_sec>0 THEN duration_sec END),0)<=5", "tracks")
def quality_dups(spark, sf_dir):
    return resolution.quality_groups(tracks(spark, sf_dir))


@query(BASED + "SELECT artist_key, base_key, count(DISTINCT version_key) AS versions FROM b WHERE artist_key<>'' AND base_key<>'' GROUP BY 1,2 HAVING count(DISTINCT version_key)>1", "tracks")
def version_groups(spark, sf_dir):
    return resolution.version_groups(tracks(spark, sf_dir))


@query(f"""+ c AS (SELECT {ALONE} AS artist_key, artist, count(*) AS files FROM v_tracks WHERE lower(trim(coalesce(artist,''))) NOT IN ('','unknown','unknown artist','va','various artists','various','n/a','none','-','--') GROUP BY 1,2)
  SELECT artist_key, count(*) AS spellings, CAST(sum(files) AS BIGINT) AS n, arg_min(artist, (-files, (artist=upper(artist))::INT, (artist=lower(artist))::INT, artist)) AS canonical FROM c GROUP BY 1 HAVING count(*)>1""", "tracks")
def artist_merge_groups(spark, sf_dir):
    return resolution.merge_groups(tracks(spark, sf_dir))


@query("SELECT coalesce(artist,'') AS label, count(*) AS n, CAST(min(CASE WHEN bpm>0 THEN floor(bpm+0.5e0) END) AS BIGINT) AS bpm_min, CAST(max(CASE WHEN bpm>0 THEN floor(bpm+0.5e0) END) AS BIGINT) AS bpm_max, count(DISTINCT genre) AS genres FROM v_tracks GROUP BY 1", "tracks")
def label_rollup(spark, sf_dir):
    return resolution.label_rollup(tracks(spark, sf_dir))


@query("SELECT content_hash, count(*) AS n, CAST(arg_max(id, (size, -id)) AS BIGINT) AS keep_id, CAST(sum(size)-max(size) AS BIGINT) AS bytes_to_free FROM v_files GROUP BY 1 HAVING count(*)>1", "files")
def exact_dups(spark, sf_dir):
    return resolution.exact_groups(view(spark, sf_dir, "files"))


@query("SELECT count(*) AS groups, CAST(coalesce(sum(n-1),0) AS BIGINT) AS copies, CAST(coalesce(sum(f),0) AS BIGINT) AS bytes_to_free FROM (SELECT count(*) AS n, sum(size)-max(size) AS f FROM v_files GROUP BY content_hash HAVING count(*)>1)", "files")
def dedupe_savings(spark, sf_dir):
    groups = resolution.exact_groups(view(spark, sf_dir, "files"))
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("copies"), F.coalesce(F.sum("bytes_to_free"), F.lit(0)).alias("bytes_to_free"))


RANK_STAGE = "list_position(['metadata-sanitize','artist-intelligence','metadata-enrich-online','filename-normalize','library-organize'], stage)"


@query("SELECT id, track_id, stage, status, processed_at FROM v_states QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY processed_at DESC, id)=1", "states")
def latest_state(spark, sf_dir):
    return resolution.latest(view(spark, sf_dir, "states"), "track_id", "processed_at").select("id", "track_id", "stage", "status", "processed_at")


@query(f"SELECT id, track_id, stage, status FROM v_states WHERE status<>'stale' QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY {RANK_STAGE} DESC, processed_at DESC, id DESC)=1", "states")
def build_tracks(spark, sf_dir):
    return resolution.current_states(view(spark, sf_dir, "states")).select("id", "track_id", "stage", "status")


@query("SELECT track_id, stage, n, id FROM (SELECT *, count(*) OVER (PARTITION BY track_id, stage) AS n FROM v_states) WHERE n > 1", "states")
def having_duplicates(spark, sf_dir):
    return resolution.repeated(view(spark, sf_dir, "states"), "track_id", "stage")


@query("SELECT (SELECT count(DISTINCT track_id) FROM v_states) AS states, (SELECT count(*) FROM v_tracks) AS tracks, (SELECT count(*) FROM (SELECT id FROM v_tracks INTERSECT SELECT track_id FROM v_states)) AS in_both", "states", "tracks")
def overlap_counts(spark, sf_dir):
    s, t = view(spark, sf_dir, "states").select("track_id"), tracks(spark, sf_dir).select("id")
    both = t.intersect(s.withColumnRenamed("track_id", "id"))
    return s.agg(F.count_distinct("track_id").alias("states")).crossJoin(t.agg(F.count("*").alias("tracks"))).crossJoin(both.agg(F.count("*").alias("in_both")))  # single rows


@query("SELECT DISTINCT track_id FROM v_states s WHERE NOT EXISTS (SELECT 1 FROM v_tracks t WHERE t.id=s.track_id)", "states", "tracks")
def stale_rows(spark, sf_dir):
    t = tracks(spark, sf_dir).select(F.col("id").alias("track_id"))
    return view(spark, sf_dir, "states").select("track_id").join(t, "track_id", "left_anti").distinct()


@query("SELECT id FROM v_tracks t WHERE NOT EXISTS (SELECT 1 FROM v_states s WHERE t.id=s.track_id)", "states", "tracks")
def untracked_rows(spark, sf_dir):
    s = view(spark, sf_dir, "states").select(F.col("track_id").alias("id"))
    return tracks(spark, sf_dir).select("id").join(s, "id", "left_anti")


@query("""+ k AS (SELECT id, filepath, lower(regexp_extract(filepath, '([^/]*)$', 1)) AS name FROM v_tracks), f AS (SELECT name, min(id) AS first_id, count(*) AS n FROM k GROUP BY 1)
  SELECT k.id, f.first_id, f.n FROM k JOIN f USING (name) WHERE k.id <> f.first_id""", "tracks")
def moved_by_name(spark, sf_dir):
    k = tracks(spark, sf_dir).select("id", F.lower(text.file_name(F.col("filepath"))).alias("name"))
    return k.join(k.groupBy("name").agg(F.min("id").alias("first_id"), F.count("*").alias("n")), "name").where("id <> first_id").select("id", "first_id", "n")


@query("SELECT s.set_id, s.position, s.track_id, t.artist, t.bpm FROM v_set_tracks s LEFT JOIN v_tracks t ON t.id=s.track_id", "set_tracks", "tracks")
def set_tracks_join(spark, sf_dir):
    return mixing.set_tracks(view(spark, sf_dir, "set_tracks"), tracks(spark, sf_dir)).select("set_id", "position", "track_id", "artist", "bpm")


@query("SELECT phase, count(*) AS n, sum(play_sec)/60 AS minutes FROM v_set_tracks GROUP BY 1", "set_tracks")
def set_phase_summary(spark, sf_dir):
    rank = F.when(F.col("phase") == "warmup", 0).when(F.col("phase") == "peak", 1).otherwise(2)
    return view(spark, sf_dir, "set_tracks").groupBy("phase").agg(F.count("*").alias("n"), (F.sum("play_sec") / 60).alias("minutes")).orderBy(rank)


@query("SELECT set_id, position, sum(play_sec) OVER (PARTITION BY set_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS played FROM v_set_tracks", "set_tracks")
def set_cumulative(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("set_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return view(spark, sf_dir, "set_tracks").select("set_id", "position", F.sum("play_sec").over(w).alias("played"))


@query(f"""+ j AS (SELECT s.set_id, s.position, t.bpm, t.genre, t.key_camelot FROM v_set_tracks s LEFT JOIN v_tracks t ON t.id=s.track_id),
  l AS (SELECT *, lag(bpm) OVER w AS nb, lag(genre) OVER w AS ng, lag(key_camelot) OVER w AS nk, row_number() OVER w AS step FROM j WINDOW w AS (PARTITION BY set_id ORDER BY position))
  SELECT set_id, position, round(0.35e0*({key_sql('nk', 'key_camelot')}) + 0.3e0*({tempo_sql('nb', 'bpm')}) + 0.2e0*(CASE abs({rank_sql(energy_sql('nb', 'ng', True))}-{rank_sql(energy_sql('bpm', 'genre', True))}) WHEN 0 THEN 1e0 WHEN 1 THEN 0.7e0 ELSE 0.35e0 END) + 0.15e0*({genre_sql('ng', 'genre')}), 9) AS total FROM l WHERE step>1""", "set_tracks", "tracks")
def set_transitions(spark, sf_dir):
    return mixing.transitions(view(spark, sf_dir, "set_tracks"), tracks(spark, sf_dir)).withColumn("total", F.round("total", 9))


@query("""+ j AS (SELECT s.set_id, s.position, t.artist, list(t.artist) OVER (PARTITION BY s.set_id ORDER BY s.position ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent FROM v_set_tracks s LEFT JOIN v_tracks t ON t.id=s.track_id)
  SELECT set_id, position FROM j WHERE list_contains(recent, artist)""", "set_tracks", "tracks")
def set_artist_repeats(spark, sf_dir):
    return mixing.repeats(view(spark, sf_dir, "set_tracks"), tracks(spark, sf_dir))


@query()
def set_build(spark, sf_dir):
    return mixing.build_sets(tracks(spark, sf_dir).where("genre IS NOT NULL"), "genre")


@query()
def phased_sets(spark, sf_dir):
    return mixing.phased_sets(tracks(spark, sf_dir).where("genre IS NOT NULL"), "genre", vibe="deep")


@query("SELECT review_status, count(*) AS n, min(item_id) AS first_item, max(item_id) AS last_item FROM v_reviews GROUP BY 1", "reviews")
def review_rollup(spark, sf_dir):
    return state.review_rollup(view(spark, sf_dir, "reviews"))


@query("SELECT item_id, review_status, n_chars FROM v_reviews JOIN documents ON doc_id=item_id WHERE review_status<>'approved' ORDER BY item_id DESC LIMIT 50 OFFSET 5", "reviews")
def review_queue_page(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    rows = view(spark, sf_dir, "reviews").where("review_status <> 'approved'").join(docs, F.col("doc_id") == F.col("item_id"))
    return rows.orderBy(F.desc("item_id")).offset(5).limit(50).select("item_id", "review_status", "n_chars")


@query("SELECT doc_id, CASE WHEN review_status IS NULL THEN 'not_reviewed' WHEN review_status<>'approved' THEN review_status WHEN n_chars<100 THEN 'too_short' ELSE 'apply' END AS outcome FROM documents LEFT JOIN v_reviews ON doc_id=item_id", "reviews")
def approved_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    status = F.col("review_status")
    outcome = F.when(status.isNull(), "not_reviewed").when(status != "approved", status).when(F.col("n_chars") < 100, "too_short").otherwise("apply")
    return docs.join(view(spark, sf_dir, "reviews"), F.col("doc_id") == F.col("item_id"), "left").select("doc_id", outcome.alias("outcome"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM v_reviews)", "reviews")
def pending_anti(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return docs.join(view(spark, sf_dir, "reviews"), F.col("doc_id") == F.col("item_id"), "left_anti")


@query("SELECT 'status' AS dimension, status AS value, count(*) AS n FROM v_tracks GROUP BY 2 UNION ALL SELECT 'parse_confidence', parse_confidence, count(*) FROM v_tracks GROUP BY 2 UNION ALL SELECT 'genre', genre, count(*) FROM v_tracks GROUP BY 2", "tracks")
def queue_counts_grouping_sets(spark, sf_dir):
    return state.counts_by(tracks(spark, sf_dir), "status", "parse_confidence", "genre")


@query("SELECT 'unchanged' AS outcome, count(*) AS n FROM v_tracks WHERE id % 3 = 0 AND id % 6 <> 0 UNION ALL SELECT 'updated', count(*) FROM v_tracks WHERE id % 6 = 0 UNION ALL SELECT 'kept', count(*) FROM v_tracks WHERE id % 3 <> 0", "tracks")
def upsert_outcomes(spark, sf_dir):
    rows = tracks(spark, sf_dir).select("id", "title", "status")
    new = rows.where("id % 3 = 0").withColumn("status", F.when(F.col("id") % 6 == 0, "changed").otherwise(F.col("status")))
    return state.change_counts(rows, new, "id", ["title", "status"])


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE status END AS status FROM v_tracks", "tracks")
def upsert_rows(spark, sf_dir):
    rows = tracks(spark, sf_dir).select("id", "status")
    return state.upsert(rows, rows.where("id % 3 = 0").withColumn("status", F.lit("new")), "id")


@query("SELECT id FROM v_inbox i WHERE NOT EXISTS (SELECT 1 FROM v_states s WHERE s.track_id=i.folder AND s.processed_at=i.ts AND s.status='success')", "inbox", "states")
def incremental_skip(spark, sf_dir):
    done = view(spark, sf_dir, "states").select(F.col("track_id").alias("folder"), F.col("processed_at").alias("ts"), "status")
    return state.pending(view(spark, sf_dir, "inbox"), done, ["folder", "ts"]).select("id")


@query("""+ g AS (SELECT *, CASE WHEN epoch(ts)-lag(epoch(ts)) OVER w <= 3600 THEN 0 ELSE 1 END AS new FROM v_inbox WINDOW w AS (PARTITION BY folder ORDER BY ts, id)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY folder ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM g)
  SELECT folder, CAST(session AS BIGINT) AS session, min(ts) AS begin, max(ts) AS "end", count(*) AS n FROM s GROUP BY 1,2""", "inbox")
def inbox_sessions(spark, sf_dir):
    return state.quiet_gaps(view(spark, sf_dir, "inbox"), "folder", "ts", 3600)


@query("""+ r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position) AS k, count(*) OVER (PARTITION BY session_id) AS m FROM v_played), d AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d)
  SELECT a.session_id, a.position, avg(b.n) AS smooth FROM r a, d, r b WHERE b.session_id = a.session_id AND b.k = greatest(1, least(a.m, a.k + d.d)) GROUP BY 1, 2""", "played")
def moving_average(spark, sf_dir):
    return state.moving_average(view(spark, sf_dir, "played"), "session_id", ["position"], "n", 5).select("session_id", "position", "smooth")


@query("""+ a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position) AS k FROM v_played), b AS (SELECT *, k-row_number() OVER (PARTITION BY session_id ORDER BY position) AS r FROM a WHERE n>=60)
  SELECT session_id, min(position) AS start, count(*) AS n FROM b GROUP BY session_id, r HAVING count(*)>=2""", "played")
def runs_above(spark, sf_dir):
    return state.runs_above(view(spark, sf_dir, "played"), "session_id", "position", "n", 60)


@query("SELECT session_id, position, n/CAST(max(n) OVER (PARTITION BY session_id) AS DOUBLE) AS share, CAST(greatest(0, coalesce(n-lag(n) OVER (PARTITION BY session_id ORDER BY position),0)) AS DOUBLE) AS rise FROM v_played", "played")
def peak_and_flux(spark, sf_dir):
    rows = view(spark, sf_dir, "played").withColumn("n", F.col("n").cast("double"))
    return state.peak_and_flux(rows, "session_id", "position", "n").select("session_id", "position", "share", "rise")


@query("""+ c AS (SELECT id, bpm, duration_sec, unnest(['intro','mix_in','groove','drop','breakdown','outro']) AS cue, unnest([0e0,0.08e0,0.2e0,0.35e0,0.6e0,0.85e0]) AS f FROM v_tracks WHERE bpm>0)
  SELECT id, cue, CAST(round(duration_sec*f/(240/bpm)) AS INT) AS bar FROM c WHERE round(duration_sec*f/(240/bpm))*(240/bpm) < duration_sec-(240/bpm)/2""", "tracks")
def cue_estimates(spark, sf_dir):
    return tracks(spark, sf_dir).select("id", F.explode(scoring.cue_estimates(F.col("bpm"), F.col("duration_sec"))).alias("c")).select("id", "c.cue", "c.bar")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_titles(spark, sf_dir):
    return web.titles(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("SELECT page_id, count(*) AS links, count(DISTINCT u) AS places FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS u FROM pages) GROUP BY 1")
def page_links(spark, sf_dir):
    links = web.links(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("url").alias("places"))


def _category_sql() -> str:
    return f"""CASE WHEN regexp_matches(filepath, '/\\.[^/]*$') OR NOT starts_with(filepath,'/') THEN 'BAD_PATH' WHEN status='stale' THEN 'STALE' WHEN trim(coalesce(artist,''))='' OR trim(coalesce(title,''))='' THEN 'MISSING_METADATA'
  WHEN coalesce(bpm,0)<=0 THEN 'MISSING_BPM' WHEN bpm NOT BETWEEN 50 AND 220 THEN 'BAD_BPM' WHEN key_camelot IS NULL THEN 'MISSING_KEY' WHEN {WHEEL.format('key_camelot')} IS NULL THEN 'BAD_KEY'
  WHEN length(lower(trim(coalesce(genre,''))))<=1 OR lower(trim(genre)) IN ('beatport','other','unknown','none','n/a','genre','traxsource','juno') THEN 'JUNK_GENRE' ELSE 'VALID' END"""


@query(f"SELECT {_category_sql()} AS category, count(*) AS n FROM v_tracks GROUP BY 1", "tracks")
def export_validation(spark, sf_dir):
    return cat.export_checks(tracks(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))


@query("""+ g AS (SELECT id, genre, title, status, bpm, key_camelot, trim(regexp_replace(regexp_replace(regexp_extract(trim(coalesce(genre,'')), '^([^,;/|]*)', 1), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM v_tracks),
  f AS (SELECT id, CASE WHEN length(n)<=1 OR lower(n) IN ('beatport','other','unknown','none','n/a','genre','traxsource','juno') THEN NULL ELSE array_to_string(list_transform(string_split(lower(n),' '), lambda w: upper(w[1])||w[2:]), ' ') END AS g FROM g WHERE status='ok' AND NOT regexp_matches(lower(concat_ws(' ', genre, title)), 'acapella|\\btools?\\b'))
  SELECT g AS playlist, count(*) AS n FROM f WHERE g IS NOT NULL GROUP BY 1 HAVING count(*)>=2""", "tracks")
def playlists_genre(spark, sf_dir):
    return cat.playlists(tracks(spark, sf_dir)).where("family = 'genre'").groupBy("playlist").agg(F.count("*").alias("n"))


@query(f"SELECT {energy_sql('bpm', 'genre')} AS playlist, count(*) AS n FROM v_tracks WHERE status='ok' GROUP BY 1", "tracks")
def playlists_energy(spark, sf_dir):
    return cat.playlists(tracks(spark, sf_dir)).where("family = 'energy'").groupBy("playlist").agg(F.count("*").alias("n"))


@query("SELECT upper(trim(key_camelot)) AS playlist, count(*) AS n FROM v_tracks WHERE status='ok' AND key_camelot IS NOT NULL GROUP BY 1 HAVING count(*)>=2", "tracks")
def playlists_key(spark, sf_dir):
    rows = cat.playlists(tracks(spark, sf_dir)).where("family = 'key'").groupBy("playlist").agg(F.count("*").alias("n"))
    return rows.orderBy(scoring.wheel_number(F.col("playlist")), scoring.wheel_mode(F.col("playlist")))


AUDIT = "trim(regexp_replace(regexp_replace(lower(regexp_extract(filepath, '([^/]*)\\.[^.]*$', 1)), '\\s*\\(\\d+\\)\\s*$', ''), '[^a-z0-9]+', ' ', 'g'))"
TOKENS = f"list_filter(list_distinct(string_split({AUDIT}, ' ')), lambda t: length(t)>1 AND t NOT IN ('remix','mix','original','feat','ft','featuring','extended'))"
#: Rows whose tokens are looked up among all others: a query set of one twentieth.
MOVED = f"+ k AS (SELECT id, filepath, filesize_bytes AS size, regexp_extract(filepath,'\\.([a-z0-9]+)$',1) AS ext, {TOKENS} AS tok FROM v_tracks), "


SCORE = "round(0.6e0*overlap+0.3e0*CASE WHEN off IS NULL THEN 0e0 ELSE greatest(0e0,1-off) END+CASE WHEN same THEN 0.1e0 ELSE 0e0 END,6)"
PAIRED = """abs(o.size-n.size)/CAST(CASE WHEN o.size>0 THEN o.size END AS DOUBLE) AS off, CASE WHEN len(o.tok)=0 THEN 0e0 ELSE len(list_intersect(o.tok,n.tok))/CAST(len(o.tok) AS DOUBLE) END AS overlap"""


@query(MOVED + f"""p AS (SELECT o.id AS old_id, n.id AS new_id, n.filepath AS new_path, o.ext=n.ext AS same, {PAIRED} FROM k o JOIN k n ON o.filepath<>n.filepath WHERE o.id%20=0)
  SELECT old_id, new_id, {SCORE} AS score, row_number() OVER (PARTITION BY old_id ORDER BY {SCORE} DESC, new_path, new_id) AS place FROM p WHERE {SCORE} > 0 QUALIFY place<=5""", "tracks")
def orphan_top5(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    found = resolution.moved_candidates(rows.where("id % 20 = 0"), rows, 5)
    return found.select("old_id", "new_id", "score", "place")


@query(MOVED + """p AS (SELECT o.id AS old_id, n.id AS new_id, abs(o.size-n.size)/CAST(o.size AS DOUBLE) AS off, len(list_intersect(o.tok,n.tok))/CAST(len(o.tok) AS DOUBLE) AS overlap FROM k o JOIN k n ON o.filepath<>n.filepath AND list_has_any(o.tok,n.tok) AND o.ext=n.ext WHERE o.size>0)
  SELECT old_id, new_id FROM p WHERE off<0.1 AND overlap>=0.7 QUALIFY row_number() OVER (PARTITION BY old_id ORDER BY overlap DESC, off, new_id)=1""", "tracks")
def relocation_best(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    return resolution.relocations(rows, rows).select("old_id", "new_id")


@query()
def rename_fuzzy(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    return resolution.fuzzy_renames(rows, rows)


@query("""+ k AS (SELECT id, regexp_extract(filepath,'^(.*)/[^/]*$',1) AS dir, artist, row_number() OVER (PARTITION BY regexp_extract(filepath,'^(.*)/[^/]*$',1), lower(coalesce(artist,'x')) ORDER BY id) AS n FROM v_tracks)
  SELECT id, dir || '/' || coalesce(artist,'x') || CASE WHEN n>1 THEN ' (' || (n-1) || ')' ELSE '' END AS target FROM k""", "tracks")
def collision_targets(spark, sf_dir):
    rows = resolution.numbered_targets(tracks(spark, sf_dir), text.folder(F.col("filepath")), F.coalesce("artist", F.lit("x")))
    return rows.select("id", "target")
