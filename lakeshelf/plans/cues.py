"""Queries of cue points with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshelf.operators import cues
from lakeshelf.plans.catalogue import query, tracks
from lakeshelf.plans.views import view

HOP, SMOOTH = 1.0, 4.0
SONGS = "s AS (SELECT id, bpm, duration_sec FROM v_tracks WHERE duration_sec > 0), l AS (SELECT id, bpm, duration_sec, CASE WHEN bpm > 0 THEN 240e0 / bpm ELSE 240e0 / 128e0 END AS long FROM s)"


def mean(name: str, width: int) -> str:
    a, b = (width - 1) // 2, width // 2
    return f"CASE WHEN count(*) OVER (PARTITION BY id ORDER BY frame ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) = {width} THEN avg({name}) OVER (PARTITION BY id ORDER BY frame ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) END AS {name}"


PROFILE = f"""{SONGS}, m AS (SELECT id, frame, count(*) OVER (PARTITION BY id) AS n, {mean('level', 4)}, {mean('bass', 4)}, {mean('flux', 2)} FROM v_frames),
  h AS (SELECT m.id, m.frame, m.n, a.level, a.bass, c.flux FROM m JOIN m a ON a.id = m.id AND a.frame = greatest(1, least(m.frame, m.n - 3)) JOIN m c ON c.id = m.id AND c.frame = greatest(0, least(m.frame, m.n - 2)) WHERE m.n >= 4),
  t AS (SELECT h.*, CAST(ceil(round(duration_sec / long - 0.5, 9)) AS INT) AS bars, CAST(ceil(round((frame + 1) * {HOP}e0 / long, 9)) AS INT) AS place FROM h JOIN l USING (id)),
  x AS (SELECT *, unnest(CASE WHEN frame = n - 1 THEN range(least(bars, place) - 1, bars) ELSE [least(bars, place) - 1] END) AS bar FROM t WHERE bars > 0),
  z AS (SELECT id, unnest(range(0, max(bars))) AS bar FROM x GROUP BY id),
  y AS (SELECT z.id, CAST(z.bar AS INT) AS bar, coalesce(avg(level), 0) AS level, coalesce(avg(bass), 0) AS bass, coalesce(avg(flux), 0) AS flux FROM z LEFT JOIN x ON x.id = z.id AND x.bar = z.bar GROUP BY 1, 2),
  p AS (SELECT id, bar, {', '.join(f"CASE WHEN max({c}) OVER (PARTITION BY id) > 1e-9 THEN round({c} / max({c}) OVER (PARTITION BY id), 6) ELSE 0 END AS {c}" for c in cues.FEATURES)} FROM y)"""

CUES = f"""+ {PROFILE}, q AS (SELECT *, count(*) OVER w AS n, lead(level) OVER o AS next_level, lead(bass) OVER o AS next_bass, greatest(0, round(bass - coalesce(lag(bass) OVER o, 0), 6)) AS jump,
    round(avg(level) OVER (PARTITION BY id ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS rest, min(CASE WHEN bar >= 4 THEN level END) OVER (PARTITION BY id ORDER BY bar ROWS UNBOUNDED PRECEDING) < 0.65 AS dipped FROM p WINDOW w AS (PARTITION BY id), o AS (PARTITION BY id ORDER BY bar)),
  r AS (SELECT *, round(0.6e0 * flux + 0.4e0 * jump, 9) AS novelty, bar >= 4 AND bar < greatest(6, floor(n * 0.75e0)) AS searched FROM q WHERE n >= 4),
  g1 AS (SELECT id, any_value(n) AS n, coalesce(min(bar) FILTER (bar >= 2 AND bar < floor(n * 0.45e0) + 2 AND level >= 0.22 AND bass >= 0.15), min(bar) FILTER (bar >= 2 AND level >= 0.22)) AS mix, min(bar) FILTER (searched AND dipped AND novelty > 0.45 AND level > 0.55) AS d1,
    (list([-novelty, bar] ORDER BY -novelty, bar) FILTER (searched AND level > 0.52))[1][2] AS d2, coalesce(min(level) FILTER (searched) < 0.65, false) AS dip FROM r GROUP BY id),
  g2 AS (SELECT id, n, mix, CAST(coalesce(d1, d2) AS INT) AS drop_, d1 IS NOT NULL OR dip AS had_dip FROM g1),
  g3 AS (SELECT g2.*, coalesce(drop_ + 4, floor(n / 3e0)) AS low FROM g2),
  g4 AS (SELECT id, any_value(g3.n) AS n, any_value(mix) AS mix, any_value(drop_) AS drop_, any_value(had_dip) AS had_dip,
    coalesce(min(bar) FILTER (bar >= coalesce(mix, 2) AND level >= 0.48 AND next_level >= 0.48 AND bass >= 0.3 AND next_bass >= 0.3), min(bar) FILTER (bar >= coalesce(mix, 2) AND level >= 0.48 AND next_level >= 0.48)) AS groove,
    (list(bar ORDER BY level, bar) FILTER (bar >= low AND bar < greatest(low + 4, floor(r.n * 0.85e0)) AND low < r.n - 4))[1] AS valley,
    coalesce(min(bar) FILTER (bar >= greatest(1, floor(r.n * 0.78e0)) AND level < 0.58 AND bar < r.n - 1 AND rest < 0.58), (list(bar ORDER BY level, bar) FILTER (bar >= greatest(1, floor(r.n * 0.78e0))))[1]) AS end_ FROM g3 JOIN r USING (id) GROUP BY id),
  e AS (SELECT l.id, long, duration_sec, greatest(25, floor(duration_sec * 0.26e0 / long) + 1) AS b4, greatest(duration_sec - 110, duration_sec * 0.8e0) AS at6 FROM l WHERE id NOT IN (SELECT id FROM g4)),
  e2 AS (SELECT *, greatest(b4 + 8, floor(duration_sec * 0.58e0 / long) + 1) AS b5 FROM e),
  e3 AS (SELECT id, long, duration_sec, unnest([{{'k': 'intro_start', 't': 0e0, 'b': 1e0, 'c': 1e0}}, {{'k': 'mix_in', 't': 8 * long, 'b': 9e0, 'c': 0.5e0}}, {{'k': 'groove_start', 't': 16 * long, 'b': 17e0, 'c': 0.4e0}}, {{'k': 'drop', 't': (b4 - 1) * long, 'b': b4, 'c': 0.35e0}},
    {{'k': 'breakdown', 't': (b5 - 1) * long, 'b': b5, 'c': 0.3e0}}, {{'k': 'outro_start', 't': at6, 'b': greatest(b5 + 4, floor(at6 / long) + 1), 'c': 0.45e0}}]) AS u FROM e2),
  c AS (SELECT id, 'intro_start' AS k, 0 AS bar, 1e0 AS s FROM g4
    UNION ALL SELECT id, 'mix_in', bar, CASE WHEN bass >= 0.15 THEN 0.72e0 ELSE 0.55e0 END + CASE WHEN next_level >= 0.22 THEN 0.08e0 ELSE 0 END FROM g4 JOIN r USING (id) WHERE bar = mix
    UNION ALL SELECT id, 'groove_start', bar, CASE WHEN bass >= 0.3 THEN 0.75e0 ELSE 0.6e0 END FROM g4 JOIN r USING (id) WHERE bar = groove
    UNION ALL SELECT id, 'drop', bar, least(0.9e0, 0.65e0 + CASE WHEN flux > 0.5 THEN 0.12e0 ELSE 0 END + CASE WHEN jump > 0.28 THEN 0.08e0 ELSE 0 END + CASE WHEN had_dip THEN 0.05e0 ELSE 0 END) FROM g4 JOIN r USING (id) WHERE bar = drop_
    UNION ALL SELECT id, 'breakdown', bar, least(0.82e0, 0.6e0 + CASE WHEN bass < 0.25 THEN 0.1e0 ELSE 0 END + CASE WHEN level < 0.3 THEN 0.08e0 ELSE 0 END) FROM g4 JOIN r USING (id) WHERE bar = valley AND level < 0.4
    UNION ALL SELECT id, 'outro_start', bar, least(0.82e0, 0.68e0 + CASE WHEN bass < 0.35 THEN 0.07e0 ELSE 0 END + CASE WHEN bar >= floor(r.n * 0.82e0) THEN 0.05e0 ELSE 0 END) FROM g4 JOIN r USING (id) WHERE bar = end_),
  cues AS (SELECT c.id, k AS cue_type, round(bar * long, 2) AS time_sec, CAST(bar + 1 AS INT) AS bar, round(s, 3) AS confidence, 'energy_analysis' AS source FROM c JOIN l ON l.id = c.id
    UNION ALL SELECT id, u.k, round(u.t, 2), CAST(u.b AS INT), u.c, 'bpm_estimate' FROM e3 WHERE u.t < duration_sec - long * 0.5)"""


def songs(spark, sf_dir):
    return tracks(spark, sf_dir).where("duration_sec > 0").select("id", "bpm", "duration_sec")


@query(f"+ {PROFILE} SELECT id, bar, level, bass, flux FROM p", "tracks", "frames")
def bar_profiles(spark, sf_dir):
    return cues.bar_profile(view(spark, sf_dir, "frames"), songs(spark, sf_dir), HOP, SMOOTH)


@query(f"{CUES} SELECT * FROM cues", "tracks", "frames")
def cue_points(spark, sf_dir):
    rows = songs(spark, sf_dir)
    return cues.cue_points(cues.bar_runs(view(spark, sf_dir, "frames"), rows, HOP, SMOOTH), rows)


@query(f"""{CUES} SELECT t.id, coalesce(nullif(artist, ''), 'Unknown') AS artist, coalesce(nullif(title, ''), regexp_extract(filepath, '([^/]*?)(?:\\.[^./]*)?$', 1)) AS title, round(coalesce(bpm, 0), 2) AS bpm, coalesce(key_camelot, '') AS key, round(coalesce(duration_sec, 0), 1) AS duration_sec,
  string_agg(cue_type || '@' || CAST(bar AS VARCHAR), ' ' ORDER BY bar, cue_type) AS found FROM v_tracks t JOIN (SELECT id, cue_type, cues.bar FROM cues) k ON k.id = t.id GROUP BY ALL""", "tracks", "frames")  # fmt: skip
def cue_masters(spark, sf_dir):
    rows = cues.cue_master(cue_points(spark, sf_dir), tracks(spark, sf_dir))
    ordered = F.array_sort(F.transform(F.map_entries("cues"), lambda e: F.struct(e["value"]["bar"].alias("bar"), e["key"].alias("k"))))
    return rows.withColumn("found", F.array_join(F.transform(ordered, lambda c: F.concat(c["k"], F.lit("@"), c["bar"].cast("string"))), " ")).drop("cues")
