"""Cue points against a plain walk over the bars, and awkward tracks."""

import math
import random
import re

from pyspark.sql import functions as F

from lakeshelf.operators import cues
from lakeshelf.plans import registry, views


def walked(rows):
    """{cue type: bar from 1} by one bar after the other; rows: (level, bass, flux)."""
    n, level, bass = len(rows), [r[0] for r in rows], [r[1] for r in rows]
    found = {"intro_start": 0}
    early = [i for i in range(2, min(n, int(n * 0.45) + 2)) if level[i] >= 0.22 and bass[i] >= 0.15]
    late = [i for i in range(2, n) if level[i] >= 0.22]
    found["mix_in"] = (early or late or [None])[0]
    begin = found["mix_in"] or 2
    full = [i for i in range(begin, n - 1) if all(level[j] >= 0.48 and bass[j] >= 0.3 for j in (i, i + 1))]
    loud = [i for i in range(begin, n - 1) if level[i] >= 0.48 and level[i + 1] >= 0.48]
    found["groove_start"] = (full or loud or [None])[0]
    news = [round(0.6 * rows[i][2] + 0.4 * max(0.0, bass[i] - (bass[i - 1] if i else 0.0)), 9) for i in range(n)]
    span = [i for i in range(4, max(6, int(n * 0.75))) if i < n]
    hits = [i for i in span if min(level[4 : i + 1]) < 0.65 and news[i] > 0.45 and level[i] > 0.55]
    peaks = sorted((-news[i], i) for i in span if level[i] > 0.52)
    found["drop"] = hits[0] if hits else peaks[0][1] if peaks else None
    low = n // 3 if found["drop"] is None else found["drop"] + 4
    valley = min(((level[i], i) for i in range(low, min(n, max(low + 4, int(n * 0.85))))), default=(1, 0)) if low < n - 4 else (1, 0)
    found["breakdown"] = valley[1] if valley[0] < 0.4 else None
    tail = range(max(1, int(n * 0.78)), n)
    quiet = [i for i in tail if level[i] < 0.58 and i < n - 1 and round(sum(level[i:]) / (n - i), 9) < 0.58]
    found["outro_start"] = quiet[0] if quiet else min((level[i], i) for i in tail)[1]
    return {k: v + 1 for k, v in found.items() if v is not None}


def test_cues_equal_a_plain_walk(spark):
    numbers = random.Random(8)
    songs = {}
    for k in range(150):
        base, n = numbers.random(), numbers.randint(4, 60)
        songs[k] = [tuple(round(min(1.0, max(0.0, numbers.gauss(base, 0.35))), 2) for _ in range(3)) for _ in range(n)]
    profile = spark.createDataFrame([(k, i, *v) for k, rows in songs.items() for i, v in enumerate(rows)], "id int, bar int, level double, bass double, flux double")
    tracks = spark.createDataFrame([(k, 120.0, 2.0 * len(rows)) for k, rows in songs.items()], "id int, bpm double, duration_sec double")
    got = {}
    for r in cues.cue_points(profile, tracks).collect():
        got.setdefault(r["id"], {})[r["cue_type"]] = r["bar"]
        assert r["time_sec"] == 2.0 * (r["bar"] - 1) and 0.5 <= r["confidence"] <= 1 and r["source"] == "energy_analysis"
    assert got == {k: walked(rows) for k, rows in songs.items()}


def test_profile_averages_holds_ends_and_fills_bars(spark):
    frames = spark.createDataFrame([(1, i, float(i), 1.0, 0.0) for i in range(8)] + [(2, 0, 1.0, 1.0, 1.0)], "id int, frame int, level double, bass double, flux double")
    tracks = spark.createDataFrame([(1, 120.0, 12.0), (2, 120.0, 12.0), (3, None, None)], "id int, bpm double, duration_sec double")
    rows = sorted(cues.bar_profile(frames, tracks, hop=1.0, smooth=2.0).collect())
    # means of two frames: .5, 1.5, ... 6.5, and 6.5 again at the end; two frames a bar, later bars as the last frame
    assert [(r["bar"], r["level"], r["bass"], r["flux"]) for r in rows] == [(k, round(v / 6.5, 6), 1.0, 0.0) for k, v in enumerate((1.0, 3.0, 5.0, 6.5, 6.5, 6.5))]
    fast = cues.bar_profile(frames, tracks.selectExpr("id", "480.0D AS bpm", "4.0D AS duration_sec"), hop=1.0, smooth=1.0)
    assert [(r["bar"], r["bass"]) for r in sorted(fast.where("id = 1").collect())] == [(0, 0.0), (1, 1.0), (2, 0.0), (3, 1.0), (4, 0.0), (5, 1.0), (6, 0.0), (7, 1.0)]


def test_estimates_and_master(spark):
    nothing = spark.createDataFrame([], "id int, bar int, level double, bass double, flux double")
    tracks = spark.createDataFrame([(1, 120.0, 300.0, "/a/b.mp3", None, "", "8A"), (2, None, 20.0, "/c.d/e", "Ann", "T", None), (3, 120.0, None, "/x", None, None, None), (4, 1.0, 9.0, None, None, None, None)], "id int, bpm double, duration_sec double, filepath string, artist string, title string, key_camelot string")
    found = cues.cue_points(nothing, tracks)
    assert sorted((r["id"], r["cue_type"], r["time_sec"], r["bar"]) for r in found.collect()) == [
        (1, "breakdown", 174.0, 88), (1, "drop", 78.0, 40), (1, "groove_start", 32.0, 17), (1, "intro_start", 0.0, 1), (1, "mix_in", 16.0, 9), (1, "outro_start", 240.0, 121),
        (2, "intro_start", 0.0, 1), (2, "mix_in", 15.0, 9), (2, "outro_start", 16.0, 37),
    ]
    master = sorted(cues.cue_master(found.unionByName(found), tracks).collect())
    assert [(r["id"], r["artist"], r["title"], r["bpm"], r["key"], sorted(r["cues"])) for r in master] == [(1, "Unknown", "b", 120.0, "8A", sorted(cues.TYPES)), (2, "Ann", "T", 0.0, "", ["intro_start", "mix_in", "outro_start"])]


def test_tasks_grow_with_the_frames(spark, monkeypatch):
    """60,000 frames in tasks of about 1,000, whatever the number of shuffle partitions; their bars and cues stay there."""
    monkeypatch.setattr(views, "TASK_ROWS", 1000)
    for name in ("bar_profiles", "cue_points", "cue_masters"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
        parts = re.findall(r"hashpartitioning\((l_partkey|id)#\w+, (\d+)\)", plan)
        assert ("l_partkey", "60") in parts and {n for _, n in parts} == {"60"}, (name, parts)


SMALL = "/root/testdata/sf0.001"


def long_tracks(spark):
    """{id: (bars, seconds of a bar)} of the tracks of over 40 seconds that have frames enough."""
    rows = views.view(spark, SMALL, "tracks").where("duration_sec > 40").join(views.view(spark, SMALL, "frames").groupBy("id").count().where("count >= 4"), "id").collect()
    long = {r["id"]: 240.0 / (r["bpm"] or 128.0) for r in rows}
    return {r["id"]: (math.ceil(round(r["duration_sec"] / long[r["id"]] - 0.5, 9)), long[r["id"]]) for r in rows}


def test_profiles_cover_whole_tracks(spark):
    """Before, durations were cut at 40 seconds."""
    bars = {r["id"]: (r["n"], r["last"] + 1) for r in registry.QUERIES["bar_profiles"](spark, SMALL).groupBy("id").agg(F.count("*").alias("n"), F.max("bar").alias("last")).collect()}
    want = {k: (n, n) for k, (n, _) in long_tracks(spark).items() if n > 0}
    assert want and {k: v for k, v in bars.items() if k in want} == want


def test_runs_of_equal_bars_give_the_same_cues(spark):
    """Frames of the first bars only, then all kinds of ends: no bar, a few and many beyond the last frame."""
    numbers = random.Random(4)
    songs = [(k, numbers.choice([None, 0.0, 20.0, 60.0, 128.0, 300.0]), numbers.choice([0.5, 4.0, 9.0, 17.0, 33.0, 120.0, 500.0])) for k in range(200)]
    frames = [(k, i, *(round(min(1.0, max(0.0, numbers.gauss(0.45, 0.35))), 2) for _ in range(3))) for k, _, _ in songs for i in range(numbers.randint(1, 40))]
    frames = spark.createDataFrame(frames, "id int, frame int, level double, bass double, flux double")
    tracks = spark.createDataFrame(songs, "id int, bpm double, duration_sec double")
    runs, profile = (f(frames, tracks, 1.0, 2.0) for f in (cues.bar_runs, cues.bar_profile))
    assert runs.groupBy("id").count().agg(F.max("count")).first()[0] <= 100 < 600 < profile.groupBy("id").count().agg(F.max("count")).first()[0]
    got, want = (sorted(map(tuple, cues.cue_points(p, tracks).collect())) for p in (runs, profile))
    assert got == want and len({c for _, c, _, _, _, s in got if s == "energy_analysis"}) == 6


def test_cues_lie_in_whole_tracks(spark):
    """Before, no cue lay beyond 40 seconds."""
    long = long_tracks(spark)
    ends = {r["id"]: r["time_sec"] for r in registry.QUERIES["cue_points"](spark, SMALL).where("cue_type = 'outro_start'").collect()}
    assert len(long) > 100
    for k, (n, seconds) in long.items():
        if n >= 8:
            assert math.floor(n * 0.78) * seconds - 0.01 <= ends[k] < n * seconds, k


def test_masters_list_the_cues_of_whole_tracks(spark):
    """Before, the last bars of a list were those of the first 40 seconds."""
    bars = {k: n for k, (n, _) in long_tracks(spark).items() if n >= 8}
    ends = {r["id"]: int(re.search(r"outro_start@(\d+)", r["found"])[1]) for r in registry.QUERIES["cue_masters"](spark, SMALL).collect() if r["id"] in bars}
    assert set(ends) == set(bars) and all(math.floor(n * 0.78) < ends[k] <= n for k, n in bars.items())
