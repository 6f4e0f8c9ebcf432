"""Joins of pairs of rows whose number grows with the square of a key's rows."""

import pandas as pd
from pyspark.sql import functions as F

from lakeshelf.functions import audit as audit_rules
from lakeshelf.functions import text
from lakeshelf.operators import audit, matching, resolution
from lakeshelf.plans import registry


def test_a_frequent_key_is_dealt_into_many_tasks(spark, monkeypatch):
    for name, value in {"BLOCK_PAIRS": 40, "TASK_PAIRS": 80}.items():
        monkeypatch.setattr(resolution, name, value)
    names = [(k, ("Ann", "Bo", "Annie", None)[0 if k < 40 else k % 4]) for k in range(60)]
    df = spark.createDataFrame(names, "id long, name string")
    got = matching.containing(df, df)
    want = sorted((a, b) for a, x in names for b, y in names if x and y and (x.lower() in y.lower() or y.lower() in x.lower()))
    assert sorted(map(tuple, got.collect())) == want
    parts = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < len(want) / 2


def test_equal_names_are_compared_once(spark, monkeypatch):
    compared = spark.sparkContext.accumulator(0)
    ratio = F.pandas_udf(lambda a, b: (compared.add(len(a)), pd.Series([0.9] * len(a)))[1], "double")
    monkeypatch.setattr(resolution, "sequence_ratio", lambda a, b, least: ratio(a, b))
    old = spark.createDataFrame([(k, f"/o/{k}/a b.mp3", 1000 + k) for k in range(20)], "id long, filepath string, filesize_bytes long")
    new = spark.createDataFrame([(k, f"/n/{k}/a {'bc'[k % 2]}.mp3", 1000 + k) for k in range(30)] + [(99, "/n/a c.wav", 1000)], "id long, filepath string, filesize_bytes long")
    rows = resolution.fuzzy_renames(old, new).collect()
    assert sorted((r["old_id"], r["new_id"]) for r in rows) == [(a, b) for a in range(20) for b in range(30)]
    assert 0 < compared.value < 20  # two pairs of names at each reading, not 600 pairs of files


#: Few names in many folders and sizes, often the old file's own path, in so many copies that all of one path would fill every list.
MOVED = [(k, f"/{'ab'[k % 2]}/{('one two', 'one three', 'two', 'x')[k % 4]}.{('mp3', 'wav')[k % 3 % 2]}", (1000, 1001, 1050, None, 0)[k % 5 if k % 7 else 3]) for k in range(420)]
FILE = "id long, filepath string, filesize_bytes long"


def pairs_of(old, new):
    """Brute force: (old_id, new_id, new_path, overlap, off, score) of all pairs of different paths."""
    tokens = {p: {t for t in p.split("/")[-1].split(".")[0].split() if len(t) > 1} for _, p, _ in old + new}
    for i, p, a in old:
        for j, q, b in new:
            if p != q:
                overlap, same = len(tokens[p] & tokens[q]) / max(1, len(tokens[p])), p[-3:] == q[-3:]
                off = abs(a - b) / a if a and b is not None else None
                yield i, j, q, overlap, off, same, round(0.6 * overlap + 0.3 * max(0.0, 1 - (1.0 if off is None else off)) + (0.1 if same else 0.0), 6)


def moved_brute(old, new):
    rows = {}
    for i, j, q, _, _, _, score in pairs_of(old, new):
        if score > 0:
            rows.setdefault(i, []).append((-score, q, j))
    return sorted((i, j, -s, place) for i, found in rows.items() for place, (s, _, j) in enumerate(sorted(found)[:5], 1))


def small_blocks(spark, monkeypatch):
    monkeypatch.setattr(resolution, "OLD_BLOCK", 3)
    monkeypatch.setattr(resolution, "NEW_BLOCK", 16)
    old = MOVED[:60] + [(1000, "/b/one two.mp3", 1000)]
    return old, MOVED, spark.createDataFrame(old, FILE), spark.createDataFrame(MOVED, FILE)


def test_moved_files_of_many_copies(spark, monkeypatch):
    old, new, o, n = small_blocks(spark, monkeypatch)
    got = sorted((r["old_id"], r["new_id"], r["score"], r["place"]) for r in resolution.moved_candidates(o, n).collect())
    assert got == moved_brute(old, new)


def test_copies_are_compared_once(spark):
    """6,000 old rows and 30,000 new ones of 20 and 40 kinds: before, all 180 million pairs were compared."""
    compared = spark.sparkContext.accumulator(0)
    name = "concat('/', id % 2, '/song ', 10 + id % 20, '.mp3')"
    old, new = (spark.range(k).selectExpr("id", f"{name} AS filepath", "100L AS filesize_bytes") for k in (6000, 30_000))

    def choose(overlap, off, same, score):
        compared.add(len(overlap))
        return (overlap == 1).nonzero()[0], [-score]

    rows = resolution.block_matches(old, new, choose, 2, [-F.col("score")])
    assert rows.count() == 0  # every name is in one folder only, so no other path has all its tokens
    assert 0 < compared.value <= 20 * 40


def test_best_overlaps_of_many_copies(spark, monkeypatch):
    old, new, o, n = small_blocks(spark, monkeypatch)
    best = {}
    for i, _, _, overlap, _, same, _ in pairs_of(old, new):
        if same and overlap > 0:
            best[i] = max(best.get(i, 0), overlap)
    assert {r["old_id"]: r["overlap"] for r in resolution.best_overlaps(o, n).collect()} == best


def test_relocations_of_many_copies(spark, monkeypatch):
    old, new, o, n = small_blocks(spark, monkeypatch)
    best = {}
    for i, j, _, overlap, off, same, _ in pairs_of(old, new):
        if same and off is not None and off < 0.1 and overlap >= 0.7:
            best[i] = min(best.get(i, (9, 9, 9)), (-overlap, off, j))
    assert {r["old_id"]: r["new_id"] for r in resolution.relocations(o, n).collect()} == {i: j for i, (_, _, j) in best.items()}


def test_replacements_of_many_copies_are_judged_once(spark, monkeypatch):
    judged = spark.sparkContext.accumulator(0)
    one = F.pandas_udf(lambda a, b: (judged.add(len(a)), pd.Series([1.0] * len(a)))[1], "double")
    monkeypatch.setattr(audit.text, "token_overlap", lambda a, b: one(a, b))
    old = [(k, "s", "stale" if k == 3 else None, "/old/ann lee.mp3", 1000 + k % 2) for k in range(50)] + [(50, "s", "ok", "/n/0/ann lee.mp3", 1000), (51, "s", "ok", "/old/ann lee.wav", 1000), (8, "s", None, "/old/ann lee.mp3", 1004)]
    new = [(f"/n/{k}/ann lee.mp3", (1001, 1004, 1020, None)[k % 4]) for k in range(80)] + [("/a/ann lee (remix).mp3", 1000)]
    rows = audit.superseded(spark.createDataFrame(old, "id long, stage string, status string, filepath string, filesize_bytes long"), spark.createDataFrame(new, "filepath string, filesize_bytes long")).collect()
    got = {r["id"]: (r["old_path"], r["replacement_path"]) for r in rows}
    assert len(rows) == len(got)  # the exact size is best, of equal ones the least path; id 8 has two sizes, of which the second fits best
    assert got == {k: ("/old/ann lee.mp3", "/n/1/ann lee.mp3" if k == 8 else "/n/0/ann lee.mp3") for k in range(50) if k != 3}
    assert 0 < judged.value <= 40  # three sizes of one old name and two of a new one, at each reading, not thousands of pairs


def test_rules_run_in_many_tasks(spark):
    """A small file is one task to its reader; neither a rule nor a filter by its result may stay in it."""
    for name in ("tag_changes", "tag_change_counts", "top_labels", "checked_plan", "plan_reasons", "scored_parses", "candidate_tiers", "detected_labels"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning(16)" in plan, name
        for below in plan.split("RoundRobinPartitioning")[1:]:
            assert "regexp" not in below.split("FileScan")[0].lower() and "FileScan" in below, name


def test_names_of_a_pair_are_judged_once(spark):
    for name in ("checked_plan", "plan_reasons", "candidate_tiers", "tier_counts", "action_counts"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"\bre[\s-]*edit\b") == 2, name  # the old and the new name, whatever reads what is found


def test_words_are_those_of_the_compared_name(spark):
    names = ["Ann - Night", "Ann  (2) - Night (3)\n", "Night - 8A - 128", "Night - 128 - 8a ", "x.y é_z", "(1)", " - ", "", None, "A\tB--c.mp3", "(4) (5)"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(text.audit_words(F.col("n")).alias("words"), F.filter(F.split(text.audit_name(F.concat("n", F.lit(".x"))), " "), lambda w: w != "").alias("want"))
    got = rows.collect()
    assert [r["words"] for r in got] == [r["want"] for r in got] and got[0]["words"] == ["ann", "night"] and got[2]["words"] == ["night"] and got[8]["words"] is None


def test_a_weak_place_is_weak_without_its_names(spark):
    rows = spark.createDataFrame([(s, o, f, k) for s in (None, 0.5, 0.8, 0.96) for o in (None, 0.5, 1.0) for f in (None, 0.001, 0.5) for k in (None, True, False)], "s double, o double, f double, k boolean")
    sure = audit_rules.is_sure(F.col("s"), F.col("o"), F.col("f"), F.col("k"))
    for new in ("/n/a.mp3", "/n/a dub.mp3"):
        tier = audit_rules.tier(F.col("s"), F.col("o"), F.col("f"), F.col("k"), F.lit("/o/a.mp3"), F.lit(new))
        assert rows.where((tier == audit_rules.TIERS[2]) != audit_rules.is_weak(sure, F.col("s"))).count() == 0 < rows.where(tier == audit_rules.TIERS[2]).count()


def test_every_file_is_sought(spark):
    """Before, only every twentieth was."""
    for name in ("relocation_best", "rename_fuzzy"):
        rows = registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
        assert len({r["old_id"] % 20 for r in rows}) > 10, name


def test_relocations_across_classes_of_size(spark, monkeypatch):
    old, new, _, _ = small_blocks(spark, monkeypatch)
    old, new = ([(i, p, None if s is None else s * (100 + i * 7 % 41) // 100) for i, p, s in rows] for rows in (old, new))
    best = {}
    for i, j, _, overlap, off, same, _ in pairs_of(old, new):
        if same and off is not None and off < 0.1 and overlap >= 0.7:
            best[i] = min(best.get(i, (9, 9, 9)), (-overlap, off, j))
    found = resolution.relocations(spark.createDataFrame(old, FILE), spark.createDataFrame(new, FILE))
    assert {r["old_id"]: r["new_id"] for r in found.collect()} == {i: j for i, (_, _, j) in best.items()} and len(best) > 5
