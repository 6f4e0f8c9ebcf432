"""The filter audit against plain application of every order, row by row."""

import re
from collections import Counter
from itertools import permutations

import pytest

from lakeshelf.llm import filter_audit


def brute(rows, labels):
    """{(part, order, step): counts} by applying each order's filters one after the other. rows: (doc_id, text, source)."""
    texts = [t or "" for _, t, _ in rows]
    first: dict = {}
    for (i, _, _), t in zip(rows, texts, strict=True):
        if i is not None:
            first[t] = min(i, first.get(t, i))
    fails, good, toxic = [], [], []
    for (i, _, _), t in zip(rows, texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append({k for k, v in tests.items() if v})
        good.append(any(q == 1 for d, q, _ in labels if d == i and i is not None))
        toxic.append(any(x == 1 for d, _, x in labels if d == i and i is not None))
    out, shapley = {}, Counter()
    for part in {s or "" for _, _, s in rows}:
        mine = [k for k, (_, _, s) in enumerate(rows) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order):
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                failing = sum(f in fails[k] for k in mine)
                out[part, order, step + 1] = (len(left), len(gone), failing - len(gone), sum(fails[k] == {f} for k in mine), sum(good[k] for k in gone), sum(toxic[k] for k in gone))
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(docs, labels):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = filter_audit.audit(filter_audit.judged(docs, labels)).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in rows}
    assert len(out) == len(rows)
    return out


def test_every_order_on_awkward_rows(spark, awkward, nothing):
    words = [f"w{k}" for k in range(300)]
    more = [(20, " ".join(words), "en", "a"), (21, " ".join(words), "en", None), (22, " ".join([*words, "$5"]), "en", "b"), (23, "Ab " * 300, "en", "b"), (24, " ".join(w.upper() for w in words), "en", "a"), (2, " ".join(words), "en", "a")]
    plain = awkward.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    labels = [(20, 1, 0), (20, 0, 1), (23, None, 1), (22, 1, None), (None, 1, 1), (1, 1, 0)]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in plain.collect()]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS part", "2 AS n")
    assert found(plain.selectExpr("*", "1 AS part", "true AS good", "'x' AS digest"), marks) == brute(rows, labels)
    assert found(nothing, marks) == {}


def test_many_heavy_repeats_take_either_route(spark, monkeypatch):
    from lakeshelf.llm import common

    monkeypatch.setattr(common, "MOST_HEAVY", 1)
    rows = [(k, f"text {k % 7 % 4}", f"s{k % 3}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int")
    assert found(df, marks) == brute(rows, [(3, 1, 1)])


def test_names_are_checked(spark):
    with pytest.raises(ValueError):
        filter_audit.audit(spark.range(1), "AAB")


def test_survivor_tables_are_those_of_sets(spark):
    rows = spark.createDataFrame([("p", False, False, a, b, c) for a in (True, False) for b in (True, False) for c in (True, False)], "part string, good boolean, toxic boolean, fails_A boolean, fails_B boolean, fails_C boolean")
    tables = filter_audit.survivor_tables(rows, "ABC")
    assert {"".join(sorted(k)): v.count() for k, v in tables.items()} == {"": 8, "A": 4, "B": 4, "C": 4, "AB": 2, "AC": 2, "BC": 2, "ABC": 1}
    for t in tables.values():
        t.unpersist()
