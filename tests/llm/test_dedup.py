"""Exact dedup, the n-gram join and connected components against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lakeshelf.llm import components, exact_dedup, ngram_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    """{row number: smallest doc_id reached}; rows: (doc_id, text)."""
    sets, ids = [shingles(t) for _, t in rows], [i for i, _ in rows]
    label, by_id = list(ids), defaultdict(list)
    for k, i in enumerate(ids):
        by_id[i].append(k)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if ids[a] is not None and ids[b] is not None and (ids[a] == ids[b] or (sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])))]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted((str(i), len(s), str(x)) for i, s, x in zip(ids, sets, label, strict=True))


def joined(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.ngram_join(df).collect())


def varied(seed, n_docs, sizes=(1, 4, 5, 6, 12, 15, 16, 17, 40, 64, 90, 250)):
    """Families of near copies around the threshold, with shared passages and sizes at the bands' ends."""
    rng, out = random.Random(seed), []
    passage = [f"p{k}" for k in range(40)]
    while len(out) < n_docs:
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice(sizes))]
        if rng.random() < 0.3:
            words += passage
        for _ in range(rng.choice((1, 2, 3, 6))):
            copy = list(words)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                place = rng.randrange(len(copy))
                copy[place : place + rng.choice((0, 1, 1, 3))] = [f"x{rng.randrange(9)}"] * rng.choice((1, 1, 2))
            out.append((len(out), " ".join(copy)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = varied(seed, 220)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


def test_join_of_large_clusters_and_long_runs(spark, monkeypatch):
    for name, value in {"BLOCK": 8, "RUN": 3, "MOST_GROUPS": 2, "LEAST_GROUP": 4, "MOST_BROADCAST": 3}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = varied(3, 150, (20, 40)) + [(1000 + k, "the same words in every one of these copies") for k in range(30)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


def test_join_of_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert joined(documents) == brute_components(rows)


def test_join_of_ids_with_several_texts(spark):
    """An id joins what its texts join, also where a group of copies is signed by another row."""
    a, b, c = ("the same words in every one of these copies", "other words that stand in only two of all rows", "a third text of words that no other row has")
    rows = [(k, a) for k in range(1, 70)] + [(500, a), (500, b), (600, b), (700, c), (700, b), (800, c), (900, "alone with these few words of its own")]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)
    assert {x for i, _, x in brute_components(rows) if i in ("500", "600", "700", "800")} == {"1"}


def test_join_of_awkward_rows(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(awkward).collect()]
    assert len(got) == len(rows)
    assert {(i, c) for i, _, c in got} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9), (None, None)}
    assert {n for i, n, _ in got if i in (3, 4, 5)} == {0} and {n for i, n, _ in got if i == 9} == {1}
    assert ngram_join.ngram_join(nothing).collect() == []


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for n in (1, 3, 4, 11, 13, 16, 60, 200, 255, 257, 1500):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            out = rng.permutation(len(a))[: len(a) // 4]  # J = 0.75 or more
            b = np.delete(a, out)
            common = np.sort(rng.choice(a, len(a) // 2, replace=False))
            if 100 * len(b) >= 75 * len(a):
                assert np.intersect1d(ngram_join.signatures(a, common)[0], ngram_join.signatures(b, common)[0]).size


def test_intersections_and_histograms():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(3000) < rng.choice([0.1, 0.5, 0.95])], rng.integers(0, 5000, 200).astype(np.uint64)])) for _ in range(40)] + [base[:0]]
    got = ngram_join.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets))
    hist = [ngram_join.histogram(s).tobytes() for s in sets]
    far = ngram_join.apart(hist, hist[::-1])
    assert len({len(h) for h in hist}) > 1 and all(d <= len(np.setxor1d(a, b)) for d, a, b in zip(far, sets, sets[::-1], strict=True))


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(200, 101), (101, 150), (7, 7)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "u long, v long"), "t").collect()))
    assert got == {k: 0 for k in range(51)} | {k: 101 for k in (101, 150, 200)}


def brute_dedup(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for text, members in groups.items():
        best = min(members)
        for m in members:
            out.append((str(rows[m[3]][0]), str(rows[best[3]][0]), len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("least", [1, 4, 64])
def test_exact_dedup(spark, documents, awkward, least, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_ROWS", least)
    monkeypatch.setattr(exact_dedup.winners, "__defaults__", (None, least))
    monkeypatch.setattr(exact_dedup.heavy_candidates, "__defaults__", (3, 8, least))
    for df in (documents, awkward):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = exact_dedup.exact_dedup(df).collect()
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == brute_dedup(rows)
        kept = [r["text_sha256"] for r in got if r["kept"]]
        assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got})


def test_exact_dedup_of_nothing(nothing):
    assert exact_dedup.exact_dedup(nothing).collect() == []


def reachable(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[top(a)] = top(b)
    return top


@pytest.mark.parametrize("seed", range(40))
def test_runs_lose_no_pair(monkeypatch, seed):
    """Every pair of one signature and similar sizes is in a list, tied, or left to an earlier signature."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(ngram_join, "RUN", int(rng.integers(2, 12)))
    m = int(rng.integers(1, 300))
    sig, n, doc, before = rng.integers(0, 6, m), rng.integers(10, 60, m), np.arange(m) + 100, rng.integers(0, 3, m)
    parts = [ngram_join.combined(sig[a : a + 60], doc[a : a + 60], n[a : a + 60], before[a : a + 60]) for a in range(0, m, 60)]
    rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort((rows[1], rows[2], rows[0]))
    rows, runs, step = [x[order] for x in rows], ngram_join.Runs(), int(rng.integers(1, 50))
    together, ties = set(), []
    for at in [*range(0, len(order), step), None]:
        docs, lengths, tied = runs.lists(None if at is None else [x[at : at + step] for x in rows])
        for part, tie in zip(np.split(docs, np.cumsum(lengths))[:-1], tied, strict=True):
            assert len(part) <= max(2, ngram_join.RUN)
            if tie:
                ties.append(tuple(part))
            together |= {(a, b) for a in part for b in part}
    top = reachable(ties, doc)
    for i in range(m):
        for j in range(i):
            if sig[i] == sig[j] and 3 * max(n[i], n[j]) <= 4 * min(n[i], n[j]) and not before[i] == before[j] != 0:
                assert (doc[i], doc[j]) in together or top(doc[i]) == top(doc[j])


def test_large_blocks_are_counted_in_parts(monkeypatch):
    sets = [np.unique(np.random.default_rng(k // 2).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)) for k in range(8)]
    want = ngram_join.intersections(sets)
    monkeypatch.setattr(ngram_join, "MOST_TOKENS", 300)
    assert (ngram_join.intersections(sets) == want).all() and want[0, 1] == len(sets[0])


@pytest.mark.parametrize("first, step", [(1, 3), (-(2**62), 2**40), (2**63 - 40_000, 2)])
def test_packed_signatures(first, step):
    """Rows come back from their buckets, whatever the ids, in at most two thirds of the 24 bytes that a plain row took."""
    rng = np.random.default_rng(4)
    doc = first + step * np.sort(rng.integers(0, 2000, 200_000))
    sig, before = rng.integers(-(2**63), 2**63, (2, len(doc)))
    size = np.where(rng.random(len(doc)) < 0.001, 0, rng.integers(2, 50_000, len(doc)))
    before[::7] = 0
    got, data = [], 0
    for row in ngram_join.in_buckets([sig, doc, size, before], 1024).to_pylist():
        data += len(row["data"])
        if row["tied"]:
            got += [(0, d, 0, f) for d, f in np.frombuffer(row["data"], np.int64).reshape(2, -1).T]
        else:
            got += [(row["bucket"] << 40 | s, d, n, b) for s, d, n, b in zip(*ngram_join.unpacked(row["data"]), strict=True)]
    want = np.where(size == 0, 0, (sig.view(np.uint64) >> np.uint64(54) << np.uint64(40) | sig.view(np.uint64) & np.uint64(2**40 - 1)).view(np.int64))
    kept = np.where(size == 0, before, before & (2**48 - 1))
    assert sorted(got) == sorted(zip(want, doc, size, kept, strict=True))
    assert step > 3 or data < 16 * len(doc)


def test_texts_of_a_large_cluster_are_shuffled_a_few_times(spark, monkeypatch):
    """Before, each of 200 documents went to 50 blocks of the other side: copies grew with the square of a cluster."""
    for name, value in {"BLOCK": 8, "SIDES": 2}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows, by_group = spark.sparkContext.accumulator(0), ngram_join.by_group

    def counted(batches, keys):
        for group in by_group(batches, keys):
            rows.add(group.num_rows)
            yield group

    monkeypatch.setattr(ngram_join, "by_group", counted)
    texts = [" ".join(f"w{k // 4}x{i}" for i in range(30)) + f" end{k % 2}" for k in range(200)]  # 50 groups of four that link
    members = spark.createDataFrame([(7, k, t) for k, t in enumerate(texts)], "cluster long, doc_id long, text string")
    found = ngram_join.compared_outsiders(members, spark.createDataFrame([(0, 0), (1, 0)], "u long, label long"))
    edges = {tuple(sorted(r)) for r in found.collect()}
    assert edges == {(a, b) for k in range(0, 200, 4) for a in range(k, k + 4) for b in range(a + 1, k + 4) if 1 not in (a, b)}
    assert 0 < rows.value < 1000
