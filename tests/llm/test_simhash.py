"""SimHash near duplicates against brute force, by every route."""

import random
import re

import numpy as np
import pytest
import xxhash

from lakeshelf.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(doc_id, fingerprint, component) by comparing all pairs of rows."""
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    ids = {x: min((i for (i, _), y in zip(rows, label, strict=True) if x == y and i is not None), default=None) for x in set(label)}
    return sorted(str((i, f"{p:016x}", ids[x])) for (i, _), p, x in zip(rows, prints, label, strict=True))


def found(df):
    return sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in simhash.simhash_dedup(df).collect())


def copies(seed, families, length):
    """Families of near copies, whose fingerprints differ in few bits to many."""
    rng, out = random.Random(seed), []
    for _ in range(families):
        words = [f"Wo{rng.randrange(500)}" for _ in range(rng.choice(length))]
        for _ in range(rng.choice((1, 2, 5))):
            copy = list(words)
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            out.append((len(out) * 7 % 1009, rng.choice((" ", "\n", " \t")).join(copy)))
    return out


@pytest.mark.parametrize(("seed", "length"), [(1, (1, 2, 3, 4, 5, 9)), (2, (60, 200, 400))])
def test_components_equal_brute_force(spark, seed, length):
    rows = [*copies(seed, 90, length), (5000, None), (5001, ""), (5002, " \n")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_components_of_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = brute(rows)
    assert found(documents) == got and len({r.rsplit(" ", 1)[1] for r in got}) < len(got)


def points(rng, n, spread):
    """Points around a few centres, up to `spread` bits from them, and others anywhere."""
    centres = [rng.getrandbits(64) for _ in range(3)]
    near = [rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(spread + 1))) for _ in range(n)]
    return sorted({*near, *(rng.getrandbits(64) for _ in range(n // 4))})


def parts(values, edges):
    label = {x: x for x in values}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize(("crowd", "batch", "rows"), [(1 << 15, 256, 1 << 18), (20, 256, 1 << 18), (1 << 15, 6, 1 << 18), (5, 3, 3000)])
def test_every_route_finds_the_same_parts(spark, monkeypatch, crowd, batch, rows):
    """The constants are read by inner functions, which are shipped with the values that they have here."""
    for name, value in {"CROWD": crowd, "CROWD_OF_BATCH": batch, "ROWS": rows, "BATCH": 100}.items():
        monkeypatch.setattr(simhash, name, value)
    values = points(random.Random(crowd + batch), 300, 4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4]
    out = simhash.candidate_links(simhash.candidate_keys(df)).collect()
    edges = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in out if r["v"] is not None]
    apart = sorted({r["u"] for r in out if r["v"] is None})
    assert bool(apart) == (crowd < 100 or batch < 100)
    if apart:
        found = simhash.crowd_links(spark.createDataFrame([(x,) for x in apart], "fp long")).collect()
        edges += [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in found]
    assert parts(values, edges) == parts(values, links)


@pytest.mark.parametrize("small", [1, 4, 64])
def test_points_of_a_key_are_joined_as_far_as_they_reach(monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    values = np.array(points(random.Random(small), 400, 4), np.uint64)
    edges = []
    for bit in range(64):
        key = simhash.keys(values, bit)
        order = np.argsort(key, kind="stable")
        edges += list(zip(*(x.tolist() for x in simhash.joined_within(key[order], values[order])), strict=True))
    every = values.tolist()
    assert parts(every, edges) == parts(every, [(a, b) for a in every for b in every if a < b and (a ^ b).bit_count() <= 4])


def test_linked_points_share_a_chain():
    rng = random.Random(5)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 5)))
        pair = np.array([a, b], np.uint64)
        met = [k for k in range(64) if len(set(simhash.keys(pair, k).tolist())) == 1]
        starts = (simhash._SEGMENT_OF[met] - 1) % 5
        assert len(simhash.near(np.full(len(met), pair[0] ^ pair[1]), starts))


def test_awkward_rows(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    assert found(awkward) == brute(rows)
    assert found(nothing) == []
