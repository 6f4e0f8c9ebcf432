"""SimHash near duplicates by the pigeonring principle.

A fingerprint's 64 bits lie on a ring of five segments. If two fingerprints differ in at most MOST_BITS bits, some
segment starts a chain of which every prefix of l segments differs in at most l * MOST_BITS / 5 bits: none in the first
segment, one in the first two, two in three, three in four. The first two of these budgets make an index: its keys are
the bits of a segment and of the next one without one of its bits, 64 keys of 24 or 25 bits for a fingerprint. What
meets under a key is a candidate; the budgets of three and four segments prune it, and only then all bits are counted.

Fingerprints that repeat are one point. A key's points leave as edges to one point of each of its connected parts, never
as all pairs. Where more than CROWD points share a key, or many points of one batch do, its points are set apart: they
are linked through the points at up to half of MOST_BITS bits from each, as two fingerprints differ in at most MOST_BITS
bits exactly if they have such a point in common. That takes work in proportion to the points, whatever they share.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import prepare, split_join, stored
from lakeshelf.llm.components import connected

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Segments, from the lowest bits; MOST_BITS is less than their number, so the first of a chain has no difference.
WIDTHS = (13, 13, 13, 13, 12)
#: Points of a key that are compared directly; of one batch, that may leave under one key; and of a batch.
CROWD, CROWD_OF_BATCH, BATCH = 1 << 15, 256, 1 << 16
#: Points of a key up to which all are compared at once, beside other keys; rows that leave at once; shingles summed at once.
SMALL, ROWS, SUMMED = 64, 1 << 18, 1 << 16

_FIRST = [sum(WIDTHS[:k]) for k in range(len(WIDTHS))]
_SEGMENTS = [((1 << w) - 1) << f for w, f in zip(WIDTHS, _FIRST, strict=True)]
_SEGMENT_OF = np.repeat(np.arange(len(WIDTHS)), WIDTHS)
#: PREFIXES[l][s]: the bits of the l segments from s on.
PREFIXES = np.array([[sum(_SEGMENTS[(s + k) % len(WIDTHS)] for k in range(n)) for s in range(len(WIDTHS))] for n in range(len(WIDTHS) + 1)], np.uint64)


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text: bit k is set if it is set in over half of the hashes of its shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = np.zeros(64, np.int64)
    for at in range(0, n, SUMMED):
        spans = zip(starts[at : min(n, at + SUMMED)].tolist(), ends[min(SHINGLE, len(words)) - 1 :][at : at + SUMMED].tolist(), strict=False)
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; null texts count as empty, whose fingerprint is 0."""
    prepare(docs.sparkSession)

    def hashed(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in batch["text"].cast(pa.large_binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, fp long")


def keys(points: np.ndarray, bit: int) -> np.ndarray:
    """The keys without `bit` of points: the bits of the segment before that of `bit`, and of its own without it."""
    start = (_SEGMENT_OF[bit] - 1) % len(WIDTHS)
    first, width = _FIRST[start], WIDTHS[start] + WIDTHS[(start + 1) % len(WIDTHS)]
    turned = (points >> np.uint64(first)) | (points << np.uint64(64 - first)) if first else points
    kept = ((1 << width) - 1) & ~(1 << ((bit - first) % 64))
    return (turned & np.uint64(kept)).view(np.int64) | np.int64(bit << 26)


def near(differences: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which differences of points that share a key of a chain from `start` keep all its budgets, and so MOST_BITS."""
    kept = np.arange(len(differences))
    for n in range(3, len(WIDTHS) + 1):
        bits = np.bitwise_count(differences[kept] & PREFIXES[n][start[kept]])
        kept = kept[bits <= n * MOST_BITS // len(WIDTHS)]
    return kept


def least_of_parts(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest of its connected part under the edges (a, b)."""
    label = np.arange(n)
    while True:
        new, low = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def parts_of_many(points: np.ndarray, start: int) -> np.ndarray:
    """For each point of one key the index of the first of its connected part; every point meets those not reached yet."""
    left, out = np.arange(len(points)), np.arange(len(points))
    while len(left):
        first, reached, left = left[0], [left[0]], left[1:]
        while reached and len(left):
            found = near(points[left] ^ points[reached.pop()], np.full(len(left), start))
            out[left[found]] = first
            reached += left[found].tolist()
            left = np.delete(left, found)
    return out


def joined_within(key: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) for points sorted by key: each with the first of its connected part under its key, if that is another."""
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    sizes = np.diff(np.append(begins, len(key)))
    start = (_SEGMENT_OF[key >> 26] - 1) % len(WIDTHS)
    few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    pairs = [np.zeros((2, 0), np.int64)]
    for k in range(1, int(sizes[sizes <= SMALL].max(initial=0))):
        one = np.flatnonzero((key[k:] == key[:-k]) & few[k:])
        one = one[near(points[one] ^ points[one + k], start[one])]
        pairs.append(np.stack([one, one + k]))
    label = least_of_parts(*np.concatenate(pairs, axis=1), len(key))
    for b, size in zip(begins[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        label[b : b + size] = b + parts_of_many(points[b : b + size], start[b])
    moved = np.flatnonzero(label != np.arange(len(key)))
    return points[moved], points[label[moved]]


def candidate_keys(points: DataFrame) -> DataFrame:
    """(key, fp, crowded) for points (fp). A crowded row stands for points of its key that have rows with a negative key."""

    def rows_of(some: np.ndarray):
        out = []
        for bit in range(64):
            found = keys(some, bit)
            order = np.argsort(found, kind="stable")
            begins = np.flatnonzero(np.concatenate([[True], found[order][1:] != found[order][:-1]]))
            sizes = np.diff(np.append(begins, len(order)))
            crowded = np.repeat(sizes > CROWD_OF_BATCH, sizes)
            first = order[begins[sizes > CROWD_OF_BATCH]]
            alone, apart = order[~crowded], order[crowded]
            out.append((np.concatenate([found[alone], found[first]]), some[np.concatenate([alone, first])], np.repeat([False, True], [len(alone), len(first)])))
            out.append((some[apart].view(np.int64) | np.iinfo(np.int64).min, some[apart], np.ones(len(apart), bool)))
        key, fp, crowded = (np.concatenate(x) for x in zip(*out, strict=True))
        for at in range(0, len(key), ROWS):
            piece = slice(at, at + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(key[piece]), pa.array(fp[piece].view(np.int64)), pa.array(crowded[piece])], ["key", "fp", "crowded"])

    def sign(batches):
        held: list[np.ndarray] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch["fp"].to_numpy().view(np.uint64))
            if held and (batch is None or sum(map(len, held)) >= BATCH):
                yield from rows_of(np.concatenate(held))
                held = []

    return points.select("fp").mapInArrow(sign, "key long, fp long, crowded boolean")


def candidate_links(signed: DataFrame) -> DataFrame:
    """(u, v): links within a key, to one point of each connected part; v is null for points of a crowded key."""

    def found(u: np.ndarray, v: np.ndarray | None):
        if v is not None and len(u):
            u, v = np.unique(np.stack([u, v]), axis=1)
        second = pa.nulls(len(u), pa.int64()) if v is None else pa.array(v.view(np.int64))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), second], ["u", "v"])

    def link(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]
        for batch in chain(batches, [None]):
            new = [] if batch is None else [batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), batch["crowded"].to_numpy(zero_copy_only=False)]
            key, fp, crowded = (np.concatenate(x) for x in zip(held, new, strict=True)) if new else held
            if not len(key):
                continue
            cut = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
            keep = slice(cut, len(key))
            if len(key) - cut > CROWD:  # the key goes on: its points leave, and one row tells that it is crowded
                yield from found(np.unique(fp[cut:]), None)
                keep, crowded = slice(len(key) - 1, len(key)), crowded | (np.arange(len(key)) >= cut)
            held = [x[keep] for x in (key, fp, crowded)]
            key, fp, crowded = key[:cut], fp[:cut], crowded[:cut]
            if not cut:
                continue
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(begins, cut))
            full = np.repeat(np.logical_or.reduceat(crowded, begins) | (sizes > CROWD), sizes)
            yield from found(np.unique(fp[full]), None)
            yield from found(*joined_within(key[~full], fp[~full]))

    ordered = signed.repartition("key").sortWithinPartitions("key", "fp")
    return ordered.mapInArrow(link, "u long, v long")


def crowd_links(points: DataFrame) -> DataFrame:
    """(u, v) for points (fp) of any number: links through common points at up to half of MOST_BITS bits from each."""
    masks = np.array([0, *(sum(1 << b for b in bits) for k in range(1, MOST_BITS // 2 + 1) for bits in combinations(range(64), k))], np.uint64)

    def around(batches):
        for batch in batches:
            points = batch["fp"].to_numpy().view(np.uint64)
            for at in range(0, len(points), ROWS // len(masks) + 1):
                some = points[at : at + ROWS // len(masks) + 1]
                middle = (some[:, None] ^ masks[None, :]).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(middle.view(np.int64)), pa.array(np.repeat(some, len(masks)).view(np.int64))], ["middle", "fp"])

    def first_of(batches):
        middle, first = None, None
        for batch in batches:
            at, fp = batch["middle"].to_numpy(), batch["fp"].to_numpy()
            if not len(at):
                continue
            begins = np.flatnonzero(np.concatenate([[at[0] != middle], at[1:] != at[:-1]]))
            firsts = np.concatenate([[first if first is not None else fp[0]], fp[begins]])[np.cumsum(np.isin(np.arange(len(at)), begins))]
            middle, first = at[-1], firsts[-1]
            edges = np.unique(np.stack([fp, firsts])[:, fp != firsts], axis=1)
            if edges.size:
                yield pa.RecordBatch.from_arrays([pa.array(e) for e in edges], ["u", "v"])

    met = points.mapInArrow(around, "middle long, fp long")
    return met.repartition("middle").sortWithinPartitions("middle", "fp").mapInArrow(first_of, "u long, v long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Fingerprints are of the words of a text with A-Z in lower case, in shingles of four (of all words if fewer), and
    link at MOST_BITS or fewer differing bits. Null, empty and blank texts have fingerprint 0, which links like any
    other. Rows are judged each by its own text: those that repeat an id are rows of their own. A null id is never the
    smallest; where all ids are null, component_id is. Equal fingerprints are one point, however many rows have it. A
    very long text is hashed whole. An empty table gives no rows, and only the id and text columns are read.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    points = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "points")
    links = stored(candidate_links(candidate_keys(points)), "links")
    edges = links.where("v IS NOT NULL")
    crowd = links.where("v IS NULL").select(F.col("u").alias("fp")).distinct()
    edges = edges.unionByName(crowd_links(crowd))
    labels = connected(edges, "simhash")
    members = stored(labels.withColumnRenamed("u", "fp").join(points.drop("n"), "fp"), "members")
    parts = stored(members.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "parts")
    found = split_join(members.select("fp", "label"), parts, "label", "size").drop("label")
    facts = stored(points.join(found, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"), "facts")
    out = split_join(rows, facts, "fp", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
