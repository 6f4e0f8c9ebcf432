"""Packing along a space-filling curve.

A document's hashed token counts are projected to few dimensions, quantised, and turned into a Hilbert key. Rows are
range-sorted by that key, so neighbours in content are neighbours in the sequences; the token stream is cut every
`length` tokens. Starts come from running sums within each range and the sums of whole ranges, one row per range.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeshelf.llm.common import keyed_text, prepare, stored

LENGTH, END_ID = 2048, 1
BUCKETS, DIMENSIONS, BITS, SEED = 256, 4, 12, 7
#: The first character that isn't plain to WordTokenizer; new entries after which a worker's caches forget the oldest.
PLAIN, MOST_CHUNKS, MOST_WORDS = 0x250, 20_000, 120_000


class Recent(dict):
    """Answers of a function to recent questions: the last `most` new ones at least, twice as many at most."""

    def __init__(self, answer: Callable[[str], bytes], most: int):
        super().__init__()
        self.answer, self.most, self.older = answer, most, {}

    def __missing__(self, question: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        found = self.older.get(question)
        self[question] = found = self.answer(question) if found is None else found
        return found


class WordTokenizer:
    """Token ids as little-endian bytes, remembered by word or by white-space-separated chunk.

    Texts of characters below U+0250, which NFC leaves alone and whose lower-casing is by character, are split into
    words by the tokenizer's own pattern and each word goes to its model. Any other text is cut at spaces and line
    ends, and each of its chunks that isn't so plain goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        low = [chr(c) for c in range(PLAIN)]
        letters, numbers = ("".join(c for c in low if unicodedata.category(c)[0] == kind) for kind in "LN")
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t-\r \x85\xa0{letters}{numbers}]+")
        self.odd = re.compile(f"[^\\0-{chr(PLAIN - 1)}]|<\\|")
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 65536 else "<u4")
        known = sorted({*range(33, 127), *range(161, 173), *range(174, 256)})
        others = [b for b in range(256) if b not in set(known)]
        self.shown = {b: chr(b) for b in known} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.chunks, self.words = Recent(self.chunk, MOST_CHUNKS), Recent(self.word, MOST_WORDS)

    def word(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.shown)
        return np.array([t.id for t in self.whole.model.tokenize(shown)], self.kind).tobytes()

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split.findall(text.lower())))

    def chunk(self, chunk: str) -> bytes:
        if self.odd.search(chunk):
            return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()
        return self.plain(chunk)

    def encode(self, text: str) -> np.ndarray:
        if self.odd.search(text):
            return np.frombuffer(b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" "))), self.kind)
        return np.frombuffer(self.plain(text), self.kind)


@lru_cache(maxsize=2)
def shared_tokenizer(path: str) -> WordTokenizer:
    """One a worker process, so that its caches serve all of the worker's tasks."""
    return WordTokenizer(path)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions of integer points (n x d, each below 2**bits) on the d-dimensional Hilbert curve (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = np.int64(1) << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), np.int64(1) << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], buckets: int = BUCKETS, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents given by token ids: hashed counts, root-damped, of length one, projected, quantised."""
    hashed = (np.arange(1 << 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % buckets
    project = np.random.default_rng(SEED).standard_normal((buckets, dimensions))
    counts = np.stack([np.bincount(hashed[a.astype(np.int64) & 0x1FFFF], minlength=buckets) for a in ids]) if ids else np.zeros((0, buckets))
    vectors = np.sqrt(counts)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    # about half of a projection comes from the mean of all documents; two standard deviations either side fill the grid
    place = (vectors @ project) / 2.5
    return hilbert_keys(np.clip((place + 0.5) * (1 << bits), 0, (1 << bits) - 1), bits)


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, curve_key, n, ids): ids as bytes, with END_ID at the end."""

    def encode(batches):
        tokenizer = shared_tokenizer(tokenizer_path)
        end = np.array([END_ID], tokenizer.kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [np.concatenate([tokenizer.encode(t), end]) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(curve_keys(ids)), pa.array([len(a) for a in ids], pa.int64()), pa.array([a.tobytes() for a in ids], pa.binary())],
                    ["doc_id", "curve_key", "n", "ids"],
                )

    prepare(docs.sparkSession)
    return keyed_text(docs, id_col, text_col).mapInArrow(encode, "doc_id long, curve_key long, n long, ids binary")


def along_curve(tokens: DataFrame) -> DataFrame:
    """tokens in curve order with the position of each document's first token in the whole stream (column `at`)."""

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch["n"].to_numpy()
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int32()), pa.array(starts), batch["doc_id"], batch["n"], batch["ids"]], ["part", "local", "doc_id", "n", "ids"])

    # doc_id in the range key parts even a large group of copies, which has one curve key
    ranges = tokens.repartitionByRange("curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id", "n")
    numbered = stored(ranges.mapInArrow(number, "part int, local long, doc_id long, n long, ids binary"), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = numbered.groupBy("part").agg(F.sum("n").alias("total"))  # a row for each range
    bases = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return numbered.join(F.broadcast(bases), F.col("part") == F.col("p")).select("doc_id", "n", "ids", (F.col("base") + F.col("local")).alias("at"))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian uint32 bytes).

    Every id of every document, END_ID included, lies in exactly one piece; sequences are numbered from 0 along the
    curve and all but the last are full, so padding is below `length` tokens over the whole corpus. Null and empty
    texts are one END_ID. Equal keys are ordered by doc_id, repeated rows are packed as often as they occur, an empty
    table gives no rows, and only the id and text columns are read.
    """
    placed = along_curve(stored(tokenized(docs, tokenizer_path, id_col, text_col), "tokens"))
    width = WordTokenizer(tokenizer_path).kind

    def cut(batches):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            out = []
            for doc_id, n, ids, at in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "ids", "at")), strict=True):
                wide = np.frombuffer(ids, width).astype("<u4")
                edges = [0, *range(length - at % length, n, length), n]
                for a, b in zip(edges, edges[1:], strict=False):
                    piece = wide[a:b].tobytes()
                    out.append((doc_id, a, b - a, zlib.crc32(piece), n, (at + a) // length, (at + a) % length, piece))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names)

    prepare(docs.sparkSession)
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
