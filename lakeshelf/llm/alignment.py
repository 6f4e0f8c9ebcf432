"""Alignment of two tokenizers' tokens, segment by segment.

A text is cut before runs of white space where no token of either vocabulary goes on past the cut: that is verified for
every character that a run may start with, in both vocabularies and in how each splits a text before its merges. So a
segment's tokens are those that the whole text has there, and every cut ends a group of tokens.

Each task cuts its texts into chunks of documents and keeps a document as numbers of its chunk's distinct segments,
which are in the order of a hash. Ranges of that hash from all chunks meet, where each distinct segment is tokenised
and aligned once, and every chunk gets the alignments of its own. Chunks then compose documents twice: first to count
how many documents hold each pair of linked ids, then, when those counts have come back to the chunks that have the
pairs, to sum them over each document's links.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeshelf.llm.common import keyed_text, prepare, stored

SPACE, ASCII_SPACE = "▁", " \t\n\x0b\x0c\r"
#: Bytes of text of a chunk, beside its last document; ranges of the hash, as bits; bits of the hash; chunks that share a range.
CHUNK, RANGE_BITS, HASH_BITS, MOST_SHARING = 8 << 20, 8, 24, 256
#: Characters tokenised at once, and words of documents whose pairs are made distinct at once.
BLOB, WORDS = 1 << 16, 1 << 19
#: A group of more links than this is counted by its distinct ids.
MANY_LINKS = 4096
SCHEMA = "chunk long, kind int, part long, value long, data binary"
NAMES = ["chunk", "kind", "part", "value", "data"]
#: Kinds of rows, in the order in which a chunk reads them.
DOCUMENTS, SEGMENTS, COUNTS = 0, 1, 2


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of integers from 0 to 2^64 - 1 as compressed planes of bytes."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        head += [len(a), width]
        body.append(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = np.array(head, "<u8").tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    count = int(np.frombuffer(raw, "<u8", 1)[0])
    head, at, out = np.frombuffer(raw, "<u8", 2 * count, 8).reshape(-1, 2), 8 + 16 * count, []
    for n, width in head.tolist():
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(planes.view("<i8").reshape(-1))
        at += n * width
    return out


def flat_places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs of so many items from each start, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def row(chunk: int, kind: int, part: int, data: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([kind], pa.int32()), pa.array([part], pa.int64()), pa.nulls(1, pa.int64()), pa.array([data], pa.binary())], NAMES)


class Tokenizers:
    """Both tokenizers with the bytes of their tokens, and the characters before which a text may be cut.

    A is byte-level, B is a BPE model of pieces with byte fallback that puts a space before a text.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as file:
            config = json.load(file)
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        shown |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        byte = {c: b for b, c in shown.items()}
        self.a_bytes = self.table({i: bytes(map(byte.__getitem__, t)) for t, i in config["model"]["vocab"].items()})
        model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model.serialized_model_proto())
        rules = proto.normalizer_spec
        pieces = {i: bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() for i, p in enumerate(proto.pieces)}
        self.b_bytes = self.table(pieces)
        self.prefixed = rules.add_dummy_prefix
        rules.add_dummy_prefix = False  # the space is part of what is encoded
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        splits = config.get("pre_tokenizer") or {}
        by_pattern = splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space") and not config.get("normalizer")
        by_merges = self.prefixed and not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and proto.trainer_spec.model_type == 2 and proto.trainer_spec.byte_fallback and not any(p.type == 4 for p in proto.pieces)
        tokens = [t.decode(errors="replace") for t in (*self.a_bytes, *self.b_bytes)]  # a part of a character isn't white space
        crossed = {w for t in tokens for w in re.findall(rf"(?<=\S)[{ASCII_SPACE}]", t)}
        #: White space before which no token of either goes on.
        self.cuts = "".join(w for w in ASCII_SPACE if w not in crossed) if by_pattern and by_merges else ""

    @staticmethod
    def table(tokens: dict[int, bytes]) -> list[bytes]:
        return [tokens.get(i, b"") for i in range(max(tokens) + 1)]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for a text that starts with its space, or None if the bytes of either differ from the text's."""
        a, b, raw = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text), text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


class Cutter:
    """Cuts a text into segments, each a run of white space and what follows up to the next cut."""

    def __init__(self, cuts: str):
        self.cuts, self.words = cuts, re.compile(r"\s+\S+")
        self.odd = re.compile(rf"(?<=\S)[^\S{re.escape(cuts)}]")

    def segments(self, text: str) -> list[str]:
        """The segments of a text that starts with a space; white space at its end stays with the last one."""
        if not self.cuts:
            return [text]
        found = self.words.findall(text)
        if self.odd.search(text):
            merged: list[str] = []
            for s in found:
                if s[0] in self.cuts or not merged:
                    merged.append(s)
                else:
                    merged[-1] += s
            found = merged
        rest = text[sum(map(len, found)) :]
        if rest:
            found[-1:] = [found[-1] + rest] if found else [rest]
        return found


class Alignments:
    """Groups of several segments: of each segment the number of groups, of each group the numbers of A and B ids, and the ids.

    A segment without groups has tokens that don't give its bytes.
    """

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays
        self.groups, self.n_a, self.n_b, self.a, self.b = arrays
        self.first_group = np.cumsum(self.groups) - self.groups
        self.first_a, self.first_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b

    @classmethod
    def joined(cls, several: list[Alignments]) -> Alignments:
        none = [np.zeros(0, np.int64)]
        return cls([np.concatenate(none + [x.arrays[k] for x in several]) for k in range(5)])

    @classmethod
    def of(cls, tokenizers: Tokenizers, segments: list[str]) -> Alignments:
        """Aligns segments: those that end in a character of a word are tokenised one after the other as one text."""
        out = []
        for alone, run in groupby(segments, lambda s: s[-1:].isspace()):
            blob: list[str] = []
            for s in run:
                blob.append(s)
                if alone or sum(map(len, blob[-64:])) >= BLOB or len(blob) * 8 >= BLOB:
                    out += cls.of_blob(tokenizers, blob)
                    blob = []
            out += cls.of_blob(tokenizers, blob) if blob else []
        return cls.joined(out)

    @classmethod
    def of_blob(cls, tokenizers: Tokenizers, segments: list[str]) -> list[Alignments]:
        found = tokenizers.encode("".join(segments))
        if found is None and len(segments) > 1:
            return [x for s in segments for x in cls.of_blob(tokenizers, [s])]
        if found is None:
            return [cls([np.zeros(n, np.int64) for n in (1, 0, 0, 0, 0)])]
        a, b = found
        ends_a, ends_b = np.cumsum(tokenizers.a_sizes[a]), np.cumsum(tokenizers.b_sizes[b])
        ends = np.cumsum([len(s.encode()) for s in segments])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not np.isin(ends, common).all():
            raise ValueError("a token goes on past a cut")
        counts = [np.bincount(np.searchsorted(common, e), minlength=len(common)) for e in (ends_a, ends_b)]
        return [cls([np.bincount(np.searchsorted(ends, common), minlength=len(segments)), *counts, a, b])]

    def take(self, some: np.ndarray) -> Alignments:
        """The alignments of some segments, in that order."""
        g = flat_places(self.first_group[some], self.groups[some])
        return Alignments([self.groups[some], self.n_a[g], self.n_b[g], self.a[flat_places(self.first_a[g], self.n_a[g])], self.b[flat_places(self.first_b[g], self.n_b[g])]])

    def sums(self, of_groups: np.ndarray) -> np.ndarray:
        """Sums over the groups of each segment."""
        total = np.concatenate([[0], np.cumsum(of_groups)])
        return total[self.first_group + self.groups] - total[self.first_group]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, pair, times): the linked id pairs (A id << 32 | B id); a pair can come more than once for a segment."""
        of_group = np.repeat(np.arange(len(self.groups)), self.groups)
        many = np.flatnonzero(self.n_a * self.n_b > MANY_LINKS)
        n = self.n_a * self.n_b
        n[many] = 0
        g = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
        pair = self.a[self.first_a[g] + within // np.maximum(self.n_b[g], 1)] << 32 | self.b[self.first_b[g] + within % np.maximum(self.n_b[g], 1)]
        out = [(of_group[g], pair, np.ones(len(g), np.int64))]
        for k in many:
            (a, times_a), (b, times_b) = (np.unique(x[f : f + m], return_counts=True) for x, f, m in ((self.a, self.first_a[k], self.n_a[k]), (self.b, self.first_b[k], self.n_b[k])))
            pair, times = (a[:, None] << 32 | b[None, :]).reshape(-1), (times_a[:, None] * times_b[None, :]).reshape(-1)
            out.append((np.full(len(pair), of_group[k]), pair, times))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def texts(self) -> list[str]:
        """Each segment's groups as `a1,a2|b1;a3|b2`; empty for a segment without groups."""
        at_a = np.arange(len(self.a)) + np.repeat(np.cumsum(self.n_b) - self.n_b, self.n_a)
        at_b = np.arange(len(self.b)) + np.repeat(np.cumsum(self.n_a), self.n_b)
        out = np.empty(2 * (len(at_a) + len(at_b)), object)
        names = np.array([str(k) for k in range(int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1)], object)
        out[2 * at_a], out[2 * at_b] = names[self.a], names[self.b]
        out[1::2] = ","
        ends = np.cumsum(self.n_a + self.n_b)
        out[2 * (ends - self.n_b) - 1] = "|"
        out[2 * ends - 1] = ";"
        some = np.flatnonzero(self.groups)
        out[2 * ends[self.first_group[some] + self.groups[some] - 1] - 1] = "\n"
        lines, texts = "".join(out.tolist()).split("\n"), [""] * len(self.groups)
        for k, line in zip(some.tolist(), lines, strict=False):
            texts[k] = line
        return texts


def hashes(segments: list[str]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, map(str.encode, segments)), np.int64, len(segments)) >> (32 - HASH_BITS)


def segment_rows(chunk: int, segments: list[str], of: np.ndarray, bits: int):
    """Rows of segments in the order of their hashes `of`, one for each range of 2^-bits of the hash."""
    part = of >> (HASH_BITS - bits)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            raw = [s.encode() for s in segments[a:b]]
            yield row(chunk, SEGMENTS, int(part[a]), packed([np.array(list(map(len, raw))), np.frombuffer(b"".join(raw), np.uint8)]))


def segments_of(data: bytes) -> list[str]:
    lengths, raw = unpacked(data)
    raw, ends = raw.astype(np.uint8).tobytes(), np.cumsum(lengths)
    return [raw[e - n : e].decode() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Chunks of documents (doc_id, text): a row of their ids, lengths and segment numbers, and rows of their segments."""

    def cut(batches):
        cutter, task, number = Cutter(Tokenizers(a_path, b_path).cuts), TaskContext.get().partitionId(), 0
        ids: list = []
        places: list[np.ndarray] = []
        known: dict[str, int] = {}
        size = 0

        def rows():
            segments = list(known)
            of = hashes(segments)
            order = np.argsort(of, kind="stable")
            new = np.empty(len(order), np.int64)
            new[order] = np.arange(len(order))
            chunk = task << 32 | number
            given = np.array([i is not None for i in ids], np.int64)
            numbers = np.array([i or 0 for i in ids], np.int64)
            lengths = np.array(list(map(len, places)), np.int64)
            every = new[np.concatenate([*places, np.zeros(0, np.int64)])] if len(new) else np.zeros(0, np.int64)
            yield row(chunk, DOCUMENTS, 0, packed([numbers.view(np.uint64), given, lengths, every]))
            yield from segment_rows(chunk, [segments[k] for k in order], of[order], RANGE_BITS)

        for batch in batches:
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                ids.append(i)
                places.append(np.fromiter((known.setdefault(s, len(known)) for s in cutter.segments(" " + text)), np.int32) if text else np.zeros(0, np.int32))
                size += len(text)
                if size >= CHUNK:
                    yield from rows()
                    ids, places, known, size, number = [], [], {}, 0, number + 1
        if ids:
            yield from rows()

    return docs.mapInArrow(cut, SCHEMA)


def by_key(batches, key: str):
    """Lists of rows of one key each, from batches sorted by it; a row is a dict."""
    return ((k, list(rows)) for k, rows in groupby((r for b in batches for r in b.to_pylist()), lambda r: r[key]))


def alignments(found: DataFrame, a_path: str, b_path: str, n_chunks: int) -> DataFrame:
    """Rows of the alignments of each chunk's segments, from its rows of segments: each distinct one is aligned once.

    Ranges of the hash are narrowed as chunks become more, so that what meets in one range stays bounded.
    """
    bits = min(HASH_BITS, RANGE_BITS + max(0, (n_chunks - 1) // MOST_SHARING).bit_length())

    def narrowed(batches):
        for r in (r for b in batches for r in b.to_pylist()):
            segments = segments_of(r["data"])
            yield from segment_rows(r["chunk"], segments, hashes(segments), bits)

    def align(batches):
        tokenizers = None
        for _, rows in by_key(batches, "part"):
            tokenizers = tokenizers or Tokenizers(a_path, b_path)
            known: dict[str, int] = {}
            places = [(r, np.array([known.setdefault(s, len(known)) for s in segments_of(r["data"])], np.int64)) for r in rows]
            every = Alignments.of(tokenizers, list(known))
            for r, some in places:
                yield row(r["chunk"], SEGMENTS, r["part"], packed(every.take(some).arrays))

    found = found.where(F.col("kind") == SEGMENTS)
    found = found.mapInArrow(narrowed, SCHEMA) if bits > RANGE_BITS else found
    return dealt(found, "part").sortWithinPartitions("part", "chunk").mapInArrow(align, SCHEMA)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows by key in as many partitions as the session shuffles to: rows are few and compressed, so they aren't to be coalesced by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


class Chunk:
    """A chunk's documents and the alignments of its segments."""

    def __init__(self, documents: bytes, segments: list[bytes]):
        numbers, given, self.lengths, self.places = unpacked(documents)
        self.ids = [int(i) if g else None for i, g in zip(numbers.tolist(), given.tolist(), strict=True)]
        self.every = Alignments.joined([Alignments(unpacked(s)) for s in segments])
        self.ends = np.cumsum(self.lengths)
        self.valid = (self.sums(self.every.groups == 0) == 0) & (self.lengths > 0)
        segment, pair, self.times = self.every.links()
        self.pairs, code = np.unique(pair, return_inverse=True)
        order = np.argsort(segment, kind="stable")
        self.code, self.times = code[order], self.times[order]
        self.n_codes = np.bincount(segment, minlength=len(self.every.groups))
        self.first_code = np.cumsum(self.n_codes) - self.n_codes

    def sums(self, of_segments: np.ndarray) -> np.ndarray:
        """For each document the sum over its segments."""
        total = np.concatenate([[0], np.cumsum(of_segments[self.places], dtype=np.int64)])
        return total[self.ends] - total[self.ends - self.lengths]

    def document_counts(self) -> np.ndarray:
        """For each pair the number of documents that hold it linked."""
        out, n = np.zeros(len(self.pairs), np.int64), len(self.every.groups)
        block = np.cumsum(self.lengths) // WORDS
        for b in np.unique(block):
            docs = np.flatnonzero((block == b) & self.valid)
            words = flat_places(self.ends[docs] - self.lengths[docs], self.lengths[docs])
            doc, segment = np.divmod(np.unique(np.repeat(np.arange(len(docs)), self.lengths[docs]) * n + self.places[words]), max(n, 1))
            codes = self.code[flat_places(self.first_code[segment], self.n_codes[segment])]
            held = np.unique(np.repeat(doc, self.n_codes[segment]) * len(out) + codes)
            out += np.bincount(held % max(len(out), 1), minlength=len(out))
        return out

    def composed(self, counts: np.ndarray, best: np.ndarray, with_groups: bool) -> pa.RecordBatch:
        """The documents' results, for the corpus-wide counts of `pairs` and whether each is the best of its A id."""
        every, valid = self.every, self.valid

        def by_link(value: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(value[self.code] * self.times)])
            return total[self.first_code + self.n_codes] - total[self.first_code]

        per_segment = [every.sums(every.n_a), every.sums(every.n_b), every.groups, every.sums(every.n_a * every.n_b), by_link(best.astype(np.int64)), by_link(counts)]
        out = [np.where(valid, self.sums(x), 0) for x in per_segment]
        texts = np.array([*every.texts(), ""], object)[:-1]
        groups = []
        for end, n, ok in zip(self.ends.tolist(), self.lengths.tolist(), valid.tolist(), strict=True):
            text = ";".join(texts[self.places[end - n : end]].tolist()) if ok else ""
            groups.append(text if with_groups else hashlib.sha256(text.encode()).hexdigest() if ok else "")
        return pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()), *map(pa.array, out), pa.array(groups, pa.string())], [*RESULT, "groups" if with_groups else "groups_sha256"])


RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def composed_chunks(batches):
    """(number, Chunk, pairs, values) of each chunk, from rows sorted by chunk, kind and part.

    Rows of counts are kept as arrays, all others are few.
    """
    held: dict = {}

    def done():
        pairs, values = (np.concatenate([*held["counts"][k], np.zeros(0, np.int64)]) for k in (0, 1))
        return held["chunk"], Chunk(held["documents"], held["segments"]), pairs, values

    for batch in batches:
        chunk, kind = batch["chunk"].to_numpy(), batch["kind"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1, [len(chunk)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held["chunk"] != chunk[a]:
                yield done()
                held = {}
            held = held or {"chunk": chunk[a], "segments": [], "counts": ([], [])}
            part = batch.slice(a, b - a)
            if kind[a] == DOCUMENTS:
                held["documents"] = part["data"][0].as_py()
            elif kind[a] == SEGMENTS:
                held["segments"] += part["data"].to_pylist()
            else:
                held["counts"][0].append(part["part"].to_numpy())
                held["counts"][1].append(part["value"].to_numpy())
    if held:
        yield done()


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups_sha256 or groups.

    A encodes a space and the text, B the text, to which it adds a space; offsets where tokens of both end cut them into
    groups, and all A-B occurrences within a group are links. A pair's count is the number of rows that hold it linked;
    n_best counts links whose pair has the highest count of its A id, ties included; count_sum sums counts over links.
    groups is `a1,a2|b1;a3|b2,b3`, groups_sha256 its digest. Texts that are null or empty, or whose tokens don't give
    back their bytes, have no tokens: zeros and ''. Rows that repeat count as often as they occur; null ids are kept.
    White space alone is text. A very long text is a chunk of its own, whole. An empty table gives no rows, and only the
    id and text columns are read.
    """
    spark = docs.sparkSession
    prepare(spark)
    name = "groups" if with_groups else "groups_sha256"
    rows = stored(chunks(keyed_text(docs, id_col, text_col), a_path, b_path), "chunks")
    documents = rows.where(F.col("kind") == DOCUMENTS)
    aligned = stored(alignments(rows, a_path, b_path, documents.count()), "alignments")
    known = documents.unionByName(aligned)

    def counted(batches):
        for number, chunk, _, _ in composed_chunks(batches):
            counts = chunk.document_counts()
            some = np.flatnonzero(counts)
            for at in range(0, len(some), 1 << 18):
                k = some[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), number)), pa.array(chunk.pairs[k]), pa.array(counts[k])], ["chunk", "pair", "n"])

    def composed(batches):
        for _, chunk, pairs, values in composed_chunks(batches):
            value = np.zeros(len(chunk.pairs), np.int64)
            value[np.searchsorted(chunk.pairs, pairs)] = values
            yield chunk.composed(value >> 1, value & 1, with_groups)

    pairs = dealt(known, "chunk").sortWithinPartitions("chunk", "kind", "part").mapInArrow(counted, "chunk long, pair long, n long")
    # a chunk has a pair once, so nothing can be combined before the shuffle, and no pair has more rows than there are chunks
    pairs = stored(pairs.select("chunk", "pair", F.sum("n").over(Window.partitionBy("pair")).alias("count")), "pairs")
    a_id = F.shiftright("pair", 32)
    best = pairs.groupBy(a_id.alias("a")).agg(F.max("count").alias("best"))  # a row for each id of A's vocabulary at most
    values = pairs.join(F.broadcast(best), a_id == F.col("a"))
    values = values.select("chunk", F.lit(COUNTS).alias("kind"), F.col("pair").alias("part"), (2 * F.col("count") + (F.col("count") == F.col("best")).cast("long")).alias("value"), F.lit(None).cast("binary").alias("data"))
    every = dealt(known.unionByName(values), "chunk").sortWithinPartitions("chunk", "kind", "part")
    return every.mapInArrow(composed, ", ".join([*(f"{c} long" for c in RESULT), f"{name} string"]))
