"""SentencePiece encoding that keeps offsets, and decoding.

Text is normalised by the longest-prefix rule of the model's compiled character map, and every normalised byte records
where it comes from, so each piece is projected to a span of the original UTF-8 bytes. Normalised text is cut before
each run of ▁; as no piece goes on past the start of such a run, the library encodes every distinct cut once and its
answer is remembered. With an empty map no prefix is ever longer than its own character, so a whole text is aligned at
once; with a map it is walked character by character.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import keyed_text, prepare

SPACE = "▁"
MOST_CUTS = 100_000  # that a worker remembers


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 prefixes and the texts that replace them."""

    def __init__(self, blob: bytes):
        self.units, self.texts = (), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """(bytes read, replacement) of the longest prefix of data[at:] in the map; (0, b"") if none is."""
        best, node, units = (0, b""), 0, self.units
        if not units:
            return best
        jump = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        node ^= jump(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= jump(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = (k + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return best


def utf8_length(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Normaliser:
    """normalised(text) gives the text that pieces are cut from, and for each of its bytes and its end the original byte."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.escape, self.trim = spec.add_dummy_prefix, spec.escape_whitespaces, spec.remove_extra_whitespaces
        self.plain = self.prefix and self.escape and not self.trim and not self.map.units

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        if self.plain:
            data = np.frombuffer(text.encode(), np.uint8)
            widths = np.where(data == 0x20, len(SPACE.encode()), 1)
            if not len(data):
                return "", np.zeros(1, np.int64)
            return SPACE + text.replace(" ", SPACE), np.concatenate([[0] * len(SPACE.encode()), np.repeat(np.arange(len(data)), widths), [len(data)]])
        data, out, source, at = text.encode(), bytearray(), [], 0
        parts = []  # (replacement, start, end) by the longest-prefix rule
        while at < len(data):
            n, new = self.map.longest(data, at)
            if not n:
                n = utf8_length(data[at])
                new = data[at : at + n]
            parts.append((new, at, at + n))
            at += n
        if self.trim:
            while parts and parts[0][0] in (b" ", b""):
                parts.pop(0)
            while parts and parts[-1][0] in (b" ", b""):
                parts.pop()
        space = SPACE.encode() if self.escape else b" "
        if self.prefix and parts:
            out += space
            source += [parts[0][1]] * len(space)
        spaced = self.trim
        for new, start, _ in parts:
            for k in range(len(new)):
                if new[k] == 0x20:
                    if not (self.trim and spaced):
                        out += space
                        source += [start] * len(space)
                else:
                    out.append(new[k])
                    source.append(start + k if new == data[start : start + len(new)] else start)
                spaced = new[k] == 0x20
        end = parts[-1][2] if parts else 0
        return out.decode(), np.array([*source, end], np.int64)


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        self.normaliser = Normaliser(proto.normalizer_spec)
        names = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        # a cut may stand alone if no piece holds a letter before a ▁ and no piece is matched ahead of the merges
        self.by_cut = self.normaliser.plain and not any(SPACE in n.lstrip(SPACE) for n in names) and not any(k == 4 for k in kinds)
        self.lengths = np.array([1 if k == 6 else len(n.encode()) for n, k in zip(names, kinds, strict=True)], np.uint32)
        self.cuts: dict[str, bytes] = {}
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*")
        self.begin, self.end = ([x] if x >= 0 else [] for x in (self.model.bos_id(), self.model.eos_id()))

    def learn(self, normal: list[str]) -> None:
        """Have the library encode all cuts of normalised texts that aren't known."""
        if len(self.cuts) > MOST_CUTS:
            self.cuts.clear()
        new = list({c for t in normal for c in self.cut.findall(t)}.difference(self.cuts))
        plain = [c[1:].replace(SPACE, " ") for c in new]
        for cut, ids in zip(new, self.model.encode(plain, num_threads=1) if new else (), strict=True):
            self.cuts[cut] = np.array(ids, "<u4").tobytes()
        # a cut of one ▁ is an empty text to the library, which gives no ids
        if SPACE in self.cuts:
            self.cuts[SPACE] = np.array([self.model.piece_to_id(SPACE)], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends) of each text, begin and end ids included: piece k covers bytes ends[k - 1] to ends[k]."""
        aligned = [self.normaliser.normalised(t) for t in texts]
        cut = [self.by_cut and SPACE not in t for t in texts]  # the library trims no ▁ that the text itself has
        self.learn([normal for (normal, _), whole in zip(aligned, cut, strict=True) if whole])
        return [self.projected(t, *a, whole) for t, a, whole in zip(texts, aligned, cut, strict=True)]

    def projected(self, text: str, normal: str, source: np.ndarray, by_cut: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and where each ends in the original: at the byte that the first normalised byte after it comes from."""
        if by_cut:
            ids = np.frombuffer(b"".join([self.cuts[c] for c in self.cut.findall(normal)]), "<u4")
        else:
            ids = np.array(self.model.encode(text), np.int64)
        lengths = self.lengths[ids].astype(np.int64)
        if not by_cut and lengths.sum() != len(source) - 1:  # pieces without a fixed text: take their surfaces from the library
            lengths = np.array([len(p.piece.encode()) for p in self.model.encode(text, return_type="proto").pieces], np.int64)
        ends = source[np.minimum(np.cumsum(lengths), len(source) - 1)] if len(ids) else np.zeros(0, np.int64)
        size = int(source[-1]) if self.normaliser.plain else len(text.encode())
        return np.concatenate([self.begin, ids, self.end]).astype("<u4"), np.concatenate([[0] * len(self.begin), ends, [size] * len(self.end)]).astype("<u4")


@lru_cache(maxsize=2)
def shared_codec(path: str) -> PieceCodec:
    """One a worker process, so that what it remembers serves all of the worker's tasks."""
    return PieceCodec(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids and ends (little-endian uint32 bytes), decoded.

    ids are the library's, with its begin and end ids and without sampling; piece k covers the original UTF-8 bytes
    from ends[k - 1] (0 for the first) to ends[k], so the spans cover the whole text in order. decoded is the library's
    decoding of ids. Null texts count as empty, which have the begin and end ids only; repeated rows each get their
    row, an empty table gives none, and only the id and text columns are read. Ties between segmentations are the
    library's. Very long texts are encoded whole; their alignment takes eight bytes for each of theirs.
    """

    def run(batches):
        codec = shared_codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part["text"].to_pylist()
                found = codec.encode(texts)
                decoded = [codec.model.decode(ids.tolist()) for ids, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([e.tobytes() for _, e in found], pa.binary()), pa.array(decoded, pa.string())],
                    ["doc_id", "ids", "ends", "decoded"],
                )

    prepare(docs.sparkSession)
    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, ends binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the digest of the pieces' ends, of encoded rows."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2("ends", 256).alias("ends_sha256"),
    )
