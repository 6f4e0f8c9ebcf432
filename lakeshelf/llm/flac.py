"""FLAC media columns: lossless storage of 8-bit samples, and a decoder that works on all frames of a batch at once.

The encoder takes the fixed linear predictor with the smallest residual for each frame, codes it in Rice partitions, and
writes stream info (with the samples' MD5) and a seek table. The decoder reads the seek table, decodes constant,
verbatim, fixed and LPC subframes with Rice codes of both kinds and their escape, verifies the CRC-8 of every header and
the CRC-16 of every frame, and gives PCM blocks with their sample offsets. Frames of all files in a batch are lanes of
NumPy arrays: step k decodes residual k of every lane.

The subset of the format read here is mono with 8 bits a sample and fixed-size blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import keyed_text, prepare

BLOCK, RATE, LEAST_BLOCK, PARTITION_ORDER = 2048, 8000, 16, 2
PAD = 64


def crc_table(bits: int, polynomial: int) -> np.ndarray:
    value = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        value = np.where(value & (1 << (bits - 1)), (value << 1) ^ polynomial, value << 1) & ((1 << bits) - 1)
    return value


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)
_ZEROS = np.array([16 - int(k).bit_length() for k in range(1 << 16)], np.int64)  # leading zeros of 16 bits


def lane_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRCs of many spans of data; lanes are ordered by length so that finished ones fall away."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    crc = np.zeros(len(starts), np.int64)
    live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    for k, n in enumerate(live):
        crc[:n] = table[(crc[:n] >> (bits - 8)) ^ data[starts[:n] + k]] ^ ((crc[:n] << 8) & ((1 << bits) - 1))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def coded_number(n: int) -> bytes:
    """A frame number in the format's UTF-8-like coding."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (7 - len(tail)) & 0xFF) | n, *tail[::-1]])


class Encoder:
    """Encodes a batch of byte strings; frames of all files are rows of one array per frame length."""

    def __init__(self, block: int = BLOCK):
        self.block = block

    def encode(self, payloads: list[bytes]) -> list[bytes]:
        frames: dict[tuple[int, int], bytes] = {}
        by_length: dict[int, list[tuple[int, int]]] = {}
        for k, p in enumerate(payloads):
            for number, at in enumerate(range(0, len(p), self.block)):
                by_length.setdefault(min(self.block, len(p) - at), []).append((k, number))
        for n, members in by_length.items():
            for at in range(0, len(members), 1024):
                part = members[at : at + 1024]
                samples = np.stack([np.frombuffer(payloads[k], np.uint8, n, number * self.block) for k, number in part]).astype(np.int64) - 128
                frames.update(zip(part, self.frames(samples, [number for _, number in part]), strict=True))
        return [self.file(k, p, frames) for k, p in enumerate(payloads)]

    def file(self, k: int, payload: bytes, frames: dict) -> bytes:
        parts = [frames[k, number] for number in range(-(-len(payload) // self.block))]
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        sizes = [len(p) for p in parts]
        info = self.block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        offsets = np.cumsum([0, *sizes])
        seek = b"".join((i * self.block).to_bytes(8, "big") + int(offsets[i]).to_bytes(8, "big") + min(self.block, len(payload) - i * self.block).to_bytes(2, "big") for i in range(len(parts)))
        return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(parts)

    def header(self, number: int, n: int) -> bytes:
        head = bytes([0xFF, 0xF8, 0x74, 0x02]) + coded_number(number) + (n - 1).to_bytes(2, "big")  # 16-bit block size, 8 kHz, mono, 8 bits
        crc = 0
        for b in head:
            crc = int(CRC8[crc ^ b])
        return head + bytes([crc])

    def frames(self, x: np.ndarray, numbers: list[int]) -> list[bytes]:
        lanes, n = x.shape
        heads = [self.header(number, n) for number in numbers]
        orders = [x]
        for _ in range(min(4, n - 1)):
            orders.append(np.diff(orders[-1], axis=1))
        tail = len(orders) - 1
        best = np.argmin([np.abs(r[:, tail - k :]).sum(axis=1) for k, r in enumerate(orders)], axis=0)
        residual = np.zeros((lanes, n), np.int64)
        for k, r in enumerate(orders):
            residual[best == k, k:] = r[best == k]
        folded = np.where(residual < 0, -2 * residual - 1, 2 * residual)
        order = PARTITION_ORDER if n % (1 << PARTITION_ORDER) == 0 and n >> PARTITION_ORDER > 4 else 0
        parts = 1 << order
        size = n >> order
        place = np.arange(n)
        used = place[None, :] >= best[:, None]
        # the parameter with the fewest bits in each partition
        costs = [np.where(used, (folded >> k) + 1 + k, 0).reshape(lanes, parts, size).sum(axis=2) for k in range(8)]
        parameter = np.argmin(costs, axis=0)
        k = np.repeat(parameter, size, axis=1)
        length = np.where(used, (folded >> k) + 1 + k, 0)
        length[:, ::size] += 4  # a partition's parameter precedes its first sample
        warm = best
        # subframe header, warm-up samples, coding method and partition order, partitions
        room = -(-(8 + 8 * warm + 6 + length.sum(axis=1)) // 8)
        base = np.array([len(h) for h in heads])
        starts = np.concatenate([[0], np.cumsum(base + room + 2)])
        out = np.zeros(starts[-1] * 8, np.uint8)
        origin = (starts[:-1] + base) * 8

        def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
            for b in range(width):
                out[at + b] = value >> (width - 1 - b) & 1

        put(origin, (8 + best) << 1, 8)
        put(origin + 8 + 8 * warm, np.full(lanes, order), 6)
        begin = np.cumsum(length, axis=1) - length + (origin + 8 + 8 * warm + 6)[:, None]
        for j in range(4):
            rows = np.flatnonzero(warm > j)
            put(origin[rows] + 8 + 8 * j, x[rows, j] & 0xFF, 8)
        for p in range(parts):
            put(begin[:, p * size], parameter[:, p], 4)
        begin[:, ::size] += 4
        stop = begin + (folded >> k)
        out[stop[used]] = 1
        for width in range(1, 8):
            some = used & (k == width)
            if some.any():
                put(stop[some] + 1, folded[some] & ((1 << width) - 1), width)
        data = np.packbits(out)
        for i, h in enumerate(heads):
            data[starts[i] : starts[i] + base[i]] = np.frombuffer(h, np.uint8)
        crc = lane_crcs(data, starts[:-1], base + room, CRC16, 16)
        data[starts[1:] - 2], data[starts[1:] - 1] = crc >> 8, crc & 0xFF
        flat = data.tobytes()
        return [flat[a:b] for a, b in zip(starts, starts[1:], strict=False)]


class Corrupt(ValueError):
    pass


class Bits:
    """Many bit positions in one buffer, read together."""

    def __init__(self, data: np.ndarray):
        d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
        self.words = (d[:-4] << 32) | (d[1:-3] << 24) | (d[2:-2] << 16) | (d[3:-1] << 8) | d[4:]  # 40 bits from each byte on
        self.top = len(self.words) - 1

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The 32 bits from each position."""
        return (self.words[np.minimum(at >> 3, self.top)] >> (8 - (at & 7))) & 0xFFFFFFFF

    def read(self, at: np.ndarray, width) -> np.ndarray:
        return np.where(np.asarray(width) > 0, self.peek(at) >> (32 - np.maximum(width, 1)), 0)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        value = self.read(at, width)
        return np.where((np.asarray(width) > 0) & (value >> (np.maximum(width, 1) - 1) > 0), value - (np.int64(1) << np.asarray(width)), value)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        count = _ZEROS[self.peek(at) >> 16]
        more = np.flatnonzero(count == 16)
        while len(more):
            extra = _ZEROS[self.peek(at[more] + count[more]) >> 16]
            count[more] += extra
            if (count[more] > 1 << 20).any():
                raise Corrupt("a unary code has no end")
            more = more[extra == 16]
        return count


def stream(media: bytes) -> tuple[int, int, bytes, list[tuple[int, int, int]]]:
    """(block size, samples, MD5, [(first sample, byte offset in the file, samples)]) of a file."""
    if media[:4] != b"fLaC":
        raise Corrupt("not a FLAC file")
    at, info, seek, last = 4, None, None, False
    while not last:
        last, kind, size = media[at] >> 7, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            info = body
        elif kind == 3:
            seek = [(int.from_bytes(body[k : k + 8], "big"), int.from_bytes(body[k + 8 : k + 16], "big"), int.from_bytes(body[k + 16 : k + 18], "big")) for k in range(0, size, 18)]
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
        raise Corrupt("only mono with 8 bits a sample is read")
    if not seek and packed & 0xFFFFFFFFF:
        raise Corrupt("no seek table")
    points = [(s, at + o, n) for s, o, n in seek or () if s != (1 << 64) - 1]
    block, total = int.from_bytes(info[2:4], "big"), packed & 0xFFFFFFFFF
    if any(o >= len(media) for _, o, _ in points) or [(s, n) for s, _, n in points] != [(s, min(block, total - s)) for s in range(0, total, max(1, block))]:
        raise Corrupt("the seek table doesn't list the file's frames")
    return block, total, info[18:34], points


def residuals(bits: Bits, at: np.ndarray, sizes: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(residuals x lanes, positions after them); lanes in descending size, at: after the warm-up samples."""
    lanes, longest = len(at), int(sizes.max(initial=0))
    out = np.zeros((longest, lanes), np.int64)
    method = bits.read(at, 2)
    wide = np.where(method == 1, 5, 4)
    if (method > 1).any():
        raise Corrupt("reserved residual coding")
    size = sizes >> bits.read(at + 2, 4)
    at = at + 6
    k, raw = np.zeros(lanes, np.int64), np.full(lanes, -1, np.int64)
    live = np.searchsorted(-sizes, -np.arange(longest), "left")
    edge = np.zeros(lanes, np.int64)  # where a lane's next partition begins
    for i, n in enumerate(live):
        new = np.flatnonzero(edge[:n] == i)
        if len(new):
            edge[new] += size[new]
            k[new] = bits.read(at[new], wide[new])
            at[new] += wide[new]
            escaped = new[k[new] == (1 << wide[new]) - 1]
            raw[new] = -1
            raw[escaped] = bits.read(at[escaped], 5)
            at[escaped] += 5
        some = slice(0, n)
        p, kk = at[some], k[some]
        if i < 33:  # the first samples of a lane are its warm-up
            due = orders[some] <= i
            if not due.all():
                some = np.flatnonzero(due)
                p, kk = at[some], k[some]
        r = raw[some]
        esc = r >= 0
        if esc.any():
            q = np.zeros(len(p), np.int64)
            q[~esc] = bits.unary(p[~esc])
            value = (q << kk) | bits.read(p + q + 1, kk)
            value = np.where(value & 1, -(value >> 1) - 1, value >> 1)
            out[i, some] = np.where(esc, bits.signed(p, np.maximum(r, 0)), value)
            at[some] = p + np.where(esc, np.maximum(r, 0), q + 1 + kk)
        else:
            q = bits.unary(p)
            value = (q << kk) | bits.read(p + q + 1, kk)
            out[i, some] = (value >> 1) ^ -(value & 1)
            at[some] = p + q + 1 + kk
    return out, at


FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def decode_frames(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Samples (lane x sample, signed) of frames given by byte span, size and expected number; checksums are verified."""
    order = np.argsort(-sizes, kind="stable")
    starts, lengths, sizes, numbers = starts[order], lengths[order], sizes[order], numbers[order]
    lanes, longest = len(starts), int(sizes.max(initial=0))
    if lane_crcs(data, starts, lengths, CRC16, 16).any():  # over its own checksum too, a sound frame leaves 0
        raise Corrupt("a frame's CRC-16 is wrong")
    head = data[starts[:, None] + np.arange(4)].astype(np.int64)
    if (head[:, 0] != 0xFF).any() or (head[:, 1] != 0xF8).any():
        raise Corrupt("no frame at a seek point")
    first = data[starts + 4].astype(np.int64)
    coded = np.where(first < 0x80, 1, _ZEROS[(~first & 0xFF) << 8])  # bytes of the frame number
    number = np.where(first < 0x80, first, first & (0x7F >> coded))
    for k in range(1, int(coded.max(initial=1))):
        number = np.where(k < coded, number << 6 | data[np.minimum(starts + 4 + k, len(data) - 1)] & 0x3F, number)
    kind = head[:, 2] >> 4
    at = starts + 4 + coded
    if (number != numbers).any() or not np.isin(kind, (6, 7)).all():
        raise Corrupt("a frame's number or block size doesn't fit the seek table")
    wide = np.where(kind == 7, 2, 1)
    block = np.where(kind == 7, data[at].astype(np.int64) << 8 | data[at + 1], data[at]) + 1
    at = at + wide
    if (block != sizes).any() or lane_crcs(data, starts, at + 1 - starts, CRC8, 8).any():
        raise Corrupt("a frame's header is wrong")
    bits, at = Bits(data), (at + 1) * 8
    form = bits.read(at, 8)
    if (form & 0x81).any():
        raise Corrupt("padding or wasted bits are set")
    form = form >> 1
    at = at + 8
    fixed, lpc = (form >= 8) & (form <= 12), form >= 32
    if not (fixed | lpc | (form < 2)).all():
        raise Corrupt("reserved subframe")
    samples = np.zeros((longest, lanes), np.int64)
    samples[:, form == 0] = bits.signed(at[form == 0], 8)[None, :]
    for lane in np.flatnonzero(form == 1):
        samples[: sizes[lane], lane] = bits.signed(at[lane] + 8 * np.arange(sizes[lane]), 8)
    coded = np.flatnonzero(fixed | lpc)
    orders = np.where(fixed, form - 8, form - 31)[coded]
    at = at[coded]
    top = int(orders.max(initial=0))
    warm = np.zeros((top, len(coded)), np.int64)
    for j in range(top):
        some = orders > j
        warm[j, some] = bits.signed(at[some] + 8 * j, 8)
    at = at + 8 * orders
    weights, shift = np.zeros((top, len(coded)), np.int64), np.zeros(len(coded), np.int64)
    for o, w in enumerate(FIXED[: top + 1]):
        weights[: len(w), (orders == o) & fixed[coded]] = np.array(w, np.int64)[:, None]
    some = np.flatnonzero(lpc[coded])
    if len(some):
        precision = bits.read(at[some], 4) + 1
        shift[some] = bits.signed(at[some] + 4, 5)
        at[some] += 9
        for j in range(top):
            has = some[orders[some] > j]
            width = precision[orders[some] > j]
            weights[j, has] = bits.signed(at[has], width)
            at[has] += width
    found, _ = residuals(bits, at, sizes[coded], orders)
    if not lpc[coded].any():  # each fixed predictor of order o is undone by o running sums
        for o in range(5):
            lane = np.flatnonzero(orders == o)
            if len(lane):
                samples[:, coded[lane]] = undone(found[:, lane], warm[:, lane], o)
    else:
        values = found
        for i in range(longest):
            if i < top:
                values[i] = np.where(orders > i, warm[i], values[i])
            m = min(i, top)
            guess = (weights[:m] * values[i - m : i][::-1]).sum(axis=0) >> shift if m else 0
            values[i] += np.where(orders <= i, guess, 0)
        samples[:, coded] = values
    out = np.empty((lanes, longest), np.int8)
    out[order] = samples.T
    return out


def undone(residual: np.ndarray, warm: np.ndarray, order: int) -> np.ndarray:
    """Samples of fixed-predictor residuals: running sums that start from the warm-up samples' differences."""
    if not order:
        return residual
    levels = [warm[:order]]
    for _ in range(order - 1):
        levels.append(np.diff(levels[-1], axis=0))
    x = residual[order:]
    for k in range(order - 1, -1, -1):
        x = np.concatenate([levels[k][:1], levels[k][:1] + np.cumsum(x, axis=0)])
    return x


def decode(media: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """[(sample offset, PCM bytes)] of each file, unsigned 8-bit; the whole file's MD5 is verified too."""
    heads = [stream(m) for m in media]
    data = np.frombuffer(b"".join(media), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(m) for m in media])])
    lanes = [(k, s, base[k] + o, n, (points[i + 1][1] if i + 1 < len(points) else len(media[k])) - o, s // block) for k, (block, _, _, points) in enumerate(heads) for i, (s, o, n) in enumerate(points)]
    out: list[list[tuple[int, bytes]]] = [[] for _ in media]
    lanes.sort(key=lambda x: -x[3])
    for at in range(0, len(lanes), 4096):
        part = lanes[at : at + 4096]
        start, size, length, number = (np.array([x[j] for x in part], np.int64) for j in (2, 3, 4, 5))
        samples = decode_frames(data, start, length, size, number).view(np.uint8) ^ 0x80
        for (k, s, _, n, _, _), row in zip(part, samples, strict=True):
            out[k].append((s, row[:n].tobytes()))
    for blocks, (_, total, md5, _) in zip(out, heads, strict=True):
        blocks.sort()
        signed = (np.frombuffer(b"".join(b for _, b in blocks), np.uint8) ^ 0x80).tobytes()
        if len(signed) != total or hashlib.md5(signed).digest() != md5:
            raise Corrupt("the samples don't give the file's MD5")
    return out


def padded(text: bytes) -> bytes:
    return text + bytes(PAD - len(text) % PAD) if len(text) % PAD or not text else text


def features(pcm: bytes) -> str:
    """Exact figures of the samples: mean square, sign changes and mean step, each as a fraction."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    step = np.diff(x)
    return f"n={len(x)};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};travel={int(np.abs(step).sum())};peak={int(np.abs(x).max())}"


def batches_of(column: pa.Array, most: int = 2_000_000):
    """(first row, values) of runs of rows with about `most` bytes."""
    held, size, first = [], 0, 0
    for k, value in enumerate(column.cast(pa.binary()).to_pylist()):
        held.append(value)
        size += len(value or b"")
        if size >= most:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, media (a FLAC file of the UTF-8 text padded to a positive multiple of 64).

    Null texts count as empty (64 zero bytes). Equal texts give equal files. Of predictors that take equally many bits
    the first is taken. A very long text is one file of up to 932,067 blocks (1.9 GB), as many as a seek table lists.
    Repeated rows each get their row, an empty table gives none, and only the id and text columns are read.
    """

    def encode(batches):
        encoder = Encoder()
        for batch in batches:
            for first, texts in batches_of(batch["text"]):
                media = encoder.encode([padded(t) for t in texts])
                ids = batch["doc_id"].slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    prepare(docs.sparkSession)
    return keyed_text(docs, id_col, text_col).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def decoded_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The rows with blocks array<struct<sample_offset, pcm>> and feature; a broken file fails the job, null stays null."""

    def run(batches):
        for batch in batches:
            for first, files in batches_of(batch[media_col]):
                sound = [k for k, m in enumerate(files) if m is not None]
                blocks: list = [None] * len(files)
                for k, found in zip(sound, decode([files[k] for k in sound]), strict=True):
                    blocks[k] = [{"sample_offset": s, "pcm": b} for s, b in found]
                traits = [None if b is None else features(b"".join(x["pcm"] for x in b)) for b in blocks]
                part = batch.slice(first, len(files))
                columns = [*part.columns, pa.array(blocks, pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())]))), pa.array(traits, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "blocks", "feature"])

    prepare(media.sparkSession)
    kinds = ", ".join(f"`{c}` {t}" for c, t in media.dtypes)
    return media.mapInArrow(run, f"{kinds}, blocks array<struct<sample_offset: bigint, pcm: binary>>, feature string")


def samples_of(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(b""), lambda all_, b: F.concat(all_, b["pcm"]))


def digests(decoded: DataFrame) -> DataFrame:
    """The sizes and digests of rows with n_bytes, media and what decoded_media adds."""
    rows = decoded.select("doc_id", "n_bytes", "media", "feature", samples_of(F.col("blocks")).alias("payload"))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
