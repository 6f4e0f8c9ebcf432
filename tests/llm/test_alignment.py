"""Cross-tokenizer alignment against both libraries over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lakeshelf.llm import alignment

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [" ", "  ", "\n", "\n\n", "\r\n", "\t", " \n ", "\xa0", "　", "\x1c", "\x85", ".", "'s", "don't", "naïve", "世界", "\U0001f600", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "a", "the", "And", "123", "-->", ";\r", "\x00", "é", "é", "​", "▁"]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    shown = {k: chr(k) for k in (*range(33, 127), *range(161, 173), *range(174, 256))}
    rest = [k for k in range(256) if k not in shown]
    byte = {c: k for k, c in (shown | {k: chr(256 + n) for n, k in enumerate(rest)}).items()}

    def groups(text):
        """[(A ids, B ids)] of a whole text."""
        if not text:
            return []
        raw = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        out, i, j = [], 0, 0
        after_a, after_b = ({e: k + 1 for k, e in enumerate(ends)} for ends in (ends_a, ends_b))
        for end in sorted({*ends_a} & {*ends_b}):
            u, v = after_a[end], after_b[end]
            out.append((ids_a[i:u], ids_b[j:v]))
            i, j = u, v
        return out

    return groups


def brute(groups, rows):
    every = [groups(t) for _, t in rows]
    held = Counter(p for g in every for p in {(x, y) for a, b in g for x in a for y in b})
    best: dict = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, _), g in zip(rows, every, strict=True):
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        sums = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links))
        out.append(str((i, *sums, hashlib.sha256(text.encode()).hexdigest() if g else "")))
    return sorted(out)


def found(df):
    return sorted(str((*(r[c] for c in alignment.RESULT), r["groups_sha256"])) for r in alignment.align(df, BYTES, PIECES).collect())


def odd_texts(seed, n):
    rng = random.Random(seed)
    return [(k, "".join(rng.choice(ODD[: rng.choice((8, 31, 31, 32))]) + rng.choice(("", " ", " ", "\n")) for _ in range(rng.randrange(30)))) for k in range(n)]


def test_odd_texts_equal_the_libraries(spark, plain):
    rows = [*odd_texts(1, 400), (1000, None), (1001, ""), (1002, " "), (1003, "  \n"), (1004, "a▁b"), (None, "the end ")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(plain, rows)  # U+2581 can't be given back


def test_documents_equal_the_libraries(documents, plain):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert found(documents) == brute(plain, rows)


def test_many_chunks_narrow_their_ranges(spark, documents, plain, monkeypatch):
    for name, value in {"CHUNK": 3000, "MOST_SHARING": 2, "WORDS": 64, "MANY_LINKS": 3}.items():
        monkeypatch.setattr(alignment, name, value)
    rows = [(r["doc_id"], r["text"]) for r in documents.where("doc_id < 60").select("doc_id", "text").collect()]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)) == brute(plain, rows)


def test_cuts_are_verified():
    assert alignment.Tokenizers(BYTES, PIECES).cuts == " \t\n\x0b\x0c"  # pieces such as ;\r go on past \r
    cutter = alignment.Cutter(" \n")
    assert cutter.segments(" a\r\nb c\n d \n") == [" a\r\nb", " c", "\n d \n"]
    assert alignment.Cutter("").segments(" a b") == [" a b"]


def test_a_group_of_many_links_counts_as_pair_by_pair(monkeypatch):
    rng = np.random.default_rng(3)
    one = alignment.Alignments([np.array([2, 1]), np.array([5, 1, 7]), np.array([4, 2, 6]), rng.integers(0, 4, 13), rng.integers(0, 4, 12)])
    want = Counter()
    for s, p, n in zip(*one.links(), strict=True):
        want[int(s), int(p)] += int(n)
    monkeypatch.setattr(alignment, "MANY_LINKS", 1)
    got = Counter()
    for s, p, n in zip(*one.links(), strict=True):
        got[int(s), int(p)] += int(n)
    assert got == want and sum(want.values()) == 20 + 2 + 42


def test_awkward_rows(spark, awkward, nothing, plain):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    assert found(awkward) == brute(plain, rows)
    assert found(nothing) == []
    groups = alignment.align(awkward.where("doc_id = 9"), BYTES, PIECES, with_groups=True).first()["groups"]
    assert groups == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain("two words"))
