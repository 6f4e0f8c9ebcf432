"""FLAC round trips and corruption, pages by literal cases, and the registered queries against DuckDB."""

import hashlib
import math
import os
import time
import random
import zlib

import duckdb
import numpy as np
import pytest

from lakeshelf.llm import flac, html_extract, registry


def payloads():
    rng = random.Random(3)
    made = [b"", b"a", b"abc" * 5000, bytes(range(256)) * 20, rng.randbytes(5000), b"\x00" * 2048, b"\xff\x00" * 3000, "é世界 ".encode() * 700, b"x" * 64, rng.randbytes(2048 * 130)]
    return [flac.padded(t) for t in made]


def test_flac_round_trip():
    texts = payloads()
    files = flac.Encoder().encode(texts)
    for want, blocks in zip(texts, flac.decode(files), strict=True):
        at = 0
        for offset, pcm in blocks:
            assert offset == at
            at += len(pcm)
        assert b"".join(b for _, b in blocks) == want and len(want) % 64 == 0 < len(want)


def test_every_changed_byte_is_noticed():
    file = flac.Encoder().encode([flac.padded(b"some text to keep " * 20)])[0]
    for k in range(4 + 4 + 18, len(file)):
        broken = bytearray(file)
        broken[k] ^= 0x10
        try:
            same = flac.decode([bytes(broken)]) == flac.decode([file])
        except (flac.Corrupt, IndexError, ValueError):
            continue
        assert same and 42 <= k < 46 + 18  # a seek point's own header may be redundant, the samples never change


def lpc_frame(samples, weights, shift, precision):
    """One LPC frame, written bit by bit as the format says: an encoder of the decoder's other path."""
    n, order = len(samples), len(weights)
    bits = f"{0:01b}{31 + order:06b}0" + "".join(f"{s & 0xFF:08b}" for s in samples[:order]) + f"{precision - 1:04b}{shift:05b}" + "".join(f"{w & (1 << precision) - 1:0{precision}b}" for w in weights)
    bits += "00" + f"{0:04b}" + f"{2:04b}"
    for i in range(order, n):
        r = samples[i] - (sum(w * samples[i - 1 - j] for j, w in enumerate(weights)) >> shift)
        folded = 2 * r if r >= 0 else -2 * r - 1
        bits += "0" * (folded >> 2) + "1" + f"{folded & 3:02b}"
    bits += "0" * (-len(bits) % 8)
    body = flac.Encoder().header(0, n) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = 0
    for b in body:
        crc = int(flac.CRC16[(crc >> 8) ^ b]) ^ (crc << 8 & 0xFFFF)
    return body + crc.to_bytes(2, "big")


def test_lpc_frames_are_decoded():
    samples = [int(60 * np.sin(k / 7)) for k in range(300)]
    frame = np.frombuffer(lpc_frame(samples, [13, -6], 3, 6), np.uint8)
    got = flac.decode_frames(frame, np.array([0]), np.array([len(frame)]), np.array([300]), np.array([0]))
    assert got[0].tolist() == samples


def test_media_of_documents(documents, awkward, nothing):
    for df in (documents, awkward):
        texts = [(r["doc_id"], (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect()]
        want = sorted((str(i), len(t), len(flac.padded(t)), hashlib.sha256(flac.padded(t)).hexdigest(), zlib.crc32(flac.padded(t)[-64:])) for i, t in texts)
        rows = flac.digests(flac.decoded_media(flac.stored_media(df))).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
        assert len({r["media_sha256"] for r in rows}) == len({t for _, t in texts})
    assert flac.decoded_media(flac.stored_media(nothing)).collect() == []


def test_null_media_stay_null(spark):
    rows = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert flac.decoded_media(rows).first()["blocks"] is None


ARTICLE = "This is a sentence of the article, and it goes on for a while; it has marks. " * 4
PAGE = f"""<!doctype html><html><head><title>T</title><style>p {{}}</style></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies, of course. Accept them, please.</div>
<div class="article-body"><h1>A &amp; B</h1><p>{ARTICLE}</p><p>Short&nbsp;one
 here.</p><script>var x = "<p>no</p>";</script><p>{ARTICLE}<b>bold</b> end</p></div>
<aside><p>{ARTICLE}</p></aside><div id="comments"><p>{ARTICLE}</p></div><form><p>{ARTICLE}</p></form><footer>c</footer></body></html>"""
CLEAN = ARTICLE.strip()


def test_article_is_extracted():
    assert html_extract.main_text(PAGE) == f"A & B\n\n{CLEAN}\n\nShort one here.\n\n{CLEAN} bold end"
    unnamed = PAGE.replace("article-body", "x1")
    assert html_extract.main_text(unnamed) == html_extract.main_text(PAGE)


def test_article_names_only_raise_scores():
    page = f"<html><body><div class='post-meta'>By X</div><div class='text'><p>{ARTICLE}</p><p>{ARTICLE}</p></div></body></html>"
    assert html_extract.main_text(page) == f"{CLEAN}\n\n{CLEAN}"
    both = page.replace("By X", f"<p>{ARTICLE}</p><ul><li>A short item</li></ul>")
    assert html_extract.main_text(both) == f"{CLEAN}\n\nA short item\n\n{CLEAN}\n\n{CLEAN}"


@pytest.mark.parametrize("wrapper", ["<div class='content-sidebar-wrap'><main>{}</main></div>", "<div id='page' class='has-sidebar'><div>{}</div></div>", "<div class='hidden'><article>{}</article></div>"])
def test_wrappers_with_other_names_keep_their_text(wrapper):
    inner = f"<p>{ARTICLE}</p><p>{ARTICLE}</p><div class='comments'><p>Nice, thanks.</p></div>"
    assert html_extract.main_text(f"<html><body><nav><p>{ARTICLE}</p></nav>{wrapper.format(inner)}</body></html>") == f"{CLEAN}\n\n{CLEAN}"


def plain_selection(elements):
    """The texts that path ratios select, by the formulas and one element after the other; elements: (path, text)."""
    paths = list(dict.fromkeys(path for path, _ in elements))
    texts = {p: [t for q, t in elements if q == p] for p in paths}
    length = [sum(map(len, texts[p])) / len(texts[p]) for p in paths]
    marks = [(1 + sum(t.count(".") + t.count(",") for t in texts[p])) / len(texts[p]) for p in paths]
    side = math.exp(-0.5 / 0.36)

    def smooth(x):
        return [(side * x[max(k - 1, 0)] + x[k] + side * x[min(k + 1, len(x) - 1)]) / (1 + 2 * side) for k in range(len(x))]

    fused = [a * b for a, b in zip(smooth(length), smooth(marks), strict=True)]
    content = {p for p, f in zip(paths, fused, strict=True) if f >= sum(fused) / len(fused)}
    parents = {p[:-1] for p in content}
    inside = [any(len(q) > 2 and p[: len(q)] == q for q in parents) for p, _ in elements]
    chosen = {k for k, (p, _) in enumerate(elements) if p in content}
    for k, (p, _) in enumerate(elements):
        later = next((j for j in range(k, len(elements)) if elements[j][0] in content or not (inside[j] or elements[j][0][:-1] in parents)), None)
        if p[-1] == "h2" and later is not None and later > k and elements[later][0] in content:
            chosen.add(k)
    between = {k for k in range(len(elements)) if inside[k] and chosen and min(chosen) < k < max(chosen)}
    return [t for k, (_, t) in enumerate(elements) if k in chosen | between]


def test_path_ratios_equal_the_formulas():
    rng = random.Random(4)
    for _ in range(200):
        elements, page = [], "<html><body>"
        for _ in range(rng.randint(1, 5)):
            depth = rng.randint(0, 3)
            page += "<div>" * depth
            for _ in range(rng.randint(1, 5)):
                tag, text = rng.choice(("p", "h2", "pre")), rng.choice(("Menu", "One word, more.", "Some words, and. " * rng.randint(1, 9))).strip()
                page += f"<{tag}>{text}</{tag}>"
                elements.append((("html", "body", *["div"] * depth, tag), text))
            page += "</div>" * depth
        assert html_extract.main_text(page) == "\n\n".join(plain_selection(elements))


@pytest.mark.parametrize("page", ["<article>{}<div class='box'><p>Buy our shoes</p></div></article>", "<div class='content'>{}<div><span>Sign in to read more offers</span></div></div>", "<div class='box'><p>Buy our shoes</p></div><article>{}</article>"])
def test_an_article_name_does_not_take_in_what_scores_low(page):
    inner = f"<h1>Title</h1><div>By X</div><p>{ARTICLE}</p><ul><li>An item</li></ul><p>{ARTICLE}</p>"
    assert html_extract.main_text(f"<html><body>{page.format(inner)}</body></html>") == f"Title\n\nBy X\n\n{CLEAN}\n\nAn item\n\n{CLEAN}"


@pytest.mark.parametrize("wrapper", ["<form id='aspnetForm'>{}</form>", "<form><article>{}</article><div>Go</div></form>", "<header>{}</header>", "<aside><main>{}</main></aside>"])
def test_forms_and_headers_around_most_of_the_text_are_wrappers(wrapper):
    body = wrapper.format(f"<p>{ARTICLE}</p><p>{ARTICLE}</p><nav><p>{ARTICLE}</p></nav><form><p>Your name, please.</p></form>")
    assert html_extract.main_text(f"<html><body>{body}</body></html>") == f"{CLEAN}\n\n{CLEAN}"
    other = "<form><p>Write to us, and we answer.</p></form><aside><article>A teaser, with little text.</article></aside>"
    assert html_extract.main_text(f"<html><body>{body}{other}</body></html>") == f"{CLEAN}\n\n{CLEAN}"


def test_ratios_decide_between_paths_of_an_article(monkeypatch):
    page = f"<html><body><article><p>{ARTICLE}</p><div class='x'><p>Short one.</p></div></article></body></html>"
    assert html_extract.main_text(page) == CLEAN
    monkeypatch.setattr(html_extract, "smoothed", lambda values: values.max() - values + 1)
    assert html_extract.main_text(page) == "Short one."


@pytest.mark.parametrize("piece", ["<a href='", "<div>", "<div class='ad'>", "<a '>'", "</div>", "<p><b '\">", "<div>x</p>", "<article><p class='ad'>x"])
def test_broken_pages_take_linear_time(piece):
    began = time.process_time()
    html_extract.main_text(piece * 8_000)
    assert time.process_time() - began < 3


@pytest.mark.parametrize("page", ["", "<", "<p", "<p>", "</div>", "<!-- a", "<script>a", "&#x110000;&nbsp;", "<a href='", "<div " * 50, "<p>" * 3000, "plain text only"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_extract.main_text(page), str)


def test_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = html_extract.extract(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["n_chars"] > 200 for r in rows) > len(rows) * 0.8 and not any("<" in r["text"] and "</" in r["text"] for r in rows)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2)], "page_id long, url string, html string, text int")
    assert sorted(r["text"] for r in html_extract.extract(odd).collect()) == ["", "", ""]
    assert html_extract.extract(pages.where("false")).collect() == []


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{os.path.join(data, table)}.parquet')")
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(str([dict(zip(names, r, strict=True))[c] for c in columns]) for r in found.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want
