"""Main text of web pages by tag-path ratios.

Every block of text has a path: the block-level tags from the root down to it, with their classes. Per path the text's
length and punctuation per block are aggregated, damped by the share of link text, smoothed along the page, fused, and
thresholded; paths above the threshold are content. Containers that name themselves as something else (menus, adverts,
reader comments, forms and so on) by their tag are never content, unless a form, aside or header is a wrapper that holds
most of the scored text, or a form most of that in articles; by a word of their class, id or role their paths' scores are lowered and must still reach the best
other path's, unless the container holds an article or main element or, on pages without one, most of the scored text. A
container that names itself the article only raises the score of its paths. Beside content come the headings above it and
the short blocks that lie between its blocks on the page, below the elements right around content.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import prepare

TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)")
SPECIAL = re.compile("[\"'>]")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "noembed", "xmp"}
DROPPED = {"nav", "footer", "aside", "form", "head", "button", "select", "menu", "dialog", "object", "canvas", "audio", "video", "datalist", "fieldset"}
BLOCK = set(
    "html body head div p section article main header footer nav aside form h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address details summary hr fieldset legend center menu dialog hgroup option select button".split()
)
#: Of these, those that hold most of the scored text are wrappers.
WRAPPERS = {"form", "aside", "fieldset", "header"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag on the left ends an open element on the right of its own parent.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"tr", "thead"}, "tfoot": {"tr", "tbody"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE = {"article", "main"}
#: Words of a class or id that name a container as something other than the article, or as the article.
OTHER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar side rail widget nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead topbar footer bottom cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus discussion form search pager "
    "pagination paging toolbar skip copyright legal disclaimer paywall teaser trending popular tags hidden".split()
)
ARTICLE_WORDS = set("article articlebody content main post story entry".split())
#: The factor by which an article's name raises the fused score of a path.
RAISED = 2.0
#: The factor by which another container's name lowers it.
LOWERED = 0.1
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
KERNEL = np.exp(-0.5 * (np.arange(-1, 2) / 0.6) ** 2)


def words_of(rest: str) -> list[str]:
    found = " ".join(a or b or c for a, b, c in NAMES.findall(rest))
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower()) if w]


class Scanner:
    """Cuts a page into texts and tags in one pass, however broken it is: what a failed search has seen isn't searched again."""

    def __init__(self, page: str):
        self.page, self.gone, self.failed = page, set(), set()

    def find(self, what: str, at: int) -> int:
        found = -1 if what in self.gone else self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The place after the > that ends a tag, outside quotes if there is one; -1 if there is no > at all."""
        place, opened = at, []
        while found := SPECIAL.search(self.page, place):
            quote = found.start()
            if found[0] == ">":
                return quote + 1
            opened.append(quote)
            if quote in self.failed or (place := self.find(found[0], quote + 1) + 1) == 0:
                break
        self.failed.update(opened)
        return self.find(">", at) + 1 or -1

    def tokens(self):
        """(text, "", False, "") or ("", lower-case tag, whether it ends, attributes) in page order; no comments, no raw contents."""
        page, at = self.page, 0
        while at < len(page):
            start = self.find("<", at)
            if start != at:
                yield page[at : start if start > 0 else len(page)], "", False, ""
                if start < 0:
                    return
            at = start
            if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
                ends = "-->" if page[at + 2] == "-" else "]]>"
                at = self.find(ends, at + 4) + 3 if self.find(ends, at + 4) >= 0 else len(page)
                continue
            tag = TAG.match(page, at)
            end = self.tag_end(tag.end()) if tag else self.find(">", at) + 1 or -1 if page[at + 1 : at + 2] in ("!", "?") else -1
            if end < 0:
                yield "<", "", False, ""
                at += 1
                continue
            at = end
            if not tag:
                continue
            name, rest = tag["tag"].lower(), page[tag.end() : end - 1]
            if name in RAW and not tag["end"]:
                if not rest.rstrip().endswith("/"):
                    found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                    at = found.end() if found else len(page)
                continue
            yield "", name, bool(tag["end"]), rest


class Paths:
    """The root-to-leaf paths of a page, numbered from 0, the root's; parents come before their children."""

    def __init__(self):
        self.parent, self.label, self.depth, self.numbers = [0], [""], [0], {}

    def below(self, parent: int, label: str) -> int:
        number = self.numbers.setdefault((parent, label), len(self.label))
        if number == len(self.label):
            self.parent.append(parent)
            self.label.append(label)
            self.depth.append(self.depth[parent] + 1)
        return number

    def tag(self, path: int) -> str:
        return self.label[path].split(".")[0]


@dataclass(slots=True)
class Open:
    """An open element; what lies in it inherits all but its tag."""

    tag: str
    path: int
    dropped: bool  # by its tag, or as a part of such an element
    article: int  # the number of the outermost article container, or 0
    named: int  # the number of the innermost container with another name, or 0
    wrapped: int  # the number of the innermost WRAPPERS element, or 0
    inside: bool  # in an article or main element


@dataclass(slots=True)
class Block:
    at: Open
    text: str
    links: int


def blocks(page: str) -> tuple[list[Block], Paths, list[int]]:
    """The blocks with text in page order, the page's paths, and for each container with another name the one around it.

    Blocks in WRAPPERS that hold too little are dropped.
    """
    out, paths, parts, links, articles, others, wrappers, forms = [], Paths(), [], 0, 0, [0], [0], [False]
    open_, counts, in_link = [Open("", 0, False, 0, 0, 0, False)], Counter(), False

    def flush() -> None:
        nonlocal parts, links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(open_[-1], text, links))
        parts, links = [], 0

    def close(k: int) -> None:
        flush()
        counts.subtract(x.tag for x in open_[k:])
        del open_[k:]

    for text, tag, ends, rest in Scanner(page).tokens():
        if not tag:
            parts.append(text)
            links += len(text) if in_link else 0
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not ends
        elif tag not in BLOCK:
            continue
        elif tag in VOID:
            flush()
        elif ends:
            flush()
            if counts[tag] > 0:
                k = len(open_) - 1
                while open_[k].tag != tag:
                    k -= 1
                close(k)
        else:
            if open_[-1].tag == "p" or open_[-1].tag in CLOSES.get(tag, ()):
                close(len(open_) - 1)
                if open_[-1].tag in CLOSES.get(tag, ()):
                    close(len(open_) - 1)
            flush()
            names, outer, whole = words_of(rest) if rest else [], open_[-1], tag in ("html", "body")
            article, named = outer.article, outer.named
            if not whole and OTHER_WORDS.intersection(names) and not (tag in ARTICLE and "comment" not in names and "comments" not in names):
                others.append(named)
                named = len(others) - 1
            wrapped = outer.wrapped
            if tag in WRAPPERS and not (tag == "header" and article):
                wrappers.append(wrapped)
                forms.append(tag in ("form", "fieldset"))
                wrapped = len(wrappers) - 1
            dropped = outer.dropped or tag in DROPPED - WRAPPERS
            if not article and not dropped and not whole and tag not in HEADINGS and (tag in ARTICLE or ARTICLE_WORDS.intersection(names)):
                articles += 1
                article = articles
            path = paths.below(outer.path, ".".join([tag, *names]))
            open_.append(Open(tag, path, dropped, 0 if dropped else article, named, wrapped, not dropped and (outer.inside or tag in ARTICLE)))
            counts[tag] += 1
    flush()
    drop_parts(out, wrappers, forms)
    return out, paths, others


def drop_parts(found: list[Block], outer: list[int], forms: list[bool]) -> None:
    """Marks the blocks of WRAPPERS as dropped that hold most neither of the scored text nor, as a form, of that in articles."""
    gone = [True] * len(outer)
    for articles in (False, True):
        scored = [0] * len(outer)
        for b in found:
            if not b.at.dropped and (b.at.inside or not articles):
                scored[b.at.wrapped] += max(0, len(b.text) - b.links)
        total = sum(scored)
        for k in range(len(outer) - 1, 0, -1):
            gone[k] &= 2 * scored[k] <= total or articles and not forms[k]
            scored[outer[k]] += scored[k]
    gone[0] = False
    for k in range(1, len(outer)):
        gone[k] |= gone[outer[k]]
    for b in found:
        if gone[b.at.wrapped]:
            b.at.dropped, b.at.article, b.at.inside = True, 0, False


def lowered(found: list[Block], outer: list[int]) -> list[bool]:
    """Whether each block lies in a container with another name that isn't a wrapper.

    Wrappers hold an article or main element; on pages without one, they hold most of the scored text. outer: for each
    such container the one around it, which has a smaller number.
    """
    kept, size = [b for b in found if not b.at.dropped], len(outer)
    around: dict[int, int] = {}  # for each article the innermost container that all its blocks lie in
    seen = set()
    for b in kept:
        if b.at.inside:
            at, common = b.at.named, around.setdefault(b.at.article, b.at.named)
            while at > common and (b.at.article, at) not in seen:
                seen.add((b.at.article, at))
                at = outer[at]
            if at < common:
                while at != common:
                    common, at = (outer[common], at) if common > at else (common, outer[at])
                around[b.at.article] = common
    wide = [False] * size
    if around:
        for at in around.values():
            while at and not wide[at]:
                wide[at] = True
                at = outer[at]
    else:
        scored = [0] * size
        for b in kept:
            scored[b.at.named] += max(0, len(b.text) - b.links)
        total = sum(scored)
        for k in range(size - 1, 0, -1):
            wide[k] = 2 * scored[k] > total
            scored[outer[k]] += scored[k]
    low = [False] * size
    for k in range(1, size):
        low[k] = low[outer[k]] or not wide[k]
    return [low[b.at.named] for b in found]


def main_text(page: str) -> str:
    """The texts of the content paths' blocks, and of short ones beside them, joined by two line ends."""
    found, paths, others = blocks(page)
    if not found:
        return ""
    low = lowered(found, others)
    keys = [(b.at.path, is_low) for b, is_low in zip(found, low, strict=True)]  # a path counts apart where it is lowered
    number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    of, size = np.array([number[k] for k in keys]), len(number)
    n, chars, marks, links = (np.bincount(of, x, size) for x in ([1] * len(found), [len(b.text) for b in found], [len(PUNCTUATION.findall(b.text)) for b in found], [min(b.links, len(b.text)) for b in found]))
    dropped, is_low, article = (np.bincount(of, x, size) > 0 for x in ([b.at.dropped for b in found], low, [b.at.article > 0 for b in found]))
    open_share = 1 - links / chars
    fused = smoothed(chars / n * open_share) * smoothed((1 + marks) / n * open_share)
    fused[dropped] = 0
    fused[is_low] *= LOWERED
    least = fused.mean()
    fused[article & ~is_low] *= RAISED  # after the threshold is known, so that no other path falls below it
    best = fused[~is_low].max(initial=0.0)
    content = (fused > 0) & (fused >= np.where(is_low, max(least, best), least))
    parents = {paths.parent[path] for (path, is_low), k in number.items() if content[k] and not is_low}
    own = [content[k] and not b.at.dropped for b, k in zip(found, of, strict=True)]
    near = beside([b.at.path for b in found], own, parents, paths)
    chosen = []
    for b, ours, close, is_low in zip(found, own, near, low, strict=True):
        if (ours or close and not is_low and not b.at.dropped) and not linked_only(paths.tag(b.at.path), b.text, b.links):
            chosen.append(b.text)
    return "\n\n".join(chosen)


def beside(at: list[int], own: list[bool], parents: set[int], paths: Paths) -> list[bool]:
    """Whether each block belongs to content beside it; at: the blocks' paths, own: whether they are content.

    Only blocks below one of parents, the elements right around content, belong to it: headings if content follows before
    the page leaves these elements, other blocks if content or such a heading comes before and content comes after.
    Right below the body only headings do.
    """
    inside = [False] * len(paths.label)
    for path in range(1, len(inside)):
        up = paths.parent[path]
        inside[path] = inside[up] or up in parents and paths.depth[up] > 2
    out, leads = [False] * len(at), False
    for i in range(len(at) - 1, -1, -1):
        if own[i]:
            leads = True
        elif inside[at[i]] or paths.parent[at[i]] in parents:
            out[i] = leads and paths.tag(at[i]) in HEADINGS
        else:
            leads = False
    places = [i for i in range(len(at)) if own[i] or out[i]]
    return [out[i] or inside[at[i]] and places[0] < i < places[-1] for i in range(len(at))] if places else out


def linked_only(tag: str, text: str, links: int) -> bool:
    """A list item or cell that is a link and no more, as in a menu."""
    return tag in ("li", "td", "dd", "ul", "div") and links >= len(text) > 0


def smoothed(values: np.ndarray) -> np.ndarray:
    """A narrow Gaussian along the page's paths."""
    wide = np.concatenate([values[:1], values, values[-1:]])
    return np.convolve(wide, KERNEL / KERNEL.sum(), "valid")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text (blocks in page order, joined by two line ends), n_chars (code points).

    The whole html is read; character references are decoded and white space inside a block becomes one space. Pages
    that are null, empty or without content give an empty text. Broken markup is read leniently: open elements end with
    their parent, and a tag that never ends is text. Paths of equal score fare alike. A very long page is scanned once, in
    time and memory in proportion to it. Null ids and urls stay null, repeated rows each get their row, an empty table
    gives none, and only the named columns are read.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h) for h in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
