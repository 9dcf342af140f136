"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: the runs of text between the edges of block elements. A block's features
are its ancestors' tags, words of their classes and ids, and its text. The field is trained on labelled pages, made in
many layouts by `labelled_page`, and the best path (Viterbi) says which blocks are content.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from quillstone.cluster import ship
from quillstone.llm import crf
from quillstone.llm.common import pieces

PAGES = 600  # labelled pages that the field is trained on
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "noscript", "template", "svg", "textarea", "iframe", "object", "math"}
_RAW_END = {t: re.compile(rf"</{t}\s*(?:>|\Z)", re.I) for t in _RAW}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_INLINE = {"a", "b", "i", "em", "strong", "span", "u", "s", "small", "sub", "sup", "code", "abbr", "cite", "q", "mark", "font", "time", "label", "kbd", "var", "big", "tt", "ins", "del", "bdi", "bdo", "img", "wbr"}
_TAGS = ("article", "main", "section", "nav", "header", "footer", "aside", "ul", "li", "div", "p", "h1", "h2", "h3", "table", "td", "form", "button", "blockquote", "pre", "figure", "title", "head", "a", "b", "select", "dl")
_TAG_NO = {t: k for k, t in enumerate(_TAGS)}
_TAG_NO |= {"ol": _TAG_NO["ul"], "th": _TAG_NO["td"], "h4": _TAG_NO["h3"], "h5": _TAG_NO["h3"], "h6": _TAG_NO["h3"], "strong": _TAG_NO["b"], "option": _TAG_NO["select"], "dt": _TAG_NO["dl"], "dd": _TAG_NO["dl"]}
_HINTS = (
    re.compile(r"(?:^|[-_ ])(?:ads?|adverts?|banner|sponsor|promo)", re.I),
    re.compile(r"nav|menu|breadcrumb|crumb|pager|pagination|toolbar|tabs", re.I),
    re.compile(r"side|related|widget|share|social|recommend|popular|tags", re.I),
    re.compile(r"foot|copyright|legal|cookie|consent|subscribe|newsletter|modal|popup", re.I),
    re.compile(r"comment|reply|disqus", re.I),
    re.compile(r"content|article|post|entry|story|body|main|text", re.I),
)
_SPACE = re.compile(r"[ \t\r\n\f\v ]+")
_SMALL = re.compile(r"©|all rights|cookie|privacy|sign in|log in|subscribe|read more|share|click|menu|copyright", re.I)
WIDTH = len(_TAGS) + len(_HINTS) + 14


def blocks(html: str) -> list[tuple[str, frozenset, int, int]]:
    """Leaf blocks in order: (text, ancestor marks, characters inside links, depth). Unclosed and crossed tags are closed by the next ancestor that matches; scripts, styles and comments are dropped."""
    out: list[tuple[str, frozenset, int, int]] = []
    stack: list[str] = []
    marks: list[frozenset] = [frozenset()]
    text: list[str] = []
    linked, in_link = 0, 0
    held = marks[0]

    def close() -> None:
        nonlocal text, linked
        if text:
            s = _SPACE.sub(" ", unescape("".join(text))).strip(" ")
            if s:
                out.append((s, held, linked, len(stack)))
        text, linked = [], 0

    at, n, match = 0, len(html), _TOKEN.match
    while at < n:
        m = match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                if not text:
                    held = marks[-1]
                text.append(s)
                linked += len(s) if in_link else 0
            continue
        name = name.lower()
        if m[1]:
            if name in stack:
                if name not in _INLINE:
                    close()
                while True:
                    gone = stack.pop()
                    marks.pop()
                    in_link -= gone == "a"
                    if gone == name:
                        break
            elif name == "p":
                close()
            continue
        if name in _RAW:
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else n
            continue
        if name not in _INLINE:
            close()
            if name == "p" and "p" in stack or name == "li" and "li" in stack and "ul" not in stack[len(stack) - stack[::-1].index("li") :]:
                while True:  # the element before ends here
                    gone = stack.pop()
                    marks.pop()
                    in_link -= gone == "a"
                    if gone == name:
                        break
        if name in _VOID or m[3].endswith("/"):
            if name == "br" and text:
                text.append(" ")
            continue
        found = {_TAG_NO[name]} if name in _TAG_NO else set()
        for a in _ATTR.finditer(m[3]):
            value = a[1] or a[2] or a[3] or ""
            found |= {len(_TAGS) + k for k, p in enumerate(_HINTS) if p.search(value)}
        stack.append(name)
        marks.append(marks[-1] | found if found else marks[-1])
        in_link += name == "a"
    close()
    return out


def features(page: list[tuple[str, frozenset, int, int]]) -> np.ndarray:
    x = np.zeros((len(page), WIDTH))
    base = len(_TAGS) + len(_HINTS)
    for i, (s, marks, linked, depth) in enumerate(page):
        for k in marks:
            x[i, k] = 1.0
        n, words = len(s), s.count(" ") + 1
        x[i, base : base + 9] = (np.log1p(n), np.log1p(words), min(1.0, linked / n), (s.count(".") + s.count(",")) / words, s[-1] in ".!?…", n / words / 10, bool(_SMALL.search(s)) if n < 400 else 0.0, (s.count("|") + s.count("»") + s.count("/")) / words, depth / 10)
    if len(page):
        place = np.arange(len(page)) / max(1, len(page) - 1)
        size = x[:, base]
        x[:, base + 9], x[:, base + 10] = place < 0.2, place > 0.8
        x[1:, base + 11] = size[:-1]
        x[:-1, base + 12] = size[1:]
        x[:, base + 13] = size - size.max()
    return x


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page in one of many layouts, and the texts of its content blocks."""
    syllables = "an er in on re th en at or es st ti ou ha nd ing al de la que ción ment eau ung keit sch ver au".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    junk = rng.random() < 0.15

    def prose(least: int, most: int) -> str:
        n = rng.randint(least, most)
        ws = [word() + (rng.choice((",", ".", "")) if rng.random() < 0.25 else "") for _ in range(n)]
        s = (" | " if junk and rng.random() < 0.6 else " ").join(ws)
        return s[0].upper() + s[1:] + ("" if junk else ".")

    def links(n: int) -> str:
        items = [f'<a href="/{k}">{" ".join(word() for _ in range(rng.randint(1, 3)))}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    content: list[str] = []

    def keep(s: str) -> str:
        content.append(s)
        return s

    title = prose(3, 10)
    open_, shut = rng.choice((("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="content"><div class="entry">', "</div></div>"), ("<article><section>", "</section></article>"), ('<div class="story-body">', "</div>"), ("<div>", "</div>")))
    body = [f"<h1>{keep(title)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        if kind < 0.6:
            body.append(f"<p>{keep(prose(4, 90))}</p>" if rng.random() < 0.6 else f"<p>{keep(prose(4, 90))}")
        elif kind < 0.72:
            body.append(f"<p><b>{keep(prose(10, 60))}</b><br><p>{keep(prose(4, 60))}</p>")
        elif kind < 0.8:
            body.append(f"<h2>{keep(prose(2, 7))}</h2>")
        elif kind < 0.86:
            body.append("<ul>" + "".join(f"<li>{keep(prose(4, 18))}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
        elif kind < 0.9:
            body.append(f"<blockquote>{keep(prose(8, 30))}</blockquote>")
        elif kind < 0.94:
            body.append(f"<table><tr><td>{keep(prose(2, 8))}</td><td>{keep(prose(2, 8))}</td></tr></table>")
        else:
            body.append(rng.choice((f'<div class="ad">{prose(4, 25)}</div>', f'<aside class="related">{links(3)}</aside>', f'<div class="share-buttons">{prose(1, 3)}</div>')))
    top = rng.choice((f"<nav>{links(rng.randint(3, 9))}</nav>", f'<div class="menu">{links(rng.randint(3, 8))}</div>', f"<header><nav>{links(5)}</nav></header>", f'<header><div id="top">{prose(2, 6)}</div></header>', ""))
    ad = rng.choice((f'<!-- ad 1 --><div class="ad">{prose(5, 40)}</div>', f'<div class="ad-banner">{prose(3, 25)}</div>', f'<div id="sponsor">{prose(3, 40)}</div>', ""))
    side = rng.choice((f"<aside>{prose(3, 30)}</aside>", f'<div class="sidebar">{links(6)}</div>', f'<div class="widget related">{prose(4, 20)}</div>', ""))
    after = rng.choice((f'<div class="comments"><p>{prose(4, 40)}</p><p>{prose(4, 30)}</p></div>', f'<div class="cookie-consent">{prose(5, 20)}</div>', f'<form><button>{word()}</button></form>', ""))
    foot = rng.choice((f"<footer>{prose(3, 40)}</footer>", f"<footer>© 2024 {word()} <p>{prose(3, 12)}</p></footer>", f'<div class="footer">{links(4)}</div>', ""))
    html = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style></head><body>{top}{ad if rng.random() < 0.7 else ""}{side if rng.random() < 0.5 else ""}{open_}{"".join(body)}{shut}{side if rng.random() < 0.5 else ""}{after}{foot}</body></html>'
    return html, content


def labelled_blocks(rng: random.Random) -> tuple[list, list[int]]:
    """A labelled page's blocks and their labels, 1 for content. The page's title is no content."""
    html, content = labelled_page(rng)
    page = blocks(html)
    wanted = [_SPACE.sub(" ", c).strip(" ") for c in content]
    labels, k = [], 0
    for s, marks, *_ in page:
        good = k < len(wanted) and s == wanted[k] and _TAG_NO["head"] not in marks
        k += good
        labels.append(int(good))
    return page, labels


@cache
def model(pages: int = PAGES, seed: int = 11) -> crf.Crf:
    """The field trained on so many labelled pages."""
    rng = random.Random(seed)
    made = [labelled_blocks(rng) for _ in range(pages)]
    return crf.train(np.vstack([features(p) for p, _ in made]), np.array([y for _, ys in made for y in ys]), np.array([len(p) for p, _ in made]), rounds=150)


def extract_pages(field: crf.Crf, htmls: list[str]) -> list[tuple[str, int, int]]:
    """(text, blocks, content blocks) of each page; content blocks are joined by newlines."""
    pages = [blocks(h) for h in htmls]
    lengths = np.array([len(p) for p in pages], dtype=np.int64)
    if not lengths.sum():
        return [("", 0, 0)] * len(htmls)
    labels = field.viterbi(np.vstack([features(p) for p in pages if p]), lengths)
    out, at = [], 0
    for p in pages:
        kept = [b[0] for b, y in zip(p, labels[at : at + len(p)].tolist()) if y]
        at += len(p)
        out.append(("\n".join(kept), len(p), len(kept)))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", field: crf.Crf | None = None) -> DataFrame:
    """Each row's id, its main text, number of leaf blocks and of content blocks.

    Null HTML: null text, 0 blocks. Empty HTML or HTML without text: empty text, 0 blocks. Text without tags is one block.
    Repeated rows and null ids are kept; other columns are ignored. One pass over whole pages, no shuffle.
    """
    spark = pages.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(field or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            given = batch.column(1).to_pylist()
            found = extract_pages(sent.value, [h or "" for h in given])
            texts = [None if h is None else f[0] for h, f in zip(given, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string()), pa.array([f[1] for f in found], type=pa.int32()), pa.array([f[2] for f in found], type=pa.int32())], ["id", "text", "blocks", "content_blocks"])

    picked = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("text"))
    schema = StructType().add("id", pages.schema[id_col].dataType).add("text", StringType()).add("blocks", IntegerType()).add("content_blocks", IntegerType())
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
