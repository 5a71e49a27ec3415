"""Main text of web pages: a linear-chain CRF over DOM leaf blocks.

A page is cut into leaf blocks (runs of text inside one block-level element),
each with features of its ancestors' tags and class names and of its text.  The
CRF has two labels, boilerplate and main; it is trained on labelled pages made
by `labelled_pages` and decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import sliced

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript textarea select option button svg math iframe object canvas audio video map datalist title xmp noembed noframes".split())
#: A start tag of the key closes an open element of the value, up to the stop elements.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table body html div article section".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: frozenset[str]  # features of the ancestors
    tag: str
    linked: int  # characters inside links


@dataclass(slots=True)
class _Open:
    """An open element.  All that its blocks need of its ancestors is kept here, so that nothing walks up the stack."""

    tag: str
    path: frozenset[str]  # features of it and its ancestors
    block: str  # tag of the nearest element that is no inline one
    paragraph: int  # depth of the open paragraph that a block inside would end, or -1
    stop: int  # depth of the nearest element that an omitted end tag can't cross, or -1


_TOP = _Open("", frozenset(), "", -1, -1)


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks in page order.  Unclosed and stray tags, a cut-off end and missing elements are repaired as browsers do.

    The cost is linear in the page's length, however deep elements nest: with
    `known`, ancestors contribute those features only, so a path is bounded.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    depths: dict[str, list[int]] = {}  # of the open elements of each tag
    parts: list[str] = []
    linked = hidden = links = at = 0
    top = _TOP

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, top.path, top.block, linked))
            parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    def push(tag: str, own: tuple[str, ...]) -> None:
        nonlocal hidden, links, top
        depth, inline = len(stack), tag in INLINE
        if known is not None:
            own = tuple(f for f in own if f in known)
        path = top.path if top.path.issuperset(own) else top.path.union(own)
        top = _Open(tag, path, top.block if inline else tag, depth if tag == "p" else top.paragraph if inline else -1, depth if tag in STOPS else top.stop)
        stack.append(top)
        depths.setdefault(tag, []).append(depth)
        hidden += tag in HIDDEN
        links += tag == "a"

    def close(depth: int) -> None:
        """Ends the elements from `depth` on."""
        nonlocal hidden, links, top
        while len(stack) > depth:
            tag = stack.pop().tag
            depths[tag].pop()
            hidden -= tag in HIDDEN
            links -= tag == "a"
        top = stack[-1] if stack else _TOP

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = max(m.end(), at + 1)
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if depths.get(tag):
                if tag not in INLINE:
                    flush()
                close(depths[tag][-1])
            elif tag == "p":  # stands for an empty paragraph
                flush()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag not in INLINE:
            flush()
            if top.paragraph >= 0:  # a block ends an open paragraph
                close(top.paragraph)
            ended = [d[i] for t in CLOSES.get(tag, ()) if (d := depths.get(t)) and (i := bisect_right(d, top.stop)) < len(d)]
            if ended:
                close(min(ended))
            if tag == "body" and hidden:  # a head without its end
                while stack and hidden:
                    close(len(stack) - 1)
        if tag in VOID:
            continue
        push(tag, _features_of(tag, m[3] or ""))
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            at = end.start() if end else n
    flush()
    return out


@lru_cache(32)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I)


@lru_cache(10_000)
def _features_of(tag: str, attributes: str) -> tuple[str, ...]:
    found = [] if tag in INLINE and tag != "a" else [f"in:{tag}"]
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                found += [f"name:{w}" for w in NAME_PART.findall(value)]
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                found.append("hidden")
    return tuple(found)


def features(found: list[Block]) -> list[set[str]]:
    """Features of every block; its neighbours come in by the chain."""
    out = []
    for b in found:
        n = len(b.text)
        words = b.text.count(" ") + 1
        share = b.linked / max(n, 1)
        f = {"bias", *b.path, f"tag:{b.tag}", f"words:{min(words.bit_length(), 7)}", f"links:{min(int(share * 4), 3)}"}
        if b.text[-1] in ".!?:;\"')…»”":
            f.add("ends")
        if b.text[0] in "©|•·»←→":
            f.add("sign")
        if re.search(r"©|\(c\)|copyright|all rights", b.text, re.I):
            f.add("rights")
        if words >= 10 and share < 0.2:
            f.add("prose")
        out.append(f)
    if out:
        out[0].add("first")
        out[-1].add("last")
    return out


# ---- labelled pages ----

MARK = ""  # a private character in front of main text, taken away before training
#: Class and id words of each kind of part.
NAMES = {
    "content": "content article post entry story main body text page single prose markdown",
    "ad": "ad ads advert advertisement adsense banner promo promoted sponsor sponsored adbox dfp",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager topnav tabs toc",
    "header": "header masthead topbar logo branding tagline site head",
    "footer": "footer copyright colophon bottom legal credits foot",
    "side": "sidebar aside widget related recommended popular trending rail secondary teaser",
    "notice": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup paywall overlay disclaimer message",
    "comments": "comment comments reply replies respond disqus discussion feedback commentlist",
    "share": "share social sharing follow tweet buttons tags meta byline author",
    "form": "form search login contact field input",
}
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ein sch ung lich keit ver ber aux eau ment tion que elle oi ción ado ñ llo mente".split()


class _Writer:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def sentence(self, lo: int = 3, hi: int = 25) -> str:
        r = self.r
        words = [self.word() for _ in range(r.randint(lo, hi))]
        style = r.random()
        if style < 0.1:
            words = [w + r.choice(["###", "&amp;&amp;&amp;", "$$$", "***", "%%%"]) for w in words]
        elif style < 0.15:
            words = [w.upper() + "!!" for w in words]
        return " ".join(words).capitalize() + r.choice(["." * (r.random() < 0.85), "?", "!", "."])

    def prose(self, lo: int = 1, hi: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(lo, hi)))

    def named(self, kind: str, tag: str) -> str:
        r = self.r
        names = NAMES[kind].split()
        attribute = r.choice(["class", "class", "id"])
        extra = [self.word()] if r.random() < 0.3 else []
        return f'<{tag} {attribute}="{r.choice(["-", " ", "_"]).join(r.sample(names, r.randint(1, 2)) + extra)}">'

    def links(self) -> str:
        r = self.r
        items = [f'<li><a href="/{i}">{" ".join(self.word() for _ in range(r.randint(1, 5)))}</a>' + "</li>" * (r.random() < 0.9) for i in range(r.randint(2, 8))]
        return f"<ul>{''.join(items)}</ul>"

    def wrap(self, kind: str, tags: str, body: str, bare: float = 0.4) -> str:
        tag = self.r.choice([t for t in tags.split() if t != "p" or "<" not in body])  # a paragraph can't hold blocks
        plain = self.r.random() < bare and tag not in ("div", "section", "p")
        return f"{f'<{tag}>' if plain else self.named(kind, tag)}{body}</{tag}>"

    def aside(self, kind: str) -> str:
        """A part that isn't the article."""
        r = self.r
        short = self.sentence(2, 14)
        if kind == "nav":
            return self.wrap("nav", "nav nav div", self.links())
        if kind == "ad":
            return self.wrap("ad", "div div aside p", r.choice([short, f"<p>{short}</p>", self.prose(1, 2)]))
        if kind == "header":
            return self.wrap("header", "header header div", f"{r.choice([f'<a href=/>{short}</a>', f'<p>{short}</p>', short, f'<h1>{short}</h1>' if r.random() < 0.3 else short])}" + (self.links() if r.random() < 0.5 else ""))
        if kind == "footer":
            return self.wrap("footer", "footer footer div", r.choice(["&copy; ", "", "Copyright "]) + f"{self.word()}.example &middot; {short}" + (self.links() if r.random() < 0.3 else ""))
        if kind == "side":
            return self.wrap("side", "aside aside div section", f"<h3>{self.sentence(1, 4)}</h3>" * (r.random() < 0.6) + r.choice([self.links(), f"<p>{self.prose(1, 3)}</p>"]))
        if kind == "notice":
            return self.wrap("notice", "div div section p dialog", r.choice([self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>"]) + "<button>ok</button>" * (r.random() < 0.4))
        if kind == "comments":
            body = "".join(self.wrap("comments", "div li article p", f"<b>{self.word()}</b> <p>{self.prose(1, 4)}</p>") for _ in range(r.randint(1, 5)))
            return self.wrap("comments", "div section ol", f"<h3>{self.sentence(1, 3)}</h3>" * (r.random() < 0.6) + body, 0.1)
        if kind == "form":
            return f"<form action=/>{self.wrap('form', 'div p', f'<label>{self.sentence(1, 4)}</label><input name=q>')}{short * (r.random() < 0.5)}<button>{self.word()}</button></form>"
        return self.wrap("share", "div ul p", self.links() if r.random() < 0.5 else short)

    def article(self) -> str:
        r = self.r
        out = [f"<h1>{MARK}{self.sentence(2, 12)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.62:
                text = MARK + self.prose()
                out.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f'<p>{text} <a href="/x">{self.word()}</a> {self.word()}.</p>']))
            elif kind < 0.72:
                out.append(f"<h2>{MARK}{self.sentence(1, 6)}</h2>")
            elif kind < 0.78:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.sentence(2, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.82:
                out.append(f"<blockquote>{MARK}{self.prose(1, 3)}</blockquote>")
            elif kind < 0.85:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{self.word()}</td><td>{MARK}{self.word()}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.88:
                out.append(f"<p>{MARK}{self.sentence(1, 3)}</p>")
            elif kind < 0.95:
                out.append(self.aside(r.choice(["ad", "ad", "notice", "share", "side", "form"])))
        body = "".join(out) + (self.aside("comments") if r.random() < 0.12 else "")
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        body = f"{f'<{tag}>' if tag in ('article', 'main') and r.random() < 0.7 else self.named('content', tag)}{body}</{tag}>"
        if r.random() < 0.2:
            body = f"<main>{body}</main>"
        elif r.random() < 0.2:
            body = f'{self.named("content", "div")}{body}</div>'
        return body

    def page(self) -> str:
        r = self.r
        before = [self.aside(k) for k in ("header", "nav", "notice", "ad", "side", "form", "nav") if r.random() < 0.45]
        after = [self.aside(k) for k in ("share", "comments", "side", "ad", "notice", "form", "footer", "footer") if r.random() < 0.45]
        head = f"<head><meta charset=utf-8><title>{self.sentence()}</title><style>p{{margin:0}}</style></head>" if r.random() < 0.9 else ""
        page = f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- {self.word()} -->{self.article()}{''.join(after)}"
        return page + "</body></html>" * (r.random() < 0.7)


def labelled_pages(count: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels (1: main) of made-up pages of many layouts."""
    out = []
    for i in range(count):
        found = blocks(_Writer(seed * 1_000_003 + i).page())
        labels = [int(MARK in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(MARK, "") or "."
        if found:
            out.append((found, labels))
    return out


# ---- the chain ----

class ChainCRF:
    """Two labels; emission weights by feature, transition and start weights."""

    def __init__(self, weights: dict[str, float], transitions: np.ndarray, start: np.ndarray) -> None:
        self.weights, self.transitions, self.start = weights, transitions, start
        self.known = frozenset(weights)

    @classmethod
    def train(cls, pages: list[tuple[list[Block], list[int]]], steps: int = 120, rate: float = 0.2, l2: float = 2e-4, least: int = 3) -> ChainCRF:
        """Penalised maximum likelihood by Adam; gradients by forward-backward over all pages at once."""
        rows = [features(p) for p, _ in pages]
        counts: dict[str, int] = {}
        for page in rows:
            for f in page:
                for x in f:
                    counts[x] = counts.get(x, 0) + 1
        names = sorted(x for x, c in counts.items() if c >= least)
        at = {x: i for i, x in enumerate(names)}
        longest, k = max(map(len, rows)), len(pages)
        x = np.zeros((k, longest, len(names)), np.float32)
        y = np.zeros((k, longest), np.int64)
        mask = np.zeros((k, longest), bool)
        for i, (page, (_, labels)) in enumerate(zip(rows, pages)):
            mask[i, :len(page)] = True
            y[i, :len(page)] = labels
            for t, f in enumerate(page):
                x[i, t, [at[z] for z in f if z in at]] = 1
        flat = x.reshape(-1, len(names))
        w, tr, st = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
        gold = np.zeros((2, 2))
        both = mask[:, 1:]
        np.add.at(gold, (y[:, :-1][both], y[:, 1:][both]), 1)
        gold_start = np.bincount(y[:, 0], minlength=2)
        moment = [np.zeros_like(v) for v in (w, tr, st)]
        second = [np.zeros_like(v) for v in (w, tr, st)]
        lse = lambda a, axis: np.logaddexp(*np.split(a, 2, axis)).squeeze(axis)
        for step in range(1, steps + 1):
            e = np.zeros((k, longest, 2))
            e[..., 1] = (flat @ w.astype(np.float32)).reshape(k, longest)
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = st + e[:, 0]
            for t in range(1, longest):
                new = lse(alpha[:, t - 1, :, None] + tr, 1) + e[:, t]
                alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                new = lse(tr + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
            z = lse(alpha[:, -1], 1)
            node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
            pair = np.exp(alpha[:, :-1, :, None] + tr + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
            gradients = [
                ((y * mask - node[..., 1]).ravel() @ flat) / k - l2 * w,
                (gold - pair.sum((0, 1))) / k - l2 * tr,
                (gold_start - node[:, 0].sum(0)) / k - l2 * st,
            ]
            for i, (v, g) in enumerate(zip((w, tr, st), gradients)):
                moment[i] = 0.9 * moment[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                v += rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        return cls({n: round(float(v), 6) for n, v in zip(names, w)}, tr.round(6), st.round(6))

    def viterbi(self, page: list[set[str]]) -> list[int]:
        """The best labels; ties go to boilerplate."""
        if not page:
            return []
        get = self.weights.get
        (t00, t01), (t10, t11) = self.transitions.tolist()
        a, b = self.start.tolist()
        back = []
        for i, f in enumerate(page):
            e = sum(sorted(get(x, 0.0) for x in f))
            if i:
                from_a = a + t00 >= b + t10, a + t01 >= b + t11
                a, b = max(a + t00, b + t10), max(a + t01, b + t11)
                back.append(from_a)
            b += e
        label = int(b > a)
        out = [label]
        for from_a in reversed(back):
            label = 0 if from_a[label] else 1
            out.append(label)
        return out[::-1]


#: Bound on the training set: pages made for fitting.
TRAINING_PAGES = 400


@lru_cache(4)
def trained_model(pages: int = TRAINING_PAGES, seed: int = 1) -> ChainCRF:
    """The model, fitted on the driver in a few seconds; the same on every run."""
    return ChainCRF.train(labelled_pages(pages, seed))


def main_text(page: str | None, model: ChainCRF) -> str:
    if not page:
        return ""
    found = blocks(page, model.known)
    return " ".join(b.text for b, label in zip(found, model.viterbi(features(found))) if label)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None, model: ChainCRF | None = None) -> DataFrame:
    """The columns `keep` (default: all) and `text_col`: each page's main blocks joined by a space.

    Null and empty pages, and pages without main blocks, give the empty string.
    Whole pages are read, however long.  A column named like `text_col` is
    replaced.  Repeated pages give equal texts; an empty table an empty result.
    """
    crf = model or trained_model()
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() != text_col.lower()]
    inner = pages.select(F.struct(F.lit(0).alias("_"), *[pages[f"`{c}`"] for c in kept]).alias("row"), pages[f"`{html_col}`"].alias("h"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "h"):
                texts = [main_text(h, crf) for h in part.column("h").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    out = inner.mapInArrow(extract, T.StructType([inner.schema["row"], T.StructField("text", T.StringType())]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("text").alias(text_col))
