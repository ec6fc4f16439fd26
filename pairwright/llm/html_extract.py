"""HTML extraction by a recurrent block labeller.

A page becomes a sequence of leaf blocks: text between block-level tags, with the tags, classes and ids above it. Each
block is a vector of hashed path steps, hashed words and a few measures; a bidirectional LSTM in numpy reads the whole
sequence, so a block is judged with all of the page before and after it. The network is trained here, when the
operator is called, on seeded pages that a generator writes in many layouts; nothing is learned from the pages read.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import map_arrow

# Fixed values of HTML: elements that hold no rendered text, void elements, inline elements, implied ends.
SILENT = frozenset("script style template noscript textarea select option svg math iframe object canvas audio video title head".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img button".split()
)
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

PATH, WORDS, MEASURES = 96, 32, 8
WIDTH = PATH + WORDS + MEASURES
HIDDEN = 20
PAGES, EPOCHS, SEED = 640, 10, 11
#: Blocks (with padding) that one pass of the network holds.
CELLS = 16_384


class Block:
    """A block's text, the characters of it in links, and of the names above it the hashed slots (as bits) and their number."""

    __slots__ = ("slots", "depth", "text", "linked")

    def __init__(self, slots: int, depth: int, text: str, linked: int):
        self.slots, self.depth, self.text, self.linked = slots, depth, text, linked


class _Open:
    """The open elements: each knows the sum of its path, and where the last of a name is takes no search."""

    def __init__(self):
        self.names: list[str] = []
        self.paths: list[tuple[int, int]] = [(0, 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.silent = self.links = 0

    def push(self, name: str, steps: list[str]) -> None:
        slots, depth = self.paths[-1]
        for step in steps:
            slots |= 1 << zlib.crc32(step.encode("utf-8", "replace")) % PATH
        self.places.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.paths.append((slots, depth + len(steps)))
        self.silent += name in SILENT
        self.links += name == "a"

    def close(self, place: int) -> None:
        """Closes the element at place and all in it."""
        while len(self.names) > place:
            name = self.names.pop()
            self.paths.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            self.silent -= name in SILENT
            self.links -= name == "a"

    def last(self, *names: str) -> int:
        """The place of the innermost element of these names, or -1."""
        return max((found[-1] for name in names if (found := self.places.get(name))), default=-1)


def blocks_of(page: str) -> list[Block]:
    """The page's leaf blocks in order; white space in a block is one space, blocks without text are left out.

    References are decoded in each piece of text between two tags, so a tag in the middle of one leaves it as it is.
    Time and memory grow with the page's length, however deep it is."""
    out: list[Block] = []
    open_ = _Open()
    pieces: list[str] = []
    link_chars = 0
    at, size = 0, len(page)

    def flush():
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(*open_.paths[-1], text, link_chars))
            pieces.clear()
        link_chars = 0

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                if not open_.silent:
                    pieces.append(html.unescape(token))
                    if open_.links:
                        link_chars += len(token)
            continue
        name = name.lower()
        if m[1]:
            if name not in INLINE:
                flush()
            place = open_.last(name)
            # an inline end tag never closes the blocks around it
            if place >= 0 and (name not in INLINE or not open_.blocks or place > open_.blocks[-1]):
                open_.close(place)
            continue
        if name in VOID:
            if name in ("br", "wbr", "hr", "img", "input") and not open_.silent:
                if name == "hr":
                    flush()
                elif name != "wbr":
                    pieces.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in ENDS_PARAGRAPH and open_.blocks and open_.names[open_.blocks[-1]] == "p":
                open_.close(open_.blocks[-1])
            if name in SIBLINGS:
                place = open_.last(*SIBLINGS[name])
                if place > open_.last(*SCOPE[name]):
                    open_.close(place)
        if m[3].endswith("/") and name in ("svg", "path", "circle"):
            continue
        steps = [name] if name not in INLINE else []
        for found in _NAMES.finditer(m[3]):
            steps += [w.lower() for w in re.split(r"[\s_-]+", next(filter(None, found.groups()), "")) if w]
        open_.push(name, steps)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            open_.close(len(open_.names) - 1)
    flush()
    return out


@functools.lru_cache(1 << 16)
def _slot(word: str) -> int:
    return PATH + zlib.crc32(word.encode("utf-8", "replace")) % WORDS


@functools.lru_cache(1 << 12)
def _path_slots(slots: int) -> list[int]:
    return [k for k in range(PATH) if slots >> k & 1]


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row for each block: the slots of its path, the shares of its words' slots (of all its words), measures."""
    slots, values, measures = [], [], []
    for i, b in enumerate(blocks):
        at, text = i * (PATH + WORDS), b.text
        path = _path_slots(b.slots)
        slots += [at + k for k in path]
        values += [1.0] * len(path)
        words = text.lower().split(" ")
        n = len(text)
        slots += [at + _slot(w) for w in words]
        values += [1 / (1 + len(words))] * len(words)
        stops = text.count(".") + text.count(",") + text.count(";") + text.count(":") + text.count("!") + text.count("?")
        measures.append((log1p(n) / 8, min(1.0, b.linked / n), log1p(len(words)) / 6, min(2.0, stops / (1 + len(words))), i / len(blocks), b.depth / 16, 1.0, float(len(words) < 8)))
    x = np.zeros((len(blocks), WIDTH), np.float32)
    x[:, : PATH + WORDS] = np.bincount(slots, values, len(blocks) * (PATH + WORDS)).reshape(len(blocks), -1) if blocks else 0
    x[:, PATH + WORDS :] = np.array(measures, np.float32).reshape(-1, MEASURES)
    return x


class Network:
    """A bidirectional LSTM with a logistic output on both states."""

    def __init__(self, rng: np.random.Generator):
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"w{d}"] = (rng.normal(size=(WIDTH, 4 * HIDDEN)) / np.sqrt(WIDTH)).astype(np.float32)
            self.p[f"u{d}"] = (rng.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p["o"] = (rng.normal(size=2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.p["z"] = np.zeros(1, np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        t, b, _ = x.shape
        pre = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        hs, tape = np.zeros((t, b, HIDDEN), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            g = pre[k] + h @ self.p[f"u{d}"]
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, n = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            c2 = np.where(m, f * c + i * n, c)
            th = np.tanh(c2)
            h2 = np.where(m, o * th, h)
            if keep:
                tape.append((k, i, f, o, n, c, th, h, m))
            h, c = h2, c2
            hs[k] = h
        return hs, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, _ = self._pass(x, mask, "f", False)
        hb, _ = self._pass(x, mask, "b", False)
        return np.concatenate([hf, hb], 2) @ self.p["o"] + self.p["z"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        passes = {d: self._pass(x, mask, d, True) for d in "fb"}
        both = np.concatenate([passes["f"][0], passes["b"][0]], 2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["z"], -30, 30)))
        e = np.where(mask, p - y, 0).astype(np.float32) / max(1, mask.sum())
        grad = {"o": np.einsum("tb,tbh->h", e, both), "z": np.array([e.sum()], np.float32)}
        for d, cut in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            out = e[:, :, None] * self.p["o"][cut]
            pre, u = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), self.p[f"u{d}"]
            gu = np.zeros_like(u)
            dh, dc = np.zeros_like(out[0]), np.zeros_like(out[0])
            for k, i, f, o, n, c, th, h, m in reversed(passes[d][1]):
                dh = dh + out[k]
                live = np.where(m, dh, 0)
                dcell = np.where(m, dc + live * o * (1 - th * th), 0)
                g = np.concatenate([dcell * n * i * (1 - i), dcell * c * f * (1 - f), live * th * o * (1 - o), dcell * i * (1 - n * n)], 1)
                pre[k] = g
                gu += h.T @ g
                dh = np.where(m, g @ u.T, dh)
                dc = np.where(m, dcell * f, dc)
            grad[f"w{d}"], grad[f"u{d}"], grad[f"c{d}"] = np.einsum("tbx,tbg->xg", x, pre, optimize=True), gu, pre.sum((0, 1))
        return grad

    def keep(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page's vectors, whether each block is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            take = order[-max(1, CELLS // max(1, longest)) :]
            del order[-len(take) :]
            if longest:
                x, mask = padded([pages[i] for i in take])
                z = self.logits(x, mask)
                for k, i in enumerate(take):
                    out[i] = z[: len(pages[i]), k] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), WIDTH), np.float32), np.zeros((t, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


# What the generator writes: names that sites give to their parts.
_PARTS = {
    "menu": (("nav", ""), ("div", "menu"), ("ul", "nav navbar"), ("div", "breadcrumb"), ("div", "navigation"), ("div", "topbar links"), ("ul", "menu")),
    "head": (("header", ""), ("div", "header"), ("div", "masthead"), ("div", "site-header banner"), ("div", "logo")),
    "foot": (("footer", ""), ("div", "footer"), ("div", "copyright"), ("div", "site-footer"), ("section", "footer bottom")),
    "side": (("aside", ""), ("div", "sidebar"), ("div", "related"), ("div", "widget"), ("aside", "recommended"), ("div", "trending popular"), ("div", "share social")),
    "note": (("div", "cookie"), ("div", "notice"), ("div", "consent banner"), ("div", "alert"), ("div", "gdpr popup"), ("div", "newsletter subscribe"), ("div", "modal")),
    "ad": (("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "advertisement"), ("div", "sponsored"), ("section", "promo"), ("div", "banner-ad")),
    "form": (("form", ""), ("form", "search"), ("div", "login"), ("form", "signup"), ("form", "contact")),
    "talk": (("div", "comments"), ("section", "comments"), ("ol", "comment-list"), ("div", "replies"), ("section", "discussion responses"), ("div", "disqus")),
}
_BODIES = (("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "article"), ("section", "entry"), ("article", "story"), ("div", "main text"), ("div", "body"))


def generated(r: random.Random) -> tuple[str, list[bool]]:
    """A page of a random layout and whether each of its blocks is main text."""
    letters = "".join(r.sample("abcdefghijklmnopqrstuvwxyzéüñ", 14))
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    labels: list[bool] = []
    loud, marks = r.random() < 0.12, r.choice(("", "", "", "", "", "!!", "###", "***"))  # texts in capitals, with odd marks

    def line(n, dots=True):
        w = [word() for _ in range(n)]
        if dots:
            w = [x + (r.choice(".,;") if r.random() < 0.15 else "") for x in w]
        if r.random() < 0.1:
            w.append("&amp;")
        text = " ".join(x + marks if r.random() < 0.7 else x for x in w)
        return text.upper().replace("&AMP;", "&amp;") if loud else text.capitalize()

    def opened(tag, name):
        how = r.choice(("class", "class", "id"))
        return f'<{tag} {how}="{name}">' if name else f"<{tag}>"

    def other(kind):
        tag, name = r.choice(_PARTS[kind])
        inner = []
        for _ in range(r.choice((1, 1, 1, 2, 3, 6)) if kind != "menu" else r.randint(2, 9)):
            labels.append(False)
            n = r.choice((1, 2, 3)) if kind == "menu" else r.choice((1, 3, 6, 12, 30, 60)) if kind in ("talk", "ad", "side", "note") else r.choice((2, 4, 8, 14))
            text = line(n, r.random() < 0.5)
            if kind == "menu" or kind in ("side", "foot", "head") and r.random() < 0.5:
                text = f'<a href="/{word()}">{text}</a>'
            if kind == "form":
                text = f"<label>{text}</label><input name={word()}>"
            item = "li" if tag in ("ul", "ol") else r.choice(("p", "div", "li", "span-free", "h3", "h2"))
            inner.append(f"<{item}>{text}</{item}>" if item != "span-free" else f"<div>{text}</div>")
        if kind != "menu" and len(inner) == 1 and r.random() < 0.5:
            inner[0] = re.sub(r"^<\w+>|</\w+>$", "", inner[0])
        if kind == "menu" and tag not in ("ul", "ol") and r.random() < 0.6:
            inner = ["<ul>", *[re.sub(r"^<\w+>", "<li>", re.sub(r"</\w+>$", "</li>", x)) for x in inner], "</ul>"]
        return opened(tag, name) + "".join(inner) + f"</{tag}>"

    def body():
        tag, name = r.choice(_BODIES)
        inner = []
        if r.random() < 0.85:
            labels.append(True)
            inner.append(f"<h1>{line(r.randint(1, 9), False)}</h1>")
        for _ in range(r.choice((1, 2, 3, 5, 8, 14, 24))):
            if inner and r.random() < 0.06:
                inner.append(other(r.choice(("ad", "side", "note", "form"))))
                continue
            item = r.choices(("p", "h2", "li", "blockquote", "pre", "td", "div"), (14, 1, 1, 1, 0.4, 0.4, 0.6))[0]
            labels.append(True)
            text = line(r.randint(1, 8) if item in ("h2", "li", "td") or r.random() < 0.15 else r.randint(6, 90))
            if r.random() < 0.15:
                text = f"<b>{text}" + r.choice(("</b>", "<br>"))
            if r.random() < 0.1:
                text += f' <a href="/{word()}">{word()}</a> {word()}.'
            inner.append({"li": f"<ul><li>{text}</li></ul>", "td": f"<table><tr><td>{text}</td></tr></table>"}.get(item, f"<{item}>{text}" + ("" if item == "p" and r.random() < 0.1 else f"</{item}>")))
        return opened(tag, name) + "".join(inner) + f"</{tag}>"

    parts = []
    for kinds, chance in ((("note", "head", "menu"), 0.8), (("menu", "head"), 0.8), (("ad", "note", "side", "form"), 0.6)):
        if r.random() < chance:
            parts.append(other(r.choice(kinds)))
    parts.append(body())
    for kinds, chance in ((("talk", "side", "form"), 0.5), (("talk", "ad", "side"), 0.5), (("foot", "menu"), 0.9)):
        if r.random() < chance:
            parts.append(other(r.choice(kinds)))
    page = "".join(parts)
    if r.random() < 0.4:
        page = f"{opened('div', r.choice(('wrapper', 'page', 'container', 'site')))}{page}</div>"
    return f"<html><head><title>{word()}</title><style>p{{}}</style></head><body><script>x='</p>'</script>{page}</body></html>", labels


@functools.cache
def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network trained on generated pages; the same for the same arguments."""
    r, rng = random.Random(seed), np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        page, labels = generated(r)
        found = blocks_of(page)
        if len(found) == len(labels):
            data.append((vectors(found), np.array(labels, np.float32)))
    net = Network(rng)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda i: len(data[i][0]) + rng.random() * 8)
        groups = [order[i : i + 16] for i in range(0, len(order), 16)]
        for g in rng.permutation(len(groups)):
            x, mask = padded([data[i][0] for i in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(groups[g]):
                y[: len(data[i][1]), k] = data[i][1]
            step += 1
            rate = 0.01 * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, d in net.gradient(x, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                net.p[k] = (net.p[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-7)).astype(np.float32)
    return net


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    text is the main blocks joined by line breaks, '' if there are none; null and empty html give ''. Broken markup is
    read as far as it goes; pages of any length are read whole. Repeated rows are each extracted. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    net = train()

    def one(batch):
        found = [blocks_of(p or "") for p in batch.column(2).to_pylist()]
        kept = net.keep([vectors(b) for b in found])
        text = ["\n".join(b.text for b, k in zip(bs, ks, strict=False) if k) for bs, ks in zip(found, kept, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return map_arrow(pages.select("page_id", "url", F.col("html")), one, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
