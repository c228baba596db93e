"""Main text of web pages: a bidirectional LSTM labels each block with the whole page in view.

A page is cut into leaf blocks: runs of text between block-level tags. A block goes in as a hashed vector of its tag
path (the innermost DEEP names, classes and ids), a hashed vector of its words, and a few numbers (length, share of link
text, place, its container's share of the page's text and of link text). A recurrent layer reads the blocks in each
direction, so every block is judged with the document's whole context; blocks labelled as main text are joined in page
order.

The network is trained in numpy on pages that a fixed grammar makes: articles among menus, headers, footers, sidebars,
notices, adverts, forms and comments, in many layouts (semantic elements, named and unnamed containers, table cells,
threads), with invented words and with words and class names left out at random, so it learns no site and no name alone.
The training pages are a bounded number; the input is never read for it.

Time grows with a page's length, however its tags are nested or broken; a page of very many blocks is read in pieces that
hand the recurrent state on, so its memory is its text and some 200 bytes a block.

Defined results: null, empty and textless pages give an empty text; unclosed, stray and truncated tags are read as far
as they go (a quote that is never closed ends the pairing of quotes on the page); very long pages are read whole; repeated
rows give equal results; kept columns named text or n_chars give way to the results; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import prepare

PATHS, WORDS, NUMBERS, HIDDEN = 160, 32, 8, 16
PAGES, STEPS = 1600, 420
#: Names of a tag path that go in, counted from the block.
DEEP = 24
#: Blocks of a page that are read at once.
PIECE = 20_000
#: Elements that end a run of text.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("br hr".split())
#: Elements whose content is never text.
HIDDEN_ELEMENTS = "script|style|noscript|template|textarea|svg|iframe"
#: Opening one of these ends an open one of the named.
CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_END_OF = {x: re.compile(rf"</{x}\s*>", re.I) for x in HIDDEN_ELEMENTS.split("|")}
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def pieces(html: str) -> Iterator[tuple[str | None, bool, str]]:
    """(element name, is an end tag, attributes) of each tag, and (None, False, text) of the text between, in one pass."""
    at, size, quotes = 0, len(html), True
    while at < size:
        cut = html.find("<", at)
        if cut < 0:
            yield None, False, html[at:]
            return
        if cut > at:
            yield None, False, html[at:cut]
        if html.startswith("<!--", cut):
            end = html.find("-->", cut + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), cut):
            end = html.find(">", cut)
            at = size if end < 0 else end + 1
            continue
        if not (m := _TAG.match(html, cut)):
            yield None, False, "<"
            at = cut + 1
            continue
        rest = _REST.match(html, m.end()) if quotes else None
        if rest is None:
            # no end that leaves quotes paired: from here on the next sign ends a tag, so no part is read twice
            quotes = False
            end, again = html.find(">", m.end()), html.find("<", m.end())
            if end < 0 and again < 0:
                return  # cut off inside a tag
            if end < 0 or 0 <= again < end:
                yield None, False, html[cut : again]
                at = again
                continue
            at = end + 1
        else:
            at = rest.end()
        name = m[2].lower()
        if not m[1] and name in _END_OF:
            end_of = _END_OF[name].search(html, at)
            at = size if end_of is None else end_of.end()
            continue
        yield name, bool(m[1]), html[m.end() : at - 1]


def blocks(html: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text with single spaces, characters of link text) of each leaf block, in page order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # open elements, each with the path down to it
    open_: dict[str, int] = {}  # how many of each are open
    parts: list[str] = []
    links, linked = 0, 0
    path: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((path, text, linked))
            parts.clear()
        linked = 0

    def close() -> None:
        open_[stack.pop()[0]] -= 1

    for name, end, rest in pieces(html):
        if name is None:
            parts.append(rest)
            if links:
                linked += len(rest)
            continue
        if name == "a":
            links = 0 if end else 1
        if name not in BLOCK:
            continue
        flush()
        if end:
            if open_.get(name):
                while stack[-1][0] != name:
                    close()
                close()
        elif name not in VOID:
            if name in ENDS_P and stack and stack[-1][0] == "p":
                close()
            if name in CLOSES and stack and stack[-1][0] in CLOSES[name]:
                close()
            marks = [w for a in _ATTRIBUTE.findall(rest) for w in re.split(r"[\s_-]+", a.strip("\"'").lower()) if w]
            above = stack[-1][1] if stack else ()
            stack.append((name, (*above, name, *(f".{w}" for w in marks[:DEEP]))[-DEEP:]))
            open_[name] = open_.get(name, 0) + 1
        links = 0 if not end else links
        path = stack[-1][1] if stack else ()
    flush()
    return out


@lru_cache(maxsize=1 << 16)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATHS, np.float32)
    for i, x in enumerate(path):
        h = zlib.crc32(x.encode())
        v[h % PATHS] += 1.0 if h >> 20 & 1 else -1.0
        if i:
            h = zlib.crc32((path[i - 1] + ">" + x).encode())
            v[h % PATHS] += 0.5 if h >> 20 & 1 else -0.5
    return v


def container(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path without its innermost element."""
    k = len(path) - 1
    while k > 0 and path[k][0] == ".":
        k -= 1
    return path[: max(k, 0)]


def shares(page: list[tuple[tuple[str, ...], str, int]]) -> tuple[dict, int, int]:
    """(characters and characters of link text by container, characters of the page, blocks of the page)."""
    by: dict[tuple[str, ...], list[int]] = {}
    for path, text, linked in page:
        own = by.setdefault(container(path), [0, 0])
        own[0] += len(text)
        own[1] += min(linked, len(text))
    return by, sum(x for x, _ in by.values()), len(page)


def page_features(page: list[tuple[tuple[str, ...], str, int]], of: tuple | None = None, first: int = 0) -> np.ndarray:
    """A row of numbers for each block. of: shares of the whole page, if these are only its blocks from `first` on."""
    by, total, size = of or shares(page)
    x = np.zeros((len(page), PATHS + WORDS + NUMBERS), np.float32)
    for i, (path, text, linked) in enumerate(page):
        x[i, :PATHS] = _path_vector(path)
        words = text.lower().split()
        h = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
        v = np.bincount(h % WORDS, np.where(h >> 20 & 1, 1.0, -1.0), WORDS)
        x[i, PATHS : PATHS + WORDS] = v / (1e-9 + (v * v).sum() ** 0.5)
        own, links = by[container(path)]
        x[i, -NUMBERS:] = min(1.0, np.log1p(len(text)) / 4 - 1), min(1.0, linked / len(text)), text[-1] in ".!?", (first + i) / size, len(words) < 6, own / total, links / own, text[0] == "©"
    return x


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(p: dict, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, pages, hidden) of one direction; where the mask is zero the state stays."""
    gates = x @ p["w" + d] + p["b" + d]
    h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((*x.shape[:2], HIDDEN), np.float32)
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        g = gates[t] + h @ p["u" + d]
        i, f, o, n = _sig(g[:, :HIDDEN]), _sig(g[:, HIDDEN : 2 * HIDDEN]), _sig(g[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
        on = mask[t][:, None]
        c_new = f * c + i * n
        tc = np.tanh(c_new)
        if keep is not None:
            keep.append((t, h, c, i, f, o, n, tc, on))
        h, c = on * (o * tc) + (1 - on) * h, on * c_new + (1 - on) * c
        out[t] = h
    return out


def _logits(p: dict, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    s = np.concatenate([_pass(p, d, x, mask, None if keep is None else keep.setdefault(d, [])) for d in "fb"], 2)
    if keep is not None:
        keep["s"] = s
    return s @ p["out"] + x @ p["skip"] + p["bias"][0]


def _gradient(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    keep: dict = {}
    dz = (_sig(_logits(p, x, mask, keep)) - y) * mask / mask.sum()
    grad = {"out": np.einsum("tnh,tn->h", keep["s"], dz), "skip": np.einsum("tnh,tn->h", x, dz), "bias": dz.sum(keepdims=True).reshape(1)}
    ds = dz[:, :, None] * p["out"]
    for d, part in (("f", ds[:, :, :HIDDEN]), ("b", ds[:, :, HIDDEN:])):
        dg_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        du = np.zeros_like(p["u" + d])
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, h, c, i, f, o, n, tc, on in reversed(keep[d]):
            dh = dh + part[t]
            own = dh * on
            dcn = dc * on + own * o * (1 - tc * tc)
            dg = np.concatenate([dcn * n * i * (1 - i), dcn * c * f * (1 - f), own * tc * o * (1 - o), dcn * i * (1 - n * n)], 1)
            dg_all[t] = dg
            du += h.T @ dg
            dh = dg @ p["u" + d].T + dh * (1 - on)
            dc = dcn * f + dc * (1 - on)
        grad |= {"u" + d: du, "w" + d: np.einsum("tnx,tng->xg", x, dg_all), "b" + d: dg_all.sum((0, 1))}
    return grad


def _padded(pages: list[np.ndarray], labels: list[np.ndarray] | None = None):
    steps = max(map(len, pages))
    x, mask, y = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, 1
        if labels is not None:
            y[: len(page), k] = labels[k]
    return x, mask, y


#: Parts that names of containers are made of; a container's name says little where they are mixed.
NEUTRAL = ["content", "wrap", "wrapper", "inner", "outer", "text", "col", "row", "page", "box", "block", "section", "left", "right", "grid", "container", "body", "main", "a1", "x7", "css", "unit", "area", "region", "site", "view"]
JUNK_NAMES = {
    "ad": ["ad", "ads", "advert", "banner ad", "sponsored", "promo", "ad-slot", "advertisement", "dfp-unit", "sponsor-box"],
    "side": ["sidebar", "related", "widget", "recommended", "most-read", "trending", "more-stories", "rail"],
    "notice": ["cookie-notice", "cookies", "consent", "notice", "gdpr-banner", "popup", "alert-bar", "privacy-notice", "paywall"],
    "form": ["subscribe", "search", "newsletter", "login", "signup", "contact-form"],
    "comment": ["comments", "comment-list", "reader-comments", "responses", "discussion", "replies", "thread"],
    "share": ["share", "social", "tags", "meta", "share-bar", "pagination", "breadcrumb", "skip", "breadcrumbs"],
    "menu": ["menu", "nav", "navbar", "top-menu", "links", "mainnav", "navigation"],
    "head": ["site-header", "top", "masthead", "header", "logo", "branding"],
    "foot": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon"],
}


def made_pages(n: int = PAGES, seed: int = 11) -> Iterator[tuple[str, list[int]]]:
    """(html, label of each leaf block) of pages from the grammar."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    chance = lambda p: rng.random() < p
    some = lambda a, b: range(int(rng.integers(a, b + 1)))
    syllables = "the an re on er in th ou le de la qu ei sch ung tion ment ado ción ra lo mi sa es ent ing ka bo tu vel dor pri sta lun".split()
    said: list[int] = []

    def words(a: int, b: int) -> str:
        return " ".join("".join(pick(syllables) for _ in some(1, 3)) for _ in some(a, b))

    def sentence(a: int, b: int) -> str:
        return words(a, b).capitalize() + pick([".", ".", ".", "", "?", "!"])

    def leaf(tag: str, text: str, label: int, attrs: str = "") -> str:
        said.append(label)
        if chance(0.15):
            text = f"<b>{text}</b>"
        if chance(0.1):
            text += f' <a href="/{words(1, 1)}">{words(1, 2)}</a>'
        return f"<{tag}{attrs}>{text}</{tag}>" if tag not in ("p", "li") or chance(0.93) else f"<{tag}{attrs}>{text}"

    def links(k: int) -> str:
        """A list of links, as list items, paragraphs or one run of them."""
        kind = rng.integers(4)
        one = lambda: f'<a href="/x">{words(1, 4)}</a>'
        if kind == 0:
            said.append(0)
            return f"<div>{pick([' | ', ' ', ' · ']).join(one() for _ in range(max(1, k)))}</div>"
        tag = pick(["li", "li", "p", "td"])
        body = "".join((said.append(0), f"<{tag}>{one()}</{tag}>")[1] for _ in range(max(1, k)))
        return f"<ul>{body}</ul>" if tag == "li" else f"<table><tr>{body}</tr></table>" if tag == "td" else f"<div>{body}</div>"

    def attribute(name: str) -> str:
        return f' {pick(["class", "class", "id"])}="{name}"'

    def neutral() -> str:
        return attribute("-".join(pick(NEUTRAL) for _ in some(1, 2))) if chance(0.7) else ""

    def named(kind: str, sure: float = 0.75) -> str:
        return attribute(pick(JUNK_NAMES[kind])) if chance(sure) else neutral()

    def wrapped(inside: str, deep: int) -> str:
        for _ in some(0, deep):
            tag = pick(["div", "div", "section"])
            inside = f"<{tag}{neutral()}>{inside}</{tag}>"
        return inside

    def junk(inner: bool = False) -> str:
        kind = rng.integers(10)
        text = lambda: leaf(pick(["p", "div", "span", "p"]), sentence(2, 25), 0)
        flat = lambda x: x.replace("<span>", "<div>").replace("</span>", "</div>")
        if kind == 0:
            return f"<nav{named('menu', 0.5)}>{links(rng.integers(2, 8))}</nav>"
        if kind == 1:
            return leaf(pick(["div", "div", "aside", "p"]), words(3, 22) + pick(["", "."]), 0, attribute(pick(JUNK_NAMES["ad"])))
        if kind == 2:
            return flat(f"<{(t := pick(['aside', 'aside', 'div']))}{named('side', 1 if t == 'div' else 0.6)}>{leaf(pick(['h3', 'h4', 'div']), words(1, 4), 0)}{links(rng.integers(1, 6)) if chance(0.6) else text()}</{t}>")
        if kind == 3:
            return flat(f"<div{named('notice', 1)}>{text()}{leaf('button', words(1, 2), 0) if chance(0.7) else ''}</div>")
        if kind == 4:
            return f"<form{named('form', 0.5)}>{leaf(pick(['p', 'label', 'div']).replace('label', 'legend'), words(2, 12), 0)}{leaf('button', words(1, 2), 0)}</form>"
        if kind == 5:
            return comments()
        if kind == 6:
            return flat(f"<div{named('share', 1)}>{links(rng.integers(1, 5)) if chance(0.5) else text()}</div>")
        if kind == 7 and not inner:
            return f"<div{named('menu', 0.6)}>{links(rng.integers(4, 10))}</div>"
        if kind == 8:
            return leaf(pick(["nav", "aside", "form"]), words(1, 25) + pick(["", "."]), 0)
        return leaf("div", words(1, 6), 0, attribute(pick(JUNK_NAMES["share"])))

    def comments() -> str:
        tag, out = pick(["section", "div", "ol", "ul"]), leaf("h3", words(1, 3), 0) if chance(0.8) else ""
        for _ in some(1, 6):
            item, inside = pick(["div", "div", "li", "article"]), ""
            if chance(0.4):
                inside += leaf("div", words(1, 3), 0, attribute(pick(["author", "user", "byline", "meta"])))
            inside += leaf("p", sentence(3, 40), 0)
            if chance(0.2):
                inside += f'<div class="{pick(["children", "reply", "comment"])}">{leaf("p", sentence(2, 30), 0)}</div>'
            out += f"<{item}{attribute(pick(['comment', 'reply', 'comment-body', 'response'])) if item == 'article' or chance(0.7) else ''}>{inside}</{item}>"
        return f"<{tag}{attribute(pick(JUNK_NAMES['comment']))}>{out}</{tag}>"

    def body(parts: tuple[int, int] = (1, 12)) -> str:
        out = leaf(pick(["h1", "h1", "h2"]), words(2, 12), 1) if chance(0.85) else ""
        if chance(0.25):
            out += leaf(pick(["div", "p"]), words(2, 8), 1, attribute(pick(["byline", "author", "dateline", "lead", "summary", "standfirst"])) if chance(0.6) else "")
        for _ in some(*parts):
            kind = rng.random()
            if kind < 0.08:  # junk inside an article is still its text
                text = pick([" ".join([words(1, 1)] * int(rng.integers(5, 200))), words(100, 500), words(3, 60).replace(" ", " | "), words(3, 60).upper().replace(" ", "!! ")])
                out += leaf("p", text, 1)
            elif kind < 0.66:
                out += leaf("p", " ".join(sentence(1, 30) for _ in some(1, 4)) if chance(0.6) else words(1, 60) + pick(["", "."]), 1)
            elif kind < 0.74:
                out += leaf(pick(["h2", "h3", "h4"]), words(1, 7), 1)
            elif kind < 0.81:
                tag = pick(["ul", "ol"])
                out += f"<{tag}>" + "".join(leaf("li", words(1, 15), 1) for _ in some(1, 5)) + f"</{tag}>"
            elif kind < 0.85:
                out += f"<blockquote>{leaf('p', sentence(3, 30), 1)}</blockquote>"
            elif kind < 0.89:
                said.extend((1, 1))
                out += f"<p><b>{words(1, 5)}.<br>{words(2, 30)}</p>"
            elif kind < 0.92:
                out += "<table>" + "".join(f"<tr>{leaf('td', words(1, 3), 1)}{leaf('td', words(1, 3), 1)}</tr>" for _ in range(2)) + "</table>"
            elif kind < 0.94:
                out += leaf("pre", words(2, 20), 1)
            elif kind < 0.955:
                out += f"<figure>{leaf('figcaption', words(2, 12), 1)}</figure>"
            else:
                out += junk(True)
        return out

    def article() -> str:
        kind = rng.integers(9)
        if kind <= 1:
            return f"<article>{body()}</article>"
        if kind == 2:
            inside = body()
            return f"<main><article{attribute(pick(['post', 'entry'])) if chance(0.7) else ''}>{inside}</article>{junk() if chance(0.5) else ''}</main>"
        if kind == 3:
            return f"<main>{wrapped(body(), 2)}</main>"
        if kind == 4:
            return f"<div{attribute(pick(['content', 'post', 'article', 'entry-content', 'story', 'article-body', 'main', 'post-content', 'text']))}>{body()}</div>"
        if kind == 5:  # a heading and byline in one container, paragraphs in a further one
            head = leaf("h1", words(2, 12), 1)
            head += leaf("div", words(2, 8), 1, attribute(pick(["byline", "date", "author"]))) if chance(0.6) else ""
            return wrapped(f"<div{neutral()}>{head}<div{neutral()}>{body((2, 10))}</div></div>", 2)
        if kind == 6:  # columns in table cells
            side = f"<td>{links(rng.integers(3, 9))}</td>" if chance(0.7) else ""
            return f"<table{neutral()}><tr>{side}<td>{body((2, 9))}</td></tr></table>"
        if kind == 7:  # text straight in containers
            out = leaf("h1", words(2, 9), 1)
            for _ in some(2, 8):
                out += leaf("div", sentence(8, 60), 1)
            return wrapped(f"<div{neutral()}>{out}</div>", 2)
        return wrapped(body((2, 14)), 3)

    for _ in range(n):
        said = []
        page = "<!DOCTYPE html><html><head>" + (leaf("title", words(1, 10), 0) if chance(0.9) else "") + "</head><body>"
        if chance(0.5):
            tag = pick(["header", "header", "div"])
            page += f"<{tag}{named('head', 1 if tag == 'div' else 0.5)}>{leaf(pick(['h1', 'div', 'p', 'h2']), words(1, 4), 0)}{links(3) if chance(0.4) else ''}</{tag}>"
        inside = "".join(junk() for _ in some(0, 3))
        inside += article()
        inside += "".join(junk() for _ in some(0, 2))
        if chance(0.3):
            inside += comments()
        page += wrapped(inside, 2) if chance(0.5) else inside
        if chance(0.85):
            sign = pick(["&copy; ", "", "&copy; 2024 ", "© "])
            if chance(0.5):
                page += leaf("footer", sign + words(1, 25) + pick(["", "."]), 0, named("foot", 0.3))
            elif chance(0.6):
                page += f"<footer{named('foot', 0.3)}>{leaf('p', sign + words(2, 25), 0) if chance(0.5) else links(2)}</footer>"
            else:
                inner = leaf("p", sign + words(2, 25), 0)
                page += f"<div{attribute(pick(JUNK_NAMES['foot']))}>{inner}{links(3) if chance(0.5) else ''}</div>"
        yield page + "</body></html>", said


@lru_cache(maxsize=1)
def train(n: int = PAGES, steps: int = STEPS, batch: int = 48, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    wide = PATHS + WORDS + NUMBERS
    p = {"out": rng.normal(size=2 * HIDDEN) * 0.2, "skip": np.zeros(wide), "bias": np.zeros(1)}
    for d in "fb":
        p |= {"w" + d: rng.normal(size=(wide, 4 * HIDDEN)) * 0.1, "u" + d: rng.normal(size=(HIDDEN, 4 * HIDDEN)) * 0.2, "b" + d: np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    xs, ys = [], []
    for page, labels in made_pages(n):
        found = blocks(page)
        if len(found) == len(labels) and len(found) <= 80:
            xs.append(page_features(found))
            ys.append(np.array(labels, np.float32))
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    mean = p
    for t in range(1, steps + 1):
        own = rng.choice(len(xs), batch, replace=False)
        x, mask, y = _padded([xs[i] for i in own], [ys[i] for i in own])
        # whole pages without words, without paths: neither may decide alone
        x[:, rng.random(batch) < 0.5, PATHS : PATHS + WORDS] = 0
        x[:, rng.random(batch) < 0.08, :PATHS] = 0
        rate = 0.02 * (1 - t / (steps + 1))
        for k, g in _gradient(p, x, mask, y).items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        if t > steps * 2 // 3:  # the mean of the last steps judges more evenly than any one of them
            mean = {k: a + (p[k] - a) / (t - steps * 2 // 3) for k, a in mean.items()} if t > steps * 2 // 3 + 1 else {k: a.copy() for k, a in p.items()}
    return mean


def _long(p: dict, page: list) -> np.ndarray:
    """Logits of a page of very many blocks: a piece at a time, from its start and from its end."""
    of, out = shares(page), np.zeros(len(page), np.float32)
    starts = range(0, len(page), PIECE)
    for k, d in enumerate("fb"):
        h = c = np.zeros(HIDDEN, np.float32)
        for start in starts if d == "f" else reversed(starts):
            x = page_features(page[start : start + PIECE], of, start)
            gates = x @ p["w" + d] + p["b" + d]
            for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
                g = gates[t] + h @ p["u" + d]
                i, f, o = _sig(g[:HIDDEN]), _sig(g[HIDDEN : 2 * HIDDEN]), _sig(g[2 * HIDDEN : 3 * HIDDEN])
                c = f * c + i * np.tanh(g[3 * HIDDEN :])
                h = o * np.tanh(c)
                out[start + t] += h @ p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            if d == "f":
                out[start : start + len(x)] += x @ p["skip"] + p["bias"][0]
    return out


def label(p: dict, pages: list[list], most: int = PIECE) -> list[np.ndarray]:
    """Probability of main text for each block of each page. Pages of like length go together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        if len(pages[order[at]]) > most:
            out[order[at]] = _sig(_long(p, pages[order[at]]))
            at += 1
            continue
        to = at + 1
        while to < len(order) and (to - at + 1) * len(pages[order[to]]) <= most:
            to += 1
        own = order[at:to]
        x, mask, _ = _padded([page_features(pages[i]) for i in own])
        prob = _sig(_logits(p, x, mask))
        for k, i in enumerate(own):
            out[i] = prob[: len(pages[i]), k]
        at = to
    return out


def main_text(p: dict, pages: list[str]) -> list[str]:
    """The main text of each page."""
    found = [blocks(x) for x in pages]
    return [" ".join([t for (_, t, _), q in zip(page, prob) if q >= 0.5]) for page, prob in zip(found, label(p, found))]


def extract(df: DataFrame, html_col: str, *keep: str) -> DataFrame:
    """The kept columns, text string and n_chars long (code points)."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(train())  # of a fixed size, about 100 kB

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([t for part in slices(pages) for t in main_text(shared.value, [x.as_py() or "" for x in part])], pa.string())

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("row"), F.arrow_udf(run, "string")(df[html_col].cast("string")).alias("text"))
    kept = [F.col("row")[c].alias(c) for c in keep if c not in ("text", "n_chars")]
    return rows.select(*kept, "text", F.length("text").cast("long").alias("n_chars"))


def op6(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), "html", "page_id", "url")
