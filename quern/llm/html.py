r"""Main text of HTML pages: gradient-boosted trees over DOM nodes, decoded over the hierarchy.

Parsing follows HTML's rules where they matter for text: raw text elements, void elements, implied ends (p, li, dt, dd, table
parts, option), unclosed elements, cut-off tags.  Block elements are nodes; the text runs between their tags are leaves.

Features of a node: its kind, attribute tokens (words of class, id and role, by groups of meaning), the same of its ancestors, depth,
text and link density of its subtree, its siblings' number and mean length, its place in the page.  The trees (logistic loss, depth
``DEPTH``, ``TREES`` of them) are fitted in numpy on ``TRAIN_PAGES`` invented pages (the documented bound) whose blocks are labelled as they are
written.  ``python -m quern.llm.html`` does that and writes ``html_model.npz``, which ``default_model`` loads.

Decoding.  A node's label says whether its subtree holds main text; a node with it needs a parent with it.  The labelling of
the largest total log-probability under that rule comes from one pass up and one down the tree; text comes from the leaves
that hold it.

One Arrow pass, no shuffle.  Pages are parsed and scored in groups of ``GROUP``; memory follows their size.

Defined cases: null or empty html gives an empty text; a page without main text too; broken UTF-8 is replaced; white space is
what Unicode calls so, after character references are decoded; unknown references stay; repeated rows give repeated results;
an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

TRAIN_PAGES, TREES, DEPTH, RATE, BINS, SEED = 900, 60, 4, 0.25, 32, 5
GROUP = 256
MODEL = os.path.join(os.path.dirname(os.path.abspath(__file__)), "html_model.npz")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=$|[\s/=])|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents aren't text of the page.  Without an end tag those of the first kind hold the rest of the page, as in browsers; of the others only the start tag goes.
_RAW = frozenset("script style iframe noframes xmp".split())
_APART = frozenset("title textarea noscript template svg canvas audio video annotation annotation-xml".split())
_INLINE = frozenset("math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mpadded mphantom menclose mmultiscripts mprescripts none mtable mtr mtd semantics a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input link meta base".split())
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW | _APART}
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "body": ("head",)}
_SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "tfoot": ("table",), "option": ("select",), "optgroup": ("select",), "body": ("html",)}
_TAGS = {t: k for k, group in enumerate(["p", "h1 h2 h3 h4 h5 h6 hgroup", "li ul ol dl dt dd dir", "nav menu", "header", "footer", "aside", "form button select option label fieldset legend input optgroup dialog search", "article main", "div section", "table tr td th tbody thead tfoot caption", "figure figcaption", "blockquote pre address"]) for t in group.split()}
_N_TAGS = 14
_LEXICON = {
    w: k
    for k, words in enumerate([
        "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc skip tabs", "header masthead top topbar banner site branding logo hero", "footer bottom copyright colophon contentinfo legal", "sidebar side aside widget widgets rail complementary column",
        "ad ads adv advert adverts advertisement sponsor sponsored promo promotion dfp", "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall warning privacy", "comment comments commentlist disqus reply replies discussion respond reader feedback reviews",
        "share sharing social follow facebook twitter", "related recommended recommendations trending popular more links tags meta also", "form search login signup register contact", "content main article post entry story body text page blog",
    ])
    for w in words.split()
}
_N_LEX = 11
_N_FLAGS = _N_TAGS + _N_LEX + 1


class Page:
    """Nodes in page order; a node's parent comes before it.  ``text`` is None for elements."""

    __slots__ = ("flags", "links", "parent", "tags", "text")

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.flags: list[int] = []
        self.text: list[str | None] = []
        self.links: list[int] = []
        self.tags: list[int] = []

    def add(self, parent: int, flags: int, text: str | None, links: int = 0) -> int:
        self.parent.append(parent)
        self.flags.append(flags)
        self.text.append(text)
        self.links.append(links)
        self.tags.append(0)
        return len(self.parent) - 1


@lru_cache(maxsize=8192)
def _flags(tag: str, attributes: str) -> int:
    out = 1 << _TAGS[tag] if tag in _TAGS else 0
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            for w in _WORDS.findall(m[2]):
                if (k := _LEXICON.get(w.lower())) is not None:
                    out |= 1 << (_N_TAGS + k)
        if _HIDDEN.search(attributes):
            out |= 1 << (_N_TAGS + _N_LEX)
    return out


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("", page.add(-1, 0, None))]
    pieces: list[str] = []
    state = [0, 0]  # open links, characters of the run inside links

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                page.add(stack[-1][1], 1 << (_N_TAGS - 1), text, min(state[1], len(text)))
        state[1] = 0

    def close(k: int) -> None:
        """Ends the elements from place k of the stack on."""
        if any(t not in _INLINE for t, _ in stack[k:]):
            flush()
        for t, _ in stack[k:]:
            state[0] -= t == "a"
        del stack[k:]

    def say(raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if state[0]:
                state[1] += len(text.strip())

    at, n = 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, ends, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if source[m.end() - 1] != ">":  # cut off
            break
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in _RAW or tag in _APART:
            page.tags[stack[-1][1]] += 1
            if attributes.rstrip().endswith("/") and tag == "svg":
                continue
            end = _END[tag].search(source, at)
            if end is None:
                if tag in _RAW:
                    break
                continue
            at = source.find(">", end.end())
            at = n if at < 0 else at + 1
            continue
        if tag in _INLINE:
            if tag == "br":
                pieces.append(" ")
            page.tags[stack[-1][1]] += 1
            if tag not in _VOID:
                stack.append((tag, stack[-1][1]))
                state[0] += tag == "a"
            continue
        flush()
        implied, scope = _IMPLIED.get(tag, ()), _SCOPE.get(tag, ())
        if implied:
            low = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in scope:
                    break
                if stack[k][0] in implied:
                    low = k
            if low:
                close(low)
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in _INLINE:
                    break
        if tag == "hr" or tag in _VOID:
            continue
        stack.append((tag, page.add(stack[-1][1], _flags(tag, attributes), None)))
        page.tags[stack[-1][1]] += 1
    flush()
    return page


_PUNCTUATION = str.maketrans("", "", ".,;:!?")
N_FEATURES = 2 * _N_FLAGS + 14


def features(page: Page) -> np.ndarray:
    n = len(page.parent)
    parent = page.parent
    depth, above = [0] * n, [0] * n
    chars, links, marks, leaves, tags, kids = [0] * n, list(page.links), [0] * n, [0] * n, list(page.tags), [0] * n
    for k in range(n):
        p = parent[k]
        if p >= 0:
            depth[k], above[k] = depth[p] + 1, above[p] | page.flags[p]
            kids[p] += 1
        if (t := page.text[k]) is not None:
            chars[k], leaves[k], marks[k] = len(t), 1, len(t) - len(t.translate(_PUNCTUATION))
    for k in range(n - 1, 0, -1):
        p = parent[k]
        chars[p] += chars[k]
        links[p] += links[k]
        marks[p] += marks[k]
        leaves[p] += leaves[k]
        tags[p] += tags[k]
    up = np.maximum(np.array(parent), 0)
    c, l, m, f, t, d, kid = (np.array(x, dtype=np.float32) for x in (chars, links, marks, leaves, tags, depth, kids))
    order = np.zeros(n, dtype=np.float32)
    seen = [0] * n
    for k in range(1, n):
        order[k] = seen[parent[k]]
        seen[parent[k]] += 1
    around = np.bincount(up[1:], weights=np.log1p(c[1:]), minlength=n)[up] / np.maximum(kid[up], 1) if n > 1 else np.zeros(n)
    own, over = np.array(page.flags, dtype=np.int64), np.array(above, dtype=np.int64)
    bits = np.arange(_N_FLAGS)
    numbers = np.stack([d, np.log1p(c), l / np.maximum(c, 1), np.log1p(c / np.maximum(f, 1)), m / np.maximum(c, 1), np.log1p(c / (t + 1)), kid, order, kid[up], around, c / max(c[0], 1), np.arange(n) / n, l[up] / np.maximum(c[up], 1), np.log1p(c[up])], axis=1)
    return np.concatenate([(own[:, None] >> bits) & 1, (over[:, None] >> bits) & 1, numbers], axis=1).astype(np.float32)


# --- trees


class Boosted:
    """Trees of a fixed depth in arrays: split feature and limit by node, value by leaf."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, value: np.ndarray) -> None:
        self.base, self.feature, self.limit, self.value = base, feature, limit, value

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base, dtype=np.float32), np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += value[at - (2**DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> Boosted:
    """Newton boosting on histograms of at most ``BINS`` bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, inner = np.full(len(x), base), 2**DEPTH - 1
    out = [np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, 2**DEPTH), np.float32)]
    for k in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h, at = y - p, p * (1 - p) + 1e-6, np.zeros(len(x), dtype=np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            best, pick = np.full(wide, 1e-3), [(0, -1)] * wide
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (at - first) * (len(e) + 1) + binned[:, j]
                gs = np.bincount(cell, g, wide * (len(e) + 1)).reshape(wide, -1)
                hs = np.bincount(cell, h, wide * (len(e) + 1)).reshape(wide, -1)
                gl, hl = gs.cumsum(axis=1)[:, :-1], hs.cumsum(axis=1)[:, :-1]
                gt, ht = gs.sum(axis=1, keepdims=True), hs.sum(axis=1, keepdims=True)
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                top = gain.argmax(axis=1)
                for w in np.flatnonzero(gain[np.arange(wide), top] > best):
                    best[w], pick[w] = gain[w, top[w]], (j, int(top[w]))
            go = np.zeros(len(x), dtype=np.int64)
            for w, (j, b) in enumerate(pick):
                if b >= 0:
                    out[0][k, first + w], out[1][k, first + w] = j, edges[j][b]
                    here = at == first + w
                    go[here] = binned[here, j] > b
            at = 2 * at + 1 + go
        leaf = at - inner
        value = rate * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        out[2][k] = value
        score = score + value[leaf]
    return Boosted(base, *out)


def decode(parent: list[int], logit: np.ndarray) -> list[bool]:
    """The most probable labelling in which each labelled node has a labelled parent."""
    keep, drop = (-np.logaddexp(0, -logit)).tolist(), (-np.logaddexp(0, logit)).tolist()
    n = len(parent)
    for k in range(n - 1, 0, -1):
        p = parent[k]
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    out = [False] * n
    for k in range(n):
        out[k] = keep[k] > drop[k] and (k == 0 or out[parent[k]])
    return out


def texts_of(pages: list[str], model: Boosted) -> list[str]:
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    logits = model.logit(np.concatenate([features(p) for p in parsed]))
    out, at = [], 0
    for p in parsed:
        label = decode(p.parent, logits[at : at + len(p.parent)])
        at += len(p.parent)
        out.append("\n\n".join(t for t, keep in zip(p.text, label) if keep and t is not None))
    return out


# --- labelled pages


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[Page, np.ndarray]]:
    """Invented pages of many layouts.  Main text is written between the signs U+E000 and U+E001, which are taken out
    again and give the leaves' labels; an element is labelled if a leaf below it is."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    some = lambda low, high: int(rng.integers(low, high + 1))
    chance = lambda p: rng.random() < p

    def words(low: int, high: int) -> str:
        out = ["".join(pick("etaoinshrdlucmfwypvbgkéüñß") for _ in range(some(1, 9))) for _ in range(some(low, high))]
        return " ".join(w + pick(["", "", "", "", "", "", ",", ".", "###" if chance(0.1) else ""]) for w in out).capitalize() + pick([".", ".", ""])

    def name(*options: str) -> str:
        value = pick(options)
        value = value + pick(["", "", "", "-" + pick(["box", "wrap", "area", "1", "inner"]), " " + pick(["clearfix", "col", "row"])])
        return f' {pick(["class", "class", "id"])}="{value}"'

    mark = lambda s: "\ue000" + s + "\ue001"
    link = lambda: f'<a href="/{some(1, 999)}">{words(1, 3)}</a>'

    def paragraph(main: bool) -> str:
        text = words(*pick([(1, 6), (5, 30), (30, 120)]))
        if chance(0.25):
            text += f" <{(t := pick(['b', 'i', 'em', 'strong', 'span', 'code']))}>{words(1, 8)}</{t}> {words(1, 12)}"
        if chance(0.15):
            text += f" {link()} {words(1, 10)}"
        if chance(0.1):
            text = f"<b>{text}<br>"
        return f"<p>{mark(text) if main else text}" + pick(["</p>", "</p>", "</p>", ""])

    def article() -> str:
        title = mark(words(2, 12))
        head = f"<h1>{title}</h1>" if chance(0.75) else (f"<header><h1>{title}</h1></header>" if chance(0.4) else "")
        body = []
        for _ in range(pick([0, 1, 1, 2, 3, 5, 9, 14])):
            draw = rng.random()
            if draw < 0.76:
                body.append(paragraph(True))
            elif draw < 0.84:
                body.append(f"<h{(h := some(2, 4))}>{mark(words(1, 7))}</h{h}>")
            elif draw < 0.9:
                body.append("<ul>" + "".join(f"<li>{mark(words(2, 20))}</li>" for _ in range(some(2, 6))) + "</ul>")
            elif draw < 0.93:
                body.append(f"<blockquote>{paragraph(True)}</blockquote>")
            elif draw < 0.95:
                body.append(f"<figure><img src=x><figcaption>{mark(words(2, 14))}</figcaption></figure>")
            elif draw < 0.97:
                body.append("<table>" + "".join(f"<tr><td>{mark(words(1, 4))}</td><td>{mark(words(1, 4))}</td></tr>" for _ in range(some(2, 4))) + "</table>")
            else:
                body.append(f"<pre>{mark(words(5, 30))}</pre>")
            if chance(0.12):
                body.append(pick([advert, share, notice, form, sidebar, menu])())
        if body and chance(0.12):
            body.append(pick([comments, footer, form, share])())
        if not head and not body:
            head = f"<h1>{title}</h1>"
        inner = head + "".join(body)
        if chance(0.1):
            return inner  # right below the body or the page's wrapper
        wrap = pick(["article", "article", "article", "main", "div", "div", "section"])
        bare = chance(0.2) if wrap in ("div", "section") else chance(0.7)
        attributes = "" if bare else name("content", "post", "entry-content", "article-body", "story", "main-text", "blog-post")
        out = f"<{wrap}{attributes}>{inner}</{wrap}>"
        return f"<main{pick(['', name('main', 'page-content')])}>{out}</main>" if chance(0.2) and wrap != "main" else out

    def menu() -> str:
        items = "<ul>" + "".join(f"<li>{link()}" + pick(["</li>", "</li>", ""]) for _ in range(some(3, 9))) + "</ul>"
        return pick([f"<nav>{items}</nav>", f"<nav{name('menu', 'navbar')}>{items}</nav>", f"<div{name('nav', 'menu', 'navigation', 'breadcrumbs')}>{items}</div>", f"<div{name('menu', 'breadcrumb')}>{' &gt; '.join(link() for _ in range(some(2, 5)))}</div>", f"<div role='navigation'>{items}</div>"])

    def header() -> str:
        inner = f"<h1>{words(1, 4)}</h1>" if chance(0.4) else f"<div>{words(1, 10)}</div>"
        inner += pick(["", menu(), f"<p>{words(3, 12)}</p>"])
        return pick([f"<header>{inner}</header>", f"<div{name('header', 'masthead', 'topbar', 'site-header')}>{inner}</div>", f"<header{name('banner', 'site-header')}>{inner}</header>"])

    def footer() -> str:
        inner = pick([f"&copy; {words(1, 12)}", f"<p>&copy; {some(1990, 2030)} {words(2, 40)}</p>", "".join(link() for _ in range(some(2, 6))), f"<p>{words(5, 60)}</p>"])
        return pick([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{name('footer', 'site-footer', 'copyright', 'bottom')}>{inner}</div>"])

    def advert() -> str:
        inner = pick([words(2, 40), f"<p>{words(3, 60)}</p>", f"<h3>{words(2, 5)}</h3><p>{words(5, 30)}</p>", link()])
        return f"<{(t := pick(['div', 'div', 'aside', 'section']))}{name('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo')}>{inner}</{t}>"

    def notice() -> str:
        inner = pick([words(3, 40), f"<p>{words(3, 60)}</p><button>{words(1, 2)}</button>"])
        return f"<{(t := pick(['div', 'div', 'section', 'aside']))}{name('cookie', 'cookie-notice', 'consent', 'notice', 'newsletter', 'popup', 'alert')}>{inner}</{t}>"

    def share() -> str:
        return f"<div{name('share', 'social', 'sharing')}>" + "".join(link() for _ in range(some(2, 5))) + "</div>"

    def sidebar() -> str:
        inner = "".join(pick([lambda: f"<h3>{words(1, 4)}</h3><ul>" + "".join(f"<li>{link()}</li>" for _ in range(some(2, 6))) + "</ul>", lambda: f"<div class='widget'><p>{words(3, 50)}</p></div>", lambda: f"<p>{words(3, 60)}</p>", lambda: words(3, 30)])() for _ in range(some(1, 3)))
        return pick([f"<aside>{inner}</aside>", f"<aside{name('sidebar', 'related', 'widgets')}>{inner}</aside>", f"<div{name('sidebar', 'widget', 'rail', 'related', 'side')}>{inner}</div>"])

    def form() -> str:
        return f"<form{pick(['', name('search', 'login', 'contact')])}><label>{words(1, 3)}</label><input name=q>" + pick(["", f"<p>{words(2, 20)}</p>", f"<select><option>{words(1, 2)}<option>{words(1, 2)}</select>"]) + f"<button>{words(1, 2)}</button></form>"

    def comments() -> str:
        each = "".join(pick([lambda: f"<div class='comment'><b>{words(1, 2)}</b>{paragraph(False)}</div>", lambda: f"<li class='comment'>{paragraph(False)}</li>", lambda: f"<article class='comment'>{paragraph(False)}{paragraph(False)}</article>", lambda: f"<p>{words(5, 90)}</p>"])() for _ in range(some(1, 6)))
        tag = pick(["div", "section", "ol", "aside"])
        return f"<{tag}{name('comments', 'comment-list', 'reader-comments', 'discussion', 'replies')}>{pick(['', f'<h2>{words(1, 3)}</h2>'])}{each}</{tag}>"

    out = []
    while len(out) < n:
        before = [x() for x in (header, menu, advert, notice, form, sidebar) if chance(0.45)]
        after = [x() for x in (comments, sidebar, advert, share, form, notice) if chance(0.35)] + ([footer()] if chance(0.85) else [])
        rng.shuffle(before)
        body = [*before, article() if chance(0.97) else "", *after]
        if chance(0.3):
            k = len(before)
            body[k : k + 2] = [f"<div{name('wrapper', 'container', 'page', 'layout')}>{''.join(body[k : k + 2])}</div>"]
        source = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{''.join(body)}</body></html>"
        if chance(0.15):
            source = source[: int(len(source) * rng.uniform(0.4, 1))]
        page = parse(source)
        label, inside = np.zeros(len(page.parent)), False
        for k, t in enumerate(page.text):
            if t is not None:
                label[k] = inside or "\ue000" in t
                if "\ue000" in t or "\ue001" in t:
                    inside = t.rfind("\ue000") > t.rfind("\ue001")
                page.text[k] = t.replace("\ue000", "").replace("\ue001", "")
        for k in range(len(label) - 1, 0, -1):
            label[page.parent[k]] = max(label[page.parent[k]], label[k])
        out.append((page, label))
    return out


def fit_pages(pages: list[tuple[Page, np.ndarray]]) -> Boosted:
    return fit(np.concatenate([features(p) for p, _ in pages]), np.concatenate([y for _, y in pages]))


@lru_cache(maxsize=1)
def default_model() -> Boosted:
    with np.load(MODEL) as stored:
        return Boosted(float(stored["base"]), stored["feature"].astype(np.int64), stored["limit"], stored["value"])


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Boosted | None = None) -> DataFrame:
    """(page_id, url, text) for each row of ``df``."""
    given = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, GROUP):
                batch = whole.slice(at, GROUP)
                pages = [(t or b"").decode("utf-8", "replace") for t in pc.cast(batch.column(2), pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.encode("utf-8", "replace").decode() for t in texts_of(pages, given)], pa.string())], names=["page_id", "url", "text"])

    return df.select(df[id_col].cast("bigint").alias("page_id"), df[url_col].cast("string").alias("url"), df[html_col].alias("html")).mapInArrow(run, "page_id bigint, url string, text string")


if __name__ == "__main__":
    made = fit_pages(labelled_pages())
    np.savez_compressed(MODEL, base=made.base, feature=made.feature.astype(np.int16), limit=made.limit, value=made.value)
