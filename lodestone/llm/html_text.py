"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: runs of text between block-level tags, with the
open elements above them. A two-label chain (main text or not) scores each
block by features of its ancestors and its text, and neighbouring labels by
transition weights; Viterbi finds the best labelling. The field is trained by
maximum likelihood on labelled pages that labelled_pages() composes.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br input nobr blink picture source track audio video svg path canvas map area object param embed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript title textarea iframe noembed noframes xmp svg math select option button".split())
#: an opening tag ends these open elements, up to the given container
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

# Elements that hold blocks; others above a block say nothing about it.
HOLDERS = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())

_RAW_START = re.compile(r"<(script|style|template|noscript|title|textarea|iframe|noembed|noframes|xmp|svg|math|select|button)(?=[\s/>])", re.I)
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
#: a tag without < in it: never reads past the next one
_PLAIN = re.compile(r"[^>\"'<]*+(?:(?:\"[^\"<]*+\"|'[^'<]*+')[^>\"'<]*+)*+>")
_UNQUOTED = re.compile(r"[^>\"']*+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*+>?", re.I) for t in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


class Element:
    """An open element that holds blocks, linked to the one around it."""

    __slots__ = ("parent", "tag", "names", "base")

    def __init__(self, parent: Element | None, tag: str, names: str) -> None:
        self.parent, self.tag, self.names = parent, tag, names
        self.base: tuple | None = None


class Block:
    """A leaf block: its text pieces, the element around it and the share of linked text."""

    __slots__ = ("pieces", "inside", "linked", "total", "text")

    def __init__(self, inside: Element | None) -> None:
        self.pieces: list[str] = []
        self.inside = inside
        self.linked = self.total = 0
        self.text = ""


class _Tags:
    """Where tags end. Quoted attributes may hold any sign; where quotes never close,
    a tag ends at the next >. Places from which quotes are known never to close are
    kept, so that all searches together read the page a few times at most."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.dead = page, page.rfind(">"), set()

    def end(self, at: int) -> int:
        """The position after the tag whose name ends at at; -1 if there is no more >."""
        if at > self.last:
            return -1
        m = _PLAIN.match(self.page, at)
        if m:
            return m.end()
        i, seen = at, []
        while i not in self.dead:
            seen.append(i)
            i = _UNQUOTED.match(self.page, i).end()
            if i >= len(self.page):
                break
            if self.page[i] == ">":
                return i + 1
            i = self.page.find(self.page[i], i + 1) + 1
            if not i:
                break
        self.dead.update(seen)
        return self.page.find(">", at) + 1


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page that have text, in order, in time linear in the page.
    Never fails: what does not parse as a tag is text, and unclosed elements end where
    a browser ends them. Character references are decoded in each piece of text."""
    out: list[Block] = []
    stack: list[tuple[str, Element | None]] = []
    places: dict[str, list[int]] = {}  # of open elements, by name
    holders: list[int] = []  # places of those that are not inline
    now: Block | None = None
    at, tags = 0, _Tags(page)

    def close(i: int) -> None:
        nonlocal now
        while len(stack) > i:
            places[stack.pop()[0]].pop()
        while holders and holders[-1] >= i:
            holders.pop()
            now = None

    def last(names: frozenset | set) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=-1)

    def text(piece: str) -> None:
        nonlocal now
        if not piece or (now is None and piece.isspace()):
            return
        if now is None:
            now = Block(stack[holders[-1]][1] if holders else None)
            out.append(now)
        n = len(piece)
        now.pieces.append(html.unescape(piece) if "&" in piece else piece)
        now.total += n
        now.linked += n if places.get("a") else 0

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        if page.startswith(("<!", "<?"), lt):
            end = page.find("-->", lt + 4) + 2 if page.startswith("<!--", lt) else page.find(">", lt)
            at = end + 1 if end > 1 else len(page)
            continue
        m = _RAW_START.match(page, lt)
        if m:
            raw, end = m[1].lower(), page.find(">", m.end())
            if end < 0:
                break
            stop = None if page[end - 1] == "/" and raw in ("svg", "math") else _RAW_END[raw].search(page, end)
            at = end + 1 if page[end - 1] == "/" and raw in ("svg", "math") else stop.end() if stop else len(page)
            continue
        m = _OPEN.match(page, lt)
        end = tags.end(m.end()) if m else -1
        if not m and page.startswith("</", lt):
            end = page.find(">", lt) + 1
            at = end or len(page)
            continue
        if end < 0:
            text("<")
            at = lt + 1
            continue
        at, name = end, m[2].lower()
        if m[1]:
            if places.get(name):
                close(places[name][-1])
            elif name not in INLINE:
                now = None
            continue
        if name == "br":
            text(" ")
            continue
        if name not in INLINE:
            now = None
            if holders and stack[holders[-1]][0] == "p":
                close(holders[-1])
            if name in CLOSES:
                ends, stop_at = (last(x) for x in CLOSES[name])
                if ends > stop_at:
                    close(ends)
        if name in VOID:
            continue
        element = None
        if name not in INLINE:
            attrs = page[m.end() : end - 1]
            names = " ".join(" ".join(x) for x in _NAMES.findall(attrs)).lower() if "=" in attrs else ""
            element = Element(stack[holders[-1]][1] if holders else None, name, names)
            holders.append(len(stack))
        places.setdefault(name, []).append(len(stack))
        stack.append((name, element))
    for b in out:
        b.text = " ".join("".join(b.pieces).split())
    return [b for b in out if b.text]


def _base(e: Element | None, known: dict | None) -> tuple[frozenset, frozenset]:
    """The features in=tag and name=word of an element and all around it, each from its
    parent's; with known, only those. html and body have none: they hold the whole page."""
    chain = []
    while e is not None and e.base is None:
        chain.append(e)
        e = e.parent
    base = e.base if e is not None else (frozenset(), frozenset())
    for x in reversed(chain):
        if x.tag not in ("html", "body"):
            new = {"name=" + w for w in _SPLIT.split(x.names) if w} | ({"in=" + x.tag} if x.tag in HOLDERS else set())
            new = {f for f in new if (known is None or f in known) and f not in base[0]}
            own = frozenset("own=" + w for w in _SPLIT.split(x.names) if w and (known is None or "own=" + w in known)) if x.names else frozenset()
            base = (base[0] | new if new else base[0], own)
        x.base = base
    return base


def features(page: list[Block], known: dict | None = None) -> list[list[str]]:
    """Names of the features that each block of a page has; of those of the elements
    around it, only known ones if these are given."""
    out = []
    for i, b in enumerate(page):
        base, own = _base(b.inside, known)
        if not own and b.inside is not None and b.inside.parent is not None:
            own = _base(b.inside.parent, known)[1]
        f = ["bias", "tag=" + (b.inside.tag if b.inside else ""), *base, *own]
        words = len(b.text.split())
        f.append(f"words={min(7, words.bit_length())}")
        share = b.linked / max(1, b.total)
        f.append("links=" + ("none" if not share else "some" if share < 0.5 else "most" if share < 0.95 else "all"))
        last = b.text[-1]
        f.append("end=" + ("stop" if last in ".!?…\"'”»)" else "colon" if last == ":" else "other"))
        if "©" in b.text:
            f.append("sign=copyright")
        if "|" in b.text or "·" in b.text or "»" in b.text:
            f.append("sign=bar")
        if i == 0:
            f.append("place=first")
        if i == len(page) - 1:
            f.append("place=last")
        if words <= 14:
            f += {"word=" + w for w in _WORD.findall(b.text.lower()) if w in CUES}
        out.append(f)
    return out


# Words that tell notices, menus, forms and the like in short blocks.
CUES = frozenset("""
about accept ad advertisement advertising all also article articles audio back bookmark by cart categories category checkout click
comment comments consent contact continue cookie cookies copyright email enter facebook follow footer forum gdpr help home instagram
latest linkedin load log login logout menu more news newsletter next notice page password pinterest policy popular post posted posts
previous print privacy promoted read recent recommended register related reply reserved rights rss save search share sign site sitemap
skip social sponsored sponsor submit subscribe subscription tags terms topics trending tweet twitter updated username video videos view
views whatsapp youtube your
""".split())


def _sentence(r: random.Random, n: int) -> str:
    words = ["".join(r.choice("bcdfghlmnprstvw") + r.choice("aeiouéäö") for _ in range(r.randint(1, 4))) for _ in range(n)]
    if r.random() < 0.25:
        words.insert(r.randrange(len(words) + 1), r.choice(sorted(CUES)))
    return " ".join(words).capitalize()


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, set[int]]]:
    """n composed pages, each with the set of its main blocks (their numbers).

    Main text is marked by a private character while a page is composed, so
    labels come from what a part is, not from how it looks. Layouts vary over
    semantic and generic markup, order of parts, missing end tags and wording.
    """
    r = random.Random(seed)
    mark = "\ue000"
    pick = r.choice

    def wrap(tag: str, names: list[str], body: str) -> str:
        if r.random() < 0.5 and tag:
            return f"<{tag}>{body}</{tag}>" if r.random() < 0.5 else f'<{tag} class="{pick(names)}">{body}</{tag}>'
        return f'<div {pick(["class", "id"])}="{pick(names)}">{body}</div>'

    def line(lo: int, hi: int, main: bool = False, stop: float = 0.5) -> str:
        return (mark if main else "") + _sentence(r, r.randint(lo, hi)) + ("." if r.random() < stop else "")

    def links(k: int) -> str:
        items = [f'<a href="/{i}">{line(1, 3, stop=0.1)}</a>' for i in range(k)]
        return pick([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<span>{x}</span> " for x in items)])()

    def cue(*words: str) -> str:
        return pick(words)

    def deep(body: str) -> str:
        k = r.choice([0, 0, 0, 0, 2, 5, 9])
        return "<div>" * k + body + "</div>" * k

    def boiler(kind: str) -> str:
        if kind == "nav":
            return wrap("nav", ["menu", "nav", "navbar", "navigation", "top-menu", "breadcrumb", "breadcrumbs"], links(r.randint(2, 8)))
        if kind == "header":
            return wrap("header", ["header", "site-header", "masthead", "banner", "topbar"], pick(["<h1>", "<p>", "<div>", "<h2>"]) + line(1, 4, stop=0.1) + pick(["", f"<p>{line(3, 9)}</p>", links(3)]))
        if kind == "ad":
            return f'<div {pick(["class", "id"])}="{pick(["ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner-ad", "sponsored"])}">{pick(["", "<p>"])}{line(3, 30, stop=0.8)}</div>'
        if kind == "aside":
            body = "".join(pick([f"<p>{line(4, 30, stop=0.8)}</p>", links(4), f"<h3>{line(1, 4, stop=0)}</h3>"]) for _ in range(r.randint(1, 4)))
            return wrap("aside", ["sidebar", "side", "widget", "related", "related-posts", "recommended", "popular", "rail"], deep(body))
        if kind == "notice":
            return f'<div {pick(["class", "id"])}="{pick(["cookie", "cookie-notice", "notice", "consent", "gdpr-banner", "alert", "newsletter", "popup", "modal", "paywall", "message"])}"><p>{pick([cue("We use cookies", "Accept all cookies", "Subscribe to our newsletter", "Sign up"), ""])} {line(4, 30, stop=0.9)}</p>{pick(["", "<a href=#>Accept</a>"])}</div>'
        if kind == "form":
            return f'<form action="/x"><label>{cue("Email", "Search", "Your name", "Password", "Username")}</label><input type="text"><p>{line(2, 12)}</p><div>{cue("Submit", "Subscribe", "Log in")}</div></form>'
        if kind == "comments":
            body = "".join(f'<{t} class="comment"><{pick(["b", "cite", "span"])}>{line(1, 2, stop=0)}</{"b"}>{deep(f"<p>{line(3, 40, stop=0.9)}</p>")}{pick(["", "<a href=#>Reply</a>"])}</{t}>' for t in [pick(["div", "li", "article", "section"])] for _ in range(r.randint(1, 5)))
            return wrap("section", ["comments", "comment-list", "discussion", "responses", "replies", "reader-comments", "disqus"], pick(["", "<h3>Comments</h3>"]) + body) if r.random() < 0.3 else f'<{(t := pick(["section", "div", "ol"]))} {pick(["class", "id"])}="{pick(["comments", "comment-list", "discussion", "responses", "reader-comments", "replies"])}">{pick(["", "<h3>Comments</h3>"])}{body}</{t}>'
        if kind == "share":
            return f'<div class="{pick(["share", "social", "tags", "meta", "byline", "post-meta", "author-box"])}">{pick([links(3), line(2, 6, stop=0.1)])}</div>'
        text = pick(["&copy; " + line(1, 8), "&copy; x.example.com &middot; " + line(2, 16, stop=0.8), links(4), f"<p>{line(2, 20, stop=0.8)}</p>"])
        return wrap("footer", ["footer", "site-footer", "bottom", "copyright", "colophon"], text)

    def para() -> str:
        body = mark + " ".join(_sentence(r, r.choice([1, 2, 4, 8, 14, 25])) + "." for _ in range(r.choice([1, 1, 2, 3, 5, 12])))
        if r.random() < 0.2:
            body = body[:-1]
        if r.random() < 0.2:
            body += f' <a href="/y">{_sentence(r, 2)}</a> {_sentence(r, 4)}.'
        if r.random() < 0.1:
            body = f"{mark}<a href=/z>{body[1:]}</a>"
        return pick([f"<p>{body}</p>"] * 6 + [f"<p><b>{body}<br>", f"<p>{body}", f"<div>{body}</div>", f"<p>{body}<br>{_sentence(r, 5)}.</p>"])

    def article() -> str:
        body = ""
        if r.random() < 0.85:
            h = f"<{(t := pick(['h1', 'h1', 'h2']))}>{line(1, 14, True, 0.2)}</{t}>"
            body += f"<header>{h}</header>" if r.random() < 0.15 else h
        if r.random() < 0.15:
            body += boiler("share")
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9, 14])):
            x = r.random()
            if x < 0.72:
                body += para()
            elif x < 0.78:
                body += f"<h{(k := r.randint(2, 4))}>{line(1, 8, True, 0.1)}</h{k}>"
            elif x < 0.82:
                body += "<ul>" + "".join(f"<li>{line(1, 20, True)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
            elif x < 0.84:
                body += f"<blockquote><p>{line(4, 30, True, 0.9)}</p></blockquote>"
            elif x < 0.86:
                body += f"<pre>{line(2, 20, True, 0.2)}</pre>"
            elif x < 0.88:
                body += "<table>" + "".join(f"<tr><td>{line(1, 3, True, 0)}</td><td>{line(1, 3, True, 0)}</td></tr>" for _ in range(3)) + "</table>"
            elif x < 0.89:
                body += f"<figure><img src=x><figcaption>{line(2, 12, True)}</figcaption></figure>"
            else:
                body += boiler(pick(["ad", "ad", "aside", "aside", "notice", "notice", "form", "share"]))
                body += para() if r.random() < 0.5 else ""
        if r.random() < 0.12:
            body += boiler("comments")
        t = r.random()
        if t < 0.5:
            return f"<article>{body}</article>"
        if t < 0.63:
            return f"<main>{body}</main>"
        if t > 0.93:
            return body
        return f'<div {pick(["class", "id"])}="{pick(["content", "main", "post", "entry-content", "article-body", "story", "body-text"])}">{body}</div>'

    pages = []
    for _ in range(n):
        kinds = ["nav", "header", "ad", "aside", "notice", "form", "share"]
        before = "".join(boiler(k) for k in r.sample(kinds, r.randint(0, 4)))
        after = "".join(boiler(k) for k in r.sample(["ad", "aside", "notice", "form", "comments", "share", "nav"], r.randint(0, 4)))
        middle = article()
        foot = boiler("footer") if r.random() < 0.9 else ""
        if r.random() < 0.12:
            before = after = foot = ""
        if r.random() < 0.05:
            before = after = foot = ""
            middle = "".join(para() for _ in range(r.choice([1, 1, 2, 4])))
        if r.random() < 0.3 and middle.startswith("<article"):
            middle = f"<main>{middle}{boiler('aside') if r.random() < 0.4 else ''}{boiler('comments') if r.random() < 0.3 else ''}</main>"
        if r.random() < 0.15:  # named parts far above their texts
            before, after, foot = (f'<div>{x}</div>' if r.random() < 0.5 else x for x in (before, after, foot))
        if r.random() < 0.15:
            middle = f"<div><div><div>{middle}</div></div></div>"
        page = f"<html><head><title>{line(1, 9)}</title><style>p{{}}</style></head><body>{before}{middle}{after}{foot}" + ("</body></html>" if r.random() < 0.9 else "")
        found = blocks(page)
        main = {i for i, b in enumerate(found) if mark in b.text}
        pages.append((page.replace(mark, ""), main))
    return pages


class Field:
    """Weights of a trained field: per feature and label, and between labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.names, self.weights, self.moves = names, weights, moves
        self.cache: dict[str, float] = {k: float(weights[i, 1] - weights[i, 0]) for k, i in names.items()}

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi: the best labels of a page's blocks."""
        get, (stay0, to1), (to0, stay1) = self.cache.get, self.moves[0].tolist(), self.moves[1].tolist()
        a = b = 0.0
        back: list[tuple[int, int]] = []
        for i, f in enumerate(features(page, self.names)):
            gain = sum(get(x, 0.0) for x in f)
            if i == 0:
                a, b = 0.0, gain
                continue
            a0, a1, b0, b1 = a + stay0, b + to0, a + to1, b + stay1
            back.append((int(a1 > a0), int(b1 >= b0)))
            a, b = max(a0, a1), max(b0, b1) + gain
        label = [b > a]
        for x in reversed(back):
            label.append(bool(x[label[-1]]))
        return label[::-1] if page else []


def fit(pages: list[tuple[str, set[int]]], rounds: int = 200, l2: float = 0.02) -> Field:
    """Maximum likelihood with an L2 penalty; forward-backward over all pages at once."""
    names: dict[str, int] = {}
    rows: list[tuple[int, int]] = []
    found = [(b, main) for p, main in pages if (b := blocks(p))]
    longest, n = max(len(b) for b, _ in found), len(found)
    real, gold = np.zeros((n, longest), bool), np.zeros((n, longest), np.int64)
    for i, (b, main) in enumerate(found):
        for j, f in enumerate(features(b)):
            real[i, j], gold[i, j] = True, j in main
            rows += [(i * longest + j, names.setdefault(x, len(names))) for x in f]
    cell, feat = np.array(rows).T
    w, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
    m, v = np.zeros(len(names) * 2 + 4), np.zeros(len(names) * 2 + 4)
    truth = np.stack([np.bincount(feat, weights=(gold.ravel() == y)[cell], minlength=len(names)) for y in (0, 1)], axis=1)
    both = real[:, 1:] & real[:, :-1]
    truth_moves = np.array([[np.sum(both & (gold[:, :-1] == x) & (gold[:, 1:] == y)) for y in (0, 1)] for x in (0, 1)])
    for t in range(1, rounds + 1):
        s = np.stack([np.bincount(cell, weights=w[feat, y], minlength=n * longest) for y in (0, 1)], axis=1).reshape(n, longest, 2)
        up, down = np.zeros_like(s), np.zeros_like(s)
        up[:, 0] = s[:, 0]
        for j in range(1, longest):
            step = np.logaddexp.reduce(up[:, j - 1, :, None] + moves, axis=1) + s[:, j]
            up[:, j] = np.where(real[:, j, None], step, up[:, j - 1])
        for j in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves[None] + (s[:, j + 1] + down[:, j + 1])[:, None, :], axis=2)
            down[:, j] = np.where(real[:, j + 1, None], step, 0.0)
        z = np.logaddexp.reduce(up[:, -1], axis=1)
        p = np.exp(up + down - z[:, None, None]) * real[:, :, None]
        expected = np.stack([np.bincount(feat, weights=p[:, :, y].ravel()[cell], minlength=len(names)) for y in (0, 1)], axis=1)
        pair = np.exp(up[:, :-1, :, None] + moves + (s + down)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        g = np.concatenate([((expected - truth) / n + l2 * w / n * 2).ravel(), ((pair.sum(axis=(0, 1)) - truth_moves) / n).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.25 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, moves = w - step[:-4].reshape(-1, 2), moves - step[-4:].reshape(2, 2)
    return Field(names, w, moves)


@lru_cache(1)
def trained(pages: int = 800, seed: int = 11) -> Field:
    """The field of production: fitted on composed pages, the same in every run."""
    return fit(labelled_pages(pages, seed))


def main_text(page: str | None, field: Field) -> str:
    """The main blocks of a page, joined by line feeds; empty for null."""
    found = blocks(page or "")
    return "\n".join(b.text for b, main in zip(found, field.decode(found), strict=True) if main)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    Null and empty pages give an empty text. Whole pages are read, however long
    and however broken their markup. Repeated rows stay; an empty table gives an
    empty result; other columns are ignored.
    """
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py(), field) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
