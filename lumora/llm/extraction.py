"""Main text of web pages by a tree-structured graphical model.

The nodes of a page's tree are its block elements and those inline ones whose names say what they are. Each has a hidden label,
content or not. Its own features (kind of element, words in class, id and role, its own and those of elements above, amount of text, share of links,
of itself and of what is below) give a potential, and each parent and child share one, which depends on what the child is. Sum-product messages
up and down the tree give every node's exact marginal; text of nodes with a marginal of at least 0.5 is the page's.

The weights maximise the likelihood of labelled pages (gradients from the same messages) under a Gaussian prior. Labelled pages
come from pages that mark one main part themselves (``<article>``, ``<main>``): their nodes are content below it and not
elsewhere. Those pages are also rebuilt from their own pieces with the main part under other elements and names, and with
menus, bars, notices, adverts, forms, sidebars and comments of various names around and inside it, so that the model also reads
pages that mark nothing. A page may give labels itself: an attribute ``data-label`` of 1 or 0 holds for what is below, too.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm import dom
from lumora.llm.common import out_schema, release_after, row_key, small_batches, thinned

# Words of class, id and role names.
CHROME_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs byline caption comment comments commentlist contentinfo cookie consent copyright credits dialog disqus dropdown feedback foot footer form gdpr head header login masthead menu menubar meta modal nav navbar navigation "
    "newsletter notice alert pager pagination paywall popup popular promo promoted promotion recommend recommended related reply replies respond response responses search share sharing shoutbox sidebar sign signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar trending warning widget widgets".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
CHROME_TAGS = frozenset("nav footer header aside form menu search dialog fieldset legend".split())
#: Landmarks by which pages mark their main part.
LANDMARK = re.compile(r"<(article|main)\b[^>]*>(.*)</\1\s*>", re.S | re.I)
#: Pages rebuilt from each sampled page, and bounds of the sample (read by the driver).
REBUILT, MOST_PAGES, MOST_CHARS = 3, 300, 100_000
_TAGS = ("h1", "h", "p", "list", "item", "div", "section", "article", "main", "chrome", "table", "cell", "quote", "figure", "page", "inline", "other")
_KIND = {"h1": "h1", "p": "p", "div": "div", "section": "section", "article": "article", "main": "main", "html": "page", "body": "page", "#page": "page", "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure", "table": "table"}
_KIND |= {f"h{n}": "h" for n in range(2, 7)} | dict.fromkeys(("ul", "ol", "dl", "dir"), "list") | dict.fromkeys(("li", "dt", "dd"), "item") | dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot", "caption"), "cell") | dict.fromkeys(CHROME_TAGS, "chrome")
_WORDS, _SHARES = (0, 2, 8, 25, 80), (0.0, 0.25, 0.6, 0.9)
_SIZES = (len(_TAGS), 2, 2, 2, len(_WORDS) + 1, len(_SHARES) + 1, len(_WORDS) + 1, len(_SHARES) + 1, 2, 2, 2, 2)
_AT = np.concatenate([[0], np.cumsum(_SIZES)])
N_FEATURES = int(_AT[-1])
#: What a child is, for the potential it shares with its parent: marked as chrome, as main part, a heading, inline, else.
N_EDGES = 5
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END = re.compile(r"[.!?…][\"'»”’)\]]*\s*\Z")


def names(attrs: dict[str, str]) -> tuple[bool, bool]:
    """Whether the names of an element say that it is not content, and that it is."""
    words = {w.lower() for k in ("class", "id", "role", "itemprop", "aria-label") if k in attrs for w in _NAME.findall(attrs[k])}
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", "")))
    return hidden or not words.isdisjoint(CHROME_WORDS), not words.isdisjoint(MAIN_WORDS)


def _wanted(tag: str, attrs: dict[str, str]) -> bool:
    return any(names(attrs)) or "data-label" in attrs


@dataclass
class Forest:
    """Trees of several pages laid out together: nodes by depth, each with its active features and its kind of edge."""

    doms: list[dom.Dom]
    first: np.ndarray  # of each page
    parents: np.ndarray
    levels: list[np.ndarray]
    features: np.ndarray
    edges: np.ndarray


def _bucket(values: np.ndarray, bounds: tuple[float, ...]) -> np.ndarray:
    return np.searchsorted(np.asarray(bounds), values, "left")


def plant(doms: list[dom.Dom]) -> Forest:
    first = np.concatenate([[0], np.cumsum([len(d.tags) for d in doms])]).astype(np.int64)
    n = int(first[-1])
    parents = np.concatenate([np.where((p := np.array(d.parents)) < 0, -1, p + at) for d, at in zip(doms, first, strict=False)]) if doms else np.empty(0, np.int64)
    depths = np.concatenate([np.array(d.depths) for d in doms]) if doms else np.empty(0, np.int64)
    own, linked, ends = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    kind, chrome, main, copy = np.empty(n, np.int64), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    tag_id = {t: i for i, t in enumerate(_TAGS)}
    for d, at in zip(doms, first, strict=False):
        for i, (tag, attrs) in enumerate(zip(d.tags, d.attrs, strict=True), int(at)):
            kind[i] = tag_id[_KIND.get(tag, "other" if tag in dom.BLOCK else "inline")]
            if attrs:
                chrome[i], main[i] = names(attrs)
        for node, _, in_link, part in d.pieces:
            words = len(part.split())
            if words:
                i = int(at) + node
                own[i] += words
                linked[i] += words * in_link
                ends[i] = bool(_END.search(part))
                copy[i] |= "©" in part
    chrome |= kind == tag_id["chrome"]
    by_depth = np.argsort(depths, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depths[by_depth])) + 1) if n else []
    below, below_linked = own.copy(), linked.copy()
    for rows in levels[:0:-1]:
        np.add.at(below, parents[rows], below[rows])
        np.add.at(below_linked, parents[rows], below_linked[rows])
    share = lambda a, b: _bucket(np.divide(a, b, out=np.zeros(n), where=b > 0), _SHARES)
    is_main = main | (kind == tag_id["article"]) | (kind == tag_id["main"])
    under = np.zeros((n, 2), bool)
    for rows in levels[1:]:
        above = parents[rows]
        under[rows] = under[above] | np.stack([chrome[above], is_main[above] & ~chrome[above]], 1)
    groups = (kind, chrome, main, ends, _bucket(own, _WORDS), share(linked, own), _bucket(below, _WORDS), share(below_linked, below), copy, (own == 0) & (below > 0), under[:, 0], under[:, 1])
    features = np.stack([g.astype(np.int64) + at for g, at in zip(groups, _AT, strict=False)], 1)
    heading = (kind == tag_id["h1"]) | (kind == tag_id["h"])
    edges = np.select([chrome, is_main, heading, kind == tag_id["inline"]], [0, 1, 2, 3], 4)
    return Forest(doms, first, parents, levels, features, edges)


def marginals(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each node P(content), of each node P(parent's label, own label) (zero for roots), and the sum of log partition functions.

    ``unary``: log-odds of content; ``pair``: log potentials [kind of edge, parent's label, own label].
    """
    n = len(forest.parents)
    inner = np.stack([np.zeros(n), unary], 1)  # own potential and what children say
    up = np.zeros((n, 2))  # to the parent
    for rows in forest.levels[:0:-1]:
        both = pair[forest.edges[rows]] + inner[rows][:, None, :]
        up[rows] = np.logaddexp(both[..., 0], both[..., 1])
        np.add.at(inner, forest.parents[rows], up[rows])
    down, joint, total = np.zeros((n, 2)), np.zeros((n, 2, 2)), 0.0
    belief = inner
    for depth, rows in enumerate(forest.levels):
        if depth:
            parent = forest.parents[rows]
            rest = belief[parent] - up[rows]
            both = pair[forest.edges[rows]] + inner[rows][:, None, :] + rest[:, :, None]
            norm = both.max((1, 2), keepdims=True)
            e = np.exp(both - norm)
            joint[rows] = e / e.sum((1, 2), keepdims=True)
            from_parent = pair[forest.edges[rows]] + rest[:, :, None]
            down[rows] = np.logaddexp(from_parent[:, 0], from_parent[:, 1])
            belief[rows] = inner[rows] + down[rows]
        else:
            total = float(np.logaddexp(inner[rows, 0], inner[rows, 1]).sum())
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint, total


def labels(forest: Forest) -> np.ndarray:
    """The label of each node: its own ``data-label``, or else its parent's; none is 0."""
    out = np.zeros(len(forest.parents), np.int64)
    own = np.concatenate([[{"1": 1, "0": 0}.get(a.get("data-label", ""), -1) for a in d.attrs] for d in forest.doms]) if forest.doms else out
    for depth, rows in enumerate(forest.levels):
        out[rows] = np.where(own[rows] >= 0, own[rows], out[forest.parents[rows]] if depth else 0)
    return out


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def content(self, forest: Forest) -> np.ndarray:
        return marginals(forest, self.weights[forest.features].sum(1), self.pair)[0]


def prior() -> tuple[np.ndarray, np.ndarray]:
    """Means of the weights' prior: names speak, neighbours agree. They decide where no page is labelled."""
    w, pair = np.zeros(N_FEATURES), np.zeros((N_EDGES, 2, 2))
    w[_AT[1] + 1], w[_AT[2] + 1] = -3.0, 2.0
    w[_AT[0] + _TAGS.index("article")] = w[_AT[0] + _TAGS.index("main")] = 3.0
    w[_AT[0] + _TAGS.index("page")] = -2.0
    w[_AT[10] + 1], w[_AT[11] + 1] = -3.0, 1.0
    pair[:, 0, 0] = pair[:, 1, 1] = 1.0
    return w, pair


def fit(pages: list[str], *, steps: int = 200, rate: float = 0.1, variance: float = 4.0) -> Model:
    """The weights of greatest posterior for pages whose elements have ``data-label``."""
    w0, pair0 = prior()
    if not pages:
        return Model(w0, pair0)
    forest = plant([dom.read(p, _wanted) for p in pages])
    y, inner = labels(forest), np.flatnonzero(forest.parents >= 0)
    seen = np.zeros((N_EDGES, 2, 2))
    np.add.at(seen, (forest.edges[inner], y[forest.parents[inner]], y[inner]), 1)
    x = np.concatenate([w0, pair0.ravel()])
    mean, m, v = x.copy(), np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        w, pair = x[:N_FEATURES], x[N_FEATURES:].reshape(N_EDGES, 2, 2)
        p, joint, _ = marginals(forest, w[forest.features].sum(1), pair)
        g = np.zeros_like(x)
        g[:N_FEATURES] = np.bincount(forest.features.ravel(), np.repeat(y - p, forest.features.shape[1]), N_FEATURES)
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.edges[inner], joint[inner])
        g[N_FEATURES:] = (seen - expected).ravel()
        g = (g - (x - mean) / variance) / len(pages)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(x[:N_FEATURES], x[N_FEATURES:].reshape(N_EDGES, 2, 2))


# Names of rebuilt parts: element and attributes, by kind.
_PARTS = {
    "menu": ("<nav>", '<div class="navbar">', '<ul class="menu">', '<div id="nav-main">', '<header>', '<div role="navigation">', '<div class="breadcrumbs">', '<ul id="top-menu">', '<div class="toolbar">'),
    "header": ("<header>", '<div class="site-header">', '<div id="masthead">', '<div role="banner">', '<div id="header">'),
    "notice": ('<div class="cookie-notice">', '<div role="alert">', '<div id="gdpr">', '<p class="notice">', '<div class="newsletter">', '<div class="paywall">', '<aside class="promo">'),
    "advert": ('<div class="ad">', '<div class="sponsored">', '<aside>', '<div id="ad-top">', '<p class="advert">', '<section class="advertisement">'),
    "form": ("<form>", '<div class="signup">', '<div id="login-form">', '<form class="search">', '<div class="subscribe">'),
    "sidebar": ("<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<section class="related">', '<div role="complementary" class="popular">'),
    "comments": ('<section class="comments">', '<div id="comments">', '<ol class="commentlist">', '<div class="responses">', '<div id="disqus_thread">', '<section id="reader-comments">'),
    "footer": ("<footer>", '<div class="footer">', '<div id="site-footer">', '<div role="contentinfo">'),
}
_MAINS = ("<article>", "<main>", '<article class="post">', '<div class="content">', '<div id="main-content">', '<div class="entry-content">', '<div class="article-body">', '<div class="post">', '<section>', "<div>", '<div role="main">', '<section class="story">')
_WRAPS = ("", "", "<div>", '<div class="container">', '<div id="page">', "<section>")


def _closed(start: str, inner: str, label: str = "") -> str:
    """``inner`` under the start tag, with a label."""
    tag = re.match(r"<(\w+)", start)[1]
    return f"<{tag}{label}{start[len(tag) + 1:]}{inner}</{tag}>"


def label_page(html_text: str, rnd: random.Random | None = None) -> str | None:
    """The page with labels, as it is or (with ``rnd``) rebuilt from its pieces; None if it marks no main part, or several."""
    m = LANDMARK.search(html_text)
    if m is None or len(re.findall(rf"<{m[1]}\b", html_text, re.I)) > 1:
        return None
    if rnd is None:
        return html_text[: m.start()] + re.sub(r"\A<(\w+)", r'<\1 data-label="1"', m[0]) + html_text[m.end() :]
    around = dom.read(html_text[: m.start()] + "<p>" + html_text[m.end() :], _wanted)
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").strip()
    links = [esc(s) for _, _, link, s in around.pieces if link and s.strip()] or ["Home", "About"]
    shorts = [esc(s) for _, _, link, s in around.pieces if not link and s.strip()] or ["Read more."]
    blocks = [esc(x) for x in dom.lines(dom.read(m[2]), np.ones(1 << 16, bool)).split("\n")[:50] if x] or ["Text."]
    some = lambda xs, a, b: [rnd.choice(xs) for _ in range(rnd.randint(a, b))]
    anchor = lambda s: f'<a href="/x">{s}</a>'
    para = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
    items = lambda xs: "<ul>" + "".join(f"<li>{x}</li>" for x in xs) + "</ul>"

    def part(kind: str) -> str:
        if kind == "menu":
            inner = items(map(anchor, some(links, 3, 9))) if rnd.random() < 0.7 else " | ".join(map(anchor, some(links, 3, 9)))
        elif kind == "header":
            inner = rnd.choice([f"<h1>{rnd.choice(shorts)}</h1>", f"<div>{anchor(rnd.choice(links))}</div>" + para(some(shorts, 0, 1)), rnd.choice(shorts)])
        elif kind in ("notice", "advert"):
            inner = rnd.choice([rnd.choice(shorts), para(some(shorts, 1, 2)), rnd.choice(shorts) + " " + anchor(rnd.choice(links)), f"<h4>{rnd.choice(shorts)}</h4>" + para(some(blocks, 1, 1))])
        elif kind == "form":
            inner = "".join(f"<label>{x}</label> <input>" for x in some(links, 1, 3)) + f"<button>{rnd.choice(links)}</button>" + para(some(shorts, 0, 1))
        elif kind == "sidebar":
            inner = f"<h3>{rnd.choice(links)}</h3>" + rnd.choice([items(map(anchor, some(links, 2, 6))), para(some(shorts, 1, 3)), para(some(blocks, 1, 2)), items(some(shorts, 2, 3))])
        elif kind == "comments":
            inner = f"<h3>{rnd.choice(links)}</h3>" + "".join(rnd.choice([f"<div><b>{rnd.choice(links)}</b>{para(some(blocks, 1, 2))}</div>", f"<li>{rnd.choice(blocks)}</li>", para(some(blocks + shorts, 1, 1)), f"<article><p>{rnd.choice(blocks)}</p></article>"]) for _ in range(rnd.randint(1, 5)))
        else:
            inner = rnd.choice(["", "&copy; "]) + rnd.choice([rnd.choice(shorts), para(some(shorts, 1, 2)), items(map(anchor, some(links, 2, 5))), rnd.choice(shorts) + " " + anchor(rnd.choice(links))])
        return _closed(rnd.choice(_PARTS[kind]), inner, ' data-label="0"')

    maybe = lambda kind, share: part(kind) if rnd.random() < share else ""
    inner = re.sub(r"<(h[1-6])\b.*?</\1\s*>", "", m[2], flags=re.S | re.I) if rnd.random() < 0.4 else m[2]
    borders = [x.start() for x in re.finditer(r"<p\b", inner)]
    inside = rnd.choice(["advert", "notice", "sidebar", "form", "menu"])
    if borders and rnd.random() < 0.5:
        at = rnd.choice(borders)
        inner = inner[:at] + part(inside) + inner[at:]
    if rnd.random() < 0.3:
        inner = f"<div>{inner}</div>"
    if rnd.random() < 0.3:
        inner += rnd.choice([f"<blockquote>{rnd.choice(blocks)}</blockquote>", items(some(blocks, 1, 3)), f"<table><tr><td>{rnd.choice(blocks)}</td></tr></table>", f"<h2>{rnd.choice(blocks)[:40]}</h2><p>{rnd.choice(blocks)}</p>"])
    if (comments := rnd.random()) < 0.3:
        inner += part("comments")
    middle = _closed(rnd.choice(_MAINS), inner, ' data-label="1"') + maybe("sidebar", 0.5) + (part("comments") if comments > 0.7 else "")
    wrap = rnd.choice(_WRAPS)
    middle = _closed(wrap, maybe("notice", 0.2) + middle) if wrap else middle
    return f"<html><body>{maybe('header', 0.4)}{maybe('menu', 0.8)}{maybe('notice', 0.3)}{maybe('advert', 0.4)}{maybe('form', 0.2)}{middle}{maybe('advert', 0.2)}{maybe('menu', 0.2)}{maybe('footer', 0.8)}</body></html>"


def fit_pages(pages: DataFrame, *, html_col: str = "html", most_pages: int = MOST_PAGES, most_chars: int = MOST_CHARS) -> Model:
    """A model from at most ``most_pages`` pages of at most ``most_chars`` characters that mark their main part, drawn by a hash of
    the page, so rows that repeat are one. Runs two jobs when called; without such pages the prior's means are the model."""
    marked = pages.select(F.col(html_col).alias("html")).where(F.col("html").rlike(r"(?i)</(article|main)\s*>") & (F.length("html") <= most_chars))
    chosen = thinned(marked, row_key("html"), most_pages, marked.count(), "html").orderBy("_u").limit(most_pages).collect()
    out = []
    for r in chosen:
        rnd = random.Random(r["_u"])
        out += [x for x in (label_page(r["html"]), *(label_page(r["html"], rnd) for _ in range(REBUILT))) if x]
    return fit(out)


def extract(pages: DataFrame, model: Model, *, html_col: str = "html", text_out: str = "text", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep``, the main text and ``n_chars``, its code points. One row per row of ``pages``, repeated ones too.

    A null or empty page, and one without content, gives an empty text. A page is read whole whatever its length. A kept column named
    like a new one is an error (ValueError): give ``text_out`` another name. Other columns may have any name. Lowers the session's Arrow batches.
    """
    small_batches(pages.sparkSession)
    schema = out_schema(pages, keep, {text_out: F.lit(""), "n_chars": F.lit(0).cast("long")})

    def texts(sources: list[str | None]) -> Iterator[str]:
        held: list[dom.Dom] = []
        n = 0
        for i, source in enumerate(sources):
            held.append(dom.read(source or "", _wanted))
            n += len(held[-1].tags)
            if n > 20_000 or i + 1 == len(sources):
                forest = plant(held)
                kept = model.content(forest) >= 0.5
                yield from (dom.lines(d, kept[at:]) for d, at in zip(held, forest.first, strict=False))
                held, n = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array(texts(b.column(len(keep)).to_pylist()), pa.string())
            yield pa.record_batch([*b.columns[: len(keep)], got, pc.utf8_length(got).cast(pa.int64())], names=[*keep, text_out, "n_chars"])

    source = "_html" + "_" * max(map(len, keep), default=0)
    return pages.select(*keep, F.col(html_col).alias(source)).mapInArrow(release_after(run), schema)


def oracle() -> str:
    """DuckDB SQL of what ``op13_extraction`` has to find on the test pages, whose main part is the one article."""
    decoded = "regexp_replace(replace(replace(replace(x, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')"
    return f"""
WITH blocks AS (
  SELECT page_id, url, unnest(list_transform(regexp_split_to_array(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?(p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g'))) AS x,
    generate_subscripts(regexp_split_to_array(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?(p|h1)>'), 1) AS i
  FROM pages),
clean AS (SELECT page_id, url, i, trim(regexp_replace({decoded}, '\\s+', ' ', 'g')) AS x FROM blocks),
texts AS (SELECT page_id, url, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (x <> ''), '') AS text FROM clean GROUP BY page_id, url)
SELECT page_id, url, text, length(text) AS n_chars FROM texts"""
