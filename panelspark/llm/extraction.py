"""Main text of web pages by a tree-structured graphical model.

Every block of a page is a node that is content or not. A node's own potential is linear in its features; a potential
for each kind of child couples it with its parent. Sum-product messages, up the tree and then down, give every node's
exact marginal; texts of runs whose marginal is at least one half are the main text. Potentials are fitted to the exact
conditional likelihood of labelled pages, whose gradient needs those marginals alone.

Defined results: a null or empty html, or a page without shown text, has the empty text and 0 characters; rows are
independent, so repeated rows and null ids are kept as they are; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import dom
from panelspark.llm.common import modest_batches, rows_of, text_or_empty

#: Words in class, id and role attributes that say what a block is for.
HINTS = (
    "ad ads advert advertisement article aside author banner body breadcrumb breadcrumbs byline caption column comment comments consent content cookie copyright "
    "dialog disqus entry feed footer foot form gdpr head header legal links login main masthead menu meta modal nav navbar navigation newsletter notice "
    "pagination pager page popup post privacy promo promotion recommended related reply replies response search share sharing sidebar signup social sponsor "
    "sponsored story subscribe tags teaser text toolbar top topbar tracking widget wrapper"
).split()
TAGS = "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul #text #root".split()
_HINTS, _TAGS = frozenset(HINTS), frozenset(TAGS)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TRUTH = re.compile(r"""data-truth="([01])\"""")
#: Kinds of parent-child pair, each with a table of potentials of its own.
KINDS = {"#text": 0, "p": 1, "li": 2, "h1": 3, "h2": 3, "h3": 3, "h4": 3}
SECTIONS = frozenset("article aside body div footer form header main nav section table td ul ol".split())
N_KINDS = 6


def _kind(name: str) -> int:
    return KINDS.get(name, 4 if name in SECTIONS else 5)


def _hints(attrs: str) -> list[str]:
    found = []
    for m in _ATTR.finditer(attrs):
        for word in re.split(r"[^a-zA-Z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "")):
            word = word.lower()
            if word in _HINTS:
                found.append(f"hint:{word}")
            elif word.endswith("s") and word[:-1] in _HINTS:
                found.append(f"hint:{word[:-1]}")
    return found


@lru_cache(maxsize=4096)
def _own(name: str, attrs: str) -> tuple[str, ...]:
    """Features of an element that its start tag gives."""
    return (f"tag:{name if name in _TAGS else 'other'}", *dict.fromkeys(_hints(attrs)))


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def features(tree: dom.Tree) -> list[tuple[str, ...]]:
    """The active features of each node."""
    n = len(tree.names)
    chars, links, runs = [len(t) for t in tree.texts], list(tree.links), [int(bool(t)) for t in tree.texts]
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        runs[p] += runs[i]
    total = max(1, chars[0])
    out = []
    for i in range(n):
        name = tree.names[i]
        density = _bucket(links[i] / max(1, chars[i]), (0.05, 0.3, 0.7, 0.95))
        if name == "#text":
            text = tree.texts[i]
            long = _bucket(len(text), (12, 30, 80, 200, 500))
            marks = f"end:{text[-1] in '.!?:;…”»'}"
            legal = ("legal",) if "©" in text or "(c)" in text[:80].lower() else ()
            out.append(("#text", f"run:{long}", f"run-links:{density}", marks, *legal))
        else:
            share = _bucket(chars[i] / total, (0.02, 0.1, 0.3, 0.6, 0.9))
            mean = _bucket(chars[i] / max(1, runs[i]), (12, 30, 80, 200))
            out.append((*_own(name, tree.attrs[i]), f"share:{share}", f"mean:{mean}", f"links:{density}"))
    return out


class Forest:
    """Trees side by side, levels by depth, so that messages of a whole batch pass in a few array operations."""

    def __init__(self, trees: list[dom.Tree]) -> None:
        parents, depths, kinds = [], [], []
        self.starts = []
        for tree in trees:
            base = len(parents)
            self.starts.append(base)
            depth: list[int] = []
            for i, p in enumerate(tree.parents):
                depth.append(0 if p < 0 else depth[p] + 1)
                parents.append(p + base if p >= 0 else -1)
                kinds.append(_kind(tree.names[i]))
            depths += depth
        self.parents, self.kinds = np.asarray(parents, dtype=np.int64), np.asarray(kinds, dtype=np.int64)
        order = np.argsort(np.asarray(depths, dtype=np.int64), kind="stable")
        sizes = np.bincount(np.asarray(depths, dtype=np.int64))
        self.levels = np.split(order, np.cumsum(sizes)[:-1])


def sum_product(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each node, of each (parent, child) pair by child, and the log of the partition function.

    unary[i, s] is node i's potential in state s; pair[k, r, s] that of a child of kind k in state s below a parent in r.
    """
    belief = unary.copy()
    message = np.zeros_like(unary)
    for level in forest.levels[:0:-1]:
        inner = belief[level][:, None, :] + pair[forest.kinds[level]]
        message[level] = np.logaddexp(inner[:, :, 0], inner[:, :, 1])
        np.add.at(belief, forest.parents[level], message[level])
    roots = forest.levels[0]
    log_z = float(np.logaddexp(belief[roots, 0], belief[roots, 1]).sum())
    full = belief.copy()
    both = np.zeros((len(unary), 2, 2))
    for level in forest.levels[1:]:
        cavity = full[forest.parents[level]] - message[level]
        joint = cavity[:, :, None] + pair[forest.kinds[level]] + belief[level][:, None, :]
        both[level] = joint
        full[level] = np.logaddexp(joint[:, 0, :], joint[:, 1, :])
    node = np.exp(full - np.logaddexp(full[:, :1], full[:, 1:]))
    top = both.max(axis=(1, 2), keepdims=True)
    both = np.exp(both - top)
    return node, both / both.sum(axis=(1, 2), keepdims=True), log_z


class Model:
    """Weights by feature and potentials by kind of child."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, pair: np.ndarray) -> None:
        self.names, self.weights, self.pair = names, weights, pair

    def unary(self, active: list[tuple[str, ...]]) -> np.ndarray:
        get, w = self.names.get, self.weights.tolist()
        w.append(0.0)
        return np.asarray([(0.0, sum(w[get(f, -1)] for f in fs)) for fs in active])

    def marginals(self, trees: list[dom.Tree]) -> list[np.ndarray]:
        """For each tree, each node's probability of being content."""
        forest = Forest(trees)
        node, _, _ = sum_product(forest, self.unary([fs for t in trees for fs in features(t)]), self.pair)
        return np.split(node[:, 1], forest.starts[1:])


def fit(pages: list[tuple[dom.Tree, list[int]]], rounds: int = 200, rate: float = 0.1, decay: float = 2e-3) -> Model:
    """Adam on the exact conditional log-likelihood of labelled trees."""
    trees = [t for t, _ in pages]
    truth = np.asarray([y for _, ys in pages for y in ys], dtype=np.int64)
    active = [fs for t in trees for fs in features(t)]
    names = {f: k for k, f in enumerate(sorted({f for fs in active for f in fs}))}
    owner = np.repeat(np.arange(len(active)), [len(fs) for fs in active])
    column = np.asarray([names[f] for fs in active for f in fs], dtype=np.int64)
    forest = Forest(trees)
    child = np.flatnonzero(forest.parents >= 0)
    seen = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen, (forest.kinds[child], truth[forest.parents[child]], truth[child]), 1.0)
    theta = np.zeros(len(names) + N_KINDS * 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        weights, pair = theta[: len(names)], theta[len(names) :].reshape(N_KINDS, 2, 2)
        unary = np.zeros((len(active), 2))
        unary[:, 1] = np.bincount(owner, weights[column], minlength=len(active))
        node, both, _ = sum_product(forest, unary, pair)
        off = (truth - node[:, 1])[owner]
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.kinds[child], both[child])
        gradient = np.concatenate([np.bincount(column, off, minlength=len(names)), (seen - expected).ravel()]) / len(trees)
        gradient -= decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(names, theta[: len(names)].copy(), theta[len(names) :].reshape(N_KINDS, 2, 2).copy())


def labels(tree: dom.Tree) -> list[int]:
    """A run is content if the nearest data-truth above it says so; an element, if most of its characters are."""
    n = len(tree.names)
    truth = [0] * n
    for i in range(1, n):
        m = _TRUTH.search(tree.attrs[i])
        truth[i] = int(m[1]) if m else truth[tree.parents[i]]
    good, every = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if tree.names[i] == "#text":
            good[i], every[i] = len(tree.texts[i]) * truth[i], len(tree.texts[i])
        if i:
            good[tree.parents[i]] += good[i]
            every[tree.parents[i]] += every[i]
    return [int(2 * g > e) if e else truth[i] for i, (g, e) in enumerate(zip(good, every, strict=True))]


class _Writer:
    """Writes labelled pages: data-truth marks what is main text. Layouts, names and prose vary by seed."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        r = self.r
        self.parts = ["".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouéüñ") for _ in range(r.randint(1, 2))) for _ in range(60)]

    def words(self, n: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(self.parts) for _ in range(r.randint(1, 3))) for _ in range(n))

    def prose(self, most: int = 60) -> str:
        r, out = self.r, []
        for _ in range(r.choice((1, 1, 2, 3, 6))):
            out.append(self.words(r.choice((1, 2, 5, 9, 20, most))).capitalize() + r.choice(".....!?,") + r.choice(("", "", "", "%%%", "***", " |")))
        text = " ".join(out)
        if r.random() < 0.2:
            text = text.replace(" ", r.choice((" <b>", " <i>", ' <a href="/x">')), 1) + r.choice(("</b>", "</i>", "</a>", ""))
        return text

    def items(self, n: int, link: bool) -> str:
        one = (lambda: f'<li><a href="/{self.words(1)}">{self.words(self.r.randint(1, 3))}</a></li>') if link else (lambda: f"<li>{self.prose(12)}</li>")
        return f"<ul>{''.join(one() for _ in range(n))}</ul>"

    def name(self, *hints: str) -> str:
        r = self.r
        if r.random() < 0.25:
            return ""
        return f' {r.choice(("class", "class", "id"))}="{r.choice(hints)}{r.choice(("", "", "-" + self.words(1), " x" + str(r.randint(1, 99))))}"'

    def boilerplate(self) -> str:
        r = self.r
        kind = r.choice("nav nav menu ad ad aside related cookie form search comments share crumbs newsletter login header tags".split())
        p = lambda n: "".join(f"<p>{self.prose(30)}</p>" for _ in range(n))
        return {
            "nav": lambda: f"<nav{self.name('nav', 'navbar', 'menu')}>{self.items(r.randint(2, 9), True)}</nav>",
            "menu": lambda: f'<div class="{r.choice(("menu", "nav", "navigation", "links"))}">{self.items(r.randint(2, 9), True)}</div>',
            "ad": lambda: f'<div class="{r.choice(("ad", "ads", "advert", "banner", "sponsored", "promo"))}">{self.prose(12) if r.random() < 0.6 else p(1)}</div>',
            "aside": lambda: f"<aside{self.name('sidebar', 'widget', 'aside')}><h3>{self.words(2)}</h3>{self.items(r.randint(1, 5), r.random() < 0.6) if r.random() < 0.6 else p(2)}</aside>",
            "related": lambda: f'<div class="{r.choice(("related", "recommended", "teaser", "sidebar"))}"><h3>{self.words(2)}</h3>{self.items(r.randint(2, 5), True)}</div>',
            "cookie": lambda: f'<div {r.choice(("class", "id"))}="{r.choice(("cookie", "consent", "notice", "gdpr", "popup", "modal"))}"><p>{self.prose(15)}</p><button>{self.words(1)}</button></div>',
            "form": lambda: f"<form{self.name('form', 'signup', 'subscribe')}><p>{self.prose(9)}</p><label>{self.words(2)}</label><input name=q><button>{self.words(1)}</button></form>",
            "search": lambda: f'<form class="search"><label>{self.words(1)}</label><input name=q></form>',
            "comments": lambda: f'<{(t := r.choice(("section", "div")))} {r.choice(("class", "id"))}="{r.choice(("comments", "comment-list", "replies", "responses", "disqus"))}"><h2>{self.words(2)}</h2>'
            + "".join(f'<div class="{r.choice(("comment", "reply"))}"><b>{self.words(1)}</b> {p(r.randint(1, 2))}</div>' for _ in range(r.randint(1, 5))) + f"</{t}>",
            "share": lambda: f'<div class="{r.choice(("share", "social", "toolbar"))}"><a href=x>{self.words(1)}</a> <a href=y>{self.words(1)}</a></div>',
            "crumbs": lambda: f'<div class="{r.choice(("breadcrumb", "breadcrumbs", "pagination"))}"><a href=/>{self.words(1)}</a> &gt; <a href=/b>{self.words(1)}</a></div>',
            "newsletter": lambda: f'<div class="newsletter"><h4>{self.words(3)}</h4><p>{self.prose(12)}</p></div>',
            "login": lambda: f'<div class="login">{self.words(2)} <a href=/l>{self.words(1)}</a></div>',
            "header": lambda: f"<header{self.name('header', 'masthead', 'top')}><a href=/>{self.words(2)}</a><p>{self.prose(6)}</p></header>",
            "tags": lambda: f'<div class="tags">{self.items(3, True)}</div>',
        }[kind]()

    def article(self) -> str:
        r = self.r
        blocks = [f"<h1>{self.words(r.randint(2, 8))}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            blocks.append(
                r.choice(
                    [lambda: f"<p>{self.prose()}</p>"] * 9
                    + [lambda: f"<p><b>{self.prose()}<br><p>{self.prose()}</p>", lambda: f"<h2>{self.words(3)}</h2><p>{self.prose()}</p>", lambda: self.items(r.randint(1, 4), False)]
                    + [lambda: f"<blockquote><p>{self.prose()}</p></blockquote>", lambda: f"<pre>{self.words(8)}\n{self.words(5)}</pre>", lambda: f"<div>{self.prose()}</div>", lambda: f"{self.prose()}<br><br>"]
                    + [lambda: f"<table><tr><td>{self.words(2)}</td><td>{self.words(1)}</td></tr></table>", lambda: f"<figure><img src=x><figcaption>{self.prose(9)}</figcaption></figure>"]
                )()
            )
        for _ in range(r.choice((0, 0, 0, 1, 2))):  # strangers inside the article
            blocks.insert(r.randint(0, len(blocks)), f'<div data-truth="0">{self.boilerplate()}</div>' if r.random() < 0.3 else self.boilerplate().replace(">", ' data-truth="0">', 1))
        inside = "".join(blocks)
        tag, name = r.choice((("article", ""), ("article", self.name("post", "story", "entry")), ("main", ""), ("div", ' class="content"'), ("div", ' class="post-body"'), ("div", ' id="main-text"'), ("div", f' class="{self.words(1)}"'), ("section", ' class="article-body"'), ("td", ""), ("div", "")))
        return f'<table><tr><td data-truth="1">{inside}</td></tr></table>' if tag == "td" else f'<{tag}{name} data-truth="1">{inside}</{tag}>'

    def page(self) -> str:
        r = self.r
        before = [self.boilerplate() for _ in range(r.randint(0, 4))]
        after = [self.boilerplate() for _ in range(r.randint(0, 4))]
        foot = r.choice(("footer", "footer", "div class=footer"))
        end = f"<{foot}>&copy; {self.words(2)} &middot; {self.prose(8)}{self.items(2, True) if r.random() < 0.4 else ''}</{foot.split()[0]}>" if r.random() < 0.8 else ""
        middle = "".join(before) + self.article() + "".join(after) + end
        if r.random() < 0.3:
            middle = f'<div class="{r.choice(("wrapper", "page", "container", "site"))}">{middle}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{}}</style></head><body>{middle}{r.choice(('</body></html>', ''))}"


def labelled_pages(n: int, seed: int) -> list[str]:
    """Pages of many layouts whose data-truth attributes mark the main text; the model never sees that attribute."""
    return [_Writer(seed * 1_000_003 + k).page() for k in range(n)]


@lru_cache(maxsize=2)
def trained(n_pages: int = 700, seed: int = 11) -> Model:
    trees = [dom.parse(p) for p in labelled_pages(n_pages, seed)]
    return fit([(t, labels(t)) for t in trees])


def main_texts(model: Model, pages: list[str]) -> list[str]:
    """The main text of each page: its content runs in page order, joined by one space."""
    trees = [dom.parse(p) for p in pages]
    return [" ".join(t for t, m in zip(tree.texts, marginal.tolist(), strict=True) if t and m >= 0.5) for tree, marginal in zip(trees, model.marginals(trees), strict=True)]


def extract(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 128):
            texts = main_texts(model, batch.column("html").to_pylist())
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    modest_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
