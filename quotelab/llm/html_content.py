"""The main text of pages: a tree-structured graphical model tells the article's runs of text from menus, notices and the like.

Every node of a page's tree (``html_dom``) is content or not. Its features (tag, words of class, id and role, sizes, share of
links) pull it to one side, and a potential for each kind of child binds it to its parent. Both are learned from labelled
pages by maximum likelihood with exact gradients: sum-product messages run up the tree and down again and give the marginals of
nodes and edges; the same messages give the marginals of a new page, and runs of text with one of at least a half are its main
text, joined in page order. Pages are handled in groups of ``SLICE`` characters, one level of all their trees at a time.

Null and empty pages, and pages without content, have the empty text. A page is taken whole and alone: repeated rows, ids and
other columns play no part. A labelled page whose text is not made of runs of the page is matched as far as it goes.
"""
from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelab.llm.html_dom import HEADINGS, Page

#: Labelled pages that a fit takes at most; features are hashed to so many weights.
LABELLED, WIDTH = 5000, 1 << 14
#: Characters of pages that a worker handles together.
SLICE = 1 << 20

#: Kinds of children that a potential binds to their parents.
KINDS = {"#text": 0, "p": 1, "blockquote": 1, "pre": 1, "li": 2, "ul": 3, "ol": 3, "dl": 3, "div": 4, "section": 5, "article": 6, "main": 6, "table": 7,
         "tbody": 7, "thead": 7, "tr": 7, "td": 7, "th": 7, "nav": 8, "header": 9, "footer": 10, "aside": 11, "form": 12, "figure": 13, "body": 14,
         **dict.fromkeys(HEADINGS, 15)}
KIND_COUNT = 17

_NAMING = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label|data-[\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*.?true", re.I)


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % WIDTH


@lru_cache(maxsize=1 << 15)
def _named(tag: str, attributes: str) -> tuple[int, ...]:
    """Features that a tag with its attributes has anywhere."""
    found = {f"tag {tag}"}
    for m in _NAMING.finditer(attributes):
        for w in _WORD.findall(m[2] or m[3] or m[4] or ""):
            w = w.lower()
            found |= {f"word {w}", f"stem {w[:5]}"}
    if len(found) == 1:
        found.add(f"plain {tag}")
    if _HIDDEN.search(attributes):
        found.add("hidden")
    return tuple(sorted(map(_slot, found)))


@lru_cache(maxsize=1 << 12)
def _sized(what: str, size: int, of: int = 0) -> int:
    return _slot(f"{what} {size} {of}")


def _density(linked: int, chars: int) -> int:
    return 0 if not linked else 1 + min(3, 4 * linked // max(chars, 1))


class Forest:
    """The trees of pages side by side: parents, levels, kinds and features of all nodes."""

    def __init__(self, pages: list[str | None]):
        self.texts: list[str] = []
        parent, kind, slots, counts, self.page, self.run = [], [], [], [], [], []
        for number, html in enumerate(pages):
            page, first = Page(html or ""), len(parent)
            n = len(page.tag)
            chars, linked, runs = [len(t) for t in page.text], list(page.linked), [int(t == "#text") for t in page.tag]
            for k in range(n - 1, 0, -1):  # children come after their parents
                p = page.parent[k]
                chars[p] += chars[k]
                linked[p] += linked[k]
                runs[p] += runs[k]
            for k in range(n):
                tag, own = page.tag[k], chars[k]
                density = _density(linked[k], own)
                if tag == "#text":
                    text, above = page.text[k], page.tag[page.parent[k]]
                    features = (_sized("run of " + above, min(own.bit_length(), 9)), _sized("run links", density), _sized("run in " + above, density),
                                _sized("end", int(text[-1] in ".!?\"”»")), _sized("signs", min(3, text.count(".") + text.count(","))), _sized("mark", int("©" in text)))
                    self.run.append(first + k)
                    self.texts.append(text)
                    self.page.append(number)
                else:
                    share = 4 * own // max(chars[0], 1)
                    features = (*_named(tag, page.attributes[k]), _sized("size", min(own.bit_length(), 12)), _sized("links", density), _sized("share", share),
                                _sized("runs", min(runs[k].bit_length(), 6)), _sized("links of " + tag, density, min(own.bit_length() // 3, 3)))
                slots += features
                counts.append(len(features))
                kind.append(KINDS.get(tag, KIND_COUNT - 1))
            parent += [first + p if p >= 0 else -1 for p in page.parent]
        # level by level, children of one parent side by side; ``self.at`` is the place of a node in page order
        above = np.array(parent, np.int64)
        depth = np.zeros(len(above), np.int64)
        for k, p in enumerate(parent):
            depth[k] = depth[p] + 1 if p >= 0 else 0
        order = np.argsort(depth, kind="stable")
        at = np.empty_like(order)
        at[order] = np.arange(len(order))
        counts, ends = np.array(counts, np.int64), np.cumsum(counts, dtype=np.int64)
        self.counts = counts[order]
        self.slots = np.array(slots, np.int64)[np.repeat(ends[order] - np.cumsum(self.counts), self.counts) + np.arange(len(slots))]
        self.parent = np.where(above[order] >= 0, at[above[order]], -1)
        kinds = np.array(kind, np.int64)[order]
        self.edge = np.where(self.parent >= 0, kinds[self.parent] * KIND_COUNT + kinds, 0)
        self.run = at[np.array(self.run, np.int64)]
        cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=-1) + 2))
        self.levels = []  # (first, last + 1, where a new parent begins, these parents), from the second level on
        for low, high in zip(cuts[1:-1], cuts[2:], strict=True):
            starts = np.flatnonzero(np.diff(self.parent[low:high], prepend=-1))
            self.levels.append((low, high, starts, self.parent[low:high][starts]))

    def unary(self, weights: np.ndarray) -> np.ndarray:
        """Log potentials of (not content, content)."""
        total = np.concatenate([[0.0], np.cumsum(weights[self.slots])])
        ends = np.cumsum(self.counts)
        return np.stack([np.zeros(len(ends)), total[ends] - total[ends - self.counts]], axis=1)

    def add_up(self, x: np.ndarray) -> np.ndarray:
        """``x`` of every node with that of all nodes below it."""
        x = x.copy()
        for low, high, starts, parents in reversed(self.levels):
            x[parents] += np.add.reduceat(x[low:high], starts)
        return x


def sum_product(forest: Forest, unary: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of every node (n, 2), of every edge to its parent (n, 2, 2; zero at roots), and the log partition of every node's tree.

    ``edges[node, of parent, of child]`` are the log potentials.
    """
    below, up = unary.copy(), np.zeros_like(unary)
    for low, high, starts, parents in reversed(forest.levels):
        up[low:high] = np.logaddexp(*np.moveaxis(edges[low:high] + below[low:high, None, :], 2, 0))
        below[parents] += np.add.reduceat(up[low:high], starts)
    belief, pair = below.copy(), np.zeros((len(unary), 2, 2))
    for low, high, _, _ in forest.levels:
        joint = (belief[forest.parent[low:high]] - up[low:high])[:, :, None] + edges[low:high]
        belief[low:high] += np.logaddexp(joint[:, 0], joint[:, 1])
        joint += below[low:high, None, :]
        pair[low:high] = np.exp(joint - np.logaddexp(*belief[low:high].T)[:, None, None])
    whole = np.logaddexp(*belief.T)
    return np.exp(belief - whole[:, None]), pair, whole


class Model:
    """Weights of features, and potentials of edges by the kinds of parent and child."""

    def __init__(self, weights: np.ndarray, edges: np.ndarray):
        self.weights, self.edges = weights, edges

    def marginals(self, forest: Forest) -> np.ndarray:
        """P(content) of every node."""
        return sum_product(forest, forest.unary(self.weights), self.edges[forest.edge])[0][:, 1]

    def extract(self, pages: list[str | None]) -> list[str]:
        forest = Forest(pages)
        found: list[list[str]] = [[] for _ in pages]
        if len(forest.run):
            for text, page, p in zip(forest.texts, forest.page, self.marginals(forest)[forest.run], strict=True):
                if p >= 0.5:
                    found[page].append(text)
        return [" ".join(f) for f in found]


def run_labels(texts: list[str], main: str) -> list[bool]:
    """Which runs of text, in order, make up ``main``; as many as follow one another in it if they do not make it up exactly."""
    whole = " ".join(main.split()) + " "
    reached, took = {0}, []
    for t in texts:
        ends = {p: p + len(t) + 1 for p in reached if whole.startswith(t + " ", p)}
        took.append({e: p for p, e in ends.items()})
        reached |= set(ends.values())
    at, labels = max(reached), [False] * len(texts)
    for k in range(len(texts) - 1, -1, -1):
        if at in took[k]:
            at, labels[k] = took[k][at], True
    return labels


def _labels(forest: Forest, mains: list[str]) -> np.ndarray:
    """Labels of all nodes: runs by the text, elements by whether most characters below them are content."""
    good, chars = np.zeros(len(forest.parent)), np.zeros(len(forest.parent))
    by_page: dict[int, list[int]] = {}
    for k, page in enumerate(forest.page):
        by_page.setdefault(page, []).append(k)
    for page, runs in by_page.items():
        for k, label in zip(runs, run_labels([forest.texts[k] for k in runs], mains[page]), strict=True):
            chars[forest.run[k]] = len(forest.texts[k])
            good[forest.run[k]] = label * len(forest.texts[k])
    return (2 * forest.add_up(good) > forest.add_up(chars)).astype(np.int64)


def fit(pages: list[str], mains: list[str], rounds: int = 150, ridge: float = 0.02, step: float = 0.1) -> Model:
    """Maximum likelihood with a ridge, by Adam on the exact gradient."""
    forest = Forest(pages)
    y = _labels(forest, mains)
    child = np.flatnonzero(forest.parent >= 0)

    def by_kind(pairs: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(forest.edge[child], pairs[child, a, b], KIND_COUNT**2) for a in (0, 1) for b in (0, 1)], axis=1).reshape(-1, 2, 2)

    seen = np.zeros((len(y), 2, 2))
    seen[child, y[forest.parent[child]], y[child]] = 1
    seen = by_kind(seen)
    theta = [np.zeros(WIDTH), np.zeros((KIND_COUNT**2, 2, 2)), np.zeros((KIND_COUNT, 2, 2))]  # the last for a child's kind whatever its parent
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    both = lambda: theta[1] + np.tile(theta[2], (KIND_COUNT, 1, 1))
    for t in range(1, rounds + 1):
        nodes, pairs, _ = sum_product(forest, forest.unary(theta[0]), both()[forest.edge])
        slope = np.bincount(forest.slots, np.repeat(nodes[:, 1] - y, forest.counts), WIDTH)
        bend = by_kind(pairs) - seen
        for k, g in enumerate((slope, bend, bend.reshape(KIND_COUNT, KIND_COUNT, 2, 2).sum(axis=0))):
            g = g + ridge * theta[k]
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            theta[k] = theta[k] - step * (1 - (t - 1) / rounds) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return Model(theta[0], both())


def train(labelled: DataFrame, html_col: str = "html", main_col: str = "main") -> Model:
    """Fit on at most ``LABELLED`` pages, drawn by hash, of a table of pages with their main texts."""
    rows = labelled.select(labelled[html_col].cast("string").alias("html"), labelled[main_col].cast("string").alias("main")).filter("html IS NOT NULL AND main IS NOT NULL")
    got = rows.orderBy(F.xxhash64("html"), "html").limit(LABELLED).toArrow()
    return fit(got["html"].to_pylist(), got["main"].to_pylist())


def main_texts(pages: DataFrame, model: Model, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``id_cols`` and text, the main text of every page."""
    held = pages.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers

    def run(batches):
        for b in batches:
            first, some, size = 0, [], 0
            for k, html in enumerate(b.column("html")):
                some.append(html.as_py())
                size += len(some[-1] or "")
                if size >= SLICE or k + 1 == len(b):
                    yield pa.RecordBatch.from_arrays([b.column("key").slice(first, len(some)), pa.array(held.value.extract(some), pa.string())], names=["key", "text"])
                    first, some, size = k + 1, [], 0

    rows = pages.select(F.struct(*[pages[c].alias(c) for c in id_cols]).alias("key"), pages[html_col].cast("string").alias("html"))
    found = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string")
    return found.select("key.*", "text")
