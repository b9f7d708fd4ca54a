"""Main-text extraction by a tree-structured graphical model over the DOM.

Every element of a page (block elements, and inline ones that carry a class, id or role) is a binary
variable: content or boilerplate.  Element potentials come from its tag, its class and id words, its
place, and the text and links in it; parent-child potentials say how likely the two states are to
meet, by the child's tag.  Sum-product message passing, upward and then downward, gives each
element's content marginal; text of elements with a marginal of one half or more is kept.

Both kinds of potential are trained together, by pseudo-likelihood (each element's state given its
neighbours' states is a logistic regression), on pages that label themselves: those with an ``article``
or ``main`` element.  There the label says only whether an element lies in it and outside ``nav``,
``aside``, ``footer`` and ``form``; class and id words take no part in it, and elements that such words
mark within the article have no label.  On two of three pages those tags are disguised as ``div``, so
what the model learns of words, links, text and place is not the labelling rule.  Weights are drawn
towards prior weights, for marks that the sample does not show.

Some evidence is not learnt.  An element that is not shown (``hidden``, ``aria-hidden``, an invisible
style) and a raw-text one is boilerplate with all within it.  An element whose class, id or role as a whole
names an advert, menu, comment list or the like is so too, unless it is or holds an ``article`` or ``main``
element.  Names of parts that an article may have too (``header``, ``search-text``) say so within an ``article`` or
``main`` only where the element holds neither a top heading nor sentences outside links.  A word within a longer
name (``has-comments``, ``social-science``) is weak evidence, and none on an element that so speaks.
The header of an article is part of it; a page's header is not.

* Null html counts as empty; a page without text gives the empty string.
* Character references are decoded, white space inside a block becomes one space, blocks are
  trimmed and joined in page order by one line feed.  Nothing is capped.
* Rows that repeat an id are extracted each for itself.  An empty table gives an empty result.
* A marginal of exactly one half (a tie) counts as content.
* Input columns beside id, url and html are ignored, also those named like an output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtable.llm.dom import RAW_TEXT, Tree, parse
from groundtable.plans.shared import short_batches

# Groups of element names, and words in class, id and role that mark an element.
GROUPS = {
    "title": "h1", "heading": "h2 h3 h4 h5 h6 hgroup", "paragraph": "p", "quote": "blockquote pre figure figcaption",
    "item": "li dt dd", "list": "ul ol dl menu", "article": "article", "main": "main", "section": "section", "division": "div center",
    "table": "table thead tbody tfoot caption", "cell": "tr td th", "nav": "nav", "header": "header", "footer": "footer",
    "aside": "aside dialog", "form": "form fieldset select option button input label", "hidden": "head script style noscript template title textarea iframe svg",
    "frame": "html body #root",
    "loose": "#text", "inline": "a abbr b bdi bdo big cite code data del em font i ins kbd mark q s samp small span strong sub sup time u var", "other": "",
}
OUTSIDE = {"nav", "aside", "footer", "form"}
DISGUISED = OUTSIDE | {"article", "main", "header", "section"}
GROUP_OF = {tag: i for i, tags in enumerate(GROUPS.values()) for tag in tags.split()}
GROUP_NAMES = list(GROUPS)
BOILERPLATE_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising advertorial banner promo promos promotion promoted sponsor sponsors sponsored "
    "nav navbar navigation navigational menu menubar submenu breadcrumb breadcrumbs footer header masthead sidebar widget widgets comment comments commentlist "
    "reply replies respond disqus cookie cookies consent notice notices alert share sharing sharethis social related recommended recommendations "
    "subscribe subscription newsletter popup modal overlay login signup signin search pagination pager toolbar copyright complementary contentinfo skip skiplink".split()
)
PLAIN_WORDS = set(  # say nothing by themselves, so a name made of these and of boilerplate words is a boilerplate name
    "site page top left right bottom center box block area container wrapper wrap list listing section slot unit zone inner outer item items bar text form link links "
    "button buttons icon icons main primary secondary global posts articles stories content body row col column columns group panel region holder thread title heading "
    "google mobile desktop sticky fixed small large big wide and the this to or of on in for us by with s".split()
)
# Within an article these name parts of it as well as boilerplate, so what the element holds decides.
EITHER_WORDS = set("header masthead search social related alert reply replies respond login skip promotion".split())
CONTENT_WORDS = set("content article post entry body story text prose".split())
_NAME = re.compile(r"[^\W_]+")
_STOP = re.compile(r"[.!?。！？]")
_SPACE = re.compile(r"\s+")
N_FEATURES = len(GROUPS) + 13
SURE = -30.0  # the potential of evidence that is not learnt


@dataclass(frozen=True)
class ExtractParams:
    """``max_pages`` bounds the training sample; ``prior`` is the pull towards the prior weights."""

    max_pages: int = 2_000
    prior: float = 0.05
    steps: int = 400


def _prior_weights() -> np.ndarray:
    w = np.zeros(N_FEATURES)
    for name, weight in (("nav", -5), ("header", -3), ("footer", -5), ("aside", -5), ("form", -5), ("hidden", -9), ("article", 3), ("main", 3), ("paragraph", 1), ("title", 2), ("loose", 1)):
        w[GROUP_NAMES.index(name)] = weight
    w[len(GROUPS)] = -2  # a boilerplate word within a longer name of its class, id or role
    w[len(GROUPS) + 1] = 1  # a content word
    w[len(GROUPS) + 9] = -5  # within navigation, forms and the like
    w[len(GROUPS) + 10] = 2  # within an article or main element
    return w


@lru_cache(maxsize=20_000)
def named(marks: str) -> tuple[bool, bool, bool]:
    """Whether a whole name is one of boilerplate, holds a word of it, holds a content word."""
    whole = part = content = False
    for name in marks.split():
        words = [w for w in _NAME.findall(name) if not w.isdigit()]
        held = [w in BOILERPLATE_WORDS for w in words]
        content |= bool(CONTENT_WORDS.intersection(words)) and not any(held)
        part |= any(held)
        whole |= any(held) and all(h or w in PLAIN_WORDS or re.fullmatch(r"\d+x\d+", w) is not None for h, w in zip(held, words))
    return whole and not content, part, content


@lru_cache(maxsize=20_000)
def either(marks: str) -> bool:
    """Whether all boilerplate words of a name may also name a part of an article."""
    return set(_NAME.findall(marks)) & BOILERPLATE_WORDS <= EITHER_WORDS


def _speaks(tree: Tree) -> np.ndarray:
    """Elements that hold a top heading, or sentences of which less than half is links."""
    size = len(tree.tags)
    stops, whole, linked = np.zeros(size), np.zeros(size), np.array(tree.linked, dtype=float)
    titled = np.array([t == "h1" for t in tree.tags])
    for element, _, run in tree.texts:
        stops[element] += len(_STOP.findall(run))
        whole[element] += len(run.strip())
    for i in range(size - 1, 0, -1):
        p = tree.parents[i]
        stops[p], whole[p], linked[p], titled[p] = stops[p] + stops[i], whole[p] + whole[i], linked[p] + linked[i], titled[p] | titled[i]
    return titled | ((stops > 0) & (linked < whole / 2))


def _heads(tree: Tree) -> list[bool]:
    """Which elements are the header of an article, so part of it."""
    within = [False] * len(tree.tags)
    out = [False] * len(tree.tags)
    for i in range(1, len(tree.tags)):
        within[i] = within[tree.parents[i]] or tree.tags[i] in ("article", "main")
        out[i] = tree.tags[i] == "header" and within[tree.parents[i]]
    return out


def _certain(tree: Tree) -> np.ndarray:
    """Elements that are boilerplate for sure: not shown, raw text, or named as boilerplate, and all within them."""
    size = len(tree.tags)
    holds = np.array([t in ("article", "main", "html", "body", "#root") for t in tree.tags])
    for i in range(size - 1, 0, -1):
        holds[tree.parents[i]] |= holds[i]
    out, within, speaks = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool), None
    for i in range(1, size):
        within[i] = within[tree.parents[i]] or tree.tags[tree.parents[i]] in ("article", "main")
        out[i] = out[tree.parents[i]] or tree.hidden[i] or tree.tags[i] in RAW_TEXT
        if out[i] or holds[i] or not tree.marks[i] or not named(tree.marks[i])[0]:
            continue
        if within[i] and either(tree.marks[i]):
            speaks = _speaks(tree) if speaks is None else speaks
            out[i] = not speaks[i]
        else:
            out[i] = True
    return out


def _features(tree: Tree) -> np.ndarray:
    """One row per element."""
    size = len(tree.tags)
    out = np.zeros((size, N_FEATURES))
    own, stops = np.zeros(size), np.zeros(size)
    for element, _, run in tree.texts:
        own[element] += len(run.strip())
        stops[element] += len(_STOP.findall(run))
    before = np.concatenate([[0], np.cumsum(own)[:-1]])
    whole, linked, paragraphs = own.copy(), np.array(tree.linked, dtype=float), np.array([t == "p" for t in tree.tags], dtype=float)
    for i in range(size - 1, 0, -1):
        p = tree.parents[i]
        whole[p] += whole[i]
        linked[p] += linked[i]
        paragraphs[p] += paragraphs[i]
    heads, speaks = _heads(tree), _speaks(tree)
    groups = [GROUP_OF["section"] if head else GROUP_OF.get(t, len(GROUPS) - 1) for t, head in zip(tree.tags, heads)]
    out[np.arange(size), groups] = 1
    at = len(GROUPS)
    for i in range(1, size):
        p, tag = tree.parents[i], tree.tags[i]
        if tree.marks[i] and tag not in ("article", "main", "html", "body"):
            whole_name, part, out[i, at + 1] = named(tree.marks[i])
            out[i, at] = part and (whole_name or not speaks[i])
        over = tree.tags[p]
        out[i, at + 9] = max(out[p, at + 9], over in OUTSIDE or (over == "header" and not heads[p]))
        out[i, at + 10] = max(out[p, at + 10], over in ("article", "main"))
    out[:, at + 2] = np.log1p(own) / 5
    out[:, at + 3] = np.log1p(whole) / 8
    out[:, at + 4] = linked / np.maximum(whole, 1)
    out[:, at + 5] = np.minimum(stops / np.maximum(own, 1) * 50, 2)
    out[:, at + 6] = np.log1p(paragraphs) / 3
    out[:, at + 7] = whole / max(whole[0], 1)
    out[:, at + 8] = 1
    out[:, at + 11] = before / max(whole[0], 1)
    out[:, at + 12] = 1 - (before + whole) / max(whole[0], 1)
    return out


def _labels(tree: Tree) -> np.ndarray | None:
    """1 for content, 0 for boilerplate, -1 for elements without a label; None for pages without article or main."""
    size = len(tree.tags)
    roots = {i for i in range(size) if tree.tags[i] == "article"} or {i for i in range(size) if tree.tags[i] == "main"}
    if not roots:
        return None
    unsure = _certain(tree)
    out = np.zeros(size)
    for i in range(1, size):
        inside = i in roots or out[tree.parents[i]] != 0
        out[i] = 0 if not inside or tree.tags[i] in OUTSIDE else -1 if unsure[i] or out[tree.parents[i]] == -1 else 1
    return out


def _neighbours(tree: Tree, truth: np.ndarray) -> np.ndarray:
    """For each element the signs of its parent's and children's states, summed by the child's group."""
    out = np.zeros((len(truth), len(GROUPS)))
    signs = np.where(truth < 0, 0, 2 * truth - 1)
    for i in range(1, len(truth)):
        group, parent = GROUP_OF.get(tree.tags[i], len(GROUPS) - 1), tree.parents[i]
        out[i, group] += signs[parent]
        out[parent, group] += signs[i]
    return out


def _disguise(tree: Tree) -> Tree:
    return replace(tree, tags=["div" if t in DISGUISED else t for t in tree.tags])


def _trainer(params: ExtractParams):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = N_FEATURES + len(GROUPS)
        prior = np.concatenate([_prior_weights(), np.full(len(GROUPS), 1.0)])
        rows, labels = [np.zeros((0, width))], [np.zeros(0)]
        number = 0
        for batch in batches:
            for page in batch.column("html").to_pylist():
                tree = parse(page)
                truth = _labels(tree)
                if truth is None:
                    continue
                number += 1
                seen = _disguise(tree) if number % 3 else tree
                known = truth >= 0
                rows.append(np.hstack([_features(seen), _neighbours(seen, truth)])[known])
                labels.append(truth[known])
        flat = prior.copy()
        if number:
            x, y = np.concatenate(rows), np.concatenate(labels)
            bound = 0.25 * np.linalg.norm(x.T @ x, 2) / len(x) + params.prior / 10
            velocity = np.zeros_like(flat)
            for _ in range(params.steps):
                p = 1 / (1 + np.exp(-np.clip(x @ flat, -35, 35)))
                gradient = x.T @ (p - y) / len(x) + params.prior / 10 * (flat - prior)
                velocity = 0.9 * velocity - gradient / bound * 0.5
                flat = flat + velocity
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["place", "value"])

    return train


def train_extractor(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", params: ExtractParams = ExtractParams()) -> np.ndarray:
    """Element weights and parent-child potentials, a vector of fixed length."""
    ids = (
        pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("id"))
        .orderBy(F.xxhash64("id"), "id").limit(params.max_pages)
    )
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).where("html IS NOT NULL")
    sample = rows.join(F.broadcast(ids.distinct()), "id")  # at most max_pages rows
    model = (
        sample.repartition(1).sortWithinPartitions(F.xxhash64("id"), "html").select("html")
        .mapInArrow(_trainer(params), "place int, value double").toArrow().sort_by("place")
    )
    return model["value"].to_numpy()


def marginals(parents: np.ndarray, depths: np.ndarray, unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Content marginals of a forest by sum-product, all elements of a depth at once.

    ``unary`` is (elements, 2) and ``pair`` (elements, parent state, own state), in logs.
    """
    size = len(parents)
    order = np.argsort(depths, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depths))[:-1]) if size else []
    up = np.zeros((size, 2))  # message to the parent
    below = unary.copy()  # own potential and all messages from children
    for level in reversed(levels[1:]):
        joined = pair[level] + below[level][:, None, :]
        up[level] = np.logaddexp(joined[:, :, 0], joined[:, :, 1])
        up[level] -= up[level].max(axis=1, keepdims=True)
        np.add.at(below, parents[level], up[level])
    down = np.zeros((size, 2))  # message from the parent
    for level in levels[1:]:
        above = (below[parents[level]] - up[level] + down[parents[level]])[:, :, None] + pair[level]
        down[level] = np.logaddexp(above[:, 0, :], above[:, 1, :])
        down[level] -= down[level].max(axis=1, keepdims=True)
    belief = below + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


def potentials(tree: Tree, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each element's log potential of content against boilerplate, and its coupling with its parent."""
    score = _features(tree) @ model[:N_FEATURES]
    groups = [GROUP_OF.get(tag, len(GROUPS) - 1) for tag in tree.tags]
    return np.where(_certain(tree), SURE, score), model[N_FEATURES:][groups]


def _extract(trees: list[Tree], model: np.ndarray) -> list[str]:
    starts = np.concatenate([[0], np.cumsum([len(t.tags) for t in trees])]).astype(int)
    found = [potentials(t, model) for t in trees]
    score, coupling = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    parents = np.concatenate([np.array(t.parents) + s for t, s in zip(trees, starts)])
    depths = np.concatenate([np.array(t.depths) for t in trees])
    unary = np.stack([np.zeros(len(score)), score], axis=1)
    pair = coupling[:, None, None] / 2 * np.array([[1, -1], [-1, 1]])
    content = marginals(parents, depths, unary, pair) >= 0.5
    out = []
    for tree, start in zip(trees, starts):
        blocks: dict[int, list[str]] = {}
        for element, block, run in tree.texts:
            if content[start + element]:
                blocks.setdefault(block, []).append(run)
        tidy = (_SPACE.sub(" ", "".join(runs)).strip() for runs in blocks.values())
        out.append("\n".join(t for t in tidy if t))
    return out


def main_text(pages: DataFrame, model: np.ndarray, html_col: str = "html") -> Column:
    """The column of main texts of an html column under a trained model."""
    short_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        out: list[str] = []
        for first in range(0, len(pages), 64):
            out += _extract([parse(p) for p in pages.slice(first, 64).to_pylist()], shared.value)
        return pa.array(out, pa.string())

    return extract(F.coalesce(F.col(html_col).cast("string"), F.lit("")))


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", params: ExtractParams = ExtractParams()
) -> DataFrame:
    """One row per page: id, url, text, n_chars (code points)."""
    model = train_extractor(pages, id_col, html_col, params)
    found = pages.select(F.col(id_col), F.col(url_col), main_text(pages, model, html_col).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
