"""HTML main text by a tree-structured graphical model (operator 8).

Each page becomes a tree: its block elements, and as leaves the *blocks*, the
runs of text between block boundaries. Every node is content or not. Elements
that say what they are (landmark tags, roles, telling class or id words) are
observed, and so is all within menus, adverts, comments and the like; all other
nodes are hidden. Class and id words speak of more than the element itself
(``has-sidebar``, ``comments-open``): those that name other parts are features only at
html, body, main and article elements and at all that hold a main or article, save
inside an article, where HTML has an article within stand for a comment. Node potentials weigh tag, class words, text
length, links and punctuation; parent-child potentials say how often a child of
some tag is content under a parent that is or is not. Sum-product messages go up
and down the tree once, which gives exact marginals. Blocks of marginal 0.5 or
more, in page order, are the text.

Training. Pages with an observed main part are the labelled ones: each node
there takes the label of its nearest observed ancestor. Tasks count features
and parent-child pairs per label, Spark sums the counts over all labelled pages;
the model has at most ``FEATURES`` features, whatever the input.

Pages are independent rows: nothing is shuffled but counts, so no key is hot.

Defined results. Null or empty html, and pages without content, give "" and 0
characters. White space inside a block (``br`` too) is one space; blocks are
joined by a blank line. Broken markup is read as far as it goes: open elements
end with the page, stray end tags are passed over. Repeated rows give repeated
results; a null ``id_col`` is kept; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.workers import received, sent

FEATURES = 20_000
# What HTML says of its elements, and words that name parts of a page.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section
    summary table tbody td tfoot th thead tr ul""".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("head svg math object select button datalist audio video canvas map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_BEFORE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
               "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "tbody": {"table"}, "tfoot": {"table"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog".split())
GOOD_TAGS = frozenset("article main".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BAD_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment
    comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice
    notices notification overlay pagination popup promo promoted promotion recommended related reply replies respond
    share sharing sidebar sidenav skip social sponsor sponsored subscribe subscription topbar widget""".split())
GOOD_WORDS = frozenset("article articlebody maincontent".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:>|\Z)|[^>]*+(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|itemprop|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""",
                       re.I)
WORD = re.compile(r"[a-z]+")
BAD, GOOD, HIDDEN = 0, 1, None


class Page:
    """The tree in page order: parents come before their children."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#root"]
        self.seen: list[int | None] = [HIDDEN]       # observed labels
        self.features: list[list[str]] = [[]]
        self.text: list[str | None] = [None]         # of blocks
        self._says: list[tuple] = [(HIDDEN, False, False)]      # own label, telling words against it, main or article
        self._parse(source)
        self._observe()

    def _add(self, tag: str, parent: int, features, text=None, says=(HIDDEN, False, False)) -> int:
        self.parent.append(parent)
        self.tag.append("heading" if tag in HEADINGS else tag)
        self.seen.append(HIDDEN)
        self._says.append(says)
        self.features.append(features)
        self.text.append(text)
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        open_: list[tuple[str, int]] = [("#root", 0)]     # block elements
        run: list[str] = []
        linked, in_link, dropped, at = 0, False, [], 0

        def flush():
            nonlocal linked
            if run:
                text = " ".join(entities.unescape("".join(run)).split())
                if text:
                    self._block(open_[-1][1], text, linked)
                run.clear()
            linked = 0

        def close(tags, limit=()):
            """End open elements down to one of ``tags``, but none of ``limit``."""
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] in tags:
                    del open_[i:]
                    return
                if open_[i][0] in limit:
                    return

        while True:
            m = TOKEN.search(source, at)
            if not dropped and (piece := source[at:m.start() if m else len(source)]):
                run.append(piece)
                linked += len(piece) * in_link
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag, end = m[2].lower(), m[1]
            if dropped:
                if end and tag in dropped:
                    del dropped[dropped.index(tag):]
                elif not end and tag in DROPPED:
                    dropped.append(tag)
                elif tag == "body" and dropped == ["head"]:
                    dropped.clear()
                if dropped:
                    if not end and tag in RAW:
                        at = self._skip(source, tag, at)
                    continue
                if end or tag != "body":
                    continue
            if not end and tag in RAW:
                at = self._skip(source, tag, at)
            elif not end and tag in DROPPED:
                flush()
                dropped.append(tag)
            elif tag == "br":
                run.append(" ")
            elif tag == "a":
                in_link = not end
            elif tag in BLOCKS:
                flush()
                in_link = False
                if end:
                    close({tag})
                    continue
                if tag != "hr" and open_[-1][0] == "p":
                    open_.pop()
                if tag in ENDS_BEFORE:
                    close(ENDS_BEFORE[tag], HOLDS.get(tag, ()))
                if tag not in VOID:
                    open_.append((tag, self._element(tag, open_, m[3])))
        flush()

    @staticmethod
    def _skip(source: str, tag: str, at: int) -> int:
        end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
        return end.end() if end else len(source)

    def _element(self, tag: str, open_: list, attributes: str) -> int:
        parent = open_[-1][1]
        words, role, hidden = [], "", False
        if len(attributes) > 3:
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), (a or b or c).lower()
                if name == "hidden" or name == "aria-hidden" and value == "true":
                    hidden = True
                elif name == "style":
                    hidden |= "display:none" in value.replace(" ", "")
                elif name == "role":
                    role = value
                else:
                    words += WORD.findall(value)
        label = HIDDEN
        if hidden or tag in BAD_TAGS or role in BAD_ROLES:
            label = BAD
        elif tag in GOOD_TAGS or role == "main" or not GOOD_WORDS.isdisjoint(words):
            label = GOOD
        return self._add(tag, parent, [f"tag {'heading' if tag in HEADINGS else tag}", *(f"word {w}" for w in sorted(set(words)))],
                         says=(label, not BAD_WORDS.isdisjoint(words), tag in GOOD_TAGS or role == "main"))

    def _observe(self) -> None:
        """Observed labels, once it is known what each element holds."""
        holds = [main and label != BAD for label, _, main in self._says]
        for i in range(len(holds) - 1, 0, -1):
            if holds[i] and self._says[self.parent[i]][0] != BAD:
                holds[self.parent[i]] = True
        inside, article = [False] * len(holds), [False] * len(holds)     # something good; an article
        for i in range(1, len(holds)):
            up, tag, (label, against, _) = self.parent[i], self.tag[i], self._says[i]
            inside[i] = inside[up] or self.seen[up] == GOOD
            article[i] = article[up] or self.tag[up] == "article"
            spared = tag in ("html", "body", "main") or holds[i] and not article[i]
            if self.seen[up] == BAD or label == BAD or against and not spared or tag == "header" and not inside[i]:
                self.seen[i] = BAD
            else:
                self.seen[i] = label

    def _block(self, parent: int, text: str, linked: int) -> None:
        n = len(text)
        size = next(k for k, most in enumerate((15, 40, 120, 400, math.inf)) if n <= most)
        self._add("#text", parent, [f"size {size}", f"links {min(3, 4 * min(linked, n) // (n + 1))}",
                                            f"stop {text[-1] in '.!?:;…。'}", f"in {self.tag[parent]}"], text)

    def labels(self) -> list[int] | None:
        """Of a page with an observed main part, each node's label."""
        if GOOD not in self.seen:
            return None
        out = []
        for p, s in zip(self.parent, self.seen):
            out.append(s if s is not HIDDEN else out[p] if out else BAD)
        return out


def counted(page: Page, counts: Counter) -> None:
    labels = page.labels()
    if labels is None:
        return
    for i, label in enumerate(labels):
        if i:
            counts["pair", page.tag[i], labels[page.parent[i]], label] += 1
        for f in page.features[i]:
            counts["node", f, 0, label] += 1


def _leaning(counts: list, towards: list, smooth: float) -> list:
    """Shares by row, with some weight on those of ``towards``."""
    return [[(n + (5 + smooth * sum(row)) * t) / (sum(row) + 5 + smooth * sum(row)) for n, t in zip(row, lean)]
            for row, lean in zip(counts, towards)]


def _logs(rows: list) -> list:
    return [[math.log(x) for x in row] for row in rows]


class Model:
    """Log potentials from counts, smoothed so that no habit of the training
    pages is beyond doubt; only observed nodes are."""
    SMOOTH, MOST, SURE = 0.02, 2.0, 1e3
    MOST_BY_TAG = 1.0       # a list may well be content, though all lists of the training pages are menus

    def __init__(self, counts: dict[tuple, int]):
        total = [1, 1]
        for (kind, _, _, label), n in counts.items():
            if kind == "node":
                total[label] += n
        self.weight = {}
        for f in {k[1] for k in counts if k[0] == "node"}:
            share = [counts.get(("node", f, 0, x), 0) / total[x] for x in (0, 1)]
            dust = self.SMOOTH * sum(share) + 1e-9
            w = math.log((share[1] + dust) / (share[0] + dust))
            most = self.MOST if f.split()[0] in ("size", "links", "stop") else self.MOST_BY_TAG
            self.weight[f] = max(-most, min(most, w))
        pairs: dict[str, list] = {}
        for (kind, tag, y, x), n in counts.items():
            if kind == "pair":
                for t in (tag, "*"):
                    pairs.setdefault(t, [[0, 0], [0, 0]])[y][x] += n
        # Each tag's pairs lean on those of all tags, and these on staying as the parent is.
        any_ = _leaning(pairs.get("*", [[0, 0], [0, 0]]), [[0.95, 0.05], [0.05, 0.95]], self.SMOOTH)
        self.pair = {t: _logs(_leaning(c, any_, self.SMOOTH)) for t, c in pairs.items()} | {"*": _logs(any_)}

    def potentials(self, page: Page) -> tuple[list, list]:
        """Log potential of content against not, per node; pair potentials per node."""
        weight, any_ = self.weight, self.pair["*"]
        node = [(self.SURE if s else -self.SURE) if s is not HIDDEN else sum(weight.get(f, 0.0) for f in fs)
                for s, fs in zip(page.seen, page.features)]
        return node, [self.pair.get(t, any_) for t in page.tag]

    def marginals(self, page: Page) -> list[float]:
        """Log odds that each node is content, by sum-product."""
        node, pair = self.potentials(page)
        return sum_product(page.parent, node, pair)


def _sum(a: float, b: float) -> float:
    return (a if a > b else b) + math.log1p(math.exp(-abs(a - b)))


def sum_product(parent: list[int], node: list[float], pair: list) -> list[float]:
    """Exact log odds of every node of a tree; all messages are log odds."""
    belief = list(node)                 # own potential and messages from children
    up = [0.0] * len(node)
    for i in range(len(node) - 1, 0, -1):
        (a, b), (c, d) = pair[i]
        up[i] = _sum(c, d + belief[i]) - _sum(a, b + belief[i])
        belief[parent[i]] += up[i]
    for i in range(1, len(node)):
        rest = belief[parent[i]] - up[i]            # all that the parent knows from elsewhere
        (a, b), (c, d) = pair[i]
        belief[i] += _sum(b, d + rest) - _sum(a, c + rest)
    return belief


def extract(model: Model, source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    odds = model.marginals(page)
    return "\n\n".join(t for t, o in zip(page.text, odds) if t is not None and o >= 0)


def fit(pages: DataFrame, html_col: str = "html") -> Model:
    """A model from all pages that have an observed main part."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: Counter = Counter()
            for source in b["html"]:
                counted(Page(source), counts)
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "name", "above", "label", "n"])

    rows = pages.select(F.col(html_col).alias("html")).filter("html is not null")
    total = (rows.mapInPandas(count, "kind string, name string, above int, label int, n long")
             .groupBy("kind", "name", "above", "label").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "kind", "name", "above", "label").limit(FEATURES))
    return Model({(r.kind, r.name, r.above, r.label): r.n for r in total.collect()})


def main_text(pages: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html",
              keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep``, text and n_chars of every page."""
    shared = sent(pages.sparkSession.sparkContext, model)

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = received(shared)
        for sources in batches:
            yield pd.Series([extract(m, s) for s in sources], dtype=object)

    got = pages.select(id_col, *keep, read.asNondeterministic()(F.col(html_col)).alias("text"))
    return got.withColumn("n_chars", F.char_length("text").cast("long"))
