"""Main text of HTML pages by a tree-structured graphical model.

The page is parsed into a tree of block elements whose leaves are runs of inline text.  Every node has a hidden state:
whether there is content in it.  Node potentials come from its class, id and role words, or, for a run of text, its
length, links and punctuation; edge potentials from the states of parent and child and the tag of the child.  Messages pass once
upward and once downward (sum-product), which is exact on a tree; a run whose content marginal is above one half is
part of the main text.  All potentials are smoothed counts over labelled pages.

Text: character references are decoded, white space inside a run becomes one blank, runs are joined in page order by
one blank.  Comments, scripts, styles, templates, frames, drawings, what stands in for media and the head are no text.

Defined results: null, empty and blank pages give an empty text; broken markup is read as far as it goes (unclosed
elements end with their parent, unmatched end tags are ignored).  A head without an end ends at the first tag or text
that may not stand in it; a media element that is still open where a block around it ends holds nothing.  A quote in a
tag opens a value only after ``=``.  Each row is read on its own, so repeated rows get the
same text.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewindows.llm.labelled_pages import labelled_pages

SMOOTH = 0.5
MAX_FEATURES = 50_000  # most frequent features that the model keeps
RUN_WEIGHT = 0.35  # runs of one box are alike: their potentials are flattened, so that many do not outvote the box
LABELLED = 1500  # labelled pages to train on

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*)>?""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCE = tuple(".!?:;。！？…")
VOID = frozenset("area base col embed img input link meta param source track wbr hr br".split())
SILENT = frozenset("script style template noscript head title svg iframe object canvas audio video".split())
MEDIA = frozenset("svg object canvas audio video".split())  # what stands in them is shown by old readers only, or drawn
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes script style template".split())
RAW = frozenset("script style template noscript title iframe".split())  # their end is sought as text
# Elements that begin a new run of text.  All others, unknown ones too, stand in the line.
BLOCK = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td textarea tfoot th thead tr ul".split()
)
BLOCKS_END_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul".split()
)
# An opening tag ends open elements of these tags, up to the nearest one of the second set.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}


SOUGHT_END = re.compile(rf"</({'|'.join(sorted(MEDIA | RAW))})(?=[\s/>]|\Z)", re.I)
P_STAYS = ("td", "th", "button", "table")  # a paragraph around one of these is not ended from inside it


class Tree:
    """Nodes in document order: parent, features key, tag, and the text of leaves (None for elements)."""

    __slots__ = ("parent", "key", "tag", "text", "label", "children")

    def __init__(self) -> None:
        self.parent, self.key, self.tag, self.text, self.label = [-1], [("root", "")], ["root"], [None], [False]
        self.children: list[int] = []  # number of children, counted when first asked for

    def alone(self, i: int) -> bool:
        if len(self.children) != len(self.parent):
            self.children = [0] * len(self.parent)
            for p in self.parent[1:]:
                self.children[p] += 1
        return self.children[self.parent[i]] == 1


def parse(page: str) -> Tree:
    tree = Tree()
    stack = [(0, "root")]  # open block elements
    silent: list[str] = []
    parts: list[str] = []
    link_parts: list[str] = []
    where: dict[str, list[int]] = {}  # places of the open elements of each tag in the stack
    inside: list[str] = []  # elements open in a media element
    inside_of: Counter = Counter()
    media_at = void_until = 0  # where that one began; before the second place media tags hold nothing
    last_end = {m.group(1).lower(): m.start() for m in SOUGHT_END.finditer(page)}
    links = labelled = at = 0

    def flush() -> None:
        if not parts:
            return
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            linked = len(" ".join(html.unescape("".join(link_parts)).split()))
            words = text.count(" ") + 1
            size = 0 if words <= 3 else 1 if words <= 10 else 2 if words <= 25 else 3
            share = 0 if not linked else 1 + min(2, int(3 * linked / (len(text) + 1)))
            tree.parent.append(stack[-1][0])
            tree.key.append((size, share, text.endswith(SENTENCE), stack[-1][1]))
            tree.tag.append("#text")
            tree.text.append(text)
            tree.label.append(labelled > 0)
        parts.clear()
        link_parts.clear()

    def close_to(depth: int) -> None:
        flush()
        while len(stack) > depth:
            where[stack.pop()[1]].pop()

    def nearest(*tags: str) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    while True:
        found = TOKEN.search(page, at)
        if found is None:
            if silent and silent[0] in MEDIA:  # never closed: read again from behind its tag
                at, void_until = media_at, len(page)
                silent.clear()
                continue
            break
        start, end = found.span()
        if silent == ["head"] and page[at:start].strip():
            silent.clear()
        if start > at and not silent:
            parts.append(page[at:start])
            if links:
                link_parts.append(page[at:start])
        at = end
        name = found.group(2)
        if name is None:
            if found.group().startswith("<![CDATA[") and not silent:
                parts.append(html.escape(found.group()[9:].removesuffix("]]>")))
            continue
        name, closing, rest = name.lower(), found.group(1), found.group(3)
        if closing:
            if name in SILENT:
                if name in silent:
                    del silent[len(silent) - 1 - silent[::-1].index(name) :]
                if not silent:
                    inside.clear()
                    inside_of.clear()
            elif silent:
                if silent[0] in MEDIA and name in BLOCK:
                    if inside_of[name]:
                        while inside_of[name]:
                            last = inside.pop()
                            inside_of[last] -= 1
                            if last == name:
                                break
                    elif where.get(name):
                        at, void_until = media_at, start
                        silent.clear()
                        inside.clear()
                        inside_of.clear()
            elif name == "a":
                links = max(0, links - 1)
            elif name == "x-label":
                flush()
                labelled = max(0, labelled - 1)
            elif nearest(name):
                close_to(nearest(name))
            continue
        if silent == ["head"] and name not in IN_HEAD:
            silent.clear()
        if name == "head" and (len(tree.parent) > 1 or "".join(parts).strip()):
            continue  # there is a body already
        if name in SILENT:
            if rest.rstrip().endswith("/") and name not in ("script", "style"):
                continue
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at) if last_end.get(name, -1) >= at else None
                if not close and name not in ("script", "style"):
                    continue
                at = close.start() if close else len(page)
            elif name in MEDIA:
                flush()
                if at <= void_until or last_end.get(name, 0) < at:
                    continue
                if not silent:
                    media_at = at
            silent.append(name)
            flush()
            continue
        if silent:
            if name in BLOCK and name not in VOID and not rest.rstrip().endswith("/"):
                inside.append(name)
                inside_of[name] += 1
            continue
        if name in ("br", "mtd"):
            parts.append(" ")
        elif name == "a":
            links += 1
        elif name == "x-label":
            flush()
            labelled += 1
        elif name not in BLOCK and not (name == "ins" and rest.strip()):
            continue
        else:
            if name in BLOCKS_END_P and nearest("p") > nearest(*P_STAYS):
                close_to(nearest("p"))
            if name in SIBLINGS:
                ends, stop = SIBLINGS[name]
                around = nearest(*stop)
                depth = min((places[k] for t in ends if (places := where.get(t)) and (k := bisect_right(places, around)) < len(places)), default=0)
                if depth:
                    close_to(depth)
            flush()
            if name in VOID:
                continue
            tree.parent.append(stack[-1][0])
            tree.key.append((name, rest.strip()))
            tree.tag.append(name)
            tree.text.append(None)
            tree.label.append(False)
            where.setdefault(name, []).append(len(stack))
            stack.append((len(tree.parent) - 1, name))
    if silent == ["head"] and page[at:].strip():
        silent.clear()
    if at < len(page) and not silent:
        parts.append(page[at:])
    flush()
    return tree


def features(key: tuple) -> list[str]:
    """The features of a node from its key: the name words of an element, or the shape of a run of text."""
    if len(key) == 4:
        size, share, stop, under = key
        return [f"size:{size}", f"links:{share} under:{under}", f"stop:{stop}"]
    found = []
    for name, value in ATTRIBUTE.findall(key[1]):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            found += sorted({f"name:{w.lower()}" for w in NAME_WORD.findall(value)})
    return found or [f"plain:{key[0]}"]


def edge_tag(tree: Tree, i: int) -> str:
    """What the potential between node ``i`` and its parent depends on: its tag, or the tag around a run, and whether it
    is all that its parent holds."""
    tag = tree.tag[i] if tree.text[i] is None else "run " + tree.tag[tree.parent[i]]
    return f"only {tag}" if tree.alone(i) else tag


def states(tree: Tree) -> list[bool]:
    """Labels of all nodes: a run by its mark, an element if there is content in it."""
    out = list(tree.label)
    for i in range(len(out) - 1, 0, -1):
        if out[i]:
            out[tree.parent[i]] = True
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            tree = parse(page or "")
            state = states(tree)
            counts["root", "", state[0]] += 1
            for i in range(1, len(state)):
                kind = "run" if tree.text[i] is not None else "element"
                counts[f"{kind}", "", state[i]] += 1
                for feature in features(tree.key[i]):
                    counts[kind, feature, state[i]] += 1
                for tag in ("", edge_tag(tree, i)):
                    counts[f"edge:{int(state[tree.parent[i]])}", tag, state[i]] += 1
    rows = [(a, b, c, n) for (a, b, c), n in counts.items()]
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "feature", "state", "n"])


class Model:
    """Log ratios of node potentials and probabilities of edges."""

    def __init__(self, counts: dict[tuple[str, str, bool], int]):
        self.counts = counts
        self.cached: dict[tuple, float] = {}
        self.edges: dict[str, tuple[float, float]] = {}

    def _seen(self, kind: str, feature: str) -> bool:
        return (kind, feature, True) in self.counts or (kind, feature, False) in self.counts

    def _ratio(self, kind: str, feature: str) -> float:
        yes, no = (self.counts.get((kind, feature, s), 0) + SMOOTH for s in (True, False))
        all_yes, all_no = (self.counts.get((kind, "", s), 0) + 2 * SMOOTH for s in (True, False))
        return math.log(yes / all_yes) - math.log(no / all_no)

    def evidence(self, key: tuple) -> float:
        """Log of the node potential of content over that of none."""
        if key not in self.cached:
            if len(self.cached) > 100_000:
                self.cached.clear()
            kind = "run" if len(key) == 4 else "element"
            known = [f for f in features(key) if self._seen(kind, f)]
            if not known and self._seen(kind, f"plain:{key[0]}"):
                known = [f"plain:{key[0]}"]  # names that no labelled page has say no more than none
            self.cached[key] = sum(self._ratio(kind, f) for f in known) * (RUN_WEIGHT if kind == "run" else 1.0)
        return self.cached[key]

    def root(self) -> float:
        """The probability that a page has content."""
        yes, no = (self.counts.get(("root", "", s), 0) + SMOOTH for s in (True, False))
        return yes / (yes + no)

    def edge(self, tag: str) -> tuple[float, float]:
        """The probability of content in a node of that tag whose parent has none or some."""
        if tag not in self.edges:
            out = []
            for state in (0, 1):
                yes, no = (self.counts.get((f"edge:{state}", "", s), 0) + SMOOTH for s in (True, False))
                prior = yes / (yes + no)
                yes, no = (self.counts.get((f"edge:{state}", tag, s), 0) for s in (True, False))
                out.append((yes + 4 * prior) / (yes + no + 4))
            self.edges[tag] = (out[0], out[1])
        return self.edges[tag]


def marginals(tree: Tree, model: Model) -> list[float]:
    """The content marginal of every node by one upward and one downward pass."""
    n, parent = len(tree.parent), tree.parent
    yes = [1.0] * n  # own potential times the messages of the children
    no = [1.0] * n
    yes[0], no[0] = model.root(), 1.0 - model.root()
    for i in range(1, n):
        yes[i] = math.exp(max(-30.0, min(30.0, model.evidence(tree.key[i]))))
    to_yes, to_no = [1.0] * n, [1.0] * n  # messages to the parent, for each of its states
    for i in range(n - 1, 0, -1):
        scale = yes[i] + no[i]
        yes[i], no[i] = yes[i] / scale, no[i] / scale
        empty, full = model.edge(edge_tag(tree, i))
        to_yes[i] = full * yes[i] + (1 - full) * no[i]
        to_no[i] = empty * yes[i] + (1 - empty) * no[i]
        p = parent[i]
        yes[p] *= to_yes[i]
        no[p] *= to_no[i]
        if yes[p] + no[p] < 1e-200:
            yes[p], no[p] = yes[p] * 1e200, no[p] * 1e200
    scale = yes[0] + no[0]
    yes[0], no[0] = yes[0] / scale, no[0] / scale
    for i in range(1, n):
        p = parent[i]
        empty, full = model.edge(edge_tag(tree, i))
        above_yes, above_no = yes[p] / to_yes[i], no[p] / to_no[i]  # the parent without this child
        yes[i] *= full * above_yes + empty * above_no
        no[i] *= (1 - full) * above_yes + (1 - empty) * above_no
        scale = yes[i] + no[i]
        yes[i], no[i] = yes[i] / scale, no[i] / scale
    return yes


def main_text(page: str | None, model: Model) -> str:
    if not page or not page.strip():
        return ""
    tree = parse(page)
    content = marginals(tree, model)
    return " ".join(t for t, p in zip(tree.text, content, strict=True) if t is not None and p > 0.5)


def train(labelled: DataFrame, page: str = "html", max_features: int = MAX_FEATURES) -> Model:
    """Count potentials over pages in which ``x-label data-label=content`` elements mark content."""
    counts = labelled.select(F.col(f"`{page}`").alias("html")).mapInArrow(_count, "kind string, feature string, state boolean, n long")
    counts = counts.groupBy("kind", "feature", "state").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind", "feature", "state").limit(max_features)
    return Model({(r.kind, r.feature, r.state): r.n for r in counts.collect()})


def _extract(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        for batch in batches:
            place = batch.num_columns - 1
            texts = [main_text(column.as_py(), model) for column in batch.column(place)]
            kept = [batch.column(i) for i in range(place)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in batch.schema][:-1] + ["text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """The columns ``keep`` with the main ``text`` and its code points ``n_chars``."""
    kept = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{page}`").alias("_html"))
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    return kept.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(model)), ", ".join([*given, "text string, n_chars long"]))


def op1_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(spark.createDataFrame(labelled_pages(LABELLED), "page_id long, html string"))
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)
