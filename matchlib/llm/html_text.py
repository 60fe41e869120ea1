"""Main text of web pages: flat blocks, their neighbours, and a decision tree.

A page is read as a flat run of text blocks. A block is described by its word
count and link density, those of the blocks before and after it, and by whether
it or a container of it is named as page furniture (1) or is an element for it
(2), stands in an article, is a heading, or has the words of a notice. A decision
tree, trained by Spark on the small labelled table below, tells main text from the
rest. Elements that are hidden by attribute, and inline ones named as adverts, are
left out.

Defined results: a null or empty html has no text (an empty string, 0
characters); a page cut short is read as far as it goes, a tag that never ends
is text up to the next tag; script, style, textarea and title run to their end
tag or the page's end; what else isn't shown (head, svg, button, option, ...) ends
at its end tag, its parent's, at <body>, at once if self-closing, or if it has no
end tag of its own at the next block; repeated rows are each extracted; a null url or
page_id is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import html as html_module
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["words", "link_density", "words_before", "density_before", "words_after", "density_after", "furniture", "article", "heading", "notice"]


def labelled_blocks() -> list[tuple]:
    """The labelled table: typical blocks between typical neighbours; the features in their order, then 1 for main text."""
    links, nothing, short, text, long = (3, 1.0), (0, 0.0), (6, 0.0), (40, 0.05), (160, 0.0)
    around = [(links, links), (nothing, nothing), (short, links), (links, short), (text, text), (text, links), (links, text), (long, nothing), (short, long)]
    out = []

    def add(main: int, words, densities, furniture=(0,), article=(0,), heading=(0,), notice=(0,), between=around) -> None:
        out.extend((w, d, *x, *y, f, a, h, n, main) for w in words for d in densities for x, y in between for f in furniture for a in article for h in heading for n in notice)

    # an article's own blocks, of any kind
    add(1, (1, 4, 12, 60, 300), (0.0, 0.3, 1.0), article=(1,), heading=(0, 1), notice=(0, 1))
    # furniture by name, unless it is long, free of links and among text; furniture by element
    add(0, (1, 8, 30, 90), (0.0, 0.3, 1.0), furniture=(1,), article=(0, 1), heading=(0, 1))
    add(0, (8, 30, 90), (0.0,), furniture=(1,), article=(0, 1), notice=(1,))
    add(1, (230, 400), (0.0, 0.1), furniture=(1,), article=(0, 1), notice=(0, 1))
    add(0, (230, 400), (0.6, 1.0), furniture=(1,), article=(0, 1))
    add(0, (1, 8, 30, 90, 230, 400), (0.0, 0.3, 1.0), furniture=(2,), article=(0, 1))
    # lists of links
    add(0, (1, 3, 8, 20, 60), (0.75, 1.0), heading=(0, 1))
    # paragraphs, wherever they stand
    add(1, (14, 25, 60, 150, 400), (0.0, 0.1, 0.3))
    add(1, (30, 80), (0.45,), between=[(x, y) for x in (text, long) for y in (text, long)])
    add(0, (8, 14), (0.45,))
    # short lines: in a text or alone they belong to it, beside links they don't
    told = [(x, y) for x in (short, text, long) for y in (short, text, long)]
    add(1, (1, 4, 8), (0.0, 0.2), between=told + [(x, y) for x in (text, long) for y in (links, nothing)] + [(nothing, nothing)])
    add(0, (1, 4, 8), (0.0, 0.2), between=[(links, links), (links, nothing), (nothing, links), (short, links), (short, nothing), (links, short)])
    # headings go with what follows
    add(1, (2, 6, 12), (0.0, 0.2), heading=(1,), between=[(x, y) for x in (links, nothing, short, text, long) for y in (short, text, long)] + [(nothing, nothing)])
    add(0, (2, 6, 12), (0.0, 0.2), heading=(1,), between=[(x, y) for x in (links, short, text, long) for y in (links, nothing)] + [(nothing, links)])
    # notices are short
    add(0, (2, 8, 14, 25, 45), (0.0, 0.2, 0.45), heading=(0, 1), notice=(1,))
    add(1, (90, 200, 400), (0.0, 0.2), notice=(1,))
    return out


# Elements by their part in a page.
RAW = "script style textarea title".split()
HIDDEN = set("noscript template svg math head select option button iframe object canvas audio video".split())
NESTING = set("template svg math object".split())
OWN_BODY = set("template iframe object".split())
INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input picture source".split())
CONTAINERS = set("article main section div nav header footer aside form ul ol dl table figure body html fieldset details dialog menu".split())
FURNITURE_TAGS = set("nav footer aside form dialog menu".split())
FURNITURE_NAMES = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads adv advert advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription share sharing social comment comments reply replies respond discussion disqus related recommended pagination pager toolbar login signup search form widget copyright legal toc commentlist commentbox commentform".split()
)
#: Parts of a compound name that tell only where or how a container stands: left-sidebar is a sidebar, job-search is no search.
PLACES = set("site page main global primary secondary left right top bottom mobile desktop sticky fixed inner outer box bar list block container wrapper wrap section area panel group row item items link links button buttons icons media post posts article articles thread more form js slot unit body head title message messages dialog holder space zone region module component element fluid user users reader readers visitor visitors stories topics tags bio small large new".split())
ARTICLE_NAMES = set("article content main post entry story".split())
ADVERT_NAMES = set("ad ads advert advertisement adsbygoogle promo promotion sponsor sponsored".split())
VOID = set("br hr img input wbr source".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CONTAINERS | HEADINGS | set("p li dt dd tr td th thead tbody tfoot caption pre blockquote address center hr figcaption summary".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z!?][^<>]*>",
    re.S | re.I,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I) for tag in RAW}
#: Words of notices, as a page has them outside its text.
_NOTICE = re.compile(r"©|\b(?:copyright|all rights reserved|cookies?|newsletter|subscribe|sign (?:up|in)|log ?in|privacy policy|terms of (?:use|service)|advertisement|sponsored)\b", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN_BY = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_STYLE_HIDES = re.compile(r"style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TEXT_TAG = re.compile(r"<(p|h1|article|main)(?=[\s/>])", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_OF_ANOTHER = re.compile(r"(?:with|without|has|no|not|show|hide)[-_]")


def _container(tag: str, attrs: str, inside: tuple[int, bool], wraps: bool = False) -> tuple[int, bool]:
    """(furniture: 1 by a name, 2 by an element for it; article) within a container that opens inside such a one. A compound name counts if its other parts tell of a place only; wraps: a form around paragraphs is no furniture."""
    furniture, article = inside
    names: set[str] = set()
    whole: set[str] = set()
    for found in _NAMES.findall(attrs):
        for token in found.lower().strip("\"'").split():
            whole.add(token)
            # with-sidebar tells of another element
            if not _OF_ANOTHER.match(token):
                parts = set(filter(None, _SPLIT.split(token)))
                names.update(parts if parts & FURNITURE_NAMES and all(x in FURNITURE_NAMES or x in PLACES or x.isdigit() or len(x) == 1 for x in parts) else parts - FURNITURE_NAMES | {token})
    named = bool((whole if tag in ("article", "main", "section", "body", "html") else names) & FURNITURE_NAMES)
    if tag in ("article", "main"):
        # a name on a wrapper doesn't reach into an article
        return 2 if inside[0] == 2 else int(named and tag != "main"), True
    if names & ARTICLE_NAMES and not named:
        article = True
    if (tag in FURNITURE_TAGS and not (tag == "form" and wraps)) or (tag == "header" and not article) or (named and not (article and names & {"header"})):
        furniture = 0 if tag in ("body", "html") else 2 if tag in FURNITURE_TAGS - {"form"} else 1
    return max(furniture, inside[0]), article


def _own_names(attrs: str, names: set[str]) -> bool:
    """Whether an element that is no container is named so: by a whole class name, or an advert's compound."""
    whole = {t for found in _NAMES.findall(attrs) for t in found.lower().strip("\"'").split()}
    return bool(whole & names) or any(_SPLIT.split(t)[0] in ADVERT_NAMES for t in whole)


def _hides(attrs: str) -> bool:
    """Whether attributes hide an element."""
    return bool(attrs) and ((("hidden" in attrs.lower()) and bool(_HIDDEN_BY.search(_QUOTED.sub("", attrs)))) or bool(_STYLE_HIDES.search(attrs)))


@functools.cache
def _same(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*?(/?)>", re.I)


@functools.cache
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


class _Ends:
    """Where elements of a page end; each tag's places are listed once for a page."""

    def __init__(self, html: str):
        self.html = html
        self.known: dict[str, tuple[list[int], list[int | None], int]] = {}
        self.texts: list[int] | None = None

    def _of(self, tag: str) -> tuple[list[int], list[int | None], int]:
        """The starts of the tag's tokens, for each the end of an element that opens just before it (None: no end of its own), and the last end tag's start."""
        if tag not in self.known:
            tokens = list(_same(tag).finditer(self.html))
            nests = tag in NESTING or tag in CONTAINERS or tag in INLINE
            # from the page's end on, with depths by the tags to the right: at that before an element's end tag it ends there
            depth, at, ends = 0, {}, []
            for m in reversed(tokens):
                if m[1]:
                    at[depth], depth = m.end(), depth + 1
                elif not m[2]:
                    depth -= 1
                    if not nests:
                        at = {}
                ends.append(at.get(depth - 1))
            last = max((m.start() for m in _end_tag(tag).finditer(self.html)), default=-1)
            self.known[tag] = [m.start() for m in tokens], ends[::-1], last
        return self.known[tag]

    def end(self, tag: str, at: int) -> int | None:
        """The place after the end tag of an element that opens before at; None if it has no end tag of its own."""
        starts, ends, _ = self._of(tag)
        i = bisect.bisect_left(starts, at)
        return ends[i] if i < len(ends) else None

    def any_after(self, tag: str, at: int) -> bool:
        """Whether an end tag follows."""
        return self._of(tag)[2] >= at

    def wraps(self, at: int) -> bool:
        """Whether a form that opens before at holds a page's text: a first heading, an article, or two paragraphs."""
        end = self.end("form", at)
        if self.texts is None:
            self.texts = [m.start() for m in _TEXT_TAG.finditer(self.html) for _ in range(1 if m[1].lower() == "p" else 2)]
        return bisect.bisect_left(self.texts, len(self.html) if end is None else end) - bisect.bisect_left(self.texts, at) >= 2


def blocks(html: str) -> list[tuple[str, int, int, int, bool, bool, bool]]:
    """(text, words, words in links, furniture, article, heading, notice) of each block that has text, in page order."""
    out, parts, linked = [], [], 0
    # (tag, state before it, whether text is hidden before it, whether the next block ends it)
    stack: list[tuple[str, tuple[int, bool], bool, bool]] = []
    state, hidden, heading, link, own = (0, False), False, False, 0, 0
    # tags that have no end tag any more
    endless: set[str] = set()
    ends = _Ends(html)
    # how often a tag stands in the stack
    opened: Counter[str] = Counter()

    def enter(tag: str, ends_with_block: bool) -> None:
        stack.append((tag, state, hidden, ends_with_block))
        opened[tag] += 1

    def innermost(tag: str) -> int | None:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if opened[tag] else None

    def close() -> None:
        nonlocal linked
        words = html_module.unescape("".join(parts)).split()
        if words:
            text = " ".join(words)
            out.append((text, len(words), min(linked, len(words)), max(state[0], own), state[1], heading, bool(_NOTICE.search(text))))
        parts.clear()
        linked = 0

    def text(s: str) -> None:
        nonlocal linked
        if s and stack and stack[-1][0] == "head" and stack[-1][3] and s.strip():
            leave(len(stack) - 1)
        if s and not hidden:
            parts.append(s)
            if link:
                linked += len(s.split())

    def leave(depth: int) -> None:
        nonlocal state, hidden
        state, hidden = stack[depth][1:3]
        for x in stack[depth:]:
            opened[x[0]] -= 1
        del stack[depth:]

    at = 0
    while m := _TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["raw"] or "").lower()
        if m["raw"]:
            if not (m[0].endswith("/>") and any(x[0] in ("svg", "math") for x in stack)):
                at = _RAW_END[tag].search(html, at).end()
            parts.append(" ")
            continue
        if not tag:
            continue
        attrs = m["attrs"] or ""
        if tag in BLOCKS:
            if tag == "body" and not m["end"] and hidden:
                own_body = any(opened[x] for x in OWN_BODY)
                of = next((i for i, x in enumerate(stack) if x[0] == "head" or (x[0] in HIDDEN and not own_body)), None)
                if of is not None:
                    leave(of)
            while hidden and stack and stack[-1][3]:
                leave(len(stack) - 1)
        if attrs and not m["end"] and not hidden and tag not in HIDDEN and tag not in VOID and tag not in ("html", "body") and (_hides(attrs) or (tag in INLINE and tag != "a" and _own_names(attrs, ADVERT_NAMES))):
            end = None if tag in endless else ends.end(tag, at)
            if end is not None:
                at = end
                parts.append(" ")
                if tag in BLOCKS:
                    close()
                continue
            if not ends.any_after(tag, at):
                endless.add(tag)
            if tag in BLOCKS and tag not in CONTAINERS:
                close()
                enter(tag, True)
                hidden = True
                continue
        if tag in HIDDEN:
            if m["end"]:
                depth = innermost(tag)
                if depth is not None:
                    leave(depth)
            elif not m["attrs"].endswith("/"):
                enter(tag, tag in endless or ends.end(tag, at) is None)
                if tag not in endless and not ends.any_after(tag, at):
                    endless.add(tag)
                hidden = True
            parts.append(" ")
            continue
        if hidden and not (m["end"] and tag in CONTAINERS):
            if tag in CONTAINERS:
                enter(tag, False)
            continue
        if tag in INLINE:
            if tag == "a":
                link = max(0, link + (-1 if m["end"] else 1))
            elif tag == "br":
                parts.append(" ")
            continue
        depth = innermost(tag) if m["end"] and tag in CONTAINERS else None
        if hidden and (depth is None or stack[depth][2]):
            # an end tag of nothing, or of what opened in hidden text
            if depth is not None:
                leave(depth)
            continue
        close()
        link = 0
        heading = tag in HEADINGS and not m["end"]
        own = int(bool(attrs) and not m["end"] and tag not in CONTAINERS and _own_names(attrs, FURNITURE_NAMES - {"header"}))
        if tag in CONTAINERS:
            if not m["end"]:
                enter(tag, False)
                state = _container(tag, attrs, state, tag == "form" and ends.wraps(at))
            elif depth is not None:
                leave(depth)
    text(html[at:])
    close()
    return out


def features(page: list[tuple]) -> np.ndarray:
    """A row of FEATURES for each block."""
    n = len(page)
    words = np.array([b[1] for b in page], dtype=float)
    density = np.array([b[2] / b[1] for b in page], dtype=float)
    pad = lambda x, k: np.concatenate([[0.0], x])[:n] if k < 0 else np.concatenate([x, [0.0]])[1:]
    return np.column_stack([words, density, pad(words, -1), pad(density, -1), pad(words, 1), pad(density, 1), *(np.array([b[i] for b in page], dtype=float) for i in (3, 4, 5, 6))])


def train(spark: SparkSession, labelled: list[tuple] | None = None, depth: int = 12) -> list[tuple[int, float, int, int, int]]:
    """The tree as nodes (feature, threshold, left, right, class): a row goes left if its feature is at most the threshold; feature -1 marks a leaf."""
    rows = spark.createDataFrame([(*map(float, r[:-1]), float(r[-1])) for r in labelled or labelled_blocks()], [*FEATURES, "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=0).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    lines = [x.strip() for x in model.toDebugString.splitlines()[1:] if x.strip()]
    nodes: list[tuple[int, float, int, int, int]] = []

    def grow(i: int) -> tuple[int, int]:
        """(number of the node that line i begins, next line)."""
        me = len(nodes)
        nodes.append((-1, 0.0, 0, 0, 0))
        if leaf := re.match(r"Predict: ([\d.]+)", lines[i]):
            nodes[me] = (-1, 0.0, 0, 0, int(float(leaf[1])))
            return me, i + 1
        feature, threshold = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", lines[i]).groups()
        left, i = grow(i + 1)
        right, i = grow(i + 1)  # after its "Else"
        nodes[me] = (int(feature), float(threshold), left, right, 0)
        return me, i

    grow(0)
    return nodes


def classify(nodes: list[tuple[int, float, int, int, int]], rows: np.ndarray) -> np.ndarray:
    """The class of each row."""
    out = np.zeros(len(rows), dtype=np.int64)

    def walk(node: int, at: np.ndarray) -> None:
        feature, threshold, left, right, value = nodes[node]
        if feature < 0:
            out[at] = value
        elif len(at):
            low = rows[at, feature] <= threshold
            walk(left, at[low])
            walk(right, at[~low])

    walk(0, np.arange(len(rows)))
    return out


def main_text(html: str | None, nodes: list[tuple[int, float, int, int, int]]) -> str:
    """The main blocks of a page, joined by empty lines."""
    page = blocks(html or "")
    if not page:
        return ""
    return "\n\n".join(b[0] for b, main in zip(page, classify(nodes, features(page))) if main)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of pages(page_id, url, html)."""
    nodes = train(pages.sparkSession)

    def of(batches):
        for batch in batches:
            texts = [main_text(x, nodes) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(of, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
