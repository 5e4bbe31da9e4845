"""The main text of web pages by a maximum-scoring subsequence.

A page is a row of words and tags. Words score positive and tags negative; the
contiguous run of the largest sum, found in one scan, is the region of the main
text. Weights are log odds of being main text, from labelled pages, for words by
where they stand (running text, heading, link) and for tags by their name; the
labels are either given or the pages' own ``article`` markup, which is hidden while
weights are learnt, so that pages without it are read by the same weights. A
prior (``PRIOR``) stands in for what labelled pages do not show.

What the markup says of a place enters the scores: words inside menus, page headers
and footers, sidebars, notices, adverts, forms and reader comments score 0, as do
words outside a page's articles if it marks such, and tags inside cost little. The
same places are left out of the region's text: adverts between paragraphs do not cut
it in two. Scripts, styles, comments of the markup, hidden elements and others
without text are not read. Of an article's own header the headings are kept.

A heading directly before the region belongs to it. Blocks are what block elements
bound; ``br`` is white space. Character references are decoded once, with or
without a semicolon as in HTML. Null and empty pages, and pages without words, give
an empty text; of equal runs the first counts; repeated rows give repeated results;
pages are read whole, however long, cut off anywhere. An empty table gives no rows;
a sample without labels leaves the prior. Only html is read, other columns stay.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, with content that is no text or no markup, that bound blocks, and that stand in a head.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("head script style template noscript title iframe object svg math canvas audio video select textarea option button".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEAD = frozenset("meta link base title style script noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr b br cite code em i img mark q s small span strong sub sup time u wbr".split())
#: Elements whose start ends an open element of the list before the bar, not beyond those after it.
ENDED = {"li": "li|ul ol", "dt": "dt dd|dl", "dd": "dt dd|dl", "tr": "tr td th|table", "td": "td th|tr table", "th": "td th|tr table", "a": "a|"}
ENDED = {tag: tuple(frozenset(part.split()) for part in rule.split("|")) for tag, rule in ENDED.items()}
PARAGRAPH_ENDED = (frozenset(["p"]), frozenset("article main section div td th li blockquote body".split()))
#: Places that are no main text, by element, and by a word of the class, id or role.
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adbox advert advertisement advertising adslot alert banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright dialog footer gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice notification overlay pager pagination popup promo promoted promotion rail recommendations recommended related search share sharing sidebar signup social sponsor sponsored submenu subscribe subscription teaser toolbar widget"
    .split()
)
COMMENT_WORDS = frozenset("comment commentlist comments disqus replies reply respond".split())
#: Places that are, likewise.
INSIDE = {"main": 1, "article": 2}
INSIDE_WORDS = frozenset("article articlebody content entry main post story".split())
#: Scores, where a word of running text has 1, of words and tags of which labelled pages say little, and how many sightings they stand for.
PRIOR = {"text": 1.0, "heading": 0.5, "link": 0.05, "p": -0.3, "br": -0.1, "li": -1.5, "a": -1.0, "inline": -0.1, "title": -0.5, "block": -4.0, "outside": -8.0}
PRIOR_WEIGHT = 50
#: Cost of a tag inside the article where the markup names it; least score of a word and least cost of a tag elsewhere.
IN_ARTICLE, LEAST = 0.02, 0.01
#: Score of a word outside of all places that are named as main text, if a page has such.
ELSEWHERE = 0.3
#: Pages that weights are learnt from, about.
LEARN_PAGES = 4000

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: What is known of a place; from TOP, the header of an article, on it is no main text.
OPEN, IN, TOP, OUT, COMMENTS, GONE = range(6)


@dataclass(slots=True)
class Piece:
    """A run of text with its place, or a tag."""

    text: str  # decoded; "" for a tag
    kind: str  # text, heading, link or space; of a tag its name, with a slash if it closes
    place: int
    block: int  # number of the block it belongs to
    level: int  # 2 within an article, 1 within the page's main element


def _named(attributes: str) -> tuple[set[str], bool, bool]:
    """Words of class, id and role; whether the property is that of an article's body; whether the element is hidden."""
    names, body, hidden = set(), False, False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            for name in value.split():
                parts = _WORD.findall(name)
                names.update(parts)
                names.add("".join(parts))
        elif key == "itemprop":
            body |= value == "articlebody"
        else:
            hidden |= (key == "hidden" and value != "false") or (key == "aria-hidden" and value == "true") or (key == "style" and bool(_HIDDEN.search(value)))
    return names, body, hidden


def place_of(tag: str, attributes: str, around: int, level: int, by_name: bool) -> tuple[int, int]:
    """Place and level of an element, from its tag, its attributes if names count, and what is around it."""
    if around == GONE or tag in NO_TEXT:
        return GONE, level
    names, body, hidden = _named(attributes) if attributes.strip() else (set(), False, False)
    if hidden:
        return GONE, level
    names = names if by_name and tag not in ("html", "body") else set()
    if around == COMMENTS or (names & COMMENT_WORDS and tag not in INSIDE):
        return COMMENTS, level
    if tag in INSIDE or body:  # also in a wrapper that is named after the sidebar beside it
        return IN, max(level, INSIDE.get(tag, 2))
    if tag in OUTSIDE or names & OUTSIDE_WORDS:
        return OUT, level
    if tag == "header":
        return (OUT if level < 2 else max(around, TOP)), level
    if around == TOP and tag in HEADINGS or around == OPEN and names & INSIDE_WORDS:
        return IN, level
    return around, level


def pieces(page: str, by_name: bool = True) -> list[Piece]:
    """Texts and tags of a page in order, without hidden ones; elements end where HTML implies it."""
    out: list[Piece] = []
    stack: list[tuple[str, int, int]] = [("", OPEN, 0)]
    opened: Counter = Counter()  # open elements by tag; of headings together by "#"
    block = at = 0
    size = len(page)

    def pop(to: int) -> None:
        for tag, _, _ in stack[to:]:
            opened[tag] -= 1
            opened["#"] -= tag in HEADINGS
        del stack[to:]

    while at < size:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else size
        _, place, level = stack[-1]
        if stop > at and place != GONE:
            text = entities.unescape(page[at:stop])
            kind = "space" if not text.strip() else "link" if opened["a"] else "heading" if opened["#"] else "text"
            out.append(Piece(text, kind, place, block, level))
        if not found:
            break
        at = found.end()
        if not found.group(2):
            continue
        closing, tag, attributes = found.group(1), found.group(2).lower(), found.group(3)
        if tag == "br" and place != GONE:
            out.append(Piece(" ", "space", place, block, level))
        block += tag in BLOCKS
        if closing:
            if opened[tag] > 0:
                depth = next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag)
                _, place, level = stack[depth]
                pop(depth)
        else:
            if stack[-1][0] == "head" and tag not in HEAD:
                pop(len(stack) - 1)
            ends, limits = ENDED.get(tag) or (PARAGRAPH_ENDED if tag in BLOCKS else ((), ()))
            if any(opened[e] > 0 for e in ends):
                depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] in ends or stack[d][0] in limits), 0)
                if depth and stack[depth][0] in ends:
                    pop(depth)
            _, around, above = stack[-1]
            place, level = place_of(tag, attributes, around, above, by_name)
            # inline elements that change nothing are not kept open, so forgotten ends do not pile up
            if tag not in VOID and (tag in BLOCKS or tag == "a" or place != around or opened[tag] > 0):
                stack.append((tag, place, level))
                opened[tag] += 1
                opened["#"] += tag in HEADINGS
            if tag in RAW:
                end = re.compile(rf"</{tag}(?![a-z])", re.I).search(page, at)
                at = end.start() if end else size
        if place != GONE:
            out.append(Piece("", closing + tag, place, block, level))
    return out


def _family(kind: str) -> str:
    """The prior's entry for a tag."""
    tag = kind.lstrip("/")
    if tag in HEADINGS:
        return "title"
    if tag in PRIOR:
        return tag
    return "outside" if tag in OUTSIDE or tag in ("header", "html", "body") else "block" if tag in BLOCKS else "inline"


@dataclass(frozen=True)
class Weights:
    """Scores of a word by its kind, above 0, and of a tag by its name, below 0."""

    words: dict[str, float]
    tags: dict[str, float]

    def scores(self, seen: list[Piece]) -> list[float]:
        """The score of each piece of a page; a page's words outside its articles, if it has such, score 0."""
        level = max((p.level for p in seen if p.place < TOP and p.text.strip()), default=0)
        named = any(p.place == IN and p.text.strip() for p in seen)
        out = []
        for p in seen:
            if p.text:
                known = p.kind == "space" or p.place >= TOP or p.level < level
                out.append(0.0 if known else self.words[p.kind] * len(p.text.split()) * (ELSEWHERE if named and p.place == OPEN else 1.0))
            elif p.level == level > 0 and p.kind.lstrip("/") not in INSIDE or p.place == IN and p.level >= level:
                out.append(-IN_ARTICLE)
            else:
                out.append(self.tags.get(p.kind) or min(-LEAST, PRIOR[_family(p.kind)]))
        return out


def counts(page: str) -> Counter:
    """(kind, whether in the main text) of the words and tags of a page, labelled by its article markup; nothing if it has none.

    Tags at places that are known to be outside say nothing of their name.
    """
    seen = pieces(page)
    out: Counter = Counter()
    if any(p.level and p.text.strip() for p in seen):
        for p in seen:
            inside, tag = p.level > 0 and p.place < TOP, p.kind.lstrip("/")
            if p.text and p.kind != "space":
                out[p.kind, inside] += len(p.text.split())
            elif not p.text and tag not in INSIDE and p.place < TOP and tag in BLOCKS | INLINE:
                out["<" + p.kind, inside] += 1
    return out


def weights_from(observed: dict[tuple[str, bool], int]) -> Weights:
    """Log odds of main text by kind, in units of those of a word of running text, drawn to the prior."""

    def log_odds(kind: str) -> float:
        return math.log((observed.get((kind, True), 0) + 1) / (observed.get((kind, False), 0) + 1))

    unit = max(1.0, log_odds("text"))

    def score(kind: str, prior: float) -> float:
        n = min(PRIOR_WEIGHT, observed.get((kind, True), 0) + observed.get((kind, False), 0))
        return (log_odds(kind) / unit * n + prior * PRIOR_WEIGHT) / (n + PRIOR_WEIGHT)

    words = {kind: min(1.0, max(LEAST, score(kind, PRIOR[kind]))) for kind in ("text", "heading", "link")}
    return Weights(words, {kind[1:]: min(-LEAST, score(kind, PRIOR[_family(kind[1:])])) for kind, _ in observed if kind[0] == "<"})


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the first contiguous run with the largest sum, empty if no score is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for at, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, at
        total += score
        if total > best:
            best, region = total, (start, at + 1)
    return region


def _widened(seen: list[Piece], start: int, end: int) -> tuple[int, int]:
    """The region with the rest of its outer blocks, and with the headings directly before it."""
    while end < len(seen) and seen[end].block == seen[end - 1].block:
        end += 1
    while True:
        while start and seen[start - 1].block == seen[start].block:
            start -= 1
        back = start
        while back and not seen[back - 1].text.strip() and seen[back - 1].place < TOP and (seen[back - 1].kind[0] != "/" or seen[back - 1].kind[1:] in HEADINGS | INLINE):
            back -= 1
        if not back or seen[back - 1].kind != "heading" or seen[back - 1].place >= TOP:
            return start, end
        start = back - 1


def main_text(page: str | None, weights: Weights) -> str:
    """The main text of one page, a line for each block."""
    for by_name in (True, False):  # where all text is at places named otherwise, the names are of something else
        seen = pieces(page or "", by_name)
        start, end = best_region(weights.scores(seen))
        if start < end:
            break
    else:
        return ""
    start, end = _widened(seen, start, end)
    blocks: dict[int, list[str]] = {}
    for p in seen[start:end]:
        if p.text and p.place < TOP:
            blocks.setdefault(p.block, []).append(p.text)
    lines = (" ".join("".join(held).split()) for held in blocks.values())
    return "\n".join(line for line in lines if line)


def _count_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            total += counts(page)
    rows = sorted(total.items())
    yield pa.record_batch([pa.array([k for (k, _), _ in rows], pa.string()), pa.array([y for (_, y), _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], names=["kind", "inside", "n"])


def learn(pages: DataFrame, *, about: int = LEARN_PAGES) -> Weights:
    """Weights from about ``about`` of the pages, chosen by a hash of their html, that mark their article.

    What is collected is a number for each tag of HTML.
    """
    html = pages.select(F.col("html").cast("string").alias("html")).where("html is not null")
    share = min(1.0, about / max(1, html.count()))
    chosen = html.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int(share * (1 << 20)))
    observed = chosen.mapInArrow(_count_pages, "kind string, inside boolean, n bigint").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return weights_from({(r.kind, r.inside): r.n for r in observed.collect()})


def extract(pages: DataFrame, weights: Weights, html: Column | None = None) -> DataFrame:
    """``pages`` without html, with text and n_chars (code points); columns of these names are replaced."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]
    rows = pages.select(*kept, (F.col("html") if html is None else html).cast("string").alias("html"))
    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [main_text(page, own) for page in batch.column("html").to_pylist()]
            columns = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.record_batch([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
