"""HTML extraction: the best contiguous region of a page by maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores positive where main text usually stands and negative
elsewhere, a tag scores negative, and one linear scan finds the contiguous region of the largest sum.

Weights are log-odds learned from labelled pages, those that mark their own main text with <article> or
<main>. A word's weight is that of its block's tag and of standing in a link, plus that of each container
around it, by its element and by the words of its class, id and role. Prior counts stand for what few pages
show: some elements and names are known to be menus, adverts, notices and so on, others say nothing. Names
of a state (has-sidebar, no-comments, nav-open) describe a page and not what is in the container; a name
that only starts with a weak word (search-theory) counts little.

The labels serve learning. Of a page to extract, a mark only says that words in it score a little at least
and that tags in it cost nothing, so its short lists and links stay; words outside it have their usual
weights, and the scan decides between them.

What stands in a container with clear evidence against it (a menu, an advert, reader comments) is no part
of the text wherever it is, so the scan steps over it, and one in the middle of an article does not cut it.
That evidence is not believed where it would leave nothing: a page's form or wrapper that holds at least
FRAME of its words along with its heading or mark is the page's frame, and if no region scores above
zero, containers that hold half of the words lose their evidence and the page is scanned again. (Elements
that are never main text, such as nav and footer, keep theirs.)

Tags are found by a scanner that never goes back, so time is linear in the page, whatever it holds. Text is
decoded after tags are found, white space inside a block becomes one space, blocks are joined in page
order by one space. The whole page is read; nothing is capped.

A null or empty html gives empty text. Unclosed, crossing and unknown tags, unfinished comments and tags
at the end of the page are taken as browsers do; a quote that never closes ends at its tag's end. Repeated
rows are extracted one by one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

# Fixed values of HTML: elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(("article", "main"))
#: Elements that are never main text, and those that seldom are.
NEVER = frozenset("nav menu aside footer button select option head svg math canvas object audio video dialog".split())
SELDOM = frozenset("form fieldset header".split())
#: Names of containers that are seldom main text wherever they stand in a class, id or role ...
STRONG = frozenset(
    "navbar navigation menu breadcrumb breadcrumbs pagination pager aside sidebar related recommended recommendations footer contentinfo copyright colophon masthead "
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promotion dfp adsense cookie cookies consent gdpr popup newsletter subscribe subscription signup "
    "paywall toast comment comments commentlist respond disqus sharebar searchbox searchform".split()
)
#: ... and names that say so alone or as the last of several.
WEAK = frozenset(
    "nav toolbar topbar tabs skip widget trending popular complementary rail teaser teasers header banner notice notices alert modal overlay reply replies discussion feedback share sharing social form search login".split()
)
#: Words that make a name one of a state.
STATE = frozenset("has have no not with without is are show shows hide hides hidden open opened closed close enabled disabled active inactive sticky visible".split())

#: How strongly a prior counts, in words or tags; the sides are (main, elsewhere).
PRIOR = 20.0
_LIKELY = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main section td dd dt figcaption li div text".split())
_PRIOR_SHARES = {"block": 0.75, "link": 0.35, "other": 0.05, "never": 0.005, "seldom": 0.03, "strong": 0.02, "weak": 0.30, "plain": 0.50}
WORD_RANGE, TAG_RANGE, NAME_RANGE = (-4.0, 1.5), (-2.0, -0.01), (-5.0, 0.0)
#: Evidence against a container from which its text is left out.
CLEAR = -2.0
#: A container with this share of the page's words, and its heading or mark, is the page's frame.
FRAME = 2 / 3
#: Least weight of a word inside a mark.
WORD_IN_MARK = 0.01
#: Learned weights kept: those of the most frequent contexts and names. Others have their prior.
MAX_WEIGHTS = 20_000

_START = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
# an attribute, with what stands before it; possessive, so that nothing is read twice
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=]?[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_CAMEL = re.compile(r"([a-z])([A-Z])")
_WORDS = re.compile(r"[a-z]+")
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


@dataclass(slots=True)
class Box:
    """A container: its parent's number, features of its element and names, whether it is (in) a mark, whether
    it holds a first heading or a mark."""

    parent: int
    features: tuple[str, ...]
    hidden: bool = False
    mark: bool = False
    heading: bool = False
    words: int = 0


@dataclass(slots=True)
class Page:
    """A page's boxes, and its runs: (tag, "") or (None, text) with block, link, box."""

    boxes: list[Box] = field(default_factory=lambda: [Box(-1, ())])
    runs: list[tuple[str | None, str, str, bool, int]] = field(default_factory=list)


_names: dict[str, tuple[str, ...]] = {}


def names_of(value: str) -> tuple[str, ...]:
    """The features of a class, id or role: each name's word that says most about it."""
    if (known := _names.get(value)) is not None:
        return known
    out = []
    for name in value.split():
        parts = _WORDS.findall(_CAMEL.sub(r"\1 \2", name).lower())
        if not parts or STATE & set(parts):
            continue
        strong = next((w for w in parts if w in STRONG), None)
        if strong:
            out.append("strong:" + strong)
        elif parts[-1] in WEAK:
            # the header of an entry or a page holds its title
            out.append(("weak:" if len(parts) == 1 or parts[-1] == "header" else "strong:") + parts[-1])
        else:
            out.append("plain:" + "-".join(parts))
    if len(_names) < 50_000:
        _names[value] = tuple(out)
    return tuple(out)


def _attributes(page: str, pos: int) -> tuple[dict[str, str], int]:
    """What a tag says from pos, and where it ends; len(page) + 1 if it does not."""
    said: dict[str, str] = {}
    n = len(page)
    while True:
        m = _ATTRIBUTE.match(page, pos)
        pos = m.end()
        if m[1]:
            name = m[1].lower()
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            if name in ("class", "id", "role", "hidden", "aria-hidden", "style"):
                said.setdefault(name, value)
        if pos >= n:
            return said, n + 1
        if page[pos] == ">":
            return said, pos + 1
        if m.end() == m.start():
            pos += 1  # a stray sign


def parse(page: str) -> Page:
    """The page's runs of text and tags, in one pass."""
    out = Page()
    boxes, runs = out.boxes, out.runs
    # of each open element: tag, box, nearest block's place in the stack, whether in a link
    stack: list[tuple[str, int, int, bool]] = []
    places: dict[str, list[int]] = {}
    pos, n, bang = 0, len(page), -1

    def pop(to: int) -> None:
        while len(stack) > to:
            places[stack.pop()[0]].pop()

    def text(a: int, b: int) -> None:
        if a < b:
            if stack:
                _, box, block, link = stack[-1]
                runs.append((None, page[a:b], stack[block][0] if block >= 0 else "text", link, box))
            else:
                runs.append((None, page[a:b], "text", False, 0))

    while pos < n:
        m = _START.search(page, pos)
        if not m:
            text(pos, n)
            break
        text(pos, m.start())
        pos = m.end()
        c = page[pos]
        box = stack[-1][1] if stack else 0
        if c == "!" or c == "?":
            if page.startswith("!--", pos):
                pos += 3
                if page.startswith((">", "->"), pos):
                    pos = page.index(">", pos) + 1
                else:
                    if bang < pos:  # the other way to end a comment is rare: looked for once, and again when passed
                        bang = page.find("--!>", pos)
                        bang = bang if bang >= 0 else n
                    end = page.find("-->", pos, bang)
                    pos = end + 3 if end >= 0 else min(n, bang + 4)
            else:
                end = page.find(">", pos)
                pos = end + 1 if end >= 0 else n
            continue
        closing = c == "/"
        name = _NAME.match(page, pos + closing)
        if not name:  # </ before no letter is a comment
            end = page.find(">", pos)
            pos = end + 1 if end >= 0 else n
            continue
        tag = name[0].lower()
        said, pos = _attributes(page, name.end())
        if pos > n:
            break  # an unfinished tag ends the page
        if closing:
            runs.append(("/" + tag, "", "", False, box))
            if places.get(tag):
                at = places[tag][-1]
                # an inline element's end does not reach out of a block
                if not (tag in INLINE and tag != "a" and stack[-1][2] > at):
                    pop(at)
            continue
        if tag in VOID:
            runs.append((tag, "", "", False, box))
            continue
        if tag in RAW:
            runs.append((tag, "", "", False, box))
            close = _CLOSE[tag].search(page, pos)
            pos = _attributes(page, close.end())[1] if close else n
            continue
        inline = tag in INLINE
        if not inline and stack:  # a new block ends an open paragraph, with what it left open
            at = stack[-1][2]
            if at >= 0 and (stack[at][0] == "p" or stack[at][0] == tag and tag in ("li", "dt", "dd", "td", "tr", "option")):
                pop(at)
        _, box, block, link = stack[-1] if stack else ("", 0, -1, False)
        if tag == "h1":
            boxes[box].heading = True
        hidden = "hidden" in said or said.get("aria-hidden", "").lower() == "true" or bool(said.get("style")) and bool(_NONE.search(said["style"]))
        own = tuple(dict.fromkeys(f for k in ("class", "id", "role") if k in said for f in names_of(said[k]))) if tag not in ("html", "body") else ()
        if boxes[box].mark:
            own = tuple(f for f in own if f != "weak:header")
        if tag in NEVER:
            own = ("never:" + tag, *own)
        elif tag in SELDOM and not (tag == "header" and boxes[box].mark):  # an article's own header holds its title
            own = ("seldom:" + tag, *own)
        if own or hidden or tag in MAIN:
            boxes.append(Box(box, own, hidden, boxes[box].mark or tag in MAIN, tag in MAIN))
            box = len(boxes) - 1
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, box, block if inline else len(stack), link or tag == "a"))
        runs.append((tag, "", "", False, box))
    for _, value, _, _, box in runs:
        if value:
            boxes[box].words += len(value.split())
    for box in range(len(boxes) - 1, 0, -1):  # children have higher numbers
        up = boxes[boxes[box].parent]
        up.words += boxes[box].words
        up.heading |= boxes[box].heading
    return out


def _context(block: str, link: bool) -> str:
    return f"in:{block}+a" if link else f"in:{block}"


def _count(page: str, found: Counter) -> None:
    """Adds a labelled page's words and tags, by feature and side."""
    parsed = parse(page)
    boxes = parsed.boxes
    if not any(b.mark for b in boxes):
        return
    odd: list[bool] = []  # whether a box is known to be other than main text, by itself or what is around it
    for b in boxes:
        odd.append(b.parent >= 0 and odd[b.parent] or b.hidden or any(f.startswith(("never:", "seldom:", "strong:")) for f in b.features))
    sums = [[0, 0] for _ in boxes]  # words elsewhere and in a mark
    for tag, value, block, link, box in parsed.runs:
        if tag:
            if not odd[box]:
                found["tag:" + tag, int(boxes[box].mark)] += 1
        elif words := len(value.split()):
            sums[box][boxes[box].mark] += words
            if not odd[box]:  # what its container explains says nothing about the block
                found[_context(block, link), int(boxes[box].mark)] += words
    for i in range(len(boxes) - 1, 0, -1):
        for side in (0, 1):
            sums[boxes[i].parent][side] += sums[i][side]
            for f in boxes[i].features if sums[i][side] else ():
                found[f, side] += sums[i][side]


def learn(pages: DataFrame) -> dict[tuple[str, int], int]:
    """Counts (feature, side) -> words or tags over all labelled pages, of at most MAX_WEIGHTS features."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for x in batch.column("html"):
                if x.as_py():
                    _count(x.as_py(), found)
                if len(found) > 20_000:
                    yield _counts(found)
                    found = Counter()
        yield _counts(found)

    def _counts(found: Counter) -> pa.RecordBatch:
        keys = list(found)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], ["feature", "side", "n"])

    counted = pages.select("html").mapInArrow(run, "feature string, side int, n long").groupBy("feature").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("b"))
    # Made-up elements and rare names stay below what a prior weighs.
    kept = counted.where(F.col("a") + F.col("b") >= int(PRIOR)).orderBy((F.col("a") + F.col("b")).desc(), "feature").limit(MAX_WEIGHTS).collect()
    return {(f, side): n for f, a, b in kept for side, n in enumerate((a, b)) if n}


class Weights:
    """Log-odds of contexts, names and tags."""

    def __init__(self, counts: dict[tuple[str, int], int]):
        self.counts, self.known = counts, {}
        self.tags = [max(1.0, sum(n for (c, s), n in counts.items() if s == side and c.startswith("tag:"))) for side in (0, 1)]

    def of(self, feature: str) -> float:
        if feature not in self.known:
            n = [self.counts.get((feature, side), 0) for side in (0, 1)]
            kind, _, value = feature.partition(":")
            if kind == "tag":
                odds = math.log((n[1] + 1) / (self.tags[1] + 1)) - math.log((n[0] + 1) / (self.tags[0] + 1))
                self.known[feature] = min(TAG_RANGE[1], max(TAG_RANGE[0], odds if sum(n) else -0.1))
            else:
                block, plus, _ = value.partition("+")
                share = _PRIOR_SHARES[kind if kind != "in" else "other" if block not in _LIKELY else "link" if plus else "block"]
                low, high = WORD_RANGE if kind == "in" else NAME_RANGE
                self.known[feature] = min(high, max(low, math.log((n[1] + PRIOR * share) / (n[0] + PRIOR * (1 - share)))))
        return self.known[feature]


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, last) of the largest sum, the first of equals; empty if none is above zero."""
    best = total = 0.0
    start = first = last = 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, first, last = total, start, i + 1
    return first, last


def scores(parsed: Page, weights: Weights, believed: bool = True) -> tuple[list[float], list[bool]]:
    """Each run's score, and whether its text is left out. With believed=False containers that hold half of
    the page's words have no evidence but for elements that are never main text."""
    boxes = parsed.boxes
    total = max(1, boxes[0].words)
    evidence, out = [0.0] * len(boxes), [False] * len(boxes)
    for i, b in enumerate(boxes):
        if b.parent < 0:
            continue
        own = min((weights.of(f) for f in b.features), default=0.0)
        frame = b.words >= FRAME * total and b.heading or not believed and 2 * b.words >= total
        if frame:
            own = min((weights.of(f) for f in b.features if f.startswith("never:")), default=0.0)
        evidence[i] = evidence[b.parent] + own
        out[i] = out[b.parent] or b.hidden or own <= CLEAR
    values, gone = [], []
    for tag, value, block, link, box in parsed.runs:
        gone.append(out[box])
        if out[box]:
            values.append(0.0)
        elif tag:
            values.append(0.0 if boxes[box].mark else weights.of("tag:" + tag))
        else:
            words = len(value.split())
            weight = max(WORD_RANGE[0], weights.of(_context(block, link)) + evidence[box])
            values.append(words * (max(WORD_IN_MARK, weight) if boxes[box].mark else weight))
    return values, gone


def extract(page: str, weights: Weights) -> str:
    """The main text of one page."""
    parsed = parse(page)
    values, gone = scores(parsed, weights)
    first, last = best_region(values)
    if first == last:
        values, gone = scores(parsed, weights, believed=False)
        first, last = best_region(values)
    blocks: list[str] = []
    inline: list[str] = []
    for i in range(first, last):
        tag, value, *_ = parsed.runs[i]
        if tag:
            if tag.lstrip("/") not in INLINE:
                blocks.append("".join(inline))
                inline = []
        elif not gone[i]:
            inline.append(value)
    blocks.append("".join(inline))
    return " ".join(x for b in blocks if b and (x := " ".join(htmllib.unescape(b).split())))


def extract_pages(pages: DataFrame, counts: dict[tuple[str, int], int] | None = None) -> DataFrame:
    """pages(page_id, url, html) as page_id, url, text, n_chars; weights are learned from the pages unless given."""
    small_batches(pages.sparkSession)
    learned = learn(pages) if counts is None else counts

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(learned)
        for batch in batches:
            texts = [extract(x.as_py() or "", weights) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
