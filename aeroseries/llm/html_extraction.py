"""Main text of web pages as the maximum-scoring run of tokens.

A page is a sequence of words and tags. Every token scores by the log-odds of its kind being content: words count by what
encloses them, tags by their name. The odds are learned from labelled pages, those that mark their article with ``article``
or ``main``; tags never score above a small negative value. A linear scan finds the run with the highest sum; its words,
without those inside menus, adverts, forms and the like, are the text. Such asides within the article do not break it: they
score as a tag. A page that marks no article is taken as one.

Weights come from a bounded sample (``LABELLED_PAGES``) and fit in a few dozen numbers. Each page is one pass of its own;
nothing is shuffled but the counts.

Defined cases: a null or empty page gives an empty text; without labelled pages the prior counts decide; an unclosed comment,
script or tag ends with the page; repeated rows are read each for itself; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the weights are learned from.
LABELLED_PAGES = 1_000
#: Tags score this at most.
TAG_CEILING = -0.01

# Fixed values of HTML: elements that hold no content of the article, that break blocks, that have no end tag, and names
# in ``class`` or ``id`` that mark what surrounds an article.
ASIDE_TAGS = set(
    "aside button canvas dialog embed fieldset footer form head header iframe input label menu nav noscript object option "
    "script select style svg template textarea title".split()
)
BLOCK_TAGS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split()
)
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
ASIDE_NAMES = set(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "disqus footer header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup "
    "promo promoted promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar widget".split()
)
MAIN_TAGS = {"article", "main"}
#: First parts of names that tell what an element goes with, not what it is: has-sidebar.
OTHERS = {"has", "no", "with", "without"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MARKED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Za-z]+")

# Kinds of token.
WORD, PLAIN_WORD, ASIDE_WORD, ASIDE_TAG = "word", "word outside", "word aside", "tag aside"
#: Of asides where the article may be. They are left out of the text, and so have no say in where it starts and ends.
INNER_WORD, INNER_TAG = "word aside within", "tag aside within"
#: Counts that stand for a few pages seen before: (in content, elsewhere).
PRIOR = {WORD: (20, 4), PLAIN_WORD: (2, 6), ASIDE_WORD: (0, 20), ASIDE_TAG: (0, 10)}


def _aside(name: str, attributes: str) -> bool:
    if name in ASIDE_TAGS:
        return True
    if name in ("html", "body") or name in MAIN_TAGS or not attributes:
        return False
    marks = (next(filter(None, found.groups()), "") for found in _MARKED.finditer(attributes))
    names = ([part.lower() for part in _NAME.findall(name)] for mark in marks for name in mark.split())
    return any(not ASIDE_NAMES.isdisjoint(parts) for parts in names if parts and parts[0] not in OTHERS)


def tokens(page: str) -> Iterator[tuple[str, str | None, bool]]:
    """(kind, text, breaks) in page order: runs of words with their text, and tags; ``breaks`` marks the edge of a block."""
    has_main = re.search(r"<(?:article|main)\b", page, re.I) is not None
    # Name, inside an aside, inside the main element, inside an aside by its tag.
    stack: list[tuple[str, bool, bool, bool]] = []
    opened = False
    at = 0
    for found in _MARKUP.finditer(page):
        if found.start() > at:
            yield _run(page[at : found.start()], stack, has_main)
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            yield "tag other", None, found["raw"] is not None
            continue
        breaks = name in BLOCK_TAGS
        if found["end"]:
            kind = "tag /" + name
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if stack[depth][1]:
                        kind = INNER_TAG if not has_main or stack[depth][2] else ASIDE_TAG
                    del stack[depth:]
                    break
        else:
            if breaks and any(entry[0] == "p" for entry in stack):
                while stack.pop()[0] != "p":
                    pass
            above = stack[-1] if stack else ("", False, False, False)
            aside = above[1] or _aside(name, found["rest"])
            if name == "main" or name == "article" and not opened and not above[2]:
                # A class name of a wrapper says nothing of the main element; later articles may be comments.
                aside = above[3]
            opened = opened or name in MAIN_TAGS and not aside
            kind = "tag " + name
            if aside:
                kind = INNER_TAG if not has_main or above[2] else ASIDE_TAG
            if name not in VOID_TAGS and not found["rest"].endswith("/"):
                stack.append((name, aside, above[2] or name in MAIN_TAGS, above[3] or name in ASIDE_TAGS))
        yield kind, " " if name == "br" else None, breaks
    if at < len(page):
        yield _run(page[at:], stack, has_main)


def _run(text: str, stack: list[tuple[str, bool, bool, bool]], has_main: bool) -> tuple[str, str, bool]:
    inside = not has_main or (stack and stack[-1][2])
    if stack and stack[-1][1]:
        return INNER_WORD if inside else ASIDE_WORD, text, False
    return (WORD if inside else PLAIN_WORD), text, False


def count_kinds(page: str) -> Counter:
    """Tokens of a labelled page by (kind, in content): content is what the main element holds, less its asides."""
    counts: Counter = Counter()
    inside = 0
    for kind, text, _ in tokens(page):
        if kind in ("tag article", "tag main"):
            inside += 1
        elif kind in ("tag /article", "tag /main"):
            inside = max(0, inside - 1)
        if kind.startswith("word"):
            counts[kind, kind == WORD] += len(text.split())
        else:
            counts[kind, inside > 0 and kind not in (ASIDE_TAG, INNER_TAG)] += 1
    return counts


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of each kind; those of tags are cut at ``TAG_CEILING``."""
    kinds = {kind for kind, _ in counts} | set(PRIOR)
    seen = {
        kind: tuple(counts.get((kind, inside), 0) + PRIOR.get(kind, (0, 0))[not inside] + 0.5 for inside in (True, False))
        for kind in kinds
    }
    content, elsewhere = (sum(pair[i] for pair in seen.values()) for i in range(2))
    odds = {kind: math.log(pair[0] / content) - math.log(pair[1] / elsewhere) for kind, pair in seen.items()}
    return {kind: value if kind.startswith("word") else min(value, TAG_CEILING) for kind, value in odds.items()}


def learn(pages: DataFrame, page: str = "html") -> dict[str, float]:
    """Weights from at most ``LABELLED_PAGES`` pages that mark their article."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for body in batch.column(0).to_pylist():
                total.update(count_kinds(body))
        columns = [(kind, inside, n) for (kind, inside), n in total.items()]
        kinds, inside, n = zip(*columns) if columns else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(inside, pa.bool_()), pa.array(n, pa.int64())], names=["kind", "inside", "n"]
        )

    body = F.col(page).cast("string")
    labelled = pages.select(body.alias("html")).filter(F.rlike(body, F.lit("(?i)<(article|main)\\b"))).limit(LABELLED_PAGES)
    found = labelled.mapInArrow(counted, "kind string, inside boolean, n bigint")
    # Names that no page repeats are left to the default, so that what is collected stays small.
    total = found.groupBy("kind", "inside").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n")).limit(1_000)
    return weights_of({(row["kind"], row["inside"]): row["n"] for row in total.collect()})


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the run with the highest positive sum, the first and then the longest of equals; (0, 0) if none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best or (total == best and best > 0 and start == found[0]):
            best, found = total, (start, i + 1)
    return found


def main_text(page: str, weights: dict[str, float]) -> str:
    """The text of the best run: blocks with single blanks, joined by empty lines."""
    parts = list(tokens(page))
    other = min(TAG_CEILING, weights.get("tag other", TAG_CEILING))
    scores = []
    for kind, text, _ in parts:
        if kind in (INNER_WORD, INNER_TAG):
            scores.append(TAG_CEILING)
        else:
            scores.append(weights[kind] * len(text.split()) if kind.startswith("word") else weights.get(kind, other))
    start, end = best_run(scores)
    blocks, block = [], []
    for kind, text, breaks in parts[start:end]:
        if breaks:
            blocks.append(block)
            block = []
        elif text and kind in (WORD, "tag br"):
            block.append(text)
    blocks.append(block)
    joined = (" ".join(html.unescape("".join(block)).split()) for block in blocks)
    return "\n\n".join(filter(None, joined))


def extract(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html", weights: dict[str, float] | None = None
) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for every page."""
    learned = learn(pages, page) if weights is None else weights

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(body or "", learned) for body in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    asked = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html")
    )
    return asked.mapInArrow(extracted, "page_id bigint, url string, text string, n_chars bigint")
