"""Quality rules as a short-circuit cascade.

Every rule is a Boolean column: true rejects a document. On a sample each rule's cost (seconds for the sample) and
selectivity (share it rejects) are measured, and the rules are tried in order of rejection per cost, so that most documents
are decided by the cheap and telling ones. The rules are tried inside one ``CASE`` expression, which stops at the first that
rejects. The order changes the time taken, never the verdict.

All expressions are JVM-side; documents are neither shuffled nor sorted.

Defined cases: a null or empty text has no words and is rejected; repeated rows are judged each for itself; an empty table
gives no rows; other columns are kept by ``keep_good`` and not read by ``measure``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroseries.functions.lineage import cut_lineage

#: Documents of the sample on which cost and selectivity are measured.
SAMPLE_ROWS = 2_000
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]"
_WINDOW = 5


def words_of(text: Column) -> Column:
    """The words of a text; an empty array if there are none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\x09-\\x0D]+"))


def word_chars(text: Column) -> Column:
    """Code points in words: all but blanks, which take one byte each."""
    blanks = F.octet_length(text) * 0
    for blank in _BLANKS:
        blanks = blanks + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(blank), F.lit("")))
    return F.coalesce((F.length(text) - blanks).cast("bigint"), F.lit(0).cast("bigint"))


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_SYMBOLS)).cast("bigint"), F.lit(0).cast("bigint"))


def n_capitals(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("\\p{Lu}")).cast("bigint"), F.lit(0).cast("bigint"))


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda line: F.trim(line, F.lit(_BLANKS)) != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it and wherever the filter is moved to."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def n_repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more, the first occurrence included."""

    def hashed(own: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(own) - _WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(own, i + F.lit(k)) for k in range(_WINDOW))))

    def counted(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(placed, covered)).otherwise(F.lit(0))

    def covered(placed: Column) -> Column:
        same = lambda k, other: F.coalesce(F.get(placed, k)["h"] == F.get(placed, other)["h"], F.lit(False))
        at = F.sequence(F.lit(0), F.size(placed) - 1)
        again = F.filter(at, lambda k: same(k, k + 1) | ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))))
        return let(F.sort_array(F.transform(again, lambda k: F.get(placed, k)["i"])), spread)

    def spread(starts: Column) -> Column:
        # A window covers its five words, less those that the next one covers again.
        fresh = lambda start, k: F.least(F.lit(_WINDOW), F.coalesce(F.get(starts, k + 1) - start, F.lit(_WINDOW)))
        return F.aggregate(F.transform(starts, fresh), F.lit(0), lambda a, b: a + b)

    several = let(words, lambda own: F.when(F.size(own) > _WINDOW, let(hashed(own), counted)).otherwise(F.lit(0)))
    return several.cast("bigint")


@dataclass(frozen=True)
class Rule:
    """A named condition on a text and its words that rejects a document."""

    name: str
    rejects: Callable[[Column, Column], Column]


#: The base rules, and those beside them; thresholds are shares in whole numbers, so that they are exact.
BASE = [
    Rule("few_words", lambda text, words: F.size(words) < 10),
    Rule("repeated_windows", lambda text, words: n_repeat_words(words) * 100 > F.size(words) * 20),
]
RULES = [
    Rule("symbols", lambda text, words: n_symbols(text) * 10 > F.size(words)),
    Rule(
        "repeated_lines",
        lambda text, words: let(lines_of(text), lambda lines: n_dup_lines(lines) * 100 > F.size(lines) * 30),
    ),
    Rule("capitals", lambda text, words: n_capitals(text) * 2 > word_chars(text)),
    Rule("long_words", lambda text, words: word_chars(text) > F.size(words) * 25),
    Rule(
        "few_letters",
        lambda text, words: F.size(F.filter(words, lambda word: F.rlike(word, F.lit("\\p{L}")))) * 2 < F.size(words),
    ),
]


def measured_order(docs: DataFrame, text: str, known: Sequence[Rule]) -> list[Rule]:
    """The rules by share rejected per second on a sample of the documents, the best first."""
    body = F.col(text).cast("string")
    some = docs.select(body.alias("text")).sample(0.1, seed=7).limit(SAMPLE_ROWS)
    sample = cut_lineage(some.select("text", words_of(F.col("text")).alias("words")))

    def seconds(condition: Column) -> tuple[float, int]:
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - began, rejected

    seconds(F.lit(False))
    idle, _ = seconds(F.lit(False))
    worth = {}
    for rule in known:
        took, rejected = min(seconds(rule.rejects(F.col("text"), F.col("words"))) for _ in range(2))
        worth[rule.name] = rejected / max(took - idle, 1e-3)
    return sorted(known, key=lambda rule: (-worth[rule.name], rule.name))


def rejected_by(ordered: Sequence[Rule], text: Column, words: Column) -> Column:
    """The name of the first rule in this order that rejects, or null; later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(rule.rejects(text, words), F.lit(rule.name)).otherwise(verdict)
    return verdict


def measure(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The base figures and the verdict for every document."""
    ordered = measured_order(docs, text, RULES)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    split = own.withColumn("words", words_of(F.col("text")))
    body, words, n_words = F.col("text"), F.col("words"), F.size("words").cast("bigint")
    counted = split.select(
        "doc_id", "text", "words", n_words.alias("n_words"), word_chars(body).alias("word_chars"),
        n_symbols(body).alias("n_symbols"), let(lines_of(body), n_dup_lines).alias("n_dup_lines"),
        n_repeat_words(words).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    base = counted.withColumn("base_failed", failed)
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(rejected_by(ordered, body, words).isNull())
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept")
    )


def keep_good(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents that no rule rejects."""
    ordered = measured_order(docs, text, [*BASE, *RULES])
    body = F.col(text).cast("string")
    return docs.filter(let(words_of(body), lambda words: rejected_by(ordered, body, words).isNull()))
