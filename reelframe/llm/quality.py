"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.cluster import release_memory

#: Rows on which cost and selectivity of the rules are estimated. The order they give never changes a verdict.
SAMPLE_ROWS = 512
#: Texts of a batch that are Python strings at once; bounds memory only.
TEXTS_AT_ONCE = 256
#: Words of a repeated window.
WINDOW = 8
_MARKS = bytes(set(range(256)) - set(b"#*$%&|<>"))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Text:
    """One text's figures, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass")
        self.known: dict[str, int] = {}

    def __getitem__(self, name: str) -> int:
        if name not in self.known:
            self.known[name] = MEASURES[name](self)
        return self.known[name]

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # at ASCII white space


def _word_chars(t: Text) -> int:
    joined = b"".join(t.words)
    return len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))


def _dup_lines(t: Text) -> int:
    lines = [x for x in t.raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _repeat_words(t: Text) -> int:
    """Words inside windows of eight words that occur twice or more. Windows are told apart by 64-bit sums of
    their words' hashes, and those that look equal are compared word by word."""
    words = t.words
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        sums = sums * _MULTIPLIER + codes[k : k + n]
    order = np.argsort(sums, kind="stable")
    ranked = sums[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[1:] |= same
    twice[:-1] |= same
    seen: dict[tuple, int] = {}
    hit = np.zeros(n, bool)
    for i in order[twice].tolist():
        first = seen.setdefault(tuple(words[i : i + WINDOW]), i)
        if first != i:
            hit[first] = hit[i] = True
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    return int((np.cumsum(marks) > 0).sum())


MEASURES: dict[str, Callable[[Text], int]] = {
    "n_words": lambda t: len(t.words),
    "word_chars": _word_chars,
    "n_symbols": lambda t: len(t.raw.translate(None, _MARKS)),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text when ``rejects`` holds; the figures it asks for are computed only then."""

    name: str
    rejects: Callable[[Text], bool]
    base: bool = False


#: The first two are the base rules. The others are fixed limits of web-corpus filters: symbols to words,
#: repeated lines (three at least), and mean length of words.
RULES = [
    Rule("few_words", lambda t: t["n_words"] < 20, base=True),
    Rule("repeated_words", lambda t: 100 * t["n_repeat_words"] > 30 * t["n_words"], base=True),
    Rule("symbols", lambda t: 10 * t["n_symbols"] > t["n_words"]),
    Rule("repeated_lines", lambda t: t["n_dup_lines"] > 2 and 10 * t["n_dup_lines"] > 3 * (1 + t.raw.count(b"\n"))),
    Rule("word_length", lambda t: t["word_chars"] < 2 * t["n_words"] or t["word_chars"] > 15 * t["n_words"]),
]


def order_rules(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` with the highest rejection per second first, as measured on the executors over a hashed sample.

    Only sums by rule come to the driver. An empty table leaves the order as given.
    """

    def measure(batches):
        spent, hits = np.zeros(len(rules)), np.zeros(len(rules), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for i, rule in enumerate(rules):
                    fresh, began = Text(text), time.perf_counter()
                    hits[i] += bool(rule.rejects(fresh))
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(spent), pa.array(hits)], names=["rule", "seconds", "rejected"])

    total = docs.count()
    if not total:
        return list(rules)
    share = min(1.0, sample_rows / total)
    sample = docs.select(F.col("text").cast("string")).sample(False, share, seed=17)
    got = {r["rule"]: r for r in sample.mapInArrow(measure, "rule int, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-(got[i]["rejected"] / max(got[i]["seconds"], 1e-9)) if i in got else 0, i))]


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, figures: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Run the cascade over every whole text: ``doc_id``, the columns ``keep``, ``kept`` and ``rejected_by``.

    A text leaves the cascade at the first rule that rejects it; later rules don't look at it. With ``figures``
    the rest of its figures and ``base_failed`` are added afterwards. A null text counts as empty (and fails the
    minimum of words); repeated rows each get their verdict; an empty table gives none. ``kept`` doesn't depend
    on the order of the rules; ``rejected_by`` does.
    """
    rules = order_rules(docs) if rules is None else rules
    keep = keep or []
    base = [r for r in rules if r.base]
    schema = docs.select("doc_id", *keep).schema.add("kept", "boolean").add("rejected_by", "string")
    if figures:
        for name in MEASURES:
            schema = schema.add(name, "long")
        schema = schema.add("base_failed", "boolean")

    def judge(batches):
        for batch in batches:
            by, values, failed = [], {m: [] for m in MEASURES}, []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                t = Text(text)
                by.append(next((r.name for r in rules if r.rejects(t)), None))
                if figures:
                    for m, out in values.items():
                        out.append(t[m])
                    failed.append(any(r.rejects(t) for r in base))
            cols = [*batch.columns[:-1], pa.array([b is None for b in by], pa.bool_()), pa.array(by, pa.string())]
            if figures:
                cols += [*(pa.array(v, pa.int64()) for v in values.values()), pa.array(failed, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select("doc_id", *keep, F.col("text").cast("string").alias("__text")).mapInArrow(judge, schema)


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that every rule lets pass, all columns unchanged.

    Only texts go to the Python workers and only verdicts come back; the rows themselves stay in the JVM.
    """
    rules = order_rules(docs)

    @F.arrow_udf("boolean")
    def passes(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            kept: list[bool] = []
            for a in range(0, len(texts), TEXTS_AT_ONCE):
                kept += [not any(r.rejects(t) for r in rules) for t in map(Text, texts.slice(a, TEXTS_AT_ONCE).to_pylist())]
            yield pa.array(kept, pa.bool_())
            release_memory()

    return docs.where(passes(F.col("text").cast("string")))
