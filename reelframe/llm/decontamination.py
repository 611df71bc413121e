"""Benchmark decontamination with a distributed positional inverted index of the training documents.

The index holds a posting (term, doc, pos) for each occurrence of a term that the benchmark uses, in segments that
are sorted by term. A phrase starts where the posting lists of its terms, each moved back by the term's place in the
phrase, agree: lists are intersected from the rarest term on, so the long ones are only read where the rare ones met.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.llm.cluster import settle, shared_dir

#: Words of a phrase; an item of fewer is one phrase.
PHRASE = 10
#: Rows of at most five numbers or words that may be broadcast, about 50 MB; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Letters and digits of ASCII, and all beyond it.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(_WORD), 0)


def _lower(word: Column) -> Column:
    """A-Z alone become small, whatever else has small letters too."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast what has been counted and is small enough, else leave the join to Spark."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


class Phrases:
    """The benchmark: its different word sequences (passages), the places of their terms, and who has which."""

    def __init__(self, benchmark: DataFrame, folder: str):
        words = F.transform(_words(F.col("text")), _lower)
        self.items = settle(benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words")).where(F.size("words") > 0), f"{folder}/items")
        self.passages = settle(self.items.select("words").distinct().select(F.monotonically_increasing_id().alias("passage"), "words"), f"{folder}/passages")
        spots = self.passages.select("passage", F.least(F.size("words"), F.lit(PHRASE)).alias("k"), F.size("words").alias("size"), F.posexplode("words").alias("j", "word"))
        self.terms = settle(spots.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), f"{folder}/terms")
        self.spots = settle(spots.join(self.terms, "word").select("passage", "k", "size", "j", "term"), f"{folder}/spots")

    def windows(self, counts: DataFrame) -> DataFrame:
        """``(passage, k, w, terms)`` of the phrases all of whose terms have postings: (n, j, term), rarest first."""
        at = self.spots.join(counts, "term").withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.expr("j - k + 1")), F.least("j", F.expr("size - k")))))
        found = at.groupBy("passage", "k", "w").agg(F.sort_array(F.collect_list(F.struct("n", "j", "term"))).alias("terms"))
        return found.where(F.size("terms") == F.col("k"))


def build_index(docs: DataFrame, phrases: Phrases, folder: str) -> DataFrame:
    """Postings ``(term, doc, pos)`` of the whole texts, and ``doc_id`` and ``n_words`` in one row a document.

    ``doc`` numbers the rows, so repeated rows and null ids stay apart. That row has ``n_words``, all others don't;
    it is the first word's posting, without a term if the benchmark hasn't the word or the text has none.
    """
    read = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", _words(F.col("text")).alias("words"))
    each = read.select("doc", "doc_id", F.size("words").cast("long").alias("size"), F.posexplode_outer("words").alias("pos", "raw"))
    head = F.coalesce("pos", F.lit(0)) == 0
    placed = each.withColumn("word", _lower(F.col("raw"))).join(_small(phrases.terms), "word", "left").where(head | F.col("term").isNotNull())
    only = {c: F.when(head, F.col(s)).alias(c) for c, s in (("doc_id", "doc_id"), ("n_words", "size"))}
    return settle(placed.select("term", "doc", "pos", *only.values()).sortWithinPartitions("term", "doc", "pos"), f"{folder}/index")


def term_counts(index: DataFrame, folder: str) -> DataFrame:
    return settle(index.where("term is not null").groupBy("term").agg(F.count("*").alias("n")), f"{folder}/counts")


def phrase_matches(index: DataFrame, phrases: Phrases, folder: str) -> DataFrame:
    """``(doc, passage, lo, hi)``: the words lo to hi of the document are a stretch of the passage, and at least a
    phrase long; stretches are as long as they can be.

    The rarest term's postings say where a phrase may lie (``shift``: the passage's start in the document), the
    second rarest term's list, moved alike, leaves few of them, and the lists of all others around decide.
    """
    lists, folder = index.where("term is not null").select("term", "doc", "pos"), f"{folder}/phrases"
    ranked = phrases.windows(term_counts(index, folder))
    pick = lambda i: (F.get("terms", F.lit(i))["term"].alias(f"t{i}"), F.get("terms", F.lit(i))["j"].alias(f"j{i}"))
    anchors = settle(ranked.select("passage", *pick(0), *pick(1)).distinct(), f"{folder}/anchors")
    first = lists.join(_small(anchors), F.col("term") == F.col("t0")).select("passage", "doc", F.expr("pos - j0").alias("shift"), "j0", "j1", "t1")
    seconds = _small(anchors.select(F.col("t1").alias("term")).where("t1 is not null").distinct())
    other = lists.join(seconds, "term", "left_semi").select(F.col("doc").alias("d"), F.col("term").alias("t"), F.col("pos").alias("p"))
    met = first.where("j1 is not null").join(other, F.expr("doc = d and t1 = t and shift + j1 = p"))
    kept = settle(met.select("passage", "doc", "shift", "j0").union(first.where("j1 is null").select("passage", "doc", "shift", "j0")).distinct(), f"{folder}/kept")
    around = kept.join(_small(phrases.spots), "passage").where(F.expr(f"abs(j - j0) < {PHRASE}")).select("passage", "k", "doc", "shift", "j", "term").distinct()
    near = lists.join(_small(settle(kept.select("doc").distinct(), f"{folder}/docs")), "doc", "left_semi").select(F.col("doc").alias("d"), F.col("term").alias("t"), F.col("pos").alias("p"))
    agree = around.join(near, F.expr("doc = d and term = t and shift + j = p"))
    island = F.expr("j - row_number() over (partition by doc, passage, shift order by j)")  # at most a passage's words
    runs = agree.withColumn("island", island).groupBy("doc", "passage", "shift", "island", "k").agg(F.min("j").alias("a"), F.max("j").alias("b"))
    return runs.where("b - a + 1 >= k").select("doc", "passage", F.expr("shift + a").alias("lo"), F.expr("shift + b").alias("hi"))


def proximity_matches(index: DataFrame, phrases: Phrases, folder: str, span: int) -> DataFrame:
    """``(doc, passage, w, pos)``: all different terms of the passage's phrase from ``w`` on stand, in any order,
    within ``span`` words of the document that hold the phrase's rarest term at ``pos``.

    Postings are joined by document, term and stretches of ``span`` words, so a document full of both terms costs
    its postings times the span, not their product.
    """
    lists, folder = index.where("term is not null").select("term", "doc", "pos"), f"{folder}/near"
    sought = phrases.windows(term_counts(index, folder)).select("passage", "w", F.get("terms", F.lit(0))["term"].alias("t0"), F.array_distinct(F.transform("terms", lambda t: t["term"])).alias("ts"))
    sought = settle(sought, f"{folder}/sought")
    pivots = lists.join(_small(sought), F.col("term") == F.col("t0")).select("passage", "w", "doc", F.col("pos").alias("p"), "t0", "ts")
    wanted = pivots.withColumn("t", F.explode("ts")).withColumn("cell", F.explode(F.expr(f"array(p div {span} - 1, p div {span}, p div {span} + 1)")))
    there = lists.select(F.col("doc").alias("d"), "term", "pos", F.expr(f"pos div {span}").alias("c"))
    met = wanted.join(there, F.expr(f"doc = d and t = term and cell = c and abs(pos - p) < {span} and (t <> t0 or pos = p)"))
    starts = met.withColumn("s", F.explode(F.sequence(F.greatest("p", "pos") - span + 1, F.least("p", "pos"))))
    full = starts.groupBy("doc", "passage", "w", "p", "s").agg(F.count_distinct("t").alias("n"), F.first(F.size("ts")).alias("size")).where("n = size")
    return full.select("doc", "passage", "w", F.col("p").alias("pos")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items array<string>, contaminated)`` of every document.

    A word is hit that lies in any occurrence of ten consecutive words of an item, or of a whole item that has fewer;
    ``items`` are the different ids of the items met, sorted as strings. Words are letters and digits of ASCII, A-Z
    made small, and all beyond ASCII. Null texts have no words and meet nothing; an item without a word is no phrase;
    of an item without id the words are hit but it isn't counted; repeated rows and null doc_ids each get a row; an
    empty benchmark leaves all clean; other columns are ignored.
    """
    folder = shared_dir(docs.sparkSession, "decontamination")
    phrases = Phrases(benchmark, folder)
    index = build_index(docs, phrases, folder)
    spans = settle(phrase_matches(index, phrases, folder), f"{folder}/spans")
    hits = spans.select("doc", F.explode(F.sequence("lo", "hi")).alias("pos")).distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    names = phrases.items.where("item_id is not null").join(phrases.passages, "words").select("passage", "item_id").distinct()
    met = spans.select("doc", "passage").distinct().join(names, "passage").select("doc", "item_id").distinct()
    items = met.groupBy("doc").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    heads = index.where("n_words is not null").select("doc", "doc_id", "n_words")
    whole = heads.join(hits, "doc", "left").join(items, "doc", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", F.expr("cast(array() as array<string>)"))})
    return whole.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))
