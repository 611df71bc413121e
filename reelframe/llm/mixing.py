"""Mixing sources to target weights by fixed-length blocks, on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.llm.cluster import settle, shared_dir

#: Words of a block.
BLOCK_WORDS = 128
#: Slots of an output shard, a block each.
SHARD_SLOTS = 4_096
#: Rows of a source whose sizes are summed in one task.
ROWS_PER_STRIPE = 2_000
#: Slots filled by one task.
SLOTS_PER_TASK = 65_536
#: Rounds of the index permutation.
ROUNDS = 24
WEIGHTS = (5, 2, 1)
#: A source is taken so many times at most.
MAX_REPEATS = 3
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text between ASCII white space; null: 0."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    spaces = F.char_length(trimmed) - F.char_length(F.replace(trimmed, F.lit(" "), F.lit("")))
    edges = trimmed.startswith(" ").cast("int") + trimmed.endswith(" ").cast("int")
    return F.when(F.trim(trimmed) == "", 0).otherwise(spaces + 1 - edges).cast("long")


def _uniform(*cols) -> Column:
    """A long from 0 to 2^53 - 1 that follows from the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11)


def permute(index: Column, count: Column, *key) -> Column:
    """Place of ``index`` under a pseudorandom permutation of 0 .. count - 1, chosen by ``key``.

    In each round a number k of 0 .. count - 1 pairs every place x with (k - x) mod count; a hash of the pair
    decides whether the two change places. So any count is served without tables or retries.
    """
    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("k"), r, *key), count) - x, count)
        swap = F.xxhash64(F.lit("s"), r, F.greatest(x, other), *key).bitwiseAND(1) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, turn)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of ``sizes(source, source_size)``: ``(source, source_size, rank, weight, target)``.

    Sources in order of code points, null last, weigh 5, 2, 1 and so on around; they share the sum of all sizes
    by weight, but none beyond `MAX_REPEATS` times its size, and what is above goes to the others by weight.
    Filling is solved in one pass: with sources by cap per weight, a source is at its cap as long as an equal
    level for it and all after it would be above. One row a source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MAX_REPEATS))
    everyone = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everyone)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    settled = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "rank", "level"))).over(everyone)["level"]
    return levels.withColumn("target", F.when(settled.isNull(), F.col("cap")).otherwise(F.least("cap", settled * F.col("weight")))).select("source", "source_size", "rank", "weight", "target")


def lay_out(docs: DataFrame, folder: str, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Lay every document's words on its source's line: ``(doc_id, row, rank, size, at)`` and the sources.

    The order on the line is by hash. A source is summed in stripes that follow its number of rows, so a source
    with a third of all rows is summed by many tasks; rows without an id, or with the same, are dealt to stripes by their text.
    ``row`` is the column of ``docs`` so named, null without one.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("h"), (F.col(row) if row else F.lit(None)).cast("long").alias("row"))
    rows = settle(rows, f"{folder}/sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = settle(source_targets(sources.select("source", "source_size")).join(sources.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), f"{folder}/sources")
    keyed = rows.join(targets.select(F.col("source").alias("s"), "rank", "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    keyed = keyed.withColumn("stripe", F.pmod(F.xxhash64(F.lit("stripe"), "doc_id", "h"), F.ceil(F.col("rows") / ROWS_PER_STRIPE)))
    sums = keyed.groupBy("rank", "stripe").agg(F.sum("size").alias("n"))
    stripes = Window.partitionBy("rank").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rank", "stripe", F.coalesce(F.sum("n").over(stripes), F.lit(0)).alias("before"))
    within = Window.partitionBy("rank", "stripe").orderBy(F.xxhash64(F.lit("line"), "doc_id"), "doc_id", "size", "h", "row")
    run = keyed.withColumn("inside", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    line = run.join(starts, ["rank", "stripe"]).select("doc_id", "row", "rank", "size", (F.col("before") + F.col("inside")).alias("at"))
    return settle(line, f"{folder}/line"), targets


def draw_slots(targets: DataFrame, folder: str, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """Which block fills each slot: ``(rank, block, epoch, shard, slot_no)``.

    A source's slots in all are its target in blocks. Each shard draws its slots' sources multinomially by
    hashed uniform numbers; where the draws of all shards miss a source's slots in all, the surplus slots of
    the last shards go to the sources that fall short. A source's k-th slot takes index k mod blocks under that
    epoch's permutation.
    """
    blocks = F.ceil(F.col("source_size") / block_words)
    plan = targets.where("source_size > 0").select("rank", blocks.cast("long").alias("blocks"), F.round(F.col("target") * blocks / F.col("source_size")).cast("long").alias("slots"))
    edge = Window.orderBy("rank")
    plan = plan.withColumn("low", F.sum("slots").over(edge) - F.col("slots")).withColumn("all", F.sum("slots").over(Window.partitionBy()))
    plan = settle(plan.where("slots > 0"), f"{folder}/plan")
    total = plan.agg(F.max("all")).first()[0] or 0
    shards = -(-total // shard_slots)
    # one row a slot, and the sources' lower edges in each shard; the last edge below a draw names its source
    draws = plan.sparkSession.range(total).select((F.col("id") / shard_slots).cast("long").alias("shard"), F.pmod(_uniform(F.lit(seed), "id"), F.lit(max(1, total))).alias("u"), F.lit(None).cast("int").alias("edge_of"))
    edges = plan.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.col("low").alias("u"), F.col("rank").alias("edge_of")) if shards else draws.limit(0)
    seen = Window.partitionBy("shard").orderBy("u", F.col("edge_of").asc_nulls_last())
    drawn = edges.unionByName(draws).withColumn("rank", F.last("edge_of", True).over(seen)).where("edge_of is null")
    counts = drawn.groupBy("shard", "rank").agg(F.count("*").alias("n"))
    by_source = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.join(plan.select("rank", "slots"), "rank").withColumn("before", F.coalesce(F.sum("n").over(by_source), F.lit(0)))
    counts = settle(counts.withColumn("keep", F.greatest(F.lit(0), F.least(F.col("n"), F.col("slots") - F.col("before")))), f"{folder}/counts")
    freed = counts.where("n > keep").groupBy("shard").agg(F.sum(F.col("n") - F.col("keep")).alias("free"))
    freed = freed.select("shard", F.explode(F.expr("sequence(0L, free - 1)")).alias("i")).withColumn("place", F.row_number().over(Window.orderBy("shard", "i")))
    short = plan.select("rank", "slots").join(counts.groupBy("rank").agg(F.sum("keep").alias("have")), "rank", "left").withColumn("lack", F.col("slots") - F.coalesce("have", F.lit(0))).where("lack > 0")
    short = short.select("rank", F.explode(F.expr("sequence(0L, lack - 1)")).alias("i")).withColumn("place", F.row_number().over(Window.orderBy("rank", "i")))
    filled = counts.select("shard", "rank", F.col("keep").alias("n")).unionByName(freed.join(short, "place").groupBy("shard", "rank").agg(F.count("*").alias("n")))
    final = filled.groupBy("shard", "rank").agg(F.sum("n").alias("n")).where("n > 0").withColumn("from", F.coalesce(F.sum("n").over(by_source), F.lit(0)))
    # few rows become many here, so they are dealt to tasks by the slots they become
    spread = final.repartition(max(1, -(-total // SLOTS_PER_TASK)), "shard", "rank")
    slots = spread.select("shard", "rank", F.explode(F.expr("sequence(`from`, `from` + n - 1)")).alias("k")).join(plan.select("rank", "blocks"), "rank")
    epoch = (F.col("k") / F.col("blocks")).cast("long")
    slots = slots.withColumn("epoch", epoch).withColumn("block", permute(F.pmod("k", "blocks"), F.col("blocks"), F.lit(seed), F.col("rank"), F.col("epoch")))
    return slots.select("rank", "block", "epoch", "shard", F.pmod(F.xxhash64(F.lit(seed), "rank", "k"), F.lit(1 << 40)).alias("slot_no"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7, row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mix ``docs(doc_id, source, text)``; returns the documents' line, the sources, and the drawn pieces.

    Pieces ``(doc_id, row, rank, at, size, epoch, block, shard, slot_no, first, words)``: words ``first`` (from 0)
    to ``first + words`` of the document stand in that block of that shard. Empty texts take no place; null
    sources are a source; repeated rows are each laid out. ``row`` names a column that tells rows apart, if there
    is one. No rows give none.
    """
    folder = shared_dir(docs.sparkSession, "mixing")
    line, targets = lay_out(docs, folder, row)
    slots = settle(draw_slots(targets, folder, block_words, shard_slots, seed), f"{folder}/slots")
    spans = line.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})")))
    first = F.greatest(F.lit(0), F.col("block") * block_words - F.col("at"))
    last = F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("at"))
    spans = spans.withColumn("first", first).withColumn("words", last - first)
    return line, targets, spans.join(slots, ["rank", "block"])


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """Per document of the mix: ``(doc_id, size, source_size, target, taken)``."""
    line, targets, pieces = mix(docs, **options)
    # a document's place on its source's line is its own; one without words has no place and takes none
    taken = pieces.groupBy(F.col("rank").alias("its_rank"), F.col("at").alias("its_at")).agg(F.sum("words").alias("taken"))
    rows = line.join(taken, (F.col("rank") == F.col("its_rank")) & (F.col("at") == F.col("its_at")) & (F.col("size") > 0), "left").select("doc_id", "rank", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    return rows.join(targets.select("rank", "source_size", "target"), "rank").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row per row of ``docs`` and epoch with the words drawn, other columns unchanged.

    ``text`` keeps the white space before each drawn word but the first; ``n_chars``, if there, is its length.
    Rows are numbered as they are written down once, so repeated and null ``doc_id`` are rows like any other.
    """
    numbered = settle(docs.withColumn("__row", F.monotonically_increasing_id()), f"{shared_dir(docs.sparkSession, 'mixing')}/rows")
    _, _, pieces = mix(numbered, row="__row", **options)
    runs = F.array_sort(F.collect_list(F.struct("first", "words")))
    drawn = pieces.groupBy("row", "epoch").agg(runs.alias("__runs"), (F.sum("words") == F.first("size")).alias("__all")).select(F.col("row").alias("__drawn"), "__runs", "__all")
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{_WORD}"), 0)
    joined = numbered.join(drawn, F.col("__row") == F.col("__drawn"))
    # only a document of which words are missing is taken apart
    some = F.transform(F.array(words), lambda w: F.array_join(F.transform("__runs", lambda r: F.array_join(F.slice(w, r["first"].cast("int") + 1, r["words"].cast("int")), "")), ""))[0]
    text = F.when(F.col("__all"), F.col("text")).otherwise(some)
    out = joined.withColumn("text", F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
