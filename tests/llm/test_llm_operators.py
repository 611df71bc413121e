"""Each operator against brute force and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelframe.llm import chat, embeddup, mixing, packing, quality, queries, sharding, simhash, suffix, tokenbin, warc
from reelframe.llm.cluster import components, lean, shared_dir
from reelframe.llm.tokens import WordEncoder, public_vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Odd rows: null and empty texts, white space alone, control strings, a repeated row, a null id and source.
ODD = [
    (1, "same words here and there", "en", "b", 25), (1, "same words here and there", "en", "b", 25), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", "a", 4),
    (5, "<|endoftext|> it's  two  spaces\n\n\nend ", "en", "a", 3), (6, "é́ ½ Ωμέγα \U0001f600 | ¦", "el", "é", 9), (None, "no id but words", "en", None, 15), (7, "same words here and there", "en", "b", 25),
    (8, "long " * 9000 + "tail", "en", "b", 45004),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    extra = {c: F.lit("clash") for c in ("size", "h", "fp", "kept", "epoch", "runs", "length", "bucket", "node", "words")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 90), (7, 3), (100, 90)], "a long, b long")
    got = {r.id: r.root for r in components(edges, "test").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90}
    assert components(edges.limit(0), "none").count() == 0


def test_idle_workers_hand_memory_back(spark):
    """A task that frees all but the last of many objects, in a worker that goes on afterwards."""

    def anonymous_mb():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) / 1024 for x in f if x.startswith("Pss_Anon:"))

    def probe(batches):
        held = []

        def task(inner):
            for _ in inner:
                many = [bytes(600) for _ in range(200_000)]
                held.append(many[-1])
                yield anonymous_mb()

        for _ in batches:
            began = anonymous_mb()
            (full,) = lean(task)(iter([0]))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (began, full, anonymous_mb())], names=["began", "full", "after"])

    (r,) = spark.range(1).coalesce(1).mapInArrow(probe, "began double, full double, after double").collect()
    assert r.full - r.began > 90 and r.after - r.began < 30


#: Every kind of white space, controls, combining and cased letters, numbers, marks, and strings of special tokens.
ATOMS = [" ", " ", " ", " ", "\n", "\n", "  ", "\n\n", "a", "B", "the", "word", "Straße", "\u00e9", "e\u0301", "\u0301", "\u03a3", "\u0130", "\u01c5", "1", "\u00bd", "\u00b2", "\u0663", "\u6f22", "\ud55c", "\u1112\u1161", "'s", "'", "\u2019s", "n't", "|", ".", "...", "!?", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", ";", "\u212a", "\x00", "\x7f", "\u00aa", "\u00d7", "\U0001f600", "\ufb01"]
ATOMS += [chr(c) for c in (*range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_agrees_with_the_library(docs, name):
    """Over 100,000 texts a vocabulary against an untouched library object, and with special strings as text."""
    import random

    rng = random.Random(11)
    plain, as_text = Tokenizer.from_file(public_vocabulary(name)), Tokenizer.from_file(public_vocabulary(name))
    as_text.encode_special_tokens = True
    fixed = [r.text for r in docs.select("text").collect()] + [r[1] for r in ODD] + ["a  b", "\nx", "x\n y", "x \ny", "a|b | |", "they've\u0085we'll", "\u0391\u03a3", "word,word. (x) it's 'tis", "\u00a0\u00a0x\n\u00a0\u00a0y", "a\x1cb", "", None, "x" * 300, "\n", " "]
    for library, e in ((plain, WordEncoder(public_vocabulary(name))), (as_text, WordEncoder(public_vocabulary(name), max_words=5000, specials_as_text=True))):
        for turn in range(26):
            texts = fixed if not turn else ["".join(rng.choices(ATOMS if i % 2 else ATOMS[:42], k=rng.randrange(14))) for i in range(4000)]
            want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            assert e.encode(texts) == want
        assert e.encode(fixed) == e.encode(fixed) and e.encode([]) == []


# 1: packing


def test_bounds_and_best_fit():
    rng = np.random.default_rng(3)
    for cap in (10, 64):
        for _ in range(60):
            x = rng.integers(1, cap + 1, rng.integers(1, 40))
            where, offset = packing.best_fit_decreasing(x, cap)
            sizes, counts = np.unique(x, return_counts=True)
            bound = packing.sequence_bound(sizes, counts, cap)
            assert bound <= where.max() + 1 and bound >= -(-x.sum() // cap)
            for b in range(where.max() + 1):
                at = sorted(zip(offset[where == b], x[where == b]))
                assert [a for a, _ in at] == [sum(n for _, n in at[:i]) for i in range(len(at))] and sum(n for _, n in at) <= cap
    assert packing.sequence_bound(np.array([6]), np.array([5]), 10) == 5  # over half each
    assert packing.sequence_bound(np.array([4]), np.array([5]), 10) == 3


def test_packing_meets_its_bound(spark, docs, odd, empty, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 40)
    vocabulary = public_vocabulary("word_bpe_49k.json")
    for frame, capacity in ((docs, 4096), (odd, 1024)):
        placed = packing.pack_documents(frame, vocabulary, capacity).toPandas()
        total = placed["length"].sum()
        sums = placed.groupby("sequence_id")["length"].sum()
        assert sums.max() <= capacity and len(sums) <= -(-total // capacity) + 1  # tasks are tiny here
        ordered = placed.sort_values(["sequence_id", "offset"])
        assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    e = WordEncoder(vocabulary)
    ids = np.frombuffer(e.encode([ODD[-1][1]])[0] + np.array([1], "<u4").tobytes(), "<u4")
    long = placed[placed.doc_id == 8].sort_values("piece")
    assert long["length"].tolist() == [1024] * (len(ids) // 1024) + [len(ids) % 1024]
    assert long["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + 1024].tobytes()) for a in range(0, len(ids), 1024)]
    assert placed[placed.doc_id.isin([2, 3])]["length"].tolist() == [1, 1] and len(placed[placed.doc_id == 1]) == 2
    assert packing.pack_documents(empty, vocabulary).count() == 0


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing_query_against_the_library(spark, docs, odd, capacity):
    """Every piece's ids, order and place from an untouched library object."""
    vocabulary = public_vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(vocabulary)
    spaced = spark.createDataFrame([(21, "a\x1cb\x1fc"), (22, "x <|startoftext|> y"), (23, "\u00a0\u2003z")], "doc_id long, text string")
    for frame in (docs, odd, spaced):
        want = []
        for r in frame.select("doc_id", "text").collect():
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
            want += [(r.doc_id, i, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for i, a in enumerate(range(0, len(ids), capacity))]
        placed = packing.pack_documents(frame, vocabulary, capacity).collect()
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed), key=str) == sorted(want, key=str)
        held = {}
        for r in placed:
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in held.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= capacity


def test_packing_stops_without_gain(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 20)
    rows = [(i, 0, 0, n, i) for i, n in enumerate([60, 41, 41, 30, 29, 25] * 40)]
    placed = packing.pack(spark.createDataFrame(rows, packing.PIECES), 100).toPandas()
    sizes, counts = np.unique([r[3] for r in rows], return_counts=True)
    assert len(placed) == len(rows) and placed.groupby("sequence_id")["length"].sum().max() <= 100
    assert placed["sequence_id"].nunique() <= packing.sequence_bound(sizes, counts, 100) * 1.1


def test_packed_sequences(spark, docs):
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).limit(30)
    vocabulary = public_vocabulary("word_bpe_49k.json")
    placed = packing.pack_documents(some, vocabulary, 256)
    whole = {r.sequence_id: r.ids for r in packing.sequences(some, placed, vocabulary).collect()}
    for r in placed.collect():
        ids = np.array(whole[r.sequence_id][r.offset : r.offset + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32


# 2: quality


def figures(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_figures(spark, odd, empty):
    texts = ["a b c d e f g h " * 4, "x\nx\n\nx\ny", "# $ % & | < > *", "é" * 9, "a b c d e f g h a b c d e f g h"] + [r[1] for r in ODD if r[1] is None or len(r[1]) < 999]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.apply_rules(frame, figures=True).collect()}
    for i, t in enumerate(texts):
        n = figures(t)
        assert tuple(got[i][m] for m in quality.MEASURES) == n
        assert got[i].base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
    assert quality.apply_rules(odd, figures=True).count() == len(ODD) and quality.apply_rules(empty, figures=True).count() == 0


def test_quality_order_never_changes_a_verdict(spark, docs, odd):
    runs = [{r.doc_id: r.kept for r in quality.apply_rules(docs, rules).collect()} for rules in (quality.RULES, quality.RULES[::-1], None)]
    assert runs[0] == runs[1] == runs[2]
    assert quality.keep_good(spark, odd).columns == odd.columns
    kept = quality.keep_good(spark, docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, v in runs[0].items() if v}


def test_cheap_selective_rules_come_first(spark):
    import time

    frame = spark.createDataFrame([(i, "word " * 30) for i in range(64)], "doc_id long, text string")
    slow = quality.Rule("slow", lambda t: time.sleep(0.002) or True)
    never, good = quality.Rule("never", lambda t: False), quality.Rule("good", lambda t: True)
    assert [r.name for r in quality.order_rules(frame, [never, slow, good])] == ["good", "slow", "never"]


def python_traffic(frame, folder):
    """Bytes sent to Python workers and back while ``frame`` is written."""
    store = frame.sparkSession._jsparkSession.sharedState().statusStore()
    known = store.executionsCount()
    frame.write.parquet(folder)
    frame.sparkSession.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total = {"data sent to Python workers": 0.0, "data returned from Python workers": 0.0}
    runs = store.executionsList()
    for at in range(known, runs.size()):
        values = store.executionMetrics(runs.apply(at).executionId())
        for m in (runs.apply(at).metrics().apply(k) for k in range(runs.apply(at).metrics().size())):
            if m.name() in total and values.contains(m.accumulatorId()):
                number, unit = re.search(r"([\d.]+) (B|[KMG]iB)", values.apply(m.accumulatorId())).groups()
                total[m.name()] += float(number) * {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}[unit]
    return tuple(total.values())


def test_quality_sends_texts_once_and_gets_verdicts(spark, docs):
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    sent, returned = python_traffic(quality.keep_good(spark, docs), shared_dir(spark, "traffic"))
    assert size <= sent < 1.3 * size and 0 < returned < size / 20


# 3: sharding


def test_sharding(spark, docs, odd, empty):
    for frame in (docs, odd):
        rows = sharding.shard_rows(frame, 8).toPandas()
        sizes = rows.groupby("shard")["slot"].agg(["count", "max"])
        assert len(rows) == frame.count() and (sizes["count"] == sizes["max"] + 1).all() and sizes["count"].max() - sizes["count"].min() <= 1
    assert sharding.shard_rows(empty).count() == 0
    one, two, other = ([tuple(r) for r in sharding.shard_rows(docs, 4, seed=s).orderBy("shard", "slot").select("doc_id").collect()] for s in (1, 1, 2))
    assert one == two != other
    # a shard's files are read in shuffled order: within a bucket's run the slots ascend
    folder = shared_dir(spark, "order")
    sharding.write_shards(docs, folder, 2, bucket_bytes=1 << 30)
    for shard in range(2):
        slots = [r.slot for r in spark.read.parquet(f"{folder}/shard={shard}").coalesce(1).collect()]
        assert slots == sorted(slots)
    for frame in (docs, odd):  # the query's columns from the texts alone
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}-query/documents.parquet")
        got = sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in queries.op3_sharding(spark, f"{folder}-query").collect()), key=str)
        want = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), "rows", None) for r in frame.select("doc_id", "text").collect()]
        assert got == sorted(want, key=str)
    small = sharding.shuffle_rows(docs, bucket_bytes=2000).select("position").toPandas()["position"]
    assert sorted(small) == list(range(docs.count()))


def test_sharding_shuffles_texts_once(spark, docs):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = sharding.shuffle_rows(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


# 4: WARC


def test_archives(spark):
    pages = [(1, "http://a", "x" * 5000), (2, None, None), (3, "http://b c\n", ""), (4, "u", "x" * 5000), (5, "u", "é\r\n\r\n0\r\n"), (5, "u", "é\r\n\r\n0\r\n"), (9, "u", "<b>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = sorted(tuple(r) for r in warc.archive_digest(frame, segment_bytes=300).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for p, _, t in sorted(pages, key=lambda p: p[0]):
        first.setdefault(t or "", p)
    want = sorted((p, len((t or "").encode()), sha(t), "response" if first[t or ""] == p else "revisit", None if first[t or ""] == p else first[t or ""]) for p, _, t in pages)
    assert got == want
    assert sum(r[3] == "revisit" for r in warc.archive_digest(frame, min_bytes=100).collect()) == 1
    assert warc.archive_digest(frame.limit(0)).count() == 0


def test_archives_with_repeated_and_null_ids(spark):
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    for n in (50, 5000):  # below and above a segment
        a, b, c, d = ("abcd"[i] * n for i in range(4))
        # equal rows with the smallest id; an id with several payloads, one of them a copy; null ids alike and not
        pages = [(1, a), (1, a), (2, a), (2, a), (2, b), (2, c), (3, c), (None, a), (None, b), (None, d), (None, d), (None, "x" + d), (-4, c + c)]
        frame = spark.createDataFrame([(p, "u", t) for p, t in pages], "page_id long, url string, html string")
        first = {}
        for p, t in pages:
            first[t] = min((q for q, u in pages if u == t and q is not None), default=None)
        want = [(p, len(t), sha(t), "response" if p == first[t] else "revisit", None if p == first[t] else first[t]) for p, t in pages]
        assert sorted(map(tuple, warc.archive_digest(frame, segment_bytes=300).collect()), key=str) == sorted(want, key=str)


def test_files_of_lost_attempts_do_not_count(spark):
    import glob
    import shutil

    folder = shared_dir(spark, "attempts")
    warc.write_archives(spark.createDataFrame([(1, "u", "y")], "page_id long, url string, html string"), folder)
    (name,) = glob.glob(folder.removeprefix("file://") + "/*.warc.gz")
    shutil.copy(name, name.replace(".warc.gz", "-lost.warc.gz"))
    assert warc.read_segments(spark, folder).count() == 1


def test_damaged_segments(spark):
    frame = spark.createDataFrame([(1, "u", "y" * 4000)], "page_id long, url string, html string")
    folder = shared_dir(spark, "damaged")
    warc.write_archives(frame, folder, segment_bytes=300)
    segments = warc.read_segments(spark, folder)
    again = warc.reassemble(segments.union(segments.where("segment = 3"))).collect()
    assert len(again) == 1 and bytes(again[0].payload) == b"y" * 4000
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassemble(segments.where("segment is null or segment <> 3")).collect()
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nab")
    assert warc.dechunk(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"


# 5: chat


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "<|im_end|>"), (1, 1, "assistant", "a<\\|b<|im_start|>assistant\n"), (1, 1, "assistant", "a<\\|b<|im_start|>assistant\n"), (2, 5, None, None), (2, None, "odd\n%0Arole", "<"), (3, 1, "assistant", "é\n"), (3, 0, "system", "\\<\\\\|"), (None, 0, "assistant", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash"))
    got = {r.conv_id: r for r in chat.conversation_digest(frame).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        mine = sorted(((t if t is not None else -1), role or "", text or "") for c, t, role, text in turns if c == conv)
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()
        loss = "".join(b for _, a, b in mine if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digest(frame.limit(0)).count() == 0


def test_chat_parts(spark):
    part = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "i.png", 1000, 500, None, None), None, ("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 3)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {part}")
    r = chat.format_conversations(frame).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|document|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.turn_no, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "i.png", 85 + 2 * 170), (1, "audio", "a.wav", 38), (1, "document", "d.pdf", 1800)]
    assert r.expanded_tokens == 85 + 340 + 38 + 1800 and [m is None for m in r.loss_mask] == [True, False]


# 6: mixing


def test_permutation(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
        assert sorted(got) == list(range(n)) and (n < 97 or got != list(range(n)))


def water_fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing(spark, docs, odd, empty):
    for frame in (docs, odd):
        rows = frame.select("doc_id", "source", "text").collect()
        sizes = {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
        target = water_fill(sizes)
        got = mixing.mix_counts(frame).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_counts(frame).collect()), key=str)
        source = {r.doc_id: r.source for r in rows}
        taken = dict.fromkeys(sizes, 0)
        assert len(got) == len(rows)
        for r in got:
            assert r.taken <= 3 * r.size and r.source_size == sizes[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6
            taken[source[r.doc_id]] += r.taken
        for s in sizes:
            assert abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS
    assert mixing.mix_counts(empty).count() == 0


def test_mixed_documents(spark, docs):
    counts = {r.doc_id: r.taken for r in mixing.mix_counts(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words, texts = dict.fromkeys(counts, 0), {r.doc_id: WORD.findall(r.text or "") for r in docs.collect()}
    for r in mixed.collect():
        mine = WORD.findall(r.text)
        words[r.doc_id] += len(mine)
        assert set(mine) <= set(texts[r.doc_id]) and r.n_chars == len(r.text)
    assert words == counts


def test_mixed_documents_with_repeated_and_null_ids(spark, odd, empty):
    # every word names the row it is from, but for two wholly equal rows
    sizes = [300, 900, 40, 500, 700, 128, 350, 200, 60, 450]
    ids = [1, 1, 1, None, None, None, 2, 2, 3, 4]
    rows = [(d, " ".join(f"r{i}_{k}" for k in range(n)), "en", "ab"[i % 2], 0) for i, (d, n) in enumerate(zip(ids, sizes))]
    rows += [(5, " ".join(f"twin_{k}" for k in range(250)), "en", "a", 0)] * 2
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    mixed = mixing.mixed_documents(frame).collect()
    owner = {w: (d, source) for d, text, _, source, _ in rows for w in text.split()}
    seen, taken = {}, {"a": 0, "b": 0}
    for r in mixed:
        mine = r.text.split()
        names = {w.split("_")[0] for w in mine}
        places = [int(w.split("_")[1]) for w in mine]
        assert len(names) == 1 and places == sorted(set(places)) and {owner[w] for w in mine} == {(r.doc_id, r.source)} and r.n_chars == len(r.text)
        taken[r.source] += len(mine)
        for w in mine:
            seen[w] = seen.get(w, 0) + 1
    target = water_fill({s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in taken})
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS for s in taken)
    assert all(n <= mixing.MAX_REPEATS * (2 if w.startswith("twin") else 1) for w, n in seen.items())
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in mixing.mix_counts(odd).collect())
    assert mixing.mixed_documents(empty).count() == 0


# 7: repeats


def brute_masks(texts, span):
    """Per text its bytes and which of them go."""
    data, seen = [(t or "").encode() for t in texts], {}
    for b in data:
        for i in range(len(b) - span + 1):
            seen[b[i : i + span]] = seen.get(b[i : i + span], 0) + 1
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = True
        yield b, gone


def brute_cut(texts, span):
    return [(len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])) for b, gone in brute_masks(texts, span)]


def test_suffix_array():
    import random

    rng = random.Random(1)
    for _ in range(1500):
        x = [rng.randrange(rng.choice([1, 2, 4, 30])) for _ in range(rng.randrange(40))] * rng.choice([1, 1, 3])
        assert suffix.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("block", [64, 2])
def test_repeats_against_brute_force(spark, block, monkeypatch):
    import random

    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(suffix, "DIGESTS_PER_GROUP", 4)
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    base, passage = letters(900), letters(230)
    texts = [base, base, base[:300] + "X" + base[301:], base[100:350], letters(199), None, "", "a" * 450, passage, letters(150) + "é" * 120 + letters(40)]
    texts += [letters(90) + passage[rng.randrange(20) :] + letters(60) for _ in range(12)] + [base[k : k + 260] + letters(50) for k in range(0, 500, 60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.cut_documents(frame).collect()}
    assert [got[i] for i in range(len(texts))] == brute_cut(texts, 200)


def test_repeats_on_odd_rows(spark, odd, empty):
    rows = suffix.cut_documents(odd).collect()
    want = brute_cut([r[1] for r in ODD], 200)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in rows) == sorted(w[:3] for w in want)
    assert suffix.cut_documents(empty).count() == 0
    out = suffix.without_repeats(spark, odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    twice = spark.createDataFrame([(9, "repeat me " * 30), (9, "repeat me " * 30)], "doc_id long, text string")
    assert [r.n_removed for r in suffix.cut_documents(twice).collect()] == [300, 300]
    stretched = suffix.text_contexts(bytes(range(256)) * 4500, 200)
    assert stretched[3].max() == 256 * 4500 - 200 and (np.diff(stretched[2]) > 0).all()


def test_cut_text_stays_valid(spark):
    import random

    rng = random.Random(4)
    shared = "".join(rng.choice("éèüß€") for _ in range(130))
    texts = ["intro " + shared + " one", "other " + shared + " two"]
    out = suffix.without_repeats(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert all(shared[:60] not in r.text and r.text.startswith(t[:5]) for r, t in zip(out, texts))


# 8: token shards


def test_wavelet_matrix():
    rng = np.random.default_rng(8)
    for ids in (np.zeros(0, np.uint32), np.array([5], np.uint32), rng.integers(0, 70000, 3000).astype(np.uint32), np.minimum(rng.zipf(1.3, 3000), 900).astype(np.uint32)):
        shard = tokenbin.Shard(tokenbin.build_shard([1, None], [len(ids), 0], ids))
        assert (shard.all_ids() == ids).all() and shard.doc_ids == [1, None]
        for i in rng.integers(0, max(1, len(ids)), 40 if len(ids) else 0).tolist():
            token = int(ids[i])
            at = np.flatnonzero(ids == token)
            assert shard.access(i) == token and shard.count(token) == len(at) and shard.count(token, i) == int((at < i).sum())
            j = int(rng.integers(len(at)))
            assert shard.find(token, j) == at[j]
        assert shard.count(1 << 20) == 0
    with pytest.raises(ValueError):
        tokenbin.Shard(b"nothing like it")


def test_token_shards(spark, docs, odd, empty):
    vocabulary = public_vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(vocabulary)
    spaced = spark.createDataFrame([(1, "\u00a0\u00a0if x:\n\u00a0\u00a0 y"), (2, "a\x1cb <|endoftext|>"), (3, "x\x1f \u2003")], "doc_id long, text string")
    for frame in (docs, odd, spaced):
        rows = sorted(frame.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        ids = [np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in rows]
        starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
        want = sorted(zip([r.doc_id for r in rows], starts, map(len, ids), [zlib.crc32(x.tobytes()) for x in ids]), key=str)
        assert sorted(map(tuple, tokenbin.token_digest(frame, vocabulary).collect()), key=str) == want
    assert tokenbin.token_digest(empty, vocabulary).count() == 0


# 9: embeddings


def brute_vectors(rows, threshold=0.98):
    links = {r[0]: set() for r in rows}
    ok = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    for i, (a, v, x) in enumerate(rows):
        for b, w, y in rows[:i]:
            if x is not None and x == y and ok(v) and ok(w) and len(v) == len(w):
                p, q = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = {}
    for r in links:
        seen, todo = {r}, [r]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out[r] = (len(links[r]), min(seen))
    return out


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "TREE_SIZE", 24)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.16])).tolist() for i in range(150)]
    rows = [(i, v, int(i % 12 > 8)) for i, v in enumerate(vectors)]
    rows += [(200 + i, vectors[3], 0) for i in range(30)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [float("inf")] + [1.0] * 15, 0), (304, vectors[0], None), (305, [2 * x for x in vectors[5]], 0), (306, [None] + [1.0] * 15, 0), (307, [1.0, 2.0], 0), (308, [], 0), (309, [-x for x in vectors[3]], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddup.near_duplicates(frame).collect()}
    assert got == brute_vectors(rows)
    assert embeddup.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_with_null_and_repeated_ids(spark):
    a, b, c = [1.0, 0.01], [1.0, 0.0], [0.0, 1.0]
    rows = [(None, a, 0), (5, b, 0), (3, b, 0), (3, c, 0), (None, c, 1), (None, [0.01, 1.0], 1), (None, None, 0)]
    got = sorted(map(tuple, embeddup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).select("vec_id", "label", "n_links", "component_id").collect()), key=str)
    assert got == sorted([(None, "0", 2, 3), (5, "0", 2, 3), (3, "0", 2, 3), (3, "0", 0, 3), (None, "1", 1, None), (None, "1", 1, None), (None, "0", 0, None)], key=str)


def test_cover_tree_invariants():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(120, 8))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    tree = embeddup.CoverTree(p)
    assert sorted(tree.centres[-1].tolist()) == list(range(120))
    i, j = embeddup.near_pairs(tree, tree, 0.5)
    apart = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert {(a, b) for a, b in zip(i, j) if apart[a, b] <= 0.5} == set(zip(*np.nonzero(apart <= 0.5)))


# 10: SimHash


def test_gray_order_index():
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(4)]]))
    left = fps[np.argsort(simhash.gray_rank(fps), kind="stable")]
    i, j = simhash.near_pairs(left, left, 2)
    near = np.bitwise_count(left[:, None] ^ left[None]) <= 2
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))
    order = np.sort(simhash.gray_rank(np.arange(16, dtype=np.uint64)))
    assert order.tolist() == list(range(16))


def brute_simhash(rows, most=2):
    import xxhash

    def fingerprint(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not w:
            return 0
        g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if bin(f[i] ^ f[j]).count("1") <= most and group[i] != group[j]:
                    low, high = sorted((group[i], group[j]))
                    group = [low if g == high else g for g in group]
        break
    names = [min((rows[j][0] for j in range(len(rows)) if group[j] == g and rows[j][0] is not None), default=None) for g in group]
    return sorted(((d, f"{x:016x}", n) for (d, _), x, n in zip(rows, f, names)), key=str)


@pytest.mark.parametrize("node,pack", [(256, 1024), (4, 3)])
def test_simhash_against_brute_force(spark, docs, odd, empty, node, pack, monkeypatch):
    monkeypatch.setattr(simhash, "PACK_SIZE", pack)
    for frame in (docs, odd):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        monkeypatch.setattr(simhash.link_fingerprints, "__defaults__", (2, node))
        got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(frame).select("doc_id", simhash.hex_of(F.col("fp")).alias("fp"), "component_id").collect()), key=str)
        assert got == brute_simhash(rows)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(spark, odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, 6, None, 8}


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_similar(rows, similarity=0.8):
    """(doc_id, smallest doc_id reachable) over pairs of this Jaccard similarity; texts without words are alike."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            common = len(x & y)
            if common >= similarity * (len(x) + len(y) - common) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    names: dict = {}
    for g, (d, _) in zip(group, rows):
        names[g] = min((x for x in (names.get(g), d) if x is not None), default=None)
    return sorted(((d, names[g]) for g, (d, _) in zip(group, rows)), key=str)


def edited_texts(seed, groups, copies):
    """Groups of edited copies of one text, at every similarity, and texts of their own."""
    import random

    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([20, 60, 200, 600]))]
        for _ in range(copies):
            edited = base[:]
            for _ in range(rng.randrange(1 + len(base) // 30)):
                edited[rng.randrange(len(edited))] = word()
            texts.append(" ".join(edited))
    return texts + [" ".join(word() for _ in range(rng.randrange(1, 90))) for _ in range(60)]


@pytest.mark.parametrize("pack,node", [(1024, 64), (3, 4)])
def test_similar_documents(spark, docs, odd, empty, pack, node, monkeypatch):
    monkeypatch.setattr(simhash, "PACK_SIZE", pack)
    monkeypatch.setattr(simhash, "WIDE_NODE_SIZE", node)
    planted = spark.createDataFrame(list(enumerate(edited_texts(3, 8, 14))), "doc_id long, text string")
    for frame in (planted, docs, odd):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        got = sorted(map(tuple, simhash.similar_documents(frame).collect()), key=str)
        want = brute_similar(rows)
        assert [d for d, _ in got] == [d for d, _ in want]
        assert sum(g != w for g, w in zip(got, want)) <= len(rows) // 100  # candidates miss few; nothing else may differ
    assert simhash.similar_documents(empty).count() == 0 and simhash.keep_one(spark, empty).count() == 0


def test_packs_follow_gray_order(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PACK_SIZE", 16)
    rng = np.random.default_rng(12)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 64, 100, dtype=np.uint64), np.uint64(5 << 60) | rng.integers(0, 1 << 40, 300, dtype=np.uint64)]))
    frame = spark.createDataFrame([(0, x) for x in fps.view(np.int64).tolist()], "table int, view long")
    packs = simhash.gray_packs(frame, 4, []).collect()
    seen = []
    for p in packs:
        views = np.frombuffer(p.views, "<u8")
        rank = simhash.gray_rank(views)
        assert len(views) <= 16 and (rank[1:] > rank[:-1]).all() and set((views >> np.uint64(60)).tolist()) == {p.node}
        shared, bits = (np.array(x, np.int64).view(np.uint64) for x in (p.shared, p.bits))
        assert ((views & shared) == bits).all()
        seen += [(int(rank[0]), int(rank[-1]))]
    seen.sort()
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:])) and sum(len(p.views) // 8 for p in packs) == len(fps)


def test_every_candidate_is_decided(spark):
    """Pairs above the threshold among many just below it, and families of copies edited to every similarity."""
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    texts, pairs = [], []
    for _ in range(3):
        one = [word() for _ in range(400)]
        other = [word() if i in range(10, 82, 9) else w for i, w in enumerate(one)]
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(one), " ".join(other)]
        for base in (one, other):
            for _ in range(40):
                changed = {5 * k - 8 for k in rng.sample(range(20, 80), 9)}
                texts.append(" ".join(word() if i in changed else w for i, w in enumerate(base)))
    for _ in range(15):
        base = [word() for _ in range(rng.randrange(60, 300))]
        for _ in range(15):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    got = dict(map(tuple, simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    want = dict(brute_similar(list(enumerate(texts))))
    assert all(want[b] == a for a, b in pairs)
    assert got == want


def test_rows_of_a_group_do_not_grow_with_its_square(spark, tmp_path, monkeypatch):
    """Near fingerprints that fill many packs, dealt over tasks that grow with them: four times the group, about four times
    the rows listed."""
    lean, made = simhash.lean, {}

    def counting(task):
        rows = made[size]

        def run(batches):
            for batch in task(batches):
                rows.add(batch.num_rows)
                yield batch

        return lean(run if task.__name__ == "compare" else task)

    monkeypatch.setattr(simhash, "lean", counting)
    monkeypatch.setattr(simhash, "PACK_SIZE", 16)
    monkeypatch.setattr(simhash, "WIDE_NODE_SIZE", 4096)  # one node a table
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "2k"}
    before = {k: spark.conf.get(k) for k in settings}
    rng = np.random.default_rng(29)
    bits = np.repeat(rng.integers(0, 2, (1, 256), dtype=np.uint8), 512, 0) ^ (rng.random((512, 256)) < 0.07)
    wide = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for size in (128, 512):
            spark.conf.set("spark.sql.shuffle.partitions", size // 8)
            made[size] = spark.sparkContext.accumulator(0)
            rows = [(i, wide[i].tobytes(), i, -1, -1) for i in range(size)]
            frame = spark.createDataFrame(rows, "id long, wide binary, grp long, apart long, after long")
            found = simhash.candidate_links(frame, f"file://{tmp_path}/{size}", simhash._differing_share(0.8), 4).collect()
            assert {r.a for r in found} == set(range(size))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert made[512].value < 6 * made[128].value, {k: v.value for k, v in made.items()}


def test_rows_without_ids_spread(spark, tmp_path):
    """Rows that all lack a doc_id, or share one, go to many buckets, shards and stripes."""
    texts = [" ".join(f"w{i}x{k}" for k in range(50)) for i in range(400)]
    for doc in (None, 7):
        frame = spark.createDataFrame([(doc, t, "en", "a", 1) for t in texts], SCHEMA)
        placed = sharding.shuffle_rows(frame, bucket_bytes=4000)
        assert sorted(r.position for r in placed.collect()) == list(range(400))
        assert {r.text for r in placed.collect()} == set(texts)
        folder = shared_dir(spark, "spread")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        manifest = tokenbin.write_shards(frame, folder, public_vocabulary("byte_bpe_50k.json"), 2)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert manifest.count() >= 3 and manifest.agg(F.sum("n_docs")).first()[0] == 400
        digest = tokenbin.read_shards(manifest, folder).collect()
        starts = sorted((r.start, r.n_tokens) for r in digest)
        assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(400)]
        counts = mixing.mix_counts(frame).collect()
        assert len(counts) == 400 and sum(r.taken for r in counts) > 0
