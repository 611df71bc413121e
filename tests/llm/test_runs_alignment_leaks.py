"""Periodic runs, cross-tokenizer alignment and benchmark decontamination against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.llm import alignment, decontamination, queries, runs
from reelframe.llm.cluster import shared_dir
from reelframe.llm.tokens import public_vocabulary

SF = "/root/testdata/sf0.001"
WORD, LETTERS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A, B = public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model")
SMALL = {c: c + 32 for c in range(65, 91)}
ODD = [
    (1, "same words here and there"), (1, "same words here and there"), (2, None), (3, ""), (4, " \n\t "), (5, "<|endoftext|> it's  two  spaces\n\n\nend <s> </s> <unk>"), (6, "é́ ½ Ωμέγα \U0001f600 | ¦"),
    (None, "no id here"), (8, "long " * 9000 + "tail"), (9, "a ▁x"), (10, "▁"), (11, "  lead"), (12, "trail "), (13, "a\x00b 　 ﬁ"), (15, "\nx"), (16, "'s"), (17, "́ x"), (18, " "), (19, "x" * 3000),
    (20, "a b c " * 5 + "d"), (21, "a a a a a"), (22, "a a a a a a"), (23, "İ ABCÉ One,TWO;3"),
]
ODD = [(i and 5000 + i, text) for i, text in ODD]


@pytest.fixture(scope="module")
def both(spark):
    clash = {c: F.lit("clash") for c in ("runs", "block", "docs", "pairs", "links", "term", "pos", "doc", "words", "n_words", "groups")}
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd).repartition(3).withColumns(clash)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


# 11: runs


def slow_runs(words):
    """By the definition: every period, every stretch."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_small_sequences():
    rng = random.Random(1)
    for turn in range(3000):
        k = rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(k) for _ in range(rng.randrange(60))]
        if turn % 3 == 0:
            root = [rng.randrange(k) for _ in range(rng.randrange(1, 9))]
            words = words[:10] + (root * 8)[: rng.randrange(60)] + words[10:20]
        assert sorted(map(tuple, runs.find_runs(np.array(words, np.int32)).tolist())) == sorted(slow_runs(words))


def test_suffix_trees_and_long_runs():
    numbers = np.random.default_rng(5).integers(0, 3, 700)
    tree = runs.SuffixTree(numbers)
    for turned, values in ((False, numbers.tolist()), (True, (2 - numbers).tolist())):
        assert tree.order(turned).tolist() == sorted(range(700), key=lambda i: values[i:])
    a, b = np.random.default_rng(6).integers(0, 700, (2, 4000))
    a, b = a[a != b], b[a != b]
    common = lambda i, j: next((k for k in range(700) if max(i, j) + k == 700 or numbers[i + k] != numbers[j + k]), 0)
    assert tree.prepare().common(a, b).tolist() == [common(i, j) for i, j in zip(a.tolist(), b.tolist())]
    assert runs.find_runs(np.zeros(20_000, int)).tolist() == [[0, 20_000, 1]]
    assert runs.find_runs(np.tile(np.arange(997), 9)).tolist() == [[0, 8973, 997]]


def test_stretches_lose_no_run():
    rng = random.Random(3)
    for _ in range(100):
        texts = []
        for _ in range(20):
            words = [rng.randrange(30) for _ in range(rng.randrange(50))]
            for _ in range(rng.randrange(3)):
                root, at = [rng.randrange(30) for _ in range(rng.randrange(1, 9))], rng.randrange(len(words) + 1)
                words[at:at] = (root * 10)[: rng.randrange(4 * len(root), 9 * len(root) + 1)]
            texts.append(words)
        got = runs._runs_by_text(np.array([w for t in texts for w in t], np.int32), np.cumsum([len(t) for t in texts]))
        assert got == {i: slow_runs(t) for i, t in enumerate(texts) if slow_runs(t)}


def _planted(doc, words):
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_run_digest(both, empty, monkeypatch):
    want = []
    for r in both.collect():
        words = _planted(r.doc_id, WORD.findall(r.text or ""))
        found = slow_runs(words) if len(words) < 5000 else [(0, 9000, 1)]
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((r.doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))))
    assert _rows(runs.run_digest(both)) == sorted(want, key=str)
    monkeypatch.setattr(runs, "BYTES_AT_ONCE", 300)
    assert _rows(runs.run_digest(both)) == sorted(want, key=str) and runs.run_digest(empty).count() == 0
    plain = {r.doc_id: r for r in runs.periodic_runs(both.where("doc_id in (5020, 5021, 5022, 5004)")).collect()}
    assert [(x.start, x.length, x.period) for x in plain[5020].runs] == [(0, 15, 3)] and plain[5020].collapsed == "a b c d"
    assert not plain[5021].runs and plain[5022].collapsed == "a" and plain[5004].collapsed == ""


# 12: alignment


def _tokens(library, model, text):
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}
    a = [(i, bytes(letters[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(text)]
    return (a, b) if text and all(b"".join(x for _, x in side) == (" " + text).encode() for side in (a, b)) else None


def _spans(side):
    out, at = [], 0
    for i, piece in side:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def slow_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    library, model, out, counts = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), [], Counter()
    library.encode_special_tokens = True
    for doc, text in texts:
        sides = _tokens(library, model, text or "")
        if sides is None:
            out.append((doc, [], [], [], ""))
            continue
        (a, b), links, k = map(_spans, sides), [], 0
        for i, s, e in a:
            while b[k][2] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][1] < e:
                links.append((i, b[j][0]))
                j += 1
        ends, groups, x, y = sorted({e for *_, e in a} & {e for *_, e in b}), [], 0, 0
        for end in ends:
            x2, y2 = (next((n + 1 for n in range(at, len(side)) if side[n][2] == end)) for at, side in ((x, a), (y, b)))
            groups.append(",".join(str(t[0]) for t in a[x:x2]) + "|" + ",".join(str(t[0]) for t in b[y:y2]))
            x, y = x2, y2
        counts.update(set(links))
        out.append((doc, a, b, links, ";".join(groups)))
    top = {}
    for (i, _), n in counts.items():
        top[i] = max(top.get(i, 0), n)
    return sorted(((d, len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), g) for d, a, b, links, g in out), key=str)


def test_alignment(both, empty, monkeypatch):
    want = slow_alignment([(r.doc_id, r.text) for r in both.collect()])
    assert _rows(alignment.align_documents(both, A, B)) == want
    for at_once, block in ((500, 3000), (1, 1)):
        monkeypatch.setattr(alignment, "BYTES_AT_ONCE", at_once)
        monkeypatch.setattr(alignment, "BYTES_IN_BLOCK", block)
        some = both if block > 1 else both.where("doc_id > 5000")
        expected = want if block > 1 else slow_alignment([(r.doc_id, r.text) for r in some.collect()])
        assert _rows(alignment.align_documents(some, A, B)) == expected
    assert alignment.align_documents(empty, A, B).count() == 0
    zeros = [r for r in want if r[1] == 0]
    assert {5002, 5003, 5009, 5010} <= {r[0] for r in zeros} and all(r[1:] == (0, 0, 0, 0, 0, 0, "") for r in zeros)


# 13: decontamination


def _words(text):
    return LETTERS.findall((text or "").translate(SMALL))


def slow_leaks(docs, items):
    windows = {}
    for item, text in items:
        words = _words(text)
        k = min(10, len(words))
        for i in range(len(words) - k + 1) if k else ():
            windows.setdefault(tuple(words[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        words, hit, met = _words(text), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    met |= windows[tuple(words[i : i + k])]
        names = sorted(str(m) for m in met if m is not None)
        out.append((doc, len(words), len(hit), len(names), names, bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1000, "Same WORDS"), (1001, "x"), (1002, None), (1003, " ,. "), (1004, "here and there"), (1004, "tail"), (None, "no id"), (1005, "long " * 12), (1006, "one two 3"), (1007, "abcÉ"), (1000, "Same WORDS")]
    return spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame(rows, "item_id long, text string")).withColumn("term", F.lit("clash"))


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination(spark, both, items, empty, limit, monkeypatch):
    """With everything small broadcast and with everything shuffled."""
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    docs = both.union(both.where("doc_id = 7").withColumn("doc_id", F.lit(99).cast("long")))
    want = slow_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = _rows(decontamination.contamination(docs, items))
    assert got == want and any(r[5] for r in want) and not all(r[5] for r in want)
    assert {r[0]: (r[2], r[3]) for r in got if r[0] is None} == {None: (2, 0)}
    if limit:
        assert decontamination.contamination(empty, items).count() == 0
        clean = decontamination.contamination(docs, items.limit(0)).collect()
        assert len(clean) == docs.count() and not any(r.contaminated for r in clean)


def test_proximity(spark):
    """All terms of a phrase within so many words, in any order, against every stretch of every document."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(40)))) for i in range(30)]
    benchmark = [(1, "a b c"), (2, "f e f d"), (3, "j"), (4, "a b c d e f g h i j a b")]
    folder = shared_dir(spark, "near-test")
    phrases = decontamination.Phrases(spark.createDataFrame(benchmark, "item_id long, text string"), folder)
    index = decontamination.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), phrases, folder)
    ids = {r.doc: r.doc_id for r in index.where("n_words is not null").collect()}
    names = {r.passage: tuple(r.words) for r in phrases.passages.collect()}
    counts = Counter(w for _, t in docs for w in t.split())
    terms = {r.term: r.word for r in phrases.terms.collect()}
    for span in (4, 12):
        got = {(ids[r.doc], names[r.passage], r.w, r.pos) for r in decontamination.proximity_matches(index, phrases, f"{folder}/{span}", span).collect()}
        want, order = set(), {w: t for t, w in terms.items()}
        for doc, text in docs:
            words = text.split()
            for _, phrase in benchmark:
                p = phrase.split()
                k = min(10, len(p))
                for w in range(len(p) - k + 1):
                    window = p[w : w + k]
                    # the rarest term: least count, then first place in the passage
                    rare = min(range(k), key=lambda i: (counts[window[i]], w + i, order[window[i]]))
                    for s in range(1 - span, len(words)):
                        part = set(words[max(s, 0) : s + span])
                        if part >= set(window):
                            want |= {(doc, tuple(p), w, x) for x in range(max(s, 0), min(s + span, len(words))) if words[x] == window[rare]}
        assert got == want and want


def test_queries_are_registered():
    assert {"op11_periodic_runs", "op12_tokenizer_alignment", "op13_benchmark_decontamination"} <= set(queries.queries())
    assert {"op11_periodic_runs", "op13_benchmark_decontamination"} <= set(queries.oracle_sql())
