"""Every stage of the pipeline on its own input against brute force, and that its decisions take effect."""

import zlib

import numpy as np
import pytest
from test_llm_operators import ODD, SCHEMA, WORD, brute_masks, brute_similar, figures, water_fill
from tokenizers import Tokenizer

import corpus_pipeline
from reelframe.llm.cluster import settle, shared_dir
from reelframe.llm.tokens import public_vocabulary

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, folder, results = docs.columns, shared_dir(spark, "stages"), [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        results.append(settle(stage(spark, results[-1], SF), f"{folder}/{i}"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "mixing sources", "best-fit packing"]
    assert all(r.columns == columns for r in results[:-1])
    raw, good, single, cut, mixed, packed = ([r.asDict() for r in x.collect()] for x in results)

    def passes(text):
        n, chars, symbols, dup, repeat = figures(text)
        lines = (text or "").count("\n") + 1
        return n >= 20 and 100 * repeat <= 30 * n and 10 * symbols <= n and not (dup > 2 and 10 * dup > 3 * lines) and 2 * n <= chars <= 15 * n

    assert {d["doc_id"] for d in good} == {d["doc_id"] for d in raw if passes(d["text"])}
    assert {d["doc_id"]: d for d in good}.items() <= {d["doc_id"]: d for d in raw}.items()
    groups = brute_similar([(d["doc_id"], d["text"]) for d in good])
    assert {d["doc_id"] for d in single} == {d for d, name in groups if d == name}

    single.sort(key=lambda d: d["doc_id"])
    by_id = {d["doc_id"]: d for d in cut}
    for d, (data, gone) in zip(single, brute_masks([d["text"] for d in single], 200)):
        at, want = 0, []
        for c in d["text"]:  # a character goes if all its bytes do
            n = len(c.encode())
            if not gone[at : at + n].all():
                want.append(c)
            at += n
        after = by_id[d["doc_id"]]
        assert after["text"] == "".join(want) and after["n_chars"] == len(want) and (after["source"], after["lang"]) == (d["source"], d["lang"])

    sizes: dict = {}
    for d in cut:
        sizes[d["source"]] = sizes.get(d["source"], 0) + len(WORD.findall(d["text"]))
    taken = dict.fromkeys(sizes, 0)
    for d in mixed:
        taken[d["source"]] += len(WORD.findall(d["text"]))
    for s, t in water_fill(sizes).items():
        assert abs(taken[s] - t) <= 128

    library = Tokenizer.from_file(public_vocabulary("word_bpe_49k.json"))
    ids = [np.array([*library.encode(d["text"], add_special_tokens=False).ids, 1], "<u4").tobytes() for d in mixed]
    want = sorted(zlib.crc32(x[a : a + 16384]) for x in ids for a in range(0, len(x), 16384))
    assert sorted(p["ids_crc32"] for p in packed) == want
    total = sum(p["length"] for p in packed)
    assert len({p["sequence_id"] for p in packed}) == -(-total // 4096)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_and_empty_tables(spark, number):
    """Nulls in every column, empty and long texts, ties, repeated rows, and no rows at all."""
    name, stage = corpus_pipeline.STAGES[number]
    long = " ".join(f"w{i * 7919 % 99991}" for i in range(12_000))
    rows = [*ODD, (None, None, None, None, None), (None, None, None, None, None), (11, long, "en", "b", 1), (12, long, None, "b", None), (11, long, "en", "b", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for docs in (frame, frame.limit(0)):
        out = stage(spark, docs, SF)
        got = out.collect()
        assert number == 4 or out.columns == docs.columns
        assert bool(got) == bool(docs.count())
    kept = {r.doc_id for r in stage(spark, frame, SF).collect()}
    if name == "quality rules":
        assert kept == {11, 12}
    elif name == "simhash near-dedup":
        assert kept == {1, 2, 5, 6, None, 8, 11}
    else:
        assert 11 in kept
