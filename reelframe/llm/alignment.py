"""Cross-tokenizer alignment: which tokens of two vocabularies overlap in a text, where both end at once, and in how
many documents of the corpus two ids meet.

Tables of token starts are joined by ``merge_asof`` in both directions, keyed by document. A block of documents keeps
its different id pairs once; only these meet the corpus-wide counts, so a link isn't shuffled but its block's pair.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.llm.cluster import release_memory, settle, shared_dir
from reelframe.llm.tokens import _LETTERS, _gather, _gather_runs, encoder

#: Bytes of texts whose tokens are laid side by side at once, and of texts that share a block's pairs. Longer texts
#: are taken alone. Both bound memory only.
BYTES_AT_ONCE, BYTES_IN_BLOCK = 500_000, 4_000_000
#: Words kept per worker and vocabulary; when reached, the table starts anew.
MAX_WORDS = 120_000
_SPACE = "▁"
#: No piece holds a space after another character, so a single space between two others starts pieces anew.
_SAFE_SPACE = re.compile("(?<=[^ ]) (?=[^ ])")
_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


class PieceEncoder:
    """Ids of a SentencePiece model for whole texts, with the ids of seen words kept."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("pieces of this model reach across spaces")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.max_words, self.seen = max_words, {}

    def _words(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.seen]
        if new:
            self.seen.update(zip(new, (np.array(ids, "<u4").tobytes() for ids in self.model.encode(new, num_threads=1))))
        return [self.seen[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, none of them null or empty, one text after another, and how many each has."""
        if len(self.seen) > self.max_words:
            self.seen = {}
        apart = pc.match_substring_regex(texts, "  |^ | \\z").to_numpy(zero_copy_only=False)
        parts: list = [None] * len(texts)
        even = np.flatnonzero(~apart)
        if len(even):
            lists = pc.split_pattern(texts.take(pa.array(even)), " ")
            words = lists.flatten().dictionary_encode()
            ids, ends = _gather(self._words(words.dictionary.to_pylist()), words.indices.to_numpy(zero_copy_only=False))
            edges = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])].tolist()
            for i, a, b in zip(even.tolist(), edges, edges[1:]):
                parts[i] = ids[a:b]
        for i in np.flatnonzero(apart).tolist():
            parts[i] = np.frombuffer(b"".join(self._words(_SAFE_SPACE.split(texts[i].as_py()))), "<u4")
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


class Vocabularies:
    """Both sides' encoders and what bytes their ids stand for."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = encoder(a_path, MAX_WORDS, True), PieceEncoder(b_path)
        letters = {letter: byte for byte, letter in _LETTERS.items()}
        names = sorted(self.a.library.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        a_bytes = [bytes(letters.get(ord(c), ord(c) & 255) for c in name) for name, _ in names]
        self.flat = [np.frombuffer(b"".join(x), "u1") for x in (a_bytes, self.b.bytes)]
        self.edges = [np.concatenate([[0], np.cumsum([len(t) for t in x])]) for x in (a_bytes, self.b.bytes)]

    def tokens(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, numbers of ids) of the texts, a space before each, by A and by B."""
        # after a letter and a space the text is encoded as after a space alone; the letter's id is taken off
        raw = self.a.encode(pc.binary_join_element_wise(pa.scalar("a", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4 - 1
        return [(np.frombuffer(b"".join(r[4:] for r in raw), "<u4"), sizes), self.b.encode(texts)]

    def spell(self, side: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens in a row, and where each begins and the last one ends."""
        return _gather_runs(self.flat[side], self.edges[side], ids)


_KNOWN: dict[tuple, Vocabularies] = {}


def _vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """This worker's encoders."""
    if (a_path, b_path) not in _KNOWN:
        _KNOWN[a_path, b_path] = Vocabularies(a_path, b_path)
    return _KNOWN[a_path, b_path]


def _spelled(both: Vocabularies, texts: pa.Array) -> tuple[np.ndarray, list]:
    """Which texts both sides spell byte for byte, and for these, per side, ids, numbers of ids and token starts."""
    wanted = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    sizes = pc.binary_length(wanted).to_numpy(zero_copy_only=False)
    data = np.frombuffer(b"".join(wanted.cast(pa.large_binary()).to_pylist()), "u1")
    sides = [(ids, counts, *both.spell(side, ids)) for side, (ids, counts) in enumerate(both.tokens(texts))]
    lengths = [np.diff(starts[np.cumsum(counts)], prepend=0) for _, counts, _, starts in sides]
    fits = (lengths[0] == sizes) & (lengths[1] == sizes)
    places, good = np.flatnonzero(fits), fits.copy()
    for (_, _, spelled, _), own in zip(sides, lengths):
        wrong = np.flatnonzero(spelled[np.repeat(fits, own)] != data[np.repeat(fits, sizes)])
        good[places[np.searchsorted(np.cumsum(sizes[fits]), wrong, side="right")]] = False
    out = []
    for side, (ids, counts, _, _) in enumerate(sides):
        ids = ids[np.repeat(good, counts)].astype(np.int64)
        out.append((ids, counts[good], np.concatenate([[0], np.cumsum(np.diff(both.edges[side])[ids])])[:-1]))
    return good, out


def _joined(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids).cast(pa.string())), ",")


def _align(both: Vocabularies, texts: pa.Array) -> tuple[dict[str, np.ndarray], pa.Array, np.ndarray, np.ndarray]:
    """Figures and groups of each text, none of them null or empty, then the different id pairs that each holds
    linked, text after text, and how many links each stands for; ``entries`` says how many pairs a text has."""
    good, ((a, n_a, a_at), (b, n_b, b_at)) = _spelled(both, texts)
    n = len(n_a)
    tables = [pd.DataFrame({"at": at, "doc": np.repeat(np.arange(n), counts), "token": np.arange(len(at))}) for at, counts in ((a_at, n_a), (b_at, n_b))]
    for t in tables:
        t["start"] = t["at"]
    by_a = pd.merge_asof(tables[0], tables[1], on="at", by="doc", suffixes=("", "_over"))
    by_b = pd.merge_asof(tables[1], tables[0], on="at", by="doc", suffixes=("", "_over"))
    # tokens leave no gaps: two end at once where the next two start at once
    a_opens, b_opens = ((t["start"] == t["start_over"]).to_numpy() for t in (by_a, by_b))
    docs = np.concatenate([by_a["doc"], by_b["doc"][~b_opens]])
    pairs = np.concatenate([a << 32 | b[by_a["token_over"]], a[by_b["token_over"][~b_opens]] << 32 | b[~b_opens]])
    groups = [pc.binary_join_element_wise(_joined(a, np.append(np.flatnonzero(a_opens), len(a))), _joined(b, np.append(np.flatnonzero(b_opens), len(b))), "|")]
    n_groups = np.bincount(by_a["doc"][a_opens], minlength=n)
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)]), pa.int32()), groups[0]), ";")
    codes, different = pd.factorize(pairs)
    held, times = np.unique(docs * max(1, len(different)) + codes, return_counts=True)
    of, codes = np.divmod(held, max(1, len(different)))
    figures = {k: np.zeros(len(texts), np.int64) for k in (*_FIGURES, "entries")}
    for k, v in zip(figures, (n_a, n_b, n_groups, np.bincount(docs, minlength=n), np.bincount(of, minlength=n))):
        figures[k][good] = v
    return figures, pc.fill_null(lines.take(pa.array(np.where(good, np.cumsum(good) - 1, 0), mask=~good)), ""), different[codes], times


def _blocks(both: Vocabularies, batches):
    """(doc_ids, figures, groups, pairs, times) of blocks of documents as they come in, with one entry a document."""
    ids, figures, groups, pairs, times, size = [], {k: [] for k in (*_FIGURES, "entries")}, [], [], [], 0
    for batch in batches:
        texts = batch.column(1)
        ends, a = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
        while a < len(texts):
            done = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + BYTES_AT_ONCE, side="right")))
            some = pc.fill_null(texts.slice(a, b - a).cast(pa.large_string()), "")
            full = pc.greater(pc.binary_length(some), 0).to_numpy(zero_copy_only=False)
            places = np.where(full, np.cumsum(full) - 1, 0)
            if full.any():
                found, lines, keys, counts = _align(both, some.filter(pa.array(full)))
                pairs.append(keys)
                times.append(counts)
                lines = pc.fill_null(lines.take(pa.array(places, mask=~full)), "")
            else:
                found, lines = {k: np.zeros(1, np.int64) for k in figures}, pa.array([""] * len(some))
            for k, v in found.items():
                figures[k].append(np.where(full, v[places], 0))
            ids.append(batch.column(0).slice(a, b - a))
            groups.append(lines)
            size, a = size + int(ends[b - 1]) - done, b
            if size >= BYTES_IN_BLOCK:
                yield ids, figures, groups, pairs, times
                release_memory()
                ids, figures, groups, pairs, times, size = [], {k: [] for k in figures}, [], [], [], 0
    if ids:
        yield ids, figures, groups, pairs, times


def align_documents(docs: DataFrame, a_path: str, b_path: str, keep: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` of each whole text, a space before it.

    A is a byte-level vocabulary of the ``tokenizers`` library, B a SentencePiece model with byte fallback; special
    strings are plain text. ``groups`` writes the least stretches at whose ends tokens of both end, as ``a1,a2|b1``
    joined by semicolons; ``keep`` makes of it what is to be kept. A link is a pair of tokens that share a byte. The
    count of two ids is the number of documents that hold them linked; ``n_best`` counts links whose ids have the
    highest count of their A id (ties included), ``count_sum`` adds the counts of all links. Null and empty texts,
    and texts that either side spells otherwise, have zeros and no groups; repeated rows and null ids each count and
    get a row; other columns are ignored; no rows give none.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    folder = shared_dir(spark, "alignment")
    held = f"doc_id: {kind}, {', '.join(f'{k}: bigint' for k in _FIGURES)}, entries: bigint, groups: string"
    schema = f"block long, docs array<struct<{held}>>, pairs array<struct<pair: bigint, docs: bigint>>, links binary"

    def read(batches):
        both, press = _vocabularies(a_path, b_path), zstandard.ZstdCompressor(level=1).compress
        for number, (ids, figures, groups, pairs, times) in enumerate(_blocks(both, batches)):
            codes, different = pd.factorize(np.concatenate([np.empty(0, np.int64), *pairs]))
            times = np.concatenate([np.empty(0, np.int64), *times])
            links = press(codes.astype("<i4").tobytes() + times.astype("<i4").tobytes())
            columns = [pa.concat_arrays(ids), *(pa.array(np.concatenate(v)) for v in figures.values()), pa.concat_arrays([g.cast(pa.string()) for g in groups])]
            row = pa.StructArray.from_arrays(columns, names=["doc_id", *figures, "groups"])
            met = pa.StructArray.from_arrays([pa.array(different), pa.array(np.bincount(codes, minlength=len(different)))], names=["pair", "docs"])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (row, met)]
            block = (TaskContext.get().partitionId() << 32) + number
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists, pa.array([links], pa.binary())], names=["block", "docs", "pairs", "links"])

    blocks = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(read, schema)
    blocks = settle(blocks.withColumn("docs", F.transform("docs", lambda d: d.withField("groups", keep(d["groups"])))), f"{folder}/blocks")
    met = blocks.select("block", F.posexplode("pairs").alias("place", "met")).select("block", "place", "met.*")
    counts = settle(met.groupBy("pair").agg(F.sum("docs").alias("n")), f"{folder}/counts").withColumn("a", F.shiftright("pair", 32))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # at most a row an id of A: bounded by the vocabulary
    counts = counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    known = met.select("block", "place", "pair").join(counts, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("counts"))

    def weigh(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                rows, codes = batch.column(0).slice(i, 1).flatten(), np.frombuffer(unpack(batch.column(1)[i].as_py()), "<i4").astype(np.int64)
                codes, times = codes[: len(codes) // 2], codes[len(codes) // 2 :]
                counts = batch.column(2).slice(i, 1).flatten()
                n, best = counts.field("n").to_numpy(zero_copy_only=False), counts.field("best").to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(rows.field("entries").to_numpy(zero_copy_only=False))])
                sums = [np.diff(np.concatenate([[0], np.cumsum(times * v[codes])])[ends]) for v in (best, n)]
                cols = {k: rows.field(k) for k in ("doc_id", *_FIGURES)} | {"n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64()), "groups": rows.field("groups")}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    whole = blocks.join(known, "block", "left").select("docs", "links", "counts")
    return whole.mapInArrow(weigh, f"doc_id {kind}, {', '.join(f'{k} long' for k in (*_FIGURES, 'n_best', 'count_sum'))}, groups string")
