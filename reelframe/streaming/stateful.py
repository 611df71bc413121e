"""Operators on unbounded streams: framing elementary streams, re-blocking, decoding, interleaving, counts by window.

A stream's rows are taken in order of ``seq`` within a micro-batch, and a row that marks the stream's end ends it
there, wherever micro-batches are cut: what follows under the same key starts anew. What a task holds of a key is its
state and one micro-batch's rows, which the source's limits (such as ``maxFilesPerTrigger``) bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import merge

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows of one frame that goes back to Spark, and bytes of pieces that are split at once.
ROWS_AT_ONCE, BYTES_AT_ONCE = 4096, 1 << 20
#: Units in one list, and about the bytes of a list: Spark holds as many lists as rows before it sends them.
UNITS_A_LIST, BYTES_A_LIST = 64, 4096


def _grouped(rows: DataFrame, keys: list[str], run: Callable, output: str, state: str, timeout: str = GroupStateTimeout.NoTimeout) -> DataFrame:
    return rows.groupBy(*keys).applyInPandasWithState(run, output, state, "append", timeout)


def _in_order(batches: Iterator[pd.DataFrame], columns: list[str], order: list[str]) -> Iterator[tuple]:
    """Rows of a micro-batch by ``order``, as tuples of ``order`` and ``columns``; each frame is sorted, then they are merged."""
    frames = [b if len(order) == 1 and b[order[0]].is_monotonic_increasing else b.sort_values(order) for b in batches]
    rows = [zip(*(f[c].tolist() if f[c].dtype == object else f[c] for c in (*order, *columns))) for f in frames]
    return rows[0] if len(rows) == 1 else merge(*rows, key=lambda r: r[: len(order)])


def _out(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of rows as they come; one at least."""
    held, any_yet = [], False
    for row in rows:
        held.append(row)
        if len(held) == ROWS_AT_ONCE:
            yield pd.DataFrame(held, columns=columns)
            held, any_yet = [], True
    if held or not any_yet:
        yield pd.DataFrame(held, columns=columns)


def _stateful(rows: DataFrame, key: str, key_type: str, columns: list[str], fresh: tuple, step: Callable, output: list[tuple[str, str]], state_type: str) -> DataFrame:
    """``step(state, row) -> (state, outputs)`` over each key's rows; ``row`` are ``columns`` and whether the stream ends
    there. After an end the state is ``fresh`` again and nothing is kept of it."""
    names = [key, *(n for n, _ in output)]

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = {"state": tuple(state.get) if state.exists else fresh}

        def each():
            for row in _in_order(batches, [*columns, "eos"], ["seq"]):
                ended = bool(row[-1])
                held, found = step(last["state"], row[1:-1], ended)
                last["state"] = fresh if ended else held
                for f in found:
                    yield (k[0], *f)

        yield from _out(each(), names)
        if last["state"] != fresh:
            state.update(last["state"])
        elif state.exists:
            state.remove()

    return _grouped(rows, [key], run, f"{key} {key_type}, {', '.join(f'{n} {t}' for n, t in output)}", state_type)


def reblock(rows: DataFrame, key: str, frame_size: int, key_type: str = "string") -> DataFrame:
    """Frames of ``frame_size`` samples from ``rows(key, seq long, samples long, eos boolean)``.

    Emits ``(key, frame_no, samples)`` for each full frame, and the short rest when a row marks the stream's end.
    The state is two numbers a stream.
    """

    def step(state: tuple, row: tuple, ended: bool):
        frame, held = state[0], state[1] + int(row[0])
        full, rest = divmod(held, frame_size)
        out = [(frame + i, frame_size) for i in range(full)]
        return (frame + full, rest), out + ([(frame + full, rest)] if ended and rest else [])

    return _stateful(rows, key, key_type, ["samples"], (0, 0), step, [("frame_no", "long"), ("samples", "long")], "frame long, held long")


def sample_frames(rows: DataFrame, key: str, frame_size: int, planes: int, width: int, capacity: int | None = None, short: str = "emit", key_type: str = "string") -> DataFrame:
    """Frames ``(key, frame_no, samples, planes array<binary>)`` with their samples, from ``rows(key, seq long, samples
    long, planes array<binary>, eos boolean)``.

    ``width`` are the bytes of a sample in one plane (of all channels where they are interleaved). A packet whose
    planes are fewer than ``planes`` or hold fewer than its samples is an error, what they hold beyond is left out;
    more samples than ``capacity`` waiting is an overflow. The rest at a stream's end is a short frame, or with
    ``short="drop"`` left out, with ``short="fail"`` an underflow. The state is the rest of each plane.
    """
    if short not in ("emit", "drop", "fail"):
        raise ValueError(f"unknown way with a short frame {short!r}")

    def step(state: tuple, row: tuple, ended: bool):
        frame, held = state[0], [bytes(p) for p in state[1]] or [b""] * planes
        samples, data = int(row[0]), row[1] if row[1] is not None else []
        if samples and (len(data) < planes or any(p is None or len(p) < samples * width for p in list(data)[:planes])):
            raise ValueError(f"a packet of {samples} samples without their bytes in {planes} planes")
        if samples:
            held = [h + bytes(p)[: samples * width] for h, p in zip(held, data)]
        waiting, size = len(held[0]) // width, frame_size * width
        if capacity is not None and waiting > capacity:
            raise ValueError(f"{waiting} samples waiting where {capacity} may")
        full = waiting // frame_size
        out = [(frame + i, frame_size, [h[i * size : (i + 1) * size] for h in held]) for i in range(full)]
        held, rest = [h[full * size :] for h in held], waiting % frame_size
        if ended and rest and short == "fail":
            raise ValueError(f"{rest} samples at a stream's end where a frame has {frame_size}")
        if ended and rest and short == "emit":
            out.append((frame + full, rest, held))
        return (frame + full, held), out

    return _stateful(rows, key, key_type, ["samples", "planes"], (0, []), step, [("frame_no", "long"), ("samples", "long"), ("planes", "array<binary>")], "frame long, held array<binary>")


def pcm_stream(rows: DataFrame, key: str, codec: str, channels: int = 1, key_type: str = "string") -> DataFrame:
    """Native (little-endian) samples ``(key, packet_no, samples long, data binary)`` of a stream of PCM packets
    ``rows(key, seq long, data binary, eos boolean)`` that may be cut anywhere, inside a sample too.

    What is left of a sample waits for the next packet; at the end of the stream it is drained as it is, a packet of
    no whole sample. Encoding is the same exchange of bytes. The state is less than one sample of all channels.
    """
    from reelframe.operators.packets import PCM

    width, big = PCM[codec]
    step_bytes = width * channels

    def native(data: bytes) -> bytes:
        return b"".join(data[i : i + width][::-1] for i in range(0, len(data), width)) if big and width > 1 else data

    def step(state: tuple, row: tuple, ended: bool):
        number, data = state[0], bytes(state[1]) + bytes(row[0] or b"")
        whole = len(data) // step_bytes
        out = [(number, whole, native(data[: whole * step_bytes]))] if whole else []
        number, rest = number + bool(whole), data[whole * step_bytes :]
        return (number, rest), out + ([(number, 0, rest)] if ended and rest else [])

    return _stateful(rows, key, key_type, ["data"], (0, b""), step, [("packet_no", "long"), ("samples", "long"), ("data", "binary")], "packet long, rest binary")


def frame_stream(rows: DataFrame, key: str, split: Callable[[bytes], tuple[list[bytes], bytes]], key_type: str = "string") -> DataFrame:
    """Units of an elementary stream that arrives in pieces ``rows(key, seq long, data binary, eos boolean)``.

    ``split`` gives the whole units of what is there and the rest, which waits for what follows; at the end of
    the stream the rest is a unit too, if there is any. Emits ``(key, unit_no, unit)``. Pieces that follow one another
    in a micro-batch are split together, and units leave the task in lists.
    """
    names = [key, "__first", "__units"]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bytes, bool]]:
        """Bytes of neighbouring pieces, `BYTES_AT_ONCE` at most, and whether the stream ends after them."""
        held, size = [], 0
        for _, data, eos in _in_order(batches, ["data", "eos"], ["seq"]):
            data, ended = data or b"", bool(eos)
            if held and size + len(data) > BYTES_AT_ONCE:
                yield b"".join(held), False
                held, size = [], 0
            if len(data) > BYTES_AT_ONCE:
                cuts = [data[i : i + BYTES_AT_ONCE] for i in range(0, len(data), BYTES_AT_ONCE)]
                yield from ((c, False) for c in cuts[:-1])
                data = cuts[-1]
            held.append(data)
            size += len(data)
            if ended:
                yield b"".join(held), True
                held, size = [], 0
        if held:
            yield b"".join(held), False

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, rest = state.get if state.exists else (0, b"")
        rest, any_yet = bytes(rest), False
        for data, ended in whole(batches):
            units, rest = split(rest + data) if data else ([], rest)
            if ended and rest:
                units, rest = [*units, rest], b""
            if units:
                most = max(1, min(UNITS_A_LIST, BYTES_A_LIST * len(units) // max(1, sum(map(len, units)))))
                starts = range(0, len(units), most)
                yield pd.DataFrame({key: [k[0]] * len(starts), "__first": [number + i for i in starts], "__units": [units[i : i + most] for i in starts]})
                any_yet = True
            number = 0 if ended else number + len(units)
        if not any_yet:
            yield pd.DataFrame([], columns=names)
        if number or rest:
            state.update((number, rest))
        elif state.exists:
            state.remove()

    found = _grouped(rows, [key], run, f"{key} {key_type}, __first long, __units array<binary>", "number long, rest binary")
    return found.select(key, "__first", F.posexplode("__units").alias("__place", "unit")).select(key, (F.col("__first") + F.col("__place")).alias("unit_no"), "unit")


def interleave_stream(rows: DataFrame, key: str, ts: str, late: str, key_type: str = "string") -> DataFrame:
    """Packets of each file in the order a writer takes them, while they still arrive: ``(key, place, stream_index, seq,
    ts, data)`` from ``rows(key, stream_index int, seq long, ts timestamp, data binary, eos boolean)``.

    A packet waits until the watermark, ``late`` behind the latest time, has passed it, so all before it are there;
    then it leaves, of equal times by ``seq``. The end of a file, marked by a row, lets everything out. Places count
    from 1. Packets later than the watermark are left out by Spark. The state holds what waits.
    """
    names = [key, "place", "stream_index", "seq", "ts", "data"]

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, *held = state.get if state.exists else (0, [], [], [], [])
        waiting, ended = [(int(t), int(q), int(s), bytes(d)) for t, q, s, d in zip(*held)], False
        for t, q, s, d, eos in _in_order(batches, ["stream_index", "data", "eos"], [ts, "seq"]):
            ended |= bool(eos)
            waiting.append((t.value // 1000, int(q), int(s), bytes(d or b"")))
        waiting.sort(key=lambda w: w[:2])
        passed = state.getCurrentWatermarkMs() * 1000
        cut = len(waiting) if ended else next((i for i, w in enumerate(waiting) if w[0] > passed), len(waiting))
        yield from _out(((k[0], place + 1 + i, s, q, pd.Timestamp(t, unit="us"), d) for i, (t, q, s, d) in enumerate(waiting[:cut])), names)
        waiting = waiting[cut:]
        if ended or not (waiting or place + cut):
            state.remove()
            return
        state.update((place + cut, *(list(c) for c in (zip(*waiting) if waiting else ([],) * 4))))
        if waiting:  # looked at again when the watermark is past the first that waits
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, passed // 1000) + 1)

    marked = rows.withWatermark(ts, late)
    return _grouped(marked, [key], run, f"{key} {key_type}, place long, stream_index int, seq long, ts timestamp, data binary", "place long, times array<long>, seqs array<long>, streams array<int>, data array<binary>", GroupStateTimeout.EventTimeTimeout)


def annex_b_pieces(data: bytes) -> tuple[list[bytes], bytes]:
    """`split` for Annex B: units that are followed by another start code; the last waits with its start code."""
    from reelframe.functions.bits import annex_b_units

    last = data.rfind(b"\x00\x00\x01")
    if last < 0:
        return [], data[-2:] if len(data) > 2 else data
    return list(annex_b_units(data[:last] + b"\x00\x00\x01")), data[last:]


def windowed_counts(rows: DataFrame, ts: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Packets and units by tumbling window of event time; rows later than ``late`` behind are left out."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def drain(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Run a stream over everything there is now and write it as Parquet below ``folder``."""
    query = rows.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
