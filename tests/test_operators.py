"""Timelines, seeking, containers and streams on small known inputs."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from reelframe.functions.timebase import rational
from reelframe.operators import packets, seek, timeline
from reelframe.sources import mp4, mp4_index, mux, register, wav
from reelframe.streaming import stateful


def test_sample_table(spark):
    samples = spark.createDataFrame([(1, 1, 100, 10), (1, 2, 200, 10), (1, 3, 150, 20)], "t int, sample_no long, size long, duration long")
    chunks = spark.createDataFrame([(1, 1, 1000)], "t int, chunk long, offset long")
    runs = spark.createDataFrame([(1, 1, 3)], "t int, first_chunk long, per_chunk long")
    sync = spark.createDataFrame([(1, 1), (1, 3)], "t int, sample_no long")
    rows = timeline.sample_table(chunks, runs, samples, ["t"], sync).orderBy("sample_no").collect()
    assert [(r.offset, r.pts, r.is_sync) for r in rows] == [(1000, 0, True), (1100, 10, False), (1300, 20, True)]
    assert all(r.is_sync for r in timeline.sample_table(chunks, runs, samples, ["t"], sync.limit(0)).collect())


def test_run_lengths(spark):
    rows = spark.createDataFrame([(1, i, d) for i, d in enumerate((1024, 1024, 512, 1024))], "t int, i int, d long")
    runs = timeline.run_lengths(rows, ["t"], ["i"], "d")
    assert [(r["count"], r.d) for r in runs.orderBy("run").collect()] == [(2, 1024), (1, 512), (1, 1024)]
    totals = spark.createDataFrame([(1, 6), (2, 2)], "t int, total long")
    back = timeline.expand_runs(runs, ["t"], "d", totals).orderBy("t", "sample_no").collect()
    assert [r.d for r in back] == [1024, 1024, 512, 1024, 1024, 1024, 1, 1]
    assert timeline.expand_runs(runs, ["t"], "d", spark.createDataFrame([(1, 3)], "t int, total long")).count() == 3


def test_seek(spark):
    index = spark.createDataFrame([(1, i, t, 5000 * i, 10, i % 2 == 0) for i, t in enumerate(range(0, 5000, 1000))], "f int, seq long, timestamp long, pos long, size long, keyframe boolean")
    targets = spark.createDataFrame([(1, 0, 2000), (1, 1, 1500), (1, 2, 3000), (1, 3, -5)], "f int, target_id long, timestamp long")
    found = lambda **o: [r.entry and r.entry.timestamp for r in seek.find(targets, index, ["f"], **o).orderBy("target_id").collect()]
    assert found() == [2000, 1000, 3000, 0] and found(keyframe_only=True) == [2000, 0, 2000, 0]
    places = spark.createDataFrame([(1, 0, 12000), (1, 1, -1)], "f int, target_id long, pos long")
    assert [r.entry and r.entry.pos for r in seek.find_by_pos(places, index, ["f"]).orderBy("target_id").collect()] == [10000, None]


def test_interleave(spark):
    rows = spark.createDataFrame([("f", 1, 300, None, 1000), ("f", 2, 100, None, 1000), ("f", 3, None, None, 1000), ("f", 4, 48000, None, 48000), ("f", 5, None, 2000, 1000)], "path string, seq long, dts long, pts long, den int").withColumn("time_base", rational(1, F.col("den")))
    assert [r.seq for r in timeline.interleave(rows, ["path"], "seq").orderBy("place").collect()] == [2, 1, 4, 5, 3]


def test_packets(spark):
    p = spark.createDataFrame([(500, 490, 33, None)], "pts long, dts long, duration long, x string").withColumn("time_base", rational(1, 1000))
    r = packets.rescale_packets(p, rational(1, 1_000_000)).first()
    assert (r.pts, r.dts, r.duration) == (500000, 490000, 33000)
    registry = packets.default_registry()
    with pytest.raises(NotImplementedError):
        registry.decoder("h264")(F.lit(b""))
    with pytest.raises(LookupError):
        registry.encoder("h264")
    first = registry.decoder("pcm_u8")
    registry.register("pcm_u8", lambda c: None)
    assert registry.decoder("pcm_u8") is first


def test_wav_round_trip(spark, tmp_path):
    register(spark)
    payload = bytes(i % 256 for i in range(400))
    row = [("a.wav", 0, 0, None, None, 44100, 2, "pcm_s16le", None, payload), ("b.wav", 0, 0, None, None, 8000, 1, "pcm_u8", None, b"x" * 9001)]
    spark.createDataFrame(row, wav.SCHEMA).repartition("path").sortWithinPartitions("path", "seq").write.format("wav").mode("append").save(f"file://{tmp_path}/w")
    rows = spark.read.format("wav").load(f"file://{tmp_path}/w").orderBy("path", "seq").collect()
    assert bytes(rows[0].data) == payload and rows[0].duration == 100
    assert [(r.pts, r.duration) for r in rows[1:]] == [(0, 4096), (4096, 4096), (8192, 809)]
    cut = spark.read.format("wav").option("bytesPerPartition", "1000").load(f"file://{tmp_path}/w")
    assert cut.orderBy("path", "seq").collect() == rows and cut.rdd.getNumPartitions() == 11
    part = spark.read.format("wav").option("since", 0.6).option("until", 1.03).option("bytesPerPartition", "1000").load(f"file://{tmp_path}/w")
    assert [(r.path[-5:], r.seq) for r in part.orderBy("path", "seq").collect()] == [("b.wav", 1), ("b.wav", 2)]
    light = spark.read.format("wav").option("payload", "false").load(f"file://{tmp_path}/w")
    assert light.where("data is not null").count() == 0 and light.count() == 4


def test_wav_headers():
    import io

    with pytest.raises(ValueError, match="missing fmt"):
        wav.read_header(io.BytesIO(b"RIFF\0\0\0\0WAVEdata\0\0\0\0"))
    with pytest.raises(ValueError, match="not a WAV"):
        wav.read_header(io.BytesIO(b"RIFF\0\0\0\0AVI "))
    h = wav.read_header(io.BytesIO(wav.wav_bytes("pcm_f32le", 2, 48000, b"")))
    assert (h.codec, h.align, h.size) == ("pcm_f32le", 8, 0)


def test_mp4_round_trip(spark, tmp_path):
    register(spark)
    rows = [("m.mp4", s, i, None, None, d, 44100 if s else 90000, "aac" if s else "h264", s == 1 or i % 2 == 0, None, 44100, 2, 1280, 720, bytes([s, i]) * (50 + i)) for i, d in enumerate((1024, 1024, 512)) for s in (0, 1)]
    spark.createDataFrame(rows, mp4.SCHEMA).coalesce(1).write.format("mp4").mode("append").save(f"file://{tmp_path}/m")
    back = spark.read.format("mp4").load(f"file://{tmp_path}/m").orderBy("stream_index", "seq").collect()
    assert [bytes(r.data) for r in back] == [r[-1] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert [r.pts for r in back] == [0, 1024, 2048] * 2 and [r.keyframe for r in back] == [True, False, True] + [True] * 3
    assert (back[0].width, back[0].height, back[3].channels, back[3].sample_rate) == (1280, 720, 2, 44100)


def test_mp4_boxes():
    wide = b"\0\0\0\x01free" + (24).to_bytes(8, "big") + b"x" * 8
    assert [(b[2], b[5], b[6]) for b in mp4.walk_boxes(wide)] == [("free", 16, 8)]
    assert [(b[2], b[6]) for b in mp4.walk_boxes(b"\0\0\0\0mdat" + b"y" * 5)] == [("mdat", 5)]
    assert mp4.duration_runs([1024, 1024, 512]) == [(2, 1024), (1, 512)]
    with pytest.raises(ValueError, match="no track"):
        mp4.read_tracks(mp4.box(b"moov"))


def test_stateful_framing(spark, tmp_path):
    pieces = [("a", 0, b"\0\0\1\x67\x42", False), ("a", 1, b"\x00\0\0\1\x68", False), ("a", 2, b"\x01\x02", True)]
    spark.createDataFrame(pieces, "k string, seq long, data binary, eos boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, seq long, data binary, eos boolean").parquet(f"{tmp_path}/in")
    stateful.drain(stateful.frame_stream(stream, "k", stateful.annex_b_pieces), f"{tmp_path}/o")
    got = [bytes(r.unit) for r in spark.read.parquet(f"{tmp_path}/o/out").orderBy("unit_no").collect()]
    assert got == [b"\x67\x42", b"\0\0\1\x68\x01\x02"]


def test_transcode_and_concealment(spark):
    p = spark.createDataFrame([("f", 0, 1, b"\x01\x02"), ("f", 7, 2, b"zz")], "path string, stream_index int, seq long, data binary")
    streams = spark.createDataFrame([("f", 0, "pcm_s16be")], "path string, index int, codec_id string")
    out = packets.transcode(p, streams, {"pcm_s16be": "pcm_s16le"}).collect()
    assert [(r.seq, bytes(r.data), r.codec_id) for r in out] == [(1, b"\x02\x01", "pcm_s16le")]
    rows = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, None)], "k int, i int, v double")
    assert [r.v for r in timeline.conceal(rows, ["k"], ["i"], ["v"]).orderBy("i").collect()] == [None, 5.0, 5.0]


def test_chunks_without_runs(spark):
    """Without runs, and before the first run, a chunk holds one sample."""
    chunks = spark.createDataFrame([(t, c, 100 * c) for t in (1, 2) for c in (1, 2, 3)], "track long, chunk long, offset long")
    runs = spark.createDataFrame([(1, 3, 2)], "track long, first_chunk int, per_chunk int")
    got = sorted((r.track, r.chunk, r.per_chunk) for r in timeline.chunk_runs(chunks, runs, ["track"]).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 2, 1), (2, 3, 1)]


def test_previous_across_stretches(spark):
    rows = spark.createDataFrame([(k, t) for k in ("a", "b", None) for t in (0, 5, 9, 31, 32, 95)], "k string, t long")
    got = sorted(((r.k or "", r.t, r["__before"].t if r["__before"] else None) for r in timeline.with_previous(rows, ["k"], ["t"], F.floor(F.col("t") / 10), ["t"]).collect()), key=str)
    assert got == sorted(((k, t, b) for k in ("a", "b", "") for t, b in ((0, None), (5, 0), (9, 5), (31, 9), (32, 31), (95, 32))), key=str)


def test_reset_and_new_streams(spark):
    row = spark.range(1).select(packets.new_stream(F.lit(3), packets.video_parameters(F.lit("h264"), F.lit(0), F.lit(1), "skip")).alias("s"), packets.codec_parameters().alias("p"), packets.reset_frame(packets.new_audio_frame(F.lit(8000), F.lit(1), F.lit(4))).alias("f")).first()
    assert row.s.parameters is None and row.s["index"] == 3 and not any(row.s.disposition) and (row.p.codec_id, row.p.media_type, row.p.width) == ("none", "video", 0)
    assert row.f.samples == 4 and row.f.planes == [None] * 8
    fresh = packets.reset_packets(spark.createDataFrame([(b"x", 5, 7)], "data binary, pts long, kept long")).first()
    assert (bytes(fresh.data), fresh.pts, fresh.kept) == (b"", None, 7)


def _moov(sizes, chunks, runs, times, sync=None, same=0):
    """A one-track moov box with these tables; ``same`` sizes claim four billion samples."""
    import struct

    entry = mp4.box(b"mp4a", struct.pack(">6xH8xHH4xI", 1, 2, 16, 44100 << 16))
    stsz = struct.pack(">II", same, 4_000_000_000 if same else len(sizes)) + struct.pack(f">{len(sizes)}I", *sizes)
    tables = [mp4.full_box(b"stsd", struct.pack(">I", 1), entry), mp4._table(b"stts", "II", times), mp4.full_box(b"stsz", stsz), mp4._table(b"stsc", "III", [(a, b, 1) for a, b in runs]), mp4._table(b"stco", "I", [(c,) for c in chunks])]
    tables += [] if sync is None else [mp4._table(b"stss", "I", [(x,) for x in sync])]
    mdia = mp4.box(b"mdia", mp4.full_box(b"mdhd", struct.pack(">4IHH", 0, 0, 1000, 0, 0, 0)), mp4.full_box(b"hdlr", struct.pack(">I4s12x", 0, b"soun")), mp4.box(b"minf", mp4.box(b"stbl", *tables)))
    return mp4.box(b"moov", mp4.box(b"trak", mdia))


def test_mp4_sample_tables():
    """Against a plain reading of the rules; runs from any chunk on, counts beyond all bounds, samples in no chunk."""
    import random

    rng = random.Random(2)
    for _ in range(1500):
        n = rng.randrange(12)
        sizes, chunks = [rng.randrange(1, 50) for _ in range(n)], [rng.randrange(1000) for _ in range(rng.randrange(6))]
        runs = sorted({rng.randrange(1, 6): rng.choice([0, 1, 2, 3, 4_000_000_000]) for _ in range(rng.randrange(3))}.items())
        times = [(rng.choice([0, 1, 2, 3, 4_294_967_295]), rng.randrange(5)) for _ in range(rng.randrange(4))]
        sync = [rng.randrange(14) for _ in range(3)] if rng.random() < 0.5 else None
        durations = [d for c, d in times for _ in range(min(c, n))]
        durations = (durations + [durations[-1] if durations else 1] * n)[:n]
        if runs and chunks:
            held = [(c, s) for c in range(len(chunks)) for s in range(min(n, next((p for f, p in reversed(runs) if f <= c + 1), 1)))][:n]
            offsets = [chunks[c] + sum(sizes[i - s : i]) for i, (c, s) in enumerate(held)] + [chunks[0]] * (n - len(held))
        else:
            offsets = [chunks[min(i, len(chunks) - 1)] if chunks else 0 for i in range(n)]
        t = mp4.read_tracks(_moov(sizes, chunks, runs, times, sync))[0]
        assert (t.offsets.tolist(), t.durations.tolist(), t.sync.tolist()) == (offsets, durations, [sync is None or i + 1 in sync for i in range(n)])
    assert mp4.read_tracks(_moov([1, 1, 1], [36, 39, 44], [(2, 1)], [(3, 1)]))[0].offsets.tolist() == [36, 39, 44]
    assert len(mp4.read_tracks(_moov([], [36], [(1, 4_000_000_000)], [(4_000_000_000, 1)], same=7), 1000)[0].sizes) == 1000 // 7


def test_long_tables_in_blocks():
    """Blocks of any length give the samples that the whole tables do, also of odd tables and of several tracks."""
    import io
    import random

    rng = random.Random(4)
    for case in range(300):
        n = rng.randrange(0, 40)
        sizes = [rng.randrange(0, 9) for _ in range(n)]
        chunks = [rng.randrange(0, 5000) for _ in range(rng.choice([0, 1, 3, 12, 40]))]
        runs = [(rng.randrange(0, 14), rng.choice([0, 1, 2, 5, 4_000_000_000])) for _ in range(rng.choice([0, 1, 3]))]
        times = [(rng.choice([0, 1, 3, 7, 4_000_000_000]), rng.randrange(0, 4)) for _ in range(rng.choice([0, 1, 2, 9]))]
        sync = rng.choice([None, [rng.randrange(0, 45) for _ in range(5)]])
        data = _moov(sizes, chunks, runs, times, sync, same=rng.choice([0, 0, 7]))
        if case % 3 == 0:
            data = mp4.box(b"moov", data[8:], mp4.box(b"trak", b""), data[8:])
        size = max(300, len(data))
        want = [mp4.track_samples("p", i, t) for i, t in enumerate(mp4.read_tracks(data, size))]
        for at_once in (1, 3, 16, 1000):
            blocks = list(mp4.file_samples(io.BytesIO(data), "p", size, at_once, 0))
            assert all(len(b.seq) <= at_once for b in blocks)
            for s in want:
                own = [b for b in blocks if b.stream == s.stream]
                for name in ("seq", "pts", "offsets", "sizes", "durations", "sync"):
                    assert [x for b in own for x in getattr(b, name).tolist()] == np.asarray(getattr(s, name)).tolist(), (case, name)
                assert all((b.track.codec, b.track.timescale, b.track.rate, b.track.channels) == (s.track.codec, s.track.timescale, s.track.rate, s.track.channels) for b in own)
    with pytest.raises(ValueError, match="no track"):
        list(mp4.file_samples(io.BytesIO(mp4.box(b"moov", bytes(20))), "p", 28, 4, 0))


def test_a_film_is_put_together_in_little_memory(tmp_path):
    """Tables of a million samples go from parts to the file and back without being in memory together."""
    import tracemalloc

    folder, rows = f"file://{tmp_path}", []
    for piece in range(16):
        part = mux._Part(folder, "f.mp4", 0, piece)
        part.out.write(b"xy" * 65_536)
        for stream in (0, 1):
            numbers = np.arange(32_768)
            columns = tuple(mux.array(c) for c in "qqqb")
            for column, values in zip(columns, (np.full(32_768, 2), numbers * 4 + 2 * stream, 1 + numbers % 50, (numbers % 5 == 0) | (stream == 1))):
                column.frombytes(values.astype("i1" if column.typecode == "b" else "i8").tobytes())
            part.tracks[stream] = {"stream": stream, "codec": "aac" if stream else "h264", "timescale": 90_000, "rate": 48_000, "channels": 2, "width": 64, "height": 48}, columns
        part.bytes = 131_072
        rows += part.close().to_pylist()
    tracemalloc.start()
    with open(tmp_path / "f.mp4", "wb") as out:
        mux._whole(out, rows, "mp4")
    seen = [0, 0]
    with open(tmp_path / "f.mp4", "rb") as f:
        for s in mp4.file_samples(f, "f", (tmp_path / "f.mp4").stat().st_size):
            assert (s.durations == 1 + (s.seq % 32_768) % 50).all() and (s.offsets == 36 + s.seq * 4 + 2 * s.stream).all() and (s.sync == ((s.seq % 32_768 % 5 == 0) | (s.stream == 1))).all()
            seen[s.stream] += len(s.seq)
    assert seen == [524_288, 524_288] and tracemalloc.get_traced_memory()[1] < 24 << 20
    tracemalloc.stop()


def _written_mp4(spark, folder):
    rows = [(f"{name}.mp4", s, i, None, None, 10 * (1 + i % 3), 1000, "aac" if s else "h264", s == 1 or i % 7 == 3, None, 44100, 2, 64, 48, bytes([s, i]) * (5 + i)) for name in "ab" for i in range(60) for s in (0, 1)]
    spark.createDataFrame(rows, mp4.SCHEMA).repartition("path").sortWithinPartitions("path", "seq").write.format("mp4").mode("append").save(f"file://{folder}")
    return spark.read.format("mp4").load(f"file://{folder}").collect()


def test_mp4_index_and_time_ranges(spark, tmp_path):
    """Reading by time, kind and byte against all packets; any length of stretches."""
    register(spark)
    whole = sorted(_written_mp4(spark, f"{tmp_path}/m"))
    (tmp_path / "m" / "bad.mp4").write_bytes(b"\0\0\0\x08free")
    for step in (7, 1000):
        mp4_index.index_files(spark, f"file://{tmp_path}/m", step, errors="skip").write.parquet(f"{tmp_path}/i{step}")
        index = spark.read.parquet(f"{tmp_path}/i{step}")
        assert index.count() == (36 if step == 7 else 4)
        assert sorted(mp4_index.read_packets(index).collect()) == whole
        for since, until in ((0.0, 0.1), (0.305, 0.4), (-1, 0.05), (0.02, 9), (5, 9)):
            for flag in ("any", "backward"):
                want = []
                for key in {(r.path, r.stream_index) for r in whole}:
                    track = [r for r in whole if (r.path, r.stream_index) == key]
                    i = max([r.seq for r in track if r.pts <= since * 1000], default=0)
                    start = i if flag == "any" else max([r.seq for r in track[: i + 1] if r.keyframe], default=None)
                    want += [r for r in track if start is not None and r.seq >= start and r.pts < until * 1000]
                assert sorted(mp4_index.read_packets(index, since, until, flag).collect()) == sorted(want)
        first = {key: max(r.seq for r in whole if (r.path, r.stream_index) == key and r.pos <= 500) for key in {(r.path, r.stream_index) for r in whole}}
        assert {(r.path, r.stream_index): r.start for r in mp4_index.starts(index, 500, "byte").collect()} == first
        assert mp4_index.starts(index, 3, "byte").count() == 0
        assert mp4_index.read_packets(index.where("stream_index = 1"), payload=False).where("data is null").count() == 120
    with pytest.raises(ValueError, match="flag"):
        mp4_index.starts(index, 0, "sideways")
    with pytest.raises(Exception, match="no moov"):
        mp4_index.index_files(spark, f"file://{tmp_path}/m").count()


def test_mp4_pushed_conditions_read_no_more(spark, tmp_path, monkeypatch):
    """The conditions' rows by both plans; with an index no table is parsed and only the wanted samples' bytes are read."""
    import io

    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull, LessThan, StringContains

    register(spark)
    whole = _written_mp4(spark, f"{tmp_path}/m")
    mp4_index.index_files(spark, f"file://{tmp_path}/m", 16).write.parquet(f"{tmp_path}/i")
    load = lambda **o: spark.read.format("mp4").options(**o).load(f"file://{tmp_path}/m")
    indexed, cut = load(index=f"file://{tmp_path}/i"), load(bytesPerPartition="700")
    assert sorted(cut.collect()) == sorted(whole) == sorted(indexed.collect()) and cut.rdd.getNumPartitions() > 8
    one = whole[0].path
    for condition, keep in (
        ("pts >= 100 and pts < 300 and stream_index = 0", lambda r: 100 <= r.pts < 300 and r.stream_index == 0), ("keyframe and seq > 50", lambda r: r.keyframe and r.seq > 50),
        (f"path = '{one}' and not keyframe", lambda r: r.path == one and not r.keyframe), ("pos = 36 or seq = 59", lambda r: r.pos == 36 or r.seq == 59), ("keyframe and keyframe = false", lambda r: False), ("dts > 400 and pts <= 500", lambda r: 400 < r.pts <= 500),
    ):
        want = sorted(filter(keep, whole))
        one_query = (load(index=f"file://{tmp_path}/i", pushFilters="true"), load(bytesPerPartition="700", pushFilters="true"))
        assert all(sorted(frame.where(condition).collect()) == want for frame in (indexed, cut, *one_query))
    reader = mp4.ConditionedMp4Reader({"path": f"file://{tmp_path}/m", "index": f"file://{tmp_path}/i"})
    odd = StringContains(("path",), "x")
    assert list(reader.pushFilters([IsNotNull(("pts",)), GreaterThanOrEqual(("pts",), 100), LessThan(("pts",), 300), EqualTo(("stream_index",), 0), odd])) == [odd]
    monkeypatch.setattr(mp4, "find_moov", None)
    taken = []

    class Counted(io.FileIO):
        def read(self, n=-1):
            out = super().read(n)
            taken.append(len(out))
            return out

    monkeypatch.setattr(mp4, "open_read", lambda path: Counted(path))
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(got) == sum(100 <= r.pts < 300 and r.stream_index == 0 for r in whole) and sum(taken) == sum(len(r["data"]) for r in got) < sum(len(r.data) for r in whole) / 4


def test_index_plans_keep_no_rows(spark, tmp_path):
    """What the driver holds of an index grows with the tasks, not with the stretches; together they are read once."""
    import pickle

    tables = []
    for n in range(400):
        rows = list(mp4_index._stretches(mp4.track_samples(f"/m/{n % 200:03}.mp4", n // 200, mp4.Track("h264", 1000, offsets=np.arange(90) * 10, sizes=np.full(90, 10), durations=np.full(90, 1), sync=np.arange(90) % 9 == 0)), 3))
        tables.append(pa.Table.from_pylist(rows, schema=mp4_index._ARROW))
    pq.write_table(pa.concat_tables(tables), f"{tmp_path}/x.parquet", row_group_size=5000)
    keys = lambda tasks, bounds: sorted((s.path, s.stream, int(s.seq[0])) for t in tasks for s in mp4_index.load_stretches(f"file://{tmp_path}", t, bounds))
    bounds = mp4.Bounds()
    tasks = mp4_index.plan_stretches(f"file://{tmp_path}", bounds, 256 << 20)
    assert len(pickle.dumps(tasks)) < 2000 and len(tasks) <= 3 and len(keys(tasks, bounds)) == len(set(keys(tasks, bounds))) == 12_000
    assert len(mp4_index.plan_stretches(f"file://{tmp_path}", bounds, 16 << 20)) >= 25
    bounds.low["seq"], bounds.high["seq"], bounds.paths = 40, 44, {"/m/007.mp4", "/m/100.mp4", "none"}
    assert keys(mp4_index.plan_stretches(f"file://{tmp_path}", bounds, 1), bounds) == [(p, s, a) for p in ("/m/007.mp4", "/m/100.mp4") for s in (0, 1) for a in (39, 42)]


def test_small_mp4_files_share_tasks(spark, tmp_path):
    """A task reads many small files and gives their rows in few batches; a large file still has several tasks."""
    rows = [(f"{n}.mp4", 0, i, None, None, 10, 1000, "h264", True, None, 0, 0, 64, 48, bytes([n, i]) * 4) for n in range(60) for i in range(2)]
    register(spark)
    spark.createDataFrame(rows, mp4.SCHEMA).repartition(2, "path").sortWithinPartitions("path", "seq").write.format("mp4").mode("append").save(f"file://{tmp_path}/m")
    reader = lambda **o: mp4.Mp4Reader({"path": f"file://{tmp_path}/m", **o})
    whole = spark.read.format("mp4").load(f"file://{tmp_path}/m")
    assert whole.rdd.getNumPartitions() == 1 and sorted((r.path.rsplit("/", 1)[1], r.seq, r.data) for r in whole.collect()) == sorted((r[0], r[2], r[-1]) for r in rows)
    assert [b.num_rows for p in reader().partitions() for b in reader().read(p)] == [120]
    assert [len(p.files) for p in reader(bytesPerPartition=str(20 << 20)).partitions()] == [19, 19, 19, 3]
    assert len(reader(bytesPerPartition="700").partitions()) == sum(-(-f.stat().st_size // 700) for f in (tmp_path / "m").glob("*.mp4"))


def test_stretches_give_the_same(spark):
    """Sums, places, runs and frames in stretches of any length against one task's."""
    import random

    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(8)]), rng.choice([1, 1, 1, 2]), rng.choice([None, rng.randrange(-900, 900), 3 * i]), rng.choice([1, 3, 1001]), rng.choice([0, 1000, 90_000, 7])) for i in range(400)]
    frame = spark.createDataFrame(rows, "k string, i long, n long, d long, dts long, num int, den int").withColumn("time_base", rational(F.col("num"), F.col("den"))).withColumn("pts", F.lit(None).cast("long"))
    for width in (1, 7, 100, 10_000):
        cut = timeline.even_spans(frame, "i", width)
        spans = [r.span for r in cut.orderBy("i").collect()]
        assert spans == sorted(spans) and (width > 1000) == (len(set(spans)) == 1) and len(spans) == 400
        if width == 100:
            assert 3 <= len(set(spans)) <= 5 and max(map(spans.count, spans)) <= 110
        same = lambda f, *names: sorted((tuple(r) for r in f.select(*names).collect()), key=str)
        assert same(timeline.running_start(cut, ["k"], ["i"], "n", "at", F.col("span")), "k", "i", "at") == same(timeline.running_start(frame, ["k"], ["i"], "n", "at"), "k", "i", "at")
        assert same(timeline.run_lengths(cut, ["k"], ["i"], "d", F.col("span")), "k", "run", "count", "d") == same(timeline.run_lengths(frame, ["k"], ["i"], "d"), "k", "run", "count", "d")
        assert same(timeline.reblock(cut, ["k"], ["i"], "n", 5, F.col("span")), "k", "i", "frame_no", "first", "count") == same(timeline.reblock(frame, ["k"], ["i"], "n", 5), "k", "i", "frame_no", "first", "count")
        for by_time in (True, False):
            assert same(timeline.interleave(frame, ["k"], "i", by_time, rows_per_span=width), "k", "i", "place") == same(timeline.interleave(frame, ["k"], "i", by_time), "k", "i", "place")
    dense = spark.range(1000).select(F.when(F.col("id") < 900, F.col("id")).otherwise(F.col("id") * 1_000_000).alias("t"), "id").union(spark.createDataFrame([(None, 5)], "t long, id long"))
    sizes = {r.span: r["count"] for r in timeline.even_spans(dense, "t", 50).groupBy("span").count().collect()}
    assert sizes[-1] == 1 and sum(sizes.values()) == 1001
    assert timeline.even_spans(dense.limit(0), "t", 5).count() == 0 and set(r.span for r in timeline.even_spans(dense.where("id = 5"), "t", 1).collect()) <= {0, -1}


def test_crc_of_pieces(spark):
    """Any cut of a stream, empty and null pieces, against zlib over the whole."""
    import random
    import zlib

    rng = random.Random(3)
    pieces = [(k, i, rng.choice([None, b"", rng.randbytes(rng.randrange(1, 70)), bytes(rng.randrange(400))])) for k in ("a", None, "c") for i in range(60)] + [("long", 0, b"x"), ("long", 1, bytes(3_000_000)), ("none", 0, None)]
    frame = spark.createDataFrame(pieces, "k string, i int, data binary").repartition(5)
    whole = {k: b"".join(d or b"" for kk, _, d in pieces if kk == k) for k in ("a", None, "c", "long", "none")}
    for cut in (None, F.floor(F.col("i") / 7)):
        got = {r.k: (r.crc, r.bytes) for r in packets.crc32_fold(frame, ["k"], ["i"], "data", cut).collect()}
        assert got == {k: (zlib.crc32(v), len(v)) for k, v in whole.items()}


def test_muxing_by_many_tasks(spark, tmp_path):
    """Parts of any size give the bytes that one task writes; beyond a file's end a further one goes on."""
    register(spark)
    rows = [(f"{name}.mp4", s, i, None, None, 10 + i % 3, 1000, "aac" if s else "h264", s == 1 or i % 7 == 3, None, 44100, 2, 64, 48, bytes([s, i]) * (5 + i)) for name in "ab" for i in range(60) for s in (0, 1)]
    frame = spark.createDataFrame(rows, mp4.SCHEMA).repartition(4)
    frame.repartition("path").sortWithinPartitions("path", "seq", "stream_index").write.format("mp4").mode("append").save(f"file://{tmp_path}/one")
    for rows_per_part, part_bytes in ((10_000, 64 << 20), (16, 500), (5, 1)):
        made = mux.write_media(frame, f"file://{tmp_path}/{rows_per_part}", "mp4", rows_per_part=rows_per_part, part_bytes=part_bytes).collect()
        assert sorted((r.path, r.file_no, r.file) for r in made) == [("a.mp4", 0, "a.mp4"), ("b.mp4", 0, "b.mp4")]
        for r in made:
            assert (tmp_path / str(rows_per_part) / r.file).read_bytes() == (tmp_path / "one" / r.file).read_bytes() and r.bytes == (tmp_path / "one" / r.file).stat().st_size
    made = mux.write_media(frame, f"file://{tmp_path}/rolled", "mp4", rows_per_part=16, part_bytes=500, file_bytes=3000).collect()
    assert {r.file for r in made} >= {"a.mp4", "a-1.mp4", "b-1.mp4"}
    back = sorted((tuple(r) for r in spark.read.format("mp4").load(f"file://{tmp_path}/rolled").select(F.regexp_extract("path", "([ab])[-0-9]*.mp4$", 1), "stream_index", "data").collect()), key=str)
    assert back == sorted(((r[0][0], r[1], r[-1]) for r in rows), key=str)
    sound = [("w", 0, i, 8000, 1, "pcm_u8", bytes([i]) * (i % 5)) for i in range(99)]
    frame = spark.createDataFrame(sound, "path string, stream_index int, seq long, sample_rate int, channels int, codec_id string, data binary").repartition(3)
    assert [r.file for r in mux.write_media(frame, f"file://{tmp_path}/w", "wav", rows_per_part=9).collect()] == ["w"]
    assert (tmp_path / "w" / "w").read_bytes() == wav.wav_bytes("pcm_u8", 1, 8000, b"".join(r[-1] for r in sound))
    assert mux.write_media(frame.limit(0), f"file://{tmp_path}/none", "wav").count() == 0
    with pytest.raises(ValueError, match="4 GiB"):
        mux.write_media(frame, "x", "wav", file_bytes=1 << 32)
    with pytest.raises(ValueError, match="no writer"):
        mux.write_media(frame, "x", "avi")
    with pytest.raises(ValueError, match="4 GiB"):
        wav.wav_header("pcm_u8", 1, 8000, 1 << 32)


def _cuts(spark, tmp_path, rows, schema, sizes, build, name):
    """What a stream gives for the same rows cut into micro-batches in several ways."""
    out = []
    for n, size in enumerate(sizes):
        folder = tmp_path / f"{name}{n}"
        for i in range(0, len(rows), size):
            spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            for part in (folder / "in").glob("part-0*"):  # read in this order, one a trigger
                if not part.name.startswith("part-x"):
                    part.rename(part.with_name(f"part-x{i:05d}.parquet"))
                    import os

                    os.utime(folder / "in" / f"part-x{i:05d}.parquet", (1_000_000 + i, 1_000_000 + i))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        stateful.drain(build(stream), str(folder))
        out.append(sorted((tuple(map(lambda v: [bytes(x) for x in v] if isinstance(v, list) else bytes(v) if isinstance(v, bytearray) else v, r)) for r in spark.read.parquet(f"{folder}/out").collect()), key=str))
    return out


def test_streams_end_where_they_end(spark, tmp_path):
    """Rows after an end start anew in the same micro-batch too; any cut gives the same frames."""
    rows = [("a", 0, 600, True), ("a", 1, 600, False), ("b", 0, 2100, False), ("a", 2, 700, True), ("b", 1, 5, False), ("b", 2, 0, True), ("b", 3, 9, False)]
    got = _cuts(spark, tmp_path, rows, "k string, seq long, samples long, eos boolean", (1, 3, 7), lambda s: stateful.reblock(s, "k", 1024), "r")
    assert got[0] == got[1] == got[2] == sorted([("a", 0, 600), ("a", 0, 1024), ("a", 1, 276), ("b", 0, 1024), ("b", 1, 1024), ("b", 2, 57)], key=str)
    pieces = [("a", 0, b"\0\0\1\x67\x42", False), ("a", 1, b"\x00\0\0\1\x68", True), ("a", 2, b"\0\0\1\x01\0\0", False), ("a", 3, b"\1\x02", True)]
    got = _cuts(spark, tmp_path, pieces, "k string, seq long, data binary, eos boolean", (1, 2, 4), lambda s: stateful.frame_stream(s, "k", stateful.annex_b_pieces), "f")
    assert got[0] == got[1] == got[2] and len(got[0]) == 4


def test_sample_frames_and_pcm(spark, tmp_path):
    import random

    rng, rows, whole = random.Random(5), [], {}
    for k in "ab":
        for i in range(7):
            n = rng.randrange(0, 9)
            planes = [rng.randbytes(2 * n) for _ in range(2)]
            rows.append((k, i, n, [p + b"zz" for p in planes], i == 6))
            whole[k] = [x + p for x, p in zip(whole.get(k, [b""] * 2), planes)]
    schema = "k string, seq long, samples long, planes array<binary>, eos boolean"
    got = _cuts(spark, tmp_path, rows, schema, (3, 14), lambda s: stateful.sample_frames(s, "k", 4, 2, 2), "s")
    want = sorted(((k, f, min(4, len(p[0]) // 2 - 4 * f), [x[8 * f : 8 * f + 8] for x in p]) for k, p in whole.items() for f in range(-(-len(p[0]) // 8))), key=str)
    assert got[0] == got[1] == want
    for options, message in (({"capacity": 3}, "waiting"), ({"short": "fail"}, "at a stream's end")):
        bad = [("a", 0, 5, [bytes(10)] * 2, True)]
        with pytest.raises(Exception, match=message):
            _cuts(spark, tmp_path, bad, schema, (1,), lambda s, o=options: stateful.sample_frames(s, "k", 4, 2, 2, **o), message[:2])
    with pytest.raises(Exception, match="without their bytes"):
        _cuts(spark, tmp_path, [("a", 0, 5, [bytes(9)], True)], schema, (1,), lambda s: stateful.sample_frames(s, "k", 4, 2, 2), "few")
    dropped = _cuts(spark, tmp_path, rows, schema, (14,), lambda s: stateful.sample_frames(s, "k", 4, 2, 2, short="drop"), "d")[0]
    assert dropped == [w for w in want if w[2] == 4]

    data = {k: rng.randbytes(41) for k in "ab"}
    cut = [(k, i, data[k][a:b], b == 41) for k in "ab" for i, (a, b) in enumerate(((0, 3), (3, 3), (3, 20), (20, 41)))]
    for got in _cuts(spark, tmp_path, cut, "k string, seq long, data binary, eos boolean", (1, 5), lambda s: stateful.pcm_stream(s, "k", "pcm_s16be", 2), "p"):
        for k in "ab":
            mine = sorted((r for r in got if r[0] == k), key=lambda r: r[1])
            native = b"".join(data[k][i : i + 2][::-1] for i in range(0, 40, 2))
            assert b"".join(r[3] for r in mine) == native + data[k][40:] and sum(r[2] for r in mine) == 10 and mine[-1][2:] == (0, data[k][40:])


def test_stream_interleaving(spark, tmp_path):
    """The order of the batch operator, whatever the micro-batches, as long as nothing is later than allowed."""
    import datetime
    import random

    rng, start = random.Random(8), datetime.datetime(2024, 1, 1)
    times = [(f, s, start + datetime.timedelta(milliseconds=40 * i + (13 if s else 0))) for f in "xy" for i in range(20) for s in (0, 1)]
    times.sort(key=lambda t: t[2].timestamp() + rng.uniform(0, 0.3))  # up to 0.3 s out of order
    rows = [(f, s, q, t, bytes([q]), False) for q, (f, s, t) in enumerate(times)] + [(f, 0, 100, start + datetime.timedelta(seconds=2), b"", True) for f in "xy"]
    schema = "f string, stream_index int, seq long, ts timestamp, data binary, eos boolean"
    want = sorted((f, p, q) for f in "xy" for p, (_, q) in enumerate(sorted((r[3], r[2]) for r in rows if r[0] == f), 1))
    for got in _cuts(spark, tmp_path, rows, schema, (9, 40, 100), lambda s: stateful.interleave_stream(s, "f", "ts", "1 second"), "i"):
        assert sorted((r[0], r[1], r[3]) for r in got) == want
    open_end = _cuts(spark, tmp_path, rows[:-2], schema, (20,), lambda s: stateful.interleave_stream(s, "f", "ts", "100 milliseconds"), "o")[0]
    assert 0 < len(open_end) < len(rows) - 2 and all(sorted(r[1] for r in open_end if r[0] == f) == list(range(1, 1 + sum(r[0] == f for r in open_end))) for f in "xy")


def test_error_policies_and_seek_flags(spark):
    from reelframe.errors import KINDS, MediaError, kind_of

    rows = spark.createDataFrame([("a", 0, 1.0, True), ("a", 1, 2.0, False), ("a", 2, 3.0, True), ("b", 3, None, False), ("b", 4, 5.0, None)], "k string, i int, v double, bad boolean")
    get = lambda mode: [(r.i, r.v) for r in timeline.with_policy(rows, F.col("bad"), ["k"], ["i"], ["v"], mode).orderBy("i").collect()]
    assert get("skip") == [(1, 2.0), (3, None), (4, 5.0)] and get("conceal") == [(0, None), (1, 2.0), (2, 2.0), (3, None), (4, 5.0)]
    with pytest.raises(Exception, match="corrupt data"):
        get("fail")
    with pytest.raises(ValueError, match="mode"):
        get("guess")
    index = spark.createDataFrame([(1, i, 1000 * i, 5000 * i, 10, i % 2 == 0) for i in range(5)], "f int, seq long, timestamp long, pos long, size long, keyframe boolean")
    targets = spark.createDataFrame([(1, 0, 3500)], "f int, target_id long, at long")
    assert [seek.seek(targets, index, ["f"], flag).first().entry.seq for flag in ("backward", "any", "byte")] == [2, 3, 0]
    with pytest.raises(ValueError, match="flag"):
        seek.seek(targets, index, ["f"], "frame")
    assert [kind_of(e) for e in (EOFError(), FileNotFoundError(), MemoryError(), ValueError(), OSError(), MediaError("again"))] == ["eof", "not_found", "no_memory", "invalid_argument", "io", "again"]
    assert str(MediaError("eof", "x")) == KINDS["eof"] and str(MediaError("unsupported", "h264")) == "unsupported: h264"


def test_framing_splits_pieces_together(monkeypatch):
    """Any cut into pieces, frames and micro-batches gives the same units; neighbouring pieces are split at once."""
    import random

    import pandas as pd

    held, calls, rng = {}, [], random.Random(5)

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.get = False, None

    def split(data):
        calls.append(len(data))
        return stateful.annex_b_pieces(data)

    def grouped(rows, keys, run, *_):
        held["run"] = run
        raise InterruptedError

    monkeypatch.setattr(stateful, "_grouped", grouped)
    with pytest.raises(InterruptedError):
        stateful.frame_stream(None, "k", split, "long")
    unit = lambda: bytes(rng.choice(b"\1ABCD") for _ in range(rng.randrange(1, 9)))
    streams = [[unit() for _ in range(rng.randrange(1, 200))] for _ in range(3)]
    rows = []
    for units in streams:
        data = b"".join(b"\0\0\1" + u for u in units)
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(20))})
        rows += [(data[a:b], b == len(data)) for a, b in zip(cuts, cuts[1:])]
    want = [(i, u) for units in streams for i, u in enumerate([*units[:-1], b"\0\0\1" + units[-1]])]
    for at_once, batches in ((1 << 20, 1), (1 << 20, 3), (7, 2)):
        monkeypatch.setattr(stateful, "BYTES_AT_ONCE", at_once)
        calls.clear()
        state, got, step = State(), [], -(-len(rows) // batches)
        for a in range(0, len(rows), step):
            part = [(9, i, *rows[i]) for i in range(a, min(a + step, len(rows)))]
            rng.shuffle(part)
            frames = [pd.DataFrame(part[i::2], columns=["k", "seq", "data", "eos"]) for i in (0, 1)]
            for frame in held["run"]((9,), iter(frames), state):
                got += [(first + i, u) for first, units in zip(frame["__first"], frame["__units"]) for i, u in enumerate(units)]
        assert got == want and not state.exists
        assert at_once == 7 or len(calls) <= len(streams) + batches - 1


def test_growing_raw_streams(spark, tmp_path):
    """A file that grows between triggers and restarts is framed once; its end comes when its mark does."""
    register(spark)
    folder = tmp_path / "raw"
    folder.mkdir()
    pieces = lambda: spark.readStream.format("rawstream").option("bytesPerPartition", "5").load(f"file://{folder}")

    def run():
        stateful.drain(stateful.frame_stream(pieces(), "path", stateful.annex_b_pieces), str(tmp_path / "o"))
        return sorted((r.path.rsplit("/", 1)[1], r.unit_no, bytes(r.unit)) for r in spark.read.schema("path string, unit_no long, unit binary").parquet(f"{tmp_path}/o/out").collect())

    unit = lambda n: b"\0\0\1" + bytes([65 + n]) * (4 + n)
    (folder / "a.raw").write_bytes(unit(0) + unit(1)[:5])
    assert run() == [("a.raw", 0, b"AAAA")]
    with (folder / "a.raw").open("ab") as f:
        f.write(unit(1)[5:] + unit(2))
    (folder / "b.raw").write_bytes(unit(3))
    assert run() == [("a.raw", 0, b"AAAA"), ("a.raw", 1, b"BBBBB")]
    for name in "ab":
        (folder / f"{name}.raw.end").touch()
    want = [("a.raw", 0, b"AAAA"), ("a.raw", 1, b"BBBBB"), ("a.raw", 2, unit(2)), ("b.raw", 0, unit(3))]
    assert run() == want and run() == want


def test_raw_files_share_tasks(tmp_path):
    """Small files share a task, of which each file is opened once; large ones have several tasks; nothing is left out."""
    from reelframe.sources.raw_stream import RawStreamReader

    for i in range(300):
        (tmp_path / f"{i:03}.raw").write_bytes(bytes([i % 256]) * (i % 40))
        (tmp_path / f"{i:03}.raw.end").touch()
    (tmp_path / "big.raw").write_bytes(bytes(130 << 20))
    reader = RawStreamReader({"path": f"file://{tmp_path}", "bytesPerPartition": str(20)})
    end = reader.latestOffset()
    end["taken"] = {p: n for p, n in end["taken"].items() if "big" not in p}
    tasks = reader.partitions(reader.initialOffset(), end)
    rows = [r for t in tasks for r in reader.read(t)]
    assert len(tasks) == 2 and len(rows) == sum(max(1, -(-(i % 40) // 20)) for i in range(300)) and sum(r[3] for r in rows) == 300
    assert all(b"".join(r[2] for r in rows if r[0].endswith(f"/{i:03}.raw")) == bytes([i % 256]) * (i % 40) for i in range(300))
    assert reader.partitions(end, end) == []
    large = RawStreamReader({"path": f"file://{tmp_path}/big.raw"})
    assert len(large.partitions(large.initialOffset(), {"taken": dict([*large.latestOffset()["taken"].items()]), "ended": []})) == 3


def test_subtitles_by_sql(spark):
    from reelframe.functions import subtitles

    subtitles.register_functions(spark)
    ass = "[Events]\nDialogue: 0,0:00:01.5,0:00:02.25,Top,,0,0,0,,{\\b1}a, b\\Nc\nDialogue: broken\r\nDialogue: 0,0:00:03.00,0:00:04.00,,,0,0,0,,d"
    files = spark.createDataFrame([(1, ass), (2, None)], "id int, t string")
    got = spark.sql("SELECT f.id, c.* FROM {f} f, LATERAL subtitle_cues('ass', encode(f.t, 'utf-8')) c ORDER BY cue_no", f=files).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1500, 2250, "a, b\nc", "Top"), (1, 1, 3000, 4000, "d", "")]
    assert [r.text for r in subtitles.cues(files, "ass", "id", "t").orderBy("cue_no").collect()] == [r.text for r in got]
    vtt = spark.sql("SELECT * FROM subtitle_cues('webvtt', 'WEBVTT\n\n00:01.000 --> 00:02.000\n<b>x</b>\n')").collect()
    assert [tuple(r) for r in vtt] == [(0, 1000, 2000, "x")]
    for bad, message in (("SELECT * FROM subtitle_cues('sub', 'x')", "codec must be"), ("SELECT * FROM subtitle_cues('srt', 1)", "string or binary")):
        with pytest.raises(Exception, match=message):
            spark.sql(bad).collect()
