"""Known answers for time bases, bytes, dictionaries, bitstreams and subtitles."""

import random

import pytest
from pyspark.sql import functions as F

from reelframe.functions import bits, dicts, dims, octets, subtitles
from reelframe.functions import timebase as T


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_rationals(spark):
    r = T.rational
    got = one(spark, T.show(T.reduce(r(6, 4))), T.show(T.reduce(r(3, -4))), T.show(T.reduce(r(0, 5))), T.show(T.add(r(1, 4), r(1, 4))), T.show(T.subtract(r(3, 4), r(1, 4))), T.show(T.multiply(r(2, 3), r(3, 4))), T.show(T.divide(r(1, 2), r(3, 4))), T.show(T.multiply(r(30000, 1), r(1, 30000))), T.show(T.invert(r(-2, 3))))
    assert list(got) == ["3/2", "-3/4", "0/1", "1/2", "1/2", "1/2", "2/3", "1/1", "3/-2"]
    got = one(spark, T.equals(r(2, 4), r(1, 2)), T.equals(r(-1, 2), r(1, -2)), T.equals(r(0, 0), r(0, 0)), T.compare(r(1, -2), r(1, 3)), T.reduce(r(1, 0), "skip"), T.add(r(2**31 - 1, 1), r(1, 1), "skip"))
    assert list(got) == [True, True, None, -1, None, None]
    with pytest.raises(Exception, match="invalid rational"):
        one(spark, T.reduce(r(1, 0)))
    assert list(one(spark, *[T.gcd_int(a, b) for a, b in ((12, 8), (7, 13), (0, 5), (-12, 8), (0, 0))])) == [4, 1, 5, 4, 1]


def test_from_double(spark):
    values = [0.5, -0.25, 3.141592653589793, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(T.from_double("v", F.lit(1000)).alias("r")).collect()
    assert [(r.r.num, r.r.den) for r in rows[:2]] == [(1, 2), (-1, 4)]
    assert abs(rows[2].r.num / rows[2].r.den - values[2]) < 0.001 and rows[2].r.den <= 1000
    assert all(r.r is None or r.r.num is None for r in rows[3:])


def test_rescale_against_whole_numbers(spark):
    rng = random.Random(5)
    edge = [0, 1, -1, 2**63 - 1, -(2**63), 2**62, 3, 90000, 1000]
    rows = [(rng.choice([*edge, rng.randrange(-(10**12), 10**12)]), rng.choice(edge), rng.choice(edge)) for _ in range(1500)]
    frame = spark.createDataFrame(rows, "v long, s long, d long")

    def model(v, s, d, how):
        if d == 0:
            return None
        if s == 0:
            return 0
        q, rest = divmod(abs(v) * abs(s), abs(d))
        negative = (v < 0) != ((s < 0) != (d < 0))
        q += {"zero": False, "inf": rest > 0, "down": negative and rest > 0, "up": not negative and rest > 0, "near": 2 * rest >= abs(d)}[how]
        return None if q >= 2**63 else -q if negative else q

    for how in T.ROUNDINGS:
        got = [r[0] for r in frame.select(T.rescale(F.col("v"), F.col("s"), F.col("d"), how, "skip")).collect()]
        assert got == [model(*r, how) for r in rows]
    with pytest.raises(Exception, match="rescale to zero"):
        one(spark, T.rescale(1, 0, 0))


def test_time_stamps(spark):
    r = T.rational
    got = one(spark, T.rescale_q(48000, r(1, 48000), r(1, 1000)), T.compare_ts(500, r(1, 1000), 500_000, r(1, 1_000_000)), T.compare_ts(499, r(1, 1000), 500_000, r(1, 1_000_000)), T.compare_ts(F.lit(None).cast("long"), r(1, 1000), 1, r(1, 1)), T.show_ts(F.lit(1500), r(1, 1000)), T.show_ts(F.lit(None), r(1, 1000)), T.from_seconds(2.5, r(1, 1)), T.from_seconds(-2.5, r(1, 1)), T.discontinuity(F.lit(5), r(1, 1), F.lit(1), r(1, 1), 2.0))
    assert list(got) == [1000, 0, -1, None, "1.500000s", "NOPTS", 3, -3, True]


def test_bytes(spark):
    b = lambda x: F.lit(x)
    got = one(spark, octets.crc32_hex(b(b"")), octets.crc32_hex(b(b"123456789")), octets.base64_encode(b(b"Hello")), octets.base64_decode(F.lit("SGVs\nbG8=")), octets.base64_decode(F.lit("SGVs!G8="), "skip"), octets.base64_decode(F.lit("SGVsbG8=\n"), "skip"), octets.swap_groups(b(b"\x01\x02\x03\x04\x05"), 2), octets.swap_groups(b(bytes.fromhex("0000803F00000040")), 4), octets.read_uint(b(b"\x01\xff\x80\x03"), 0, 4, True), octets.read_uint(b(b"\x01"), 0, 2), octets.read_u64(b(b"\xff" * 8), 0), octets.resized(b(b"abc"), 5), octets.resized(b(b"abc"), 2), octets.copied(b(b"xy"), b(b"abcd"), 2))
    assert list(got)[:3] == ["00000000", "cbf43926", "SGVsbG8="]
    assert [bytes(x) if x is not None and not isinstance(x, int) else x for x in list(got)[3:6]] == [b"Hello", None, None]
    assert bytes(got[6]) == b"\x02\x01\x04\x03\x05" and bytes(got[7]).hex() == "3f80000040000000"
    assert got[8] == 0x0380FF01 and got[9] is None and int(got[10]) == 2**64 - 1
    assert [bytes(x) for x in list(got)[11:]] == [b"abc\0\0", b"ab", b"xycd"]
    got = one(spark, octets.silence(F.lit("u8p"), 2), octets.silence(F.lit("s16"), 2), octets.pcm_s16_samples(b(b"\xff\xff\x01\x00\x09")), octets.probe(b(b"\0\0\0\x18ftyp")), octets.probe(b(b"abc")))
    assert bytes(got[0]) == b"\x80\x80" and bytes(got[1]) == b"\0\0" and got[2] == [-1, 1] and got[3].format == "mp4" and got[4] is None


def test_dicts_and_options(spark):
    d = dicts.parse(F.lit(" title=Hello; artist = World;novalue;title=Again"), ";", "=")
    got = one(spark, dicts.show(d), dicts.get(d, "artist"), dicts.get(d, "none"), dicts.show(dicts.parse(F.lit(""), ";", "=")), dicts.show(dicts.put(d, "artist", "x")), dicts.contains(dicts.remove(d, "title"), "title"))
    assert list(got) == ["title=Again; artist=World", "World", None, "", "title=Again; artist=x", False]
    options = dicts.Options()
    options.register("bitrate", dicts.Option(int, 128000, 1000, 10_000_000))
    options.register("verbose", dicts.Option(bool, False))
    options.set("bitrate", "64000")
    options.set("verbose", "yes")
    assert options.get("bitrate") == 64000 and options.get("verbose", bool) is True
    for bad in (("bitrate", "1"), ("bitrate", "x"), ("nothing", "1"), ("verbose", "maybe")):
        with pytest.raises(ValueError):
            options.set(*bad)
    options.reset()
    assert options.get("bitrate") == 128000


def test_adts_and_opus(spark):
    h = one(spark, bits.adts_header(F.lit(bytes.fromhex("FFF150800D7FFC"))))[0]
    assert (h.profile, h.sample_rate_index, h.channels, h.frame_length, h.header_size, h.has_crc) == ("LC", 4, 2, 107, 7, False)
    assert one(spark, bits.adts_header(F.lit(b"\xff\xf1\x7c\x80\x0d\x7f\xfc"), "skip"))[0] is None
    toc = [one(spark, bits.opus_toc(F.lit(b)))[0] for b in (0x08, 0xFC, 0x61)]
    assert [(t.mode, t.bandwidth, t.samples, t.stereo, t.code) for t in toc] == [("SILK", "NB", 960, False, 0), ("CELT", "FB", 960, True, 0), ("Hybrid", "SWB", 480, False, 1)]
    counts = [one(spark, bits.opus_frame_count(F.lit(bytes.fromhex(x)), "skip"))[0] for x in ("08", "09", "0A", "0B05", "0B", "0B00")]
    assert counts == [1, 2, 2, 5, None, None]


def test_nal_units():
    assert [u.hex() for u in bits.annex_b_units(bytes.fromhex("000000016742001E00000001680102"))] == ["6742001e", "680102"]
    assert [u.hex() for u in bits.annex_b_units(bytes.fromhex("000001674200000165AA"))] == ["6742", "65aa"]
    assert list(bits.annex_b_units(b"\0\0\1\0\0\1\0\0\1")) == [] and list(bits.annex_b_units(b"abc")) == []
    assert [len(u) for u in bits.avcc_units(bytes.fromhex("00000003674200000000026801"), 4)] == [3, 2]
    with pytest.raises(ValueError):
        list(bits.avcc_units(bytes.fromhex("000000FF67"), 4))
    r = bits.BitReader(bytes([0b10100110, 0b01000000]))
    assert [r.ue() for _ in range(4)] == [0, 1, 2, 3]


def test_subtitles(spark):
    srt = "1\n00:00:01,000 --> 00:00:03,500\nHello World\n\n2\n00:00:04,000 --> 00:00:06,000\nSecond line\nWith continuation\n"
    vtt = "﻿WEBVTT\n\n00:01.000 --> 00:03.5 position:10%\n<b>Hi</b> all\n\nbroken\n\n1\n01:00:00.25 --> 01:00:01.000\ntwo\n"
    ass = "[Events]\nDialogue: 0,0:00:01.00,0:00:03.50,Default,,0,0,0,,Hello, World\nDialogue: 0,0:00:04.0,0:00:06.00,D,,0,0,0,,Second {\\b1}bold{\\b0}\\Nline\n"
    rows = lambda text, kind: [tuple(r)[1:] for r in subtitles.cues(spark.createDataFrame([(1, text), (2, None)], "k int, text string"), kind, "k").orderBy("cue_no").collect()]
    assert rows(srt, "srt") == [(0, 1000, 3500, "Hello World"), (1, 4000, 6000, "Second line\nWith continuation")]
    assert rows(vtt, "webvtt") == [(0, 1000, 3500, "Hi all"), (1, 3600250, 3601000, "two")]
    assert rows(ass, "ass") == [(0, 1000, 3500, "Hello, World"), (1, 4000, 6000, "Second bold\nline")]
    times = one(spark, subtitles.srt_time(F.lit("01:02:03,456")), subtitles.srt_time(F.lit("00:00:01,5")), subtitles.ass_time(F.lit("0:01:23.45")), subtitles.ass_time(F.lit("0:00:01.5")), subtitles.webvtt_time(F.lit("01:23.456")), subtitles.webvtt_time(F.lit("x")), subtitles.strip_ass_tags(F.lit("a{b}c}d{e")))
    assert list(times) == [3723456, 1005, 83450, 1500, 83456, None, "acd"]


def test_dimensions(spark):
    assert [f(spark).count() for f in (dims.pixel_formats, dims.sample_formats, dims.channel_layouts, dims.codecs, dims.nal_types, dims.opus_configs)] == [25, 10, 8, 20, 15, 32]
    rows = {r.name: r for r in dims.pixel_formats(spark).select("name", *[dims.image_line_size(F.lit(w), F.lit(p), F.col("components"), F.col("planes"), F.col("log2_cw"), F.col("planar"), F.col("bpc")).alias(f"l{w}_{p}") for w, p in ((1920, 0), (1920, 1), (1921, 1))]).collect()}
    assert (rows["yuv420p"].l1920_0, rows["yuv420p"].l1920_1, rows["yuv420p"].l1921_1) == (1920, 960, 961)
    assert (rows["rgb24"].l1920_0, rows["rgba"].l1920_0, rows["yuv420p10le"].l1920_0) == (5760, 7680, 3840)
    got = one(spark, dims.layout_name(dims.layout_of(F.lit("surround"))), dims.layout_name(F.array(F.lit("FL"), F.lit("LFE"))), dims.layout_of(F.lit("x")))
    assert list(got) == ["3.0", "FL+LFE", None]


def test_annex_b_column_agrees(spark):
    cases = [b"", b"\0\0\1", b"ab\0\0\1cd", b"\0\0\0\1e\xff\0\0\0\1\0\0\1f\0", b"\0\0\1\0\0\0\1x\0\0\0\0\1y", bytes(range(256)) + b"\0\0\1\n\r\x85"]
    rng = random.Random(6)
    cases += [bytes(rng.choice([0, 0, 0, 1, 1, 200]) for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, b binary").select("i", bits.annex_b_column(F.col("b")).alias("u")).collect()
    for r in rows:
        assert [bytes(u) for u in r.u] == list(bits.annex_b_units(cases[r.i]))


def test_crc_queries_against_zlib(spark):
    import zlib

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r.crc for r in entry.queries()["crc32_documents"](spark, folder).collect()}
    assert got == {r.doc_id: f"{zlib.crc32(r.text.encode()):08x}" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    folds: dict = {}
    for r in sorted(spark.read.parquet(f"{folder}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        folds[r.conv_id] = zlib.crc32((r.text or "").encode(), folds.get(r.conv_id, 0))
    got = {r.conv_id: r.crc for r in entry.queries()["crc32_incremental"](spark, folder).collect()}
    assert got == {k: f"{v:08x}" for k, v in folds.items()}
