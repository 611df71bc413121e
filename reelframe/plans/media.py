"""Dimension tables, containers and streams: parts, documents and events as media."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelframe.errors import SKIP
from reelframe.functions import dims, octets, timebase
from reelframe.operators import packets
from reelframe.plans.catalog import query, table
from reelframe.sources import mp4, mp4_index, mux, register
from reelframe.sources.files import place_of, shared_dir
from reelframe.streaming import stateful

# Fixed values, written out apart from the table in `dims` that they are held against.
_PIX = """pix(id, name, components, bpp, planes, cw, ch, planar, bpc) AS (VALUES
(0, 'yuv420p', 3, 12, 3, 1, 1, true, 8), (1, 'yuv422p', 3, 16, 3, 1, 0, true, 8), (2, 'yuv444p', 3, 24, 3, 0, 0, true, 8), (3, 'yuv420p10le', 3, 15, 3, 1, 1, true, 10), (4, 'yuv420p10be', 3, 15, 3, 1, 1, true, 10),
(5, 'yuv422p10le', 3, 20, 3, 1, 0, true, 10), (6, 'yuv444p10le', 3, 30, 3, 0, 0, true, 10), (7, 'yuva420p', 4, 20, 4, 1, 1, true, 8), (8, 'nv12', 3, 12, 2, 1, 1, true, 8), (9, 'nv21', 3, 12, 2, 1, 1, true, 8),
(10, 'rgb24', 3, 24, 1, 0, 0, false, 8), (11, 'bgr24', 3, 24, 1, 0, 0, false, 8), (12, 'rgba', 4, 32, 1, 0, 0, false, 8), (13, 'bgra', 4, 32, 1, 0, 0, false, 8), (14, 'argb', 4, 32, 1, 0, 0, false, 8), (15, 'abgr', 4, 32, 1, 0, 0, false, 8),
(16, 'gbrp', 3, 24, 3, 0, 0, true, 8), (17, 'gray', 1, 8, 1, 0, 0, false, 8), (18, 'gray16le', 1, 16, 1, 0, 0, false, 16), (19, 'yuyv422', 3, 16, 1, 1, 0, false, 8), (20, 'uyvy422', 3, 16, 1, 1, 0, false, 8),
(21, 'vaapi', 0, 0, 0, 0, 0, false, 0), (22, 'd3d11', 0, 0, 0, 0, 0, false, 0), (23, 'videotoolbox', 0, 0, 0, 0, 0, false, 0), (24, 'cuda', 0, 0, 0, 0, 0, false, 0))"""
_LINE = lambda p: f"(CASE WHEN planar AND {p} IN (1, 2) THEN (w + (1 << cw) - 1) // (1 << cw) ELSE w END * CASE WHEN bpc > 8 THEN 2 ELSE 1 END * CASE WHEN planar THEN 1 ELSE components END)"
_TALL = lambda p: f"(CASE WHEN planar AND {p} IN (1, 2) THEN (h + (1 << ch) - 1) // (1 << ch) ELSE h END)"


def _by_part(spark, sf_dir, dim, count: int):
    """Parts joined to a fixed table by number; such tables have a few dozen rows at most."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % count).cast("int").alias("id"))
    return part.join(F.broadcast(dim), "id")


@query(f"WITH {_PIX} SELECT p_partkey, name, components, bpp, planes FROM part JOIN pix ON p_partkey % 25 = id")
def pixfmt_dim(spark, sf_dir):
    return _by_part(spark, sf_dir, dims.pixel_formats(spark), 25).select("p_partkey", "name", "components", "bpp", "planes")


@query("""WITH f(id, name, b, planar) AS (VALUES (0, 'u8', 1, false), (1, 's16', 2, false), (2, 's32', 4, false), (3, 'flt', 4, false), (4, 'dbl', 8, false), (5, 'u8p', 1, true), (6, 's16p', 2, true), (7, 's32p', 4, true), (8, 'fltp', 4, true), (9, 'dblp', 8, true))
SELECT p_partkey, name, b * p_size * CASE WHEN planar THEN 1 ELSE 6 END::BIGINT AS bytes, replace(name, 'p', '') AS interleaved FROM part JOIN f ON p_partkey % 10 = id""")
def samplefmt_buffers(spark, sf_dir):
    rows = _by_part(spark, sf_dir, dims.sample_formats(spark), 10)
    return rows.select("p_partkey", "name", dims.buffer_size(F.col("bytes_per_sample"), F.col("planar"), F.col("p_size"), F.lit(6)).alias("bytes"), F.col("to_interleaved").alias("interleaved"))


@query("""WITH l(id, name, c) AS (VALUES (0, 'mono', 1), (1, 'stereo', 2), (2, '2.1', 3), (3, '3.0', 3), (4, 'quad', 4), (5, '5.0', 5), (6, '5.1', 6), (7, '7.1', 8))
SELECT p_partkey, name AS named, c AS nb_channels, name IN ('2.1', '5.1', '7.1') AS has_lfe FROM part JOIN l ON p_partkey % 8 = id""")
def layout_dim(spark, sf_dir):
    rows = _by_part(spark, sf_dir, dims.channel_layouts(spark), 8)
    return rows.select("p_partkey", dims.layout_name(dims.layout_of(F.col("name"))).alias("named"), F.size("channels").alias("nb_channels"), F.array_contains("channels", "LFE").alias("has_lfe"))


@query("""WITH c(id, name) AS (SELECT i - 1, n FROM (SELECT unnest(['h264', 'hevc', 'vp8', 'vp9', 'av1', 'png', 'none', 'pcm_s16le', 'pcm_s16be', 'pcm_f32le', 'pcm_f32be', 'pcm_u8', 'flac', 'aac', 'opus', 'mp3', 'vorbis', 'srt', 'ass', 'webvtt']) AS n, unnest(range(1, 21)) AS i))
SELECT p_partkey, name, CASE WHEN id < 7 THEN 'video' ELSE 'audio' END AS media_type FROM part JOIN c ON p_partkey % 20 = id""")
def codec_dim(spark, sf_dir):
    return _by_part(spark, sf_dir, dims.codecs(spark), 20).select("p_partkey", "name", "media_type")


@query(f"""WITH {_PIX}, p AS (SELECT p_partkey, p_size * 37 AS w, p_size * 21 AS h, pix.* FROM part JOIN pix ON p_partkey % 25 = id)
SELECT p_partkey, CASE WHEN planes > 0 THEN ({_LINE(0)} + 31) // 32 * 32 END::BIGINT AS luma, CASE WHEN planes > 1 THEN {_LINE(1)} END::BIGINT AS chroma,
(CASE WHEN planes > 0 THEN {_LINE(0)} * {_TALL(0)} ELSE 0 END + CASE WHEN planes > 1 THEN {_LINE(1)} * {_TALL(1)} ELSE 0 END + CASE WHEN planes > 2 THEN {_LINE(2)} * {_TALL(2)} ELSE 0 END + CASE WHEN planes > 3 THEN {_LINE(3)} * {_TALL(3)} ELSE 0 END)::BIGINT AS bytes FROM p""")
def image_sizes(spark, sf_dir):
    rows = _by_part(spark, sf_dir, dims.pixel_formats(spark), 25)
    w, h = F.col("p_size") * 37, F.col("p_size") * 21
    line = lambda plane, align: dims.image_line_size(w, F.lit(plane), F.col("components"), F.col("planes"), F.col("log2_cw"), F.col("planar"), F.col("bpc"), align)
    whole = dims.image_buffer_size(w, h, F.col("components"), F.col("planes"), F.col("log2_cw"), F.col("log2_ch"), F.col("planar"), F.col("bpc"))
    return rows.select("p_partkey", line(0, 32).alias("luma"), line(1, 1).alias("chroma"), whole.alias("bytes"))


@query("""SELECT s_suppkey, (s_suppkey % 4)::INT AS stream_index, CASE WHEN s_suppkey % 2 = 0 THEN 'video' ELSE 'audio' END AS media_type, CASE WHEN s_suppkey % 2 = 0 THEN 'h264' ELSE 'aac' END AS codec_id,
CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey * 16 ELSE 0 END::INT AS width, CASE WHEN s_suppkey % 2 = 1 THEN 48000 ELSE 0 END::INT AS sample_rate, CASE WHEN s_suppkey % 2 = 1 THEN s_nationkey ELSE 0 END::INT AS channels, '1/1' AS aspect, true AS is_default, false AS is_forced
FROM supplier WHERE s_nationkey > 0""")
def stream_rows(spark, sf_dir):
    """Suppliers as streams; those of nation 0 have no size or channels and are refused."""
    n, video = F.col("s_nationkey").cast("int"), F.col("s_suppkey") % 2 == 0
    made = F.when(video, packets.video_parameters(F.lit("h264"), n * 16, F.lit(720), SKIP)).otherwise(packets.audio_parameters(F.lit("aac"), F.lit(48_000), n, SKIP))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", packets.new_stream(F.col("s_suppkey") % 4, made, ("default",)).alias("s")).where("s.parameters is not null")
    return rows.select("s_suppkey", F.col("s.index").alias("stream_index"), "s.parameters.media_type", "s.parameters.codec_id", "s.parameters.width", "s.parameters.sample_rate", "s.parameters.channels", timebase.show(F.col("s.parameters.sample_aspect_ratio")).alias("aspect"), F.col("s.disposition.default").alias("is_default"), F.col("s.disposition.forced").alias("is_forced"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 48000 END::INT AS sample_rate, CASE WHEN p_size % 3 > 0 THEN p_size % 3 END::INT AS planes_set FROM part""")
def audio_frames(spark, sf_dir):
    """Parts as audio frames of a plane a channel; frames without channels are refused."""
    channels = (F.col("p_size") % 3).cast("int")
    rows = table(spark, sf_dir, "part").select("p_partkey", channels.alias("n"), packets.new_audio_frame(F.lit(48_000), channels, F.lit(1024), SKIP).alias("f"))
    planes = F.transform("f.planes", lambda p, i: F.when(i < F.col("n"), F.encode(F.lit("x"), "utf-8")).otherwise(p))
    return rows.select("p_partkey", "f.sample_rate", F.when(F.col("f").isNotNull(), packets.plane_count(planes)).alias("planes_set"))


def _write_wav(spark, sf_dir) -> str:
    """Each source's texts as the audio of a WAV file, written by many tasks; returns their folder."""
    register(spark)
    folder = shared_dir(spark, "wav")
    rows = table(spark, sf_dir, "documents").select(F.concat("source", F.lit(".wav")).alias("path"), F.lit(0).alias("stream_index"), F.col("doc_id").alias("seq"), F.lit(None).cast("long").alias("pts"), F.lit(None).cast("long").alias("duration"), F.lit(8000).alias("sample_rate"), F.lit(1).alias("channels"), F.lit("pcm_u8").alias("codec_id"), F.lit(None).cast("long").alias("pos"), F.encode("text", "utf-8").alias("data"))
    mux.write_media(rows, folder, "wav", rows_per_part=2_500)
    return folder


@query("""WITH d AS (SELECT source, sum(octet_length(encode(text)))::BIGINT AS n FROM documents GROUP BY source)
SELECT source || '.wav' AS file, (n + 4095) // 4096 AS packets, n AS samples, n AS bytes, 'pcm_u8' AS codec_id FROM d""")
def wav_roundtrip(spark, sf_dir):
    """Each source's texts as the audio of a WAV file, written and read back through ``format("wav")``."""
    back = spark.read.format("wav").load(_write_wav(spark, sf_dir))
    return back.groupBy(F.substring_index("path", "/", -1).alias("file")).agg(F.count("*").alias("packets"), F.sum("duration").alias("samples"), F.sum(F.octet_length("data")).cast("long").alias("bytes"), F.first("codec_id").alias("codec_id"))


@query("""WITH d AS (SELECT source, sum(octet_length(encode(text)))::BIGINT AS n FROM documents GROUP BY source), p AS (SELECT source, n, unnest(range(0, (n + 4095) // 4096)) AS seq FROM d)
SELECT source || '.wav' AS file, seq, seq * 4096 AS pts, least(4096, n - seq * 4096)::BIGINT AS duration FROM p WHERE seq >= 3 * 8000 // 4096 AND seq * 4096 < 5 * 8000""")
def wav_time_range(spark, sf_dir):
    """The packets of every file that sound between 3 and 5 seconds; only these are read."""
    rows = spark.read.format("wav").option("since", "3").option("until", "5").load(_write_wav(spark, sf_dir))
    return rows.select(F.substring_index("path", "/", -1).alias("file"), "seq", "pts", "duration")


_MP4 = """e AS (SELECT user_id, event_id, encode(event_type || props) AS b, event_id % 50 + 1 AS d, event_type = 'view' AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
m AS (SELECT user_id || '.mp4' AS file, seq, b, d AS duration, coalesce(sum(d) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pts, k AS keyframe FROM e)"""


def _write_mp4(spark, sf_dir) -> str:
    """Each user's events as the samples of an MP4 file; returns their folder."""
    register(spark)
    folder = shared_dir(spark, "mp4")
    none = lambda t: F.lit(None).cast(t)
    rows = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit(".mp4")).alias("path"), F.lit(0).alias("stream_index"), F.col("event_id").alias("seq"), none("long").alias("pts"), none("long").alias("dts"), (F.col("event_id") % 50 + 1).alias("duration"), F.lit(90_000).alias("timescale"), F.lit("h264").alias("codec_id"), (F.col("event_type") == "view").alias("keyframe"), none("long").alias("pos"), none("int").alias("sample_rate"), none("int").alias("channels"), F.lit(1280).alias("width"), F.lit(720).alias("height"), F.encode(F.concat("event_type", "props"), "utf-8").alias("data"))
    rows.repartition("path").sortWithinPartitions("path", "seq").write.format("mp4").mode("append").save(folder)
    return folder


@query("""WITH e AS (SELECT event_id AS seq, encode(event_type || props) AS b, event_id % 50 + 1 AS d, (event_id % 2)::INT AS s FROM events), b AS (SELECT *, coalesce(sum(octet_length(b)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT s AS stream_index, seq, md5(b) AS payload, d AS duration, (seq % 5 = 0 OR s = 1) AS keyframe FROM b""")
def mp4_many_tasks(spark, sf_dir):
    """All events as one film of a video and an audio track, written by many tasks and read back by its index."""
    register(spark)
    folder = shared_dir(spark, "film")
    stream = (F.col("event_id") % 2).cast("int")
    rows = table(spark, sf_dir, "events").select(F.lit("film.mp4").alias("path"), stream.alias("stream_index"), F.col("event_id").alias("seq"), (F.col("event_id") % 50 + 1).alias("duration"), F.lit(90_000).alias("timescale"), F.when(stream == 0, "h264").otherwise("aac").alias("codec_id"), ((F.col("event_id") % 5 == 0) | (stream == 1)).alias("keyframe"),
        F.when(stream == 1, 48_000).alias("sample_rate"), F.when(stream == 1, 2).alias("channels"), F.lit(640).alias("width"), F.lit(360).alias("height"), F.encode(F.concat("event_type", "props"), "utf-8").alias("data"))
    mux.write_media(rows, folder, "mp4", rows_per_part=2_500)
    mp4_index.index_files(spark, folder, samples=1024).write.parquet(f"{folder}-index")
    back = mp4_index.read_packets(spark.read.parquet(f"{folder}-index"))
    first = table(spark, sf_dir, "events").groupBy(stream.alias("stream_index")).agg(F.min("event_id").alias("least"))  # ids have no gaps: every second one is the stream's
    return back.join(first, "stream_index").select("stream_index", (F.col("least") + 2 * F.col("seq")).alias("seq"), F.md5("data").alias("payload"), "duration", "keyframe")


def _named():
    return F.substring_index("path", "/", -1).alias("file")


@query(f"WITH {_MP4} SELECT file, seq, decode(b) AS payload, duration, pts, keyframe FROM m")
def mp4_roundtrip(spark, sf_dir):
    """Each user's events as the samples of an MP4 file, written and read back through ``format("mp4")``."""
    back = spark.read.format("mp4").load(_write_mp4(spark, sf_dir))
    return back.select(_named(), "seq", F.decode("data", "utf-8").alias("payload"), "duration", "pts", "keyframe")


def _indexed(spark, sf_dir) -> tuple[str, str]:
    """Folder of the files and of their index, in stretches of 32 samples."""
    folder = _write_mp4(spark, sf_dir)
    mp4_index.index_files(spark, folder, samples=32).write.parquet(f"{folder}-index")
    return folder, f"{folder}-index"


@query(f"""WITH {_MP4}, aim AS (SELECT file, max(seq) AS i FROM m WHERE pts <= 450 GROUP BY file), k AS (SELECT m.file, max(m.seq) AS start FROM m JOIN aim ON m.file = aim.file AND m.seq <= aim.i AND keyframe GROUP BY m.file)
SELECT m.file, m.seq, m.pts, decode(b) AS payload FROM m JOIN k ON m.file = k.file AND m.seq >= k.start WHERE m.pts < 1800""")
def mp4_time_range(spark, sf_dir):
    """What a player reads of every file to show 5 to 20 ms: from the last keyframe before, by the index."""
    _, index = _indexed(spark, sf_dir)
    rows = mp4_index.read_packets(spark.read.parquet(index), since=450 / 90_000, until=1800 / 90_000)
    return rows.select(_named(), "seq", "pts", F.decode("data", "utf-8").alias("payload"))


@query(f"WITH {_MP4} SELECT file, seq, pts, decode(b) AS payload FROM m WHERE keyframe AND pts >= 450 AND pts < 1800")
def mp4_pushed_conditions(spark, sf_dir):
    """Conditions on time and keyframes that the reader answers from the index before it opens a file."""
    folder, index = _indexed(spark, sf_dir)
    rows = spark.read.format("mp4").option("index", index).option("pushFilters", "true").load(folder).where("keyframe and pts >= 450 and pts < 1800")
    return rows.select(_named(), "seq", "pts", F.decode("data", "utf-8").alias("payload"))


@query(f"""WITH {_MP4}, o AS (SELECT file, seq, keyframe, pts, 36 + coalesce(sum(octet_length(b)) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM m)
SELECT file, max(seq) FILTER (pos <= 500) AS by_byte, max(seq) FILTER (pts <= 450) AS by_time, coalesce(max(seq) FILTER (pts <= 450 AND keyframe), -1) AS by_keyframe FROM o GROUP BY file""")
def mp4_seek_flags(spark, sf_dir):
    """Where reading would begin in each file: by a byte, by a time, and at the keyframe before it."""
    _, folder = _indexed(spark, sf_dir)
    index = spark.read.parquet(folder)
    found = {n: mp4_index.starts(index, x, flag).select("path", F.col("start").alias(n)) for n, x, flag in (("by_byte", 500, mp4_index.BYTE), ("by_time", 450 / 90_000, mp4_index.ANY), ("by_keyframe", 450 / 90_000, mp4_index.BACKWARD))}
    return found["by_time"].join(found["by_byte"], "path", "left").join(found["by_keyframe"], "path", "left").select(_named(), "by_byte", "by_time", F.coalesce("by_keyframe", F.lit(-1)).alias("by_keyframe"))


@query("""WITH s AS (SELECT p_partkey, p_size AS z, unnest(range(0, 6)) AS seq FROM part)
SELECT p_partkey, seq, (seq * 10)::BIGINT AS pts, (CASE seq WHEN 0 THEN 100 WHEN 1 THEN 200 WHEN 2 THEN 200 + z WHEN 3 THEN 300 WHEN 4 THEN 300 + z ELSE 100 END)::BIGINT AS pos, z::BIGINT AS size, seq IN (0, 3) AS keyframe FROM s""")
def mp4_chunk_runs(spark, sf_dir):
    """Tables of six samples in three chunks, the first run from chunk 2 on, a count beyond what the box holds, and a
    sample that lies in no chunk."""
    uint = lambda *values: b"".join(v.to_bytes(4, "big") for v in values)
    size = octets.write_uint(F.col("p_size").cast("long"), 4)

    def box(kind: bytes, *parts) -> tuple:
        """(column, bytes it takes); a part is such a pair, or fixed bytes."""
        pairs = [(F.lit(p), len(p)) if isinstance(p, bytes) else p for p in parts]
        n = 8 + sum(m for _, m in pairs)
        return F.concat(F.lit(uint(n) + kind), *(c for c, _ in pairs)), n

    entry = box(b"mp4a", uint(0, 1, 0, 0) + b"\x00\x02\x00\x10" + uint(0, 44100 << 16))
    stbl = box(b"stbl", box(b"stsd", uint(0, 1), entry), box(b"stts", uint(0, 1, 9, 10)), box(b"stsz", uint(0, 0, 6), *[(size, 4)] * 6), box(b"stsc", uint(0, 4_000_000_000, 2, 2, 1)), box(b"stco", uint(0, 3, 100, 200, 300)), box(b"stss", uint(0, 2, 1, 4)))
    mdia = box(b"mdia", box(b"mdhd", uint(0, 0, 0, 1000, 60, 0)), box(b"hdlr", uint(0, 0) + b"soun" + uint(0, 0, 0)), box(b"minf", stbl))
    rows = table(spark, sf_dir, "part").select("p_partkey", box(b"moov", box(b"trak", mdia))[0].alias("b"))
    return mp4.sample_rows(rows, "p_partkey", "b").select("p_partkey", "seq", "pts", "pos", "size", "keyframe")


@query("""SELECT p_partkey, k.depth, k.box_type, k.payload_size FROM part, LATERAL (VALUES (0, 'moov', 16 + p_size), (1, 'udta', 8 + p_size), (2, 'name', p_size), (0, 'free', 0)) k(depth, box_type, payload_size)""")
def mp4_boxes(spark, sf_dir):
    """Nested boxes written in expressions from part columns, then walked."""
    n = F.col("p_size").cast("long")
    head = lambda size, kind: F.concat(octets.write_uint(size, 4), F.lit(kind))
    data = F.concat(head(n + 24, b"moov"), head(n + 16, b"udta"), head(n + 8, b"name"), octets.filled(0x41, F.col("p_size")), head(F.lit(8), b"free"))
    rows = table(spark, sf_dir, "part").select("p_partkey", data.alias("b"))
    return mp4.boxes(rows, "p_partkey", "b").select("p_partkey", "depth", "box_type", F.col("payload_size").cast("int").alias("payload_size"))


def _stream(spark, sf_dir, name: str):
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.rsplit("/", 1)[0] + "/" + name + "*.parquet")


@query("""SELECT event_type, count(*)::BIGINT AS n, time_bucket(INTERVAL '1 hour', ts) AS window_start FROM events GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    """Hourly packet counts by a structured stream with a watermark, in complete mode over what there is."""
    folder = shared_dir(spark, "windows")
    name = "w" + folder.rsplit("-", 1)[-1]
    counts = stateful.windowed_counts(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour", "1 day")
    query_ = counts.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.select("event_type", "n", F.col("window.start").cast("timestamp_ntz").alias("window_start")).write.mode("overwrite").parquet(f"{folder}/{name}")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.parquet(f"{folder}/{name}")


@query("""WITH s AS (SELECT user_id, sum(event_id % 700 + 1)::BIGINT AS n FROM events GROUP BY user_id), f AS (SELECT user_id, n, unnest(range(0, n // 1024)) AS frame_no FROM s)
SELECT user_id, frame_no, 1024::BIGINT AS samples FROM f""")
def stream_reblock(spark, sf_dir):
    """Frames of 1024 samples by a stateful stream; a stream that doesn't end holds its rest back."""
    folder = shared_dir(spark, "reblock")
    rows = _stream(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 700 + 1).alias("samples"), F.lit(False).alias("eos"))
    stateful.drain(stateful.reblock(rows, "user_id", 1024, "long"), folder)
    return spark.read.parquet(f"{folder}/out")


@query("""SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN p_size % 4 + 1 ELSE 1 END)::INT AS planes, (p_size * CASE WHEN p_size % 2 = 0 THEN 1 ELSE p_size % 4 + 1 END)::INT AS plane_bytes,
substr(upper(to_hex(encode(repeat('A', p_size)))) || '', 1, 2 * least(3, p_size)) || repeat('00', greatest(p_size - 3, 0)::INT) AS copied FROM part""")
def sample_buffers(spark, sf_dir):
    """Zeroed planes of planar and interleaved samples, and the first bytes of a plane copied into another."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("n"), octets.alloc_samples(F.col("p_size") % 2 == 0, (F.col("p_size") % 4 + 1).cast("int"), F.col("p_size").cast("int")).alias("p"))
    target = octets.filled(0, F.col("n"))
    copied = octets.copied(octets.filled(0x41, F.col("n")), target, F.least(F.lit(3), F.col("n")))
    return rows.select("p_partkey", F.size("p").alias("planes"), F.octet_length(F.get("p", F.lit(0))).alias("plane_bytes"), F.hex(copied).alias("copied"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM documents)
SELECT doc_id, (i - 1)::BIGINT AS unit_no, w AS word FROM w""")
def stream_annexb(spark, sf_dir):
    """Words as units of elementary streams that arrive in pieces of 100 bytes."""
    folder = shared_dir(spark, "annexb")
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    data = F.encode(F.array_join(F.transform(words, lambda w: F.concat(F.lit("\x00\x00\x01"), w)), ""), "utf-8")
    whole = _stream(spark, sf_dir, "documents").select("doc_id", data.alias("b")).where("octet_length(b) > 0")
    pieces = whole.select("doc_id", "b", F.explode(F.expr("sequence(0, (octet_length(b) - 1) div 100)")).alias("n"))
    rows = pieces.select("doc_id", F.col("n").cast("long").alias("seq"), F.substring(F.col("b"), F.col("n") * 100 + 1, F.lit(100)).alias("data"), F.expr("n = (octet_length(b) - 1) div 100").alias("eos"))
    stateful.drain(stateful.frame_stream(rows, "doc_id", stateful.annex_b_pieces, "long"), folder)
    # the unit that a stream's end gives out still has its start code
    return spark.read.parquet(f"{folder}/out").select("doc_id", "unit_no", F.regexp_replace(F.decode("unit", "utf-8"), "^\\x00\\x00\\x01", "").alias("word"))


@query("""WITH s AS (SELECT user_id, string_agg(event_type || props, '' ORDER BY event_id) AS t FROM events GROUP BY user_id), f AS (SELECT user_id, t, unnest(range(0, length(t) // 64)) AS frame_no FROM s)
SELECT user_id, frame_no, 64::BIGINT AS samples, substr(t, frame_no * 64 + 1, 64) AS data FROM f""")
def stream_frames(spark, sf_dir):
    """Events as 8-bit samples of their user, cut into frames of 64 that carry them."""
    folder = shared_dir(spark, "frames")
    data = F.encode(F.concat("event_type", "props"), "utf-8")
    rows = _stream(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.octet_length(data).cast("long").alias("samples"), F.array(data).alias("planes"), F.lit(False).alias("eos"))
    stateful.drain(stateful.sample_frames(rows, "user_id", 64, 1, 1, key_type="long"), folder)
    return spark.read.parquet(f"{folder}/out").select("user_id", "frame_no", "samples", F.decode(F.get("planes", F.lit(0)), "utf-8").alias("data"))


@query("""WITH l AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - 86400000000 AS passed FROM events)
SELECT user_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events, l WHERE epoch_us(ts) <= passed""")
def stream_interleave(spark, sf_dir):
    """Each user's events in the order of their times, as far as the watermark, a day behind, has come."""
    folder = shared_dir(spark, "interleave")
    rows = _stream(spark, sf_dir, "events").select("user_id", F.lit(0).alias("stream_index"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.encode("event_type", "utf-8").alias("data"), F.lit(False).alias("eos"))
    stateful.drain(stateful.interleave_stream(rows, "user_id", "ts", "1 day", "long"), folder)
    return spark.read.parquet(f"{folder}/out").select("user_id", "seq", "place")


def _write_raw(rows, folder: str):
    """Append ``rows(path, data)``, a file's rows standing together, to raw files, and mark each as ended."""
    import pyarrow as pa

    def write(batches):
        done: dict[str, int] = {}
        place, root = place_of(folder)
        place.create_dir(root, recursive=True)
        name = out = None
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if path != name:
                    if out is not None:
                        out.close()
                    name, out = path, place.open_output_stream(f"{root}/{path}.raw")
                out.write(data.as_py())
                done[path] = done.get(path, 0) + 1
        if out is not None:
            out.close()
        for path in done:
            place.open_output_stream(f"{root}/{path}.raw.end").close()
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.string()), pa.array(list(done.values()), pa.int64())], names=["path", "n"])

    rows.repartition("path").sortWithinPartitions("path", "seq").select("path", "data").mapInArrow(write, "path string, n long").write.format("noop").mode("overwrite").save()


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS unit_no, w AS word FROM w""")
def raw_stream_units(spark, sf_dir):
    """Conversations as raw files of units, framed by a stream that is stopped, finds further files and goes on."""
    register(spark)
    folder = shared_dir(spark, "raw")
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    data = F.encode(F.array_join(F.transform(words, lambda w: F.concat(F.lit("\x00\x00\x01"), w)), ""), "utf-8")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("seq"), data.alias("data"), (F.col("conv_id") % 2).alias("half")).where("octet_length(data) > 0")
    for half in (0, 1):
        _write_raw(rows.where(F.col("half") == half), f"{folder}/files")
        pieces = spark.readStream.format("rawstream").option("bytesPerPartition", "8192").load(f"{folder}/files")
        stateful.drain(stateful.frame_stream(pieces, "path", stateful.annex_b_pieces), folder)
    back = spark.read.parquet(f"{folder}/out").select(F.regexp_extract("path", r"(-?\d+)\.raw$", 1).cast("long").alias("conv_id"), "unit_no", "unit")
    # the unit that a stream's end gives out still has its start code
    return back.select("conv_id", "unit_no", F.regexp_replace(F.decode("unit", "utf-8"), "^\\x00\\x00\\x01", "").alias("word"))
