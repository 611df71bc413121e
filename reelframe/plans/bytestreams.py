"""Bytes, bitstreams, subtitles and dictionaries over texts, conversations and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelframe.functions import bits, dicts, octets, subtitles
from reelframe.operators.packets import crc32_fold
from reelframe.plans.catalog import query, table

# CRC-32 by table: 256 entries from the reflected polynomial, then a fold over the bytes.
_CRC = """RECURSIVE steps AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS n FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8),
lut AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8)"""
_FOLD = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(b) + 1), lambda k: ('0x' || substr(hex(b), (2 * k - 1)::INT, 2))::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"


@query()
def crc32_documents(spark, sf_dir):
    """CRC-32 of every whole text (SQL folds bytes too slowly on whole tables; the tests hold it against zlib)."""
    return table(spark, sf_dir, "documents").select("doc_id", octets.crc32_hex(F.encode("text", "utf-8")).alias("crc"))


@query(f"WITH {_CRC}, d AS (SELECT event_id, encode(event_type || props) AS b FROM events) SELECT event_id, lower(printf('%08x', {_FOLD})) AS crc FROM d, lut")
def crc32_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", octets.crc32_hex(F.encode(F.concat("event_type", "props"), "utf-8")).alias("crc"))


@query(f"WITH {_CRC}, d AS (SELECT conv_id, encode(string_agg(text, '' ORDER BY turn)) AS b FROM conversations GROUP BY conv_id) SELECT conv_id, lower(printf('%08x', {_FOLD})) AS crc, octet_length(b)::BIGINT AS bytes FROM d, lut")
def crc32_incremental(spark, sf_dir):
    """CRC-32 over each conversation's texts in order of turn: pieces are hashed apart and combined, no text is joined."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "utf-8").alias("data"))
    return crc32_fold(turns, ["conv_id"], ["turn"], "data").select("conv_id", F.lower(F.lpad(F.hex("crc"), 8, "0")).alias("crc"), "bytes")


@query("SELECT doc_id, base64(encode(text)) AS encoded, octet_length(encode(text))::INT AS size FROM documents")
def base64_roundtrip(spark, sf_dir):
    encoded = table(spark, sf_dir, "documents").select("doc_id", octets.base64_encode(F.encode("text", "utf-8")).alias("encoded"))
    # the encoded text is a column of its own: Spark keeps the projections apart, as decoding uses it several times
    return encoded.select("doc_id", "encoded", F.octet_length(octets.base64_decode(F.col("encoded"))).alias("size"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type || event_id END AS decoded FROM events")
def base64_decode_lenient(spark, sf_dir):
    """Line breaks inside, missing padding, and junk that is refused."""
    encoded = octets.base64_encode(F.encode(F.concat("event_type", F.col("event_id").cast("string")), "utf-8"))
    kind = F.col("event_id") % 4
    shaped = F.when(kind == 0, encoded).when(kind == 1, F.concat(F.left(encoded, F.lit(4)), F.lit("\r\n "), F.substring(encoded, 5, 1000))).when(kind == 2, F.regexp_replace(encoded, "=", "")).otherwise(F.concat(F.lit("!"), encoded))
    return table(spark, sf_dir, "events").select("event_id", F.decode(octets.base64_decode(shaped, "skip"), "utf-8").alias("decoded"))


@query("""WITH d AS (SELECT event_id, hex(encode(event_type || event_id)) AS h FROM events), s AS (SELECT event_id, h, unnest(range(0, length(h) // 4)) AS i FROM d),
v AS (SELECT event_id, ('0x' || substr(h, (4 * i + 3)::INT, 2) || substr(h, (4 * i + 1)::INT, 2))::BIGINT AS x FROM s)
SELECT event_id, count(*)::BIGINT AS samples, sum(CASE WHEN x >= 32768 THEN x - 65536 ELSE x END)::BIGINT AS total FROM v GROUP BY event_id""")
def pcm_s16_samples(spark, sf_dir):
    samples = octets.pcm_s16_samples(F.encode(F.concat("event_type", F.col("event_id").cast("string")), "utf-8"))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(samples).alias("x"))
    return rows.groupBy("event_id").agg(F.count("*").alias("samples"), F.sum("x").alias("total"))


@query("""SELECT doc_id, md5(regexp_replace(hex(encode(text)), '(..)(..)', '\\2\\1', 'g')) AS swapped2, md5(regexp_replace(hex(encode(text)), '(..)(..)(..)(..)', '\\4\\3\\2\\1', 'g')) AS swapped4 FROM documents""")
def pcm_swap_bytes(spark, sf_dir):
    data = F.encode("text", "utf-8")
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(F.encode(F.hex(octets.swap_groups(data, n)), "utf-8")).alias(f"swapped{n}") for n in (2, 4)])


@query("""SELECT event_id, event_id % 65536 AS le16, event_id AS be32, event_id * 1000003 AS le56, upper(printf('%08x', event_id)) AS raw FROM events""")
def endian_reads(spark, sf_dir):
    v = F.col("event_id")
    data = F.concat(octets.write_uint(v, 2, True), octets.write_uint(v, 4), octets.write_uint(v * 1_000_003, 7, True))
    rows = table(spark, sf_dir, "events").select("event_id", data.alias("b"))
    return rows.select("event_id", octets.read_uint(F.col("b"), 0, 2, True).alias("le16"), octets.read_uint(F.col("b"), 2, 4).alias("be32"), octets.read_uint(F.col("b"), 6, 7, True).alias("le56"), F.hex(octets.take(F.col("b"), 2, 4)).alias("raw"))


@query("""SELECT p_partkey, repeat(CASE WHEN p_partkey % 2 = 0 THEN '80' ELSE '00' END, p_size) AS silence, repeat(CASE WHEN p_partkey % 3 > 0 THEN '80' ELSE '00' END, p_size * 2) AS black,
upper(to_hex(encode(left(p_name, p_size)))) || repeat('00', greatest(0, p_size - length(p_name))) AS resized FROM part""")
def buffer_fills(spark, sf_dir):
    fmt = F.when(F.col("p_partkey") % 2 == 0, "u8").otherwise("s16")
    plane = (F.col("p_partkey") % 3).cast("int")
    name = F.encode("p_name", "utf-8")
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(octets.silence(fmt, F.col("p_size"))).alias("silence"), F.hex(octets.black_plane(F.lit(True), plane, F.col("p_size"), F.lit(2))).alias("black"), F.hex(octets.resized(name, F.col("p_size"))).alias("resized"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS entries, CASE WHEN event_id % 3 = 1 THEN 'new' ELSE props END AS props, event_id % 3 <> 0 AS has_type FROM events""")
def side_data_upsert(spark, sf_dir):
    start = F.create_map(F.lit("props"), F.encode("props", "utf-8"), F.lit("type"), F.encode("event_type", "utf-8"))
    kind = F.col("event_id") % 3
    changed = F.when(kind == 0, octets.drop_side_data(start, "type")).when(kind == 1, octets.put_side_data(start, "props", F.encode(F.lit("new"), "utf-8"))).otherwise(start)
    rows = table(spark, sf_dir, "events").select("event_id", changed.alias("m"))
    return rows.select("event_id", F.size("m").alias("entries"), F.decode(octets.get_side_data(F.col("m"), "props"), "utf-8").alias("props"), octets.get_side_data(F.col("m"), "type").isNotNull().alias("has_type"))


@query("""WITH d AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents), p AS (SELECT doc_id, n, unnest(range(0, (n + 4095) // 4096)) AS seq FROM d)
SELECT doc_id, seq, seq * 4096 AS pts, least(4096, n - seq * 4096)::BIGINT AS duration FROM p""")
def wav_packetize(spark, sf_dir):
    """Texts as unsigned 8-bit audio in packets of 4096 frames."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("b")).where(F.octet_length("b") > 0)
    packets = rows.select("doc_id", "b", F.explode(F.expr("sequence(0L, cast((octet_length(b) - 1) div 4096 as bigint))")).alias("seq"))
    data = octets.take(F.col("b"), (F.col("seq") * 4096).cast("int"), 4096)
    return packets.select("doc_id", "seq", (F.col("seq") * 4096).alias("pts"), F.octet_length(data).cast("long").alias("duration"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'wav' WHEN 1 THEN 'mp4' WHEN 2 THEN 'mp4' END AS format, CASE p_partkey % 5 WHEN 0 THEN 90 WHEN 1 THEN 95 WHEN 2 THEN 50 END AS score,
CASE WHEN p_partkey % 5 = 0 THEN p_size + 36 END AS riff_size FROM part""")
def format_probe(spark, sf_dir):
    kind = F.col("p_partkey") % 5
    wav = F.concat(F.lit(b"RIFF"), octets.write_uint(F.col("p_size") + 36, 4, True), F.lit(b"WAVE"))
    data = F.when(kind == 0, wav).when(kind == 1, F.lit(b"\0\0\0\x18ftypisom")).when(kind == 2, F.lit(b"\0\0\0\x08moov")).when(kind == 3, F.lit(b"RIFF")).otherwise(F.encode("p_name", "utf-8"))
    rows = table(spark, sf_dir, "part").select("p_partkey", data.alias("b")).withColumn("p", octets.probe(F.col("b")))
    return rows.select("p_partkey", "p.format", "p.score", F.when(F.col("p_partkey") % 5 == 0, octets.read_uint(F.col("b"), 4, 4, True)).alias("riff_size"))


_CONV = "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS cue_no, turn * 1000 AS start_ms, turn * 1000 + 750 AS end_ms, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS text FROM conversations"


def _cue_files(spark, sf_dir, head: str, cue):
    """A subtitle file a conversation, a cue a turn, white space made single spaces."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", cue(F.col("turn"), flat).alias("cue"))
    files = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "cue"))).alias("t"))
    return files.select("conv_id", F.concat(F.lit(head), F.array_join("t.cue", "\n")).alias("text"))


def _stamp(turn, ms: int, form: str):
    return F.format_string(form, F.call_function("div", turn, F.lit(3600)), F.call_function("div", turn, F.lit(60)) % 60, turn % 60, F.lit(ms))


@query(_CONV)
def srt_parse(spark, sf_dir):
    cue = lambda t, x: F.concat((t + 1).cast("string"), F.lit("\n"), _stamp(t, 0, "%02d:%02d:%02d,%03d"), F.lit(" --> "), _stamp(t, 750, "%02d:%02d:%02d,%03d"), F.lit("\n"), x, F.lit("\n"))
    return subtitles.cues(_cue_files(spark, sf_dir, "", cue), "srt", "conv_id")


@query(_CONV)
def webvtt_parse(spark, sf_dir):
    cue = lambda t, x: F.concat(F.lit("id "), t.cast("string"), F.lit("\n"), _stamp(t, 0, "%02d:%02d:%02d.%03d"), F.lit(" --> "), _stamp(t, 750, "%02d:%02d:%02d.%03d"), F.lit(" position:10%\n<b>"), x, F.lit("</b>\n"))
    return subtitles.cues(_cue_files(spark, sf_dir, "﻿WEBVTT\nKind: captions\n\n", cue), "webvtt", "conv_id")


@query(_CONV)
def ass_parse(spark, sf_dir):
    cue = lambda t, x: F.concat(F.lit("Dialogue: 0,"), _stamp(t, 0, "%d:%02d:%02d.%02d"), F.lit(","), _stamp(t, 75, "%d:%02d:%02d.%02d"), F.lit(",Default,,0,0,0,,{\\b1}"), x, F.lit("{\\b0}"))
    return subtitles.cues(_cue_files(spark, sf_dir, "[Events]\nFormat: Layer, Start, End\nDialogue: broken\n", cue), "ass", "conv_id")


@query(f"SELECT conv_id, codec, cue_no, start_ms, end_ms, text FROM ({_CONV}) c, (SELECT unnest(['ass', 'srt']) AS codec) k")
def subtitles_by_sql(spark, sf_dir):
    """Two dialects of the same cues, parsed by a table function that SQL calls for each file."""
    subtitles.register_functions(spark)
    srt = lambda t, x: F.concat((t + 1).cast("string"), F.lit("\n"), _stamp(t, 0, "%02d:%02d:%02d,%03d"), F.lit(" --> "), _stamp(t, 750, "%02d:%02d:%02d,%03d"), F.lit("\n"), x, F.lit("\n"))
    ass = lambda t, x: F.concat(F.lit("Dialogue: 0,"), _stamp(t, 0, "%d:%02d:%02d.%02d"), F.lit(","), _stamp(t, 75, "%d:%02d:%02d.%02d"), F.lit(",Default,,0,0,0,,{\\b1}"), x, F.lit("{\\b0}"))
    return spark.sql("""SELECT f.conv_id, 'srt' AS codec, c.cue_no, c.start_ms, c.end_ms, c.text FROM {srt} f, LATERAL subtitle_cues('srt', f.text) c
        UNION ALL SELECT f.conv_id, 'ass', c.cue_no, c.start_ms, c.end_ms, c.text FROM {ass} f, LATERAL subtitle_cues('ass', f.text) c WHERE c.style = 'Default'""", srt=_cue_files(spark, sf_dir, "", srt), ass=_cue_files(spark, sf_dir, "[Events]\n", ass))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]*>?|>', '', 'g')) AS stripped FROM pages")
def strip_vtt_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.encode(subtitles.strip_webvtt_tags(F.col("html")), "utf-8")).alias("stripped"))


@query("SELECT event_id, event_type || ' tail' AS stripped, event_type AS unclosed FROM events")
def strip_ass_tags(spark, sf_dir):
    tagged = F.concat(F.lit("{\\i1}"), "event_type", F.lit("{\\i0} tail}"))
    return table(spark, sf_dir, "events").select("event_id", subtitles.strip_ass_tags(tagged).alias("stripped"), subtitles.strip_ass_tags(F.concat("event_type", F.lit("{\\pos"))).alias("unclosed"))


@query("""SELECT event_id, (event_id * 37 % 86400) * 1000 + event_id % 1000 AS srt, (event_id * 37 % 86400) * 1000 + event_id % 100 * 10 AS ass, (event_id * 37 % 86400) * 1000 + event_id % 10 * 100 AS vtt,
(event_id * 37 % 3600) * 1000 + 5 AS short_srt FROM events""")
def time_parse_three_dialects(spark, sf_dir):
    s = F.col("event_id") * 37 % 86400
    clock = F.format_string("%02d:%02d:%02d", F.call_function("div", s, F.lit(3600)), F.call_function("div", s, F.lit(60)) % 60, s % 60)
    short = F.format_string("00:%02d:%02d,5", F.call_function("div", s % 3600, F.lit(60)), s % 60)
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id", subtitles.srt_time(F.concat(clock, F.lit(","), F.format_string("%03d", F.col("event_id") % 1000))).alias("srt"),
        subtitles.ass_time(F.concat(clock, F.lit("."), F.format_string("%02d7", F.col("event_id") % 100))).alias("ass"),
        subtitles.webvtt_time(F.concat(clock, F.lit("."), (F.col("event_id") % 10).cast("string"))).alias("vtt"), subtitles.srt_time(short).alias("short_srt"),
    )


@query("SELECT event_id, 'k=' || event_id || '; event=' || event_type || '; z=a=b' AS shown, event_type AS event FROM events")
def dict_parse(spark, sf_dir):
    text = F.concat(F.lit(" k = first;event="), "event_type", F.lit(";;novalue; z = a=b ; k="), F.col("event_id").cast("string"))
    d = dicts.parse(text, ";", "=")
    return table(spark, sf_dir, "events").select("event_id", dicts.show(d).alias("shown"), dicts.get(d, "event").alias("event"))


@query("SELECT event_id, 'a=1; type=' || event_type || '; user=' || user_id AS merged, 'type=' || event_type || '; user=' || user_id AS removed FROM events")
def dict_merge(spark, sf_dir):
    left = dicts.put(dicts.put(dicts.empty(), "a", "1"), "type", "none")
    right = dicts.put(dicts.put(dicts.empty(), "user", F.col("user_id")), "type", F.col("event_type"))
    merged = dicts.merge(left, right)
    return table(spark, sf_dir, "events").select("event_id", dicts.show(merged).alias("merged"), dicts.show(dicts.remove(merged, "a")).alias("removed"))


@query("SELECT event_id, event_id BETWEEN 1000 AND 9000 AS bitrate, event_id % 3 < 2 AS verbose FROM events")
def option_values(spark, sf_dir):
    words = F.get(F.array(F.lit("on"), F.lit("no"), F.lit("maybe")), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", dicts.valid_option(F.col("event_id").cast("string"), dicts.Option(int, 2000, 1000, 9000)).alias("bitrate"), dicts.valid_option(words, dicts.Option(bool, False)).alias("verbose"))


def _adts(rows):
    """Headers from columns: rate index, channels and length from part, supplier and quantity."""
    rate, config, length = F.col("l_partkey") % 13, F.col("l_suppkey") % 8, F.col("l_partkey") % 8000 + 7
    fixed = 0xFFF1 << 40 | 1 << 38 | 31 << 8 | 0xFC  # sync word, no checksum, LC, full buffer, one block
    word = F.lit(fixed) + rate * (1 << 34) + config * (1 << 30) + length * (1 << 13)
    return rows.withColumn("b", octets.write_uint(word, 7))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, 'LC' AS profile, [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350][(l_partkey % 13 + 1)::INT]::INT AS sample_rate,
CASE WHEN l_suppkey % 8 = 7 THEN 8 ELSE l_suppkey % 8 END::INT AS channels, (l_partkey % 8000 + 7)::INT AS frame_length, (l_partkey % 8000)::INT AS payload_size FROM lineitem""")
def adts_header(spark, sf_dir):
    rows = _adts(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"))
    rows = rows.select("l_orderkey", "l_partkey", "l_suppkey", octets.read_uint(F.col("b"), 0, 7).alias("word"))
    rows = rows.withColumn("h", bits.adts_fields(F.col("word"), F.lit(False)))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "h.profile", "h.sample_rate", "h.channels", "h.frame_length", "h.payload_size")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, 'audio' AS media_type, 'aac' AS codec_id, 1 AS profile, [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350][(l_partkey % 13 + 1)::INT]::INT AS sample_rate,
CASE WHEN l_suppkey % 8 = 7 THEN 8 ELSE l_suppkey % 8 END::INT AS channels FROM lineitem""")
def adts_parameters(spark, sf_dir):
    """Codec parameters of the stream that each ADTS header starts."""
    rows = _adts(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"))
    rows = rows.select("l_orderkey", "l_partkey", "l_suppkey", octets.read_uint(F.col("b"), 0, 7).alias("word"))
    rows = rows.withColumn("p", bits.adts_parameters(bits.adts_fields(F.col("word"), F.lit(False))))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "p.media_type", "p.codec_id", "p.profile", "p.sample_rate", "p.channels")


@query("""SELECT l_orderkey, l_partkey, 'audio' AS media_type, 'opus' AS codec_id, 48000 AS sample_rate, CASE WHEN (l_partkey % 256)::INT & 4 <> 0 THEN 2 ELSE 1 END AS channels FROM lineitem""")
def opus_parameters(spark, sf_dir):
    """Codec parameters of the stream that each Opus packet starts."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", bits.opus_parameters(bits.opus_toc((F.col("l_partkey") % 256).cast("int"))).alias("p"))
    return rows.select("l_orderkey", "l_partkey", "p.media_type", "p.codec_id", "p.sample_rate", "p.channels")


@query("""SELECT event_id, k.unit_no::INT AS unit_no, (7 + (event_id + k.unit_no) % 20)::INT AS size FROM events, (SELECT unnest(range(0, 3)) AS unit_no) k""")
def adts_split(spark, sf_dir):
    """Junk, then three frames back to back, then one cut off."""
    def frame(k: int, whole: bool = True):
        n = F.lit(7) + (F.col("event_id") + k) % 20
        head = [F.lit(0xFF), F.lit(0xF1), F.lit(0x50), F.lit(0x80), F.call_function("div", n, F.lit(8)), n % 8 * 32 + 31, F.lit(0xFC)]
        return F.concat(*[octets.write_uint(x, 1) for x in head], *([octets.filled(0x11, (n - 7).cast("int"))] if whole else []))

    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit(b"\x01\x02"), *[frame(k) for k in range(3)], octets.filled(0xFF, 2)).alias("b"))
    return bits.split_units(rows, "b", bits.adts_frames).select("event_id", "unit_no", F.octet_length("unit").alias("size"))


_OPUS = "CASE WHEN c < 12 THEN [480, 960, 1920, 2880][c % 4 + 1] WHEN c < 16 THEN [480, 960][c % 2 + 1] ELSE [120, 240, 480, 960][c % 4 + 1] END"


@query(f"""WITH b AS (SELECT l_orderkey, l_partkey, (l_partkey % 256)::INT AS b, ((l_partkey % 256) >> 3)::INT AS c FROM lineitem)
SELECT l_orderkey, l_partkey, CASE WHEN c < 12 THEN 'SILK' WHEN c < 16 THEN 'Hybrid' ELSE 'CELT' END AS mode,
CASE WHEN c < 4 THEN 'NB' WHEN c < 8 THEN 'MB' WHEN c < 12 THEN 'WB' WHEN c < 14 THEN 'SWB' WHEN c < 16 THEN 'FB' WHEN c < 20 THEN 'NB' WHEN c < 24 THEN 'WB' WHEN c < 28 THEN 'SWB' ELSE 'FB' END AS bandwidth,
({_OPUS})::INT AS samples, b & 4 <> 0 AS stereo, b & 3 AS code FROM b""")
def opus_toc(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", bits.opus_toc((F.col("l_partkey") % 256).cast("int")).alias("t"))
    return rows.select("l_orderkey", "l_partkey", "t.mode", "t.bandwidth", "t.samples", "t.stereo", "t.code")


@query("""WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_partkey % 4 AS code, l_suppkey % 64 AS n FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN code = 0 THEN 1 WHEN code < 3 THEN 2 WHEN n > 0 THEN n END::INT AS frames FROM b""")
def opus_frame_count(spark, sf_dir):
    data = F.concat(octets.write_uint(F.col("l_partkey") % 256, 1), octets.write_uint(F.col("l_suppkey") % 64, 1))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", bits.opus_frame_count(data, "skip").alias("frames"))


@query("""WITH b AS (SELECT l_orderkey, l_partkey, (l_partkey % 256)::INT AS b, (l_partkey % 32)::INT AS t FROM lineitem)
SELECT l_orderkey, l_partkey, CASE WHEN t BETWEEN 1 AND 13 THEN ['Slice', 'SlicePartA', 'SlicePartB', 'SlicePartC', 'SliceIdr', 'Sei', 'Sps', 'Pps', 'Aud', 'EndSequence', 'EndStream', 'Filler', 'SpsExt'][t]
 WHEN t = 19 THEN 'AuxSlice' WHEN t = 20 THEN 'SliceExt' ELSE 'Unknown(' || t || ')' END AS name, (b >> 5) & 3 AS ref_idc, t IN (1, 2, 3, 4, 5, 19, 20) AS is_vcl, t = 5 AS is_idr FROM b""")
def nal_classify(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", bits.nal_type((F.col("l_partkey") % 256).cast("int")).alias("n"))
    return rows.select("l_orderkey", "l_partkey", "n.name", "n.ref_idc", "n.is_vcl", "n.is_idr")


_WORDS = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM documents)
SELECT doc_id, (i - 1)::INT AS unit_no, w AS word FROM w"""


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1).alias("w"))


@query(_WORDS)
def nal_annexb_split(spark, sf_dir):
    """Words as units between start codes of three and four bytes."""
    joined = F.array_join(F.transform("w", lambda w, i: F.concat(F.when(i % 2 == 0, "\x00\x00\x01").otherwise("\x00\x00\x00\x01"), w)), "")
    rows = _words(spark, sf_dir).select("doc_id", F.encode(joined, "utf-8").alias("b"))
    units = rows.select("doc_id", F.posexplode(bits.annex_b_pieces(F.col("b"))).alias("unit_no", "unit"))
    return units.select("doc_id", "unit_no", F.decode(F.encode("unit", "ISO-8859-1"), "utf-8").alias("word"))


@query(_WORDS)
def nal_avcc_split(spark, sf_dir):
    """Words as units behind four-byte lengths."""
    digits = F.array_join(F.transform("w", lambda w: F.concat(F.lpad(F.hex(F.octet_length(w).cast("long")), 8, "0"), F.hex(F.encode(w, "utf-8")))), "")
    rows = _words(spark, sf_dir).select("doc_id", F.unhex(digits).alias("b"))
    return bits.split_units(rows, "b", lambda data: bits.avcc_units(data, 4)).select("doc_id", "unit_no", F.decode("unit", "utf-8").alias("word"))


@query("SELECT p_partkey, 66::BIGINT AS profile, (p_size % 52)::BIGINT AS level, (p_partkey % 120 + 1) * 16 AS width, p_size::BIGINT * 16 AS height FROM part")
def sps_dimensions(spark, sf_dir):
    """Parameter sets written bit by bit in expressions from part columns, then parsed."""
    return bits.sps_info(_parameter_sets(spark, sf_dir), "b").select("p_partkey", "profile", "level", "width", "height")


@query("SELECT p_partkey, 'video' AS media_type, 'h264' AS codec_id, 66 AS profile, (p_size % 52)::INT AS level, ((p_partkey % 120 + 1) * 16)::INT AS width, (p_size * 16)::INT AS height FROM part")
def sps_parameters(spark, sf_dir):
    """Codec parameters of the stream that each parameter set describes."""
    rows = bits.sps_info(_parameter_sets(spark, sf_dir), "b")
    rows = rows.select("p_partkey", bits.sps_parameters(F.col("profile"), F.col("level"), F.col("width"), F.col("height")).alias("p"))
    return rows.select("p_partkey", "p.media_type", "p.codec_id", "p.profile", "p.level", "p.width", "p.height")


def _parameter_sets(spark, sf_dir):
    def ue(v):
        code = F.bin(v.cast("long") + 1)
        return F.concat(F.repeat(F.lit("0"), F.char_length(code) - 1), code)

    zero = F.lit("1")
    fields = F.concat(zero, zero, zero, F.lit("010"), F.lit("010"), F.lit("0"), ue(F.col("p_partkey") % 120), ue(F.col("p_size") - 1), F.lit("1"), F.lit("1"))
    padded = F.concat(fields, F.repeat(F.lit("0"), 128 - F.char_length(fields)))
    payload = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.lpad(F.conv(F.substring(padded, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")), "")
    data = F.concat(F.lit(b"\x67\x42\x00"), octets.write_uint(F.col("p_size") % 52, 1), F.unhex(payload))
    return table(spark, sf_dir, "part").select("p_partkey", data.alias("b"))
