"""Elementary bitstreams: ADTS and Opus headers and NAL types as expressions; NAL, SPS and ADTS framing in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.errors import FAIL, reject
from reelframe.functions.dims import AAC_PROFILES, ADTS_RATES, NAL_PICTURE_TYPES, NAL_TYPES, OPUS_RATES, OPUS_RUNS
from reelframe.functions.octets import byte_at, read_uint

ADTS = "struct<profile:string,sample_rate_index:int,sample_rate:int,channel_config:int,channels:int,frame_length:int,has_crc:boolean,header_size:int,payload_size:int>"
#: What a parsed header says of its stream.
PARAMETERS = "struct<media_type:string,codec_id:string,profile:int,level:int,width:int,height:int,sample_rate:int,channels:int>"


def _table(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _parameters(media_type: str, codec_id: str, **known: Column) -> Column:
    names = [f.split(":")[0] for f in PARAMETERS.removeprefix("struct<").removesuffix(">").split(",")]
    given = {"media_type": F.lit(media_type), "codec_id": F.lit(codec_id)} | known
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in names]).cast(PARAMETERS)


def adts_parameters(header: Column) -> Column:
    """Codec parameters of a stream from one of its `adts_header`; null of null."""
    profile = F.array_position(_table(AAC_PROFILES), header["profile"]) - 1
    return F.when(header.isNotNull(), _parameters("audio", "aac", profile=profile, sample_rate=header["sample_rate"], channels=header["channels"]))


def opus_parameters(toc: Column) -> Column:
    """Codec parameters of a stream from its first packet's `opus_toc`: the clock is 48 kHz whatever the band."""
    return F.when(toc.isNotNull(), _parameters("audio", "opus", sample_rate=F.lit(48_000), channels=F.when(toc["stereo"], 2).otherwise(1)))


def sps_parameters(profile: Column, level: Column, width: Column, height: Column) -> Column:
    """Codec parameters of a stream from the columns of `sps_info`; null where the set didn't parse."""
    return F.when(width.isNotNull(), _parameters("video", "h264", profile=profile, level=level, width=width, height=height))


def adts_header(data: Column, mode: str = FAIL) -> Column:
    """Header of an ADTS frame from its first seven bytes.

    Too few bytes, no sync word, a reserved rate and a frame shorter than its header are errors. The frame's
    length is compared as a whole number.
    """
    return adts_fields(read_uint(data, 0, 7), data.isNull(), mode)


def adts_fields(word: Column, missing: Column, mode: str = FAIL) -> Column:
    """`adts_header` of the first seven bytes as one number (null: too few), which is best a column of its own, as
    every field is cut from it."""
    cut = lambda shift, mask: F.shiftrightunsigned(word, shift).bitwiseAND(mask).cast("int")
    profile, rate, config, length = cut(38, 3), cut(34, 15), cut(30, 7), cut(13, 0x1FFF)
    crc = cut(40, 1) == 0
    header = F.when(crc, 9).otherwise(7)
    channels = F.when(config == 7, 8).otherwise(config)
    made = F.struct(F.get(_table(AAC_PROFILES), profile).alias("profile"), rate.alias("sample_rate_index"), F.get(_table(ADTS_RATES), rate).alias("sample_rate"), config.alias("channel_config"), channels.alias("channels"), length.alias("frame_length"), crc.alias("has_crc"), header.alias("header_size"), F.greatest(length - header, F.lit(0)).alias("payload_size")).cast(ADTS)
    sound = word.isNotNull() & (cut(44, 0xFFF) == 0xFFF) & (rate < len(ADTS_RATES)) & (length >= header)
    return F.when(missing, F.lit(None).cast(ADTS)).when(sound, made).otherwise(reject("invalid ADTS header", ADTS, mode))


def opus_toc(byte: Column) -> Column:
    """``struct<config,mode,bandwidth,samples,band_rate,frame_ms,stereo,code>`` of a packet's first byte."""
    configs = [(mode, band, n) for mode, band, sizes in OPUS_RUNS for n in sizes]
    config = F.shiftright(byte, 3)
    at = lambda i: F.get(_table([c[i] for c in configs]), config)
    rate = F.get(_table([OPUS_RATES[c[1]] for c in configs]), config)
    return F.struct(config.alias("config"), at(0).alias("mode"), at(1).alias("bandwidth"), at(2).alias("samples"), rate.alias("band_rate"), (at(2) / 48.0).cast("float").alias("frame_ms"), (byte.bitwiseAND(4) != 0).alias("stereo"), byte.bitwiseAND(3).alias("code"))


def opus_frame_count(data: Column, mode: str = FAIL) -> Column:
    """1 for code 0, 2 for codes 1 and 2, the second byte's lower six bits for code 3 (0 and none are errors)."""
    code, second = byte_at(data, 0).bitwiseAND(3), byte_at(data, 1).bitwiseAND(0x3F)
    bad = reject("invalid Opus frame count", "int", mode)
    return F.when(data.isNull(), F.lit(None).cast("int")).when(F.octet_length(data) == 0, bad).when(code == 0, 1).when(code < 3, 2).when(F.coalesce(second, F.lit(0)) > 0, second).otherwise(bad)


def nal_type(byte: Column) -> Column:
    """``struct<type,name,ref_idc,is_vcl,is_idr>`` of a unit's first byte."""
    kind = byte.bitwiseAND(31)
    table = F.create_map(*[x for k, n in NAL_TYPES.items() for x in (F.lit(k), F.lit(n))])
    name = F.coalesce(F.try_element_at(table, kind), F.concat(F.lit("Unknown("), kind.cast("string"), F.lit(")")))
    return F.struct(kind.alias("type"), name.alias("name"), F.shiftright(byte, 5).bitwiseAND(3).alias("ref_idc"), kind.isin(*NAL_PICTURE_TYPES).alias("is_vcl"), (kind == 5).alias("is_idr"))


def annex_b_units(data: bytes) -> Iterator[bytes]:
    """Units between start codes of three or four bytes; empty ones and what stands before the first are dropped."""
    units = data.split(b"\x00\x00\x01")[1:]
    if b"\x00\x00\x00\x01" in data:  # a zero before a start code belongs to it
        units[:-1] = [u[:-1] if u.endswith(b"\x00") else u for u in units[:-1]]
    return filter(None, units)


def annex_b_pieces(data: Column) -> Column:
    """`annex_b_units` of a binary column as an array of strings, without Python: bytes stand for the first 256
    characters. Explode it, then encode each as ISO-8859-1."""
    # a zero before a start code belongs to it; what stands before the first one is dropped
    pieces = F.slice(F.split(F.decode(data, "ISO-8859-1"), r"\x00?\x00\x00\x01", -1), 2, 2147483640)
    return F.when(F.array_contains(pieces, ""), F.array_remove(pieces, "")).otherwise(pieces)


def annex_b_column(data: Column) -> Column:
    """`annex_b_units` of a binary column as an array of binaries."""
    return F.transform(annex_b_pieces(data), lambda u: F.encode(u, "ISO-8859-1"))


def avcc_units(data: bytes, width: int) -> Iterator[bytes]:
    """Units after big-endian lengths of ``width`` bytes; empty ones are passed over, a length beyond the end is an error."""
    if width not in (1, 2, 3, 4):
        raise ValueError("lengths have one to four bytes")
    at = 0
    while at + width <= len(data):
        n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + n > len(data):
            raise ValueError("a unit is cut off")
        if n:
            yield data[at : at + n]
        at += n


def adts_frames(data: bytes) -> Iterator[bytes]:
    """Frames from sync word to sync word; a bad header is an error, a frame cut off at the end is dropped."""
    at = 0
    while at + 7 <= len(data):
        if data[at] != 0xFF or data[at + 1] & 0xF0 != 0xF0:
            at += 1
            continue
        n = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        if data[at + 2] >> 2 & 15 >= len(ADTS_RATES) or n < (7 if data[at + 1] & 1 else 9):
            raise ValueError("invalid ADTS header")
        if at + n > len(data):
            return
        yield data[at : at + n]
        at += n


def split_units(rows: DataFrame, data: str, split: Callable[[bytes], Iterator[bytes]], mode: str = FAIL) -> DataFrame:
    """A row per unit of the binary column ``data``: other columns, ``unit_no`` from 0, ``unit``.

    Null and empty data give none; data that doesn't parse stops the query or gives none (``skip``).
    """
    kept = [c for c in rows.columns if c != data]
    schema = rows.select(*kept).schema.add("unit_no", "integer").add("unit", "binary")

    def run(batches):
        for batch in batches:
            index, number, units = [], [], []
            for i, raw in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                try:
                    found = list(split(raw or b""))
                except ValueError:
                    if mode == FAIL:
                        raise
                    found = []
                index += [i] * len(found)
                number += range(len(found))
                units += found
            taken = [batch.column(c).take(pa.array(index, pa.int64())) for c in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(number, pa.int32()), pa.array(units, pa.binary())], names=schema.names)

    return rows.select(*kept, data).mapInArrow(run, schema)


class BitReader:
    """Bits from the highest of each byte, and Exp-Golomb numbers."""

    def __init__(self, data: bytes):
        self.bits, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, n: int) -> int:
        if n > self.left:
            raise ValueError("the data ends")
        self.left -= n
        return self.bits >> self.left & ((1 << n) - 1)

    def ue(self) -> int:
        zeros = 0
        while not self.read(1):
            zeros += 1
            if zeros > 31:
                raise ValueError("an Exp-Golomb number is too long")
        return (1 << zeros | self.read(zeros)) - 1

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


# Profiles whose parameter sets describe chroma.
CHROMA_PROFILES = (100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135)


def sps_fields(unit: bytes) -> tuple[int, int, int, int, int]:
    """Profile, level, id, width and height of a sequence parameter set, header byte first, without cropping."""
    r = BitReader(unit[1:])
    profile, _, level, number = r.read(8), r.read(8), r.read(8), r.ue()
    if profile in CHROMA_PROFILES:
        chroma = r.ue()
        if chroma == 3:
            r.read(1)
        r.ue(), r.ue(), r.read(1)
        if r.read(1):
            for i in range(12 if chroma == 3 else 8):
                if r.read(1):  # a scaling list: 4x4 for the first six, 8x8 after
                    last = following = 8
                    for _ in range(16 if i < 6 else 64):
                        if following:
                            following = (last + r.se()) % 256
                        last = following or last
    r.ue()
    order = r.ue()
    if order == 0:
        r.ue()
    elif order == 1:
        r.read(1), r.se(), r.se()
        for _ in range(r.ue()):
            r.se()
    r.ue(), r.read(1)
    width, units = r.ue() + 1, r.ue() + 1
    return profile, level, number, 16 * width, (2 - r.read(1)) * units * 16


def sps_info(rows: DataFrame, data: str, mode: str = FAIL) -> DataFrame:
    """``rows`` with profile, level, sps_id, width, height; null where ``skip`` and the set doesn't parse."""
    names = ("profile", "level", "sps_id", "width", "height")
    schema = T.StructType(list(rows.schema.fields))  # a copy: add changes its object
    for n in names:
        schema = schema.add(n, "long")
    place = rows.columns.index(data)

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(place).to_pylist():
                try:
                    out.append(sps_fields(raw or b""))
                except ValueError:
                    if mode == FAIL:
                        raise
                    out.append((None,) * 5)
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in cols)], names=schema.names)

    return rows.mapInArrow(run, schema)
