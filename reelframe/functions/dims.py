"""Fixed tables: pixel formats, sample formats, channel layouts, codecs, NAL types, Opus configurations, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, components, bits a pixel, planes, log2 of chroma width and height, planar, alpha, hardware, bits a component.
PIXEL_FORMATS = (
    ("yuv420p", 3, 12, 3, 1, 1, True, False, False, 8),
    ("yuv422p", 3, 16, 3, 1, 0, True, False, False, 8),
    ("yuv444p", 3, 24, 3, 0, 0, True, False, False, 8),
    ("yuv420p10le", 3, 15, 3, 1, 1, True, False, False, 10),
    ("yuv420p10be", 3, 15, 3, 1, 1, True, False, False, 10),
    ("yuv422p10le", 3, 20, 3, 1, 0, True, False, False, 10),
    ("yuv444p10le", 3, 30, 3, 0, 0, True, False, False, 10),
    ("yuva420p", 4, 20, 4, 1, 1, True, True, False, 8),
    ("nv12", 3, 12, 2, 1, 1, True, False, False, 8),
    ("nv21", 3, 12, 2, 1, 1, True, False, False, 8),
    ("rgb24", 3, 24, 1, 0, 0, False, False, False, 8),
    ("bgr24", 3, 24, 1, 0, 0, False, False, False, 8),
    ("rgba", 4, 32, 1, 0, 0, False, True, False, 8),
    ("bgra", 4, 32, 1, 0, 0, False, True, False, 8),
    ("argb", 4, 32, 1, 0, 0, False, True, False, 8),
    ("abgr", 4, 32, 1, 0, 0, False, True, False, 8),
    ("gbrp", 3, 24, 3, 0, 0, True, False, False, 8),
    ("gray", 1, 8, 1, 0, 0, False, False, False, 8),
    ("gray16le", 1, 16, 1, 0, 0, False, False, False, 16),
    ("yuyv422", 3, 16, 1, 1, 0, False, False, False, 8),
    ("uyvy422", 3, 16, 1, 1, 0, False, False, False, 8),
    ("vaapi", 0, 0, 0, 0, 0, False, False, True, 0),
    ("d3d11", 0, 0, 0, 0, 0, False, False, True, 0),
    ("videotoolbox", 0, 0, 0, 0, 0, False, False, True, 0),
    ("cuda", 0, 0, 0, 0, 0, False, False, True, 0),
)
# Name and bytes a sample; planar twins end in p.
SAMPLE_BYTES = {"u8": 1, "s16": 2, "s32": 4, "flt": 4, "dbl": 8}
# Layouts and their channels.
LAYOUTS = {
    "mono": ("FC",),
    "stereo": ("FL", "FR"),
    "2.1": ("FL", "FR", "LFE"),
    "3.0": ("FL", "FR", "FC"),
    "quad": ("FL", "FR", "BL", "BR"),
    "5.0": ("FL", "FR", "FC", "BL", "BR"),
    "5.1": ("FL", "FR", "FC", "LFE", "BL", "BR"),
    "7.1": ("FL", "FR", "FC", "LFE", "BL", "BR", "SL", "SR"),
}
LAYOUT_ALIASES = {"surround": "3.0", "4.0": "quad"}
# Codecs by kind. Subtitle codecs are reported as audio.
CODECS = {
    "video": ("h264", "hevc", "vp8", "vp9", "av1", "png", "none"),
    "audio": ("pcm_s16le", "pcm_s16be", "pcm_f32le", "pcm_f32be", "pcm_u8", "flac", "aac", "opus", "mp3", "vorbis", "srt", "ass", "webvtt"),
}
# NAL unit types.
NAL_TYPES = {1: "Slice", 2: "SlicePartA", 3: "SlicePartB", 4: "SlicePartC", 5: "SliceIdr", 6: "Sei", 7: "Sps", 8: "Pps", 9: "Aud", 10: "EndSequence", 11: "EndStream", 12: "Filler", 13: "SpsExt", 19: "AuxSlice", 20: "SliceExt"}
NAL_PICTURE_TYPES = (1, 2, 3, 4, 5, 19, 20)
# ADTS sampling rates by index, AAC profiles by index.
ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
AAC_PROFILES = ("Main", "LC", "SSR", "LTP")
# Opus mode, bandwidth and frame sizes in samples at 48 kHz, for consecutive configurations.
OPUS_RUNS = (
    ("SILK", "NB", (480, 960, 1920, 2880)), ("SILK", "MB", (480, 960, 1920, 2880)), ("SILK", "WB", (480, 960, 1920, 2880)),
    ("Hybrid", "SWB", (480, 960)), ("Hybrid", "FB", (480, 960)),
    ("CELT", "NB", (120, 240, 480, 960)), ("CELT", "WB", (120, 240, 480, 960)), ("CELT", "SWB", (120, 240, 480, 960)), ("CELT", "FB", (120, 240, 480, 960)),
)
OPUS_RATES = {"NB": 8000, "MB": 12000, "WB": 16000, "SWB": 24000, "FB": 48000}


def pixel_formats(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(PIXEL_FORMATS)]
    return spark.createDataFrame(rows, "id int, name string, components int, bpp int, planes int, log2_cw int, log2_ch int, planar boolean, alpha boolean, hardware boolean, bpc int")


def sample_formats(spark: SparkSession) -> DataFrame:
    rows = [(n + p, b, p == "p", n in ("flt", "dbl"), n + "p", n) for p in ("", "p") for n, b in SAMPLE_BYTES.items()]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, name string, bytes_per_sample int, planar boolean, is_float boolean, to_planar string, to_interleaved string")


def channel_layouts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, list(c)) for i, (n, c) in enumerate(LAYOUTS.items())], "id int, name string, channels array<string>")


def codecs(spark: SparkSession) -> DataFrame:
    rows = [(n, kind) for kind, names in CODECS.items() for n in names]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, name string, media_type string")


def nal_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, k in NAL_PICTURE_TYPES, k == 5) for k, n in NAL_TYPES.items()], "type int, name string, is_vcl boolean, is_idr boolean")


def opus_configs(spark: SparkSession) -> DataFrame:
    rows = [(mode, band, n, OPUS_RATES[band]) for mode, band, sizes in OPUS_RUNS for n in sizes]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "config int, mode string, bandwidth string, samples int, band_rate int")


def layout_of(name: Column) -> Column:
    """Channels of a named layout, aliases included; null if unknown."""
    known = LAYOUTS | {a: LAYOUTS[n] for a, n in LAYOUT_ALIASES.items()}
    table = F.create_map(*[x for n, c in known.items() for x in (F.lit(n), F.array(*map(F.lit, c)))])
    return F.try_element_at(table, name)


def layout_name(channels: Column) -> Column:
    """Name of a layout, or its channels joined by +."""
    found = F.coalesce(*[F.when(channels == F.array(*map(F.lit, c)), n) for n, c in LAYOUTS.items()])
    return F.coalesce(found, F.array_join(channels, "+"))


def buffer_size(bytes_per_sample: Column, planar: Column, samples: Column, channels: Column) -> Column:
    """Bytes of one plane if planar, else of all channels."""
    return (bytes_per_sample * samples * F.when(planar, 1).otherwise(channels)).cast("long")


def _shifted_up(value: Column, bits: Column) -> Column:
    scale = F.pow(F.lit(2), bits).cast("int")
    return F.call_function("div", value + scale - 1, scale)


def image_line_size(width: Column, plane: Column, components: Column, planes: Column, log2_cw: Column, planar: Column, bpc: Column, align: int = 1) -> Column:
    """Bytes of a line: chroma planes are narrower, over 8 bits take two bytes, packed ones hold all components.

    As in the formula this follows, second planes of NV12 count half a width and packed 4:2:2 counts three
    components a pixel. ``align`` is a power of two. A plane that isn't there is null.
    """
    wide = F.when(planar & plane.isin(1, 2), _shifted_up(width, log2_cw)).otherwise(width)
    size = wide * F.when(bpc > 8, 2).otherwise(1) * F.when(planar, 1).otherwise(components)
    return F.when(plane < planes, (F.call_function("div", size + (align - 1), F.lit(align)) * align).cast("long"))


def image_buffer_size(width: Column, height: Column, components: Column, planes: Column, log2_cw: Column, log2_ch: Column, planar: Column, bpc: Column, align: int = 1) -> Column:
    """Bytes of all planes."""
    tall = lambda p: F.when(planar & p.isin(1, 2), _shifted_up(height, log2_ch)).otherwise(height)
    one = lambda s, p: s + image_line_size(width, p, components, planes, log2_cw, planar, bpc, align) * tall(p)
    return F.when(planes > 0, F.aggregate(F.sequence(F.lit(0), planes - 1), F.lit(0).cast("long"), one)).otherwise(F.lit(0).cast("long"))
