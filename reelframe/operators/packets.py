"""Packets, frames, streams and codec parameters as rows, and the transcoding job over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.errors import FAIL, reject
from reelframe.functions import timebase
from reelframe.functions.octets import crc32_before, swap_groups
from reelframe.operators import timeline

FLAGS = "struct<keyframe:boolean,corrupt:boolean,discard:boolean>"
PACKET = f"path string, stream_index int, seq long, pts long, dts long, duration long, time_base {timebase.RATIONAL}, flags {FLAGS}, pos long, side_data map<string,binary>, data binary"
MAX_PLANES = 8


def new_packet(data: Column) -> list[Column]:
    """Columns of a packet that is only data: no times, unknown time base, position -1."""
    none = lambda t: F.lit(None).cast(t)
    off = F.struct(*[F.lit(False).alias(n) for n in ("keyframe", "corrupt", "discard")])
    return [data.alias("data"), none("long").alias("pts"), none("long").alias("dts"), none("long").alias("duration"), timebase.rational(0, 0).alias("time_base"), F.lit(0).alias("stream_index"), off.alias("flags"), F.lit(-1).cast("long").alias("pos"), F.create_map().cast("map<string,binary>").alias("side_data")]


def packet_size(data: Column) -> Column:
    return F.coalesce(F.octet_length(data), F.lit(0))


def rescale_packets(packets: DataFrame, target: Column, rounding: str = "near", mode: str = FAIL) -> DataFrame:
    """pts, dts and duration in another time base; unknown ones stay unknown."""
    tb = F.col("time_base")
    factors = {"__up": tb["num"].cast("long") * target["den"].cast("long"), "__down": tb["den"].cast("long") * target["num"].cast("long"), "__known": timebase.is_valid(tb) & timebase.is_valid(target)}
    unknown = reject("invalid time base", "long", mode)
    one = lambda c: F.when(F.col(c).isNull(), F.lit(None).cast("long")).when(F.col("__known"), timebase.rescale(F.col(c), F.col("__up"), F.col("__down"), rounding, mode)).otherwise(unknown)
    # the factors are columns of their own, so that the three times share them
    return packets.withColumns(factors).withColumns({c: one(c) for c in ("pts", "dts", "duration")}).withColumn("time_base", target).drop(*factors)


def known_streams(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """Packets of streams that exist; others are passed over."""
    return packets.join(streams.select("path", F.col("index").alias("stream_index")), ["path", "stream_index"], "left_semi")


def new_video_frame(width: Column, height: Column, mode: str = FAIL) -> Column:
    """``struct<media_type,width,height,planes>``; sides must be positive."""
    kind = "struct<media_type:string,width:int,height:int,planes:array<binary>>"
    planes = F.array_repeat(F.lit(None).cast("binary"), MAX_PLANES)
    made = F.struct(F.lit("video").alias("media_type"), width.cast("int").alias("width"), height.cast("int").alias("height"), planes.alias("planes"))
    return F.when((width > 0) & (height > 0), made.cast(kind)).otherwise(reject("frame without size", kind, mode))


def new_audio_frame(sample_rate: Column, channels: Column, samples: Column, mode: str = FAIL) -> Column:
    """``struct<media_type,sample_rate,channels,samples,planes>``; rate and channels must be positive."""
    kind = "struct<media_type:string,sample_rate:int,channels:int,samples:int,planes:array<binary>>"
    planes = F.array_repeat(F.lit(None).cast("binary"), MAX_PLANES)
    made = F.struct(F.lit("audio").alias("media_type"), sample_rate.cast("int").alias("sample_rate"), channels.cast("int").alias("channels"), samples.cast("int").alias("samples"), planes.alias("planes"))
    return F.when((sample_rate > 0) & (channels > 0), made.cast(kind)).otherwise(reject("frame without rate or channels", kind, mode))


def reset_frame(frame: Column) -> Column:
    """The frame without its planes; kind and sizes stay."""
    return frame.withField("planes", F.array_repeat(F.lit(None).cast("binary"), MAX_PLANES))


def reset_packets(packets: DataFrame) -> DataFrame:
    """Packets as new ones: no data, times, flags, position or side data; other columns stay."""
    fresh = dict(zip(("data", "pts", "dts", "duration", "time_base", "stream_index", "flags", "pos", "side_data"), new_packet(F.lit(b""))))
    return packets.withColumns({n: c for n, c in fresh.items() if n in packets.columns})


#: Codec parameters and streams as rows.
CODEC_PARAMETERS = f"struct<codec_id:string,media_type:string,extradata:binary,bit_rate:long,width:int,height:int,pixel_format:string,frame_rate:{timebase.RATIONAL},sample_aspect_ratio:{timebase.RATIONAL},sample_format:string,sample_rate:int,channel_layout:array<string>,channels:int,frame_size:int>"
DISPOSITION = "struct<default:boolean,attached_pic:boolean,forced:boolean,hearing_impaired:boolean,visual_impaired:boolean>"


def codec_parameters(**known: Column) -> Column:
    """Parameters with what is known; by default video of no codec, sizes and rates 0, square pixels."""
    none = F.lit(None)
    zero = F.lit(0)
    values = {
        "codec_id": F.lit("none"), "media_type": F.lit("video"), "extradata": none.cast("binary"), "bit_rate": zero.cast("long"), "width": zero, "height": zero,
        "pixel_format": none.cast("string"), "frame_rate": timebase.rational(0, 0), "sample_aspect_ratio": timebase.rational(1, 1), "sample_format": none.cast("string"),
        "sample_rate": zero, "channel_layout": none.cast("array<string>"), "channels": zero, "frame_size": zero,
    } | known
    return F.struct(*[c.alias(n) for n, c in values.items()]).cast(CODEC_PARAMETERS)


def video_parameters(codec_id: Column, width: Column, height: Column, mode: str = FAIL) -> Column:
    """Parameters of a video stream; sides must be positive."""
    made = codec_parameters(codec_id=codec_id, width=width, height=height)
    return F.when((width > 0) & (height > 0), made).otherwise(reject("video without size", CODEC_PARAMETERS, mode))


def audio_parameters(codec_id: Column, sample_rate: Column, channels: Column, mode: str = FAIL) -> Column:
    """Parameters of an audio stream; rate and channels must be positive."""
    made = codec_parameters(codec_id=codec_id, media_type=F.lit("audio"), sample_rate=sample_rate, channels=channels)
    return F.when((sample_rate > 0) & (channels > 0), made).otherwise(reject("audio without rate or channels", CODEC_PARAMETERS, mode))


def new_stream(index: Column, parameters: Column, disposition: tuple[str, ...] = ()) -> Column:
    """A stream of which only number and parameters are known: no duration or frames, unknown time base."""
    flags = [n.split(":")[0] for n in DISPOSITION.removeprefix("struct<").removesuffix(">").split(",")]
    if unknown := set(disposition) - set(flags):
        raise ValueError(f"unknown disposition {sorted(unknown)}")
    marks = F.struct(*[F.lit(n in disposition).alias(n) for n in flags])
    return F.struct(index.cast("int").alias("index"), parameters.alias("parameters"), timebase.rational(0, 0).alias("time_base"), F.lit(None).cast("long").alias("duration"), F.lit(None).cast("long").alias("nb_frames"), F.create_map().cast("map<string,string>").alias("metadata"), marks.alias("disposition"))


def set_plane(planes: Column, index: int, data: Column) -> Column:
    if not 0 <= index < MAX_PLANES:
        raise ValueError("a frame has eight planes")
    return F.transform(planes, lambda p, i: F.when(i == index, data).otherwise(p))


def plane_count(planes: Column) -> Column:
    return F.size(F.filter(planes, lambda p: p.isNotNull()))


def channel_count(layout: Column, channels: Column) -> Column:
    """Channels of the layout if there is one, else the plain number."""
    return F.coalesce(F.when(F.size(layout) > 0, F.size(layout)), channels)


def crc32_fold(pieces: DataFrame, keys: list[str], order: list, data: str, span: Column | None = None) -> DataFrame:
    """``(*keys, crc long, bytes long)``: the CRC-32 of each stream's pieces, one after another in ``order``.

    A piece is hashed where it lies, and only its CRC and length are moved: with what follows it they say what it adds
    to the whole's CRC, and these are joined by exclusive or in any order. Null pieces are empty. ``span``: see
    `timeline.running_start`; it must not look at ``data``.
    """
    whole = F.coalesce(F.col(data), F.lit(b""))
    names = [c for c in pieces.columns if c != data]
    short = pieces.select(*names, F.crc32(whole).alias("__crc"), F.octet_length(whole).cast("long").alias("__n"))
    placed = timeline.running_start(short, keys, order, "__n", "__from", span)
    totals = short.groupBy(*keys).agg(F.sum("__n").alias("__all")).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__all")
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rest = F.col("__all") - F.col("__from") - F.col("__n")
    return placed.join(totals, met).groupBy(*keys).agg(F.bit_xor(crc32_before(F.col("__crc"), rest)).alias("crc"), F.sum("__n").alias("bytes"))


#: PCM codecs: bytes a sample and whether the high byte comes first.
PCM = {"pcm_u8": (1, False), "pcm_s16le": (2, False), "pcm_s16be": (2, True), "pcm_f32le": (4, False), "pcm_f32be": (4, True)}


def pcm_decode(data: Column, codec: str) -> Column:
    """Native (little-endian) samples of a packet; a short last sample stays as it is."""
    width, big = PCM[codec]
    return swap_groups(data, width) if big else data


#: Encoding is the same exchange of bytes.
pcm_encode = pcm_decode


def frame_samples(data: Column, codec: str, channels: Column) -> Column:
    return F.call_function("div", F.octet_length(data), PCM[codec][0] * channels).cast("long")


class Registry:
    """Codecs by name: the first registration of a name is the one found. Compressed ones are known but unsupported."""

    def __init__(self):
        self.decoders: dict[str, Callable[[Column], Column]] = {}
        self.encoders: dict[str, Callable[[Column], Column]] = {}

    def register(self, name: str, decode: Callable[[Column], Column] | None = None, encode: Callable[[Column], Column] | None = None) -> None:
        if decode is not None:
            self.decoders.setdefault(name, decode)
        if encode is not None:
            self.encoders.setdefault(name, encode)

    def decoder(self, name: str) -> Callable[[Column], Column]:
        if name not in self.decoders:
            raise LookupError(f"no decoder for {name}")
        return self.decoders[name]

    def encoder(self, name: str) -> Callable[[Column], Column]:
        if name not in self.encoders:
            raise LookupError(f"no encoder for {name}")
        return self.encoders[name]


def _unsupported(name: str) -> Callable[[Column], Column]:
    def refuse(_: Column) -> Column:
        raise NotImplementedError(f"{name} can't be decoded")

    return refuse


def default_registry() -> Registry:
    registry = Registry()
    for name in PCM:
        registry.register(name, lambda c, n=name: pcm_decode(c, n), lambda c, n=name: pcm_encode(c, n))
    for name in ("h264", "hevc", "vp8", "vp9", "av1", "aac", "opus", "flac", "mp3", "vorbis"):
        registry.register(name, _unsupported(name))
    return registry


def transcode(packets: DataFrame, streams: DataFrame, codecs: dict[str, str] | None = None, registry: Registry | None = None) -> DataFrame:
    """Decode and encode every packet of a known stream; ``codecs`` maps a stream's codec to its new one.

    ``streams(path, index, codec_id)``. Times pass through. The codecs in use are looked up before anything runs,
    so one that isn't supported fails at once. Which streams there are comes from their table, once per codec.
    """
    registry, codecs = registry or default_registry(), codecs or {}
    used = sorted(r[0] for r in streams.select("codec_id").distinct().collect())  # at most one row a known codec
    step = {c: (registry.decoder(c), registry.encoder(codecs.get(c, c))) for c in used}
    joined = packets.join(streams.select("path", F.col("index").alias("stream_index"), "codec_id"), ["path", "stream_index"])
    data = F.coalesce(*[F.when(F.col("codec_id") == c, encode(decode(F.col("data")))) for c, (decode, encode) in step.items()], F.lit(None).cast("binary"))
    target = F.coalesce(*[F.when(F.col("codec_id") == c, F.lit(codecs.get(c, c))) for c in used], F.lit(None).cast("string"))
    return joined.withColumn("data", data).withColumn("codec_id", target)


def chain(*filters: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Bitstream filters one after another."""

    def run(packets: DataFrame) -> DataFrame:
        for step in filters:
            packets = packets.transform(step)
        return packets

    return run
