"""Bytes: endian reads and writes, checksums, base64, fills, PCM, side data — built-in expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.errors import FAIL, reject


def _col(x) -> Column:
    return F.lit(x) if isinstance(x, (int, str, bytes)) else x


def take(data: Column, offset, length) -> Column:
    """``length`` bytes from ``offset`` (from 0)."""
    return F.substring(data, _col(offset) + 1, _col(length))


def byte_at(data: Column, offset) -> Column:
    """The byte at ``offset`` as an int; null beyond the end."""
    return F.conv(F.nullif(F.hex(take(data, offset, 1)), F.lit("")), 16, 10).cast("int")


def swap_groups(data: Column, width: int) -> Column:
    """Bytes of each full group of ``width`` in reverse; a shorter tail stays as it is."""
    digits = F.hex(data)
    turned = F.regexp_replace(digits, "(..)" * width, "".join(f"${i}" for i in range(width, 0, -1)))
    return F.unhex(turned)


def read_uint(data: Column, offset, width: int, little: bool = False) -> Column:
    """Unsigned number of 1 to 7 bytes as a long; null if fewer are there."""
    piece = take(data, offset, width)
    piece = F.when(F.octet_length(piece) == width, swap_groups(piece, width) if little and width > 1 else piece)
    return F.conv(F.hex(piece), 16, 10).cast("long")


def read_u64(data: Column, offset, little: bool = False) -> Column:
    """Unsigned 64-bit number as decimal(20,0)."""
    piece = take(data, offset, 8)
    piece = F.when(F.octet_length(piece) == 8, swap_groups(piece, 8) if little else piece)
    return F.conv(F.hex(piece), 16, 10).cast("decimal(20,0)")


def write_uint(value: Column, width: int, little: bool = False) -> Column:
    """Lowest ``width`` bytes of a long."""
    digits = F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * width))
    data = F.unhex(digits)
    return swap_groups(data, width) if little and width > 1 else data


def crc32_hex(data: Column) -> Column:
    """IEEE CRC-32 as eight lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.crc32(data)), 8, "0"))


def _crc_shifts() -> list[int]:
    """For k from 0 to 47 what each of the 32 bits of a CRC becomes when 2^k zero bytes follow."""
    step = lambda c: c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    row, out = [1 << j for j in range(32)], []
    for _ in range(8):
        row = [step(c) for c in row]
    for _ in range(48):
        out += row
        square = []
        for c in row:  # twice as many zeros: the same map once more
            total = 0
            for j in range(32):
                total ^= row[j] if c >> j & 1 else 0
            square.append(total)
        row = square
    return out


def crc32_before(crc: Column, following: Column) -> Column:
    """What a piece's CRC-32 adds to the whole's when ``following`` bytes come after it.

    The CRC of a text is the exclusive or of these over its pieces, in any order.
    """
    shifts = F.array(*map(F.lit, _crc_shifts()))
    bits = F.filter(F.sequence(F.lit(0), F.lit(47)), lambda k: F.getbit(following, k) == 1)
    through = lambda c, k: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda r, j: r.bitwiseXOR(F.when(F.getbit(c, j) == 1, F.get(shifts, k * 32 + j)).otherwise(F.lit(0).cast("long"))))
    return F.aggregate(bits, crc.cast("long"), through)


def base64_encode(data: Column) -> Column:
    """Standard alphabet, padded, never broken into lines whatever the session says."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def base64_decode(text: Column, mode: str = FAIL) -> Column:
    """White space inside is passed over, padding at the end is optional, and left-over bits are dropped.

    Text that is written out plainly goes straight to the built-in function. ``text`` is best a column of its own.
    """
    body = F.translate(text, "= \t\r\n\f", "")
    sound = F.regexp_like(text, F.lit(r"^[A-Za-z0-9+/ \t\r\n\f]*=*\z"))
    whole = F.char_length(body) - F.when(F.char_length(body) % 4 == 1, 1).otherwise(0)
    padded = F.rpad(F.left(body, whole), (F.ceil(whole / 4) * 4).cast("int"), "=")
    plain = (F.char_length(text) % 4 == 0) & F.regexp_like(text, F.lit(r"^[A-Za-z0-9+/]*={0,2}\z"))
    return F.when(text.isNull(), F.lit(None).cast("binary")).when(plain, F.unbase64(text)).when(sound, F.unbase64(padded)).otherwise(reject("invalid base64", "binary", mode))


def filled(byte: int, length) -> Column:
    return F.unhex(F.repeat(F.lit(f"{byte:02X}"), _col(length)))


def silence(sample_format: Column, length) -> Column:
    """Unsigned 8-bit audio rests at 0x80, every other format at 0."""
    return F.when(sample_format.isin("u8", "u8p"), filled(0x80, length)).otherwise(filled(0, length))


def black_plane(is_yuv: Column, plane: Column, line_size: Column, height: Column) -> Column:
    """Chroma planes of YUV rest at 128, everything else at 0."""
    return F.when(is_yuv & (plane > 0), filled(128, line_size * height)).otherwise(filled(0, line_size * height))


def resized(data: Column, length) -> Column:
    """Cut or filled up with zero bytes."""
    short = F.greatest(_col(length) - F.octet_length(data), F.lit(0))
    return F.concat(F.substring(data, F.lit(1), F.least(_col(length), F.octet_length(data))), filled(0, short))


def copied(source: Column, target: Column, length, mode: str = FAIL) -> Column:
    """The first ``length`` bytes of ``source`` over those of ``target``; both must have so many."""
    fits = (F.octet_length(source) >= _col(length)) & (F.octet_length(target) >= _col(length))
    return F.when(fits, F.concat(take(source, 0, length), F.substring(target, _col(length) + 1, F.octet_length(target)))).otherwise(reject("copy beyond a plane", "binary", mode))


def alloc_samples(planar: Column, channels: Column, bytes_per_channel: Column) -> Column:
    """Zeroed planes: one a channel if planar, else one for all."""
    return F.when(planar, F.array_repeat(filled(0, bytes_per_channel), channels)).otherwise(F.array(filled(0, bytes_per_channel * channels)))


def put_side_data(data: Column, kind, value: Column) -> Column:
    """Add or replace one entry of ``map<string,binary>``."""
    return F.map_concat(F.map_filter(F.coalesce(data, F.create_map().cast("map<string,binary>")), lambda k, _: k != _col(kind)), F.create_map(_col(kind), value))


def drop_side_data(data: Column, kind) -> Column:
    return F.map_filter(data, lambda k, _: k != _col(kind))


def get_side_data(data: Column, kind) -> Column:
    return F.try_element_at(data, _col(kind))


def pcm_s16_samples(data: Column) -> Column:
    """Little-endian signed 16-bit samples as an array; an odd last byte is left out."""
    digits = F.hex(data)
    n = F.floor(F.octet_length(data) / 2).cast("int")
    one = lambda i: F.conv(F.concat(F.substring(digits, i * 4 + 3, F.lit(2)), F.substring(digits, i * 4 + 1, F.lit(2))), 16, 10).cast("int")
    signed = lambda x: F.when(x >= 32768, x - 65536).otherwise(x)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: signed(one(i)))).otherwise(F.array().cast("array<int>"))


def wav_probe(data: Column) -> Column:
    return F.when((F.octet_length(data) >= 12) & (take(data, 0, 4) == F.lit(b"RIFF")) & (take(data, 8, 4) == F.lit(b"WAVE")), 90).otherwise(0)


def mp4_probe(data: Column) -> Column:
    kind = take(data, 4, 4)
    return F.when(F.octet_length(data) < 8, 0).when(kind == F.lit(b"ftyp"), 95).when(kind.isin(b"moov", b"free", b"mdat"), 50).otherwise(0)


def probe(data: Column) -> Column:
    """The format with the highest score above 0, of equals the first listed: ``struct<format,score>``, else null."""
    entries = F.array(F.struct(F.lit("wav").alias("format"), wav_probe(data).alias("score"), F.lit(0).alias("order")), F.struct(F.lit("mp4").alias("format"), mp4_probe(data).alias("score"), F.lit(-1).alias("order")))
    best = F.array_max(F.transform(entries, lambda e: F.struct(e["score"].alias("score"), e["order"].alias("order"), e["format"].alias("format"))))
    return F.when(best["score"] > 0, F.struct(best["format"].alias("format"), best["score"].alias("score")))
