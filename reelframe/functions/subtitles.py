"""Subtitle files as cues: times, tags, and whole-file parsing for the three dialects."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUES = "cue_no int, start_ms long, end_ms long, text string"
_DIGITS = r"^\+?[0-9]+\z"


def _number(x: Column) -> Column:
    """An unsigned whole number without spaces, else null."""
    return F.when(F.regexp_like(x, F.lit(_DIGITS)), x.try_cast("long"))


def _clock(h: Column, m: Column, s: Column, ms: Column) -> Column:
    return (h * 60 + m) * 60_000 + s * 1000 + ms


def srt_time(text: Column) -> Column:
    """``H:M:S,ms`` or ``H:M:S.ms`` in milliseconds; the last field is taken as a number as it stands."""
    p = F.split(F.trim(F.replace(text, F.lit(","), F.lit("."))), ":")
    last = F.split(F.get(p, F.lit(2)), r"\.")
    ok = (F.size(p) == 3) & (F.size(last) == 2)
    return F.when(ok, _clock(_number(F.get(p, F.lit(0))), _number(F.get(p, F.lit(1))), _number(F.get(last, F.lit(0))), _number(F.get(last, F.lit(1)))))


def ass_time(text: Column) -> Column:
    """``H:MM:SS.cc``: one digit of hundredths is tenths, more than two are cut."""
    p = F.split(F.trim(text), ":")
    last = F.split(F.get(p, F.lit(2)), r"\.")
    ok = (F.size(p) == 3) & (F.size(last) == 2)
    cs = _number(F.rpad(F.left(F.get(last, F.lit(1)), F.lit(2)), 2, "0"))
    return F.when(ok, _clock(_number(F.get(p, F.lit(0))), _number(F.get(p, F.lit(1))), _number(F.get(last, F.lit(0))), cs * 10))


def webvtt_time(text: Column) -> Column:
    """``MM:SS.mmm`` or ``HH:MM:SS.mmm``; milliseconds are filled up with zeros or cut to three digits."""
    p = F.split(F.trim(text), ":")
    n = F.size(p)
    last = F.split(F.get(p, n - 1), r"\.")
    ms = _number(F.rpad(F.left(F.get(last, F.lit(1)), F.lit(3)), 3, "0"))
    hours = F.when(n == 3, _number(F.get(p, F.lit(0)))).otherwise(0)
    return F.when(n.isin(2, 3) & (F.size(last) == 2), _clock(hours, _number(F.get(p, n - 2)), _number(F.get(last, F.lit(0))), ms))


def strip_ass_tags(text: Column) -> Column:
    """Without ``{...}``; an unclosed brace takes the rest, a stray closing one goes too."""
    return F.regexp_replace(text, r"\{[^}]*\}?|\}", "")


def strip_webvtt_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]*>?|>", "")


def ass_cues(files: DataFrame, text: str = "text") -> DataFrame:
    """Cues of each row's ASS file, from expressions alone: every line that starts with ``Dialogue:``.

    Lines that don't parse are dropped; ``cue_no`` counts the others. Other columns stay.
    """
    kept = [c for c in files.columns if c != text]
    lines = files.select(*kept, F.posexplode(F.split(F.col(text), "\r?\n")).alias("__line", "__raw")).where(F.col("__raw").startswith("Dialogue:"))
    fields = F.split(F.substring("__raw", 10, 2147483647), ",", 10)
    shown = F.replace(F.replace(strip_ass_tags(F.get(fields, F.lit(9))), F.lit("\\N"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    rows = lines.select(*kept, "__line", ass_time(F.get(fields, F.lit(1))).alias("start_ms"), ass_time(F.get(fields, F.lit(2))).alias("end_ms"), shown.alias("text"))
    return rows.where("start_ms is not null and end_ms is not null and text is not null")


def _whole(x: str) -> int | None:
    digits = x[1:] if x[:1] == "+" else x
    return int(digits) if digits.isascii() and digits.isdigit() else None


def _time(x: str, dialect: str) -> int | None:
    parts = x.strip().replace(",", ".").split(":") if dialect == "srt" else x.strip().split(":")
    if len(parts) not in ((3,) if dialect == "srt" else (2, 3)):
        return None
    sec = parts[-1].split(".")
    if len(sec) != 2:
        return None
    fraction = sec[1] if dialect == "srt" else sec[1][:3].ljust(3, "0")
    values = [_whole(v) for v in (*parts[:-1], sec[0], fraction)]
    if None in values:
        return None
    h, m, s, ms = values if len(values) == 4 else (0, *values)
    return (h * 60 + m) * 60_000 + s * 1000 + ms


def _lines(text: str) -> list[str]:
    out = [x.removesuffix("\r") for x in text.split("\n")]
    return out[:-1] if out[-1] == "" else out


def _srt(text: str) -> Iterator[tuple[int, int, str]]:
    lines, i = _lines(text), 0
    while i < len(lines):
        number, i = _whole(lines[i].strip()), i + 1
        if number is None:
            continue
        ends = lines[i].split("-->") if i < len(lines) else []
        times = [_time(e, "srt") for e in ends]
        if len(times) != 2 or None in times:
            raise ValueError(f"cue {number}: no timing line")
        i, body = i + 1, []
        while i < len(lines) and lines[i].strip():
            body.append(lines[i])
            i += 1
        if body:
            yield times[0], times[1], "\n".join(body)


def _webvtt(text: str) -> Iterator[tuple[int, int, str]]:
    lines = _lines(text.lstrip("﻿"))
    if not lines or not lines[0].startswith("WEBVTT"):
        raise ValueError("no WEBVTT header")
    i = 1
    while i < len(lines) and lines[i].strip():
        i += 1
    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        if "-->" not in lines[i]:
            i += 1  # a cue's name
            if i >= len(lines) or "-->" not in lines[i]:
                continue
        start, _, rest = lines[i].partition("-->")
        times = _time(start, "webvtt"), _time((rest.split() or [""])[0], "webvtt")
        i, body = i + 1, []
        while i < len(lines) and lines[i].strip():
            body.append(lines[i])
            i += 1
        if None not in times and body:
            yield times[0], times[1], re.sub(r"<[^>]*>?|>", "", "\n".join(body))


def _ass_time(x: str) -> int | None:
    parts = x.strip().split(":")
    last = parts[-1].split(".")
    if len(parts) != 3 or len(last) != 2:
        return None
    values = [_whole(v) for v in (*parts[:2], last[0], last[1][:2].ljust(2, "0"))]
    return None if None in values else (values[0] * 60 + values[1]) * 60_000 + values[2] * 1000 + values[3] * 10


def _ass(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Cues and their styles; lines that don't parse are dropped."""
    for line in re.split("\r?\n", text):
        fields = line[9:].split(",", 9) if line.startswith("Dialogue:") else []
        times = [_ass_time(f) for f in fields[1:3]]
        if len(fields) == 10 and None not in times:
            shown = re.sub(r"\{[^}]*\}?|\}", "", fields[9]).replace("\\N", "\n").replace("\\n", "\n")
            yield times[0], times[1], shown, fields[3]


_DIALECTS = {"srt": _srt, "webvtt": _webvtt}


class SubtitleCues:
    """Table function ``subtitle_cues(codec, data)``: the cues of one file, to be called by ``LATERAL`` in SQL.

    The codec is a constant (``srt``, ``webvtt`` or ``ass``) and decides the parser and the columns: ASS adds the style.
    A file that doesn't parse is an error; a null one has no cues. ``register_functions`` makes it known.
    """

    @staticmethod
    def analyze(codec, data):
        from pyspark.sql.types import BinaryType, StringType, StructType
        from pyspark.sql.udtf import AnalyzeResult

        if not codec.isConstantExpression or codec.value not in (*_DIALECTS, "ass"):
            raise ValueError("the codec must be one of 'srt', 'webvtt' and 'ass'")
        if not isinstance(data.dataType, (StringType, BinaryType)):
            raise ValueError("a subtitle file is a string or binary")
        schema = StructType().add("cue_no", "integer").add("start_ms", "long").add("end_ms", "long").add("text", "string")
        return AnalyzeResult(schema.add("style", "string") if codec.value == "ass" else schema)

    def eval(self, codec, data):
        if data is not None:
            text = bytes(data).decode() if isinstance(data, (bytes, bytearray)) else data
            for i, cue in enumerate(_ass(text) if codec == "ass" else _DIALECTS[codec](text)):
                yield (i, *cue)


def register_functions(spark) -> None:
    """Make `SubtitleCues` known to SQL as ``subtitle_cues``."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("subtitle_cues", udtf(SubtitleCues))


def cues(files: DataFrame, dialect: str, key: str, text: str = "text", mode: str = "fail") -> DataFrame:
    """``(key, cue_no, start_ms, end_ms, text)`` of each row's whole file (string or UTF-8 bytes).

    A file that doesn't parse stops the query (``fail``) or gives no cues (``skip``); a null file gives none.
    """
    if dialect == "ass":
        rows = ass_cues(files.select(F.col(key), F.col(text).cast("string").alias(text)), text)
        number = F.row_number().over(Window.partitionBy(key).orderBy("__line")) - 1
        return rows.select(key, number.cast("int").alias("cue_no"), "start_ms", "end_ms", "text")
    parse = _DIALECTS[dialect]
    schema = files.select(key).schema.add("cue_no", "integer").add("start_ms", "long").add("end_ms", "long").add("text", "string")

    def run(batches):
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    found = list(parse(data.decode() if isinstance(data, bytes) else data))
                except ValueError:
                    if mode == "fail":
                        raise
                    found = []
                rows += [(k, i, *cue) for i, cue in enumerate(found)]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=schema.names)

    return files.select(key, text).mapInArrow(run, schema)
