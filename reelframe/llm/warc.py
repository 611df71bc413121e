"""WARC archives: segmented, chunk-framed records with revisits, written as files and reassembled."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.cluster import put_file, settle, shared_dir

#: A record block longer than this is cut into segments.
SEGMENT_BYTES = 16_384
#: An archive file is closed once it holds so many bytes.
FILE_BYTES = 16 << 20
CHUNK_BYTES = 4_096
_DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _chunked(payload: bytes) -> bytes:
    parts = [payload[i : i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunk(framed: bytes) -> bytes:
    """Payload of a body in chunked transfer framing; chunk extensions and trailers are passed over."""
    at, out = 0, []
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            if not (framed[at:] == b"\r\n" or framed.endswith(_END)):
                raise ValueError("the chunked body doesn't end")
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than it says")
        out.append(framed[at : at + size])
        at += size + 2


def _record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in ({"WARC-Date": _DATE} | fields | {"Content-Length": str(len(block))}).items())
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + _END, 1, mtime=0)


def _page_records(record_id: str, url: str | None, payload: bytes | None, digest: str, refers_to: str | None, segment_bytes: int) -> list[bytes]:
    own = {"WARC-Record-ID": f"<{record_id}>", "WARC-Target-URI": re.sub(r"[\s\x00-\x1f]", "%20", url or "about:blank"), "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if payload is None:
        return [_record({"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{refers_to}>"} | own, head)]
    block = head + _chunked(payload)
    if len(block) <= segment_bytes:
        return [_record({"WARC-Type": "response"} | own, block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record({"WARC-Type": "response", "WARC-Segment-Number": "1"} | own, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = {"WARC-Segment-Total-Length": str(len(block))} if n == len(parts) else {}
        out.append(_record({"WARC-Type": "continuation", "WARC-Record-ID": f"<{record_id}:segment:{n}>", "WARC-Segment-Origin-ID": f"<{record_id}>", "WARC-Segment-Number": str(n)} | more, part))
    return out


WRITTEN = "name string, n_records long, page_id long, sha string, record_id string"


def _write(rows: DataFrame, folder: str, kind: str, segment_bytes: int) -> DataFrame:
    """Write ``rows(page_id, url, sha, payload, refers_to, referred)`` as files: `WRITTEN`, a row a file, and one
    without a name a ``referred`` row. A record id ends in its task's number and its own in that task.
    """

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part, held, size, files, count = task.partitionId(), [], 0, 0, 0

        def close():
            nonlocal held, size, files
            # an attempt's files are its own, so what a lost one leaves is never mistaken for them
            name = f"{kind}-{part:06d}-{task.taskAttemptId()}-{files:05d}.warc.gz"
            put_file(folder, name, b"".join(held))
            made = (name, len(held), None, None, None)
            held, size, files = [], 0, files + 1
            return made

        def rows_of(made):
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in WRITTEN.split(", ")])

        for batch in batches:
            made = []
            for row in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                record_id = f"urn:page:{'null' if row['page_id'] is None else row['page_id']}:{digest}:{kind}-{part}-{count}"
                count += 1
                records = _page_records(record_id, row["url"], row["payload"], digest, row["refers_to"], segment_bytes)
                held += records
                size += sum(map(len, records))
                if row["referred"]:
                    made.append((None, None, row["page_id"], row["sha"], record_id))
                if size >= FILE_BYTES:
                    made.append(close())
            yield rows_of(made)
        if held:
            yield rows_of([close()])

    return settle(rows.select("page_id", "url", "sha", "payload", "refers_to", "referred").mapInArrow(write, WRITTEN), f"{folder}-{kind}")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC files and return their manifest ``(name, n_records)``.

    Of pages with equal payloads of at least ``min_bytes`` bytes that with the smallest ``page_id`` is a
    response and the others revisit it. Null html is an empty payload, a null url ``about:blank``. Rows repeated
    with the smallest page_id are all responses; a null page_id sorts after every other. Every row has a record
    id of its own, whatever page_ids repeat or are null.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumns({"sha": F.sha1("payload"), "n": F.octet_length("payload")})
    keys = rows.drop("payload").where(F.col("n") >= min_bytes)
    # grouped before the shuffle; only payloads that repeat go on, and only ids, urls and digests move
    firsts = keys.groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copies = settle(keys.join(firsts, ["sha", "n"]).select("page_id", "url", "sha", "n", "first"), f"{folder}-copies")
    # a page_id may stand for several payloads, so rows are told by both
    known = copies.select(F.col("page_id").alias("its_id"), F.col("sha").alias("its_sha"), F.col("n").alias("its_n"), (~F.col("page_id").eqNullSafe(F.col("first"))).alias("again")).distinct()
    tagged = rows.join(known, F.col("page_id").eqNullSafe(F.col("its_id")) & (F.col("sha") == F.col("its_sha")) & (F.col("n") == F.col("its_n")), "left").where("again is null or not again")
    responses = _write(tagged.withColumns({"refers_to": F.lit(None).cast("string"), "referred": F.col("again").isNotNull()}), folder, "response", segment_bytes)
    ids = responses.where("name is null").groupBy(F.col("page_id").alias("first"), "sha").agg(F.min("record_id").alias("refers_to"))
    revisits = copies.where("page_id is null and first is not null or page_id <> first").join(ids, ["first", "sha"], "left")
    revisits = _write(revisits.withColumns({"payload": F.lit(None).cast("binary"), "referred": F.lit(False)}), folder, "revisit", segment_bytes)
    return settle(responses.unionByName(revisits).where("name is not null").select("name", "n_records"), folder + "-manifest")


def _records(content: bytes):
    """Each record of a file of gzip members, one member a record."""
    stream = io.BytesIO(content)
    rest = b""
    while True:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            rest = rest or stream.read(1 << 16)
            if not rest:
                if parts:
                    raise ValueError("the archive is cut off")
                return
            parts.append(member.decompress(rest))
            rest = member.unused_data
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, block = raw.split(_END, 1)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(block) != size + 4 or block[size:] != _END:
        raise ValueError("the record's length is wrong")
    return fields, block[:size]


SEGMENTS = "record_id string, type string, origin string, segment int, total long, refers_to string, digest string, block binary"


def read_segments(spark, folder: str) -> DataFrame:
    """Every record of the archives that the manifest of ``folder`` names, continuations apart."""

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                for raw in _records(content.as_py()):
                    f, block = parse_record(raw)
                    out.append((f["warc-record-id"], f["warc-type"], f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]) if "warc-segment-number" in f else None, int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, f.get("warc-refers-to"), f.get("warc-payload-digest"), block))
                cols = list(zip(*out)) or [[]] * 8
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    names = spark.read.schema("name string, n_records long").parquet(folder + "-manifest").select("name")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).withColumn("name", F.substring_index("path", "/", -1))
    return files.join(names, "name", "left_semi").select("content").mapInArrow(read, SEGMENTS)


RECORDS = "record_id string, type string, refers_to string, digest string, payload binary"


def reassemble(segments: DataFrame) -> DataFrame:
    """Whole records: ``(record_id, type, refers_to, digest, payload)``.

    Continuations are grouped by origin, put in order of segment number, held against the total length, and the
    chunked transfer framing is decoded. A gap in the numbers, a wrong length or a wrong digest is an error. A
    segment delivered twice counts once. Records without segments aren't shuffled. Null payloads don't occur.
    """

    def payload_of(block: bytes, kind: str) -> bytes:
        head, body = block.split(_END, 1)
        if kind == "revisit":
            return b""
        return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body

    def whole(batches):
        for frame in batches:
            frame["payload"] = [payload_of(b, k) for b, k in zip(frame["block"], frame["type"])]
            yield frame[["record_id", "type", "refers_to", "digest", "payload"]]

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("segment").drop_duplicates("segment")
        first, block = frame.iloc[0], b"".join(frame["block"])
        if frame["segment"].tolist() != list(range(1, len(frame) + 1)) or frame["total"].iloc[-1] != len(block):
            raise ValueError(f"{first['record_id']}: segments are missing")
        return pd.DataFrame([(first["record_id"], first["type"], first["refers_to"], first["digest"], payload_of(block, first["type"]))], columns=["record_id", "type", "refers_to", "digest", "payload"])

    alone = segments.where("segment is null").mapInPandas(whole, RECORDS)
    return alone.unionByName(segments.where("segment is not null").groupBy("origin").applyInPandas(join, RECORDS))


def archive_digest(pages: DataFrame, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back: one row a page.

    Columns page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit's size comes from the
    response it refers to. No pages give no rows.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "archives")
    manifest = write_archives(pages, folder, min_bytes, segment_bytes)
    if not manifest.take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")

    def check(batches):
        for frame in batches:
            found = [digest_of(p) for p in frame["payload"]]
            said = [d.removeprefix("sha1:") for d in frame["digest"]]
            if any(a != b for a, b, k in zip(found, said, frame["type"]) if k != "revisit"):
                raise ValueError("a payload differs from its digest")
            yield pd.DataFrame({"record_id": frame["record_id"], "record_type": frame["type"], "ref": frame["refers_to"], "payload_digest": said, "size": [len(p) for p in frame["payload"]]})

    records = settle(reassemble(read_segments(spark, folder)).mapInPandas(check, "record_id string, record_type string, ref string, payload_digest string, size long"), folder + "-records")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+|null):", 1).try_cast("long")
    responses = records.where("record_type = 'response'").select(page("record_id").alias("page_id"), F.col("size").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    sizes = records.where("record_type = 'response'").select(F.col("record_id").alias("ref"), F.col("size").alias("payload_bytes"), F.col("payload_digest").alias("their_digest"))
    size = F.when(F.col("payload_digest") == F.col("their_digest"), F.col("payload_bytes")).otherwise(F.raise_error(F.concat("record_id", F.lit(": no such payload"))).cast("long"))
    revisits = records.where("record_type = 'revisit'").drop("size").join(sizes, "ref", "left").withColumn("payload_bytes", size)
    return responses.unionByName(revisits.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("ref").alias("refers_to")))
