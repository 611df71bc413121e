"""Chat formatting with typed content parts, on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
#: A text-like part carries text; any other carries a reference to its attachment.
KINDS = ("text", "image", "audio", "document")
#: Tokens by kind of attachment: per 512-pixel tile of an image, per second of audio, per page of a document.
TOKENS_PER_UNIT = {"image": 170, "audio": 25, "document": 600}
BASE_TOKENS = {"image": 85, "audio": 0, "document": 0}
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """``<|`` with any number of backslashes inside gets one more, so no control string is left; null: empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """Exact inverse of `escape`."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    """As `escape`, and the role stays on one line."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    none = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")))


def _expanded(part: Column) -> Column:
    """Tokens that an attachment stands for."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(512)) / 512) * F.ceil(F.coalesce(part["height"], F.lit(512)) / 512)
    image = F.lit(BASE_TOKENS["image"]) + TOKENS_PER_UNIT["image"] * tiles
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * TOKENS_PER_UNIT["audio"])
    document = F.coalesce(part["pages"], F.lit(1)) * TOKENS_PER_UNIT["document"]
    return F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", document).otherwise(0).cast("long")


def visit_parts(parts: Column) -> tuple[Column, Column]:
    """Flatten a turn's parts in order: its escaped text with placeholders, and its attachments.

    Text is escaped; an attachment becomes ``<|kind|>``, a control string no text can hold. A null list, null
    parts and null text are empty; an unknown type counts as text. Attachments carry type, ref and tokens.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    attached = lambda p: p["type"].isin(*KINDS[1:])
    body = F.array_join(F.transform(parts, lambda p: F.when(attached(p), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(escape(p["text"]))), "")
    found = F.transform(F.filter(parts, attached), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens")))
    return body, found


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Format ``turns(conv_id, turn, role, parts)``, one row a conversation.

    ``formatted``: its turns in order of turn (null first; ties by role, then body), each
    ``<|im_start|>role\\nbody<|im_end|>\\n``. ``loss_mask``: per turn the code points ``(start, stop)`` of a
    trained body, null for other turns. ``attachments``: in order, with turn number and ``tokens``;
    ``expanded_tokens`` is their sum. A null role is empty, a null conv_id a conversation of its own, repeated
    turns stay. Turns are shuffled once, by conversation; offsets are running sums, so long conversations cost
    no more per turn than short ones.
    """
    body, found = visit_parts(F.col("parts"))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), body.alias("body"), found.alias("attached"))
    rows = rows.withColumn("head", F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    size = F.char_length("head") + F.char_length("body") + len(STOP) + 1
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("at", F.coalesce(F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("at") + F.char_length("head")
    mask = F.when(F.col("role") == trained_role, F.struct(start.alias("start"), (start + F.char_length("body")).alias("stop")))
    piece = F.concat("head", "body", F.lit(STOP + "\n"))
    listed = F.transform("attached", lambda a: F.struct(F.col("n").alias("turn_no"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", piece.alias("piece"), mask.alias("mask"), listed.alias("attached")))).alias("t"))
    attachments = F.flatten(F.col("t.attached"))
    return whole.select("conv_id", F.array_join("t.piece", "").alias("formatted"), F.col("t.mask").alias("loss_mask"), attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per turn of ``format_conversations``' output, from ``formatted`` and ``loss_mask`` alone.

    ``(conv_id, n, formatted_chars, role, text, trained)``: placeholders of attachments stay in the text. A mask that doesn't
    cover exactly a body raises an error.
    """
    chunks = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 2147483647)
    rows = formatted.select("conv_id", "loss_mask", F.char_length("formatted").cast("long").alias("formatted_chars"), F.posexplode(chunks).alias("n", "chunk"))
    order = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum((F.char_length("chunk") + len(START)).cast("long")).over(order), F.lit(0)))
    role = F.substring_index("chunk", "\n", 1)
    body = F.expr(f"substring(chunk, char_length(substring_index(chunk, '\\n', 1)) + 2, char_length(chunk) - char_length(substring_index(chunk, '\\n', 1)) - {len(STOP) + 2})")
    rows = rows.select("conv_id", "n", "formatted_chars", role.alias("raw_role"), body.alias("body"), (F.col("at") + len(START) + F.char_length(role) + 1).alias("start"), F.get("loss_mask", F.col("n")).alias("mask"))
    fits = (F.col("mask.start") == F.col("start")) & (F.col("mask.stop") == F.col("start") + F.char_length("body"))
    trained = F.when(F.col("mask").isNull(), False).when(fits, True).otherwise(F.raise_error(F.lit("a loss span isn't a turn's body")).cast("boolean"))
    return rows.select("conv_id", "n", "formatted_chars", _unescape_role(F.col("raw_role")).alias("role"), unescape(F.col("body")).alias("text"), trained.alias("trained"))


def conversation_digest(turns: DataFrame) -> DataFrame:
    """Format ``turns(conv_id, turn, role, text)`` and digest what is read back, one row a conversation."""
    formatted = format_conversations(turns.select("conv_id", "turn", "role", text_parts(F.col("text").cast("string")).alias("parts")))
    back = read_back(formatted.select("conv_id", "formatted", "loss_mask"))
    spoken = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    listed = F.array_sort(F.collect_list(F.struct("n", spoken.alias("spoken"), F.when(F.col("trained"), F.col("text")).otherwise("").alias("loss"))))
    digests = back.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.first("formatted_chars").alias("formatted_chars"), listed.alias("t"))
    loss = F.array_join("t.loss", "")
    return digests.select("conv_id", "n_turns", F.sha2(F.array_join("t.spoken", "").cast("binary"), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
