"""What a row that can't be computed becomes, and the kinds of errors that readers and writers meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAIL, SKIP, CONCEAL = "fail", "skip", "conceal"

# What each kind of error is called.
KINDS = {
    "eof": "end of file", "invalid_data": "invalid data", "unsupported": "unsupported", "io": "I/O error", "not_found": "not found", "again": "resource temporarily unavailable",
    "overflow": "numeric overflow", "invalid_argument": "invalid argument", "invalid_state": "invalid state", "no_memory": "out of memory",
}
#: Kinds that say nothing but their name.
_BARE = ("eof", "again", "overflow", "no_memory")


class MediaError(Exception):
    """An error of one of the `KINDS`."""

    def __init__(self, kind: str, message: str = ""):
        self.kind = kind
        super().__init__(KINDS[kind] if kind in _BARE else f"{KINDS[kind]}: {message}")


def kind_of(error: BaseException) -> str:
    """The kind that a Python error stands for; any other error of the system is an I/O error."""
    if isinstance(error, MediaError):
        return error.kind
    for types, kind in ((EOFError, "eof"), (FileNotFoundError, "not_found"), (MemoryError, "no_memory"), (UnicodeError, "invalid_data"), (ValueError, "invalid_argument"), (NotImplementedError, "unsupported"), (OverflowError, "overflow"), (BlockingIOError, "again")):
        if isinstance(error, types):
            return kind
    return "io"


def reject(message: str, kind: str, mode: str) -> Column:
    """``fail``: the query stops with the message; ``skip``: the value is null."""
    if mode == FAIL:
        return F.raise_error(F.lit(message)).cast(kind)
    if mode == SKIP:
        return F.lit(None).cast(kind)
    raise ValueError(f"unknown error mode {mode!r}")
