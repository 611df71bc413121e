"""Ordered string dictionaries as ``array<struct<key,value>>``, and typed options."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

DICT = "array<struct<key:string,value:string>>"


def _col(x) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _pair(k, v) -> Column:
    return F.struct(_col(k).cast("string").alias("key"), _col(v).cast("string").alias("value"))


def empty() -> Column:
    return F.array().cast(DICT)


def get(d: Column, key) -> Column:
    return F.get(F.filter(d, lambda e: e["key"] == _col(key)), F.lit(0))["value"]


def contains(d: Column, key) -> Column:
    return F.exists(d, lambda e: e["key"] == _col(key))


def put(d: Column, key, value) -> Column:
    """A known key keeps its place, a new one comes last."""
    pair = _pair(key, value)
    return F.when(contains(d, key), F.transform(d, lambda e: F.when(e["key"] == _col(key), pair).otherwise(e))).otherwise(F.concat(d, F.array(pair)))


def remove(d: Column, key) -> Column:
    return F.filter(d, lambda e: e["key"] != _col(key))


def _unique(pairs: Column) -> Column:
    """Keys at their first place with their last value."""
    def step(s, e):
        return F.when(F.exists(s, lambda x: x["key"] == e["key"]), F.transform(s, lambda x: F.when(x["key"] == e["key"], e).otherwise(x))).otherwise(F.concat(s, F.array(e)))

    return F.aggregate(pairs, empty(), step)


def merge(left: Column, right: Column) -> Column:
    """Values of ``right`` win, places of ``left`` stay."""
    return _unique(F.concat(left, right))


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+\z", "")


def parse(text: Column, pair_sep: str, kv_sep: str) -> Column:
    """Pairs without a separator are passed over, the first separator splits, and the last value of a key wins."""
    literal = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
    parts = F.filter(F.split(text, literal(pair_sep)), lambda p: F.instr(p, kv_sep) > 0)
    pairs = F.transform(parts, lambda p: F.transform(F.split(p, literal(kv_sep), 2), _trim))
    return _unique(F.transform(pairs, lambda p: _pair(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))


def show(d: Column) -> Column:
    return F.array_join(F.transform(d, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


@dataclass(frozen=True)
class Option:
    """A typed option with an inclusive range for numbers."""

    kind: type
    default: object
    least: float | None = None
    most: float | None = None


TRUE_WORDS, FALSE_WORDS = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


@dataclass
class Options:
    """Registered options and their values. Unknown names, wrong types and values out of range raise ValueError."""

    defs: dict[str, Option] = field(default_factory=dict)
    values: dict[str, object] = field(default_factory=dict)

    def register(self, name: str, option: Option) -> None:
        self.defs[name] = option
        self.values[name] = option.default

    def set(self, name: str, text: str) -> None:
        """From text."""
        kind = self._def(name).kind
        if kind is bool:
            word = text.lower()
            if word not in TRUE_WORDS + FALSE_WORDS:
                raise ValueError(f"{name}: not a boolean: {text!r}")
            self.set_value(name, word in TRUE_WORDS)
        else:
            self.set_value(name, kind(text))

    def set_value(self, name: str, value: object) -> None:
        option = self._def(name)
        if type(value) is not option.kind:
            raise ValueError(f"{name}: expected {option.kind.__name__}")
        if option.kind in (int, float) and not ((option.least is None or value >= option.least) and (option.most is None or value <= option.most)):
            raise ValueError(f"{name}: {value} is out of range")
        self.values[name] = value

    def get(self, name: str, kind: type | None = None):
        option = self._def(name)
        if kind is not None and kind is not option.kind:
            raise ValueError(f"{name} isn't {kind.__name__}")
        return self.values[name]

    def reset(self) -> None:
        self.values = {n: o.default for n, o in self.defs.items()}

    def _def(self, name: str) -> Option:
        if name not in self.defs:
            raise ValueError(f"unknown option {name!r}")
        return self.defs[name]


def valid_option(text: Column, option: Option) -> Column:
    """Whether each text would be taken by an option: a column form of `Options.set`."""
    if option.kind is bool:
        return F.lower(text).isin(*TRUE_WORDS, *FALSE_WORDS)
    if option.kind is str:
        return text.isNotNull()
    number = text.try_cast("long" if option.kind is int else "double")
    least = F.lit(True) if option.least is None else number >= option.least
    most = F.lit(True) if option.most is None else number <= option.most
    return F.coalesce(number.isNotNull() & F.regexp_like(text, F.lit(r"^[+-]?[0-9.eE+-]+\z")) & least & most, F.lit(False))
