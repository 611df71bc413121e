"""Exact arithmetic on rationals and time bases as column expressions.

A rational is ``struct<num:int,den:int>``; a denominator of 0 means unknown and gives null. Products of two
64-bit numbers that may be longer are formed in decimals of 38 digits, which hold them exactly, and stay in generated code.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from reelframe.errors import FAIL, reject

ROUNDINGS = ("zero", "inf", "down", "up", "near")
RATIONAL = "struct<num:int,den:int>"
_INT_MAX, _LONG_MAX = 2**31 - 1, 2**63 - 1


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def rational(num, den) -> Column:
    return F.struct(_col(num).cast("int").alias("num"), _col(den).cast("int").alias("den"))


def is_valid(r: Column) -> Column:
    return F.coalesce(r["den"] != 0, F.lit(False))


def gcd(a, b) -> Column:
    """Greatest common divisor of the absolute values, 1 for two zeros. 92 steps do for any 64-bit pair."""
    start = F.struct(F.abs(_col(a).cast("decimal(20,0)")).alias("a"), F.abs(_col(b).cast("decimal(20,0)")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).cast("decimal(20,0)").alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: F.when(s["a"] == 0, 1).otherwise(s["a"]).cast("decimal(20,0)"))


def gcd_int(a, b) -> Column:
    """`gcd` of numbers below 2^62 as a long; 46 steps do for 32-bit pairs, 92 for all."""
    start = F.struct(F.abs(_col(a).cast("long")).alias("a"), F.abs(_col(b).cast("long")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: F.greatest(s["a"], F.lit(1)))


def _reduced(num: Column, den: Column, mode: str) -> Column:
    """Lowest terms with a positive denominator, from longs; beyond 32 bits is an overflow."""
    g = gcd_int(num, den)
    sign = F.when(den < 0, -1).otherwise(1)
    n, d = [F.call_function("div", x, g) * sign for x in (num, den)]
    fits = (F.abs(n) <= _INT_MAX) & (d <= _INT_MAX)
    return F.when(num.isNull() | den.isNull(), F.lit(None).cast(RATIONAL)).when(den == 0, reject("invalid rational", RATIONAL, mode)).when(~fits, reject("rational overflow", RATIONAL, mode)).otherwise(rational(n, d))


def reduce(r: Column, mode: str = FAIL) -> Column:
    return _reduced(r["num"].cast("long"), r["den"].cast("long"), mode)


def invert(r: Column, mode: str = FAIL) -> Column:
    """Numerator and denominator change places; signs stay as they are."""
    return F.when(r["num"] == 0, reject("can't invert zero", RATIONAL, mode)).otherwise(rational(r["den"], r["num"]))


def negate(r: Column) -> Column:
    return rational(-r["num"], r["den"])


def _parts(a: Column, b: Column):
    return [x[f].cast("long") for x in (a, b) for f in ("num", "den")]


def _known(a: Column, b: Column, value: Column, mode: str) -> Column:
    return F.when(is_valid(a) & is_valid(b), value).otherwise(reject("invalid rational", RATIONAL, mode))


def add(a: Column, b: Column, mode: str = FAIL) -> Column:
    an, ad, bn, bd = _parts(a, b)
    return _known(a, b, _reduced(an * bd + bn * ad, ad * bd, mode), mode)


def subtract(a: Column, b: Column, mode: str = FAIL) -> Column:
    an, ad, bn, bd = _parts(a, b)
    return _known(a, b, _reduced(an * bd - bn * ad, ad * bd, mode), mode)


def multiply(a: Column, b: Column, mode: str = FAIL) -> Column:
    an, ad, bn, bd = _parts(a, b)
    return _known(a, b, _reduced(an * bn, ad * bd, mode), mode)


def divide(a: Column, b: Column, mode: str = FAIL) -> Column:
    an, ad, bn, bd = _parts(a, b)
    return _known(a, b, _reduced(an * bd, ad * bn, mode), mode)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by value; null if either is unknown. Denominators may be negative."""
    an, ad, bn, bd = _parts(a, b)
    flip = F.when((ad < 0) != (bd < 0), -1).otherwise(1)
    return F.when(is_valid(a) & is_valid(b), (F.signum(an * bd - bn * ad) * flip).cast("int"))


def equals(a: Column, b: Column) -> Column:
    """By value; null, not true, where both are unknown."""
    return compare(a, b) == 0


def to_double(r: Column) -> Column:
    return F.try_divide(r["num"].cast("double"), r["den"].cast("double"))


def show(r: Column) -> Column:
    return F.concat_ws("/", r["num"].cast("string"), r["den"].cast("string"))


@F.pandas_udf(StructType([StructField("num", IntegerType()), StructField("den", IntegerType())]))
def from_double(value: pd.Series, max_den: pd.Series) -> pd.DataFrame:
    """Best continued-fraction convergent with a denominator of at most ``max_den``.

    Null for null, infinite or undefined values, a limit below 1, and numerators beyond 32 bits. All rows take
    the same step together, 64 at most.
    """
    v, limit = value.to_numpy("float64", na_value=np.nan), max_den.to_numpy("float64", na_value=0)
    good = np.isfinite(v) & (limit > 0)
    x = np.abs(np.where(good, v, 0.0))
    whole = np.floor(x)
    p0, q0, p, q, rest = np.ones_like(x), np.zeros_like(x), whole, np.ones_like(x), x - whole
    going = good & (rest >= 1e-12)
    for _ in range(63):
        if not going.any():
            break
        turned = 1.0 / np.where(going, rest, 1.0)
        going &= turned <= 1e15
        digit = np.floor(turned)
        p2, q2 = digit * p + p0, digit * q + q0
        going &= q2 <= limit
        p0, q0, p, q = np.where(going, p, p0), np.where(going, q, q0), np.where(going, p2, p), np.where(going, q2, q)
        rest = np.where(going, turned - digit, rest)
        going &= rest >= 1e-12
    good &= p <= _INT_MAX
    num = pd.array(np.where(good, np.sign(v) * p, 0).astype("int64"), "Int32")
    out = pd.DataFrame({"num": num, "den": pd.array(np.where(good, q, 0).astype("int64"), "Int32")})
    out.loc[~good, ["num", "den"]] = pd.NA
    return out


def rescale(value, src, dst, rounding: str = "near", mode: str = FAIL) -> Column:
    """``value * src / dst`` exactly, rounded; null for nulls.

    ``zero`` toward 0, ``inf`` away from it, ``down`` and ``up`` toward the infinities, ``near`` to the nearest
    with ties away from 0. dst = 0 is an error even if src = 0; so is a result beyond 64 bits.
    """
    if rounding not in ROUNDINGS:
        raise ValueError(f"unknown rounding {rounding!r}")
    v, s, d = (_col(x).cast("decimal(19,0)") for x in (value, src, dst))
    product = (F.abs(v) * F.abs(s)).cast("decimal(38,0)")
    by = F.when(d == 0, F.lit(1).cast("decimal(19,0)")).otherwise(F.abs(d))
    negative = (v < 0) != ((s < 0) != (d < 0))
    rest = product % by
    more = {"zero": F.lit(False), "inf": rest > 0, "down": negative & (rest > 0), "up": ~negative & (rest > 0), "near": rest * 2 >= by}[rounding]
    # the quotient as a long wraps without notice, so what doesn't fit is turned away before
    outside = product >= by * F.lit(str(_LONG_MAX + 1)).cast("decimal(19,0)")
    size = F.call_function("div", F.when(outside, F.lit(0).cast("decimal(38,0)")).otherwise(product), by).cast("decimal(20,0)") + F.when(more, 1).otherwise(0)
    result = F.when(negative, -size).otherwise(size)
    outside = outside | (size > F.lit(_LONG_MAX))
    answer = F.when(d == 0, reject("rescale to zero", "long", mode)).when(s == 0, F.lit(0).cast("long")).when(outside, reject("rescale overflow", "long", mode)).otherwise(result.cast("long"))
    quick, short = _rescale_short(_col(value).cast("long"), _col(src).cast("long"), _col(dst).cast("long"), rounding)
    return F.when(v.isNotNull() & s.isNotNull() & d.isNotNull(), F.when(short, quick).otherwise(answer))


def _rescale_short(v: Column, s: Column, d: Column, rounding: str) -> tuple[Column, Column]:
    """The same in 64 bits, and where it holds: the product fits, and no operand is the smallest number."""
    size = F.when(s > -_LONG_MAX, F.greatest(F.abs(s), F.lit(1))).otherwise(F.lit(_LONG_MAX))
    most = F.call_function("div", F.lit(_LONG_MAX), size)
    fits = (s > -_LONG_MAX) & (d > -_LONG_MAX) & (d != 0) & v.between(-most, most)
    product, by = F.abs(v * s), F.abs(d)
    rest = product % by
    negative = (v < 0) != ((s < 0) != (d < 0))
    more = {"zero": F.lit(False), "inf": rest > 0, "down": negative & (rest > 0), "up": ~negative & (rest > 0), "near": rest >= by - rest}[rounding]
    whole = F.call_function("div", product, by) + F.when(more, 1).otherwise(0)
    return F.when(negative, -whole).otherwise(whole), fits


def rescale_q(value, src: Column, dst: Column, rounding: str = "near", mode: str = FAIL) -> Column:
    """From one time base to another."""
    up = src["num"].cast("long") * dst["den"].cast("long")
    down = src["den"].cast("long") * dst["num"].cast("long")
    known = is_valid(src) & is_valid(dst)
    return F.when(_col(value).isNull(), F.lit(None).cast("long")).when(known, rescale(value, up, down, rounding, mode)).otherwise(reject("invalid time base", "long", mode))


def compare_ts(a, tb_a: Column, b, tb_b: Column, mode: str = FAIL) -> Column:
    """Exact order of two timestamps in their own time bases: -1, 0 or 1; null for nulls."""
    scaled = lambda x, n, d: (_col(x).cast("decimal(19,0)") * (n.cast("long") * d.cast("long")).cast("decimal(19,0)")).cast("decimal(38,0)")
    sign = F.signum(scaled(a, tb_a["num"], tb_b["den"]) - scaled(b, tb_b["num"], tb_a["den"])).cast("int")
    return F.when(_col(a).isNotNull() & _col(b).isNotNull(), F.when(is_valid(tb_a) & is_valid(tb_b), sign).otherwise(reject("invalid time base", "int", mode)))


def to_seconds(value, tb: Column) -> Column:
    return F.when(is_valid(tb), _col(value).cast("double") * to_double(tb))


def from_seconds(seconds, tb: Column, mode: str = FAIL) -> Column:
    """Nearest tick, ties away from 0."""
    ticks = F.round(F.try_divide(_col(seconds).cast("double"), to_double(tb)))
    capped = F.when(ticks >= 2.0**63, F.lit(_LONG_MAX)).when(ticks <= -(2.0**63), F.lit(-_LONG_MAX - 1)).otherwise(ticks.cast("long"))
    return F.when(is_valid(tb) & (tb["num"] != 0), capped).otherwise(reject("invalid time base", "long", mode))


def show_ts(value, tb: Column) -> Column:
    """Seconds to six places, of the binary number's exact value, or NOPTS where there is no time."""
    seconds = to_seconds(value, tb)
    return F.when(seconds.isNull(), "NOPTS").otherwise(F.concat(F.call_function("format_number", seconds, F.lit("0.000000")), F.lit("s")))


def discontinuity(now, tb_now: Column, before, tb_before: Column, threshold: float) -> Column:
    """Whether two times are further apart than ``threshold`` seconds; null if either is unknown."""
    return F.abs(to_seconds(now, tb_now) - to_seconds(before, tb_before)) > threshold
