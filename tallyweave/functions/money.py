"""Money in integer minor units as column expressions: parse, round, format, tolerances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("reject", "trunc", "half_up", "half_even")
LONG_MIN, LONG_MAX = "-9223372036854775808", "9223372036854775807"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def parse(text: Column, scale: Column, mode: str = "reject") -> Column:
    """struct(minor, code) of a decimal text; one of them is null.

    Codes: empty_amount, bad_format, too_many_digits (only ``reject``: a non-zero digit
    beyond the scale), overflow. Half-even looks at the first discarded digit alone, and
    with scale 0 both half modes round any non-zero excess away from zero.
    """
    if mode not in MODES:
        raise ValueError(f"unknown rounding mode {mode}")

    def pieces(t: Column) -> Column:
        body = F.when(F.substring(t, 1, 1).isin("+", "-"), F.substring(t, F.lit(2), F.length(t))).otherwise(t)
        split = F.split_part(body, F.lit("."), F.lit(1)), F.split_part(body, F.lit("."), F.lit(2))
        form = F.coalesce(body.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), F.lit(False))
        return F.struct(t.alias("t"), F.when(form, split[0]).alias("whole"), F.when(form, split[1]).alias("frac"))

    def digits(p: Column) -> Column:
        excess = F.substring(p["frac"], scale + 1, F.length(p["frac"]))
        kept = F.concat(F.lit("0"), p["whole"], F.rpad(F.substring(p["frac"], F.lit(1), scale), scale, "0"))
        return F.struct(p["t"].alias("t"), kept.alias("kept"), F.substring(excess, 1, 1).alias("first"), (F.translate(excess, "0", "") != "").alias("nonzero"))

    def sized(d: Column) -> Column:
        odd = F.substring(d["kept"], -1, 1).isin("1", "3", "5", "7", "9")
        up = {
            "reject": F.lit(False),
            "trunc": F.lit(False),
            "half_up": F.when(scale == 0, d["nonzero"]).otherwise(d["first"] >= "5"),
            "half_even": F.when(scale == 0, d["nonzero"]).otherwise((d["first"] > "5") | ((d["first"] == "5") & odd)),
        }[mode]
        size = d["kept"].try_cast("decimal(38,0)") + F.when(up, 1).otherwise(0).cast("decimal(1,0)")
        return F.struct(d["t"].alias("t"), d["kept"].alias("kept"), d["nonzero"].alias("nonzero"), F.when(F.substring(d["t"], 1, 1) == "-", -size).otherwise(size).alias("signed"))

    def judged(v: Column) -> Column:
        fits = v["signed"].between(F.lit(LONG_MIN).cast("decimal(38,0)"), F.lit(LONG_MAX).cast("decimal(38,0)"))
        code = (
            F.when(F.coalesce(v["t"], F.lit("")) == "", "empty_amount")
            .when(v["kept"].isNull(), "bad_format")
            .when(F.lit(mode == "reject") & v["nonzero"], "too_many_digits")
            .when(~F.coalesce(fits, F.lit(False)), "overflow")
        )
        return let(code, lambda c: F.struct(F.when(c.isNull(), v["signed"].try_cast("long")).alias("minor"), c.alias("code")))

    return let(strip(text), lambda t: let(pieces(t), lambda p: let(digits(p), lambda d: let(sized(d), judged))))


def _checked(value: Column, a_currency: Column, b_currency: Column) -> Column:
    """struct(minor, code) of a decimal value of two amounts: code is currency_mismatch or overflow."""
    fits = value.between(F.lit(LONG_MIN).cast("decimal(38,0)"), F.lit(LONG_MAX).cast("decimal(38,0)"))
    code = F.when(~a_currency.eqNullSafe(b_currency), "currency_mismatch").when(~fits, "overflow")
    return F.struct(F.when(code.isNull(), value.try_cast("long")).alias("minor"), code.alias("code"))


def _wide(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def add(a: Column, b: Column, a_currency: Column, b_currency: Column) -> Column:
    """struct(minor, code) of the sum of two amounts of one currency."""
    return _checked(_wide(a) + _wide(b), a_currency, b_currency)


def subtract(a: Column, b: Column, a_currency: Column, b_currency: Column) -> Column:
    return _checked(_wide(a) - _wide(b), a_currency, b_currency)


def abs_diff(a: Column, b: Column, a_currency: Column, b_currency: Column) -> Column:
    return _checked(F.abs(_wide(a) - _wide(b)), a_currency, b_currency)


def compare(a: Column, b: Column, a_currency: Column, b_currency: Column) -> Column:
    """-1, 0 or 1; null for two currencies."""
    return F.when(a_currency.eqNullSafe(b_currency), F.signum(_wide(a) - _wide(b)).cast("int"))


def render(minor: Column, scale: Column) -> Column:
    """Decimal text with exactly ``scale`` digits after the point."""
    digits = F.lpad(F.abs(minor.cast("decimal(20,0)")).cast("string"), F.greatest(scale + 1, F.length(F.abs(minor.cast("decimal(20,0)")).cast("string"))), "0")
    n = F.length(digits)
    text = F.when(scale == 0, digits).otherwise(F.concat(F.substring(digits, F.lit(1), n - scale), F.lit("."), F.substring(digits, n - scale + 1, scale)))
    return F.when(minor < 0, F.concat(F.lit("-"), text)).otherwise(text)


def within(diff: Column, base: Column, absolute: int | None, bps: int | None) -> Column:
    """Every enabled bound holds, inclusively; with none enabled, always."""
    out = F.lit(True)
    if absolute is not None:
        out = out & (diff <= F.lit(absolute).cast("long"))
    if bps is not None:
        wide = lambda c: c.cast("decimal(19,0)")
        out = out & (wide(diff) * F.lit(10000).cast("decimal(5,0)") <= wide(F.lit(bps)) * F.abs(base.cast("decimal(19,0)")))
    return out


def compare_tolerance(diff: Column, base: Column, absolute: int | None, bps: int | None) -> Column:
    """-1, 0 or 1 against the smaller enabled bound; with none enabled, against zero."""
    bounds = []
    if absolute is not None:
        bounds.append(F.lit(absolute).cast("decimal(38,0)"))
    if bps is not None:
        bounds.append(F.floor(F.lit(bps).cast("decimal(19,0)") * F.abs(base.cast("decimal(19,0)")) / F.lit(10000)).cast("decimal(38,0)"))
    bound = F.least(*bounds) if len(bounds) > 1 else bounds[0] if bounds else F.lit(0).cast("decimal(38,0)")
    return F.signum(diff.cast("decimal(38,0)") - bound).cast("int")


def tolerance_base(a: Column, b: Column) -> Column:
    """The larger of the signed values, which ``within`` takes by magnitude."""
    return F.greatest(a, b)
