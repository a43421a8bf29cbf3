"""Exact fixed decimals: ``struct<mantissa bigint, scale int>`` with a scale per row."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from tickloom.functions.common import bind, groups
from tickloom.schema import MAX_LONG, MAX_SCALE, MIN_LONG

_WIDE = "decimal(38,0)"


def _null() -> Column:
    return F.lit(None)


def fixed(mantissa: Column | int, scale: Column | int) -> Column:
    """A fixed decimal from its two parts."""
    m = mantissa if isinstance(mantissa, Column) else F.lit(mantissa)
    s = scale if isinstance(scale, Column) else F.lit(scale)
    return F.struct(m.cast("bigint").alias("mantissa"), s.cast("int").alias("scale"))


def pow10(exponent: Column) -> Column:
    """10^exponent for 0..18 as decimal(20,0), read from one constant array."""
    table = F.expr(f"array({', '.join(f'cast({10 ** k} as decimal(20,0))' for k in range(MAX_SCALE + 1))})")
    return F.try_element_at(table, exponent.cast("int") + F.lit(1))


def fits_long(wide: Column) -> Column:
    """True when a decimal(38,0) value lies in the signed 64-bit range."""
    return wide.between(F.lit(Decimal(MIN_LONG)).cast(_WIDE), F.lit(Decimal(MAX_LONG)).cast(_WIDE))


def at_scale_18(value: Column) -> Column:
    """Mantissa at the common scale 18; 19 + 18 digits always fit decimal(38,0)."""
    wide = value["mantissa"].cast("decimal(20,0)") * pow10(F.lit(MAX_SCALE) - value["scale"])
    return wide.cast(_WIDE)


def fd_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, exact across scales (1.00 equals 1).  NULL when either side is absent."""
    same = F.when(a["mantissa"] < b["mantissa"], -1).when(a["mantissa"] > b["mantissa"], 1).otherwise(0)
    x, y = at_scale_18(a), at_scale_18(b)
    other = F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return (F.when(a.isNull() | b.isNull(), _null().cast("int"))
            .when(a["scale"] == b["scale"], same).otherwise(other))


def fd_compare_literal(a: Column, mantissa: int, scale: int, op: str) -> Column:
    """``a op literal`` as a boolean.

    Rows that already have the literal's scale, nearly all rows of a real column, compare two longs;
    only the others go through wide decimals.
    """
    def test(x: Column, y: Column) -> Column:
        return {"EQ": x == y, "NE": x != y, "LT": x < y, "LTE": x <= y, "GT": x > y,
                "GTE": x >= y}[op]

    wide = F.lit(Decimal(mantissa) * 10 ** (MAX_SCALE - scale)).cast(_WIDE)
    return F.when(a["scale"] == F.lit(scale), test(a["mantissa"], F.lit(mantissa).cast("bigint"))) \
        .otherwise(test(at_scale_18(a), wide))


def fd_rescale_error(value: Column, target: int) -> Column:
    """Why ``value`` cannot take scale ``target`` exactly, or NULL when it can."""
    up = F.lit(target) - value["scale"]
    scaled = (value["mantissa"].cast("decimal(20,0)") * pow10(up)).cast(_WIDE)
    lost = value["mantissa"].cast("decimal(20,0)") % pow10(-up)
    return (F.when((up > 0) & ~fits_long(scaled), F.lit("BigInteger out of long range"))
            .when((up < 0) & (lost != 0),
                  F.lit("scale reduction would discard nonzero fractional digits")))


def fd_rescale(value: Column, target: int) -> Column:
    """``value`` at scale ``target``; NULL where the change overflows or would lose digits."""
    up = F.lit(target) - value["scale"]
    wide = value["mantissa"].cast("decimal(20,0)")
    raised = (wide * pow10(up)).cast(_WIDE)
    # div() of two decimals is exact and already a long.
    lowered = F.call_function("div", wide, pow10(-up))
    return (F.when(up == 0, value)
            .when((up > 0) & fits_long(raised), fixed(raised, target))
            .when((up < 0) & (wide % pow10(-up) == 0), fixed(lowered, target)))


def fd_plain(value: Column) -> Column:
    """Plain text with every stored fraction digit kept: ``-5 / 2`` is ``-0.05``."""
    text = value["mantissa"].cast("string")
    negative = text.startswith("-")
    digits = F.when(negative, F.substring(text, F.lit(2), F.lit(20))).otherwise(text)
    scale = value["scale"]
    padded = F.lpad(digits, F.greatest(F.length(digits), scale + F.lit(1)), F.lit("0"))
    cut = F.length(padded) - scale
    return (F.when(scale == 0, text)
            .otherwise(F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")),
                                F.substring(padded, F.lit(1), cut), F.lit("."),
                                F.substring(padded, cut + F.lit(1), scale))))


def long_parse(text: Column) -> Column:
    """Exact signed 64-bit text; NULL for blanks around digits, fractions or overflow."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))


def _digits_to_long(digits: Column) -> Column:
    """Signed digits of any length, leading zeros included, as a long or NULL."""
    short = F.regexp_replace(digits, r"^(-?)0+(?=[0-9])", "$1")
    wide = F.when(F.length(short) <= 20, short.try_cast(_WIDE))
    return F.when(fits_long(wide), wide.cast("bigint"))


def fd_parse(text: Column) -> Column:
    """Optional ``-``, digits, optional ``.digits`` of at most 18; NULL otherwise."""
    # Up to nine digits on each side, nearly every value, need one pattern and one cast.
    point = F.instr(text, ".")
    quick = fixed(F.replace(text, F.lit("."), F.lit("")).try_cast("bigint"),
                  F.when(point == 0, 0).otherwise(F.length(text) - point))
    return F.when(text.rlike(r"^-?[0-9]{1,9}(\.[0-9]{1,9})?\z"), quick) \
        .when(fd_parse_error(text).isNull(),
              fixed(_digits_to_long(F.replace(text, F.lit("."), F.lit(""))),
                        F.length(F.regexp_extract(text, r"\.([0-9]+)\z", 1))))


def fd_parse_error(text: Column) -> Column:
    """Why ``text`` is no fixed decimal, or NULL when it is one."""
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    fraction = F.regexp_extract(text, r"\.([0-9]+)\z", 1)
    return (F.when(text == "", F.lit("fixed decimal text must not be empty"))
            .when(text == "-", F.lit("fixed decimal text must contain digits"))
            .when(dots > 1, F.lit("fixed decimal text must contain at most one decimal point"))
            .when(~text.rlike(r"^-?[0-9]+(\.[0-9]+)?\z"),
                  F.lit("fixed decimal text must contain digits with an optional decimal point"))
            .when(F.length(fraction) > MAX_SCALE,
                  F.lit(f"fixed decimal scale must be between 0 and {MAX_SCALE}"))
            .when(_digits_to_long(F.replace(text, F.lit("."), F.lit(""))).isNull(),
                  F.lit("value cannot be converted exactly: BigInteger out of long range")))


_PRICE = r"^([+-]?)(?:([0-9]+)(?:\.([0-9]*))?|\.([0-9]+))(?:[eE]([+-]?[0-9]{1,10}))?\z"


def price_at_scale(text: Column, scale: int) -> Column:
    """Mantissa of decimal text at ``scale``; exponents allowed, NULL unless exact and in range.

    Works on the digit text, so numbers of more than 38 digits keep their meaning.
    """
    null = F.lit(None).cast("bigint")

    def exact(g: Column) -> Column:
        fraction = F.concat(g["g3"], g["g4"])
        digits = F.ltrim(F.concat(g["g2"], fraction), F.lit("0"))
        exponent = F.when(g["g5"] == "", F.lit(0).cast("bigint")).otherwise(g["g5"].try_cast("bigint"))
        parts = F.struct(g["g1"].alias("sign"), digits.alias("digits"),
                         F.rtrim(digits, F.lit("0")).alias("core"), exponent.alias("exponent"),
                         F.length(fraction).alias("places"))
        return bind(parts, scaled)

    def scaled(d: Column) -> Column:
        shift = (d["exponent"] - d["places"] + F.lit(scale) + F.length(d["digits"]) - F.length(d["core"]))
        zeros = F.repeat(F.lit("0"), F.when(shift.between(0, 19), shift).otherwise(0).cast("int"))
        wide = F.concat(d["sign"], d["core"], zeros).try_cast(_WIDE)
        return (F.when(~d["exponent"].between(-2147483647, 2147483647), null)
                .when(d["core"] == "", F.lit(0).cast("bigint"))
                .when((shift < 0) | (F.length(d["core"]) + shift > 19), null)
                .when(fits_long(wide), wide.cast("bigint")))

    # Short plain numbers, nearly every cell of a real file, take one pattern and one cast.
    plain = rf"^-?[0-9]{{1,15}}(\.[0-9]{{1,{scale}}})?\z" if scale else r"^-?[0-9]{1,15}\z"
    quick = (text.try_cast(f"decimal({15 + scale},{scale})")
             * F.lit(Decimal(10 ** scale)).cast("decimal(19,0)")).cast("bigint")
    return (F.when(text.rlike(plain) & F.lit(scale <= 3), quick)
            .when(text.rlike(_PRICE), bind(groups(text, _PRICE, 5), exact)))
