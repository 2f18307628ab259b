"""Small column builders shared by the plans."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r(c: str | Column, digits: int = 4) -> Column:
    return F.round(col(c), digits)


def ratio(num: str | Column, den: str | Column) -> Column:
    """Null instead of an error when the denominator is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def ratio0(num: str | Column, den: str | Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def sum_if(cond: Column, value: str | Column) -> Column:
    """Conditional sum that is 0 on no match."""
    return F.sum(F.when(cond, col(value)).otherwise(F.lit(0)))


def above(value: str | Column, steps: Sequence[tuple[float, object]], default: object) -> Column:
    """First label whose threshold is strictly below ``value`` (steps in descending order)."""
    return _bands(steps, default, lambda t: col(value) > F.lit(t))


def at_least(value: str | Column, steps: Sequence[tuple[float, object]], default: object) -> Column:
    return _bands(steps, default, lambda t: col(value) >= F.lit(t))


def below(value: str | Column, steps: Sequence[tuple[float, object]], default: object) -> Column:
    """First label whose threshold is strictly above ``value`` (steps in ascending order)."""
    return _bands(steps, default, lambda t: col(value) < F.lit(t))


def _bands(steps, default, test) -> Column:
    out = None
    for threshold, label in steps:
        out = F.when(test(threshold), F.lit(label)) if out is None else out.when(test(threshold), F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def is_buy(side: str | Column = "side") -> Column:
    return F.lower(col(side)) == F.lit("buy")


def scaled(raw: str | Column, decimals: str | Column) -> Column:
    """Raw on-chain integer to a human amount, each factor scaled on its own."""
    return col(raw).cast("double") / F.pow(F.lit(10.0), col(decimals).cast("double"))


def mul_div_floor(quantity: str | Column, price: str | Column, decimals: str | Column) -> Column:
    """floor(quantity * price / 10^decimals) on raw integers whose product would not fit 38 digits.

    The quantity is split into whole units and a remainder, so every partial product is exact.
    """
    big = lambda c: col(c).cast("decimal(38,0)")
    unit = F.pow(F.lit(10.0), col(decimals)).cast("decimal(38,0)")
    q, p = big(quantity), big(price)
    rest = q % unit
    part = (rest * p).cast("decimal(38,0)")
    whole = ((q - rest) / unit).cast("decimal(38,0)")
    return ((whole * p).cast("decimal(38,0)") + ((part - part % unit) / unit).cast("decimal(38,0)")).cast("decimal(38,0)")


def kind_of(df, name: str):
    """Data type of a column, to keep raw amounts in the type they arrive in."""
    return df.schema[name].dataType


def seq(block: str | Column = "block_number", log_index: str | Column = "log_index") -> Column:
    """One long that orders events like (block, log index); keeps min_by/max_by in hash aggregation."""
    return F.shiftleft(col(block).cast("long"), 31) + col(log_index).cast("long")


def time_order(df) -> Column:
    """One number that orders rows by (ts, seq, chain): event order inside a chain, time where chains meet.

    ``seq`` counts a chain's own blocks, so it says nothing across chains. A decimal, unlike a struct, keeps
    min_by/max_by in hash aggregation. Seconds up to 11 digits, seq up to 19; equal (ts, seq) go by chain id.
    """
    order = F.col("ts").cast("decimal(11,0)") * F.lit(Decimal(10**19)) + F.col("seq").cast("decimal(19,0)")
    if "chain_id" not in df.columns:
        return order.cast("decimal(38,0)")
    return (order * F.lit(Decimal(10**7)) + F.pmod(F.col("chain_id"), F.lit(10**7)).cast("decimal(8,0)")).cast("decimal(38,0)")


def row_key(*parts: str | Column) -> Column:
    """sha-256 of the parts joined by ``_``; null parts become the word ``null`` instead of vanishing."""
    texts = [F.coalesce(col(p).cast("string"), F.lit("null")) for p in parts]
    return F.sha2(F.concat_ws("_", *texts), 256)


def currency_address(id_hex: str | Column) -> Column:
    """Numeric currency id, given as hex text so that any width fits, to a 20-byte address."""
    digits = F.regexp_replace(F.lower(col(id_hex)), "^0x", "")
    return F.concat(F.lit("0x"), F.lpad(digits, 40, "0"))


def currency_address_from_long(id_long: str | Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(col(id_long).cast("long"))), 40, "0"))


def format_amount(amount: str | Column) -> Column:
    """Six places for tiny positive amounts, otherwise two to six with trailing zeros trimmed."""
    six = F.format_number(col(amount), 6)
    trimmed = F.regexp_replace(six, r"(\.\d\d\d*?)0+$", "$1")
    return F.when((col(amount) > 0) & (col(amount) < 0.01), six).otherwise(trimmed)


def format_usd(amount: str | Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(col(amount), 2))


def format_bps(bps: str | Column) -> Column:
    """Basis points as a one-decimal percentage."""
    return F.concat(F.format_number(col(bps) / 100.0, 1), F.lit("%"))


def plain_symbol(symbol: str | Column) -> Column:
    """Strip the synthetic-token prefix ``gs``."""
    return F.when(F.substring(col(symbol), 1, 2) == "gs", F.expr("substring(%s, 3)" % symbol)
                  if isinstance(symbol, str) else F.regexp_replace(symbol, "^gs", "")).otherwise(col(symbol))


def format_bytes(n: str | Column) -> Column:
    c = col(n).cast("double")
    return (
        F.when(c >= 1 << 30, F.concat(F.format_number(c / (1 << 30), 2), F.lit(" GB")))
        .when(c >= 1 << 20, F.concat(F.format_number(c / (1 << 20), 2), F.lit(" MB")))
        .when(c >= 1 << 10, F.concat(F.format_number(c / (1 << 10), 2), F.lit(" KB")))
        .otherwise(F.concat(F.format_number(c, 0), F.lit(" B")))
    )


def format_duration(seconds: str | Column) -> Column:
    c = col(seconds).cast("long")
    h, m, s = F.floor(c / 3600), F.floor(F.pmod(c, F.lit(3600)) / 60), F.pmod(c, F.lit(60))
    return (
        F.when(c >= 3600, F.format_string("%dh %dm", h, m))
        .when(c >= 60, F.format_string("%dm %ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )
