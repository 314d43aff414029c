"""Prices and currencies, as Column expressions.  Money is DECIMAL(14, 2); halves round to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

MONEY = "decimal(14,2)"


def parse_price(value: Column) -> Column:
    """The first number of a text, spaces left out and a comma read as a point; null if there is none."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", ""), ",", ".")
    number = F.nullif(F.regexp_extract(flat, r"-?\d+(?:\.\d+)?", 0), F.lit(""))
    return F.bround(number.try_cast("decimal(28,8)"), 2).cast(MONEY)


def price_from_text(text: Column) -> Column:
    """The first amount of money that is nowhere in the text an instalment."""
    text = F.coalesce(text, F.lit(""))
    amounts = F.transform(F.regexp_extract_all(text, F.lit("(?iu)" + vocab.AMOUNT), F.lit(1)), parse_price)
    parts = F.transform(F.regexp_extract_all(text, F.lit("(?iu)" + vocab.INSTALMENT), F.lit(1)), parse_price)
    return F.get(F.filter(amounts, lambda p: p.isNotNull() & ~F.array_contains(parts, p)), F.lit(0))


def positive(price: Column) -> Column:
    return F.when(price > 0, price)


def effective_price(price: Column, original: Column, discounted: Column, has_discount: Column) -> Column:
    return F.coalesce(F.when(has_discount, positive(discounted)), positive(price), positive(original))


def currency_code(value: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.upper(F.trim(value)), 1, 3), F.lit("")), F.lit("UAH"))


def currency_label(value: Column) -> Column:
    text = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(text.isin(*vocab.HRYVNIA), F.lit("UAH")).otherwise(text)


def currency_of_symbol(symbol: Column) -> Column:
    out = F.lit("UAH")
    for k, v in vocab.CURRENCY_SYMBOLS.items():
        out = F.when(F.trim(symbol) == k, F.lit(v)).otherwise(out)
    return out


def middle(low: Column, high: Column) -> Column:
    """The mean of the middle two prices, to cents; null without them."""
    return F.bround((low.cast("decimal(16,3)") + high) * F.lit("0.5").cast("decimal(2,1)"), 2).cast(MONEY)


def recommended(lowest: Column, count: Column) -> Column:
    """Six percent below the lowest price in whole units, 1 at least; null for a thin market."""
    cut = F.bround(lowest * F.lit(vocab.DISCOUNT).cast("decimal(3,2)"), 0)
    return F.when(count >= vocab.MIN_SAMPLE, F.greatest(cut, F.lit(1).cast("decimal(14,0)")).cast("decimal(14,0)"))


def cents(price: Column) -> Column:
    return (price * 100).cast("long")


def display_price(price: Column) -> Column:
    """Thousands set apart by spaces; decimals only where there are any."""
    whole = price == F.floor(price)
    return F.when(whole, F.replace(F.format_number(price, 0), F.lit(","), F.lit(" "))).otherwise(F.replace(F.format_number(price, 2), F.lit(","), F.lit(" ")))


def display_date(ts: Column) -> Column:
    month = F.element_at(F.array(*map(F.lit, vocab.MONTHS)), F.month(ts))
    return F.concat_ws(" ", F.dayofmonth(ts).cast("string"), month, F.year(ts).cast("string"), F.lit("о"), F.date_format(ts, "HH:mm"))
