"""Text, part numbers, matching and gates, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


#: The letter that a pattern's matches begin with; a pattern with alternatives outside of brackets has none.
_FIRST = re.compile(r"(?:\\b)?(\w)(?![?*{])")


def _one_of(patterns) -> str:
    """The patterns as one; where each begins with a letter, those of a letter are tried only at that letter."""
    first = [_FIRST.match(p) if "|" not in re.sub(r"\([^()]*\)", "", p) else None for p in patterns]
    if None in first:
        return "|".join(f"(?:{p})" for p in patterns)
    by: dict[str, list[str]] = {}
    for found, p in zip(first, patterns):
        by.setdefault(found[1], []).append(p)
    return f"(?=[{''.join(sorted(by))}])(?:" + "|".join(f"(?={k})(?:{'|'.join(v)})" for k, v in sorted(by.items())) + ")"


def any_of(text: Column, patterns) -> Column:
    """Whether one of the patterns (in lower case) occurs, in any case; null text has none.

    The text is put in lower case once: patterns that ignore case cost many times as much at each character.
    """
    return F.coalesce(F.lower(text).rlike("(?U)" + _one_of(patterns)), F.lit(False))


def present(text: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def fold(text: Column) -> Column:
    """Lower case, with ß as ss and a final sigma as a sigma."""
    return F.replace(F.translate(F.lower(text), "ς", "σ"), F.lit("ß"), F.lit("ss"))


# --- words and similarity ---------------------------------------------------------------


def name_tokens(name: Column) -> Column:
    """Lower-case words of two characters or more, bar stop words, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    stop = F.array(*map(F.lit, vocab.STOP_WORDS))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))


def token_similarity(a: Column, b: Column) -> Column:
    """Mean of Jaccard and containment of two token sets, to three places; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    jaccard = both / F.size(F.array_union(a, b))
    inside = both / F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.bround(jaccard * 0.5 + inside * 0.5, 3))


def shared_similarity(both: Column, a: Column, b: Column) -> Column:
    """`token_similarity` of two sets of ``a`` and ``b`` words, one at least, that share ``both``."""
    return F.bround(both / (a + b - both) * 0.5 + both / F.least(a, b) * 0.5, 3)


def _side(tokens: Column, group) -> Column:
    side = F.lit(None).cast("int")
    for i, beginnings in reversed(list(enumerate(group))):
        has = F.exists(tokens, lambda t: F.lit(False) | _starts(t, beginnings))
        side = F.when(has, F.lit(i)).otherwise(side)
    return side


def _starts(token: Column, beginnings) -> Column:
    out = F.lit(False)
    for b in beginnings:
        out = out | token.startswith(b)
    return out


def laterality_conflict(a: Column, b: Column) -> Column:
    """Whether two token lists name opposite sides in a group; the first side of a group that occurs is the one named."""
    out = F.lit(False)
    for group in vocab.SIDES:
        out = out | F.coalesce(_side(a, group) != _side(b, group), F.lit(False))
    return out


def brands_compatible(a: Column, b: Column) -> Column:
    a, b = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    return (a == "") | (b == "") | (a == b)


def market_brand(brand: Column) -> Column:
    """Null for a house brand."""
    return F.when(F.lower(F.trim(F.coalesce(brand, F.lit("")))).isin(*vocab.OWN_BRANDS), F.lit(None)).otherwise(brand)


def stems(tokens: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(tokens, lambda t: F.length(t) >= vocab.STEM), lambda t: F.substring(t, 1, vocab.STEM)))


def topic_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(stems(a), stems(b)), F.lit(False))


# --- part numbers --------------------------------------------------------------------


def norm_code(value: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), r"(?iu)[^0-9A-ZА-ЯІЇЄЁ]+", "")


def is_car_model(token: Column) -> Column:
    return F.coalesce(token.rlike(rf"^(?:{'|'.join(vocab.CAR_NAMES)})[A-Z]{{0,2}}\d{{1,4}}$"), F.lit(False))


def normalize_oem(value: Column) -> Column:
    """Upper case without white space; null if shorter than 4, without a letter or digit, or a car model."""
    token = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", ""))
    fine = (F.length(token) >= 4) & token.rlike(r"[\p{L}\p{N}]") & ~is_car_model(token)
    return F.when(fine, token)


def part_number(value: Column) -> Column:
    """A token of 6 or more Latin letters and digits with two digits at least; null if it has a dot or is a car model."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    token = F.upper(F.regexp_replace(raw, r"(?U)[\s\-]+", ""))
    fine = ~raw.contains(".") & (F.length(token) >= 6) & token.rlike(r"^(?=(?:\D*\d){2})[A-Z0-9]+$") & ~is_car_model(token)
    return F.when(fine, token)


def number_list(value: Column) -> Column:
    """Part numbers of a comma-separated list."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), part_number)
    return F.filter(parts, lambda x: x.isNotNull())


def order_numbers(numbers: Column) -> Column:
    """Distinct numbers, those with a letter first, each part in its order."""
    each = F.array_distinct(numbers)
    letter = lambda x: x.rlike(r"\p{L}")
    return F.concat(F.filter(each, letter), F.filter(each, lambda x: ~letter(x)))


def file_numbers(code: Column, mpn: Column, first: Column, second: Column, queries: Column) -> Column:
    """Numbers of an export row: its own four fields, then those among its search phrases."""
    own = F.filter(F.array(*map(normalize_oem, (code, mpn, first, second))), lambda x: x.isNotNull())
    return order_numbers(F.array_distinct(F.concat(own, number_list(queries))))


def matchable(codes: Column) -> Column:
    """Normalised codes long enough to be looked for inside a text."""
    return F.filter(F.transform(codes, norm_code), lambda c: F.length(c) >= vocab.MIN_OEM)


def is_ambiguous(code: Column) -> Column:
    return code.rlike(r"^\d+$") & (F.length(code) < vocab.SELF_SUFFICIENT_DIGITS)


def group_key(sku: Column, listing_id: Column) -> Column:
    """Upper-case ASCII letters and digits of a SKU without the house suffix; the listing's id if none is left."""
    bare = F.upper(F.regexp_replace(F.coalesce(sku, F.lit("")), "[^0-9A-Za-z]+", ""))
    bare = F.regexp_replace(bare, "KEMP$", "")
    return F.when(bare == "", listing_id.cast("string")).otherwise(bare)


def search_terms(numbers: Column, name: Column) -> Column:
    """Two numbers and the first eight words of the name, distinct."""
    words = F.array_join(F.slice(name_tokens(name), 1, vocab.MAX_NAME_TOKENS), " ")
    terms = F.concat(F.slice(numbers, 1, vocab.MAX_OEM_TERMS), F.array(words))
    return F.array_distinct(F.filter(terms, lambda t: t != ""))


def cache_key(listing_id: Column, numbers: Column, brand: Column, name: Column, seller_ids: Column, seller_slugs: Column) -> Column:
    parts = F.concat(numbers, F.array(F.coalesce(brand, F.lit("")), name), seller_ids, seller_slugs)
    return F.concat(F.lit("competitor-prices:v12:"), listing_id.cast("string"), F.lit(":"), F.sha1(F.array_join(parts, "|")))


# --- match score ------------------------------------------------------------------------


def match_score(numbers: Column, query_name: Column, query_brand: Column, text: Column, name: Column | None = None, brand: Column | None = None) -> Column:
    """Confidence that ``text`` (and its ``name``) describes the queried part; 0 if it doesn't."""
    name = text if name is None else name
    brand = F.lit(None).cast("string") if brand is None else brand
    ours, theirs = name_tokens(query_name), name_tokens(text)
    code_text = norm_code(text)
    hits = F.filter(matchable(numbers), lambda c: F.contains(code_text, c))
    clear = F.exists(hits, lambda c: ~is_ambiguous(c))
    by_number = brands_compatible(market_brand(query_brand), brand) & (F.size(hits) > 0) & (clear | topic_overlap(ours, theirs))
    alike = token_similarity(ours, name_tokens(name))
    return (
        F.when(laterality_conflict(ours, theirs), F.lit(0.0))
        .when(by_number, F.lit(vocab.OEM_HIT))
        .when(alike >= vocab.NAME_STRONG, F.lit(vocab.NAME_STRONG_SCORE))
        .when(alike >= vocab.NAME_KEEP, F.lit(vocab.NAME_KEEP_SCORE))
        .otherwise(F.lit(0.0))
    )


# --- gates ------------------------------------------------------------------------------


def is_used(text: Column) -> Column:
    return any_of(text, vocab.USED)


def is_price_on_request(title: Column, availability: Column) -> Column:
    return any_of(title, vocab.ON_REQUEST) | any_of(availability, vocab.ON_REQUEST_STOCK)


def is_junk(title: Column, availability: Column) -> Column:
    """Used or without a price: `is_used` and `is_price_on_request`, in one pass over each text."""
    return any_of(title, vocab.USED + vocab.ON_REQUEST) | any_of(availability, vocab.USED + vocab.ON_REQUEST_STOCK)


def condition_of(title: Column, availability: Column) -> Column:
    return F.when(is_used(title) | is_used(availability), F.lit("used")).when(any_of(title, vocab.NEW), F.lit("new"))


def stock_of(availability: Column) -> Column:
    code = F.lit(None).cast("string")
    for k, v in vocab.STOCK_CODES.items():
        code = F.when(F.lower(F.trim(availability)) == k, F.lit(v)).otherwise(code)
    return F.coalesce(
        code,
        F.when(any_of(availability, vocab.OUT_OF_STOCK), F.lit("out_of_stock"))
        .when(any_of(availability, vocab.ON_ORDER), F.lit("on_order"))
        .when(any_of(availability, vocab.IN_STOCK), F.lit("in_stock")),
    )
