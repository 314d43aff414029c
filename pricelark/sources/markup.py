"""What pages say in their markup: JSON-LD, microdata and meta tags, rows of a parts feed.

Runs inside Arrow batches.  Tags are read by the standard HTML parser; of a large page only the tags
around a word that is looked for are, which `str.find` finds.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from operator import itemgetter


class _OneTag(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = None

    def handle_starttag(self, tag, attrs):
        self.found = self.found or (tag, {k: v or "" for k, v in reversed(attrs)})

    handle_startendtag = handle_starttag


def tags_with(html: str, word: str) -> Iterator[tuple[str, dict, int]]:
    """(name, attributes, end) of the opening tags whose source holds ``word``, in any case, in order."""
    low, at = html.lower(), 0
    while (at := low.find(word, at)) >= 0:
        start, end = low.rfind("<", 0, at), low.find(">", at)
        if start < 0 or end < 0:
            return
        if low.find(">", start, at) < 0:
            reader = _OneTag()
            reader.feed(html[start : end + 1])
            if reader.found:
                yield (*reader.found, end + 1)
                at = end
        at += 1


def ld_blocks(html: str) -> list:
    """The JSON values of the page's JSON-LD scripts; those that are no JSON are left out."""
    out = []
    for name, attrs, end in tags_with(html, "ld+json"):
        if name == "script" and attrs.get("type", "").strip().lower().startswith("application/ld+json"):
            close = html.lower().find("</script", end)
            try:
                out.append(json.loads(html[end : close if close >= 0 else len(html)]))
            except ValueError:
                continue
    return out


def tagged_prices(html: str) -> list[str]:
    """Texts that may be a price: of microdata (``itemprop="price"``), then of ``og:price:amount`` meta tags, in order.

    A tag's ``content`` counts, or else the text between it and the next tag.
    """
    out = []
    for word, key, wanted, only in (("itemprop", "itemprop", "price", None), ("og:price:amount", "property", "og:price:amount", "meta")):
        for name, attrs, end in tags_with(html, word):
            named = attrs.get(key) or (attrs.get("name") if only else None)
            if named == wanted and (only is None or name == only):
                close = html.find("<", end)
                out.append(attrs["content"] if "content" in attrs else html[end : close if close >= 0 else len(html)])
    return out


#: Attributes and texts of the feed's markup.  Fixed values.
ROW_MARK, TOKEN, WAREHOUSE, BOOST = "data-interactive-feed-item-element", "data-token", "data-wh-id", "data-is-boost-position"
USED_FLAGS = {"data-bu": "1", "data-is-cardismantling": "true"}
USED_TEXT, USED_BADGE = "были в употреблении", "б/у"
DESCRIPTION = "ap-feed__table__descr"
FEED_CLASS = "ap-feed"
_USED_WORD = USED_TEXT.split()[-1]

#: Markup that needs no parser: lower-case tags, quoted values, no comment, declaration or closed-in-itself tag; text elements apart.
_TAG = r'<[a-z][a-z0-9]*(?: +[a-z][a-z0-9-]*="[^"<>]*")* *>'
_PLAIN = re.compile(rf"(?:[^<]++|{_TAG}|</[a-z][a-z0-9]*>)*+")
_TEXT_ELEMENT = re.compile(r"<(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)")
_PARTS = re.compile(r"<(/?)([a-z][a-z0-9]*)([^>]*)>([^<]*)")
_ATTRIBUTE = re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')


def _is_plain(html: str) -> bool:
    return _PLAIN.fullmatch(html) is not None and _TEXT_ELEMENT.search(html) is None


@lru_cache(4096)
def _escaped_attributes(tag: str) -> tuple:
    """Attributes of a tag that holds character references, as the parser reads them."""
    reader = _TagAttributes()
    reader.feed(tag)
    return tuple(reader.found)


class _TagAttributes(HTMLParser):
    found: list = []

    def handle_starttag(self, tag, attrs):
        self.found = attrs


def _read_plain(html: str, reader: FeedReader) -> None:
    """Gives ``reader`` the parts of a plain page, the same that its parser would."""
    for closing, tag, inside, said in _PARTS.findall(html):
        if closing:
            reader.handle_endtag(tag)
        elif not inside:
            reader.handle_starttag(tag, ())
        else:
            reader.handle_starttag(tag, _escaped_attributes(f"<{tag}{inside}>") if "&" in inside else _ATTRIBUTE.findall(inside))
        if said:
            reader.handle_data(entities.unescape(said) if "&" in said else said)


def _says_used(value: str) -> bool:
    low = value.lower()
    return _USED_WORD in low and USED_TEXT in " ".join(low.split())


class FeedReader(HTMLParser):
    """Rows of a feed page as dicts of texts, and the token of its continuation."""

    def __init__(self):
        super().__init__()
        self.rows: list[dict] = []
        self.token = None
        self.row = self.cell = self.title = None
        self.opened: list[str] = []  # kinds of the elements around the text that is read
        self.in_currency = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if TOKEN in a and self.token is None:
            self.token = a[TOKEN]
        if tag == "tr" and a.get(ROW_MARK) == "true":
            self.row = {"warehouse_id": a.get(WAREHOUSE), "boosted": a.get(BOOST) == "1", "used": any(a.get(k, "").lower() == v for k, v in USED_FLAGS.items()), "maker": [], "currency": []}
            self.cell = None
        if self.row is None:
            return
        kind = a.get("data-type")
        if tag == "td":
            self.cell, self.title = kind, a.get("title")
        if kind == "code":
            self.row |= {"code": a.get("title"), "part_uri": a.get("href")}
        elif kind == "delivery":
            self.row |= {"city": a.get("data-city"), "availability": a.get("data-tooltip-content")}
        elif kind == "price":
            self.row["price"] = a.get("data-value")
        elif DESCRIPTION in a.get("class", "") and self.title is not None:
            self.row["description"] = self.title or None
        self.in_currency = kind == "currency"
        self.row["used"] |= any(_says_used(v) for v in a.values())

    def handle_data(self, data):
        if self.row is None:
            return
        said = " ".join(data.lower().split())
        self.row["used"] |= USED_TEXT in said or said.replace(" ", "") == USED_BADGE
        if self.in_currency and data.strip():
            self.row["currency"].append(data.split()[0])
            self.in_currency = False
        if self.cell == "maker":
            self.row["maker"].append(data)

    def handle_endtag(self, tag):
        if tag == "td":
            self.cell = None
        elif tag == "tr" and self.row is not None:
            maker = " ".join(" ".join(self.row["maker"]).split())
            self.rows.append(self.row | {"maker": maker or None, "currency": next(iter(self.row["currency"]), None)})
            self.row = None


def feed(html: str | None) -> tuple[list[dict], str | None, bool]:
    """(rows, token, whether the page is a feed at all)."""
    html = html or ""
    reader = FeedReader()
    if _is_plain(html):
        _read_plain(html, reader)
    else:
        reader.feed(html)
        reader.close()
    return reader.rows, reader.token, bool(reader.rows) or FEED_CLASS in html


def feed_token(html: str | None) -> tuple[str | None, bool]:
    """(token, whether the page is a feed at all): what `feed` gives, its rows only read where that needs them."""
    html = html or ""
    if FEED_CLASS not in html or not _is_plain(html):
        return feed(html)[1:]
    at = html.find(f' {TOKEN}="')
    while at >= 0:
        start, end = html.rfind("<", 0, at), html.find(">", at)
        if html.find(">", start, at) < 0:
            inside = html[start : end + 1]
            for name, value in _escaped_attributes(inside) if "&" in inside else _ATTRIBUTE.findall(inside):
                if name == TOKEN:
                    return value or "", True
        at = html.find(f' {TOKEN}="', at + 1)
    return None, True


# --- pages of rows that are built alike -------------------------------------------------------

#: A row's values, in order.
ROW_FIELDS = ("maker", "code", "part_uri", "description", "city", "availability", "price", "currency", "warehouse_id", "boosted", "used")
_DESCRIPTION = ROW_FIELDS.index("description")
#: Attributes whose value decides what is read; all others are only copied.
_DECIDE = {ROW_MARK, BOOST, *USED_FLAGS, "data-type", "class"}
_NAMED = re.compile(r" ([a-z][a-z0-9-]*)=$")
_REFERENCES = {"&quot;": '"', "&lt;": "<", "&gt;": ">", "&amp;": "&"}
_BEFORE = "\2"  # the title of a cell before the piece
#: `_layout` of markup without its values; 1 where it was seen once, emptied when there are ``_KNOWN``.
_LAYOUTS: dict = {}
_KNOWN = 10_000


@lru_cache(4096)
def _unescaped(value: str) -> str:
    for k, v in _REFERENCES.items():  # &amp; is the last
        value = value.replace(k, v)
    return value


def _once_more(known: dict, key, make, *args):
    """What ``make`` gives for a key that was seen before; None at first, so that markup that varies costs little more."""
    if key not in known:
        if len(known) >= _KNOWN:
            known.clear()
        known[key] = 1
        return None
    known[key] = found = make(key, *args) or ()
    return found


def _layout(skeleton: tuple[str, ...]) -> tuple | None:
    """(places of the deciding values, what picks them, number of ``<``, of ``>``, plans by what is picked) of plain markup without its values; None if it isn't plain."""
    names = [_NAMED.search(s) for s in skeleton[:-1]]
    whole = '"0"'.join(skeleton)
    if None in names or not _is_plain(whole) or sum(len(_ATTRIBUTE.findall(inside)) for closing, _, inside, _ in _PARTS.findall(whole) if not closing) != len(names):
        return None
    places = [2 * i + 1 for i, n in enumerate(names) if n[1] in _DECIDE]
    return places, itemgetter(0, 0, *places), whole.count("<"), whole.count(">"), {}


def _plan(deciding: tuple[str, ...], skeleton: tuple[str, ...], places: list[int]) -> tuple | None:
    """(fixed values, places of a row's copied values, what picks a row of both, what picks the token) of a piece: the reader is shown marks instead of values.

    None where a row isn't closed in its piece, or is more than values put into their fields.
    """
    said = dict(zip([0, 0, *places], deciding))
    values = [said.get(i, f"\1{i}\1") for i in range(1, 2 * len(skeleton) - 1, 2)]
    if any("&" in v for v in values):
        return None
    reader = FeedReader()
    reader.title = _BEFORE
    _read_plain("".join([f'{s}"{v}"' for s, v in zip(skeleton, values)]) + skeleton[-1], reader)
    if reader.row is not None or len(reader.rows) > 1:
        return None
    fixed, picked, copied = [], [], []
    for value in [*[r.get(c) for r in reader.rows for c in ROW_FIELDS], reader.token]:
        if isinstance(value, str) and (_BEFORE in value or "\1" in value):
            at = value.strip("\1")
            if value != f"\1{at}\1" or not at.isdigit():
                return None
            copied.append(int(at))
            picked.append(int(at))
        else:
            picked.append(2 * len(skeleton) - 1 + len(fixed))
            fixed.append(value)
    return fixed, copied, itemgetter(*picked[:-1]) if reader.rows else None, picked[-1] if reader.token is not None else None


def _pieces(html: str) -> tuple[list[tuple], str | None] | None:
    """(rows, token) of a page whose pieces, cut before each row, were all seen before but for their values; None of any other page."""
    if "\1" in html or _BEFORE in html or (("б" in html or "Б" in html) and _USED_WORD in html.lower()):
        return None
    references = "&" in html
    if references and html.count("&") != sum(map(html.count, _REFERENCES)):
        return None
    rows, token, opening, closing = [], None, 0, 0
    for nth, piece in enumerate(html.split("<tr ")):
        parts = (f"<tr {piece}" if nth else piece).split('"')
        skeleton = tuple(parts[::2])
        layout = _LAYOUTS.get(skeleton, 1)
        if layout == 1:
            layout = _once_more(_LAYOUTS, skeleton, _layout) if len(parts) % 2 else None
        if not layout or len(parts) % 2 == 0:
            return None
        places, picked, more_opening, more_closing, plans = layout
        opening += more_opening
        closing += more_closing
        deciding = picked(parts)
        plan = plans.get(deciding, 1)
        if plan == 1:
            plan = _once_more(plans, deciding, _plan, skeleton, places)
        if not plan:
            return None
        fixed, copied, row, told = plan
        if references:
            for i in copied:
                if "&" in parts[i]:
                    parts[i] = _unescaped(parts[i])
        parts += fixed
        if row:
            found = row(parts)
            rows.append(found if found[_DESCRIPTION] != "" else (*found[:_DESCRIPTION], None, *found[_DESCRIPTION + 1 :]))
        if token is None and told is not None:
            token = parts[told]
    # A value that holds a tag's end would be cut otherwise by the reader.
    return (rows, token) if opening == html.count("<") and closing == html.count(">") else None


def feed_values(html: str | None) -> tuple[list[tuple], str | None, bool]:
    """What `feed` gives, rows as tuples of their ``ROW_FIELDS``.  Of rows that are built alike only the values are read; any other page is read by `feed`."""
    html = html or ""
    got = _pieces(html)
    if got is None:
        rows, token, is_feed = feed(html)
        return [tuple([r.get(c) for c in ROW_FIELDS]) for r in rows], token, is_feed
    return *got, bool(got[0]) or FEED_CLASS in html
