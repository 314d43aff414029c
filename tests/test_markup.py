"""Tags and feed rows of pages, also of broken ones."""

import random

import pytest

from pricelark.sources import markup


def test_ld_blocks():
    html = """<SCRIPT Type='Application/LD+JSON; charset=utf-8'>{"a": 1}</script><script>var x = "application/ld+json";</script>
    <script type="application/ld+json">{broken</script><script type="text/x" data-k="application/ld+json">{"no": 1}</script><script type="application/ld+json">[1, "</b>"]</script><script type="application/ld+json">{"cut": 2}"""
    assert markup.ld_blocks(html) == [{"a": 1}, [1, "</b>"], {"cut": 2}]
    assert markup.ld_blocks("") == markup.ld_blocks("ld+json") == markup.ld_blocks("<ld+json") == []


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<span itemprop="price">1 250,5 грн</span>', ["1 250,5 грн"]),
        ("<meta itemprop=price content='7'>", ["7"]),
        ('<b itemprop="priceCurrency">UAH</b><b ITEMPROP="price">9', ["9"]),
        ('<meta property="og:price:amount" content="77"><i itemprop="price">5</i>', ["5", "77"]),
        ('<meta content="3" name="og:price:amount"><div data-x="og:price:amount">4</div>', ["3"]),
        ("text itemprop=price without a tag", []),
        ("", []),
    ],
)
def test_tagged_prices(html, want):
    assert markup.tagged_prices(html) == want


def _row(attrs="", cells=""):
    return f'<tr {markup.ROW_MARK}="true" {attrs}>{cells}</tr>'


def test_feed_rows():
    cells = '<td data-type="maker"><b>A &amp;</b> <i>B</i></td><td data-type="code" title="8E0 &quot;5&quot;" href="/part-1/"></td><td title="опис"><span class="x ap-feed__table__descr">y</span></td><td data-type="price" data-value="12.5"><b data-type="currency"> $ </b></td>'
    rows, token, is_feed = markup.feed(_row('data-wh-id="w" data-is-boost-position="1"', cells) + "<tr><td>no row</td></tr>" + '<a data-token="{&quot;n&quot;: 1}"><a data-token="second">')
    assert (len(rows), token, is_feed) == (1, '{"n": 1}', True)
    r = rows[0]
    assert (r["maker"], r["code"], r["part_uri"], r["description"], r["price"], r["currency"], r["warehouse_id"], r["boosted"], r["used"]) == ("A & B", '8E0 "5"', "/part-1/", "опис", "12.5", "$", "w", True, False)


@pytest.mark.parametrize(
    ("row", "used"),
    [
        (_row('data-bu="1"'), True), (_row('data-bu="0"'), False), (_row('data-is-cardismantling="TRUE"'), True), (_row(cells="<td><span> Б / У </span></td>"), True),
        (_row(cells='<td title="деталі, що Были  в\nупотреблении"></td>'), True), (_row(cells="<td>були нові</td>"), False),
    ],
)
def test_used_rows(row, used):
    assert markup.feed(row)[0][0]["used"] is used


def test_pages_that_are_no_feed():
    assert markup.feed(None) == markup.feed("<html>robot check</html>") == ([], None, False)
    assert markup.feed('<div class="ap-feed">nothing found</div>') == ([], None, True)
    assert markup.feed(_row()[:-5])[0] == []  # a row that isn't closed isn't whole


def test_plain_pages_read_as_parsed_ones(monkeypatch):
    """Pages of plain markup are read without the parser, rows and token alike; the parser reads all others."""
    parts = [
        f'<tr {markup.ROW_MARK}="true" data-wh-id="3">', f'<tr {markup.ROW_MARK}="true" data-bu="1">', "</tr>", '<td data-type="maker" title="a &amp; b">', "</td>", "<b>", "Bosch", "&lt;x&gt; &amp", "a&notit b", "б/ у", "были  в\nупотреблении",
        '<a data-type="code" title="q" href="/p/">', '<span data-type="currency">', "</span>", " грн ", '<i x="были &#1074; употреблении" y="1" x="2">', '<a data-token="{&quot;n&quot;: 1}">', '<a data-token="">', '<b title=" data-token=">',
        '<div class="ap-feed">', '<span class="ap-feed__table__descr">', '<a data-token="x" data-token="y">', "<!-- <tr> -->", "<br/>", "<script>", "<TD>", "<td title=x>", "<", ">", '<a href="x>y">',
    ]
    draw = random.Random(3)
    made = ["".join(draw.choices(parts[:22] if n % 3 else parts, k=draw.randint(0, 25))) for n in range(3000)]
    got = [(markup.feed(h), markup.feed_token(h)) for h in made]
    assert 1000 < sum(map(markup._is_plain, made)) < 2500
    monkeypatch.setattr(markup, "_is_plain", lambda html: False)
    for h, (whole, token) in zip(made, got):
        assert (whole, token) == (markup.feed(h), markup.feed(h)[1:]), h


def test_rows_that_are_built_alike(monkeypatch):
    """Pages whose rows differ by their values alone are read as `feed` reads them, without it; all others by it (F1)."""
    monkeypatch.setattr(markup, "_LAYOUTS", {})
    draw = random.Random(4)
    values = ["1", "", "a&amp;b", "&quot;x&quot;", "были в употреблении", "&#1074; x", "<", "б/у", "currency", "ap-feed__table__descr"]
    cells = ['<td data-type="maker"><b>M</b></td>', '<td data-type="code" title="%s" href="%s"></td>', '<td title="%s"><span class="ap-feed__table__descr">x</span></td>', '<td data-type="price" data-value="%s"><b data-type="currency"> $ </b></td>', '<i x="%s">', "<td><span> б/у </span></td>", 'x "', "<br/>", '<b class="%s">']
    shapes = ["".join(_row('data-wh-id="%s"' + ' data-bu="1"' * (draw.random() < 0.2), "".join(draw.choices(cells, k=5)))[: draw.choice([None, None, None, -5])] for _ in range(draw.randint(0, 3))) + draw.choice(["", '<a data-token="%s">']) for _ in range(150)]
    made = [shape.replace("%", "%%").replace("%%s", "%s") % tuple(draw.choices(values[: draw.choice([4, 4, 4, 10])], k=shape.count("%s"))) for shape in shapes for _ in range(20)]
    by_feed = []
    whole = markup.feed
    monkeypatch.setattr(markup, "feed", lambda html: by_feed.append(html) or whole(html))
    got = [markup.feed_values(h) for h in made]
    assert 500 < len(by_feed) < 2500
    for h, (rows, token, is_feed) in zip(made, got):
        assert ([dict(zip(markup.ROW_FIELDS, r)) for r in rows], token, is_feed) == ([{c: r.get(c) for c in markup.ROW_FIELDS} for r in whole(h)[0]], *whole(h)[1:]), h


def test_rows_that_are_built_alike_stay_bounded(monkeypatch):
    monkeypatch.setattr(markup, "_LAYOUTS", {})
    monkeypatch.setattr(markup, "_KNOWN", 50)
    for n in range(500):
        markup.feed_values(_row(cells=f'<td data-type="maker">{n}</td>') * 2)
        markup.feed_values(_row(cells=f'<td data-type="k{n}"></td>') * 2)
    assert len(markup._LAYOUTS) <= 50 and all(len(found[-1]) <= 50 for found in markup._LAYOUTS.values() if isinstance(found, tuple) and found)
