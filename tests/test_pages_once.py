"""Tags that pages share are read once, and pages come out as the library's parser has them."""

from __future__ import annotations

from html.parser import HTMLParser
from random import Random

from docloom.sources import html

PAGE = "<html><body><h1>No. {0}</h1><table><tr><td colspan=\"2\">{0} &amp; more<br/>x</td><td style='display: none'>y</td></tr></table><p>end</p></body></html>"


def test_shared_tags_are_read_once(monkeypatch):
    read = []
    tag = HTMLParser.parse_starttag
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: (read.append(i), tag(self, i))[1])
    for k in range(200):
        table = html.elements(PAGE.format(k))[1]
        assert table["rows"] == [{"row_type": "body", "values": [{"val": f"{k} & more x", "colspan": 2}]}]
    assert len(read) <= 9  # of 200 pages; once each


def test_pages_are_read_as_by_the_library(monkeypatch):
    draw = Random(3)
    some = ["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<td colspan=3>", "<div a='>'>", "<b/>", "<br>", "<P q=\"1\" Q>", "</b >", "<xbrli:x>", "</xbrli:x>", "<i =>", "<!-- <p> -->", "<script>", "</script>", "<", "&lt;p&gt;", "&am", "a", " b "]
    pages = ["".join(draw.choice(some) for _ in range(draw.randrange(1, 20))) for _ in range(3000)]
    quick = [html.elements(p) for p in pages]
    assert sum(html._plain(p) is not None for p in pages) > 100
    monkeypatch.setattr(html, "_plain", lambda page: None)
    assert quick == [html.elements(p) for p in pages]
