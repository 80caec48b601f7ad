"""Damaged tables against the grids that a reader would draw."""

import pytest

from rankloom.sources.landing import tables_of


def grids(page):
    return [[[c for _, c in row] for row in t["rows"]] for t in tables_of(page)]


GOOD = "<table><tr><td>1</td><td>Ann</td></tr><tr><td>2</td><td>Bob</td></tr></table>"
WANT = [[["1", "Ann"], ["2", "Bob"]]]


@pytest.mark.parametrize("page", [
    GOOD, GOOD.replace("</td>", ""), GOOD.replace("</tr>", ""), GOOD.replace("</td>", "").replace("</tr>", ""), GOOD.replace("</td>", "").replace("</tr>", "").replace("</table>", ""),
    "<table><tbody><td>1<td>Ann<tr><td>2<td>Bob</table>", "<table><thead><tr><td>1<td>Ann<tbody><tr><td>2<td>Bob</tfoot></table>", GOOD.replace("<td>", "<td><b>").replace("</td>", ""), GOOD.replace("Ann", "A<!-- x -->nn").upper().replace("ANN", "Ann").replace("BOB", "Bob").replace("A<!-- X -->NN", "Ann"),
    "</td></tr></table>" + GOOD + "</table>", GOOD.replace("Ann", "<script>var x = '<td>no</td>';</script>Ann"),
])
def test_missing_end_tags(page):
    assert grids(page) == WANT


def test_nested_tables_keep_the_outer_cells_text():
    page = "<table><tr><td>before<table><tr><td>in</td></tr></table>after</td><td>x</td></tr></table>"
    assert grids(page) == [[["in"]], [["beforeafter", "x"]]]
    assert grids("<table><tr><td>a<table><tr><td>in<td>2<tr><td>3</table> b<td>c") == [[["in", "2"], ["3"]], [["a b", "c"]]]
    assert grids("<table><tr><td>a</td></tr><table><tr><td>b</td></tr></table>") == [[["a"]], [["b"]]]  # in no cell: the first table has ended


def test_spans_over_implied_ends():
    page = "<table><tr><th rowspan=2>r<th colspan='2'>wide<tr><td>1<td rowspan=x>2<tr><td>3"
    assert grids(page) == [[["r", "wide", "wide"], ["r", "1", "2"], ["3"]]]
    assert grids("<table><tr><td>a<td rowspan=3>s<tr><td>b<tr></table>") == [[["a", "s"], ["b", "s"], []]]


def test_captions_headings_and_breaks():
    (t,) = tables_of("<h2>Head <i>line</i><table class='w'><caption>The <b>cap</b><tr><td>a<br>b<br/>c<h3>d</h3>")
    assert (t["heading"], t["caption"], t["class"], t["rows"]) == ("Head line", "The cap", "w", [[(False, "a b cd")]])
    assert [x["heading"] for x in tables_of("<h2>One</h2>" + GOOD + "<h3>Two" + GOOD)] == ["One", "Two"] and tables_of("") == [] and tables_of(None) == []
