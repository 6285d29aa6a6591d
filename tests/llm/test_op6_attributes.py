"""Attributes of blocks: only what hides an element hides its text, and pages of the table label nothing by hand."""

import pytest

from netprism.llm import html_text

P = "The council met on Tuesday to speak about the new road, which is to cross the old market square from north to south."


@pytest.mark.parametrize(("attribute", "off"), [
    ('style="list-style:none"', False), ("style='text-decoration: none; float:none'", False), ('title="the hidden valley"', False), ('data-x="aria-hidden=true"', False),
    ('data-hidden="true"', False), ('aria-hidden="false"', False), ('style="x-display:none"', False), ("data-style='display:none'", False), ("class=\"a\"title='hidden'", False),
    ("hidden", True), ('hidden=""', True), ('style="color:red; DISPLAY : none !important"', True), ("style='visibility:hidden;'", True), ("aria-hidden=true", True), ('class="a"hidden', True),
])
def test_what_hides(attribute, off):
    html = f"<body><article {attribute}><p>{P}</p></article></body>"
    assert [x.off for x in html_text.parse(html)[0] if x.tag == "article"] == [off]
    assert html_text.train([]).text(html) == ("" if off else P)


@pytest.mark.parametrize("attribute", ['data-type="a"', "itemtype=b", 'data-x="any"', "y=0", "y"])
def test_pages_are_not_labelled_by_hand(attribute):
    nodes, _ = html_text.parse(f"<body><article {attribute}><p>{P}</p></article></body>")
    assert [x.label for x in nodes] == [None] * len(nodes)
    assert html_text.labels(nodes)[-1] == 1
    assert {x.label for h in html_text.PAGES for x in html_text.parse(h, by_hand=True)[0]} >= {"1", None}
