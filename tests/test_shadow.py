import pytest

from sparkveil.operators import perception

CASES = [
    ("<div><template shadowrootmode='open'><p>in</p></template><p>out</p></div>", ["in"]),
    ("<div><p>out</p><template shadowrootmode='open'><p>in</p><slot></slot></template></div>", ["in", "out"]),
    ("<x-a><p slot='b'>two</p><p slot='a'>one</p><template shadowrootmode='open'><slot name='a'></slot></template></x-a>", ["one"]),
    ("<ul><template shadowrootmode='open'><p>no host</p></template><li>x</li></ul>", ["x"]),
    ("<div><template shadowrootmode='open'><p>in</p><slot></slot></template><template shadowrootmode='open'><p>second</p></template><p>out</p></div>", ["in", "out"]),
    ("<div><template shadowrootmode='closed'><p>in</p></template><p>out</p></div>", ["out"]),
    ("<template><p>inert</p><template><p>inert</p></template></template><p>out</p>", ["out"]),
    ("<div hidden><template shadowrootmode='open'><p>in</p></template></div><p>out</p>", ["out"]),
    ("<div><template shadowrootmode='open'><p>never closed</p>", ["never closed"]),
]


@pytest.mark.parametrize(("html", "texts"), CASES)
def test_texts_of_shadow_trees(spark, html, texts):
    rows = perception.regions(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    assert [r.raw_text for r in rows if r.raw_text] == texts


def test_ids_hold_within_their_tree():
    w = perception._Walker(1)
    w.feed("<label for='a'>Outer</label><div><template shadowrootmode='open'><label for='a'>Inner</label><input id='a' value='1'></template></div><input id='a' value='2'>")
    w.close()
    assert [(r["value"], r["label_text"]) for r in w.result() if r["tag"] == "input"] == [("1", "Inner"), ("2", "Outer")]


def test_plain_pages_are_read_by_one_pattern_as_the_parser_reads_them(monkeypatch):
    def parsed(html):
        w = perception._Walker(1)
        w.feed(html)
        w.close()
        return w.result()

    said = lambda rows: [{k: r[k] for k in ("pos", "tag", "text", "value", "label_text", "in_main", "options", "message", "elem_id")} for r in rows]
    plain = [
        '<main><label for="a">Mail &amp; more</label><input id="a" value="x@y"><p>one<p>two</main>', '<div role="listbox" id="q"><span role="option" aria-selected="true">A</span></div><p>1 > 2</p>',
        '<x-a><p slot="t">in</p><template shadowrootmode="open"><label>L<input value="1"></label><slot name="t"></slot></template></x-a><article><p>after</p></article>', "",
    ]
    odd = ["<p>a < b</p>", "<title><b>t</b></title><p>x</p>", "<br/><p title='q'>x</p>", "<!-- <p>no</p> --><p>x</p>", "<P>x</P>", "<p>cut <b", '<input value="a&amp;b">']
    expected = [said(parsed(h)) for h in plain + odd]
    assert [said(perception._Walker(1).read(h)) for h in plain + odd] == expected
    monkeypatch.setattr(perception._Walker, "feed", lambda self, html: 1 / 0)
    assert [said(perception._Walker(1).read(h)) for h in plain] == expected[: len(plain)]
