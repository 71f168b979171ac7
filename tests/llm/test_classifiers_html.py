import os
import time
import random
import zlib

import pytest

from sparkveil.llm import classifiers, html

SF = "/root/testdata/sf0.01"


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def corpus(n=600, seed=1):
    r = random.Random(seed)
    clean = [f"{a}{b}" for a in ("al", "be", "co", "di", "en") for b in ("ra", "si", "to", "vu", "wo", "xa")]
    bad = ["frightful", "nasty", "horrid"]
    rows = []
    for i in range(n):
        sentences = [" ".join(r.choice(clean) for _ in range(r.randrange(3, 12))) + "." for _ in range(r.randrange(1, 12))]
        toxic = int(i % 4 == 0)
        if toxic:
            k = r.randrange(len(sentences))
            sentences[k] = sentences[k][:-1] + f" {r.choice(bad)} {r.choice(clean)}."
        junk = int(i % 5 == 1)
        text = " ".join(sentences)
        rows.append((i, text.upper().replace(" ", "!! ") if junk else text, toxic, 1 - junk))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "kept") for i, t, _, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, x) for i, _, x, q in rows], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_toxicity_held_out_and_located(spark, tables):
    docs, labels, rows = tables
    got = {r.doc_id: r for r in classifiers.toxicity(docs, labels).collect()}
    held = [x for x in rows if fold(x[0]) == 0]
    assert sum(got[i].predicted == t for i, _, t, _ in held) / len(held) > 0.98
    for i, text, toxic, _ in held:
        if toxic and "!!" not in text:
            (a, b) = (got[i].starts[0], got[i].ends[0])
            assert any(w in text[a:b].lower() for w in ("frightful", "nasty", "horrid"))


def test_noisy_or_is_the_documents_score():
    m = classifiers.ToxicModel(-3.0, {"bad": 4.0})
    p, located = m.score("fine. bad one. also fine")
    q = 1 / (1 + 2.718281828459045**3)
    assert abs(p - (1 - (1 - q) ** 2 * (1 - 1 / (1 + 2.718281828459045**-1)))) < 1e-9
    assert [(a, b) for a, b, _ in located] == [(5, 14)]
    assert m.score("") == (0.0, [])


def test_labels_outside_the_fold_only(spark, tables):
    docs, labels, rows = tables
    sample, sizes = classifiers.labelled_sample(docs, labels, "toxic", 50, 10_000, 1)
    held = {t for i, t, _, _ in rows if fold(i) == 0} - {t for i, t, _, _ in rows if fold(i) != 0}
    assert not held & {t for t, _ in sample} and len(sample) == 100
    assert sum(sizes.values()) == sum(fold(i) != 0 for i, *_ in rows)


def test_a_long_clean_text_is_not_toxic(spark, tables):
    docs, labels, rows = tables
    clean = " ".join(t for i, t, toxic, _ in rows if not toxic and fold(i) == 0)
    long = (clean + " ") * (1_000_000 // len(clean) + 1)
    more = spark.createDataFrame([(-1, long, ""), (-2, long + " So frightful alra.", "")], docs.schema)
    got = {r.doc_id: r for r in classifiers.toxicity(docs.unionByName(more), labels).filter("doc_id < 0").collect()}
    assert got[-1].score < 0.5 and got[-1].predicted == 0 and got[-1].n_sentences == 0
    assert got[-2].predicted == 1 and got[-2].n_sentences == 1


def test_long_labelled_texts_take_part_within_the_bound(spark):
    docs = spark.createDataFrame([(i, f"{i} " * (3000 if i == 4 else 20)) for i in range(1, 60)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    sample, _ = classifiers.labelled_sample(docs, labels, "toxic", 70, 1000, 1)
    texts = [t for t, _ in sample]
    assert "4 " * 3000 in texts and all(texts.count(t) == 2 for t in texts)  # rows alike take part as rows
    sample, _ = classifiers.labelled_sample(docs, labels, "toxic", 70, 50, 1)
    assert "4 " * 3000 not in [t for t, _ in sample] and len(sample) > 60
    assert all(sum(len(t) for t, y in sample if y == v) <= 70 * 50 for v in (0, 1))


def test_quality_held_out(spark, tables):
    docs, labels, rows = tables
    model = classifiers.train_quality(docs, labels)
    scored = classifiers.score_quality(docs, model)
    assert scored.columns == ["doc_id", "text", "raw_bytes", "bad_bytes", "good_bytes", "score", "predicted"]  # the old score is replaced
    got = {r.doc_id: r for r in scored.collect()}
    held = [x for x in rows if fold(x[0]) == 0]
    assert sum(got[i].predicted == q for i, _, _, q in held) / len(held) > 0.97


def test_quality_sizes_and_score_by_hand(spark, tables):
    import zstandard as z

    docs, labels, rows = tables
    model = classifiers.train_quality(docs, labels)
    presses = []
    for content in (model.bad, model.good):
        d = z.ZstdCompressionDict(content)
        presses.append(z.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    for r in classifiers.score_quality(docs, model).limit(40).collect():
        raw = r.text.encode()
        bad, good = (sum(len(p.compress(raw[at : at + 512])) for at in range(0, len(raw), 512)) for p in presses)
        assert (r.raw_bytes, r.bad_bytes, r.good_bytes) == (len(raw), bad, good)
        d = 100 * (bad - good) / len(raw)
        k = sum(x <= d for x in model.knots)
        want = model.shares[0] if k == 0 else model.shares[-1] if k == len(model.knots) else model.shares[k - 1] + (model.shares[k] - model.shares[k - 1]) * (d - model.knots[k - 1]) / (model.knots[k] - model.knots[k - 1])
        assert abs(r.score - want) < 1e-9
    assert model.shares == sorted(model.shares) and model.knots == sorted(model.knots) and 0 < model.shares[0] < model.shares[-1] < 1


def test_dictionaries_read_whole_texts(tables):
    long = [(t * 30, q) for _, t, _, q in tables[2]]
    changed = [(t[:8192] + "".join(map(chr, range(0x4E00, 0x4F00))) * 20, q) for t, q in long]
    assert classifiers.fit_quality(long, {0: 1, 1: 4}).good != classifiers.fit_quality(changed, {0: 1, 1: 4}).good


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_edges(spark, tables, which):
    docs, labels, _ = tables
    odd = spark.createDataFrame([(1, None), (None, ""), (3, "word " * 40_000), (3, "word " * 40_000)], "doc_id long, text string")
    if which == "toxic":
        run = lambda d, l: classifiers.toxicity(d, l)
    else:
        run = lambda d, l: classifiers.score_quality(d, classifiers.train_quality(d, l))
    got = run(odd, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert run(docs, labels.filter("false")).count() == docs.count()  # no labels: a constant score
    assert run(docs.filter("false"), labels).count() == 0


def articles(spark):
    import html as h
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(h.unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?p>|</?h1>", article))
        yield r.page_id, r.html, [p for p in parts if p]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pages_of_the_driver(spark):
    want = {i: "\n".join(parts) for i, _, parts in articles(spark)}
    for r in html.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pages_without_any_telling_tag(spark):
    import re

    tree, right, wrong, lost = html.train(), 0, 0, 0
    for _, page, parts in articles(spark):
        bare = re.sub(r' (?:class|id)="[^"]*"', "", re.sub(r"<(/?)(nav|article|footer|main|header|aside)\b[^>]*>", r"<\1div>", page))
        got = html.main_text(bare, tree)[0].split("\n")
        right += len(set(got) & set(parts))
        wrong += len(set(got) - set(parts))
        lost += len(set(parts) - set(got))
    assert wrong / (right + wrong) < 0.02 and lost / (right + lost) < 0.01


def test_neighbours_decide():
    tree = html.train()
    said = tree.said()
    assert all(f"{name} <=" in said for name in ("words before", "words after", "density", "density before"))
    box = "<div>A line of just a few words</div>"
    menu, prose = "<div><a>Home</a> <a>News</a></div>", "<div>" + "words of the story " * 15 + "</div>"
    assert "few words" in html.main_text(prose + box + prose, tree)[0]
    assert "few words" not in html.main_text(menu + box + menu + prose * 3, tree)[0]


CASES = [
    ("<article><h1>T &amp; x</h1><p>one  <b>two</b>\n three<p>four</article>", "T & x\none two three\nfour"),
    ("<nav><a href=x>Home</a><main><p>Hello there</p><aside>see also</aside><div class='comments'><p>nice one</div></main><footer>c</footer>", "Hello there"),
    ("<header><h1>Site</h1></header><article>text<script>var a='<p>no</p>'</script> more<!-- x --> end</article><form><label>Mail</label><input></form>", "text more end"),
    ("<article><p>a<div class='ad'>buy</div><p>b</article><div id=cookie-notice>we use cookies and so on and on</div>", "a\nb"),
    ("<div><p>" + "plain words here " * 12 + "</p></div><ul><li><a href=a>A</a><li><a href=b>B</a></ul>", ("plain words here " * 12).strip()),
    ("<h1>A title</h1><p>Short paragraph of the page.</p><p>Another short one here.</p>", "A title\nShort paragraph of the page.\nAnother short one here."),
    ("<article><p>Some words here of the text.</p><p><a>Read the full report</a></p><p>More words of the text.</p></article>", "Some words here of the text.\nRead the full report\nMore words of the text."),
    ("<article><header><h1>Headline</h1><p>by me</p></header><p>Text of it is here</p></article>", "Headline\nby me\nText of it is here"),
    ("<article><div class='post-header'><h1>Headline here</h1></div><p>Some text</p></article>", "Headline here\nSome text"),
    ("<div class='footer-post'><p>" + "a story of words " * 9 + "</p></div>", ("a story of words " * 9).strip()),
    ("<nav><div class='main'>Home News <a>Sport</a></div></nav><article><p>body text</p></article>", "body text"),
    ("<article><p>Let <math><mi>x</mi></math> be</p></article>", "Let x be"),
    ("<article><h2 id='search'>Search results</h2><section id='related-work'><p>Related work is this.</p></section></article>", "Search results\nRelated work is this."),
    ("<article><p>seen</p><p hidden>not seen</p><p style='display: none'>nor this</p></article>", "seen"),
    ("", ""), ("   ", ""), ("<", "<"), ("<article>5 &lt; 6 &#x1F600;&nbsp;x</article>", "5 < 6 😀 x"), ("<article><p title='a > b'>q</p></article", "q"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_small_pages(page, text):
    got = html.main_text(page, html.train())[0]
    assert got == text or (page == "<" and got in ("", "<"))


@pytest.mark.parametrize("name", ["search", "share", "notice", "comment", "related", "banner", "newsletter"])
@pytest.mark.parametrize("tag", ["section", "div"])
@pytest.mark.parametrize("attribute", ["id", "class"])
def test_names_inside_an_article_are_no_veto(name, tag, attribute):
    prose = "words of the story that go on for a while " * 6
    page = f"<article><h1>A headline of it</h1><p>{prose}</p><{tag} {attribute}='{name}'><h2>What it is</h2><p>{prose}</p></{tag}></article>"
    assert html.main_text(page, html.train())[0].split("\n") == ["A headline of it", prose.strip(), "What it is", prose.strip()]
    short = f"<article><h1>A headline of it</h1><p>{prose}</p><{tag} {attribute}='{name}'>Do it now</{tag}><p>{prose}</p></article>"
    assert "Do it now" not in html.main_text(short, html.train())[0]


@pytest.mark.parametrize("page", ["<button>x " * 200_000, "<div>" * 400_000 + "x", "<div>x" * 200_000, "</b>" * 400_000, "<p>" + "</div>x" * 200_000, "<!a " * 400_000, "<a \"x' " * 300_000, "<select><noscript>" * 100_000, "<" * 2_000_000, "&" * 2_000_000, "<div>" * 200_000 + "</p>" * 200_000])
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    html.blocks(page)
    assert time.time() - began < 8


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, "u", "<article>x</article>", "t"), (None, None, "<article>" + "y " * 50_000 + "</article>", "t")], "page_id long, url string, html string, text string")
    got = sorted(r.n_chars for r in html.extract(pages).collect())
    assert got == [0, 1, 99_999]
    assert html.extract(pages.filter("false")).count() == 0
