import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkveil.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name in ("quality", "near"):  # rows go or stay as they are
            assert docs.exceptAll(before).count() == 0 and 0 < docs.count() < before.count()
        if name == "lines":
            assert docs.filter("n_chars <> length(text)").count() == 0
        if name == "mix":
            assert docs.join(before, columns, "left_anti").count() == 0
    assert {"doc_id", "ids", "n_tokens"} <= set(docs.columns)


def test_bad_documents_go_and_good_ones_stay(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = corpus_pipeline.drop_bad(spark, docs, "/root/testdata/sf0.1").select("doc_id", F.lit(1).alias("kept"))
    held = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).join(kept, "doc_id", "left")
    rates = {r.quality: r.rate for r in held.groupBy("quality").agg(F.avg(F.col("kept").isNotNull().cast("double")).alias("rate")).collect()}
    assert rates[1] > 0.98 and rates[0] < 0.2


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("stage", ["quality", "lines", "near", "mix", "encode"])
def test_stages_on_an_empty_table(spark, stage):
    empty = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    assert dict(corpus_pipeline.STAGES)[stage](spark, empty, SF).count() == 0


@pytest.mark.parametrize("sources,at", [(20, 5), (20, 4), (3, 3), (1, 1)])
def test_long_lines_of_few_sources_go(spark, sources, at):
    notice = "This work is licensed under the licence that everybody has here."
    rows = [(i, f"own text {i}\nOn.\n{notice}" if i < at else f"own text {i}\nOn.", "en", f"s{i}", 0) for i in range(min(sources, 9))]
    rows += [(i, f"other text {i}", "en", f"s{i}", 0) for i in range(9, sources)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.text for x in corpus_pipeline.drop_lines(spark, docs, SF).collect()}
    gone = set(range(1, at)) if at == min(5, sources) and at > 1 else set()  # the first stays; a short line on 9 sources, too
    assert got == {i: f"own text {i}\nOn." if i in gone else t for i, t, *_ in rows}


def test_near_keeps_one_row_of_each_group(spark):
    r = random.Random(3)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = []
    for k in range(30):
        words = [f"w{k}x{r.randrange(999)}" for _ in range(60)]
        for _ in range(r.randrange(1, 6)):
            text = " ".join(words if r.random() < 0.5 else [*words, f"end{r.randrange(3)}"])
            row = (r.choice([None, k, k, 100 + k % 3]), text, "en", f"s{r.randrange(2)}", k)
            rows += [row] * r.choice([1, 1, 2])
    rows += [(500, "same text of five words and more", "en", "b", 1000), (500, "same text of five words and more", "en", "a", 1000)]
    rows += [(None, " ".join(map(str, range(50))) + e, "en", "s", 1001) for e in (" x", " y", " y")]
    wordless = [(1, None, "en", "s", 0), (1, "", "en", "s", 0), (1, "", "en", "s", 0)]
    r.shuffle(rows)
    got = [tuple(x) for x in corpus_pipeline.drop_near(spark, spark.createDataFrame(rows + wordless, schema), SF).collect()]
    assert sorted(x[1] or "" for x in got if not x[1]) == ["", "", ""]
    got = [x for x in got if x[1]]
    # rows of one n_chars are near duplicates of each other and of no others
    groups = {}
    for x in rows:
        groups.setdefault(x[4], []).append(x)
    assert sorted(x[4] for x in got) == sorted(groups) and set(got) <= set(rows)
    for x in got:
        assert x[0] == min((y[0] for y in groups[x[4]] if y[0] is not None), default=None)
    assert (500, "same text of five words and more", "en", "a", 1000) in got


@pytest.mark.parametrize("stage", ["quality", "lines", "near", "mix", "encode"])
def test_stages_on_odd_rows(spark, stage):
    """Nulls, empty and very long texts, repeated rows, ids that are shared or missing, and columns named as the operators name theirs."""
    r = random.Random(7)
    long = " ".join(f"w{r.randrange(9000)}" for _ in range(60_000))
    prose = " ".join(f"v{k}" for k in range(60))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "\n \n", "en", "a"), (4, long, "en", "a"), (4, long, "en", "a"), (None, prose, "en", None), (None, prose, "en", None), (4, prose + " end", "en", "b"), (5, "one", "en", "b"), (5, "one", "en", "b")]
    extra = "score double, predicted int, n_lines int, n_removed int, repetition int, winner boolean, component_id long, ids string, rep long, cluster long"
    docs = spark.createDataFrame([(*x, len(x[1] or ""), 0.5, 7, 7, 7, 7, True, 7, "x", 7, 7) for x in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)
    got = [tuple(x[:4]) for x in out.collect()] if stage != "encode" else []
    if stage != "encode":
        assert out.columns == docs.columns and set(got) <= set(rows)
    if stage == "quality":  # rows with one text are judged alike
        assert all(got.count(x) in (0, rows.count(x)) for x in rows)
    if stage == "lines":
        assert sorted(got, key=str) == sorted(rows, key=str)
    if stage == "near":
        assert sorted(got, key=str) == sorted([rows[0], rows[1], rows[2], rows[4], rows[7], rows[8]], key=str)
    if stage == "mix":
        assert all(got.count(x) % rows.count(x) == 0 for x in rows)
    if stage == "encode":
        assert sorted((x.doc_id or 0, x.n_tokens == 0) for x in out.collect()) == sorted((i or 0, not t) for i, t, *_ in rows)
