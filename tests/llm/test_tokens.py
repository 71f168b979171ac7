import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkveil.llm import tokens

PATH = P.path("byte_bpe_50k.json")
TEXTS = ["", "Hello  world\n\n  it's 1234", "naïve café 😀😀 日本語", "<|endoftext|> inside", "x" * 3000, "a\x1cb !\x1c c d e", " \t\n  ", "É" * 50 + " ß", "الله 123"]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x500), r.randrange(0x4E00, 0x4F00), 32, 10])) for _ in range(n))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_encode_equals_rank_library_and_round_trips(spark):
    texts = [*TEXTS, *(noise(s, 500) for s in range(20)), "word " * 30_000, None]
    got = {r.doc_id: r for r in tokens.encode(docs(spark, texts), PATH, offsets=True).collect()}
    own = reference()
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i].ids == ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_offsets_cover_the_text_and_split_characters():
    c = tokens.codec(PATH)
    for t in [*TEXTS, noise(3, 400)]:
        (ids,) = c.encode([t])
        spans = c.offsets(ids)
        covered = set()
        for (a, b), i in zip(spans, ids, strict=True):
            assert t[a:b].encode().find(c.bytes_of[i]) >= 0
            covered |= set(range(a, b))
        assert covered == set(range(len(t)))


def test_stream_waits_for_whole_characters():
    c = tokens.codec(PATH)
    (ids,) = c.encode(["日本😀"])
    assert "".join(c.stream(iter(ids))) == "日本😀"
    assert "".join(c.stream(iter(ids[:-1]))).endswith("�")


def test_pieces_do_not_change_ids():
    c = tokens.codec(PATH)
    text = noise(7, 3000)
    whole = c.library.encode(text, add_special_tokens=False).ids
    parts = [i for p in tokens.pieces(text, 50) for i in c.library.encode(p, add_special_tokens=False).ids]
    assert parts == whole


def test_decode_column(spark):
    rows = tokens.encode(docs(spark, TEXTS), PATH)
    back = {r.doc_id: r.text for r in tokens.decode(rows, PATH).collect()}
    assert back == dict(enumerate(TEXTS))


def test_counts_equal_library(spark):
    texts = [*TEXTS, *(noise(s, 700) for s in range(10)), "՘౜ odd", "tok " * 600, None]
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in tokens.count_tokens(docs(spark, texts), PATH, P.PATTERN, 512).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)


def test_whole_tokens_are_proven():
    whole = tokens.whole_tokens(PATH)
    library = Tokenizer.from_file(PATH)
    assert len(whole) > 40_000
    for s in random.Random(1).sample(sorted(whole), 300):
        assert library.encode(s, add_special_tokens=False).ids == [whole[s]]


@pytest.mark.parametrize("make", ["encode", "count"])
def test_empty_table_and_repeated_rows(spark, make):
    f = (lambda d: tokens.encode(d, PATH)) if make == "encode" else (lambda d: tokens.count_tokens(d, PATH, P.PATTERN, 512))
    assert f(docs(spark, ["a"]).filter("false")).count() == 0
    twice = docs(spark, ["a b"]).union(docs(spark, ["a b"]))
    assert [r.n_tokens for r in f(twice).collect()] == [2, 2]
    nulls = twice.withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.doc_id for r in f(nulls).collect()] == [None, None]
