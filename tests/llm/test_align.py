import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkveil.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    "", None, " ", "Hello  world\n\n  it's 1234", "naïve café 😀😀 日本語", "<|endoftext|> inside </s> <unk>", "x" * 3000, "a\x1cb !\x1c c d e", " \t\n  ", "É" * 50 + " ß",
    "الله 123", "ﬁn ① ½  nbsp​", "▁under ▁score", "<0x41>", "the cat sat on the mat. " * 400, "\x00nul", "é ẛ̣", "the cat", "the cat",
]


def by_hand(texts):
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = {}
    kept = [b for b in range(256) if chr(b).isprintable() and b > 32 and not 127 <= b <= 160 and b != 173]
    for n, b in enumerate(kept + [b for b in range(256) if b not in kept]):
        alphabet[chr(b) if n < len(kept) else chr(256 + n - len(kept))] = b
    rows, links = [], []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = [(i, bytes(alphabet[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()) for i in pieces.encode(text)] if text else []
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []
        ends = []
        for tokens in (a, b):
            at, own = 0, []
            for _, x in tokens:
                at += len(x)
                own.append(at)
            ends.append(own)
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, ga, gb = [], 0, 0
        for e in both:
            na, nb = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(str(i) for i, _ in a[ga:na]) + "|" + ",".join(str(i) for i, _ in b[gb:nb]))
            ga, gb = na, nb
        links.append([(a[ends[0].index(e)][0], b[ends[1].index(e)][0]) for e in both])
        rows.append([len(a), len(b), len(both), len(both), ";".join(groups)])
    counts = Counter(p for own in links for p in own)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(*r[:4], sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "") for r, own in zip(rows, links, strict=True)]


def noise(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(chr(r.choice([r.randrange(32, 127), r.randrange(97, 123), r.randrange(160, 0x500), r.randrange(0x4E00, 0x4F00), r.randrange(0x1F300, 0x1F700), 32, 10])) for _ in range(n))


@pytest.mark.parametrize("frequent", [align.FREQUENT, 0.01])
def test_align_equals_pairs_by_hand(spark, monkeypatch, frequent):
    monkeypatch.setattr(align, "FREQUENT", frequent)
    texts = [*TEXTS, *(noise(s, 300) for s in range(12))]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, n_a string, pair long").repartition(3)
    got = sorted(align.align(docs, A, B, P.PATTERN).collect(), key=lambda r: 3 if r.doc_id is None else r.doc_id)
    assert got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(r)[1:] for r in got] == by_hand(texts)


def test_align_of_an_empty_table(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B, P.PATTERN).count() == 0


def test_groups_as_text(spark):
    (row,) = align.group(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), A, B, P.PATTERN, groups=True).collect()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert align._unpack(bytes(row.links))[1].sum() == row.n_links


def test_fast_ids_equal_the_library_on_texts_of_all_planes():
    own = align.ByteTokens(A, P.PATTERN, align.strange_characters(A, P.PATTERN))
    texts = [noise(s, 400) for s in range(40, 60)] + [t for t in TEXTS if t]
    assert own.encode(texts) == own.codec.encode(texts)
