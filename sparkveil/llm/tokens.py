"""Byte-level BPE: encoding with offsets, decoding by the reversed byte table, and token counts.

Both operators take vocabulary files of public tokenizers by path; nothing is trained or stored here.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import slices, workers

#: Bytes of text that one call of the library may hold as encodings (each token costs about 150 bytes there).
CALL_BYTES = 256 << 10

#: A run of non-blanks ends and a plain blank begins: no pre-token of the byte-level pattern spans this place.
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def byte_table() -> dict[str, int]:
    """The byte-level alphabet, from character to byte.

    Printable bytes of Latin-1 stand for themselves; the other 68 bytes take the characters from
    U+0100 on, in byte order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(text: str, most: int = CALL_BYTES // 4) -> Iterator[str]:
    """``text`` cut into pieces of about ``most`` characters at places where no pre-token can span.

    Encoding the pieces one after another equals encoding the whole text. A run of ``most`` or more
    characters without white space stays whole.
    """
    at = 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Codec:
    """A byte-level BPE vocabulary with its library encoder and its reversed byte table."""

    def __init__(self, path: str, specials_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = specials_as_text
        self.library.no_truncation()
        self.library.no_padding()
        to_byte = byte_table()
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = added[i].encode() if i in added else bytes(to_byte[c] for c in token)
        self.digits_of = [str(i) for i in range(len(self.bytes_of))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. The library never holds the encodings of more than about CALL_BYTES of text."""
        out: list[list[int]] = [[] for _ in texts]
        waiting: list[tuple[int, str]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            for (i, _), e in zip(waiting, self.library.encode_batch_fast([p for _, p in waiting], add_special_tokens=False), strict=True):
                out[i] += e.ids
            waiting.clear()
            held = 0

        for i, text in enumerate(texts):
            for piece in pieces(text):
                waiting.append((i, piece))
                held += len(piece)
                if held >= CALL_BYTES // 2:
                    flush()
        if waiting:
            flush()
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids. Ids outside the vocabulary raise IndexError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: list[int]) -> list[tuple[int, int]]:
        """The characters that each id covers, as (start, end) in code points of the decoded text.

        A character whose bytes are split over several ids is covered by each of them.
        """
        out, n = [], 0  # n: characters begun so far
        for i in ids:
            piece = self.bytes_of[i]
            begun = sum(b & 0xC0 != 0x80 for b in piece)
            first = n if piece and piece[0] & 0xC0 != 0x80 else n - 1
            n += begun
            out.append((max(first, 0), n))
        return out

    def stream(self, ids: Iterator[int]) -> Iterator[str]:
        """Text as the ids arrive: bytes of a character that is not whole yet wait for the next id.

        What can't become a character is replaced by U+FFFD, at the end too.
        """
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if said := decoder.decode(self.bytes_of[i]):
                yield said
        if said := decoder.decode(b"", final=True):
            yield said


@lru_cache(maxsize=4)
def codec(path: str, specials_as_text: bool = True) -> Codec:
    return Codec(path, specials_as_text)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = False, ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    ``path`` names a byte-level vocabulary file of the tokenizers library. Returns ``keep``, n_tokens,
    ids_sha256 (hex of the decimal ids joined by one space), decoded_sha256, n_split (ids that begin
    inside a character), and with ``ids`` the ids, with ``offsets`` start and end of each in code points.

    A null text counts as empty: 0 tokens and the digests of nothing. Repeated rows give repeated rows;
    an empty table an empty one. Columns of ``docs`` beside ``keep`` and ``text`` are not read, so their
    names can't clash.
    """
    fields = ["n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long"]
    fields += ["ids array<int>"] * ids + ["starts array<int>, ends array<int>"] * offsets
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_sv_text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches, "_sv_text", 2 << 20):
            out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "n_split", "ids", "starts", "ends")}
            for own in c.encode(batch.column("_sv_text").to_pylist()):
                raw = c.decode(own)
                out["n_tokens"].append(len(own))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(c.digits_of.__getitem__, own)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["n_split"].append(0 if raw.isascii() else sum(c.bytes_of[i][0] & 0xC0 == 0x80 for i in own))
                if ids:
                    out["ids"].append(own)
                if offsets:
                    spans = c.offsets(own)
                    out["starts"].append([s for s, _ in spans])
                    out["ends"].append([e for _, e in spans])
            kinds = {"n_tokens": pa.int64(), "n_split": pa.int64(), "ids": pa.list_(pa.int32()), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())}
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_split"] + ["ids"] * ids + ["starts", "ends"] * offsets
            arrays = [pa.array(out[k], kinds.get(k, pa.string())) for k in names]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], *names])

    return workers(source).mapInArrow(run, ", ".join([head, *fields] if head else fields))


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """The table with ``to`` added: the text of the id arrays, by the reversed byte table.

    Bytes that form no character (a split one whose other ids are missing) become U+FFFD. Null ids
    give null, no ids an empty text. An existing column ``to`` is replaced.
    """
    source = workers(encoded.drop(to)) if to in encoded.columns and to != ids else workers(encoded)
    @F.pandas_udf("string")
    def back(arrays: pd.Series) -> pd.Series:
        c = codec(path)
        return arrays.map(lambda a: None if a is None else c.decode([int(i) for i in a]).decode("utf-8", "replace"))

    return source.withColumn(to, back(F.col(ids)))


# ---------------------------------------------------------------- token counts


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> dict[str, int]:
    """The vocabulary strings proven to encode alone as one token that is one pre-token, with their ids.

    The proof is by the library itself, over the whole vocabulary (its size bounds the result): the
    string's bytes must be valid UTF-8, must be one pre-token, and must encode to just that id.
    """
    c = codec(path, False)
    added = set(c.library.get_added_tokens_decoder())
    found = []
    for i, raw in enumerate(c.bytes_of):
        if i in added or not raw:
            continue
        try:
            found.append((i, raw.decode()))
        except UnicodeDecodeError:
            continue
    out = {}
    for at in range(0, len(found), 2000):
        part = found[at : at + 2000]
        for (i, s), e in zip(part, c.library.encode_batch_fast([s for _, s in part], add_special_tokens=False), strict=True):
            if e.ids == [i] and len(c.library.pre_tokenizer.pre_tokenize_str(s)) == 1:
                out[s] = i
    return out


@lru_cache(maxsize=4)
def agreeing_characters(path: str, pattern: str, last: int = 0xFFFF) -> str:
    """A regex class, negated, of the characters on which ``pattern`` and the library's pre-tokenizer agree.

    The two use tables of different Unicode versions. Each character up to ``last`` is tried between
    letters, digits, blanks and marks; a text with any other character is counted by the library alone.
    """
    import regex

    own = regex.compile(pattern)
    split = codec(path, False).library.pre_tokenizer.pre_tokenize_str
    ranges: list[list[int]] = []
    for c in range(last + 1):
        if 0xD800 <= c < 0xE000:
            continue
        s = "a{0}b1{0}2 {0} {0}{0}'{0}! {0}!".format(chr(c))
        if own.findall(s) == [s[a:b] for _, (a, b) in split(s)]:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[^" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in ranges) + "]"


class _Costs(dict):
    """Tokens of a pre-token: 1 for a proven whole token, else by the library, remembered up to a bound."""

    def __init__(self, whole: dict[str, int], library):
        super().__init__(dict.fromkeys(whole, 1))
        self.library, self.whole, self.room = library, whole, 400_000

    def __missing__(self, piece: str) -> int:
        n = len(self.library.encode(piece, add_special_tokens=False).ids)
        if len(piece) < 64:
            if self.room == 0:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
                self.room = 400_000
            self[piece] = n
            self.room -= 1
        return n


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Tokens of every whole text: proven whole tokens are counted straight, only the rest is merged.

    Returns ``keep``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``). The library's
    special strings inside a text count one token each, as by its default. A null text counts as empty:
    0 bytes, 0 tokens. Repeated rows give repeated rows, an empty table an empty one. Other columns of
    ``docs`` are not read.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary
    strange = agreeing_characters(path, pattern)
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_sv_text"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        c = codec(path, False)
        own, odd = regex.compile(pattern), re.compile(strange)
        specials = [t.content for t in c.library.get_added_tokens_decoder().values()]
        cut = re.compile("|".join(map(re.escape, specials))) if specials else None
        costs = _Costs(whole.value, c.library)

        def plain(s: str) -> int:
            if odd.search(s):
                return sum(map(len, c.encode([s])))
            return sum(sum(map(costs.__getitem__, own.findall(p))) for p in pieces(s))

        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column("_sv_text"):
                s = value.as_py()
                n_bytes.append(len(s.encode()))
                parts = cut.split(s) if cut and cut.search(s) else [s]
                n_tokens.append(sum(map(plain, parts)) + len(parts) - 1)
            arrays = [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    return workers(source).mapInArrow(run, head + "n_bytes long, n_tokens long, over_limit boolean")
