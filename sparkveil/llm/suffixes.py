"""Passages that repeat across documents, by suffix arrays over parts of the corpus that hold equal strings together.

Each string of ``length`` bytes has a least hash among its substrings of ANCHOR bytes, its key: equal strings have equal keys, and
neighbouring strings of a text mostly share theirs, so that a run of them travels as one piece of text. Pieces meet by key, and the
pieces of one key get a suffix array of their own, in which equal strings are neighbours. Many such arrays are built in step, one
numpy operation for a step of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import durable, join_by_weight, slices, workers
from sparkveil.llm.shingles import mix

#: Bytes of the substrings whose least hash is a key.
ANCHOR = 24
#: Bytes of text that a task takes together, and that it hashes at once.
BLOCK, CHUNK = 8 << 20, 1 << 18
#: Strings of a piece at most.
RUN = 64
#: Keys, and pieces, that one group of a shuffle holds on average.
PART_KEYS, PART_PIECES = 1 << 20, 1 << 16
#: Pieces of a key above which its strings travel one by one, and how many such keys there may be: beyond that number the bound rises.
MOST, CROWDED = 1 << 14, 1 << 20
#: Bytes whose suffix arrays are built in step, and distinct pieces of a key above which they are cut anew by longer substrings.
STEP, FEW = 1 << 20, 64
_LAST = (1 << 63) - 1


# ---------------------------------------------------------------- keys and pieces


def gram_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the substrings of ``size`` bytes at each place."""
    h, n = text.astype(np.uint64) + np.uint64(1), 1
    with np.errstate(over="ignore"):
        while n < size:
            s = min(n, size - n)  # the last two halves overlap
            left = h[: len(h) - s]
            h = (left ^ (left >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[s:] * np.uint64(2 * s + 1)
            n += s
    return mix(h)


def whole_hashes(strings: bytes, size: int) -> np.ndarray:
    """64-bit hashes of strings of ``size`` bytes each, one after another."""
    n = len(strings) // size
    words = np.zeros((n, -(-size // 8) * 8), np.uint8)
    words[:, :size] = np.frombuffer(strings, np.uint8).reshape(n, size)
    h = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for column in words.view(np.uint64).T:
            h = mix(h ^ column)
    return h


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = 1
    while n < width:
        s = min(n, width - n)
        values = np.minimum(values[: len(values) - s], values[s:])
        n += s
    return values


def pieces(texts: list[bytes], length: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, start, strings) of all pieces: runs of at most RUN strings of one text with one key, in order of the text."""
    anchor = min(anchor, length)
    out: list[list[np.ndarray]] = [[], [], [], []]
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= CHUNK):
            held += len(texts[to])
            to += 1
        flat = np.frombuffer(b"".join(texts[at:to]), np.uint8)
        if len(flat) >= length:
            sizes = np.array([len(t) for t in texts[at:to]])
            keys = mix(least(gram_hashes(flat, anchor), length - anchor + 1))
            own = np.repeat(np.arange(at, to), sizes)[: len(keys)]
            begins = (np.cumsum(sizes) - sizes)[own - at]
            whole = np.arange(len(keys)) + length <= begins + sizes[own - at]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1]) | (whole[1:] != whole[:-1])
            first = np.flatnonzero(new)
            count = np.diff(first, append=len(keys))
            kept = whole[first]
            first, count = first[kept], count[kept]
            if (count > RUN).any():
                parts = -(-count // RUN)
                nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                first, count = np.repeat(first, parts) + nth * RUN, np.minimum(np.repeat(count, parts) - nth * RUN, RUN)
            for kind, column in zip(out, (keys[first], own[first], first - begins[first], count), strict=True):
                kind.append(column)
        at = to
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, (np.uint64, np.int64, np.int64, np.int64), strict=True))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key, by its upper half."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _code(keys: np.ndarray, parts: int) -> np.ndarray:
    """A key's part and lower half."""
    return (_part(keys, parts) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, as one compressed blob."""
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(arrays[0])).tobytes() + b"".join(x.tobytes() for x in arrays))


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out if at == len(raw) else [*out, np.frombuffer(raw, np.uint8, offset=at)]


def _dealt(to: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of the arrays for each value of ``to``."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    ends = np.flatnonzero(np.diff(to, append=-1)) + 1 if len(to) else []
    begin = 0
    for end in ends:
        yield int(to[begin]), [x[order[begin:end]] for x in arrays]
        begin = end


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of one value begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[list]]:
    """Rows of the batches as lists, one for each of ``names``, in blocks of about BLOCK bytes of text; texts as bytes."""
    held, size = [[] for _ in names], 0
    for batch in slices(batches, "text", BLOCK // 4):
        for own, name in zip(held, names, strict=True):
            column = batch.column(name)
            own += column.cast(pa.binary()).to_pylist() if name == "text" else column.to_pylist()
        size += batch.column("text").nbytes
        if size >= BLOCK:
            yield held
            held, size = [[] for _ in names], 0
    if held[0]:
        yield held


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))


_BLOB = {"part": pa.int64(), "blob": pa.binary()}


# ---------------------------------------------------------------- suffix arrays


def suffix_arrays(texts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places of each text's suffixes in ascending order, text after text; text k is ``texts[begins[k]:begins[k + 1]]``.

    A text holds symbols above 0 and begins and ends with 0, which may stand within it, too, and parts its strings: no suffix is
    compared beyond a 0, and those at a 0 come first. The construction is linear and in two phases, for all texts in step:

    1. Suffixes form groups by their first symbol. From the greatest group down, each suffix points to the nearest one before it
       whose group is smaller; suffixes pointed to leave their group for new ones right after it, by how many point to them. In the
       end a group is the suffixes with one Lyndon prefix, and groups stand in the order of those prefixes.
    2. Suffixes are emitted in ascending order: what stands before an emitted suffix, and what that points to and so on, takes the
       next place of its group. No symbol is renamed, nothing recurses.
    """
    n = len(texts)
    own = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.argsort(own * 512 + texts, kind="stable").astype(np.int32)
    ranked = (own * 512 + texts)[order]
    first = _runs(ranked)
    sizes = np.zeros(n, np.int32)
    sizes[first] = np.diff(first, append=n)
    group = np.empty(n, np.int32)
    group[order] = np.repeat(first, sizes[first])
    where = np.empty(n, np.int32)
    where[order] = np.arange(n, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    low, high = begins[:-1].astype(np.int64), begins[1:].astype(np.int64)
    floor = low + sizes[low]  # beyond the zeros
    moved = np.zeros(n, bool)
    low, high = floor, high
    while True:
        live = high > low
        low, high = low[live], high[live]
        if not len(low):
            break
        start = group[order[high - 1]]
        count = high - start
        ends = np.cumsum(count)
        members = order[np.arange(ends[-1]) + np.repeat(start - ends + count, count)]
        high = start.astype(np.int64)
        # pointers: hop over suffixes of the same or a greater group
        to, mine = before[members], group[members]
        wrong = np.flatnonzero(group[to] >= mine)
        while len(wrong):
            to[wrong] = before[to[wrong]]
            before[members] = to
            wrong = wrong[group[to[wrong]] >= mine[wrong]]
        before[members] = to
        to = np.sort(to[texts[to] > 0])
        at = _runs(to)
        if not len(at):
            continue
        times = np.diff(at, append=len(to))
        to = to[at]
        # regroup what is pointed to: by old group, then by how often
        old = group[to]
        rank = np.argsort(old.astype(np.int64) * (int(times.max()) + 1) + times, kind="stable")
        to, old, times = to[rank], old[rank], times[rank]
        of = _runs(old)
        leaving = np.diff(of, append=len(old))
        end = old[of] + sizes[old[of]]
        place = np.arange(len(to)) + np.repeat(end - leaving - of, leaving)
        # those that stand there and stay change places with those that leave from elsewhere
        moved[to] = True
        there = order[place]
        staying = there[~moved[there]]
        vacant = where[to]
        vacant = vacant[vacant < np.repeat(end - leaving, leaving)]
        moved[to] = False
        order[vacant], where[staying] = staying, vacant
        order[place], where[to] = to, place
        split = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (times[1:] != times[:-1])]))
        width = np.diff(split, append=len(to))
        sizes[old[of]] -= leaving
        sizes[place[split]] = width
        group[to] = np.repeat(place[split], width)
    # second phase
    out = np.full(n, -1, np.int32)
    zeros = np.flatnonzero(texts == 0)
    emitted = texts == 0
    nth = np.arange(len(zeros)) - np.searchsorted(zeros, begins[:-1])[own[zeros]]
    out[begins[own[zeros]] + nth] = zeros
    free = np.arange(n, dtype=np.int32)  # of a group's first place: its next free one
    at, high = begins[:-1].astype(np.int64), begins[1:].astype(np.int64)
    begin = at
    while True:
        live = at < high
        at, high, begin = at[live], high[live], begin[live]
        if not len(at):
            return out
        s = out[at] - 1
        s = s[(out[at] > begin) & ~emitted[np.maximum(s, 0)]]
        while len(s):
            g = group[s]
            out[free[g]] = s  # one of a text at a time, so that no two take one place
            free[g] += 1
            emitted[s] = True
            s = before[s]
            s = s[~emitted[s]]
        at = at + 1


def repeats(strings: list[bytes], of: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, place) of all places whose next ``length`` bytes are in a string of the same text ``of`` with a lesser ``order``.

    Strings are sorted by ``of``; each text gets a suffix array, in which equal strings of ``length`` bytes are neighbours.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    begins = _runs(of)
    ends = np.append(begins[1:], len(of))
    size = np.add.reduceat(np.array([len(s) + 1 for s in strings]), begins) + 1 if len(begins) else begins
    by_size = np.argsort(size, kind="stable")  # texts of like size go in step
    at = 0
    while at < len(by_size):
        to = max(at + 1, at + int(np.searchsorted(np.cumsum(size[by_size[at:]]), STEP, "right")))
        own = by_size[at:to]
        at = to
        which = np.concatenate([np.arange(begins[k], ends[k]) for k in own])
        raw, starts, bounds = [], [], [0]
        n = 0
        for k in own:
            raw.append(np.zeros(1, np.int16))
            n += 1
            for i in range(begins[k], ends[k]):
                starts.append(n)
                raw += [np.frombuffer(strings[i], np.uint8).astype(np.int16) + np.int16(1), np.zeros(1, np.int16)]
                n += len(strings[i]) + 1
            bounds.append(n)
        texts, starts, bounds = np.concatenate(raw), np.array(starts), np.array(bounds)
        sorted_ = suffix_arrays(texts, bounds)
        string = np.full(n, -1, np.int64)  # of the places at which a whole string of ``length`` begins
        windows = np.array([len(strings[i]) - length + 1 for i in which])
        places = np.repeat(starts - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
        string[places] = np.repeat(np.arange(len(which)), windows)
        sorted_ = sorted_[string[sorted_] >= 0]
        text_of = np.repeat(np.arange(len(own)), ends[own] - begins[own])[string[sorted_]]
        same = np.zeros(len(sorted_), bool)
        span = np.arange(length)
        for a in range(1, len(sorted_), 1 << 14):
            left, right = sorted_[a - 1 : a - 1 + (1 << 14)], sorted_[a : a + (1 << 14)]
            left = left[: len(right)]
            same[a : a + len(right)] = (texts[left[:, None] + span] == texts[right[:, None] + span]).all(axis=1)
        same[1:] &= text_of[1:] == text_of[:-1]
        first = np.flatnonzero(~same)
        rank = order[which][string[sorted_]]
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(rank))) if len(first) else rank
        hit = sorted_[rank > lowest]
        out.append((which[string[hit]], hit - starts[string[hit]]))
    return np.concatenate([s for s, _ in out]), np.concatenate([p for _, p in out])


def resolve(strings: list[bytes], keys: np.ndarray, order: np.ndarray, length: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """As ``repeats`` for distinct strings of any key in any order; a key of more than FEW strings is cut anew by longer substrings.

    Longer substrings part the strings of a crowded key; where they are as long as the strings sought, equal strings are alone.
    """
    by_key = np.argsort(keys, kind="stable")
    begin = _runs(keys[by_key])
    width = np.diff(begin, append=len(by_key))
    few = by_key[np.repeat((width > 1) & ((width <= FEW) | (anchor >= length)), width)]  # a key with one string has nothing to sort
    s, p = repeats([strings[i] for i in few], keys[few], order[few], length)
    out = [(few[s], p)]
    many = by_key[np.repeat((width > FEW) & (anchor < length), width)]
    if len(many):
        anchor = (anchor + length + 1) // 2 if length - anchor > 8 else length
        key, of, start, count = pieces([strings[i] for i in many], length, anchor)
        of = many[of]
        own = [strings[i][a : a + n] for i, a, n in zip(of.tolist(), start.tolist(), (count + length - 1).tolist(), strict=True)]
        which, distinct, lowest, distinct_key = collapse(own, key, order[of])
        later = np.flatnonzero(order[of] > lowest[which])
        out.append((np.repeat(of[later], count[later]), _counted(start[later], count[later])))
        first = np.flatnonzero(order[of] == lowest[which])
        s, p = resolve(distinct, distinct_key, lowest, length, anchor)
        row, nth = _each(which[first], s)
        out.append((of[first[row]], start[first[row]] + p[nth]))
    return np.concatenate([s for s, _ in out]), np.concatenate([p for _, p in out])


def collapse(strings: list[bytes], keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """The number of each string's value, the values, and the least order and the key of each."""
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
    lowest = np.full(len(number), _LAST, np.int64)
    np.minimum.at(lowest, which, order)
    own_key = np.zeros(len(number), np.uint64)
    own_key[which] = keys
    return which, list(number), lowest, own_key


def _counted(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each row, ``count`` of them."""
    return np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)


def _each(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``values``, place in ``wanted``) of all equal pairs."""
    order = np.argsort(values, kind="stable")
    low, high = np.searchsorted(values[order], wanted, "left"), np.searchsorted(values[order], wanted, "right")
    return order[_counted(low, high - low)], np.repeat(np.arange(len(wanted)), high - low)




# ---------------------------------------------------------------- the steps of the job


def _keys(source: DataFrame, length: int, parts: int, buckets: int) -> DataFrame:
    """First exchange: each text's keys, to the part of the key; keys that several texts of a block have, at once to the text's bucket.

    Of the latter a part gets two texts and the count, whatever the block holds. part, blob; parts from ``parts`` on are buckets of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches, ["tid", "text"]):
            once = {}
            for i, t in zip(ids, texts, strict=True):
                once.setdefault(i, t)
            tids = np.array(list(once), np.int64)
            key, text, _, _ = pieces(list(once.values()), length)
            order = np.argsort(key, kind="stable")
            key, text = key[order], text[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])]) if len(key) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            times = np.diff(first, append=len(key))
            key, text = key[first], text[first]  # a row for each key of a text
            begin = _runs(key)
            width = np.diff(begin, append=len(key))
            total = np.add.reduceat(times, begin) if len(begin) else times
            nth = np.arange(len(key)) - np.repeat(begin, width)
            witness = nth < 2
            counts = np.where(nth == 1, np.repeat(total, width) - np.repeat(times[begin] if len(begin) else times, width), times)
            rows = []
            w_key, w_text, w_count = key[witness], text[witness], counts[witness]
            for part, (k, t, c) in _dealt(_part(w_key, parts).astype(np.int64), w_key, w_text, w_count):
                rows.append((part, _pack((k & np.uint64(0xFFFFFFFF)).astype(np.uint32), tids[t], c.astype(np.uint32))))
            shared = np.repeat(width > 1, width)
            code, tid = _code(key[shared], parts), tids[text[shared]]
            for bucket, (c, t) in _dealt(tid % buckets, code, tid):
                rows.append((parts + bucket, _pack(t, c)))
            for a in range(0, len(rows), 256):
                yield _table(rows[a : a + 256], **_BLOB)

    return workers(source.select("tid", "text")).mapInArrow(run, "part long, blob binary")


def _shared(dealt: DataFrame, parts: int, buckets: int) -> DataFrame:
    """Keys that several texts have, to the texts' buckets: part (a bucket, or -1 for keys of many pieces with their counts), blob, n."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        part, rows = key[0].as_py(), []
        blobs = [b.as_py() for b in group.column("blob")]
        if part >= parts:
            arrays = [_unpack(b, np.int64, np.uint64) for b in blobs]
            rows.append((part - parts, _pack(*(np.concatenate(x) for x in zip(*arrays, strict=True))), sum(len(x[0]) for x in arrays)))
        else:
            low, tid, count = (np.concatenate(x) for x in zip(*(_unpack(b, np.uint32, np.int64, np.uint32) for b in blobs), strict=True))
            order = np.argsort(low, kind="stable")
            low, tid, count = low[order], tid[order], count[order]
            begin = _runs(low)
            width = np.diff(begin, append=len(low))
            several = np.minimum.reduceat(tid, begin) != np.maximum.reduceat(tid, begin)
            total = np.add.reduceat(count.astype(np.int64), begin)
            code = (np.uint64(part) << np.uint64(32)) | low.astype(np.uint64)
            many = several & (total > MOST)
            if many.any():
                rows.append((-1, _pack(code[begin[many]], total[many]), int(many.sum())))
            hit = np.repeat(several, width)
            for bucket, (t, c) in _dealt(tid[hit] % buckets, tid[hit], code[hit]):
                rows.append((bucket, _pack(t, c), len(t)))
        return pa.Table.from_batches([_table(rows, **_BLOB, n=pa.int64())])

    return workers(dealt).groupBy("part").applyInArrow(run, "part long, blob binary, n long")


def _by_text(shared: DataFrame) -> DataFrame:
    """tid, codes: the keys of each text that other texts have, too."""

    def run(group: pa.Table) -> pa.Table:
        tid, code = (np.concatenate(x) for x in zip(*(_unpack(b.as_py(), np.int64, np.uint64) for b in group.column("blob")), strict=True))
        order = np.argsort(tid, kind="stable")
        tid, code = tid[order], code[order]
        begin = _runs(tid)
        rows = [(int(tid[a]), np.unique(code[a:b]).tobytes()) for a, b in zip(begin, [*begin[1:], len(tid)], strict=True)]
        return pa.Table.from_batches([_table(rows, tid=pa.int64(), codes=pa.binary())])

    return workers(shared.filter("part >= 0").select("part", "blob")).groupBy("part").applyInArrow(run, "tid long, codes binary")


def _crowded(shared: DataFrame) -> np.ndarray:
    """Sorted codes of the keys whose pieces are above MOST, or above the least power of 2 that leaves CROWDED such keys at most."""
    rows = workers(shared.filter("part < 0").select("blob"))

    def powers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                power, n = np.unique(np.log2(_unpack(blob.as_py(), np.uint64, np.int64)[1]).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(power), pa.array(n)], ["power", "n"])

    most, above = MOST, 0
    for power, n in sorted(((r.power, r.n) for r in rows.mapInArrow(powers, "power long, n long").groupBy("power").agg(F.sum("n").alias("n")).collect()), reverse=True):
        above += n
        if above > CROWDED:
            most = 2 ** (power + 1)
            break

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                code, total = _unpack(blob.as_py(), np.uint64, np.int64)
                yield _table([(code[total >= most].tobytes(),)], codes=pa.binary())

    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.codes, np.uint64) for r in rows.mapInArrow(codes, "codes binary").collect())]))


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_, values)
    at[at == len(sorted_)] = 0
    return sorted_[at] == values


def _pieces(marked: DataFrame, length: int, parts: int, groups: int, crowded: np.ndarray) -> DataFrame:
    """Second exchange: the pieces of shared keys, to the group of the key: part, blob.

    Of equal pieces of a block only those of the least document travel; the others' bytes are found already and go, as
    spans, to a group of their own kind (from ``groups`` on). Strings of crowded keys travel one by one, keyed by themselves.
    """
    held = marked.sparkSession.sparkContext.broadcast(crowded)  # at most CROWDED codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tids, ords, codes, texts in _blocks(batches, ["tid", "ord", "codes", "text"]):
            key, text, start, count = pieces(texts, length)
            code = _code(key, parts)
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            hit = np.zeros(len(key), bool)
            for k, own in enumerate(codes):
                hit[bounds[k] : bounds[k + 1]] = _among(code[bounds[k] : bounds[k + 1]], np.frombuffer(own, np.uint64))
            key, text, start, count, code = key[hit], text[hit], start[hit], count[hit], code[hit]
            single = _among(code, held.value)
            if single.any():
                times = count[single]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                text = np.concatenate([text[~single], np.repeat(text[single], times)])
                start = np.concatenate([start[~single], np.repeat(start[single], times) + nth])
                count = np.concatenate([count[~single], np.ones(len(nth), np.int64)])
                key = np.concatenate([key[~single], np.zeros(len(nth), np.uint64)])
                first = len(key) - len(nth)
            else:
                first = len(key)
            ord_, tid = np.array(ords, np.int64)[text], np.array(tids, np.int64)[text]
            strings = [texts[t][s : s + c] for t, s, c in zip(text.tolist(), start.tolist(), (count + length - 1).tolist(), strict=True)]
            if first < len(key):
                key[first:] = whole_hashes(b"".join(strings[first:]), length)
            lowest: dict[bytes, int] = {}
            for s, o in zip(strings, ord_.tolist(), strict=True):
                if o < lowest.setdefault(s, o):
                    lowest[s] = o
            gone = ord_ > np.fromiter(map(lowest.__getitem__, strings), np.int64, len(strings))
            rows = []
            for to, own in _dealt(tid[gone] % groups, tid[gone], ord_[gone], start[gone], (start + count + length - 1)[gone]):
                rows.append((groups + to, _pack(*_joined(*own))))
            left = np.flatnonzero(~gone)
            for to, (at,) in _dealt(_part(key[left], groups).astype(np.int64), left):
                said = np.frombuffer(b"".join(strings[i] for i in at), np.uint8)
                blob = _pack(key[at], tid[at], ord_[at], start[at].astype(np.int32), count[at].astype(np.int32))
                rows.append((to, len(blob).to_bytes(8, "little") + blob + zstandard.ZstdCompressor(level=1).compress(said.tobytes())))
            for a in range(0, len(rows), 256):
                yield _table(rows[a : a + 256], **_BLOB)

    return workers(marked).mapInArrow(run, "part long, blob binary")


def _joined(tid: np.ndarray, ord_: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The spans of each text, where they meet as one."""
    order = np.lexsort((start, ord_, tid))
    tid, ord_, start, end = tid[order], ord_[order], start[order], end[order]
    text = np.cumsum(np.concatenate([[0], (tid[1:] != tid[:-1]) | (ord_[1:] != ord_[:-1])])) if len(tid) else np.zeros(0, np.int64)
    shift = text * (int(end.max()) + 1 if len(end) else 1)  # texts one after another, so that one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (start + shift)[1:] > reach[:-1]]) if len(tid) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(tid)) - 1 if len(first) else first
    return tid[first], ord_[first], start[first], (reach - shift)[last]


def _spans(dealt: DataFrame, length: int, groups: int, buckets: int) -> DataFrame:
    """part (a bucket of texts), blob: the bytes of texts that a lesser document has; a group of pieces makes one row for each bucket."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        blobs = [b.as_py() for b in group.column("blob")]
        if key[0].as_py() >= groups:
            found = [np.concatenate(x) for x in zip(*(_unpack(b, *[np.int64] * 4) for b in blobs), strict=True)]
        else:
            parts, strings = [], []
            for b in blobs:
                size = int.from_bytes(b[:8], "little")
                own = _unpack(b[8 : 8 + size], np.uint64, np.int64, np.int64, np.int32, np.int32)
                said, at = zstandard.ZstdDecompressor().decompress(b[8 + size :]), 0
                for n in (own[4] + (length - 1)).tolist():
                    strings.append(said[at : at + n])
                    at += n
                parts.append(own)
            keys, tid, ord_, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            start, count = start.astype(np.int64), count.astype(np.int64)
            which, distinct, lowest, own_key = collapse(strings, keys, ord_)
            gone = ord_ > lowest[which]
            first = np.flatnonzero(~gone)
            string, place = resolve(distinct, own_key, lowest, length)
            order = np.lexsort((place, string))
            string, place = string[order], place[order]
            begin = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]) | (place[1:] > place[:-1] + 1)])) if len(string) else string
            row, nth = _each(which[first], string[begin])
            row, a, b = first[row], place[begin][nth], (place[np.append(begin[1:], len(place)) - 1] if len(place) else place)[nth] + length
            found = [np.concatenate([x[gone], y]) for x, y in zip((tid, ord_, start, start + count + length - 1), (tid[row], ord_[row], start[row] + a, start[row] + b), strict=True)]
        own = _joined(*found)
        rows = [(bucket, _pack(*x)) for bucket, x in _dealt(own[0] % buckets, *own)]
        return pa.Table.from_batches([_table(rows, **_BLOB)])

    return workers(dealt).groupBy("part").applyInArrow(run, "part long, blob binary")


def _spans_by_text(spans: DataFrame) -> DataFrame:
    """tid, ord, spans: the spans of each text as int64 pairs (start, end), where they meet as one."""

    def run(group: pa.Table) -> pa.Table:
        found = (np.concatenate(x) for x in zip(*(_unpack(b.as_py(), *[np.int64] * 4) for b in group.column("blob")), strict=True))
        tid, ord_, start, end = _joined(*found)
        text = np.flatnonzero(np.concatenate([[True], (tid[1:] != tid[:-1]) | (ord_[1:] != ord_[:-1])]))
        rows = [(int(tid[a]), int(ord_[a]), np.stack([start[a:b], end[a:b]], 1).tobytes()) for a, b in zip(text, [*text[1:], len(tid)], strict=True)]
        return pa.Table.from_batches([_table(rows, tid=pa.int64(), ord=pa.int64(), spans=pa.binary())])

    return workers(spans).groupBy("part").applyInArrow(run, "tid long, ord long, spans binary")


def repeated_spans(docs: DataFrame, length: int = 50) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text): its rows without and with texts, its distinct texts, and the spans of bytes to remove.

    Rows have doc_id, ord (the order of documents), digest and tid of the text, n_bytes or text. Distinct texts have digest, first (the
    least ord), n (rows), tid, n_bytes. Spans have tid, ord and spans (int64 pairs as binary), for rows whose ord is the text's first only: of a
    later copy all is removed.
    """
    source = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    digest = F.sha2(F.col("text").cast("binary"), 256)
    source = source.withColumn("digest", digest).withColumn("tid", F.xxhash64("digest"))
    rows = durable(source.select("doc_id", "ord", "digest", "tid", F.octet_length("text").cast("long").alias("n_bytes")))
    firsts = durable(rows.groupBy("digest").agg(F.min("ord").alias("first"), F.count("*").alias("n"), F.first("tid").alias("tid"), F.first("n_bytes").alias("n_bytes")))
    size = firsts.agg(F.sum("n_bytes")).head()[0] or 0
    # a piece holds (length - ANCHOR + 2) / 2 strings on average
    parts = max(1, -(-2 * size // (length - min(ANCHOR, length) + 2) // PART_KEYS))
    buckets = max(1, -(-size // (4 * BLOCK)))
    long = source.filter(F.octet_length("text") >= length)
    shared = durable(_shared(_keys(long, length, parts, buckets), parts, buckets))
    crowded = _crowded(shared)
    groups = max(1, -(-(shared.filter("part >= 0").agg(F.sum("n")).head()[0] or 0) // PART_PIECES))
    marks = _by_text(shared).join(firsts.select("tid", "digest", F.col("first").alias("ord")), "tid")
    marked = long.join(marks.drop("tid"), ["digest", "ord"]).select("tid", "ord", "codes", "text")
    spans = durable(_spans_by_text(_spans(_pieces(marked, length, parts, groups, crowded), length, groups, buckets)))
    return rows, source, firsts, spans


def drop_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte covered by a string of ``length`` bytes that also starts in a document with a lesser doc_id is removed; strings are
    judged on the input and may overlap, n_spans counts the maximal removed runs, kept_sha256 digests what is left. Bytes are UTF-8,
    so a character may be cut. Rows with one doc_id are not lesser than each other, a null id counts as the greatest long. Null counts as
    empty; empty and short texts lose nothing. Repeated rows give repeated rows, an empty table an empty one. Columns beside doc_id and
    text are not read.

    Equal texts meet by digest and go through the rest once. Two texts count as one where xxhash64 of their SHA-256 digests agree.
    """
    rows, source, firsts, spans = repeated_spans(docs, length)
    cut_rows = source.join(spans.select("ord", F.col("tid").alias("own"), "spans"), "ord").filter("tid = own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK // 4):
            out: list[tuple] = []
            for raw, own in zip(batch.column("text").cast(pa.binary()), batch.column("spans").to_pylist(), strict=True):
                text, at, kept = raw.as_py(), 0, hashlib.sha256()
                gone = np.frombuffer(own, np.int64).reshape(-1, 2)
                for a, b in gone.tolist():
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((len(text), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), kept.hexdigest()))
            said = _table(out, n_bytes=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(), kept_sha256=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *said.columns], ["doc_id", *said.schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = workers(cut_rows.select("doc_id", "text", "spans")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    # the others need no text: later copies are gone whole, the rest stays whole
    total = max(1, firsts.agg(F.sum("n")).head()[0] or 0)
    whole = join_by_weight(rows.select("doc_id", "ord", "digest", "tid", "n_bytes"), firsts.select("digest", "first", "n"), ["digest"], "n", total, "inner")
    whole = whole.join(spans.select("tid", "ord"), ["tid", "ord"], "left_anti")
    copy = (F.col("ord") > F.col("first")) & (F.col("n_bytes") >= length)
    whole = whole.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        copy.cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("digest")).alias("kept_sha256"),
    )
    return cut.unionByName(whole)
