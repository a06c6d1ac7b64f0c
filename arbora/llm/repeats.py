"""Windows that occur again anywhere in a corpus: what the substring operators share.

A text is a sequence of units (bytes, or words). A window is ``width`` units in a row. Each window
picks one of its grams (``gram`` units in a row) as its anchor, by content alone, so equal windows
have equal anchors at equal places. The search therefore

1. finds the anchors of each text (about two in ``width - gram + 2`` units, and a few for each
   periodic stretch, however long it is),
2. keeps those whose gram occurs in another place, by an aggregate with partial sums,
3. cuts a context around each of them, the windows that may have picked it, and
4. brings contexts with equal grams together in a shard, where a solver compares their units and
   returns the span of the repeated windows around each anchor.

Solvers compare units. A shard of too many contexts is dealt again, by longer grams: see
crowded_spans and dealt_again; there contexts (by two 64-bit hashes) and windows (by a 128-bit
one) count as equal if their hashes are. So no shard grows with the corpus and none is capped.

Exact copies of whole texts (two 64-bit hashes) are one text in this search, with a count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import cut, for_python, join_by_size, join_spread, text_of, written

#: Units that are hashed at once; places in such a chunk take 18 bits of the keys below.
CHUNK = 1 << 18
PLACE = np.uint64(CHUNK - 1)
#: Contexts in a shard beyond which it is dealt again, and ranges that its windows are split into.
SHARD, PARTS = 1 << 14, 4
#: Contexts that a solver sees at once, in whole shards.
TOGETHER = 1 << 14
#: Anchors of one period that are followed one by one.
FEW = 256
#: Anchors that are looked at together for periods.
STEP = 1 << 12
#: Odd multipliers of the rolling hash and of its finish.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretches of a sequence, by prefix sums."""

    UP = powers(BASE, CHUNK + 1)
    DOWN = powers(pow(BASE, -1, 1 << 64), CHUNK + 1)

    def __init__(self, units: np.ndarray):
        self.sums = np.zeros(len(units) + 1, dtype=np.uint64)
        np.cumsum(units * self.UP[: len(units)], out=self.sums[1:])

    def of(self, starts, ends, at) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.DOWN[at]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        h ^= h >> np.uint64(29)
        h *= np.uint64(MIX)
        return h ^ (h >> np.uint64(32))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, from least-so-far runs of blocks of ``w``."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    full[: len(x)] = x
    full = full.reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def gaps(hashes: np.ndarray, picks: np.ndarray, begins: np.ndarray, most: int) -> np.ndarray:
    """How far before each pick the same gram stands last in its text, 0 if not within ``most``."""
    out, back = np.zeros(len(picks), dtype=np.int64), np.arange(1, most + 1)
    for a in range(0, len(picks), STEP):
        own = picks[a : a + STEP, None]
        at = own - back
        same = (hashes[np.maximum(at, 0)] == hashes[own]) & (at >= begins[a : a + STEP, None])
        out[a : a + STEP] = np.where(same.any(axis=1), same.argmax(axis=1) + 1, 0)
    return out


def leading(same: np.ndarray) -> np.ndarray:
    """How many of each row's first values are true."""
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))


def runs(units: np.ndarray, picks: np.ndarray, gap: np.ndarray, begins: np.ndarray, ends: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretch with period ``gap`` around each pick, as far as windows with that pick see.

    Where many picks have the same period, the whole of ``units`` is compared at once instead.
    """
    start, end = np.zeros_like(picks), np.zeros_like(picks)
    periods, kind, size = np.unique(gap, return_inverse=True, return_counts=True)
    for p in periods[size > FEW].tolist():
        own = np.flatnonzero(gap == p)
        breaks = np.concatenate([[-1], np.flatnonzero(units[p:] != units[:-p]), [len(units) - p]])
        k = np.searchsorted(breaks, picks[own] - p)
        start[own] = np.maximum(breaks[k - 1] + 1, begins[own])
        end[own] = np.minimum(breaks[k] + p, ends[own])
    few, back, ahead = np.flatnonzero(size[kind] <= FEW), np.arange(1, width - gram + 2), np.arange(width + 1)
    for a in range(0, len(few), STEP):
        own = few[a : a + STEP]
        at, p = (picks - gap)[own, None], gap[own, None]
        i, j = at - back, at + ahead
        start[own] = (at - leading((i >= begins[own, None]) & (units[np.maximum(i, 0)] == units[np.maximum(i, 0) + p]))[:, None])[:, 0]
        last = len(units) - 1
        end[own] = (at + p + leading((j + p < ends[own, None]) & (units[np.minimum(j, last)] == units[np.minimum(j + p, last)]))[:, None])[:, 0]
    return start, end


def anchors(units: np.ndarray, sizes: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, gram hash) of the anchors of texts that lie in ``units`` in a row.

    A window's anchor is its gram of the least hash, the last of equal ones. In a periodic stretch
    that choice would move on with each period, so there it depends on which ends of the stretch
    the window shows: its end (the last gram stays), only its start (the first one), or neither.
    Of the windows that show neither all but the first ``period + 1`` are left out: each equals one
    of those, and ``periodic_span`` gives the whole stretch once one of them is found repeated,
    as the first always is. All of this depends on the window's units alone, so equal windows still
    have equal anchors at equal places. At most CHUNK units.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(units) < width:
        return none, none, none
    first = np.cumsum(sizes) - sizes
    rolling = Rolling(units)
    n = len(units) - gram + 1
    hashes = rolling.of(slice(0, n), slice(gram, None), slice(0, n))
    keys = (hashes & ~PLACE) | (PLACE - np.arange(n, dtype=np.uint64))
    least = sliding_least(keys, width - gram + 1)
    windows = np.maximum(sizes - width + 1, 0)
    starts = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    places = (PLACE - (least[starts] & PLACE)).astype(np.int64)
    new = np.diff(places, prepend=-1) != 0
    picks = places[new]
    owner = np.searchsorted(first, picks, side="right") - 1
    gap = gaps(hashes, picks, first[owner], longest_period(gram, width))
    if gap.any():
        start, end = np.zeros_like(picks), np.zeros_like(picks)
        some = np.flatnonzero(gap)
        start[some], end[some] = runs(units, picks[some], gap[some], first[owner[some]], (first + sizes)[owner[some]], gram, width)
        each = np.diff(np.append(np.flatnonzero(new), len(places)))
        held = np.flatnonzero(np.repeat(gap > 0, each))
        pick = np.repeat(some, each[some])
        seen = (starts[held] <= places[held] - gap[pick]) & (end[pick] >= starts[held] + width)
        held, pick = held[seen], pick[seen]
        at = starts[held]
        shown = start[pick] > at
        places[held[shown]] -= ((picks - start) // np.maximum(gap, 1) * gap)[pick[shown]]
        kept = np.ones(len(places), dtype=bool)
        kept[held[~shown & (at > (start + gap)[pick])]] = False
        picks = np.unique(places[kept])
        owner = np.searchsorted(first, picks, side="right") - 1
    return owner, picks - first[owner], hashes[picks].view(np.int64)


def longest_period(gram: int, width: int) -> int:
    """Periods up to which a window within a periodic stretch shows the same gram twice."""
    return (width - gram) // 2


def periodic_span(sequence, end: int, gram: int, width: int) -> tuple[int, int] | None:
    """The periodic stretch that the window before ``end`` lies in, if all of it is repeated.

    A stretch of period p and at least ``width`` + p units is covered by windows that also start p
    units further on or before. ``sequence`` is sliced and compared: bytes, or a list of words.
    """
    tail = sequence[end - width : end]
    for p in range(1, longest_period(gram, width) + 1):
        if tail[0] == tail[p] and tail[-1] == tail[-1 - p] and tail[p:] == tail[:-p]:
            break
    else:
        return None
    start, n = end - width, len(sequence)
    for step in (1 << 16, 1 << 8, 1):  # large stretches are compared in large steps
        while end + step <= n and sequence[end : end + step] == sequence[end - p : end - p + step]:
            end += step
        while start >= step and sequence[start - step : start] == sequence[start - step + p : start + p]:
            start -= step
    return (start, end) if end - start >= width + p else None


class Units(NamedTuple):
    """How a kind of unit is read from texts. Functions get and give bytes."""

    #: Stretches of texts in a row: (texts' numbers, places of their first units, units, sizes).
    chunks: Callable[[list[bytes], int], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
    #: The text prepared for slicing, its number of units, and a slice of it as bytes.
    open: Callable[[bytes], object]
    size: Callable[[object], int]
    slice: Callable[[object, int, int], bytes]
    #: The same for a context that was sliced out before: gives slice(start, end) of it, or None
    #: where it doesn't reach that far.
    inner: Callable[[bytes], Callable[[int, int], bytes | None]]


class Job(NamedTuple):
    """Windows of ``width`` units, anchored at grams of ``gram``; solve works on whole shards.

    solve(shard, t) gets the members of whole shards, in order of the shard's number: k1 and k2 of
    the text, the anchor's place, the context, the units that it has before its anchor, and the least
    and greatest distance of the start of a window that is asked for before the anchor. It returns
    rows of t, and starts and ends of stretches of their texts that repeated windows cover.
    """

    units: Units
    width: int
    gram: int
    solve: Callable[[np.ndarray, pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k1, k2, text: two hashes with different seeds name a text."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.cast("binary").alias("text"))


def anchor_rows(texts: DataFrame, job: Job) -> DataFrame:
    """gram, k1, k2, place: the anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for numbers, begins, units, sizes in job.units.chunks(b.column(b.schema.get_field_index("text")).to_pylist(), job.width):
                text, place, gram = anchors(units, sizes, job.gram, job.width)
                row = numbers[text]
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(k1[row]), pa.array(k2[row]), pa.array((place + begins[text]).astype(np.int32))], ["gram", "k1", "k2", "place"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "gram long, k1 long, k2 long, place int")


def context_rows(marked: DataFrame, job: Job) -> DataFrame:
    """gram, k1, k2, place, before, units, context: windows that may hold each marked anchor.

    ``marked`` has k1, k2, text and marks (place, gram, crowded), each text once; units is the
    number of units of the context, before of those that lie before the anchor.
    """
    slack = job.width - job.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "k1", "k2", "place", "before", "units", "context"]
        for b in batches:
            out: list[tuple] = []
            held = 0
            for k1, k2, text, marks in zip(*(b.column(c) for c in ("k1", "k2", "text", "marks")), strict=True):
                opened = job.units.open(text.as_py())
                n, k1, k2 = job.units.size(opened), k1.as_py(), k2.as_py()
                for m in marks.as_py():
                    p = m["place"]
                    a = max(0, p - slack)
                    out.append((m["gram"], k1, k2, p, p - a, (z := min(n, p + job.width)) - a, c := job.units.slice(opened, a, z)))
                    held += len(c)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names)

    out = marked.select("k1", "k2", "text", "marks").mapInArrow(run, "gram long, k1 long, k2 long, place int, before int, units int, context binary")
    return out.withColumn("low", F.lit(0)).withColumn("high", F.lit(slack))


TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


def solved(members: DataFrame, job: Job, keys: list[str]) -> DataFrame:
    """k1, k2, span: the solver's spans for shards of ``members``, by ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table, key: np.ndarray) -> pa.RecordBatch:
            shard = np.insert(np.cumsum((key[1:] != key[:-1]).any(axis=1)), 0, 0)
            row, start, end = (x.astype(np.int64) for x in job.solve(shard, t))
            return pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy()[row]) for c in ("k1", "k2")] + [pa.array(start << 31 | end)], ["k1", "k2", "span"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < TOGETHER:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([t[c].to_numpy() for c in keys], axis=1)
            other = np.flatnonzero((key != key[-1]).any(axis=1))
            n = other[-1] + 1 if len(other) else 0  # the last shard may go on
            if n:
                yield solve(t.slice(0, n), key[:n])
            held = t.slice(n).to_batches()
        if sum(x.num_rows for x in held):
            t = pa.Table.from_batches(held).combine_chunks()
            yield solve(t, np.stack([t[c].to_numpy() for c in keys], axis=1))

    return members.repartition(*keys).sortWithinPartitions(*keys).select("k1", "k2", "place", "before", "context", "low", "high", *(k for k in keys if k not in ("low", "high"))).mapInArrow(run, "k1 long, k2 long, span long")


def core_rows(members: DataFrame, job: Job) -> DataFrame:
    """k1, k2, place, low, high, core1, core2: what a member's windows share, by where they start.

    The range is cut at PARTS + 1 points, the same for all members. A point is a window; what lies
    between two points is a range, and its core the units that all its windows share. There is
    no row where the text ends before the point or core does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            digests: list[bytes] = []
            for k1, k2, place, before, context, low, high in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "place", "before", "context", "low", "high")), strict=True):
                inner = job.units.inner(context)
                points = sorted({low + (high - low) * k // PARTS for k in range(PARTS + 1)})
                ranges = [(p, p) for p in points] + [(p + 1, q - 1) for p, q in zip(points, points[1:], strict=False) if q > p + 1]
                for a, z in ranges:
                    if (core := inner(before - a, before - z + job.width)) is not None:
                        out.append((k1, k2, place, a, z))
                        digests.append(xxhash.xxh3_128_digest(core))
            cores = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, TYPES[1:4] + (pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cores[:, 0].copy()), pa.array(cores[:, 1].copy())], ["k1", "k2", "place", "low", "high", "core1", "core2"])

    return members.select("k1", "k2", "place", "before", "context", "low", "high").mapInArrow(run, "k1 long, k2 long, place int, low int, high int, core1 long, core2 long")


def dealt_again(members: DataFrame, job: Job, shard: int) -> DataFrame:
    """The spans of ``members`` (with low and high, the range of windows) of overfull shards.

    All windows of a member hold its anchor, so the outermost repeated ones give its span. A round
    tests the windows at the points, and the cores of the ranges between them: ranges that lie
    beyond the outermost repeated point and whose core is repeated stay open. Shards of equal
    cores in which a range is open go to the solver, or on to the next round if still too large.
    ``members`` must be cut from their lineage, as every round reads them again.
    """
    out, keys, member = None, ["core1", "core2", "low", "high"], ["k1", "k2", "place"]
    contexts = members.select(*member, "before", "context")
    while True:
        cores = core_rows(members, job)
        who = F.xxhash64(*member)
        sizes = cores.groupBy(*keys).agg(F.count("*").alias("n"), F.min(who).alias("a"), F.max(who).alias("b")).where("a <> b").select(*keys, "n")
        again = written(cores.join(sizes, keys))
        points = again.where("low = high")
        start = (F.col("place") - F.col("low")).cast("long")
        found = points.select("k1", "k2", F.shiftleft(start, 31).bitwiseOR(start + job.width).alias("span"))
        outer = points.groupBy(*member).agg(F.min("low").alias("least"), F.max("low").alias("most"))
        ranges = again.where("low < high").join(outer, member, "left").withColumn("open", F.expr("most is null or low > most or high < least")).drop("least", "most")
        # a range that is closed for a member may hold what another one, whose range is open, repeats
        open_ = ranges.groupBy(*keys).agg(F.max("open").alias("open")).where("open").drop("open")
        open_ = written(ranges.drop("open").join(open_, keys))
        found = found.unionByName(solved(open_.where(F.col("n") <= shard).join(contexts, member), job, keys))
        out = found if out is None else out.unionByName(found)
        many = open_.where(F.col("n") > shard)
        if many.isEmpty():
            return out
        members = many.select(*member, "low", "high").join(contexts, member)


def crowded_spans(crowded: DataFrame, job: Job, shard: int) -> DataFrame:
    """The spans of the contexts of overfull shards.

    Contexts that are equal as a whole are repeated as a whole; one of each kind is left as a
    partner for others, chosen with partial sums before the shuffle.
    """
    who, same = F.xxhash64("k1", "k2", "place"), ["c1", "c2"]
    rows = written(crowded.withColumn("c1", F.xxhash64("context", "before")).withColumn("c2", F.xxhash64(F.lit(1), "context", "before")))
    one = F.first(F.struct("k1", "k2", "place", "before", "context", "low", "high")).alias("one")
    kinds = written(rows.groupBy(*same).agg(F.min(who).alias("a"), F.max(who).alias("b"), F.count("*").alias("n"), one))
    start = (F.col("place") - F.col("before")).cast("long")
    twins = join_spread(rows.where(F.col("units") >= job.width).select("k1", "k2", "place", "before", "units", *same), kinds.where("a <> b").select(*same, "n"), same, "n", ["k1", "k2", "place"])
    spans = twins.select("k1", "k2", F.shiftleft(start, 31).bitwiseOR(start + F.col("units")).alias("span"))
    return spans.unionByName(dealt_again(kinds.select("one.*"), job, shard))


def marks_of(rows: DataFrame, job: Job, shard: int) -> DataFrame:
    """k1, k2, marks: each text's anchors whose gram occurs in another place, in it or elsewhere."""
    found = anchor_rows(rows, job)
    who = F.xxhash64("k1", "k2", "place")
    grams = cut(found.groupBy("gram").agg(F.count("*").alias("n"), F.min(who).alias("a"), F.max(who).alias("b")).where("a <> b").select("gram", "n", (F.col("n") > shard).alias("crowded")))
    # a line that many texts share brings its grams to as many places; each text has one entry, however many copies it has
    return join_spread(found, grams, ["gram"], "n", ["k1", "k2", "place"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "gram", "crowded")).alias("marks"))


def spans_of(marked: DataFrame, job: Job, shard: int) -> DataFrame:
    """k1, k2, spans: for each text with repeated windows the spans that they cover, packed.

    A span is start * 2**31 + end.
    """
    some = lambda which: marked.withColumn("marks", F.filter("marks", which)).where(F.size("marks") > 0)
    spans = solved(context_rows(some(lambda m: ~m["crowded"]), job), job, ["gram"])
    crowded = some(lambda m: m["crowded"])
    if not crowded.isEmpty():
        spans = spans.unionByName(crowded_spans(context_rows(crowded, job), job, shard))
    return spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def merged(spans: list[int], sequence, gram: int, width: int) -> list[tuple[int, int]]:
    """Packed spans as (start, end), in order, those that meet or overlap made one, and with them
    the periodic stretches that they end in (see anchors)."""
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        while out and a <= out[-1][1]:
            last = out.pop()
            a, b = min(a, last[0]), max(b, last[1])
        out.append((a, b))

    todo = sorted((s >> 31, s & (1 << 31) - 1) for s in spans)
    for k, (a, b) in enumerate(todo):
        add(a, b)
        end = out[-1][1]
        if (k + 1 == len(todo) or todo[k + 1][0] > end) and (whole := periodic_span(sequence, end, gram, width)):
            add(*whole)
    return out


def without_repeats(docs: DataFrame, job: Job, strip: Callable[[bytes, int, list[int] | None], tuple], names: str, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """doc_id and what ``strip(text, copies, spans)`` gives for the row's text, as ``names``.

    The texts are shuffled once, to one row for each different text, where they meet their marks.
    A text without any has its result there; the others are written to the shared folder, and only
    they go on. Documents then look their text's result up by its two hashes.
    """
    rows = keyed(for_python(docs), id_col, text_col)
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies")).join(marks_of(rows, job, shard), ["k1", "k2"], "left")
    fields = [x.split()[0] for x in names.split(", ")]
    mark = "array<struct<place:int,gram:bigint,crowded:boolean>>"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(None,) * len(fields) if m.is_valid else strip(t.as_py(), n.as_py(), None) for t, n, m in zip(*(b.column(c) for c in ("text", "copies", "marks")), strict=True)]
            left = [t if m.is_valid else None for t, m in zip(b.column(2), b.column(4), strict=True)]
            results = [pa.array(x, pa.string() if f.endswith("sha256") else pa.int64()) for f, x in zip(fields, zip(*own, strict=True) if own else [[]] * len(fields), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x and x.as_py() for x in left], pa.binary()), b.column(3), b.column(4), *results], ["k1", "k2", "text", "copies", "marks", *fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [strip(t.as_py(), n.as_py(), s.as_py()) for t, n, s in zip(*(b.column(c) for c in ("text", "copies", "spans")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *(pa.array(x) for x in (zip(*own, strict=True) if own else [[]] * len(fields)))], ["k1", "k2", "copies", *fields])

    table = written(texts.select("k1", "k2", "text", "copies", "marks").mapInArrow(settle, f"k1 long, k2 long, text binary, copies long, marks {mark}, {names}"))
    marked = table.where("marks is not null").select("k1", "k2", "text", "copies", "marks")
    others = marked.drop("marks").join(spans_of(marked, job, shard), ["k1", "k2"], "left").select("k1", "k2", "text", "copies", "spans").mapInArrow(finish, f"k1 long, k2 long, copies long, {names}")
    results = written(table.where("marks is null").select("k1", "k2", "copies", *fields).unionByName(others))
    return join_by_size(rows.select("doc_id", "k1", "k2"), results, ["k1", "k2"], "copies").select("doc_id", *fields)
