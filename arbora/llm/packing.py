"""Best-fit packing of documents into sequences, planned over the histogram of lengths.

Best-fit decreasing runs over counts of lengths instead of documents: pieces of one length are
placed many at a time, and sequences with the same room left are one entry. The plan's size is
bounded by the capacity, not by the corpus. Documents then take the planned slots by their rank
within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import cut, for_python, text_of
from arbora.llm.tokens import WordEncoder, encoder

#: Tokens that a sequence holds.
CAPACITY = 4096
#: Token that ends each document.
END = 1
#: Rows of one length that are ranked in one group.
RANKED = 1000


class Slots(NamedTuple):
    """``count`` pieces of one length, ``each`` in a row in each sequence from ``sequence`` on."""

    start: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slots], dict[int, int], int]:
    """Slots in order of ``start``, each length's first slot, and the number of sequences.

    ``counts`` has the pieces of each length. A length's pieces, longest length first, go to the
    sequences with the least room that is enough, as many as fit into each, then to new ones.
    """
    room: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}
    slots, first, at, sequences = [], {}, 0, 0

    def put(left: int, sequence: int, n: int) -> None:
        if n and left:
            if left not in open_:
                open_[left] = []
                insort(room, left)
            open_[left].append((sequence, n))

    for length in sorted(counts, reverse=True):
        first[length], todo = at, counts[length]
        while todo:
            k = bisect_left(room, length)
            if k < len(room):
                left = room[k]
                sequence, n = open_[left].pop()
                if not open_[left]:
                    del open_[left], room[k]
            else:
                left, sequence = capacity, sequences
                n = -(-todo // (capacity // length))
                sequences += n
            each = left // length
            full = min(n, todo // each)
            if full:
                slots.append(Slots(at, full * each, sequence, each, capacity - left))
                put(left - each * length, sequence, full)
                at, todo = at + full * each, todo - full * each
            if todo and full < n:  # the last of the length, in one sequence that keeps more room
                slots.append(Slots(at, todo, sequence + full, todo, capacity - left))
                put(left - todo * length, sequence + full, 1)
                at, todo, full = at + todo, 0, full + 1
            put(left, sequence + full, n - full)
    return slots, first, sequences


def _cut(words: WordEncoder, keys: list[int | None], texts: list[str], capacity: int, end: int) -> list[tuple]:
    """The rows of ``pieces`` of some texts. A text that follows its copy has the copy's pieces."""
    last, step, out = np.array([end], dtype="<u4").tobytes(), 4 * capacity, []
    firsts = [i for i, x in enumerate(texts) if not i or x != texts[i - 1]]
    ends, own, now, rest, piece = [*firsts[1:], len(keys)], [], 0, b"", 0
    for i, packed in chain(words.packed([texts[i] for i in firsts]), [(len(firsts), b"")]):
        if i > now:  # the text before has ended
            rest += last
            own += [(piece + k, (piece + k) * capacity, len(ids := rest[a : a + step]) // 4, zlib.crc32(ids)) for k, a in enumerate(range(0, len(rest), step))]
            out += [(key, *x) for key in keys[firsts[now] : ends[now]] for x in own]
            own, now, rest, piece = [], i, b"", 0
        rest += packed
        while len(rest) >= step + 4:
            own.append((piece, piece * capacity, capacity, zlib.crc32(rest[:step])))
            rest, piece = rest[step:], piece + 1
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, then ``end``, cut to pieces.

    Only documents of more than ``capacity`` ids are cut; the last piece may be shorter. A null
    or empty text is the end token alone. Long texts are encoded and cut stretch by stretch. Copies that follow
    each other, as the mix gives them, are encoded once.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(WordEncoder, path)
        for b in batches:
            out = _cut(words, b.column(0).to_pylist(), b.column(1).to_pylist(), capacity, end)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    return for_python(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """``rows`` (doc_id, piece, length and others) with sequence_id and offset.

    Lengths are between 1 and ``capacity``, so the histogram, the plan and the table of lengths
    that are broadcast have a bound that doesn't depend on the rows. Ranks within a length are
    taken in groups of about ``ranked`` rows, by a hash of document and piece, and moved by the
    sizes of the groups before: a length that a third of all pieces share is ranked by many
    tasks. Which of the rows of one length gets which slot is immaterial; reruns agree, but for
    rows that repeat doc_id and piece, which may trade places. An empty table gives none.
    """
    spark = rows.sparkSession
    rows = cut(rows)
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    slots, first, _ = plan(counts, capacity)
    lengths = spark.createDataFrame([(k, first[k], -(-n // ranked)) for k, n in counts.items()], "length long, first long, groups long")
    salted = rows.join(F.broadcast(lengths), "length").withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.col("groups")))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "group").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy("length", "group").orderBy("doc_id", "piece")
    placed = salted.join(sizes, ["length", "group"]).withColumn("slot", F.col("first") + F.col("before") + F.row_number().over(own) - 1)
    table = np.array(slots, dtype=np.int64).reshape(-1, 5)

    columns = rows.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", sequence_id long, offset long"
    return placed.select(*columns, "slot").mapInArrow(_taking(table, columns), schema)


def _taking(table: np.ndarray, columns: list[str]):
    """The function that looks each slot up in the plan; it holds no session or DataFrame."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot, length = (b.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "length"))
            start, _, sequence, each, offset = table[np.searchsorted(table[:, 0], slot, side="right") - 1].T
            k = slot - start
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence + k // each), pa.array(offset + k % each * length)], [*columns, "sequence_id", "offset"])

    return take


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` of the documents, packed.

    A null or empty text is one piece of one id. Very long texts are encoded whole and cut to pieces. Rows that
    repeat are packed each on its own, ids may be null. Columns of ``docs`` other than id and text are ignored,
    whatever they are named. An empty table gives none.
    """
    return pack(pieces(docs, path, capacity), capacity)
