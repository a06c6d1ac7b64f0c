"""Substring dedup by relative Lempel-Ziv parsing.

A shard's reference block is made of the stretches of texts around one anchor gram, each place of
a text once. Its suffix array, by doubling prefixes, gives for every place the longest match at
any other place of the block. Stretches are factored against it greedily, from left to right.
Factors of at least a window become spans, and the next factor is looked for at the first window
that crosses the factor's end, so that no window that straddles a boundary is missed; where
there is no such factor the parsing goes on with the next word.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from arbora.llm.repeats import CHUNK, Job, Rolling, Units, merged, powers, without_repeats

#: Words of a repeated window, and of the gram at which it is anchored.
WIDTH, GRAM = 35, 10
#: Words of more bytes are hashed by their digest.
LONG_WORD = 256
#: Bytes of a text whose words are listed at once.
STRETCH = 1 << 19
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: A number for each byte.
BYTES = powers(0xA0761D6478BD642F, 257)[1:]


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists; long ones as their digests behind a byte that is no text."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + STRETCH) if len(text) - at > STRETCH else None
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        if words and max(map(len, words)) > LONG_WORD:
            words = [w if len(w) <= LONG_WORD else b"\xff" + xxhash.xxh3_128_digest(w) for w in words]
        yield words
        at = end


def word_hashes(words: list[bytes]) -> np.ndarray:
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    return Rolling(BYTES[np.frombuffer(joined, dtype=np.uint8)]).of(ends - sizes, ends, ends - sizes)


def word_chunks(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    numbers, begins, sizes, words, size = [], [], [], [], 0
    for i, t in enumerate(texts):
        begin, tail = 0, []
        for own in words_of(t):
            own = tail + own
            if len(own) >= width:
                step = max(1, CHUNK // (LONG_WORD + 1) - width)  # the words of a step, with spaces, fit a chunk
                for a in range(0, len(own) - width + 1, step):
                    part = own[a : a + step + width - 1]
                    weight = sum(map(len, part)) + len(part)
                    if words and size + weight > CHUNK:
                        yield np.array(numbers), np.array(begins), word_hashes(words), np.array(sizes)
                        numbers, begins, sizes, words, size = [], [], [], [], 0
                    numbers.append(i)
                    begins.append(begin + a)
                    sizes.append(len(part))
                    words += part
                    size += weight
            tail = own[-(width - 1) :]
            begin += len(own) - len(tail)
    if words:
        yield np.array(numbers), np.array(begins), word_hashes(words), np.array(sizes)


def word_slices(context: bytes):
    ends = list(accumulate(len(w) + 1 for w in context.split(b" ")))
    return lambda a, b: context[ends[a - 1] if a else 0 : ends[b - 1] - 1] if 0 <= a < b <= len(ends) else None


def longest_matches(block: np.ndarray, levels: int) -> np.ndarray:
    """For each place of a block the length of its longest match at any other place, up to 2 ** ``levels``.

    Ranks of the 2 ** k numbers from each place on, by doubling, give the order of all suffixes;
    the longest match of a suffix is with a neighbour in that order.
    """
    n = len(block)
    ranks = [np.unique(block, return_inverse=True)[1].astype(np.int32)]
    for k in range(levels):
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - (1 << k))] = ranks[-1][1 << k :] + 1
        ranks.append(np.unique(ranks[-1] * np.int64(n + 1) + ahead, return_inverse=True)[1].astype(np.int32))
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[1:].copy(), order[:-1].copy()
    length, open_ = np.zeros(n - 1, dtype=np.int64), np.ones(n - 1, dtype=bool)
    for k in range(levels, -1, -1):
        rank = np.append(ranks[k], -1)
        same = open_ & (rank[np.minimum(a, n)] == rank[np.minimum(b, n)]) & (a < n) & (b < n)
        step = same.astype(np.int64) << k
        a, b, length = a + step, b + step, length + step
        if k == levels:
            open_ = ~same
    out = np.zeros(n, dtype=np.int64)
    out[order[1:]] = length
    out[order[:-1]] = np.maximum(out[order[:-1]], length)
    return out


def factored(longest: np.ndarray, width: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the factors of at least ``width``, in order, of a greedy parsing."""
    hits = np.flatnonzero(longest >= width).tolist()
    starts, ends, k = [], [], 0
    while k < len(hits):
        at, end = hits[k], hits[k] + int(longest[hits[k]])
        starts.append(at)
        ends.append(end)
        k = bisect_left(hits, end - width + 1, k + 1)
    return starts, ends


def parsing(width: int):
    """The solver: shards' contexts become reference blocks, which their own stretches are factored against."""

    def solve(shard: np.ndarray, t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k1, k2, place, before = (t[c].to_numpy().astype(np.int64) for c in ("k1", "k2", "place", "before"))
        contexts, start = t["context"], place - before
        numbers: dict[bytes, int] = {}
        block: list[int] = []
        base = 0
        rows, firsts, sizes = [], [], []  # of each stretch: its row, its first word's place in the text, its words
        last, end = None, 0
        for row in np.lexsort((start, k2, k1, shard)).tolist():
            words = contexts[row].as_py().split(b" ")
            key, a = (shard[row], k1[row], k2[row]), int(start[row])
            if key == last and a <= end:
                words = words[end - a :]
                sizes[-1] += len(words)
            else:
                if last is not None:
                    block.append(-len(rows))  # a number of its own ends each stretch
                if last is None or key[0] != last[0]:
                    numbers, base = {}, base + len(numbers)  # words of two shards never match
                rows.append(row)
                firsts.append(a)
                sizes.append(len(words))
                end = a
            block += [numbers.setdefault(w, base + len(numbers)) for w in words]
            last, end = key, end + len(words)
        block.append(-len(rows))
        starts, ends = map(np.array, factored(longest_matches(np.array(block), width.bit_length()), width))
        if not len(starts):
            return starts, starts, starts
        begins = np.cumsum(np.array(sizes) + 1) - np.array(sizes) - 1
        own = np.searchsorted(begins, starts, side="right") - 1
        shift = np.array(firsts)[own] - begins[own]
        return np.array(rows)[own], starts + shift, ends + shift

    return solve


UNITS = Units(word_chunks, lambda t: t.split(), len, lambda w, a, b: b" ".join(w[a:b]), word_slices)


def job(width: int = WIDTH, gram: int = GRAM) -> Job:
    return Job(UNITS, width, gram, parsing(width))


def stripping(width: int, gram: int):
    def strip(text: bytes, copies: int, spans: list[int] | None) -> tuple[int, int, str]:
        words = text.split()
        own = [(0, len(words))] if copies > 1 and len(words) >= width else merged(spans or [], words, gram, width)
        kept, at = [], 0
        for a, b in own:
            kept += words[at:a]
            at = b
        kept += words[at:]
        return len(words), sum(b - a for a, b in own), hashlib.sha256(b" ".join(kept)).hexdigest()

    return strip


def strip_word_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of ``docs``.

    Each word covered by ``width`` consecutive words that also start anywhere else, in any row or
    the same one, is removed. Words are runs other than ASCII white space, unchanged. Null texts
    have no words. Very long texts and words are read whole, a chunk at a time, and periodic
    stretches cost no more than others. Ids may be null or repeat; rows that repeat a text are
    copies of each other. Other columns are ignored. An empty table gives none.
    """
    return without_repeats(docs, job(width, gram), stripping(width, gram), "n_words long, n_removed long, kept_sha256 string", **options)
