"""Substring dedup over suffix arrays, sorted by deep-shallow sorting.

Each shard holds the suffixes at one anchor gram. They are sorted twice: what follows the anchor,
and, reversed, what precedes it. Sorting is shallow first, a multikey quicksort whose characters
are eight bytes, down to a fixed depth; groups that still share that long a prefix are ordered
by blind tries, which compare a suffix with one other only. The two arrays of common prefixes
tell for each distance before the anchor which windows are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arbora.llm.repeats import CHUNK, Job, Units, merged, powers, without_repeats

#: Bytes of a repeated string, and of the gram at which it is anchored.
WIDTH, GRAM = 400, 96
#: Eight-byte characters that the multikey quicksort looks at before blind tries take over.
SHALLOW = 16
#: A number for each byte.
BYTES = powers(0xA0761D6478BD642F, 257)[1:]


def byte_chunks(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    numbers, begins, parts, size = [], [], [], 0

    def chunk():
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        return np.array(numbers), np.array(begins), BYTES[data], np.array([len(p) for p in parts])

    for i, t in enumerate(texts):
        for a in range(0, len(t) - width + 1, CHUNK - width + 1):
            part = t[a : a + CHUNK]
            if parts and size + len(part) > CHUNK:
                yield chunk()
                numbers, begins, parts, size = [], [], [], 0
            numbers.append(i)
            begins.append(a)
            parts.append(part)
            size += len(part)
    if parts:
        yield chunk()


def byte_slices(context: bytes):
    return lambda a, b: context[a:b] if a >= 0 and b <= len(context) else None


class Node:
    """Of a blind trie: the depth at which its members first differ, and a branch for each byte."""

    __slots__ = ("depth", "branches")

    def __init__(self, depth: int, branches: dict):
        self.depth, self.branches = depth, branches


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differing = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differing.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """Members in the order of their strings, and each one's common prefix with the one before.

    Inserting goes down by single bytes without looking at those in between, compares the string
    with the leaf that it comes to, and goes down again to where the two part. A string's end
    sorts before any byte. Equal strings share a leaf.
    """

    def byte(s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1

    root: Node | list[int] = [members[0]]
    for k in members[1:]:
        s, node = strings[k], root
        while isinstance(node, Node):
            node = node.branches.get(byte(s, node.depth)) or next(iter(node.branches.values()))
        t = strings[node[0]]
        depth = common(s, t)
        if depth == len(s) == len(t):
            node.append(k)
            continue
        above, node = None, root
        while isinstance(node, Node) and node.depth < depth:
            above, node = node, node.branches[s[node.depth]]
        if isinstance(node, Node) and node.depth == depth:
            node.branches[byte(s, depth)] = [k]
            continue
        new = Node(depth, {byte(t, depth): node, byte(s, depth): [k]})
        if above is None:
            root = new
        else:
            above.branches[s[above.depth]] = new
    order, prefixes = [], []
    todo: list[tuple[int, Node | list[int]]] = [(-1, root)]
    while todo:
        shared, node = todo.pop()
        if isinstance(node, Node):
            first, *others = sorted(node.branches)
            todo += [(node.depth, node.branches[c]) for c in reversed(others)]
            todo.append((shared, node.branches[first]))
        else:
            order += node
            prefixes += [shared] + [len(strings[node[0]])] * (len(node) - 1)
    return order, prefixes


def deep_shallow(strings: list[bytes], group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups, and common prefixes with the one before (-1: none).

    ``group`` numbers the groups in order. A pass of the multikey quicksort orders all open groups
    by their next character; common prefixes follow from the first character that differs.
    """
    n = len(strings)
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=n)
    wide = 8 * shallow
    data = np.frombuffer(b"".join([s[:wide].ljust(wide, b"\0") for s in strings]), dtype=">u8").reshape(n, shallow).astype(np.uint64)
    order = np.argsort(group, kind="stable")
    part = group[order]
    prefix = np.where(np.diff(part, prepend=part[:1] - 1) != 0, -1, wide)
    part = np.cumsum(prefix < 0)
    for d in range(shallow):
        open_ = np.flatnonzero((np.diff(part, prepend=-1) == 0) | (np.diff(part, append=part[-1:] + 1) == 0))
        if not len(open_):
            break
        own = order[open_]
        key = data[own, d]
        by = np.lexsort((key, part[open_]))
        own, key = own[by], key[by]
        order[open_] = own
        same = np.diff(part[open_], prepend=-1) == 0
        x = np.insert(key[1:] ^ key[:-1], 0, 0)
        new = same & (x != 0)
        prefix[open_[new]] = 8 * d + sum((x[new] < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
        part = np.cumsum(prefix < 8 * (d + 1))
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    lengths = np.diff(np.append(starts, n))
    for a, m in zip(starts[lengths > 1].tolist(), lengths[lengths > 1].tolist(), strict=True):
        own, shared = blind_trie(strings, order[a : a + m].tolist())
        order[a : a + m] = own
        prefix[a + 1 : a + m] = shared[1:]
    # padding is no part of a string: what two share ends with the shorter one
    prefix[1:] = np.minimum(prefix[1:], np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    return order, prefix


def equal_windows(width: int):
    """The solver: for each context with repeated windows the span from the first to the last of them."""

    def solve(shard: np.ndarray, t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, before, low, high = (t[c].to_numpy().astype(np.int64) for c in ("place", "before", "low", "high"))
        most, least = distances(shard, t["context"].to_pylist(), before, low, high)
        hit = np.flatnonzero(most >= 0)
        return hit, (place - most)[hit], (place - least + width)[hit]

    def distances(shard: np.ndarray, contexts: list[bytes], before: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest and least distance of a repeated window's start before the anchor, -1 if there is none."""
        n = len(contexts)
        most, least = np.full(n, -1), np.full(n, -1)
        ahead = [c[b:] for c, b in zip(contexts, before.tolist(), strict=True)]
        behind = [c[:b][::-1] for c, b in zip(contexts, before.tolist(), strict=True)]
        after = np.fromiter(map(len, ahead), dtype=np.int64, count=n)
        order_a, prefix_a = deep_shallow(ahead, shard)
        order_b, prefix_b = deep_shallow(behind, shard)

        def best(order: np.ndarray, prefix: np.ndarray) -> np.ndarray:
            out = np.empty(n, dtype=np.int64)
            out[order] = np.maximum(prefix, np.append(prefix[1:], -1))
            return out

        may = np.flatnonzero(best(order_a, prefix_a) + best(order_b, prefix_b) >= width)
        if not len(may):
            return most, least
        class_a, class_b = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        for d in range(int(low[may].min()), int(min(high[may].max(), before[may].max())) + 1):
            own = may[(low[may] <= d) & (high[may] >= d) & (before[may] >= d) & (after[may] >= width - d)]
            if len(own) < 2:
                continue
            class_a[order_a] = np.cumsum(prefix_a < width - d)
            class_b[order_b] = np.cumsum(prefix_b < d)
            key = class_a[own] * (n + 1) + class_b[own]
            by = np.argsort(key, kind="stable")
            same = np.diff(key[by]) == 0
            hit = own[by[np.append(same, False) | np.insert(same, 0, False)]]
            most[hit] = d
            least[hit] = np.where(least[hit] < 0, d, least[hit])
        return most, least

    return solve


UNITS = Units(byte_chunks, lambda t: t, len, lambda t, a, b: t[a:b], byte_slices)


def job(width: int = WIDTH, gram: int = GRAM) -> Job:
    return Job(UNITS, width, gram, equal_windows(width))


def stripping(width: int, gram: int):
    def strip(text: bytes, copies: int, spans: list[int] | None) -> tuple[int, int, int, str]:
        own = [(0, len(text))] if copies > 1 and len(text) >= width else merged(spans or [], text, gram, width)
        kept, at = hashlib.sha256(), 0
        for a, b in own:
            kept.update(text[at:a])
            at = b
        kept.update(text[at:])
        return len(text), sum(b - a for a, b in own), len(own), kept.hexdigest()

    return strip


def strip_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of ``docs``.

    Each UTF-8 byte covered by a string of ``width`` bytes that also starts anywhere else, in any
    row or the same one, is removed; matches don't cross rows. Null texts are empty. Very long texts
    are read whole, a chunk at a time, and periodic stretches cost no more than others. Ids may be
    null or repeat; rows that repeat a text are copies of each other, so that texts of at least
    ``width`` bytes lose everything. Other columns are ignored. An empty table gives none.
    """
    return without_repeats(docs, job(width, gram), stripping(width, gram), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", **options)
