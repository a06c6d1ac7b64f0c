"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees.

Two fingerprints within ``radius`` bits agree on one of ``radius + 1`` blocks of bits, so the
fingerprints are dealt to shards by the value of each block. Each shard's members form a BK-tree
(children keyed by their integer Hamming distance to the parent), and each member asks the tree
for its neighbours, following only edges that the radius allows. A shard that is too large is
dealt again by blocks of the bits that its members may still differ in, until it is small: no
neighbour is lost, and the number of different fingerprints that share all but a few bits is
bounded. A shard returns links that span its groups, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import cut, for_python, join_by_size, text_of
from arbora.llm.components import components

BITS = 64
#: Seed of XXH64.
SEED = 42
#: Differing bits up to which fingerprints are linked, and words in a shingle.
RADIUS, SHINGLE = 2, 3
#: Members of a shard beyond which it is dealt again.
SHARD = 512
#: Shingles that are counted at once.
BLOCK = 1 << 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text, in order: ``shingle`` words in a row, joined by a space.

    Words are runs other than ASCII white space, A-Z in lower case. A text of fewer words than a
    shingle is one shingle; one without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, hash_ = b" ".join(words), xxhash.xxh64_digest
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    last = min(shingle, len(words)) - 1
    ends = (starts + sizes)[last:]
    starts = starts[: len(ends)]
    spans = (zip(starts[a : a + BLOCK].tolist(), ends[a : a + BLOCK].tolist(), strict=True) for a in range(0, len(ends), BLOCK))
    return np.frombuffer(b"".join([b"".join([hash_(joined[s:e], SEED) for s, e in own]) for own in spans]), dtype=">u8").astype(np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE, lanes: int = 1, repeats: bool = True) -> bytes:
    """8 * ``lanes`` bytes: a bit is 1 if it is set in over half of the shingles' hashes.

    Shingles that repeat count as often as they occur, or once if not ``repeats``. A text without
    words has fingerprint zero. The first lane's hash is the shingle's XXH64; the other lanes'
    hashes are mixed from it, each with a factor of its own.
    """
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return bytes(8 * lanes)
    if not repeats:
        hashes = np.unique(hashes)
    counts = np.zeros((lanes, BITS), dtype=np.int64)
    for a in range(0, len(hashes), BLOCK):
        first = hashes[a : a + BLOCK]
        for lane in range(lanes):
            h = (mixed(first, lane) if lane else first).astype(">u8")
            counts[lane] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), axis=1).tobytes()


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another hash from a 64-bit hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 * (2 * lane + 1) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), text_hash: one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b"".join([fingerprint(x.as_py(), shingle) for x in b.column(2)])
            fps = np.frombuffer(packed, dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), b.column(1)], ["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).cast("binary").alias("text"))
    return for_python(rows).mapInArrow(run, "doc_id long, fp long, text_hash long")


class BKTree:
    """A Burkhard-Keller tree over different fingerprints."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for k in range(1, len(values)):
            at = 0
            while True:
                edge = (values[at] ^ values[k]).bit_count()
                below = self.children[at].setdefault(edge, k)
                if below == k:
                    break
                at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values within ``radius`` bits: only edges that the radius allows."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = self.children[at]
            if len(below) > 2 * radius + 1:
                todo += [below[e] for e in range(d - radius, d + radius + 1) if e in below]
            else:
                todo += [k for e, k in below.items() if -radius <= e - d <= radius]
        return found


def spanning(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Places (a, b) of the links of a minimum spanning forest of all pairs within ``radius``.

    Any two that the pairs connect are connected by links none of which is longer than needed.
    """
    tree, root = BKTree(values), list(range(len(values)))
    near = sorted(((values[k] ^ values[other]).bit_count(), other, k) for k, v in enumerate(values) for other in tree.within(v, radius) if other < k)

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for _, a, b in near:
        x, y = top(a), top(b)
        if x != y:
            root[y] = x
            out.append((a, b))
    return out


def blocks(mask: int, parts: int) -> list[int]:
    """Masks that add to ``mask`` one of ``parts`` blocks of the bits that it lacks."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in bits) for k in range(parts) if (bits := free[k * len(free) // parts : (k + 1) * len(free) // parts])]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Pairs a, b of ``fps`` (fp, all different) whose closure links all within ``radius`` bits."""
    masks, out = [0], None
    members = fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    while True:
        finer = {m: blocks(m, radius + 1) for m in masks}
        options = F.create_map(*(x for m, b in finer.items() for x in (F.lit(signed(m)), F.array(*(F.lit(signed(y)) for y in b)))))
        members = members.withColumn("mask", F.explode(options[F.col("mask")])).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = cut(members.groupBy("mask", "value").count().where("count > 1"))
        masks = sorted({m for b in finer.values() for m in b})
        last = all(BITS - m.bit_count() <= radius + 1 for m in masks)
        small = sizes if last else sizes.where(F.col("count") <= shard)
        found = members.join(small.drop("count"), ["mask", "value"]).repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(_shards(radius), "a long, b long")
        out = found if out is None else out.unionByName(found)
        large = sizes.where(F.col("count") > shard).drop("count")
        if last or large.isEmpty():
            return out
        members = cut(members.join(large, ["mask", "value"]).select("mask", "fp"))


def _shards(radius: int):
    """Reads members sorted by shard; holds one shard of at most SHARD members at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []

        def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            found = [(own[x], own[y]) for part in np.split(fps, edges) for own in [part.view(np.uint64).tolist()] for x, y in spanning(own, radius)]
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "value")], axis=1)
            fps = b.column(b.schema.get_field_index("fp")).to_numpy(zero_copy_only=False)
            if not len(fps):
                continue
            if rest:
                keys, fps = np.concatenate([rest[0], keys]), np.concatenate([rest[1], fps])
            whole = np.flatnonzero((keys != keys[-1]).any(axis=1))
            n = whole[-1] + 1 if len(whole) else 0  # the last shard may go on in the next batch
            if n:
                yield solve(keys[:n], fps[:n])
            rest = [keys[n:], fps[n:]]
        if rest:
            yield solve(*rest)

    return run


def classes(rows: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """fp, label: the fingerprints of ``rows`` that are linked to others, with their component."""
    return components(links(rows.select("fp").distinct(), radius, shard))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of ``docs``.

    The component is that of the fingerprint; its id the smallest doc_id in it (null only if all
    ids are null). Null texts are empty; texts without words share fingerprint zero, which is
    linked like any other. Very long texts are hashed whole, some shingles at a time. Repeated rows repeat in the result. An empty table gives none.
    """
    rows = cut(fingerprints(docs, shingle))
    per = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    linked = cut(classes(per, radius, shard).join(per, F.col("node") == F.col("fp")).select("fp", "label", "least"))
    whole = cut(linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    named = join_by_size(linked, whole, ["label"], "members").select("fp", "component_id")
    ids = cut(per.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "size"))
    out = join_by_size(rows, ids, ["fp"], "size")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
