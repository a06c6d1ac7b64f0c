"""Near-duplicate documents by wide SimHash fingerprints, candidates confirmed on their words.

Two texts whose sets of ``shingle``-word shingles have a Jaccard similarity of 0.8 or more differ
in about 15 % of the fingerprint's bits, too many for blocks that must agree exactly. So several
tables each deal the fingerprints by a random choice of bits, as many tables as a pair at the
threshold needs to meet in one of them with the probability asked for. Where they meet, a BK-tree
finds the pairs within the radius, and a minimum spanning forest of them gives links. What links
connect is a crowd: all pairs that meet within the radius lie in one. A crowd's texts come to one
task, which compares all pairs within the radius and joins the groups of a similar pair at once, so
that no pair within a group is looked at again and no pair is a row.

A crowd that is too large for that has its links confirmed first. Then it is cut to parts by its rare
shingles: of a text's shingles in one order, the rarest in the crowd first, two similar texts share one
at places that leave enough shingles behind for their similarity. Texts that can't be similar to
another one by that drop out, so a crowd around a template costs in proportion to its texts. Parts that are still
too large are dealt to blocks, of which each two meet, and a large group doesn't meet itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import cut, for_python, join_by_size, join_spread, small_enough, text_of, written
from arbora.llm.components import components
from arbora.llm.simhash import fingerprint, shingle_hashes, spanning

#: Words of a shingle, Jaccard similarity of near duplicates, and the probability that a pair at
#: that similarity meets in a table.
SHINGLE, SIMILARITY, MEETING = 5, 0.8, 0.99
#: 64-bit lanes of a fingerprint; bits that deal it at least; members of a shard that are compared.
LANES, KEY_BITS, SHARD = 8, 14, 512
#: Nodes up to which a list of them is broadcast: 8 bytes each.
BROADCAST_NODES = 1_000_000
#: Tables in which overfull keys are dealt at random.
FIRST = 6
#: Members of an overfull key's block; two of them are held at a time.
BLOCK = 4096
#: Bytes of texts in a block of a crowd, each counted as so many more for the time that it takes.
TEXT_BLOCK, TEXT_BYTES = 1 << 22, 1 << 12
#: What the size that a place allows may be off by rounding.
SLACK = 1e-6


def differing(similarity: float) -> float:
    """Share of bits in which fingerprints of two sets of equal size differ, by their Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables(n: int, similarity: float = SIMILARITY, meeting: float = MEETING, lanes: int = LANES) -> np.ndarray:
    """Bits of the fingerprint that each table deals by; more bits, and more tables, for more rows.

    There are as many as a pair needs that differs in one standard deviation more bits than is usual.
    """
    p = differing(similarity)
    p += math.sqrt(p * (1 - p) / (64 * lanes))
    bits = max(KEY_BITS, math.ceil(math.log2(max(n, 1) + 1)) - 8)
    number = math.ceil(math.log(1 - meeting) / math.log(1 - (1 - p) ** bits))
    rng = np.random.default_rng(17)
    return np.stack([np.sort(rng.choice(64 * lanes, bits, replace=False)) for _ in range(number)])


def radius(similarity: float = SIMILARITY, lanes: int = LANES) -> int:
    """Differing bits up to which a pair is looked at: three standard deviations over the mean."""
    p, bits = differing(similarity), 64 * lanes
    return math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


def wide_fingerprints(docs: DataFrame, shingle: int, lanes: int, text_col: str = "text") -> DataFrame:
    """node (the text's hash), fp: one row per row of ``docs`` with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x.as_py(), shingle, lanes, repeats=False) for x in b.column(1)], pa.binary())], ["node", "fp"])

    rows = docs.select(node_of(text_col).alias("node"), text_of(text_col).cast("binary").alias("text"))
    return for_python(rows).mapInArrow(run, "node long, fp binary").where(F.col("fp") != F.lit(bytes(8 * lanes)))


def node_of(text_col: str = "text"):
    return F.xxhash64(text_of(text_col))


def dealt(fps: DataFrame, picks: np.ndarray) -> DataFrame:
    """node, fp, key, and other columns of ``fps`` before key: each fingerprint once for each table."""
    weights = 1 << np.arange(picks.shape[1], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp = b.column(0), b.column(1)
            if not len(node):
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(fp.to_pylist()), dtype=np.uint8).reshape(len(fp), -1), axis=1)
            for k, pick in enumerate(picks):
                key = bits[:, pick].astype(np.int64) @ weights + (k << 40)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], [*b.schema.names, "key"])

    return fps.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*fps.dtypes, ("key", "bigint")]))


def forests(most: int):
    """Links of each (key, part) in sorted rows; one part is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, values = None, [], []
        out: list[tuple[int, int]] = []

        def solve() -> None:
            if len(values) > 1:
                out.extend((nodes[a], nodes[b]) for a, b in spanning(values, most))

        for b in batches:
            for key, part, node, fp in zip(*(b.column(c).to_pylist() for c in ("key", "part", "node", "fp")), strict=True):
                if (key, part) != now:
                    solve()
                    now, nodes, values = (key, part), [], []
                nodes.append(node)
                values.append(int.from_bytes(fp))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out.clear()
        solve()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def candidates(fps: DataFrame, similarity: float = SIMILARITY, lanes: int = LANES, shard: int = SHARD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) whose components are those of all pairs within the radius that meet in a table,
    and those components, the crowds (node, label); both cut from their lineage.

    A key with more than ``shard`` members is first dealt to parts at random, in FIRST tables: of a
    large group of near copies each member meets ``shard`` others in each, and its crowd holds
    together through any of them. Then all members of such a key, in any table, that are not in
    one crowd by that meet, in blocks of ``block`` by ``block``.
    """
    picks, most = tables(fps.count(), similarity, lanes=lanes), radius(similarity, lanes)
    rows = dealt(fps, picks)
    large = overfull(rows, shard)
    spread = rows.join(small_enough(large, BROADCAST_NODES), F.col("key") == F.col("__key"), "left").where(F.col("parts").isNull() | (F.shiftright("key", 40) < FIRST))
    spread = spread.select("key", F.coalesce(F.pmod(F.xxhash64("key", "node"), F.col("parts")), F.lit(0)).alias("part"), "node", "fp")
    links = spread.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(forests(most), "a long, b long")
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    crowds = cut(components(links))
    if large.isEmpty():
        return links, crowds
    named = fps.join(small_enough(crowds, BROADCAST_NODES), "node", "left").select("node", "fp", F.coalesce("label", "node").alias("label"))
    keys = small_enough(large.select(F.col("__key").alias("key")), BROADCAST_NODES)
    members = dealt(cut(named), picks).join(keys, "key").withColumn("weight", F.lit(1))
    more = cut(met(members, block).mapInArrow(across(most), "a long, b long"))
    if more.isEmpty():
        return links, crowds
    return links.unionByName(more), cut(components(stars(crowds).unionByName(more)))


def stars(groups: DataFrame) -> DataFrame:
    """a, b: links that give the same components in fewer rounds than those they came from."""
    return groups.select(F.col("node").alias("a"), F.col("label").alias("b"))


def tiles(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], make=None) -> Iterator[tuple[list, ...]]:
    """The columns of each (key, part) in sorted rows, the last of them through ``make``."""
    now, held = None, tuple([] for _ in columns)
    for b in batches:
        for key, part, *row in zip(*(b.column(c).to_pylist() for c in ("key", "part")), *(b.column(c) for c in columns), strict=True):
            if (key, part) != now:
                if now is not None:
                    yield held
                now, held = (key, part), tuple([] for _ in columns)
            for column, x in zip(held, row, strict=True):
                column.append(x.as_py())
            if make:
                held[-1][-1] = make(held[-1][-1])
    if now is not None:
        yield held


def bits_of(fps: list[bytes]) -> np.ndarray:
    """A row for each 64 bits of the fingerprints, a column for each fingerprint."""
    return np.ascontiguousarray(np.frombuffer(b"".join(fps), dtype=np.uint64).reshape(len(fps), -1).T)


def apart(lanes: np.ndarray, label: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places behind ``k`` of another label within ``most`` bits, and their differing bits."""
    other = np.flatnonzero(label[k + 1 :] != label[k]) + k + 1
    bits = np.bitwise_count(lanes[:, other] ^ lanes[:, k : k + 1]).sum(axis=0, dtype=np.uint16)
    return other[bits <= most], bits[bits <= most]


def links_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["a", "b"])


def joined_to(k: int, near: np.ndarray, label: np.ndarray) -> list[int]:
    """One place of each label of ``near``; from now on those labels are that of ``k``."""
    others, first = np.unique(label[near], return_index=True)
    label[np.isin(label, others)] = label[k]
    return near[first].tolist()


def across(most: int):
    """Links that join the labels of each (key, part) as all its pairs within ``most`` bits would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, labels, fps in tiles(batches, ("node", "label", "fp")):
            if len(set(labels)) < 2:
                continue
            lanes, label, found = bits_of(fps), np.array(labels, dtype=np.int64), []
            for k in range(len(nodes) - 1):
                near, _ = apart(lanes, label, k, most)
                found += [(nodes[k], nodes[j]) for j in joined_to(k, near, label)]
            yield links_of(found)

    return run


def overlapping(most: int):
    """The same for pairs that also allow each other's size by their ``reach``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, labels, sizes, reaches, fps in tiles(batches, ("node", "label", "size", "reach", "fp")):
            if len(set(labels)) < 2:
                continue
            lanes, label, found = bits_of(fps), np.array(labels, dtype=np.int64), []
            size, reach = np.array(sizes), np.array(reaches)
            for k in range(len(nodes) - 1):
                near, _ = apart(lanes, label, k, most)
                near = near[(size[near] <= reach[k]) & (reach[near] >= size[k])]
                found += [(nodes[k], nodes[j]) for j in joined_to(k, near, label)]
            yield links_of(found)

    return run


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def joining(most: int, shingle: int, similarity: float):
    """Links that join the labels of each (key, part) as all its similar pairs would.

    The nearest pairs of two labels come first; once one is similar, its labels are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, labels, fps, sets in tiles(batches, ("node", "label", "fp", "text"), lambda text: np.unique(shingle_hashes(text, shingle))):
            lanes, label, found = bits_of(fps), np.array(labels, dtype=np.int64), []
            size = np.array([len(x) for x in sets])
            for k in range(len(nodes) - 1):
                near, bits = apart(lanes, label, k, most)
                may = np.minimum(size[near], size[k]) >= similarity * np.maximum(size[near], size[k])
                near = near[may][np.argsort(bits[may], kind="stable")]
                while len(near):
                    j, near = near[0], near[1:]
                    if similar(sets[k], sets[j], similarity):
                        found.append((nodes[k], nodes[j]))
                        label[label == label[j]] = label[k]
                        near = near[label[near] != label[k]]
            yield links_of(found)

    return run


def overfull(rows: DataFrame, shard: int) -> DataFrame:
    """__key, parts: the keys of ``rows`` with more than ``shard`` members."""
    return cut(rows.groupBy("key").count().where(F.col("count") > shard).select(F.col("key").alias("__key"), F.ceil(F.col("count") / shard).alias("parts")))


def met(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (key, label, node, weight and others), dealt and sorted by key and part: once for
    each two blocks of a key that have to meet, a block being rows of about ``block`` in weight.

    A label of more than a block in a key has blocks of its own, which don't meet one another; the
    others share blocks, of which each meets itself and all. Keys of one label are left out.
    """
    sizes = cut(rows.groupBy("key", "label").agg(F.sum("weight").alias("n")))
    own = F.col("n") > block
    zones = sizes.select("key", "label", F.when(own, F.col("label")).alias("zone"), "n").groupBy("key", "zone").agg(F.sum("n").alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
    keys = zones.groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("key")
    zones = cut(zones.join(keys, "key").select("key", "zone", F.ceil(F.col("n") / block).alias("pieces")))
    at = F.struct(F.col("zone").isNull().alias("mixed"), F.coalesce("zone", F.lit(0)).alias("zone"), "piece").alias("at")
    blocks = cut(zones.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).select("key", at))
    two = blocks.withColumnRenamed("at", "x").join(blocks.withColumnRenamed("at", "y"), "key").where("x <= y and (x.mixed or y.mixed or x.zone <> y.zone)")
    two = cut(two.withColumn("part", F.monotonically_increasing_id() + 1))
    ends = two.select("key", "part", F.explode(F.array_distinct(F.array("x", "y"))).alias("at"))
    named = rows.join(small_enough(sizes.where(own).select("key", "label", F.lit(True).alias("own")), BROADCAST_NODES), ["key", "label"], "left")
    named = named.withColumn("zone", F.when(F.col("own"), F.col("label"))).drop("own")
    zones = zones.select(F.col("key").alias("__key"), F.col("zone").alias("__zone"), "pieces")
    placed = named.join(small_enough(zones, BROADCAST_NODES), (F.col("key") == F.col("__key")) & F.col("zone").eqNullSafe(F.col("__zone")))
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("key", "node"), F.col("pieces"))).select(*rows.columns, at)
    return placed.join(small_enough(ends, BROADCAST_NODES), ["key", "at"]).drop("at").repartition("key", "part").sortWithinPartitions("key", "part")


def crowded(crowds: DataFrame, fps: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key, node, fp, text, weight: the members of crowds (node, label), each text once."""
    texts = docs.select(node_of(text_col).alias("node"), text_of(text_col).cast("binary").alias("text")).join(small_enough(crowds, BROADCAST_NODES), "node")
    texts = texts.groupBy("node", F.col("label").alias("key")).agg(F.first("text").alias("text"))
    return texts.join(fps, "node").select("key", "node", "fp", "text", (F.octet_length("text") + TEXT_BYTES).alias("weight"))


def joined(members: DataFrame, groups: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, lanes: int = LANES, block: int = TEXT_BLOCK) -> DataFrame:
    """a, b: links between the groups of each crowd's members; a node in none is a group of its own."""
    named = members.join(small_enough(groups, BROADCAST_NODES), "node", "left").withColumn("label", F.coalesce("label", "node"))
    return for_python(met(named, block)).mapInArrow(joining(radius(similarity, lanes), shingle, similarity), "a long, b long")


def shingle_rows(named: DataFrame, shingle: int) -> DataFrame:
    """key, node, label, size, h: a row for the hash of each different shingle of each text, of which it has ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), shingle)) for x in b.column("text")]
            size = np.array([len(x) for x in sets], dtype=np.int64)
            if size.sum():
                ids = [np.repeat(b.column(c).to_numpy(zero_copy_only=False), size) for c in ("key", "node", "label")]
                columns = [*ids, np.repeat(size, size), np.concatenate(sets).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "label", "size", "h"])

    return for_python(named.select("key", "node", "label", "text")).mapInArrow(run, "key long, node long, label long, size long, h long")


def meeting_lists(named: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """key (of a list), node, label, size, reach: texts that share a shingle of a crowd at a place where they may be similar.

    A text's shingles come in the order of (texts of the crowd that have it, hash). Of texts of a and b shingles,
    at least similarity / (1 + similarity) * (a + b) are common if they are similar. From the first common one on,
    both have that many left, so with p shingles before it the first text allows the second at most ``reach`` =
    (a - p) * (1 + similarity) / similarity - a of them, and the second one the first. Shingles that no other text has take
    the first places but are no rows. Lists of one label, and those where no text is allowed a partner of its own
    size or more, hold no such pair.
    """
    rows = written(shingle_rows(named, shingle))
    often = written(rows.groupBy("key", "h").agg(F.count("*").alias("texts")).where("texts > 1"))
    text = Window.partitionBy("key", "node")
    shared = join_spread(rows, often, ["key", "h"], "texts", ["node"])
    place = F.col("size") - F.count("*").over(text) + F.row_number().over(text.orderBy("texts", "h")) - 1
    reach = (F.col("size") - F.col("place")) * ((1 + similarity) / similarity) - F.col("size") + SLACK
    placed = shared.withColumn("place", place).select(F.xxhash64("key", "h").alias("list"), "node", "label", "size", reach.alias("reach"))
    placed = written(placed.where(F.col("reach") >= similarity * F.col("size")))
    lists = placed.groupBy("list").agg(F.count("*").alias("rows"), F.min("label").alias("a"), F.max("label").alias("b"), F.max(F.col("reach") >= F.col("size")).alias("may"))
    lists = written(lists.where("a <> b and may").select("list", "rows"))
    return join_spread(placed, lists, ["list"], "rows", ["node"]).drop("rows").withColumnRenamed("list", "key")


def finer(members: DataFrame, large: DataFrame, groups: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, lanes: int = LANES, block: int = BLOCK) -> DataFrame:
    """``members`` with the crowds of ``large`` (key) cut to the parts that rare shingles leave together.

    All pairs that ``joined`` looks for lie in one part; texts of no such pair are left out. ``groups`` (node, label) are
    the groups found before, which stay together.
    """
    inside = members.join(small_enough(large, BROADCAST_NODES), "key")
    named = inside.join(small_enough(groups, BROADCAST_NODES), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = cut(named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key"))
    lists = meeting_lists(named.join(small_enough(mixed, BROADCAST_NODES), "key"), shingle, similarity)
    lists = lists.join(members.select("node", "fp"), "node").withColumn("weight", F.lit(1))
    links = cut(met(lists, block).mapInArrow(overlapping(radius(similarity, lanes)), "a long, b long").distinct())
    parts = cut(components(stars(groups).unionByName(links)))
    again = inside.drop("key").join(small_enough(parts, BROADCAST_NODES), "node").withColumnRenamed("label", "key")
    return members.join(small_enough(large, BROADCAST_NODES), "key", "left_anti").unionByName(again)


def shingle_set(text: str, shingle: int) -> set:
    words = text.encode().lower().split()
    return set(zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else {tuple(words)}


def confirmed(links: DataFrame, members: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The links whose texts, of ``members`` (node, text), have that Jaccard similarity."""
    both = links.join(members.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(members.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, last, own = [], None, set()
            for x, y in zip(b.column(2), b.column(3), strict=True):
                if (x := x.as_py().decode()) != last:
                    last, own = x, shingle_set(x, shingle)
                other = shingle_set(y.as_py().decode(), shingle)
                keep.append(len(own & other) >= similarity * len(own | other))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return for_python(both.select("a", "b", "ta", "tb")).mapInArrow(run, "a long, b long")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, lanes: int = LANES, shard: int = SHARD, block: int = BLOCK, text_block: int = TEXT_BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the one of the smallest doc_id.

    Null ids come last, then the smaller text hash decides. Texts without words are near to none
    and all stay; rows with equal texts share a fate (exact dedup tells them apart). Very long
    texts are read whole. All columns are kept as they are. An empty table gives none.
    """
    fps = cut(wide_fingerprints(docs, shingle, lanes).distinct())
    links, crowds = candidates(fps, similarity, lanes, shard, block)
    members = written(crowded(crowds, fps, docs))
    large = cut(members.groupBy("key").agg(F.sum("weight").alias("n")).where(F.col("n") > text_block).select("key"))
    groups = crowds.limit(0)
    if not large.isEmpty():
        inside = crowds.join(small_enough(large, BROADCAST_NODES), F.col("label") == F.col("key")).select(F.col("node").alias("a"))
        groups = cut(components(confirmed(links.join(inside, "a"), members, shingle, similarity)))
        members = finer(members, large, groups, shingle, similarity, lanes, block)
    groups = cut(components(stars(groups).unionByName(joined(members, groups, shingle, similarity, lanes, text_block))))
    ids = docs.select(node_of().alias("node"), F.col("doc_id").alias("id"), F.col("doc_id").isNull().alias("no_id")).join(groups, "node")
    best = ids.groupBy("label").agg(F.min(F.struct("no_id", "id", "node")).getField("node").alias("best"))
    best = cut(best.join(groups.groupBy("label").agg(F.count("*").alias("members")), "label"))
    gone = cut(join_by_size(groups, best, ["label"], "members").where("node <> best").select(F.col("node").alias("__gone")))
    return docs.join(small_enough(gone, BROADCAST_NODES), node_of() == F.col("__gone"), "left_anti").select(*docs.columns)
