"""Random spanning trees and tree sums of graphs that no single task has to hold.

The samplers and determinants of ``trees`` work on one matrix in one task. Here a graph is an edge
relation throughout: trees come by popping cycles, sums of trees by eliminating blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.portable import PRIME, mixed, uniform
from arbora.operators.components import connected
from arbora.operators.graph import laplacian_minor, symmetrize
from arbora.operators.joins import looked_up
from arbora.operators.trees import logs
from arbora.session import cut

#: Parts that the edges of one vertex are dealt to, and exits of vertices up to which one task finds cycles.
PARTS, LOCAL = 32, 1 << 16
#: Exits that each vertex draws at once where one task pops the cycles.
AHEAD = 16
#: Rows and columns of a block of a matrix, and bytes of blocks that go to Python together.
BLOCK, BATCH = 256, 16 << 20


def waiting(u: Column, v: Column, pops: Column, log_weight: Column, seed: int) -> Column:
    """ln of the time until edge (u, v) rings at the draw of u after ``pops`` others: the first of u's edges is its exit.

    Times are exponential at the rate of the weight, so each edge is the first with a probability
    proportional to it. Nothing is summed over a vertex's edges, and weights of any size will do.
    """
    # mixed twice at the end: three keys in a row give numbers of which two tell the third
    ring = mixed(mixed(v + mixed(u + mixed(pops, seed), seed + 1), seed + 2), seed + 4)
    return F.ln(-F.ln((ring + 1) / F.lit(PRIME + 1.0))) - log_weight


def exits(vertices: DataFrame, edges: DataFrame, n: int, seed: int, most: int) -> DataFrame:
    """v, pops, nxt: the exit that each of ``vertices`` (v, pops) draws; uniform after ``most`` draws, or without edges."""
    dealt = vertices.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    drawn = edges.join(dealt, (F.col("u") == F.col("v")) & (F.col("__part") == F.col("part"))).where(F.col("pops") < most)
    first = drawn.groupBy("v", "pops").agg(F.min(F.struct(waiting(F.col("u"), F.col("to"), F.col("pops"), F.col("weight"), seed).alias("at"), "to")).alias("first"))
    other = F.floor(uniform(F.col("v") + mixed(F.col("pops"), seed), seed + 3) * (n - 1))
    other = F.least(other, F.lit(n - 2)) + (F.least(other, F.lit(n - 2)) >= F.col("v")).cast("long")
    return vertices.join(first.select("v", "pops", F.col("first.to").alias("to")), ["v", "pops"], "left").select("v", "pops", F.coalesce("to", other).alias("nxt"))


def cycles(to: dict[int, int]) -> list[int]:
    """Vertices that their exits lead back to."""
    known, out = set(), []
    for v in to:
        path = {}
        while v in to and v not in known and v not in path:
            path[v] = len(path)
            v = to[v]
        if v in path:
            out += [x for x, k in path.items() if k >= path[v]]
        known.update(path)
    return out


def _cycles_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vertices on cycles of exits (v, nxt), at most LOCAL of them."""
    to: dict[int, int] = {}
    for b in batches:
        to.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(cycles(to), pa.int64())], ["v"])


def _popped_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, pops, nxt, short of at most LOCAL vertices with their next draws (v, pops, nxt): cycles are popped until there are none, or a vertex runs short of draws."""
    drawn: dict[int, list[tuple[int, int]]] = {}
    for b in batches:
        for v, pops, nxt in zip(*(b.column(c).to_pylist() for c in ("v", "pops", "nxt")), strict=True):
            drawn.setdefault(v, []).append((pops, nxt))
    for x in drawn.values():
        x.sort(reverse=True)
    while all(drawn.values()) and (loops := cycles({v: x[-1][1] for v, x in drawn.items()})):
        last = {v: drawn[v].pop()[0] for v in loops}
    rows = [(v, *x[-1], False) if x else (v, last[v] + 1, -1, True) for v, x in drawn.items()]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["v", "pops", "nxt", "short"])


def on_cycles(exit_of: DataFrame, n: int, root: int, local: int = LOCAL) -> DataFrame:
    """v of the vertices that their exits (v, nxt), a table or checkpoint, lead back to.

    Every vertex jumps twice as far in each round, so after log2(n) rounds those that have not come to the
    root stand on cycles, all places of which are stood on. Vertices that come to the root leave.
    """
    jumps = exit_of.select("v", "nxt").where(F.col("nxt") != root)
    for _ in range(n.bit_length()):
        if jumps.count() <= local:
            return jumps.coalesce(1).mapInArrow(_cycles_here, "v long")
        jumps = cut(looked_up(jumps.withColumnRenamed("nxt", "at"), "at", jumps.withColumnRenamed("v", "to"), "to").select("v", "nxt"))
    return cut(jumps.select(F.col("nxt").alias("v")).distinct())


def popped_tree(w: DataFrame, n: int, seed: int, root: int = 0, most: int | None = None, local: int = LOCAL) -> DataFrame:
    """i, j: a spanning tree with probability proportional to the product of its weights, by popping cycles.

    ``w`` has i, j and log_weight, or weight; vertices are 0..n-1. Every vertex but the root draws an exit. Where
    exits close a cycle all of its vertices draw anew, and what is left without cycles is the tree: its law
    doesn't depend on the order in which cycles are popped, so all go at once. After ``most`` draws (2 * n * n) a
    vertex goes anywhere, uniformly, as one without edges does at once. A round is a few joins, cut by checkpoint(). Up to
    ``local`` vertices draw AHEAD exits each at a time, and one task pops their cycles, with the same result.
    """
    most = 2 * n * n if most is None else most
    both = symmetrize(logs(w).where(F.col("weight") > float("-inf")).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "weight"))
    edges = cut(both.select("u", F.col("v").alias("to"), "weight", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int").alias("__part")))
    fresh = w.sparkSession.range(n).where(F.col("id") != root).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("pops"))
    done = lambda x: x.select(F.least("v", "nxt").cast("int").alias("i"), F.greatest("v", "nxt").cast("int").alias("j"))
    while n <= local:
        ahead = fresh.withColumn("pops", F.explode(F.sequence(F.col("pops"), F.col("pops") + AHEAD - 1)))
        state = cut(exits(ahead, edges, n, seed, most).repartition(1).mapInArrow(_popped_here, "v long, pops long, nxt long, short boolean"))
        if state.where("short").isEmpty():
            return done(state)
        fresh = state.select("v", "pops")
    state = cut(exits(fresh, edges, n, seed, most))
    while True:
        popped = on_cycles(state, n, root, local)
        if popped.isEmpty():
            return done(state)
        again = state.join(popped, "v", "left_semi").select("v", (F.col("pops") + 1).alias("pops"))
        state = cut(state.join(popped, "v", "left_anti").unionByName(exits(again, edges, n, seed, most)))


def _square(data: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(data.values, dtype=float).reshape(rows, -1)


def _blocks_to_python(df: DataFrame) -> DataFrame:
    """The session's Arrow batches end at BATCH bytes, unless they are smaller already."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(key)).rstrip("b")
    if not now.isdigit() or int(now) > BATCH:
        conf.set(key, f"{BATCH}b")
    return df


def blocks_of(cells: DataFrame, n: int, block: int) -> DataFrame:
    """bi, bj, data: a dense matrix of n rows from its cells (u, v, value), in blocks row by row."""
    m = -(-n // block)
    size = lambda b: min(block, n - b * block)

    def filled(table: pa.Table) -> pa.Table:
        bi, bj = table["bi"][0].as_py(), table["bj"][0].as_py()
        x = np.zeros((size(bi), size(bj)))
        np.add.at(x, (table["r"].to_numpy(), table["c"].to_numpy()), table["value"].to_numpy())
        return pa.table([pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([x.ravel()], pa.list_(pa.float64()))], names=["bi", "bj", "data"])

    at = lambda c, name: (F.floor(F.col(c) / block).cast("int").alias(f"b{name}"), (F.col(c) % block).cast("int").alias("r" if name == "i" else "c"))
    own = cells.select(*at("u", "i"), *at("v", "j"), F.col("value").cast("double").alias("value"))
    every = cells.sparkSession.range(m * m).select(F.floor(F.col("id") / m).cast("int").alias("bi"), F.lit(0).alias("r"), (F.col("id") % m).cast("int").alias("bj"), F.lit(0).alias("c"), F.lit(0.0).alias("value"))
    return own.unionByName(every).groupBy("bi", "bj").applyInArrow(filled, "bi int, bj int, data array<double>")


def log_determinant(cells: DataFrame, n: int, block: int = BLOCK) -> float:
    """ln of the determinant of a positive definite matrix of n rows, given by its cells (u, v, value).

    Blocks are eliminated in turn. The pivot block, of bounded size, goes to all tasks; each other block
    meets the one of its row and the one of its column and loses their product. A task holds four blocks.
    """
    state, total = cut(blocks_of(cells, n, block)), 0.0
    for k in range(-(-n // block)):
        size = min(block, n - k * block)

        def inverted(batches: Iterator[pa.RecordBatch], size: int = size) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    x = _square(b.column("data")[i], size)
                    sign, value = np.linalg.slogdet(x)
                    inverse = np.linalg.inv(x) if sign > 0 else np.zeros_like(x)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([inverse.ravel()], pa.list_(pa.float64())), pa.array([float(value) if sign > 0 else -np.inf])], ["k", "inverse", "value"])

        def reduced(batches: Iterator[pa.RecordBatch], size: int = size) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    cell = lambda name: b.column(name)[row]  # noqa: B023, E731
                    left = _square(cell("lower"), len(cell("lower").values) // size)
                    x = _square(cell("data"), len(left)) - left @ _square(cell("inverse"), size) @ _square(cell("upper"), size)
                    yield pa.RecordBatch.from_arrays([pa.array([cell("bi").as_py()], pa.int32()), pa.array([cell("bj").as_py()], pa.int32()), pa.array([x.ravel()], pa.list_(pa.float64()))], ["bi", "bj", "data"])

        pivot = cut(_blocks_to_python(state.where((F.col("bi") == k) & (F.col("bj") == k))).select("data").mapInArrow(inverted, "k int, inverse array<double>, value double"))
        total += pivot.select("value").first()[0]
        if total == float("-inf"):
            return total
        lower = state.where((F.col("bj") == k) & (F.col("bi") > k)).select("bi", F.col("data").alias("lower"))
        upper = state.where((F.col("bi") == k) & (F.col("bj") > k)).select("bj", F.col("data").alias("upper"))
        rest = state.where((F.col("bi") > k) & (F.col("bj") > k)).withColumn("k", F.lit(k))
        met = rest.join(lower, "bi").join(upper, "bj").join(F.broadcast(pivot.drop("value")), "k")
        state = cut(met.mapInArrow(reduced, "bi int, bj int, data array<double>"))
    return total


def log_partition(w: DataFrame, n: int, root: int = 0, floor: float = 0.0, block: int = BLOCK) -> DataFrame:
    """log_z: ln of the sum over spanning trees of the products of their weights, for a graph of any size.

    ``w`` has i, j and log_weight, or weight; vertices are 0..n-1. Weights are taken relative to the largest. Without
    any tree the result is minus infinity, or that of the minor with ``floor`` added to its diagonal.
    """
    edges = cut(logs(w).where(F.col("weight") > float("-inf")).select("i", "j", "weight"))
    top = edges.agg(F.max("weight")).first()[0]
    labels = connected(edges.select(F.col("i").cast("long").alias("a"), F.col("j").cast("long").alias("b")))
    whole = n == 1 or tuple(labels.agg(F.count("*"), F.countDistinct("label")).first()) == (n, 1)
    if not whole and not floor:
        return w.sparkSession.createDataFrame([(float("-inf"),)], "log_z double")
    top = 0.0 if top is None else top
    place = lambda c: F.when(F.col(c) > root, F.col(c) - 1).otherwise(F.col(c))
    cells = laplacian_minor(edges.withColumn("weight", F.exp(F.col("weight") - top)), root).select(place("u").alias("u"), place("v").alias("v"), "value")
    if not whole:
        ground = w.sparkSession.range(n - 1).select(F.col("id").cast("int").alias("u"), F.col("id").cast("int").alias("v"), (F.lit(floor) * F.exp(F.lit(-top))).alias("value"))
        cells = cells.unionByName(ground)
    value = log_determinant(cells, n - 1, block) + (n - 1) * top if n > 1 else 0.0
    return w.sparkSession.createDataFrame([(float(value),)], "log_z double")
