"""The online learners as stateful streams, keyed by edge.

State per edge is its counts (or log cells) and the last step, whatever the length of the stream.
Steps that lie together go to an edge as one row, and what comes of them can leave as one, so neither sort nor exchange has
a row for each step and pair. Rows of a micro-batch are put in order of time, piece by piece as they come; a step that was
seen before, or one that leaves a gap, is an error: the estimators need every earlier row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from arbora.operators.blocks import pair_ends, pairs_of
from arbora.operators.encode import columns, size
from arbora.operators.weights import constants, factors

#: Steps of an edge that are taken in together.
PIECE = 1 << 14
#: Steps of a row that goes to an edge where they follow each other, and where they don't; steps of a row that leaves. Each is about 1 KB.
FOLLOWING, APART, GRID = 1 << 10, 1 << 7, 1 << 7
#: Rows of an edge that are unpacked at once.
UNPACKED = 1 << 6


def code_type(k: int) -> np.dtype:
    """The smallest type that holds the cells of a pair."""
    return np.min_scalar_type(k * k - 1).newbyteorder("<")


def packed_rows(t: np.ndarray, cells: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """First step, steps and cells of rows that hold the steps ``t``, which are sorted. No steps are given where they follow each other."""
    cuts = np.flatnonzero(np.diff(t) != 1) + 1
    if len(cuts) > len(t) // APART:
        for a in range(0, len(t), APART):
            yield int(t[a]), t[a : a + APART].astype("<i8").tobytes(), cells[a : a + APART].tobytes()
        return
    for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(t)], strict=True):
        for a in range(first, end, FOLLOWING):
            yield int(t[a]), b"", cells[a : min(a + FOLLOWING, end)].tobytes()


def packed_pairs(wide: DataFrame, k: int) -> DataFrame:
    """i, j, t, steps, cells: for each pair rows of many steps that lie together in ``wide``, from the first one ``t`` on.

    A cell is u * k + v. Steps at which one of a pair's values is outside of 0..k-1 are left out.
    """
    n, kind = size(wide), code_type(k)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("t", pa.int64()), ("steps", pa.binary()), ("cells", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            t = rows.column("t").to_numpy()
            order = np.argsort(t, kind="stable")
            t, out = t[order], []
            values = np.stack([rows.column(c).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)[order] for c in columns(n)]).astype(np.int64)
            inside = (values >= 0) & (values < k)
            for i, j in pairs_of(n):
                at = np.flatnonzero(inside[i] & inside[j])
                out += [(i, j, *x) for x in packed_rows(t[at], (values[i, at] * k + values[j, at]).astype(kind))]
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], f.type) for c, f in enumerate(schema)], schema=schema)

        for b in batches:
            if b.num_rows:
                waiting.append(b)
            if sum(x.num_rows for x in waiting) >= PIECE:
                yield packed()
        if waiting:
            yield packed()

    return wide.mapInArrow(pack, "i int, j int, t long, steps binary, cells binary")


def unpacked(frames: Iterable[pd.DataFrame], kind: np.dtype) -> Iterator[pd.DataFrame]:
    """t and cell of each step of an edge's packed rows, UNPACKED rows at a time."""
    for x in frames:
        for a in range(0, len(x), UNPACKED):
            cells = [np.frombuffer(c, dtype=kind) for c in x["cells"].iloc[a : a + UNPACKED]]
            rows = zip(x["t"].iloc[a : a + UNPACKED], x["steps"].iloc[a : a + UNPACKED], cells, strict=True)
            t = [np.frombuffer(steps, dtype="<i8") if steps else np.arange(first, first + len(c)) for first, steps, c in rows]
            yield pd.DataFrame({"t": np.concatenate(t), "cell": np.concatenate(cells)})


def in_order(batches: Iterable[pd.DataFrame], last: int, columns: dict[str, str], piece: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """The steps after ``last`` and ``columns`` (names with types) of an edge's rows, at most ``piece`` in order of time together.

    Rows may come in any order. A piece goes out and is forgotten when its last row is there, so what is held are
    rows that came before earlier ones.
    """
    held: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
    first = 0
    error = lambda t: ValueError(f"steps after {last} must follow each other without gap or repeat, got {t[:5].tolist()}...")
    for x in batches:
        steps = x["t"].to_numpy()
        place = steps - last - 1
        number = place // piece
        for p in np.unique(number).tolist():
            own = number == p
            at = place[own] - p * piece
            if p < first:
                raise error(steps[own])
            if p not in held:
                held[p] = np.zeros(piece, dtype=bool), [np.zeros(piece, dtype=kind) for kind in columns.values()]
            there, values = held[p]
            if there[at].any() or len(np.unique(at)) < len(at):
                raise error(steps[own])
            there[at] = True
            for v, c in zip(values, columns, strict=True):
                v[at] = x[c].to_numpy()[own]
        while first in held and held[first][0].all():
            yield np.arange(piece) + last + 1 + first * piece, *held.pop(first)[1]
            first += 1
    if held:
        there = held[min(held)][0]
        n = int(there.sum())
        if list(held) != [first] or not there[:n].all():
            raise error(last + 1 + min(held) * piece + np.flatnonzero(there))
        yield np.arange(n) + last + 1 + first * piece, *(v[:n] for v in held[first][1])


def losses(t: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln(theta_i * theta_j / theta_ij) at the steps ``t``, for cells u * k + v and the counts (k, k) before; and the counts after."""
    k, at = len(counts), np.arange(len(t))
    hits = np.zeros((len(t), k * k), dtype=np.int64)
    hits[at, cells] = 1
    before = counts.ravel() + np.cumsum(hits, axis=0) - hits  # counts of each cell before each row
    grid = before.reshape(-1, k, k)
    a, b, c = grid[at, cells // k].sum(axis=1), grid[at, :, cells % k].sum(axis=1), before[at, cells]
    one, two = t - 1 + k / 2, t - 1 + k * k / 2
    return np.log(np.maximum((a + 0.5) / one * ((b + 0.5) / one) / ((c + 0.5) / two), 1e-300)), counts + hits.sum(axis=0).reshape(k, k)


def given(key: tuple, t: np.ndarray, name: str, path: np.ndarray, lists: bool) -> pd.DataFrame:
    """t, i, j and ``name`` of an edge's steps, which follow each other, or with ``lists`` of GRID steps a row: the first one and all values."""
    if lists:
        t, path = t[::GRID], [path[a : a + GRID] for a in range(0, len(path), GRID)]
    return pd.DataFrame({"t": t, "i": key[0], "j": key[1], name: path})


def phi_stream(wide: DataFrame, k: int, lists: bool = False) -> DataFrame:
    """t, i, j, cum_phi for each new row of a streaming wide table, or with ``lists`` for GRID steps from t on."""
    kind = code_type(k)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total, counts = state.get if state.exists else (0, 0.0, [0] * (k * k))
        joint = np.array(counts, dtype=np.int64).reshape(k, k)
        for t, cells in in_order(unpacked(batches, kind), last, {"cell": kind}):
            phi, joint = losses(t, cells.astype(np.int64), joint)
            sums = total + np.cumsum(phi)
            last, total = int(t[-1]), float(sums[-1])
            yield given(key, t, "cum_phi", sums, lists)
        state.update((last, total, joint.ravel().tolist()))

    out, held = f"t long, i int, j int, cum_phi {'array<double>' if lists else 'double'}", "last long, total double, counts array<long>"
    return packed_pairs(wide, k).groupBy("i", "j").applyInPandasWithState(update, out, held, "append", GroupStateTimeout.NoTimeout)


def weights_stream(wide: DataFrame, n: int, k: int, rows: int, epsilon: float = 0.9, seed: int = 7, retries: int = 1, lists: bool = False) -> DataFrame:
    """t, i, j, log_weight for each new row, or with ``lists`` for GRID steps from t on: the state is the logarithm of each cell's product.

    A row's factor is drawn where it is taken in, so that only values are exchanged and held.
    """
    c, kind = constants(n, k, rows, epsilon), code_type(k)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, logs = state.get if state.exists else (0, [0.0] * (k * k))
        logs = np.array(logs)
        for t, cells in in_order(unpacked(batches, kind), last, {"cell": kind}):
            u, v = np.divmod(cells.astype(np.int64), k)
            steps = np.zeros((len(t), k * k))
            steps[np.arange(len(t)), v * k + u] = c.eta * np.log(np.maximum(factors(t, key, u, v, n, k, c, seed, retries), 1e-300))
            path = logs + np.cumsum(steps, axis=0)
            last, logs = int(t[-1]), path[-1].copy()
            top = path.max(axis=1)
            yield given(key, t, "log_weight", top + np.log(np.exp(path - top[:, None]).sum(axis=1)), lists)
        state.update((last, logs.tolist()))

    out, held = f"t long, i int, j int, log_weight {'array<double>' if lists else 'double'}", "last long, logs array<double>"
    return packed_pairs(wide, k).groupBy("i", "j").applyInPandasWithState(update, out, held, "append", GroupStateTimeout.NoTimeout)


def by_steps(batch: DataFrame, n: int, name: str, work: Callable[[np.ndarray, np.ndarray], Iterable[np.ndarray]]) -> DataFrame:
    """t, i, j: ``work(t, paths)`` of a micro-batch of lists ``name``, PIECE steps at a time; paths have a row for each step and a column for each pair.

    An edge's value is not a number where it has none at a step that others have.
    """
    out = pa.schema([("t", pa.int64()), ("i", pa.int32()), ("j", pa.int32())])
    i, j = pair_ends(n)
    pair = np.full((n, n), -1)
    pair[i, j] = np.arange(len(i))

    def apply(rows: pa.Table) -> pa.Table:
        at, column = rows.column("t").to_numpy(), pair[rows.column("i").to_numpy(), rows.column("j").to_numpy()]
        values = rows.column(name).combine_chunks()
        ends, flat, first = values.offsets.to_numpy(), values.values.to_numpy(), at.min()
        paths = np.full(((at + np.diff(ends)).max() - first, len(i)), np.nan)
        for t, c, a, z in zip((at - first).tolist(), column.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            paths[t : t + z - a, c] = flat[a:z]
        there = np.flatnonzero(~np.isnan(paths).all(axis=1))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(work(there + first, paths[there]), out, strict=True)], schema=out)

    return batch.withColumn("block", F.floor(F.col("t") / PIECE)).groupBy("block").applyInArrow(apply, "t long, i int, j int")


def tree_stream(weights: DataFrame, structure: Callable[[DataFrame], DataFrame], folder: str) -> StreamingQuery:
    """Start the second stage of a learner: the tree of each step of a stream of weights (t, i, j, ..., or lists of them).

    Every micro-batch holds whole steps. Their trees, ``structure`` of the batch, are written to a
    folder named by the batch, over what a run that failed there has left: each step comes once.
    """

    def write(batch: DataFrame, number: int) -> None:
        structure(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return weights.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()


def trees_of(weights: DataFrame, structure: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """t, i, j: the trees of what is there now, read back once the stream has come to its end."""
    query = tree_stream(weights, structure, folder)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return weights.sparkSession.read.schema("t long, i int, j int").parquet(f"{folder}/out").select("t", "i", "j")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window start, event_type, n: a tumbling count with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def last_updates(stream: DataFrame, keys: list[str], value: str, folder: str) -> DataFrame:
    """The last value of each key of an aggregate that is given in update mode, over what is there now.

    Each micro-batch writes the rows that it changed to a folder named by the batch, over what a run
    that failed there has left; nothing is held by the driver.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    rows = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def read_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there now into parquet files in ``folder``, and read them."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
