"""The perturbed leader's losses as a stream with typed state variables in RocksDB.

The state of an edge is a clock (last step and total loss) and a map from cells to counts: a micro-batch
reads and writes only what its rows touch, in a store that spills to disk and is restored from
changelogs, so an edge's state needn't fit into a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from arbora.operators.encode import pair_form
from arbora.streaming.online import drained, in_order, losses

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EdgeLoss(StatefulProcessor):
    """t, i, j, cum_phi for each row of an edge, in order of time; gaps and repeats are errors."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "last long, total double")
        self.cells = handle.getMapState("cells", "u int, v int", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, total = self.clock.get() if self.clock.exists() else (0, 0.0)
        k = self.k
        counts = np.zeros((k, k), dtype=np.int64)
        for (u, v), (n,) in self.cells.iterator():
            counts[u, v] = n
        before = counts
        for t, u, v in in_order(rows, last, {"u": "int32", "v": "int32"}):
            phi, counts = losses(t, u.astype(np.int64) * k + v, counts)
            sums = total + np.cumsum(phi)
            last, total = int(t[-1]), float(sums[-1])
            yield pd.DataFrame({"t": t, "i": key[0], "j": key[1], "cum_phi": sums})
        for u, v in np.argwhere(counts != before).tolist():
            self.cells.updateValue((u, v), (int(counts[u, v]),))
        self.clock.update((last, total))

    def close(self) -> None:
        pass


def loss_stream(wide: DataFrame, k: int) -> DataFrame:
    """t, i, j, cum_phi for each new row of a streaming wide table. Its query needs the provider ROCKSDB."""
    return pair_form(wide, k).groupBy("i", "j").transformWithStateInPandas(EdgeLoss(k), "t long, i int, j int, cum_phi double", "Append", "None")


def drained_with_rocksdb(stream: DataFrame, folder: str) -> DataFrame:
    """``drained`` with state in RocksDB; the session's provider is what it was before."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return drained(stream, folder)
    finally:
        conf.set(PROVIDER, before)
