"""Iterations over a table whose rounds exchange sums of a fixed size.

A task folds blocks of rows into one vector of sums per round and decides the parameters of
the next.  A table of up to ``ONE_TASK_CELLS`` cells (twice as many where only an outcome is asked
for) is walked by one executor task, all rounds through.  A larger one takes one job a round: partitions are folded where they lie and their
vectors added cell by cell with map-side combination.  What earlier rounds did to a row is
done again from the parameters since the last copy of the rows, at most ``CHAIN`` of them, so
a round writes nothing; both ways walk the same rounds.
"""

from __future__ import annotations

import atexit
import pickle
import re
import shutil
import tempfile
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a table that one task walks, in some 64 MB a copy; rounds after which the rows are copied.
ONE_TASK_CELLS, CHAIN = 8 << 20, 8


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="sigloom-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy in the shared folder, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def lists(values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A matrix as a column of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()), type=kind)


class Task:
    """What is walked; ``advance`` changes a block as the round does and returns its sums."""

    def load(self, batch: pa.RecordBatch) -> Any:
        raise NotImplementedError

    def join(self, blocks: list) -> Any:
        raise NotImplementedError

    def advance(self, block: Any, params: Any) -> np.ndarray:
        raise NotImplementedError

    def decide(self, sums: np.ndarray, params: Any, step: int) -> tuple[Any, bool]:
        """The next parameters, and whether the round just summed was the last."""
        raise NotImplementedError

    def state(self, block: Any) -> dict[str, np.ndarray]:
        """The columns (matrices of doubles) that rounds change."""
        raise NotImplementedError

    def outcome(self, block: Any, params: Any) -> np.ndarray:
        """Sums over a block after the last round, where they are all that is asked for."""
        raise NotImplementedError


def _replaced(batch: pa.RecordBatch, state: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lists(state[n], batch.column(n).type) if n in state else batch.column(n) for n in batch.schema.names], names=batch.schema.names)


def _one_task(rows: DataFrame, task: Task) -> tuple[DataFrame, Any]:
    shape = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema.fields), T.StructField("params", T.BinaryType())])

    def walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        block, params, done, step = task.join([task.load(b) for b in held]), None, False, 0
        while not done:
            params, done = task.decide(task.advance(block, params), params, step)
            step += 1
        at = 0
        for batch in held:
            own = _replaced(batch, {n: v[at : at + batch.num_rows] for n, v in task.state(block).items()})
            yield pa.RecordBatch.from_arrays([*own.columns, pa.nulls(batch.num_rows, pa.binary())], names=shape.names)
            at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in held[0].schema), pa.array([pickle.dumps(params)], pa.binary())], names=shape.names)

    got = settle(rows.coalesce(1).mapInArrow(walk_all, shape))
    params = pickle.loads(got.filter(F.col("params").isNotNull()).select("params").first()[0])
    return got.filter(F.col("params").isNull()).drop("params"), params


def _one_task_outcome(rows: DataFrame, task: Task) -> tuple[Any, np.ndarray | None]:
    def walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [task.load(b) for b in batches if b.num_rows]
        if not blocks:
            return
        block, params, done, step = task.join(blocks), None, False, 0
        while not done:
            params, done = task.decide(task.advance(block, params), params, step)
            step += 1
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((params, task.outcome(block, params)))], pa.binary())], names=["got"])

    got = rows.coalesce(1).mapInArrow(walk_all, "got binary").collect()  # one row
    return pickle.loads(got[0]["got"]) if got else (None, None)


def _total(rows: DataFrame, sums: Any) -> np.ndarray:
    """What ``sums`` gives for the batches, added cell by cell."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = sums(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([lists(total[None, :])], names=["v"])

    cells = rows.mapInArrow(folded, "v array<double>").select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    got = cells.collect()  # as many rows as the parameters have numbers, about
    vector = np.zeros(len(got))
    for r in got:
        vector[r["at"]] = r["v"]
    return vector


def walk(rows: DataFrame, task: Task, width: int) -> tuple[DataFrame, Any]:
    """The settled ``rows`` after the last round, and the parameters that it gave; ``width`` is a row's cells."""
    if rows.count() * width <= ONE_TASK_CELLS:
        return _one_task(rows, task)
    rows, params, _ = _many_tasks(rows, task)
    return rows, params


def outcome(rows: DataFrame, task: Task, width: int) -> tuple[Any, np.ndarray | None]:
    """The parameters after the last round of the ``rows`` and the task's outcome; writes no table, so a task holds twice the cells."""
    if rows.count() * width <= 2 * ONE_TASK_CELLS:
        return _one_task_outcome(rows, task)
    _, params, sums = _many_tasks(settle(rows), task, ends=True)
    return params, sums


def _many_tasks(rows: DataFrame, task: Task, ends: bool = False) -> tuple[DataFrame, Any, np.ndarray | None]:
    def caught_up(batch: pa.RecordBatch, chain: list) -> Any:
        block = task.load(batch)
        for params in chain:
            task.advance(block, params)
        return block

    chain: list = []
    params, done, step = None, False, 0
    while not done:
        behind, now = list(chain), params

        vector = _total(rows, lambda batch, behind=behind, now=now: task.advance(caught_up(batch, behind), now))
        chain.append(params)
        params, done = task.decide(vector, params, step)
        step += 1
        if done and ends:
            return rows, params, _total(rows, lambda batch, behind=list(chain), now=params: task.outcome(caught_up(batch, behind), now))
        if done or len(chain) >= CHAIN:
            passed = list(chain)

            def copied(batches: Iterator[pa.RecordBatch], passed=passed) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        yield _replaced(batch, task.state(caught_up(batch, passed)))

            rows, chain = settle(rows.mapInArrow(copied, rows.schema)), []
    return rows, params, None
