"""Order-dependent work on long groups: running medians in one pass, and greedy folds that one group's tasks share.

A greedy fold cuts ordered rows into pieces; whether a row goes on in the open piece depends on what the piece holds. Once a
piece starts at a row, nothing before that row matters, so each row has one next start. Rows are sorted by key and order
into range partitions, so that a long group lies in several. A partition's first and last group are then summarised as a
function of the state they are entered with: its first rows, up to where even the lightest piece must end, and for each of
these the pieces that follow if one starts there, and the state left at the end. States are passed on from summary to
summary (there are two at most for each partition), and each partition then numbers its own rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabula.session import materialize, shuffle_partitions


class RunningMedian:
    """The median of values so far, by two heaps: adding takes log n, asking is at once. Its state can be saved and taken up."""

    def __init__(self, low: bytes = b"", high: bytes = b""):
        self.low, self.high = np.frombuffer(low).tolist(), np.frombuffer(high).tolist()  # the lower half negated

    def __len__(self) -> int:
        return len(self.low) + len(self.high)

    def add(self, value: float) -> None:
        heapq.heappush(self.low, -heapq.heappushpop(self.high, value))
        if len(self.low) > len(self.high):
            heapq.heappush(self.high, -heapq.heappop(self.low))

    def median(self) -> float:
        return self.high[0] if len(self.high) > len(self.low) else (self.high[0] - self.low[0]) / 2

    def saved(self) -> tuple[bytes, bytes]:
        return np.array(self.low, float).tobytes(), np.array(self.high, float).tobytes()


def keyed_pass(rows: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, added: str) -> DataFrame:
    """The rows with the columns ``added`` (a schema): one pass over each key's rows in order, batch by batch.

    ``step(state, batch)`` gets a state and a run of one key's rows and returns the added arrays; what it keeps is its state, so a
    long key is never held whole.
    """
    run = "_run"
    while run in rows.columns:
        run += "_"
    sorted_ = rows.withColumn(run, F.xxhash64(*keys)).repartition(*keys).sortWithinPartitions(run, *keys, *order)
    names = [f.split()[0] for f in added.split(", ")]

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            ids = batch.column(run).to_numpy()
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
            made = []
            for a, b in zip(edges, edges[1:], strict=False):
                if last is None or ids[a] != last:
                    last, state = ids[a], start()
                made.append(step(state, batch.slice(a, b - a)))
            if made:
                kept = batch.drop_columns([run])
                yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.concat_arrays(x) for x in zip(*made, strict=True)]], [*kept.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), added])
    return sorted_.mapInArrow(passed, schema)


def _floats(batch: pa.RecordBatch, name: str) -> list[float]:
    """The values of a column; nulls and what isn't a number as NaN."""
    return batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False).tolist()


def running_medians(rows: DataFrame, keys: list[str], order: list[str], value: str, median="median_before", count="n_before") -> DataFrame:
    """The rows with the median and the number of the values before each in its key; nulls and NaN don't count."""

    def step(state: RunningMedian, batch: pa.RecordBatch):
        n, m = [], []
        for v in _floats(batch, value):
            n.append(len(state))
            m.append(state.median() if n[-1] else None)
            if v == v:
                state.add(v)
        return pa.array(m, pa.float64()), pa.array(n, pa.int64())

    return keyed_pass(rows, keys, order, RunningMedian, step, f"{median} double, {count} long")


def gate_step(state: RunningMedian, values: list[float], low: float, high: float, least: int) -> list[bool]:
    """ST-2's rule: a value is accepted if it lies in the band around the median of the values accepted before it (all are
    until ``least`` of them); flagged values don't count, and null or NaN is never accepted."""
    out = []
    for v in values:
        ok = v == v
        if ok and len(state) >= least:
            m = state.median()
            ok = low * m <= v <= high * m
        if ok:
            state.add(v)
        out.append(ok)
    return out


class GreedyBatches:
    """FLD-1, FLD-2: a piece ends before the row that would take it over the limit, and where the break key changes."""

    columns = ("w", "g")

    def __init__(self, limit: int):
        self.limit = limit

    def nexts(self, rows: dict) -> np.ndarray:
        w, n = rows["w"], len(rows["w"])
        before = np.concatenate(([0], np.cumsum(w)))
        over = np.searchsorted(before, before[:-1] + self.limit, "right") - 1
        breaks = np.append(np.flatnonzero(rows["g"][1:] != rows["g"][:-1]) + 1, n)
        start = np.arange(n)
        return np.minimum(np.maximum(over, start + 1), breaks[np.searchsorted(breaks, start, "right")])

    def lightest(self, rows: dict):
        return 0, rows["g"][0]

    def first(self, state, rows: dict) -> int:
        held, g = state
        changes = np.flatnonzero(rows["g"] != g)
        over = int(np.searchsorted(np.cumsum(rows["w"]), self.limit - held, "right"))
        return min(over, int(changes[0]) if len(changes) else len(rows["w"]))

    def end(self, state, start: int | None, rows: dict):
        held = int(rows["w"][start or 0 :].sum())
        return held + (state[0] if start is None else 0), rows["g"][-1]


class ShortJoins:
    """FLD-4, FLD-5: a row goes on in the piece of the row before if they touch, either is under ``minimum``, and both with a space fit into ``maximum``."""

    columns = ("w", "s", "b", "x", "y", "whole", "can")

    def __init__(self, minimum: int, maximum: int):
        self.minimum, self.maximum = minimum, maximum

    def _touch(self, a: dict, b: dict, i, j):
        """Whether row j of b can go on after row i of a."""
        inside = (a["b"][i] == b["b"][j]) & (a["y"][i] == b["x"][j])
        return (a["s"][i] == b["s"][j]) & a["can"][i].astype(bool) & b["can"][j].astype(bool) & (inside | ((a["y"][i] == a["whole"][i]) & (b["x"][j] == 0)))

    def _goes_on(self, held: int, w: int) -> bool:
        return min(held, w) < self.minimum and held + 1 + w <= self.maximum

    def nexts(self, rows: dict) -> np.ndarray:
        n, w = len(rows["w"]), rows["w"].tolist()
        touch = [False, *self._touch(rows, rows, slice(0, n - 1), slice(1, n)).tolist()]
        out = []
        for start in range(n):
            held, t = w[start], start + 1
            while t < n and touch[t] and self._goes_on(held, w[t]):
                held += 1 + w[t]
                t += 1
            out.append(t)
        return np.array(out)

    def lightest(self, rows: dict):
        return -1, None

    def first(self, state, rows: dict) -> int:
        held, last = state
        n, w = len(rows["w"]), rows["w"].tolist()
        touch = [last is None or bool(self._touch(last, rows, slice(0, 1), slice(0, 1))[0]), *self._touch(rows, rows, slice(0, n - 1), slice(1, n)).tolist()]
        for t in range(n):
            if not (touch[t] and self._goes_on(held, w[t])):
                return t
            held += 1 + w[t]
        return n

    def end(self, state, start: int | None, rows: dict):
        own = rows["w"][start or 0 :]
        held = int(own.sum()) + len(own) - 1
        return held + (state[0] + 1 if start is None else 0), {c: rows[c][-1:] for c in self.columns}


def _summary(fold, rows: dict) -> bytes:
    """What the rows do with any entering state."""
    n = len(rows["w"])
    nexts = fold.nexts(rows).tolist()
    pieces, last = [0] * n, [0] * n
    for j in range(n - 1, -1, -1):
        t = nexts[j]
        pieces[j], last[j] = (1, j) if t >= n else (1 + pieces[t], last[t])
    head = min(n, fold.first(fold.lightest(rows), rows) + 1)
    ends = {j: fold.end(None, j, rows) for j in set(last[:head])}
    return pickle.dumps(({c: a[:head] for c, a in rows.items()}, pieces[:head], [ends[j] for j in last[:head]]))


def _runs(batches: Iterator[pa.RecordBatch], columns: tuple) -> Iterator[tuple]:
    """(chunk, run, whether it is the chunk's first, its last, header, columns as arrays, the rows as a table) of sorted rows."""
    held: list[pa.RecordBatch] = []
    at = None

    def made(first: bool, last: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        header, body = table.filter(pc.is_valid(table["header"])), table.filter(pc.is_null(table["header"]))
        arrays = {c: body[c].combine_chunks().to_numpy(zero_copy_only=False) if body.num_rows else np.zeros(0, np.int64) for c in columns}
        return first, last, header["header"][0].as_py() if header.num_rows else None, arrays, body

    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column("chunk").to_numpy().astype(np.int64), batch.column("run").to_numpy()])
        edges = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            here = (int(ids[0, a]), int(ids[1, a]))
            if held and here != at:
                yield made(first, here[0] != at[0])
                first, held = here[0] != at[0], []
            at = here
            held.append(batch.slice(a, b - a))
    if held:
        yield made(first, True)


def piece_numbers(rows: DataFrame, keys: list[str], order: str, fold, fields: dict[str, Column], carry: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """(keys, order, carried columns, piece): pieces numbered from 0 in each key, in order of ``order`` (ties: by the fields, then alike)."""
    spark = rows.sparkSession
    own, with_them = [f"k{i}" for i in range(len(keys))], [f"c{i}" for i in range(len(carry))]
    slim = rows.select(*[F.col(k).alias(o) for k, o in zip([*keys, *carry], [*own, *with_them], strict=True)], F.col(order).alias("o"), *[fields[c].alias(c) for c in fold.columns])
    sort = [*own, "o", *fold.columns]
    ranged = slim.repartitionByRange(partitions or shuffle_partitions(spark), *sort).withColumn("chunk", F.spark_partition_id())
    chunks = materialize(ranged.withColumn("run", F.xxhash64(*own)).withColumn("header", F.lit(None).cast("binary")), "fold-chunks")
    by_chunk = lambda df: df.repartition("chunk").sortWithinPartitions("chunk", *own, F.col("header").isNull(), "o", *fold.columns)
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    key_schema = "".join(f"{o} {kinds[o]}, " for o in own)

    def summaries(batches):
        for first, last, _, arrays, body in _runs(batches, fold.columns):
            if first or last:  # others lie in one partition
                yield pa.RecordBatch.from_arrays([*[body[c].combine_chunks().slice(0, 1) for c in [*own, "chunk", "run"]], pa.array([_summary(fold, arrays)], pa.binary())], [*own, "chunk", "run", "summary"])

    def entries(batches):
        at, state, base = None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                run = batch.column("run")[i].as_py()
                if run != at:
                    at, state, base = run, None, 0
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in [*own, "chunk", "run"]], pa.array([pickle.dumps((state, base))], pa.binary())], [*own, "chunk", "run", "header"])
                head, pieces, ends = pickle.loads(batch.column("summary")[i].as_py())
                start = 0 if state is None else fold.first(state, head)
                if start < len(pieces):
                    state, base = ends[start], base + pieces[start]
                else:
                    state = fold.end(state, None, head)

    tail = "chunk int, run long"
    summed = by_chunk(chunks).mapInArrow(summaries, f"{key_schema}{tail}, summary binary")
    entered = materialize(summed.repartition("run").sortWithinPartitions("run", *own, "chunk").mapInArrow(entries, f"{key_schema}{tail}, header binary"), "fold-entries")

    def numbered(batches):
        for _, _, header, arrays, body in _runs(batches, fold.columns):
            state, base = pickle.loads(header) if header else (None, 0)
            n = body.num_rows
            if not n:
                continue
            nexts = fold.nexts(arrays).tolist()
            starts = np.zeros(n, np.int64)
            j = 0 if state is None else fold.first(state, arrays)
            while j < n:
                starts[j] = 1
                j = nexts[j]
            yield from pa.Table.from_arrays([*[body[c] for c in [*own, "o", *with_them]], pa.array(base - 1 + np.cumsum(starts))], [*own, "o", *with_them, "piece"]).to_batches()

    done = by_chunk(chunks.unionByName(entered, allowMissingColumns=True)).mapInArrow(numbered, f"{key_schema}o {kinds['o']}, {''.join(f'{c} {kinds[c]}, ' for c in with_them)}piece long")
    return done.select(*[F.col(o).alias(k) for k, o in zip([*keys, order, *carry], [*own, "o", *with_them], strict=True)], "piece")


def running_sums(rows: DataFrame, keys: list[str], order: str, weight: Column, partitions: int | None = None) -> DataFrame:
    """(keys, order, _w, _rank, _before, _total, _rows): sums and ranks over ordered rows of a key, in two levels.

    Range partitions are summed apart, the sums of earlier partitions are added to each (a row for each partition and key),
    and rows are summed inside their partition, so a long key runs in several tasks.
    """
    spark = rows.sparkSession
    own = [f"k{i}" for i in range(len(keys))]
    slim = rows.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(order).alias("o"), weight.cast("long").alias("w"))
    chunks = materialize(slim.repartitionByRange(partitions or shuffle_partitions(spark), *own, "o", "w").withColumn("chunk", F.spark_partition_id()), "sum-chunks")
    small = chunks.groupBy(*own, "chunk").agg(F.sum("w").alias("s"), F.count("*").alias("n"))
    earlier = W.partitionBy(*own).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*own)
    zero = F.lit(0).cast("long")
    small = small.select(*own, "chunk", F.coalesce(F.sum("s").over(earlier), zero).alias("s0"), F.coalesce(F.sum("n").over(earlier), zero).alias("n0"), F.sum("s").over(whole).alias("total"), F.sum("n").over(whole).alias("rows"))
    small = small.select(*[F.col(c).alias(f"{c}_") for c in [*own, "chunk"]], "s0", "n0", "total", "rows")
    joined = chunks.join(small, [F.col(o).eqNullSafe(F.col(f"{o}_")) for o in own] + [F.col("chunk") == F.col("chunk_")])
    inside = W.partitionBy("chunk", *own).orderBy("o", "w").rowsBetween(W.unboundedPreceding, -1)
    return joined.select(
        *[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], F.col("o").alias(order), F.col("w").alias("_w"), (F.col("n0") + F.row_number().over(W.partitionBy("chunk", *own).orderBy("o", "w")) - 1).alias("_rank"),
        (F.col("s0") + F.coalesce(F.sum("w").over(inside), zero)).alias("_before"), F.col("total").alias("_total"), F.col("rows").alias("_rows"),
    )
