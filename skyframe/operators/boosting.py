"""Multiclass boosted trees: softmax boosting with one regression tree per class and round.

A round takes the softmax of the margins, grows a regression tree on each class's residuals (y - p) over
a hash sample of the rows and a drawn subset of the features, the classes' trees side by side, and
gives the leaves Newton steps ``G / (H + reg_lambda)`` with G the sum of the residuals in the leaf (shrunk
by ``reg_alpha``) and H that of ``2 p (1 - p)``, times the learning rate.

Rows are binned once by ``MAX_BINS`` candidate thresholds per feature, taken from all rows. A node of more than
``ROWS_A_TASK`` rows is split by sums per bin that all tasks add up, a pass for the nodes of a level; smaller
nodes' rows are sent to one task each, which grows the rest of the tree. So a round on a table
that fits a task is one job, and no task holds more than such a node.

Trees are small arrays. Margins are computed from them on Arrow batches, a tree at a time over a
whole batch, so scoring is one projection however many trees there are. Margins of the latest rounds
are recomputed and written every ``WRITE_EVERY`` rounds, which keeps both the lineage and the work of
a round short.

Training continues from a fitted ensemble (``start``): its margins are where the new rounds begin,
its trees stay as they are. ``staged_log_loss`` gives the loss after every round from one pass.

Differences to other boosting libraries: splits are chosen by variance of the residuals; ``gamma`` is
the least such gain, ``min_child_weight`` a number of rows.
"""

from __future__ import annotations

import heapq
import json
import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import LABEL
from ..session import materialise, spread

MAX_BINS = 128
WRITE_EVERY = 4
ROWS_A_TASK = 1_000_000  # a node of no more rows (15 bytes each) is grown by one task
ROWS_AT_ONCE = 1 << 17  # rows of a task that are worked on together
NODES_AT_ONCE = 256  # nodes whose sums per bin are held together
EPS = 2.0 ** -52


class Tree(NamedTuple):
    """Nodes, the root first; ``feature`` is -1 at a leaf, whose ``value`` counts."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Node number of the leaf of each row of ``x``; a missing value goes right."""
        inner, own = self.feature >= 0, np.arange(len(self.feature))
        feature = np.where(inner, self.feature, 0)  # rows that are at a leaf stay there
        below = np.stack([np.where(inner, self.right, own), np.where(inner, self.left, own)], axis=1).ravel()
        flat, row = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        at, level = np.zeros(len(x), dtype=np.int64), own[:1][inner[:1]]
        while len(level):
            at = below[2 * at + (flat[row + feature[at]] <= self.threshold[at])]
            level = np.concatenate([self.left[level], self.right[level]])
            level = level[inner[level]]
        return at


@dataclass
class BoostedModel:
    """A fitted ensemble: ``rounds`` holds one tree per class each. Margins start at 0."""
    labels: list[str]
    features: list[str]
    scaler_stats: dict[str, tuple[float, float]]
    rounds: list[list[Tree]] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` (array in the order of the labels) and ``predicted_label``."""
        out = df.withColumn("probability", softmax(margins(_array(self.features), None, self.rounds, len(self.labels))))
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        return out.withColumn("predicted_label", F.get(F.array(*[F.lit(c) for c in self.labels]), best - 1))


def _array(features: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(-1, width)


def margins(x: Column, start: Column | None, rounds: list[list[Tree]], n_classes: int) -> Column:
    """Margins of the classes after ``rounds``, from ``start`` (0 where there is none)."""
    def total(x: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
        out = before.copy()
        for trees in rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.leaf(x)]
        return list(out)

    @F.pandas_udf("array<double>")
    def added(x: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series(total(np.array(x.tolist(), dtype=np.float64).reshape(len(x), -1), _matrix(before, n_classes)))

    return added(x, F.array_repeat(F.lit(0.0), n_classes) if start is None else start)


def softmax(margin: Column) -> Column:
    def shares(m):
        e = F.transform(m, lambda v: F.exp(v - F.array_max(m)))
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
    return F.get(F.transform(F.array(margin), shares), F.lit(0))  # bound once, used many times


def candidate_cuts(rows: DataFrame, n_features: int) -> list[np.ndarray]:
    """The thresholds that are tried for each feature, from all rows: halfway between two neighbouring values
    where there are at most ``MAX_BINS`` values, quantiles otherwise."""
    values = rows.select(F.posexplode("x").alias("f", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    told = values.groupBy("f").agg(
        F.approx_count_distinct("v").alias("about"),
        F.percentile_approx("v", [i / MAX_BINS for i in range(1, MAX_BINS)], 10_000).alias("quantiles")).collect()
    seen = defaultdict(list)
    for r in values.where(F.col("f").isin([r["f"] for r in told if r["about"] <= 2 * MAX_BINS])).distinct().collect():
        seen[r["f"]].append(r["v"])
    cuts = [np.empty(0)] * n_features
    for r in told:
        exact = np.unique(seen[r["f"]])
        found = (exact[:-1] + exact[1:]) / 2 if 0 < len(exact) <= MAX_BINS else np.unique(r["quantiles"])
        cuts[r["f"]] = found[~np.isnan(found)]
    return cuts


def binned(x: Column, cuts: list[np.ndarray]) -> Column:
    """Bin of each feature, a byte each; a missing value is in the last."""
    @F.pandas_udf("binary")
    def numbers(x: pd.Series) -> pd.Series:
        values = _matrix(x, len(cuts))
        out = np.stack([np.searchsorted(c, values[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
        return pd.Series([row.tobytes() for row in out], dtype=object)

    return numbers(x)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _matrix_of(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Rows of numbers from a column of bytes."""
    size = np.dtype(dtype).itemsize * width
    fixed = column.cast(pa.binary(size))
    return np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * size:][:len(fixed) * size].view(dtype).reshape(-1, width)


def _column_of(values: np.ndarray) -> pa.Array:
    size = values.dtype.itemsize * values.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(size), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bins and residuals, each of many rows."""
    for batch in batches:
        for x, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(x, np.uint8).reshape(-1, width)
            yield x, np.frombuffer(r).reshape(len(x), -1)


def _advance(x: np.ndarray, margin: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    for trees in rounds:
        for k, tree in enumerate(trees):
            margin[:, k] += tree.value[tree.leaf(x)]
    return margin


def _advanced(rows: DataFrame, rounds: list[list[Tree]], width: int, n_classes: int) -> DataFrame:
    """``rows`` with their margins after ``rounds`` (trees over bins), as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                before = batch.column(3)
                margin = (np.array(before.flatten()).reshape(-1, n_classes) if pa.types.is_list(before.type)
                          else _matrix_of(before, np.float64, n_classes).copy())
                margin = _advance(_matrix_of(batch.column(0), np.uint8, width), margin, rounds)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _column_of(margin)], names=["b", "y", "rid", "m"])

    return rows.select("b", "y", "rid", "m").mapInArrow(run, "b binary, y int, rid long, m binary")


def _residuals(rounds: list[list[Tree]], width: int, n_classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches of bins, class and margins: bins and residuals of the classes after ``rounds``, a row
    for many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            x = _matrix_of(batch.column(0), np.uint8, width)
            margin = _advance(x, _matrix_of(batch.column(2), np.float64, n_classes).copy(), rounds)
            e = np.exp(margin - margin.max(axis=1, keepdims=True))
            residual = -e / e.sum(axis=1, keepdims=True)
            residual[np.arange(len(e)), batch.column(1).to_numpy()] += 1
            yield pa.RecordBatch.from_pydict({"x": pa.array([x.tobytes()], pa.binary()), "r": pa.array([residual.tobytes()], pa.binary())})

    return run


def _curvature(r: np.ndarray) -> np.ndarray:
    return np.maximum(2 * np.abs(r) * (1 - np.abs(r)), 1e-16)  # |r| is p or 1 - p


class Limits(NamedTuple):
    """What a tree is grown within: features of a row, bins, levels, least rows of a leaf and least gain."""
    features: int
    bins: int
    depth: int
    rows: int
    gain: float


def _per_bin(x: np.ndarray, r: np.ndarray, at: np.ndarray, m: int, shown: Sequence[int], bins: int) -> np.ndarray:
    """Rows and sums of residuals of ``m`` nodes per shown feature and bin."""
    out = np.empty((2, m, len(shown), bins))
    for j, f in enumerate(shown):
        key = at * bins + x[:, f]
        out[0, :, j] = np.bincount(key, minlength=m * bins).reshape(m, bins)
        out[1, :, j] = np.bincount(key, r, minlength=m * bins).reshape(m, bins)
    return out


def best_splits(per_bin: np.ndarray, shown: Sequence[int], limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: no split), last bin on the left and rows on the left, per node: the split that lowers
    the variance most, the first of equals."""
    m = per_bin.shape[1]
    if per_bin.shape[3] < 2:
        return np.full(m, -1), np.zeros(m, np.int64), np.zeros(m)
    n, g = per_bin.cumsum(axis=3)
    rows, total = n[:, :, -1:], g[:, :, -1:]
    n, g = n[:, :, :-1], g[:, :, :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        parted, whole = g * g / n + (total - g) ** 2 / (rows - n), total * total / rows
        gain = (parted - whole) / rows
        ok = (n >= limits.rows) & (rows - n >= limits.rows) & (gain >= limits.gain) & (parted - whole > 1e-12 * parted)
    gain = np.where(ok, gain, -1.0).reshape(m, -1)
    best = gain.argmax(axis=1)
    which, cut = np.divmod(best, per_bin.shape[3] - 1)
    found = gain[np.arange(m), best] > 0
    return np.where(found, np.asarray(shown)[which], -1), np.where(found, cut, 0), n[np.arange(m), which, cut]


def _splits_here(x: np.ndarray, r: np.ndarray, at: np.ndarray, m: int, shown: Sequence[int], limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Best splits of ``m`` nodes whose rows are all here."""
    feature, cut = np.empty(m, np.int64), np.empty(m, np.int64)
    order = np.argsort(at, kind="stable") if m > NODES_AT_ONCE else slice(None)
    x, r, at = x[order], r[order], at[order]
    for a in range(0, m, NODES_AT_ONCE):
        b = min(m, a + NODES_AT_ONCE)
        some = slice(*np.searchsorted(at, [a, b])) if m > NODES_AT_ONCE else slice(None)
        per_bin = _per_bin(x[some], r[some], at[some] - a, b - a, shown, limits.bins)
        feature[a:b], cut[a:b], _ = best_splits(per_bin, shown, limits)
    return feature, cut


def grow_here(x: np.ndarray, r: np.ndarray, shown: Sequence[int], limits: Limits) -> pd.DataFrame:
    """The nodes, with their sums, of a tree on rows that are all here."""
    h, at, levels, first, m = _curvature(r), np.zeros(len(x), np.int64), [], 0, 1
    for depth in range(limits.depth + 1):
        sums = {"g": np.bincount(at, r, m), "h": np.bincount(at, h, m), "n": np.bincount(at, minlength=m)}
        feature, cut = _splits_here(x, r, at, m, shown, limits) if depth < limits.depth else (np.full(m, -1), np.zeros(m, np.int64))
        split = feature >= 0
        place = 2 * (np.cumsum(split) - 1)
        left = np.where(split, first + m + place, -1)
        levels.append(pd.DataFrame({"feature": feature, "cut": cut, "left": left, "right": np.where(split, left + 1, -1), **sums}))
        first, m = first + m, 2 * int(split.sum())
        if not m:
            break
        kept = split[at]
        x, r, h, at = x[kept], r[kept], h[kept], at[kept]
        at = place[at] + (x[np.arange(len(x)), feature[at]] > cut[at])
    return pd.concat(levels, ignore_index=True)


class Node(NamedTuple):
    """A node that may still be split: class, number in its tree, levels that may follow, rows."""
    k: int
    number: int
    depth: int
    rows: int


def _slots(nodes: list[Node], trees: list[Tree]) -> list[np.ndarray]:
    """Per class, the place in ``nodes`` of each node of its tree, -1 where it is not among them."""
    out = [np.full(len(t.feature), -1) for t in trees]
    for i, node in enumerate(nodes):
        out[node.k][node.number] = i
    return out


def _split_large(data: DataFrame, trees: list[Tree], nodes: list[Node], subsets: list[list[int]], limits: Limits) -> pd.DataFrame:
    """Best split and sums of each of ``nodes``: every task sums its rows per bin, the sums are added up by node."""
    slots = _slots(nodes, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, per_bin = np.zeros(len(nodes)), np.zeros((2, len(nodes), len(subsets[0]), limits.bins))
        for x, r in _blocks(batches, limits.features):
            for k in {node.k for node in nodes}:
                slot = slots[k][trees[k].leaf(x)]
                own = np.flatnonzero(slots[k] >= 0)
                mine = np.sort(slots[k][own])
                rows = np.flatnonzero(slot >= 0)
                at = np.searchsorted(mine, slot[rows])
                h[mine] += np.bincount(at, _curvature(r[rows, k]), len(mine))
                per_bin[:, mine] += _per_bin(x[rows], r[rows, k], at, len(mine), subsets[k], limits.bins)
        for i in np.flatnonzero(per_bin[0].any(axis=(1, 2))):
            yield pa.RecordBatch.from_pydict({"slot": pa.array([i], pa.int32()), "sums": pa.array(
                [np.concatenate([h[i:i + 1], per_bin[:, i].ravel()]).tobytes()], pa.binary())})

    def choose(parts: pd.DataFrame) -> pd.DataFrame:
        node = nodes[int(parts["slot"].iloc[0])]
        sums = sum(np.frombuffer(p) for p in sorted(parts["sums"]))
        per_bin = sums[1:].reshape(2, 1, len(subsets[0]), limits.bins)
        feature, cut, rows = best_splits(per_bin, subsets[node.k], limits) if node.depth else (np.array([-1]), np.zeros(1), np.zeros(1))
        n, g = per_bin[:, 0, 0].sum(axis=1)
        return pd.DataFrame({"slot": parts["slot"].iloc[:1].to_numpy(), "feature": feature, "cut": cut, "n_left": rows, "g": g, "h": sums[0], "n": n})

    return (data.mapInArrow(run, "slot int, sums binary").groupBy("slot")
            .applyInPandas(choose, "slot int, feature int, cut int, n_left long, g double, h double, n long").toArrow().to_pandas())


def _grow_small(data: DataFrame, residuals: Callable, trees: list[Tree], nodes: list[Node], subsets: list[list[int]], limits: Limits) -> pd.DataFrame:
    """The trees below ``nodes``: the rows of a node go to one task, which grows what is below it."""
    slots, cores = _slots(nodes, trees), data.sparkSession.sparkContext.defaultParallelism
    n_parts = min(len(nodes), max(cores, -(-sum(node.rows for node in nodes) // ROWS_A_TASK)))
    parts, loads = [0] * len(nodes), [(0, p) for p in range(n_parts)]
    for i in sorted(range(len(nodes)), key=lambda i: -nodes[i].rows):
        load, parts[i] = heapq.heappop(loads)
        heapq.heappush(loads, (load + nodes[i].rows, parts[i]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, r in _blocks(residuals(batches), limits.features):
            out: dict[str, list] = {"part": [], "slot": [], "x": [], "r": []}
            for k in {node.k for node in nodes}:
                slot = slots[k][trees[k].leaf(x)]
                order = np.argsort(slot, kind="stable")
                order = order[np.searchsorted(slot[order], 0):]
                found, begins = np.unique(slot[order], return_index=True)
                for i, rows in zip(found.tolist(), np.split(order, begins[1:])):
                    for name, v in zip(out, (parts[i], i, x[rows].tobytes(), r[rows, k].tobytes())):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("part", pa.int32()), ("slot", pa.int32()), ("x", pa.binary()), ("r", pa.binary())]))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for batch in batches:
            for i, x, r in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                held[i].append((x, r))
        for i in sorted(held):
            x, r = (np.frombuffer(b"".join(v), t) for v, t in zip(zip(*sorted(held.pop(i))), (np.uint8, np.float64)))
            grown = grow_here(x.reshape(len(r), -1), r, subsets[nodes[i].k], limits._replace(depth=nodes[i].depth))
            yield pa.RecordBatch.from_pandas(grown.assign(slot=i, node=np.arange(len(grown))), preserve_index=False, schema=pa.schema(
                [("slot", pa.int32()), ("node", pa.int32()), *[(c, pa.int64()) for c in ("feature", "cut", "left", "right")],
                 ("g", pa.float64()), ("h", pa.float64()), ("n", pa.int64())]))

    return (data.mapInArrow(send, "part int, slot int, x binary, r binary").repartitionById(n_parts, "part")
            .mapInArrow(grow, "slot int, node int, feature long, cut long, left long, right long, g double, h double, n long")
            .toArrow().to_pandas().sort_values(["slot", "node"]))


def newton_leaves(trees: list[Tree], sums: pd.DataFrame, params: Mapping[str, object]) -> list[Tree]:
    rate, ridge, lasso = (float(params[p]) for p in ("learning_rate", "reg_lambda", "reg_alpha"))
    out = []
    for k, tree in enumerate(trees):
        value = np.zeros(len(tree.feature))
        own = sums[sums["k"] == k]
        g = np.sign(own["g"]) * np.maximum(np.abs(own["g"]) - lasso, 0)
        value[own["leaf"].to_numpy()] = rate * g / (own["h"] + ridge)
        out.append(tree._replace(value=value))
    return out


def training_rows(train: DataFrame, labels: Sequence[str], features: Sequence[str], label: str, start: BoostedModel | None) -> DataFrame:
    """``x``, class number ``y``, a number ``rid`` for sampling, margins ``m`` of ``start``. Rows of a
    class that is not among the labels are left out, as are rows without a label."""
    code = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col(label).cast("string")).cast("int") - 1
    used = train.select(*dict.fromkeys([*features, label]))
    dealt = spread(used).sortWithinPartitions(*used.columns)
    rows = dealt.select(_array(features).alias("x"), code.alias("y"), F.monotonically_increasing_id().alias("rid")).where("y >= 0")
    return materialise(rows.withColumn("m", margins(F.col("x"), None, start.rounds if start else [], len(labels))), "boost-rows")


def grow_round(rows: DataFrame, recent: list[list[Tree]], n: int, cuts: list[np.ndarray], n_classes: int,
               params: Mapping[str, object], number: int) -> tuple[list[Tree], pd.DataFrame]:
    """One tree per class on the residuals of ``rows`` (about ``n``) after the ``recent`` rounds, all classes at
    once, and the sums of residuals and curvatures per class and leaf. Thresholds are numbers of bins."""
    rng = np.random.default_rng([int(params["random_state"]), number])
    shown = max(1, math.ceil(float(params["colsample_bytree"]) * len(cuts) - 1e-9))
    subsets = [sorted(rng.choice(len(cuts), shown, replace=False).tolist()) for _ in range(n_classes)]
    limits = Limits(len(cuts), max(len(c) for c in cuts) + 1, int(params["max_depth"]),
                    max(1, int(float(params["min_child_weight"]))), float(params["gamma"]))
    level = [Node(k, 0, limits.depth, n) for k in range(n_classes)]
    data, residuals = rows.select("b", "y", "m"), _residuals(recent, limits.features, n_classes)
    if n > ROWS_A_TASK:  # several passes read them
        data, residuals = data.mapInArrow(residuals, "x binary, r binary").persist(StorageLevel.MEMORY_AND_DISK), iter
    try:
        return _grown(data, residuals, level, subsets, limits, n_classes)
    finally:
        data.unpersist()


def _grown(data: DataFrame, residuals: Callable, level: list[Node], subsets: list[list[int]], limits: Limits,
           n_classes: int) -> tuple[list[Tree], pd.DataFrame]:
    grown: list[list[list]] = [[[-1, 0, -1, -1]] for _ in range(n_classes)]  # feature, bin, left, right
    trees, sums, small = [_tree(t) for t in grown], [], []
    while level:
        small += [node for node in level if node.rows <= ROWS_A_TASK]
        large, level = [node for node in level if node.rows > ROWS_A_TASK], []
        for a in range(0, len(large), NODES_AT_ONCE):
            some = large[a:a + NODES_AT_ONCE]
            for s in _split_large(data, trees, some, subsets, limits).sort_values("slot").itertuples():
                k, place, depth, _ = some[s.slot]
                if s.feature < 0:
                    sums.append((k, place, s.g, s.h, s.n))
                    continue
                grown[k][place] = [s.feature, s.cut, len(grown[k]), len(grown[k]) + 1]
                for rows in (s.n_left, s.n - s.n_left):
                    level.append(Node(k, len(grown[k]), depth - 1, rows))
                    grown[k].append([-1, 0, -1, -1])
        trees = [_tree(t) for t in grown]
    if small:
        for slot, below in _grow_small(data, residuals, trees, small, subsets, limits).groupby("slot"):
            k, place = small[slot].k, small[slot].number
            names = np.concatenate([[place], np.arange(len(below) - 1) + len(grown[k])])
            inner = below["feature"].to_numpy() >= 0
            left, right = (np.where(inner, names[below[c].to_numpy()], -1) for c in ("left", "right"))
            nodes = list(zip(below["feature"].tolist(), below["cut"].tolist(), left.tolist(), right.tolist()))
            grown[k][place] = nodes[0]
            grown[k] += nodes[1:]
            sums += [(k, *leaf) for leaf in zip(names[~inner].tolist(), *(below[c][~inner].tolist() for c in "ghn"))]
    return [_tree(t) for t in grown], pd.DataFrame(sums, columns=["k", "leaf", "g", "h", "n"])


def _tree(nodes: list[list]) -> Tree:
    feature, cut, left, right = (np.array(c, dtype=np.int64) for c in zip(*nodes))
    return Tree(feature, cut.astype(np.uint8), left, right, np.zeros(len(nodes)))


def _unbinned(tree: Tree, cuts: list[np.ndarray]) -> Tree:
    """The same tree over the features' values."""
    threshold = [float(cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(tree.feature.tolist(), tree.threshold.tolist())]
    return tree._replace(threshold=np.array(threshold))


def fit(train: DataFrame, labels: Sequence[str], stats: dict[str, tuple[float, float]], params: Mapping[str, object],
        features: Sequence[str], label: str = LABEL, start: BoostedModel | None = None) -> BoostedModel:
    """``n_estimators`` rounds on ``train``, behind those of ``start``."""
    k, width = len(labels), len(features)
    done = list(start.rounds) if start else []
    rows = training_rows(train, labels, features, label, start)
    n, cuts = rows.count(), candidate_cuts(rows, width)
    if not n:
        return BoostedModel(list(labels), list(features), dict(stats), done)
    rows = materialise(_advanced(rows.select(binned(F.col("x"), cuts).alias("b"), "y", "rid", "m"), [], width, k), "boost-bins")
    share, recent = int(float(params["subsample"]) * (1 << 20)), []
    first = len(done)
    for number in range(first, first + int(params["n_estimators"])):
        if len(recent) >= WRITE_EVERY:
            rows, recent = materialise(_advanced(rows, recent, width, k), "boost-bins"), []
        drawn = rows.where(f"pmod(xxhash64(rid, {number}, {int(params['random_state'])}), {1 << 20}) < {share}")
        trees, sums = grow_round(drawn, recent, n, cuts, k, params, number)
        if len(sums):
            recent.append(newton_leaves(trees, sums, params))
            done.append([_unbinned(tree, cuts) for tree in recent[-1]])
    return BoostedModel(list(labels), list(features), dict(stats), done)


def staged_log_loss(model: BoostedModel, test: DataFrame, label: str = LABEL) -> DataFrame:
    """(round, log_loss, n): the mean log-loss on ``test`` after each round, all from one pass. Rows
    whose label is unknown to the model or that lack a feature are left out."""
    code = F.array_position(F.array(*[F.lit(c) for c in model.labels]), F.col(label).cast("string")).cast("int") - 1
    rounds, k = model.rounds, len(model.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            y, m = batch.column(1).to_numpy(), np.zeros((batch.num_rows, k))
            lost = []
            for trees in rounds:
                for i, tree in enumerate(trees):
                    m[:, i] += tree.value[tree.leaf(x)]
                top = m.max(axis=1)
                p = np.exp(m[np.arange(len(y)), y] - top) / np.exp(m - top[:, None]).sum(axis=1)
                lost.append(float(-np.log(np.clip(p, EPS, 1 - EPS)).sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(1, len(lost) + 1), pa.int32()), pa.array(lost, pa.float64()),
                 pa.array(np.full(len(lost), len(y)), pa.int64())], names=["round", "lost", "n"])

    rows = test.dropna(subset=model.features).select(_array(model.features).alias("x"), code.alias("y")).where("y >= 0")
    return (rows.mapInArrow(run, "round int, lost double, n long").groupBy("round")
            .agg((F.sum("lost") / F.sum("n")).alias("log_loss"), F.sum("n").alias("n")))


# -- artifact ------------------------------------------------------------------------------

NODES = "round int, class int, node int, feature int, threshold double, left int, right int, value double"


def write(model: BoostedModel, path: str, spark: SparkSession) -> str:
    """Write the trees as a table of nodes; returns the rest of the model as text."""
    frames = [pd.DataFrame({"round": r, "class": k, "node": np.arange(len(t.feature)), **t._asdict()})
              for r, trees in enumerate(model.rounds) for k, t in enumerate(trees)]
    nodes = pd.concat(frames) if frames else pd.DataFrame({c.split()[0]: [] for c in NODES.split(", ")})
    spark.createDataFrame(nodes, NODES).write.mode("overwrite").parquet(f"{path}/nodes")
    return json.dumps({"labels": model.labels, "features": model.features})


def read(path: str, rest: str, stats: dict[str, tuple[float, float]], spark: SparkSession) -> BoostedModel:
    nodes = spark.read.schema(NODES).parquet(f"{path}/nodes").toPandas().sort_values(["round", "class", "node"])
    rounds: list[list[Tree]] = []
    kinds = {"feature": np.int64, "threshold": np.float64, "left": np.int64, "right": np.int64, "value": np.float64}
    for (r, _), t in nodes.groupby(["round", "class"], sort=True):
        if r == len(rounds):
            rounds.append([])
        rounds[-1].append(Tree(*[t[c].to_numpy().astype(kind) for c, kind in kinds.items()]))
    told = json.loads(rest)
    return BoostedModel(told["labels"], told["features"], stats, rounds)
