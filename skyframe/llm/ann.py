"""Approximate nearest neighbours by cross-polytope hashing.

Every table rotates unit vectors with a fast pseudo-rotation (three rounds of random signs and
a Hadamard transform) and assigns each to the nearest signed axis (with ``depth`` 2 to a pair of
axes of two rotations). A query probes the ``probes`` nearest buckets of each of ``tables``
tables. Candidates are reranked by the inner product of the original vectors in double precision.

How many tables and probes are needed depends on the dimension, the rows and above all on the
structure of the vectors, so it is measured (``Plan``): for up to ``sample`` queries of each
dimension, chosen by hash, the true neighbours are found by comparing with every row; the
cheapest (depth, tables, probes) whose tables hold at least ``target`` of them is taken. Vectors in
tight clusters need a few buckets however many rows there are; vectors without structure need a
share of all axes, so their cost per query grows with the rows, as any exact answer's does.

Lengths. The inner product ranks by direction and length, the hash sees directions only. Vectors
are therefore filed by the power of two of their length too, and every query probes its buckets
at all lengths that occur.

Equal vectors form a class first: classes are hashed and compared, their rows are not. A class
keeps its ``k + 1`` smallest distinct ids with the number of rows of each, which is all that any
answer can need, so a vector repeated over a third of the rows costs one comparison. A query whose
id occurs in several classes is compared under that id, and classes that hold nothing else are
passed over. Vectors and queries meet in their buckets; a bucket is dealt into a grid of at most
``block`` vectors by ``block`` queries, so a task's group is bounded. Sizes of buckets are broadcast up
to ``BROADCAST_ROWS`` of them.

Buckets promise nothing about a query that lies apart from the bulk of the vectors: what it
probes may be all but empty. A query that met fewer than ``enough`` classes, or found more than half
of its probed buckets empty, is therefore compared with every class, in a grid of the same blocks
(``compare_all``): so no list is shorter than the candidates allow.

Defined cases: vectors that are null, zero or hold a null or a non-finite component take no
part; vectors of different dimensions have no product, each dimension is searched by itself;
components keep their type (float or double), only the hash is computed in floats; an id may repeat
(each row is a candidate, and a row is no candidate for a query with its own id); a null id takes
no part; fewer candidates than ``k`` give shorter lists; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

BROADCAST_ROWS = 1 << 20
MAX_TABLES = 16
MAX_PROBES = 4096
BUCKET_COST = 1000  # compared rows that take about the time of one probed bucket
DEEP_ROWS = 1 << 20  # from here on plans with two rotations a table are measured too


class CrossPolytope:
    def __init__(self, dimension: int, tables: int, depth: int = 1, seed: int = 3):
        self.dimension, self.tables, self.depth = dimension, tables, depth
        self.size = 1 << max(0, dimension - 1).bit_length()
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1.0, 1.0], dtype=np.float32), (tables * depth, 3, self.size))

    def _hadamard(self, x: np.ndarray) -> np.ndarray:
        half = 1
        while half < self.size:
            pairs = x.reshape(len(x), -1, 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), -1)
            half *= 2
        return x / np.float32(np.sqrt(self.size))

    def rotate(self, x: np.ndarray, rotation: int) -> np.ndarray:
        y = np.zeros((len(x), self.size), dtype=np.float32)
        y[:, :self.dimension] = x / np.linalg.norm(x, axis=1, keepdims=True)
        for signs in self.signs[rotation]:
            y = self._hadamard(y * signs)
        return y

    def axes(self, x: np.ndarray, rotation: int) -> np.ndarray:
        """Scores of all signed axes."""
        y = self.rotate(x, rotation)
        return np.concatenate([y, -y], axis=1)

    def buckets(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Numbers of the ``probes`` best buckets in every table, all tables' in a row."""
        axes, rows = 2 * self.size, np.arange(len(x))[:, None]
        out = []
        for table in range(self.tables):
            code, total = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1), dtype=np.float32)
            for level in range(self.depth):
                both = self.axes(x, table * self.depth + level)
                near = _largest(both, probes)
                # every way to go on from the best so far with one of the best axes here
                code = (code[:, :, None] * axes + near[:, None, :]).reshape(len(x), -1)
                total = (total[:, :, None] + both[rows, near][:, None, :]).reshape(len(x), -1)
                best = _largest(total, probes)
                code, total = code[rows, best], total[rows, best]
            out.append(code + table * axes ** self.depth)
        return np.concatenate(out, axis=1)


def _largest(x: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest values of each row, in any order."""
    if n >= x.shape[1]:
        return np.tile(np.arange(x.shape[1]), (len(x), 1))
    return np.argpartition(-x, n - 1, axis=1)[:, :n]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Directions as floats, whatever the lengths."""
    x = x.astype(np.float64)
    return (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32)


# -- choice of tables and probes -----------------------------------------------------------

class Plan(NamedTuple):
    depth: int
    tables: int
    probes: int
    recall: float  # on the sampled queries
    visited: float  # rows compared per query, as a share of all


def _ranks(polytope: CrossPolytope, table: int, queries: np.ndarray, rows: np.ndarray, asked: np.ndarray,
           which: np.ndarray) -> np.ndarray:
    """For pairs (number of a query, sorted, and of a row): how many buckets of the table the query
    probes before the row's."""
    levels = range(table * polytope.depth, (table + 1) * polytope.depth)
    scores = [polytope.axes(queries, r) for r in levels]
    own = [np.argmax(polytope.axes(rows, r), axis=1) for r in levels]
    out = np.zeros(len(asked), dtype=np.int64)
    ends = np.searchsorted(asked, np.arange(len(queries) + 1))
    for q, (begin, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        score = sum(s[q][o[which[begin:end]]] for s, o in zip(scores, own))
        ordered = np.sort(scores[-1][q])
        if polytope.depth > 1:  # pairs of axes with a larger sum
            score = score[:, None] - scores[0][q][None, :] + np.float32(1e-6)
        out[begin:end] = (len(ordered) - np.searchsorted(ordered, score, side="right")).reshape(end - begin, -1).sum(axis=1)
    return out


def choose(queries: np.ndarray, near: list[np.ndarray], rows: np.ndarray, n_rows: int, target: float,
           depths: tuple[int, ...] = (1,)) -> Plan:
    """The cheapest plan that finds ``target`` of the pairs (query, one of its ``near`` vectors). What a
    plan visits is read off ``rows``, a sample of the ``n_rows`` of the table; a probed bucket is
    as dear as ``BUCKET_COST`` compared rows."""
    dimension = queries.shape[1]
    complete = Plan(1, 1, 2 * CrossPolytope(dimension, 1).size, 1.0, 1.0)
    asked = np.repeat(np.arange(len(queries)), [len(n) for n in near])
    if not len(asked):
        return complete
    queries, rows, wanted = _scaled(queries), _scaled(rows), _scaled(np.concatenate(near))
    every, each = np.repeat(np.arange(len(queries)), len(rows)), np.tile(np.arange(len(rows)), len(queries))
    best, least = complete, float(n_rows + BUCKET_COST * complete.probes)
    for depth in depths:
        polytope = CrossPolytope(dimension, MAX_TABLES, depth)
        reach = np.full(len(asked), np.iinfo(np.int64).max)  # probes that find a pair in one of the tables so far
        seen: list[np.ndarray] = []
        for table in range(MAX_TABLES):
            reach = np.minimum(reach, _ranks(polytope, table, queries, wanted, asked, np.arange(len(asked))))
            seen.append(np.sort(_ranks(polytope, table, queries, rows, every, each)))
            probes = int(np.sort(reach)[int(np.ceil(target * len(reach))) - 1]) + 1
            visited = sum(int(np.searchsorted(s, probes)) for s in seen) / len(every)
            price = visited * n_rows + BUCKET_COST * probes * (table + 1)
            if price < least and probes <= MAX_PROBES:
                best, least = Plan(depth, table + 1, probes, float((reach < probes).mean()), visited), price
    return best


# -- rows, classes and queries -------------------------------------------------------------

def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components in a row, and where each vector begins and how many it has."""
    size = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size, size


def usable_rows(vectors: DataFrame, asked: Column) -> DataFrame:
    """``vec_id, vector, asked`` of the rows that take part, with the dimension, the power of two of
    the length (``band``) and a 128-bit digest of the vector (``a, b``)."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, begin, size = _ragged(batch.column(1))
            owner = np.repeat(np.arange(len(size)), size)
            top = np.zeros(len(size))
            np.maximum.at(top, owner, np.abs(np.nan_to_num(flat.astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)))
            fine = (np.bincount(owner, weights=~np.isfinite(flat), minlength=len(size)) == 0) & (top > 0)
            at = np.flatnonzero(fine)
            squares = np.bincount(owner, weights=np.where(fine[owner], flat / np.where(top > 0, top, 1)[owner], 0.0) ** 2, minlength=len(size))
            band = np.floor(np.log2(top[at]) + np.log2(squares[at]) / 2)
            digests = b"".join(hashlib.blake2b((flat[b:b + n] + 0.0).tobytes(), digest_size=16).digest()
                               for b, n in zip(begin[at].tolist(), size[at].tolist()))
            both = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(size[at].astype(np.int32)), pa.array(band.astype(np.int32)),
                 pa.array(both[:, 0]), pa.array(both[:, 1])],
                names=["vec_id", "vector", "asked", "dimension", "band", "a", "b"])

    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"),
                    F.coalesce(asked, F.lit(False)).alias("asked"))
            .mapInArrow(run, f"vec_id long, vector {kind}, asked boolean, dimension int, band int, a long, b long"))


def classes_of(rows: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their ``k + 1`` smallest ids (``ids``: id and its number of rows)."""
    few = (ids.withColumn("n", F.row_number().over(W.partitionBy("a", "b").orderBy("vec_id"))).where(F.col("n") <= k + 1)
           .groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n_rows"))).alias("ids")))
    vectors = rows.groupBy("a", "b").agg(F.first("vector").alias("vector"), F.first("dimension").alias("dimension"),
                                         F.first("band").alias("band"))
    least = F.get("ids", F.lit(0))["vec_id"]
    return vectors.join(few, ["a", "b"]).select(
        "a", "b", "ids", "vector", "dimension", "band", least.alias("least"),
        F.coalesce(F.get("ids", F.lit(1))["vec_id"], least).alias("second"), F.monotonically_increasing_id().alias("class"))


def queries_of(classes: DataFrame, ids: DataFrame) -> DataFrame:
    """One entry per asked vector; an id asked in several classes has an entry of its own (``own``) in
    each, since it may fill any number of classes that are no answer to it."""
    asked = ids.where("asked")
    several = asked.select("vec_id").join(ids.select("vec_id"), "vec_id").groupBy("vec_id").agg(F.count(F.lit(1)).alias("m"))
    marked = asked.select("a", "b", "vec_id").join(several, "vec_id")
    entries = marked.select("a", "b", F.when(F.col("m") > 1, F.col("vec_id")).alias("own")).distinct()
    return (classes.select("a", "b", "vector", "dimension").join(entries, ["a", "b"])
            .withColumn("query", F.monotonically_increasing_id()))


def hashed(side: DataFrame, plans: dict[int, Plan], probing: bool) -> DataFrame:
    """``side`` with ``buckets``: its vector's own ones, or those a query probes. Dimensions without a plan have few rows;
    one table is probed whole."""
    names = side.columns
    at_vector = names.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, begin, size = _ragged(batch.column(at_vector))
            out: list[list[int]] = [[]] * len(size)
            for dimension in np.unique(size).tolist():
                at = np.flatnonzero(size == dimension)
                plan = plans.get(dimension) or Plan(1, 1, 2 * CrossPolytope(dimension, 1).size, 1.0, 1.0)
                polytope = CrossPolytope(dimension, plan.tables, plan.depth)
                for some in np.array_split(at, max(1, len(at) * dimension * (plan.probes if probing else 1) >> 22)):
                    x = _scaled(flat[begin[some][:, None] + np.arange(dimension)])
                    for i, found in zip(some.tolist(), polytope.buckets(x, plan.probes if probing else 1).tolist()):
                        out[i] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*names, "buckets"])

    return side.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in side.schema), "buckets array<long>"]))


# -- comparing -----------------------------------------------------------------------------

NEAR = pa.struct([("class", pa.int64()), ("score", pa.float64()), ("least", pa.int64())])


def best_pairs(queries: np.ndarray, owns: list[int | None], vectors: np.ndarray, least: np.ndarray, second: np.ndarray,
               keep: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per query the row numbers of the ``keep`` vectors with the largest inner products (ties by the
    least id that is not the query's own), those products in double precision, summed in one
    order wherever a pair is met, and those ids."""
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        rough = q @ v.T
    out = []
    for one, row, own in zip(q, rough, owns):
        first, near = least, np.arange(len(v))
        if own is not None:
            first = np.where(least == own, second, least)
            near = np.flatnonzero(first != own)
        if len(near) > keep and np.isfinite(row).all():  # rough products may differ from exact ones in the last bits
            edge = np.partition(row[near], len(near) - keep)[len(near) - keep]
            near = near[row[near] >= edge - 1e-9 * max(1.0, np.abs(row).max())]
        exact = np.sum(one[None, :] * v[near], axis=1)
        order = np.lexsort((first[near], -exact))[:keep]
        out.append((near[order], exact[order], first[near[order]]))
    return out


def sides(vectors: DataFrame, queries: DataFrame, block: int) -> DataFrame:
    """Blocks of vectors (nv) and of queries (nq) in every bucket that holds both; a query's bucket is
    one bucket in every band that has it."""
    keys = ["dimension", "bucket"]
    nv = vectors.groupBy(*keys, "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nv"))
    nq = queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nq"))
    sizes = materialise(nv.join(nq, keys), "ann-sizes")
    return F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes


def compare(vectors: DataFrame, queries: DataFrame, sizes: DataFrame, keep: int) -> DataFrame:
    """(query, near) of every group (dimension, bucket, band, i, j): the query's best classes there."""
    def dealt(side: DataFrame, name: str, keys: list[str], own: str, other: str, i: str, j: str, extra: list[Column]) -> DataFrame:
        return (side.join(sizes, keys)
                .select("dimension", "bucket", "band", F.col(name).alias("name"), "vector", *extra,
                        F.pmod(F.xxhash64(name), F.col(own)).cast("int").alias(i),
                        F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(j)))

    none = F.lit(None).cast("long")
    mine = dealt(vectors, "class", ["dimension", "bucket", "band"], "nv", "nq", "i", "j",
                 [F.col("least").alias("least"), F.col("second").alias("second"), F.lit(False).alias("is_query")])
    theirs = dealt(queries, "query", ["dimension", "bucket"], "nq", "nv", "j", "i",
                   [F.col("own").alias("least"), none.alias("second"), F.lit(True).alias("is_query")])
    placed = mine.unionByName(theirs)
    parts = shuffle_partitions(placed.sparkSession)

    def group(queries: list, vectors: list) -> list:
        out = []
        if queries and vectors:
            names, least, second = (np.array([r[i] for r in vectors]) for i in (0, 1, 2))
            v = np.stack([r[3] for r in vectors])
            for begin in range(0, len(queries), 256):
                some = queries[begin:begin + 256]
                found = best_pairs(np.stack([r[3] for r in some]), [r[1] for r in some], v, least, second, keep)
                out += [(r[0], names[at], score, first) for r, (at, score, first) in zip(some, found)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, vectors = None, [], []

        def emit() -> Iterator[pa.RecordBatch]:
            out = group(queries, vectors)
            if out:
                lists = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate([o[i] for o in out]), t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()))],
                    fields=list(NEAR))
                offsets = np.cumsum([0, *[len(o[1]) for o in out]])
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists)], names=["query", "near"])

        for batch in batches:
            flat, begin, size = _ragged(batch.column(9))
            x = [flat[a:a + n] for a, n in zip(begin.tolist(), size.tolist())]
            keys = zip(*[batch.column(i).to_pylist() for i in range(9)])
            for row, (dimension, bucket, band, i, j, is_query, name, least, second) in enumerate(keys):
                if at != (dimension, bucket, band, i, j):
                    yield from emit()
                    at, queries, vectors = (dimension, bucket, band, i, j), [], []
                (queries if is_query else vectors).append((name, least, second, x[row]))
        yield from emit()

    group_of = ["dimension", "bucket", "band", "i", "j"]
    return (placed.repartition(parts, *group_of).sortWithinPartitions(*group_of)
            .select(*group_of, "is_query", "name", "least", "second", "vector")
            .mapInArrow(run, "query long, near array<struct<class:long,score:double,least:long>>")
            .select("query", F.inline("near")))


def compare_all(classes: DataFrame, queries: DataFrame, block: int, keep: int) -> DataFrame:
    """The same for all queries and all vectors of a dimension: one bucket, exact."""
    zero = F.lit(0).cast("long").alias("bucket")
    vectors = classes.select("class", "least", "second", "vector", "dimension", F.lit(0).alias("band"), zero)
    queries = queries.select("query", "own", "vector", "dimension", zero)
    return compare(vectors, queries, sides(vectors, queries, block), keep)


def best(met: DataFrame, n: int) -> DataFrame:
    """The ``n`` best classes of each query, ties by least id."""
    w = W.partitionBy("query").orderBy(F.desc("score"), "least")
    return (met.groupBy("query", "class").agg(F.max("score").alias("score"), F.min("least").alias("least"))
            .withColumn("n", F.row_number().over(w)).where(F.col("n") <= n))


def plans_of(classes: DataFrame, queries: DataFrame, k: int, target: float, sample: int, block: int,
             dimensions: int = 64) -> dict[int, Plan]:
    """A plan for each of the ``dimensions`` dimensions with the most vectors, measured on up to ``sample`` queries."""
    sizes = (classes.groupBy("dimension").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dimension")
             .limit(dimensions).collect())
    of = {r["dimension"]: r["n"] for r in sizes}
    if not of:
        return {}
    # vectors that come to the driver: at most 2^24 components for each of the two samples
    wanted = F.greatest(F.lit(16), F.least(F.lit(sample), (F.lit(1 << 24) / (F.col("dimension") * (k + 1) * len(of))).cast("int")))
    drawn = W.partitionBy("dimension").orderBy("h")
    chosen = materialise(queries.where(F.col("dimension").isin(list(of))).withColumn("h", F.xxhash64("query", "own"))
                         .withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= wanted).drop("h", "r"), "ann-sample")
    near = best(compare_all(classes, chosen, block, k + 1), k).select("query", "class").join(
        classes.select("class", F.col("vector").alias("near")), "class").select("query", "near")
    rows = (classes.where(F.col("dimension").isin(list(of))).withColumn("h", F.xxhash64("a", "b"))
            .withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= 4 * wanted).select("dimension", "vector"))
    asked, found, seen = {}, {}, {}
    for r in chosen.select("dimension", "query", "vector").collect():
        asked.setdefault(r["dimension"], {})[r["query"]] = np.array(r["vector"])
    for r in near.collect():
        found.setdefault(r["query"], []).append(np.array(r["near"]))
    for r in rows.collect():
        seen.setdefault(r["dimension"], []).append(np.array(r["vector"]))
    out = {}
    for dimension, some in asked.items():
        lists = [np.array(found.get(q, [])).reshape(-1, dimension) for q in some]
        out[dimension] = choose(np.array(list(some.values())), lists, np.array(seen[dimension]), of[dimension], target,
                                (1, 2) if of[dimension] >= DEEP_ROWS else (1,))
    return out


def nearest(vectors: DataFrame, asked: Column, k: int = 20, target: float = 0.95, sample: int = 128, block: int = 2048,
            plan: Plan | None = None, enough: int | None = None) -> DataFrame:
    """For every row (vec_id, embedding) where ``asked`` holds: query_id, rank, vec_id, score. ``plan``
    replaces the measured one."""
    rows = materialise(usable_rows(vectors, asked), "ann-rows")
    ids = materialise(rows.groupBy("a", "b", "vec_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("asked").alias("asked")), "ann-ids")
    classes = materialise(classes_of(rows, ids, k), "ann-classes")
    queries = materialise(queries_of(classes, ids), "ann-queries")
    plans = plans_of(classes, queries, k, target, sample, block) if plan is None else {
        r["dimension"]: plan for r in classes.select("dimension").distinct().limit(1 << 16).collect()}

    probed = materialise(hashed(queries, plans, True), "ann-probed")
    own = materialise(hashed(classes.select("class", "least", "second", "vector", "dimension", "band"), plans, False), "ann-codes")
    mine = own.select("class", "least", "second", "vector", "dimension", "band", F.explode("buckets").alias("bucket"))
    theirs = probed.select("query", "own", "vector", "dimension", F.explode("buckets").alias("bucket"))
    sizes = sides(mine, theirs, block)
    enough = max(k + 1, 4 * k + 1 if enough is None else enough)
    near = materialise(best(compare(mine, theirs, sizes, k + 1), enough), "ann-near")

    filled = (probed.select("query", F.size("buckets").alias("probes"), "dimension", F.explode("buckets").alias("bucket"))
              .join(sizes.select("dimension", "bucket").distinct(), ["dimension", "bucket"])
              .groupBy("query", "probes").agg(F.count(F.lit(1)).alias("full")).where(F.col("full") * 2 >= F.col("probes")))
    served = near.where(F.col("n") == enough).select("query").join(filled, "query")
    short = materialise(queries.join(served, "query", "left_anti"), "ann-short")
    if not short.isEmpty():
        near = (near.join(short.select("query"), "query", "left_anti")
                .unionByName(best(compare_all(classes, short, block, k + 1), k + 1)))
    ranked = near.where(F.col("n") <= k + 1).join(classes.select("class", "ids"), "class")
    lists = (ranked.groupBy("query").agg(F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(
        (-F.col("score")).alias("minus"), i["vec_id"].alias("vec_id"), i["n_rows"].alias("n_rows")))))).alias("found")))
    named = materialise(lists.join(queries.select("query", "a", "b", "own"), "query").select("a", "b", "own", "found"), "ann-lists")
    others = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    repeated = F.flatten(F.transform(others, lambda x: F.array_repeat(x, F.least(x["n_rows"], F.lit(k)).cast("int"))))
    # an id with entries of its own is answered by them
    alone = named.select("a", "b", F.col("own").alias("vec_id")).where(F.col("vec_id").isNotNull())
    asking = rows.where("asked").select("vec_id", "a", "b").join(alone.withColumn("named", F.lit(True)), ["a", "b", "vec_id"], "left")
    return (asking.select(F.col("vec_id").alias("query_id"), "a", "b", F.when(F.col("named"), F.col("vec_id")).alias("own_"))
            .join(named.withColumnsRenamed({"a": "a_", "b": "b_"}),
                  (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")) & F.col("own").eqNullSafe(F.col("own_")))
            .select("query_id", F.posexplode(F.slice(repeated, 1, k)).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
                    (-F.col("x.minus")).alias("score")))
