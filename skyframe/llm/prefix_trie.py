"""Trie of conversation prefixes, screened by a count-min sketch.

A node is a distinct sequence of first d turns (role, text); conversations that begin with it
are its members. The root holds all conversations.

Digests. A turn is its SHA-256 (``turn_rows``); a prefix is a polynomial in its turns modulo
2^61 - 1, twice with different bases, so the digest of a longer prefix follows from a shorter
one and two halves of a conversation can be added up. Rows of digests, not texts, are sorted by
(conversation, turn) into ranges and streamed (``_stream``). A range ends anywhere, also inside
a conversation; what the ranges before hold of a conversation is added afterwards from at most
two small rows a range (``_carries``). A conversation that holds a third of all rows is thus
many tasks' work.

Screening. Every prefix is counted in a count-min sketch of two rows; a bit a cell says whether
its count exceeds one (``sketch``). A prefix with a clear bit has one member: its node is emitted
where it stands. Only the others are grouped exactly, and a check proves that no two different
prefixes were taken for one: all rows of a group must agree in depth, last turn (SHA-256) and the
digest before it. The sketch takes eight cells a prefix and at most ``max_cells`` a row (two times
16 MB as sent to the tasks); beyond some hundred million prefixes it lets more of them through to
the exact grouping, and results stay the same.

Subtrees. A prefix of one member adds nothing to the saved tokens and is one leaf, so sums
over subtrees run over shared nodes only, by pointer doubling: after round k a node has
summed its descendants nearer than 2^k, so the rounds grow with the logarithm of the depth. The
ancestor 2^k levels up is looked up by (conversation, depth), a key without repeats.

Defined cases: turns are ordered by ``turn`` (null first), equal turns by their digest; null role
or text is empty; rows that repeat are turns of their own; rows without a conv_id belong to no
conversation and are left out; a conversation may be left without turns and is then a member of the
root alone; an empty table has no nodes; other columns are ignored. The hash of the ends of one
node is one running SHA-256: one task streams that node's ids, sorted, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import modular
from .common import materialise, shuffle_partitions

BASES = (1_148_719_364_817_264_239, 871_203_561_937_482_657)
POWERS = tuple(modular.Powers(b) for b in BASES)
P = modular.PRIME
PREFIX = ("conv_id long, depth long, d1 long, d2 long, p1 long, p2 long, key binary, words long, last boolean")
RUN = "h int, shift int, turns long, k1 long, k2 long"


# -- turns ---------------------------------------------------------------------------------

def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, key`` (SHA-256 of role and text), ``words`` of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return materialise(conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")), "trie-turns")


def leads(rows: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """How every conversation begins: ``conv_id, n_own, h`` (own turns it gives up at the start),
    ``lead`` (the first ``h`` turns of conversation ``base`` instead) and ``own`` (the turns given
    up). ``taken`` is ``h`` and at most ``most``, so both lists are short."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    heads = materialise(rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
                        .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rn", "key", "words"))).alias("head")),
                        "trie-heads")
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    convs = (counts.join(heads, "conv_id").select("conv_id", "n_own", taken.cast("int").alias("h"),
                                                  base.alias("base"), "head"))
    led = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    none = F.slice("head", 1, 0)
    return materialise(convs.join(led, "base", "left").select(
        "conv_id", "n_own", "h", F.slice("head", F.lit(1), F.col("h")).alias("own"),
        F.coalesce(F.slice("base_head", F.lit(1), F.col("h")), none).alias("lead")), "trie-leads")


# -- digests -------------------------------------------------------------------------------

def _values(key: bytes) -> tuple[int, int]:
    return tuple(int.from_bytes(key[8 * i:8 * i + 8], "little") % P for i in range(2))


def _polynomial(keys: list[bytes], at: int = 0) -> list[int]:
    out = [0, 0]
    for j, key in enumerate(keys):
        for i, v in enumerate(_values(key)):
            out[i] = (out[i] + v * pow(BASES[i], at + j, P)) % P
    return out


def lead_prefixes(begin: DataFrame) -> DataFrame:
    """Prefixes of depth 0 to the end of each conversation's lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                keys = [x["key"] for x in r["lead"]]
                total = len(keys) + max(0, r["n_own"] - r["h"])
                before = [None, None]
                for d in range(len(keys) + 1):
                    here = _polynomial(keys[:d])
                    rows.append((r["conv_id"], d, *here, *before, keys[d - 1] if d else b"",
                                 r["lead"][d - 1]["words"] if d else 0, d == total))
                    before = here
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), _PREFIX_TYPES)], names=_PREFIX_NAMES)

    return begin.mapInArrow(run, PREFIX)


def lead_headers(begin: DataFrame) -> DataFrame:
    """What a conversation's own prefixes need to know of its lead: its polynomial less that of
    the own turns given up (``k1, k2``), the move of the turns behind (``shift``), its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                led, own = [x["key"] for x in r["lead"]], [x["key"] for x in r["own"]]
                shift = len(led) - r["h"]
                k = [(a - b) % P for a, b in zip(_polynomial(led), _polynomial(own, shift))]
                rows.append((r["conv_id"], r["h"], shift, len(led) + max(0, r["n_own"] - r["h"]), *k))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                             names=["conv_id", "h", "shift", "turns", "k1", "k2"])

    return begin.mapInArrow(run, "conv_id long, " + RUN)


_PREFIX_NAMES = ["conv_id", "depth", "d1", "d2", "p1", "p2", "key", "words", "last"]
_PREFIX_TYPES = [pa.int64()] * 6 + [pa.binary(), pa.int64(), pa.bool_()]
_RUN_NAMES = ["h", "shift", "turns", "k1", "k2"]
_RUN_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
_STREAMED = ("part int, conv_id long, i long, o1 long, o2 long, key binary, words long, summary boolean, " + RUN)


def _key_values(keys: pa.Array) -> list[np.ndarray]:
    flat = np.frombuffer(b"".join(keys.to_pylist()), dtype="<u8").reshape(-1, 4)
    return [modular.reduce(flat[:, i]) for i in range(2)]


def _stream(sorted_rows: DataFrame) -> DataFrame:
    """Numbers and polynomial sums of the turns of each conversation within its range. A header
    comes before its conversation's turns and is copied to them. The first and the last
    conversation of a range also come as a summary row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, n, sums, info = None, 0, [0, 0], [None] * 5  # the conversation the last batch ended in
        first = True

        def summary() -> pa.RecordBatch:
            row = [part, conv, n, *sums, None, None, True, *info]
            types = [pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.int64(), pa.bool_(), *_RUN_TYPES]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)],
                                              names=["part", "conv_id", "i", "o1", "o2", "key", "words", "summary", *_RUN_NAMES])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            turn = batch.column("kind").to_numpy() == 1
            starts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
            run_of = np.searchsorted(starts, np.arange(len(ids)), side="right") - 1
            goes_on = conv is not None and ids[0] == conv
            if conv is not None and not goes_on and first:
                yield summary()
                first = False
            # numbers of the turns in their run, after those of the batches before
            count = np.cumsum(turn)
            before = count[starts] - turn[starts]
            begin = np.zeros(len(starts), dtype=np.int64)
            begin[0] = n if goes_on else 0
            number = count - 1 - before[run_of] + begin[run_of]
            keys = batch.column("key").fill_null(bytes(32))
            values = _key_values(keys)
            outs, totals = [], []
            for lane in range(2):
                terms = np.where(turn, modular.mul(values[lane], POWERS[lane](np.maximum(number, 0))), np.uint64(0))
                running = modular.running_sum(terms)
                start = modular.sub(running[starts], terms[starts])
                start[0] = (P - sums[lane]) % P if goes_on else start[0]
                outs.append(modular.sub(running, start[run_of]))
            # headers go to all rows of their run
            header = np.flatnonzero(~turn)
            source = np.full(len(starts), -1)
            source[run_of[header]] = header
            told = []
            for name, kind, old in zip(_RUN_NAMES, _RUN_TYPES, info):
                column = batch.column(name)
                taken = column.take(pa.array(np.where(source < 0, 0, source)[run_of]))
                known = (source >= 0)[run_of]
                rest = pa.scalar(old if goes_on else None, kind)
                carried = pa.array(run_of == 0)
                taken = pc.if_else(pa.array(known), taken, pc.if_else(carried, rest, pa.scalar(None, kind)))
                told.append(taken.cast(kind))
            if first and len(starts) > 1:
                end = starts[1] - 1
                conv, n, sums = int(ids[end]), int(number[end]) + 1, [int(o[end]) for o in outs]
                info = [c[int(end)].as_py() for c in told]
                yield summary()
                first = False
            conv, n, sums = int(ids[-1]), int(number[-1]) + 1, [int(o[-1]) for o in outs]
            info = [c[len(ids) - 1].as_py() for c in told]
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part), pa.int32()), batch.column("conv_id"), pa.array(number),
                 *[pa.array(o.astype(np.int64)) for o in outs], batch.column("key"), batch.column("words"),
                 pa.array(np.zeros(len(ids), dtype=bool)), *told],
                names=["part", "conv_id", "i", "o1", "o2", "key", "words", "summary", *_RUN_NAMES])
            yield out.filter(pa.array(turn))
        if conv is not None:
            yield summary()

    return sorted_rows.mapInArrow(run, _STREAMED)


def _carries(streamed: DataFrame) -> dict[int, tuple]:
    """What the first conversation of a range has in the ranges before it: (conversation, turns,
    sums, header), by range. Collects at most two rows a range."""
    rows = sorted(streamed.where("summary").drop("key", "words").collect(), key=lambda r: (r["part"], r["conv_id"]))
    out: dict[int, tuple] = {}
    open_conv, n, sums, info = None, 0, [0, 0], None
    for r in rows:
        if r["conv_id"] == open_conv:
            out[r["part"]] = (open_conv, n, tuple(sums), info)
            sums = [(s + pow(b, n, P) * r[o]) % P for s, b, o in zip(sums, BASES, ("o1", "o2"))]
            n += r["i"]
        else:
            open_conv, n, sums = r["conv_id"], r["i"], [r["o1"], r["o2"]]
            info = tuple(r[c] for c in _RUN_NAMES)
    return out


def own_prefixes(streamed: DataFrame) -> DataFrame:
    """Prefixes that end in an own turn of their conversation."""
    carries = _carries(streamed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv = batch.column("part").to_numpy(), batch.column("conv_id").to_numpy()
            i = batch.column("i").to_numpy().copy()
            sums = [batch.column(c).to_numpy().astype(np.uint64) for c in ("o1", "o2")]
            info = [batch.column(c).cast(pa.int64()).fill_null(0).to_numpy().copy() for c in _RUN_NAMES]
            for p in np.unique(part).tolist():
                if p not in carries:
                    continue
                open_conv, n, before, known = carries[p]
                rows = (part == p) & (conv == open_conv)
                for lane in range(2):
                    moved = modular.mul(sums[lane][rows], np.uint64(pow(BASES[lane], n, P)))
                    sums[lane][rows] = modular.add(moved, np.uint64(before[lane]))
                i[rows] += n
                for column, value in zip(info, known):
                    column[rows] = value
            h, shift, turns, *k = info
            own = i >= h
            shifts, which = np.unique(shift, return_inverse=True)
            values = _key_values(batch.column("key"))
            digests = []
            for lane in range(2):
                power = np.array([pow(BASES[lane], s, P) for s in shifts.tolist()], dtype=np.uint64)
                there = modular.add(modular.mul(sums[lane], power[which]), k[lane].astype(np.uint64))
                last = modular.mul(values[lane], POWERS[lane](np.maximum(i + shift, 0)))
                digests.append((there, modular.sub(there, last)))
            depth = i + shift + 1
            out = pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(depth), *[pa.array(d[0].astype(np.int64)) for d in digests],
                 *[pa.array(d[1].astype(np.int64)) for d in digests], batch.column("key"), batch.column("words"),
                 pa.array(depth == turns)], names=_PREFIX_NAMES)
            yield out.filter(pa.array(own))

    return streamed.where("not summary").mapInArrow(run, PREFIX)


def prefixes(rows: DataFrame, begin: DataFrame) -> DataFrame:
    """Every prefix of every conversation: its depth, digest, the digest one turn before, its last
    turn, and whether the conversation ends there."""
    n = shuffle_partitions(rows.sparkSession)
    headers = lead_headers(begin)
    both = headers.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = materialise(both, "trie-rows")
    order = [F.col("conv_id"), F.col("kind"), F.col("turn").asc_nulls_first(), F.col("key")]
    streamed = materialise(_stream(both.repartitionByRange(n, *order).sortWithinPartitions(*order)), "trie-streamed")
    return materialise(lead_prefixes(begin).unionByName(own_prefixes(streamed)), "trie-prefixes")


# -- screening -----------------------------------------------------------------------------

def sketch(found: DataFrame, max_cells: int) -> tuple[int, np.ndarray]:
    """(cells a row, bits of the cells counted more than once, the second row's behind the
    first's). Cells are counted by Spark, packed by its bitmap functions; the bits are at most
    2 * ``max_cells`` whatever the input."""
    count = found.count()
    width = min(max_cells, max(1 << 15, 1 << (8 * count).bit_length()))
    cells = found.select(F.explode(F.array(*_cells("d1", "d2", width))).alias("cell"))
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    packed = (shared.groupBy(F.bitmap_bucket_number(F.col("cell") + 1).alias("bucket"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") + 1)).alias("bits")).toPandas())
    bits = np.zeros((2 * width >> 15, 4096), dtype=np.uint8)
    for bucket, b in zip(packed["bucket"], packed["bits"]):
        bits[bucket - 1] = np.frombuffer(bytes(b), dtype=np.uint8)
    return width, bits.reshape(-1)


def _cells(a: str, b: str, width: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(r), a, b), F.lit(width)) + r * width for r in range(2)]


def screen(found: DataFrame, max_cells: int) -> DataFrame:
    """``found`` with ``many`` and ``many_before``: whether the prefix, and the one a turn before, may
    have more than one member. False is certain."""
    width, bits = sketch(found, max_cells)
    shared = found.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def both_set(one, two):
        bits = shared.value

        def get(c):
            c = c.to_numpy()
            return (bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1
        return pd.Series((get(one) & get(two)).astype(bool))

    asked = found.withColumn("many", both_set(*_cells("d1", "d2", width)))
    before = [F.coalesce(c, F.lit(0)) for c in _cells("p1", "p2", width)]
    return asked.withColumn("many_before", both_set(*before) & (F.col("depth") > 0))


# -- nodes ---------------------------------------------------------------------------------

def shared_nodes(screened: DataFrame) -> DataFrame:
    """Exact nodes of the prefixes that may be shared, with a proof that each is one prefix."""
    nodes = materialise(
        screened.where("many").groupBy("d1", "d2")
        .agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
             F.max("depth").alias("depth_"), F.min("key").alias("key"), F.max("key").alias("key_"),
             F.min("p1").alias("p1"), F.max("p1").alias("p1_"), F.min("p2").alias("p2"), F.max("p2").alias("p2_"),
             F.max("words").alias("words"), F.count_if("last").alias("n_ends"), F.max("many_before").alias("ask")), "trie-nodes")
    differs = ~(F.col("depth").eqNullSafe(F.col("depth_")) & F.col("key").eqNullSafe(F.col("key_"))
                & F.col("p1").eqNullSafe(F.col("p1_")) & F.col("p2").eqNullSafe(F.col("p2_")))
    if nodes.where(differs).limit(1).count():
        raise ValueError("two different prefixes have the same digest")
    return nodes.drop("depth_", "key_", "p1_", "p2_")


def subtree_sums(shared: DataFrame, screened: DataFrame) -> DataFrame:
    """``shared`` (d1, d2, conv_id, depth, leaves, saved) with both sums taken over subtrees."""
    places = screened.where("many").select("conv_id", F.col("depth").alias("up"), F.col("d1").alias("a1"), F.col("d2").alias("a2"))
    deepest = shared.agg(F.max("depth").alias("d")).first()["d"] or 0
    step = 1
    while step <= deepest:
        moved = (shared.where(F.col("depth") >= step).withColumn("up", F.col("depth") - step)
                 .join(places, ["conv_id", "up"])
                 .groupBy("a1", "a2").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
        summed = shared.join(moved, (F.col("d1") == F.col("a1")) & (F.col("d2") == F.col("a2")), "left")
        zero = F.lit(0).cast("long")
        shared = materialise(summed.select(
            "d1", "d2", "conv_id", "depth", (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved")), "trie-sums")
        step *= 2
    return shared


def end_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids that end in each node (d1, d2, conv_id), streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([digest.hexdigest()])],
                                              names=["d1", "d2", "ends_sha256"])

        for batch in batches:
            if not batch.num_rows:
                continue
            d1, d2, ids = (c.to_numpy() for c in batch.columns)
            edge = np.flatnonzero((np.diff(d1) != 0) | (np.diff(d2) != 0)) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)]):
                text = ",".join(map(str, ids[s:e].tolist())).encode()
                if node == (d1[s], d2[s]):
                    digest.update(b"," + text)
                    continue
                if node is not None:
                    yield row()
                node, digest = (d1[s], d2[s]), hashlib.sha256(text)
        if node is not None:
            yield row()

    n = shuffle_partitions(ends.sparkSession)
    return (ends.select("d1", "d2", "conv_id").repartition(n, "d1", "d2").sortWithinPartitions("d1", "d2", "conv_id")
            .mapInArrow(run, "d1 long, d2 long, ends_sha256 string"))


def trie(rows: DataFrame, begin: DataFrame, max_cells: int = 1 << 27) -> DataFrame:
    """One row per node of the conversations' prefixes (see ``turn_rows`` and ``leads``):
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``key`` (SHA-256 of the last turn),
    ``words`` (of its text), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    screened = materialise(screen(prefixes(rows, begin), max_cells), "trie-screened")
    nodes = shared_nodes(screened)
    alone = screened.where("not many")

    # children by parent: exact nodes, and lone prefixes behind one that may be shared
    below = (nodes.where("depth > 0 and ask").select("p1", "p2", (F.col("n_convs") == 1).cast("long").alias("one"))
             .unionByName(alone.where("many_before").select("p1", "p2", F.lit(1).cast("long").alias("one"))))
    children = materialise(below.groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2"))
                           .agg(F.count(F.lit(1)).alias("n_children"), F.sum("one").alias("n_single")), "trie-children")
    zero = F.lit(0).cast("long")
    counted = materialise(
        nodes.where("n_convs > 1").join(children, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
        .select("d1", "d2", "p1", "p2", "conv_id", "depth", "key", "words", "n_convs",
                F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_single", zero).alias("n_single")), "trie-shared")
    sums = subtree_sums(counted.select("d1", "d2", "conv_id", "depth",
                                       F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_single")).alias("leaves"),
                                       ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), screened)
    ends = end_hashes(screened.where("many and last").join(counted.select("d1", "d2"), ["d1", "d2"], "left_semi"))
    shared = (counted.join(sums.select("d1", "d2", "leaves", "saved"), ["d1", "d2"])
              .join(ends, ["d1", "d2"], "left")
              .select("conv_id", "depth", "p1", "p2", "key", "words", "n_convs", "n_children",
                      F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.lit(True).alias("ask")))
    single = (nodes.where("n_convs = 1").select("conv_id", "depth", "p1", "p2", "key", "words",
                                                (F.col("n_ends") > 0).alias("last"), "ask")
              .unionByName(alone.select("conv_id", "depth", "p1", "p2", "key", "words", "last", F.col("many_before").alias("ask"))))
    one = F.lit(1).cast("long")
    single = single.select("conv_id", "depth", "p1", "p2", "key", "words", one.alias("n_convs"),
                           F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
                           one.alias("n_leaves"), zero.alias("saved_tokens"),
                           F.sha2(F.when(F.col("last"), F.col("conv_id").cast("string")).otherwise(""), 256).alias("ends_sha256"), "ask")
    rows_out = shared.unionByName(single)
    parents = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent"))
    asking = rows_out.where("ask and depth > 0").join(parents, ["p1", "p2"])
    rest = rows_out.where("not (ask and depth > 0)").withColumn(
        "parent", F.when(F.col("depth") > 0, F.col("conv_id")))
    return (asking.select(*rest.columns).unionByName(rest)
            .select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "key", "words", "n_convs", "n_children",
                    "n_leaves", "saved_tokens", "ends_sha256"))
