"""Near-duplicate embeddings by lattice hashing: random projections decoded to points of E8."""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicatlas.llm.components import components
from topicatlas.operators.lineage import cut_lineage

TABLES = 8
#: Neighbouring cells of a vector's own that are probed in each table.
PROBES = 12
SEED = 20_240_817
#: Members of a block; a cell of more is compared block against block.
BLOCK = 256
#: Cells up to this size are compared many at a time.
SMALL_CELL = 24


def _root_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two ones of either sign, or eight halves of even sign."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate([found, halves[(halves < 0).sum(axis=1) % 2 == 0]])


ROOTS = _root_vectors()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates of even sum: where the sum is odd, the
    coordinate that was rounded furthest is rounded the other way."""
    y = np.rint(x)
    odd = np.flatnonzero(y.sum(axis=1) % 2 != 0)
    rest = x[odd] - y[odd]
    k = np.abs(rest).argmax(axis=1)
    y[odd, k] += np.where(rest[np.arange(len(odd)), k] >= 0, 1, -1)
    return y


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the even whole points and these moved by a half."""
    one, two = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - two) ** 2).sum(axis=1) < ((x - one) ** 2).sum(axis=1)
    return np.where(nearer[:, None], two, one)


def _cell(points: np.ndarray, table: int, label: np.ndarray) -> np.ndarray:
    """A number for a point, a table and a label; equal numbers are verified by cosine and label."""
    odd = np.random.default_rng(SEED + 1).integers(1, 2**62, 10, np.uint64) * np.uint64(2) + np.uint64(1)
    key = ((2 * points).astype(np.int64).view(np.uint64) * odd[:8]).sum(axis=-1, dtype=np.uint64)
    key = key + label.astype(np.int64).view(np.uint64) * odd[8] + np.full(1, table + 1, np.uint64) * odd[9]
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def cells(unit: np.ndarray, label: np.ndarray, tables: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each table the cell of each unit vector, and the cells it probes: the nearest
    neighbours of its lattice point."""
    rng = np.random.default_rng(SEED)
    basis = rng.standard_normal((unit.shape[1], tables * 8))
    shift = np.random.default_rng(SEED + 2).uniform(0, 2, tables * 8)
    y = (unit @ basis + shift).reshape(len(unit), tables, 8)
    home = np.empty((tables, len(unit)), np.int64)
    near = np.empty((tables, len(unit), probes), np.int64)
    for t in range(tables):
        point = nearest_point(y[:, t])
        home[t] = _cell(point, t, label)
        if probes:
            gain = (y[:, t] - point) @ ROOTS.T  # all roots are equally long
            chosen = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
            near[t] = _cell(point[:, None, :] + ROOTS[chosen], t, label[:, None])
    return home, near


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column in double precision, padded to the longest."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = np.zeros((len(sizes), int(sizes.max(initial=0))))
    found[np.arange(found.shape[1]) < sizes[:, None]] = flat
    return found / np.linalg.norm(found / (top := np.abs(found).max(axis=1, keepdims=True)), axis=1, keepdims=True) / top


def _cell_rows(tables: int, probes: int):
    def task(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                unit, label = _units(part.column("embedding")), part.column("label").to_numpy()
                cid = part.column("cid").to_numpy()
                home, near = cells(unit, label, tables, probes)
                for t in range(tables):
                    key = np.concatenate([home[t][:, None], near[t]], axis=1)
                    own = np.zeros(key.shape, bool)
                    own[:, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(key.size, t, np.int32)),
                            pa.array(key.ravel()),
                            pa.array(np.repeat(cid, key.shape[1])),
                            pa.array(own.ravel()),
                        ],
                        ["t", "cell", "cid", "home"],
                    )

    return task


def _first_meeting(i, j, t, cell, home, near):
    """Whether a pair meets in cell ``cell`` of table ``t`` for the first time of all."""
    first = np.ones(len(i), bool)
    for k in range(home.shape[0]):
        a, b = home[k][i], home[k][j]
        a_probed = (near[k][j] == a[:, None]).any(axis=1) | (a == b)
        b_probed = (near[k][i] == b[:, None]).any(axis=1) | (a == b)
        first &= ~((k < t) & (a_probed | b_probed))
        least = np.where(a_probed & b_probed, np.minimum(a, b), np.where(a_probed, a, b))
        first &= (k != t) | (least == cell)
    return first


def _local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member that links among n members reach, for each of them."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def _compare(tables: int, probes: int, threshold: float):
    """A task over rows sorted by cell and pair of blocks: links within, counted once each.

    Gives for each member that has links the number of other vectors they lead to,
    and the least member they reach.
    """

    def links_of(part: pa.Table):
        unit = _units(part.column("embedding").combine_chunks())
        label, size = part.column("label").to_numpy(), part.column("size").to_numpy()
        cid, copies = part.column("cid").to_numpy(), part.column("copies").to_numpy()
        own, block = part.column("home").to_numpy(), part.column("block").to_numpy()
        t, cell = part.column("t").to_numpy(), part.column("cell").to_numpy()
        one, two = part.column("one").to_numpy(), part.column("two").to_numpy()
        new = np.append(True, (t[1:] != t[:-1]) | (cell[1:] != cell[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(t)))
        found = []
        small = np.flatnonzero((sizes > 1) & (sizes <= SMALL_CELL))
        for n in np.unique(sizes[small]).tolist():
            a, b = np.triu_indices(n, 1)
            group = starts[small[sizes[small] == n]]
            for k in range(0, len(group), step := max(1, 100_000 // len(a))):
                base = group[k : k + step, None]
                i, j = (base + a).ravel(), (base + b).ravel()
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                found.append((i[near], j[near]))
        for s, n in zip(starts[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist(), strict=True):
            a, b = np.nonzero(np.triu(unit[s : s + n] @ unit[s : s + n].T >= threshold, 1))
            found.append((a + s, b + s))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        fit = (own[i] | own[j]) & (label[i] == label[j]) & (size[i] == size[j]) & (cid[i] != cid[j])
        fit &= (one[i] == two[i]) | (block[i] != block[j])
        i, j = i[fit], j[fit]
        if not len(i):
            return None
        home, near = cells(unit, label, tables, probes)
        first = np.concatenate(
            [
                _first_meeting(i[k : k + 50_000], j[k : k + 50_000], t[i[k : k + 50_000]], cell[i[k : k + 50_000]], home, near)
                for k in range(0, len(i), 50_000)
            ]
        )
        counted = np.zeros(len(t), np.int64)
        np.add.at(counted, i[first], copies[j[first]])
        np.add.at(counted, j[first], copies[i[first]])
        least = _local_components(len(t), i, j)
        use = np.unique(np.concatenate([i, j]))
        return pa.RecordBatch.from_arrays(
            [pa.array(cid[use]), pa.array(counted[use]), pa.array(cid[least[use]])], ["cid", "links", "least"]
        )

    def task(batches):
        kept = None
        for batch in batches:
            kept = pa.concat_tables([kept, pa.Table.from_batches([batch])]) if kept else pa.Table.from_batches([batch])
            # The last cell of a batch may go on in the next; all before it is whole.
            keys = [kept.column(c).to_numpy() for c in ("t", "cell", "one", "two")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if whole and (out := links_of(kept.slice(0, whole))):
                yield out
            kept = kept.slice(whole)
        if kept and (out := links_of(kept)):
            yield out

    return task


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vectors (vec_id, embedding, label)``.

    Vectors are linked if their labels are equal, their lengths too and their cosine
    in double precision is at least ``threshold``.  Candidates share a cell of a
    table: a vector lies in the cell of its lattice point and probes neighbouring
    ones.  Null labels, and vectors that are null, empty, zero or hold a null or
    non-finite component, link with nothing.  Equal vectors of a label are one class
    and link with each other.  Cells of many members are compared in pairs of blocks;
    tasks return counts and one row per member, not the pairs.  A vector's links are
    counted where it meets the other first, so tables do not count twice.  Rows that
    repeat a ``vec_id`` are vectors of their own; an empty table gives an empty one.
    """
    source = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("long").alias("label"),
    )
    usable = (
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    good = source.where(F.coalesce(usable, F.lit(False)))
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    rows = classes.select("cid", "label", "embedding").mapInArrow(
        _cell_rows(tables, probes), "t int, cell long, cid long, home boolean"
    )
    rows = cut_lineage(rows, "cells")
    shared = rows.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any"))
    shared = cut_lineage(shared.where("n > 1 and any").drop("any"), "shared-cells")
    members = rows.join(shared, ["t", "cell"])
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    members = members.withColumn("block", F.pmod(F.xxhash64("cid"), n_blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    members = members.select(
        "t", "cell", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "cid", "home"
    )
    members = cut_lineage(members, "cell-members")
    carried = members.join(classes.select("cid", "label", "embedding", "copies", F.size("embedding").alias("size")), "cid")
    carried = carried.repartition("t", "cell", "one", "two").sortWithinPartitions("t", "cell", "one", "two")
    linked = cut_lineage(carried.mapInArrow(_compare(tables, probes, threshold), "cid long, links long, least long"), "vector-links")
    counts = cut_lineage(linked.groupBy("cid").agg(F.sum("links").alias("links")), "link-counts")
    joined = components(linked.select(F.col("cid").alias("a"), F.col("least").alias("b")))
    labelled = classes.select("cid", "first").join(joined.select(F.col("node").alias("cid"), "component"), "cid", "left")
    labelled = cut_lineage(labelled.select("cid", "first", F.coalesce("component", "cid").alias("component")), "class-components")
    least = cut_lineage(labelled.groupBy("component").agg(F.min("first").alias("component_id")), "component-least")
    known = labelled.join(least, "component").join(counts, "cid", "left").select("cid", "component_id", "links")
    known = classes.select("cid", "label", "embedding", "copies").join(known, "cid").drop("cid")
    known = cut_lineage(known, "class-results")
    found = good.join(known, ["label", "embedding"]).select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    alone = source.where(~F.coalesce(usable, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return found.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
