"""Embedding near-duplicates by a pivot-permutation index.

A bounded sample of the vectors, no two of them close to each other, serves as reference points (pivots). Each vector
is described by its nearest pivots in order; it stands in the inverted list of each of them. Two vectors are candidates
if they share enough pivots, and the cosine of candidates is verified in double precision. A pair belongs to the list of
the lowest pivot it shares; there, vectors meet by the second one they share, so pairs that share one pivot only aren't
compared. Where a list is so dense that this saves nothing it is compared as a whole, but for pairs that share a lower
pivot for sure.

A dense group holds one pivot or few, however large it is, so which pivots are nearest doesn't hang on the noise of its
members. Equal vectors are one class from the start, so copies cost one row, and links are counted and merged inside
blocks of a list instead of being written out as pairs: what leaves a block is at most two rows for each of its vectors. A
list with very many vectors is cut into blocks, each pair of blocks a group of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, named, salted_join
from .components import components

#: How many pivots two vectors must share.
SHARED = 2
#: Pivots have a lower cosine than this with each other; they are taken from a sample of so many times their number.
APART, SAMPLE = 0.7, 2
#: Vectors of a list that are compared with as many others in one group.
BLOCK = 2048
#: Links of two blocks that are looked at one by one.
PAIRS = 1 << 16


def n_pivots(classes: int) -> int:
    """Pivots for so many classes of vectors: their root, so that lists and pivots grow alike; 32 to 2,048."""
    return int(min(2048, max(32, classes**0.5)))


def nearest_for(pivots: int) -> int:
    """Nearest pivots kept for a vector: more where pivots are many, as their order hangs on less then."""
    return 8 if pivots <= 512 else 10 if pivots <= 1024 else 12


def spread(units: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the vectors (of length 1), first come first, none of them within APART of another."""
    taken = np.zeros((0, units.shape[1]))
    for u in units:
        if len(taken) == most:
            break
        if not (taken @ u >= APART).any():
            taken = np.concatenate([taken, u[None]])
    return taken


def usable(v: Column) -> Column:
    """Whether a vector can have a cosine: no null or non-finite component, and not all zero."""
    fine = F.forall(v, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a column scaled to length 1 in double precision (first by their largest part, so none overflows)."""
    m = _matrix(column).astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def described(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """``classes`` (rep, n, v) with ``near``: the numbers of the nearest pivots, nearest first, ties to the lower."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            vectors = batch.column(2)
            near: list = [None] * batch.num_rows
            sizes = np.array([len(v) for v in vectors], dtype=int)
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                order = np.argsort(-(_units(vectors.take(pa.array(own))) @ shared.value[d].T), axis=1, kind="stable")[:, :nearest]
                for i, o in zip(own.tolist(), order.astype(np.int16)):
                    near[i] = o
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int16()))], names=["rep", "n", "v", "near"])

    return classes.select("rep", "n", "v").mapInArrow(run, f"rep long, n long, v {dict(classes.dtypes)['v']}, near array<smallint>")


def _products(units_a: np.ndarray, near_a: np.ndarray, units_b: np.ndarray, near_b: np.ndarray, pivot: int, least: float, need: int) -> np.ndarray:
    """Pairs with a cosine of ``least`` that may share ``need`` pivots of which ``pivot`` is the lowest."""
    hits = np.zeros((len(units_a), len(units_b)), bool)
    if need > 1:
        sides = []
        for near in (near_a, near_b):
            row, at = np.nonzero(near > pivot)
            second = near[row, at]
            order = np.argsort(second, kind="stable")
            names, first = np.unique(second[order], return_index=True)
            sides.append(dict(zip(names.tolist(), np.split(row[order], first[1:]))))
        both = sides[0].keys() & sides[1].keys()
        if 2 * sum(len(sides[0][q]) * len(sides[1][q]) for q in both) < hits.size:
            for q in both:
                a, b = sides[0][q], sides[1][q]
                hits[np.ix_(a, b)] |= units_a[a] @ units_b[b].T >= least
            return hits
    low_a, low_b = near_a.min(axis=1), near_b.min(axis=1)
    for low in np.unique(low_a).tolist():
        a = np.flatnonzero(low_a == low)
        b = np.arange(len(units_b)) if low == pivot else np.flatnonzero(low_b != low)
        if len(b):
            hits[np.ix_(a, b)] = units_a[a] @ units_b[b].T >= least
    return hits


def verified(units_a: np.ndarray, near_a: np.ndarray, units_b: np.ndarray, near_b: np.ndarray, pivot: int, least: float, shared: int) -> np.ndarray:
    """Which pairs of two blocks of a pivot's list are links that no list of a lower pivot has."""
    need = min(shared, near_a.shape[1])  # with fewer pivots than are to be shared, all of them are
    hits = _products(units_a, near_a, units_b, near_b, pivot, least, need)
    a, b = np.nonzero(hits)
    if len(a) > PAIRS:  # a dense group: by products of matrices with a column for each pivot
        names = np.unique(near_a)
        held_a, held_b = ((near[:, :, None] == names).any(axis=1).astype(np.float32) for near in (near_a, near_b))
        low = names < pivot
        return hits & (held_a[:, low] @ held_b[:, low].T == 0) & (held_a[:, ~low] @ held_b[:, ~low].T >= need)
    same = near_a[a][:, :, None] == near_b[b][:, None, :]
    lower = (same & (near_a[a] < pivot)[:, :, None]).any(axis=(1, 2))
    hits[a, b] = ~lower & (same.sum(axis=(1, 2)) >= need)
    return hits


def merged(hits: np.ndarray) -> np.ndarray:
    """The lowest row number joined to each row by a symmetric matrix of links."""
    label = np.arange(len(hits))
    while True:
        least = [np.where(hits[i : i + 256], label[None, :], len(hits)).min(axis=1, initial=len(hits)) for i in range(0, len(hits), 256)]
        new = np.minimum(label, np.concatenate(least)) if least else label
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(index: DataFrame, least: float, shared: int) -> DataFrame:
    """(rep, links, root): by block, how many other vectors a class is linked with, and the class it is merged with."""
    # A vector's highest pivot is never the lowest of two that it shares.
    ordered = F.array_sort("near")
    lists = index.select("rep", "n", "v", "near", F.size("v").alias("d"), F.explode(F.when(F.size("near") > 1, F.slice(ordered, 1, F.size("near") - 1) if shared > 1 else ordered).otherwise(ordered)).alias("pivot"))
    sizes = lists.groupBy("d", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each pivot
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    parts = lists.join(F.broadcast(sizes), ["d", "pivot"]).withColumn("own", own).withColumn("other", other)
    groups = parts.select("d", "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "v", "near")

    def run(key, t):
        _, pivot, i, j = (k.as_py() for k in key)
        rep, n, side = (t.column(c).to_numpy() for c in ("rep", "n", "own"))
        order = np.lexsort((rep, side))
        rep, n, side = rep[order], n[order], side[order]
        units, near = _units(t.column("v"))[order], _matrix(t.column("near"))[order].astype(np.int16)
        if i == j:
            hits = verified(units, near, units, near, pivot, least, shared)
            np.fill_diagonal(hits, False)
        else:
            m = int(np.searchsorted(side, j))
            hits = np.zeros((len(rep), len(rep)), bool)
            hits[:m, m:] = verified(units[:m], near[:m], units[m:], near[m:], pivot, least, shared)
            hits |= hits.T
        linked = np.flatnonzero(hits.any(axis=1))
        some = hits[np.ix_(linked, linked)]
        return pa.table({"rep": rep[linked], "links": some @ n[linked], "root": rep[linked][merged(some)]})

    return groups.groupBy("d", "pivot", "i", "j").applyInArrow(run, "rep long, links long, root long")


def near_duplicates(table: DataFrame, vector: str = "embedding", key: str = "vec_id", least: float = 0.9, nearest: int | None = None, shared: int = SHARED, pivots: int | None = None) -> DataFrame:
    """Per row of ``table``: key, n_links, component_id and kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Repeated keys are separate vectors. Rows with a null key take part; they are never a
    component's id unless it has no other. An empty table gives no rows. Extra columns are not read.
    """
    rows = cut(table.select(named(key).alias("__key"), named(vector).alias("v")).withColumn("ok", usable(F.col("v").cast("array<double>"))))
    # Classes go by their place in the table as it was written, as keys may be null or repeated and hashes may collide.
    classes = cut(rows.where("ok").groupBy("v").agg(F.count("*").alias("n"), F.min("__key").alias("least"))).withColumn("rep", F.monotonically_increasing_id())
    count = classes.count()
    most = pivots or n_pivots(count)
    nearest = nearest or nearest_for(most)
    chosen = classes.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE * most).collect()  # SAMPLE times n_pivots rows at most
    by_size: dict[int, list] = {}
    for r in chosen:
        by_size.setdefault(len(r.v), []).append(r.v)
    dims = [r.d for r in classes.select(F.size("v").alias("d")).distinct().collect()] if count else []  # vector lengths in use
    points = {d: spread(_units(pa.array(by_size.get(d) or np.eye(d)[: nearest * 4].tolist(), pa.list_(pa.float64()))), most) for d in dims}
    found = cut(links(described(classes, points, nearest), least, shared))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select("rep", "root"), "rep", "root").withColumnRenamed("node", "rep")
    rooted = cut(classes.join(linked, "rep", "left").join(roots, "rep", "left").select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), count)
    grouped = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    several = cut(grouped.where("n > 1").drop("n"), count)  # a class that is alone has its own least key
    joined = salted_join(rooted, several, "root", "left").select("v", "n_links", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = salted_join(rows.withColumn("v", F.when(F.col("ok"), F.col("v"))), cut(joined, count), "v", "left", 20_000)
    out = out.select(F.col("__key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("component_id").isNull(), F.col("__key")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(named(key) == F.col("component_id"), F.lit(False)))
