"""SimHash near-duplicates with pigeonring filtering.

A fingerprint of 64 bits is cut into five segments on a ring. If two fingerprints differ in at most two bits, the
pigeonring principle gives a start segment from which every chain of consecutive segments keeps its cumulative
difference within the proportional budget ``floor(2 * length / 5)``: 0, 0, 1, 1, 2. So the first two segments of that
chain are equal, and they are the key by which candidates meet; the longer chains prune them before the full check.

Only distinct fingerprints are compared, so exact copies cost one row. A key shared by many fingerprints is narrowed by
the chain of three: its third segment may differ in one bit, so members meet in the values at distance 0 or 1 from it.
Where even such a group is large its members aren't expanded into pairs: they meet in the points at distance 0 or 1 from
them instead (two of them share such a point exactly if they differ in two bits at most), which stays linear and exact.

``near_duplicates`` links documents by the fingerprint of their three-word shingles alone. ``keep_one`` is to find copies in
which words were changed, which moves such a fingerprint by more bits than can be searched. It searches two fingerprints
of single words instead, which move little, and confirms what they find by a third one, of five-word shingles. Nodes are
then the distinct triples of fingerprints; those of a key with many are compared in blocks, from which only the class that
each node is merged with comes out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, named, salted_join
from .components import components
from .pivots import merged

WIDTHS = (13, 13, 13, 13, 12)
STARTS = tuple(sum(WIDTHS[:i]) for i in range(len(WIDTHS)))
#: Keys with more distinct fingerprints than this are narrowed by a third segment, and then go by the points around them.
HOT = 64
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15
#: Words of a shingle by which likeness is confirmed, and the bits in which its fingerprints may differ. Two texts that share 0.8 of
#: their shingles differ in 9.7 bits on average with a standard deviation of 2.9, so most such pairs pass.
SHINGLE, UNLIKE = 5, 12
#: Fingerprints of single words that are searched, each of its own hash of the words.
WAYS = 2
#: Nodes of a key that are compared with as many others in one group.
GROUP = 2048


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text as an unsigned number; 0 for a text without words or none at all."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space are touched
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + shingle - 1]
        hashes = [digest(b" ".join(x), 42) for x in zip(*(part[i:] for i in range(shingle)))] if len(words) >= shingle else [digest(b" ".join(words), 42)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):  # sums of 255 bits fit a byte, which is several times faster
            ones += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def word_fingerprints(text: str | None) -> list[int]:
    """WAYS SimHashes of the words of one text as unsigned numbers, all 0 without words.

    A word that occurs n times weighs 16 * (1 + ln n), rounded, so the words that every text has don't decide alone.
    """
    import xxhash

    counts = Counter((text or "").encode("utf-8").lower().split())
    weights = np.rint(16 * (1 + np.log(np.fromiter(counts.values(), float, len(counts)))))
    words, total, out = list(counts), weights.sum(), []
    for way in range(WAYS):
        ones = np.zeros(64)
        for at in range(0, len(words), BLOCK):
            hashes = np.array([xxhash.xxh64_intdigest(w, way) for w in words[at : at + BLOCK]], dtype="<u8")
            ones += weights[at : at + BLOCK] @ np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
        out.append(int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]))
    return out


def marks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(__key, mark) of every row; a mark holds the searched fingerprints and the confirming one as signed longs."""
    names = [*(f"fp{way}" for way in range(WAYS)), "likeness"]
    mark = T.StructType([T.StructField(n, T.LongType()) for n in names])
    schema = T.StructType([T.StructField("__key", docs.schema[key].dataType), T.StructField("mark", mark)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            found = np.array([[*word_fingerprints(t), fingerprint(t, SHINGLE)] for t in texts], np.uint64).reshape(-1, len(names)).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(c)) for c in found.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(columns, names)], names=schema.names)

    return docs.select(named(key), named(text)).mapInArrow(run, schema)


def fingerprints(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(__key, fp) of every row; the fingerprint is a signed long."""
    schema = T.StructType([T.StructField("__key", docs.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=schema.names)

    return docs.select(named(key), named(text)).mapInArrow(run, schema)


def _segment(fp: Column, i: int) -> Column:
    i %= len(WIDTHS)
    return F.shiftrightunsigned(fp, STARTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def _differing(a: Column, b: Column, i: int, length: int) -> Column:
    """Bits that differ in ``length`` segments from segment i on."""
    mask = sum(((1 << WIDTHS[k % 5]) - 1) << STARTS[k % 5] for k in range(i, i + length))
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))


def _keys(nodes: DataFrame) -> DataFrame:
    fp = F.col("fp")
    keys = [F.struct(F.lit(i).alias("start"), F.shiftleft(_segment(fp, i), 13).bitwiseOR(_segment(fp, i + 1)).alias("seg")) for i in range(5)]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.start", "k.seg")


def _chain_holds(a: Column, b: Column) -> Column:
    out = F.bit_count(a.bitwiseXOR(b)) <= 2
    for i in range(5):
        out = out & ((F.col("start") != i) | ((_differing(a, b, i, 3) <= 1) & (_differing(a, b, i, 4) <= 1)))
    return out


def _by_start(values) -> Column:
    """An array of numbers that depends on the start segment."""
    out = F.lit(None).cast("array<bigint>")
    for i in range(5):
        out = F.when(F.col("start") == i, F.array(*map(F.lit, values(i)))).otherwise(out)
    return out


def _flips(segments: list[int]) -> list[int]:
    """No change, and each change of one bit in the given segments, as signed longs."""
    bits = [s for k in segments for s in range(STARTS[k % 5], STARTS[k % 5] + WIDTHS[k % 5])]
    return [0] + [(1 << s) - (1 << 64) if s == 63 else 1 << s for s in bits]


def links(nodes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of distinct ``nodes.fp`` at Hamming distance 1 or 2."""
    keys = _keys(nodes)
    sizes = keys.groupBy("start", "seg").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keys.join(sizes, ["start", "seg"]))
    few = shared.where(F.col("n") <= HOT).drop("n")
    a, b = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
    out = a.join(b, ["start", "seg"]).where((F.col("a") < F.col("b")) & _chain_holds(F.col("a"), F.col("b"))).select("a", "b")
    hot = shared.where(F.col("n") > HOT).drop("n")
    if hot.isEmpty():
        return out
    third = F.lit(None).cast("bigint")
    for i in range(5):
        mask = sum(1 << s for s in range(STARTS[(i + 2) % 5], STARTS[(i + 2) % 5] + WIDTHS[(i + 2) % 5]))
        third = F.when(F.col("start") == i, F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))).otherwise(third)
    changed = hot.withColumn("flip", F.explode(_by_start(lambda i: _flips([i + 2]))))
    near = changed.select("start", "seg", third.bitwiseXOR(F.col("flip")).alias("third"), "fp", (F.col("flip") == 0).alias("own"))
    group = ["start", "seg", "third"]
    narrow = near.groupBy(*group).agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).where("n > 1 and owners > 0")
    met = cut(near.join(narrow, group).drop("owners"))
    own = met.where(F.col("own") & (F.col("n") <= HOT)).select(*group, F.col("fp").alias("a"))
    other = met.where(F.col("n") <= HOT).select(*group, F.col("fp").alias("b"), "own")
    # Where both have the third segment itself, the pair counts once; else the owner's side has it.
    out = out.union(own.join(other, group).where((F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b"))) & _chain_holds(F.col("a"), F.col("b"))).select("a", "b"))
    dense = met.where(F.col("n") > HOT).select("start", "seg", "fp").distinct()
    points = dense.select("start", "seg", "fp", F.explode(_by_start(lambda i: _flips([i + 2, i + 3, i + 4]))).alias("flip")).select("start", "seg", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    # At most 65 distinct fingerprints lie around a point, so these groups are bounded.
    star = points.withColumn("a", F.min("fp").over(Window.partitionBy("start", "seg", "point"))).select("a", F.col("fp").alias("b")).where("a != b")
    return out.union(star)


def confirmed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], start: int) -> np.ndarray:
    """Which pairs of two blocks, each (searched fingerprints, confirming ones), that share the key of ``start`` are linked."""
    both = a[0][:, None] ^ b[0][None, :]
    chain = np.uint64(sum(((1 << WIDTHS[k % 5]) - 1) << STARTS[k % 5] for k in range(start, start + 3)))
    row, column = np.nonzero(np.bitwise_count(both & chain) <= 1)
    fine = (np.bitwise_count(both[row, column]) <= 2) & (np.bitwise_count(a[1][row] ^ b[1][column]) <= UNLIKE)
    hits = np.zeros(both.shape, bool)
    hits[row[fine], column[fine]] = True
    return hits


def confirmed_links(nodes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of ``nodes`` (node, mark) of which one way's fingerprints differ in 2 bits
    at most and the confirming ones in UNLIKE at most."""
    ways = F.posexplode(F.array(*[F.col(f"mark.fp{way}") for way in range(WAYS)])).alias("way", "fp")
    one = nodes.select("node", F.col("mark.likeness").alias("likeness"), ways)
    fp, group = F.col("fp"), ["way", "start", "seg"]
    pairs = [F.struct(F.lit(i).alias("start"), F.shiftleft(_segment(fp, i), 13).bitwiseOR(_segment(fp, i + 1)).alias("seg")) for i in range(5)]
    keys = one.select("node", "fp", "likeness", "way", F.explode(F.array(*pairs)).alias("k")).select("node", "fp", "likeness", "way", "k.start", "k.seg")
    shared = cut(keys.join(keys.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1"), group))
    few = shared.where(F.col("n") <= HOT).drop("n")
    a, b = (few.select(*group, F.col("node").alias(x), F.col("fp").alias(f"fp_{x}"), F.col("likeness").alias(f"like_{x}")) for x in "ab")
    alike = F.bit_count(F.col("like_a").bitwiseXOR(F.col("like_b"))) <= UNLIKE
    out = a.join(b, group).where((F.col("a") < F.col("b")) & _chain_holds(F.col("fp_a"), F.col("fp_b")) & alike).select("a", "b")
    blocks = F.ceil(F.col("n") / GROUP).cast("int")
    hot = shared.where(F.col("n") > HOT).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    if hot.isEmpty():
        return out
    parts = hot.select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "fp", "likeness")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        _, start, _, i, j = (k.as_py() for k in key)
        side, node, fps, like = (t.column(c).to_numpy() for c in ("own", "node", "fp", "likeness"))
        order = np.lexsort((node, side))
        side, node, fps, like = side[order], node[order], fps[order].view(np.uint64), like[order].view(np.uint64)
        if i == j:
            hits = confirmed((fps, like), (fps, like), start)
            np.fill_diagonal(hits, False)
        else:
            m = int(np.searchsorted(side, j))
            hits = np.zeros((len(node), len(node)), bool)
            hits[:m, m:] = confirmed((fps[:m], like[:m]), (fps[m:], like[m:]), start)
            hits |= hits.T
        linked = np.flatnonzero(hits.any(axis=1))
        return pa.table({"a": node[linked][merged(hits[np.ix_(linked, linked)])], "b": node[linked]})

    return out.union(parts.groupBy(*group, "i", "j").applyInArrow(run, "a long, b long").where("a != b"))


def _by_component(rooted: DataFrame, total: int, mark: str) -> DataFrame:
    """(mark, root, component_id) of rows (mark, least, root); a root's component_id is the least key of its rows."""
    grouped = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    several = cut(grouped.where("n > 1").drop("n"), total)  # a mark that is alone has its own least key
    found = salted_join(rooted, several, "root", "left")
    return cut(found.select(mark, "root", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), total)


def _confirmed(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(__key, mark) of every row, and (mark, root, component_id) of every distinct mark."""
    marked = cut(marks(docs, text, key))
    total = marked.count()
    # Nodes go by their place in the table as it was written.
    nodes = cut(marked.groupBy("mark").agg(F.min("__key").alias("least")), total).withColumn("node", F.monotonically_increasing_id())
    roots = components(confirmed_links(nodes))
    rooted = cut(nodes.join(roots, "node", "left").select("mark", "least", F.coalesce("root", "node").alias("root")), total)
    return marked, _by_component(rooted, total, "mark")


def _labelled(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(__key, fp) of every row, and (fp, root, component_id) of every distinct fingerprint."""
    marked = cut(fingerprints(docs, text, key))
    total = marked.count()
    nodes = cut(marked.groupBy("fp").agg(F.min("__key").alias("least")), total)
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = cut(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), total)
    return marked, _by_component(rooted, total, "fp")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: key, ``fingerprint`` (16 hex digits) and ``component_id``.

    component_id is the smallest key of the component, the row's own included. Null and empty texts have fingerprint
    zero and are linked like any other. Repeated rows are repeated in the result; null keys are never chosen as a
    component's id, which is null where it has no other. An empty table gives no rows. Extra columns are not read.
    """
    marked, labelled = _labelled(docs, text, key)
    return salted_join(marked, labelled, "fp").select(F.col("__key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest key (all its columns).

    Two texts are near copies if a fingerprint of their words differs in 2 bits at most and that of their five-word shingles in UNLIKE
    at most, as it mostly does for texts that share 0.8 of their shingles; groups are the components of such links. Texts
    without words (null, empty) are copies of each other.

    Of rows that share that key the one with the smallest text is kept. Rows with a null key stay only where their
    component has no other key, one for each. Extra columns are carried along, whatever their names. Documents are
    shuffled once, to meet the kept keys; only where keys repeat or are null does more happen.
    """
    marked, labelled = _confirmed(docs, text, key)
    chosen, row, root, own = fresh(docs.columns, "chosen", "row", "root", "own")
    columns = [named(c) for c in docs.columns]
    ids = labelled.where("component_id is not null").select(F.col("component_id").alias(chosen)).distinct()
    kept = docs.join(ids, named(key) == F.col(chosen), "left_semi")
    if not marked.where("__key is not null").groupBy("__key").count().where("count > 1").isEmpty():
        first = F.row_number().over(Window.partitionBy(named(key)).orderBy(named(text)))
        kept = kept.withColumn(row, first).where(F.col(row) == 1).select(*columns)
    if not marked.where("__key is null").isEmpty():
        lone = labelled.where("component_id is null").select("mark", "root")
        nameless = docs.where(named(key).isNull())
        found = marks(nameless.select(F.struct(*columns).alias("row"), named(text).alias("text")), "text", "row")
        groups = salted_join(found, lone, "mark")
        # One row of each component, by a minimum that is found before rows meet.
        least = groups.groupBy("root").agg(F.min_by("__key", F.struct(F.col("__key").getField(text), F.xxhash64("__key"))).alias("__key"))
        kept = kept.unionByName(least.select(*[F.col("__key").getField(c).alias(c) for c in docs.columns]))
    return kept
