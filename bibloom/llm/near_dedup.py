"""MinHash near-dedup: a chosen-path set similarity join.

Texts become sets of word shingles. Equal sets collapse into one class first. Independent trees then branch the
classes by minwise tokens: the first two levels of tree t are taken at once, by two coordinates of its own. A class
whose neighbours in set size cannot link with it leaves its node, and small nodes of equal members count once. Small
nodes are compared exhaustively on full sets; an oversize node is dealt into blocks that all hold the node's pivot, and
what the pivot and the blocks do not bring into one component branches on: by tuples of further coordinates that no other
tree or level uses, taken only for the texts in such nodes, and by set size, as linked sets differ little in size.
Oversize nodes of the last depth are compared block against block, so no node is cut off. Only verified spanning links
leave a task.

Nulls, empty texts and texts without words have an empty set and link with nothing. Fewer words than a shingle takes:
the whole sequence is the only shingle. Very long texts are read whole. Repeated rows and ties: the smallest doc_id
leads; rows of one doc_id with different texts are one document, linked to what any of its texts links to. Rows without
doc_id have no component. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.llm.common import U64, Union, bounded_batches, components, groups, mix, partitions, release, sliced, texts_of, word_hashes, written

#: Trees; a pair of similarity s is missed by all with probability (1 - s * s) ** TREES at most where nodes are small.
TREES = 10
#: Trees of the first pass. The second pass skips nodes that the first has brought into one component.
FIRST = 2
#: Classes, and their shingles, that one task compares exhaustively.
NODE, NODE_SHINGLES = 1024, 2_000_000
#: Branches of an oversize node, coordinates of each, and levels of branching.
BRANCHES, PATH, DEPTH = 4, 3, 2
#: Blocks outside an oversize node's largest component that are compared with all others rather than branched.
FINISH = 4
#: Minwise coordinates: two for each root, then PATH for each branch of each tree and level.
ROOTS, LEVEL = 2 * TREES, PATH * BRANCHES * TREES
COORDINATES = ROOTS + LEVEL * DEPTH
_MASKS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * U64(0xD1B54A32D192ED03))
_ODD = mix(_MASKS) | U64(1)
_WEIGHTS = mix(np.arange(101, 133, dtype=np.uint64)) | U64(1)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = word_hashes(texts)
    n = len(h)
    weights = _WEIGHTS[np.arange(words) % len(_WEIGHTS)]
    full = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        full += h[k : n - words + 1 + k] * weights[k]
    full = mix(full)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * weights[: b - a]).sum(dtype=np.uint64) + U64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _marks(flat: np.ndarray, start: np.ndarray, some: np.ndarray, low: int, high: int) -> pa.ListArray:
    """The minwise hashes low to high - 1 of sets that lie end to end in flat; zeros where some is false."""
    marks = np.zeros((len(some), high - low), np.uint64)
    if len(start):
        for k in range(low, high):
            marks[some, k - low] = np.minimum.reduceat((flat ^ _MASKS[k]) * _ODD[k], start)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (len(some) + 1) * (high - low), high - low, dtype=np.int32)), pa.array(marks.view(np.int64).ravel()))


def _laid(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(size, flat, start, some): the texts' shingle sets end to end, and where those that are not empty begin."""
    sets = shingle_sets(texts, words)
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return n, flat, np.concatenate(([0], np.cumsum(n)[:-1]))[n > 0], n > 0


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            n, flat, start, some = _laid(texts_of(batch.column("text")), words)
            d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(start):
                d1[some] = np.add.reduceat(mix(flat + U64(7)), start)
                d2[some] = np.add.reduceat(mix(flat ^ U64(0x5851F42D4C957F2D)), start)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), _marks(flat, start, some, 0, ROOTS)], names=["doc_id", "n_shingles", "d1", "d2", "marks"])

    return run


def _further(words: int, depth: int):
    """(rep, marks) of texts (rep, text): the coordinates by which nodes of a depth branch."""
    low = ROOTS + LEVEL * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            _, flat, start, some = _laid(texts_of(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), _marks(flat, start, some, low, low + LEVEL)], names=["rep", "marks"])

    return run


def linked(sets: list[np.ndarray], block: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of all pairs of different sets, by products of blocks of the incidence matrix.

    Values that only one set holds meet no other set and are left out.
    """
    m = len(sets)
    if m == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([[0, both], [both, 0]])
    values, inverse, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(m), [len(s) for s in sets]), holders > 1
    row, inverse, values = row[shared[inverse]], (np.cumsum(shared) - 1)[inverse[shared[inverse]]], values[shared]
    order = np.argsort(inverse, kind="stable")
    row, inverse = row[order], inverse[order]
    out = np.zeros((m, m))
    for lo in range(0, len(values), block):
        a, b = np.searchsorted(inverse, [lo, lo + block])
        part = np.zeros((m, min(block, len(values) - lo)), np.float32)
        part[row[a:b], inverse[a:b] - lo] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def _compare(words: int, percent: int):
    """Exhaustive comparison in each task key: yields spanning links (a, b) of what it finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for table in groups(batches, "task"):
            rep, comp = table.column("rep").to_numpy(), table.column("comp").to_numpy()
            if len(rep) < 2 or len(set(comp)) < 2:
                continue
            sets = shingle_sets(texts_of(table.column("text").combine_chunks()), words)
            n = np.array([len(s) for s in sets])
            both = linked(sets)
            x, y = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
            tree, place = Union(len(rep)), {}
            for i, c in enumerate(comp):  # what is known to hang together already
                tree.join(i, place.setdefault(c, i))
            for i, j in zip(x.tolist(), y.tolist()):
                if tree.join(i, j):
                    a.append(int(rep[i]))
                    b.append(int(rep[j]))
            if len(a) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        release()

    return run


def _blocks(n: Column, bulk: Column) -> Column:
    return F.ceil(2 * F.greatest(n / NODE, bulk / NODE_SHINGLES)).cast("int")


def _sizes(members: DataFrame) -> DataFrame:
    """(node, size, bulk, pivot, most, ...) of the nodes of members (node, rep, n, comp) with two components at least.

    most: the largest component; within and rest: the blocks that it and the others make.
    """
    parts = members.groupBy("node", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("bulk"), F.min("rep").alias("pivot"))
    size = parts.groupBy("node").agg(F.sum("size").alias("size"), F.sum("bulk").alias("bulk"), F.min("pivot").alias("pivot"), F.count("*").alias("comps"), F.max(F.struct("size", "bulk", "comp")).alias("most")).where("comps > 1")
    blocks = F.greatest(F.lit(2), _blocks(F.col("size"), F.col("bulk")))
    return size.select("node", "pivot", _small().alias("small"), blocks.alias("blocks"), F.col("most.comp").alias("most"), _blocks(F.col("most.size"), F.col("most.bulk")).alias("within"), _blocks(F.col("size") - F.col("most.size"), F.col("bulk") - F.col("most.bulk")).alias("rest"))


def _tasks(members: DataFrame) -> DataFrame:
    """(task, rep, comp) from members (node, rep, n, comp).

    A node of at most NODE classes and NODE_SHINGLES shingles is one task. A larger one is dealt into blocks that all
    hold its pivot.
    """
    full = members.join(_sizes(members), "node")
    small, large = full.where("small").select(F.xxhash64("node").alias("task"), "rep", "comp"), full.where("not small")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pivots = large.where("rep = pivot").select("node", "rep", "comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = large.where("rep <> pivot").select("node", "rep", "comp", block.alias("block")).unionByName(pivots)
    return small.unionByName(dealt.select(F.xxhash64("node", "block").alias("task"), "rep", "comp"))


def _block_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(task, rep, comp): each pair of blocks of the nodes, but for pairs within a node's largest component, which hangs together."""
    full, own = members.join(nodes, "node"), F.col("comp") == F.col("most")
    dealt = full.withColumn("block", F.when(own, F.col("rest") + F.pmod(F.xxhash64("rep"), "within")).otherwise(F.pmod(F.xxhash64("rep"), "rest")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(own, F.col("rest")).otherwise(F.col("rest") + F.col("within")) - 1))).where("other <> block")
    return pairs.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "rep", "comp")


def _small() -> Column:
    return (F.col("size") <= NODE) & (F.col("bulk") <= NODE_SHINGLES)


def _with_components(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return members.withColumn("comp", F.col("rep"))
    return members.join(comps, members["rep"] == comps["id"], "left").select("node", "rep", "n", F.coalesce("component", "rep").alias("comp"))


def _branched(members: DataFrame, texts: DataFrame, depth: int, words: int, percent: int) -> DataFrame:
    """The children of nodes: by paths of their tree's own coordinates and cells of set size; sets that may link share a cell."""
    first = PATH * BRANCHES * F.col("tree")
    pick = F.array(*[F.xxhash64(F.lit(k), *[F.element_at("marks", first + PATH * k + j + 1) for j in range(PATH)]) for k in range(BRANCHES)])
    step = float(np.log(100 / percent)) if percent < 100 else 1e-9
    size = F.log("n") / F.lit(4 * step)
    cells = F.array_distinct(F.array(F.floor(size), F.floor(size + 0.25)))  # a linked larger set is less than a step away
    open_texts = texts.join(members.select("rep").distinct().hint("merge"), "rep", "left_semi")
    marks = written(open_texts.select("rep", "text").mapInArrow(_further(words, depth), "rep long, marks array<long>"), "marks")
    split = members.join(marks, "rep").select("node", "rep", "n", "tree", F.explode(pick).alias("mark"), cells.alias("cells"))
    split = written(split.select("rep", "n", "tree", "node", "mark", F.explode("cells").alias("cell")).select(F.xxhash64("node", "mark", "cell").alias("node"), "rep", "n", "tree"), "children")
    return written(split.join(split.groupBy("node").agg(F.count("*").alias("size")).where("size > 1").select("node"), "node"), "members")


def _roots(leads: DataFrame, percent: int) -> DataFrame:
    """(node, rep, n, tree) of the trees' first nodes, without what cannot link in its node.

    Leads alone in their node go. In a small node a class goes if the classes next to it in set size are too small or
    too large for a link; small nodes of equal members are compared once, in the first tree that has them.
    """
    mark = lambda k: F.element_at("marks", 2 * F.col("tree") + k)
    roots = leads.select("rep", "n", "marks", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(F.xxhash64("tree", mark(1), mark(2)).alias("node"), "rep", "n", "tree")
    sizes = roots.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("bulk")).where("size > 1")
    roots = written(roots.join(sizes, "node"), "shared")
    by_size = Window.partitionBy("node").orderBy("n", "rep")
    near = lambda x, y: F.coalesce(100 * F.least(x, y) >= percent * F.greatest(x, y), F.lit(False))
    fits = roots.where(_small()).select("node", "rep", "n", "tree", F.lag("n").over(by_size).alias("before"), F.lead("n").over(by_size).alias("after"))
    fits = fits.where(near(F.col("n"), F.col("before")) | near(F.col("n"), F.col("after"))).select("node", "rep", "n", "tree")
    members = [F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep", F.lit(1)) % (1 << 40)).alias("y")]
    first = fits.groupBy("node").agg(F.first("tree").alias("tree"), *members).groupBy("size", "x", "y").agg(F.min(F.struct("tree", "node")).alias("least")).select("least.node")
    return fits.join(first, "node").unionByName(roots.where(~_small()).select("node", "rep", "n", "tree"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; links have 100 * |A & B| >= percent * |A | B|."""
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select("doc_id", "text")
    sketch = written(source.mapInArrow(_sketch(words), "doc_id long, n_shingles long, d1 long, d2 long, marks array<long>"), "sketch")
    classes = sketch.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "classes")
    leads = written(sketch.select("doc_id", "n_shingles", "marks").join(classes.select(F.col("rep").alias("doc_id")).hint("shuffle_hash"), "doc_id").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "marks"), "leads")
    roots = written(_roots(leads, percent), "roots")
    needed = roots.select(F.col("rep").alias("doc_id")).distinct()  # grows with the table: never broadcast
    texts = written(source.join(needed.hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text"), "texts")

    n = partitions(spark)
    found: list[DataFrame] = []
    comps: DataFrame | None = None

    def compare(tasks: DataFrame) -> DataFrame | None:
        """Compares in each task; the components of all links so far."""
        dealt = tasks.join(texts, "rep").repartition(n, "task").sortWithinPartitions("task", "rep")
        links = written(dealt.mapInArrow(_compare(words, percent), "a long, b long"), "links")
        if links.isEmpty():
            return comps
        found.append(links)
        return written(components(reduce(DataFrame.unionByName, found)), "components")

    for low, high in ((0, FIRST), (FIRST, TREES)):
        members = roots.where((F.col("tree") >= low) & (F.col("tree") < high)).select("node", "rep", "n", "tree")
        for depth in range(DEPTH + 1):
            comps = compare(_tasks(_with_components(members, comps)))
            known = _with_components(members, comps)
            left = written(_sizes(known).where("not small"), "open")
            last = F.lit(depth == DEPTH) | (F.col("rest") <= FINISH)
            if left.isEmpty():
                break
            comps = compare(_block_pairs(known, left.where(last)))
            left = left.where(~last).select("node")
            if left.isEmpty():
                break
            members = _branched(members.join(left, "node"), texts, depth, words, percent)

    own = sketch.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["n_shingles", "d1", "d2"], "left")
    if comps is not None:
        own = own.join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left")
    else:
        own = own.withColumn("component", F.lit(None).cast("long"))
    out = own.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
