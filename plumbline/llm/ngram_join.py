"""N-gram Jaccard self-join: MinHash LSH forest, then exact verification.

Each distinct text is one node. In each tree its key is a path of MinHashes, and the sorted
paths are a trie. Texts meet on the longest prefixes first; within such a match one text
stands for all when prefixes are shortened. A text's prefixes are shortened until it meets any
text at the threshold in some tree with the target probability. How far that is depends on the
text: one of few shingles can only reach the threshold at a higher similarity, which needs
less shortening. A recall that no prefix reaches is an error. Paths that share not even the
shortest prefix with another are dropped before they are sorted.

The tries are never held: Spark sorts the paths by range, each task walks its part once, and
matches that go on from one part to the next are joined by the parts' ends. Texts that meet,
directly or through others, form a candidate group.
Within each group all pairs are verified exactly on their shingle sets, by products of
incidence matrices; groups of many rows or bytes are split into blocks and every pair of blocks
is a unit of work, so pairs are neither emitted as rows nor held in one task.

Result: one row per input row with its class, the smallest id of its connected component,
and its number of links, i.e. of other rows at or above the threshold. Copies of a text
count as links but are never expanded.

Defined results: a null text counts as empty; a text without words links only to its
copies; rows that repeat an id count as separate rows; a class without an id has a null
class. Texts are told apart by 128 bits of hash. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, partitions, saved, with_small
from .graph import components
from .shingles import WIDTH, mix, shingles, slices

THRESHOLD = 0.8
RECALL = 0.999
TREES = 24
DEPTH = 8
BLOCK = 384
#: A block holds about so many bytes of text at most, or one text.
BLOCK_BYTES = 4_000_000
#: Texts of more shingles than this are not looked at one by one for what they can reach.
FEW = 24

_RNG = np.random.default_rng(77)
_FLIPS = _RNG.integers(1, 2**32, TREES * DEPTH, dtype=np.uint32)
_TIMES = _RNG.integers(1, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)


def prefix_length(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which texts of this similarity meet in some tree with this probability."""
    for length in range(depth, 0, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    raise ValueError(f"recall {recall} at threshold {threshold} cannot be reached with {trees} trees")


def needed(count: int, threshold: float, recall: float, trees: int = TREES) -> int:
    """The prefix length at which a text of so many different shingles has the target recall.

    That of the least similarity at or above the threshold which its sizes allow.
    """
    reach = [i / (count + other - i) for other in range(1, int(count / threshold) + 2) for i in range(1, min(count, other) + 1)]
    return prefix_length(min([x for x in reach if x >= threshold - 1e-9] + [1.0]), recall, trees)


def paths(hashes: np.ndarray, at: np.ndarray, trees: int) -> np.ndarray:
    """For each text with shingles, its path in each tree, 16 bits a level: texts x trees x DEPTH."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(starts), trees, DEPTH), "<u2")
    if len(starts):
        low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        for tree in range(trees):
            for level in range(DEPTH):
                f = tree * DEPTH + level
                least = np.minimum.reduceat((low ^ _FLIPS[f]) * _TIMES[f], starts)
                out[:, tree, level] = (mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def forest(docs: DataFrame, threshold: float, recall: float, trees: int = TREES, width: int = WIDTH, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, k1, k2, size, need, paths): each row's text hashes, bytes, shortest prefix length (0 without words) and paths."""
    usual = prefix_length(threshold, recall, trees)
    few = [usual, *(needed(n, threshold, recall, trees) for n in range(1, FEW + 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3)
            sizes = np.asarray(pa.compute.binary_length(texts), dtype=np.int64)
            for a, b in slices(sizes):
                hashes, at = shingles(texts.slice(a, b - a), width)
                made = paths(hashes, at, trees)
                count = np.diff(at)
                need = np.where(count > 0, usual, 0)
                for i in np.flatnonzero((count > 0) & (count <= FEW)):
                    need[i] = few[len(np.unique(hashes[at[i]:at[i + 1]]))]
                ends = np.concatenate([[0], np.cumsum(np.where(count > 0, made[0].nbytes if len(made) else 0, 0))]).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(made.tobytes())])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sizes[a:b]), pa.array(need, pa.int32()), blobs],
                                                 names=["id", "k1", "k2", "size", "need", "paths"])

    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("k1"),
                       F.xxhash64(F.lit(1), text).alias("k2"), text.alias("t"))
    return rows.mapInArrow(run, "id long, k1 long, k2 long, size long, need int, paths binary")


def _walk(lowest: int):
    """Rows (tree, path, node, need) in order -> edges (a, b) with level 0; and the first and last match of each level, with its key.

    A text takes part at the levels from its own need on. It is joined to the first text of its
    match, unless one that stands for it in a longer match is there to be joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "level", "key"]
        last: dict[int, tuple[bytes, int, int]] = {}
        ends: list[tuple[int, int, bytes]] = []
        for batch in batches:
            if not len(batch):
                continue
            tree, node, need = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            path = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), 2 * DEPTH)
            path = np.concatenate([tree.astype("<u2")[:, None].view(np.uint8), path], axis=1)
            stand, stand_need = np.full(len(batch), -1, np.int64), np.zeros(len(batch), np.int64)
            stands = np.zeros(len(batch), bool)
            a, b = [], []
            for level in range(DEPTH, lowest - 1, -1):
                mine = np.flatnonzero(need <= level)
                if not len(mine):
                    continue
                key = path[mine, :2 + 2 * level]
                new = np.ones(len(mine), bool)
                new[1:] = (key[1:] != key[:-1]).any(axis=1)
                first = mine[np.maximum.accumulate(np.where(new, np.arange(len(mine)), 0))]
                root, root_need = node[first].astype(np.int64), need[first].astype(np.int64)
                begin = key[0].tobytes()
                if level not in last:
                    ends.append((int(root[0]), level, begin))
                elif last[level][0] == begin:
                    run_one = np.cumsum(new) == 1
                    root[run_one], root_need[run_one] = last[level][1:]
                last[level] = key[-1].tobytes(), int(root[-1]), int(root_need[-1])
                own = ~stands[mine] | (stand[mine] == node[mine]) | (stand_need[mine] > level)
                link = own & (root != node[mine])
                a.append(node[mine][link])
                b.append(root[link])
                stand[mine], stand_need[mine], stands[mine] = root, root_need, True
            a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.zeros(len(a), np.int32)),
                                              pa.nulls(len(a), pa.binary())], names=names)
        ends += [(root, level, key) for level, (key, root, _) in last.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in ends], pa.int64()), pa.nulls(len(ends), pa.int64()),
                                          pa.array([x[1] for x in ends], pa.int32()), pa.array([x[2] for x in ends], pa.binary())], names=names)

    return run


def candidates(nodes: DataFrame, lowest: int, trees: int = TREES) -> DataFrame:
    """Edges (a, b) that join all texts (node, need, paths) that meet in a tree."""
    size = 2 * DEPTH
    met = nodes.where("need > 0").select("node", "need", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: F.substring("paths", i * size + 1, F.lit(size)))).alias("tree", "path"))
    met = met.withColumn("label", F.xxhash64("tree", F.substring("path", 1, 2 * lowest)))
    shared = saved(met.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label"), "shared")
    some = saved(with_small(met, shared, ["label"], "left_semi").select("tree", "path", "node", "need"), "paths")
    order = some.repartitionByRange(partitions(nodes.sparkSession), "tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    walked = saved(order.mapInArrow(_walk(lowest), "a long, b long, level int, key binary"), "matches")
    ends = walked.where("level > 0")  # two for each level and task
    tops = ends.groupBy("level", "key").agg(F.min("a").alias("top"))
    over = ends.join(tops, ["level", "key"]).select("a", F.col("top").alias("b"))
    return walked.where("level = 0").select("a", "b").union(over).where("a <> b")


def linked(texts: list[str], threshold: float, width: int) -> np.ndarray:
    """Boolean matrix of pairs at or above the threshold."""
    hashes, at = shingles(pa.array(texts, pa.large_string()), width)
    sets = [np.unique(hashes[at[i]:at[i + 1]]) for i in range(len(texts))]
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[code] > 1
    slot = np.cumsum(count > 1) - 1
    code, owner = slot[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    step = 8192
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        a, b = np.searchsorted(code, [low, low + step])
        has = np.zeros((len(sets), min(step, int(code[-1]) + 1 - low)), np.float32)
        has[owner[a:b], code[a:b] - low] = 1
        shared += has @ has.T
    union = sizes[:, None] + sizes[None, :] - shared
    near = (shared > 0) & (shared >= threshold * union - 1e-9)
    np.fill_diagonal(near, False)
    return near


def roots(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the first row of its component."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def verify(threshold: float, width: int):
    """Task function over rows (unit, across, block, node, copies, t) sorted by unit and node: (node, links, root)."""

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        near = linked([r[5] for r in rows], threshold, width)
        if rows[0][1]:  # two blocks: pairs within one are another unit's
            block = np.array([r[2] for r in rows])
            near &= block[:, None] != block[None, :]
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            return None
        nodes, copies = np.array([r[3] for r in rows]), np.array([r[4] for r in rows], np.float64)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[some]), pa.array((near @ copies)[some].astype(np.int64)), pa.array(nodes[roots(near)][some])],
            names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[0] != rows[0][0]:
                    if len(rows) > 1 and (out := flush(rows)):
                        yield out
                    rows = []
                if not rows or row[3] != rows[-1][3]:  # else a repeated row
                    rows.append(row)
        if len(rows) > 1 and (out := flush(rows)):
            yield out

    return run


def similar_texts(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES,
                  width: int = WIDTH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, comp, class_id, n_links): see the module's text; comp names the component, also where ids are null."""
    rows = saved(forest(docs, threshold, recall, trees, width, id_col, text_col), "forest")
    nodes = saved(rows.groupBy("k1", "k2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("need").alias("need"),
        F.first("paths").alias("paths")), "nodes")
    groups = components(candidates(nodes.withColumnRenamed("k1", "node"), prefix_length(threshold, recall, trees), trees))
    known = nodes.select(F.col("k1").alias("node"), "rep", "copies", "size")
    groups = saved(groups.join(known, "node"), "groups")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / BLOCK_BYTES)).cast("int")
    sizes = saved(groups.groupBy("comp").agg(blocks.alias("blocks")), "sizes")
    units = groups.join(sizes, "comp").select(
        "node", "rep", "comp", "blocks", "copies", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int").alias("block"))
    units = saved(units, "units").withColumnRenamed("node", "k1")
    text = F.coalesce(text_col, F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("k1"), text.alias("t"))
    texts = with_small(texts, units, ["k1"]).where(F.col("id").eqNullSafe(F.col("rep")))
    pairs = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("comp", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
        (F.col("block") != F.col("other")).alias("across"), "block", F.col("k1").alias("node"), "copies", "t")
    work = pairs.repartition(partitions(docs.sparkSession), "unit").sortWithinPartitions("unit", "node")
    links = saved(work.mapInArrow(verify(threshold, width), "node long, links long, root long"), "links")
    classes = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = nodes.select("k1", "k2", "rep", "copies").join(
        counts.join(classes, "node").withColumnRenamed("node", "k1"), "k1", "left")
    found = saved(found.withColumn("comp", F.coalesce("comp", "k1")), "found")
    lowest = saved(found.groupBy("comp").agg(F.min("rep").alias("class_id")), "lowest")
    found = saved(found.join(lowest, "comp").select(
        "k1", "k2", "comp", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    return rows.select("id", "k1", "k2").join(found, ["k1", "k2"]).withColumnRenamed("id", id_col)


def first_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of docs that stand for their class: the smallest id of each; of equal rows, one."""
    found = similar_texts(docs, id_col=id_col, text_col=text_col, **options).withColumnRenamed(id_col, "id")
    stands = F.col("id").eqNullSafe(F.col("class_id"))
    keep = saved(found.where(stands).groupBy("comp").agg(F.min("k1").alias("k")), "keep")
    keys = found.groupBy("id", "k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.first("comp").alias("comp"), F.first("class_id").alias("class_id"))
    keys = saved(keys.join(keep, "comp").withColumn("stands", stands & (F.col("k1") == F.col("k"))).where("not stands or n > 1").select(
        "id", "k1", "stands"), "gone")
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text).alias("own_k1"))

    def on(side: DataFrame) -> list:
        return [rows["own_id"].eqNullSafe(side["id"]), rows["own_k1"] == side["k1"]]

    gone = F.broadcast(keys) if is_small(keys) else keys
    once = rows.join(gone, on(gone), "left_anti").select("row.*")
    twice = keys.where("stands")
    if twice.isEmpty():
        return once
    twice = F.broadcast(twice) if is_small(keys) else twice
    return once.union(rows.join(twice, on(twice), "left_semi").dropDuplicates(["own_id", "own_k1"]).select("row.*"))
