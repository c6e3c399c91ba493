"""Near-duplicate vectors by cosine, with cover trees and a dual traversal.

On unit vectors, cosine >= c means distance <= sqrt(2 - 2c). The upper levels of the tree lie over the
cluster: a cell with more vectors than a block may hold chooses pivots of its own, its vectors go to the
nearest, and the new cells are treated alike, so a block holds what is close together. Every cell has its
covering radius. Pairs of cells are followed down from the root, level by level: a pair whose
centres are further apart than the distance plus both radii holds no link and is dropped with all
that lies below it, before any vector is sent anywhere.

Every block has a cover tree of its own below that: nested levels of nodes with halving radii, each
node with its true covering radius. Two blocks are compared node against node in the same way; a pair
of nodes that is close enough holds only links; everything else is opened, down to pairs of vectors
whose cosine decides.

Blocks that follow each other in the order of the tree share a shelf, and a task compares two shelves,
block against block. The bound also holds between a vector and a whole block, so a vector is sent only to
shelves it may have links on, once to each. In vectors without structure no bound cuts anything off but
the vectors' own blocks are still compared node by node, in matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tunestrata.llm.common import written
from tunestrata.llm.components import components
from tunestrata.operators.joins import per_key
from tunestrata.operators.ordering import running_totals

#: Vectors in a block.
BLOCK = 8192
#: Cells a cell is parted into at most, vectors their pivots are chosen from (by a hash of their
#: content), and vectors of one cell that a task assigns.
FAN, PIVOT_SAMPLE, ASSIGNED = 64, 1024, 1 << 17
#: Blocks are compared shelf by shelf: so many shelves, but none with more vectors than this.
SHELVES, SHELF = 16, 1 << 18
#: A cell that keeps more than this share of its parent's vectors is not parted by distance any more.
STUCK = 0.9
#: Radii of the levels below the pivots, from the top; every vector is within 2 of any other.
RADII = tuple(2.0**-k for k in range(12))
#: Edges, or arrays of them, that are kept before they are folded to a forest.
HELD = 1 << 16
_SLACK = 1e-7  # more than rounding can take off a distance


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray
    level: int


def net(vectors: np.ndarray, radius: float) -> np.ndarray:
    """For each vector the number of a centre within ``radius``; centres are further apart than that.

    Greedy, some hundred vectors at a time: those of a stretch that no earlier centre covers are
    gone through in order, then the new centres take in what is left of the rest.
    """
    owner = np.full(len(vectors), -1, np.int64)
    open_, found = np.arange(len(vectors)), 0
    limit = 1 - radius * radius / 2
    while len(open_):
        head, open_ = open_[:256], open_[256:]
        close = vectors[head] @ vectors[head].T >= limit
        centres = []
        for i in range(len(head)):
            if owner[head[i]] < 0:
                owner[head[close[i] & (owner[head] < 0)]] = found + len(centres)
                owner[head[i]] = found + len(centres)
                centres.append(head[i])
        if len(open_):
            cosines = vectors[open_] @ vectors[centres].T
            best = cosines.argmax(axis=1)
            taken = cosines[np.arange(len(open_)), best] >= limit
            owner[open_[taken]] = found + best[taken]
            open_ = open_[~taken]
        found += len(centres)
    return owner


def made_nodes(vectors: np.ndarray, rows: np.ndarray, owner: np.ndarray, level: int) -> list[Node]:
    """Nodes out of a net: the first vector of each is the centre, the furthest gives the radius."""
    if not len(rows):
        return []
    order = np.argsort(owner, kind="stable")
    nodes = []
    for group in np.split(rows[order], np.flatnonzero(np.diff(owner[order])) + 1):
        centre = vectors[group[0]]
        away = float((2 - 2 * (vectors[group] @ centre)).max()) if len(group) > 1 else 0.0
        nodes.append(Node(centre, max(away, 0.0) ** 0.5, group, level))
    return nodes


def opened(vectors: np.ndarray, rows: np.ndarray, level: int) -> tuple[np.ndarray, int]:
    """The first net from a level on that parts the rows, and the level below it.

    Below the last level every vector is a node.
    """
    while level < len(RADII):
        owner = net(vectors[rows], RADII[level])
        level += 1
        if owner.max(initial=0) > 0:
            return owner, level
    return np.arange(len(rows)), level


def top_level(cosine: float) -> int:
    """The level at which a block's tree is entered: the first with radii within the distance.

    Wider nodes than that are hardly ever far enough apart to be cut off; what upper levels would
    part is parted by the pivots.
    """
    reach = (2 - 2 * cosine) ** 0.5
    return next((k for k, radius in enumerate(RADII) if radius <= reach), len(RADII))


def children(vectors: np.ndarray, node: Node) -> list[Node]:
    return made_nodes(vectors, node.rows, *opened(vectors, node.rows, node.level)) if len(node.rows) > 1 else [node]


def spanning_forest(edges: np.ndarray, rows: int) -> np.ndarray:
    """Edges from the smallest row of each component to its others: at most ``rows`` - 1."""
    root, (a, b) = np.arange(rows), edges.T
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    others = np.flatnonzero(root != np.arange(rows))
    return np.column_stack([root[others], others])


class Links:
    """Counts of links, and edges that join up what is linked, for the vectors of two blocks.

    Edges are folded to a spanning forest whenever many have come together.
    """

    def __init__(self, weights: np.ndarray):
        self.count, self.weights, self.edges, self.held = np.zeros(len(weights), np.int64), weights, [], 0

    def edge(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = np.broadcast_arrays(a, b)
        self.edges.append(np.column_stack([a[a != b], b[a != b]]))
        self.held += len(self.edges[-1])
        if self.held > 2 * len(self.weights) + HELD or len(self.edges) > HELD:
            self.forest()

    def forest(self) -> np.ndarray:
        """The edges so far as a spanning forest, which also takes their place."""
        found = np.concatenate([*self.edges, np.empty((0, 2), np.int64)]).astype(np.int64)
        self.edges = [spanning_forest(found, len(self.weights))]
        self.held = len(self.edges[0])
        return self.edges[0]

    def all_of(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every vector of ``a`` links with every one of ``b`` (disjoint, or the same rows)."""
        if a is b:
            self.count[a] += self.weights[a].sum() - self.weights[a]
            self.edge(a[:1], a)
        else:
            self.count[a] += self.weights[b].sum()
            self.count[b] += self.weights[a].sum()
            self.edge(a[:1], b)
            self.edge(a, b[:1])

    def some_of(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        """Links as a matrix over ``a`` and ``b``; over one set of rows every row links with itself."""
        if a is b:
            np.fill_diagonal(linked, True)
            self.count[a] += linked @ self.weights[a] - self.weights[a]
        else:
            self.count[a] += linked @ self.weights[b]
            self.count[b] += self.weights[a] @ linked
        new_rows, new_columns = linked.any(axis=1), np.ones(len(b), bool)
        while new_rows.any():  # breadth first from one row at a time: a tree for each component
            rows = np.flatnonzero(new_rows)[:1]
            while len(rows):
                new_rows[rows] = False
                columns = np.flatnonzero(linked[rows].any(axis=0) & new_columns)
                if not len(columns):
                    break
                new_columns[columns] = False
                self.edge(a[rows[linked[np.ix_(rows, columns)].argmax(axis=0)]], b[columns])
                rows = np.flatnonzero(linked[:, columns].any(axis=1) & new_rows)
                if len(rows):
                    self.edge(a[rows], b[columns[linked[np.ix_(rows, columns)].argmax(axis=1)]])


def near_pairs(left: list[Node], right: list[Node], reach: float) -> Iterator[tuple[int, int, float]]:
    """Pairs of nodes the bound does not cut off, with the distance of their centres."""
    centres, radii = np.array([n.centre for n in right]), np.array([n.radius for n in right])
    widest = radii.max()
    for start in range(0, len(left), 256):
        part = left[start : start + 256]
        own = np.array([n.radius for n in part])
        cosines = np.array([n.centre for n in part]) @ centres.T
        least = 1 - (reach + own + widest + _SLACK) ** 2 / 2
        rows, columns = np.nonzero(cosines >= least[:, None])
        away = np.sqrt(np.maximum(2 - 2 * cosines[rows, columns], 0))
        close = away <= reach + own[rows] + radii[columns] + _SLACK
        yield from zip((start + rows[close]).tolist(), columns[close].tolist(), away[close].tolist(), strict=True)


def traverse(vectors: np.ndarray, left: list[Node], right: list[Node] | None, cosine: float, links: Links) -> None:
    """Compare two lists of nodes, or one list with itself (``right`` is None)."""
    reach = float(np.sqrt(2 - 2 * cosine))
    todo = [(left, right)]
    while todo:
        a_nodes, b_nodes = todo.pop()
        if not a_nodes or b_nodes == []:
            continue
        for i, j, away in near_pairs(a_nodes, b_nodes or a_nodes, reach):
            a, b = a_nodes[i], (b_nodes or a_nodes)[j]
            if b_nodes is None and (j < i or j == i and len(a.rows) == 1):
                continue
            furthest = 2 * a.radius if a is b else away + a.radius + b.radius
            if furthest <= reach - _SLACK and len(a.rows) * len(b.rows) > 1:
                links.all_of(a.rows, b.rows)
            elif len(a.rows) * len(b.rows) <= 1 << 18:
                links.some_of(a.rows, b.rows, vectors[a.rows] @ vectors[b.rows].T >= cosine)
            elif a is b:
                todo.append((children(vectors, a), None))
            else:
                todo.append((children(vectors, a), children(vectors, b)))


def unit(data: list[bytes], dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<f8").reshape(-1, dimensions)


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots by farthest-first traversal: any number of the first ones are a net of their own."""
    chosen, best = [0], sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, sample @ sample[chosen[-1]])
    return sample[chosen]


def usable(vector: str = "embedding") -> F.Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, weight, embedding`` to ``node, weight, v``: the unit vector as bytes."""
    schema = pa.schema([("node", pa.int64()), ("weight", pa.int64()), ("v", pa.binary())])
    for batch in batches:
        packed = []
        for x in batch.column(2).to_pylist():
            x = np.array(x, "<f8")
            x /= np.abs(x).max()
            packed.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], schema=schema)


def _by_length(*columns: pd.Series) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Places of rows whose vectors have one length, and their vectors as matrices."""
    sizes = np.array([len(v) for v in columns[0]])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, [unit([c.iloc[i] for i in at], size // 8) for c in columns]


def _chosen(rows: pd.DataFrame) -> pd.DataFrame:
    """Pivots of one cell: half of them far from each other, half as the vectors lie."""
    data = unit(rows["v"].tolist(), len(rows["v"].iloc[0]) // 8)
    count = int(min(FAN, max(2, -(-2 * int(rows["n"].iloc[0]) // int(rows["block"].iloc[0])))))
    pivots = np.unique(np.concatenate([far_apart(data, (count + 1) // 2), data[: count // 2]]), axis=0)
    cell = pd.Series([rows["cell"].iloc[0]] * len(pivots), dtype=object)
    return pd.DataFrame({"cell": cell, "k": np.arange(len(pivots)), "v": [p.tobytes() for p in pivots]})


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cell, salt, k, node, weight, v``, sorted by cell and salt, pivots (``k`` not null) before vectors,
    to ``node, weight, v, cell, away``: the nearest pivot's cell and the distance to it."""
    schema = pa.schema([("node", pa.int64()), ("weight", pa.int64()), ("v", pa.binary()), ("cell", pa.string()), ("away", pa.float64())])
    now, numbers, parts = None, [], []
    for batch in batches:
        keys = np.array([f"{c}/{s}" for c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], object)
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for first, last in zip(cuts, np.r_[cuts[1:], len(keys)], strict=True):
            if keys[first] != now:
                now, numbers, parts = keys[first], [], []
            rows = batch.slice(first, last - first)
            is_pivot = rows.column(2).is_valid().to_numpy(zero_copy_only=False)
            pivots, members = rows.filter(pa.array(is_pivot)), rows.filter(pa.array(~is_pivot))
            numbers += pivots.column(2).to_pylist()
            parts += pivots.column(5).to_pylist()
            if not members.num_rows:
                continue
            dimensions = len(parts[0]) // 8
            cosines = unit(members.column(5).to_pylist(), dimensions) @ unit(parts, dimensions).T
            best = cosines.argmax(axis=1)
            away = np.sqrt(np.maximum(2 - 2 * cosines[np.arange(len(best)), best], 0))
            cell = members.column(0)[0].as_py()
            cells = pa.array([f"{cell}.{numbers[i]}" for i in best])
            yield pa.RecordBatch.from_arrays([members.column(3), members.column(4), members.column(5), cells, pa.array(away)], schema=schema)


def _sent(reach: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cell, salt, other, centre, radius, node, weight, v, home, shelf, owner, level``, sorted by cell and salt,
    balls (``other`` not null: the shelf they lie on) before vectors, to vectors with each pair of shelves
    they may have links in, ``low`` and ``high``, once."""
    kept = ["node", "weight", "v", "home", "shelf", "owner", "level"]
    now, others, parts, radii = None, [], [], []
    for batch in batches:
        keys = np.array([f"{c}/{s}" for c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], object)
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for first, last in zip(cuts, np.r_[cuts[1:], len(keys)], strict=True):
            if keys[first] != now:
                now, others, parts, radii = keys[first], [], [], []
            rows = batch.slice(first, last - first)
            is_ball = rows.column(2).is_valid().to_numpy(zero_copy_only=False)
            balls, members = rows.filter(pa.array(is_ball)), rows.filter(pa.array(~is_ball))
            others += balls.column(2).to_pylist()
            parts += balls.column(3).to_pylist()
            radii += balls.column(4).to_pylist()
            if not members.num_rows:
                continue
            names, number = np.unique(np.array(others, object).astype(str), return_inverse=True)
            order = np.argsort(number, kind="stable")
            starts = np.searchsorted(number[order], np.arange(len(names)))
            dimensions = len(parts[0]) // 8
            centres, far = unit(parts, dimensions)[order], np.array(radii)[order] + reach + _SLACK
            step = max(1, (1 << 22) // len(centres))
            for start in range(0, members.num_rows, step):
                some = members.slice(start, step)
                apart = np.sqrt(np.maximum(2 - 2 * (unit(some.column("v").to_pylist(), dimensions) @ centres.T), 0))
                near = np.logical_or.reduceat(apart <= far, starts, axis=1)
                for k, name in enumerate(names):
                    going = some.filter(pa.array(near[:, k]))
                    if going.num_rows:
                        own = going.column("shelf").to_pylist()
                        pairs = [pa.array([f(x, str(name)) for x in own]) for f in (min, max)]
                        yield pa.RecordBatch.from_arrays([*(going.column(c) for c in kept), *pairs], names=[*kept, "low", "high"])


@F.pandas_udf(BooleanType())
def _may_link(a: pd.Series, b: pd.Series, far: pd.Series) -> pd.Series:
    """Whether two vectors (of one length) are no further apart than ``far``."""
    out = np.zeros(len(a), bool)
    for at, (left, right) in _by_length(a, b):
        apart = np.sqrt(np.maximum(2 - 2 * (left * right).sum(axis=1), 0))
        out[at] = apart <= far.to_numpy()[at] + _SLACK
    return pd.Series(out)


_MEMBER = "node bigint, weight bigint, v binary, cell string, away double"


def cells_of(vectors: DataFrame, block: int) -> tuple[DataFrame, DataFrame, int]:
    """``node, weight, v, cell, away`` of every vector in its last cell, the tree of cells (``cell, parent,
    centre, radius, n, leaf``), and its depth. There is a root for each length of vectors.

    Cells too large for a block are parted at once, level by level; their vectors are dealt out to
    tasks with the few pivots of their cell, so no task holds a cell. Where distances do not part a
    cell (nearly all of it goes to one pivot) it stays as it is.
    """
    members = vectors.select("node", "weight", "v", (F.octet_length("v") / 8).cast("int").cast("string").alias("cell"), F.lit(2.0).alias("away"))
    members = written(members, "vector-cells")
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.min("v").alias("centre"))
    tree = written(sizes.select("cell", F.lit(None).cast("string").alias("parent"), "centre", "radius", "n", F.lit(False).alias("stuck")), "cell-tree")
    level, trees, depth = tree, [tree], 0
    while True:
        large = level.where((F.col("n") > block) & ~F.col("stuck")).select("cell", "n")
        if large.isEmpty():
            break
        rows = members.join(large, "cell")
        first = Window.partitionBy("cell").orderBy(F.xxhash64("v"), "node")
        sample = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= PIVOT_SAMPLE).withColumn("block", F.lit(block))
        pivots = written(sample.select("cell", "v", "n", "block").groupBy("cell").applyInPandas(_chosen, "cell string, k bigint, v binary"), "pivots")
        salts = F.ceil(F.col("n") / ASSIGNED).cast("int")
        none = F.lit(None).cast("bigint")
        asked = pivots.join(large, "cell").select("cell", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "k", none.alias("node"), none.alias("weight"), "v")
        going = rows.select("cell", F.pmod(F.hash("node"), salts).alias("salt"), none.alias("k"), "node", "weight", "v")
        dealt = asked.unionByName(going).repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.col("k").asc_nulls_last())
        moved = dealt.mapInArrow(_assigned, _MEMBER)
        members = written(members.join(large.select("cell"), "cell", "left_anti").select("node", "weight", "v", "cell", "away").unionByName(moved), "vector-cells")
        parent = F.regexp_replace("cell", r"\.[0-9]+$", "")
        sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).withColumn("parent", parent)
        sizes = sizes.join(large.select(F.col("cell").alias("parent"), F.col("n").alias("of")), "parent")
        centres = pivots.select(F.concat_ws(".", "cell", F.col("k").cast("string")).alias("cell"), F.col("v").alias("centre"))
        level = sizes.join(centres, "cell").select("cell", "parent", "centre", "radius", "n", (F.col("n") > F.col("of") * STUCK).alias("stuck"))
        level = written(level, "cell-tree")
        trees.append(level)
        depth += 1
    whole = trees[0]
    for more in trees[1:]:
        whole = whole.unionByName(more)
    parents = per_key(whole.where("parent is not null").withColumnRenamed("parent", "up"), ["up"])
    whole = whole.join(parents, whole["cell"] == parents["up"], "left")
    return members, written(whole.select("cell", "parent", "centre", "radius", "n", F.col("up").isNull().alias("leaf")), "cell-tree"), depth


def cell_pairs(tree: DataFrame, depth: int, reach: float) -> DataFrame:
    """``a, b`` (``a`` <= ``b``): pairs of last cells that may hold links, followed down from the roots."""
    pairs = tree.where("parent is null").select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    facts = ["cell", "centre", "radius"]
    below = tree.where("parent is not null").select(F.col("parent").alias("up"), *facts)
    below = below.unionByName(tree.where("leaf").select(F.col("cell").alias("up"), *facts))
    for _ in range(depth):
        for side in ("a", "b"):
            own = below.select(F.col("up").alias(side), F.struct(*facts).alias(f"new_{side}"))
            pairs = pairs.join(own, side)
        near = _may_link("new_a.centre", "new_b.centre", F.col("new_a.radius") + F.col("new_b.radius") + F.lit(reach))
        low, high = F.least("new_a.cell", "new_b.cell"), F.greatest("new_a.cell", "new_b.cell")
        pairs = written(pairs.where((F.col("new_a.cell") == F.col("new_b.cell")) | near).select(low.alias("a"), high.alias("b")).distinct(), "cell-pairs")
    return pairs


def shelves_of(tree: DataFrame, block: int) -> DataFrame:
    """``cell, home, shelf`` for every block (``home``): a shelf holds blocks that follow each other in the
    order of the tree, so what is close together, and vectors of one length.

    A vector is sent once for each pair of shelves, so what is sent grows with the vectors up to
    ``SHELVES`` times ``SHELF`` of them.
    """
    leaves = tree.where("leaf").select("cell", "n")
    vectors = leaves.agg(F.sum("n")).first()[0] or 0
    size = min(SHELF, max(block, -(-vectors // SHELVES)))
    placed = running_totals(leaves, [F.col("cell").asc()], ["n"])
    parts = F.ceil(F.col("n") / block).cast("int")
    homes = placed.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    number = F.floor((F.col("n_before") + F.col("part") * block) / size).cast("string")
    length = F.regexp_extract("cell", r"^[0-9]+", 0)
    return homes.select("cell", F.concat_ws("/", "cell", F.col("part").cast("string")).alias("home"), F.concat_ws("/", length, number).alias("shelf"))


def links_of(found: DataFrame, cosine: float, block: int) -> DataFrame:
    """``a, b, n`` for distinct vectors ``node, weight, embedding``: counts (b null) and edges (n null)."""
    reach = float(np.sqrt(2 - 2 * cosine))
    vectors = found.mapInArrow(_units, "node bigint, weight bigint, v binary")
    members, tree, depth = cells_of(vectors, block)
    pairs = cell_pairs(tree, depth, reach)
    # A cell that distances do not part is cut by a hash.
    parts = tree.where("leaf").select("cell", "centre", "radius", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    home = F.concat_ws("/", "cell", F.pmod(F.xxhash64("node"), F.col("parts")).cast("string"))

    def grown(rows: pd.DataFrame) -> pd.DataFrame:
        dimensions = len(rows["v"].iloc[0]) // 8
        owner, level = opened(unit(rows["v"].tolist(), dimensions), np.arange(len(rows)), top_level(cosine))
        return rows.assign(cell=rows["cell"].astype(object), home=rows["home"].astype(object), owner=owner, level=level)

    homes = members.join(parts.select("cell", "parts"), "cell").select("node", "weight", "v", "cell", home.alias("home"))
    shape = "node bigint, weight bigint, v binary, cell string, home string, owner bigint, level bigint"
    treed = written(homes.groupBy("home").applyInPandas(grown, shape), "trees")
    shelves = shelves_of(tree, block)
    sides = pairs.select(F.col("a").alias("cell"), F.col("b").alias("other")).unionByName(
        pairs.where("a != b").select(F.col("b").alias("cell"), F.col("a").alias("other"))
    )
    balls = shelves.select(F.col("cell").alias("other"), "shelf").distinct().join(
        parts.select(F.col("cell").alias("other"), "centre", "radius"), "other"
    )
    own = F.col("cell") == F.col("other")  # in its own cell every vector stays
    balls = sides.join(balls, "other").select("cell", F.col("shelf").alias("on"), "centre", F.when(own, 2.0).otherwise(F.col("radius")).alias("radius"))
    salts = tree.where("leaf").select("cell", F.ceil(F.col("n") / ASSIGNED).cast("int").alias("salts"))
    none = {"other": "string", "centre": "binary", "radius": "double"}
    members = treed.join(shelves, ["cell", "home"]).join(salts, "cell").select(
        "cell", F.pmod(F.hash("node"), F.col("salts")).alias("salt"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()),
        "node", "weight", "v", "home", "shelf", "owner", "level",
    )
    asked = balls.join(salts, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("on").alias("other"), "centre", "radius",
        *(F.lit(None).cast(members.schema[c].dataType).alias(c) for c in members.columns[5:]),
    )
    dealt = members.unionByName(asked).repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.col("other").asc_nulls_last())
    met = dealt.mapInArrow(partial(_sent, reach), "node bigint, weight bigint, v binary, home string, shelf string, owner bigint, level bigint, low string, high string")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        data = unit(rows["v"].tolist(), len(rows["v"].iloc[0]) // 8)
        links = Links(rows["weight"].to_numpy())
        owner, level, shelf = rows["owner"].to_numpy(), rows["level"].to_numpy(), rows["shelf"].to_numpy()
        blocks = []
        for at in rows.reset_index(drop=True).groupby("home", sort=True).indices.values():
            middle = data[at].mean(axis=0)
            radius = float(np.sqrt(((data[at] - middle) ** 2).sum(axis=1).max()))
            blocks.append((shelf[at[0]], middle, radius, made_nodes(data, at, owner[at], int(level[at[0]]))))
        alone = rows["low"].iloc[0] == rows["high"].iloc[0]
        for i, (on, middle, radius, nodes) in enumerate(blocks):
            if alone:
                traverse(data, nodes, None, cosine, links)
            for other_on, other_middle, other_radius, others in blocks[i + 1 :]:
                apart = float(np.sqrt(((middle - other_middle) ** 2).sum()))
                if (alone or on != other_on) and apart <= reach + radius + other_radius + _SLACK:
                    traverse(data, nodes, others, cosine, links)
        node = rows["node"].to_numpy()
        some = np.flatnonzero(links.count)
        edges = links.forest()
        return pd.concat(
            [
                pd.DataFrame({"a": node[some], "b": pd.array([None] * len(some), "Int64"), "n": pd.array(links.count[some], "Int64")}),
                pd.DataFrame({"a": node[edges[:, 0]], "b": pd.array(node[edges[:, 1]], "Int64"), "n": pd.array([None] * len(edges), "Int64")}),
            ]
        )

    return met.groupBy("low", "high").applyInPandas(compare, "a bigint, b bigint, n bigint")


def vector_groups(vectors: DataFrame, cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding``).

    Equal vectors are compared as one and counted by their number. Vectors that are null, zero, or
    hold null or non-finite components, and rows without an id, link with nothing: they count no
    links and are their own component (without an id, neither component nor ``kept`` is known).
    Vectors of different lengths do not link. Repeated rows are vectors like others. Other columns
    are ignored. An empty table gives an empty result.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = usable() & F.col("vec_id").isNotNull()
    own = F.col("vec_id") == F.col("vec_id")  # null without an id
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), own.alias("kept"))
    rows = rows.where(fine)
    nodes = per_key(rows, ["embedding"], F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    found = written(links_of(nodes.select("node", "weight", "embedding"), cosine, block), "vector-links")
    counts = per_key(found.where("b is null"), ["a"], F.sum("n").alias("n")).withColumnRenamed("a", "node")
    roots = components(found.where("b is not null").select("a", "b"))
    named = nodes.join(counts, "node", "left").join(roots, "node", "left").select(
        "embedding", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    least = per_key(named, ["root"], F.min("least").alias("component_id"))
    named = written(named.join(least, "root").select("embedding", "n_links", "component_id"), "vector-components")
    joined = rows.join(named, "embedding").select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")
    )
    return joined.union(alone)
