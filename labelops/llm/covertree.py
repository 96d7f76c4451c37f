"""Operator 12: embedding near-dedup by dual traversal of cover trees.

Vectors of one label are linked if their cosine reaches ``MIN_COSINE``: on the unit sphere, if their
distance stays within r = sqrt(2 - 2 * MIN_COSINE).

1. **Points.** Equal vectors of a label are one point with a weight and its smallest id (map-side
   combined). A vector that is null or zero, or holds a null or non-finite component, is no point.
2. **Top of the tree, in Spark.** A label is a node. While a node has more points than a cell holds
   (``CELL_BYTES``), it is split: pivots come from a bounded sample of the node (``SAMPLE``, taken
   by hash; it decides the tree's shape, never the result) by farthest-first order, cut at the halving
   radius that leaves at most ``FANOUT``; every point goes to its nearest pivot, to the near child if
   within r/2 and else to the far child (so strays don't widen a cluster); the covering radius of a
   child is the largest distance in it. A split works on slices of bounded size, so a
   label with a third of all rows is many tasks. After ``DEPTH`` splits the rest is dealt by hash
   under the node's own pivot and radius.
3. **Node pairs, in Spark.** Pairs of nodes go down together. For pivots at distance d with radii a, b:
   d > r + a + b drops the pair; d + a + b <= r links all its points at once (one row, whatever the
   sizes: a tight cluster of any size costs its cells, not its pairs); else the pair stays.
4. **Trees and dual traversal, in tasks.** Each cell gets a cover tree (nested levels with halving radii,
   greedy covers, actual covering radii) once; the pairs of cells that stay meet in a task, where
   pairs of tree nodes are traversed by the same two rules, down to single points, which the cosine
   decides. A task returns link counts and a spanning forest, not pairs.
5. **Components** by star contraction (``simhash.components``).

Bounds carry a slack of 1e-9, so rounding never decides for a single pair but its cosine in double precision.

Defined results: unusable vectors and null labels have no links and stand for themselves; vectors of
different lengths never link; equal vectors (repeated rows included) link with each other; a null id
counts as larger than any other, and a component of null ids only has a null id and is not kept; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelops.session import scratch_dir, ship_package

from .simhash import components, forest

MIN_COSINE = 0.93
CELL_BYTES = 8 << 20  # of double components in one cell
SAMPLE = 1024
FANOUT = 64
DEPTH = 12
SLACK = 1e-9
FLOOR = 2.0**-12  # radius of the last level of a tree
BATCH = 512  # candidates for a cover looked at together
PRODUCT = 1 << 18  # node pairs measured at a time
GATHER = 1 << 21  # components gathered at a time for pairs of nodes
ROWS = 4096  # vectors compared with new centres at a time


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def cover(x: np.ndarray, radius: float, most: int | None = None):
    """Greedy cover of unit vectors: centres (the first vector is one) and the centre each vector goes to.
    Centres are more than ``radius`` apart; vectors are within it of theirs. Stops behind ``most`` centres."""
    owner, centres = np.full(len(x), -1), []
    left = np.arange(len(x))
    while len(left):
        head = left[:BATCH]
        near = distances(x[head], x[head]) <= radius
        fresh, free = [], np.ones(len(head), bool)
        for i in range(len(head)):
            if free[i]:
                fresh.append(i)
                free &= ~near[i]
                free[i] = False
        if most is not None and len(centres) + len(fresh) > most:
            return None, None
        new = head[fresh]
        best, hit = np.zeros(len(left), np.int64), np.zeros(len(left), bool)
        for at in range(0, len(left), ROWS):
            d = distances(x[left[at:at + ROWS]], x[new])
            best[at:at + ROWS] = d.argmin(axis=1)
            hit[at:at + ROWS] = d.min(axis=1) <= radius
        hit[np.searchsorted(left, new)] = True
        best[np.searchsorted(left, new)] = np.arange(len(new))
        owner[left[hit]] = best[hit] + len(centres)
        centres.extend(new.tolist())
        left = left[~hit]
    return np.array(centres), owner


def pivots(sample: np.ndarray, most: int = FANOUT) -> np.ndarray:
    """Rows of the finest level of halving radii that covers the sample with at most ``most`` centres."""
    radius, found = 2.0, np.array([0])
    while radius > FLOOR:
        centres, _ = cover(sample, radius, most)
        if centres is None:
            break
        found, radius = centres, radius / 2
    if len(found) < 2 and len(sample) > 1:  # the next level is too fine: its first, farthest-first
        order, d = [0], distances(sample, sample[:1])[:, 0]
        while len(order) < min(most, len(sample)):
            k = int(d.argmax())
            if d[k] <= 0:
                break
            order.append(k)
            d = np.minimum(d, distances(sample, sample[k:k + 1])[:, 0])
        found = np.array(order)
    return found


class Tree:
    """Cover tree of unit vectors in numpy: points in the order of a walk, so that a node is a range of them.
    Node k covers points [first[k], last[k]) around x[centre[k]] within radius[k]; children are nodes
    [child[k], child[k] + n_child[k]); single points have none."""

    FIELDS = ("first", "last", "centre", "radius", "child", "n_child")

    @classmethod
    def build(cls, x: np.ndarray):
        order = np.arange(len(x))
        first, last, centre, radius, child, n_child = [0], [len(x)], [0], [0.0], [0], [0]
        level = [(0, 2.0)]
        while level:
            below = []
            for node, rho in level:
                s, e = first[node], last[node]
                if e - s == 1:
                    centre[node] = s
                    continue
                own = x[order[s:e]]
                d = distances(own, own[:1])[:, 0]
                radius[node], centre[node] = float(d.max()) + SLACK, s
                rho = min(rho, 2.0 ** math.floor(math.log2(max(d.max(), FLOOR))))
                while True:  # the next level that splits the node; equal directions are split into points
                    if rho < FLOOR:
                        owner = np.arange(e - s)
                        break
                    centres, owner = cover(own, rho)
                    if len(centres) > 1:
                        break
                    rho /= 2
                by = np.lexsort((np.arange(e - s) != (centres[owner] if rho >= FLOOR else owner), owner))
                order[s:e] = order[s:e][by]
                cut = np.flatnonzero(np.diff(owner[by], prepend=-1))
                child[node], n_child[node] = len(first), len(cut)
                for a, b in zip(cut, [*cut[1:], e - s]):
                    below.append((len(first), rho / 2))
                    first.append(s + int(a)), last.append(s + int(b)), centre.append(s + int(a))
                    radius.append(0.0), child.append(0), n_child.append(0)
            level = below
        tree = cls()
        tree.x, tree.order = x[order], order
        for name, values in zip(cls.FIELDS, (first, last, centre, radius, child, n_child)):
            setattr(tree, name, np.array(values, np.float64 if name == "radius" else np.int64))
        return tree


def traverse(a: Tree, b: Tree, same: bool, min_cosine: float):
    """Yield arrays of node pairs (i of a, j of b) all of whose points are linked; every linked pair
    of points lies in one of them. If ``same``, a pair (i, i) stands for the pairs inside node i."""
    r = math.sqrt(2 - 2 * min_cosine)

    def walk(all_i, all_j):
        step = max(1, GATHER // a.x.shape[1])
        for at in range(0, len(all_i), step):
            i, j = all_i[at:at + step], all_j[at:at + step]
            # single points are decided by the cosine, others by bounds
            cos = np.einsum("ij,ij->i", a.x[a.centre[i]], b.x[b.centre[j]])
            reach = a.radius[i] + b.radius[j]
            one = (a.n_child[i] == 0) & (b.n_child[j] == 0)
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))
            own = (i == j) if same else np.zeros(len(i), bool)
            linked = np.where(one, cos >= min_cosine, d + reach + SLACK <= r)
            linked = np.where(own, 2 * a.radius[i] + SLACK <= r, linked) & ~(own & one)
            if linked.any():
                yield i[linked], j[linked]
            open_ = ~linked & ~one & (own | (d <= r + reach + SLACK))
            i, j, own = i[open_], j[open_], own[open_]
            if not len(i):
                continue
            # open the node with the larger radius; a node with itself opens into its pairs of children
            left = (own | (a.radius[i] >= b.radius[j])) & (a.n_child[i] > 0) | (b.n_child[j] == 0)
            right = own | ~left
            na, nb = np.where(left, a.n_child[i], 1), np.where(right, b.n_child[j], 1)
            ca, cb = np.where(left, a.child[i], i), np.where(right, b.child[j], j)
            size = na * nb
            wide = size > PRODUCT
            for k in np.flatnonzero(wide):  # by blocks of children
                rows = max(1, PRODUCT // int(nb[k]))
                for first in range(0, int(na[k]), rows):
                    n = min(rows, int(na[k]) - first)
                    yield from walk(*_children(a, b, ca[[k]] + first, np.array([n]), cb[[k]], nb[[k]], own[[k]], r))
            ca, na, cb, nb, own, size = (x[~wide] for x in (ca, na, cb, nb, own, size))
            parts = np.flatnonzero(np.diff(np.cumsum(size) // PRODUCT)) + 1
            for part in np.split(np.arange(len(size)), parts):
                if len(part):
                    yield from walk(*_children(a, b, ca[part], na[part], cb[part], nb[part], own[part], r))

    yield from walk(np.array([0]), np.array([0]))


def _children(a: Tree, b: Tree, ca, na, cb, nb, own, r: float):
    """Pairs of children that the distance bound keeps; of a node with itself each pair once."""
    out_i, out_j = [], []
    wide = na * nb >= 4096
    for k in np.flatnonzero(wide):  # one product of matrices
        p, q = np.arange(ca[k], ca[k] + na[k]), np.arange(cb[k], cb[k] + nb[k])
        d = distances(a.x[a.centre[p]], b.x[b.centre[q]])
        keep = d <= r + a.radius[p][:, None] + b.radius[q][None, :] + SLACK
        if own[k]:
            keep &= p[:, None] <= q[None, :]
        x, y = np.nonzero(keep)
        out_i.append(p[x]), out_j.append(q[y])
    ca, na, cb, nb, own = ca[~wide], na[~wide], cb[~wide], nb[~wide], own[~wide]
    size = na * nb
    of = np.repeat(np.arange(len(size)), size)
    t = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    p, q = ca[of] + t // nb[of], cb[of] + t % nb[of]
    keep = ~own[of] | (p <= q)
    out_i.append(p[keep]), out_j.append(q[keep])
    return np.concatenate(out_i), np.concatenate(out_j)


def links(a: Tree, b: Tree, weight_a, weight_b, same: bool, min_cosine: float):
    """Weight linked to each point of a and of b, and the forest label of each point (a's, then b's)."""
    n = len(a.x)
    total_a, total_b = np.concatenate([[0], np.cumsum(weight_a)]), np.concatenate([[0], np.cumsum(weight_b)])
    add_a, add_b = np.zeros(n + 1, np.int64), np.zeros(len(b.x) + 1, np.int64)
    base, inside = (0, np.zeros(n, np.int64)) if same else (n, None)
    edges, whole_a = [], np.zeros(len(a.first), bool)  # nodes whose points are known to be connected
    whole_b = whole_a if same else np.zeros(len(b.first), bool)
    for i, j in traverse(a, b, same, min_cosine):
        fa, la, fb, lb = a.first[i], a.last[i], b.first[j], b.last[j]
        own = (i == j) & same
        for add, lo, hi, w in ((add_a, fa, la, total_b[lb] - total_b[fb]), (add_a if same else add_b, fb, lb, total_a[la] - total_a[fa])):
            once = own & (add is add_a) & (lo is fb)  # a node with itself counts its weight once
            np.add.at(add, lo, np.where(once, 0, w))
            np.add.at(add, hi, -np.where(once, 0, w))
        if same:  # a point is not its own partner; its other copies are counted outside
            for s, e in zip(fa[own], la[own]):
                inside[s:e] = 1
        edges.append((fa, fb + base))
        for tree, node, whole, shift in ((a, i, whole_a, 0), (b, j, whole_b, base)):
            node = np.unique(node[~whole[node]])
            whole[node] = True
            u, of = _spans(tree.first[node], tree.last[node])
            edges.append((u + shift, tree.first[node][of] + shift))
    got_a, got_b = np.cumsum(add_a[:-1]), np.cumsum(add_b[:-1])
    if same:
        got_a -= inside * np.asarray(weight_a)
    return got_a, got_b, forest(n if same else n + len(b.x), edges)


def _spans(lo, hi):
    """All points of many ranges, and the range each comes from."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + lo[of], of


# ---- Spark side ----

POINT = "p long, root string, vector array<double>, id long, weight long, k1 long, k2 long"
NODE = "parent string, node string, centre array<double>, radius double, n long, weight long, rep long"


def _keyed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, root, vector, k1, k2): usable rows have a root (dimension and label) and a key of 128 bits."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda c: c + F.lit(0.0))  # -0.0 becomes 0.0
    fine = (F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
            & F.exists("vector", lambda c: c != 0))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.col(label_col).cast("string").alias("label"))
    root = F.when(F.coalesce(fine, F.lit(False)) & F.col("label").isNotNull(),
                  F.concat(F.size("vector").cast("string"), F.lit(":"), F.regexp_replace("label", "/", "//")))
    rows = rows.select("vec_id", "vector", root.alias("root"))
    return rows.select("vec_id", "root", "vector", F.xxhash64("root", "vector").alias("k1"),
                       F.xxhash64(F.lit(1), "root", "vector").alias("k2"))


def _matrix(column) -> np.ndarray:
    """A column of equally long lists of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _node_pivots(most: str):
    def run(table: pa.Table) -> pa.Table:
        x = unit(_matrix(table["vector"]))
        rows = pivots(x, table[most][0].as_py())
        return pa.table({"node": pa.array([table["node"][0].as_py()] * len(rows)),
                         "pivots": pa.array(x[rows].tolist(), pa.list_(pa.float64()))})

    return run


def _deal(near: float):
    """Points of one slice of a node to the node's children: nearest pivot, near or far."""
    def run(points: pa.Table, centres: pa.Table) -> pa.Table:
        if not points.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.int64())],
                            names=["p", "parent", "node", "centre", "distance", "weight"])
        x, c = unit(_matrix(points["vector"])), _matrix(centres["pivots"])
        best, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        for at in range(0, len(x), ROWS):
            d = distances(x[at:at + ROWS], c)
            best[at:at + ROWS] = d.argmin(axis=1)
            far[at:at + ROWS] = d.min(axis=1)
        parent = points["node"][0].as_py()
        child = 2 * best + (far > near)
        return pa.table({"p": points["p"], "parent": pa.array([parent] * len(x)),
                         "node": pa.array([f"{parent}/{k}" for k in child.tolist()]),
                         "centre": pa.array(c[best].tolist(), pa.list_(pa.float64())), "distance": pa.array(far),
                         "weight": points["weight"]})

    return run


def _split(spark, place: str, level: int, pts: DataFrame, at: DataFrame, heavy: DataFrame, r: float, last: bool):
    """One level down for the heavy nodes (node, n, room): new places (p, node) and children."""
    parts = heavy.select("node", F.ceil(F.col("n") / F.col("room")).cast("int").alias("parts"), "n", "room")
    inside = pts.join(at, "p").join(parts, "node")
    piece = F.pmod(F.xxhash64("p", F.lit(level)), F.col("parts")).cast("int")
    inside = inside.select("node", "p", "vector", "weight", "n", "parts", "room", piece.alias("piece"))
    if last:  # same centre and radius for every part
        moved = inside.select("p", F.col("node").alias("parent"), F.concat("node", F.lit("/"), "piece").alias("node"),
                              F.lit(None).cast("array<double>").alias("centre"), F.lit(None).cast("double").alias("distance"), "weight")
    else:
        few = F.pmod(F.xxhash64(F.lit(level), "p"), F.lit(1 << 40)) < F.lit(4.0 * SAMPLE * (1 << 40)) / F.col("n")
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64(F.lit(level), "p"), "p"))
        sample = inside.filter(few).withColumn("k", rank).filter(F.col("k") <= SAMPLE)
        fan = F.least(F.lit(FANOUT), F.greatest(F.lit(2), F.ceil(2 * F.col("n") / F.col("room")))).cast("int")
        chosen = (sample.select("node", "vector", fan.alias("most"))
                  .groupBy("node").applyInArrow(_node_pivots("most"), "node string, pivots array<double>"))
        spread = chosen.join(parts, "node").select("node", "pivots", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("piece"))
        moved = (inside.select("node", "piece", "p", "vector", "weight").groupBy("node", "piece")
                 .cogroup(spread.groupBy("node", "piece"))
                 .applyInArrow(_deal(r / 2), "p long, parent string, node string, centre array<double>, distance double, weight long"))
    moved.write.parquet(f"{place}/moved{level}")
    moved = spark.read.parquet(f"{place}/moved{level}")
    kids = moved.groupBy("parent", "node").agg(F.first("centre").alias("centre"), (F.max("distance") + SLACK).alias("radius"),
                                               F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min("p").alias("rep"))
    return moved.select("p", "node"), kids


def _judged(pairs: DataFrame, nodes: DataFrame, r: float) -> DataFrame:
    """Pairs (a, b) of nodes with ``linked``: true, false (to be opened), without the ones out of reach."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("centre").alias(f"c{x}"), F.col("radius").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    cos = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    d = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cos)))
    reach = F.col("ra") + F.col("rb")
    return (both.withColumn("d", d).filter(F.coalesce(F.col("d") <= r + reach + SLACK, F.lit(True)))
            .select("a", "b", F.coalesce(F.col("d") + reach + SLACK <= r, F.lit(False)).alias("linked")))


def node_pairs(spark, place: str, pts: DataFrame, r: float, cell_bytes: int, depth: int):
    """Split nodes until those in open pairs fit a cell. Returns places (p, node), open pairs of cells, linked
    pairs of nodes, and all nodes (NODE columns)."""
    at = pts.select("p", F.col("root").alias("node"))
    pts.groupBy("root").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min("p").alias("rep")).select(
        F.col("root").alias("parent"), F.col("root").alias("node"), F.lit(None).cast("array<double>").alias("centre"),
        F.lit(None).cast("double").alias("radius"), "n", "weight", "rep").write.parquet(f"{place}/nodes0")
    nodes = every = spark.read.schema(NODE).parquet(f"{place}/nodes0")
    nodes.filter("n > 1").select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(False).alias("linked")).write.parquet(f"{place}/pairs0")
    judged = spark.read.schema("a string, b string, linked boolean").parquet(f"{place}/pairs0")
    linked = judged.filter("linked")
    room = F.greatest(F.lit(2), F.floor(F.lit(cell_bytes) / 8 / F.substring_index("node", ":", 1).cast("int"))).cast("long")
    for level in range(1, depth + 2):
        open_ = judged.filter("NOT linked")
        used = open_.select(F.col("a").alias("node")).union(open_.select("b")).distinct()
        heavy = nodes.join(used, "node").select("node", "n", room.alias("room"), "centre", "radius").filter("n > room")
        if level > depth + 1 or heavy.isEmpty():
            break
        last = level == depth + 1
        moved, kids = _split(spark, place, level, pts, at, heavy, r, last)
        if last:
            keep = heavy.select(F.col("node").alias("parent"), F.col("centre").alias("c"), F.col("radius").alias("q"))
            kids = kids.join(keep, "parent").withColumn("centre", F.col("c")).withColumn("radius", F.col("q")).drop("c", "q")
        kids.select("parent", "node", "centre", "radius", "n", "weight", "rep").write.parquet(f"{place}/nodes{level}")
        kids = spark.read.schema(NODE).parquet(f"{place}/nodes{level}")
        every = every.unionByName(kids)
        (at.join(moved.withColumnRenamed("node", "to"), "p", "left").select("p", F.coalesce("to", "node").alias("node"))
         .write.parquet(f"{place}/at{level}"))
        at = spark.read.schema("p long, node string").parquet(f"{place}/at{level}")
        same = nodes.join(heavy.select("node"), "node", "left_anti").withColumn("parent", F.col("node"))
        nodes = same.select(*kids.columns).unionByName(kids)
        nodes.write.parquet(f"{place}/now{level}")
        nodes = spark.read.schema(NODE).parquet(f"{place}/now{level}")
        child = lambda x: nodes.select(F.col("parent").alias(x), F.col("node").alias(f"{x}2"))
        down = open_.select("a", "b").join(child("a"), "a").join(child("b"), "b").filter("a != b OR a2 <= b2")
        down = down.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        _judged(down, nodes, r).write.parquet(f"{place}/pairs{level}")
        judged = spark.read.schema("a string, b string, linked boolean").parquet(f"{place}/pairs{level}")
        linked = linked.unionByName(judged.filter("linked"))
    return at, judged.filter("NOT linked").select("a", "b"), linked.select("a", "b"), every


CELL = "node string, p binary, weight binary, x binary, dim int, first binary, last binary, centre binary, radius binary, child binary, n_child binary"


def _pack(table: pa.Table) -> pa.Table:
    x = unit(_matrix(table["vector"]))
    tree = Tree.build(x)
    p, weight = (table[c].to_numpy()[tree.order] for c in ("p", "weight"))
    blobs = [p, weight, tree.x] + [None] + [getattr(tree, f) for f in Tree.FIELDS]
    return pa.table([table["node"][:1], *(pa.array([x.shape[1]], pa.int32()) if b is None else pa.array([b.tobytes()], pa.binary()) for b in blobs)],
                    names=["node", "p", "weight", "x", "dim", *Tree.FIELDS])


def _unpack(table: pa.Table, k: int):
    get = lambda name, kind: np.frombuffer(table[name][k].as_buffer(), kind)
    tree = Tree()
    for f in Tree.FIELDS:
        setattr(tree, f, get(f, np.float64 if f == "radius" else np.int64))
    tree.x = get("x", np.float64).reshape(-1, table["dim"][k].as_py())
    return tree, get("p", np.int64), get("weight", np.int64)


def _meet(min_cosine: float):
    """One pair of cells (or one cell with itself): (p, w, to): weight linked to a point, and a forest edge."""
    def run(table: pa.Table) -> pa.Table:
        same = table.num_rows == 1
        a, pa_, wa = _unpack(table, 0)
        b, pb, wb = (a, pa_, wa) if same else _unpack(table, 1)
        got_a, got_b, label = links(a, b, wa, wb, same, min_cosine)
        p, w = (pa_, got_a) if same else (np.concatenate([pa_, pb]), np.concatenate([got_a, got_b]))
        keep = w > 0
        return pa.table({"p": p[keep], "w": w[keep], "to": p[label[keep]]})

    return run


def link_counts(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                min_cosine: float = MIN_COSINE, cell_bytes: int = CELL_BYTES, depth: int = DEPTH) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per vector."""
    spark = vectors.sparkSession
    ship_package(spark)
    place = scratch_dir(spark, "covertree")
    r = math.sqrt(2 - 2 * min_cosine)
    rows = _keyed(vectors, id_col, vector_col, label_col)
    (rows.filter("root IS NOT NULL").groupBy("k1", "k2", "root")
     .agg(F.first("vector").alias("vector"), F.min("vec_id").alias("id"), F.count("*").alias("weight"))
     .withColumn("p", F.monotonically_increasing_id())
     .select("p", "root", "vector", "id", "weight", "k1", "k2").write.parquet(f"{place}/points"))
    pts = spark.read.schema(POINT).parquet(f"{place}/points")
    at, open_, linked, nodes = node_pairs(spark, place, pts, r, cell_bytes, depth)

    # trees of the cells in open pairs, and their meetings
    need = (open_.withColumn("pair", F.struct("a", "b")).select("pair", F.explode(F.array_distinct(F.array("a", "b"))).alias("node")))
    cells = (pts.join(at, "p").join(need.select("node").distinct(), "node", "left_semi").select("node", "p", "weight", "vector")
             .groupBy("node").applyInArrow(_pack, CELL))
    (need.join(cells, "node").groupBy("pair").applyInArrow(_meet(min_cosine), "p long, w long, to long")
     .write.parquet(f"{place}/met"))
    met = spark.read.schema("p long, w long, to long").parquet(f"{place}/met")
    counts = met.select("p", "w")
    edges = met.select("p", F.col("to").alias("q"))

    # pairs of nodes linked as a whole: every point below one counts the other's weight
    if not linked.isEmpty():
        stat = nodes.select(F.col("node").alias("b"), "weight", "rep")
        both = linked.union(linked.filter("a != b").select("b", "a")).toDF("a", "b").join(stat, "b")
        of_node = both.groupBy("a").agg(F.sum("weight").alias("w"), F.max((F.col("a") == F.col("b")).cast("long")).alias("own"),
                                        F.min("rep").alias("to"))
        path = F.split("node", "(?<!/)/(?!/)")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, 1, i), "/"))
        above = at.select("node").distinct().select("node", F.explode(prefixes).alias("a")).join(of_node, "a")
        hit = pts.select("p", F.col("weight").alias("mine")).join(at, "p").join(above.select("node", "w", "own", "to"), "node")
        hit.select("p", (F.col("w") - F.col("own") * F.col("mine")).alias("w"), F.col("to").alias("q")).write.parquet(f"{place}/whole")
        whole = spark.read.schema("p long, w long, q long").parquet(f"{place}/whole")
        reps = both.join(stat.select(F.col("b").alias("a"), F.col("rep").alias("p")), "a").select("p", F.col("rep").alias("q"))
        counts = counts.unionByName(whole.select("p", "w"))
        edges = edges.unionByName(whole.select("p", "q")).unionByName(reps)

    edges = edges.filter("p != q").select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct()
    joined = components(edges)
    total = counts.groupBy("p").agg(F.sum("w").alias("w"))
    done = (pts.drop("root").join(total, "p", "left").join(joined.select(F.col("id").alias("p"), F.col("root").alias("c")), "p", "left")
            .select("k1", "k2", "id", (F.coalesce("w", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("c", "p").alias("c")))
    least = done.groupBy("c").agg(F.min("id").alias("component_id"))
    done = done.join(least, "c").select("k1", "k2", "n_links", "component_id")
    out = rows.select("vec_id", "root", "k1", "k2").join(done, ["k1", "k2"], "left")
    # a row that is no point stands for itself
    usable = F.col("root").isNotNull()
    component = F.when(usable, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(usable, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
