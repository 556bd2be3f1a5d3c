"""Embedding near-dedup by a cover tree and dual traversal.

The tree goes down by radius, at every size alike. Its top levels, radii halving
from the root, are pivots from a bounded sample; every vector descends to a
leaf, whose covering radius is measured over all its vectors. Blocks of
neighbouring leaves get their lower levels within tasks: nested nets down to
knots, so narrow that all vectors of a knot link. The dual traversal compares
leaves, then nodes of two blocks, then knots: a pair whose centres lie farther
apart than the link distance and both covering radii is pruned, one that lies
within the link distance with both radii added links as a whole. What is left
between two knots of several vectors is compared vector by vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import arrow_batches, cut, with_fields
from pliego.llm.components import components

THRESHOLD = 0.95
BLOCK = 4096  # vectors whose lower levels a task builds, knots it compares with as many others
SAMPLE = 2048  # vectors the pivots come from, at most
LEAVES = 1024  # of the top levels, which the driver holds; the tree goes on below them
SLACK = 1e-6  # of distances, above rounding in double precision
NARROW = 0.49  # radius of a knot, of the link distance: its vectors lie within that distance
FLAT = 1e-4  # link distance below which every vector is a knot, since SLACK would blur narrower ones


def unit_rows(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as unit rows in double precision, shorter ones padded with zeros, and their lengths."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    size = np.asarray(vectors.value_lengths())
    if len(size) and (size == width).all():
        rows = values.reshape(-1, width)
    else:
        rows = np.zeros((len(size), width))
        rows[np.arange(width) < size[:, None]] = values
    if len(rows):
        rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that no square over- or underflows
        rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return rows, size


@dataclass
class Node:
    """``centre`` is a row of the pivots; ``radius`` covers all vectors below."""

    centre: int
    children: list[Node] = field(default_factory=list)
    leaf: int = -1
    radius: float = 0.0


def build_tree(pivots: np.ndarray, leaves: int, least: float = SLACK) -> tuple[Node, np.ndarray]:
    """Nested levels over the pivots: radii 2, 1, 1/2, ... Each level keeps the
    centres above it and adds, farthest first, those it takes to cover the sample,
    until it is covered within ``least`` or ``leaves`` is reached. Gives the root
    and the leaves' centres."""
    centres = [0]
    nearest = np.linalg.norm(pivots - pivots[0], axis=1)
    owner = np.zeros(len(pivots), dtype=int)
    root = Node(0)
    level = {0: root}  # centre -> its node of the lowest level
    radius = 2.0
    while len(centres) < leaves and nearest.max() > least:
        radius /= 2
        parents = dict(level)
        level = {}
        for c, node in parents.items():
            level[c] = Node(c)
            node.children.append(level[c])
        own = owner.copy()  # centre of the level above that is nearest to a pivot
        while len(centres) < leaves and nearest.max() > max(radius, least):
            far = int(nearest.argmax())
            centres.append(far)
            level[far] = Node(far)
            parents[int(own[far])].children.append(level[far])
            gap = np.linalg.norm(pivots - pivots[far], axis=1)
            closer = gap < nearest
            nearest[closer], owner[closer] = gap[closer], far
    for i, c in enumerate(level):
        level[c].leaf = i
    return root, pivots[list(level)]


def descend(root: Node, pivots: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf of each row, and its distance from the leaf's centre: at each level a
    row goes to the nearest child."""
    leaf, gap = np.zeros(len(rows), dtype=np.int32), np.zeros(len(rows))
    stack = [(root, np.arange(len(rows)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if not node.children:
            leaf[at] = node.leaf
            gap[at] = np.linalg.norm(rows[at] - pivots[node.centre], axis=1)
            continue
        centres = pivots[[c.centre for c in node.children]]
        best = (rows[at] @ centres.T).argmax(axis=1)
        stack.extend((c, at[best == i]) for i, c in enumerate(node.children))
    return leaf, gap


def cover(node: Node, pivots: np.ndarray, radii: dict[int, float]) -> list[int]:
    """Set covering radii from the leaves up; gives the leaves below that hold vectors."""
    if not node.children:
        node.radius = radii.get(node.leaf, -1.0)
        return [node.leaf] if node.radius >= 0 else []
    below = [leaf for c in node.children for leaf in cover(c, pivots, radii)]
    reach = [float(np.linalg.norm(pivots[c.centre] - pivots[node.centre])) + c.radius for c in node.children if c.radius >= 0]
    node.radius = max(reach, default=-1.0)
    return below


def leaf_pairs(root: Node, pivots: np.ndarray, link: float) -> list[tuple[int, int]]:
    """Dual traversal: unordered pairs of leaves that may hold vectors within ``link``."""
    out: set[tuple[int, int]] = set()
    stack = [(root, root)] if root.radius >= 0 else []
    while stack:
        a, b = stack.pop()
        if not a.children and not b.children:
            out.add((min(a.leaf, b.leaf), max(a.leaf, b.leaf)))
            continue
        xs = [c for c in a.children or [a] if c.radius >= 0]
        ys = xs if a is b else [c for c in b.children or [b] if c.radius >= 0]
        gap = distances(pivots[[x.centre for x in xs]] @ pivots[[y.centre for y in ys]].T)
        near = gap <= link + SLACK + np.add.outer([x.radius for x in xs], [y.radius for y in ys])
        stack.extend((xs[i], ys[j]) for i, j in np.argwhere(near) if a is not b or i <= j)
    return sorted(out)


def distances(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosines))


def nets(rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nested nets over unit rows, radii 1, 1/2, ... down to ``least``: the centres of a
    net are more than its radius apart and cover all rows within it. Gives each
    row's knot, the nearest centre of the last net, each row's node, the nearest
    one of the net before that, and the knots' centres as row numbers."""
    centres = [0]
    best, owner, node = distances(rows @ rows[0]), np.zeros(len(rows), int), np.zeros(len(rows), int)
    best[0] = 0.0
    radius = 2.0
    while radius > least:
        radius = max(least, radius / 2)
        if radius == least:
            node = owner.copy()
        bare = np.flatnonzero(best > radius)
        while len(bare):
            some = bare[:256]
            gap = distances(rows[some] @ rows[some].T)
            left, new = np.ones(len(some), bool), []
            for i in range(len(some)):
                if left[i]:
                    new.append(i)
                    left &= gap[i] > radius
            at = some[new]
            gap = distances(rows @ rows[at].T)
            near = gap.argmin(axis=1)
            gap = gap[np.arange(len(rows)), near]
            closer = gap < best
            best[closer], owner[closer] = gap[closer], near[closer] + len(centres)
            best[at], owner[at] = 0.0, np.arange(len(at)) + len(centres)
            centres.extend(at)
            bare = bare[best[bare] > radius]
    return owner, node, np.array(centres)


def centred(rows: np.ndarray, starts: np.ndarray, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean directions of runs of ``rows`` that begin at ``starts``, and their covering
    radii over the rows and what these themselves ``reach``."""
    size = np.diff(np.append(starts, len(rows)))
    mean = np.add.reduceat(rows, starts)
    length = np.linalg.norm(mean, axis=1, keepdims=True)
    mean = np.where(length > SLACK, mean / np.maximum(length, SLACK), rows[starts])
    mean[size == 1] = rows[starts[size == 1]]
    gap = distances(np.einsum("ij,ij->i", rows, np.repeat(mean, size, axis=0)))
    gap[np.repeat(size == 1, size)] = 0.0
    return mean, np.maximum.reduceat(gap if reach is None else gap + reach, starts)


def lower_levels(rows: np.ndarray, length: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree below a block. Gives an order of its rows in which nodes and knots are
    runs, and in it each row's node and knot, the first row of each knot, the
    knots' centres and radii. Rows of different ``length`` share no knot."""
    node, knot, base = np.zeros(len(rows), int), np.zeros(len(rows), int), 0
    for size in np.unique(length):
        at = np.flatnonzero(length == size)
        if least > 0:
            k, v, centres = nets(rows[at], least)
        else:
            k, v, centres = np.arange(len(at)), np.zeros(len(at), int), at
        # A knot lies in the node of its centre.
        knot[at] = k + base
        node[at] = (v[centres] if least > 0 else v)[k] + base
        base += len(centres)
    order = np.lexsort((knot, node))
    node, knot = node[order], knot[order]
    starts = np.flatnonzero(np.append(True, knot[1:] != knot[:-1]))
    mean, radius = centred(rows[order], starts)
    return order, node, knot, starts, mean, radius


@dataclass
class Side:
    """Knots of one side of a comparison, those of a node side by side."""

    unit: np.ndarray
    radius: np.ndarray
    single: np.ndarray
    size: np.ndarray
    weight: np.ndarray
    starts: np.ndarray  # of the nodes


def spread(found: np.ndarray, label: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
    """Join the labels of ``rows`` and ``cols`` that ``found`` links; edges (row, its
    label) of the result are a forest with the same components."""
    for i in np.flatnonzero(found.any(axis=1)):
        roots = np.unique(label[np.append(cols[found[i]], rows[i])])
        if len(roots) > 1:
            label[np.isin(label, roots[1:])] = roots[0]


def compare_knots(a: Side, b: Side | None, link: float, threshold: float) -> tuple[np.ndarray, np.ndarray, list, list, int]:
    """Dual traversal of two blocks (None: of one with itself), nodes first. Gives for
    either side the weight of what each knot links with as a whole, edges of a
    forest over all knots, the pairs (i, j) that only their vectors can tell, and
    the number of pairs of nodes and of knots whose distance was taken."""
    n, one = len(a.unit), b is None
    b = a if b is None else b
    ca, ra = centred(a.unit, a.starts, a.radius)
    cb, rb = centred(b.unit, b.starts, b.radius)
    live = distances(ca @ cb.T) <= link + SLACK + ra[:, None] + rb[None, :]
    node_a = np.repeat(np.arange(len(ca)), np.diff(np.append(a.starts, n)))
    node_b = np.repeat(np.arange(len(cb)), np.diff(np.append(b.starts, len(b.unit))))
    count_a, count_b = np.zeros(n, np.int64), np.zeros(len(b.unit), np.int64)
    label = np.arange(n if one else n + len(b.unit))
    shift = 0 if one else n
    open_a, open_b, taken = [], [], len(ca) * (len(ca) + 1) // 2 if one else len(ca) * len(cb)
    for s in range(0, n, 512):
        r = np.arange(s, min(n, s + 512))
        c = np.flatnonzero(live[node_a[r[0]] : node_a[r[-1]] + 1].any(axis=0)[node_b])
        if one:
            c = c[c >= s]
        if not len(c):
            continue
        cosine = a.unit[r] @ b.unit[c].T
        gap, reach = distances(cosine), a.radius[r][:, None] + b.radius[c][None, :]
        single = a.single[r][:, None] & b.single[c][None, :]
        near = np.where(single, cosine >= threshold, gap + reach <= link - SLACK)
        rest = ~single & ~near & (gap <= link + reach + SLACK)
        fit = a.size[r][:, None] == b.size[c][None, :]
        if one:  # each pair once
            fit &= r[:, None] < c[None, :]
        taken += int(fit.sum())
        near &= fit
        rest &= fit
        count_a[r] += near @ b.weight[c]
        count_b[c] += a.weight[r] @ near
        spread(near, label, r, c + shift)
        i, j = np.nonzero(rest)
        open_a.append(r[i])
        open_b.append(c[j])
    moved = np.flatnonzero(label != np.arange(len(label)))
    rest = list(zip(np.concatenate([*open_a, np.zeros(0, int)]), np.concatenate([*open_b, np.zeros(0, int)]), strict=True))
    return count_a, count_b, list(zip(moved, label[moved], strict=True)), rest, taken


def _valid(vec: str) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vec).isNotNull() & ~bad & F.exists(vec, lambda x: x != 0)


def _placed(classes: DataFrame, root: Node, pivots: np.ndarray, width: int) -> DataFrame:
    """``classes`` with the leaf each vector descends to and its distance from the leaf's centre."""
    schema = with_fields(classes, "leaf int, gap double")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, _ = unit_rows(b.column("v"), width)
            leaf, gap = descend(root, pivots, own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(gap)], names=schema.names)

    return classes.mapInArrow(place, schema)


def pack_leaves(leaves: list[tuple[int, int]], block: int) -> dict[int, tuple[int, int]]:
    """Leaves (number, vectors) in the tree's order to units: leaf -> (unit, its blocks).
    Neighbours share a unit of one block; a leaf beyond that is a unit of several."""
    units, unit, held = {}, -1, block
    for leaf, n in leaves:
        if held + n > block:
            unit, held = unit + 1, 0
        held += n
        units[leaf] = (unit, max(1, math.ceil(n / block)))
    return units


# Rows of a block with their knot; ``centre`` to ``single`` stand in a knot's first row.
TREE = "c long, n long, v {v}, unit int, knot long, name long, node long, weight_all long, centre array<double>, radius double, weight long, single boolean"
MEET = "kind string, a long, b long, n long, with array<long>, x long, y long"
EXACT = "kind string, a long, b long, n long"
INDEX = 1 << 20  # knots of a block are numbered below this


def _matrix(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)


def _knots(t: pa.Table, width: int, least: float) -> pa.Table:
    """The lower levels of one block."""
    v = _matrix(t.column("v"))
    unit, size = unit_rows(v, width)
    order, node, knot, starts, mean, radius = lower_levels(unit, size, least)
    c, n = t.column("c").to_numpy()[order], t.column("n").to_numpy()[order]
    base = t.column("home")[0].as_py() * INDEX
    count = np.diff(np.append(starts, len(order)))
    weight = np.add.reduceat(n, starts)
    first = np.zeros(len(order), bool)
    first[starts] = True
    at = np.cumsum(first) - 1
    centre = [None] * len(order)
    for i, row in zip(starts, mean, strict=True):
        centre[i] = row
    none = ~first
    columns = {
        "c": c, "n": n, "v": v.take(pa.array(order)), "unit": t.column("unit").combine_chunks(),
        "knot": base + at, "name": np.minimum.reduceat(c, starts)[at], "node": base + node, "weight_all": weight[at],
        "centre": pa.array(centre, pa.list_(pa.float64())), "radius": pa.array(radius[at], mask=none),
        "weight": pa.array(weight[at], mask=none), "single": pa.array(count[at] == 1, mask=none),
    }
    return pa.table(columns)


def _meet(t: pa.Table, width: int, link: float, threshold: float) -> pa.Table:
    """Knots of two blocks, or of one: what links as a whole, and what is left open."""
    knot, name, node = (t.column(c).to_numpy() for c in ("knot", "name", "node"))
    first = t.column("first").to_numpy().astype(bool)
    order = np.lexsort((knot, node, ~first))
    unit = _matrix(t.column("v")).flatten().to_numpy().reshape(-1, width)
    k = int(first.sum())
    one = t.column("x")[0].as_py() == t.column("y")[0].as_py()

    def side(at: np.ndarray) -> Side:
        own = node[at]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        return Side(unit[at], *(t.column(c).to_numpy()[at] for c in ("radius", "single", "size", "weight")), starts)

    knot, name = knot[order], name[order]
    shift = 0 if one else k
    if not one and k in (0, len(order)):  # nothing to meet
        return pa.table({"kind": pa.array([], pa.string()), **{c: pa.array([], pa.int64()) for c in "abn"}, "with": pa.array([], pa.list_(pa.int64())), **{c: pa.array([], pa.int64()) for c in "xy"}})
    ca, cb, edges, rest, taken = compare_knots(side(order[:k]), None if one else side(order[k:]), link, threshold)
    counts = ca + cb if one else np.concatenate([ca, cb])
    has = np.flatnonzero(counts)
    lists: dict[tuple[int, int, int], list[int]] = {}
    for i, j in rest:
        a, b = sorted((int(knot[i]), int(knot[j + shift])))
        lists.setdefault((a, a // INDEX, b // INDEX), []).append(b)
    kinds = [("links", len(has)), ("edge", len(edges)), ("open", len(lists)), ("taken", 1)]
    none = [None] * (len(has) + len(edges))
    return pa.table({
        "kind": pa.array([k for k, m in kinds for _ in range(m)], pa.string()),
        "a": pa.array([*knot[has].tolist(), *(int(name[i]) for i, _ in edges), *(a for a, _, _ in lists), None], pa.int64()),
        "b": pa.array([*[None] * len(has), *(int(name[j]) for _, j in edges), *[None] * (len(lists) + 1)], pa.int64()),
        "n": pa.array([*counts[has].tolist(), *[None] * (len(edges) + len(lists)), taken], pa.int64()),
        "with": pa.array([*none, *lists.values(), None], pa.list_(pa.int64())),
        "x": pa.array([*none, *(x for _, x, _ in lists), None], pa.int64()),
        "y": pa.array([*none, *(y for _, _, y in lists), None], pa.int64()),
    })


def _exact(t: pa.Table, pairs: pa.Table, width: int, threshold: float) -> pa.Table:
    """Vectors of the knots of two blocks that bounds leave open, compared pair by pair."""
    ids = t.column("knot").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    c, n, name = (t.column(k).to_numpy()[order] for k in ("c", "n", "name"))
    unit, _ = unit_rows(_matrix(t.column("v")).take(pa.array(order)), width)
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    known = ids[starts]
    at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
    meets = np.zeros((len(known), len(known)), bool)
    for a, others in zip(pairs.column("knot").to_pylist(), pairs.column("with").to_pylist(), strict=True):
        meets[np.searchsorted(known, a), np.searchsorted(known, others)] = True
    count, hit, taken = np.zeros(len(ids), np.int64), np.zeros_like(meets), 0
    for s in range(0, len(ids), 512):
        r = np.arange(s, min(len(ids), s + 512))
        wanted = meets[at[r[0]] : at[r[-1]] + 1].any(axis=0)
        q = np.flatnonzero(wanted[at])
        if not len(q):
            continue
        mask = meets[at[r]][:, at[q]]
        taken += int(mask.sum())
        near = (unit[r] @ unit[q].T >= threshold) & mask
        count[r] += near @ n[q]
        count[q] += n[r] @ near
        cols = np.flatnonzero(np.append(True, at[q][1:] != at[q][:-1]))
        rows = np.flatnonzero(np.append(True, at[r][1:] != at[r][:-1]))
        block = np.logical_or.reduceat(np.logical_or.reduceat(near, cols, axis=1), rows, axis=0)
        hit[np.ix_(at[r][rows], at[q][cols])] |= block
    has = np.flatnonzero(count)
    i, j = np.nonzero(hit)
    lead = name[starts]
    return pa.table({
        "kind": pa.array(["links"] * len(has) + ["edge"] * len(i) + ["taken"], pa.string()),
        "a": pa.array([*c[has].tolist(), *lead[i].tolist(), None], pa.int64()),
        "b": pa.array([*name[has].tolist(), *lead[j].tolist(), None], pa.int64()),
        "n": pa.array([*count[has].tolist(), *[None] * len(i), taken], pa.int64()),
    })


def embedding_links(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", threshold: float = THRESHOLD, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors``.

    Two vectors link if their cosine in double precision is ``threshold`` or more
    and they have equally many components. Null, empty and zero vectors, those
    with null or non-finite components and rows without vec_id link with
    nothing: no links, their own id as component, kept (not kept without one).
    Equal vectors are compared once and counted as often as there are rows, so
    copies cost nothing; rows that share a vec_id are one node. An empty table
    gives none. ``report`` is filled with the numbers of distinct vectors, leaves,
    pairs of leaves that remain, knots, pairs of nodes and knots whose distance
    was taken, and pairs of vectors compared one by one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("_id"), F.col(vec).alias("_v"))
    good = F.coalesce(_valid("_v"), F.lit(False)) & F.col("_id").isNotNull()
    hashes = [F.xxhash64("_v").alias("_h1"), F.xxhash64(F.lit("again"), "_v").alias("_h2")]
    members = rows.select("_id", good.alias("good"), *hashes)
    classes = cut(rows.filter(good).select("*", *hashes).groupBy("_h1", "_h2").agg(F.min("_id").alias("c"), F.count(F.lit(1)).alias("n"), F.any_value("_v").alias("v")), "vectors")

    total, width = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    link = math.sqrt(max(0.0, 2 - 2 * threshold))
    least = NARROW * link if link >= FLAT else 0.0
    bound = max(64, min(SAMPLE, 4_000_000 // width))
    share = min(1 << 30, math.ceil((1 << 30) * bound / max(1, total)))
    sample = classes.filter(F.pmod("_h1", F.lit(1 << 30)) < share).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        sample = classes.limit(1).select("v").toArrow().column("v").combine_chunks()
    pivots, _ = unit_rows(sample, width)
    if len(pivots):
        root, _ = build_tree(pivots, LEAVES, max(least, SLACK))
    else:
        root, pivots = Node(0, leaf=0), np.zeros((1, width))
    if root.children == []:
        root.leaf = 0

    arrow_batches(spark, 4096)
    placed = cut(_placed(classes.select("c", "n", "v"), root, pivots, width), "placed")
    stats = {r["leaf"]: r for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap")).collect()}  # a row a leaf
    order = cover(root, pivots, {k: r["gap"] for k, r in stats.items()})
    pairs = leaf_pairs(root, pivots, link)
    units = pack_leaves([(k, stats[k]["n"]) for k in order], block)

    # Lower levels: a leaf that holds a third of all vectors is many blocks, dealt by a hash.
    names = spark.createDataFrame([(k, u, m) for k, (u, m) in units.items()] or [(-1, -1, 1)], "leaf int, unit int, m int")
    home = F.col("unit") + F.lit(LEAVES).cast("long") * F.pmod(F.xxhash64("c"), F.col("m").cast("long"))
    blocks = placed.join(F.broadcast(names), "leaf").select("c", "n", "v", "unit", home.alias("home"))
    tree = cut(blocks.groupBy("home").applyInArrow(lambda t: _knots(t, width, least), TREE.format(v=classes.schema["v"].dataType.simpleString())), "tree")
    knots = tree.filter("centre IS NOT NULL").select("knot", "name", "node", "unit", F.col("centre").alias("v"), "radius", "weight", "single", F.size("v").alias("size"))

    # Blocks of knots, whole nodes dealt by a hash: each knot goes to the blocks its own is compared with.
    parts = {r["unit"]: math.ceil(r["n"] / block) for r in knots.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a unit
    met = sorted({(x, y) for i, j in pairs for x, y in ((units[i][0], units[j][0]), (units[j][0], units[i][0]))})
    partners = spark.createDataFrame([(x, y, parts[x], parts[y]) for x, y in met] or [(-1, -1, 1, 1)], "unit int, other int, k int, m int")
    own = F.struct(F.col("unit"), F.pmod(F.xxhash64("node"), F.col("k").cast("long")).cast("int").alias("part"))
    other = F.struct(F.col("other").alias("unit"), F.col("part"))
    sent = knots.join(F.broadcast(partners), "unit").withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("met", other)
    sent = sent.select("knot", "name", "node", "v", "radius", "weight", "single", "size", F.least("own", "met").alias("x"), F.greatest("own", "met").alias("y"), (F.col("own") <= F.col("met")).alias("first"))
    found = cut(sent.groupBy("x", "y").applyInArrow(lambda t: _meet(t, width, link, threshold), MEET), "found")

    # Pairs of knots that their bounds leave open: their vectors meet, by the blocks that hold them.
    rest = found.filter("kind = 'open'").select("x", "y", F.col("a").alias("knot"), F.col("with"))
    asked = rest.select("x", "y", "knot").unionByName(rest.select("x", "y", F.explode("with").alias("knot"))).distinct()
    called = tree.select("knot", "name", "c", "n", "v").join(asked, "knot")
    listed = rest.select(F.col("x").alias("px"), F.col("y").alias("py"), "knot", "with")
    exact = called.groupBy("x", "y").cogroup(listed.groupBy("px", "py")).applyInArrow(lambda t, p: _exact(t, p, width, threshold), EXACT)
    exact = cut(exact, "exact")

    whole = found.filter("kind = 'links'").groupBy(F.col("a").alias("knot")).agg(F.sum("n").alias("k"))
    linked = tree.join(whole, "knot", "left").select("c", "name", (F.col("weight_all") - F.col("n") + F.coalesce("k", F.lit(0))).alias("linked"))
    linked = linked.unionByName(exact.filter("kind = 'links'").select(F.col("a").alias("c"), F.col("b").alias("name"), F.col("n").alias("linked")))
    counts = cut(linked.groupBy("c").agg(F.sum("linked").alias("linked"), F.min("name").alias("name"), F.max("name").alias("last")), "counts")
    # An id with vectors in several knots is one node, so these hang together.
    split = linked.join(counts.filter("name < last").select("c", F.col("name").alias("a")), "c").select("a", F.col("name").alias("b"))
    edges = found.filter("kind = 'edge'").select("a", "b").unionByName(exact.filter("kind = 'edge'").select("a", "b")).unionByName(split)
    labels = components(edges).withColumnRenamed("node", "name")
    by_class = classes.select("_h1", "_h2", "c", "n").join(counts.join(labels, "name", "left"), "c")
    by_class = cut(by_class.select("_h1", "_h2", (F.col("linked") + F.col("n") - 1).alias("n_links"), F.coalesce("root", "name").alias("component_id")), "classes")
    if report is not None:
        taken = found.filter("kind = 'taken'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        dots = exact.filter("kind = 'taken'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        report.update(vectors=total, leaves=len(stats), leaf_pairs=len(pairs), knots=knots.count(), knot_pairs=taken, vector_pairs=dots)
    linked = members.filter("good").join(by_class, ["_h1", "_h2"]).select("_id", "n_links", "component_id")
    alone = members.filter(~F.col("good")).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("_id").alias(vec_id), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def embedding_dedup(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``vectors`` whose vec_id names its component, all their columns."""
    kept = cut(embedding_links(vectors, vec, vec_id, threshold).filter("kept").select(vec_id).distinct(), "kept")
    return vectors.join(kept, vec_id, "left_semi")
