"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. It is named by its smallest member
and its depth: at one depth a conversation is member of one node only. Turns are
known by 128-bit hashes; the xor of place-bound turn hashes names a prefix, so a
prefix is a running xor and no conversation is ever held whole.

Sums over subtrees come from the parent-edge forest. A component's centroid is
the deepest node that bears more than half of its weight, and the nodes with
more than half are just the path from the centroid to the component's top. Cutting
there adds the total below the centroid to that path and leaves components of at
most half the weight. Large components are cut by joins; those of bounded weight
are finished in the same way by tasks, many at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pliego.llm.common import cut

# Weight (rows of conversations' paths) up to which a component is finished by one
# task; rows that such a task holds at a time, one component more at most.
LOCAL_WEIGHT = 65536
LOCAL_ROWS = 1 << 18
# Turns of a conversation summed up in one group; conversations in one piece of a list of ends.
BLOCK = 4096
CHUNK = 512

NODE = ["depth", "k1", "k2"]
TOP = ["td", "t1", "t2"]


def n_words(text: Column) -> Column:
    """Runs of characters other than \\x20 and \\x09-\\x0D."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def numbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with pos: 1, 2, 3 ... within ``keys`` (no key: over all). Rows are
    dealt out by ranges of (keys, order) and written; a key that spans ranges is
    numbered range by range from their sizes, so a hot key is many tasks' work."""
    dealt = cut(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    firsts = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    both = dealt.withColumn("_place", place).join(firsts, [*keys, "_part"])
    return both.withColumn("pos", (F.col("_first") + F.col("_place")).cast("long")).drop("_first", "_place", "_part")


def own_turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, pos (from 1), t1, t2 (hashes of role and text) and w (words of the text)."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    slim = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.xxhash64(by, said).alias("t1"),
        F.xxhash64(F.lit("again"), said, by).alias("t2"),
        n_words(said).alias("w"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_u"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2"), F.col("_u")]
    return numbered(cut(slim, "slim"), ["conv"], order).drop("turn", "_u")


def rebuilt(own: DataFrame, lead: int, family: int) -> tuple[DataFrame, DataFrame]:
    """(conv, n: number of rebuilt turns; every conversation) and the rebuilt turns
    conv, depth, t1, t2, w, n. A conversation takes its first h turns from the
    first of its family, h being a hash of its id below ``lead``."""
    c = F.col("conv")
    sizes = cut(own.groupBy("conv").agg(F.count(F.lit(1)).alias("_own")), "sizes")
    kin = sizes.withColumn("_h", F.crc32(c.cast("string").cast("binary")) % lead).withColumn("_base", c - c % family)
    base = sizes.select(F.col("conv").alias("_base"), F.col("_own").alias("_theirs"))
    kin = kin.join(base, "_base", "left").withColumn("_led", F.least("_h", F.coalesce("_theirs", F.lit(0))))
    kin = cut(kin.withColumn("n", F.col("_led") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))), "kin")
    heads = own.filter(F.col("pos") < lead).withColumnRenamed("conv", "_base")
    led = kin.join(heads, "_base").filter(F.col("pos") <= F.col("_h")).select("conv", F.col("pos").alias("depth"), "t1", "t2", "w", "n")
    rest = own.join(kin, "conv").filter(F.col("pos") > F.col("_h"))
    rest = rest.select("conv", (F.col("pos") - F.col("_h") + F.col("_led")).alias("depth"), "t1", "t2", "w", "n")
    return kin.select("conv", "n"), cut(led.unionByName(rest), "rebuilt")


def paths(turns: DataFrame) -> DataFrame:
    """``turns`` with k1, k2, the prefix that ends with the turn, and p1, p2, the
    one before it: running xors, blocks of turns summed up apart."""
    x = [F.xxhash64(F.lit(i), "depth", "t1", "t2").alias(f"x{i}") for i in (1, 2)]
    turns = turns.select("conv", "depth", "w", "n", *x, F.expr(f"(depth - 1) div {BLOCK}").alias("_block"))
    sums = turns.groupBy("conv", "_block").agg(*[F.bit_xor(f"x{i}").alias(f"b{i}") for i in (1, 2)])
    before = Window.partitionBy("conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    firsts = sums.select("conv", "_block", *[F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    within = Window.partitionBy("conv", "_block").orderBy("depth")
    runs = turns.select("*", *[F.bit_xor(f"x{i}").over(within).alias(f"r{i}") for i in (1, 2)]).join(firsts, ["conv", "_block"])
    keys = [F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"k{i}") for i in (1, 2)]
    parents = [F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")).bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)]
    return cut(runs.select("conv", "depth", "w", "n", *keys, *parents), "paths")


def trie_nodes(convs: DataFrame, path: DataFrame) -> DataFrame:
    """Every node: NODE, p1, p2 (its parent's key), conv_id (smallest member),
    parent_conv_id, n_convs, n_children, w, and weight: the rows of members' paths
    in its subtree, itself included. The root has depth 0 and key 0."""
    count, least = F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")
    weight = F.sum(F.col("n") - F.col("depth") + 1).alias("weight")
    # A node's members share their prefix, so its parent and words are the same in every row.
    inner = path.groupBy(*NODE).agg(least, count, F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("w").alias("w"), weight)
    none = F.lit(None).cast("long")
    root = convs.withColumn("depth", F.lit(0).cast("long")).agg(least, count, weight).filter("n_convs > 0")
    root = root.select(*[F.lit(0).cast("long").alias(c) for c in NODE], "conv_id", "n_convs", none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("w"), "weight")
    nodes = cut(inner.unionByName(root), "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.filter("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = cut(nodes.join(parents, ["depth", "p1", "p2"], "left"), "named")
    return named.join(children, NODE, "left").na.fill(0, ["n_children"])


def cut_components(big: DataFrame, path: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut each component of ``big`` at its centroid: (the centroids, their sums
    complete; the other nodes in their new components)."""
    weighty = F.col("weight") * 2 > F.col("total")
    centroid = F.max_by(F.struct(*NODE, "weight"), "depth").alias("c")
    found = big.filter(weighty).groupBy(*TOP).agg(centroid)
    found = found.select(*TOP, F.col("c.depth").alias("cd"), F.col("c.k1").alias("c1"), F.col("c.k2").alias("c2"), F.col("c.weight").alias("cw"))
    # The path of a node is that of its smallest member: one step below the
    # centroid's depth it tells whether the node is below, and under which child.
    step = path.select(F.col("conv").alias("conv_id"), (F.col("depth") - 1).alias("cd"), "k1", "k2", "p1", "p2")
    step = step.select("conv_id", "cd", *[F.col(c).alias(f"s_{c}") for c in ("k1", "k2", "p1", "p2")])
    here = big.join(found, TOP).join(step, ["conv_id", "cd"], "left")
    same = lambda a, b: (F.col(a) == F.col("c1")) & (F.col(b) == F.col("c2"))
    side = F.when((F.col("depth") == F.col("cd")) & same("k1", "k2"), 0).when((F.col("depth") > F.col("cd")) & same("s_p1", "s_p2"), 1).otherwise(-1)
    here = cut(here.withColumn("_side", side), "sides")
    below = here.filter("_side >= 0").groupBy(*TOP).agg(F.sum("leaf").alias("_leaf"), F.sum("saved").alias("_saved"))
    centroids = here.filter("_side = 0").join(below, TOP)
    centroids = centroids.withColumn("n_leaves", F.col("n_leaves") + F.col("_leaf")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("_saved"))
    above = here.filter("_side = -1").join(below, TOP)
    for name, add in (("n_leaves", F.col("_leaf")), ("saved_tokens", F.col("_saved")), ("weight", -F.col("cw"))):
        above = above.withColumn(f"_{name}", F.when(weighty, F.col(name) + add).otherwise(F.col(name)))
    above = above.withColumn("total", F.col("total") - F.col("cw")).drop("n_leaves", "saved_tokens", "weight")
    above = above.withColumnsRenamed({f"_{c}": c for c in ("n_leaves", "saved_tokens", "weight")})
    parts = here.filter("_side = 1").drop(*TOP, "total").withColumnsRenamed({"s_k1": "t1", "s_k2": "t2"}).withColumn("td", F.col("cd") + 1)
    tops = parts.filter("depth = td").select(*TOP, F.col("weight").alias("total"))
    parts = parts.join(tops, TOP)
    return centroids.select(*big.columns), above.select(*big.columns).unionByName(parts.select(*big.columns))


def finish(conv: np.ndarray, depth: np.ndarray, parent: np.ndarray, weight: np.ndarray, own: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Centroid decomposition of whole components. ``parent`` is the row of a
    node's parent, its own row for a top; ``own`` (rows x values) are a node's
    values and ``sums`` what was added before. Returns the sums over subtrees."""
    n = len(conv)
    weight, sums = weight.copy(), sums.copy()
    top = parent.copy()
    while True:  # the top of each node, by doubling
        up = top[top]
        if np.array_equal(up, top):
            break
        top = up
    live = np.argsort(depth, kind="stable")
    centroid = np.zeros(n, dtype=np.int64)
    jump = np.zeros(n, dtype=np.int64)
    while len(live):
        mine = top[live]
        path = live[2 * weight[live] > weight[mine]]
        centroid[top[path]] = path  # in order of depth: the deepest stays
        cut_at = centroid[mine]
        jump[live] = np.where((live == mine) | (live == cut_at) | (parent[live] == cut_at), live, parent[live])
        at = jump[live]
        while True:
            further = jump[at]
            if np.array_equal(further, at):
                break
            jump[live] = at = further
        below = (at != mine) | (cut_at == mine)
        total = np.zeros((n, own.shape[1]), dtype=np.int64)
        np.add.at(total, mine[below], own[live[below]])
        sums[path] += total[top[path]]
        above = path[path != centroid[top[path]]]
        weight[above] -= weight[centroid[top[above]]]
        top[live[below]] = at[below]
        live = live[live != cut_at]
    return sums


def finish_components(small: DataFrame) -> DataFrame:
    """The sums of components of bounded weight, each finished within one task."""
    kept = ["conv_id", "depth", "parent_conv_id", "weight", "leaf", "saved", "n_leaves", "saved_tokens"]
    other = [c for c in small.columns if c not in [*kept, *TOP]]
    rows = small.select(*TOP, *kept, *other)
    columns = rows.columns

    def solve(t: pa.Table, comp: np.ndarray) -> pa.Table:
        col = {c: t.column(c).to_numpy() for c in kept if c != "parent_conv_id"}
        up = t.column("parent_conv_id").fill_null(-1).to_numpy()
        names = np.unique(col["conv_id"])
        deepest = int(col["depth"].max()) + 2
        place = lambda k, d, c: (k * deepest + d) * len(names) + np.searchsorted(names, c)
        mine = place(comp, col["depth"], col["conv_id"])
        order = np.argsort(mine)
        inner = np.flatnonzero(col["depth"] > t.column("td").to_numpy())
        parent = np.arange(len(mine))
        parent[inner] = order[np.searchsorted(mine[order], place(comp[inner], col["depth"][inner] - 1, up[inner]))]
        own = np.stack([col["leaf"], col["saved"]], axis=1)
        sums = finish(col["conv_id"], col["depth"], parent, col["weight"], own, np.stack([col["n_leaves"], col["saved_tokens"]], axis=1))
        t = t.drop_columns(["n_leaves", "saved_tokens"]).append_column("n_leaves", pa.array(sums[:, 0])).append_column("saved_tokens", pa.array(sums[:, 1]))
        return t.select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            ids = np.stack([t.column(c).to_numpy() for c in TOP])
            starts = np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1])
            whole = t.num_rows if last else int(starts[-1])  # the last component may go on
            held.clear()
            if whole < t.num_rows:
                held.extend(t.slice(whole).to_batches())
            if whole:
                comp = np.zeros(t.num_rows, dtype=np.int64)
                comp[starts[1:]] = 1
                yield from solve(t.slice(0, whole), np.cumsum(comp)[:whole]).to_batches()

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= LOCAL_ROWS:
                yield from flush(False)
        if held and sum(h.num_rows for h in held):
            yield from flush(True)

    return rows.repartition(*TOP).sortWithinPartitions(*TOP).mapInArrow(run, rows.schema)


def roll_up(nodes: DataFrame, path: DataFrame, local_weight: int = LOCAL_WEIGHT) -> DataFrame:
    """``nodes`` (trie_nodes) with n_leaves and saved_tokens summed over subtrees."""
    out = []
    zero = F.lit(0).cast("long")
    now = nodes.select(
        *NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "weight",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("w")).alias("saved"),
        zero.alias("n_leaves"), zero.alias("saved_tokens"), *[zero.alias(c) for c in TOP],
    )
    now = cut(now, "forest")
    root = now.filter("depth = 0").select("weight").first()
    now = now.withColumn("total", F.lit(root.weight if root else 0).cast("long"))
    small = F.col("total") <= local_weight
    while True:
        out.append(finish_components(now.filter(small).drop("total")))
        big = now.filter(~small)
        if big.isEmpty():
            break
        done, now = cut_components(big, path)
        out.append(done.drop("total"))
        now = cut(now, "forest")
    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    return found.drop("leaf", "saved", "weight", *TOP)


def ends(convs: DataFrame, path: DataFrame) -> DataFrame:
    """NODE and ends_sha256 for nodes where conversations end: SHA-256 of their ids
    in decimal, ascending, comma-joined. Ids are joined in bounded pieces; a
    node's pieces are hashed one after another in one stream, never held together."""
    zero = F.lit(0).cast("long")
    last = path.filter("depth = n").select("conv", *NODE).unionByName(convs.filter("n = 0").select("conv", *[zero.alias(c) for c in NODE]))
    piece = numbered(last, [], [F.col("conv")]).withColumn("_piece", F.expr(f"(pos - 1) div {CHUNK}"))
    pieces = piece.groupBy(*NODE, "_piece").agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        schema = pa.schema([*[(c, pa.int64()) for c in NODE], ("ends_sha256", pa.string())])
        for b in batches:
            done = []
            for row in zip(*(b.column(c).to_pylist() for c in [*NODE, "_ids"]), strict=True):
                if row[:3] == key:
                    sha.update(b"," + row[3].encode())
                    continue
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = row[:3], hashlib.sha256(row[3].encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, sha.hexdigest()), strict=True))], schema=schema)

    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "_piece")
    return dealt.select(*NODE, "_ids").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def conversation_trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    lead: int = 4, family: int = 20, local_weight: int = LOCAL_WEIGHT,
) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Null turns come first; turns equal in ``turn`` are ordered by a hash of role
    and text, repeated rows are turns of their own. A null role or text is empty.
    Rows without a conversation id belong to no conversation and are left out. An
    empty table has no node, not even a root. Other columns don't matter.
    """
    convs, turns = rebuilt(own_turns(conversations, conv_id, turn, role, text), lead, family)
    path = paths(turns)
    found = roll_up(trie_nodes(convs, path), path, local_weight)
    none = hashlib.sha256(b"").hexdigest()
    out = found.join(ends(convs, path), NODE, "left").na.fill(none, ["ends_sha256"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
