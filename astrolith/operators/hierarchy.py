"""Parent-child links of unknown depth to full hierarchies.

Every node takes one parent (the least key) as its place in a spanning forest.
Subtree sizes are summed upward, sibling ranges are prefix sums of those sizes
and are added up downward, which gives each node its nested-set range
``[pre, pre + size)`` inside its tree.  Both directions run by pointer
doubling: after round k a node's pointer is its 2^k-th ancestor, so a chain of
a million links takes 20 rounds, not a million.  A node v gains, in round k,
the sizes of the nodes whose pointer is v: exactly those 2^k links below it.

Nodes that the upward pass never finishes hang on a loop.  They, and nodes
below a node with several parents, may reach several roots; for this part of
the graph only, root distances come from doubling over (node, ancestor) pairs
that stops at the first node outside the part, where the nested-set depth
takes over.  ``Forest.descendants`` divides the graph in the same way: ranges
for the nodes with one chain of ancestors, pairs over all links for the others.

Defined results: links with a missing end are no links; repeated links count
once; a node linked to itself is a loop; empty input gives empty output; NULL
never becomes a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from astrolith.runtime import Scratch

#: siblings of one parent are summed in groups of about this many
SIBLING_BUCKET = 50_000
#: positions per bin of the range join
BIN = 4096


class Forest:
    """Nested-set view of a parent-child graph.

    ``nodes``: id, key.  ``links``: child, parent (ids, distinct).
    ``up``: id, parent, n_parents, ptr, depth, root, size, mixed: the state
    after the upward pass; ``ptr`` not NULL means unprocessed (on or below a
    loop), ``mixed`` that some ancestor or the node itself has several parents.
    """

    def __init__(self, links: DataFrame, child: str = "child", parent: str = "parent"):
        self.spark = links.sparkSession
        self.scratch = Scratch(self.spark, "hierarchy")
        put = self.scratch.put
        raw = (
            links.select(F.col(child).cast("string").alias("c"), F.col(parent).cast("string").alias("p"))
            .where((F.col("c") != "") & (F.col("p") != ""))
            .distinct()
        )
        raw = put(raw, "links")
        keys = raw.select(F.explode(F.array("c", "p")).alias("key")).distinct()
        self.nodes = put(keys.select(F.monotonically_increasing_id().alias("id"), "key"), "nodes")
        a = self.nodes.select(F.col("id").alias("child"), F.col("key").alias("c"))
        b = self.nodes.select(F.col("id").alias("parent"), F.col("key").alias("p"))
        self.links = put(raw.join(a, "c").join(b, "p").select("child", "parent", "p"), "coded")
        self.scratch.drop(raw)
        self.up = self._upward()

    def _upward(self) -> DataFrame:
        put = self.scratch.put
        chosen = self.links.groupBy("child").agg(
            F.min_by("parent", "p").alias("parent"), F.count(F.lit(1)).alias("n_parents")
        )
        state = (
            self.nodes.select("id")
            .join(chosen, F.col("id") == F.col("child"), "left")
            .select(
                "id",
                "parent",
                F.coalesce("n_parents", F.lit(0)).alias("n_parents"),
                F.col("parent").alias("ptr"),
                F.col("parent").isNotNull().cast("long").alias("depth"),
                F.when(F.col("parent").isNull(), F.col("id")).alias("root"),
                F.lit(1).cast("long").alias("size"),
                (F.coalesce("n_parents", F.lit(0)) > 1).alias("mixed"),
            )
        )
        state = put(state, "up")
        open_before = None
        while True:
            open_now = state.where(F.col("ptr").isNotNull()).count()
            # no chain of nodes finished in the last round: what is left is loops
            if open_now == 0 or open_now == open_before:
                return state
            open_before = open_now
            moving = state.where(F.col("ptr").isNotNull())
            gain = moving.groupBy("ptr").agg(F.sum("size").alias("gain"))
            hop = state.select(
                F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("depth").alias("depth2"),
                F.col("root").alias("root2"), F.col("mixed").alias("mixed2"),
            )
            jumped = moving.join(hop, "ptr").select(
                "id", "parent", "n_parents", F.col("ptr2").alias("ptr"),
                (F.col("depth") + F.col("depth2")).alias("depth"),
                F.col("root2").alias("root"), "size",
                (F.col("mixed") | F.col("mixed2")).alias("mixed"),
            )
            after = state.where(F.col("ptr").isNull()).unionByName(jumped)
            after = after.join(gain.withColumnRenamed("ptr", "id"), "id", "left").withColumn(
                "size", F.col("size") + F.coalesce("gain", F.lit(0))
            ).drop("gain")
            new = put(after, "up")
            self.scratch.drop(state)
            state = new

    def nested(self, with_path: bool = False) -> DataFrame:
        """The least-key spanning forest only; ``all_paths`` follows all links.

        One row per node of the forest: node_key, parent_key, root_key, depth,
        pre, size (range ``[pre, pre + size)`` within its root's tree), on_loop
        and, on demand, path (keys from the root down).

        Nodes on or below a loop of chosen parents have on_loop true and no
        range, depth, root or path.
        """
        out = self.up.join(self._positions(with_path), "id", "left")
        names = self.nodes
        out = (
            out.join(names.select("id", F.col("key").alias("node_key")), "id")
            .join(names.select(F.col("id").alias("parent"), F.col("key").alias("parent_key")), "parent", "left")
            .join(names.select(F.col("id").alias("root"), F.col("key").alias("root_key")), "root", "left")
        )
        loop = F.col("ptr").isNotNull()
        return out.select(
            "node_key", "parent_key", "root_key",
            F.when(~loop, F.col("depth")).alias("depth"),
            "pre",
            F.when(~loop, F.col("size")).alias("size"),
            loop.cast("int").alias("on_loop"),
            *(["path"] if with_path else []),
        )

    def _positions(self, with_path: bool = False) -> DataFrame:
        """(id, pre): where the range of each finished node begins in its tree; on demand with its path."""
        put = self.scratch.put
        done = self.up.where(F.col("ptr").isNull())
        per_parent = done.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("kids"))
        kids = (
            done.where(F.col("parent").isNotNull())
            .select("id", "parent", "size")
            .join(per_parent, "parent")
            .join(self.nodes, "id")
            .withColumn("b", F.pmod(F.xxhash64("key"), F.ceil(F.col("kids") / SIBLING_BUCKET)))
        )
        kids = put(kids.select("id", "key", "parent", "size", "b"), "kids")
        inner = Window.partitionBy("parent", "b").orderBy("key")
        before_in = F.sum("size").over(inner) - F.col("size")
        totals = kids.groupBy("parent", "b").agg(F.sum("size").alias("total"))
        outer = Window.partitionBy("parent").orderBy("b")
        starts = totals.select("parent", "b", (F.sum("total").over(outer) - F.col("total")).alias("start"))
        offs = (
            kids.select("id", "parent", "b", before_in.alias("before"))
            .join(starts, ["parent", "b"])
            .select("id", (F.lit(1) + F.col("start") + F.col("before")).alias("off"))
        )
        base = done.join(offs, "id", "left").select(
            "id", F.col("parent").alias("ptr"), F.coalesce("off", F.lit(0)).alias("pre")
        )
        if with_path:
            base = base.join(self.nodes, "id").select("id", "ptr", "pre", F.array("key").alias("path"))
        state = put(base, "down")
        while state.where(F.col("ptr").isNotNull()).limit(1).count():
            hop = state.select(
                F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("pre").alias("pre2"),
                *([F.col("path").alias("path2")] if with_path else []),
            )
            jumped = state.where(F.col("ptr").isNotNull()).join(hop, "ptr").select(
                "id", F.col("ptr2").alias("ptr"), (F.col("pre") + F.col("pre2")).alias("pre"),
                *([F.concat("path2", "path").alias("path")] if with_path else []),
            )
            new = put(state.where(F.col("ptr").isNull()).unionByName(jumped), "down")
            self.scratch.drop(state)
            state = new
        return state.drop("ptr")

    def distances(self) -> DataFrame:
        """(node_key, root_key, depth): fewest links from each node to each root
        it reaches, and one row ('', -1) for each node on a loop or with an
        ancestor on one.

        Nodes with one chain of ancestors have the root of their tree and the
        number of nested-set ranges around them as depth (``range_depths``)."""
        put, drop = self.scratch.put, self.scratch.drop
        key = self.nodes.select("id", F.col("key").alias("node_key"))
        placed = put(self.up.join(self._positions(), "id").select("id", "root", "pre", "size", "mixed"), "placed")
        depths = range_depths(placed, "root", "id")
        plain = put(placed.where(~F.col("mixed")).select("id", "root").join(depths, "id"), "plain")
        part = self.up.where(F.col("ptr").isNotNull() | F.col("mixed")).select("id")
        part = put(part, "part")
        inside = self.links.join(part.withColumnRenamed("id", "child"), "child", "left_semi")
        walks = put(
            inside.join(part.withColumnRenamed("id", "parent"), "parent", "left_semi")
            .select(F.col("child").alias("v"), F.col("parent").alias("u")),
            "walks",
        )
        ends = put(
            inside.join(plain.withColumnRenamed("id", "parent"), "parent")
            .groupBy(F.col("child").alias("v"), F.col("root").alias("r"))
            .agg((F.min("depth") + 1).alias("d")),
            "ends",
        )
        step, seen = 1, None
        while True:
            n_walkers = walks.select("v").distinct().count()
            e = ends.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("s")).first()
            now = (n_walkers, e["n"], e["s"])
            if n_walkers == 0 or now == seen:
                break
            seen = now
            longer = walks.join(ends.select(F.col("v").alias("u"), "r", "d"), "u").select(
                "v", "r", (F.col("d") + F.lit(step)).alias("d")
            )
            new_ends = put(ends.unionByName(longer).groupBy("v", "r").agg(F.min("d").alias("d")), "ends")
            new_walks = put(
                walks.join(walks.select(F.col("v").alias("u"), F.col("u").alias("w")), "u")
                .select("v", F.col("w").alias("u")).distinct(),
                "walks",
            )
            drop(ends, walks)
            ends, walks, step = new_ends, new_walks, step * 2
        coded = plain.select("id", "root", "depth").unionByName(
            ends.select(F.col("v").alias("id"), F.col("r").alias("root"), F.col("d").alias("depth"))
        )
        root = self.nodes.select(F.col("id").alias("root"), F.col("key").alias("root_key"))
        reached = coded.join(key, "id").join(root, "root").select("node_key", "root_key", "depth")
        looped = (
            walks.select(F.col("v").alias("id")).distinct().join(key, "id")
            .select("node_key", F.lit("").alias("root_key"), F.lit(-1).cast("long").alias("depth"))
        )
        return reached.unionByName(looped)

    def all_paths(self) -> DataFrame:
        """One row per node and root it reaches, over all links: node_key,
        n_parents, root_key, depth, at_loop, n_below, path.

        depth is the fewest links to that root and path (keys from the root
        down) a way of that length, upwards by the least key; at_loop tells
        whether the node or some ancestor lies on a loop; n_below counts the
        other nodes below.  A node that reaches no root has one row without
        root, depth and path.
        """
        put = self.scratch.put
        found = put(self.distances(), "found")
        reached = found.where(F.col("depth") >= 0).select(F.col("node_key").alias("v"), F.col("root_key").alias("r"), "depth")
        at_loop = found.where(F.col("depth") < 0).select("node_key", F.lit(1).alias("at_loop"))
        key = self.nodes.select(F.col("id"), F.col("key").alias("v"))
        links = self.links.join(key.withColumnRenamed("id", "child"), "child").select("v", "p")
        via = (
            reached.join(links, "v")
            .join(reached.select(F.col("v").alias("p"), "r", (F.col("depth") + 1).alias("depth")), ["p", "r", "depth"])
            .groupBy("v", "r").agg(F.min("p").alias("ptr"))
        )
        state = put(reached.join(via, ["v", "r"], "left").select("v", "r", "depth", "ptr", F.array("v").alias("path")), "ways")
        while state.where(F.col("ptr").isNotNull()).limit(1).count():
            hop = state.select(F.col("v").alias("ptr"), "r", F.col("ptr").alias("ptr2"), F.col("path").alias("path2"))
            jumped = state.where(F.col("ptr").isNotNull()).join(hop, ["ptr", "r"]).select(
                "v", "r", "depth", F.col("ptr2").alias("ptr"), F.concat("path2", "path").alias("path")
            )
            new = put(state.where(F.col("ptr").isNull()).unionByName(jumped), "ways")
            self.scratch.drop(state)
            state = new
        below = (
            self.descendants().where(F.col("ancestor_key") != F.col("node_key"))
            .groupBy(F.col("ancestor_key").alias("node_key")).agg(F.count(F.lit(1)).alias("n_below"))
        )
        nodes = self.up.join(key, "id").select(F.col("v").alias("node_key"), "n_parents")
        ways = state.select(F.col("v").alias("node_key"), F.col("r").alias("root_key"), "depth", "path")
        return (
            nodes.join(ways, "node_key", "left").join(at_loop, "node_key", "left").join(below, "node_key", "left")
            .select(
                "node_key", "n_parents", "root_key", "depth", F.coalesce("at_loop", F.lit(0)).alias("at_loop"),
                F.coalesce("n_below", F.lit(0)).alias("n_below"), "path",
            )
        )

    def descendants(self) -> DataFrame:
        """(ancestor_key, node_key, distance): every node with each node below it
        over all links, and the fewest links between them.

        A node on a loop is below itself, at the length of its shortest loop.
        """
        put, drop = self.scratch.put, self.scratch.drop
        key = self.nodes.select("id", F.col("key").alias("node_key"))
        plain = self.up.where(F.col("ptr").isNull() & ~F.col("mixed")).select("id")
        part = put(self.up.where(F.col("ptr").isNotNull() | F.col("mixed")).select("id"), "part")
        # the ancestors of a plain node are plain, so ranges give all of them
        ranges = self.nested().join(plain.join(key, "id").select("node_key"), "node_key", "left_semi")
        ranges = put(ranges, "ranges")
        above = put(descendants(ranges, ranges), "above")
        inside = self.links.join(part.withColumnRenamed("id", "child"), "child", "left_semi")
        walks = put(
            inside.join(part.withColumnRenamed("id", "parent"), "parent", "left_semi")
            .select(F.col("child").alias("v"), F.col("parent").alias("u")),
            "walks",
        )
        exits = put(
            inside.join(plain.withColumnRenamed("id", "parent"), "parent")
            .select(F.col("child").alias("v"), F.col("parent").alias("b")),
            "exits",
        )
        # pairs: up to ``step`` links; walks: exactly ``step``
        pairs, step, seen = put(walks.withColumn("d", F.lit(1).cast("long")), "pairs"), 1, 0
        while (now := pairs.count()) != seen:
            seen = now
            longer = walks.join(pairs.select(F.col("v").alias("u"), F.col("u").alias("w"), "d"), "u").select(
                "v", F.col("w").alias("u"), (F.col("d") + F.lit(step)).alias("d")
            )
            new_pairs = put(pairs.unionByName(longer).groupBy("v", "u").agg(F.min("d").alias("d")), "pairs")
            new_walks = put(
                walks.join(walks.select(F.col("v").alias("u"), F.col("u").alias("w")), "u")
                .select("v", F.col("w").alias("u")).distinct(),
                "walks",
            )
            drop(pairs, walks)
            pairs, walks, step = new_pairs, new_walks, step * 2
        one = F.lit(1).cast("long")
        left = (
            exits.select("v", "b", one.alias("d"))
            .unionByName(pairs.join(exits.withColumnRenamed("v", "u"), "u").select("v", "b", (F.col("d") + one).alias("d")))
            .groupBy("v", "b").agg(F.min("d").alias("d"))
        )
        named = lambda df, a: (
            df.join(key.withColumnRenamed("id", "v"), "v")
            .join(self.nodes.select(F.col("id").alias(a), F.col("key").alias("ancestor_key")), a)
            .select("ancestor_key", "node_key", F.col("d").alias("distance"))
        )
        left = put(named(left, "b"), "left")
        further = left.withColumnRenamed("ancestor_key", "b").join(
            above.select(F.col("node_key").alias("b"), "ancestor_key", F.col("distance").alias("more")), "b"
        ).select("ancestor_key", "node_key", (F.col("distance") + F.col("more")).alias("distance"))
        outside = left.unionByName(further).groupBy("ancestor_key", "node_key").agg(F.min("distance").alias("distance"))
        return above.unionByName(named(pairs, "u")).unionByName(outside)


def range_depths(nested: DataFrame, tree: str = "root_key", node: str = "node_key") -> DataFrame:
    """(node, depth) of every node with a range, from the nested-set ranges alone.

    A sweep over the positions of each tree: a range opens at ``pre`` and closes
    at ``pre + size``, and the ranges open at a node's position, its own left
    out, are its ancestors.  Sums run within bins of BIN positions, and over the
    bins of a tree, so no task sweeps a whole tree.
    """
    held = nested.where(F.col("pre").isNotNull()).select(tree, node, "pre", "size")
    marks = held.select(tree, node, F.col("pre").alias("at"), F.lit(1).alias("d")).unionByName(
        held.select(tree, F.lit(None).cast(held.schema[node].dataType).alias(node), (F.col("pre") + F.col("size")).alias("at"), F.lit(-1).alias("d"))
    ).withColumn("bin", F.floor(F.col("at") / BIN))
    totals = marks.groupBy(tree, "bin").agg(F.sum("d").alias("total"))
    before = Window.partitionBy(tree).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(tree, "bin", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("open"))
    # at one position ranges close before the next one opens
    inside = Window.partitionBy(tree, "bin").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.withColumn("here", F.sum("d").over(inside)).where(F.col("d") == 1)
    return swept.join(starts, [tree, "bin"]).select(node, (F.col("open") + F.col("here") - 1).alias("depth"))


def descendants(nested: DataFrame, queries: DataFrame) -> DataFrame:
    """(ancestor_key, node_key, distance) of all nodes below each queried node
    in the spanning forest; ``Forest.descendants`` follows all links.

    ``nested`` is ``Forest.nested()``, ``queries`` has node_key.  A range is
    cut into bins of BIN positions, so the join is an equality on root and bin
    followed by the range test, also for a tree that holds most nodes.
    """
    q = (
        nested.join(queries.select("node_key").distinct(), "node_key", "left_semi")
        .where(F.col("on_loop") == 0)
        .select(
            "root_key", F.col("node_key").alias("ancestor_key"), F.col("pre").alias("lo"),
            (F.col("pre") + F.col("size")).alias("hi"), F.col("depth").alias("d0"),
        )
        .withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor((F.col("hi") - 1) / BIN))))
    )
    n = nested.where(F.col("on_loop") == 0).select(
        "root_key", "node_key", "pre", "depth", F.floor(F.col("pre") / BIN).alias("bin")
    )
    return (
        n.join(q, ["root_key", "bin"])
        .where((F.col("pre") > F.col("lo")) & (F.col("pre") < F.col("hi")))
        .select("ancestor_key", "node_key", (F.col("depth") - F.col("d0")).alias("distance"))
    )
