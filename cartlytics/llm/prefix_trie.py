"""Prefix trie of conversations, rolled up by centroid decomposition.

Every distinct sequence of first d turns (role, text) is a node of depth d; conversations that begin
with it are its members.  A node is known by two 64-bit exclusive-or sums of hashes of (position, turn), so
that prefixes are running sums: a long conversation is cut into chunks whose sums are added, and no text
travels after its turn's place is known.

``rollup`` adds values up the parent edges.  Components (at first the whole trie) are split recursively:

* weights: a node weighs its members, so the weight below a node is a sum over its members' lengths, known
  from one aggregate;
* the centroid of a component is the deepest node with at least half of the component's weight below it;
* the component total below the centroid is one aggregate; it is added to the centroid and to the
  nodes on the path from there to the component's top (the path is looked up in the rows of a member);
* each child of the centroid is then the top of a component of its own, and what remains above is one, too.
  All weigh at most half, so there are at most log2 of the rows such rounds, whatever the depth or the degree.

Components of at most ``block`` members' turns are finished within one task each, by the same decomposition in
memory (``centroid_totals``).

Cases: rows of a null conv_id belong to no conversation and are left out; null roles and texts are empty; turns are in
the order of turn (null first), role, text, so that ties have one order, and repeated rows are turns
of their own; an empty table has no nodes; extra columns are ignored.  Ids of a node's ended
conversations are hashed in order as they stream by: SHA-256 allows no parts, so those of one node
meet in one task, which holds none of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlytics.llm.common import materialise, partitions, ship, text_or_empty

ship(__name__)

FAMILY = 100  # conversations that share the first turns of one of them
MOST_SHARED = 6  # their number is below this
CHUNK = 4096  # turns of a conversation that one running sum covers
BLOCK = 16384
BROADCAST_ROWS = 200_000  # rows of a few columns that may be broadcast

NUMBERED = T.StructType([T.StructField(c, T.LongType()) for c in ("conv_id", "part", "at", "a", "b", "chars")])


def number_rows(batches: Iterator) -> Iterator:
    """mapInArrow over a sorted partition: conv_id, a, b, chars -> NUMBERED; ``at`` counts a
    conversation's rows within the partition."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, seen = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0).to_numpy(zero_copy_only=False)
        place = np.arange(n)
        new = np.concatenate([[True], conv[1:] != conv[:-1]])
        start = np.maximum.accumulate(np.where(new, place, 0))
        at = place - start
        if last is not None and conv[0] == last:
            at[start == 0] += seen
        last, seen = conv[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part)), pa.array(at), *batch.columns[1:]], names=NUMBERED.names)


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), two hashes a and b of (role, text), and the text's code points of every row.  Rows are dealt
    by ranges of (conv_id, turn, ...), so that a conversation of any length is spread over tasks."""
    spark = conversations.sparkSession
    rows = (conversations.where("conv_id IS NOT NULL")
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_or_empty("role").alias("role"), text_or_empty().alias("text"))
            .withColumn("nth", F.monotonically_increasing_id()))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("nth")]
    numbered = materialise(
        rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        .select("conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(1), "role").alias("b"), F.length("text").cast("long").alias("chars"))
        .mapInArrow(number_rows, NUMBERED))
    spans = numbered.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only the first conversation of a partition can have begun earlier: at most a row for each partition
    before = spans.withColumn("before", F.sum("n").over(earlier)).where("before > 0").select("conv_id", "part", "before")
    return (numbered.join(F.broadcast(before), ["conv_id", "part"], "left")
            .select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "a", "b", "chars"))


def _shared_turns() -> Column:
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED


def member_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, chars (of the node's last text), length of each rebuilt conversation at
    each depth from 0.

    Conversation c is rebuilt from the first h turns of conversation c - c % 100, h being crc32 of c modulo
    6, and its own turns after its first h."""
    placed = materialise(placed_turns(conversations))
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.withColumn("h", _shared_turns()).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = materialise(convs.withColumn("shared", F.least("h", F.coalesce("base_n", F.lit(0))))
                        .select("conv_id", "base", "h", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    own = (placed.join(convs, "conv_id").where("pos >= h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "a", "b", "chars", "length"))
    heads = placed.where(F.col("pos") < MOST_SHARED - 1).select(F.col("conv_id").alias("base"), "pos", "a", "b", "chars")
    shared = convs.join(heads, "base").where("pos < h").select("conv_id", "pos", "a", "b", "chars", "length")
    rows = (own.unionByName(shared).withColumn("chunk", F.expr(f"pos div {CHUNK}"))
            .withColumn("a", F.xxhash64("pos", "a")).withColumn("b", F.xxhash64("b", "pos")))
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = (rows.where(F.col("length") > CHUNK).groupBy("conv_id", "chunk").agg(F.bit_xor("a").alias("sa"), F.bit_xor("b").alias("sb"))
            .select("conv_id", "chunk", F.bit_xor("sa").over(earlier).alias("sa"), F.bit_xor("sb").over(earlier).alias("sb")).where("chunk > 0"))
    running = (rows.withColumn("xa", F.bit_xor("a").over(so_far)).withColumn("xb", F.bit_xor("b").over(so_far))
               .join(sums, ["conv_id", "chunk"], "left")
               .withColumn("xa", F.col("xa").bitwiseXOR(F.coalesce("sa", F.lit(0)))).withColumn("xb", F.col("xb").bitwiseXOR(F.coalesce("sb", F.lit(0)))))
    turns = running.select("conv_id", (F.col("pos") + 1).alias("depth"), _node(F.col("xa"), F.col("xb")).alias("node"),
                           _node(F.col("xa").bitwiseXOR(F.col("a")), F.col("xb").bitwiseXOR(F.col("b"))).alias("parent"), "chars", "length")
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), _node(F.lit(0), F.lit(0)).alias("node"), F.lit(None).cast("string").alias("parent"),
                        F.lit(0).cast("long").alias("chars"), "length")
    return turns.unionByName(tops)


def _node(a: Column, b: Column) -> Column:
    return F.concat_ws("-", F.hex(a.cast("long")), F.hex(b.cast("long")))


def trie_nodes(members: DataFrame) -> DataFrame:
    """node, parent, depth, conv_id (least member), n_convs, chars, below (weight of the subtree: rows of
    its members from this depth on)."""
    return (members.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
                                        F.count(F.lit(1)).alias("n_convs"), F.first("chars").alias("chars"), F.sum("length").alias("_lengths"))
            .withColumn("below", F.col("_lengths") - F.col("n_convs") * (F.col("depth") - 1)).drop("_lengths"))


# ---------------------------------------------------------------- rollup

def centroid_totals(parent: list[int], values):
    """Subtree sums of a tree.  ``parent``: index of each node's parent, -1 for the top; ``values``: array (nodes, k).

    Components are split at their centroids; the sum below a centroid is added along its path to the top."""
    import numpy as np

    n = len(parent)
    if n == 1:
        return values.copy()
    children: list[list[int]] = [[] for _ in range(n)]
    for v, p in enumerate(parent):
        if p >= 0:
            children[p].append(v)
    first, stack = [], [parent.index(-1)]
    while stack:  # parents before children, a subtree without gaps
        v = stack.pop()
        first.append(v)
        stack.extend(children[v])
    place = {v: i for i, v in enumerate(first)}
    up = np.array([place[parent[v]] if parent[v] >= 0 else -1 for v in first])
    ordered, totals = values[first], np.zeros_like(values)
    work = [np.arange(n)]
    while work:
        part = work.pop()
        top = part[0]
        if len(part) == 1:
            totals[top] += ordered[top]
            continue
        at = {int(v): i for i, v in enumerate(part)}
        size = [1] * len(part)
        for i in range(len(part) - 1, 0, -1):
            size[at[int(up[part[i]])]] += size[i]
        centre = max(i for i in range(len(part)) if 2 * size[i] >= len(part))
        end = centre + size[centre]
        total = ordered[part[centre:end]].sum(axis=0)
        v = int(part[centre])
        totals[v] += total
        while v != top:
            v = int(up[v])
            totals[v] += total
        i = centre + 1
        while i < end:  # children of the centroid
            work.append(part[i:i + size[i]])
            i += size[i]
        if centre:
            work.append(np.concatenate([part[:centre], part[end:]]))
    out = np.empty_like(totals)
    out[first] = totals
    return out


def finish_components(k: int):
    """mapInArrow over rows sorted by component: comp, node, parent, k values, k sums so far -> node, k totals."""

    def totals_of(rows: list[tuple]):
        import numpy as np

        at = {r[1]: i for i, r in enumerate(rows)}
        parent = [at.get(r[2], -1) if r[1] != r[0] else -1 for r in rows]
        values = np.array([r[3:3 + k] for r in rows], np.int64).reshape(len(rows), k)
        done = centroid_totals(parent, values) + np.array([r[3 + k:] for r in rows], np.int64).reshape(len(rows), k)
        return [r[1] for r in rows], done

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def batch_of(found):
            sums = np.concatenate([d for _, d in found])
            return pa.RecordBatch.from_arrays([pa.array([n for names, _ in found for n in names], pa.string()), *[pa.array(sums[:, i]) for i in range(k)]],
                                              names=["node", *[f"t{i}" for i in range(k)]])

        now = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and now[0][0] != row[0]:
                    found.append(totals_of(now))
                    now = []
                now.append(row)
            if found:
                yield batch_of(found)
        if now:
            yield batch_of([totals_of(now)])

    return run


def _attached(df: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join with a written table, broadcast only if it is counted to be small."""
    return df.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, list(keys))


def rollup(nodes: DataFrame, members: DataFrame, values: Sequence[str], block: int = BLOCK) -> DataFrame:
    """node and, for each of ``values`` (whole numbers), its sum over the node's subtree, under the same name.

    ``nodes``: as of ``trie_nodes`` with the values; ``members``: as of ``member_rows``.  The
    nodes are one tree: several tops are an error of the subquery."""
    spark, k = nodes.sparkSession, len(values)
    v, s = [f"v{i}" for i in range(k)], [f"s{i}" for i in range(k)]
    tops = nodes.where("parent IS NULL").select(F.col("node").alias("comp"))
    paths = members.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("node").alias("y"), F.col("parent").alias("above"))
    start = nodes.select("node", "parent", "depth", "conv_id", "below", *[F.col(c).cast("long").alias(x) for c, x in zip(values, v, strict=True)],
                         *[F.lit(0).cast("long").alias(x) for x in s])
    state = materialise(start.withColumn("comp", tops.select("comp").scalar()))
    settled, finished = [], []
    while True:
        weights = state.where("node = comp").select("comp", F.col("below").alias("weight"), F.col("depth").alias("top"))
        big = materialise(weights.where(F.col("weight") > block))
        if big.isEmpty():
            settled.append(state)
            break
        settled.append(state.join(big.select("comp"), "comp", "left_anti"))
        inside = _attached(state, big, ["comp"])
        centre = materialise(inside.where(2 * F.col("below") >= F.col("weight")).groupBy("comp", "top")
                             .agg(F.max(F.struct("depth", "node", "conv_id", "below")).alias("x"))
                             .select("comp", "top", F.col("x.depth").alias("xd"), F.col("x.node").alias("x"), F.col("x.conv_id").alias("xc"), F.col("x.below").alias("xw")))
        # the child of the centroid on the way to each node, read from the rows of one of its members
        inside = _attached(state, centre, ["comp"])
        ways = paths.withColumnRenamed("c", "conv_id").withColumn("xd", F.col("d") - 1).drop("d")
        inside = inside.join(ways, ["conv_id", "xd"], "left")
        under = (F.col("depth") > F.col("xd")) & (F.col("above") == F.col("x"))
        inside = materialise(inside.withColumn("child", F.when(under, F.col("y"))).drop("y", "above"))
        sums = materialise(inside.where("child IS NOT NULL OR node = x").groupBy("comp").agg(*[F.sum(a).alias(f"t_{a}") for a in v]))
        totals = materialise(centre.join(sums, "comp"))
        # from the centroid to the top of its component
        way_up = paths.select(F.col("c").alias("xc"), "d", F.col("y").alias("node"))
        path = (_attached(way_up, totals, ["xc"]).where("d <= xd AND d >= top")
                .select("node", F.when(F.col("node") == F.col("x"), F.lit(0)).otherwise(F.col("xw")).alias("less"), *[f"t_{a}" for a in v]))
        added = inside.join(path, "node", "left")
        added = added.select("node", "parent", "depth", "conv_id", (F.col("below") - F.coalesce("less", F.lit(0))).alias("below"), *v,
                             *[(F.col(a) + F.coalesce(f"t_{b}", F.lit(0))).alias(a) for a, b in zip(s, v, strict=True)],
                             F.coalesce("child", "comp").alias("comp"), (F.col("node") == F.col("x")).alias("is_centre"))
        added = materialise(added)
        finished.append(added.where("is_centre").select("node", *s))
        state = added.where("NOT is_centre").drop("is_centre")
    small = settled[0]
    for part in settled[1:]:
        small = small.unionByName(part)
    schema = T.StructType([T.StructField("node", T.StringType()), *[T.StructField(f"t{i}", T.LongType()) for i in range(k)]])
    totals = (small.select("comp", "node", "parent", *v, *s).repartition(partitions(spark), "comp").sortWithinPartitions("comp")
              .mapInArrow(finish_components(k), schema).toDF("node", *values))
    for part in finished:
        totals = totals.unionByName(part.toDF("node", *values))
    return totals


# ---------------------------------------------------------------- report

ENDS = T.StructType([T.StructField("node", T.StringType()), T.StructField("ends_sha256", T.StringType())])


def hash_ends(batches: Iterator) -> Iterator:
    """mapInArrow: node, conv_id, sorted -> ENDS."""
    import hashlib

    import pyarrow as pa

    node, digest = None, None
    for batch in batches:
        done = []
        for name, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = name, hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(2)], names=ENDS.names)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (node, digest.hexdigest())], names=ENDS.names)


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens
    (sums over the subtree), ends_sha256 (of the ids of conversations that end there)."""
    spark = conversations.sparkSession
    members = materialise(member_rows(conversations))
    plain = materialise(trie_nodes(members))
    children = plain.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(plain.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                        .withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")))
    totals = rollup(nodes, members, ["n_leaves", "saved_tokens"], block)
    ends = (members.where("depth = length").select("node", "conv_id").repartition(partitions(spark), "node").sortWithinPartitions("node", "conv_id")
            .mapInArrow(hash_ends, ENDS))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.drop("n_leaves", "saved_tokens").join(parents, "parent", "left").join(totals, "node").join(ends, "node", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
