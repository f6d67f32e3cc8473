"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative a group.

Vectors link if their labels are equal and their cosine, in double precision, is at least the threshold (0.93).
``annotated`` gives every row the number of other rows it links with directly, the least vec_id of its connected component,
and whether it is that representative; ``representatives`` keeps only those.

1. Copies (equal label and components) become one class with a weight; only classes are compared.
2. Cells: spherical k-means over a sample of the classes by hash (``SAMPLE_ROWS`` at most; every class is then
   assigned).  Seeds are no closer than the threshold, and centres that come closer merge.
3. A class is compared in its home cell, the one of its nearest centre, and visits the cells before its own whose border,
   the plane between the two centres, is within ``reach`` of it.  A pair is compared in the lower of its two home cells.
   The distance to that plane changes by at most sin(acos(threshold)) between linked vectors: ``exact_reach`` loses
   no link whatever the data.  The default is ``DEVIATIONS`` standard deviations of that distance for a link at the threshold
   whose difference has no preferred direction, or the exact reach where that is less, as in few
   dimensions (measured recall in the README and the tests).
4. Classes within half the threshold's angle of their home centre, the cell's core, all link with one another: they
   are counted by one aggregate and never compared, so that a group with a third of all rows costs no
   products.  Only what lies within one and a half times that angle is compared with a core.
5. The others of a cell are cut into blocks of about ``BLOCK``; a task has one pair of blocks, counts links by products
   of blocks, and hands on counts and a spanning forest, never pairs.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows of a null label, link with
nothing and are their own component; vectors of different lengths never link; repeated rows link with each other; a
null vec_id takes part, but is a component's id only if all of its ids are null; extra columns are kept (the three new
ones replace columns of their names); an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlytics.llm.common import fresh, materialise, partitions, ship, small_batches
from cartlytics.llm.order_minhash import components

ship(__name__)

THRESHOLD = 0.93
DEVIATIONS = 3.0
MAX_CELLS = 2048
SAMPLE_ROWS = 32768
ROUNDS = 8
BLOCK = 4096
BROADCAST_ROWS = 200_000
SAFE = 1e-9  # far above the rounding of a cosine


def exact_reach(threshold: float = THRESHOLD) -> float:
    """The reach that loses no link."""
    return math.sqrt(1.0 - threshold * threshold) + SAFE


def reach_of(dim: int, threshold: float = THRESHOLD) -> float:
    """The default reach for vectors of this length."""
    return min(exact_reach(threshold), DEVIATIONS * math.sqrt((1.0 - threshold * threshold) / dim))


def unit(v):
    """The vector of length 1 in this direction, or None."""
    import numpy as np

    if v is None or not len(v):
        return None
    v = np.asarray(v, np.float64) + 0.0
    if not np.isfinite(v).all():
        return None
    most = np.abs(v).max()
    if most == 0:
        return None
    v = v / most  # no overflow in the squares
    return v / np.sqrt((v * v).sum())


def vector_class(label: Column, embedding: Column) -> Column:
    """Hash of the label and the components; null for what links with nothing."""

    @F.pandas_udf("string")
    def hashed(labels: pd.Series, vectors: pd.Series) -> pd.Series:
        import hashlib

        import numpy as np

        out = []
        for name, v in zip(labels, vectors, strict=True):
            if name is None or unit(v) is None:
                out.append(None)
                continue
            out.append(hashlib.md5(str(name).encode() + b"\0" + (np.asarray(v, np.float64) + 0.0).tobytes()).hexdigest())
        return pd.Series(out, dtype=object)

    return hashed(label.cast("string"), embedding.cast("array<double>"))


# ---------------------------------------------------------------- cells

CENTRES = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("centre", T.ArrayType(T.DoubleType()))])


def apart(vectors, most: int, threshold: float):
    """Of ``vectors`` in order, up to ``most`` that are not within the threshold of an earlier chosen one."""
    import numpy as np

    chosen = vectors[:0]
    for at in range(0, len(vectors), 256):
        some = vectors[at:at + 256]
        if len(chosen):
            some = some[(some @ chosen.T).max(axis=1) < threshold]
        keep: list[int] = []
        near = some @ some.T
        for i in range(len(some)):
            if not keep or near[i, keep].max() < threshold:
                keep.append(i)
        chosen = np.concatenate([chosen, some[keep]])
        if len(chosen) >= most:
            return chosen[:most]
    return chosen


def spherical_means(vectors, cells: int, threshold: float):
    """Unit centres, at most ``cells`` of them, no two within the threshold of each other."""
    import numpy as np

    centres = apart(vectors, cells, threshold)
    for _ in range(ROUNDS):
        home = np.concatenate([(vectors[i:i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(vectors), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, vectors)
        length = np.sqrt((sums * sums).sum(axis=1))
        size = np.bincount(home, minlength=len(centres))
        there = length > 1e-12
        means = sums[there] / length[there, None]
        centres = apart(means[np.argsort(-size[there], kind="stable")], cells, threshold)
    return centres


def fit_cells(classes: DataFrame, cells: int | None, threshold: float) -> dict:
    """dim -> centres (array).  Fitted in one task a dim on a bounded sample by hash."""
    import numpy as np

    n = classes.count()
    cells = cells or max(1, min(MAX_CELLS, round(2 * n ** (1 / 3))))
    share = min(1.0, SAMPLE_ROWS / max(n, 1))

    def fit(table):
        import pyarrow as pa

        dim = table.column("dim")[0].as_py()
        order = np.argsort(table.column("node").to_numpy(zero_copy_only=False))
        vectors = np.array([unit(v) for v in table.column("vec").to_pylist()])[order]
        found = spherical_means(vectors, cells, threshold)
        return pa.table({"dim": pa.array([dim] * len(found), pa.int32()), "centre": pa.array(found.tolist(), pa.list_(pa.float64()))})

    part = F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = classes.where(part).select("dim", "node", "vec").groupBy("dim").applyInArrow(fit, CENTRES).collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r["dim"], []).append(r["centre"])
    return {d: np.array(c) for d, c in out.items()}


PLACED = T.StructType([
    T.StructField("node", T.StringType()), T.StructField("label", T.StringType()), T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()),
    T.StructField("kind", T.StringType()),  # core, home or visitor
    T.StructField("ring", T.BooleanType()),  # not of the core, but near enough to link with it
    T.StructField("weight", T.LongType()), T.StructField("vec", T.BinaryType()),  # unit vector, doubles
])


def place(centres, threshold: float, reach: float | None):
    """mapInArrow: node, label, dim, weight, vec -> PLACED, a row for the home cell and each visited cell."""
    angle = math.acos(threshold)
    core, ring = math.cos(angle / 2) + SAFE, math.cos(1.5 * angle) - SAFE

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        of_dim = {}
        for d, c in centres.value.items():
            gap = np.sqrt(np.maximum(2.0 - 2.0 * (c @ c.T), 1e-12))
            of_dim[d] = (c, gap)
        for batch in batches:
            dims = batch.column(2).to_numpy()
            units = [unit(v) for v in batch.column(4).to_pylist()]
            picked, cells, kinds, rings = [], [], [], []
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                u = np.array([units[i] for i in rows])
                if d not in of_dim:  # a length that the sample does not have: one cell
                    picked.append(rows)
                    cells.append(np.zeros(len(rows), np.int32))
                    kinds += ["home"] * len(rows)
                    rings.append(np.zeros(len(rows), bool))
                    continue
                c, gap = of_dim[d]
                near = u @ c.T
                home = near.argmax(axis=1)
                best = near[np.arange(len(rows)), home]
                margin = (best[:, None] - near) / gap[home]
                visit = (margin <= (reach_of(int(d), threshold) if reach is None else reach)) & (np.arange(len(c))[None, :] < home[:, None])
                v_row, v_cell = np.nonzero(visit)
                is_core = best >= core
                picked += [rows, rows[v_row]]
                cells += [home.astype(np.int32), v_cell.astype(np.int32)]
                kinds += ["core" if x else "home" for x in is_core] + ["visitor"] * len(v_row)
                rings += [(best >= ring) & ~is_core, near[v_row, v_cell] >= ring]
            if not picked:
                continue
            picked = np.concatenate(picked)
            take = pa.array(picked)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(np.concatenate(cells), pa.int32()), pa.array(kinds, pa.string()),
                 pa.array(np.concatenate(rings), pa.bool_()), batch.column(3).take(take), pa.array([units[i].tobytes() for i in picked], pa.binary())],
                names=PLACED.names)

    return run


# ---------------------------------------------------------------- products

FOUND = T.StructType([T.StructField("node", T.StringType()), T.StructField("links", T.LongType()), T.StructField("root", T.StringType())])


def links_in_task(u, first, second, weight, threshold: float):
    """(links by weight, index of the least linked row of the local component) of the rows of one task.

    ``first``, ``second``: which rows stand on which side of the products; pairs of equal rows do not count."""
    import numpy as np

    n = len(u)
    links, root = np.zeros(n, np.int64), np.arange(n)
    a, b = np.flatnonzero(first), np.flatnonzero(second)
    edges = []
    for at in range(0, len(a), 512):
        rows = a[at:at + 512]
        hit = u[rows] @ u[b].T >= threshold
        hit &= rows[:, None] != b[None, :]
        # a pair with both its rows on both sides is met twice: it counts for the row on the left
        twice = second[rows][:, None] & first[b][None, :]
        links[rows] += (hit * weight[b][None, :]).sum(axis=1)
        np.add.at(links, b, (np.where(twice, False, hit) * weight[rows][:, None]).sum(axis=0))
        edges.append(hit)
    hits = np.concatenate(edges) if edges else np.zeros((0, len(b)), bool)
    rows, cols = hits.any(axis=1), hits.any(axis=0)
    a, b, hits = a[rows], b[cols], hits[rows][:, cols]
    while len(a):
        before = root.copy()
        for i, row in zip(a, hits, strict=True):
            least = min(root[i], root[b[row]].min())
            root[i] = least
            root[b[row]] = np.minimum(root[b[row]], least)
        root = root[root]
        if (root == before).all():
            break
    return links, root


def compare(threshold: float):
    """mapInArrow over rows sorted by task: task, node, side, weight, vec -> FOUND.  side: bit 1 left, bit 2 right."""

    def found_in(rows: list[tuple]):
        import numpy as np

        side = np.array([r[2] for r in rows])
        links, root = links_in_task(np.frombuffer(b"".join(r[4] for r in rows)).reshape(len(rows), -1), side & 1 > 0, side & 2 > 0, np.array([r[3] for r in rows], np.int64), threshold)
        return [(rows[i][1], int(links[i]), rows[root[i]][1]) for i in np.flatnonzero(links)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now: list[tuple] = []

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())],
                                              names=FOUND.names)

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and now[0][0] != row[0]:
                    out += found_in(now)
                    now = []
                now.append(row)
            if out:
                yield batch_of(out)
        if now and (out := found_in(now)):
            yield batch_of(out)

    return run


def _attached(df: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a written table, broadcast only if it is counted to be small."""
    return df.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, list(keys), how)


def _block(count: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(count))


def block_pairs(placed: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """task, node, side, weight, vec: each placed class in the pairs of blocks that it takes part in.

    Classes outside the core meet each other in pairs of blocks a <= b, where visitors do not meet visitors; those of
    the ring meet the core in pairs (ring block, core block)."""
    cell = ["label", "dim", "cell"]
    counted = _attached(placed, sizes, cell)
    others = counted.where("kind <> 'core' AND homes > 0 AND homes + visitors > 1").withColumn("blocks", F.ceil((F.col("homes") + F.col("visitors")) / block)).withColumn("mine", _block("blocks"))
    others = others.select(*cell, "node", "kind", "weight", "vec", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    # within a block, homes stand on both sides and visitors on the left; between blocks, in two tasks: homes of the one block against all of the other,
    # then homes of the other against visitors of the one
    home = F.col("kind") == "home"
    same = others.where("mine = other").select(*cell, F.lit("o").alias("type"), low.alias("a"), high.alias("b"), "node", F.when(home, 3).otherwise(1).alias("side"), "weight", "vec")
    between = others.where("mine <> other")
    first = between.where(home | (F.col("mine") == high)).select(
        *cell, F.lit("p").alias("type"), low.alias("a"), high.alias("b"), "node", F.when(F.col("mine") == high, 1).otherwise(2).alias("side"), "weight", "vec")
    second = between.where((home & (F.col("mine") == high)) | (~home & (F.col("mine") == low))).select(
        *cell, F.lit("q").alias("type"), low.alias("a"), high.alias("b"), "node", F.when(home, 2).otherwise(1).alias("side"), "weight", "vec")
    near = counted.where("cores > 0 AND rings > 0 AND (kind = 'core' OR ring)").withColumn("ring_blocks", F.ceil(F.col("rings") / block)).withColumn("core_blocks", F.ceil(F.col("cores") / block))
    core = F.col("kind") == "core"
    near = near.withColumn("mine", F.when(core, _block("core_blocks")).otherwise(_block("ring_blocks")))
    near = near.select(*cell, "node", "kind", "weight", "vec", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.when(core, F.col("ring_blocks")).otherwise(F.col("core_blocks")) - 1)).alias("other"))
    near = near.select(*cell, F.lit("c").alias("type"), F.when(core, F.col("other")).otherwise(F.col("mine")).alias("a"), F.when(core, F.col("mine")).otherwise(F.col("other")).alias("b"),
                       "node", F.when(core, 2).otherwise(1).alias("side"), "weight", "vec")
    rows = same.unionByName(first).unionByName(second).unionByName(near)
    return rows.select(F.concat_ws("|", "type", "dim", "cell", "a", "b", "label").alias("task"), "node", "side", "weight", "vec")


def linked_classes(classes: DataFrame, threshold: float, reach: float | None, cells: int | None, block: int) -> DataFrame:
    """node, links (weights of other classes that link with it), root: spanning edges; several rows a class."""
    spark = classes.sparkSession
    centres = spark.sparkContext.broadcast(fit_cells(classes, cells, threshold))
    placed = materialise(classes.select("node", "label", "dim", "weight", "vec").mapInArrow(place(centres, threshold, reach), PLACED))
    cell = ["label", "dim", "cell"]
    sizes = placed.groupBy(*cell).agg(
        F.count_if(F.col("kind") == "home").alias("homes"), F.count_if(F.col("kind") == "visitor").alias("visitors"),
        F.count_if(F.col("kind") == "core").alias("cores"), F.count_if(F.col("ring")).alias("rings"),
        F.sum(F.when(F.col("kind") == "core", F.col("weight"))).alias("core_weight"), F.min(F.when(F.col("kind") == "core", F.col("node"))).alias("lead"))
    sizes = materialise(sizes.where("homes + cores > 0"))
    found = (block_pairs(placed, sizes, block).repartition(partitions(spark), "task").sortWithinPartitions("task", "node")
             .mapInArrow(compare(threshold), FOUND))
    core = (_attached(placed.where("kind = 'core'").select(*cell, "node", "weight"), sizes.where("cores > 1").select(*cell, "core_weight", "lead"), cell)
            .select("node", (F.col("core_weight") - F.col("weight")).alias("links"), F.col("lead").alias("root")))
    return found.unionByName(core)


# ---------------------------------------------------------------- result

def class_table(df: DataFrame, vec_id: str, label: str, embedding: str) -> DataFrame:
    """node, label, dim, weight, vec_id (least), vec of each class of copies that can link, written once."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("vec"))
    return materialise(rows.withColumn("node", vector_class(F.col("label"), F.col("vec"))).where("node IS NOT NULL").groupBy("node").agg(
        F.first("label").alias("label"), F.first(F.size("vec")).alias("dim"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("vec_id"), F.first("vec").alias("vec")))


def annotated(df: DataFrame, threshold: float = THRESHOLD, reach: float | None = None, cells: int | None = None, block: int = BLOCK,
              vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """The rows of ``df`` with n_links, component_id and kept.  ``cells``: by default twice the cube root of the number
    of classes, ``MAX_CELLS`` at most; ``reach``: ``reach_of`` the length by default."""
    small_batches(df.sparkSession, 2000)
    classes = class_table(df, vec_id, label, embedding)
    found = materialise(linked_classes(classes, threshold, reach, cells, block))
    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    group = components(edges).select("node", F.col("class").alias("group"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    sized = (classes.where("weight > 1").select("node").unionByName(links.select("node")).distinct()
             .join(classes.select("node", "weight", "vec_id"), "node").join(links, "node", "left").join(group, "node", "left")
             .select("node", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("group", "node").alias("group")))
    sized = materialise(sized)
    least = sized.groupBy("group").agg(F.min("vec_id").alias("component"))
    result = materialise(sized.join(least, "group").select("node", "links", "component"))
    own, n, c = fresh(df, "node", "links", "component")
    given = df.withColumn(own, vector_class(F.col(label), F.col(embedding)))
    joined = _attached(given, result.toDF(own, n, c), [own], "left")
    mine = F.col(vec_id).cast("long")
    component = F.when(F.col(n).isNull(), mine).otherwise(F.col(c))
    new = {"n_links", "component_id", "kept"}
    return joined.select(*[x for x in df.columns if x not in new], F.coalesce(F.col(n), F.lit(0).cast("long")).alias("n_links"),
                         component.alias("component_id"), mine.eqNullSafe(component).alias("kept"))


def representatives(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that stay: of each component those of its least vec_id; columns of ``df`` only."""
    kept = annotated(df, **options).where("kept")
    return kept.select(*[c for c in df.columns if c in kept.columns and c not in ("n_links", "component_id", "kept")])
