"""Near-duplicate documents by Order MinHash.

A text is the sequence of its five-word shingles, each labelled with its occurrence number.
For each of ``SAMPLES`` hash functions, the ``KEPT`` labelled shingles of least hash, taken
in text order, give one key: two texts share a key with a probability that grows with the
shingles that they have in common and in the same order, i.e. with edit similarity.

Texts that share a key are candidates.  A candidate pair is verified by a banded alignment of
the two word sequences: similarity = aligned equal words / (n1 + n2 - aligned), and a link needs
``MIN_SIMILARITY``.  Texts whose five-word shingles have a Jaccard similarity of 0.8 in the same order
are links by this measure, and so are texts with one word in twenty replaced.  What the band
leaves out cannot be aligned in a link, so it excludes none.

Classes are the connected components of the links; copies (equal words) are one node.  Within
a key, every member is first compared with one leader.  Where a key's members are then of several classes, they are compared in
blocks of about ``BLOCK``: a task has two blocks of one key, rules out pairs by their lengths and by a lower bound of their distance
(``far_apart``), verifies the others unless they are of one class by then, and hands on links that
join classes.  No pair is ever a row, no key is capped and no link is lost: n1 + n2 - 2 x aligned is at least the
distance of the two texts' counts of words by any hash.

Cases: null texts are empty; texts without a letter or digit are near their exact copies only, and blank ones are
alone; a text of fewer than five words is a single shingle; repeated rows are copies; extra columns are ignored; null
doc_ids take part, and the class id is null only if the whole class has none.  Rows that share a doc_id but not a text are
judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlytics.llm.common import WordIds, fresh, materialise, mix64, partitions, ship, small_batches, text_or_empty
from cartlytics.llm.decontam import BITS, seed_bitmap

ship(__name__)

SHINGLE = 5
MIN_SIMILARITY = 0.8
#: With a share j of their shingles in common, two texts have a sample's key in common with probability
#: j**3, and no key at all with (1 - j**3)**48: 1e-15 at 0.8, 7e-6 at 0.6, 0.2% at 0.5, 4% at 0.4 (about one word in
#: twelve replaced).
SAMPLES = 48
KEPT = 3
BLOCK = 1024
BROADCAST_ROWS = 4_000_000  # hashes of rows that go; more are joined by a shuffle of the texts
WORD = r"[^\W_]+"

TEXTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("row", T.LongType()),
    T.StructField("raw", T.LongType()),  # of the text; null for a blank one
    T.StructField("text_hash", T.LongType()),  # of the words; null without words
    T.StructField("keys", T.ArrayType(T.LongType())),
    T.StructField("n", T.IntegerType()),  # words
])


def shingles(h):
    """uint64 hashes of the shingles of a text's word hashes."""
    import numpy as np

    k = min(SHINGLE, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i:i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix64(out)


def occurrence_labelled(s):
    """Mix the occurrence number of each shingle into its hash."""
    import numpy as np

    order = np.argsort(s, kind="stable")
    sorted_s = s[order]
    new = np.concatenate([[True], sorted_s[1:] != sorted_s[:-1]])
    if new.all():
        return s
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    label = np.empty(len(s), np.uint64)
    label[order] = (np.arange(len(s)) - start).astype(np.uint64)
    return s + label * np.uint64(0xD1B54A32D192ED03)


def kept(n: int) -> int:
    """How many shingles make a key of a text of n: fewer for short texts."""
    return max(1, min(KEPT, n // 3))


def order_keys(labelled):
    """Keys (int64) of a text: for each of SAMPLES hash functions its least labelled shingles in text
    order.  A short text gets keys for each number of shingles that a similar text may have."""
    import math

    import numpy as np

    n = len(labelled)
    salts = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    # the shingles are mixed well; one product by an odd number for each sample orders them anew
    ranks = (labelled[None, :] ^ salts[:, None]) * (mix64(salts) | np.uint64(1))[:, None]
    out = []
    for k in sorted({min(n, kept(m)) for m in (n, math.ceil(MIN_SIMILARITY * n), int(n / MIN_SIMILARITY))}):
        least = np.argpartition(ranks, k - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (SAMPLES, 1))
        least.sort(axis=1)
        key = salts + np.uint64(k)
        for i in range(k):
            key = mix64((key + np.uint64(i)) ^ labelled[least[:, i]])
        out.append(key.view(np.int64))
    return np.concatenate(out)


def keys_of_texts(batches: Iterator) -> Iterator:
    """mapInArrow: doc_id, row, raw, text -> TEXTS."""
    import re

    import numpy as np
    import pyarrow as pa

    find, ids = re.compile(WORD).findall, WordIds()
    for batch in batches:
        texts, keys, sizes = [], [], []
        for text in batch.column(3).to_pylist():
            h = ids.array(find(text.lower()))
            s = shingles(h)
            sizes.append(len(h))
            if len(s):
                texts.append(ids.hash(h.tobytes()) - (1 << 63))
                keys.append(order_keys(occurrence_labelled(s)).tolist())
            else:
                texts.append(None)
                keys.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32())],
            names=TEXTS.names)


SEQUENCES = T.StructType([T.StructField("text_hash", T.LongType()), T.StructField("row", T.LongType()),
                          T.StructField("seq", T.BinaryType())])  # uint32 word hashes


def sequences(wanted):
    """mapInArrow: row, text -> SEQUENCES of the rows whose text may be wanted.  ``wanted``: broadcast bits of
    the hashes of the wanted texts, of fixed size; a join decides."""

    def run(batches: Iterator) -> Iterator:
        import re

        import numpy as np
        import pyarrow as pa

        bits, mask = np.frombuffer(wanted.value, np.uint8), (1 << BITS) - 1
        find, ids = re.compile(WORD).findall, WordIds()
        for batch in batches:
            out = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = ids.array(find(text.lower()))
                whole = ids.hash(h.tobytes()) if len(h) else 0
                own = whole - (1 << 63)
                at = own & mask
                if len(h) and bits[at >> 3] >> (at & 7) & 1:
                    out.append((own, row, h.astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                                             names=SEQUENCES.names)

    return run


def aligned(a, b, least: int) -> int:
    """Length of the longest common subsequence of two sequences if it is at least ``least``,
    else any lower number.

    Common ends are cut off first.  The rest is aligned within a band: with ``need`` pairs still to
    be aligned, positions shift by at most len(b) - need one way and len(a) - need the other.  A row
    of the alignment is one integer, a bit for each word of b (bit-parallel)."""
    n, m = len(a), len(b)
    if min(n, m) < least:
        return 0
    import numpy as np

    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    a, b = a[head:], b[head:]
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - k:][::-1] != b[len(b) - k:][::-1])
    tail = int(differ[0]) if len(differ) else k
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    done = head + tail
    if not len(a) or not len(b):
        return done
    # no more can be aligned than the words in common, repeats counted
    (u, n_u), (v, n_v) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    bound = done + int(np.minimum(n_u[i], n_v[j]).sum())
    if bound < least:
        return bound
    a, b = a[np.isin(a, both)], b[np.isin(b, both)]  # what has no partner is never aligned
    places: dict[int, int] = {}
    for j, v in enumerate(b.tolist()):
        places[v] = places.get(v, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, need = full, least - done
    left, right = max(0, len(a) - need), max(0, len(b) - need)
    for i, v in enumerate(a.tolist()):
        low = max(0, i - left)
        u = row & places[v] & ((1 << (i + right + 1)) - 1 >> low << low)
        row = ((row + u) | (row - u)) & full
    return done + len(b) - row.bit_count()


VERIFIED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])


def similarity_of(x, y) -> float:
    """Of two word sequences, 0 if it is below ``MIN_SIMILARITY``."""
    import math

    total = len(x) + len(y)
    found = aligned(x, y, math.ceil(MIN_SIMILARITY / (1 + MIN_SIMILARITY) * total - 1e-9))
    return found / (total - found) if found >= MIN_SIMILARITY * (total - found) - 1e-9 else 0.0


def far_apart(counts, sizes, i: int):
    """Which of the texts from i + 1 on cannot be linked with text i.

    ``counts``: words by bucket of a hash.  Words that are not aligned are n1 + n2 - 2 x aligned, at least the sum of the
    differences of the counts; a link leaves (1 - s) / (1 + s) of n1 + n2 at most unaligned."""
    import numpy as np

    most = (1 - MIN_SIMILARITY) / (1 + MIN_SIMILARITY) * (sizes[i + 1:] + sizes[i]) + 1e-6
    out = np.abs(sizes[i + 1:] - sizes[i]) > most
    near = np.flatnonzero(~out)
    out[near] = np.abs(counts[i + 1 + near] - counts[i]).sum(axis=1) > most[near]
    return out


def compare_blocks(batches: Iterator) -> Iterator:
    """mapInArrow over rows sorted by task: task, block, text_hash, class, seq -> VERIFIED: links that join the classes of a
    task.  A task of one block compares it with itself, one of two blocks the one with the other."""
    import pyarrow as pa

    def links_in(rows):
        import numpy as np

        rows.sort(key=lambda r: (len(r[4]), r[2]))
        texts = [np.frombuffer(r[4], np.uint32) for r in rows]
        sizes = np.array([len(t) for t in texts], np.int64)
        buckets = 64
        while buckets * 3 < sizes[-1] and buckets < 4096:
            buckets *= 2
        counts = np.array([np.bincount(t % buckets, minlength=buckets) for t in texts]).astype(np.int32)
        block, classes = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
        two, found = len(set(block.tolist())) > 1, []
        for i in range(len(rows) - 1):
            end = int(np.searchsorted(sizes, sizes[i] / MIN_SIMILARITY + 1, side="right"))  # longer ones are no links
            open_ = classes[i + 1:end] != classes[i]
            if two:
                open_ &= block[i + 1:end] != block[i]
            if not open_.any():
                continue
            for j in np.flatnonzero(open_ & ~far_apart(counts[:end], sizes[:end], i)) + i + 1:
                if classes[j] == classes[i]:
                    continue
                similarity = similarity_of(texts[i], texts[j])
                if similarity:
                    found.append((rows[i][2], rows[j][2], similarity))
                    classes[classes == classes[j]] = classes[i]
        return found

    now: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now and now[0][0] != row[0]:
                out += links_in(now)
                now = []
            now.append(row)
        if out:
            yield _links(pa, out)
    if now and (out := links_in(now)):
        yield _links(pa, out)


def _links(pa, rows):
    return pa.RecordBatch.from_arrays([pa.array([min(r[:2]) for r in rows], pa.int64()), pa.array([max(r[:2]) for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.float64())], names=VERIFIED.names)


def verify(batches: Iterator) -> Iterator:
    """mapInArrow: a, b, seq_a, seq_b -> the pairs that are links."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows = []
        for a, b, sa, sb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            similarity = similarity_of(np.frombuffer(sa, np.uint32), np.frombuffer(sb, np.uint32))
            if similarity:
                rows.append((a, b, similarity))
        yield _links(pa, rows)


def components(links: DataFrame) -> DataFrame:
    """node, class (the least node) of every node of ``links`` (a, b).

    Every round, each node takes the least class among itself and its neighbours, and then the
    class of its class, until nothing changes.  Each round's table is written."""
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class"))
    labels = materialise(labels)
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near")))
        hooked = (labels.join(near, "node")
                  .select("node", F.col("class").alias("was"), F.least("class", "near").alias("class")))
        jump = labels.select(F.col("node").alias("class"), F.col("class").alias("next"))
        new = materialise(hooked.join(jump, "class", "left")
                          .select("node", "was", F.least("class", F.coalesce("next", "class")).alias("class")))
        labels = new.select("node", "class")
        if new.where("class < was").isEmpty():
            return labels


def row_key():
    """A hash of the document's id and text: only rows that are equal in both share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_or_empty())


def key_table(docs: DataFrame) -> DataFrame:
    """doc_id, row (row_key), raw, text_hash, keys, n of every row, written once."""
    small_batches(docs.sparkSession)
    raw = F.when(text_or_empty().rlike(r"\S"), F.xxhash64(text_or_empty(), F.lit("no words")))
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), raw.alias("raw"), text_or_empty().alias("text"))
                       .mapInArrow(keys_of_texts, TEXTS))


def links_of(texts: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, similarity) between different texts, and the class of each linked text.

    ``texts``: text_hash, row, keys, n, one row for each text_hash."""
    keyed = texts.select("text_hash", "n", F.explode("keys").alias("key"))
    # a key's size, and its leader: the member of least hash, the same for all keys where possible
    leads = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("text_hash").alias("lead")).where("members > 1"))
    shared = materialise(keyed.join(leads, "key"))
    wanted = materialise(shared.select("text_hash").distinct().join(texts.select("text_hash", "row"), "text_hash"))
    bits = docs.sparkSession.sparkContext.broadcast(seed_bitmap(wanted.select(F.col("text_hash").alias("seed"))))
    seqs = materialise(docs.select(row_key().alias("row"), text_or_empty().alias("text")).mapInArrow(sequences(bits), SEQUENCES)
                       .join(wanted, ["text_hash", "row"]).groupBy("text_hash").agg(F.first("seq").alias("seq")))
    close = F.least("n", "lead_n") >= MIN_SIMILARITY * F.greatest("n", "lead_n")
    tried = (shared.where(F.col("text_hash") != F.col("lead")).select("text_hash", "n", "lead").distinct()
             .join(texts.select(F.col("text_hash").alias("lead"), F.col("n").alias("lead_n")), "lead").where(close)
             .select(F.least("text_hash", "lead").alias("a"), F.greatest("text_hash", "lead").alias("b")).distinct())
    links = materialise(verified(tried, seqs))
    classes = components(links)
    # keys whose members are of several classes still
    now = (shared.where("members > 2").select("key", "members", "text_hash")
           .join(classes.withColumnRenamed("node", "text_hash"), "text_hash", "left").withColumn("class", F.coalesce("class", "text_hash")))
    spread = now.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("key")
    now = materialise(now.join(spread, "key").join(seqs, "text_hash"))
    fresh = materialise(_block_pairs(now).mapInArrow(compare_blocks, VERIFIED)).dropDuplicates(["a", "b"])
    if fresh.isEmpty():
        return links, classes
    return materialise(links.unionByName(fresh).distinct()), joined(classes, fresh)


def _block_pairs(members: DataFrame) -> DataFrame:
    """task, block, text_hash, class, seq: each member in the pairs of blocks of its key that it takes part in."""
    blocks = F.ceil(F.col("members") / BLOCK)
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("text_hash"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    task = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return (dealt.select(task.alias("task"), "block", "text_hash", "class", "seq").repartition(partitions(members.sparkSession), "task")
            .sortWithinPartitions("task"))


def joined(classes: DataFrame, fresh: DataFrame) -> DataFrame:
    """The classes after more links: only the classes that these links join are looked at."""
    nodes = fresh.select(F.col("a").alias("node")).unionByName(fresh.select(F.col("b").alias("node"))).distinct()
    every = materialise(classes.unionByName(nodes.join(classes, "node", "left_anti").select("node", F.col("node").alias("class"))))
    of = lambda side: every.select(F.col("node").alias(side), F.col("class").alias(f"class_{side}"))
    between = fresh.join(of("a"), "a").join(of("b"), "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).where("a <> b")
    moved = components(between).select(F.col("node").alias("class"), F.col("class").alias("to"))
    return materialise(every.join(moved, "class", "left").select("node", F.coalesce("to", "class").alias("class")))


def verified(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    return (pairs.join(seqs.withColumnRenamed("text_hash", "a").withColumnRenamed("seq", "seq_a"), "a")
            .join(seqs.withColumnRenamed("text_hash", "b").withColumnRenamed("seq", "seq_b"), "b")
            .select("a", "b", "seq_a", "seq_b").mapInArrow(verify, VERIFIED))


def _classified(docs: DataFrame) -> DataFrame:
    """doc_id, row, class and class_id (the least doc_id of the class) of every row; written once.  The class of a row without
    words is its text; blank rows have none."""
    rows = key_table(docs)
    texts = materialise(rows.where("text_hash IS NOT NULL").groupBy("text_hash").agg(F.min(F.struct("row", "keys", "n")).alias("t"))
                        .select("text_hash", "t.row", "t.keys", "t.n"))
    _, classes = links_of(texts, docs)
    named = (rows.select("doc_id", "row", "raw", "text_hash").join(classes.withColumnRenamed("node", "text_hash"), "text_hash", "left")
             .select("doc_id", "row", F.coalesce("class", "text_hash", "raw").alias("class")))
    named = materialise(named)
    first = named.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"),
                                                                 F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")).alias("k"))
    return materialise(named.join(first.select("class", "class_id", F.col("k.row").alias("keeper")), "class", "left"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every document."""
    return _classified(docs).select("doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the row of least id (ties: one of them), once; all columns kept."""
    rows = _classified(docs)
    name, = fresh(docs, "row")
    gone = materialise(rows.where("row <> keeper").select(F.col("row").alias(name)).distinct())
    twice = materialise(rows.where("class IS NOT NULL").groupBy(F.col("row").alias(name)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(name))
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    stay = docs.join(few, row_key() == F.col(name), "left_anti")
    if twice.isEmpty():
        return stay
    # of rows with equal id and text, one stays
    return (stay.join(twice, row_key() == F.col(name), "left_anti")
            .unionByName(stay.join(twice, row_key() == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"])))
