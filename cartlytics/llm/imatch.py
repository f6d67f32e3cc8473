"""I-Match fingerprints, with randomised lexicons.

Document frequencies of all terms are counted over the distinct texts of the whole corpus, so that copies
do not make their terms common.  The lexicon keeps the terms whose inverse document frequency is in a chosen band.  A document's distinct lexicon terms are
sorted; each of several randomised subsets of the lexicon keeps some of them, and the hash of what it
keeps is one part of the fingerprint.  Subsets come in levels of falling density (a term is in a
subset of level L with probability 4**-L), so that for a text of any length some subsets keep
just a few of its terms and survive an edit.

The likeness of two fingerprints is the share of equal parts among the subsets that keep a term of
either text, at the levels that expect no more than one kept term of the longer one (at the last
level for still longer ones).

A text with few lexicon terms (words mostly too rare, or too common as in boilerplate) has a second part of
the fingerprint: the same subsets, applied to all its distinct terms.  Where either of two texts has few, the
second parts are compared.  Texts that have not many more lexicon terms than that (``scarce``) carry
it too, so that two similar texts mostly have it or lack it together.  A fingerprint depends on the text and the corpus's lexicon
alone, and every likeness is computed from two fingerprints as they are returned.

The lexicon has at most (mean distinct terms of a document) / MIN_SHARE terms, whatever the corpus's
size.  It is broadcast while it is counted to have at most ``BROADCAST_TERMS`` terms, else joined by
shuffle.  Documents are dealt by ranges of the id, so that a document, its edited text and its
successor are made in one pass over one shuffle of the texts.

Cases: null texts are empty; texts without terms are all alike (1) and like no others (0); ties of doc_id are
ordered by text; a single row is its own successor; an empty table gives no rows; extra columns
are ignored; null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlytics.llm.common import materialise, partitions, text_or_empty

#: The band: terms in at least MIN_SHARE and at most MAX_SHARE of the distinct texts.
MIN_SHARE, MAX_SHARE = 0.004, 0.03
#: Few lexicon terms: under so many, or under one in so many of the text's terms.  Scarce: the same with the second pair.
FEW, SCARCE = (4, 16), (16, 8)
LEVELS = 5
SUBSETS = 12
BROADCAST_TERMS = 1_000_000
SEPARATORS = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits, as 64-bit hashes."""
    words = F.array_distinct(F.split(F.lower(text), SEPARATORS))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = MIN_SHARE, high: float = MAX_SHARE) -> DataFrame:
    """term, mask_a, mask_b: the terms of the band, each with the subsets that keep it as bits; a level has
    SUBSETS subsets in either mask."""
    texts = docs.select(text_or_empty().alias("text"))
    counted = texts.distinct().select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = texts.select(F.xxhash64("text")).distinct().count()
    band = counted.where((F.col("df") >= max(1, low * n)) & (F.col("df") <= max(1, high * n))).select("term")

    def mask(half: int) -> Column:
        """Bit (level - 1) * SUBSETS + k: whether subset k of the level keeps the term."""
        def bit_of(bit):
            return F.when(keeps(F.col("term"), half, bit, one_in(bit)), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS * SUBSETS - 1)), F.lit(0).cast("bigint"), lambda m, bit: m.bitwiseOR(bit_of(bit)))

    return materialise(band.withColumn("mask_a", mask(0)).withColumn("mask_b", mask(1)))


def one_in(bit: Column) -> Column:
    """The subset of a bit keeps one in so many terms: 4**level."""
    level = F.call_function("div", bit, F.lit(SUBSETS)) + 1
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (2 * level).cast("int"))


def keeps(term: Column, half: int, bit: Column, share: Column) -> Column:
    return F.pmod(F.xxhash64(term, F.lit(half), bit), share) == 0


def first_level(size: Column) -> Column:
    """The densest level of subsets that expect to keep at most one of ``size`` terms."""
    return F.least(F.lit(LEVELS), F.greatest(F.lit(1), F.ceil(F.log2(size.cast("double")) / 2))).cast("int")


def _fewer(bounds: tuple[int, int], found: Column, size: Column) -> Column:
    """Whether so many lexicon terms are under one of the bounds, in a text of ``size`` terms."""
    return (found < bounds[0]) | (found * bounds[1] < size)


def _hashed(kept: Column) -> Column:
    """Eight hexadecimal digits of an array of terms; empty without any."""
    nothing = F.substring(F.hex(F.xxhash64(F.array().cast("array<bigint>"))), -8, 8)
    return F.replace(F.substring(F.hex(F.xxhash64(kept)), -8, 8), nothing, F.lit(""))


def _bits(size: Column) -> Column:
    return F.sequence((first_level(size) - 1) * SUBSETS, F.lit(LEVELS * SUBSETS - 1))


def lexicon_part(found: Column) -> Column:
    """``found``: sorted array<struct<term, mask_a, mask_b>>.  ``terms:part,part,...`` from the first level
    for that many terms on, with an empty part where a subset keeps none; ``0:`` without lexicon terms."""
    def part(mask: str, bit: Column) -> Column:
        return _hashed(F.transform(F.filter(found, lambda t: F.getbit(t[mask], bit) == 1), lambda t: t["term"]))

    parts = F.transform(_bits(F.size(found)), lambda bit: F.concat(part("mask_a", bit), F.lit(","), part("mask_b", bit)))
    return F.when(F.size(found) > 0, F.concat(F.size(found).cast("string"), F.lit(":"), F.array_join(parts, ","))).otherwise("0:")


def whole_part(every: Column) -> Column:
    """The same for a sorted array of all terms of a text."""
    def part(half: int, at: Column) -> Column:
        return _hashed(F.filter(every, lambda t: keeps(t, half, at["bit"], at["share"])))

    steps = F.transform(_bits(F.size(every)), lambda bit: F.struct(bit.alias("bit"), one_in(bit).alias("share")))
    parts = F.transform(steps, lambda at: F.concat(part(0, at), F.lit(","), part(1, at)))
    return F.when(F.size(every) > 0, F.concat(F.size(every).cast("string"), F.lit(":"), F.array_join(parts, ","))).otherwise("0:")


def _alike(a: Column, b: Column) -> Column:
    """Likeness of two parts that are made in the same way."""
    size_a, size_b = (F.substring_index(x, ":", 1).cast("int") for x in (a, b))
    first = first_level(F.greatest(size_a, size_b))
    pa, pb = (F.slice(F.split(F.substring_index(x, ":", -1), ","), (first - first_level(n)) * 2 * SUBSETS + 1, F.lit(2 * LEVELS * SUBSETS))
              for x, n in ((a, size_a), (b, size_b)))
    both = F.arrays_zip(pa.alias("x"), pb.alias("y"))
    same = F.size(F.filter(both, lambda p: (p["x"] == p["y"]) & (p["x"] != "")))
    some = F.size(F.filter(both, lambda p: (p["x"] != "") | (p["y"] != "")))
    return F.when(a == b, F.lit(1.0)).when((size_a == 0) | (size_b == 0) | (some == 0), F.lit(0.0)).otherwise(same / some)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two fingerprints ``lexicon part`` or ``lexicon part|whole part``; see the module's docstring."""
    found = [F.substring_index(x, ":", 1).cast("int") for x in (a, b)]
    whole = [F.substring_index(x, "|", -1) for x in (a, b)]  # the lexicon part where there is no other
    few = [_fewer(FEW, n, F.substring_index(w, ":", 1).cast("int")) for n, w in zip(found, whole, strict=True)]
    second = a.contains("|") & b.contains("|") & (few[0] | few[1])
    return F.when(second, _alike(*whole)).otherwise(_alike(*(F.substring_index(x, "|", 1) for x in (a, b))))


def _bucketed(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, extra: rows by range of the id, so that each row's successor is in its bucket.
    The first row of a bucket is also in the bucket before, as ``extra`` (1; 2 after the last
    document).  The bounds are ids from a hash sample of about 16 a bucket: they decide balance only, and no
    row depends on which ids are in it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    buckets = 8 * partitions(docs.sparkSession)
    ids = rows.select("doc_id").where("doc_id IS NOT NULL")
    every = max(1, rows.count() // (16 * buckets))
    sample = sorted({r["doc_id"] for r in ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).collect()})
    bounds = sorted({sample[i * len(sample) // buckets] for i in range(buckets)}) if sample else []
    # the least id belongs to the first bucket, with null ids before it
    at = F.lit(0)
    size = 1
    if len(bounds) > 1:
        inner = bounds[1:]
        size = len(inner) + 1
        at = F.coalesce(_rank(inner, F.col("doc_id")), F.lit(0))
    least = rows.agg(F.min(F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)))).alias("m")).first()["m"]
    if least is None:
        first = F.lit(False)
        firsts = []
    else:
        first = F.col("doc_id") == F.lit(least[1]).cast("long") if least[0] else F.col("doc_id").isNull()
        firsts = bounds[1:]
    opens = F.col("doc_id").isin([int(b) for b in firsts]) if firsts else F.lit(False)
    own = F.struct(at.cast("int").alias("bucket"), F.lit(0).alias("extra"))
    places = F.when(first, F.array(own, F.struct(F.lit(size - 1).alias("bucket"), F.lit(2).alias("extra")))).when(
        F.coalesce(opens, F.lit(False)), F.array(own, F.struct((at - 1).cast("int").alias("bucket"), F.lit(1).alias("extra")))).otherwise(F.array(own))
    return rows.withColumn("p", F.explode(places)).select("doc_id", "text", "p.bucket", "p.extra")


def _rank(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``: first whole blocks, then within one."""
    listed = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    stride = int(len(bounds) ** 0.5) + 1
    blocks = F.size(F.filter(listed(bounds[stride - 1::stride]), lambda x: x <= value)) if len(bounds) >= stride else F.lit(0)
    within = F.size(F.filter(F.slice(listed(bounds), blocks * stride + 1, F.lit(stride)), lambda x: x <= value))
    return blocks * stride + within


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    known = lexicon(docs)
    if known.count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    order = Window.partitionBy("bucket").orderBy(F.when(F.col("extra") == 2, 1).otherwise(0), F.col("doc_id").asc_nulls_first(), "text", "extra")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    with_next = _bucketed(docs).withColumn("next", F.coalesce(F.lead("text").over(order), F.col("text")))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next"), F.lit(1), cut))
    every = lambda c, name: F.sort_array(terms(F.col(c))).alias(name)
    base = (with_next.select("bucket", "extra", "doc_id", "text", n.alias("n_chars"), edited.alias("edited"))
            .select("bucket", "extra", "doc_id", "n_chars", F.sha2("edited", 256).alias("sha"), every("text", "all_a"), every("edited", "all_b")))
    fact = F.struct("n_chars", "sha", "all_a", "all_b")
    none = F.lit(None).cast("struct<n_chars:int,sha:string,all_a:array<bigint>,all_b:array<bigint>>")
    side = lambda c, k: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(k).alias("side"), none.alias("fact")))
    # one row a document carries its facts, under a key of its own; the others are its terms
    items = F.concat(side("all_a", 0), side("all_b", 1), F.array(F.struct(F.xxhash64("row").alias("term"), F.lit(2).alias("side"), fact.alias("fact"))))
    rows = (base.withColumn("row", F.monotonically_increasing_id())  # follows the order within a bucket
            .select("bucket", "extra", "doc_id", "row", F.explode(items).alias("i"))
            .select("bucket", "extra", "doc_id", "row", "i.term", "i.side", "i.fact"))
    hits = rows.join(known, "term", "left").where("side = 2 OR mask_a IS NOT NULL")
    own = lambda k: F.sort_array(F.collect_list(F.when(F.col("side") == k, F.struct("term", "mask_a", "mask_b"))))
    scarce = lambda k: _fewer(SCARCE, F.size(k), F.size(f"all_{k}")).alias(f"scarce_{k}")
    second = lambda k: F.when(F.col(f"scarce_{k}"), F.concat(F.lit("|"), whole_part(F.col(f"all_{k}")))).otherwise("")
    made = (hits.groupBy("bucket", "row").agg(F.max("extra").alias("extra"), F.max("doc_id").alias("doc_id"), F.max("fact").alias("fact"), own(0).alias("a"), own(1).alias("b"))
            .select("bucket", "row", "extra", "doc_id", "fact.*", "a", "b")
            .select("*", scarce("a"), scarce("b"))
            .select("bucket", "row", "extra", "doc_id", "n_chars", F.col("sha").alias("edited_sha256"),
                    *[F.concat(lexicon_part(F.col(k)), second(k)).alias(name) for k, name in (("a", "fingerprint"), ("b", "edited_fingerprint"))])
            .withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))))
    follows = F.coalesce(F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("row")), F.col("fingerprint"))
    return (made.withColumn("next", follows).where("extra = 0")
            .select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                    likeness(F.col("fingerprint"), F.col("next")).alias("near_next")))
