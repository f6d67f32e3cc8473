"""Toxic spans and document scores from a linear-chain conditional random field.

Token labels come from the document labels of the training fold: a word of a toxic text
is a toxic token if it, or one of its affixes, separates toxic from clean training texts
and is not much weaker evidence than the strongest word of that text.  The field has two
states (clean, toxic), hashed word and affix features for the state, and a full
transition matrix; it is fitted by its exact likelihood gradient (forward-backward).

Scoring runs forward-backward over each whole text.  The marginals p_t of the toxic
state give the spans (maximal runs of words with p_t >= 0.5, as code point offsets) and
the document score: a calibrated logistic of log(sum -log(1 - p_t)), the noisy-or of the
tokens.

Cases: a null text counts as empty; a text without words scores as one without toxic
evidence; repeated rows each give a row; an empty training fold gives a constant score of
the prior 0; extra columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlytics.llm.common import ship, small_batches, text_or_empty

ship(__name__)

#: Training texts of each class at most (the classifier is fitted on a bounded sample).
TRAIN_TEXTS = 2000
THRESHOLD = 0.3
WORD = r"[^\W_]+"
BUCKETS = 1 << 18
EPOCHS = 40
#: Words that are scored at a time, and code points of the longest text that is learnt from.
WORDS_AT_ONCE = 500_000
LONGEST_TRAINED = 50_000
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("predicted", T.IntegerType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])


def in_held_out_fold(doc_id: str = "doc_id"):
    """Rows never used for learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- the field

def word_features(word: str) -> list[int]:
    """Hash buckets of a lower-case word: itself, its prefixes and suffixes."""
    import zlib

    parts = ["=" + word] + [f"{k}<{word[:k]}" for k in (3, 4, 5, 6)] + [f"{k}>{word[-k:]}" for k in (3, 4)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def forward_backward(e, first, trans, start, block: int = 256):
    """Ratios toxic : clean of the forward (r) and backward (q) messages of a stream of texts.

    ``e`` has each token's log weight of the toxic state, ``first`` marks first tokens of
    texts.  The stream is cut into blocks; all blocks advance together, once to get each
    block's transfer matrix and once from its true entry, so the cost is linear.
    """
    import numpy as np

    n = len(e)
    block = max(1, min(block, n))
    nb = -(-n // block)
    pad = nb * block - n
    w = np.exp(np.clip(e, -30, 30))
    w = np.concatenate([w, np.ones(pad)]).reshape(nb, block).T
    f = np.concatenate([first, np.ones(pad, bool)]).reshape(nb, block).T
    (a00, a01), (a10, a11) = np.exp(trans)
    p0, p1 = np.exp(start)

    def scan(step, apply):
        m = [np.ones(nb), np.zeros(nb), np.zeros(nb), np.ones(nb)]
        for row in step:
            m = apply(m, row)
            total = m[0] + m[1] + m[2] + m[3]
            m = [x / total for x in m]
        return m

    def ahead(m, t):
        out = []
        for x, y in ((m[0], m[1]), (m[2], m[3])):
            s = x + y
            out += [np.where(f[t], s * p0, x * a00 + y * a10), np.where(f[t], s * p1, x * a01 + y * a11) * w[t]]
        return out

    m = scan(range(block), ahead)
    entry, v = np.empty(nb), (1.0, 0.0)
    for b in range(nb):
        entry[b] = v[1] / v[0] if v[0] > 0 else 1e30
        x, y = v[0] * m[0][b] + v[1] * m[2][b], v[0] * m[1][b] + v[1] * m[3][b]
        v = (x / (x + y), y / (x + y))
    r, cur = np.empty((block, nb)), entry
    for t in range(block):
        cur = np.where(f[t], p1 / p0, (a01 + a11 * cur) / (a00 + a10 * cur)) * w[t]
        r[t] = cur

    # backward: q at t follows from q at t + 1; the first token of a text resets it to 1
    def behind(m, t):
        out = []
        for x, y in ((m[0], m[1]), (m[2], m[3])):  # columns of the transfer matrix
            y = y * w[t]
            out += [np.where(f[t], x * p0 + y * p1, x * a00 + y * a01), np.where(f[t], x * p0 + y * p1, x * a10 + y * a11)]
        return out

    m = scan(range(block - 1, -1, -1), behind)
    leave, v = np.empty(nb), (0.5, 0.5)
    for b in range(nb - 1, -1, -1):
        leave[b] = v[1] / v[0]
        x, y = v[0] * m[0][b] + v[1] * m[2][b], v[0] * m[1][b] + v[1] * m[3][b]
        v = (x / (x + y), y / (x + y))
    q, cur = np.empty((block, nb)), leave
    for t in range(block - 1, -1, -1):
        q[t] = cur
        z = w[t] * cur
        cur = np.where(f[t], 1.0, (a10 + a11 * z) / (a00 + a01 * z))
    return r.T.ravel()[:n], q.T.ravel()[:n], w.T.ravel()[:n]


def marginals(e, first, model):
    import numpy as np

    r, q, _ = forward_backward(e, first, model["trans"], model["start"])
    odds = np.clip(r * q, 0, 1e12)
    return odds / (1 + odds)


def evidence(p, bounds):
    """log of sum -log(1 - p) over each text; -20 for none."""
    import numpy as np

    total = np.zeros(len(bounds) - 1)
    has = bounds[1:] > bounds[:-1]
    if has.any():
        total[has] = np.add.reduceat(-np.log1p(-np.minimum(p, 1 - 1e-9)), bounds[:-1][has])
    return np.log(total + 2e-9)


def token_labels(word_feats, ids, bounds, toxic):
    """0/1 per token, from the labels of the texts; see the module's docstring."""
    import numpy as np

    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d in range(len(toxic)):
        feats = np.unique(word_feats[np.unique(ids[bounds[d]:bounds[d + 1]])])
        (pos if toxic[d] else neg)[feats] += 1
    rate1, rate0 = (pos + 0.1) / n1, (neg + 0.5) / n0
    separating = (pos >= 3) & (rate1 / (rate1 + rate0) >= 0.9)
    strength = np.where(separating, pos * np.log(np.maximum(1, rate1 / rate0)), 0)
    of_word = strength[word_feats].max(axis=1) if len(word_feats) else np.zeros(0)
    y = np.zeros(len(ids), np.int8)
    for d in np.flatnonzero(toxic):
        s = of_word[ids[bounds[d]:bounds[d + 1]]]
        if len(s) and s.max() > 0:
            y[bounds[d]:bounds[d + 1]] = s >= 0.2 * s.max()
    return y


def fit_field(texts: list[str], toxic, prior: float) -> dict:
    """Fit the field and the calibration on labelled texts; ``prior``: share of toxic texts
    in the whole training fold, which the sample may not have."""
    import re

    import numpy as np

    vocabulary: dict[str, int] = {}
    find, ids, bounds = re.compile(WORD).findall, [], [0]
    for text in texts:
        words = find(text.lower())
        ids.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words)))
        bounds.append(bounds[-1] + len(words))
    ids, bounds, toxic = np.concatenate([*ids, np.zeros(0, np.int64)]), np.array(bounds), np.asarray(toxic, bool)
    model = {"weights": np.zeros(BUCKETS, np.float32), "bias": -6.0, "trans": np.zeros((2, 2)), "start": np.zeros(2), "scale": 0.0, "shift": -12.0}
    if not len(ids) or not toxic.any() or toxic.all():
        return model
    feats = np.array([word_features(w) for w in vocabulary], np.int64)
    y = token_labels(feats, ids, bounds, toxic)
    used = np.ones(len(ids), bool)
    for d in np.flatnonzero(toxic):  # toxic texts without a toxic token teach the field nothing
        used[bounds[d]:bounds[d + 1]] = y[bounds[d]:bounds[d + 1]].any()
    first = np.zeros(len(ids), bool)
    first[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    kept_ids, kept_y, kept_first = ids[used], y[used].astype(float), first[used]
    theta, bias, trans, start = np.zeros(BUCKETS), -3.0, np.zeros((2, 2)), np.zeros(2)
    seen = np.bincount(feats.ravel(), minlength=BUCKETS) > 0
    per_word = np.bincount(kept_ids, kept_y, minlength=len(feats))
    follows = ~kept_first[1:]
    y0, y1 = kept_y[:-1][follows], kept_y[1:][follows]
    seen_pairs = np.array([[((1 - y0) * (1 - y1)).sum(), ((1 - y0) * y1).sum()], [(y0 * (1 - y1)).sum(), (y0 * y1).sum()]])
    seen_start = np.array([(1 - kept_y)[kept_first].sum(), kept_y[kept_first].sum()])
    state = {}

    def adam(name, value, grad, rate, step):
        m, v = state.get(name, (0, 0))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        state[name] = (m, v)
        return value + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)

    for step in range(1, EPOCHS + 1):
        e = (theta[feats].sum(axis=1) + bias)[kept_ids]
        r, q, w = forward_backward(e, kept_first, trans, start)
        odds = np.clip(r * q, 0, 1e12)
        p = odds / (1 + odds)
        gap = per_word - np.bincount(kept_ids, p, minlength=len(feats))
        grad = np.bincount(feats.ravel(), np.repeat(gap, feats.shape[1]), minlength=BUCKETS) - 0.5 * theta
        a = np.exp(trans)
        rp, z = r[:-1][follows], (w * q)[1:][follows]
        pair = np.stack([np.full(len(rp), a[0, 0]), a[0, 1] * z, a[1, 0] * rp, a[1, 1] * rp * z])
        pair /= pair.sum(axis=0)
        expected = pair.sum(axis=1).reshape(2, 2)
        start_gap = seen_start - np.array([(1 - p)[kept_first].sum(), p[kept_first].sum()])
        theta = np.where(seen, adam("theta", theta, grad, 0.3, step), 0)
        bias = adam("bias", bias, gap.sum() - 0.01 * bias, 0.1, step)
        trans = adam("trans", trans, seen_pairs - expected - 0.5 * trans, 0.1, step)
        start = adam("start", start, start_gap - 0.5 * start, 0.1, step)
    model |= {"weights": theta.astype(np.float32), "bias": float(bias), "trans": trans, "start": start}
    p = marginals((model["weights"][feats].sum(axis=1) + model["bias"])[ids], first, model)
    return model | calibrate(evidence(p, bounds), toxic, prior)


def calibrate(x, toxic, prior: float) -> dict:
    """Logistic a * x + b by Newton's method, with softened targets, weighted to ``prior``."""
    import numpy as np

    n1, n0 = toxic.sum(), (~toxic).sum()
    weight = np.where(toxic, prior / n1, (1 - prior) / n0) * len(x)
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.1, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g, h = weight * (target - p), weight * np.maximum(p * (1 - p), 1e-6)
        ga, gb = (g * x).sum() - 1e-2 * a, g.sum()
        haa, hab, hbb = (h * x * x).sum() + 1e-2, (h * x).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        reach = min(1.0, 5 / max(1e-9, abs(da) * np.abs(x).max() + abs(db)))
        a, b = a + reach * da, b + reach * db
    return {"scale": float(max(a, 1e-3)), "shift": float(b)}


# ---------------------------------------------------------------- on tables

def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_TEXTS) -> dict:
    """Learn from the rows of ``labels`` outside the held-out fold.  At most ``per_class``
    distinct texts of each class are read, those of the lowest hash of the id, and of these the ones of at most ``LONGEST_TRAINED`` code points; the share of
    toxic rows is counted over all of them."""
    import numpy as np

    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~in_held_out_fold()))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for c in (0, 1):
        part = usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    total = sum(counts.values())
    prior = min(max(counts.get(1, 0) / total if total else 0.0, 1e-4), 1 - 1e-4)
    # at most 2 * per_class ids are broadcast, and as many texts meet in the one task that learns
    small_batches(docs.sparkSession)
    sample = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= LONGEST_TRAINED)
              .join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").repartition(1))
    rows = sample.mapInArrow(learn(prior), MODEL).collect()
    if not rows:
        return fit_field([], [], prior)
    r = rows[0]
    weights = np.frombuffer(bytes(r["weights"]), np.float32)
    return {"weights": weights, "bias": r["bias"], "trans": np.array(r["trans"]).reshape(2, 2), "start": np.array(r["start"]), "scale": r["scale"], "shift": r["shift"]}


MODEL = T.StructType([T.StructField("weights", T.BinaryType()), T.StructField("bias", T.DoubleType()), T.StructField("trans", T.ArrayType(T.DoubleType())),
                      T.StructField("start", T.ArrayType(T.DoubleType())), T.StructField("scale", T.DoubleType()), T.StructField("shift", T.DoubleType())])


def learn(prior: float):
    """mapInArrow: doc_id, text, toxic of the sample -> MODEL, one row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0], r[2], r[1]))
        texts: dict[str, int] = {}
        for _, text, toxic in rows:
            texts[text] = max(texts.get(text, 0), toxic)
        m = fit_field(list(texts), list(texts.values()), prior)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m["weights"].tobytes()], pa.binary()), pa.array([m["bias"]]), pa.array([m["trans"].ravel().tolist()], pa.list_(pa.float64())),
             pa.array([m["start"].tolist()], pa.list_(pa.float64())), pa.array([m["scale"]]), pa.array([m["shift"]])], names=MODEL.names)

    return run


def score_batches(model: dict, threshold: float):
    """mapInArrow function: doc_id, text -> SCHEMA."""

    def run(batches: Iterator) -> Iterator:
        import re

        import numpy as np
        import pyarrow as pa

        weights, bias, known = model["weights"], model["bias"], {}
        pattern = re.compile(WORD)

        def strength(word):
            got = known.get(word)
            if got is None:
                if len(known) >= 300_000:
                    known.clear()
                got = known[word] = float(weights[word_features(word)].sum()) + bias
            return got

        def strengths(text):
            if not text:
                return np.zeros(0)
            low = text.lower()
            if len(low) < 1_000_000:
                words = pattern.findall(low)
                return np.fromiter(map(strength, words), np.float64, len(words))
            return np.fromiter((strength(m.group()) for m in pattern.finditer(low)), np.float64)  # no list of a very long text's words

        def judge(texts, values):
            """Scores and spans of some texts, given their words' strengths."""
            bounds = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
            e = np.concatenate([*values, np.zeros(0)])
            first = np.zeros(len(e), bool)
            first[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
            p = marginals(e, first, model) if len(e) else e
            x = model["scale"] * evidence(p, bounds) + model["shift"]
            spans = []
            for d, text in enumerate(texts):
                own = p[bounds[d]:bounds[d + 1]] >= 0.5
                found = []
                if own.any():
                    # lower-casing may change a text's length: offsets come from the text itself where it does not
                    low = text.lower()
                    at = [m.span() for m in pattern.finditer(low)]
                    if len(low) != len(text):
                        place = np.cumsum([0, *(len(c.lower()) for c in text)])
                        at = [tuple(int(np.searchsorted(place, v)) for v in s) for s in at]
                    for t in np.flatnonzero(own):
                        if found and found[-1][2] == t - 1:
                            found[-1][1:] = [at[t][1], t]
                        else:
                            found.append([at[t][0], at[t][1], t])
                spans.append([{"start": a, "end": b} for a, b, _ in found])
            return 1 / (1 + np.exp(-np.clip(x, -35, 35))), spans

        for batch in batches:
            ids = batch.column(0)
            scores, spans, texts, values, words = [np.zeros(0)], [], [], [], 0
            for text in batch.column(1).to_pylist():
                texts.append(text)
                values.append(strengths(text))
                words += len(values[-1])
                if words >= WORDS_AT_ONCE:
                    some, found = judge(texts, values)
                    scores.append(some)
                    spans += found
                    texts, values, words = [], [], 0
            if texts:
                some, found = judge(texts, values)
                scores.append(some)
                spans += found
            scores = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "score", "predicted", "spans"])

    return run


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, spans of every whole text."""
    small_batches(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .mapInArrow(score_batches(model, threshold), SCHEMA))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, all columns kept.  The text
    is scored in the same pass that hands the row on; nothing is shuffled."""
    model = fit(docs, labels)
    small_batches(docs.sparkSession)
    judge, columns = score_batches(model, threshold), docs.columns

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts = batch.column(columns.index("text")).fill_null("")
            ask = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], names=["doc_id", "text"])
            verdict = next(judge(iter([ask])))
            yield batch.filter(pc.equal(verdict.column(2), 0))

    return docs.mapInArrow(run, docs.schema)
