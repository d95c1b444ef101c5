"""Convolutional text classifier in numpy: hashed word embeddings, several filter widths, max pooling.

A word's embedding is the sum of hashed vectors of the word and of its first four and five characters, so
that inflected forms share strength. Filters of one to three words run over the whole text, each keeps its
maximum, and a logistic layer on the maxima gives the score. Embeddings, filters and output layer start at random
and are all fitted, by adaptive gradient steps in numpy, with some words left out of each step. Fitting uses at most ``sample`` labelled rows
of each class, chosen by a hash of the doc_id, of at most ``LONGEST`` characters each; scoring covers every row and
every word.

Scores are shifted so that 0.5 separates best on all usable labelled rows that the weights were not fitted
on; for the same rows, thresholds are calibrated by language, for use by a filter. Both come from histograms
of scores that Spark makes over all of these rows; a language's is smoothed towards that of all, by
``PRIOR`` rows of its rarer class, so that no language needs a least number of rows. The score itself sees
the text only.

Defined results: a null or empty text is scored as one without words; rows without a label, or with a null
label, are not fitted on, and of several labels of one id the largest counts; without usable labels of both classes
every score is that of a logit of -30, below 1e-12; repeated rows are scored each, and score alike; an empty table gives no
rows. Columns of ``docs`` other than the text stay as they are; ``__score``, ``__threshold``, ``__logit`` and
``__text`` are this operator's names, and columns that have them are dropped.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
SAMPLE, EPOCHS, SEED = 2000, 12, 7
#: Longest text, in characters, to fit on; longer ones are scored like any other. With SAMPLE it bounds what comes to the driver: 80 million characters.
LONGEST = 20_000
#: Histogram bins of a logit's unit, and the logits that the first and last bin start from.
BINS, SPAN = 20, 40
#: Rows of a language's rarer class at which it counts as much as all languages together.
PRIOR = 10
#: Size of the first steps, which shrinks to nothing over the epochs, and what the sums of squared gradients start from.
RATE, DAMP = 0.2, 1e-3
#: Share of words that a step doesn't see, so that no word alone decides; rows of a step; steps at least, for few rows.
DROP, ROWS, STEPS = 0.35, 32, 700
TRIM = re.compile(r"^\W+|\W+$")


def features(word: str) -> list[int]:
    """Bucket numbers of a lower-case word; 0 is the empty word's."""
    import xxhash

    w = TRIM.sub("", word)
    if not w:
        return [0, 0, 0]
    return [1 + xxhash.xxh64_intdigest(k, 11) % (BUCKETS - 1) for k in ("w" + w, "4" + w[:4], "5" + w[:5])]


class Words:
    """Words to row numbers of a growing table of their features; emptied when full."""

    def __init__(self, most: int = 1 << 18):
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.rows, self._feats = {"": 0}, array("i", [0, 0, 0])

    def numbers(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        for w in {w for w in words if w not in rows}:
            rows[w] = len(rows)
            self._feats.extend(features(w))
        return np.fromiter(map(rows.__getitem__, words), np.int32, len(words))

    def feats(self) -> np.ndarray:
        """Three bucket numbers of each row."""
        return np.array(self._feats, np.int32).reshape(-1, 3)

    def reset_if_full(self) -> None:
        if len(self.rows) > self.most:
            self.reset()


def laid_out(texts: list[str | None], table: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each padded so that no filter reaches the next, and where each begins."""
    pad = [""] * max(WIDTHS)
    words, starts = [], []
    for t in texts:
        starts.append(len(words))
        words += (t or "").lower().split()
        words += pad
    return table.numbers(words), np.array(starts)


class Cnn:
    """The model: embedding, filters by width, output layer."""

    def __init__(self, rng: np.random.Generator):
        self.emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.filters = {w: rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = np.full(len(WIDTHS) * FILTERS, 0.5, np.float32)
        self.shift = 0.0

    def pooled(self, ids: np.ndarray, starts: np.ndarray, vectors: np.ndarray, where: bool = False):
        """Maxima of each filter over each text, and optionally where they are. vectors: of the word numbers."""
        top, at = [], []
        for w in WIDTHS:
            # component by component, as a matrix product may round by the number of rows
            projected = [sum(vectors[:, d, None] * self.filters[w][j][d] for d in range(DIM)) for j in range(w)]
            n = len(ids) - w + 1
            c = projected[0][ids[:n]]
            for j in range(1, w):
                c += projected[j][ids[j : j + n]]
            # a text's windows end with its last pad; later ones would reach the next text
            ends = np.append(starts[1:], len(ids)) - w + 1
            m = np.maximum.reduceat(c, np.column_stack([starts, ends]).ravel()[:-1], axis=0)[::2]
            top.append(np.maximum(m + self.bias[w], 0))
            if where:
                size = np.diff(np.append(starts, n))
                hit = (c == np.repeat(m, size, axis=0)) & (np.arange(n) < np.repeat(ends, size))[:, None]
                spot = np.where(hit, np.arange(n)[:, None], n)
                at.append(np.minimum.reduceat(spot, starts, axis=0))
        return np.concatenate(top, 1), at

    def logits(self, texts: list[str | None], table: Words) -> np.ndarray:
        out = []
        from codeloom.llm.bpe import blocks

        for b, e in blocks(texts, 1 << 18):
            ids, starts = laid_out(texts[b:e], table)
            local, ids = np.unique(ids, return_inverse=True)
            vectors = self.emb[table.feats()[local]].sum(1)
            out.append((self.pooled(ids.astype(np.int32), starts, vectors)[0] * self.out).sum(1))
            table.reset_if_full()
        return np.concatenate(out) + self.shift if out else np.zeros(0)


def fit(texts: list[str | None], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED):
    """The model, and which rows its weights were fitted on; its shift is from the others of ``texts``."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    model, table = Cnn(rng), Words(1 << 30)
    if len(set(labels.tolist())) < 2:
        model.out[:] = 0
        model.shift = -30.0
        return model, np.ones(len(texts), bool)
    aside = np.arange(len(texts)) % 5 == 0
    rows = np.flatnonzero(~aside)
    per_text = []
    for t in texts:
        ids, _ = laid_out([t], table)
        per_text.append(ids)
    feats = table.feats()
    # both classes weigh the same, however many rows each has
    weight = np.where(labels == 1, 0.5 / labels[rows].mean(), 0.5 / (1 - labels[rows].mean())) if 0 < labels[rows].mean() < 1 else np.ones(len(labels))
    weight = weight.astype(np.float32)
    m2 = {id(p): np.full(p.shape, DAMP, np.float32) for p in (model.emb, model.out, *model.filters.values(), *model.bias.values())}

    def step(p, at, g, rate):
        s = m2[id(p)]
        if at is None:
            s += g * g
            p -= rate * g / np.sqrt(s)
        else:  # rows of the table, summed over repeats first
            u, inv = np.unique(at, return_inverse=True)
            total = np.zeros((len(u), g.shape[1]), np.float32)
            np.add.at(total, inv, g)
            s[u] += total * total
            p[u] -= rate * total / np.sqrt(s[u])
            p[0] = 0

    bias = np.zeros(1, np.float32)
    m2[id(bias)] = np.full(1, DAMP, np.float32)
    epochs = max(epochs, -(-STEPS * ROWS // len(rows))) if epochs else 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        rng.shuffle(rows)
        for k in range(0, len(rows), ROWS):
            part = rows[k : k + ROWS]
            size = np.array([len(per_text[i]) for i in part])
            ids = np.concatenate([per_text[i] for i in part])
            starts = np.cumsum(size) - size
            ids = np.where(rng.random(len(ids)) < DROP, 0, ids)
            local, inv = np.unique(ids, return_inverse=True)
            vectors = model.emb[feats[local]].sum(1)
            top, at = model.pooled(inv.astype(np.int32), starts, vectors, True)
            p = 1 / (1 + np.exp(-(top @ model.out + bias)))
            d = (p - labels[part]) * weight[part] / len(part)
            back = d[:, None] * model.out[None, :] * (top > 0)
            step(model.out, None, top.T @ d, rate)
            step(bias, None, d.sum(keepdims=True), rate)
            for b, w in enumerate(WIDTHS):
                g = back[:, b * FILTERS : (b + 1) * FILTERS]
                spots = at[b]
                grad = np.zeros_like(model.filters[w])
                rowids, rowgrads = [], []
                for j in range(w):
                    word = inv[np.minimum(spots + j, len(inv) - 1)]
                    grad[j] = np.einsum("df,dfk->kf", g, vectors[word])
                    gv = g[:, :, None] * model.filters[w][j].T[None]
                    f = feats[local[word]].reshape(-1, 3)
                    rowids.append(f.ravel())
                    rowgrads.append(np.repeat(gv.reshape(-1, DIM), 3, axis=0))
                step(model.filters[w], None, grad, rate)
                step(model.bias[w], None, g.sum(0), rate)
                step(model.emb, np.concatenate(rowids), np.concatenate(rowgrads).astype(np.float32), rate)
    model.shift = float(bias[0])
    held = np.flatnonzero(aside)
    z = model.logits([texts[i] for i in held], table)
    y = labels[held]
    model.shift -= cutoff(z, y)
    return model, ~aside


def cutoff(z: np.ndarray, y: np.ndarray) -> float:
    """The logit that misjudges the least weight, classes weighted equally; in the middle of the widest gap."""
    order = np.argsort(z, kind="stable")
    return middle(z[order], loss(y[order], 1 - y[order]))


def loss(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Weight misjudged by a cut before each of the ordered places and after the last, classes weighted equally."""
    missed = np.append(0, np.cumsum(pos)) / max(pos.sum(), 1)  # positives below the cut
    return missed + 1 - np.append(0, np.cumsum(neg)) / max(neg.sum(), 1)  # and negatives above it


def middle(z: np.ndarray, loss: np.ndarray) -> float:
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gap = np.concatenate([[1], z[1:] - z[:-1], [1]])
    best = np.flatnonzero(loss <= loss.min() + 1e-9)
    return float(cuts[best[np.argmax(gap[best])]])


def calibrate(raw: DataFrame, labels: DataFrame, fitted: list) -> tuple[float, dict]:
    """The cutoff of ``raw(doc_id, lang, __logit)`` over all usable labelled rows but the ``fitted`` ids, and thresholds by language (key None: of others)."""
    spark = raw.sparkSession
    lang = F.col("lang") if "lang" in raw.columns else F.lit(None).cast("string")
    bin_ = F.floor(F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), "__logit")) * BINS).cast("int")
    truth = usable(labels)
    if fitted:  # at most 2 * sample ids
        truth = truth.join(F.broadcast(spark.createDataFrame([(i,) for i in fitted], truth.select("doc_id").schema)), "doc_id", "left_anti")
    # a language has at most 2 * SPAN * BINS + 1 bins
    counts = raw.select("doc_id", lang.alias("lang"), bin_.alias("bin")).join(truth, "doc_id").groupBy("lang", "bin").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg")).collect()
    bins = {b: k for k, b in enumerate(sorted({r.bin for r in counts}))}
    of: dict = {}
    for r in counts:
        h = of.setdefault(r.lang, np.zeros((2, len(bins))))
        h[:, bins[r.bin]] += r.pos, r.neg
    total = sum(of.values(), np.zeros((2, len(bins))))
    if not total.sum(1).all():
        return 0.0, {None: 0.5}
    z = (np.array(list(bins)) + 0.5) / BINS
    everywhere = loss(*total)
    shift, limits = middle(z, everywhere), {None: 0.5}
    for lang, h in of.items():
        if lang is not None and (rarer := h.sum(1).min()) > 0:
            own = rarer / (rarer + PRIOR)
            limits[lang] = float(1 / (1 + np.exp(shift - middle(z, own * loss(*h) + (1 - own) * everywhere))))
    return shift, limits


def usable(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: one row of each labelled id; remainder of crc32 not 0."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1) AND crc32(cast(doc_id AS string)) % 5 <> 0")
    return rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Labelled rows to fit on, on the driver: at most ``sample`` of each class, none over ``LONGEST``."""
    truth = usable(labels)
    order = [F.xxhash64(F.lit("fit"), "doc_id"), "doc_id"]
    ids = [r for y in (0, 1) for r in truth.where(F.col("toxic") == y).orderBy(*order).limit(sample).collect()]
    if not ids:
        return [], [], np.zeros(0)
    chosen = docs.sparkSession.createDataFrame(ids, truth.schema)  # at most 2 * sample rows of two numbers
    short = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST)
    # of repeated rows the least, so that the rows collected are as many as the ids
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id % 1000003 * 7919 % 1000003, r.doc_id, r.text or ""))
    return [r.doc_id for r in rows], [r.text for r in rows], np.array([r.toxic for r in rows])


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The model and the ids that its weights were fitted on."""
    ids, texts, y = sampled(docs, labels, sample)
    model, used = fit(texts, y)
    return model, [i for i, u in zip(ids, used, strict=True) if u]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The model, shifted, and thresholds by language."""
    model, ids = fitted(docs, labels, sample)
    shift, limits = calibrate(logits(docs, model, text=False), labels, ids)
    model.shift -= shift
    return model, limits


def logits(docs: DataFrame, model: Cnn, text: bool = True) -> DataFrame:
    """``docs`` with its columns, text only if asked for, and the model's logit."""
    import pyarrow as pa

    from codeloom.llm.common import held

    docs = docs.drop("__score", "__threshold", "__logit", "__text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: buckets times dimensions

    def run(batches):
        words = held("toxicity words", Words)
        for b in batches:
            z = shared.value.logits(b.column("__text").to_pylist(), words)
            cols = [c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "__text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(z, pa.float64())], [n for n in b.schema.names if n != "__text"] + ["__logit"])

    kept = docs.select(*[c for c in docs.columns if text or c != "text"])
    schema = T.StructType([*kept.schema.fields, T.StructField("__logit", T.DoubleType())])
    return docs.select(*kept.columns, F.col("text").alias("__text")).mapInArrow(run, schema)


def judged(raw: DataFrame, shift: float, thresholds: dict) -> DataFrame:
    """``raw`` with score (0 to 1) and threshold (its language's) in place of the logit."""
    lang = F.col("lang") if "lang" in raw.columns else F.lit(None).cast("string")
    pairs = [x for k, v in thresholds.items() if k is not None for x in (F.lit(k), F.lit(v))]
    limit = F.coalesce(F.create_map(*pairs)[lang], F.lit(thresholds[None])) if pairs else F.lit(thresholds[None])
    z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("__logit") - shift))
    return raw.withColumn("__score", 1 / (1 + F.exp(-z))).withColumn("__threshold", limit).drop("__logit")


def score(docs: DataFrame, model: Cnn, thresholds: dict) -> DataFrame:
    """``docs`` with its columns, score (0 to 1) and threshold (its language's)."""
    return judged(logits(docs, model), 0.0, thresholds)


def trained_score(docs: DataFrame, labels: DataFrame, text: bool = True) -> DataFrame:
    """``score`` by the model of ``train``; texts are read by the model once, for thresholds and scores."""
    from codeloom.llm.common import cut

    model, ids = fitted(docs, labels)
    raw = cut(logits(docs, model, text))
    return judged(raw, *calibrate(raw, labels, ids))


def op8_toxicity(spark, sf_dir):
    from codeloom.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = trained_score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), text=False)
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        F.col("__score").alias("score"),
        F.when(F.col("__score") >= 0.5, 1).otherwise(0).alias("predicted"),
        (F.col("__score") >= F.col("__threshold")).alias("over_language_threshold"),
    )
