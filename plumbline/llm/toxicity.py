"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy on the shards of a Spark table.

A word's vector is the sum of the hashed embeddings of the word, of its beginnings and of its ending, so that forms not
seen in training share what their stems have taught. Filters of several widths run over the whole text, the greatest
response of each filter is kept, and a logistic layer scores it. Platt scaling on rows that the weights did not see turns the
score into a probability at the share of toxic rows among the labels; a threshold is then set for each language.

Every labelled row that is not held out takes part with its whole text: four fifths of the ids, by a hash, teach the weights,
the others calibrate. The rows are dealt into shards of some ``SHARD_ROWS``. In each round every shard goes once through
its rows, starting from the weights of the round before, and Spark averages what the shards have learnt, an embedding
weighted by how often each of them changed it. The sums are of whole numbers, so their order does not matter. The driver holds the weights
(2^18 embeddings at most) and never a row. Language, source, label and id are never inputs of a score.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import store
from plumbline.llm.bloom import bloom
from plumbline.llm.textbytes import LOWER, mix, prefix_sums, range_hash, slices

#: Labelled rows of a shard, about: a fifth of them calibrates.
SHARD_ROWS = 8192
#: Words (and 32 for each text) that are put in random order at a time.
BLOCK_WORDS = 1 << 18
ROUNDS, BATCH, SEED = 6, 64, 7
#: Weights are summed as multiples of 1 / FINE; raw scores are multiples of 1 / STEPS between -64 and 64.
FINE, STEPS = 1 << 18, 1 << 10
BUCKETS = 1 << 18
DIM, FILTERS, WIDTHS = 8, 6, (1, 2, 3)
#: Buckets met in fewer training texts keep a zero vector: what cannot be learnt must not add noise.
LEAST_TEXTS = 4
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (words x parts) of runs of letters and digits, and the text number of each word. Bucket 0 is padding."""
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = inside & np.concatenate([[True], ~inside[:-1]]) if len(data) else inside
    if len(data):
        first |= inside & edge[:-1]
    start = np.flatnonzero(first)
    last = inside & np.concatenate([~inside[1:], [True]]) if len(data) else inside
    if len(data):
        last |= inside & edge[1:]
    end = np.flatnonzero(last) + 1
    sums = prefix_sums(LOWER[data])
    parts = [(start, end), *((start, np.minimum(end, start + n)) for n in (4, 5, 6)), (np.maximum(start, end - 4), end)]
    out = np.empty((len(start), len(parts)), np.int32)
    for k, (s, e) in enumerate(parts):
        h = mix(range_hash(sums, s, e) + np.uint64(k))
        out[:, k] = (h % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    return out, np.searchsorted(at, start, "right") - 1


@dataclass
class Model:
    embed: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] | None = None

    def pooled(self, parts: np.ndarray, text: np.ndarray, texts: int, where: bool = False):
        """Greatest response of each filter over each text, 0 at least; with ``where`` also its window's first word."""
        counts = np.bincount(text, minlength=texts)
        out = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
        places = np.full(out.shape, -1, np.int64)
        some = np.flatnonzero(counts)
        if not len(some):
            return (out, places, None) if where else out
        begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
        x = self.embed[parts[:, 0]]
        for k in range(1, parts.shape[1]):
            x = x + self.embed[parts[:, k]]
        for n, (width, w, b) in enumerate(zip(WIDTHS, self.filters, self.biases, strict=True)):
            z = x @ w[0]
            for j in range(1, width):  # words after the text's end count as zero vectors
                z[:-j] += (x @ w[j])[j:] * (text[j:] == text[:-j])[:, None]
            best = np.maximum.reduceat(z, begin[some], axis=0)
            span = slice(n * FILTERS, (n + 1) * FILTERS)
            out[some, span] = np.maximum(best + b, 0)
            if where:
                for t in some:
                    places[t, span] = begin[t] + np.argmax(z[begin[t] : begin[t] + counts[t]], axis=0)
        return (out, places, x) if where else out

    def raw(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of texts before calibration, in steps."""
        parts, text = word_features(data, at)
        raw = self.pooled(parts, text, len(at) - 1) @ self.weights + self.bias
        return np.rint(np.clip(raw.astype(np.float64), -64, 64) * STEPS).astype(np.int64)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (raw / STEPS) + self.shift, -40, 40)))

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.probability(self.raw(data, at))

    def dense(self) -> np.ndarray:
        """All weights but the embeddings, as rows of DIM numbers."""
        flat = np.concatenate([*(w.ravel() for w in self.filters), *self.biases, self.weights, [self.bias]])
        return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)

    def with_weights(self, embed: np.ndarray, dense: np.ndarray) -> Model:
        flat = dense.ravel().astype(np.float32)
        sizes = [*(w.size for w in self.filters), *(b.size for b in self.biases), self.weights.size, 1]
        own = np.split(flat, np.cumsum(sizes))
        n = len(WIDTHS)
        return Model(embed, [x.reshape(w.shape) for x, w in zip(own, self.filters, strict=False)], own[n : 2 * n], own[2 * n], float(own[2 * n + 1][0]))


def _adam(state: dict, key, value: np.ndarray, grad: np.ndarray, rate: float, rows=None) -> None:
    m, v, t = state.setdefault(key, (np.zeros_like(value), np.zeros_like(value), [0]))
    t[0] += 1
    at = slice(None) if rows is None else rows
    m[at] = 0.9 * m[at] + 0.1 * grad
    v[at] = 0.99 * v[at] + 0.01 * grad * grad
    value[at] -= rate * (m[at] / (1 - 0.9 ** t[0])) / (np.sqrt(v[at] / (1 - 0.99 ** t[0])) + 1e-6)


def new_model(known: np.ndarray) -> Model:
    """Weights before the first round. ``known``: the buckets that are learnt."""
    rng = np.random.default_rng(SEED)
    embed = np.zeros((BUCKETS, DIM), np.float32)
    embed[known] = rng.normal(0, 0.05, (int(known.sum()), DIM))
    return Model(embed, [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], [np.full(FILTERS, -0.05, np.float32) for _ in WIDTHS], rng.normal(0.3, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), -2.0)


#: A text on its way into the training: shard, bucket numbers of its words, label.
Text = tuple[int, np.ndarray, int]


def texts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[Text]:
    """The texts of batches of (shard, label, text)."""
    for batch in batches:
        shard, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for start, stop, data, at in slices(batch.column(2), 1 << 20):
            parts, text = word_features(data, at)
            edges = np.searchsorted(text, np.arange(stop - start + 1))
            for k in range(stop - start):
                yield int(shard[start + k]), parts[edges[k] : edges[k + 1]], int(label[start + k])


def _blocks(texts: Iterable[Text]) -> Iterator[list[Text]]:
    block, words = [], 0
    for t in texts:
        block.append(t)
        words += 32 + len(t[1])
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


class Learner:
    """One shard's copy of the weights in one round."""

    def __init__(self, model: Model, known: np.ndarray, turn: int):
        self.model, self.known, self.turn = model.with_weights(model.embed.copy(), model.dense()), known, turn
        self.bias, self.state = np.array([model.bias], np.float32), {}
        self.texts, self.changes = 0, np.zeros(BUCKETS, np.int64)

    def learn(self, shard: int, texts: Iterable[Text]) -> None:
        for k, block in enumerate(_blocks(texts)):
            order = np.random.default_rng((SEED, self.turn, shard, k)).permutation(len(block))
            for own in np.array_split(order, -(-len(block) // BATCH)):
                self.step([block[t] for t in own])

    def step(self, own: list[Text]) -> None:
        model, rate = self.model, 0.02 * 0.7**self.turn
        p, number = np.concatenate([t[1] for t in own]), np.repeat(np.arange(len(own)), [len(t[1]) for t in own])
        label = np.array([t[2] for t in own])
        self.texts += len(own)
        pooled, places, x = model.pooled(p, number, len(own), where=True)
        out = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + self.bias[0], -30, 30)))
        back = ((out - label) / len(own)).astype(np.float32)
        to_pooled = back[:, None] * model.weights * (pooled > 0)
        hit, grads = [], []
        for n, width in enumerate(WIDTHS):
            span = slice(n * FILTERS, (n + 1) * FILTERS)
            g, place = to_pooled[:, span], places[:, span]
            t, f = np.nonzero((g != 0) & (place >= 0))
            gw = np.zeros_like(model.filters[n])
            for j in range(width):
                at_j = place[t, f] + j
                ok = (at_j < len(p)) & (number[np.minimum(at_j, len(p) - 1)] == t) if len(t) else np.zeros(0, bool)
                tt, ff, aa = t[ok], f[ok], at_j[ok]
                if not len(tt):
                    continue
                np.add.at(gw[j].T, ff, g[tt, ff][:, None] * x[aa])
                hit.append(p[aa])
                grads.append(g[tt, ff][:, None] * model.filters[n][j][:, ff].T)
            _adam(self.state, ("w", n), model.filters[n], gw + 1e-4 * model.filters[n], rate)
            _adam(self.state, ("b", n), model.biases[n], g.sum(0), rate)
        _adam(self.state, "v", model.weights, pooled.T @ back + 1e-4 * model.weights, rate)
        _adam(self.state, "c", self.bias, np.array([back.sum()], np.float32), rate)
        model.bias = float(self.bias[0])
        if hit:
            ids, inverse = np.unique(np.concatenate(hit).ravel(), return_inverse=True)
            ge = np.zeros((len(ids), DIM), np.float32)
            np.add.at(ge, inverse.ravel(), np.repeat(np.concatenate(grads), p.shape[1], axis=0))
            own_known = self.known[ids]
            ge *= own_known[:, None]
            _adam(self.state, "e", model.embed, ge + 1e-4 * model.embed[ids] * own_known[:, None], rate, ids)
            self.changes[ids[own_known]] += 1

    def learnt(self) -> pa.RecordBatch:
        """Rows (key, weight, numbers in steps of 1 / FINE): changed embeddings by bucket, the other weights under keys below 0."""
        ids, dense = np.flatnonzero(self.changes), self.model.dense()
        key = np.concatenate([ids, -1 - np.arange(len(dense))])
        weight = np.concatenate([self.changes[ids], np.full(len(dense), self.texts)])
        value = np.rint(np.concatenate([self.model.embed[ids], dense]).astype(np.float64) * FINE).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(weight), *(pa.array(value[:, k]) for k in range(DIM))], names=["key", "weight", *_VALUES])


_VALUES = [f"v{k}" for k in range(DIM)]


def known_buckets(rows: DataFrame) -> np.ndarray:
    """Which buckets at least ``LEAST_TEXTS`` texts hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for _, parts, _ in texts_of(batches):
            seen[np.unique(parts)] += 1
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(seen[ids])], names=["key", "n"])

    got = rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS).select("key").toArrow()
    known = np.zeros(BUCKETS, bool)
    known[got["key"].to_numpy()] = True
    known[0] = False
    return known


def train(rows: DataFrame, rounds: int = ROUNDS) -> Model:
    """Weights learnt from all rows (shard, label, text); each shard lies in one file, in a fixed order."""
    context = rows.sparkSession.sparkContext
    known = known_buckets(rows)
    model = new_model(known)
    for turn in range(rounds):
        shared = context.broadcast((model, known))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            for shard, texts in itertools.groupby(texts_of(batches), key=lambda t: t[0]):
                learner = Learner(*shared.value, turn)
                learner.learn(shard, texts)
                yield learner.learnt()

        schema = ", ".join(f"{c} long" for c in ("key", "weight", *_VALUES))
        mean = rows.mapInArrow(learn, schema).groupBy("key").agg(*((F.sum(F.col(c) * F.col("weight")) / F.sum("weight") / FINE).cast("float").alias(c) for c in _VALUES)).toArrow()
        shared.destroy()
        key, value = mean["key"].to_numpy(), np.stack([mean[c].to_numpy() for c in _VALUES], axis=1)
        embed, dense = model.embed.copy(), model.dense()
        embed[key[key >= 0]] = value[key >= 0]
        dense[-1 - key[key < 0]] = value[key < 0]
        model = model.with_weights(embed, dense)
    return model


def calibrate(model: Model, scored: DataFrame, positive_share: float, precision: float, default: float) -> None:
    """Platt scaling at the labels' own share of positives, then a threshold for each language: the lowest at which the
    precision there is reached on the calibration rows, no lower than ``default`` / 2; ``default`` where a language has few.

    ``scored``: numbers n of rows by (lang, label, raw). There are at most 2^17 raw scores, so the driver gets bounded counts."""
    counts = scored.groupBy("raw", "label").agg(F.sum("n").alias("n")).orderBy("raw", "label").toArrow()
    raw, label, n = (counts[c].to_numpy() for c in ("raw", "label", "n"))
    x = raw / STEPS
    pos, neg = (max(1, int(n[label == v].sum())) for v in (1, 0))
    weight = n * np.where(label == 1, positive_share / pos, (1 - positive_share) / neg)
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps on two numbers, with a weak pull to (1, 0)
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum(weight * (p - label) * x) + 1e-3 * (a - 1), np.sum(weight * (p - label)) + 1e-4 * b])
        w = weight * p * (1 - p)
        h = np.array([[np.sum(w * x * x) + 1e-3, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-4]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -0.5, 0.5)
        if np.abs(step).max() < 1e-9:
            break
    model.scale, model.shift = float(max(a, 1e-3)), float(b)
    by_score = scored.groupBy("lang", "raw").agg(*(F.sum(F.when(F.col("label") == v, F.col("n")).otherwise(0)).alias(c) for v, c in ((1, "pos"), (0, "neg"))))
    down = Window.partitionBy("lang").orderBy(F.desc("raw")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = by_score.select("lang", "raw", F.sum("pos").over(down).alias("pos"), F.sum("neg").over(down).alias("neg"))
    good, bad = F.col("pos") * (positive_share / pos), F.col("neg") * ((1 - positive_share) / neg)
    limits = over.groupBy("lang").agg(F.max("pos").alias("pos"), F.min(F.when(good >= precision * (good + bad), F.col("raw"))).alias("raw")).where("pos >= 20").orderBy("lang").collect()
    model.thresholds = {r["lang"]: default if r["raw"] is None else float(min(0.95, max(default / 2, model.probability(r["raw"])))) for r in limits}


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))


def labelled_rows(docs: DataFrame, known: DataFrame, rows: int, *, id_col: str, text_col: str, lang_col: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Stored rows (shard, label, text, lang, calibrates), a file for each shard. ``known``: (_id, _label), ``rows`` of ``docs`` have one."""
    shards = -(-rows // shard_rows)
    among = bloom(known, F.xxhash64("_id"))

    @F.pandas_udf("boolean")
    def may_be_known(key: pd.Series) -> pd.Series:
        return pd.Series(among.value.test(key.to_numpy().view(np.uint64)))

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.lit(None).cast("int").alias("label"), F.col(text_col).alias("text"), lang.alias("lang"))
    given = known.select("_id", F.col("_label").cast("int").alias("label"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"))
    place = F.xxhash64("_id")
    both = own.where(may_be_known(place)).withColumn("is_doc", F.lit(True)).unionByName(given.withColumn("is_doc", F.lit(False)))
    dealt = both.withColumn("place", place).withColumn("shard", F.pmod(F.shiftright("place", 8), F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard"))
    one_id = Window.partitionBy("shard", "place", "_id").orderBy("text", "lang").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = dealt.withColumn("label", F.max("label").over(one_id)).where("is_doc and label is not null")  # texts move once: labels come to them
    return store.keep(found.select("shard", "label", "text", "lang", (F.pmod("place", F.lit(5)) == 4).alias("calibrates")), "labelled")


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", precision: float = 0.9, default: float = 0.7, rounds: int = ROUNDS, shard_rows: int = SHARD_ROWS) -> Model | None:
    """A model from all labelled rows that are not held out; None if one of the two labels has no row."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col))).groupBy(F.col(id_col).try_cast(docs.schema[id_col].dataType).alias("_id")).agg(F.max(label_col).alias("_label"))
    share = known.agg(F.avg("_label")).first()[0]
    if share is None or share in (0.0, 1.0):
        return None
    rows = docs.select(F.col(id_col).alias("_own")).join(known, F.col("_own") == F.col("_id")).count()
    if not rows:
        return None
    with store.collecting() as made:
        found = labelled_rows(docs, known, rows, id_col=id_col, text_col=text_col, lang_col=lang_col, shard_rows=shard_rows)
        model = train(found.where(~F.col("calibrates")).select("shard", "label", "text"), rounds)
        shared = spark.sparkContext.broadcast(model)

        def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, stop, data, at in slices(batch.column(2), 1 << 20):
                    own = batch.slice(start, stop - start)
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(shared.value.raw(data, at))], names=["lang", "label", "raw"])

        scored = found.where("calibrates").select("lang", "label", "text").mapInArrow(raw, "lang string, label int, raw long")
        calibrate(model, store.keep(scored.groupBy("lang", "label", "raw").agg(F.count("*").alias("n")), "calibration"), float(share), precision, default)
        shared.destroy()
    for path in made:
        store.delete(spark, path)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", threshold: float = 0.7, **fitting) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (score >= ``threshold``) and ``rejected`` (score >= the threshold calibrated
    for the row's language).

    Null and empty texts have no words and get the score of the bias alone. Very long texts are learnt from and scored whole. Repeated rows get
    equal scores. Without labelled rows of both kinds every score is 0. Columns of ``docs`` named like an output are replaced.
    """
    spark = docs.sparkSession
    store.bound_batches(spark)
    model = fit(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, default=threshold, **fitting)
    shared = spark.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in ("score", "predicted", "rejected")]
    text_at = columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, at in slices(batch.column(text_at), 1 << 20):
                own = batch.slice(start, stop - start)
                values = shared.value.score(data, at) if shared.value is not None else np.zeros(stop - start)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(values)], names=[*columns, "score"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.select(*columns).dtypes) + ", score double"
    scored = docs.select(*columns).mapInArrow(score, schema)
    limits = (model.thresholds if model is not None else None) or {}
    limit = F.lit(threshold)
    if lang_col in columns and limits:
        limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.coalesce(F.col(lang_col), F.lit(""))), limit)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("rejected", F.col("score") >= limit)
