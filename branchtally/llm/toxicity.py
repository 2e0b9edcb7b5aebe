"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word is the sum of the embeddings of its hash and of the hashes of its first bytes, so unseen
forms of a known stem are near it. Filters of several widths run over the words; the maximum of
each filter over the whole text goes into a logistic unit. Training is gradient descent with the
gradients that pass through the maxima; one embedding dimension starts at the smoothed log-odds
of its bucket. A third of the sample is kept out of training: it calibrates the score (Platt) and
sets a threshold for each language.

Labels are read from a bounded sample (``SAMPLE_ROWS`` labelled rows by hash of the id, and of
those the shortest of each language and label in ``SAMPLE_CHARS`` characters); the model is of fixed size and is broadcast. Every
text is scored whole, inside Arrow batches, from its words alone.

Defined cases: null and empty texts score what no word scores; without labels, or with one label
only, every score is the share of toxic labels (0 without any); null ids have no label and are
not held out; labels that are null or contradict each other do not count; repeated rows are
scored alike; empty tables give an empty result; further columns pass through ``score``, and
those named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnp import ALNUM, grouped, hash_words

#: Buckets and size of the embeddings, bytes of the prefixes, filter widths, filters of each.
BUCKETS, DIM, PREFIXES, WIDTHS, FILTERS = 1 << 15, 8, (4, 5, 6, 7), (1, 2, 3), 8
#: Bounds of the labelled sample.
SAMPLE_ROWS, SAMPLE_CHARS = 9_000, 48_000_000
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.08, 20_261
#: Score from which a text counts as toxic without a threshold of its language.
THRESHOLD = 0.7
#: Labelled rows, and toxic ones among them, that a language needs for its own threshold.
LANG_ROWS, LANG_TOXIC = 150, 15


@dataclass
class Model:
    embeddings: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def word_buckets(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers of each word, first word of each text)."""
    at, hashes, heads = hash_words(data, ALNUM, PREFIXES)
    ids = np.stack([hashes, *heads], axis=1) & np.uint64(BUCKETS - 1)
    return ids.astype(np.int32), np.searchsorted(at, starts)


def _vectors(embeddings: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = embeddings[ids[:, 0]]
    for j in range(1, ids.shape[1]):
        out = out + embeddings[ids[:, j]]
    return out


def _convolve(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    n = len(x) - len(f) + 1
    return sum(x[i : i + n] @ f[i] for i in range(len(f)))


def pooled(model: Model, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The maxima of all filters over each text; 0 where a text has too few words."""
    ends = np.append(begins[1:], len(ids))
    out = np.zeros((len(begins), len(WIDTHS) * FILTERS), np.float32)
    x = _vectors(model.embeddings, ids)
    for w, (width, f, offset) in enumerate(zip(WIDTHS, model.filters, model.offsets, strict=True)):
        has = np.flatnonzero(ends - begins >= width)
        if not len(has):
            continue
        y = _convolve(x, f)
        bounds = np.stack([begins[has], ends[has] - width + 1], axis=1).ravel()
        y = np.concatenate([y, np.full((1, FILTERS), -np.inf, np.float32)])  # the last bound may be the end
        top = np.maximum.reduceat(y, bounds, axis=0)[::2]
        out[has, w * FILTERS : (w + 1) * FILTERS] = np.maximum(top + offset, 0)
    return out


def raw_scores(model: Model, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return pooled(model, ids, begins) @ model.weights + model.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str], labels: np.ndarray, langs: list[str | None]) -> Model:
    """Trains on two thirds of the sample, calibrates on the rest."""
    rng = np.random.default_rng(SEED)
    share = float(np.mean(labels)) if len(labels) else 0.0
    docs = [_ids_of(t) for t in texts]
    hold = np.arange(len(docs)) % 3 == 2
    fit = np.flatnonzero(~hold)
    model = _fresh(rng)
    if not 0 < labels[fit].sum() < len(fit):
        model.weights[:] = 0
        model.bias = float(np.log(max(share, 1e-4) / max(1 - share, 1e-4)))
        return model
    _log_odds(model, [docs[i] for i in fit], labels[fit])
    model.bias = float(np.log(share / (1 - share))) - 1
    squares = [np.full_like(p, 1e-3) for p in (model.embeddings, *model.filters, *model.offsets, model.weights)] + [np.full(1, 1e-3)]
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        order = rng.permutation(fit)
        for i in range(0, len(order), BATCH):
            _step(model, [docs[j] for j in order[i : i + BATCH]], labels[order[i : i + BATCH]], squares, rate, rng)
    held = np.flatnonzero(hold)
    if len(held):
        z = np.array([raw_scores(model, docs[i], np.zeros(1, np.int64))[0] for i in held], np.float64)
        model.scale, model.shift = _platt(z, labels[held])
        model.thresholds = _by_language(_sigmoid(model.scale * z + model.shift), labels[held], [langs[i] for i in held])
    return model


def _ids_of(text: str | None) -> np.ndarray:
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    return word_buckets(data, np.zeros(1, np.int64))[0]


def _fresh(rng: np.random.Generator) -> Model:
    small = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    filters = [small(w, DIM, FILTERS) / np.sqrt(w) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3 / len(f)  # toward the log-odds
    return Model(small(BUCKETS, DIM) * 0.05, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.abs(small(len(WIDTHS) * FILTERS)), 0.0)


def _log_odds(model: Model, docs: list[np.ndarray], labels: np.ndarray) -> None:
    """Starts dimension 0 at the buckets' smoothed log-odds, by the number of texts that hold them."""
    seen = np.zeros((2, BUCKETS))
    for ids, y in zip(docs, labels, strict=True):
        seen[int(y), np.unique(ids)] += 1
    total = seen.sum(1, keepdims=True) * 0 + np.array([[np.sum(labels == 0)], [np.sum(labels == 1)]])
    p = (seen + 0.5) / (total + 1)
    odds = np.log(p[1] / p[0]) * (seen.sum(0) / (seen.sum(0) + 4))
    model.embeddings[:, 0] = odds / 4


def _step(model: Model, docs: list[np.ndarray], labels: np.ndarray, squares: list[np.ndarray], rate: float, rng: np.random.Generator) -> None:
    """One step of Adagrad on the log loss of a batch; words are dropped at random."""
    g_emb: dict[str, list] = {"at": [], "g": []}
    g_f = [np.zeros_like(f) for f in model.filters]
    g_o = [np.zeros_like(o) for o in model.offsets]
    g_w, g_b = np.zeros_like(model.weights), 0.0
    for ids, y in zip(docs, labels, strict=True):
        if len(ids) > 8:
            ids = ids[rng.random(len(ids)) > 0.2]
        x = _vectors(model.embeddings, ids)
        top = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        where: list[np.ndarray | None] = []
        for w, (width, f, o) in enumerate(zip(WIDTHS, model.filters, model.offsets, strict=True)):
            if len(ids) < width:
                where.append(None)
                continue
            conv = _convolve(x, f)
            at = conv.argmax(0)
            where.append(at)
            top[w * FILTERS : (w + 1) * FILTERS] = np.maximum(conv[at, np.arange(FILTERS)] + o, 0)
        error = float(_sigmoid(np.array(top @ model.weights + model.bias)) - y) / len(docs)
        g_w += error * top
        g_b += error
        back = error * model.weights * (top > 0)
        for w, (width, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
            if where[w] is None:
                continue
            g = back[w * FILTERS : (w + 1) * FILTERS]
            g_o[w] += g
            for i in range(width):
                at = where[w] + i
                g_f[w][i] += x[at].T * g
                g_x = f[i].T * g[:, None]  # (FILTERS, DIM)
                for j in range(ids.shape[1]):
                    g_emb["at"].append(ids[at, j])
                    g_emb["g"].append(g_x)
    at, inverse = np.unique(np.concatenate(g_emb["at"]) if g_emb["at"] else np.zeros(0, np.int32), return_inverse=True)
    g = np.zeros((len(at), DIM), np.float32)
    if len(at):
        np.add.at(g, inverse, np.concatenate(g_emb["g"]))
    squares[0][at] += g * g
    model.embeddings[at] -= rate * g / np.sqrt(squares[0][at])
    dense = [*zip(model.filters, g_f, strict=True), *zip(model.offsets, g_o, strict=True), (model.weights, g_w)]
    for (p, grad), s in zip(dense, squares[1:-1], strict=True):
        grad = grad + 1e-4 * p
        s += grad * grad
        p -= rate * grad / np.sqrt(s)
    squares[-1] += g_b * g_b
    model.bias -= float(rate * g_b / np.sqrt(squares[-1][0]))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale (positive) and shift of a logistic fit of the labels on the raw scores."""
    if not 0 < y.sum() < len(y):
        return 1.0, 0.0
    spread = max(float(z.std()), 1e-6)
    u = z / spread
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a weak prior
        p = _sigmoid(a * u + b)
        q = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([np.sum((p - y) * u) + 1e-2 * a, np.sum(p - y)])
        hess = np.array([[np.sum(q * u * u) + 1e-2, np.sum(q * u)], [np.sum(q * u), np.sum(q) + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -1, 1))
    return (max(a, 1e-3) / spread, b) if np.isfinite([a, b]).all() else (1.0, 0.0)


def _by_language(score: np.ndarray, y: np.ndarray, langs: list[str | None]) -> dict[str, float]:
    """Per language the threshold from 0.5 to 0.9 with the best F1; ties go to the one nearest the default."""
    out = {}
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if own.sum() < LANG_ROWS or y[own].sum() < LANG_TOXIC:
            continue
        tried = np.round(np.arange(0.5, 0.901, 0.02), 2)
        hit = [(score[own] >= t) for t in tried]
        f1 = [2 * np.sum(h & (y[own] == 1)) / max(1, np.sum(h) + y[own].sum()) for h in hit]
        out[lang] = float(min(zip(tried, f1, strict=True), key=lambda p: (-round(p[1], 6), abs(p[0] - THRESHOLD)))[0])
    return out


# ---------------------------------------------------------------- Spark


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never read: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _within(rows: list, most: int) -> list:
    """The rows whose ``n`` fit into ``most`` characters, so that only the longest texts are left out.

    Each language and label has its share of the characters by its rows and takes its shortest
    texts first; what shares leave over goes to the shortest of the rest.
    """
    order = sorted(rows, key=lambda r: (r["n"], r["doc_id"]))
    strata = [(r["lang"], r["toxic"] > 0) for r in order]
    share = {s: most * strata.count(s) // len(order) for s in set(strata)}
    chosen, rest = [], []
    for row, stratum in zip(order, strata, strict=True):
        fits = row["n"] <= share[stratum]
        share[stratum] -= row["n"] if fits else 0
        (chosen if fits else rest).append(row)
    left = most - sum(r["n"] for r in chosen)
    for row in rest:
        if row["n"] > left:
            break  # the rest is longer
        left -= row["n"]
        chosen.append(row)
    return chosen


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the sample of labelled rows that are not held out."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
        .where("toxic = other")
        .select("doc_id", "toxic")
    )
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))  # bounded rows
    text = F.coalesce(F.col("text"), F.lit(""))
    length = F.max(F.length(text)).alias("n")
    lengths = docs.join(sample, "doc_id").groupBy("doc_id").agg(length, F.first("toxic").alias("toxic"), F.min("lang").alias("lang"))
    chosen = [(row["doc_id"], int(row["toxic"])) for row in _within(lengths.collect(), SAMPLE_CHARS)]  # SAMPLE_ROWS rows at most
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id bigint, toxic int")
    rows = docs.select("doc_id", text.alias("text"), "lang").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    found = sorted(rows.select(F.xxhash64("doc_id"), "text", "toxic", "lang").toArrow().to_pylist(), key=lambda r: list(r.values())[0])
    return train([r["text"] for r in found], np.array([int(r["toxic"] > 0) for r in found]), [r["lang"] for r in found])


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**model.value)
        for batch in batches:
            scores = []
            # Unicode case; done before grouping because it may change a text's length
            texts = pa.array([(t or "").lower() for t in batch.column("_text").to_pylist()], pa.string())
            for _, _, data, starts in grouped(texts, lower=False):
                ids, begins = word_buckets(data, starts)
                scores.append(_sigmoid(m.scale * raw_scores(m, ids, begins).astype(np.float64) + m.shift))
            score = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            kept = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), score], names=[*kept, "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns of ``docs`` plus ``score``, from ``text`` alone."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # BUCKETS x DIM numbers
    read = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)
    return read.mapInArrow(_scorer(sent), f"{schema}, score double")


def threshold_of(model: Model, lang: Column) -> Column:
    """The language's threshold, else the default; at most SAMPLE_ROWS / LANG_ROWS languages."""
    out = F.lit(THRESHOLD)
    for name, value in sorted(model.thresholds.items()):
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the verdict by the language's threshold."""
    model = learn(docs, labels)
    return score(docs, model, ["doc_id", "lang"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        threshold_of(model, F.col("lang")).alias("lang_threshold"), (F.col("score") >= threshold_of(model, F.col("lang"))).alias("rejected"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the texts that their language's threshold rejects."""
    model = learn(docs, labels)
    scored = score(docs.withColumn("_body", F.col("text")), model, [*(c for c in docs.columns if c != "text"), "_body"])
    clean = scored.where(F.col("score") < threshold_of(model, F.col("lang")))
    return clean.withColumnRenamed("_body", "text").select(*docs.columns)
