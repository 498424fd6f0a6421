"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only the bag has a label. Each sentence has a probability by a logistic model of its hashed words
and their beginnings (PREFIXES bytes, so that inflected forms count together), and the bag's is their noisy-or: 1 - prod(1 - p). Training fits the sentences' weights to the bags' labels, so the model learns
which sentences make a document toxic and can point at them.

The model is fitted on up to TRAIN_BAGS labelled documents of each class (chosen by a hash), whole texts, in the driver; that bound is
what the driver holds and what is broadcast is BUCKETS weights. Scoring covers every row and is map-only.

Nulls: a null or blank text has no sentences and scores 0. Null labels and ids do not train. Without both classes in the
training rows every score is 0. Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropcube.llm import kernels as K
from cropcube.session import ship

BUCKET_BITS = 18
TRAIN_BAGS = 2000
FOLDS = 5
#: Bytes of the beginnings of a word that are features beside the word.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: A feature trains if it is in so many training documents.
LEAST_DOCS = 4
#: Standard errors by which a feature's log-odds of toxic documents must exceed 0 to train.
SURE = 2.0
BIAS = -6.0
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


#: Sets the features of each length apart.
SALTS = np.random.default_rng(11).integers(0, 1 << 63, 1 + len(PREFIXES), dtype=np.uint64) << np.uint64(1)


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Buckets of each word (a row): the word, then its beginnings; bucket 0 stands for none."""
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.int32)
    if not len(starts):
        return out
    shift = np.uint64(64 - BUCKET_BITS)
    for col, n in enumerate((0, *PREFIXES)):
        at = np.arange(len(starts)) if n == 0 else np.flatnonzero(ends - starts > n)
        h = K.span_hashes(raw, starts[at], ends[at] if n == 0 else starts[at] + n)
        out[at, col] = np.maximum(1, (h ^ SALTS[col]) >> shift)
    return out


def sentences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each word, first word of each sentence, first sentence of each text, and each sentence's byte span."""
    starts, ends, first = K.word_bounds(raw, offsets, K.ALNUM)
    n = len(starts)
    bucket = features(raw, starts, ends)
    new = np.zeros(n, bool)
    if n:
        marks = np.concatenate([[0], np.cumsum(ENDS[raw])])
        new[1:] = marks[starts[1:]] > marks[ends[:-1]]
        new[first[:-1][first[:-1] < n]] = True
    begin = np.flatnonzero(new)
    per_text = np.searchsorted(begin, first)
    last = np.concatenate([begin[1:], [n]]) - 1 if len(begin) else begin
    return bucket, begin, per_text, starts[begin], ends[last] if len(begin) else begin


def segment_sum(values: np.ndarray, first: np.ndarray, total: int) -> np.ndarray:
    """Sums of runs that begin at ``first`` (runs may be empty at the end)."""
    s = np.concatenate([[0.0], np.cumsum(values)])
    edge = np.concatenate([first, [total]])
    return s[edge[1:]] - s[edge[:-1]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_logits(self, bucket: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self.bias + segment_sum(self.weights[bucket].sum(axis=1), begin, len(bucket))

    def score(self, logits: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Noisy-or of each text's sentences: 1 - exp(-sum of softplus)."""
        soft = np.logaddexp(0, logits)
        return -np.expm1(-segment_sum(soft, per_text[:-1], per_text[-1]))


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.1, decay: float = 1e-3, seed: int = 3) -> Model:
    """Gradient steps (scaled by each weight's past gradients) on the bags' log-likelihood.

    ``bags``: features of the words, first word of each sentence, label. For a bag of probability P a sentence's
    gradient is p (1 - y / P).
    """
    size = 1 << BUCKET_BITS
    labels = np.array([y for _, _, y in bags])
    model = Model(np.zeros(size), BIAS)
    if not len(bags) or labels.min() == labels.max():
        model.bias = -np.inf
        return model
    df = np.zeros(size, np.int64)
    toxic = np.zeros(size, np.int64)
    for b, _, y in bags:
        u = np.unique(b)
        df[u] += 1
        toxic[u] += y
    pos = labels.sum()
    odds = np.log((toxic + 0.5) / (pos + 1)) - np.log((df - toxic + 0.5) / (len(labels) - pos + 1))
    sure = odds - SURE * np.sqrt(1 / (toxic + 0.5) + 1 / (df - toxic + 0.5))
    known = (df >= LEAST_DOCS) & (sure > 0)  # others would only remember single documents
    known[0] = False
    model.weights[known] = np.minimum(sure[known], 4)
    past = np.full(size, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), 64):
            part = [bags[k] for k in order[i : i + 64]]
            bucket = np.concatenate([b for b, _, _ in part])
            at = np.cumsum([0, *(len(b) for b, _, _ in part)])
            begin = np.concatenate([s + a for (_, s, _), a in zip(part, at[:-1], strict=True)]).astype(np.int64)
            per = np.cumsum([0, *(len(s) for _, s, _ in part)])
            y = np.array([v for _, _, v in part], float)
            z = model.sentence_logits(bucket, begin)
            whole = np.maximum(model.score(z, per), 1e-9)
            count = np.diff(per)
            grad = sigmoid(z) * np.repeat(1 - y / whole, count)
            words = np.repeat(grad, np.diff(np.concatenate([begin, [len(bucket)]])))
            u, inverse = np.unique(bucket, return_inverse=True)
            g = np.bincount(inverse.ravel(), np.repeat(words, bucket.shape[1]), len(u)) * known[u] + decay * model.weights[u]
            past[u] += g * g
            model.weights[u] -= rate * g / np.sqrt(past[u])
    return model


def fold_of(id_: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.crc32(id_.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bags: int = TRAIN_BAGS) -> Model:
    named = labels.select(F.col(id_col).alias("cc_id"), F.col(label_col).alias("cc_y")).where("cc_id IS NOT NULL AND cc_y IN (0, 1)")
    named = named.where(fold_of(F.col("cc_id")) != 0).groupBy("cc_id").agg(F.min("cc_y").alias("cc_y"))
    pick = lambda y: named.where(F.col("cc_y") == y).orderBy(F.xxhash64("cc_id"), "cc_id").limit(bags)
    chosen = pick(0).union(pick(1))
    told = docs.select(F.col(id_col).alias("cc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "cc_id")

    def cut(batches):
        for batch in batches:
            raw, offsets = K.texts_of(batch.column(batch.schema.get_field_index("text")))
            keep = [x for x in range(batch.num_columns) if batch.schema.field(x).name != "text"]
            ids, ys = (batch.column(x) for x in keep)
            words, begins = [], []
            for i, j in K.groups(offsets):
                bucket, begin, per, _, _ = sentences(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                edge = np.concatenate([begin, [len(bucket)]])
                for d in range(j - i):
                    a, b = per[d], per[d + 1]
                    words.append(bucket[edge[a] : edge[b]].tobytes())
                    begins.append((begin[a:b] - edge[a]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), ys.cast(pa.int32()), pa.array(words, pa.binary()), pa.array(begins, pa.binary())], ["id", "y", "words", "begins"])

    rows = told.select("cc_id", "cc_y", "text").mapInArrow(cut, "id string, y int, words binary, begins binary").collect()
    rows.sort(key=lambda r: (r.id, bytes(r.words)))  # the order of rows must not matter
    return fit([(np.frombuffer(bytes(r.words), np.int32).reshape(-1, 1 + len(PREFIXES)), np.frombuffer(bytes(r.begins), np.int32).astype(np.int64), r.y) for r in rows if len(r.words)])


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, spans: bool = True, least: float = 0.5) -> DataFrame:
    """``docs``' columns ``keep`` (all if None), ``score``, ``predicted`` and, if ``spans``, ``offending``: byte spans and scores of sentences from ``least`` on."""
    ship(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    added = "score double, predicted int" + ", offending array<struct<start: long, end: long, score: double>>" * spans
    added = T.StructType.fromDDL(added).fields
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in added}]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        m = Model(told.value[0].astype(np.float64), told.value[1])
        for batch in batches:
            raw, offsets = K.texts_of(batch.column(batch.schema.get_field_index(text_col)))
            out = np.zeros(len(offsets) - 1)
            where: list[list[dict]] = [[] for _ in range(len(out))] if spans else []
            for i, j in K.groups(offsets):
                base = offsets[i : j + 1] - offsets[i]
                bucket, begin, per, a, b = sentences(raw[offsets[i] : offsets[j]], base)
                if not len(begin):
                    continue
                z = m.sentence_logits(bucket, begin)
                out[i:j] = m.score(z, per)
                if spans:
                    p = sigmoid(z)
                    for s in np.flatnonzero(p >= least).tolist():
                        d = int(np.searchsorted(per, s, "right")) - 1
                        where[i + d].append({"start": int(a[s] - base[d]), "end": int(b[s] - base[d]), "score": float(p[s])})
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(out), pa.array((out >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(where, kind)] * spans, [*keep, *(f.name for f in added)])

    carried = docs.select(*dict.fromkeys([*keep, text_col]))
    return carried.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + added))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """``score``'s rows under a model of ``train``.

    A null or blank text has no sentence and the score 0; texts of any length are scored whole, repeated rows alike. Labels of null ids
    or other values than 0 and 1 are left out; an id with both labels counts as 0. Without labels of both kinds all scores are 0. A
    score of 0.5 is predicted as 1. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    return score(docs, train(docs, labels, id_col, text_col, label_col), text_col, keep, spans)
