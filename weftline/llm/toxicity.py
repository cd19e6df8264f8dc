"""Toxicity by a factorization machine over hashed terms.

A text's features are the distinct terms it holds, hashed to buckets; of those that enough sampled texts hold, the ones
that tell most of the label are kept, alone or in a pair. Beside a weight, each bucket has a short vector, and the product of two buckets' vectors is the weight of
their meeting in one text: what neither term tells alone, such as an insult where a group is named, the pair can.
The machine is fitted by mini-batch gradient descent on a bounded sample of labelled documents, in one task.

Edge cases: a null or empty text has no terms and gets the score of the bias, the share of toxic documents learned;
rows with a null label or key teach nothing; without labelled rows every score is 0; repeated rows are scored alike;
an empty table gives an empty result; input columns named like an output column are replaced. Texts are read whole,
a million characters at a time; a score is made from distinct buckets, so memory does not follow the length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, small_slices, text_column, texts_of, without

BUCKETS = 1 << 18
#: Letters of a word's beginning, which is a term too, so that inflected and compound forms share one.
STEM = 5
#: Labelled documents used at most, those whose keys hash lowest.
SAMPLE = 8_000
FACTORS, EPOCHS, BATCH, RATE = 6, 60, 64, 0.1
#: Strength of the pull of weights and vectors to zero.
DECAY_WEIGHT, DECAY_VECTOR = 2e-3, 4e-3
#: Sampled texts in which a bucket must occur, and how many buckets of the strongest association are kept.
LEAST_TEXTS, FEATURES = 4, 1000
#: Buckets that vary most, whose pairs are tried; pairs kept, and what their chi square must have over that of either part.
VARIED, PAIRS, GAIN = 1024, 200, 30.0
_TERM = re.compile(r"\w+")
_CHUNK = 1 << 20
_known: dict[str, tuple[int, int]] = {}


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    place: np.ndarray  # bucket -> row of weights and vectors, or -1


def terms(text: str) -> np.ndarray:
    """The sorted distinct buckets of a text's terms: its words in lower case, and their beginnings."""
    found: set[str] = set()
    at = 0
    while at < len(text):
        end = at + _CHUNK
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):
            end += 1
        found.update(_TERM.findall(text[at:end].lower()))
        at = end
    buckets: set[int] = set()
    for word in found:
        pair = _known.get(word)
        if pair is None:
            if len(_known) > 200_000:
                _known.clear()
            stem = word[:STEM] + "*"
            _known[word] = pair = tuple(crc32(x.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for x in (word, stem))
        buckets.update(pair)
    return np.array(sorted(buckets), np.int64)


def raw_score(model: ToxicityModel, buckets: np.ndarray) -> float:
    rows = model.place[buckets]
    rows = rows[rows >= 0]
    # Pairs are divided by the number of terms, so that a long text's many pairs don't outweigh its terms.
    v = model.vectors[rows].astype(np.float64)
    s = v.sum(0)
    pairs = 0.5 * float((s * s - (v * v).sum(0)).sum()) / max(len(rows), 1)
    return model.bias + float(model.weights[rows].astype(np.float64).sum()) + pairs


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _chi(both: np.ndarray, seen: np.ndarray, positive: int, n: int) -> np.ndarray:
    """Chi square of presence in ``seen`` of ``n`` texts, ``both`` of them among the ``positive`` ones; 0 for what is rare."""
    share = positive / max(n, 1)
    expected = seen * share
    spread = expected * (1 - share) * (1 - seen / max(n, 1))
    return np.where((seen >= LEAST_TEXTS) & (spread > 0), (both - expected) ** 2 / np.maximum(spread, 1e-9), 0)


def _associated(texts: list[np.ndarray], labels: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The buckets whose presence is most associated with the label, and those of pairs that are so beyond their parts."""
    toxic = [t for t, y in zip(texts, labels) if y > 0.5]
    n, positive = len(texts), len(toxic)
    both = np.bincount(np.concatenate(toxic) if toxic else np.zeros(0, int), minlength=BUCKETS)
    chi = _chi(both, seen, positive, n)
    kept = np.lexsort((np.arange(BUCKETS), -chi))[:FEATURES]
    kept = kept[chi[kept] > 0]
    # Terms that tell something together only: the label against the presence of both, among the terms that vary most.
    vary = np.where(seen >= LEAST_TEXTS, seen * (n - seen), 0)
    some = np.lexsort((np.arange(BUCKETS), -vary))[:VARIED]
    some = some[vary[some] > 0]
    at = np.full(BUCKETS, -1)
    at[some] = np.arange(len(some))
    seen_both, toxic_both = np.zeros((len(some), len(some)), np.float32), np.zeros((len(some), len(some)), np.float32)
    for start in range(0, n, 1024):
        has = np.zeros((min(1024, n - start), len(some)), np.float32)
        for i, t in enumerate(texts[start : start + 1024]):
            found = at[t]
            has[i, found[found >= 0]] = 1
        seen_both += has.T @ has
        of = has[labels[start : start + 1024] > 0.5]
        toxic_both += of.T @ of
    gain = np.triu(_chi(toxic_both, seen_both, positive, n) - np.maximum(chi[some][:, None], chi[some][None, :]), 1)
    best = np.argsort(-gain, axis=None, kind="stable")[:PAIRS]
    i, j = np.unravel_index(best, gain.shape)
    far = gain[i, j] > GAIN
    return np.unique(np.concatenate((kept, some[i[far]], some[j[far]])))


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> ToxicityModel:
    """A machine fitted to texts given as buckets."""
    seen = np.bincount(np.concatenate(texts) if texts else np.zeros(0, int), minlength=BUCKETS)
    used = _associated(texts, labels, seen)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    rows = [place[t] for t in texts]
    rows = [r[r >= 0] for r in rows]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(used)), rng.normal(0, 0.05, (len(used), FACTORS))
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    bias = base = float(np.log(share / (1 - share)))
    gw, gv = np.full(len(used), 1e-2), np.full((len(used), FACTORS), 1e-2)  # squared gradients so far
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            sizes = np.array([len(rows[i]) for i in batch])
            flat = np.concatenate([rows[i] for i in batch])
            if not len(flat):
                continue
            owner = np.repeat(np.arange(len(batch)), sizes)
            share_of = 1 / np.maximum(sizes, 1)
            vf = v[flat]
            s = np.stack([np.bincount(owner, vf[:, f], len(batch)) for f in range(FACTORS)], 1)
            squares = np.bincount(owner, (vf * vf).sum(1), len(batch))
            out = bias + np.bincount(owner, w[flat], len(batch)) + 0.5 * ((s * s).sum(1) - squares) * share_of
            error = (_sigmoid(out) - labels[batch]) / len(batch)
            bias -= RATE * float(error.sum())
            hit, back = np.unique(flat, return_inverse=True)
            dw = np.bincount(back, error[owner], len(hit)) + DECAY_WEIGHT * w[hit] / len(batch)
            pull = (error * share_of)[owner][:, None] * (s[owner] - vf)
            dv = np.stack([np.bincount(back, pull[:, f], len(hit)) for f in range(FACTORS)], 1) + DECAY_VECTOR * v[hit] / len(batch)
            gw[hit] += dw * dw
            gv[hit] += dv * dv
            w[hit] -= RATE * dw / np.sqrt(gw[hit])
            v[hit] -= RATE * dv / np.sqrt(gv[hit])
    return ToxicityModel(bias if len(used) else base, w.astype(np.float32), v.astype(np.float32), place)


def _eligible(sample: DataFrame) -> np.ndarray:
    """The buckets of (label, terms) rows that ``train`` can choose: no more than FEATURES and VARIED together."""
    n, positive = sample.agg(F.count("*"), F.sum((F.col("label") > 0.5).cast("long"))).first()
    each = sample.select(F.explode("terms").alias("bucket"), (F.col("label") > 0.5).cast("long").alias("toxic"))
    each = cut(each.groupBy("bucket").agg(F.count("*").alias("seen"), F.sum("toxic").alias("both")).where(F.col("seen") >= LEAST_TEXTS))
    share = F.lit((positive or 0) / max(n, 1))
    off = F.col("both") - F.col("seen") * share
    spread = F.col("seen") * share * (1 - share) * (1 - F.col("seen") / F.lit(max(n, 1)))
    strong = each.withColumn("by", F.coalesce(F.try_divide(off * off, spread), F.lit(0.0)))
    varied = each.withColumn("by", F.col("seen") * (n - F.col("seen")))
    rows = [r.bucket for table, most in ((strong, FEATURES), (varied, VARIED)) for r in table.orderBy(F.desc("by"), "bucket").limit(most).collect()]
    return np.unique(np.array(rows, np.int64))


def fit_toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> ToxicityModel | None:
    """A machine learned from at most SAMPLE documents of ``df`` that ``labels`` marks; None without any."""
    marked = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).select(F.col(key).alias("__key"), F.col(toxic).cast("double").alias("label"))
    marked = marked.groupBy("__key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("__key"), "__key").limit(SAMPLE)
    docs = df.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__h"), F.col(text).alias("__text")).join(F.broadcast(cut(marked)), "__key")
    # A key may have many rows: of those with one text one is taken, and the bound holds for all that are left.
    picked = docs.groupBy("__key", "__h").agg(F.first("label").alias("label")).orderBy(F.xxhash64("__key", "__h"), "__key", "__h").limit(SAMPLE)
    docs = docs.drop("label").join(F.broadcast(cut(picked)), ["__key", "__h"]).groupBy("__key", "__h", "label").agg(F.first("__text").alias("__text"))
    bound_batches(df.sparkSession)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "__text"):
            found = [terms(t) for t in texts_of(batch, "__text")]
            yield pa.RecordBatch.from_arrays([batch.column("__key").cast(pa.string()), batch.column("label"), pa.array(found, pa.list_(pa.int64()))], ["key", "label", "terms"])

    sample = cut(docs.select("__key", "label", "__text").mapInArrow(featurise, "key string, label double, terms array<bigint>"))
    eligible = df.sparkSession.sparkContext.broadcast(_eligible(sample))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.intersect1d(t.values.to_numpy(), eligible.value) for t in batch.column("terms")]
            yield batch.set_column(2, "terms", pa.array(found, pa.list_(pa.int64())))

    sample = sample.mapInArrow(narrow, sample.schema)

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(order=[tuple(t) for t in part["terms"]]).sort_values(["key", "order"])
        model = train([np.asarray(t, np.int64) for t in part["terms"]], part["label"].to_numpy())
        used = np.nonzero(model.place >= 0)[0]
        return pd.DataFrame({"bias": [model.bias], "used": [used.tolist()], "w": [model.weights.tolist()], "v": [model.vectors.ravel().tolist()]})

    rows = sample.groupBy().applyInPandas(learn, "bias double, used array<bigint>, w array<float>, v array<float>").collect()
    if not rows:
        return None
    r = rows[0]
    place = np.full(BUCKETS, -1, np.int32)
    place[np.array(r.used, int)] = np.arange(len(r.used))
    return ToxicityModel(r.bias, np.array(r.w, np.float32), np.array(r.v, np.float32).reshape(-1, FACTORS), place)


def score_toxicity(df: DataFrame, model: ToxicityModel | None, text: str = "text") -> DataFrame:
    """``df`` with the probability of a toxic label as ``score``."""
    df = without(df, "score")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def scores(texts: list[str | None]) -> pa.Array:
        known = sent.value
        return pa.array([float(_sigmoid(raw_score(known, terms(t or "")))) if known else 0.0 for t in texts], pa.float64())

    return df.withColumn("score", text_column(df.sparkSession, "double", lambda: scores)(text))
