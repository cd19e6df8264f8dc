"""Language identification by nearest centroid.

A text is lower-cased, everything but letters becomes a single blank, and its characters, pairs and triples are
hashed to a normalised TF-IDF vector. Each language has several centroids, found by spherical k-means over a bounded
sample of labelled documents; the nearest one by cosine names the language. Texts are rejected that are hardly nearer to
any centroid than documents of like length are to those of other languages, and farther than nearly all are from their own.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; equal cosines go to the
language first in code point order; rows with a null label or key teach nothing; without labelled rows every text is
``und``; repeated rows are read alike; an empty table gives an empty result; input columns named like an output column
are replaced. Texts are read whole, a million characters at a time. Of rows with one key, language and text one is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, small_slices, text_column, texts_of, without

DIMENSIONS = 1 << 12
#: Labelled documents used for one language, and for all of them together.
SAMPLE, SAMPLE_ALL = 400, 20_000
CENTROIDS, ROUNDS = 4, 12
#: Languages from which on nothing is learned and an error says so: their centroids are held by the driver and each task.
LANGUAGES = 1000
#: The floor of a length class: the quantile of its sampled documents that MARGIN lowers, and how far ABOVE the others it may lie.
QUANTILE, MARGIN, ABOVE = 0.01, 0.85, 1.1
UNKNOWN = "und"
_CHUNK = 1 << 20
_CLASSES = 24


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floors: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str) -> tuple[np.ndarray, int]:
    """Hashed counts of the character n-grams, and the number of letters."""
    total, letters = np.zeros(DIMENSIONS, np.int64), 0
    text = text.lower()
    tail = np.array([32], np.uint32)  # the last two characters so far
    for at in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[at : at + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _letters()[codes]
        letters += int(is_letter.sum())
        codes = np.where(is_letter, codes, np.uint32(32))
        blank = codes == 32
        codes = codes[~(blank & np.concatenate((tail[-1:] == 32, blank[:-1])))]
        run = np.concatenate((tail, codes))
        if at + _CHUNK >= len(text) and len(run) > 1 and run[-1] != 32:
            run = np.concatenate((run, np.array([32], np.uint32)))
        one = run * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + run[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + run[2:]
        old = len(tail) if at else 0
        for hashed in (one[old:], two[max(old - 1, 0) :] * np.uint32(0x9E3779B1), three[max(old - 2, 0) :] * np.uint32(0x9E3779B1)):
            total += np.bincount(hashed >> np.uint32(20), minlength=DIMENSIONS)
        tail = run[-2:]
    return total, letters


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0).astype(np.float32) * idf)


def _length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), _CLASSES - 1)


def _cluster(vectors: np.ndarray, k: int = CENTROIDS) -> np.ndarray:
    """Spherical k-means, started from the mean and then the vector farthest from all centroids so far."""
    found = _unit(vectors.mean(0, keepdims=True))
    while len(found) < min(k, len(vectors)):
        found = np.vstack((found, vectors[[int((vectors @ found.T).max(1).argmin())]]))
    for _ in range(ROUNDS):
        nearest = (vectors @ found.T).argmax(1)
        found = np.vstack([_unit(vectors[nearest == i].mean(0, keepdims=True)) if (nearest == i).any() else found[[i]] for i in range(len(found))])
    return found


def _sampled(df: DataFrame, key: str, lang: str, text: str = "text") -> DataFrame:
    """(__key, __lang, __h) of a bounded sample of different texts: for each language the rows that hash lowest.

    A language is thinned by its share before its rows are ranked, so no task ranks a whole language.
    """
    slim = df.where(F.col(key).isNotNull() & F.col(lang).isNotNull())
    slim = slim.select(F.col(key).alias("__key"), F.col(lang).alias("__lang"), F.xxhash64(text).alias("__h"))
    lot = F.xxhash64("__key", "__h")
    sizes = slim.groupBy("__lang").agg(F.approx_count_distinct(lot).alias("n"))
    sizes = cut(sizes)
    if (n := sizes.count()) > LANGUAGES:
        raise ValueError(f"{n} languages; {LANGUAGES} can be learned, and none is left out")
    each = max(1, min(SAMPLE, SAMPLE_ALL // max(1, sizes.count())))
    place = F.pmod(lot, F.lit(1 << 30)) / float(1 << 30)
    thin = slim.join(F.broadcast(sizes), "__lang").where(place * F.col("n") < 2 * each + 20).select("__key", "__lang", "__h").distinct()
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy(lot, "__key", "__h"))
    return thin.withColumn("r", rank).where(F.col("r") <= each).select("__key", "__lang", "__h")


def fit_languages(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model of the languages of ``df``, from at most SAMPLE documents of each."""
    picked = F.broadcast(cut(_sampled(df, key, lang, text)))
    docs = df.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__h"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    docs = docs.join(picked, ["__key", "__lang", "__h"], "left_semi").groupBy("__key", "__lang", "__h").agg(F.first("__text").alias("__text"))
    bound_batches(df.sparkSession)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "__text"):
            rows = [(name, *counts(t)) for name, t in zip(batch.column("__lang").to_pylist(), texts_of(batch, "__text"))]
            rows = [(name, tf, n) for name, tf, n in rows if n]
            yield pa.RecordBatch.from_arrays([
                pa.array([name for name, _, _ in rows], pa.string()), pa.array([n for _, _, n in rows], pa.int64()),
                pa.array([np.nonzero(tf)[0] for _, tf, _ in rows], pa.list_(pa.int32())),
                pa.array([tf[tf > 0] for _, tf, _ in rows], pa.list_(pa.int64())),
            ], ["lang", "letters", "dims", "tf"])

    sample = cut(docs.select("__lang", "__text").mapInArrow(featurise, "lang string, letters long, dims array<int>, tf array<bigint>"))
    seen = np.zeros(DIMENSIONS)
    for r in sample.select(F.explode("dims").alias("d")).groupBy("d").count().collect():  # DIMENSIONS rows at most
        seen[r.d] = r["count"]
    total = sample.count()
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    def vectors(part: pd.DataFrame) -> np.ndarray:
        tf = np.zeros((len(part), DIMENSIONS), np.float32)
        for i, (d, n) in enumerate(zip(part["dims"], part["tf"])):
            tf[i, d] = n
        return _vectors(tf, idf)

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(order=[tuple(d) for d in part["dims"]]).sort_values(["letters", "order"])
        found = _cluster(vectors(part))
        return pd.DataFrame({"lang": part["lang"].iat[0], "values": found.tolist()})

    rows = sample.groupBy("lang").applyInPandas(learn, "lang string, values array<double>").collect()  # LANGUAGES * CENTROIDS at most
    languages = sorted({r.lang for r in rows})
    found = sorted(((languages.index(r.lang), r["values"]) for r in rows))
    centroids = np.array([v for _, v in found], np.float32).reshape(-1, DIMENSIONS)
    owner = np.array([i for i, _ in found], int)
    sent = df.sparkSession.sparkContext.broadcast((languages, centroids, owner))

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, known, of = sent.value
        for part in parts:
            for at in range(0, len(part), 256):
                some = part.iloc[at : at + 256]
                near = vectors(some) @ known.T
                mine = np.array([names.index(x) for x in some["lang"]])[:, None] == of[None, :]
                yield pd.DataFrame({
                    "letters": some["letters"], "own": np.where(mine, near, -1).max(1).astype(float), "other": np.where(mine, -1, near).max(1).astype(float)})

    told = sample.mapInPandas(measure, "letters long, own double, other double").collect() if len(found) else []  # SAMPLE_ALL at most
    return LanguageModel(languages, idf, centroids, owner, _floors([tuple(r) for r in told]))


def _floors(told: list[tuple[int, float, float]]) -> np.ndarray:
    """Least cosine of each length class, from (letters, cosine with the own language, with the nearest other one).

    A language that was not learned is like the others to a sampled one: the floor lies ABOVE their median, but at most at
    MARGIN times what nearly all texts reach in their own language. A class takes what shorter ones have where it has no sample.
    """
    floors, last = np.zeros(_CLASSES), 0.0
    values = np.array(told, float).reshape(-1, 3)
    classes = _length_class(values[:, 0])
    for c in range(_CLASSES):
        own, other = values[classes == c, 1], values[classes == c, 2]
        if len(own) >= 5:
            last = float(np.quantile(own, QUANTILE)) * MARGIN
            if other.max() >= 0:
                last = min(last, float(np.median(other)) * ABOVE)
        floors[c] = last
    return floors


def identify(model: LanguageModel, texts: list[str]) -> list[tuple[str, float, bool]]:
    """(language, cosine, rejected) of each text."""
    if not len(model.centroids):
        return [(UNKNOWN, 0.0, True)] * len(texts)
    out = []
    for at in range(0, len(texts), 256):
        measured = [counts(t) for t in texts[at : at + 256]]
        letters = np.array([n for _, n in measured])
        near = _vectors(np.array([tf for tf, _ in measured]), model.idf) @ model.centroids.T
        best = near.argmax(1)
        score = np.clip(near[np.arange(len(best)), best].astype(float), 0.0, 1.0)
        far = score < model.floors[_length_class(letters)]
        for i, n in enumerate(letters):
            out.append((model.languages[model.owner[best[i]]], float(score[i]), bool(far[i])) if n else (UNKNOWN, 0.0, True))
    return out


def predict_languages(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and rejected."""
    df = without(df, "lang_pred", "score", "rejected")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def told(texts: list[str | None]) -> pa.StructArray:
        found = identify(sent.value, [t or "" for t in texts])
        columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "rejected"])

    tell = text_column(df.sparkSession, "struct<lang_pred:string,score:double,rejected:boolean>", lambda: told)
    return df.withColumn("__told", tell(text)).select(*df.columns, "__told.*")


def held_out(key: str, folds: int, fold: int):
    """Whether crc32 of the key as text leaves ``fold`` on division; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))
