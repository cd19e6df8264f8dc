"""Quality rules and a hashed n-gram likelihood ratio, with DataFrame functions only.

Words and pairs of neighbouring words are hashed to buckets. A multinomial over the buckets of trusted documents and
one over those of all documents give each bucket a log ratio; a document's score is the mean over its n-grams, and
documents below a fixed threshold are rejected. The ratios are whole numbers of millionths, so sums don't depend on
their order and every run decides alike.

Every document is read by itself: its words, repeated windows and lines are found inside its row, and nothing is
shuffled but bucket counts that each task has summed. Repeated windows are told by 64-bit hashes of their words.

Edge cases: a null text has no words; a text with fewer than MIN_WORDS words fails the rules; rows are judged one
by one, so null keys and repeated rows are judged alike; without trusted documents every score is 0, so only the
rules reject; an empty table gives an empty result; input columns named
like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Buckets of single words, and as many again of pairs.
BUCKETS = 1 << 14
UNIT = 1_000_000
#: Trusted labels used at most, those whose keys hash lowest.
TRUSTED = 20_000
#: Least mean log ratio, in millionths, of a document that is kept.
THRESHOLD = -200_000
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(_SPACE))
    return F.when(inner != "", F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(h: Column) -> Column:
    """Buckets of the words, then of the pairs."""
    mask = F.lit(BUCKETS - 1)
    single = F.transform(h, lambda a: a.bitwiseAND(mask))
    pairs = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: a.bitwiseXOR(F.shiftrightunsigned(b, 7)).bitwiseAND(mask) + BUCKETS)
    return F.concat(single, F.slice(pairs, 1, F.greatest(F.size(h) - 1, F.lit(0))))


def _spans(h: Column, length: int) -> Column:
    """Hash of the ``length`` (a power of two) elements from each place on, made of two hashes of half the length.

    The last places lack elements. An array is sliced once a doubling, not once a place, so the work follows its size.
    """
    def pair(a: Column, step: int) -> Column:
        return F.zip_with(a, F.slice(a, step + 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y))

    return pair(h, 1) if length == 2 else _let(_spans(h, length // 2), lambda half: pair(half, length // 2))


def _repeated(h: Column) -> Column:
    """Number of words in windows that the text holds more than once."""
    n = F.size(h)
    windows = F.slice(_spans(h, WINDOW), 1, n - (WINDOW - 1))

    def count(found: Column) -> Column:
        placed = F.array_sort(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        again = _let(placed, lambda s: F.filter(s, lambda e, k: (
            (F.get(s, k - 1)["x"].eqNullSafe(e["x"])) | (F.get(s, k + 1)["x"].eqNullSafe(e["x"])))))
        places = F.array_sort(F.transform(again, lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    some = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), count(w)).otherwise(F.lit(0)))
    return F.when(n >= WINDOW, some).otherwise(F.lit(0)).cast("long")


def base_rules(text: Column) -> dict[str, Column]:
    """Counts that need no words array."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    return {
        "word_chars": F.char_length(F.translate(text, _SPACE, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def trusted_keys(labels: DataFrame, key: str = "doc_id", quality: str = "quality", most: int = TRUSTED) -> DataFrame:
    """Up to ``most`` keys of rows labelled 1: a bounded, repeatable sample."""
    good = labels.where((F.col(quality) == 1) & F.col(key).isNotNull()).select(F.col(key).alias("__trusted"))
    return good.orderBy(F.xxhash64("__trusted"), "__trusted").limit(most).distinct()


def bucket_counts(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, target, raw): n-grams in trusted and in all documents. ``trusted`` is bounded, so it is broadcast."""
    docs = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    docs = docs.join(F.broadcast(trusted), F.col("__key") == F.col("__trusted"), "left")
    grams = _let(_hashes(_words(F.coalesce("__text", F.lit("")))), _grams)
    each = docs.select(F.col("__trusted").isNotNull().cast("long").alias("good"), F.explode(grams).alias("bucket"))
    return each.groupBy("bucket").agg(F.sum("good").alias("target"), F.count("*").alias("raw"))


def log_ratios(counts: DataFrame, buckets: int = 2 * BUCKETS) -> list[int]:
    """The ratio of each bucket, with one count added to each bucket of either multinomial; 0 without trusted ones.

    Words and pairs are one multinomial each. The counts are at most ``buckets`` rows, whatever the corpus holds.
    """
    half = (F.col("bucket") >= buckets // 2).alias("half")
    sums = counts.groupBy(half).agg(F.sum("target").alias("all_target"), F.sum("raw").alias("all_raw"))
    every = counts.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    full = every.join(counts, "bucket", "left").withColumn("half", half).join(sums, "half", "left")
    # Target counts are scaled to the raw total first, so the added count weighs alike in both.
    scaled = F.coalesce("target", F.lit(0)) * (F.col("all_raw") / F.col("all_target"))
    ratio = F.when(F.col("all_target") > 0, F.log((scaled + 1) / (F.coalesce("raw", F.lit(0)) + 1))).otherwise(0.0)
    ratio = F.round(ratio * UNIT).cast("long").alias("ratio")
    return [r.ratio for r in full.select("bucket", ratio).orderBy("bucket").collect()]


def _table(ratios: list[int]) -> Column:
    """The ratios as a constant array, which the optimizer folds once."""
    return F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")


def judge(df: DataFrame, ratios: list[int], text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``df`` with the rules' counts, base_failed, score (mean log ratio; null without words) and kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    keep = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    model = _table(ratios)

    def measured(h: Column) -> Column:
        total = F.aggregate(_grams(h), F.lit(0).cast("long"), lambda acc, g: acc + F.get(model, g.cast("int")))
        return F.struct(F.size(h).cast("long").alias("n_words"), _repeated(h).alias("n_repeat_words"), total.alias("total"))

    found = _let(_hashes(_words(F.coalesce(F.col(text), F.lit("")))), measured)
    rules = base_rules(F.col(text))
    out = df.select(*keep, found.alias("__m"), *[c.alias(f"__{n}") for n, c in rules.items()])
    n, again = F.col("__m.n_words"), F.col("__m.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * again > REPEAT_PERCENT * n)
    grams = 2 * n - 1
    passed = F.col("__m.total") >= threshold * grams
    values = {
        "n_words": n, **{c: F.col(f"__{c}") for c in rules}, "n_repeat_words": again, "base_failed": failed,
        "score": F.when(n > 0, F.col("__m.total") / (grams * F.lit(float(UNIT)))), "kept": ~failed & passed,
    }
    return out.select(*keep, *[values[c].alias(c) for c in names])


def quality_rules(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, trusted: int = TRUSTED
) -> DataFrame:
    """``df`` judged against the documents that ``labels`` trusts and against all documents."""
    counts = cut(bucket_counts(df, trusted_keys(labels, key, most=trusted), key, text))
    return judge(df, log_ratios(counts), text, threshold)
