"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

1. Targets. The mix's words are shared among sources by weight; a source stops at ``cap`` times its size and the
   excess is shared again by weight. That fill is solved in closed form over one row a source.
2. Expected copies. Within a source a document's expected copies grow with its length class (number of binary
   digits of its size), up to ``cap``; the same fill over (source, class) totals makes them add up to the target.
3. Whole copies are certain. The remaining fraction is a document's inclusion probability p: documents are
   ranked by [u / (1 - u)] / [p / (1 - p)], u a hash of key and size, and the first ones are taken until their words
   reach what is left of the target; the last goes to the nearer side.
4. This goes tier by tier: documents of more than a tenth of their source's target, of more than a hundredth, the
   rest. What a tier takes too much or too little of is for the later ones to make up: the fill over what is still
   to be decided is solved again for the rest of the target. So a source misses its target by less than a hundredth,
   wherever its short documents can make up for the long ones.

The cut of each ranking is found from a histogram of ranks (BUCKETS a source, summed before the shuffle); only the
bucket that holds the cut is ordered. So no task sees a source's documents, the decision about a document is an
expression of its own columns and one row of its source, and texts are never shuffled.

Edge cases: a null text has size 0; documents of size 0 are taken 0 words; null is a source of its own, the last;
null keys are one key; rows with one key and size in a source have one rank, and where the cut falls among them as many
are taken as come nearest to the target, of rows that are otherwise equal no matter which; extra columns are kept, those
named like an output column are replaced; an empty table gives an empty result. Reruns agree, in any partitioning (but for
which of several rows with one key, or without any, and one size are at the cut). One task orders the sources, a row
each, and one the documents of a source in one of BUCKETS buckets of ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, join_lookup, without

WEIGHTS, TOTAL, CAP = (3, 1, 2), 1.5, 2.0
#: Parts of the source's target above which a document belongs to the first, second, ... tier.
TIERS = (0.1, 0.01)
BUCKETS = 1 << 14
_SPACE = " \t\n\x0b\x0c\r"


def word_count(text: str | Column) -> Column:
    """Number of words in a text; null and blank texts have none."""
    inner = F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(_SPACE))
    return F.coalesce(F.when(inner != "", F.size(F.split(inner, r"[\x20\x09-\x0D]+"))), F.lit(0)).cast("long")


def _fill(df: DataFrame, within: list[str], budget: str, weight: str, most: str) -> DataFrame:
    """``df`` with ``level``: least(most, level * weight) adds up to ``budget`` in each group of ``within``.

    Rows fill up in order of most / weight. If the first k are full, the level is what they leave of the budget over
    the weight of the others; it is the right one for the first k at which the next row isn't full, and as more rows
    are taken for full the level only falls from there on.
    """
    order = Window.partitionBy(*within).orderBy(F.col(most) / F.col(weight), weight, most)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    trial = (F.col(budget) - F.coalesce(F.sum(most).over(before), F.lit(0))) / F.sum(weight).over(rest)
    fits = trial * F.col(weight) <= F.col(most)
    group = Window.partitionBy(*within)
    # If no row leaves room, all are full: any level from the largest ratio on does.
    return (
        df.withColumn("__trial", trial).withColumn("__fits", fits)
        .withColumn("level", F.coalesce(F.max(F.when(F.col("__fits"), F.col("__trial"))).over(group), F.max(F.col(most) / F.col(weight)).over(group)))
        .drop("__trial", "__fits")
    )


def source_targets(sizes: DataFrame, source: str, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, class, words) totals."""
    sums = sizes.groupBy(source).agg(F.sum("words").alias("source_size"))
    turn = (F.row_number().over(Window.partitionBy("__all").orderBy(F.col(source).asc_nulls_last())) - 1) % len(weights) + 1
    table = sums.withColumn("__all", F.lit(1)).withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), turn))
    table = table.withColumn("__budget", F.sum("source_size").over(Window.partitionBy("__all")) * F.lit(float(total)))
    filled = _fill(table.withColumn("__most", F.col("source_size") * F.lit(float(cap))), ["__all"], "__budget", "__weight", "__most")
    return filled.select(source, "source_size", F.least("__most", F.col("level") * F.col("__weight")).alias("target"))


def _classes(size: Column) -> Column:
    """Number of binary digits of a size."""
    return F.length(F.bin(size)).cast("int")


def _tier() -> Column:
    tier = F.lit(len(TIERS))
    for i in reversed(range(len(TIERS))):
        tier = F.when(F.col("__words") > F.col("target") * TIERS[i], F.lit(i)).otherwise(tier)
    return tier


def _rank(p: Column) -> Column:
    u = F.col("__u")
    return (u / (1 - u)) / (p / (1 - p))


def _prepared(df: DataFrame, key: str, size: str) -> DataFrame:
    """``df`` with the class, the hash that breaks ties and the random number of each document."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col(size)))
    number = F.conv(F.substring("__h", 1, 13), 16, 10).cast("long")
    return df.withColumn("__class", _classes(F.col(size))).withColumn("__h", digest).withColumn("__u", (number + 0.5) / float(1 << 52))


def _weighed(df: DataFrame, cap: float, level: str = "__level", cut_at: str = "__cut") -> DataFrame:
    """Documents joined to their source's plan, with certain copies, rank and whether they lie before the cut or at it."""
    copies = F.least(F.lit(float(cap)), F.col(level) * F.col("__class"))
    df = df.withColumn("__whole", F.floor(copies)).withColumn("__p", copies - F.floor(copies))
    df = df.withColumn("__q", F.when((F.col("__p") > 0) & (F.col("__words") > 0), _rank(F.col("__p"))))
    if cut_at not in df.columns:
        return df
    q, h = F.col(f"{cut_at}.q"), F.col(f"{cut_at}.h")
    df = df.withColumn("__in", F.coalesce((F.col("__q") < q) | ((F.col("__q") == q) & (F.col("__h") < h)), F.lit(False)))
    return df.withColumn("__at", F.coalesce((F.col("__q") == q) & (F.col("__h") == h), F.lit(False)))


def _cut(docs: DataFrame, room: DataFrame) -> DataFrame:
    """(__src, cut): the rank up to which documents (__src, __q, __h, __words) are taken to fill ``room`` (__src, __room)."""
    bucket = F.floor(F.col("__q") / (1 + F.col("__q")) * BUCKETS).alias("bucket")
    docs = docs.where("__q is not null").select("__src", "__q", "__h", "__words", bucket)
    sums = docs.groupBy("__src", "bucket").agg(F.sum("__words").alias("words"))
    until = F.sum("words").over(Window.partitionBy("__src").orderBy("bucket"))
    over = join_lookup(sums.withColumn("until", until), room, "__src").where(F.col("until") > F.col("__room"))
    edges = over.groupBy("__src").agg(F.min(F.struct("bucket", (F.col("until") - F.col("words")).alias("below"), "__room")).alias("edge"))
    edges = cut(edges)
    edge = join_lookup(docs, edges, "__src").where(F.col("bucket") == F.col("edge.bucket"))
    # Documents of one rank have one size; they are one step, of which as many are taken as come nearest to the room.
    steps = edge.groupBy("__src", "__q", "__h").agg(F.count("*").alias("n"), F.first("__words").alias("each"), F.first("edge").alias("edge"))
    earlier = Window.partitionBy("__src").orderBy("__q", "__h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("edge.below") + F.coalesce(F.sum(F.col("n") * F.col("each")).over(earlier), F.lit(0))
    room = F.floor((F.col("edge.__room") - before) / F.col("each") + 0.5)
    steps = steps.withColumn("take", F.greatest(F.lit(0), F.least(F.col("n"), room)).cast("long"))
    last = F.max(F.when(F.col("take") > 0, F.struct(F.col("__q").alias("q"), F.col("__h").alias("h"), F.col("take").alias("some"), F.col("n"))))
    cuts = steps.groupBy("__src").agg(last.alias("at"), F.min("__q").alias("low"))
    # If the edge bucket takes nothing, the cut lies just below its first document.
    return cuts.select("__src", F.coalesce("at", _nowhere(F.col("low"))).alias("cut"))


def _nowhere(q: Column) -> Column:
    """A cut below ``q`` at which no document lies."""
    return F.struct(q.alias("q"), F.lit("").alias("h"), F.lit(0).cast("long").alias("some"), F.lit(0).cast("long").alias("n"))


def _plus(plan: DataFrame, more: DataFrame) -> DataFrame:
    """``plan`` with the columns of ``more``; both have one row a source."""
    other = more.withColumnRenamed("__src", "__of")
    return plan.join(other, F.col("__src").eqNullSafe(F.col("__of")), "left").drop("__of")


def _plan_tier(plan: DataFrame, slim: DataFrame, sums: DataFrame, tier: int, cap: float) -> DataFrame:
    """``plan`` with level, cut and taken words of a tier, what was still to be taken being in ``__rest``."""
    classes = _plus(sums.where((F.col("words") > 0) & (F.col("__tier") >= tier)), plan.select("__src", "__rest"))
    classes = classes.withColumn("__weight", F.col("words") * F.col("__class")).withColumn("__most", F.col("words") * F.lit(float(cap)))
    levels = _fill(classes, ["__src"], "__rest", "__weight", "__most")
    copies = F.least(F.lit(float(cap)), F.col("level") * F.col("__class"))
    chance = F.when(F.col("__tier") == tier, (copies - F.floor(copies)) * F.col("words")).otherwise(0.0)
    levels = levels.groupBy("__src").agg(F.first("level").alias("__level"), F.sum(chance).alias("__room"))
    plan = cut(_plus(plan, levels))
    mine = slim.where(F.col("__tier") == tier)
    cuts = _cut(_weighed(join_lookup(mine, plan, "__src"), cap), plan.select("__src", "__room"))
    # Without a cut the tier's documents don't go beyond the room: all are taken.
    plan = cut(_plus(plan, cuts.withColumnRenamed("cut", "__cut")).withColumn("__cut", F.coalesce("__cut", _nowhere(F.lit(float("inf"))))))
    docs = _weighed(join_lookup(mine, plan, "__src"), cap)
    sure = F.sum((F.coalesce("__whole", F.lit(0)) + F.col("__in").cast("int")) * F.col("__words"))
    some = F.max(F.when(F.col("__at"), F.col("__cut.some") * F.col("__words")))
    taken = docs.groupBy("__src").agg((sure + F.coalesce(some, F.lit(0))).alias("__taken"))
    rest = F.greatest(F.lit(0.0), F.col("__rest") - F.coalesce("__taken", F.lit(0)))
    plan = _plus(plan, taken).withColumn("__rest", rest)
    return cut(plan.withColumn(f"__tier{tier}", F.struct("__level", "__cut")).drop("__level", "__cut", "__room", "__taken"))


def mix_sources(
    df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size",
    weights: Sequence[float] = WEIGHTS, total: float = TOTAL, cap: float = CAP,
) -> DataFrame:
    """``df`` (with word counts in ``size``) plus source_size, target, copies and taken (words, repeats counted)."""
    df = without(df, "source_size", "target", "copies", "taken")
    slim = df.select(F.col(key).alias("__key"), F.col(source).alias("__src"), F.col(size).alias("__words"))
    slim = cut(_prepared(slim, "__key", "__words").drop("__key"))
    sums = slim.groupBy("__src", "__class").agg(F.sum("__words").alias("words"))
    plan = cut(source_targets(sums, "__src", weights, total, cap))
    tiers = range(len(TIERS) + 1)
    slim = cut(join_lookup(slim, plan.select("__src", "target"), "__src").withColumn("__tier", _tier()).drop("target"))
    sums = cut(slim.groupBy("__src", "__class", "__tier").agg(F.sum("__words").alias("words")))
    plan = plan.withColumn("__rest", F.col("target"))
    for tier in tiers:
        plan = _plan_tier(plan, slim, sums, tier, cap)
    named = df.withColumn("__src", F.col(source)).withColumn("__words", F.col(size))
    docs = join_lookup(_prepared(named, key, size), plan, "__src").withColumn("__tier", _tier())
    docs = docs.withColumn("__own", F.element_at(F.array(*[F.col(f"__tier{t}") for t in tiers]), F.col("__tier") + 1))
    docs = _weighed(docs.withColumn("__level", F.col("__own.__level")).withColumn("__cut", F.col("__own.__cut")), cap)
    split = F.lit(False)
    for t in tiers:
        cut_at = F.col(f"__tier{t}.__cut")
        split = split | (cut_at["some"] < cut_at["n"])
    if plan.where(split).isEmpty():
        docs = docs.withColumn("__more", F.col("__in") | (F.col("__at") & (F.col("__cut.some") > 0)))
    else:
        docs = docs.where(~F.col("__at")).withColumn("__more", F.col("__in")).unionByName(_some_of(docs.where("__at")))
    copies = F.coalesce(F.when(F.col("__words") > 0, F.col("__whole") + F.col("__more").cast("int")), F.lit(0)).cast("long")
    docs = docs.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("__words"))
    return docs.select(*df.columns, "source_size", "target", "copies", "taken")


def _some_of(docs: DataFrame) -> DataFrame:
    """Documents at their source's cut, with ``__more`` true for as many as it takes; they differ in nothing the mix goes by.

    They are numbered by partition and place there, so no task sees more of them than it has read.
    """
    docs = cut(docs.withColumn("__no", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__no", 33)))
    step = ["__src", "__tier"]
    sums = docs.groupBy(*step, "__part").agg(F.count("*").alias("n"))
    above = Window.partitionBy(*step).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"{c}_") for c in (*step, "__part")], F.coalesce(F.sum("n").over(above), F.lit(0)).alias("__above"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*step, "__part")]
    place = F.row_number().over(Window.partitionBy(*step, "__part").orderBy("__no"))
    numbered = docs.withColumn("__place", place).join(sums, same[0] & same[1] & same[2])
    return numbered.withColumn("__more", F.col("__above") + F.col("__place") <= F.col("__cut.some")).drop("__no", "__place", "__above", "__part", "__src_", "__tier_", "__part_")


def repeat_copies(mixed: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """One row for each copy that the mix takes."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


#: The same mix over the whole table in DuckDB's SQL, put together from a head and a part for each tier.
_HEAD = f"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), sized AS (
  SELECT *, length(bin(size))::INT AS class, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || size::VARCHAR) AS h FROM docs
), drawn AS (
  SELECT *, (('0x' || substr(h, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY ALL
), weighted AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget, source_size * 2.0::DOUBLE AS most FROM sources
), tried AS (
  SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most / weight, weight, most ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, weight, most ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS trial FROM weighted
), targets AS (
  SELECT source, source_size, least(most, coalesce(max(CASE WHEN trial * weight <= most THEN trial END) OVER (), max(most / weight) OVER ()) * weight) AS target FROM tried
), tiered AS (
  SELECT d.*, t.source_size, t.target,
    CASE WHEN d.size > t.target * 0.1::DOUBLE THEN 0 WHEN d.size > t.target * 0.01::DOUBLE THEN 1 ELSE 2 END AS tier
  FROM drawn d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), classes AS (
  SELECT source, class, tier, sum(size)::BIGINT AS words, words * class AS weight, words * 2.0::DOUBLE AS most
  FROM tiered GROUP BY source, class, tier HAVING sum(size) > 0
), rest0 AS (SELECT source, target AS budget FROM targets)"""
_TIER = """, tried{t} AS (
  SELECT c.*, (budget - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS trial
  FROM classes c JOIN rest{t} b ON c.source IS NOT DISTINCT FROM b.source WHERE tier >= {t}
  WINDOW o AS (PARTITION BY c.source ORDER BY most / weight, weight, most)
), levels{t} AS (
  SELECT *, coalesce(max(CASE WHEN trial * weight <= most THEN trial END) OVER (PARTITION BY source), max(most / weight) OVER (PARTITION BY source)) AS level FROM tried{t}
), plan{t} AS (
  SELECT source, any_value(level) AS level, sum(CASE WHEN tier = {t} THEN (least(2.0::DOUBLE, level * class) - floor(least(2.0::DOUBLE, level * class))) * words ELSE 0 END) AS room
  FROM levels{t} GROUP BY source
), copies{t} AS (
  SELECT d.*, p.room, least(2.0::DOUBLE, p.level * d.class) AS m FROM tiered d LEFT JOIN plan{t} p ON d.source IS NOT DISTINCT FROM p.source WHERE tier = {t}
), ranked{t} AS (
  SELECT *, coalesce(floor(m), 0) AS whole, CASE WHEN m > floor(m) AND size > 0 THEN (u / (1 - u)) / ((m - floor(m)) / (1 - (m - floor(m)))) END AS q FROM copies{t}
), done{t} AS (
  SELECT *, q IS NOT NULL AND row_number() OVER (PARTITION BY source, q, h) <= floor((room - (sum(CASE WHEN q IS NOT NULL THEN size END)
    OVER (PARTITION BY source ORDER BY q, h) - sum(size) OVER (PARTITION BY source, q, h))) / nullif(size, 0)::DOUBLE + 0.5::DOUBLE) AS extra FROM ranked{t}
), rest{n} AS (
  SELECT b.source, greatest(0, budget - coalesce(taken, 0)) AS budget FROM rest{t} b
  LEFT JOIN (SELECT source, sum((whole + extra::INT) * size) AS taken FROM done{t} GROUP BY source) l ON b.source IS NOT DISTINCT FROM l.source
)"""
MIX_SQL = _HEAD + "".join(_TIER.format(t=t, n=t + 1) for t in range(3)) + """
SELECT doc_id, size, source_size, target, ((whole + extra::INT) * size)::BIGINT AS taken
FROM (SELECT * FROM done0 UNION ALL SELECT * FROM done1 UNION ALL SELECT * FROM done2)
"""
