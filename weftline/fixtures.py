"""Views of the synthetic tables as hunks, commits, plans, analyses, scores and responses.

Each view is one SQL text that Spark and DuckDB both read, so a query and its SQL start from the same rows; Spark has a text of
its own for the hunks, which a test holds against the other one.
Numbering is done within a change set: no window spans the whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import ADDED, REMOVED

#: What a change set is: one customer's or one nation's orders.
KEYS = {"customer": "o_custkey", "nation": "CAST(c_nationkey AS BIGINT)"}
_BRANCHES = {"spark": "explode(array(0, 1, 2, 3))", "duckdb": "unnest([0, 1, 2, 3])"}
_DAYS = {"spark": "datediff(CAST(l_shipdate AS DATE), DATE '1995-01-01')", "duckdb": "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))"}

_HUNKS = """
SELECT changeset_id, CAST(row_number() OVER (PARTITION BY changeset_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
    l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS BIGINT) AS hunk_id, l_orderkey AS commit_id, md5(CAST(l_orderkey AS STRING)) AS sha,
  concat(CASE WHEN l_partkey % 2 = 0 THEN 'part/' ELSE 'part-alt/' END, p_brand, '/', CAST(l_partkey % 40 AS STRING)) AS file_path,
  old_start, old_count, old_start AS new_start, greatest(CAST(0 AS BIGINT), old_count + l_linenumber - 4) AS new_count, p_name, p_type, p_size
FROM (
  SELECT *, @key AS changeset_id, CAST(@days AS BIGINT) AS old_start, CAST(l_quantity AS BIGINT) - 1 AS old_count
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey
) placed"""

#: The same rows for Spark: lines meet their parts first and orders their customers before both meet, so that lines are moved once for each of
#: these and once to their change set. They are ranked in their order before that, and what follows from their own columns is made after the
#: numbering, so that no column which only breaks ties is moved to the change set, and no text that can be made.
_SPARK_HUNKS = """
SELECT changeset_id, hunk_id, l_orderkey AS commit_id, md5(CAST(l_orderkey AS STRING)) AS sha,
  concat(CASE WHEN l_partkey % 2 = 0 THEN 'part/' ELSE 'part-alt/' END, p_brand, '/', CAST(l_partkey % 40 AS STRING)) AS file_path,
  old_start, old_count, old_start AS new_start, greatest(CAST(0 AS BIGINT), old_count + l_linenumber - 4) AS new_count, p_name, p_type, p_size
FROM (SELECT *, CAST(@days AS BIGINT) AS old_start, CAST(l_quantity AS BIGINT) - 1 AS old_count FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY changeset_id ORDER BY l_orderkey, line_rank) - 1 AS BIGINT) AS hunk_id
  FROM (SELECT changeset_id, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, p_brand, p_name, p_type, p_size,
      row_number() OVER (PARTITION BY l_orderkey, changeset_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
        l_extendedprice, l_quantity, l_discount, l_tax) AS line_rank
    FROM (SELECT * FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) lines
    JOIN (SELECT o_orderkey, @key AS changeset_id FROM {orders} JOIN {customer} ON o_custkey = c_custkey) owned ON l_orderkey = o_orderkey) ranked) numbered
) placed"""

_COMMITS = """
SELECT changeset_id, o_orderkey AS commit_id, md5(CAST(o_orderkey AS STRING)) AS sha, o_orderpriority AS short,
  concat(o_orderpriority, chr(10), chr(10), 'Status ', o_orderstatus) AS long,
  CAST(row_number() OVER (PARTITION BY changeset_id ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS position
FROM (SELECT *, @key AS changeset_id FROM {orders} JOIN {customer} ON o_custkey = c_custkey) owned"""

#: A damaged plan: hunks left out, assigned twice, repeated in a commit, and unknown ones. Each view reads the one below once.
_CHANGES = """
SELECT changeset_id, commit_id, hunk_id, 'existing' AS kind,
  CAST(dense_rank() OVER (PARTITION BY changeset_id ORDER BY commit_id) - 1 AS INT) AS commit_pos,
  CAST(row_number() OVER (PARTITION BY changeset_id, commit_id ORDER BY branch, hunk_id) - 1 AS INT) AS change_pos
FROM (
  SELECT changeset_id, branch, CASE WHEN branch = 1 THEN commit_id + 1 ELSE commit_id END AS commit_id,
    CASE WHEN branch = 3 THEN hunk_id + 1000000 ELSE hunk_id END AS hunk_id
  FROM (SELECT changeset_id, commit_id, hunk_id, @branches AS branch FROM {hunks} h) each
  WHERE CASE branch WHEN 0 THEN hunk_id % 17 <> 0 WHEN 1 THEN hunk_id % 23 = 0 WHEN 2 THEN hunk_id % 29 = 0 ELSE hunk_id % 31 = 0 END
) parts"""

_PLANNED = """
SELECT changeset_id, commit_id, commit_pos,
  CASE WHEN commit_id % 13 = 0 THEN '  ' WHEN commit_id % 11 = 0 THEN repeat('é', 40) ELSE concat('Change ', CAST(commit_id AS STRING)) END AS short,
  CASE WHEN commit_id % 2 = 0 THEN '' ELSE concat('Body of ', CAST(commit_id AS STRING)) END AS long
FROM (
  SELECT DISTINCT changeset_id, CASE WHEN branch = 0 THEN commit_id ELSE CAST(-1 AS BIGINT) END AS commit_id,
    CASE WHEN branch = 0 THEN commit_pos ELSE CAST(top + 1 AS INT) END AS commit_pos
  FROM (SELECT *, @branches AS branch FROM (SELECT *, max(commit_pos) OVER (PARTITION BY changeset_id) AS top FROM {changes} c) topped) each
  WHERE branch = 0 OR branch = 1 AND changeset_id % 5 = 0
) every"""

#: Each third commit depends on the one before; some on none that exists; every fourth change set holds a cycle.
_DEPS = """
SELECT changeset_id, commit_id, depends_on FROM (
  SELECT changeset_id, commit_id, CASE branch
    WHEN 0 THEN CASE WHEN commit_pos % 3 = 1 OR changeset_id % 4 = 0 THEN previous END
    WHEN 1 THEN CASE WHEN commit_id % 7 = 0 THEN CAST(999999999 AS BIGINT) END
    WHEN 2 THEN CASE WHEN commit_pos = 0 AND changeset_id % 4 = 0 THEN fourth END END AS depends_on
  FROM (SELECT *, @branches AS branch FROM (
    SELECT *, lag(commit_id) OVER (PARTITION BY changeset_id ORDER BY commit_pos) AS previous,
      max(CASE WHEN commit_pos = 3 THEN commit_id END) OVER (PARTITION BY changeset_id) AS fourth FROM {planned} p) near) each
) found WHERE depends_on IS NOT NULL"""

_ANALYSES = """
SELECT changeset_id, hunk_id, p_type AS topic, file_path, p_name AS unit,
  CASE p_size % 9 WHEN 0 THEN 'feature' WHEN 1 THEN 'bugfix' WHEN 2 THEN 'refactor' WHEN 3 THEN 'test' WHEN 4 THEN 'documentation'
    WHEN 5 THEN 'configuration' WHEN 6 THEN 'dependency' WHEN 7 THEN 'formatting' ELSE 'other' END AS category
FROM {hunks} h"""

_SCORES = """
SELECT changeset_id, sha, day, criterion, CAST(level AS INT) AS level FROM (
  SELECT user_id AS changeset_id, CAST(CAST(ts AS DATE) AS STRING) AS sha, CAST(ts AS DATE) AS day,
    CASE event_type WHEN 'click' THEN 'atomicity' WHEN 'error' THEN 'message_quality' WHEN 'purchase' THEN 'logical_cohesion'
      WHEN 'signup' THEN 'scope_appropriateness' ELSE 'reversibility' END AS criterion,
    max(CAST(1 + floor(value) % 5 AS INT)) AS level
  FROM {events} GROUP BY 1, 2, 3, 4
) best"""

#: Model answers: fenced, in any fence, bare, without JSON, in a fence that is never closed.
_RESPONSES = """
SELECT event_id, CASE event_id % 5
  WHEN 0 THEN concat('Here:', chr(10), '```json', chr(10), props, chr(10), '```', chr(10), 'done')
  WHEN 1 THEN concat('```text', chr(10), props, chr(10), '```')
  WHEN 2 THEN concat('The answer is ', props, ' as asked')
  WHEN 3 THEN 'none' ELSE concat('```json', chr(10), props) END AS response
FROM {events} e"""

VIEWS = {
    "hunks": _HUNKS, "commits": _COMMITS, "changes": _CHANGES, "planned": _PLANNED, "deps": _DEPS, "analyses": _ANALYSES, "scores": _SCORES,
    "responses": _RESPONSES,
}


def _needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", VIEWS[name])))


def view(spark: SparkSession, sf_dir: str, name: str, by: str = "customer", **made: DataFrame) -> DataFrame:
    """A view of the tables in ``sf_dir``; views that are ``made`` already are read from there."""
    sources = {n: made[n] if n in made else view(spark, sf_dir, n, by, **made) if n in VIEWS else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in _needs(name)}
    return spark.sql({"hunks": _SPARK_HUNKS}.get(name, VIEWS[name]).replace("@key", KEYS[by]).replace("@days", _DAYS["spark"]).replace("@branches", _BRANCHES["spark"]), **sources)


def with_views(*names: str, by: str = "customer") -> str:
    """The head of a DuckDB query over views: WITH name AS (...), ... for them and what they are made of."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _needs(name):
            if n in VIEWS:
                visit(n)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in order:
        sql = VIEWS[name].replace("@key", KEYS[by]).replace("@days", _DAYS["duckdb"]).replace("@branches", _BRANCHES["duckdb"])
        parts.append(f"{name} AS ({re.sub(r'[{](.+?)[}]', r'\1', sql)})")
    return "WITH " + ",\n".join(parts)


def made_lines(h: Column) -> Column:
    """Lines of a hunk struct: the old ones removed, the new ones added, as many as its counts tell."""
    made = lambda kind, word, n: F.transform(
        F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(f"{word} "), i.cast("string"), F.lit(" of "), h["hunk_id"].cast("string")).alias("content")))
    return F.concat(made(REMOVED, "old", h["old_count"]), made(ADDED, "new", h["new_count"]))


def without_lines(hunks: DataFrame) -> DataFrame:
    """Hunks whose lines ``made_lines`` makes where they are wanted."""
    return hunks.select(
        "changeset_id", "hunk_id", "commit_id", "sha", "file_path", "old_start", "old_count", "new_start", "new_count",
        F.lit(False).alias("old_missing_newline_at_eof"), (F.col("hunk_id") % 3 == 0).alias("new_missing_newline_at_eof"))


def with_lines(hunks: DataFrame, *keep: str) -> DataFrame:
    """Hunks with lines; the columns to ``keep`` stay."""
    lines = made_lines(F.struct("hunk_id", "old_count", "new_count"))
    return hunks.select(
        "changeset_id", "hunk_id", "commit_id", "sha", "file_path", "old_start", "old_count", "new_start", "new_count", lines.alias("lines"),
        F.array("sha").alias("likely_source_commits"), F.lit(False).alias("old_missing_newline_at_eof"), (F.col("hunk_id") % 3 == 0).alias("new_missing_newline_at_eof"),
        *keep,
    )
