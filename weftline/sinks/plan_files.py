"""Plans and assessments stored as JSON, one object for each change set, and read back.

A store is a folder to which every save adds a folder of its own, so saving one change set leaves the files of all others
alone, and a save that breaks off leaves what was there: only saves that ended (they hold ``_SUCCESS``) are read. Of a
change set the object saved last counts. ``compact`` writes these into one save and removes the ones before it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rubric import place
from ..plans.assessment import commit_scores, range_scores
from ..plans.strategies import Plan
from ..schemas import STRATEGIES

VERSION = 1
STORED = (
    "changeset_id long, version int, strategy string, next_commit_index int, "
    "commits array<struct<description:struct<short:string,long:string>,changes:array<struct<type:string,data:bigint>>,created_sha:string>>"
)


def stored_plans(plan: Plan, strategy: str, created: DataFrame | None = None) -> DataFrame:
    """(changeset_id, stored): the JSON of each plan. ``created``: changeset_id, commit_pos, created_sha of commits made so far."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    listed = F.array_sort(F.collect_list(F.struct("change_pos", F.col("kind").alias("type"), F.col("hunk_id").alias("data"))))
    changes = plan.changes.groupBy("changeset_id", "commit_id").agg(F.transform(listed, lambda x: x.dropFields("change_pos")).alias("changes"))
    rows = plan.commits.join(changes, ["changeset_id", "commit_id"], "left").withColumn("changes", F.coalesce("changes", F.array()))
    if created is None:
        rows = rows.withColumn("created_sha", F.lit(None).cast("string"))
    else:
        rows = rows.join(created.select("changeset_id", "commit_pos", "created_sha"), ["changeset_id", "commit_pos"], "left")
    one = F.struct("commit_pos", F.struct("short", "long").alias("description"), "changes", "created_sha")
    plans = rows.groupBy("changeset_id").agg(F.array_sort(F.collect_list(one), lambda a, b: a["commit_pos"] - b["commit_pos"]).alias("c"), F.count("created_sha").cast("int").alias("next_commit_index"))
    body = F.struct(
        "changeset_id", F.lit(VERSION).alias("version"), F.lit(strategy).alias("strategy"), "next_commit_index",
        F.transform("c", lambda x: x.dropFields("commit_pos")).alias("commits"))
    return plans.select("changeset_id", F.to_json(body).alias("stored"))


def _append(rows: DataFrame, path: str, kind: str) -> None:
    """Lines of JSON added to a store as a save of their own; later saves have greater names."""
    rows.select("stored").write.text(f"{path}/{kind}-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")


def _saves(spark: SparkSession, path: str, kind: str) -> list[str]:
    """The folders of the saves that ended, oldest first; as many as there were saves since the store was compacted."""
    place_ = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}-*/_SUCCESS")
    found = place_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place_)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def _lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(changeset_id, saved, stored) of all saves of a kind."""
    saves = _saves(spark, path, kind)
    if not saves:
        return spark.createDataFrame([], "changeset_id long, saved string, stored string")
    saved = F.regexp_extract("_metadata.file_path", f"/{kind}-([^/]+)/[^/]*$", 1)
    return spark.read.text(saves).select(F.get_json_object("value", "$.changeset_id").cast("long").alias("changeset_id"), saved.alias("saved"), F.col("value").alias("stored"))


def _latest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(changeset_id, saved, stored): what was saved last of each change set."""
    last = _lines(spark, path, kind).groupBy("changeset_id").agg(F.max(F.struct("saved", "stored")).alias("x"))
    return last.select("changeset_id", "x.saved", "x.stored")


def save_plans(plan: Plan, strategy: str, path: str, created: DataFrame | None = None) -> None:
    """Adds these change sets' plans to the store at ``path``; plans of theirs saved before no longer count, nor does their progress."""
    _append(stored_plans(plan, strategy, created), path, "plans")


def save_progress(created: DataFrame, path: str) -> None:
    """Adds to the store at ``path`` that commits were made: ``created`` is changeset_id, commit_pos, created_sha. No plan is read or written."""
    _append(created.select(F.to_json(F.struct("changeset_id", "commit_pos", "created_sha")).alias("stored")), path, "progress")


def _made(spark: SparkSession, path: str, plans: DataFrame) -> DataFrame:
    """(changeset_id, commit_pos, created_sha) saved as progress after the change set's plan; of a commit the last one."""
    lines = _lines(spark, path, "progress").withColumn("m", F.from_json("stored", "commit_pos int, created_sha string"))
    rows = lines.join(plans.select("changeset_id", F.col("saved").alias("since")), "changeset_id").where("saved > since and m.commit_pos is not null")
    return rows.groupBy("changeset_id", "m.commit_pos").agg(F.max(F.struct("saved", "m.created_sha")).alias("x")).select("changeset_id", "commit_pos", "x.created_sha")


def compact(spark: SparkSession, path: str) -> None:
    """Writes what counts of a store of plans as one save, progress included, and then removes the saves before it."""
    old = _saves(spark, path, "plans") + _saves(spark, path, "progress")
    plans = _latest(spark, path, "plans")
    made = _made(spark, path, plans).groupBy("changeset_id").agg(F.map_from_entries(F.collect_list(F.struct("commit_pos", "created_sha"))).alias("made"))
    rows = plans.join(made, "changeset_id", "left").withColumn("p", F.from_json("stored", STORED))
    sha = lambda c, i: F.coalesce(F.try_element_at("made", i), c["created_sha"])
    commits = F.transform("p.commits", lambda c, i: c.withField("created_sha", sha(c, i)))
    at = F.greatest("p.next_commit_index", F.array_max(F.map_keys("made")) + 1)
    body = F.to_json(F.struct("changeset_id", "p.version", "p.strategy", at.alias("next_commit_index"), commits.alias("commits")))
    _append(rows.select(F.when(F.col("made").isNull(), F.col("stored")).otherwise(body).alias("stored")), path, "plans")
    for save in old:
        delete_stored(spark, save)


def read_plans(stored: DataFrame) -> tuple[Plan, DataFrame]:
    """(plan, progress) of (stored): ids are the commits' places, and dependencies are gone; progress is changeset_id, next_index."""
    rows = stored.select(F.from_json("stored", STORED).alias("p")).select("p.*")
    commits = rows.select("changeset_id", F.posexplode("commits").alias("commit_pos", "c")).withColumn("commit_id", F.col("commit_pos").cast("long"))
    changes = commits.select("changeset_id", "commit_id", "commit_pos", F.posexplode("c.changes").alias("change_pos", "x"))
    return (
        Plan(
            commits.select("changeset_id", "commit_id", "commit_pos", F.col("c.description.short").alias("short"), F.col("c.description.long").alias("long")),
            changes.select("changeset_id", "commit_id", "commit_pos", "change_pos", F.col("x.type").alias("kind"), F.col("x.data").alias("hunk_id")),
        ),
        rows.select("changeset_id", F.col("next_commit_index").alias("next_index")),
    )


def load_plans(spark: SparkSession, path: str) -> tuple[Plan, DataFrame]:
    """(plan, progress) of a store: each change set's last plan, and the first commit after those that were made."""
    latest = _latest(spark, path, "plans")
    plan, progress = read_plans(latest)
    made = _made(spark, path, latest).groupBy("changeset_id").agg((F.max("commit_pos") + 1).alias("made"))
    return plan, progress.join(made, "changeset_id", "left").select("changeset_id", F.greatest("next_index", "made").alias("next_index"))


#: An assessment as it is stored: one object for each change set.
ASSESSMENT = (
    "changeset_id long, base_sha string, head_sha string, assessed_at string, overall double, "
    "scores array<struct<sha:string,position:int,criterion:string,level:int,rationale:string,evidence:array<string>,suggestions:array<string>>>"
)


def stored_assessments(scores: DataFrame, commits: DataFrame, ends: DataFrame, assessed_at: str) -> DataFrame:
    """(changeset_id, stored): the JSON of each change set's assessment.

    ``scores`` as ``parse_responses`` gives them; ``commits``: changeset_id, sha, position; ``ends``: changeset_id, base_sha, head_sha.
    """
    overall = range_scores(commit_scores(scores), ends.select("changeset_id"))
    rows = scores.join(commits.select("changeset_id", "sha", "position"), ["changeset_id", "sha"]).withColumn("p", place("criterion"))
    one = F.struct("position", "p", "sha", "criterion", "level", "rationale", "evidence", "suggestions")
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["sha"], x["position"], x["criterion"], x["level"], x["rationale"], x["evidence"], x["suggestions"]))
    whole = ends.join(overall, "changeset_id").join(rows.groupBy("changeset_id").agg(listed.alias("scores")), "changeset_id", "left")
    whole = whole.select("changeset_id", "base_sha", "head_sha", F.lit(assessed_at).alias("assessed_at"), "overall", F.coalesce("scores", F.array()).alias("scores"))
    return whole.select("changeset_id", F.to_json(F.struct(*whole.columns)).alias("stored"))


def save_assessments(stored: DataFrame, path: str) -> None:
    """Adds these change sets' assessments to the store at ``path``; theirs saved before no longer count."""
    _append(stored, path, "assessments")


def read_assessments(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranges, scores) of (stored): changeset_id, ends, time and overall score; and the scores with their commits' places."""
    rows = stored.select(F.from_json("stored", ASSESSMENT).alias("a")).select("a.*")
    return rows.drop("scores"), rows.select("changeset_id", F.explode("scores").alias("s")).select("changeset_id", "s.*")


def load_assessments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_assessments(_latest(spark, path, "assessments"))


def delete_stored(spark: SparkSession, path: str) -> bool:
    """Whether there was something at ``path``, which is then gone."""
    place_ = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place_, True)


def list_stored(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the JSON files in a folder, by path; none if there is no such folder."""
    place_ = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not place_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place_):
        return spark.createDataFrame([], "path string, length long")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", "length").orderBy("path")
