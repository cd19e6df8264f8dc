"""Recorded model answers as relations: plans, analyses, relations between hunks, and splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import between_braces, extract_json, format_lines, normalize_topic, once
from ..schemas import ANALYSIS_RESPONSE, CATEGORIES, PLAN_RESPONSE, RELATION_RESPONSE, SPLIT_RESPONSE
from ..sinks.patches import slim_struct
from ..sources.diff import partial_hunk, raw_fragment
from .strategies import Plan


def read_plans(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, errors) of (changeset_id, response): one row a planned commit with its change specs, in order."""
    read = responses.withColumn("__json", extract_json("response")).withColumn("__c", F.from_json("__json", PLAN_RESPONSE)["commits"])
    error = F.when(F.col("__json").isNull(), "no JSON found").when(F.col("__c").isNull(), "invalid JSON")
    read = read.withColumn("error", error)
    rows = read.where("error is null").select("changeset_id", F.posexplode("__c").alias("commit_pos", "c"))
    commits = rows.select("changeset_id", F.col("commit_pos").cast("long").alias("commit_id"), "commit_pos", F.col("c.short_description").alias("short"),
                          F.col("c.long_description").alias("long"), F.coalesce("c.changes", F.array()).alias("changes"))
    return commits, read.where("error is not null").select("changeset_id", "error")


def convert_changes(commits: DataFrame, hunks: DataFrame, lines: Callable[[Column], Column] | None = None) -> DataFrame:
    """Change specs as planned changes: a whole hunk, some of its lines, or a fragment written by the model.

    New hunks are numbered from one more than the largest id on, in document order. A part of an unknown hunk, lines out
    of range and empty fragments give a null ``new_hunk`` with the reason in ``error``. Where lines follow from a hunk's own columns,
    ``lines`` makes them of a slim hunk once it has met its change, so that they are not moved.
    """
    specs = commits.select("changeset_id", "commit_id", "commit_pos", F.posexplode("changes").alias("change_pos", "s"))
    specs = specs.withColumn("source", F.coalesce("s.hunk_id", "s.id"))
    # New hunks are numbered before any lines are there, and these are moved once.
    kind = F.col("s.type")
    most = hunks.groupBy("changeset_id").agg(F.max("hunk_id").alias("most"))
    nth = F.sum(F.col("is_new").cast("int")).over(Window.partitionBy("changeset_id").orderBy("commit_pos", "change_pos"))
    specs = specs.withColumn("is_new", kind != "hunk").withColumn("nth", nth).join(most, "changeset_id", "left")
    own = hunks.select("changeset_id", F.col("hunk_id").alias("source"), F.col("file_path").alias("__path"), (F.col("lines") if lines is None else slim_struct()).alias("__own"), "old_start", "new_start")
    specs = specs.join(own, ["changeset_id", "source"], "left")
    found = F.col("__own") if lines is None else F.when(F.col("__own").isNotNull(), lines(F.col("__own")))
    part = F.transform(F.array(found), lambda x: partial_hunk(x, F.col("s.lines"), F.col("old_start"), F.col("new_start")))[0]  # lines are made once
    new = F.when(kind == "partial", part).when(kind == "raw", raw_fragment("s.diff"))
    specs = specs.withColumn("new_hunk", new)
    error = (
        F.when(F.col("is_new") & (kind == "partial") & F.col("__path").isNull(), "unknown hunk")
        .when(F.col("is_new") & F.col("new_hunk").isNull(), F.when(kind == "partial", "line out of range").otherwise("no lines"))
    )
    specs = specs.withColumn("error", error)
    return specs.select(
        "changeset_id", "commit_id", "commit_pos", "change_pos", F.when(F.col("is_new"), "new").otherwise("existing").alias("kind"),
        F.when(F.col("is_new"), F.coalesce("most", F.lit(0)) + F.col("nth")).otherwise(F.col("source")).alias("hunk_id"),
        F.when(F.col("is_new"), F.coalesce("s.file_path", "__path")).alias("file_path"), "new_hunk", "error")


def plan_from_responses(responses: DataFrame, hunks: DataFrame) -> Plan:
    """The plan that recorded answers hold; specs in error are left out."""
    commits, _ = read_plans(responses)
    changes = convert_changes(commits, hunks).where("error is null")
    return Plan(commits.drop("changes"), changes.select("changeset_id", "commit_id", "commit_pos", "change_pos", "kind", "hunk_id"))


def judged_analyses(responses: DataFrame) -> DataFrame:
    """(changeset_id, hunk_id, file_path, response) with the answer that was read in ``answer``, and what is wrong with it, or null, in ``error``."""
    read = once(responses, __json=extract_json("response"), answer=F.from_json("__json", ANALYSIS_RESPONSE))
    category = F.col("answer.category")
    error = F.when(F.col("__json").isNull(), "no JSON found").when(category.isNull() | ~category.isin(*CATEGORIES), "invalid category").when(F.col("answer.topic").isNull(), "no topic")
    return read.withColumn("error", error).withColumn("topic", F.when(error.isNull(), normalize_topic("answer.topic"))).drop("__json")


def read_analyses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(analyses, errors) of (changeset_id, hunk_id, file_path, response); an unknown category is an error."""
    read = judged_analyses(responses)
    good = read.where("error is null").select(
        "changeset_id", "hunk_id", F.col("answer.category").alias("category"), F.coalesce("answer.semantic_units", F.array().cast("array<string>")).alias("semantic_units"),
        "topic", F.col("answer.depends_on_context").alias("depends_on_context"), "file_path")
    return good, read.where("error is not null").select("changeset_id", "hunk_id", "error")


def read_relations(responses: DataFrame) -> DataFrame:
    """(changeset_id, group_pos, hunk_ids, reason) of (changeset_id, response)."""
    groups = F.from_json(between_braces("response"), RELATION_RESPONSE)["groups"]
    rows = responses.select("changeset_id", F.posexplode(groups).alias("group_pos", "g"))
    return rows.select("changeset_id", "group_pos", "g.hunk_ids", F.coalesce("g.reason", F.lit("")).alias("reason"))


def read_splits(responses: DataFrame) -> DataFrame:
    """(changeset_id, cluster_id, split_pos, short, long, hunk_ids) of (changeset_id, cluster_id, response)."""
    split = F.from_json(between_braces("response"), SPLIT_RESPONSE)["split"]
    rows = responses.select("changeset_id", "cluster_id", F.posexplode(split).alias("split_pos", "s"))
    return rows.select("changeset_id", "cluster_id", "split_pos", F.col("s.short_description").alias("short"), F.col("s.long_description").alias("long"), "s.hunk_ids")


def model_context(hunks: DataFrame) -> DataFrame:
    """What a model is shown of each hunk."""
    return hunks.select("changeset_id", "hunk_id", "file_path", "old_start", "new_start", format_lines("lines").alias("diff"), "likely_source_commits")
