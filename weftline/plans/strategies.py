"""Plans made without a model: by file, squashed, or along the source commits."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.text import file_name, path_key
from ..operators.attribution import source_commit
from ..schemas import PLAN_CHANGE, PLAN_COMMIT, STRATEGIES


@dataclass(frozen=True)
class Plan:
    """``commits`` and ``changes`` as in schemas; ``deps`` (changeset_id, commit_id, depends_on) or None."""

    commits: DataFrame
    changes: DataFrame
    deps: DataFrame | None = None

    def materialised(self) -> Plan:
        """The plan cut from its lineage."""
        return Plan(cut(self.commits), cut(self.changes), self.deps and cut(self.deps))


class Strategy(Protocol):
    def __call__(self, commits: DataFrame, hunks: DataFrame) -> Plan: ...


def _exploded(groups: DataFrame) -> Plan:
    """A plan of rows (changeset_id, commit_id, commit_pos, short, long, hunk_ids)."""
    changes = groups.select("changeset_id", "commit_id", "commit_pos", F.posexplode("hunk_ids").alias("change_pos", "hunk_id"))
    return Plan(
        groups.select("changeset_id", "commit_id", "commit_pos", "short", "long"),
        changes.select("changeset_id", "commit_id", "commit_pos", "change_pos", F.lit("existing").alias("kind"), "hunk_id"),
    )


def by_file(commits: DataFrame | None, hunks: DataFrame) -> Plan:
    """One commit for each file, files ordered by path component."""
    files = hunks.groupBy("changeset_id", "file_path").agg(F.array_sort(F.collect_list("hunk_id")).alias("hunk_ids"))
    place = F.row_number().over(Window.partitionBy("changeset_id").orderBy(path_key("file_path"), "file_path")) - 1
    short = F.concat(F.lit("Update "), file_name("file_path"))
    return _exploded(files.select(
        "changeset_id", place.cast("long").alias("commit_id"), place.cast("int").alias("commit_pos"), short.alias("short"),
        F.concat(short, F.lit("\n\nChanges to "), "file_path").alias("long"), "hunk_ids"))


def squash(commits: DataFrame, hunks: DataFrame) -> Plan:
    """One commit for each change set that has hunks, its body listing the source commits."""
    listed = commits.groupBy("changeset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "short"))), lambda x: x["short"]).alias("subjects"))
    ids = hunks.groupBy("changeset_id").agg(F.array_sort(F.collect_list("hunk_id")).alias("hunk_ids"))
    both = ids.join(listed, "changeset_id", "left").withColumn("subjects", F.coalesce("subjects", F.array().cast("array<string>")))
    n = F.size("subjects")
    short = F.when(n == 1, F.get("subjects", F.lit(0))).otherwise(F.format_string("Squashed %d commits", n))
    bullets = F.array_join(F.transform("subjects", lambda s: F.concat(F.lit("- "), s, F.lit("\n"))), "")
    long = F.when(n > 1, F.concat(short, F.lit("\n\nSquashed commits:\n"), bullets)).otherwise(short)
    return _exploded(both.select(
        "changeset_id", F.lit(0).cast("long").alias("commit_id"), F.lit(0).alias("commit_pos"), short.alias("short"), long.alias("long"), "hunk_ids"))


def preserve(commits: DataFrame, hunks: DataFrame) -> Plan:
    """One commit for each source commit to which hunks are attributed; its id is the position, so ids may have gaps.

    Hunks attributed to no commit of the range are in no commit.
    """
    owned = source_commit(hunks, commits).groupBy("changeset_id", "sha").agg(F.array_sort(F.collect_list("hunk_id")).alias("hunk_ids"))
    kept = commits.select("changeset_id", "sha", "position", "short", "long").join(owned, ["changeset_id", "sha"])
    place = F.row_number().over(Window.partitionBy("changeset_id").orderBy("position")) - 1
    return _exploded(kept.select(
        "changeset_id", F.col("position").cast("long").alias("commit_id"), place.cast("int").alias("commit_pos"), "short", "long", "hunk_ids"))


def absorb(commits: DataFrame, hunks: DataFrame) -> Plan:
    """An empty plan: this strategy is left to an outside program."""
    spark = hunks.sparkSession
    return Plan(spark.createDataFrame([], PLAN_COMMIT), spark.createDataFrame([], PLAN_CHANGE))


def strategy(name: str, **recorded: DataFrame) -> Strategy:
    """A strategy by name; ``llm`` and ``hierarchical`` plan from recorded model answers given as keyword tables."""
    from .hierarchical import plan_hierarchical
    from .responses import plan_from_responses

    known: dict[str, Strategy] = {
        "by-file": by_file, "squash": squash, "preserve": preserve, "absorb": absorb,
        "llm": lambda commits, hunks: plan_from_responses(recorded["responses"], hunks),
        "hierarchical": lambda commits, hunks: plan_hierarchical(recorded["analyses"], hunks),
    }
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; one of {', '.join(STRATEGIES)}")
    return known[name]
