"""Checks of plans; each is a small relation of issues, and all of them have the same columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MAX_SUBJECT, MIN_SUBJECT, trim_space
from ..operators.changesets import each_changeset
from ..operators.ranges import overlapping_hunks
from .strategies import Plan

ISSUE = {
    "changeset_id": "long", "issue_type": "string", "commit_id": "long", "hunk_id": "long", "commit_ids": "array<long>", "hunk_ids": "array<long>",
    "length": "int", "file_path": "string", "hunk_b": "long", "commit_b": "long",
}
#: Issue types that the deterministic fixes can mend.
FIXABLE = ("UnassignedHunks", "DuplicateHunkAcrossCommits")
#: Issue types that can be mended at all.
MODEL_FIXABLE = (*FIXABLE, "DuplicateHunkInCommit", "OverlappingHunks", "FailedAssessment")


def _issues(df: DataFrame, kind: str) -> DataFrame:
    df = df.withColumn("issue_type", F.lit(kind))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in ISSUE.items()])


def _large(df: DataFrame) -> DataFrame:
    """What grows with the plan and is never to be broadcast: written views are so well compressed that the planner would."""
    return df.hint("merge")


def existing(changes: DataFrame) -> DataFrame:
    return changes.where("kind = 'existing'")


def empty_messages(commits: DataFrame, least: int = 1) -> DataFrame:
    return _issues(commits.where(F.octet_length(trim_space("short")) < least), "EmptyMessage")


def long_messages(commits: DataFrame, most: int = MAX_SUBJECT) -> DataFrame:
    """Subjects longer than ``most`` bytes."""
    return _issues(commits.withColumn("length", F.octet_length("short")).where(F.col("length") > most), "MessageTooLong")


def without_changes(commits: DataFrame, changes: DataFrame) -> DataFrame:
    return _issues(commits.join(_large(changes.select("changeset_id", "commit_id").distinct()), ["changeset_id", "commit_id"], "left_anti"), "NoChanges")


def invalid_hunks(changes: DataFrame, hunks: DataFrame) -> DataFrame:
    return _issues(changes.join(_large(hunks.select("changeset_id", "hunk_id")), ["changeset_id", "hunk_id"], "left_anti"), "InvalidHunk")


def duplicates_within(changes: DataFrame) -> DataFrame:
    """One issue for each occurrence after the first in a commit."""
    nth = F.row_number().over(Window.partitionBy("changeset_id", "commit_id", "hunk_id").orderBy("change_pos"))
    return _issues(changes.withColumn("n", nth).where("n > 1"), "DuplicateHunkInCommit")


def duplicates_across(changes: DataFrame) -> DataFrame:
    """Hunks assigned more than once, with their commits in plan order; a commit that repeats one is listed again."""
    at = F.struct("commit_pos", "change_pos", "commit_id")
    twice = changes.groupBy("changeset_id", "hunk_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(at)).alias("at")).where("n > 1")
    return _issues(twice.withColumn("commit_ids", F.transform("at", lambda x: x["commit_id"])), "DuplicateHunkAcrossCommits")


def unassigned(hunks: DataFrame, changes: DataFrame) -> DataFrame:
    """(changeset_id, hunk_id) of hunks that no commit holds."""
    held = existing(changes).select("changeset_id", "hunk_id").distinct()
    return hunks.select("changeset_id", "hunk_id").join(_large(held), ["changeset_id", "hunk_id"], "left_anti")


def unassigned_hunks(hunks: DataFrame, changes: DataFrame) -> DataFrame:
    left = unassigned(hunks, changes).groupBy("changeset_id").agg(F.array_sort(F.collect_list("hunk_id")).alias("hunk_ids"))
    return _issues(left, "UnassignedHunks")


def invalid_dependencies(deps: DataFrame, commits: DataFrame) -> DataFrame:
    """``commit_b`` is what is missing."""
    known = commits.select("changeset_id", F.col("commit_id").alias("depends_on"))
    return _issues(deps.join(_large(known), ["changeset_id", "depends_on"], "left_anti").withColumn("commit_b", F.col("depends_on")), "InvalidDependency")


def first_cycle(nodes: list[int], edges: dict[int, list[int]]) -> list[int] | None:
    """The first cycle that a depth-first walk meets, closed by its first node."""
    seen: set[int] = set()
    for start in nodes:
        if start in seen:
            continue
        seen.add(start)
        path, on_path, turns = [start], {start}, [iter(edges.get(start, ()))]
        while turns:
            for node in turns[-1]:
                if node in on_path:
                    return [*path[path.index(node) :], node]
                if node not in seen:
                    seen.add(node)
                    path.append(node)
                    on_path.add(node)
                    turns.append(iter(edges.get(node, ())))
                    break
            else:
                turns.pop()
                on_path.discard(path.pop())
    return None


def cyclic_edges(deps: DataFrame, rounds: int = 1) -> DataFrame:
    """``deps`` without most edges that lie on no cycle: an edge stays only while its head depends on something
    and its tail is depended on. Each round reads ``deps`` three times, so more of them want a materialised table."""
    for _ in range(rounds):
        leaving = deps.select("changeset_id", F.col("commit_id").alias("depends_on")).distinct()
        entered = deps.select("changeset_id", F.col("depends_on").alias("commit_id")).distinct()
        deps = deps.join(_large(leaving), ["changeset_id", "depends_on"], "left_semi").join(_large(entered), ["changeset_id", "commit_id"], "left_semi")
    return deps


def cycles(deps: DataFrame, commits: DataFrame) -> DataFrame:
    """The first cycle of each change set that has one, in commit order."""
    placed = cyclic_edges(deps).join(_large(commits.select("changeset_id", "commit_id", "commit_pos")), ["changeset_id", "commit_id"])

    def walk(rows: list[dict]) -> list[tuple]:
        edges: dict[int, list[int]] = {}
        for r in rows:
            edges.setdefault(r["commit_id"], []).append(r["depends_on"])
        found = first_cycle(list(edges), edges)
        return [(found,)] if found else []

    found = each_changeset(placed, ["commit_pos", "depends_on", "commit_id"], walk, "commit_ids array<long>")
    return _issues(found, "CyclicDependency")


def placed_hunks(changes: DataFrame, hunks: DataFrame) -> DataFrame:
    return existing(changes).join(_large(hunks.select("changeset_id", "hunk_id", "file_path", "old_start", "old_count", "new_count")), ["changeset_id", "hunk_id"])


def overlaps(changes: DataFrame, hunks: DataFrame) -> DataFrame:
    found = overlapping_hunks(placed_hunks(changes, hunks))
    return _issues(found.withColumnsRenamed({"hunk_a": "hunk_id", "commit_a": "commit_id"}), "OverlappingHunks")


def validate_plan(plan: Plan, hunks: DataFrame) -> DataFrame:
    """All issues of a plan, which is read many times: one that is dear to make is better materialised first."""
    return reduce(DataFrame.unionByName, plan_checks(plan, hunks))


def plan_checks(plan: Plan, hunks: DataFrame) -> list[DataFrame]:
    """The issues of a plan, a relation for each check."""
    own = existing(plan.changes)
    found = [
        empty_messages(plan.commits), long_messages(plan.commits), without_changes(plan.commits, plan.changes), invalid_hunks(own, hunks),
        duplicates_within(own), duplicates_across(own), unassigned_hunks(hunks, plan.changes), overlaps(own, hunks),
    ]
    if plan.deps is not None:
        found += [invalid_dependencies(plan.deps, plan.commits), cycles(plan.deps, plan.commits)]
    return found


def validate_commits(plan: Plan, hunks: DataFrame) -> DataFrame:
    """The stricter check of single commits: subjects of MIN_SUBJECT bytes at least, and new hunks count too."""
    found = [
        empty_messages(plan.commits, MIN_SUBJECT), long_messages(plan.commits), without_changes(plan.commits, plan.changes),
        invalid_hunks(plan.changes, hunks), duplicates_within(plan.changes),
    ]
    return reduce(DataFrame.unionByName, found)


def incomplete_assignment(changes: DataFrame, hunks: DataFrame) -> DataFrame:
    """(changeset_id, hunk_id, n): hunks that aren't assigned exactly once."""
    counts = changes.groupBy("changeset_id", "hunk_id").agg(F.count("*").alias("n"))
    every = hunks.select("changeset_id", "hunk_id").join(counts, ["changeset_id", "hunk_id"], "full")
    return every.select("changeset_id", "hunk_id", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def fixable(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("issue_type").isin(*FIXABLE))


def model_fixable(issues: DataFrame) -> DataFrame:
    """Issues that a model can be asked to mend."""
    return issues.where(F.col("issue_type").isin(*MODEL_FIXABLE))


def issues_of(issues: DataFrame, kind: str) -> DataFrame:
    """The issues of one type, with the columns that tell something of it."""
    columns = {
        "UnassignedHunks": ["hunk_ids"], "DuplicateHunkAcrossCommits": ["hunk_id", "commit_ids"], "FailedAssessment": ["commit_id"],
        "OverlappingHunks": ["file_path", "hunk_id", "commit_id", "hunk_b", "commit_b"],
    }
    return issues.where(F.col("issue_type") == kind).select("changeset_id", *columns.get(kind, [c for c in ISSUE if c not in ("changeset_id", "issue_type")]))


def failed_assessments(overall: DataFrame, least: float) -> DataFrame:
    """Commits (changeset_id, commit_id, overall) that score below ``least``."""
    return _issues(overall.where(F.col("overall") < least), "FailedAssessment")


def describe(issue: str = "issue_type") -> Column:
    """An issue as a sentence."""
    c = lambda name: F.col(name).cast("string")
    commit, hunk = F.concat(F.lit("commit#"), c("commit_id")), F.concat(F.lit("hunk#"), c("hunk_id"))
    many = lambda column, word, sep: F.array_join(F.transform(column, lambda x: F.concat(F.lit(f"{word}#"), x.cast("string"))), sep)
    texts = {
        "EmptyMessage": F.concat(commit, F.lit(": empty commit message")),
        "MessageTooLong": F.concat(commit, F.lit(": message too long ("), c("length"), F.lit(f" chars, max {MAX_SUBJECT})")),
        "NoChanges": F.concat(commit, F.lit(": no changes in commit")),
        "InvalidHunk": F.concat(commit, F.lit(": invalid hunk reference "), hunk),
        "DuplicateHunkInCommit": F.concat(commit, F.lit(": duplicate hunk "), hunk, F.lit(" within commit")),
        "DuplicateHunkAcrossCommits": F.concat(hunk, F.lit(" assigned to multiple commits: "), many("commit_ids", "commit", ", ")),
        "UnassignedHunks": F.concat(F.lit("unassigned hunks: "), many("hunk_ids", "hunk", ", ")),
        "InvalidDependency": F.concat(commit, F.lit(": depends on non-existent commit#"), c("commit_b")),
        "CyclicDependency": F.concat(F.lit("cyclic dependency: "), many("commit_ids", "commit", " -> ")),
        "OverlappingHunks": F.concat(
            F.lit("overlapping hunks in "), c("file_path"), F.lit(": "), hunk, F.lit(" (commit "), commit, F.lit(") and hunk#"), c("hunk_b"),
            F.lit(" (commit commit#"), c("commit_b"), F.lit(")")),
    }
    out = F.lit(None).cast("string")
    for kind, text in texts.items():
        out = F.when(F.col(issue) == kind, text).otherwise(out)
    return out
