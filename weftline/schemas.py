"""Relations of the engine; every one begins with the change set it belongs to."""

from __future__ import annotations

from pyspark.sql import types as T

LINE = "struct<type:string,content:string>"
LINES = f"array<{LINE}>"
HUNK = (
    "changeset_id long, hunk_id long, file_path string, old_start long, old_count long, new_start long, new_count long, "
    f"lines {LINES}, likely_source_commits array<string>, old_missing_newline_at_eof boolean, new_missing_newline_at_eof boolean"
)
FILE_CHANGE = (
    "changeset_id long, seq int, file_path string, change_type string, old_mode string, new_mode string, is_binary boolean, "
    "has_content_hunks boolean, likely_source_commits array<string>"
)
COMMIT = "changeset_id long, position int, sha string, short string, long string"
PLAN_COMMIT = "changeset_id long, commit_id long, commit_pos int, short string, long string"
PLAN_CHANGE = "changeset_id long, commit_id long, commit_pos int, change_pos int, kind string, hunk_id long"
PLAN_DEP = "changeset_id long, commit_id long, depends_on long"
ANALYSIS = (
    "changeset_id long, hunk_id long, category string, semantic_units array<string>, topic string, depends_on_context string, file_path string"
)
SCORE = "changeset_id long, sha string, position int, criterion string, level int, rationale string, evidence array<string>, suggestions array<string>"

ADDED, REMOVED, CONTEXT = "added", "removed", "context"

#: Change categories in order of declaration, and strategies.
CATEGORIES = ("feature", "bugfix", "refactor", "test", "documentation", "configuration", "dependency", "formatting", "other")
STRATEGIES = ("preserve", "by-file", "squash", "llm", "hierarchical", "absorb")

#: JSON of recorded model responses.
SCORES_RESPONSE = "scores array<struct<criterion:string,level:int,rationale:string,evidence:array<string>,suggestions:array<string>>>"
PLAN_RESPONSE = (
    "commits array<struct<short_description:string,long_description:string,"
    "changes:array<struct<type:string,id:bigint,hunk_id:bigint,lines:array<int>,file_path:string,diff:string>>>>"
)
ANALYSIS_RESPONSE = "category string, semantic_units array<string>, topic string, depends_on_context string"
RELATION_RESPONSE = "groups array<struct<hunk_ids:array<bigint>,reason:string>>"
SPLIT_RESPONSE = "short_description string, long_description string, split array<struct<short_description:string,long_description:string,hunk_ids:array<bigint>>>"


def of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
