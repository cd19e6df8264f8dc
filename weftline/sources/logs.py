"""Commit logs as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space


def read_log(log: DataFrame) -> DataFrame:
    """Commits of (changeset_id, position, sha, message): the whole message, trimmed, is the body, its first line the subject."""
    body = trim_space("message")
    return log.select("changeset_id", "position", "sha", F.regexp_replace(F.split(body, "\n")[0], "\r$", "").alias("short"), body.alias("long"))


def split_log(texts: DataFrame) -> DataFrame:
    """(changeset_id, position, sha, message) of (changeset_id, log_text), the output of ``git log --reverse --format=%H%n%B%x00``."""
    entries = F.filter(F.transform(F.split("log_text", "\x00"), lambda e: F.regexp_replace(e, r"^\n+", "")), lambda e: e != "")
    rows = texts.select("changeset_id", F.posexplode(entries).alias("position", "entry"))
    return rows.select("changeset_id", "position", F.substring_index("entry", "\n", 1).alias("sha"), F.regexp_replace("entry", r"^[^\n]*\n?", "").alias("message"))
