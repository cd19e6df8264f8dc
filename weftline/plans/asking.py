"""Asking a model: a caller's function over prompts, with tries, or answers recorded before."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import ensure_folder
from ..functions.rubric import CRITERIA
from ..functions.text import response_path, trim_space
from .assessment import commit_scores, criterion_stats, parse_responses, range_scores
from .prompts import analysis_prompts, assessment_prompts, diff_contents, plan_prompts
from .responses import plan_from_responses, read_analyses
from .strategies import Plan

#: Tries of a plan or an assessment, and of a hunk's analysis; seconds before the second try of that, doubled each time.
TRIES, ANALYSIS_TRIES, WAIT = 3, 5, 0.2
#: Prompts in flight at most, over all executors.
AT_ONCE = 8
Model = Callable[[str], str]


def has_json(answer: str) -> bool:
    return 0 <= answer.find("{") < answer.rfind("}")


def ask(prompts: DataFrame, model: Model, tries: int = TRIES, wait: float = 0.0, good: Callable[[str], bool] = has_json,
        log: str | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """``prompts`` with response (null if no try gave a good one), error of the last try, and tries made.

    The model is asked now, once for each distinct prompt, and what it said is kept in the Parquet folder ``log`` (one of its
    own in the shared checkpoint folder if none is named), so later actions read answers and a later call with the same log
    asks only what has no good answer yet. At most ``at_once`` prompts are in flight, over all executors: so many
    partitions ask, one prompt after the other. What a lost task has asked and not yet written is asked again.
    """
    spark = prompts.sparkSession
    if log is None:
        ensure_folder(spark)
        log = f"{spark.sparkContext.getCheckpointDir()}/answers-{uuid.uuid4().hex}"
    named = prompts.withColumn("__digest", F.sha2(F.coalesce("prompt", F.lit("")), 256))
    schema = "__digest string, response string, error string, tries int"

    def once(prompt: str) -> tuple[str | None, str | None, int]:
        error = None
        for n in range(1, tries + 1):
            if n > 1 and wait:
                time.sleep(wait * 2 ** (n - 2))
            try:
                answer = model(prompt)
            except Exception as e:  # whatever a caller's model raises counts as a failed try
                error = f"model error: {e}"
                continue
            if good(answer):
                return answer, None, n
            error = "no JSON found"
        return None, error, tries

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [once(p) for p in part["prompt"]]
            yield pd.DataFrame({"__digest": part["__digest"], "response": [f[0] for f in found], "error": [f[1] for f in found], "tries": [f[2] for f in found]})

    wanted = named.groupBy("__digest").agg(F.first("prompt").alias("prompt"))
    if _exists(spark, log):
        wanted = wanted.join(spark.read.schema(schema).parquet(log).where("response is not null"), "__digest", "left_anti")
    wanted.select("__digest", F.coalesce("prompt", F.lit("")).alias("prompt")).repartition(at_once).mapInPandas(run, schema).write.mode("append").parquet(log)
    # Of several entries a good one holds.
    best = F.max(F.struct(F.col("response").isNotNull().alias("good"), "tries", "response", "error")).alias("best")
    said = spark.read.schema(schema).parquet(log).groupBy("__digest").agg(best)
    return named.join(said, "__digest", "left").select(*prompts.columns, "best.response", "best.error", "best.tries")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _real_path(paths: pd.Series) -> pd.Series:
    """Paths with links resolved, as the shared folder is mounted on the executors."""
    return paths.map(os.path.realpath, na_action="ignore")


def answers_in_files(asked: DataFrame, folders: tuple[str, ...]) -> DataFrame:
    """``asked``, whose response names a JSON file, with that file's text as the response, or an error.

    ``folders`` are shared by all executors; one read lists what lies under them, and a response's path meets it by a join.
    So only files under these folders are ever read, and a link that leads out of them isn't followed.
    """
    spark = asked.sparkSession
    roots = [os.path.realpath(f) for f in folders if os.path.isdir(f)]
    told = asked.withColumn("__path", response_path("response")).withColumn("__real", F.pandas_udf(_real_path, "string")("__path"))
    under = F.exists(F.array(*map(F.lit, roots)).cast("array<string>"), lambda r: F.startswith(F.col("__real"), F.concat(r, F.lit("/"))))
    if roots:
        read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text([f"file://{r}" for r in roots], wholetext=True)
        name = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
        files = read.select(name.alias("__file"), F.col("value").alias("__text")).dropDuplicates(["__file"])
    else:
        files = spark.createDataFrame([], "__file string, __text string")
    found = told.join(files, under & (F.col("__real") == F.col("__file")), "left")
    empty = F.length(trim_space(F.col("__text"))) == 0
    why = (
        F.when(F.col("response").isNull(), F.col("error") if "error" in asked.columns else F.lit("no response")).when(F.col("__path").isNull(), "no file path in the response")
        .when(~under, F.concat(F.lit("not under an allowed folder: "), F.col("__real"))).when(F.col("__file").isNull(), F.concat(F.lit("no such file: "), F.col("__path")))
        .when(F.col("__text").isNull() | empty, F.concat(F.lit("empty file: "), F.col("__path")))
    )
    return found.withColumn("error", why).withColumn("response", F.when(F.col("error").isNull(), F.col("__text"))).drop("__path", "__real", "__file", "__text")


def label_hunks(hunks: DataFrame, commits: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """(analyses, errors) of every hunk."""
    asked = ask(analysis_prompts(hunks, commits), model, ANALYSIS_TRIES, WAIT)
    return read_analyses(asked.select("changeset_id", "hunk_id", "file_path", F.coalesce("response", F.lit("")).alias("response")))


def plan_with(hunks: DataFrame, commits: DataFrame, model: Model) -> Plan:
    """The plan that a model makes of each change set in one answer."""
    asked = ask(plan_prompts(hunks, commits), model).where("response is not null")
    return plan_from_responses(asked.select("changeset_id", "response"), hunks)


@dataclass(frozen=True)
class RangeAssessment:
    """``scores`` (one row a commit and criterion), ``commits`` (overall), ``criteria`` (mean, least, most, sigma), ``overall`` and ``errors``."""

    scores: DataFrame
    commits: DataFrame
    criteria: DataFrame
    overall: DataFrame
    errors: DataFrame


def assess_range(commits: DataFrame, hunks: DataFrame, model: Model | None = None, answers: DataFrame | None = None, criteria: tuple[str, ...] = CRITERIA) -> RangeAssessment:
    """Every commit of every change set scored by a model, or by recorded ``answers`` (changeset_id, sha, response), and summed up.

    A change set without commits has the overall score 0; a commit without a good answer is in ``errors``.
    """
    if (model is None) == (answers is None):
        raise ValueError("give a model or recorded answers")
    if answers is None:
        asked = ask(assessment_prompts(commits, diff_contents(hunks), criteria), model)
        answers = asked.select("changeset_id", "sha", F.coalesce("response", F.lit("")).alias("response"))
    scores, errors = parse_responses(answers, criteria)
    overall = commit_scores(scores)
    sets = commits.select("changeset_id").union(hunks.select("changeset_id")).distinct()
    return RangeAssessment(scores, overall, criterion_stats(scores), range_scores(overall, sets), errors)


