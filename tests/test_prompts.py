"""What models are asked, and assessments from end to end."""

import json
import uuid

import pytest
from pyspark.sql import functions as F
from weftline.functions.rubric import CRITERIA, LEVEL_TEXTS
from weftline.plans import asking, hierarchical, prompts, responses, validation
from weftline.plans.strategies import Plan
from weftline.schemas import ANALYSIS, COMMIT, HUNK, PLAN_CHANGE, PLAN_COMMIT
from weftline.sinks import plan_files, reports

SHA = [f"{i}" * 40 for i in range(3)]


@pytest.fixture
def hunks(spark):
    line = lambda n: {"type": "added", "content": f"line {n}"}
    rows = [(1, i, f"dir/f{i % 2}", 5 * i, 0, 5 * i, 12, [line(n) for n in range(12)], [SHA[i % 3][:7]], False, False) for i in range(4)]
    return spark.createDataFrame(rows, HUNK)


@pytest.fixture
def commits(spark):
    return spark.createDataFrame([(1, i, SHA[i], f"Subject {i}", f"Subject {i}\n\nBody {i}") for i in range(2)], COMMIT)


@pytest.fixture
def plan(spark):
    rows = [(1, 0, 0, "First", "why first"), (1, 1, 1, "Second", "")]
    changes = [(1, 0, 0, 0, "existing", 0), (1, 1, 1, 0, "existing", 0), (1, 1, 1, 1, "existing", 1)]
    return Plan(spark.createDataFrame(rows, PLAN_COMMIT), spark.createDataFrame(changes, PLAN_CHANGE))


@pytest.fixture
def analyses(spark):
    return spark.createDataFrame([(1, i, ("feature", "test")[i % 2], [f"unit {i}", "more"], "topic", None, f"dir/f{i % 2}") for i in range(4)], ANALYSIS)


def test_plan_prompts(spark, hunks, commits):
    text = prompts.plan_prompts(hunks, commits).first().prompt
    assert f"Commit {SHA[1][:8]}\nSubject 1\n\nBody 1\n" in text
    assert "Hunk 1 of dir/f1 (old line 5, new line 5)\nfrom 1111111: Subject 1\n```diff\n+line 0\n" in text
    assert "from 2222222: (unknown)\n" in text and text.index("Hunk 0 of") < text.index("Hunk 3 of")
    filed = prompts.plan_prompts(hunks, commits, spark.createDataFrame([(1, "/tmp/h")], "changeset_id long, path string")).first().prompt
    assert "The hunks are in /tmp/h\n" in filed and "+line 0" not in filed
    assert prompts.hunk_files(hunks, commits).first().content.count("```diff") == 4


def test_prompts_for_fixes(spark, hunks, commits, plan):
    text = prompts.unassigned_prompts(plan, hunks, commits).first().prompt
    assert "Hunk 2 of dir/f0" in text and "Hunk 3 of dir/f1" in text and "Hunk 0 of" not in text and "Commit 0: First\nwhy first\n" in text
    row = prompts.duplicate_prompts(plan, hunks).first()
    assert row.hunk_id == 0 and "Commit 0: First" in row.prompt and "Commit 1: Second" in row.prompt and '{"hunk_id": 0,' in row.prompt
    close = hunks.withColumn("old_start", F.lit(1).cast("long")).withColumn("old_count", F.lit(9).cast("long")).withColumn("file_path", F.lit("one"))
    apart = Plan(plan.commits, plan.changes.where("not (commit_id = 1 and hunk_id = 0)"))
    row = prompts.overlap_prompts(apart, close).first()
    assert (row.hunk_a, row.hunk_b) == (0, 1) and "Two hunks of one overlap" in row.prompt and "Commit 1: Second" in row.prompt
    scores = spark.createDataFrame([(1, "0", c, 2, "because", ["more context"]) for c in CRITERIA], "changeset_id long, sha string, criterion string, level int, rationale string, suggestions array<string>")
    row = prompts.message_prompts(plan, scores, hunks).first()
    assert row.commit_id == 0 and "Score: 40.0%\nAtomicity, level 2 of 5: because\n- more context\n" in row.prompt and "dir/f0, hunk 0\n```diff" in row.prompt
    real = scores.withColumn("sha", F.lit(SHA[0]))
    row = prompts.reword_prompts(commits, real, spark.createDataFrame([(1, SHA[0], "+x")], "changeset_id long, sha string, diff string")).first()
    assert row.sha == SHA[0] and f"commit {SHA[0][:8]}" in row.prompt and "```diff\n+x\n```" in row.prompt


def test_prompts_for_clusters(hunks, commits, analyses, plan):
    rows = {r.hunk_id: r.prompt for r in prompts.analysis_prompts(hunks, commits).collect()}
    assert len(rows) == 4 and "Source commit: Subject 1\n\nBody 1\n" in rows[1] and "Source commit" not in rows[2] and "dir/f1, lines 5 to 5\n" in rows[1]
    assert "Hunk 3, dir/f1 (test): unit 3, more\n" in prompts.relation_prompts(analyses).first().prompt
    row = prompts.commit_prompts(hierarchical.topic_clusters(analyses), analyses, hunks).first()
    assert "Topic: topic\nCategories: feature, test\n" in row.prompt and "+line 9\n" in row.prompt and "+line 10" not in row.prompt
    assert "So far: First\n\ndir/f0 (feature): unit 0, more\n" in {r.commit_id: r.prompt for r in prompts.repair_prompts(plan, analyses).collect()}[0]


def test_context_is_capped(spark):
    many = spark.createDataFrame([(1, i, f"{i:040d}", f"S{i}", "m") for i in range(15)], COMMIT)
    text = {r.sha: r.prompt for r in prompts.assessment_prompts(many, spark.createDataFrame([], "changeset_id long, sha string, diff string")).collect()}[f"{7:040d}"]
    assert text.count("/15 ") == 10 and "and 4 more from 00000000 to 00000000\n" in text and ", 8 of 15\n" in text
    assert all(t in text for c in CRITERIA for t in LEVEL_TEXTS[c])


def test_models_are_asked_again(spark):
    asked = spark.createDataFrame([(1, "good"), (2, "never"), (3, "raise")], "changeset_id long, prompt string")

    def model(prompt):
        if prompt == "raise":
            raise RuntimeError("no line")
        return '{"a": 1}' if prompt == "good" else "nothing"

    got = {r.changeset_id: (r.response, r.error, r.tries) for r in asking.ask(asked, model).collect()}
    assert got == {1: ('{"a": 1}', None, 1), 2: (None, "no JSON found", 3), 3: (None, "model error: no line", 3)}


def test_answers_in_files(spark, tmp_path, monkeypatch):
    kept, other = tmp_path / "kept", tmp_path / "other"
    for folder in (kept, other, tmp_path / "temp"):
        folder.mkdir()
        (folder / "a.json").write_text('{"a": "ä"}')
    (kept / "empty.json").write_text(" \n")
    (kept / "link.json").symlink_to(other / "a.json")
    (tmp_path / "keptother").mkdir()
    (tmp_path / "keptother" / "a.json").write_text("{}")
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path / "temp"))
    printed = {f"Done.\n  {kept}/a.json \n{other}/a.json": None, f"{tmp_path}/temp/a.json": None, "": "no file path", "a.json": "no file path",
               f"{kept}/none.json": "no such file", f"{kept}/empty.json": "empty file"}
    printed |= dict.fromkeys((f"{other}/a.json", f"{kept}/../other/a.json", f"{kept}/link.json", f"{tmp_path}/keptother/a.json"), "not under an allowed folder")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(printed)], "changeset_id long, response string")
    got = asking.answers_in_files(asked, (str(kept), str(tmp_path / "missing"), str(tmp_path / "temp"))).collect()
    assert len(got) == len(printed)
    for r, why in zip(sorted(got), printed.values()):
        assert (r.response, r.error) == ('{"a": "ä"}', None) if why is None else r.response is None and r.error.startswith(why)
    assert {r.error[:12] for r in asking.answers_in_files(asked, ()).collect()} == {"no file path", "not under an"}


def test_each_prompt_is_asked_once(spark, tmp_path):
    calls, fails = tmp_path / "calls", tmp_path / "fails"
    calls.mkdir()

    def model(prompt):
        (calls / uuid.uuid4().hex).write_text(prompt)
        if prompt == "p3" and fails.exists():
            raise OSError("gone")
        return "{}"

    fails.touch()
    df = spark.createDataFrame([(i, f"p{i % 5}") for i in range(40)], "changeset_id long, prompt string").repartition(6)
    log = f"{tmp_path}/log"
    asked = asking.ask(df, model, tries=2, log=log, at_once=3)
    assert asked.count() == 40 and asked.where("response is null").count() == 8 and {r.tries for r in asked.collect()} == {1, 2}
    assert sorted(p.read_text() for p in calls.iterdir()) == ["p0", "p1", "p2", "p3", "p3", "p4"]
    fails.unlink()
    again = asking.ask(df, model, tries=2, log=log, at_once=3)
    assert again.where("response is null").count() == 0 and len(list(calls.iterdir())) == 7


def test_labels_and_plans_from_a_model(hunks, commits):
    good, errors = asking.label_hunks(hunks, commits, lambda p: json.dumps({"category": "feature", "semantic_units": ["u"], "topic": "A Topic"}))
    assert good.count() == 4 and errors.isEmpty() and good.first().topic == "a_topic"
    made = asking.plan_with(hunks, commits, lambda p: json.dumps({"commits": [{"short_description": "All", "long_description": "", "changes": [{"type": "hunk", "id": i} for i in range(4)]}]}))
    assert [r.short for r in made.commits.collect()] == ["All"] and made.changes.count() == 4


def test_assessment_from_end_to_end(spark, hunks, commits, tmp_path):
    level = lambda p: 5 if "Commit 00000000" in p else 3
    model = lambda p: json.dumps({"scores": [{"criterion": c, "level": level(p), "rationale": "r", "evidence": ["e"]} for c in CRITERIA]})
    own = hunks.withColumn("sha", F.concat(F.repeat(F.substring(F.col("likely_source_commits")[0], 1, 1), F.lit(40))))
    found = asking.assess_range(commits, own, model)
    assert {r.sha[:1]: round(r.overall, 6) for r in found.commits.collect()} == {"0": 1.0, "1": 0.6} and found.errors.isEmpty()
    assert round(found.overall.first().overall, 6) == 0.8 and {r.criterion: r["mean"] for r in found.criteria.collect()} == dict.fromkeys(CRITERIA, 4.0)
    with pytest.raises(ValueError):
        asking.assess_range(commits, own)
    ends = spark.createDataFrame([(1, "b" * 9, "h" * 9), (2, "b", "h")], "changeset_id long, base_sha string, head_sha string")
    plan_files.save_assessments(plan_files.stored_assessments(found.scores, commits, ends, "2024-01-01T00:00:00Z"), f"{tmp_path}/a.json")
    ranges, scores = plan_files.load_assessments(spark, f"{tmp_path}/a.json")
    assert {r.changeset_id: (r.head_sha, round(r.overall, 6)) for r in ranges.collect()} == {1: ("h" * 9, 0.8), 2: ("h", 0.0)}
    assert sorted((r.sha, r.criterion, r.level, r.evidence) for r in scores.collect()) == sorted((r.sha, r.criterion, r.level, r.evidence) for r in found.scores.collect())
    (tmp_path / "x.json").write_text("{}")
    (tmp_path / "y.txt").write_text("{}")
    assert [r.path.rsplit("/", 1)[1] for r in plan_files.list_stored(spark, str(tmp_path)).collect()] == ["x.json"]
    assert plan_files.list_stored(spark, f"{tmp_path}/none").count() == 0
    assert plan_files.delete_stored(spark, f"{tmp_path}/x.json") and not plan_files.delete_stored(spark, f"{tmp_path}/x.json")


def test_rubric_boxes(spark):
    box = reports.rubric_box("atomicity", 2).split("\n")
    assert box[0] == "\x1b[1mAtomicity\x1b[0m (Level 2)" and box[1] == "┌" + "┬".join(["─" * 24] * 5) + "┐"
    plain = [line.replace("\x1b[42;30m", "").replace("\x1b[0m", "") for line in box[2:-1]]
    assert all(len(line) == 126 for line in plain) and plain[0].split("│")[1:-1] == [str(n).center(24) for n in range(1, 6)]
    for k, text in enumerate(LEVEL_TEXTS["atomicity"], 1):
        assert " ".join(" ".join(line.split("│")[k].strip() for line in plain[2:-1]).split()) == text
    assert all(line.count("\x1b[42;30m") == 1 for line in (box[2], *box[4:-2]))
    scores = spark.createDataFrame([(1, SHA[0], c, 2) for c in CRITERIA], "changeset_id long, sha string, criterion string, level int")
    commits = spark.createDataFrame([(1, SHA[0], 0, "Do it")], "changeset_id long, sha string, position int, short string")
    ends = spark.createDataFrame([(1, "b" * 12, "h" * 12)], "changeset_id long, base_sha string, head_sha string")
    assert all(reports.rubric_box(c, 2) in reports.range_report(scores, commits, ends).first().report for c in CRITERIA)


def test_issues_by_kind(spark, plan, hunks):
    found = validation.validate_plan(plan, hunks).unionByName(validation.failed_assessments(spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.9)], "changeset_id long, commit_id long, overall double"), 0.5))
    assert [(r.hunk_id, r.commit_ids) for r in validation.issues_of(found, "DuplicateHunkAcrossCommits").collect()] == [(0, [0, 1])]
    assert [r.hunk_ids for r in validation.issues_of(found, "UnassignedHunks").collect()] == [[2, 3]]
    assert [r.commit_id for r in validation.issues_of(found, "FailedAssessment").collect()] == [0]
    assert {r.issue_type for r in validation.model_fixable(found).collect()} == {"DuplicateHunkAcrossCommits", "UnassignedHunks", "FailedAssessment"}
