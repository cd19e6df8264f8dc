"""What is moved and sorted: lines that can be made are made last, and columns that only break ties stay where they are."""

import pytest
from pyspark.sql import functions as F
from weftline.checkpoints import cut
from weftline.fixtures import made_lines, view, with_lines, without_lines
from weftline.operators import attribution, reconstruction
from weftline.plans import hierarchical, prompts, responses, strategies, validation
from weftline.queries import QUERIES
from weftline.sinks.patches import write_patches

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def hunks(spark):
    cols = "changeset_id long, hunk_id long, commit_id long, sha string, file_path string, old_start long, old_count long, new_start long, new_count long"
    made = [(1, 0, 1, "a", "x", 5, 2, 5, 0), (1, 3, 1, "a", "x", 1, 0, 1, 3), (1, 10, 2, "b", "y", 1, 0, 1, 0), (1, 2, 1, "a", "y", 9, 1, 9, 1), (2, 0, 3, "c", "x", 4, 3, 4, 0)]
    return spark.createDataFrame(made, cols)


def test_commit_diffs_without_moved_lines(hunks):
    assert rows(prompts.diff_contents(without_lines(hunks), made_lines)) == rows(prompts.diff_contents(with_lines(hunks)))


def test_patches_without_moved_lines(hunks):
    index = hunks.where("file_path = 'x'").select("changeset_id", "file_path")
    for known in (None, index):
        assert rows(write_patches(without_lines(hunks), ["changeset_id"], in_index=known, lines=made_lines)) == rows(write_patches(with_lines(hunks), ["changeset_id"], in_index=known))


def test_changes_without_moved_lines(spark, hunks):
    spec = '{"type": "partial", "hunk_id": %d, "lines": [%s]}'
    asked = [spec % (0, "1, 2"), spec % (0, "3"), spec % (77, "1"), spec % (10, "1"), spec % (10, ""), '{"type": "hunk", "id": 2}', '{"type": "raw", "file_path": "z", "diff": "+n\\n-o"}', spec % (3, "3, 1, 3")]
    text = '{"commits": [{"short_description": "s", "long_description": "", "changes": [%s]}]}' % ", ".join(asked)
    commits = responses.read_plans(spark.createDataFrame([(1, text), (2, text)], "changeset_id long, response string"))[0]
    slim, full = responses.convert_changes(commits, without_lines(hunks), made_lines), responses.convert_changes(commits, with_lines(hunks))
    assert rows(slim) == rows(full) and slim.count() == 16
    first = {r.change_pos: (r.hunk_id, r.error) for r in slim.where("changeset_id = 1").collect()}
    assert [first[i][1] for i in range(8)] == [None, "line out of range", "unknown hunk", "line out of range", None, None, None, None]
    assert [first[i][0] for i in (0, 5, 7)] == [11, 2, 17]


def test_only_the_first_sort_of_hunks_sees_what_breaks_ties(spark):
    plan = view(spark, SF, "hunks").select("changeset_id", "hunk_id", "file_path")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and "l_tax" in windows[1] and not any(c in windows[0] for c in ("l_tax", "l_discount", "l_extendedprice", "l_suppkey"))


@pytest.mark.parametrize("name", ["analysis_responses", "scored_responses"])
def test_answers_are_read_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("Generate explode(array(") >= 2


def test_files_commits_without_a_join(spark):
    made = [(1, 0, "x", "b", 1), (1, 1, "x", "a", 0), (1, 2, "y", "b", 1), (2, 0, "x", "c", 0)]
    hunks = spark.createDataFrame(made, "changeset_id long, hunk_id long, file_path string, sha string, position int")
    joined = attribution.attribute_by_file(hunks, attribution.file_to_commits(hunks))
    found = attribution.attribute_touched(hunks)
    assert rows(found.select(*joined.columns)) == rows(joined)
    commits = hunks.select("changeset_id", "sha", "position").distinct()
    extra = spark.createDataFrame([(3, 0, ["z"]), (3, 1, ["z", "y"]), (3, 2, [])], "changeset_id long, hunk_id long, likely_source_commits array<string>")
    got = attribution.source_commit(found.select(*extra.columns).union(extra), commits).collect()
    assert {tuple(r) for r in got} == {(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (2, 0, "c"), (3, 0, "z"), (3, 1, "z")} and len(got) == 6


@pytest.mark.parametrize("name", ["preserve_plan", "overlapping_hunks"])
def test_views_read_twice_are_made_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan


def test_files_without_moved_lines(spark, hunks):
    """Hunks of file x don't fit its text, so there are problems too."""
    slim = without_lines(hunks).withColumn("commit_pos", F.col("commit_id").cast("int")).withColumn("adjusted_start", F.col("old_start"))
    full = with_lines(hunks, "commit_id").withColumn("commit_pos", F.col("commit_id").cast("int")).withColumn("adjusted_start", F.col("old_start"))
    made = spark.createDataFrame([(1, "x", 7), (1, "same", 2), (2, "x", 6)], "changeset_id long, file_path string, n int")
    content = F.concat(F.repeat(F.lit("line\n"), F.col("n")), F.lit("end"))
    base = made.select("changeset_id", "file_path", content.alias("content"))
    kept = lambda df: df.where("hunk_id <> 3")
    whole, partly = reconstruction.rebuild(base, full), reconstruction.rebuild(base, kept(full))
    assert rows(reconstruction.rebuild(made, slim, lines=made_lines, content=content)) == rows(whole) and whole.where("size(problems) > 0").count() > 0
    wanted = rows(reconstruction.content_differences(whole, partly))
    assert rows(reconstruction.rebuilt_differences(made, slim, kept(slim), lines=made_lines, content=content)) == wanted and len(wanted) == 1
    assert rows(reconstruction.rebuilt_differences(base, full, kept(full))) == wanted


@pytest.mark.parametrize("name", ["rebuilt_files", "lost_hunks"])
def test_no_text_of_a_file_is_gathered_or_joined(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join FullOuter" in line]
    assert joins and all("concat(" not in line for line in plan[joins[0] :])


def test_no_check_of_a_written_plan_is_broadcast(spark):
    """Written views are small as files, so the planner would broadcast millions of rows of them."""
    plan = strategies.Plan(*(cut(view(spark, SF, n)) for n in ("planned", "changes", "deps")))
    hunks = cut(view(spark, SF, "hunks"))
    checks = validation.plan_checks(plan, hunks)
    checks[7] = validation.placed_hunks(plan.changes, hunks)  # the overlaps have small joins besides
    assert [i for i, found in enumerate(checks) if "Broadcast" in found._jdf.queryExecution().executedPlan().toString()] == []


def test_hunks_are_gathered_slim_and_meet_the_index_first(spark, hunks):
    index = hunks.where("file_path = 'x'").select("changeset_id", "file_path")
    plan = write_patches(without_lines(hunks), ["changeset_id"], in_index=index, lines=made_lines)._jdf.queryExecution().optimizedPlan().toString()
    gathered = next(line for line in plan.splitlines() if "collect_list" in line)
    assert gathered.count("hunk_id") == 2 and gathered.count("old_count") == 2, gathered  # a column and its name
    assert plan.index("collect_list") < plan.index("Join LeftOuter")
    assert "l_partkey" not in QUERIES["indexed_patches"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_prompts_without_moved_lines(spark, hunks):
    commits = spark.createDataFrame([(1, "a", 0, "s", "one\n\ntwo"), (1, "b", 1, "t", "t"), (2, "c", 0, "u", "u"), (3, "d", 0, "v", "no hunks")], "changeset_id long, sha string, position int, short string, long string")
    many = hunks.withColumn("old_count", F.col("old_count") * 150)  # so that one diff is cut
    asked = prompts.analysis_prompts(without_lines(many).withColumn("likely_source_commits", F.array("sha")), commits, made_lines)
    assert rows(asked) == rows(prompts.analysis_prompts(with_lines(many), commits)) and asked.count() == 5
    whole = prompts.assessment_prompts(commits, prompts.diff_contents(with_lines(many)))
    slim = prompts.assessment_prompts(commits, prompts.slim_contents(without_lines(many)), lines=made_lines)
    assert rows(slim) == rows(whole) and slim.count() == 4 and "-old 100 of 0" in str(rows(slim)) and "-old 300 of 0" not in str(rows(slim))


@pytest.mark.parametrize("name", ["analysis_prompts", "assessment_prompts"])
def test_prompts_join_no_diff(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "- old" not in plan and "concat(old " not in plan[plan.index("Join ") :]


def test_changes_with_their_analysis_are_not_joined_again(spark):
    plan = strategies.Plan(*(view(spark, SF, n) for n in ("planned", "changes")))
    analyses = cut(view(spark, SF, "analyses").withColumn("semantic_units", F.array("unit")))
    plan = strategies.Plan(cut(plan.commits), cut(plan.changes))
    told = strategies.Plan(plan.commits, cut(plan.changes.join(analyses.select("changeset_id", "hunk_id", "category", "file_path"), ["changeset_id", "hunk_id"])))
    for edges in (hierarchical.file_edges, hierarchical.commit_ranks):
        found = edges(told.changes, analyses)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and rows(found) == rows(edges(plan.changes, analyses))
