"""Stores of plans that grow by saves, and diff files read in many tasks."""

import os

from pyspark.sql import functions as F

from weftline.plans.strategies import Plan
from weftline.sinks import plan_files
from weftline.sources.diff import commit_hunks, parse_diff, read_diffs

SHA = ["a" * 40, "b" * 40, "c" * 40]


def _plan(spark, changeset, commits):
    heads = [(changeset, i, i, short, short) for i, (short, _) in enumerate(commits)]
    changes = [(changeset, i, i, k, "existing", h) for i, (_, hunks) in enumerate(commits) for k, h in enumerate(hunks)]
    return Plan(
        spark.createDataFrame(heads, "changeset_id long, commit_id long, commit_pos int, short string, long string"),
        spark.createDataFrame(changes, "changeset_id long, commit_id long, commit_pos int, change_pos int, kind string, hunk_id long"))


def _state(spark, path):
    plan, progress = plan_files.load_plans(spark, path)
    return sorted((r.changeset_id, r.commit_pos, r.short) for r in plan.commits.collect()), dict(sorted((r.changeset_id, r.next_index) for r in progress.collect()))


def test_saves_of_different_change_sets_lie_beside_each_other(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert _state(spark, path) == ([], {})
    plan_files.save_plans(_plan(spark, 1, [("First", [0]), ("Second", [1]), ("Third", [2])]), "by-file", path)
    before = {f: (tmp_path / "store" / f).stat().st_mtime_ns for f in os.listdir(path)}
    plan_files.save_plans(_plan(spark, 2, [("Other", [0])]), "squash", path)
    assert before.items() <= {f: (tmp_path / "store" / f).stat().st_mtime_ns for f in os.listdir(path)}.items()
    both = [(1, 0, "First"), (1, 1, "Second"), (1, 2, "Third"), (2, 0, "Other")]
    assert _state(spark, path) == (both, {1: 0, 2: 0})
    made = lambda *rows: plan_files.save_progress(spark.createDataFrame(rows, "changeset_id long, commit_pos int, created_sha string"), path)
    made((1, 0, SHA[0]))
    made((1, 1, SHA[1]), (7, 0, SHA[2]))
    assert _state(spark, path) == (both, {1: 2, 2: 0})
    # A save that broke off is not read.
    broken = tmp_path / "store" / f"plans-{'9' * 20}-x"
    broken.mkdir()
    (broken / "part-0.txt").write_text('{"changeset_id":1,"version":1,"strategy":"squash","next_commit_index":0,"commits":[]}\n')
    assert _state(spark, path) == (both, {1: 2, 2: 0})
    plan_files.compact(spark, path)
    assert _state(spark, path) == (both, {1: 2, 2: 0}) and len(plan_files._saves(spark, path, "plans")) == 1 and not plan_files._saves(spark, path, "progress")
    stored = plan_files._latest(spark, path, "plans").where("changeset_id = 1").select(F.from_json("stored", plan_files.STORED).alias("p")).first().p
    assert [c.created_sha for c in stored.commits] == [SHA[0], SHA[1], None]
    # A new plan of a change set begins anew, and leaves the others as they are.
    plan_files.save_plans(_plan(spark, 1, [("Anew", [0, 1, 2])]), "squash", path)
    assert _state(spark, path) == ([(1, 0, "Anew"), (2, 0, "Other")], {1: 0, 2: 0})


def _file(name, hunks, lines=1):
    body = "".join(f"@@ -{10 * k + 1},0 +{10 * k + 1},{lines} @@\n" + "".join(f"+{name} {k} {i} commit {SHA[2]}\n" for i in range(lines)) for k in range(hunks))
    return f"diff --git a/{name} b/{name}\nindex 1..2 100644\n--- a/{name}\n+++ b/{name}\n{body}"


def test_a_log_of_several_commits_is_read_in_many_tasks(spark, tmp_path):
    head = lambda sha: f"commit {sha}\nAuthor: A <a@b>\n\n    Message\n    diff --git in a message\n\n"
    names = [[f"d{i}/f{i}.txt" for i in range(40)], [], ["huge.txt", "last.txt"]]
    log = head(SHA[0]) + "".join(_file(n, 2) for n in names[0]) + "\n" + head(SHA[1]) + "\n" + head(SHA[2]) + _file("huge.txt", 3, 4000) + _file("last.txt", 1)
    (tmp_path / "log.diff").write_text(log)
    (tmp_path / "plain.diff").write_text(_file("x", 1) + _file("y", 2))
    (tmp_path / "empty.diff").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = read_diffs(spark, str(tmp_path))
        got = [(os.path.basename(r.path), r.sha, r.diff_text.split("\n")[0].split(" b/")[-1]) for r in rows.orderBy("path", "file_no").collect()]
        assert got == [("log.diff", SHA[0] if n != "huge.txt" and n != "last.txt" else SHA[2], n) for part in names for n in part] + [("plain.diff", None, "x"), ("plain.diff", None, "y")]
        assert spark.read.option("lineSep", "\ndiff --git ").text(f"{tmp_path}/log.diff").rdd.getNumPartitions() > 10
        hunks = commit_hunks(rows.where("sha is not null"), 5)
        found = [(r.sha, r.hunk_id, r.file_path, len(r.lines), r.likely_source_commits) for r in hunks.orderBy("sha", "hunk_id").collect()]
        want = [(SHA[0], 5 + 2 * i + k, n, 1, [SHA[0]]) for i, n in enumerate(names[0]) for k in range(2)]
        assert found == want + [(SHA[2], 5 + k, "huge.txt", 4000, [SHA[2]]) for k in range(3)] + [(SHA[2], 8, "last.txt", 1, [SHA[2]])]
        plain = parse_diff(rows.where("sha is null"))
        whole = parse_diff(spark.createDataFrame([(1, (tmp_path / "plain.diff").read_text())], "changeset_id long, diff_text string"))
        same = lambda p: [r.asDict() for r in p.hunks.drop("changeset_id").orderBy("hunk_id").collect()]
        assert same(plain) == same(whole) and len(same(whole)) == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
