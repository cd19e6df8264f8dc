"""Assessment reports, one text for each change set, in four formats each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rubric import CRITERIA, LEVEL_TEXTS, LEVELS, TITLES, place
from ..functions.text import short_sha
from ..plans.assessment import changed_notes, commit_scores, compact_report, compare_ranges, criterion_stats, percent, range_scores

FORMATS = ("pretty", "json", "markdown", "compact")
#: Width of a rubric box's cell, and the escape codes of a level that is reached and of a title.
BOX_WIDTH, HIT, BOLD = 24, "\x1b[42;30m{}\x1b[0m", "\x1b[1m{}\x1b[0m"
#: Headings and table heads of the reports.
SUMMARY_HEAD = "| Criterion | Mean | Min | Max | Std Dev |\n|-----------|------|-----|-----|--------|\n"
LEVEL_HEAD = "| Criterion | Level |\n|-----------|-------|\n"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _check(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")


def _joined(rows: DataFrame, keys: list[str], order: list[str], text: Column, name: str) -> DataFrame:
    """Texts of a group, concatenated in ``order``."""
    listed = F.array_sort(F.collect_list(F.struct(*order, text.alias("__t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["__t"]), "").alias(name))


def range_report(scores: DataFrame, commits: DataFrame, ends: DataFrame, fmt: str = "pretty", verbose: bool = False) -> DataFrame:
    """(changeset_id, report). ``scores``: changeset_id, sha, criterion, level and, if verbose, rationale; ``commits``:
    changeset_id, sha, position, short; ``ends``: changeset_id, base_sha, head_sha."""
    _check(fmt)
    if fmt == "compact":
        return compact_report(scores, commits)
    overall = commit_scores(scores)
    stats = criterion_stats(scores).withColumn("title", _lookup(TITLES, F.col("criterion")))
    rows = scores.withColumn("place", place("criterion")).withColumn("rationale", F.coalesce("rationale", F.lit("")) if "rationale" in scores.columns else F.lit(""))
    head = ends.join(range_scores(overall), "changeset_id")
    own = overall.join(commits.select("changeset_id", "sha", "position", "short"), ["changeset_id", "sha"])
    if fmt == "json":
        levels = F.array_sort(F.collect_list(F.struct("place", "criterion", "level", "rationale")))
        parts = rows.groupBy("changeset_id", "sha").agg(F.transform(levels, lambda x: x.dropFields("place")).alias("criterion_scores"))
        each = own.join(parts, ["changeset_id", "sha"])
        each = each.groupBy("changeset_id").agg(F.array_sort(F.collect_list(F.struct("position", "sha", "short", "overall", "criterion_scores"))).alias("commits"))
        sums = stats.groupBy("changeset_id").agg(F.array_sort(F.collect_list(F.struct("criterion", "mean", "least", "most", "sigma"))).alias("criteria"))
        whole = head.join(sums, "changeset_id").join(each, "changeset_id")
        return whole.select("changeset_id", F.to_json(F.struct("base_sha", "head_sha", "overall", "criteria", "commits"), {"pretty": "true"}).alias("report"))
    span = F.concat(short_sha("base_sha"), F.lit(".."), short_sha("head_sha"))
    share = F.format_string("%.1f%%", percent("overall"))
    if fmt == "markdown":
        top = F.concat(F.lit("# Commit Assessment Report\n\n**Range**: `"), span, F.lit("`\n**Overall Score**: "), share, F.lit("\n\n## Summary\n\n" + SUMMARY_HEAD))
        line = F.format_string("| %s | %.1f | %d | %d | %.2f |\n", "title", "mean", "least", "most", "sigma")
        level = F.format_string("| %s | %d |\n", "criterion", "level")
        opening = F.concat(F.lit("### `"), short_sha("sha"), F.lit("` "), F.col("short"), F.lit("\n\n**Score**: "), share, F.lit("\n\n" + LEVEL_HEAD))
        middle, extra = "\n## Commits\n\n", F.format_string("**%s**: %s\n\n", "criterion", "rationale")
    else:
        top = F.concat(F.lit("Assessment: "), span, F.lit("\nOverall Score: "), share, F.lit("\n\nAggregate Scores:\n"))
        line = F.format_string("  %s: %.1f (min: %d, max: %d, std: %.2f)\n", "title", "mean", "least", "most", "sigma")
        level = F.concat(_boxes(), F.lit("\n"))
        opening = F.concat(F.lit("\n"), short_sha("sha"), F.lit(" "), F.col("short"), F.lit(" ("), share, F.lit(")\n\n"))
        middle, extra = "\nCommits:\n", F.format_string("    %s\n", "rationale")
    lines = _joined(stats, ["changeset_id"], ["title"], line, "lines")
    levels = _joined(rows, ["changeset_id", "sha"], ["place"], level, "levels").join(
        _joined(rows, ["changeset_id", "sha"], ["place"], extra, "extra"), ["changeset_id", "sha"])
    block = F.concat(opening, F.col("levels"), F.lit("\n"), F.col("extra") if verbose else F.lit(""))
    blocks = _joined(own.join(levels, ["changeset_id", "sha"]), ["changeset_id"], ["position"], block, "blocks")
    whole = head.withColumn("top", top).join(lines, "changeset_id").join(blocks, "changeset_id")
    return whole.select("changeset_id", F.concat("top", "lines", F.lit(middle), "blocks").alias("report"))


def comparison_report(before: DataFrame, after: DataFrame, fmt: str = "pretty") -> DataFrame:
    """(changeset_id, report) of two tables of scores; change sets that only one side has are left out."""
    _check(fmt)
    both = range_scores(commit_scores(before)).withColumnRenamed("overall", "b").join(
        range_scores(commit_scores(after)).withColumnRenamed("overall", "a"), "changeset_id")
    notes = changed_notes(compare_ranges(criterion_stats(before), criterion_stats(after)))
    rows = both.join(notes, "changeset_id", "left").withColumn("delta", F.round(F.col("a") - F.col("b"), 6))
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("improvements", F.coalesce("improvements", empty)).withColumn("regressions", F.coalesce("regressions", empty))
    if fmt == "json":
        return rows.select("changeset_id", F.to_json(F.struct(F.col("b").alias("before"), F.col("a").alias("after"), "delta", "improvements", "regressions"), {"pretty": "true"}).alias("report"))
    written = lambda c: F.format_string("%.1f%%", percent(c))
    change = F.concat(F.when(F.col("delta") > 0, "+").when(F.col("delta") < 0, "-").otherwise(""), written(F.abs("delta")))
    if fmt == "compact":
        return rows.select("changeset_id", F.concat(written("b"), F.lit(" -> "), written("a"), F.lit(" ("), change, F.lit(")")).alias("report"))

    def section(title: str, column: str, mark: str, end: str) -> Column:
        listed = F.array_join(F.transform(column, lambda x: F.concat(F.lit(mark), x, F.lit("\n"))), "")
        return F.when(F.size(column) > 0, F.concat(F.lit(title), listed, F.lit(end))).otherwise("")

    if fmt == "markdown":
        top = F.concat(F.lit("# Assessment Comparison\n\n**Before**: "), written("b"), F.lit("\n**After**: "), written("a"), F.lit("\n**Change**: "), change, F.lit("\n\n"))
        parts = section("## Improvements\n\n", "improvements", "- ", "\n"), section("## Regressions\n\n", "regressions", "- ", "")
    else:
        top = F.concat(F.lit("Assessment Comparison\n\nBefore: "), written("b"), F.lit(" -> After: "), written("a"), F.lit(" ("), change, F.lit(")\n\n"))
        parts = section("Improvements:\n", "improvements", "  + ", "\n"), section("Regressions:\n", "regressions", "  - ", "\n")
    return rows.select("changeset_id", F.concat(top, *parts).alias("report"))


def wrap_words(text: str, width: int) -> list[str]:
    """Lines of whole words, as many as fit; a word longer than a line is cut where it begins one, an empty text is one empty line."""
    lines = [""]
    for word in text.split():
        if not lines[-1]:
            lines[-1] = word[:width]
            if len(word) > width:
                lines.append("")
        elif len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return lines if len(lines) == 1 or lines[-1] else lines[:-1]


def rubric_box(criterion: str, level: int) -> str:
    """The levels of a criterion side by side, the one reached in colour."""
    cells = [[str(n), *wrap_words(text, BOX_WIDTH - 2)] for n, text in zip(LEVELS, LEVEL_TEXTS[criterion])]
    height = max(map(len, cells))
    rule = lambda left, middle, right: left + middle.join(["─" * BOX_WIDTH] * len(cells)) + right + "\n"

    def row(k: int) -> str:
        texts = [(c[k] if k < len(c) else "").center(BOX_WIDTH) for c in cells]
        return "│" + "│".join(HIT.format(t) if n == level else t for n, t in zip(LEVELS, texts)) + "│\n"

    head = BOLD.format(TITLES[criterion]) + f" (Level {level})\n"
    return head + rule("┌", "┬", "┐") + row(0) + rule("├", "┼", "┤") + "".join(row(k) for k in range(1, height)) + rule("└", "┴", "┘")


def _boxes() -> Column:
    """The box of (criterion, level): one of 25 constant texts."""
    return F.create_map(*[F.lit(x) for c in CRITERIA for n in LEVELS for x in (f"{c}:{n}", rubric_box(c, n))])[F.concat_ws(":", "criterion", F.col("level").cast("string"))]
