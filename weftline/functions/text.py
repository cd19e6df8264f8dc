"""Column functions over text. All stay in the JVM; lengths are code points unless bytes are named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest subject line in bytes, shortest one, and bytes of a diff that a scorer is shown.
MAX_SUBJECT, MIN_SUBJECT, MAX_DIFF = 72, 5, 3000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c: Column | str) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def short_sha(sha: Column | str) -> Column:
    return F.left(col(sha), F.lit(8))


def path_key(path: Column | str) -> Column:
    """Sort key by path component, so that ``a/b`` comes before ``a-b/x``."""
    return F.split(col(path), "/")


def file_name(path: Column | str) -> Column:
    """The last component, or the whole path if that is empty."""
    last = F.element_at(F.split(F.regexp_replace(col(path), "/+$", ""), "/"), -1)
    return F.coalesce(F.when(last != "", last), col(path))


def format_lines(lines: Column | str) -> Column:
    """Lines with their signs, newline-joined."""
    sign = lambda x: F.when(x["type"] == "added", "+").when(x["type"] == "removed", "-").otherwise(" ")
    return F.array_join(F.transform(col(lines), lambda x: F.concat(sign(x), x["content"])), "\n")


def render_message(short: Column | str, long: Column | str) -> Column:
    """A commit message: the subject alone, the body if it begins with the subject, else both."""
    subject, body = trim_space(short), trim_space(long)
    return (
        F.when((body == "") | (body == subject), subject)
        .when(F.startswith(col(long), subject), col(long))
        .otherwise(F.concat(subject, F.lit("\n\n"), body))
    )


def normalize_topic(topic: Column | str) -> Column:
    return F.regexp_replace(F.translate(F.lower(col(topic)), " -", "__"), r"[^\p{L}\p{N}_]", "")


def capitalize_first(text: Column | str) -> Column:
    c = col(text)
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))


def fallback_subject(units: Column | str) -> Column:
    """A subject made of the first three of an ordered list of semantic units."""
    first = F.slice(col(units), 1, 3)
    rest = F.array_join(F.slice(first, 2, 2), ", ")
    head = capitalize_first(F.get(first, F.lit(0)))
    return F.when(F.size(first) == 0, F.lit("Update code")).when(F.size(first) == 1, head).otherwise(F.concat(head, F.lit(" and "), rest))


def truncate_subject(subject: Column | str, most: int = MAX_SUBJECT) -> Column:
    """Cut by characters if it is too long in bytes."""
    c = col(subject)
    return F.when(F.octet_length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)


def branch_namespace(branch: Column | str) -> Column:
    """A branch name as one path component; null means a detached head."""
    c = col(branch)
    plain = F.regexp_replace(F.regexp_replace(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^0-9a-z]", "-"), "^-+|-+$", "")
    return F.when(c.isNull(), "detached").when(plain == "", "branch").otherwise(plain)


def truncate_diff(diff: Column | str, most: int = MAX_DIFF) -> Column:
    """At most ``most`` bytes, cut after a whole line where there is one, else after a whole character."""
    c = col(diff)
    head = F.regexp_replace(F.make_valid_utf8(F.substring(c.cast("binary"), 1, most).cast("string")), "�+$", "")
    whole = F.regexp_extract(head, r"(?s)^(.*)\n", 1)
    return F.when(F.octet_length(c) <= most, c).when(F.contains(head, F.lit("\n")), whole).otherwise(head)


def strip_comments(text: Column | str) -> Column:
    kept = F.filter(F.split(col(text), "\n"), lambda x: ~F.startswith(x, F.lit("#")))
    return trim_space(F.array_join(kept, "\n"))


def response_path(text: Column | str) -> Column:
    """The first line that is an absolute path of a JSON file."""
    lines = F.transform(F.split(col(text), "\n"), trim_space)
    return F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("/")) & F.endswith(x, F.lit(".json"))), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are made once a row, one after the other, however many filters and columns behind use them.

    A filter is not pushed through an explode, nor is a column repeated in what uses it.
    """
    for name, made in columns.items():
        df = df.select(*df.columns, F.explode(F.array(made)).alias(name))
    return df


def extract_json(text: Column | str) -> Column:
    """JSON of a response: in a json fence, else in any fence after its first line, else between the outer braces.

    A fence that is opened but not closed gives null; so does a text without braces.
    """
    c = col(text)
    json_fence = F.regexp_extract(c, r"(?s)```json(.*?)```", 1)
    any_fence = F.regexp_extract(c, r"(?s)^.*?```(?:[^\n]*\n)?(.*?)```", 1)
    return (
        F.when(F.contains(c, F.lit("```json")), F.when(F.regexp_like(c, F.lit(r"(?s)```json.*?```")), trim_space(json_fence)))
        .when(F.contains(c, F.lit("```")), F.when(F.regexp_like(c, F.lit(r"(?s)```(?:[^\n]*\n)?.*?```")), trim_space(any_fence)))
        .otherwise(between_braces(c))
    )


def between_braces(text: Column | str) -> Column:
    """From the first opening brace to the last closing one, null without both in this order."""
    c = col(text)
    return F.when(F.regexp_like(c, F.lit(r"(?s)\{.*\}")), F.regexp_extract(c, r"(?s)\{.*\}", 0))


def event_text(stream: Column | str) -> Column:
    """The text parts of a line-delimited JSON event stream, concatenated in order; other lines add nothing."""
    parts = F.transform(F.split(col(stream), "\n"), lambda x: F.when(F.get_json_object(x, "$.type") == "text", F.get_json_object(x, "$.part.text")))
    return F.array_join(parts, "")
