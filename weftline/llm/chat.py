"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and its text alone under the loss
mask. A turn is written ``<s>role[INST]text[/INST]</s>``. Where a role or text holds one of these four control strings,
with any number of backslashes after its first character, one more backslash is put there; taking one away restores
the text, and no control string is left inside. Turns after the last reply (all turns, if there is none) would be in
no example; they are kept in a context example, which has no target and an empty mask.

The expansion is a lazy generator over a conversation's ordered turns: one example is built at a time. A conversation
is one row by nature (each example holds all that precedes it), whole conversations are never gathered together. One
whose turns, or whose longest example, pass the 2 GB that Spark allows a value fails with Spark's error; nothing is cut.

Edge cases: null texts and roles are read as empty; a null id is a conversation of its own; turns are ordered by turn
(null first), role and text, and repeated rows stay repeated; an empty reply has an empty mask; an empty table gives
an empty result; other input columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
OPEN, BODY, BODY_END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
REPLY = "assistant"
_CONTROL = r"(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def expand_replies(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, example int, target int, formatted, loss_start int, loss_end int).

    ``target`` is the position of the reply among the conversation's turns, null in a context example; the mask is
    the code points from loss_start to loss_end, exclusive, of ``formatted``.
    """
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    one = df.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text")).alias("one"))
    turns = one.groupBy("conv").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    # Each turn is escaped once, however many examples it is in.
    written = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["role"]).alias("head"), escape(t["text"]).alias("body")))
    turns = turns.select("conv", written.alias("turns"))
    places = F.sequence(F.lit(1), F.size("turns"))
    replies = F.filter(places, lambda i: (F.element_at("turns", i)["role"] == REPLY) | (i == F.size("turns")))
    each = turns.select("conv", "turns", F.posexplode(replies).alias("example", "last"))
    render = lambda t: F.concat(F.lit(OPEN), t["head"], F.lit(BODY), t["body"], F.lit(BODY_END + CLOSE))
    formatted = F.array_join(F.transform(F.slice("turns", 1, F.col("last")), render), "")
    last = F.element_at("turns", F.col("last"))
    each = each.select(
        "conv", "example", formatted.alias("formatted"), F.char_length(last["body"]).alias("n"),
        F.when(last["role"] == REPLY, F.col("last") - 1).alias("target"),
    )
    end = F.char_length("formatted") - len(BODY_END + CLOSE)
    start = F.when(F.col("target").isNotNull(), end - F.col("n")).otherwise(end)
    return each.select(F.col("conv").alias(conv), "example", "target", "formatted", start.alias("loss_start"), end.alias("loss_end"))


def loss_text(formatted: str = "formatted", start: str = "loss_start", end: str = "loss_end") -> Column:
    """The unescaped text under the mask."""
    return unescape(F.substring(F.col(formatted), F.col(start) + 1, F.col(end) - F.col(start)))


def read_turns(formatted: str | Column = "formatted") -> Column:
    """The turns (role, text) of a formatted example, unescaped."""
    source = F.col(formatted) if isinstance(formatted, str) else formatted
    pieces = F.filter(F.split(source, CLOSE), lambda p: p != "")

    def parse(piece: Column) -> Column:
        role = F.substring_index(F.substring(piece, len(OPEN) + 1, 1 << 30), BODY, 1)
        body = F.substring(piece, F.lit(len(OPEN + BODY) + 1) + F.char_length(role), F.char_length(piece) - F.char_length(role) - len(OPEN + BODY + BODY_END))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, parse)


def conversation_digests(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What can be read back from the examples, one row a conversation."""
    seen = examples.select(
        F.col(conv), "example", "formatted", F.char_length("formatted").cast("long").alias("chars"), loss_text().alias("loss")
    )
    whole = seen.groupBy(conv).agg(
        F.max_by("formatted", "example").alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    whole = whole.withColumn("turns", read_turns("last"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


DIGEST_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), sized AS (
  SELECT *, 21 - 1 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows_
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS until FROM sized
)
SELECT conv_id, max(n)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(until) FILTER (role = 'assistant' OR place = n)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""
