import hashlib
import random
import re

from pyspark.sql import functions as F
from weftline.llm import chat as C

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
ESC = lambda s: re.sub(r"([<\[])(\\*)(/?s>|/?INST\])", r"\1\\\2\3", s)


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        until, total, loss = 0, 0, ""
        for n, (_, _, r, x) in enumerate(turns):
            until += len(f"<s>{ESC(r)}[INST]{ESC(x)}[/INST]</s>")
            loss += x * (r == "assistant")
            total += until * (r == "assistant" or n == len(turns) - 1)
        out[c] = (len(turns), SHA("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), SHA(loss), total)
    return out


def conversations():
    rnd = random.Random(6)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "<", "[", "\\", "/s>", "s>", "INST]", "é😀", " ", "\n", "<\\/s>", "$1", "ok"]
    text = lambda: rnd.choice([None, "", "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))])
    roles = ["user", "assistant", "system", None, "tool</s>", "assistant "]
    rows = [(c, t, rnd.choice(roles), text()) for c in range(60) for t in range(rnd.randrange(1, 9))]
    return rows + [(None, 1, "assistant", "no id"), (1000, None, "user", "a"), (1000, None, "user", "a"), (1000, 0, "assistant", "b" * 50_000), (1001, 0, "assistant", "</s>[INST] ok [/INST]")]


def test_digests_equal_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumn("example", F.lit("clash"))
    examples = C.expand_replies(df)
    got = {r.conv_id: tuple(r)[1:] for r in C.conversation_digests(examples).collect()}
    assert got == plain(rows)
    for r in examples.collect():
        assert (r.target is None) <= (r.loss_start == r.loss_end)
        assert r.formatted[r.loss_end :] == "[/INST]</s>"
        body = r.formatted[r.loss_start : r.loss_end]
        assert not any(c in body for c in ("<s>", "</s>", "[INST]", "[/INST]"))
        assert r.target is None or r.formatted[: r.loss_start].endswith("assistant[INST]")


def test_one_example_a_reply(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", str(i)) for i in range(6)] + [(2, 0, "user", "x")]
    got = C.expand_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "example").collect()
    assert [(r.conv_id, r.target) for r in got] == [(1, 1), (1, 3), (1, 5), (2, None)]
    assert all(b.formatted.startswith(a.formatted) for a, b in zip(got[:2], got[1:3]))


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.conversation_digests(C.expand_replies(df)).count() == 0
