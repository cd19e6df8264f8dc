import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm.alignment import Aligner, Transducer, align, alignment_report, byte_level_bytes
from weftline.llm.queries import ALIGNED_VOCABS, QUERIES

SF = "/root/testdata/sf0.001"
A, B = map(P.path, ALIGNED_VOCABS)
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def aligner():
    return Aligner(open(A, "rb").read(), open(B, "rb").read(), memo=50)


_A = Tokenizer.from_file(A)
_A.encode_special_tokens = True
_B = sentencepiece.SentencePieceProcessor(model_file=B)
_SIGNS = byte_level_bytes()
_NAMES = {i: t for t, i in _A.get_vocab().items()}


def plain(text):
    """Groups by offsets: whole texts encoded by the libraries, cut where both sides end."""
    if not text:
        return []
    a, b = _A.encode(" " + text, add_special_tokens=False).ids, _B.encode(text)
    ends, joined = [], []
    for ids, piece in ((a, lambda i: bytes(_SIGNS[c] for c in _NAMES[i])),
                       (b, lambda i: bytes([int(_B.id_to_piece(i)[3:5], 16)]) if _B.is_byte(i) else _B.id_to_piece(i).replace("▁", " ").encode())):
        at, own, data = 0, [], b""
        for i in ids:
            data += piece(i)
            at += len(piece(i))
            own.append(at)
        ends.append(own)
        joined.append(data)
    if joined != [(" " + text).encode()] * 2:
        return []
    both, found, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for end in both:
        k, m = ends[0].index(end) + 1, ends[1].index(end) + 1
        found.append((a[i:k], b[j:m]))
        i, j = k, m
    return found


def report(texts):
    groups = [plain(t) for t in texts]
    counts = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    found = []
    for g in groups:
        links = [(a[-1], b[-1]) for a, b in g]
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        found.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(counts[x] == most[x[1]] for x in links),
                      sum(counts[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if g else ""))
    return found


SPECIAL = ["", None, " ", "  ", "a", " a  b ", "x▁y", "<|endoftext|> <s> </s> <0x41> <unk>", "I'll don't 's", "tab\tx\r\n y", "\x00 \x85 z", "naïve café é",
           "中文 рус \U0001f600\U0001f600 ok", "a  b 　c", "w" * 3000, "ab " * 700, "a᠎ b ​ c ﻿ d", "  p"]


@pytest.mark.parametrize("text", SPECIAL)
def test_special_texts(aligner, text):
    assert aligner.groups(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\nab'sZ0.,é’-"), st.characters(codec="utf-8")), max_size=60))
def test_chunks_change_nothing(text):
    aligner = _shared()
    assert aligner.groups(text) == plain(text)


_made = []


def _shared():
    if not _made:
        _made.append(Aligner(open(A, "rb").read(), open(B, "rb").read()))
    return _made[0]


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=30), st.sets(st.integers(1, 29)), st.sets(st.integers(1, 29)))
def test_transducer_by_offsets(data, left, right):
    tokens, sides = {}, []
    for cuts in (left, right):
        ends = sorted({c for c in cuts if c < len(data)} | {len(data)})
        sides.append([tokens.setdefault(data[s:e], len(tokens)) for s, e in zip([0, *ends], ends)])
    names = {i: t for t, i in tokens.items()}
    groups = Transducer((names.__getitem__, names.__getitem__)).groups(*sides)
    ends = [{sum(len(names[i]) for i in ids[: k + 1]) for k in range(len(ids))} for ids in sides]
    assert len(groups) == len(ends[0] & ends[1])
    assert [sum((g[k] for g in groups), []) for k in (0, 1)] == sides
    assert all(b"".join(map(names.get, a)) == b"".join(map(names.get, b)) for a, b in groups)


def test_transducer_refuses_other_bytes():
    names = [b"ab", b"a", b"c"]
    t = Transducer((names.__getitem__, names.__getitem__))
    assert t.groups([0], [1, 2]) is None and t.groups([0], [1]) is None and t.groups([], []) == []


def test_report_with_repeats_and_both_joins(spark):
    rng = random.Random(5)
    texts = [*SPECIAL, *(" ".join(rng.choice(["the", "Lantern", "lanterns", "café", "x1", "don't", "中"]) for _ in range(rng.randint(1, 30))) for _ in range(60))]
    texts += texts[-5:] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    wanted = dict(enumerate(report(texts)))
    for limit in (10**6, 3):  # by broadcast, and by a salted shuffle
        got = alignment_report(df, A, B, pair_rows=limit).collect()
        assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == wanted


def test_align_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "ab cd", "k"), (1, "ab cd", "k"), (None, None, "z")], "doc_id long, text string, groups string")
    got = align(df, A, B).collect()
    assert len(got) == 3 and got[0].groups == got[1].groups and got[2].groups == []
    assert [(g.a, g.b) for g in got[0].groups] == plain("ab cd") and got[0].groups[-1].end == len(" ab cd")
    assert align(df.limit(0), A, B).collect() == [] and alignment_report(df.limit(0), A, B).collect() == []


def test_op12_over_the_table(spark):
    known = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_alignment"](spark, SF).collect()}
    assert got == dict(zip(known, report(list(known.values()))))
