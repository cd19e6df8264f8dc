import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from weftline.llm.byte_bpe import TreeCodec, decode_bpe, encode_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codecs():
    raw = open(PATH, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    flat = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return flat, TreeCodec(raw, P.PATTERN, 16, 8)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abe the'sñé 1,\n\t!é漢字😀'l"), max_size=300))
def test_tree_equals_flat(codecs, text):
    flat, tree = codecs
    ids = tree.encode(text)
    assert ids == flat.encode_ordinary(text)
    assert tree.decode(ids) == text.encode()


def test_long_matches(codecs):
    flat, tree = codecs
    rnd = random.Random(5)
    for letters in ("ab", "etaoinshr", "éèçñ", "=-_", "0123", "漢字かな"):
        text = "".join(rnd.choice(letters) for _ in range(5000))
        assert tree.encode(text) == flat.encode_ordinary(text)
    for text in ("a" * 3001, " " * 3001 + "x", "\n \n" * 1000, "<|endoftext|>" * 200, "don't" * 500):
        assert tree.encode(text) == flat.encode_ordinary(text)


def test_rows(spark, codecs):
    flat, _ = codecs
    texts = [None, "", "Hello  wörld", "x" * 50_000, "same", "same"]
    df = spark.createDataFrame([(i, t, "keep", [0]) for i, t in enumerate(texts)], "doc_id long, text string, other string, IDS array<int>")
    out = decode_bpe(encode_bpe(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert out.columns == ["doc_id", "text", "other", "ids", "decoded"]
    for r in out.collect():
        assert r.ids == flat.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert encode_bpe(df.limit(0), PATH, P.PATTERN).count() == 0
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in decode_bpe(nulls, PATH, P.PATTERN).collect()] == [b"", b""]


def test_kinds_are_those_of_the_library(codecs):
    flat, tree = codecs
    raw = open(PATH, "rb").read()
    whole = TreeCodec(raw, P.PATTERN)
    rnd = random.Random(8)
    code_points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for n in range(1000):
        text = "".join(map(chr, rnd.choices(code_points, k=rnd.randrange(1, 3000))))
        text = text if n % 2 else "".join(c for c in text if not c.isspace())
        assert (whole if n % 5 else tree).encode(text) == flat.encode_ordinary(text)


def test_ordinary_documents_are_joined(codecs):
    flat, _ = codecs
    tree = TreeCodec(open(PATH, "rb").read(), P.PATTERN)
    text = "The quick brown fox doesn't jump over 42 lazy dogs. " * 60
    assert tree.encode(text) == flat.encode_ordinary(text) and tree.joins == 7
    with pytest.raises(ValueError):
        TreeCodec(b"", r"\w+")


@pytest.mark.parametrize("sign", ["a", "é", "1", "!", "'", " ", "\n"])
def test_long_runs_are_joined_anywhere(codecs, sign):
    flat, tree = codecs
    for before in ("", " ", "x ", "x'", "!'", "x'l", " '", "don't "):
        for after in ("", " ", "'s", "'re", "x", "1", "!"):
            text = before + sign * 1500 + after
            assert tree.encode(text) == flat.encode_ordinary(text), (before, after)
