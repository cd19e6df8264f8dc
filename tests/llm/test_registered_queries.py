"""Each registered query over the whole tables at the smallest scale, beside SQL, a library or plain Python."""

import base64
import glob
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow.dataset as ds
import pytest
import tiktoken
from test_secrets import plain as plain_secrets
from test_simhash import brute
from test_simhash import plain as plain_print

import corpus_pipeline as C
from weftline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def table(name):
    return ds.dataset(f"{SF}/{name}.parquet").to_table().to_pylist()


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, SF)
    cols = sorted(found.columns)
    plain = lambda rs: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rs)
    assert plain(found.select(*cols).collect()) == plain(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())


def test_op1_simhash(spark):
    got = rows(spark, "op1_simhash")
    prints = [(r["doc_id"], plain_print(r["text"])) for r in table("documents")]
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((i, f"{p:016x}") for i, p in prints)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute(prints)


def test_op2_secrets(spark):
    got = {r.doc_id: r for r in rows(spark, "op2_secrets")}
    assert len(got) == len(table("documents"))
    for r in table("documents"):
        base = plain_secrets(r["text"] or "")
        counts = Counter(k for k, _, _ in base)
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        own = got[r["doc_id"]]
        assert (own.n_assign, own.n_access, own.n_hex, own.base_sha256) == (counts["assign"], counts["access"], counts["hex"], sha(told))
        assert set(told.split(",")) - {""} <= set(own.spans.split(","))


def test_op5_adds_the_conversation(spark):
    said = "</s>[INST] ok [/INST]"
    own = {r.conv_id: r for r in rows(spark, "op5_chat")}[-1]
    assert (own.n_turns, own.turns_sha256, own.loss_chars, own.loss_sha256) == (2, sha(f"user\n{said}\nassistant\n{said}\n"), len(said), sha(said))


def test_op6_embeddings(spark):
    known = table("embeddings")
    group, links = {}, Counter()
    usable = []
    for r in known:
        v = r["embedding"]
        group[r["vec_id"]] = r["vec_id"]
        if v and r["label"] is not None and None not in v and np.isfinite(v).all() and any(v):
            v = np.array(v, float)
            usable.append((r["vec_id"], r["label"], v / np.linalg.norm(v)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for n, (i, a, x) in enumerate(usable):
        for j, b, y in usable[:n]:
            if a == b and len(x) == len(y) and float(x @ y) >= 0.98:
                links[i] += 1
                links[j] += 1
                one, two = sorted((root(i), root(j)))
                group[two] = one
    got = {r.vec_id: r for r in rows(spark, "op6_embeddings")}
    assert len(got) == len(known)
    assert all(r.n_links <= links[i] and r.kept == (i == r.component_id) for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(links.values())
    assert np.mean([r.component_id == root(i) for i, r in got.items()]) >= 0.98


def test_op7_byte_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    flat = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = {}
    for r in table("documents"):
        ids = flat.encode_ordinary(r["text"] or "")
        wanted[r["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(r["text"] or ""))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op7_byte_bpe")} == wanted


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def test_op8_language(spark):
    known = {r["doc_id"]: r for r in table("documents")}
    got = rows(spark, "op8_language")
    assert sorted(r.doc_id for r in got) == sorted(known)
    learned = {r["lang"] for i, r in known.items() if not held(i, 5, 0) and r["lang"] is not None}
    right = []
    for r in got:
        own = known[r.doc_id]
        assert r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in own["text"] or ""):
            assert r.lang_pred == "und"
        else:
            assert r.lang_pred in learned
            if r.held_out and own["lang"]:
                right.append(r.lang_pred == own["lang"])
    assert np.mean(right) > 0.95


def test_op9_quality(spark):
    known = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    got = rows(spark, "op9_quality")
    assert sorted(r.doc_id for r in got) == sorted(known)
    for r in got:
        text = known[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        again = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        wanted = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == wanted
        assert not (r.kept and failed)
    assert any(r.kept for r in got)


def test_op10_learns_nothing_held_out(spark, tmp_path):
    got = rows(spark, "op10_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(r["doc_id"] for r in table("documents"))
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    os.symlink(f"{SF}/documents.parquet", tmp_path / "documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").selectExpr(
        "doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    turned = QUERIES["op10_toxicity"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.score) for r in turned) == sorted((r.doc_id, r.score) for r in got)


def test_pipeline(spark):
    got = C.run(spark, SF).collect()
    texts = {r["doc_id"] for r in table("documents")}
    assert got and all(r.decodes and len(r.ids) == r.n_tokens for r in got) and {r.doc_id for r in got} <= texts
    assert max(Counter(r.doc_id for r in got).values()) <= 2
