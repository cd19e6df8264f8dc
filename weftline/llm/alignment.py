"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizations of the same bytes are read side by side. The state is which side leads and the bytes by which it leads (its
dangling suffix, never longer than one token); the other side takes its next token, which either eats into the suffix, eats
it up, or leaves a suffix of its own. Where the suffix is empty both sides end together, and a group closes. Transitions
depend on the suffix and the next token alone and are memoised, and so is the run over a *chunk*:

A chunk is a blank and what follows it up to the next blank that stands between two signs that are no white space. Both
tokenizers begin a new token at such a blank, whatever stands before or after: the byte-level pattern matches a blank only
as the first sign of a match or within white space, and no piece of the other vocabulary has a blank mark behind another
sign (checked when it is loaded, with the normaliser being the identity; else whole texts are encoded). So the suffix is
empty there, a text's groups are its chunks' groups, and each worker encodes a chunk once, however often it comes back.

Counts of linked id pairs are taken over all documents. The table of pairs is bounded by the two vocabularies and by tokens
that share an end; it is broadcast up to PAIR_ROWS counted rows, beyond that the join is by shuffle, hot pairs salted.

Edge cases: a null or empty text, and one whose tokens give other bytes than the text (a literal U+2581 among them), has no
tokens: zeros and an empty digest; special tokens' strings are plain text; repeated rows are aligned alike and each counts;
an empty table gives an empty result; columns named like an output column are replaced. Memory is a few megabytes of text or
the longest single text, and MEMO chunks of at most LONG characters a worker.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import join_lookup, stored, text_column, without

#: Chunks that a worker keeps, and characters of the longest one that it keeps.
MEMO, LONG = 700_000, 64
#: Rows of the table of linked pairs up to which it is broadcast.
PAIR_ROWS = 1_000_000
#: A blank that begins a chunk. Signs that only some engines take for white space don't count as signs here.
_CUT = re.compile(r"(?<=[^\s᠎​﻿]) (?=[^\s᠎​﻿])")
_MARK = "▁"
SUMMARY = "struct<n_a:bigint,n_b:bigint,n_groups:bigint,groups_sha256:string,pairs:array<bigint>,times:array<int>>"
GROUPS = "array<struct<a:array<int>,b:array<int>,start:int,end:int>>"

Groups = list[tuple[list[int], list[int]]]


def byte_level_bytes() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Closes groups of tokens of side 0 and side 1 wherever both end together."""

    def __init__(self, pieces: tuple[Callable[[int], bytes], Callable[[int], bytes]]):
        self.pieces = pieces
        self.states, self.behind, self.names = [(0, b"")], [0], {(0, b""): 0}
        self.moves: dict[tuple[int, int], int] = {}

    def _move(self, state: int, token: int) -> int:
        """The state after the side that is behind has taken ``token``; -1 if bytes differ."""
        behind, suffix = self.states[state]
        piece = self.pieces[behind](token)
        if suffix.startswith(piece):
            after = (behind, suffix[len(piece) :])
        elif piece.startswith(suffix):
            after = (1 - behind, piece[len(suffix) :])
        else:
            return -1
        if not after[1]:
            return 0
        if after not in self.names:
            self.names[after] = len(self.states)
            self.states.append(after)
            self.behind.append(after[0])
        return self.names[after]

    def groups(self, a: list[int], b: list[int]) -> Groups | None:
        """The groups of two tokenizations; None if their bytes differ."""
        moves, behind, found = self.moves, self.behind, []
        state = i = j = first = second = 0
        while True:
            if behind[state]:
                if j == len(b):
                    break
                token = b[j]
                j += 1
            else:
                if i == len(a):
                    break
                token = a[i]
                i += 1
            after = moves.get((state, token))
            if after is None:
                after = moves[state, token] = self._move(state, token)
            if after == 0:
                found.append((a[first:i], b[second:j]))
                first, second = i, j
            elif after < 0:
                return None
            state = after
        return found if state == 0 and i == len(a) and j == len(b) else None


class Aligner:
    """Aligns the tokens of a byte-level BPE file (a blank and the text) and a sentencepiece model (which adds the blank)."""

    def __init__(self, a_file: bytes, b_file: bytes, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        signs, size = byte_level_bytes(), self.b.get_piece_size()
        self.a_bytes = {i: bytes(map(signs.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        names = [self.b.id_to_piece(i) for i in range(size)]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(_MARK, " ").encode() for i, t in enumerate(names)]
        self.transducer = Transducer((self.a_bytes.__getitem__, self.b_bytes.__getitem__))
        self.cuts = not any(_MARK in t.lstrip(_MARK) for t in names) and self._plain()
        self.memo_limit, self.memo = memo, {}

    def _plain(self) -> bool:
        """Whether the model takes texts as they are."""
        probe = "  Aé é ﬁ Ａ　\t x  "
        pieces = b"".join(self.b_bytes[i] for i in self.b.encode(probe))
        return pieces == (" " + probe).encode()

    def _aligned(self, texts: list[str]) -> list[Groups | None]:
        """The groups of each text as a whole; None where its tokens give other bytes."""
        found = []
        left = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for text, a, b in zip(texts, (e.ids for e in left), self.b.encode(texts, num_threads=1)):
            same = b"".join(map(self.a_bytes.__getitem__, a)) == b" " + text.encode()
            found.append(self.transducer.groups(a, b) if same else None)
        return found

    def _chunks(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def groups(self, text: str | None) -> Groups:
        """All groups of a text; none if its bytes aren't those of its tokens."""
        if not text:
            return []
        parts = self._aligned(self._chunks(text))
        return [] if None in parts else list(chain.from_iterable(parts))

    def _know(self, chunks: list[str]) -> dict[str, tuple | None]:
        """Of each chunk: its groups in writing, numbers of tokens and groups, and the pairs that end together."""
        found = {}
        for chunk, groups in zip(chunks, self._aligned(chunks)):
            if groups is None:
                found[chunk] = None
                continue
            texts, n_a, n_b = [], 0, 0
            for a, b in groups:
                texts.append(f"{a[0]}|{b[0]}" if len(a) == len(b) == 1 else f"{','.join(map(str, a))}|{','.join(map(str, b))}")
                n_a += len(a)
                n_b += len(b)
            found[chunk] = ";".join(texts), n_a, n_b, len(groups), tuple([a[-1] << 32 | b[-1] for a, b in groups])
        return found

    def summaries(self, texts: list[str | None]) -> list[tuple]:
        """Of each text n_a, n_b, n_groups, digest, distinct linked pairs and how often each is linked."""
        rows = [self._chunks(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(rows)).difference(self.memo))
        found = self._know(new)
        if len(self.memo) + len(new) > self.memo_limit:
            found |= {c: self.memo[c] for c in set(chain.from_iterable(rows)).intersection(self.memo)}
            self.memo.clear()
        self.memo.update(found)
        told = [self._summary([self.memo[c] for c in row]) for row in rows]
        for c in new:
            if len(c) > LONG:
                del self.memo[c]
        return told

    def _summary(self, told: list[tuple | None]) -> tuple:
        if not told or None in told:
            return 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int32)
        texts, n_a, n_b, n_groups, pairs = zip(*told)
        pairs, times = np.unique(np.fromiter(chain.from_iterable(pairs), np.int64, sum(n_groups)), return_counts=True)
        return sum(n_a), sum(n_b), sum(n_groups), hashlib.sha256(";".join(texts).encode()).hexdigest(), pairs, times.astype(np.int32)


@lru_cache(1)
def _aligner(*files: bytes) -> Aligner:
    """One a worker process, so that tasks after the first find its chunks known."""
    return Aligner(*files)


def _spans(aligner: Aligner, text: str | None) -> list[dict]:
    found, at = [], 0
    for a, b in aligner.groups(text):
        size = sum(len(aligner.a_bytes[i]) for i in a)
        found.append({"a": list(a), "b": list(b), "start": at, "end": at + size})
        at += size
    return found


def _files(*paths: str) -> list[bytes]:
    files = []
    for path in paths:
        with open(path, "rb") as f:
            files.append(f.read())
    return files


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text", out: str = "groups") -> DataFrame:
    """``df`` with the groups of each text: ids of either side, and the group's bytes in the text behind a blank."""
    files, df = _files(a_path, b_path), without(df, out)

    def work() -> Callable[[list[str | None]], pa.Array]:
        aligner = _aligner(*files)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("start", pa.int32()), ("end", pa.int32())]))
        return lambda texts: pa.array([_spans(aligner, t) for t in texts], kind)

    return df.withColumn(out, text_column(df.sparkSession, GROUPS, work)(text))


def _summaries(df: DataFrame, a_path: str, b_path: str, text: str) -> Column:
    files = _files(a_path, b_path)

    def work() -> Callable[[list[str | None]], pa.Array]:
        aligner = _aligner(*files)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]

        def turn(texts: list[str | None]) -> pa.Array:
            columns = list(zip(*aligner.summaries(texts))) or [[]] * len(kinds)
            return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        return turn

    return text_column(df.sparkSession, SUMMARY, work)(text)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best) of rows (pair, times): how often a pair is linked, and whether no other pair of its B id is more often."""
    counts = links.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(2**32 - 1)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_report(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", pair_rows: int = PAIR_ROWS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row, counts taken over all rows."""
    docs = df.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), _summaries(df, a_path, b_path, text).alias("s"))
    docs = stored(docs.select("id", "row", "s.*"))  # fixes the row numbers
    each = docs.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    counts = stored(pair_counts(each.drop("row")))
    found = join_lookup(each, counts, "pair", pair_rows).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return docs.drop("pairs", "times").join(found, "row", "left").select(
        F.col("id").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
