"""Byte-level BPE by monoid tree reduction.

A text's encoding is put together from the encodings of its halves, cut at any place. To join two neighbours, a window
around the seam is encoded anew; it grows until what lies outside can't change:

* A place is an edge if a letter, a digit or another sign is followed by a character of a different kind (an apostrophe
  followed by a letter is none). Every match of SPLIT is a run of one kind with at most one blank before it, a contraction
  or a run of white space, so no match holds an edge inside, in whatever text it stands, and none looks beyond one
  except from white space. So a text's tokens are those of the parts before and after an edge, and the window runs from
  the last edge before the seam to the first one after it.
* Where a run of one kind is long, the window is one of tokens. A sequence of tokens is the encoding of its bytes exactly
  if every adjacent pair is the encoding of its own bytes; so the window grows until the pairs on its rims are.

Decoding concatenates bytes up the same kind of tree. Kinds of characters are asked of the library's own engine, whose
tables of characters may differ from Python's.

Edge cases: a null or empty text has no tokens and decodes to no bytes; null ids decode to no bytes; repeated
rows are encoded alike; an empty table gives an empty result; input columns named like the output column
are replaced. Memory is bounded by a few megabytes of text, or the longest single text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append, bound_batches, text_column, with_fields, without

#: Fixed value: the pattern for which the edges above are proven.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text, bytes within one match, and ids that are one leaf.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 512, 1024, 256
#: Bytes of text that a worker encodes at a time (one text at least).
SLICE = 1 << 20
#: A vocabulary file larger than this is not sent to executors.
VOCAB_LIMIT = 64 << 20
#: Tokens, and characters, on either side of a seam that are looked at first.
WINDOW, NEAR = 4, 32

#: Kinds: L letter, N digit, S white space, P other, and the apostrophe.
_KINDS = {i: "L" if chr(i).isalpha() else "N" if chr(i).isdigit() else "S" if chr(i) in "\t\n\x0b\x0c\r " else "'" if chr(i) == "'" else "P" for i in range(128)}
_EDGE = re.compile(r"(?<=L)[^L]|(?<=N)[^N]|(?<=P)[LNS]|(?<=')[NS]")


class _Plain(dict):
    """Code points to ASCII characters of the same kind, told by the engine that splits texts."""

    def __init__(self, pattern: str):
        ranks = {bytes([i]): i for i in range(256)}
        for first in b"a1!":
            ranks |= {bytes([first, i]): len(ranks) + i for i in range(0xC2, 0xF5)}
        ranks = {token: i for i, token in enumerate(ranks)}
        self._probe = tiktoken.Encoding("kinds", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        super().__init__((i, i) for i in range(128))

    def __missing__(self, code: int) -> int:
        # A match that holds both characters has their neighbouring bytes merged.
        sign, size = chr(code), len(chr(code).encode())
        kind = next((like for before, like in zip("a1!", "A0!") if len(self._probe.encode_ordinary(before + sign)) == size), "\t")
        self[code] = ord(kind)
        return self[code]


class TreeCodec:
    """Encodes and decodes texts by the ranks of a vocabulary file."""

    def __init__(self, vocab: bytes, pattern: str = SPLIT, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        if pattern != SPLIT:
            raise ValueError("where texts may be cut is proven for the pattern SPLIT only")
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocab.splitlines())}
        self.flat = tiktoken.Encoding("weftline", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.leaf_chars, self.leaf_bytes = max(leaf_chars, 2), max(leaf_bytes, 8)
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.plain = _Plain(pattern)
        self.fits = lru_cache(1 << 16)(self._fits)
        self.joins = 0

    def encode(self, text: str) -> list[int]:
        return self._text(text, 0, len(text))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self.flat.decode_bytes(ids)
        middle = len(ids) // 2
        return b"".join((self.decode(ids[:middle]), self.decode(ids[middle:])))

    def _text(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf_chars:
            return self.flat.encode_ordinary(text[start:end])
        seam = (start + end) // 2
        return self.join_texts(text, start, seam, end, self._text(text, start, seam), self._text(text, seam, end))

    def join_texts(self, text: str, start: int, seam: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The tokens of text[start:end] from those of its parts before and after ``seam``."""
        self.joins += 1
        near = NEAR
        while True:
            # The window of characters grows to the next edges, or to the ends.
            low, high = max(start, seam - near), min(end, seam + near)
            kinds = self._kinds(text[max(start, low - 1) : high])
            at = seam - max(start, low - 1)
            edges = [m.start() for m in _EDGE.finditer(kinds)]
            before, after = [e for e in edges if e <= at], [e for e in edges if e >= at]
            if (before or low == start) and (after or high == end):
                break
            if near >= 2 * self.leaf_chars and self._one_run(kinds, at):
                return self._join_run(text, start, seam, end, left, right)
            near *= 2
        offset = seam - at
        p, q = before[-1] + offset if before else start, after[0] + offset if after else end
        if p == q:
            left += right
            return left
        i, j = self._tokens(reversed(left), text[p:seam]), self._tokens(right, text[seam:q])
        del left[len(left) - i :]
        left += self._window(text[p:q])
        left += right[j:]
        return left

    def _kinds(self, text: str) -> str:
        return (text if text.isascii() else text.translate(self.plain)).translate(_KINDS)

    def _tokens(self, ids, text: str) -> int:
        """How many of the tokens make up ``text``."""
        n = size = 0
        whole = len(text.encode())
        for token in ids:
            if size == whole:
                break
            size += self.length[token]
            n += 1
        return n

    def _window(self, text: str) -> list[int]:
        if len(text) <= 4 * max(self.leaf_chars, NEAR):
            return self.flat.encode_ordinary(text)
        ids: list[int] = []
        for match in self.pattern.finditer(text if text.isascii() else text.translate(self.plain)):
            ids += self.piece(text[match.start() : match.end()].encode())
        return ids

    @staticmethod
    def _one_run(kinds: str, at: int) -> bool:
        """Whether the seam is inside a run of letters, digits or other signs, too far from its start for a contraction."""
        kind = kinds[at] if at < len(kinds) else "S"
        return kind in "LNP" and at >= 8 and kinds[at - 8 : at] == kind * 8

    def _join_run(self, text: str, start: int, seam: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """As ``join_texts``, where the seam is inside one match, whose parts are the last match before and the first after it."""
        kind, low, high, step = self._kinds(text[seam]), seam, seam, NEAR
        same = kind + "'" * (kind == "P")
        while low > start:
            kinds = self._kinds(text[max(start, low - step) : low])
            kept = len(kinds.rstrip(same))
            low -= len(kinds) - kept
            if kept:
                break
            step *= 2
        step = NEAR
        while high < end:
            kinds = self._kinds(text[high : min(end, high + step)])
            rest = len(kinds.lstrip(same))
            high += len(kinds) - rest
            if rest:
                break
            step *= 2
        # The match's start: after a contraction, or with the blank before the run.
        first = low
        if kind == "L" and low > start and text[low - 1] == "'":
            first = self._last_match(text, start, low - 1, seam)
        elif low > start and text[low - 1] == " ":
            first = low - 1
        i, j = self._tokens(reversed(left), text[first:seam]), self._tokens(right, text[seam:high])
        whole = self.join(left[len(left) - i :], right[:j])
        return left[: len(left) - i] + whole + right[j:]

    def _last_match(self, text: str, start: int, mark: int, seam: int) -> int:
        """Where the last match before ``seam`` starts, from the apostrophe at ``mark`` on there being letters only."""
        low = mark
        while low > start and self._kinds(text[low - 1]) in "P'":
            low -= 1
        low -= low > start and text[low - 1] == " "
        found = low
        plain = text[low:seam].translate(self.plain)
        for match in self.pattern.finditer(plain):
            found = low + match.start()
        return found

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one match of the pattern."""
        if len(data) <= self.leaf_bytes:
            return self.flat._encode_single_piece(data)
        middle = len(data) // 2
        return self.join(self.piece(data[:middle]), self.piece(data[middle:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes taken together."""
        i, j = min(WINDOW, len(left)), min(WINDOW, len(right))
        while True:
            whole = i == len(left) and j == len(right)
            seam = b"".join(self.token_bytes[t] for t in (*left[len(left) - i :], *right[:j]))
            again = self.flat._encode_single_piece(seam)
            # A window that happens to be a vocabulary entry is looked up, not merged; a wider one is merged.
            merged = whole or len(again) > 1
            stable_left = merged and (i == len(left) or self.fits(left[-i - 1], again[0]))
            stable_right = merged and (j == len(right) or self.fits(again[-1], right[j]))
            if stable_left and stable_right:
                return left[: len(left) - i] + again + right[j:]
            if not stable_left or (not merged and i < len(left)):
                i = min(2 * i, len(left))
            if not stable_right or (not merged and j < len(right)):
                j = min(2 * j, len(right))

    def _fits(self, a: int, b: int) -> bool:
        return self.flat._encode_single_piece(self.token_bytes[a] + self.token_bytes[b]) == [a, b]


@lru_cache(4)
def _codec(vocab: bytes, pattern: str, leaf_chars: int, leaf_bytes: int) -> TreeCodec:
    return TreeCodec(vocab, pattern, leaf_chars, leaf_bytes)


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as file:
        vocab = file.read(VOCAB_LIMIT + 1)
    if len(vocab) > VOCAB_LIMIT:
        raise ValueError(f"the vocabulary {path} is larger than {VOCAB_LIMIT} bytes")
    return df.sparkSession.sparkContext.broadcast(vocab)


def _lists(found: list[list[int]]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.array(f, np.int32) for f in found]) if found else np.empty(0, np.int32)))


def encode_bpe(
    df: DataFrame, vocab_path: str, pattern: str = SPLIT, text: str = "text", ids: str = "ids",
    leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES,
) -> DataFrame:
    """``df`` with the token ids of the ``text`` column as ``ids`` array<int>."""
    df = without(df, ids) if ids.lower() != text.lower() else df
    vocab = _vocabulary(df, vocab_path)

    def work():
        codec = _codec(vocab.value, pattern, leaf_chars, leaf_bytes)
        return lambda texts: _lists([codec.encode(t or "") for t in texts])

    return df.withColumn(ids, text_column(df.sparkSession, "array<int>", work, SLICE)(text))


def recode_bpe(df: DataFrame, vocab_path: str, pattern: str = SPLIT, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the token ids of ``text``, and the bytes that they decode to, by one worker that holds one codec."""
    df = without(df, *[c for c in (ids, decoded) if c.lower() != text.lower()])
    vocab = _vocabulary(df, vocab_path)

    def work():
        codec = _codec(vocab.value, pattern, LEAF_CHARS, LEAF_BYTES)

        def both(texts: list[str | None]) -> pa.StructArray:
            found = [codec.encode(t or "") for t in texts]
            return pa.StructArray.from_arrays([_lists(found), pa.array([codec.decode(x) for x in found], pa.binary())], ["ids", "decoded"])

        return both

    kept = [c for c in df.columns if c not in (ids, decoded)]
    coded = df.withColumn("__coded", text_column(df.sparkSession, "struct<ids:array<int>,decoded:binary>", work, SLICE)(text))
    return coded.select(*kept, _field("ids").alias(ids), _field("decoded").alias(decoded))


def _field(name: str) -> Column:
    return F.col(f"__coded.{name}")


def decode_bpe(df: DataFrame, vocab_path: str, pattern: str = SPLIT, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes of the ``ids`` column as ``decoded`` binary."""
    df = without(df, decoded)
    vocab = _vocabulary(df, vocab_path)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab.value, pattern, LEAF_CHARS, LEAF_BYTES)
        for batch in batches:
            rows = (x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else [] for x in batch.column(ids))
            yield append(batch, [decoded], [pa.array([codec.decode(x) for x in rows], pa.binary())])

    return df.mapInArrow(run, with_fields(df, f"`{decoded}` binary"))
