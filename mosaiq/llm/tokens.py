"""Encoding of texts by a public byte-level BPE tokenizer, in linear time.

The bytes of a piece are mapped to Latin-1 characters, so an Aho-Corasick automaton over the vocabulary finds the
longest token at every position in one pass. The encoding is then the only token sequence in which every two
neighbours are compatible, i.e. in which no merge across their border would have come first. It is found by taking the
longest match and going back to shorter ones where neighbours don't fit; compatibility of two tokens is memoised, and
positions that can't be reached are never tried twice.

Defined cases: null and empty texts give an empty list; the strings of special tokens are ordinary text; the whole
text is encoded, however long.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.session import spread

#: Where the public vocabulary files lie. A parameter: they are never copied here.
VOCABULARY_DIR = os.environ.get("MOSAIQ_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pattern that splits a text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and token pairs that a worker remembers; beyond it starts anew. Results don't depend on it.
MEMO = 200_000


def _byte_chars() -> dict[str, str]:
    """From the vocabulary file's printable stand-ins to the byte, as a Latin-1 character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + k): chr(b) for k, b in enumerate(rest)}


class BytePairEncoder:
    """A byte-level BPE vocabulary with the tables for encoding by backtracking."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = _byte_chars()
        self.ids = {"".join(back[c] for c in t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.find = regex.compile(PATTERN).findall
        self.merged: dict[tuple[int, int], int] = {}
        size = max(self.ids.values()) + 1
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.order = [-1] * size  # the merge's rank; bytes have none
        self.length, self.shorter = [0] * size, [-1] * size
        single = set(back.values())
        known = {t for t in self.ids if t in single}
        for rank, (a, b) in enumerate(merges):
            a, b = "".join(back[c] for c in a), "".join(back[c] for c in b)
            pair, t = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.merged[pair] = t
            self.parts[t] = pair
            self.order[t] = rank
            known.add(a + b)
        self.ids = {t: i for t, i in self.ids.items() if t in known}
        self.trie = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.length[i] = len(t)
            self.trie.add_word(t, i)
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in self.ids:
                    self.shorter[i] = self.ids[t[:n]]
                    break
        self.trie.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` standing side by side.

        Their merges are undone, latest first; if at some moment the two tokens at the border could be merged earlier
        than what was undone there, BPE would have done that instead.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        order, parts, inf = self.order, self.parts, len(self.order)
        bound, fits = inf, True  # merges of a rank below the bound would have been done across the border
        strict = False
        while True:
            across = self.merged.get((left, right))
            if across is not None and (order[across] < bound or (strict and order[across] == bound)):
                fits = False
                break
            a, b = order[left], order[right]
            if a < 0 and b < 0:
                break
            # undo the later of the two; of equal ones the right one, as BPE merges from the left
            if a > b:
                bound, strict = a, False
                left = parts[left][1]
            else:
                bound, strict = b, True
                right = parts[right][0]
        if len(self.fits) > MEMO:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def piece(self, s: str) -> list[int]:
        """Ids of one piece, given as Latin-1."""
        whole = self.ids.get(s)
        if whole is not None:
            return [whole]
        n, length, shorter, compatible = len(s), self.length, self.shorter, self.compatible
        longest = [-1] * n
        for end, i in self.trie.iter(s):
            start = end + 1 - length[i]
            if longest[start] < 0 or length[i] > length[longest[start]]:
                longest[start] = i
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if open_at[end] and (last < 0 or compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:  # nothing fits here: go back, and try the last one shorter
                open_at[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for p in self.find(text or ""):
            ids = memo.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8").decode("latin-1"))
                if len(memo) > MEMO:
                    memo.clear()
                if len(p) <= 64:
                    memo[p] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(path)


def _run(batches: Iterator[pa.RecordBatch], path: str, count_only: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for b in batches:
        texts = b.column(b.schema.get_field_index("text"))
        keep = [b.column(k) for k in range(b.num_columns - 1)]
        names = b.schema.names[:-1]
        if count_only:
            n = pa.array([len(enc.encode(t.as_py())) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*keep, n], [*names, "n_tokens"])
            continue
        flat: list[int] = []
        ends = [0]
        for t in texts:
            flat += enc.encode(t.as_py())
            ends.append(len(flat))
        ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
        yield pa.RecordBatch.from_arrays([*keep, ids], [*names, "ids"])


def encode_texts(
    df: DataFrame, key: str, text: str = "text", vocabulary: str = VOCABULARY, directory: str = VOCABULARY_DIR
) -> DataFrame:
    """``key, ids``: the token ids of every row's text, one row out for each row in, also for null keys."""
    path = os.path.join(directory, vocabulary)
    rows = spread(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")))
    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _run(it, path, False), f"k {kind}, ids array<int>")
    return out.withColumnRenamed("k", key)


def count_tokens(
    df: DataFrame, columns: list[str], text: str = "text", vocabulary: str = VOCABULARY, directory: str = VOCABULARY_DIR
) -> DataFrame:
    """``columns..., n_tokens``: the number of tokens of every row's text; 0 for null and empty texts."""
    path = os.path.join(directory, vocabulary)
    rows = spread(df.select(*columns, F.col(text).cast("string").alias("text")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda it: _run(it, path, True), f"{kinds}, n_tokens bigint")
