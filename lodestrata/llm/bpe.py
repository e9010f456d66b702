"""Byte-pair encoding and decoding with the merge list of a public tokenizer file.

A word's symbols lie in one contiguous array, beside it the ranks of adjacent pairs. The encoder scans the ranks
for the leftmost minimum, deletes the boundary there, and refreshes the ranks on its two sides, until no pair has a
rank. Words over ``SHORT`` symbols take the same merges from a heap, so that their cost does not grow with the
square of their length. Results are kept per word in a cache of bounded size.

The file's special tokens are found in the text as it stands, before anything is normalised. Cases: null and empty
texts have no ids and an empty decoded text; very long texts and words are encoded whole; lone surrogates can't
occur in UTF-8 columns; repeated rows get equal results; empty tables give empty results; other columns pass
through untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trim, whole

SHORT = 128
CACHED_WORDS = 120_000
#: The white space of the tokenizer's pattern language.
SPACE = r"\t-\r \x85\xa0  -     　"
ENCODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where it prints, else the next code point from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Words(dict):
    """Encoded words; computes the missing ones and forgets all when full."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, word):
        if len(self) >= CACHED_WORDS:
            self.clear()
        got = self[word] = self.compute(word)
        return got


class WordBpe:
    """Encoder and decoder of one tokenizer file of the word-end kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            joined = a + b
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[joined])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.letters = byte_letters()
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # The file's own pattern, with its white space spelled out.
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", "[^" + SPACE)
        self.words = regex.compile(pattern)
        self.known = Words(self._known)

    def _known(self, word: str) -> tuple[bytes, str]:
        ids = self.encode_word(word)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(self.tokens[i] for i in ids)

    def encode_word(self, word: str) -> list[int]:
        symbols = [self.letters[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        parts = [self.vocab[s] for s in symbols]
        return self.merge_short(parts) if len(parts) <= SHORT else self.merge_long(parts)

    def merge_short(self, parts: list[int]) -> list[int]:
        none = (1 << 60, -1)
        get = self.ranks.get
        ranks = [get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none or best[1] < 0:
                break
            at = ranks.index(best)
            parts[at] = best[1]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), none)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, made, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or self.ranks.get((parts[i], parts[j])) != (rank, made):
                continue
            parts[i], parts[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.ranks.get((parts[a], parts[b]))):
                    heapq.heappush(heap, (*r, a))
        return [p for p in parts if p >= 0]

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        return self.words.findall(text.lower())

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and the decoded text."""
        known = self.known
        if self.specials is None or "<|" not in text:
            got = [known[w] for w in self.split(text)]
        else:
            got = []
            for part in self.specials.split(text):
                if part in self.special:
                    got.append((struct.pack("<I", self.special[part]), part))
                else:
                    got += [known[w] for w in self.split(part)]
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got])

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as files without a decoder have it; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=4)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def _ids(data: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def _listed(encoded: list[bytes]) -> pa.Array:
    """An array of lists of ids, without a Python number an id."""
    offsets = np.cumsum([0, *(len(x) // 4 for x in encoded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode(path: str, text: Column) -> Column:
    """The ids of a text column as an array of int."""

    @F.arrow_udf("array<int>")
    def encoded(column: pa.Array) -> pa.Array:
        own = loaded(path)
        return _listed([own.encode(x.as_py())[0] for x in column])

    return encoded.asNondeterministic()(whole(text))


def decode(path: str, ids: Column) -> Column:
    """The text of an array of ids; null ids give an empty text."""

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        own = loaded(path)
        return pa.array([own.decode([i for i in x or () if i is not None]) for x in column.to_pylist()], pa.string())

    return decoded.asNondeterministic()(ids)


def digests(path: str, text: Column, ids: bool = False) -> Column:
    """A struct of n_tokens, ids_sha256 and decoded_sha256, and the ids too if asked for; else they never leave the worker."""
    kind = T.StructType([*ENCODED, T.StructField("ids", T.ArrayType(T.IntegerType()))]) if ids else ENCODED

    @F.arrow_udf(kind)
    def digested(column: pa.Array) -> pa.Array:
        trim()
        own = loaded(path)
        counts, hashes, texts, kept = [], [], [], []
        for x in column:
            data, back = own.encode(x.as_py())
            counts.append(len(data) // 4)
            hashes.append(hashlib.sha256(data).hexdigest())
            texts.append(hashlib.sha256(back.encode()).hexdigest())
            if ids:
                kept.append(data)
        columns = [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())]
        return pa.StructArray.from_arrays([*columns, *([_listed(kept)] if ids else [])], kind.names)

    return digested.asNondeterministic()(whole(text))
