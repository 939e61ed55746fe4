"""BPE encoding and decoding for the word-level vocabulary, by contiguous rank arrays.

A word's parts lie in one row of a matrix, beside a row with the ranks of adjacent
parts. Each step takes the smallest rank of the row (the leftmost of equals),
deletes that boundary and refreshes the ranks beside it. All words of one length
step together, which keeps the work in numpy. Words above ``SHORT`` bytes, for
which repeated scans would be quadratic, merge through a heap instead.

The text side follows the file: special tokens stand for themselves, then NFC,
lower case by character, and a split into letters, single digits and other runs.
White space separates and vanishes. Decoding joins the tokens' strings with one
space, as the file names no decoder.

Null texts are empty: no ids, and an empty decoded text. Nothing is truncated: a text of
any length is encoded whole, in a task that holds its words and ids, about 60 bytes a word.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.text import Words, slices

SHORT = 48
NONE = np.iinfo(np.int64).max
#: Distinct white-space separated chunks whose ids a worker remembers.
REMEMBERED = 300_000

# The white space of Unicode, the printable stand-ins of the byte-level alphabet, and where
# the character tables of the vocabulary's library differ from the installed ones (code points in hexadecimal).
SPACE = "\t-\r \x85\xa0  -     　"
# Code points that the installed tables call letters or numbers, and the vocabulary's library does not.
NEWER_LETTERS = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7"
    " 10ed9-10eee 11b0a 11db0-11ddb 11df1-11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20"
    " 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de"
    " 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f")
NEWER_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
# Marks that the library's normal form does not order or compose, though the installed one does.
NEWER_MARKS = (
    "7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50"
    " 10f82-10f85 11070 1133b 1145e 11839-1183a 11930 11938 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97"
    " 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef")
# Capitals that the library lowers and the installed tables do not, by range, and how far their small letters are.
NEWER_CAPITALS = {
    "1c89": 1, "a7cb": -42343, "a7cc": 1, "a7ce": 1, "a7d2": 1, "a7d4": 1, "a7da": 1, "a7dc": -42561, "10d50-10d65": 32,
    "16ea0-16eb8": 27}
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def members(ranges: str) -> list[int]:
    """The code points of ranges written in hexadecimal."""
    ends = [[int(x, 16) for x in r.split("-")] for r in ranges.split()]
    return [c for e in ends for c in range(e[0], e[-1] + 1)]


def _set(ranges: str) -> str:
    return "".join(rf"\U{int(e[0], 16):08X}-\U{int(e[-1], 16):08X}" for e in (r.split("-") for r in ranges.split()))


_LETTER, _NUMBER = rf"[\p{{L}}--[{_set(NEWER_LETTERS)}]]", rf"[\p{{N}}--[{_set(NEWER_NUMBERS)}]]"
_OTHER = rf"[[^{SPACE}\p{{L}}\p{{N}}]||[{_set(NEWER_LETTERS + ' ' + NEWER_NUMBERS)}]]"
#: The word pattern of the vocabulary's file by the installed tables; before it the line feed that ends a
#: chunk here. The exact one is slower, and for texts with code points where the tables differ.
WORD = rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
EXACT = rf"\n|'s|'t|'re|'ve|'m|'ll|'d|{_LETTER}+|{_NUMBER}|{_OTHER}+"
LOWERED = {c: c + far for ranges, far in NEWER_CAPITALS.items() for c in members(ranges)} | {0x3A3: 0x3C3}


@lru_cache(maxsize=1)
def differing() -> np.ndarray:
    """For each code point whether it needs the exact rules."""
    table = np.zeros(0x110000, bool)
    table[[*members(NEWER_LETTERS), *members(NEWER_NUMBERS), *members(NEWER_MARKS), *LOWERED]] = True
    return table


def byte_alphabet() -> list[str]:
    """The character that stands for each byte."""
    rest = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(rest)) for b in range(256)]


class WordBpe:
    """One vocabulary file, with the ids of the chunks seen so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**vocab, **self.special}.items()}
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [(vocab[a] << 32 | vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        keys = np.array([k for k, _ in pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.merged = np.array([m for _, m in pairs], np.int64)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.word, self.exact = regex.compile(WORD), regex.compile(EXACT, regex.V1)
        self.marks = regex.compile(f"([{_set(NEWER_MARKS)}])")
        self._forget()

    def _forget(self):
        self.chunks = pa.array([], pa.string())
        self.start, self.size, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    # --- words -----------------------------------------------------------------

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each adjacent pair, ``NONE`` where they don't merge."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.order[at], NONE)

    def _scan(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length, a row each: their final parts and how many."""
        rows, width = parts.shape
        out, size = np.zeros((rows, width), np.int64), np.full(rows, 1)
        live, rank = np.arange(rows), self.ranks(parts[:, :-1], parts[:, 1:])
        while parts.shape[1] > 1 and len(live):
            best = rank.argmin(1)
            merges = rank[np.arange(len(live)), best] != NONE
            if not merges.all():
                over = live[~merges]
                out[over, : parts.shape[1]], size[over] = parts[~merges], parts.shape[1]
                live, parts, rank, best = live[merges], parts[merges], rank[merges], best[merges]
            at, n, left = np.arange(len(live)), parts.shape[1] - 1, np.ones_like(parts, bool)
            parts[at, best] = self.merged[rank[at, best]]
            left[at, best + 1] = False
            parts = parts[left].reshape(len(live), n)
            left = np.ones_like(rank, bool)
            left[at, best] = False
            rank = rank[left].reshape(len(live), n - 1)
            for place in (best - 1, best):  # the boundaries beside the merged part
                ok = (place >= 0) & (place < n - 1)
                a, p = at[ok], place[ok]
                rank[a, p] = self.ranks(parts[a, p], parts[a, p + 1])
        out[live, 0] = parts[:, 0] if len(live) else 0
        return out, size

    def _heap(self, parts: list[int]) -> list[int]:
        """One long word: the same merges in the same order, without repeated scans."""
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        first = self.ranks(np.array(parts[:-1], np.int64), np.array(parts[1:], np.int64))
        heap = [(int(r), i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0:
                    new = int(self.ranks(np.int64(parts[k]), np.int64(parts[after[k]])))
                    if new != NONE:
                        heapq.heappush(heap, (new, k, parts[k], parts[after[k]]))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words that the pattern has cut out: all ids, each word's start and size."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:][: len(words) + 1]
        data, width = np.frombuffer(words.buffers()[2], np.uint8), np.diff(offsets)
        size, done = np.zeros(len(words), np.int64), []
        for n in np.unique(width[width > 0]):
            at = np.flatnonzero(width == n)
            symbols = data[offsets[at][:, None] + np.arange(n)]
            parts = self.inner[symbols]
            parts[:, -1] = self.final[symbols[:, -1]]
            if n > SHORT:
                for i, row in zip(at, parts):
                    ids = np.array([self._heap(row.tolist())], np.int64)
                    size[i] = ids.shape[1]
                    done.append((np.array([i]), ids))
            else:
                ids, size[at] = self._scan(parts)
                done.append((at, ids))
        start = np.cumsum(size) - size
        flat = np.zeros(size.sum(), np.int64)
        for at, ids in done:
            place = np.arange(ids.shape[1])
            used = place < size[at][:, None]
            flat[(start[at][:, None] + place)[used]] = ids[used]
        return flat, start, size

    # --- texts -----------------------------------------------------------------

    def cut(self, chunks: str) -> list[str]:
        """The words of chunks that line feeds end, each chunk's line feed after them."""
        if chunks.isascii():
            return self.word.findall(chunks.lower())
        codes = np.frombuffer(chunks.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not differing()[codes].any():
            return self.word.findall(unicodedata.normalize("NFC", chunks).lower())
        # Newer marks stand by themselves; a sigma is lowered by character, without the rule for a final one.
        parts = [unicodedata.normalize("NFC", part) for part in self.marks.split(chunks)]
        return self.exact.findall("".join(parts).translate(LOWERED).lower())

    def _learn(self, chunks: pa.Array) -> None:
        """Remember the ids of new chunks."""
        has = pc.match_substring_regex(chunks, self.split_special.pattern)
        plain, odd = chunks.filter(pc.invert(has)), chunks.filter(has)
        self._add(plain, self.cut("".join([c + "\n" for c in plain.to_pylist()])), {})
        if len(odd):  # chunks with special tokens, which stand outside the text rules
            cuts: list[str] = []
            for chunk in odd.to_pylist():
                for piece in self.split_special.split(chunk):
                    cuts += [f"\n{piece}"] if piece in self.special else self.cut(piece)
                cuts.append("\n")
            self._add(odd, cuts, {f"\n{t}": i for t, i in self.special.items()})

    def _add(self, chunks: pa.Array, cuts: list[str], special: dict[str, int]) -> None:
        """cuts: the words of the chunks in order, a line feed after each chunk's."""
        if not len(chunks):
            return
        coded = pa.array(cuts, pa.string()).dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary
        flat, start, size = self.encode_words(words)
        for token, i in special.items():
            k = pc.index(words, token).as_py()
            if k >= 0:
                start[k], size[k], flat = len(flat), 1, np.append(flat, i)
        end = pc.index(words, "\n").as_py()
        size[end] = 0
        taken = size[at]
        ends = np.cumsum(taken)
        ids = flat[np.repeat(start[at] - (ends - taken), taken) + np.arange(ends[-1])]
        last = ends[at == end]
        first = np.concatenate([[0], last[:-1]])
        self.start = np.concatenate([self.start, len(self.ids) + first])
        self.size = np.concatenate([self.size, last - first])
        self.ids = np.concatenate([self.ids, ids])
        self.chunks = pa.concat_arrays([self.chunks, chunks])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text's ids end."""
        words = Words(texts)
        if not len(words.ids):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        if len(self.chunks) > REMEMBERED:
            self._forget()
        new = pc.is_null(pc.index_in(words.distinct, self.chunks))
        self._learn(words.distinct.filter(new))
        at = pc.index_in(words.distinct, self.chunks).to_numpy()[words.ids]
        size = self.size[at]
        ends = np.cumsum(size)
        take = np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1])
        return self.ids[take], np.concatenate([[0], ends])[words.ends]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join([self.tokens[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    """The vocabulary of ``path``, loaded once in each worker."""
    return WordBpe(path)


def encoded(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text."""
    bpe = vocabulary(path)
    for part in slices(texts):
        ids, ends = bpe.encode(part)
        yield from np.split(ids, ends[:-1])


def encode(path: str, text: str | Column) -> Column:
    """A column of ids, array<int>, for a text column."""
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        rows = list(encoded(texts, path))
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
    return ids(text)


def count(path: str, text: str | Column) -> Column:
    """A column with the number of ids of a text column."""
    @F.arrow_udf("long")
    def sizes(texts: pa.Array) -> pa.Array:
        bpe, out = vocabulary(path), []
        for part in slices(texts):
            out.append(np.diff(bpe.encode(part)[1], prepend=0))
        return pa.array(np.concatenate([np.zeros(0, np.int64), *out]), pa.int64())
    return sizes(text)


def decode(path: str, ids: str | Column) -> Column:
    """A text column for a column of ids; null ids give an empty text."""
    @F.arrow_udf("string")
    def texts(rows: pa.Array) -> pa.Array:
        bpe = vocabulary(path)
        return pa.array([bpe.decode(np.array(r or [], np.int64)) for r in rows.to_pylist()], pa.string())
    return texts(ids)


def round_trip(docs: DataFrame, path: str, text: str = "text", name: str = "_trip") -> DataFrame:
    """``docs`` with a struct ``name``: count and digests of ids and decoded text. A column of that
    name is an error.

    The digests are taken where the ids are made, so that neither ids nor decoded
    texts leave the worker.
    """
    if name in docs.columns:
        raise ValueError(f"the table has a column {name}; give another name for the result")
    fields = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def trip(texts: pa.Array) -> pa.Array:
        bpe, numbers, rows = vocabulary(path), decimals(path), []
        for ids in encoded(texts, path):
            digits = " ".join([numbers[i] for i in ids.tolist()])
            rows.append((len(ids), hashlib.sha256(digits.encode()).hexdigest(),
                         hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
        return pa.array([dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), r)) for r in rows], fields)
    return docs.withColumn(name, trip(F.col(text)))


@lru_cache(maxsize=2)
def decimals(path: str) -> list[str]:
    return [str(i) for i in range(max(vocabulary(path).tokens) + 1)]
