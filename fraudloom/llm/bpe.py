"""Reasons as tokens of a public word-level BPE vocabulary, and back.

A short word holds its parts between boundaries and the ranks of adjacent parts in two contiguous arrays: the least rank is looked
for again and again, the boundary between its two parts goes, and only the ranks beside it are looked up anew. A word beyond ``LONG``
parts would scan too often; it keeps the same ranks in a heap and joins in the same order. Words repeat, so each worker remembers
the tokens of the last ones it met.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from struct import pack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fraudloom.llm.common import map_rows

LONG = 100  # parts of a word beyond which ranks go to a heap
REMEMBERED = 1 << 19  # pieces a worker remembers before it starts afresh (under 100 MB)
BLOCK = 1 << 20  # characters of a long text cut into words at a time

#: White space of the words' pattern. ``str.split`` also cuts at ``NOT_SPACE``.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_SPACE = re.compile("[\x1c-\x1f]")
END = "</w>"
_NEVER = 1 << 60


@cache
def word_pattern() -> re.Pattern:
    """Contractions, runs of letters, single digits, and runs of other signs."""
    letters, digits = (_class(kind) for kind in "LN")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{SPACE}{letters}{digits}]+")


def _class(kind: str) -> str:
    """Ranges of the characters whose Unicode category starts with ``kind``."""
    has = np.array([unicodedata.category(chr(c))[0] == kind for c in range(0x110000)] + [False])
    edges = np.flatnonzero(has != np.concatenate([[False], has[:-1]])).reshape(-1, 2)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.tolist())


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it prints in Latin-1, otherwise the next one from U+0100 on."""
    letters = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = iter(range(256, 512))
    return [letters.get(b) or chr(next(rest)) for b in range(256)]


class WordBPE(dict):
    """A vocabulary file, and the tokens of the pieces (text without white space) and words met lately, as bytes of ids.

    Ids are little-endian unsigned 32-bit integers. ``rank`` holds, for two adjacent parts' ids, the rank of their joint and its id.
    """

    def __init__(self, spec: bytes) -> None:
        super().__init__()
        model = json.loads(spec)
        ids: dict[str, int] = model["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.rank = {ids[a] << 32 | ids[b]: i << 32 | ids[a + b] for i, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.words, self.known = word_pattern().findall, {}
        self.inner, self.last = [ids[c] for c in letters], [ids[c + END] for c in letters]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")" if self.special else r"(?!)()")
        names = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        self.names = [names.get(i) for i in range(max(names, default=-1) + 1)]

    def __missing__(self, piece: str) -> bytes:
        words, known = self.words(piece), self.known
        for word in words:
            if word not in known:
                ids = self.word(word)
                known[word] = pack(f"<{len(ids)}I", *ids)
        tokens = known[words[0]] if len(words) == 1 else b"".join([known[word] for word in words])
        if len(piece) <= LONG:
            self[piece] = tokens
        if len(self) >= REMEMBERED or len(known) >= REMEMBERED or len(piece) > LONG:
            known.clear()
        if len(self) >= REMEMBERED:
            self.clear()
        return tokens

    def word(self, word: str) -> list[int]:
        """Ids of one word; its last part carries the word's end."""
        data = word.encode()
        part = [*map(self.inner.__getitem__, data)]
        part[-1] = self.last[data[-1]]
        if len(part) > LONG:
            return self._heaped(part)
        get = self.rank.get
        rank = [get(a << 32 | b, _NEVER) for a, b in pairwise(part)]
        while rank and (low := min(rank)) != _NEVER:
            i = rank.index(low)
            del part[i + 1], rank[i]
            part[i] = made = low & 0xFFFFFFFF
            if i:
                rank[i - 1] = get(part[i - 1] << 32 | made, _NEVER)
            if i < len(rank):
                rank[i] = get(made << 32 | part[i + 1], _NEVER)
        return part

    def _heaped(self, part: list[int]) -> list[int]:
        n, get = len(part), self.rank.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int]] = []

        def look(i: int, j: int) -> None:
            pair = part[i] << 32 | part[j]
            if (r := get(pair)) is not None:
                heapq.heappush(heap, (r, i, pair))

        for i in range(n - 1):
            look(i, i + 1)
        while heap:
            r, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or part[i] < 0 or part[i] << 32 | part[j] != pair:
                continue  # one of the two has been joined meanwhile
            part[i], part[j], after[i] = r & 0xFFFFFFFF, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                look(i, after[j])
            if before[i] >= 0:
                look(before[i], i)
        return [p for p in part if p >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text. Special tokens' strings in it become their ids."""
        out: list[bytes] = []
        for i, piece in enumerate(self.cut.split(text)):
            if i % 2:
                out.append(self.special[piece].to_bytes(4, "little"))
            elif piece:
                # Lower-casing goes character by character, so sigma has no final form.
                plain = unicodedata.normalize("NFC", piece).replace("\u03a3", "\u03c3").lower()
                for block in _blocks(plain):
                    out += map(self.__getitem__, re.split(f"[{SPACE}]+", block) if NOT_SPACE.search(block) else block.split())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Token strings joined by a space, special ones included; numbers outside the vocabulary are left out."""
        names, most = self.names, len(self.names)
        return " ".join([s for i in np.frombuffer(ids, "<u4").tolist() if i < most and (s := names[i]) is not None])


def _blocks(plain: str) -> Iterator[str]:
    """Pieces of a text cut at spaces, which no word spans."""
    at = 0
    while len(plain) - at > BLOCK:
        stop = plain.find(" ", at + BLOCK)
        if stop < 0:
            break
        yield plain[at:stop]
        at = stop
    yield plain[at:] if at else plain


_LOADED: dict[str, WordBPE] = {}


def _shared(df: DataFrame, vocabulary: str):
    """Loader of the vocabulary for tasks; the file, one or two megabytes whatever the records, is broadcast."""
    with open(vocabulary, "rb") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())

    def load() -> WordBPE:
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = WordBPE(spec.value)
        return _LOADED[vocabulary]

    return load


def encode_reasons(records: DataFrame, vocabulary: str) -> DataFrame:
    """Tokens of every ``reason``.

    ``records``: ``reason``; all other columns (``event_id``, ``title``, ...) pass through, ``reason`` included. ``vocabulary`` is the
    path of a vocabulary file with word ends. Adds ``token_ids`` (binary: ids in order, each a little-endian unsigned 32-bit integer)
    and ``n_tokens``; input columns of these names are replaced. Null and empty text has no tokens. Text is composed (NFC), white
    space is dropped and letters are lower-cased; strings of special tokens become their ids; no others are added. Texts of any
    length are taken whole. Repeated rows give repeated results, an empty table an empty one.
    """
    load = _shared(records, vocabulary)

    def run(texts: list):
        bpe = load()
        ids = [bpe.encode(t) if t else b"" for t in texts]
        return ids, [len(x) // 4 for x in ids]

    return map_rows(records, ["reason"], {"token_ids": T.BinaryType(), "n_tokens": T.LongType()}, run)


def decode_tokens(records: DataFrame, vocabulary: str) -> DataFrame:
    """``decoded`` text of ``token_ids`` as ``encode_reasons`` gives them: token strings, word ends shown, joined by spaces.

    All columns pass through; one named ``decoded`` is replaced. Null ids give null, no ids the empty text.
    """
    load = _shared(records, vocabulary)
    return map_rows(records, ["token_ids"], {"decoded": T.StringType()}, lambda ids: [[None if x is None else load().decode(x) for x in ids]])
