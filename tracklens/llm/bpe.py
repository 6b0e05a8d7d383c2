"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has one encoding, and every encoding is its prefix's encoding plus
one last token. So it is enough to store, for each byte prefix, that unique valid last token:
reading the tokens back from the end gives the encoding of any prefix, appending bytes only
adds entries, and an edit invalidates only the entries behind it.

A token may follow another exactly if encoding their joined bytes gives these two tokens
again, which ``Vocabulary.follows`` decides by undoing their merges from the latest on.

Defined results: a null text encodes as the empty one (no ids); text is never cut, and a piece
of any length costs time linear in its bytes; repeated rows give repeated results; an input
column named as an output one is replaced.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracklens.llm.common import map_columns, quoted, sha256_hex, texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces and pairs remembered by a worker; when full they are forgotten and computed again.
PIECES_KEPT = 400_000
PAIRS_KEPT = 1_000_000
LONGEST_KEPT = 64


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.text_of = {r: str(r) for r in self.bytes_of}
        #: Whether a byte string is a token or only the end of longer ones.
        self.ends = {t[k:]: None for t in self.rank for k in range(1, len(t))} | self.rank
        #: The two tokens that the merge making a token joins; itself twice if it is one byte.
        self.halves: dict[int, tuple[int, int]] = {}
        #: Tokens that merging never makes from their bytes; they only stand for whole pieces.
        self.unmade: set[int] = set()
        for token, r in self.rank.items():
            self.halves[r] = (r, r) if len(token) == 1 else self._split(token, r)
        self._pairs: dict[tuple[int, int], bool] = {}
        #: Two generations: when the newer is full it becomes the older, so common pieces stay.
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def _split(self, token: bytes, rank: int) -> tuple[int, int]:
        parts = self.merge(token, below=rank)
        if len(parts) != 2:
            self.unmade.add(rank)
            return (rank, rank)
        return (parts[0], parts[1])

    def merge(self, data: bytes, below: int | None = None) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals: the definition."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(
                ((r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None),
                default=None,
            )
            if best is None or (below is not None and best[0] >= below):
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand directly after ``left`` in an encoding."""
        known = self._pairs.get((left, right))
        if known is None:
            known = self._clean_border(left, right)
            if len(self._pairs) >= PAIRS_KEPT:
                self._pairs.clear()
            self._pairs[left, right] = known
        return known

    def _clean_border(self, left: int, right: int) -> bool:
        """Goes back in time: was there a moment when the parts at the border would have merged?

        The part made last is undone first. While a part stands undone, the border must not hold a
        merge of lower rank than the merge undone last; the left part wins among equal ranks.
        """
        a, b, before = left, right, float("inf")
        while True:
            joined = self.rank.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < before:
                return False
            a_whole, b_whole = self.halves[a][1] == a, self.halves[b][0] == b
            if a_whole and b_whole:
                return True
            if b_whole or (not a_whole and a > b):
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece of split text."""
        found = self._older.get(text)
        if found is None:
            data = text.encode()
            whole = self.rank.get(data)
            found = (whole,) if whole is not None else tuple(PrefixTable(self, data).tokens())
        if len(text) <= LONGEST_KEPT:
            if len(self._pieces) >= PIECES_KEPT:
                self._pieces, self._older = {}, self._pieces
            self._pieces[text] = found
        return found

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        add = ids.extend
        for p in split(text):
            add(self._pieces.get(p) or self.piece(p))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """The unique valid last token of every byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Adds bytes at the end; entries of the old prefixes stay as they are.

        For each new end, tokens are tried from the longest down: the one that may follow the
        last token of what stands before it is the last token of this prefix.
        """
        self.data += more
        self._fill(len(self.data))

    def _fill(self, to: int) -> None:
        """Adds the entries of prefixes of up to ``to`` bytes."""
        v = self.vocabulary
        data, last, ends, unmade, pairs = self.data, self.last, v.ends, v.unmade, v._pairs
        for j in range(len(last), to + 1):
            found, i = [], j - 1
            while i >= 0 and (part := data[i:j]) in ends:
                if (token := ends[part]) is not None and token not in unmade:
                    found.append((i, token))
                i -= 1
            for i, token in reversed(found):  # the longest first
                if i == 0 or (ok := pairs.get((last[i], token))) or (ok is None and v.follows(last[i], token)):
                    last.append(token)
                    break

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Edits the piece and encodes again from the edit on, until the old entries hold again.

        An entry depends on the bytes and entries of as many prefixes as the longest token has bytes. When so many behind
        the edit are what they were, all others are too.
        """
        old, at, longest = self.last, start + len(new), self.vocabulary.longest
        shift = at - end
        self.data, self.last = self.data[:start] + new + self.data[end:], old[: start + 1]
        self._fill(at)
        while at < len(self.data):
            to = min(at + longest, len(self.data))
            self._fill(to)
            if to - at == longest and self.last[at + 1 :] == old[at + 1 - shift : to + 1 - shift]:
                self.last += old[to + 1 - shift :]
                return
            at = to

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix of ``end`` bytes, all of them by default."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes_of[self.last[at]])
        return out[::-1]


split = regex.compile(public_tokenizers.PATTERN).findall


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary(path)


def encode(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``ids`` (array of int) and ``n_tokens`` of every whole text."""
    path = path or public_tokenizers.path(VOCABULARY)
    made = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        v = vocabulary(path)
        ids = [v.encode(t) for t in texts(columns[0])]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())]

    return map_columns(df, [quoted(text_col)], df.columns if keep is None else keep, made, work)


def decode(df: DataFrame, ids_col: str = "ids", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``decoded`` (binary): the bytes of a column of ids; null ids give null."""
    path = path or public_tokenizers.path(VOCABULARY)
    made = T.StructType([T.StructField("decoded", T.BinaryType())])

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        v = vocabulary(path)
        return [pa.array([None if x is None else v.decode(x) for x in columns[0].to_pylist()], pa.binary())]

    return map_columns(df, [quoted(ids_col)], df.columns if keep is None else keep, made, work)


def round_trip(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Encodes, decodes the ids, and keeps counts and digests only: nothing long leaves the task."""
    path = path or public_tokenizers.path(VOCABULARY)
    made = T.StructType([
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ])

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        v = vocabulary(path)
        shown, out = v.text_of.__getitem__, []
        for t in texts(columns[0]):
            ids = v.encode(t)
            out.append((len(ids), sha256_hex(",".join(map(shown, ids)).encode()), sha256_hex(v.decode(ids))))
        by = list(zip(*out, strict=True)) if out else [[], [], []]
        return [pa.array(by[0], pa.int64()), pa.array(by[1], pa.string()), pa.array(by[2], pa.string())]

    return map_columns(df, [quoted(text_col)], df.columns if keep is None else keep, made, work)
