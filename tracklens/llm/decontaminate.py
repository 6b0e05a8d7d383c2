"""Benchmark decontamination with suffix arrays of the training texts.

The training texts are cut into shards of whole documents. A task holds one shard at a time:
its words as numbers of the benchmark's vocabulary, and the sorted array of its suffixes.
Every suffix of every benchmark text is then searched in that array by bisection, all of
them at once. The neighbours of its place give its longest verbatim match in the shard, and
the bounds of its first words give every occurrence, and so the documents to remove. Suffixes
that begin with the same window are bisected together and then extended each, which gives every
document its longest verbatim match and the place of it.

A suffix whose words are not all known to the benchmark as far as the shortest window reaches
cannot hold a match and is left out of the array; nothing else is.

The benchmark is the query set. It is dealt into blocks of at most ``BLOCK_BYTES`` by measured
size, items longer than ``PIECE_WORDS`` in overlapping pieces. A task holds ``BLOCKS_AT_ONCE``
blocks and searches a shard for each of them while it has its words; further blocks are a further
pass over the rows of the one before, which carry what was found so far, so that rows need no numbers.

Defined results: null or wordless documents have no words and no hits; null or wordless items
have no windows; items with a null id are one item without a name, which counts among the items found
but is not listed; repeated items count once; repeated documents give repeated rows; empty tables
give no hits, or no rows; extra columns are kept, and one named as a result is replaced.
Documents are searched whole: one longer than a shard is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.llm.common import quoted, sha256_hex, staged, utf8

WINDOW = 10
#: Words compared at once while sorting; longer matches are extended word by word.
DEPTH = 16
SHARD_WORDS = 500_000
BLOCK_BYTES = 16 << 20
BLOCKS_AT_ONCE = 4
PIECE_WORDS = 500_000
#: Pairs of a benchmark suffix and a place that are extended at once.
PAIRS_AT_ONCE = 2_000_000
#: Windows of the benchmark whose keys, 64 bytes each, are held at once while a shard is searched.
KEYS_AT_ONCE = 200_000
#: Words compared one by one; what agrees beyond is measured by digests of ranges, and the best are compared again.
STEPS = 64
#: Two primes below 2**31 and their bases: digests of ranges are sums of words times powers, modulo each.
_PRIMES = ((2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353))
#: Word characters are digits, letters and everything beyond ASCII; the rest becomes a blank.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TABLE).split()


class Windows(NamedTuple):
    size: int
    #: A suffix that begins with each window, by the windows' order; keys are made from it where they are searched.
    opened: np.ndarray
    #: Suffixes by window, those of a window by the word before; window k has those from ``ends[k]`` to ``ends[k + 1]``.
    suffixes: np.ndarray
    ends: np.ndarray
    #: Window and word before of each, as one number: ascending.
    before: np.ndarray
    #: Distinct items by window, in the same way.
    items: np.ndarray
    item_ends: np.ndarray


class Benchmark:
    """One block of items ``(id or None, first word, text)``: vocabulary, words end to end, and the windows of every item."""

    def __init__(self, items: list[tuple[str | None, int, bytes]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        last = lambda name: (name is None, name or "")
        self.names = sorted({name for name, _, _ in items}, key=last)
        number = {name: k for k, name in enumerate(self.names)}
        # Columns of each item, then joined: nothing but the vocabulary is held as Python numbers.
        columns: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint32), *[np.zeros(0, np.int32)] * 3)]
        for name, begin, text in sorted(set(items), key=lambda x: (last(x[0]), x[1:])):
            own = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.uint32)
            n = len(own)
            # The last row ends the item; no document word has its number.
            columns.append((np.r_[own, np.uint32(0)], np.r_[np.full(n, number[name], np.int32), np.int32(-1)], np.arange(n, -1, -1, dtype=np.int32), np.r_[np.arange(begin, begin + n, dtype=np.int32), np.int32(-1)]))
        self.words, self.item, self.left, self.at = (np.concatenate(c) for c in zip(*columns, strict=True))
        first = np.r_[True, self.left[:-1] == 0][: len(self.item)]
        #: A suffix opens a window if the window fits into its item, or is all of a shorter item.
        opens = np.flatnonzero((self.left >= window) | (first & (self.left > 0)))
        length = np.minimum(self.left[opens], window)
        self.shortest = int(length.min()) if len(length) else window
        #: By length of window: least and greatest key of each distinct one, and the suffixes that begin with it.
        self.windows: list[Windows] = []
        for size in np.unique(length).tolist():
            own = opens[length == size]
            opened, which = distinct(self.words, own, size)
            bounds = np.arange(len(opened) + 1)
            before = (which << 32) | self.before(own)
            order = np.argsort(before, kind="stable")
            in_item = np.unique((which << 32) | self.item[own])
            self.windows.append(Windows(
                size, opened, own[order], np.searchsorted(before[order] >> 32, bounds),
                before[order], in_item & 0xFFFFFFFF, np.searchsorted(in_item >> 32, bounds),
            ))
        self._digests: list[np.ndarray] | None = None

    def before(self, suffixes: np.ndarray) -> np.ndarray:
        """The words before; 0 where an item begins."""
        return np.where(suffixes > 0, self.words[suffixes - 1], 0).astype(np.int64)

    @property
    def digests(self) -> list[np.ndarray]:
        if self._digests is None:
            self._digests = running(self.words)
        return self._digests


@lru_cache(maxsize=8)
def _powers(base: int, prime: int, n: int) -> np.ndarray:
    found = np.ones(1, np.uint64)
    while len(found) < n:
        found = np.r_[found, found * np.uint64(pow(base, len(found), prime)) % np.uint64(prime)]
    return found


def powers(base: int, prime: int, n: int) -> np.ndarray:
    return _powers(base, prime, 1 << max(1, n - 1).bit_length())[:n]


def running(words: np.ndarray) -> list[np.ndarray]:
    """For each prime the sums over the words before every place; words are numbered below 2**31, so products and sums of a shard fit."""
    made = []
    for prime, base in _PRIMES:
        terms = words.astype(np.uint64) * powers(base, prime, len(words)) % np.uint64(prime)
        made.append(np.r_[np.zeros(1, np.uint64), np.cumsum(terms)] % np.uint64(prime))
    return made


def packed(words: np.ndarray, at: np.ndarray, size: np.ndarray | int, fill: int = 0) -> np.ndarray:
    """``size`` words from each place on, filled up to ``DEPTH``, as byte strings that sort like the words."""
    column, size = np.arange(DEPTH, dtype=np.int32), np.broadcast_to(np.asarray(size), len(at))
    rows = np.zeros((len(at), DEPTH), ">u4")
    for k in range(0, len(at), KEYS_AT_ONCE):
        own = slice(k, k + KEYS_AT_ONCE)
        index = at[own].astype(np.int32)[:, None] + column
        np.minimum(index, max(0, len(words) - 1), out=index)
        rows[own] = words[index]
        rows[own][column >= size[own][:, None]] = fill
    return rows.view(f"S{4 * DEPTH}").ravel()


def distinct(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the places with equal windows the first, in the windows' order, and of every place the number of its window."""
    keys = packed(words, at, size)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(at), bool)
    for a in range(1, len(at), KEYS_AT_ONCE):
        b = min(a + KEYS_AT_ONCE, len(at))
        new[a:b] = keys[order[a:b]] != keys[order[a - 1 : b - 1]]
    which = np.empty(len(at), np.int64)
    which[order] = np.cumsum(new) - 1
    return at[order[new]], which


class SuffixArray:
    """The suffixes of one shard in the order of their first ``DEPTH`` words, each ending with its document."""

    def __init__(self, words: np.ndarray, left: np.ndarray, shortest: int) -> None:
        self.words, self.left = words, left
        known = np.cumsum(np.r_[0, words > 0])
        at = np.flatnonzero(left >= shortest)
        at = at[known[at + shortest] - known[at] == shortest]
        keys = packed(words, at, left[at])
        order = np.argsort(keys, kind="stable")
        self.at, self.keys = at[order], keys[order]
        self._digests: list[np.ndarray] | None = None

    def between(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the ranges its number and the places in it, one row per place."""
        count = high - low
        which = np.repeat(np.arange(len(low)), count)
        index = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        return which, self.at[index]

    def occurrences(self, bench: Benchmark) -> Iterator[tuple[Windows, np.ndarray, np.ndarray]]:
        """By length: numbers of windows and the places where they stand."""
        for windows in bench.windows:
            yield windows, *self.between(*self.bounds(bench, windows.opened, windows.size))

    def bounds(self, bench: Benchmark, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of these benchmark suffixes the range of those here that begin with the same words."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(0, len(at), KEYS_AT_ONCE):
            own = at[k : k + KEYS_AT_ONCE]
            found.append((np.searchsorted(self.keys, packed(bench.words, own, size), "left"), np.searchsorted(self.keys, packed(bench.words, own, size, fill=0xFFFFFFFF), "right")))
        return tuple(np.concatenate(side) for side in zip(*found, strict=True))

    def begins(self, windows: Windows, bench: Benchmark, which: np.ndarray, place: np.ndarray, exact: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Suffixes, places and lengths of the matches that begin at these occurrences, so many pairs at once.

        A match that the words before belong to is told where it begins. So a place meets the suffixes of its window but
        for those with its own word before, which lie together: a run of one word makes as many pairs as it has words, not their square.
        """
        inner = (place > 0) & (self.left[place - 1] == self.left[place] + 1)
        own = (which.astype(np.int64) << 32) | np.where(inner, self.words[place - 1], 0)
        known = (own & 0xFFFFFFFF) > 0
        skip_from = np.where(known, np.searchsorted(windows.before, own, "left"), windows.ends[which + 1])
        skip_to = np.where(known, np.searchsorted(windows.before, own, "right"), windows.ends[which + 1])
        low = np.stack([windows.ends[which], skip_to], axis=1).ravel()
        count = np.stack([skip_from, windows.ends[which + 1]], axis=1).ravel() - low
        places = np.repeat(place, 2)
        low, places, count = low[count > 0], places[count > 0], count[count > 0]
        done = np.r_[0, np.cumsum(count)]
        for begin in range(0, int(done[-1]), PAIRS_AT_ONCE):
            pair = np.arange(begin, min(begin + PAIRS_AT_ONCE, int(done[-1])))
            of = np.searchsorted(done, pair, "right") - 1
            suffix, at = windows.suffixes[low[of] + pair - done[of]], places[of]
            yield suffix, at, self._agree(bench, suffix, at, exact)

    def verified(self, bench: Benchmark, suffix: np.ndarray, place: np.ndarray, size: np.ndarray) -> bool:
        """Whether matches of these lengths are there word by word."""
        return all(np.array_equal(self.words[p : p + n], bench.words[s : s + n]) for s, p, n in zip(suffix.tolist(), place.tolist(), size.tolist(), strict=True) if n > STEPS)

    def longest(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """For every benchmark suffix the length of its longest match here, and its first place."""
        n = len(bench.words)
        best, where = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        if not len(self.at) or not n:
            return best, where
        least = _Least(self.at)
        for k in range(0, n, KEYS_AT_ONCE):
            own = np.arange(k, min(k + KEYS_AT_ONCE, n))
            low = np.searchsorted(self.keys, packed(bench.words, own, bench.left[own]), "left")
            # The neighbours in order agree longest, so their agreement is the length up to DEPTH.
            for near in (self.at[np.maximum(low - 1, 0)], self.at[np.minimum(low, len(self.at) - 1)]):
                best[own] = np.maximum(best[own], self._agree(bench, own, near, most=DEPTH))
            some = own[best[own] > 0]
            low = np.searchsorted(self.keys, packed(bench.words, some, best[some]), "left")
            high = np.searchsorted(self.keys, packed(bench.words, some, best[some], fill=0xFFFFFFFF), "right")
            where[some] = least.of(low, high)
        full = np.flatnonzero(best == DEPTH)
        if len(full):
            self._beyond(bench, full, best, where)
        return best, where

    def _beyond(self, bench: Benchmark, full: np.ndarray, best: np.ndarray, where: np.ndarray, exact: bool = False) -> None:
        """The lengths of ``DEPTH`` words and more.

        A match of a suffix is the rest of one that begins at it or before, so the matches that begin tell all: at each suffix the one
        that ends last counts, of those that end there the one with the first place. Both are a running maximum.
        """
        opened, which = distinct(bench.words, full, DEPTH)
        before = (which << 32) | bench.before(full)
        order = np.argsort(before, kind="stable")
        ends, none = np.searchsorted(before[order] >> 32, np.arange(len(opened) + 1)), np.zeros(0, np.int64)
        windows = Windows(DEPTH, opened, full[order], ends, before[order], none, none)
        of, place = self.between(*self.bounds(bench, opened, DEPTH))
        last = np.full(len(bench.words), -1, np.int64)
        for suffix, at, size in self.begins(windows, bench, of, place, exact):
            np.maximum.at(last, suffix, ((suffix + size) << 32) - (at - suffix + (1 << 31)))
        last = np.maximum.accumulate(last)
        end = (last >> 32) + 1  # what is taken off is between 0 and 2**32
        apart = (end << 32) - last - (1 << 31)
        at = np.arange(len(last))
        own = np.flatnonzero((last >= 0) & (end - at >= DEPTH))
        told = own[np.r_[True, last[own][1:] != last[own][:-1]]] if len(own) else own
        if not exact and not self.verified(bench, told, told + apart[told], end[told] - told):
            return self._beyond(bench, full, best, where, exact=True)
        best[own], where[own] = end[own] - own, own + apart[own]
        return None

    def _agree(self, bench: Benchmark, suffix: np.ndarray, place: np.ndarray, exact: bool = False, most: int | None = None) -> np.ndarray:
        """How many words agree; beyond ``STEPS``, and unless ``exact``, by digests, which can only tell too many."""
        limit = np.minimum(bench.left[suffix], self.left[place])
        if most is not None:
            limit = np.minimum(limit, most)
        size = np.zeros(len(suffix), np.int64)
        live, k = np.flatnonzero(limit > 0), 0
        while len(live) and (exact or most is not None or k < STEPS):
            live = live[bench.words[suffix[live] + k] == self.words[place[live] + k]]
            k += 1
            size[live] = k
            live = live[limit[live] > k]
        if len(live):
            size[live] = self._by_digest(bench, suffix[live], place[live], limit[live], k)
        return size

    def _by_digest(self, bench: Benchmark, suffix: np.ndarray, place: np.ndarray, limit: np.ndarray, known: int) -> np.ndarray:
        """Bisection for the greatest length whose digests are equal."""
        if self._digests is None:
            self._digests = running(self.words)
        power = [powers(base, prime, max(len(self.words), len(bench.words)) + 1) for prime, base in _PRIMES]
        low, high = np.full(len(suffix), known, np.int64), limit.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = np.ones(len(suffix), bool)
            for (prime, _), mine, theirs, p in zip(_PRIMES, self._digests, bench.digests, power, strict=True):
                m = np.uint64(prime)
                a = (mine[place + middle] + m - mine[place]) % m * p[suffix] % m
                b = (theirs[suffix + middle] + m - theirs[suffix]) % m * p[place] % m
                equal &= a == b
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low


class _Least:
    """The least value of ranges, by minima over ranges of powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while len(self.levels[-1]) > (size := 1 << (len(self.levels) - 1)):
            self.levels.append(np.minimum(self.levels[-1][:-size], self.levels[-1][size:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """None of the ranges is empty."""
        found, level = np.empty(len(low), np.int64), np.frexp(high - low)[1] - 1
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            found[own] = np.minimum(self.levels[k][low[own]], self.levels[k][high[own] - (1 << k)])
        return found


class _Shard:
    """The words of documents gathered until there are enough."""

    def __init__(self) -> None:
        self.words: list[list[bytes]] = []
        self.total = 0

    def add(self, text: bytes) -> None:
        self.words.append(words_of(text))
        self.total += len(self.words[-1])

    @property
    def sizes(self) -> list[int]:
        return [len(w) for w in self.words]

    def arrays(self, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        get, sizes = vocabulary.get, np.array(self.sizes, np.int64)
        words = np.fromiter((get(w, 0) for own in self.words for w in own), np.uint32, self.total)
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        return words, np.repeat(ends, sizes) - np.arange(len(words)), doc, ends - sizes


def _runs(hit: np.ndarray, start: int, size: int) -> list[list[int]]:
    """The runs of hit words of one document, as [from, to)."""
    own = np.flatnonzero(np.diff(np.r_[False, hit[start : start + size], False].astype(np.int8)))
    return own.reshape(-1, 2).tolist()


class Found(NamedTuple):
    """What one document holds; ``longest`` is the length of a match, its word, and the item and word that it is of."""

    runs: list[list[int]]
    items: list[str]
    unnamed: bool
    longest: tuple[int, int, str | None, int] | None


NOTHING = Found([], [], False, None)


def _longest_of_each(array: SuffixArray, bench: Benchmark, windows: Windows, which: np.ndarray, place: np.ndarray, doc: np.ndarray, exact: bool) -> tuple[np.ndarray, ...]:
    """Suffix, place, length and document of the longest match of each document; of equals the first in it, then the first item and place."""
    kept = tuple(np.zeros(0, np.int64) for _ in range(3))
    for more in array.begins(windows, bench, which, place, exact):
        suffix, at, size = (np.r_[a, b] for a, b in zip(kept, more, strict=True))
        order = np.lexsort([bench.at[suffix], bench.item[suffix], at, -size, doc[at]])
        _, firsts = np.unique(doc[at][order], return_index=True)
        kept = tuple(x[order[firsts]] for x in (suffix, at, size))
    return (*kept, doc[kept[1]])


def search_shard(shard: _Shard, bench: Benchmark) -> dict[int, Found]:
    """By number of the document, what each that has a hit holds."""
    words, left, doc, starts = shard.arrays(bench.vocabulary)
    edge = np.zeros(len(words) + 1, np.int64)
    items: dict[int, set[int]] = {}
    best: dict[int, tuple] = {}
    array = SuffixArray(words, left, bench.shortest)
    for windows, which, place in array.occurrences(bench):
        np.add.at(edge, place, 1)
        np.add.at(edge, place + windows.size, -1)
        for d, w in np.unique(np.stack([doc[place], which], axis=1), axis=0).tolist():
            items.setdefault(d, set()).update(windows.items[windows.item_ends[w] : windows.item_ends[w + 1]].tolist())
        for exact in (False, True):
            own = _longest_of_each(array, bench, windows, which, place, doc, exact)
            if exact or array.verified(bench, *own[:3]):
                break
        for suffix, at, size, d in zip(*map(np.ndarray.tolist, own), strict=True):
            mine = (-size, int(at - starts[d]), int(bench.item[suffix]), int(bench.at[suffix]))
            best[d] = min(best.get(d, mine), mine)
    hit = np.cumsum(edge[:-1]) > 0
    found = {}
    for d, own in items.items():
        size, at, item, word = best[d]
        names = [bench.names[i] for i in sorted(own)]
        found[d] = Found(_runs(hit, starts[d], shard.sizes[d]), [n for n in names if n is not None], None in names, (-size, at, bench.names[item], word))
    return found


def merged(a: Found, b: Found) -> Found:
    if a.longest is None or b.longest is None:
        return a if b.longest is None else b
    runs: list[list[int]] = []
    for x, y in sorted(a.runs + b.runs):
        if runs and runs[-1][1] >= x:
            runs[-1][1] = max(runs[-1][1], y)
        else:
            runs.append([x, y])
    order = lambda m: (-m[0], m[1], m[2] is None, m[2] or "", m[3])
    return Found(runs, sorted({*a.items, *b.items}), a.unnamed or b.unnamed, min(a.longest, b.longest, key=order))


MATCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("word", T.LongType()), T.StructField("item", T.StringType()), T.StructField("item_word", T.LongType())])
HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("unnamed", T.BooleanType()),
    T.StructField("longest", MATCH),
])
_MATCH = pa.struct([("n", pa.int64()), ("word", pa.int64()), ("item", pa.string()), ("item_word", pa.int64())])
_ARROW = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.bool_(), _MATCH]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """The items ``(item, begin, body)`` as blocks that are each proven to hold at most ``BLOCK_BYTES``, or one piece.

    Longer items are cut into pieces that overlap by all but one word of a window, so that every window lies in one.
    Only sizes of blocks come to the driver here; while a block is too large, there are twice as many.
    """
    items = benchmark.select(quoted(item_col).cast("string").alias("item"), quoted(text_col).alias("body"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = words_of(text)
                for begin in range(0, max(1, len(words) - WINDOW + 1), PIECE_WORDS):
                    body = b" ".join(words[begin : begin + PIECE_WORDS + WINDOW - 1])
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([begin], pa.int64()), pa.array([body], pa.binary())], names=["item", "begin", "body"])

    items = staged(items.mapInArrow(cut, "item string, begin long, body binary").filter("length(body) > 0").distinct(), "benchmark-items")
    n = 1
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "begin", "body"), F.lit(n)))
        sizes = dealt.groupBy("block").agg(F.sum(F.length("body") + F.coalesce(F.octet_length("item"), F.lit(0))).alias("size"), F.count("*").alias("many"))
        if not sizes.filter((F.col("size") > BLOCK_BYTES) & (F.col("many") > 1)).limit(1).count():
            return [dealt.filter(F.col("block") == b).select("item", "begin", "body") for b in range(n)]
        n *= 2


def hits(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``n_words``, ``runs`` of hit words, the ``items`` found, ``unnamed`` ones, and the ``longest`` match, per document."""
    made = set(HITS.fieldNames())
    keep = [c for c in (documents.columns if keep is None else keep) if c.lower() not in made]
    found = documents.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(text_col).alias("body"))
    kept = found.columns
    blocks = blocks_of(benchmark, item_col, item_text_col)
    for k in range(0, len(blocks), BLOCKS_AT_ONCE):
        found = _pass(found if k == 0 else staged(found, "decontaminated"), blocks[k : k + BLOCKS_AT_ONCE], kept)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *HITS.fieldNames())


def _collected(block: DataFrame) -> list[tuple[str | None, int, bytes]]:
    return [(r["item"], r["begin"], bytes(r["body"])) for r in block.collect()]  # at most BLOCK_BYTES, or one piece


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Shard, pa.RecordBatch]]:
    """Shards with their rows; the text is the column ``body``."""
    for batch in batches:
        shard, start = _Shard(), 0
        for k, text in enumerate(utf8(batch.column("body"))):
            shard.add(text)
            if shard.total >= SHARD_WORDS:
                yield shard, batch.slice(start, k + 1 - start)
                shard, start = _Shard(), k + 1
        if start < batch.num_rows:
            yield shard, batch.slice(start)


def _pass(found: DataFrame, blocks: list[DataFrame], kept: list[str]) -> DataFrame:
    shared = [found.sparkSession.sparkContext.broadcast(_collected(b)) for b in blocks]
    schema = T.StructType([*[found.schema[c] for c in kept], *HITS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benches = [Benchmark(s.value) for s in shared]
        for shard, rows in _shards(batches):
            out = [NOTHING] * rows.num_rows
            if "runs" in rows.schema.names:
                before = zip(*[rows.column(c).to_pylist() for c in ("runs", "items", "unnamed", "longest")], strict=True)
                out = [Found(r, i, u, tuple(m.values()) if m else None) for r, i, u, m in before]
            for bench in benches:
                for d, own in search_shard(shard, bench).items():
                    out[d] = merged(out[d], own)
            longest = [None if f.longest is None else dict(zip(("n", "word", "item", "item_word"), f.longest, strict=True)) for f in out]
            made = [shard.sizes, [f.runs for f in out], [f.items for f in out], [f.unnamed for f in out], longest]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], *[pa.array(m, k) for m, k in zip(made, _ARROW, strict=True)]], names=schema.fieldNames())

    return found.mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """Adds ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, and the longest match with its place."""
    return found.withColumns({
        "n_hit": F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0]),
        "n_items": F.size("items").cast("long") + F.col("unnamed").cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ","), 256),
        "longest_match": F.coalesce("longest.n", F.lit(0)),
        "match_word": F.col("longest.word"),
        "match_item": F.col("longest.item"),
        "match_item_word": F.col("longest.item_word"),
    }).withColumn("contaminated", F.col("n_hit") > 0)


def longest_matches(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For every benchmark suffix that matches anywhere: its longest verbatim match and where.

    Columns ``item, item_word, n_match, doc, doc_word``; of equally long matches the smallest
    document and place. Each shard sends at most one row per suffix, which are reduced by key. A match that
    runs beyond a piece of a very long item is told up to the piece's end.
    """
    spark, parts = documents.sparkSession, []
    source = documents.select(quoted(id_col).cast("string").alias("doc"), quoted(text_col).alias("body"))
    for block in blocks_of(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(_collected(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(shared.value)
            for shard, rows in _shards(batches):
                ids = rows.column("doc").to_pylist()
                words, left, doc, starts = shard.arrays(bench.vocabulary)
                size, where = SuffixArray(words, left, 1).longest(bench)
                ok = np.flatnonzero(size > 0)
                at = where[ok]
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array([bench.names[i] for i in bench.item[ok]], pa.string()),
                    "item_word": pa.array(bench.at[ok], pa.int64()),
                    "n_match": pa.array(size[ok], pa.int64()),
                    "doc": pa.array([ids[d] for d in doc[at]], pa.string()),
                    "doc_word": pa.array(at - starts[doc[at]], pa.int64()),
                })

        parts.append(source.mapInArrow(run, "item string, item_word long, n_match long, doc string, doc_word long"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.groupBy("item", "item_word").agg(F.min_by(F.struct("n_match", "doc", "doc_word"), F.struct(-F.col("n_match"), "doc", "doc_word")).alias("m"))
    return best.select("item", "item_word", "m.*")


def clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without those that hold a benchmark window."""
    names = documents.columns
    inner = documents.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])
    done = hits(inner, benchmark, f"c{names.index(text_col)}").filter(F.size("runs") == 0)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
