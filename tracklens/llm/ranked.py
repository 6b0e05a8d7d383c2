"""Ranked lexical search over geometric blocks of every term's postings.

Documents are laid out by the terms that weigh most in them, and every posting list is cut, chunk by chunk of
them, into blocks of documents that are alike: some members serve as centres and each joins the centre that points most nearly where it does.
A block keeps its members and a summary, the largest impact of each term among them. The sum of a
search's weights times the summary bounds the score of every member, and a block is passed over only
when that bound is below the score of a tenth document that is known already. Nothing else is left
out: bounds and scores are whole numbers, no list is cut and no summary thinned, so results are exact.

Terms are numbered from the rarest to the commonest. A document's score is taken in the list of the rarest term that it
shares with the search, so a block's summary needs only its own and commoner terms, and the common
lists, whose bounds are sums of few small weights, are mostly passed over as a whole.

Jobs: the documents are read once for each block of searches and kept as counts of the searches' terms;
these, a small part of the texts, are all that is shuffled, and the index is written from them; a first pass scores each search's best block in every
chunk, which gives the score to beat; a second pass scores whatever can reach it. A task returns ten rows
a search at most. Only searches are broadcast, at most ``BLOCK_ITEMS`` of them and ``BLOCK_BYTES`` of terms, or one.

Defined results: null or wordless documents are not counted and not found; null or wordless items
find nothing; rows with a null id rank behind all others of their score; repeated documents rank one behind
the other; repeated items are searches of their own; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.llm.common import quoted, staged, utf8

TOP = 10
#: Searches, and bytes of their terms, of one pass over the documents.
BLOCK_ITEMS, BLOCK_BYTES = 2000, 8 << 20
#: Documents and postings of a chunk, and members of a block.
CHUNK_DOCS, CHUNK_POSTINGS, BLOCK_DOCS = 2048, 1 << 18, 32
#: Chunks of a partition.
PARTITION_CHUNKS = 4

#: Letters to lower case and all other ASCII that is not a digit to blanks; what is not ASCII belongs to terms.
_SEPARATED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_SEPARATED).split()


@dataclass
class Searches:
    """A block of searches: the numbers of their terms, from rare to common, and the terms' weights."""

    numbers: list[np.ndarray]
    weight: np.ndarray
    at: dict[int, list[tuple[int, int]]] = field(init=False)

    def __post_init__(self) -> None:
        self.at = {}
        for s, own in enumerate(self.numbers):
            for i, t in enumerate(own.tolist()):
                self.at.setdefault(t, []).append((s, i))

    def after(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of term ``t``: the terms from it on that a search has together with it; the searches that have it; each one's columns among those terms, and where they begin."""
        held = self.at[t]
        parts = [self.numbers[s][i:] for s, i in held]
        terms, columns = np.unique(np.concatenate(parts), return_inverse=True)
        return terms, np.array([s for s, _ in held]), columns, np.cumsum([0, *map(len, parts[:-1])])


@dataclass
class Chunk:
    """Documents as sorted term numbers with impacts, and their part of every posting list in blocks."""

    doc_id: pa.Array
    first: np.ndarray  # of a document's terms
    term: np.ndarray
    impact: np.ndarray
    list_term: np.ndarray
    list_first: np.ndarray  # of a list's blocks
    member_first: np.ndarray  # of a block's members
    member: np.ndarray
    most_first: np.ndarray  # of a block's summary
    most_term: np.ndarray
    most: np.ndarray

    ARRAYS = "first term impact list_term list_first member_first member most_first most_term most".split()


INDEX = "doc_id array<bigint>, " + ", ".join(f"{c} array<int>" for c in Chunk.ARRAYS)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _dense(row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, np.int64)
    out[row, column] = value
    return out


def _alike(points: np.ndarray) -> np.ndarray:
    """A block number for every member: by the nearest of the centres, in runs of at most ``BLOCK_DOCS``."""
    near = points.astype(np.float32)
    centres = near[::BLOCK_DOCS]
    label = np.argmax(near @ (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1)).T, axis=1)
    order = np.argsort(label, kind="stable")
    ordered = label[order]
    inside = np.arange(len(order)) - np.searchsorted(ordered, ordered)
    new = np.concatenate([[False], (ordered[1:] != ordered[:-1]) | (inside[1:] % BLOCK_DOCS == 0)])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def chunk_of(doc_id: pa.Array, first: np.ndarray, term: np.ndarray, impact: np.ndarray, searches: Searches) -> Chunk:
    """The index of some documents, whose terms are ascending in each."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    by_term = np.argsort(term, kind="stable")
    list_term, begin = np.unique(term[by_term], return_index=True)
    place = np.full(len(searches.weight), -1)
    lists, members, sizes, most_terms, mosts, most_sizes = [0], [], [], [], [], []
    for t, postings in zip(list_term.tolist(), np.split(by_term, begin[1:]), strict=True):
        terms, *_ = searches.after(t)
        place[terms] = np.arange(len(terms))
        docs = doc[postings]
        size = first[docs + 1] - postings
        cells = _ranges(postings, size)
        row, column = np.repeat(np.arange(len(docs)), size), place[term[cells]]
        ok = column >= 0
        row, column, value = row[ok], column[ok], impact[cells[ok]]
        place[terms] = -1
        block = np.zeros(len(docs), np.int64)
        if len(docs) > BLOCK_DOCS:
            block = _alike(_dense(row, column, value * searches.weight[terms[column]], (len(docs), len(terms))))
        members.append(docs[np.argsort(block, kind="stable")])
        own = np.bincount(block)
        sizes.append(own)
        key = block[row] * len(terms) + column
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        mosts.append(np.maximum.reduceat(value[order], starts))
        most_terms.append(terms[key[starts] % len(terms)])
        most_sizes.append(np.bincount(key[starts] // len(terms), minlength=len(own)))
        lists.append(lists[-1] + len(own))
    every = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    offsets = lambda parts: np.concatenate([[0], np.cumsum(every(parts))])
    return Chunk(doc_id, first, term, impact, list_term, np.array(lists), offsets(sizes), every(members), offsets(most_sizes), every(most_terms), every(mosts))


@dataclass
class Best:
    """The highest scores of every search so far, and the score that others have to reach."""

    least: np.ndarray
    search: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    unnamed: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    doc_id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, search: np.ndarray, score: np.ndarray, unnamed: np.ndarray, doc_id: np.ndarray) -> None:
        parts = [np.concatenate(p) for p in ((self.search, search), (self.score, score), (self.unnamed, unnamed), (self.doc_id, doc_id))]
        order = np.lexsort((parts[3], parts[2], -parts[1], parts[0]))
        parts = [p[order] for p in parts]
        place = np.arange(len(order)) - np.searchsorted(parts[0], parts[0])
        tenth = place == TOP - 1
        self.least[parts[0][tenth]] = np.maximum(self.least[parts[0][tenth]], parts[1][tenth])
        self.search, self.score, self.unnamed, self.doc_id = (p[place < TOP] for p in parts)


class _Scorer:
    """Bounds of a chunk's blocks and scores of their members."""

    def __init__(self, chunk: Chunk, searches: Searches) -> None:
        self.c, self.s = chunk, searches
        self.place = np.full(len(searches.weight), -1)

    def bounds(self) -> Iterator[tuple[int, tuple, np.ndarray]]:
        """For each list its number, what ``after`` says of its term, and the bound of each block for each search."""
        c = self.c
        for k, t in enumerate(c.list_term.tolist()):
            after = terms, _, columns, begin = self.s.after(t)
            low, high = c.list_first[k], c.list_first[k + 1]
            cells = slice(c.most_first[low], c.most_first[high])
            row = np.repeat(np.arange(high - low), np.diff(c.most_first[low : high + 1]))
            summary = _dense(row, np.searchsorted(terms, c.most_term[cells]), c.most[cells], (high - low, len(terms)))
            yield k, after, np.add.reduceat(summary[:, columns] * self.s.weight[terms[columns]], begin, axis=1)

    def scores(self, k: int, after: tuple, blocks: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(search, document, score)`` of members of some blocks of a list for some of its searches; what a document shares with a search before this list's term is not in its score here."""
        c, (terms, searches, columns, begin) = self.c, after
        blocks = blocks + c.list_first[k]
        docs = c.member[_ranges(c.member_first[blocks], c.member_first[blocks + 1] - c.member_first[blocks])]
        size = c.first[docs + 1] - c.first[docs]
        cells = _ranges(c.first[docs], size)
        self.place[terms] = np.arange(len(terms))
        row, column = np.repeat(np.arange(len(docs)), size), self.place[c.term[cells]]
        self.place[terms] = -1
        ok = column >= 0
        points = _dense(row[ok], column[ok], c.impact[cells[ok]], (len(docs), len(terms)))
        ends = np.append(begin[1:], len(columns))
        size = (ends - begin)[wanted]
        columns = columns[_ranges(begin[wanted], size)]
        found = np.add.reduceat(points[:, columns] * self.s.weight[terms[columns]], np.cumsum(size) - size, axis=1)
        return np.tile(searches[wanted], len(docs)), np.repeat(docs, len(wanted)), found.ravel()

    def keep(self, best: Best, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Adds what reaches the score to beat; of several scores of a document the highest is the whole one."""
        if not parts:
            return
        search, doc, score = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((-score, doc, search))
        search, doc, score = search[order], doc[order], score[order]
        first = np.concatenate([[True], (search[1:] != search[:-1]) | (doc[1:] != doc[:-1])])
        ok = first & (score >= best.least[search])
        ids = self.c.doc_id
        unnamed, named = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
        best.add(search[ok], score[ok], unnamed[doc[ok]], named[doc[ok]])


def probe(chunk: Chunk, searches: Searches, best: Best) -> None:
    """Scores the members of each search's best block of the chunk."""
    scorer, top = _Scorer(chunk, searches), {}
    for k, after, bound in scorer.bounds():
        high = bound.argmax(axis=0)
        for j, s in enumerate(after[1].tolist()):
            b = int(high[j])
            if bound[b, j] >= best.least[s] and bound[b, j] > top.get(s, (0,))[0]:
                top[s] = (int(bound[b, j]), k, b, j)
    asked: dict[int, list[tuple[int, int]]] = {}
    for _, k, b, j in top.values():
        asked.setdefault(k, []).append((b, j))
    parts = []
    for k, pairs in asked.items():
        after = searches.after(int(chunk.list_term[k]))
        parts += [scorer.scores(k, after, np.array([b]), np.array([j])) for b, j in pairs]
    scorer.keep(best, parts)


def scan(chunk: Chunk, searches: Searches, best: Best) -> None:
    """Scores the members of every block whose bound reaches the score to beat."""
    scorer, parts = _Scorer(chunk, searches), []
    for k, after, bound in scorer.bounds():
        live = bound >= best.least[after[1]]
        if live.any():
            found = scorer.scores(k, after, np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0)))
            ok = found[2] >= best.least[found[0]]
            parts.append(tuple(x[ok] for x in found))
    scorer.keep(best, parts)


def searches_of(benchmark: DataFrame, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """The items with a number, and ``(number, terms)`` in blocks that are each proven to keep their bounds, or are one item."""
    items = staged(benchmark.withColumn("number_", F.monotonically_increasing_id()), "ranked-items")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t))) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["number", "terms"])

    asked = staged(items.select("number_", quoted(text_col)).mapInArrow(cut, "number long, terms array<binary>").filter(F.size("terms") > 0), "ranked-terms")
    n = 1
    while True:
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(n)))
        size = F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.length(t) + 8))
        sizes = dealt.groupBy("block").agg(size.alias("size"), F.count("*").alias("many"))
        if not sizes.filter(f"(size > {BLOCK_BYTES} OR many > {BLOCK_ITEMS}) AND many > 1").limit(1).count():
            return items, [dealt.filter(F.col("block") == b).select("number", "terms") for b in range(n)]
        n *= 2


def vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """``(doc_id, n, term, tf)`` of every document: how many terms it has, and how often those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            n, found = [], []
            for text in utf8(batch.column(1)):
                words = terms_of(text)
                n.append(len(words))
                found.append([(number[w], k) for w, k in Counter(words).items() if w in number])
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 2)
            columns = [pa.ListArray.from_arrays(offsets, pa.array(flat[:, i], pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *columns], names=["doc_id", "n", "term", "tf"])

    return docs.select(quoted(id_col).cast("long"), quoted(text_col)).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(np.asarray(column.offsets))
    return sizes.astype(np.int64), np.asarray(column.flatten()).astype(np.int64)


def weighted(counts: DataFrame, searches, numbers, n_docs: int, n_terms: int) -> DataFrame:
    """Documents as ascending term numbers with impacts, and the two terms that weigh most in them; ``numbers`` are the terms' by the vocabulary's order, or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weight = numbers.value, searches.value.weight
        for batch in batches:
            size, term = _flat(batch.column("term"))
            _, tf = _flat(batch.column("tf"))
            m = np.array([10 + 90 * n * n_docs // n_terms for n in batch.column("n").to_pylist()], np.int64)  # any size of whole number
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, size))
            term, doc = number[term], np.repeat(np.arange(len(size)), size)
            order = np.lexsort((term, doc))
            order = order[term[order] >= 0]
            term, impact, doc = term[order], impact[order], doc[order]
            some, size = np.unique(doc, return_counts=True)  # a document without any term that is asked for has no postings
            first = np.concatenate([[0], np.cumsum(size)])
            by_weight = term[np.lexsort((-weight[term] * impact, doc))]
            lead, second = by_weight[first[:-1]], by_weight[np.minimum(first[:-1] + 1, first[1:] - 1)]
            lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32())) for x in (term, impact)]
            keep = [batch.column(c).take(pa.array(some)) for c in ("row", "doc_id")]
            yield pa.RecordBatch.from_arrays([*keep, *lists, pa.array(lead, pa.int32()), pa.array(second, pa.int32())], names=["row", "doc_id", "term", "impact", "lead", "second"])

    return counts.filter(F.size("term") > 0).mapInArrow(run, "row long, doc_id long, term array<int>, impact array<int>, lead int, second int")


def build_index(docs: DataFrame, searches, partitions: int) -> DataFrame:
    """One row for each chunk of documents, with its part of every posting list.

    Documents with the same leading terms come to lie in the same chunks. Partitions are ranges of terms and row numbers, so that no term is too frequent for them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = searches.value
        waiting: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            ids = pa.concat_arrays([w[0] for w in waiting])
            size, term, impact = (np.concatenate([w[i] for w in waiting]) for i in (1, 2, 3))
            waiting.clear()
            c = chunk_of(ids, np.concatenate([[0], np.cumsum(size)]), term, impact, own)
            arrays = [pa.array(getattr(c, a).astype(np.int32)) for a in Chunk.ARRAYS]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (ids, *arrays)]
            return pa.RecordBatch.from_arrays(lists, names=["doc_id", *Chunk.ARRAYS])

        docs = postings = 0
        for batch in batches:
            size, term = _flat(batch.column("term"))
            _, impact = _flat(batch.column("impact"))
            ends, start = np.cumsum(size), 0
            while start < len(size):
                base = ends[start - 1] if start else 0
                stop = min(start + CHUNK_DOCS - docs, int(np.searchsorted(ends, base + CHUNK_POSTINGS - postings, side="left")) + 1, len(size))
                cells = slice(base, ends[stop - 1])
                waiting.append((batch.column("doc_id").slice(start, stop - start), size[start:stop], term[cells], impact[cells]))
                docs, postings, start = docs + stop - start, postings + int(ends[stop - 1] - base), stop
                if docs >= CHUNK_DOCS or postings >= CHUNK_POSTINGS:
                    yield made()
                    docs = postings = 0
        if waiting:
            yield made()

    alike = ("lead", "second", "row")
    return docs.repartitionByRange(partitions, *alike).sortWithinPartitions(*alike).mapInArrow(run, INDEX)


def _passed(index: DataFrame, searches, least, visit) -> DataFrame:
    """``(search, doc_id, score)``: at most ten of a search from every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(least.value.copy())
        for batch in batches:
            for r in range(batch.num_rows):
                ids, *arrays = (batch.column(i)[r].values for i in range(batch.num_columns))
                visit(Chunk(ids, *(np.asarray(a).astype(np.int64) for a in arrays)), searches.value, best)
        yield pa.RecordBatch.from_arrays([pa.array(best.search), pa.array(best.doc_id, pa.int64(), mask=best.unnamed), pa.array(best.score)], names=["search", "doc_id", "score"])

    return index.mapInArrow(run, "search long, doc_id long, score long")


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("search").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


def _block(docs: DataFrame, block: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(number, rank, doc_id, score)`` of one block of searches."""
    spark = docs.sparkSession
    asked = [(r["number"], [bytes(t) for t in r["terms"]]) for r in block.collect()]  # within the block's bounds
    vocabulary = sorted({t for _, terms in asked for t in terms})
    counts = staged(vectors(docs, id_col, text_col, vocabulary).withColumn("row", F.monotonically_increasing_id()), "ranked-counts")
    total = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = dict.fromkeys(range(len(vocabulary)), 0)
    df.update((r["t"], r["count"]) for r in counts.select(F.explode("term").alias("t")).groupBy("t").count().collect())  # a row for each term of the block at most
    weights = {i: math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * n + 1))) for i, n in df.items() if n}
    order = sorted((i for i, w in weights.items() if w > 0), key=lambda i: (df[i], i))
    numbers = np.full(len(vocabulary), -1)
    numbers[order] = np.arange(len(order))
    known = {t: int(numbers[i]) for i, t in enumerate(vocabulary)}
    own = Searches([np.array(sorted(known[t] for t in terms if known[t] >= 0), np.int64) for _, terms in asked], np.array([weights[i] for i in order], np.int64))
    share = spark.sparkContext.broadcast
    searches = share(own)
    partitions = max(math.ceil(total["docs"] / (PARTITION_CHUNKS * CHUNK_DOCS)), min(spark.sparkContext.defaultParallelism, math.ceil(total["docs"] / CHUNK_DOCS)), 1)
    index = staged(build_index(weighted(counts, searches, share(numbers), total["docs"], total["terms"]), searches, partitions), "ranked-index")
    least = np.ones(len(asked), np.int64)
    first = _ranked(_passed(index, searches, share(least), probe)).groupBy("search").agg(F.min("score").alias("tenth"), F.count("*").alias("n"))
    for r in first.filter(F.col("n") == TOP).collect():  # a row for each search of the block at most
        least[r["search"]] = r["tenth"]
    found = _ranked(_passed(index, searches, share(least), scan))
    named = spark.createDataFrame([(i, number) for i, (number, _) in enumerate(asked)], "search long, number long")
    return found.join(named, "search").select("number", "rank", "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ten highest-scoring documents of every item."""
    items, blocks = searches_of(benchmark.select(quoted(item_col).alias("item"), quoted(item_text_col).alias("text")), "text")
    parts = [_block(docs, b, id_col, text_col) for b in blocks]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.join(items.select(F.col("number_").alias("number"), F.col("item").alias("item_id")), "number").select("item_id", "rank", "doc_id", "score")
