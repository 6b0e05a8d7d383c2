"""Word index and ranking as DataFrames: postings, matches, BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.functions import expr

WEIGHTS = {"title": 10.0, "artist": 4.0, "album": 1.0}
RANK_WEIGHTS = {"title": 1.0, "artist": 0.4, "album": 0.2, "version": 0.1}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def build_postings(df: DataFrame, id_col: str, cols: list[str], stem: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, col, pos, term)`` and the columns to ``carry``: words lower-cased, accents folded, stemmed if asked."""
    words = [expr.word_tokens(expr.fold_accents(F.coalesce(F.col(c), F.lit("")))) for c in cols]
    tokens = F.array(*[F.struct(F.lit(c).alias("col"), (stemmed(w) if stem else w).alias("words")) for c, w in zip(cols, words, strict=True)])
    each = df.select(F.col(id_col).alias("doc_id"), *carry, F.explode(tokens).alias("t"))
    return each.select("doc_id", "t.col", F.posexplode("t.words").alias("pos", "term"), *carry)


#: Words whose stems a task remembers.
REMEMBERED = 100_000


def stemmed(words: Column) -> Column:
    """Arrays of words as their stems, where they are cut: a task stems each distinct word of a batch once, and nothing is joined."""

    @F.arrow_udf("array<string>")
    def stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}
        for array in batches:
            each = array.flatten().dictionary_encode()
            if len(known) > REMEMBERED:
                known.clear()
            for w in each.dictionary.to_pylist():
                if w not in known:
                    known[w] = porter_stem(w)
            values = pa.array([known[w] for w in each.dictionary.to_pylist()], pa.string()).take(each.indices)
            sizes = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)

    return stems(words)


def stem_vocabulary(terms: DataFrame) -> DataFrame:
    """``(term, stem)`` of the distinct terms: the stemmer sees each word once, in Arrow batches."""

    @F.pandas_udf("string")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield words.map(porter_stem)

    return terms.distinct().select("term", stems("term").alias("stem"))


def query_terms(keywords: str) -> list[str]:
    """Words of a query as an index with stems holds them."""
    return [porter_stem(t) for t in keywords.lower().split()]


def match_all(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Documents that have every term in some column."""
    wanted = sorted(set(terms))
    found = postings.filter(F.col("term").isin(wanted)).groupBy("doc_id").agg(F.count_distinct("term").alias("n"))
    return found.filter(F.col("n") == len(wanted)).select("doc_id")


def match_column(postings: DataFrame, col: str, terms: list[str], prefix: bool = True) -> DataFrame:
    """Documents in which every term begins, or is, a word of one column."""
    rows, conds = postings.filter(F.col("col") == col), []
    for t in terms:
        conds.append(F.col("term").startswith(t) if prefix else F.col("term") == t)
    any_of = conds[0]
    for c in conds[1:]:
        any_of = any_of | c
    hit = rows.filter(any_of).groupBy("doc_id").agg(*[F.max(c).alias(f"t{i}") for i, c in enumerate(conds)])
    every = F.col("t0")
    for i in range(1, len(conds)):
        every = every & F.col(f"t{i}")
    return hit.filter(every).select("doc_id")


def match_phrase(postings: DataFrame, col: str, terms: list[str]) -> DataFrame:
    """Documents in which the terms stand next to each other in one column.

    Each hit votes for the place where the phrase would begin; a place with a vote for every
    term holds it. That is one pass and one shuffle, whatever the length of the phrase.
    """
    places = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(terms)])
    votes = postings.filter((F.col("col") == col) & F.col("term").isin(sorted(set(terms))))
    votes = votes.select("doc_id", "pos", "term", F.explode(places).alias("p")).filter(F.col("term") == F.col("p.t"))
    starts = votes.groupBy("doc_id", (F.col("pos") - F.col("p.i")).alias("start")).agg(F.count_distinct("p.i").alias("n"))
    return starts.filter(F.col("n") == len(terms)).select("doc_id").distinct()


def doc_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc_id").agg(F.count("*").alias("length"))


def bm25(postings: DataFrame, stats: DataFrame, terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """``(doc_id, bm25)`` for documents with every term; lower is better.

    The frequency of a term in a document is weighted by column; rarity and length are those of
    whole documents.
    """
    wanted, weights = sorted(set(terms)), weights or {}
    weight = F.lit(1.0)
    for c, w in weights.items():
        weight = F.when(F.col("col") == c, F.lit(w)).otherwise(weight)
    tf = postings.filter(F.col("term").isin(wanted)).groupBy("term", "doc_id").agg(F.sum(weight).alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    docs, mean = stats.agg(F.count("*")).scalar(), stats.agg(F.avg("length")).scalar()
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = tf.join(F.broadcast(df), "term").join(stats, "doc_id").withColumns({"docs": docs, "mean": mean})  # df: a row per term
    return scored.groupBy("doc_id").agg((-F.sum(part)).alias("bm25"), F.count("*").alias("n")).filter(F.col("n") == len(wanted)).drop("n")


def match_song(df: DataFrame, title: str, artist: str, limit: int | None = 500) -> DataFrame:
    """The recordings of one song in headline order, so many of them, or all."""
    from tracklens.operators.relational import headline_order

    same = (F.lower("title") == title.lower()) & (F.lower("artist") == artist.lower())
    found = df.filter(same).orderBy(*headline_order())
    return found if limit is None else found.limit(limit)


def stemmed_word(rows: DataFrame, tokens: DataFrame, text: Column) -> DataFrame:
    """The first token (``pos``, ``token``; three characters or more) that some shown row does not hold.

    The rows are one page and the tokens one query, so both sides are small by construction.
    """
    held = rows.select(expr.fold_accents(F.lower(text)).alias("held"))
    long = tokens.filter(F.length("token") >= 3)
    missed = long.join(F.broadcast(held), ~F.col("held").contains(expr.fold_accents(F.col("token"))))
    return missed.agg(F.min_by("token", "pos").alias("stemmed_word"))


def weighted_text_rank(df: DataFrame, id_col: str, terms: list[str]) -> DataFrame:
    """``(doc_id, rank)``: weighted share of columns' words that are terms, for documents with every term."""
    postings = build_postings(df, id_col, list(RANK_WEIGHTS))
    wanted, weight = sorted(set(terms)), F.lit(0.0)
    for c, w in RANK_WEIGHTS.items():
        weight = F.when(F.col("col") == c, F.lit(w)).otherwise(weight)
    hit = postings.filter(F.col("term").isin(wanted)).groupBy("doc_id", "term").agg(F.max(weight).alias("w"), F.count("*").alias("n"))
    ranked = hit.groupBy("doc_id").agg(F.sum(F.col("w") * (1 + F.log(F.col("n").cast("double")))).alias("rank"), F.count("*").alias("terms"))
    return ranked.filter(F.col("terms") == len(wanted)).select("doc_id", "rank")


def stemmed_words(rows: DataFrame, tokens: DataFrame, text: Column) -> DataFrame:
    """The same for many searches at once: rows of pages and tokens both carry their ``query_id``.

    Both meet by search; a page has at most 200 rows and a search few words, so no search is a large group.
    """
    held = rows.select("query_id", expr.fold_accents(F.lower(text)).alias("held"))
    missed = tokens.filter(F.length("token") >= 3).join(held, "query_id").filter(~F.col("held").contains(expr.fold_accents(F.lower("token"))))
    return missed.groupBy("query_id").agg(F.min_by("token", "pos").alias("stemmed_word"))


# ---- the stemmer of Porter (1980), An algorithm for suffix stripping ----------------------------


def _consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    """The m of [C](VC)^m[V]."""
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(b and not a for a, b in zip(kinds, kinds[1:]))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


#: The suffix tables of steps 2, 3 and 4.
STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()


def _replace(w: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            return base + table[suffix] if _measure(base) > 0 else w
    return w


def porter_stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    # plurals and -ed, -ing
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        base = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else ""
        if base and _vowel(base):
            if base.endswith(("at", "bl", "iz")):
                w = base + "e"
            elif _double(base) and base[-1] not in "lsz":
                w = base[:-1]
            else:
                w = base + "e" if _measure(base) == 1 and _cvc(base) else base
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            cut = len(suffix) - 1 if suffix in ("sion", "tion") else 0
            base = w[: -len(suffix)] + suffix[:1] if cut else w[: -len(suffix)]
            if _measure(base) > 1:
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
