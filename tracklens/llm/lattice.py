"""Language-model scoring by the likelihood of the subword lattice.

A word, with its leading mark, is spelled by the pieces of an existing vocabulary in many ways.
Each piece has a probability; the forward recursion adds up all spellings in log space, so a
word's score is its marginal probability, not that of one segmentation. Words are independent
and a text ends with one end token, so a text's log10 probability is the sum over its tokens.

Piece probabilities mix the vocabulary's own scores (ranks of its merges, as a Zipf distribution)
with how often the pieces spell the training words. The vocabulary keeps the share ``PRIOR`` of all
probability however large the corpus is; with no training words it has all. Pieces that lower-cased text
cannot hold have none. The base score is an add-one unigram model of whole words.

How the work is dealt: words are counted per task, then by word. Their marginals are computed
once per distinct word. From then on a word of more than ``LONG_WORD`` bytes goes by its digest. The most
frequent words, at most ``COMMON_WORDS`` by a threshold found from a histogram of counts and so at most
that many times ``LONG_WORD`` bytes, go to all tasks; all others are joined by word, and
as each of them is rare no join key is hot. Nothing else leaves the executors but sums.

Defined results: a null or blank text is its end token alone; a null id counts as the empty text
when parts are dealt; repeated rows give repeated results and count as often; with an empty
table or no training rows all counts are 0 and the base score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.llm.common import quoted, staged, utf8

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
PRIOR = 0.2
ZIPF_SHIFT = 2.7
COMMON_WORDS = 250_000
#: Distinct words, and bytes of them, that a task holds before it sends its counts on.
COUNTED_AT_ONCE, BYTES_AT_ONCE = 200_000, 64 << 20
#: Words of more bytes than this go by their digest.
LONG_WORD = 64
MARK = "▁".encode()
END = b""  # no word is empty


def held_out(doc_id: object) -> bool:
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def key_of(word: bytes) -> bytes:
    """The word, or for a long one a digest behind a blank, which no word holds."""
    return word if len(word) <= LONG_WORD else b" " + sha256(word).digest()


def word_counts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(word, c, n)`` for all words and the end token: counts in the training part and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        held: Counter[bytes] = Counter()
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            words = sorted(train.keys() | held.keys(), key=len)
            while words:
                many = max(1, min(50_000, BYTES_AT_ONCE // max(1, len(words[-1]))))  # the longest of those that are left
                part, words = words[-many:], words[:-many]
                c = np.fromiter((train.get(w, 0) for w in part), np.int64, len(part))
                n = c + np.fromiter((held.get(w, 0) for w in part), np.int64, len(part))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(c), pa.array(n)], names=["word", "c", "n"])
            train.clear()
            held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                to = held if held_out(doc_id) else train
                to.update(tokens(text))
                to[END] += 1
                size += len(text)  # no less than its distinct words
                if len(train) + len(held) > COUNTED_AT_ONCE or size > BYTES_AT_ONCE:
                    yield from send()
                    size = 0
        yield from send()

    counted = documents.select(quoted(id_col), quoted(text_col)).mapInArrow(run, "word binary, c long, n long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


@lru_cache(maxsize=2)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """How often each piece of the vocabulary spells the training words; the end token is piece -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        total, ends = np.zeros(sp.get_piece_size(), np.int64), 0
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ends += sum(c for w, c in zip(words, counts, strict=True) if w == END)
            spelled = sp.encode([w.decode() for w in words], num_threads=1)
            sizes = [len(x) for x in spelled]
            if sum(sizes):
                np.add.at(total, np.concatenate([np.array(x, np.int64) for x in spelled if x]), np.repeat(counts, sizes))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([*some.tolist(), -1], pa.int64()), "n": pa.array([*total[some].tolist(), ends], pa.int64())})

    return words.filter("c > 0").select("word", "c").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))


class Lattice:
    """Log10 probabilities of the pieces by their bytes, and the forward recursion over them."""

    def __init__(self, path: str, counts: dict[int, int]) -> None:
        sp = processor(path)
        mass: dict[bytes, float] = {}
        rank = {i: -sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))}
        last = max((r for r in rank.values() if r < 1e8), default=0.0)
        spelled = {i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode() for i in rank}
        prior = {i: 1 / (ZIPF_SHIFT + (last if sp.is_byte(i) or r >= 1e8 else r)) for i, r in rank.items() if spelled[i] == spelled[i].lower()}
        prior[-1], spelled[-1] = 1 / ZIPF_SHIFT, END
        total, seen = sum(prior.values()), sum(counts.get(i, 0) for i in prior)
        share = PRIOR if seen else 1.0
        for i, p in prior.items():
            mass[spelled[i]] = mass.get(spelled[i], 0.0) + share * p / total + (1 - share) * counts.get(i, 0) / max(1, seen)
        self.end = math.log10(mass.pop(END))
        #: Natural logarithm of each piece; None where the bytes only begin longer ones.
        self.pieces: dict[bytes, float | None] = {s[:k]: None for s in mass for k in range(1, len(s))}
        self.pieces.update({s: math.log(p) for s, p in mass.items()})

    def log10(self, word: bytes) -> float:
        """The marginal log10 probability of a word; the end token's for the empty one."""
        if word == END:
            return self.end
        data, pieces, log1p, exp = MARK + word, self.pieces, math.log1p, math.exp
        n = len(data)
        alpha: list[float | None] = [None] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            a = alpha[i]
            if a is None:
                continue
            for j in range(i + 1, n + 1):
                part = data[i:j]
                if part not in pieces:
                    break
                p = pieces[part]
                if p is not None:
                    x, y = a + p, alpha[j]
                    alpha[j] = x if y is None else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
        return alpha[n] / math.log(10)  # every byte is a piece, so there is a way


def word_scores(words: DataFrame, path: str, counts: dict[int, int]) -> DataFrame:
    """``(word, c, n, p)`` with the marginal log10 probability ``p`` of each distinct word; long words by their digest."""
    shared = words.sparkSession.sparkContext.broadcast(counts)  # at most one number per piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, shared.value)
        for batch in batches:
            found = batch.column(0).to_pylist()
            p = [lattice.log10(w) for w in found]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(w) for w in found], pa.binary()), *batch.columns[1:], pa.array(p, pa.float64())], names=["word", "c", "n", "p"])

    return words.select("word", "c", "n").mapInArrow(run, "word binary, c long, n long, p double")


def common_words(scored: DataFrame, most: int = COMMON_WORDS) -> tuple[DataFrame, DataFrame]:
    """The words above the least count that leaves at most ``most`` of them, and all others."""
    level = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    held = {r["level"]: r["count"] for r in scored.groupBy(level.alias("level")).count().collect()}  # 8 levels per doubling
    least, total = max(held, default=0) + 1, 0
    for lv in sorted(held, reverse=True):
        total += held[lv]
        if total > most:
            break
        least = lv
    return scored.filter(level >= least), scored.filter(level < least)


def score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``keep`` columns with ``held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    path = path or public_tokenizers.path(VOCABULARY)
    spark = documents.sparkSession
    made = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in (documents.columns if keep is None else keep) if c.lower() not in made]

    words = staged(word_counts(documents, id_col, text_col), "word-counts")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    train_tokens, kinds = int(sums["n"]), int(sums["v"])
    counts = {r["piece"]: r["n"] for r in piece_counts(words, path).collect()}  # at most the vocabulary
    scored = staged(word_scores(words, path, counts), "word-scores")
    common, rare = common_words(scored)
    top = [(r["word"], r["c"], r["p"]) for r in common.select("word", "c", "p").toLocalIterator()]  # at most COMMON_WORDS
    shared = spark.sparkContext.broadcast((
        [bytes(w) for w, _, _ in top],
        np.log10(np.array([c for _, c, _ in top], float) + 1),
        np.array([p for _, _, p in top], float),
        np.array([c > 0 for _, c, _ in top], bool),
    ))
    floor = math.log10(train_tokens + kinds + 1)

    wide = documents.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(id_col).alias("id"), quoted(text_col).alias("body"))
    rest = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("tf", T.LongType())]))
    own = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("lattice", T.DoubleType()), ("rare", rest)]
    schema = T.StructType([*[wide.schema[f"k{i}"] for i in range(len(keep))], *[T.StructField(n, t) for n, t in own]])
    arrow = [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, base, lattice, known = shared.value
        get = {w: i for i, w in enumerate(names)}.get
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("id").to_pylist(), utf8(batch.column("body")), strict=True):
                found = [*map(key_of, tokens(text)), END]
                at = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
                there = at[at >= 0]
                others = Counter(found[i] for i in np.flatnonzero(at < 0)) if len(there) < len(found) else {}
                rows.append((held_out(doc_id), len(found), int(known[there].sum()), float(base[there].sum()), float(lattice[there].sum()), [{"word": w, "tf": n} for w, n in others.items()]))
            by = list(zip(*rows, strict=True)) if rows else [[]] * len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, t) for c, t in zip(by, arrow, strict=True)]], names=schema.fieldNames())

    partial = staged(wide.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "text-scores")
    each = partial.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    added = each.join(rare, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known2"),
        F.sum(F.col("tf") * F.log10(F.col("c") + F.lit(1.0))).alias("base2"),
        F.sum(F.col("tf") * F.col("p")).alias("lattice2"),
    )
    both = partial.drop("rare").join(added, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return both.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "held_out",
        "n_tokens",
        plus("known", "known2").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (plus("base", "base2") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        plus("lattice", "lattice2").alias("score"),
    )
