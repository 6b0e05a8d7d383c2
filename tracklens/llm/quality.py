"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one
``failed`` mask with a bit per rule; a policy is only a mask of the rules it enforces, so
policies are applied, versioned and compared on the ledger without touching a text again.

Defined results: a null or blank text has no words (all measures 0, the length rule fails);
repeated rows give repeated results; an empty table gives an empty ledger; extra columns are
kept, and one named as a ledger column is replaced. Texts are measured whole: the cost of a
text is linear in its length but for one sort of its windows.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.llm.common import map_columns, quoted, utf8

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\v\f\r"
#: Fixed odd multipliers of the window hash; any would do, as hits are verified.
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)

MEASURES = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_lines", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("n_letters", T.LongType()),
    T.StructField("n_upper", T.LongType()),
    T.StructField("n_stutter", T.LongType()),
])

#: Bit, name and failing condition of every rule, over the measures. Conditions compare
#: integers only, so that any engine gives the same bits.
RULES: list[tuple[str, str]] = [
    ("too_short", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_heavy", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 20 * n_dup_lines > 7 * n_lines"),
    ("short_words", "n_words >= 20 AND word_chars < 2 * n_words"),
    ("long_words", "n_words >= 20 AND word_chars > 25 * n_words"),
    ("shouting", "n_letters >= 50 AND 2 * n_upper > n_letters"),
    ("stuttering", "n_words >= 20 AND 2 * n_stutter > n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versions are never edited: a new policy gets a new name.
POLICIES = {
    "base": BIT["too_short"] | BIT["repeated_windows"],
    "v1": sum(BIT.values()),
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window occurring twice or more in the list, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    hashed = np.zeros(n, np.uint64)
    for k in range(window):
        hashed += (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * _POWERS[k % WINDOW]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order][1:] == hashed[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe)  # equal hashes: now by the words themselves
    _, which, count = np.unique(ids[at[:, None] + np.arange(window)], axis=0, return_inverse=True, return_counts=True)
    hits = at[count[which.ravel()] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()  # ASCII white space only
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    chars = len(text.decode())
    white = len(text) - len(text.translate(None, _WHITE))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(text) - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (
        len(words),
        chars - white,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        dup,
        repeated_words(words),
        upper + lower,
        upper,
        sum(map(eq, words, words[1:])),
    )


def ledger(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Measures of every text and ``failed``, the bits of the rules that it breaks."""

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        rows = [measure(t) for t in utf8(columns[0])]
        by = list(zip(*rows, strict=True)) if rows else [[] for _ in MEASURES]
        return [pa.array(c, pa.int64()) for c in by]

    measured = map_columns(df, [quoted(text_col)], df.columns if keep is None else keep, MEASURES, work)
    bits = sum(
        (F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)),
        F.lit(0).cast("long"),
    )
    return measured.withColumn("failed", bits)


def passes(policy: str, failed: str = "failed") -> Column:
    """True where none of the policy's rules failed."""
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def failed_names(failed: str = "failed") -> Column:
    """The names of the broken rules, by bit."""
    return F.concat_ws(",", *[F.when(F.col(failed).bitwiseAND(F.lit(b)) != 0, F.lit(n)) for n, b in BIT.items()])


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: what it rejects, rejects alone, and what would be kept without it.

    Documents are first counted by mask, so that only the distinct masks (at most 2 to the
    number of rules) are looked at again, with bitwise tests.
    """
    mask = POLICIES[policy]
    counted = led.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("mask")).agg(F.count("*").alias("n"))
    rows = [
        F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask
    ]
    each = counted.select("mask", "n", F.explode(F.array(*rows)).alias("r"))
    has = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    without = F.col("mask").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    return each.groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")).agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(has & without, F.col("n")).otherwise(0)).alias("n_only_by_it"),
        F.sum(F.when(without, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.sum("n").alias("n_docs"),
    )
