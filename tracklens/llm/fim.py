"""Fill-in-the-middle: whole texts cut at line ends by rank and select over 64-bit words.

The UTF-8 bytes of an Arrow batch are viewed as words of eight bytes. Arithmetic on whole words
marks the bytes that end a unit (line feeds) and those that begin a code point, each by its
highest bit. Bits are counted by word and summed, so that the number of marks before a byte (rank)
is one look-up, and the byte of the k-th mark (select) is a search for its word and a few steps
inside the word. All texts of a batch are cut at once; no text is gone through byte by byte.

Defined results: a null or empty text has no units and stays plain, as does one that holds a
sentinel; a null id is hashed as an empty one; repeated rows are repeated in the result, all in the
same way; an empty table gives an empty result; a column that is named as a result gives way to it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.llm.common import map_columns, quoted

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Texts of a hundred that are transformed, and of those, texts of a hundred that begin with their suffix.
RATE, SPM_RATE, SEED = 100, 50, 7

_EACH, _LOW, _HIGH = (np.uint64(x) for x in (0x0101010101010101, 0x7F7F7F7F7F7F7F7F, 0x8080808080808080))
_ONE = np.uint64(1)


def words_of(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words, with zeros behind the last."""
    padded = np.zeros((len(data) + 8) // 8 * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def equal_bytes(words: np.ndarray, byte: int) -> np.ndarray:
    """The highest bit of each byte that equals ``byte``. No sum leaves its byte, so the marks are exact."""
    x = words ^ (_EACH * np.uint64(byte))
    return ~(((x & _LOW) + _LOW) | x | _LOW)


def code_points(words: np.ndarray) -> np.ndarray:
    """The highest bit of each byte that begins a code point, which is all but ``10xxxxxx``."""
    return ~(words & ~(words << _ONE)) & _HIGH


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bytes before ``at`` are marked."""
        word, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.marks[word] & ((_ONE << bits) - _ONE))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the marked byte that ``k`` others precede."""
        word = np.searchsorted(self.before, k, side="right") - 1
        left, found = k - self.before[word], self.marks[word]
        for step in range(7):  # a word has at most eight marks; lower ones go until the wanted one is the lowest
            found = np.where(left > step, found & (found - _ONE), found)
        lowest = found & (~found + _ONE)
        return (word << 3) + (np.bitwise_count(lowest - _ONE).astype(np.int64) >> 3)


def cuts(ids: list[int | None]) -> np.ndarray:
    """Four unsigned 32-bit integers for each id."""
    drawn = b"".join(hashlib.sha256(f"{SEED}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(drawn, ">u4").reshape(-1, 4).astype(np.int64)


def transform_batch(ids: pa.Array, text: pa.Array) -> list[pa.Array]:
    body = text.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1] if len(body) else np.zeros(1, np.int64)
    data = np.frombuffer(body.buffers()[2] or b"", np.uint8)
    words = words_of(data)
    lines, points = Marks(equal_bytes(words, 10)), Marks(code_points(words))
    start, end, drawn = ends[:-1], ends[1:], cuts(ids.to_pylist())
    before, feeds = lines.rank(start), lines.rank(end) - lines.rank(start)
    n = feeds + ((end > start) & (data[np.maximum(end, 1) - 1] != 10) if len(data) else 0)

    def place(units: np.ndarray) -> np.ndarray:
        """The byte behind so many units: behind a line feed, but behind the text if that lacks its last one."""
        inner = (units > 0) & (units <= feeds)
        out = np.where(units == 0, start, end)
        out[inner] = lines.select((before + units - 1)[inner]) + 1
        return out

    a, b = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    first, second = place(np.minimum(a, b)), place(np.maximum(a, b))
    prefix_chars, middle_chars = points.rank(first) - points.rank(start), points.rank(second) - points.rank(first)
    raw, forms, made = data.tobytes(), [], []
    for s, f, m, e, (_, _, rate, order) in zip(start.tolist(), first.tolist(), second.tolist(), end.tolist(), drawn.tolist(), strict=True):
        whole = raw[s:e]
        if not whole or PREFIX in whole or SUFFIX in whole or MIDDLE in whole or rate % 100 >= RATE:
            forms.append("plain")
            made.append(whole)
        elif order % 100 < SPM_RATE:
            forms.append("spm")
            made.append(b"".join((SUFFIX, raw[m:e], PREFIX, raw[s:f], MIDDLE, raw[f:m])))
        else:
            forms.append("psm")
            made.append(b"".join((PREFIX, raw[s:f], SUFFIX, raw[m:e], MIDDLE, raw[f:m])))
    plain = np.array([f == "plain" for f in forms], bool)
    return [
        pa.array(n, pa.int64()),
        pa.array(forms, pa.string()),
        pa.array(prefix_chars, pa.int64(), mask=plain),
        pa.array(middle_chars, pa.int64(), mask=plain),
        pa.array(made, pa.binary()).cast(pa.string()),
    ]


MADE = T.StructType([T.StructField(c, T.LongType()) if c not in ("form", "output") else T.StructField(c, T.StringType()) for c in ("n", "form", "prefix_chars", "middle_chars", "output")])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and the transformed ``output``."""
    return map_columns(docs, [quoted(id_col), quoted(text_col)], docs.columns if keep is None else keep, MADE, lambda c: transform_batch(*c))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A transformed one holds each sentinel once, as its text has none."""
    parts = F.split(output, "<[PSM]>")
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def digests(made: DataFrame, keep: list[str]) -> DataFrame:
    return made.select(
        *[quoted(c) for c in keep], "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
