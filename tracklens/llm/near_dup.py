"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits, and embedded as the 32 counts of
one bits in them. The Manhattan distance of two such vectors never exceeds the Hamming
distance of the fingerprints, so it may rule pairs out but never loses one.

Counts 0, 1, 2 are kept in unary (00, 01, 11), which makes the embedding a long again and the
Manhattan distance ``bit_count(a ^ b)``. The range join at distance 3 runs on a grid: the
segments form six groups, and vectors within distance 3 agree wholly in at least three of
them; so each of the 20 choices of three groups gives one cell per vector, and only vectors
that share a cell are compared, first by Manhattan distance, then by the exact bits.

Only distinct fingerprints enter the join, whatever number of documents has each. Links are
joined into components by alternating star contractions whose tables are written between
rounds; nothing is gathered on the driver but counts.

Defined results: a null or blank text has fingerprint zero and is linked like any other; rows
with a null id link others, and their component is the smallest id reachable (null if there is
none); repeated rows are repeated in the result; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.llm.common import join_counted, map_columns, new_path, quoted, remove, scratch, staged, utf8

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
GROUPS = 6
_EVEN = 0x5555555555555555
#: Above this, a cell is cut into blocks that are compared block by block, in many tasks.
CELL_ROWS = 2000


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``width`` words, lower-cased in A-Z, space-joined."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(joined, SEED)], np.uint64)
    ends = [n + i for i, n in enumerate(accumulate(map(len, words)))]
    starts = itertools.chain([0], (e + 1 for e in ends))
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])], np.uint64)


def simhash_of(hashes: np.ndarray) -> int:
    """The SimHash as a signed long: a bit is one if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # a very long text takes no more memory
        block = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    return simhash_of(shingle_hashes(text, width))


def with_fingerprint(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, width: int = SHINGLE) -> DataFrame:
    made = T.StructType([T.StructField("simhash", T.LongType())])

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        return [pa.array([fingerprint(t, width) for t in utf8(columns[0])], pa.int64())]

    return map_columns(df, [quoted(text_col)], df.columns if keep is None else keep, made, work)


def segment_counts(fp: Column) -> Column:
    """The embedding: per two-bit segment its number of one bits, in unary."""
    low = fp.bitwiseAND(F.lit(_EVEN))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_masks(max_distance: int = MAX_DISTANCE, groups: int = GROUPS) -> list[int]:
    """One mask for each choice of the groups that must agree."""
    edges = [2 * round(32 * k / groups) for k in range(groups + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [_signed(sum(c)) for c in combinations(parts, groups - max_distance)]


def groups_for(distinct: int, max_distance: int = MAX_DISTANCE) -> int:
    """So many groups that a cell holds about one vector of that many, so that candidates do not grow with the table.

    Two random counts of a segment agree in 3 of 8 cases, and a cell fixes all but ``max_distance`` of the groups.
    """
    groups = 2 * max_distance
    while distinct > (8 / 3) ** (32 * (groups - max_distance) / groups) and groups < 32:
        groups += 1
    return groups


def blocked(rows: DataFrame, n: str, own: str, mine: str, other: str, key: Column) -> DataFrame:
    """``rows`` of a cell of ``n`` rows dealt into blocks of about ``CELL_ROWS`` by ``key``: the own block and, one row each, all others."""
    blocks = F.ceil(F.col(n) / F.lit(CELL_ROWS)).cast("int")
    return rows.withColumn(mine, F.pmod(F.xxhash64(key), blocks).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), blocks - 1)))


def links(prints: DataFrame, max_distance: int = MAX_DISTANCE, groups: int | None = None) -> DataFrame:
    """Pairs ``(a, b, distance)``, a < b, of the distinct values of ``prints.simhash`` that link."""
    vectors = prints.select("simhash").distinct()
    masks = grid_masks(max_distance, groups or groups_for(vectors.count(), max_distance))
    # One number for the cell: which groups agree, and on what. Other cells may share it; the check below decides.
    # A cell follows from fingerprint and choice: it is the key that rows are dealt by and is not moved with them.
    cells = vectors.select("simhash", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("choice"))
    cell = F.xxhash64("choice", segment_counts(F.col("simhash")).bitwiseAND(F.get(F.array(*[F.lit(m) for m in masks]), F.col("choice"))))
    full = cells.groupBy(cell.alias("cell")).count().filter(F.col("count") > 1)
    # Written, as both sides of the join below are made of it: all cells move once to meet those that are shared.
    # The planner takes a generated table for as small as its source and would broadcast all cells, hence the hint.
    shared = staged(cells.join(full.hint("merge"), cell == F.col("cell")).select("simhash", "choice", "cell", "count"), "cells")
    shared = shared.withColumn("v", segment_counts(F.col("simhash")))
    # In a large cell every block meets every block: each pair meets in exactly one of the tasks.
    left = blocked(shared, "count", "simhash", "i", "j", F.col("simhash")).select("cell", "i", "j", "choice", F.col("simhash").alias("a"), F.col("v").alias("va"))
    right = blocked(shared, "count", "simhash", "j", "i", F.col("simhash")).select("cell", "i", "j", F.col("simhash").alias("b"), F.col("v").alias("vb"))
    bits = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    # A pair is told by the first choice of groups on which it agrees, so only once.
    first = F.lit(len(masks))
    for k in range(len(masks) - 1, -1, -1):
        first = F.when(F.col("va").bitwiseXOR(F.col("vb")).bitwiseAND(F.lit(masks[k])) == 0, F.lit(k)).otherwise(first)
    near = left.join(right, ["cell", "i", "j"]).filter(
        (F.col("a") < F.col("b")) & (bits("va", "vb") <= max_distance) & (bits("a", "b") <= max_distance) & (F.col("choice") == first)
    )
    return near.select("a", "b", bits("a", "b").alias("distance"))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)``: the smallest node that each node of the edges ``(a, b)`` reaches.

    Alternates two contractions until nothing changes: every node's larger neighbours, then all
    its smaller ones, move to its smallest neighbour. Each round is a written table, the one
    before is deleted; rounds grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    path = new_path(spark, label)
    now = staged(both.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label, path)
    while True:
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = ways.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after_path = new_path(spark, label)
        after = staged(small, label, after_path)
        changed = after.join(now, ["u", "v"], "left_anti").limit(1).count() or now.join(after, ["u", "v"], "left_anti").limit(1).count()
        remove(spark, path)
        now, path = after, after_path
        if not changed:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, width: int = SHINGLE) -> DataFrame:
    """``keep`` columns with ``simhash`` (long) and ``component_id``, one row per input row."""
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("component_id", "simhash")]
    inner = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(kept)], quoted(id_col).alias("own"), quoted(text_col).alias("body"))
    made = staged(with_fingerprint(inner, "body", [*[f"k{i}" for i in range(len(kept))], "own"], width), "simhash")
    prints = staged(made.groupBy("simhash").agg(F.min("own").alias("first_id"), F.count("*").alias("n")), "simhash-ids")
    linked = components(links(prints).select("a", "b"))
    ids = linked.join(prints, linked["node"] == prints["simhash"]).select("node", "root", "first_id")
    smallest = ids.groupBy("root").agg(F.min("first_id").alias("least_id"))
    merged = ids.select("node", "root").join(smallest, "root").select(F.col("node").alias("simhash"), "least_id")
    resolved = prints.join(merged, "simhash", "left").select("simhash", F.coalesce("least_id", "first_id").alias("component"), "n")
    out = join_counted(made.drop("own"), resolved, "simhash", "n", made.count())
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "simhash", F.col("component").alias("component_id"))


# ---- one document of each group: the corpus pipeline's rule -------------------------------------

#: Copies share at least this part of all their distinct runs of so many words.
COPY_WIDTH, COPY_SHARE = 5, 0.8
#: The second index: two texts at 0.8 meet in one of 20 bands of 5 minima with probability 0.9996.
BANDS, BAND_ROWS = 20, 5
#: Bytes of shingle sets in a block of a bucket.
BLOCK_BYTES = 4 << 20
#: Pairs of one text that go to one task.
SHARE_ROWS = 500
#: Bytes of sets of shingles that a task remembers while it compares.
SETS_HELD = 16 << 20
_ODD = np.random.default_rng(SEED).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MORE = np.random.default_rng(SEED + 1).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingle_set(text: bytes, width: int = COPY_WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def shared_part(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    small, large = (a, b) if len(a) < len(b) else (b, a)
    both = int((large.take(np.searchsorted(large, small), mode="clip") == small).sum())
    return both / (len(a) + len(b) - both)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set; the greatest number for an empty one."""
    least = np.full(len(_ODD), 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 256):
        mixed = np.multiply.outer(_ODD, shingles[k : k + 256])
        mixed += _MORE[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A number for each band of minima."""
    return [_signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in least.reshape(BANDS, BAND_ROWS)]


def with_bands(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``set_id`` (the same for the same set of shingles), ``simhash`` and ``bands``."""
    made = T.StructType([T.StructField("set_id", T.BinaryType()), T.StructField("simhash", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        ids, prints, bands = [], [], []
        for text in utf8(columns[0]):
            hashes = shingle_hashes(text, COPY_WIDTH)
            distinct = np.unique(hashes)
            ids.append(xxhash.xxh3_128_digest(distinct.tobytes()))
            prints.append(simhash_of(hashes))
            bands.append(band_keys(minima(distinct)))
        return [pa.array(ids, pa.binary()), pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]

    return map_columns(df, [quoted(text_col)], keep, made, work)


#: Up to so many row numbers (8 MB) are broadcast to pick texts where they lie; beyond, texts are moved to meet them.
PICKED_ROWS = 1_000_000


def texts_of(texts_: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts ``(row, text)`` of some distinct ``rows``, which are few beside all texts where few have copies."""
    return texts_.join(F.broadcast(rows) if rows.count() <= PICKED_ROWS else rows, "row", "left_semi")


def confirmed(pairs: DataFrame, texts_: DataFrame, least: float) -> DataFrame:
    """Those of the distinct pairs ``(a, b)`` whose texts share enough, written; the pairs of a hot ``b`` go to many tasks."""
    pairs = staged(pairs.select("a", "b"), "copy-pairs")
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    pairs = join_counted(pairs, counts, "b", "n", pairs.count())
    shares = F.ceil(F.col("n") / F.lit(SHARE_ROWS)).cast("int")
    pairs = pairs.withColumn("share", F.pmod(F.xxhash64("a"), shares).cast("int"))
    ends = [staged(pairs.select(F.col(c).alias("row")).distinct(), "copy-ends") for c in ("a", "b")]
    one = texts_of(texts_, ends[0]).select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    # Only the few hot rows have several shares: they are told where the texts lie, and each text moves once.
    several = staged(counts.filter(F.col("n") > SHARE_ROWS).select("b", shares.alias("shares")), "copy-shares")
    other = texts_of(texts_, ends[1]).select(F.col("row").alias("b"), F.col("text").alias("text_b")).join(F.broadcast(several) if several.count() <= PICKED_ROWS else several, "b", "left")
    other = other.select("b", "text_b", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
    wide = pairs.select("a", "b", "share").join(one, "a").join(other, ["b", "share"])
    made = T.StructType([T.StructField("similar", T.DoubleType())])

    def setup():
        held: dict[int, np.ndarray] = {}
        size = 0

        def set_of(row: int, text: bytes) -> np.ndarray:
            nonlocal size
            if row not in held:
                if size > SETS_HELD:
                    held.clear()
                    size = 0
                held[row] = shingle_set(text)
                size += held[row].nbytes
            return held[row]

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            rows = zip(columns[0].to_pylist(), utf8(columns[1]), columns[2].to_pylist(), utf8(columns[3]), strict=True)
            return [pa.array([shared_part(set_of(a, x), set_of(b, y)) for a, x, b, y in rows], pa.float64())]

        return work

    done = map_columns(wide, [F.col("a"), F.col("text_a"), F.col("b"), F.col("text_b")], ["a", "b"], made, None, setup)
    return staged(done.filter(F.col("similar") >= least).select("a", "b"), "copies")


def distinct_buckets(each: DataFrame) -> DataFrame:
    """``(bucket, n, b)`` of the buckets of several rows, one of all buckets with the same rows, as close copies share most bands; ``b`` is the first row.

    The rows of a bucket are told by their number, the first of them and the exclusive or of their digests. 64 bits are enough
    for that: only the few buckets of one first row are ever held against each other.
    """
    full = each.groupBy("bucket").agg(F.count("*").alias("n"), F.min("row").alias("b"), F.bit_xor(F.xxhash64("row")).alias("rows")).filter("n > 1")
    return full.groupBy("n", "b", "rows").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "b")


def first_candidates(alive: DataFrame, members: DataFrame) -> DataFrame:
    """``(a, b)``: every text with the first of its fingerprint and of each of its buckets, and the first texts of linked fingerprints."""
    prints = staged(alive.groupBy("simhash").agg(F.min("row").alias("b"), F.count("*").alias("n")), "copy-prints")
    same = join_counted(alive.select("row", "simhash"), prints.filter("n > 1"), "simhash", "n", alive.count()).select(F.col("row").alias("a"), "b")
    ends = links(prints).select(F.col("a").alias("x"), F.col("b").alias("y"))
    ends = ends.join(prints.select(F.col("simhash").alias("x"), F.col("b").alias("a")), "x").join(prints.select(F.col("simhash").alias("y"), "b"), "y")
    near = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return same.unionByName(near).unionByName(members.select(F.col("row").alias("a"), "b")).filter("a != b").distinct()


def links_between(left: pa.Table, right: pa.Table, least: float) -> Iterator[tuple[int, int]]:
    """Pairs of linked rows of two blocks ``(row, comp, set)`` with different components, one for each row of ``left`` and component."""
    sets = [np.frombuffer(x, np.uint64) for x in right["set"].to_pylist()]
    if not sets or not left.num_rows:
        return
    size, comps, rows = np.array([len(x) for x in sets]), right["comp"].to_numpy(), right["row"].to_numpy()
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for row, comp, data in zip(left["row"].to_pylist(), left["comp"].to_pylist(), left["set"].to_pylist(), strict=True):
        mine = np.frombuffer(data, np.uint64)
        low = np.searchsorted(flat, mine, "left")
        count = np.searchsorted(flat, mine, "right") - low
        at = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((both >= least * (len(mine) + size - both)) & (comps != comp))
        for k in near[np.unique(comps[near], return_index=True)[1]].tolist():
            yield row, int(rows[k])


def other_links(members: DataFrame, linked: DataFrame, texts_: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` between rows of a bucket that no links join yet, written.

    Only buckets with several components are looked at: there every row outside the largest component meets all rows
    of the bucket, as sets of shingles in blocks of bounded rows and bytes. Intersections are counted for a whole block at once;
    what leaves a task is only links, never candidates.
    """
    named = linked.select(F.col("node").alias("row"), "root")
    groups = staged(members.join(named, "row", "left").select("bucket", "row", F.coalesce("root", "row").alias("comp")), "copy-groups")
    mixed = groups.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.count("*").alias("kinds"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("n"))
    mixed = staged(mixed.filter("kinds > 1").select("bucket", "main", "n"), "copy-mixed")
    inside = staged(join_counted(groups, mixed, "bucket", "n", groups.count()).select("bucket", "row", "comp", "main"), "copy-inside")
    made = T.StructType([T.StructField("set", T.BinaryType()), T.StructField("size", T.LongType())])

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        found = [shingle_set(t).tobytes() for t in utf8(columns[0])]
        return [pa.array(found, pa.binary()), pa.array([len(x) for x in found], pa.int64())]

    asked = texts_of(texts_, staged(inside.select("row").distinct(), "copy-asked"))
    sets = staged(map_columns(asked, [F.col("text")], ["row"], made, work), "copy-sets")

    # Blocks are cut by the sizes of the sets; the sets move only when every row knows its blocks.
    outside = F.col("comp") != F.col("main")
    sized = staged(inside.join(sets.select("row", "size"), "row").select("bucket", "row", "comp", "size", outside.alias("outside")), "copy-sized")
    blocks = lambda n, b: F.greatest(F.lit(1), F.ceil(n / F.lit(CELL_ROWS)), F.ceil(b / F.lit(BLOCK_BYTES))).cast("int")
    cuts = sized.groupBy("bucket").agg(
        F.count("*").alias("n"), blocks(F.count_if("outside"), F.sum(F.when(F.col("outside"), F.col("size")).otherwise(0))).alias("most_i"), blocks(F.count("*"), F.sum("size")).alias("most_j")
    )
    own = lambda most: F.pmod(F.xxhash64("row"), F.col(most)).cast("int")
    dealt = join_counted(sized, cuts, "bucket", "n", sized.count()).withColumns({"own_i": own("most_i"), "own_j": own("most_j")})
    # Every row is asked in its own column of blocks; one outside the largest component asks in its own line of them. Where both meet it is one row.
    every = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    names = ["bucket", "i", "j", "row", "comp", "asks", "asked"]
    right = dealt.withColumn("i", every("most_i")).withColumns({"j": F.col("own_j"), "asks": F.col("outside") & (F.col("i") == F.col("own_i")), "asked": F.lit(True)})
    left = dealt.filter("outside and most_j > 1").withColumn("j", every("most_j")).filter("j != own_j").withColumns({"i": F.col("own_i"), "asks": F.lit(True), "asked": F.lit(False)})
    placed = staged(right.select(*names).unionByName(left.select(*names)), "copy-placed")

    def meet(block: pa.Table) -> pa.Table:
        found = list(links_between(block.filter(block["asks"]), block.filter(block["asked"]), least))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    wide = placed.join(sets.select("row", "set"), "row")
    return staged(wide.groupBy("bucket", "i", "j").applyInArrow(meet, "a long, b long").distinct(), "more-copies")


#: Up to so many bitmaps of 4 kB (16 MB) are broadcast to leave out rows where they lie; beyond, rows are moved to meet their numbers.
BITMAPS = 4096


def rows_in(made: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``made`` whose numbers are among the distinct ``rows``, which may be most: one bit for each number is what meets them."""
    number = F.col("row") + 1  # the first row of a partition then falls into the bitmap of the others
    numbers = rows.select(F.bitmap_bucket_number(number).alias("part"), F.bitmap_bit_position(number).alias("at")).repartition("part")
    bits = staged(numbers.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")), "row-bits")
    if bits.count() > BITMAPS:
        return made.join(rows, "row", "left_semi")
    at = F.bitmap_bit_position(number).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    picked = made.join(F.broadcast(bits), F.bitmap_bucket_number(number) == F.col("part"))
    return picked.filter(F.getbit(byte, F.pmod(at, F.lit(8))) == 1).select(*made.columns)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = COPY_SHARE) -> DataFrame:
    """The rows of ``df`` without near copies: of the rows that links join one stays, the one with the smallest id.

    Texts link whose distinct runs of five words have a Jaccard similarity of ``least`` or more. Candidates come from the
    SimHash grid over five-word shingles and, as at 0.8 two fingerprints differ in about ten bits, from bands of
    minima beside it; every link is confirmed by the texts. First each text meets the first text of its fingerprint
    and of its buckets; then those of a bucket that are still not linked meet all of it. Rows of the same set of
    runs are one text.

    Null and blank texts are copies of each other; a null id comes after all others; of repeated rows one stays.
    """
    names = df.columns
    body = f"c{names.index(text_col)}"
    inner = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)], quoted(id_col).alias("own")).withColumn("row", F.monotonically_increasing_id())
    # Written once with its numbers: whatever is read later, by however many tasks, a row keeps its number.
    made = staged(with_bands(inner, body, inner.columns), "bands")
    path = new_path(df.sparkSession, "stay")
    with scratch(df.sparkSession):
        rank = [F.col("own").isNull().alias("unnamed"), "own", "row"]
        alive = made.groupBy("set_id").agg(F.min(F.struct(*rank, "simhash", "bands")).alias("first"))
        alive = staged(alive.select(*[f"first.{c}" for c in ("own", "row", "simhash", "bands")]), "alive")

        each = alive.select("row", F.posexplode("bands").alias("band", "key")).select("row", F.xxhash64("band", "key").alias("bucket"))
        full = staged(distinct_buckets(each), "buckets")
        total = full.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        members = staged(join_counted(each, full, "bucket", "n", total), "members")
        texts_ = made.select("row", F.col(body).alias("text"))
        found = confirmed(first_candidates(alive, members), texts_, least)
        linked = staged(components(found), "linked")
        linked = staged(components(found.unionByName(other_links(members, linked, texts_, least))), "linked")

        named = linked.join(alive.select(F.col("row").alias("node"), "own"), "node").select("root", "own", F.col("node").alias("row"))
        kept = named.groupBy("root").agg(F.min(F.struct(*rank)).alias("first")).select(F.col("first.row").alias("row"))
        gone = named.select("row").join(kept, "row", "left_anti")
        stay = staged(alive.select("row").join(gone, "row", "left_anti"), "stay", path)
    return rows_in(made, stay).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def hex_fingerprint(fp: str = "simhash") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
