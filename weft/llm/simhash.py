"""Near-duplicates by SimHash, found by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; bit i is set where it is set in more than half of the XXH64 values (seed 42) of the text's
word shingles. Two fingerprints at an even distance limit r share a point within r/2 bits of both, so every distinct
fingerprint emits all variants within r/2 flips (65 for r = 2), rows shuffle on the variant, and all fingerprints that
meet there are linked after their distance has been verified. Fingerprints are made distinct first, hence a variant
receives at most as many rows as a ball has points (65), whatever the number of copies: no bucket needs a cap.

Two bits of 64 find nearly equal texts only. Texts whose shingles are alike to 0.8 differ in about a seventh of all bits, too many
for a ball. So keep_one works on long fingerprints of LONG bits, of which it takes segments, and hashes balls of radius two
around each segment: every segment emits all variants within one flip, and two texts meet if any segment differs in at
most two bits. Segments are some ten bits longer than the logarithm of the number of fingerprints, so that few strangers meet,
and so many that texts of the least likeness meet with a chance of FOUND, nearer ones nearly always. Those that meet are
verified on all LONG bits, where many meet inside the join that pairs them. A variant where a great group of near copies meets is not capped; slots.py says how it is searched.

Defined cases: a null text counts as empty, an empty text has fingerprint zero and links like any other, a text of
fewer words than a shingle is one shingle. Repeated rows give repeated results. A null id yields a row whose component
is the smallest non-null id of its group (null if there is none). An empty table gives an empty result. components ignores
other columns than the id and text, keep_one passes them through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.slots import connect, crowded
from weft.llm.text import utf8
from weft.operators.components import connected_components
from weft.session import cut

BITS = 64
#: Shingles whose bits are counted at a time, which bounds memory for any length of text.
BLOCK = 1 << 15
#: Variants that one task should emit.
EMITTED = 2_000_000
#: Bits of a long fingerprint, each 64 from one mixing of a shingle's hash.
LONG = 512
#: Chance that texts of the least likeness meet.
FOUND = 0.9


def shingle_hashes(data: bytes, shingle: int, seed: int) -> tuple[int, Iterator[int]]:
    """How many shingles a text has, repeats included, and their XXH64 values."""
    words = data.lower().split()  # on bytes, both touch ASCII only
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return min(1, len(words)), iter([digest(b" ".join(words), seed)])
    return len(words) - shingle + 1, (digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(shingle))))


def fingerprint(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one UTF-8 text as a signed 64-bit integer."""
    n, hashes = shingle_hashes(data, shingle, seed)
    counts = np.zeros(BITS, dtype=np.int64)
    left = n
    while left:
        block = np.fromiter(hashes, dtype="<u8", count=min(left, BLOCK))
        left -= len(block)
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16)
    packed = np.packbits(2 * counts > n, bitorder="little")
    return int(packed.view("<i8")[0])


def long_fingerprint(data: bytes, shingle: int = 5, seed: int = 42) -> bytes:
    """LONG / 8 bytes: bit by bit what most shingles have in mixings of their hashes; no word gives zeros."""
    n, hashes = shingle_hashes(data, shingle, seed)
    salts = np.arange(1, LONG // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(LONG, dtype=np.int64)
    left = n
    while left:
        block = np.fromiter(hashes, dtype="<u8", count=min(left, BLOCK * BITS // LONG))
        left -= len(block)
        x = block[:, None] + salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(len(block), -1), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > n).tobytes()


def fingerprint_column(text: str | Column = "text", shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x.as_py(), shingle, seed) for x in texts], pa.int64())

    return simhash(utf8(text))


def long_fingerprint_column(text: str | Column = "text", shingle: int = 5, seed: int = 42) -> Column:
    """The long fingerprint as binary."""

    @F.arrow_udf("binary")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([long_fingerprint(x.as_py(), shingle, seed) for x in texts], pa.binary())

    return simhash(utf8(text))


def hex64(column: str) -> Column:
    """16 lowercase hex digits of a long read as unsigned."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def ball_masks(half: int) -> list[int]:
    """Every mask of at most half set bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, column: str = "fp", radius: int = 2) -> DataFrame:
    """Verified links (a, b), a > b, among distinct fingerprints, enough to connect all that differ in at most radius bits.

    All fingerprints that meet at a variant are within radius of each other, so linking each to the smallest of
    them loses no connection and avoids all pairs.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: the ball hashing meets at radius / 2")
    balls = ball_masks(radius // 2)
    masks = F.array(*[F.lit(m).cast("long") for m in balls])
    centres = cut(prints.select(F.col(column).alias("fp")))
    # The shuffle that made them distinct was sized for fingerprints, not for the variants that come of them.
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, centres.count() * len(balls) // EMITTED)
    variants = centres.repartition(tasks, "fp").select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant")))
    near = met.where((F.col("fp") != F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= radius))
    return near.select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def groups(prints: DataFrame, id_col: str = "doc_id", radius: int = 2) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of prints(id_col, fp); root names the group."""
    least = prints.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    roots = connected_components(links(least.select("fp"), "fp", radius)).select(F.col("node").alias("fp"), "root")
    owned = least.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = owned.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return owned.join(named, "root").select("fp", "root", "component_id")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: id, fingerprint (hex), component_id (smallest id reachable over links)."""
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col, shingle).alias("fp")))
    return prints.join(groups(prints, "id", radius), "fp").select(
        F.col("id").alias(id_col), hex64("fp").alias("fingerprint"), "component_id"
    )


def differing(likeness: float) -> float:
    """Share of bits that differ between texts of equally many shingles of which so large a Jaccard share is common."""
    return math.acos(2 * likeness / (1 + likeness)) / math.pi


def segment_plan(n: int, least: float) -> tuple[int, int]:
    """Bits of a segment and number of segments for n long fingerprints."""
    size = min(56, max(16, math.ceil(math.log2(max(2, n))) + 10))
    p = differing(least)
    meet = sum(math.comb(size, k) * p**k * (1 - p) ** (size - k) for k in range(3))
    return size, math.ceil(math.log(1 - FOUND) / math.log(1 - meet))


def segment_classes(own: DataFrame, least: float) -> DataFrame:
    """(pid, root): classes that verified links make of own(pid, p), distinct long fingerprints that meet and are near."""
    n = own.count()
    size, count = segment_plan(n, least)
    rng = np.random.Generator(np.random.PCG64(11))
    order = np.concatenate([rng.permutation(LONG) for _ in range(-(-size * count // LONG))])
    segments = order[: size * count].reshape(count, size)
    weights = np.int64(1) << np.arange(size, dtype=np.int64)
    limit = round(LONG * differing(least))

    @F.arrow_udf("array<long>")
    def keys_of(values: pa.Array) -> pa.Array:
        bits = np.unpackbits(np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, LONG // 8), axis=1)
        keys = np.stack([bits[:, segment] @ weights + (np.int64(k) << np.int64(size)) for k, segment in enumerate(segments)], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, count), pa.int32()), pa.array(keys.reshape(-1)))

    @F.arrow_udf("int")
    def distance(x: pa.Array, y: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(side.to_pylist()), np.uint8).reshape(-1, LONG // 8) for side in (x, y))
        return pa.array(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32), pa.int32())

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = own.select(F.col("pid").alias("a"), F.col("p").alias("x")), own.select(F.col("pid").alias("b"), F.col("p").alias("y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", distance("x", "y").alias("d")).where(F.col("d") <= limit)

    @F.arrow_udf("array<long>")
    def words_of(values: pa.Array) -> pa.Array:
        flat = np.frombuffer(b"".join(values.to_pylist()), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, LONG // 64), pa.int32()), pa.array(flat))

    def sketched(items: DataFrame) -> DataFrame:
        return items.join(own.select("pid", "p"), "pid").withColumn("sketch", words_of("p")).drop("p")

    def near(x: Column, y: Column) -> Column:
        return sum((F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(LONG // 64)), F.lit(0)) <= limit

    masks = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << k for k in range(size))]])
    tasks = max(own.sparkSession.sparkContext.defaultParallelism, n * count * (size + 1) // EMITTED)
    keyed = own.repartition(tasks, "pid").select("pid", F.explode(keys_of("p")).alias("key")).select("pid", "key", F.explode(masks).alias("mask"))
    return connect(crowded(keyed.select(F.col("key").bitwiseXOR(F.col("mask")).alias("slot"), "pid")), verified, near, sketched)


def near_groups(prints: DataFrame, id_col: str = "doc_id", least: float = 0.8) -> DataFrame:
    """(p, root, component_id) for every distinct long fingerprint of prints(id_col, p); root names the group."""
    own = cut(prints.groupBy("p").agg(F.min(id_col).alias("least_id")).select(F.monotonically_increasing_id().alias("pid"), "p", "least_id"))
    rooted = own.join(segment_classes(own, least), "pid", "left").select("p", "least_id", F.coalesce("root", "pid").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("p", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The input's rows and columns, one row of each group of near duplicates: that of the smallest id.

    Texts are near from a likeness of least on, that of their shingles as the long fingerprints tell it. Where rows repeat an
    id, one of them stays (smallest fingerprint). Rows without an id lose to any with one; a
    group that has no id at all keeps one of its rows. The few columns that decide are joined back by a row's
    id and text hash, so whole rows are shuffled once and fingerprints are made once.
    """
    content = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    prints = cut(docs.select(F.col(id_col).alias("id"), content.alias("h"), long_fingerprint_column(text_col, shingle).alias("p")))
    chosen = (
        prints.join(near_groups(prints, "id", least), "p")
        .where(F.col("id").eqNullSafe(F.col("component_id")))
        .groupBy("root", "id")
        .agg(F.min_by("h", F.struct("p", "h")).alias("h"))
        .select(F.struct("id", F.coalesce("h", F.lit(0)).alias("h")).alias("__chosen"))  # of the very type of __key
    )
    keyed = docs.withColumn("__key", F.struct(F.col(id_col).alias("id"), content.alias("h")))
    # An inner join (chosen keys are distinct): a semi-join would be pushed below the key and cost the window a second shuffle.
    kept = keyed.join(cut(chosen), F.col("__key") == F.col("__chosen"))
    rank = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(1)))
    return kept.withColumn("__rank", rank).where("__rank = 1").select(*[docs[c] for c in docs.columns])
