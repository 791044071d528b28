"""Document fingerprints by randomised edit embedding.

A walk reads a string with a pointer: at step t it emits the symbol under the pointer and then moves on by the shared
random bit r(t, symbol). Two strings that differ by few edits fall back into step soon after each edit, so their
walks emit the same symbols at the same steps nearly everywhere: edit distance has become Hamming distance.

Texts are walked on two levels. A text is cut into blocks where the hash of the GRAM characters before a place says so (one place
in SPACING), and after BLOCK characters at the latest. An outer walk goes over the blocks, each known by the characters it was
cut at; an inner walk goes over the characters of a block. An edit inside a block disturbs a few inner steps of that block, and
one that makes or removes a cut a few outer steps, however long the text is and wherever the edit lies. Blocks of all
texts of a batch walk together in numpy, and only blocks that some bit looks at walk at all. A walk has twice as many steps
as symbols, on average as many as it takes to pass them all.

A fingerprint has BITS bits. Each bit has its own random priorities over outer and over inner steps, looks at the steps of
highest priority that the text, and then the block, is long enough for, and hashes the character emitted there to one bit. Hence
texts of different lengths still look at mostly the same places. The likeness of two fingerprints is 1 - 2 d / BITS, at
least 0, for d differing bits, as unrelated bits agree half the time.

Near texts are found by bands. A band is a sample of bits, and texts that agree on a whole band meet in its slot and are
verified by their likeness. Bands are as wide as the number of fingerprints asks for (they tell some six bits more than its
logarithm, so that slots hold few strangers) and as many as find a pair at the least likeness with a chance of FOUND. No slot is capped: slots.py
says how members of a crowded one are tried.

Defined cases: a null text counts as empty; an empty text has the zero fingerprint. Equal texts have equal
fingerprints. Documents are ordered by descending id, rows without an id last, rows of equal id by the hash of their text; after the last
comes the first, and the only row of a table is its own successor. Rows without an id belong to classes but name none (a class
without any id has a null class_id). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.slots import connect, crowded
from weft.llm.text import utf8
from weft.session import cut, tidy

BITS = 512
#: Characters whose hash decides a cut, mean and greatest distance of cuts.
GRAM, SPACING, BLOCK = 8, 512, 2048
STEPS = 2 * BLOCK
SEED = 20_240_601
PAD = 255
#: Blocks that walk together, characters hashed at a time, and outer steps times texts held: they bound a worker's memory.
TOGETHER, PIECE, HELD = 4096, 1 << 20, 1 << 22
#: How much a bit of these fingerprints tells, as characters are not equally frequent: bits of entropy, from texts in four languages.
EVEN = 0.89
#: Chance that two fingerprints of the least likeness share a band.
FOUND = 0.95
#: Leading bits that a slot's members carry, and the chance that those of a pair of the least likeness are too far apart to try it.
SKETCH, LOST = 64, 1e-5


@lru_cache(maxsize=1)
def _random() -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Shared randomness: moves[t, class] of inner walks, each bit's looked-at inner and outer steps, hash bits[bit, class]."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    moves = rng.integers(0, 2, (STEPS, 256)).astype(np.uint8)
    moves[:, PAD] = 0

    def records() -> np.ndarray:
        # The running minimum of independent priorities moves from step j past step x with chance j / x.
        at, found = 1, [0, 1]
        while at < 1 << 46:
            at = int(at / max(rng.random(), 1e-12)) + 1
            found.append(at)
        return np.array(found, np.int64)

    inner, outer = [records() for _ in range(BITS)], [records() for _ in range(BITS)]
    return moves, inner, outer, rng.integers(0, 2, (BITS, 256)).astype(np.uint8)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _classes(codes: np.ndarray) -> np.ndarray:
    """Code points hashed to 0 .. 254."""
    return ((codes * np.uint32(2_654_435_761) >> np.uint32(16)) % np.uint32(PAD)).astype(np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def blocks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks of a text start, and the symbol of each: the hash of the GRAM characters before it, 0 for the first."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, hashes = [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)]
    for begin in range(0, n, PIECE):
        lead = min(begin, GRAM)
        codes = _codes(text[begin - lead : begin + PIECE]).astype(np.uint64)
        if len(codes) <= GRAM:
            continue
        grams = np.zeros(len(codes) - GRAM, np.uint64)  # of the characters before place GRAM, GRAM + 1, ...
        for k in range(GRAM):
            grams = grams * np.uint64(0x100000001B3) + codes[k : k + len(grams)]
        grams = _mixed(grams)
        found = np.flatnonzero(grams % np.uint64(SPACING) == 0)
        places.append(found + GRAM + begin - lead)
        hashes.append(grams[found])
    starts, symbols = np.concatenate(places), np.concatenate(hashes)
    lengths = np.diff(np.append(starts, n))
    more = (lengths - 1) // BLOCK  # cuts for lack of others
    if more.any():
        each = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        forced = np.repeat(starts, more) + BLOCK * each
        order = np.argsort(np.concatenate([starts, forced]), kind="stable")
        symbols = np.concatenate([symbols, each.astype(np.uint64)])[order]
        starts = np.concatenate([starts, forced])[order]
    return starts, symbols


def _pointers(symbols: list[np.ndarray]) -> list[np.ndarray]:
    """Of texts by their block symbols, the block under the pointer of the outer walk at every step; the number of blocks past the end."""
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(symbols)
    order = sorted((k for k in range(len(symbols)) if len(symbols[k])), key=lambda k: -len(symbols[k]))
    while order:
        steps = 2 * len(symbols[order[0]])
        now, order = order[: max(1, HELD // steps)], order[max(1, HELD // steps) :]
        counts = np.array([len(symbols[k]) for k in now])
        base = np.concatenate([[0], np.cumsum(counts + 1)])[:-1]
        flat = np.zeros(int((counts + 1).sum()), np.uint64)
        for k, at in zip(now, base):
            flat[at : at + len(symbols[k])] = symbols[k]
        seen = np.empty((steps, len(now)), np.int32)
        walking = np.searchsorted(-2 * counts, -np.arange(steps), side="left")
        at = np.zeros(len(now), np.int64)
        for t in range(steps):
            n = int(walking[t])
            seen[t, :n] = at[:n]
            bit = _mixed(flat[base[:n] + at[:n]] ^ np.uint64((t * 0x632BE59BD9B4E019) % (1 << 64))) >> np.uint64(63)
            at[:n] = np.minimum(at[:n] + bit.astype(np.int64), counts[:n])
        for j, k in enumerate(now):
            out[k] = seen[: 2 * counts[j], j].copy()
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """BITS / 8 bytes per text."""
    _, inner, outer, hashed = _random()
    cuts = [blocks(t) for t in texts]
    counts = np.array([len(starts) for starts, _ in cuts], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    lengths = np.concatenate([np.diff(np.append(starts, len(t))) for (starts, _), t in zip(cuts, texts)]) if texts else np.empty(0, np.int64)
    pointers = _pointers([symbols for _, symbols in cuts])
    # The block and the inner step that every bit of every text looks at; block -1 past the end.
    steps = np.empty((len(texts), BITS), np.int64)
    for bit in range(BITS):
        steps[:, bit] = outer[bit][np.searchsorted(outer[bit], 2 * counts, side="right") - 1]
    block = np.full((len(texts), BITS), -1, np.int64)
    for k in np.flatnonzero(counts):
        at = pointers[k][steps[k] - 1]
        block[k] = np.where(at < counts[k], first[k] + at, -1)
    length = np.where(block >= 0, lengths[block] if len(lengths) else 0, 0)
    step = np.empty_like(block)
    for bit in range(BITS):
        step[:, bit] = inner[bit][np.searchsorted(inner[bit], 2 * length[:, bit], side="right") - 1]
    emitted = np.full(block.shape, PAD, np.uint8)
    looked, which = np.unique(block, return_inverse=True)
    which = which.reshape(block.shape)
    lead = int(len(looked) > 0 and looked[0] < 0)
    walkers = looked[lead:]
    order = np.argsort(-lengths[walkers], kind="stable") if len(walkers) else np.empty(0, np.int64)
    owner = np.searchsorted(first, walkers, side="right") - 1
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    rank = np.where(block >= 0, place[np.maximum(which - lead, 0)] if len(place) else 0, -1)
    for begin in range(0, len(order), TOGETHER):
        some = order[begin : begin + TOGETHER]
        size = lengths[walkers[some]]
        rows = np.full((len(some), int(size[0]) + 1), PAD, np.uint8)
        for r, w in enumerate(some):
            k = owner[w]
            start = int(cuts[k][0][walkers[w] - first[k]])
            rows[r, : size[r]] = _classes(_codes(texts[k][start : start + int(size[r])]))
        walked = _walk(rows, size)
        inside = (rank >= begin) & (rank < begin + len(some))
        emitted[inside] = walked[step[inside] - 1, rank[inside] - begin]
    bits = hashed[np.arange(BITS), emitted]
    bits[counts == 0] = 0
    return np.packbits(bits, axis=1)


def _walk(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Emitted classes [step, block]; blocks come longest first, so those still walking are a leading slice."""
    moves = _random()[0]
    steps = 2 * int(lengths[0])
    out = np.full((steps, len(lengths)), PAD, np.uint8)
    symbols = rows.reshape(-1)
    at = np.arange(len(lengths), dtype=np.int64) * rows.shape[1]
    walking = np.searchsorted(-2 * lengths, -np.arange(steps), side="left")
    for t in range(steps):
        n = int(walking[t])
        seen = out[t, :n]
        np.take(symbols, at[:n], out=seen)
        at[:n] += moves[t].take(seen)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of equal steps, for rows of fingerprint bytes."""
    differing = np.unpackbits(a ^ b, axis=1).sum(axis=1, dtype=np.int64)
    return np.maximum(0.0, 1.0 - 2.0 * differing / BITS)


def edited(text: str, following: str) -> str:
    """text with its last third of code points replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_column(text: str | Column = "text") -> Column:
    """The fingerprint as binary."""

    @F.arrow_udf("binary")
    def prints(values: pa.Array) -> pa.Array:
        texts = [x.as_py().decode("utf-8", "replace") for x in values]
        return pa.array([row.tobytes() for row in fingerprints(texts)], pa.binary())

    return prints(utf8(text))


#: Parts that a bucket of one id may fall into.
SPLITS = 1 << 12


def with_successors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, tail, id, h, packed) laid out so that, partition by partition, each row is followed by its successor.

    Ids are cut at approximate quantiles into contiguous buckets, and an id that fills several of them (as null may) by the
    hash of the text; every bucket also receives the first row of the next one (tail), and the last bucket that of the first. So
    one shuffle, of compressed texts, and a sort within partitions replace a window over the whole table. The driver
    sees one row per bucket. Rows of one id and text stay together.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    with tidy(spark):
        counted = docs.select(F.col(id_col).cast("long").alias("id")).agg(
            F.percentile_approx("id", [k / parts for k in range(1, parts)], 10 * parts).alias("q"), F.count(F.lit(1)).alias("n"), F.count("id").alias("known")
        ).first()
    bounds, often = np.unique(np.array(counted["q"] or [], np.int64), return_counts=True)
    pieces = np.where(often > 1, np.minimum(often + 1, SPLITS - 1), 0)
    lost = min(SPLITS, 1 + parts * (counted["n"] - counted["known"]) // max(1, counted["n"]))

    @F.arrow_udf("long")
    def bucket_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        share = (hashes.to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # rises with the hash
        k = np.searchsorted(bounds, known, side="left")
        inside = np.minimum(k, max(0, len(bounds) - 1))
        hot = (k < len(bounds)) & (bounds[inside] == known) & (pieces[inside] > 0) if len(bounds) else np.zeros(len(known), bool)
        split = np.where(missing, lost, np.where(hot, pieces[inside] if len(bounds) else 0, 0)).astype(np.uint64)
        part = np.where(split > 0, (share * split) >> np.uint64(32), np.uint64(SPLITS - 1)).astype(np.int64)
        return pa.array(np.where(missing, len(bounds) + 1, len(bounds) - k) * SPLITS + part, pa.int64())

    placed = named.withColumn("bucket", bucket_of("id", "h"))
    first = F.struct((F.coalesce(-F.col("id"), F.lit(0))).alias("down"), "h")
    with tidy(spark):
        tops = {row["bucket"]: row["top"] for row in placed.groupBy("bucket").agg(F.min_by(F.struct("id", "h"), first).alias("top")).collect()}
    filled = sorted(tops)
    after = [(filled[k - 1], *tops[b], b) for k, b in enumerate(filled)]  # the first bucket's head closes the last one
    heads = spark.createDataFrame(after, "goes long, top long, top_h long, head_of long")
    is_head = (F.col("bucket") == F.col("head_of")) & F.col("id").eqNullSafe(F.col("top")) & (F.col("h") == F.col("top_h"))
    marked = placed.withColumn("packed", packed_column("text")).drop("text").join(F.broadcast(heads), is_head, "left")  # a row per bucket
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail"))
    there = F.struct(F.col("goes").alias("bucket"), F.lit(True).alias("tail"))
    dealt = marked.select("id", "h", "packed", F.explode(F.when(F.col("goes").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("p"))
    laid = dealt.select("p.bucket", "p.tail", "id", "h", "packed").repartition("bucket")
    return laid.sortWithinPartitions("bucket", "tail", F.col("id").desc_nulls_last(), "h", "packed")


def packed_column(text: str) -> Column:
    """The bytes compressed: a shuffle of whole texts writes about half as much."""

    @F.arrow_udf("binary")
    def packed(values: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.array([pack(x.as_py()) for x in values], pa.binary())

    return packed(F.col(text))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """Per row: fingerprints of its text and its edited text, their likeness and that to the next document's, and the class
    of its near texts (class_id: their smallest id)."""
    schema = "id long, n_chars long, sha binary, p binary, e binary, near_edited double, near_next double"
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    names = ["id", "n_chars", "sha", "p", "e", "near_edited", "near_next"]

    def judge(rows: list[tuple], following: list[tuple]) -> pa.RecordBatch:
        changed = [edited(r[2], f[2]) for r, f in zip(rows, following)]
        own, new, near = np.stack([r[3] for r in rows]), fingerprints(changed), np.stack([f[3] for f in following])
        columns = [
            [r[0] for r in rows],
            [len(r[2]) for r in rows],
            [hashlib.sha256(c.encode()).digest() for c in changed],
            [x.tobytes() for x in own],
            [x.tobytes() for x in new],
            likeness(own, new),
            likeness(own, near),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            # Slices keep the decoded texts of a batch small.
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [unpack(x.as_py()).decode("utf-8", "replace") for x in part.column("packed")]
                rows = held + list(zip(part.column("id").to_pylist(), part.column("tail").to_pylist(), texts, fingerprints(texts)))
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]
                if pairs:
                    yield judge(*map(list, zip(*pairs)))
                held = rows[-1:]

    rows = cut(with_successors(docs, id_col, text_col).mapInArrow(run, schema))
    classed = rows.join(near_classes(rows, least), "p")
    digits = [F.lower(F.hex(c)).alias(name) for c, name in (("sha", "edited_sha256"), ("p", "fingerprint"), ("e", "edited_fingerprint"))]
    return classed.select(F.col("id").alias(id_col), "n_chars", *digits, "near_edited", "near_next", "class_id")


def band_plan(n: int, least: float) -> tuple[int, int]:
    """Bits of a band and number of bands for n fingerprints."""
    width = min(62 - 16, max(16, math.ceil((math.log2(max(2, n)) + 6) / EVEN)))
    agree = (1 + least) / 2  # of a bit, at the least likeness
    return width, math.ceil(math.log(1 - FOUND) / math.log(1 - agree**width))


def sketch_limit(least: float) -> int:
    """Differing bits of two sketches beyond which their pair is not tried."""
    p, t, tail = (1 - least) / 2, 0, 1.0
    while True:
        tail -= math.comb(SKETCH, t) * p**t * (1 - p) ** (SKETCH - t)
        if tail <= LOST:
            return t
        t += 1


def band_classes(own: DataFrame, least: float) -> DataFrame:
    """(pid, root): classes of own(pid, p) that verified links make, of at least that likeness between texts that share a band."""
    width, count = band_plan(own.count(), least)
    rng = np.random.Generator(np.random.PCG64(SEED + 1))
    bands = np.stack([rng.choice(BITS, width, replace=False) for _ in range(count)])
    weights = np.int64(1) << np.arange(width, dtype=np.int64)

    @F.arrow_udf("array<long>")
    def slots_of(values: pa.Array) -> pa.Array:
        bits = np.unpackbits(_rows_of(values), axis=1)
        keys = np.stack([bits[:, band] @ weights + (np.int64(k) << np.int64(width)) for k, band in enumerate(bands)], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, count), pa.int32()), pa.array(keys.reshape(-1)))

    @F.arrow_udf("long")
    def sketch_of(values: pa.Array) -> pa.Array:
        return pa.array(np.ascontiguousarray(_rows_of(values)[:, : SKETCH // 8]).view(np.int64).reshape(-1))

    def plausible(x: Column, y: Column) -> Column:
        return F.bit_count(x.bitwiseXOR(y)) <= sketch_limit(least)

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = own.select(F.col("pid").alias("a"), F.col("p").alias("x")), own.select(F.col("pid").alias("b"), F.col("p").alias("y"))
        near = F.arrow_udf(_likeness_of, "double")("x", "y")
        return pairs.join(left, "a").join(right, "b").select("a", "b", near.alias("near")).where(F.col("near") >= least)

    return connect(crowded(own.select("pid", sketch_of("p").alias("sketch"), F.explode(slots_of("p")).alias("slot"))), verified, plausible)


def near_classes(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(p, class_id): of every distinct fingerprint of prints(id, p), the smallest id among all that links connect it with."""
    own = cut(prints.groupBy("p").agg(F.min("id").alias("least_id")).select(F.monotonically_increasing_id().alias("pid"), "p", "least_id"))
    rooted = own.join(band_classes(own, least), "pid", "left").select("p", "least_id", F.coalesce("root", "pid").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("class_id")), "root").select("p", "class_id")


def _rows_of(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def _likeness_of(x: pa.Array, y: pa.Array) -> pa.Array:
    return pa.array(likeness(_rows_of(x), _rows_of(y)), pa.float64())
