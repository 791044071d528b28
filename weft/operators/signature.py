"""Signature blocking: token variations, signatures of variation sets, records by their signatures, balanced splits."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, MinHashLSH
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import jaccard, similarity_ratio, soundex
from weft.functions.variations import all_variations
from weft.operators.graph import dense_index
from weft.session import cut


def vocabulary(records: DataFrame) -> DataFrame:
    """(token)."""
    return records.select(F.explode("tokens").alias("token")).distinct()


def _symmetric(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """(token, variant) with every token its own variant and pairs in both directions."""
    own = tokens.select("token", F.col("token").alias("variant"))
    turned = pairs.select(F.col("variant").alias("token"), F.col("token").alias("variant"))
    return own.unionByName(pairs).unionByName(turned).distinct()


def _segment(n: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Zero-based start and length of the i-th of k + 1 nearly equal segments of n characters."""
    base, longer = F.floor(n / (k + 1)).cast("int"), (n % (k + 1)).cast("int")
    extra = F.greatest(F.lit(0), i - (k + 1 - longer))
    return (i * base + extra).cast("int"), F.when(i >= k + 1 - longer, base + 1).otherwise(base)


def fuzzy_variations(tokens: DataFrame, threshold: int = 85, max_gap: int = 2) -> DataFrame:
    """Tokens of equal first character, lengths at most max_gap apart and similarity of threshold or more.

    A threshold bounds the edit distance k by the longer length. Of k + 1 segments of the shorter token at least one
    survives k edits and stands in the longer token, at most k places away. So pairs meet in an equi-join on first character,
    both lengths and a segment, and are then verified; tokens too short for k + 1 segments meet on their lengths alone.
    """
    sized = tokens.select("token", F.substring("token", 1, 1).alias("c"), F.char_length("token").alias("n")).where("n > 0")

    def edits(longer: str) -> Column:
        return F.floor(F.col(longer) * (100.5 - threshold) / 100).cast("int")

    n, k = F.col("n"), F.col("k")
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit("").alias("part")))

    def own(i: Column) -> Column:
        start, size = _segment(n, k, i)
        return F.struct(i.alias("i"), F.substring(F.col("token"), start + 1, size).alias("part"))

    short = sized.select("*", F.explode(F.sequence(n, n + max_gap)).alias("m")).withColumn("k", edits("m")).where((k > 0) & (n > 0))
    offered = short.select("token", "c", "n", "m", F.explode(F.when(n > k, F.transform(F.sequence(F.lit(0), k), own)).otherwise(whole)).alias("s"))

    def near(i: Column) -> Column:
        start, size = _segment(n, k, i)
        first, last = F.greatest(F.lit(0), start - k), F.least(start + k, F.col("m") - size)
        places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.struct(i.alias("i"), F.substring(F.col("token"), p + 1, size).alias("part")))

    long = sized.withColumnRenamed("n", "m").select("*", F.explode(F.sequence(F.greatest(F.lit(1), F.col("m") - max_gap), F.col("m"))).alias("n"))
    long = long.withColumn("k", edits("m")).where(k > 0)
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), k), near)))
    sought = long.select(F.col("token").alias("variant"), "c", "n", "m", F.explode(F.when(n > k, parts).otherwise(whole)).alias("s"))
    met = offered.join(sought, ["c", "n", "m", "s"]).where(F.col("token") != F.col("variant")).select("token", "variant").distinct()
    return _symmetric(tokens, met.where(similarity_ratio(F.col("token"), F.col("variant")) >= threshold))


def phonetic_classes(tokens: DataFrame) -> DataFrame:
    """(token, code, head): every token with its sound code and the smallest token of that code. As many rows as tokens, however many
    sound alike: what J11 means without its pairs, whose number grows with the square of a code's tokens."""
    coded = tokens.select("token", soundex("token").alias("code"))
    heads = coded.groupBy("code").agg(F.min("token").alias("head"))
    return coded.join(heads, "code").select("token", "code", "head")


def phonetic_variations(tokens: DataFrame) -> DataFrame:
    """Tokens of equal sound code (J11), in pairs, as variation sets are made of; for large vocabularies see phonetic_classes."""
    coded = tokens.select("token", soundex("token").alias("code"))
    return coded.join(coded.select(F.col("token").alias("variant"), "code"), "code").select("token", "variant")


def manual_variations(tokens: DataFrame, mapping: DataFrame) -> DataFrame:
    """Variants from mapping(token, variant), one way."""
    own = tokens.select("token", F.col("token").alias("variant"))
    return own.unionByName(mapping.join(tokens, "token").select("token", "variant")).distinct()


def data_quality_variations(tokens: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Tokens one of whose generated variants is another token's lower case."""
    made = tokens.select("token", F.explode(all_variations(F.lower("token"), rules)).alias("low")).where((F.col("low") != "") & (F.col("low") != F.lower("token")))
    known = tokens.select(F.col("token").alias("variant"), F.lower("token").alias("low"))
    pairs = made.join(known, "low").where(F.col("token") != F.col("variant")).select("token", "variant")
    return _symmetric(tokens, pairs)


def variations(
    tokens: DataFrame, method: str = "data_quality", threshold: int = 85, mapping: DataFrame | None = None, rules: list[str] | None = None
) -> DataFrame:
    """(token, variant) by data_quality, fuzzy, phonetic or manual."""
    if method == "data_quality":
        return data_quality_variations(tokens, rules)
    if method == "fuzzy":
        return fuzzy_variations(tokens, threshold)
    if method == "phonetic":
        return phonetic_variations(tokens)
    if method == "manual":
        return manual_variations(tokens, mapping) if mapping is not None else tokens.select("token", F.col("token").alias("variant"))
    raise ValueError(f"unknown method {method!r}")


def set_signatures(variants: DataFrame, prefix: str = "VSIG") -> DataFrame:
    """(sig, tokens): one signature per distinct variation set, numbered in the order of the sets."""
    sets = variants.groupBy("token").agg(F.array_sort(F.collect_set("variant")).alias("tokens")).select("tokens").distinct()
    numbered = dense_index(sets, [F.col("tokens")], "n")
    return numbered.select(F.concat(F.lit(f"{prefix}_"), F.lpad((F.col("n") + 1).cast("string"), 5, "0")).alias("sig"), "tokens")


def token_signatures(signatures: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, sig): every signature whose set has the token."""
    return signatures.select("sig", F.explode("tokens").alias("token")).join(tokens, "token", "left_semi").select("token", "sig")


def record_signatures(records: DataFrame, token_sigs: DataFrame) -> DataFrame:
    """(ref_id, sigs): sorted distinct signatures of a record's tokens, empty for none."""
    rows = records.select("ref_id", F.explode_outer(F.array_distinct("tokens")).alias("token")).join(token_sigs, "token", "left")
    return rows.groupBy("ref_id").agg(F.array_sort(F.collect_set("sig")).alias("sigs"))


def exact_blocks(record_sigs: DataFrame) -> DataFrame:
    """(key, ref_id): records of equal signature set; those without any share one block."""
    return record_sigs.select(F.col("sigs").alias("key"), "ref_id")


def lsh_blocks(record_sigs: DataFrame, threshold: float = 0.5, num_tables: int = 8, seed: int = 42) -> DataFrame:
    """(key, ref_id): records by the set of records that are at least threshold similar to them, by MinHash LSH.

    Records without a signature are dropped. Candidates from hashed features are verified by the Jaccard similarity of the
    signatures themselves, and a record is its own neighbour; a pair is found with a chance of 1 - (1 - j) ** num_tables.
    """
    rows = cut(record_sigs.where(F.size("sigs") > 0).select("ref_id", "sigs"))
    typed = HashingTF(inputCol="sigs", outputCol="features", numFeatures=1 << 20, binary=True).transform(rows)
    model = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=num_tables, seed=seed).fit(typed)
    # Features that share a bucket make texts look more alike, or a little less; the margin is for the latter.
    met = model.approxSimilarityJoin(typed, typed, min(1.0, 1.0 - 0.8 * threshold) + 1e-9, "distance")
    both = met.select(F.col("datasetA.ref_id").alias("ref_id"), F.col("datasetB.ref_id").alias("other"), F.col("datasetA.sigs").alias("x"), F.col("datasetB.sigs").alias("y"))
    pairs = both.where(jaccard(F.col("x"), F.col("y"), 0.0) >= threshold - 1e-12).select("ref_id", "other")
    pairs = pairs.unionByName(rows.select("ref_id", F.col("ref_id").alias("other")))
    near = pairs.groupBy("ref_id").agg(F.array_sort(F.collect_set(F.col("other").cast("string"))).alias("key"))
    return near.select("key", "ref_id")


def split_blocks(blocks: DataFrame, record_sigs: DataFrame, max_depth: int = 3, min_size: int = 2) -> DataFrame:
    """(label, ref_id): blocks split in two, level by level, by the signature that parts them most evenly.

    A label is the block's key and the signs of its splits, +sig for members that have it and -sig for the others; equal labels of
    different blocks are told apart by #1, #2, ... in the order of their keys.
    """
    sigs = cut(record_sigs.select("ref_id", F.explode("sigs").alias("sig")))
    current = cut(blocks.select(F.col("key").alias("root"), F.array().cast("array<string>").alias("steps"), "ref_id"))
    for _ in range(max_depth):
        sizes = current.groupBy("root", "steps").agg(F.count(F.lit(1)).alias("size"))
        large = sizes.where((F.col("size") > min_size) & (F.col("size") > 1))
        held = current.join(sigs, "ref_id").groupBy("root", "steps", "sig").agg(F.count(F.lit(1)).alias("n"))
        usable = held.join(large, ["root", "steps"]).where(F.col("n") < F.col("size"))
        balance = F.least("n", F.col("size") - F.col("n"))
        rank = F.row_number().over(Window.partitionBy("root", "steps").orderBy(balance.desc(), "sig"))
        best = cut(usable.withColumn("rank", rank).where("rank = 1").select("root", "steps", "sig"))
        if best.isEmpty():
            break
        has = sigs.withColumn("has", F.lit(True))
        parted = current.join(best, ["root", "steps"], "left").join(has, ["ref_id", "sig"], "left")
        sign = F.concat(F.when(F.col("has"), "+").otherwise("-"), F.col("sig"))
        current = cut(parted.select("root", F.when(F.col("sig").isNull(), F.col("steps")).otherwise(F.array_append("steps", sign)).alias("steps"), "ref_id"))
    labels = current.select("root", "steps").distinct().withColumn("base", F.concat("root", "steps"))
    again = F.row_number().over(Window.partitionBy("base").orderBy("root", "steps")) - 1
    named = labels.withColumn("again", again).select(
        "root", "steps", F.when(F.col("again") == 0, F.col("base")).otherwise(F.array_append("base", F.concat(F.lit("#"), F.col("again").cast("string")))).alias("label")
    )
    return current.join(named, ["root", "steps"]).select("label", "ref_id")
