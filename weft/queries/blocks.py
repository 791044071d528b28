"""Queries on blocks, refinement, trees, partitions and merging."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import blocks as B
from weft.operators import merge, partition, refine, seeds
from weft.operators.metrics import reduction
from weft.operators.tokens import term_frequency
from weft.operators.trie import hierarchical_blocks
from weft.queries import base
from weft.queries.base import FULL_SEEDS, KEPT_DOCUMENTS, KEPT_PARTS, OCCURRENCES, PARTS, SEEDS, Book, components_sql, prints_sql

BOOK = Book()
FLAT = "array_to_string(key, ' ') AS key, ref_id"


def flat(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.array_join("key", " ").alias("key"), "ref_id")


def document_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.seed_blocks(*base.kept_documents(spark, sf_dir))


def part_seeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Seeds of part records (all tokens of frequency two or more), and the records."""
    records, freq = base.kept_parts(spark, sf_dir)
    return seeds.seed_blocks(records, freq, full=True), records


@BOOK.add(f"{KEPT_DOCUMENTS}, {SEEDS} SELECT {FLAT} FROM seed")
def seed_blocks_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(document_seeds(spark, sf_dir))


@BOOK.add(f"{KEPT_DOCUMENTS}, {FULL_SEEDS} SELECT {FLAT} FROM seed")
def seed_blocks_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(seeds.seed_blocks(*base.kept_documents(spark, sf_dir), full=True))


@BOOK.add(f"{KEPT_DOCUMENTS} SELECT token AS key, ref_id FROM kd JOIN ktf USING (token) WHERE freq >= 5")
def beta_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(seeds.beta_blocks(*base.kept_documents(spark, sf_dir), 5))


@BOOK.add(f"{KEPT_DOCUMENTS} SELECT token AS key, ref_id FROM kd JOIN ktf USING (token), (SELECT avg(freq) AS m FROM ktf) WHERE freq >= 1.1 * m")
def mean_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(seeds.mean_blocks(*base.kept_documents(spark, sf_dir)))


@BOOK.add(f"{KEPT_PARTS}, {FULL_SEEDS} SELECT array_to_string(key, ' ') AS key, array_to_string(list(ref_id ORDER BY ref_id), ',') AS ref_ids FROM seed GROUP BY key")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.inverted_index(part_seeds(spark, sf_dir)[0]).select(F.array_join("key", " ").alias("key"), F.array_join(F.col("ref_ids").cast("array<string>"), ",").alias("ref_ids"))


PAIRS = "pair AS (SELECT DISTINCT x.ref_id AS a, y.ref_id AS b FROM seed x JOIN seed y ON x.key = y.key AND x.ref_id < y.ref_id)"


@BOOK.add(f"{KEPT_DOCUMENTS}, {SEEDS}, {PAIRS} SELECT a, b FROM pair")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.candidate_pairs(document_seeds(spark, sf_dir))


@BOOK.add(f"{KEPT_DOCUMENTS}, {SEEDS}, s AS (SELECT key, count(*) AS n FROM seed GROUP BY key) SELECT count(*) AS n_blocks, cast(sum(n * (n - 1) / 2) AS BIGINT) AS n_pairs FROM s")
def pair_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pair_total(document_seeds(spark, sf_dir))


@BOOK.add(
    f"{KEPT_DOCUMENTS}, {SEEDS}, {PAIRS}, n AS (SELECT count(*) AS n FROM rec), p AS (SELECT count(*) AS p FROM pair) "
    "SELECT p AS n_pairs, cast(n * (n - 1) / 2 AS BIGINT) AS brute_force, round(100 * (1 - p / (n * (n - 1) / 2)), 4) AS reduction_pct FROM n, p"
)
def reduction_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, freq = base.kept_documents(spark, sf_dir)
    return reduction(B.candidate_pairs(seeds.seed_blocks(records, freq)), records.count())


def _top_k_sql(order: str, extra: str = "") -> str:
    return f"""{KEPT_DOCUMENTS}, {SEEDS},
st AS (SELECT key, count(*) AS size, len(key) AS klen, list_sum(list_transform(key, lambda t: length(t))) / len(key) AS tlen FROM seed GROUP BY key){extra},
ranked AS (SELECT s.key, ref_id, row_number() OVER (PARTITION BY ref_id ORDER BY {order}, s.key) AS r FROM seed s JOIN st ON s.key = st.key),
kept AS (SELECT key, ref_id FROM ranked WHERE r <= 3), ok AS (SELECT key FROM kept GROUP BY key HAVING count(*) >= 2)
SELECT {FLAT} FROM kept WHERE key IN (SELECT key FROM ok)"""


@BOOK.add(_top_k_sql("size"))
def topk_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(B.top_k(document_seeds(spark, sf_dir)))


@BOOK.add(_top_k_sql("size / greatest(klen, 1), -klen, size"))
def topk_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(B.top_k(document_seeds(spark, sf_dir), mode="specificity"))


@BOOK.add(_top_k_sql("-klen, size"))
def topk_keylen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(B.top_k(document_seeds(spark, sf_dir), mode="keylen"))


_NORM = ", ".join(
    f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END AS n_{c}" for c in ("size", "klen", "tlen")
)


@BOOK.add(
    _top_k_sql("score, size, -klen", "").replace(
        "FROM seed GROUP BY key)", f"FROM seed GROUP BY key), st2 AS (SELECT *, {_NORM} FROM st), st3 AS (SELECT *, round(1.0 * n_size + 0.5 * (1.0 - n_klen) + 2.0 * (1.0 - n_tlen), 12) AS score FROM st2)", 1
    ).replace("JOIN st ON s.key = st.key", "JOIN st3 ON s.key = st3.key")
)
def topk_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(B.top_k(document_seeds(spark, sf_dir), mode="composite", weight_size=1.0, weight_shared=0.5, weight_tokenlen=2.0))


@BOOK.add(
    f"{KEPT_DOCUMENTS}, {SEEDS}, {prints_sql('seed', 'bs')}, m AS (SELECT members, list_sort(list_distinct(flatten(list(key)))) AS key FROM bs GROUP BY members) "
    "SELECT array_to_string(key, ' ') AS key, unnest(members) AS ref_id FROM m"
)
def merge_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(B.merge_identical(document_seeds(spark, sf_dir)))


@BOOK.add(f"{KEPT_DOCUMENTS}, {SEEDS}, {prints_sql('seed', 'bs')}, m AS (SELECT members, min(key) AS key FROM bs GROUP BY members) SELECT array_to_string(key, ' ') AS key, unnest(members) AS ref_id FROM m")
def dedup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(B.dedup_blocks(document_seeds(spark, sf_dir)))


def purge_sql(blocks: str, name: str) -> str:
    """Maximal blocks; of equal ones the key of fewest tokens, then least. A superset holds the block's first member."""
    return f"""{prints_sql(blocks, f"{name}_all")},
{name}_one AS (SELECT members, any_value(size) AS size, min((len(key), key)) AS k FROM {name}_all GROUP BY members),
{name}_in AS (SELECT DISTINCT a.k FROM {name}_one a JOIN (SELECT k, members, size, unnest(members) AS m FROM {name}_one) b ON b.m = a.members[1] AND b.size > a.size AND list_has_all(b.members, a.members)),
{name} AS (SELECT k[2] AS key, unnest(members) AS ref_id FROM {name}_one WHERE k NOT IN (SELECT k FROM {name}_in))"""


@BOOK.add(f"{KEPT_DOCUMENTS}, {SEEDS}, {purge_sql('seed', 'pure')} SELECT {FLAT} FROM pure")
def purge_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(B.purge_subsets(document_seeds(spark, sf_dir)))


def refine_sql(source: str, name: str, floor: int) -> str:
    return f"""{name}_x AS (SELECT DISTINCT list_sort(list_append(b.key, d.token)) AS key, b.ref_id FROM {source} b JOIN kd d ON b.ref_id = d.ref_id AND NOT list_contains(b.key, d.token)),
{name} AS (SELECT key, ref_id FROM {name}_x WHERE key IN (SELECT key FROM {name}_x GROUP BY key HAVING count(*) >= {floor}))"""


@BOOK.add(f"{KEPT_PARTS}, {FULL_SEEDS}, {refine_sql('seed', 'l1', 2)} SELECT {FLAT} FROM l1")
def refine_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(refine.refine_blocks(*part_seeds(spark, sf_dir), 2))


_DEEP = f"{refine_sql('seed', 'l1', 2)}, {refine_sql('l1', 'l2', 2)}, {refine_sql('l2', 'l3', 3)}, deep AS (SELECT * FROM seed UNION SELECT * FROM l1 UNION SELECT * FROM l2 UNION SELECT * FROM l3)"


@BOOK.add(f"{KEPT_PARTS}, {FULL_SEEDS}, {_DEEP} SELECT {FLAT} FROM deep")
def refine_depth_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(refine.recursive_blocking(*part_seeds(spark, sf_dir), 3, 2, merge=False, purge=False).blocks)


@BOOK.add(
    f"{KEPT_PARTS}, {FULL_SEEDS}, {_DEEP}, {prints_sql('deep', 'bs')}, m AS (SELECT members, list_sort(list_distinct(flatten(list(key)))) AS key FROM bs GROUP BY members) "
    "SELECT array_to_string(list_sort(members), ',') AS members FROM m"
)
def refine_merged_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = refine.recursive_blocking(*part_seeds(spark, sf_dir), 3, 2, merge=True, purge=False).blocks
    return merged.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("ref_id")).cast("array<string>"), ",").alias("members")).select("members")


@BOOK.add(f"{KEPT_PARTS}, {FULL_SEEDS}, {purge_sql('seed', 'pure')} SELECT {FLAT} FROM pure")
def refine_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(refine.purged_recursion(*part_seeds(spark, sf_dir), 5))


@BOOK.add(f"{KEPT_PARTS}, {FULL_SEEDS}, {refine_sql('seed', 'f4', 4)}, {refine_sql('f4', 'f3', 3)}, {refine_sql('f3', 'f2', 2)}, last AS (SELECT * FROM f2 UNION ALL SELECT * FROM f3 WHERE NOT EXISTS (SELECT 1 FROM f2) UNION ALL SELECT * FROM f4 WHERE NOT EXISTS (SELECT 1 FROM f3)) SELECT {FLAT} FROM last")
def refine_falling_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(refine.falling_floor(*part_seeds(spark, sf_dir), 4))


def dedup_sql(blocks: str, name: str) -> str:
    return f"""{prints_sql(blocks, f"{name}_p")}, {name}_k AS (SELECT min((len(key), key)) AS k FROM {name}_p GROUP BY members),
{name} AS (SELECT b.key, b.ref_id FROM {blocks} b JOIN {name}_k ON b.key = k[2])"""


def kept_level_sql(source: str, name: str, floor: int) -> str:
    return f"{refine_sql(source, f'{name}n', floor)}, {name}u AS (SELECT * FROM {source} UNION SELECT * FROM {name}n), {dedup_sql(f'{name}u', name)}"


@BOOK.add(f"{KEPT_PARTS}, {FULL_SEEDS}, {kept_level_sql('seed', 'g3', 3)}, {kept_level_sql('g3', 'g2', 2)} SELECT {FLAT} FROM g2")
def refine_falling_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(refine.falling_floor(*part_seeds(spark, sf_dir), 3, keep=True))


@BOOK.add(f"{KEPT_PARTS}, {FULL_SEEDS}, {kept_level_sql('seed', 'h1', 1)}, {kept_level_sql('h1', 'h2', 2)} SELECT {FLAT} FROM h2")
def refine_rising_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(refine.rising_floor(*part_seeds(spark, sf_dir), 2))


#: Groups are parted by one token after the other, in order of frequency; a token that all or none of a group's members have parts nothing.
_TREE = f"""{PARTS}, {OCCURRENCES}, rk AS (SELECT token, row_number() OVER (ORDER BY freq DESC, token) - 1 AS rank FROM tf),
has AS (SELECT DISTINCT rank, ref_id FROM occ JOIN rk USING (token)),
tree(rank, path, ref_id) AS (SELECT cast(0 AS BIGINT), '', ref_id FROM rec UNION ALL
    SELECT rank + 1, CASE WHEN low = high THEN path ELSE path || CASE WHEN path = '' THEN '' ELSE ' ' END || token || '=' || h END, ref_id
    FROM (SELECT t.rank, t.path, t.ref_id, rk.token, h, min(h) OVER (PARTITION BY t.path) AS low, max(h) OVER (PARTITION BY t.path) AS high
        FROM (SELECT tree.*, CASE WHEN has.ref_id IS NULL THEN 0 ELSE 1 END AS h FROM tree LEFT JOIN has ON has.rank = tree.rank AND has.ref_id = tree.ref_id) t JOIN rk ON rk.rank = t.rank))
SELECT DISTINCT path, ref_id FROM tree"""


@BOOK.add(_TREE)
def hierarchical_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = base.parts(spark, sf_dir)
    tree = hierarchical_blocks(records, term_frequency(records))
    return tree.select(F.array_join(F.transform("path", lambda s: F.concat(s["token"], F.lit("="), s["present"].cast("string"))), " ").alias("path"), "ref_id")


_INITIAL = f"""{PARTS}, {OCCURRENCES}, m AS (SELECT avg(freq) * 1.1 AS b FROM tf),
pos AS (SELECT ref_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM rec),
best AS (SELECT ref_id, first(token ORDER BY freq DESC, pos) AS token FROM pos JOIN tf USING (token), m WHERE freq >= b GROUP BY ref_id),
p0 AS (SELECT [coalesce(token, 'UNIQUE_' || rec.ref_id)] AS key, rec.ref_id FROM rec LEFT JOIN best USING (ref_id)),
kd AS (SELECT DISTINCT ref_id, token FROM occ)"""


def _partition_sql(source: str, name: str, beta: int) -> str:
    return f"""{name}_c AS (SELECT key, token, count(*) AS n FROM {source} b JOIN kd USING (ref_id) WHERE NOT list_contains(key, token) GROUP BY key, token HAVING count(*) >= {beta}),
{name}_b AS (SELECT key, first(token ORDER BY n DESC, token) AS token FROM {name}_c GROUP BY key),
{name} AS (SELECT CASE WHEN kd.token IS NULL THEN p.key ELSE list_sort(list_append(p.key, b.token)) END AS key, p.ref_id
    FROM {source} p LEFT JOIN {name}_b b ON p.key = b.key LEFT JOIN kd ON kd.ref_id = p.ref_id AND kd.token = b.token)"""


@BOOK.add(f"{_INITIAL} SELECT {FLAT} FROM p0")
def partition_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = base.parts(spark, sf_dir)
    return flat(partition.initial_partition(records, term_frequency(records)))


@BOOK.add(f"{_INITIAL}, {_partition_sql('p0', 'p1', 2)}, {_partition_sql('p1', 'p2', 3)}, {_partition_sql('p2', 'p3', 4)} SELECT {FLAT} FROM p3")
def partition_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = base.parts(spark, sf_dir)
    return flat(partition.iterative_partition(records, term_frequency(records), 4))


#: Rare tokens only, so that components stay apart.
_RARE = "rare AS (SELECT [token] AS key, ref_id FROM kd JOIN ktf USING (token) WHERE freq BETWEEN 2 AND 3)"


@BOOK.add(
    f"""{KEPT_PARTS}, {_RARE}, e AS (SELECT DISTINCT x.ref_id AS a, y.ref_id AS b FROM rare x JOIN rare y ON x.key = y.key AND x.ref_id < y.ref_id),
nodes AS (SELECT DISTINCT ref_id FROM rare), {components_sql('e', 'nodes')},
k AS (SELECT root, list_sort(list_distinct(flatten(list(key)))) AS key FROM rare JOIN comp USING (ref_id) GROUP BY root)
SELECT array_to_string(k.key, ' ') AS key, comp.ref_id FROM comp JOIN k USING (root)"""
)
def component_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, freq = base.kept_parts(spark, sf_dir)
    return flat(merge.merge_sharing_records(seeds.seed_blocks(records, freq.where("freq <= 3"), full=True)))


_COMBOS = f"""{PARTS}, {OCCURRENCES}, v AS (SELECT token FROM tf, (SELECT avg(freq) * 1.5 AS b FROM tf) WHERE freq > b),
vd AS (SELECT DISTINCT ref_id, token FROM occ JOIN v USING (token)),
combo AS (SELECT [x.token, y.token] AS key, x.ref_id FROM vd x JOIN vd y ON x.ref_id = y.ref_id AND x.token < y.token)"""


@BOOK.add(f"{_COMBOS} SELECT {FLAT} FROM combo")
def k_combo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = base.parts(spark, sf_dir)
    return flat(merge.combination_blocks(records, merge.valid_tokens(records), 2))


@BOOK.add(
    f"""{KEPT_PARTS}, pairs AS (SELECT [x.token, y.token] AS key, x.ref_id FROM kd x JOIN kd y ON x.ref_id = y.ref_id AND x.token < y.token),
many AS (SELECT key FROM pairs GROUP BY key HAVING count(*) >= 2), pb AS (SELECT key, ref_id FROM pairs JOIN many USING (key)),
kk AS (SELECT DISTINCT key FROM pb), e AS (SELECT DISTINCT key[1] AS a, key[2] AS b FROM kk), nodes AS (SELECT a AS ref_id FROM e UNION SELECT b FROM e), {components_sql('e', 'nodes')},
r AS (SELECT key, root FROM kk JOIN comp ON comp.ref_id = key[1]), m AS (SELECT root, min(key) AS merged FROM r GROUP BY root)
SELECT DISTINCT array_to_string(merged, ' ') AS key, ref_id FROM pb JOIN r USING (key) JOIN m USING (root)"""
)
def key_overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, freq = base.kept_parts(spark, sf_dir)
    pairs = merge.combination_blocks(records, freq, 2)
    many = B.block_sizes(pairs).where("size >= 2").select("key")
    return flat(merge.merge_sharing_key_tokens(pairs.join(many, "key", "left_semi")))


def _iteration_sql(k: int, by_key: bool, source: str, name: str) -> str:
    """blocks of k valid tokens of source(ref_id, token), without equal ones, merged: {name}(key, ref_id)."""
    tokens = f"{source} x0" + "".join(f" JOIN {source} x{j} ON x{j}.ref_id = x0.ref_id AND x{j - 1}.token < x{j}.token" for j in range(1, k))
    valid = " AND ".join(f"x{j}.token IN (SELECT token FROM {name}_v)" for j in range(k))
    node = "d.key[1]" if by_key else "'r' || d.ref_id"
    edges = (
        f"SELECT key[1] AS a, unnest(key) AS b FROM {name}_k" if by_key
        else f"SELECT 'k' || array_to_string(key, ' ') AS a, 'r' || ref_id AS b FROM {name}_d"
    )
    merged = "first(key ORDER BY len(key), key)" if by_key else "list_sort(list_distinct(flatten(list(key))))"
    parts = components_sql(f"{name}_e", f"{name}_n")
    for inner in ("und", "reach", "comp"):
        parts = re.sub(rf"\b{inner}\b", f"{name}_{inner}", parts)
    return f"""{name}_f AS (SELECT token, count(*) AS freq FROM {source} GROUP BY token), {name}_v AS (SELECT token FROM {name}_f, (SELECT avg(freq) * 1.5 AS b FROM {name}_f) WHERE freq > b),
{name}_b AS (SELECT [{", ".join(f"x{j}.token" for j in range(k))}] AS key, x0.ref_id FROM {tokens} WHERE {valid}), {dedup_sql(f"{name}_b", f"{name}_d")},
{name}_k AS (SELECT DISTINCT key FROM {name}_d), {name}_e AS ({edges}), {name}_n AS (SELECT a AS ref_id FROM {name}_e UNION SELECT b FROM {name}_e), {parts},
{name}_r AS (SELECT DISTINCT d.key, c.root FROM {name}_d d JOIN {name}_comp c ON c.ref_id = {node}), {name}_m AS (SELECT root, {merged} AS merged FROM {name}_r GROUP BY root),
{name} AS (SELECT DISTINCT m.merged AS key, d.ref_id FROM {name}_d d JOIN {name}_r r ON r.key = d.key JOIN {name}_m m ON m.root = r.root)"""


def _iterations_sql(by_key: bool, name: str) -> str:
    return f"""{_iteration_sql(1, by_key, "base", f"{name}1")}, {name}s AS (SELECT 'block_' || sha1(array_to_string(key, chr(31))) AS ref_id, ref_id AS token FROM {name}1),
{_iteration_sql(2, by_key, f"{name}s", f"{name}2")}, {name}o AS (SELECT DISTINCT b.key, o.token AS ref_id FROM {name}2 b JOIN {name}s o ON o.ref_id = b.ref_id)"""


_ITERATIONS = f"""{PARTS}, base AS (SELECT cast(ref_id AS VARCHAR) AS ref_id, unnest(tokens) AS token FROM rec), {_iterations_sql(False, "u")}, {_iterations_sql(True, "w")}
SELECT false AS by_key, 1 AS k, {FLAT} FROM u1 UNION ALL SELECT false, 2, {FLAT} FROM uo UNION ALL SELECT true, 1, {FLAT} FROM w1 UNION ALL SELECT true, 2, {FLAT} FROM wo"""


@BOOK.add(_ITERATIONS)
def iterative_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for by_key in (False, True):
        for k, stage in enumerate(merge.iterative_combinations(base.parts(spark, sf_dir), 2, by_key), 1):
            rows = flat(stage).select(F.lit(by_key).alias("by_key"), F.lit(k).alias("k"), "key", "ref_id")
            out = rows if out is None else out.unionByName(rows)
    return out
