"""Queries on pair graphs, clusters, evaluation and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import blocks as B
from weft.operators import graph as G
from weft.operators import layout, metrics, report, seeds
from weft.plans import flagship
from weft.queries import base
from weft.queries.base import DOCUMENTS, FULL_SEEDS, KEPT_DOCUMENTS, KEPT_PARTS, SEEDS, Book, components_sql
from weft.queries.blocks import purge_sql
from weft.session import cut, table

BOOK = Book()
TAU = 0.2

_KEPT = f"""{KEPT_DOCUMENTS}, {SEEDS}, st AS (SELECT key, count(*) AS size FROM seed GROUP BY key),
ranked AS (SELECT s.key, ref_id, row_number() OVER (PARTITION BY ref_id ORDER BY size, s.key) AS r FROM seed s JOIN st ON s.key = st.key),
cutk AS (SELECT key, ref_id FROM ranked WHERE r <= 3), blk AS (SELECT key, ref_id FROM cutk WHERE key IN (SELECT key FROM cutk GROUP BY key HAVING count(*) >= 2))"""


def _arcs_sql(contribution: str, s: float, most: int | None = None) -> str:
    cap = f" AND size * (size - 1) / 2 <= {most}" if most else ""
    return f"""{_KEPT}, bsz AS (SELECT key, count(*) AS size FROM blk GROUP BY key), n AS (SELECT cast(count(*) AS DOUBLE) AS corpus FROM rec),
con AS (SELECT key, {contribution} AS c FROM bsz, n WHERE size >= 2{cap}),
raw AS (SELECT x.ref_id AS a, y.ref_id AS b, sum(c) AS w FROM blk x JOIN blk y ON x.key = y.key AND x.ref_id < y.ref_id JOIN con ON con.key = x.key WHERE c <> 0 GROUP BY ALL),
edge AS (SELECT a, b, w * (1 - {s} + {s} * CASE WHEN len(u) = 0 THEN 0.0 ELSE len(list_intersect(ta, tb)) / len(u) END) AS w
    FROM (SELECT a, b, w, ra.tokens AS ta, rb.tokens AS tb, list_distinct(list_concat(ra.tokens, rb.tokens)) AS u FROM raw JOIN krec ra ON ra.ref_id = a JOIN krec rb ON rb.ref_id = b))"""


def kept_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Default seeds of documents after the per-record filter, and the records."""
    records, freq = base.kept_documents(spark, sf_dir)
    return cut(B.top_k(seeds.seed_blocks(records, freq))), records


def rounded(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", F.round("w", 6).alias("w"))


@BOOK.add(f"{_arcs_sql('1.0 / size', 1.0)} SELECT a, b, round(w, 6) AS w FROM edge")
def arcs_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.arcs_graph(*kept_blocks(spark, sf_dir)))


@BOOK.add(f"{_arcs_sql('CASE WHEN size >= corpus THEN 0.0 ELSE ln(corpus / size) / size END', 0.5)} SELECT a, b, round(w, 6) AS w FROM edge")
def arcs_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, records = kept_blocks(spark, sf_dir)
    return rounded(G.arcs_graph(blocks, records, "idf", records.count(), factors=G.ArcsFactors(pair_sim_weight=0.5)))


@BOOK.add(
    _arcs_sql(
        r"(1.0 / size) * (1.0 + 0.5 * ln(1 + list_max(list_transform(key, lambda t: length(t))))) "
        r"* CASE WHEN len(list_filter(key, lambda t: NOT regexp_full_match(t, '\p{Nd}+'))) = 0 THEN 0.5 ELSE 2.0 END", 0.0, 10,
    )
    + " SELECT a, b, round(w, 6) AS w FROM edge"
)
def arcs_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, records = kept_blocks(spark, sf_dir)
    factors = G.ArcsFactors(length_weight=0.5, numeric_factor=0.5, word_factor=2.0, pair_sim_weight=0.0)
    return rounded(G.arcs_graph(blocks, records, max_block_pair_cost=10, factors=factors))


#: Pairs sampled of a block: fewer than the largest blocks have, so that both ways are taken.
DENSITY_SAMPLE = 3


@BOOK.add(
    f"""{_KEPT}, pl AS (SELECT key, ref_id, row_number() OVER (PARTITION BY key ORDER BY md5(cast(ref_id AS VARCHAR)), ref_id) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM blk),
al AS (SELECT x.key, x.ref_id AS a, y.ref_id AS b, y.i * (y.i - 1) // 2 + x.i AS p, x.n * (x.n - 1) // 2 AS total FROM pl x JOIN pl y ON x.key = y.key AND x.i < y.i),
dr AS (SELECT key, unnest(list_transform(range(least(total, {DENSITY_SAMPLE})), lambda k: cast(floor(k * total / least(total, {DENSITY_SAMPLE})) AS BIGINT))) AS p FROM (SELECT DISTINCT key, total FROM al)),
pr AS (SELECT key, a, b FROM al JOIN dr USING (key, p)),
j AS (SELECT key, CASE WHEN len(u) = 0 THEN 0.0 ELSE len(list_intersect(ta, tb)) / len(u) END AS j
    FROM (SELECT key, ra.tokens AS ta, rb.tokens AS tb, list_distinct(list_concat(ra.tokens, rb.tokens)) AS u FROM pr JOIN krec ra ON ra.ref_id = a JOIN krec rb ON rb.ref_id = b))
SELECT array_to_string(key, ' ') AS key, round(avg(j), 6) AS density FROM j GROUP BY key"""
)
def block_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, records = kept_blocks(spark, sf_dir)
    return G.block_density(blocks, records, DENSITY_SAMPLE).select(F.array_join("key", " ").alias("key"), F.round("density", 6).alias("density"))


@BOOK.add(
    f"""{_arcs_sql('1.0 / size', 1.0)}, e AS (SELECT a, b, round(w, 6) AS w FROM edge), x AS (SELECT min(w) AS lo, max(w) AS hi, (max(w) - min(w)) / 10 AS width FROM e),
p AS (SELECT cast(CASE WHEN width = 0 THEN 0 ELSE least(floor((w - lo) / width), 9) END AS INTEGER) AS bucket, lo, width FROM e, x)
SELECT bucket, round(lo + bucket * width, 6) AS lo, count(*) AS n FROM p GROUP BY bucket, lo, width"""
)
def edge_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edge_histogram(cut(rounded(G.arcs_graph(*kept_blocks(spark, sf_dir))))).withColumn("lo", F.round("lo", 6))


_CLUSTERS = f"""{_arcs_sql('1.0 / size', 1.0)}, e AS (SELECT a, b FROM edge WHERE round(w, 9) >= {TAU}), {components_sql('e', 'rec')},
sz AS (SELECT root, count(*) AS size FROM comp GROUP BY root), num AS (SELECT root, row_number() OVER (ORDER BY size DESC, root) - 1 AS cluster_id FROM sz),
clu AS (SELECT comp.ref_id, num.cluster_id FROM comp JOIN num USING (root))"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, records = kept_blocks(spark, sf_dir)
    return cut(G.number_clusters(cut(G.cluster_records(blocks, records, TAU))))


@BOOK.add(f"{_CLUSTERS} SELECT ref_id, cluster_id FROM clu")
def clusters_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, sf_dir)


@BOOK.add()
def density_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, records = kept_blocks(spark, sf_dir)
    return G.number_clusters(cut(G.cluster_records(blocks, records, 0.05, density_floor=0.7)))


#: With merge and purge, recursion leaves the largest seeds, each under all tokens that its members have in common (those of one
#: member, which nothing extends, under their own tokens).
_FLAGSHIP = f"""{KEPT_PARTS}, {FULL_SEEDS}, {purge_sql("seed", "pure")}, psz AS (SELECT key, count(*) AS size, min(ref_id) AS one FROM pure GROUP BY key),
com AS (SELECT p.key, d.token FROM pure p JOIN kd d USING (ref_id) JOIN psz z ON z.key = p.key AND z.size > 1 GROUP BY p.key, d.token, z.size HAVING count(*) = z.size),
lone AS (SELECT key[1] AS token, min(ref_id) AS one FROM seed GROUP BY key HAVING count(*) = 1),
names AS (SELECT key, list_sort(list(token)) AS name FROM (SELECT * FROM com UNION SELECT z.key, lone.token FROM psz z JOIN lone USING (one) WHERE z.size = 1) GROUP BY key),
named AS (SELECT n.name AS key, p.ref_id FROM pure p JOIN names n USING (key)), st AS (SELECT key, count(*) AS size FROM named GROUP BY key),
ranked AS (SELECT s.key, ref_id, row_number() OVER (PARTITION BY ref_id ORDER BY size, s.key) AS r FROM named s JOIN st ON s.key = st.key),
cutk AS (SELECT key, ref_id FROM ranked WHERE r <= 3), blk AS (SELECT key, ref_id FROM cutk WHERE key IN (SELECT key FROM cutk GROUP BY key HAVING count(*) >= 2)),
con AS (SELECT key, 1.0 / count(*) AS c FROM blk GROUP BY key HAVING count(*) >= 2 AND count(*) * (count(*) - 1) / 2 <= 100000),
raw AS (SELECT x.ref_id AS a, y.ref_id AS b, sum(c) AS w FROM blk x JOIN blk y ON x.key = y.key AND x.ref_id < y.ref_id JOIN con ON con.key = x.key GROUP BY ALL),
edge AS (SELECT a, b, w * len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) AS w
    FROM (SELECT a, b, w, ra.tokens AS ta, rb.tokens AS tb FROM raw JOIN krec ra ON ra.ref_id = a JOIN krec rb ON rb.ref_id = b)),
e AS (SELECT a, b FROM edge WHERE round(w, 9) >= 0.2), {components_sql("e", "rec")}, sz AS (SELECT root, count(*) AS size FROM comp GROUP BY root),
num AS (SELECT root, row_number() OVER (ORDER BY size DESC, root) - 1 AS cluster_id FROM sz)
SELECT comp.ref_id, num.cluster_id FROM comp JOIN num USING (root)"""


@BOOK.add(_FLAGSHIP)
def flagship_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps with merge and purge on part records: cluster of every part."""
    prepared = flagship.prepare(base.parts(spark, sf_dir), base.PART_FREQUENCY)
    return flagship.run(prepared, flagship.Config(full=True, max_depth=3, max_block_pair_cost=100_000)).clusters


@BOOK.add()
def ablation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the four merge and purge combinations, with parts of equal name, brand and size as truth."""
    prepared = flagship.prepare(base.parts(spark, sf_dir), base.PART_FREQUENCY)
    truth = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref_id"), F.xxhash64("p_name", "p_brand", "p_size").cast("string").alias("truth_id"))
    return flagship.experiments(prepared, truth, flagship.Config(full=True, max_depth=2), {"A_merge_purge"}).drop("time_total_s")


_TRUTH = "truth AS (SELECT doc_id AS ref_id, min(doc_id) OVER (PARTITION BY text) AS truth_id FROM documents)"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal text are the same: the smallest id names them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    names = docs.groupBy("h").agg(F.min("doc_id").alias("truth_id"))
    return docs.join(names, "h").select(F.col("doc_id").alias("ref_id"), "truth_id")


_SCORES = """round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1"""


@BOOK.add(
    f"""{_CLUSTERS}, {_TRUTH}, cp AS (SELECT x.ref_id AS a, y.ref_id AS b FROM clu x JOIN clu y ON x.cluster_id = y.cluster_id AND x.ref_id < y.ref_id),
tp AS (SELECT x.ref_id AS a, y.ref_id AS b FROM truth x JOIN truth y ON x.truth_id = y.truth_id AND x.ref_id < y.ref_id),
c AS (SELECT (SELECT count(*) FROM cp JOIN tp USING (a, b)) AS TP, (SELECT count(*) FROM tp) AS E, (SELECT count(*) FROM cp) AS L),
s AS (SELECT *, CASE WHEN L > 0 THEN TP / L ELSE 1.0 END AS p, CASE WHEN E > 0 THEN TP / E ELSE 1.0 END AS r FROM c)
SELECT TP, E, L, L - TP AS FP, E - TP AS FN, {_SCORES} FROM s"""
)
def er_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cluster_metrics(clusters(spark, sf_dir), truth(spark, sf_dir))


@BOOK.add(
    f"""{KEPT_DOCUMENTS}, {SEEDS}, {_TRUTH}, cp AS (SELECT DISTINCT x.ref_id AS a, y.ref_id AS b FROM seed x JOIN seed y ON x.key = y.key AND x.ref_id < y.ref_id),
tp AS (SELECT x.ref_id AS a, y.ref_id AS b FROM truth x JOIN truth y ON x.truth_id = y.truth_id AND x.ref_id < y.ref_id),
c AS (SELECT (SELECT count(*) FROM cp JOIN tp USING (a, b)) AS TP, (SELECT count(*) FROM tp) AS E, (SELECT count(*) FROM cp) AS L),
s AS (SELECT *, CASE WHEN L > 0 THEN TP / L ELSE 1.0 END AS p, CASE WHEN E > 0 THEN TP / E ELSE 1.0 END AS r FROM c)
SELECT TP, E, L, L - TP AS FP, E - TP AS FN, {_SCORES} FROM s"""
)
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = seeds.seed_blocks(*base.kept_documents(spark, sf_dir))
    return metrics.pair_metrics(B.candidate_pairs(seed), truth(spark, sf_dir))


_SIZES = "SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM {0} GROUP BY {1}) GROUP BY size"


@BOOK.add(f"{_CLUSTERS} {_SIZES.format('clu', 'cluster_id')}")
def cluster_size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.size_distribution(clusters(spark, sf_dir), "cluster_id")


@BOOK.add(
    f"""{_CLUSTERS}, {_TRUTH}, p AS ({_SIZES.format('clu', 'cluster_id')}), t AS ({_SIZES.format('truth', 'truth_id')})
SELECT cast(sum(abs(coalesce(p.n, 0) - coalesce(t.n, 0))) AS BIGINT) AS size_distribution_l1, cast(sum(coalesce(p.n, 0) - coalesce(t.n, 0)) AS BIGINT) AS cluster_count_diff
FROM p FULL JOIN t USING (size)"""
)
def size_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.size_l1(metrics.size_distribution(clusters(spark, sf_dir), "cluster_id"), metrics.size_distribution(truth(spark, sf_dir), "truth_id"))


@BOOK.add(
    f"""{_CLUSTERS}, s AS (SELECT count(*) AS size FROM clu GROUP BY cluster_id) SELECT count(*) AS n_total, count(*) FILTER (size > 1) AS n_multi,
count(*) FILTER (size = 1) AS n_singletons, min(size) AS min_size, max(size) AS max_size, round(avg(size), 3) AS mean_size, cast(median(size) AS DOUBLE) AS median_size FROM s"""
)
def size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.size_summary(clusters(spark, sf_dir), "cluster_id")


_SUMMARY = ("n_total", "n_multi", "n_singletons", "min_size", "max_size", "mean_size", "median_size")


def _summary_sql(source: str, by: str, name: str) -> str:
    return f"""{name}z AS (SELECT count(*) AS size FROM {source} GROUP BY {by}), {name}d AS (SELECT size, count(*) AS n FROM {name}z GROUP BY size),
{name} AS (SELECT count(*) AS {name}_n_total, count(*) FILTER (size > 1) AS {name}_n_multi, count(*) FILTER (size = 1) AS {name}_n_singletons, min(size) AS {name}_min_size, max(size) AS {name}_max_size,
    round(avg(size), 3) AS {name}_mean_size, cast(median(size) AS DOUBLE) AS {name}_median_size, (SELECT string_agg(size || ':' || n, ',' ORDER BY size) FROM {name}d) AS {name}_sizes FROM {name}z)"""


@BOOK.add(
    f"""{_CLUSTERS}, {_TRUTH}, {_summary_sql("clu", "cluster_id", "predicted")}, {_summary_sql("truth", "truth_id", "truth_")},
cp AS (SELECT x.ref_id AS a, y.ref_id AS b FROM clu x JOIN clu y ON x.cluster_id = y.cluster_id AND x.ref_id < y.ref_id),
tp AS (SELECT x.ref_id AS a, y.ref_id AS b FROM truth x JOIN truth y ON x.truth_id = y.truth_id AND x.ref_id < y.ref_id),
c AS (SELECT (SELECT count(*) FROM cp JOIN tp USING (a, b)) AS TP, (SELECT count(*) FROM tp) AS E, (SELECT count(*) FROM cp) AS L),
s AS (SELECT *, CASE WHEN L > 0 THEN TP / L ELSE 1.0 END AS p, CASE WHEN E > 0 THEN TP / E ELSE 1.0 END AS r FROM c),
dist AS (SELECT cast(sum(abs(coalesce(p.n, 0) - coalesce(t.n, 0))) AS BIGINT) AS size_distribution_l1, cast(sum(coalesce(p.n, 0) - coalesce(t.n, 0)) AS BIGINT) AS cluster_count_diff
    FROM predictedd p FULL JOIN truth_d t USING (size))
SELECT (SELECT count(*) FROM clu) AS n_records_total, (SELECT count(DISTINCT ref_id) FROM clu) AS n_unique_records, predicted.*, truth_.*,
    TP, E, L, L - TP AS FP, E - TP AS FN, {_SCORES}, size_distribution_l1, cluster_count_diff FROM predicted, truth_, s, dist"""
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.run_metrics(clusters(spark, sf_dir), truth(spark, sf_dir), {"tau": TAU, "weighting": "uniform"})

    def flat(nested: str, name: str) -> list[Column]:
        sizes = F.transform(F.map_entries(f"{nested}.size_distribution"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
        return [*[F.col(f"{nested}.{c}").alias(f"{name}_{c}") for c in _SUMMARY], F.array_join(sizes, ",").alias(f"{name}_sizes")]

    return found.select(
        "n_records_total", "n_unique_records", *flat("predicted_clusters", "predicted"), *flat("truth_clusters", "truth_"),
        "pair_metrics.*", "size_distribution_l1", "cluster_count_diff",
    )


@BOOK.add(
    f"""{_CLUSTERS}, g AS (SELECT cluster_id, count(*) AS size, list({{'id': clu.ref_id, 't': array_to_string(rec.tokens, ' ')}} ORDER BY clu.ref_id) AS rs
    FROM clu JOIN rec USING (ref_id) GROUP BY cluster_id HAVING count(*) > 1)
SELECT cluster_id, size, array_to_string(list_transform(rs, lambda r: r.id || ':' || r.t), '|') AS records FROM g"""
)
def cluster_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = layout.map_documents(clusters(spark, sf_dir), base.documents(spark, sf_dir), 2)
    line = F.transform("records", lambda r: F.concat(r["ref_id"].cast("string"), F.lit(":"), F.array_join(r["tokens"], " ")))
    return nested.select("cluster_id", "size", F.array_join(line, "|").alias("records"))


@BOOK.add(
    f"""{_CLUSTERS}, sz2 AS (SELECT cluster_id, count(*) AS size, 0.6 * sqrt(count(*) + 1) + 0.4 AS radius FROM clu GROUP BY cluster_id HAVING count(*) >= 2),
room AS (SELECT greatest(1, ceil(1.4 * sqrt(cast(sum(cast(round(pi() * radius * radius, 6) AS DECIMAL(30, 6))) AS DOUBLE)) * 1000000)) AS room FROM sz2),
strip AS (SELECT *, cast(round((2 * radius + 0.15) * 1000000) AS BIGINT) AS wide FROM sz2),
placed AS (SELECT *, coalesce(sum(wide) OVER (ORDER BY radius DESC, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM strip),
rws AS (SELECT *, floor(start / room) AS row, start - floor(start / room) * room AS x FROM placed, room),
tops AS (SELECT row, high, coalesce(sum(high) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM (SELECT row, max(wide) AS high FROM rws GROUP BY row)),
disc AS (SELECT cluster_id, size, radius, x / 1000000 + radius AS x, -(top + high / 2) / 1000000 AS y FROM rws JOIN tops USING (row)),
pts AS (SELECT ref_id, cluster_id, size, x, y, row_number() OVER (PARTITION BY cluster_id ORDER BY ref_id) - 1 AS i, greatest(radius - 0.25, radius * 0.7) AS inr FROM clu JOIN disc USING (cluster_id)),
an AS (SELECT *, inr * sqrt((i + 0.5) / size) AS r, 2 * pi() * i / power((1 + sqrt(5)) / 2, 2) AS t FROM pts)
SELECT ref_id, cluster_id, round(x + r * cos(t), 6) AS px, round(y + r * sin(t), 6) AS py FROM an"""
)
def cluster_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(spark, sf_dir)
    points = layout.record_points(found, layout.cluster_discs(found, 2))
    return points.select("ref_id", "cluster_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


#: Order lines stand in for a run table: flags are axes and quantities and prices are scores.
@BOOK.add(
    """WITH r AS (SELECT l_returnflag AS flag, l_linestatus AS status, cast(l_linenumber AS VARCHAR) AS line, l_quantity AS v FROM lineitem),
a AS (SELECT 'flag' AS axis, flag AS level, v FROM r UNION ALL SELECT 'status', status, v FROM r UNION ALL SELECT 'line', line, v FROM r)
SELECT axis, level, max(v) AS max, round(avg(v), 6) AS mean, median(v) AS median, count(*) AS n FROM a GROUP BY axis, level"""
)
def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), "l_quantity")
    return report.rollups(runs, ["flag", "status", "line"], "l_quantity").withColumn("mean", F.round("mean", 6))


@BOOK.add("SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem")
def report_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.correlation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("corr", 6).alias("corr"))


@BOOK.add(
    "SELECT count(*) FILTER (l_discount > l_tax) AS fn_dominant, count(*) FILTER (l_tax > l_discount) AS fp_dominant, count(*) FILTER (l_discount = 0) AS zero_f1 FROM lineitem"
)
def report_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.dominance(table(spark, sf_dir, "lineitem"), "l_tax", "l_discount", "l_discount")


@BOOK.add(
    """SELECT o_orderpriority, o_orderstatus, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS best, max(o_totalprice) AS best_value,
first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS worst, min(o_totalprice) AS worst_value FROM orders GROUP BY o_orderpriority, o_orderstatus"""
)
def report_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.extremes(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice", "o_orderkey")


@BOOK.add(f"{DOCUMENTS}, o AS (SELECT unnest(tokens) AS token FROM rec), f AS (SELECT token, count(*) AS freq FROM o GROUP BY token) SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) AS rank FROM f ORDER BY freq DESC, token LIMIT 20")
def report_top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.operators.tokens import term_frequency

    return report.top(term_frequency(base.documents(spark, sf_dir)), [F.col("freq").desc(), F.col("token")], 20)
