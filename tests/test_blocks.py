from __future__ import annotations

import random
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weft.operators import blocks as B
from weft.operators import correct, graph, layout, merge, metrics, partition, refine, seeds, signature, tokens, trie
from weft.operators.components import connected_components
from weft.plans import flagship, pii, signatures
from weft.session import cut, one_row
from weft.sources.files import sample_records

REC = "ref_id long, tokens array<string>"


def naive_records(seed: int, n: int = 14, vocabulary: int = 9) -> list[tuple]:
    rng = random.Random(seed)
    return [(k, rng.sample([f"TOK{v}" for v in range(vocabulary)], rng.randrange(0, 5))) for k in range(n)]


def as_sets(df) -> dict:
    out: dict = {}
    for r in df.collect():
        out.setdefault(tuple(r["key"]), set()).add(r["ref_id"])
    return out


def naive_refine(blocks: dict, records: dict, floor: int) -> dict:
    new: dict = {}
    for key, refs in blocks.items():
        for token in {t for r in refs for t in records[r]} - set(key):
            members = {r for r in refs if token in records[r]}
            if len(members) >= floor:
                new[tuple(sorted({*key, token}))] = members
    return new


def naive_seeds(rows: list[tuple]) -> dict:
    counts: dict = {}
    for ref, ts in rows:
        for t in ts:
            counts.setdefault((t,), set()).add(ref)
    return {k: v for k, v in counts.items() if len(v) >= 2}


@pytest.mark.parametrize("seed", range(4))
def test_recursion_equals_the_plain_loop(spark, seed):
    rows = naive_records(seed)
    records, df = {r: set(t) for r, t in rows}, spark.createDataFrame(rows, REC)
    start = naive_seeds(rows)
    plain = dict(start)
    for depth in range(1, 4):
        new = naive_refine(plain, records, max(depth, 2))
        if not new:
            break
        plain = {**plain, **new}
    got = seeds.seed_blocks(df, tokens.term_frequency(df), full=True)
    assert as_sets(got) == start
    assert as_sets(refine.recursive_blocking(got, df, 3, 2, False, False).blocks) == plain
    merged = refine.recursive_blocking(got, df, 3, 2, True, False)
    assert {frozenset(v) for v in as_sets(merged.blocks).values()} == {frozenset(v) for v in plain.values()}
    maximal = {frozenset(v) for v in start.values() if not any(v < o for o in start.values())}
    for merge_too in (True, False):
        purged = refine.recursive_blocking(got, df, 3, 2, merge_too, True)
        assert {frozenset(v) for v in as_sets(purged.blocks).values()} == maximal
    assert {frozenset(v) for v in as_sets(refine.purged_recursion(got, df, 3)).values()} == maximal


def test_refinement_example(spark):
    df = spark.createDataFrame([(1, ["A", "B", "C"]), (2, ["A", "B", "C"]), (3, ["A", "B"]), (4, ["A", "D"])], REC)
    got = seeds.seed_blocks(df, tokens.term_frequency(df), full=True)
    assert as_sets(got) == {("A",): {1, 2, 3, 4}, ("B",): {1, 2, 3}, ("C",): {1, 2}}
    one = as_sets(refine.refine_blocks(got, df, 2))
    assert one == {("A", "B"): {1, 2, 3}, ("A", "C"): {1, 2}, ("B", "C"): {1, 2}}
    merged = as_sets(B.merge_identical(B.union_blocks(got, refine.refine_blocks(got, df, 2))))
    assert merged == {("A",): {1, 2, 3, 4}, ("A", "B"): {1, 2, 3}, ("A", "B", "C"): {1, 2}}
    assert as_sets(refine.recursive_blocking(got, df, 1).blocks) == {("A",): {1, 2, 3, 4}}
    peak = refine.recursive_blocking(got, df, 0)
    assert peak.peak_depth == 0 and peak.peak_size == 3


def test_term_frequency_can_make_a_block_of_one(spark):
    df = spark.createDataFrame([(1, ["AAAA", "AAAA"]), (2, ["BBBB"])], REC)
    assert as_sets(seeds.seed_blocks(df, tokens.frequencies(df, "tf"), 5)) == {("AAAA",): {1}}
    assert as_sets(seeds.seed_blocks(df, tokens.frequencies(df, "df"), 5)) == {}


def naive_tree(rows: list[tuple]) -> dict:
    records = {r: set(t) for r, t in rows}
    freq: dict = {}
    for _, ts in rows:
        for t in ts:
            freq[t] = freq.get(t, 0) + 1
    every, frontier = {(): set(records)}, {(): set(records)}
    for token in sorted(freq, key=lambda t: (-freq[t], t)):
        new = {}
        for key, refs in frontier.items():
            have = {r for r in refs if token in records[r]}
            if len(refs) <= 1 or not have or have == refs:
                new[key] = refs
                continue
            for step, half in ((1, have), (0, refs - have)):
                new[(*key, (token, step))] = every[(*key, (token, step))] = half
        frontier = new
    return every


@pytest.mark.parametrize(("seed", "size", "rounds"), [(1, 100, 9), (2, 6, 9), (3, 1, 3), (4, 1, 30), (5, 3, 0)])
def test_hierarchical_tree_equals_the_plain_loop(spark, seed, size, rounds):
    rows = naive_records(seed, 16, 8)
    df = spark.createDataFrame(rows, REC)
    got: dict = {}
    for r in trie.hierarchical_blocks(df, tokens.term_frequency(df), size, rounds).collect():
        got.setdefault(tuple((s["token"], s["present"]) for s in r["path"]), set()).add(r["ref_id"])
    assert got == naive_tree(rows)


def test_partition_keeps_every_record_once(spark):
    for seed in range(3):
        rows = naive_records(seed, 30, 7)
        df = spark.createDataFrame(rows, REC)
        parts = partition.iterative_partition(df, tokens.term_frequency(df), 4).collect()
        assert sorted(r["ref_id"] for r in parts) == [r for r, _ in rows]
    lone = spark.createDataFrame([(1, []), (2, ["A"])], REC)
    keys = {r["ref_id"]: r["key"] for r in partition.initial_partition(lone, tokens.term_frequency(lone)).collect()}
    assert keys == {1: ["UNIQUE_1"], 2: ["UNIQUE_2"]}


def test_partitions_broadcast_nothing_by_estimate(spark, tmp_path, monkeypatch):
    """Compressed files of records look small enough to broadcast, however many tokens come of them."""
    spark.createDataFrame(naive_records(3, 40), REC).write.parquet(str(tmp_path / "records"))
    plans, cut = [], partition.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(partition, "cut", seen)
    df = spark.read.parquet(str(tmp_path / "records"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert partition.iterative_partition(df, tokens.term_frequency(df), 4).count() == 40
    assert len(plans) > 1 and not any("BroadcastHashJoin" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_checkpoints_and_components_leave_no_shuffle_files(spark):
    """Else rounds pile up: every shuffle has three small files for each writing task until the driver collects its garbage."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()

    def shuffles() -> set[str]:
        return {name for name in blocks.diskBlockManager().getAllFiles().mkString("\n").splitlines() if "shuffle_" in name}

    spark.sparkContext._jvm.System.gc()
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(5, "a")
    before = shuffles()
    roots = cut(connected_components(edges))
    for _ in range(50):  # files go shortly after
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert roots.where("root = 0").count() == 301


def test_rounds_of_one_row_cost_the_driver_no_threads(spark):
    """Each shuffle of an adaptive plan starts a thread that idles for a minute; solvers ask for one row after another."""
    threads = spark.sparkContext._jvm.java.lang.Thread

    def idle() -> set[str]:
        return {t for t in threads.getAllStackTraces().keySet().toString().split("Thread[") if t.startswith("shuffle-exchange")}

    rows, before = cut(spark.range(50).repartition(3)), idle()
    assert [one_row(rows.agg(F.sum(F.col("id") * k)))[0] for k in range(5)] == [1225 * k for k in range(5)]
    assert not idle() - before and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_colliding_partition_keys_unite(spark):
    blocks = spark.createDataFrame([(["A"], 1), (["A"], 2), (["B"], 3), (["B"], 4)], "key array<string>, ref_id long")
    df = spark.createDataFrame([(1, ["A", "B"]), (2, ["A", "B"]), (3, ["A", "B"]), (4, ["A", "B"])], REC)
    assert as_sets(partition.refine_partition(blocks, df, 2)) == {("A", "B"): {1, 2, 3, 4}}


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((40, 30), (60, 200), (50, 49)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 49 else [(k, k + 1) for k in range(49)]
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
        assert got == {x: find(x) for e in edges for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merging_is_connected_components(spark):
    blocks = spark.createDataFrame([(["A"], 1), (["A"], 2), (["B"], 2), (["B"], 3), (["C"], 9), (["A", "D"], 9)], "key array<string>, ref_id long")
    assert as_sets(merge.merge_sharing_records(blocks)) == {("A", "B"): {1, 2, 3}, ("A", "C", "D"): {9}}
    assert as_sets(merge.merge_sharing_key_tokens(blocks)) == {("A",): {1, 2, 9}, ("B",): {2, 3}, ("C",): {9}}


def test_combinations(spark):
    df = spark.createDataFrame([(1, ["D", "A", "C", "A"]), (2, ["A"]), (3, [])], REC)
    valid = spark.createDataFrame([("A",), ("C",), ("D",)], "token string")
    for k in (1, 2, 3, 4):
        wanted = {c: {1} for c in combinations("ACD", k)}
        if k == 1:
            wanted[("A",)] = {1, 2}
        assert as_sets(merge.combination_blocks(df, valid, k)) == wanted
    stages = merge.iterative_combinations(spark.createDataFrame([(k, ["X", "X", "X", f"t{k}"]) for k in range(4)], REC), 2, False)
    assert as_sets(stages[0]) == {("X",): {"0", "1", "2", "3"}} and as_sets(stages[1]) == {}


def test_top_k_needs_a_weight(spark):
    blocks = spark.createDataFrame([(["A"], 1)], "key array<string>, ref_id long")
    for bad in ("composite", "nonsense"):
        with pytest.raises(ValueError):
            B.top_k(blocks, mode=bad)


def naive_split(cluster: set, edges: list, floor: float, least: int) -> list[set]:
    n = len(cluster)
    if n < least or not edges or len(edges) / (n * (n - 1) // 2) >= floor:
        return [cluster]
    edges = sorted(edges)
    for i in range(len(edges)):
        rest = edges[i + 1 :]
        parts = graph._parts(cluster, rest)
        if len(parts) > 1:
            return [p for part in parts for p in naive_split(part, [e for e in rest if e[1] in part and e[2] in part], floor, least)]
    return [cluster]


@pytest.mark.parametrize("seed", range(5))
def test_density_split_equals_edge_by_edge_removal(spark, seed):
    rng = random.Random(seed)
    edges = [(round(rng.random(), 2), a, b) for a, b in combinations(range(9), 2) if rng.random() < 0.4 or b == a + 1]
    got: dict = {}
    clusters = spark.createDataFrame([(k, 0) for k in range(9)] + [(50, 50)], "ref_id long, root long")
    for r in graph.split_by_density(clusters, spark.createDataFrame(edges, "w double, a long, b long"), 0.6).collect():
        got.setdefault(r["root"], set()).add(r["ref_id"])
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in naive_split(set(range(9)), edges, 0.6, 3)} | {frozenset([50])}


def test_metrics_conventions(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (9, "a")], "ref_id long, truth_id string")
    universe = spark.createDataFrame([(1,), (2,), (3,)], "ref_id long")
    none = spark.createDataFrame([], "a long, b long")
    row = metrics.pair_metrics(none, truth, universe).first()
    assert (row["E"], row["L"], row["precision"], row["recall"], row["f1"]) == (1, 0, 1.0, 0.0, 0.0)
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert tuple(metrics.pair_metrics(pairs, truth, universe).first())[:5] == (1, 1, 2, 1, 0)
    single = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "ref_id long, cluster_id long")
    assert tuple(metrics.cluster_metrics(single, truth, universe).first()) == (1, 1, 1, 0, 0, 1.0, 1.0, 1.0)
    assert metrics.pair_metrics(none, truth.limit(0)).first()["recall"] == 1.0
    summary = metrics.size_summary(single, "cluster_id").first()
    assert (summary["n_total"], summary["n_multi"], summary["mean_size"], summary["median_size"]) == (2, 1, 1.5, 1.5)


def test_correction(spark):
    freq = {"SMITH": 20, "JONES": 12, "SMYTH": 2, "SIMTH": 1, "SMITHS": 3, "JONE": 1, "JONS3": 1, "RARE": 2, "AB": 1, "MITH": 4, "SMUTH": 1}
    df = spark.createDataFrame(list(freq.items()), "token string, freq long")
    got = dict(map(tuple, correct.correction_map(df).collect()))
    assert got == {"SMYTH": "SMITH", "SIMTH": "SMITH", "SMITHS": "SMITH", "JONE": "JONES", "SMUTH": "SMITH"}
    words = spark.createDataFrame([("SMYTH",)], "word string")
    mapping = correct.correction_map(df, words)
    assert "SMYTH" not in dict(map(tuple, mapping.collect()))
    records = spark.createDataFrame([(1, ["SIMTH", "X", "SIMTH"]), (2, [])], REC)
    assert {r["ref_id"]: r["tokens"] for r in correct.apply_corrections(records, mapping).collect()} == {1: ["SMITH", "X", "SMITH"], 2: []}


@pytest.mark.parametrize("held", [True, False])
def test_rows_of_equal_and_null_ids_stay_apart(spark, held, monkeypatch):
    if not held:
        monkeypatch.setattr("weft.operators.lists.HELD_ROWS", -1)
    rows = [(1, ["A", "B"]), (1, ["C", "D", "A"]), (1, ["A", "B"]), (None, ["E"]), (None, ["F", None, "A"]), (2, []), (3, None), (4, ["A"])]
    records = spark.createDataFrame(rows, REC).repartition(3)
    gone = spark.createDataFrame([("A",), ("X",)], "token string")
    got = sorted((r["ref_id"] or 0, r["tokens"]) for r in tokens.remove_tokens(records, gone).collect())
    assert got == [(0, ["E"]), (0, ["F"]), (1, ["B"]), (1, ["B"]), (1, ["C", "D"]), (2, []), (3, []), (4, [])]
    mapping = spark.createDataFrame([("A", "Z"), ("D", "E")], "token string, standard string")
    got = sorted((r["ref_id"] or 0, r["tokens"]) for r in correct.apply_corrections(records, mapping).collect())
    assert got == [(0, ["E"]), (0, ["F", "Z"]), (1, ["C", "E", "Z"]), (1, ["Z", "B"]), (1, ["Z", "B"]), (2, []), (3, []), (4, ["Z"])]
    assert tokens.remove_tokens(records.limit(0), gone).count() == 0
    assert tokens.remove_tokens(records, gone.limit(0)).count() == 8


def test_sampled_pairs(spark):
    blocks = spark.createDataFrame([([k], r) for k, n in (("A", 30), ("B", 3), ("C", 1)) for r in range(n)], "key array<string>, ref_id long")
    got: dict = {}
    for r in graph.sampled_pairs(blocks, 40).collect():
        assert r["a"] < r["b"]
        got.setdefault(r["key"][0], []).append((r["a"], r["b"]))
    assert len(got["A"]) == len(set(got["A"])) == 40 and sorted(got["B"]) == [(0, 1), (0, 2), (1, 2)] and "C" not in got
    assert len({x for p in got["A"] for x in p}) > 20


def naive_purge(blocks: dict) -> dict:
    first: dict = {}
    for key in sorted(blocks, key=lambda k: (len(k), k)):
        first.setdefault(frozenset(blocks[key]), key)
    return {key: set(members) for members, key in first.items() if not any(members < other for other in first)}


@pytest.mark.parametrize("seed", range(3))
def test_purge_equals_the_plain_loop(spark, seed):
    rng = random.Random(seed)
    blocks = {(f"K{k}",): set(rng.sample(range(400), rng.choice((1, 2, 3, 8, 200)))) for k in range(120)}
    blocks |= {(f"S{k}",): set(rng.sample(sorted(rng.choice([b for b in blocks.values() if len(b) > 3])), 3)) for k in range(40)}
    df = spark.createDataFrame([(list(k), r) for k, rs in blocks.items() for r in rs], "key array<string>, ref_id long")
    assert as_sets(B.purge_subsets(df)) == naive_purge(blocks)


def test_signature_blocks(spark):
    sigs = spark.createDataFrame([(1, ["A", "B", "C"]), (2, ["A", "B", "C"]), (3, ["A", "D"]), (4, []), (5, [])], "ref_id long, sigs array<string>")
    blocks = signature.exact_blocks(sigs)
    assert as_sets(blocks) == {("A", "B", "C"): {1, 2}, ("A", "D"): {3}, (): {4, 5}}
    assert sorted(map(tuple, B.candidate_pairs(blocks).collect())) == [(1, 2), (4, 5)]
    near = as_sets(signature.lsh_blocks(sigs, 0.9))
    assert near == {("1", "2"): {1, 2}, ("3",): {3}}
    one = spark.createDataFrame([(["K"], k) for k in range(1, 6)], "key array<string>, ref_id long")
    leaves: dict = {}
    for r in signature.split_blocks(one, sigs, 3, 2).collect():
        leaves.setdefault(tuple(r["label"]), set()).add(r["ref_id"])
    assert leaves == {("K", "+A", "+B"): {1, 2}, ("K", "+A", "-B"): {3}, ("K", "-A"): {4, 5}}
    tied = spark.createDataFrame([(["K"], 1), (["K", "+A"], 2)], "key array<string>, ref_id long")
    assert signature.split_blocks(tied, sigs.limit(0), 3, 2).count() == 2


def test_variation_methods(spark):
    words = spark.createDataFrame([("SMITH",), ("SMYTH",), ("SMITHY",), ("JONES",)], "token string")
    fuzzy = {(r["token"], r["variant"]) for r in signature.variations(words, "fuzzy", 80).collect()}
    assert ("SMITH", "SMYTH") in fuzzy and ("SMYTH", "SMITH") in fuzzy and ("SMITH", "SMITHY") in fuzzy and ("JONES", "SMITH") not in fuzzy
    sound = {(r["token"], r["variant"]) for r in signature.variations(words, "phonetic").collect()}
    assert ("SMITH", "SMYTH") in sound and ("JONES", "JONES") in sound
    mapping = spark.createDataFrame([("JONES", "JONS")], "token string, variant string")
    assert ("JONES", "JONS") in {(r["token"], r["variant"]) for r in signature.variations(words, "manual", mapping=mapping).collect()}
    low = spark.createDataFrame([("going",), ("GOIN",), ("x",)], "token string")
    assert ("going", "GOIN") in {(r["token"], r["variant"]) for r in signature.variations(low, "data_quality", rules=["ortho_informal"]).collect()}
    with pytest.raises(ValueError):
        signature.variations(words, "other")


@pytest.mark.parametrize("threshold", [95, 85, 70, 40, 0])
def test_fuzzy_join_loses_no_pair(spark, threshold):
    rng = random.Random(threshold)
    words = sorted({"".join(rng.choice("AB") for _ in range(rng.randrange(1, 16))) for _ in range(120)})

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    wanted = {
        (a, b) for a in words for b in words
        if a == b or a[0] == b[0] and abs(len(a) - len(b)) <= 2 and round(100 * (1 - distance(a, b) / max(len(a), len(b)))) >= threshold
    }
    found = signature.fuzzy_variations(spark.createDataFrame([(w,) for w in words], "token string"), threshold)
    assert {tuple(r) for r in found.collect()} == wanted


def test_lsh_blocks_find_near_sets_and_verify_them(spark):
    """Recall against all pairs, and no pair below the threshold."""
    rng = random.Random(17)
    rows = []
    for k in range(60):
        base = rng.sample(range(5000), 20)
        rows += [(3 * k, base), (3 * k + 1, base[:-2] + [9000 + k, 9100 + k]), (3 * k + 2, base[:12] + rng.sample(range(5000, 8000), 8))]
    rows = [(r, [f"S{x}" for x in sorted(set(xs))]) for r, xs in rows]
    sets = {str(r): set(xs) for r, xs in rows}
    got = {(str(r["ref_id"]), o) for r in signature.lsh_blocks(spark.createDataFrame(rows, "ref_id long, sigs array<string>"), 0.6).collect() for o in r["key"]}
    want = {(a, b) for a in sets for b in sets if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert got <= want and len(got) / len(want) >= 0.9 and {(r, r) for r in sets} <= got


def test_discs_lie_in_rows_without_overlap(spark):
    rng = random.Random(18)
    clusters = spark.createDataFrame([(k, c) for c in range(40) for k in range(rng.randrange(1, 30))], "ref_id long, cluster_id long")
    discs = layout.cluster_discs(clusters).collect()
    sizes = {r["cluster_id"]: r["count"] for r in clusters.groupBy("cluster_id").count().collect()}
    assert {r["cluster_id"]: r["size"] for r in discs} == {c: n for c, n in sizes.items() if n > 1}
    for a, b in combinations(discs, 2):
        assert (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 >= (a["radius"] + b["radius"]) ** 2 - 1e-6
    wide, high = max(r["x"] + r["radius"] for r in discs), -min(r["y"] - r["radius"] for r in discs)
    assert 0.4 < wide / high < 2.5
    points = layout.record_points(clusters, layout.cluster_discs(clusters)).collect()
    by = {r["cluster_id"]: r for r in discs}
    assert all((p["px"] - by[p["cluster_id"]]["x"]) ** 2 + (p["py"] - by[p["cluster_id"]]["y"]) ** 2 <= by[p["cluster_id"]]["radius"] ** 2 for p in points)
    assert layout.cluster_discs(clusters.limit(0)).count() == 0
    assert [layout.color_for_size(n, 9) for n in (1, 5, 9)] == ["#440154", "#21918c", "#fde725"]


def test_flagship_run(spark):
    raw = sample_records(spark, 60)
    records = raw.select(F.col("RecID").alias("ref_id"), F.split(F.upper(F.concat_ws(" ", "Name", "Address")), " ").alias("tokens"))
    truth = raw.select(F.col("RecID").alias("ref_id"), F.col("source_id").cast("string").alias("truth_id"))
    prepared = flagship.prepare(records)
    runs = list(flagship.ablation(prepared, flagship.Config(max_depth=2, full=True, density_floor=0.3)))
    assert len(runs) == 4 and all(run.clusters.count() == 60 for run in runs)
    row = runs[0].metrics(truth).first()
    assert row["n_records_total"] == 60 and 0 <= row["pair_metrics"]["f1"] <= 1 and row["timings_seconds"]["filter"] >= 0
    tree = next(flagship.ablation(prepared, flagship.Config(hierarchical=True)))
    assert tree.clusters.select("ref_id").distinct().count() == 60
    with pytest.raises(ValueError):
        flagship.Config(full=True, hierarchical=True)
    assert flagship.legacy(flagship.Config(), 4).max_depth == 4 and flagship.legacy(flagship.Config(), records=records, factor=0.6).init_df_max == 3
    assert len(flagship.grid()) == 47


def test_signature_and_record_workflows(spark):
    raw = sample_records(spark, 40)
    records = raw.select(F.col("RecID").alias("ref_id"), F.split(F.upper(F.concat_ws(" ", "Name", "Address")), " ").alias("tokens"))
    exact = signatures.run(records, method="fuzzy")
    assert exact.blocks.count() == 40 == exact.leaves.count()
    near = signatures.run(records, method="fuzzy", use_lsh=True)
    assert near.leaves.count() == near.blocks.count() and set(near.timings) == {"phase_0", "phase_1", "phase_2", "phase_3"}
    lines = ["record_id: 1; last_name: Lee; ssn: 490-46-2048", "record_id: 2; last_name: Li; ssn: 490462048", "record_id: 3; last_name: Ray; phone: 5015551234"]
    got = {r["record_id"]: r["cluster_id"] for r in pii.resolve(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {"1": 0, "2": 0, "3": 1}
