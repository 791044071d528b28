from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weft.operators import minhash as M

WIDE = {"alpha": 2, "beta": 10, "max_depth": 2, "auto_stopword_top_percentile": 0.0, "max_keys_per_level": 100}


@pytest.fixture(scope="module")
def blocker(spark):
    return M.RecursiveMinHashBlocker(M.BlockerConfig(**WIDE)).fit(M.demo(spark))


def members(blocks):
    return [set(r["member_record_ids"]) for r in blocks.collect()]


def test_variants_of_a_person_share_a_block(blocker):
    found = members(blocker.blocks())
    assert any({1, 2, 3} <= b for b in found) and any({4, 5} <= b for b in found)


def test_no_signature_repeats_on_a_path_and_children_lie_in_parents(blocker):
    blocks = {r["block_id"]: r for r in blocker.blocks().collect()}
    for r in blocks.values():
        assert len(set(r["used_keys_path"])) == len(r["used_keys_path"]) == r["depth"] and r["blocking_key"] in r["used_keys_path"]
        assert (r["parent_block"] is None) == (r["depth"] == 1)
        if r["parent_block"] is not None:
            assert set(r["member_record_ids"]) <= set(blocks[r["parent_block"]]["member_record_ids"])
        assert r["size"] == len(r["member_record_ids"]) >= 2


def test_missing_columns(spark):
    with pytest.raises(KeyError):
        M.RecursiveMinHashBlocker().fit(spark.createDataFrame([(1, "a")], "Other int, Name string"))
    with pytest.raises(KeyError):
        M.RecursiveMinHashBlocker().fit(spark.createDataFrame([(1, "a")], "RecID int, Name string"))


def test_scores_export_and_metrics(blocker):
    scores = blocker.scores().collect()
    assert scores and all(0 <= r["score"] <= 1 and r["a"] < r["b"] for r in scores)
    export = blocker.export()
    assert {"Name", "Address", "block_id"} <= set(export.columns)
    assert export.count() == sum(len(b) for b in members(blocker.blocks()))
    nested = blocker.nested().where("size > 1").collect()
    assert len(nested) == len(members(blocker.blocks())) and all(r["similarity_scores"] for r in nested)
    row = blocker.metrics().first()
    assert row["total_records"] == 7 and row["num_blocks"] == len(members(blocker.blocks())) and row["max_depth_reached"] == 2
    assert M.report(blocker.blocks()).agg(F.sum("n")).first()[0] == row["num_blocks"]


def test_refitting_does_not_accumulate(spark):
    again = M.RecursiveMinHashBlocker(M.BlockerConfig(**WIDE))
    first = members(again.fit(M.demo(spark)).blocks())
    assert members(again.fit(M.demo(spark)).blocks()) == first


def test_stop_signatures(spark):
    records = M.tokenize(M.demo(spark), M.BlockerConfig())
    keys = M.token_keys(records, 2)
    sigs = M.record_signatures(records, keys)
    frequent = M.stop_signatures(sigs, keys, 0.005)
    assert frequent.count() == 1
    both = M.stop_signatures(sigs, keys, 0.005, ("LEE", "absent"))
    lee = keys.where("token = 'lee'").first()["sig"]
    assert both.count() == 2 and lee in {r["sig"] for r in both.collect()}
    assert M.stop_signatures(sigs, keys, 0.0).count() == 0


def test_depth_zero_and_rarest_keys(spark):
    assert M.RecursiveMinHashBlocker(M.BlockerConfig(**{**WIDE, "max_depth": 0})).fit(M.demo(spark)).blocks().count() == 0
    few = M.RecursiveMinHashBlocker(M.BlockerConfig(**{**WIDE, "max_keys_per_level": 1, "max_depth": 1})).fit(M.demo(spark))
    assert few.blocks().count() == 1


def test_correction_runs_before_hashing(spark):
    rows = [(k, "SMITH", "x") for k in range(12)] + [(50, "SMYTH", "y"), (51, "JONES", "z"), (52, "JONES", "z")]
    df = spark.createDataFrame(rows, "RecID int, Name string, Address string")
    config = M.BlockerConfig(**{**WIDE, "beta": 100, "run_global_correction": True})
    tokens = {r["ref_id"]: r["tokens"] for r in M.RecursiveMinHashBlocker(config).fit(df).records.collect()}
    assert tokens[50] == ["smith", "y"]
