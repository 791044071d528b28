from __future__ import annotations

import pytest

from weft.__main__ import main


def test_commands(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    main(["sample", "--rows", "40", "--output", at("sample")], spark)
    sample = spark.read.option("header", True).csv(at("sample"))
    assert sample.count() == 40
    sample.select("RecID", "Name", "Address").coalesce(1).write.option("header", True).csv(at("people"))
    main(["blocks", "--input", at("people"), "--output", at("blocks"), "--max-depth", "2", "--stop-share", "0"], spark)
    assert {"block_id", "Name"} <= set(spark.read.option("header", True).csv(at("blocks")).columns)
    (tmp_path / "known.txt").write_text("birch\nivy\n")
    main(["blocks", "--input", at("people"), "--output", at("fixed"), "--max-depth", "1", "--global-correction", "--gc-min-freq-std", "3", "--word-list", at("known.txt"), "--jaccard", "--report"], spark)
    assert "similarity_scores" in spark.read.json(at("fixed.scores")).columns
    (tmp_path / "S1G.txt").write_text("id,body\n" + "\n".join(f"{r['RecID']},{r['Name']} {r['Address']}" for r in sample.collect()))
    (tmp_path / "truthABCgoodDQ.txt").write_text("id,truth\n" + "\n".join(f"{r['RecID']},{r['source_id']}" for r in sample.collect()))
    main(["clusters", "--input", at("S1G.txt"), "--truth-dir", str(tmp_path), "--output", at("clusters"), "--full-blocking", "--no-merge", "--max-recursion-depth", "1"], spark)
    assert spark.read.json(at("clusters")).selectExpr("sum(size)").first()[0] == 40
    assert 0 <= spark.read.json(at("clusters.metrics.json")).first()["pair_metrics"]["f1"] <= 1
    main(["signatures", "--input", at("S1G.txt"), "--method", "fuzzy", "--output", at("signatures")], spark)
    assert spark.read.option("header", True).csv(at("signatures")).count() == 40
    (tmp_path / "lines.csv").write_text("last_name: Lee; ssn: 1; record_id: a\nlast_name: Li; ssn: 1; record_id: b\n")
    main(["people", "--extract", "--input", at("lines.csv"), "--output", at("resolved")], spark)
    assert [r["cluster_id"] for r in spark.read.option("header", True).csv(at("resolved")).collect()] == ["0", "0"]
    with pytest.raises(SystemExit):
        main(["clusters", "--output", "x"], spark)
