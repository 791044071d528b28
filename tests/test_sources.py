from __future__ import annotations

import json

from weft.operators import report
from weft.sources import files as S


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_records(spark, tmp_path):
    path = write(tmp_path / "S1G.txt", "RecID,fname,lname\nA1,John,O'BRIEN,12 Main\n\nno delimiter here\nA2,Ann  Lee,,490-46-2048\nA1,Jane,Doe\n A3 , x \n")
    got = {r["ref_id"]: r["tokens"] for r in S.read_records(spark, path).collect()}
    assert got == {"A1": ["JANE", "DOE"], "A2": ["ANN", "LEE", "490462048"], "A3": ["X"]}
    assert [r["ref_id"] for r in S.read_records(spark, path).orderBy("seq").collect()] == ["A1", "A2", "A3"]


def test_folders_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "b.txt", "id,NAME\n2,late\n4,four\n")
    write(folder / "a.txt", "id,NAME\n1,one\n2,early\n")
    write(folder / "c.txt", "id,NAME\n1,uno\n")
    rows = S.read_records(spark, str(folder)).orderBy("seq").collect()
    assert [(r["ref_id"], r["tokens"]) for r in rows] == [("1", ["UNO"]), ("2", ["LATE"]), ("4", ["FOUR"])]
    assert dict(map(tuple, S.read_truth(spark, str(folder)).collect())) == {"1": "uno", "2": "late", "4": "four"}
    long = write(tmp_path / "long.txt", "id,NAME\n" + "".join(f"{k % 50},v{k}\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")  # many splits, dealt to tasks by size
    try:
        got = dict(map(tuple, S.read_truth(spark, long).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {str(k): f"v{4950 + k}" for k in range(50)}


def test_table_records_with_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b", 2), (1, "c", 1), (None, "e", 1), (None, None, 2)], "id long, body string, at long")
    assert sorted(r["tokens"] for r in S.table_records(df, "id", "body").collect()) == [[], ["A", "B"], ["C"], ["E"]]
    last = {r["ref_id"]: r["tokens"] for r in S.table_records(df, "id", "body", last_by="at").collect()}
    assert last == {1: ["A", "B"], None: []}


def test_read_truth_words_and_tables(spark, tmp_path):
    truth = write(tmp_path / "truth.csv", "RecID,TruthID\n1,a\n2\n3, b \n\n1,c\n")
    assert sorted(map(tuple, S.read_truth(spark, truth).collect())) == [("1", "c"), ("3", "b")]
    words = write(tmp_path / "words.txt", "one\n\n two \none\n")
    assert sorted(r[0] for r in S.read_words(spark, words).collect()) == ["one", "two"]
    table = write(tmp_path / "t.csv", 'RecID,Name\n1,"Lee, Ann"\n2,Bo\n')
    assert [tuple(r) for r in S.read_table(spark, table, "RecID int, Name string").collect()] == [(1, "Lee, Ann"), (2, "Bo")]
    assert S.read_table(spark, table).columns == ["RecID", "Name"]
    assert [r[0] for r in S.read_first_column(spark, write(tmp_path / "r.csv", "raw one,x\nraw two\n")).collect()] == ["raw one", "raw two"]


def test_load_dict_parses_and_never_evaluates(spark, tmp_path):
    path = write(tmp_path / "d.txt", "{'r1': ['A', \"B\"], 'r2': []}")
    assert [(r["ref_id"], r["tokens"]) for r in S.load_dict(spark, path).orderBy("seq").collect()] == [("r1", ["A", "B"]), ("r2", [])]


def test_names():
    assert S.truth_file("data/S12PX.txt", "t") == "t/truthABCpoorDQ.txt"
    assert S.truth_file("S1G.txt", "t") == "t/truthABCgoodDQ.txt"
    assert S.truth_file("SAMPLE.txt", "t") == "t/truthABCpoorDQ.txt" and S.truth_file("S1.txt", "t") is None
    assert S.config_suffix(True, False) == "_m1_p0"
    assert report.slug("tau=0.2 / x") == "tau=0.2___x" and report.number(None) == "-" == report.number(float("nan")) and report.number(0.5) == "0.5000"
    assert report.markdown([{"a": 1, "b": 0.25}]).splitlines()[2] == "| 1 | 0.2500 |" and report.markdown([]).startswith("(no")


def test_sample_records_are_reproducible(spark):
    a = S.sample_records(spark, 200).orderBy("RecID").collect()
    assert a == S.sample_records(spark, 200).repartition(3).orderBy("RecID").collect()
    assert len(a) == 200 and all(r["source_id"] == r["RecID"] for r in a[:140])
    noisy = [(r, a[r["source_id"] - 1]) for r in a[140:]]
    assert all(r["source_id"] <= 140 and (r["Name"], r["Address"]) != (s["Name"], s["Address"]) or r["Name"] for r, s in noisy)
    assert sum((r["Name"], r["Address"]) != (s["Name"], s["Address"]) for r, s in noisy) > 50


def test_writers(spark, tmp_path):
    clusters = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "ref_id long, cluster_id long")
    records = spark.createDataFrame([(1, ["A"]), (2, ["B"]), (3, ["C"])], "ref_id long, tokens array<string>")
    S.write_clusters(clusters, records, str(tmp_path / "c"), include_singletons=False)
    (row,) = [json.loads(line) for f in (tmp_path / "c").glob("part-*") for line in f.read_text().splitlines()]
    assert row == {"cluster_id": 0, "size": 2, "records": [{"ref_id": 1, "tokens": ["A"]}, {"ref_id": 2, "tokens": ["B"]}]}
    S.write_metrics(spark.createDataFrame([(0.5, 3)], "f1 double, TP long"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m.metrics.json")).first()["TP"] == 3
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "m.metrics.log")).collect())[0].startswith("TP:")
    blocks = spark.createDataFrame([(["A", "B"], 1)], "key array<string>, ref_id long")
    S.write_csv(S.flat_blocks(blocks, records), str(tmp_path / "b"))
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).first()["label"] == "A B"


def test_collect_runs(spark, tmp_path):
    for group, name, f1 in (("A", "default", "0.5"), ("A", "other", None), ("B", "x", "bad")):
        (tmp_path / group / name).mkdir(parents=True)
        (tmp_path / group / name / "invocation.json").write_text(json.dumps({"command": f"run {name}"}))
        if f1:
            (tmp_path / group / name / "clusters_m0_p1.metrics.json").write_text(json.dumps({"pair_metrics": {"f1": float(f1)}}) if f1 != "bad" else "{")
    rows = {(r["group"], r["config_id"]): r for r in S.collect_runs(spark, str(tmp_path), {"F1": "pair_metrics.f1"}).collect()}
    assert {k: (r["command"], r["F1"], r["error"]) for k, r in rows.items()} == {
        ("A", "default"): ("run default", "0.5", None), ("A", "other"): ("run other", None, "missing"), ("B", "x"): ("run x", None, "unreadable"),
    }


def test_read_runs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"config": {"tau": 0.2}, "pair_metrics": {"f1": 0.5}}, indent=1))
    (tmp_path / "b.json").write_text("not json")
    (tmp_path / "c.json").write_text(json.dumps({"config": {}}))
    rows = S.read_runs(spark, str(tmp_path), {"tau": "config.tau", "F1": "pair_metrics.f1"}).orderBy("file").collect()
    assert [(r["tau"], r["F1"], r["error"]) for r in rows] == [("0.2", "0.5", None), (None, None, "unreadable"), (None, None, None)]
