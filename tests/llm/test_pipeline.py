from __future__ import annotations

import corpus_pipeline as P

SF = "/root/testdata/sf0.01"


def test_stages_keep_their_contracts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    assert [name for name, _ in P.STAGES] == ["toxicity", "quality", "simhash near-dedup", "mixing", "bpe"]
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
            docs = P.cut(out)
            counts.append(docs.count())
        else:
            rows = out.collect()
            assert len(rows) == counts[-1] and all(r["round_trip"] for r in rows)
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0


def test_near_copies_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = P.cut(P.drop_poor(spark, P.cut(P.drop_toxic(spark, docs, SF)), SF))
    ids = {r["doc_id"] for r in kept.collect()}
    clean = [d for d, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(d in ids for d in clean) / len(clean) > 0.97
    single = P.drop_near_duplicates(spark, kept, SF).collect()
    assert len({r["text"] for r in single}) == len(single)


def test_stages_take_odd_rows(spark):
    """Nulls in any column, repeated rows and ids, empty and very long texts, clashing extra columns, an empty table."""
    text = "a plain sentence of several words that repeats nothing and offends nobody at all"
    rows = [
        (1, text, "en", "s", 1, "x"), (1, text, "en", "s", 1, "x"), (1, text + " once more", None, None, None, None), (None, text + " null", "en", "s", 1, "x"),
        (None, None, None, None, None, None), (3, None, "en", "s", 1, "x"), (4, "", "en", "s", 1, "x"), (5, "word and another, " * 20_000, "en", "s", 1, "x"), (6, text.upper(), "zz", "s", 1, "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in P.STAGES[:-1]:
            out = P.cut(stage(spark, docs, SF))
            assert out.columns == docs.columns
            docs = out
        assert all(r["round_trip"] for r in P.STAGES[-1][1](spark, docs, SF).collect())
    deduplicated = P.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sum(r["text"] in (None, "") for r in deduplicated) == 1 and sum(r["text"] is not None and r["text"].lower() == text for r in deduplicated) == 1
