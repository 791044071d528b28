from __future__ import annotations

import numpy as np
import pytest

from weft.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_features_of_empty_text():
    assert len(Q.features(b"")) == len(Q.FEATURES) and np.isfinite(Q.features(b"")).all()
    assert np.isfinite(Q.features(b"x" * 1_000_000)).all()


def test_classifier_separates_held_out_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = sorted((r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect())
    x, y = np.array([Q.features(docs[d].encode()) for d, _ in labels]), np.array([q for _, q in labels])
    half = len(y) // 2
    p = Q.fit(x[:half], y[:half]).probability(x[half:])
    assert ((p >= 0.5) == y[half:]).mean() > 0.95


def brute(rows, prior):
    """Posteriors from (host, path, e) in plain Python."""
    out = []
    for k, (h, p, e) in enumerate(rows):
        hosts = [x[2] for j, x in enumerate(rows) if x[0] == h and j != k]
        paths = [x[2] for j, x in enumerate(rows) if x[:2] == (h, p) and j != k]
        host = (sum(hosts) / 1e6 + prior.host * prior.mean) / (len(hosts) + prior.host)
        path = (sum(paths) / 1e6 + prior.path * host) / (len(paths) + prior.path)
        clip = lambda v: min(max(v, 1e-6), 1 - 1e-6)
        z = np.log(clip(e / 1e6) / (1 - clip(e / 1e6))) + np.log(clip(path) / (1 - clip(path))) - np.log(prior.mean / (1 - prior.mean))
        out.append((host, path, 1 / (1 + np.exp(-z))))
    return out


@pytest.mark.parametrize("limit", [20_000, 0])
def test_posteriors_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(Q, "BROADCAST_SITES", limit)
    rng = np.random.default_rng(3)
    rows = [(None if k % 17 == 0 else f"h{k % 5}", None if k % 13 == 0 else f"p{k % 3}", int(rng.integers(1, 999_999))) for k in range(120)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, host string, path string, e long")
    stats, prior = Q.site_statistics(df.select("host", "path", "e"))
    assert prior.mean == pytest.approx(np.mean([r[2] for r in rows]) / 1e6)
    judged = Q.judge(df.select("k", *[Q.F.col(c).alias(f"__{c}") for c in ("host", "path", "e")]))
    got = {r["k"]: (r["__host_posterior"], r["__path_posterior"], r["__quality"]) for r in judged.collect()}
    for k, wanted in enumerate(brute(rows, prior)):
        assert got[k] == pytest.approx(wanted, abs=2e-6)


def test_sparse_sites_shrink():
    prior = Q.Prior(0.8, 10.0, 10.0)
    few = brute([("h", "p", 100_000)] * 2, prior)[0]
    many = brute([("h", "p", 100_000)] * 60, prior)[0]
    assert many[0] < few[0] < 0.8


def test_pseudo_count_falls_with_spread():
    assert Q._pseudo_count(0.8, 0.01, 0.01) == 10_000.0
    assert 1.0 <= Q._pseudo_count(0.8, 0.01, 0.1) < Q._pseudo_count(0.8, 0.01, 0.02)


def test_a_hot_host_does_not_drown_the_spread_between_hosts(spark):
    rng = np.random.default_rng(5)
    shares = {f"h{k}": rng.beta(4, 4) for k in range(40)}

    def prior(hot: int):
        rows = [(h, h, int(1e6 * (rng.random() < share))) for h, share in shares.items() for _ in range(hot if h == "h0" else 30)]
        return Q.site_statistics(spark.createDataFrame(rows, "host string, path string, e long"))[1]

    assert 0.4 < prior(3000).host / prior(30).host < 2.5


def test_training_is_bounded_by_ids_and_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "fit", lambda x, y: seen.append((len(x), y.tolist())))
    docs = spark.createDataFrame([(1, f"copy {k}") for k in range(300)] + [(2, "b"), (3, None), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (9, 1), (None, 1), (4, None)], "doc_id long, quality int")
    Q.train(docs, labels)
    assert seen == [(3, [1, 0, 1])]


def test_query_and_rejection(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in Q.assess(docs, labels).collect()}
    kept = Q.reject(docs, labels)
    assert len(rows) == 1000 and kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in rows.items() if r["keep"]}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [rows[d]["keep"] for d, q in truth.items() if q == 1]
    bad = [rows[d]["keep"] for d, q in truth.items() if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_defined_cases(spark):
    schema = "doc_id long, text string, lang string, source string, quality string, e string"
    docs = spark.createDataFrame([(1, None, None, None, "q", "e"), (2, "", "en", "s", "q", "e"), (2, "", "en", "s", "q", "e"), (None, "text", None, "s", "q", "e")], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = Q.assess(docs, none).collect()
    assert len(rows) == 4 and all(r["evidence"] == 0.5 and r["keep"] == 1 for r in rows)
    assert Q.reject(docs, none).columns == docs.columns
    assert Q.assess(docs.limit(0), none).count() == 0
