from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import toxicity as T
from weft.llm.queries import op7_toxicity

SF = "/root/testdata/sf0.01"


def corpus(n: int, seed: int) -> tuple[list[bytes], np.ndarray]:
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(300)]
    texts, labels = [], []
    for k in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(1, 80))]
        if k % 3 == 0:
            body.insert(rng.randrange(len(body) + 1), "nastywo" + rng.choice(["ing", "ed", "s", "ly", f"x{k}"]))
        texts.append(" ".join(body).encode())
        labels.append(int(k % 3 == 0))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def net():
    return T.fit(*corpus(300, 1), steps=250)


def test_generalises_to_new_forms_of_a_stem(net):
    texts, labels = corpus(300, 2)
    scorer = T.Scorer(net)
    scores = np.array([scorer.score(t) for t in texts])
    assert ((scores > 0.5) == labels).mean() > 0.97


def test_memo_and_pieces_do_not_change_scores(net, monkeypatch):
    texts, _ = corpus(50, 3)
    long = b" ".join(texts * 40) + b" nastywoing " + b" ".join(texts)
    whole = T.Scorer(net).score(long)
    monkeypatch.setattr(T, "MEMO", 10)
    again = T.Scorer(net)
    assert again.score(long) == pytest.approx(whole, abs=1e-6)
    words = T.words_of(long)
    ids = np.array([(0,) * 4] * 2 + [T.rows_of(w) for w in words] + [(0,) * 4] * 2, np.int64)
    best, _ = net.pooled(net.table(ids), np.array([0]))
    direct = T.sigmoid(float(np.maximum(best[0], 0) @ net.out) + net.bias)
    assert whole == pytest.approx(float(direct), abs=1e-5)
    assert again.scores([long, b"", *texts]) == pytest.approx([whole] + [T.Scorer(net).score(t) for t in [b"", *texts]], abs=1e-6)


def plain_score(net, text: bytes) -> float:
    """One word, filter and window at a time."""
    vectors = [net.embeddings[list(T.rows_of(w))].sum(axis=0).astype(float) for w in T.words_of(text)]
    vectors = [np.zeros(T.DIMS)] * 2 + vectors + [np.zeros(T.DIMS)] * 2
    total = net.bias + net.shift
    for i, w in enumerate(T.WIDTHS):
        for f in range(T.FILTERS):
            best = max(sum(vectors[at + k] @ net.kernels[w][k][:, f] for k in range(w)) for at in range(len(vectors) - w + 1))
            total += max(0.0, best + net.biases[w][f]) * net.out[i * T.FILTERS + f]
    return 1 / (1 + np.exp(-total))


def test_scores_equal_plain_loops(net):
    texts, _ = corpus(12, 5)
    texts += [b"", b"one", "é Ünïcode".encode()]
    assert T.Scorer(net).scores(texts) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-5)


def test_gradients_equal_differences():
    """Each kind of parameter moved by a little, against the loss of plain_score."""
    net = T.initial(3)
    net.out += 0.2
    texts, labels = corpus(5, 8)
    vocabulary = sorted({w for t in texts for w in T.words_of(t)})
    hashed = np.array([(0,) * 4] + [T.rows_of(w) for w in vocabulary], np.int64)
    ids, starts = T.padded([np.array([1 + vocabulary.index(w) for w in T.words_of(t)]) for t in texts])
    g = T.gradients(net, hashed, ids, starts, labels)

    def loss() -> float:
        p = [plain_score(net, t) for t in texts]
        return -sum(np.log(x if y else 1 - x) for x, y in zip(p, labels))

    def slope(array: np.ndarray, at: tuple) -> float:
        array[at] += 1e-3
        up = loss()
        array[at] -= 2e-3
        down = loss()
        array[at] += 1e-3
        return (up - down) / 2e-3

    assert slope(net.out, (5,)) == pytest.approx(g.out[5], abs=0.02)
    for w in T.WIDTHS:
        assert slope(net.biases[w], (3,)) == pytest.approx(g.biases[w][3], abs=0.02)
        assert slope(net.kernels[w], (w - 1, 2, 3)) == pytest.approx(g.kernels[w][w - 1, 2, 3], abs=0.02)
    row = int(np.bincount(g.rows[g.rows > 0]).argmax())
    assert slope(net.embeddings, (row, 4)) == pytest.approx(g.values[g.rows == row, 4].sum(), abs=0.02)


def test_repeated_ids_and_long_labelled_texts(spark):
    """max_rows bounds what reaches the driver even where thousands of rows share one labelled id; long texts train whole."""
    long = "é " * 500_000 + "foul deed"  # 1.5 MB
    rows = [(1, f"copy {k} foul deed") for k in range(500)] + [(2, "fine day"), (3, long), (4, "fair day"), (6, "fine word"), (7, "fair word")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 0), (6, 0), (7, 0), (8, 1)], "doc_id long, toxic int")
    ids = T.labelled_ids(labels, "toxic", "doc_id")
    assert sorted(map(tuple, ids.collect())) == [(1, 1), (2, 0), (3, 1), (4, 0), (6, 0), (7, 0), (8, 1)]
    free = {r[0] for r in ids.where(~T.kept_out("__id")).select("__id").collect()}
    sample = T.sample_of(docs, ids, 2500, "doc_id", "text")
    assert len(sample) == len(free - {8}) and (3 not in free or long.encode() in [t for *_, t in sample])
    assert len(T.sample_of(docs, ids, 1, "doc_id", "text")) <= 2


def test_empty_texts_have_the_score_of_no_evidence(net):
    scorer = T.Scorer(net)
    assert scorer.score(b"") == scorer.score(b" \n!?") < 0.5


def test_best_threshold():
    assert T.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.5)
    assert T.best_threshold(np.array([0.9]), np.array([1])) is None


def test_thresholds_see_every_kept_out_row_at_true_class_shares(spark):
    """Rows that words cannot tell apart, 8 of 100 toxic: a small sample of as many of each class must not set the threshold."""
    rng = random.Random(4)
    words = [f"word{k}" for k in range(60)]

    def text(toxic: bool) -> str:
        return " ".join([rng.choice(words) for _ in range(12)] + ["nasty"] * (rng.random() < (0.7 if toxic else 0.15)))

    rows = [(k, text(k % 25 < 2), "en", int(k % 25 < 2)) for k in range(3000)]
    rows = [(k, ("word1 " * 4_000 if k % 7 == 0 else "") + t, lang, y) for k, t, lang, y in rows]  # some long
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    net = T.train(df, df, max_rows=150)
    seen = {r["doc_id"] for r in df.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(5)) == 0).select("doc_id").collect()}
    out = [row for row in rows if row[0] in seen]
    scorer = T.Scorer(net)
    scores, real = np.array([scorer.score(t.encode()) for _, t, _, _ in out]), np.array([y for *_, y in out])
    counted = T.kept_out_scores(df, T.labelled_ids(df, "toxic", "doc_id"), net, "doc_id", "text", "lang")
    assert sum(n for *_, n in counted) == len(out) and sum(y * n for _, y, _, n in counted) == real.sum()

    def f1(threshold: float) -> float:
        return 2 * (real & (scores >= threshold)).sum() / ((scores >= threshold).sum() + real.sum())

    best = max(f1(s) for s in scores)
    assert f1(net.threshold) == pytest.approx(best, abs=0.01)


def test_equal_scores_stay_on_one_side():
    assert T.best_threshold(np.array([0.9, 0.5, 0.5, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.3)
    assert T.best_threshold(np.array([0.9, 0.5, 0.1]), np.array([1, 1, 0]), np.array([1, 1, 90])) == pytest.approx(0.3)


def test_held_out_accuracy_on_documents(spark):
    rows = op7_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = rows.join(labels, "doc_id").collect()
    for r in got[:50]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in got if r["held_out"]]
    assert rows.count() == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9  # 299 labelled texts in four languages


def test_scores_ignore_everything_but_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = T.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    a = [r["s"] for r in docs.orderBy("doc_id").select(T.score_column(docs, net).alias("s")).collect()]
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    b = [r["s"] for r in other.orderBy("doc_id").select(T.score_column(other, net).alias("s")).collect()]
    assert a == b


def test_defined_cases(spark):
    schema = "doc_id long, text string, lang string, score string"
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", "en", "x"), (None, "w", "en", "x"), (1, "w", "en", "y")], schema)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = T.score_documents(docs, none).collect()
    assert [(r["score"], r["predicted"], r["flagged"]) for r in out] == [(0.0, 0, 0)] * 4
    assert sum(r["doc_id"] is None and not r["held_out"] for r in out) == 1
    assert T.reject(docs, none).columns == docs.columns and T.reject(docs, none).count() == 4
    one = spark.createDataFrame([(1, 1), (2, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    assert T.train(docs, one) is None
    assert T.score_documents(docs.limit(0), none).count() == 0
