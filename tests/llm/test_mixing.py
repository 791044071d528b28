from __future__ import annotations

import math
import random
from collections import Counter

import pytest
import xxhash

from weft.llm import mixing as M
from weft.llm.queries import TARGETS

SCHEMA = "doc_id long, text string, lang string, rate string, tokens int"


def words(text: str | None) -> list[str]:
    return [w for w in (text or "").replace("\n", " ").lower().split(" ") if w]


def bucket(word: str) -> int:
    return (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(word.encode(), 42)) % M.BUCKETS


def kept(doc: int | None) -> bool:
    """Whether an id is kept out of the counts; a null id hashes to the seed."""
    h = 42 if doc is None else xxhash.xxh64_intdigest(str(doc).encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % M.KEPT_OUT == 0


def corpus() -> list[tuple]:
    rng = random.Random(8)
    vocabulary = {d: [f"{d}{k}" for k in range(40)] + ["shared"] for d in ("aa", "bb", "cc")}
    rows: list[tuple] = []
    for k in range(200):
        d = rng.choices(["aa", "bb", "cc"], [0.7, 0.2, 0.1])[0]
        other = rng.choice(["aa", "bb", "cc"])
        body = [rng.choice(vocabulary[d]) for _ in range(rng.randrange(1, 60))] + [rng.choice(vocabulary[other]) for _ in range(rng.choice([0, 0, 20]))]
        rows.append((k, " ".join(body), d, "x", 1))
    return rows + [rows[3], rows[3], (None, rows[5][1], "aa", "x", 1), (900, None, None, "x", 1), (901, "", "aa", "x", 1), (902, "aa1\n" * 30_000, "aa", "x", 1)]


TARGET = {"aa": 0.2, "bb": 0.5, "cc": 0.3}


def brute(rows: list[tuple]) -> tuple[dict, dict]:
    """(rows by id and text, totals by domain) by plain loops."""
    every = [(i, t, d) for i, t, d, *_ in rows if d in TARGET]
    labelled, kept_out = [x for x in every if not kept(x[0])], [x for x in every if kept(x[0])]
    names = sorted(TARGET)
    counts = {d: Counter(bucket(w) for _, t, x in labelled if x == d for w in words(t)) for d in names}
    size = {d: sum(c.values()) + 0.5 * M.BUCKETS for d, c in counts.items()}
    logs = {d: [math.log((counts[d][b] + 0.5) / size[d]) for b in range(M.BUCKETS)] for d in names}
    unit = {d: [round(1000 * (logs[d][b] - sum(logs[e][b] for e in names) / len(names))) for b in range(M.BUCKETS)] for d in names}
    share = Counter(d for _, _, d in labelled)

    def posterior(text: str | None, evidence: int) -> list[float]:
        ws = words(text)
        z = [sum(unit[d][bucket(w)] for w in ws) / (1 + len(ws) / evidence) / 1000 + math.log(share[d] / len(labelled)) for d in names]
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    evidence = min(M.EVIDENCE, key=lambda n: -sum(math.log(posterior(t, n)[names.index(d)]) for _, t, d in kept_out))
    out = {(i, t): (len(words(t)), [round(1000 * x) for x in posterior(t, evidence)]) for i, t, *_ in rows}
    total = sum(out[(i, t)][0] for i, t, *_ in rows)
    rates = {key: 1.0 for key in out}
    gram = [[sum(out[r[:2]][0] * out[r[:2]][1][a] * out[r[:2]][1][b] for r in rows) / 1e6 / total for b in range(3)] for a in range(3)]
    step, before = 1.6 / M._largest(gram), None
    for _ in range(151):
        sums = [sum(rates[r[:2]] * out[r[:2]][0] * out[r[:2]][1][k] / 1000 for r in rows) / total for k in range(3)]
        residual = [s - TARGET[d] for s, d in zip(sums, names)]
        if max(map(abs, residual)) < 1e-3 or before and max(abs(a - b) for a, b in zip(residual, before)) < 1e-5:
            break
        before = residual
        rates = {key: max(0.0, rate - step * sum(x * q / 1000 for x, q in zip(residual, out[key][1]))) for key, rate in rates.items()}
    return {key: (*out[key], rates[key]) for key in out}, dict(zip(names, sums))


def test_mix_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    wanted, totals = brute(rows)
    text = {}
    for i, t, *_ in rows:
        text.setdefault(i, t)
    got = M.mix(df, df, TARGET, max_rows=10_000).collect()
    assert len(got) == len(rows)
    for r in got:
        n, q, rate = wanted[(r["doc_id"], text[r["doc_id"]])]
        assert r["n_tokens"] == n
        assert [round(1000 * r[f"p_{d}"]) for d in sorted(TARGET)] == pytest.approx(q, abs=1)
        assert r["rate"] == pytest.approx(rate, abs=0.02) and r["rate"] >= 0
    for d, wanted_share in TARGET.items():
        share = sum(r["expected_tokens"] * r[f"p_{d}"] for r in got) / sum(r["n_tokens"] for r in got)
        assert share == pytest.approx(wanted_share, abs=2e-3)


def test_draw_follows_the_rates(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    rates = {r["doc_id"]: r["rate"] for r in M.mix(df, df, TARGET, max_rows=10_000).collect()}
    drawn = M.draw(df, df, TARGET, max_rows=10_000)
    assert drawn.columns == df.columns
    counts = Counter(r["doc_id"] for r in drawn.collect())
    present = Counter(r[0] for r in rows)
    for doc, rate in rates.items():
        assert math.floor(rate) <= counts[doc] / present[doc] <= math.ceil(rate)


def test_evidence_is_what_predicts_best(spark):
    rng = random.Random(31)
    rows = []
    for k in range(400):  # words say little, and a text repeats its few words
        d = rng.choice(["aa", "bb"])
        some = [rng.choice(["x", "y"] + [d] * (rng.random() < 0.5) + [{"aa": "bb", "bb": "aa"}[d]] * (rng.random() < 0.3)) for _ in range(3)]
        rows.append((k, " ".join(some * 40), d, "x", 1))
    rough = M.learned(spark.createDataFrame(rows, SCHEMA), ["aa", "bb"], "lang", "doc_id", "text", 1000)
    sure = [(k, " ".join(f"{d}{rng.randrange(30)}" for _ in range(30)), d, "x", 1) for k in range(300) for d in [rng.choice(["aa", "bb"])]]
    clear = M.learned(spark.createDataFrame(sure, SCHEMA), ["aa", "bb"], "lang", "doc_id", "text", 1000)
    assert rough.evidence <= 10 < clear.evidence


def test_unreachable_target_keeps_its_residual(spark):
    df = spark.createDataFrame([(1, "aa1 aa2", "aa", "x", 1), (2, "aa3", "aa", "x", 1), (7, "aa1", "aa", "x", 1), (9, "aa1", "aa", "x", 1)], SCHEMA)
    got = M.mix(df, df, {"aa": 0.5, "zz": 0.5}).collect()
    assert all(r["p_zz"] == 0 and r["rate"] == pytest.approx(0.5, abs=2e-3) for r in got)


@pytest.mark.parametrize(
    ("cells", "targets"),
    [
        ([(100, 0, 0, 0, 10_000), (0, 1000, 0, 0, 94_500), (0, 0, 1000, 0, 250), (0, 0, 0, 1000, 250)], [0.2, 0.4, 0.2, 0.2]),
        ([(1000, 0, 0, 0, 500), (0, 1000, 0, 0, 998_500), (0, 0, 1000, 0, 500), (0, 0, 300, 700, 500)], [0.2, 0.4, 0.2, 0.2]),
        ([(1000, 0, 0, 0, 700), (0, 1000, 0, 0, 200), (0, 0, 1000, 0, 100), (600, 0, 0, 400, 50), (0, 0, 0, 1000, 1)], [0.0, 0.4, 0.3, 0.3]),
    ],
)
def test_scarce_and_unwanted_domains_meet_their_targets(spark, cells, targets):
    df = spark.createDataFrame(cells, "q0 int, q1 int, q2 int, q3 int, tokens long")
    history, residual = M.solve(df, targets, most=20)
    assert max(map(abs, residual)) < 1e-3
    rated = df.withColumn("rate", M.rate_column(history, 4)).collect()
    for k, target in enumerate(targets):
        assert sum(r["rate"] * r["tokens"] * r[f"q{k}"] / 1000 for r in rated) / sum(r["tokens"] for r in rated) == pytest.approx(target, abs=1e-3)


def test_targets_out_of_reach_are_reported(spark):
    df = spark.createDataFrame([(1, "aa1 aa2", "aa", "x", 1), (2, "aa3", "aa", "x", 1), (7, "aa1", "aa", "x", 1), (9, "aa1", "aa", "x", 1)], SCHEMA)
    with pytest.warns(UserWarning, match="out of reach.*zz"):
        M.mix(df, df, {"aa": 0.5, "zz": 0.5})
    with pytest.raises(ValueError, match="out of reach"):
        M.mix(df, df, {"aa": 0.5, "zz": 0.5}, strict=True)
    with pytest.warns(UserWarning):
        assert M.residuals(df, df, {"aa": 0.5, "zz": 0.5})["zz"] == pytest.approx(-0.5, abs=2e-3)
    mixed = spark.createDataFrame([(500, 500, 10), (400, 600, 10)], "q0 int, q1 int, tokens long")
    _, residual = M.solve(mixed, [0.9, 0.1], most=20)
    best = min((0.5 * r - 0.9) ** 2 + (0.5 * r - 0.1) ** 2 for r in (k / 1000 for k in range(3000)))
    assert sum(x * x for x in residual) == pytest.approx(best, abs=1e-3)


def test_empty_and_unlabelled_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "aa1", "aa", "x", 1), (2, None, None, "x", 1)], SCHEMA)
    assert M.mix(empty, some, TARGET).count() == 0 and M.draw(empty, some, TARGET).count() == 0
    assert [r["rate"] for r in M.mix(some, empty, TARGET).collect()] == [1.0, 1.0]


def test_languages_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labelled = M.labelled_documents(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), 3000)
    got = M.mix(docs, labelled, TARGETS).join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = [max(TARGETS, key=lambda d: r[f"p_{d}"]) == r["lang"] for r in got if r["n_tokens"] >= 10]
    assert sum(right) / len(right) > 0.97
    total = sum(r["n_tokens"] for r in got)
    for d, share in TARGETS.items():
        assert sum(r["expected_tokens"] * r[f"p_{d}"] for r in got) / total == pytest.approx(share, abs=2e-3)


def test_plan_has_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = M.mix(docs, docs, TARGETS)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_plans_do_not_spell_out_the_tables(spark):
    """The driver keeps the description of every plan; with the tables as literals one takes over 100,000 letters."""
    df = spark.createDataFrame(corpus(), SCHEMA)
    domains = M.Domains(("aa", "bb"), (math.log(0.5),) * 2, (tuple(range(M.BUCKETS)), tuple(range(0, -M.BUCKETS, -1))))
    scored = M.posteriors(df, domains, "doc_id", "text")
    assert len(scored._jdf.queryExecution().toString()) < 50_000
    row = next(r for r in scored.collect() if r["id"] == 4)
    ws = words(corpus()[4][1])
    z = [sign * sum(map(bucket, ws)) / (1 + len(ws) / 40) / 1000 for sign in (1, -1)]
    assert [row["q0"], row["q1"]] == [round(1000 / (1 + math.exp(z[1] - z[0]))), round(1000 / (1 + math.exp(z[0] - z[1])))]
