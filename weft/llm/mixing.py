"""Mixing to target weights with soft domain membership, in DataFrame and SQL functions only.

A naive Bayes classifier over hashed words, counted from a labelled table, gives every document a posterior over domains.
Words of a text are not independent, so n of them count as n E / (n + E) words; E is the one of EVIDENCE by which the classifier
best predicts labelled rows that it was not counted from (a third of them, by a hash of the id).
Each document then gets a nonnegative rate (how often it is expected to be drawn), such that the expected tokens of
every domain, sum of rate * tokens * posterior, match the target weights of the same token budget. Rates solve the least
squares problem by projected gradient steps from rate 1, in the metric that weighs a document by its tokens: one
step subtracts from every rate the same linear function of its posterior and cuts at zero. A rate is therefore a
function of the posterior and the history of residuals (a few numbers per step). So the solver works on posteriors
grouped to thousandths with their token sums, and documents compute their rates from the history, without a join.
Gradient steps are slow for domains with few tokens. What they leave is settled by one last step of the same form, the
least change of the rates that meets all targets; Newton's method on its dual (a number per domain) finds it.

Scores are sums of integers, so they do not depend on the order of addition. Words are counted per document in the task
that reads it; what is shuffled is one row per document, whatever its length, source or copies.

Defined cases: a null or empty text has no tokens, its posterior is the prior; a null id is a document like others (rows
of equal id and text share one score). Labelled rows whose domain has no target do not train. A domain without any
training row has posterior 0 and keeps its residual. Targets that no nonnegative rates meet are approached as far as
possible, and a warning (with strict, an error) names what is left; residuals() gives it in figures. An empty table gives an empty result. At most max_rows labelled
rows train, those of smallest id hash; the driver holds BUCKETS counts per domain. Other columns pass through.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import cut, one_row

BUCKETS = 8192
#: Log likelihoods are kept in thousandths, posteriors in thousandths.
UNIT = 1000
#: How many independent words any text may count as.
EVIDENCE = (5, 10, 20, 40, 80, 160, 320, 640)
#: One in so many labelled ids is kept out of the counts.
KEPT_OUT = 3
#: Weight of the last step's own size beside the residuals: bounds it where targets are out of reach.
LEAST = 1e-12
#: Residual shares of tokens below which targets count as met.
TOLERANCE = 1e-3


def words(text: str | Column) -> Column:
    """Runs between blanks and line ends, lower-cased; an empty text has one empty word."""
    text = F.col(text) if isinstance(text, str) else text
    return F.split(F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\n"), F.lit(" "))), " ")


def bucket(word: str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Domains:
    """names in order, log prior, and per domain a log likelihood (thousandths) by bucket."""

    names: tuple[str, ...]
    prior: tuple[float, ...]
    likelihood: tuple[tuple[int, ...], ...]
    evidence: int = 40


def train(labelled: DataFrame, names: list[str], domain_col: str, text_col: str, smooth: float = 0.5) -> Domains:
    """Counts by one grouped aggregation. Likelihoods are relative to the mean over domains, so a word that says
    nothing adds nothing."""
    exploded = labelled.where(F.col(domain_col).isin(names)).select(F.col(domain_col).alias("d"), F.explode(words(text_col)).alias("w")).where("w <> ''")
    counted = exploded.groupBy("d", bucket("w").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {name: [0] * BUCKETS for name in names}
    for row in counted:
        counts[row["d"]][row["b"]] = row["n"]
    docs = {r["d"]: r["n"] for r in labelled.groupBy(F.col(domain_col).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    known = [name for name in names if docs.get(name)]
    logs = {}
    for name in known:
        total = sum(counts[name]) + smooth * BUCKETS
        logs[name] = [math.log((n + smooth) / total) for n in counts[name]]
    middle = [sum(logs[name][b] for name in known) / len(known) for b in range(BUCKETS)] if known else []
    every = sum(docs[name] for name in known) or 1
    return Domains(
        tuple(names),
        tuple(math.log(docs[name] / every) if name in logs else -math.inf for name in names),
        tuple(tuple(round(UNIT * (x - m)) for x, m in zip(logs[name], middle)) if name in logs else (0,) * BUCKETS for name in names),
    )


def _lookups(spark: SparkSession, domains: Domains) -> list[Column]:
    """The domains' tables, each an array that generated code looks up.

    They are scalar subqueries over one local row: as literals they would stand in every description of the plan, which the driver
    keeps for its history, megabytes for each query.
    """
    tables = spark.createDataFrame(pa.table({f"l{k}": pa.array([table], pa.list_(pa.int32())) for k, table in enumerate(domains.likelihood)}))
    return [tables.select(name).scalar() for name in tables.columns]


def _sums(docs: DataFrame, domains: Domains, id_col: str, text_col: str) -> DataFrame:
    """(id, h, tokens, copies, l0, l1, ...): per distinct id and text, tokens and log likelihoods of all its rows."""
    # The hash is made below the generator: beside it, it would be computed again for every word.
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    rows = hashed.select("id", "h", F.posexplode(words("text")).alias("at", "w"))
    placed = rows.select("id", "h", "at", (F.col("w") != "").alias("real"), F.when(F.col("w") != "", bucket("w")).alias("b"))
    return placed.groupBy("id", "h").agg(
        F.count_if("real").alias("tokens"),
        F.count_if(F.col("at") == 0).alias("copies"),
        *[F.coalesce(F.sum(F.get(table, F.col("b"))), F.lit(0)).alias(f"l{k}") for k, table in enumerate(_lookups(docs.sparkSession, domains))],
    )


def _scores(domains: Domains, evidence: int) -> dict[int, Column]:
    """Log posteriors, up to a common constant, of the domains that have a prior; a row's copies count once."""
    once = F.lit(UNIT) * F.col("copies") * (1 + F.col("tokens") / (F.col("copies") * evidence))
    return {k: F.col(f"l{k}") / once + F.lit(prior) for k, prior in enumerate(domains.prior) if prior > -math.inf}


def _top(scores: dict[int, Column]) -> Column:
    return F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()), F.lit(0.0))


def with_evidence(domains: Domains, kept_out: DataFrame, domain_col: str, id_col: str, text_col: str) -> Domains:
    """domains with the evidence of least log loss on kept_out rows, the first of equal ones."""
    alive = [k for k, prior in enumerate(domains.prior) if prior > -math.inf]
    if not alive:
        return domains
    losses = []
    for k in alive:
        rows = _sums(kept_out.where(F.col(domain_col) == domains.names[k]), domains, id_col, text_col)
        for evidence in EVIDENCE:
            scores = _scores(domains, evidence)
            top = _top(scores)
            spread = F.log(sum((F.exp(x - top) for x in scores.values()), F.lit(0.0)))
            rows = rows.withColumn(f"e{evidence}", F.round(top + spread - scores[k], 9) * F.col("copies"))
        losses.append(rows.agg(*[F.coalesce(F.sum(f"e{e}"), F.lit(0.0)).alias(f"e{e}") for e in EVIDENCE]).first())
    total = {e: round(sum(row[f"e{e}"] for row in losses), 6) for e in EVIDENCE}
    return replace(domains, evidence=min(EVIDENCE, key=lambda e: (total[e], e))) if any(total.values()) else domains


def posteriors(docs: DataFrame, domains: Domains, id_col: str, text_col: str) -> DataFrame:
    """(id, h, tokens, copies, q0, q1, ...): per distinct id and text, tokens of all its rows and posteriors in thousandths."""
    scores = _scores(domains, domains.evidence)
    raised = _sums(docs, domains, id_col, text_col).withColumn("top", _top(scores))
    raised = raised.withColumns({f"e{k}": F.exp(scores[k] - F.col("top")) if k in scores else F.lit(0.0) for k in range(len(domains.names))})
    total = sum((F.col(f"e{k}") for k in scores), F.lit(0.0))
    shares = raised.withColumn("z", F.when(total > 0, total).otherwise(1.0))
    return shares.select("id", "h", "tokens", "copies", *[F.round(UNIT * F.col(f"e{k}") / F.col("z")).cast("int").alias(f"q{k}") for k in range(len(domains.names))])


def _dot(k_values: list[Column], weights: Column) -> Column:
    out = F.lit(0.0)
    for k, value in enumerate(k_values):
        out = out + value * F.get(weights, F.lit(k))
    return out


def rate_column(history: list[list[float]], count: int) -> Column:
    """The rate of a row with posteriors q0 .. q(count-1): steps from 1, each cut at zero."""
    if not history:
        return F.lit(1.0)
    steps = F.split(F.lit(";".join(",".join(repr(x) for x in step) for step in history)), ";")
    steps = F.transform(steps, lambda s: F.split(s, ",").cast("array<double>"))
    p = [F.col(f"q{k}") / UNIT for k in range(count)]
    return F.aggregate(steps, F.lit(1.0), lambda rate, step: F.greatest(F.lit(0.0), rate - _dot(p, step)))


def _largest(matrix: list[list[float]]) -> float:
    """Largest eigenvalue of a small nonnegative symmetric matrix, by power iteration."""
    n = len(matrix)
    v, value = [1.0 / math.sqrt(n)] * n, 0.0
    for _ in range(200):
        w = [sum(a * b for a, b in zip(row, v)) for row in matrix]
        value = math.sqrt(sum(x * x for x in w))
        if value == 0:
            return 0.0
        v = [x / value for x in w]
    return value


def _settle(cells: DataFrame, targets: list[float], total: int, tolerance: float) -> list[float]:
    """The last step from cells(q..., tokens, rate): rates max(0, rate - p . step) are the nearest that meet the targets.

    Newton's method on the convex, piecewise quadratic dual. Damped and shortened steps are tried in one job, the best is taken; it
    ends when the targets are met or no step lowers the dual any more. Domains without evidence do not move.
    """
    count = len(targets)
    p = [F.col(f"q{k}") / UNIT for k in range(count)]
    share = F.col("tokens") / total

    def after(step: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), F.col("rate") - _dot(p, F.array(*[F.lit(float(x)) for x in step])))

    def value(square: float, step: np.ndarray) -> float:
        return square / 2 + float(step @ wanted) + LEAST / 2 * float(step @ step)

    wanted = np.array(targets)
    step = np.zeros(count)
    while True:
        rated = cells.withColumn("r", after(step))
        alive = F.when(F.col("r") > 0, share).otherwise(0.0)
        sums = one_row(rated.agg(
            F.sum(share * F.col("r") * F.col("r")).alias("square"),
            *[F.sum(share * F.col("r") * p[k]).alias(f"s{k}") for k in range(count)],
            *[F.sum(p[k]).alias(f"any{k}") for k in range(count)],
            *[F.sum(alive * p[i] * p[j]).alias(f"h{i}_{j}") for i in range(count) for j in range(i, count)],
        ))
        left = np.array([round(sums[f"s{k}"], 12) for k in range(count)]) - wanted
        known = np.array([sums[f"any{k}"] > 0 for k in range(count)])
        lowest = value(sums["square"], step)
        if not known.any() or np.abs(left[known]).max() < tolerance:
            return step.tolist()
        slope = np.where(known, LEAST * step - left, 0.0)
        curve = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(count)] for i in range(count)])
        curve[~known] = curve[:, ~known] = 0.0
        moves = [np.linalg.solve(curve + damp * np.eye(count), slope) for damp in (LEAST, 1e-9, 1e-6, 1e-3, 1.0)]
        tried = [step - short * move for move in moves for short in (1.0, 0.25, 1 / 16, 1 / 64)]
        squares = one_row(cells.agg(*[F.sum(share * after(x) * after(x)).alias(f"t{k}") for k, x in enumerate(tried)]))
        values = [value(squares[k], x) for k, x in enumerate(tried)]
        best = int(np.argmin(values))
        if not values[best] < lowest - 1e-12 * max(1.0, abs(lowest)):
            return step.tolist()
        step = tried[best]


def solve(cells: DataFrame, targets: list[float], tolerance: float = TOLERANCE, most: int = 150) -> tuple[list[list[float]], list[float]]:
    """(history, residual shares): at most most projected gradient steps on cells(q..., tokens) and, where these leave a
    residual, a last step that settles it. Only sums per domain reach the driver."""
    count = len(targets)
    p = [F.col(f"q{k}") / UNIT for k in range(count)]
    first = one_row(cells.agg(F.sum("tokens").alias("n"), *[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(count) for j in range(i, count)]))
    total = first["n"] or 0
    if not total:
        return [], [0.0] * count
    gram = [[first[f"m{min(i, j)}_{max(i, j)}"] / total for j in range(count)] for i in range(count)]
    step = 1.6 / max(1e-9, _largest(gram))
    history: list[list[float]] = []
    before: list[float] = []

    def left() -> list[float]:
        rated = cells.withColumn("rate", rate_column(history, count))
        sums = one_row(rated.agg(*[F.sum(F.col("rate") * F.col("tokens") * p[k]).alias(f"s{k}") for k in range(count)]))
        return [round(sums[k] / total - targets[k], 9) for k in range(count)]

    while True:
        residual = left()
        settled = before and max(abs(a - b) for a, b in zip(residual, before)) < tolerance / 100
        if max(map(abs, residual)) < tolerance:
            return history, residual
        if settled or len(history) >= most:
            break
        history.append([step * x for x in residual])
        before = residual
    last = _settle(cut(cells.withColumn("rate", rate_column(history, count))), targets, total, tolerance)
    if any(last):
        history.append(last)
        residual = left()
    return history, residual


def learned(labelled: DataFrame, names: list[str], domain_col: str, id_col: str, text_col: str, max_rows: int) -> Domains:
    """The classifier from at most max_rows labelled rows, two thirds of the ids for its counts, the others for its evidence."""
    chosen = labelled.where(F.col(domain_col).isin(names)).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(max_rows)
    rows = cut(chosen.select(F.col(id_col).alias("id"), F.col(domain_col).alias("domain"), F.col(text_col).alias("text")))
    out = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(KEPT_OUT)) == 0  # also ids that are null
    domains = train(rows.where(~out), names, "domain", "text")
    return with_evidence(domains, rows.where(out), "domain", "id", "text")


def rated(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], domain_col: str, id_col: str, text_col: str, max_rows: int, strict: bool = False
) -> tuple[DataFrame, dict[str, float]]:
    """(id, h, tokens, copies, q..., rate) per distinct id and text, and the residual share of tokens by domain, in order."""
    names = sorted(targets)
    weight = sum(targets.values())
    scored = cut(posteriors(docs, learned(labelled, names, domain_col, id_col, text_col, max_rows), id_col, text_col))
    qs = [f"q{k}" for k in range(len(names))]
    cells = cut(scored.groupBy(*qs).agg(F.sum("tokens").alias("tokens")))
    history, left = solve(cells, [targets[name] / weight for name in names])
    residual = dict(zip(names, left))
    unmet = {name: x for name, x in residual.items() if abs(x) >= TOLERANCE}
    if history and unmet:
        said = f"targets out of reach; shares of tokens above (below, if negative) target: {unmet}"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    return scored.withColumn("rate", F.round(rate_column(history, len(names)), 6)), residual


def residuals(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], domain_col: str = "lang",
    id_col: str = "doc_id", text_col: str = "text", max_rows: int = 3000,
) -> dict[str, float]:
    """By how large a share of all tokens each domain's expected tokens miss their target."""
    return rated(docs, labelled, targets, domain_col, id_col, text_col, max_rows)[1]


def labelled_documents(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """Documents that the labelled table lists: at most max_rows ids, sampled before any text is read."""
    ids = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__labelled")).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(max_rows)
    return docs.join(F.broadcast(ids), docs[id_col] == F.col("__labelled"), "left_semi")


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], domain_col: str = "lang",
    id_col: str = "doc_id", text_col: str = "text", max_rows: int = 3000, strict: bool = False,
) -> DataFrame:
    """Per row: id, n_tokens, rate, expected_tokens, and p_<domain> for every target."""
    scored, names = rated(docs, labelled, targets, domain_col, id_col, text_col, max_rows, strict)
    each = scored.withColumn("n", (F.col("tokens") / F.col("copies")).cast("long"))
    once = each.select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "rate", F.round(F.col("rate") * F.col("n"), 6).alias("expected_tokens"),
        *[(F.col(f"q{k}") / UNIT).alias(f"p_{name}") for k, name in enumerate(names)], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return once.drop("copy")


def draw(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], domain_col: str = "lang",
    id_col: str = "doc_id", text_col: str = "text", max_rows: int = 3000, salt: int = 11, strict: bool = False,
) -> DataFrame:
    """The rows and columns of docs, each as often as its rate says: the whole part, and once more with the
    probability of the rest, decided by a hash of id and text."""
    scored, _ = rated(docs, labelled, targets, domain_col, id_col, text_col, max_rows, strict)
    chance = F.pmod(F.xxhash64(F.lit(salt), "id", "h"), F.lit(1 << 20)) / (1 << 20)
    times = scored.select(F.struct("id", "h").alias("__of"), F.floor(F.col("rate") + chance).cast("int").alias("__times")).where("__times > 0")
    keyed = docs.withColumn("__row", F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h")))
    drawn = keyed.join(times, F.col("__row") == F.col("__of"))
    return drawn.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[docs[c] for c in docs.columns])
