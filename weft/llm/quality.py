"""Document quality by hierarchical empirical Bayes.

A logistic classifier on surface features of the whole text gives each document a probability of being good. These
probabilities are pooled by host and, below it, by path through grouped aggregation. A host's posterior mean shrinks its
own mean towards the global one, a path's towards its host's; how strongly is estimated from the spread between hosts and
between paths (method of moments), so a site with few documents says little and one with many speaks for itself. A
document's quality combines its own odds with the odds its path gives it, without its own share in them (leave one out).

Sums are kept in integer millionths, so results do not depend on the order of addition. Site statistics are joined by
broadcast while they have at most BROADCAST_SITES rows (counted), and by a shuffled join, which adaptive execution splits on
a hot host, beyond that.

Training takes at most max_rows labelled ids, those of smallest id hash, and of the rows that share one the one of smallest
text hash; only their feature vectors reach the driver, so max_rows bounds them. assess scores a text once and keeps only its
evidence and site. reject scores it twice, before and after the sites are known, which costs less than to write or
shuffle whole texts in between; evidence is a function of the text, so both agree.
Defined cases: null and empty texts have the features of an empty text; a null host or path is a site of its own; without
labels of both classes every document's own probability is 0.5. Repeated rows count as often as they occur. An
empty table gives an empty result. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.text import utf8
from weft.session import cut

BROADCAST_SITES = 20_000
MILLION = 1_000_000
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
SYMBOLS = b"#$%&*@^~=+<>{}[]\\_"
DIGITS = b"0123456789"
FEATURES = ("upper", "symbols", "bars", "bangs", "digits", "stops", "letters", "word_length", "unique", "repeated", "lines", "doubled_lines", "size")


def features(data: bytes) -> list[float]:
    """Surface features of one text; each a share or a logarithm."""
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))

    def count(of: bytes) -> int:
        return len(data) - len(data.translate(None, of))

    letters = max(1, count(LETTERS))
    lines = [line for line in data.split(b"\n") if line]
    shingles = max(1, len(words) - 2)
    return [
        count(UPPER) / letters,
        count(SYMBOLS) / n,
        data.count(b"|") / n,
        data.count(b"!") / n,
        count(DIGITS) / size,
        count(b".,") / n,
        count(LETTERS) / size,
        min(3.0, len(data) / n / 10),
        len(set(words)) / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / shingles if len(words) > 2 else 0.0,
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words)) / 10,
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Features, and their square roots, which tell little from none."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], axis=1)


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (expand(x) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -12, 12)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> Classifier:
    """Ridge logistic regression by Newton steps."""
    wide = expand(x)
    mean, scale = wide.mean(axis=0), wide.std(axis=0) + 1e-6
    z = np.concatenate([(wide - mean) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
        w -= step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, w)


def features_column(text: str | Column = "text") -> Column:
    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array([features(x.as_py()) for x in texts], pa.list_(pa.float64()))

    return measured(utf8(text))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> Classifier | None:
    """The classifier; None without labelled texts of both classes. An id labelled twice counts as good if any label says so."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y"))
    ids = rows.groupBy("__id").agg(F.max("__y").alias("__y"))
    chosen = ids.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(max_rows)
    sampled = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    once = sampled.select("__id", "__y", F.xxhash64(F.coalesce(F.col("__text").cast("string"), F.lit(""))).alias("__h"), features_column("__text").alias("x"))
    rows = sorted(tuple(r) for r in once.groupBy("__id", "__y").agg(F.min_by("x", "__h").alias("x")).collect())
    y = np.array([r[1] for r in rows])
    if not rows or y.all() or not y.any():
        return None
    return fit(np.array([r[2] for r in rows]), y)


def evidence_column(model: Classifier | None, text: str | Column = "text") -> Column:
    """The classifier's probability, in millionths."""

    @F.arrow_udf("long")
    def evidence(texts: pa.Array) -> pa.Array:
        if model is None or not len(texts):
            return pa.array(np.full(len(texts), MILLION // 2), pa.int64())
        p = model.probability(np.array([features(x.as_py()) for x in texts]))
        return pa.array(np.rint(p * MILLION).astype(np.int64), pa.int64())

    return evidence.asNondeterministic()(utf8(text))


@dataclass(frozen=True)
class Prior:
    """Global mean and the pseudo-counts by which hosts shrink to it and paths to their hosts."""

    mean: float
    host: float
    path: float


def _pseudo_count(mean: float, within: float, between: float) -> float:
    """Pseudo-count of a beta prior whose variance is that between groups beyond their sampling noise."""
    spread = max(1e-6, between - within)
    return float(np.clip(mean * (1 - mean) / spread - 1, 1.0, 10_000.0))


def site_statistics(scored: DataFrame) -> tuple[DataFrame, Prior]:
    """(host, path, n, s, hn, hs) per path, and the prior, from rows (host, path, e) with e in millionths."""
    paths = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count(F.lit(1)).alias("k")).first()
    if not total["n"]:
        return paths.withColumns({"hn": F.col("n"), "hs": F.col("s")}), Prior(0.5, 1.0, 1.0)
    mean = min(1 - 1e-6, max(1e-6, total["s"] / MILLION / total["n"]))

    def moments(groups: DataFrame, n: str, deviation: Column) -> tuple[float, float]:
        """Noise and spread of group means. A group's weight n / (1 + n / 100) levels off as that of a random-effects mean does: beyond
        some rows a group's mean is exact, and one host with a third of all rows says no more about the spread between hosts."""
        weight = F.col(n) / (1 + F.col(n) / 100.0)
        row = groups.agg(
            F.sum(F.round(weight * deviation * deviation, 9)).alias("b"), F.sum(weight).alias("w"), F.sum(F.round(weight / F.col(n), 9)).alias("i")
        ).first()
        return mean * (1 - mean) * row["i"] / row["w"], row["b"] / row["w"]

    share = F.col("hs") / (MILLION * F.col("hn"))
    host = _pseudo_count(mean, *moments(hosts, "hn", share - mean))
    above = hosts.withColumnRenamed("host", "of")
    joined = cut(paths.join(above, F.col("host").eqNullSafe(F.col("of"))).select("host", "path", "n", "s", "hn", "hs"))
    path = _pseudo_count(mean, *moments(joined, "n", F.col("s") / (MILLION * F.col("n")) - share))
    return joined, Prior(mean, host, path)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def posterior_columns(prior: Prior) -> dict[str, Column]:
    """host_posterior, path_posterior (both without the document itself) and quality."""
    own = F.col("__e") / MILLION
    host = ((F.col("__hs") - F.col("__e")) / MILLION + prior.host * prior.mean) / (F.col("__hn") - 1 + prior.host)
    path = ((F.col("__s") - F.col("__e")) / MILLION + prior.path * host) / (F.col("__n") - 1 + prior.path)

    def clip(p: Column) -> Column:
        return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))

    odds = _logit(clip(own)) + _logit(clip(path)) - float(np.log(prior.mean / (1 - prior.mean)))
    return {"host_posterior": F.round(host, 6), "path_posterior": F.round(path, 6), "quality": F.round(1 / (1 + F.exp(-odds)), 6)}


def scored(docs: DataFrame, model: Classifier | None, host: str, path: str, text_col: str) -> DataFrame:
    """docs with __host, __path and __e, the text's own evidence in millionths."""
    placed = docs.withColumns({"__host": F.col(host).cast("string"), "__path": F.col(path).cast("string")})
    return placed.withColumn("__e", evidence_column(model, text_col))


def judge(scored: DataFrame) -> DataFrame:
    """Scored rows with __host_posterior, __path_posterior and __quality."""
    stats, prior = site_statistics(scored.select(F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__e").alias("e")))
    sites = stats.select(*[F.col(c).alias(f"__{c}") for c in ("n", "s", "hn", "hs")], F.col("host").alias("__site_host"), F.col("path").alias("__site_path"))
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    on = F.col("__host").eqNullSafe(F.col("__site_host")) & F.col("__path").eqNullSafe(F.col("__site_path"))
    joined = scored.join(sites, on)
    return joined.withColumns({f"__{name}": column for name, column in posterior_columns(prior).items()})


def assess(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, own probability, host and path posteriors, quality, keep (1 from the threshold on)."""
    rows = scored(docs, train(docs, labels, id_col=id_col, text_col=text_col), host, path, text_col)
    judged = judge(cut(rows.select(F.col(id_col).alias("__id"), "__host", "__path", "__e")))
    return judged.select(
        F.col("__id").alias(id_col), (F.col("__e") / MILLION).alias("evidence"), F.col("__host_posterior").alias("host_posterior"), F.col("__path_posterior").alias("path_posterior"),
        F.col("__quality").alias("quality"), (F.col("__quality") >= threshold).cast("int").alias("keep"),
    )


def reject(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with their columns, of quality at or above the threshold."""
    judged = judge(scored(docs, train(docs, labels, id_col=id_col, text_col=text_col), host, path, text_col))
    return judged.where(F.col("__quality") >= threshold).select(*[docs[c] for c in docs.columns])
