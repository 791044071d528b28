"""Toxicity scores by a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its prefixes, so inflected forms of a stem share most of
it. Filters of several widths slide over the words, max pooling keeps each filter's strongest response anywhere in the
text, and a logistic unit on the pooled responses gives the score. Because the filters are linear, a word's
contribution to every filter position is computed once per distinct word and then looked up.

Training uses whole texts of labelled rows: at most max_rows ids of each class, those of smallest id hash, and one row of an id,
that of smallest text hash, so max_rows bounds the texts on the driver whatever the table's size. One id in KEPT_OUT takes no
part. Scores refer to the class shares among all labelled training rows. Thresholds are calibrated for each language on every
labelled row of the ids kept out, so on scores of texts that the very network has not seen, at the true class shares: the
scores are counted by thousandths of log odds, and only the counts reach the driver. They shrink to the global threshold where a
language has few toxic rows, and that is THRESHOLD where they lack a class; language enters only the decision, never the score.

Defined cases: null and empty texts, and texts without a word, get the score of no evidence. Rows without a label do not
train; nor do labels without a text. An id labelled twice counts as toxic if any label says so. Without labelled rows of both
classes to train on every score is 0. A score equal to a threshold is at it: flagged, and rejected. Repeated rows give repeated
results; an empty table gives an empty result; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.text import utf8

BUCKETS, DIMS = 1 << 15, 12
WIDTHS, FILTERS = (1, 2, 3), 12
#: Prefix lengths, in bytes, that are hashed beside the whole word.
PREFIXES = (4, 5, 6)
#: ASCII letters lower-cased, digits kept, other ASCII blanked; bytes of other letters kept.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Distinct words a worker remembers before it starts anew.
MEMO = 100_000
#: Words that go through the filters together.
TOGETHER = 16_384
THRESHOLD = 0.3
#: One in so many ids is kept out of the gradient steps, to calibrate thresholds.
KEPT_OUT = 5


def words_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def rows_of(word: bytes) -> tuple[int, ...]:
    """Embedding rows of a word; row 0 is reserved for no word."""
    keys = [word, *(b"^" + word[:n] for n in PREFIXES if len(word) >= n)]
    rows = [1 + zlib.crc32(key) % (BUCKETS - 1) for key in keys]
    return tuple(rows + [0] * (1 + len(PREFIXES) - len(rows)))


@dataclass
class Network:
    embeddings: np.ndarray
    kernels: dict[int, np.ndarray]  # width -> [position, dim, filter]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    shift: float = 0.0  # added to the log odds, so that scores refer to the true class shares
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = THRESHOLD

    def table(self, rows: np.ndarray) -> np.ndarray:
        """[word, position and filter] contributions of words given by their embedding rows."""
        vectors = self.embeddings.take(rows[:, 0], axis=0)
        for k in range(1, rows.shape[1]):
            vectors += self.embeddings.take(rows[:, k], axis=0)
        return vectors @ np.concatenate([self.kernels[w][k] for w in WIDTHS for k in range(w)], axis=1)

    def pooled(self, responses: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """[text, filter] strongest responses, for consecutive texts of which each starts at a row of starts (its words in
        order, padded by two empty words on either side); and what where() finds their rows from."""
        ends = np.append(starts[1:], len(responses))
        best, places, column = [], [], 0
        for w in WIDTHS:
            total = responses[:, column : column + FILTERS].copy()
            for k in range(1, w):
                total[:-k] += responses[k:, column + k * FILTERS : column + (k + 1) * FILTERS]
                total[ends - k] = -np.inf  # the window would leave its text
            column += w * FILTERS
            top = np.maximum.reduceat(total, starts, axis=0)
            best.append(top + self.biases[w])
            places.append((total, top))
        return np.concatenate(best, axis=1), places

    @staticmethod
    def where(places: list[tuple[np.ndarray, np.ndarray]], starts: np.ndarray) -> list[np.ndarray]:
        """Of every width, the first row at which a text's filter had its strongest response."""
        found = []
        for total, top in places:
            lengths = np.diff(np.append(starts, len(total)))
            rows = np.where(total == np.repeat(top, lengths, axis=0), np.arange(len(total))[:, None], len(total))
            found.append(np.minimum.reduceat(rows, starts, axis=0))
        return found


def initial(seed: int = 7) -> Network:
    rng = np.random.Generator(np.random.PCG64(seed))
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    embeddings[0] = 0
    kernels = {w: rng.normal(0, 0.5 / np.sqrt(w), (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS}
    biases = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
    return Network(embeddings, kernels, biases, rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)


def sigmoid(z: float | np.ndarray) -> float | np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Adam:
    def __init__(self, shape: tuple[int, ...], rate: float):
        self.m, self.v, self.rate, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), rate, 0

    def step(self, value: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient * gradient - self.v)
        value -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-7)


def _odds(docs: list[np.ndarray], hashed: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Smoothed log odds of embedding rows by the number of training texts of either class that use them, positive part:
    a start that needs few labelled texts."""
    seen = np.zeros((2, BUCKETS))
    for doc, label in zip(docs, labels):
        seen[label, np.unique(hashed[np.unique(doc)])] += 1
    n = np.bincount(labels, minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds[seen[1] < 2] = 0
    odds[0] = 0
    return np.maximum(odds, 0).astype(np.float32)


@dataclass
class Gradients:
    """Sums over a batch; rows and values list what each embedding row receives."""

    out: np.ndarray
    bias: float
    kernels: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    rows: np.ndarray
    values: np.ndarray


def gradients(net: Network, hashed: np.ndarray, ids: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> Gradients:
    """Of the log loss summed over a batch: ids are words of consecutive padded texts, hashed their embedding rows. Only pooled
    positions carry a gradient. A word's responses are computed once a batch."""
    used, which = np.unique(ids, return_inverse=True)
    best, places = net.pooled(net.table(hashed[used]).take(which, axis=0), starts)
    hidden = np.maximum(best, 0)
    error = (sigmoid(hidden @ net.out + net.bias) - labels).astype(np.float32)
    back = error[:, None] * net.out * (best > 0)
    kernels, biases, rows, values = {}, {}, [], []
    for i, (w, place) in enumerate(zip(WIDTHS, net.where(places, starts))):
        up = back[:, i * FILTERS : (i + 1) * FILTERS]
        biases[w] = up.sum(axis=0)
        kernels[w] = np.empty_like(net.kernels[w])
        for k in range(w):
            at = hashed[ids[place + k]]  # [text, filter, hash]
            kernels[w][k] = np.einsum("tfd,tf->df", net.embeddings[at].sum(axis=2), up)
            rows.append(at.reshape(-1))
            values.append(np.repeat(np.einsum("df,tf->tfd", net.kernels[w][k], up).reshape(-1, DIMS), at.shape[2], axis=0))
    return Gradients(error @ hidden, float(error.sum()), kernels, biases, np.concatenate(rows), np.concatenate(values))


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of consecutive texts, each padded by two zeros on either side, and where each starts."""
    out = np.zeros(sum(map(len, texts)) + 4 * len(texts), np.int64)
    starts, at = np.empty(len(texts), np.int64), 0
    for k, text in enumerate(texts):
        starts[k] = at
        out[at + 2 : at + 2 + len(text)] = text
        at += len(text) + 4
    return out, starts


def fit(texts: list[bytes], labels: np.ndarray, steps: int | None = None, batch: int = 32, seed: int = 7) -> Network:
    """Gradient steps (by default more for more texts) on batches with as many texts of either class."""
    steps = min(1200, 200 + len(texts) // 4) if steps is None else steps
    net = initial(seed)
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    vocabulary: dict[bytes, int] = {}
    flat = array("i", (0,) * (1 + len(PREFIXES)))  # embedding rows of the words, packed: the driver holds many words
    docs = []
    for text in texts:
        ids = array("i")
        for word in words_of(text):
            place = vocabulary.get(word)
            if place is None:
                place = vocabulary[word] = len(vocabulary) + 1
                flat.extend(rows_of(word))
            ids.append(place)
        docs.append(np.frombuffer(ids, np.int32))
    del vocabulary
    hashed = np.frombuffer(flat, np.int32).reshape(-1, 1 + len(PREFIXES))
    net.embeddings[:, 0] = _odds(docs, hashed, labels)
    net.kernels[1][0, :, 0] = 0
    net.kernels[1][0, 0, 0] = net.out[0] = 1.0
    net.biases[1][0] = -1.0
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    adam = {w: (_Adam(net.kernels[w].shape, 0.01), _Adam((FILTERS,), 0.01)) for w in WIDTHS}
    adam_out, adam_bias = _Adam(net.out.shape, 0.01), _Adam((1,), 0.01)
    squares = np.full(BUCKETS, 1e-4, np.float32)
    for _ in range(steps):
        chosen = np.concatenate([rng.choice(c, batch // 2) for c in classes])
        ids, starts = padded([docs[d] for d in chosen])
        g = gradients(net, hashed, ids, starts, labels[chosen])
        for w in WIDTHS:
            adam[w][0].step(net.kernels[w], g.kernels[w] / batch)
            adam[w][1].step(net.biases[w], g.biases[w] / batch)
        adam_out.step(net.out, g.out / batch + 1e-4 * net.out)
        bias = np.array([net.bias], np.float32)
        adam_bias.step(bias, np.array([g.bias / batch], np.float32))
        net.bias = float(bias[0])
        # Adagrad by row for the embeddings that pooled positions used.
        order = np.argsort(g.rows, kind="stable")
        at, first = np.unique(g.rows[order], return_index=True)
        summed = np.add.reduceat(g.values[order], first, axis=0) / batch
        squares[at] += (summed * summed).mean(axis=1)
        net.embeddings[at] -= 0.05 * summed / np.sqrt(squares[at])[:, None]
        net.embeddings[0] = 0
    return net


class Scorer:
    """Scores texts with a bounded memo of words."""

    def __init__(self, net: Network):
        self.net, self.none = net, net.table(np.zeros((1, 1 + len(PREFIXES)), np.int64))
        self._restart()

    def _restart(self) -> None:
        self.places: dict[bytes, int] = {}
        self.known = np.repeat(self.none, 1024, axis=0)

    def _learn(self, words: list[bytes]) -> None:
        fresh = [w for w in dict.fromkeys(words) if w not in self.places]
        if not fresh:
            return
        table = self.net.table(np.array([rows_of(w) for w in fresh], np.int64))
        start = 1 + len(self.places)
        while start + len(fresh) > len(self.known):
            self.known = np.concatenate([self.known, np.repeat(self.none, len(self.known), axis=0)])
        self.known[start : start + len(fresh)] = table
        self.places.update(zip(fresh, range(start, start + len(fresh))))

    def scores(self, texts: Iterable[bytes]) -> list[float]:
        """Texts go through the filters some TOGETHER words at a time. A longer text is cut into pieces that overlap by the widest
        filter less one word, so no window is lost and memory stays bounded."""
        out: list[float] = []
        strongest: list[np.ndarray] = []  # of the pieces since the last flush, per text
        pieces: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            if pieces:
                starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces[:-1]])]).astype(np.int64)
                best, _ = self.net.pooled(self.known[np.concatenate(pieces)], starts)
                for k, row in zip(owner, best):
                    strongest[k] = row if strongest[k] is None else np.maximum(strongest[k], row)
            pieces.clear()
            owner.clear()

        waiting = 0
        for data in texts:
            words = words_of(data)
            strongest.append(None)
            for start in range(0, max(1, len(words)), TOGETHER):
                if len(self.places) > MEMO:
                    flush()
                    waiting = 0
                    self._restart()
                piece = words[max(0, start - max(WIDTHS) + 1) : start + TOGETHER]
                self._learn(piece)
                ids = np.zeros(len(piece) + 4, np.int64)
                ids[2 : 2 + len(piece)] = [self.places[w] for w in piece]
                pieces.append(ids[2 if start else 0 : len(ids) - 2 if start + TOGETHER < len(words) else len(ids)])
                owner.append(len(strongest) - 1)
                waiting += len(ids)
                if waiting > TOGETHER:
                    flush()
                    waiting = 0
        flush()
        if strongest:
            z = np.maximum(np.stack(strongest), 0) @ self.net.out + self.net.bias + self.net.shift
            out = sigmoid(z.astype(np.float64)).tolist()
        return out

    def score(self, data: bytes) -> float:
        return self.scores([data])[0]


def labelled_ids(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """(__id, __y): one row per labelled id."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
    return rows.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y"))


def kept_out(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(KEPT_OUT)) == 0


def _lang(lang_col: str | None) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col else F.lit("")


def sample_of(docs: DataFrame, ids: DataFrame, max_rows: int, id_col: str, text_col: str) -> list[tuple[int, int, bytes]]:
    """Bounded training rows (hash, label, whole text) on the driver.

    Ids are sampled before texts are touched, so the join's small side has at most 2 max_rows rows; of the rows that share an
    id one is kept, so no more come back.
    """
    free = ids.where(~kept_out("__id")).withColumn("__h", F.xxhash64(F.col("__id").cast("string")))
    chosen = None
    for y in (0, 1):
        part = free.where(F.col("__y") == y).orderBy("__h", "__id").limit(max_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    read = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where(F.col("__text").isNotNull())
    found = read.join(F.broadcast(chosen), "__id").groupBy("__id", "__h", "__y").agg(F.min_by("__text", F.struct(F.xxhash64("__text"), "__text")).alias("__text"))
    return sorted((r["__h"], r["__y"], r["__text"].encode()) for r in found.collect())


def best_threshold(scores: np.ndarray, truth: np.ndarray, counts: np.ndarray | None = None) -> float | None:
    """The threshold of highest F1, midway to the next lower score; counts: rows that each entry stands for."""
    if not truth.any() or truth.all():
        return None
    order = np.argsort(-scores, kind="stable")
    each = np.ones(len(scores)) if counts is None else counts
    hits = np.cumsum((truth * each)[order])
    f1 = 2 * hits / (np.cumsum(each[order]) + hits[-1])
    # Entries of one score are on the same side of any threshold.
    f1[:-1][scores[order[:-1]] == scores[order[1:]]] = -1
    k = int(f1.argmax())
    below = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((scores[order[k]] + below) / 2)


def kept_out_scores(docs: DataFrame, ids: DataFrame, net: Network, id_col: str, text_col: str, lang_col: str | None) -> list[tuple[str, int, float, int]]:
    """(language, label, score, rows) of all labelled rows kept out of training, counted by thousandths of log odds."""
    texts = docs.where(kept_out(id_col)).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), _lang(lang_col).alias("__lang"))
    read = texts.where(F.col("__text").isNotNull()).join(ids.where(kept_out("__id")), "__id")
    scored = read.select("__lang", "__y", score_column(docs, net, "__text").alias("__s"))
    counted = scored.groupBy("__lang", "__y", F.round(F.ln(F.col("__s") / (1 - F.col("__s"))), 3).alias("__z")).agg(F.count(F.lit(1)).alias("n"))
    return sorted((r["__lang"], r["__y"], float(sigmoid(r["__z"])), r["n"]) for r in counted.collect())


def calibrate(net: Network, checked: list[tuple[str, int, float, int]], enough: int = 50) -> None:
    """Set the thresholds of highest F1 over checked rows, THRESHOLD where these lack a class. A language's is drawn towards the
    global one, the more the fewer toxic rows it has beside enough."""
    real, scores, each = (np.array([row[k] for row in checked]) for k in (1, 2, 3))

    def shrunk(own: np.ndarray, towards: float, beside: int) -> float:
        found = best_threshold(scores[own], real[own], each[own])
        toxic = float((real * each)[own].sum())
        return towards if found is None else float((toxic * found + beside * towards) / (toxic + beside))

    net.threshold = shrunk(np.ones(len(checked), bool), THRESHOLD, 0)
    net.thresholds = {name: shrunk(np.array([row[0] == name for row in checked]), net.threshold, enough) for name in sorted({row[0] for row in checked})}


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 2500,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
) -> Network | None:
    """A network with calibrated shift and thresholds; None without labelled texts of both classes to train on."""
    ids = labelled_ids(labels, label, id_col)
    rows = sample_of(docs, ids, max_rows, id_col, text_col)
    truth = np.array([y for _, y, _ in rows], np.int64)
    if not rows or truth.all() or not truth.any():
        return None
    texts = [text for _, _, text in rows]
    del rows
    net = fit(texts, truth)
    del texts
    counts = {row["__y"]: row["n"] for row in ids.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    net.shift = float(np.log(counts[1] / counts[0]))  # batches had equal shares
    calibrate(net, kept_out_scores(docs, ids, net, id_col, text_col, lang_col))
    return net


def score_column(df: DataFrame, net: Network | None, text: str | Column = "text") -> Column:
    """The score as a double. The network, of fixed size, is broadcast."""
    sent = df.sparkSession.sparkContext.broadcast(net)
    made: list[Scorer] = []

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        if sent.value is None:
            return pa.array(np.zeros(len(texts)))
        if not made:
            made.append(Scorer(sent.value))
        return pa.array(made[0].scores(x.as_py() for x in texts), pa.float64())

    return toxicity.asNondeterministic()(utf8(text))  # so that a filter on it does not run it twice


def threshold_column(net: Network | None, lang_col: str = "lang") -> Column:
    """The calibrated threshold of a row's language, the global one for others."""
    if net is None:
        return F.lit(1.1)
    choice = F.lit(net.threshold)
    for lang, threshold in net.thresholds.items():
        choice = F.when(F.col(lang_col) == lang, F.lit(threshold)).otherwise(choice)
    return choice


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, score, predicted (at 0.3) and flagged (at the language's own threshold)."""
    net = train(docs, labels.where(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score_column(docs, net, text_col).alias("score"), threshold_column(net, lang_col).alias("__t"))
    return scored.select(
        id_col, "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), (F.col("score") >= F.col("__t")).cast("int").alias("flagged")
    )


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows, with their columns, whose score is below the threshold of their language."""
    net = train(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col)
    scored = docs.withColumn("__toxicity", score_column(docs, net, text_col))
    return scored.where(F.col("__toxicity") < threshold_column(net, lang_col)).select(*docs.columns)
