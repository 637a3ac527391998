"""Quality classifier learned from positives and unlabelled text (non-negative risk).

Trusted positives P and unlabelled texts U train a linear model over binned figures
by the non-negative risk ``pi R_P(+) + max(0, R_U(-) - pi R_P(-))`` under the bounded sigmoid loss.
U is every training text with its label ignored, so it follows the corpus as it is; labelled
negatives teach nothing.

1. *Figures.*  Style: character classes, word lengths, repeated words and lines, symbols per
   word.  Content: log-odds of hashed words between P and U, counted over all training texts
   in ``BUCKETS`` buckets, as mean, lowest and share of poor words of a text.  The odds are counted in two
   halves by the hash of the text and a text is given those of the half that it is not in, in
   training and in scoring alike, so that no text is judged by its own words.  Each figure is cut
   at quantiles of all training texts into one-hot bins.
2. *Prior.*  A first fit, under the logistic loss, ranks texts by the ratio of the densities of P and U.  The share of U
   above a rank over the share of held-back P above it bounds ``pi`` from above at every rank;
   the estimate is the least bound with its margin of error (best-bin estimation).
3. *Fit.*  Adam on P and a sample of U is a warm start; then ``passes`` steps follow the risk's
   gradient over all of U, one aggregation of a figure a weight each, under a bound of its curvature.
   Where the bracket of the risk is negative it adds nothing to the gradient, and the passes end.  ``predicted`` is the sign of the minimised risk's decision, nothing else.

P and the sample of U are at most ``max_rows`` rows, picked by the hash of the id: the documented
bound of what reaches the driver.  Word counts, quantiles, the prior and the passes read all of U.

Defined results: null and empty texts have the figures of an empty text and get a score;
without positives all scores are 0.5; repeated ids are scored row by
row, null ids too (they do not train); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import U64, Words, bound_batches, flat, materialize, mix, pieces, required

MAX_ROWS = 8000
BINS = 12
BUCKETS = 1 << 14
LEAST_COUNT = 20
_CLASS = np.zeros(256, dtype=np.uint8)
#: Byte classes: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 ``!?``, 5 ``#*$%&<>``, 6 ``|``, 7 ``.,;:``, 8 white space, 9 non-ASCII, 10 ``@/_=+~^\\{}[]``
for _i, _chars in enumerate((b"", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b"!?", b"#*$%&<>", b"|", b".,;:", b" \t\n\x0b\x0c\r", bytes(range(128, 256)), b"@/_=+~^\\{}[]")):
    _CLASS[list(_chars)] = _i
CLASSES = 11


def _share(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return top / np.maximum(bottom, 1)


def halves(words: Words, h: np.ndarray) -> np.ndarray:
    """The half (0 or 1) of each text: a function of its words alone."""
    n = len(words.first) - 1
    out = np.zeros(n, dtype=np.int64)
    full = np.flatnonzero(np.diff(words.first))
    if len(full):
        out[full] = (mix(np.add.reduceat(h, words.first[:-1][full])) >> U64(63)).astype(np.int64)
    return out


def features(data: np.ndarray, offsets: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Style and content figures, a row per text; ``odds`` gives the log-odds of a word's bucket by half."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    first = words.first
    count = np.diff(first)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), count)
    cls = _CLASS[data]
    sums = np.zeros((CLASSES, n))
    for c in range(1, CLASSES):
        acc = np.concatenate(([0], np.cumsum(cls == c)))
        sums[c] = acc[offsets[1:]] - acc[offsets[:-1]]
    h = words.hashes(lower=True)
    length = words.ends - words.starts
    last = data[words.ends - 1] if len(h) else np.zeros(0, dtype=np.uint8)
    head = data[words.starts] if len(h) else np.zeros(0, dtype=np.uint8)
    tally = lambda flag: np.bincount(doc[flag], minlength=n)
    lag = lambda k: np.concatenate((np.zeros(min(k, len(h)), dtype=bool), (h[k:] == h[:-k]) & (doc[k:] == doc[:-k])))
    own = np.unique(mix(h ^ (doc.astype(U64) * U64(0x9E3779B97F4A7C15)))) if len(h) else h
    # distinct words: sort (document, hash) pairs through one mixed key, then count first uses
    order = np.lexsort((h, doc)) if len(own) != len(h) else np.arange(len(h))
    sh, sd = h[order], doc[order]
    fresh = np.concatenate(([True], (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1]))) if len(h) else np.zeros(0, dtype=bool)
    distinct = np.bincount(sd[fresh], minlength=n)
    nl = np.flatnonzero(data == 10)
    line_doc = np.searchsorted(offsets, nl, side="right") - 1
    lines = np.bincount(line_doc, minlength=n) + 1 if len(nl) else np.ones(n)
    o = odds[1 - halves(words, h)[doc], (h & U64(BUCKETS - 1)).astype(np.int64)]
    least = np.zeros(n)
    if len(h):
        full = np.flatnonzero(count)
        least[full] = np.minimum.reduceat(o, first[:-1][full])
    return np.stack(
        [
            _share(np.bincount(doc, o, n), count),
            least,
            _share(tally(o < -0.5), count),
            np.log1p(count),
            _share(size, count),
            _share(sums[2], sums[1] + sums[2]),
            *(_share(sums[c], count) for c in (3, 4, 5, 6, 7, 10)),
            _share(sums[9], size),
            _share(distinct, count),
            _share(distinct, np.sqrt(count)),
            _share(tally(lag(1)), count),
            _share(tally(lag(2) | lag(3) | lag(5)), count),
            _share(tally(length <= 1), count),
            _share(tally(length > 20), count),
            _share(tally((last == 46) | (last == 33) | (last == 63)), count),
            _share(tally((head >= 65) & (head <= 90)), count),
            _share(tally(_CLASS[last] == 5), count),
            _share(count, lines),
            np.bincount(doc, length.astype(float) ** 2, n) / np.maximum(count, 1),
        ],
        axis=1,
    )


class PULinear:
    """Binned figures, non-negative PU risk under the sigmoid loss, or the logistic loss to rank by."""

    def __init__(self, odds: np.ndarray, cuts: list[np.ndarray], ranking: bool = False):
        self.odds, self.cuts, self.ranking = odds, cuts, ranking
        self.weight, self.bias, self.decay = np.zeros(len(cuts) * (BINS + 1)), 0.0, 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Index of each figure's bin in the weight vector; figures compare as the 32-bit numbers that are stored."""
        x = x.astype(np.float32)
        return np.stack([np.searchsorted(c, x[:, j], side="right") + j * (BINS + 1) for j, c in enumerate(self.cuts)], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weight[self.bins(x)].sum(axis=1) + self.bias

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.logit(features(data, offsets, self.odds))

    def sums(self, b: np.ndarray, coef: np.ndarray) -> np.ndarray:
        """Sum of ``coef`` by bin, and of all."""
        return np.append(np.bincount(b.ravel(), np.repeat(coef, b.shape[1]), len(self.weight)), coef.sum())

    def minus(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss of calling a text negative, and its slope; that of calling it positive is ``minus(-z)``."""
        s = sigmoid(z)
        return (np.logaddexp(0, z), s) if self.ranking else (s, s * (1 - s))

    def unlabelled(self, b: np.ndarray) -> np.ndarray:
        """Sums over rows of U: the gradient of the loss of class minus, the loss, the rows."""
        loss, slope = self.minus(self.weight[b].sum(axis=1) + self.bias)
        return np.concatenate((self.sums(b, slope), [loss.sum(), len(b)]))

    def risk(self, bp: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
        """The risk of class plus, and the bracket; ``u`` from :meth:`unlabelled`."""
        zp = self.weight[bp].sum(axis=1) + self.bias
        return prior * self.minus(-zp)[0].mean(), u[-2] / max(1.0, u[-1]) - prior * self.minus(zp)[0].mean()

    def gradient(self, bp: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
        """Gradient of the non-negative risk and the value of its bracket."""
        zp = self.weight[bp].sum(axis=1) + self.bias
        plus = self.sums(bp, -prior * self.minus(-zp)[1] / len(zp))
        bracket = self.risk(bp, u, prior)[1]
        return (plus + self.bracket_gradient(bp, u, prior) if bracket >= 0 else plus), bracket

    def bracket_gradient(self, bp: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
        """Gradient of the bracket: the negative risk that U shows, less what positives in U add to it."""
        zp = self.weight[bp].sum(axis=1) + self.bias
        return u[:-2] / max(1.0, u[-1]) - self.sums(bp, prior * self.minus(zp)[1] / len(zp))

    def newton(self, bp: np.ndarray, u: np.ndarray, prior: float, inverse: np.ndarray) -> float:
        """One step by sums over all of U; the bracket before it.

        A negative bracket means that the fit explains away more than U holds: the step then is the
        non-negative estimator's ascent, along the bracket's own gradient and as far as brings it to zero."""
        g, bracket = self.gradient(bp, u, prior)
        if bracket >= 0:
            g[:-1] += self.decay * self.weight
            self.step(inverse @ g)
        else:
            up = self.bracket_gradient(bp, u, prior)
            way = inverse @ up
            self.step(way * (bracket / max(float(up @ way), 1e-12)))
        return bracket

    def step(self, d: np.ndarray) -> None:
        self.weight -= d[:-1]
        self.bias -= d[-1]

    def start(self, pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05) -> PULinear:
        """Adam over full batches."""
        bp, bu = self.bins(pos), self.bins(unl)
        self.decay = SHRINK / len(pos)
        g1, g2 = np.zeros(len(self.weight) + 1), np.zeros(len(self.weight) + 1)
        for t in range(1, steps + 1):
            g, _ = self.gradient(bp, self.unlabelled(bu), prior)
            g[:-1] += self.decay * self.weight
            g1, g2 = 0.9 * g1 + 0.1 * g, 0.999 * g2 + 0.001 * g * g
            self.step(rate * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.999**t)) + 1e-8))
        return self

    def curvature(self, unl: np.ndarray) -> np.ndarray:
        """An upper bound of the unclipped risk's second derivatives, from a sample of U."""
        b = self.bins(unl)
        one = np.zeros((len(b), len(self.weight) + 1))
        one[np.arange(len(b))[:, None], b] = 1
        one[:, -1] = 1
        return one.T @ one * (0.3 / max(1, len(b))) + np.diag(np.append(np.full(len(self.weight), self.decay + 1e-3), 1e-3))


#: Weight decay times the number of positives.
SHRINK = 1.0


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _word_counts(batches):
    """Partial counts of word buckets by half of the texts: over all rows and over the positives."""
    held = np.zeros((2, 2 * BUCKETS), dtype=np.int64)
    for batch in batches:
        kind = batch.column(0).to_numpy()
        data, off = flat(batch.column(1))
        for a, b in pieces(off, 2 << 20):
            words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a])
            h, size = words.hashes(lower=True), np.diff(words.first)
            at = (h & U64(BUCKETS - 1)).astype(np.int64) + BUCKETS * np.repeat(halves(words, h), size)
            held[0] += np.bincount(at, minlength=2 * BUCKETS)
            held[1] += np.bincount(at[np.repeat(kind[a:b] == 1, size)], minlength=2 * BUCKETS)
    some = np.flatnonzero(held[0])
    yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(held[0][some]), pa.array(held[1][some])], names=["bucket", "u", "p"])


def word_odds(rows: DataFrame) -> np.ndarray:
    """Log-odds of word buckets between the positives and all rows of (kind, text), by half."""
    found = rows.mapInArrow(_word_counts, "bucket int, u long, p long").groupBy("bucket").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).toArrow()
    u, p = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    at = found.column("bucket").to_numpy()
    u[at], p[at] = found.column("u").to_numpy(), found.column("p").to_numpy()
    u, p = u.reshape(2, BUCKETS), p.reshape(2, BUCKETS)
    share = lambda x: np.log((x + 1) / (x.sum(axis=1, keepdims=True) + BUCKETS))
    return np.where(u >= LEAST_COUNT, np.clip(share(p) - share(u), -3, 3), 0.0)


def _features(odds: np.ndarray):
    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(2))
            for a, b in pieces(off, 2 << 20):
                x = features(data[off[a] : off[b]], off[a : b + 1] - off[a], odds).astype(np.float32)
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(list(x), pa.list_(pa.float32()))], names=["kind", "rank", "x"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unlabelled(model: PULinear):
    def run(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + model.unlabelled(model.bins(_matrix(batch.column(0))))
        if np.ndim(total):
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    return run


def over_all(table: DataFrame, model: PULinear) -> np.ndarray:
    """:meth:`PULinear.unlabelled` over all rows: tasks add up, one number a weight comes back."""
    sums = table.select("x").mapInArrow(_unlabelled(model), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(len(model.weight) + 3)
    out[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
    return out


def _above(model: PULinear, ranks: np.ndarray):
    def run(batches):
        n = np.zeros(len(ranks), dtype=np.int64)
        for batch in batches:
            z = np.sort(model.logit(_matrix(batch.column(0)))) if batch.num_rows else np.zeros(0)
            n += len(z) - np.searchsorted(z, ranks, side="left")
        yield pa.record_batch([pa.array(np.arange(len(ranks), dtype=np.int32)), pa.array(n)], names=["i", "n"])

    return run


def best_bin(above_u: np.ndarray, rows_u: int, above_p: np.ndarray, rows_p: int, delta: float = 0.1) -> float:
    """The class prior: the least share of U over share of P above a rank, errors considered."""
    u, p = above_u / max(1, rows_u), np.maximum(above_p / max(1, rows_p), 1e-9)
    margin = np.sqrt(np.log(4 / delta) / 2 / max(1, rows_u)) + np.sqrt(np.log(4 / delta) / 2 / max(1, rows_p))
    i = int(np.argmin(u / p + margin / p))
    return float(np.clip(u[i] / p[i], 0.02, 0.98))


def estimated_prior(table: DataFrame, rows: int, first: PULinear, held: np.ndarray) -> float:
    """Best-bin estimate over all rows of U with the positives that the first fit did not see."""
    z = np.sort(first.logit(held))
    ranks = np.unique(z[(np.linspace(0, 1, 201)[:-1] * len(z)).astype(np.int64)])
    sums = table.select("x").mapInArrow(_above(first, ranks), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    above = np.zeros(len(ranks))
    above[sums.column("i").to_numpy()] = sums.column("n").to_numpy()
    return best_bin(above, rows, len(z) - np.searchsorted(z, ranks, side="left"), len(z))


def _score(model: PULinear | None):
    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(1))
            for a, b in pieces(off, 2 << 20):
                s = np.full(b - a, 0.5) if model is None else sigmoid(model.texts(data[off[a] : off[b]], off[a : b + 1] - off[a]))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(s)], names=["doc_id", "score"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, trains: Column, max_rows: int = MAX_ROWS, passes: int = 4, id_col: str = "doc_id", text_col: str = "text") -> PULinear | None:
    """Fit on positives of ``labels`` and all documents, both where ``trains`` holds."""
    bound_batches(docs.sparkSession)
    rows = required(docs, id_col, text_col).where(trains).toDF("doc_id", "text").where("doc_id is not null")
    marks = required(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    good = marks.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    rank = F.xxhash64("doc_id")
    pos = rows.select("doc_id").join(good, "doc_id", "left_semi").distinct().orderBy(rank, "doc_id").limit(max_rows)
    # at most max_rows ids: a bounded broadcast
    pos = F.broadcast(pos.withColumn("kind", F.lit(1)))
    rows = rows.join(pos, "doc_id", "left").select(F.coalesce("kind", F.lit(0)).alias("kind"), rank.alias("rank"), "text")
    odds = word_odds(rows.select("kind", "text"))
    table = materialize(rows.mapInArrow(_features(odds), "kind int, rank long, x array<float>"), "figures")

    fetch = lambda d: _matrix(d.orderBy("rank", F.col("x")).limit(max_rows).select("x").toArrow().column("x").combine_chunks())  # noqa: E731  in an order that depends on the rows alone
    p = table.where("kind = 1")
    if not p.take(1):
        return None
    p, u = fetch(p), fetch(table)
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    # tails matter most for style: extra cuts close to both ends
    q = np.unique(np.concatenate((q[::2], [0.01, 0.04, 0.96, 0.99, 0.9, 0.06])))[:BINS]
    at = [f"percentile_approx(x[{j}], array({', '.join(f'{v:.6f}' for v in q)}), 10000) as q{j}" for j in range(p.shape[1])]
    stats = table.selectExpr("count(*) as n", *at).first()
    cuts = [np.unique(np.array(stats[f"q{j}"], dtype=np.float64)) for j in range(p.shape[1])]

    prior = estimated_prior(table, stats.n, PULinear(odds, cuts, ranking=True).start(p[::2], u, 0.5), p[1::2] if len(p) > 1 else p)
    model = PULinear(odds, cuts).start(p, u, prior)
    bp, inverse = model.bins(p), np.linalg.inv(model.curvature(u))
    for _ in range(passes):
        model.newton(bp, over_all(table, model), prior, inverse)
    return model


def score_quality(docs: DataFrame, model: PULinear | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    bound_batches(docs.sparkSession)
    rows = required(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_score(model), "doc_id long, score double")


def _keep(model: PULinear, text_at: int):
    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(text_at))
            keep = [model.texts(data[off[a] : off[b]], off[a : b + 1] - off[a]) >= 0 for a, b in pieces(off, 2 << 20)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, dtype=bool)))

    return run


def keep_quality(docs: DataFrame, model: PULinear | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts (score of at least 0.5), all columns as they are."""
    if model is None:
        return docs
    bound_batches(docs.sparkSession)
    # by position: other columns may differ from these in case alone
    rows = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    return rows.mapInArrow(_keep(model, docs.columns.index(text_col)), rows.schema).toDF(*docs.columns)
