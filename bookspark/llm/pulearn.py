"""Quality by positive-unlabelled learning: trusted good texts, web text of unknown quality and an estimated class prior.

No text is known to be bad. A linear model of text statistics minimises the
non-negative risk: the loss of trusted texts as good, times the prior, and the loss of web
text as bad less the part that its good texts cause, or zero where that is negative.
With the logistic loss that is smooth and unbiased. It is minimised
by Newton steps, shortened where that is better; every step is a pass of Spark
over all rows that returns one sum, so nothing is sampled.

The prior is the share of good texts in web text. A first model tells
trusted from web text on one half of the rows; on the other half, above a
threshold where web text is purest, web text is as frequent as the prior
times trusted text. The threshold is the one with the least upper confidence bound.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.llm._shared import add_columns, cut

#: Weight of the squared weights in the risk, and in that of the model for the prior.
PENALTY, APART = 5e-3, 1e-4
#: Newton steps at most, the relative gain of the risk under which they end, and what parts of a step are tried with it.
STEPS, GAIN, SHORTER = 12, 1e-4, (0.5, 0.2, 0.05)
#: Bins of the scores from which the prior is read, and its confidence.
BINS, DOUBT, SLACK = 4096, 0.1, 0.01

#: Characters that prose seldom has.
_SYMBOLS = b"#*$%&|<>@^~=+{}[]\\/_"
_ENDS = tuple(".!?:;\"')")


def _shares(text: bytes) -> list[float]:
    """Statistics between 0 and 1 of a text."""
    n = max(1, len(text))
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    upper, lower = bytes_[65:91].sum(), bytes_[97:123].sum()
    symbols = sum(int(bytes_[c]) for c in _SYMBOLS)
    whole = text.decode("utf-8", "replace")
    words, lines = whole.split(), [x for x in whole.split("\n") if x and not x.isspace()]
    m, k = max(1, len(words)), max(1, len(lines))
    counts = Counter(words)
    following = list(zip(words, words[1:]))
    return [
        upper / n, upper / max(1, upper + lower), bytes_[48:58].sum() / n, symbols / n, bytes_[124] / n, (bytes_[33] + bytes_[63]) / n,
        (bytes_[44] + bytes_[46]) / n, bytes_[10] / n, bytes_[128:].sum() / n, bytes_[:9].sum() / n, 1 - (upper + lower + bytes_[128:].sum()) / n,
        len(counts) / m, sum(a == b for a, b in following) / m, max(counts.values(), default=0) / m, len(set(following)) / max(1, m - 1),
        sum(1 for w in words if len(w) > 1 and w.isupper()) / m, sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,") / m,
        sum(1 for w in words if not any(map(str.isalpha, w[:3]))) / m, counts_of_length(words, 1) / m, min(1.0, len(whole) / m / 20), counts_over(words, 20) / m,
        1 - len(set(lines)) / k, sum(1 for x in lines if " " not in x.strip()) / k, sum(1 for x in lines if not x.rstrip().endswith(_ENDS)) / k, min(1.0, k / m),
        min(1.0, math.log1p(len(words)) / 12), float(len(words) < 3), float(len(words) < 10), float(len(words) < 30), float(len(words) < 100),
    ]


def counts_of_length(words: list[str], n: int) -> int:
    return sum(1 for w in words if len(w) == n)


def counts_over(words: list[str], n: int) -> int:
    return sum(1 for w in words if len(w) > n)


def features(text: bytes | None) -> np.ndarray:
    """The statistics, as they are and bent so that small shares count, and a constant."""
    x = np.array(_shares(text or b""))
    return np.concatenate([x, np.sqrt(x), np.minimum(x, 0.04) * 25, np.minimum(x, 0.2) * 5, [1.0]]).astype(np.float32)


def featurize(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with features binary, of the whole text; a null text counts as empty. A column of that name is replaced."""
    return add_columns(documents, text, "features binary", lambda: lambda texts: ([features(t).tobytes() for t in texts],))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64)


def _summed(rows: DataFrame, function: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """function(features, positive) of all batches, summed: in each task, then in about as many tasks as the root of their number."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += function(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    parts = rows.mapInArrow(one, "s binary")
    found = parts.repartition(max(1, math.isqrt(rows.sparkSession.sparkContext.defaultParallelism))).mapInArrow(more, "s binary").collect()
    return sum((np.frombuffer(r["s"]) for r in found), np.zeros(size))


def _losses(z: np.ndarray) -> list[np.ndarray]:
    """The losses of scores as bad and as good, summed over the rows."""
    return [np.logaddexp(0, z).sum(axis=0), np.logaddexp(0, -z).sum(axis=0)]


def _sums(x: np.ndarray, positive: np.ndarray, w: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For web text (all rows) and for trusted text: number, losses as bad and as good at w and at the other weights, gradient of the first, Hessian, sum of x."""
    out, all_ = [], np.column_stack([w, others.T])
    for own in (x, x[positive]):
        z = own @ all_
        p = 1 / (1 + np.exp(-np.clip(z[:, 0], -500, 500)))
        out += [[len(own)], *_losses(z), own.T @ p, ((own * (p * (1 - p))[:, None]).T @ own).ravel(), own.sum(axis=0)]
    return np.concatenate(out)


def risk(sums: np.ndarray, w: np.ndarray, others: np.ndarray, prior: float | None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Risk, gradient and Hessian at w, and the risks at the others. With a prior the non-negative risk; without, that of telling trusted from web text."""
    d, k = len(w), 1 + len(others)
    cuts = np.cumsum([1, k, k, d, d * d, d])
    (n, bad, _, g, h, _), (m, as_bad, as_good, gp, hp, xp) = (np.split(s, cuts[:-1]) for s in np.split(sums, 2))
    n, m = max(1.0, n[0]), max(1.0, m[0])
    bad, as_bad, as_good, g, gp, xp = bad / n, as_bad / m, as_good / m, g / n, gp / m, xp / m
    h, hp = h.reshape(d, d) / n, hp.reshape(d, d) / m
    penalty = APART if prior is None else PENALTY
    norms = penalty / 2 * (np.vstack([w, others]) ** 2).sum(axis=1)
    if prior is None:
        values, g, h = as_good + bad, gp - xp + g, h + hp
    else:
        values = prior * as_good + np.maximum(0, bad - prior * as_bad)
        if bad[0] > prior * as_bad[0]:
            # the gradients of a good text's two losses differ by x: no Hessian of trusted text is left
            g = g - prior * xp
        else:
            g, h = prior * (gp - xp), prior * hp
    values = values + norms
    return float(values[0]), g + penalty * w, h + penalty * np.eye(d), values[1:]


def fit(rows: DataFrame, prior: float | None, size: int) -> np.ndarray:
    """The weights of least risk over rows(features, positive)."""

    def at(w: np.ndarray, others: np.ndarray):
        return risk(_summed(rows, lambda x, p: _sums(x, p, w, others), 2 * (1 + 2 * (1 + len(others)) + 2 * size + size * size)), w, others, prior)

    w, nothing = np.zeros(size), np.zeros((0, size))
    best, g, h, _ = at(w, nothing)
    for _ in range(STEPS):
        step = np.linalg.solve(h, g)
        shorter = np.array([w - t * step for t in SHORTER])
        value, new_g, new_h, values = at(w - step, shorter)
        if values.min() < value:
            k = int(values.argmin())
            new = shorter[k]
            if best - values[k] > GAIN * best:
                value, new_g, new_h, _ = at(new, nothing)
        else:
            new = w - step
        gain = best - min(value, values.min())
        if gain <= GAIN * best:
            return w if gain <= 0 else new
        w, best, g, h = new, value, new_g, new_h
    return w


def estimate_prior(rows: DataFrame, w: np.ndarray) -> float:
    """The share of good texts in web text, from how much of both lies above each score."""

    def bins(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        at = np.minimum((p * BINS).astype(np.int64), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[positive], minlength=BINS)]).astype(float)

    return prior_of(*np.split(_summed(rows, bins, 2 * BINS), 2))


def prior_of(web: np.ndarray, trusted: np.ndarray) -> float:
    """From the numbers of web and trusted texts in each bin of the score."""
    if not web.sum() or not trusted.sum():
        return 0.5
    above = [np.cumsum(x[::-1]) / x.sum() for x in (web, trusted)]
    margin = sum(math.sqrt(math.log(4 / DOUBT) / 2 / x.sum()) for x in (web, trusted))
    some = above[1] > 0
    bound = (above[0][some] + (1 + SLACK) * margin) / above[1][some]
    k = int(np.argmin(bound))
    return float(np.clip(above[0][some][k] / above[1][some][k], 0.01, 0.99))


def train(rows: DataFrame, positive: str = "positive") -> dict:
    """A model of rows with features and the boolean `positive`: trusted texts; null counts as false.

    All rows are web text, the trusted ones among them too, so that it has the corpus's
    own share of good texts. Without trusted texts every text gets 0.5.
    """
    # halves by row and not by text: a large group of copies would lie in one half
    own = cut(rows.select("features", F.coalesce(F.col(f"`{positive}`"), F.lit(False)).alias("p"), (F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2)) == 0).alias("half")))
    first = own.where("p").select("features").first()
    if first is None:
        return {"prior": 0.5, "weights": None}
    size = len(first["features"]) // 4
    halves = [own.where("half").select("features", "p"), own.where("not half").select("features", "p")]
    prior = estimate_prior(halves[1], fit(halves[0], None, size))
    return {"prior": prior, "weights": fit(own.select("features", "p"), prior, size)}


def score(featured: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """featured with score double (0 to 1) and predicted int (1 from the threshold on); repeated rows stay, columns of these names are replaced."""
    weights = model["weights"]

    def make():
        def run(rows):
            if weights is None:
                p = np.full(len(rows), 0.5)
            else:
                x = np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64)
                # a sum a row, and no matrix product, whose rounding depends on the rows beside it
                p = 1 / (1 + np.exp(-np.clip((x * weights).sum(axis=1), -500, 500)))
            return p.tolist(), (p >= threshold).astype(int).tolist()

        return run

    return add_columns(featured, "features", "score double, predicted int", make)
