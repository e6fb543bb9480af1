"""Toxicity by a support vector machine with a gapped-subsequence string kernel.

Two strings are alike if they share subsequences of ORDER characters; each
counts less the wider it is spread, up to ORDER + GAP characters. So an insult
with inserted, dropped or inflected letters is still close to the insult.
Nyström landmarks, the words that mark toxic texts most, turn the kernel into
short vectors. A sentence is its words' best likeness to each landmark. A
linear support vector machine is trained on labelled sentences: those of clean
texts are negative, and of a toxic text the sentence that the machine of the
round before finds worst is positive. A text is scored by its worst sentence.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.llm._shared import add_columns, cut

#: Labelled texts of each class that training takes at most, on average: a bounded sample by hash of the text.
SAMPLE = 6000
ORDER, GAP, DECAY = 3, 2, 0.6
LANDMARKS = 72
#: Sentences of each class that training takes, on average, at most: of a larger sample a part of the texts by hash, each with all its sentences.
SENTENCES = 60_000
#: A likeness under this counts as none.
LEAST = 0.35
#: Distinct words whose likenesses a task keeps; then it starts anew.
CACHED = 300_000
#: Longer words are compared in windows of so many characters.
LONGEST = 24

_OFFSETS = [(0, *c) for c in combinations(range(1, ORDER + GAP), ORDER - 1)]
_WEIGHTS = np.array([DECAY ** (o[-1] + 1) for o in _OFFSETS])


def _subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of every gapped subsequence; words get a border on both sides."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    letters = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(letters))
    out = []
    for offsets, weight in zip(_OFFSETS, _WEIGHTS):
        ok = np.flatnonzero(at + offsets[-1] < ends)
        code = letters[ok]
        for o in offsets[1:]:
            code = (code << 21) | letters[ok + o]
        out.append((owner[ok], code, np.full(len(ok), weight)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _norms(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((code, owner))
    owner, code, weight = owner[order], code[order], weight[order]
    if not len(owner):
        return np.zeros(n)
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])]))
    return np.sqrt(np.bincount(owner[first], np.add.reduceat(weight, first) ** 2, n))


class Kernel:
    """Normalised kernel values of words with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        owner, code, weight = _subsequences(landmarks)
        norms = _norms(owner, code, weight, len(landmarks))
        self.codes = np.unique(code)
        self.table = np.zeros((len(self.codes), len(landmarks)))
        np.add.at(self.table, (np.searchsorted(self.codes, code), owner), weight / norms[owner])
        self.most = self.table.max(axis=1) if len(landmarks) else np.zeros(0)

    def __call__(self, words: list[str]) -> np.ndarray:
        owner, code, weight = _subsequences(words)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        # no landmark can give more than the most that any gives for each subsequence
        squares = np.bincount(owner, weight**2, len(words))
        bound = np.bincount(owner[hit], weight[hit] * self.most[at[hit]], len(words))
        near = bound >= LEAST * np.sqrt(squares)
        out = np.zeros((len(words), len(self.landmarks)))
        hit &= near[owner]
        if hit.any():
            chosen = near[owner]
            norms = _norms(owner[chosen], code[chosen], weight[chosen], len(words))
            rows, cells, w = owner[hit], at[hit], weight[hit]
            order = np.argsort(rows, kind="stable")
            rows, cells, w = rows[order], cells[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            out[rows[first]] = np.add.reduceat(self.table[cells] * w[:, None], first) / norms[rows[first], None]
            out[out < LEAST] = 0
        return out


def words_of(text: str) -> list[str]:
    """Lower-case tokens; three or more single characters in a row are also one token together."""
    words = text.lower().split()
    if min(map(len, words), default=9) == 1:
        run: list[str] = []
        for k in range(len(words) - 1, -2, -1):
            w = words[k].strip(_MARKS) if k >= 0 else ""
            if len(w) == 1:
                run.append(w)
                continue
            if len(run) >= 3:
                words.insert(k + 1, "".join(run[::-1]))
            run = []
    return words


_MARKS = ".,;:!?\"'()[]{}<>«»“”„…¿¡*_~`|/\\"
_ENDS = frozenset(".!?…")


class _Words:
    """Which words are like a landmark at all, and how much."""

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def learn(self, words: list[str]) -> None:
        if len(self.known) > CACHED:
            self.clear()
        words = [w for w in dict.fromkeys(words) if w not in self.known]
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            plain = [w.strip(_MARKS) for w in part]
            pieces = [(k, p[j : j + LONGEST]) for k, p in enumerate(plain) for j in range(0, max(1, len(p) - LONGEST // 2), LONGEST // 2)]
            values = self.kernel([p for _, p in pieces])
            some = np.flatnonzero(values.any(axis=1)).tolist()
            best: dict[int, np.ndarray] = {}
            for s in some:
                k = pieces[s][0]
                best[k] = np.maximum(best[k], values[s]) if k in best else values[s]
            for k, w in enumerate(part):
                if k in best:
                    self.known[w] = len(self.rows)
                    self.rows.append(best[k])
                else:
                    self.known[w] = -1

    def sentences(self, words: list[str]) -> np.ndarray:
        """One row for each sentence that has a word like a landmark."""
        found = [(k, n) for k, w in enumerate(words) if (n := self.known[w]) >= 0]
        if not found:
            return np.zeros((0, len(self.kernel.landmarks)))
        own, at, number = [], 0, 0
        for k, _ in found:
            number += sum(w[-1] in _ENDS for w in words[at:k])
            at = k
            own.append(number)
        own = np.array(own)
        rows = np.array([self.rows[n] for _, n in found])
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        return np.maximum.reduceat(rows, first, axis=0)


def _vectors(words: _Words, texts: list) -> list[np.ndarray]:
    split = [words_of(t.decode()) if t else [] for t in texts]
    words.learn([w for own in split for w in own])
    return [words.sentences(own) for own in split]


def train(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, landmarks: int = LANDMARKS) -> dict:
    """A model of the documents that have a label 0 or 1, or of a hash sample of `sample` a class.

    The machine takes all sentences of those, or of a part of them with about SENTENCES a class.

    Null texts and labels are left out. Without texts of both classes every text gets the base score.
    """
    marks = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return {"landmarks": [], "base": rate}
    bound = F.when(F.col("y") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    ids = cut(marks.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < bound * 1_000_003))
    if ids.count() > 4 * sample:
        raise ValueError("the sample is far larger than its bound")
    # the sample is bounded, so its ids go to the documents and not the other way round
    rows = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    chosen = cut(rows.join(F.broadcast(ids), "id").select("text", "y"))

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        toxic, clean = Counter(), Counter()
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if y else clean).update({w.strip(_MARKS) for w in words_of(t)})
        names = [w for w in toxic.keys() | clean.keys() if w and len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[w] for w in names], pa.int64()), pa.array([clean[w] for w in names], pa.int64())], names=["word", "toxic", "clean"])

    counts = chosen.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    part = {y: max(1.0, min(sample, n)) for y, n in sizes.items()}
    score = F.col("toxic") * F.log((F.col("toxic") + 0.5) / part[1] / ((F.col("clean") + 0.5) / part[0]))
    marking = [r["word"] for r in counts.where("toxic >= 3").withColumn("s", score).where("s > 0").orderBy(F.desc("s"), "word").limit(8 * landmarks).collect()]
    picked = _landmarks(marking, landmarks)
    if not picked:
        return {"landmarks": [], "base": rate}
    kernel = Kernel(picked)
    shared = documents.sparkSession.sparkContext.broadcast(picked)

    def vectors(batches):
        import pyarrow as pa

        words = _Words(Kernel(shared.value))
        for batch in batches:
            found = _vectors(words, batch.column(0).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in found], pa.binary())], names=["y", "x"])

    length = F.size(F.split("text", r"[.!?\n]+"))
    shares = {r["y"]: min(1.0, SENTENCES / max(1, r["n"])) for r in chosen.groupBy("y").agg(F.sum(length).alias("n")).collect()}
    part = F.when(F.col("y") == 1, shares.get(1, 1.0)).otherwise(shares.get(0, 1.0))
    taken = chosen.where(F.pmod(F.xxhash64("text", "y"), F.lit(1_000_003)) < part * 1_000_003)
    data = taken.mapInArrow(vectors, "y int, x binary").collect()
    texts = [np.frombuffer(r["x"], np.float32).reshape(-1, len(picked)).astype(float) for r in data]
    return {"landmarks": picked, "base": rate} | _fit(kernel, texts, np.array([r["y"] for r in data]))


def _landmarks(words: list[str], most: int) -> list[str]:
    """Words in their order, without those that an earlier one is nearly equal to."""
    out: list[str] = []
    values = Kernel(words)(words) if words else np.zeros((0, 0))
    taken: list[int] = []
    for k, w in enumerate(words):
        if len(out) < most and (not taken or values[k, taken].max() < 0.8):
            out.append(w)
            taken.append(k)
    return out


def _fit(kernel: Kernel, texts: list[np.ndarray], y: np.ndarray) -> dict:
    """Nyström map, the machine over sentences, and a logistic curve over the texts' worst sentences."""
    own = kernel(kernel.landmarks)
    values, axes = np.linalg.eigh((own + own.T) / 2)
    values = np.maximum(values, 1e-3)
    whiten = axes @ np.diag(values**-0.5) @ axes.T
    texts = [x @ whiten for x in texts]
    empty = np.zeros((1, len(whiten)))
    negative = np.concatenate([empty, *[x for x, t in zip(texts, y) if t == 0 and len(x)]])
    worst = [x[np.argmax(np.linalg.norm(x, axis=1))] for x, t in zip(texts, y) if t == 1 and len(x)]
    w, b = np.zeros(len(whiten)), 0.0
    for _ in range(4):
        if not worst:
            break
        w, b = _machine(np.array(worst), negative)
        worst = [x[np.argmax(x @ w)] for x, t in zip(texts, y) if t == 1 and len(x)]
    margin = np.array([max((x @ w + b).max(initial=-9), b) for x in texts])
    slope, shift = _logistic(margin, y)
    return {"weights": whiten @ w, "bias": b, "slope": slope, "shift": shift}


def _machine(positive: np.ndarray, negative: np.ndarray, rounds: int = 400, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, classes weighed alike, by accelerated gradient steps."""
    x = np.concatenate([positive, negative])
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    c = np.concatenate([np.full(len(positive), 0.5 / len(positive)), np.full(len(negative), 0.5 / len(negative))])
    step = 1 / (2 * np.linalg.norm(x * np.sqrt(c)[:, None], 2) ** 2 + penalty)
    w = v = np.zeros(x.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (penalty * v - 2 * x.T @ (c * y * slack))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - y) * margin).sum() + 1e-2 * (a - 1), (p - y).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin**2).sum() + 1e-2, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return float(max(a, 1e-3)), float(b)


def score(documents: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """documents with score double (0 to 1) and predicted int (1 from the threshold on).

    Null and empty texts, and texts without a word like a landmark, get the
    score of an empty sentence. Repeated rows stay; columns of these names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        if not model["landmarks"]:
            return lambda texts: ([float(model["base"])] * len(texts), [int(model["base"] >= threshold)] * len(texts))
        words = _Words(Kernel(model["landmarks"]))

        def run(texts):
            margin = np.array([max((x @ model["weights"]).max(initial=0), 0) for x in _vectors(words, texts)]) + model["bias"]
            p = 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["shift"], -500, 500)))
            return p.tolist(), (p >= threshold).astype(int).tolist()

        return run

    return add_columns(documents, text, "score double, predicted int", make)
