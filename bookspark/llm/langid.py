"""Language identification of mixed texts: scripts, word scores and Viterbi.

Training counts the letter scripts and the character trigrams of words by
language. For a text, the script of each word's letters leaves the languages
that are written in it; each word then has a score for each of them, and a
Viterbi pass with a penalty for switching labels spans of words. The language
of most letters is the text's.
"""

from __future__ import annotations

from collections import Counter
from functools import cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.llm._shared import add_columns, parts

#: Labelled texts of one language that training takes at most, on average: a bounded sample by hash of the text.
SAMPLE = 3000
#: Score that a change of language costs, and the most that one word can say.
SWITCH, MOST = 6.0, 8.0
#: Distinct words that a training task counts before it turns them into trigrams.
HELD = 200_000
#: A language is a candidate for a script if it has this share of its letters in it.
SCRIPT_SHARE = 0.01

#: The first and last code points of scripts' letters (Unicode blocks).
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F),
    ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)


#: Scripts by number; 1 is any other.
NAMES = ["none", "other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
#: Words of a text whose passes run beside each other, and the most numbers that a block of such runs has.
RUN, BLOCK = 64, 2_000_000


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it counts in trigrams, and its script's number if it is a letter (0: none, 1: other)."""
    letter = np.array([chr(o).isalpha() for o in range(0x110000)])
    script = letter.astype(np.uint8)
    for name, a, b in SCRIPTS:
        script[a : b + 1][letter[a : b + 1]] = NAMES.index(name)
    keep = letter.copy()
    keep[0x80:] = True
    return keep, script


def read_words(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of distinct words that hold no white space, as numbers, and the word of each; then each word's script and letters.

    A trigram is a letter, or other character beyond ASCII, with its
    neighbours in the word or the word's border. Characters that do not count are passed over.
    """
    keep, script = _alphabet()
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    border = points == 32
    owner = np.cumsum(border) - 1
    kinds = script[points]
    at = np.flatnonzero(kinds)
    letters = np.bincount(owner[at], minlength=len(words))
    first = at[np.flatnonzero(np.diff(owner[at], prepend=-1))]
    scripts = np.zeros(len(words), np.int64)
    scripts[owner[first]] = kinds[first]
    chosen = keep[points] | border
    points, owner = points[chosen], owner[chosen]
    mid = np.flatnonzero(points != 32)
    return (points[mid - 1] << 42) | (points[mid] << 21) | points[mid + 1], owner[mid], scripts, letters[: len(words)]


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(keys, return_inverse=True)
    return own, np.bincount(at, weights, len(own)).astype(np.int64)


def train(documents: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> dict:
    """The model of all labelled rows given, or of a hash sample of `sample` a language; so that it is bounded by the sample.

    Rows with a null text or label are left out. Without rows there is no language.
    """
    rows = documents.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "keys": np.zeros(0, np.int64), "scores": np.zeros((1, 0)), "allowed": np.ones((len(NAMES), 0), bool)}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003)

    def count(batches):
        import pyarrow as pa

        seen: dict[str, Counter] = {}

        def totals():
            for name, words in seen.items():
                keys, owner, scripts, letters = read_words(list(words))
                times = np.fromiter(words.values(), np.int64, len(words))
                for kind, (own, n) in (("g", _sums(keys, times[owner])), ("s", _sums(scripts, times * letters))):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array([kind] * len(own), pa.string()), pa.array(own), pa.array(n)], names=["lang", "kind", "item", "n"])
            seen.clear()

        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(name, Counter()).update(t.lower().split())
                if sum(map(len, seen.values())) > HELD:
                    yield from totals()
        yield from totals()

    counts = chosen.mapInArrow(count, "lang string, kind string, item long, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    at = {name: k for k, name in enumerate(langs)}
    found = [(r["kind"], r["item"], at[r["lang"]], r["n"]) for r in counts.collect()]
    keys = np.array(sorted({item for kind, item, _, _ in found if kind == "g"}), np.int64)
    table, letters = np.zeros((len(keys) + 1, len(langs))), np.zeros((len(NAMES), len(langs)))
    for kind, item, l, n in found:
        if kind == "g":
            table[np.searchsorted(keys, item), l] = n
        else:
            letters[item, l] = n
    scores = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table)))
    allowed = letters / np.maximum(letters.sum(axis=0), 1) >= SCRIPT_SHARE
    return {"langs": langs, "keys": keys, "scores": scores, "allowed": allowed | ~allowed.any(axis=1, keepdims=True)}


def word_scores(model: dict, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The score of each language for each of some distinct words, the best 0, and the words' letters; without letters all are 0."""
    grams, owner, scripts, letters = read_words(words)
    out = np.zeros((len(words), len(model["langs"])))
    if not len(grams):
        return out, letters
    keys = model["keys"]
    at = np.searchsorted(keys, grams)
    at[np.append(keys, -1)[at] != grams] = len(keys)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    own = owner[starts]
    sums = np.add.reduceat(model["scores"][at], starts, axis=0)
    sums = np.maximum(sums - sums.max(axis=1, keepdims=True), -MOST)
    sums[~model["allowed"][scripts[own]]] = -2 * MOST
    out[own] = sums
    out[letters == 0] = 0
    return out, letters


def _passes(now: np.ndarray, active: np.ndarray, rows, switch: float, kept: list | None = None) -> np.ndarray:
    """Forward pass over runs of falling lengths: now is (..., labels, runs), active[t] the runs longer than t; kept takes the values before each word."""
    for t, m in enumerate(active.tolist()):
        own = now[..., :m]
        if kept is not None:
            kept.append(own.copy())
        np.maximum(own, own.max(axis=-2, keepdims=True) - switch, out=own)
        own += rows(t, m)
    return now


def viterbi(scores: np.ndarray, words: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; texts of `sizes` words follow each other, and `words` are rows of scores.

    Texts are cut into runs that all pass beside each other: first from every
    label, for the best value between any two ends of a run; those give each
    text's best labels at its cuts, and a second pass from these the words between.
    The result is that of one pass over the whole text.
    """
    labels = scores.shape[1]
    counts = -(-sizes // RUN)
    text = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(text)) - (np.cumsum(counts) - counts)[text]
    starts = (np.cumsum(sizes) - sizes)[text] + place * RUN
    lengths = np.minimum(RUN, sizes[text] - place * RUN)
    order = np.argsort(-lengths, kind="stable")
    step = max(1, BLOCK // (labels * labels))
    blocks = []
    for k in range(0, len(order), step):
        runs = order[k : k + step]
        active = np.searchsorted(-lengths[runs], -np.arange(lengths[runs[0]]), side="left")
        blocks.append((runs, active, lambda t, m, first=starts[runs]: scores[words[first[:m] + t]].T))
    between = np.zeros((len(text), labels, labels))
    for runs, active, rows in blocks:
        now = np.full((labels, labels, len(runs)), -np.inf)
        now[np.arange(labels), np.arange(labels)] = 0
        between[runs] = np.moveaxis(_passes(now, active, rows, switch), -1, 0)
    texts = np.argsort(-counts, kind="stable")
    live = np.searchsorted(-counts[texts], -np.arange(counts.max(initial=0)), side="left")
    heads = (np.cumsum(counts) - counts)[texts]
    value, came = np.zeros((len(sizes), labels)), np.zeros((len(text), labels), np.int64)
    for j, m in enumerate(live.tolist()):
        ways = value[:m, :, None] + between[heads[:m] + j]
        came[heads[:m] + j] = ways.argmax(axis=1)
        value[:m] = ways.max(axis=1)
    last, first_of, last_of = value.argmax(axis=1), np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    for j in range(len(live) - 1, -1, -1):
        m = live[j]
        at = heads[:m] + j
        last_of[at] = last[:m]
        last[:m] = first_of[at] = came[at, last[:m]]
    out = np.zeros(len(words), np.int64)
    for runs, active, rows in blocks:
        now, kept = np.full((labels, len(runs)), -np.inf), []
        now[first_of[runs], np.arange(len(runs))] = 0
        _passes(now, active, rows, switch, kept)
        label = last_of[runs]
        for t in range(len(active) - 1, -1, -1):
            before, m = kept[t], active[t]
            out[starts[runs[:m]] + t] = label[:m]
            best = before.argmax(axis=0)
            lane = np.arange(m)
            label[:m] = np.where(before[best, lane] - switch > before[label[:m], lane], best, label[:m])
    return out


def identify(documents: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """documents with lang_pred, score and lang_spans (words from start to before end, and their language).

    score is the share of letters in the predicted language's spans. A text
    that is null or has no letter is `und` with score 0, and so are all
    texts under a model without languages. Words are what white space parts.
    Repeated rows stay; columns of these names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        import pyarrow as pa

        model = shared.value
        langs, names = model["langs"], pa.array([*model["langs"], "und"], pa.string())

        def some(texts: list) -> tuple[np.ndarray, np.ndarray, pa.Array]:
            parted = [t.decode().lower().split() if t and langs else [] for t in texts]
            sizes = np.array([len(w) for w in parted], np.int64)
            numbers = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(parted)))}
            words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(parted)), np.int64, int(sizes.sum()))
            scores, letters = word_scores(model, list(numbers))
            labels = viterbi(scores, words, sizes)
            owner = np.repeat(np.arange(len(texts)), sizes)
            width = max(1, len(langs))
            weight = np.bincount(owner * width + labels, letters[words], len(texts) * width).reshape(len(texts), width)
            total = weight.sum(axis=1)
            pred = np.where(total > 0, weight.argmax(axis=1), len(langs))
            lead = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
            ends = np.append(lead, len(words))[1:]
            spoken = total[owner[lead]] > 0
            lead, ends = lead[spoken], ends[spoken]
            base = (np.cumsum(sizes) - sizes)[owner[lead]]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[lead], minlength=len(texts)))])
            spans = pa.StructArray.from_arrays([pa.array(lead - base), pa.array(ends - base), names.take(pa.array(labels[lead]))], names=["start", "end", "lang"])
            return pred, weight.max(axis=1) / np.maximum(total, 1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)

        def run(texts):
            pred, score, spans = zip(*map(some, parts(texts)))
            return [names.take(pa.array(np.concatenate(pred))), pa.array(np.concatenate(score)), pa.concat_arrays(spans)]

        return run

    return add_columns(documents, text, "lang_pred string, score double, lang_spans array<struct<start: long, end: long, lang: string>>", make)
