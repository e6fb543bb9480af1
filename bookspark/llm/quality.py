"""Quality rules, with repetition from a suffix array.

The words of a batch of texts are numbered, each text's apart, and sorted
into one suffix array by prefix doubling. The longest common prefixes of
neighbouring suffixes give the maximal repeated runs of words; the union of
their spans is what the text repeats. Texts are independent: no shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from bookspark.llm._shared import add_columns, numbered, parts

#: Characters that count as symbols (a fixed value).
SYMBOLS = "#*$%&|<>"
_SPLIT = bytes(32 if b in b" \t\n\v\f\r" else b for b in range(256))
_SYMBOL = SYMBOLS.encode()
_LINES = bytes(32 if b in b" \t\v\f\r" else b for b in range(256))


def repeats(numbers: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run from it that starts elsewhere in its text too.

    numbers: the texts' words as numbers, one text after the other; texts:
    the number of each word's text. Runs may overlap.
    """
    n = len(numbers)
    if n == 0:
        return np.zeros(0, np.int64)
    ends = np.searchsorted(texts, texts, side="right")  # of each word's text
    _, rank = np.unique(texts.astype(np.int64) * (int(numbers.max()) + 1) + numbers, return_inverse=True)
    counts = np.bincount(rank)
    rank = (np.cumsum(counts) - counts)[rank]  # the first place of each suffix's group
    levels, size = [], 1
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while True:
        levels.append(rank)  # equal for suffixes whose first `size` words are equal
        if not len(tied):
            break
        after = tied + size
        second = np.where(after < ends[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[tied]
        order = np.lexsort((second, first))
        tied, first, second = tied[order], first[order], second[order]
        place = np.arange(len(tied))
        group = np.concatenate([[True], first[1:] != first[:-1]])
        part = group | np.concatenate([[True], second[1:] != second[:-1]])
        rank = rank.copy()
        rank[tied] = first + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        alone = part & np.concatenate([part[1:], [True]])
        tied = tied[~alone]
        size *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(texts[a] == texts[b])
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[live] + common[live], b[live] + common[live]
        inside = (x + (1 << k) <= ends[a[live]]) & (y + (1 << k) <= ends[b[live]])
        same = np.zeros(len(live), bool)
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        common[live[same]] += 1 << k
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def measures(text: bytes | None, words: list[bytes]) -> tuple[int, int, int]:
    """Code points in words, symbols, and lines with a word that equal an earlier one."""
    if not text:
        return 0, 0, 0
    characters = len(b"".join(words).decode())
    symbols = len(text) - len(text.translate(None, _SYMBOL))
    seen, repeated = set(), 0
    for line in text.split(b"\n"):
        if line.translate(_LINES).strip(b" "):
            if line in seen:
                repeated += 1
            seen.add(line)
    return characters, symbols, repeated


def score(documents: DataFrame, text: str = "text", window: int = 5, least_words: int = 10, most_repeated: int = 20, longest: int = 200) -> DataFrame:
    """documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat, base_failed and kept.

    n_repeat_words: words inside repeated runs of at least `window` words, the
    first occurrence included. base_failed: fewer than least_words words, or
    more than most_repeated percent of them repeated. The method's verdict
    adds that no run of more than `longest` words may come twice. A null or
    empty text has no words and fails. Repeated rows stay; columns of these
    names are replaced.
    """
    new = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, base_failed boolean, kept boolean"

    def make():
        def run(texts):
            rows: list[tuple] = []
            for part in parts(texts, 2_000_000):
                rows += _measured(part, window, least_words, most_repeated, longest)
            return [list(c) for c in zip(*rows)]

        return run

    return add_columns(documents, text, new, make)


def _measured(texts: list, window: int, least_words: int, most_repeated: int, longest: int) -> list[tuple]:
    words = [t.translate(_SPLIT).split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    number: dict[bytes, int] = {}
    numbers = np.array([number.setdefault(w, len(number)) for own in words for w in own], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    runs = repeats(numbers, owner)
    edges = np.zeros(len(numbers) + 1, np.int64)
    starts = np.flatnonzero(runs >= window)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + runs[starts], -1)
    covered = np.cumsum(edges[:-1]) > 0
    repeated = np.bincount(owner[covered], minlength=len(texts))
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, owner, runs)
    out = []
    for t, own, n, r, m in zip(texts, words, sizes.tolist(), repeated.tolist(), most.tolist()):
        failed = n < least_words or 100 * r > most_repeated * n
        out.append((n, *measures(t, own), r, m, failed, not failed and m <= longest))
    return out


def keep(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """documents that the rules keep, with their own columns, of any name."""
    plain, text, restored = numbered(documents, text)
    return score(plain, text, **options).where("kept").select(*restored)
