"""Fill-in-the-middle examples: two cuts at unit boundaries, found on a wavelet matrix over character classes.

A character's class says whether it is white space, whether it ends a word unit
and whether it ends a line. The classes of a run of texts make one wavelet
matrix, of a bit plane a class bit. How many units end before a place is a sum
of rank queries, one for each class that ends such a unit; the place of the
k-th end is a select where one class ends units, and a bisection on those sums
where several do. All texts of the run are asked at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookspark.llm._shared import parts, unused, without

#: Class bits of a character.
WHITE, WORD_END, LINE_END = 1, 2, 4
PLANES = 3
#: The class bit that ends a unit of each kind; every character is a unit of its own in "char".
UNITS = {"word": WORD_END, "line": LINE_END, "char": 0}
#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Code points of white space.
_BLANK = np.array([9, 10, 11, 12, 13, 32], np.uint32)


class Bits:
    """A bit vector in words of 64 bits with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        room = np.zeros(-(-(self.size + 1) // 64) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        room[: len(packed)] = packed
        self.words = room.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """rank and select of small codes, many queries at a time."""

    def __init__(self, codes: np.ndarray, planes: int = PLANES):
        self.size, self.planes = len(codes), []
        for level in reversed(range(planes)):
            bits = (codes >> level) & 1
            self.planes.append((level, Bits(bits)))
            # a stable partition: zeros of the plane first
            codes = np.concatenate([codes[bits == 0], codes[bits == 1]])

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How often the code stands before each place."""
        low, high = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for level, plane in self.planes:
            if (code >> level) & 1:
                zeros = plane.size - plane.ones
                low, high = zeros + plane.rank1(low), zeros + plane.rank1(high)
            else:
                low, high = low - plane.rank1(low), high - plane.rank1(high)
        return high - low

    def select(self, code: int, k: np.ndarray) -> np.ndarray:
        """The place of each k-th (from 1) of the code; size where there are fewer."""
        return first_place(lambda at: self.rank(code, at), np.asarray(k, np.int64), np.zeros(len(k), np.int64), np.full(len(k), self.size, np.int64)) - 1


def first_place(count, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest place in [low, high] before which count() is `wanted` or more, by bisection; high + 1 if there is none."""
    low, last, high = low.copy(), high, high + 1
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        enough = (count(np.minimum(middle, last)) >= wanted) & open_
        high = np.where(enough, middle, high)
        low = np.where(open_ & ~enough, middle + 1, low)
    return low


def classes(letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each code point of texts that lie behind each other and end (exclusive) at `ends`."""
    white = np.isin(letters, _BLANK)
    last = np.zeros(len(letters), bool)
    last[ends[ends > np.concatenate([[0], ends[:-1]])] - 1] = True
    next_white = np.concatenate([white[1:], [True]]) | last
    word_end = (~white & next_white) | last
    return (white * WHITE + word_end * WORD_END + ((letters == 10) | last) * LINE_END).astype(np.uint8)


class Boundaries:
    """The unit boundaries of texts behind each other."""

    def __init__(self, texts: list[str], unit: str):
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        bit = UNITS[unit]
        self.matrix = WaveletMatrix(classes(letters, self.ends)) if bit else None
        self.enders = [c for c in range(1 << PLANES) if c & bit]
        self.base = self.count(self.starts)
        self.units = self.count(self.ends) - self.base

    def count(self, at: np.ndarray) -> np.ndarray:
        """Units that end before each place."""
        if self.matrix is None:
            return np.asarray(at, np.int64)
        return sum(self.matrix.rank(c, at) for c in self.enders)

    def place(self, units: np.ndarray) -> np.ndarray:
        """Code points that each text's first `units` units have."""
        if self.matrix is None:
            return units
        return first_place(self.count, self.base + units, self.starts, self.ends) - self.starts


def draws(key: str | Column, seed: int = 42) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: the first groups of eight hex digits of sha256 of `seed:key`; a null key counts as an empty text."""
    key = F.col(f"`{key}`") if isinstance(key, str) else key
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(documents: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, unit: str = "word", rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """documents with n_units long, form string, cut_1 and cut_2 long, output string; columns of these names are replaced.

    A text is cut before and after its middle, at two boundaries drawn by the
    row's key, so that a task that is run again cuts alike. Units are words with
    the white space before them (and a text's last white space), lines with
    their end, or characters. `rate` of 100 texts are rearranged, `spm_rate` of
    100 of those with the suffix first. The cuts are code points, also of
    plain texts.

    Null and empty texts, and texts that contain a mark, stay plain; a null text
    gives an empty output. Repeated rows with a key are cut alike. The text is
    never shortened: output and form give it back, see restored().
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    new = ["n_units", "form", "cut_1", "cut_2", "output"]
    kept = without(documents, new)
    body, names = F.coalesce(F.col(f"`{text}`"), F.lit("")), unused(documents, "h1", "h2", "h3", "h4", "body")
    drawn = kept.select(*[F.col(f"`{c}`") for c in kept.columns], *[h.alias(n) for h, n in zip(draws(key, seed), names)], body.alias(names[4]))
    schema = T.StructType([*drawn.schema.fields, *T.StructType.fromDDL("n_units long, cut_1 long, cut_2 long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.num_columns - 1).to_pylist()
            h1, h2 = (batch.column(batch.num_columns - k).to_numpy(zero_copy_only=False) for k in (5, 4))
            out, done = [], 0
            for own in parts(texts):
                b, rows = Boundaries(own, unit), slice(done, done + len(own))
                x, y = h1[rows] % (b.units + 1), h2[rows] % (b.units + 1)
                out.append((b.units, b.place(np.minimum(x, y)), b.place(np.maximum(x, y))))
                done += len(own)
            columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[f.name for f in schema.fields])

    cut = drawn.mapInArrow(run, schema)
    t = F.col(names[4])
    marked = t == ""
    for m in MARKS:
        marked = marked | t.contains(m)
    form = F.when(marked | (F.col(names[2]) % 100 >= rate), PLAIN).when(F.col(names[3]) % 100 < spm_rate, SPM).otherwise(PSM)
    return cut.select(*[F.col(f"`{c}`") for c in kept.columns], "n_units", form.alias("form"), "cut_1", "cut_2", arranged(t, form, F.col("cut_1"), F.col("cut_2")).alias("output"))


def arranged(text: Column, form: Column, cut_1: Column, cut_2: Column) -> Column:
    """The example of a text with cuts after cut_1 and cut_2 code points."""
    first, second = cut_1.cast("int"), cut_2.cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text of an example, from its marks and form alone."""
    inside = lambda a, b: F.split_part(F.split_part(output, F.lit(a), F.lit(2)), F.lit(b), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(inside(PREFIX, SUFFIX), middle, inside(SUFFIX, MIDDLE))
    spm = F.concat(inside(PREFIX, MIDDLE), middle, inside(SUFFIX, PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
