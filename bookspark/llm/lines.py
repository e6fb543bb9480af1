"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

A line's signature comes from its character shingles at all positions: one
hash each, sorted on a circle. The circle has BANDS marks, and a band is the
next ROWS smallest hashes after a mark: a one-permutation MinHash, in which a
thin stretch borrows from the next. All lines that share a band are candidates
of each other; their Jaccard similarity is computed exactly over the same
shingles, and union-find over the pairs that pass keeps the first line of each
component.

A bucket's members are first compared with two leaders, which joins most
copies. Members that are then still in different components are compared with
each other: pair by pair in a small bucket, and in a crowded one by an exact
similarity join over what sets each line apart from the bucket's common text,
so that no pair that shares a band is left out. Pairs whose set sizes rule a
link out are dropped before their texts are fetched.

Shingles are SHINGLE UTF-16 units, so a character beyond the basic plane
counts as two, and they are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookspark.llm._shared import components, cut, small, stored, unused, without

BANDS = 11
ROWS = 6
SHINGLE = 5
SIMILARITY = 0.8
#: Lines with fewer characters between their white space are left alone; 1 leaves only blank lines alone.
LEAST_CHARS = 1
#: Open members of a bucket up to which its pairs are listed.
CROWD = 64

#: White space that is no part of a line.
_BLANK = " \t\r\f\v"


#: 32-bit hashes of a line's shingles that may fall together.
TOGETHER = 4


def shingles(line: Column, named: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Hashes of the line's shingles in order, repeats included; a line of fewer characters is one shingle."""

    def windows(units: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(units) - (2 * SHINGLE - 1), F.lit(1)), F.lit(2))
        return F.transform(starts, lambda at: named(F.substring(units, at, F.lit(2 * SHINGLE))))

    # the one-element array has the line encoded once, not for each window
    return F.get(F.transform(F.array(F.encode(line, "UTF-16BE")), windows), 0)


def banded(lines: DataFrame) -> DataFrame:
    """lines with size, the number of different shingles, and bands, an array of hashes; line is left out."""
    marks = [F.lit((k * ((1 << 32) // BANDS)) - (1 << 31)).cast("int") for k in range(BANDS)]
    kept = [c for c in lines.columns if c != "line"]
    # 32-bit hashes are enough to propose candidates
    out = lines.select(*kept, F.sort_array(F.array_distinct(shingles(F.col("line"), F.hash))).alias("__hashes"))
    out = out.select(*kept, F.concat("__hashes", F.slice("__hashes", 1, ROWS)).alias("__turned"), F.sort_array(F.concat("__hashes", F.array(*marks))).alias("__circle"))
    # as many hashes as stand before mark k stand before its run
    runs = [F.xxhash64(F.slice("__turned", F.array_position("__circle", m).cast("int") - k, ROWS)) for k, m in enumerate(marks)]
    return out.select(*kept, (F.size("__circle") - BANDS).alias("size"), F.array_distinct(F.array(*runs)).alias("bands"))


def possible(a: Column, b: Column) -> Column:
    """Sets of about these sizes can have a similarity of SIMILARITY; 32-bit hashes that fall together are allowed for."""
    return F.least(a, b) + TOGETHER >= SIMILARITY * (F.greatest(a, b) - TOGETHER)


def alike(a: Column, b: Column, n: Column) -> Column:
    """Two lines with n different shingles, each counted by itself, have a Jaccard similarity of SIMILARITY or more.

    Sets of n elements that have s in common have n / (1 + s) together.
    """
    return (1 + SIMILARITY) * F.size(F.array_union(shingles(a), shingles(b))) <= n + 1e-6


def _lines(documents: DataFrame, text: str, doc_id: str, least_chars: int) -> DataFrame:
    """(id, row, n, line, a, b): the lines that count; a and b are together a 128-bit name of the line's text."""
    rows = documents.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("row"), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("n", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(_BLANK))).where(F.length("line") >= least_chars)
    return rows.withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit(7), F.col("line"))})


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b, ...) of which the lines' Jaccard similarity is SIMILARITY or more, by texts(a, size, line)."""
    mine, its = (texts.select(F.col("a").alias(x), F.col("size").alias(f"n_{x}"), F.col("line").alias(f"l_{x}")) for x in "ab")
    n = F.col("n_a") + F.col("n_b")
    both = pairs.join(mine, "a").join(its, "b").where(possible(F.col("n_a"), F.col("n_b")))
    return both.where(alike(F.col("l_a"), F.col("l_b"), n)).select(*pairs.columns)


def crossing(crowded: DataFrame, texts: DataFrame) -> DataFrame:
    """crowded(a, c, band, first) -> (a, b, ca, cb): candidates of one band and different c; no link between components is lost.

    Buckets of one leader, first, share a common text: the shingles that two of
    three of its lines have. D, a line's difference from it, is small in near
    copies, and with x(a) = |D(a)| - (1 - s) / (1 + s) * |a| two lines have a
    similarity of s or more where x(a) + x(b) <= 2 * |D(a) and D(b) in common|.
    Where the left side is not above 0, a and b are both linked to the line of
    least x in their bucket. All others need a common difference. These go by
    rarity: the first of them stands early enough in both lines that as many as
    are needed can follow (prefix and position filter).
    """
    spots = crowded.select("a", "c", "first").distinct()
    sets = spots.join(texts.select("a", "line"), "a").select("a", "c", "first", F.array_distinct(shingles(F.col("line"))).alias("s"))
    three = spots.groupBy("first").agg(F.array_distinct(F.array(F.min("a"), F.max("a"), F.min_by("a", F.xxhash64("a")))).alias("a"))
    three = three.select("first", F.explode("a").alias("a")).join(texts.select("a", "line"), "a")
    three = three.groupBy("first").agg(F.collect_list(F.array_distinct(shingles(F.col("line")))).alias("s"))
    x, y, z = (F.coalesce(F.get("s", k), F.array().cast("array<bigint>")) for k in range(3))
    common = cut(three.select("first", F.array_union(F.array_union(F.array_intersect(x, y), F.array_intersect(x, z)), F.array_intersect(y, z)).alias("m")))
    own = sets.join(small(common, F.size("m")), "first", "left").withColumn("m", F.coalesce("m", F.array().cast("array<bigint>")))
    own = own.select("a", "c", "first", F.size("s").alias("size"), F.concat(F.array_except("s", "m"), F.array_except("m", "s")).alias("d"))
    own = cut(own.select("a", "c", "first", (F.size("d") - (1 - SIMILARITY) / (1 + SIMILARITY) * F.col("size")).alias("x"), "d"))

    placed = crowded.select("a", "c", "band", "first").join(own.select("a", "first", "x"), ["a", "first"])
    centres = placed.groupBy("band").agg(F.min(F.struct("x", "a", "c")).alias("least"))
    stars = placed.join(centres, "band").where((F.col("c") != F.col("least.c")) & (F.col("x") + F.col("least.x") <= 1e-6))
    stars = stars.select("a", F.col("least.a").alias("b"), F.col("c").alias("ca"), F.col("least.c").alias("cb")).distinct()

    # the least x that a partner, which is of another component, can have
    least = own.groupBy("first", "c").agg(F.min("x").alias("x"))
    best = least.groupBy("first").agg(F.min(F.struct("x", "c")).alias("best"))
    second = least.join(best, "first").where("c != best.c").groupBy("first").agg(F.min("x").alias("second"), F.first("best").alias("best"))
    need = F.greatest(F.lit(1), F.ceil((F.col("x") + F.when(F.col("c") == F.col("best.c"), F.col("second")).otherwise(F.col("best.x"))) / 2 - 1e-6)).cast("int")
    open_ = cut(own.join(small(cut(second)), "first").select("a", "c", "first", "x", "d", (F.size("d") - need + 1).alias("most")).where("most > 0"))
    # rows of differences are many, so that they are kept narrow
    terms = open_.select("a", "first", F.explode("d").alias("t")).withColumn("n", F.count("*").over(Window.partitionBy("first", "t")).cast("int"))
    ranked = terms.groupBy("a", "first").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("d")).join(open_.drop("d"), ["a", "first"])
    ranked = ranked.select("a", "c", "first", "x", F.size("d").alias("size"), F.posexplode(F.slice("d", F.lit(1), F.col("most"))).alias("at", "e"))
    # room: the common differences that there can be if this is the first
    heads = ranked.where("e.n > 1").select("first", F.col("e.t").alias("t"), "a", "c", "x", (F.col("size") - F.col("at")).alias("room"))
    its = heads.select("first", "t", F.col("a").alias("b"), F.col("c").alias("cb"), F.col("x").alias("y"), F.col("room").alias("its_room"))
    pairs = heads.withColumnRenamed("c", "ca").join(its, ["first", "t"]).where(
        (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.col("x") + F.col("y") > 0) & (2 * F.least("room", "its_room") >= F.col("x") + F.col("y") - 1e-6)
    )
    pairs = cut(pairs.select("a", "b", "ca", "cb").distinct())
    mine, theirs = (crowded.groupBy(F.col("a").alias(k)).agg(F.collect_set("band").alias(f"bands_{k}")) for k in "ab")
    pairs = pairs.join(mine, "a").join(theirs, "b").where(F.arrays_overlap("bands_a", "bands_b")).select("a", "b", "ca", "cb")
    return stars.unionByName(pairs)


def _pairs(rows: DataFrame, key: str) -> DataFrame:
    """rows(a, c, size, key) -> (a, b, ca, cb) of the same key and different c whose sizes allow a link."""
    pairs = rows.select("a", F.col("c").alias("ca"), F.col("size").alias("na"), key).join(rows.select(F.col("a").alias("b"), F.col("c").alias("cb"), F.col("size").alias("nb"), key), key)
    return pairs.where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & possible(F.col("na"), F.col("nb"))).select("a", "b", "ca", "cb").distinct()


def linked(signed: DataFrame, lines: DataFrame) -> DataFrame:
    """signed(a, size, bands) of lines(a, b, line) -> (node, component): components of a by all links of lines that share a band.

    Should two texts have one a, neither is linked, only copied exactly.
    """
    members = signed.select("a", "size", F.explode("bands").alias("band")).repartition("band")
    # the greatest size is for a plan with one exchange; a partition has at most half as many leaders' rows as members
    leaders = members.groupBy("band").agg(F.min("a").alias("first"), F.max("a").alias("other"), F.max("size").alias("most")).where("first < other and most >= 0")
    members = cut(members.join(leaders.hint("shuffle_hash"), "band").select("a", "size", "band", "first", "other"))
    named = cut(members.select("a").distinct())
    # where few lines have candidates, the others' texts are not shuffled
    texts = lines.select("a", "b", "line").join(small(named), "a").groupBy("a").agg(F.first("line").alias("line"), F.min("b").alias("x"), F.max("b").alias("y"))
    texts = cut(texts.where("x = y").select("a", "line", F.size(F.array_distinct(shingles(F.col("line")))).alias("size")))
    stars = members.select("a", F.explode(F.array("first", "other")).alias("leader")).where("a != leader")
    stars = stars.select(F.least("a", "leader").alias("a"), F.greatest("a", "leader").alias("b")).distinct()
    groups = cut(components(similar(stars, texts)))
    # leaders have met all others
    rest = members.where("a != first and a != other").select("a", "size", "band", "first").join(groups, F.col("a") == F.col("node"), "left").select("a", "size", "band", "first", F.coalesce("component", "a").alias("c"))
    counts = rest.groupBy("band").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low != high")
    rest = cut(rest.join(counts.select("band", "n"), "band"))
    few, crowded = rest.where(F.col("n") <= CROWD), rest.where(F.col("n") > CROWD).select("a", "c", "band", "first")
    pairs = _pairs(few, "band")
    if not crowded.isEmpty():
        pairs = pairs.unionByName(crossing(cut(crowded), texts)).distinct()
    joined = cut(components(similar(pairs, texts).select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    if joined.isEmpty():
        return groups
    moved = joined.select(F.col("node").alias("was"), F.col("component").alias("now"))
    alone = joined.join(groups.select("node"), "node", "left_anti")
    return groups.join(moved, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component")).unionByName(alone)


def repeated_lines(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, row, gone): by document, the numbers of its lines (from 0) that copy an earlier line, near or exact.

    A line is first by document id (null first), then by its place. Lines
    under least_chars code points, white space aside, are left alone.
    """
    lines = _lines(documents, text, doc_id, least_chars)
    # copies of a line are one row before its shingles are made
    known = lines.groupBy("a", "b").agg(F.min(F.struct("id", "row", "n")).alias("first"), F.count("*").alias("copies"), F.first("line").alias("line"))
    with stored(banded(known)) as known:
        groups = linked(known.select("a", "size", "bands"), lines)
        named = known.join(groups, F.col("a") == F.col("node"), "left").select("a", "b", "first", "copies", F.coalesce("component", "a").alias("c"), F.col("component").isNotNull().alias("near"))
        firsts = named.where("near").groupBy("c").agg(F.min("first").alias("kept"))
        copied = cut(named.where("copies > 1 or near").join(firsts, "c", "left").select("a", "b", F.coalesce("kept", "first").alias("kept")))
    gone = lines.select("id", "row", "n", "a", "b").join(copied, ["a", "b"]).where(~F.struct("id", "row", "n").eqNullSafe(F.col("kept")))
    return gone.groupBy("id", "row").agg(F.sort_array(F.collect_set("n")).alias("gone"))


def _cleaned(documents: DataFrame, text: str, doc_id: str, least_chars: int, n_lines: str, n_gone: str) -> DataFrame:
    """documents without their repeated lines, with their numbers under these names, which documents don't have."""
    gone = cut(repeated_lines(documents, text, doc_id, least_chars))
    row, its_id, its_row, numbers = unused(documents, "row", "id", "its_row", "numbers")
    body = F.col(f"`{text}`")
    gone = small(gone.select(F.col("id").alias(its_id), F.col("row").alias(its_row), F.col("gone").alias(numbers)), F.size(numbers))
    both = documents.withColumn(row, F.xxhash64(body)).join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col(its_id)) & (F.col(row) == F.col(its_row)), "left")
    left = F.array_join(F.filter(F.split(body, "\n"), lambda x, i: ~F.array_contains(numbers, i)), "\n")
    columns = [F.when(F.col(numbers).isNull(), body).otherwise(left).alias(c) if c == text else F.col(f"`{c}`") for c in documents.columns]
    return both.select(*columns, F.coalesce(F.size(F.split(body, "\n")), F.lit(0)).cast("long").alias(n_lines), F.coalesce(F.size(numbers), F.lit(0)).cast("long").alias(n_gone))


def deduplicate(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = LEAST_CHARS) -> DataFrame:
    """documents with n_lines, n_gone and the text without its repeated lines.

    A null text stays null, with no lines; an empty one has one line. Repeated rows
    share their lines' fate. Columns of the new names are replaced.
    """
    return _cleaned(without(documents, ["n_lines", "n_gone"]), text, doc_id, least_chars, "n_lines", "n_gone")


def drop_repeats(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = LEAST_CHARS) -> DataFrame:
    """documents without their repeated lines; one that loses every line with a word goes, one that had none stays."""
    n_lines, n_gone = unused(documents, "n_lines", "n_gone")
    out = _cleaned(documents, text, doc_id, least_chars, n_lines, n_gone)
    return out.where((F.col(n_gone) <= 0) | F.col(f"`{text}`").rlike(r"\S")).select(*[F.col(f"`{c}`") for c in documents.columns])
