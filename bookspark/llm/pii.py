"""Personal data by patterns and by bootstrapped context, in DataFrame functions only.

Base entities (email, ip, card, phone) come from fixed patterns. They seed a
bootstrapping: every identifier-like token, run of digit groups and base entity
stands in three lexical patterns: the two words before it, the words on both
sides, and the word before it with its own shape. Patterns and instances are a
graph. Its scores are computed in rounds: a pattern is as trustworthy as the
share of known instances of a kind among its instances, an instance as its
patterns together. Instances of trusted patterns that no base pattern finds
are added with the kind that they were found as.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.llm._shared import cut, small, unused, without

#: The base patterns. Possessive, which changes no match here but keeps long texts linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: Cheap tests without which a text has no entity of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

ROUNDS = 3
#: A pattern needs this many different known instances, and this share of all its instances; an instance this score.
LEAST_SEEDS, LEAST_SHARE, LEAST_SCORE = 3, 0.5, 0.8
#: Characters that an identifier-like token has at least.
SHORTEST = 5
#: Candidates beside the base entities: words with a digit or an @, and groups of digits with spaces between, as in cards and phones.
WORD = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_END = r"(?![^\s,;:!?])"
RUN = rf"(?<!\S)[+(]*+[0-9][0-9().+-]*+{_END}(?: ++\(?+[0-9][0-9().+-]*+{_END})++"
#: What stands in a pattern for a neighbouring word with a digit or an @, or for an entity.
SLOT = "#"

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The digits of a string pass the Luhn test."""
    doubled = F.transform(F.split(F.reverse(_digits(number)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(k: Column, found: Column) -> Column:
    """The match of the kind at this place of KINDS is an entity."""
    kind = dict(zip(KINDS, range(len(KINDS))))
    octets = found.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    return F.when(k == kind["ip"], octets).when(k == kind["card"], luhn(found)).when(k == kind["phone"], F.length(_digits(found)).between(9, 15)).otherwise(True)


def _totals(lengths: Column) -> Column:
    """Running totals of an array of numbers, array<bigint>: in chunks, so that long arrays are not copied for each element."""
    chunk = 256
    none = F.expr("cast(array() as array<bigint>)")

    def running(numbers: Column, start: Column) -> Column:
        add = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out"))
        return F.aggregate(numbers, F.struct(start.alias("at"), none.alias("out")), add, lambda a: a["out"])

    numbers = F.transform(lengths, lambda n: n.cast("long"))
    chunks = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / chunk).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    chunks = F.transform(chunks, lambda k: F.slice(numbers, k * chunk + 1, F.lit(chunk)))
    ends = running(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0).cast("long"))
    starts = F.concat(F.array(F.lit(0).cast("long")), ends)
    return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(starts) - 1), running))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _found(text: Column, searched: list[str], body: Callable[[Column], Column]) -> Column:
    """Array of body of struct<k, found, gaps, ends> of each pattern in `searched`: its place, matches, the text around them, and where they end in code points."""
    none = F.expr("cast(array() as array<string>)")
    needed = {PATTERNS[kind]: part for kind, part in NEEDS.items() if part}

    def one(k: int, pattern: str) -> Column:
        test = F.instr(text, needed[pattern]) > 0 if pattern in needed else F.lit(True)
        parts = F.struct(F.lit(k).alias("k"), F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
        return F.when(test & text.rlike(pattern), parts).otherwise(F.struct(F.lit(k).alias("k"), none.alias("gaps"), none.alias("found")))

    def placed(p: Column) -> Column:
        lengths = F.zip_with(p["gaps"], p["found"], lambda g, f: F.length(g) + F.coalesce(F.length(f), F.lit(0)))
        ends = _let(lengths, lambda n: F.slice(_totals(n), F.lit(1), F.size(p["found"])))
        return _let(F.struct(p["k"].alias("k"), p["found"].alias("found"), p["gaps"].alias("gaps"), ends.alias("ends")), body)

    return F.transform(F.array(*[one(k, pattern) for k, pattern in enumerate(searched)]), placed)


def entities(text: Column) -> Column:
    """array<struct<start, k, end>> of the base entities in code points, sorted; k is the kind's place in KINDS."""

    def spans(p: Column) -> Column:
        whole = F.zip_with(p["found"], p["ends"], lambda f, e: F.struct((e - F.length(f)).alias("start"), p["k"].alias("k"), e.alias("end"), f.alias("whole")))
        good = F.filter(whole, lambda m: _valid(m["k"], m["whole"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), m["k"].alias("k"), m["end"].alias("end")))

    return F.array_sort(F.flatten(_found(text, list(PATTERNS.values()), spans)))


def _beside(gap: Column) -> Column:
    """struct<last, second, first>: the gap's last word, the one before it, and its first word, empty where there is none.

    Punctuation between an entity and white space belongs to no word.
    """
    turned = r"^(?:[^A-Za-z0-9\s]++(?=\s|$))?+\s*+(\S++)?+(?:\s++(\S++))?+"

    def word(found: Column) -> Column:
        return F.when(found.rlike("[0-9@]"), F.lit(SLOT)).otherwise(F.lower(found))

    backwards = _let(F.reverse(gap), lambda g: F.array(*[word(F.reverse(F.regexp_extract(g, turned, n))) for n in (1, 2)]))
    return _let(backwards, lambda w: F.struct(F.get(w, 0).alias("last"), F.get(w, 1).alias("second"), word(F.regexp_extract(gap, r"^[^A-Za-z0-9\s]*+\s*+(\S++)", 1)).alias("first")))


def _in_context(p: Column) -> Column:
    """A pattern's part of _found() -> array<struct<start, end, token, k, second, last, next>>: its matches with two words before each and one after.

    Only the two gaps before a match and the one after it are looked at, so a
    text's work is linear; a match beyond an empty gap counts as a SLOT, and as two if it has white space.
    """

    def span(g: Column, f: Column, i: Column) -> Column:
        end, mine, was, slot = F.get(p["ends"], i), F.get(g, i), F.get(g, i - 1)["last"], F.lit(SLOT)
        earlier = lambda n: F.when(i >= n, slot).otherwise("")
        over = F.when(i < 1, "").when(F.get(p["found"], i - 1).rlike(r"\s"), slot).when(was != "", was).otherwise(earlier(2))
        last = F.when(mine["last"] != "", mine["last"]).otherwise(earlier(1))
        second = F.when(mine["second"] != "", mine["second"]).when(mine["last"] != "", earlier(1)).otherwise(over)
        after = F.get(g, i + 1)["first"]
        after = F.when(after != "", after).when(i + 1 < F.size(p["found"]), slot).otherwise("")
        return F.struct((end - F.length(f)).alias("start"), end.alias("end"), f.alias("token"), p["k"].alias("k"), second.alias("second"), last.alias("last"), after.alias("next"))

    return _let(F.transform(p["gaps"], _beside), lambda g: F.transform(p["found"], lambda f, i: span(g, f, i)))


def _meets(base: Column, start: Column, end: Column) -> Column:
    """[start, end) overlaps a span of `base`, an array of the kinds' sorted spans: the last one of a kind that starts before the end decides, found by bisection."""

    def last_before(spans: Column) -> Column:
        steps = F.sequence(F.ceil(F.log2(F.size(spans) + 1)).cast("int"), F.lit(1), F.lit(-1))
        ahead = lambda at, step: at + F.pow(F.lit(2), step - 1).cast("int")
        found = F.aggregate(steps, F.lit(-1), lambda at, step: F.when(F.get(spans, ahead(at, step))["start"] < end, ahead(at, step)).otherwise(at))
        return F.coalesce(F.get(spans, found)["end"] > start, F.lit(False))

    return F.exists(base, lambda spans: F.when(F.size(spans) > 0, last_before(spans)).otherwise(False))


def tokens(documents: DataFrame) -> DataFrame:
    """(id, row, text) -> (id, row, start, end, token, k, second, last, next): candidates and the words beside them.

    Base entities have their kind k, with inner spaces and wherever they are
    attached. Others are identifier-like: words and runs of digit groups of any
    length from SHORTEST on that no base entity overlaps, without punctuation at
    their ends. A neighbouring word with a digit or an @ is a SLOT, as entities are.
    """
    rows = documents.where(F.col("text").rlike("[0-9@]"))
    names, kinds = ("second", "last", "next"), len(KINDS)

    def trimmed(m: Column) -> Column:
        start = m["start"] + F.length(F.regexp_extract(m["token"], "^[^A-Za-z0-9+@(]*", 0))
        token = F.regexp_replace(m["token"], "^[^A-Za-z0-9+@(]+|[^A-Za-z0-9]+$", "")
        return _let(token, lambda t: F.struct(start.alias("start"), (start + F.length(t)).alias("end"), t.alias("token"), F.lit(None).cast("int").alias("k"), *[m[n].alias(n) for n in names]))

    def free(base: Column, others: Column) -> Column:
        good = F.filter(F.transform(F.flatten(others), trimmed), lambda m: (F.length(m["token"]) >= SHORTEST) & m["token"].rlike("[0-9@]"))
        return F.concat(F.flatten(base), F.filter(good, lambda m: ~_meets(base, m["start"], m["end"])))

    def known(of_kind: Column) -> Column:
        return F.filter(of_kind, lambda m: _valid(m["k"], m["token"]))

    every = _found(F.col("text"), [*PATTERNS.values(), WORD, RUN], _in_context)
    found = _let(every, lambda a: _let(F.transform(F.slice(a, 1, kinds), known), lambda base: free(base, F.slice(a, kinds + 1, 2))))
    # only the candidates leave a text's row
    return rows.select("id", "row", F.explode(found).alias("m")).select("id", "row", "m.*")


def shape(token: Column) -> Column:
    """The token with 9 for each digit and a for each run of letters."""
    return F.regexp_replace(F.regexp_replace(token, r"\p{L}++", "a"), r"\p{Nd}", "9")


def patterns() -> Column:
    """array<string> of the lexical patterns of a row of tokens(): two words before, words on both sides, word before and shape.

    A pattern has all its words, and one that is no SLOT.
    """
    def both(a: str, b: str) -> Column:
        return (F.col(a) != "") & (F.col(b) != "") & ((F.col(a) != SLOT) | (F.col(b) != SLOT))

    before = F.when(both("second", "last"), F.concat(F.lit("b:"), "second", F.lit(" "), "last"))
    around = F.when(both("last", "next"), F.concat(F.lit("a:"), "last", F.lit(" _ "), "next"))
    shaped = F.when((F.col("last") != "") & (F.col("last") != SLOT), F.concat(F.lit("s:"), "last", F.lit(" "), shape(F.col("token"))))
    return F.array_compact(F.array(before, around, shaped))


def discovered(found: DataFrame) -> DataFrame:
    """Rows of tokens() -> (token, k): instances that trusted patterns give a kind, base ones left out."""
    edges = cut(found.select("token", F.explode(patterns()).alias("pattern")).distinct())
    seeds = found.where("k is not null").groupBy("token").agg(F.min("k").alias("k")).withColumn("score", F.lit(1.0))
    seeds = cut(seeds)
    # only patterns of at least one seed can ever be trusted in the first round, and only their instances later
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    known = seeds
    for _ in range(ROUNDS):
        scored = edges.join(known, "token").groupBy("pattern", "k").agg(F.sum("score").alias("s"), F.count("*").alias("m")).where(F.col("m") >= LEAST_SEEDS)
        trusted = scored.join(sizes, "pattern").select("pattern", "k", (F.col("s") / F.col("n")).alias("share")).where(F.col("share") >= LEAST_SHARE)
        odds = F.sum(F.log(F.greatest(1 - F.col("share") * F.col("trust"), F.lit(1e-9))))
        # a pattern's share is damped by how many instances stand behind it
        trusted = trusted.join(sizes, "pattern").withColumn("trust", F.col("n") / (F.col("n") + 1))
        scores = edges.join(trusted.drop("n"), "pattern").groupBy("token", "k").agg((1 - F.exp(odds)).alias("score"))
        best = scores.groupBy("token").agg(F.max(F.struct("score", -F.col("k"))).alias("b")).select("token", (-F.col("b.col2")).alias("k"), F.col("b.score").alias("score"))
        new = best.join(seeds.select("token"), "token", "left_anti").where(F.col("score") >= LEAST_SCORE)
        known = cut(seeds.select("token", "k", "score").unionByName(new.select("token", "k", "score")))
    return known.join(seeds.select("token"), "token", "left_anti").select("token", "k")


def find(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """documents with base_spans and spans, array<struct<start, k, end>> sorted by start and kind.

    base_spans has the base patterns' entities, spans also what the contexts
    found where no base span is. Null and empty texts have none; repeated rows
    stay. Columns of these names are replaced.
    """
    kept = without(documents, ["base_spans", "spans"])
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = entities(body)
    rows = documents.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(body).alias("row"), body.alias("text"))
    found = cut(tokens(rows))
    new = found.where("k is null").drop("k").join(discovered(found), "token").select("id", "row", F.struct("start", "k", "end").alias("s"))
    its_row, its_id, its_row2, more = unused(kept, "row", "id", "row2", "more")
    new = cut(new.groupBy(F.col("id").alias(its_id), F.col("row").alias(its_row2)).agg(F.collect_set("s").alias(more)))
    all_rows = kept.withColumns({its_row: F.xxhash64(body), "base_spans": base})
    # few rows have more spans: then no text is shuffled
    both = all_rows.join(small(new, 3 * F.size(more)), F.col(f"`{doc_id}`").eqNullSafe(F.col(its_id)) & (F.col(its_row) == F.col(its_row2)), "left")
    by_kind = F.array(*[_of(F.col("base_spans"), kind) for kind in KINDS])
    free = _let(by_kind, lambda base: F.filter(more, lambda s: ~_meets(base, s["start"], s["end"])))
    spans = F.when(F.col(more).isNull(), F.col("base_spans")).otherwise(F.array_sort(F.concat("base_spans", free)))
    return both.select(*[F.col(f"`{c}`") for c in kept.columns], "base_spans", spans.alias("spans"))


def _of(spans: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.filter(spans, lambda s: s["k"] == k)


def count(spans: Column, kind: str) -> Column:
    """How many of the spans are of the kind."""
    return F.size(_of(spans, kind))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
