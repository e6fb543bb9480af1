"""Bootstrapped contexts held against plain Python, on small texts and by time on long ones."""

import math
import random
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from bookspark.llm import pii

ROWS = "doc_id long, text string"


def slot(word):
    return "#" if re.search("[0-9@]", word) else word.lower()


def test_words_beside_candidates(spark):
    texts = [
        "call  me on +44 20 7946 0958, or (x) me@a.org now",
        "me@a.org you@b.org",
        "ab12345",
        "x 4111 1111 1111 1111 me@a.org - end1x",
        "ids: 10.0.0.1\n\nnext=77777 ok",
        "1 2 3 44444 5x9999",
    ]
    got = defaultdict(set)
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, row long, text string")
    for r in pii.tokens(docs).collect():
        assert texts[r["id"]][r["start"] : r["end"]] == r["token"]
        got[r["id"]].add((r["token"], r["k"], r["second"], r["last"], r["next"]))
    assert got[0] == {("+44 20 7946 0958", 3, "me", "on", "or"), ("me@a.org", 0, "or", "(x)", "now")}
    assert got[1] == {("me@a.org", 0, "", "", "#"), ("you@b.org", 0, "", "#", "")}
    assert got[2] == {("ab12345", None, "", "", "")}
    assert got[3] == {("4111 1111 1111 1111", 2, "", "x", "#"), ("me@a.org", 0, "#", "#", "-"), ("end1x", None, "#", "-", "")}
    assert got[4] == {("10.0.0.1", 1, "", "ids:", "#"), ("next=77777", None, "ids:", "#", "ok")}
    assert got[5] == {("44444", None, "#", "#", "#"), ("1 2 3 44444", None, "", "", "#"), ("5x9999", None, "#", "#", "")}


def test_graph_scores_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "#", ""]
    rows = []
    for _ in range(600):
        n = rng.randrange(60)
        token = f"id-{n}" if n % 3 else f"u{n}@x.org"
        rows.append((token, None if n % 3 else 0, *[rng.choice(words) for _ in range(3)]))
    rows += [(f"u{n}@x.org", 0, "write", "to", "now") for n in range(0, 60, 3)] + [(t, None, "write", "to", "now") for t in ("id-1", "id-2")]
    rows += [(f"+1 555 000 {n:04}", 3, "please", "ring", "soon") for n in range(12)] + [("555 000 7777", None, "please", "ring", "soon"), ("id-4", None, "please", "ring", "then")]
    got = {tuple(r) for r in pii.discovered(spark.createDataFrame(rows, "token string, k int, second string, last string, next string")).collect()}

    edges = defaultdict(set)
    for token, _, second, last, after in rows:
        shape = re.sub("[0-9]", "9", re.sub("[A-Za-z]+", "a", token))
        for a, b, name in ((second, last, f"b:{second} {last}"), (last, after, f"a:{last} _ {after}")):
            if a and b and (a, b) != ("#", "#"):
                edges[name].add(token)
        if last not in ("", "#"):
            edges[f"s:{last} {shape}"].add(token)
    seeds = {}
    for token, k, *_ in rows:
        if k is not None:
            seeds[token] = min(k, seeds.get(token, 9))
    known = {t: (k, 1.0) for t, k in seeds.items()}
    for _ in range(pii.ROUNDS):
        odds = defaultdict(float)
        for own in edges.values():
            by_kind = defaultdict(list)
            for t in own:
                if t in known:
                    by_kind[known[t][0]].append(known[t][1])
            for k, scores in by_kind.items():
                share = sum(scores) / len(own)
                if len(scores) >= pii.LEAST_SEEDS and share >= pii.LEAST_SHARE:
                    for t in own:
                        odds[t, k] += math.log(max(1 - share * len(own) / (len(own) + 1), 1e-9))
        best = {}
        for (t, k), s in odds.items():
            best[t] = max(best.get(t, (-1, 0)), (1 - math.exp(s), -k))
        known = {t: (k, 1.0) for t, k in seeds.items()} | {t: (-k, s) for t, (s, k) in best.items() if t not in seeds and s >= pii.LEAST_SCORE}
    want = {(t, k) for t, (k, _) in known.items() if t not in seeds}
    assert got == want and {("id-1", 0), ("id-2", 0), ("555 000 7777", 3)} <= want


def test_shapes_and_long_identifiers_are_found(spark):
    long = "x-" * 60 + "9"
    luhn = lambda n: sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(str(n)[::-1])) % 10 == 0
    cards = [str(n) for n in range(4111_1111_1111_1113, 4111_1111_1111_1313) if luhn(n)][:10]
    texts = [f"{w} card {c[:4]} {c[4:8]} {c[8:12]} {c[12:]}" for w, c in zip("abcdefghij", cards)]
    texts += ["k card 4111 1111 1111 1112", *(f"please write to me{k}@x.org today" for k in range(8)), f"please write to {long} today", "card 12345"]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), ROWS)).select("doc_id", pii.written(F.col("spans")).alias("s"))
    found = dict(map(tuple, got.collect()))
    assert found[10] == "card:7:26" and found[19] == f"email:16:{16 + len(long)}" and found[20] == ""


def test_long_texts_take_linear_time(spark):
    def seconds(n):
        text = " ".join(f"word{k} plain me{k}@x.org 10.0.{k % 256}.7" for k in range(n // 4))
        docs = spark.createDataFrame([(1, text)], ROWS)
        began = time.time()
        assert pii.tokens(docs.selectExpr("doc_id as id", "doc_id as row", "text")).count() == 3 * (n // 4)
        return time.time() - began

    seconds(4000)
    assert seconds(64_000) <= 4 * seconds(16_000) * 1.5 + 2
