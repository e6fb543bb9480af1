"""References to explained titles inside running text, against a scan of each text with each title."""

import random
import re
import time

from pyspark.sql import functions as F

from bookspark.operators import notes

NOTES = "book_id string, node int, ord int, title string, note string"


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def referred(rows):
    """book -> node -> note, by scanning."""
    out = {}
    for book, node, order, _, note in rows:
        firsts = {}
        for b, _, o, t, n in sorted(rows, key=lambda r: r[2]):
            if b == book and n.strip() and words(t):
                firsts.setdefault(tuple(words(t)), (o, t))
        titles = [(w, t) for w, (o, t) in firsts.items() if o < order]
        lines = []
        for line in note.split("\n"):
            spans = [m.span() for m in re.finditer(r"[^\W_]+", line)]
            own, at, kept = words(line), 0, []
            while at < len(own):
                fits = [(len(w), t) for w, t in titles if tuple(own[at : at + len(w)]) == w]
                if fits:
                    size, t = max(fits)
                    kept.append((at, size, t))
                    at += size
                else:
                    at += 1
            if len(kept) == 1 and kept[0][1] == len(own):
                lines.append(f"- See [{kept[0][2]}] for details")
                continue
            for at, size, t in reversed(kept):
                end = spans[at + size - 1][1]
                line = line[:end] + f" (see [{t}] for details)" + line[end:]
            lines.append(line)
        out[book, node] = "\n".join(lines)
    return out


def test_titles_in_sentences_get_their_reference(spark):
    rows = [
        ("b", 0, 0, "Fourier transform", "- Waves add up."),
        ("b", 1, 1, "Transform", "- Something else."),
        ("b", 2, 2, "Sound", "- see the Fourier transform below, and transforms\n- FOURIER TRANSFORM.\n- a transform, (Fourier) Transform!"),
        ("b", 3, 3, "Fourier transform", "- again, Sound"),
        ("b", 4, 4, "Never", ""),
        ("c", 5, 9, "Other", "- see the Fourier transform, never"),
    ]
    got = {(r["book_id"], r["node"]): r["note"] for r in notes.refer_to_explained(spark.createDataFrame(rows, NOTES)).collect()}
    assert got["b", 2] == "- see the Fourier transform (see [Fourier transform] for details) below, and transforms\n- See [Fourier transform] for details\n- a transform (see [Transform] for details), (Fourier) Transform (see [Fourier transform] for details)!"
    assert got["b", 3] == "- again, Sound (see [Sound] for details)" and got["c", 5] == "- see the Fourier transform, never"
    assert got == referred(rows)


def test_references_against_a_scan(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(["ab", "Ab", "cd.", "é", "x", "(y)"]) for _ in range(rng.randint(1, n)))
    rows = [("b" if k % 4 else "c", k, k, text(3), "" if k % 9 == 8 else "\n".join(f"- {text(9)}" for _ in range(rng.randint(1, 3)))) for k in range(50)]
    got = {(r["book_id"], r["node"]): r["note"] for r in notes.refer_to_explained(spark.createDataFrame(rows, NOTES)).collect()}
    assert got == referred(rows)


def test_detailed_notes_end_with_relations(spark):
    rows = spark.createDataFrame([("A", "One. Two.", "detailed", "B (explains)"), ("A", "One. Two.", "short", "B (explains)"), ("A", "One.", "detailed", notes.UNRELATED), ("A", "", "detailed", "B (explains)")], "t string, c string, d string, r string")
    got = [r[0] for r in rows.select(notes.write_notes(F.col("t"), F.col("c"), F.col("d"), F.col("r"))).collect()]
    assert got == ["- One.\n- Two.\n- Related: B (explains)", "- One.\n- Two.", "- One.", ""]


def test_plan_has_equi_joins_only(spark):
    rows = spark.createDataFrame([("b", 0, 0, "A", "- a")], NOTES)
    plan = notes.refer_to_explained(rows)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_long_bullet_is_cut_once(spark):
    words = 60_000
    rows = [("b", 0, 0, "Tort", "- A wrong."), ("b", 1, 1, "Long", "- " + "word " * words + "tort")]
    began = time.time()
    got = {r["node"]: r["note"] for r in notes.refer_to_explained(spark.createDataFrame(rows, NOTES)).collect()}
    assert got == {0: "- A wrong.", 1: "- " + "word " * words + "tort (see [Tort] for details)"}
    assert time.time() - began < 40


def test_words_of_texts_are_not_shuffled(spark):
    rows = [("b", k, k, f"t{k} x", "- " + " ".join(f"w{k}x{i}" for i in range(200)) + f" t{k - 1} x") for k in range(12)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = notes.refer_to_explained(spark.createDataFrame(rows, NOTES))._jdf.queryExecution().executedPlan()
        assert plan.execute().count() == len(rows)
        sent, left = [], [plan]
        while left:
            p = left.pop()
            left += [p.children().apply(k) for k in range(p.children().size())]
            if p.nodeName() == "Exchange":
                sent.append(p.metrics().apply("shuffleRecordsWritten").value())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sent and max(sent) <= 4 * len(rows)
