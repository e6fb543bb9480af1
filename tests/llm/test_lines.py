"""Near copies just under the threshold: few of their pairs are compared, and no link is lost."""

import numpy as np

from bookspark.llm import lines


def test_near_copies_under_the_threshold_are_not_compared_in_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    base, texts = [word() for _ in range(60)], []
    for k in range(240):  # two of three lines change one word, the third so many that it hardly links
        own = list(base)
        for at in rng.choice(60, 1 + k % 3 // 2 * rng.integers(6, 12), replace=False):
            own[at] = word()
        texts.append(" ".join(own))
    df = spark.createDataFrame([(k, t, t) for k, t in enumerate(texts)], "doc_id long, text string, line string")
    bands = {r["doc_id"]: set(r["bands"]) for r in lines.banded(df).collect()}
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    both = [(a, b) for a in label for b in label if a < b and bands[a] & bands[b]]
    links = [(a, b) for a, b in both if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    asked, similar = [], lines.similar
    monkeypatch.setattr(lines, "similar", lambda pairs, t: asked.append(pairs.count()) or similar(pairs, t))
    got = {r["id"] for r in lines.repeated_lines(df).collect()}
    assert got == {k for k in range(len(texts)) if label[k] != k}
    assert len(both) > 10_000 and asked[-1] < 0.1 * len(both)
