"""One row of each component, whatever the ids; fingerprints and components against all pairs."""

import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from bookspark.llm import simhash
from bookspark.llm._shared import prepare, shared_dir, stored


def fingerprint(text, width=4):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in lowered.replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_and_kept_rows_against_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 3, 60, 300]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            own = list(words)
            if own and rng.random() < 0.6:
                own[rng.randrange(len(own))] = "Changed"
            rows.append((rng.choice([None, *range(60)]), " ".join(own) or rng.choice([None, "", " \n"]), f"x{len(rows)}"))
    rows += [rows[0], rows[1], (None, "same words of no number", "y"), (None, "other words than before here", "z")]
    bits = [fingerprint(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    members = defaultdict(list)
    for k, g in enumerate(group):
        members[g].append(k)
    least = {g: min((rows[k][0] for k in own if rows[k][0] is not None), default=None) for g, own in members.items()}
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, extra string").repartition(3)

    got = simhash.near_duplicates(docs).select("doc_id", "extra", "fingerprint", "component_id").collect()
    want = [(i, x, f"{bits[k]:016x}", least[group[k]]) for k, (i, _, x) in enumerate(rows)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))

    kept = [tuple(r) for r in simhash.one_each(docs).collect()]
    assert len(kept) == len(members) < len(rows)
    of_row = {row: group[k] for k, row in enumerate(rows)}
    assert {of_row[r] for r in kept} == set(members)
    assert all(r[0] == least[of_row[r]] for r in kept)


def test_a_stored_table_goes_on_an_error(spark):
    import os

    folder = shared_dir(spark).removeprefix("file:")
    with pytest.raises(ValueError), stored(spark.range(3).withColumn("x", F.lit(1))):
        assert any(n.startswith("stored-") for n in os.listdir(folder))
        raise ValueError
    assert not any(n.startswith("stored-") for n in os.listdir(folder))
