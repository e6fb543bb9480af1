"""The training-data operators against brute force, and on odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookspark.llm import bpe, decontaminate, langid, lines, pagetext, pii, quality, simhash, toxicity, warc
from bookspark.llm._shared import components, prepare
from bookspark.llm.queries import vocabulary_path

DOCS = "doc_id long, text string, lang string, n_words string"
ODD = [(1, None, None, "x"), (2, "", "en", None), (None, "some words here", "en", "x"), (4, "one. two. " * 4000, "en", "x"), (5, "same text of a row", "en", "x"), (5, "same text of a row", "en", "x"), (6, "x" * 50_000, None, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return prepare(spark).createDataFrame(ODD, DOCS)


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


APPLY = {
    "decontaminate": lambda d: decontaminate.contamination(d, items(d.sparkSession, ["some words here", None, ""])),
    "pii": lambda d: pii.find(d),
    "bpe": lambda d: bpe.encode(d, vocabulary_path(), decode=True),
    "langid": lambda d: langid.identify(d, langid.train(d)),
    "lines": lambda d: lines.deduplicate(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "quality": lambda d: quality.score(d),
    "toxicity": lambda d: toxicity.score(d, toxicity.train(d, d.select("doc_id", F.lit(1).alias("toxic")))),
}


@pytest.mark.parametrize("name", APPLY)
def test_odd_rows_stay_and_empty_tables_are_empty(odd, name):
    assert APPLY[name](odd).count() == len(ODD)
    assert APPLY[name](odd.limit(0)).count() == 0


CLASHES = ["gone", "more", "n_words", "n_gone", "n_lines", "kept", "id", "row", "bits", "hit_items", "__n0", "c0", "__id", "__row", "__gone", "Component_ID"]
STAGES = {
    "quality": lambda d: quality.keep(d),
    "lines": lambda d: lines.drop_repeats(d),
    "simhash": lambda d: simhash.one_each(d),
    "decontaminate": lambda d: decontaminate.decontaminate(d, items(d.sparkSession, ["some words here", None, ""])),
    "pii": lambda d: pii.find(d).drop("base_spans", "spans"),
    "page text": lambda d: pagetext.extract(d.withColumnRenamed("text", "html").withColumn("url", F.lit(None).cast("string"))).select("doc_id", F.col("html").alias("text"), *CLASHES),
}


@pytest.mark.parametrize("name", STAGES)
def test_columns_of_any_name_stay_as_they_are(spark, name):
    rows = [(i, t, *[f"{c}{k}" for c in CLASHES]) for k, (i, t) in enumerate([(1, None), (2, ""), (None, "a b c d e f g h i j k l"), (None, "m n o p q r s t u v w x me@x.org"), (3, "one two three four five six seven eight nine ten\nnew line"), (3, "one two three four five six seven eight nine ten\nother line"), (4, "some words here " + "z" * 5000)])]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    got = STAGES[name](docs)
    assert got.columns == docs.columns
    extras = {r[2:]: r[0] for r in rows}
    found = [tuple(r) for r in got.collect()]
    assert found and all(extras[r[2:]] == r[0] for r in found) and len({r[2:] for r in found}) == len(found)
    assert STAGES[name](docs.limit(0)).count() == 0


def test_windows_against_brute_force(spark):
    rng = np.random.default_rng(0)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 4, n)]
    benchmark = [" ".join(word(n)) for n in (1, 2, 5, 13, 14, 20)] + ["", None]
    texts = [" ".join(word(n)) for n in rng.integers(0, 80, 40)] + [f"a {b}! B" for b in benchmark if b]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (1 << 20, 300):
        got = {r["doc_id"]: r for r in decontaminate.contamination(docs, items(spark, benchmark), block_bytes=block).collect()}
        for k, t in enumerate(texts):
            w, hit, own = re.findall(r"[a-z0-9]+", t.lower()), set(), set()
            for i, b in enumerate(benchmark):
                v = re.findall(r"[a-z0-9]+", (b or "").lower())
                n = min(13, len(v))
                wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
                for j in range(len(w) - n + 1):
                    if tuple(w[j : j + n]) in wins:
                        hit |= set(range(j, j + n))
                        own.add(i)
            spans = {p for s in got[k]["hit_spans"] for p in range(s["start"], s["end"])}
            assert (got[k]["n_words"], spans, set(got[k]["hit_items"])) == (len(w), hit, own)


def test_base_entities_against_brute_force(spark):
    import random

    random.seed(5)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, m):
        digits = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(digits[::-1])) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]

    texts = ["".join(random.choice("00123456789 --..+()@a_b") for _ in range(random.randint(0, 120))) for _ in range(300)]
    texts += ["a@b.c_d@e.f", "4111 1111 1111 1111", "5 4111111111111111", "1.2.3.4.5.6.7.8", "é+1 (234) 555-6789."]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", pii.written(F.col("base_spans")).alias("s")).collect()
    for k, s in got:
        want = sorted((m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, texts[k]) if valid(kind, m[0]))
        assert s == ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in want), texts[k]


def test_places_in_texts_of_many_entities(spark):
    n = 3000
    text = " ".join(f"é{k}@x.org, 10.0.{k % 300}.1" for k in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.find(docs).select("text", F.transform("base_spans", lambda x: F.struct(x["start"], x["k"], x["end"])).alias("s")).first()
    want = sorted([(m.start(), 0, m.end()) for m in re.finditer(r"[0-9]+@x\.org", text)] + [(m.start(), 1, m.end()) for m in re.finditer(r"10\.0\.([0-9]+)\.1", text) if int(m[1]) < 256])
    assert [tuple(x) for x in got["s"]] == want and got["text"] == text


def test_contexts_find_unseen_identifiers(spark):
    known = [f"please write to me{k}@x.org today" for k in range(8)]
    texts = [*known, "please write to my-name-at-9 today", "other 12345 words"]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", pii.written(F.col("spans")).alias("s"))
    found = dict(map(tuple, got.collect()))
    assert found[8] == "email:16:28" and found[9] == ""


@pytest.mark.parametrize(
    "known, unseen, want",
    [
        ("please call us at +44 20 7946 09{k}1 any day", "please call us at 020 7946 0123 any day", "phone:18:31"),
        ("please write  mailto:me{k}@x.org\n\ntoday", "please write  mailto: my-name-at-9 today", "email:22:34"),
        ("so\n\nwrite  to  me{k}@x.org, today", "so\n\nwrite  to  my-name-at-9, today", "email:15:27"),
    ],
)
def test_contexts_of_spaced_and_attached_entities(spark, known, unseen, want):
    texts = [*(known.format(k=k) for k in range(8)), unseen, "other 12345 words"]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", pii.written(F.col("spans")).alias("s"))
    found = dict(map(tuple, got.collect()))
    assert found[8] == want and found[9] == ""


def test_encoding_equals_the_library(spark):
    import random

    from tokenizers import Tokenizer

    path = vocabulary_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    coder = bpe.Transducer(bpe.read_vocabulary(path))
    random.seed(2)
    letters = "aabcdeehinorst'é1 ñ \u0085\x1cΣÉß"
    texts = ["".join(random.choice(letters) for _ in range(random.randrange(60))) for _ in range(400)]
    texts += ["".join(random.choice(random.choice(["aeinst", "a", "ha"])) for _ in range(3000)) for _ in range(5)]
    texts += ["<|endoftext|>x<|startoftext|>", "", "don't  we'll"]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == want
        assert "".join(coder.decoded(want)) == library.decode(want, skip_special_tokens=False)


def test_words_in_sight_have_the_ids_of_the_stream():
    import random

    random.seed(4)
    coder = bpe.Transducer(bpe.read_vocabulary(vocabulary_path()))
    for _ in range(1500):
        word = "".join(random.choice(random.choice(["etaoinshr", "aeiou", "thing", "ab", "é😀ß"])) for _ in range(random.randint(1, coder.lookahead)))
        word = word.encode().decode("latin-1").translate(coder.table)[: coder.lookahead]
        assert coder._whole(word) == list(coder.stream(word))


def test_decoding_by_bytes_equals_the_library(spark):
    import random

    from tokenizers import Tokenizer

    path = vocabulary_path("byte_bpe_50k.json")
    library, coder = Tokenizer.from_file(path), bpe.Transducer(bpe.read_vocabulary(path))
    random.seed(1)
    rows = [[random.randrange(50257) for _ in range(30)] for _ in range(100)]
    rows += [library.encode("".join(random.choice("abc é日本😀\n  ñß.,!1") for _ in range(40)), add_special_tokens=False).ids for _ in range(100)]
    want = [library.decode(ids, skip_special_tokens=False) for ids in rows]
    assert ["".join(coder.decoded(ids)) for ids in rows] == want
    df = prepare(spark).createDataFrame([(k, ids) for k, ids in enumerate([*rows, None, []])], "doc_id int, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, path).collect()}
    assert [got[k] for k in range(len(got))] == [*want, "", ""]


def test_long_words_are_emitted_before_they_end():
    coder = bpe.Transducer(bpe.read_vocabulary(vocabulary_path()))
    word = "abcdefghij" * 5000
    stream = coder.word(word)
    first = next(stream)
    assert coder.strings[first] and len(list(stream)) > 1000


def test_mixed_text_has_spans(spark):
    en, fr = "the house and the garden with many trees", "la maison et le jardin avec des arbres"
    rows = [(k, t, l, "") for k, (t, l) in enumerate([(en, "en"), (fr, "fr")] * 5)]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    got = langid.identify(spark.createDataFrame([(1, f"{en} {fr} et la maison"), (2, "12 34"), (3, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [s["lang"] for s in got[0]["lang_spans"]] == ["en", "fr"] and got[0]["lang_pred"] == "fr"
    assert [r["lang_pred"] for r in got[1:]] == ["und", "und"]


def test_label_runs_against_one_pass():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 3, 64, 65, 128, 500, 1, 0, 1300, 63])
    for labels in (1, 2, 4):
        scores = -8 * rng.random((50, labels))
        words = rng.integers(0, 50, sizes.sum())
        got, first = langid.viterbi(scores, words, sizes), 0
        for n in sizes.tolist():
            own, now, back = scores[words[first : first + n]], np.zeros(labels), []
            for t in range(n):
                best = now.argmax()
                jump = (now[best] - langid.SWITCH > now) & (t > 0)
                back.append(np.where(jump, best, np.arange(labels)))
                now = np.where(jump, now[best] - langid.SWITCH, now) + own[t]
            want, label = [], now.argmax()
            for b in back[::-1]:
                want.append(label)
                label = b[label]
            assert got[first : first + n].tolist() == want[::-1]
            first += n


def test_trigrams_of_words():
    words = ["a1b", "don't", "12", "—", "ж"]
    grams, owner, scripts, letters = langid.read_words(words)
    text = ["".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0)) for g in grams.tolist()]
    assert list(zip(owner.tolist(), text)) == [(0, " ab"), (0, "ab "), (1, " do"), (1, "don"), (1, "ont"), (1, "nt "), (3, " — "), (4, " ж ")]
    assert [langid.NAMES[k] for k in scripts] == ["latin", "latin", "none", "none", "cyrillic"] and letters.tolist() == [2, 4, 0, 0, 1]


def test_fuzzy_lines_keep_the_first(spark):
    line = "the quick brown fox jumps over the lazy dog and then it rests in the warm sun for a while"
    near = line.replace("warm", "cold")
    docs = spark.createDataFrame([(1, f"{line}\nshort"), (2, f"{near}\nshort"), (3, f"{line}\nanother line that is long enough to count but is not like the one above")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.deduplicate(docs).collect()}
    assert got[1] == f"{line}\nshort" and got[2] == "" and got[3].startswith("another")
    assert {r["text"] for r in lines.deduplicate(docs, least_chars=6).collect()} == {f"{line}\nshort", "short", got[3]}


@pytest.mark.parametrize("crowd", [3, 1000])
def test_crowded_bands_lose_no_pair(spark, monkeypatch, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd, raising=False)
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    shared, texts = word(8), []
    for _ in range(40):  # one passage with tails of its own, and a copy of each with one other letter
        tail = word(6)
        texts += [f"{shared} {tail}", f"{shared} {tail[:-1]}#"]
    texts += ["ab" * 30, "ab" * 100]
    df = spark.createDataFrame([(k, t, t) for k, t in enumerate(texts)], "doc_id long, text string, line string")
    bands = {r["doc_id"]: set(r["bands"]) for r in lines.banded(df).collect()}
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    near = [(a, b) for a in label for b in label if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    shares = [(a, b) for a, b in near if bands[a] & bands[b]]
    assert len(shares) >= 0.95 * len(near) >= 38
    for _ in texts:
        for a, b in shares:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["id"] for r in lines.repeated_lines(df).collect()}
    assert got == {k for k in range(len(texts)) if label[k] != k}


def test_recall_of_bands_and_links(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(2, 9))))
    vocabulary, texts = [word() for _ in range(3000)], []
    for _ in range(900):
        line = " ".join(rng.choice(vocabulary, rng.integers(8, 60)))
        texts.append(line)
        for _ in range(rng.integers(1, 7)):  # letters here and there
            at = rng.integers(0, len(line))
            line = line[:at] + "#" + line[at + 1 :]
        texts.append(line)
    texts += ["x y " + "ha " * 20, "x y " + "ha " * 90]
    df = spark.createDataFrame([(k, t, t.strip()) for k, t in enumerate(texts)], "doc_id long, text string, line string")
    sets = [{t.strip()[i : i + 5] for i in range(len(t.strip()) - 4)} for t in texts]
    near = [(k, k + 1) for k in range(0, len(texts), 2) if len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1])]
    bands = {r["doc_id"]: set(r["bands"]) for r in lines.banded(df).collect()}
    hard = [(a, b) for a, b in near if len(sets[a] & sets[b]) < 0.85 * len(sets[a] | sets[b])]
    assert len(near) > 500 and len(hard) > 50
    assert sum(bool(bands[a] & bands[b]) for a, b in hard) >= 0.95 * len(hard)
    gone = {r["id"] for r in lines.repeated_lines(df).collect()}
    assert gone <= {b for _, b in near} and len(gone) >= 0.95 * len(near) and len(texts) - 1 in gone


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    label = list(range(60))
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = {(n, label[n]) for e in edges for n in e if any(x != y for x, y in edges if n in (x, y))}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_fingerprint_links_against_brute_force(spark):
    from xxhash import xxh64_intdigest

    assert simhash.fingerprint(b"A b\tc d") == xxh64_intdigest(b"a b c d", 42)
    rng = np.random.default_rng(4)
    keys = []
    for base in rng.integers(-(2**63), 2**63 - 1, 15).tolist():
        keys += [base ^ int(sum({1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 6))})) for _ in range(10)]
    keys = sorted(set(keys))
    label = {k: k for k in keys}
    pairs = [(a, b) for a in keys for b in keys if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4]
    for _ in keys:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = components(simhash.links(spark.createDataFrame([(k,) for k in keys], "bits long")))
    found = dict(map(tuple, got.collect()))
    assert {k: found.get(k, k) for k in keys} == label


def test_one_row_of_each_component(spark):
    first, second, third = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(None, first), (None, first), (None, second), (7, third), (7, " ".join(f"d{k}" for k in range(60))), (9, third), (None, third), (3, None)]
    docs = prepare(spark).createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    got = simhash.one_each(docs)
    assert got.columns == docs.columns
    want = [(None, first), (None, second), (7, third), (7, rows[4][1]), (3, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_repeats_against_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(100):
        docs = [rng.integers(0, 3, rng.integers(0, 25)).tolist() for _ in range(3)]
        want = []
        for d in docs:
            for i in range(len(d)):
                best = 0
                for j in range(len(d)):
                    k = 0
                    while i != j and max(i, j) + k < len(d) and d[i + k] == d[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        numbers = np.array([x for d in docs for x in d], np.int64)
        owner = np.array([k for k, d in enumerate(docs) for _ in d], np.int64)
        assert quality.repeats(numbers, owner).tolist() == want


def test_kernel_against_brute_force():
    from itertools import combinations as choose

    def values(word):
        out, word = {}, f"^{word}$"
        for at in choose(range(len(word)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.ORDER + toxicity.GAP:
                key = "".join(word[k] for k in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    def like(a, b):
        x, y = values(a), values(b)
        dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
        return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))

    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcd"), rng.integers(1, 9))) for _ in range(60)] + ["é", "日本語"]
    marks = words[:12]
    got = toxicity.Kernel(marks)(words)
    want = np.array([[like(w, m) for m in marks] for w in words])
    want[want < toxicity.LEAST] = 0
    assert np.allclose(got, want)


def test_a_machine_is_fitted_to_labelled_sentences(spark):
    rng = np.random.default_rng(11)
    plain = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8))) for _ in range(200)]
    sentence = lambda: " ".join(rng.choice(plain, 8)) + "."
    bad = ["worthless", "scumbag", "imbecile"]
    rows = []
    for k in range(300):
        text = [sentence() for _ in range(4)]
        if k % 3 == 0:
            word = bad[k % 9 // 3]
            at = rng.integers(2, len(word))
            text[rng.integers(0, 4)] = f"you {word if k % 2 else word[:at] + '*' + word[at:]} {plain[k % 200]}."
        rows.append((k, " ".join(text), int(k % 3 == 0)))
    docs = prepare(spark).createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int").where("doc_id < 200")
    model = toxicity.train(docs.where("doc_id < 200"), labels, landmarks=4)
    assert model["landmarks"] and set(model["landmarks"]) & set(bad)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    held = [(y, got[k]) for k, _, y in rows if k >= 200]
    assert sum(p for y, p in held if y) >= 0.9 * sum(y for y, _ in held) and sum(p for y, p in held if not y) <= 2


def test_gapped_insults_are_like_their_landmark():
    kernel = toxicity.Kernel(["idiot", "garden"])
    values = kernel(["idiot", "i-d-iot", "idxiot", "idiots", "table"])
    assert values[0, 0] == pytest.approx(1) and (values[1:4, 0] > 0.35).all() and values[4].max() == 0
    assert "idiot" in toxicity.words_of("you i d i o t there")


def test_page_text_and_site_templates(spark):
    article = "<html><head><title>t</title></head><body><nav>menu</nav><header>site</header><article><h1>Head&amp;line</h1><p>First<br>line <b>of {k}</b> it<p>Second\n para.<div class='ad'>buy</div></article><section class=comments>bad</section><footer>foot</footer>"
    assert pagetext.text_of(article.format(k=1)) == "Head&line First line of 1 it Second para."
    page = "<body><div class=x><p>Always here on all pages</p></div><p>Only on page {k}</p><script>var a='</p>'</script>"
    rows = [(k, "https://Site.org/a", page.format(k=k)) for k in range(6)] + [(9, None, None)]
    got = dict(map(tuple, pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect()))
    assert got == {k: f"Only on page {k}" for k in range(6)} | {9: ""}


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><div style='overflow:hidden' title=\"hidden gems\"><p>One</p><a href=/hidden-falls>two</a> <a href='/x?id=menu'>three</a></div>", "One two three"),
        ("<body><div hidden>no</div><div HIDDEN=''>no</div><p id=menu>no</p><p>yes</p>", "yes"),
        ("<body><div class='content has-sidebar'><p>Main text</p></div><div class='x sidebar'>no</div>", "Main text"),
        ("<body><div class='social'><article><p>Text</p></article></div>", "Text"),
        ("<body><div class=related><article>one</article></div><article>two</article>", "two"),
        ("<body><p title=it's>hello</p><p a=b\"c>more</p><a href=\"x>y\" title='a>b'>link</a>", "hello more link"),
        ("<body><main><p>one</p></main><p>between</p><main><p>two</p></main>", "one between two"),
        ("<article>A one</article><article>B two</article>", "A one B two"),
        ("<body><article><p class='share-price'>12</p><div class='related-work'>prior</div></article>", "12 prior"),
        ("<body><div id='page-banner-wrap'><article>Text</article></div>", "Text"),
        ("<p>an open <b>tag <i", "an open tag"),
        ("<body><p>Before</p><article>one</article><p>Between</p><div><article>two</article></div><article class=comment-body>no</article><p>After</p>", "Before one Between two After"),
    ],
)
def test_main_text_stays_in_page_order(html, text):
    assert pagetext.text_of(html) == text


def test_templates_of_large_hosts(spark):
    page = "<body><div><p>{t}</p></div><p>Only on page {k}</p>"
    rows = [(k, "https://site.org/a", page.format(k=k, t="Section template" if k < 8 else f"Own {k}")) for k in range(30)]
    got = pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), many_pages=8).select("page_id", "text")
    assert dict(map(tuple, got.collect())) == {k: f"Only on page {k}" if k < 8 else f"Own {k} Only on page {k}" for k in range(30)}


def test_templates_against_counts_by_host(spark):
    rng = np.random.default_rng(12)
    parts = [f"<div><p>Part {k} of a site</p></div>" for k in range(12)]
    rows = []
    for k in range(80):
        own = sorted(rng.choice(12, 3, replace=False).tolist()) + [0] * int(k % 4 < 3)
        rows.append((k, f"https://host{k % 2}.org/{k}", own, "<body>" + "".join(parts[i] for i in own) + f"<p>Own {k}</p>"))
    docs = spark.createDataFrame([(k, u, h) for k, u, _, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pagetext.extract(docs, least_pages=4, share=0.4).select("page_id", "text").collect()}
    for host in range(2):
        mine = [r for r in rows if r[0] % 2 == host]
        common = {i for i in range(12) if (n := sum(i in own for _, _, own, _ in mine)) >= 4 and n >= 0.4 * len(mine)}
        assert common
        for k, _, own, _ in mine:
            assert got[k] == " ".join([f"Part {i} of a site" for i in own if i not in common] + [f"Own {k}"])


def test_archives_round_trip(spark):
    rows = [(3, "u", "same"), (1, "u", "same"), (1, "u", "same"), (None, None, "same"), (4, "a\r\nb", "é" * 100_000), (5, "u", None), (6, "u", "")]
    got = warc.round_trip(prepare(spark), spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    same = [(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 4]
    assert sorted(same, key=repr) == sorted([(1, "response", None), (1, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1)], key=repr)
    long = next(r for r in got if r["page_id"] == 4)
    assert long["payload_bytes"] == 200_000 and warc._sha1(("é" * 100_000).encode()) == long["payload_digest"]


def test_monolithic_stream_of_many_members(tmp_path):
    from pyarrow import fs

    data = [warc.record(k, f"http://x/{k}", bytes([65 + k]) * 3_000_000, None, False) for k in range(3)]
    packed = b"".join(zlib.compress(d, wbits=31) if k else b"" for k, d in enumerate([b"", *data]))
    (tmp_path / "w").write_bytes(packed)
    store = fs.LocalFileSystem()
    assert warc.normalise_file(store, str(tmp_path / "w"), str(tmp_path / "o"), str(tmp_path / "i")) == 3
    with pytest.raises(ValueError):
        (tmp_path / "w").write_bytes(zlib.compress(data[0][:-100], wbits=31))
        warc.normalise_file(store, str(tmp_path / "w"), str(tmp_path / "o"), str(tmp_path / "i"))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon"
    unique = lambda k: " ".join(f"{w}{k}" for w in words.split())
    docs = [(1, unique(1), "en", "s", 1), (2, unique(1), "en", "s", 1), (3, unique(3) + " " + words, "en", "s", 1), (4, "too short", "en", "s", 1), (5, unique(5), "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items(spark, [words]).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(vocabulary_path()).encode(unique(1), add_special_tokens=False)
    words_of_first = Tokenizer.from_file(vocabulary_path()).decode(want.ids, skip_special_tokens=False).replace("</w>", "").split()
    assert set(got) == {1, 5} and got[5]["n_tokens"] == len(got[5]["ids"]) > 0
    assert got[1]["decoded"].replace("</w>", "").split() == words_of_first
    assert hashlib.sha256(" ".join(map(str, got[1]["ids"])).encode()).hexdigest() == hashlib.sha256(" ".join(map(str, want.ids)).encode()).hexdigest()
