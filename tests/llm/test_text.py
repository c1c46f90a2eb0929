"""Near duplicates, line dedup, language models, decontamination and the pipeline on small texts."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import decontam, jaccard, langid, linededup
from corpusgraph.llm.common import shingles, word_hashes
from corpusgraph.llm.components import components
from corpusgraph.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def _words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def _set(text):
    w = _words(text)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def _near_copies(rng):
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [None, "", " \t ", "one two", "One  TWO", "one two three"]
    for n in (5, 6, 9, 14, 30, 80, 200):
        for _ in range(6):
            base = [rng.choice(vocabulary) for _ in range(n)]
            texts.append(" ".join(base))
            for edits in (0, 1, 2, 3, 5, 8):
                w = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(w))
                    w[at : at + 1] = rng.choice([[], ["new"], [w[at], rng.choice(vocabulary)]])
                texts.append(" ".join(w))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [f"{passage} " + " ".join(f"own{i}x{j}" for j in range(rng.randint(3, 25))) for i in range(60)]
    return texts


def _components(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = _near_copies(rng)
    sets = [_set(t) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = _components(len(texts), edges)
    df = spark.createDataFrame([*((i, t, 7) for i, t in enumerate(texts)), (None, "one two", 7)], "doc_id long, text string, component_id int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    assert got.pop(None) == (1, None)
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_near_duplicates_with_repeated_ids(spark):
    rng = random.Random(21)
    texts = _near_copies(rng)[6:80]
    ids = [rng.randrange(30) for _ in texts]
    sets = [_set(t) for t in texts]
    edges = [(ids[i], ids[j]) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = _components(30, edges)
    got = jaccard.near_duplicates(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((i, len(s), want[i]) for i, s in zip(ids, sets, strict=True))
    base = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    few = spark.createDataFrame([(1, base), (1, other), (2, base + " x"), (3, other + " y")], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.near_duplicates(few).collect()} == {1}


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert jaccard.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).where("n_shingles = 0 and component_id = doc_id").count() == 2


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(5)
    missed = 0
    for n in (1, 2, 3, 4, 5, 7, 8, 12, 20, 37, 90, 300):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            gone, more = rng.integers(0, n // 4 + 1), rng.integers(0, n // 3 + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, more).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            with np.errstate(over="ignore"):
                keys = [{k for *_, ks in jaccard.index_keys(x) for k in ks.tolist()} for x in (a, b)]
            missed += not keys[0] & keys[1]
    assert missed == 0


@pytest.mark.parametrize("most", [256, 4])
def test_tiles_connect_what_is_similar(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "DOCS_PER_BLOCK", most)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, 20).astype(np.uint64))]
    for _ in range(30):
        sets.append(np.unique(np.concatenate([rng.permutation(sets[rng.integers(len(sets))])[1:], rng.integers(0, 2**63, 1).astype(np.uint64)])))
    rows = spark.createDataFrame([(i, len(s), bytearray(s.astype("<u8").tobytes())) for i, s in enumerate(sets)], "doc_id long, n long, elements binary")
    # of one key: a single block, and blocks of few documents by size
    for _ in range(20):
        sets.append(np.unique(np.concatenate([rng.permutation(sets[rng.integers(len(sets))])[2:], rng.integers(0, 2**63, 5).astype(np.uint64)])))
    rows = spark.createDataFrame([(i, len(s), bytearray(s.astype("<u8").tobytes())) for i, s in enumerate(sets)], "doc_id long, n long, elements binary")
    postings = spark.createDataFrame([(1, i, i) for i in range(len(sets))], "key long, doc long, component long")
    similar = lambda a, b: 100 * (x := len(np.intersect1d(a, b))) >= 75 * (len(a) + len(b) - x)
    want = _components(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])])
    got = [(r["a"], r["b"]) for r in jaccard.compared_in_tiles(postings, rows).collect()]
    assert _components(len(sets), got) == want
    assert all(similar(sets[a], sets[b]) for a, b in got)


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)]
    want = _components(400, edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: want[n] for e in edges for n in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_and_shingles():
    texts = ["A b\tc  d e F", "a B c d E f", None, "", "x", "é É"]
    words, counts = word_hashes(texts)
    assert counts.tolist() == [6, 6, 0, 0, 1, 2]
    assert (words[:6] == words[6:12]).all() and words[13] != words[14]
    sets, sizes = shingles(words, counts)
    assert sizes.tolist() == [2, 2, 0, 0, 1, 1] and (sets[:2] == sets[2:4]).all()


def _line_rule(docs, least):
    """The dropped lines by comparing all pairs."""
    lines = [((d, i), _words(x)) for d, t in docs if d is not None and t is not None for i, x in enumerate(t.split("\n"))]
    lines = sorted((p, w) for p, w in lines if w)
    out = {}
    for k, (p, w) in enumerate(lines):
        earlier = [v for q, v in lines[:k] if q < p]
        if w in earlier:
            out[p] = False
        elif len(w) >= least and any(_edit(w, v) for v in [x for x, y in _first(lines).values() if len(x) >= least and y < _first(lines)[tuple(w)][1]]):
            out[p] = True
    return out


def _first(lines):
    seen = {}
    for p, w in lines:
        seen.setdefault(tuple(w), (w, p))
    return seen


def _edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    base = [[rng.choice("abcdefgh") * 2 for _ in range(rng.randint(3, 9))] for _ in range(25)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(base))
            if rng.random() < 0.5:
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["zz"], [w[at], "yy"], [w[at].upper()]])
            lines.append(rng.choice([" ", "  ", "\t"]).join(w))
        docs.append((d, "\n".join(lines)))
    docs += [(40, None), (41, ""), (42, "\n\n"), (None, docs[0][1])]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, line string, near int")
    got = {(r["doc_id"], r["line_no"]): r["near"] for r in linededup.dropped_lines(df, 4).collect()}
    assert got == _line_rule(docs, 4)
    left = {r["doc_id"]: r["text"] for r in linededup.without_lines(df.select("doc_id", "text", "line"), linededup.dropped_lines(df, 4)).where("doc_id is not null").collect()}
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in got) for d, t in docs if d is not None and t is not None and any((d, i) not in got for i in range(len(t.split("\n"))))} | {40: None}
    assert left == want


def test_line_dedup_of_lines_of_any_length(spark):
    import corpus_pipeline as p

    lines = ["}", "see  below", "See below", "see above", "", "", "one two three four five six seven", "one two three four five six seven eight", "one two three four five six seven nine", "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec", "\u4eca\u5929\u5929\u6c14\u4e0d\u597d\u6211\u4eec", "\u4f60\u597d", "\u60a8\u597d", "}"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "}\n\u4f60\u597d\nnew\n"), (3, "}")], "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): r["near"] for r in linededup.dropped_lines(docs).collect()}
    assert got == {(1, 2): False, (1, 8): True, (1, 10): True, (1, 13): False, (2, 0): False, (2, 1): False, (3, 0): False}
    full = docs.selectExpr("doc_id", "text", "'en' as lang", "'x' as source", "length(text) as n_chars")
    left = {r["doc_id"]: r["text"] for r in p.line_dedup(spark, full, SF).collect()}
    assert left == {1: "\n".join(x for i, x in enumerate(lines) if (1, i) not in got), 2: "new\n"}


def test_line_dedup_of_short_lines_and_repeated_ids(spark, monkeypatch):
    short = spark.createDataFrame([(1, "Share this page now"), (2, "Share this page now")], "doc_id long, text string")
    assert [(r["doc_id"], r["line_no"], r["near"]) for r in linededup.dropped_lines(short).collect()] == [(2, 0, False)]
    blank = spark.createDataFrame([(1, ""), (2, " \n\t")], "doc_id long, text string")
    assert linededup.dropped_lines(blank).count() == 0 and linededup.dropped_lines(blank.where("1 = 0")).count() == 0
    long = " ".join(f"w{i}" for i in range(9))
    rows = [(1, f"only here\n{long}"), (1, f"{long} more"), (1, f"{long} more"), (2, "only here\nnew")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = dict(docs.selectExpr("text", "xxhash64(text)").collect())
    first, second = sorted([rows[0], rows[1]], key=lambda r: parts[r[1]])
    want = {(1, parts[second[1]], second[1].split("\n").index(next(x for x in second[1].split("\n") if x.startswith(long))), True), (2, parts[rows[3][1]], 0, False)}
    monkeypatch.setattr(linededup, "OFTEN", 1)
    for _ in range(2):  # with lines of two occurrences marked by broadcast, and by the join
        got = linededup.dropped_lines(docs)
        assert {tuple(r) for r in got.collect()} == want
        left = sorted(r["text"] for r in linededup.without_lines(docs, got).collect())
        assert left == sorted(["only here", f"{long} more", f"{long} more", "new"] if first is rows[1] else [rows[0][1], "new"])
        monkeypatch.setattr(linededup, "OFTEN", 1000)


def test_one_edit():
    rng = random.Random(9)
    for _ in range(500):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(5))] for _ in range(2))
        assert linededup.one_edit(a, b) == _edit(a, b)


def test_languages(spark):
    docs = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = docs.where("held_out").join(truth, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
    assert docs.where("score < 0 or score > 1 or lang_pred is null").count() == 0
    assert docs.where("rejected").count() <= 0.01 * docs.count()


def test_held_out_labels_teach_nothing(spark, tmp_path):
    """Held-out rows with a label nobody else has, and then with none: the predictions are the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = []
    for name, label in (("own", F.lit("xx")), ("none", F.lit(None).cast("string"))):
        held = langid.held_out(F.col("doc_id"))
        docs.withColumn("lang", F.when(held, label).otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = QUERIES["op5_language_id"](spark, f"{tmp_path}/{name}").collect()
        assert {r["lang_pred"] for r in rows} <= {"en", "fr", "de", "es", "und"} and any(r["held_out"] for r in rows)
        got.append(sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in rows))
    assert got[0] == got[1]


@pytest.mark.parametrize("n_rare", [3, 60])
def test_a_rare_language_rejects_too(spark, n_rare):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("doc_id", "text", "lang").orderBy("doc_id").collect()
    rare = [r for r in docs if r["lang"] == "es"]
    fit = [r for r in docs if r["lang"] in ("en", "fr", "de")] + rare[:n_rare]
    who = langid.fit(spark.createDataFrame(fit, "doc_id long, text string, lang string"))
    assert all(np.isfinite(m.most) for m in who.models.values())
    rng = random.Random(14)
    odd = lambda first, n: " ".join("".join(chr(first + rng.randrange(n)) for _ in range(rng.randint(2, 9))) for _ in range(80))
    unseen = [(i, odd(0x430, 32)) for i in range(40)] + [(100 + i, odd(0x4E00, 3000)) for i in range(40)]
    said = langid.identify(spark.createDataFrame(unseen, "doc_id long, text string"), who)
    assert said.where("rejected").count() >= 76
    own = langid.identify(spark.createDataFrame(rare[60:], "doc_id long, text string, lang string"), who)
    assert own.where("rejected").count() <= 0.02 * len(rare[60:])


def test_language_of_odd_texts(spark):
    rows = [(i, "the cat and the dog went to the house " * 3, "en") for i in range(30)] + [(100 + i, "le chat et le chien vont à la maison " * 3, "fr") for i in range(30)]
    who = langid.fit(spark.createDataFrame([*rows, (1000, None, "en"), (1001, "x", None)], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "123 !?", 0.5), (4, "the house and the cat", 0.5), (5, "La Maison et le chien", 0.5), (6, "le chat " * 50_000, 0.5), (6, "le chat " * 50_000, 0.5)], "doc_id long, text string, score double")
    got = sorted((r["doc_id"], r["lang_pred"], r["rejected"]) for r in langid.identify(df, who).collect())
    assert [g[1] for g in got] == ["und", "und", "und", "en", "fr", "fr", "fr"] and all(g[2] for g in got[:3])
    assert langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
    assert {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(10)
    letters = rng.integers(0, 30, (5000, langid.ORDER)).astype(np.uint64)
    codes, counts = np.unique((letters << (np.uint64(16) * np.arange(langid.ORDER, dtype=np.uint64))).sum(axis=1, dtype=np.uint64), return_counts=True)
    m = langid.Model.fit(codes, counts, 31)
    for context in [*(codes[:5] >> np.uint64(16)).tolist(), 1]:
        every = (np.uint64(context) << np.uint64(16)) | np.array([*range(30), langid.OTHER_LETTER], np.uint64)
        assert np.exp(m.log_prob(every)).sum() == pytest.approx(1, abs=1e-6)


def _kneser_ney(grams, classes):
    """Interpolated Kneser-Ney by its definition: grams maps tuples of ORDER letters to counts."""
    counts = {langid.ORDER: dict(grams)}
    for n in range(langid.ORDER - 1, 0, -1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1

    def p(g):
        if not g:
            return 1 / classes
        own = counts[len(g)]
        once, twice = (sum(c == k for c in own.values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        after = {k[-1]: c for k, c in own.items() if k[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        return max(0, after.get(g[-1], d) - d) / sum(after.values()) + d * len(after) / sum(after.values()) * p(g[1:])

    return p


def test_models_equal_the_definition():
    text = "the cat and the dog saw \u4eca\u5929 that a theatre has the hat"
    letters = sorted({c for c in text if c.isalpha()})
    who = langid.Identifier([ord(c) for c in letters], {})
    who.prepare()
    codes, counts = np.unique(langid.grams([text], who.alphabet)[0], return_counts=True)
    unpack = lambda code: tuple(int(code) >> 16 * k & 0xFFFF for k in range(langid.ORDER - 1, -1, -1))
    plain = _kneser_ney({unpack(c): int(n) for c, n in zip(codes, counts, strict=True)}, len(letters) + 2)
    m = langid.Model.fit(codes, counts, len(letters) + 2)
    asked = langid.grams([text, "that thing \u4eca ends", "xyz"], who.alphabet)[0]
    assert np.exp(m.log_prob(asked)) == pytest.approx([plain(unpack(c)) for c in asked], abs=1e-12)


def test_texts_without_letters_and_equal_ids(spark):
    rows = [(i, "12 34 !?", "xx") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs.repartition(1)) is None
    words = [(None, f"the cat and dog number {chr(97 + i)} went to the house", "en") for i in range(20)] + [(7, f"le chien et le chat {chr(97 + i)} vont au jardin", "fr") for i in range(20)]
    mixed = docs.repartition(1).union(spark.createDataFrame(words, docs.schema).repartition(1))
    who = langid.fit(mixed, docs_per_lang=20)
    assert who is not None and sorted(who.models) == ["en", "fr"]
    got = {r["lang_pred"] for r in langid.identify(mixed.where("lang = 'fr'"), who).collect()}
    assert got == {"fr"}


def test_decontamination(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    vocabulary = [word() for _ in range(800)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(12, 60)) + ". " + text(6) + ".") for i in range(25)]
    docs = [(i, text(rng.randint(0, 500))) for i in range(300)]
    planted = {}
    for d in range(0, 50, 2):
        item = d // 2
        w = items[item][1].split()
        if item % 3 == 1:  # a close paraphrase: some words replaced or left out
            for at in rng.sample(range(len(w)), len(w) // 8):
                w[at] = rng.choice(["other", ""])
        docs[d] = (d, " ".join([text(rng.randint(0, 200)), *w, text(rng.randint(0, 200))]))
        planted[d] = item
    rows = [(*d, 0.1) for d in docs] + [(None, items[0][1], 0.1), (900, None, 0.1), (901, "", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cosine double")
    bench = spark.createDataFrame([*items, (98, None), (99, ""), (None, "x y")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(df, bench).collect()}
    assert got == set(planted.items())
    assert decontam.leaks(df, bench.where("1 = 0")).count() == 0
    assert decontam.leaks(df.where("1 = 0"), bench).count() == 0


def _windows_with_leak(items, i, words):
    """Whether any window of the text holds the item, by its longest common subsequence with every one."""
    n = len(items.words[i])
    size = decontam.BLOCK_WORDS * (decontam.SHORT_BLOCKS if n <= decontam.SHORT_ITEM else decontam.LONG_BLOCKS)
    for start in range(0, len(words), decontam.BLOCK_WORDS):
        region = words[max(0, start - n // 2) : start - n // 2 + max(n, size) + 2 * (n // 2)]
        share, answer = decontam.lcs(items.words[i], region) / n, decontam.lcs(items.answers[i], region) / len(items.answers[i])
        if share >= decontam.CERTAIN or share >= decontam.MIN_LCS and answer >= decontam.MIN_ANSWER:
            return True
    return False


def test_decontamination_recall_of_long_items_and_paraphrases(spark):
    rng = random.Random(13)
    words = [t.split() for t in (r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").orderBy("doc_id").collect()) if t]
    long = [w for w in words if len(w) > 520]
    items, docs = [], []
    for i, (n, kept) in enumerate([(n, kept) for n in (20, 45, 100, 200, 300, 500) for kept in (1.0, 0.7) for _ in range(12)]):
        source, other = rng.sample(long, 2)
        at = rng.randrange(len(source) - n)
        item = source[at : at + n]
        copy = [w if rng.random() < kept else rng.choice(other) for w in item]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(other[: rng.randrange(200)] + copy + other[300 : 300 + rng.randrange(200)])))
    assert max(b - a for n in range(65, 2000) for a, b in decontam.parts_of(n)) <= decontam.PART_WORDS
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(df, bench).collect()}
    rows = [{"item_id": i, "text": t, "answer": None} for i, t in items]
    prepared = decontam.prepared(rows, np.ones((decontam.FEATURES, 1), np.float32), np.ones(decontam.FEATURES, np.float32))
    want = {(i, i) for i, t in docs if _windows_with_leak(prepared, i, word_hashes([t])[0].tolist())}
    assert len(want) >= 120
    verbatim = {(i, i) for i in range(len(items)) if i // 12 % 2 == 0}
    assert verbatim <= want and verbatim <= got
    assert len(want & got) >= 0.95 * len(want)


def test_latent_basis_covers_all_documents(spark):
    """A few documents of many passages, each with words of its own, among 12,000 short ones: the basis has the direction of each."""
    few = [[f"w{i}x{k}" for k in range(64)] for i in range(6)]
    rows = [(i, f"short{i % 40} text{i % 31}") for i in range(12_000)] + [(100_000 + i, " ".join(w * 60)) for i, w in enumerate(few)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string")
    idf = decontam.idf_of(docs)
    basis = decontam.latent_basis(docs, items, idf)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3) or not basis.any(axis=0).all()
    for w in few:
        names, tf = np.unique(decontam.features(word_hashes([" ".join(w)])[0]), return_counts=True)
        x = tf * idf[names]
        assert np.linalg.norm(x / np.linalg.norm(x) @ basis[names]) > 0.95


def test_lcs():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(12)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        assert decontam.lcs(a, b) == plain(a, b)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = c.sql(ORACLE_SQL[name])
    columns = sorted(rel.columns)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    show = lambda r: tuple(str(list(x)) if isinstance(x, list | tuple) else str(x) for x in r)
    got = sorted(show([r[x] for x in columns]) for r in df.collect())
    want = sorted(map(show, c.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]}) t").fetchall()))
    assert got == want


def test_pipeline(spark):
    import corpus_pipeline as p

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(p.COLUMNS), name
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False))
    assert len(kept[0]) >= 195
    got = p.run(spark, SF)
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == kept[-1]


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as p

    none = spark.read.parquet(f"{SF}/documents.parquet").where("1 = 0")
    for _, stage in p.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_pipeline_with_null_and_repeated_ids(spark):
    """Rows without an id and rows that repeat one go through all stages: none gets lost or crashes a stage."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*p.COLUMNS)
    some = {r["doc_id"]: r for r in docs.where("length(text) > 400").orderBy("doc_id").limit(3).collect()}
    a, b, c = (tuple(r) for r in some.values())
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    more = [(None, *a[1:]), (None, *a[1:]), (None, *b[1:]), c, (None, item, "en", None, None), (None, None, None, None, None), (900001, item, None, None, None)]
    df = docs.where(~docs["doc_id"].isin(list(some))).unionByName(spark.createDataFrame([a, b, c, *more], docs.schema))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, df, SF)
        df = spark.createDataFrame(out.collect(), out.schema)
        without = sorted(r["text"] for r in df.where("doc_id is null").collect())
        assert without == sorted([a[1], a[1], b[1], item]), name  # the one without a text goes with language ID
        assert df.where(df["doc_id"] == c[0]).count() in (0, 2), name
    assert df.where("doc_id = 900001").count() == 0
    pieces = p.STAGES[-1][1](spark, df, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in df.select("doc_id").distinct().collect()}
