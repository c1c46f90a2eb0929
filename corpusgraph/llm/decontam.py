"""Benchmark decontamination by latent semantic retrieval.

Windows of every text and benchmark items are TF-IDF vectors over hashed words, projected on the leading singular vectors
of a passage matrix (randomised SVD, whose products are summed over tasks). Windows near an item in that space are
candidates; a longest common subsequence of words with the item, and with its answer alone, decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.common import portions, table, word_hashes

#: Words are hashed to so many features.
FEATURES = 1 << 14
RANK, OVERSAMPLE = 96, 8
#: Passages of the fit whose products are formed at a time; blocks of features in which tasks' sums meet, and tasks for each core and
#: in all at most, as each hands on FEATURES x (RANK + OVERSAMPLE) numbers.
PASSAGES_AT_ONCE, SUM_BLOCKS, FIT_TASKS_PER_CORE, MOST_FIT_TASKS = 32, 64, 8, 256
BLOCK_WORDS = 16
#: Items up to so many words are sought in windows of SHORT_BLOCKS blocks, longer ones in windows of LONG_BLOCKS.
SHORT_ITEM, SHORT_BLOCKS, LONG_BLOCKS = 24, 2, 4
#: Longer items are sought part by part: equal parts of at most so many words, each of which fits whole in a window.
PART_WORDS = BLOCK_WORDS * (LONG_BLOCKS - 1)
#: Candidates: cosine to the part of at least this share of what a window with MIN_LCS of the part's words would have.
NEAR = 0.6
#: Leaks: this share of the item's words in order, and of its answer's; or CERTAIN of the item's alone.
MIN_LCS, MIN_ANSWER, CERTAIN = 0.65, 0.5, 0.85
#: Items searched in one pass over the texts.
ITEMS_AT_ONCE = 4096


def answer_words(text: str | None, answer: str | None = None) -> str:
    """The given answer, else the last sentence of a text of several, else its last third."""
    if answer:
        return answer
    text = (text or "").strip()
    cut_at = max(text[:-1].rfind(". "), text[:-1].rfind("\n"), text[:-1].rfind("? "))
    if cut_at > 0:
        return text[cut_at + 1 :]
    words = text.split()
    return " ".join(words[len(words) * 2 // 3 :])


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors over a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = s = (1 << len(a)) - 1
    for x in b:
        if m := masks.get(x):
            u = s & m
            s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def features(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(50)).astype(np.int64)


def _document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many texts have each feature; the last row counts the texts."""
    counts = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        texts = batch["text"].tolist()
        for a, b in portions(texts):
            words, sizes = word_hashes(texts[a:b])
            of = np.repeat(np.arange(b - a, dtype=np.int64), sizes)
            seen = np.unique(of * FEATURES + features(words)) % FEATURES
            counts[:FEATURES] += np.bincount(seen, minlength=FEATURES)
            counts[FEATURES] += b - a
    hit = np.flatnonzero(counts)
    yield pd.DataFrame({"feature": hit, "n": counts[hit]})


def idf_of(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every feature over all documents; the driver gets FEATURES numbers."""
    rows = docs.select("text").mapInPandas(_document_counts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(FEATURES + 1)
    counts[rows["feature"].to_numpy()] = rows["n"]
    return np.log((1 + counts[FEATURES]) / (1 + counts[:FEATURES])).astype(np.float32)


def _tfidf(texts: list[str | None], idf: np.ndarray, per: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, unit weights: a column for each passage) of a few passages at a time: `per` words of a text, or the whole text."""
    words, sizes = word_hashes(texts)
    f, sizes = features(words), sizes[sizes > 0]
    n = -(-sizes // per) if per else np.ones(len(sizes), np.int64)
    first, before = np.cumsum(sizes) - sizes, np.cumsum(n) - n
    starts = np.repeat(first, n) + (per or 0) * (np.arange(n.sum()) - np.repeat(before, n))
    place = np.zeros(FEATURES, np.int64)
    for x in range(0, len(starts), PASSAGES_AT_ONCE):
        edges = np.append(starts[x : x + PASSAGES_AT_ONCE + 1], len(f))[: PASSAGES_AT_ONCE + 1]
        own, k = f[edges[0] : edges[-1]], len(edges) - 1
        seen = np.zeros(FEATURES, bool)
        seen[own] = True
        names = np.flatnonzero(seen)
        place[names] = np.arange(len(names))
        tf = np.bincount(place[own] * k + np.repeat(np.arange(k), np.diff(edges)), minlength=len(names) * k).reshape(-1, k)
        w = tf.astype(np.float32) * idf[names][:, None]
        norm = np.sqrt((w**2).sum(axis=0))
        yield names, w / np.where(norm > 0, norm, 1)


def _products(test, idf, per: int | None):
    """Sums over the task's passages of x (x' B), as rows of blocks of features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = test.value
        total = np.zeros((FEATURES, b.shape[1]), np.float32)
        for batch in batches:
            texts = batch["text"].tolist()
            for first, last in portions(texts):
                for names, w in _tfidf(texts[first:last], idf.value, per):
                    total[names] += w @ (w.T @ b[names])
        yield pd.DataFrame({"block": range(SUM_BLOCKS), "sums": [x.tobytes() for x in np.split(total, SUM_BLOCKS)]})

    return run


def _added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"block": [key[0]], "sums": [np.sum([np.frombuffer(x, np.float32) for x in rows["sums"]], axis=0, dtype=np.float32).tobytes()]})


def _applied(texts: DataFrame, idf, test, per: int | None) -> np.ndarray:
    """A'A times the test matrix (FEATURES x a few numbers) for the passages A of all texts."""
    sc = texts.sparkSession.sparkContext
    tasks = min(MOST_FIT_TASKS, FIT_TASKS_PER_CORE * sc.defaultParallelism)
    parts = texts.coalesce(tasks).mapInPandas(_products(test, idf, per), "block int, sums binary")
    out = np.zeros((SUM_BLOCKS, FEATURES // SUM_BLOCKS, test.value.shape[1]), np.float32)
    for r in parts.groupBy("block").applyInPandas(_added, "block int, sums binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["sums"], np.float32).reshape(out.shape[1:])
    return out.reshape(FEATURES, -1).astype(np.float64)


def latent_basis(docs: DataFrame, items: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 6) -> np.ndarray:
    """Leading right singular vectors (FEATURES x rank) of the passages of all documents and items.

    Randomised, in one pass (Nystrom): A'A is applied to a random matrix; the tasks add up their own passages, and the driver
    holds FEATURES x (rank + OVERSAMPLE) numbers. Items have about as much weight as the documents.
    """
    spark = docs.sparkSession
    weight = max(1, items.count()) / (4.0 * max(1, docs.count()))
    test, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((FEATURES, rank + OVERSAMPLE)))
    shared_idf, shared = spark.sparkContext.broadcast(idf), spark.sparkContext.broadcast(test.astype(np.float32))
    y = weight * _applied(docs.select("text"), shared_idf, shared, BLOCK_WORDS * LONG_BLOCKS) + 4 * _applied(items.select("text"), shared_idf, shared, None)
    test = shared.value.astype(np.float64)
    # A'A is y (test' y)^-1 y' on what it was applied to; a share of rounding's size keeps the inverse within bounds
    y += 1e-6 * np.linalg.norm(y) * test
    values, vectors = np.linalg.eigh((test.T @ y + y.T @ test) / 2)
    some = values > 1e-9 * max(values.max(), 1e-300)
    basis = np.zeros((FEATURES, rank), np.float32)
    if some.any():
        left = np.linalg.svd(y @ (vectors[:, some] / np.sqrt(values[some])), full_matrices=False)[0][:, :rank]
        basis[:, : left.shape[1]] = left
    return basis


@dataclass
class Items:
    """What the tasks need of the items: ids, words, words with counts and sorted, answers; and of their parts: item, first word, latent vectors, the
    least cosine and the windows to use."""

    ids: list[int]
    words: list[list[int]]
    counts: list[Counter[int]]
    known: list[np.ndarray]
    answers: list[list[int]]
    of: np.ndarray
    offsets: np.ndarray
    vectors: np.ndarray
    least: np.ndarray
    blocks: np.ndarray


def parts_of(n: int) -> list[tuple[int, int]]:
    """(first, last) word of the parts of an item of n words: the whole of one that fits in a window, else equal parts.

    Where a subsequence holds a share of the item, it holds at least that share of one of the parts.
    """
    k = 1 if n <= BLOCK_WORDS * LONG_BLOCKS else -(-n // PART_WORDS)
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


def prepared(rows: list, basis: np.ndarray, idf: np.ndarray) -> Items:
    texts = [r["text"] for r in rows]

    def lists(texts: list[str]) -> list[list[int]]:
        words, sizes = word_hashes(texts)
        return [x.tolist() for x in np.split(words, np.cumsum(sizes)[:-1])]

    words = lists(texts)
    parts = [(i, *p) for i, w in enumerate(words) for p in parts_of(len(w))]
    vectors = []
    for i, a, b in parts:
        names, tf = np.unique(features(np.array(words[i][a:b], np.uint64)), return_counts=True)
        w = tf * idf[names]
        vectors.append(w @ basis[names] / max(1e-9, np.sqrt((w**2).sum())))
    vectors = np.stack(vectors)
    own = np.maximum((vectors**2).sum(axis=1), 1e-9)
    n = np.array([b - a for _, a, b in parts])
    blocks = np.where(n <= SHORT_ITEM, SHORT_BLOCKS, LONG_BLOCKS)
    dilution = np.sqrt(np.minimum(1.0, n / (BLOCK_WORDS * blocks)))
    known = [np.unique(np.array(w, np.uint64)) for w in words]
    answers = lists([answer_words(r["text"], r["answer"]) for r in rows])
    of, offsets = np.array([i for i, *_ in parts]), np.array([a for _, a, _ in parts])
    return Items([r["item_id"] for r in rows], words, [Counter(w) for w in words], known, answers, of, offsets, vectors.astype(np.float32), (NEAR * MIN_LCS * own * dilution).astype(np.float32), blocks)


def _judge(items: Items, i: int, region: list[int]) -> tuple[float, float]:
    own, answer, counts = items.words[i], items.answers[i], items.counts[i]
    shared = counts.keys() & region
    if sum(map(counts.__getitem__, shared)) < MIN_LCS * len(own):  # no subsequence can be longer
        return 0.0, 0.0
    region = [w for w in region if w in shared]
    share = lcs(own, region) / len(own)
    return share, (lcs(answer, region) / len(answer) if answer and share >= MIN_LCS else 1.0)


def _possible(known: np.ndarray, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many words of each region (first to last, sorted) are words of the item: no subsequence is longer."""
    low = first.min()
    own = words[low : last.max()]
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    sums = np.concatenate([[0], np.cumsum(known[at] == own)])
    return sums[last - low] - sums[first - low]


def search(texts: list[str | None], items: Items, basis: np.ndarray, squares: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(text, item, cosine, share of the item, share of the answer) of the leaks: the best window of each pair.

    basis: FEATURES rows, and one of zeros.
    """
    words, sizes = word_hashes(texts)
    if not len(words):
        return []
    f = features(words)
    n_blocks = -(-sizes // BLOCK_WORDS)
    first_word, first_block = np.cumsum(sizes) - sizes, np.cumsum(n_blocks) - n_blocks
    of = np.repeat(np.arange(len(sizes)), n_blocks)
    starts = first_word[of] + BLOCK_WORDS * (np.arange(n_blocks.sum()) - first_block[of])
    sums = np.zeros((len(starts), basis.shape[1]), np.float32)
    step, ends = 2048, np.append(starts[1:], len(f))
    for x in range(0, len(starts), step):  # few words at a time: their vectors are large
        a, b, into = starts[x : x + step], ends[x : x + step], sums[x : x + step]
        one = np.empty_like(into)
        for k in range(BLOCK_WORDS):  # the last row of the basis stands for no word
            np.take(basis, np.where(a + k < b, f[np.minimum(a + k, len(f) - 1)], FEATURES), axis=0, out=one, mode="clip")
            into += one
    norms = np.add.reduceat(squares[f], starts)
    lengths = np.array([len(w) for w in items.words])
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for blocks in (SHORT_BLOCKS, LONG_BLOCKS):
        which = np.flatnonzero(items.blocks == blocks)
        if not len(which):
            continue
        window, square = sums.copy(), norms.copy()
        for k in range(1, blocks):  # following blocks of the same text
            same = np.zeros(len(of), bool)
            same[: len(of) - k] = of[k:] == of[: len(of) - k]
            at = np.flatnonzero(same)
            window[at] += sums[at + k]
            square[at] += norms[at + k]
        window /= np.sqrt(np.maximum(square, 1e-9))[:, None]
        for x in range(0, len(of), 4096):
            near = window[x : x + 4096] @ items.vectors[which].T
            w, j = np.nonzero(near >= items.least[which][None, :])
            cosine, at, part = near[w, j], w + x, which[j]
            item, text, n = items.of[part], of[at], lengths[items.of[part]]
            start = starts[at] - items.offsets[part] - n // 2
            a = np.maximum(first_word[text], start)
            b = np.minimum(first_word[text] + sizes[text], start + np.maximum(n, BLOCK_WORDS * blocks) + 2 * (n // 2))
            order = np.lexsort((at, item, text))
            cuts = np.flatnonzero(np.diff(text[order]) | np.diff(item[order])) + 1
            for pairs in np.split(order, cuts) if len(order) else []:
                t, i = int(text[pairs[0]]), int(item[pairs[0]])
                most = _possible(items.known[i], words, a[pairs], b[pairs])
                for k in pairs[most >= MIN_LCS * n[pairs]]:
                    share, answer = _judge(items, i, words[a[k] : b[k]].tolist())
                    if (share >= CERTAIN or share >= MIN_LCS and answer >= MIN_ANSWER) and share > found.get((t, i), (0, 0, 0))[1]:
                        found[t, i] = float(cosine[k]), share, answer
    return [(t, i, *x) for (t, i), x in found.items()]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, item_share, answer_share) of every document that holds a benchmark item or a close
    paraphrase of it.

    docs: doc_id, text; benchmark: item_id, text and, if it has one, answer. Null and empty texts, and rows without an
    id, match nothing. Repeated rows give a row for each. Items of up to ITEMS_AT_ONCE are searched in one pass over the
    whole texts, more in further passes. An empty benchmark or table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").rlike(r"[^ \t\n\x0b\f\r]")).select("item_id", "text", answer.alias("answer"))
    schema = "doc_id long, item_id long, cosine double, item_share double, answer_share double"
    n_items = items.count()
    if not n_items:
        return spark.createDataFrame([], schema)
    idf = idf_of(docs)
    basis = latent_basis(docs, items, idf)
    weighted = spark.sparkContext.broadcast(np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]), np.float32)]))
    squares = spark.sparkContext.broadcast(idf**2)
    passes = -(-n_items // ITEMS_AT_ONCE)
    out = None
    for k in range(passes):
        some = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        rows = some.collect()  # at most some ITEMS_AT_ONCE
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(prepared(rows, basis, idf))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
                for a, b in portions(texts):
                    hits = search(texts[a:b], shared.value, weighted.value, squares.value)
                    if hits:
                        yield pd.DataFrame([(ids[a + t], shared.value.ids[i], c, p, q) for t, i, c, p, q in hits], columns=["doc_id", "item_id", "cosine", "item_share", "answer_share"])

        found = docs.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("item_share", 6).alias("item_share"), F.round("answer_share", 6).alias("answer_share"))
