"""Best-fit packing: every id once, capacity kept, and nearly as few sequences as can be."""

import bisect
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import bestfit

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def plain_best_fit(sizes, capacity: int) -> int:
    """The number of bins of best-fit by decreasing size, with a sorted list of rooms."""
    rooms, n = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, s)
        if at == len(rooms):
            n += 1
            room = capacity
        else:
            room = rooms.pop(at)
        bisect.insort(rooms, room - s)
    return n


@pytest.mark.parametrize("seed", range(4))
def test_best_fit(seed):
    rng = random.Random(seed)
    sizes = np.array([rng.choice([rng.randint(1, 64), rng.randint(1, 20), 64]) for _ in range(500)])
    bins, offsets, fill = bestfit.best_fit(sizes, 64)
    assert len(fill) == plain_best_fit(sizes.tolist(), 64) and fill.max() <= 64
    for b in range(len(fill)):
        at = sorted((int(offsets[i]), int(sizes[i])) for i in np.flatnonzero(bins == b))
        assert [o for o, _ in at] == np.cumsum([0, *(s for _, s in at[:-1])]).tolist() and sum(s for _, s in at) == fill[b]


def held(rows, docs, capacity: int, end: int = 1):
    """Checks the pieces of docs (doc_id, text) and returns (sequences, tokens)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        want[doc] += [(p, s, len(x), zlib.crc32(array("I", x).tobytes())) for p, s in enumerate(range(0, len(ids), capacity)) for x in [ids[s : s + capacity]]]
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s[:-1])]).tolist() and sum(n for _, n in s) <= capacity
    return len(sequences), [n for s in sequences.values() for _, n in s]


@pytest.mark.parametrize(("parts", "portion"), [(1, 20_000), (9, 7), (40, 60)])
def test_pieces(spark, parts, portion):
    rng = random.Random(parts)
    words = "the quick brown fox jumps over lazy dogs, again and again.\n".split(" ")
    docs = [(i if i % 50 else None, " ".join(rng.choices(words, k=rng.choice([1, 5, 20, 40, 55, 300])))) for i in range(400)] + [(3, "again"), (5, None), (6, ""), (7, "x" * 20_000)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, bin string").repartition(parts)
    n, sizes = held(bestfit.best_fit_pieces(df, PATH, 64, portion=portion).collect(), docs, 64)
    assert plain_best_fit(sizes, 64) <= n <= 1.03 * plain_best_fit(sizes, 64) + 1


def test_query_and_none(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n, sizes = held(bestfit.op11_best_fit_packing(spark, sf).collect(), docs, 4096)
    assert n <= plain_best_fit(sizes, 4096) + 1
    spark.read.parquet(f"{sf}/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    assert bestfit.op11_best_fit_packing(spark, str(tmp_path)).count() == 0
