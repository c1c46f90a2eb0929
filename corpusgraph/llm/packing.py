"""Hierarchical multi-length packing of documents into training sequences.

A document is cut into whole windows of the longest context; what is left of it goes to the tier of the shortest
context that holds it. Each tier is packed into windows of its own size; the gap that the tier's next piece can't fill is
filled from shorter tiers, and at last by cutting a piece. Windows of a tier are exactly full, so they need no padding.
All of it happens within a task, on a stream of batches: a task holds a few windows of pending pieces for each tier, and
only its last sequence may be padded.

Sequences of one context are then dealt into step groups over all tasks: the pieces are stored, each task's number of
sequences of a context is counted, and the running numbers are cut into groups whose sizes differ by one at most. Only these
counts are sent; no piece is shuffled.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.common import stored, table
from corpusgraph.llm.tokens import END_ID, encoder

CONTEXTS = (256, 512, 1024, 2048)
#: A tier waits until it holds so many windows, so that it can fill the gaps of longer ones.
WINDOWS_AHEAD = 4
#: Tokens of a step group.
STEP_TOKENS = 1 << 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int"
#: With the task, and the sequence's number among those of its context there.
_PACKED = f"{PIECES}, part int, nth long"


class _Piece:
    __slots__ = ("doc", "tokens", "ids", "start", "length")

    def __init__(self, doc, tokens, ids, start, length):
        self.doc, self.tokens, self.ids, self.start, self.length = doc, tokens, ids, start, length


class TierPacker:
    """Takes documents one by one, keeps finished rows in `rows`."""

    def __init__(self, contexts: tuple[int, ...], partition: int):
        self.contexts = sorted(contexts)
        self.tiers: dict[int, deque[_Piece]] = {c: deque() for c in self.contexts}
        self.held = dict.fromkeys(self.contexts, 0)
        self.made = dict.fromkeys(self.contexts, 0)
        self.partition, self.sequence = partition, partition << 36
        self.rows: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        tokens, longest = len(ids) // 4, self.contexts[-1]
        whole = tokens - tokens % longest
        for start in range(0, whole, longest):
            self._emit([_Piece(doc, tokens, ids[4 * start : 4 * (start + longest)], start, longest)], longest)
        if whole < tokens:
            self._route(_Piece(doc, tokens, ids[4 * whole :], whole, tokens - whole))
        for c in reversed(self.contexts):
            while self.held[c] >= WINDOWS_AHEAD * c:
                self._window(c)

    def finish(self) -> None:
        """Packs what is pending, longest context first; the last sequence may stay short."""
        pending = deque(p for c in reversed(self.contexts) for p in self.tiers[c])
        left = sum(p.length for p in pending)
        for c in reversed(self.contexts):
            self.tiers[c].clear()
            self.held[c] = 0
        while left:
            room = size = next((c for c in reversed(self.contexts) if c <= left), left)
            pieces = []
            while room:
                p = pending.popleft()
                if p.length > room:
                    p, rest = self._cut(p, room)
                    pending.appendleft(rest)
                pieces.append(p)
                room -= p.length
            left -= size
            self._emit(pieces, size if size in self.held else self.contexts[-1])

    def _route(self, p: _Piece, front: bool = False) -> None:
        c = next(c for c in self.contexts if p.length <= c)
        (self.tiers[c].appendleft if front else self.tiers[c].append)(p)
        self.held[c] += p.length

    def _take(self, c: int) -> _Piece:
        p = self.tiers[c].popleft()
        self.held[c] -= p.length
        return p

    @staticmethod
    def _cut(p: _Piece, at: int) -> tuple[_Piece, _Piece]:
        return _Piece(p.doc, p.tokens, p.ids[: 4 * at], p.start, at), _Piece(p.doc, p.tokens, p.ids[4 * at :], p.start + at, p.length - at)

    def _window(self, context: int) -> None:
        pieces, room = [], context
        while room:
            c = next((c for c in reversed(self.contexts) if c <= context and self.tiers[c] and self.tiers[c][0].length <= room), None)
            if c is not None:
                p = self._take(c)
            else:  # no piece fits: the shortest tier that has one gives its head
                c = next(c for c in self.contexts if self.tiers[c])
                p, rest = self._cut(self._take(c), room)
                self._route(rest, front=True)
            pieces.append(p)
            room -= p.length
        self._emit(pieces, context)

    def _emit(self, pieces: list[_Piece], context: int) -> None:
        offset, nth = 0, self.made[context]
        self.made[context] += 1
        for p in pieces:
            self.rows.append((p.doc, p.start, p.length, zlib.crc32(p.ids), p.tokens, self.sequence, offset, context, self.partition, nth))
            offset += p.length
        self.sequence += 1


def _pack(path: str, contexts: tuple[int, ...], end: bytes):
    columns = [c.split()[0] for c in _PACKED.split(", ")]

    def frame(packer: TierPacker) -> pd.DataFrame:
        out = pd.DataFrame(packer.rows, columns=columns)
        out["doc_id"] = out["doc_id"].astype("Int64")
        packer.rows = []
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, words = TierPacker(contexts, TaskContext.get().partitionId()), encoder(path, blanks=True)
        for batch in batches:
            docs = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            texts = batch["text"].tolist()
            for at in range(0, len(docs), 256):
                for doc, ids in zip(docs[at : at + 256], words.encode(texts[at : at + 256]), strict=True):
                    packer.add(doc, ids + end)
                if len(packer.rows) > 10_000:
                    yield frame(packer)
        packer.finish()
        if packer.rows:
            yield frame(packer)

    return run


def packed_pieces(docs: DataFrame, tokenizer_path: str, contexts: tuple[int, ...] = CONTEXTS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """The pieces of all documents (doc_id, text): PIECES and step_group.

    A document is its ids and then end_id; a null or empty text is the end id alone. Each id lies in exactly one piece.
    sequence_id is unique, offset gapless within it. Sequences of `context` tokens are full but for the last one of a
    task, which is to be padded to the longest context. A step group has sequences of one context alone, of step_tokens
    together or a little less; the groups of a context differ by one sequence at most. Null and repeated doc_ids are packed
    as rows of their own; other columns are left out; an empty table gives no rows. Contexts must be powers of two.
    """
    end = np.array([end_id], "<u4").tobytes()
    pieces = stored(docs.select("doc_id", "text").mapInPandas(_pack(tokenizer_path, contexts, end), _PACKED), "pieces")
    made = sorted(pieces.groupBy("part", "context").agg(F.max("nth") + 1).collect())  # some numbers for each task
    totals: dict[int, int] = dict.fromkeys(contexts, 0)
    before = []
    for part, context, n in made:
        before.append((part, context, totals[context]))
        totals[context] += n
    sizes = [(c, i, n, -(-n // max(1, step_tokens // c))) for i, (c, n) in enumerate(sorted(totals.items()))]
    spark = docs.sparkSession
    places = spark.createDataFrame(before, "part int, context int, before long").join(F.broadcast(spark.createDataFrame(sizes, "context int, at int, total long, groups long")), "context")
    # the groups of a context after those of shorter ones; number nth of n is in group nth * groups / n
    group = F.col("at").cast("long") * (1 << 40) + F.expr("((before + nth) * groups) div total")
    numbered = pieces.join(F.broadcast(places), ["part", "context"]).withColumn("step_group", group)
    return numbered.select(*(c.split()[0] for c in PIECES.split(", ")), "step_group")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packed_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
