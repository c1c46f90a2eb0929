"""Best-fit packing of whole documents: hierarchical residual packing.

A document longer than the capacity is cut into full pieces, which are sequences of their own, and a rest; rests and shorter
documents are items. Each task packs its items best-fit, longest first, a portion at a time; bins that are nearly full are
done. Bins with room left are items of the next round: they meet those of other tasks in groups of bounded size, and are
packed best-fit again, whole, as often as that saves bins and until one group is left.

Only numbers move between tasks, and of these only those of bins with room. A bin keeps the least id of its pieces as its
own, so a repeated task makes the same bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.common import blocks_of, stored, table
from corpusgraph.llm.tokens import END_ID, encoder

CAPACITY = 4096
#: A bin with at most so many tokens of room in 256 of its capacity is done.
ROOM_256 = 1
#: Items that are packed at once.
PORTION = 20_000
#: A further round is worth it where the last one saved one bin in so many.
WORTH = 200

_PIECES = "bin long, offset long, fill long, done boolean, uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_COLUMNS = [c.split()[0] for c in _PIECES.split(", ")]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin): longest item first, each into the fullest bin that takes it.

    Ties go to the item that comes first, and to the bin that got that room last. Sizes are 1 to capacity.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms = 0  # bit r is set where some bin has room r
    fill: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            with_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


def _packed(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The bins of rows packed as items into fewer ones; rows of a bin together, by offset."""
    first = np.flatnonzero(rows["offset"].to_numpy() == 0)
    item = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
    bins, offsets, fill = best_fit(rows["fill"].to_numpy()[first], capacity)
    of = bins[item]
    uid = rows["uid"].to_numpy()
    least = np.full(len(fill), np.iinfo(np.int64).max)
    np.minimum.at(least, of, uid)
    return rows.assign(bin=least[of], offset=rows["offset"].to_numpy() + offsets[item], fill=fill[of], done=(capacity - fill[of]) * 256 <= ROOM_256 * capacity)


def _local(path: str, capacity: int, end: bytes, portion: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, uid = encoder(path, blanks=False), TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=_COLUMNS)
            out["doc_id"] = out["doc_id"].astype("Int64")
            whole = out["fill"] == capacity
            return pd.concat([out[whole], _packed(out[~whole].reset_index(drop=True), capacity)])

        for batch in batches:
            docs, texts = [None if pd.isna(d) else int(d) for d in batch["doc_id"]], batch["text"].tolist()
            for at in range(0, len(docs), 256):
                for doc, ids in zip(docs[at : at + 256], words.encode(texts[at : at + 256]), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        rows.append((uid, 0, len(own) // 4, len(own) == 4 * capacity, uid, doc, piece, start, len(own) // 4, zlib.crc32(own)))
                        uid += 1
                if len(rows) >= portion:
                    yield frame()
                    rows = []
        if rows:
            yield frame()

    return run


def best_fit_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, portion: int = PORTION) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents (doc_id, text).

    A document is its ids and then end_id; a null or empty text is the end id alone. Only documents over the capacity are
    cut, into full pieces and a last one that may be shorter. sequence_id is unique, offset gapless within it. Null and
    repeated doc_ids are packed as documents of their own; other columns are left out; an empty table gives no rows.
    """
    end = np.array([end_id], "<u4").tobytes()
    last = stored(docs.select("doc_id", "text").mapInPandas(_local(tokenizer_path, capacity, end, portion), _PIECES), "bins")

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="group").sort_values(["bin", "offset"], ignore_index=True)
        return _packed(rows, capacity)

    finished, bins, groups = [], None, None
    while True:
        finished.append(last.where("done"))
        left = last.where("not done")
        n = left.where("offset = 0").count()
        if not n or groups == 1 or (bins is not None and (bins - n) * WORTH < bins):
            break
        bins, groups = n, blocks_of(n, portion)
        in_groups = left.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(len(finished))), F.lit(groups)))
        last = stored(in_groups.groupBy("group").applyInPandas(merge, _PIECES), "bins")
    out = left
    for part in finished:
        out = out.unionByName(part)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of at most 4096 tokens as best-fit rounds find."""
    import public_tokenizers

    return best_fit_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
