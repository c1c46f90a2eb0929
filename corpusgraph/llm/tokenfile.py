"""Token ids in binary files: fixed-width bit packing with block offsets.

File: payload, index, footer. The payload holds blocks of BLOCK_IDS ids, each id in the least number of bits that holds
the vocabulary (bit i of an id is bit i of its place, lowest first), each block padded to whole bytes. The index holds
document ids (int64), a byte for each that says if it is null, the end of each document in ids (int64) and the byte
offset of each block (int64, one more than blocks). Footer: FOOTER. So any span of ids is read with one seek and
unpacked with numpy.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.llm.common import cut, new_folder, table
from corpusgraph.llm.tokens import END_ID, encoder

MAGIC = b"IDBITS01"
BLOCK_IDS = 1 << 15
#: magic, bits of an id, ids of a block, documents, ids, bytes of the payload
FOOTER = struct.Struct("<8sIIqqq")

MANIFEST = "part int, path string, n_docs long, n_ids long"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (spread.astype("<u4") << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def _store(uri: str):
    """A pyarrow filesystem and the path in it: local folders and whatever stores pyarrow knows."""
    from pyarrow import fs

    if re.match(r"file:|/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.docs: list[int | None] = []
        self.ends: list[int] = []
        self.offsets = [0]
        self.ids = 0
        self.rest = np.zeros(0, "<u4")

    def _blocks(self, ids: np.ndarray) -> None:
        for at in range(0, len(ids), BLOCK_IDS):
            data = pack(ids[at : at + BLOCK_IDS], self.bits)
            self.stream.write(data)
            self.offsets.append(self.offsets[-1] + len(data))

    def add(self, docs: list[int | None], ids: list[bytes]) -> None:
        for d, x in zip(docs, ids, strict=True):
            self.ids += len(x) // 4
            self.docs.append(d)
            self.ends.append(self.ids)
        got = np.concatenate([self.rest, np.frombuffer(b"".join(ids), "<u4")])
        full = len(got) - len(got) % BLOCK_IDS
        self._blocks(got[:full])
        self.rest = got[full:].copy()

    def close(self) -> None:
        self._blocks(self.rest)
        null = np.array([d is None for d in self.docs], np.uint8)
        for x in (np.array([d or 0 for d in self.docs], "<i8"), null, np.array(self.ends, "<i8"), np.array(self.offsets, "<i8")):
            self.stream.write(x.tobytes())
        self.stream.write(FOOTER.pack(MAGIC, self.bits, BLOCK_IDS, len(self.docs), self.ids, self.offsets[-1]))


class TokenFile:
    """Random access to a file: ids(a, b) unpacks the blocks that hold the span alone."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        magic, self.bits, self.block, n, self.n_ids, payload = FOOTER.unpack(stream.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        index = stream.read_at(size - FOOTER.size - payload, payload)
        docs, null = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n)
        self.docs = [None if z else int(d) for d, z in zip(docs, null, strict=True)]
        self.ends = np.frombuffer(index, "<i8", n, 9 * n)
        self.offsets = np.frombuffer(index, "<i8", -(-self.n_ids // self.block) + 1, 17 * n)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, "<u4")
        first, last = a // self.block, -(-b // self.block)
        data = self.stream.read_at(int(self.offsets[last] - self.offsets[first]), int(self.offsets[first]))
        if self.bits not in (8, 16, 32):  # block by block: unpacked bits take far more room than ids
            parts = [unpack(data[self.offsets[i] - self.offsets[first] : self.offsets[i + 1] - self.offsets[first]], self.bits, min(self.block, self.n_ids - i * self.block)) for i in range(first, last)]
            got = np.concatenate(parts)
        else:
            got = unpack(data, self.bits, min(last * self.block, self.n_ids) - first * self.block)
        return got[a - first * self.block : b - first * self.block]


def _writer(folder: str, path: str, end: bytes, blanks: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, words, out = TaskContext.get().partitionId(), encoder(path, blanks), None
        name = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex[:8]}.bin"  # of this attempt alone: the manifest names those that count
        store, at = _store(name)
        for batch in batches:
            if out is None and len(batch):
                store.create_dir(at.rpartition("/")[0], recursive=True)
                stream = store.open_output_stream(at)
                out = TokenFileWriter(stream, bits_for(max(words.vocabulary, END_ID + 1)))
            docs = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            texts = batch["text"].tolist()
            for i in range(0, len(docs), 256):
                out.add(docs[i : i + 256], [ids + end for ids in words.encode(texts[i : i + 256])])
        if out is not None:
            out.close()
            stream.close()
            yield pd.DataFrame({"part": [part], "path": [name], "n_docs": [len(out.docs)], "n_ids": [out.ids]})

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, blanks: bool = False, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of all documents (doc_id, text) in ascending doc_id order and returns the manifest (MANIFEST).

    Each document is its ids and then end_id (a null or empty text: end_id alone). Files follow one another by `part`.
    Null doc_ids come first; rows with one doc_id stand in the order of the input. An empty table writes no file. The
    folder must be one that all executors reach.
    """
    placed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    ordered = placed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    end = np.array([end_id], "<u4").tobytes()
    return cut(ordered.select("doc_id", "text").mapInPandas(_writer(folder, tokenizer_path, end, blanks), MANIFEST))


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            store, at = _store(r.path)
            with store.open_input_file(at) as stream:
                f = TokenFile(stream)
                starts = np.concatenate([[0], f.ends[:-1]])
                first = 0
                while first < len(f.docs):  # some 16 MB of ids at a time, a long document alone
                    last = max(first + 1, int(np.searchsorted(f.ends, starts[first] + (1 << 22), "right")))
                    ids = f.ids(int(starts[first]), int(f.ends[last - 1])).tobytes()
                    at0 = int(starts[first])
                    spans = list(zip(starts[first:last].tolist(), f.ends[first:last].tolist(), strict=True))
                    crc = [zlib.crc32(ids[4 * (a - at0) : 4 * (b - at0)]) for a, b in spans]
                    yield pd.DataFrame({"doc_id": pd.array(f.docs[first:last], "Int64"), "start": [r.base + a for a, _ in spans], "n_tokens": [b - a for a, b in spans], "ids_crc32": crc})
                    first = last


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; start: ids of all documents before it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = cut(manifest.select("part", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")))
    dealt = files.repartition(max(1, files.count()), "part").select("path", "base")
    return dealt.mapInPandas(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as files and read back."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, new_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest)
