"""Token ids in binary files with directly addressable codes.

A file holds the ids of documents in ascending id order. Each id is cut into 8-bit chunks, lowest first. Level j keeps one
chunk of every id that has more than j chunks, a bitmap that says which of them go on to level j + 1, and a rank directory
(ones before each block of 512 bits). The token at position i is found from level 0's chunk i; where its bit is set, its
next chunk is at the bit's rank on the next level. No block is decoded to reach a token.

Layout: magic, counts, then doc ids, token offsets and for each level chunks, bitmap and ranks, as little-endian arrays.
Null and empty texts are documents of the end id alone; a very long text is held whole by one task; null ids sort first and come back
null; repeated rows are kept, each as its own document, rows of one id in the order of their texts. An empty table gives no files and
an empty result. Extra columns are not read, whatever their names. The files are the operator's output and stay in their folder.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, fs_of, put_file, scratch
from .tokens import encoder

MAGIC = b"QDAC0001"
BLOCK = 512
#: Tokens after which a task begins its next file: bounds what it holds.
FILE_TOKENS = 4_000_000
_NULL_ID = -(2**63)
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def build_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, ranks) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.concatenate([_ONES[bits].astype(np.uint64), np.zeros(-len(bits) % (BLOCK // 8), dtype=np.uint64)])
        sums = padded.reshape(-1, BLOCK // 8).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(sums)[:-1]]).astype("<u8") if len(sums) else np.zeros(0, dtype="<u8")
        levels.append(((rest & 0xFF).astype(np.uint8), bits, ranks))
        rest = rest[more] >> np.uint32(8)
    return levels


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """Parts of one file."""
    levels = build_levels(ids)
    head = MAGIC + struct.pack("<QQI", len(doc_ids), len(ids), len(levels)) + struct.pack(f"<{len(levels)}Q", *(len(c) for c, _, _ in levels))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    return [head, doc_ids.astype("<i8").tobytes(), offsets.tobytes(), *(a.tobytes() for level in levels for a in level)]


class TokenFile:
    """Random access to one file by range reads: only the directory is held."""

    def __init__(self, uri: str):
        fs, path = fs_of(uri)
        self.file = fs.open_input_file(path)
        head = self.file.read(28)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.n_docs, self.n_tokens, n = struct.unpack("<QQI", head[8:])
        sizes = struct.unpack(f"<{n}Q", self.file.read(8 * n))
        self.doc_ids = np.frombuffer(self.file.read(8 * self.n_docs), dtype="<i8")
        self.offsets = np.frombuffer(self.file.read(8 * (self.n_docs + 1)), dtype="<u8").astype(np.int64)
        at, self.levels = 28 + 8 * n + 8 * self.n_docs + 8 * (self.n_docs + 1), []
        for size in sizes:
            bitmap = at + size
            ranks = bitmap + -(-size // 8)
            self.levels.append((size, at, bitmap, ranks))
            at = ranks + 8 * -(-size // BLOCK)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids of positions start to end, read from their own chunks, bits and rank entries alone."""
        start, end = max(0, start), min(end, self.n_tokens)
        ids = np.zeros(max(0, end - start), dtype=np.uint32)
        where, lo, hi = np.arange(len(ids)), start, end
        for j, (_, at, bitmap, ranks) in enumerate(self.levels):
            if hi <= lo:
                break
            ids[where] |= np.frombuffer(self._read(at + lo, hi - lo), dtype=np.uint8).astype(np.uint32) << np.uint32(8 * j)
            block = lo // BLOCK
            first = block * (BLOCK // 8)
            bits = np.unpackbits(np.frombuffer(self._read(bitmap + first, -(-hi // 8) - first), dtype=np.uint8), bitorder="little")
            (before,) = struct.unpack("<Q", self._read(ranks + 8 * block, 8))
            more = bits[lo - first * 8 : hi - first * 8].astype(bool)
            lo = before + int(bits[: lo - first * 8].sum())
            hi = lo + int(more.sum())
            where = where[more]
        return ids

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])


def _writer(path: str, folder: str, end_id: int, file_tokens: int):
    def write(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, tool = TaskContext.get().partitionId(), encoder(path)
        keys, counts, ids, number, held = [], [], [], 0, 0
        end = np.array([end_id], dtype=np.uint32).tobytes()

        def done() -> pd.DataFrame:
            nonlocal keys, counts, ids, number, held
            name = f"tokens-{part:06d}-{number:06d}.dac"
            put_file(f"{folder}/{name}", pack(np.array(keys, dtype=np.int64), np.array(counts, dtype=np.int64), np.concatenate(ids)))
            row = pd.DataFrame({"part": [part], "number": [number], "name": [name], "n_tokens": [held]})
            keys, counts, ids, number, held = [], [], [], number + 1, 0
            return row

        for pdf in rows:
            for key, got in zip(pdf["id"], tool.encode(list(pdf["text"])), strict=True):
                keys.append(key)
                counts.append(len(got) // 4 + 1)
                ids.append(np.frombuffer(got + end, dtype=np.uint32))
                held += counts[-1]
                if held >= file_tokens:
                    yield done()
        if keys:
            yield done()

    return write


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> list[tuple[str, int]]:
    """Write all documents in ascending id order; (file, tokens before it) of each file, in order.

    Documents are dealt into ranges of ids; a task begins a new file after file_tokens tokens. Only one small row per file comes to the driver.
    """
    batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    stats = dealt.mapInPandas(_writer(tokenizer_path, folder, end_id, file_tokens), "part int, number int, name string, n_tokens long").collect()
    out, before = [], 0
    for row in sorted(stats, key=lambda r: (r["part"], r["number"])):
        out.append((row["name"], before))
        before += row["n_tokens"]
    return out


def read_token_files(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """Per document from the files: id, start over all files, tokens, crc32 of its ids."""

    def read(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for name, before in zip(pdf["name"], pdf["before"], strict=True):
                file, step = TokenFile(f"{folder}/{name}"), 1000
                for k in range(0, file.n_docs, step):
                    out = []
                    bounds = file.offsets[k : min(k + step, file.n_docs) + 1]
                    ids = file.tokens(int(bounds[0]), int(bounds[-1])).astype("<u4")
                    for key, a, b in zip(file.doc_ids[k : k + step].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        own = ids[a - bounds[0] : b - bounds[0]]
                        out.append((None if key == _NULL_ID else key, before + a, b - a, zlib.crc32(own.tobytes())))
                    yield pd.DataFrame({c: pd.array([r[i] for r in out], dtype="Int64") for i, c in enumerate(("doc_id", "start", "n_tokens", "ids_crc32"))})

    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    listed = spark.createDataFrame(files, "name string, before long").repartition(len(files))
    return listed.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the files, read them back, one row per document."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    files = write_token_files(docs, tokenizer_path, folder, end_id, id_col, text_col)
    return read_token_files(docs.sparkSession, folder, files)
