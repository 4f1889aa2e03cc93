"""What several operators share: the shared folder, written intermediates, files by URI, and word hashes in numpy."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: with texts of some KB each, a batch stays at a few MB.
BATCH_ROWS = 1000
#: Bytes of text that the numpy word hashing takes at a time; a longer text goes alone.
CHUNK_BYTES = 1 << 20

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset, a local one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quillstone-")
            spark.sparkContext.setCheckpointDir(_OWN[app])
        found = _OWN[app]
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/quillstone/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written"] = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove written intermediates on which nothing depends any more, and let Spark drop shuffle files that nothing refers to."""
    for df in tables:
        spark, path = df.sparkSession, df.__dict__.get("written")
        if path:
            drop_path(spark, path)
    if tables:
        gc.collect()
        spark._jvm.System.gc()  # the context cleaner acts on collected references


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path of any Hadoop file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fs_of(uri: str):
    """(pyarrow file system, path) of a URI: file, hdfs, s3 and others that Arrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def put_file(uri: str, parts) -> None:
    """Write bytes under a temporary name and move them: a repeated attempt gives the same whole file."""
    fs, path = fs_of(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(temp) as out:
        for part in parts:
            out.write(part)
    fs.move(temp, path)


def batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch in this session; Python workers look for this package where the driver has it."""
    home, known = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if home not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(x for x in (home, known.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else; null as empty."""
    return F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- words and their hashes -------------------------------------------------------------------

#: Lower-cases A-Z and turns every other ASCII character but 0-9 a-z into a space; UTF-8 bytes above 127 are word characters.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Keeps all bytes but the ASCII white space 9-13 and 32.
SPACE_TABLE = bytes(32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A prime: hashes are polynomials modulo it.
PRIME = 2**61 - 1
_P, _LOW, _29 = np.uint64(PRIME), np.uint64(2**32 - 1), np.uint64(2**29 - 1)
_U29, _U32, _U61 = np.uint64(29), np.uint64(32), np.uint64(61)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of values below it."""
    ah, al, bh, bl = a >> _U32, a & _LOW, b >> _U32, b & _LOW
    mid, low = ah * bl + al * bh, al * bl
    return _fold((ah * bh << np.uint64(3)) + (mid >> _U29) + ((mid & _29) << _U32) + (low & _P) + (low >> _U61))


class Hasher:
    """Polynomial hashes modulo a 61-bit prime of words and of runs of words.

    Two different runs of n values collide for at most n of the 2**61 multipliers, so that no fixed pair of texts is prone to.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.bytes = rng.integers(1, PRIME, 256, dtype=np.uint64)
        self.p = int(rng.integers(2**32, PRIME))
        self.inv = pow(self.p, -1, PRIME)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> None:
        while len(self.up) < n:
            step = len(self.up)
            self.up, self.down = (np.concatenate([x, times(x, np.uint64(pow(p, step, PRIME)))]) for x, p in ((self.up, self.p), (self.down, self.inv)))

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of values[start:end] for each pair, whatever its place."""
        self.powers(len(values) + 1)
        terms = times(values, self.up[: len(values)])
        high, low = (np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x)]) for x in (terms >> _U32, terms & _LOW))
        high, low = _fold(high[end] - high[start]), _fold(low[end] - low[start])
        total = _fold((high >> _U29) + ((high & _29) << _U32) + low)
        return _fold(times(total, self.down[start]) + (end - start).astype(np.uint64))

    def words(self, buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.spans(self.bytes[buffer], start, end)


def chunks(texts: list, table: bytes, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts in chunks of bounded bytes: (first text, bytes, word starts, word ends, words before each text and after the last)."""
    first, held, size = 0, [], 0

    def out():
        raw = b" ".join(held) + b" "
        low = np.frombuffer(raw.translate(table), dtype=np.uint8)
        gap = low == 32
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(low) and not gap[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(x) + 1 for x in held])
        bound = np.concatenate([[0], np.searchsorted(start, ends)])
        return first, low, start, end, bound

    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if held and size + len(raw) > most:
            yield out()
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield out()
