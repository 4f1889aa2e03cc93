"""Versioned stores of tables.

A version's data lie in folders that no other version changes; a numbered manifest names them and is moved into place last, so that
a reader always finds a whole version and a writer that stops leaves the former one. Nothing is deleted before its successor is
readable; `vacuum` removes what no kept manifest names.

A keyed table is cut into hash buckets of one column. An upsert or a deletion reads and rewrites the buckets of its rows only; the
new manifest names the new folders of these and the old folders of all others. Two writers at once: the second to finish fails, as
its manifest's number is taken.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a keyed table; its manifest lists so many folders at most.
BUCKETS = 64
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset, a local one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quillstone-store-"))
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/stores/{name}-{uuid.uuid4().hex[:12]}"


def spill(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, is counted and reused without work, and is safe from lost executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    p = jvm.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """A small file, written beside its place and moved: readers see the old one or the new one. Without replace an existing one is an error."""
    temp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    jvm, src, fs = _hadoop(spark, temp)
    fs.mkdirs(src.getParent())
    out = fs.create(src, False)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(jvm, "Options$Rename")
    option = spark.sparkContext._gateway.new_array(kind, 1)
    option[0] = kind.OVERWRITE if replace else kind.NONE
    jvm.FileContext.getFileContext(src.toUri(), spark._jsc.hadoopConfiguration()).rename(src, jvm.Path(path), option)


def get_text(spark: SparkSession, path: str) -> str:
    _, p, fs = _hadoop(spark, path)
    source = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of the files under a path: names, sizes and times of change. Another content is another fingerprint."""
    _, p, fs = _hadoop(spark, path)
    root, found, files = str(fs.makeQualified(p)), [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        found.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps([root, sorted(found)]).encode()).hexdigest()


def _numbers(spark: SparkSession, path: str) -> list[int]:
    _, p, fs = _hadoop(spark, f"{path}/manifests")
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """The newest manifest or that of a number; None where there is none."""
    path = path.rstrip("/")
    known = _numbers(spark, path)
    if not known or (number is not None and number not in known):
        return None
    return json.loads(get_text(spark, f"{path}/manifests/{number or known[-1]:08d}.json"))


def commit(spark: SparkSession, path: str, number: int, identity: dict, tables: dict) -> None:
    """The last step of every change."""
    said = {"number": number, "identity": identity, "tables": tables}
    put_text(spark, f"{path.rstrip('/')}/manifests/{number:08d}.json", json.dumps(said, ensure_ascii=False, sort_keys=True))


def bucket_of(by: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(by).cast("string")), F.lit(n)).cast("int")


def _write_buckets(rows: DataFrame, folder: str, by: str, n: int, order: list[str] = ()) -> list[int]:
    """Rows as a folder for each bucket; returns the buckets that have rows. Spark evens out large and small buckets over its tasks."""
    spark = rows.sparkSession
    dealt = rows.withColumn("bucket", bucket_of(by, n)).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(folder)
    _, p, fs = _hadoop(spark, folder)
    return sorted(int(f.getPath().getName()[7:]) for f in fs.listStatus(p) if f.getPath().getName().startswith("bucket="))


def write_table(rows: DataFrame, path: str, name: str, key: str | None = None, by: str | None = None, order: tuple = (), buckets: int = BUCKETS) -> dict:
    """A table's data in a folder of their own, which no manifest names yet; returns what `save` takes."""
    path, data = path.rstrip("/"), uuid.uuid4().hex[:12]
    folder, held = f"{path}/data/{data}/{name}", {"schema": rows.schema.json(), "key": key}
    if not key:
        rows.write.parquet(folder)
        return held | {"folder": data}
    written = _write_buckets(rows, folder, by or key, buckets, list(order))
    return held | {"by": by or key, "n": buckets, "buckets": {str(b): data for b in written}}


def save(tables: dict[str, DataFrame | tuple | dict], path: str, identity: dict | None = None, buckets: int = BUCKETS) -> int:
    """A new version that holds these tables whole; returns its number.

    A table is rows, (rows, key, bucket column or None, columns to sort by), or what `write_table` has written.
    """
    path, found = path.rstrip("/"), {}
    for name, given in tables.items():
        if isinstance(given, DataFrame):
            given = write_table(given, path, name)
        elif isinstance(given, tuple):
            given = write_table(given[0], path, name, *given[1:], buckets=buckets)
        found[name] = given
    spark = SparkSession.getActiveSession()
    number = max(_numbers(spark, path), default=0) + 1
    commit(spark, path, number, identity or {}, found)
    return number


def read_table(spark: SparkSession, path: str, name: str, t: dict, only: list[int] | None = None) -> DataFrame:
    """A table by its entry in a manifest; of a keyed one, only some buckets where they are given."""
    path, schema = path.rstrip("/"), StructType.fromJson(json.loads(t["schema"]))
    if t["key"] is None:
        return spark.read.schema(schema).parquet(f"{path}/data/{t['folder']}/{name}")
    folders = [f"{path}/data/{v}/{name}/bucket={b}" for b, v in sorted(t["buckets"].items()) if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def load(spark: SparkSession, path: str, name: str, number: int | None = None, only: list[int] | None = None) -> DataFrame:
    """A table of the newest version or that of a number."""
    held = manifest(spark, path, number)
    if held is None:
        raise FileNotFoundError(f"no store at {path}")
    return read_table(spark, path, name, held["tables"][name], only)


def state(spark: SparkSession, path: str, identity: dict) -> str:
    """ready, stale (built from other inputs or settings) or missing."""
    found = manifest(spark, path)
    return "missing" if found is None else "ready" if {k: found["identity"].get(k) for k in identity} == identity else "stale"


def touched(spark: SparkSession, path: str, name: str, values: DataFrame, column: str) -> list[int]:
    """The buckets of the values, at most as many as the table has."""
    n = manifest(spark, path)["tables"][name]["n"]
    return sorted(r[0] for r in values.select(bucket_of(column, n).alias("b")).distinct().collect())


def _rewritten(path: str, name: str, rows: DataFrame, only: list[int], held: dict, schema: StructType) -> dict:
    """Rows as the new content of some buckets; returns the table's new entry, which no manifest names yet."""
    data, t = uuid.uuid4().hex[:12], dict(held)
    written = _write_buckets(rows, f"{path.rstrip('/')}/data/{data}/{name}", t["by"], t["n"])
    t["buckets"] = {b: v for b, v in t["buckets"].items() if int(b) not in only} | {str(b): data for b in written}
    t["schema"] = schema.json()
    return t


def _replace(spark: SparkSession, path: str, name: str, rows: DataFrame, only: list[int], found: dict, schema: StructType) -> int:
    t = _rewritten(path, name, rows, only, found["tables"][name], schema)
    commit(spark, path, found["number"] + 1, found["identity"], found["tables"] | {name: t})
    return len(only)


def replace_buckets(spark: SparkSession, path: str, found: dict, tables: dict[str, tuple[DataFrame, list[int]]]) -> None:
    """In one version that follows the manifest `found`, new contents of some buckets of several tables."""
    new = dict(found["tables"])
    for name, (rows, only) in tables.items():
        schema = StructType.fromJson(json.loads(new[name]["schema"]))
        new[name] = _rewritten(path, name, rows.select(*schema.names), only, new[name], schema)
    commit(spark, path, found["number"] + 1, found["identity"], new)


def replace_groups(spark: SparkSession, path: str, values: DataFrame, tables: dict[str, DataFrame]) -> int:
    """In one version, the rows of whole groups in several tables: those of the values go, the given ones come. Returns the buckets rewritten.

    values: one column, the bucket column of all the tables.
    """
    found, column, n = manifest(spark, path), values.columns[0], 0
    new = dict(found["tables"])
    for name, rows in tables.items():
        buckets = touched(spark, path, name, values, column)
        if buckets:
            known = load(spark, path, name, found["number"], buckets)
            gone = values.select(F.col(column).alias("__gone")).distinct()
            kept = known.join(gone, F.col(column).eqNullSafe(F.col("__gone")), "left_anti")
            new[name] = _rewritten(path, name, kept.unionByName(rows.select(*known.columns)), buckets, new[name], known.schema)
            n += len(buckets)
    if n:
        commit(spark, path, found["number"] + 1, found["identity"], new)
    return n


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the last row."""
    w = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def upsert_rows(known: DataFrame, new: DataFrame, key: str, only: list[str] | None = None) -> DataFrame:
    """Rows by key: new ones replace known ones, or only set some columns of them; unknown keys are added."""
    once = last_wins(new, [key], [F.xxhash64(*new.columns)])
    if not only:
        return known.join(once.select(key), key, "left_anti").unionByName(once, allowMissingColumns=True)
    given = once.select(key, *(F.col(c).alias(f"__{c}") for c in only), F.lit(True).alias("__given"))
    set_rows = known.join(given, key, "left").select(*(F.when(F.col("__given"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in only else F.col(c) for c in known.columns))
    return set_rows.unionByName(once.join(known.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(spark: SparkSession, path: str, name: str, new: DataFrame, only: list[str] | None = None) -> int:
    """Rows by key into a keyed table: replaced, or with `only` some columns set; unknown keys are added. Returns the buckets rewritten.

    The bucket column must not change with a key: rows of a known key lie in the bucket of its value in that column.
    """
    found = manifest(spark, path)
    t = found["tables"][name]
    buckets = touched(spark, path, name, new, t["by"])
    if not buckets:
        return 0
    known = load(spark, path, name, found["number"], buckets)
    merged = upsert_rows(known, new, t["key"], only).select(*known.columns)
    return _replace(spark, path, name, merged, buckets, found, known.schema)


def delete(spark: SparkSession, path: str, name: str, which: Column) -> int:
    """Rows that satisfy a condition go (null: stay). Returns the buckets rewritten: those that hold such rows."""
    found = manifest(spark, path)
    t, rows = found["tables"][name], load(spark, path, name, found["number"])
    gone = F.coalesce(which, F.lit(False))
    buckets = touched(spark, path, name, rows.filter(gone), t["by"])
    if not buckets:
        return 0
    return _replace(spark, path, name, load(spark, path, name, found["number"], buckets).filter(~gone), buckets, found, rows.schema)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes manifests but the newest ones and the data folders that none of those names; returns the folders removed."""
    path, numbers = path.rstrip("/"), _numbers(spark, path.rstrip("/"))
    used, removed = set(), 0
    for number in numbers[-keep:]:
        for t in manifest(spark, path, number)["tables"].values():
            used |= set(t["buckets"].values()) if t["key"] else {t["folder"]}
    jvm, p, fs = _hadoop(spark, f"{path}/data")
    for number in numbers[:-keep]:
        fs.delete(jvm.Path(f"{path}/manifests/{number:08d}.json"), False)
    for f in fs.listStatus(p):
        if f.getPath().getName() not in used:
            removed += bool(fs.delete(f.getPath(), True))
    return removed
