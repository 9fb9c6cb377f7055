"""What the operators of this subpackage share: reading, durable intermediate tables, small expressions."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java and RE2 pattern of a word: code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Java pattern of what separates words.
GAP = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is set, one in the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return where or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/nomina-checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage is cut and outlives lost executors.

    The table is removed when the driver ends, or by release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nomina-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def release(docs: DataFrame) -> None:
    """Removes the tables that stored() wrote so far, and lets Spark remove shuffles that nothing refers to any more; for
    use between jobs, when their results are written. Does nothing if docs reads such a table."""
    if any("/nomina-" in f for f in docs.inputFiles()):
        return
    _sweep()
    unreferenced(docs)


def unreferenced(docs: DataFrame) -> None:
    """Lets Spark remove the shuffles that nothing refers to any more: those of tables that stored() has written."""
    docs.sparkSession.sparkContext._jvm.System.gc()


def _sweep() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            return


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts (strings are literals, null reads as empty)."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat(*cols)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def unit_hash_sql(*parts: str) -> str:
    """The DuckDB form of unit_hash; each part is an SQL expression."""
    text = " || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"(CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def sampled(rows: DataFrame, limit: int, size: int, among: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, text, label) of the `limit` ids (`among` these, else the rows' own) with the smallest hash, with that
    as _h, as long as the texts before one come to fewer than `size` characters: what reaches the driver is bounded in
    both. Of rows with one id the one with the least label and text counts.

    The hash first thins the ids to about twice the limit, so that what tasks send on is bounded too."""
    ids = (rows if among is None else among).select("doc_id").distinct().withColumn("_h", F.xxhash64("doc_id"))
    n = ids.count()
    if n > 4 * limit:
        ids = ids.filter(F.col("_h") < int(2**64 * (2 * limit / n)) - 2**63)
    ids = ids.orderBy("_h", "doc_id").limit(limit)
    found = rows.select("doc_id", "text", "label").join(F.broadcast(ids), "doc_id")  # `limit` ids
    found = found.groupBy("_h", "doc_id").agg(F.min(F.struct("label", "text")).alias("x")).select("_h", "doc_id", "x.label", "x.text")
    order = Window.orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # over `limit` rows
    return found.withColumn("_n", F.coalesce(F.sum(F.length("text").cast("long")).over(order), F.lit(0))).filter(F.col("_n") < size).drop("_n")


def octets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string column's bytes, its n+1 offsets into them and which rows are null (those have no bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    nulls = np.asarray(column.is_null())
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw[:0], offs - offs[0], nulls


def texts(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8 bytes; null is empty."""
    return column.fill_null("").cast(pa.large_binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 over uint64."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words (bytes), remembered up to a bound of distinct words."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        self.of, self.seen, self.limit = xxhash.xxh3_64_intdigest, {}, limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.limit:
            seen.clear()
        new = set(words).difference(seen)
        for w in new:
            seen[w] = self.of(w)
        return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes; of the whole sequence where it is shorter; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < width:
        h = np.full(1, n, np.uint64)
        for w in words:
            h = mix64(h * np.uint64(0x100000001B3) ^ w)
        return h
    h = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        h = (h ^ words[i : n - width + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return mix64(h)
