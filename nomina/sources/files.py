"""Pages, dictionaries and what a scan found, in files; every reader is Spark's.

A scan's table is a folder of runs: `hits` and, written after them, `pages`, a row for each page that was scanned. Of a
chunk of pages the last finished run counts: what an interrupted run left behind is never read, and a rerun without hits
clears those before it."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nomina.functions.similarity import gazetteer_token

#: Version of what a scan finds; hits of another version aren't mixed in.
SCAN_VERSION = 2
#: Pages of a file that are scanned, or skipped as done, together.
CHUNK_SIZE = 100
#: Columns of hits with what stands for one that a table lacks.
HIT_DEFAULTS = {
    "minor_ctx": 0, "minor_tier": "", "minor_reason": "", "recognizer": "spacy", "minor_binding": "",
    "suppressed": 0, "suppress_reason": "", "raw_surface": "",
}
#: Words of header lines that dictionaries leave out.
HEADER_TOKENS = ["name", "surname", "rank", "count"]


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page_num, text) of text files, pages cut at form feeds. PDF needs a parser that isn't here: any reader that
    yields these columns takes its place."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\f")).alias("p", "text"))
    return files.select("file", (F.col("p") + 1).alias("page_num"), "text")


def document_pages(docs: DataFrame) -> DataFrame:
    """documents as pages: the source is the file, doc_id the page."""
    return docs.select(F.coalesce("source", F.lit("")).alias("file"), F.col("doc_id").cast("int").alias("page_num"), F.coalesce("text", F.lit("")).alias("text"))


def has_text(pages: DataFrame) -> DataFrame:
    """Files any page of which has text."""
    return pages.groupBy("file").agg(F.bool_or(F.trim("text") != "").alias("has_text"))


def dictionary(lines: DataFrame) -> DataFrame:
    """(token): distinct folded tokens of lines (value): before the first comma, two characters or more, only letters,
    hyphens and apostrophes, no header words."""
    t = gazetteer_token(F.substring_index("value", ",", 1)).alias("token")
    return lines.select(t).filter((F.length("token") >= 2) & ~F.col("token").isin(HEADER_TOKENS) & F.col("token").rlike(r"^[\p{L}'\-]+$")).distinct()


def dictionary_files(spark: SparkSession, *paths: str) -> list[tuple[str, int, int]]:
    """(path, size, time) of the files named, and of those ending in .csv or .txt right inside the folders named."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), set()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            continue
        folder = fs.getFileStatus(p).isDirectory()
        for s in fs.listStatus(p):
            if s.isFile() and (not folder or s.getPath().getName().lower().endswith((".csv", ".txt"))):
                found.add((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def load_dictionary(spark: SparkSession, *paths: str, cache: str | None = None, label: str = "names") -> DataFrame | None:
    """The tokens of dictionary files, None where there is no file. With cache they are compiled once into that folder,
    under a name that the files' paths, sizes and times make."""
    found = dictionary_files(spark, *paths)
    if not found:
        return None
    tokens = dictionary(spark.read.text([f for f, _, _ in found]))
    if cache is None:
        return tokens
    name = hashlib.sha1("\n".join("|".join(map(str, f)) for f in found).encode()).hexdigest()[:16]
    where = f"{cache.rstrip('/')}/{label}-{name}"
    if not _exists(spark, f"{where}/_SUCCESS"):
        tokens.write.mode("overwrite").parquet(where)
    return spark.read.schema("token string").parquet(where)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_page(page: str = "page_num", size: int | None = CHUNK_SIZE):
    """First page of a page's chunk; without a size a file is one chunk."""
    return F.lit(1) if size is None else (F.floor((F.col(page) - 1) / size) * size + 1).cast("int")


def chunks(pages: DataFrame, size: int | None = CHUNK_SIZE) -> DataFrame:
    """(file, start_page, end_page): the chunks of files, the last one ending with its file's last page."""
    return pages.groupBy("file", first_page(size=size).alias("start_page")).agg(F.max("page_num").cast("int").alias("end_page"))


def write_scan(hits: DataFrame, pages: DataFrame, problems: DataFrame, path: str, size: int | None = CHUNK_SIZE) -> None:
    """Adds a run: hits of pages (file, page_num), then these pages with their problems (file, page_num, reason)."""
    where, run = f"{path.rstrip('/')}/scan_version={SCAN_VERSION}", f"run={time.time_ns()}"
    hits.write.parquet(f"{where}/hits/{run}")
    reasons = problems.groupBy("file", "page_num").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))  # of one page
    rows = pages.select("file", "page_num").distinct().join(reasons, ["file", "page_num"], "left")
    rows = rows.withColumn("start_page", first_page(size=size)).join(chunks(pages, size), ["file", "start_page"])
    rows.write.parquet(f"{where}/pages/{run}")


def read_pages(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, page_num, reasons, start_page, end_page, run) of the pages scanned, each by the last run of its chunk, and
    where runs cut chunks differently, of the page; None where none was."""
    where = f"{path.rstrip('/')}/scan_version={SCAN_VERSION}/pages"
    if not _exists(spark, where):
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(where).withColumn("run", F.col("run").cast("long"))
    last = [F.max("run").over(Window.partitionBy("file", c)) for c in ("start_page", "page_num")]
    return rows.withColumn("_last", F.least(F.col("run"), *last) == F.greatest(*last)).filter("_last").drop("_last")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits of the pages scanned, each page's by the run that read_pages names; columns that a table lacks have their
    defaults."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path.rstrip('/')}/scan_version={SCAN_VERSION}/hits").withColumn("run", F.col("run").cast("long"))
    rows = rows.join(read_pages(spark, path), ["file", "page_num", "run"], "left_semi").drop("run")
    return rows.withColumns({c: F.lit(v) for c, v in HIT_DEFAULTS.items() if c not in rows.columns})


def clear(spark: SparkSession, path: str) -> bool:
    """Removes a hits table of this engine; whatever has no scan_version folders is left alone."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or not any(s.getPath().getName().startswith("scan_version=") for s in fs.listStatus(p)):
        return False
    return fs.delete(p, True)
