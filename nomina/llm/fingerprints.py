"""Document fingerprints: bottom-k sketches of shingle hashes (operator 4), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nomina.llm.common import GAP, WORD, table

#: Words in a shingle, and hashes in a sketch.
WIDTH, K = 5, 128


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The k smallest distinct hashes of a text's shingles, ascending; null reads as empty, which has none.

    A text of fewer words than a shingle has its whole word sequence as the one shingle."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")

    def of(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(width)]))
        return F.when(n >= width, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return F.element_at(F.transform(F.array(words), of), 1)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' union from their sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two sketches: the part of the union's sketch that both hold; 1 where both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(_both(a, b, k) / F.size(merge(a, b, k)).cast("double"))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has: the common ones among the union's over a's among them; 1 for an empty a.

    Null where the union's sketch holds none of a's (few shingles beside many): the two sketches then tell nothing."""
    u = merge(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(_both(a, b, k) / F.nullif(F.size(F.array_intersect(u, a)), F.lit(0)).cast("double"))


def containment_in(a: Column, text: Column, width: int = WIDTH) -> Column:
    """Part of the hashes of a sketch with any that a whole text's shingles have: exact if the sketch holds all shingles."""
    return F.size(F.array_intersect(a, sketch(text, 2**31 - 1, width))) / F.size(a).cast("double")


def _both(a: Column, b: Column, k: int) -> Column:
    """Of the union's sketch, how many are in both: common hashes no greater than its last."""
    return F.size(F.array_intersect(F.array_intersect(a, b), merge(a, b, k)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash as a part of the hash range."""
    part = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / part)


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def bounds(docs: DataFrame, parts: int) -> list:
    """Smallest doc_id of each of at most `parts` even stretches of the ids: so many numbers reach the driver, no more."""
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull())
    cut = ids.repartitionByRange(parts, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"))
    return sorted({r.low for r in cut.collect()})


def with_next(docs: DataFrame, cols: list[str]) -> DataFrame:
    """docs with next_<col>: that column of the next document by ascending doc_id (after the last: of the first).

    Null ids come first; equal ids are ordered by text. The ids are cut into even stretches, the first row of each also
    stands at the end of the stretch before it, and the window runs within a stretch: one shuffle, no task with all rows."""
    spark = docs.sparkSession
    lows = bounds(docs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = max(len(lows), 1)
    if lows:
        low = F.array(*[F.lit(x).cast("long") for x in lows])
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
        at = F.aggregate(steps, F.lit(0), lambda acc, s: F.when((acc + s <= n) & (F.element_at(low, F.least(acc + s, F.lit(n))) <= F.col("doc_id")), acc + s).otherwise(acc))
        at = F.greatest(at - 1, F.lit(0))
        head = F.col("doc_id") == F.element_at(low, at + 1)
    else:
        at, head = F.lit(0), F.lit(True)
    smallest = docs.filter(F.col("doc_id").isNull()).limit(1).count() > 0  # then a null id heads the first stretch
    if smallest:
        head = F.when(F.col("doc_id").isNull(), F.lit(True)).otherwise(head & (at > 0))
    rows = docs.withColumn("_at", F.coalesce(at, F.lit(0))).withColumn("_head", F.coalesce(head, F.lit(False)))
    where = F.when(F.col("_head"), F.array(F.struct(F.col("_at").alias("at"), F.lit(False).alias("end")), F.struct(F.pmod(F.col("_at") - 1, F.lit(n)).alias("at"), F.lit(True).alias("end")))).otherwise(
        F.array(F.struct(F.col("_at").alias("at"), F.lit(False).alias("end")))
    )
    rows = rows.withColumn("_w", F.explode(where)).withColumn("_at", F.col("_w.at")).withColumn("_end", F.col("_w.end"))
    order = Window.partitionBy("_at").orderBy("_end", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in cols})
    return rows.filter(~F.col("_end")).drop("_at", "_head", "_w", "_end")


def op4_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch of each document and of its edited text; likeness to the edited text and to the next document; how much of the
    document the edited text holds; distinct shingles of the document and, from the merged sketch, of it and the next."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("sketch", sketch(F.col("text"))), ["text", "sketch"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.coalesce(containment(F.col("sketch"), F.col("edited_sketch")), containment_in(F.col("sketch"), F.col("edited"))).alias("kept_by_edit"),
        distinct_shingles(F.col("sketch")).alias("n_distinct"),
        distinct_shingles(merge(F.col("sketch"), F.col("next_sketch"))).alias("n_distinct_with_next"),
    )
