"""Mixing sources to target weights by Pareto order sampling (operator 2), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomina.llm.common import WORD, stored, unit_hash, unit_hash_sql

#: Weights that the sources take in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: No source's target and no document's words exceed so many times their size.
CAP = 3
SEED = "mix:"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, n_docs, target): all sizes shared by weight, stopped at cap times a source's size.

    Sharing the excess again until none is above is the water level L with sum(min(cap * size, L * weight)) = total:
    in the order of cap * size / weight the stopped sources come first. These windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    # the first source that the level doesn't stop fixes it for all that follow
    fixed = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(whole)
    per = per.withColumn("fixed", fixed.getField("level"))
    return per.select("source", "source_size", "n_docs", F.when(F.col("fixed").isNull(), F.col("most")).otherwise(F.least("most", F.col("fixed") * F.col("weight"))).alias("target"))


def _rank() -> Column:
    """Pareto order: equal odds by the random number, then by id and size."""
    return F.struct("odds", "u", "doc_id", "size")


def _units(sizes: DataFrame) -> DataFrame:
    """(s, sn, doc_id, size, u, words): rows of sizes alike in source, id and size as one, words that of all of them."""
    keys = (F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("sn"), "doc_id", "size", "u")
    return sizes.groupBy(*keys).agg((F.count(F.lit(1)) * F.col("size")).alias("words"))


def inclusion(units: DataFrame, per: DataFrame) -> DataFrame:
    """per (with s, sn, rest) and num, den: a document's chance of one more copy is min(1, size * num / den).

    The chances are proportional to the size and stop at certainty: with the largest documents certain, those of the others
    bring in as many words as are still missing. The windows run over the distinct sizes of a source."""
    square = F.col("size").cast("decimal(19,0)") * F.col("words").cast("decimal(19,0)")
    sizes = units.filter("size > 0").groupBy("s", "sn", "size").agg(F.sum("words").alias("words"), F.sum(square).alias("squares"))
    sizes = sizes.join(per.select("s", "sn", "rest"), ["s", "sn"])
    order = Window.partitionBy("s", "sn").orderBy(F.col("size").desc())
    num = F.col("rest") - F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    den = F.sum("squares").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    sizes = sizes.withColumns({"num": num, "den": den}).filter(F.col("size") * F.col("num") <= F.col("den"))
    found = sizes.groupBy("s", "sn").agg(F.max_by(F.struct("num", "den"), "size").alias("f"))
    return per.join(found, ["s", "sn"], "left").select(*per.columns, "f.num", "f.den")


def odds() -> Column:
    """Random odds over inclusion odds; 0 for the certain, infinite for those without a chance."""
    chance = F.least(F.lit(1.0), F.col("size") * F.col("num") / F.col("den"))
    rank = lambda p: F.when(p >= 1, 0.0).when(p > 0, F.col("u") / (1 - F.col("u")) * ((1 - p) / p)).otherwise(float("inf"))
    return F.coalesce(F.get(F.transform(F.array(chance), rank), 0), F.lit(float("inf")))


def cuts(units: DataFrame, per: DataFrame) -> DataFrame:
    """Per source (source, source_size, target, whole, num, den): whole copies that all its documents give; `stop`, the first
    in Pareto order that has no place for one more; `last`, which of those from there on comes nearest to what is missing.

    The order is cut into about sqrt(documents) stretches; only the stretch in which the words reach the target is
    ordered row by row, so that no task holds a whole source."""
    per = per.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    per = per.withColumn("whole", F.floor("share")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    per = per.withColumns({"s": F.coalesce("source", F.lit("")), "sn": F.col("source").isNull()})
    per = stored(inclusion(units, per).drop("share"))
    parts = F.ceil(F.sqrt("n_docs"))
    small = per.select("s", "sn", "rest", "num", "den", parts.alias("parts"))
    rows = units.join(small, ["s", "sn"]).withColumn("odds", odds())
    at = F.when(F.col("odds") == float("inf"), 1.0).otherwise(F.col("odds") / (1 + F.col("odds")))
    rows = rows.withColumn("part", F.floor(at * F.col("parts")))
    sums = rows.groupBy("s", "sn", "part").agg(F.sum("words").alias("sum"), F.first("rest").alias("rest"))
    order = Window.partitionBy("s", "sn").orderBy("part")
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = sums.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest"))).select("s", "sn", "part", "before")
    order = Window.partitionBy("s", "sn").orderBy("odds", "u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.join(at, ["s", "sn", "part"]).withColumn("reach", F.col("before") + F.sum("words").over(order))
    fits = F.col("reach") <= F.col("rest")
    stop = near.groupBy("s", "sn").agg(F.min(F.when(~fits, _rank())).alias("stop"), (F.first("rest") - F.coalesce(F.max(F.when(fits, F.col("reach"))), F.first("before"))).alias("gap"))
    stop = stored(stop)
    off = F.abs(F.col("words") - F.col("gap"))
    behind = rows.join(stop, ["s", "sn"]).filter((_rank() >= F.col("stop")) & (F.col("words") > 0) & (off < F.col("gap")))
    last = behind.groupBy("s", "sn").agg(F.min_by(_rank(), F.struct(off, _rank())).alias("last"))
    return per.drop("n_docs", "rest").join(stop.drop("gap"), ["s", "sn"], "left").join(last, ["s", "sn"], "left").drop("s", "sn")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, copies and taken = size * copies, columns of these names replaced.

    Each source gives floor(target / size) whole copies of every document. One more goes to a Pareto sample of its documents
    with chances proportional to size, where certain ones come first: of fixed size, that is as many words as are missing.
    The sample ends with the first document that is too long for them; the one of the others that comes nearest to what
    is then missing is added, if any comes nearer. A null text has size 0, a null source is a source of its own,
    a null id hashes as the empty string. Rows alike in id, source and size fall on the same side. No rows: no rows."""
    rows = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("u", unit_hash(seed, F.col("doc_id")))
    sizes = stored(rows.select("doc_id", "source", "size", "u"))
    per = stored(targets(sizes, weights, cap))
    cut = stored(cuts(stored(_units(sizes)), per)).withColumnRenamed("source", "cut_source")
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    out = rows.drop("source_size", "target", "taken", "copies", "whole", "num", "den", "stop", "last", "cut_source", "odds")
    out = out.join(cut, F.col("source").eqNullSafe(F.col("cut_source"))).withColumn("odds", odds())
    more = (_rank() < F.col("stop")) | F.col("last").eqNullSafe(_rank())
    out = out.withColumn("copies", F.col("whole") + F.coalesce(more, F.lit(False)).cast("long"))
    return out.select(*keep, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op2_pareto_mix(spark, sf_dir) -> DataFrame:
    from nomina.llm.common import table

    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def sql(seed: str = SEED, weights: tuple = WEIGHTS, cap: int = CAP, docs: str = "documents") -> str:
    """DuckDB SQL: (doc_id, source, text, size, source_size, target, copies) of each row of docs."""
    return f"""
WITH sized AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, {unit_hash_sql(f"'{seed}'", "doc_id")} AS u FROM {docs}
), per0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), per1 AS (
  SELECT *, [{", ".join(f"{float(w)}::DOUBLE" for w in weights)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}] AS weight,
    source_size * {float(cap)}::DOUBLE AS most FROM per0
), per2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per1 WINDOW o AS (ORDER BY most / weight, source NULLS LAST)
), per3 AS (
  SELECT *, (SELECT arg_min(level, most / weight) FROM per2 WHERE level * weight <= most) AS fixed FROM per2
), per AS (
  SELECT source, source_size, CASE WHEN fixed IS NULL THEN most ELSE least(most, fixed * weight) END AS target FROM per3
), per4 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, target - whole * source_size AS rest FROM per
), units AS (
  SELECT source, doc_id, size, u, sum(size)::BIGINT AS words FROM sized GROUP BY ALL
), steps AS (
  SELECT x.source, size, rest - coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS num,
    (sum(squares) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS den
  FROM (SELECT source, size, sum(words)::HUGEINT AS words, sum(size::HUGEINT * words)::HUGEINT AS squares FROM units WHERE size > 0 GROUP BY source, size) x
    JOIN per4 p ON x.source IS NOT DISTINCT FROM p.source WINDOW o AS (PARTITION BY x.source ORDER BY size DESC)
), chances AS (
  SELECT source, arg_max(num, size) AS num, arg_max(den, size) AS den FROM steps WHERE size * num <= den GROUP BY source
), odd AS (
  SELECT x.*, p.rest, least(1.0::DOUBLE, size * c.num / c.den) AS chance,
    CASE WHEN chance >= 1 THEN 0.0::DOUBLE WHEN chance > 0 THEN u / (1 - u) * ((1 - chance) / chance) ELSE 'inf'::DOUBLE END AS odds
  FROM units x JOIN per4 p ON x.source IS NOT DISTINCT FROM p.source LEFT JOIN chances c ON x.source IS NOT DISTINCT FROM c.source
), ordered AS (
  SELECT *, sum(words) OVER o AS reach, row_number() OVER o AS place FROM odd WINDOW o AS (PARTITION BY source ORDER BY odds, u, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)
), stops AS (
  SELECT source, min(place) FILTER (reach > rest) AS stop, any_value(rest) - coalesce(max(reach) FILTER (reach <= rest), 0) AS gap FROM ordered GROUP BY source
), lasts AS (
  SELECT o.source, arg_min(place, (abs(words - gap), place)) AS last FROM ordered o JOIN stops s ON o.source IS NOT DISTINCT FROM s.source
  WHERE place >= stop AND words > 0 AND abs(words - gap) < gap GROUP BY o.source
), picked AS (
  SELECT o.source, doc_id, size FROM ordered o JOIN stops s ON o.source IS NOT DISTINCT FROM s.source LEFT JOIN lasts l ON o.source IS NOT DISTINCT FROM l.source
  WHERE place < stop OR place = last
)
SELECT d.* EXCLUDE (u), p.source_size, p.target, CAST(p.whole + CASE WHEN k.size IS NULL THEN 0 ELSE 1 END AS BIGINT) AS copies
FROM sized d JOIN per4 p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN picked k ON d.source IS NOT DISTINCT FROM k.source AND d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.size = k.size"""


SQL = f"SELECT doc_id, size, source_size, target, size * copies AS taken FROM ({sql()})"
