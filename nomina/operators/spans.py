"""Sources of person spans, their overlaps and where they stand on a page."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from nomina import vocab
from nomina.functions.similarity import fold_token

#: A capitalised token, and what a text is cut into: runs of such tokens, or stretches without one.
_CAP = r"\p{Lu}[\w'’.\-]*"
_TOKEN = regex.compile(_CAP)
_RUNS = regex.compile(rf"(?:(?!\p{{Lu}})(?:[^\W\d_][\w'’.\-]*|[\W\d_]+))++|({_CAP}(?:[ \t]*{_CAP})*)")
#: Names of span sources: each takes units (unit_id, text) and returns (unit_id, start, end, entity, score, recognizer).
SOURCES: dict = {}


def register(name: str, source) -> None:
    """A statistical recogniser is a source of spans too; none is built in."""
    SOURCES[name] = source


def capitalised_runs(units: DataFrame) -> DataFrame:
    """(unit_id, run, start, token, norm): tokens with offsets of the runs of two or more capitalised tokens, and folded.

    Only spaces and tabs stand within a run; a token that ends in a period with three letters or more ends its run. One
    Arrow pass over a unit's text, its tokens folded once a word."""
    key = units.schema["unit_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded: dict[str, str] = {}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for unit, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = 0
                for m in _RUNS.finditer(text or ""):
                    if m[1] is None:
                        continue
                    tokens: list[tuple[int, str]] = []
                    for t in [*_TOKEN.finditer(m[1]), None]:
                        if t is not None:
                            tokens.append((m.start() + t.start(), t[0]))
                            if not (t[0].endswith(".") and sum(c.isalpha() for c in t[0]) >= 3):
                                continue
                        n += 1
                        if len(tokens) > 1:
                            for col, v in zip(out, zip(*((unit, n, at, w) for at, w in tokens), strict=True), strict=True):
                                col.extend(v)
                        tokens = []
            for w in set(out[3]).difference(folded):
                folded[w] = fold_token(w)
            norm = [folded[w] for w in out[3]]
            if len(folded) > 200_000:
                folded.clear()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), *(pa.array(c, k) for c, k in zip((*out[1:], norm), (pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True))], names=["unit_id", "run", "start", "token", "norm"])

    rows = units.filter(F.col("text").rlike(r"\p{Lu}")).select("unit_id", "text")
    return rows.mapInArrow(run, f"unit_id {key.dataType.simpleString()}, run int, start int, token string, norm string")


def gazetteer_spans(units: DataFrame, names: DataFrame, ambiguous: DataFrame | None = None, min_matches: int = 2, score: float = vocab.DICTIONARY_SCORE) -> DataFrame:
    """PERSON spans: runs of two or more capitalised tokens with min_matches dictionary tokens, one of them unambiguous.

    A hyphenated token matches by a part. names and ambiguous have one folded token a row (token); they join by hash, so
    their size is not bounded by memory."""
    toks = capitalised_runs(units)
    forms = F.array_distinct(F.concat(F.array("norm"), F.filter(F.split("norm", "-"), lambda p: p != "")))
    each = toks.withColumn("token_form", F.explode(F.when(F.col("norm").contains("-"), forms).otherwise(F.array("norm"))))
    each = each.join(names.select(F.col("token").alias("token_form"), F.lit(1).alias("hit")).distinct(), "token_form", "left")
    if ambiguous is None:
        each = each.withColumn("common", F.lit(None).cast("int"))
    else:
        each = each.join(ambiguous.select(F.col("token").alias("token_form"), F.lit(1).alias("common")).distinct(), "token_form", "left")
    per = each.groupBy("unit_id", "run", "start", "token").agg(F.max("hit").alias("hit"), F.max("common").alias("common"))
    runs = per.groupBy("unit_id", "run").agg(
        F.min("start").cast("int").alias("start"),
        F.max(F.col("start") + F.length("token")).cast("int").alias("end"),
        F.count(F.lit(1)).alias("n"),
        F.count("hit").alias("hits"),
        F.count(F.when(F.col("hit").isNotNull() & F.col("common").isNull(), 1)).alias("clear"),
    )
    found = runs.filter((F.col("n") >= 2) & (F.col("hits") >= min_matches) & (F.col("clear") > 0))
    return found.select("unit_id", "start", "end", F.lit("PERSON").alias("entity"), F.lit(score).alias("score"), F.lit("gazetteer").alias("recognizer"))


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """One span for each overlapping cluster of a unit and entity: by start, longer first, a span joins the first kept one
    that it overlaps, replaces it if it scores higher, and both labels make `both`. A fold over a unit's own spans."""
    fields = [F.col(c) for c in ("entity", "end", "score", "recognizer")]
    row = F.struct(F.col("start"), (F.col("start") - F.col("end")).alias("len"), *fields)
    per = spans.groupBy("unit_id").agg(F.array_sort(F.collect_list(row)).alias("a"))
    slot = "array<struct<start:int,len:int,entity:string,end:int,score:double,recognizer:string>>"

    def step(acc: Column, r: Column) -> Column:
        over = F.transform(acc, lambda k: (k["entity"] == r["entity"]) & (r["start"] < k["end"]) & (k["start"] < r["end"]))
        at = F.array_position(over, F.lit(True))

        def new(k: Column, i: Column) -> Column:
            better = r["score"] > k["score"]
            label = F.when(r["recognizer"] != k["recognizer"], "both").otherwise(k["recognizer"])
            pick = lambda f: F.when(better, r[f]).otherwise(k[f]).alias(f)
            return F.when(i + 1 == at, F.struct(pick("start"), pick("len"), pick("entity"), pick("end"), pick("score"), label.alias("recognizer"))).otherwise(k)

        return F.when(at > 0, F.transform(acc, new)).otherwise(F.concat(acc, F.array(r)))

    kept = F.aggregate("a", F.expr(f"cast(array() as {slot})"), step)
    return per.select("unit_id", F.explode(kept).alias("k")).select("unit_id", "k.start", "k.end", "k.entity", "k.score", "k.recognizer")


def overlapping_entities(persons: DataFrame, others: DataFrame) -> DataFrame:
    """persons with overlaps: the sorted distinct entities of others that overlap each in its unit."""
    per = others.groupBy("unit_id").agg(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e"), "entity")).alias("_o"))
    hit = F.filter("_o", lambda o: (o["s"] < F.col("end")) & (F.col("start") < o["e"]))
    out = persons.join(per, "unit_id", "left")
    return out.withColumn("overlaps", F.coalesce(F.array_sort(F.array_distinct(F.transform(hit, lambda o: o["entity"]))), F.expr("cast(array() as array<string>)"))).drop("_o")


_PLACES = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


@F.pandas_udf(_PLACES)
def locate_all(haystack: pd.Series, needle: pd.Series) -> pd.Series:
    """All places of a surface in a text, any white space between its words; no word boundary is asked for."""

    def places(h: str, n: str) -> list:
        parts = (n or "").split()
        if not parts or not h:
            return []
        return [{"start": m.start(), "end": m.end()} for m in re.finditer(r"\s+".join(map(re.escape, parts)), h)]

    return pd.Series([places(h, n) for h, n in zip(haystack, needle, strict=True)])
