"""From pages to judged hits: units, spans, surfaces, contexts, scores and verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from nomina import vocab
from nomina.functions import text as T
from nomina.operators import minors, scoring, spans, suppression, units
from nomina.sources import files
from nomina.sources.tables import stored

#: Characters to either side of a place that it is judged by; no rule but that of joined names reads more than 80.
AROUND = 400


def detect(pages: DataFrame, names: DataFrame | None, ambiguous: DataFrame | None = None, cells: DataFrame | None = None, entities: Sequence[str] = ("PERSON",), score: float = vocab.DICTIONARY_SCORE) -> DataFrame:
    """(file, page_num, seq, kind, col_role, source, raw, start, end, score, recognizer, overlaps): resolved spans of the
    entities asked for in every unit, from the dictionary, if there is one, and all registered sources; raw keeps the
    source's casing. overlaps names the other entities that cover a span."""
    u = units.page_units(pages, cells).withColumn("unit_id", F.xxhash64("file", "page_num", "kind", "seq", "analysis_text"))
    texts = u.select("unit_id", F.col("analysis_text").alias("text"))
    parts = [] if names is None else [spans.gazetteer_spans(texts, names, ambiguous, score=score)]
    parts += [source(texts) for source in spans.SOURCES.values()]
    if not parts:
        raise ValueError("no span source: a dictionary or a registered recogniser is needed")
    found = reduce(DataFrame.unionByName, parts)
    asked = F.col("entity").isin(*entities)
    persons = spans.resolve_overlaps(found.filter(asked))
    persons = spans.overlapping_entities(persons, found.filter(~asked))
    text = F.when(F.length("source_text") == F.length("analysis_text"), F.col("source_text")).otherwise(F.col("analysis_text"))
    rows = persons.join(u, "unit_id").withColumn("source", text)
    return rows.select("file", "page_num", F.struct("seq", "start").alias("seq"), "kind", "col_role", "source", F.expr("substring(source, start + 1, end - start)").alias("raw"), "start", "end", "score", "recognizer", "overlaps")


def hits(pages: DataFrame, names: DataFrame | None, as_of: int, ambiguous: DataFrame | None = None, cells: DataFrame | None = None, denylist: DataFrame | None = None, entities: Sequence[str] = ("PERSON",), score: float = vocab.DICTIONARY_SCORE) -> DataFrame:
    """(seq, file, page_num, raw_name, score, boosted, minor_ctx, minor_tier, minor_reason, recognizer, minor_binding,
    suppressed, suppress_reason, raw_surface).

    A prose surface is judged where it stands; any other wherever it stands on its page, else in its unit. The first clean
    place clears it, else the last place's verdict stands; the greatest boost and the strongest binding count. A surface
    that is debris alone keeps its form, so that it is held back with that reason."""
    rows = detect(pages, names, ambiguous, cells, entities, score).withColumn("surface", T.normalize_name(F.col("raw")))
    rows = rows.withColumn("name", T.let(T.sanitize(F.col("raw")), lambda n: F.when(n != "", n).otherwise(F.col("surface"))))
    rows = rows.withColumn("name_key", T.dedup_key(F.col("name")))
    rows = rows.filter("name_key != ''").withColumn("is_variant", F.col("kind").isin("truecase", "flipped"))
    rows = stored(units.first_variants(rows).withColumn("hit", F.xxhash64("file", "page_num", "seq", "kind", "raw")))
    own = F.array(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))
    prose = rows.filter("kind = 'prose'").withColumns({"on_page": F.lit(True), "places": own})
    other = rows.filter("kind != 'prose'").join(pages.select("file", "page_num", F.col("text").alias("page")), ["file", "page_num"])
    other = other.withColumn("places", spans.locate_all("page", "raw")).withColumn("on_page", F.size("places") > 0)
    other = other.withColumn("places", F.when(F.col("on_page"), F.col("places")).otherwise(own)).withColumn("source", F.when(F.col("on_page"), F.col("page")).otherwise(F.col("source")))
    there = prose.unionByName(other.drop("page"))
    spans_of = there.filter("on_page").select("file", "page_num", F.explode("places").alias("p"))
    spans_of = spans_of.groupBy("file", "page_num").agg(F.array_sort(F.collect_set(F.struct(F.col("p.start").alias("s"), F.col("p.end").alias("e")))).alias("page_spans"))
    # a place takes only its surroundings along: what is judged reaches no further, but for names joined to one beyond them
    low = lambda p: F.greatest(p["start"] - AROUND, F.lit(0))
    cut = lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), low(p).alias("low"), F.substring(F.col("source"), low(p) + 1, p["end"] + AROUND - low(p)).alias("ctx"))
    c = there.withColumn("places", F.transform("places", cut)).drop("source").join(spans_of, ["file", "page_num"], "left")
    c = c.select("hit", "name", "surface", "file", "page_num", "seq", "score", "recognizer", "col_role", "overlaps", "on_page", "page_spans", F.posexplode("places").alias("n", "p"))
    inside = F.filter("page_spans", lambda x: (x["s"] >= F.col("p.low")) & (x["s"] < F.col("p.end")))
    mine = F.array(F.struct(F.col("p.start").alias("s"), F.col("p.end").alias("e")))
    moved = F.transform(F.when(F.col("on_page"), inside).otherwise(mine), lambda x: F.struct((x["s"] - F.col("p.low")).alias("s"), (x["e"] - F.col("p.low")).alias("e")))
    c = c.select(*[x for x in c.columns if x not in ("on_page", "page_spans", "p")], F.col("p.ctx").alias("ctx"), (F.col("p.start") - F.col("p.low")).alias("start"), (F.col("p.end") - F.col("p.low")).alias("end"), moved.alias("spans"))
    if denylist is not None:
        denied = suppression.denylist_detail(rows.select("hit", "name"), ["hit"], "name", denylist)
        c = c.join(denied, "hit", "left")
    told = rows.select("hit", F.lit(False).alias("implausible"), F.lit(False).alias("condemned")).limit(0) if names is None else scoring.implausible_names(rows.select("hit", "name"), ["hit"], "name", names)
    c = c.join(told, "hit", "left")
    c = c.withColumns({x: F.coalesce(x, F.lit(False)) for x in ("implausible", "condemned")})
    c = suppression.verdict(c, "denylist_detail" if denylist is not None else None, F.col("implausible"), F.col("condemned"))
    at = (F.col("ctx"), F.col("start"), F.col("end"))
    c = c.withColumns({"boost": scoring.context_boost(*at), "reasons": minors.reasons(*at, as_of)})
    c = c.withColumn("binding", minors.binding(F.col("ctx"), F.col("spans"), F.col("start"), F.col("end"), F.col("reasons"), F.col("col_role"), as_of))
    kinds = F.array(*[F.lit(b) for b in minors.BINDINGS])
    judged = F.when(F.col("suppress_reason") != "", F.left(F.concat_ws("|", "suppress_reason", "suppress_detail"), F.lit(200))).otherwise("")
    per = c.withColumn("judged", judged).groupBy("hit", "name", "surface", "file", "page_num", "seq", "score", "recognizer").agg(
        F.max("boost").alias("boost"),
        F.element_at(kinds, F.max(F.array_position(kinds, F.col("binding"))).cast("int")).alias("minor_binding"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"),
        F.bool_and(F.col("judged") != "").alias("suppressed"),
        F.max_by("judged", "n").alias("judged"),
        F.bool_or("implausible").alias("implausible"),
    )
    boosted = scoring.composite(F.col("score"), F.col("boost"), scoring.shape_adjustment(F.col("name"), F.col("implausible")))
    bound = F.col("minor_binding") != ""
    return per.select(
        F.xxhash64("file", "page_num", "seq").alias("seq"),
        "file",
        "page_num",
        F.col("name").alias("raw_name"),
        "score",
        boosted.alias("boosted"),
        bound.cast("int").alias("minor_ctx"),
        minors.tier(F.col("minor_binding")).alias("minor_tier"),
        F.when(bound, F.left(F.array_join("reasons", "; "), F.lit(500))).otherwise("").alias("minor_reason"),
        "recognizer",
        "minor_binding",
        F.col("suppressed").cast("int").alias("suppressed"),
        F.when(F.col("suppressed"), F.col("judged")).otherwise("").alias("suppress_reason"),
        F.left("surface", F.lit(200)).alias("raw_surface"),
    )


def scan(pages: DataFrame, names: DataFrame | None, as_of: int, path: str, cells: DataFrame | None = None, size: int | None = files.CHUNK_SIZE, force: bool = False, **settings) -> dict:
    """Scans what the table at path lacks and adds it there: chunks of `size` pages of a file that a run before finished
    are left out (with force the table is removed first). Returns the counters of the run: hits and suppressed."""
    spark = pages.sparkSession
    if force:
        files.clear(spark, path)
    done = files.read_pages(spark, path)
    if done is not None:
        left = stored(units.pending_chunks(files.chunks(pages, size), done.select("file", "start_page", "end_page").distinct()))
        keep = lambda df: df.join(left.select("file", "start_page"), [df["file"] == left["file"], files.first_page(size=size) == left["start_page"]], "left_semi")
        pages, cells = keep(pages), None if cells is None else keep(cells)
    seen = Observation()
    found = hits(pages, names, as_of, cells=cells, **settings).observe(seen, F.count(F.lit(1)).alias("hits"), F.coalesce(F.sum("suppressed"), F.lit(0)).alias("suppressed"))
    files.write_scan(found, pages, units.page_problems(pages, cells), path, size)
    return seen.get
