"""From hits to names: roll-up, merging of inverted names, possible duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomina import vocab
from nomina.functions import text as T
from nomina.functions.similarity import alike, token_sort_ratio
from nomina.operators.minors import BINDINGS
from nomina.sources.tables import stored

#: Forms that are compared with as many others at once.
BLOCK = 2048
_TIERS = ["", "low", "medium", "high"]


def _rank(x: Column, order: list[str]) -> Column:
    return F.coalesce(F.array_position(T.words(order), x), F.lit(1)).cast("int")


def roll_up(hits: DataFrame, key: Column | None = None, folded: Column | None = None) -> DataFrame:
    """One row a name of hits (seq, file, page_num, raw_name, boosted, minor_ctx, minor_tier, minor_reason, recognizer,
    minor_binding, suppressed, suppress_reason, raw_surface). The longest raw_name is displayed, the earliest of equal ones.

    folded is null for a name's own hits, else the form of another key that is folded into it: such a form is one of the
    name's surfaces and never displayed."""
    folded = F.lit(None).cast("string") if folded is None else folded
    h = hits.withColumn("name_key", T.dedup_key(F.col("raw_name")) if key is None else key).filter("name_key != ''")
    surface = F.when((F.coalesce("raw_surface", F.lit("")) != "") & (T.normalize_name(F.col("raw_surface")) != F.col("raw_name")), F.col("raw_surface"))
    reasons = F.filter(F.split(F.coalesce("minor_reason", F.lit("")), "; "), lambda r: r != "")
    return h.groupBy("name_key").agg(
        F.max_by("raw_name", F.struct(folded.isNull(), F.length("raw_name"), -F.col("seq"))).alias("display"),
        F.max("boosted").alias("confidence"),
        F.max(F.col("minor_ctx").cast("int")).alias("possible_minor"),
        F.element_at(T.words(BINDINGS), F.max(_rank(F.col("minor_binding"), BINDINGS))).alias("minor_binding"),
        F.element_at(T.words(_TIERS), F.max(_rank(F.col("minor_tier"), _TIERS))).alias("minor_tier"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(reasons)))).alias("minor_reasons"),
        F.array_sort(F.collect_set("recognizer")).alias("recognizers"),
        F.array_sort(F.collect_set(F.struct("file", "page_num"))).alias("locations"),
        F.count(F.lit(1)).alias("occurrence_count"),
        F.sum(F.col("suppressed").cast("int")).alias("suppressed_count"),
        F.array_sort(F.collect_set(F.when((F.col("suppressed").cast("int") > 0) & (F.col("suppress_reason") != ""), F.col("suppress_reason")))).alias("suppress_reasons"),
        F.array_sort(F.array_union(F.collect_set(surface), F.collect_set(folded))).alias("surfaces"),
    )


def merge_inverted(hits: DataFrame) -> DataFrame:
    """(name_key, target, display): each key, and where `Surname, Given` is displayed and the flipped key exists, that key."""
    keyed = hits.withColumn("name_key", T.dedup_key(F.col("raw_name"))).filter("name_key != ''")
    shown = keyed.groupBy("name_key").agg(F.max_by("raw_name", F.struct(F.length("raw_name"), -F.col("seq"))).alias("display"))
    flips = shown.withColumn("flip", T.dedup_key(F.coalesce(T.flipped_name(F.col("display")), F.lit(""))))
    have = shown.select(F.col("name_key").alias("flip"), F.lit(True).alias("there"))
    out = flips.join(have.hint("merge"), "flip", "left")
    return out.select("name_key", F.when(F.col("there") & (F.col("flip") != F.col("name_key")), F.col("flip")).otherwise(F.col("name_key")).alias("target"), "display")


def duplicate_pairs(names: DataFrame, threshold: float = vocab.FUZZY) -> DataFrame:
    """(a, b, ratio), a < b: keys whose token-sorted forms have an indel likeness of threshold or more.

    Strings of lengths m and n at a likeness of t have at most (1 - t) (m + n) characters inserted or deleted. One deleted
    costs a string two of its bigrams at most, one inserted one; so they share (1.5 t - 1) (m + n) - 1 bigrams at least,
    repeated ones counted by occurrence. With all bigrams in one order, the rarest first, two strings that share k of
    them share one among the first (bigrams - k + 1) of each: only those are joined, so common bigrams are mostly left out.
    Where the bound is not positive the strings are short, and their characters are joined too.

    Bigrams go with a number for their name. No side is broadcast: names of repeated words take a hundredth of their size in
    a file, and it is the file by which Spark takes a table as small enough for the driver."""
    t = threshold / 100.0
    share = 1.5 * t - 1
    if share <= 0:
        raise ValueError("the bigram bound needs a threshold over 66.7")
    rows = names.select("name_key").distinct().select("name_key", F.array_join(F.array_sort(T.tokens(F.col("name_key"))), " ").alias("s"))
    rows = stored(rows.filter("s != ''").select(F.monotonically_increasing_id().alias("id"), "name_key", "s", F.length("s").alias("n")))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), lambda i: F.substring(F.col("s"), i, F.lit(2)))
    each = rows.select("id", "n", F.explode(pieces).alias("g")).groupBy("id", "n", "g").agg(F.count(F.lit(1)).alias("m"))
    each = each.select("id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("m").cast("int")), lambda i: F.concat_ws("\x00", "g", i))).alias("g"))
    each = each.join(each.groupBy("g").agg(F.count(F.lit(1)).alias("f")).hint("merge"), "g")
    least = F.greatest(F.lit(1.0), F.ceil(share * F.col("n") * (2 / (2 - t)) - 1 - 1e-9)).cast("int")  # with the shortest partner
    grams = F.transform(F.array_sort(F.collect_list(F.struct("f", "g"))), lambda x: x["g"])
    first = each.groupBy("id", "n").agg(grams.alias("g")).withColumn("g", F.slice("g", 1, F.greatest(F.size("g") - least + 1, F.lit(1))))
    short = rows.filter(F.col("n") <= 1 / share).select("id", "n", F.explode(F.transform(F.array_distinct(F.split("s", "")), lambda x: F.concat(F.lit("\x01"), x))).alias("g"))
    first = stored(first.select("id", "n", F.explode("g").alias("g")).unionByName(short))
    a, b = (first.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), "g") for x in "ab")
    fit = (F.col("a") < F.col("b")) & (F.least("na", "nb") * (2 - t) >= F.greatest("na", "nb") * t - 1e-9)
    pairs = a.join(b.hint("merge"), "g").filter(fit).select("a", "b").distinct()
    one, two = (rows.select(F.col("id").alias(x), F.col("name_key").alias(f"k{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    pairs = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").withColumn("ratio", token_sort_ratio("sa", "sb")).filter(F.col("ratio") >= threshold)
    return pairs.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "ratio")


def duplicate_flags(names: DataFrame, threshold: float = vocab.FUZZY) -> DataFrame:
    """(name_key, possible_duplicates): the displays of the other names of a pair, in both directions, sorted."""
    pairs = duplicate_pairs(names, threshold)
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    shown = names.select(F.col("name_key").alias("b"), "display")
    return both.join(shown.hint("merge"), "b").groupBy(F.col("a").alias("name_key")).agg(F.array_sort(F.collect_set("display")).alias("possible_duplicates"))


def _links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, block, id, s, names), those of a pair of blocks together, to (id, links, least): how many names of the other
    block (of one block: of other forms) each form is alike, and the least id that it reaches by links between the two."""

    def found(t: pa.Table) -> pa.RecordBatch:
        i, j, block, names = (t.column(c).to_numpy() for c in ("i", "j", "block", "names"))
        ids, forms = t.column("id").to_pylist(), t.column("s").to_pylist()
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = np.zeros(len(t), np.int64)
        label = np.argsort(np.argsort(np.array(ids, object)))  # the order of ids; each is there once
        of = np.argsort(label)
        for x, ys in alike([forms[k] for k in one], [forms[k] for k in two], threshold):
            x, ys = one[x], two[ys]
            ys = ys[ys != x]
            if len(ys):
                links[x] += names[ys].sum()
                if i[0] != j[0]:
                    links[ys] += names[x]
                met = np.unique(np.append(label[ys], label[x]))
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(links), pa.array([ids[k] for k in of[label]], pa.string())], names=["id", "links", "least"])

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not len(held):
            continue
        i, j = held.column("i").to_numpy(), held.column("j").to_numpy()
        at = 0
        for to in (np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist():
            yield found(held.slice(at, to - at))
            at = to
        held = held.slice(at)
    if held is not None and len(held):
        yield found(held)


def _reached(edges: DataFrame) -> DataFrame:
    """(a, b): the least id b that each id a reaches over edges (a, b); ids without an edge are left out. Large and small
    stars by turns until nothing changes."""
    edges, last = stored(edges.filter("a != b").distinct()), None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).filter("a != b").distinct()
        edges = stored(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == last:
            return edges
        last = now


def duplicate_classes(names: DataFrame, threshold: float = vocab.FUZZY, block: int = BLOCK) -> DataFrame:
    """(name_key, class_id, n_links) of each distinct key with a token: how many other keys' token-sorted forms have an indel
    likeness of threshold or more, and the least key that it reaches by such links, itself included.

    Keys of one sorted form are compared once. Every two forms of fitting lengths are, in pairs of blocks, and no pair is
    written: where nearly all names are alike, as numbered ones are, the pairs outgrow any output."""
    rows = names.select("name_key").distinct().select("name_key", F.array_join(F.array_sort(T.tokens(F.col("name_key"))), " ").alias("s"))
    rows = stored(rows.filter("s != ''"))
    forms = stored(rows.groupBy("s").agg(F.min("name_key").alias("id"), F.count(F.lit(1)).alias("names")))
    blocks = max(1, -(-forms.count() // block))
    dealt = forms.withColumn("block", F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "s", "names")
    tasks = max(1, blocks * (blocks + 1) // 2)
    dealt = dealt.repartition(min(tasks, 2000), "i", "j").sortWithinPartitions("i", "j")
    met = stored(dealt.mapInArrow(lambda batches: _links(batches, threshold), "id string, links long, least string"))
    reached = _reached(met.select(F.col("id").alias("a"), F.col("least").alias("b"))).select(F.col("a").alias("id"), F.col("b").alias("class_id"))
    per = forms.join(met.groupBy("id").agg(F.sum("links").alias("links")), "id").join(reached, "id", "left")
    per = per.select("s", F.coalesce("class_id", "id").alias("class_id"), (F.col("links") + F.col("names") - 1).alias("n_links"))
    return rows.join(per, "s").select("name_key", "class_id", "n_links")
