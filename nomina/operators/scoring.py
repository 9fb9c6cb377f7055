"""Scores, tiers and the trigram model of dictionary names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomina import vocab
from nomina.functions import text as T
from nomina.functions.similarity import gazetteer_token

ALPHA = 0.01
#: Percentiles of the names' scores: below the first a token is implausible, below the second condemned. Scored names that
#: a conviction needs.
SIGNAL, CONVICT, LEAST_NAMES = 1.0, 0.1, 20000


def context_boost(ctx: Column, start: Column, end: Column) -> Column:
    near = T.window(ctx, start, end, vocab.BOOST_WINDOW, vocab.BOOST_WINDOW)
    terms = "|".join(T._escape(w) for w in sorted(vocab.CONTEXT_BOOST))
    return F.when(near.rlike(rf"(?iU)\b(?:{terms})\b"), vocab.BOOST).otherwise(0.0)


def shape_adjustment(name: Column, implausible: Column | None = None) -> Column:
    """Minus the penalties, summed in this order: digit, one token, institutional term, case, trigrams."""
    toks = T.tokens(name)
    inst = F.exists(toks, lambda t: F.btrim(t, F.lit(".,;:()[]\"'")).isNotNull() & F.lower(F.btrim(t, F.lit(".,;:()[]\"'"))).isin(vocab.INSTITUTIONAL))
    case = name.rlike(r"\p{L}") & ((name == F.upper(name)) | (name == F.lower(name)))
    part = lambda c, p: F.when(c, F.lit(p)).otherwise(F.lit(0.0))
    total = F.lit(0.0) + part(name.rlike(r"\p{Nd}"), 0.30) + part(F.size(toks) < 2, 0.15) + part(inst, 0.50) + part(case, 0.10)
    return -(total + part(implausible, 0.15) if implausible is not None else total)


def composite(score: Column, boost: Column, shape: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + boost + shape))


def tier_for(confidence: Column, fraction: Column, certain: float = vocab.CERTAIN, light: float = vocab.LIGHT) -> Column:
    base = F.when(confidence >= certain, "essentially_certain").when(confidence >= light, "light_review").otherwise("extensive_review")
    return F.when(fraction >= 0.80, "extensive_review").when((fraction >= 0.50) & (base == "essentially_certain"), "light_review").otherwise(base)


def _padded(token: Column) -> Column:
    t = F.regexp_replace(token, r"[^\p{L}'\-]", "")
    return F.when(t != "", F.concat(F.lit("\x02\x02"), t, F.lit("\x03")))


def ngrams(tokens: DataFrame) -> DataFrame:
    """(token, tri, bi) of each place of each folded token."""
    s = tokens.select("token", _padded(F.col("token")).alias("s")).filter("s is not null")
    return s.select("token", F.explode(F.sequence(F.lit(3), F.length("s"))).alias("i"), "s").select("token", F.expr("substring(s, i - 2, 3)").alias("tri"), F.expr("substring(s, i - 2, 2)").alias("bi"))


class NgramModel:
    """Trigram and bigram counts of distinct dictionary tokens, as tables, and the size of the alphabet."""

    def __init__(self, names: DataFrame):
        self.names = names.select("token").distinct()
        grams = ngrams(self.names)
        self.tri = grams.groupBy("tri").agg(F.count(F.lit(1)).alias("n_tri"))
        self.bi = grams.groupBy("bi").agg(F.count(F.lit(1)).alias("n_bi"))
        chars = self.names.select(F.explode(F.split(_padded(F.col("token")), "")).alias("ch")).filter("ch != ''")
        self.vocab = chars.agg(F.greatest(F.count_distinct("ch"), F.lit(1)).alias("v"))

    def score(self, tokens: DataFrame) -> DataFrame:
        """(token, score): mean natural log of each character's part after the two before it; tokens of under 4 letters or
        of another script have none."""
        own = tokens.select("token").distinct().filter((F.regexp_count("token", F.lit(r"\p{L}")) >= 4) & T.is_latin(F.col("token")))
        rows = ngrams(own).join(self.tri, "tri", "left").join(self.bi, "bi", "left").crossJoin(F.broadcast(self.vocab))  # one row
        part = (F.coalesce("n_tri", F.lit(0)) + ALPHA) / (F.coalesce("n_bi", F.lit(0)) + ALPHA * F.col("v"))
        return rows.groupBy("token").agg((F.sum(F.ln(part)) / F.count(F.lit(1))).alias("score"))

    def thresholds(self, percents: tuple = (SIGNAL, CONVICT)) -> DataFrame:
        """(pct, threshold, n): the score at place int(n * pct / 100) of the ascending scores of the names.

        The place is found among the scores below an approximate percentile, so that no task sorts all names."""
        scores = self.score(self.names)
        n = scores.count()
        out = None
        for pct in percents:
            at = min(max(int(n * pct / 100.0), 0), max(n - 1, 0))
            ranked = scores.orderBy("score").limit(at + 1).agg(F.max("score").alias("threshold"))
            one = ranked.select(F.lit(pct).alias("pct"), "threshold", F.lit(n).cast("long").alias("n"))
            out = one if out is None else out.unionByName(one)
        return out


def implausible_names(rows: DataFrame, key: list[str], name: str, dictionary: DataFrame) -> DataFrame:
    """key, implausible and condemned of the rows with tokens: whether a token scores below the first threshold of the
    dictionary's model; whether one does below the second while no token, or part of a hyphenated one, is in the
    dictionary, and the model has LEAST_NAMES scored names."""
    model = NgramModel(dictionary)
    limits = {r["pct"]: r for r in model.thresholds((SIGNAL, CONVICT)).collect()}  # two rows
    low, lowest = (F.lit(limits[p]["threshold"]).cast("double") for p in (SIGNAL, CONVICT))
    toks = rows.select(*key, F.explode(T.tokens(F.col(name))).alias("_raw")).withColumn("token", gazetteer_token("_raw"))
    latin = toks.withColumn("_latin", T.is_latin(F.col("_raw")))
    parts = F.filter(F.split("token", "-"), lambda p: p != "")
    own = latin.select("token").distinct()
    forms = own.withColumn("_form", F.explode(F.array_distinct(F.concat(F.array("token"), parts))))
    known = forms.join(dictionary.select(F.col("token").alias("_form")).distinct(), "_form").select("token", F.lit(True).alias("_known")).distinct()
    each = latin.join(model.score(own), "token", "left").join(known, "token", "left")
    # scores are sums in any order: the name at the threshold itself mustn't fall below it
    under = lambda limit: F.bool_or(F.coalesce(F.col("_latin") & (F.col("score") < limit - 1e-9), F.lit(False)))
    per = each.groupBy(*key).agg(under(low).alias("implausible"), under(lowest).alias("_under"), F.bool_or(F.coalesce("_known", F.lit(False))).alias("_any"))
    return per.select(*key, "implausible", (F.lit(limits[CONVICT]["n"] >= LEAST_NAMES) & F.col("_under") & ~F.col("_any")).alias("condemned"))


def runs_of(pages: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Islands of consecutive distinct pages: keys, low, high."""
    w = Window.partitionBy(*keys).orderBy(page)
    rows = pages.select(*keys, page).distinct().withColumn("_g", F.col(page) - F.row_number().over(w))
    return rows.groupBy(*keys, "_g").agg(F.min(page).alias("low"), F.max(page).alias("high")).drop("_g")
