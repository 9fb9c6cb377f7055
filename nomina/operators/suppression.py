"""Verdicts that hold a name back: debris, boilerplate, denylist, organisation, medical term. The first that fires counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomina import vocab
from nomina.functions import text as T
from nomina.functions.similarity import eponyms


def garbage_signals(name: Column, implausible: Column | None = None) -> Column:
    """Array of signals; a severe one stands alone. implausible: whether a token's trigrams are."""
    toks, letters = T.tokens(name), F.regexp_count(name, F.lit(r"\p{L}"))
    letters_of = lambda t: F.lower(F.regexp_replace(t, r"\P{L}", ""))
    latin = F.filter(toks, T.is_latin)
    punct = F.regexp_count(name, F.lit(r"(?U)[^\p{L}\p{N}\s]"))
    body = F.greatest(F.length(F.regexp_replace(name, " ", "")), F.lit(1))
    weak = [
        ("alnum_mixed_token", F.exists(toks, lambda t: t.rlike(r"\p{L}") & t.rlike(r"\p{Nd}"))),
        ("consonant_run", F.exists(latin, lambda t: letters_of(t).rlike(f"[^{vocab.VOWELS}]{{6,}}"))),
        ("digits", name.rlike(r"\p{Nd}")),
        *([("implausible_ngrams", implausible)] if implausible is not None else []),
        ("no_multiletter_token", ~F.exists(toks, lambda t: F.regexp_count(t, F.lit(r"\p{L}")) >= 2)),
        ("overlong_token", F.exists(toks, lambda t: F.length(t) > 30)),
        ("punctuation_ratio", punct / body > 0.34),
        ("repeated_char_run", F.exists(latin, lambda t: letters_of(t).rlike(r"(.)\1\1"))),
        ("vowelless_token", F.exists(latin, lambda t: (F.length(letters_of(t)) >= 5) & ~letters_of(t).rlike(T.VOWEL))),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in weak]))
    one = lambda s: F.array(F.lit(s))
    return F.when(F.coalesce(name, F.lit("")) == "", one("empty")).when(letters == 0, one("no_letters")).when(name.rlike(T.GARBAGE), one("interior_garbage_char")).otherwise(found)


def garbage_detail(name: Column, implausible: Column | None = None, condemned: Column | None = None) -> Column:
    """Signals if one is severe or two are weak; the third way: implausible, condemned by the strict threshold (which the
    caller sets only for a model of 20,000 names or more and a span without dictionary tokens)."""

    def judge(s: Column) -> Column:
        severe = F.get(s, 0).isin("empty", "no_letters", "interior_garbage_char")
        out = F.when(F.coalesce(severe, F.lit(False)) | (F.size(s) >= 2), F.array_join(s, ","))
        if condemned is not None:
            out = out.when(F.array_contains(s, "implausible_ngrams") & condemned, "implausible_ngrams,not_in_gazetteer")
        return out.otherwise("")

    return T.let(garbage_signals(name, implausible), judge)


def tokens_after(ctx: Column, end: Column, limit: int) -> Column:
    """Words in the text after a span up to the first sentence boundary; none without context or at offset 0."""
    cut = F.regexp_extract(T.normalize_context(F.substring(ctx, (end + 1).cast("int"), F.lit(limit))), r"^[^.!?;]*", 0)
    found = F.regexp_extract_all(cut, F.lit(r"(?U)[\w&&[^\d_]][’']?[\w’'\-]*"), F.lit(0))
    return F.when((F.coalesce(ctx, F.lit("")) != "") & (F.coalesce(end, F.lit(0)) > 0), found).otherwise(F.expr("cast(array() as array<string>)"))


def _bare(t: Column) -> Column:
    return F.btrim(F.lower(t), F.lit(vocab.STRIP))


def terms_after(ctx: Column, end: Column) -> Column:
    """struct(strong, weak): institutional terms among the next 4 words; linkers are passed over, a word that isn't
    capitalised ends the walk, a strong term too."""
    start = F.struct(F.lit(False).alias("stop"), F.lit("").alias("strong"), F.expr("cast(array() as array<string>)").alias("weak"))

    def step(acc: Column, t: Column) -> Column:
        n = _bare(t)
        strong, weak, plain = n.isin(vocab.INSTITUTIONAL), n.isin(vocab.INSTITUTIONAL_WEAK), ~t.rlike(r"^\p{Lu}")
        skip = acc["stop"] | n.isin(vocab.LINKERS)
        return F.struct(
            F.when(skip, acc["stop"]).otherwise(plain | strong).alias("stop"),
            F.when(~skip & ~plain & strong, n).otherwise(acc["strong"]).alias("strong"),
            F.when(~skip & ~plain & ~strong & weak, F.concat(acc["weak"], F.array(n))).otherwise(acc["weak"]).alias("weak"),
        )

    return F.aggregate(F.slice(tokens_after(ctx, end, 80), 1, 4), start, step)


def org_detail(name: Column, ctx: Column | None = None, end: Column | None = None, overlaps: Column | None = None) -> Column:
    """Why a name reads as an organisation, or the empty string. overlaps: upper-case entity labels over the span."""
    none = F.expr("cast(array() as array<string>)")
    overlaps = none if overlaps is None else F.transform(F.coalesce(overlaps, none), F.upper)
    join = lambda a: F.array_join(a, "+")
    toks = F.array_distinct(T.bare_tokens(name))
    own = T.let(toks, lambda t: F.struct(F.array_sort(F.array_intersect(t, T.words(vocab.INSTITUTIONAL))).alias("strong"), F.array_sort(F.array_intersect(t, T.words(vocab.INSTITUTIONAL_WEAK))).alias("weak")))
    after = F.struct(F.lit("").alias("strong"), none.alias("weak")) if ctx is None else terms_after(ctx, end)

    def further(o: Column, a: Column) -> Column:
        """Weak terms after the span that are new; they count from two on."""
        return T.let(F.filter(a["weak"], lambda w: ~F.array_contains(o["weak"], w)), lambda m: F.when(F.size(m) >= 2, m).otherwise(none))

    def proven(weak: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(F.size(weak) >= 3, F.lit("multiple_weak_terms")),
                F.when(F.arrays_overlap(overlaps, T.words(["LOCATION", "GPE"])), F.lit("ner_location")),
                F.when(name.rlike(r"(?iU)\b(?:of|for|&|and\s+sons|and\s+daughters|und)\b"), F.lit("org_construction")),
            )
        )

    def judge(o: Column, a: Column, more: Column, weak: Column, proof: Column) -> Column:
        hard = F.array_sort(F.array_intersect(F.array_distinct(overlaps), T.words(["ORGANIZATION", "ORG", "NRP"])))
        later = F.when(F.size(more) > 0, F.concat(F.lit("|after:"), join(F.array_sort(F.array_distinct(more))))).otherwise("")
        return (
            F.when(F.size(o["strong"]) > 0, F.concat(F.lit("institutional_term:"), join(o["strong"])))
            .when(a["strong"] != "", F.concat(F.lit("following_institutional_term:"), a["strong"]))
            .when((F.size(weak) > 0) & (F.size(proof) > 0), F.concat(F.lit("weak_term:"), join(weak), later, F.lit("|"), join(proof)))
            .when((F.size(weak) > 0) & (F.size(hard) > 0), F.concat(F.lit("ner_entity:"), join(hard), F.lit("|weak_term:"), join(weak)))
            .otherwise("")
        )

    def with_more(o: Column, a: Column, more: Column) -> Column:
        weak = F.array_sort(F.array_distinct(F.concat(o["weak"], more)))
        return T.let(weak, lambda w: T.let(F.array_sort(proven(w)), lambda pr: judge(o, a, more, w, pr)))

    return T.let(own, lambda o: T.let(after, lambda a: T.let(further(o, a), lambda m: with_more(o, a, m))))


# Which words before a name and which codes near it count depends on each part of these patterns.
_CUES = r"\b(" + "|".join(r"\s+".join(T._escape(w) for w in c.split()) for c in sorted(vocab.CLINICAL_CUES, key=len, reverse=True)) + r")\s*[:\-]?\s*(?:of\s+)?$"
_ICD = r"(?<![A-Za-z0-9])[A-TV-Z]\d{2}(?:\.[0-9A-Za-z]{1,4})?(?![A-Za-z0-9])"


def medical_detail(name: Column, ctx: Column, start: Column, end: Column) -> Column:
    """Why a name reads as a medical term, or the empty string."""
    toks = T.bare_tokens(name)
    last = F.try_element_at(toks, F.lit(-1))
    keep = vocab.STRIP.replace("'", "").replace("’", "")
    raw = F.transform(T.tokens(name), lambda t: F.btrim(F.lower(t), F.lit(keep)))
    own = F.filter(raw, lambda t: t.rlike(r"(?:['’]s|s['’])$"))
    base = F.transform(own, lambda t: F.btrim(F.regexp_replace(t, r"(?:['’]s|s['’])$", ""), F.lit(vocab.STRIP)))
    wide = (F.size(toks) == 1) | (F.size(own) > 0)
    after = F.transform(tokens_after(ctx, end, 72), _bare)
    after = T.let(after, lambda a: F.when(wide, a).otherwise(F.slice(a, 1, 3)))
    head = F.get(F.filter(after, lambda t: t.isin(vocab.HEAD_NOUNS)), 0)
    before = T.normalize_context(F.substring(ctx, (F.greatest(start - 32, F.lit(0)) + 1).cast("int"), F.least(start, F.lit(32)).cast("int")))
    cue = F.regexp_extract(before, "(?iU)" + _CUES, 1)
    near = T.normalize_context(T.window(ctx, start, end, 16, 16))
    quoted = F.substring(ctx, (end + 1).cast("int"), F.lit(1)).isin("'", "’")
    has = F.coalesce(ctx, F.lit("")) != ""
    found = F.struct(F.get(F.array_compact(eponyms(base)), 0).alias("possessed"), eponyms(toks).alias("named"), head.alias("head"), cue.alias("cue"), F.size(toks).alias("n"), last.alias("last"))

    def judge(f: Column) -> Column:
        one, tail = F.get(F.array_compact(f["named"]), 0), F.try_element_at(f["named"], F.lit(-1))
        return (
            F.when(f["n"] == 0, "")
            .when(f["last"].isin(vocab.HEAD_NOUNS), F.concat(F.lit("head_noun:"), f["last"]))
            .when(f["possessed"].isNotNull(), F.concat(F.lit("possessive_eponym:"), f["possessed"]))
            .when(f["head"].isNotNull(), F.concat(F.lit("following_head_noun:"), f["head"]))
            .when(has & (f["n"] <= 2) & (f["cue"] != ""), F.concat(F.lit("clinical_cue:"), T.collapse(F.lower(f["cue"]))))
            .when(has & (end > 0) & near.rlike(_ICD) & one.isNotNull(), F.concat(F.lit("icd_adjacent_eponym:"), one))
            .when(has & (end > 0) & quoted & tail.isNotNull(), F.concat(F.lit("possessive_eponym:"), tail))
            .otherwise("")
        )

    return T.let(found, judge)


def denylist_detail(rows: DataFrame, key: list[str], name: str, denylist: DataFrame) -> DataFrame:
    """key and denylist_detail of the rows all of whose folded tokens are on the list (token); others are left out."""
    from nomina.functions.similarity import gazetteer_token

    listed = denylist.select(F.col("token").alias("_t"), F.lit(True).alias("_on")).distinct()
    toks = rows.select(*key, F.explode(T.tokens(F.col(name))).alias("_raw")).withColumn("_t", gazetteer_token("_raw")).filter("_t != ''")
    found = toks.join(listed, "_t", "left").groupBy(*key).agg(F.bool_and(F.coalesce("_on", F.lit(False))).alias("_all"), F.array_sort(F.collect_set("_t")).alias("_ts"))
    return found.filter("_all").select(*key, F.concat(F.lit("denylist:"), F.left(F.array_join("_ts", "+"), F.lit(80))).alias("denylist_detail"))


def verdict(rows: DataFrame, denied: str | None = None, implausible: Column | None = None, condemned: Column | None = None) -> DataFrame:
    """rows (name, ctx, start, end, overlaps, and a denylist detail column) with suppress_reason and suppress_detail.

    Order: debris, boilerplate, denylist, organisation, medical term; empty strings where none fires."""
    name, ctx, start, end = (F.col(c) for c in ("name", "ctx", "start", "end"))
    rows = rows.withColumns({"_g": garbage_detail(name, implausible, condemned), "_o": org_detail(name, ctx, end, F.col("overlaps")), "_m": medical_detail(name, ctx, start, end)})
    deny = F.coalesce(F.col(denied), F.lit("")) if denied else F.lit("")
    pick = lambda reason, detail: (
        F.when(F.col("_g") != "", reason("ocr_garbage") if reason else F.col("_g"))
        .when(T.boilerplate_only(name), reason("salutation_only") if reason else F.lit("boilerplate_only"))
        .when(deny != "", reason("denylist") if reason else deny)
        .when(F.col("_o") != "", reason("organization") if reason else F.col("_o"))
        .when(F.col("_m") != "", reason("medical_term") if reason else F.col("_m"))
        .otherwise("")
    )
    return rows.withColumns({"suppress_reason": pick(F.lit, None), "suppress_detail": pick(None, None)}).drop("_g", "_o", "_m")
