"""Whether a name is bound to a child, by column, label, birth date or relation. All ages are as of a given year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nomina import vocab
from nomina.functions import text as T

# Which ages, dates and labels count depends on each part of these patterns, so they are stated as they are.
_AGE = r"(?:[0-9]|1[0-7])"
MINOR_AGE = rf"(?iU)\b(?:age[d]?\s*:?\s*)?(?<!\d){_AGE}(?!\d)\s*(?:-|\s)?\s*(?:years?|yrs?|y\.?\s?o\.?|yo)\b(?:\s*old)?|\bage[d]?\s*:?\s*(?<!\d){_AGE}(?!\d)\b"
ADULT_AGE = r"(?iU)\bage[d]?\s*:?\s*(?<!\d)(?:1[89]|[2-9]\d)(?!\d)\b|\b(?<!\d)(?:1[89]|[2-9]\d)(?!\d)\s*years?\s*old\b"
_CUE = r"(?:d\.?o\.?b\.?|date\s+of\s+birth|birth\s*date|birthdate|born(?:\s+on|\s+in)?|dob)\s*[:\-]?\s*"
_WRITTEN = rf"(?iU){_CUE}(?:\d{{1,2}}\s+)?(?:{'|'.join(vocab.MONTHS)})\.?\s+(?:\d{{1,2}},?\s+)?((?:19|20)\d{{2}})"
_NUMERIC = rf"(?iU){_CUE}\b\d{{1,2}}[/-]\d{{1,2}}[/-](\d{{2,4}})\b"
_YEAR = rf"(?iU){_CUE}\b((?:19|20)\d{{2}})\b"
_CREDENTIAL = r"(?iU)^\s*[,.]?\s*(?:" + "|".join(T._escape(c) for c in sorted(vocab.CREDENTIALS)) + r")\b"
_APPOSITIVE = rf"(?iU)^\s*[,(]?\s*(?:who\s+is\s+)?(?:a\s+)?(?:minor|juvenile|age[d]?\s*:?\s*{_AGE}\b|{_AGE}\s*(?:years?|yrs?|y/?o)\b|sophomore|freshman|junior|senior)"
_JOINED = r"(?iU)^\s*(?:,|and|&|;)\s*$"
TIERS = {"column": "high", "label": "high", "dob": "high", "relation": "medium", "": ""}
BINDINGS = ["", "relation", "dob", "label", "column"]


def birth_years(window: Column, as_of: int) -> Column:
    """Years of dates right after a birth cue; two digits pivot on the year of as_of."""
    two = lambda y: F.when(y.cast("int") < 100, y.cast("int") + F.when(y.cast("int") <= as_of % 100, 2000).otherwise(1900)).otherwise(y.cast("int"))
    take = lambda p: F.regexp_extract_all(window, F.lit(p), F.lit(1))
    return F.concat(F.transform(take(_WRITTEN), lambda y: y.cast("int")), F.transform(take(_NUMERIC), two), F.transform(take(_YEAR), lambda y: y.cast("int")))


def dob_minor(window: Column, as_of: int) -> Column:
    return F.exists(birth_years(window, as_of), lambda y: (F.lit(as_of) - y).between(0, 18))


def dob_adult(window: Column, as_of: int) -> Column:
    return F.exists(birth_years(window, as_of), lambda y: F.lit(as_of) - y > 18)


def reasons(ctx: Column, start: Column, end: Column, as_of: int) -> Column:
    """Sorted signals in the 40 characters around a name."""
    raw = T.window(ctx, start, end, vocab.MINOR_WINDOW, vocab.MINOR_WINDOW)
    near = T.normalize_context(raw)
    found = lambda x, p: F.regexp_extract_all(x, F.lit(p), F.lit(0))
    terms = F.transform(found(near, T.phrase_pattern(vocab.MINOR_TERMS)), F.lower)
    acronyms = found(raw, r"(?U)\b(?:" + "|".join(vocab.ACRONYMS) + r")\b")
    ages = F.transform(found(near, MINOR_AGE), lambda a: F.concat(F.lit("age:"), F.lower(F.trim(a))))
    dob = F.when(dob_minor(near, as_of), F.array(F.lit("dob-implies-minor"))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_sort(F.array_distinct(F.concat(terms, acronyms, ages, dob)))


def column_role(header: Column) -> Column:
    """adult wins over minor; else the empty string."""
    text = T.normalize_context(F.coalesce(header, F.lit("")))
    return F.when(text.rlike(T.phrase_pattern(vocab.ADULT_COLUMN)), "adult").when(text.rlike(T.phrase_pattern(vocab.MINOR_COLUMN)), "minor").otherwise("")


def bound(ctx: Column, start: Column, end: Column, as_of: int) -> Column:
    """struct(adult, minor): what the label before a name and the text after it say."""
    low = F.greatest(start - vocab.BEFORE, F.lit(0))
    before = T.normalize_context(F.substring(ctx, (low + 1).cast("int"), (start - low).cast("int")))
    after = T.normalize_context(F.substring(ctx, (end + 1).cast("int"), F.lit(vocab.AFTER)))

    def judge(w: Column) -> Column:
        b, a, years = w["b"], w["a"], w["y"]
        old = F.exists(years, lambda y: F.lit(as_of) - y > 18)
        young = F.exists(years, lambda y: (F.lit(as_of) - y).between(0, 18))
        adult = b.rlike(T.label_pattern(vocab.ADULT_LABELS)) | a.rlike(_CREDENTIAL) | a.rlike(ADULT_AGE) | old
        minor = b.rlike(T.label_pattern(vocab.MINOR_LABELS)) | a.rlike(_APPOSITIVE) | young
        return F.struct(adult.alias("adult"), minor.alias("minor"))

    windows = T.let(after, lambda a: F.struct(before.alias("b"), a.alias("a"), birth_years(a, as_of).alias("y")))
    return T.let(windows, judge)


def inherits(ctx: Column, spans: Column, start: Column, as_of: int) -> Column:
    """Joined by , and & or ; to an earlier span (s, e) that is bound to a child and to no adult."""

    def joined(sp: Column) -> Column:
        gap = T.normalize_context(F.substring(ctx, (sp["e"] + 1).cast("int"), F.greatest(start - sp["e"], F.lit(0)).cast("int")))
        child = T.let(bound(ctx, sp["s"], sp["e"], as_of), lambda b: b["minor"] & ~b["adult"])
        return F.when((sp["e"] < start) & gap.rlike(_JOINED), child).otherwise(F.lit(False))

    return F.exists(spans, joined)


def binding(ctx: Column, spans: Column, start: Column, end: Column, signals: Column, role: Column, as_of: int) -> Column:
    """column, label, dob, relation, or the empty string."""
    near = T.normalize_context(T.window(ctx, start, end, 25, vocab.AFTER))
    tight = T.normalize_context(T.window(ctx, start, end, vocab.MINOR_WINDOW, vocab.MINOR_WINDOW))
    strong = F.exists(signals, lambda r: r.startswith("age:") | F.lower(r).isin(vocab.STRONG_SIGNALS))

    def judge(b: Column) -> Column:
        return (
            F.when(role == "adult", "")
            .when(role == "minor", "column")
            .when(b["minor"], "label")
            .when(inherits(ctx, spans, start, as_of), "label")
            .when(b["adult"], "")
            .when(F.size(signals) == 0, "")
            .when(dob_minor(near, as_of) | near.rlike(MINOR_AGE), "dob")
            .when(tight.rlike(T.phrase_pattern(vocab.RELATION_TERMS)) | strong, "relation")
            .otherwise("")
        )

    return T.let(bound(ctx, start, end, as_of), judge)


def tier(kind: Column) -> Column:
    out = F.lit("")
    for k, t in TIERS.items():
        out = F.when(kind == k, t).otherwise(out)
    return out
