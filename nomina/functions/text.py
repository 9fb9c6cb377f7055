"""Column functions over names and lines of text. Patterns are Java's, Unicode-aware where words are concerned."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from nomina import vocab

#: A character that can't stand inside a name: punctuation, symbols, private, format, unassigned, less what names hold.
GARBAGE = r"[\p{P}\p{Sc}\p{So}\p{Sk}\p{Co}\p{Cf}\p{Cn}\p{Cs}<>|^~=+$&&[^ '’‘`\-‐‑–.,]]"
LETTER = r"\p{L}"
VOWEL = f"[{vocab.VOWELS}]"
#: A letter, then word characters, apostrophes, periods and hyphens.
NAME_TOKEN = r"[\w&&[^\d_]][\w'’.\-]*"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated, and written into the plan, once."""
    return F.get(F.transform(F.array(value), body), 0)


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", " ")


def normalize_name(x: Column) -> Column:
    return F.btrim(F.trim(collapse(x)), F.lit(".,;:()[]\"'"))


def dedup_key(x: Column) -> Column:
    return F.lower(normalize_name(x))


def normalize_context(x: Column) -> Column:
    """Hyphenated line breaks joined, white space collapsed."""
    return collapse(F.regexp_replace(x, r"(?U)-\s*\n\s*", ""))


def window(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """The text from `before` characters before start to `after` past end, clamped; offsets count from 0."""
    low = F.greatest(start - before, F.lit(0))
    return F.substring(text, (low + 1).cast("int"), F.greatest(end + after - low, F.lit(0)).cast("int"))


def page_garbage_ratio(x: Column) -> Column:
    """Share of the characters other than white space that can't occur in running text; 0 for none."""
    body = F.regexp_count(x, F.lit(r"(?U)\S"))
    bad = F.regexp_count(x, F.lit(r"[{}|\\^~<>\x{AC}\x{2020}\x{2021}\x{B6}\p{Sc}\p{So}\p{Sk}\p{Co}\p{Cf}\p{Cn}\p{Cs}&&[^\p{L}\p{N}\s]]"))
    return F.when(body > 0, bad / body).otherwise(F.lit(0.0))


def is_uppercase_line(x: Column) -> Column:
    """At least 6 letters, 2 tokens with a letter, and three quarters of the letters upper case."""
    letters = F.regexp_count(x, F.lit(r"\p{L}"))
    tokens = F.regexp_count(x, F.lit(r"\S*\p{L}\S*"))
    return (letters >= 6) & (tokens >= 2) & (F.regexp_count(x, F.lit(r"\p{Lu}")) / F.greatest(letters, F.lit(1)) >= 0.75)


def titlecase(x: Column) -> Column:
    """Upper case after anything but a letter, lower case else; a letter whose mapping isn't one letter stays."""

    def piece(run: Column) -> Column:
        chars = F.split(run, "")
        mapped = F.transform(chars, lambda c, i: let(F.when(i == 0, F.upper(c)).otherwise(F.lower(c)), lambda m: F.when(F.length(m) == 1, m).otherwise(c)))
        return F.when(run.rlike(r"^\p{L}"), F.array_join(mapped, "")).otherwise(run)

    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), piece), "")


def csv_safe(x: Column) -> Column:
    return F.when(x.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def is_latin(token: Column) -> Column:
    """Every letter is a to z or one of the accented vowels."""
    return ~F.lower(token).rlike(f"[\\p{{L}}&&[^a-z{vocab.VOWELS}]]")


def tokens(x: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def bare_tokens(x: Column) -> Column:
    """Tokens lower-cased, without punctuation at their ends; empty ones left out."""
    return F.filter(F.transform(tokens(x), lambda t: F.btrim(F.lower(t), F.lit(vocab.STRIP))), lambda t: t != "")


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _edges(t: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(t, f"^{GARBAGE}+", ""), f"{GARBAGE}+$", "")
    return F.btrim(t, F.lit(vocab.STRIP + " "))


def sanitize(raw: Column) -> Column:
    """A detected surface without debris at the ends of its tokens and without leading salutation, valediction or
    honorific; of each kind the longest phrase of up to 4 tokens goes, and never the last token."""
    toks = F.filter(F.transform(tokens(F.coalesce(raw, F.lit(""))), _edges), lambda t: t != "")

    def leading(t: Column, phrases: list[str]) -> Column:
        probe = lambda n: F.array_join(F.transform(F.slice(t, 1, n), lambda x: F.btrim(F.lower(x), F.lit(vocab.STRIP))), " ")
        n = None
        for k in (4, 3, 2, 1):
            if any(len(p.split()) == k for p in phrases):
                hit = (F.size(t) >= k) & probe(k).isin([p for p in phrases if len(p.split()) == k])
                n = F.when(hit, k) if n is None else n.when(hit, k)
        return n.otherwise(0)

    def step(t: Column, _: Column) -> Column:
        out = None
        for phrases in (vocab.SALUTATIONS, vocab.VALEDICTIONS, vocab.HONORIFICS):
            rest = let(leading(t, phrases), lambda n: F.when((n > 0) & (n < F.size(t)), F.slice(t, n + 1, F.greatest(F.size(t) - n, F.lit(1)))))
            out = rest if out is None else F.coalesce(out, rest)
        return F.coalesce(out, t)

    return F.array_join(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1))), toks, step), " ")


def boilerplate_only(name: Column) -> Column:
    toks = bare_tokens(name)
    safe = vocab.BOILERPLATE
    return (F.size(toks) == 0) | F.array_join(toks, " ").isin(safe) | F.forall(toks, lambda t: t.isin(safe))


def phrase_pattern(terms: list[str]) -> str:
    """Any of the terms on word boundaries, any white space between their words; the first that fits in sorted order."""
    return r"(?iU)\b(?:" + "|".join(r"\s+".join(_escape(w) for w in t.split()) for t in sorted(terms)) + r")\b"


def label_pattern(labels: list[str]) -> str:
    """A label at the end of the text before a name, with a number in brackets and one of : - , after it."""
    alt = "|".join(r"\s+".join(_escape(w) for w in t.split()) for t in sorted(labels, key=len, reverse=True))
    return rf"(?iU)\b(?:{alt})\b\s*\(?\s*\d{{0,2}}\s*\)?\s*[:\-,]?\s*$"


def _escape(word: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|/-])", r"\\\1", word)


def flipped_name(cell: Column) -> Column:
    """`Surname, Given` as `Given Surname`, or null: for other shapes, suffixes, organisations and header pairs."""
    from nomina.operators.suppression import org_detail

    text = F.trim(collapse(cell))
    part = lambda n: NAME_TOKEN + r"(?:\s+" + NAME_TOKEN + rf"){{0,{n}}}"
    shape = rf"(?U)^\s*({part(2)})\s*,\s*({part(3)})\s*$"
    header = lambda x: let(bare_tokens(x), lambda ts: (F.size(ts) > 0) & F.forall(ts, lambda t: t.isin(vocab.HEADER_WORDS)))

    def flip(m: Column) -> Column:
        bad = F.lower(F.rtrim(m["given"], F.lit("."))).isin(vocab.NAME_SUFFIXES) | (header(m["surname"]) & header(m["given"]))
        return let(F.concat(m["given"], F.lit(" "), m["surname"]), lambda f: F.when(~bad & (org_detail(f) == ""), f))

    parts = let(text, lambda t: F.when(t.rlike(shape), F.struct(F.trim(F.regexp_extract(t, shape, 1)).alias("surname"), F.trim(F.regexp_extract(t, shape, 2)).alias("given"))))
    return let(parts, lambda m: F.when(m.isNotNull(), flip(m)))


def compress_pages(pages: Column) -> Column:
    """Distinct page numbers as ranges: p3-p5,p9."""
    ordered = F.array_sort(F.array_distinct(pages))
    step = lambda acc, p: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["hi"] == p - 1), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), p.alias("hi"))))).otherwise(F.concat(acc, F.array(F.struct(p.alias("lo"), p.alias("hi")))))
    ranges = F.aggregate(ordered.cast("array<bigint>"), F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)"), step)
    return F.array_join(F.transform(ranges, lambda r: F.when(r["lo"] == r["hi"], F.concat(F.lit("p"), r["lo"])).otherwise(F.concat(F.lit("p"), r["lo"], F.lit("-p"), r["hi"]))), ",")
