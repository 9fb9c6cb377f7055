"""DuckDB SQL of the review engine's queries, where it can express them."""

from __future__ import annotations

import re

from nomina import vocab

_LINES = r"""lines AS (
  SELECT doc_id, (i - 1)::INTEGER AS line_no, regexp_replace(regexp_replace(t[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS line
  FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents))
)"""
_UPPER = r"""length(regexp_replace(line, '\P{L}', '', 'g')) >= 6 AND len(list_filter(regexp_extract_all(line, '\S+'), lambda w: regexp_matches(w, '\p{L}'))) >= 2
  AND length(regexp_replace(line, '\P{Lu}', '', 'g'))::DOUBLE / length(regexp_replace(line, '\P{L}', '', 'g')) >= 0.75"""


#: White space with the Unicode property, for RE2.
_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NORM = rf"trim(trim(regexp_replace(line, '{_SPACE}+', ' ', 'g')), '.,;:()[]" + '"' + "''')"
#: A name's token: a letter or mark, then word characters, apostrophes, periods and hyphens.
_TOKEN = r"[\p{L}\p{M}\p{Nl}][\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\'’.\-]*".replace("\\'", "''")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(x: str, values) -> str:
    return f"{x} IN ({', '.join(_quoted(v) for v in sorted(values))})"


def _norm(x: str) -> str:
    return _NORM.replace("line", x, 1)


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_SPACE}+'), lambda t: t <> '')"


def _bare(x: str) -> str:
    return f"list_filter(list_transform({_tokens(x)}, lambda t: trim(lower(t), {_quoted(vocab.STRIP)})), lambda t: t <> '')"


def _of(x: str, values) -> str:
    """Sorted distinct bare tokens of x among the values."""
    return f"list_sort(list_distinct(list_filter({_bare(x)}, lambda t: {_in('t', values)})))"


def _org(x: str) -> str:
    """Why a name by itself reads as an organisation."""
    built = rf"regexp_matches({x}, '(?i)\b(of|for|&|and\s+sons|and\s+daughters|und)\b')"
    proof = f"list_filter([CASE WHEN len(weak) >= 3 THEN 'multiple_weak_terms' END, CASE WHEN {built} THEN 'org_construction' END], lambda p: p IS NOT NULL)"
    return f"""(SELECT CASE WHEN len(strong) > 0 THEN 'institutional_term:' || array_to_string(strong, '+')
      WHEN len(weak) > 0 AND len({proof}) > 0 THEN 'weak_term:' || array_to_string(weak, '+') || '|' || array_to_string({proof}, '+') ELSE '' END
      FROM (SELECT {_of(x, vocab.INSTITUTIONAL)} AS strong, {_of(x, vocab.INSTITUTIONAL_WEAK)} AS weak))"""


def _flips(rows: str, column: str) -> str:
    """SQL of rows with `flipped`: `Surname, Given` in a column as `Given Surname`, or null."""
    shape = rf"^\s*({_TOKEN}(?:\s+{_TOKEN}){{0,2}})\s*,\s*({_TOKEN}(?:\s+{_TOKEN}){{0,3}})\s*$"
    flat = rf"trim(regexp_replace({column}, '\s+', ' ', 'g'))"
    header = lambda x: f"(len({_bare(x)}) > 0 AND len(list_filter({_bare(x)}, lambda t: NOT {_in('t', vocab.HEADER_WORDS)})) = 0)"
    return f"""(SELECT * EXCLUDE (surname, given), CASE WHEN surname <> '' AND NOT {_in("lower(rtrim(given, '.'))", vocab.NAME_SUFFIXES)} AND NOT ({header('surname')} AND {header('given')})
      AND {_org("(given || ' ' || surname)")} = '' THEN given || ' ' || surname END AS flipped
      FROM (SELECT *, trim(regexp_extract({flat}, '{shape}', 1)) AS surname, trim(regexp_extract({flat}, '{shape}', 2)) AS given FROM {rows}))"""


_GARBAGE = r"""SELECT file, page_num, CASE WHEN trim(text) = '' THEN 'empty_text_layer' WHEN b > 0 AND g::DOUBLE / b > 0.30 THEN 'ocr_garbage_suspected' END AS reason FROM (
  SELECT *, length(regexp_replace(text, '\s', '', 'g')) AS b, length(regexp_replace(text, '[^{}|\\\^~<>¬†‡¶\p{Sc}\p{So}\p{Sk}\p{Co}\p{Cf}]', '', 'g')) AS g FROM pages_)"""
_PAGES = "SELECT coalesce(source, '') AS file, doc_id::INTEGER AS page_num, coalesce(text, '') AS text FROM documents"
#: Folded capitalised words of the documents.
_DICTIONARY = r"""dictionary AS (SELECT DISTINCT lower(w) AS token FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nd}_]+')) AS w FROM documents) WHERE regexp_matches(w, '^[A-Z][a-z]{2,}$'))"""
_GRAMS = f"""{_DICTIONARY}, padded AS (SELECT token, chr(2) || chr(2) || token || chr(3) AS s FROM dictionary),
  grams AS (SELECT token, substr(s, i::BIGINT, 3) AS tri, substr(s, i::BIGINT, 2) AS bi FROM (SELECT token, s, unnest(range(1, length(s) - 1)) AS i FROM padded))"""
_SCORES = f"""{_GRAMS}, scored AS (
  SELECT token, sum(ln((n_tri + 0.01::DOUBLE) / (n_bi + 0.01::DOUBLE * v))) / count(*) AS score FROM grams
  JOIN (SELECT tri, count(*) AS n_tri FROM grams GROUP BY tri) USING (tri) JOIN (SELECT bi, count(*) AS n_bi FROM grams GROUP BY bi) USING (bi),
  (SELECT count(DISTINCT c) AS v FROM (SELECT unnest(string_split(s, '')) AS c FROM padded)) WHERE length(token) >= 4 GROUP BY token)"""
#: Each line as a hit: its name, key and place, every third document's held back.
_HITS = f"""{_LINES}, raw_hits AS (SELECT l.doc_id * 100000 + line_no AS seq, source, l.doc_id % 3 = 0 AS odd, {_NORM} AS raw FROM lines l JOIN documents USING (doc_id)),
  hits AS (SELECT *, lower({_norm("raw")}) AS name_key FROM raw_hits)"""
_MERGED = f"""{_HITS}, shown AS (SELECT name_key, arg_max(raw, length(raw) * 1000000000000 - seq) AS display FROM hits WHERE name_key <> '' GROUP BY name_key),
  turned AS (SELECT name_key, lower({_norm("coalesce(flipped, '')")}) AS flip FROM {_flips("shown", "display")}),
  merged AS (SELECT t.name_key, CASE WHEN o.name_key IS NOT NULL AND t.flip <> t.name_key THEN t.flip ELSE t.name_key END AS target FROM turned t LEFT JOIN shown o ON t.flip = o.name_key)"""


def _shape() -> str:
    inst = f"len(list_filter({_tokens('line')}, lambda t: {_in('lower(trim(t, ' + _quoted('.,;:()[]' + chr(34) + chr(39)) + '))', vocab.INSTITUTIONAL)})) > 0"
    part = lambda c, p: f"CASE WHEN {c} THEN {p}::DOUBLE ELSE 0 END"
    case = r"regexp_matches(line, '\p{L}') AND (line = upper(line) OR line = lower(line))"
    return " + ".join([part(r"regexp_matches(line, '\p{Nd}')", 0.30), part(f"len({_tokens('line')}) < 2", 0.15), part(inst, 0.50), part(case, 0.10)])


def _tier(confidence: str, fraction: str) -> str:
    base = f"CASE WHEN {confidence} >= {vocab.CERTAIN} THEN 'essentially_certain' WHEN {confidence} >= {vocab.LIGHT} THEN 'light_review' ELSE 'extensive_review' END"
    return f"CASE WHEN {fraction} >= 0.80 THEN 'extensive_review' WHEN {fraction} >= 0.50 AND {base} = 'essentially_certain' THEN 'light_review' ELSE {base} END"


def _signals() -> str:
    latin = rf"list_filter(toks, lambda t: NOT regexp_matches(regexp_replace(lower(t), '[a-z{vocab.VOWELS}]', '', 'g'), '\p{{L}}'))"
    letters = r"lower(regexp_replace(t, '\P{L}', '', 'g'))"
    some = lambda of, test: f"len(list_filter({of}, lambda t: {test})) > 0"
    thrice = f"len(list_filter(range(1, length({letters}) - 1), lambda i: substr({letters}, i, 1) = substr({letters}, i + 1, 1) AND substr({letters}, i, 1) = substr({letters}, i + 2, 1))) > 0"
    weak = {
        "alnum_mixed_token": some("toks", r"regexp_matches(t, '\p{L}') AND regexp_matches(t, '\p{Nd}')"),
        "consonant_run": some(latin, f"regexp_matches({letters}, '[^{vocab.VOWELS}]{{6,}}')"),
        "digits": r"regexp_matches(word, '\p{Nd}')",
        "no_multiletter_token": "NOT " + some("toks", r"length(regexp_replace(t, '\P{L}', '', 'g')) >= 2"),
        "overlong_token": some("toks", "length(t) > 30"),
        "punctuation_ratio": rf"length(regexp_replace(word, '[\p{{L}}\p{{N}}]|{_SPACE}', '', 'g'))::DOUBLE / greatest(length(replace(word, ' ', '')), 1) > 0.34",
        "repeated_char_run": some(latin, thrice),
        "vowelless_token": some(latin, f"length({letters}) >= 5 AND NOT regexp_matches({letters}, '[{vocab.VOWELS}]')"),
    }
    listed = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in weak.items())
    return f"""SELECT word, CASE WHEN NOT regexp_matches(word, '\\p{{L}}') THEN 'no_letters'
      WHEN regexp_matches(regexp_replace(word, '[ ''’‘`\\-‐‑–.,]', '', 'g'), '[\\p{{P}}\\p{{Sc}}\\p{{So}}\\p{{Sk}}\\p{{Co}}\\p{{Cf}}<>|^~=+$]') THEN 'interior_garbage_char'
      ELSE array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ',') END AS signals
      FROM (SELECT word, {_tokens("word")} AS toks FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM documents))"""


def _any_of(x: str, terms) -> str:
    """Whether x holds one of the terms on word boundaries (of Unicode, which \\b of RE2 isn't), any white space between
    their words."""
    other = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
    alt = "|".join(r"\s+".join(map(re.escape, t.split())) for t in terms)
    return f"regexp_matches({x}, {_quoted(rf'(?i)(?:^|{other})(?:{alt})(?:$|{other})')})"


def _flat(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '-{_SPACE}*\n{_SPACE}*', '', 'g'), '{_SPACE}+', ' ', 'g')"


_FOLLOWER = r"[\p{L}\p{M}\p{Nl}][’\']?[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}’\'\-]*".replace("\\'", "''")
#: Places of the first two words of a text: what stands between matches gives their offsets.
_PLACES = rf"""WITH d AS (SELECT doc_id, text, regexp_extract(text, '\w+\s+\w+') AS needle FROM documents WHERE text IS NOT NULL),
  p AS (SELECT *, regexp_extract(needle, '^\w+') || '{_SPACE}+' || regexp_extract(needle, '\w+$') AS pattern FROM d WHERE needle <> ''),
  m AS (SELECT doc_id, regexp_extract_all(text, pattern) AS found, regexp_split_to_array(text, pattern) AS gaps FROM p),
  l AS (SELECT doc_id, unnest(range(1, len(found) + 1)) AS i, list_transform(found, lambda x: length(x)) AS f, list_transform(gaps, lambda x: length(x)) AS g FROM m)
  SELECT doc_id, (list_sum(g[1:i]) + coalesce(list_sum(f[1:i - 1]), 0))::INTEGER AS "start", (list_sum(g[1:i]) + list_sum(f[1:i]))::INTEGER AS "end" FROM l"""


def _sanitized() -> str:
    """Lines without debris at the ends of their tokens and without leading phrases: one phrase a round of the recursion."""
    debris, kept = r"[\p{P}\p{Sc}\p{So}\p{Sk}\p{Co}\p{Cf}<>|^~=+$]+", r"[ ''’‘`\-‐‑–.,]"
    masked = f"regexp_replace(w, '{kept}', 'a', 'g')"
    low, high = f"length(regexp_extract({masked}, '^{debris}'))", f"length(regexp_extract({masked}, '{debris}$'))"
    clean = f"trim(substr(w, {low} + 1, greatest(length(w) - {low} - {high}, 0)), {_quoted(vocab.STRIP + ' ')})"
    probe = lambda k: f"array_to_string(list_transform(t[1:{k}], lambda x: trim(lower(x), {_quoted(vocab.STRIP)})), ' ')"

    def longest(phrases) -> str:
        of = {k: [p for p in phrases if len(p.split()) == k] for k in (4, 3, 2, 1)}
        n = "(CASE " + " ".join(f"WHEN len(t) >= {k} AND {_in(probe(k), ps)} THEN {k}" for k, ps in of.items() if ps) + " ELSE 0 END)"
        return f"CASE WHEN {n} > 0 AND {n} < len(t) THEN {n} END"

    cut = f"coalesce({', '.join(longest(p) for p in (vocab.SALUTATIONS, vocab.VALEDICTIONS, vocab.HONORIFICS))}, 0)"
    return f"""WITH RECURSIVE {_LINES}, rounds(doc_id, line_no, t) AS (
      SELECT doc_id, line_no, list_filter(list_transform({_tokens("line")}, lambda w: {clean}), lambda w: w <> '') FROM lines
      UNION ALL SELECT doc_id, line_no, t[n + 1:] FROM (SELECT *, {cut} AS n FROM rounds) WHERE n > 0)
      SELECT doc_id, line_no, array_to_string(arg_min(t, len(t)), ' ') AS name FROM rounds GROUP BY doc_id, line_no"""


def _runs(common: list[str]) -> str:
    """Dictionary spans of units (unit_id, text) for CTEs units and dictionary (token); common tokens alone don't count."""
    word = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}''’.\-]*"
    name = rf"\p{{Lu}}{word}"
    # runs of capitalised tokens, other words, and what stands between words: together the whole text
    cut = rf"{name}(?:[ \t]*{name})*|[\p{{L}}\p{{M}}\p{{Nl}}]{word}|[^\p{{L}}\p{{M}}\p{{Nl}}]"
    listed = " OR ".join([_in("form", common)] if common else ["false"])
    each = lambda found: f"unnest({found}) AS w, unnest(range(1, len({found}) + 1))"
    pieces, tokens = f"regexp_extract_all(text, '{cut}')", rf"regexp_extract_all(piece, '{name}[ \t]*')"
    return rf"""pieces AS (SELECT unit_id, w AS piece, i, sum(length(w)) OVER (PARTITION BY unit_id ORDER BY i) - length(w) AS place FROM (SELECT unit_id, {each(pieces)} AS i FROM units)),
      tokens AS (SELECT unit_id, i, j, rtrim(w, ' ' || chr(9)) AS token, place + sum(length(w)) OVER (PARTITION BY unit_id, i ORDER BY j) - length(w) AS s
        FROM (SELECT unit_id, i, place, {each(tokens)} AS j FROM pieces WHERE regexp_matches(piece, '^\p{{Lu}}'))),
      ended AS (SELECT *, (token LIKE '%.' AND length(regexp_replace(token, '\P{{L}}', '', 'g')) >= 3)::INTEGER AS stop FROM tokens),
      run AS (SELECT *, sum(stop) OVER (PARTITION BY unit_id, i ORDER BY j) - stop AS k, trim(lower(strip_accents(token)), '.,;:''’"()[]') AS norm FROM ended),
      forms AS (SELECT *, unnest(list_distinct(list_concat([norm], list_filter(string_split(norm, '-'), lambda f: f <> '')))) AS form FROM run),
      judged AS (SELECT unit_id, i, k, s, any_value(length(token)) AS n, bool_or(form IN (SELECT token FROM dictionary)) AS hit, bool_or({listed}) AS common FROM forms GROUP BY unit_id, i, k, s)
      SELECT unit_id, min(s)::INTEGER AS "start", max(s + n)::INTEGER AS "end", 'PERSON' AS entity, {vocab.DICTIONARY_SCORE}::DOUBLE AS score, 'gazetteer' AS recognizer
      FROM judged GROUP BY unit_id, i, k HAVING count(*) >= 2 AND count(*) FILTER (hit) >= 2 AND count(*) FILTER (hit AND NOT common) > 0"""


def _role(x: str) -> str:
    return f"CASE WHEN {_any_of(x, vocab.ADULT_COLUMN)} THEN 'adult' WHEN {_any_of(x, vocab.MINOR_COLUMN)} THEN 'minor' ELSE '' END"


def _columns(cells: list[tuple]) -> str:
    """CTEs cells and facts, a row for each column of a table."""
    rows = ", ".join("(" + ", ".join(_quoted(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in cells)
    return f"""cells AS (SELECT * FROM (VALUES {rows}) v(file, page_num, table_id, r, c, cell)),
      heads AS (SELECT file, page_num, table_id, c, {_flat("max(CASE WHEN r = 0 THEN cell ELSE '' END)")} AS header, count(*) FILTER (r > 0 AND flipped IS NOT NULL) AS shaped
      FROM {_flips("cells", "cell")} GROUP BY ALL),
      facts AS (SELECT file, page_num, table_id, c, {_role("header")} AS col_role, {_any_of("header", vocab.NAME_COLUMN)} OR shaped >= 2 AS is_name_column FROM heads)"""


def oracle_sql(spans: list[tuple], pages: list[tuple], names: list[str], cells: list[tuple], people: list[str], common: list[str]) -> dict[str, str]:
    """The fixtures: spans (unit_id, start, end, entity, score, recognizer), pages (file, page_num, text), names, cells
    (file, page_num, table_id, r, c, cell), dictionary tokens and the common ones of these."""
    letter = r"regexp_matches(substr(line, {}, 1), '\p{{L}}')"
    cased = lambda f: f"CASE WHEN length({f}(substr(line, i, 1))) = 1 THEN {f}(substr(line, i, 1)) ELSE substr(line, i, 1) END"
    more = ", ".join(f"({_quoted(f)}, {n}, {' || chr(10) || '.join(_quoted(x) for x in t.split(chr(10)))})" for f, n, t in pages)
    zero = ["possible_minors", "minor_high", "minor_medium", "bound_by_column", "bound_by_label", "bound_by_dob", "bound_by_relation"]
    after = rf"regexp_extract_all(regexp_extract({_flat('substr(line, e + 1, 80)')}, '^[^.!?;]*'), '{_FOLLOWER}')"
    words = r"SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM documents"
    return {
        "relocate_spans": _PLACES,
        "sanitize_surface": _sanitized(),
        "gazetteer_runs": f"WITH {_DICTIONARY}, units AS (SELECT doc_id AS unit_id, text FROM documents WHERE text IS NOT NULL), {_runs([])}",
        "ambiguous_demotion": f"WITH dictionary AS (SELECT unnest([{', '.join(map(_quoted, people))}]) AS token), units AS (SELECT file || ':' || page_num AS unit_id, text FROM (VALUES {more}) v(file, page_num, text)), {_runs(common)}",
        "column_roles": f"WITH {_columns(cells)} SELECT * FROM facts",
        "cell_units": f"""WITH {_columns(cells)}, t AS (SELECT file, page_num, trim(regexp_replace(cell, '{_SPACE}*\\n{_SPACE}*', ' ', 'g')) AS t, CASE WHEN r = 0 THEN '' ELSE col_role END AS col_role, is_name_column
          FROM cells JOIN facts USING (file, page_num, table_id, c)), f AS (SELECT * FROM {_flips("t", "t")} WHERE t <> '')
          SELECT file, page_num, 'cell' AS kind, t AS analysis_text, t AS source_text, col_role FROM f
          UNION ALL SELECT file, page_num, 'flipped', flipped, t, col_role FROM f WHERE is_name_column AND flipped <> t""",
        "garbage_verdicts": f"""SELECT word, CASE WHEN signals IN ('no_letters', 'interior_garbage_char') OR contains(signals, ',') THEN signals ELSE '' END AS detail FROM ({_signals()})""",
        "context_boosts": f"""WITH {_LINES}, near AS (SELECT *, substr(line, greatest(s - 30, 0) + 1, e + 30 - greatest(s - 30, 0)) AS near FROM (SELECT *, length(line) // 2 AS s, length(line) // 2 + 5 AS e FROM lines))
          SELECT doc_id, line_no, near, CASE WHEN {_any_of("near", vocab.CONTEXT_BOOST)} THEN {vocab.BOOST}::DOUBLE ELSE 0 END AS boost, CASE WHEN line = '' THEN '' ELSE array_to_string({after}, ',') END AS after FROM near""",
        "boilerplate_words": f"SELECT word, len(b) = 0 OR {_in("array_to_string(b, ' ')", vocab.BOILERPLATE)} AS boilerplate FROM (SELECT word, {_bare('word')} AS b FROM ({words}))",
        "header_roles": f"""SELECT word, {_role("flat")} AS role
          FROM (SELECT word, {_flat("word")} AS flat FROM ({words} UNION ALL SELECT unnest(['Student name', 'PARENT', 'Teacher / Pupil', 'guardians', 'Child', 'minor' || chr(10) || 'children'])))""",
        "variant_dedupe": f"""WITH {_LINES}, h AS (SELECT doc_id AS page_num, line_no AS seq, regexp_extract(lower({_NORM}), '^[^\\x20]+') AS name_key, line_no % 3 <> 0 AS is_variant FROM lines)
          SELECT page_num, seq, name_key, is_variant FROM h WHERE NOT is_variant UNION ALL SELECT page_num, seq, name_key, is_variant FROM (
          SELECT *, row_number() OVER (PARTITION BY page_num, name_key ORDER BY seq) AS n FROM h v WHERE is_variant
          AND NOT EXISTS (SELECT 1 FROM h o WHERE NOT o.is_variant AND o.page_num = v.page_num AND o.name_key = v.name_key)) WHERE n = 1""",
        "titlecase_lines": f"""WITH {_LINES} SELECT doc_id, line_no, array_to_string(list_transform(range(1, length(line) + 1), lambda i: CASE WHEN NOT {letter.format("i")} THEN substr(line, i, 1)
          WHEN i > 1 AND {letter.format("i - 1")} THEN {cased("lower")} ELSE {cased("upper")} END), '') AS line FROM lines WHERE {_UPPER}""",
        "garbage_signals": _signals(),
        "shape_scores": f"""WITH {_LINES} SELECT doc_id, line_no, round(0 - p, 6) AS shape, round(c, 6) AS confidence, {_tier("round(c, 6)", "0.0")} AS tier
          FROM (SELECT *, greatest(0, least(1, 0.85::DOUBLE + 0.0 - p)) AS c FROM (SELECT *, {_shape()} AS p FROM lines))""",
        "flipped_names": f"WITH {_LINES} SELECT doc_id, line_no, flipped FROM {_flips('lines', 'line')} WHERE flipped IS NOT NULL",
        "page_problems": f"WITH pages_ AS ({_PAGES} UNION ALL SELECT * FROM (VALUES {more}) v(file, page_num, text)) SELECT * FROM ({_GARBAGE}) WHERE reason IS NOT NULL",
        "org_rules": f"SELECT name, {_org('name')} AS detail FROM (SELECT DISTINCT name FROM (SELECT unnest([{', '.join(_quoted(n) for n in names)}]) AS name UNION ALL SELECT s_name FROM supplier))",
        "ngram_counts": f"WITH {_GRAMS} SELECT tri, count(*) AS n_tri FROM grams GROUP BY tri",
        "ngram_scores": f"WITH {_SCORES} SELECT token, round(score, 6) AS score FROM scored",
        "ngram_thresholds": f"""WITH {_SCORES}, ranked AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS place, count(*) OVER () AS n FROM scored)
          SELECT pct, round(score, 6) AS threshold, n FROM ranked, (VALUES (1.0::DOUBLE), (0.1::DOUBLE)) p(pct) WHERE place = least(floor(n * pct / 100.0), n - 1)""",
        "inverted_merge": f"WITH {_MERGED} SELECT name_key, target FROM merged",
        "manifest_totals": f"""WITH {_MERGED}, rolled AS (SELECT target, count(*) AS n, count(*) FILTER (odd) AS held, bool_or(odd) AS g, bool_or(NOT odd) AS s FROM hits JOIN merged USING (name_key) GROUP BY target),
          tiered AS (SELECT *, {_tier("0.65", "(held::DOUBLE / n)")} AS tier FROM rolled)
          SELECT count(*) AS names, coalesce(sum(n), 0)::BIGINT AS occurrences, {", ".join(f"count(*) FILTER (tier = '{t}') AS {t}" for t in ("essentially_certain", "light_review", "extensive_review"))},
          count(*) FILTER (held = n) AS suppressed, count(*) FILTER (held > 0 AND held < n) AS rescued, {", ".join(f"0::BIGINT AS {z}" for z in zero)},
          count(*) FILTER (s AND NOT g) AS recognizer_spacy, count(*) FILTER (g AND NOT s) AS recognizer_gazetteer, count(*) FILTER (g AND s) AS recognizer_both FROM tiered""",
        "file_stats": f"""WITH {_LINES}, pages_ AS ({_PAGES}), h AS (SELECT source AS file, count(*) AS hits, count(*) FILTER (l.doc_id % 3 = 0) AS suppressed FROM lines l JOIN documents USING (doc_id) GROUP BY source),
          p AS (SELECT file, string_agg(reason || ':' || n, '; ' ORDER BY reason || ':' || n) AS problems FROM (SELECT file, reason, count(*) AS n FROM ({_GARBAGE}) WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY file)
          SELECT coalesce(h.file, p.file) AS file, coalesce(hits, 0) AS hits, coalesce(suppressed, 0) AS suppressed, coalesce(problems, '') AS problems FROM h FULL OUTER JOIN p ON h.file = p.file""",
        "norm_name": f"WITH {_LINES} SELECT doc_id, line_no, {_NORM} AS name, lower({_NORM}) AS name_key FROM lines",
        "context_normalize": r"SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(text, ''), '-\s*\n\s*', '', 'g'), '\s+', ' ', 'g')) AS flat FROM documents",
        "uppercase_lines": f"WITH {_LINES} SELECT doc_id, line_no, line FROM lines WHERE {_UPPER}",
        "csv_safe": f"WITH {_LINES} " + r"SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^[=+\-@]') THEN '''' || line ELSE line END AS cell FROM lines",
        "page_garbage": r"""SELECT doc_id, round(CASE WHEN b = 0 THEN 0 ELSE g::DOUBLE / b END, 6) AS ratio FROM (
          SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS b, length(regexp_replace(coalesce(text, ''), '[^{}|\\\^~<>¬†‡¶\p{Sc}\p{So}\p{Sk}\p{Co}\p{Cf}]', '', 'g')) AS g FROM documents)""",
        "page_ranges": """SELECT l_suppkey, min(page) AS low, max(page) AS high FROM (SELECT l_suppkey, page, page - row_number() OVER (PARTITION BY l_suppkey ORDER BY page) AS g
          FROM (SELECT DISTINCT l_suppkey, l_partkey::BIGINT AS page FROM lineitem)) GROUP BY l_suppkey, g""",
        "page_lists": """SELECT source, string_agg(CASE WHEN low = high THEN 'p' || low ELSE 'p' || low || '-p' || high END, ',' ORDER BY low) AS pages FROM (
          SELECT source, min(doc_id) AS low, max(doc_id) AS high FROM (SELECT source, doc_id, doc_id - row_number() OVER (PARTITION BY source ORDER BY doc_id) AS g
          FROM (SELECT DISTINCT source, doc_id FROM documents)) GROUP BY source, g) GROUP BY source""",
        "latin_words": rf"""SELECT word, NOT regexp_matches(regexp_replace(lower(word), '[a-z{vocab.VOWELS}]', '', 'g'), '\p{{L}}') AS latin
          FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM documents)""",
        "gazetteer_tokens": """SELECT DISTINCT token FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS token FROM part)
          WHERE length(token) >= 2 AND token NOT IN ('name', 'surname', 'rank', 'count') AND regexp_matches(token, '^[a-z''-]+$')""",
        "denylist_all_tokens": """WITH deny AS (SELECT DISTINCT t FROM (SELECT unnest(string_split(lower(n_name), ' ')) AS t FROM nation) WHERE t < 'nation_2'),
          toks AS (SELECT n_nationkey, unnest(string_split(lower(n_name), ' ')) AS t FROM nation)
          SELECT n_nationkey, 'denylist:' || left(string_agg(DISTINCT toks.t, '+' ORDER BY toks.t), 80) AS denylist_detail FROM toks LEFT JOIN deny ON toks.t = deny.t
          GROUP BY n_nationkey HAVING count(*) = count(deny.t)""",
        "suppressor_overlap": "WITH s(unit_id, s, e, entity, score, recognizer) AS (VALUES " + ", ".join(map(str, spans)) + """)
          SELECT p.unit_id::INTEGER AS unit_id, p.s::INTEGER AS "start", p.e::INTEGER AS "end", p.recognizer, coalesce(string_agg(DISTINCT o.entity, ',' ORDER BY o.entity), '') AS overlaps
          FROM s p LEFT JOIN s o ON o.entity <> 'PERSON' AND p.unit_id = o.unit_id AND o.s < p.e AND p.s < o.e WHERE p.entity = 'PERSON' GROUP BY ALL""",
        "resume_antijoin": """SELECT DISTINCT source AS file, (doc_id // 100 * 100 + 1)::INTEGER AS start_page, (doc_id // 100 * 100 + 100)::INTEGER AS end_page FROM documents
          WHERE (doc_id // 100 * 100 + 1) % 200 <> 1""",
        "name_rollup": f"""WITH {_HITS} SELECT name_key, arg_max(raw, length(raw) * 1000000000000 - seq) AS display, count(*) AS occurrence_count, count(*) FILTER (odd) AS suppressed_count,
          concat_ws(',', CASE WHEN bool_or(odd) THEN 'gazetteer' END, CASE WHEN bool_or(NOT odd) THEN 'spacy' END) AS recognizers, count(DISTINCT source)::INTEGER AS file_count
          FROM hits WHERE name_key <> '' GROUP BY name_key""",
    }
