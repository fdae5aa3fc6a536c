"""SQL for queries whose text reads citations: the grammar is that of the operators, the rest is said anew."""

from __future__ import annotations

from statuta.functions.text import BOOK_ALIASES, GENITIVES, LIST_MARK, NOISE_BOOKS, NUMBER
from statuta.operators import extraction as ex

FORM = r"^Art\.\s*(\S+)(?:\s+Abs\.\s*(\S+))?\s+(\S.*)$"


def _numbers(x: str) -> str:
    """The distinct numbers that a list means."""
    item = r"^\s*(\d{1,9})\s*(?:[-–]|bis\s)\s*(\d{1,9})\s*$"
    a, b = (f"try_cast(regexp_extract(y, '{item}', {i}) AS INT)" for i in (1, 2))
    through = f"CASE WHEN abs({a} - {b}) <= 20 THEN list_transform(generate_series(least({a}, {b}), greatest({a}, {b})), lambda z: z::VARCHAR) ELSE [] END"
    return f"list_distinct(list_concat(flatten(list_transform(string_split_regex(lower({x}), '{LIST_MARK}'), lambda y: {through})), regexp_extract_all(lower({x}), '{NUMBER}')))"


def _quiet(pattern: str) -> str:
    """The grammar over a text whose words for subdivisions are in lower case, so that none can be a book."""
    for word in ("Abs", "Bst", "Buchstabe", "Ziff", "Satz"):
        pattern = pattern.replace(word, word.lower())
    return pattern


def phrases(key: str, table: str, text: str, form: str = ex.PHRASE_SQL) -> str:
    noise = ", ".join(f"'{n}'" for n in NOISE_BOOKS)
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY pos) - 1 AS pos, regexp_extract(m, '{form}', 1) AS chain, regexp_extract(m, '{form}', 2) AS book FROM (SELECT {key}, unnest(l) AS m, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT {key}, regexp_extract_all({text}, '{form}') AS l FROM {table}))
WHERE upper(regexp_extract(regexp_extract(m, '{form}', 2), '^\\S+')) NOT IN ({noise})"""


def articles(key: str, found: str, tune=lambda p: p) -> str:
    """``key.., art, abs`` of ``found(key.., chain)``."""
    unit, paragraphs = tune(ex.UNIT), tune(ex.PARAGRAPHS)
    return f"""SELECT {key}, art, unnest(CASE WHEN i = n AND len(p) > 0 THEN p ELSE [''] END) AS abs FROM (SELECT {key}, p, len(a) AS n, unnest(a) AS art, generate_subscripts(a, 1) AS i FROM
(SELECT {key}, {_numbers("regexp_extract(u, '" + unit + "', 1)")} AS a, list_distinct(flatten(list_transform(regexp_extract_all(regexp_extract(u, '{unit}', 2), '{paragraphs}', 1), lambda q: {_numbers('q').replace('lambda y', 'lambda yy').replace('(y,', '(yy,')}))) AS p
FROM (SELECT {key}, unnest(regexp_extract_all(chain, '{unit}')) AS u FROM ({found}))))"""


_PARTS = f"SELECT DISTINCT citation, regexp_extract(citation, '{FORM}', 3) AS b, regexp_extract(citation, '{FORM}', 1) AS a, regexp_extract(citation, '{FORM}', 2) AS p FROM laws_db WHERE regexp_matches(citation, '{FORM}')"
LOOKUP = f"""SELECT upper(b) AS book, lower(a) AS art, lower(p) AS abs, min(citation) AS citation FROM ({_PARTS}) WHERE p <> '' GROUP BY 1, 2, 3
UNION ALL SELECT book, art, '', coalesce(own, 'Art. ' || s.a || ' ' || s.b) FROM (SELECT upper(b) AS book, lower(a) AS art, min(CASE WHEN p = '' THEN citation END) AS own, min({{'b': b, 'a': a}}) AS s FROM ({_PARTS}) GROUP BY 1, 2)"""


def candidates(book: str) -> str:
    """What a written book may mean, in order."""
    book = f"regexp_replace({book}, '[\\s\\x{{a0}}]+', ' ', 'g')"
    bare = lambda x: f"upper(regexp_replace(regexp_replace({x}, '^[\\s.,;:()\\[\\]]+', ''), '[\\s.,;:()\\[\\]]+$', ''))"
    alias = lambda x: f"CASE {bare(x)} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in BOOK_ALIASES.items()) + f" ELSE {bare(x)} END"
    first, cut = f"string_split({book}, ' ')[1]", lambda x: f"regexp_replace({x}, '(\\pL)\\d{{1,3}}$', '\\1')"
    return "[" + ", ".join(alias(x) for x in (book, first, cut(book), cut(first))) + "]"


def resolved(key: str, found: str) -> str:
    """``key.., citation`` of ``found(key.., book, art, abs)``, where one is known."""
    return f"""SELECT f.{key.replace(', ', ', f.')}, r.citation FROM ({found}) f JOIN (SELECT o.book, o.art, o.abs, arg_min(k.citation, o.n * 2 + (k.abs <> lower(o.abs))::INT) AS citation FROM
(SELECT book, art, abs, unnest(c) AS b, generate_subscripts(c, 1) AS n FROM (SELECT DISTINCT book, art, abs, {candidates('book')} AS c FROM ({found}))) o JOIN ({LOOKUP}) k ON k.book = o.b AND k.art = lower(o.art) AND (k.abs = lower(o.abs) OR k.abs = '') GROUP BY 1, 2, 3) r USING (book, art, abs)"""


def laws(key: str, table: str, text: str) -> str:
    return resolved(f"{key}, pos", articles(f"{key}, pos, book", phrases(key, table, text)))


LAW_MENTIONS = f"SELECT DISTINCT doc_id, pos, citation FROM ({laws('doc_id', 'documents', 'text')})"
ALL_LAW_MENTIONS = f"SELECT DISTINCT doc_id, citation FROM ({laws('doc_id', 'documents', 'text')})"

_ASKED = "(SELECT test_id, query || chr(10) || coalesce(pre_citations, '') AS t FROM test)"
QUERY_MENTIONS = f"""SELECT DISTINCT f.test_id, f.pos, f.art, f.abs, f.book, coalesce(n.near, 0) AS near FROM ({articles('test_id, pos, book', phrases('test_id', _ASKED, 't'))}) f
LEFT JOIN (SELECT b AS book, a AS art, count(*) AS near FROM ({_PARTS}) GROUP BY 1, 2) n USING (book, art)"""

_TEXTS = "(SELECT test_id, concat_ws(chr(10), query, german_translation, decomposed_queries_raw) AS t FROM test)"
_LISTED = " UNION ALL ".join(f"SELECT test_id, trim(x) AS citation FROM (SELECT test_id, unnest(string_split({c}, ';')) AS x FROM test)" for c in ("pre_near_matches", "pre_citations"))
QUERY_HINTS = f"SELECT DISTINCT test_id, citation FROM ({_LISTED} UNION ALL SELECT test_id, citation FROM ({laws('test_id', _TEXTS, 't')})) WHERE citation IN (SELECT citation FROM laws_db)"

_TEXT = "text"
for _word in ("Absatz", "Abs", "Bst", "Buchstaben", "Buchstabe", "BST", "Ziffer", "Ziff", "Satz", "Und", "Oder"):
    _TEXT = f"regexp_replace({_TEXT}, '\\b{_word}\\b', '{_word.lower()}', 'g')"
_ROWS = f"(SELECT citation AS source, {_TEXT} AS t, regexp_extract(citation, '{FORM}', 3) AS own FROM documents WHERE starts_with(citation, 'Art.') AND text IS NOT NULL)"
_SPOKEN = phrases("source, own", _ROWS, "t", _quiet(ex.PHRASE_SQL))
_KNOWN = f"SELECT DISTINCT book FROM (SELECT book, unnest(c) AS b FROM (SELECT DISTINCT book, {candidates('book')} AS c FROM ({_SPOKEN}))) WHERE b IN (SELECT book FROM ({LOOKUP}))"
_EXPLICIT = resolved("source", articles("source, book", f"SELECT * FROM ({_SPOKEN}) WHERE book IN ({_KNOWN})", _quiet))
_REST = f"(SELECT source, own, regexp_replace(t, '{_quiet(ex.PHRASE_SQL)}', ' ; ', 'g') AS t FROM {_ROWS})"
_BARE = f"SELECT source, own AS book, chain FROM ({_SPOKEN}) WHERE book NOT IN ({_KNOWN}) AND own <> '' UNION ALL SELECT source, own AS book, unnest(regexp_extract_all(t, '(?:^|[^A-Za-z0-9_])({_quiet(ex._UNIT)})', 1)) AS chain FROM {_REST} WHERE own <> ''"
LAW_EDGES = f"""SELECT source, target, min(kind) AS kind, nullif(regexp_extract(source, '{FORM}', 3), '') AS source_book, regexp_extract(target, '{FORM}', 3) AS target_book FROM
(SELECT source, citation AS target, 'explicit' AS kind FROM ({_EXPLICIT}) UNION ALL SELECT source, citation, 'internal' FROM ({resolved('source', articles('source, book', _BARE, _quiet))})) WHERE source <> target GROUP BY 1, 2"""

_MATCHES = lambda p: f"SELECT citation, unnest(l) AS m, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT citation, regexp_extract_all(text, '{p}') AS l FROM documents WHERE citation IS NOT NULL)"
_DOCKET = lambda x: f"CASE WHEN contains({x}, '.') AND NOT contains({x}, '_') THEN regexp_replace({x}, '\\.', '_') ELSE {x} END"
_BASE = f"CASE WHEN regexp_matches(citation, '^BGE \\d+ [IVX]+[a-z]? \\d+( |$)') THEN regexp_extract(citation, '^BGE \\d+ [IVX]+[a-z]? \\d+') WHEN regexp_matches(citation, '^\\d[A-Z]+[_.]\\d+/\\d{{2,4}}( |$)') THEN {_DOCKET("split_part(citation, ' ', 1)")} END"
COURT_REFERENCES = f"""SELECT citation, ref, row_number() OVER (PARTITION BY citation ORDER BY first_at, ref) AS place FROM (SELECT citation, ref, min(pass * 1000000000 + pos) AS first_at FROM (
SELECT citation, 0 AS pass, pos, 'BGE ' || regexp_extract(m, '{ex.BGE}', 1) || ' ' || regexp_extract(m, '{ex.BGE}', 2) || ' ' || regexp_extract(m, '{ex.BGE}', 3) || CASE WHEN regexp_extract(m, '{ex.BGE}', 4) <> '' THEN ' E. ' || regexp_extract(m, '{ex.BGE}', 4) ELSE '' END AS ref FROM ({_MATCHES(ex.BGE)})
UNION ALL SELECT citation, 1, pos, unnest(CASE WHEN e <> '' THEN [d || ' E. ' || e, d] ELSE [d] END) FROM (SELECT citation, pos, regexp_extract(m, '{ex.DOCKET}', 2) AS e, {_DOCKET("regexp_extract(m, '" + ex.DOCKET + "', 1)")} AS d FROM ({_MATCHES(ex.DOCKET)})))
WHERE NOT coalesce(trim(citation) = trim(ref) OR trim(ref) = {_BASE}, FALSE) GROUP BY 1, 2)"""

_TITLE = r"trim(regexp_extract(coalesce(document, ''), '(?s)Gesetz:\s*(.*?)\s*(?:Regelungsbereich:|Normtext:|$)', 1))"
_GEN = "list_filter([n, " + ", ".join(f"CASE WHEN ends_with(n, '{e}') THEN n[:-{len(e) + 1}] || '{g}' END" for e, g in GENITIVES.items()) + "], lambda x: x IS NOT NULL)"
DOCUMENT_PARTS = rf"""SELECT law_id, title, body_length, CASE WHEN title IS NULL THEN '' ELSE array_to_string({_GEN}, ';') END AS names FROM (SELECT law_id, CASE WHEN document IS NOT NULL THEN {_TITLE} END AS title, upper({_TITLE}) AS n, length(CASE WHEN contains(document, 'Normtext:') THEN trim(regexp_extract(document, '(?s)Normtext:\s*(.*)$', 1)) ELSE document END) AS body_length FROM laws_db)"""

_CLEAN = r"trim(regexp_replace(CASE WHEN contains(f, 'GERMAN LEGAL QUERY:') THEN string_split(f, 'GERMAN LEGAL QUERY:')[-1] ELSE f END, '[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}]+', ' ', 'g'))"
TRANSLATION_CHECKS = rf"""SELECT test_id, clean, concat_ws(';', CASE WHEN clean = '' THEN 'empty' END, CASE WHEN length(clean) > 2 * greatest(length(query), 1) THEN 'too_long' END, CASE WHEN regexp_matches(clean, '^\s*[\[{{]') THEN 'json' END) AS faults
FROM (SELECT test_id, query, {_CLEAN} AS clean FROM (SELECT test_id, query, regexp_replace(regexp_replace(coalesce(german_translation, ''), '(?s)^\s*```\w*\s*', ''), '\s*```\s*$', '') AS f FROM test))"""

# ---------------------------------------------------------------- references of laws, however spelled

_W, _SUFFIX = r"[\s\x{a0}]*", "(bis|ter|quater|quinquies|sexies|septies|octies|novies|[a-z])"
_SUFFIX += r"(?:[\s\x{a0},.;:)]|$)"
_SEP = rf"{_W},?{_W}"
_CITED = rf"(?is)^{_W}art(?:icle|ikel)?\.?{_W}(\d+){_W}(?:{_SUFFIX})?(?:{_SEP}(?:abs(?:atz)?|al|para?|cpv)\.?{_W}(\d+){_W}(?:{_SUFFIX})?)?(?:{_SEP}(?:lit|bst|let|buchstabe|litera|ziff(?:er)?|satz|nr)\b\.?{_W}[\pL\d]{{1,4}}\b\.?\)?)*{_SEP}(.*?){_W}$"
_G = lambda x, i: f"regexp_extract({x}, '{_CITED}', {i})"
_NUMBER = lambda x, i: f"regexp_replace({_G(x, i)}, '^0+(\\d)', '\\1')"
_STEM = lambda x: f"regexp_replace(regexp_replace(regexp_replace({_G(x, 5)}, '[\\s\\x{{a0}}]+', ' ', 'g'), '^[\\s.,;:(\\[\"''«»]+', ''), '[\\s\\d.,;:)\\]\"''«»*†‡¹²³⁴-⁹⁰]+$', '')"
_KEY = lambda x: f"{_NUMBER(x, 1)} || lower({_G(x, 2)}) || '|' || {_NUMBER(x, 3)} || lower({_G(x, 4)}) || '|' || lower({_STEM(x)})"
_START = r"(?i)(art(?:icle|ikel)?\.?[\s\x{a0}]*\d)"
_CITING = rf"""SELECT law_id, loaded_at, unnest(string_split(regexp_replace("references", '{_START}', chr(1) || '\1', 'g'), chr(1))[2:]) AS raw FROM laws_db WHERE "references" IS NOT NULL"""
_ITEMS = rf"SELECT law_id, loaded_at, regexp_replace(raw, '[\s\x{{a0}};|,/\[\]\"'']+$', '') AS item FROM ({_CITING})"
ORPHANS = f"""SELECT r.law_id, r.key, r.loaded, r.ref, CASE WHEN s.key IS NULL THEN 'missing' WHEN s.arrives > r.loaded THEN 'late' WHEN s.ends <= r.loaded THEN 'deleted' END AS kind FROM
(SELECT i.law_id, {_KEY('i.item')} AS key, min(i.loaded_at) AS loaded, min('Art. ' || {_NUMBER('i.item', 1)} || lower({_G('i.item', 2)}) || CASE WHEN {_G('i.item', 3)} <> '' THEN ' Abs. ' || {_NUMBER('i.item', 3)} || lower({_G('i.item', 4)}) ELSE '' END || ' ' || coalesce(c.book_code, {_STEM('i.item')})) AS ref
 FROM ({_ITEMS}) i LEFT JOIN (SELECT lower(book_code) AS code, min(book_code) AS book_code FROM domains GROUP BY 1) c ON c.code = lower({_STEM('i.item')}) WHERE regexp_matches(i.item, '{_CITED}') GROUP BY 1, 2) r
LEFT JOIN (SELECT {_KEY('citation')} AS key, min(loaded_at) AS arrives, min(repealed_at) AS ends FROM laws_db WHERE regexp_matches(citation, '{_CITED}') GROUP BY 1) s USING (key)"""
P1_FOUND = f"SELECT law_id, ref, kind FROM ({ORPHANS}) WHERE kind IS NOT NULL"
P1_REPORT = f"SELECT 'laws_db' AS table_name, CAST(date_trunc('month', loaded) AS DATE) AS period, kind, count(*) AS n FROM ({ORPHANS}) WHERE kind IS NOT NULL GROUP BY 1, 2, 3"
