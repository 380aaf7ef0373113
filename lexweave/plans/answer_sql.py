"""SQL of the queries on sentences and claims."""

from __future__ import annotations

from collections.abc import Callable

from lexweave.functions import fixed
from lexweave.functions import text as X


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sentences_sql(column: str) -> str:
    """Array of sentences: candidate places as line ends, those behind an abbreviation or an initial taken back."""
    spaced = rf"trim(regexp_replace(coalesce({column}, ''), '\s+', ' ', 'g'))"
    pieces = rf"""string_split(regexp_replace({spaced}, '([.;?!]["''”’)]*\s+)(["“‘(]?[A-Z0-9])', '\1' || chr(10) || '\2', 'g'), chr(10))"""
    last = r"""lower(regexp_extract(rtrim(regexp_extract(p, '([\p{L}\p{N}_''.]*)\.["''”’)]*\s+$', 1), '.'), '[^.]*$'))"""
    goes_on = rf"""(regexp_matches(p, '\.["''”’)]*\s+$') AND (list_contains({listed(fixed.ABBREVIATIONS)}, {last}) OR length({last}) = 1))"""
    joined = f"string_split(array_to_string(list_transform({pieces}, lambda p: CASE WHEN {goes_on} THEN p ELSE p || chr(10) END), ''), chr(10))"
    return f"list_filter(list_transform({joined}, lambda p: trim(p)), lambda p: p <> '')"


def _stem(word: str) -> str:
    """A word's claim stem."""
    restore = {"ied": "y", "ies": "y", "ural": "ure"}
    cases = " ".join(f"WHEN ends_with({word}, '{x}') AND length({word}) >= {len(x) + 4} THEN left({word}, -{len(x)}) || '{restore.get(x, '')}'" for x in fixed.CLAIM_SUFFIXES)
    return rf"CASE WHEN regexp_matches({word}, '[0-9]') OR length({word}) <= 4 THEN {word} ELSE regexp_replace(CASE {cases} ELSE {word} END, '^(.{{4,}})e$', '\1') END"


def _stems(words: str) -> str:
    return f"list_distinct(list_transform({words}, lambda w: {_stem('w')}))"


def _content(words: str) -> str:
    return _stems(f"list_filter({words}, lambda w: NOT list_contains({listed(X.GENERIC)}, w))")


def _denied(words: str) -> str:
    return _content(f"flatten(list_transform(range(1, len({words}) + 1), lambda i: CASE WHEN list_contains({listed(fixed.NEGATORS)}, {words}[i]) THEN {words}[i + 1:i + 4] ELSE [] END))")


def _with_not(text: str) -> str:
    return rf"regexp_replace({text}, 'n[''’]t\b', ' not', 'g')"


def _spoken(text: str) -> str:
    return f"regexp_extract_all({_with_not(f'lower({text})')}, '{fixed.SPOKEN_WORD}')"


def _canonical(text: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(lower({text}), '[“”"‘’''`]', '', 'g'), '[^\p{{L}}\p{{N}}_()]+', ' ', 'g'))"""


def _share(part: str, whole: str) -> str:
    return f"(CASE WHEN len({part}) = 0 THEN 0.0 ELSE len(list_intersect({part}, {whole})) / len({part}) END)"


def _without(terms: str, aside: str) -> str:
    return f"list_filter({terms}, lambda t: NOT list_contains({aside}, t))"


def _behind(words: str) -> str:
    return _content(f"CASE WHEN list_contains({words}, 'without') THEN {words}[list_position({words}, 'without') + 1:list_position({words}, 'without') + 4] ELSE [] END")


def _subjects() -> str:
    """Columns of a claim: its terms but for those that each kind of conflict turns on."""
    pairs = [f"{_without('terms', _stems(listed([w for side in pair for w in side])))} AS about{n}" for n, pair in enumerate(fixed.ANTONYMS)]
    return ", ".join([f"{_without('terms', 'list_append(behind, $$without$$)')} AS about_guard", f"{_without('terms', _stems(listed(fixed.ABSOLUTE)))} AS about_absolute", *pairs])


def _conflict() -> str:
    """Does sentence s contradict claim c?"""
    kinds = [f"list_has_any(c.behind, s.guards) AND {_share('c.about_guard', 's.stems')} >= 0.5"]
    for n, pair in enumerate(fixed.ANTONYMS):
        for own, other in (pair, pair[::-1]):
            kinds.append(f"list_has_any(c.words, {listed(own)}) AND list_has_any(s.words, {listed(other)}) AND NOT list_has_any(s.words, {listed(own)}) AND {_share(f'c.about{n}', 's.stems')} >= 0.5")
    limits = " OR ".join(f"contains(s.low, '{q}')" for q in fixed.QUALIFIERS)
    kinds.append(f"list_has_any(c.words, {listed(fixed.ABSOLUTE)}) AND ({limits}) AND {_share('c.about_absolute', 's.stems')} >= 0.5")
    kinds.append(f"NOT list_has_any(s.words, {listed([*fixed.NEGATORS, 'without'])}) AND list_has_any(c.denies, s.stems) AND {_share('c.terms', 's.stems')} >= 0.5")
    return " OR ".join(f"({k})" for k in kinds)


def claim_support_sql(index: str, hits: str, tokens: Callable[[str], str]) -> str:
    """Of variants of the passages, without quotations: what the three best documents say."""
    capital = rf"regexp_matches({{w}}, '^\p{{Lu}}') AND NOT list_contains({listed(fixed.GENERIC_CAPITALIZED)}, {{low}})"
    named = capital.replace("{w}", "w[i]").replace("{low}", "trim(lower(w[i]), '’''')")
    led = capital.replace("{w}", "coalesce(w[i + 1], '')").replace("{low}", "lower(w[i + 1])")
    guard = tokens(f"regexp_extract(lower(sentence), '{fixed.GUARD}', 1)")
    giving = "CASE WHEN any_giving THEN share >= 0.3 ELSE place = 1 END"
    return rf"""WITH {index}, {hits},
cited AS (SELECT h.query_id, h.rank, d.doc_id, coalesce(d.text, '') AS text FROM hits h JOIN documents d ON d.doc_id = h.row),
base AS (SELECT item_id, text AS a, array_to_string(list_concat(string_split(text, ' ')[2:], string_split(text, ' ')[1:1]), ' ') AS b FROM benchmark WHERE item_id IN (SELECT query_id FROM hits)),
said AS (SELECT item_id, 'a' AS kind, a AS claim FROM base UNION ALL SELECT item_id, 'b', b FROM base UNION ALL SELECT item_id, 'c', 'never ' || b FROM base UNION ALL SELECT item_id, 'd', b || ' by Qqzz' FROM base UNION ALL SELECT item_id, 'e', a FROM base),
spoken AS (SELECT *, {_spoken('claim')} AS words, {tokens(_with_not('claim'))} AS ts, {tokens('claim')} AS plain, {_canonical('claim')} AS canonical, {sentences_sql('claim')} AS sentences FROM said),
termed AS MATERIALIZED (SELECT item_id, kind, words, canonical, {_content('ts')} AS terms, {_behind('words')} AS behind, {_denied('words')} AS denies, list_filter(list_distinct(plain), lambda t: regexp_matches(t, '[0-9]') AND NOT contains(t, '(')) AS numbers, sentences FROM spoken),
c AS MATERIALIZED (SELECT *, {_subjects()} FROM termed),
pieces AS (SELECT item_id, kind, regexp_extract_all(sentence, '[A-Za-z][\p{{L}}\p{{N}}_’''-]*') AS w FROM (SELECT item_id, kind, unnest(sentences) AS sentence FROM c)),
name_places AS (SELECT item_id, kind, w, unnest(list_filter(range(1, len(w) + 1), lambda i: {named} AND length(w[i]) > 2 AND (i > 1 OR ({led})))) AS i FROM pieces),
names AS (SELECT item_id, kind, w[i] AS name FROM name_places UNION SELECT item_id, kind, unnest(numbers) FROM c),
texts AS (SELECT DISTINCT doc_id, text FROM cited), items AS MATERIALIZED (SELECT doc_id, text, {_canonical('text')} AS canonical, {_stems(tokens('text'))} AS stems FROM texts),
split AS (SELECT doc_id, unnest({sentences_sql('text')}) AS sentence FROM texts),
heard AS MATERIALIZED (SELECT doc_id, sentence, {_spoken('sentence')} AS words, {tokens('sentence')} AS ts FROM split),
s AS MATERIALIZED (SELECT doc_id, lower(sentence) AS low, words, {_denied('words')} AS denies, {_stems('ts')} AS stems, {_stems(guard)} AS guards FROM heard),
judged AS (SELECT c.item_id, c.kind, bool_or({_conflict()}) AS conflict, bool_or(list_has_any(c.denies, s.denies) AND {_share('c.terms', 's.stems')} >= 0.5) AS confirmed
  FROM c JOIN cited h ON h.query_id = c.item_id JOIN s ON s.doc_id = h.doc_id GROUP BY 1, 2),
shares AS (SELECT c.item_id, c.kind, h.rank, i.stems, {_share('c.terms', 'i.stems')} AS share, len(string_split(c.canonical, ' ')) >= 4 AND contains(i.canonical, c.canonical) AS verbatim, i.text FROM c JOIN cited h ON h.query_id = c.item_id JOIN items i ON i.doc_id = h.doc_id),
most AS (SELECT *, bool_or(share >= 0.3) OVER (PARTITION BY item_id, kind) AS any_giving, row_number() OVER (PARTITION BY item_id, kind ORDER BY share DESC, rank) AS place FROM shares),
gathered AS (SELECT item_id, kind, min(rank) FILTER (verbatim) AS exact, bool_and(trim(text) = '') AS blank, flatten(list(stems)) AS known, flatten(list(stems) FILTER ({giving})) AS held, string_agg('E' || rank, ',' ORDER BY rank) FILTER ({giving}) AS giving FROM most GROUP BY 1, 2),
strange AS (SELECT n.item_id, n.kind, bool_or(NOT list_has_all(g.known, {_stems(tokens('n.name'))})) AS stranger FROM names n JOIN gathered g ON g.item_id = n.item_id AND g.kind = n.kind GROUP BY 1, 2),
measured AS (SELECT c.item_id, c.kind, g.exact, g.giving, {_share('c.terms', 'g.held')} AS share, g.blank, c.terms, c.denies, x.stranger, j.conflict, j.confirmed
  FROM c JOIN gathered g ON g.item_id = c.item_id AND g.kind = c.kind LEFT JOIN judged j ON j.item_id = c.item_id AND j.kind = c.kind LEFT JOIN strange x ON x.item_id = c.item_id AND x.kind = c.kind),
ruled AS (SELECT *, CASE WHEN kind = 'e' THEN 'unknown' WHEN blank THEN 'blank' WHEN exact IS NOT NULL THEN 'verbatim' WHEN len(terms) < 2 THEN 'thin' WHEN stranger THEN 'stranger' WHEN conflict THEN 'conflict'
  WHEN len(denies) > 0 AND NOT coalesce(confirmed, false) THEN 'unconfirmed' WHEN share >= 0.75 THEN 'covered' ELSE 'uncovered' END AS rule FROM measured)
SELECT item_id || '.' || kind AS claim_id, CASE WHEN rule IN ('verbatim', 'covered') THEN 'supported' WHEN rule = 'conflict' THEN 'contradicted' ELSE 'insufficient' END AS status,
  CASE WHEN rule = 'verbatim' THEN 1.0 WHEN rule IN ('covered', 'uncovered') THEN round(share, 4) ELSE 0.0 END::DOUBLE AS score, CASE WHEN rule = 'verbatim' THEN 1.0 WHEN rule IN ('covered', 'uncovered') THEN round(share, 4) END::DOUBLE AS coverage,
  rule, CASE WHEN rule = 'verbatim' THEN 'E' || exact WHEN rule IN ('covered', 'uncovered') THEN giving ELSE '' END AS supporting FROM ruled"""
