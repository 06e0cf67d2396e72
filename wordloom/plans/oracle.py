"""DuckDB SQL of analysis and segmentation, with the lexicon and rule tables inlined."""

from __future__ import annotations

from wordloom.functions import orthography as o
from wordloom.functions import rules as r
from wordloom.operators.segment import LABELS

from . import tables as t
from .tables import CLOSED, STEMS

FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (list, tuple)):
        return f"[{', '.join(map(lit, x))}]::VARCHAR[]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values(rows: list[tuple], cols: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, row)) + ')' for row in rows)}) AS t({cols})"


def implied(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '([szxo]|ch|sh)$') THEN 'SIBILANT' WHEN regexp_matches({x}, '.[^aeio]e$') THEN 'SILENT_E' WHEN regexp_matches({x}, '[^aeiou]y$') THEN 'Y_FINAL' ELSE 'REG' END)"


def doubled(x: str) -> str:
    return f"(length({x}) >= 2 AND {x}[-1:] = {x}[-2:-2])"


KINDS = sorted({(x[0], x[1]) for x in r.INFLECTION} | {(0, "")})
OUTS = sorted({(x[0], x[1]) for x in r.OUTER} | {(0, "")})

_MADE = [x[0] for x in r.DERIVATION]
#: What is built around a mined lexeme: what stands before it and after it.
AROUND = [("", x) for x in [*_MADE, *t.BUILT_ENDINGS, *(a + _MADE[(i + t.SECOND) % len(_MADE)] for i, a in enumerate(_MADE)), *(x + "s" for x in _MADE), "t", "en"]] + [(p, x) for p, _ in r.PREFIXES for x in ("", "s", "t", "ness")]

#: The lexemes that words of a table give by rule, from counts(item).
MINED = f"""
mst AS (SELECT DISTINCT item AS stem, md5(item) AS h FROM counts WHERE regexp_matches(item, '{t.MINED_WORD}')),
ms AS (SELECT *, {t.MINED_POS} AS pos FROM mst WHERE {t.MINED}),
mined AS (SELECT ('0x' || substr(h, 6, 11))::BIGINT + 1000 AS lex_id, stem, pos, CASE WHEN substr(h, 3, 1) = '0' THEN 'UNKNOWN' WHEN substr(h, 3, 1) = '1' AND pos = 'V' THEN 'IRR_SING' WHEN pos = 'ADV' THEN 'REG'
  WHEN pos IN ('V', 'ADJ') AND regexp_matches(stem, '[^aeiou][aeiou][^aeiouywx]$') AND substr(h, 3, 1) < '8' THEN 'DOUBLE_CONS' ELSE {implied('stem')} END AS sc, ({t.MINED_WEIGHT})::DOUBLE AS w, {t.MINED_KNOWN} AS known,
  CASE WHEN {t.MINED_STORED} AND pos = 'V' THEN '+PAST' WHEN {t.MINED_STORED} AND pos = 'N' THEN '+PL' END AS tag, {t.BUILT} AS built, {t.LEVEL} AS level FROM ms),
made AS (SELECT a.before || stem || a.after AS word FROM mined, ({values(AROUND, 'before, after')}) a WHERE built),
words AS (SELECT item AS word FROM counts UNION SELECT word FROM made UNION SELECT upper(word) FROM made WHERE substr(md5(word), 1, 1) = '0'),
"""

#: CTEs of the lexicon and the rule tables.
TABLES = f"""
lex0 AS ({values([(i, s, p, c, 1.0 if w is None else w, w is not None) for i, (s, p, c, w, _) in enumerate(STEMS)], 'lex_id, stem, pos, sc, w, known')}@LEX@),
lex AS (SELECT lex_id::BIGINT AS lex_id, stem, pos, sc, w::FLOAT AS weight, known, CASE WHEN sc LIKE 'IRR_%' THEN {implied('stem')} ELSE sc END AS eff,
  CASE WHEN sc LIKE 'IRR_%' OR sc = 'UNKNOWN' THEN {implied('stem')} ELSE sc END AS dcl,
  NOT (sc LIKE 'IRR_%' AND regexp_matches(stem, '[^aeiou][aeiou][^aeiouywx]$')) AS dknown FROM lex0),
irr AS ({values([(i, t, f) for i, x in enumerate(STEMS) for t, f in x[4].items()], 'lex_id, tag, form')}@IRR@),
closed AS ({values([(w,) for w in CLOSED], 'word')}),
deriv AS ({values([(s, src, d, c, y, m, 'FREQ' in z, 'NOT_CL' in z, i) for i, (s, src, d, c, y, m, z) in enumerate(r.DERIVATION)], 'suffix, sources, derived, classes, yrest, min_stem, freq, notcl, rule_ord')}),
pref AS ({values([(p, a, i) for i, (p, a) in enumerate(r.PREFIXES)], 'prefix, attaches, prefix_ord')}),
infl AS ({values([(*x, i) for i, x in enumerate(r.INFLECTION)], 'kind, tail, pos, classes, tag, guard, tag_ord')}),
outr AS ({values([(*x, i) for i, x in enumerate(r.OUTER)], 'alternation, tail, pos, classes, tag, tag_ord')}),
kinds AS ({values(KINDS, 'kind, tail')}),
outs AS ({values(OUTS, 'alternation, tail')})"""
#: The fixed cases alone, and with the mined lexemes.
SMALL = TABLES.replace("@LEX@", "").replace("@IRR@", "")
LARGE = TABLES.replace("@LEX@", " UNION ALL SELECT lex_id, stem, pos, sc, w, known FROM mined").replace("@IRR@", " UNION ALL SELECT lex_id, tag, stem || CASE tag WHEN '+PAST' THEN 't' ELSE 'en' END FROM mined WHERE tag IS NOT NULL")


def _stripped(name: str, forms: str) -> str:
    base = "form[:length(form) - length(suffix)]"
    return f"""
{name}0 AS (SELECT f.form, d.*, {base} AS base FROM {forms} f JOIN deriv d ON suffix(f.form, d.suffix) AND length(f.form) > length(d.suffix)
  WHERE NOT (d.notcl AND f.form IN (SELECT word FROM closed))),
{name} AS (SELECT * FROM (
  SELECT *, 0 AS cand_ord, '' AS required, base AS cand FROM {name}0
  UNION ALL SELECT *, 1, 'Y_FINAL', base[:-2] || 'y' FROM {name}0 WHERE yrest AND base[-1:] = 'i'
  UNION ALL SELECT *, 2, 'SILENT_E', base || 'e' FROM {name}0 WHERE suffix[1] IN ('a','e','i','o','u') OR form IN ({', '.join(map(lit, o.E_DELETION))})
  UNION ALL SELECT *, 3, 'DOUBLE_CONS', base[:-2] FROM {name}0 WHERE suffix[1] IN ('a','e','i','o','u') AND {doubled('base')}))"""


def _rooted(name: str, cands: str) -> str:
    return f"""
{name} AS (SELECT c.form, l.stem, l.pos, ['-' || c.suffix] AS deriv, c.derived AS derived_pos, (l.weight * 0.9::FLOAT)::FLOAT AS weight, [c.rule_ord, c.cand_ord, 0, l.lex_id]::BIGINT[] AS inner_ord
  FROM {cands} c JOIN lex l ON c.cand = l.stem
  LEFT JOIN (SELECT stem AS form, max(weight) AS whole FROM lex WHERE known GROUP BY stem) k ON k.form = c.form
  WHERE list_contains(c.sources, l.pos) AND (len(c.classes) = 0 OR list_contains(c.classes, l.sc)) AND length(l.stem) >= c.min_stem
    AND CASE c.required WHEN 'Y_FINAL' THEN regexp_matches(c.cand, '[^aeiou]y$') OR l.sc = 'Y_FINAL' WHEN 'SILENT_E' THEN regexp_matches(c.cand, '.[^aeio]e$') OR l.dcl = 'SILENT_E'
      WHEN 'DOUBLE_CONS' THEN l.sc = 'DOUBLE_CONS' ELSE TRUE END
    AND (NOT c.freq OR NOT l.known OR k.whole IS NULL OR l.weight >= k.whole))"""


#: From words(word) to analyses(word, stem, pos, features, weight, prefix, deriv, derived_pos, emit, rank).
ANALYSES = f"""
lw AS (SELECT DISTINCT translate(word, {FOLD}) AS word FROM words),
reads AS (SELECT word, word AS key, '' AS prefix, -1 AS prefix_ord FROM lw
  UNION ALL SELECT word, word[length(prefix) + 1:], prefix, prefix_ord FROM lw JOIN pref ON starts_with(word, prefix) WHERE length(word) >= length(prefix) + 2 AND regexp_matches(word, '^[a-z]+$')),
every AS (SELECT DISTINCT key AS word FROM reads),
low AS (SELECT word FROM every WHERE regexp_matches(word, '^[a-z]+$')),
heads AS (SELECT word, kind, tail, word[:length(word) - length(tail)] AS head FROM low JOIN kinds ON suffix(word, tail) AND length(word) > length(tail)),
ends AS (SELECT word, kind, tail, CASE kind WHEN 0 THEN head WHEN 1 THEN head[:-2] || 'y' WHEN 2 THEN head[:-2] ELSE head || 'e' END AS cand FROM heads
  WHERE kind IN (0, 3) OR (kind = 1 AND head[-1:] = 'i') OR (kind = 2 AND {doubled('head')})),
hits AS (SELECT e.*, l.* FROM ends e JOIN lex l ON e.cand = l.stem),
inflected AS (
  SELECT word, stem, pos, []::VARCHAR[] AS features, weight, []::VARCHAR[] AS deriv, '' AS derived_pos, [1, length(word), 0, lex_id, 0]::BIGINT[] AS emit FROM hits WHERE kind = 0 AND tail = ''
  UNION ALL SELECT h.word, h.stem, h.pos, [i.tag], h.weight, []::VARCHAR[], '', [1, length(h.word) - length(h.tail), h.kind, h.lex_id, i.tag_ord]::BIGINT[]
  FROM hits h JOIN infl i ON h.kind = i.kind AND h.tail = i.tail AND h.pos = i.pos
  WHERE list_contains(i.classes, h.eff) AND (i.guard = '' OR (i.guard = 'takes_es' AND (regexp_matches(h.stem, '([szxo]|ch|sh)$') OR h.eff = 'SIBILANT')) OR (i.guard = 'doubling_known' AND h.dknown))
    AND ((h.kind = 0 AND h.pos = 'N') OR NOT EXISTS (SELECT 1 FROM irr WHERE irr.lex_id = h.lex_id AND irr.tag = i.tag))),
oheads AS (SELECT word, alternation, tail, word[:length(word) - length(tail)] AS head FROM low JOIN outs ON suffix(word, tail) AND length(word) > length(tail) + 1),
surfaces AS (SELECT word, alternation, tail, CASE alternation WHEN 0 THEN head WHEN 1 THEN head[:-2] || 'y' ELSE head || 'e' END AS form FROM oheads
  WHERE alternation = 0 OR (alternation = 1 AND head[-1:] = 'i' AND regexp_matches(head[:-2] || 'y', '[^aeiou]y$')) OR (alternation = 3 AND regexp_matches(head || 'e', '.[^aeio]e$'))),
f1 AS (SELECT DISTINCT form FROM surfaces),{_stripped('s1', 'f1')},
above AS (SELECT * FROM s1 WHERE required <> 'DOUBLE_CONS' AND length(suffix) >= 2 AND length(cand) >= min_stem AND (required = '' OR {implied('cand')} = required)),
f2 AS (SELECT DISTINCT cand AS form FROM above),{_stripped('s2', 'f2')},{_rooted('r1', 's1')},{_rooted('r2', 's2')},
bases AS (SELECT * FROM r1 UNION ALL
  SELECT a.form, r2.stem, r2.pos, list_concat(r2.deriv, ['-' || a.suffix]), a.derived, (r2.weight * 0.9::FLOAT)::FLOAT, list_concat([a.rule_ord, a.cand_ord, 1]::BIGINT[], r2.inner_ord)
  FROM above a JOIN r2 ON a.cand = r2.form WHERE list_contains(a.sources, r2.derived_pos) AND length(r2.stem) >= 4 AND length(r2.deriv[1]) > 2),
dfound AS (SELECT s.word, s.alternation, s.tail, b.* FROM surfaces s JOIN bases b ON s.form = b.form),
derived AS (
  SELECT word, stem, pos, []::VARCHAR[] AS features, weight, deriv, derived_pos, list_concat([2, 0, alternation]::BIGINT[], list_concat(inner_ord, [0]::BIGINT[])) AS emit FROM dfound WHERE tail = ''
  UNION ALL SELECT d.word, d.stem, d.pos, [u.tag], d.weight, d.deriv, d.derived_pos, list_concat([2, length(d.tail), d.alternation]::BIGINT[], list_concat(d.inner_ord, [u.tag_ord]::BIGINT[]))
  FROM dfound d JOIN outr u ON d.alternation = u.alternation AND d.tail = u.tail AND d.derived_pos = u.pos WHERE list_contains(u.classes, {implied('d.form')})),
stored AS (SELECT e.word, l.stem, l.pos, [i.tag] AS features, l.weight, []::VARCHAR[] AS deriv, '' AS derived_pos, [0, l.lex_id, list_position({lit(list(o.FEATURES.values()))}, i.tag)]::BIGINT[] AS emit
  FROM every e JOIN irr i ON e.word = i.form JOIN lex l ON l.lex_id = i.lex_id),
found AS (SELECT word AS key, stem, pos, deriv, features, max(weight) AS weight, min(emit) AS emit, arg_min(derived_pos, emit) AS derived_pos
  FROM (SELECT * FROM inflected UNION ALL SELECT * FROM derived UNION ALL SELECT * FROM stored) GROUP BY ALL),
merged AS (SELECT r.word, f.stem, f.pos, f.features, f.weight, r.prefix, f.deriv, f.derived_pos, CASE WHEN r.prefix = '' THEN f.emit ELSE list_concat([3, r.prefix_ord, trunc(-f.weight::DOUBLE * 1e6)::BIGINT]::BIGINT[], f.emit) END AS emit
  FROM found f JOIN reads r ON f.key = r.key WHERE r.prefix = '' OR f.pos <> 'FUNC'),
analyses AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY weight DESC, emit, stem, pos) AS rank FROM merged)"""


def lcp(a: str, b: str) -> str:
    return f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: {a}[:i] = {b}[:i]))"


def _cut(rest: str, suf: str, may_skip: bool) -> str:
    if not may_skip:
        return f"(CASE WHEN {suf} IS NULL THEN 0 ELSE {lcp(rest, suf)} END)"
    skip = f"(CASE WHEN {rest}[1] <> {suf}[1] AND length({rest}) > 1 AND {rest}[2:2] = {suf}[1] THEN 1 ELSE 0 END)"
    return f"(CASE WHEN {suf} IS NULL THEN 0 WHEN {skip} = 1 THEN 1 + {lcp(rest + '[2:]', suf)} ELSE {lcp(rest, suf)} END)"


_LABEL = "CASE " + " ".join(f"WHEN list_contains(features, '{t}') THEN '{n}'" for t, n in LABELS) + " WHEN len(features) = 0 THEN 'SUFFIX_DERIV' ELSE 'SUFFIX_INFL' END"


#: The heaviest lexeme's weight, and whether it is known; of equals the first.
_TOP = "arg_max(l.weight, [l.weight::DOUBLE, -l.lex_id]) AS w, arg_max(l.known, [l.weight::DOUBLE, -l.lex_id]) AS k"


#: From analyses, and words(word) as they are written, to segs(word, rank, ...).
SEGMENTS = f"""
facts AS (SELECT l.stem, {_TOP}, bool_or(l.sc = 'SIBILANT') AS sib, bool_or(l.pos = 'FUNC') AS func, bool_or(l.pos = 'V') AS verb FROM lex l GROUP BY l.stem),
fpos AS (SELECT l.stem, l.pos, {_TOP} FROM lex l GROUP BY l.stem, l.pos),
att AS (SELECT prefix, unnest(attaches) AS pos FROM pref),
index AS (SELECT DISTINCT irr.form, lex.stem, irr.tag FROM irr JOIN lex USING (lex_id)),
kept AS (SELECT DISTINCT form FROM irr),
raw AS (SELECT DISTINCT word, translate(word, {FOLD}) AS lower FROM words),
a0 AS (SELECT r.word, r.lower, a.* EXCLUDE (word, rank, emit), length(a.prefix) AS p, r.lower[length(a.prefix) + 1:] AS region,
    len(a.features) = 1 AND x.tag IS NOT NULL AS is_irr, coalesce(f.sib, FALSE) AS sib
  FROM raw r JOIN analyses a ON r.lower = a.word LEFT JOIN index x ON x.form = r.lower AND x.stem = a.stem AND x.tag = a.features[1] LEFT JOIN facts f ON f.stem = a.stem WHERE regexp_matches(r.word, '[A-Za-z]')),
a1 AS (SELECT *, {lcp('region', 'stem')} AS lcp FROM a0),
a2 AS (SELECT *, is_irr OR lcp = 0 AS whole, word[p + lcp + 1:] AS tail, deriv[1][2:] AS suf1, deriv[2][2:] AS suf2 FROM a1),
a3 AS (SELECT *, {_cut('tail', 'suf1', True)} AS m1a FROM a2),
a4 AS (SELECT *, CASE WHEN suf1 IS NOT NULL AND m1a = 1 AND tail[1] <> suf1[1] THEN 0 ELSE m1a END AS m1 FROM a3),
a5 AS (SELECT *, tail[m1 + 1:] AS rest FROM a4),
a6 AS (SELECT *, CASE WHEN m1 > 0 AND rest <> '' THEN {_cut('rest', 'suf2', False)} ELSE 0 END AS m2 FROM a5),
a7 AS (SELECT *, CASE WHEN whole THEN [(word, 'IRREGULAR')] ELSE list_filter([(word[:p], 'PREFIX'), (word[p + 1:p + lcp], 'STEM'), (tail[:m1], 'SUFFIX_DERIV'), (rest[:m2], 'SUFFIX_DERIV'), (rest[m2 + 1:], {_LABEL})], lambda x: x[1] <> '') END AS parts FROM a6),
a8 AS (SELECT *, list_transform(parts, lambda x: x[1]) AS pieces, list_transform(parts, lambda x: x[2]) AS labels,
  CASE WHEN whole OR lcp >= length(region) THEN '' WHEN lcp < length(stem) AND stem[lcp + 1:lcp + 1] = 'y' AND region[lcp + 1:lcp + 1] = 'i' THEN 'y_to_i'
    WHEN lcp + 1 = length(stem) AND stem[lcp + 1:lcp + 1] = 'e' THEN 'e_deletion'
    WHEN lcp = length(stem) AND region[lcp + 1:lcp + 1] = stem[lcp:lcp] AND region[lcp + 1:lcp + 1] NOT IN ('a','e','i','o','u') THEN 'consonant_doubling'
    WHEN lcp = length(stem) AND region[lcp + 1:lcp + 2] = 'es' AND (regexp_matches(stem, '([szxj]|ch|sh)$') OR sib) THEN 'epenthesis' ELSE '' END AS alt,
  CASE WHEN whole THEN 'irregular' WHEN len(parts) >= 2 THEN 'decomposed' ELSE 'lexicon_stem' END AS gate,
  CASE WHEN prefix <> '' THEN lower[p + 1:] END AS base FROM a7),
direct AS (SELECT d.base, d.prefix, {_TOP} FROM (SELECT DISTINCT base, prefix FROM a8 WHERE prefix <> '') d JOIN lex l ON l.stem = d.base JOIN att ON att.prefix = d.prefix AND att.pos = l.pos GROUP BY d.base, d.prefix),
through AS (SELECT DISTINCT d.stem, d.prefix FROM (SELECT DISTINCT stem, prefix FROM a8 WHERE prefix <> '') d JOIN lex l ON l.stem = d.stem JOIN att ON att.prefix = d.prefix AND att.pos = l.pos),
a9 AS (SELECT a8.*, wf.w AS whole_w, d.w AS dir_w, d.k AS dir_k, t.stem IS NOT NULL AS thr, jf.w AS joint_w, jf.k AS joint_k, own.w AS own_w, own.k AS own_k,
  coalesce(bf.func, FALSE) AS base_func, coalesce(wf.func, FALSE) AS whole_func, coalesce(wf.verb, FALSE) AS whole_verb, wc.word IS NOT NULL AS whole_closed, bc.word IS NOT NULL AS base_closed, wk.form IS NOT NULL AS whole_stored, bk.form IS NOT NULL AS base_stored
  FROM a8 LEFT JOIN facts wf ON wf.stem = a8.lower LEFT JOIN facts bf ON bf.stem = a8.base LEFT JOIN facts jf ON a8.prefix <> '' AND jf.stem = a8.prefix || a8.stem LEFT JOIN fpos own ON own.stem = a8.stem AND own.pos = a8.pos
  LEFT JOIN direct d ON d.base = a8.base AND d.prefix = a8.prefix LEFT JOIN through t ON t.stem = a8.stem AND t.prefix = a8.prefix
  LEFT JOIN closed wc ON wc.word = a8.lower LEFT JOIN closed bc ON bc.word = a8.base LEFT JOIN kept wk ON wk.form = a8.lower LEFT JOIN kept bk ON bk.form = a8.base),
b0 AS (SELECT *, CASE WHEN dir_w IS NOT NULL THEN dir_w WHEN stem <> base AND thr THEN joint_w END AS att_w, CASE WHEN dir_w IS NOT NULL THEN dir_k WHEN stem <> base AND thr THEN joint_k END AS att_k,
  list_transform(list_filter(parts, lambda x: x[2] <> 'STEM'), lambda x: length(x[1])) AS affixes, list_position(labels, 'STEM') AS stem_at, list_transform(parts, lambda x: length(x[1])) AS lens FROM a9),
b1 AS (SELECT *, gate = 'decomposed' AND (NOT (prefix = '' OR (length(base) >= 3 AND NOT base_closed AND NOT base_func AND att_w IS NOT NULL AND NOT (att_k AND coalesce(whole_w > att_w - 0.01875::FLOAT, FALSE))))
    OR (list_contains(features, '+PL') AND length(stem) < 3)) AS demoted,
  list_min(CASE WHEN alt IN ('y_to_i', 'consonant_doubling', 'epenthesis') THEN list_concat(list_transform(lens[:coalesce(stem_at, 1) - 1], lambda x: x), list_transform(range(coalesce(stem_at, 0) + 1, len(lens) + 1),
    lambda i: CASE WHEN lens[i] > 1 AND len(list_filter(lens[stem_at + 1:i - 1], lambda y: y > 1)) = 0 THEN lens[i] - 1 ELSE lens[i] END)) ELSE affixes END) AS affix FROM b0),
b2 AS (SELECT *, NOT demoted AND gate = 'decomposed' AND NOT whole_closed AND pos <> 'FUNC' AND NOT whole_func AND length(stem) >= 3 AND own_w IS NOT NULL
  AND NOT (affix <= 2 AND own_k AND coalesce(whole_w > own_w, FALSE)) AND NOT whole_stored AND NOT base_stored
  AND NOT (alt = 'consonant_doubling' AND len(deriv) > 0 AND derived_pos <> 'V' AND whole_verb) AS promotable, count(*) OVER (PARTITION BY word) AS n_analyses FROM b1)"""

#: From b2 to @N@segs, by one of the orders.
RANKED = """
@N@b3 AS (SELECT *, row_number() OVER (PARTITION BY word, stem, gate, alt, pieces, labels ORDER BY @PROMOTED@ demoted, weight DESC) AS copy FROM b2),
@N@b4 AS (SELECT word, pieces, labels, stem AS lemma, alt, 'fst' AS source, gate, n_analyses, weight, demoted, promotable, 1 AS first FROM @N@b3 WHERE copy = 1),
@N@b5 AS (SELECT * FROM @N@b4 UNION ALL SELECT word, [word], ['UNK'], '', '', 'fallback', 'no_analysis', n_analyses, 0.0::FLOAT, FALSE, FALSE, 0 FROM @N@b4
  WHERE length(word) <= 6 AND NOT regexp_matches(word, '[a-z]') AND regexp_matches(word, '[A-Z]') GROUP BY word, n_analyses HAVING bool_and(demoted)),
@N@segs AS (SELECT * EXCLUDE (first), row_number() OVER (PARTITION BY word ORDER BY first, @PROMOTED@ demoted, weight DESC, len(pieces) DESC, lemma, labels, gate, alt) AS rank FROM @N@b5
  UNION ALL SELECT word, CASE WHEN word = '' THEN [] ELSE [word] END, CASE WHEN word = '' THEN [] ELSE ['UNK'] END, '', '', CASE WHEN regexp_matches(word, '[A-Za-z]') THEN 'fallback' ELSE 'passthrough' END,
    CASE WHEN regexp_matches(word, '[A-Za-z]') THEN 'no_analysis' ELSE 'passthrough' END, 0, 0.0::FLOAT, FALSE, FALSE, 1 FROM raw WHERE word NOT IN (SELECT word FROM a0))"""

PROMOTED = "NOT (len(pieces) > 1 AND promotable),"
#: Word units of a table, counted.
UNITS = r"[\p{L}\p{Nl}\p{No}]+|\p{Nd}+|[^\s\p{L}\p{N}]+"


def counted(name: str = "documents") -> str:
    return rf"""units AS (SELECT unnest(regexp_extract_all(text, '{UNITS}')) AS item FROM {name}),
counts AS (SELECT item, count(*) AS cnt FROM units WHERE regexp_matches(item, '^[\p{{L}}\p{{Nl}}\p{{No}}]+$') GROUP BY item)"""


def analysis(select: str, more: str = "") -> str:
    """Over query_words and the mined lexicon."""
    return f"WITH {counted()}, {MINED}{LARGE}, {ANALYSES}{more} {select}"


def at_level(n: int, select: str, more: str = "") -> str:
    """segmentation() with the n-th of the nested lexicons."""
    large = LARGE.replace("known FROM mined", f"known FROM mined WHERE level <= {n}").replace("FROM mined WHERE tag IS NOT NULL", f"FROM mined WHERE tag IS NOT NULL AND level <= {n}")
    words = MINED.replace("words AS (", "unused AS (") + "words AS (SELECT item AS word FROM counts),"
    return f"WITH {counted()}, {words}{large}, {ANALYSES}, {segments(False)}{more} {select}"


def ranked(derived_first: bool, name: str = "") -> str:
    return RANKED.replace("@PROMOTED@", PROMOTED if derived_first else "").replace("@N@", name)


def segments(derived_first: bool) -> str:
    return f"{SEGMENTS}, {ranked(derived_first)}"


def segmentation(select: str, derived_first: bool = False, more: str = "") -> str:
    """Over query_words and the mined lexicon."""
    return f"WITH {counted()}, {MINED}{LARGE}, {ANALYSES}, {segments(derived_first)}{more} {select}"
