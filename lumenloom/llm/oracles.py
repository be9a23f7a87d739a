"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from lumenloom.llm import rule_ledger

_WORD = r"[^\x20\x09-\x0D]"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
e AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o || ' ' || lead(word, 5) OVER o || ' ' || lead(word, 6) OVER o || ' ' || lead(word, 7) OVER o AS win
      FROM e WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY r, win) > 1 THEN 1 ELSE 0 END AS again FROM k),
v AS (SELECT r, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM c),
n AS (SELECT r, sum(covered)::BIGINT AS n_repeat_words FROM v GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n.n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN n ON w.r = n.r),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {x.fails} THEN {1 << k} ELSE 0 END" for k, x in enumerate(rule_ledger.RULES))})::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, (failures & {rule_ledger.mask(rule_ledger.POLICIES[rule_ledger.PRODUCTION])}) = 0 AS kept, failures FROM f
"""

_CELLS = ", ".join(f"('{p}', '{r}', {rule_ledger.mask(names)}, {rule_ledger.mask([r])})" for p, names in rule_ledger.POLICIES.items() for r in names)
_LEDGER = OP2[: OP2.rindex("SELECT doc_id")]

ABLATIONS = f"""{_LEDGER}
, cells AS (SELECT * FROM (VALUES {_CELLS}) AS t(policy, rule, whole, bit))
SELECT policy, rule, count(f.failures) AS documents, count(*) FILTER (f.failures & whole = 0) AS kept, count(*) FILTER (f.failures & bit <> 0) AS failed,
       count(*) FILTER (f.failures & whole = bit) AS failed_alone, coalesce(bool_or(f.failures & bit <> 0), FALSE) AS ever_failed
FROM cells LEFT JOIN f ON TRUE GROUP BY policy, rule
"""

_MIX = rf"""
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM {{table}}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS most, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k, most / weight AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN ratio > level THEN weight * first_value(level) OVER (ORDER BY CASE WHEN ratio > level THEN 0 ELSE 1 END, k) ELSE most END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS size FROM d GROUP BY source, h),
c AS (SELECT source, h, size, sum(size) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM g),
b AS (SELECT c.source, p.target - p.whole * p.source_size AS budget, c.h, c.upto, c.size FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source),
x AS (SELECT source, h AS edge, upto - budget < budget - (upto - size) AS takes FROM b WHERE upto >= budget QUALIFY row_number() OVER (PARTITION BY source ORDER BY h) = 1),
y AS (SELECT d.*, p.source_size, p.target, least(3, p.whole + CASE WHEN d.h < x.edge OR (d.h = x.edge AND x.takes) THEN 1 ELSE 0 END)::BIGINT AS copies
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN x ON d.source IS NOT DISTINCT FROM x.source)"""

OP6 = f"WITH {_MIX.format(table='documents')}\nSELECT doc_id, size, source_size, target, size * copies AS taken FROM y"

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT r, doc_id, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d WHERE text IS NOT NULL),
n AS (SELECT *, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS form, len(regexp_extract_all(line, '{_WORD}+')) >= 4 AND doc_id IS NOT NULL AS counts FROM e),
b AS (SELECT form, min(doc_id) AS keeper FROM n WHERE counts GROUP BY form HAVING count(DISTINCT source) >= 5),
m AS (SELECT n.r, n.pos, n.line, coalesce(n.counts AND b.form IS NOT NULL AND n.doc_id > b.keeper, FALSE) AS gone FROM n LEFT JOIN b ON n.counts AND n.form = b.form),
k AS (SELECT r, string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos) AS kept, count(*)::BIGINT AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_removed FROM m GROUP BY r)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed FROM d LEFT JOIN k ON d.r = k.r
"""


OP12 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
s AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
g AS MATERIALIZED (SELECT lang, list_slice(ws, i, i + m - 1) AS ph, m, count(*) AS f FROM o, range(1, 6) t(m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100),
k AS (SELECT lang, ph, m, f AS a, unnest(range(1, m)) AS k FROM g WHERE m > 1),
c AS (SELECT k.lang, k.ph, k.a, k.k, x.f AS l, y.f AS r, s.n, (1000::HUGEINT * k.a * s.n) // (x.f::HUGEINT * y.f) AS score
      FROM k JOIN g x ON x.lang = k.lang AND x.ph = list_slice(k.ph, 1, k.k) JOIN g y ON y.lang = k.lang AND y.ph = list_slice(k.ph, k.k + 1, k.m) JOIN s ON s.lang = k.lang),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
d AS (SELECT DISTINCT b.lang, b.ph FROM b JOIN (SELECT lang, list_slice(ph, i, i + z - 1) AS ph, f FROM g, range(1, 6) t(i), range(2, 6) u(z) WHERE z < m AND i + z - 1 <= m) q ON q.lang = b.lang AND q.ph = b.ph WHERE 100 * q.f >= 100 * b.a),
e AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, a, l, r, n, score FROM b ANTI JOIN d ON d.lang = b.lang AND d.ph = b.ph)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM e
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def _lloyd(rounds: int) -> str:
    """Assignments a1.. and codebooks b0.. of all rounds as common table expressions."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k + 1} AS MATERIALIZED (SELECT r, pos, entry, far FROM (SELECT e.r, e.pos, b.entry, sum((e.x - b.y) * (e.x - b.y)) AS far FROM e JOIN b{k} b USING (pos, i) GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY r, pos ORDER BY far, entry) = 1)""")
        if k < rounds:
            steps.append(f"""m{k + 1} AS (SELECT pos, a.entry, i, sum(x) AS s, count(*) AS n FROM e JOIN a{k + 1} a USING (r, pos) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT pos, entry, i, CASE WHEN m.n IS NULL THEN b.y ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS y FROM b{k} b LEFT JOIN m{k + 1} m USING (pos, entry, i))""")
    return ",\n".join(steps)


OP13 = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))::HUGEINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT r, unnest(v) AS x, unnest(range(len(v))) AS j, len(v) // 4 AS width FROM k),
e AS MATERIALIZED (SELECT r, j // width AS pos, j % width AS i, x FROM u),
b0 AS MATERIALIZED (SELECT pos, r AS entry, i, x AS y FROM e WHERE r < 256),
{_lloyd(4)},
h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY pos, entry, i)) AS codebooks_sha256 FROM b4),
c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(far)::BIGINT AS error FROM a5 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (r), h
"""

ORACLES = {"op2_rule_ledger": OP2, "rule_ablations": ABLATIONS, "op6_source_mix": OP6, "op10_line_spread": OP10, "op12_suffix_sigma": OP12, "op13_vector_codes": OP13}
