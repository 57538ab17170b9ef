"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from .quality import RULES

WORDS = r"'[^\x20\x09-\x0D]+'"

NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) > 2 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || chr(31) || w[k + 1] || chr(31) || w[k + 2])) WHEN len(w) > 0 THEN [array_to_string(w, chr(31))] ELSE [] END AS sh FROM w),
 e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
 p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
 r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT d, v FROM r JOIN l ON c = u),
 m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
 SELECT doc_id, len(sh)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN m ON d = doc_id"""

REPEATS = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
 win AS (SELECT doc_id, k AS p, md5(array_to_string(w[k : k + 49], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM w)),
 m AS (SELECT x, min(doc_id) AS low FROM win GROUP BY x),
 gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(p, p + 50)) AS pos FROM win JOIN m USING (x) WHERE low < doc_id)),
 every AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
 k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM every ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
 SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

BYTES = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 win AS (SELECT r, unnest(range(1, length(h) // 2 - 198)) AS p, h FROM d WHERE length(h) >= 400),
 x AS (SELECT r, p, sha256(substr(h, 2 * p - 1, 400)) AS x FROM win),
 twice AS (SELECT x FROM x GROUP BY x HAVING count(*) > 1),
 hit AS (SELECT r, p, p - lag(p, 1, -1000) OVER (PARTITION BY r ORDER BY p) > 200 AS fresh FROM x JOIN twice USING (x)),
 runs AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS g FROM hit) GROUP BY r, g),
 gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS before FROM runs),
 cut AS (SELECT r, sum(b - a) AS removed, count(*) AS n_spans, string_agg(substr(h, 2 * before - 1, 2 * (a - before)), '' ORDER BY a) AS front, max(b) AS rest FROM gaps JOIN d USING (r) GROUP BY r)
 SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
   sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE front || substr(h, 2 * rest - 1) END)) AS kept_sha256 FROM d LEFT JOIN cut USING (r)"""

HARD = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 e AS (SELECT vec_id, label, unnest(x) AS c, generate_subscripts(x, 1) AS d FROM v),
 s AS (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, sum(a.c * b.c)::BIGINT AS score FROM e a JOIN e b ON a.d = b.d AND a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
 p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
 SELECT p.anchor AS anchor_id, p.other AS positive_id, (row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other))::INT AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
 FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score QUALIFY rank <= 10"""


def quality(limit: float = 0.1, error: float = 0.1) -> str:
    cells = ", ".join(f"('{r}', {i}, {float(c)})" for r, cs in RULES.items() for i, c in enumerate(cs))
    share = limit / len(RULES)
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in RULES) + " END"
    tail = f"ln(list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share}) + (n - j) * ln(1 - {share})))))"
    ratios = ", ".join(f"coalesce({a}::DOUBLE / nullif({b}, 0), 0) AS {c}" for a, b, c in (("n_symbols", "word_chars", "symbol_ratio"), ("n_dup_lines", "n_lines", "dup_line_ratio"), ("n_repeat_words", "n_words", "repeat_ratio"), ("n_upper", "word_chars", "upper_ratio"), ("word_chars", "n_words", "mean_word_chars")))
    broken = "list_filter([" + ", ".join(f"CASE WHEN {r} >= (SELECT cutoff FROM chosen x WHERE x.stratum = m.stratum AND x.rule = '{r}') THEN '{r}' END" for r in RULES) + "], lambda x: x IS NOT NULL)"
    return rf"""WITH w AS (SELECT doc_id, coalesce(lang, '(null)') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
 tri AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
 twice AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM tri) WHERE c > 1),
 rep AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM twice, range(0, 3) r(j) GROUP BY doc_id),
 base AS (SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
   length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORDS})) AS lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
 counted AS (SELECT * EXCLUDE (lines), len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM base),
 m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {ratios} FROM counted),
 q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
 cells(rule, step, cutoff) AS (VALUES {cells}),
 c AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND {value} >= cutoff) AS k, count(*) FILTER (quality <> 1 AND {value} >= cutoff) AS bad FROM m JOIN q USING (doc_id), cells WHERE NOT base_failed GROUP BY ALL),
 ok AS (SELECT *, min(CASE WHEN k > {share} * n THEN false ELSE {tail} <= ln({error}) - ln((SELECT count(DISTINCT stratum) FROM c) * {float(len(RULES))}) END) OVER (PARTITION BY stratum, rule ORDER BY step) AS passed FROM c),
 chosen AS (SELECT stratum, rule, arg_max(cutoff, (bad, -step)) AS cutoff FROM ok WHERE passed GROUP BY stratum, rule),
 labelled AS (SELECT DISTINCT stratum FROM m JOIN q USING (doc_id) WHERE NOT base_failed)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len({broken}) = 0 AS kept, n_lines, n_upper, {", ".join(RULES)},
   CASE WHEN stratum IN (FROM labelled) THEN stratum ELSE '(other)' END AS stratum, array_to_string({broken}, ',') AS rejected_by FROM m"""
