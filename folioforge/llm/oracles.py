"""DuckDB SQL for the operators that SQL can express.

Written for checking on small tables: near-duplicates there join all pairs that share a shingle.
"""

from __future__ import annotations

from . import quality_rules as qr

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TOKENS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
 iw AS (SELECT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
 dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
 m AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON iw.s = dw.s AND iw.n = dw.n),
 h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM (SELECT DISTINCT doc_id, p, n FROM m)) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
 FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

NEAR_DUP = f"""WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS.format(_LOW)} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]) END) AS x FROM d)),
 z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM c JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
 r(x, y) AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT r.x, f.y FROM r JOIN (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e) f ON f.x = r.y),
 g AS (SELECT x AS doc_id, min(y) AS y FROM r GROUP BY x)
 SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(g.y, d.doc_id)) AS component_id, d.doc_id <= coalesce(g.y, d.doc_id) AS kept FROM d LEFT JOIN z USING (doc_id) LEFT JOIN g USING (doc_id)"""


def _bin(v: str) -> str:
    s = f"greatest(length(bin({v})) - {qr.SUB_BITS}, 0)"
    return f"({s} * {1 << qr.SUB_BITS} + ({v} >> {s}))"


def _least(b: str) -> str:
    return f"(({b} - {b} // {1 << qr.SUB_BITS} * {1 << qr.SUB_BITS}) << ({b} // {1 << qr.SUB_BITS})::INT)"


def _quantiles(source: str, *keys: str) -> str:
    by = ", ".join((*keys, "rate"))
    at = lambda q: f"min(CASE WHEN upto >= total * {q}::DOUBLE THEN bin END)"
    return f"(SELECT {by}, {_least('low')} AS low, {_least('high')} AS high, total FROM (SELECT {by}, {at(qr.LOWER)} AS low, {at(qr.UPPER)} AS high, any_value(total) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM {source}) GROUP BY {by}))"


def quality() -> str:
    part = {"mark_rate": ("n_marks", "word_chars", 100_000), "word_length": ("word_chars", "n_words", 1_000), "upper_rate": ("n_upper", "n_letters", 100_000), "dup_line_rate": ("n_dup_lines", "n_lines", 100_000), "repeat_rate": ("n_repeat_words", "n_words", 100_000)}
    rates = ", ".join(f"{scale} * {a} // greatest({b}, 1) AS {r}" for r, (a, b, scale) in part.items())
    long = " UNION ALL ".join(f"SELECT lang, source, {k} AS rate, {r} AS v FROM r" for k, r in enumerate(qr.RATES))
    guard = "CASE rate " + " ".join(f"WHEN {k} THEN {qr.GUARD[r]}" for k, r in enumerate(qr.RATES)) + " END"
    side = {"high": f"high + {qr.SPREAD} * greatest(high - low, guard)", "low": f"low - {qr.SPREAD} * greatest(high - low, guard)"}
    cuts = ", ".join(f"max(CASE WHEN rate = {qr.RATES.index(r)} THEN {side[s]} END) AS cut_{r}_{s}" for r, s in qr.RULES)
    over = ", ".join(f"CASE WHEN {r} {'>' if s == 'high' else '<'} cut_{r}_{s} THEN '{r}_{s}' END" for r, s in qr.RULES)
    pick = lambda c: f"CASE WHEN f.total >= {qr.MIN_GROUP} THEN f.{c} WHEN l.total >= {qr.MIN_GROUP} THEN l.{c} ELSE a.{c} END AS {c}"
    tok = _TOKENS.format("coalesce(text, '')")
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {tok} AS w FROM documents),
 win AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
 rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT win.doc_id, unnest(range(win.p, win.p + 3)) AS k FROM win JOIN (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1) g ON g.doc_id = win.doc_id AND g.s = win.s) GROUP BY doc_id),
 l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
 m AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\\x00-\\x08\\x0E-\\x1F\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', '', 'g')) AS n_marks FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id)),
 r AS (SELECT *, {rates} FROM m), fine AS (SELECT lang, source, rate, {_bin('v')} AS bin, count(*) AS n FROM ({long}) GROUP BY ALL),
 by_lang AS (SELECT lang, rate, bin, sum(n) AS n FROM fine GROUP BY ALL), by_all AS (SELECT rate, bin, sum(n) AS n FROM fine GROUP BY ALL),
 t AS (SELECT *, {guard} AS guard FROM (SELECT f.lang, f.source, f.rate, {pick('low')}, {pick('high')}
 FROM {_quantiles('fine', 'lang', 'source')} f JOIN {_quantiles('by_lang', 'lang')} l ON l.rate = f.rate AND l.lang IS NOT DISTINCT FROM f.lang JOIN {_quantiles('by_all')} a ON a.rate = f.rate)),
 c AS (SELECT lang, source, {cuts} FROM t GROUP BY lang, source)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules = '' AS kept, rules FROM
 (SELECT r.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {over}) AS rules FROM r JOIN c ON c.lang IS NOT DISTINCT FROM r.lang AND c.source IS NOT DISTINCT FROM r.source)"""


DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 o AS (SELECT k, lang, source, unnest(w) AS term FROM d),
 kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
 c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
 g AS (SELECT DISTINCT lang, source FROM d),
 every AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS lang_n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
 p AS (SELECT *, 1 + CAST(CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p,
 1 + CAST(CAST(1000000000 AS HUGEINT) * (lang_n + 2) // (sum(lang_n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS q FROM every),
 pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(pairs.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
 term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
 r AS (SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair UNION ALL SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
 SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10"""

MIXTURE = f"""WITH d AS (SELECT doc_id, source, CAST(len({_TOKENS.format("coalesce(text, '')")}) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
 w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
 o AS (SELECT *, row_number() OVER (ORDER BY CAST(size AS DOUBLE) / weight, source NULLS LAST) AS k, CAST(sum(size) OVER () AS BIGINT) AS total FROM w),
 u AS (SELECT *, CAST(sum(size) OVER (ORDER BY k) AS BIGINT) - size AS before, CAST(sum(weight) OVER (ORDER BY k DESC) AS BIGINT) AS others FROM o),
 f AS (SELECT *, weight * (3 * total - 4 * before) > 4 * CAST(size AS HUGEINT) * others AS stopped FROM u),
 l AS (SELECT 3 * any_value(total) - 4 * coalesce(sum(size) FILTER (stopped), 0) AS num, 2 * sum(weight) FILTER (NOT stopped) AS den FROM f),
 t AS (SELECT source, size AS source_size, CASE WHEN stopped THEN CAST(2 * size AS DOUBLE) ELSE CAST(weight * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target FROM f, l),
 b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
 x AS (SELECT *, CAST(floor(target) AS BIGINT) - whole * source_size AS rest FROM b),
 r AS (SELECT d.*, x.source_size, x.target, x.whole, x.rest, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto, CAST(sum(d.size) OVER (PARTITION BY d.source, h) AS BIGINT) AS tie FROM d JOIN x ON x.source IS NOT DISTINCT FROM d.source)
 SELECT doc_id, size, source_size, target, CAST(whole * size + CASE WHEN upto <= rest THEN size WHEN upto - tie < rest THEN CAST(size AS HUGEINT) * (rest - upto + tie) // tie ELSE 0 END AS BIGINT) AS taken FROM r"""

COLLOCATIONS = f"""WITH p AS MATERIALIZED (SELECT k, lang, j, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT k, lang, unnest(pieces) AS piece, unnest(range(len(pieces))) AS j FROM
 (SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang, string_split_regex({_LOW}, '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents))),
 n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
 o AS MATERIALIZED (SELECT lang, w, lead(w, 1) OVER (PARTITION BY k, j ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY k, j ORDER BY i) AS w3 FROM (SELECT k, lang, j, unnest(w) AS w, unnest(range(len(w))) AS i FROM p)),
 f AS MATERIALIZED (SELECT lang, size, x, count(*) AS f FROM (SELECT lang, 1 AS size, w AS x FROM o UNION ALL SELECT lang, 2, w || ' ' || w2 FROM o UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM o) WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
 c AS MATERIALIZED (SELECT lang, size, x AS phrase, f AS a, string_split(x, ' ') AS w FROM f WHERE size > 1),
 two AS (SELECT lang, phrase, a, 1 AS k, w[1] AS x, array_to_string(w[2:size], ' ') AS y FROM c UNION ALL SELECT lang, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] FROM c WHERE size = 3),
 cuts AS (SELECT two.lang, phrase, a, k, l.f AS l, r.f AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS score FROM two JOIN f l ON l.lang = two.lang AND l.x = two.x JOIN f r ON r.lang = two.lang AND r.x = two.y),
 best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 inner_ AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE size = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE size = 3),
 most AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
 kept AS (SELECT best.* FROM best LEFT JOIN most ON most.lang = best.lang AND most.phrase = best.phrase WHERE coalesce(100 * longer < 50 * best.a, true)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
 SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


ORACLES = {"op3_decontaminate": DECONTAMINATE, "op4_near_dup": NEAR_DUP, "op10_quality_rules": quality(), "op11_source_divergence": DIVERGENCE, "op12_mixture": MIXTURE, "op13_collocations": COLLOCATIONS}
