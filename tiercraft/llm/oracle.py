"""DuckDB SQL for the text operators' queries that SQL can express."""

from __future__ import annotations

from tiercraft.llm import mixing, quality_rules, url_filter

_SPACE = r"\x20\x09-\x0D"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, parts[i] AS line, i,
             {_LOWER.format(f"regexp_replace(parts[i], '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')")} AS k
      FROM d, unnest(generate_series(1, len(parts))) AS g(i)),
s AS (SELECT k, min(doc_id) AS keeper FROM l WHERE length(k) >= 10
      GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT l.doc_id, l.i, l.line, s.k IS NOT NULL AND l.doc_id <> s.keeper AS falls
      FROM l LEFT JOIN s USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (falls) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT falls), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def _bits48(expr: str) -> str:
    return f"('0x' || substr(md5('42|' || {expr}), 1, {mixing.HASH_DIGITS}))::BIGINT"


_OP4 = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+')) AS size FROM documents),
n AS (SELECT greatest(1, ceil(sqrt(count(*)) / 16))::BIGINT AS slots FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS pool FROM src),
lv AS (SELECT *, (pool - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
one AS (SELECT arg_min(lvl, cap / weight) AS lvl FROM lv WHERE cap / weight >= lvl),
tg AS (SELECT source, source_size,
              CASE WHEN one.lvl IS NULL OR cap <= one.lvl * weight THEN cap
                   ELSE one.lvl * weight END::DOUBLE AS target,
              {_bits48("'offset|' || coalesce(source, '')")} / {float(16 ** mixing.HASH_DIGITS)!r}::DOUBLE AS off
       FROM lv, one),
keyed AS (SELECT *, {_bits48("coalesce(doc_id::VARCHAR, '')")} AS k,
                 CASE WHEN size < 16 THEN size
                      ELSE length(bin(size)) * 16 + size // (1::BIGINT << (length(bin(size)) - 4)::INT)
                      END AS cls FROM sized),
r AS (SELECT keyed.*, row_number() OVER (PARTITION BY source ORDER BY cls, k % slots, size, k,
                                         doc_id NULLS LAST, md5(t)) AS place FROM keyed, n)
SELECT r.doc_id, r.size::BIGINT AS size, tg.source_size, tg.target,
       ((floor(off + place * rate) - floor(off + (place - 1) * rate)) * r.size)::BIGINT AS taken
FROM r JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM tg) tg
  ON r.source IS NOT DISTINCT FROM tg.source
"""

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
_OP9 = f"""
WITH p AS (
  SELECT page_id, strpos(coalesce(url, ''), '://') > 0 AS has,
         substr(url, strpos(url, '://') + 3) AS rest FROM pages),
q AS (SELECT page_id,
             CASE WHEN has THEN {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} ELSE '' END AS host,
             CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p),
r(rv, rh, rp) AS (VALUES {_RULES}),
best AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp) * 1000 + length(rh)) AS rule,
         arg_max(rv, length(rh || rp) * 1000 + length(rh)) AS rv
  FROM q JOIN r ON starts_with(path, rp) AND (host = rh OR ends_with(host, '.' || rh))
  GROUP BY page_id)
SELECT q.page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM q LEFT JOIN best USING (page_id)
"""


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _low_words(text: str) -> str:
    return f"regexp_extract_all({_LOWER.format(text)}, '{_WORD}')"


_OP5 = f"""
WITH d AS (SELECT doc_id, {_low_words("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_low_words('text')} AS w FROM benchmark
      WHERE item_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
      FROM b, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
s AS (SELECT DISTINCT n FROM g),
dn AS (SELECT doc_id, w, n FROM d, s WHERE len(w) >= n),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
       FROM dn, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
h AS (SELECT doc_id, i, n, item FROM dw JOIN g USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def _js(counts: str, reference: str) -> str:
    """Jensen-Shannon distance of two lists of counts in columns of a row."""
    def share(c: str) -> str:
        return f"list_transform({c}, lambda x: x::DOUBLE / list_sum({c})::DOUBLE)"

    def half(p: str, q: str) -> str:
        return (f"list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] > 0 "
                f"THEN z[1] * ln(z[1] * 2 / (z[1] + z[2])) ELSE 0.0 END))")
    p, q = share(counts), share(reference)
    return (f"CASE WHEN list_sum({counts}) > 0 AND list_sum({reference}) > 0 "
            f"THEN sqrt(greatest(0.0, ({half(p, q)} + {half(q, p)}) / (2 * ln(2.0::DOUBLE)))) ELSE 0.0 END")


_LANGS = quality_rules.COMMON_WORDS
_CHARS = ", ".join("length(regexp_replace(t, '" + p.replace("'", "''") + "', '', 'g'))"
                   for p in quality_rules.CHAR_PATTERNS)
_N_COMMON = max(map(len, _LANGS.values())) + 1
_sums = {c: "[" + ", ".join(f"coalesce(sum({c}[{k + 1}]), 0)" for k in range(n)) + "]"
         for c, n in (("chars", len(quality_rules.CHAR_CLASSES)), ("common", _N_COMMON))}
_LISTS = ", ".join(f"('{k}', [{', '.join(repr(w) for w in v)}])" for k, v in _LANGS.items())
_LISTED = ", ".join(map(repr, _LANGS))
_OP2 = rf"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lang,
                  regexp_replace(coalesce(text, ''), '[^\p{{L}}]+', '', 'g') AS letters FROM documents),
d AS (SELECT rid, doc_id, t, CASE WHEN regexp_matches(lang, '[^{_SPACE}]') THEN lang
                                  WHEN length(regexp_replace(letters, '\p{{Latin}}+', '', 'g')) * 2 > length(letters)
                                  THEN '{quality_rules.NO_LANG}' END AS named FROM r),
w AS (SELECT *, regexp_extract_all(t, '[^{_SPACE}]+') AS w, regexp_extract_all(lower(t), '\p{{L}}+') AS lw,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS ls FROM d),
tri AS (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS g
        FROM (SELECT * FROM w WHERE len(w) >= 4), unnest(generate_series(1, len(w) - 2)) AS u(i)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM again, unnest([i, i + 1, i + 2]) AS u(p) GROUP BY rid),
c AS (SELECT rid, doc_id, named, lw, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[{_SPACE}]+', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '{quality_rules.SYMBOLS}'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(lw) AS n_lw,
             list_append([{_CHARS}], length(t) - list_sum([{_CHARS}]))::BIGINT[] AS chars FROM w),
h AS (SELECT c.*, listed, list_transform(cw, lambda x: len(list_filter(lw, lambda y: y = x))) AS hits
      FROM c JOIN (VALUES {_LISTS}) AS v(listed, cw) ON named = listed OR named IS NULL),
m AS (SELECT *, list_append(hits, n_lw - list_sum(hits))::BIGINT[] AS common FROM h),
ref AS (SELECT listed, {_sums['chars']} AS ref_chars, {_sums['common']} AS ref_common
        FROM m WHERE named IS NOT NULL GROUP BY listed),
own AS (SELECT named, {_sums['chars']} AS ref_chars FROM c WHERE named NOT IN ({_LISTED}) GROUP BY named),
near AS (SELECT m.*, {_js('chars', 'ref_chars')} AS char_distance, {_js('common', 'ref_common')} AS word_distance
         FROM m JOIN ref USING (listed) WHERE named IS NOT NULL OR list_sum(ref_common) > 0),
compared AS (SELECT rid, char_distance, word_distance FROM near
             QUALIFY row_number() OVER (PARTITION BY rid ORDER BY word_distance, char_distance, listed) = 1
             UNION ALL SELECT rid, {_js('chars', 'ref_chars')}, 0.0 FROM c JOIN own USING (named)),
j AS (SELECT c.*, coalesce(char_distance, 0.0) AS char_distance, coalesce(word_distance, 0.0) AS word_distance,
             list_sum(chars) AS n_chars, coalesce(n_repeat_words, 0)::BIGINT AS n_rep
      FROM c LEFT JOIN compared USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR n_rep * 100 > n_words * {quality_rules.MAX_REPEAT_PERCENT} AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_rep AS n_repeat_words,
       round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance, base_failed,
       NOT base_failed
       AND NOT (n_chars >= {quality_rules.MIN_CHARS} AND char_distance > {quality_rules.MAX_CHAR_DISTANCE})
       AND NOT (n_lw >= {quality_rules.MIN_LETTER_WORDS}
                AND word_distance > {quality_rules.MAX_WORD_DISTANCE} + 1 / sqrt(n_lw::DOUBLE)) AS kept
FROM f
"""


_OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, list_transform(generate_series(1, length(h) // 2 - 49), lambda i: hash(substr(h, 2 * i - 1, 100))) AS s
      FROM d WHERE length(h) >= 100),
w AS (SELECT doc_id, unnest(s) AS s, unnest(generate_series(1, len(s))) AS i FROM x),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w JOIN f USING (s) WHERE least < doc_id),
n AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 49 AS z FROM n GROUP BY doc_id, k),
c AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1)::BIGINT AS n_removed, max(z) AS last,
             string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS head
      FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^{_SPACE}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
      FROM (SELECT * FROM d WHERE len(w) > 0), unnest(generate_series(1, len(w) - least(3, len(w)) + 1)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM e JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * common >= 85 * (p.n + q.n - common)),
r(node, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT node, b FROM r JOIN l ON reach = a),
c AS (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

_OP13 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{_SPACE}]+') AS ws,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
m AS (SELECT doc_id, part,
             (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * e::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT f1.c || f2.c || f3.c || f4.c || f5.c AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits
      FROM f f1, f f2, f f3, f f4, f f5
      WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31 AND len(list_distinct(bits)) = 5),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before
      FROM o, range(1, 6) r(k)),
r AS (SELECT part, filter_order, step::INT AS step, bit,
             coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
      FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""

ORACLE = {
    "op13_filter_audit": _OP13,"op1_suffix_dedup": _OP1, "op2_quality_rules": _OP2, "op3_line_dedup": _OP3, "op4_mix": _OP4,
          "op5_decontaminate": _OP5, "op8_near_dedup": _OP8, "op9_url_filter": _OP9}
