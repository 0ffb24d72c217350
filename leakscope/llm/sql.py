"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

import math

from . import line_dedup, mixing, substring_dedup
from .common import WORD

SQL: dict[str, str] = {}
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"
_SPACE = r"E' \t\n\x0B\x0C\r'"

SQL["op3_mixing"] = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n
       FROM d GROUP BY source),
s1 AS (SELECT *, {list(mixing.WEIGHTS)}[n % {len(mixing.WEIGHTS)} + 1] AS weight, {mixing.MOST} * source_size AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY cap / weight, n) AS k FROM s1),
s3 AS (SELECT *, (CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                       AS DOUBLE))
                 / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
l AS (SELECT level FROM s3 WHERE cap > weight * level ORDER BY k LIMIT 1),
s AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * coalesce((SELECT level FROM l), 1e308)) AS target,
             CAST(('0x' || substr(md5('{mixing.SEED}|' || coalesce(source, '~null')), 1, 13)) AS BIGINT) / {float(1 << 52)} AS off
      FROM s3),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) - 1 AS nth FROM d),
c AS (SELECT n.doc_id, n.source, size, source_size, target,
             CASE WHEN size > 0 THEN least(floor((nth + 1) * rate + off) - floor(nth * rate + off), {mixing.MOST}) ELSE 0 END AS copies
      FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken FROM c
"""

SQL["op5_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, p, string_agg(x, ' ') OVER win AS h, count(*) OVER win AS n FROM u
      WINDOW win AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {substring_dedup.SIZE - 1} FOLLOWING)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS nth FROM k WHERE n = {substring_dedup.SIZE}),
g AS (SELECT DISTINCT doc_id, p + o AS p FROM f, range(0, {substring_dedup.SIZE}) r(o) WHERE nth > 1),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM u ANTI JOIN g USING (doc_id, p) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

SQL["op7_line_dedup"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS line_no FROM d),
b AS (SELECT *, trim(raw, {_SPACE}) AS x, len(regexp_extract_all(raw, '{WORD}')) AS n FROM a),
u AS (SELECT *, row_number() OVER w AS p, sum(n) OVER w AS upto, sum(n) OVER w - n AS before FROM b WHERE x != ''
      WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
l AS (SELECT doc_id, list(x ORDER BY p) AS xs FROM u GROUP BY doc_id),
few AS (SELECT u.doc_id, u.p, v.p AS q FROM u ASOF JOIN u v ON u.doc_id = v.doc_id AND u.before + {line_dedup.MIN_WORDS} <= v.upto),
long AS (SELECT u.doc_id, u.p, v.p AS q FROM u ASOF JOIN u v ON u.doc_id = v.doc_id AND u.before + {line_dedup.LONG_WORDS} <= v.upto),
few_back AS (SELECT u.doc_id, v.p, u.p AS q FROM u ASOF JOIN u v ON u.doc_id = v.doc_id AND u.upto - {line_dedup.MIN_WORDS} >= v.before),
long_back AS (SELECT u.doc_id, v.p, u.p AS q FROM u ASOF JOIN u v ON u.doc_id = v.doc_id AND u.upto - {line_dedup.LONG_WORDS} >= v.before),
runs AS (SELECT doc_id, p, greatest(q, p + {line_dedup.MIN_LINES - 1}) AS q FROM few UNION SELECT * FROM long
         UNION SELECT doc_id, least(p, q - {line_dedup.MIN_LINES - 1}) AS p, q FROM few_back UNION SELECT * FROM long_back),
f AS (SELECT doc_id, p, q, row_number() OVER (PARTITION BY array_to_string(xs[p:q], chr(10)) ORDER BY doc_id, p) AS nth
      FROM runs JOIN l USING (doc_id) WHERE p >= 1 AND q <= len(xs)),
g AS (SELECT DISTINCT doc_id, unnest(range(p, q + 1)) AS p FROM f WHERE nth > 1),
gone AS (SELECT u.doc_id, u.line_no FROM u JOIN g USING (doc_id, p)),
kept AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) AS t FROM a ANTI JOIN gone USING (doc_id, line_no) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(m.n, 0) AS BIGINT) AS n_lines_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

#: Fixed values of op10, stated anew: buckets of 1 % error, quantile levels, resolutions.
_GAMMA = 1.01 / 0.99
_LEVELS = {"symbol_ratio": (0.9, 0.01), "dup_line_ratio": (0.99, 0.05), "repeat_ratio": (0.99, 0.05), "mean_word": (0.9, 0.1)}
_VALUE = f"CASE WHEN bucket = -1000000 THEN 0 ELSE pow({_GAMMA!r}, bucket) * {2 / (_GAMMA + 1)!r} END"


def _quantiles(name: str, source: str, keys: str) -> str:
    part = f"PARTITION BY {keys}metric"
    at = ", ".join(f"min({_VALUE}) FILTER (WHERE upto >= {q} * n_all) AS {c}" for q, c in (("0.1", "lo"), ("0.5", "mid"), ("level", "hi")))
    return f"""
{name}_c AS (SELECT *, sum(n) OVER ({part} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER ({part}) AS n_all,
             coalesce(sum(n) FILTER (WHERE bucket = -1000000) OVER ({part}), 0) AS n_none FROM {source} JOIN sp USING (metric)),
{name} AS (SELECT {keys}metric, max(n_all) AS n_rows, {at},
           coalesce(min({_VALUE}) FILTER (WHERE bucket != -1000000 AND upto - n_none >= 0.25 * (n_all - n_none)), 0) AS pos
           FROM {name}_c GROUP BY {keys}metric)"""


def _pick(q: str, first: str = "") -> str:
    return f"CASE {first}WHEN lang_q.n_rows >= 200 THEN lang_q.{q} ELSE every_q.{q} END"


_BASE = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"
SQL["op10_quality_rules"] = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, p, string_agg(x, ' ') OVER win AS h, count(*) OVER win AS c FROM u
      WINDOW win AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
f AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, h) AS times FROM k WHERE c = 3),
g AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM f, range(0, 3) r(o) WHERE times > 1 GROUP BY doc_id),
b AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_repeat_words,
             len(ls) AS n_lines FROM d LEFT JOIN g USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
             CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio,
             CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word FROM b),
fit AS (SELECT DISTINCT * EXCLUDE (doc_id) FROM m WHERE NOT base_failed),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{s}' AS metric, {s} AS x FROM fit" for s in _LEVELS)}),
sp(metric, level, least) AS (VALUES {", ".join(f"('{k}', CAST({v} AS DOUBLE), CAST({r} AS DOUBLE))" for k, (v, r) in _LEVELS.items())}),
sketch AS (SELECT lang, source, metric, CASE WHEN x < 1e-9 THEN -1000000 ELSE ceil(ln(x) / {math.log(_GAMMA)!r}) END AS bucket,
                  count(*) AS n FROM v GROUP BY ALL),
by_lang AS (SELECT lang, metric, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
every AS (SELECT metric, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
{_quantiles("own", "sketch", "lang, source, ")}, {_quantiles("lang_q", "by_lang", "lang, ")}, {_quantiles("every_q", "every", "")},
q AS (SELECT own.lang, own.source, own.metric, {", ".join(_pick(c, f"WHEN own.n_rows >= 200 THEN own.{c} ") + f" AS {c}" for c in ("lo", "mid", "hi", "pos"))},
             {_pick("pos")} AS lang_pos
      FROM own JOIN lang_q ON own.lang IS NOT DISTINCT FROM lang_q.lang AND own.metric = lang_q.metric
      JOIN every_q ON own.metric = every_q.metric),
fence AS (SELECT lang, source, metric,
                 CASE WHEN metric = 'mean_word' THEN (mid - 3.0 * greatest(mid - lo, least)) / {_GAMMA!r} ELSE 0 END AS low,
                 CASE WHEN metric = 'mean_word' THEN mid + 3.0 * greatest(hi - mid, least)
                      ELSE greatest(2 * hi, pos / 2, lang_pos / 2, least) END * {_GAMMA!r} AS high
          FROM q JOIN sp USING (metric)),
lim AS (SELECT lang, source, {", ".join(f"max({c}) FILTER (WHERE metric = '{s}') AS {c}_{s}" for s in _LEVELS for c in ("low", "high"))}
        FROM fence GROUP BY lang, source)
SELECT doc_id, {_BASE}, base_failed,
       NOT base_failed AND {" AND ".join(f"{s} BETWEEN low_{s} AND high_{s}" for s in _LEVELS)} AS kept
FROM m LEFT JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source
"""
