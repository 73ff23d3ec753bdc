"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from tunedata.llm import secret_scan, url_filter

UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
LOW = "'abcdefghijklmnopqrstuvwxyz'"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {}

ORACLE["op1_line_dedup"] = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, trim(translate(line, {UP}, {LOW}), {WS}) AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE r.key IS NOT NULL AND k.doc_id <> r.keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE r.key IS NULL OR k.doc_id = r.keeper), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY k.doc_id
"""

ORACLE["op10_exact_dedup"] = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {UP}, {LOW}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

ORACLE["op9_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
       list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
p AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM p, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
f AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        len(l)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * n_words AS fs,
        word_chars NOT BETWEEN 2 * n_words AND 15 * n_words AS fw, 100 * n_dup_lines > 30 * n_lines AS fl FROM f),
c AS (SELECT source, count(*) AS n, unnest([1, 2, 3, 4]) AS rule,
        unnest([sum(base_failed::INT), sum(fs::INT), sum(fw::INT), sum(fl::INT)])::DOUBLE AS f FROM b GROUP BY source),
m AS (SELECT rule, sum(f) / sum(n) AS m, sum(n) AS total, count(*) AS hosts FROM c GROUP BY rule),
s AS (SELECT rule, m, greatest(m * (1 - m) / greatest(sum(n * (f / n - m) ** 2) / total - m * (1 - m) * hosts / total, 1e-9) - 1, 0) AS s
      FROM c JOIN m USING (rule) GROUP BY rule, m, total, hosts),
h AS (SELECT source, max(n) AS host_docs, max((f + m * s) / (n + s)) <= 0.5 AS host_kept FROM c JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept, host_docs, host_kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source
"""

_KINDS = r"""
  ('assign', 1, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8),
  ('access', 2, 'AKIA[A-Z0-9]+', 16), ('hex', 3, '[0-9a-f]{32,}', 32), ('entropy', 4, '[A-Za-z0-9+/_-]{20,}', 20)"""

ORACLE["op2_secret_scan"] = r"""
WITH k(kind, rank, pattern, least) AS (VALUES """ + _KINDS + r"""),
m AS (SELECT doc_id, kind, rank, least, regexp_extract_all(coalesce(text, ''), pattern) AS m, string_split_regex(coalesce(text, ''), pattern) AS g,
        CASE WHEN kind = 'assign' THEN regexp_extract_all(coalesce(text, ''), pattern, 2) END AS v FROM documents, k),
e AS (SELECT doc_id, kind, rank, least, i, length(m[i]) AS len, length(g[i]) AS gap, m[i] AS s, length(coalesce(v[i], m[i])) AS size
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
p AS (SELECT *, sum(gap + len) OVER (PARTITION BY doc_id, kind ORDER BY i) - len AS s0 FROM e),
base AS (SELECT doc_id, kind, rank, s0 AS a, s0 + len AS b FROM p WHERE kind <> 'entropy' AND size >= least),
c AS (SELECT doc_id, i, s0, s, CASE WHEN regexp_full_match(s, '[0-9a-fA-F]+') THEN 'hex' ELSE 'base64' END AS class FROM p
      WHERE kind = 'entropy' AND NOT regexp_full_match(s, '__ALLOW__') AND NOT (regexp_full_match(s, '__WORDS__') AND NOT regexp_matches(s, '__HUMP__'))),
ch AS (SELECT doc_id, i, s0, class, unnest(range(0, length(s))) AS p, unnest(string_split(regexp_replace(s, '__PLACEHOLDER__', '__FILLER__', 'g'), '')) AS c FROM c),
wn AS (SELECT x.doc_id, x.i, x.s0, x.class, x.p, y.c, count(*) AS n FROM ch x JOIN ch y
       ON x.doc_id = y.doc_id AND x.i = y.i AND y.p BETWEEN x.p - 19 AND x.p WHERE x.p >= 19 GROUP BY ALL),
hot AS (SELECT doc_id, i, s0, class, p, sum((__MICRO__)[n + 1]) AS t FROM wn GROUP BY ALL),
ent AS (SELECT doc_id, 'entropy' AS kind, 4 AS rank, min(s0 + p - 19) AS a, max(s0 + p + 1) AS b FROM hot
        WHERE t <= CASE class WHEN 'hex' THEN __HEX__ ELSE __B64__ END GROUP BY doc_id, i),
a AS (SELECT * FROM base UNION ALL SELECT * FROM ent),
s AS (SELECT doc_id, count(*) FILTER (WHERE rank = 1) AS n1, count(*) FILTER (WHERE rank = 2) AS n2, count(*) FILTER (WHERE rank = 3) AS n3,
        string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, rank) FILTER (WHERE rank < 4) AS base,
        string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, rank) AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(n1, 0) AS n_assign, coalesce(n2, 0) AS n_access, coalesce(n3, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
ORACLE["op2_secret_scan"] = (ORACLE["op2_secret_scan"].replace("__ALLOW__", "|".join(secret_scan.ALLOW))
                             .replace("__WORDS__", secret_scan.WORDS).replace("__HUMP__", secret_scan.HUMP)
                             .replace("__PLACEHOLDER__", secret_scan.PLACEHOLDER).replace("__FILLER__", secret_scan.FILLER)
                             .replace("__MICRO__", str(secret_scan._micro(secret_scan.WINDOW)))
                             .replace("__HEX__", str(secret_scan._most(20, secret_scan.BITS["hex"])))
                             .replace("__B64__", str(secret_scan._most(20, secret_scan.BITS["base64"]))))

ORACLE["op3_url_filter"] = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), __UP__, __LOW__) AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k(kind, h, p) AS (VALUES __RULES__),
v AS (SELECT page_id, arg_max(k.h || k.p, length(k.h || k.p)) AS rule, arg_max(kind, length(k.h || k.p)) AS verdict
      FROM h JOIN k ON (host = k.h OR ends_with(host, '.' || k.h)) AND starts_with(path, k.p) GROUP BY page_id),
s AS (SELECT h.page_id, host, path, rule, verdict, (verdict = 'block')::INT AS label,
        list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '__VALUE__') THEN '*' ELSE x END) AS s0
      FROM h LEFT JOIN v ON h.page_id = v.page_id),
l AS (SELECT page_id, host, path, rule, verdict, label, CASE WHEN len(s0) > 6 THEN list_concat(s0[1:6], ['**']) ELSE s0 END AS t0 FROM s),
__DEPTHS__
m8 AS (SELECT host, t6 AS template, t6 AS branch, t6 AS name, coalesce(sum(label), 0) AS bad, count(label) AS n FROM l6 GROUP BY ALL),
__MERGES__
tot AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0 END AS base FROM m8),
ho AS (SELECT host, (sum(bad) + 10 * any_value(base)) / (sum(n) + 10) AS hs FROM m8, tot GROUP BY host),
gr AS (SELECT *, CASE WHEN list_contains(branch, '+') THEN list_position(branch, '+') - 1 ELSE greatest(len(branch) - 1, 0) END AS q
      FROM (SELECT host, branch, sum(bad) AS bad, sum(n) AS n FROM m1 GROUP BY ALL)),
s0 AS (SELECT gr.*, hs AS share FROM gr JOIN ho ON gr.host = ho.host),
__SHARES__
j AS (SELECT m1.host, template, '/' || array_to_string(name, '/') AS name, (s6.bad + 10 * share) / (s6.n + 10) AS share
      FROM m1 JOIN s6 ON m1.host = s6.host AND m1.branch = s6.branch)
SELECT page_id, l6.host, path, rule, coalesce(verdict, CASE WHEN share >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, j.name AS template
FROM l6 JOIN j ON l6.host = j.host AND l6.t6 = j.template
"""
_DEPTH = """
c{d} AS (SELECT host, t{e}[1:{e}] AS node FROM l{e} WHERE len(t{e}) >= {d} GROUP BY ALL HAVING count(DISTINCT t{e}[{d}]) > 50),
l{d} AS (SELECT l{e}.*, CASE WHEN c{d}.host IS NOT NULL AND len(t{e}) >= {d} THEN list_concat(t{e}[1:{e}], ['*'], t{e}[{d}+1:]) ELSE t{e} END AS t{d}
  FROM {src} l{e} LEFT JOIN c{d} ON l{e}.host = c{d}.host AND l{e}.t{e}[1:{e}] = c{d}.node),"""
#: step 4 at depth {d}: families of the branches of depth {d} or more; m1 is the last one
_MERGE = """
f{d} AS (SELECT *, sum(bad) OVER w AS fb, sum(n) OVER w AS fl FROM (
        SELECT host, branch, list_concat(branch[1:{e}], ['+'], branch[{d}+1:]) AS family, sum(bad) AS bad, sum(n) AS n FROM m{u} WHERE len(branch) >= {d} GROUP BY ALL)
      WINDOW w AS (PARTITION BY host, family)),
g{d} AS (SELECT *, CASE WHEN n > 0 AND fl > n THEN abs(bad / n - (fb - bad) / (fl - n)) <= 1.96 * sqrt(fb / fl * (1 - fb / fl) * (1 / n + 1 / (fl - n))) ELSE false END AS alike FROM f{d}),
k{d} AS (SELECT * FROM g{d} QUALIFY (alike OR n = 0) AND bool_or(alike) OVER (PARTITION BY host, family)),
m{d} AS (SELECT x.host, template, coalesce(k.family, x.branch) AS branch, CASE WHEN k.alike THEN list_concat(name[1:{e}], ['+'], name[{d}+1:]) ELSE name END AS name, x.bad, x.n
      FROM m{u} x LEFT JOIN k{d} k ON x.host = k.host AND x.branch = k.branch),"""
#: step 5: share of the node at depth {d}, without the labels of the next node on the path (of the group itself at its last node)
_SHARE = """
n{d} AS (SELECT host, template[1:{d}] AS node, sum(bad) AS b, sum(n) AS c FROM m1 WHERE len(template) >= {d} GROUP BY ALL),
s{d} AS (SELECT x.host, x.branch, x.bad, x.n, x.q, CASE WHEN x.q >= {d} THEN
        (a.b - CASE WHEN x.q = {d} THEN x.bad ELSE z.b END + 10 * x.share) / (a.c - CASE WHEN x.q = {d} THEN x.n ELSE z.c END + 10) ELSE x.share END AS share
      FROM s{e} x LEFT JOIN n{d} a ON x.host = a.host AND x.q >= {d} AND x.branch[1:{d}] = a.node
        LEFT JOIN (SELECT host, template[1:{u}] AS node, sum(bad) AS b, sum(n) AS c FROM m1 WHERE len(template) >= {u} GROUP BY ALL) z
          ON x.host = z.host AND x.q >= {u} AND x.branch[1:{u}] = z.node),"""
ORACLE["op3_url_filter"] = (ORACLE["op3_url_filter"].replace("__MERGES__", "".join(_MERGE.format(d=d, e=d - 1, u=d + 1) for d in range(7, 0, -1)))
                            .replace("__SHARES__", "".join(_SHARE.format(d=d, e=d - 1, u=d + 1) for d in range(1, 7))).replace("__UP__", UP).replace("__LOW__", LOW).replace("__VALUE__", url_filter.VALUE)
                            .replace("__RULES__", ", ".join(str(r) for r in url_filter.RULES))
                            .replace("__DEPTHS__", "".join(_DEPTH.format(d=d, e=d - 1, src="l" if d == 1 else f"l{d - 1}") for d in range(1, 7)).replace("l0.*", "l0.*").replace("FROM l0 WHERE", "FROM l WHERE")))
