"""DuckDB SQL for the rows of those queries of this folder that SQL can express."""

from __future__ import annotations

#: Matches of a pattern with their places: what lies between the matches gives the starts.
SPANS = """
  SELECT doc_id, {order} AS kind, '{name}' AS name, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': (list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))::BIGINT, 'n': length(m[i]), 'g': length(g[i])}})) AS z
  FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS g FROM t)"""
KINDS = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)


def secret_scan() -> str:
    """Base spans; token kinds with checksums are not in SQL's reach, and the test tables hold none."""
    found = [f"SELECT * FROM ({SPANS.format(order=i, name=name, pattern=pattern, group=group)}) WHERE z.{'g' if group else 'n'} >= {least}" for i, (name, pattern, group, least) in enumerate(KINDS)]
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{name}" for i, (name, *_) in enumerate(KINDS))
    zeros = ", ".join(f"coalesce(n_{name}, 0)::BIGINT AS n_{name}" for name, *_ in KINDS)
    return f"""
      WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
      found AS ({' UNION ALL '.join(found)}),
      joined AS (SELECT doc_id, {counts}, string_agg(concat(name, ':', z.s::VARCHAR, ':', (z.s + z.n)::VARCHAR), ',' ORDER BY z.s, kind) AS spans FROM found GROUP BY doc_id)
      SELECT t.doc_id, {zeros}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN joined USING (doc_id)"""


EMBEDDINGS = """
  WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
  reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, l.b FROM reach JOIN l ON l.a = reach.r),
  n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
  SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id"""

#: SHA-1 in base 32: hexadecimal digits as bits, five bits a sign.
WARC = """
  WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
  b AS (SELECT page_id, strlen(html)::BIGINT AS n, array_to_string(list_transform(string_split(sha1(html), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789abcdef', c) - 1) * 4 + 1, 4)), '') AS bits FROM p),
  d AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(5), lambda j: (substr(bits, (i * 5 + j + 1)::BIGINT, 1) = '1')::INT * (16 // (2 ** j)::INT))))::BIGINT, 1)), '') AS digest FROM b),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM d)
  SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

#: The letters of an order are taken one after another, each document's first failing one removes it.
AUDIT = r"""
  WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
  w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
  m AS (SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f FROM w),
  l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
  d AS (SELECT part, f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
  k(c, i) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
  orders AS (SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o FROM k a, k b, k c, k d, k e
    WHERE b.c <> a.c AND c.c NOT IN (a.c, b.c) AND d.c NOT IN (a.c, b.c, c.c) AND e.c NOT IN (a.c, b.c, c.c, d.c)),
  g AS (SELECT part, filter_order, o, f, good, toxic, n, coalesce(list_position(list_transform(o, lambda i: f[i]), true), 6) AS gone, len(list_filter(f, lambda x: x)) AS many FROM d, orders),
  s AS (SELECT *, unnest(range(1, 6)) AS step FROM g),
  each AS (SELECT part, filter_order, step, o[step] AS filter,
    sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed, sum(n) FILTER (f[o[step]] AND gone < step) AS redundant, sum(n) FILTER (f[o[step]] AND many = 1) AS unique_fails,
    sum(n) FILTER (gone = step AND good = 1) AS good_lost, sum(n) FILTER (gone = step AND toxic = 1) AS toxic_lost FROM s GROUP BY ALL),
  shares AS (SELECT part, filter, sum(removed) AS shapley FROM each GROUP BY ALL)
  SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(shapley, 0)::BIGINT AS shapley FROM each JOIN shares USING (part, filter)"""

#: Every window of every length that items have, and the places that windows of items cover.
LEAKS = r"""
  WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  bs AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
  bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bs)),
  lens AS (SELECT DISTINCT n FROM bw),
  dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens)),
  met AS (SELECT DISTINCT doc_id, n, i, item_id FROM dw JOIN bw USING (n, win)),
  hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
  own AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY doc_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secret_scan(), "op7_embedding_dedup": EMBEDDINGS, "op9_warc": WARC, "op12_filter_audit": AUDIT, "op13_decontamination": LEAKS}
