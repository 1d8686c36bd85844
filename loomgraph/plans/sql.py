"""Common table expressions that the queries' SQL shares."""

ITEMS = r"""items AS (
  SELECT 'd' || lpad(d.doc_id::VARCHAR, 9, '0') AS item_id, d.doc_id, e.event_type AS source_type, d.source AS author_native_id, e.ts AS published_at,
         d.text, d.lang, t.text_normalized, CASE WHEN length(t.text_normalized) > 0 THEN sha256(t.text_normalized) END AS text_hash,
         CASE WHEN (e.props->>'$.k')::INT >= 90 THEN sha256(e.props) END AS media_hash, e.value
  FROM documents d JOIN events e ON e.event_id = d.doc_id,
  LATERAL (SELECT nullif(lower(trim(regexp_replace(regexp_replace(d.text, 'https?://\S+|www\.\S+', ' ', 'g'), '\s+', ' ', 'g'))), '') AS text_normalized) t)"""
STANCE = r"""stance AS (
  SELECT i.item_id, i.lang AS entity_id, CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS polarity, least(1.0, i.value / 500) AS strength
  FROM items i JOIN labels l ON l.doc_id = i.doc_id)"""
PAIRS = r"""hashed AS (
  SELECT 'near_duplicate_text' AS edge_type, text_hash AS hash, {'id': item_id, 'author': author_native_id, 'moment': published_at} AS who FROM items
  UNION ALL SELECT 'shared_media', media_hash, {'id': item_id, 'author': author_native_id, 'moment': published_at} FROM items),
groups AS (SELECT edge_type, hash, list(who ORDER BY who.id) AS g FROM hashed WHERE hash IS NOT NULL GROUP BY ALL),
firsts AS (SELECT edge_type, hash, g, unnest(range(1, len(g))) AS k FROM groups),
pairs AS (
  SELECT g[k].id AS src_item_id, other.id AS dst_item_id, edge_type, hash, g[k].author AS sa, other.author AS da, g[k].moment AS st, other.moment AS dt
  FROM (SELECT edge_type, hash, g, k, unnest(g[k + 1:]) AS other FROM firsts))"""
COCLUSTER = r"""cocluster AS (
  SELECT src_item_id, dst_item_id, edge_type AS basis_edge_type, sa AS author_src, da AS author_dst, abs(date_diff('microsecond', st, dt)) / 1000000 AS time_delta_seconds
  FROM pairs WHERE sa <> da AND greatest(st, dt) <= least(st, dt) + INTERVAL 24 HOUR)"""
MEMBERS = r"""links AS (
  SELECT item_id, 't:' || text_hash AS h FROM items WHERE text_hash IS NOT NULL
  UNION SELECT item_id, 'm:' || media_hash FROM items WHERE media_hash IS NOT NULL),
shared AS (SELECT l.item_id, l.h FROM links l JOIN (SELECT h FROM links GROUP BY h HAVING count(*) > 1) s ON l.h = s.h),
reach(item_id, label) AS (
  SELECT item_id, item_id FROM shared
  UNION
  SELECT b.item_id, r.label FROM reach r JOIN shared a ON a.item_id = r.item_id JOIN shared b ON b.h = a.h AND r.label < b.item_id),
members AS (SELECT 'tight:' || min(label) AS narrative_id, item_id FROM reach GROUP BY item_id)"""
PROFILES = r"""judged AS (
  SELECT i.source_type || ':' || i.author_native_id AS author_id, s.entity_id, s.polarity, s.strength, i.published_at AS moment, m.narrative_id
  FROM items i JOIN stance s USING (item_id) LEFT JOIN members m USING (item_id) WHERE i.author_native_id IS NOT NULL),
polar AS (
  SELECT author_id, entity_id, polarity, count(*) AS n, sum(strength) AS weight, min(moment) AS since, max(moment) AS until, list(DISTINCT narrative_id) FILTER (WHERE narrative_id IS NOT NULL) AS told
  FROM judged GROUP BY ALL),
weighed AS (SELECT *, n / sum(n) OVER (PARTITION BY author_id, entity_id) AS p FROM polar),
profiles AS (
  SELECT author_id, entity_id, sum(n)::BIGINT AS volume, coalesce(any_value(n) FILTER (WHERE polarity = 'positive'), 0)::BIGINT AS positive_count,
         coalesce(any_value(n) FILTER (WHERE polarity = 'negative'), 0)::BIGINT AS negative_count, coalesce(any_value(n) FILTER (WHERE polarity = 'neutral'), 0)::BIGINT AS neutral_count,
         (coalesce(sum(weight) FILTER (WHERE polarity = 'positive'), 0) - coalesce(sum(weight) FILTER (WHERE polarity = 'negative'), 0)) / sum(n) AS net_stance,
         1 + sum(p * ln(p)) / ln(3) AS stance_consistency, min(since) AS first_seen, max(until) AS last_seen, date_diff('day', min(since), max(until))::BIGINT AS time_span_days,
         len(list_distinct(flatten(list(coalesce(told, [])))))::BIGINT AS narrative_spread
  FROM weighed GROUP BY ALL)"""
#: Scores of the pairs (a, b) of ``compared``: shared words, and what each side has besides.
TOKEN_SET = r"""worded AS (SELECT a, b, list_sort(list_distinct(string_split(a, ' '))) AS wa, list_sort(list_distinct(string_split(b, ' '))) AS wb FROM compared),
parted AS (SELECT a, b, list_filter(wa, lambda x: list_contains(wb, x)) AS s, list_filter(wa, lambda x: NOT list_contains(wb, x)) AS oa, list_filter(wb, lambda x: NOT list_contains(wa, x)) AS ob FROM worded),
texts_of AS (SELECT a, b, len(s) > 0 AND (len(oa) = 0 OR len(ob) = 0) AS inside, array_to_string(s, ' ') AS s, array_to_string(list_concat(s, oa), ' ') AS ta, array_to_string(list_concat(s, ob), ' ') AS tb FROM parted),
sides AS (SELECT a, b, ta AS x, tb AS y FROM texts_of UNION ALL SELECT a, b, s, ta FROM texts_of WHERE s <> '' UNION ALL SELECT a, b, s, tb FROM texts_of WHERE s <> ''),
best AS (SELECT a, b, max(200.0 * list_reduce(list_prepend([0 for j in range(length(y) + 1)], [[ascii(c)] for c in string_split(x, '')]),
  lambda prev, c: list_reduce(list_prepend([0], [[j] for j in range(1, length(y) + 1)]),
    lambda done, j: done || [CASE WHEN ascii(substr(y, j[1]::INT, 1)) = c[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], done[j[1]]) END]))[-1] / (length(x) + length(y))) AS ratio FROM sides GROUP BY ALL),
scores AS (SELECT t.a, t.b, CASE WHEN t.inside THEN 100.0 ELSE k.ratio END AS score FROM texts_of t JOIN best k ON k.a = t.a AND k.b = t.b)"""


def query(select: str, *parts: str) -> str:
    """A statement over the named parts; ``reach`` is recursive."""
    return f"WITH RECURSIVE {', '.join(parts)} {select}"
