"""SQL equivalents of the subpackage's queries, where SQL can express them."""

OP6 = """
WITH hosts AS (
    SELECT page_id, url, nullif(rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host
    FROM pages),
entries AS (
    SELECT h.host, e.ts AS at, max(e.event_id) AS id, arg_max(e.event_type IN ('purchase', 'error'), e.event_id) AS listed
    FROM events e JOIN hosts h ON h.page_id = e.user_id WHERE h.host IS NOT NULL GROUP BY h.host, e.ts),
captures AS (
    SELECT h.page_id, h.url, h.host, e.ts AS fetched_at FROM hosts h LEFT JOIN events e ON e.event_id = h.page_id),
asked AS (
    SELECT page_id, fetched_at, unnest([array_to_string(string_split(host, '.')[i:], '.')
        FOR i IN range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)]) AS suffix
    FROM captures WHERE host IS NOT NULL AND fetched_at IS NOT NULL),
active AS (
    SELECT a.page_id, a.suffix, n.id, n.listed FROM asked a ASOF LEFT JOIN entries n ON a.suffix = n.host AND a.fetched_at >= n.at),
hits AS (
    SELECT page_id, max(struct_pack(size := length(suffix), host := suffix, id := id)) AS m
    FROM active WHERE coalesce(listed, false) GROUP BY page_id)
SELECT c.page_id AS capture_id, c.url, c.fetched_at, c.host, h.page_id IS NOT NULL AS blocked, h.m.host AS matched, h.m.id AS entry_id
FROM captures c LEFT JOIN hits h USING (page_id)
"""

OP13 = """
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS plain
    FROM documents),
g AS (
    SELECT plain, count(*) AS group_size, min(struct_pack(less := -chars, nameless := doc_id IS NULL, doc_id := doc_id)) AS best
    FROM d GROUP BY plain)
SELECT d.doc_id, g.best.doc_id AS keep_id, g.group_size,
       d.doc_id IS NOT DISTINCT FROM g.best.doc_id AND d.chars = -g.best.less AS kept, sha256(d.plain) AS text_sha256
FROM d JOIN g USING (plain)
"""

ORACLE: dict[str, str] = {"op6_temporal_list_join": OP6, "op13_extendible_hash_dedup": OP13}
