"""SQL equivalents of the registered queries, over the raw tables.

Written independently of the DataFrame code; the views below restate the registry
projection in SQL.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "document_types": """
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, lower(r_name) AS key, r_name AS name,
               CASE WHEN r_regionkey % 2 = 1 THEN lower(r_name) END AS short_name, r_regionkey < 3 AS is_system
        FROM region""",
    "users": """
        SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '.')) || '@example.org' AS email,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'admin' WHEN 'MACHINERY' THEN 'super_admin' ELSE 'staff' END AS role_slug,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 2 WHEN 'MACHINERY' THEN 3 ELSE 1 END AS role_id,
               c_acctbal >= 0 AS is_active
        FROM customer""",
    "templates": """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name, CAST(n_regionkey + 1 AS BIGINT) AS document_type_id,
               CASE WHEN n_nationkey % 2 = 0 THEN 'custom' ELSE 'auto' END AS grouping_mode,
               CASE n_nationkey % 4 WHEN 0 THEN 'letter' WHEN 1 THEN 'long_bond' WHEN 2 THEN 'a4' ELSE 'custom' END AS paper_size,
               CASE WHEN n_nationkey % 3 = 0 THEN 'landscape' ELSE 'portrait' END AS orientation,
               CASE WHEN n_nationkey % 8 = 3 THEN CAST(n_nationkey * 10 + 100.5 AS DOUBLE) END AS custom_width_mm,
               CASE WHEN n_nationkey % 8 = 3 THEN CAST(n_nationkey * 12 + 40.25 AS DOUBLE) END AS custom_height_mm,
               n_nationkey % 5 < 2 AS is_active
        FROM nation""",
    "template_fields": """
        SELECT p_partkey AS id, p_partkey % 25 + 1 AS document_template_id, p_name AS name,
               CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 5 * 2 END AS person_group,
               CASE WHEN p_partkey % 7 <> 0 THEN p_size * 3 END AS person_field_order,
               CAST(p_partkey % 10 AS DOUBLE) / 10.0 AS x, CAST(p_partkey % 13 AS DOUBLE) / 12.0 AS y,
               CAST(0.1 AS DOUBLE) AS width, CAST(p_size AS DOUBLE) / 500.0 AS height, p_partkey AS sort_order, p_partkey % 4 <> 0 AS is_required
        FROM part""",
    "records": """
        SELECT o_orderkey AS id,
               CASE o_orderkey % 4 WHEN 0 THEN 'birth' WHEN 1 THEN 'death' WHEN 2 THEN 'marriage' ELSE 'custom' END AS doc_type,
               CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey % 4 + 1 END AS document_type_id,
               o_orderkey % 25 + 1 AS document_template_id,
               CASE WHEN o_orderkey % 5 <> 0 THEN 'R-' || o_orderkey END AS registry_number,
               CASE WHEN o_orderstatus <> 'O' THEN 'submitted' ELSE 'draft' END AS status,
               'Supplier#' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 9, '0') AS ocr_model_key,
               o_custkey AS created_by, CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS submitted_by,
               CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_minutes(o_orderkey % 1440) END AS submitted_at,
               o_orderdate AS created_at
        FROM orders""",
    "fields": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS id, l_orderkey AS record_id,
               'Field ' || l_linenumber AS name,
               CASE WHEN l_partkey % 11 <> 0 THEN 'part ' || l_partkey END AS ocr_text,
               CASE WHEN l_suppkey % 19 <> 0 THEN 'part ' || (l_partkey + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END)
                    ELSE '  ' END AS verified_value,
               CASE WHEN l_partkey % 13 <> 0 THEN 50 + l_quantity END AS ocr_confidence,
               l_returnflag <> 'R' AS is_required,
               CASE WHEN l_orderkey % 3 <> 0 AND l_suppkey % 4 <> 0 THEN CAST(l_suppkey % 4 AS INT) END AS person_group,
               CASE WHEN l_orderkey % 3 <> 0 AND l_suppkey % 5 <> 0 THEN CAST(l_partkey % 9 AS INT) END AS person_field_order,
               CASE WHEN l_partkey % 29 <> 0 THEN CAST(l_linenumber - 1 AS DOUBLE) * CAST(0.14 AS DOUBLE) END AS x,
               CAST(l_suppkey % 5 AS DOUBLE) * CAST(0.22 AS DOUBLE) AS y,
               l_quantity / 400.0::DOUBLE + 0.02::DOUBLE AS width, 0.05::DOUBLE AS height, l_linenumber AS sort_order
        FROM lineitem""",
    "requests": """
        SELECT o_orderkey * 2 + j AS id, o_orderkey AS record_id,
               CASE (o_orderkey + j) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'withdrawn' END AS status,
               'Correct entry ' || o_orderkey AS reason, o_orderkey % 6 = 0 AS changes_registry_number,
               CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 5 <> 0 THEN 'R-' || o_orderkey END AS current_registry_number,
               CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 12 <> 0 THEN 'N-' || (o_orderkey + j) END AS proposed_registry_number,
               o_custkey AS requested_by,
               CASE WHEN (o_orderkey + j) % 4 IN (1, 2) THEN o_custkey END AS reviewed_by,
               CASE WHEN (o_orderkey + j) % 4 IN (1, 2) THEN o_orderdate + to_days(CAST(j + 1 AS INT)) END AS reviewed_at,
               o_orderdate + to_days(CAST(j AS INT)) AS created_at
        FROM orders, (VALUES (0), (1)) AS twice(j)""",
    "items": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), j) AS id, l_orderkey * 2 + j AS change_request_id,
               CASE WHEN l_partkey % 17 = 0 THEN 'gone-' ELSE '' END
                 || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS record_field_id,
               'part ' || l_partkey AS current_value,
               CASE WHEN (l_suppkey + j) % 9 <> 0 THEN ' part ' || (l_partkey + j) ELSE ' ' END AS proposed_value
        FROM lineitem, (VALUES (0), (1)) AS twice(j)""",
    "audit": """
        SELECT event_id AS id, CASE WHEN event_id % 10 <> 0 THEN user_id END AS user_id,
               CASE WHEN event_id % 10 <> 0 AND event_id % 3 <> 0 THEN 'Actor ' || user_id END AS actor_name,
               'record.' || event_type AS action, event_type, value, props,
               upper(event_type[1]) || event_type[2:] || ' on entry #' || event_id AS description, ts AS created_at
        FROM events""",
    "ocr_models": """
        SELECT s_suppkey AS id, s_name AS key, 'Model ' || s_suppkey AS label, s_suppkey = 7 AS is_active,
               CASE WHEN s_suppkey % 5 <> 0 THEN abs(s_acctbal) / 10000.0::DOUBLE END AS cer,
               CASE WHEN s_suppkey % 5 <> 0 THEN abs(s_acctbal) / 10000.0::DOUBLE * 1.5::DOUBLE END AS wer,
               CASE WHEN s_suppkey % 5 <> 0 THEN 1 - abs(s_acctbal) / 10000.0::DOUBLE END AS exact_match,
               CASE WHEN s_suppkey % 5 <> 0 THEN 'form-scans' END AS evaluation_dataset,
               CASE WHEN s_suppkey % 5 <> 0 THEN CASE WHEN s_suppkey % 7 = 3 THEN 'val' ELSE 'test' END END AS evaluation_split,
               CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 37 END AS evaluation_sample_count,
               CASE WHEN s_suppkey % 5 <> 0 THEN sha256(s_name) END AS evaluation_manifest_sha256,
               CASE WHEN s_suppkey % 5 <> 0 THEN sha256(s_name || 'w') END AS evaluation_weights_sha256,
               CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '2026-01-01' + to_days(CAST(s_suppkey AS INT)) END AS evaluated_at,
               CASE WHEN s_suppkey % 9 = 0 THEN TIMESTAMP '2026-03-01' END AS disk_deleted_at
        FROM supplier""",
    "remote": """
        SELECT s_name AS key, 'Disk ' || s_name AS label, s_suppkey % 3 = 0 AS loaded, s_suppkey % 2 = 0 AS evaluated,
               abs(s_acctbal) / 10000.0::DOUBLE AS cer, abs(s_acctbal) / 9000.0::DOUBLE AS wer, s_suppkey AS samples
        FROM supplier WHERE s_acctbal >= 0
        UNION ALL SELECT n_name, NULL, false, false, NULL, NULL, NULL FROM nation""",
    "manifest": """
        SELECT CASE WHEN n % 41 = 0 THEN '' ELSE file END AS filename,
               CASE WHEN n % 13 = 0 THEN '  ' WHEN n % 17 = 0 THEN ' unreadable ' ELSE text END AS label,
               CASE WHEN n % 10 < 6 THEN 'train' WHEN n % 10 < 8 THEN ' Val ' WHEN n % 31 = 0 THEN '' WHEN n % 29 = 0 THEN 'dev'
                    ELSE 'test' END AS split, n AS ord
        FROM (SELECT *, conv_id * 101 + turn AS n, 'c' || conv_id || '-' || turn || '.png' AS file FROM conversations)""",
    "rows_": """
        SELECT trim(filename) AS filename, lower(trim(split)) AS split, trim(label) AS label, ord FROM manifest""",
    "images": """
        SELECT CASE WHEN n % 10 < 6 THEN 'train' WHEN n % 10 < 8 THEN 'val' ELSE 'test' END AS split,
               'c' || conv_id || '-' || turn || '.png' AS filename, CAST(length(text) * 10 AS BIGINT) AS length
        FROM (SELECT *, conv_id * 101 + turn AS n FROM conversations) WHERE role <> 'system'
        UNION ALL SELECT 'test', 'p' || page_id || '.PNG', CAST(length(html) AS BIGINT) FROM pages""",
    "preds": """
        SELECT 'c' || conv_id || '-' || turn || '.png' AS filename, role, text AS reference,
               CASE n % 3 WHEN 0 THEN replace(replace(text, 'en', 'm'), 'e', 'c')
                          WHEN 1 THEN regexp_replace(text, ' [a-z]+ ', ' ', 'g') ELSE text END AS hypothesis,
               CAST(n % 1000 AS DOUBLE) / 10.0::DOUBLE AS confidence,
               CASE WHEN n % 23 = 0 THEN 'cannot open file' END AS error
        FROM (SELECT *, conv_id * 101 + turn AS n FROM conversations)""",
    "persisted": """
        SELECT record_id, id AS field_id, CASE WHEN person_group IS NULL THEN 'details' ELSE 'person' END AS kind,
               coalesce(person_group, 0) AS number,
               CASE WHEN person_group IS NULL THEN 'document-details' ELSE 'person-' || person_group END AS group_id,
               CASE WHEN person_group IS NULL THEN 'Document details' ELSE 'Person 0' || person_group END AS label,
               CAST(row_number() OVER (PARTITION BY record_id, person_group ORDER BY
                 CASE WHEN person_group IS NULL THEN sort_order ELSE coalesce(person_field_order, sort_order) END,
                 sort_order, id) - 1 AS INT) AS position, name, ocr_text, verified_value, width
        FROM fields""",
    "history": """
        SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS epoch,
               CASE WHEN user_id % 4 <> 0 THEN round(value, 2) END AS val_loss, round(value + 1, 2) AS train_loss,
               CAST(event_id % 100 + 1 AS DOUBLE) AS seconds,
               CASE WHEN user_id % 4 <> 0 THEN round(value, 2) ELSE round(value + 1, 2) END AS loss
        FROM events""",
    "proposed": """
        SELECT i.id AS item_id, i.change_request_id AS request_id, q.record_id, i.record_field_id, f.name, f.verified_value,
               f.is_required, nullif(trim(i.proposed_value), '') AS new_value, nullif(trim(f.verified_value), '') AS now_value,
               q.created_at
        FROM items i JOIN requests q ON q.id = i.change_request_id
        JOIN fields f ON f.id = i.record_field_id AND f.record_id = q.record_id""",
    "judged": """
        SELECT q.*, r.status AS record_status, r.registry_number, coalesce(v.changes, 0) AS changes,
               q.changes_registry_number AND q.proposed_registry_number IS DISTINCT FROM r.registry_number AS renumber,
               CASE WHEN r.id IS NULL THEN 'unknown_record' WHEN r.status <> 'submitted' THEN 'not_locked'
                    WHEN p.record_id IS NOT NULL THEN 'already_pending' WHEN v.blank THEN 'required_blank'
                    WHEN coalesce(v.changes, 0) = 0 AND NOT (q.changes_registry_number
                         AND q.proposed_registry_number IS DISTINCT FROM r.registry_number) THEN 'no_change'
                    ELSE 'opened' END AS verdict
        FROM requests q LEFT JOIN records r ON r.id = q.record_id
        LEFT JOIN (SELECT DISTINCT record_id FROM requests WHERE status = 'pending') p ON p.record_id = q.record_id
        LEFT JOIN (SELECT request_id, count(*) FILTER (new_value IS DISTINCT FROM now_value) AS changes,
                          bool_or(is_required AND new_value IS NULL) AS blank FROM proposed GROUP BY 1) v ON v.request_id = q.id""",
    "opened": """
        SELECT *, CASE WHEN verdict IN ('unknown_record', 'not_locked') THEN verdict
                       WHEN (created_at, id) > (min(CASE WHEN verdict = 'opened' THEN (created_at, id) END) OVER (PARTITION BY record_id))
                       THEN 'already_pending' ELSE verdict END AS outcome,
               CAST(changes + CASE WHEN renumber THEN 1 ELSE 0 END AS BIGINT) AS change_count
        FROM judged""",
    "decided": """
        SELECT q.id AS request_id, q.record_id, q.requested_by, q.status, q.changes_registry_number, q.proposed_registry_number,
               q.created_at + INTERVAL 3 DAY AS reviewed_at,
               CASE WHEN q.id % 5 <> 0 THEN 'note ' || q.id ELSE 'no' END AS note,
               CASE WHEN q.status NOT IN ('pending', 'approved') THEN 'not_pending'
                    WHEN EXISTS (SELECT 1 FROM proposed p WHERE p.request_id = q.id AND p.is_required AND p.new_value IS NULL)
                    THEN 'required_blank' ELSE 'approved' END AS outcome
        FROM requests q""",
    "applying": """
        SELECT p.*, d.reviewed_at, row_number() OVER (PARTITION BY p.record_field_id ORDER BY d.reviewed_at, p.request_id) AS nth,
               lag(p.new_value) OVER (PARTITION BY p.record_field_id ORDER BY d.reviewed_at, p.request_id) AS before_value
        FROM proposed p JOIN decided d USING (request_id) WHERE d.outcome = 'approved'""",
    "renumbering": """
        SELECT d.*, r.registry_number, row_number() OVER (PARTITION BY d.record_id ORDER BY d.reviewed_at, d.request_id) AS nth,
               lag(d.proposed_registry_number) OVER (PARTITION BY d.record_id ORDER BY d.reviewed_at, d.request_id) AS before_value
        FROM decided d JOIN records r ON r.id = d.record_id WHERE d.outcome = 'approved' AND d.changes_registry_number""",
    "model_files": """
        SELECT s_name AS folder, filename, s_suppkey * 1000 + 7 AS length FROM supplier, (VALUES ('config.json'), ('model.safetensors'),
               ('pytorch_model.bin'), ('evaluation-report.json')) AS f(filename)
        WHERE filename = 'config.json' OR (filename = 'model.safetensors' AND s_suppkey % 3 <> 0)
           OR (filename = 'pytorch_model.bin' AND s_suppkey % 4 = 0) OR (filename = 'evaluation-report.json' AND s_suppkey % 5 = 0)""",
}


def with_views(sql: str) -> str:
    """Prefix the views a statement uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body, recursive = sql.strip(), ""
    if body.startswith("WITH RECURSIVE "):
        body, recursive = ", " + body[15:], "RECURSIVE "
    elif body.startswith("WITH "):
        body = ", " + body[5:]
    return f"WITH {recursive}{head}\n{body}"


def in_scope(first: str, last: str) -> str:
    """Inclusive local days, eight hours ahead of UTC."""
    return (f"status = 'submitted' AND submitted_at >= TIMESTAMP '{first}' - INTERVAL 8 HOUR "
            f"AND submitted_at < TIMESTAMP '{last}' + INTERVAL 1 DAY - INTERVAL 8 HOUR")


YEAR = in_scope("2000-07-01", "2001-06-15")
ALL_TIME = in_scope("1995-01-01", "2001-12-31")
QUARTER = in_scope("2001-01-10", "2001-03-20")

_DIFFERS = "ocr_text IS NOT NULL AND trim(ocr_text) <> trim(coalesce(verified_value, ''))"
_CORRECTED = "trim(coalesce(ocr_text, '')) <> trim(coalesce(verified_value, ''))"


def _quality(threshold: str, select: str = "", group: str = "", extra: str = "") -> str:
    return f"""
        SELECT {select} count(ocr_confidence) AS confidence_fields, round(avg(ocr_confidence), 1) AS average_confidence,
          count(*) FILTER (ocr_confidence < {threshold}) AS below_threshold,
          CASE WHEN count(ocr_confidence) > 0 THEN round((count(ocr_confidence) - count(*) FILTER (ocr_confidence < {threshold}))::DOUBLE
            / count(ocr_confidence) * 100, 1) END AS threshold_pass_rate,
          count(ocr_text) AS comparable_fields, count(*) FILTER ({_DIFFERS}) AS corrected_fields,
          CASE WHEN count(ocr_text) > 0 THEN round((count(*) FILTER ({_DIFFERS}))::DOUBLE / count(ocr_text) * 100, 1) END AS correction_rate
        FROM fields f JOIN (SELECT id AS rid, document_type_id FROM records WHERE {ALL_TIME}) s ON f.record_id = s.rid {extra} {group}"""


_TYPES = """
        SELECT t.id AS document_type_id, t.key, t.name, coalesce(c.n, 0) AS total,
          CASE WHEN (SELECT sum(n) FROM c) > 0 THEN round(coalesce(c.n, 0)::DOUBLE / (SELECT sum(n) FROM c)::DOUBLE * 100, 1) ELSE 0.0::DOUBLE END AS share
        FROM document_types t LEFT JOIN c ON c.document_type_id = t.id"""


def _trend(scope: str, unit: str, first: str, last: str) -> str:
    return f"""
        WITH n AS (SELECT date_trunc('{unit}', submitted_at + INTERVAL 8 HOUR)::DATE AS bucket, document_type_id, count(*) AS n
                   FROM records WHERE {scope} GROUP BY 1, 2),
        days AS (SELECT unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 {unit}))::DATE AS bucket)
        SELECT CAST(d.bucket AS VARCHAR) AS bucket, t.id AS document_type_id, coalesce(t.short_name, t.name) AS series, coalesce(n.n, 0) AS total
        FROM days d CROSS JOIN document_types t LEFT JOIN n ON n.bucket = d.bucket AND n.document_type_id = t.id"""


def _violations(*rules: tuple[str, str]) -> str:
    """'; '-joined texts of the broken rules."""
    cells = ", ".join(f"CASE WHEN {broken} THEN '{text}' END" for broken, text in rules)
    return f"concat_ws('; ', {cells})"


def _geometry(side: str) -> list[tuple[str, str]]:
    shown = {"0.00001": "1e-05"}.get(side, side)
    return [
        ("x IS NULL OR x NOT BETWEEN 0 AND 1", "x: between 0 and 1"),
        ("y IS NULL OR y NOT BETWEEN 0 AND 1", "y: between 0 and 1"),
        (f"width IS NULL OR width NOT BETWEEN {side} AND 1", f"width: between {shown} and 1"),
        (f"height IS NULL OR height NOT BETWEEN {side} AND 1", f"height: between {shown} and 1"),
        ("x + width > 1.00001", "width: beyond the document width"),
        ("y + height > 1.00001", "height: beyond the document height"),
    ]


_BOTH = ("(person_group IS NULL) <> (person_field_order IS NULL)", "person_group: group and order belong together")

# One byte per character, so that the byte distance is the distance over code points.
_ACCENTS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_CODES = " || ".join(f"chr({i})" for i in [*range(1, 10), *range(14, 14 + len(_ACCENTS) - 9)])


def _bytes(c: str) -> str:
    return f"translate({c}, '{_ACCENTS}', {_CODES})"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


# Word edit distance of every pair: one step per reference word, the table row carried as a list.
def _steps(prefix: str) -> str:
    return f"""{prefix}steps AS (
          SELECT k, ref, hyp, 0 AS i, range(0, len(hyp) + 1) AS line FROM {prefix}tok
          UNION ALL
          SELECT k, ref, hyp, i + 1, list_reduce(range(1, len(hyp) + 1), lambda acc, j:
            list_append(acc, least(acc[j] + 1, line[j + 1] + 1, line[j] + CASE WHEN hyp[j] = ref[i + 1] THEN 0 ELSE 1 END)), [i + 1])
          FROM {prefix}steps WHERE i < len(ref))"""


def _distances(source: str, prefix: str = "", by: str = "") -> str:
    """``source``: a FROM clause giving reference, hypothesis and a unique k."""
    return f"""{prefix}p AS (SELECT {by + ',' if by else ''} k, reference, hypothesis FROM {source}),
        {prefix}tok AS (SELECT k, {_tokens('reference')} AS ref, {_tokens('hypothesis')} AS hyp FROM {prefix}p),
        {_steps(prefix)},
        {prefix}w AS (SELECT k, line[len(line)] AS word_errors, len(ref) AS words FROM {prefix}steps WHERE i = len(ref)),
        {prefix}d AS (SELECT p.*, levenshtein({_bytes('reference')}, {_bytes('hypothesis')}) AS char_errors, length(reference) AS chars,
                     word_errors, words FROM {prefix}p p JOIN {prefix}w USING (k))"""


def _rates(rounding: str, accuracy: str = "accuracy") -> str:
    exact = "count(*) FILTER (reference = hypothesis)"
    parts = {"cer": ("sum(char_errors)", "sum(chars)"), "wer": ("sum(word_errors)", "sum(words)"), accuracy: (exact, "count(*)")}
    return ", ".join(f"coalesce({rounding.format(f'{n}::DOUBLE / nullif({d}, 0)')}, 0.0) AS {name}" for name, (n, d) in parts.items()
                     ) + f", {exact} AS exact, count(*) AS total"


_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("char_errors", "chars", "word_errors", "words"))


def _metrics(source: str, by: str = "") -> str:
    return f"""WITH RECURSIVE {_distances(source, by=by)}
        SELECT {by + ',' if by else ''} {_rates('round({}, 9)')}, {_SUMS} FROM d {'GROUP BY ' + by if by else ''}"""


_PAIRS = "(SELECT filename AS k, role, reference, hypothesis FROM preds)"
_FIELD_PAIRS = "(SELECT id AS k, verified_value AS reference, coalesce(ocr_text, '') AS hypothesis FROM fields)"
_SCORED = """(SELECT s.filename AS k, trim(s.label) AS reference, trim(p.hypothesis) AS hypothesis FROM (
            SELECT filename, arg_max(label, ord) AS label FROM manifest WHERE lower(trim(split)) = 'test' GROUP BY 1) s
          JOIN (SELECT DISTINCT filename FROM images WHERE split = 'test') g USING (filename)
          JOIN preds p ON p.filename = s.filename AND p.error IS NULL
          WHERE trim(s.label) <> '' AND upper(trim(s.label)) <> 'UNREADABLE')"""


def _read_rows(listed: str) -> str:
    return f"SELECT filename, CAST(length(label) AS INT) AS label_length FROM ({listed}) WHERE trim(label) <> '' AND upper(trim(label)) <> 'UNREADABLE'"


_STAMP = "'%Y-%m-%d %H:%M:%S'"

_SQL: dict[str, str] = {
    # ------------------------------------------------------------ dashboard
    "ocr_quality_by_type": f"""
        WITH c AS (SELECT document_type_id, count(*) AS n FROM records WHERE {ALL_TIME} GROUP BY 1), t AS ({_TYPES}),
        q AS ({_quality('80', 's.document_type_id,', 'GROUP BY s.document_type_id')})
        SELECT t.*, coalesce(confidence_fields, 0) AS confidence_fields, coalesce(below_threshold, 0) AS below_threshold,
          coalesce(comparable_fields, 0) AS comparable_fields, coalesce(corrected_fields, 0) AS corrected_fields,
          average_confidence, threshold_pass_rate, correction_rate
        FROM t LEFT JOIN q USING (document_type_id)""",
    "headline": f"""
        SELECT count(*) FILTER (status = 'submitted') AS records, count(*) FILTER ({YEAR}) AS period_records FROM records""",
    "records_by_type": f"""
        WITH c AS (SELECT document_type_id, count(*) AS n FROM records WHERE {YEAR} GROUP BY 1) {_TYPES}""",
    "record_trend_monthly": _trend(YEAR, "month", "2000-07-01", "2001-06-15"),
    "record_trend_daily": _trend(QUARTER, "day", "2001-01-10", "2001-03-20"),
    "trend_totals": f"""
        WITH n AS (SELECT date_trunc('month', submitted_at + INTERVAL 8 HOUR)::DATE AS bucket, count(*) AS n FROM records WHERE {ALL_TIME} GROUP BY 1)
        SELECT CAST(d AS VARCHAR) AS bucket, coalesce(n, 0) AS total
        FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 MONTH))::DATE AS d) LEFT JOIN n ON bucket = d""",
    "growth_rate": f"""
        WITH n AS (SELECT count(*) FILTER (submitted_at + INTERVAL 8 HOUR >= TIMESTAMP '2001-06-01') AS latest,
          count(*) FILTER (submitted_at + INTERVAL 8 HOUR >= TIMESTAMP '2001-05-01' AND submitted_at + INTERVAL 8 HOUR < TIMESTAMP '2001-06-01') AS previous
          FROM records WHERE {YEAR})
        SELECT latest, previous, CASE WHEN previous > 0 THEN round((latest - previous)::DOUBLE / previous * 100, 1) END AS growth_rate FROM n""",
    "ocr_quality": _quality("80"),
    "ocr_quality_stored_threshold": _quality("70.5"),
    "throughput": f"""
        SELECT t.submitted_by, coalesce(u.name, 'Removed account') AS name,
          CASE u.role_slug WHEN 'admin' THEN 'Admin' WHEN 'super_admin' THEN 'Super Admin' ELSE 'Staff' END AS role, total
        FROM (SELECT submitted_by, count(*) AS total FROM records WHERE {ALL_TIME} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6) t
        LEFT JOIN users u ON u.id = t.submitted_by""",
    "account_health": "SELECT count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive FROM users",
    "staff_counts": """
        SELECT (SELECT count(*) FROM records WHERE submitted_by = 7 AND status = 'submitted' AND submitted_at >= TIMESTAMP '1999-05-31 16:00:00')
          AS submitted_this_month, (SELECT count(*) FROM requests WHERE requested_by = 7 AND status = 'pending') AS pending_change_requests""",
    "staff_recent": f"""
        SELECT id, strftime(submitted_at, {_STAMP}) AS submitted_at FROM records WHERE submitted_by = 7 AND status = 'submitted'
        ORDER BY records.submitted_at DESC, id DESC LIMIT 5""",
    # -------------------------------------------------------------- reports
    "report_filter": f"""
        SELECT r.id, r.status, strftime(created_at, {_STAMP}) AS created_at FROM records r JOIN document_types t ON t.id = r.document_type_id
        WHERE t.key = 'asia' AND status = 'submitted' AND r.created_at >= TIMESTAMP '1996-01-31 16:00:00'
          AND r.created_at < TIMESTAMP '2000-11-30 16:00:00'""",
    "report_summary": """
        WITH m AS (SELECT * FROM records WHERE created_at >= TIMESTAMP '1996-01-31 16:00:00' AND created_at < TIMESTAMP '2000-11-30 16:00:00')
        SELECT count(*) AS total, count(*) FILTER (status = 'submitted') AS submitted, count(*) FILTER (status = 'draft') AS drafts,
          (SELECT round(avg(ocr_confidence), 1) FROM fields WHERE record_id IN (SELECT id FROM m)) AS average_confidence FROM m""",
    "report_rows": f"""
        SELECT r.id AS record_id, r.registry_number,
          coalesce(t.name, CASE doc_type WHEN 'birth' THEN 'Birth Certificate' WHEN 'death' THEN 'Death Certificate'
            WHEN 'marriage' THEN 'Marriage Certificate' ELSE 'Custom Document' END) AS document_type,
          CASE r.status WHEN 'draft' THEN 'Draft' ELSE 'Submitted' END AS status, coalesce(f.title, 'Untitled record') AS primary_value,
          strftime(r.created_at, {_STAMP}) AS created_at, c.name AS created_by, strftime(r.submitted_at, {_STAMP}) AS submitted_at,
          s.name AS submitted_by, r.ocr_model_key AS ocr_model, coalesce(f.n, 0) AS fields, f.average_confidence
        FROM records r LEFT JOIN document_types t ON t.id = r.document_type_id LEFT JOIN users c ON c.id = r.created_by
        LEFT JOIN users s ON s.id = r.submitted_by
        LEFT JOIN (SELECT record_id, count(*) AS n, round(avg(ocr_confidence), 1) AS average_confidence,
                     arg_min(verified_value, (sort_order, id)) FILTER (trim(verified_value) <> '') AS title FROM fields GROUP BY 1) f
          ON f.record_id = r.id""",
    "record_title": """
        SELECT record_id, coalesce(arg_min(verified_value, (sort_order, id)) FILTER (trim(verified_value) <> ''), 'Untitled record') AS title
        FROM fields GROUP BY 1""",
    "enrich_records": """
        SELECT r.id, c.name AS creator_name, s.name AS submitter_name,
          coalesce(t.name, CASE doc_type WHEN 'birth' THEN 'Birth Certificate' WHEN 'death' THEN 'Death Certificate'
            WHEN 'marriage' THEN 'Marriage Certificate' ELSE 'Custom Document' END) AS type_label,
          coalesce(t.short_name, t.name, CASE doc_type WHEN 'birth' THEN 'Birth' WHEN 'death' THEN 'Death' WHEN 'marriage' THEN 'Marriage'
            ELSE 'Custom' END) AS type_short_label
        FROM records r LEFT JOIN document_types t ON t.id = r.document_type_id LEFT JOIN users c ON c.id = r.created_by
        LEFT JOIN users s ON s.id = r.submitted_by""",
    # --------------------------------------------------------------- search
    "archive_search": f"""
        SELECT id, registry_number, strftime(submitted_at, {_STAMP}) AS submitted_at FROM records r
        WHERE submitted_at >= TIMESTAMP '1996-01-01' AND r.submitted_at < TIMESTAMP '2001-07-01'
          AND (registry_number ILIKE '%t 12%' OR id IN (SELECT record_id FROM fields WHERE verified_value ILIKE '%t 12%'))""",
    "archive_search_wildcard": """
        SELECT r.id, registry_number FROM records r JOIN document_types t ON t.id = r.document_type_id
        WHERE t.key = 'america' AND status = 'submitted'
          AND (registry_number ILIKE '%R-1_3%' OR r.id IN (SELECT record_id FROM fields WHERE verified_value ILIKE '%R-1_3%'))""",
    "audit_filter": f"""
        SELECT id, user_id, description, strftime(created_at, {_STAMP}) AS created_at FROM audit a
        WHERE action = 'record.click' AND a.created_at >= TIMESTAMP '2024-01-02' AND a.created_at < TIMESTAMP '2024-01-21'
          AND (description ILIKE '%entry #1%' OR coalesce(actor_name, '') ILIKE '%entry #1%')""",
    "audit_page": f"""
        SELECT id, action, strftime(created_at, {_STAMP}) AS created_at FROM audit a ORDER BY a.created_at DESC, id DESC LIMIT 25 OFFSET 50""",
    "audit_seek": f"""
        SELECT id, action, strftime(created_at, {_STAMP}) AS created_at FROM audit a
        WHERE (a.created_at, id) < (SELECT (k.created_at, k.id) FROM audit k WHERE k.id = 500)
        ORDER BY a.created_at DESC, id DESC LIMIT 25""",
    "own_recent_activity": f"""
        SELECT id, action, strftime(created_at, {_STAMP}) AS created_at FROM audit a WHERE user_id = 7
        ORDER BY a.created_at DESC, id DESC LIMIT 6""",
    "audit_page_info": "SELECT count(*) AS total, count(*) > 75 AS has_more FROM audit",
    "recorded_actions": "SELECT DISTINCT action FROM audit",
    "known_actors": "SELECT id, name FROM users WHERE id IN (SELECT user_id FROM audit WHERE user_id IS NOT NULL)",
    "user_search": """
        SELECT id, name, email FROM users WHERE (name ILIKE '%000012%' OR email ILIKE '%000012%') AND is_active AND role_slug = 'staff'""",
    "data_entry_users": "SELECT id, name, CAST(role_id AS BIGINT) AS role_id FROM users WHERE role_slug IN ('staff', 'super_admin')",
    "request_search_moderator": """
        SELECT q.id, q.record_id, q.status FROM requests q LEFT JOIN records r ON r.id = q.record_id
        LEFT JOIN document_types t ON t.id = r.document_type_id LEFT JOIN users u ON u.id = q.requested_by
        WHERE coalesce(reason ILIKE '%77%', false) OR coalesce(registry_number ILIKE '%77%', false) OR coalesce(t.name ILIKE '%77%', false)
          OR coalesce(t.short_name ILIKE '%77%', false) OR coalesce(u.name ILIKE '%77%', false) OR q.id = 77 OR r.id = 77""",
    "request_search_own": """
        SELECT q.id, q.record_id, q.status FROM requests q LEFT JOIN records r ON r.id = q.record_id
        LEFT JOIN document_types t ON t.id = r.document_type_id
        WHERE requested_by = 7 AND q.status = 'pending' AND (coalesce(reason ILIKE '%euro%', false) OR coalesce(registry_number ILIKE '%euro%', false)
          OR coalesce(t.name ILIKE '%euro%', false) OR coalesce(t.short_name ILIKE '%euro%', false))""",
    "request_queue_page": f"""
        SELECT id, status, strftime(created_at, {_STAMP}) AS created_at FROM requests q
        ORDER BY status = 'pending' DESC, q.created_at DESC, id DESC LIMIT 15 OFFSET 15""",
    "status_counts": "SELECT status, count(*) AS total FROM requests GROUP BY 1",
    "status_counts_own": "SELECT status, count(*) AS total FROM requests WHERE requested_by = 7 GROUP BY 1",
    "needs_review": "SELECT id, record_id, ocr_confidence FROM fields WHERE ocr_confidence < 80",
    # ------------------------------------------------------------- counting
    "usage_counts": """
        SELECT t.id, t.name, t.is_system, (SELECT count(*) FROM templates p WHERE p.document_type_id = t.id) AS templates_count,
          (SELECT count(*) FROM templates p WHERE p.document_type_id = t.id AND NOT is_active) AS drafts_count,
          (SELECT count(*) FROM records r WHERE r.document_type_id = t.id) AS records_count FROM document_types t""",
    "template_usage": """
        SELECT t.id, t.name, t.document_type_id, t.is_active, coalesce(f.n, 0) AS fields_count, coalesce(f.g, 0) AS person_groups,
          coalesce(r.n, 0) AS records_count
        FROM templates t LEFT JOIN (SELECT document_template_id AS i, count(*) AS n, count(DISTINCT person_group) AS g FROM template_fields GROUP BY 1) f ON f.i = t.id
        LEFT JOIN (SELECT document_template_id AS i, count(*) AS n FROM records GROUP BY 1) r ON r.i = t.id""",
    "person_group_count": "SELECT document_template_id, count(DISTINCT person_group) AS person_groups FROM template_fields GROUP BY 1",
    "change_count": """
        SELECT q.id, CAST(coalesce(n, 0) + CASE WHEN changes_registry_number THEN 1 ELSE 0 END AS BIGINT) AS change_count
        FROM requests q LEFT JOIN (SELECT change_request_id AS i, count(*) AS n FROM items GROUP BY 1) ON i = q.id""",
    "last_active_admin_guard": """
        SELECT id, name, role_slug = 'super_admin' AND (SELECT count(*) FROM users o WHERE o.role_slug = 'super_admin' AND o.is_active)
          - CASE WHEN is_active THEN 1 ELSE 0 END = 0 AS is_last_active_admin FROM users""",
    "record_detail_counts": f"""
        WITH a AS (SELECT * FROM requests WHERE status = 'approved'),
        t AS (SELECT a.record_id, count(DISTINCT record_field_id) AS n FROM items i JOIN a ON a.id = i.change_request_id GROUP BY 1),
        g AS (SELECT record_id, bool_or(changes_registry_number) AS c FROM a GROUP BY 1),
        f AS (SELECT record_id, count(*) AS n, count(*) FILTER ({_CORRECTED}) AS c FROM fields GROUP BY 1)
        SELECT r.id, coalesce(f.n, 0) AS field_count, coalesce(f.c, 0) AS ocr_adjusted_count, coalesce(g.c, false) AS registry_was_corrected,
          CAST(coalesce(t.n, 0) + CASE WHEN g.c THEN 1 ELSE 0 END AS BIGINT) AS post_submission_changes
        FROM records r LEFT JOIN f ON f.record_id = r.id LEFT JOIN t ON t.record_id = r.id LEFT JOIN g ON g.record_id = r.id""",
    "review_summary": """
        SELECT record_id, count(*) AS readings, round(avg(coalesce(ocr_confidence, 0)), 1) AS average_confidence,
          count(*) FILTER (coalesce(ocr_confidence, 0) < 80) AS flagged FROM fields GROUP BY 1""",
    "verification_state": """
        WITH g AS (SELECT record_id, person_group, count(*) FILTER (trim(verified_value) <> '') AS verified, count(*) AS total FROM fields GROUP BY 1, 2)
        SELECT *, verified = total AS checked, verified > 0 AND verified < total AS indeterminate FROM g""",
    # -------------------------------------------------------------- layouts
    "template_requiredness": """
        WITH k AS (SELECT document_template_id AS t, 'field ' || (id % 6 + 1) AS name, arg_max(is_required, (sort_order, id)) AS req FROM template_fields GROUP BY 1, 2)
        SELECT f.id, coalesce(k.req, true) AS is_required FROM fields f JOIN records r ON r.id = f.record_id
        LEFT JOIN k ON k.t = r.document_template_id AND k.name = lower(trim(f.name))""",
    "active_template_per_type": """
        SELECT t.id, a.i AS template_id, a.n AS template_name FROM document_types t LEFT JOIN
          (SELECT document_type_id AS d, min(id) AS i, arg_min(name, id) AS n FROM templates WHERE is_active GROUP BY 1) a ON a.d = t.id""",
    "template_matches_type": f"""
        SELECT r.id, {_violations(("p.document_type_id IS NULL OR r.document_type_id IS NULL OR p.document_type_id <> r.document_type_id",
                                   "document_template_id: does not belong to this document type"),
                                  ("m.key IS NULL", "ocr_model_key: not a registered model"))} AS violations
        FROM records r LEFT JOIN templates p ON p.id = r.document_template_id
        LEFT JOIN (SELECT key FROM ocr_models WHERE disk_deleted_at IS NULL) m ON m.key = r.ocr_model_key""",
    "ordered_templates": "SELECT id, document_type_id, is_active FROM templates",
    "publish_templates": """
        SELECT id, id = max(id) OVER (PARTITION BY document_type_id) AS is_active FROM templates""",
    "active_violations": """
        SELECT document_type_id, count(*) AS active_rows FROM templates WHERE is_active GROUP BY 1 HAVING count(*) > 1""",
    "canonicalize_groups": """
        SELECT f.id, f.document_template_id,
          CAST(CASE WHEN t.grouping_mode = 'custom' AND person_group IS NOT NULL THEN
            dense_rank() OVER (PARTITION BY f.document_template_id, person_group IS NULL ORDER BY person_group) END AS INT) AS person_group,
          CAST(CASE WHEN t.grouping_mode <> 'custom' THEN NULL WHEN person_group IS NULL THEN person_field_order ELSE
            row_number() OVER (PARTITION BY f.document_template_id, person_group ORDER BY coalesce(person_field_order, 0), sort_order) - 1 END AS INT) AS person_field_order
        FROM template_fields f JOIN templates t ON t.id = f.document_template_id""",
    "group_selected": """
        SELECT id AS index, document_template_id AS document_id,
          CAST(CASE WHEN is_required THEN person_group ELSE coalesce(max(person_group) OVER (PARTITION BY document_template_id), 0) + 1 END AS INT) AS person_group,
          CAST(CASE WHEN is_required THEN person_field_order ELSE
            row_number() OVER (PARTITION BY document_template_id, is_required ORDER BY x, y, id) - 1 END AS INT) AS person_field_order
        FROM template_fields""",
    "boxes_in_region": """
        SELECT f.id, f.record_id AS document_id FROM fields f JOIN records r ON r.id = f.record_id
        WHERE x IS NOT NULL AND (r.id % 251 > 2 OR r.id % 173 > 2)
          AND (x + width) * 800 >= r.id % 500 AND x * 800 <= r.id % 500 + r.id % 251
          AND (y + height) * 1100 >= r.id % 300 AND y * 1100 <= r.id % 300 + r.id % 173""",
    # ------------------------------------------------------------- grouping
    "field_groups_persisted": "SELECT record_id, field_id, kind, number, group_id, label, position FROM persisted",
    "group_summary": f"""
        SELECT record_id, kind, number, group_id, label, count(*) AS field_count, count(*) FILTER ({_CORRECTED}) AS corrected_count,
          CASE WHEN kind = 'person' THEN coalesce(
            CASE WHEN count(*) = 11 THEN max(nullif(trim(verified_value), '')) FILTER (position = 2) END,
            arg_max(trim(verified_value), (width, -position)) FILTER (length(trim(verified_value)) >= 3 AND regexp_matches(verified_value, '[a-z]')),
            count(*) || ' verified fields') END AS identity
        FROM persisted GROUP BY record_id, kind, number, group_id, label""",
    "record_headings": """
        WITH e AS (SELECT record_id, count(*) AS n, bool_and(trim(verified_value) <> '') AS numbered,
            arg_min(trim(verified_value), number) AS a, arg_max(trim(verified_value), number) AS z
          FROM persisted WHERE kind = 'person' AND position = 0 GROUP BY 1),
        h AS (SELECT r.id, registry_number, e.*, coalesce(t.short_name, t.name, CASE doc_type WHEN 'birth' THEN 'Birth' WHEN 'death' THEN 'Death'
            WHEN 'marriage' THEN 'Marriage' ELSE 'Custom' END) AS kind
          FROM records r LEFT JOIN e ON e.record_id = r.id LEFT JOIN document_types t ON t.id = r.document_type_id)
        SELECT id, CASE WHEN n IS NULL THEN coalesce(registry_number, kind || ' record #' || id)
          WHEN numbered AND a = z THEN kind || ' · Entry ' || a WHEN numbered THEN kind || ' · Entries ' || a || '–' || z
          ELSE kind || ' · ' || n || ' people' END AS heading FROM h""",
    "person_counts": "SELECT record_id, count(DISTINCT number) AS person_count FROM persisted WHERE kind = 'person' GROUP BY 1",
    "request_detail": """
        SELECT i.id, p.record_id, p.group_id, p.position FROM items i JOIN persisted p ON p.field_id = i.record_field_id""",
    "request_detail_orphans": """
        SELECT id, record_field_id FROM items WHERE record_field_id NOT IN (SELECT field_id FROM persisted)""",
    "column_labels": """
        WITH b AS (SELECT id, name, record_id // 64 AS sheet, row_number() OVER (PARTITION BY record_id // 64 ORDER BY id) - 1 AS place FROM fields),
        c AS (SELECT *, count(*) OVER (PARTITION BY sheet, place // 11) AS size FROM b)
        SELECT id AS field_id, CASE WHEN size = 11 AND place // 11 > 0 AND place // 11 % 2 = 0
          THEN ['Entry no.', 'Date registered', 'Child''s name', 'Sex', 'Date of birth', 'Place of birth', 'Father''s name', 'Mother''s name',
                'Nationality', 'Informant', 'Remarks'][place % 11 + 1]
          ELSE coalesce(nullif(name, ''), 'Field ' || (place % 11 + 1)) END AS column_label FROM c""",
    # ------------------------------------------------------------- workflow
    "open_requests": "SELECT id AS proposal_id, record_id, outcome, change_count FROM opened",
    "open_requests_items": """
        SELECT p.request_id AS proposal_id, p.record_field_id, p.verified_value AS current_value, p.new_value AS proposed_value
        FROM proposed p JOIN opened o ON o.id = p.request_id WHERE o.outcome = 'opened' AND p.new_value IS DISTINCT FROM p.now_value""",
    "opened_audit": """
        SELECT id AS auditable_id, requested_by AS user_id, 'Requested ' || change_count || ' change(s) on record #' || record_id || '.' AS description,
          CAST(changes AS VARCHAR) AS field_count FROM opened WHERE outcome = 'opened'""",
    "approve_outcomes": "SELECT request_id, outcome FROM decided",
    "approve_fields": """
        SELECT f.id, CASE WHEN a.f IS NOT NULL THEN a.v.v ELSE f.verified_value END AS verified_value
        FROM fields f LEFT JOIN (SELECT record_field_id AS f, arg_max({'v': new_value}, nth) AS v FROM applying GROUP BY 1) a ON a.f = f.id""",
    "approve_records": """
        SELECT r.id, CASE WHEN a.i IS NOT NULL THEN a.v.v ELSE r.registry_number END AS registry_number
        FROM records r LEFT JOIN (SELECT record_id AS i, arg_max({'v': proposed_registry_number}, nth) AS v FROM renumbering GROUP BY 1) a ON a.i = r.id""",
    "approve_requests": f"""
        SELECT q.id, CASE WHEN d.outcome = 'approved' THEN 'approved' WHEN q.status = 'approved' THEN 'pending' ELSE q.status END AS status,
          CASE WHEN d.outcome = 'approved' THEN q.requested_by ELSE q.reviewed_by END AS reviewed_by,
          strftime(CASE WHEN d.outcome = 'approved' THEN d.reviewed_at ELSE q.reviewed_at END, {_STAMP}) AS reviewed_at,
          CASE WHEN d.outcome = 'approved' THEN d.note END AS decision_note FROM requests q JOIN decided d ON d.request_id = q.id""",
    "approve_applied": """
        SELECT request_id, item_id, name, CASE WHEN nth = 1 THEN verified_value ELSE before_value END AS old_value, new_value FROM applying
        UNION ALL SELECT request_id, NULL, 'Registry Number', CASE WHEN nth = 1 THEN registry_number ELSE before_value END, proposed_registry_number FROM renumbering""",
    "approved_audit": """
        WITH n AS (SELECT request_id, count(DISTINCT name) AS n FROM applying GROUP BY 1),
        e AS (
          SELECT request_id, item_id, coalesce(name, '') AS name, CASE WHEN nth = 1 THEN verified_value ELSE before_value END AS old_value, new_value FROM applying
          UNION ALL SELECT request_id, NULL, 'Registry Number', CASE WHEN nth = 1 THEN registry_number ELSE before_value END, proposed_registry_number FROM renumbering),
        last AS (SELECT *, row_number() OVER (PARTITION BY request_id, name ORDER BY item_id IS NULL DESC, item_id DESC) AS back FROM e),
        m AS (
          SELECT request_id, '{' || string_agg(to_json(name) || ':' || coalesce(to_json(old_value), 'null'), ',' ORDER BY name) || '}' AS old_values,
            '{' || string_agg(to_json(name) || ':' || coalesce(to_json(new_value), 'null'), ',' ORDER BY name) || '}' AS new_values
          FROM last WHERE back = 1 GROUP BY 1)
        SELECT d.record_id AS auditable_id, d.requested_by AS user_id, 'Approved change request #' || d.request_id || ' and applied '
          || (coalesce(n.n, 0) + CASE WHEN d.changes_registry_number THEN 1 ELSE 0 END) || ' value(s).' AS description, m.old_values, m.new_values
        FROM decided d LEFT JOIN n USING (request_id) LEFT JOIN m USING (request_id) WHERE d.outcome = 'approved'""",
    "approved_entries": """
        WITH e AS (
          SELECT request_id, item_id, name, CASE WHEN nth = 1 THEN verified_value ELSE before_value END AS old_value, new_value FROM applying
          UNION ALL SELECT request_id, NULL, 'Registry Number', CASE WHEN nth = 1 THEN registry_number ELSE before_value END, proposed_registry_number FROM renumbering),
        last AS (SELECT *, row_number() OVER (PARTITION BY request_id, name ORDER BY item_id IS NULL DESC, item_id DESC) AS back FROM e)
        SELECT l.request_id, d.record_id, l.name, l.old_value, l.new_value FROM last l JOIN decided d USING (request_id) WHERE back = 1""",
    "reject_requests": """
        WITH d AS (SELECT id, requested_by, CASE WHEN id % 5 <> 0 THEN 'note ' || id ELSE 'no' END AS note, reviewed_by, status FROM requests),
        e AS (SELECT *, status = 'pending' AND length(note) BETWEEN 5 AND 2000 AS hit FROM d)
        SELECT id, CASE WHEN hit THEN 'rejected' ELSE status END AS status, CASE WHEN hit THEN requested_by ELSE reviewed_by END AS reviewed_by,
          CASE WHEN hit THEN note END AS decision_note FROM e""",
    "rejected_audit": """
        SELECT id AS auditable_id, requested_by AS user_id, 'Rejected change request #' || id || '. Reason: note ' || id AS description
        FROM requests WHERE status = 'pending' AND id % 5 <> 0 AND length('note ' || id) BETWEEN 5 AND 2000""",
    "withdraw_requests": """
        WITH w AS (SELECT id, status, CASE WHEN id % 3 = 0 THEN 'not_requester' WHEN status <> 'pending' THEN 'not_pending' ELSE 'withdrawn' END AS outcome FROM requests)
        SELECT id, CASE WHEN outcome = 'withdrawn' THEN 'withdrawn' ELSE status END AS status, outcome FROM w""",
    "one_pending_per_record": """
        SELECT record_id, count(*) AS pending, arg_min(id, (created_at, id)) AS first_request_id FROM requests
        WHERE status IN ('pending', 'withdrawn') GROUP BY 1 HAVING count(*) > 1""",
    "transition_check": f"""
        WITH m AS (SELECT id, status, CASE WHEN id % 7 <> 0 THEN reviewed_by END AS reviewed_by FROM requests)
        SELECT id, status = 'pending' AS is_open, {_violations(
            ("status IN ('approved', 'rejected') AND reviewed_by IS NULL", "reviewed_by: a decision needs a reviewer"),
            ("status NOT IN ('approved', 'rejected') AND reviewed_by IS NOT NULL", "reviewed_by: not decided"))} AS violations FROM m""",
    "field_change_history": """
        SELECT i.record_field_id, i.change_request_id, i.proposed_value,
          row_number() OVER (PARTITION BY i.record_field_id ORDER BY q.created_at DESC, q.id DESC) AS newest
        FROM items i JOIN requests q ON q.id = i.change_request_id WHERE q.status = 'approved'""",
    "submitted_audit": f"""
        WITH n AS (SELECT record_id, count(*) AS n, count(*) FILTER ({_CORRECTED}) AS c FROM fields GROUP BY 1)
        SELECT r.id AS auditable_id, r.submitted_by AS user_id, 'Submitted and locked a ' || coalesce(t.short_name, t.name, CASE doc_type
            WHEN 'birth' THEN 'Birth' WHEN 'death' THEN 'Death' WHEN 'marriage' THEN 'Marriage' ELSE 'Custom' END) || ' record.' AS description,
          coalesce(t.key, doc_type) AS document_type, registry_number, coalesce(n.n, 0) AS field_count, coalesce(n.c, 0) AS corrected_fields,
          ocr_model_key AS ocr_model
        FROM records r LEFT JOIN n ON n.record_id = r.id LEFT JOIN document_types t ON t.id = r.document_type_id WHERE r.status = 'submitted'""",
    "audit_diff_rows": """
        SELECT a.id, coalesce(actor_name, u.name, 'System') AS actor, k.key, k.before, k.after, k.before IS DISTINCT FROM k.after AS changed
        FROM (SELECT *, [{'key': 'value', 'before': CAST(value AS VARCHAR), 'after': NULL},
                         {'key': 'type', 'before': event_type, 'after': event_type},
                         {'key': 'k', 'before': NULL, 'after': json_extract_string(props, '$.k')},
                         {'key': 'password', 'before': NULL, 'after': '[redacted]'}] AS ks FROM audit) a
        CROSS JOIN unnest(a.ks) AS t(k) LEFT JOIN users u ON u.id = a.user_id""",
    # -------------------------------------------------------------- quality
    "check_fields_capture": "SELECT id, " + _violations(*_geometry("0.00001"), _BOTH, (
        "trim(verified_value) = ''", "verified_value: required")) + " AS violations FROM fields",
    "copy_names": r"""
        WITH e AS (SELECT document_template_id AS t, lower(name) AS n FROM template_fields),
        u AS (SELECT DISTINCT t, regexp_extract(n, '(?s)^(.*) copy( ([2-9]|[1-9][0-9]+))?$', 1) AS k,
            coalesce(try_cast(nullif(regexp_extract(n, '(?s)^(.*) copy( ([2-9]|[1-9][0-9]+))?$', 3), '') AS BIGINT), 1) AS num
            FROM e WHERE regexp_matches(n, '(?s)^(.*) copy( ([2-9]|[1-9][0-9]+))?$')),
        o AS (SELECT t, k, num - row_number() OVER (PARTITION BY t, k ORDER BY num) AS off FROM u),
        b AS (SELECT document_template_id AS t, CAST(sort_order AS INT) AS position, name, coalesce(nullif(trim(name), ''), 'Field') AS base FROM template_fields),
        c AS (SELECT *, row_number() OVER (PARTITION BY t, lower(base) ORDER BY position, name) AS n FROM b),
        m AS (SELECT c.t, c.position, c.name, c.base, c.n, c.n + count(o.off) AS m
            FROM c LEFT JOIN o ON o.t = c.t AND o.k = lower(c.base) AND o.off < c.n GROUP BY c.t, c.position, c.name, c.base, c.n)
        SELECT t AS document_template_id, position, name, base || CASE WHEN m = 1 THEN ' copy' ELSE ' copy ' || m END AS copy_name FROM m""",
    "check_fields_layout": "SELECT id, " + _violations(*_geometry("0.01"), _BOTH) + " AS violations FROM template_fields",
    "check_unique_names": """
        SELECT id, CASE WHEN count(*) OVER (PARTITION BY record_id, lower(trim(name))) > 1 THEN 'name: occurs more than once' ELSE '' END AS violations FROM fields""",
    "check_field_count": f"""
        SELECT r.id, coalesce(n, 0) AS field_count, {_violations(("n IS NULL", "fields: at least 1"), ("n > 450", "fields: at most 450"))} AS violations
        FROM records r LEFT JOIN (SELECT record_id, count(*) AS n FROM fields GROUP BY 1) f ON f.record_id = r.id""",
    "check_report_filters": "SELECT id, " + _violations(
        ("id % 3 = 0", "to: before from"), ("id % 4 = 1", "doc_type: unknown"), ("id % 5 = 0", "status: unknown"),
        ("id % 6 = 0", "submitted_by: unknown")) + " AS violations FROM records",
    "check_paper": "SELECT id, CASE WHEN paper_size = 'custom' THEN custom_width_mm END AS custom_width_mm, "
                   "CASE WHEN paper_size = 'custom' THEN custom_height_mm END AS custom_height_mm, " + _violations(
        ("paper_size = 'custom' AND (custom_width_mm IS NULL OR custom_width_mm NOT BETWEEN 50 AND 2000)", "custom_width_mm: between 50 and 2000"),
        ("paper_size = 'custom' AND (custom_height_mm IS NULL OR custom_height_mm NOT BETWEEN 50 AND 2000)", "custom_height_mm: between 50 and 2000"),
    ) + " AS violations FROM templates",
    "check_reason": "SELECT id, CASE WHEN id % 4 = 0 THEN 'reason: 10 to 2000 characters' ELSE '' END AS violations FROM requests",
    "check_type_names": """
        SELECT id, name AS clean_name, CASE WHEN count(*) OVER (PARTITION BY lower(name)) > 1 THEN 'name: already exists' ELSE '' END AS violations FROM template_fields""",
    "check_uploads": """
        SELECT split, filename, CASE WHEN length * 2000 > 20971520 THEN 'file: above 20 MB' ELSE '' END AS violations FROM images""",
    "explode_fields_json": """
        SELECT event_id AS id, CAST(j AS INT) AS sort_order, CASE j WHEN 0 THEN event_type ELSE 'value' END AS name,
          CASE j WHEN 0 THEN CAST(value AS VARCHAR) END AS verified_value, CASE j WHEN 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS x
        FROM events, (VALUES (0), (1)) AS t(j) WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0""",
    "explode_fields_json_rejected": """
        SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'the fields must be a list' WHEN event_id % 13 = 0 THEN 'the fields could not be read'
          ELSE 'the fields are missing' END AS reason FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0""",
    # --------------------------------------------------------------- models
    "active_models": "SELECT id, key FROM ocr_models WHERE is_active AND disk_deleted_at IS NULL",
    "selectable_models": """
        SELECT key, coalesce(label, key) AS label, key = (SELECT min(key) FROM ocr_models WHERE is_active AND disk_deleted_at IS NULL) AS is_active FROM remote""",
    "resolve_model": """
        SELECT id, CASE WHEN id % 3 <> 0 THEN ocr_model_key END AS requested_key,
          CASE WHEN id % 3 <> 0 AND ocr_model_key IN (SELECT key FROM remote) THEN ocr_model_key
               ELSE (SELECT min(key) FROM ocr_models WHERE is_active AND disk_deleted_at IS NULL) END AS model_key FROM records""",
    "model_overview": """
        SELECT coalesce(m.key, r.key) AS key, coalesce(m.label, r.label, m.key, r.key) AS label, coalesce(m.key, r.key) = 'base' AS is_base,
          r.key IS NOT NULL AS on_disk, coalesce(r.loaded, false) AS loaded, coalesce(m.is_active, false) AS is_active, m.key IS NOT NULL AS registered
        FROM ocr_models m FULL JOIN remote r ON r.key = m.key WHERE m.disk_deleted_at IS NULL""",
    "reconcile_models": """
        WITH s AS (SELECT coalesce(m.key, r.key) AS key, m.key AS mk, r.key AS rk, m.label AS ml, r.label AS rl, m.disk_deleted_at AS dd, m.is_active AS ia
          FROM ocr_models m FULL JOIN remote r ON r.key = m.key),
        a AS (SELECT *, CASE WHEN mk IS NULL THEN 'registered' WHEN rk IS NOT NULL AND dd IS NOT NULL THEN 'restored'
          WHEN rk IS NULL AND dd IS NULL THEN 'tombstoned' ELSE 'unchanged' END AS action FROM s)
        SELECT key, action, CASE action WHEN 'registered' THEN coalesce(rl, rk) WHEN 'restored' THEN coalesce(rl, ml) ELSE ml END AS label,
          coalesce(ia AND action <> 'tombstoned', false) AS is_active, action = 'tombstoned' OR (action = 'unchanged' AND dd IS NOT NULL) AS is_tombstoned,
          rk IS NOT NULL AS on_disk FROM a""",
    "reconcile_counts": """
        SELECT count(r.key) AS remote, count(*) FILTER (m.key IS NULL) AS registered,
          count(*) FILTER (r.key IS NOT NULL AND m.disk_deleted_at IS NOT NULL) AS restored,
          count(*) FILTER (r.key IS NULL AND m.disk_deleted_at IS NULL) AS tombstoned FROM ocr_models m FULL JOIN remote r ON r.key = m.key""",
    "missing_on_disk": "SELECT key FROM ocr_models WHERE key NOT IN (SELECT key FROM remote)",
    "sync_evaluations": f"""
        WITH n AS (SELECT m.*, r.key IS NOT NULL AS listed, r.evaluated AND r.samples > 0 AS ok, r.cer AS c2, r.wer AS w2, r.samples AS s2
          FROM ocr_models m LEFT JOIN remote r ON r.key = m.key)
        SELECT key, round(CASE WHEN NOT listed THEN cer WHEN ok THEN c2 END, 6) AS cer, round(CASE WHEN NOT listed THEN wer WHEN ok THEN w2 END, 6) AS wer,
          CASE WHEN NOT listed THEN evaluation_split WHEN ok THEN 'test' END AS evaluation_split,
          CASE WHEN NOT listed THEN evaluation_sample_count WHEN ok THEN s2 END AS evaluation_sample_count,
          strftime(CASE WHEN NOT listed THEN evaluated_at WHEN ok THEN TIMESTAMP '2026-02-01' END, {_STAMP}) AS evaluated_at,
          CASE WHEN NOT listed THEN NULL WHEN ok THEN 'evaluation_imported' WHEN cer IS NOT NULL THEN 'evaluation_cleared' END AS event FROM n""",
    "model_profiles": """
        WITH l AS (SELECT coalesce(r.key, m.key) AS key, coalesce(r.label, m.label, r.key) AS label, coalesce(m.is_active, false) AS is_active,
            r.key IS NULL AS late, coalesce(m.cer IS NOT NULL AND m.evaluation_split = 'test' AND m.evaluation_sample_count > 0, false) AS has_data,
            m.cer, m.wer, m.exact_match, m.evaluation_sample_count AS n, m.evaluated_at AS done
          FROM remote r FULL JOIN (SELECT * FROM ocr_models WHERE disk_deleted_at IS NULL) m ON m.key = r.key),
        o AS (SELECT *, row_number() OVER (ORDER BY NOT is_active, CASE WHEN is_active THEN false ELSE NOT has_data END, late, key) AS rn FROM l)
        SELECT key, label, is_active, has_data, CASE WHEN has_data THEN 'Locked test set' ELSE 'No benchmark' END AS source_label,
          CASE WHEN has_data THEN 'form-scans · test · ' || format('{:,}', n) || ' samples · evaluated ' || strftime(done, '%b %-d, %Y')
            ELSE 'Upload a model ZIP containing a valid evaluation-report.json from the locked test set.' END AS evidence,
          CASE WHEN has_data THEN n ELSE 0 END AS field_count, CASE WHEN has_data THEN round(greatest(0, least(1, 1 - cer)) * 100, 1) END AS character_accuracy,
          CASE WHEN has_data THEN round(greatest(0, least(1, 1 - wer)) * 100, 1) END AS word_accuracy,
          CASE WHEN has_data THEN round(greatest(0, least(1, exact_match)) * 100, 1) END AS exact_match, rn = 1 AS selected FROM o""",
    "model_inventory": """
        SELECT folder AS key, string_agg(filename, '; ' ORDER BY filename) AS files FROM model_files GROUP BY 1
        HAVING bool_or(filename = 'config.json') AND bool_or(filename IN ('model.safetensors', 'pytorch_model.bin'))""",
    "storage_usage": "SELECT count(*) AS file_count, CAST(sum(length) AS BIGINT) AS total_bytes FROM model_files",
    "validate_reports": f"""
        WITH x AS (SELECT s_name AS n, s_suppkey AS k, s_acctbal / 10000 AS cer, EXISTS (SELECT 1 FROM model_files m WHERE m.folder = s_name AND m.filename = 'model.safetensors') AS has FROM supplier),
        e AS (SELECT *, CASE WHEN k % 23 = 1 THEN 'schema_version must be 1' WHEN k % 13 = 4 THEN 'split must be ''test'''
          WHEN k % 11 = 5 THEN 'sample_count must be positive' WHEN k % 19 = 2 THEN 'dataset is required'
          WHEN k % 17 = 3 THEN 'manifest_sha256 must be a SHA-256 digest' WHEN k % 7 = 6 THEN 'weights_file must name the model weights'
          WHEN NOT has THEN 'model.safetensors is missing' WHEN k % 9 = 8 THEN 'weights_sha256 does not match the uploaded checkpoint'
          WHEN k % 31 = 7 THEN 'evaluated_at must include a timezone' WHEN cer < 0 THEN 'CER and WER must be finite non-negative rates'
          WHEN k % 29 = 6 THEN 'exact_match must be between 0 and 1' END AS error FROM x)
        SELECT n AS model_folder, error, CASE WHEN error IS NULL THEN k + 1 END AS sample_count, CASE WHEN error IS NULL THEN round(cer, 6) END AS cer,
          CASE WHEN error IS NULL THEN 0.25::DOUBLE END AS wer, CASE WHEN error IS NULL THEN 0.9::DOUBLE END AS exact_match,
          CASE WHEN error IS NULL THEN '2026-08-02 02:00:00' END AS evaluated_at, CASE WHEN error IS NULL THEN sha256(n) END AS manifest_sha256 FROM e""",
    "has_evaluation": """
        SELECT key, coalesce(cer IS NOT NULL AND evaluation_split = 'test' AND evaluation_sample_count > 0, false) AS has_evaluation FROM ocr_models""",
    # ------------------------------------------------------------- datasets
    "usable_labels": "SELECT ord, filename FROM manifest WHERE trim(label) <> '' AND upper(trim(label)) <> 'UNREADABLE'",
    "missing_images": """
        SELECT split, filename, ord FROM rows_ m WHERE split IN ('train', 'val', 'test')
          AND NOT EXISTS (SELECT 1 FROM images i WHERE i.split = m.split AND i.filename = m.filename)""",
    "orphan_images": """
        SELECT split, filename, length FROM images i WHERE NOT EXISTS (SELECT 1 FROM rows_ m WHERE m.split = i.split AND m.filename = i.filename)""",
    "dataset_summary": """
        SELECT s.split, coalesce(i.n, 0) AS images, CAST(coalesce(i.b, 0) AS BIGINT) AS bytes, coalesce(u.n, 0) AS usable
        FROM (VALUES ('train'), ('val'), ('test')) AS s(split) LEFT JOIN (SELECT split, count(*) AS n, sum(length) AS b FROM images GROUP BY 1) i USING (split)
        LEFT JOIN (SELECT split, count(*) AS n FROM rows_ WHERE label <> '' AND upper(label) <> 'UNREADABLE' GROUP BY 1) u USING (split)""",
    "dataset_totals": """
        SELECT count(*) AS total_images, CAST(sum(length) AS BIGINT) AS size_bytes, (SELECT count(*) FROM manifest) AS manifest_rows FROM images""",
    "validate_dataset": """
        WITH r AS (SELECT *, split IN ('train', 'val', 'test') AS known, label = '' AS blank, upper(label) = 'UNREADABLE' AS bad FROM rows_),
        c AS (SELECT count(*) AS manifest_rows, count(*) FILTER (split = 'train') AS rows_train, count(*) FILTER (split = 'val') AS rows_val,
            count(*) FILTER (split = 'test') AS rows_test, count(*) FILTER (split = 'train' AND NOT blank AND NOT bad) AS usable_train,
            count(*) FILTER (split = 'val' AND NOT blank AND NOT bad) AS usable_val, count(*) FILTER (split = 'test' AND NOT blank AND NOT bad) AS usable_test,
            count(*) FILTER (known AND blank) AS empty_labels, count(*) FILTER (known AND bad) AS unreadable_labels,
            coalesce((SELECT string_agg(DISTINCT CASE WHEN split = '' THEN '(blank)' ELSE split END, '; ' ORDER BY CASE WHEN split = '' THEN '(blank)' ELSE split END)
              FROM r WHERE NOT known), '') AS unknown_splits FROM r),
        miss AS (SELECT * FROM r WHERE known AND NOT EXISTS (SELECT 1 FROM images i WHERE i.split = r.split AND i.filename = r.filename)),
        orph AS (SELECT * FROM images i WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.split = i.split AND r.filename = i.filename)),
        l AS (SELECT (SELECT count(DISTINCT split) FROM r WHERE NOT known) AS unknown_split_count, (SELECT count(*) FROM miss) AS missing_image_count, (SELECT count(*) FROM orph) AS orphan_image_count,
          coalesce((SELECT string_agg(split || '/' || filename, '; ' ORDER BY ord) FROM (SELECT * FROM miss WHERE filename <> '' ORDER BY ord LIMIT 25)), '') AS missing_images,
          coalesce((SELECT string_agg(split || '/' || filename, '; ' ORDER BY list_position(['train', 'val', 'test'], split), filename)
            FROM (SELECT * FROM orph ORDER BY list_position(['train', 'val', 'test'], split), filename LIMIT 25)), '') AS orphan_images)
        SELECT c.*, l.*, CAST((missing_image_count > 0)::INT + (usable_train = 0)::INT AS INT) AS error_count,
          CAST((usable_val = 0)::INT + (orphan_image_count > 0)::INT + (empty_labels + unreadable_labels > 0)::INT + (unknown_splits <> '')::INT AS INT) AS warning_count,
          NOT (missing_image_count > 0 OR usable_train = 0) AS ok FROM c, l""",
    "unknown_splits": """
        SELECT DISTINCT CASE WHEN split = '' THEN '(blank)' ELSE split END AS name FROM rows_ WHERE split NOT IN ('train', 'val', 'test')""",
    "split_scope": _read_rows("""
        SELECT filename, arg_max(label, ord) AS label FROM manifest WHERE lower(trim(split)) = 'test'
          AND filename IN (SELECT filename FROM images WHERE split = 'test') GROUP BY 1"""),
    "split_scope_fallback": _read_rows("""
        SELECT filename, arg_max(label, ord) AS label FROM manifest WHERE filename IN (SELECT filename FROM images WHERE split = 'val') GROUP BY 1"""),
    # ----------------------------------------------------------- evaluation
    "corpus_metrics": _metrics(_PAIRS),
    "corpus_metrics_by_role": _metrics(_PAIRS, "role"),
    "corpus_metrics_fields": _metrics(_FIELD_PAIRS),
    "pair_distances": f"""
        SELECT filename, CAST(levenshtein({_bytes('reference')}, {_bytes('hypothesis')}) AS BIGINT) AS char_errors,
          CAST(length(reference) AS BIGINT) AS chars, CAST(len({_tokens('reference')}) AS BIGINT) AS words, reference = hypothesis AS exact FROM preds""",
    "word_distances": f"""
        WITH RECURSIVE tok AS (SELECT filename AS k, {_tokens('reference')} AS ref, {_tokens('hypothesis')} AS hyp FROM preds), {_steps('')}
        SELECT k AS filename, CAST(line[len(line)] AS BIGINT) AS word_errors FROM steps WHERE i = len(ref)""",
    "evaluate_predictions": f"""WITH RECURSIVE {_distances(_SCORED)} SELECT {_rates('round_even({}, 4)', 'exact_match')} FROM d""",
    "compare_models": f"""WITH RECURSIVE {_distances(_PAIRS, 'a_')}, {_distances(_FIELD_PAIRS, 'b_')},
        a AS (SELECT {_rates('{}')} FROM a_d), b AS (SELECT {_rates('{}')} FROM b_d),
        m AS (SELECT unnest(['CER', 'WER', 'Accuracy']) AS metric, unnest([a.cer, a.wer, a.accuracy]) AS base,
                     unnest([b.cer, b.wer, b.accuracy]) AS tuned FROM a, b)
        SELECT metric, round(base, 9) AS base, round(tuned, 9) AS tuned, CASE WHEN base = tuned THEN 'same'
          WHEN (metric = 'Accuracy') = (tuned > base) THEN 'better' ELSE 'worse' END AS verdict FROM m""",
    "evaluate_predictions_rows": f"""
        SELECT k AS filename, reference, hypothesis AS prediction, reference = hypothesis AS match FROM {_SCORED}""",
    "evaluation_report": f"""
        SELECT count(*) AS sample_count, round(sum(levenshtein(reference, hypothesis))::DOUBLE / sum(length(reference)), 9) AS cer, 'test' AS split FROM {_FIELD_PAIRS}""",
    "prediction_summary": """
        SELECT count(*) AS count, round_even(avg(confidence) FILTER (error IS NULL), 1) AS average_confidence,
          count(*) FILTER (error IS NULL AND confidence < 80) AS low_confidence FROM preds""",
    "prediction_rows": """
        SELECT filename AS "FILENAME", CASE WHEN error IS NOT NULL THEN 'ERROR: ' || error ELSE hypothesis END AS "PREDICTION",
          CASE WHEN error IS NOT NULL THEN '' ELSE format('{:.1f}', confidence) END AS "CONFIDENCE" FROM preds""",
    "sequence_confidence": """
        WITH t AS (SELECT user_id AS seq_id, event_id AS pos, event_type = 'purchase' AS e, -value / 100 AS lp, event_id % 37 <> 0 AS fin FROM events),
        m AS (SELECT seq_id, min(pos) FILTER (e AND fin) AS stop FROM t GROUP BY 1)
        SELECT seq_id, count(*) FILTER (fin AND (stop IS NULL OR pos <= stop)) AS tokens,
          coalesce(round_even(exp(avg(lp) FILTER (fin AND (stop IS NULL OR pos <= stop))) * 100, 1), 0.0) AS confidence
        FROM t JOIN m USING (seq_id) GROUP BY 1""",
    "batch_predict": """
        SELECT conv_id, turn, CASE WHEN role = 'system' THEN 0 ELSE length(lower(text)) END AS text_length,
          CASE WHEN role = 'system' THEN 0.0::DOUBLE ELSE 50.0::DOUBLE + length(text) % 50 END AS confidence,
          CASE WHEN role = 'system' THEN 'cannot read system turns' END AS error FROM conversations""",
    # -------------------------------------------------------------- history
    "best_epoch": """
        SELECT run_id, arg_min(epoch, (loss, epoch)) AS best_epoch, min(loss) AS best_loss, count(*) AS epochs FROM history GROUP BY 1""",
    "checkpoints": """
        SELECT run_id, epoch, loss AS selection_loss FROM (SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY epoch
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM history) WHERE best IS NULL OR loss < best""",
    "early_stop": """
        WITH b AS (SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM history),
        s AS (SELECT *, epoch - max(CASE WHEN best IS NULL OR loss < best THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS streak FROM b)
        SELECT run_id, min(epoch) FILTER (streak >= 5) AS stop_epoch, count(*) AS epochs FROM s GROUP BY 1""",
    "training_eta": """
        WITH e AS (SELECT *, sum(seconds) OVER (PARTITION BY run_id ORDER BY epoch) AS elapsed FROM history)
        SELECT run_id, epoch, round(elapsed, 3) AS elapsed, round(elapsed / epoch * (200 - epoch), 3) AS eta_seconds FROM e""",
    "throttle_breaches_daily": """
        WITH RECURSIVE a AS (SELECT event_id AS id, 'user' || user_id || '@example.org|10.0.0.1' AS key, epoch_us(ts) / 1000000.0 AS sec, event_type = 'purchase' AS ok,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        step AS (
          SELECT key, 0::BIGINT AS n, NULL::BIGINT AS id, 0.0::DOUBLE AS start, 0 AS fails, false AS refused FROM a GROUP BY key
          UNION ALL
          SELECT key, n, id, CASE WHEN NOT blocked AND NOT ok AND live = 0 THEN sec ELSE start END,
            CASE WHEN blocked THEN live WHEN ok THEN 0 ELSE live + 1 END, blocked
          FROM (SELECT s.key, a.n, a.id, a.sec, a.ok, s.start, CASE WHEN a.sec >= s.start + 86400 THEN 0 ELSE s.fails END AS live,
                  (CASE WHEN a.sec >= s.start + 86400 THEN 0 ELSE s.fails END) >= 5 AS blocked
                FROM step s JOIN a ON a.key = s.key AND a.n = s.n + 1))
        SELECT id, key, refused FROM step WHERE n > 0""",
    # --------------------------------------------------------------- values
    "corrections": f"""
        SELECT id, nullif(trim(verified_value), '') AS normalised, {_CORRECTED} AS was_corrected, {_DIFFERS} AS rate_corrected,
          coalesce(least(100, greatest(0, ocr_confidence)), 0) AS confidence FROM fields""",
    "dirty_diff": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS id, CAST((l_returnflag <> 'R')::INT + (l_linenumber > 3)::INT AS INT) AS moved,
          CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS flag_before, CASE WHEN l_returnflag <> 'R' THEN 'R' END AS flag_after,
          CASE WHEN l_linenumber > 3 THEN CAST(l_linenumber AS VARCHAR) END AS line_before, NULL::VARCHAR AS line_after FROM lineitem""",
    "filters_used": """
        SELECT id, concat_ws(',', CASE WHEN registry_number IS NOT NULL THEN 'registry_number' END, 'status',
          CASE WHEN submitted_by IS NOT NULL THEN 'submitted_by' END) AS filters FROM records""",
    "model_scores": """
        SELECT key, round(greatest(0, least(1, 1 - cer)) * 100, 1) AS characters, round(greatest(0, least(1, wer * 2 - 0.5)) * 100, 1) AS clamped,
          'my model ' || id || ' v2' AS pretty, evaluation_dataset || ' · test · ' || format('{:,}', evaluation_sample_count) || ' samples · evaluated '
          || strftime(evaluated_at, '%b %-d, %Y') AS evidence FROM ocr_models""",
    "person_metadata": """
        SELECT id, CASE WHEN id % 5 = 0 THEN 2::BIGINT END AS person_group, CASE WHEN id % 5 = 0 THEN CAST(person_field_order AS BIGINT) END AS person_field_order
        FROM template_fields""",
    "paper_dimensions": """
        WITH d AS (SELECT *, CASE paper_size WHEN 'letter' THEN 215.9 WHEN 'long_bond' THEN 215.9 WHEN 'a4' THEN 210.0 ELSE coalesce(custom_width_mm, 210.0) END::DOUBLE AS pw,
            CASE paper_size WHEN 'letter' THEN 279.4 WHEN 'long_bond' THEN 330.2 WHEN 'a4' THEN 297.0 ELSE coalesce(custom_height_mm, 297.0) END::DOUBLE AS ph FROM templates),
        o AS (SELECT *, CASE WHEN orientation = 'portrait' THEN pw ELSE ph END AS w, CASE WHEN orientation = 'portrait' THEN ph ELSE pw END AS h FROM d)
        SELECT id, w AS width_mm, h AS height_mm, round(w / h, 6) AS aspect, CASE paper_size WHEN 'letter' THEN '8.5 × 11 in' WHEN 'long_bond' THEN '8.5 × 13 in'
            WHEN 'a4' THEN '210 × 297 mm' ELSE regexp_replace(format('{:.2f}', pw), '\\.?0+$', '') || ' × ' || regexp_replace(format('{:.2f}', ph), '\\.?0+$', '') || ' mm' END AS size_label,
          (CASE WHEN id * 100.0 / 1300.0 >= 1 THEN 'landscape' ELSE 'portrait' END) <> orientation
            OR abs(id * 100.0 / 1300.0 - w / h) / (w / h) > 0.1 AS mismatch FROM o""",
    "safe_names": """
        SELECT id, name || ' v1' AS safe_name, 'template-samples/' || format('{:03d}', document_template_id) || '-' || replace(name, ' ', '-') || '-co-x/'
          || format('{:05d}', id) || '-layout/' || replace(name, ' ', '-') || '-co-x--layout--sample.pdf' AS path FROM template_fields""",
    "labels": """
        SELECT id, CASE role_slug WHEN 'staff' THEN 'Staff' WHEN 'admin' THEN 'Admin' ELSE 'Super Admin' END AS role, 'C0' AS initials FROM users""",
    "action_titles": """
        SELECT id, 'Record ' || upper(event_type[1]) || event_type[2:] AS title FROM audit""",
    "decoded_images": "SELECT conv_id, turn, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, true AS same FROM conversations",
}

ORACLE: dict[str, str] = {name: with_views(sql) for name, sql in _SQL.items()}
