"""DuckDB statements for ``catalog_mechanisms``."""

from __future__ import annotations

from quillmesh.operators.latency import HISTOGRAM_BOUNDS
from quillmesh.plans.oracles import DENSE, EMBED_BODIES, HEAD, OCCURRENCES, ORACLES, PAIRS, SCORE_PAIRS, cte, oracle, r6, toks

_LATE = "INTERVAL 10 MINUTE"
_BUCKETS = " || ',' || ".join([f"count(*) FILTER (ran AND elapsed_s <= {float(b)}::DOUBLE)" for b in HISTOGRAM_BOUNDS] + ["count(*) FILTER (ran)"])

ARRIVALS = f"""
arrivals AS (SELECT *, CASE event_type WHEN 'signup' THEN 400 WHEN 'error' THEN 500 ELSE 200 END::BIGINT AS status,
    CASE user_id % 3 WHEN 0 THEN 'embed' WHEN 1 THEN 'rerank' ELSE 'rewrite' END AS model_type,
    CASE user_id % 2 WHEN 0 THEN 'default' ELSE 'other' END AS model_name, 'Runner' || (user_id % 2) AS model_cls, value / 10 AS elapsed_s,
    ts + (CASE WHEN event_id % 37 = 5 THEN 1200 ELSE event_id % 7 END) * INTERVAL 1 SECOND AS arrived_at FROM events),
judged AS (SELECT *, ts < arrived_at - {_LATE} AS late, CASE WHEN ts < arrived_at - {_LATE} THEN arrived_at ELSE ts END AS counted_at FROM arrivals),
flagged AS (SELECT *, NOT late AND NOT (event_type = 'signup' AND user_id % 3 < 2) AS counted, NOT late AND event_type <> 'signup' AS ran FROM judged),
minutes AS (SELECT date_trunc('minute', counted_at) AS m, model_type, model_name, model_cls, status, count(*) FILTER (counted) AS requests,
    count(*) FILTER (late) AS late_rows, count(*) FILTER (ran) AS runs, coalesce(sum(elapsed_s) FILTER (ran), 0.0) AS sum_s, {_BUCKETS} AS buckets
  FROM flagged GROUP BY ALL)"""

oracle(
    "minute_metrics",
    cte(ARRIVALS)
    + f"""SELECT strftime(m, '%Y-%m-%d %H:%M') AS minute, model_type, model_name, model_cls, status, requests, late_rows, runs,
  round(sum_s, 4) AS sum_s, buckets FROM minutes WHERE m + INTERVAL 1 MINUTE <= (SELECT max(counted_at) FROM judged) - {_LATE}""",
)

oracle(
    "late_rows",
    cte(ARRIVALS) + "SELECT model_type, model_name, sum(late_rows)::BIGINT AS late_rows, sum(runs)::BIGINT AS runs FROM minutes GROUP BY ALL",
)

oracle("regroup_pieces", ORACLES["explode_regroup"])

oracle(
    "bucketed_alignment",
    cte(OCCURRENCES, PAIRS, HEAD, SCORE_PAIRS)
    + "SELECT sample_id, pos, doc_id, g.score AS gen_score, r.score AS ref_score FROM generated g JOIN golden r USING (sample_id, pos)",
)

oracle(
    "request_lines",
    cte(
        EMBED_BODIES,
        """lines AS (SELECT e.*, request_id % 17 IN (3, 4) AS broken, CASE request_id % 17
      WHEN 3 THEN '{"request_id":' || request_id || ',"body":"cut' ELSE '{"request_id":"no number ' || request_id || '","body":"{}"}' END AS line
    FROM embed_requests e)""",
    )
    + """SELECT CASE WHEN broken THEN md5(line) ELSE request_id::VARCHAR END AS request, CASE WHEN NOT broken THEN model END AS model,
  CASE WHEN NOT broken THEN len(texts)::BIGINT END AS n_texts, CASE WHEN broken OR NOT ok THEN 400::BIGINT END AS status,
  CASE WHEN broken THEN 'valid error: the line is not a JSON request' ELSE 'valid error: ' || fault END AS error,
  CASE WHEN broken OR NOT ok THEN 'validation' END AS error_stage FROM lines""",
)

PADDED = f"""
sized AS (SELECT doc_id, len({toks('text')}) AS size, greatest(ceil(len({toks('text')}) / 64.0) * 64, 64)::BIGINT AS padded_tokens FROM documents)"""

oracle(
    "token_budget_batches",
    cte(
        OCCURRENCES,
        DENSE,
        PADDED,
        "placed AS (SELECT *, row_number() OVER (PARTITION BY padded_tokens ORDER BY doc_id) - 1 AS place, greatest(16384 // padded_tokens, 1) AS room FROM sized)",
        "lengths AS (SELECT padded_tokens, ceil(count(*) / any_value(room)::DOUBLE)::BIGINT AS batches FROM placed GROUP BY padded_tokens)",
        "bases AS (SELECT padded_tokens, coalesce(sum(batches) OVER (ORDER BY padded_tokens DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM lengths)",
        "totals AS (SELECT doc_id, round(sum((dim + 1) * value::FLOAT::DOUBLE), 3) + 0.0 AS dense_total FROM dense GROUP BY doc_id)",
    )
    + """SELECT doc_id, (base + place // room)::BIGINT AS batch_no, padded_tokens, dense_total
FROM placed JOIN bases USING (padded_tokens) JOIN totals USING (doc_id)""",
)

oracle(
    "placed_models",
    cte(
        OCCURRENCES,
        DENSE,
        "named AS (SELECT doc_id, CASE doc_id % 20 WHEN 18 THEN 'dense_only' WHEN 19 THEN 'sparse_only' ELSE 'default' END AS model FROM documents)",
        f"tops AS (SELECT doc_id, {r6('max(abs(value::FLOAT::DOUBLE))')} AS largest FROM dense GROUP BY doc_id)",
        "words AS (SELECT doc_id, len(list_distinct(l))::BIGINT AS n_tokens FROM doc_lists)",
    )
    + """SELECT doc_id, model, CASE WHEN model <> 'sparse_only' THEN 64::BIGINT END AS dims,
  CASE WHEN model <> 'sparse_only' THEN largest END AS largest, CASE WHEN model <> 'dense_only' THEN n_tokens END AS n_tokens
FROM named JOIN tops USING (doc_id) JOIN words USING (doc_id)""",
)

oracle(
    "token_counts",
    cte(PADDED) + "SELECT padded_tokens, count(*) AS texts, sum(size)::BIGINT AS tokens FROM sized GROUP BY padded_tokens",
)
