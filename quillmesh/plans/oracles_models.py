"""DuckDB statements for ``catalog_models``."""

from __future__ import annotations

from quillmesh.plans.oracles import (
    GATES, HEAD, LOG, MATRIX, OCCURRENCES, ORACLES, PAIRS, STATS, SUMMARY, VOCAB, _MODEL_LINES, cte, fixed, oracle, r6, tid,
)

oracle(
    "isolated_failures",
    cte(PAIRS)
    + f"""SELECT doc_id, item_id,
  CASE WHEN length(text) BETWEEN 400 AND 6000 THEN {r6('least(length(query), length(text))::DOUBLE / greatest(length(query), length(text))')} END AS score,
  CASE WHEN length(text) NOT BETWEEN 400 AND 6000 THEN 500::BIGINT END AS status,
  CASE WHEN length(text) > 6000 THEN 'run exception: text of more than 6000 characters'
    WHEN length(text) < 400 THEN 'run exception: 0 results for 1 inputs' END AS error FROM pairs""",
)

oracle(
    "head_outside_model",
    cte(
        PAIRS,
        """lengths AS (SELECT doc_id, item_id, length(query)::DOUBLE AS q, length(text)::DOUBLE AS t FROM pairs),
features AS (SELECT doc_id, item_id, least(q, t) / greatest(q, t, 1.0) AS f1, q / (q + t + 1.0) AS f2, 1.0 / (1.0 + q / 100.0) AS f3,
    1.0 / (1.0 + t / 1000.0) AS f4 FROM lengths),
logits AS (SELECT doc_id, item_id,
    -1.0 + tanh(f1 * 1.5 + f2 * 0.5 + f3 * 1.0 + f4 * 0.25 - 0.25) * 2.0
         + tanh(f1 * -0.75 + f2 * 1.25 + f3 * 0.5 + f4 * 0.5) * 1.0
         + tanh(f1 * 0.5 + f2 * 2.0 + f3 * -0.5 + f4 * -0.25 + 0.125) * 0.5
         + tanh(f1 * 1.0 + f2 * -0.5 + f3 * 1.5 + f4 * 0.75 - 0.5) * 1.5 AS logit FROM features)""",
    )
    + f"SELECT doc_id, item_id, {r6('1.0 / (1.0 + exp(-logit))')} AS score FROM logits",
)

oracle("histogram_stream", ORACLES["latency_histogram"])

oracle(
    "id_to_token_whole",
    cte(OCCURRENCES, VOCAB)
    + f"""SELECT 'document' AS side, doc_id AS id, token, {r6('1.0 / (1.0 + pos / 512.0)')} AS weight FROM doc_first
UNION ALL SELECT 'item', item_id, token, {r6('1.0 / (1.0 + pos / 512.0)')} FROM item_first SEMI JOIN vocab USING (token)""",
)

oracle("score_matrix_by_token", ORACLES["lexical_score_matrix"])

oracle(
    "lexical_top_k",
    cte(OCCURRENCES, VOCAB, MATRIX)
    + f"""SELECT item_id, doc_id, {r6('score')} AS score, row_number() OVER (PARTITION BY item_id ORDER BY {r6('score')} DESC, doc_id) AS rank
FROM matrix QUALIFY rank <= 10""",
)

oracle(
    "eval_report_counts",
    f"""SELECT * FROM ({ORACLES['eval_report']})
UNION ALL SELECT * FROM ({SUMMARY} SELECT CASE kind WHEN 'dense' THEN 103::BIGINT ELSE 303::BIGINT END, 'Total samples compared: ' || max(samples)
  FROM summary WHERE kind IN ('dense', 'rerank') GROUP BY kind)""",
)

_LINES = "".join(
    f" UNION ALL SELECT task, model_name, {n}, '{before}' || {fixed(c, 2)} || '{after}' FROM stats WHERE status = 'ok'"
    for n, before, c, after in _MODEL_LINES
)

oracle(
    "latency_summary",
    cte(
        LOG,
        STATS,
        f"""model_lines AS (SELECT task, model_name, 0 AS n, CASE WHEN status = 'ok' THEN '✅ ' || model_name || ':'
    ELSE '❌ ' || model_name || ': ' || error END AS line FROM stats{_LINES}),
heads(task, n, line) AS (VALUES ('', 0, '{"=" * 80}'), ('', 1, 'LATENCY BENCHMARK RESULTS'), ('', 2, '{"=" * 80}'), ('', 3, 'Timestamp: 2024-01-01 00:00:00'),
  ('', 4, 'Warmup runs: 5'), ('', 5, 'Benchmark iterations: 100'), ('embed', 0, '📊 EMBEDDING MODELS'), ('embed', 1, '{"-" * 50}'),
  ('rerank', 0, '📊 RERANKER MODELS'), ('rerank', 1, '{"-" * 50}')),
every AS (SELECT task, '' AS model_name, n, line FROM heads WHERE task = '' OR task IN (SELECT task FROM stats) UNION ALL FROM model_lines)""",
    )
    + "SELECT row_number() OVER (ORDER BY task, model_name, n) - 1 AS line_no, line FROM every",
)

_COS, _CORR = fixed("cos", 4), fixed("corr", 4)

oracle(
    "verdict_cases",
    SUMMARY.rstrip()
    + ","
    + GATES
    + f""",
cases(case_name, a, b) AS (VALUES ('as is', 1.0, 1.0), ('dense worse', 0.5, 1.0), ('rerank worse', 1.0, 0.5), ('both worse', 0.5, 0.5),
  ('only dense', 1.0, NULL), ('only dense, worse', 0.5, NULL), ('only rerank', NULL, 1.0), ('only rerank, worse', NULL, 0.5), ('nothing', NULL, NULL)),
means AS (SELECT case_name, gates.cos * a::DOUBLE AS cos, gates.corr * b::DOUBLE AS corr FROM cases CROSS JOIN gates)
SELECT case_name, cos >= 0.9 AS embedding_good, corr >= 0.8 AS reranker_good,
  CASE WHEN cos IS NULL AND corr IS NULL THEN 'NOT EVALUATED' WHEN coalesce(cos >= 0.9, true) AND coalesce(corr >= 0.8, true) THEN 'GOOD'
    WHEN coalesce(cos >= 0.9, false) OR coalesce(corr >= 0.8, false) THEN 'MIXED' ELSE 'ATTENTION' END AS label,
  CASE WHEN cos IS NULL AND corr IS NULL THEN 'Nothing was evaluated'
    WHEN corr IS NULL AND cos >= 0.9 THEN '✅ Embedding results look GOOD - Generated embeddings closely match reference data (Cosine Similarity: ' || {_COS} || ')'
    WHEN corr IS NULL THEN '❌ Embedding results need ATTENTION - Significant differences detected in embeddings (Cosine Similarity: ' || {_COS} || ' < 0.9)'
    WHEN cos IS NULL AND corr >= 0.8 THEN '✅ Reranker results look GOOD - Generated reranker scores closely match reference data (Correlation: ' || {_CORR} || ')'
    WHEN cos IS NULL THEN '❌ Reranker results need ATTENTION - Significant differences detected in reranker scores (Correlation: ' || {_CORR} || ' < 0.8)'
    WHEN cos >= 0.9 AND corr >= 0.8 THEN '✅ Results look GOOD - Generated files closely match reference data (Cosine Similarity: '
      || {_COS} || ', Reranker Correlation: ' || {_CORR} || ')'
    WHEN cos < 0.9 AND corr < 0.8 THEN '❌ Results need ATTENTION - Significant differences detected in both components (Cosine Similarity: '
      || {_COS} || ' < 0.9, Correlation: ' || {_CORR} || ' < 0.8)'
    ELSE '⚠️  Results are MIXED - Some components match well, others need attention (Cosine Similarity: ' || {_COS} || ', Correlation: ' || {_CORR} || ')' END AS message
FROM means""",
)
