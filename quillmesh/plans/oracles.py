"""DuckDB statements that state each catalogue query independently, over the same tables."""

from __future__ import annotations

WORD = r"[\p{L}\p{N}]+"
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def clean(x: str) -> str:
    return strip(f"replace(regexp_replace({x}, '<[^>]+>', '', 'g'), chr(10), '')")


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}')"


def tid(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 15))::BIGINT"


def ids(x: str) -> str:
    return f"list_transform({toks(x)}, lambda t: {tid('t')})"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def fixed(x: str, digits: int) -> str:
    return f"""CASE WHEN isnan({x}) THEN 'nan' WHEN {x} = 'inf'::DOUBLE THEN 'inf'
      WHEN {x} = '-inf'::DOUBLE THEN '-inf' ELSE printf('%.{digits}f', {x}) END"""


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# Shared building blocks -------------------------------------------------------------------------

OCCURRENCES = f"""
doc_lists AS MATERIALIZED (SELECT doc_id, {toks('text')} AS l FROM documents),
doc_tokens AS (SELECT doc_id, unnest(l) AS token, unnest(range(len(l))) AS pos FROM doc_lists),
doc_first AS MATERIALIZED (SELECT doc_id, token, min(pos) AS pos FROM doc_tokens GROUP BY ALL),
item_lists AS MATERIALIZED (SELECT item_id, {toks('text')} AS l FROM benchmark),
item_tokens AS (SELECT item_id, unnest(l) AS token, unnest(range(len(l))) AS pos FROM item_lists),
item_first AS MATERIALIZED (SELECT item_id, token, min(pos) AS pos FROM item_tokens GROUP BY ALL)"""

VOCAB = """
vocab AS (
  SELECT token, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf
  FROM doc_first GROUP BY token)"""

PAIRS = """
pairs AS (
  SELECT d.doc_id, d.text, d.doc_id // 8 AS request_id, d.doc_id % 8 AS pos, b.item_id, b.text AS query
  FROM documents d JOIN benchmark b ON b.item_id = (d.doc_id // 8) % (SELECT count(*) FROM benchmark))"""

HEAD = """
shared AS (
  SELECT p.doc_id, count(*) AS n_common,
         sum(1.0 / (1.0 + i.pos / 512.0) * (1.0 / (1.0 + d.pos / 512.0))) AS overlap
  FROM pairs p JOIN item_first i ON i.item_id = p.item_id JOIN doc_first d ON d.doc_id = p.doc_id AND d.token = i.token
  GROUP BY p.doc_id),
sizes AS (
  SELECT p.doc_id, len(il.l) AS lq, len(dl.l) AS ld, len(list_distinct(il.l)) AS nq, len(list_distinct(dl.l)) AS nd
  FROM pairs p JOIN item_lists il ON il.item_id = p.item_id JOIN doc_lists dl ON dl.doc_id = p.doc_id),
features AS (
  SELECT s.doc_id,
    CASE WHEN nq = 0 THEN 0.0 ELSE coalesce(overlap, 0.0) / nq END AS f1,
    CASE WHEN nq + nd = 0 THEN 0.0 ELSE coalesce(n_common, 0)::DOUBLE / (nq + nd - coalesce(n_common, 0)) END AS f2,
    CASE WHEN nq = 0 THEN 0.0 ELSE coalesce(n_common, 0)::DOUBLE / nq END AS f3,
    CASE WHEN greatest(lq, ld) = 0 THEN 0.0 ELSE least(lq, ld)::DOUBLE / greatest(lq, ld) END AS f4
  FROM sizes s LEFT JOIN shared o USING (doc_id)),
scored AS (
  SELECT p.doc_id, p.item_id, p.request_id, p.pos,
    -1.0 + tanh(f1 * 1.5 + f2 * 0.5 + f3 * 1.0 + f4 * 0.25 - 0.25) * 2.0
         + tanh(f1 * -0.75 + f2 * 1.25 + f3 * 0.5 + f4 * 0.5) * 1.0
         + tanh(f1 * 0.5 + f2 * 2.0 + f3 * -0.5 + f4 * -0.25 + 0.125) * 0.5
         + tanh(f1 * 1.0 + f2 * -0.5 + f3 * 1.5 + f4 * 0.75 - 0.5) * 1.5 AS score
  FROM pairs p JOIN features f USING (doc_id))"""

WINDOWS = """
windows AS (
  SELECT conv_id, turn, turns FROM (
    SELECT conv_id, turn, role, list(text) OVER (
      PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS turns
    FROM conversations) WHERE role = 'user')"""

# Text ---------------------------------------------------------------------------------------------

oracle("clean_html", f"SELECT page_id, {clean('html')} AS text, {strip('url')} AS url FROM pages")

oracle(
    "retrieval_dataset_texts",
    f"""SELECT 'query' AS split, item_id AS id, {strip('text')} AS text FROM benchmark
    UNION ALL SELECT 'corpus', page_id, {clean('html')} FROM pages""",
)

oracle(
    "tokenize_pad",
    f"""
WITH l AS (SELECT doc_id, {ids('text')} AS ids FROM documents),
e AS (SELECT doc_id, list_concat(list_concat([0], ids[1:510]), [2]) AS cut,
             list_concat(list_concat([0], ids), [2]) AS whole FROM l)
SELECT doc_id, 512::BIGINT AS padded_length, len(cut)::BIGINT AS attended,
  md5(array_to_string(list_concat(cut, list_transform(range(512 - len(cut)), lambda i: 1::BIGINT)), ',')) AS padded_md5,
  len(whole)::BIGINT AS whole_length, md5(array_to_string(whole, ',')) AS whole_md5
FROM e""",
)

oracle(
    "pack_pair",
    cte(
        PAIRS,
        f"t AS (SELECT doc_id, item_id, {ids('query')} AS q, {ids('text')} AS d FROM pairs)",
        "f AS (SELECT *, 508 - len(q) AS room, len(d) <= 508 - len(q) OR 508 - len(q) >= 1 AS fits FROM t)",
        """p AS (SELECT doc_id, item_id, fits, list_concat([0], q, [2, 2], d, [2]) AS w,
           list_concat([0], q, [2, 2], CASE WHEN room > 0 THEN d[1:room] ELSE [] END, [2]) AS x FROM f)""",
    )
    + """
SELECT doc_id, item_id, CASE WHEN fits THEN len(x)::BIGINT END AS attended,
  CASE WHEN fits THEN md5(array_to_string(
    list_concat(x, list_transform(range(512 - len(x)), lambda i: 1::BIGINT)), ',')) END AS ids_md5,
  CASE WHEN NOT fits THEN 'query leaves no room for the text' END AS error, md5(array_to_string(w, ',')) AS whole_md5
FROM p""",
)

oracle(
    "zip_first_pairs",
    f"""
SELECT ordinal, item_id, page_id, query, t.text FROM
  (SELECT row_number() OVER (ORDER BY item_id) AS ordinal, item_id, {strip('text')} AS query FROM benchmark) q
JOIN (SELECT row_number() OVER (ORDER BY page_id) AS ordinal, page_id, {clean('html')} AS text FROM pages) t
USING (ordinal) WHERE ordinal <= 16""",
)

oracle(
    "history_join",
    cte(WINDOWS)
    + "SELECT conv_id, turn, len(turns)::BIGINT AS n_turns, array_to_string(turns, '[SEP]') AS history FROM windows",
)

# Requests -----------------------------------------------------------------------------------------

EMBED_BODIES = """
bodies AS (SELECT doc_id AS request_id, CASE doc_id % 15
  WHEN 1 THEN '{"text":[' || to_json(text) || ',' || to_json(source) || '],"return_sparse":true}'
  WHEN 2 THEN '{"text":[]}' WHEN 3 THEN '{"text":7}'
  WHEN 4 THEN '{"text":[' || to_json(text) || ',1]}'
  WHEN 5 THEN '{"text":[' || to_json(text) || ',null]}'
  WHEN 6 THEN '{"model":"default"}' WHEN 7 THEN '{"text":null}' WHEN 8 THEN '{"text":' || source
  WHEN 9 THEN '{"text":' || to_json(text) || ',"model":"dense_only","return_sparse":true}'
  WHEN 10 THEN '{"text":' || to_json(text) || ',"return_dense":"yes"}'
  WHEN 11 THEN '{"text":' || to_json(text) || ',"model":"missing"}'
  WHEN 12 THEN '{"text":' || to_json(text) || ',"model":"sparse_only"}'
  WHEN 14 THEN '{"text":' || to_json(text) || ',"language":' || to_json(source) || '}'
  -- 13 repeats the key; its last value is the text
  ELSE '{"text":' || to_json(text) || '}' END AS body FROM documents),
parsed AS (SELECT request_id, TRY_CAST(body AS JSON) AS j FROM bodies),
typed AS (SELECT *, json_type(j, '$.text') AS tt, json_type(j, '$.model') AS tm,
    json_type(j, '$.return_dense') AS td, json_type(j, '$.return_sparse') AS ts,
    json_extract(j, '$.text[*]') AS items FROM parsed),
faults AS (SELECT *,
    CASE WHEN tt = 'VARCHAR' THEN [json_extract_string(j, '$.text')]
         WHEN tt = 'ARRAY' AND len(items) >= 1 AND len(list_filter(items, lambda x: json_type(x) <> 'VARCHAR')) = 0
         THEN list_transform(items, lambda x: json_extract_string(x, '$')) END AS texts FROM typed),
checked AS (SELECT *, CASE WHEN j IS NULL THEN 'the body is not valid JSON' ELSE nullif(concat_ws('; ',
    CASE WHEN texts IS NULL THEN 'text: a string or a non-empty list of strings is required' END,
    CASE WHEN tm <> 'VARCHAR' THEN 'model: a string is required' END,
    CASE WHEN td <> 'BOOLEAN' THEN 'return_dense: a boolean is required' END,
    CASE WHEN ts <> 'BOOLEAN' THEN 'return_sparse: a boolean is required' END,
    CASE WHEN request_id % 15 = 14 THEN 'unknown keys: language' END), '') END AS fault FROM faults),
embed_requests AS (SELECT request_id, fault IS NULL AS ok, fault,
    CASE WHEN fault IS NULL THEN coalesce(json_extract_string(j, '$.model'), 'default') END AS model,
    CASE WHEN fault IS NULL THEN texts END AS texts,
    CASE WHEN fault IS NULL THEN tt = 'VARCHAR' END AS scalar_input,
    CASE WHEN fault IS NULL THEN coalesce((j->>'$.return_dense')::BOOLEAN, true) END AS return_dense,
    CASE WHEN fault IS NULL THEN coalesce((j->>'$.return_sparse')::BOOLEAN, false) END AS return_sparse
  FROM checked)"""

ROUTED = """
registry(model, model_cls, has_dense, has_sparse) AS (VALUES
  ('default', 'HashedEmbedRunner', true, true), ('dense_only', 'HashedDenseRunner', true, false),
  ('sparse_only', 'PositionalSparseRunner', false, true)),
routed AS (SELECT e.*, r.model_cls,
    CASE WHEN NOT ok THEN 'validation' WHEN r.model_cls IS NULL THEN 'routing'
         WHEN (return_dense AND NOT has_dense) OR (return_sparse AND NOT has_sparse) THEN 'capability' END AS stage,
    CASE WHEN NOT ok THEN 'valid error: ' || fault
         WHEN r.model_cls IS NULL THEN 'model name [' || e.model || '] not found'
         WHEN return_dense AND NOT has_dense THEN 'param check error: the model has no dense output'
         WHEN return_sparse AND NOT has_sparse THEN 'param check error: the model has no sparse output' END AS error
  FROM embed_requests e LEFT JOIN registry r USING (model))"""


def chars(x: str) -> str:
    return f"list_sum(list_transform({x}, lambda t: length(t)))::BIGINT"


oracle(
    "validate_embed",
    cte(EMBED_BODIES)
    + f"""SELECT request_id, model, len(texts)::BIGINT AS n_texts, {chars('texts')} AS n_chars, scalar_input,
  return_dense, return_sparse, CASE WHEN NOT ok THEN 400::BIGINT END AS status, 'valid error: ' || fault AS error,
  CASE WHEN NOT ok THEN 'validation' END AS error_stage FROM embed_requests""",
)

oracle(
    "request_files",
    cte(EMBED_BODIES)
    + f"""SELECT request_id, model, len(texts)::BIGINT AS n_texts, {chars('texts')} AS n_chars,
  CASE WHEN NOT ok THEN 400::BIGINT END AS status, 'valid error: ' || fault AS error FROM embed_requests""",
)

oracle(
    "route_and_capability",
    cte(EMBED_BODIES, ROUTED)
    + """SELECT request_id, model, model_cls, CASE WHEN stage IS NULL THEN 200 ELSE 400 END::BIGINT AS status,
  error, stage AS error_stage FROM routed""",
)

RERANK_REQUESTS = """
grouped AS (SELECT request_id, any_value(query) AS query, list(text ORDER BY pos) AS texts,
    list(pos ORDER BY pos) AS at, list(doc_id ORDER BY pos) AS docs FROM pairs GROUP BY request_id),
rerank_requests AS (SELECT *, request_id % 9 AS k,
    CASE WHEN request_id % 9 IN (1, 3) THEN 'texts: a non-empty list of strings is required'
         WHEN request_id % 9 = 2 THEN 'query: a string is required'
         WHEN request_id % 9 = 6 THEN 'unknown keys: top_n' END AS fault FROM grouped)"""

oracle(
    "validate_rerank",
    cte(PAIRS, RERANK_REQUESTS)
    + f"""SELECT request_id,
  CASE WHEN fault IS NULL THEN CASE k WHEN 4 THEN 'missing' WHEN 5 THEN 'sigmoid' ELSE 'default' END END AS model,
  CASE WHEN fault IS NULL THEN length(query)::BIGINT END AS query_chars,
  CASE WHEN fault IS NULL THEN len(texts)::BIGINT END AS n_texts,
  CASE WHEN fault IS NULL THEN {chars('texts')} END AS n_chars,
  CASE WHEN fault IS NOT NULL THEN 400::BIGINT END AS status, 'valid error: ' || fault AS error,
  CASE WHEN fault IS NOT NULL THEN 'validation' END AS error_stage
FROM rerank_requests""",
)

REWRITE_REQUESTS = """
rewrite_requests AS (SELECT conv_id, turn, turns, conv_id % 8 AS k, CASE WHEN conv_id % 8 IN (1, 2, 3, 4)
    THEN 'message: a non-empty list of non-empty lists of strings is required'
    WHEN conv_id % 8 = 6 THEN 'unknown keys: top_n' END AS fault FROM windows)"""

oracle(
    "validate_rewrite",
    cte(WINDOWS, REWRITE_REQUESTS)
    + f"""SELECT conv_id, turn,
  CASE WHEN fault IS NULL THEN CASE WHEN k = 5 THEN 'missing' ELSE 'default' END END AS model,
  CASE WHEN fault IS NULL THEN 1::BIGINT END AS n_dialogues,
  CASE WHEN fault IS NULL THEN {chars('turns')} END AS n_chars,
  CASE WHEN fault IS NOT NULL THEN 400::BIGINT END AS status, 'valid error: ' || fault AS error,
  CASE WHEN fault IS NOT NULL THEN 'validation' END AS error_stage
FROM rewrite_requests""",
)

oracle(
    "explode_regroup",
    """SELECT conv_id || '-' || (turn // 4) AS request_id, count(*)::BIGINT AS n_results,
  string_agg(md5(text), ',' ORDER BY turn) AS answers FROM conversations GROUP BY conv_id, turn // 4""",
)

oracle(
    "expand_pairs",
    cte(PAIRS)
    + """SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY pos) - 1 AS pos,
  md5(query) AS query_md5, md5(text) AS text_md5 FROM pairs WHERE request_id % 9 NOT IN (1, 2, 3, 6)
UNION ALL SELECT DISTINCT request_id, NULL::BIGINT, NULL, NULL FROM pairs WHERE request_id % 9 IN (1, 2, 3, 6)""",
)

# Weights, vectors, scores ---------------------------------------------------------------------------

oracle(
    "token_weights_max",
    f"""
WITH l AS (SELECT doc_id, list_concat([0], {ids('text')}, [2, 1]) AS x FROM documents),
o AS (SELECT doc_id, unnest(x) AS token_id, unnest(range(len(x))) AS i FROM l),
w AS (SELECT doc_id, token_id, max(((i * 7 + doc_id) % 11 - 3) / 4.0) AS weight FROM o
      WHERE token_id > 3 AND ((i * 7 + doc_id) % 11 - 3) > 0 GROUP BY ALL)
SELECT d.doc_id, w.token_id, w.weight FROM documents d LEFT JOIN w USING (doc_id)""",
)

oracle(
    "lexical_weights",
    cte(OCCURRENCES, VOCAB)
    + f"""SELECT doc_id, {tid('token')} AS token_id, {r6('idf / (1.0 + pos / 512.0)')} AS weight
FROM doc_first JOIN vocab USING (token)""",
)

oracle(
    "id_to_token",
    cte(OCCURRENCES, VOCAB)
    + f"""SELECT doc_id, token, {r6('1.0 / (1.0 + pos / 512.0)')} AS weight
FROM doc_first JOIN vocab USING (token) WHERE df >= 2""",
)

oracle(
    "colbert_trim",
    f"""SELECT vec_id, greatest(least(vec_id % 17, 16) - 1, 0)::BIGINT AS n_vecs,
  {r6('coalesce(list_sum((embedding::DOUBLE[])[1:4 * greatest(least(vec_id % 17, 16) - 1, 0)]), 0.0)')} AS total
FROM embeddings""",
)

DENSE = f"""
sums AS (SELECT doc_id, {tid('token')} % 64 AS dim,
    sum(CASE WHEN ({tid('token')} // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM doc_tokens GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM sums GROUP BY doc_id),
dense AS (SELECT d.doc_id, g.dim, CASE WHEN coalesce(n, 0.0) > 0 THEN coalesce(v, 0.0) / n ELSE 0.0 END AS value
  FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS dim) g LEFT JOIN sums s ON s.doc_id = d.doc_id AND s.dim = g.dim
  LEFT JOIN norms n ON n.doc_id = d.doc_id)"""

oracle(
    "dense_embed",
    cte(OCCURRENCES, DENSE) + f"SELECT doc_id, dim, {r6('value::FLOAT::DOUBLE')} AS value FROM dense",
)

oracle(
    "sparse_embed",
    cte(OCCURRENCES)
    + f"""SELECT d.doc_id, {tid('f.token')} AS token_id, {r6('1.0 / (1.0 + f.pos / 512.0)')} AS weight
FROM documents d LEFT JOIN doc_first f USING (doc_id)""",
)

oracle(
    "embed_multi_model",
    cte(
        OCCURRENCES,
        DENSE,
        "ds AS (SELECT doc_id, sum(abs(value::FLOAT::DOUBLE)) AS s FROM dense GROUP BY doc_id)",
        "ss AS (SELECT doc_id, count(*) AS n, sum(1.0 / (1.0 + pos / 512.0)) AS s FROM doc_first GROUP BY doc_id)",
    )
    + """SELECT d.doc_id, ['default', 'dense_only', 'sparse_only'][d.doc_id % 3 + 1] AS model,
  CASE WHEN d.doc_id % 3 < 2 THEN 64::BIGINT END AS dims,
  CASE WHEN d.doc_id % 3 < 2 THEN round(ds.s, 4) END AS dense_abs_sum,
  CASE WHEN d.doc_id % 3 <> 1 THEN coalesce(ss.n, 0)::BIGINT END AS n_tokens,
  CASE WHEN d.doc_id % 3 <> 1 THEN round(coalesce(ss.s, 0.0), 4) END AS sparse_sum
FROM documents d LEFT JOIN ds USING (doc_id) LEFT JOIN ss USING (doc_id)""",
)

MATRIX = """
item_weights AS (SELECT i.item_id, i.token,
    coalesce(v.idf, ln((SELECT count(*) FROM documents) + 1.0) + 1.0) / (1.0 + i.pos / 512.0) AS w
  FROM item_first i LEFT JOIN vocab v USING (token)),
matrix AS (SELECT i.item_id, d.doc_id, sum(i.w * (v.idf / (1.0 + d.pos / 512.0))) AS score
  FROM item_weights i JOIN doc_first d USING (token) JOIN vocab v USING (token) GROUP BY ALL)"""

oracle(
    "lexical_score_matrix",
    cte(OCCURRENCES, VOCAB, MATRIX) + f"SELECT item_id, doc_id, {r6('score')} AS score FROM matrix",
)

oracle(
    "lexical_score_pair",
    cte(OCCURRENCES, PAIRS)
    + f"""SELECT p.doc_id, p.item_id,
  {r6('coalesce(sum(1.0 / (1.0 + i.pos / 512.0) * (1.0 / (1.0 + d.pos / 512.0))), 0.0)')} AS score
FROM pairs p LEFT JOIN item_first i ON i.item_id = p.item_id
LEFT JOIN doc_first d ON d.doc_id = p.doc_id AND d.token = i.token GROUP BY ALL""",
)

oracle(
    "score_head",
    f"""
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS j FROM embeddings),
h AS (SELECT vec_id, i, sum(v * ((i * 7 + j * 3) % 11 - 5) / 10.0) AS d
      FROM x CROSS JOIN (SELECT unnest(range(4)) AS i) GROUP BY ALL),
t AS (SELECT vec_id, -1.0 + sum(tanh(d + [0.1, -0.2, 0.3, 0.0][i + 1]::DOUBLE) * [2.0, 1.0, 0.5, 1.5][i + 1]::DOUBLE) AS logit
      FROM h GROUP BY vec_id)
SELECT vec_id, {r6('logit')} AS logit, {r6('1.0 / (1.0 + exp(-logit))')} AS score FROM t""",
)

oracle("rerank_scores", cte(OCCURRENCES, PAIRS, HEAD) + f"SELECT doc_id, item_id, {r6('score')} AS score FROM scored")

oracle(
    "rerank_sigmoid",
    cte(OCCURRENCES, PAIRS, HEAD)
    + f"SELECT doc_id, item_id, {r6('1.0 / (1.0 + exp(-score))')} AS score FROM scored",
)

oracle(
    "rerank_fallback",
    cte(PAIRS)
    + f"""
SELECT request_id, pos,
  CASE WHEN lost THEN 1.0
       ELSE least(length(query), length(text))::DOUBLE / greatest(length(query), length(text), 1) END AS score,
  lost AS fell_back, CASE WHEN bad THEN 500::BIGINT END AS status,
  CASE WHEN bad THEN 'run exception: poisoned text' END AS error
FROM (SELECT *, length(text) % 25 = 0 AS bad, bool_or(length(text) % 25 = 0) OVER (PARTITION BY request_id) AS lost
      FROM pairs)""",
)


def rewritten(turns: str) -> str:
    """Ctes that rewrite the dialogues of a relation ``said(k, turns)``."""
    return f"""
parts AS (SELECT k, {toks('turns[len(turns)]')} AS last,
    flatten(list_transform(turns[1:len(turns) - 1], lambda t: {toks('t')})) AS earlier FROM {turns}),
spoken AS (SELECT k, last, unnest(earlier) AS w, unnest(range(len(earlier))) AS i FROM parts),
extra AS (SELECT k, w, min(i) AS i FROM spoken WHERE length(w) >= 4 AND NOT list_contains(last, w) GROUP BY ALL),
extras AS (SELECT k, list(w ORDER BY i) AS ws FROM extra GROUP BY k),
rewritten AS (SELECT k, array_to_string(list_concat(last, coalesce(ws, [])), ' ') AS rewritten
  FROM parts LEFT JOIN extras USING (k))"""


oracle(
    "rewrite_context",
    cte(WINDOWS, "said AS (SELECT {'c': conv_id, 't': turn} AS k, turns FROM windows)", rewritten("said"))
    + "SELECT k.c AS conv_id, k.t AS turn, rewritten FROM rewritten",
)

# Every candidate pair is scored like an assigned one.
CANDIDATE_HEAD = HEAD.replace("p.doc_id, p.item_id, p.request_id, p.pos,", "p.doc_id, p.item_id,")
for _old, _new in (
    ("SELECT p.doc_id, count(*)", "SELECT p.doc_id, p.item_id, count(*)"),
    ("GROUP BY p.doc_id)", "GROUP BY p.doc_id, p.item_id)"),
    ("SELECT p.doc_id, len(", "SELECT p.doc_id, p.item_id, len("),
    ("SELECT s.doc_id,", "SELECT s.doc_id, s.item_id,"),
    ("shared o USING (doc_id)", "shared o USING (doc_id, item_id)"),
    ("features f USING (doc_id)", "features f USING (doc_id, item_id)"),
):
    CANDIDATE_HEAD = CANDIDATE_HEAD.replace(_old, _new)

oracle(
    "retrieve_then_rerank",
    cte(
        OCCURRENCES,
        VOCAB,
        MATRIX,
        """pairs AS (SELECT * FROM (SELECT item_id, doc_id, round(score, 6) AS lexical_score,
      row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS lexical_rank FROM matrix)
    WHERE lexical_rank <= 10)""",
        CANDIDATE_HEAD,
    )
    + f"""SELECT item_id, doc_id, lexical_rank, lexical_score,
  row_number() OVER (PARTITION BY item_id ORDER BY {r6('score')} DESC, doc_id) AS rerank_rank, {r6('score')} AS rerank_score
FROM pairs JOIN scored USING (item_id, doc_id)""",
)

# Serving --------------------------------------------------------------------------------------------

TEXT_TOKENS = f"""
answers AS (SELECT request_id, model, stage, error, return_dense, return_sparse,
    CASE WHEN stage IS NULL THEN unnest(CASE WHEN stage IS NULL THEN texts ELSE [NULL] END) END AS text,
    CASE WHEN stage IS NULL THEN unnest(CASE WHEN stage IS NULL THEN range(len(texts)) ELSE [NULL] END) END AS pos
  FROM routed)"""

oracle(
    "serve_embed_rows",
    cte(EMBED_BODIES, ROUTED, TEXT_TOKENS)
    + f"""SELECT request_id, pos, model, CASE WHEN stage IS NULL AND return_dense THEN 64::BIGINT END AS dims,
  CASE WHEN stage IS NULL AND return_sparse THEN len(list_distinct({toks('text')}))::BIGINT END AS n_tokens,
  CASE WHEN stage IS NULL THEN 200 ELSE 400 END::BIGINT AS status, error FROM answers""",
)

oracle(
    "serve_rerank_rows",
    cte(OCCURRENCES, PAIRS, HEAD, RERANK_REQUESTS)
    + f"""
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY s.pos) - 1 AS pos,
  CASE WHEN k = 5 THEN 'sigmoid' ELSE 'default' END AS model,
  {r6('CASE WHEN k = 5 THEN 1.0 / (1.0 + exp(-score)) ELSE score END')} AS score, 200::BIGINT AS status, NULL AS error
FROM rerank_requests JOIN scored s USING (request_id) WHERE k NOT IN (1, 2, 3, 4, 6)
UNION ALL
SELECT request_id, NULL, CASE WHEN k = 4 THEN 'missing' END, NULL, 400,
  coalesce('valid error: ' || fault, 'model name [missing] not found')
FROM rerank_requests WHERE k IN (1, 2, 3, 4, 6)""",
)

oracle(
    "serve_rewrite_rows",
    cte(
        WINDOWS,
        REWRITE_REQUESTS,
        "said AS (SELECT {'c': conv_id, 't': turn} AS k, turns FROM rewrite_requests WHERE rewrite_requests.k IN (0, 7))",
        rewritten("said"),
    )
    + """SELECT k.c AS conv_id, k.t AS turn, 0::BIGINT AS pos, rewritten, 200::BIGINT AS status, NULL AS error FROM rewritten
UNION ALL
SELECT conv_id, turn, NULL, NULL, 400, coalesce('valid error: ' || fault, 'model name [missing] not found')
FROM rewrite_requests r WHERE r.k NOT IN (0, 7)""",
)

for _name in ("result_sink", "length_bucket_order"):
    oracle(
        _name,
        f"SELECT doc_id, 64::BIGINT AS dims, len(list_distinct({toks('text')}))::BIGINT AS n_tokens FROM documents",
    )

# Evaluation -----------------------------------------------------------------------------------------

DENSE_METRICS = ("cosine_similarity", "euclidean_distance", "l2_norm_difference", "mse", "mae")
SPARSE_METRICS = ("jaccard_similarity", "value_mse", "value_mae")
SCORE_METRICS = ("mse", "mae", "correlation")


def rounded(names: tuple[str, ...]) -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


CUT = "list_transform(embedding::DOUBLE[], lambda x: floor(x * 100) / 100.0::DOUBLE)"


def dense_pairs(copy: str) -> str:
    return f"""
vectors AS (SELECT vec_id AS sample_id, embedding::DOUBLE[] AS a, {copy} AS b FROM embeddings),
sums2 AS (SELECT sample_id, len(a) <> len(b) AS shape_mismatch, len(a) AS n,
    list_sum(list_transform(a, lambda x, i: x * b[i])) AS ab, list_sum(list_transform(a, lambda x: x * x)) AS aa,
    list_sum(list_transform(b, lambda x: x * x)) AS bb,
    list_sum(list_transform(a, lambda x, i: (x - b[i]) * (x - b[i]))) AS sq,
    list_sum(list_transform(a, lambda x, i: abs(x - b[i]))) AS ad FROM vectors WHERE b IS NOT NULL),
dense_metrics AS (SELECT sample_id, shape_mismatch,
    CASE WHEN NOT shape_mismatch THEN CASE WHEN aa * bb = 0 THEN 'nan'::DOUBLE ELSE ab / (sqrt(aa) * sqrt(bb)) END END AS cosine_similarity,
    CASE WHEN NOT shape_mismatch THEN sqrt(sq) END AS euclidean_distance,
    CASE WHEN NOT shape_mismatch THEN abs(sqrt(aa) - sqrt(bb)) END AS l2_norm_difference,
    CASE WHEN NOT shape_mismatch THEN sq / n END AS mse, CASE WHEN NOT shape_mismatch THEN ad / n END AS mae FROM sums2)"""


CLEAN_DENSE_PAIRS = dense_pairs(CUT)
DENSE_PAIRS = dense_pairs(
    f"""CASE WHEN vec_id % 50 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: x * 0.0::DOUBLE)
      WHEN vec_id % 60 = 7 THEN ({CUT})[1:63] WHEN vec_id % 70 = 9 THEN NULL ELSE {CUT} END"""
)

oracle(
    "compare_dense",
    cte(DENSE_PAIRS) + f"SELECT sample_id, shape_mismatch, {rounded(DENSE_METRICS)} FROM dense_metrics",
)

def sparse_pairs(in_gen: str, in_ref: str) -> str:
    return f"""
cells AS (SELECT doc_id AS sample_id, {tid('token')} AS k, 1.0::DOUBLE / (1.0 + pos / 512.0) AS w FROM doc_first),
gen AS (SELECT * FROM cells WHERE {in_gen}),
ref AS (SELECT sample_id, k, floor(w * 100) / 100.0::DOUBLE AS w FROM cells WHERE {in_ref}),
merged AS (SELECT coalesce(g.sample_id, r.sample_id) AS sample_id, g.w AS g, r.w AS r
  FROM gen g FULL JOIN ref r ON g.sample_id = r.sample_id AND g.k = r.k),
sums3 AS (SELECT sample_id, count(*) AS u, count(g - r) AS common_keys_count, count(g) AS generated_keys_count,
    count(r) AS reference_keys_count, avg((g - r) * (g - r)) AS m2, avg(abs(g - r)) AS m1 FROM merged GROUP BY sample_id),
sparse_metrics AS (SELECT d.doc_id AS sample_id, coalesce(common_keys_count, 0) AS common_keys_count,
    coalesce(generated_keys_count, 0) AS generated_keys_count, coalesce(reference_keys_count, 0) AS reference_keys_count,
    coalesce(common_keys_count::DOUBLE / u, 0.0) AS jaccard_similarity,
    coalesce(m2, 'inf'::DOUBLE) AS value_mse, coalesce(m1, 'inf'::DOUBLE) AS value_mae
  FROM documents d LEFT JOIN sums3 s ON s.sample_id = d.doc_id)"""


CLEAN_SPARSE_PAIRS = sparse_pairs("true", "true")
SPARSE_PAIRS = sparse_pairs("w >= 0.3", "w <= 0.9")

for _name in ("compare_sparse", "compare_sparse_long"):
    oracle(
        _name,
        cte(OCCURRENCES, SPARSE_PAIRS)
        + f"""SELECT sample_id, common_keys_count, generated_keys_count, reference_keys_count, {rounded(SPARSE_METRICS)}
FROM sparse_metrics""",
    )

oracle(
    "compare_embeddings",
    cte(OCCURRENCES, DENSE_PAIRS, SPARSE_PAIRS)
    + f"""SELECT 'dense' AS kind, sample_id, {r6('cosine_similarity')} AS first, {r6('mae')} AS second FROM dense_metrics
UNION ALL SELECT 'sparse', sample_id, {r6('jaccard_similarity')}, {r6('value_mae')} FROM sparse_metrics""",
)


def score_pairs(in_golden: str) -> str:
    return f"""
generated AS (SELECT request_id AS sample_id, pos, doc_id, {r6('score')} AS score FROM scored),
golden AS (SELECT sample_id, pos, floor(score * 100) / 100.0::DOUBLE AS score FROM generated WHERE {in_golden}),
score_sums AS (SELECT sample_id, avg((g.score - r.score) * (g.score - r.score)) AS mse, avg(abs(g.score - r.score)) AS mae,
    count(*) AS score_count, covar_pop(g.score, r.score) AS c, stddev_pop(g.score) AS sg, stddev_pop(r.score) AS sr,
    min(g.score) = max(g.score) OR min(r.score) = max(r.score) AS flat
  FROM generated g JOIN golden r USING (sample_id, pos) GROUP BY sample_id),
score_metrics AS (SELECT sample_id, mse, mae, score_count,
    CASE WHEN score_count = 1 THEN 1.0 WHEN flat OR sg * sr = 0 THEN 'nan'::DOUBLE
         ELSE greatest(-1.0, least(1.0, c / (sg * sr))) END AS correlation FROM score_sums)"""


CLEAN_SCORE_PAIRS = score_pairs("true")
SCORE_PAIRS = score_pairs("doc_id IN (SELECT doc_id FROM labels)")

oracle(
    "compare_scores",
    cte(OCCURRENCES, PAIRS, HEAD, SCORE_PAIRS)
    + f"SELECT sample_id, {rounded(SCORE_METRICS)}, score_count FROM score_metrics",
)

oracle(
    "alignment_report",
    cte(OCCURRENCES, PAIRS, HEAD, SCORE_PAIRS)
    + """SELECT g AS generated_samples, r AS reference_samples, b AS total_samples, g <> r AS length_mismatch FROM
  (SELECT (SELECT count(*) FROM generated) AS g, (SELECT count(*) FROM golden) AS r,
          (SELECT count(*) FROM generated JOIN golden USING (sample_id, pos)) AS b)""",
)


def summary(kind: str, metrics: tuple[str, ...], source: str) -> str:
    """NaN anywhere makes every statistic NaN; an infinite value makes the deviation NaN."""
    lines = []
    for m in metrics:
        nan = f"bool_or(isnan({m}))"
        finite = f"CASE WHEN isfinite({m}) THEN {m} END"
        lines.append(
            f"""SELECT '{kind}' AS kind, '{m}' AS metric, count({m}) AS samples,
  CASE WHEN {nan} THEN 'nan'::DOUBLE ELSE avg({m}) END AS mean,
  CASE WHEN {nan} OR bool_or(isinf({m})) THEN 'nan'::DOUBLE ELSE stddev_pop({finite}) END AS std,
  CASE WHEN {nan} THEN 'nan'::DOUBLE ELSE min({m}) END AS min,
  CASE WHEN {nan} THEN 'nan'::DOUBLE ELSE max({m}) END AS max FROM {source} HAVING count({m}) > 0"""
        )
    return "\nUNION ALL\n".join(lines)


SUMMARY = cte(
    OCCURRENCES,
    PAIRS,
    HEAD,
    CLEAN_DENSE_PAIRS,
    CLEAN_SPARSE_PAIRS,
    CLEAN_SCORE_PAIRS,
    "summary AS ("
    + "\nUNION ALL\n".join(
        [
            summary("dense", DENSE_METRICS, "dense_metrics"),
            summary("sparse", SPARSE_METRICS, "sparse_metrics"),
            summary("rerank", SCORE_METRICS, "score_metrics"),
        ]
    )
    + ")",
)

oracle(
    "eval_summary",
    SUMMARY + f"SELECT kind, metric, samples, {rounded(('mean', 'std', 'min', 'max'))} FROM summary",
)

oracle(
    "eval_summary_raw",
    cte(
        OCCURRENCES,
        DENSE_PAIRS,
        SPARSE_PAIRS,
        "summary AS ("
        + summary("dense", DENSE_METRICS, "dense_metrics")
        + "\nUNION ALL\n"
        + summary("sparse", SPARSE_METRICS, "sparse_metrics")
        + ")",
    )
    + f"""SELECT kind, metric, samples, {fixed('mean', 4)} AS mean, {fixed('std', 4)} AS std, {fixed('min', 4)} AS min,
  {fixed('max', 4)} AS max FROM summary""",
)

GATES = """
gates AS (SELECT
    (SELECT mean FROM summary WHERE kind = 'dense' AND metric = 'cosine_similarity') AS cos,
    (SELECT mean FROM summary WHERE kind = 'rerank' AND metric = 'correlation') AS corr)"""

VERDICT = f"""SELECT cos >= 0.9 AS embedding_good, corr >= 0.8 AS reranker_good,
  CASE WHEN cos >= 0.9 AND corr >= 0.8 THEN 'GOOD' WHEN cos >= 0.9 OR corr >= 0.8 THEN 'MIXED' ELSE 'ATTENTION' END AS label,
  CASE WHEN cos >= 0.9 AND corr >= 0.8 THEN '✅ Results look GOOD - Generated files closely match reference data (Cosine Similarity: '
      || {fixed('cos', 4)} || ', Reranker Correlation: ' || {fixed('corr', 4)} || ')'
    WHEN cos < 0.9 AND corr < 0.8 THEN '❌ Results need ATTENTION - Significant differences detected in both components (Cosine Similarity: '
      || {fixed('cos', 4)} || ' < 0.9, Correlation: ' || {fixed('corr', 4)} || ' < 0.8)'
    ELSE '⚠️  Results are MIXED - Some components match well, others need attention (Cosine Similarity: '
      || {fixed('cos', 4)} || ', Correlation: ' || {fixed('corr', 4)} || ')' END AS message FROM gates"""

oracle("verdict", SUMMARY.rstrip() + "," + GATES + "\n" + VERDICT)

_REPORT_LINES = [
    (110, "dense", "cosine_similarity", "Cosine Similarity", 4),
    (111, "dense", "euclidean_distance", "Euclidean Distance", 4),
    (112, "dense", "mse", "MSE", 6),
    (113, "dense", "mae", "MAE", 6),
    (210, "sparse", "jaccard_similarity", "Jaccard Similarity", 4),
    (211, "sparse", "value_mse", "Value MSE", 6),
    (212, "sparse", "value_mae", "Value MAE", 6),
    (310, "rerank", "mse", "MSE", 6),
    (311, "rerank", "mae", "MAE", 6),
    (312, "rerank", "correlation", "Correlation", 4),
]
_REPORT_TITLES = [
    (0, "=" * 80),
    (1, "EVALUATION REPORT: Generated vs Reference Pickle Files"),
    (2, "=" * 80),
    (100, "📊 EMBEDDING COMPARISON RESULTS"),
    (101, "-" * 50),
    (102, "🔹 Dense Embeddings:"),
    (200, "🔹 Sparse Embeddings:"),
    (300, "📊 RERANKER COMPARISON RESULTS"),
    (301, "-" * 50),
    (302, "🔹 Reranker Scores:"),
    (400, "🎯 OVERALL ASSESSMENT"),
    (401, "-" * 50),
    (420, "=" * 80),
]

oracle(
    "eval_report",
    SUMMARY.rstrip()
    + ","
    + GATES
    + "\nSELECT line_no::BIGINT AS line_no, line FROM ("
    + " UNION ALL ".join(f"SELECT {n} AS line_no, '{t}' AS line" for n, t in _REPORT_TITLES)
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT {n}, '  {t}: ' || {fixed('mean', d)} || ' ± ' || {fixed('std', d)} FROM summary "
        f"WHERE kind = '{k}' AND metric = '{m}'"
        for n, k, m, t, d in _REPORT_LINES
    )
    + f" UNION ALL SELECT 410, message FROM ({VERDICT}))",
)

oracle(
    "evaluation_sink",
    f"""SELECT NULL::BIGINT AS sample_id, line FROM ({ORACLES['eval_report']})
UNION ALL SELECT * FROM ({cte(OCCURRENCES)} SELECT d.doc_id, count(f.token)::VARCHAR
  FROM documents d LEFT JOIN doc_first f USING (doc_id) GROUP BY d.doc_id)""",
)

PARITY = """
tensors AS (SELECT vec_id, embedding::DOUBLE[] AS a, CASE vec_id % 4 WHEN 0 THEN embedding::DOUBLE[]
    WHEN 1 THEN list_transform(embedding::DOUBLE[], lambda x: x * 1.5::DOUBLE)
    WHEN 2 THEN list_transform(embedding::DOUBLE[], lambda x: x * -3.0::DOUBLE)
    ELSE (embedding::DOUBLE[])[1:63] END AS b FROM embeddings),
parity AS (SELECT vec_id, b, vec_id % 4 <> 3 AS shape_match, list_transform(a, lambda x, i: abs(x - b[i])) AS gaps,
    len(list_filter(list_transform(a, lambda x, i: abs(x - b[i]) <= 1e-5 + abs(b[i])), lambda ok: NOT ok)) = 0 AS close
  FROM tensors)"""

oracle(
    "backend_parity",
    cte(PARITY)
    + f"""SELECT vec_id, CASE WHEN shape_match THEN '8x8' ELSE '63' END AS shape_b, shape_match,
  CASE WHEN shape_match THEN {r6('list_max(gaps)')} END AS max_abs_err,
  CASE WHEN shape_match THEN {r6('list_sum(gaps) / 64')} END AS mean_abs_err, {r6('b[1]')} AS first_b,
  5::BIGINT AS n_preview, shape_match AND close AS passed FROM parity""",
)

oracle("backend_parity_overall", cte(PARITY) + "SELECT bool_and(shape_match AND close) AS all_passed FROM parity")

# Latency and service metrics ------------------------------------------------------------------------

LOG = """
log AS (SELECT CASE WHEN event_type IN ('click', 'view', 'signup') OR event_id = 0 THEN 'embed' ELSE 'rerank' END AS task,
    CASE WHEN event_id = 0 THEN 'single' ELSE event_type END AS model_name, event_id, ts, value AS latency_ms,
    CASE WHEN event_type = 'error' AND value > 50 AND event_id > 0 THEN 'runtime failure' END AS error FROM events)"""

STATS = """
base AS (SELECT task, model_name, 'Runner_' || model_name AS model_class, count(latency_ms) AS iterations,
    count(error) AS failures, min(error) AS failure, avg(latency_ms) AS mean_ms,
    quantile_cont(latency_ms, 0.5) AS median_ms, coalesce(stddev_samp(latency_ms), 0.0) AS std_ms,
    min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, quantile_cont(latency_ms, 0.95) AS p95_ms,
    quantile_cont(latency_ms, 0.99) AS p99_ms FROM log GROUP BY ALL),
stats AS (SELECT task, model_name, model_class, iterations, CASE WHEN failures = 0 THEN 'ok' ELSE 'failed' END AS status,
    CASE WHEN failures > 0 THEN failure END AS error, """ + ", ".join(
    f"CASE WHEN failures = 0 THEN {c} END AS {c}"
    for c in ("mean_ms", "median_ms", "std_ms", "min_ms", "max_ms", "p95_ms", "p99_ms")
) + ", CASE WHEN failures = 0 THEN 1000.0 / mean_ms END AS qps FROM base)"

_STATS = ("mean_ms", "median_ms", "std_ms", "min_ms", "max_ms", "p95_ms", "p99_ms", "qps")

oracle(
    "latency_stats",
    cte(LOG, STATS) + f"SELECT task, model_name, model_class, iterations, {rounded(_STATS)}, status, error FROM stats",
)

oracle(
    "benchmark_sink",
    cte(LOG, STATS)
    + f"""SELECT s.task, s.model_name, {r6('mean_ms')} AS mean_ms, '5' AS warmup_runs, status, runs, slowest FROM stats s
JOIN (SELECT task, model_name, count(*) AS runs, max(latency_ms) AS slowest FROM log GROUP BY ALL) USING (task, model_name)""",
)

oracle(
    "failed_models",
    cte(LOG, STATS) + "SELECT task, model_name, model_class, error, status FROM stats WHERE status = 'failed'",
)

RANKED = """
ranked AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY mean_ms, model_name) AS position, model_name,
    mean_ms, qps FROM stats WHERE status = 'ok' QUALIFY count(*) OVER (PARTITION BY task) > 1)"""

oracle(
    "rank_models",
    cte(LOG, STATS, RANKED) + f"SELECT task, position, model_name, {rounded(('mean_ms', 'qps'))} FROM ranked",
)

oracle(
    "drop_warmup",
    cte(LOG)
    + """SELECT task, model_name, event_id, latency_ms FROM log
QUALIFY row_number() OVER (PARTITION BY task, model_name ORDER BY ts, event_id) > 5""",
)

_MODEL_LINES = [
    (1, "   Mean latency: ", "mean_ms", " ms"),
    (2, "   Median latency: ", "median_ms", " ms"),
    (3, "   P95 latency: ", "p95_ms", " ms"),
    (4, "   P99 latency: ", "p99_ms", " ms"),
    (5, "   QPS: ", "qps", ""),
    (6, "   Std dev: ", "std_ms", " ms"),
]

oracle(
    "latency_report",
    cte(LOG, STATS)
    + """SELECT task, model_name, 0::BIGINT AS line_no,
  CASE WHEN status = 'ok' THEN '✅ ' || model_name || ':' ELSE '❌ ' || model_name || ': ' || error END AS line FROM stats"""
    + "".join(
        f" UNION ALL SELECT task, model_name, {n}, '{before}' || {fixed(c, 2)} || '{after}' FROM stats WHERE status = 'ok'"
        for n, before, c, after in _MODEL_LINES
    ),
)

oracle(
    "comparison_report",
    cte(LOG, STATS, RANKED)
    + f"""SELECT DISTINCT task, 0::BIGINT AS line_no, CASE task WHEN 'embed' THEN 'Embedding Models (sorted by latency):'
  ELSE 'Reranker Models (sorted by latency):' END AS line FROM ranked
UNION ALL SELECT task, position, '  ' || position || '. ' || model_name || ': ' || {fixed('mean_ms', 2)} || ' ms (QPS: '
  || {fixed('qps', 2)} || ')' FROM ranked""",
)

REQUEST_LOG = """
log AS (SELECT ts, CASE user_id % 3 WHEN 0 THEN 'embed' WHEN 1 THEN 'rerank' ELSE 'rewrite' END AS model_type,
    CASE WHEN user_id % 2 = 0 THEN 'default' ELSE 'other' END AS model_name, 'Runner' || (user_id % 2) AS model_cls,
    CASE event_type WHEN 'signup' THEN 400 WHEN 'error' THEN 500 ELSE 200 END AS status,
    CASE event_type WHEN 'signup' THEN ['validation', 'routing', 'capability'][user_id % 3 + 1] WHEN 'error' THEN 'run' END AS stage,
    value / 10 AS elapsed_s FROM events)"""

for _name in ("request_counter", "metrics_stream"):
    oracle(
        _name,
        cte(REQUEST_LOG)
        + """SELECT model_type, model_name, model_cls, status::BIGINT AS status, count(*) AS requests FROM log
WHERE coalesce(stage, '') NOT IN ('validation', 'routing') GROUP BY ALL""",
    )

_BOUNDS = ("0.005", "0.01", "0.025", "0.05", "0.075", "0.1", "0.25", "0.5", "0.75", "1.0", "2.5", "5.0", "7.5", "10.0")

oracle(
    "latency_histogram",
    cte(REQUEST_LOG, "bounds(le, b) AS (VALUES " + ", ".join(f"('{b}', {b}::DOUBLE)" for b in _BOUNDS) + ", ('+Inf', 'inf'::DOUBLE))")
    + """SELECT model_type, model_name, model_cls, le, count(*) FILTER (elapsed_s <= b) AS bucket_count,
  round(sum(elapsed_s), 4) AS sum_s, count(*) AS runs
FROM log CROSS JOIN bounds WHERE stage IS NULL OR stage = 'run' GROUP BY ALL""",
)

oracle(
    "timeouts",
    cte(REQUEST_LOG)
    + """SELECT model_type, model_name, model_cls, count(*) FILTER (elapsed_s > 15.0) AS timeouts, count(*) AS runs
FROM log WHERE stage IS NULL OR stage = 'run' GROUP BY ALL""",
)

# Streams --------------------------------------------------------------------------------------------

oracle(
    "embed_stream",
    cte(EMBED_BODIES, ROUTED)
    + """SELECT request_id, model, CASE WHEN stage IS NULL AND return_dense THEN len(texts)::BIGINT END AS n_dense,
  CASE WHEN stage IS NULL AND return_sparse THEN len(texts)::BIGINT END AS n_sparse,
  CASE WHEN stage IS NULL THEN 200 ELSE 400 END::BIGINT AS status, error FROM routed""",
)

# The second text of each streamed request is the source name.
SOURCE_HEAD = f"""
doc_lists AS (SELECT doc_id * 2 AS doc_id, {toks('text')} AS l FROM documents
  UNION ALL SELECT doc_id * 2 + 1, {toks('source')} FROM documents),
doc_tokens AS (SELECT doc_id, unnest(l) AS token, unnest(range(len(l))) AS pos FROM doc_lists),
doc_first AS (SELECT doc_id, token, min(pos) AS pos FROM doc_tokens GROUP BY ALL),
item_lists AS (SELECT item_id, {toks('text')} AS l FROM benchmark),
item_tokens AS (SELECT item_id, unnest(l) AS token, unnest(range(len(l))) AS pos FROM item_lists),
item_first AS (SELECT item_id, token, min(pos) AS pos FROM item_tokens GROUP BY ALL),
pairs AS (SELECT d.doc_id * 2 + t.pos AS doc_id, d.doc_id AS request_id, t.pos,
    (d.doc_id // 8) % (SELECT count(*) FROM benchmark) AS item_id
  FROM documents d CROSS JOIN (SELECT unnest([0, 1]) AS pos) t)"""

oracle(
    "rerank_stream",
    cte(SOURCE_HEAD, HEAD)
    + f"""SELECT request_id, pos::BIGINT AS pos, {r6('score')} AS score, 200::BIGINT AS status, NULL AS error FROM scored
WHERE request_id % 7 NOT IN (1, 2)
UNION ALL SELECT doc_id, NULL, NULL, 400, CASE doc_id % 7
  WHEN 1 THEN 'valid error: texts: a non-empty list of strings is required'
  ELSE 'valid error: query: a string is required' END FROM documents WHERE doc_id % 7 IN (1, 2)""",
)

oracle(
    "rewrite_stream",
    cte(
        "windows AS (SELECT conv_id, turn, [role, text] AS turns FROM conversations)",
        REWRITE_REQUESTS,
        "said AS (SELECT {'c': conv_id, 't': turn} AS k, turns FROM rewrite_requests WHERE rewrite_requests.k IN (0, 7))",
        rewritten("said"),
    )
    + """SELECT k.c AS conv_id, k.t AS turn, 0::BIGINT AS pos, rewritten, 200::BIGINT AS status, NULL AS error FROM rewritten
UNION ALL
SELECT conv_id, turn, NULL, NULL, 400, coalesce('valid error: ' || fault, 'model name [missing] not found')
FROM rewrite_requests r WHERE r.k NOT IN (0, 7)""",
)

# adds its statements to ORACLES
from quillmesh.plans import oracles_mechanisms, oracles_models  # noqa: E402, F401
