"""The registered queries once more, as DuckDB SQL over the same tables."""

from __future__ import annotations

from turnwise.functions import fixed
from turnwise.operators.requests import ANSWER_SYSTEM, JUDGE_SCALE, JUDGE_SYSTEM, QA_SYSTEM

# Common table expressions; DuckDB evaluates those a query uses.
_WITH = r"""
WITH turns AS (
  SELECT conv_id, turn,
    CASE lower(role) WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS role, text
  FROM conversations
), valid AS (
  SELECT * FROM turns WHERE lower(role) IN ('human', 'gpt') AND regexp_matches(text, '\S')
), sizes AS (
  SELECT c.conv_id, count(v.conv_id) AS n_turns
  FROM conversations c LEFT JOIN valid v ON c.conv_id = v.conv_id AND c.turn = v.turn GROUP BY c.conv_id
), kept AS (
  SELECT * FROM valid WHERE conv_id IN (SELECT conv_id FROM sizes WHERE n_turns >= 4)
), scripts AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(upper(role[1]) || lower(role[2:]) || ': ' || regexp_replace(text, '^\s+|\s+$', '', 'g'),
               chr(10) || chr(10) ORDER BY turn) AS oracle,
    string_agg(turn || '|' || role || '|' || text, chr(10) ORDER BY turn) AS turns_text
  FROM kept GROUP BY conv_id
), tokens AS (
  SELECT *, regexp_extract_all(oracle, '\S+') AS tok FROM scripts
), tails AS (
  SELECT *, CASE WHEN len(tok) <= 512 THEN oracle ELSE array_to_string(tok[-512:], ' ') END AS tail,
    least(len(tok), 512) AS tail_tokens
  FROM tokens
), contexts AS (
  SELECT conv_id, 'oracle' AS strategy, 0 AS strategy_no, oracle AS context, len(tok) AS n_tokens FROM tails
  UNION ALL SELECT conv_id, 'baseline', 1, tail, tail_tokens FROM tails
  UNION ALL SELECT conv_id, 'compressed', 2, tail, tail_tokens FROM tails
), ranked AS (
  SELECT conv_id, md5('42:' || conv_id) AS shuffle_key,
    row_number() OVER (ORDER BY md5('42:' || conv_id), conv_id) - 1 AS split_rank, count(*) OVER () AS n
  FROM sizes WHERE n_turns >= 4
), splits AS (
  SELECT *, CASE
      WHEN split_rank < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train'
      WHEN split_rank < floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val'
      ELSE 'test' END AS split
  FROM ranked
), following AS (
  SELECT conv_id, turn, role, text,
    lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM valid WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), any_qa AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS qa_idx, text AS question,
    CASE WHEN next_role = 'gpt' THEN next_text END AS answer
  FROM following WHERE role = 'human'
), qa AS (
  SELECT * FROM any_qa WHERE conv_id IN (SELECT conv_id FROM scripts)
), asked AS (
  SELECT q.conv_id, q.qa_idx, c.strategy, c.strategy_no, q.question, q.answer AS ground_truth, c.context, c.n_tokens
  FROM qa q JOIN contexts c USING (conv_id) WHERE q.question <> '' AND coalesce(q.answer, '') <> ''
), answered AS (
  SELECT *, CASE WHEN strategy = 'oracle' THEN ground_truth ELSE strategy || ': ' || question END AS answer
  FROM asked
), replies AS (
  SELECT *, (conv_id * 7 + qa_idx * 3 + strategy_no + attempt) % 8 AS k,
    CAST((conv_id + qa_idx + strategy_no) % 11 AS VARCHAR) AS n
  FROM answered, (SELECT unnest([1, 2, 3]) AS attempt)
), verdicts AS (
  SELECT *, CASE k
      WHEN 0 THEN '{"score": ' || n || '}'
      WHEN 1 THEN '```json' || chr(10) || '{"score": ' || n || '.5}' || chr(10) || '```'
      WHEN 2 THEN '{"score": "' || n || '"}'
      WHEN 3 THEN 'Score: ' || n || '/10'
      WHEN 4 THEN '{"score": 1' || n || '0}'
      WHEN 5 THEN '{"score": -' || n || '}'
      WHEN 6 THEN 'no grade' END AS raw_text
  FROM replies
), bare AS (
  SELECT *, trim(regexp_replace(raw_text, '@FENCE@', '', 'g'), ' ' || chr(10)) AS unfenced FROM verdicts
), read AS (
  SELECT *, coalesce(
      CASE WHEN json_valid(raw_text) THEN TRY_CAST(json_extract_string(raw_text, '$.score') AS DOUBLE) END,
      CASE WHEN json_valid(unfenced) THEN TRY_CAST(json_extract_string(unfenced, '$.score') AS DOUBLE) END,
      TRY_CAST(regexp_extract(raw_text, '"score"\s*:\s*([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE),
      CASE WHEN TRY_CAST(regexp_extract(raw_text, '\b([0-9]+(?:\.[0-9]+)?)\b', 1) AS DOUBLE) <= 10
        THEN TRY_CAST(regexp_extract(raw_text, '\b([0-9]+(?:\.[0-9]+)?)\b', 1) AS DOUBLE) END,
      0) AS score
  FROM bare
), scored AS (
  SELECT conv_id, qa_idx, strategy, coalesce(
      min_by(greatest(0, least(10, score)), attempt) FILTER (k <> 7), 0) AS score
  FROM read GROUP BY ALL
), wide AS (
  SELECT a.conv_id, a.qa_idx, any_value(question) AS question, any_value(ground_truth) AS ground_truth,
    max(score) FILTER (a.strategy = 'oracle') AS oracle_score,
    max(score) FILTER (a.strategy = 'baseline') AS baseline_score,
    max(score) FILTER (a.strategy = 'compressed') AS compressed_score,
    max(answer) FILTER (a.strategy = 'oracle') AS oracle_answer,
    max(answer) FILTER (a.strategy = 'baseline') AS baseline_answer,
    max(answer) FILTER (a.strategy = 'compressed') AS compressed_answer,
    max(n_tokens) FILTER (a.strategy = 'oracle') AS oracle_tokens,
    max(n_tokens) FILTER (a.strategy = 'baseline') AS baseline_tokens,
    max(n_tokens) FILTER (a.strategy = 'compressed') AS compressed_tokens
  FROM answered a JOIN scored s ON a.conv_id = s.conv_id AND a.qa_idx = s.qa_idx AND a.strategy = s.strategy
  GROUP BY a.conv_id, a.qa_idx
), results AS (
  SELECT conv_id AS conversation_id, CAST(qa_idx AS INTEGER) AS qa_idx, question, ground_truth,
    oracle_score, baseline_score, compressed_score,
    CAST(printf('%.4f', CASE WHEN oracle_score > 0 THEN compressed_score / oracle_score ELSE 0.0::DOUBLE END) AS DOUBLE)
      AS recovery_rate,
    CAST(printf('%.4f', CAST(baseline_tokens AS DOUBLE) / oracle_tokens) AS DOUBLE) AS compression_ratio,
    oracle_answer, baseline_answer, compressed_answer,
    CAST(oracle_tokens AS INTEGER) AS oracle_tokens, CAST(baseline_tokens AS INTEGER) AS baseline_tokens,
    CAST(compressed_tokens AS INTEGER) AS compressed_tokens
  FROM wide
), methods AS (
  SELECT 'oracle' AS method, oracle_score AS score, 1.0::DOUBLE AS ratio FROM results
  UNION ALL SELECT 'baseline', baseline_score, compression_ratio FROM results
  UNION ALL SELECT 'compressed', compressed_score, compression_ratio FROM results
), summary AS (
  SELECT method, round(avg(score), 6) AS avg_qa_score, round(avg(ratio), 6) AS avg_compression_ratio,
    count(*) AS n_samples
  FROM methods GROUP BY method
), sentences AS (
  SELECT conv_id, turn, regexp_extract_all(lower(text), '@WORD@') AS tokens FROM kept
), words AS (
  SELECT conv_id, turn, unnest(tokens) AS word FROM sentences
), counts AS (
  SELECT word, count(*) AS n FROM words GROUP BY word
), vocabulary AS (
  SELECT word, n FROM counts WHERE n >= 3
), vectors AS (
  SELECT v.word, e.embedding AS vector FROM vocabulary v JOIN embeddings e
    ON e.vec_id = ('0x' || md5(v.word)[1:8])::BIGINT % (SELECT 2 * count(*) FROM embeddings)
), known AS (
  SELECT w.conv_id, w.turn, v.vector FROM words w JOIN vectors v USING (word)
), sums AS (
  SELECT conv_id, turn, count(*) AS n_known FROM known GROUP BY conv_id, turn
), dims AS (
  SELECT conv_id, turn, i - 1 AS dim, avg(CAST(vector[i] AS DOUBLE)) AS value
  FROM known, (SELECT unnest(range(1, 65)) AS i) GROUP BY conv_id, turn, i
), embedded AS (
  SELECT k.conv_id, k.turn, coalesce(s.n_known, 0) AS n_known, CAST(g.dim AS INTEGER) AS dim,
    coalesce(CAST(d.value AS FLOAT), 0) AS value
  FROM kept k CROSS JOIN (SELECT unnest(range(0, 64)) AS dim) g
    LEFT JOIN sums s ON s.conv_id = k.conv_id AND s.turn = k.turn
    LEFT JOIN dims d ON d.conv_id = k.conv_id AND d.turn = k.turn AND d.dim = g.dim
)
"""

_TURNS_TEXT = "turn || '|' || role || '|' || text, chr(10) ORDER BY turn"
_ANSWER_TEXT = "'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question"


def _said(system: str, user: str) -> str:
    """The hash of a request's two messages."""
    return f"sha256('system' || chr(31) || '{system}' || chr(30) || 'user' || chr(31) || {user})"


_ANSWER_ID = (
    f"sha256('answer||' || conv_id || '|' || qa_idx || '|' || strategy || '|' || {_said(ANSWER_SYSTEM, _ANSWER_TEXT)})"
)
_QA_PROMPT = (
    "'Write 3 questions about facts in the conversation below, each with a short answer. '"
    " || 'Reply as {\"qa_pairs\": [{\"question\": \"...\", \"answer\": \"...\"}]}.' || chr(10) || chr(10) || oracle"
)
_JUDGE_TEXT = (
    f"'{JUDGE_SCALE}' || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Reference answer: '"
    " || ground_truth || chr(10) || 'Given answer: ' || answer"
)
_QUESTION = "conv_id, CAST(qa_idx AS INTEGER) AS qa_idx, strategy"
_DIMS = "SELECT word, CAST(200 AS INTEGER) AS dim FROM vocabulary"
_QA_COUNTS = "SELECT conv_id, CAST(count(*) AS INTEGER) AS n_pairs FROM {} GROUP BY conv_id"

_SELECTS = {
    "scan_conversations": "SELECT conv_id, turn, role, text FROM conversations",
    "scan_fallback": (
        "SELECT CAST(conv_id AS VARCHAR) AS conversation_id, CAST(n_turns AS INTEGER) AS n_turns FROM scripts"
    ),
    "flat_to_nested": (
        f"SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, string_agg({_TURNS_TEXT}) AS turns_text "
        "FROM conversations GROUP BY conv_id"
    ),
    "nested_to_flat": "SELECT conv_id, turn, role, text FROM conversations",
    "write_splits": (
        "SELECT split, count(*) AS n, CAST(sum(n_turns) AS BIGINT) AS n_turns "
        "FROM splits JOIN scripts USING (conv_id) GROUP BY split"
    ),
    "read_splits_tolerant": "SELECT split, count(*) AS n FROM splits WHERE split <> 'val' GROUP BY split",
    "read_split_for_qa": (
        "SELECT conv_id, split, turns_text FROM splits JOIN scripts USING (conv_id) WHERE split IN ('val', 'test')"
    ),
    "write_qa": (
        "SELECT s.conv_id, split, CAST(count(q.conv_id) AS INTEGER) AS n_pairs "
        "FROM splits s LEFT JOIN qa q ON q.conv_id = s.conv_id GROUP BY ALL"
    ),
    "read_eval_dataset": (
        "SELECT s.conv_id, CAST(count(q.conv_id) AS INTEGER) AS n_pairs "
        "FROM splits s LEFT JOIN qa q ON q.conv_id = s.conv_id WHERE split = 'val' GROUP BY ALL"
    ),
    "write_results": (
        "SELECT 'run-1' AS run_id, CAST(conversation_id AS VARCHAR) AS conversation_id, qa_idx, oracle_score, "
        "baseline_score, compressed_score, compression_ratio FROM results"
    ),
    "results_artifact": (
        "SELECT run_id, count(*) AS n_results FROM results, (SELECT unnest(['run-1', 'run-2']) AS run_id) "
        "GROUP BY run_id"
    ),
    "metrics_sink": (
        "SELECT 'run-1' AS run_id, 'data/' || s.split || '_size' AS metric, "
        "CAST(count(r.split) AS DOUBLE) AS value FROM (SELECT unnest(['train', 'val', 'test']) AS split) s "
        "LEFT JOIN splits r ON r.split = s.split GROUP BY s.split "
        "UNION ALL SELECT 'run-1', 'word2vec/vocab_size', CAST(count(*) AS DOUBLE) FROM vocabulary "
        "UNION ALL SELECT 'run-1', 'eval/' || method || '/avg_qa_score', avg_qa_score FROM summary "
        "UNION ALL SELECT 'run-1', 'eval/' || method || '/avg_compression_ratio', avg_compression_ratio FROM summary "
        "UNION ALL SELECT 'run-1', 'eval/' || method || '/n_samples', CAST(n_samples AS DOUBLE) FROM summary"
    ),
    "save_word_vectors": _DIMS,
    "load_word_vectors": "SELECT word, true AS same FROM vocabulary",
    "valid_turns": "SELECT conv_id, turn, role, text FROM valid",
    "clean_turns": (
        f"SELECT s.conv_id, CAST(any_value(s.n_turns) AS INTEGER) AS n_turns, "
        f"coalesce(string_agg({_TURNS_TEXT}), '') AS turns_text "
        "FROM sizes s LEFT JOIN valid v ON v.conv_id = s.conv_id GROUP BY s.conv_id"
    ),
    "min_turns_filter": "SELECT conv_id, turn, role, text FROM kept",
    "project_conversation": "SELECT conv_id, CAST(n_turns AS INTEGER) AS n_turns, turns_text FROM scripts",
    "role_alias": "SELECT conv_id, turn, role FROM turns",
    "has_qa": _QA_COUNTS.format("any_qa"),
    "complete_qa": (
        "SELECT conv_id, CAST(qa_idx AS INTEGER) AS qa_idx, question, answer AS ground_truth FROM any_qa "
        "WHERE question <> '' AND coalesce(answer, '') <> ''"
    ),
    "enrich_record": (
        "SELECT s.conv_id, CAST(any_value(s.n_turns) AS INTEGER) AS n_turns, "
        "CAST(count(q.conv_id) AS INTEGER) AS n_pairs "
        "FROM scripts s LEFT JOIN qa q ON q.conv_id = s.conv_id GROUP BY s.conv_id"
    ),
    "result_keys": (
        "SELECT CAST(conversation_id AS VARCHAR) AS conversation_id, qa_idx, question, ground_truth FROM results"
    ),
    "defaults": (
        "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'unknown' ELSE role END AS role, "
        "CASE WHEN role = 'system' THEN '' ELSE text END AS text FROM turns"
    ),
    "explode_qa": (
        "SELECT conv_id, CAST(qa_idx AS INTEGER) AS qa_idx, question, coalesce(answer, '') AS ground_truth FROM qa"
    ),
    "qa_by_strategy": f"SELECT {_QUESTION}, question, ground_truth FROM asked",
    "token_vector_lookup": (
        "SELECT k.conv_id, k.turn, coalesce(t.n_tokens, 0) AS n_tokens, coalesce(s.n_known, 0) AS n_known FROM kept k "
        "LEFT JOIN (SELECT conv_id, turn, count(*) AS n_tokens FROM words GROUP BY conv_id, turn) t "
        "ON t.conv_id = k.conv_id AND t.turn = k.turn LEFT JOIN sums s ON s.conv_id = k.conv_id AND s.turn = k.turn"
    ),
    "vocab_membership": (
        "SELECT c.word, c.n, v.word IS NOT NULL AS known FROM counts c LEFT JOIN vectors v ON v.word = c.word"
    ),
    "attach_responses": f"SELECT {_QUESTION}, {_ANSWER_ID} AS request_id, answer FROM answered",
    "filtered_out": "SELECT conv_id, n_turns FROM sizes WHERE n_turns < 4",
    "filter_counts": (
        "SELECT count(*) FILTER (n_turns >= 4) AS kept, count(*) FILTER (n_turns < 4) AS discarded FROM sizes"
    ),
    "split_sizes": "SELECT split, count(*) AS n FROM splits GROUP BY split",
    "method_summary": "SELECT * FROM summary",
    "turn_embedding": "SELECT conv_id, turn, n_known, dim, round(CAST(value AS DOUBLE), 4) + 0 AS value FROM embedded",
    "vocabulary": "SELECT word, n FROM vocabulary",
    "corpus_stats": (
        "SELECT split, count(DISTINCT conv_id) AS n_conversations, "
        "CAST(count(*) FILTER (len(tokens) > 0) AS BIGINT) AS n_sentences "
        "FROM splits JOIN sentences USING (conv_id) GROUP BY split"
    ),
    "transcript": (
        "SELECT conv_id, string_agg(upper(role[1]) || lower(role[2:]) || ': ' || "
        r"regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY turn) AS transcript "
        "FROM turns GROUP BY conv_id"
    ),
    "eval_rows": "SELECT count(*) AS n_results FROM results",
    "split_stable": (
        "SELECT conv_id, CASE WHEN ('0x' || md5('42:' || conv_id)[:8])::BIGINT < floor(0.8::DOUBLE * 4294967296) THEN 'train' "
        "WHEN ('0x' || md5('42:' || conv_id)[:8])::BIGINT < floor((0.8::DOUBLE + 0.1::DOUBLE) * 4294967296) THEN 'val' ELSE 'test' END AS split "
        "FROM sizes WHERE n_turns >= 4"
    ),
    "conversation_bytes": (
        "SELECT conv_id, count(*) AS n_turns, CAST(sum(coalesce(strlen(role), 0) + coalesce(strlen(text), 0) + 64) AS BIGINT) AS n_bytes "
        "FROM conversations GROUP BY conv_id HAVING n_bytes > 1500"
    ),
    "split_assign": "SELECT conv_id, split FROM splits",
    "position": (
        "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position, turn "
        "FROM kept"
    ),
    "resolve_attempts": f"SELECT {_QUESTION}, score FROM scored",
    "resolve_qa_attempts": (
        "SELECT conv_id, CAST(coalesce(min_by(CASE WHEN k < 3 THEN n_pairs ELSE 0 END, attempt) FILTER (k < 4), 0) "
        "AS INTEGER) AS n_pairs FROM "
        "(SELECT s.conv_id, attempt, (s.conv_id * 5 + attempt) % 6 AS k, "
        "(SELECT count(*) FROM qa WHERE qa.conv_id = s.conv_id) AS n_pairs "
        "FROM scripts s, (SELECT unnest([1, 2, 3]) AS attempt)) GROUP BY conv_id"
    ),
    "sample_first_n": (
        "SELECT s.conv_id, split, CAST(count(*) AS INTEGER) AS n_pairs FROM splits s JOIN qa USING (conv_id) "
        "GROUP BY s.conv_id, split, shuffle_key ORDER BY shuffle_key, s.conv_id LIMIT 20"
    ),
    "token_tail": (
        r"SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '\S+')) <= 32 THEN text "
        r"ELSE array_to_string(regexp_extract_all(text, '\S+')[-32:], ' ') END AS tail FROM kept"
    ),
    "sorted_summary": "SELECT method, n_samples, avg_qa_score FROM summary",
    "seeded_shuffle": "SELECT conv_id, shuffle_key, split_rank FROM ranked",
    "preview": "SELECT conv_id, CAST(qa_idx AS INTEGER) AS qa_idx, left(question, 60) AS shown FROM qa",
    "union_splits": "SELECT conv_id, turn, split, text FROM splits JOIN kept USING (conv_id)",
    "union_files": (
        "SELECT CAST(conv_id AS VARCHAR) AS conversation_id, "
        "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM turns"
    ),
    "ctx_oracle": "SELECT conv_id, oracle AS context FROM scripts",
    "ctx_compressed": "SELECT conv_id, tail AS context FROM tails",
    "ctx_baseline": "SELECT conv_id, tail AS context FROM tails",
    "context_stats": "SELECT conv_id, strategy, CAST(n_tokens AS INTEGER) AS n_tokens FROM contexts",
    "compression_ratio": (
        "SELECT conv_id, n_turns, CAST(len(tok) AS BIGINT) AS oracle_tokens, "
        "CAST(tail_tokens AS BIGINT) AS baseline_tokens, "
        "CAST(printf('%.4f', CAST(tail_tokens AS DOUBLE) / len(tok)) AS DOUBLE) AS compression_ratio FROM tails"
    ),
    "recovery_rate": (
        "SELECT CAST(conversation_id AS VARCHAR) AS conversation_id, qa_idx, oracle_score, compressed_score, "
        "recovery_rate FROM results"
    ),
    "qa_requests": (
        f"SELECT sha256('qa||' || conv_id || '|' || {_said(QA_SYSTEM, _QA_PROMPT)}) AS request_id, conv_id, '{QA_SYSTEM}' AS system_text, "
        f"{_QA_PROMPT} AS user_text FROM scripts"
    ),
    "answer_requests": (
        f"SELECT {_ANSWER_ID} AS request_id, {_QUESTION}, '{ANSWER_SYSTEM}' AS system_text, "
        f"{_ANSWER_TEXT} AS user_text FROM asked"
    ),
    "judge_requests": (
        "SELECT sha256('judge||' || conv_id || '|' || qa_idx || '|' || strategy || '|' || "
        f"{_said(JUDGE_SYSTEM, _JUDGE_TEXT)}) AS request_id, {_QUESTION}, "
        f"'{JUDGE_SYSTEM}' AS system_text, {_JUDGE_TEXT} AS user_text FROM answered"
    ),
    "parse_qa_response": (
        "SELECT conv_id, CAST(attempt AS INTEGER) AS attempt, k < 4 AS parse_ok, "
        "CASE WHEN k < 3 THEN pairs WHEN k = 3 THEN '' END AS pairs_text FROM "
        "(SELECT s.conv_id, attempt, (s.conv_id * 5 + attempt) % 6 AS k, pairs FROM scripts s "
        "JOIN (SELECT conv_id, string_agg(concat_ws(' => ', question, answer), chr(10) ORDER BY qa_idx) AS pairs "
        "FROM qa GROUP BY conv_id) USING (conv_id), (SELECT unnest([1, 2, 3]) AS attempt))"
    ),
    "extract_score": (
        f"SELECT {_QUESTION}, CAST(attempt AS INTEGER) AS attempt, raw_text, score FROM read WHERE k <> 7"
    ),
    "clamp_score": (
        f"SELECT {_QUESTION}, CAST(attempt AS INTEGER) AS attempt, "
        "CASE WHEN k = 7 THEN 'api_error' ELSE 'ok' END AS status, "
        "CASE WHEN k <> 7 THEN greatest(0, least(10, score)) END AS score FROM read"
    ),
    "strip_prompt": f"SELECT {_QUESTION}, trim(ground_truth, ' ' || chr(10)) AS answer FROM asked",
    "custom_strategies": (
        ", chosen AS (SELECT conv_id, strategy, context, n_tokens FROM contexts WHERE strategy <> 'compressed' "
        "UNION ALL SELECT conv_id, 'last_64', NULL, least(len(tok), 64) FROM tokens), "
        "graded AS (SELECT c.strategy AS method, "
        "CAST(length(CASE WHEN c.strategy = 'oracle' THEN q.answer ELSE c.strategy || ': ' || q.question END) % 11 "
        "AS DOUBLE) AS score, CASE WHEN c.strategy = 'oracle' THEN 1.0::DOUBLE ELSE "
        "CAST(printf('%.4f', CAST(c.n_tokens AS DOUBLE) / len(t.tok)) AS DOUBLE) END AS ratio "
        "FROM qa q JOIN chosen c USING (conv_id) JOIN tokens t USING (conv_id) "
        "WHERE q.question <> '' AND coalesce(q.answer, '') <> '') "
        "SELECT method, round(avg(score), 6) AS avg_qa_score, round(avg(ratio), 6) AS avg_compression_ratio, "
        "count(*) AS n_samples FROM graded GROUP BY method"
    ),
    "scan_json_arrays": (
        "SELECT CAST(conv_id AS VARCHAR) AS conversation_id, CAST(count(*) AS INTEGER) AS n_turns FROM conversations "
        "GROUP BY conv_id"
    ),
    "eval_wide": "SELECT * REPLACE (CAST(conversation_id AS VARCHAR) AS conversation_id) FROM results",
    "flat_metrics": (
        "SELECT 'eval/' || method || '/avg_qa_score' AS metric, avg_qa_score AS value FROM summary "
        "UNION ALL SELECT 'eval/' || method || '/avg_compression_ratio', avg_compression_ratio FROM summary "
        "UNION ALL SELECT 'eval/' || method || '/n_samples', CAST(n_samples AS DOUBLE) FROM summary"
    ),
    "sentences": (
        "SELECT conv_id, turn, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS tokens_text "
        "FROM sentences WHERE len(tokens) > 0"
    ),
    "train_word2vec": "SELECT word, CAST(200 AS INTEGER) AS dim, true AS sane FROM vocabulary",
    "embedding_norm": (
        "SELECT conv_id, turn, round(sqrt(sum(CAST(value AS DOUBLE) * value)), 4) AS norm FROM embedded "
        "GROUP BY conv_id, turn"
    ),
    "batch_infer": (
        f"SELECT {_ANSWER_ID} AS request_id, CAST(1 AS INTEGER) AS attempt, 'ok' AS status, "
        rf"len(regexp_extract_all({_ANSWER_TEXT}, '\S+')) || ' tokens' AS raw_text, CAST(NULL AS VARCHAR) AS error FROM asked"
    ),
    "strategy_registry": (
        "SELECT conv_id, strategy, CASE WHEN strategy <> 'compressed' THEN context WHEN len(tok) <= 64 THEN oracle "
        "ELSE array_to_string(tok[-64:], ' ') END AS context, CAST(CASE WHEN strategy <> 'compressed' THEN n_tokens "
        "ELSE least(len(tok), 64) END AS INTEGER) AS n_tokens FROM contexts JOIN tokens USING (conv_id)"
    ),
    # The stand-ins ask for the last line, answer with a token count (of the context and six words around it), and
    # grade by the length of the line that holds the answer.
    "evaluation_run": (
        ", sampled AS (SELECT conv_id FROM splits WHERE split = 'val' ORDER BY shuffle_key, conv_id LIMIT 100), "
        "graded AS (SELECT c.strategy AS method, "
        "CAST(length('Given answer: ' || (c.n_tokens + 6) || ' tokens') % 11 AS DOUBLE) AS score, "
        "CASE WHEN c.strategy = 'oracle' THEN 1.0::DOUBLE ELSE "
        "CAST(printf('%.4f', CAST(t.tail_tokens AS DOUBLE) / len(t.tok)) AS DOUBLE) END AS ratio "
        "FROM contexts c JOIN tails t USING (conv_id) JOIN sampled USING (conv_id)) "
        "SELECT method, round(avg(score), 6) AS avg_qa_score, round(avg(ratio), 6) AS avg_compression_ratio, "
        "count(*) AS n_samples FROM graded GROUP BY method"
    ),
}

_PATTERNS = {"@WORD@": fixed.WORD.replace("'", "''"), "@FENCE@": fixed.CODE_FENCE}


def _filled(sql: str) -> str:
    for mark, pattern in _PATTERNS.items():
        sql = sql.replace(mark, pattern)
    return sql


ORACLE = {name: _filled(_WITH + select) for name, select in _SELECTS.items()}
