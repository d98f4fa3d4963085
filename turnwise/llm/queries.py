"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import (
    alignment,
    byte_cnn,
    decontaminate,
    mixing,
    ngram_join,
    periodic,
    perplexity,
    separators,
    simhash,
    substrings,
    token_files,
    toxicity,
    url_rules,
)
from turnwise.llm.labelled import fold
from turnwise.sources.scratch import land, scratch_path

END = 2  # the id after each document of a token file
SEPARATOR = 49407  # <|endoftext|> of the word vocabulary: no text yields it when special tokens are encoded as plain text
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    index = toxicity.build_index(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score_toxicity(docs, index, keep=["doc_id"]).select("row.doc_id", "score", "evidence")
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.find_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = land(mixing.measured(table(spark, sf_dir, "documents"), ["doc_id"]), scratch_path(spark, "op3"))
    return mixing.mix(rows, narrow=rows.drop("row")).select("row.doc_id", "size", "source_size", "target", "taken")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.link_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "class_id", "n_links")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge_quality(table(spark, sf_dir, "documents"), keep=["doc_id"])
    bands = ["perplexity", "lower", "upper", "start_perplexity", "start_lower", "start_upper"]
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *bands)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"), tokenizer_file(), SEPARATOR).select("doc_id", "n_tokens")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_file(), END)
    return token_files.read_documents(spark, path)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = [F.struct(F.lit(host).alias("host"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict")) for host, path, verdict in RULES]
    rules = spark.range(1).select(F.inline(F.array(*rule)))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, rules).select("row.page_id", "host", "path", "rule", "verdict")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def quality_network(spark: SparkSession, sf_dir: str, docs: DataFrame) -> byte_cnn.Network:
    return byte_cnn.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = byte_cnn.score_quality(docs, quality_network(spark, sf_dir, docs), keep=["doc_id"]).select("row.doc_id", "score")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    aligned = alignment.align_tokens(table(spark, sf_dir, "documents"), *files, keep=["doc_id"])
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    counted = alignment.count_links(aligned.withColumn("groups_sha256", digest), *files)
    return counted.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.link_fingerprints(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten goes on, from some word to its end, with the words from there over and over. ``docs`` has ``doc_id`` and ``text``."""
    h = F.crc32(F.col("doc_id").cast("string"))
    found = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    n, g = F.size("words"), F.floor(h / 10)
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    root = F.slice("words", (a + 1).cast("int"), p.cast("int"))
    again = F.slice(F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), a.cast("int")), again), " ")
    return docs.withColumn("words", found).select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.find_runs(with_planted_runs(docs), keep=["doc_id"]).withColumn("most", periodic.greatest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "most.start",
        "most.length",
        "most.period",
        F.floor(1000 * F.col("most.length") / F.col("most.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substrings": op2_substrings,
    "op3_mixing": op3_mixing,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_token_files": op7_token_files,
    "op8_url_rules": op8_url_rules,
    "op9_decontaminate": op9_decontaminate,
    "op10_byte_cnn": op10_byte_cnn,
    "op11_alignment": op11_alignment,
    "op12_simhash": op12_simhash,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE = {
    "op2_substrings": r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM doc WHERE len(w) >= 35)
), repeated AS (
  SELECT r, i FROM windows WHERE gram IN (SELECT gram FROM windows GROUP BY gram HAVING count(*) > 1)
), gone AS (
  SELECT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM repeated) GROUP BY r, p
), lists AS (
  SELECT r, list(p) AS ps FROM gone GROUP BY r
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS text
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM doc) t
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = t.r AND g.p = t.p) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN lists USING (r) LEFT JOIN kept USING (r)""",
    "op3_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, text,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, chr(0)) || ':' || coalesce(md5(text), chr(0))), 1, 13))::BIGINT::DOUBLE + 0.5)
      / 4503599627370496.0::DOUBLE AS u
  FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    -ln(u) / (0.1::DOUBLE + 0.9::DOUBLE * (1 - least(1.0::DOUBLE,
      coalesce(length(text) - length(translate(text, '#*$%&|<>!', '')), 0)::DOUBLE / greatest(1, size)))) AS key
  FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS s,
    [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM keyed GROUP BY source
), filled AS (
  SELECT *, 2 * s AS cap, sum(s) OVER () * 1.5::DOUBLE AS total,
    coalesce(sum(2 * s) OVER (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
  FROM sources
), marked AS (
  SELECT *, cap * onward <= (total - before) * w AS full_ FROM filled
), quota AS (
  SELECT source, s, CASE WHEN full_ THEN cap::DOUBLE
    ELSE (total - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN full_ THEN 0.0::DOUBLE ELSE w END) OVER () END AS target
  FROM marked
), epochs AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS e FROM quota
), groups AS (
  SELECT source, key, count(*) AS n, sum(size) AS size FROM keyed GROUP BY source, key
), ahead AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM groups
)
SELECT k.doc_id, k.size, q.s AS source_size, q.target,
  (q.e * k.size + floor(greatest(0, least(a.size, floor(q.target - q.e * q.s) - a.ahead)) / a.n))::BIGINT AS taken
FROM keyed k
JOIN epochs q ON q.source IS NOT DISTINCT FROM k.source
JOIN ahead a ON a.source IS NOT DISTINCT FROM k.source AND a.key = k.key""",
    "op8_url_rules": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path""",
    "op9_decontaminate": r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM item WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM item_window
), doc_window AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)
), hit AS (SELECT r, i, n, item FROM doc_window JOIN item_window USING (n, gram)
), word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN listed USING (r)""",
}
