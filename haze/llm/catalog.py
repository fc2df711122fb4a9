"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.llm import (archives, chat, decontaminate, neardup, packing, personal, quality, repeats, resample,
                      token_files, urls, vectordup, whitening)
from haze.session import scratch_dir

URL_RULES = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"),
             urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.annotated(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return rows.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))


def op2_arc_to_warc(spark, sf_dir):
    return archives.pages_through_archives(spark, table(spark, sf_dir, "pages"))


def op3_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.counts_through_files(docs, scratch_dir(spark, "tokens"), tokenizer_file(), separator=49407)


def op4_personal_data(spark, sf_dir):
    return personal.report(table(spark, sf_dir, "documents"))


def op5_chat_repair(spark, sf_dir):
    rows = chat.repaired(table(spark, sf_dir, "conversations"))
    return rows.select(F.col("conv").alias("conv_id"), "turn", "role", "new_role", "action",
                       F.array_join("inserted", ",").alias("inserted"), "piece")


def op6_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows, _ = quality.rated(docs, labels, ["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       quality.base_failed().alias("base_failed"), (F.col("verdict") == "keep").alias("kept"))


def op8_superminhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.groups(docs, width=2, percent=80).select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op9_repeated_substrings(spark, sf_dir):
    return repeats.removal_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.tokenised_pieces(docs, tokenizer_file())
    return packing.packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_whitening(spark, sf_dir):
    return whitening.long_form(whitening.whitened(table(spark, sf_dir, "embeddings")))


def op12_subspace_neardup(spark, sf_dir):
    return vectordup.groups(table(spark, sf_dir, "embeddings")).select(
        F.col("doc_id").alias("vec_id"), "n_links", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op13_importance_resampling(spark, sf_dir):
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_decontaminate, op2_arc_to_warc, op3_token_counts, op4_personal_data, op5_chat_repair, op6_url_filter,
        op7_quality_rules, op8_superminhash, op9_repeated_substrings, op10_best_fit_packing, op11_whitening, op12_subspace_neardup,
        op13_importance_resampling)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bs AS (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bs)),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bs) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT *, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to
FROM k"""

OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                        ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = d.doc_id"""


OP12_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, embedding FROM embeddings),
c AS (SELECT k, unnest(range(1, len(embedding) + 1)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM v),
ok AS (SELECT k, sqrt(sum(x * x)) AS n FROM c GROUP BY k HAVING count(x) = count(*) AND count_if(NOT isfinite(x)) = 0 AND sum(x * x) > 0),
u AS (SELECT c.k, c.j, c.x / ok.n AS x FROM c JOIN ok USING (k)),
link AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.j = b.j AND a.k <> b.k GROUP BY 1, 2 HAVING sum(a.x * b.x) >= 0.9e0),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT r.a, min(v.vec_id) AS low FROM reach r JOIN v ON v.k = r.b GROUP BY r.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low.low, vec_id)) AS component_id,
       vec_id <= coalesce(low.low, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.k LEFT JOIN low ON low.a = v.k"""

# CRC-32 of each distinct word: a table of 256 remainders of the polynomial, eight shifts each, then one step per byte
OP13_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
rem AS MATERIALIZED (SELECT i, c FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
dw AS MATERIALIZED (SELECT doc_id, unnest(w) AS word FROM d),
bw AS MATERIALIZED (SELECT unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
words AS MATERIALIZED (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
step AS (
  SELECT word, h, CAST(4294967295 AS BIGINT) AS c, 1 AS p FROM words
  UNION ALL
  SELECT word, h, xor(step.c // 256, rem.c), p + 2 FROM step JOIN rem
    ON rem.i = xor(step.c % 256, CAST(('0x' || substr(h, p, 2)) AS BIGINT)) WHERE p < length(h)),
bucket AS MATERIALIZED (SELECT word, xor(c, 4294967295) % 10000 AS b FROM step WHERE p > length(h)),
s AS (SELECT b, count(*) AS n FROM dw JOIN bucket USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN bucket USING (word) GROUP BY b),
gain AS (SELECT s.b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) AS DOUBLE) * ((SELECT sum(n) FROM s) + 10000)
                / (CAST((s.n + 1) AS DOUBLE) * (coalesce((SELECT sum(n) FROM t), 0) + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b)),
weight AS (SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN bucket USING (word) JOIN gain USING (b) GROUP BY doc_id),
score AS (SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || d.doc_id), 1, 8)) AS BIGINT)
                                            + 0.5e0) / 4294967296.0e0))) AS BIGINT) AS score
          FROM d LEFT JOIN weight USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM score WHERE n_features >= 20)
SELECT score.doc_id, n_features, weight, score, CASE WHEN k <= (SELECT count(*) FROM able) * 10 // 100 THEN k END AS rank
FROM score LEFT JOIN able USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL.strip(), "op2_arc_to_warc": OP2_SQL.strip(), "op8_superminhash": OP8_SQL.strip(),
            "op12_subspace_neardup": OP12_SQL.strip(), "op13_importance_resampling": OP13_SQL.strip()}
