"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, embeddings, hmm, langid, licenses, linededup, sharding, simhash
from .common import durable, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.deduplicate(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("n_bytes_left"), F.sha2("text", 256).alias("text_sha256"))


OP2_SQL = """
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM docs),
line AS (SELECT doc_id, text, unnest(range(len(lines))) AS i, unnest(lines) AS x FROM parts),
filled AS (SELECT doc_id, text, i, trim(x) AS x, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id, text) AS n
  FROM line WHERE trim(x) <> '' WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
spans AS (SELECT doc_id, text, i AS a, k, n, x || chr(10) || coalesce(lead(x) OVER w, '') || chr(10) || coalesce(lead(x, 2) OVER w, '') AS name,
    coalesce(lead(i, 2) OVER w, lead(i) OVER w, i) AS b
  FROM filled WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
win AS (SELECT doc_id, text, a, b, name FROM spans WHERE k <= n - 2 OR k = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, a) AS r FROM win),
gone AS (SELECT DISTINCT l.doc_id, l.text, l.i FROM line l JOIN ranked g ON l.doc_id = g.doc_id AND l.text = g.text AND l.i BETWEEN g.a AND g.b WHERE g.r > 1),
kept AS (SELECT l.doc_id, l.text, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS left_text
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.text = g.text AND l.i = g.i GROUP BY l.doc_id, l.text)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, CAST(strlen(k.left_text) AS BIGINT) AS n_bytes_left, sha256(k.left_text) AS text_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id <= coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN n ON vec_id = n.a
"""


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = hmm.held_out(F.col("doc_id"))
    learn = docs.where(~out)
    counts = durable(hmm.word_counts(learn))
    model = hmm.vocabulary(counts)
    coded = hmm.encode(docs, model)
    model = hmm.fit(learn, counts, model=model, coded=coded.where(~hmm.held_out(F.col("id"))))
    return hmm.score(docs, model, counts, coded=coded).withColumn("held_out", out)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = langid.fit(docs)
    found = langid.predict(docs.select("doc_id", "text"), network)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    tree = sharding.even_tree(16)
    placed = sharding.assign(slim, tree, new_tree=sharding.grown(tree))
    numbered = sharding.with_slots(placed, ["doc_id", "size", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


#: A conversation that consists of another template's control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    tree = rows.withColumn("msg_id", F.row_number().over(by)).withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1))
    out = chat.conversations(tree, tree="conv_id", score=None)
    turns, learned = chat.read_back(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    out = out.withColumns({"turns": turns, "learned": learned})
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(17 + length(role) + length(regexp_replace(role, '[^\\\\<\\[\\n]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\\\<\\[]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded_col="decoded")
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files in folders of source, five thousands and five hundreds of ids.

    A text whose first or last line speaks of licences stands for a licence
    file, one folder up, whatever its length.
    """
    notice = F.coalesce(F.substring_index("text", "\n", 1).rlike(licenses.CUE) | F.substring_index("text", "\n", -1).rlike(licenses.CUE), F.lit(False))
    number = F.col("doc_id").cast("string")
    folder = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 5000).cast("string"))
    inner = F.concat_ws("/", folder, F.floor(F.col("doc_id") / 500).cast("string"), F.concat(F.lit("document."), number))
    return docs.withColumn("path", F.when(notice, F.concat_ws("/", folder, F.concat(F.lit("LICENSE."), number))).otherwise(inner))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return licenses.scan(document_paths(docs), key_col="doc_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(greatest(len(w) - 7, 1))) AS i FROM b WHERE len(w) > 0 AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i + 1:i + 8], ' ') AS win FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT r, n, w, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, sizes),
dw AS (SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS win FROM di),
hit AS (SELECT r, n, i, item_id FROM dw JOIN bw USING (n, win)),
pos AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit),
ph AS (SELECT r, count(*) AS n_hit FROM pos GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN ph USING (r) LEFT JOIN it USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_line_dedup, op3_embeddings, op4_hmm, op5_language_id, op6_sharding, op7_chat, op8_byte_bpe, op9_licenses, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_embeddings": OP3_SQL, "op7_chat": OP7_SQL, "op10_decontaminate": OP10_SQL}
