"""A corpus from documents: language, repeated lines, near copies, leaks, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Each works on all that its predecessor
kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefront.llm import bpe, decontaminate, jaccard, langid, linededup
from wavefront.llm.common import HIDDEN, durable, table

#: No SQL can express the network, the shingles or the tokens.
ORACLE_SQL = None


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of four megabytes, so that no long ones make a worker large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without null texts and texts without a letter; these have no language.

    A missing ``lang`` is filled with the prediction, which decides nothing
    else. Where no row has a ``lang`` to learn from, it stays missing. Empty
    texts go like all without a letter; texts of any length are read whole;
    repeated rows get the same language and all stay; nulls in other columns
    and columns of any other name stay as they are. No rows give no rows.
    """
    _small_batches(spark)
    found, score = f"{HIDDEN}lang", f"{HIDDEN}score"
    out = langid.predict(docs, langid.fit(docs), "text", found, score, keep_text=True)
    out = out.where(F.col("text").rlike(r"\p{L}"))
    return out.withColumn("lang", F.coalesce("lang", F.nullif(found, F.lit(langid.UNKNOWN)))).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With repeated three-line windows cut, and without the rows of which nothing is left.

    ``n_chars`` is counted again where a text changed. The first of equal
    windows stays, by id (null last); rows of one id and text count as one and
    keep the same lines. Null and empty texts stay as they are, as do nulls and
    columns of any other name. No rows give no rows.
    """
    before, cut = f"{HIDDEN}lines", f"{HIDDEN}removed"
    out = linededup.deduplicate(docs, n_lines=before, n_removed=cut)
    changed = F.col(cut) > 0
    out = out.where(~(changed & (F.trim("text") == "")))
    return out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one row of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more.

    Operator 1 joins the fingerprints of these shingles, and what it links is
    compared exactly. Its 64 bits can't reach all such pairs (they differ in up
    to 15 bits), so the other candidates come from shared shingles; parities of
    segments bound the difference from below, and what is left is compared
    exactly. The row
    with the least id stays (null last), of rows of one id one. Null and empty
    texts are copies of each other. Other columns stay as they are. No rows
    give no rows.
    """
    _small_batches(spark)
    return jaccard.drop_similar(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows in which benchmark items occur.

    Null and empty texts have no words and stay; repeated rows go or stay
    together; other columns stay as they are. No rows give no rows.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), least_items=1).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, the text that they decode to, and whether that is the text they came from.

    A null text has no tokens, and its ``text_sha256`` and ``round_trip`` are
    null; an empty one has none and comes back. Repeated rows each get a row;
    columns other than doc_id, lang and source are left out. No rows give no rows.
    """
    _small_batches(spark)
    slim = docs.select("doc_id", "lang", "source", F.col("text"), F.sha2("text", 256).alias("text_sha256"))
    coded = bpe.encode(slim, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded_col="decoded")
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "text_sha256", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each stage's rows are written once to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
