"""Queries opN_<name> over the given tables, each through its operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm import (
    bpe,
    chat,
    cutting_stock,
    decontaminate,
    hard_negatives,
    lexical,
    license_scan,
    packing,
    pii,
    quality_knn,
    quality_rules,
    simhash,
    warc,
)
from signalmill.llm.common import table
from signalmill.session import scratch_path
from signalmill.sources.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PSEUDONYM_KEY = "signalmill"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op1_warc",
    """
    WITH p AS (
      SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
      FROM pages),
    last AS (SELECT payload_digest AS d, max(page_id) AS last_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
    FROM p LEFT JOIN last ON d = payload_digest
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as archives with one gzip member per record, read back through the sidecar index."""
    root = scratch_path(spark, "warc")
    warc.write_streams(table(spark, sf_dir, "pages"), f"{root}/streams")
    warc.normalize(spark, f"{root}/streams", f"{root}/archives")
    index = warc.write_index(spark, f"{root}/archives", f"{root}/index")
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components by 64-bit SimHash, 4-word shingles, 4 differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, budget=4)


@query("op3_quality_knn")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by its nearest labelled neighbours."""
    docs = table(spark, sf_dir, "documents")
    return quality_knn.score(docs, quality_knn.train(docs, table(spark, sf_dir, "labels")))


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the calibrated classifier's verdict on every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all documents."""
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(license_scan.unknown_paragraphs(docs)))


@query(
    "op6_chat",
    """
    WITH t AS (
      SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
    p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t),
    s AS (
      SELECT t.*, perspective, speaker = perspective AS is_assistant,
             CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
                  ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
    r AS (
      SELECT *, head || text || '<|end|>' || chr(10) AS segment,
             row_number() OVER w - 1 AS position,
             coalesce(sum(length(head || text || '<|end|>' || chr(10))) OVER w, 0) AS seg_end
      FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker, is_assistant, segment,
           CAST(seg_end - length(segment) AS BIGINT) AS seg_start, CAST(seg_end AS BIGINT) AS seg_end,
           CAST(CASE WHEN is_assistant THEN seg_end - length(segment) + length(head) END AS BIGINT) AS mask_start,
           CAST(CASE WHEN is_assistant THEN seg_end END AS BIGINT) AS mask_end
    FROM r
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's perspective."""
    return chat.segments(table(spark, sf_dir, "conversations"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed id rows, written and read back."""
    rows = packing.pack(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return packing.digest(written(rows, "packed"))


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under pseudonyms, with the number of values replaced by kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, PSEUDONYM_KEY, counts=True)


@query("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document and their decoding, as digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query("op10_decontaminate")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op11_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
      FROM embeddings
      WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
             CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT * FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    n AS (
      SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
       AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM n WHERE rank <= 10
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, among all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


@query(
    "op12_lexical_search",
    r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM documents),
    held AS (SELECT row_number() OVER () AS doc, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
    corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM held),
    tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM held) GROUP BY ALL),
    w AS (
      SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, corpus GROUP BY term, docs),
    q AS (
      SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark),
    times AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
    s AS (
      SELECT item_id, doc_id, doc,
             CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
      FROM times JOIN tf USING (term) JOIN w USING (term) JOIN held USING (doc), corpus GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM s WHERE score > 0
    QUALIFY rank <= 20
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_cutting_stock")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048 ids."""
    return cutting_stock.pack(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)
