"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.bpe import bpe_encode
from framelake.llm.decontaminate import contaminated
from framelake.llm.hilbert_shards import hilbert_shards
from framelake.llm.k2_treap import ranked_search
from framelake.llm.line_dedup import line_dedup, without_lines
from framelake.llm.merkle import merkle_manifest
from framelake.llm.ngram_join import Similarity, ngram_jaccard_join
from framelake.llm.quality_rules import quality_rules
from framelake.llm.simhash_vptree import simhash_dedup
from framelake.llm.substring_dedup import substring_dedup
from framelake.llm.toxicity import score_toxicity
from framelake.llm.url_rules import judge_urls
from framelake.llm.warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 13 words, cut from all but the smallest doc_id."""
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    coded = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the line-first verdict on every document."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(table(spark, sf_dir, "documents")).select(*columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or toxicity of every document."""
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked at a Jaccard similarity of 0.9 over 3-word shingles."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), Similarity(width=3, num=9, den=10))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents along a Hilbert curve over language, source and size, cut into 16 runs of equal row counts."""
    sharded = hilbert_shards(table(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


#: (verdict, host, path) of the listed rules.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed rule's verdict on every URL, else that of the association rules mined from the URLs that they label."""
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES).withColumn("matched", F.array_join("matched", " "))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back."""
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, with the item and the alignment."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines of all documents, cut from all but the first place."""
    found = line_dedup(table(spark, sf_dir, "documents"))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    kept = F.coalesce(without_lines(), F.lit(""))
    return found.select("doc_id", lines.alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that it gives after the tampering of one in seven."""
    digest = lambda c: F.lower(F.hex(c))
    docs = table(spark, sf_dir, "documents")
    found = merkle_manifest(docs, {"n_chars": F.col("n_chars") + 1}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return found.select("doc_id", *(digest(c).alias(c) for c in ("leaf", "subroot", "root")), digest("proof").alias("proof_sha256"), digest("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose SimHash fingerprints are linked at four differing bits or fewer."""
    found = simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op13_k2_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
