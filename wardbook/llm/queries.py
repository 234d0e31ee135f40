"""The registered queries of the operators, over the driver's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardbook.llm.decontaminate import contamination, hit_words
from wardbook.llm.frames import table
from wardbook.llm.jaccard_join import similar_documents
from wardbook.llm.language_id import fit, identify
from wardbook.llm.line_dedup import dedup_lines
from wardbook.llm.lm_score import in_training, score_documents
from wardbook.llm.mixing import mix_sources, with_quality, word_count
from wardbook.llm.nearest import nearest
from wardbook.llm.prefix_trie import code_turns, graft, joined_sha256, trie_of
from wardbook.llm.pseudonyms import pseudonymise
from wardbook.llm.scaled_sketch import sketch_edits
from wardbook.llm.spelling import spelling_variants, word_counts
from wardbook.llm.substring_dedup import dedup_substrings
from wardbook.llm.token_counts import token_counts
from wardbook.session import cut_lineage


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers' files lie: $TOKENIZERS_DIR, else the installed package."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest document that it is linked to by shingles."""
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the three-line windows that occurred before."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents by source, drawn by the labels' quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = cut_lineage(with_quality(docs, table(spark, sf_dir, "labels")))
    return mix_sources(sized, quality="__quality", size="size").select("doc_id", "size", "source_size", "target", "taken")


def op4_score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every document, learnt from six of seven folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = score_documents(docs, in_training(F.col("doc_id")), group="lang", borders=True)
    return out.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors for each twentieth one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three of four folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    model = fit(docs, where=fold != 2)
    return identify(docs.drop("lang"), model).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data under pseudonyms (the key is for show; take a secret one)."""
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="wardbook demonstration")
    return out.select("doc_id", "text", F.size("pii_kinds").alias("n_replaced"), "pii_kinds")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts(docs, tokenizer_path())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows of ten words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      (F.size("spans") > 0).alias("contaminated"))


def op10_dedup_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of 20 words that occurred before."""
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    coded = cut_lineage(code_turns(table(spark, sf_dir, "conversations")))
    trie = trie_of(graft(coded))
    nodes = trie.nodes.join(joined_sha256(trie.ends, "node", "conv"), "node", "left")
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                        F.col("saved").alias("saved_tokens"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text; likeness is the share of the document's sketch that the other has."""
    text = lambda c: F.translate(F.base64(c), "\r\n", "")
    out = sketch_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", text("sketch").alias("fingerprint"), text("edited_sketch").alias("edited_fingerprint"),
                      F.col("in_edited").alias("near_edited"), F.col("in_next").alias("near_next"), F.col("like_edited").alias("jaccard_edited"), F.col("like_next").alias("jaccard_next"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of at least three occurrences with its near words, form and root."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants(word_counts(docs, least=5, every=97).where("n >= 3"), ratio=2)


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_dedup_lines, op3_mix_sources, op4_score_documents, op5_nearest, op6_language_id, op7_pseudonyms, op8_token_counts,
                                         op9_decontaminate, op10_dedup_substrings, op11_prefix_trie, op12_fingerprints, op13_spelling_variants)}
