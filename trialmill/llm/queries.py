"""The registered queries of this package, their SQL where it can state them, and the stages of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, byte_bpe, chat_prefix, html_blocks, line_templates, mixing, ngram_trie, piece_bpe, pivot_table, toxicity,
    url_terms, vp_centroids, vp_trees,
)
from .shared import stage, table
from .sql import SQL, op3

#: Vocabulary of the tokenizer.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The two tokenizers that are aligned; the second is also encoded and decoded.
BYTE_MODEL, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Rules that decide before the terms of a URL.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Words of a gram and the least similarity of the n-gram join's query.
GRAM_WORDS, GRAM_LEAST = 4, (85, 100)


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates."""
    done = line_templates.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", "text")


def op2_ngram_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return ngram_trie.connect(table(spark, sf_dir, "documents"), GRAM_WORDS, GRAM_LEAST)


def op3_url_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    judged = url_terms.judge(table(spark, sf_dir, "pages"), RULES)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return judged.select("page_id", "host", "path", "rule", "verdict", joined("strict_terms"), joined("soft_terms"))


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    done = html_blocks.extract(table(spark, sf_dir, "pages"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        toxicity.is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


def op6_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its examples with their contexts written out."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    return chat_prefix.read_examples(chat_prefix.materialise(chat_prefix.expand(turns.unionByName(own)), rest=True))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mixing.plan(table(spark, sf_dir, "documents"))


def op8_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours by cosine of every fiftieth vector."""
    return vp_trees.search(table(spark, sf_dir, "embeddings"))


def op9_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest integer inner products of every fiftieth vector."""
    return pivot_table.search(table(spark, sf_dir, "embeddings"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _tokens(docs).drop("ids", "decoded")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers align in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.compare(docs, *alignment.public_files(BYTE_MODEL, PIECE_MODEL))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece token counts and digests of every document, encoded and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = piece_bpe.public_model(PIECE_MODEL)
    return piece_bpe.decode(piece_bpe.encode(docs, path).drop("text"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        byte_bpe.digest(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op13_vp_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors."""
    return vp_centroids.cluster(table(spark, sf_dir, "embeddings"))


def _tokens(docs: DataFrame) -> DataFrame:
    path, pattern = byte_bpe.public_vocabulary(VOCABULARY)
    return _decoded(byte_bpe.encode(docs, path, pattern).drop("text"))


def _decoded(ids: DataFrame) -> DataFrame:
    path, pattern = byte_bpe.public_vocabulary(VOCABULARY)
    return byte_bpe.decode(ids, path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        byte_bpe.digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# --- stages of the pipeline: (spark, docs, sf_dir) to documents -------------------------------------------------


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels are learnt on these very documents."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that loses all of its text goes, one that never had any stays."""
    done = line_templates.dedup(docs)
    empty = F.length(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     "))) == 0
    kept = done.where((F.col("n_dropped") == 0) | ~empty)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    classes = ngram_trie.connect(docs)
    gone = classes.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    # a fixed kind of join that can spill, so that plans are alike at every size
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.apply(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents of the mix."""
    # ids are stored, so that no task needs a worker to encode and another to decode, with a vocabulary each
    path, pattern = byte_bpe.public_vocabulary(VOCABULARY)
    return _decoded(stage(byte_bpe.encode(docs.select("doc_id", "text"), path, pattern).drop("text"), "ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenise),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_templates, op2_ngram_trie_join, op3_url_terms, op4_html_blocks, op5_toxicity_mil,
        op6_chat_prefix, op7_source_mix, op8_vp_trees, op9_pivot_table, op10_byte_bpe,
        op11_token_alignment, op12_piece_bpe, op13_vp_centroids,
    )
}

SQL["op3_url_terms"] = op3(RULES)
SQL["op13_vp_centroids"] = vp_centroids.reference_sql()
