"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, fingerprint, html_extract, langid, lm_score, neardup, oracles, packing, periodic_runs, pii, source_mix, spelling, url_filter
from . import shared as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose fold isn't 2."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(S.crc_fold("doc_id", 4) != 2))
    held = docs.select("doc_id", "text", (S.crc_fold("doc_id", 4) == 2).alias("held_out"))
    return langid.predict(held, model, keep=["doc_id", "held_out"])


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness."""
    return fingerprint.compared_with_next(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that lie within benchmark windows."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.report(docs, bench, keep=["doc_id"]).drop("matches")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), packing.default_tokenizer())


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, over shingles of four words."""
    return neardup.classes(table(spark, sf_dir, "documents"), size=4)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL; the trees learn from URLs labelled by seed words in their hosts."""
    pages = table(spark, sf_dir, "pages")
    host, _ = url_filter.split(F.col("url"))
    labelled = pages.select("url", url_filter.seed_label(host).alias("label"))
    found = url_filter.judge(pages.select("page_id", "url"), url_filter.train(labelled))
    return found.select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_extract.main_text(pages, html_extract.train(pages), keep=["page_id", "url"])


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation expanded into an example for each reply, with all before it as context, and read back from these; and one whose texts hold the template's control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat_format.expanded_digests(chat_format.prefix_targets(turns.unionByName(probe)))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, learned from those whose fold isn't 2."""
    return lm_score.score(table(spark, sf_dir, "documents"), S.crc_fold("doc_id", 7) != 2)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document's words, one in ten documents with a planted run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digests(periodic_runs.find(periodic_runs.with_planted_runs(docs), keep=["doc_id"]), ["doc_id"])


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all documents, as large as they are, takes of each."""
    return source_mix.taken(source_mix.prepare(table(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frequent words of the documents, their near words and the form that each is a variant of."""
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (op1_url_filter, op2_html_extraction, op3_document_fingerprints, op4_lm_scoring, op5_chat_formatting, op6_decontamination, op7_packing, op8_personal_data, op9_language_id, op10_near_duplicates, op11_periodic_runs, op12_source_mix, op13_spelling_variants)
}
ORACLE_SQL = oracles.ORACLE_SQL
