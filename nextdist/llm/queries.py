"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bond, chat, html, lattice, linededup, merkle, mixing, packing, quality, shards, simhash, toxicity, urlfilter
from .common import file_rows, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_simhash_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_packing(table(spark, sf_dir, "documents"))


def op10_line_dedup_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(file_rows(table(spark, sf_dir, "documents").select("doc_id", "text")), row="_row")


def op3_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filter(table(spark, sf_dir, "pages"), keep=["page_id"])


def op9_embedding_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.embedding_links(table(spark, sf_dir, "embeddings"))


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op5_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.quotation_links(table(spark, sf_dir, "conversations"), keep=["conv_id", "turn", "role"])


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.training_order(table(spark, sf_dir, "documents"), with_ids=False)


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(table(spark, sf_dir, "documents"))


def op11_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bond.hard_negatives(bond.shifted(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op12_toxicity_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


QUERIES = {
    "op12_toxicity_levenshtein": op12_toxicity_levenshtein,
    "op11_bond_negatives": op11_bond_negatives,
    "op13_merkle_windows": op13_merkle_windows,
    "op4_soft_mixing": op4_soft_mixing,
    "op2_html_blocks": op2_html_blocks,
    "op5_quotation_links": op5_quotation_links,
    "op8_training_order": op8_training_order,
    "op3_url_link_graph": op3_url_link_graph,
    "op9_embedding_lattice": op9_embedding_lattice,
    "op1_quality_rules": op1_quality_rules,
    "op6_simhash_vp_tree": op6_simhash_vp_tree,
    "op10_line_dedup_suffix_array": op10_line_dedup_suffix_array,
    "op7_harmonic_packing": op7_harmonic_packing,
}
ORACLES = {"op1_quality_rules": quality.ORACLE_SQL, "op10_line_dedup_suffix_array": linededup.ORACLE_SQL, "op2_html_blocks": html.ORACLE_SQL, "op5_quotation_links": chat.ORACLE_SQL, "op3_url_link_graph": urlfilter.ORACLE_SQL, "op9_embedding_lattice": lattice.ORACLE_SQL, "op13_merkle_windows": merkle.ORACLE_SQL, "op11_bond_negatives": bond.ORACLE_SQL}
