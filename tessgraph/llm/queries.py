"""The queries of this subpackage: opN_<name>(spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, embeddings, html_text, jaccard, lm_scoring, packing, quality_classifier, quality_rules, secrets, token_counts
from .common import table


def op1_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    return quality_classifier.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark, sf_dir):
    return token_counts.counts(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark, sf_dir):
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark, sf_dir):
    return html_text.pages_text(table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark, sf_dir):
    return embeddings.near(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_secret_scan, op3_packing, op4_quality_classifier, op5_quality_rules, op6_token_counts, op7_lm_scoring, op8_html_extraction, op9_jaccard_join, op10_embedding_near_dedup)}
ORACLE_SQL: dict[str, str] = {}
