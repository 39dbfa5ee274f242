"""One registered query per operator: ``opN_<name>`` over its whole table,
with production parameters."""

from __future__ import annotations

from . import (ann, decontaminate, hardneg, htmltext, langid, merkle, neardup, packing, pii, quality, tokencount,
               toxicity, vecdedup)
from .common import table

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


@query("op1_pii")
def op1_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query("op2_quality")
def op2_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_nearest")
def op3_nearest(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


@query("op5_decontaminate", decontaminate.ORACLE)
def op5_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_language_id")
def op7_language_id(spark, sf_dir):
    return langid.detect(table(spark, sf_dir, "documents"))


@query("op8_near_duplicates")
def op8_near_duplicates(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "documents"))


@query("op9_packing")
def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op10_html_text")
def op10_html_text(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query("op11_hard_negatives", hardneg.ORACLE)
def op11_hard_negatives(spark, sf_dir):
    return hardneg.mine(table(spark, sf_dir, "embeddings"))


@query("op12_merkle_manifest", merkle.ORACLE)
def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query("op13_vector_duplicates", vecdedup.ORACLE)
def op13_vector_duplicates(spark, sf_dir):
    return vecdedup.near_duplicates(table(spark, sf_dir, "embeddings"))
