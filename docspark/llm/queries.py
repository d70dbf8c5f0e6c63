"""The registered queries of this subpackage, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from docspark.llm import bpe, chat, lines, mixing, pii, quality, repeats, simhash, topk, toxicity
from docspark.llm.common import spread, table


def op1_topk_segments(spark, sf_dir):
    return topk.search_report(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark, sf_dir):
    return bpe.token_report(spread(table(spark, sf_dir, "documents")))


def op3_chat_format(spark, sf_dir):
    return chat.chat_report(table(spark, sf_dir, "conversations"))


def op4_simhash(spark, sf_dir):
    return simhash.simhash_report(spread(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark, sf_dir):
    return quality.quality_report(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op6_pii_feistel(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return lines.line_report(table(spark, sf_dir, "documents"))


def op8_toxic_segments(spark, sf_dir):
    return toxicity.toxicity_report(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op9_mix_sources(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_repeat_bwt(spark, sf_dir):
    return repeats.repeat_report(spread(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (op1_topk_segments, op2_bpe, op3_chat_format, op4_simhash, op5_quality_rules, op6_pii_feistel, op7_line_dedup, op8_toxic_segments, op9_mix_sources, op10_repeat_bwt)
}
ORACLES = {"op1_topk_segments": topk.ORACLE, "op3_chat_format": chat.ORACLE, "op7_line_dedup": lines.ORACLE, "op9_mix_sources": mixing.ORACLE}
