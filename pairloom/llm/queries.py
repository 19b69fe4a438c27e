"""The registered queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from . import bottom_k, filter_audit, graph_index, mixing, quality_rules, secret_scan, sentencepiece_fst, simhash, token_counts, token_store, toxicity, turn_repair, warc
from .common import table


def op1_token_store(spark, sf_dir):
    return token_store.stored_documents(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark, sf_dir):
    return secret_scan.digest_rows(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op4_nearest_neighbours(spark, sf_dir):
    return graph_index.nearest(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("broken_rules")


def op7_toxicity(spark, sf_dir):
    return toxicity.held_out_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark, sf_dir):
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark, sf_dir):
    return sentencepiece_fst.encode_documents(table(spark, sf_dir, "documents")).drop("ids")


def op11_bottom_k(spark, sf_dir):
    return bottom_k.near_duplicates(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_turn_repair(spark, sf_dir):
    return turn_repair.repaired(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_secret_scan, op3_warc, op4_nearest_neighbours, op5_token_counts, op6_quality_rules, op7_toxicity, op8_mixing, op9_simhash, op10_sentencepiece, op11_bottom_k, op12_filter_audit, op13_turn_repair)}
ORACLE_SQL = {"op4_nearest_neighbours": graph_index.ORACLE_SQL, "op3_warc": warc.ORACLE_SQL, "op6_quality_rules": quality_rules.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL, "op11_bottom_k": bottom_k.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL, "op13_turn_repair": turn_repair.ORACLE_SQL}
