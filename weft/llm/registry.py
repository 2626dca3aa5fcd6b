"""Queries of this subpackage, by name, with SQL where SQL can express them."""

from __future__ import annotations

from weft.llm import chat, clusters, divergence, mixing, packing, quality, sharding, simhash, token_files, toxicity, urls, vectors, warc


def queries() -> dict:
    return {
        "op1_entropy_mix": mixing.op1_entropy_mix,
        "op2_host_reputation": urls.op2_host_reputation,
        "op3_histogram_shard": sharding.op3_histogram_shard,
        "op4_slack_pack": packing.op4_slack_pack,
        "op5_simhash_mih": simhash.op5_simhash_mih,
        "op6_repetition_rules": quality.op6_repetition_rules,
        "op7_quotation_links": chat.op7_quotation_links,
        "op8_patched_blocks": token_files.op8_patched_blocks,
        "op9_metric_range_join": vectors.op9_metric_range_join,
        "op10_kneser_ney_toxicity": toxicity.op10_kneser_ney_toxicity,
        "op11_salvage_warc": warc.op11_salvage_warc,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_annulus_clusters": clusters.op13_annulus_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_host_reputation": urls.ORACLE, "op11_salvage_warc": warc.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_annulus_clusters": clusters.ORACLE}
