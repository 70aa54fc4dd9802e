"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from docquarry.llm import (
    bestfit, chat, fingerprints, lm, manifest, packing, pieces, private, quality, runs, secrets, sharding, similarity,
)

QUERIES = {
    "op1_pseudonyms": private.op1_pseudonyms,
    "op2_simhash": fingerprints.op2_simhash,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_feistel_shards": sharding.op4_feistel_shards,
    "op5_reply_trees": chat.op5_reply_trees,
    "op6_jaccard_join": similarity.op6_jaccard_join,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_first_fit_packing": packing.op9_first_fit_packing,
    "op10_kneser_ney": lm.op10_kneser_ney,
    "op11_best_fit_packing": bestfit.op11_best_fit_packing,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_periodic_runs": runs.op13_periodic_runs,
}
ORACLE = {
    "op5_reply_trees": chat.ORACLE, "op6_jaccard_join": similarity.ORACLE, "op8_quality_rules": quality.ORACLE,
    "op12_merkle_manifest": manifest.ORACLE,
}
