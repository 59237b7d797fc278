"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import bpe_trie, decontaminate, divergence, hmm, imatch, kneser_ney, licenses, periodic_runs, quality_rules, sharding, simhash, token_store, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_licenses": licenses.op2_licenses,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_warc": warc.op4_warc,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_simhash": simhash.op6_simhash,
    "op7_bpe_trie": bpe_trie.op7_bpe_trie,
    "op8_hmm": hmm.op8_hmm,
    "op9_token_store": token_store.op9_token_store,
    "op10_kneser_ney": kneser_ney.op10_kneser_ney,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_divergence": divergence.op12_divergence,
    "op13_imatch": imatch.op13_imatch,
}

ORACLE_SQL = {
    "op1_sharding": sharding.OP1_SQL,
    "op2_licenses": licenses.OP2_SQL,
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op12_divergence": divergence.OP12_SQL,
    "op13_imatch": imatch.OP13_SQL,
}
