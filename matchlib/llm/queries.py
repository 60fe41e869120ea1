"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe_tree, decontamination, embedding_dedup, html_text, jaccard, language, packing, periodic_runs, prefix_trie, quality, secret_scan, token_files, warc

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_warc": warc.op2_warc,
    "op3_html_text": html_text.op3_html_text,
    "op4_language_id": language.op4_language_id,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_byte_bpe": bpe_tree.op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "op8_jaccard_join": jaccard.OP8_SQL,
    "op9_secret_scan": secret_scan.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
}
