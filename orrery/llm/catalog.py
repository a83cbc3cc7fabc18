"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from . import bagminhash, bpe, compaction, decontam, divergence, html, langid, mixing, prefix_trie, quality, toxicity, urlfilter, warc

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_html_extraction": html.op3_html_extraction,
    "op4_warc_revisits": warc.op4_warc_revisits,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_compaction": compaction.op6_compaction,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_near_duplicates": bagminhash.op9_near_duplicates,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_source_mix": mixing.op13_source_mix,
}
SQL = {
    "op4_warc_revisits": warc.OP4_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op6_compaction": compaction.OP6_SQL,
    "op7_url_filter": urlfilter.OP7_SQL,
    "op8_decontamination": decontam.OP8_SQL,
    "op9_near_duplicates": bagminhash.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_source_mix": mixing.OP13_SQL,
}
