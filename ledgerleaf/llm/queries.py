"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bayes_minhash, best_fit, block_naming, chat_format, collocations, filter_audit, label_shards, multi_index, quality_fm, source_mixing, suffix_dedup, toxic_chain, warc_derivatives

QUERIES = {
    "op1_quality_fm": quality_fm.op1_quality_fm,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_bayes_minhash": bayes_minhash.op4_bayes_minhash,
    "op5_best_fit": best_fit.op5_best_fit,
    "op6_toxic_chain": toxic_chain.op6_toxic_chain,
    "op7_multi_index": multi_index.op7_multi_index,
    "op8_warc_derivatives": warc_derivatives.op8_warc_derivatives,
    "op9_source_mixing": source_mixing.op9_source_mixing,
    "op10_block_naming": block_naming.op10_block_naming,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_collocations": collocations.op12_collocations,
    "op13_label_shards": label_shards.op13_label_shards,
}
ORACLES = {
    "op2_chat_format": chat_format.ORACLE,
    "op4_bayes_minhash": bayes_minhash.ORACLE,
    "op10_block_naming": block_naming.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
