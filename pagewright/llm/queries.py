"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pagewright.llm import bwtdedup, decontam, filteraudit, hardneg, langid, mixing, sharding, simhash, syncmers, tokencount, tokenfiles, toxicity, urltrust

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_token_counts": tokencount.op2_token_counts,
    "op3_token_files": tokenfiles.op3_token_files,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_url_trust": urltrust.op5_url_trust,
    "op6_syncmers": syncmers.op6_syncmers,
    "op7_mixing": mixing.op7_mixing,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_repeats": bwtdedup.op9_repeats,
    "op10_simhash": simhash.op10_simhash,
    "op11_hard_negatives": hardneg.op11_hard_negatives,
    "op12_sharding": sharding.op12_sharding,
    "op13_filter_audit": filteraudit.op13_filter_audit,
}
ORACLE_SQL = {
    "op5_url_trust": urltrust.oracle(),
    "op8_decontaminate": decontam.ORACLE,
    "op11_hard_negatives": hardneg.ORACLE,
    "op13_filter_audit": filteraudit.ORACLE,
}
