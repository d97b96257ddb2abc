"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chatformat, decontaminate, jaccard, language, linededup, mixing, periodic, quality, sharding, suffix, tokencount, turntrie, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_mixing": mixing.op2_mixing,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_warc": warc.op4_warc,
    "op5_language": language.op5_language,
    "op6_linededup": linededup.op6_linededup,
    "op7_sharding": sharding.op7_sharding,
    "op8_suffix": suffix.op8_suffix,
    "op9_chat": chatformat.op9_chat,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_periodic": periodic.op11_periodic,
    "op12_tokencount": tokencount.op12_tokencount,
    "op13_trie": turntrie.op13_trie,
}

ORACLES = {
    "op1_quality": quality.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op4_warc": warc.ORACLE,
    "op6_linededup": linededup.ORACLE,
    "op9_chat": chatformat.ORACLE,
    "op10_jaccard": jaccard.ORACLE,
    "op13_trie": turntrie.ORACLE,
}
