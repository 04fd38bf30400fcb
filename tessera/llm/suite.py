"""The registered queries of the training-data operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import chat, crosstoken, decontam, fixity, lineruns, milquality, mixing, orderhash, repeats, subspaces, tokenfiles, trielm, whitening

QUERIES = {
    "op1_merkle_fixity": (fixity.op1, fixity.OP1_SQL),
    "op2_trie_lm": (trielm.op2, None),
    "op3_mil_quality": (milquality.op3, None),
    "op4_chat_round_trip": (chat.op4, chat.OP4_SQL),
    "op5_token_arrow": (tokenfiles.op5, None),
    "op6_temperature_mix": (mixing.op6, mixing.OP6_SQL),
    "op7_suffix_decontam": (decontam.op7, decontam.OP7_SQL),
    "op8_order_minhash": (orderhash.op8, None),
    "op9_line_runs": (lineruns.op9, lineruns.OP9_SQL),
    "op10_repeat_rules": (repeats.op10, repeats.OP10_SQL),
    "op11_cross_tokens": (crosstoken.op11, None),
    "op12_embedding_whitening": (whitening.op12, None),
    "op13_subspace_join": (subspaces.op13, subspaces.OP13_SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
