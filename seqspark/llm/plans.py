"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from seqspark.llm import chat, decontam, htmltext, langid, lexical, packing, pii, sharding, simhash, sketches, toxicity, treejoin, trie

QUERIES = {f.__name__: f for f in (
    sharding.op1_byte_shards,
    langid.op2_language_mixture,
    packing.op3_best_two_fit,
    simhash.op4_simhash_anchors,
    htmltext.op5_boosted_dom,
    pii.op6_skip_chain,
    sketches.op7_paragraph_sketches,
    decontam.op8_containment_search,
    toxicity.op9_subword_toxicity,
    chat.op10_quotation_linking,
    lexical.op11_reversed_search,
    treejoin.op12_prefix_tree_join,
    trie.op13_truncation_peeling,
)}

ORACLES: dict[str, str] = {
    "op8_containment_search": decontam.SQL,
    "op10_quotation_linking": chat.SQL,
    "op11_reversed_search": lexical.SQL,
    "op12_prefix_tree_join": treejoin.SQL,
    "op13_truncation_peeling": trie.SQL,
}
