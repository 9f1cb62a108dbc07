"""Queries and oracle SQL of the operators in this subpackage."""

from . import chat, langid, mixing, packing, sharding, simhash, suffix_dedup, topk_search, url_filter, weighted_sampling

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_document_fingerprints": weighted_sampling.op2_document_fingerprints,
    "op3_language_id": langid.op3_language_id,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_topk_search": topk_search.op6_topk_search,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_sharding": sharding.op8_sharding,
    "op9_packing": packing.op9_packing,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
}
ORACLES = {
    "op1_chat_formatting": chat.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op6_topk_search": topk_search.ORACLE_SQL,
    "op7_source_mixing": mixing.ORACLE_SQL,
    "op8_sharding": sharding.ORACLE_SQL,
}
