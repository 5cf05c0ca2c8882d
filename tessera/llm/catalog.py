"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from tessera.llm import clustering, exact_dedup, html_text, langid, manifest, near_dup, packing, pieces, pii, repeats, search, sharding, tokens

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_html_text": html_text.op2_html_text,
    "op3_near_dup": near_dup.op3_near_dup,
    "op4_packing": packing.op4_packing,
    "op5_pii": pii.op5_pii,
    "op6_bm25_search": search.op6_bm25_search,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_pieces": pieces.op9_pieces,
    "op10_sharding": sharding.op10_sharding,
    "op11_repeats": repeats.op11_repeats,
    "op12_manifest": manifest.op12_manifest,
    "op13_centroids": clustering.op13_centroids,
}
ORACLE_SQL = {
    "op8_exact_dedup": exact_dedup.SQL,
    "op12_manifest": manifest.SQL,
    "op13_centroids": clustering.SQL,
}
