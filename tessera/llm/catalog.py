"""Queries of the numbered operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from tessera.llm.decontamination import OP1_SQL, op1_benchmark_decontamination
from tessera.llm.edit_counts import op10_edit_token_counts
from tessera.llm.fixity import OP4_SQL, op4_merkle_fixity
from tessera.llm.fm_dedup import OP12_SQL, op12_fm_index_dedup
from tessera.llm.language_id import op6_language_id
from tessera.llm.lloyd import OP13_SQL, op13_lloyd_clusters
from tessera.llm.neardup import OP2_SQL, op2_minhash_neardup
from tessera.llm.packing import op3_sequence_packing
from tessera.llm.quality import op9_quality_classifier
from tessera.llm.secrets import op5_secret_scan
from tessera.llm.spelling import OP11_SQL, op11_spelling_variants
from tessera.llm.suffix_dedup import OP8_SQL, op8_suffix_dedup
from tessera.llm.topk import OP7_SQL, op7_topk_search

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_minhash_neardup": op2_minhash_neardup,
    "op3_sequence_packing": op3_sequence_packing,
    "op4_merkle_fixity": op4_merkle_fixity,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_topk_search": op7_topk_search,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_edit_token_counts": op10_edit_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fm_index_dedup": op12_fm_index_dedup,
    "op13_lloyd_clusters": op13_lloyd_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_decontamination": OP1_SQL,
    "op2_minhash_neardup": OP2_SQL,
    "op4_merkle_fixity": OP4_SQL,
    "op7_topk_search": OP7_SQL,
    "op8_suffix_dedup": OP8_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_fm_index_dedup": OP12_SQL,
    "op13_lloyd_clusters": OP13_SQL,
}
