"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from provgraph.llm.op10_spans import op10_sentence_spans
from provgraph.llm.op11_merkle import op11_merkle_manifest
from provgraph.llm.op12_simhash import op12_simhash_dedup
from provgraph.llm.op13_runs import op13_periodic_runs
from provgraph.llm.op1_classifier import op1_quality_classifier
from provgraph.llm.op2_sharding import op2_sharding, oracle as oracle2
from provgraph.llm.op3_pii import op3_pii
from provgraph.llm.op4_rules import op4_quality_rules
from provgraph.llm.op5_jaccard import op5_jaccard_join
from provgraph.llm.op6_packing import op6_packing
from provgraph.llm.op7_links import op7_url_filters, oracle as oracle7
from provgraph.llm.op8_tokens import op8_token_counts
from provgraph.llm.op9_decontaminate import op9_decontamination

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_sharding": op2_sharding,
    "op3_pii": op3_pii,
    "op4_quality_rules": op4_quality_rules,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_packing": op6_packing,
    "op7_url_filters": op7_url_filters,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_sentence_spans": op10_sentence_spans,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Queries without an entry are tested against brute force in tests/llm.
ORACLE_SQL = {
    "op2_sharding": oracle2,
    "op7_url_filters": oracle7,
}
