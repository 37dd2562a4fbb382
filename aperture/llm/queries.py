"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from aperture.llm.audit import OP11_SQL, op11_filter_interaction_audit
from aperture.llm.chat import OP10_SQL, op10_chat_formatting
from aperture.llm.classifier import op6_quality_classifier
from aperture.llm.hnsw import op5_embedding_near_dedup
from aperture.llm.lm import op3_lm_scoring
from aperture.llm.minhash import op9_minhash_near_dedup
from aperture.llm.mixing import OP7_SQL, op7_mixing
from aperture.llm.packing import op2_packing
from aperture.llm.quality import op4_quality_rules
from aperture.llm.repeats import op13_periodic_runs
from aperture.llm.suffix import op1_suffix_array_dedup
from aperture.llm.urlrules import OP12_SQL, op12_url_filters
from aperture.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    f.__name__: f
    for f in (op1_suffix_array_dedup, op2_packing, op3_lm_scoring, op4_quality_rules, op5_embedding_near_dedup, op6_quality_classifier, op7_mixing, op8_warc, op9_minhash_near_dedup, op10_chat_formatting, op11_filter_interaction_audit, op12_url_filters, op13_periodic_runs)
}

ORACLE_SQL = {"op7_mixing": OP7_SQL, "op8_warc": OP8_SQL, "op10_chat_formatting": OP10_SQL, "op11_filter_interaction_audit": OP11_SQL, "op12_url_filters": OP12_SQL}
