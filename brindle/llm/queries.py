"""The queries of this subpackage, and the SQL of those that SQL can express."""

from .align import op13_align_tokens
from .audit import OP11_SQL, op11_filter_audit
from .decontaminate import op6_decontaminate
from .lines import OP8_SQL, op8_line_dedup
from .mixing import OP9_SQL, op9_mix_sources
from .pii import op1_find_pii
from .quality import OP7_SQL, op7_quality_rules
from .sharding import op10_balanced_shards
from .simhash import op3_simhash_near_dedup
from .tokens import op4_token_id_shards
from .toxicity import op2_toxicity
from .vectors import OP12_SQL, op12_near_vectors
from .warc import OP5_SQL, op5_warc_round_trip

QUERIES = {
    "op1_find_pii": op1_find_pii,
    "op2_toxicity": op2_toxicity,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_token_id_shards": op4_token_id_shards,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_balanced_shards": op10_balanced_shards,
    "op11_filter_audit": op11_filter_audit,
    "op12_near_vectors": op12_near_vectors,
    "op13_align_tokens": op13_align_tokens,
}

ORACLE_SQL = {
    "op5_warc_round_trip": OP5_SQL,
    "op7_quality_rules": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_mix_sources": OP9_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_near_vectors": OP12_SQL,
}
