"""Queries of the operators and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from .chat import op10_chat_format
from .embed import op4_embedding_dedup
from .hmm import op7_hmm_score
from .langid import op2_language_id
from .minhash import op6_minhash_dedup
from .mixing import op8_mixing
from .packing import op5_packing
from .quality import op1_quality_rules
from .secrets import op9_secret_scan
from .sharding import op3_kd_sharding

QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_language_id, op3_kd_sharding, op4_embedding_dedup, op5_packing, op6_minhash_dedup, op7_hmm_score, op8_mixing, op9_secret_scan, op10_chat_format)
}
SQL: dict[str, str] = {}
