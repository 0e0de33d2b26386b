"""The subpackage's registered queries and the SQL that checks them, where SQL can express one."""

from __future__ import annotations

from tessera.llm.decontaminate import OP5_SQL, op5_decontaminate
from tessera.llm.extract import op6_extract
from tessera.llm.mixing import OP2_SQL, op2_mix_sources
from tessera.llm.near_dedup import OP9_SQL, op9_near_dedup
from tessera.llm.ngram import op4_lm_scores
from tessera.llm.pii import op3_pii
from tessera.llm.quality import OP8_SQL, op8_quality
from tessera.llm.secrets import op7_secret_scan
from tessera.llm.toxicity import op1_toxicity
from tessera.llm.url_filter import OP10_SQL, op10_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mix_sources": op2_mix_sources,
    "op3_pii": op3_pii,
    "op4_lm_scores": op4_lm_scores,
    "op5_decontaminate": op5_decontaminate,
    "op6_extract": op6_extract,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality": op8_quality,
    "op9_near_dedup": op9_near_dedup,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL = {
    "op2_mix_sources": OP2_SQL,
    "op5_decontaminate": OP5_SQL,
    "op8_quality": OP8_SQL,
    "op9_near_dedup": OP9_SQL,
    "op10_url_filter": OP10_SQL,
}
