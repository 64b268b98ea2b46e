"""The subpackage's queries by name, and the SQL that states their rows where SQL can."""

from __future__ import annotations

from metaloom.llm import stated
from metaloom.llm.ann import op5_nearest
from metaloom.llm.audit import op11_filter_audit
from metaloom.llm.bpe import op4_bpe
from metaloom.llm.decontam import op13_decontaminate
from metaloom.llm.fingerprint import op9_fingerprint
from metaloom.llm.langid import op1_language_id
from metaloom.llm.mixing import op8_mix
from metaloom.llm.neardup import op3_near_duplicates
from metaloom.llm.periods import op12_periodic_runs
from metaloom.llm.pii import op7_pii
from metaloom.llm.quality import op6_quality
from metaloom.llm.sharding import op10_shard
from metaloom.llm.urlfilter import op2_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": op2_url_filter,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_bpe": op4_bpe,
    "op5_nearest": op5_nearest,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_mix": op8_mix,
    "op9_fingerprint": op9_fingerprint,
    "op10_shard": op10_shard,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_decontaminate": op13_decontaminate,
}
QUERIES |= stated.QUERIES
ORACLES: dict[str, str] = dict(stated.ORACLES)
