"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from weftline.llm.decontamination import OP7_SQL, op7_decontamination
from weftline.llm.embedding_dedup import OP5_SQL, op5_embedding_dedup
from weftline.llm.html_text import op10_html_text
from weftline.llm.minhash import OP8_SQL, op8_minhash_dedup
from weftline.llm.mixing import op9_mixing
from weftline.llm.periodic_runs import OP12_SQL, op12_periodic_runs
from weftline.llm.quality import op2_quality
from weftline.llm.quality_rules import OP13_SQL, op13_quality_rules
from weftline.llm.secrets import op3_secrets
from weftline.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from weftline.llm.token_counts import op6_token_counts
from weftline.llm.token_files import op4_token_files
from weftline.llm.whitening import op11_whitening

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_token_files": op4_token_files,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_mixing": op9_mixing,
    "op10_html_text": op10_html_text,
    "op11_whitening": op11_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}
SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op5_embedding_dedup": OP5_SQL,
    "op7_decontamination": OP7_SQL,
    "op8_minhash_dedup": OP8_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_quality_rules": OP13_SQL,
}
