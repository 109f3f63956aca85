"""The registered queries of this package and their SQL."""

from __future__ import annotations

from arcwright.llm.bpe import op10_bpe
from arcwright.llm.infill import OP11_SQL, op11_infill
from arcwright.llm.jaccard import OP5_SQL, op5_jaccard
from arcwright.llm.lattice import OP1_SQL, op1_lattice
from arcwright.llm.lines import OP3_SQL, op3_lines
from arcwright.llm.mixing import op9_mixing
from arcwright.llm.secrets import op7_secrets
from arcwright.llm.token_files import op8_token_files
from arcwright.llm.topk import OP6_SQL, op6_exact_topk
from arcwright.llm.toxicity import op4_toxicity
from arcwright.llm.url_rules import OP13_SQL, op13_url_rules
from arcwright.llm.vector_codes import OP12_SQL, op12_vector_codes
from arcwright.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op10_bpe": op10_bpe,
    "op1_lattice": op1_lattice,
    "op2_warc": op2_warc,
    "op3_lines": op3_lines,
    "op4_toxicity": op4_toxicity,
    "op7_secrets": op7_secrets,
    "op5_jaccard": op5_jaccard,
    "op6_exact_topk": op6_exact_topk,
    "op8_token_files": op8_token_files,
    "op9_mixing": op9_mixing,
    "op11_infill": op11_infill,
    "op12_vector_codes": op12_vector_codes,
    "op13_url_rules": op13_url_rules,
}

ORACLES = {
    "op11_infill": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_url_rules": OP13_SQL,
    "op2_warc": OP2_SQL, "op3_lines": OP3_SQL, "op5_jaccard": OP5_SQL, "op1_lattice": OP1_SQL, "op6_exact_topk": OP6_SQL,
}
