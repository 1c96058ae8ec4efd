"""Registered queries of the training-data operators, production parameters.

No DuckDB twin where SQL lacks the means (XXH64, regex positions, trained
models, iterative solvers): those queries are held against brute force in
``tests/llm``.
"""

from __future__ import annotations

from .audit import OP12_SQL, op12_audit
from .infill import OP11_SQL, op11_infill
from .language import op5_language
from .licenses import op4_licenses
from .lines import OP10_SQL, op10_lines
from .mixing import op1_mix
from .neighbours import OP8_SQL, op8_nearest
from .packing import op2_pack
from .quality import op6_quality
from .secrets import op7_secrets
from .sharding import op9_shards
from .simhash import op3_simhash
from .token_counts import op13_tokens

QUERIES = {
    "op1_mix": op1_mix,
    "op2_pack": op2_pack,
    "op3_simhash": op3_simhash,
    "op4_licenses": op4_licenses,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_secrets": op7_secrets,
    "op8_nearest": op8_nearest,
    "op9_shards": op9_shards,
    "op10_lines": op10_lines,
    "op11_infill": op11_infill,
    "op12_audit": op12_audit,
    "op13_tokens": op13_tokens,
}
SQL: dict[str, str] = {"op8_nearest": OP8_SQL, "op10_lines": OP10_SQL, "op11_infill": OP11_SQL,
                      "op12_audit": OP12_SQL}
