"""The queries of this subpackage, each over its whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import oracles
from .bpe import op6_byte_bpe
from .collocations import op13_collocations
from .decontaminate import op3_decontaminate
from .divergence import op11_source_divergence
from .licenses import op9_license_scan
from .mixture import op12_mixture
from .near_dup import op4_near_dup
from .pii import op1_pii
from .quality_model import op7_quality_gam
from .quality_rules import op10_quality_rules
from .secrets import op2_secret_scan
from .sharding import op8_sharding
from .toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_pii, op2_secret_scan, op3_decontaminate, op4_near_dup, op5_toxicity, op6_byte_bpe, op7_quality_gam, op8_sharding, op9_license_scan, op10_quality_rules, op11_source_divergence, op12_mixture, op13_collocations)}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
