"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from engramma.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from engramma.llm.language_id import op7_language_id
from engramma.llm.licenses import OP9_SQL, op9_license_lines, op9_licenses
from engramma.llm.mixing import OP3_SQL, op3_mixing
from engramma.llm.near_dedup import op10_near_dedup
from engramma.llm.packing import op6_packing
from engramma.llm.quality import op8_quality
from engramma.llm.secrets import op5_secrets
from engramma.llm.sharding import op2_sharding
from engramma.llm.winnowing import op4_fingerprints

QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_sharding, op3_mixing, op4_fingerprints, op5_secrets, op6_packing, op7_language_id, op8_quality, op9_licenses, op9_license_lines, op10_near_dedup)
}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op3_mixing": OP3_SQL, "op9_license_lines": OP9_SQL}
