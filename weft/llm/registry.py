"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from weft.llm.bpe import op3_bpe
from weft.llm.chat import OP8_SQL, op8_chat
from weft.llm.decontamination import OP2_SQL, op2_decontamination
from weft.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from weft.llm.jaccard_join import OP1_SQL, op1_jaccard_join
from weft.llm.language import op5_language
from weft.llm.licenses import OP7_SQL, op7_license_scan
from weft.llm.pii import op4_pii
from weft.llm.secrets import op10_secret_scan
from weft.llm.token_files import op9_token_files

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_decontamination": op2_decontamination,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_language": op5_language,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_chat": op8_chat,
    "op9_token_files": op9_token_files,
    "op10_secret_scan": op10_secret_scan,
}

ORACLES = {
    "op1_jaccard_join": OP1_SQL,
    "op2_decontamination": OP2_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_license_scan": OP7_SQL,
    "op8_chat": OP8_SQL,
}
