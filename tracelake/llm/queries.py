"""The opN_ queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from .decontaminate import OP1_SQL, op1_decontaminate
from .langid import op9_langid
from .lmscore import op10_lmscore
from .mixing import OP6_SQL, op6_mixing
from .pii import op2_pii
from .simhash import op7_simhash
from .suffixdedup import op5_suffixdedup
from .toxicity import op8_toxicity
from .urlfilter import OP4_SQL, op4_urlfilter
from .vectors import OP3_SQL, op3_vectors

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii": op2_pii,
    "op3_vectors": op3_vectors,
    "op4_urlfilter": op4_urlfilter,
    "op5_suffixdedup": op5_suffixdedup,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_langid": op9_langid,
    "op10_lmscore": op10_lmscore,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op3_vectors": OP3_SQL,
    "op4_urlfilter": OP4_SQL,
    "op6_mixing": OP6_SQL,
}
