"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .audio import op4_audio
from .bpe import op9_bpe
from .chat import OP7_SQL, op7_chat
from .hpylm import op3_lm
from .langid import op10_langid
from .packing import op5_packing
from .quality import op6_quality
from .simhash import op1_simhash
from .substring import op8_substring
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_lm": op3_lm,
    "op4_audio": op4_audio,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_chat": op7_chat,
    "op8_substring": op8_substring,
    "op9_bpe": op9_bpe,
    "op10_langid": op10_langid,
}

SQL: dict[str, str] = {"op2_warc": OP2_SQL, "op7_chat": OP7_SQL}
