"""Queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

from .chat_query import OP7_SQL, op7_chat
from .decontamination_query import OP5_SQL, op5_decontamination
from .jaccard_query import op10_jaccard_join
from .language_query import op2_language
from .media_query import MEDIA_PAYLOADS_SQL, media_payloads, op6_media
from .packing_query import op9_packing
from .pii_query import PII_COUNTS_SQL, op8_pii, pii_counts
from .quality_query import op1_quality
from .toxicity_query import op3_toxicity
from .warc_query import OP4_SQL, op4_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_media": op6_media,
    "op7_chat": op7_chat,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_jaccard_join": op10_jaccard_join,
    "media_payloads": media_payloads,
    "pii_counts": pii_counts,
}
ORACLES = {"op4_warc": OP4_SQL, "op5_decontamination": OP5_SQL, "op7_chat": OP7_SQL, "media_payloads": MEDIA_PAYLOADS_SQL, "pii_counts": PII_COUNTS_SQL}
