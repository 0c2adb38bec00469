"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .embedding_dedup import op10_embedding_dedup
from .fingerprint import op5_fingerprint
from .language_id import op3_language_id
from .license_scan import op1_license_scan
from .mixing import op6_mixing
from .ngram_join import op2_ngram_join
from .oracles import ORACLES
from .packing import op8_packing
from .quality import op7_quality
from .toxicity import op4_toxicity
from .url_filter import op9_url_filter

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_ngram_join": op2_ngram_join,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_fingerprint": op5_fingerprint,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_url_filter": op9_url_filter,
    "op10_embedding_dedup": op10_embedding_dedup,
}

