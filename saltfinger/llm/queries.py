"""The training-data queries: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from .decontaminate import op2_query
from .fingerprint import op4_query
from .importance import OP11_SQL, op11_query
from .jaccard_join import op5_query
from .language_id import op9_query
from .licenses import OP1_SQL, op1_query
from .main_text import op3_query
from .mixing import op7_query
from .phrases import OP13_SQL, op13_query
from .preferences import OP6_SQL, op6_query
from .suffix_dedup import op10_query
from .token_files import op12_query
from .warc import op8_query

QUERIES = {
    "op1_license_scan": op1_query,
    "op2_spaced_seed_decontamination": op2_query,
    "op3_dom_model_main_text": op3_query,
    "op4_canonical_fingerprint": op4_query,
    "op5_ngram_jaccard_join": op5_query,
    "op6_preference_format": op6_query,
    "op7_source_mixing": op7_query,
    "op8_warc_segments": op8_query,
    "op9_kneser_ney_language": op9_query,
    "op10_suffix_dedup": op10_query,
    "op11_importance_resampling": op11_query,
    "op12_arrow_token_files": op12_query,
    "op13_phrase_mining": op13_query,
}

ORACLES = {
    "op1_license_scan": OP1_SQL,
    "op6_preference_format": OP6_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op13_phrase_mining": OP13_SQL,
}
