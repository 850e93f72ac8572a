"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from . import oracles
from .divergence_audit import op13_source_divergence_audit
from .fm_dedup import op10_fm_substring_dedup
from .hamming_dedup import op5_hamming_near_dedup
from .importance_resampling import op11_radix_importance_resampling
from .language_profiles import op6_hyperdimensional_language
from .media_ts import op1_media_transport_stream
from .pattern_packing import op3_pattern_packing
from .piece_codec import op7_piece_encode_decode
from .polytope_dedup import op9_polytope_near_dedup
from .secret_scan import op4_secret_scan
from .token_counts import op8_transducer_token_counts
from .toxicity_cnn import op2_toxicity_cnn
from .warc import op12_splittable_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_media_transport_stream,
        op2_toxicity_cnn,
        op3_pattern_packing,
        op4_secret_scan,
        op5_hamming_near_dedup,
        op6_hyperdimensional_language,
        op7_piece_encode_decode,
        op8_transducer_token_counts,
        op9_polytope_near_dedup,
        op10_fm_substring_dedup,
        op11_radix_importance_resampling,
        op12_splittable_warc,
        op13_source_divergence_audit,
    )
}
ORACLE: dict[str, str] = dict(oracles.ORACLE)
