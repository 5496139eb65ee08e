"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .alignment import op12_token_alignment
from .forest import op2_prefix_forest
from .html import op7_tag_path_text
from .langid import op4_language_codes
from .multiset import op5_multiset_fingerprints
from .packing import op6_best_fit_packing
from .phrases import ORACLE_OP13, op13_phrase_collocations
from .quality import op8_quality_trees
from .recompression import ORACLE_OP9, op9_recompression_dedup
from .sentencepieces import op10_piece_lattice
from .simhash import op3_simhash_near_dedup
from .transducer import op11_bpe_transducer
from .warc import ORACLE_OP1, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_prefix_forest": op2_prefix_forest,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_language_codes": op4_language_codes,
    "op5_multiset_fingerprints": op5_multiset_fingerprints,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_tag_path_text": op7_tag_path_text,
    "op8_quality_trees": op8_quality_trees,
    "op9_recompression_dedup": op9_recompression_dedup,
    "op10_piece_lattice": op10_piece_lattice,
    "op11_bpe_transducer": op11_bpe_transducer,
    "op12_token_alignment": op12_token_alignment,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLES: dict[str, str] = {
    "op1_warc": ORACLE_OP1,
    "op9_recompression_dedup": ORACLE_OP9,
    "op13_phrase_collocations": ORACLE_OP13,
}
