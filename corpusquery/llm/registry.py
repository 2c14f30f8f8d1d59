"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import backtracking_bpe, cross_entropy, decontaminate, fingerprint, language, license_scan, ngram_join, quotes, sampled_pieces, spelling, token_file, toxicity, whitening

QUERIES = {
    "op1_quotation_linking": quotes.query,
    "op2_cross_entropy_difference": cross_entropy.query,
    "op3_token_file": token_file.query,
    "op4_canonical_digest": fingerprint.query,
    "op5_toxicity_nnpu": toxicity.query,
    "op6_ngram_jaccard_join": ngram_join.query,
    "op7_language_bigru": language.query,
    "op8_decontamination_tiling": decontaminate.query,
    "op9_sampled_pieces": sampled_pieces.query,
    "op10_license_scan": license_scan.query,
    "op11_backtracking_bpe": backtracking_bpe.query,
    "op12_jacobi_whitening": whitening.query,
    "op13_spelling_variants": spelling.query,
}
SQL = {
    "op1_quotation_linking": quotes.SQL,
    "op2_cross_entropy_difference": cross_entropy.SQL,
    "op6_ngram_jaccard_join": ngram_join.SQL,
}
