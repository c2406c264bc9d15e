"""Queries of the training-data operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

from offerloom.llm import decontam, interpolation, jaccard, langid, neardup, packing, phrases, pii, quality, suffixes, toxicity, urls, whitening

QUERIES = {
    "op1_url_filters": urls.op1_url_filters,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_neardup": neardup.op3_neardup,
    "op4_packing": packing.op4_packing,
    "op5_quality": quality.op5_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_pii": pii.op9_pii,
    "op10_language_id": langid.op10_language_id,
    "op11_collocations": phrases.op11_collocations,
    "op12_lm_scoring": interpolation.op12_lm_scoring,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES: dict[str, str] = {"op1_url_filters": urls.OP1_SQL, "op2_jaccard_join": jaccard.OP2_SQL, "op7_suffix_dedup": suffixes.OP7_SQL, "op11_collocations": phrases.OP11_SQL}
