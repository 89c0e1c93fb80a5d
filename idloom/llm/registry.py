"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from idloom.llm import bestfit, bpe, codes, language, media, minhash, oracles, packing, quality, resample, substring, toxicity, warc, wordpiece


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_media": media.op2_media,
        "op3_minhash": minhash.op3_minhash,
        "op4_quality_forest": quality.op4_quality_forest,
        "op5_warc": warc.op5_warc,
        "op6_substring": substring.op6_substring,
        "op7_packing": packing.op7_packing,
        "op8_language": language.op8_language,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_token_counts": wordpiece.op10_token_counts,
        "op11_best_fit": bestfit.op11_best_fit,
        "op12_vector_codes": codes.op12_vector_codes,
        "op13_importance": resample.op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
