"""The training-data queries and their SQL, added to the entry module when this subpackage is there."""

from __future__ import annotations

from fabula.llm import alignment, decontam, jaccard, langid, linededup, media, mixing, quality, suffixes, tokens, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_suffixes": suffixes.op2_suffixes,
        "op3_tokens": tokens.op3_tokens,
        "op4_line_dedup": linededup.op4_line_dedup,
        "op5_jaccard": jaccard.op5_jaccard,
        "op6_decontaminate": decontam.op6_decontaminate,
        "op7_warc": warc.op7_warc,
        "op8_media": media.op8_media,
        "op9_mix": mixing.op9_mix,
        "op10_language": langid.op10_language,
        "op11_alignment": alignment.op11_alignment,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": linededup.OP4_SQL, "op5_jaccard": jaccard.OP5_SQL, "op7_warc": warc.OP7_SQL}
