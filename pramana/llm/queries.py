"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pramana.llm import decontaminate, divergence, licenses, lm, negatives, packing, pii, pivots, quality, simhash, sql, substrings, syncmers, toxicity


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_quality": quality.op2_quality,
        "op3_simhash": simhash.op3_simhash,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_pack": packing.op5_pack,
        "op6_licenses": licenses.op6_licenses,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_substrings": substrings.op8_substrings,
        "op9_syncmers": syncmers.op9_syncmers,
        "op10_pitman_yor": lm.op10_pitman_yor,
        "op11_divergence": divergence.op11_divergence,
        "op12_negatives": negatives.op12_negatives,
        "op13_pivots": pivots.op13_pivots,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_licenses": sql.LICENSES, "op7_decontaminate": sql.DECONTAMINATE, "op8_substrings": sql.SUBSTRINGS, "op11_divergence": sql.DIVERGENCE, "op12_negatives": sql.NEGATIVES, "op13_pivots": sql.NEAR_VECTORS}
