"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import crosstokens, decontam, langid, lineclean, packing, quality, secretscan, sharding, simhash, substrings, tokens, toxicity, whitening


def queries() -> dict:
    return {
        "op1_langid": langid.op1_langid,
        "op2_tokens": tokens.op2_tokens,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_decontaminate": decontam.op4_decontaminate,
        "op5_simhash": simhash.op5_simhash,
        "op6_lines": lineclean.op6_lines,
        "op7_quality": quality.op7_quality,
        "op8_secrets": secretscan.op8_secrets,
        "op9_packing": packing.op9_packing,
        "op10_substrings": substrings.op10_substrings,
        "op11_crosstokens": crosstokens.op11_crosstokens,
        "op12_whitening": whitening.op12_whitening,
        "op13_sharding": sharding.op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": decontam.ORACLE_SQL,
        "op6_lines": lineclean.ORACLE_SQL,
        "op13_sharding": sharding.ORACLE_SQL,
    }
