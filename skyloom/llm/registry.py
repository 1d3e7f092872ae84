"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import decontamination, fingerprints, jaccard, licences, packing, quality, sharding, sql, toxicity, warc, wrappers

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_sharding": sharding.op2_sharding,
    "op3_packing": packing.op3_packing,
    "op4_wrappers": wrappers.op4_wrappers,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_licences": licences.op8_licences,
    "op9_warc": warc.op9_warc,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL = {
    "op6_jaccard": sql.JACCARD,
    "op8_licences": sql.LICENCES,
    "op9_warc": sql.WARC,
}
