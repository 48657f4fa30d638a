"""The queries that apply the operators to their whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from . import decontam, licenses, line_dedup, near_dup, packing, pii, quality, sharding, token_orc, urls

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_token_orc": token_orc.op2_token_orc,
    "op3_url_cascade": urls.op3_url_cascade,
    "op4_quality_ledger": quality.op4_quality_ledger,
    "op5_setsketch": near_dup.op5_setsketch,
    "op6_pii_field": pii.op6_pii_field,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_packing": packing.op8_packing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_sharding": sharding.op10_sharding,
    "quality_ablations": quality.quality_ablations,
}

ORACLES = {
    "op1_license_scan": licenses.ORACLE_SQL,
    "op5_setsketch": near_dup.ORACLE_SQL,
    "op7_decontamination": decontam.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op3_url_cascade": urls.ORACLE_SQL,
    "op4_quality_ledger": quality.ORACLE_SQL,
    "quality_ablations": quality.ABLATIONS_SQL,
}
