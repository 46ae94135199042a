"""The subpackage's queries and their SQL, for the entry module."""

from __future__ import annotations

from tessera.llm import alignment, decontamination, embedding_dedup, fingerprint, lexical, licenses, mixing, packing, quality, secrets, simhash, suffix_dedup, warc

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_quality": quality.op2_quality,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_packing": packing.op5_packing,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_warc": warc.op7_warc,
    "op8_licenses": licenses.op8_licenses,
    "op9_mixing": mixing.op9_mixing,
    "op10_simhash": simhash.op10_simhash,
    "op11_alignment": alignment.op11_alignment,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_lexical": lexical.op13_lexical,
}

ORACLE_SQL = {
    "op7_warc": warc.OP7_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op12_decontamination": decontamination.OP12_SQL,
    "op13_lexical": lexical.OP13_SQL,
}
