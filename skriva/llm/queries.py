"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, langid, lm, media, mixing, secrets, simhash, token_output, toxicity, warc

QUERIES = {
    "op1_language_id": langid.query,
    "op2_toxicity": toxicity.query,
    "op3_secret_scan": secrets.query,
    "op4_media_tiles": media.query,
    "op5_decontamination": decontaminate.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_source_mixing": mixing.query,
    "op8_warc_bundles": warc.query,
    "op9_token_orc": token_output.query,
    "op10_lm_scoring": lm.query,
}

ORACLE_SQL = {"op5_decontamination": decontaminate.SQL, "op7_source_mixing": mixing.SQL}
