"""The subpackage's queries and, where SQL can express them, their SQL for the check."""

from __future__ import annotations

from . import exact, language, media, mixing, packing, repeats, secrets, shards, simhash, toolcalls


def queries() -> dict:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_toolcalls": toolcalls.op2_toolcalls,
        "op3_media": media.op3_media,
        "op4_mixing": mixing.op4_mixing,
        "op5_packing": packing.op5_packing,
        "op6_language": language.op6_language,
        "op7_exact": exact.op7_exact,
        "op8_shards": shards.op8_shards,
        "op9_repeats": repeats.op9_repeats,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_toolcalls": toolcalls.ORACLE, "op7_exact": exact.ORACLE}
