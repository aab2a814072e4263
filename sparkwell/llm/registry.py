"""The queries of this subpackage and their SQL twins."""

from . import ann, chat, mixing, near_dedup, packing, pii, quality, sharding, toxicity, urls


def queries() -> dict:
    return {
        "op1_quality_rules": quality.query,
        "op2_near_dedup": near_dedup.query,
        "op3_toxicity": toxicity.query,
        "op4_url_filter": urls.query,
        "op5_pii": pii.query,
        "op6_chat_format": chat.query,
        "op7_ann": ann.query,
        "op8_mixing": mixing.query,
        "op9_sharding": sharding.query,
        "op10_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": urls.ORACLE, "op6_chat_format": chat.ORACLE}
