"""Roles and the canonical record columns that every operator uses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ROLES = ("internal", "processor", "bank")  # canonical order

RECORD_COLUMNS = {
    "record_id": "string", "source_id": "string", "batch_id": "string", "batch_ord": "int", "source_line": "long", "role": "string", "role_rank": "int",
    "external_id": "string", "business_id": "string", "amount_minor": "long", "fee_minor": "long", "currency": "string", "scale": "int",
    "direction": "string", "ts_ns": "long", "timestamp_raw": "string", "counterparty": "string", "memo": "string",
    "content_hash": "string", "stable_key": "string", "isolated": "boolean", "invalid_reason": "string",
}
RECORD_SCHEMA = ", ".join(f"{c} {t}" for c, t in RECORD_COLUMNS.items())

# Registered currencies and their digits after the point.
CURRENCY_SCALES = {"USD": 2, "EUR": 2, "GBP": 2, "CNY": 2, "JPY": 0}


def role_rank(role: Column) -> Column:
    """The place of a role in the canonical order; unknown roles come last."""
    out = F.lit(len(ROLES))
    for i, r in enumerate(ROLES):
        out = F.when(role == r, i).otherwise(out)
    return out


def currency_scale(code: Column, extra: dict[str, int] | None = None) -> Column:
    """Digits of a currency, case-insensitively; null for an unknown one."""
    pairs = [F.lit(x) for kv in (CURRENCY_SCALES | (extra or {})).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.upper(code))
