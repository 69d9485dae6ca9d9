"""The notice table, of which every operator reads a part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns and types of a notice; seq is the input order that first-wins rules follow.
NOTICE: dict[str, str] = {
    "title": "string", "url": "string", "source": "string", "tender_number": "string", "customer": "string", "region": "string",
    "price": "double", "deadline": "timestamp", "status": "string", "published_at": "timestamp", "discovered_at": "timestamp",
    "raw_text": "string", "category": "string", "include_reason": "string", "exclude_reason": "string", "filter_status": "string",
    "match_confidence": "string", "review_priority": "string", "matched_terms": "array<string>", "detail_status": "string",
    "document_matches": "array<string>", "delivery_region_evidence": "string", "source_confidence": "double", "official_number": "string",
    "official_url": "string", "official_source": "string", "platform_number": "string", "platform_url": "string", "procurement_law": "string",
    "resolution_method": "string", "resolution_confidence": "double", "unique_key": "string", "seq": "bigint",
}

DEFAULTS = {"raw_text": "", "include_reason": "", "exclude_reason": "", "delivery_region_evidence": "", "source_confidence": 0.0, "resolution_confidence": 0.0, "detail_status": "not_checked"}


def as_notices(df: DataFrame) -> DataFrame:
    """All columns of a notice in order: missing ones are null or their default; others are dropped."""
    out = []
    for name, kind in NOTICE.items():
        value = F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[name]).cast(kind))
        if name in ("matched_terms", "document_matches"):
            value = F.coalesce(value, F.array().cast(kind))
        out.append(value.alias(name))
    return df.select(*out)
