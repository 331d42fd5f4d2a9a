"""Validation of whole tables: a column of violation codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora import schemas as S


def in_unit(c: Column) -> Column:
    return F.coalesce((c >= 0) & (c <= 1) & ~F.isnan(c), F.lit(False))


def violations(rules: dict[str, Column]) -> Column:
    """Codes of the rules that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules.items()]))


def experience_rules(dimension: int | Column) -> dict[str, Column]:
    c = F.col
    return {
        "content_empty": F.coalesce(F.octet_length("content"), F.lit(0)) == 0,
        "content_too_large": F.octet_length("content") > S.MAX_CONTENT_BYTES,
        "importance_range": ~in_unit(c("importance")),
        "confidence_range": ~in_unit(c("confidence")),
        "too_many_tags": F.size("domain") > S.MAX_TAGS,
        "tag_too_long": F.exists("domain", lambda x: F.octet_length(x) > S.MAX_TAG_BYTES),
        "too_many_files": F.size("related_files") > S.MAX_FILES,
        "file_too_long": F.exists("related_files", lambda x: F.octet_length(x) > S.MAX_FILE_BYTES),
        "dimension_mismatch": F.coalesce(F.size("embedding"), F.lit(-1)) != dimension,
        "agent_empty": F.coalesce(F.octet_length("source_agent"), F.lit(0)) == 0,
        "agent_too_long": F.octet_length("source_agent") > S.MAX_AGENT_BYTES,
    }


#: The rules of what an update may set.
OF_UPDATES = {"importance_range", "confidence_range", "too_many_tags", "tag_too_long", "too_many_files", "file_too_long"}


def relation_rules() -> dict[str, Column]:
    return {"self_relation": F.col("source_id") == F.col("target_id"), "strength_range": ~in_unit(F.col("strength")), "metadata_too_large": F.octet_length("metadata") > S.MAX_METADATA_BYTES}


def insight_rules(dimension: int | Column) -> dict[str, Column]:
    n = F.coalesce(F.size("source_experience_ids"), F.lit(0))
    return {"content_empty": F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "content_too_large": F.octet_length("content") > S.MAX_INSIGHT_BYTES, "confidence_range": ~in_unit(F.col("confidence")), "no_sources": n < 1, "too_many_sources": n > S.MAX_INSIGHT_SOURCES, "dimension_mismatch": F.coalesce(F.size("embedding"), F.lit(-1)) != dimension}


def activity_rules() -> dict[str, Column]:
    return {"agent_empty": F.coalesce(F.octet_length("agent_id"), F.lit(0)) == 0, "agent_too_long": F.octet_length("agent_id") > S.MAX_ACTIVITY_AGENT_BYTES, "task_too_long": F.octet_length("current_task") > S.MAX_ACTIVITY_TEXT_BYTES, "summary_too_long": F.octet_length("context_summary") > S.MAX_ACTIVITY_TEXT_BYTES}


def collective_rules() -> dict[str, Column]:
    return {"name_blank": F.coalesce(F.length(F.trim("name")), F.lit(0)) == 0, "name_too_long": F.octet_length("name") > S.MAX_NAME_BYTES, "owner_empty": F.octet_length("owner_id") == 0}


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with their codes."""
    marked = df.withColumn("violations", violations(rules))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)
