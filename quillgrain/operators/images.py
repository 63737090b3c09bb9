"""Image descriptions: normalising a vision model's JSON, page text, status counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.providers import generate_or_error

#: Labels of the page text, and the value that stands for no chart (fixed values).
LABELS = {"image": "[图片] ", "untitled": "无题注图片", "alt": "替代文本：", "ocr": "图内文字：", "subjects": "主体：", "facts": "关键事实：", "trends": "图表趋势：", "doubts": "不确定项："}
NOT_A_CHART = "不适用"
#: Around the reason why an image isn't indexed (fixed values).
UNINDEXED = ("（未索引：", "）")


def description(answer: Column) -> Column:
    """struct<ocr_text, subjects, key_facts, chart_trends, uncertainties>; null if there is no JSON object.

    Fields that are missing or of another type are empty; list items are trimmed, blank ones dropped.
    """
    body = F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))
    parsed = F.try_parse_json(body)
    string = lambda name: F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")) == "STRING", F.try_variant_get(parsed, f"$.{name}", "string")), F.lit(""))
    items = lambda name: F.filter(F.transform(F.coalesce(F.try_variant_get(parsed, f"$.{name}", "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    fields = F.struct(string("ocr_text").alias("ocr_text"), items("subjects").alias("subjects"), items("key_facts").alias("key_facts"), string("chart_trends").alias("chart_trends"), items("uncertainties").alias("uncertainties"))
    return F.when(parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT"), fields)


def page_text(found: Column, alt: Column, caption: Column) -> Column:
    """The searchable text of a described image, in a fixed order of lines; empty parts are left out."""
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    listed = lambda c, mark: F.when(F.size(c) > 0, F.array_join(c, mark))
    title = F.coalesce(some(caption), some(alt), F.lit(LABELS["untitled"]))
    line = lambda name, value: F.concat(F.lit(LABELS[name]), value)
    return F.concat_ws(
        "\n",
        line("image", title),
        F.when(some(alt) != title, line("alt", alt)),
        line("ocr", some(found["ocr_text"])),
        line("subjects", listed(found["subjects"], "、")),
        line("facts", listed(found["key_facts"], "；")),
        F.when(found["chart_trends"] != NOT_A_CHART, line("trends", some(found["chart_trends"]))),
        line("doubts", listed(found["uncertainties"], "；")),
    )


def image_status(skip: Column, size: Column, answer: Column, max_bytes: int) -> Column:
    """skipped, failed (too large or no description) or success."""
    return F.when(skip.isNotNull(), "skipped").when(size > max_bytes, "failed").when(answer.isNull(), "failed").otherwise("success")


def describe(images: DataFrame, make: Callable[[], Callable[[list[bytes]], list[str]]], max_bytes: int = 10 << 20) -> DataFrame:
    """Images (content, skip_reason, alt, caption) with status, reason and said, the text they are searched by.

    An image that is skipped or larger than ``max_bytes`` isn't sent. One that
    the provider fails on, or answers without a JSON object, has failed with its
    reason; the others of its batch are described.
    """
    size = F.octet_length("content")
    send = F.col("skip_reason").isNull() & F.coalesce(size <= max_bytes, F.lit(False))
    asked = images.withColumn("reply", generate_or_error(F.when(send, F.col("content")), make))
    found = asked.withColumn("found", description(F.col("reply.text")))
    reason = F.coalesce("skip_reason", F.when(F.col("content").isNull(), "no_content").when(size > max_bytes, "too_large"), "reply.error", F.when(F.col("found").isNull(), "no_description"))
    status = image_status(F.col("skip_reason"), size, F.col("found"), max_bytes)
    placeholder = F.concat(F.lit(LABELS["image"]), F.coalesce(F.nullif("alt", F.lit("")), F.lit(LABELS["untitled"])), F.lit(UNINDEXED[0]), reason, F.lit(UNINDEXED[1]))
    return found.select("*", status.alias("status"), reason.alias("reason")).withColumn("said", F.when(F.col("status") == "success", page_text(F.col("found"), F.col("alt"), F.col("caption"))).otherwise(placeholder)).drop("reply", "found")


def status_counts(rows: DataFrame, key: str) -> DataFrame:
    """Per document: images by status, zeros kept."""
    return rows.groupBy(key).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "skipped")))
