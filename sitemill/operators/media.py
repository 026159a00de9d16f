"""Frame sampling, context assembly and summaries of media groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemill import constants as K
from sitemill.functions.text import blank_to_null, strip


def sample_frames(df: DataFrame, total: str, max_frames: int) -> DataFrame:
    """Uniformly spaced frame numbers per row, at most ``max_frames``; none without frames."""
    n = F.col(total)
    step = F.greatest(F.lit(1), F.floor(n / max_frames)).cast("long")
    frames = F.slice(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)).cast("long") - 1, step), 1, max_frames)
    return df.filter(n > 0).select("*", F.explode(frames).alias("frame"))


def context(df: DataFrame, key: str, order: str, text: str, brand: Column, speech: Column) -> DataFrame:
    """One text per group: brand, speech, and the distinct on-screen texts as first seen.

    Rows are reduced to distinct texts before a group is gathered.
    """
    shown = df.select(key, strip(F.col(text)).alias("_text"), order, brand.alias("_brand"), speech.alias("_speech"))
    seen = shown.groupBy(key, "_text").agg(
        F.min(order).alias("_ord"), F.min("_brand").alias("_brand"), F.min("_speech").alias("_speech")
    )
    kept = F.when(F.col("_text") != "", F.struct("_ord", "_text"))
    joined = seen.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(kept)), lambda r: r["_text"]), " | "
        ).alias("visual_ocr_text"),
        F.min("_brand").alias("brand_name"),
        F.coalesce(F.min("_speech"), F.lit("")).alias("speech_transcript"),
    )
    return joined.withColumn(
        "full_semantic_payload",
        F.concat(
            F.lit("Brand: "), "brand_name", F.lit(" | Speech: "), "speech_transcript",
            F.lit(" | OnScreen Text: "), "visual_ocr_text",
        ),
    )


def cluster_brands(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Distinct non-empty brands, one row each: a cluster may have any number."""
    return df.select(cluster, blank_to_null(F.col("brand")).alias("brand")).dropna().distinct()


def summarize(df: DataFrame, cluster: str = "cluster_id", order: str = "ord", known: DataFrame | None = None) -> DataFrame:
    """Summary per cluster: hook, overlay text, leading media type and brand, counts, script and visual prompt.

    The hook is the first speech, else the first title, else a default; the lead brand is the first
    one named. A cluster of ``known`` without items gets an error row. Items are reduced
    per (cluster, type, brand), and those rows per cluster; brands are counted without a list of them.
    """
    first = {"speech": "speech_transcript", "title": "title", "overlay": "ocr_text"}

    def at(value: Column) -> Column:
        return F.min(F.when(value.isNotNull(), F.struct(F.col(order).alias("at"), value.alias("v"))))

    kind, brand = F.coalesce("type", F.lit(K.DEFAULT_MEDIA_TYPE)), blank_to_null(F.col("brand"))
    parts = df.groupBy(cluster, kind.alias("kind"), brand.alias("named")).agg(
        F.count("*").alias("n"), F.min(order).alias("named_at"), *[at(blank_to_null(F.col(c))).alias(k) for k, c in first.items()]
    )
    of_kind = F.sum("n").over(Window.partitionBy(cluster, "kind"))
    rows = parts.withColumn("of_kind", of_kind).groupBy(cluster).agg(
        # Most frequent type, the smallest name among equals.
        F.min(F.struct(-F.col("of_kind"), F.col("kind").alias("k")))["k"].alias("primary_media_type"),
        F.sum("n").alias("analyzed_items_count"),
        F.count_distinct("named").alias("brand_count"),
        F.min(F.when(F.col("named").isNotNull(), F.struct("named_at", "named")))["named"].alias("lead_brand"),
        *[F.min(k)["v"].alias(f"_{k}") for k in first],
    )
    if known is not None:
        rows = known.select(cluster).distinct().join(rows, cluster, "left")
    found = F.col("analyzed_items_count").isNotNull()
    hook = F.coalesce("_speech", "_title", F.lit(K.DEFAULT_HOOK))
    overlay = F.coalesce("_overlay", F.lit(K.DEFAULT_OVERLAY))
    script = F.format_string(
        'Script for cluster #%s\nVoiceover: "%s"\nOn-Screen Text: "%s"',
        F.col(cluster).cast("string"), hook, overlay,
    )
    prompt = F.format_string('Product shot of %s with the text "%s"', F.coalesce("lead_brand", F.lit(K.DEFAULT_SUBJECT)), overlay)
    return rows.select(
        cluster,
        F.when(found, "success").otherwise("error").alias("status"),
        F.when(~found, "Cluster contains no items").alias("message"),
        "primary_media_type",
        "analyzed_items_count",
        F.when(found, F.coalesce("brand_count", F.lit(0))).alias("brand_count"),
        "lead_brand",
        F.when(found, hook).alias("hook"),
        F.when(found, overlay).alias("overlay"),
        F.when(found, script).alias("generated_script"),
        F.when(found, prompt).alias("visual_prompt"),
    )
