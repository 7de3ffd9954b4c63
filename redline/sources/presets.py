"""The ten editorial profiles as a dimension table, and profile resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redline import vocab as V

SCHEMA = (
    "preset_no int, name string, genre string, subgenre string, audience_type string, audience_age_range string, "
    "audience_expertise string, register string, tone string, intervention_level string, "
    "preserve_author_voice boolean, max_rewrite_ratio double, max_expansion_ratio double, readability_min int, "
    "readability_max int, style_priorities array<string>, protected_terms array<string>, "
    "forbidden_changes array<string>, disabled_rules array<string>, ui_name string, ui_description string, ui_icon string"
)
UI_FIELDS = ["ui_name", "ui_description", "ui_icon"]
# What a profile has when it names no preset.
DEFAULTS = {
    "audience_expertise": "medio", "register": "neutro", "tone": "neutro", "intervention_level": "moderada",
    "preserve_author_voice": True, "max_rewrite_ratio": 0.30, "max_expansion_ratio": 1.10,
}
DEFAULT_PRIORITIES = ["claridad", "fluidez", "cohesion", "precision_lexica"]


def presets(spark: SparkSession) -> DataFrame:
    """Ten rows, fixed: always small enough to broadcast."""
    return spark.createDataFrame(V.PRESETS, SCHEMA)


def preset_by_name(spark: SparkSession, name: str) -> DataFrame:
    return presets(spark).filter(F.col("name") == name).drop(*UI_FIELDS)


def ui_listing(spark: SparkSession) -> DataFrame:
    return presets(spark).select(
        F.col("name").alias("key"), F.col("ui_name").alias("name"), F.col("ui_description").alias("description"),
        F.col("ui_icon").alias("icon"), "intervention_level", "register",
    )


def _default(field: str) -> Column:
    if field == "style_priorities":
        return F.array(*[F.lit(p) for p in DEFAULT_PRIORITIES])
    if field in ("protected_terms", "forbidden_changes", "disabled_rules"):
        return F.array().cast("array<string>")
    return F.lit(DEFAULTS.get(field))


def resolve(requests: DataFrame, key: str = "doc_id") -> DataFrame:
    """Profile per request row: override, else preset, else default, field by field.

    ``requests`` has the key, preset_name (may be null or unknown) and any of the profile fields as overrides.
    """
    table = presets(requests.sparkSession).drop(*UI_FIELDS)
    fields = [c for c in table.columns if c not in ("preset_no", "name")]
    renamed = table.select("name", *[F.col(c).alias(f"_p_{c}") for c in fields])
    joined = requests.join(F.broadcast(renamed), requests["preset_name"] == F.col("name"), "left")
    given = set(requests.columns)
    types = {f.name: f.dataType for f in table.schema}

    def value(field: str) -> Column:
        options = [F.col(field)] if field in given else []
        options.append(F.when(F.col("name").isNotNull(), F.col(f"_p_{field}")).otherwise(_default(field).cast(types[field])))
        return F.coalesce(*options).alias(field)

    changed = [F.col(f).isNotNull() for f in fields if f in given]
    any_change = F.lit(False)
    for test in changed:
        any_change = any_change | test
    source = F.when(any_change, "custom").when(F.col("name").isNotNull(), "preset").otherwise("default")
    return joined.select(key, "preset_name", *[value(f) for f in fields], source.alias("source"))


def fill_inferred(profiles: DataFrame, inferred: DataFrame, key: str = "doc_id") -> DataFrame:
    """Inferred genre, audience, register and tone fill only what the profile leaves empty."""
    fields = ["genre", "audience_type", "register", "tone"]
    extra = inferred.select(key, *[F.col(f).alias(f"_i_{f}") for f in fields])
    joined = profiles.join(extra, key, "left")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_i_{f}")))
    return joined.drop(*[f"_i_{f}" for f in fields])
