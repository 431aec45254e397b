"""Short forms of nested results, some keys of a result by its method as JSON of limited length; and any row as JSON that a
report can hold. No Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys that a method's short form lists, whether absent ones are left out (else null), and its longest form.
SHORT = {
    "deepfake_protocol": ("protocol_version triage_assessment screening_observations evidence_families validated_external_models evidentiary_conclusion", False, 1000),
    "video_deepfake_protocol": ("protocol_version triage_assessment screening_observations evidence_families validated_external_models evidentiary_conclusion", False, 1000),
    "noise_map": ("residual_std residual_mad local_std_mean local_std_cv mean std mad blocks", True, None),
    "noise_residual": ("residual_std residual_mad local_std_mean local_std_cv mean std mad blocks", True, None),
    "frequency": ("high_low_frequency_ratio spectral_peak_count spectral_peak_indices quadrant_mean_cv", False, None),
    "synthetic_feature_bank": ("feature_family feature_count calibrated", False, None),
    "synthetic_ml": ("status model_name predicted_label score score_synthetic validated calibrated reason", True, None),
    "synthetic_deep": ("status model_name predicted_label score score_synthetic validated calibrated reason", True, None),
    "synthetic_evidence_fusion": ("convergence_level family_count independent_families warning", True, 800),
    "face_context_consistency": ("faces_detected faces_analyzed screening_flags", False, None),
    "resampling": ("max_nonzero_autocorrelation short_lag_persistence screening_flag screening_threshold status", False, None),
    "jpeg_ghost": ("minimum_error_quality minimum_mean_abs_error", False, None),
    "jpeg_quantization": ("available table_count fingerprints", False, 700),
    "prnu_screen": ("residual_std local_energy_mean local_energy_cv blocks status", False, None),
    "face_artifacts": ("faces_detected faces_analyzed status", False, None),
    "video_timing": ("frame_count timestamp_count large_gaps i_frames", False, 700),
    "video_duplicates": ("frame_count duplicate_count adjacent_near_duplicates mad_threshold median_adjacent_mad", False, 700),
    "video_transition_anomalies": ("frame_count anomaly_count anomalous_transitions threshold median_transition_mad status", False, 700),
    "video_motion_discontinuities": ("frame_count anomaly_count anomalies robust_z_threshold status", False, 700),
}
#: Longest forms of results of other methods: objects, and what is no object.
OTHER_CHARS, PLAIN_CHARS = 650, 700


def listed(members: Column, keys: list[str], present: bool) -> Column:
    """A JSON object of some keys of members (MAP<STRING, VARIANT>), in their order."""
    def one(key: str) -> Column:
        value = F.try_element_at(members, F.lit(key))
        text = F.concat(F.lit(f'"{key}": '), F.coalesce(F.to_json(value), F.lit("null")))
        return F.when(F.map_contains_key(members, key), text) if present else text

    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[one(k) for k in keys])), ", "), F.lit("}"))


def short_form(method: Column, result: Column) -> Column:
    """The short form of a result in JSON text. Results that are no object are their own text, those of methods without a list
    of keys their JSON, both cut; null and unreadable results give null. Names inside nested values are in their own order."""
    whole, members = F.try_parse_json(result), F.from_json(result, "map<string,variant>")
    form = F.substring(F.to_json(whole), 1, OTHER_CHARS)
    for name, (keys, present, most) in SHORT.items():
        text = listed(members, keys.split(), present)
        form = F.when(method == name, text if most is None else F.substring(text, 1, most)).otherwise(form)
    is_object = F.startswith(F.ltrim(result), F.lit("{"))
    plain = F.substring(F.coalesce(F.try_variant_get(whole, "$", "string"), F.to_json(whole)), 1, PLAIN_CHARS)
    return F.when(whole.isNotNull(), F.when(is_object, form).otherwise(plain))


def short_results(results: DataFrame, *, method: str = "method", result: str = "result") -> DataFrame:
    return results.withColumn("short", short_form(F.col(method), F.col(result)))


def safe_value(value: Column, kind: T.DataType) -> Column:
    """A value of any type as one that JSON has: numbers, booleans and text stay, numbers that are not finite, times, intervals
    and all else become text, bytes their hex, keys of maps text; nested values in the same way."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[safe_value(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: safe_value(v, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), safe_value(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # JSON has no such numbers: as variants both kinds can stand in one array.
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.parse_json(F.concat(F.lit('"'), value.cast("string"), F.lit('"')))).otherwise(F.parse_json(value.cast("string")))
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(kind, (T.IntegralType, T.BooleanType, T.StringType, T.VariantType, T.DecimalType, T.NullType)):
        return value
    return value.cast("string")


def json_safe(df: DataFrame, columns: list[str] | None = None, name: str = "json") -> DataFrame:
    """df with one column of JSON of its columns (all, unless named), null fields kept."""
    own = [f for f in df.schema if columns is None or f.name in columns]
    whole = F.struct(*[safe_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in own])
    return df.withColumn(name, F.to_json(whole, {"ignoreNullFields": "false"}))
