"""Records of a data-set's preparation: what it is, what was found, split, built, chosen, sampled and decided. Each kind is a table of one schema, so records of many data sets are queried like any other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS, _MAP, _COUNTS = "array<string>", "map<string, string>", "map<string, bigint>"
#: Fields by kind of record; those that aren't named are strings.
KINDS: dict[str, dict[str, str]] = {
    "dataset_contract": dict.fromkeys(["version", "target", "modality", "time_column", "cost_fp_fn", "collection_window", "prediction_horizon", "intended_decision", "unit_of_observation"], "string")
    | dict.fromkeys(["keys", "sources", "group_keys", "assumptions", "constraints", "readiness_criteria"], _TEXTS)
    | {"allowed_values": _MAP},
    "finding": dict.fromkeys(["issue", "status", "evidence", "severity", "claim_kind", "likely_cause", "affected_scope", "validation_check", "recommended_action"], "string"),
    "data_quality_report": {"warnings": _TEXTS, "blockers": _TEXTS, "questions_for_next_stage": _TEXTS, "findings": "array<struct<issue: string, severity: string, evidence: string>>"},
    "split_manifest": {"strategy": "string", "group_key": "string", "embargo": "string", "rationale": "string", "seed": "bigint", "row_counts": _COUNTS, "class_rates": "map<string, double>", "overlap_checks": _MAP, "time_boundaries": _MAP},
    "feature_spec": dict.fromkeys(["kind", "name", "unit", "dtype", "formula", "fit_scope", "hypothesis", "leakage_risk", "missing_rule", "allowed_range", "encoding_scaling", "availability_time"], "string") | {"source_columns": _TEXTS},
    "transformation_step": {"step": "int", "name": "string", "operation": "string", "fit_scope": "string", "params": _MAP},
    "selection_record": dict.fromkeys(["cost", "caveat", "feature", "decision", "availability", "leakage_risk", "subgroup_impact", "redundancy_group"], "string") | {"stability": "double", "evidence": "map<string, double>", "reversible": "boolean"},
    "sampling_manifest": {"algorithm": "string", "fold_scope": "string", "synthetic_provenance": "string", "params": _MAP, "original_counts": _COUNTS, "resampled_counts": _COUNTS, "validation_test_prevalence": "double"},
    "diagnostic_report": {"protocol": "string", "error_slices": "map<string, double>", "ablations": "array<map<string, string>>", "out_of_fold_results": "map<string, double>", "forbidden_interpretations": _TEXTS},
    "dataset_card": {"version": "string", "provenance": "string", "intended_use": "string", "representativeness": "string", "exclusions": _TEXTS, "forbidden_uses": _TEXTS, "known_limitations": _TEXTS, "privacy_fairness_risks": _TEXTS},
    "readiness_verdict": {"verdict": "string", "passed": _TEXTS, "failed": _TEXTS, "accepted_exceptions": _TEXTS, "blocking_evidence": "string", "smallest_corrective_experiment": "string"},
}
#: Manifests that are lists of such records.
KINDS["feature_manifest"] = {"features": f"array<struct<{', '.join(f'{k}: {v}' for k, v in KINDS['feature_spec'].items())}>>"}
KINDS["transformation_manifest"] = {"steps": f"array<struct<{', '.join(f'{k}: {v}' for k, v in KINDS['transformation_step'].items())}>>"}
KINDS["selection_report"] = {"method_order": _TEXTS, "records": f"array<struct<{', '.join(f'{k}: {v}' for k, v in KINDS['selection_record'].items())}>>"}
DEFAULTS = {("finding", "severity"): "medium", ("finding", "claim_kind"): "fact", ("finding", "status"): "open", ("split_manifest", "strategy"): "stratified_random", ("readiness_verdict", "verdict"): "not_ready", ("selection_record", "decision"): "kept", ("dataset_contract", "modality"): "tabular"}


def schema_of(kind: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in KINDS[kind].items()))


def records(spark: SparkSession, kind: str, rows: Sequence[Mapping[str, object]]) -> DataFrame:
    """Records as a table of the kind's schema; fields that aren't given have the kind's default, or none. A field that the kind doesn't have is an error."""
    fields = KINDS[kind]
    for r in rows:
        if set(r) - set(fields):
            raise ValueError(f"{kind} has no {sorted(set(r) - set(fields))}")
    return spark.createDataFrame([tuple(r.get(f, DEFAULTS.get((kind, f))) for f in fields) for r in rows], schema_of(kind))


def from_table(df: DataFrame, kind: str, **fields: Column) -> DataFrame:
    """Records made of a table's rows: each field from an expression; the rest as in records."""
    return df.select(*[fields[f].cast(t).alias(f) if f in fields else F.lit(DEFAULTS.get((kind, f))).cast(t).alias(f) for f, t in KINDS[kind].items()])


def to_json(df: DataFrame) -> DataFrame:
    """(json): each record with its fields, those without a value among them."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def save(path: str, **manifests: DataFrame) -> None:
    """Named tables of records as line-delimited JSON below path, one folder a kind; saving again replaces them."""
    for name, df in manifests.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def load(spark: SparkSession, path: str, kind: str, name: str | None = None) -> DataFrame:
    return spark.read.schema(schema_of(kind)).json(f"{path}/{name or kind}")
