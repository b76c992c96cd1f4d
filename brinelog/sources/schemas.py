"""Declared schemas; headers are these names."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def schema(ddl: str) -> StructType:
    """A schema from "name type, ..."; unlike StructType.fromDDL it needs no session, so it works at import."""
    kinds = {"long": LongType(), "double": DoubleType(), "string": StringType()}
    return StructType([StructField(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(","))])


# the column names of the five schemas are fixed values
CETP = schema(
    "s_no long, time string, cetp_inlet_cod double, cetp_inlet_bod double, cetp_inlet_ph double, cetp_inlet_tss double, "
    "cetp_outlet_cod double, cetp_outlet_bod double, cetp_outlet_ph double, cetp_outlet_tss double"
)
FACTORY = schema("s_no long, time string, factory_id string, cod double, bod double, ph double, tss double")
EVIDENCE = schema("logged_at string, cetp_event_time string, cetp_cod double, breach_mag double, alert_level string, backtrack_time string, attributed_factory string, factory_cod double, factory_bod double, factory_tss double")
TAMPER = schema(
    "tamper_type string, factory_id string, window_end string, cod_max double, cod_min double, cod_range double, row_count long, mean_cod double, mean_tss double, baseline_cod double, baseline_tss double, "
    "total_rows long, blackout_rows long, blackout_ratio double, logged_at string"
)
#: Raw plant headers and ours (fixed values).
RAW_HEADERS = {
    "S. No": "s_no",
    "Time": "time",
    "CETP_INLET-COD - (mg/l) Raw": "cetp_inlet_cod",
    "CETP_INLET-BOD - (mg/l) Raw": "cetp_inlet_bod",
    "CETP_INLET-pH - (pH) Raw": "cetp_inlet_ph",
    "CETP_INLET-TSS - (mg/l) Raw": "cetp_inlet_tss",
    "CETP_OUTLET-COD - (mg/l) Raw": "cetp_outlet_cod",
    "CETP_OUTLET-BOD - (mg/l) Raw": "cetp_outlet_bod",
    "CETP_OUTLET-pH - (pH) Raw": "cetp_outlet_ph",
    "CETP_OUTLET-TSS - (mg/l) Raw": "cetp_outlet_tss",
}
