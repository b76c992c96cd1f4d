"""All parameters, with their checks. A Config is passed to builders; nothing is read at import."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, fields, replace

BANDS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
#: Environment variables that are not just a field's name (fixed values).
NAMES = {"cetp_dir": "CETP_DATA_DIR", "factory_dir": "FACTORY_DATA_DIR"}
_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%j": "DDD", "%p": "a", "%I": "hh", "%b": "MMM", "%B": "MMMM", "%z": "xx", "%%": "%"}


def spark_pattern(strftime: str) -> str:
    """A strftime pattern as Spark writes it; letters between the directives are quoted."""
    parts = re.split(r"(%.)", strftime)
    if odd := [p for p in parts[1::2] if p not in _STRFTIME]:
        raise ValueError(f"input_time_format has unknown directives: {', '.join(odd)}")
    return "".join(_STRFTIME[p] if k % 2 else re.sub(r"([A-Za-z]+)", r"'\1'", p.replace("'", "''")) for k, p in enumerate(parts))


@dataclass(frozen=True)
class Config:
    # names and defaults are fixed values
    window_seconds: int = 300
    window_duration_ms: int = 30_000
    window_hop_ms: int = 5_000
    zscore_threshold: float = 3.0
    epsilon: float = 1e-9
    persistence_count: int = 3
    alert_cooldown_seconds: int = 60
    alert_min_risk_band: str = "MEDIUM"
    metrics_log_interval_seconds: int = 30
    metrics_emit_interval_seconds: int = 10
    metrics_output_path: str = "data/alerts/pipeline_metrics.json"
    log_level: str = "INFO"
    input_time_format: str = "yyyy-MM-dd HH:mm"
    input_schema_sensor_column: str = "factory_id"
    input_schema_value_column: str = "cod"
    max_sensor_id_length: int = 64
    # the first matching pattern counts, so the order matters
    sensor_value_range: dict = field(default_factory=lambda: {"*ph*": [0.0, 14.0], "*turbidity*": [0.0, 1000.0], "*flow*": [0.0, 10000.0], "*": [-1e9, 1e9]})
    cetp_dir: str = "data/cetp"
    factory_dir: str = "data/factories"
    alert_log_path: str = "data/alerts/evidence_log"
    tamper_log_path: str = "data/alerts/tamper_log"
    cod_baseline: float = 193.0
    cod_threshold: float = 200.0
    pipe_travel_minutes: int = 15
    asof_tolerance_seconds: int = 120
    zero_variance_minutes: int = 5
    cod_drop_fraction: float = 0.80
    tss_stable_fraction: float = 0.20
    blackout_min_minutes: int = 10
    shield_webhook_url: str = ""
    river_sensitivity: dict = field(default_factory=lambda: {"discharge_point_A": 3.5, "discharge_point_B": 1.2})
    default_sensitivity: float = 2.0
    severity_multiplier: float = 1.0
    eri_threshold_low: float = 2.0
    eri_threshold_medium: float = 5.0
    eri_threshold_high: float = 10.0
    sensor_groups: dict = field(default_factory=lambda: {"discharge_point_A": ["FACTORY_A", "FACTORY_B", "FACTORY_C", "FACTORY_D"]})
    group_threshold: float = 2.5
    sync_tolerance_ms: int = 5_000
    watermark: str = "10 minutes"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        """Defaults, with each field replaced by the environment variable of its upper-cased name (NAMES has the exceptions), if set.

        INPUT_TIME_FORMAT may be a strftime pattern; it is turned into Spark's.
        """
        env = os.environ if env is None else env
        base, new = cls(), {}
        for f in fields(cls):
            if (raw := env.get(NAMES.get(f.name, f.name.upper()))) is not None:
                kind = type(getattr(base, f.name))
                new[f.name] = json.loads(raw) if kind is dict else kind(raw)
        out = replace(base, **new)
        if "%" in out.input_time_format:
            out = replace(out, input_time_format=spark_pattern(out.input_time_format))
        return replace(out, alert_min_risk_band=out.alert_min_risk_band.upper())

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    def checked(self) -> Config:
        """self, or ValueError for the first field that breaks its constraint."""

        def need(ok: bool, name: str, what: str) -> None:
            if not ok:
                raise ValueError(f"{name} must be {what} (got {getattr(self, name)!r})")

        need(self.window_seconds >= 10, "window_seconds", "at least 10")
        need(self.window_hop_ms >= 1, "window_hop_ms", "at least 1")
        need(self.window_duration_ms > self.window_hop_ms, "window_duration_ms", "greater than window_hop_ms")
        need(self.zscore_threshold > 0, "zscore_threshold", "positive")
        need(0 < self.epsilon < 1e-6, "epsilon", "between 0 and 1e-6")
        need(self.persistence_count >= 1, "persistence_count", "at least 1")
        need(self.alert_cooldown_seconds >= 0, "alert_cooldown_seconds", "at least 0")
        need(self.alert_min_risk_band in BANDS, "alert_min_risk_band", f"one of {BANDS}")
        for name in ("metrics_log_interval_seconds", "metrics_emit_interval_seconds", "max_sensor_id_length", "pipe_travel_minutes", "asof_tolerance_seconds", "zero_variance_minutes", "blackout_min_minutes", "sync_tolerance_ms"):
            need(getattr(self, name) >= 1, name, "at least 1")
        need(self.log_level in ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"), "log_level", "a logging level")
        for name in ("input_time_format", "input_schema_sensor_column", "input_schema_value_column"):
            need(bool(getattr(self, name).strip()), name, "non-blank")
        need(all(isinstance(v, list | tuple) and len(v) == 2 and all(isinstance(x, int | float) for x in v) and v[0] < v[1] for v in self.sensor_value_range.values()), "sensor_value_range", "patterns with [min, max], min < max")
        need(self.cod_baseline > 0, "cod_baseline", "positive")
        need(self.cod_threshold > self.cod_baseline, "cod_threshold", "greater than cod_baseline")
        for name in ("cod_drop_fraction", "tss_stable_fraction"):
            need(0 < getattr(self, name) < 1, name, "between 0 and 1")
        need(bool(self.sensor_groups) and all(self.sensor_groups.values()), "sensor_groups", "non-empty groups")
        need(self.group_threshold > 0, "group_threshold", "positive")
        need(all(1 <= v <= 5 for v in self.river_sensitivity.values()), "river_sensitivity", "factors from 1 to 5")
        need(1 <= self.default_sensitivity <= 5, "default_sensitivity", "from 1 to 5")
        need(self.severity_multiplier > 0, "severity_multiplier", "positive")
        need(0 < self.eri_threshold_low < self.eri_threshold_medium < self.eri_threshold_high, "eri_threshold_low", "positive and below medium, medium below high")
        return self


if __name__ == "__main__":
    print(Config.from_env().checked().to_json())
