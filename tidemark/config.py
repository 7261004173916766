"""Study configuration: a nested mapping with dotted access, overrides and a fingerprint."""

from __future__ import annotations

import copy
import datetime
import hashlib
import json
from typing import Any

DEFAULTS: dict[str, Any] = {
    "study": {"seed": 20260902, "start": datetime.date(2007, 1, 1), "end": datetime.date(2026, 8, 31), "floor": datetime.date(2005, 6, 1)},
    "benchmarks": {"market": "MKTX", "fill_limit": 3, "vol_days": 20},
    "events": {"vol_window": 60, "min_prior_obs": 60, "z_threshold": -3.0, "cooldown": 20},
    "outcomes": {"horizons": [1, 5, 10, 20, 60], "primary": 20, "max_tau": 60},
    "crash_type": {"benchmark_pctile": 5.0, "min_periods": 252},
    "regimes": {"vix_high_quantile": 0.75},
    "models": {"train_frac": 0.70, "val_frac": 0.15, "embargo": 20},
    "bootstrap": {"n_boot": 2000, "ci": 0.95},
    "robustness": {
        "z_thresholds": [-2.5, -3.0, -3.5, -4.0], "vol_windows": [40, 60, 120], "cooldowns": [5, 10, 20, 40],
        "horizons": [5, 10, 20, 60], "vix_high_quantiles": [0.60, 0.75, 0.90], "min_events": 100,
    },
}


class Config:
    """Immutable; `get("events.cooldown")`, `override(**{"events.cooldown": 5})`."""

    def __init__(self, values: dict[str, Any] | None = None):
        self._values = copy.deepcopy(DEFAULTS if values is None else values)

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        with open(path) as f:
            return cls(_merged(copy.deepcopy(DEFAULTS), yaml.safe_load(f) or {}))

    def get(self, dotted: str) -> Any:
        at: Any = self._values
        for part in dotted.split("."):
            at = at[part]
        return copy.deepcopy(at)

    def override(self, **changes: Any) -> Config:
        values = copy.deepcopy(self._values)
        for dotted, value in changes.items():
            *path, last = dotted.split(".")
            at = values
            for part in path:
                at = at[part]
            if last not in at:
                raise KeyError(dotted)
            at[last] = value
        return Config(values)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self._values, sort_keys=True, default=str).encode()).hexdigest()[:12]


def _merged(base: dict, more: dict) -> dict:
    for k, v in more.items():
        base[k] = _merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
    return base
