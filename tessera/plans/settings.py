"""Settings of a run: defaults, named profiles, overrides given as text, and a guard for optional steps."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping

#: Defaults. Fixed values where results depend on them.
DEFAULTS = {
    "seed": 42, "k1": 100, "rev_k": 5, "prefix_m": 48, "k2": 25, "lex_pairs": 400_000, "lex_min_count": 40, "text_off": "",
    "g_min_p": 0.5, "g_top": 6, "fs_em": False, "fs_max_iter": 200, "fs_tol": 1e-7, "n_folds": 3, "n_stages": 2, "holdout_frac": 0.0, "loco_countries": [],
    "min_p": 0.001, "unseen_min_q": 0.7, "calib_min_pairs": 1_000_000, "delta_grid": [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8], "soft_excl": True,
    "lam_grid": [0.6, 0.7, 0.8, 0.9, 1.12, 1.25, 1.4, 1.6], "min_p_grid": [0.01, 0.05], "hm_gate_grid": [0.05, 0.1, 0.2, 0.3],
    "st_pos_q": 0.98, "st_runner_up_q": 0.1, "st_neg_q": 0.02, "st_max_list": 6, "st_weight": 0.3, "st_drift": 0.15, "deadline_min": 450, "reserve_min": 40,
}
PROFILES = {
    "small": {"k1": 20, "rev_k": 2, "k2": 10, "n_folds": 2},
    "default": {},
    "recall": {"k1": 150, "rev_k": 10, "prefix_m": 64, "k2": 30},
}


def load(profile: str = "default", overrides: Mapping[str, str] | None = None) -> dict:
    """Defaults, the profile's values, and overrides (JSON text, or plain text where it is no JSON). Unknown names are errors."""
    if profile not in PROFILES:
        raise KeyError(f"unknown profile {profile}; known: {sorted(PROFILES)}")
    out = DEFAULTS | PROFILES[profile]
    for name, value in (overrides or {}).items():
        if name not in DEFAULTS:
            raise KeyError(f"unknown setting {name}")
        try:
            out[name] = json.loads(value)
        except json.JSONDecodeError:
            out[name] = value
    return out


def profile_for(cores: int, memory_gb: float) -> str:
    """The profile that the machines' cores and memory allow."""
    return "small" if memory_gb < 16 or cores < 4 else "recall" if memory_gb >= 56 and cores >= 8 else "default"


def guard(settings: Mapping, started: float, minutes: float, now: Callable[[], float] = time.time) -> bool:
    """Whether an optional step of so many minutes still fits before the deadline and its reserve."""
    return now() + 60 * (minutes + settings["reserve_min"]) <= started + 60 * settings["deadline_min"]
