"""Settings that are part of the results, with the defaults of the published study.

Every job takes these as arguments; nothing below is read implicitly by a plan.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------- fixed values
# Calendar and numeric constants of the study. They must keep these values for
# results to be comparable.
CATEGORY_BREAKS = ("2011-01-01", "2016-01-01", "2022-01-01")
TOPIC_BREAKS = ("2011-01-01", "2016-01-01", "2017-01-01", "2022-01-01")
BREAK_WINDOW_MONTHS = 12
MIN_BREAK_LEVEL = 1e-6
MIN_BREAK_CHANGE = 0.01
HP_LAMBDA = 129600.0
YOY_LAG = 12
LOG_FLOOR = 1e-6
FIRST_TOPIC_ID = 10000

EXCLUDED_ENTITIES = ("CN", "SA", "TR", "ZA", "MX", "RU", "ID", "IN", "AR", "BR")
EXCLUDED_SERIES = ("10052",)
REFERENCE_ENTITY = "AU"

AREA_TO_ENTITY = {
    "AUS": "AU",
    "CAN": "CA",
    "DEU": "DE",
    "FRA": "FR",
    "GBR": "GB",
    "ITA": "IT",
    "JPN": "JP",
    "KOR": "KR",
    "USA": "US",
}

RATE_DIMENSIONS = {
    "MEASURE": "UNE_LF_M",
    "UNIT_MEASURE": "PT_LF_SUB",
    "TRANSFORMATION": "_Z",
    "ADJUSTMENT": "Y",
    "SEX": "_T",
    "AGE": "Y_GE15",
    "ACTIVITY": "_Z",
    "FREQ": "M",
}

TRAINING_WINDOW = 60
TARGET_LAGS = 1
HOLDOUT_MONTHS = 24
VALIDATION_MONTHS = 24
WINDOW_OPTIONS = (60, 84, 120)
LAG_OPTIONS = (0, 1, 2, 3)
SEED = 42
STARTUP_TRIALS = 5
WARMUP_MONTHS = 3
# ------------------------------------------------------------ end fixed values


@dataclass(frozen=True)
class BreakRule:
    """Break dates per kind and the three thresholds of the level adjustment."""

    category: tuple[str, ...] = CATEGORY_BREAKS
    topic: tuple[str, ...] = TOPIC_BREAKS
    window_months: int = BREAK_WINDOW_MONTHS
    min_level: float = MIN_BREAK_LEVEL
    min_change: float = MIN_BREAK_CHANGE
