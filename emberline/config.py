"""Runtime settings with the fallbacks and checks applied to raw setting strings."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, replace

MINUTE_MS = 60_000

# Defaults used when a setting is absent or unusable.
DEFAULT_INTERVAL_S = 300
DEFAULT_RATE_WINDOW_MIN = 15
DEFAULT_RATE_SPAN_MIN = 8
DEFAULT_START_C = 75
DEFAULT_END_C = 50
DEFAULT_END_HOLD_MIN = 45
DEFAULT_ZONE = "America/New_York"
DEFAULT_SITE = "Sensor telemetry"


def positive_or(text: str | None, fallback: float) -> float:
    """A finite number above zero, else the fallback."""
    try:
        number = float((text or "").strip())
    except ValueError:
        return fallback
    return number if math.isfinite(number) and number > 0 else fallback


def hex_identity(text: str | None) -> str | None:
    """Device EUI: hexadecimal digits only, upper case, None when nothing is left."""
    return re.sub(r"[^0-9a-fA-F]", "", text or "").upper() or None


@dataclass(frozen=True)
class RuntimeConfig:
    """Everything the operators need to know about a deployment.

    Times are kept in the unit of their setting; the ``*_ms`` properties turn them into whole
    milliseconds.  Readings carry whole milliseconds too, so ``gap > 750_000.5`` and
    ``gap > 750_000`` select the same rows and flooring (or ceiling, for holds) loses nothing.
    """

    air_channel: int = 1
    heater_channel: int = 2
    expected_interval_s: float = DEFAULT_INTERVAL_S
    rate_window_min: float = DEFAULT_RATE_WINDOW_MIN
    rate_span_min: float = DEFAULT_RATE_SPAN_MIN
    start_c: float = DEFAULT_START_C
    end_c: float = DEFAULT_END_C
    end_hold_min: float = DEFAULT_END_HOLD_MIN
    start_samples: int = 2
    time_zone: str = DEFAULT_ZONE
    site_name: str = DEFAULT_SITE
    application_id: str | None = None
    dev_eui: str | None = None

    def __post_init__(self) -> None:
        if self.air_channel == self.heater_channel:
            raise ValueError("The air and heater channels must be different")
        if self.end_c >= self.start_c:
            raise ValueError("The session end temperature must be below the start temperature")
        if self.start_samples < 1:
            raise ValueError("A session needs at least one start sample")
        object.__setattr__(self, "rate_span_min", min(self.rate_window_min, self.rate_span_min))

    @classmethod
    def from_settings(cls, settings: Mapping[str, str]) -> RuntimeConfig:
        """Build from setting strings, such as an environment or a properties file."""
        def channel(name: str, fallback: int) -> int:
            return {"1": 1, "2": 2}.get(settings.get(name), fallback)

        return cls(
            air_channel=channel("SAUNA_CHANNEL", 1),
            heater_channel=channel("STOVEPIPE_CHANNEL", 2),
            expected_interval_s=positive_or(settings.get("EXPECTED_INTERVAL_SECONDS"), DEFAULT_INTERVAL_S),
            rate_window_min=positive_or(settings.get("RATE_WINDOW_MINUTES"), DEFAULT_RATE_WINDOW_MIN),
            rate_span_min=positive_or(settings.get("RATE_MIN_SPAN_MINUTES"), DEFAULT_RATE_SPAN_MIN),
            start_c=positive_or(settings.get("SESSION_START_PIPE_C"), DEFAULT_START_C),
            end_c=positive_or(settings.get("SESSION_END_PIPE_C"), DEFAULT_END_C),
            end_hold_min=positive_or(settings.get("SESSION_END_HOLD_MINUTES"), DEFAULT_END_HOLD_MIN),
            time_zone=settings.get("REPORT_TIME_ZONE") or DEFAULT_ZONE,
            site_name=settings.get("SITE_NAME") or DEFAULT_SITE,
            application_id=(settings.get("EXPECTED_APPLICATION_ID") or "").strip() or None,
            dev_eui=hex_identity(settings.get("EXPECTED_DEV_EUI")),
        )

    def with_changes(self, **changes: object) -> RuntimeConfig:
        return replace(self, **changes)

    @property
    def interval_ms(self) -> int:
        return math.ceil(self.expected_interval_s * 1_000)

    @property
    def stale_after_s(self) -> float:
        return max(self.expected_interval_s * 4, 1_200)

    @property
    def max_gap_ms(self) -> int:
        return math.floor(self.expected_interval_s * 2_500)

    @property
    def window_ms(self) -> int:
        return max(1, math.floor(self.rate_window_min * MINUTE_MS))

    @property
    def span_ms(self) -> int:
        return math.ceil(self.rate_span_min * MINUTE_MS)

    @property
    def hold_ms(self) -> int:
        return math.ceil(self.end_hold_min * MINUTE_MS)
