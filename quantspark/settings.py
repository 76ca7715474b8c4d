"""Named constants, and settings that environment variables QUANTSPARK_<FIELD> override."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, fields

from .errors import InvalidInput

# Fixed values.
TRADING_DAYS = 252
MAX_DAILY_RETURN = 0.50
SPLIT_CHANGE = 0.40
STALE_DAYS = 5
MIN_BARS_FOR_OUTLIERS = 30
MIN_PCA_ROWS = 50
FEATURE_VERSION = 1


@dataclass(frozen=True)
class Settings:
    store_path: str = "quantspark-store"
    batch_size: int = 50
    max_retries: int = 3
    retry_seconds: float = 1.0
    calls_per_second: float = 2.0
    log_level: str = "INFO"
    log_format: str = "pretty"


_current: Settings | None = None


def get_settings() -> Settings:
    global _current
    if _current is None:
        values = {}
        for field in fields(Settings):
            raw = os.environ.get(f"QUANTSPARK_{field.name.upper()}")
            if raw is not None:
                try:
                    values[field.name] = type(field.default)(raw)
                except ValueError as e:
                    raise InvalidInput(f"the setting {field.name} cannot be {raw!r}") from e
        _current = Settings(**values)
    return _current


def reset_settings() -> None:
    global _current
    _current = None


class _JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"level": record.levelname, "logger": record.name, "event": record.getMessage()} | getattr(record, "context", {}), default=str)


def configure_logging(settings: Settings | None = None) -> logging.Logger:
    """The package's logger, as JSON lines or as plain text."""
    settings = settings or get_settings()
    log = logging.getLogger("quantspark")
    log.setLevel(settings.log_level)
    handler = logging.StreamHandler()
    handler.setFormatter(_JsonLines() if settings.log_format == "json" else logging.Formatter("%(levelname)s %(name)s %(message)s"))
    log.handlers[:] = [handler]
    return log
