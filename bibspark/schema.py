"""Schemas of the tables, and the engine's settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from pyspark.sql import types as T

_TEXT, _TEXTS, _INT, _LONG, _BOOL = T.StringType(), T.ArrayType(T.StringType()), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


def _all(names: str, kind: T.DataType) -> list[tuple[str, T.DataType]]:
    return [(name, kind) for name in names.split()]


#: A catalogue record: every leaf is a list of strings.
RECORD = _struct(
    ("record_id", _TEXT),
    *_all("title creator contributor creationdate publisher type source description subject", _TEXTS),
    *_all("isbn issn doi volume issue spage epage pages jtitle au ad_date s_creator s_creationdate", _TEXTS),
    *_all("linktohtml linktopdf linktorsrc openaccess openurl availability", _TEXTS),
    ("holding", T.ArrayType(_struct(*_all("libraryCode subLocationCode callNumber", _TEXT)))),
    ("is_course", _BOOL),
)
METADATA = _struct(
    ("title", _TEXT),
    *_all("authors creators contributors", _TEXTS),
    *_all("date publisher type source isbn issn doi volume issue spage epage pages record_id", _TEXT),
    ("is_cdi", _BOOL),
    ("resource_type", _TEXT),
)
ITEM = _struct(
    *_all("key item_type title", _TEXT),
    ("creators", T.ArrayType(_struct(*_all("creatorType lastName firstName name", _TEXT)))),
    *_all("date doi isbn issn volume issue pages publication_title publisher extra", _TEXT),
    *_all("collections tags", _TEXTS),
    ("num_children", _INT),
)
COLLECTION = _struct(*_all("key name parent_key", _TEXT), ("num_items", _INT))
ATTACHMENT = _struct(*_all("key parent_key item_type content_type", _TEXT))
EVENT = _struct(("event_id", _LONG), ("ts", T.TimestampType()), *_all("key tier", _TEXT), ("success", _BOOL), ("latency", T.DoubleType()))
#: Levels of a log.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


@dataclass
class Settings:
    """Limits and flags; `checked` lists what is wrong with them."""

    search_cap: int = 50
    export_cap: int = 100
    batch_cap: int = 20
    isbn_limit: int = 5
    query_length: int = 1000
    query_operators: int = 30
    text_chars: int = 100_000
    session_budget: int = 15
    hour_budget: int = 20
    key_budget: int = 5
    window_seconds: int = 3600
    cache_ttl_seconds: int = 300
    cache_entries: int = 100
    cache_mb: int = 50
    recent_records: int = 500
    history_kept: int = 100
    history_shown: int = 50
    breaker_failures: int = 5
    breaker_timeout: float = 60.0
    retry_base: float = 1.0
    retry_max: float = 30.0
    auth_timeout: float = 30.0
    search_timeout: float = 30.0
    max_retries: int = 3
    refresh_buffer: int = 60
    log_level: str = "INFO"
    user_name: str = ""
    password: str = ""
    second_factor: str = ""
    items_key: str = ""
    items_user: str = ""
    trace_prefix: str = "Record-ID"
    proxy_base: str = "proxy.example.org"
    flags: dict[str, bool] = field(default_factory=lambda: {"rerank": True, "fusion": True, "enrich": True, "duplicates": True})

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "BIBSPARK_") -> Settings:
        """Defaults, overridden by environment values of the fields' types; FLAG_<name> sets a flag."""
        env = dict(os.environ if env is None else env)
        out = cls()
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None and f.name != "flags":
                setattr(out, f.name, type(getattr(out, f.name))(raw))
        for name in out.flags:
            raw = env.get(f"{prefix}FLAG_{name.upper()}")
            if raw is not None:
                out.flags[name] = raw.strip().lower() in ("1", "true", "yes", "on")
        return out

    def checked(self) -> list[str]:
        """What is wrong with the numbers, the level and the limits among each other."""
        zero = ("max_retries", "refresh_buffer", "cache_ttl_seconds")  # may be zero
        wrong = []
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                if f.name in zero and v < 0:
                    wrong.append(f"{f.name} must not be negative")
                elif f.name.endswith("_timeout") and v < 1:
                    wrong.append(f"{f.name} must be 1 at least")
                elif f.name not in zero and v <= 0:
                    wrong.append(f"{f.name} must be positive")
        if self.log_level.upper() not in LEVELS:
            wrong.append(f"log_level {self.log_level} is unknown")
        if self.key_budget > self.hour_budget:
            wrong.append("key_budget is above hour_budget")
        if self.session_budget < self.key_budget:
            wrong.append("session_budget is below key_budget")
        if self.retry_base > self.retry_max:
            wrong.append("retry_base is above retry_max")
        if not self.trace_prefix.strip():
            wrong.append("trace_prefix is blank")
        return wrong

    def credentials(self) -> list[str]:
        """Credentials for remote services that are not set. The engine needs none; tools that call services do."""
        return [f"{name} is empty" for name in ("user_name", "password", "second_factor", "items_key", "items_user") if not getattr(self, name)]


def read_env_file(text: str) -> dict[str, str]:
    """Lines of key=value; blank lines and comments are skipped, quotes around values dropped."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        key, eq, value = line.strip().partition("=")
        if eq and key and not key.startswith("#"):
            value = value.strip()
            out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out
