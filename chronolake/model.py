"""Points, profiles and connection settings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

from chronolake.errors import InvalidConfig, Unsupported

Value = int | float | str | bool


@dataclass(frozen=True)
class Point:
    """One point to be written. timestamp: an aware datetime, an integer of nanoseconds, or None for the time of writing."""

    measurement: str
    fields: Mapping[str, Value]
    tags: Mapping[str, str] = field(default_factory=dict)
    timestamp: datetime | int | None = None


_COMMON = frozenset({"health", "write"})
_SQL = _COMMON | {"query_sql", "query_sql_stream", "execute_sql", "query_iql", "create_database", "list_databases", "delete_database"}

#: Operations of each profile.
PROFILES: dict[str, frozenset[str]] = {
    "v3_core": _SQL,
    "v3_enterprise": _SQL | {"create_token", "delete_token"},
    "v2": _COMMON | {"query_flux", "create_bucket", "list_buckets", "delete_bucket"},
}


def supports(profile: str, operation: str) -> bool:
    return operation in PROFILES[profile]


def require(profile: str, operation: str) -> None:
    if not supports(profile, operation):
        raise Unsupported(operation, profile)


@dataclass(frozen=True)
class Config:
    """Settings of a named connection; only host is required."""

    host: str
    token: str = ""
    org: str = ""
    database: str | None = None
    port: int = 8086
    scheme: str = "https"
    pool_size: int = 10
    name: str = "default"

    @classmethod
    def validated(cls, **options: object) -> Config:
        unknown = set(options) - set(cls.__dataclass_fields__)
        if unknown:
            raise InvalidConfig(f"unknown options: {', '.join(sorted(unknown))}")
        if not options.get("host"):
            raise InvalidConfig("required option: host")
        for name, kind in (("host", str), ("token", str), ("org", str), ("port", int), ("pool_size", int), ("name", str)):
            if name in options and (not isinstance(options[name], kind) or isinstance(options[name], bool)):
                raise InvalidConfig(f"{name} must be of type {kind.__name__}")
        if options.get("scheme", "https") not in ("http", "https"):
            raise InvalidConfig("scheme must be http or https")
        if options.get("pool_size", 1) < 1 or options.get("port", 1) < 1:
            raise InvalidConfig("pool_size and port must be positive")
        return cls(**options)  # type: ignore[arg-type]

    @property
    def url(self) -> str:
        return f"{self.scheme}://{self.host}:{self.port}"
