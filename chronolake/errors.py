"""Errors of the engine. Those that a server would answer with a status carry status and body."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors that the engine raises on purpose."""


class StatusError(EngineError):
    status = 500

    def __init__(self, body: str):
        super().__init__(f"{self.status}: {body}")
        self.body = body


class BadRequest(StatusError):
    status = 400


class NotFound(StatusError):
    status = 404


class TableNotFound(EngineError):
    def __init__(self, measurement: str):
        super().__init__(f"table not found: {measurement}")
        self.measurement = measurement


class Unsupported(EngineError):
    """The connection's profile does not have the operation."""

    def __init__(self, operation: str, profile: str):
        super().__init__(f"{operation} is not supported by profile {profile}")
        self.operation, self.profile = operation, profile


class DeleteNotSupported(EngineError):
    """DELETE needs the enterprise profile."""


class NoDatabase(EngineError):
    """Neither the call nor the connection names a database."""


class BufferFull(EngineError):
    """A batch writer holds as much as it may."""


class WriterClosed(EngineError):
    """A batch writer was given points after its close()."""


class ConnectionMissing(EngineError):
    """No connection of that name is open."""


class EncodeError(EngineError):
    """A point cannot be written as line protocol; reason is empty_measurement, empty_fields or invalid_timestamp."""

    def __init__(self, reason: str, value: object = None):
        super().__init__(reason if value is None else f"{reason}: {value!r}")
        self.reason, self.value = reason, value


class DecodeError(EngineError):
    """A response body does not parse; kind is json_parse_error, jsonl_parse_error or arrow_parse_error."""

    def __init__(self, kind: str, detail: str):
        super().__init__(f"{kind}: {detail}")
        self.kind = kind


class UnsupportedFormat(EngineError):
    def __init__(self, name: object):
        super().__init__(f"unsupported format: {name!r}")
        self.name = name


class InvalidConfig(EngineError, ValueError):
    """A connection's configuration misses or misuses an option."""
