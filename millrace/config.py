"""Typed settings from a TOML file, a .env file and the environment.

Values given in code win, then environment variables, then `.env`, then files of secrets (one value per file, named
like the variable), then the TOML file. Nested values are named with `__`, as in INPUT__TOPIC__NAME. Unknown values are
ignored; unions of sinks are told apart by `type`. The file is `settings.toml` or what SETTINGS_FILE names, looked up
when settings are loaded.
"""

from __future__ import annotations

import dataclasses
import json
import os
import tomllib
import types
import typing
from dataclasses import dataclass, field
from pathlib import Path
from typing import Literal


@dataclass(frozen=True)
class KafkaConnection:
    broker: str
    options: dict[str, str] = field(default_factory=dict)  # passed on as kafka.<name>, for security settings and the like


@dataclass(frozen=True)
class KafkaTopic:
    name: str
    schema: dict[str, str] = field(default_factory=dict)
    format: Literal["json", "arrow-batch"] = "json"
    key_column: str | None = None


@dataclass(frozen=True)
class KafkaConsumer:
    group_id: str
    batch_size: int = 1000
    batch_timeout_sec: int = 5
    auto_offset_reset: str = "latest"
    #: False: offsets that the broker can't serve any more are skipped instead of failing the query.
    fail_on_data_loss: bool = True


@dataclass(frozen=True)
class KafkaInput:
    connection: KafkaConnection
    topic: KafkaTopic
    consumer: KafkaConsumer
    type: Literal["kafka"] = "kafka"


@dataclass(frozen=True)
class KafkaOutput:
    connection: KafkaConnection
    topic: KafkaTopic
    type: Literal["kafka"] = "kafka"


@dataclass(frozen=True)
class ClickHouseConnection:
    host: str = "localhost"
    port: int = 9000
    user: str = "default"
    password: str = ""
    secure: bool = False


@dataclass(frozen=True)
class ClickHouseTable:
    name: str
    database: str = "default"


@dataclass(frozen=True)
class ClickHouseOutput:
    connection: ClickHouseConnection
    table: ClickHouseTable
    dlq_split_factor: int = 10
    type: Literal["clickhouse"] = "clickhouse"

    def __post_init__(self):
        if self.dlq_split_factor < 2:
            raise ValueError("dlq_split_factor must be 2 or more")


@dataclass(frozen=True)
class FileInput:
    """A folder of messages (columns key and value) as Parquet, text or JSON lines; for replays and tests."""

    path: str
    topic: KafkaTopic
    format: Literal["parquet", "text"] = "text"
    files_per_batch: int = 1
    type: Literal["files"] = "files"


@dataclass(frozen=True)
class FileOutput:
    path: str
    topic: KafkaTopic
    type: Literal["files"] = "files"


InputSettings = KafkaInput | FileInput
OutputSettings = KafkaOutput | ClickHouseOutput | FileOutput


@dataclass(frozen=True)
class Dedup:
    field: str
    window_hours: int = 3
    bucket_hours: int = 1
    store_dir: str = "./dedup_store"  # the checkpoint folder, which holds the state

    def __post_init__(self):
        if self.window_hours <= 0 or self.bucket_hours <= 0:
            raise ValueError("must be a positive number of hours")


@dataclass(frozen=True)
class ElApp:
    input: InputSettings
    output: OutputSettings
    dlq: OutputSettings | None = None
    checkpoint: str = "./el_checkpoint"


@dataclass(frozen=True)
class DedupApp:
    input: InputSettings
    output: OutputSettings
    dedup: Dedup
    dlq: OutputSettings | None = None


def build(kind, value, at: str = "settings"):
    """`value` (from TOML, JSON or text) as `kind`; errors say where."""
    origin = typing.get_origin(kind)
    if origin in (typing.Union, types.UnionType):
        options = [k for k in typing.get_args(kind) if k is not type(None)]
        if value is None and len(options) < len(typing.get_args(kind)):
            return None
        if len(options) == 1:
            return build(options[0], value, at)
        if not isinstance(value, dict):
            raise ValueError(f"{at}: must be a table")
        known = {typing.get_args(typing.get_type_hints(k)["type"])[0]: k for k in options}
        name = value.get("type", "kafka" if "kafka" in known and at.endswith("input") else None)
        if name not in known:
            raise ValueError(f"{at}: type {name!r} is none of {', '.join(known)}")
        return build(known[name], value, at)
    if origin is Literal:
        if value not in typing.get_args(kind):
            raise ValueError(f"{at}: {value!r} is none of {', '.join(typing.get_args(kind))}")
        return value
    if origin is dict:
        return {str(k): str(v) for k, v in value.items()}
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise ValueError(f"{at}: must be a table")
        hints, made = typing.get_type_hints(kind), {}
        for f in dataclasses.fields(kind):
            if f.name in value:
                made[f.name] = build(hints[f.name], value[f.name], f"{at}.{f.name}")
            elif f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                inner = hints[f.name]
                if not dataclasses.is_dataclass(inner):
                    raise ValueError(f"{at}.{f.name}: missing")
                made[f.name] = build(inner, {}, f"{at}.{f.name}")
        return kind(**made)
    if kind is bool:
        if isinstance(value, bool):
            return value
        if str(value).lower() in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            return str(value).lower() in ("1", "true", "yes", "on")
        raise ValueError(f"{at}: {value!r} is no truth value")
    if kind is int and not isinstance(value, bool):
        try:
            return int(value)
        except (TypeError, ValueError):
            raise ValueError(f"{at}: {value!r} is no whole number") from None
    if kind is str and isinstance(value, str):
        return value
    raise ValueError(f"{at}: {value!r} is no {getattr(kind, '__name__', kind)}")


def _merge(low: dict, high: dict) -> dict:
    return {k: _merge(low[k], high[k]) if isinstance(low.get(k), dict) and isinstance(high.get(k), dict) else high.get(k, low.get(k)) for k in {**low, **high}}


def _nested(flat: dict[str, str], names: set[str]) -> dict:
    out: dict = {}
    for name, value in flat.items():
        path = name.lower().split("__")
        if path[0] not in names:
            continue
        spot = out
        for part in path[:-1]:
            spot = spot.setdefault(part, {}) if isinstance(spot.get(part, {}), dict) else {}
        if isinstance(value, str) and value[:1] in "{[":
            try:
                value = json.loads(value)
            except ValueError:
                pass
        spot[path[-1]] = value
    return out


def _dotenv(path: Path) -> dict[str, str]:
    lines = path.read_text().splitlines() if path.is_file() else []
    pairs = [line.removeprefix("export ").split("=", 1) for line in map(str.strip, lines) if line and line[0] != "#" and "=" in line]
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs}


def load(kind: type, *, file: str | None = None, environ: dict[str, str] | None = None, dotenv: str = ".env", secrets: str | None = None, **given):
    """Settings of `kind` (ElApp or DedupApp) from all sources."""
    environ = dict(os.environ) if environ is None else environ
    path = Path(file or environ.get("SETTINGS_FILE", "settings.toml"))
    names = {f.name for f in dataclasses.fields(kind)}
    merged = tomllib.loads(path.read_text()) if path.is_file() else {}
    kept = {p.name: p.read_text().strip() for p in Path(secrets).iterdir() if p.is_file()} if secrets else {}
    for source in (_nested(kept, names), _nested(_dotenv(Path(dotenv)), names), _nested(environ, names), given):
        merged = _merge(merged, source)
    return build(kind, merged)
