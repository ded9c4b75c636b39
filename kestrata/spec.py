"""Table definitions: validation of names, keys and options, and their defaults."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from .errors import TableError
from .plans.keys import ASCENDING, DESCENDING

# fixed values: limits, accepted option values and error texts of the table interface
MAX_KEY_FIELDS = 100
MAX_NAME = 64
TYPES = ("rocksdb",)
DATA_MODELS = ("kv", "array", "map")
HASHING_METHODS = ("virtual_nodes", "cosistent", "consistent", "uniform", "rendezvous")
TIME_FIELD = "ts"


@dataclass(frozen=True)
class TableSpec:
    name: str
    key: tuple[str, ...]
    type: str = "rocksdb"
    data_model: str = "array"
    comparator: str = DESCENDING
    time_series: bool = False
    hash_exclude: tuple[str, ...] = ()
    hashing_method: str = "uniform"
    num_of_shards: int = 16
    distributed: bool = True
    replication_factor: int = 1
    system_table: bool = False
    ttl: int | None = None
    fifo_ttl: tuple[int, int] | None = None
    clusters: tuple[Any, ...] = ()
    cache_size: int | None = None
    write_buffer_size: int | None = None
    rdb_raw: tuple[Any, ...] = ()
    index_on: dict[str, dict[str, Any]] = field(default_factory=dict)
    columns: tuple[str, ...] = ()

    @property
    def hash_key(self) -> tuple[str, ...]:
        """Key fields that choose the shard; may be empty, then every row is in one shard."""
        out = {*self.hash_exclude, *((TIME_FIELD,) if self.time_series else ())}
        return tuple(k for k in self.key if k not in out)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> TableSpec:
        d = json.loads(text)
        for k in ("key", "hash_exclude", "clusters", "rdb_raw", "columns"):
            d[k] = tuple(d[k])
        d["fifo_ttl"] = tuple(d["fifo_ttl"]) if d["fifo_ttl"] else None
        return cls(**d)

    def altered(self, options: Mapping[str, Any]) -> TableSpec:
        return replace(self, **{k: check_option(k, v) for k, v in options.items()})


def _printable(text: Any) -> bool:
    return isinstance(text, str) and all(c.isprintable() or c in "\t\n\r\v\f\b\x1b" for c in text)


def check_name(name: Any) -> str:
    if not isinstance(name, str):
        raise TableError((name, "not_list"))
    if len(name) > MAX_NAME:
        raise TableError((name, "too_long_name"))
    if any(ord(c) > 255 for c in name):
        raise TableError((name, "non_unicode_name"))
    return name


def check_key(key: Any) -> tuple[str, ...]:
    if isinstance(key, str) or not isinstance(key, Sequence):
        raise TableError((key, "invalid_key"))
    if not key:
        raise TableError((tuple(key), "no_key_field"))
    if len(key) > MAX_KEY_FIELDS:
        raise TableError((tuple(key), "key_too_long"))
    for f in key:
        if not isinstance(f, str):
            raise TableError((tuple(key), "not_list"))
        if not _printable(f):
            raise TableError((tuple(key), "not_printable"))
    if len(set(key)) != len(key):
        raise TableError((tuple(key), "dublicate_key"))
    return tuple(key)


def _whole(v: Any) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


_CHECKS = {
    "type": lambda v: v in TYPES,
    "data_model": lambda v: v in DATA_MODELS,
    "comparator": lambda v: v in (ASCENDING, DESCENDING),
    "time_series": lambda v: isinstance(v, bool),
    "distributed": lambda v: isinstance(v, bool),
    "system_table": lambda v: isinstance(v, bool),
    "hash_exclude": lambda v: isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v) and len(set(v)) == len(v),
    "hashing_method": lambda v: v in HASHING_METHODS,
    "num_of_shards": lambda v: _whole(v) and v > 0,
    "replication_factor": lambda v: _whole(v) and v > 0,
    "clusters": lambda v: isinstance(v, (list, tuple)),
    "ttl": _whole,
    "fifo_ttl": lambda v: isinstance(v, (list, tuple)) and len(v) == 2 and all(map(_whole, v)),
    "cache_size": _whole,
    "write_buffer_size": _whole,
    "rdb_raw": lambda v: isinstance(v, (list, tuple)),
}


def check_option(name: str, value: Any) -> Any:
    if name not in _CHECKS:
        raise TableError((name, "invalid_option"))
    if not _CHECKS[name](value):
        raise TableError(((name, value), "invalid_option"))
    return tuple(value) if isinstance(value, list) else value


def make_spec(name: Any, key: Any, options: Mapping[str, Any] | None = None) -> TableSpec:
    """Validate name, then key, then options; the first failure is raised."""
    name, key = check_name(name), check_key(key)
    return TableSpec(name, key, **{k: check_option(k, v) for k, v in (options or {}).items()})


def check_row_key(spec: TableSpec, key: Mapping[str, Any] | Sequence[tuple[str, Any]]) -> dict[str, Any]:
    """A request's key in the table's field order; any order of fields is accepted."""
    pairs = list(key.items()) if isinstance(key, Mapping) else list(key)
    found = dict(pairs)
    if len(pairs) != len(spec.key) or set(found) != set(spec.key):
        raise TableError("key_mismatch")
    return {k: found[k] for k in spec.key}
