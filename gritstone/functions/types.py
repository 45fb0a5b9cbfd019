"""Types of attributes beyond the built-in ones.

A custom type is an alias with a text form whose order is that of its values. Attributes of it are stored as text under
the alias, so equality, ranges and sorting are plain comparisons of strings, and reach the scan like any other.
"""

from __future__ import annotations

import ipaddress
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class CustomType(NamedTuple):
    """``text`` turns a Python value into its text form; ``encode`` and ``decode`` do the same for columns."""

    alias: str
    python: type
    text: Callable[[Any], str]
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


class TypeRegistry:
    """Custom types by alias and by Python class."""

    def __init__(self):
        self._by_alias: dict[str, CustomType] = {}

    def register(self, alias: str, python: type, text: Callable[[Any], str], encode: Callable[[Column], Column], decode: Callable[[Column], Column]) -> CustomType:
        """Add a type; an alias that is taken, by a built-in type too, is refused."""
        if alias in self._by_alias or alias in ("string", "long", "double", "boolean", "timestamp"):
            raise ValueError(f"there is a type {alias} already")
        self._by_alias[alias] = CustomType(alias, python, text, encode, decode)
        return self._by_alias[alias]

    def __getitem__(self, alias: str) -> CustomType:
        return self._by_alias[alias]

    def __contains__(self, alias: str) -> bool:
        return alias in self._by_alias

    def of(self, value: Any) -> CustomType | None:
        """The type of a Python value, if one is registered for its class."""
        return next((t for t in self._by_alias.values() if isinstance(value, t.python)), None)


def _ip_text(address: ipaddress.IPv4Address) -> str:
    return f"{int(address):08x}"


def _ip_encode(dotted: Column) -> Column:
    parts = F.split(dotted, r"\.")
    return F.lower(F.concat(*(F.lpad(F.hex(parts[i].cast("int")), 2, "0") for i in range(4))))


def _ip_decode(text: Column) -> Column:
    return F.concat_ws(".", *(F.conv(F.substring(text, 2 * i + 1, 2), 16, 10) for i in range(4)))


#: The registry that criteria look into.
TYPES = TypeRegistry()
TYPES.register("ipv4", ipaddress.IPv4Address, _ip_text, _ip_encode, _ip_decode)
TYPES.register("uuid", uuid.UUID, str, F.lower, lambda text: text)
