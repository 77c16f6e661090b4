"""Settings from an environment-like mapping: a value that can't be read gives the default and a
warning."""

from __future__ import annotations

import dataclasses
import warnings
from collections.abc import Mapping
from typing import TypeVar

T = TypeVar("T")


def from_mapping(kind: type[T], values: Mapping[str, str], prefix: str = "") -> T:
    """``kind``, a dataclass with defaults, from ``PREFIX_FIELD`` entries."""
    found = {}
    for f in dataclasses.fields(kind):
        name = f"{prefix}{f.name}".upper()
        if name not in values:
            continue
        default = f.default
        try:
            text = values[name].strip()
            if isinstance(default, bool):
                if text.lower() not in ("true", "1", "yes", "false", "0", "no"):
                    raise ValueError(text)
                found[f.name] = text.lower() in ("true", "1", "yes")
            else:
                found[f.name] = type(default)(text)
        except (TypeError, ValueError):
            warnings.warn(f"{name}={values[name]!r} can't be read; {default!r} is used", stacklevel=2)
    return kind(**found)
