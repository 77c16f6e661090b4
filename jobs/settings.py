"""A job's settings: its config file, overruled by the command line."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import fields


def from_command_line(kind: type, argv: list[str] | None, description: str):
    """``--config FILE`` and one option for each field of ``kind``; the config lies on the driver."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", help="JSON file with the settings")
    for f in fields(kind):
        parser.add_argument("--" + f.name.replace("_", "-"), dest=f.name)
    given = {k: v for k, v in vars(parser.parse_args(argv)).items() if v is not None}
    path, held = given.pop("config", None), {}
    if path:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
    unknown = set(held) - {f.name for f in fields(kind)}
    if unknown:
        parser.error(f"unknown settings: {', '.join(sorted(unknown))}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    casts = {"int": int, "float": float}
    return kind(**{f.name: casts.get(str(f.type), lambda v: v)(v) for f in fields(kind) for v in [given.get(f.name, held.get(f.name))] if v is not None})
