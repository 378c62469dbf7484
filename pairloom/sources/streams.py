"""Small objects (parameters, summaries) in files: plain text, JSON, or YAML where a library for it is installed."""

from __future__ import annotations

import json
from typing import Any

from pairloom.sources.stores import file_system

FORMATS = ("plain", "json", "yaml")


def _yaml() -> Any:
    try:
        import yaml
    except ImportError:
        raise OSError("no YAML library is installed") from None
    return yaml


def write_object(data: Any, path: str, fmt: str = "plain") -> None:
    """An object to a file of its own, in any store."""
    if fmt == "plain":
        text = f"{data}\n"
    elif fmt == "json":
        text = json.dumps(data, indent=1, ensure_ascii=False)
    elif fmt == "yaml":
        text = _yaml().safe_dump(data, default_flow_style=False)
    else:
        raise RuntimeError(f"{fmt} is no known format: {', '.join(FORMATS)}")
    system, own = file_system(path)
    with system.open_output_stream(own, compression=None) as stream:
        stream.write(text.encode())


def read_object(path: str, fmt: str = "yaml") -> Any:
    if fmt not in ("json", "yaml"):
        raise RuntimeError(f"{fmt} can't be read back: json or yaml can")
    system, own = file_system(path)
    with system.open_input_stream(own, compression=None) as stream:
        text = stream.read().decode()
    return json.loads(text) if fmt == "json" else _yaml().safe_load(text)
