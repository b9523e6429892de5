"""Settings in layers: defaults, a JSON file, environment variables, what the caller gives; and which outputs to keep."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from foliospark.operators.state import merged, needed_outputs

PREFIX = "FOLIOSPARK__"
OUTPUTS = ("sources", "chunks", "index", "keywords", "guide", "quality", "log")
REQUIRES = {"chunks": {"sources"}, "index": {"sources", "chunks"}, "keywords": {"index"}, "guide": {"keywords"}, "quality": {"sources"}}
PURPOSES = {"read": ["sources"], "search": ["chunks", "index"], "agent": ["sources", "chunks", "index", "keywords", "guide"]}
_WORDS = {**dict.fromkeys(("true", "yes", "on"), True), **dict.fromkeys(("false", "no", "off"), False), **dict.fromkeys(("null", "none", "~", ""), None)}


def value_of(text: str) -> Any:
    """What a variable's text means: true or false, nothing, a number, or the text itself."""
    bare = text.strip()
    if bare.lower() in _WORDS:
        return _WORDS[bare.lower()]
    if re.fullmatch(r"[-+]*\d+", bare) and bare.count("+") + bare.count("-") <= 1:
        return int(bare)
    try:
        return float(bare) if "." in bare or "e" in bare.lower() else bare
    except ValueError:
        return bare


def put(settings: dict[str, Any], path: list[str], value: Any) -> dict[str, Any]:
    """Settings with a value at a path."""
    return {**settings, path[0]: value if len(path) == 1 else put(settings.get(path[0]) if isinstance(settings.get(path[0]), dict) else {}, path[1:], value)}


def from_environment(variables: Mapping[str, str]) -> dict[str, Any]:
    """Settings of variables like FOLIOSPARK__limits__most=300; names count in lower case, values as they are."""
    out: dict[str, Any] = {}
    for name, text in sorted(variables.items()):
        path = [p.lower() for p in name[len(PREFIX) :].split("__") if p] if name.upper().startswith(PREFIX) else []
        out = put(out, path, value_of(text)) if path else out
    return out


def dotted(given: dict[str, Any]) -> dict[str, Any]:
    """Settings whose keys may be dotted paths."""
    out: dict[str, Any] = {}
    for key, value in given.items():
        out = merged(out, put({}, key.split("."), value))
    return out


def load(defaults: dict[str, Any], file: str | None = None, variables: Mapping[str, str] | None = None, given: dict[str, Any] | None = None) -> dict[str, Any]:
    """All layers, later ones over earlier ones.  A file that is named must be there."""
    layers = [json.loads(Path(file).read_text("utf-8")) if file else {}, from_environment(variables or {}), dotted(given or {})]
    for layer in layers:
        defaults = merged(defaults, layer)
    return defaults


def outputs_for(outputs: list[str] | None = None, purpose: str | None = None) -> tuple[set[str], set[str]]:
    """Outputs to keep, and those to make for them.  A list goes before a purpose; neither, or ``full``, means all."""
    if outputs is None and purpose not in (None, "full", *PURPOSES):
        raise ValueError(f"unknown purpose {purpose!r}; there are {', '.join([*sorted(PURPOSES), 'full'])}")
    wanted = set(outputs if outputs is not None else OUTPUTS if purpose in (None, "full") else PURPOSES[purpose])
    if wanted - set(OUTPUTS):
        raise ValueError(f"unknown outputs {sorted(wanted - set(OUTPUTS))}; there are {', '.join(OUTPUTS)}")
    return wanted, needed_outputs(wanted, REQUIRES)
