"""Text steps ahead of parsing: imports, declared parameters and their substitution."""

from __future__ import annotations

import re
from pathlib import Path

from ..types import ScriptError

_IMPORT = re.compile(r"^\s*import\s+'([^']+)'\s*;?[ \t]*$", re.I | re.M)
_DECLARE = re.compile(r"^\s*%(declare|default)\s+(\w+)\s+('[^']*'|\"[^\"]*\"|\S+?)\s*;?[ \t]*$", re.I | re.M)


def parameter_file(path: str) -> dict[str, str]:
    """Lines name=value; empty ones and those that start with # don't count."""
    out = {}
    for line in Path(path).read_text().splitlines():
        if line.strip() and not line.lstrip().startswith("#"):
            key, equals, value = line.partition("=")
            if not equals:
                raise ScriptError(f"{path}: name=value expected, found {line!r}")
            out[key.strip()] = value.strip()
    return out


def imported(source: str, base: Path, seen: tuple[Path, ...] = ()) -> str:
    """The text with each IMPORT replaced by its file, looked up beside the importing one."""

    def one(m: re.Match) -> str:
        path = (base / m[1]).resolve()
        if path in seen:
            raise ScriptError(f"{m[1]} imports itself")
        if not path.exists():
            raise ScriptError(f"no file {m[1]} to import")
        return imported(path.read_text(), path.parent, (*seen, path))

    return _IMPORT.sub(one, source)


def prepared(source: str, params: dict[str, str] | None = None, base: str | Path = ".") -> str:
    source = imported(source, Path(base))
    values = dict(params or {})
    for m in _DECLARE.finditer(source):
        value = m[3][1:-1] if m[3][0] in "'\"" else m[3]
        value = substituted(value, values)
        if m[1].lower() == "declare" and m[2] not in (params or {}):
            values[m[2]] = value
        else:
            values.setdefault(m[2], value)
    return substituted(_DECLARE.sub("", source), values)


def substituted(source: str, values: dict[str, str]) -> str:
    """Each $name that has a value, longest names first; others stay, as macros have such names too."""
    if not values:
        return source
    names = "|".join(sorted(map(re.escape, values), key=len, reverse=True))
    return re.sub(rf"\$(?:\{{({names})\}}|({names})\b)", lambda m: str(values[m[1] or m[2]]), source)
