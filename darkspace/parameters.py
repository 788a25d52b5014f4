"""Parameter files: shell assignments, one a line."""

from __future__ import annotations

import re
from collections.abc import Mapping

_LINE = re.compile(r"""^\s*(?:export\s+)?([A-Za-z_]\w*)=("(?:[^"\\]|\\.)*"|'[^']*'|[^\s#]*)\s*(?:#.*)?$""")


class Parameters(Mapping[str, str]):
    """Values by name; $NAME and ${NAME} in a value stand for what was set before (in single quotes for themselves)."""

    def __init__(self, values: Mapping[str, str]):
        self._values = dict(values)

    @classmethod
    def read(cls, path: str, **defaults: str) -> Parameters:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read(), **defaults)

    @classmethod
    def parse(cls, text: str, **defaults: str) -> Parameters:
        values = dict(defaults)
        for number, line in enumerate(text.splitlines(), 1):
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            found = _LINE.match(line)
            if found is None:
                raise ValueError(f"line {number} is no assignment: {line!r}")
            name, raw = found.groups()
            if raw[:1] == "'":
                values[name] = raw[1:-1]
            else:
                raw = raw[1:-1] if raw[:1] == '"' else raw
                values[name] = re.sub(r"\$(?:\{(\w+)\}|(\w+))", lambda m: values.get(m[1] or m[2], ""), raw)
        return cls(values)

    def __getitem__(self, name: str) -> str:
        return self._values[name]

    def __iter__(self):
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def words(self, name: str) -> list[str]:
        """A value's words, such as the names of subnets."""
        return self._values.get(name, "").split()
