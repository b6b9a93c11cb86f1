"""Prompts from YAML files, rendered for whole tables.

A template's lines hold `{{ name }}`; a line of the form `{% if name %}...{% endif %}` stays only where the value is not
empty. Templates compile to one column expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPLAIN = """An entry of a code index is below, its source first. Write the lines that a developer would search for to find it.
Source:
{{ code }}
{% if calls %}It calls {{ calls }}.{% endif %}
{% if base_classes %}It extends {{ base_classes }}.{% endif %}
{% if methods %}Its methods are {{ methods }}.{% endif %}
{% if parameters %}It takes {{ parameters }}.{% endif %}
{% if docstring %}Its author says: {{ docstring }}{% endif %}
Found in {{ file_path }} as a {{ type }}.
Name: {{ name }}
Give the task it serves in one line, then the words and names that lead to it. Add nothing that is not shown."""

_LINE_IF = re.compile(r"\s*\{%-?\s*if\s+(\w+)\s*-?%\}(.*)\{%-?\s*endif\s*-?%\}\s*")
_VALUE = re.compile(r"\{\{\s*(\w+)\s*\}\}")


@dataclass(frozen=True)
class Prompt:
    id: str
    template: str
    meta: dict = field(default_factory=dict)

    def names(self) -> list[str]:
        return sorted(set(_VALUE.findall(self.template)))

    def render(self, values: dict[str, Column]) -> Column:
        """The prompt as a column. A null or missing value is empty; a line with a false condition is left out."""
        text = lambda n: F.coalesce(values[n].cast("string"), F.lit("")) if n in values else F.lit("")

        def line(s: str) -> Column:
            parts = _VALUE.split(s)
            return F.concat(*(text(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)))

        lines = []
        for s in self.template.split("\n"):
            optional = _LINE_IF.fullmatch(s)
            lines.append(F.when(text(optional[1]) != "", line(optional[2])) if optional else line(s))
        return F.concat_ws("\n", *lines)


class Prompts:
    """Prompts by id; a file needs `id` and `template`, and ids must differ."""

    def __init__(self, folder: str | None = None):
        self.known = {"explain": Prompt("explain", EXPLAIN)}
        for p in sorted(Path(folder).glob("*.yaml")) if folder else ():
            one = self.load(p)
            if one.id in self.known:
                raise ValueError(f"{p}: prompt {one.id!r} is known already")
            self.known[one.id] = one

    @staticmethod
    def load(path: Path) -> Prompt:
        import yaml

        data = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
        if not data.get("id") or not data.get("template"):
            raise ValueError(f"{path}: a prompt needs id and template")
        return Prompt(data["id"], data["template"], data.get("meta") or {})

    def get(self, name: str) -> Prompt:
        if name not in self.known:
            raise KeyError(f"unknown prompt {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name]
