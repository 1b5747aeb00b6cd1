"""Declarative routes of sources: how their paths are made. No code and no patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = re.compile(r"\{([a-z]+)\}")


@dataclass(frozen=True)
class Profile:
    """origin: scheme and host; path: a template of one placeholder, such as ``/poem/{slug}.html``."""

    origin: str
    path: str

    def __post_init__(self):
        if not re.fullmatch(r"https://[a-z0-9.-]+", self.origin):
            raise ValueError(f"no origin: {self.origin}")
        if len(PLACEHOLDER.findall(self.path)) != 1 or not self.path.startswith("/") or re.search(r"[?#\s\\]", self.path) or re.search(r"[{}]", PLACEHOLDER.sub("", self.path)):
            raise ValueError(f"no path template: {self.path}")

    def parts(self) -> tuple[str, str]:
        """What stands before and after the placeholder."""
        before, _, after = PLACEHOLDER.split(self.path)
        return before, after

    def parse(self, path: Column) -> Column:
        """What the placeholder stands for in ``path``: one segment without query and fragment; null if the path is another."""
        before, after = self.parts()
        # by position: the template is no pattern
        middle = F.substr(path, F.lit(len(before) + 1), F.greatest(F.length(path) - len(before) - len(after), F.lit(0)))
        return F.when(path.startswith(before) & path.endswith(after) & (F.length(path) > len(before) + len(after)) & ~middle.rlike("[/?#]"), middle)

    def render(self, value: Column) -> Column:
        before, after = self.parts()
        return F.concat(F.lit(self.origin + before), value, F.lit(after))
