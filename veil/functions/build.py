"""What a row method may use while it writes its column expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F, types as T

from veil.functions.canonical import canon
from veil.functions.keyed import Secrets
from veil.settings import Settings

REDACTED = "[REDACTED]"
SUPPRESSED = "[SUPPRESSED]"


@dataclass
class Build:
    """Collects the helper columns of one projection.

    An expression that is used more than once is bound to a helper column in an
    earlier projection, so a digest is computed once per row however often the
    final expression refers to it.
    """

    secrets: Secrets
    settings: Settings
    row_key: list[Column] = field(default_factory=list)
    table: str = ""
    stages: list[dict[str, Column]] = field(default_factory=lambda: [{}, {}, {}])

    def bind(self, expression: Column, stage: int = 0) -> Column:
        taken = sum(len(s) for s in self.stages)
        name = f"__veil_{taken}"
        self.stages[stage][name] = expression
        return F.col(name)

    def draw(self, column: str) -> Column:
        tag = f"{self.table}.{column}" if self.table else column
        return self.bind(self.secrets.draw(tag, self.row_key))

    def text(self, c: Column, dtype: T.DataType, options: dict) -> Column:
        """Canonical text; a null becomes ``nan`` where nulls are literal."""
        out = canon(c, dtype, options.get("scale"))
        nulls = options.get("nulls") or ("literal" if self.settings.parity else "keep")
        return F.coalesce(out, F.lit("nan")) if nulls == "literal" else out

    def lenient(self, options: dict, name: str = "on_error") -> bool:
        """Whether unreadable values stay instead of being redacted."""
        choice = options.get(name) or ("keep" if self.settings.parity else "redact")
        return choice == "keep"
