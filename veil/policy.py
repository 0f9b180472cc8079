"""The policy: which method each column of each table gets."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession, types as T

from veil.errors import PolicyError
from veil.functions import registry
from veil.functions.registry import Method

PASS_THROUGH = "none"


@dataclass(frozen=True)
class ColumnRule:
    """One column's method and options, in the short or the long written form."""

    method: str
    options: dict = field(default_factory=dict)
    where: str = ""

    @classmethod
    def of(cls, written) -> ColumnRule:
        if isinstance(written, ColumnRule):
            return written
        if isinstance(written, str):
            return cls(registry.normal_name(written))
        if isinstance(written, Mapping):
            options = written.get("options") or {}
            method = written.get("method", registry.FALLBACK)
            where = written.get("where") or ""
            if not isinstance(method, str) or not isinstance(options, Mapping) or not isinstance(where, str):
                raise PolicyError(f"not a column rule: {written!r}")
            return cls(registry.normal_name(method), dict(options), where)
        raise PolicyError(f"not a column rule: {written!r}")


@dataclass(frozen=True)
class ResolvedRule:
    """A rule that fits a column of a known type."""

    column: str
    dtype: T.DataType
    method: Method
    options: dict
    note: str = ""
    where: str = ""


@dataclass(frozen=True)
class TablePolicy:
    """The column rules of one table; columns without a rule pass through."""

    rules: dict[str, ColumnRule] = field(default_factory=dict)

    @classmethod
    def of(cls, written) -> TablePolicy:
        if isinstance(written, TablePolicy):
            return written
        if not isinstance(written, Mapping):
            raise PolicyError(f"not a table policy: {written!r}")
        return cls({str(c): ColumnRule.of(r) for c, r in written.items()})

    def resolve(self, schema: T.StructType, strict: bool = True) -> list[ResolvedRule]:
        """Match the rules with the columns; raises where a rule cannot hold.

        A name that is no known method becomes ``hash``, the safe direction.
        """
        types = {f.name: f.dataType for f in schema.fields}
        rules = {_same_name(c, types): rule for c, rule in self.rules.items()}
        if len(rules) < len(self.rules):
            raise PolicyError("two rules for one column")
        missing = [c for c in rules if c not in types]
        if missing and strict:
            raise PolicyError(f"no such columns: {missing}")
        resolved = []
        for column, rule in rules.items():
            if column in missing or rule.method == PASS_THROUGH:
                continue
            method, note, options = registry.find(rule.method), "", rule.options
            if method is None:
                method, options = registry.find(registry.FALLBACK), {}
                note = f"unknown method {rule.method!r}, column was hashed"
            options = method.complete(options, strict)
            if rule.where and method.kind == registry.DROP:
                raise PolicyError(f"{column}: a column cannot be removed from some rows only")
            resolved.append(ResolvedRule(column, types[column], method, options, note, rule.where))
        return resolved


def _same_name(name: str, columns) -> str:
    """The column that Spark takes the name for: the same in another case too, unless the session tells them apart."""
    session = SparkSession.getActiveSession()
    apart = session is not None and session.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    if name in columns or apart:
        return name
    return next((c for c in columns if c.lower() == name.lower()), name)


def _text_kind(schemas: dict[str, T.StructType], end: str) -> str:
    """Types whose equal values have equal texts get the same name."""
    table, _, column = end.rpartition(".")
    if table not in schemas:
        return ""  # not among the tables of this job
    names = schemas[table].fieldNames()
    column = _same_name(column, names)
    if column not in names:
        raise PolicyError(f"no such column: {end}")
    dtype = schemas[table][column].dataType
    for name, kind in (("whole number", T.IntegralType), ("text", (T.StringType, T.CharType, T.VarcharType)),
                       ("time", (T.TimestampType, T.TimestampNTZType))):
        if isinstance(dtype, kind):
            return name
    if isinstance(dtype, T.DecimalType):
        return f"decimal of {dtype.scale} places"
    return dtype.simpleString()


@dataclass(frozen=True)
class Policy:
    """Table policies by table name."""

    tables: dict[str, TablePolicy]

    @classmethod
    def of(cls, written) -> Policy:
        """From a mapping or JSON text; bad JSON and an empty policy are errors."""
        if isinstance(written, Policy):
            return written
        if isinstance(written, str):
            try:
                written = json.loads(written)
            except json.JSONDecodeError as e:
                raise PolicyError(f"the policy is not valid JSON: {e}") from e
        if not isinstance(written, Mapping):
            raise PolicyError("the policy must be an object of tables")
        if not written:
            raise PolicyError("the policy is empty")
        return cls({str(t): TablePolicy.of(p) for t, p in written.items()})

    def table(self, name: str) -> TablePolicy:
        return self.tables.get(name, TablePolicy())

    def check_keys(self, links: list[tuple[str, str]], schemas: dict[str, T.StructType] | None = None) -> None:
        """Both ends of each declared key must keep equal values equal.

        A link is a pair of ``table.column`` names.  Both ends need the same
        deterministic row method with the same options, or no rule at all.  With
        schemas, both columns must exist, and if they are digested their types
        must have the same text forms: 1 and 1.0 are equal but digest differently.
        """
        for left, right in links:
            ends = []
            kinds = [_text_kind(schemas, end) for end in (left, right)] if schemas is not None else []
            for end in (left, right):
                table, _, column = end.rpartition(".")
                rule = self.table(table).rules.get(column, ColumnRule(PASS_THROUGH))
                method = registry.find(rule.method)
                if rule.method == PASS_THROUGH:
                    ends.append((PASS_THROUGH, {}))
                    continue
                method = method or registry.find(registry.FALLBACK)
                if rule.where:
                    raise PolicyError(f"{end}: a rule for some rows does not keep the key {left} = {right}")
                if method.kind != registry.ROW or not (method.deterministic or rule.options.get("consistent")):
                    raise PolicyError(f"{end}: {method.name} does not keep the key {left} = {right}")
                ends.append((method.name, method.complete(rule.options, True)))
            if ends[0] != ends[1]:
                raise PolicyError(f"{left} and {right} need the same method and options")
            if len(set(kinds)) > 1 and ends[0][0] != PASS_THROUGH and ends[0][1].get("scale") is None:
                raise PolicyError(f"{left} and {right} have types with different texts: {kinds}")
