"""Jobs: a dataset in, the anonymized dataset and a report out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veil.errors import PolicyError
from veil.functions import registry
from veil.operators.materialize import temporary_tables
from veil.plans.anonymize import plan
from veil.policy import Policy
from veil.settings import Settings
from veil.sources.tables import check_format, load_tables, save_tables, table_path

REPORT = "table string, column string, method string, kind string, note string, output string"


def _plans(tables: dict[str, DataFrame], policy: Policy, settings: Settings, row_keys, require_all_tables: bool) -> dict:
    """All tables with their rules written out; nothing is computed."""
    unknown = [t for t in policy.tables if t not in tables]
    if unknown and settings.strict:
        raise PolicyError(f"the policy names unknown tables: {unknown}")
    bare = [t for t in tables if t not in policy.tables]
    if bare and require_all_tables:
        raise PolicyError(f"tables without a policy: {bare}")
    row_keys = row_keys or {}
    return {name: plan(df, policy.table(name), settings, row_keys.get(name), name) for name, df in tables.items()}


def anonymize_tables(
    tables: dict[str, DataFrame],
    policy,
    settings: Settings,
    row_keys: dict[str, list[str]] | None = None,
    require_all_tables: bool = False,
) -> dict[str, DataFrame]:
    """All tables under one salt and key, so equal keys stay equal across tables.

    A table without a policy passes through, unless every table must have one.
    The rules of all tables are written out, and so checked, before any job starts.
    """
    plans = _plans(tables, Policy.of(policy), settings, row_keys, require_all_tables)
    return {name: planned.run() for name, planned in plans.items()}


class _Staging:
    """A folder beside the results, from which all tables move to their places together."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder = f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex}"
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, folder: str) -> bool:
        return self._fs.exists(self._path(folder))

    def _move(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} could not be moved to {target}")

    def publish(self, staged: dict[str, str], final: dict[str, str]) -> None:
        """Move all tables; where a folder stands already it makes room, and comes back if a later move fails."""
        moves: list[tuple[str, str]] = []
        try:
            for name, target in final.items():
                if self.exists(target):
                    aside = f"{self.folder}/old-{name}"
                    self._move(target, aside)
                    moves.append((target, aside))
                self._move(staged[name], target)
                moves.append((staged[name], target))
        except Exception:
            for source, target in reversed(moves):
                self._move(target, source)
            raise

    def discard(self) -> None:
        self._fs.delete(self._path(self.folder), True)


MODES = ("errorifexists", "error", "overwrite")


def run_job(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    policy,
    settings: Settings,
    tables: list[str] | None = None,
    input_format: str | None = None,
    output_format: str = "parquet",
    schemas: dict | None = None,
    row_keys: dict[str, list[str]] | None = None,
    links: list[tuple[str, str]] | None = None,
    require_all_tables: bool = False,
    mode: str = "errorifexists",
) -> DataFrame:
    """Read, anonymize and write all tables; returns what was done to each column.

    Everything that can be wrong with the request is found before any table is
    computed: rules that do not fit their columns, keys that would part, folders
    that exist.  Each table goes to ``<output>/anonymized_<table>``.  All tables
    are written to a folder of their own first and move to their places after the
    last one, so a job that fails leaves none; ``overwrite`` keeps the old ones
    until then.
    """
    output_format = check_format(output_format)
    if mode not in MODES:
        raise PolicyError(f"mode must be one of {list(MODES)}")
    policy = Policy.of(policy)
    source = load_tables(spark, input_path, tables, input_format, schemas)
    policy.check_keys(links or [], {name: df.schema for name, df in source.items()})
    staging = _Staging(spark, output_path)
    final = {name: table_path(output_path, name) for name in source}
    taken = [folder for folder in final.values() if staging.exists(folder)]
    if taken and mode != "overwrite":
        raise FileExistsError(f"already exists: {taken}")
    plans = _plans(source, policy, settings, row_keys, require_all_tables)
    lines = []
    for name, planned in plans.items():
        for rule in planned.rules:
            notes = [rule.note, f"where {rule.where}" if rule.where else ""]
            lines.append((name, rule.column, rule.method.name, rule.method.kind, ", ".join(filter(None, notes)), final[name]))
        if name not in policy.tables:
            lines.append((name, None, None, None, "no policy, passed through", final[name]))
    try:
        with temporary_tables(spark):
            for name, planned in plans.items():
                save_tables({name: planned.run()}, staging.folder, output_format)
        staging.publish({name: table_path(staging.folder, name) for name in final}, final)
    finally:
        staging.discard()
    return spark.createDataFrame(lines, REPORT)


def methods(spark: SparkSession) -> DataFrame:
    """The catalogue of methods."""
    rows = [
        (m.name, m.kind, ", ".join(f"{k}={v!r}" for k, v in m.options.items()), m.streaming, m.deterministic)
        for m in registry.all_methods()
    ]
    schema = "method string, kind string, options string, streaming_safe boolean, deterministic boolean"
    return spark.createDataFrame(rows, schema)
