"""Datasets: several tables below one path, or a single file or folder."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from veil.errors import PolicyError
from veil.sources.records import csv_records

SINGLE_TABLE = "Sheet1"
FORMATS = ("csv", "parquet", "json", "orc")

# Suffixes of codecs that Spark's readers open by themselves.
CODECS = ("gz", "bz2", "zst", "lz4", "snappy", "deflate")


def _plain(name: str) -> str:
    """The file name without the suffix of a codec."""
    stem, _, suffix = name.rpartition(".")
    return stem if stem and suffix.lower() in CODECS else name


@dataclass(frozen=True)
class Entry:
    """One file or folder below a dataset path."""

    path: str
    name: str
    is_dir: bool
    size: int

    @property
    def stem(self) -> str:
        name = _plain(self.name)
        return name.rsplit(".", 1)[0] if "." in name else name

    @property
    def suffix(self) -> str:
        name = _plain(self.name)
        return name.rsplit(".", 1)[1].lower() if "." in name else ""


def _entry(status) -> Entry:
    path = status.getPath()
    return Entry(path.toString(), path.getName(), status.isDirectory(), status.getLen())


def _locate(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _stat(spark: SparkSession, path: str) -> Entry:
    fs, hadoop = _locate(spark, path)
    if not fs.exists(hadoop):
        raise FileNotFoundError(path)
    return _entry(fs.getFileStatus(hadoop))


def _iterate(listing) -> Iterator[Entry]:
    """The visible entries of a listing, one at a time."""
    while listing.hasNext():
        entry = _entry(listing.next())
        if entry.name[0] not in "._":
            yield entry


def _children(spark: SparkSession, path: str) -> list[Entry]:
    fs, hadoop = _locate(spark, path)
    return sorted(_iterate(fs.listStatusIterator(hadoop)), key=lambda e: e.name)


def check_format(name: str) -> str:
    """The format's plain name; anything else is an error."""
    plain = name.lower().lstrip(".")
    if plain not in FORMATS:
        raise ValueError(f"unsupported file type: {name}")
    return plain


def _format_of(spark: SparkSession, entry: Entry) -> str:
    """By the suffix of the file, or of the first data file found in the folder."""
    if entry.suffix in FORMATS or not entry.is_dir:
        return check_format(entry.suffix)
    fs, hadoop = _locate(spark, entry.path)
    for file in _iterate(fs.listFiles(hadoop, True)):
        if file.suffix in FORMATS:
            return file.suffix
    raise ValueError(f"unsupported file type in {entry.path}")


def _check_lines(spark: SparkSession, path: str) -> None:
    """A line with an odd number of quotes begins or ends a record of several lines."""
    quotes = F.length(F.regexp_replace("value", '[^"]', ""))
    if not spark.read.text(path).filter(quotes % 2 == 1).isEmpty():
        raise ValueError(f"{path} has quoted line breaks: read it with quoted_line_breaks=True")


#: Reader options under which a line break is not all that matters for the records of a file.
_WHOLE_FILE = ("comment", "encoding", "charset", "lineSep", "escape")


def _split_csv(spark: SparkSession, entry: Entry, reader, schema, infer: bool, options: dict) -> DataFrame | None:
    """A CSV file or folder read in blocks that may begin within a record; None where that is not possible."""
    if any(o.lower() in map(str.lower, options) for o in _WHOLE_FILE if options.get(o) != "\n"):
        return None
    header = str(options.get("header", True)).lower() == "true"
    records = csv_records(spark, entry.path, options.get("quote", '"'), header)
    if records is None:
        return None
    names = None
    if schema is None:
        names = spark.read.options(**{**_CSV, **options}).csv(entry.path).columns
        if not infer or records.isEmpty():
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = reader.options(**options).options(header=False, lineSep="\n", inferSchema=schema is None)
    if schema is not None:
        reader = reader.schema(schema)
    texts = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    out = DataFrame(reader._jreader.csv(texts), spark)
    return out if schema is not None else out.toDF(*names)


_CSV = {"header": True, "escape": '"', "multiLine": True, "columnPruning": False, "mode": "FAILFAST"}


def _read(spark: SparkSession, entry: Entry, fmt: str, schema, infer: bool, breaks: bool, options: dict,
          split: bool = True) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None and not isinstance(schema, T.StructType):
        schema = T.StructType.fromDDL(str(schema))
    if fmt == "csv":
        if not breaks:
            _check_lines(spark, entry.path)
        reader = reader.options(**{**_CSV, "multiLine": breaks})
        if breaks and split:
            found = _split_csv(spark, entry, reader, schema, infer, options)
            if found is not None:
                return found
        reader = reader if schema is not None else reader.option("inferSchema", infer)
    reader = reader.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(entry.path)


def _chosen(spark: SparkSession, path: str, tables, fmt, schemas: dict) -> dict[str, tuple[Entry, str]]:
    """The files or folders of the asked tables and their formats."""
    root = _stat(spark, path)
    if not root.is_dir or root.suffix in FORMATS:
        found = {SINGLE_TABLE: root}
    else:
        found = {e.stem: e for e in _children(spark, root.path)}
        if found and all(not e.is_dir and e.name.startswith("part-") for e in found.values()):
            found = {SINGLE_TABLE: root}
    unknown = [t for t in [*(tables or []), *schemas] if t not in found]
    if unknown:
        raise PolicyError(f"no such tables: {unknown}")
    return {t: (found[t], check_format(fmt) if fmt else _format_of(spark, found[t])) for t in (tables or found)}


def load_tables(
    spark: SparkSession,
    path: str,
    tables: list[str] | None = None,
    fmt: str | None = None,
    schemas: dict | None = None,
    quoted_line_breaks: bool = True,
    infer_types: bool = True,
    **options,
) -> dict[str, DataFrame]:
    """Tables by name.

    A file, or a folder named like a file, is a dataset of the one table
    ``Sheet1``.  In any other folder each file or folder is a table.  Name a
    schema for tables with identifiers: inference turns ``01234`` into a number
    and reads the file once more; without ``infer_types`` all columns are text.

    A CSV record with too few or too many fields ends the job, at any size.  Values
    may hold quoted line breaks: files are split all the same, after a pass that
    counts their quotes.  Files in partition folders, and files read with their
    own comments, encoding, escapes or line ends, are one task each.  Without
    ``quoted_line_breaks`` that pass only checks them, and a file that has such a
    value is an error.
    """
    schemas = schemas or {}
    return {t: _read(spark, e, kind, schemas.get(t), infer_types, quoted_line_breaks, options)
            for t, (e, kind) in _chosen(spark, path, tables, fmt, schemas).items()}


def list_columns(
    spark: SparkSession, path: str, tables: list[str] | None = None, fmt: str | None = None
) -> dict[str, list[tuple[str, str]]]:
    """The columns and types of each table, to choose methods for; of a CSV only the header is read."""
    found = _chosen(spark, path, tables, fmt, {})
    return {t: _read(spark, e, kind, None, False, True, {}, split=False).dtypes for t, (e, kind) in found.items()}


def table_path(root: str, table: str, prefix: str = "anonymized_") -> str:
    return f"{root.rstrip('/')}/{prefix}{table}"


def save_tables(
    tables: dict[str, DataFrame],
    root: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    prefix: str = "anonymized_",
    partition_by: dict[str, list[str]] | None = None,
) -> dict[str, str]:
    """Write every table to its own folder; returns the folders."""
    fmt = check_format(fmt)
    paths = {}
    for name, df in tables.items():
        writer = df.write.format(fmt).mode(mode)
        if fmt == "csv":
            # Blanks and line breaks at the ends of a value are part of it.
            writer = writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False,
                                    ignoreTrailingWhiteSpace=False)
        by = (partition_by or {}).get(name)
        writer = writer.partitionBy(*by) if by else writer
        paths[name] = table_path(root, name, prefix)
        writer.save(paths[name])
    return paths
