"""A catalog as a Spark data source: schemas, tables, columns, views, volumes and functions, one partition for each schema.

    spark.dataSource.register(CatalogSource)
    spark.read.format("marlgrid_catalog").option("client", "package.module:factory").option("source", "...").load()

The factory is called with the option `source` and returns a client: catalogs(), schemas(catalog), and objects(catalog, schema), which yields Items.  The driver
lists schemas only; each task asks its own client for one schema's objects.  FolderCatalog, the default, takes folders of Parquet files on a disk that all
machines mount.  ListedCatalog takes what told_tables() saw of a folder in any store that Spark reads.  A client may have holds(catalog, schema): catalogs and schemas
that the options name are then asked for one by one, and what lies beside them isn't listed.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "catalog string, schema string, kind string, name string, place int, column string, type string, digest string"


@dataclass(frozen=True)
class Item:
    """kind: table, column, view, volume or function; place, column and type of a column; type of a function's language; the digest of a view's or function's text."""

    kind: str
    name: str
    place: int | None = None
    column: str | None = None
    type: str | None = None
    digest: str | None = None


class Client(Protocol):
    def catalogs(self) -> list[str]: ...
    def schemas(self, catalog: str) -> list[str]: ...
    def objects(self, catalog: str, schema: str) -> Iterator[Item]: ...


def spark_type(t: pa.DataType) -> str:
    """The name that Spark gives a Parquet column's type."""
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"array<{spark_type(t.value_type)}>"
    if pa.types.is_struct(t):
        return f"struct<{','.join(f'{f.name}:{spark_type(f.type)}' for f in t)}>"
    if pa.types.is_map(t):
        return f"map<{spark_type(t.key_type)},{spark_type(t.item_type)}>"
    if pa.types.is_timestamp(t):
        return "timestamp" if t.tz else "timestamp_ntz"
    if pa.types.is_decimal(t):
        return f"decimal({t.precision},{t.scale})"
    # fixed values: plain types by both names
    plain = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float": "float", "double": "double", "string": "string", "large_string": "string", "binary": "binary", "bool": "boolean", "date32[day]": "date"}
    return plain.get(str(t), str(t))


class FolderCatalog:
    """A folder of catalogs of schemas: `x.parquet` (a file or a folder of files) is a table, `x.sql` a view's text, `x.py` a function's, any other folder a volume."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def _folders(self, path: str) -> list[str]:
        return sorted(e.name for e in os.scandir(path) if e.is_dir() and not e.name.startswith((".", "_")) and not e.name.endswith(".parquet"))

    def catalogs(self) -> list[str]:
        return self._folders(self.root)

    def schemas(self, catalog: str) -> list[str]:
        return self._folders(f"{self.root}/{catalog}")

    def holds(self, catalog: str, schema: str | None = None) -> bool:
        """Whether it has the catalog or schema, by the rules of the listing; the folders above need not be readable."""
        names = [n for n in (catalog, schema) if n is not None]
        plain = all(n and "/" not in n and not n.startswith((".", "_")) and not n.endswith(".parquet") for n in names)
        return plain and os.path.isdir("/".join([self.root, *names]))

    def objects(self, catalog: str, schema: str) -> Iterator[Item]:
        top = f"{self.root}/{catalog}/{schema}"
        for entry in sorted(os.scandir(top), key=lambda e: e.name):
            name, kind = os.path.splitext(entry.name)
            if entry.name.startswith((".", "_")):
                continue
            if kind == ".parquet":
                yield Item("table", name)
                files = [entry.path] if entry.is_file() else sorted(f.path for f in os.scandir(entry.path) if f.name.endswith(".parquet"))
                for i, f in enumerate(pq.read_schema(files[0]) if files else []):
                    yield Item("column", name, i, f.name, spark_type(f.type))
            elif kind in (".sql", ".py") and entry.is_file():
                with open(entry.path, "rb") as f:
                    yield Item("view" if kind == ".sql" else "function", name, type=None if kind == ".sql" else "PYTHON", digest=hashlib.sha256(f.read()).hexdigest())
            elif entry.is_dir():
                yield Item("volume", entry.name)


def told_tables(spark: SparkSession, folder: str, catalog: str, schema: str) -> str:
    """The tables `x.parquet` of a folder in any store that Spark reads, with the columns that Spark gives them, as the source of a ListedCatalog.

    The driver lists the folder and has Spark read a footer for each table; no rows are read."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    paths = [s.getPath() for s in top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)]
    found = {p.getName().removesuffix(".parquet"): p.toString() for p in paths if p.getName().endswith(".parquet") and not p.getName().startswith((".", "_"))}
    tables = {name: [(f.name, f.dataType.simpleString()) for f in spark.read.parquet(found[name]).schema] for name in sorted(found)}
    return json.dumps({catalog: {schema: tables}})


class ListedCatalog:
    """Tables as told: JSON of {catalog: {schema: {table: [[column, type], ...]}}}."""

    def __init__(self, told: str):
        self._told = json.loads(told)

    def catalogs(self) -> list[str]:
        return sorted(self._told)

    def schemas(self, catalog: str) -> list[str]:
        return sorted(self._told[catalog])

    def objects(self, catalog: str, schema: str) -> Iterator[Item]:
        for name, columns in self._told[catalog][schema].items():
            yield Item("table", name)
            for i, (column, kind) in enumerate(columns):
                yield Item("column", name, i, column, kind)


@dataclass
class SchemaPartition(InputPartition):
    catalog: str
    schema: str


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        module, _, factory = options.get("client", f"{__name__}:FolderCatalog").partition(":")
        self._module, self._factory, self._source = module, factory, options["source"]
        chosen = lambda key: {v.strip() for v in options.get(key, "").split(",") if v.strip()}
        self._catalogs, self._schemas = chosen("catalogs"), chosen("schemas")

    def _client(self) -> Client:
        return getattr(importlib.import_module(self._module), self._factory)(self._source)

    def partitions(self) -> list[SchemaPartition]:
        client = self._client()
        holds = getattr(client, "holds", None)

        def named(chosen: set[str], listed: Callable[[], list[str]], *above: str) -> list[str]:
            if chosen and holds:
                return sorted(n for n in chosen if holds(*above, n))
            return [n for n in listed() if not chosen or n in chosen]

        own = named(self._catalogs, client.catalogs)
        return [SchemaPartition(c, s) for c in own for s in named(self._schemas, lambda c=c: client.schemas(c), c)] or [SchemaPartition("", "")]

    def read(self, partition: SchemaPartition) -> Iterator[tuple]:
        if not partition.catalog:  # an empty catalog
            return
        yield (partition.catalog, partition.schema, "schema", partition.schema, None, None, None, None)
        for i in self._client().objects(partition.catalog, partition.schema):
            yield (partition.catalog, partition.schema, i.kind, i.name, i.place, i.column, i.type, i.digest)


class CatalogSource(DataSource):
    """Options: source; client (module:factory); catalogs and schemas, lists of those to scan."""

    @classmethod
    def name(cls) -> str:
        return "marlgrid_catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CatalogReader:
        return CatalogReader(dict(self.options))
