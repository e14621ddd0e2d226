"""Per-client input files.

Layouts, per client id ``<id>``:
  <dir>/client_<id>.db            SQLite with tables FEATURES, SALES_RECORDS
  <dir>/<id>/train.csv, valid.csv CSV pair
  <dir>/<id>/features.parquet     parquet

Files are listed and read by Spark; the client id comes from the file path,
so all clients of one kind are one DataFrame, and a listing is a DataFrame too.
Columns are decided per file: a CSV file's header names its own columns, and each
client's renames, defaults and date column depend on its own file. A missing
folder raises. SQLite files are read by a Python data source in parts of bounded size, with columns and filters
pushed to them; they need a POSIX path, so on a cluster they must sit on a shared mounted
file system. CSV and parquet work on any Hadoop store.
"""

from __future__ import annotations

import json
import math
import os
import sqlite3
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from groupcast.operators.panel import calendar_basic, choose_target, drop_incomplete, parse_date, require_columns
from groupcast.session import settle

_SQLITE_TYPES = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "FLOAT": "double", "DOUBLE": "double",
                 "NUMERIC": "double", "TEXT": "string", "VARCHAR": "string", "DATE": "string", "TIMESTAMP": "string"}


def list_files(spark: SparkSession, data_dir: str, pattern: str, recursive: bool = False) -> DataFrame:
    """(path, length, client_dir) of the files whose name matches a glob, listed by Spark
    (any Hadoop-compatible store). Contents are not read: the binary source
    prunes the unused column."""
    rd = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        rd = rd.option("recursiveFileLookup", True)
    return rd.load(data_dir).select("path", "length", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("client_dir"))


PART_BYTES = 64 << 20
READ_ROWS = 16_384


class _RowRange(InputPartition):
    """Part ``k`` of ``parts`` of a file: an equal share of its table's rowids."""

    def __init__(self, path: str, k: int, parts: int):
        super().__init__((path, k, parts))
        self.path, self.k, self.parts = path, k, parts


def client_folder(path):
    """The folder that holds a file, from Spark's file_path, which is a URI."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(plain, r"/([^/]+)/[^/]+$", 1)


def _client_of_db(path: str) -> str:
    return os.path.basename(path)[len("client_"):-len(".db")]


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


class SqliteTableSource(DataSource):
    """``spark.read.format("groupcast_sqlite")`` with options ``table`` and ``listing`` (JSON: the files of a table of
    (path, length) that Spark listed; see ``read_sqlite_table``).

    Adds ``client_id`` (from ``client_<id>.db``). The schema is read from the first file's table definition
    (metadata only) unless given; a given schema is also the pruning, as only its columns are read. Files of more than
    PART_BYTES are read in parts, by ranges of rowid. Filters go to SQLite where it compares as Spark does, and
    Spark applies them again."""

    @classmethod
    def name(cls):
        return "groupcast_sqlite"

    def _files(self) -> list[tuple[str, int]]:
        found: list[tuple[str, int]] = []
        for part in json.loads(self.options["listing"]):
            rows = pq.read_table(_local(part)).to_pylist()
            found += [(_local(r["path"]), r["length"]) for r in rows]
        return sorted(found)

    def schema(self):
        files = self._files()
        if not files:
            raise FileNotFoundError("no client_*.db found")
        con = sqlite3.connect(files[0][0])
        try:
            cols = con.execute(f"PRAGMA table_info({self.options['table']})").fetchall()
        finally:
            con.close()
        fields = [f"`{c[1]}` {_SQLITE_TYPES.get((c[2] or 'TEXT').upper().split('(')[0], 'string')}" for c in cols]
        return ", ".join(["client_id string"] + fields)

    def reader(self, schema):
        return _SqliteReader(self.options, schema, self._files())


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema, files):
        self.table = options["table"]
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.files = files
        self.where: list[tuple[str, str, list]] = []  # column, SQL operator, values

    def pushFilters(self, filters):
        """Comparisons of a column with a value: on numbers all, on text only equality (an ordering would be
        SQLite's). On client_id they choose the files. All go back to Spark as well."""
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            number = self.kinds.get(column) in ("bigint", "double", "int")
            values = list(f.value) if isinstance(f, In) else [f.value] if hasattr(f, "value") else []
            plain = all(isinstance(v, (int, float) if number else str) and not isinstance(v, bool) and v == v for v in values)
            if column in self.kinds and plain and values:
                if isinstance(f, (EqualTo, EqualNullSafe, In)):
                    self.where.append((column, "in", values))
                elif type(f) in signs and number:
                    self.where.append((column, signs[type(f)], values))
            yield f

    def partitions(self):
        chosen = [v for c, _, v in self.where if c == "client_id"]
        out = []
        for path, length in self.files:
            if all(_client_of_db(path) in v for v in chosen):
                parts = max(1, -(-length // self.part_bytes))
                out += [_RowRange(path, k, parts) for k in range(parts)]
        return out

    def _sql(self, con, partition) -> tuple[str, list]:
        tests, values = [], []
        for column, sign, wanted in self.where:
            if column != "client_id":
                tests.append(f'"{column}" IN ({", ".join("?" * len(wanted))})' if sign == "in" else f'"{column}" {sign} ?')
                values += wanted
        if partition.parts > 1:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
            if low is not None:
                share = (high - low + 1) / partition.parts
                edge = [low + math.ceil(share * k) for k in (partition.k, partition.k + 1)]
                tests.append("rowid >= ? AND rowid < ?")
                values += edge
        cols = ", ".join(f'"{n}"' for n in self.kinds if n != "client_id") or "1"
        return f"SELECT {cols} FROM {self.table}" + (f" WHERE {' AND '.join(tests)}" if tests else ""), values

    def read(self, partition):
        if partition is None:  # Spark's stand-in when the filters leave no file
            return
        types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        names = [n for n in self.kinds if n != "client_id"]
        con = sqlite3.connect(f"file:{quote(partition.path)}?mode=ro", uri=True)
        try:
            rows = con.execute(*self._sql(con, partition))
            while part := rows.fetchmany(READ_ROWS):
                found = dict(zip(names, zip(*part, strict=True), strict=False))
                found["client_id"] = [_client_of_db(partition.path)] * len(part)
                texts = lambda col: [None if v is None else str(v) for v in col]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[n], types[k]) if k in types else pa.array(texts(found[n]), pa.string()) for n, k in self.kinds.items()],
                    names=list(self.kinds))
        finally:
            con.close()


def register_sources(spark: SparkSession) -> None:
    """Makes the SQLite source known to the session, and lets Python sources take filters."""
    spark.dataSource.register(SqliteTableSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_sqlite_table(spark: SparkSession, data_dir: str, table: str, columns: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """One table of every client_<id>.db under ``data_dir``, with ``client_id``; ``columns`` (a DDL list) prunes."""
    register_sources(spark)
    files = settle(list_files(spark, data_dir, "client_*.db").select("path", "length"))
    rd = spark.read.format("groupcast_sqlite").option("table", table).option("part_bytes", str(part_bytes))
    rd = rd.option("listing", json.dumps(files.inputFiles()))
    return (rd.schema(columns) if columns else rd).load()


# --------------------------------------------------------------------- A1
def discover_clients(spark: SparkSession, data_dir: str) -> DataFrame:
    """A1: ids of client_<id>.db files, sorted."""
    files = list_files(spark, data_dir, "client_*.db")
    return files.select(F.regexp_extract("path", r"client_([^/]+)\.db$", 1).alias("client_id")).distinct().orderBy("client_id")


# --------------------------------------------------------------------- A2, C1
def read_client_sqlite(spark: SparkSession, data_dir: str) -> DataFrame:
    """A2 + C1: FEATURES joined with SALES_RECORDS on (client, item, sale_date);
    ``sales`` becomes ``quantity``; duplicates multiply, as an inner join."""
    f = read_sqlite_table(spark, data_dir, "FEATURES")
    kinds = {c.name: c.dataType.simpleString() for c in f.schema}
    s = read_sqlite_table(spark, data_dir, "SALES_RECORDS", f"client_id string, item_id {kinds['item_id']}, sale_date {kinds['sale_date']}, sales double")
    s = s.withColumnRenamed("sales", "quantity")
    j = f.join(s, ["client_id", "item_id", "sale_date"], "inner")
    return parse_date(j, "sale_date")


# --------------------------------------------------------------------- A3, C2
TEXT_COLUMNS = {"item_id", "date", "sale_date"}


def read_client_csv(spark: SparkSession, data_dir: str) -> DataFrame:
    """A3 + C2: train.csv and valid.csv of every client, by the names in each
    file's own header, with B1 renames, B2 default and B6 date parsing per file.

    A file is a set of rows of text: its header is the line at its start (by the
    position that Spark reports), and every other line meets its file's header in a
    join. So clients may order, leave out or add columns; the result has every column
    that any file has, as DOUBLE except ids and dates."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{train,valid}.csv")
    lines = files.text(data_dir).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("_id"))
    lines = lines.filter(F.col("line").isNotNull() & (F.trim("line") != ""))
    first = lines.filter("at = 0").groupBy("path").agg(F.min(F.struct("_id", "line")).alias("h"))
    heads = first.select("path", F.col("h._id").alias("_head"), "h.line")
    names = F.transform(F.split(F.regexp_replace("line", "^\ufeff|\r$", ""), ","), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))
    heads = heads.select("path", "_head", names.alias("names"))
    found = [r.c for r in heads.select(F.explode("names").alias("c")).distinct().orderBy("c").collect()]  # column names
    if not found:
        raise FileNotFoundError(f"no CSV clients under {data_dir}")
    cells = lines.join(heads, "path").filter("_id != _head").withColumn(
        "row", F.from_csv(F.regexp_replace("line", "\r$", ""), ", ".join(f"c{i} string" for i in range(len(found)))))
    values = F.array(*[F.col(f"row.c{i}") for i in range(len(found))])
    width = F.size("names")
    named = cells.select("path", F.map_from_arrays("names", F.slice(values, F.lit(1), width)).alias("m"))
    wanted = sorted({"sales": "quantity", "event_flag": "is_holiday"}.get(c, c) for c in found)

    def column(name: str):
        """B1 per file: a renamed column counts under its new name."""
        old = {"quantity": "sales", "is_holiday": "event_flag"}.get(name)
        value = F.coalesce(F.col("m")[old], F.col("m")[name]) if old else F.col("m")[name]
        value = F.nullif(value, F.lit(""))
        return (value if name in TEXT_COLUMNS else value.cast("double")).alias(name)

    out = named.select(client_folder(F.col("path")).alias("client_id"),
                       F.map_contains_key("m", F.lit("rolling_std_28")).alias("_has"),
                       *[column(c) for c in dict.fromkeys(wanted)])
    # B2 per client: a client without the column in any of its files gets 0.
    mine = F.max("_has").over(Window.partitionBy("client_id"))
    std = F.col("rolling_std_28") if "rolling_std_28" in out.columns else F.lit(None).cast("double")
    out = out.withColumn("rolling_std_28", F.when(mine, std).otherwise(F.lit(0.0))).drop("_has")
    return parse_date(out, "date")


# --------------------------------------------------------------------- A4
def read_client_parquet(spark: SparkSession, data_dir: str) -> DataFrame:
    """A4: features.parquet per client; per row ``date``, else ``sale_date``.
    Files may have unlike columns: schemas are merged."""
    rd = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "features.parquet").option("mergeSchema", True)
    df = rd.parquet(data_dir)
    client = client_folder(F.col("_metadata.file_path"))
    days = [F.to_date(F.col(c)) for c in ("date", "sale_date") if c in df.columns]
    if not days:
        raise KeyError("parquet clients: no column named date or sale_date")
    return df.withColumn("client_id", client).withColumn("date", F.coalesce(*days))


# --------------------------------------------------------------------- A5, A6
def source_listing(spark: SparkSession, data_dir: str) -> DataFrame:
    """(client_id, kind, priority) for every client file found."""
    db = list_files(spark, data_dir, "client_*.db").select(
        F.regexp_extract("path", r"client_([^/]+)\.db$", 1).alias("client_id"), F.lit("sqlite").alias("kind"), F.lit(1).alias("priority"))
    csv = list_files(spark, data_dir, "train.csv", recursive=True).select(
        F.col("client_dir").alias("client_id"), F.lit("csv").alias("kind"), F.lit(2).alias("priority"))
    parquet = list_files(spark, data_dir, "features.parquet", recursive=True).select(
        F.col("client_dir").alias("client_id"), F.lit("parquet").alias("kind"), F.lit(3).alias("priority"))
    return db.union(csv).union(parquet)


def pick_source(listing: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """A5: per client sqlite, else csv, else parquet; a wanted client with
    no source at all raises."""
    w = Window.partitionBy("client_id").orderBy("priority")
    chosen = listing.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    if wanted is not None:
        missing = [r.client_id for r in wanted.join(chosen, "client_id", "left_anti").limit(20).collect()]
        if missing:
            raise FileNotFoundError(f"clients without any input file: {missing}")
    return chosen


def load_panel(spark: SparkSession, data_dir: str, feature_cols: list[str] | None = None) -> DataFrame:
    """Every client from its chosen source, unioned by name, with the
    Monday=0 weekday and month added (B7). With ``feature_cols``: the target is chosen
    (B4), rows that lack a feature or the target go (B5), and the result is client_id,
    item_id, date, the features in order and y (B8)."""
    chosen = pick_source(source_listing(spark, data_dir))
    readers = {"sqlite": read_client_sqlite, "csv": read_client_csv, "parquet": read_client_parquet}
    kinds = {r.kind for r in chosen.select("kind").distinct().collect()}  # three at most
    if not kinds:
        raise FileNotFoundError(f"no client files under {data_dir}")
    parts = [
        readers[k](spark, data_dir).join(chosen.filter(F.col("kind") == k).select("client_id"), "client_id", "left_semi")
        for k in readers if k in kinds
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = calendar_basic(out.withColumn("item_id", F.col("item_id").cast("string")))
    if not feature_cols:
        return out
    require_columns(out, feature_cols, "clients")
    # A target column that only some clients have is null for the others: each falls back to its quantity.
    target = F.col("quantity").cast("double")
    if choose_target(out) == "target_7d":
        has = F.count("target_7d").over(Window.partitionBy("client_id")) > 0
        target = F.when(has, F.col("target_7d").cast("double")).otherwise(target)
    rows = drop_incomplete(out.withColumn("y", target), [*feature_cols, "y"])
    return rows.select("client_id", "item_id", "date", *[F.col(c).cast("double").alias(c) for c in feature_cols], "y")
