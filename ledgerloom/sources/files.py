"""Reading and writing: typed CSV, published warehouses, audits, bounded results, run logs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.catalog import Catalog, Table
from ledgerloom.operators.quality import differing_parts
from ledgerloom.periods import month_column
from ledgerloom.sources.schemas import CATALOG
from ledgerloom.sources.warehouse import Warehouse, published


def load_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header: empty is NULL, ``True`` / ``False`` are booleans, a bad value raises."""
    booleans = [f.name for f in schema if isinstance(f.dataType, T.BooleanType)]
    as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name in booleans else f.dataType) for f in schema])
    read = (
        spark.read.schema(as_text).option("header", True).option("nullValue", "").option("emptyValue", "")
        .option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    )
    return read.withColumns({b: F.lower(F.trim(b)).cast("boolean") for b in booleans}) if booleans else read


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def layout_day(table: Table, columns: Sequence[str]) -> str | None:
    """The day by which a fact is laid out: that of its own event, the last it declares but for due days."""
    days = [c.name for c in table.columns if c.type == "DATE" and c.name in columns]
    own = [d for d in days if not d.startswith(("due", "promised"))]
    return (own or days or [None])[-1]


def by_month(df: DataFrame, table: Table) -> tuple[DataFrame, list[str]]:
    """A fact with the month of its day to partition by, its rows dealt out by day.

    Months are folders, so a period opens its own only. A task gets a range of days, and so writes
    few files; the hash of the row's key cuts a hot day. Other tables stay as they are.
    """
    day = layout_day(table, df.columns) if table.kind == "fact" else None
    if day is None:
        return df, []
    month = month_column(day)
    dealt = df.repartitionByRange(day, F.xxhash64(table.columns[0].name))
    return dealt.withColumn(month, F.trunc(day, "MM")).sortWithinPartitions(month, day), [month]


def clustered(df: DataFrame, table: Table) -> DataFrame:
    """Each file sorted by the table's day, without a shuffle, so that scans skip pages by period."""
    day = layout_day(table, df.columns)
    return df.sortWithinPartitions(day) if day else df


def load_order(catalog: Catalog, tenant: str) -> list[str]:
    """Dimensions, then bridges, then facts, each after the tables it refers to."""
    rank = {"dimension": 0, "bridge": 1, "fact": 2}
    tables = {t.name: t for t in catalog.of_tenant(tenant)}
    done: list[str] = []

    def place(name: str, above: tuple[str, ...] = ()) -> None:
        if name in done or name in above:
            return
        for column in tables[name].columns:
            if column.foreign_key:
                place(column.foreign_key.split(".")[0], (*above, name))
        done.append(name)

    for name in sorted(tables, key=lambda n: (rank[tables[n].kind], n)):
        place(name)
    return done


# facts that are joined with each other, and the key they share
LINE_KEYS = {
    "o2c_sales_order_line": "so_line_key", "o2c_fulfillment_line": "so_line_key",
    "ar_invoice": "invoice_key", "ar_payment_application": "invoice_key",
}
# joins that several tables of the built-in warehouse start from
SHARED_STEPS = ("shipped_orders", "invoice_terms", "purchases")


def full_refresh(
    wh: Warehouse,
    folder: str,
    tables: Sequence[str] | None = None,
    audit: str | None = None,
    shared_steps: Sequence[str] | None = None,
    concurrent_writes: int = 4,
    months: bool = True,
) -> str:
    """Write tables to a new version folder and make it current once all are written and sound.

    Steps that several tables share are written once under ``_steps`` and read from there:
    they are not computed again, and a lost executor costs one stage, not the whole lineage.

    Versions become current by numbered commits, which are only ever added, so a reader finds the
    old version or the whole new one at any time. Row counts are observed while writing; NULL or
    repeated primary keys stop the refresh before the commit. Facts are laid out by month,
    unless ``months`` is off, as for tables whose months are smaller than a file should be.
    Returns the version.
    """
    version = f"version-{time.strftime('%Y%m%d%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"
    wanted = [n for n in load_order(wh.catalog, wh.tenant) if n in set(tables or list(wh))]
    if shared_steps is None:
        shared_steps = SHARED_STEPS if tables is None else ()
    for step in shared_steps:
        if wh.has(step):
            wh[step].write.mode("overwrite").parquet(f"{folder}/{version}/_steps/{step}")
            wh = wh.replaced(**{step: wh.spark.read.parquet(f"{folder}/{version}/_steps/{step}")})

    def write(name: str) -> tuple[str, str, str, int, float]:
        table = wh.catalog.table(wh.tenant, name)
        key = table.primary_key
        seen = Observation(f"{wh.tenant}_{name}_{version}")
        started = time.monotonic()
        watched = [F.count(F.lit(1)).alias("rows")]
        if key:
            watched.append(F.count(F.when(F.col(key).isNull(), 1)).alias("nulls"))
        path = f"{folder}/{version}/{name}"
        rows, folders = by_month(frames[name], table) if months else (clustered(frames[name], table), [])
        rows.observe(seen, *watched).write.mode("overwrite").partitionBy(*folders).parquet(path)
        if seen.get.get("nulls", 0):
            raise ValueError(f"{name}.{key} holds {seen.get['nulls']} NULLs; {version} is not published")
        if key and wh.spark.read.parquet(path).groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name}.{key} repeats; {version} is not published")
        return version, wh.tenant, name, int(seen.get["rows"]), round(time.monotonic() - started, 3)

    # plans are made here in load order; writes overlap so that one table's last tasks do not idle the cluster
    frames = {name: wh[name] for name in wanted}
    with ThreadPoolExecutor(max_workers=concurrent_writes) as pool:
        log = list(pool.map(write, wanted))
    commit(wh.spark, folder, version)
    if audit:
        append_audit(wh.spark, log, audit)
    return version


COMPLETE = "complete"


def _commits(spark: SparkSession, folder: str) -> tuple[Any, Any, dict[int, Any]]:
    """File system, commit folder, and its files by number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_commits")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.listStatus(path) if system.exists(path) else []
    files = {f.getPath().getName(): f.getPath() for f in found}
    return system, path, {int(n): p for n, p in files.items() if n.isdigit()}


def commit(spark: SparkSession, folder: str, version: str) -> int:
    """Add the next numbered commit; of two writers at once the later takes the number after.

    A commit file is created only where there is none. It ends with a mark, so one that is still
    being written is not taken for whole.
    """
    exists = "FileAlreadyExistsException"
    while True:
        system, path, files = _commits(spark, folder)
        number = max(files, default=0) + 1
        target = spark._jvm.org.apache.hadoop.fs.Path(path, f"{number:012d}")
        try:
            out = system.create(target, False)
        except Py4JJavaError as failed:
            if exists in str(failed.java_exception) or system.exists(target):
                continue
            raise
        out.write(bytearray(f"{version}\n{COMPLETE}\n".encode()))
        out.close()
        return number


def current_version(spark: SparkSession, folder: str) -> str:
    """The version that the newest whole commit names."""
    _, _, files = _commits(spark, folder)
    for number in sorted(files, reverse=True):
        lines = [r[0] for r in spark.read.text(files[number].toString()).collect()]  # two lines
        if lines[1:] == [COMPLETE]:
            return lines[0]
    raise ValueError(f"{folder} holds no published version")


def bucket_by_line(wh: Warehouse, database: str, buckets: int) -> Warehouse:
    """The warehouse with its order-line facts stored bucketed by line key.

    Sales, shipments, invoices and payments then join on that key without a shuffle. The
    key is unique per line, so the buckets are even. ``database`` must exist.
    """
    stored = {}
    for name, key in LINE_KEYS.items():
        table = f"{database}.{name}"
        (
            wh[name].repartition(buckets, key).write.mode("overwrite").format("parquet")
            .bucketBy(buckets, key).sortBy(key).saveAsTable(table)
        )
        stored[name] = wh.spark.table(table)
    return wh.replaced(**stored)


def append_audit(spark: SparkSession, rows: Iterable[tuple[str, str, str, int, float]], path: str) -> None:
    """One line per loaded table: version, tenant, table, rows, seconds."""
    columns = "version string, tenant string, table_name string, row_count bigint, seconds double"
    frame = spark.createDataFrame(list(rows), columns).withColumn("loaded_at", F.current_timestamp())
    frame.coalesce(1).write.mode("append").parquet(path)


def open_current(spark: SparkSession, tenant: str, folder: str, catalog: Catalog = CATALOG) -> Warehouse:
    """The published version that is current now."""
    return published(spark, tenant, f"{folder}/{current_version(spark, folder)}", catalog)


def register_views(wh: Mapping[str, DataFrame], names: Iterable[str] | None = None, prefix: str = "") -> list[str]:
    """Make tables readable from SQL by name."""
    made = []
    for name in names or list(wh):
        wh[name].createOrReplaceTempView(f"{prefix}{name}")
        made.append(f"{prefix}{name}")
    return made


def insert_by_position(df: DataFrame, table: str) -> None:
    """Append a frame to a stored table, columns matched by position."""
    df.write.insertInto(table)


def sync_table(source: DataFrame, path: str) -> DataFrame:
    """Replace a stored copy with the source and return the copy."""
    source.write.mode("overwrite").parquet(path)
    return source.sparkSession.read.parquet(path)


def write_parts(source: DataFrame, folder: str, by: str) -> DataFrame:
    """Store a copy with a folder for each value of ``by`` and return the copy."""
    _dealt(source, by).write.mode("overwrite").partitionBy(by).parquet(folder)
    return read_parts(source, folder)


def read_parts(source: DataFrame, folder: str) -> DataFrame:
    """A copy stored in parts, typed as its source, so that folder names are not guessed at."""
    return source.sparkSession.read.schema(source.schema).parquet(folder).select(*source.columns)


def _dealt(source: DataFrame, by: str) -> DataFrame:
    """Rows dealt by part, and by their hash within it, so that a hot part has several writers."""
    return source.repartitionByRange(by, F.xxhash64(*[F.col(f"`{c}`") for c in source.columns]))


def sync_parts(source: DataFrame, folder: str, by: str) -> DataFrame:
    """Bring a copy stored in parts up to date by writing only the parts whose contents differ.

    Returns what was found: the part, its rows in the source and in the copy as it was. Contents
    are compared by digests that combine on the map side. A part that the source no longer has is
    removed. ``by`` has a value for each folder, few enough for the driver to list; the parts
    found are written down as literals, so that the source's scan is pruned to them. A reader at
    work meanwhile may meet parts of both states: publish versions where that matters.
    """
    spark = source.sparkSession
    found = differing_parts(source, read_parts(source, folder), [by]).collect()
    kind = source.schema[by].dataType
    values = {r[by]: r["left_rows"] for r in found}
    part = F.col(f"`{by}`")
    if any(values.values()):
        wanted = part.isin([v for v, n in values.items() if n and v is not None])
        fresh = source.where(wanted | part.isNull() if values.get(None) else wanted)
        _dealt(fresh, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)
    gone = [v for v, n in values.items() if not n]
    if gone:
        _drop_parts(spark, folder, by, spark.createDataFrame([(v,) for v in gone], T.StructType([T.StructField(by, kind)])))
    names = T.StructType([T.StructField(by, kind), T.StructField("source_rows", T.LongType()), T.StructField("copy_rows", T.LongType())])
    return spark.createDataFrame([(r[by], r["left_rows"], r["right_rows"]) for r in found], names)


def _drop_parts(spark: SparkSession, folder: str, by: str, parts: DataFrame) -> None:
    """Remove the folders of parts; their names are what Spark makes of the values."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for (value,) in parts.select(F.col(f"`{by}`").cast("string")).collect():
        system.delete(jvm.org.apache.hadoop.fs.Path(root, escape(by, value)), True)


def catalog_counts(wh: Mapping[str, DataFrame], names: Sequence[str] | None = None) -> DataFrame:
    """Row count per table and the total."""
    counted = [
        wh[n].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n in (names or list(wh))
    ]
    union = counted[0]
    for one in counted[1:]:
        union = union.unionByName(one)
    return union.rollup("table_name").agg(F.sum("row_count").alias("row_count")).select(
        F.coalesce("table_name", F.lit("total")).alias("table_name"), "row_count"
    )


def bounded_result(df: DataFrame, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """The first n rows in the order of all columns, and ``(row_count, truncated)`` of the whole result."""
    size = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("truncated", F.col("row_count") > n)
    return df.orderBy(*[F.col(f"`{c}`") for c in df.columns]).limit(n), size


def normalize_types(df: DataFrame) -> DataFrame:
    """What callers outside Spark expect: whole numbers as bigint, decimals as double, dates as text."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd")
        columns.append(c.alias(f.name))
    return df.select(*columns)


RUN_LOG = (
    "id string, tier string, mode string, retrieved_chunk_ids array<string>, refused boolean, sql_valid boolean, "
    "result_rows array<struct<texts: array<string>, numbers: array<double>>>, tokens_in bigint, tokens_out bigint, "
    "cost_usd double, latency_ms struct<retrieval: double, llm: double>"
)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one benchmark run each."""
    return spark.read.schema(RUN_LOG).json(path)


def append_run_log(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def guard_plan(
    df: DataFrame, columns: Sequence[str], tables: Iterable[str], limit: int = 100, sources: Iterable[str] | None = None
) -> DataFrame:
    """Refuse a result that shows other columns or reads other tables than allowed; then bound it.

    ``tables`` are the views or tables the plan may read: ``name`` for one of the session or of
    its current database, ``database.name`` for one elsewhere. Data that is read by no such name
    (files by their path, a frame under an alias, a query in a subquery) is refused, and so is a
    session view that hides a stored table of its name. ``sources`` are the table columns
    (``table.column``) that shown columns may be made from, whatever they are renamed to. The
    rows kept are the first ``limit`` in the order of all columns.
    """
    shown = [c for c in df.columns if c not in set(columns)]
    if shown:
        raise ValueError(f"columns not allowed: {shown}")
    allowed = {t.lower() for t in tables}
    read = _relations(df._jdf.queryExecution().analyzed(), _namer(df.sparkSession))
    if read - allowed:
        raise ValueError(f"tables not allowed: {sorted(read - allowed)}")
    if sources is not None:
        known = {s.lower() for s in sources}
        foreign = {c: sorted(made - known) for c, made in column_lineage(df).items() if made - known}
        if foreign:
            raise ValueError(f"columns made from what is not allowed: {foreign}")
    return df.orderBy(*[F.col(f"`{c}`") for c in df.columns]).limit(limit)


# leaves of a plan that hold no data of a table; the definition behind a reference is visited itself
DATALESS = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef")


def _namer(spark: SparkSession) -> Callable[[Any, bool], str]:
    """How a view or table is called: with its database, unless that is the current one."""
    home = spark.catalog.currentDatabase().lower()

    def name_of(identifier: Any, of_session: bool = False) -> str:
        table, database = identifier.table().lower(), identifier.database()
        if of_session:
            # a global session view has a database of its own; others must not hide a stored table
            if database.isDefined():
                return f"{database.get().lower()}.{table}"
            return f"<view that hides {home}.{table}>" if spark.catalog.tableExists(f"{home}.{table}") else table
        owner = database.get().lower() if database.isDefined() else home
        return table if owner == home else f"{owner}.{table}"

    return name_of


def _seq(items: Any) -> list[Any]:
    return [items.apply(i) for i in range(items.size())]


def _source_name(plan: Any, name_of: Callable[[Any, bool], str]) -> str | None:
    """The name of the view or table a node is; None for an inner node."""
    kind = plan.getClass().getSimpleName()
    if kind == "View":
        return name_of(plan.desc().identifier(), plan.isTempView())
    if kind in DATALESS or _seq(plan.children()) or _seq(plan.subqueries()):
        return None
    table = plan.catalogTable() if kind == "LogicalRelation" else None
    return name_of(table.get().identifier(), False) if table and table.isDefined() else f"<{kind}>"


def _relations(plan: Any, name_of: Callable[[Any, bool], str]) -> set[str]:
    """Names of the views and tables an analysed plan reads; ``<kind of node>`` for unnamed data."""
    name = _source_name(plan, name_of)
    if name is not None:
        return {name}
    return set().union(*[_relations(p, name_of) for p in [*_seq(plan.children()), *_seq(plan.subqueries())]])


def column_lineage(df: DataFrame) -> dict[str, set[str]]:
    """For each column shown, the table columns its values are made from.

    The analysed plan is followed by the ids of its expressions: an alias is made of what it
    refers to, a union's column of those at its place in every branch, and any other new column
    (of a generator, say) of all that its node refers to. A subquery counts for every new column
    of its node.
    """
    name_of = _namer(df.sparkSession)
    named_queries: dict[int, list[set[str]]] = {}

    def made(plan: Any) -> dict[int, set[str]]:
        source = _source_name(plan, name_of)
        outputs = _seq(plan.output())
        if source is not None:
            return {a.exprId().id(): {f"{source}.{a.name().lower()}"} for a in outputs}
        kind = plan.getClass().getSimpleName()
        if kind == "CTERelationRef":
            return {a.exprId().id(): s for a, s in zip(outputs, named_queries[plan.cteId()])}
        children = _seq(plan.children())
        known: dict[int, set[str]] = {}
        # the definitions of named queries come before the query that uses them
        for child in sorted(children, key=lambda c: c.getClass().getSimpleName() != "CTERelationDef"):
            known |= made(child)
            if child.getClass().getSimpleName() == "CTERelationDef":
                named_queries[child.id()] = [known.get(a.exprId().id(), set()) for a in _seq(child.child().output())]
        nested: set[str] = set()
        for subquery in _seq(plan.subqueries()):
            inner = made(subquery)
            nested |= set().union(*[inner.get(a.exprId().id(), set()) for a in _seq(subquery.output())])
        refer = lambda expression: set().union(
            nested, *[known.get(a.exprId().id(), set()) for a in _seq(expression.references().toSeq())]
        )
        aliases = {e.exprId().id(): e for e in _seq(plan.expressions()) if e.getClass().getSimpleName() == "Alias"}
        union = kind == "Union"
        found = {}
        for place, column in enumerate(outputs):
            key = column.exprId().id()
            if union:
                sides = [_seq(child.output())[place].exprId().id() for child in children]
                found[key] = set().union(*[known.get(s, set()) for s in sides])
            elif key in aliases:
                found[key] = refer(aliases[key])
            elif key in known:
                found[key] = known[key]
            else:
                found[key] = set().union(nested, *map(refer, _seq(plan.expressions())))
        # a window or an aggregate may order by what it does not show
        return {**known, **found}

    plan = df._jdf.queryExecution().analyzed()
    lineage = made(plan)
    return {a.name(): lineage.get(a.exprId().id(), set()) for a in _seq(plan.output())}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder the cluster names in ``spark.checkpoint.dir``.

    A session on one machine may do without; elsewhere executors could not read each other's
    files, so a missing name is an error.
    """
    root: Any = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
