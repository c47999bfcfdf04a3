"""Sources: nested JSON, parallel arrays, price files, index pages and raw documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FACT = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>"
COMPANY_FACTS = f"cik long, entityName string, facts map<string,map<string,struct<units:map<string,array<{_FACT}>>>>>"
FILING_ARRAYS = ["accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "form", "items", "primaryDocument"]
FILINGS = "cik long, filings struct<recent:struct<" + ",".join(f"{n}:array<string>" for n in FILING_ARRAYS) + ">>"


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row per filed occurrence from company-facts JSON: nothing is collapsed, nothing is dropped.

    ``facts.<taxonomy>.<concept>.units.<unit>[]`` becomes columns taxonomy,
    concept, unit and those of the occurrence; dates that are none are null.
    """
    raw = spark.read.schema(COMPANY_FACTS).option("multiLine", True).json(path)
    a = raw.select("cik", F.explode("facts").alias("taxonomy", "_c"))
    b = a.select("cik", "taxonomy", F.explode("_c").alias("concept", "_u"))
    c = b.select("cik", "taxonomy", "concept", F.explode("_u.units").alias("unit", "_f"))
    f = c.select("cik", "taxonomy", "concept", "unit", F.inline("_f"))
    day = lambda x: F.expr(f"try_to_date({x}, 'yyyy-MM-dd')")
    return f.select(
        "cik", "taxonomy", "concept", "unit", F.col("val").alias("value"), "fy", "fp", day("start").alias("period_start"), day("`end`").alias("period_end"),
        "form", F.col("accn").alias("accession_number"), day("filed").alias("filed"),
    )


def filing_lists(spark: SparkSession, path: str, forms: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """One row per filing from lists that hold a parallel array per column; bounds are inclusive."""
    raw = spark.read.schema(FILINGS).option("multiLine", True).json(path)
    zipped = raw.select("cik", F.inline(F.arrays_zip(*(F.col(f"filings.recent.{n}").alias(n) for n in FILING_ARRAYS))))
    out = zipped.select(
        "cik", F.col("accessionNumber").alias("accession_number"), F.expr("try_to_date(filingDate, 'yyyy-MM-dd')").alias("filing_date"),
        F.expr("try_to_date(reportDate, 'yyyy-MM-dd')").alias("report_date"), F.expr("try_to_timestamp(acceptanceDateTime)").alias("acceptance_datetime"),
        "form", items("items").alias("items"), F.col("primaryDocument").alias("primary_document"),
    )
    if forms is not None:
        out = out.where(F.col("form").isin(forms))
    if first is not None:
        out = out.where(F.col("filing_date") >= F.lit(first).cast("date"))
    return out if last is None else out.where(F.col("filing_date") <= F.lit(last).cast("date"))


def items(column: str):
    """A comma-parted list as an array without blanks and empty elements; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda x: F.btrim(x))
    return F.filter(parts, lambda x: x != "")


def daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from CSV with a header ``Date,Open,High,Low,Close,Volume`` in any case; rows without a date or a close are dropped."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.strip().lower(): c for c in raw.columns}
    if lost := {"date", "open", "high", "low", "close"} - set(names):
        raise ValueError(f"no columns {sorted(lost)}: not a price file")
    number = lambda c: F.expr(f"try_cast(`{names[c]}` as double)").alias(c)
    volume = F.expr(f"try_cast(`{names['volume']}` as bigint)") if "volume" in names else F.lit(None).cast("long")
    out = raw.select(F.expr(f"try_to_date(trim(`{names['date']}`), 'yyyy-MM-dd')").alias("date"), number("open"), number("high"), number("low"), number("close"), F.coalesce(volume, F.lit(0)).alias("volume"))
    return out.where("date is not null and close is not null")


CHART = (
    "chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<bigint>,"
    "indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>>>>>>"
)


def daily_chart(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from chart JSON with parallel arrays; a bar without one of its four prices is dropped, a null volume is 0."""
    raw = spark.read.schema(CHART).option("multiLine", True).json(path).select(F.explode("chart.result").alias("r"))
    q = F.col("r.indicators.quote")[0]
    bars = raw.select(F.col("r.meta.symbol").alias("symbol"), F.inline(F.arrays_zip(F.col("r.timestamp").alias("t"), *(q[c].alias(c) for c in ("open", "high", "low", "close", "volume")))))
    out = bars.select("symbol", F.to_date(F.timestamp_seconds("t")).alias("date"), "open", "high", "low", "close", F.coalesce("volume", F.lit(0)).alias("volume"))
    return out.where("open is not null and high is not null and low is not null and close is not null")


def documents(spark: SparkSession, path: str, pattern: str = "*.htm*") -> DataFrame:
    """Raw documents of a folder: ``path``, ``length``, ``content``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


class _Rows(HTMLParser):
    """Cells and first link of every table row."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[list[str], str | None]] = []
        self.cells: list[str] | None = None
        self.cell: list[str] | None = None
        self.link: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.cells, self.link = [], None
        elif tag == "td" and self.cells is not None:
            self.cell = []
        elif tag == "a" and self.cell is not None and self.link is None:
            self.link = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag == "td" and self.cell is not None:
            self.cells.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.cells is not None:
            if self.cells:
                self.rows.append((self.cells, self.link))
            self.cells = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def index_entries(page: str) -> list[tuple[int | None, str, str, str]]:
    """``(seq, description, file name, type)`` of an index page's document rows; a row of five cells without a link is an error."""
    parser = _Rows()
    parser.feed(page)
    out = []
    for cells, link in parser.rows:
        if len(cells) < 5:
            continue
        if not link:
            raise ValueError("a document row without a link")
        name = re.split(r"[/=]", link)[-1]
        out.append((int(cells[0]) if cells[0].isdigit() else None, cells[1], name, cells[3]))
    if not out:
        raise ValueError("no document rows")
    return out


def index_pages(pages: DataFrame, keys: list[str], page: str) -> DataFrame:
    """``(keys, seq, description, filename, doc_type, error)``: entries of each page, or one row with what is wrong with it."""
    schema = T.StructType(
        [*(pages.schema[k] for k in keys), T.StructField("seq", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("description", "filename", "doc_type", "error"))]
    )
    names = ["seq", "description", "filename", "doc_type", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch["_page"]):
                try:
                    got = [(*e, None) for e in index_entries(text or "")]
                except ValueError as e:
                    got = [(None, None, None, None, str(e))]
                at += [i] * len(got)
                out += got
            made = pd.DataFrame(out, columns=names).astype({"seq": "Int32"})
            yield pd.concat([batch[keys].iloc[at].reset_index(drop=True), made], axis=1)

    return pages.select(*keys, F.col(page).alias("_page")).mapInPandas(run, schema)


def override_file(spark: SparkSession, path: str, schema: str, key: list[str], required: dict[str, int]) -> DataFrame:
    """A commented CSV of overrides, checked before use.

    Lines that start with ``#`` are comments. A repeated key, a null in the key,
    or a text of ``required`` (column: least length) that is too short is an
    error, as a wrong override is worse than none.
    """
    rows = spark.read.schema(schema).option("header", True).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    bad = F.lit(False)
    for k in key:
        bad = bad | F.col(k).isNull()
    for c, least in required.items():
        bad = bad | (F.length(F.coalesce(F.col(c), F.lit(""))) < least)
    wrong = rows.where(bad).limit(5).collect()
    twice = rows.groupBy(*key).count().where("count > 1").limit(5).collect()
    if wrong or twice:
        raise ValueError(f"{path}: {len(wrong)} rows fail their checks, {len(twice)} keys are repeated, among them {[tuple(r)[:2] for r in [*wrong, *twice]]}")
    return rows


def without_excluded(rows: DataFrame, exclusions: DataFrame, key: str, day: str, first: str, last: str) -> DataFrame:
    """``rows`` without those whose key is excluded on their day; an empty bound of an exclusion is unbounded, both bounds count."""
    x = exclusions.select(F.col(key).alias("_k"), F.col(first).cast("date").alias("_a"), F.col(last).cast("date").alias("_b"))
    on = (F.col(key) == F.col("_k")) & (F.col("_a").isNull() | (F.col(day) >= F.col("_a"))) & (F.col("_b").isNull() | (F.col(day) <= F.col("_b")))
    return rows.join(x, on, "left_anti")


def csv_table(spark: SparkSession, path: str, schema: str, lists: dict[str, str] | None = None) -> DataFrame:
    """A CSV with a header in the given schema; ``lists`` (column: delimiter) become arrays without empty elements, null an empty one."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    for c, mark in (lists or {}).items():
        parts = F.split(F.coalesce(F.col(c), F.lit("")), re.escape(mark))
        rows = rows.withColumn(c, F.filter(F.transform(parts, lambda x: F.btrim(x)), lambda x: x != ""))
    return rows


def sqlite_table(spark: SparkSession, path: str, name: str, schema: T.StructType, where: str | None = None, rows_per_task: int = 250_000) -> DataFrame:
    """A table of an SQLite file, read-only, in ranges of row ids that tasks read by themselves.

    The file lies where every executor can read it. ``where`` is a predicate of
    the table's own columns that SQLite applies. Text that is no value of its
    column's type is null, days and times included. A table without row ids is an error.
    """
    import sqlite3

    quoted = '"' + name.replace('"', '""') + '"'
    columns = ", ".join('"' + f.name.replace('"', '""') + '"' for f in schema)
    source = f"file:{path}?mode=ro"
    with sqlite3.connect(source, uri=True) as con:
        first, last = con.execute(f"select min(rowid), max(rowid) from {quoted}").fetchone()
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    ask = f"select {columns} from {quoted} where rowid >= ? and rowid < ?" + (f" and ({where})" if where else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(source, uri=True) as own:
            for batch in batches:
                for start in batch["id"]:
                    got = own.execute(ask, (int(start), int(start) + rows_per_task)).fetchall()
                    yield pd.DataFrame([[None if v is None else str(v) for v in r] for r in got], columns=raw.names, dtype=object)

    if first is None:
        return spark.createDataFrame([], schema)
    starts = spark.range(first, last + 1, rows_per_task, max(1, -(-(last + 1 - first) // rows_per_task)))
    text = starts.mapInPandas(run, raw)
    return text.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))


_FRAME = "taxonomy string, tag string, ccp string, uom string, data array<struct<accn:string,cik:long,entityName:string,`end`:string,val:double>>"


def frames(spark: SparkSession, path: str) -> DataFrame:
    """One row per entity and quarter from quarterly frames; all files of the path are read as one."""
    raw = spark.read.schema(_FRAME).option("multiLine", True).json(path)
    return raw.select("taxonomy", F.col("tag").alias("concept"), F.col("ccp").alias("frame"), F.col("uom").alias("unit"), F.explode("data").alias("d")).select(
        "taxonomy", "concept", "frame", "unit", "d.cik", F.col("d.entityName").alias("entity"), F.col("d.accn").alias("accession_number"), F.expr("try_to_date(d.`end`, 'yyyy-MM-dd')").alias("end"), F.col("d.val").alias("value")
    )


def first_source(sources: list[tuple[str, object]]) -> DataFrame:
    """Rows of the first source that can be read and has any, with ``source``; ``sources`` are names and functions without arguments.

    A source that fails or is empty is passed over; if all are, that is an error that names what went wrong with each.
    """
    faults = []
    for name, read in sources:
        try:
            rows = read()
            if not rows.isEmpty():
                return rows.withColumn("source", F.lit(name))
            faults.append(f"{name}: no rows")
        except Exception as e:  # noqa: BLE001  # any fault of a source is a reason to try the next one
            faults.append(f"{name}: {type(e).__name__}")
    raise ValueError("no source has rows; " + "; ".join(faults))
