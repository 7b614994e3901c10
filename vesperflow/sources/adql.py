"""Remote star catalogues: query text with what can be pushed down, rows of the service's answer, a Python data source."""

from __future__ import annotations

import math
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Service:
    """Where a service's columns are: an object table, joined to a table of fluxes where magnitudes lie there."""

    table: str
    id: str
    ra: str
    dec: str
    mag: str
    join: str = ""


#: The two layouts in use: magnitudes in a table of their own, and all in one.
JOINED = Service("basic b", "b.oid", "b.ra", "b.dec", "f.V", " JOIN allfluxes f ON f.oidref = b.oid")
SINGLE = Service("gaia", "source_id", "ra", "dec", "gmag")


def magnitudes(mag: str, low: float | None, high: float | None) -> str:
    """Magnitudes that are there and within the bounds given."""
    return " AND ".join([f"{mag} IS NOT NULL", *([f"{mag} >= {low!r}"] if low is not None else []), *([f"{mag} <= {high!r}"] if high is not None else [])])


def query_text(service: Service, boxes: list, low: float | None = None, high: float | None = None, top: int | None = None, limit: bool = False) -> str:
    """The brightest stars of some boxes (regions with `sql`), in degrees; `limit` says LIMIT for TOP, as local engines do."""
    where = " OR ".join(b.sql(service.ra, service.dec, degrees=True) for b in boxes)
    head, tail = (f"TOP {top} ", "") if top is not None and not limit else ("", f" LIMIT {top}" if top is not None else "")
    return f"SELECT {head}{service.id} AS id, {service.ra} AS ra, {service.dec} AS decl, {service.mag} AS mag FROM {service.table}{service.join} WHERE ({where}) AND {magnitudes(service.mag, low, high)} ORDER BY mag, id{tail}"


def rows(answer: Column) -> Column:
    """The rows of a tab-separated answer with a heading, fields trimmed and unquoted, as an array of arrays."""
    lines = F.filter(F.split(answer, r"\r?\n"), lambda x: F.trim(x) != "")
    return F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.transform(F.split(x, "\t"), lambda f: F.regexp_replace(F.trim(f), '^"|"$', "")))


def stars(answers: DataFrame, answer: str = "value") -> DataFrame:
    """(id, ra, decl, mag) of answers, angles in radians; rows that lack one or have none finite are left out."""
    r = answers.select(F.explode(rows(F.col(answer))).alias("r"))
    num = lambda i: F.when(~F.isnan(F.get("r", F.lit(i)).try_cast("double")) & (F.abs(F.get("r", F.lit(i)).try_cast("double")) < float("inf")), F.get("r", F.lit(i)).try_cast("double"))
    return r.select(F.get("r", F.lit(0)).try_cast("long").alias("id"), (num(1) * (math.pi / 180)).alias("ra"), (num(2) * (math.pi / 180)).alias("decl"), num(3).alias("mag")).dropna()


def fetch(url: str, query: str, timeout: float = 60.0) -> str:
    """The service's tab-separated answer to a query."""
    body = urllib.parse.urlencode({"request": "doQuery", "lang": "adql", "format": "tsv", "query": query}).encode()
    with urllib.request.urlopen(urllib.request.Request(url, body), timeout=timeout) as r:
        return r.read().decode("utf-8", "replace")


_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class CatalogueReader(DataSourceReader):
    """Reads a table of a service; comparisons with numbers go into its query, the rest stays with Spark."""

    def __init__(self, schema: StructType, options: dict, ask: Callable[[str, str], str] = fetch):
        self.schema, self.options, self.ask, self.pushed = schema, options, ask, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _SIGNS and len(f.attribute) == 1 and isinstance(f.value, int | float) and not isinstance(f.value, bool):
                self.pushed.append(f"{f.attribute[0]} {_SIGNS[type(f)]} {f.value!r}")
            else:
                yield f

    def text(self) -> str:
        where = f" WHERE {' AND '.join(self.pushed)}" if self.pushed else ""
        return f"SELECT {', '.join(self.schema.names)} FROM {self.options['table']}{where}"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        kinds = [f.dataType.typeName() for f in self.schema]
        put = {"integer": int, "long": int, "short": int, "double": float, "float": float}
        for line in self.ask(self.options["url"], self.text()).splitlines()[1:]:
            if line.strip():
                yield tuple(None if v.strip() in ("", '""') else put.get(k, str)(v.strip().strip('"')) for v, k in zip(line.split("\t"), kinds, strict=True))


class CatalogueSource(DataSource):
    """spark.read.format("catalogue").schema(..).option("url", ..).option("table", ..): a table of a remote service."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CatalogueReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the "catalogue" format known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogueSource)
