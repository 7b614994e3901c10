"""Services that answer page by page or with a picture; the caller's function does the asking."""

from __future__ import annotations

import json
import math
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fetch(url: str, timeout: float = 60.0) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read()


def answers(ask: Callable[[int], str | bytes | None], first: int = 1) -> Iterator[tuple[int, str]]:
    """(page, text) of a service's pages: on as long as an answer names a next one; an empty answer ends them."""
    page = first
    while text := ask(page):
        text = text.decode() if isinstance(text, bytes) else text
        yield page, text
        if not json.loads(text).get("next"):
            return
        page += 1


def paged(spark: SparkSession, ask: Callable[[int], str | bytes | None], row: str, first: int = 1) -> DataFrame:
    """The rows of all pages of {count, next, results: [..]}, each of schema `row`. Pages are a service's lists of devices."""
    pages = spark.createDataFrame(list(answers(ask, first)), "page int, value string")
    return pages.select("page", F.explode(F.from_json("value", f"results array<struct<{row}>>")["results"]).alias("r")).select("page", "r.*")


def cutout_url(base: str, survey: str, ra: float, dec: float, fov: float, width: int = 1200, height: int = 900, rotation: float = 0.0, projection: str = "TAN", frame: str = "icrs", kind: str = "fits") -> str:
    """Where a survey's picture of a field is: angles in radians, the answer an image of so many pixels."""
    d = math.degrees
    return f"{base.rstrip('/')}/hips-image-services/hips2fits?" + urllib.parse.urlencode({"hips": survey, "ra": d(ra), "dec": d(dec), "width": width, "height": height, "projection": projection, "fov": d(fov), "coordsys": frame, "rotation_angle": d(rotation), "format": kind}, safe="/:")


def cutouts(fields: DataFrame, base: str, survey: str, fov: float, ask: Callable[[str], bytes] = fetch, **options) -> DataFrame:
    """(name, content) of the pictures of fields (name, ra, decl), asked for by the tasks; write them or decode them as files."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [ask(cutout_url(base, survey, a, d, fov, **options)) for a, d in zip(b["ra"], b["decl"], strict=True)]
            yield pd.DataFrame({"name": b["name"], "content": got})

    return fields.select("name", "ra", "decl").mapInPandas(run, "name string, content binary")
