"""Streaming operators: live stacking, latest properties, windows with lateness, and keyed guiding state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesperflow.session import scratch_path


def live_stack(pixels: DataFrame, by: list[str], value: str = "value", weight: str | None = None) -> DataFrame:
    """Running sum, average and weighted average of each pixel; the same partial sums as the batch stack."""
    w = F.col(weight) if weight else F.lit(1.0)
    return pixels.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("average"), (F.sum(F.col(value) * w) / F.sum(w)).alias("weighted_average"))


def latest(messages: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last value of each key by `order`: what define and update messages leave behind."""
    return messages.groupBy(*keys).agg(*(F.max_by(v, F.struct(*order)).alias(v) for v in values), F.count("*").alias("updates"))


def windowed(events: DataFrame, ts: str, width: str, lateness: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums of tumbling windows; rows later than `lateness` behind the newest are left out."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    g = e.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n", "total")


def properties(messages: DataFrame, xml: str = "value") -> DataFrame:
    """(device, property, state, elements) of instrument property messages in XML text."""
    schema = "_device string, _name string, _state string, oneNumber array<struct<_name:string,_VALUE:string>>, oneText array<struct<_name:string,_VALUE:string>>, oneSwitch array<struct<_name:string,_VALUE:string>>"
    d = messages.select("*", F.from_xml(F.col(xml), schema).alias("_d"))
    items = F.flatten(F.filter(F.array("_d.oneNumber", "_d.oneText", "_d.oneSwitch"), lambda x: x.isNotNull()))
    elements = F.map_from_entries(F.transform(items, lambda e: F.struct(e["_name"].alias("key"), F.trim(e["_VALUE"]).alias("value"))))
    return d.select(*messages.columns, F.col("_d._device").alias("device"), F.col("_d._name").alias("property"), F.col("_d._state").alias("state"), elements.alias("elements"))


_STATE = "last double, output double, n long, dropped long"


def guide(frames: DataFrame, session: str, ts: str, error: str, aggressiveness: float = 0.7, hysteresis: float = 0.1, least: float = 0.0, gap: float = 5.0) -> DataFrame:
    """(session, n, dropped, output): the correction after each batch's frames of a guiding session.

    Corrections are a mixture of the new and the previous error, none below a least move; frames more than `gap`
    seconds after the one before count as dropped ones in between. State is kept by session across batches.
    """
    kind = frames.schema[session].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, out, n, dropped = state.get if state.exists else (float("nan"), 0.0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "e"], kind="stable")
        for t, e in zip(rows["t"], rows["e"], strict=True):
            if last == last and t - last > gap:
                dropped += int((t - last) // gap)
            out = (1 - hysteresis) * aggressiveness * e + hysteresis * out
            out = out if abs(out) >= least else 0.0
            last, n = float(t), n + 1
        state.update((last, float(out), int(n), int(dropped)))
        yield pd.DataFrame({session: [key[0]], "n": [n], "dropped": [dropped], "output": [out]})

    d = frames.select(session, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"), F.col(error).cast("double").alias("e"))
    return d.groupBy(session).applyInPandasWithState(step, f"{session} {kind}, n long, dropped long, output double", _STATE, "update", "NoTimeout")


def settle(stream: DataFrame, mode: str, name: str = "result", keys: list[str] | None = None) -> DataFrame:
    """Run a streaming query over all that is there now and return what it leaves.

    Appended rows of all batches; the last batch of a complete result; of an updated one the last row of each of
    `keys`, the first column unless given. A batch writes a folder of its own, and writes it again if it runs again.
    """
    spark, keys = stream.sparkSession, keys or stream.columns[:1]
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    last: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        last[:] = [batch]

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/batch={last[0]}")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", out).parquet(out)
    if mode == "append":
        return rows.select(*stream.columns)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys and c != "batch")), "batch").alias("_s"))
    return newest.select(*keys, "_s.*").select(*stream.columns)


def sessions(events: DataFrame, ts: str, gap: str, lateness: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums of runs of events with less than `gap` between them; rows later than `lateness` are left out."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    g = e.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "n", "total")


def _drain(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None]) -> None:
    """Hand all batches that are there now to `write`."""
    q = stream.writeStream.option("checkpointLocation", scratch_path(stream.sparkSession, f"{name}-checkpoint")).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()


def collect(stream: DataFrame, snapshot: Callable[[DataFrame], DataFrame], name: str = "samples") -> DataFrame:
    """Samples gathered as they come, and after each batch the snapshot made anew of all so far; the last one returned.

    Batches append to a table of their own folders, so a batch that runs again replaces its rows.
    """
    spark = stream.sparkSession
    out, shots = scratch_path(spark, name), scratch_path(spark, f"{name}-snapshots")
    last: list[str] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        every = spark.read.schema(stream.schema).option("basePath", out).parquet(out).select(*stream.columns)
        snapshot(every).write.mode("overwrite").parquet(f"{shots}/{batch}")
        last[:] = [f"{shots}/{batch}"]

    _drain(stream, name, write)
    return spark.read.parquet(last[0]) if last else snapshot(spark.createDataFrame([], stream.schema))


def fan_out(stream: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], name: str = "handlers") -> dict[str, DataFrame]:
    """What each handler makes of every batch, by its name; a batch is read once for all of them."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            for k, f in handlers.items():
                f(df).write.mode("overwrite").parquet(f"{out}/{k}/batch={batch}")
        finally:
            df.unpersist()

    _drain(stream, name, write)
    return {k: spark.read.option("basePath", f"{out}/{k}").parquet(f"{out}/{k}") for k in handlers}


def machine(frames: DataFrame, key: str, order: list[str], columns: list[str], start: dict, step: Callable[[dict, tuple], dict], state: str) -> DataFrame:
    """(key, state columns): a machine for each key that takes its rows in order, batch after batch.

    `start` is a key's first state and `step(state, row)` the next one, row being a tuple of `columns`; `state` is the
    state's schema. Rows of a key in one batch are ordered by `order`, batches by their arrival.
    """
    kind = frames.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in state.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, held.get, strict=True)) if held.exists else dict(start)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for row in rows[columns].itertuples(index=False, name=None):
            now = step(now, row)
        held.update(tuple(now[n] for n in names))
        yield pd.DataFrame({key: [k[0]], **{n: [now[n]] for n in names}})

    need = list(dict.fromkeys([key, *order, *columns]))
    return frames.select(*need).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {state}", state, "update", "NoTimeout")


#: An autofocus run: the best size so far and where, the last size, rises in a row, samples taken, whether it is over.
FOCUS = "best double, place long, last double, rises long, taken long, done boolean"
FOCUS_START = {"best": float("inf"), "place": -1, "last": float("inf"), "rises": 0, "taken": 0, "done": False}


def focus_step(most: int = 3) -> Callable[[dict, tuple], dict]:
    """Steps of an autofocus run over rows (place, size): it ends when the size has risen so often in a row."""

    def step(s: dict, row: tuple) -> dict:
        if s["done"]:
            return s
        place, size = int(row[0]), float(row[1])
        rises = s["rises"] + 1 if size > s["last"] else 0
        better = size < s["best"]
        return {"best": size if better else s["best"], "place": place if better else s["place"], "last": size, "rises": rises, "taken": s["taken"] + 1, "done": rises >= most}

    return step


#: A guide calibration: pulses given, where it began, the largest way so far, the rate, whether it is over.
CALIBRATION = "pulses long, origin double, way double, rate double, done boolean"
CALIBRATION_START = {"pulses": 0, "origin": float("nan"), "way": 0.0, "rate": 0.0, "done": False}


def calibration_step(least: float, most: int) -> Callable[[dict, tuple], dict]:
    """Steps of a calibration over rows (position,): pulses go on until the star has moved far enough or too many were
    given; the rate is the way by pulses."""

    def step(s: dict, row: tuple) -> dict:
        if s["done"]:
            return s
        x = float(row[0])
        if s["origin"] != s["origin"]:
            return {**s, "origin": x}
        n, way = s["pulses"] + 1, abs(x - s["origin"])
        return {**s, "pulses": n, "way": way, "rate": way / n, "done": way >= least or n >= most}

    return step


def ring(n: int) -> Callable[[dict, tuple], dict]:
    """Steps of a buffer of the last n values of rows (value,)."""
    return lambda s, row: {"values": [*s["values"], row[0]][-n:], "seen": s["seen"] + 1}


def polled(name: str, schema: str, read: Callable[[int], list[tuple]]) -> type:
    """A streaming source, for `spark.dataSource.register`, that asks `read(k)` for rows at every trigger, k counting up."""
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"k": 0}

        def read(self, start: dict) -> tuple:
            return iter(read(start["k"])), {"k": start["k"] + 1}

        def readBetweenOffsets(self, start: dict, end: dict):
            return iter([x for k in range(start["k"], end["k"]) for x in read(k)])

        def commit(self, end: dict) -> None:
            pass

    own_name, own_schema = name, schema

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return own_name

        def schema(self) -> str:
            return own_schema

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Reader()

    return Source
