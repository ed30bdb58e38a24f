"""Runs and look-back over streams, with tables as state.

A batch's work is DataFrame operators over the batch and the part of the state it touches; no
key's rows are gathered in one Python group and no pairs are built. State lies beside the
checkpoint in folders that a batch writes whole, so a batch that is repeated after a failure finds
the state it found before and leaves the same. What a drain gives does not depend on how
rows fall into files and batches, in whatever order they come.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.operators.joins import asof_join
from sightline.operators.ordered import CHUNK_TICKS, running_total, tick_chunk
from sightline.session import staged
from sightline.streaming.jobs import _drain, last_committed

#: How an aggregate of a run is made from those of its pieces.
FOLDS = {"min": F.min, "max": F.max, "sum": F.sum}


def _joined(pieces: DataFrame, keys: Sequence[str], folds: Mapping[str, str], width: int) -> DataFrame:
    """Intervals that touch made one: per key ``start``, ``end`` and the folded columns.

    Intervals of a key are disjoint. Where one begins at the end of the one before, its start
    less the length of all before it is the same.
    """
    length = F.col("end") - F.col("start") + 1
    before = running_total(
        pieces, keys, tick_chunk("start", width), ["start"], {"_before": length}, inclusive=False
    )
    return (
        before.withColumn("_place", F.col("start") - F.col("_before"))
        .groupBy(*keys, "_place")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            *[FOLDS[how](n).alias(n) for n, how in folds.items()],
        )
        .drop("_place")
    )


class CarriedRuns:
    """Maximal stretches of a dense sequence where a flag holds, from rows in any order.

    State per key: the known stretches of the sequence (``regions``), and of the runs those that
    touch the border of one (``open``): these may go on. A run within a region is closed and
    leaves the state. Rows in order have one region and at most two open runs a key. A row
    whose place is known already is refused and counted; of rows of one batch with the same
    place one is taken, with the flag if any has it.
    """

    def __init__(
        self,
        keys: Sequence[str],
        seq: str,
        flag: Column,
        aggs: Mapping[str, tuple[str, Column]] | None = None,
        *,
        width: int = CHUNK_TICKS,
    ):
        self.keys, self.seq, self.flag, self.width = list(keys), seq, flag, width
        self.aggs = dict(aggs or {})
        self.folds = {n: how for n, (how, _) in self.aggs.items()}

    def _units(self, rows: DataFrame) -> DataFrame:
        """Rows as intervals of length 1, one per place."""
        flag = F.coalesce(self.flag, F.lit(False))
        held = [F.when(flag, c).alias(n) for n, (_, c) in self.aggs.items()]
        placed = rows.select(*self.keys, F.col(self.seq).cast("long").alias("start"), flag.alias("_flag"), *held)
        known = placed.where(F.col("start").isNotNull())
        return known.groupBy(*self.keys, "start").agg(
            F.max("_flag").alias("_flag"), *[F.max(n).alias(n) for n in self.aggs]
        )

    def _new(self, units: DataFrame, regions: DataFrame | None) -> DataFrame:
        """Units with ``_late``: their place lies in a known region."""
        if regions is None:
            return units.withColumn("_late", F.lit(False))
        bounds = regions.select(*self.keys, F.col("start").alias("low"), F.col("end").alias("high"))
        near = asof_join(
            units, bounds, on="start", right_on="low", by=self.keys, take=("high",), width=self.width
        )
        return near.withColumn("_late", F.coalesce(F.col("high") >= F.col("start"), F.lit(False))).drop("high")

    def take(self, rows: DataFrame, state: tuple[DataFrame, DataFrame] | None) -> dict[str, DataFrame]:
        """The state after a batch, the runs it closed, and how many rows it refused."""
        regions, open_ = state or (None, None)
        units = staged(self._new(self._units(rows), regions))
        fresh = units.where("NOT _late").withColumn("end", F.col("start"))
        known = fresh.select(*self.keys, "start", "end")
        hit = fresh.where("_flag").select(*self.keys, "start", "end", *self.aggs)
        if state:
            known, hit = known.unionByName(regions), hit.unionByName(open_)
        known = staged(_joined(known, self.keys, {}, self.width))
        runs = _joined(hit, self.keys, self.folds, self.width)
        bounds = known.select(*self.keys, F.col("start").alias("low"), F.col("end").alias("high"))
        placed = staged(
            asof_join(runs, bounds, on="start", right_on="low", by=self.keys, take=("low", "high"), width=self.width)
        )
        inside = (F.col("low") < F.col("start")) & (F.col("end") < F.col("high"))
        return {
            "regions": known,
            "open": placed.where(~inside).drop("low", "high"),
            "closed": placed.where(inside).drop("low", "high"),
            "refused": units.agg(F.count_if("_late").alias("n")),
        }

    def drain(self, rows: DataFrame, out: str, checkpoint: str) -> tuple[DataFrame, int]:
        """All runs so far, open ones too (start, end, aggregates), and how many rows were refused."""
        spark = rows.sparkSession

        def put(batch: DataFrame, number: int) -> None:
            own = batch.sparkSession
            before = None
            if number > 0:
                before = tuple(own.read.parquet(f"{out}/{t}/turn={(number - 1) % 2}") for t in ("regions", "open"))
            for table, found in self.take(staged(batch), before).items():
                turn = f"turn={number % 2}" if table in ("regions", "open") else f"batch={number}"
                found.write.mode("overwrite").parquet(f"{out}/{table}/{turn}")

        _drain(rows.writeStream.foreachBatch(put), checkpoint)
        last = last_committed(spark, checkpoint)
        if last is None:
            raise ValueError("no batch was ever drained")
        batches = [f"batch={i}" for i in range(last + 1)]
        closed = spark.read.parquet(*[f"{out}/closed/{b}" for b in batches])
        refused = spark.read.parquet(*[f"{out}/refused/{b}" for b in batches]).agg(F.sum("n")).first()[0]
        return closed.unionByName(spark.read.parquet(f"{out}/open/turn={last % 2}")), refused


class CarriedLookback:
    """For every anchor the latest event of a key at or before it, within ``span``.

    State are the anchors and events seen, in folders by stretches of ``part`` ticks. A batch joins its
    anchors as-of to the events, and the anchors seen before to its own events, of the
    stretches within its reach only; an anchor's answer is the latest of all batches.
    """

    def __init__(self, keys: Sequence[str], tick: str, anchor_id: Sequence[str], *, span: int, part: int = CHUNK_TICKS):
        self.keys, self.tick, self.id, self.span, self.part = list(keys), tick, list(anchor_id), span, part

    def _stretch(self, tick: Column) -> Column:
        return F.floor(tick / self.part).cast("long")

    def _reached(self, spark: SparkSession, folder: str, schema: T.StructType, batch: DataFrame, number: int, low: int, high: int) -> DataFrame:
        """Rows of earlier batches in the stretches from ``low`` before to ``high`` after the batch's."""
        stored = T.StructType([*schema.fields, T.StructField("stretch", T.LongType()), T.StructField("batch", T.LongType())])
        stretches = {
            s
            for r in batch.select(self._stretch(F.col(self.tick)).alias("s")).distinct().collect()
            for s in range(r.s - low, r.s + high + 1)
        }
        rows = spark.read.schema(stored).option("basePath", folder).parquet(folder)
        reached = F.col("stretch").isin(*stretches) if stretches else F.lit(False)
        return rows.where(reached & (F.col("batch") < number)).select(schema.names)

    def _latest(self, anchors: DataFrame, events: DataFrame) -> DataFrame:
        fired = events.select(*self.keys, F.col(self.tick).alias("_event"))
        near = asof_join(
            anchors, fired, on=self.tick, right_on="_event", by=self.keys, take=("_event",), within=self.span, how="inner", width=self.part
        )
        return near.select(*self.id, "_event")

    def drain(
        self,
        rows: DataFrame,
        anchors: Callable[[DataFrame], DataFrame],
        events: Callable[[DataFrame], DataFrame],
        out: str,
        checkpoint: str,
    ) -> DataFrame:
        """All anchors (keys, tick, id) with ``event_tick``.

        ``anchors`` and ``events`` give theirs out of a batch of ``rows``.
        """
        spark = rows.sparkSession

        def put(batch: DataFrame, number: int) -> None:
            own = batch.sparkSession
            held = staged(batch)
            columns = list(dict.fromkeys([*self.id, *self.keys, self.tick]))
            new_anchors = anchors(held).select(*columns)
            new_events = events(held).select(*self.keys, self.tick).distinct()
            found = self._latest(new_anchors, new_events)
            if number > 0:
                back, ahead = (self.span + self.part - 1) // self.part, 0
                old_events = self._reached(own, f"{out}/events", new_events.schema, new_anchors, number, back, ahead)
                old_anchors = self._reached(own, f"{out}/anchors", new_anchors.schema, new_events, number, ahead, back)
                found = found.unionByName(self._latest(new_anchors, old_events)).unionByName(
                    self._latest(old_anchors, new_events)
                )
            found.write.mode("overwrite").parquet(f"{out}/found/batch={number}")
            for name, table in (("events", new_events), ("anchors", new_anchors)):
                stored = table.withColumns(
                    {"stretch": self._stretch(F.col(self.tick)), "batch": F.lit(number).cast("long")}
                )
                writer = stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                writer.partitionBy("stretch", "batch").parquet(f"{out}/{name}")

        _drain(rows.writeStream.foreachBatch(put), checkpoint)
        last = last_committed(spark, checkpoint)
        if last is None:
            raise ValueError("no batch was ever drained")
        seen = spark.read.option("basePath", f"{out}/anchors").parquet(f"{out}/anchors").drop("stretch", "batch")
        found = spark.read.parquet(*[f"{out}/found/batch={i}" for i in range(last + 1)])
        latest = found.groupBy(*self.id).agg(F.max("_event").alias("event_tick"))
        return seen.join(latest, self.id, "left")
