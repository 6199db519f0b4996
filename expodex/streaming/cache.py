"""A cache with expiry and a bound, one for each key, as keyed state of a stream or in one sorted pass over a table.

Every row asks the cache of its key for an entry. An entry that was stored less than `ttl` seconds ago
is a hit; else the entry is fetched and stored at the row's time. If more than `most` entries are held
when one is to be stored, the `evict` oldest leave first. Expired entries are held no more.

Defined results: rows without a key, an entry or a time are answered as misses (stored_at is NULL if the time is)
and nothing is stored; rows of equal time are asked in the order of `ord`; repeated rows each ask; a row that comes
late, but within the watermark, hits what was stored after its time; empty tables give empty results.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: An hour, and how many entries leave when there are more than that.
TTL, MOST, EVICT = 3600, 5000, 500
# End of fixed values.

ASKED = "key string, entry string, at timestamp, ord long, hit boolean, stored_at timestamp"


class Entries:
    """What one key's cache holds, oldest first, for a pass over rows in order."""

    def __init__(self, ttl: int, most: int, evict: int):
        self.held: OrderedDict[str, int] = OrderedDict()
        self.ttl, self.most, self.evict = ttl * 1_000_000, most, evict

    def ask(self, entry: str, at: int) -> tuple[bool, int]:
        """(hit, when the answer was stored), in microseconds; times do not fall."""
        while self.held and at - next(iter(self.held.values())) >= self.ttl:
            self.held.popitem(last=False)
        if entry in self.held:
            return True, self.held[entry]
        if len(self.held) > self.most:
            for _ in range(min(self.evict, len(self.held))):
                self.held.popitem(last=False)
        self.held[entry] = at
        return False, at


def asked(rows: DataFrame, ttl: int = TTL, most: int = MOST, evict: int = EVICT) -> DataFrame:
    """rows (key, entry, at, ord) of a table -> ASKED: what a cache that saw them in order would have said.

    Keys are dealt to tasks and sorted there; a task holds one key's entries at a time, so memory is bounded by `most`
    whatever the number of a key's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cache = None, Entries(ttl, most, evict)
        for batch in batches:
            hits, stored = [], []
            for key, entry, at in zip(batch.column("key").to_pylist(), batch.column("entry").to_pylist(), batch.column("__at").to_pylist(), strict=True):
                if key is None or entry is None or at is None:
                    hits.append(False)
                    stored.append(at)
                    continue
                if key != last:
                    last, cache = key, Entries(ttl, most, evict)
                hit, since = cache.ask(entry, at)
                hits.append(hit)
                stored.append(since)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "entry", "at", "ord")), pa.array(hits, pa.bool_()), pa.array(stored, pa.int64())], names=["key", "entry", "at", "ord", "hit", "since"])

    plain = rows.select(F.col("key").cast("string").alias("key"), F.col("entry").cast("string").alias("entry"), F.col("at").cast("timestamp").alias("at"), F.col("ord").cast("long").alias("ord"))
    # Rows that only miss need no cache; they are dealt evenly.
    dealt = plain.withColumn("__at", F.unix_micros("at")).repartition("key", F.when(F.col("entry").isNull() | F.col("at").isNull() | F.col("key").isNull(), F.col("ord")))
    out = dealt.sortWithinPartitions("key", "at", "ord", "entry").mapInArrow(run, "key string, entry string, at timestamp, ord long, hit boolean, since long")
    return out.select("key", "entry", "at", "ord", "hit", F.timestamp_micros("since").alias("stored_at"))


class Cache(StatefulProcessor):
    """One key's entries as a map in the state store; a timer at the end of each entry's time removes it. Times are microseconds."""

    def __init__(self, ttl: int = TTL, most: int = MOST, evict: int = EVICT):
        self.ttl, self.most, self.evict = ttl * 1_000_000, most, evict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "entry string", "at long, n long")
        self.counts = handle.getValueState("counts", "held long, next long")

    def _counts(self) -> tuple[int, int]:
        return tuple(self.counts.get()) if self.counts.exists() else (0, 0)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: (r["us"] is not None, r["us"], r["ord"] is not None, r["ord"], r["entry"] or ""))
        entries = {r["entry"] for r in rows if r["us"] is not None and r["entry"] is not None} if key[0] is not None else set()
        count, following = self._counts() if entries else (0, 0)
        before = self._read(entries, count)
        held = dict(before)
        for row in rows:
            entry, at = row["entry"], row["us"]
            hit, since = False, at
            if entry in entries and at is not None:
                hit, since = self._ask(held, entry, at, following)
                following += not hit
            yield Row(key=key[0], entry=entry, us=at, ord=row["ord"], hit=hit, since=since)
        if held != before:
            self._write(held, before)
            self.counts.update((count + len(held) - len(before), following))

    def _read(self, entries: set[str], count: int) -> dict[str, tuple[int, int]]:
        """What is held of these entries: all that is held where it is little beside them, or where some must leave."""
        if not count:
            return {}
        if count + len(entries) > self.most or count <= 4 * len(entries):
            return {k[0]: tuple(v) for k, v in self.held.iterator()}
        return {e: tuple(self.held.getValue((e,))) for e in entries if self.held.containsKey((e,))}

    def _ask(self, held: dict[str, tuple[int, int]], entry: str, at: int, number: int) -> tuple[bool, int]:
        known = held.pop(entry, None)
        if known is not None and at - known[0] < self.ttl:
            held[entry] = known
            return True, known[0]
        if len(held) > self.most:  # `most` and one, and what has expired since the last timer
            for e in [e for e, v in held.items() if at - v[0] >= self.ttl]:
                del held[e]
            if len(held) > self.most:
                for e in sorted(held, key=lambda e: held[e][1])[: self.evict]:
                    del held[e]
        held[entry] = (at, number)
        return False, at

    def _write(self, held: dict[str, tuple[int, int]], before: dict[str, tuple[int, int]]) -> None:
        """The state is written once a batch, however many rows asked."""
        for e in before.keys() - held.keys():
            self.held.removeKey((e,))
        new = {e: v for e, v in held.items() if before.get(e) != v}
        for e, v in new.items():
            self.held.updateValue((e,), v)
        for ms in {-(-(at + self.ttl) // 1000) for at, _ in new.values()}:
            self.handle.registerTimer(ms)

    def _remove(self, entries: list[tuple]) -> None:
        for k in entries:
            self.held.removeKey(k)
        held, following = self._counts()
        self.counts.update((held - len(entries), following))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        self._remove([k for k, v in list(self.held.iterator()) if v[0] + self.ttl <= until])
        return iter(())

    def close(self) -> None:
        pass


def asked_stream(stream: DataFrame, ttl: int = TTL, most: int = MOST, evict: int = EVICT, late: str = "10 minutes") -> DataFrame:
    """A stream of (key, entry, at, ord) -> ASKED, by keyed state that expires with the watermark.

    Rows later than the watermark are dropped, as in every operator with event time. The session needs the
    state store that keeps several states a key (RocksDB), which with_state_store() sets.
    """
    rows = stream.select(F.col("key").cast("string").alias("key"), F.col("entry").cast("string").alias("entry"), F.col("at").cast("timestamp").alias("at"), F.col("ord").cast("long").alias("ord"))
    keyed = rows.withWatermark("at", late).withColumn("us", F.unix_micros("at")).groupBy("key")
    out = keyed.transformWithState(statefulProcessor=Cache(ttl, most, evict), outputStructType="key string, entry string, us long, ord long, hit boolean, since long", outputMode="Append", timeMode="EventTime")
    return out.select("key", "entry", F.timestamp_micros("us").alias("at"), "ord", "hit", F.timestamp_micros("since").alias("stored_at"))


def with_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
