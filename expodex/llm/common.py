"""What the operators share: table access, bounded Arrow chunks, scratch tables, word hashing.

Scratch tables go to the folder named by ``spark.checkpoint.dir`` (shared by all executors), so a
lost executor never loses one. They are ordinary Parquet tables with random names.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a temporary one only where the setting is absent and nothing runs on other machines."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own_scratch:
        _own_scratch["dir"] = tempfile.mkdtemp(prefix="expodex-")
        atexit.register(shutil.rmtree, _own_scratch["dir"], True)
    return f"file://{_own_scratch['dir']}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared scratch folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by stored() that nothing reads any more; any other table is left alone."""
    path = getattr(df, "_scratch", None)
    if path is not None:
        removed(df.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: A key is hot if it holds more than 1 / HOT of all rows: at most HOT keys are.
HOT = 1024


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows joined (inner) with table, one row a key, on keys that are never null.

    weight: column of table, the number of rows with the key (it is not returned); total: their sum or
    more. The rows of a hot key are dealt, by a hash of the whole row, to parts of about total / HOT rows,
    each of which gets the key's row of the table; the list of hot keys, HOT rows at most, is broadcast.
    """
    parts = F.ceil(F.col(weight) * F.lit(HOT) / F.lit(float(max(total, 1)))).cast("int")
    shared = table.select("*", parts.alias("__parts"))
    hot = shared.filter("__parts > 1").select(*keys, "__parts")
    spread = shared.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts", weight)
    names = rows.columns
    dealt = F.coalesce(F.pmod(F.xxhash64(*names), F.col("__parts")).cast("int"), F.lit(0))
    held = rows.join(F.broadcast(hot), keys, "left").select(*names, dealt.alias("__part"))
    return held.join(spread, [*keys, "__part"]).drop("__part")


#: Rows of an Arrow batch: with texts of some kilobytes a batch stays below ten megabytes on both sides of the pipe.
BATCH_ROWS = 2000


def bounded_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, unless they are smaller."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose `column` holds about `limit` bytes each (one long value may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    flat = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return flat, offsets - first


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes of words between white space, and bytes of words of ASCII letters, digits and all beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            made = []
            for base in (_P, _P_INV):
                a = np.empty(size, np.uint64)
                a[0] = 1
                filled = 1
                step = base
                while filled < size:
                    a[filled : 2 * filled] = a[:filled] * step
                    step = step * step
                    filled *= 2
                made.append(a)
        if len(_powers) > 2:
            _powers.clear()
        _powers[size] = (made[0], made[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x = x * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def words(flat: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows at once: (start, end, hash of the word with A-Z folded, first word of each row [+1])."""
    n = len(flat)
    low = _FOLD[flat]
    inside = kind[low]
    edge = np.zeros(n + 1, bool)
    if n:
        edge[1:n] = inside[1:] != inside[:-1]
        edge[0] = inside[0]
        edge[n] = inside[-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        cuts = np.unique(cuts)
        both = cuts[inside[cuts] & inside[cuts - 1]]  # two rows meet inside a word: it ends and another begins
    else:
        both = np.zeros(0, np.int64)
    at = np.flatnonzero(edge)
    if len(both):
        at = np.sort(np.concatenate([at, both, both]), kind="stable")
    starts, ends = at[0::2], at[1::2]
    power, inverse = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[low] * power[:n], out=sums[1:])
        hashed = mix((sums[ends] - sums[starts]) * inverse[starts])
    return starts, ends, hashed, np.searchsorted(starts, offsets)


def shingles(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; a shorter, non-empty sequence counts as one."""
    n = len(hashed)
    width = min(width, n)
    with np.errstate(over="ignore"):
        out = hashed[: n - width + 1].copy() if n else hashed
        for k in range(1, width):
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashed[k : n - width + 1 + k]
    return mix(out + np.uint64(width)) if n else out


class HashIndex:
    """Places of distinct 64-bit keys, found for whole arrays at once (buckets by the keys' top bits)."""

    def __init__(self, keys: np.ndarray, mixed: bool = True):
        self.mixed = mixed
        hashed = keys if mixed else mix(keys.astype(np.uint64))
        self.order = np.argsort(hashed, kind="stable")
        self.keys = hashed[self.order]
        self.bits = max(8, min(22, int(len(keys) * 2).bit_length()))
        self.first = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int64)
        self.size = np.diff(np.append(self.first, len(keys)))
        self.n = len(keys)
        self.keys = np.append(self.keys, np.uint64(0))
        self.place = np.append(self.order, -1).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Index in the constructor's keys, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        if not self.n or not len(wanted):
            return out
        wanted = wanted if self.mixed else mix(wanted.astype(np.uint64))
        slot = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        at, size = self.first[slot], self.size[slot]
        hit = (self.keys[at] == wanted) & (size > 0)
        out[hit] = self.place[at[hit]]
        rest = np.flatnonzero(~hit & (size > 1))
        step = 1
        while len(rest):
            here = at[rest] + step
            hit = self.keys[here] == wanted[rest]
            out[rest[hit]] = self.place[here[hit]]
            step += 1
            rest = rest[~hit & (size[rest] > step)]
        return out
