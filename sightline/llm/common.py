"""What several operators share: intermediate tables, Arrow tokenising, hashing."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:  # large arrays go back to the system when they are freed, so that a worker which lives on holds no more than it uses
    ctypes.CDLL(None).mallopt(-3, 1 << 20)
except (OSError, AttributeError):  # not glibc
    pass

#: White space that separates words: space, and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


#: Narrow rows in a file of an intermediate table, where their number is known.
ROWS_A_FILE = 20_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; where that is unset, a temporary one, on one machine only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sightline-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def modest(spark: SparkSession) -> None:
    """Rows sent to Python at once: texts can be long, so fewer than Spark's default, unless the session has a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1500")


class Scratch:
    """Tables written to the shared folder: they cut lineage, and outlive a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.n = spark, shared_dir(spark), 0
        modest(spark)

    def table(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Writes df and reads it again. rows: about how many narrow rows it has at most; few rows need no more than a few files."""
        self.n += 1
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
        path = f"{self.at}/{self.n}"
        # once the table is written its shuffles have no more readers; Spark then deletes their files
        name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(name, "false")
        self.spark.conf.set(name, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(name, before)
        if self.n == 1:  # what nobody drops goes with the driver: results may be read until then
            root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at)
            root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads, and lets Spark free the shuffles that made them."""
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.free()

    def free(self) -> None:
        """Finished shuffles go when the driver collects its garbage."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def quoted(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without_results(names: Iterable[str], results: Iterable[str]) -> list[str]:
    """The columns that stay: all but those named like a result, which takes their place."""
    gone = {r.lower() for r in results}
    return [c for c in names if c.lower() not in gone]


def carried(df: DataFrame, names: Iterable[str]) -> tuple[list[Column], list[Column]]:
    """Columns under plain names c0, c1, ..., which neither clash nor hold dots, and the same columns back under their own names."""
    names = list(names)
    return [quoted(c).alias(f"c{i}") for i, c in enumerate(names)], [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo n: the held-out rule of the learning operators."""
    return F.crc32(key.cast("string")) % n


def sliced(batches: Iterable[pa.RecordBatch], col: str, limit: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a text column has at most limit bytes in each, but for a single longer text."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start, total = np.cumsum(size), 0, 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, total + limit, "right")))
            yield b.slice(start, stop - start)
            pa.default_memory_pool().release_unused()
            start, total = stop, int(ends[stop - 1])


def words(text: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and where each text's words begin (one more entry than texts). A null text has none."""
    t = pc.fill_null(text.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(t)
    flat = lists.flatten()
    per = lists.offsets.to_numpy().astype(np.int64)
    per = per - per[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        flat = flat.filter(pa.array(full))
        per = np.concatenate([[0], np.cumsum(full)])[per]
    return (pc.ascii_lower(flat) if lower else flat), per  # lower case last: ascii_lower mishandles slices of large strings


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's place among the distinct words, and those."""
    if len(flat) == 0:
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def hashed(vocab: pa.Array) -> np.ndarray:
    """64-bit hashes of words."""
    from xxhash import xxh3_64_intdigest as h

    return np.fromiter((h(x) for x in vocab.to_pylist()), np.uint64, len(vocab))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), for combining hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def parts_for(df: DataFrame, rows_each: int, least: int = 1) -> int:
    """How many groups hold about rows_each rows each."""
    return max(least, -(-df.count() // rows_each))


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first `keys` columns (whole numbers or strings, none null), as one batch for each distinct key."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.ones(b.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        edges = [*np.flatnonzero(new), b.num_rows]
        for s, e in zip(edges[:-1], edges[1:]):
            this = tuple(c[s] for c in cols)
            if held and this != last:
                yield pa.concat_batches(held)
                held = []
            last = this
            held.append(b.slice(s, e - s))
    if held:
        yield pa.concat_batches(held)


def split_by_part(keys: np.ndarray, parts: int, bits: int = 64) -> np.ndarray:
    """Where the parts of sorted hashes begin (one more than parts); a part is a range of hashes."""
    edge = np.array([(i << bits) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edge), [len(keys)]])


def summed_in_parts(rows: DataFrame, ranked: bool = True) -> DataFrame:
    """block, part, keys (packed differences of sorted keys), n (packed, for each key) -> block, part, total and place (packed, for each key).

    total is a key's sum over all blocks; place is its rank in its part by falling total, or, where not ranked, how many blocks have it.
    A block has a key once at most, so no key is more than one entry for each block. One more row for each part, of a null block, has in
    total how many keys have sums 0 to 15 and more, and in place the sum.
    """

    def add(t: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        keys = [np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in t.column("keys")]
        n = np.concatenate([unpack(x.as_py()) for x in t.column("n")])
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)
        if ranked:
            rank = np.empty(len(u), np.int64)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(u))
        else:
            rank = np.bincount(at, minlength=len(u))
        facts = np.bincount(np.minimum(total, 16), minlength=17)
        totals, places = ([pack(x) for x in np.split(y[at], cuts)] for y in (total, rank))
        part = t.column("part")[0].as_py()
        return pa.table({
            "block": pa.array([*t.column("block").to_pylist(), None], pa.int64()), "part": pa.array([part] * (t.num_rows + 1), pa.int32()),
            "total": pa.array([*totals, pack(facts)], pa.binary()), "place": pa.array([*places, pack(np.array([total.sum()]))], pa.binary()),
        })

    return rows.groupBy("part").applyInArrow(add, "block long, part int, total binary, place binary")


def new_name() -> int:
    """A name for a block of rows; a table that has it is written once."""
    import os

    return int.from_bytes(os.urandom(8), "little") >> 1


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0, as planes of bytes: the empty high planes compress to nothing."""
    x = np.ascontiguousarray(x, np.uint64)
    n = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([n]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(n, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :n] = raw.T
    return out.view(np.uint64).ravel()


def asked(block: int, keys: np.ndarray, n: np.ndarray, parts: int, bits: int = 64) -> pa.RecordBatch:
    """A block's sorted keys and counts as rows for summed_in_parts."""
    cut = split_by_part(keys, parts, bits)
    full = np.flatnonzero(np.diff(cut))
    return pa.record_batch({
        "block": pa.array([block] * len(full), pa.int64()), "part": pa.array(full, pa.int32()),
        "keys": pa.array([pack(np.diff(keys[cut[p] : cut[p + 1]], prepend=np.uint64(0))) for p in full], pa.binary()), "n": pa.array([pack(n[cut[p] : cut[p + 1]]) for p in full], pa.binary()),
    })
