"""Helpers shared by the corpus operators: durable cuts of lineage, columns and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt out to.
SALTS = 64
#: Links that a task of the connected components writes, or as many as its partition has: each file costs the executor processes of their own.
LINKS_A_FILE = 50_000


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and return a frame that reads it.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a temporary one is chosen in local mode;
    on a cluster no folder is known to be shared, so that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def attach(rows: DataFrame, keys: list[str], spread: str, values: dict[str, tuple[Callable[[str | Column], Column], Column]]) -> DataFrame:
    """rows with columns for values of their key's rows, in such a way that no task holds all rows of a key.

    values: by name, a function that may be applied in two steps (sum, min, max) and its argument. The rows of a key
    are dealt out over ``SALTS`` parts by ``spread``, each part is summed up, and the parts' values of a key are joined
    to the key's parts, then to the rows. rows is read twice; rows with a null key are left out.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(*keys, "__salt").agg(*[f(x).alias(k) for k, (f, x) in values.items()])
    whole = parts.groupBy(*keys).agg(*[f(k).alias(k) for k, (f, _) in values.items()])
    told = parts.select(*keys, "__salt").join(whole, keys)
    return salted.join(told, [*keys, "__salt"]).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it, letter case aside."""
    held, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """Tells apart rows that repeat a doc_id with another text."""
    return F.xxhash64(text)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected links: (node, component), component being the least node reached.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Each step needs only the minimum of a
    node's neighbours beside its links, which ``attach`` brings there without gathering a hub's links in one task.
    Nodes without links are absent. Null ends are ignored. No step adds links, so the first count tells how many files the
    later ones need, whatever the number of shuffle partitions.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = cut(e.where(F.col("u") > F.col("v")).distinct())
    state = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if tuple(now) == state or now["n"] == 0:
            break
        state, files = tuple(now), -(-now["n"] // LINKS_A_FILE)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = attach(both, ["u"], "v", {"m": (F.min, F.least("u", "v"))})
        large = cut(least.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(files))
        least = attach(large, ["u"], "v", {"m": (F.min, F.col("v"))})
        moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        e = cut(least.select(moved.alias("u"), F.col("m").alias("v")).distinct().coalesce(files))
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def new_folder(spark: SparkSession) -> str:
    """A path for a written table in the shared folder."""
    cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that was written and is not read any more, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bit_test(longs: list[int]) -> Callable[[Column], Column]:
    """Whether the bit of a value's hash is set in a table of bits, a power of two; the same cost for any number of bits."""
    n = 64 * len(longs)
    constant = F.split(F.lit(",".join(str(x - (1 << 64) if x >> 63 else x) for x in longs)), ",").cast("array<bigint>")

    def holds(value: Column) -> Column:
        h = F.pmod(F.xxhash64(value), F.lit(n)).cast("int")
        return F.getbit(F.get(constant, F.shiftright(h, 6)), h.bitwiseAND(63)) == 1

    return holds


def hashed_set(words: list[str], bits: int = 18) -> Callable[[Column], Column]:
    """Whether a word's hash is that of one of ``words``. A share of len(words) / 2**bits of other words passes as well."""
    longs = [0] * ((1 << bits) // 64)
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=42) % (1 << bits)
        longs[h >> 6] |= 1 << (h & 63)
    return bit_test(longs)


def runtime_filter(keys: DataFrame, key: str, bits: int = 20) -> Callable[[Column], Column]:
    """A test that every value of the column ``key`` passes, and of other values those that share a bit with one.

    For rows that are to be joined with keys: fewer of them are then shuffled, unless the keys are too many for the
    2**bits bits (128 KB); a full table lets everything pass, and nothing else changes. The bits are summed up on the cluster.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b")).collect()
    table = bytearray((1 << bits) // 8)
    for r in rows:  # 32,768 bits each
        table[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["b"]
    return bit_test([int.from_bytes(table[k : k + 8], "little") for k in range(0, len(table), 8)])
