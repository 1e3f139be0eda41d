"""Shared pieces of the training-data operators: tables, scratch tables, arrays, word splitting.

Scratch tables live under ``spark.checkpoint.dir`` (shared by driver and executors), so a lost
executor never loses them.  Only where that setting is unset and the master is local (tests, notebooks) a local folder is used.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of every contract of this package.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
LOWER = (bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is named and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "graphloom-checkpoints")
    return at.rstrip("/")


#: Folders, inside the application's, that scratch tables go to now.
_SCOPES: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    return "/".join([shared_dir(spark), "graphloom", spark.sparkContext.applicationId, *_SCOPES, f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch tables made inside are deleted at the end; what reads them must be written elsewhere by then."""
    path = scratch_path(spark, "scope")
    _SCOPES.append(path.rpartition("/")[2])
    try:
        yield
    finally:
        _SCOPES.pop()
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write *df* to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application (results that read them must be written first)."""
    delete(spark, f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}")


def release(spark: SparkSession) -> bool:
    """Let go of what the driver holds of queries that are done; false where the JVM cannot return native memory.

    Plans that nothing names any more are collected, so Spark removes their shuffles and broadcasts, and the heap shrinks (what
    Python lets go of reaches the JVM a moment later, so the last ones go in the next call).
    The memory that compilers and the many threads of broadcasts and query stages have freed is returned to the system:
    the C library keeps it otherwise, some hundred megabytes after a few hundred queries.
    """
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    gc.collect()
    jvm.java.lang.System.gc()
    kinds, values = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
    of = jvm.java.lang.Class.forName
    kinds[0], kinds[1], kinds[2], kinds[3] = (of(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    values[2], values[3] = new_array(jvm.java.lang.Object, 0), new_array(jvm.java.lang.String, 0)
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()  # its class is hidden, its interface is not
    try:
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)
    except Py4JJavaError:  # a JVM without this command
        return False
    return True


def slices(batches, rows: int = 256):
    """Record batches of at most *rows* rows: what a kernel makes of a batch is then bounded, whatever Spark's batch size."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def words(text: str) -> list[str]:
    """``[^\\x20\\x09-\\x0D]+`` words; bytes.split cuts at exactly these six characters."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def fresh(name: str, columns: list[str]) -> str:
    """*name*, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with *value* evaluated once, also where *body* uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_totals(numbers: Column, chunk: int = 128) -> Column:
    """[0, a0, a0+a1, ...] (one longer than *numbers*), natively, in near linear time for arrays of any length.

    Plain array appends copy the array at each step; two levels keep a copy under *chunk* entries
    or under size/chunk entries.
    """
    zero = F.lit(0).cast("bigint")

    def grow(xs: Column, first: Column) -> Column:
        return F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def total(a: Column) -> Column:
        def step(i: Column) -> Column:
            return F.slice(a, i * chunk + 1, F.lit(chunk))

        n = F.size(a)
        starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
        sums = F.transform(starts, lambda i: F.aggregate(step(i), zero, lambda x, y: x + y))
        return let(
            grow(sums, zero),
            lambda bases: F.concat(
                F.array(zero),
                F.flatten(F.transform(starts, lambda i: F.slice(grow(step(i), F.element_at(bases, i + 1)), F.lit(2), F.lit(chunk)))),
            ),
        )

    return let(F.transform(numbers, lambda x: x.cast("bigint")), total)


def spans_of(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start:long,end:long,match:string,part:string>> of all leftmost non-overlapping matches.

    Matches and the pieces between them alternate, so their lengths give the code-point offsets; *part* is *group*.
    """

    def located(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        lengths = F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(F.length(g), F.length(m))))

        def build(totals: Column) -> Column:
            return F.transform(found, lambda m, i: F.struct(F.element_at(totals, i * 2 + 2).alias("start"), F.element_at(totals, i * 2 + 3).alias("end"), m.alias("match"), m.alias("part")))

        return let(running_totals(lengths), build)

    plain = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    if group:
        plain = F.zip_with(plain, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda s, p: s.withField("part", p))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string,part:string>>")
    return F.when(text.rlike(pattern), plain).otherwise(none)
