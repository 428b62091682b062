"""What several operators of this folder share: scratch tables, batch sizes, joins with hot keys, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_dir as new_dir
from ..scratch import remove as remove
from ..scratch import scope as scope
from ..scratch import shared_dir as shared_dir
from ..scratch import written as written

#: Rows of one Arrow batch: whole texts may be long, so batches are kept small.
ARROW_ROWS = 256
#: A key with one in so many of all rows is hot; there are no more hot keys than that.
SHARES = 1_000


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a Python worker's memory is bounded by a few hundred texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextmanager
def shuffled(spark: SparkSession) -> Iterator[None]:
    """What runs within it joins by shuffles, but for hints: many small joins would each take a table of the driver's memory
    and a thread that stays for a minute."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage, and the driver give free memory back to the system. Spark removes the shuffle
    files and broadcasts of finished queries only then, and in a long chain of small queries heap and allocators grow by what
    nobody needs any more."""
    spark.sparkContext._jvm.System.gc()
    trim_native(spark)
    if own := getattr(ctypes.CDLL(None), "malloc_trim", None):
        own(0)


def release_grown(spark: SparkSession) -> None:
    """`release`, but garbage is collected only where the heap has grown beyond half of what it may have: a collection at every
    step would itself let it grow."""
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        release(spark)
    else:
        trim_native(spark)


def trim_native(spark: SparkSession) -> str | None:
    """Has the driver's JVM return what its C allocator holds free: compilers of a chain of queries and threads that have
    ended leave it in an arena for each thread. What the JVM says, or null where it has no such command (jcmd's
    System.trim_native_heap, with glibc)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # the server's own class is closed to reflection, its interface is not
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = name, "systemTrimNativeHeap"
    try:
        return invoke.invoke(server, args)
    except Py4JJavaError:
        return None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Iterable[str], name: str) -> str:
    """A column name that no column of `taken` has, whatever the case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def words(text: Column, gaps: str) -> Column:
    """The words of a text column: what lies between signs of the class `gaps`. Of a null text: null."""
    return F.array_remove(F.split(text, f"[{gaps}]+"), "")


def with_values(rows: DataFrame, values: DataFrame, key: Sequence[str], many: str | None = None, total: int | None = None) -> DataFrame:
    """rows with the other columns of values (one row for each key), null where there are none.

    `many` of values says how many rows have its key. Hot keys, with one in SHARES of all rows or more, are looked up in
    a broadcast of SHARES rows at most; rows that have one are spread over all tasks of the join that serves the rest.
    Only joins that have something to do are made: no broadcast where no key is hot, no other join where all are. Each
    would take a job, threads and memory of the driver. Without `many`, rows are counted by key here.
    """
    if many is None:
        many = "__many"
        values = written(values.join(rows.groupBy(*key).agg(F.count("*").alias(many)), list(key), "left").fillna(0, [many]), "values")
    found, most, least = values.agg(*(F.coalesce(f(many), F.lit(0)) for f in (F.sum, F.max, F.min))).first()
    total = max(1, found if total is None else total)
    others = [c for c in values.columns if c not in key and c != "__many"]
    known = values.select(*key, F.lit(0).cast("long").alias("__at"), F.struct(*others).alias("__cold"))
    hot = values.where(F.col(many) * SHARES >= total).select(*key, F.struct(*others).alias("__hot"))
    out, cold, got = rows, F.lit(True), []
    if most * SHARES >= total:
        out, cold, got = out.join(F.broadcast(hot), list(key), "left"), F.col("__hot").isNull(), ["__hot"]
    if least * SHARES < total:
        # a row with a hot key, or a null in it, meets nothing in this join, wherever it goes
        for c in key:
            cold = cold & F.col(c).isNotNull()
        out = out.withColumn("__at", F.when(cold, F.lit(0).cast("long")).otherwise(1 + F.monotonically_increasing_id()))
        out, got = out.join(known, [*key, "__at"], "left"), [*got, "__cold"]
    out = out.withColumn("__v", F.coalesce(*got))
    return out.select(*[c for c in rows.columns], *[F.col(f"__v.{c}").alias(c) for c in others])


def stars(edges: DataFrame) -> bool:
    """Whether every node of the edges (a, b) is a root, which is no a, or has one edge, to a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return ends.where("ups > 1 OR ups = 1 AND low = 0").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected `edges` (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each is a minimum per node and a join,
    so no neighbour list is ever gathered; adaptive execution splits the join of a star's hub. There are no more rounds
    once all components are stars: none for lone pairs, and none to see that nothing changes. Edges
    that are made twice go at a round's end only, not between its steps too, which would take a shuffle more. A round's edges
    are written to the shared folder, which cuts lineage; those of the round before are removed. Both joins are by shuffles: a
    broadcast would take a job, a thread and a table of the driver's memory in every round, and between rounds the driver's
    memory is released where it has grown. Self loops and repeated
    edges are fine; an edge with a null end is left out; no edges give no rows.
    """
    spark = edges.sparkSession
    cur = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    old = None
    while True:
        with scope(spark) as made:
            cur = written(cur, "cc")
            path = made.pop()
        if old:
            remove(spark, old)
        old = path
        if stars(cur):
            break
        release_grown(spark)
        both = cur.selectExpr("inline(array(struct(a, b), struct(b AS a, a AS b)))")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a").selectExpr("inline(array(struct(a, m AS b), struct(b AS a, m AS b)))")
        cur = small.where("a <> b").distinct()
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
