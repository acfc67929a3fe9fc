"""Helpers shared by the operators: written intermediate tables, joins with hot keys,
connected components.

Intermediate tables go to the shared scratch folder (``spark.checkpoint.dir`` of the
session) as Parquet. They cut the lineage: a lost executor costs the tasks it ran, not the
steps before.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.session import scratch_path

# A key is hot if it holds more than one in HOT_SHARE of all rows, so that there are fewer
# than HOT_SHARE hot keys, however large the table is.
HOT_SHARE = 1000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


# Rows of an Arrow batch, where the session has Spark's default of 10,000: whole texts are long.
BATCH_ROWS = "1000"


def ship_code(spark) -> None:
    """Hand this package to the Python workers of the session, once for each application, so
    that tasks find it on executors where it is not installed; keep Arrow batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    if top.is_dir():
        to = Path(tempfile.mkdtemp(prefix="litrank-code-")) / "litrank_code.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(to))
    _SHIPPED.add(app)


def shuffle_width(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``stored``, as a table bucketed by ``key``: grouping it by the key needs no shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").bucketBy(shuffle_width(spark), key).sortBy(key) \
        .option("path", scratch_path(spark, table)).saveAsTable(table)
    return spark.table(table)


def hash_share(keys, wanted: int, total: int):
    """A condition that about ``wanted`` of ``total`` rows meet, by a hash of ``keys``; all rows do
    if there are no more. Put before a sort with a limit, it keeps what each task sends small."""
    if wanted >= total:
        return F.lit(True)
    bound = int(2 ** 31 * wanted / total) + 1
    return F.pmod(F.xxhash64(*keys), F.lit(2 ** 31)) < F.lit(bound)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per group, whatever the sizes of the groups.

    ``groups`` has unique ``key`` values, with the number of rows of each in ``size``; the
    sizes add up to at most ``total``. Groups of more than total / HOT_SHARE rows number
    fewer than HOT_SHARE; they are broadcast, so that their rows stay where they are. All
    others are joined by a shuffle in which no key holds more than one in HOT_SHARE rows.
    Both inputs are read twice: pass stored tables.
    """
    hot = F.col(size) * F.lit(HOT_SHARE) > F.lit(total)
    few = F.broadcast(groups.where(hot))
    rest = rows.join(F.broadcast(groups.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(groups.where(~hot).hint("merge"), key))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: ``(node, component)`` for each node that
    has an edge, the component being its smallest node.

    Alternates the large-star and small-star steps (Kiveris et al. 2014): every step is an
    aggregation with map-side minimum and a join, and every round is stored. No component is
    ever gathered in one task: a large one ends as a star of (node, smallest) rows.
    """
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) \
        .where("u <> v").distinct()
    pairs = stored(pairs, "cc")
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u") \
            .select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        least = large.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m"))
        down = large.join(least, large.v == least.w)
        small = down.select(F.col("m").alias("u"), "v") \
            .unionByName(down.select(F.col("m").alias("u"), F.col("u").alias("v"))) \
            .where("u <> v").distinct()
        pairs = stored(small, "cc")
        state = pairs.agg(F.count("*").alias("n"),
                          F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    star = pairs.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
    tops = pairs.select(F.col("u").alias("node")).distinct() \
        .join(pairs.select(F.col("v").alias("node")), "node", "left_anti") \
        .withColumn("component", F.col("node"))
    return star.unionByName(tops)
