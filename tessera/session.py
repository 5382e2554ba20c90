"""Session set-up and the helpers every operator shares: shared folders, size checks, parallelism."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by us only up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def get_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (UTC, ANSI and AQE on)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return b.config(map=settings).getOrCreate()


def ship(module: str) -> None:
    """Pickle the module's functions by value, so that executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one only where none is set and the master is local."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of executors, computes once."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Plan nodes that leave the partitions of a scan as they are.
NARROW = {"Project", "Filter", "Generate", "Union", "LogicalRelation", "LocalRelation", "LogicalRDD", "SubqueryAlias", "MapInPandas", "MapInArrow"}


def leaf_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, as the scans state them; nothing runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()) if leaves.apply(i).nodeName() == "LogicalRelation"]
    return sum(sizes)


def _narrow(plan) -> bool:
    children = plan.children()
    return plan.nodeName() in NARROW and all(_narrow(children.apply(i)) for i in range(children.size()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys (none: evenly) before a Python stage, only where df has fewer partitions than the cluster has cores twice over.

    Above a plain scan the partitions are counted; elsewhere the bytes of the scans tell, as counting would run the plan.
    """
    spark = df.sparkSession
    want = 2 * spark.sparkContext.defaultParallelism
    if _narrow(df._jdf.queryExecution().optimizedPlan()):
        have = df.rdd.getNumPartitions()
    else:
        have = leaf_bytes(df) // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if have >= want else df.repartition(want, *keys)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows, without counting all of a large one."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df for a broadcast, computed once, where it has at most so many rows; a larger one as it is."""
    got = df.limit(rows + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(got, df.schema)) if len(got) <= rows else df


#: Scans of fewer bytes hold no key that would be too much for one task.
HOT_BYTES = 4 << 30


def join_hot(left: DataFrame, right: DataFrame, key: str, right_key: str, parts: int = 64) -> DataFrame:
    """Left join of left[key] to right[right_key], where one key may hold a large part of left.

    Keys with more than 1/parts of left's rows (fewer than ``parts`` keys) meet their rows of right by broadcast, if these
    are few; all others are shuffled. Of a small left side no key is hot.
    """
    plain = lambda a, b: a.join(b, a[key] == b[right_key], "left")
    if leaf_bytes(left) < HOT_BYTES:
        return plain(left, right)
    counts = materialize(left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")), "keys")
    cut = (counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // parts
    hot = [r[key] for r in counts.filter(F.col("n") > cut).collect()]  # fewer than parts
    some = right.filter(F.col(right_key).isin(hot))
    if not hot or not small(some):
        return plain(left, right)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return plain(left.filter(is_hot), F.broadcast(some)).unionByName(plain(left.filter(~is_hot), right.filter(~F.col(right_key).isin(hot))))


def join_known(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "left", parts: int = 64) -> DataFrame:
    """Join left to right (unique on keys), where right[weight] is how many rows of left hold the key.

    Keys that hold more than 1/parts of left's rows are joined by broadcast: there are fewer than ``parts`` of them
    whatever the data. The rest is shuffled, and none of its keys is hot. Null keys match null keys. Inner or left.
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    cut = max(1, total // parts)
    names = [c for c in right.columns if c not in keys and c != weight]
    r = right.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(weight).alias("__w"), F.struct(*names).alias("__r"))
    on = lambda side: [left[k].eqNullSafe(side[f"__{k}"]) for k in keys]
    hot = F.broadcast(r.filter(F.col("__w") > cut))
    cold = r.filter(F.col("__w") <= cut)
    fields = [*left.columns, *(F.col(f"__r.{c}").alias(c) for c in names)]
    return (
        left.join(hot, on(hot), "inner").select(*fields)
        .unionByName(left.join(hot, on(hot), "left_anti").join(cold, on(cold), how).select(*fields))
    )
