"""Tables, shared work folders and connected components for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder named by spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset a temporary folder of this process serves, on one machine (local master) only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="tidelog-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows as a table in the shared folder and reads them from there."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of stored(); only for tables that no later plan reads."""
    path = getattr(df, "_work_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def slices(batch: pa.RecordBatch, texts: int, max_rows: int = 256, max_bytes: int = 4_000_000):
    """Cuts a batch where a bound of rows or of bytes in column number texts is reached, so that
    a worker holds the intermediate objects of a few MB of text at a time (or of one long text)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= max_rows or total + n > max_bytes):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def runs(batches, key: int = 0):
    """(key, table) of each run of equal values in column number key of sorted batches; a run is held whole."""
    import numpy as np

    current, held = None, []
    for batch in batches:
        names = np.array(batch.column(key).to_pylist(), object)
        cuts = [0, *(np.nonzero(names[1:] != names[:-1])[0] + 1).tolist(), len(names)]
        for start, stop in zip(cuts, cuts[1:]):
            if stop == start:
                continue
            if held and names[start] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = names[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield current, pa.Table.from_batches(held)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, component), where component
    is the smallest node reachable. Nodes are of any type with an order; loops and repeated edges are harmless.

    Contraction: in each round every node hooks to its smallest neighbour or itself, edges and labels
    are renamed by that map, and inner edges vanish. At least half of the nodes that still have an edge
    lose it, so rounds grow with the logarithm of the longest chain. Each round is a written table, joins
    read those tables, so AQE can split a hub's rows, and nothing is gathered in the driver.
    """
    spark = edges.sparkSession
    edges = stored(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    labels, parents = None, None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
        parents = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("parent")), name)
        if labels is None:
            fresh = stored(parents.select("node", F.col("parent").alias("component")), name)
        else:
            renamed = parents.select(F.col("node").alias("component"), "parent")
            fresh = stored(labels.join(renamed, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), name)
            discard(labels)
        step = stored(edges.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a").select("pa", "b"), name)
        nxt = step.join(parents.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b").where("pa <> pb")
        nxt = stored(nxt.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), name)
        for old in (edges, step, parents):
            discard(old)
        edges, labels = nxt, fresh
    if labels is None:
        return spark.createDataFrame([], edges.select(F.col("a").alias("node"), F.col("b").alias("component")).schema)
    return labels
