"""Tables and reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import layout, stats
from ..operators.query import Scope
from ..plans.engine import Analysis

# Names of the files in an output folder.
TABLE, REPORT, GRAPH = "coverage_profile.tsv", "coverage_stats.txt", "coverage_graph"
COLUMNS = ("component_name", "position", "coverage")


#: Sorts before the parts that Spark writes, so the parts one after the other are the table with one header.
HEADER = "part-0000-header.csv"


def write_table(runs: DataFrame, components: DataFrame, target: str, one_file: bool = False) -> None:
    """The depth of every base, tab-separated with one header, in order of component and position.

    Runs are sorted by ranges before their bases are made, so the sort moves no base. The target is a
    folder whose parts follow each other in order, the header first; with one_file these are joined to a file.
    """
    if components.where("name is null or name = ''").limit(1).count():
        raise ValueError("A component has no name.")
    spark = runs.sparkSession
    named = runs.join(components.select("cid", "name"), "cid").repartitionByRange("cid", "start").sortWithinPartitions("cid", "start")
    rows = named.select(F.col("name").alias("component_name"), F.explode(F.sequence("start", F.col("end") - 1)).alias("position"), F.col("depth").alias("coverage"))
    folder = f"{target}.parts" if one_file else target
    rows.write.mode("overwrite").option("sep", "\t").option("emptyValue", "").csv(folder)
    write_text(spark, "\t".join(COLUMNS) + "\n", f"{folder}/{HEADER}")
    if one_file:
        join_parts(spark, folder, target)


def join_parts(spark: SparkSession, folder: str, target: str) -> None:
    """One file of the parts of a folder in order; the folder goes. The bytes stay within Hadoop's file systems."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, path = hadoop.fs.Path(folder), hadoop.fs.Path(target)
    store = source.getFileSystem(conf)
    names = sorted(s.getPath().getName() for s in store.listStatus(source) if s.getPath().getName().startswith("part-"))
    if store.exists(path):
        store.delete(path, True)
    out = store.create(path, True)
    try:
        for name in names:
            part = store.open(hadoop.fs.Path(source, name))
            try:
                hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
    store.delete(source, True)


def write_text(spark: SparkSession, content: str, path: str) -> None:
    """A small text by Hadoop's file systems, wherever the path is."""
    write_bytes(spark, content.encode(), path)


def write_bytes(spark: SparkSession, content: bytes, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def report(a: Analysis, runs: DataFrame, precision: str, scope: Scope | None = None) -> str:
    """The text of the report; statistics of one component or of each one and all together."""
    mapping = a.mapping_stats(scope).first()
    histogram = stats.depth_histogram(runs)
    if scope is not None:
        return text.report(mapping, precision, [("Coverage Statistics", stats.total_stats(histogram).first())], scope.name)
    names = {r["cid"]: r["name"] for r in a.components.collect()}
    rows = sorted(stats.rollup_stats(histogram).collect(), key=lambda r: -1 if r["cid"] is None else r["cid"])
    return text.report(mapping, precision, [("Global Coverage Statistics" if r["cid"] is None else f"{names[r['cid']]} Coverage Statistics", r) for r in rows])


def inspection(a: Analysis, cid: int | None = None) -> str:
    """The table of components, or of one."""
    summary = a.summary() if cid is None else a.summary().where(F.col("cid") == cid)
    rows = layout.inspect_rows(summary).orderBy("cid").collect()
    total = None if cid is not None else layout.component_totals(summary).where("label = 'Total'").first()
    return text.inspection(rows, total)
