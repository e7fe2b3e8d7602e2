"""The property graph: a table of nodes and a table of edges, parallel edges allowed."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

PLACEHOLDERS = ("external", "unresolved", "")
#: How concrete a type is; the lowest is preferred when nodes are merged.
TYPE_RANK = {t: i for i, t in enumerate(("class", "", "method", "function", "type", "attribute", "data", "module", "equation", "section", "term", "file", "external", "unresolved")) if t} | {"": 14}

NODE_SCHEMA = StructType([StructField(c, StringType()) for c in ("id", "type", "name", "display_name", "domain", "docname", "anchor", "file_path")] + [StructField(c, IntegerType()) for c in ("lineno", "end_lineno", "decorator_lineno")] + [StructField(c, BooleanType()) for c in ("is_test", "in_test_file")] + [StructField(c, ArrayType(StringType())) for c in ("decorators", "verifies", "catches")] + [StructField("vv_level", StringType()), StructField("no_implementation_kind", StringType())])
EDGE_SCHEMA = StructType([StructField(c, StringType()) for c in ("source", "target", "type", "evidence")] + [StructField("confidence", DoubleType()), StructField("reftype", StringType()), StructField("lineno", IntegerType()), StructField("param", StringType()), StructField("type_checking", BooleanType()), StructField("cases", ArrayType(StringType()))])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the schema's columns; those it lacks are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame
    metadata: dict = field(default_factory=dict)

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, metadata: dict | None = None) -> PropertyGraph:
        return PropertyGraph(conform(nodes, NODE_SCHEMA), conform(edges, EDGE_SCHEMA), metadata or {})

    def typed(self, *types: str) -> DataFrame:
        """Edges of these types; of all types if none is named."""
        return self.edges.filter(F.col("type").isin(*types)) if types else self.edges

    def degree(self) -> DataFrame:
        """(id, degree): incident edges; a loop counts twice."""
        return spread(self.edges.select(F.explode(F.array("source", "target")).alias("id")), "id").groupBy("id").agg(F.count("*").alias("degree"))

    def with_phantoms(self) -> PropertyGraph:
        """Add an attribute-less node for every endpoint that has none."""
        ends = self.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        missing = ends.join(self.nodes, "id", "left_anti")
        extra = conform(missing.select("id", F.lit("unresolved").alias("type"), name_of(F.col("id")).alias("name")), NODE_SCHEMA)
        return PropertyGraph(self.nodes.unionByName(extra), self.edges, self.metadata)

    def induced(self, ids: DataFrame) -> PropertyGraph:
        """The nodes of ``ids`` and the edges between them."""
        e = self.edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
        return PropertyGraph(self.nodes.join(ids.select("id"), "id", "left_semi"), e, self.metadata)


def name_of(node_id: Column) -> Column:
    """The third part of ``domain:type:name``; names may contain colons."""
    return F.element_at(F.split(node_id, ":", 3), -1)


def leaf(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def is_placeholder(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("")).isin(*PLACEHOLDERS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where everything runs in one process and none is set, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"strandline-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder that executors share and read it back; the plan behind it is gone."""
    path = f"{shared_dir(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame) -> None:
    """Delete the tables of ``cut`` that ``df`` reads, and let go of shuffles that no plan needs: a loop keeps one round on disk."""
    spark = df.sparkSession
    for file in df.inputFiles():
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("graph-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into as many tasks as a shuffle has.

    For grouping by keys that hardly repeat: nothing is gained by grouping before
    the shuffle, which takes memory with all keys of a large split, and tasks of
    few bytes but many keys aren't joined into one.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
