"""Text sources: lines with byte offsets, adjacency text, tab-separated posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POST_SCHEMA = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def lines_with_offset(spark: SparkSession, path: str) -> DataFrame:
    """(docno, line): each line of a text collection with the byte offset at which it starts.

    The DataFrame text source has no offsets, so this one source goes through Hadoop's input format;
    everything after it is a DataFrame. Splittable and compressed files work alike; an empty file has no line.
    """
    pairs = spark.sparkContext.newAPIHadoopFile(
        path,
        "org.apache.hadoop.mapreduce.lib.input.TextInputFormat",
        "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.Text",
    )
    return spark.createDataFrame(pairs, T.StructType([T.StructField("docno", T.LongType()), T.StructField("line", T.StringType())]))


def adjacency_text(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, nbrs) of lines ``id nbr nbr ...`` separated by blanks; a lone id is a dangling node.

    Blank lines and lines whose id is no number are dropped, and so are neighbours that are no number.
    """
    parts = F.filter(F.split("value", "\\s+"), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("bigint"))
    rows = spark.read.text(path).select(numbers.alias("n")).where(F.size("n") > 0)
    return rows.select(F.col("n")[0].alias("node_id"), F.filter(F.expr("slice(n, 2, size(n))"), lambda x: x.isNotNull()).alias("nbrs")).where(
        "node_id IS NOT NULL"
    )


def tweets_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(post_id, user_id, date, text) of tab-separated lines; lines of fewer than four fields are dropped.

    Further fields are ignored, quotes are ordinary characters.
    """
    fields = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 4)
    return fields.select(*[F.col("f")[i].alias(s.name) for i, s in enumerate(POST_SCHEMA)])


def key_value_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The pairs of Hadoop sequence files of writable keys and values as two columns of ``schema``; files whose name begins with _ are skipped."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema)
