"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as Spark's reader gives it; paths go to Spark only, so any Hadoop store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one where it is unset and the master is local (tests).

    On a cluster without the setting it raises: no folder of one machine is shared there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gneiss-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df under the shared folder and read it back.

    The files are reliable storage, so a lost executor never forces what is below to run again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table of write_shared that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def n_words(text: Column) -> Column:
    """Number of words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_text(df: DataFrame, text: str, keep: list[str], fields: list[tuple[str, str]], make, rows: int = 256) -> DataFrame:
    """The kept columns and new ones computed from one text column in Arrow batches.

    make() gives, once per task, a function from a list of texts to a list of columns (lists or arrays).
    Batches are cut to few rows, so memory is bounded by some whole texts, not by the batch size.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    added = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields]
    schema = T.StructType([df.schema[c] for c in keep] + added)
    kinds = [to_arrow_type(f.dataType) for f in added]
    names = [*keep, *(name for name, _ in fields)]

    def run(batches):
        one = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = one(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], names=names)

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)
