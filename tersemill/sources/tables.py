"""Tables in and out: any of Spark's formats, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, form: str = "parquet", schema=None, **options) -> DataFrame:
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_stream(spark: SparkSession, path: str, schema, form: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(form).schema(schema).options(**options).load(path)


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", by: tuple[str, ...] = (), **options) -> None:
    df.write.format(form).mode(mode).partitionBy(*by).options(**options).save(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, form: str = "parquet"):
    return df.writeStream.format(form).option("checkpointLocation", checkpoint).start(path)


def spread(df: DataFrame) -> DataFrame:
    """A table whose scan has fewer partitions than there are cores, with its rows dealt over the cores before heavy
    work on each row. Scans are cut by spark.sql.files.maxPartitionBytes, so what is dealt is at most that for each
    core; a larger table is never shuffled, whatever its number of files."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    parts = plan.toRdd().getNumPartitions()
    return df.repartition(cores) if parts < cores else df


def write_or_keep(df: DataFrame, path: str, spare: str, form: str = "parquet", **options) -> str:
    """Writes df to path or, where that fails, to the spare path. success, or spare: the reason."""
    try:
        write(df, path, form, **options)
        return "success"
    except Exception as e:  # noqa: BLE001  whatever the sink says, the rows must not be lost
        write(df, spare, form)
        return f"spare: {type(e).__name__}"


def test_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, whether it is a file or a folder of files: streams read single files only by a pattern."""
    pattern = f"{folder}/[{name[0]}]{name[1:]}.parquet"
    return read_stream(spark, pattern, test_table(spark, folder, name).schema)
