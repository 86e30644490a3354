"""Readers and writers: items, corpora, questions; append-only CSV, JSON lines, manifests, list-partitioned indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM_SCHEMA = "id string, question string, golden_answers array<string>, choices array<string>, metadata map<string,string>"
MANIFEST_SCHEMA = "name string, kind string, dim int, ntotal long, nlist int, bytes long, seconds double"


def read_items(spark: SparkSession, path: str, schema: str = ITEM_SCHEMA) -> DataFrame:
    """By suffix: .jsonl (bad lines raise), .json (one list), .parquet; anything else raises."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if path.endswith(".json"):
        return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"cannot read {path}: neither .jsonl, .json nor .parquet")


def read_lenient(spark: SparkSession, path: str, schema: str = ITEM_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(good rows, one row of counts): bad lines are counted instead of raised."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x")).select("x.*")
    good = rows.where("_bad is null").drop("_bad")
    return good, rows.agg(F.count_if(F.col("_bad").isNull()).alias("good"), F.count_if(F.col("_bad").isNotNull()).alias("bad"))


def require(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows, with an error at run time where a required column is null; a missing column raises at once."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"columns {missing} are required")
    out = rows
    for c in columns:
        out = out.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is required")).cast(rows.schema[c].dataType)).otherwise(F.col(c)))
    return out


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus with its body in ``contents``; ``text`` is renamed if ``contents`` is missing."""
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)
    return rows if "contents" in rows.columns or "text" not in rows.columns else rows.withColumnRenamed("text", "contents")


def questions(rows: DataFrame, column: str = "question", most: int | None = None, order: str = "id") -> DataFrame:
    """Trimmed, non-blank questions; the cap counts after filtering, in order."""
    kept = rows.select(order, F.trim(column).alias("question")).where("question <> ''")
    return kept.orderBy(order).limit(most) if most else kept


def projected(rows: DataFrame, schema: str) -> DataFrame:
    """Exactly the columns of ``schema``: missing ones null, others left out."""
    kind = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind))


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    """A build manifest under its fixed schema; a schema frozen at the first append cannot shift columns."""
    projected(rows, MANIFEST_SCHEMA).write.mode("append").parquet(path)


def write_store(passages: DataFrame, path: str, key: str = "pid", order: str = "pos") -> DataFrame:
    """A passage store: the last of repeated ids wins, null titles and texts become empty, clustered by id."""
    from orrery.operators.lookup import keep_last

    kept = keep_last(passages, key, order).withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "text")})
    kept.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return passages.sparkSession.read.parquet(path)


def write_lists(vectors: DataFrame, path: str) -> DataFrame:
    """An inverted-list index: one folder a list, so that a probe prunes folders."""
    vectors.repartition("label").write.mode("overwrite").partitionBy("label").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def discover_runs(spark: SparkSession, root: str, pattern: str = "results*.jsonl") -> DataFrame:
    """(run, folder, files, bytes): the folders below ``root`` with result files, each once, in order of their paths; no file is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")
    runs = f.groupBy(folder).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return runs.select(F.element_at(F.split("folder", "/"), -1).alias("run"), "folder", "files", "bytes").orderBy("folder")


def synthetic_vectors(spark: SparkSession, n: int, dim: int, seed: int = 123) -> DataFrame:
    """Seeded normal vectors of unit length (zero norm: unchanged)."""
    x = F.array(*(F.randn(seed + k) for k in range(dim)))
    v = spark.range(n).select("id", x.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y))
    return v.select("id", F.transform("v", lambda y: y / F.when(norm == 0, 1.0).otherwise(norm)).alias("v"))


QUERIES = {}
ORACLE_SQL = {}


def resolve_path(path: str, root: str) -> str:
    """Object-store and absolute paths as they are (s3 as s3a), others under ``root``."""
    if path.startswith("s3://"):
        return "s3a://" + path.removeprefix("s3://")
    return path if "://" in path or path.startswith("/") else f"{root.rstrip('/')}/{path}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def directory_size(spark: SparkSession, path: str) -> int:
    """Bytes under a path, in any store; 0 if there is none."""
    fs, at = _file_system(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def fetch(spark: SparkSession, source: str, target: str) -> bool:
    """Copies a file or folder between stores under a ``.partial`` name and then renames it; False if the target has something already."""
    if directory_size(spark, target):
        return False
    (a, src), (b, part), (_, at) = (_file_system(spark, p) for p in (source, target + ".partial", target))
    b.delete(part, True)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, src, b, part, False, spark._jsc.hadoopConfiguration())
    b.delete(at, True)
    if not b.rename(part, at):
        raise OSError(f"cannot rename {target}.partial")
    return True


def dataset_splits(spark: SparkSession, source: str, target: str, splits: tuple[str, ...] = ("train", "dev", "test")) -> list[str]:
    """Copies a dataset's splits; nothing if any is there already."""
    if any(directory_size(spark, f"{target}/{s}.jsonl") for s in splits):
        return []
    return [s for s in splits if directory_size(spark, f"{source}/{s}.jsonl") and fetch(spark, f"{source}/{s}.jsonl", f"{target}/{s}.jsonl")]


def put_vectors(vectors: DataFrame, put: Callable[[list[dict]], None], size: int = 500) -> None:
    """Hands (id, v) to an object store's client, ``size`` at a time: {key, float32}; a task that is run again puts the same keys again."""

    def run(rows: Iterator) -> None:
        batch = []
        for r in rows:
            batch.append({"key": str(r["id"]), "float32": [float(x) for x in r["v"]]})
            if len(batch) == size:
                put(batch)
                batch = []
        if batch:
            put(batch)

    vectors.select("id", "v").foreachPartition(run)


def read_documents_of(spark: SparkSession, path: str, extract: Callable[[bytes], str], words: int = 600) -> DataFrame:
    """(path, text, error): files of any kind by a given extractor (PDF, say), the first ``words`` words; what fails says why."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for raw in b.column(1).to_pylist():
                try:
                    texts.append(" ".join(extract(raw).split()[:words]))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - any extractor's error is the row's
                    texts.append(None)
                    errors.append(f"Error: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string, error string")
