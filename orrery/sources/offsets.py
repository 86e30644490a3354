"""JSON lines by byte offset: a Spark data source with splits inside files, line numbers, and an offset index for single lines.

``JsonLines`` cuts each file into splits of ``split_bytes``; a split owns the lines that begin in it and reads on to the
end of its last one, so a file of any size is read in parallel without a shuffle. Line numbers come from the splits'
counts: a window over a few rows a file, joined to the lines. ``write_offsets`` keeps where each key's last line
stands; ``lines_of`` reads those lines alone, neighbours together, by seeking.

Files lie in any store that pyarrow opens by its URI (local, S3, HDFS). Lines end with LF, a CR before it goes. Empty files have no
lines. A key that is null, or a line that is no JSON object, is in no index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from io import BufferedReader

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 32 << 20
#: Gap between two lines up to which they are read at once; bytes that are read at once at most, or one line.
NEAR, AT_ONCE = 1 << 16, 8 << 20
LINES = "file string, split long, place long, offset long, bytes long, text string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))


def files_of(path: str) -> list[tuple[str, int]]:
    """(file, size) at or below a path, hidden ones and markers left out."""
    store, at = opened(path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int


def split_lines(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line with its end) of the lines that begin at ``start`` up to before ``end``."""
    source.seek(max(0, start - 1))
    at = start
    if start:
        at = start - 1 + len(source.readline())  # up to where the first own line begins; just the LF if it begins at start
    while at < end and (line := source.readline()):
        yield at, line
        at += len(line)


class Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int) -> None:
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Split]:
        cuts = [Split(f, a, min(a + self.split_bytes, size)) for f, size in files_of(self.path) for a in range(0, size, self.split_bytes)]
        return cuts or [Split("", 0, 0)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in LINES.split(", ")]
        if not part.file:
            return
        store, at = opened(part.file)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("file", "text") else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

        with store.open_input_file(at) as source:
            for place, (offset, line) in enumerate(split_lines(BufferedReader(source, 1 << 20), part.start, part.end)):
                rows.append((part.file, part.start, place, offset, len(line), line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")))
                size += len(line)
                if size >= 1 << 20:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orrery_json_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """LINES: place counts a split's lines from 0."""
    spark.dataSource.register(JsonLines)
    return spark.read.format(JsonLines.name()).option("path", path).option("split_bytes", split_bytes).load()


def numbered_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, line, offset, bytes, text), lines from 1."""
    rows = read_lines(spark, path, split_bytes)
    counts = rows.groupBy("file", "split").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("file", "split", before.alias("before"))
    return rows.join(counts, ["file", "split"]).select("file", (F.col("before") + F.col("place") + 1).alias("line"), "offset", "bytes", "text")


def _checked(rows: DataFrame, column: str) -> DataFrame:
    value = F.get_json_object("text", f"$.{column}")
    parsed = F.try_parse_json("text")
    why = F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit("not a JSON object"))
    why = why.when(value.isNull() | (F.trim(value) == ""), F.lit(f"blank {column}"))
    return rows.where(F.trim("text") != "").select("*", value.alias("value"), why.alias("error"))


def bad_lines(spark: SparkSession, path: str, column: str = "question", **kw) -> DataFrame:
    """(file, line, error) of every line that ``questions_of`` would raise for; blank lines are none."""
    return _checked(numbered_lines(spark, path, **kw), column).where("error is not null").select("file", "line", "error")


def questions_of(spark: SparkSession, path: str, column: str = "question", **kw) -> DataFrame:
    """(line, question), trimmed; a line without one raises with its number when it is read."""
    rows = _checked(numbered_lines(spark, path, **kw), column)
    raised = F.raise_error(F.concat("file", F.lit(" line "), F.col("line").cast("string"), F.lit(": "), "error"))
    return rows.select("line", F.when(F.col("error").isNotNull(), raised.cast("string")).otherwise(F.trim("value")).alias("question"))


def write_offsets(spark: SparkSession, path: str, target: str, key: str = "id", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(pid, file, offset, bytes), the last line of a repeated key, clustered by key; and reads it back."""
    rows = read_lines(spark, path, split_bytes).select(F.get_json_object("text", f"$.{key}").alias("pid"), "file", "offset", "bytes").where("pid is not null")
    last = rows.groupBy("pid").agg(F.max(F.struct("file", "offset", "bytes")).alias("at")).select("pid", "at.*")
    last.repartitionByRange("pid").sortWithinPartitions("pid").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def spans(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """(from, to, places in it): what to read at once for sorted (offset, bytes)."""
    held: list[int] = []
    start = end = 0
    for k, (offset, size) in enumerate(places):
        if held and (offset - end > NEAR or offset + size - start > AT_ONCE):
            yield start, end, held
            held = []
        if not held:
            start = end = offset
        end = max(end, offset + size)
        held.append(k)
    if held:
        yield start, end, held


def lines_of(offsets: DataFrame, asked: DataFrame) -> DataFrame:
    """(pid, text) for each row of ``asked`` (pid), null where there is none; reads the lines' bytes alone."""
    wanted = asked.select("pid").where("pid is not null").distinct().join(offsets, "pid")
    dealt = wanted.repartition("file", F.floor(F.col("offset") / SPLIT_BYTES)).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pids, files, offset, size = (b.column(c).to_pylist() for c in ("pid", "file", "offset", "bytes"))
            for f in dict.fromkeys(files):
                own = [k for k, x in enumerate(files) if x == f]
                store, at = opened(f)
                with store.open_input_file(at) as source:
                    for start, end, places in spans([(offset[k], size[k]) for k in own]):
                        raw = source.read_at(end - start, start)
                        rows = [own[p] for p in places]
                        texts = [raw[offset[k] - start : offset[k] - start + size[k]].rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace") for k in rows]
                        yield pa.RecordBatch.from_arrays([pa.array([pids[k] for k in rows]), pa.array(texts)], ["pid", "text"])

    found = dealt.select("pid", "file", "offset", "bytes").mapInArrow(run, "pid string, text string")
    return asked.select("pid").join(found, "pid", "left")


def q_offset_lookup(spark, d):
    """Every vector's document, read from JSON lines by the offset index."""
    from orrery.sources.scratch import Scratch
    from orrery.sources.tables import table

    with Scratch(spark) as s:
        path, index = s.path("json"), s.path("offsets")
        table(spark, d, "documents").select("doc_id", "text").write.json(path)
        offsets = write_offsets(spark, path, index, "doc_id")
        found = lines_of(offsets, table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("pid")))
        text = F.get_json_object("text", "$.text")
        return s.kept(found.select(F.col("pid").cast("long").alias("vec_id"), F.md5(text).alias("text_md5"), F.char_length(text).cast("long").alias("n_chars")))


def q_line_numbers(spark, d):
    """Of the conversations as JSON lines in sixteen files: the lines without text by file and number, whatever the splits."""
    from orrery.sources.scratch import Scratch
    from orrery.sources.tables import table

    with Scratch(spark) as s:
        path = s.path("json")
        rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, " ").otherwise(F.col("text")).alias("text"), F.pmod("conv_id", F.lit(16)).alias("part"))
        rows.repartition("part").sortWithinPartitions("part", "conv_id", "turn").write.partitionBy("part").json(path)
        part = F.regexp_extract("file", "part=(\\d+)", 1).cast("long").alias("part")
        return s.kept(bad_lines(spark, path, "text", split_bytes=1 << 16).select(part, "line", "error"))


QUERIES = {"offset_lookup": q_offset_lookup, "line_numbers": q_line_numbers}
ORACLE_SQL = {
    "offset_lookup": "select vec_id, md5(text) as text_md5, length(text)::bigint as n_chars from embeddings left join documents on doc_id = vec_id",
    "line_numbers": "with l as (select turn, text, conv_id % 16 as part, row_number() over (partition by conv_id % 16 order by conv_id, turn) as line from conversations) select part, line, 'blank text' as error from l where turn % 3 = 2 or text is null or trim(text) = ''",
}
