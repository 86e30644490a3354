"""Web archives: written, read back, indexed, and the indexes merged into capture histories.

Records are built as text in the JVM and written by Spark's own text writer with CRLF CRLF between
them, gzipped: any store Spark can write to will do, and the commit protocol deals with lost
executors. Reading goes file by file; each archive gives one capture run, sorted by (URL key,
timestamp). The external merge range-partitions all runs by (URL key, timestamp, run, place in run) -
so a hot URL spreads over partitions - and in each partition a loser tree merges the k sorted run
slices; partitions in order and rows in order are the global capture history.

Of records with equal payloads of ``MIN_REVISIT`` bytes or more, that with the largest page_id holds the
payload and the others are revisit records that refer to it; rows that repeat the largest id all hold it.
Null html: an empty payload. Null url: no target, sorted first under an empty key. Null page_id: no id,
never the largest. Very long pages are one record. Empty table: no records. Other columns are not archived.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import common

#: Fixed values of the contract and of the archive format.
MIN_REVISIT = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures have no time of their own here: so many seconds after this moment as page_id says.
EPOCH = 1_704_067_200
#: Index rows in one partition of the merge, on average at most.
MERGE_ROWS = 200_000

RUN_SCHEMA = "run string, seq long, url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, offset long, length long"


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the records that do not hold their payload."""
    told = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length("html").alias("bytes")).where(F.col("bytes") >= MIN_REVISIT)
    held = common.stored(told.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "held")
    later = told.join(held, ["digest", "bytes"]).where("refers_to is not null and not page_id <=> refers_to")
    return later.select("page_id", "digest", "refers_to").distinct()


def header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line breaks in the value are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def records(pages: DataFrame) -> DataFrame:
    """One column, value: a whole archive record without the CRLF CRLF that ends it."""
    back = common.stored(revisits(pages), "revisits")
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumns({"digest": F.sha1("html"), "bytes": F.octet_length("html")})
    same = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest"))
    page = page.alias("p").join(back.alias("r"), same, "left").select("p.*", "refers_to")
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(F.col("refers_to").isNull(), F.concat(http, F.col("html"))).otherwise(http)
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    page = page.withColumns({"block": block, "kind": kind})
    date = F.date_format(F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) % 3_000_000_000 + EPOCH), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return page.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            header("WARC-Type", F.col("kind")),
            header("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:>"))),
            header("WARC-Date", date),
            header("WARC-Target-URI", F.col("url")),
            header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            header("WARC-Refers-To", urn(F.col("refers_to"))),
            F.when(F.col("refers_to").isNotNull(), header("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit("")),
            header("Content-Type", F.lit("application/http;msgtype=response")),
            header("Content-Length", F.octet_length("block")),
            F.lit(CRLF),
            F.col("block"),
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str) -> None:
    records(pages).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record of a gzipped archive, unzipped bit by bit; offsets are of the unzipped file."""
    buffer, at, start, unzip = bytearray(), 0, 0, zlib.decompressobj(31)
    step = 1 << 20
    ended = False

    def more() -> bool:
        nonlocal at, unzip, ended
        while not ended:
            piece = unzip.decompress(content[at : at + step])
            at += step
            if unzip.eof and unzip.unused_data:
                at -= len(unzip.unused_data) + max(0, at - len(content))
                unzip = zlib.decompressobj(31)
            ended = at >= len(content)
            if piece:
                buffer.extend(piece)
                return True
        return False

    while True:
        while (head := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError(f"archive ends inside a record at {start}")
                return
        lines = buffer[:head].decode("utf-8").split(CRLF)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {start}: {lines[0][:40]!r}")
        named = dict(x.split(": ", 1) for x in lines[1:])
        end = head + 4 + int(named["Content-Length"])
        while len(buffer) < end + 4:
            if not more():
                raise ValueError(f"archive ends inside a record at {start}")
        block = bytes(buffer[head + 4 : end])
        yield named, block, start, end
        start += end + 4
        del buffer[: end + 4]


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, no scheme, no www, no fragment, lower case."""
    rest = (url or "").strip().partition("#")[0].partition("://")[2] or (url or "").strip()
    host, slash, path = rest.partition("/")
    labels = [x for x in host.lower().partition(":")[0].split(".") if x]
    if len(labels) > 2 and labels[0] == "www":
        labels = labels[1:]
    return f"{','.join(reversed(labels))}){slash or '/'}{path}".lower() if url else ""


def captures(content: bytes) -> Iterator[tuple]:
    """(url_key, captured, page_id, url, type, refers_to, digest, bytes, offset, length) of each record.

    A payload's digest and length are made anew from what the archive holds; a revisit's come from its headers.
    """
    number = lambda urn: int(x) if (x := urn[10:-1]) else None
    for named, block, offset, length in parsed(content):
        head, _, payload = block.partition(b"\r\n\r\n")
        told = named["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(head.rpartition(b"Content-Length: ")[2])
        kind, back = named["WARC-Type"], None
        if kind == "revisit":
            back = number(named["WARC-Refers-To"])
        elif sha1(payload).hexdigest() != told or len(payload) != size:
            raise ValueError(f"payload of {named['WARC-Record-ID']} is damaged")
        url = named.get("WARC-Target-URI")
        yield url_key(url), named["WARC-Date"], number(named["WARC-Record-ID"]), url, kind, back, told, size, offset, length


def runs(spark, path: str) -> DataFrame:
    """The capture runs of the archives in ``path``: one a file, each sorted by URL key and timestamp (columns: RUN_SCHEMA)."""
    common.text_batches(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
        for paths, contents in common.rows_of(batches, "path", "content"):
            for name, content in zip(paths, contents, strict=True):
                rows = sorted(captures(content), key=lambda r: (r[0], r[1], r[8]))
                run = name.rpartition("/")[2]
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    columns = [[run] * len(part), range(at, at + len(part)), *zip(*part, strict=True)]
                    yield pa.RecordBatch.from_pydict({n: pa.array(list(c), pa.int64() if n in LONGS else pa.string()) for n, c in zip(names, columns, strict=True)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, RUN_SCHEMA)


LONGS = {x.split()[0] for x in RUN_SCHEMA.split(", ") if x.endswith(" long")}


class LoserTree:
    """Tournament over k sorted runs: each inner node holds the loser of its match, so the next winner costs log2 k comparisons."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.k = max(1, len(runs))
        self.left = [iter(r) for r in runs] or [iter(())]
        self.head = [next(r, None) for r in self.left]
        self.loser = [-1] * self.k
        for leaf in range(self.k):
            self.play(leaf)

    def beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or x < y)

    def play(self, leaf: int) -> None:
        """Takes a leaf's head up the tree; while the tree fills, it waits at the first empty node."""
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.loser[node]
            if other < 0:
                self.loser[node] = winner
                return
            if self.beats(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.head[self.loser[0]]) is not None:
            leaf = self.loser[0]
            yield row
            self.head[leaf] = next(self.left[leaf], None)
            self.play(leaf)


def histories(index: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """All runs merged: rows of RUN_SCHEMA in global order of (url_key, captured, run, seq), partition after partition."""
    spark = index.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // merge_rows))
    dealt = index.repartitionByRange(n, "url_key", "captured", "run", "seq").sortWithinPartitions("run", "seq")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        rows = pa.Table.from_batches(kept).combine_chunks()
        keys = list(zip(*(rows.column(c).to_pylist() for c in ("url_key", "captured", "run", "seq")), range(rows.num_rows), strict=True))
        parts: list[list[tuple]] = []
        for row in keys:
            if not parts or parts[-1][-1][2] != row[2]:
                parts.append([])
            parts[-1].append(row)
        order = pa.array([row[4] for row in LoserTree(parts)], pa.int64())
        yield from rows.take(order).to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(merge, index.schema)


def op1_warc_histories(spark, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages"), path)
    merged = histories(common.stored(runs(spark, path), "runs"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc_histories": op1_warc_histories}
ORACLE_SQL = {
    "op1_warc_histories": f"""
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as keeper from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {MIN_REVISIT} and page_id <> keeper then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {MIN_REVISIT} and page_id <> keeper then keeper end as refers_to
from m"""
}
