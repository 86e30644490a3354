"""Source divergence audit: term-block dense matrices, all pairs of groups by broadcasting, partial sums, heaps a group.

A group is a language and source. A language keeps the terms that ``MIN_DOCS`` of its documents hold; a group gives a
kept term the share p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), N its occurrences of kept terms, V the kept terms;
the language has its own shares q likewise. Terms diverge by f = floor((p - q)^2 / (p + q)).

Occurrences are counted in each task before they are shuffled. Kept terms are dealt to blocks by hash, about
``BLOCK_TERMS`` each; groups of a language to blocks of ``BLOCK_GROUPS``. A tile (language, two blocks of groups, block
of terms) is a dense int64 matrix of groups by terms, zeros included; all its pairs are taken at once by broadcasting,
in slices of ``CELLS`` numbers. A task adds up its tiles' pair matrices, Spark the tasks'. For the terms of a group, a
tile gives its ``TOP`` best from a heap; the tiles' heaps are merged by a window a group.

All arithmetic is in whole numbers: the division by N + 2 V is long division by thousands, exact below 9 * 10^15 occurrences.

Null text, lang and source read as ''. A group without terms, or a language without kept terms, stands with its pairs (0
where V is 0). Very long texts are read whole; repeated rows are documents of their own. Other columns are not read.
Equal values rank by the item's UTF-8 bytes. Empty table: no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import common
from orrery.llm.search import table_of

#: Fixed values of the contract: documents that hold a kept term, scale of shares, terms of a group that are reported.
MIN_DOCS, SCALE_THOUSANDS, TOP = 10, 3, 10
BLOCK_TERMS, BLOCK_GROUPS, CELLS = 2048, 64, 1 << 21
#: Different (language, source, term) that a task holds before it hands them on.
HELD = 400_000

LETTERS = table_of("0123456789")


def counted(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): partial counts; term null: the group occurs. Run it in ``common.small_batches``."""

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        langs, sources, terms, n, of = [], [], [], [], []
        for (a, b), (total, docs) in held.items():
            langs += [a] * (len(total) + 1)
            sources += [b] * (len(total) + 1)
            terms += [None, *(w.decode("utf-8", "replace") for w in total)]
            n += [0, *total.values()]
            of += [0, *(docs[w] for w in total)]
        return pa.RecordBatch.from_arrays([pa.array(langs), pa.array(sources), pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(of, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for a, s, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if (a, s) not in held:
                    held[a, s] = Counter(), Counter()
                total, docs = held[a, s]
                size -= len(total)
                words = t.translate(LETTERS).split()
                total.update(words)
                docs.update(set(words))
                size += len(total)
                if size >= HELD:
                    yield rows(held)
                    held, size = {}, 0
        if held:
            yield rows(held)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(blank(lang), blank(source), blank(text).cast("binary")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), by long division."""
    by = np.asarray(total + 2 * terms, np.int64)
    whole, rest = np.divmod(np.asarray(count, np.int64) + 2, by)
    for _ in range(SCALE_THOUSANDS):
        digits, rest = np.divmod(rest * 1000, by)
        whole = whole * 1000 + digits
    return whole + 1


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of f over the terms, rows of p by rows of q."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, CELLS // max(1, out.size))
    for a in range(0, p.shape[1], step):
        x, y = p[:, None, a : a + step], q[None, :, a : a + step]
        d = x - y
        out += (d * d // (x + y)).sum(2)
    return out


class Heaps:
    """The best (value, term) of each group: larger values first, then terms by their bytes."""

    def __init__(self) -> None:
        self.held: dict[int, list[tuple[int, bytes]]] = {}

    def offer(self, group: int, values: np.ndarray, terms: list[bytes]) -> None:
        if len(values) > TOP:
            bar = np.partition(values, -TOP)[-TOP]
            near = np.flatnonzero(values >= bar).tolist()
        else:
            near = range(len(values))
        self.held[group] = heapq.nsmallest(TOP, [*self.held.get(group, ()), *((-int(values[i]), terms[i]) for i in near)])


TILE = "lang string, x long, y long, tile long, kind int, place long, source string, total long, terms long, term string, n long, of_lang long"
FOUND = "lang string, source string, part string, item string, value long"


def tiles(dealt: DataFrame) -> DataFrame:
    """(FOUND) partial sums of pairs and each task's heaps; dealt: TILE rows, tiles whole and in order, groups (kind 0) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None  # lang, x, y
        groups: dict[int, tuple[str, int]] = {}
        sums, heaps, terms, tile, rows = None, Heaps(), 0, None, []

        def add() -> None:
            nonlocal sums, rows
            if not groups:
                return
            names = sorted({r[2] for r in rows})
            column = {w: k for k, w in enumerate(names)}
            places = sorted(groups)
            row = {g: k for k, g in enumerate(places)}
            if sums is None:
                sums = np.zeros((len(places), len(places)), np.int64)
            if names:
                count, of_lang = np.zeros((len(places), len(names)), np.int64), np.zeros(len(names), np.int64)
                i, j = np.array([row[r[0]] for r in rows]), np.array([column[r[2]] for r in rows])
                count[i, j] = [r[1] for r in rows]
                of_lang[j] = [r[3] for r in rows]
                p = shares(count, np.array([groups[g][1] for g in places])[:, None], terms)
                if at[1] == at[2]:
                    sums += pair_sums(p, p)
                    q = shares(of_lang, of_all, terms)
                    raw = [w.encode() for w in names]
                    for g, own in enumerate(p):
                        good = np.flatnonzero((count[g] > 0) & (own > q))
                        if len(good):
                            d = own[good] - q[good]
                            heaps.offer(places[g], d * d // (own[good] + q[good]), [raw[k] for k in good])
                else:  # pairs of two blocks only
                    first = np.array([g // BLOCK_GROUPS == at[1] for g in places])
                    part = pair_sums(p[first], p[~first])
                    sums[np.ix_(first, ~first)] += part
                    sums[np.ix_(~first, first)] += part.T
            rows = []

        def result() -> Iterator[pa.RecordBatch]:
            if at is None or not groups:
                return
            add()
            places = sorted(groups)
            found = []
            for i, g in enumerate(places):
                for j, h in enumerate(places):
                    if i != j and (at[1] == at[2] or g // BLOCK_GROUPS != h // BLOCK_GROUPS):
                        found.append((at[0], groups[g][0], "pair", groups[h][0], int(sums[i, j])))
            found += [(at[0], groups[g][0], "term", w.decode(), -v) for g, best in heaps.held.items() for v, w in best]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], [c.split(" ")[0] for c in FOUND.split(", ")])

        of_all = 0
        for lang, x, y, t, kind, place, source, total, of_terms, term, n, of_lang in ((r[c] for c in r) for b in batches for r in b.to_pylist()):
            if (lang, x, y) != at:
                yield from result()
                at, tile, groups, sums, heaps, rows = (lang, x, y), t, {}, None, Heaps(), []
            elif t != tile:
                add()
                tile = t
            if kind == 0:
                groups[place] = (source, total)
                terms, of_all = of_terms, of_lang
            else:
                rows.append((place, n, term, of_lang))
        yield from result()

    return dealt.mapInArrow(run, FOUND)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for every other source of the language, ``term`` rows for a group's TOP terms."""
    spark = docs.sparkSession
    with common.temporary() as keep, common.small_batches(spark):
        # partial counts, then everything about a term of a language, by one shuffle
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        each = counted(docs, text, lang, source).repartition(n, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        by_term = Window.partitionBy("lang", "term")
        each = each.withColumns({"of_lang": F.sum("n").over(by_term), "docs": F.sum("docs").over(by_term)})
        each = common.stored(each.where((F.col("docs") >= min_docs) | F.col("term").isNull()).drop("docs"), "counts")
        kept = each.where("term is not null")
        sizes = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"))
        total = each.groupBy("lang", "source").agg(F.sum(F.when(F.col("term").isNotNull(), F.col("n")).otherwise(0)).alias("total"))
        by_lang = Window.partitionBy("lang")
        groups = total.join(sizes, "lang", "left").select(
            "lang", "source", "total", F.coalesce("terms", F.lit(0)).alias("terms"), F.sum("total").over(by_lang).alias("of_lang"),
            (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("place"), F.count("*").over(by_lang).alias("groups"),
        )
        groups = common.stored(groups, "groups")
        blocks, tile_count = F.ceil(F.col("groups") / BLOCK_GROUPS), F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK_TERMS))
        own = F.floor(F.col("place") / BLOCK_GROUPS)
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        corner = (F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
        about = groups.withColumns({"own": own, "blocks": blocks, "tiles": tile_count})
        none = F.lit(None)
        heads = about.select("*", other).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))
        heads = heads.select("lang", *corner, "tile", F.lit(0).alias("kind"), "place", "source", "total", "terms", none.cast("string").alias("term"), none.cast("long").alias("n"), "of_lang")
        small = common.small(common.stored(about.select("lang", "source", "place", "own", "blocks", "tiles"), "about"))
        cells = kept.join(small, ["lang", "source"]).select("*", other)
        cells = cells.select("lang", *corner, F.pmod(F.xxhash64("term"), F.col("tiles")).alias("tile"), F.lit(1).alias("kind"), "place", none.cast("string").alias("source"), none.cast("long").alias("total"), none.cast("long").alias("terms"), "term", "n", "of_lang")
        dealt = heads.union(cells).repartition(n, "lang", "x", "y", "tile").sortWithinPartitions("lang", "x", "y", "tile", "kind")
        found = common.stored(tiles(dealt), "tiles")
        pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        ranked = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
        out = pairs.union(found.where("part = 'term'")).select("*", ranked)
        return keep(common.stored(out.where(f"part = 'pair' or rank <= {TOP}"), "divergence"))


def op13_term_blocks(spark, sf_dir: str) -> DataFrame:
    return divergence(common.table(spark, sf_dir, "documents"))


QUERIES = {"op13_term_blocks": op13_term_blocks}
ORACLE_SQL = {
    "op13_term_blocks": r"""
with d as (select row_number() over () as k, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
v as (select lang, term, count(*) as n from w group by lang, term having count(distinct k) >= 10),
g as (select distinct lang, source from d),
size as (select l.lang, (select count(*) from v where v.lang = l.lang) as terms, (select coalesce(sum(n), 0)::bigint from v where v.lang = l.lang) as total from (select distinct lang from g) as l),
c as (select lang, source, term, count(*) as n from w semi join v using (lang, term) group by all),
t as (select g.lang, g.source, coalesce(sum(c.n), 0)::bigint as total from g left join c using (lang, source) group by all),
p as (select t.lang, t.source, v.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (t.total + 2 * size.terms) as p,
        1 + (1000000000::hugeint * (v.n + 2)) // (size.total + 2 * size.terms) as q
      from t join size using (lang) join v using (lang) left join c using (lang, source, term)),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p as a join p as b using (lang, term) where a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
          from g as a join g as b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (from pairs union all from terms))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 10"""
}
