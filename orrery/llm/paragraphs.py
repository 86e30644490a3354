"""Substring dedup: paragraph MinHash banding, exact Jaccard, components.

A passage may stand in a line of its own, open a line, close one, or stand amid one. So a text's paragraphs are taken
from every sentence (and line) on to the first sentence end that makes at least ``MIN_WORDS`` words, and
from each line's last word back likewise; backwards, lines of twice that and more are cut on. Paragraphs may span short
lines and overlap. A near copy amid a line is found where a paragraph of it, from one of its own sentences on, reaches ``SIMILARITY``.

Each paragraph's word shingles are MinHashed; the bands are tuned for recall. Paragraphs that share a
band meet in a bucket, where pairs are verified by exact Jaccard similarity of their shingles, but for pairs whose
parity sketches already differ in more bits than ``SIMILARITY`` lets sets differ; a bucket emits a spanning forest of what it verified. Components of these links and equal paragraphs are the
clusters. A cluster counts if it lies in more than one document; the document with the smallest key
keeps its paragraphs, the others' are removals.

Most paragraphs share nothing with any other text, and those are not banded. An edit costs a pair eight or more
of the shingles in its union, so a pair at ``SIMILARITY`` has a common run of ``REACH`` words at least (if it
does not repeat its own shingles). Of the hashes of the ``ANCHOR`` words from each place of such a run on, the
least is the run's anchor: equal runs have equal anchors. Only paragraphs are banded of which runs whose anchors occur in
other texts cover ``COVERED``: between two edits, or an edit and an end, up to REACH - 1 words may be in no common run, so a
pair at SIMILARITY, which has one edit in 45 words at most, has nearly half of its words in such runs.

A passage that stands amid lines need not hold a paragraph. So every run of ``MIN_WORDS`` words (a window),
wherever it begins, is compared as well, by equality; only windows all of whose runs have such anchors are
hashed and counted. Of equal windows the smallest document's is kept. A text's adjoining windows with the same
keeper are one row, a maximal repeated run of words. Equal texts are one here: a text of several documents is
a run as a whole, and its paragraphs count where another text has them or their like.

Equal paragraphs are one node before anything is paired, and a task sends a paragraph's bands for two texts
at most. A bucket whose paragraphs all lie in one text is passed over, and pairs in one document are: a cluster is what
links between different documents and equal paragraphs connect. A paragraph that is near only to another of its own
document is not in that one's cluster, and stays.
Buckets that hold the same paragraphs are verified once, buckets of more than ``CHUNK`` as pairs of chunks. Buckets
are verified in a few rounds, as a paragraph's shingles go to each of its buckets and would fill the disk at once;
they are joined to the list of their buckets once, before the rounds.

Null, empty and short texts (under MIN_WORDS words): no paragraphs. Very long texts are read whole.
Null key: the text's hash stands in. Rows that repeat a key count as one document. Other columns pass
through ``removed`` untouched. Empty table: no rows. Offsets are bytes of the UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import common

#: Words of a shingle, words of a paragraph at least, similarity from which paragraphs are near-duplicates.
SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
#: Share of the pairs at exactly that similarity that the bands must bring together.
RECALL = 0.99
#: Pairs at UNLIKE may share a band with this chance at most.
UNLIKE, BY_CHANCE = 0.3, 0.03
CHUNK = 2048
#: Bits of a set's parity sketch; a shingle flips the bit that its lowest bits name.
SKETCH = 256
#: Members of buckets that one round verifies, and rounds at most: a round's shuffled sets go before the next round's.
ROUND_MEMBERS, ROUNDS = 500_000, 6
#: Contents that a task remembers to have sent.
SENT = 200_000
#: Words that are hashed for an anchor, and of a run that has one; a text has about 2 / (REACH - ANCHOR + 2) anchors a word.
ANCHOR, REACH = 8, 23
#: Share of a paragraph's words that common runs must cover: 1 - REACH / 45, with room.
COVERED = 0.45

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
ENDS_SENTENCE = np.zeros(256, bool)
ENDS_SENTENCE[[ord(c) for c in ".!?"]] = True
BASE, BASE_INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def tuned(similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows of a band): the fewest rows, and then bands, that reach the recall and keep unlike pairs apart."""
    for rows in range(1, 16):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if 1 - (1 - UNLIKE**rows) ** bands <= BY_CHANCE:
            break
    return bands, rows


BANDS, ROWS = tuned()
_rng = np.random.default_rng(2024)
FACTORS = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
SHIFTS = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a batch of texts: places, hashes, and which text, line and sentence they open."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        """``data``: all texts' bytes; ``ends``: where each text ends, with 0 before."""
        n = len(data)
        word = ~SPACE[data]
        opens = np.zeros(n + 1, bool)
        opens[ends] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | opens[1:n]
        last = word.copy()
        last[:-1] &= ~word[1:] | opens[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        up = powers(BASE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((LOWER[data] + np.uint64(1)) * up[:n], out=sums[1:])
        self.hash = mixed((sums[self.end] - sums[self.start]) * powers(BASE_INVERSE, n)[self.start])
        self.text = np.searchsorted(ends, self.start, side="right") - 1
        m = len(self.start)
        self.of_text = np.searchsorted(self.text, np.arange(len(ends)))  # first word of each text, and m
        feeds = np.cumsum(data == 0x0A)
        line = np.ones(m + 1, bool)
        sentence = np.ones(m + 1, bool)
        if m > 1:
            same = self.text[1:] == self.text[:-1]
            line[1:m] = ~same | (feeds[self.start[1:]] != feeds[self.start[:-1]])
            sentence[1:m] = line[1:m] | ENDS_SENTENCE[data[self.end[:-1] - 1]]
        self.lines, self.breaks = np.flatnonzero(line), np.flatnonzero(sentence)


def paragraphs_of(w: Words, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of every paragraph, each once."""
    m = len(w.start)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top, after = w.of_text[w.text], w.of_text[w.text + 1]  # the text that a word is in
    found = []
    # forwards from every sentence
    a = w.breaks[:-1]
    e = w.breaks[np.minimum(np.searchsorted(w.breaks, a + least), len(w.breaks) - 1)]
    ok = (a + least <= after[a]) & (e <= after[a])
    found.append((a[ok], e[ok]))
    # backwards
    e, bound = w.lines[1:], w.lines[:-1]
    while e.size:
        a = w.breaks[np.maximum(np.searchsorted(w.breaks, e - least, side="right") - 1, 0)]
        ok = (e - least >= top[e - 1]) & (a >= top[e - 1])
        a, e, bound = a[ok], e[ok], bound[ok]
        found.append((a, e))
        on = a - least >= bound
        e, bound = a[on], bound[on]
    both = np.unique(np.concatenate([np.stack(x, 1) for x in found]), axis=0) if found else np.zeros((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def shingles(w: Words) -> np.ndarray:
    """The hash of the SHINGLE words from each word on; the last few of the batch run over its end and are not used."""
    h = np.append(w.hash, np.zeros(SHINGLE, np.uint64))
    total = np.zeros(len(w.hash), np.uint64)
    for k in range(SHINGLE):
        total = total * BASE + h[k : k + len(total)]
    return mixed(total)


def contents(w: Words, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of each paragraph's words in order."""
    m = len(w.hash)
    sums = np.zeros(m + 1, np.uint64)
    np.cumsum(w.hash * powers(BASE, m)[:m], out=sums[1:])
    return mixed((sums[e] - sums[a]) * powers(BASE_INVERSE, m)[a] + (e - a).astype(np.uint64)).view(np.int64)


def band_keys(shingle: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Keys of each paragraph's bands: paragraphs x BANDS."""
    cuts = np.stack([a, e - SHINGLE + 1], 1).ravel()
    out = np.zeros((len(a), BANDS), np.uint64)
    for p in range(BANDS * ROWS):
        h = np.append(shingle * FACTORS[p] + SHIFTS[p], np.uint64(0))
        least = np.minimum.reduceat(h, cuts)[::2]
        band = p // ROWS
        out[:, band] = mixed(out[:, band] * BASE + least + np.uint64(band + 1))
    return out.view(np.int64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of a string column, nulls as empty texts."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def document_key(key: str, text: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.xxhash64(F.col(text)))


def colliding(found: DataFrame) -> DataFrame:
    """(bucket, content): paragraphs that share a band with a different one of another document; buckets of the same paragraphs are one."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.where("bands is not null").select(F.explode("bands").alias("key"), "content", "doc").repartition(n, "key").sortWithinPartitions("key", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.keyed_runs(batches, ["key"]):
            key, content, doc = (whole.column(c).to_numpy() for c in ("key", "content", "doc"))
            starts = common.group_starts(key)[:-1]
            apart = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
            new = common.group_starts(key, content)[:-1]
            key, content = key[new], content[new]
            starts = common.group_starts(key)
            sizes = np.diff(starts)
            bucket = np.add.reduceat(mixed(content.astype(np.int64).view(np.uint64)), starts[:-1])
            many = np.repeat((sizes > 1) & apart, sizes)
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mixed(bucket).view(np.int64), sizes)[many]), pa.array(content[many])], ["bucket", "content"])

    return dealt.mapInArrow(run, "bucket long, content long").distinct()


def jaccard(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of sets i and sets j, pair by pair; two empty sets are equal."""
    out = np.zeros(len(i))
    for n, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        merged = np.concatenate((sets[x], sets[y]))
        merged.sort()
        both = np.count_nonzero(merged[1:] == merged[:-1])
        either = len(sets[x]) + len(sets[y]) - both
        out[n] = both / either if either else 1.0
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity sketches: sets x words. Bits that differ between two are at most the shingles that only one of the sets has."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64)
    bit = np.repeat(np.arange(len(sets)) * SKETCH, size) + (flat % np.uint64(SKETCH)).astype(np.int64)
    odd = (np.bincount(bit, minlength=len(sets) * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64).reshape(len(sets), SKETCH // 64)


def verified(sets: list[np.ndarray], ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each set the place of the first one in its bucket that it is linked to, directly or not; lo, hi: the documents it lies in."""
    size, sketch = np.array([len(s) for s in sets]), sketches(sets)
    unlike = (1 - SIMILARITY) / (1 + SIMILARITY)  # of both sizes' sum, the share that only one set has, at most
    forest = common.Forest(len(sets))
    i, step = np.arange(len(sets)), 1
    while (i := i[i + step < ends[i]]).size:
        root = forest.root
        a = i[root[i] != root[i + step]]
        a = a[(lo[a] != hi[a + step]) | (hi[a] != lo[a + step])]
        less, more = np.minimum(size[a], size[a + step]), np.maximum(size[a], size[a + step])
        a = a[less >= SIMILARITY * more - 1e-9]
        differ = np.bitwise_count(sketch[a] ^ sketch[a + step]).sum(1, dtype=np.int64)
        a = a[differ <= unlike * (size[a] + size[a + step]) + 1e-9]
        if a.size:
            a = a[jaccard(sets, a, a + step) >= SIMILARITY - 1e-12]
            forest.unite(a, a + step)
            forest.flatten()
        step += 1
    return forest.root


def by_rounds(rows: Callable[[int], DataFrame], rounds: int, name: str) -> DataFrame:
    """The rows of every round, stored; a round's shuffle files are released before the next one begins."""
    parts = []
    for r in range(rounds):
        parts.append(common.stored(rows(r), name))
        common.released(parts[-1].sparkSession)
    return reduce(DataFrame.union, parts)


def links(members: DataFrame, sets: DataFrame, rounds: int = 1) -> DataFrame:
    """(a, b): verified near-duplicate contents, enough of them to connect all that are.

    members: (bucket, content), each once; sets: (content, set, lo, hi), lo and hi the least and greatest document
    it lies in; both stay the caller's. A set is stored with the list of its deals, which a round explodes to its own.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = common.stored(members.groupBy("bucket").count().where(F.col("count") > CHUNK), "large")
    m = members.join(common.small(large), "bucket", "left")
    chunks = F.ceil(F.col("count") / CHUNK)
    own = F.pmod(F.xxhash64("content"), chunks)
    others = F.filter(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda c: c != own)
    pairs = F.transform(others, lambda c: F.xxhash64("bucket", F.least(own, c), F.greatest(own, c)))
    m = m.select("content", F.when(F.col("count").isNull(), F.array("bucket")).otherwise(pairs).alias("deals"))
    m = common.stored(m.groupBy("content").agg(F.flatten(F.collect_list("deals")).alias("deals")), "deals")
    part = lambda df, r: df.where(F.pmod("content", F.lit(rounds)) == r)
    held = by_rounds(lambda r: part(sets, r).join(part(m, r), "content"), rounds, "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.keyed_runs(batches, ["deal"]):
            key, content = whole.column("deal").to_numpy(), whole.column("content").to_numpy()
            once = common.group_starts(key, content)[:-1]
            key, content = key[once], content[once]
            sets = [np.frombuffer(x, np.uint64) for x in whole.column("set").take(pa.array(once)).to_pylist()]
            starts = common.group_starts(key)
            root = verified(sets, np.repeat(starts[1:], np.diff(starts)), whole.column("lo").to_numpy()[once], whole.column("hi").to_numpy()[once])
            child = np.flatnonzero(root != np.arange(len(root)))
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(content[child]), pa.array(content[root[child]])], ["a", "b"])

    def of_round(r: int) -> DataFrame:
        deal = F.explode(F.filter("deals", lambda d: F.pmod(d, F.lit(rounds)) == r)).alias("deal")
        dealt = held.select(deal, "content", "set", "lo", "hi").repartition(n, "deal").sortWithinPartitions("deal", "content")
        return dealt.mapInArrow(run, "a long, b long")

    found = by_rounds(of_round, rounds, "links")
    common.dropped(held)
    return found


def runs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor) of every run of REACH words of a text."""
    m, span = len(w.hash), REACH - ANCHOR + 1
    if m < REACH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(m - ANCHOR + 1)
    least, width = contents(w, at, at + ANCHOR), 1
    while width < span:  # the least of the next ``width`` places
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    first = np.flatnonzero(np.arange(m) + REACH <= w.of_text[w.text + 1])
    return first, least[first]


def anchored(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, whole, start, end, words, anchors) of every text that has windows; whole: its hash, start and end: its first and last word's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 2):
            data, ends = text_buffer(b.column(2))
            w = Words(data, ends)
            first, anchor = runs(w)
            at = w.text[first]
            long = np.diff(w.of_text)[at] >= MIN_WORDS
            at, anchor = at[long], anchor[long]
            if len(at):
                change = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1]))
                at, anchor = at[change], anchor[change]
                lists = common.group_starts(at)
                at = at[lists[:-1]]
                a, e = w.of_text[at], w.of_text[at + 1]
                columns = [pa.array(x, pa.int64()) for x in (w.start[a] - ends[at], w.end[e - 1] - ends[at], e - a)]
                columns = [*(b.column(k).take(pa.array(at)) for k in (0, 1)), *columns, pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(anchor))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "whole", "start", "end", "words", "anchors"])

    rows = docs.select(document_key(key, text), F.xxhash64(text), F.col(text))
    return rows.mapInArrow(run, "doc long, whole long, start long, end long, words long, anchors array<long>")


def covered_by(wanted: np.ndarray) -> np.ndarray:
    """How many words before each place stand in a wanted run; wanted: 1 where one begins."""
    ends = np.zeros(len(wanted) + REACH + 1, np.int64)
    ends[: len(wanted)] += wanted
    ends[REACH : len(wanted) + REACH] -= wanted
    return np.append(0, np.cumsum(np.cumsum(ends)[: len(wanted)] > 0))


#: What is found in the texts that have a wanted anchor.
MET = "whole long, lo long, hi long, at long, start long, end long, words long, content long, bands array<long>, set binary"


def met(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """The windows and paragraphs (MET) of the texts (whole, lo, hi, anchors) that have wanted anchors, each from document ``lo``.

    content: a hash of its words; at: of windows, the place of the first word, -1 of paragraphs. Paragraphs
    have bands where this task has sent them for less than two texts, and the sorted hashes of their shingles where it had sent none.
    """
    rows = docs.select(document_key(key, text).alias("lo"), F.xxhash64(text).alias("whole"), F.col(text).alias("_text"))
    if wanted.count() <= common.SMALL_ROWS:  # then only texts that are wanted are shuffled
        rows = rows.join(F.broadcast(wanted.select("lo", "whole")), ["lo", "whole"], "left_semi")
    joined = rows.join(wanted, ["lo", "whole"]).select("whole", "lo", "hi", "_text", "anchors")
    inside = MIN_WORDS - REACH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, int | None] = {}  # the text a content was first sent for; None: a second one too

        def worth(content: int, whole: int) -> int:
            """2: bands and set, 1: bands, 0: neither."""
            if content not in sent:
                sent[content] = whole
                return 2
            if sent[content] is None or sent[content] == whole:
                return 0
            sent[content] = None
            return 1

        for b in common.slices(batches, 3):
            data, ends = text_buffer(b.column(3))
            w = Words(data, ends)
            first, anchor = runs(w)
            if not len(first):
                continue
            shared = np.zeros(len(w.hash) + 1, np.int64)
            shared[first + 1] = np.isin(anchor, b.column(4).flatten().to_numpy())
            covered = covered_by(shared[1:])
            shared = np.cumsum(shared)  # how many runs before each word have a wanted anchor
            i = np.flatnonzero(np.arange(len(w.hash)) + MIN_WORDS <= w.of_text[w.text + 1])
            i = i[shared[i + inside] - shared[i] == inside]
            a, e = paragraphs_of(w)
            near = covered[e] - covered[a] >= COVERED * (e - a)
            a, e = a[near], e[near]
            content = contents(w, a, e)
            if len(sent) > SENT:
                sent.clear()
            sends = np.array([worth(c, t) for c, t in zip(content.tolist(), b.column(0).to_numpy()[w.text[a]].tolist(), strict=True)], np.int64)
            new = sends > 0
            shingle = shingles(w)
            bands = band_keys(shingle, a[new], e[new]).ravel() if new.any() else np.zeros(0, np.int64)
            sets = iter([np.unique(shingle[x : y - SHINGLE + 1]).tobytes() for x, y in zip(a[sends == 2].tolist(), e[sends == 2].tolist(), strict=True)])
            from_, to = np.append(i, a), np.append(i + MIN_WORDS, e)
            at = w.text[from_]
            new = np.append(np.zeros(len(i), bool), new)
            columns = [b.column(k).take(pa.array(at)) for k in range(3)]
            places = (np.append(i, np.full(len(a), -1)), w.start[from_] - ends[at], w.end[to - 1] - ends[at], to - from_, np.append(contents(w, i, i + MIN_WORDS), content))
            columns += [pa.array(x, pa.int64()) for x in places]
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(new * BANDS)), pa.int32()), pa.array(bands, pa.int64()), mask=pa.array(~new)))
            sends = np.append(np.zeros(len(i), np.int64), sends)
            columns.append(pa.array([next(sets) if x == 2 else None for x in sends.tolist()], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in MET.split(", ")])

    return joined.mapInArrow(run, MET)


def repeated_windows(found: DataFrame) -> DataFrame:
    """(whole, start, end, words, keeper) of every maximal run of windows that occur in other documents and first in ``keeper``; found: windows (MET)."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = found.groupBy("content").agg(F.min("lo").alias("keeper"), F.max("lo").alias("last"))
    spread = common.stored(spread.where("keeper <> last").select("content", "keeper"), "repeated")
    place = F.shiftleft("start", 32).bitwiseOR(F.col("end")).alias("place")  # offsets in a string are below 2**31
    dealt = found.select("content", "whole", "at", place).join(spread, "content").drop("content").repartition(n, "whole").sortWithinPartitions("whole", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("whole", "at", "place", "keeper")
        for t in common.keyed_runs(batches, ["whole"]):
            columns = [t.column(c).to_numpy() for c in names]
            once = common.group_starts(*columns[:2])[:-1]  # rows that repeat key and text
            whole, at, place, keeper = (c[once] for c in columns)
            start, end = place >> 32, place & 0xFFFFFFFF
            opens = common.group_starts(whole, keeper, at - np.arange(len(at)))
            opens, last = opens[:-1], opens[1:] - 1
            columns = [whole[opens], start[opens], end[last], at[last] - at[opens] + MIN_WORDS, keeper[opens]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["whole", "start", "end", "words", "keeper"])

    return dealt.mapInArrow(run, "whole long, start long, end long, words long, keeper long")


def repeated_paragraphs(found: DataFrame) -> DataFrame:
    """(whole, start, end, words, keeper) of every paragraph whose cluster lies in more than one text and document; found: paragraphs (MET), a stored table that is dropped."""
    members = common.stored(colliding(found.select("content", "bands", F.col("whole").alias("doc"))), "colliding")
    rounds = max(1, min(ROUNDS, -(-members.count() // ROUND_MEMBERS)))
    common.released(found.sparkSession)
    first = F.min(F.when(F.col("set").isNotNull(), F.struct("whole", "start")))
    each = found.groupBy("content").agg(F.min("lo").alias("lo"), F.max("lo").alias("last"), F.max("hi").alias("hi"), first.alias("at"))
    each = each.join(members.select("content").distinct().withColumn("met", F.lit(True)), "content", "left")
    each = common.stored(each.where("met or lo <> last"), "each")
    wanted = each.where("met").select("content", "lo", "hi", "at.whole", "at.start")
    sent = found.where("set is not null").select("content", "whole", "start", "set")
    own = lambda r: F.pmod("content", F.lit(rounds)) == r
    sets = by_rounds(lambda r: sent.where(own(r)).join(wanted.where(own(r)), ["content", "whole", "start"]).select("content", "set", "lo", "hi"), rounds, "sets")
    at = common.stored(found.select("content", "whole", "start", "end", "words"), "at")
    common.dropped(found)  # the bands and sets that no bucket wants
    found = at
    parts = links(members, sets, rounds)
    common.dropped(sets)
    parts = common.stored(common.components(parts), "components")
    each = each.join(parts, each.content == parts.node, "left").select("content", F.coalesce("root", "content").alias("cluster"), "lo", "last")
    spread = each.groupBy("cluster").agg(F.min("lo").alias("keeper"), F.max("last").alias("last"))
    spread = common.stored(spread.where("keeper <> last").select("cluster", "keeper"), "spread")
    named = common.stored(each.join(spread, "cluster").select("content", "keeper"), "named")
    return found.select("content", "whole", "start", "end", "words").join(named, "content").drop("content")


def part_of(spark, path: str) -> DataFrame:
    """The rows (MET) of a folder that may have none and then is not there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MET).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MET)


def places(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, whole, start, end, words, keeper) of everything that repeats, each place of a text once."""
    common.text_batches(docs.sparkSession)
    with common.temporary() as keep:
        texts = common.stored(anchored(docs, key, text), "texts")
        each = texts.groupBy("whole").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), *(F.min(c).alias(c) for c in ("start", "end", "words")))
        each = common.stored(each, "each")
        anchors = texts.select("whole", F.explode("anchors").alias("anchor"))
        shared = anchors.groupBy("anchor").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b").select("anchor")
        wanted = anchors.join(common.stored(shared, "shared"), "anchor").groupBy("whole").agg(F.collect_set("anchor").alias("anchors"))
        wanted = common.stored(wanted.join(each, "whole").select("whole", "lo", "hi", "anchors"), "wanted")
        owners = common.stored(texts.select("doc", "whole").distinct(), "owners")
        common.dropped(texts)
        common.released(docs.sparkSession)
        path = common.new_path(docs.sparkSession, "met")
        met(docs, key, text, wanted).withColumn("window", F.col("at") >= 0).write.option("compression", "zstd").partitionBy("window").parquet(path)
        common.released(docs.sparkSession)
        windows, others = (part_of(docs.sparkSession, f"{path}/window={x}") for x in ("true", "false"))
        parts = common.stored(repeated_windows(windows), "windows")
        common.dropped(windows)
        common.released(docs.sparkSession)
        parts = parts.union(common.stored(repeated_paragraphs(others), "paragraphs"))
        parts = parts.union(each.where("lo <> hi").select("whole", "start", "end", "words", F.col("lo").alias("keeper")))
        parts = common.stored(parts.groupBy("whole", "start", "end", "words").agg(F.min("keeper").alias("keeper")), "parts")
        return keep(common.stored(owners.join(parts, "whole"), "places"))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start, end, words, cluster_id, kept) of every paragraph whose cluster lies in more than one document, and of every repeated run.

    cluster_id: the cluster's smallest document key; kept: the paragraph stands in that document. A place is
    one row, with the smallest of its clusters' keys.
    """
    rows = places(docs, key, text).groupBy("doc", "start", "end", "words").agg(F.min("keeper").alias("cluster_id"))
    return rows.select("*", (F.col("doc") == F.col("cluster_id")).alias("kept"))


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the paragraphs that other documents keep; cut texts lose white space (of the six kinds) at their ends, and go with their last word."""
    dk, tk, cut = (common.free_name(docs, n) for n in ("_doc", "_whole", "_cut"))
    with common.temporary() as keep:
        spans = places(docs, key, text).where("doc <> keeper").groupBy("doc", "whole").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
        spans = keep(common.stored(spans, "spans"))
    spans = spans.withColumnsRenamed({"doc": dk, "whole": tk, "_spans": cut})
    rows = docs.withColumns({dk: document_key(key, text), tk: F.xxhash64(text)})
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cuts = b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            keep = []
            for i, (t, spans) in enumerate(zip(texts, cuts, strict=True)):
                if spans:
                    raw, at, parts = (t or "").encode("utf-8"), 0, []
                    for s, e in sorted((x["start"], x["end"]) for x in spans):
                        if s > at:
                            parts.append(raw[at:s])
                        at = max(at, e)
                    texts[i] = b"".join([*parts, raw[at:]]).strip().decode("utf-8")
                    if not texts[i]:
                        continue
                keep.append(i)
            columns = list(b.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1]).take(pa.array(keep, pa.int64()))

    if spans.count() > common.SMALL_ROWS:
        return rows.join(spans, [dk, tk], "left").select(*docs.columns, cut).mapInArrow(run, docs.schema)
    ids = F.broadcast(spans.select(dk, tk))  # then texts that stay as they are stay where they are
    touched = rows.join(ids, [dk, tk], "left_semi").join(spans, [dk, tk]).select(*docs.columns, cut).mapInArrow(run, docs.schema)
    return rows.join(ids, [dk, tk], "left_anti").select(*docs.columns).union(touched)


def op7_paragraph_bands(spark, sf_dir: str) -> DataFrame:
    rows = repeats(common.table(spark, sf_dir, "documents"))
    return rows.select(F.col("doc").alias("doc_id"), "start", "end", F.col("words").alias("n_words"), "cluster_id", "kept")


QUERIES = {"op7_paragraph_bands": op7_paragraph_bands}
ORACLE_SQL = {}
