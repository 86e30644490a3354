"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings counts the subsequences of ``ORDER`` characters they share, each weighed by
DECAY to the length of the stretch it spans, gaps included; it is normalised, so a string has kernel 1
with itself. An insult with inserted characters ("id-i*ot") or an unseen ending shares most of its
subsequences with those that were learnt.

Texts are read as units: lower-case words without edge punctuation, runs of single characters that
stand apart ("i d i o t") joined, and pairs of words that follow each other in a sentence, if both are words of
a pair that was learnt. A unit over ``WINDOW`` characters is read in overlapping windows. A text scores as its
worst unit.

Training: sentences of a bounded sample of labelled texts. A sentence bears its text's label, and its words
and pairs of words bear the sentence's; but in a toxic text most sentences are harmless, so the machine is fitted
in rounds: the positive examples are those units of toxic sentences that clean texts hardly have (of pairs, those
of words that tell nothing alone), at first weighed by how many texts have them or something close to them; after
each round the worst units of each toxic text count most, and the clean units that come nearest to passing for
toxic join the negative examples. Features are Nystroem: kernels to the landmarks times the inverse root of the
landmarks' own kernel matrix; the machine is linear in them. Since it is linear in kernels to landmarks, it is
linear in the weighed subsequences too: the landmarks' expansion is folded into one table by subsequence, which
gives the same decision values at a cost that does not grow with the landmarks.

Everything that training bounds is a parameter here: ``TRAIN_DOCS`` texts of each kind, of at most ``TRAIN_BYTES``
each (longer ones are scored, not learnt from), the ``TRAIN_UNITS`` units of most toxic texts as positive examples,
as many clean units, half of them the commonest, and twice as many hard ones. Nothing bounds what is scored.

Letters but a to z, digits and signs share ``OTHERS`` symbols by their code; the usual marked letters of one
language differ in it, Han characters clash at random.

Null and empty texts and texts without units: the score of no evidence. Very long texts are read whole.
Repeated rows are each scored. With no labelled text of one kind, every text scores 0. Other columns
pass through where asked. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from orrery.llm import common

#: Kernel: characters of a subsequence, and the factor for each character of the stretch it spans.
ORDER, DECAY = 3, 0.6
#: Characters of a unit that are read at once.
WINDOW = 16
#: Bounds of training: labelled texts of each kind, bytes of a text, units of each kind, landmarks, rounds.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_UNITS, LANDMARKS, ROUNDS = 2500, 20_000, 2400, 240, 4
#: Toxic sentences that must have a pair of words for it to be learnt: so many, and so many a toxic text.
PAIR_SENTENCES, PAIR_SHARE = 5, 0.01
#: Units whose values a worker remembers.
CACHE = 200_000
SYMBOLS, OTHERS = 128, 101  # characters are told apart as so many symbols: a to z each, others by their code
EDGES = ".,;:!?\"'()[]{}<>#*$%&|~`_-+=/\\^@…«»“”„‘’¿¡"
SINGLES = re.compile(r"(?<!\S)\w(?:\s+\w){2,}(?!\w)")


def units_of(text: str) -> set[str]:
    """The distinct units of a text."""
    low = text.lower()
    found = {x for w in set(low.split()) if (x := w.strip(EDGES))}
    if SINGLES.search(low):
        found |= {"".join(m.split()) for m in SINGLES.findall(low)}
    return found


def symbols(unit: str) -> list[int]:
    return [o - 96 if 97 <= (o := ord(c)) <= 122 else 27 + o % OTHERS for c in unit]


def letters(word: str) -> str:
    """The word without what may have been inserted: letters only."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def pairs_of(sentence: str, words: frozenset[str] | None = None) -> set[str]:
    """Pairs of words that follow each other in a sentence, as units; only those of ``words`` (by their letters), where given."""
    w = [x for x in (x.strip(EDGES) for x in sentence.lower().split()) if x]
    if words is None:
        return {f"{letters(a)} {letters(b)}" for a, b in zip(w, w[1:], strict=False)}
    known = [letters(x) in words for x in w]
    return {f"{w[i]} {w[i + 1]}" for i in range(len(w) - 1) if known[i] and known[i + 1]} if any(known) else set()


def sentences_of(text: str) -> list[str]:
    return re.split(r"(?<=[.!?])\s+|\n", text)


def windows(unit: str) -> list[str]:
    """The unit, or overlapping windows that cover it."""
    if len(unit) <= WINDOW:
        return [unit]
    return [unit[i : i + WINDOW] for i in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


_SHAPES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def shape(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For strings of ``n`` symbols: the places of every subsequence, and its weight."""
    if n not in _SHAPES:
        places = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
        _SHAPES[n] = places, DECAY ** (places[:, -1] - places[:, 0] + 1) if len(places) else np.zeros(0)
    return _SHAPES[n]


def subsequences(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of every subsequence of strings of one length: arrays of strings x subsequences, weights over the self-kernel's root."""
    places, weight = shape(len(strings[0]))
    s = np.array([symbols(x) for x in strings], np.int64)
    codes = np.zeros((len(strings), len(places)), np.int64)
    for k in range(ORDER):
        codes = codes * SYMBOLS + s[:, places[:, k]]
    order = np.argsort(codes, 1)
    ordered = np.take_along_axis(codes, order, 1)
    w = weight[order]
    new = np.ones(codes.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    rows, columns = np.nonzero(new)
    if not len(rows):
        return codes, np.zeros(codes.shape)
    flat = np.flatnonzero(new.ravel())
    total = np.add.reduceat(w.ravel(), flat)
    square = np.zeros(len(strings))
    np.add.at(square, rows, total * total)
    return codes, weight[None, :] / np.sqrt(np.maximum(square, 1e-300))[:, None]


def by_length(strings: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    groups: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(strings):
        groups[len(x)].append(i)
    for n, at in groups.items():
        step = max(1, 400_000 // max(1, len(shape(n)[0])))
        for k in range(0, len(at), step):
            yield at[k : k + step], [strings[i] for i in at[k : k + step]]


def features(parts: list[tuple[list[int], np.ndarray, np.ndarray]], n: int, codes: np.ndarray) -> np.ndarray:
    """Dense rows of subsequence weights over the given codes; others are left out."""
    out = np.zeros((n, len(codes) + 1), np.float32)
    for at, c, w in parts:
        k = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
        k[codes[k] != c] = len(codes)
        np.add.at(out, (np.repeat(at, c.shape[1]), k.ravel()), w.ravel())
    return out[:, :-1]


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernel matrix of two lists of strings, in blocks of bounded size."""
    out = np.zeros((len(a), len(b)), np.float32)
    for j in range(0, len(b), 256):
        block = b[j : j + 256]
        right = [(at, *subsequences(x)) for at, x in by_length(block)]
        codes = np.unique(np.concatenate([c.ravel() for _, c, _ in right]))
        if not len(codes):
            continue
        r = features(right, len(block), codes)
        for i in range(0, len(a), 1024):
            left = a[i : i + 1024]
            out[i : i + 1024, j : j + 256] = features([(at, *subsequences(x)) for at, x in by_length(left)], len(left), codes) @ r.T
    return out


@dataclass
class Model:
    """Decision value of a window: table[code] . weights + bias; a text's score: logistic in its worst unit's value."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float
    landmarks: list[str]
    pair_words: frozenset[str] = frozenset()  # of the pairs that were learnt

    def units_of(self, text: str) -> set[str]:
        found = units_of(text)
        if self.pair_words and not self.pair_words.isdisjoint(w if w.isalpha() else letters(w) for w in found):
            for s in sentences_of(text):
                found |= pairs_of(s, self.pair_words)
        return found

    def values(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), self.bias)
        for at, x in by_length(strings):
            if len(x[0]) >= ORDER:
                codes, w = subsequences(x)
                out[at] += (self.table[codes] * w).sum(1)
        return out

    def unit_values(self, units: list[str]) -> np.ndarray:
        cut = [windows(u) for u in units]
        v = self.values([w for x in cut for w in x])
        return np.maximum.reduceat(v, np.cumsum([0, *map(len, cut[:-1])])) if cut else v

    def calibrate(self, worst: np.ndarray, toxic: np.ndarray) -> None:
        """Sets score 0.7 between the kinds, where the shares that it gets right add up to most (labels are noisy)."""
        cuts = np.unique(worst)
        right = 1 - np.searchsorted(np.sort(worst[toxic]), cuts) / toxic.sum() + np.searchsorted(np.sort(worst[~toxic]), cuts) / (~toxic).sum()
        cut = cuts[right.argmax()]
        under, over = worst[~toxic & (worst < cut)], worst[toxic & (worst >= cut)]
        lo = np.quantile(under, 0.999) if len(under) else cut - 1
        middle = (lo + max(cut, np.quantile(over, 0.02) if len(over) else cut)) / 2
        self.slope = 6.0
        self.shift = float(np.log(0.7 / 0.3)) - self.slope * float(middle)

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -40, 40)))


def hinge_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss and weighed examples, by Newton steps on the active set."""
    z = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(z.shape[1])
    ridge = np.ones(z.shape[1])
    ridge[-1] = 1e-3
    for _ in range(steps):
        active = y * (z @ w) < 1
        za, ca = z[active], c * weight[active]
        new = np.linalg.solve(np.diag(ridge) + za.T @ (za * ca[:, None]), za.T @ (ca * y[active]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def learnt_pairs(texts: list[str], toxic: list[bool]) -> list[str]:
    """Pairs of words that stand far oftener in toxic sentences than in clean ones, though neither word does. Equal sentences, as copies have, count once."""
    sentences = {kind: {s for t, y in zip(texts, toxic, strict=True) if bool(y) == kind for s in sentences_of(t)} for kind in (False, True)}
    n_good, n_bad = (len(sentences[kind]) for kind in (False, True))
    bad = Counter(p for s in sentences[True] for p in pairs_of(s))
    bad = {p: n for p, n in bad.items() if n >= max(PAIR_SENTENCES, PAIR_SHARE * sum(toxic)) and len(p) > ORDER}
    words = frozenset(w for p in bad for w in p.split(" "))
    if not words:
        return []
    good, good_words, bad_words = Counter(), Counter(), Counter()
    for kind, counts in ((False, good_words), (True, bad_words)):
        for s in sentences[kind]:
            found = words.intersection(letters(x.strip(EDGES)) for x in s.lower().split())
            counts.update(found)
            if not kind and found:
                good.update({" ".join(map(letters, p.split(" "))) for p in pairs_of(s, words)})
    far = lambda b, g: b * n_good > 8 * (g + 0.01) * n_bad
    return sorted(p for p, n in bad.items() if far(n, good[p]) and not any(far(bad_words[w], good_words[w]) for w in p.split(" ")))


def trained(texts: list[str], toxic: list[bool], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model | None:
    """The model of labelled texts; None if one kind is missing."""
    n_bad = sum(toxic)
    n_good = len(texts) - n_bad
    bags: dict[int, set[str]] = defaultdict(set)
    good, bad = Counter(), Counter()
    pairs = learnt_pairs(texts, toxic)
    pair_words = frozenset(w for p in pairs for w in p.split(" "))
    for k, t in enumerate(texts):
        for s in sentences_of(t):
            units = units_of(s) | (pairs_of(s, pair_words) if pair_words else set())
            bags[k] |= {w for u in units for w in windows(u) if len(w) >= ORDER}
    for k, units in bags.items():
        (bad if toxic[k] else good).update(units)
    if not good or not bad:
        return None
    # labels are noisy: what stands far oftener in toxic texts is suspect even if a clean one has it
    telling = {u for u in bad if bad[u] * n_good > 8 * (good[u] + 0.01) * n_bad}
    harmless = sorted((u for u in good if u not in telling), key=lambda u: (-good[u], u))
    clean, rest = harmless[: TRAIN_UNITS // 2], sorted(harmless[TRAIN_UNITS // 2 :])
    rng = np.random.default_rng(11)
    clean += [rest[i] for i in sorted(rng.choice(len(rest), min(len(rest), TRAIN_UNITS // 2), replace=False))]
    suspects = sorted(telling, key=lambda u: (-bad[u], u))[:TRAIN_UNITS]
    if not suspects:
        return None
    near = np.maximum(kernel(suspects, suspects), 0)
    number = np.array([bad[u] for u in suspects], float)
    weight = (np.where(near > 0.45, near, 0) @ number) - 3 * np.where((k := kernel(suspects, clean)) > 0.45, k, 0).sum(1)
    weight = np.clip(weight / 10, 0.01, 1.0)
    gram, model, hard = kernel(suspects, suspects), None, []
    for turn in range(rounds):
        # landmarks: the weightiest suspects that differ from each other, then clean units, the hard ones first
        chosen: list[int] = []
        for i in np.argsort(-weight, kind="stable"):
            if len(chosen) >= landmarks * 6 // 10 or weight[i] < 0.02 and chosen:
                break
            if not chosen or gram[i, chosen].max() < 0.9:
                chosen.append(int(i))
        marks = [suspects[i] for i in chosen] + hard[: landmarks * 3 // 10]
        marks += [clean[i] for i in np.linspace(0, len(clean) - 1, max(1, landmarks - len(marks))).astype(int)]
        marks = list(dict.fromkeys(marks))
        values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
        keep = values > 1e-4 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        against = clean + hard
        x = kernel(suspects + against, marks) @ root
        y = np.append(np.ones(len(suspects)), -np.ones(len(against)))
        share = np.append(weight * len(against) / max(weight.sum(), 1e-9), [min(10.0, max(1.0, good[u] / 3)) for u in against])
        w, bias = hinge_fit(x, y, share)
        alpha = root @ w
        table = np.zeros(SYMBOLS**ORDER, np.float64)
        for at, strings in by_length(marks):
            if len(strings[0]) >= ORDER:
                codes, wt = subsequences(strings)
                np.add.at(table, codes.ravel(), (wt * alpha[at][:, None]).ravel())
        model = Model(table, bias, 1.0, 0.0, marks, pair_words)
        if turn + 1 < rounds:
            value = dict(zip(suspects, model.values(suspects).tolist(), strict=True))
            hits: Counter = Counter()
            for k, units in bags.items():
                if toxic[k] and (found := [u for u in units if u in value]):
                    top = max(value[u] for u in found)
                    hits.update(u for u in found if value[u] >= top - 0.15)
            weight = np.array([np.clip(hits[u] / 3, 0.002, 1.0) for u in suspects])
            wrong = model.values(harmless)
            worst = np.argsort(-wrong, kind="stable")[: TRAIN_UNITS // 2]
            hard = list(dict.fromkeys([*hard, *(harmless[i] for i in worst if wrong[i] > -0.6)]))[: 2 * TRAIN_UNITS]
    value = dict(zip(units := sorted(set().union(*bags.values())), model.values(units).tolist(), strict=True))
    worst = np.array([max(map(value.__getitem__, bags[k]), default=model.bias) for k in range(len(texts))])
    model.calibrate(worst, np.array(toxic))
    return model


def scored(docs: DataFrame, model: Model | None, passing: tuple[str, ...], text: str = "text", name: str = "score") -> DataFrame:
    """The columns ``passing`` and ``name``: 0 to 1, higher for likelier toxic."""
    common.text_batches(docs.sparkSession)
    keep = [c for c in passing if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: SYMBOLS ** ORDER numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for b in batches:
            bags = [m.units_of(t or "") if m else set() for t in b.column(0).to_pylist()]
            if m is None:
                found = np.zeros(len(bags))
            else:
                new = sorted(set().union(*bags) - known.keys()) if bags else []
                if len(known) > CACHE:
                    known.clear()
                    new = sorted(set().union(*bags))
                known.update(zip(new, m.unit_values(new).tolist(), strict=True))
                found = m.score(np.array([max(map(known.__getitem__, u), default=m.bias) for u in bags]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.float64())], [*b.schema.names[1:], name])

    schema = StructType([*docs.select(*keep).schema.fields, StructField(name, DoubleType())])
    return docs.select(F.col(text).alias("_text_to_score"), *keep).mapInArrow(run, schema)


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = TRAIN_DOCS) -> tuple[list[str], list[bool]]:
    """Labelled texts of at most TRAIN_BYTES, at most ``bound`` of each kind, first by a hash of the key; rows of unlike labels for one key do not count."""
    told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).where("_lo = _hi")
    kinds = [told.where(F.col("_lo") == kind).orderBy(F.xxhash64(key), key).limit(bound) for kind in (0, 1)]
    few = kinds[0].union(kinds[1]).select(key, (F.col("_lo") == 1).alias("_toxic"))
    rows = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(few), key).where(F.octet_length("_text") <= TRAIN_BYTES).select(key, "_text", "_toxic").distinct().orderBy(key, "_text").collect()
    return [r["_text"] for r in rows], [r["_toxic"] for r in rows]


def op5_subsequence_svm(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    fold: Callable = lambda: F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = trained(*sample(docs, labels.where(~fold())))
    rows = scored(docs, model, ("doc_id",))
    return rows.select("doc_id", F.coalesce(fold(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op5_subsequence_svm": op5_subsequence_svm}
ORACLE_SQL = {}
