"""Evaluation passages inside corpus documents, whole or in part.

Latent semantic retrieval finds candidates, an exact check decides:

1. Term statistics of all documents give inverse-frequency weights.
2. The evaluation items are cut into overlapping windows of words; their TF-IDF
   matrix is factorised by a randomised SVD whose passes over the windows are
   distributed sums (``latent_basis``).
3. Documents are cut into windows in the same way.  A window with neither a row
   of word pairs known from the items, as long as RUN words need, nor a part of a
   span with enough known pairs for a whole item, cannot hold a passage; the others are projected
   and compared with all item windows by cosine, and must share words enough.
4. For each candidate the common run of words and, for the whole item, the
   longest common subsequence around the place of the match are computed, and
   the item's rarest words (its answers) must be there too.

A run of ``RUN`` words lies wholly inside a window of ``WINDOW`` words at a step of
``STEP``, in the item as in the document, so windows lose no run by position.

Documents stay where they are: both passes are maps, nothing is shuffled but
term counts.  Items are handled in blocks of ``BLOCK_ITEMS``, each a pass over the
documents, so that what is broadcast stays bounded.

Defined results: null, empty and wordless texts contain nothing and are
contained in nothing; an item shorter than RUN words counts only as a whole; an
item or document that is repeated is reported once per id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textblock as tb
from ..functions.postings import per_row as _per_row

RUN, WINDOW, STEP = 16, 24, 8
#: One word in this many of a whole item may be replaced or left out.
LOOSE = 8
BLOCK_ITEMS = 500
PAIR_PLACES = 1 << 22
BUCKETS = 1 << 18
#: Dimensions of the latent space, oversampling and power iterations of the SVD.
RANK, EXTRA, POWERS = 256, 32, 2
#: Windows of items that a task multiplies, and terms whose sums travel together.
WINDOWS_A_TASK, TERM_BLOCK = 400, 1024
#: Least cosine of a candidate in the latent space.
COSINE = 0.4
#: Share of an item's words that count as its answers, and how many of them a whole match must hold.
ANSWERS, ANSWERED = 0.2, 0.5


def term_counts(documents: DataFrame, text_col: str) -> np.ndarray:
    """Occurrences per hash bucket of the words of all texts; BUCKETS rows reach the driver at most."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            h, _ = tb.hashed_words(b.column(0))
            total += np.bincount(h & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["b", "n"])

    got = documents.select(F.col(text_col).cast("string")).mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[got.column("b").to_numpy()] = got.column("n").to_numpy()
    return counts


def weights_of(counts: np.ndarray) -> np.ndarray:
    """Squared inverse passage frequency of every bucket, a word counting once in WINDOW words."""
    return np.maximum(np.log((1.0 + counts.sum()) / WINDOW / (1.0 + counts)), 0.1).astype(np.float32) ** 2


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of the windows of all texts; the last one of a text may be shorter."""
    size = np.diff(first)
    count = np.where(size > 0, np.maximum(np.ceil((size - WINDOW) / STEP).astype(np.int64), 0) + 1, 0)
    of, k = _per_row(count)
    begin = first[of] + k * STEP
    return begin, np.minimum(begin + WINDOW, first[of + 1]), of


class Items:
    """The evaluation items of one block: words, windows and vocabulary."""

    def __init__(self, ids: list[int], texts: list[str | None], weight: np.ndarray) -> None:
        self.ids = np.array(ids, np.int64)
        self.words, self.first = tb.hashed_words(pa.array(texts, pa.large_string()))
        self.vocabulary, self.term = np.unique(self.words, return_inverse=True)
        self.weight = weight[self.vocabulary & (BUCKETS - 1)]
        self.begin, self.end, self.of = windows(self.first)

    def answers(self, i: int) -> set[int]:
        """The rarest words of an item."""
        a, b = self.first[i], self.first[i + 1]
        terms = np.unique(self.term[a:b])
        rare = terms[np.argsort(-self.weight[terms], kind="stable")][: max(1, int(len(terms) * ANSWERS))]
        return set(self.vocabulary[rare].tolist())


def rows_times(values: np.ndarray, terms: np.ndarray, begin: np.ndarray, end: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """For each window the sum of value x basis row over its terms."""
    row, k = _per_row(end - begin)
    at = begin[row] + k
    out = np.zeros((len(begin), basis.shape[1]), np.float32)
    if len(at):
        filled = end > begin
        starts = (np.cumsum(end - begin) - (end - begin))[filled]
        out[filled] = np.add.reduceat(basis[terms[at]] * values[at][:, None], starts, axis=0)
    return out


def latent_basis(spark, items: Items) -> np.ndarray:
    """Terms x RANK: right singular vectors of the items' TF-IDF windows, by randomised SVD.

    A pass multiplies the windows' matrix by a thin one and its transpose back;
    the windows are rows of a table, each task sums its part, and the parts are
    added up on the executors, TERM_BLOCK terms at a time.
    """
    n_terms = len(items.vocabulary)
    k = min(RANK + EXTRA, n_terms, max(len(items.begin), 1))
    table = pa.table({"terms": [items.term[a:b] for a, b in zip(items.begin, items.end)]}, pa.schema([("terms", pa.list_(pa.int64()))]))
    rows = spark.createDataFrame(table).repartition(max(1, len(items.begin) // WINDOWS_A_TASK))
    weight = spark.sparkContext.broadcast(items.weight)

    def both_ways(thin: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(thin)

        def run(batches):
            total = np.zeros_like(shared.value, np.float64)
            for b in batches:
                offs = b.column(0).offsets.to_numpy().astype(np.int64)
                terms = b.column(0).values.to_numpy()
                value = weight.value[terms]
                norm = np.sqrt(np.maximum(np.add.reduceat(value.astype(np.float64) ** 2, offs[:-1]), 1e-12)) if len(terms) else np.zeros(0)
                value = (value / np.repeat(norm, np.diff(offs))).astype(np.float32)
                y = rows_times(value, terms, offs[:-1], offs[1:], shared.value)
                np.add.at(total, terms, np.repeat(y, np.diff(offs), axis=0) * value[:, None])
            for lo in range(0, len(total), TERM_BLOCK):
                if total[lo : lo + TERM_BLOCK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([total[lo : lo + TERM_BLOCK].tobytes()], pa.binary())], ["at", "part"])

        def added(parts: pa.Table) -> pa.Table:  # one part a task
            total = sum(np.frombuffer(x.as_py(), np.float64) for x in parts.column(1))
            return pa.table({"at": pa.array([parts.column(0)[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

        sums = rows.mapInArrow(run, "at int, part binary").groupBy("at").applyInArrow(added, "at int, part binary").toArrow()
        got = np.zeros_like(thin, np.float64)
        for at, part in zip(sums.column(0).to_pylist(), sums.column(1)):
            block = np.frombuffer(part.as_buffer(), np.float64).reshape(-1, thin.shape[1])
            got[at : at + len(block)] = block
        return got

    thin = np.random.default_rng(7).standard_normal((n_terms, k)).astype(np.float32)
    for _ in range(POWERS + 1):
        thin = np.linalg.qr(both_ways(thin))[0].astype(np.float32)
    values, vectors = np.linalg.eigh(thin.T @ both_ways(thin))
    return (thin @ vectors[:, ::-1][:, :RANK]).astype(np.float32)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-9)


def common_run(doc: list[int], item: list[int]) -> int:
    """Longest run of consecutive words in both."""
    best, last = 0, {}
    places: dict[int, list[int]] = {}
    for j, w in enumerate(item):
        places.setdefault(w, []).append(j)
    for w in doc:
        now = {j: last.get(j - 1, 0) + 1 for j in places.get(w, ())}
        if now:
            best = max(best, max(now.values()))
        last = now
    return best


def common_subsequence(doc: list[int], item: list[int]) -> int:
    """Length of the longest common subsequence, one bit for each item word."""
    masks: dict[int, int] = {}
    for j, w in enumerate(item):
        masks[w] = masks.get(w, 0) | (1 << j)
    full = (1 << len(item)) - 1
    row = full
    for w in doc:
        m = masks.get(w, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


def surely_kept(n: int) -> tuple[int, int]:
    """Of a whole item of n words in a document, wherever its windows fall: the words of it that the best window spans,
    and minus the most that can be missing of them, if one word in LOOSE is.
    """
    missing = n // LOOSE
    best = (WINDOW + n, 0)
    for offset in range(STEP):  # words between the start of the item and the next window
        spans = [min(n, begin + WINDOW) - max(0, begin) for begin in range(offset - WINDOW // STEP * STEP, n, STEP) if begin + WINDOW > 0]
        whole = sum(x == min(n, WINDOW) for x in spans)
        held = max(spans)
        # Missing words fall on disjoint windows in turn, and each on WINDOW / STEP overlapping ones at most.
        disjoint = max(1, (n - offset) // WINDOW)
        most = min(missing, missing // disjoint if n - offset >= WINDOW else missing, WINDOW // STEP * missing // max(whole, 1))
        best = min(best, (held, -most), key=sum)
    return best


def _pair_places(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of word pairs in the table of those that items hold."""
    return (tb.mix(left.view(np.uint64) * np.uint64(1_000_003) + right.view(np.uint64)) & np.uint64(PAIR_PLACES - 1)).astype(np.int64)


class Matcher:
    """Retrieval and check of one block of items against documents."""

    def __init__(self, items: Items, basis: np.ndarray, weight: np.ndarray) -> None:
        self.items, self.basis, self.weight = items, basis, weight
        latent = rows_times(items.weight[items.term], items.term, items.begin, items.end, basis)
        self.latent = _unit(latent).T.copy()
        self.lists = [items.words[a:b].tolist() for a, b in zip(items.first[:-1], items.first[1:])]
        n = np.diff(items.first)
        kept = {int(k): surely_kept(int(k)) for k in np.unique(n[n > 0])}
        #: Words of an item that some window of a document holding the item has at least.
        self.need = np.array([min(RUN, sum(kept[int(k)])) if k else 0 for k in n])
        #: Lengths of items, and the word pairs that so many words of a document hold if they are the item: every word that is missing breaks two.
        self.spans = [(k, k - 1 - 2 * (k // LOOSE)) for k in kept]
        self.pairs = np.zeros(PAIR_PLACES, bool)
        inner = np.ones(max(len(items.words) - 1, 0), bool)
        border = items.first[1:-1] - 1
        inner[border[(border >= 0) & (border < len(inner))]] = False
        self.pairs[_pair_places(items.words[:-1], items.words[1:])[inner]] = True
        row, k = _per_row(items.end - items.begin)
        #: Window and term of every word of the items' windows, ascending.
        self.has = np.unique(row * len(items.vocabulary) + items.term[items.begin[row] + k])
        self.answers = [items.answers(i) if b > a else set() for i, (a, b) in enumerate(zip(items.first[:-1], items.first[1:]))]

    def promising(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text of the windows that can hold a passage."""
        begin, end, of = windows(first)
        n = len(words)
        if n < 2:
            return begin, end, of
        known = np.zeros(n, bool)
        known[:-1] = self.pairs[_pair_places(words[:-1], words[1:])]
        last = first[1:][first[1:] > first[:-1]] - 1
        known[last] = False  # no pair spans two texts
        place = np.arange(n)
        in_row = place - np.maximum.accumulate(np.where(known, -1, place))
        runs = np.concatenate([[0], np.cumsum(in_row >= RUN - 1)])
        upto = np.concatenate([[0], np.cumsum(known)])
        has_run = runs[np.maximum(end - 1, begin)] - runs[np.minimum(begin + RUN - 2, np.maximum(end - 1, begin))] > 0
        edges = np.zeros(n + 1, np.int64)  # where spans that may be a whole item begin and end
        for size, least in self.spans:
            last = np.minimum(size - 1, n)
            at = np.flatnonzero(upto[last:] - upto[: n + 1 - last] >= least) if least > 0 else np.arange(n)
            edges += np.bincount(np.minimum(at, n), minlength=n + 1) - np.bincount(np.minimum(at + size, n), minlength=n + 1) if len(at) else 0
        inside = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:n] > 0)])
        keep = has_run | (inside[end] > inside[begin])
        return begin[keep], end[keep], of[keep]

    def candidates(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place where the item would begin, item) of every pair of windows that is near in the latent space."""
        items = self.items
        begin, end, of = self.promising(words, first)
        texts, starts, found = [], [], []
        for lo in range(0, len(begin), 2000):
            b, e = begin[lo : lo + 2000], end[lo : lo + 2000]
            row, k = _per_row(e - b)
            w = words[b[row] + k]
            term = np.searchsorted(items.vocabulary, w)
            term[term == len(items.vocabulary)] = 0
            known = items.vocabulary[term] == w
            row, term = row[known], term[known]
            at = np.searchsorted(row, np.arange(len(b) + 1))
            q = _unit(rows_times(items.weight[term], term, at[:-1], at[1:], self.basis))
            i, j = np.nonzero(q @ self.latent >= COSINE)
            # Of the document's window at least as many words must be the item window's.
            r, k = _per_row(at[i + 1] - at[i])
            asked = j[r] * len(items.vocabulary) + term[at[i][r] + k]
            place = np.minimum(np.searchsorted(self.has, asked), max(len(self.has) - 1, 0))
            shared = np.bincount(r, self.has[place] == asked, minlength=len(i)) if len(i) else np.zeros(0)
            ok = shared >= self.need[items.of[j]]
            i, j = i[ok], j[ok]
            texts.append(of[lo + i])
            starts.append(b[i] - (items.begin[j] - items.first[items.of[j]]))
            found.append(items.of[j])
        if not texts:
            z = np.zeros(0, np.int64)
            return z, z, z
        return np.concatenate(texts), np.concatenate(starts), np.concatenate(found)

    def holds(self, words: np.ndarray, lo: int, hi: int, start: int, item: int) -> bool:
        """Whether the text at words[lo:hi] holds the item, looked for around *start*."""
        target = self.lists[item]
        n = len(target)
        a, b = max(lo, start - WINDOW - STEP), min(hi, start + n + WINDOW + STEP)
        doc = words[a:b].tolist()
        if len(set(doc) & set(target)) < min(RUN, n - n // LOOSE) // 2:
            return False
        if common_run(doc, target) >= RUN:
            return True
        answers = self.answers[item]
        return common_subsequence(doc, target) >= n - n // LOOSE and len(answers & set(doc)) >= ANSWERED * len(answers)

    def match(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) of all items held by the texts."""
        text, start, item = self.candidates(words, first)
        # Neighbouring windows ask the same question.
        asked = np.unique(np.stack([text, item, start // STEP], 1), axis=0) if len(text) else np.zeros((0, 3), np.int64)
        out: set[tuple[int, int]] = set()
        for t, i, s in asked.tolist():
            if (t, i) not in out and self.holds(words, int(first[t]), int(first[t + 1]), s * STEP, i):
                out.add((t, i))
        pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def leaked(documents: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id) of every item that a document holds."""
    spark = documents.sparkSession
    weight = weights_of(term_counts(documents, doc_text))
    out = spark.createDataFrame([], "doc_id long, item_id long")
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i is not null").dropDuplicates(["i"]).orderBy("i")
    block: list = []

    def flush() -> None:
        nonlocal out
        if block:
            out = out.unionByName(_one_block(documents, Items([r.i for r in block], [r.t for r in block], weight), weight, doc_id, doc_text))
            block.clear()

    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK_ITEMS:
            flush()
    flush()
    return out


def _one_block(documents: DataFrame, items: Items, weight: np.ndarray, doc_id: str, doc_text: str) -> DataFrame:
    spark = documents.sparkSession
    if not len(items.words):
        return spark.createDataFrame([], "doc_id long, item_id long")
    shared = spark.sparkContext.broadcast((items, latent_basis(spark, items), weight))

    def run(batches):
        matcher = Matcher(*shared.value)
        for b in batches:
            for lo, hi in tb.slices(b.column(1)):
                words, first = tb.hashed_words(b.column(1).slice(lo, hi - lo))
                text, item = matcher.match(words, first)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(text)), pa.array(matcher.items.ids[item])], ["doc_id", "item_id"])

    return documents.select(F.col(doc_id).cast("long").alias("d"), F.col(doc_text).cast("string")).filter("d is not null").mapInArrow(run, "doc_id long, item_id long").distinct()
