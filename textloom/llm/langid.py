"""Language of each text and of each segment of mixed texts.

Character n-grams of words are kept in one bit-sliced Bloom filter: each slot is
a bit mask over languages, a lookup ANDs the slots of an n-gram and returns all
languages that contain it at once.  Per-language popcounts, corrected for the
filter's false positives, decide.

* ``train`` fits the filter on about ``TRAIN_TEXTS`` labelled texts of each
  language (those whose hash of id and side is below its share), a documented bound.  An
  n-gram enters the filter of a language if its rate there is at least
  ``MEMBER_SHARE`` of its highest rate, so that wrong labels do not count.
* ``segments`` gives each word the popcounts of its n-grams (an n-gram of c
  languages counts 1/c for each, one of more than ``COMMON`` nothing), sums them
  over a window of words and cuts the text into runs of one best language.  A
  run of fewer than ``SEGMENT_WORDS`` words, or without clearly more evidence
  than the main language has in it, joins its surroundings: names, numbers and
  single foreign words are no segment.

Defined results: null, empty and wordless texts, and texts without any known
n-gram, have no language and no segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textblock as tb
from ..hashing import portable_hash
from .pairs import row_sums
from ..storage import cut

LANGUAGES = ("en", "de", "fr", "es", "pt", "ru", "fa", "ar")
#: Labelled texts of each language that the filter is fitted on at most.
TRAIN_TEXTS = 4000
MEMBER_SHARE, LEAST_COUNT = 0.15, 3
SLOTS, HASHES = 1 << 20, 3
COMMON = 3
WINDOW, SEGMENT_WORDS = 4, 5
#: How many times the main language's evidence a segment's own must be.
CLEARLY = 1.5

# Three-letter codes of the languages above.
THREE = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "rus": "ru", "fas": "fa", "per": "fa", "ara": "ar"}


def primary(label: Column) -> Column:
    """The language that a label names: lower case, without blanks and region; null if blank."""
    tag = F.lower(F.element_at(F.split(F.regexp_replace(label, r"^\s+|\s+$", ""), "[-_]"), 1))
    tag = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in THREE.items() for x in kv]), tag), tag)
    return F.when(tag != "", tag)


def unique_words(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of one occurrence of each different word, and for every word its number among them."""
    _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    return starts[one], ends[one], back


def grams(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 3- and 4-grams of ' word ' and the number of the word; words with digits have none."""
    size = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(size)])
    pos = np.arange(at[-1]) - np.repeat(at[:-1], size)
    word = np.repeat(np.arange(len(starts)), size)
    inner = (pos > 0) & (pos < size[word] - 1)
    chars = np.full(at[-1], tb.SPACE, np.uint64)
    chars[inner] = folded[(starts[word] + pos - 1)[inner]]
    digit = row_sums(((chars >= 48) & (chars <= 57)).astype(np.int64), at) > 0
    out, of = [], []
    for n in (3, 4):
        first = np.flatnonzero((pos + n <= size[word]) & ~digit[word])
        h = np.zeros(len(first), np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + chars[first + k]
        out.append(tb.mix(h + np.uint64(n)))
        of.append(word[first])
    return np.concatenate(out), np.concatenate(of)


def slots_of(gram: np.ndarray) -> list[np.ndarray]:
    """The HASHES places of each n-gram in the filter."""
    return [((gram >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


def train(texts: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """The filter, a mask for each slot, from (key, text, label): key identifies the text, label may be wrong or null.

    Labels are counted first, then one scan draws the texts whose hash lies below
    their language's share.  What reaches the driver is the filter itself, SLOTS
    masks at most.
    """
    labelled = texts.withColumn("label", primary(F.col("label"))).filter(F.col("label").isin(*languages))
    have = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one a language
    limit = [F.lit(x) for lang, n in have.items() for x in (lang, float(16**12) * min(1.0, TRAIN_TEXTS / n))]
    below = F.element_at(F.create_map(*limit), F.col("label")) if limit else F.lit(0.0)
    drawn = labelled.filter(portable_hash(F.col("key"), "langid", digits=12) < below)
    sample = drawn.select("text", F.array_position(F.array(*map(F.lit, languages)), F.col("label")).cast("int").alias("lang"))

    def count(batches):
        for b in batches:
            lang = b.column(1).to_numpy() - 1
            for lo, hi in tb.slices(b.column(0)):
                codes, offs = tb.codes_of(tb.strip_tags(b.column(0).slice(lo, hi - lo)))
                f, offs = tb.fold(codes, offs)
                s, e, first = tb.words(f, offs)
                g, word = grams(f, s, e)
                of = np.repeat(lang[lo:hi], np.diff(first))[word]
                for i in range(len(languages)):
                    each, n = tb.distinct(g[of == i])
                    yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(np.full(len(each), i, np.int32)), pa.array(n)], ["g", "lang", "n"])

    counts = cut(sample.mapInArrow(count, "g long, lang int, n long").groupBy("g", "lang").agg(F.sum("n").alias("n")), "langid-counts")
    total = dict(counts.groupBy("lang").agg(F.sum("n")).collect())
    rate = F.create_map(*[F.lit(x) for kv in total.items() for x in kv]) if total else F.create_map(F.lit(0), F.lit(1))
    rows = counts.withColumn("r", F.col("n") / F.element_at(rate, F.col("lang")))
    most = rows.groupBy("g").agg(F.max("r").alias("most"), F.collect_list(F.struct("lang", "n", "r")).alias("by"))  # at most one entry a language
    masks = most.select("g", F.explode("by").alias("x"), "most").filter(f"x.n >= {LEAST_COUNT} and x.r >= {MEMBER_SHARE} * most").groupBy("g").agg(F.bit_or(F.expr("shiftleft(1L, x.lang)")).alias("mask")).toArrow()
    table = np.zeros(SLOTS, mask_type(len(languages)))
    g, m = masks.column("g").to_numpy().view(np.uint64), masks.column("mask").to_numpy().view(np.uint64).astype(table.dtype)
    for slot in slots_of(g):
        np.bitwise_or.at(table, slot, m)
    return table


def mask_type(languages: int) -> type:
    """The least unsigned integer with a bit for each language."""
    if languages > 64:
        raise ValueError("a filter holds at most 64 languages")
    return np.uint16 if languages <= 16 else np.uint32 if languages <= 32 else np.uint64


class Detector:
    """The filter with its false-positive corrections."""

    def __init__(self, table: np.ndarray, languages: tuple[str, ...] = LANGUAGES) -> None:
        self.table, self.languages = table, languages
        n = len(languages)
        fill = np.array([((table >> table.dtype.type(i)) & table.dtype.type(1)).mean() for i in range(n)])
        self.wrong = fill**HASHES
        #: Few languages: what every mask weighs, worked out once.
        self.every = self.weights(np.arange(1 << n, dtype=table.dtype)) if n <= 10 else None

    def weights(self, masks: np.ndarray) -> np.ndarray:
        """What n-grams of these masks weigh for each language, corrected for false positives; those of no language, or of too many, nothing."""
        kind = self.table.dtype.type
        bits = np.stack([(masks >> kind(i)) & kind(1) for i in range(len(self.languages))], 1).astype(np.float32)
        c = bits.sum(1)
        out = ((bits / np.maximum(c, 1)[:, None] - self.wrong) / (1 - self.wrong)).astype(np.float32)
        out[(c == 0) | (c > COMMON)] = 0
        return out

    def evidence(self, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Evidence of every word for every language."""
        if len(starts) == 0:
            return np.zeros((0, len(self.languages)), np.float32)
        s, e, back = unique_words(folded, starts, ends, tb.word_hashes(folded, starts, ends))
        g, word = grams(folded, s, e)
        a, b, c = slots_of(g)
        masks = self.table[a] & self.table[b] & self.table[c]
        per = np.zeros((len(s), len(self.languages)), np.float32)
        weight = self.every
        if weight is None:
            values, masks = np.unique(masks, return_inverse=True)
            weight = self.weights(values)
        told = np.flatnonzero(weight.any(1)[masks])
        masks, word = masks[told], word[told]
        for i in range(len(self.languages)):
            per[:, i] = np.bincount(word, weight[masks, i], len(s))
        return per[back]

    def segments(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Segments of all texts: row, lang (index), words, confidence; main: each text's language, -1 for none."""
        codes, offs = tb.codes_of(tb.strip_tags(texts))
        f, offs = tb.fold(codes, offs)
        s, e, first = tb.words(f, offs)
        return self.segments_of(self.evidence(f, s, e), first)

    @staticmethod
    def sums(ev: np.ndarray) -> np.ndarray:
        """Evidence of all words before each."""
        out = np.zeros((len(ev) + 1, ev.shape[1]))
        np.cumsum(ev, 0, np.float64, out[1:])
        return out

    def segments_of(self, ev: np.ndarray, first: np.ndarray, upto: np.ndarray | None = None) -> dict[str, np.ndarray]:
        n = len(first) - 1
        upto = self.sums(ev) if upto is None else upto
        total = upto[first[1:]] - upto[first[:-1]]
        main = np.where(total.max(1, initial=0) > 0.5, total.argmax(1), -1) if n else np.zeros(0, np.int64)
        row = np.repeat(np.arange(n), np.diff(first))
        at = np.arange(len(ev))
        near = upto[np.minimum(at + WINDOW + 1, first[row + 1])] - upto[np.maximum(at - WINDOW, first[row])]
        best = near.argmax(1)
        best = np.where(near.max(1, initial=0) > 0.5, best, main[row])
        run, begin, end, lang = self._runs(best, row)
        inside = upto[end] - upto[begin]
        own, base = inside[np.arange(len(lang)), lang], inside[np.arange(len(lang)), np.maximum(main[run], 0)]
        real = (lang == main[run]) | ((end - begin >= SEGMENT_WORDS) & (own > CLEARLY * base) & (own > 0.4 * (end - begin)))
        lang = np.where(real, lang, main[run])
        # A main language without a run of its own: the text is in what its runs say.
        best = np.repeat(lang, end - begin)
        run, begin, end, lang = self._runs(best, row)
        inside = upto[end] - upto[begin]
        share = inside[np.arange(len(lang)), np.maximum(lang, 0)] / np.maximum(inside.clip(0).sum(1), 1e-9)
        keep = lang >= 0
        return {"row": run[keep], "lang": lang[keep], "begin": begin[keep] - first[run[keep]], "words": (end - begin)[keep], "confidence": np.clip(share[keep], 0, 1), "main": main}

    @staticmethod
    def _runs(best: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if len(best) == 0:
            z = np.zeros(0, np.int64)
            return z, z, z, z
        begin = np.concatenate([[0], np.flatnonzero((best[1:] != best[:-1]) | (row[1:] != row[:-1])) + 1])
        return row[begin], begin, np.concatenate([begin[1:], [len(best)]]), best[begin]
