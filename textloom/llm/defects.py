"""Broken prompt-response pairs: a multi-label linear classifier.

``fit`` takes all pairs and makes defective ones of them: truncated (with and
without an ellipsis, within words and between sentences), copied (numbered,
quoted, repeated), swapped for an answer in another language, refused, emptied.

Refusals are not listed but learnt: a response given word for word to at least
``RECUR`` prompts whose lengths differ by ``SPREAD`` depends on none of them
(``recurring``).  All of them are learnt from as refused responses; half are
shown to the classifier by the words of the others only, so that it also knows
refusals that it has not seen.

Usual ratios, frequent words, words of refusals and endings are counted over all
pairs.  The features of each pair, and of what is made of it, are written once,
to be learnt from and to be judged.  One logistic regression for each defect is
trained on hashed n-grams of the response's end and on binned features of the
pair, by tasks whose weights are averaged after each pass; pairs that a first
round finds defective leave the sound ones in the second.  Each threshold is the
least one that keeps ``PRECISION`` on the held-out pairs (a quarter, by hash),
counted by score, but gives up at most ``MISSED`` of their defective ones.  The
driver holds weights, counts by score and the frequent among the statistics.

Defined results: a null, blank or placeholder response is ``empty`` whatever the
prompt; a null prompt is an empty text; repeated rows give one result; of
several defects the first in ``DEFECTS`` is given.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import labels as lab, textblock as tb
from .langid import LANGUAGES, primary
from ..functions.postings import in_bitmap, key_bitmap, per_row
from ..hashing import portable_hash
from ..storage import cut, forget, freeing, small_enough

DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated")
#: Distinct prompts of a recurring response, the least ratio of their lengths, and its least words.
RECUR, SPREAD, SAID_WORDS = 3, 1.2, 3
#: One recurring response weighs as one in SAID_SHARE of all pairs, or SAID_ROWS pairs; one pair of it at most SAID_WEIGHT.
SAID_ROWS, SAID_SHARE, SAID_WEIGHT = 20, 600, 4.0
#: Recurring responses up to this many are broadcast; more are joined.
BROADCAST_SAID = 200_000
#: How many times as frequent in recurring responses as in others a word or word pair must be to speak for a refusal.
SPEAKS = 5
#: Parts of the written examples, at least, and pairs to a part.
TASKS, SHARD_ROWS = 12, 100_000
#: Words that a task gathers before it counts and writes them.
GATHERED = 2_000_000
PLACES = 1 << 16
#: Averages of the tasks' weights; of less than FEW pairs each task goes through its own several times, up to EPOCHS, before each.
PASSES, FEW, EPOCHS = 2, 120_000, 6
RATE, BATCH = 0.15, 256
#: Share of the pairs that is held out to set thresholds.
HELD = 0.25
PRECISION, MISSED = 0.98, 0.02
#: Scores are counted from -SCORE_RANGE to SCORE_RANGE, in so many steps.
SCORE_RANGE, SCORES = 32.0, 8192
#: Share of the pairs that has an ending, for each level of usual ones.
LEVELS = (1 / 12_000, 3 / 12_000, 10 / 12_000, 50 / 12_000)
#: Weight of the synthetic pairs against sound ones when thresholds are set: about their share in real data.
REAL_SHARE = 0.02

# Words that stand in place of a text.
PLACEHOLDERS = "n a na nan nil null none empty missing blank todo tbd undefined leer vacio vide vazio пусто нет خالی تهی فارغ"
# Names of the languages in these languages, in the order of LANGUAGES.
LANGUAGE_NAMES = {
    "en": "English Englisch anglais inglés inglês английском английски английский انگلیسی الإنجليزية بالإنجليزية",
    "de": "German Deutsch allemand alemán alemão немецком немецки немецкий آلمانی الألمانية بالألمانية",
    "fr": "French Französisch français francés francês французском французски французский فرانسوی فرانسه الفرنسية بالفرنسية",
    "es": "Spanish Spanisch espagnol español espanhol испанском испански испанский اسپانیایی الإسبانية بالإسبانية",
    "pt": "Portuguese Portugiesisch portugais portugués português португальском португальски португальский پرتغالی البرتغالية بالبرتغالية",
    "ru": "Russian Russisch russe ruso russo русском русски русский روسی الروسية بالروسية",
    "fa": "Persian Farsi Persisch persan persa персидском персидски персидский فارسی الفارسية بالفارسية",
    "ar": "Arabic Arabisch arabe árabe арабском арабски арабский عربی العربية بالعربية",
}
#: The request for a language stands among the last words of a prompt.
REQUEST_WORDS = 8

_CLOSERS = " \t\r\n\"'”“«»)]*_>`|"
_ENDS = ".!?؟。۔"
_COMMAS = ",;:-–—،؛"
_AFTER = _CLOSERS + _ENDS + "…,;:-"
_STOPS = ".!?؟۔"
_CUT = re.compile(r"(?:\.\.\.|…|\[\.\.\.\]|\[…\])[\"'”»)*\s]*$")


def _sizes(texts: pa.Array) -> np.ndarray:
    """Words of each text, as many as in its block."""
    codes, offs = tb.codes_of(tb.strip_tags(texts))
    return np.diff(tb.words(*tb.fold(codes, offs))[2])


def _hash(words: str) -> np.ndarray:
    return tb.hashed_words(pa.array([words], pa.large_string()))[0]


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tb.mix(a.view(np.uint64) * np.uint64(0x9E3779B1) + b.view(np.uint64))


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in an ascending table."""
    if not len(table):
        return np.zeros(len(values), bool)
    # A bitmap by the lowest bits drops most of the others: a search costs more.
    bits = 8 * len(table) + 63
    bits = np.uint64((1 << bits.bit_length()) - 1)
    may = np.zeros(int(bits) + 1, bool)
    may[table.view(np.uint64) & bits] = True
    out = may[values.view(np.uint64) & bits]
    of = np.flatnonzero(out)
    few = values[of]
    at = np.searchsorted(table, few)
    at[at == len(table)] = 0
    out[of] = table[at] == few
    return out


def _numbers(f: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which words of the folded text *f* have digits only."""
    digit = (f >= 48) & (f <= 57)
    out = digit[s] & digit[e - 1]
    at = np.flatnonzero(out & (e - s > 2))
    row, k = per_row(e[at] - s[at])
    out[at] = np.bincount(row, digit[s[at][row] + k], len(at)) == e[at] - s[at]
    return out


class Block:
    """Words of a column of texts: hashes, starts, and which are numbers."""

    def __init__(self, texts: pa.Array) -> None:
        codes, offs = tb.codes_of(tb.strip_tags(texts))
        f, offs = tb.fold(codes, offs)
        s, e, self.first = tb.words(f, offs)
        self.words = tb.word_hashes(f, s, e)
        self.number = _numbers(f, s, e)
        self.size = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.size)), self.size)

    @functools.cached_property
    def key(self) -> np.ndarray:
        """Row and word of all distinct words, ascending."""
        return tb.distinct((self.row.astype(np.uint64) << np.uint64(32)) | (self.words.view(np.uint64) & np.uint64(0xFFFFFFFF)))[0]

    @functools.cached_property
    def distinct(self) -> np.ndarray:
        return np.bincount((self.key >> np.uint64(32)).astype(np.int64), minlength=len(self.size))

    def take(self, rows: np.ndarray) -> Block:
        """The block of the texts *rows*."""
        out = object.__new__(Block)
        out.size = self.size[rows]
        out.row, k = per_row(out.size)
        at = self.first[rows][out.row] + k
        out.words, out.number, out.first = self.words[at], self.number[at], np.concatenate([[0], np.cumsum(out.size)])
        out.distinct = self.distinct[rows]
        row, k = per_row(out.distinct)
        start = np.cumsum(self.distinct) - self.distinct
        out.key = (row.astype(np.uint64) << np.uint64(32)) | (self.key[start[rows][row] + k] & np.uint64(0xFFFFFFFF))
        return out

    def common(self, other: Block) -> np.ndarray:
        both = np.intersect1d(self.key, other.key, assume_unique=True)
        return np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(self.size))

    def numbers(self) -> np.ndarray:
        w, r = self.words[self.number], self.row[self.number]
        return tb.distinct((r.astype(np.uint64) << np.uint64(32)) | (w.view(np.uint64) & np.uint64(0xFFFFFFFF)))[0]


def _ending(text: str) -> tuple[int, int, int]:
    """How a response ends: kind of its end (0 mark, 1 cut mark, 2 comma or dash, 3 nothing), words and digits of the last sentence."""
    t = text
    if _CUT.search(t):
        kind = 1
    else:
        bare = t.rstrip(_CLOSERS)
        last = bare[-1:] or " "
        kind = 0 if last in _ENDS else 2 if last in _COMMAS else 3
    bare = t.rstrip(_AFTER)
    at = max((bare.rfind(c + " ") for c in _STOPS), default=-1)
    at = max(at, bare.rfind("\n"))
    tail = bare[at + 1 :].split()
    return kind, len(tail), sum(w[:1].isdigit() or w[-1:].isdigit() for w in tail)


@functools.cache
def _classes() -> np.ndarray:
    """For every code point the sets of ``_ending`` that it is in, one bit each; those from 0x1FFFF on are in none."""
    out = np.zeros(0x20000, np.uint8)
    for bit, chars in enumerate((_CLOSERS, _ENDS, _COMMAS, _AFTER, _STOPS, "\"'”»)*")):
        out[[ord(c) for c in chars]] |= 1 << bit
    for c in range(0x1FFFF):
        out[c] |= (chr(c).isspace() << 6) | (chr(c).isdigit() << 7)
    return out


def _endings(texts: pa.Array) -> np.ndarray:
    """``_ending`` of every text."""
    codes, offs = tb.codes_of(texts)
    lo, hi = offs[:-1], offs[1:]
    if not len(codes):
        return np.tile([3, 0, 0], (len(lo), 1))
    sets = _classes()[np.minimum(codes, 0x1FFFF)]
    closer, end, comma, after, stop, quote, space, digit = ((sets & (1 << bit)) != 0 for bit in range(8))

    def last(of: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """The last place of *of* in each text before *upto*; the one before its start if there is none."""
        at = np.concatenate([[-1], np.flatnonzero(of)])
        return np.maximum(at[np.searchsorted(at, upto) - 1], lo - 1)

    def char(at: np.ndarray) -> np.ndarray:
        """The code points at these places, 0 outside the text."""
        return np.where((at >= lo) & (at < hi), codes[np.clip(at, 0, len(codes) - 1)], 0)

    def dots(at: np.ndarray) -> np.ndarray:
        """Code points of the ellipsis that ends at these places."""
        three = (char(at) == 46) & (char(at - 1) == 46) & (char(at - 2) == 46)
        return np.where(three, 3, char(at) == 0x2026)

    at = last(~(quote | space), hi)
    inside = dots(at - 1)
    cut_off = (dots(at) > 0) | ((char(at) == 93) & (inside > 0) & (char(at - 1 - inside) == 91))
    at = last(~closer, hi)
    here = np.maximum(at, 0)
    kind = np.where(cut_off, 1, np.where(at < lo, 3, np.where(end[here], 0, np.where(comma[here], 2, 3))))
    upto = last(~after, hi) + 1
    blank, newline = codes == 32, codes == 10
    stop[:-1] &= blank[1:]
    begin = last(stop | newline, upto) + 1
    opens = ~space
    opens[1:] &= space[:-1]
    opens[lo[lo < hi]] = ~space[lo[lo < hi]]
    opens = np.flatnonzero(opens)
    first = np.searchsorted(opens, begin)
    n = np.searchsorted(opens, upto) - first
    row, k = per_row(n)
    a = opens[first[row] + k]
    # A word's last letter is before the next blank, or the text's last one.
    blanks = np.append(np.flatnonzero(space), len(codes))
    z = np.minimum(blanks[np.searchsorted(blanks, a)], upto[row]) - 1
    return np.stack([kind, n, np.bincount(row, digit[a] | digit[z], len(lo)).astype(np.int64)], 1)


class Features:
    """Turns pairs into rows of active feature places; fitted statistics are the usual length ratios, endings and the words of refusals."""

    def __init__(self) -> None:
        self.placeholders = np.unique(_hash(PLACEHOLDERS))
        self.ratio: dict[str, float] = {}
        none = np.zeros(0, np.int64)
        self.frequent = none
        self.tails = (np.zeros(0, np.uint64), none)
        #: How often an ending is seen, for each level.
        self.levels = np.array([2.0, 4.0, 11.0, 51.0])
        #: Words and word pairs of refusals: from all recurring responses, and from each half of them.
        self.refusal = {k: (none, np.zeros(0, np.uint64)) for k in ("all", 0, 1)}

    def shapes(self, b: Block) -> np.ndarray:
        """Words as themselves if frequent, else as a name or a number."""
        return self.shaped(b, _member(b.words, self.frequent))

    @staticmethod
    def shaped(b: Block, frequent: np.ndarray) -> np.ndarray:
        return np.where(b.number, 1, np.where(frequent, b.words, 2)).astype(np.int64)

    def tail_hashes(self, shapes: np.ndarray, b: Block) -> np.ndarray:
        """Hashes of the last 1, 2, 3 and 4 shapes of each text."""
        out = np.zeros((len(b.size), 4), np.uint64)
        h = np.zeros(len(b.size), np.uint64)
        for k in range(4):
            at = b.first[1:] - 1 - k
            w = np.where(b.size > k, shapes[np.clip(at, 0, max(len(shapes) - 1, 0))] if len(shapes) else 0, -7)
            h = tb.mix(h * np.uint64(31) + w.astype(np.int64).view(np.uint64) + np.uint64(k))
            out[:, k] = h
        return out

    def blank(self, t: Block) -> np.ndarray:
        short = np.flatnonzero(t.size <= 3)
        row, k = per_row(t.size[short])
        out = np.zeros(len(t.size), bool)
        out[short] = np.bincount(row, _member(t.words[t.first[short][row] + k], self.placeholders), len(short)) == t.size[short]
        return out

    def rows(self, s: Block, t: Block, texts: pa.Array, ratio_keys: list[str], kinds: np.ndarray, wrong: np.ndarray, halves: np.ndarray | None = None) -> np.ndarray:
        """Active places of every pair.  wrong: 1 the response's language is another one, 0 not, -1 cannot be judged.

        halves: for training pairs the half of the recurring responses whose words
        they are shown by, -1 for all.
        """
        n = len(texts)
        cols: list[np.ndarray] = []

        def add(name: int, *values: np.ndarray) -> None:
            h = np.full(n, name, np.uint64)
            for v in values:
                h = tb.mix(h * np.uint64(1_000_003) + np.asarray(v).astype(np.int64).view(np.uint64))
            cols.append((tb.mix(h) & np.uint64(PLACES - 1)).astype(np.int64))

        blank = self.blank(t)
        add(1, blank)
        # copies
        both = t.common(s)
        extra, missing = t.distinct - both, s.distinct - both
        copied = (missing == 0) & (extra <= 1) & (s.distinct > 0)
        add(2, np.minimum(extra, 4), np.minimum(missing, 4))
        add(3, copied)
        # refusals
        shares = []
        for part in ("all", 0, 1) if halves is not None else ("all",):
            words, pairs = self.refusal[part]
            known = _member(t.words, words)
            covered = np.zeros(len(t.words) + 1, bool)
            if len(t.words) > 1:
                pair = _member(_pair_hash(t.words[:-1], t.words[1:]), pairs) & (t.row[:-1] == t.row[1:])
                covered[:-2] |= pair
                covered[1:-1] |= pair
            size = np.maximum(t.size, 1)
            new = ~known & ~t.number & ~covered[:-1]
            shares.append((np.bincount(t.row, covered[:-1], n) / size, np.bincount(t.row, known, n) / size, np.bincount(t.row, new, n)))
        share, said, plain = shares[0]
        for half in (0, 1) if halves is not None else ():
            at = halves == half
            share, said, plain = (np.where(at, shares[1 + half][k], x) for k, x in enumerate((share, said, plain)))
        ratio = np.log(np.maximum(t.size, 1) / np.maximum(s.size, 1)) - np.array([self.ratio.get(k, 0.0) for k in ratio_keys])
        sn, tn = s.numbers(), t.numbers()
        n_src = np.bincount((sn >> np.uint64(32)).astype(np.int64), minlength=n)
        lost = n_src - np.bincount((np.intersect1d(sn, tn, assume_unique=True) >> np.uint64(32)).astype(np.int64), minlength=n)
        add(4, np.floor(share * 5))
        add(5, np.floor(share * 5), np.minimum(plain, 6))
        add(17, np.floor(said * 6))
        add(18, np.floor(said * 6), np.minimum(plain, 3), np.minimum(both, 2))
        add(19, np.floor(said * 6), np.floor(share * 3), np.minimum(t.size, 40) // 8)
        frequent = _member(t.words, self.frequent)
        usual = np.floor(np.bincount(t.row[frequent], minlength=n) / np.maximum(t.size, 1) * 5)
        own = np.diff(np.searchsorted(tn >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))) > 0  # has numbers
        add(40, usual, own, np.minimum(both, 2), np.minimum(t.size, 40) // 8)
        add(41, usual, np.floor(said * 4), own)
        # language
        add(6, wrong)
        add(7, wrong, copied, share > 0.5, blank)
        # length and numbers
        z = np.where(kinds == 1, 9, np.clip(np.floor(ratio / 0.08), -12, 6))
        lost = np.where(kinds == 1, 0, np.minimum(lost, 4))
        add(8, z)
        add(9, np.floor(z / 2), lost, kinds)
        add(10, lost, np.minimum(n_src, 5), kinds)
        # ending
        ends = _endings(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        tails = self.tail_hashes(self.shaped(t, frequent), t)
        at = np.searchsorted(self.tails[0], tails)
        at[at == len(self.tails[0])] = 0
        seen = np.where(self.tails[0][at] == tails, self.tails[1][at], 0) if len(self.tails[0]) else np.zeros(tails.shape, np.int64)
        level = np.digitize(seen, self.levels)
        add(11, ends[:, 0])
        add(12, ends[:, 0], level[:, 1], level[:, 2])
        add(13, ends[:, 0], level[:, 3], level[:, 2])
        for k in range(1, 4):
            add(20 + k, tails[:, k].view(np.int64))
            add(30 + k, tails[:, k].view(np.int64), ends[:, 0] % 2, np.minimum(ends[:, 2], 2))
        add(14, np.minimum(ends[:, 1], 24) // 2, np.minimum(ends[:, 2], 2))
        add(15, np.minimum(ends[:, 1], 24) // 2, np.minimum(ends[:, 2], 2), level[:, 1])
        add(16, z, level[:, 2] > 1, ends[:, 0])
        return np.stack(cols, 1)


class Classifier:
    """One weight vector and threshold for each defect."""

    def __init__(self, features: Features, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.features, self.weights, self.thresholds = features, weights, thresholds

    def scores(self, places: np.ndarray) -> np.ndarray:
        return self.weights[:, places].sum(2).T if len(places) else np.zeros((0, len(DEFECTS)))

    def defects(self, places: np.ndarray) -> np.ndarray:
        """Number of the first defect of each row, -1 for none."""
        over = self.scores(places) >= self.thresholds
        return np.where(over.any(1), over.argmax(1), -1)


def _threshold(sound: np.ndarray, bad: np.ndarray) -> float:
    """Least score at which the precision holds when defects are as rare as in real data; examples counted by score."""
    if not bad.sum():
        return 1e9
    edge = (np.arange(SCORES) / SCORES * 2 - 1) * SCORE_RANGE
    hit = np.cumsum(bad[::-1])[::-1] / bad.sum() * REAL_SHARE
    miss = np.cumsum(sound[::-1])[::-1] / max(sound.sum(), 1) * (1 - REAL_SHARE)
    good = np.flatnonzero((hit > 0) & (hit / np.maximum(hit + miss, 1e-12) >= PRECISION))
    exact = max(edge[good[0]], 0.0) if len(good) else 1e9
    # Among the sound pairs some real defects are left; they must not cost the made ones.
    return min(exact, max(0.0, float(edge[np.searchsorted(np.cumsum(bad), MISSED * bad.sum(), side="right")])))


def _spoil(source: list[str], target: list[str], wrong_pool: dict[str, list[str]], langs: list[str], instruct: np.ndarray, said: list[str], rng: np.random.Generator) -> list[tuple[int, str, str]]:
    """Synthetic defects: (row, spoiled response, defect).  said: recurring responses of the block."""
    out = []
    for i, (s, t) in enumerate(zip(source, target)):
        kind = i % 8
        words = t.split() if kind in (0, 1, 2, 5) else []
        if kind in (0, 1, 2) and len(words) > 6:
            if kind == 2 and not instruct[i]:  # stops early, between sentences
                parts = re.split(r"(?<=[.!?؟])\s+", t.strip())
                if len(parts) > 1:
                    out.append((i, " ".join(parts[: rng.integers(1, len(parts))]), "truncated"))
                    continue
            at = int(len(t) * rng.uniform(0.25, 0.93))
            piece = t[:at].rstrip()
            if rng.random() < 0.6:
                piece = " ".join(words[: max(3, int(len(words) * rng.uniform(0.25, 0.93)))])
            piece = piece.rstrip(".!?؟ ")
            out.append((i, piece + ["", "", "…", "...", " [...]", ",", "-", ""][rng.integers(8)], "truncated"))
        elif kind in (3, 4) and s.strip():
            how = rng.integers(5)
            out.append((i, [s, f"{rng.integers(1, 10)}. {s}", f'"{s}"', f"{s}\n{s}", s.lower()][how], "copy"))
        elif kind == 5 and said:
            a = said[rng.integers(len(said))]
            b = [a, a.lower(), a.rstrip(".") + "!", f"{a} {said[rng.integers(len(said))]}", f"{a} ({words[rng.integers(len(words))] if words else 'X'}, {rng.integers(1000, 9999)})"][rng.integers(5)]
            out.append((i, b, "refusal"))
        elif kind == 6:
            out.append((i, ["", " ", "N/A", "null", "-", "…", "[empty]", "none", "<p></p>", '""', "—", "."][rng.integers(12)], "empty"))
        others = [x for x in wrong_pool if x != langs[i]] if instruct[i] and i % 2 else []
        if others:
            pool = wrong_pool[others[rng.integers(len(others))]]
            out.append((i, pool[rng.integers(len(pool))], "wrong_language"))
    return out


class Judge:
    """What a worker needs to turn pairs into features: the feature maker and the language reader."""

    def __init__(self, features: Features, table: np.ndarray) -> None:
        self.features, self.reader = features, lab.Reader(table)
        self.names = {int(h): LANGUAGES.index(k) for k, v in LANGUAGE_NAMES.items() for h in _hash(v).tolist()}
        self.name_hashes = np.array(sorted(self.names), np.int64)

    def languages(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Main language and the set of languages (bits) of each text."""
        got = self.reader.languages(texts)
        bits = np.zeros(len(texts), np.int64)
        np.bitwise_or.at(bits, got["row"], 1 << got["lang"])
        return got["main"], bits

    def wanted(self, source: pa.Array, s: Block, kinds: np.ndarray) -> np.ndarray:
        """The language that each prompt asks for, or else is in; -1 where that isn't asked."""
        want, at = np.full(len(kinds), -1), np.flatnonzero(kinds == 1)
        if len(at):
            want[at] = self.languages(source.take(pa.array(at)))[0]
            hit = np.flatnonzero(np.isin(s.words, self.name_hashes) & (s.first[s.row + 1] - np.arange(len(s.words)) <= REQUEST_WORDS)) if len(s.words) else np.zeros(0, np.int64)
            asked = dict(zip(s.row[hit].tolist(), (self.names[int(h)] for h in s.words[hit].tolist())))
            for i in at.tolist():
                want[i] = asked.get(i, want[i])
        return want

    def wrong(self, want: np.ndarray, target: pa.Array, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a response is wholly in a language other than the wanted one, and its main language; -1 where that isn't asked."""
        out, said_in, at = np.full(len(kinds), -1), np.full(len(kinds), -1), np.flatnonzero(kinds == 1)
        if len(at):
            main, bits = self.languages(target.take(pa.array(at)))
            judged = (main >= 0) & (want[at] >= 0)
            out[at] = np.where(judged, (bits >> np.maximum(want[at], 0)) & 1 == 0, -1)
            said_in[at] = main
        return out, said_in

    def places(self, source: pa.Array, target: pa.Array, ratio_keys: list[str], kinds: np.ndarray) -> np.ndarray:
        """Active places of each pair."""
        s = Block(source)
        return self.answered(s, self.wanted(source, s, kinds), target, ratio_keys, kinds)[0]

    def answered(self, s: Block, want: np.ndarray, target: pa.Array, ratio_keys: list[str], kinds: np.ndarray, halves: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Active places of each pair, and the main language of each response that a language is asked of."""
        wrong, main = self.wrong(want, target, kinds)
        out = self.features.rows(s, Block(target), target, ratio_keys, kinds, wrong, halves)
        self.width = out.shape[1]
        return out, main


def _prepared(records: DataFrame, id_col: str, source_col: str, target_col: str, src_lang: str, tgt_lang: str, instruct_col: str) -> DataFrame:
    pair = F.concat_ws("-", F.coalesce(primary(F.col(src_lang)), F.lit("")), F.coalesce(primary(F.col(tgt_lang)), F.lit("")))
    kind = F.coalesce(F.col(instruct_col).cast("int"), F.lit(0))
    return records.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(target_col).cast("string").alias("target"), pair.alias("pair"), kind.alias("kind"))


def keyed(pairs: DataFrame) -> DataFrame:
    """All pairs with k, a hash of the response's words, s, one of the prompt, and n, the prompt's length; null for responses of fewer than SAID_WORDS words."""
    rows = pairs.withColumn("w", _said(F.col("target")))
    rows = rows.withColumn("k", F.when(F.col("w").like("% " * (SAID_WORDS - 1) + "%"), F.xxhash64("w"))).drop("w")
    asked = F.col("k").isNotNull()
    return rows.withColumn("s", F.when(asked, F.xxhash64("source"))).withColumn("n", F.when(asked, F.length("source")))


def recurring(pairs: DataFrame) -> DataFrame:
    """(k, n): responses of at least SAID_WORDS words that are given to prompts of different kinds, by a hash of their words, with the number of prompts."""
    rows = (pairs if "k" in pairs.columns else keyed(pairs)).filter("k is not null and n > 0").select("k", "s", "n")
    prompts = rows.groupBy("k", "s").agg(F.min("n").alias("n")).groupBy("k").agg(F.count("*").alias("prompts"), F.min("n").alias("least"), F.max("n").alias("most"))
    return prompts.filter((F.col("prompts") >= RECUR) & (F.col("most") >= SPREAD * F.col("least"))).select("k", F.col("prompts").alias("n"))


def _said(text: Column) -> Column:
    """The letters of a response in lower case, words joined by blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def marked(pairs: DataFrame) -> DataFrame:
    """All of the ``keyed`` pairs with said, the hash of a recurring response (null for others), the weight in training, and whether the pair is held out.

    A pair without a response weighs nothing.  The pairs of one recurring response
    weigh together as much as one in ``SAID_SHARE`` of all pairs, but none more than
    ``SAID_WEIGHT`` others.
    """
    known = cut(recurring(pairs), "p5-recurring")
    most = float(max(SAID_ROWS, pairs.select("id").count() // SAID_SHARE))
    known = F.broadcast(known) if small_enough(known, BROADCAST_SAID) else known
    rows = pairs.drop("s", "n").join(known, "k", "left")
    present = F.coalesce(F.length(F.trim("target")) > 0, F.lit(False))
    weight = F.when(~present, 0.0).when(F.col("n").isNotNull(), F.least(F.lit(most) / F.col("n"), F.lit(SAID_WEIGHT))).otherwise(1.0)
    held = F.coalesce(portable_hash(F.col("id"), "defects") < HELD * 2.0**32, F.lit(False))
    return rows.select("id", "source", "target", "pair", "kind", F.when(F.col("n").isNotNull(), F.col("k")).alias("said"), weight.cast("double").alias("weight"), held.alias("held"))


class _Batch:
    """One batch of marked pairs."""

    def __init__(self, b: pa.RecordBatch) -> None:
        self.ids = b.column(0)
        self.source, self.target = b.column(1).cast(pa.large_string()), b.column(2).cast(pa.large_string())
        self.keys, self.kinds = b.column(3).to_pylist(), b.column(4).to_numpy().astype(np.int64)
        self.said = b.column(5).is_valid().to_numpy(zero_copy_only=False)
        self.half = np.where(self.said, b.column(5).fill_null(0).to_numpy() & 1, -1)
        self.weight, self.held = b.column(6).to_numpy(), b.column(7)

    def parts(self):
        for lo, hi in _ranges(self.source, self.target):
            out = object.__new__(_Batch)
            for k, v in vars(self).items():
                setattr(out, k, v[lo:hi])
            yield out


_MARKED = ["id", "source", "target", "pair", "kind", "said", "weight", "held"]


class _Tail:
    """The last words of texts in the form that ``Features.tail_hashes`` takes."""

    def __init__(self, words: pa.Array) -> None:
        offs = words.offsets.to_numpy().astype(np.int64)
        self.words = words.values.to_numpy()[offs[0] : offs[-1]]
        self.first = offs - offs[0]
        self.size = np.diff(self.first)
        self.number = self.words == 1


def _statistics(rows: DataFrame) -> Features:
    """Frequent words, the words of refusals, usual ratios by language pair and usual endings, counted over all *rows*."""
    features = Features()

    rows = rows.withColumn("held", F.lit(False)).select(*_MARKED)

    def said(batches):
        """Weights of words (kind 0) and word pairs (1) of recurring responses, in each half of them, and of all of them (3)."""
        for b in batches:
            for p in _Batch(b).parts():
                t = Block(p.target)
                inner = t.row[:-1] == t.row[1:]
                for kind, h, row in ((0, t.words.view(np.uint64), t.row), (1, _pair_hash(t.words[:-1], t.words[1:])[inner], t.row[:-1][inner]), (3, np.zeros(len(p.ids), np.uint64), np.arange(len(p.ids)))):
                    keys, back = np.unique(h, return_inverse=True)
                    a, b = (np.bincount(back, (p.weight * (p.half == k))[row], len(keys)) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(a), pa.array(b)], ["kind", "h", "a", "b"])

    weighed = cut(rows.filter("said is not null").mapInArrow(said, "kind int, h long, a double, b double").groupBy("kind", "h").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "p5-said")
    # Word pairs of other responses matter only if a recurring one has them too.
    asked = rows.sparkSession.sparkContext.broadcast(key_bitmap(weighed.filter("kind = 1"), "h"))

    def counts(batches):
        """Counts of words (kind 0) and word pairs (1) of sound pairs, the last words and the length ratio of each (2)."""
        gathered, size = ([], []), 0

        def tallied():
            for kind, parts in enumerate(gathered):
                keys, n = tb.distinct(np.concatenate(parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                none = pa.nulls(len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n.astype(float)), none.cast(pa.string()), none.cast(pa.float64()), none.cast(pa.list_(pa.int64()))], _COUNTED)
                parts.clear()

        for b in batches:
            for p in _Batch(b).parts():
                t, words = Block(p.target), _sizes(p.source)
                sound = ~p.said & (p.weight > 0)
                pairs = _pair_hash(t.words[:-1], t.words[1:]).view(np.int64)
                pairs = pairs[in_bitmap(asked.value, pairs) & (t.row[:-1] == t.row[1:]) & sound[t.row[:-1]]]
                gathered[0].append(t.words[sound[t.row]])
                gathered[1].append(pairs)
                size += len(t.words)
                if size > GATHERED:
                    yield from tallied()
                    size = 0
                at = np.flatnonzero(sound)
                shown = np.where(t.number, 1, t.words)
                kept = np.minimum(t.size[at], 4)
                offs = np.concatenate([[0], np.cumsum(kept)])
                last = shown[np.repeat(t.first[1:][at] - offs[1:], kept) + np.arange(offs[-1])]
                none = pa.nulls(len(at))
                ratio = np.log(np.maximum(t.size, 1) / np.maximum(words, 1))[at]
                pair = pa.array([p.keys[i] if p.kinds[i] == 0 else None for i in at.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 2, np.int32)), none.cast(pa.int64()), none.cast(pa.float64()), pair, pa.array(ratio), tb.list_array(last, offs, pa.int64())], _COUNTED)
        yield from tallied()

    counted = cut(rows.mapInArrow(counts, "kind int, h long, sound double, pair string, ratio double, last array<long>"), "p5-counts")
    ended = counted.filter("kind = 2")
    n = max(ended.count(), 1)
    per_said = weighed.filter("kind = 3").agg(F.sum(F.col("a") + F.col("b"))).first()[0] or 1.0
    often = max(20, n // 600)
    speaks = " or ".join(f"({x} > 0 and {x} / {per_said} >= {SPEAKS} * sound / {n})" for x in ("(a + b)", "a", "b"))
    zero = F.lit(0.0)
    both = counted.filter("kind < 2").select("kind", "h", "sound", zero.alias("a"), zero.alias("b")).unionByName(weighed.filter("kind < 2").select("kind", "h", zero.alias("sound"), "a", "b"))
    sums = both.groupBy("kind", "h").agg(*[F.sum(c).alias(c) for c in ("sound", "a", "b")])
    with freeing(rows.sparkSession):
        got = sums.filter(f"(kind = 0 and sound >= {often}) or {speaks}").toArrow()  # frequent words, and those that speak for a refusal
    kind, h, sound, a, b = (got.column(c).to_numpy() for c in got.column_names)
    features.frequent = np.sort(h[(kind == 0) & (sound >= often)])
    for name, x in (("all", a + b), (0, b), (1, a)):  # a half is shown by the words of the other
        speak = (x / per_said >= SPEAKS * sound / n) & (x > 0)
        features.refusal[name] = (np.sort(h[(kind == 0) & speak]), np.sort(h[(kind == 1) & speak].view(np.uint64)))
    medians = ended.filter("pair is not null").groupBy("pair").agg(F.percentile_approx("ratio", 0.5, 1000).alias("m"), F.count("*").alias("n")).filter("n >= 20").collect()  # one a language pair
    features.ratio = {r.pair: r.m for r in medians}
    features.levels = np.maximum(np.array(LEVELS) * n, [2, 4, 11, 51])
    shared = rows.sparkSession.sparkContext.broadcast(features)

    def tails(batches):
        for b in batches:
            t = _Tail(b.column(0))
            keys, n = np.unique(shared.value.tail_hashes(shared.value.shapes(t), t)[:, 1:], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["t", "n"])

    seen = ended.select("last").mapInArrow(tails, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).filter(F.col("n") >= float(features.levels[0]))
    with freeing(rows.sparkSession):
        seen = seen.toArrow()  # at most three for each 1 / LEVELS[0] pairs
    t = seen.column("t").to_numpy().view(np.uint64)
    order = np.argsort(t)
    features.tails = (t[order], seen.column("n").to_numpy()[order])
    forget(counted, weighed)
    return features


_COUNTED = ["kind", "h", "sound", "pair", "ratio", "last"]
_EXAMPLES = "id long, label int, weight double, held boolean, places binary, made binary, more binary"


def _binary(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Rows of *values*, from offs[i] to offs[i + 1], as bytes."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind) -> np.ndarray:
    """All bytes of a binary column as one flat array."""
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(kind) if offs[-1] > offs[0] else np.zeros(0, kind)


def _examples(rows: DataFrame, features: Features, table: np.ndarray, shards: int) -> DataFrame:
    """Of every pair its active places, and label and places of the defective ones made of it; written.

    label: -1 for a pair taken as sound, the refusal's for a recurring response,
    -2 for one that isn't trained on as it is.
    """
    shared = rows.sparkSession.sparkContext.broadcast((features, table))

    def run(batches):
        features, table = shared.value
        judge = Judge(features, table)
        refusal = DEFECTS.index("refusal")
        for b in batches:
            for p in _Batch(b).parts():
                n = len(p.ids)
                rng = np.random.default_rng(abs(p.ids[0].as_py() or 0) if n else 0)
                s = Block(p.source)
                want = judge.wanted(p.source, s, p.kinds)
                own, main = judge.answered(s, want, p.target, p.keys, p.kinds)
                label = np.where(p.weight > 0, np.where(p.said, refusal, -1), -2)
                # Half of the recurring responses is shown by the words of the others.
                shown = np.flatnonzero((label == refusal) & (rng.random(n) < 1 / 2))
                label[shown] = -2
                made = [(shown, np.full(len(shown), refusal), _placed(judge, p, s, want, shown, p.target.take(pa.array(shown)), p.half[shown]))]
                sound = np.flatnonzero(label == -1)
                texts_s, texts_t = p.source.to_pylist(), p.target.to_pylist()
                langs = [LANGUAGES[k] if k >= 0 else "" for k in main.tolist()]
                pool: dict[str, list[str]] = {}
                for i in sound.tolist():
                    if p.kinds[i] == 1 and langs[i]:
                        pool.setdefault(langs[i], []).append(texts_t[i])
                said = [texts_t[i] for i in np.flatnonzero(p.said & (p.weight > 0))]
                spoiled = _spoil([texts_s[i] or "" for i in sound], [texts_t[i] for i in sound], pool, [langs[i] for i in sound], p.kinds[sound], said, rng)
                at = sound[np.array([i for i, _, _ in spoiled], np.int64)]
                targets = pa.array([x for _, x, _ in spoiled], pa.large_string())
                made.append((at, np.array([DEFECTS.index(d) for _, _, d in spoiled], np.int64), _placed(judge, p, s, want, at, targets)))
                at, labels, places = (np.concatenate(x) for x in zip(*made))
                order = np.argsort(at, kind="stable")
                offs = np.searchsorted(at[order], np.arange(n + 1))
                one = np.arange(n + 1)
                cols = [p.ids, pa.array(label.astype(np.int32)), pa.array(p.weight), p.held, _binary(own.astype(np.uint16), one), _binary(labels[order].astype(np.uint8), offs), _binary(places[order].astype(np.uint16), offs)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "label", "weight", "held", "places", "made", "more"])

    return cut(rows.select(*_MARKED).mapInArrow(run, _EXAMPLES).repartition(shards, "id"), "p5-examples")


def _placed(judge: Judge, p: _Batch, s: Block, want: np.ndarray, at: np.ndarray, target: pa.Array, halves: np.ndarray | None = None) -> np.ndarray:
    """Places of the pairs *at* with the responses *target*.  s, want: words and wanted languages of all prompts."""
    out = []
    for lo, hi in _ranges(p.source.take(pa.array(at)), target):
        rows = at[lo:hi]
        out.append(judge.answered(s.take(rows), want[rows], target.slice(lo, hi - lo), [p.keys[i] for i in rows], p.kinds[rows], None if halves is None else halves[lo:hi])[0])
    return np.concatenate(out) if out else np.zeros((0, judge.width), np.int64)


def _learnt(b: pa.RecordBatch, held: bool, first: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, label or -1, weight) of the examples of a batch that are held out or not.

    first: the weights of the first round; pairs that they find defective, and what was made of them, are left out.
    """
    label, weight, is_held = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
    own = _unpacked(b.column(4), np.uint16).reshape(b.num_rows, -1).astype(np.int64)
    made = _unpacked(b.column(5), np.uint8).astype(np.int64)
    more = _unpacked(b.column(6), np.uint16).reshape(len(made), own.shape[1] if b.num_rows else 0).astype(np.int64)
    row = np.repeat(np.arange(b.num_rows), np.diff(np.frombuffer(b.column(5).buffers()[1], np.int32)[b.column(5).offset :][: b.num_rows + 1]))
    use = is_held == held
    if first is not None:
        use = use & ~((label == -1) & (first[own].sum(1) >= 0).any(1))
    a, c = np.flatnonzero(use & (label > -2)), use[row]
    return np.concatenate([own[a], more[c]]), np.concatenate([label[a], made[c]]), np.concatenate([weight[a], weight[row[c]]])


def _descend(w: np.ndarray, g2: np.ndarray, places: np.ndarray, label: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    """One pass of logistic regressions by AdaGrad, all defects at once; changes w and g2."""
    order, slot = rng.permutation(len(places)), np.zeros(PLACES, np.int64)
    for lo in range(0, len(order), BATCH):
        b = order[lo : lo + BATCH]
        p = places[b]
        err = 1 / (1 + np.exp(-np.clip(w[p].sum(1), -30, 30))) - (label[b][:, None] == np.arange(len(DEFECTS)))
        err *= weight[b][:, None]
        flat = p.ravel()
        at = np.flatnonzero(np.bincount(flat, minlength=PLACES))
        slot[at] = np.arange(len(at))
        back = slot[flat]
        grad = np.stack([np.bincount(back, np.repeat(e, p.shape[1]), len(at)) for e in err.T], 1)
        grad = grad / len(b) + 1e-6 * w[at]
        g2[at] += grad**2
        w[at] -= RATE * grad / np.sqrt(g2[at])


def _trained(examples: DataFrame, passes: int, repeat: int, first: np.ndarray | None) -> np.ndarray:
    """Weights of the logistic regressions on all examples that aren't held out.

    Each task goes through its examples from the weights reached so far, *repeat*
    times; then the changes are averaged, for each place by how often it was
    active, *passes* times.
    """
    spark, d = examples.sparkSession, len(DEFECTS)
    w, g2 = np.zeros((PLACES, d)), np.full((PLACES, d), 1e-2)
    names = [f"{x}{k}" for x in "wg" for k in range(d)]
    for turn in range(passes):
        shared = spark.sparkContext.broadcast((w, g2, first))

        def run(batches, turn=turn, shared=shared):
            w0, g0, first = shared.value
            w, g2, n, rng = w0.copy(), g0.copy(), np.zeros(PLACES, np.int64), np.random.default_rng(5 + turn)
            parts = (_learnt(b, False, first) for b in batches if b.num_rows)
            if repeat > 1:  # few in all
                parts = list(parts)
                parts = [tuple(np.concatenate(x) for x in zip(*parts))] * repeat if parts else []
            for places, label, weight in parts:
                _descend(w, g2, places, label, weight, rng)
                n += np.bincount(places.ravel(), minlength=PLACES)
            at = np.flatnonzero(n)
            cols = [(x[at] * n[at][:, None]).astype(np.float32).T for x in (w - w0, g2 - g0)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), *(pa.array(c) for x in cols for c in x)], ["at", "n", *names])

        changes = examples.mapInArrow(run, "at int, n long, " + ", ".join(f"{x} float" for x in names))
        with freeing(spark):
            got = changes.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).toArrow()  # one a place
        at, n = got.column("at").to_numpy(), got.column("n").to_numpy()
        # Rounded: sums may come in any order.
        change = np.round(np.stack([got.column(x).to_numpy() / n for x in names], 1) if len(at) else np.zeros((0, 2 * d)), 9)
        w, g2 = w.copy(), g2.copy()
        w[at] += change[:, :d]
        g2[at] += np.maximum(change[:, d:], 0)
    return w


def _thresholds(examples: DataFrame, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The threshold of each defect, from all held-out examples: counts of them by score."""
    shared = examples.sparkSession.sparkContext.broadcast((weights, first))

    def run(batches):
        w, first = shared.value
        out = np.zeros((2, len(DEFECTS), SCORES), np.int64)
        for b in batches:
            if b.num_rows:
                places, label, _ = _learnt(b, True, first)
                at = np.clip(np.floor((w[places].sum(1) / SCORE_RANGE + 1) / 2 * SCORES), 0, SCORES - 1).astype(np.int64)
                for k in range(len(DEFECTS)):  # a row with another defect says nothing
                    for y, of in ((0, label == -1), (1, label == k)):
                        out[y, k] += np.bincount(at[of, k], minlength=SCORES)
        flat = out.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "n"])

    got = examples.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * len(DEFECTS) * SCORES, np.int64)
    counts[got.column("at").to_numpy()] = got.column("n").to_numpy()
    sound, bad = counts.reshape(2, len(DEFECTS), SCORES)
    return np.array([_threshold(sound[k], bad[k]) for k in range(len(DEFECTS))])


def fitted(pairs: DataFrame, table: np.ndarray) -> tuple[Classifier, DataFrame]:
    """The classifier trained on all *pairs* (id, source, target, pair, kind), and the written examples, which have the places of every pair."""
    pairs = cut(keyed(pairs), "p5-pairs")  # responses are read letter by letter once
    rows = marked(pairs)
    features = _statistics(rows)
    n = pairs.count()
    examples = _examples(rows, features, table, max(TASKS, n // SHARD_ROWS))
    forget(pairs)
    repeat = int(np.clip(FEW // max(n, 1), 1, EPOCHS))
    # Real defects among the pairs taken for sound: out, at even odds.
    first = _trained(examples, 1, repeat, None)
    weights = _trained(examples, PASSES, repeat, first)
    return Classifier(features, weights.T.copy(), _thresholds(examples, weights, first)), examples


def fit(pairs: DataFrame, table: np.ndarray) -> Classifier:
    """Train on all *pairs* (id, source, target, pair, kind)."""
    model, examples = fitted(pairs, table)
    forget(examples)
    return model


def _ranges(source: pa.Array, target: pa.Array):
    """Row ranges of bounded length by the longer column."""
    import pyarrow.compute as pc

    longer = pc.if_else(pc.greater(pc.fill_null(pc.binary_length(source), 0), pc.fill_null(pc.binary_length(target), 0)), source, target)
    yield from tb.slices(longer)


def classified(pairs: DataFrame, model: Classifier, table: np.ndarray) -> DataFrame:
    """(id, defect) of every defective one of *pairs*."""
    shared = pairs.sparkSession.sparkContext.broadcast((model, table))

    def run(batches):
        model, table = shared.value
        judge = Judge(model.features, table)
        names = pa.array(DEFECTS)
        for b in batches:
            source, target = b.column(1).cast(pa.large_string()), b.column(2).cast(pa.large_string())
            keys, kinds = b.column(3).to_pylist(), b.column(4).to_numpy()
            for lo, hi in _ranges(source, target):
                got = model.defects(judge.places(source.slice(lo, hi - lo), target.slice(lo, hi - lo), keys[lo:hi], kinds[lo:hi]))
                at = np.flatnonzero(got >= 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(at)), names.take(pa.array(got[at]))], ["id", "defect"])

    return pairs.mapInArrow(run, "id long, defect string").dropDuplicates(["id"])


def judged(records: DataFrame, id_col: str, source_col: str, target_col: str, src_lang: str, tgt_lang: str, instruct_col: str, table: np.ndarray) -> DataFrame:
    """(id, defect) of every defective pair.  table: the language filter (``labels.fit``)."""
    pairs = _prepared(records, id_col, source_col, target_col, src_lang, tgt_lang, instruct_col)
    model, examples = fitted(pairs, table)
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = pa.array(DEFECTS)
        for b in batches:
            got = shared.value.defects(_unpacked(b.column(1), np.uint16).reshape(b.num_rows, -1).astype(np.int64)) if b.num_rows else np.zeros(0, np.int64)
            at = np.flatnonzero(got >= 0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), names.take(pa.array(got[at]))], ["id", "defect"])

    return examples.select("id", "places").mapInArrow(run, "id long, defect string").dropDuplicates(["id"])
