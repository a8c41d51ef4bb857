"""Text that was decoded with the wrong character encoding.

For every pair of encodings the garbled form of each expected character is
computed once (``patterns``): UTF-8 read as a single-byte encoding (once or
twice) gives sequences that correct text does not hold; one single-byte
encoding read as another gives single characters that correct text may hold.

An Aho-Corasick automaton over all of them gives the matched spans of every
blank-delimited piece of text, and only matched spans are replaced.  Looked at
are texts with a character outside the plain alphabets and texts with a word that
another encoding of its script (koi8-r and cp1251 read as each other) makes far
more frequent.  Sequences decide by themselves; a span of single characters says
which pairs can have made it, and that pair is taken whose restored words are far
more frequent in the corpus than the piece as it stands (``token_counts``, over
all texts), so that correct accents, capitals and typographic marks stay.  Pieces
with replacement characters, or question marks inside words, have lost
characters: they are reported, not restored.

Defined results: null and empty texts are not garbled and stay what they are.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textblock as tb
from .pairs import row_sums

# Encodings that text is wrongly read as, and single-byte ones that it is written in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1256", "mac_roman", "cp437", "cp850", "cp866", "koi8-r")
WRITTEN_IN = ("cp1251", "cp1256", "cp1252", "koi8-r", "cp866", "mac_roman", "iso8859-5", "iso8859-6")
TWICE = ("cp1252", "latin-1")
#: Buckets of each of the two rows of token counts; a token's count is the lesser of its two.
BUCKETS = 1 << 20
#: How many times as frequent as the garbled form a restored one must be.
MORE = 20

ALPHABET = [
    chr(c)
    for a, b in ((0xA1, 0xAD), (0xAE, 0x180), (0x400, 0x460), (0x490, 0x492), (0x600, 0x700), (0x200C, 0x2010), (0x2013, 0x203B))
    for c in range(a, b)
] + ["\xa0", "€", "™", "−", "№", "﻿"]

#: Characters of plain texts: a piece with only these and ASCII is not looked at.
_PLAIN = "\\u0300-\\u036f\\u0401\\u0410-\\u044f\\u0451\\u0600-\\u06ff\\u200c-\\u200f\\uff10-\\uff19“”„‘’«»–—…"
# Question marks for lost letters; a capital after a small letter and a mark is the next sentence.
_MISSING = r"[^\W\d_A-Z]\?+[^\W\d_A-Z]|[A-Z]\?+[^\W\d_]|\?\?\?|(?:^|[\s(])\?+[^\W\d_]"
_ODD = re.compile(f"[^\\x00-\\x7f{_PLAIN}]|[A-Za-z][\\u0370-\\u06ff]|[\\u0370-\\u06ff][A-Za-z]|{_MISSING}")
_LOST = re.compile(f"�|{_MISSING}")
_PIECE = re.compile(r"[^ \t\r\n]+")
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s\x00-\x7f]")
_WORD = re.compile(r"[^\W\d_]+")
# Marks that wrong decoding turns into letters, and what may follow an apostrophe.
_MARKS = frozenset("“”„‘’«»–—…€ \xa0،؛؟")
_SHORT = frozenset(("s", "t", "d", "m", "ll", "re", "ve"))
_INSIDE = re.compile(r"[^\W\d_][“”„‘’«»–—…€][^\W\d_]")
_CONTRACTED = re.compile(r"[A-Za-z]{2}’(?:s|t|d|m|ll|re|ve)\b")
_ACCENTS = re.compile(r"[À-ÿ]{3}|^[À-ÿ]{2,}$")
_FOREIGN = re.compile(r"[Ѐ-ۿ]{3}")
_FOREIGN_ANY = re.compile(r"[Ѐ-ۿ]")
_ODD_RUN = re.compile(r"[^\x00-\x7f]{3}")
_KINDS: np.ndarray | None = None
BREAK, LETTER, SYMBOL = 0, 1, 2


def _read(data: bytes, encoding: str) -> str:
    """Decode as lenient readers do: bytes that the encoding lacks become control characters."""
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in data)


@functools.cache
def patterns() -> tuple[dict[str, tuple[str, int]], dict[tuple[str, str], dict[int, str]]]:
    """Garbled sequence -> (character, strength), and for each single-byte pair garbled character -> character.

    Strength 2: no correct text holds the sequence; 1: letters and plain marks
    that may stand together by chance, which count only beside stronger ones.
    """
    plain = re.compile(f"[\\x00-\\x7f{_PLAIN}À-ÖØ-öø-ÿ]")
    many: dict[str, tuple[str, int]] = {}
    for ch in ALPHABET:
        data = ch.encode("utf-8")
        for enc in READ_AS:
            bad = _read(data, enc)
            strength = 2 if any(not plain.match(c) for c in bad) or (bad[0] in "ÃÂâØÙÚÛÐÑ" and not bad[1].isalpha()) else 1
            if enc in TWICE:
                twice = _read(bad.encode("utf-8"), enc)
                many.setdefault(twice, (ch, 2))
            if bad not in many or strength > many[bad][1]:
                many.setdefault(bad, (ch, strength))
    for c in ALPHABET:
        many.pop(c, None)
    single: dict[tuple[str, str], dict[int, str]] = {}
    for true in WRITTEN_IN:
        for wrong in READ_AS:
            table = {}
            for ch in ALPHABET:
                try:
                    bad = _read(ch.encode(true), wrong)
                except UnicodeEncodeError:
                    continue
                if bad != ch and len(bad) == 1 and ord(bad) > 127:
                    table[ord(bad)] = ch
            if true != wrong and len(table) > 20 and table not in single.values():
                single[true, wrong] = table
    return many, single


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For the basic plane: lower-case code point, and whether it breaks words, is a letter or a symbol of its own."""
    global _KINDS
    if _KINDS is None:
        low, kind = np.arange(0x10000, dtype=np.uint32), np.zeros(0x10000, np.uint8)
        for cp in range(0x10000):
            if 0xD800 <= cp < 0xE000:
                continue
            ch = chr(cp)
            if ch.isalpha():
                kind[cp] = LETTER
                low[cp] = ord(ch.lower()) if len(ch.lower()) == 1 else cp
            elif cp > 127 and not ch.isspace() and not (ch.isdecimal() or ch.isnumeric()):
                kind[cp] = SYMBOL
        _KINDS = np.stack([low, kind.astype(np.uint32)])
    return _KINDS[0], _KINDS[1]


def _tokens(texts: pa.Array) -> np.ndarray:
    """Hashes of all lower-case words and single symbols of the texts."""
    codes, offs = tb.codes_of(texts)
    if not len(codes):
        return np.zeros(0, np.int64)
    low, kinds = _kinds()
    inside = np.minimum(codes, 0xFFFF)
    kind = np.where(codes < 0x10000, kinds[inside], SYMBOL)
    lower = np.where(codes < 0x10000, low[inside], codes)
    cut = np.zeros(len(codes) + 1, bool)
    cut[offs] = True
    is_letter = kind == LETTER
    prev, follows = np.concatenate([[False], is_letter[:-1]]), np.concatenate([is_letter[1:], [False]])
    starts = np.flatnonzero((is_letter & (~prev | cut[:-1])) | (kind == SYMBOL))
    ends = np.flatnonzero((is_letter & (~follows | cut[1:])) | (kind == SYMBOL)) + 1
    return tb.word_hashes(lower.astype(np.uint32), starts, ends)


def _places(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the counts of hashed tokens are, in the first and in the second row."""
    return tokens & (BUCKETS - 1), ((tokens >> 24) & (BUCKETS - 1)) + BUCKETS


def token_counts(texts: DataFrame, columns: list[str]) -> np.ndarray:
    """Occurrences per hash bucket of the words and symbols of all texts; 2 * BUCKETS rows reach the driver at most."""

    def run(batches):
        total = np.zeros(2 * BUCKETS, np.int64)
        for b in batches:
            for col in b.columns:
                for lo, hi in tb.slices(col):
                    for places in _places(_tokens(col.slice(lo, hi - lo))):
                        total += np.bincount(places, minlength=2 * BUCKETS)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["b", "n"])

    got = texts.select(*[F.col(c).cast("string") for c in columns]).mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * BUCKETS, np.int32)
    counts[got.column("b").to_numpy()] = np.minimum(got.column("n").to_numpy(), 2**31 - 1)
    return counts


#: A replacement in a text: begin, end, what stands there instead.
Edit = tuple[int, int, str]


def applied(text: str, edits: list[Edit]) -> str:
    """The text with the spans of *edits* replaced."""
    out, pos = [], 0
    for a, b, good in sorted(edits):
        out += [text[pos:a], good]
        pos = b
    return "".join(out) + text[pos:]


@functools.cache
def _automata():
    """Automaton of all patterns, automaton of the certain ones, suspicious code points and same-script pairs; once a worker.

    A sequence carries its size, character and strength; a single character
    carries, with strength 0, what it stands for under each pair.
    """
    import ahocorasick

    many, single = patterns()
    every, certain = ahocorasick.Automaton(), ahocorasick.Automaton()
    for bad, (good, strength) in many.items():
        every.add_word(bad, (len(bad), good, strength))
        if strength > 1:
            certain.add_word(bad, True)
    certain.make_automaton()
    stands_for: dict[str, dict[tuple[str, str], str]] = {}
    for pair, table in single.items():
        for cp, good in table.items():
            stands_for.setdefault(chr(cp), {})[pair] = good
    for ch, by_pair in stands_for.items():
        if not every.exists(ch):
            every.add_word(ch, (1, by_pair, 0))
    every.make_automaton()
    odd = np.array([bool(re.match(f"[^\\x00-\\x7f{_PLAIN}]", chr(c))) for c in range(0x10000)])
    # Pairs that make plain letters of others of their script, as lower-case code points by code point.
    swaps: list[np.ndarray] = []
    low, kinds = _kinds()
    for table in single.values():
        inside = {c: ord(g) for c, g in table.items() if not odd[c] and c >= 0x370 and kinds[c] == LETTER and c >> 8 == ord(g) >> 8 and kinds[ord(g)] == LETTER}
        if len(inside) > 20:
            swap = low.copy()
            swap[list(inside)] = low[list(inside.values())]
            swaps.append(swap)
    return every, certain, odd, swaps


class Repairer:
    """Decides and restores; remembers its decisions on pieces, which repeat a lot."""

    #: Pieces remembered before the memory starts afresh.
    KEEP = 200_000

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        #: A word more frequent than this cannot be MORE times rarer than any other.
        self.common = int(counts.max(initial=0)) // (MORE // 4)
        self.single = patterns()[1]
        self.automaton, self.certain, self.odd, self.swaps = _automata()
        self.known: dict[str, tuple[list[Edit], str, tuple | None, bool]] = {}

    def frequency(self, tokens: list[str]) -> np.ndarray:
        if not tokens:
            return np.zeros(0, np.int64)
        codes, offs = tb.codes_of(pa.array(tokens))
        a, b = _places(tb.word_hashes(codes, offs[:-1], offs[1:]))
        return np.minimum(self.counts[a], self.counts[b]).astype(np.int64)

    def rereadable(self, codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which texts hold a plain word that another encoding of its script makes MORE times as frequent."""
        low, kinds = _kinds()
        inside = np.minimum(codes, 0xFFFF)
        cut = np.zeros(len(codes) + 1, bool)
        cut[offs] = True
        letter = (codes < 0x10000) & (kinds[inside] == LETTER)
        starts = np.flatnonzero(letter & (~np.concatenate([[False], letter[:-1]]) | cut[:-1]))
        ends = np.flatnonzero(letter & (~np.concatenate([letter[1:], [False]]) | cut[1:])) + 1
        script = codes[starts] >= 0x370
        starts, ends = starts[script], ends[script]
        found = np.zeros(len(offs) - 1, bool)
        if not len(starts):
            return found

        def frequent(by: np.ndarray) -> np.ndarray:
            a, b = _places(tb.word_hashes(by[inside].astype(np.uint32), starts, ends))
            return np.minimum(self.counts[a], self.counts[b]).astype(np.int64)

        now = frequent(low)
        few = now <= self.common
        starts, ends, now = starts[few], ends[few], now[few]
        row = np.searchsorted(offs, starts, "right") - 1
        for swap in self.swaps if len(starts) else ():
            found[row[frequent(swap) + 1 >= MORE * (now + 1)]] = True
        return found

    def has_sequence(self, text: str) -> bool:
        """Whether the text holds a sequence that only wrong decoding makes."""
        return next(self.certain.iter(text), None) is not None

    def sequences(self, piece: str) -> tuple[list[Edit], int]:
        """The garbled sequences of a piece, longest first from the left, and the strongest match."""
        found: dict[int, tuple[int, str, int]] = {}
        for end, (size, good, strength) in self.automaton.iter(piece):
            at = end - size + 1
            if strength and (at not in found or size > found[at][0]):
                found[at] = (size, good, strength)
        edits, pos, best, weak = [], 0, 0, 0
        for at in sorted(found):
            if at >= pos:
                size, good, strength = found[at]
                edits.append((at, at + size, good))
                pos = at + size
                best, weak = max(best, strength), weak + (strength == 1)
        if best == 1:  # letters only: three in one piece, and the piece must become words that are known
            before, after = self.frequency(_TOKEN.findall(piece.lower())), self.frequency(_TOKEN.findall(applied(piece, edits).lower()))
            best = 2 if weak >= 2 and len(after) and after.min() >= MORE * (1 + before.min(initial=10**9)) else 1
        return (edits if best > 1 else []), best

    def characters(self, piece: str, pair: tuple[str, str] | None = None) -> tuple[list[Edit], tuple[str, str] | None]:
        """The spans that the single-byte pair makes which restores far more frequent words; with *pair*, by that one if plausible."""
        words = _WORD.findall(piece.lower())
        bad = [w for w in words if not w.isascii()]
        if not bad and not any(self.odd[ord(c)] for c in piece if 127 < ord(c) < 0x10000):
            return [], None
        if not words:
            return [], None
        now = int(self.frequency(bad).max()) if bad else int(self.frequency(words).min())
        if now > self.common:
            return [], None
        spans = {end: by_pair for end, (_, by_pair, strength) in self.automaton.iter(piece) if not strength}
        for i, c in enumerate(piece):  # a sequence of one character may stand for others too
            if i not in spans and ord(c) > 127 and (own := self.single_of(c)):
                spans[i] = own
        must = {i for i, c in enumerate(piece) if ord(c) > 127 and self.odd[min(ord(c), 0xFFFF)]}
        options: list[tuple[list[Edit], str, tuple[str, str], list[str], bool]] = []
        if not must <= spans.keys():
            return [], None
        able = set().union(*spans.values()) if pair is None else {pair}
        for key in [k for k in self.single if k in able]:
            if not all(key in spans[i] for i in must):
                continue
            edits = [(i, i + 1, by[key]) for i, by in spans.items() if key in by]
            if not edits:
                continue
            good = applied(piece, edits)
            parts = _WORD.findall(good.lower())
            marks = [g for _, _, g in edits if not g.isalpha()]
            if not all(c in _MARKS for c in marks) or not _plausible(good):
                continue
            if parts and sum(map(len, parts)) < sum(map(len, words)) - 2:
                continue
            if not parts and (len(words) > 1 or len(words[0]) > 1 or good.strip(".,;:!?") not in ("—", "–")):
                continue
            named = bool(_FOREIGN.search(good)) and bool(_ODD_RUN.search(piece))
            options.append((edits, good, key, parts, named))
        if not options:
            return [], None
        counts = iter(self.frequency([t for o in options for t in o[3]]).tolist())
        best, choice = 0.0, None
        for edits, good, key, parts, named in options:
            own = [next(counts) for _ in parts]
            low = min([n for n, t in zip(own, parts) if t not in _SHORT], default=MORE * (now + 1) if not parts else 0)
            if named and pair is not None and low < 2 and now < 2:
                low = 2  # a name beside words already read back
            score = (low + 1) / (now + 1)
            if score > best:
                best, choice = score, (edits, good, key)
        need = 1.5 if pair is not None else MORE / 4 if "’" in choice[1] else MORE
        return (choice[0], choice[2]) if best >= need else ([], None)

    def single_of(self, ch: str) -> dict[tuple[str, str], str]:
        """What a character stands for under each single-byte pair."""
        return {pair: table[ord(ch)] for pair, table in self.single.items() if ord(ch) in table}

    def piece(self, piece: str) -> tuple[list[Edit], str, tuple[str, str] | None, bool]:
        """(edits, restored, single-byte pair used, whether garbled)."""
        got = self.known.get(piece)
        if got is None:
            lost = bool(_LOST.search(piece)) and "://" not in piece
            edits, strength = self.sequences(piece)
            pair = None
            if strength < 2:
                edits, pair = self.characters(piece)
            if piece == "Ã":  # its second character was a blank
                edits = [(0, 1, "à")]
            good = applied(piece, edits)
            got = (edits, good, pair, lost or good != piece)
            if len(self.known) >= self.KEEP:
                self.known.clear()
            self.known[piece] = got
        return got

    def text(self, text: str) -> tuple[str, bool, bool]:
        """(restored text, whether garbled, whether characters are lost)."""
        done: list[tuple[re.Match, list[Edit], str, tuple[str, str] | None]] = []
        left: list[re.Match] = []
        votes: dict[tuple[str, str], int] = {}
        lost = strong = False
        for m in _PIECE.finditer(text):
            p = m.group()
            if p.isascii() and "?" not in p:
                continue
            edits, good, pair, bad = self.piece(p)
            if not bad:
                if not p.isascii():
                    left.append(m)
                continue
            lost |= bool(_LOST.search(p))
            strong |= pair is None and good != p
            if pair:
                votes[pair] = votes.get(pair, 0) + 1
            done.append((m, edits, good, pair))
        pair = max(votes, key=votes.get) if votes else None
        # Letters for letters of another script: one piece alone may be chance.
        if pair and votes[pair] < 2 and any(x == pair and m.group().strip("".join(_MARKS) + ".,;:()").isalpha() and _FOREIGN_ANY.search(good) for m, _, good, x in done):
            pair = None
        others = [d[0] for d in done if not (d[3] is None or d[3] == pair or not _FOREIGN_ANY.search(d[2]))]
        done = [d for d in done if d[0] not in others]
        left += others if pair else []
        garbled = lost or bool(done)
        found = [(m.start(), edits) for m, edits, _, _ in done]
        # What could not be decided alone is read back as the text around it was.
        for m in left if pair or strong else ():
            edits, used = self.characters(m.group(), pair) if pair else ([], None)
            if not used and strong:
                edits = self.wholly(m.group())
            found.append((m.start(), edits))
        return applied(text, [(at + a, at + b, good) for at, edits in found for a, b, good in edits]), garbled, lost

    def wholly(self, piece: str) -> list[Edit]:
        """Weak sequences of a piece too, if these make up all of it but ASCII."""
        found: dict[int, tuple[int, str]] = {}
        for end, (size, good, strength) in self.automaton.iter(piece):
            if strength and size > found.get(end - size + 1, (0,))[0]:
                found[end - size + 1] = (size, good)
        edits, pos = [], 0
        while pos < len(piece):
            size, good = found.get(pos, (1, piece[pos]))
            if size == 1 and not piece[pos].isascii():
                return []
            if pos in found:
                edits.append((pos, pos + size, good))
            pos += size
        return edits

    def column(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Restored texts, garbled flags and lost flags; texts without suspicious characters are not touched."""
        n = len(texts)
        garbled, lost = np.zeros(n, bool), np.zeros(n, bool)
        changed: dict[int, str] = {}
        for lo, hi in tb.slices(texts):
            part = texts.slice(lo, hi - lo)
            codes, offs = tb.codes_of(part)
            if not len(codes):
                continue
            inside = np.minimum(codes, 0xFFFF)
            sus = self.odd[inside] | (codes == 63)
            # Latin beside another script
            other = (codes >= 0x370) & (codes <= 0x6FF)
            latin = ((codes | 32) >= 97) & ((codes | 32) <= 122)
            sus[1:] |= (other[1:] & latin[:-1]) | (other[:-1] & latin[1:])
            again = self.rereadable(codes, offs)
            for i in np.flatnonzero((row_sums(sus.astype(np.int64), offs) > 0) | again):
                t = part[int(i)].as_py()
                if not again[i] and not _ODD.search(t):
                    continue
                good, garbled[lo + i], lost[lo + i] = self.text(t)
                if good != t:
                    changed[lo + int(i)] = good
        if changed:
            values = texts.to_pylist()
            for i, good in changed.items():
                values[i] = good
            texts = pa.array(values, texts.type)
        return texts, garbled, lost


def _plausible(text: str) -> bool:
    """Whether no word mixes scripts, has capitals after small letters, marks inside or accented letters only, as misread words do."""
    if _INSIDE.search(text) and not _CONTRACTED.search(text):
        return False
    for w in re.findall(r"[^\W\d_]+", text):
        kinds = {"l" if c < "ɐ" else "c" if "Ѐ" <= c < "԰" else "a" if "\u0600" <= c < "\u0700" else "x" for c in w}
        if len(kinds) > 1 or "x" in kinds or _ACCENTS.search(w):
            return False
        if any(a.islower() and b.isupper() for a, b in zip(w, w[1:])):
            return False
    return True


REPAIR_SCHEMA = "id long, side string, garbled boolean, lost boolean, restored string"


def repair(records: DataFrame, id_col: str, columns: dict[str, str]) -> DataFrame:
    """Garbled texts with what could be restored: (id, side, garbled, lost, restored).  columns: side -> text column."""
    spark = records.sparkSession
    counts = spark.sparkContext.broadcast(token_counts(records, list(columns.values())))
    sides = list(columns)

    def run(batches):
        worker = Repairer(counts.value)
        for b in batches:
            for k, side in enumerate(sides):
                texts, garbled, lost = worker.column(b.column(k + 1))
                at = pa.array(np.flatnonzero(garbled))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), pa.array([side] * len(at), pa.string()), pa.array(garbled[at.to_numpy()]), pa.array(lost[at.to_numpy()]), texts.take(at).cast(pa.string())],
                    ["id", "side", "garbled", "lost", "restored"],
                )

    return records.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("string") for c in columns.values()]).mapInArrow(run, REPAIR_SCHEMA)
