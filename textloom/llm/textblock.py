"""Many texts as one array of code points.

Python string work costs microseconds per word; the operators of this package
work on whole Arrow batches instead.  A batch's texts are laid end to end as
``uint32`` code points and every step (folding, word splitting, hashing) is a
few numpy passes over that array.

*Folding* makes texts comparable "as written": compatibility decomposition,
case folding, marks and joiners removed, native and full-width digits as ASCII
digits, look-alike Arabic letters merged, simple tags and all other characters
turned into word breaks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..hashing import mix

SPACE, DROP, MULTI = 32, 0, 1
#: Most code points worked on at once; bounds the memory of the numpy passes.
SLICE_CHARS = 1_500_000

# Arabic-script letters written in two ways.
LOOKALIKE = {"ي": "ی", "ى": "ی", "ك": "ک"}

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>")
_MULTIPLE: dict[int, str] = {}


def fold_char(ch: str) -> str:
    """The folded form of one character: '' if dropped, ' ' if it breaks words."""
    out = []
    for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).casefold()):
        kind = unicodedata.category(c)
        if kind[0] == "M" or kind == "Cf" or c == "ـ":
            continue
        if kind == "Nd":
            c = str(unicodedata.decimal(c))
        elif kind[0] not in "LN":
            c = " "
        out.append(LOOKALIKE.get(c, c))
    return "".join(out)


def _entry(cp: int) -> int:
    s = fold_char(chr(cp))
    if len(s) > 1:
        s = s.strip() if len(s.strip()) == 1 else s
    if len(s) > 1:
        _MULTIPLE[cp] = s
        return MULTI
    return ord(s) if s else DROP


_table: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Folded code point by code point, for the basic plane; made once per worker."""
    global _table
    if _table is None:
        t = np.full(0x10000, SPACE, np.uint32)
        for cp in range(0x10000):
            if not 0xD800 <= cp < 0xE000 and not 0xAC00 <= cp < 0xD7A4:
                t[cp] = _entry(cp)
        t[0xAC00:0xD7A4] = np.arange(0xAC00, 0xD7A4)
        _table = t
    return _table


def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the start of each (one more entry than texts); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    bufs = texts.buffers()
    offs = np.frombuffer(bufs[1], np.int64, n + 1, texts.offset * 8)
    lo, hi = int(offs[0]), int(offs[-1])
    raw = bufs[2].slice(lo, hi - lo).to_pybytes() if hi > lo else b""
    data = np.frombuffer(raw, np.uint8)
    try:
        codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeError:  # not valid UTF-8: text by text, bad bytes become U+FFFD
        parts = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offs - lo, offs[1:] - lo)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    offs = offs - lo
    return codes, offs - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), offs)  # bytes that begin no character


def strip_tags(texts: pa.Array) -> pa.Array:
    """Simple markup tags replaced by blanks; untouched unless a '<' occurs."""
    if not pc.any(pc.match_substring(texts, "<")).as_py():
        return texts
    return pc.replace_substring_regex(texts.cast(pa.large_string()), pattern=_TAG.pattern, replacement=" ")


def fold(codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, with word breaks as SPACE, and the texts' new starts."""
    table = fold_table()
    low = codes < 0x10000
    if low.all():
        out = table[codes]
    else:
        out = np.full(len(codes), SPACE, np.uint32)
        out[low] = table[codes[low]]
        high = np.flatnonzero(~low)
        values, back = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([_entry(int(v)) for v in values], np.uint32)[back]
    multi = np.flatnonzero(out == MULTI)
    if len(multi):
        size = np.ones(len(out), np.int64)
        forms = [_MULTIPLE[int(codes[i])] for i in multi]
        size[multi] = [len(f) for f in forms]
        at = np.concatenate([[0], np.cumsum(size)])
        wide = np.repeat(out, size)
        for i, f in zip(multi, forms):
            wide[at[i] : at[i] + len(f)] = [ord(c) for c in f]
        out, offs = wide, at[offs]
    dropped = out == DROP
    if dropped.any():
        out, offs = out[~dropped], offs - np.searchsorted(np.flatnonzero(dropped), offs)
    return out, offs


def words(folded: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word."""
    n = len(folded)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    is_word = folded != SPACE
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    prev = np.concatenate([[False], is_word[:-1]])
    starts = np.flatnonzero(is_word & (~prev | cut[:-1]))
    follows = np.concatenate([is_word[1:], [False]])
    ends = np.flatnonzero(is_word & (~follows | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, ascending, and how often each occurs: ``np.unique`` by sorting, far faster than by its table."""
    s = np.sort(values)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    return s[at], np.diff(at, append=len(s))


_rng = np.random.default_rng(20240611)
_POS = (_rng.integers(1, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash (int64) of every word, the same on every machine."""
    if len(starts) == 0:
        return np.zeros(0, np.int64)
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    kind = np.int32 if max(at[-1], len(folded)) < 2**31 else np.int64
    pos = np.arange(at[-1], dtype=kind)
    pos -= np.repeat(at[:-1].astype(kind), size)
    chars = folded[np.repeat(starts.astype(kind), size) + pos].astype(np.uint64)
    chars += np.uint64(1)
    chars *= np.uint64(0x9E3779B97F4A7C15)
    chars ^= chars >> np.uint64(29)
    pos &= 63
    chars *= _POS[pos]
    h = np.add.reduceat(chars, at[:-1])
    return mix(h + size.astype(np.uint64)).view(np.int64)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE_CHARS bytes each (a longer text is a range of its own)."""
    n = len(texts)
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // SLICE_CHARS
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [n]])
    yield from zip(edges[:-1].tolist(), edges[1:].tolist())


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words of all texts in order, and the index of each text's first word."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    parts, firsts, base = [], [np.zeros(1, np.int64)], 0
    for a, b in slices(texts):
        codes, offs = codes_of(strip_tags(texts.slice(a, b - a)))
        f, offs = fold(codes, offs)
        s, e, first = words(f, offs)
        parts.append(word_hashes(f, s, e))
        firsts.append(first[1:] + base)
        base += len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.concatenate(firsts)


def folded_words(text: str | None) -> list[str]:
    """The folded words of one text, by the same rules; the slow twin used in tests and reports."""
    s = "".join(fold_char(c) for c in _TAG.sub(" ", text or ""))
    return s.split(" ") if s and " " not in s else [w for w in s.split(" ") if w]


def list_array(values: np.ndarray, offs: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and starts."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values, kind))
