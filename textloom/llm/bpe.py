"""Encoding a corpus with a public byte-level BPE vocabulary, exactly and in linear time.

BPE is defined by merging pairs in rank order.  The same result is found without
merging: of all ways to cover a text by tokens exactly one has only *compatible*
neighbours, where two tokens are compatible if merging in rank order would leave
the border between them alone.  The encoder walks the text with the longest
vocabulary match at each place (an Aho-Corasick automaton over bytes mapped to
Latin-1), checks each new token against the one before it (memoised), and steps
back to a shorter token where that fails; a place that failed once is never
entered again, which makes it linear.

Texts are cut into chunks first, at borders that the pre-tokenizer keeps too.  A chunk's ids do not depend on
what surrounds it, so each worker keeps the ids of chunks it met, up to a bound.

Defined results: null and empty texts give an empty list; blank texts are
encoded as they stand; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textblock import slices

#: Entries that a worker remembers before it starts afresh.
CACHE_ENTRIES = 300_000
#: Longer chunks are encoded but not remembered.
CACHE_CHARS = 48

# White space as Unicode defines it, and the vocabulary's published pre-tokenizer pattern.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters of the Latin, Cyrillic and Arabic blocks; a run of them, or of digits, that plain punctuation ends is a chunk.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f\u0620-\u064a\u0671-\u06d3"
_ENDS = f"(?=[{_WHITE}.,;:!?()'\"«»|]|\\Z)"
_CHUNK = re.compile(f" ?[{_LETTERS}]+{_ENDS}| ?[0-9\u0660-\u0669\u06f0-\u06f9]+{_ENDS}| ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> id of a rank file (one base64 token and its id a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merges:
    """How each token came about, and from that which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for rank, token in enumerate(self.tokens):
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None and left < rank and right < rank and self.compatible(left, right):
                    self.parts[rank] = (left, right)
                    self.joined[left, right] = rank
                    break

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens in rank order gives just these two.

        Undo merges from the latest back.  At each step the innermost pieces at
        the border could have merged before the piece that swallowed them; if
        the rank of that merge is lower than of the last one undone, they would.
        """
        undone = len(self.tokens)
        joined, parts = self.joined, self.parts
        while True:
            across = joined.get((left, right))
            if across is not None and across < undone:
                return False
            l_parts, r_parts = parts.get(left), parts.get(right)
            if l_parts is None and r_parts is None:
                return True
            # A merge left of the border happens before an equal one right of it.
            if r_parts is None or (l_parts is not None and left > right):
                undone, left = left, l_parts[1]
            else:
                undone, right = right + 1, r_parts[0]


class Encoder(dict):
    """chunk -> its ids as int32 bytes; fills itself."""

    def __init__(self, merges: Merges) -> None:
        import ahocorasick
        import regex

        super().__init__()
        self.merges = merges
        self.split = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        ids = {}
        for rank, token in enumerate(merges.tokens):
            if token:
                ids[token] = rank
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.by_text = {token.decode("latin-1"): rank for token, rank in ids.items()}
        self.reach = max(map(len, ids))
        self.walk = self.automaton.longest_prefix
        #: Every prefix of a token -> the longest token that begins it.
        self.complete: dict[str, int] = {}
        for text in self.by_text:
            rank = -1
            for k in range(1, len(text) + 1):
                rank = self.by_text.get(text[:k], rank)
                self.complete[text[:k]] = rank
        #: For each token, the longest token that is a proper prefix of it, -1 if none.
        self.shorter = [-1] * len(merges.tokens)
        for token, rank in ids.items():
            self.shorter[rank] = next((ids[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ids), -1)
        self.size = [len(t) for t in merges.tokens]
        self.pairs: dict[tuple[int, int], bool] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in self.split(chunk):
            ids += self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        got = array("i", ids).tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = got
        return got

    def fits(self, left: int, right: int) -> bool:
        if len(self.pairs) >= 4 * CACHE_ENTRIES:
            self.pairs.clear()
        ok = self.pairs[left, right] = self.merges.compatible(left, right)
        return ok

    def longest(self, mapped: str, pos: int) -> int:
        """The longest token at *pos*: as far as the automaton goes, then its last complete token."""
        rest = mapped[pos : pos + self.reach]
        return self.complete[rest[: self.walk(rest)]]

    def encode_piece(self, piece: bytes) -> list[int]:
        mapped = piece.decode("latin-1")
        whole = self.by_text.get(mapped)
        if whole is not None:
            return [whole]
        n, size, pairs = len(piece), self.size, self.pairs
        out: list[int] = []
        dead: set[int] = set()  # places from which no covering goes on
        pos, token, last = 0, self.longest(mapped, 0), -1
        while True:
            while token >= 0:
                end = pos + size[token]
                if end not in dead:
                    ok = last < 0 or pairs.get((last, token))
                    if ok is None:
                        ok = self.fits(last, token)
                    if ok:
                        break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                pos, last, token = end, token, self.longest(mapped, end)
            else:
                dead.add(pos)
                token = out.pop()
                pos -= size[token]
                last, token = out[-1] if out else -1, self.shorter[token]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _CHUNK.findall(text)))


_encoders: dict[str, Encoder] = {}


def encode_column(df: DataFrame, id_col: str, text_col: str, ranks_path: str) -> DataFrame:
    """(id_col, ids) with the token ids of each text.  The rank file is read once, on the driver."""
    import hashlib

    ranks = read_ranks(ranks_path)
    merges = df.sparkSession.sparkContext.broadcast(Merges(ranks))
    key = hashlib.sha256(repr(sorted(ranks.items(), key=lambda x: x[1])).encode()).hexdigest()

    def run(batches):
        encoder = _encoders.get(key)
        if encoder is None:
            encoder = _encoders[key] = Encoder(merges.value)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                got = [encoder.encode(t) if t else b"" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
                offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(got), np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offs), ids)], ["id", "ids"])

    ids: Column = F.col(id_col).cast("long")
    return df.select(ids.alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)
