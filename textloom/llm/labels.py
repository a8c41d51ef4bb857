"""Checking language labels: the languages that each side of a record is really written in.

Texts read with the wrong encoding count in the language they were written in:
sequences that only wrong decoding makes are replaced first (``mojibake``), and a
text with hardly any evidence for a language is read back by every single-byte
pair and kept in the reading with the most evidence.

Defined results: sides of fewer than ``LEAST_WORDS`` words (empty, blank,
placeholders) have no language; repeated records count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import langid, mojibake, textblock as tb

LEAST_WORDS = 3
#: Evidence per word below which a text is tried in other readings, and how many times more a reading must have.
WEAK, BETTER = 0.6, 2.0


class Reader:
    """Detector and repairer of one worker."""

    def __init__(self, table: np.ndarray) -> None:
        self.detector = langid.Detector(table)
        self.repairer = mojibake.Repairer(np.zeros(2 * mojibake.BUCKETS, np.int32))
        self.seen = {cp for t in self.repairer.single.values() for cp in t}

    def unscrambled(self, texts: pa.Array, codes: np.ndarray, offs: np.ndarray) -> pa.Array:
        """Texts with misread sequences replaced; the same object if there are none."""
        odd = self.repairer.odd[np.minimum(codes, 0xFFFF)]
        values = None
        for i in np.flatnonzero(mojibake.row_sums(odd.astype(np.int32), offs)).tolist():
            t = texts[i].as_py()
            if not self.repairer.has_sequence(t):
                continue
            good = mojibake._PIECE.sub(self._piece, t)
            if good != t:
                values = values if values is not None else texts.to_pylist()
                values[i] = good
        return texts if values is None else pa.array(values, texts.type)

    def _piece(self, m) -> str:
        p = m.group()
        if p.isascii():
            return p
        edits, strength = self.repairer.sequences(p)
        return mojibake.applied(p, edits if strength > 1 else self.repairer.wholly(p))

    def languages(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Segments of the texts of one slice (row, lang, begin, words, confidence) and each text's main language."""
        texts = tb.strip_tags(texts)
        codes, offs = tb.codes_of(texts)
        repaired = self.unscrambled(texts, codes, offs)
        if repaired is not texts:
            texts = repaired
            codes, offs = tb.codes_of(texts)
        f, foffs = tb.fold(codes, offs)
        s, e, first = tb.words(f, foffs)
        ev = self.detector.evidence(f, s, e)
        upto = self.detector.sums(ev)
        total = (upto[first[1:]] - upto[first[:-1]]).max(1, initial=0)
        n = np.diff(first)
        weak = np.flatnonzero((n >= LEAST_WORDS) & (total < WEAK * n))
        if len(weak):
            replaced = self._other_readings(texts, weak, total)
            if replaced:
                values = texts.to_pylist()
                for i, t in replaced.items():
                    values[i] = t
                codes, offs = tb.codes_of(pa.array(values, pa.large_string()))
                f, foffs = tb.fold(codes, offs)
                s, e, first = tb.words(f, foffs)
                ev = self.detector.evidence(f, s, e)
                upto = self.detector.sums(ev)
        got = self.detector.segments_of(ev, first, upto)
        enough = np.diff(first) >= LEAST_WORDS
        got["main"] = np.where(enough, got["main"], -1)
        keep = enough[got["row"]]
        return {k: v if k == "main" else v[keep] for k, v in got.items()}

    def _other_readings(self, texts: pa.Array, rows: np.ndarray, total: np.ndarray) -> dict[int, str]:
        tries: list[tuple[int, str]] = []
        for i in rows.tolist():
            t = texts[i].as_py()
            if sum(ord(c) > 127 and ord(c) in self.seen for c in t) < 0.2 * len(t):
                continue
            tries += {(i, t.translate(table)) for table in self.repairer.single.values()} - {(i, t)}
        best: dict[int, tuple[float, str]] = {}
        for lo in range(0, len(tries), 500):
            part = tries[lo : lo + 500]
            codes, offs = tb.codes_of(pa.array([t for _, t in part], pa.large_string()))
            f, offs = tb.fold(codes, offs)
            s, e, first = tb.words(f, offs)
            ev = self.detector.evidence(f, s, e)
            upto = np.concatenate([np.zeros((1, ev.shape[1])), np.cumsum(ev, 0, np.float64)])
            score = (upto[first[1:]] - upto[first[:-1]]).max(1, initial=0)
            for (i, t), x in zip(part, score.tolist()):
                if x > BETTER * total[i] + 1 and x > best.get(i, (0.0,))[0]:
                    best[i] = (x, t)
        return {i: t for i, (_, t) in best.items()}


def fit(records: DataFrame, id_col: str, sides: dict[str, tuple[str, str]]) -> np.ndarray:
    """The language filter from the records' own labels.  sides: name -> (label column, text column)."""
    texts = None
    for side, (label, text) in sides.items():
        part = records.select(F.concat_ws("/", F.col(id_col).cast("string"), F.lit(side)).alias("key"), F.col(text).cast("string").alias("text"), F.col(label).alias("label"))
        texts = part if texts is None else texts.unionByName(part)
    return langid.train(texts)


SEGMENTS = "array<struct<lang: string, begin: int, words: int, confidence: double>>"


def written_in(records: DataFrame, id_col: str, columns: list[str], table: np.ndarray) -> DataFrame:
    """(id, one column of segments for each text column): language, first word, number of words, confidence."""
    shared = records.sparkSession.sparkContext.broadcast(table)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int32()), ("words", pa.int32()), ("confidence", pa.float64())]))

    def segments(reader: Reader, col: pa.Array) -> pa.Array:
        parts, counts = [], []
        names = pa.array(reader.detector.languages)
        for lo, hi in tb.slices(col):
            got = reader.languages(col.slice(lo, hi - lo).cast(pa.large_string()))
            counts.append(np.bincount(got["row"], minlength=hi - lo))
            parts.append(pa.StructArray.from_arrays([names.take(pa.array(got["lang"])), pa.array(got["begin"], pa.int32()), pa.array(got["words"], pa.int32()), pa.array(got["confidence"], pa.float64())], ["lang", "begin", "words", "confidence"]))
        offs = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
        flat = pa.concat_arrays(parts) if parts else pa.array([], kind.value_type)
        return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), flat)

    def run(batches):
        reader = Reader(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *(segments(reader, c) for c in b.columns[1:])], ["id", *columns])

    schema = ", ".join(["id long", *(f"{c} {SEGMENTS}" for c in columns)])
    return records.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("string") for c in columns]).mapInArrow(run, schema)
