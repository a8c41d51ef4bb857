"""Subject areas of documents by a distributed latent Dirichlet topic model.

* Texts are hashed into folded words once; every later pass reads these.
* The vocabulary are the terms in at least ``LEAST_SHARE`` of the documents, so its
  size is bounded by the mean document length over that share.
* Topics are polylingual: a topic has one term distribution for each language, over
  the terms that belong to it, so that a subject weighs alike in all languages
  whatever their shares of the corpus.  One topic is started for each subject from
  the terms that are over-represented in hand-labelled documents (at most
  ``LABELLED`` of each subject, a documented bound), two for the rest of the
  texts.  Variational EM over all documents then moves them; the start of the
  subject topics stays as their prior.  Expected counts are added up on the
  executors; the sums, topics x terms, reach the driver once a pass.
* A fitted topic gets the subject that its top terms (by lift over the corpus)
  are labelled with; topics whose top terms agree on none are background.
* A document gets the subjects that have at least ``SHARE`` of what its topic
  proportions give to subjects at all.

Defined results: null, empty and blank texts, and texts with less than
``LEAST_WORDS`` expected words on subjects, have no subject; labels that are null,
unknown or entered twice are cleaned (case, blanks) or ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textblock as tb
from .langid import primary
from ..hashing import portable_hash
from ..storage import cut

LEAST_SHARE, LEAST_DOCS = 0.0008, 3
LABELLED = 2000
PASSES, STEPS = 3, 3
LEAST_LANGUAGE = 0.005
#: Weight of a subject topic's start as its prior in later passes.
PRIOR = 0.5
#: A term speaks for a subject with this many labelled documents, most of them of the subject.
SUPPORT = 4
ALPHA, ETA = 0.1, 0.01
#: Terms by which a topic is judged, and how many of them must speak for some subject.
TOP_TERMS, LEAST_TERMS = 25, 4
SHARE, LEAST_WORDS = 0.2, 1.5
#: Least probability of a word's subject for the word to be counted to it.
SURE = 0.5


def hashed(documents: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, w): the language it is marked with, and 32-bit hashes of the folded words in order."""

    def run(batches):
        for b in batches:
            for lo, hi in tb.slices(b.column(2)):
                h, first = tb.hashed_words(b.column(2).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), tb.list_array((h & 0xFFFFFFFF).astype(np.uint32).view(np.int32), first, pa.int32())], ["id", "lang", "w"])

    return documents.select(F.col(id_col).cast("long").alias("id"), primary(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string")).mapInArrow(run, "id long, lang string, w array<int>")


def clean_labels(labels: DataFrame, id_col: str, label_col: str, subjects: list[str]) -> DataFrame:
    """(id, s): one row for each document and subject number, of at most LABELLED documents a subject."""
    s = F.array_position(F.array(*map(F.lit, subjects)), F.lower(F.regexp_replace(label_col, r"^\s+|\s+$", ""))).cast("int") - 1
    rows = labels.select(F.col(id_col).cast("long").alias("id"), s.alias("s")).filter("id is not null and s >= 0").distinct()
    out = None
    for k in range(len(subjects)):
        part = rows.filter(F.col("s") == k).orderBy(portable_hash(F.col("id"), "topics"), "id").limit(LABELLED)
        out = part if out is None else out.unionByName(part)
    return out


def languages(words: DataFrame) -> list[str]:
    """Languages that enough documents are marked with; at most 1 / LEAST_LANGUAGE."""
    n = words.groupBy("lang").agg(F.count("*").alias("n"))
    total = words.count()
    return sorted(r.lang for r in n.filter((F.col("n") >= LEAST_LANGUAGE * total) & F.col("lang").isNotNull()).collect())


def vocabulary(words: DataFrame, labels: DataFrame, n_subjects: int, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms (ascending), occurrences, documents with each term by labelled subject, and occurrences by language."""
    marked = words.join(F.broadcast(labels.groupBy("id").agg(F.collect_set("s").alias("s"))), "id", "left")  # at most n_subjects * LABELLED rows
    number = F.coalesce(F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1, F.lit(-1)) if langs else F.lit(-1)
    names = ["n", "df", *(f"s{k}" for k in range(n_subjects)), *(f"l{k}" for k in range(len(langs)))]

    def run(batches):
        for b in batches:
            offs = b.column(0).offsets.to_numpy().astype(np.int64)
            w = b.column(0).values.to_numpy()[offs[0] : offs[-1]].view(np.uint32).astype(np.uint64)
            row = np.repeat(np.arange(len(offs) - 1, dtype=np.uint64), np.diff(offs))
            key, n = np.unique((row << np.uint64(32)) | w, return_counts=True)
            doc, term = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            terms, back = np.unique(term, return_inverse=True)
            cols = [np.bincount(back, n, len(terms)), np.bincount(back, minlength=len(terms))]
            tags, lang = b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
            for k in range(n_subjects):
                has = np.array([t is not None and k in t for t in tags], bool)
                cols.append(np.bincount(back, has[doc], len(terms)))
            for k in range(len(langs)):
                cols.append(np.bincount(back, n * (lang == k)[doc], len(terms)))
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int32)), *(pa.array(c.astype(np.int64)) for c in cols)], ["t", *names])

    total = words.count()
    sums = marked.select("w", "s", number.alias("g")).mapInArrow(run, "t int, " + ", ".join(f"{c} long" for c in names)).groupBy("t").agg(*[F.sum(c).alias(c) for c in names])
    got = sums.filter(F.col("df") >= max(LEAST_DOCS, LEAST_SHARE * total)).toArrow()
    terms = got.column("t").to_numpy().view(np.uint32)
    order = np.argsort(terms)
    cols = [got.column(c).to_numpy()[order].astype(np.float64) for c in names]
    table = np.array(cols).reshape(len(names), len(terms))
    return terms[order], table[0], table[2 : 2 + n_subjects], table[2 + n_subjects :]


def term_languages(by_language: np.ndarray) -> np.ndarray:
    """The language that a term belongs to: where it is most frequent; one more group for terms of unmarked documents."""
    if not len(by_language):
        return np.zeros(by_language.shape[1], np.int64)
    rate = by_language / np.maximum(by_language.sum(1, keepdims=True), 1)
    return np.where(rate.max(0) > 0, rate.argmax(0), len(by_language))


def _within(values: np.ndarray, group: np.ndarray, how) -> np.ndarray:
    """For each topic and term the sum or maximum over the terms of its language."""
    out = np.zeros((len(values), int(group.max(initial=0)) + 1))
    for row, v in zip(out, values):
        how.at(row, group, v)
    return out[:, group]


def subject_seeds(n: np.ndarray, by_subject: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Start of the subject topics (subjects x terms): the terms over-represented in their labelled documents, language by language.

    Terms weigh by the labelled documents that hold them, scaled up to the corpus:
    what is frequent in documents that nobody labels is no subject's.
    """
    rest = by_subject.sum(0) - by_subject
    rate, other = ((x + 0.05) / np.maximum(_within(x, group, np.maximum), 1) for x in (by_subject, rest))
    scale = n.sum() / max(by_subject.sum(), 1)
    return np.minimum(by_subject * scale, n) * np.maximum(np.log(rate / other), 0) ** 2 * (by_subject >= 2) + ETA


def clear_terms(by_subject: np.ndarray) -> np.ndarray:
    """Terms that speak for one subject: in enough labelled documents, most of them of that subject."""
    return (by_subject.sum(0) >= SUPPORT) & (by_subject.max(0, initial=0) > 0.5 * by_subject.sum(0))


def background_seeds(n: np.ndarray, by_subject: np.ndarray) -> np.ndarray:
    """Start of the other topics: the corpus, and the corpus with random changes; hardly any of the subjects' terms."""
    other = np.where(clear_terms(by_subject), 0.05, 1.0)
    return np.stack([n, 0.2 * n * np.random.default_rng(11).uniform(0.5, 1.5, len(n))]) * other + ETA


def bags(words: DataFrame, terms: np.ndarray) -> DataFrame:
    """(id, t): the documents as vocabulary numbers in order, -1 for one or more words outside."""
    shared = words.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        for b in batches:
            offs = b.column(1).offsets.to_numpy().astype(np.int64)
            w = b.column(1).values.to_numpy()[offs[0] : offs[-1]].view(np.uint32)
            offs = offs - offs[0]
            at = np.searchsorted(shared.value, w)
            at[at == len(shared.value)] = 0
            t = np.where(shared.value[at] == w, at, -1) if len(shared.value) else np.full(len(w), -1)
            first = np.zeros(len(t) + 1, bool)
            first[offs] = True
            keep = (t >= 0) | first[:-1] | np.concatenate([[True], t[:-1] >= 0]) if len(t) else np.zeros(0, bool)
            upto = np.concatenate([[0], np.cumsum(keep)])
            yield pa.RecordBatch.from_arrays([b.column(0), tb.list_array(t[keep].astype(np.int32), upto[offs], pa.int32())], ["id", "t"])

    return words.select("id", "w").mapInArrow(run, "id long, t array<int>")


def _posterior(t: np.ndarray, doc: np.ndarray, n_docs: int, beta: np.ndarray) -> np.ndarray:
    """Topic probabilities of each token after a few steps of variational inference of its document."""
    like = beta.T[t]
    theta = np.full((n_docs, beta.shape[0]), 1.0, np.float32)
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    r = like
    for _ in range(STEPS):
        r = like * theta[doc]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        if len(starts):
            theta[doc[starts]] = np.add.reduceat(r, starts, axis=0) + ALPHA
    return r


def _tokens(column: pa.Array, max_tokens: int = 200_000):
    """Ranges of documents of a batch: first row, row count, tokens and their rows."""
    offs = column.offsets.to_numpy().astype(np.int64)
    t = column.values.to_numpy()[offs[0] : offs[-1]]
    offs = offs - offs[0]
    part = offs[1:] // max_tokens
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(offs) - 1]]) if len(offs) > 1 else np.zeros(0, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(a), int(b - a), t[offs[a] : offs[b]], np.repeat(np.arange(b - a), np.diff(offs[a : b + 1]))


def em_pass(bag: DataFrame, beta: np.ndarray) -> np.ndarray:
    """Expected occurrences, topics x terms, over all documents."""
    shared = bag.sparkSession.sparkContext.broadcast(beta.astype(np.float32))

    topics = [f"k{k}" for k in range(len(beta))]

    def run(batches):
        beta = shared.value
        total = np.zeros(beta.shape, np.float64)
        for b in batches:
            for _, n, t, doc in _tokens(b.column(0)):
                t, doc = t[t >= 0], doc[t >= 0]
                r = _posterior(t, doc, n, beta)
                for k in range(len(beta)):
                    total[k] += np.bincount(t, r[:, k], beta.shape[1])
        at = np.flatnonzero(total.any(0))
        for lo in range(0, len(at), 20_000):
            part = at[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(x[part]) for x in total)], ["t", *topics])

    sums = bag.select("t").mapInArrow(run, "t int, " + ", ".join(f"{k} double" for k in topics)).groupBy("t").agg(*[F.sum(k).alias(k) for k in topics]).toArrow()
    out = np.zeros(beta.shape)
    out[:, sums.column("t").to_numpy()] = [sums.column(k).to_numpy() for k in topics]
    return out


def _beta(counts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Term distributions of the topics, one for each language."""
    counts = counts + ETA
    return counts / _within(counts, group, np.add)


def topic_subjects(beta: np.ndarray, n: np.ndarray, by_subject: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subject of each topic (-1: background) by its top terms, and those terms (topics x TOP_TERMS)."""
    usual = _beta((n + 1)[None], group)[0]
    score = beta * np.log(np.maximum(beta / usual, 1e-9))
    top = np.argsort(-score, axis=1, kind="stable")[:, :TOP_TERMS]
    says, clear = by_subject.argmax(0), clear_terms(by_subject)
    out = np.full(len(beta), -1)
    for k in range(len(beta)):
        own = top[k][clear[top[k]]]
        weight = np.bincount(says[own], np.maximum(score[k, own], 0), len(by_subject)) if len(own) >= LEAST_TERMS else np.zeros(1)
        if weight.max() > 0.5 * weight.sum() and weight.max() > 0.3 * np.maximum(score[k, top[k]], 0).sum():
            out[k] = weight.argmax()
    return out, top


class Model:
    """A fitted model: vocabulary, topics and their subjects."""

    def __init__(self, terms: np.ndarray, n: np.ndarray, by_subject: np.ndarray, counts: np.ndarray, group: np.ndarray, subjects: list[str]) -> None:
        self.terms, self.subjects = terms, subjects
        self.beta = _beta(counts, group)
        self.subject_of, self.top = topic_subjects(self.beta, n, by_subject, group)


def fit(documents: DataFrame, labels: DataFrame, subjects: list[str], id_col: str, text_col: str, lang_col: str, label_id: str, label_col: str) -> tuple[Model, DataFrame]:
    """The model fitted on all documents, and the documents as vocabulary numbers."""
    words = cut(hashed(documents, id_col, text_col, lang_col), "p10-words")
    terms, n, by_subject, by_language = vocabulary(words, clean_labels(labels, label_id, label_col, subjects), len(subjects), languages(words))
    bag = cut(bags(words, terms), "p10-bags")
    group = term_languages(by_language)
    start = subject_seeds(n, by_subject, group)
    counts = np.concatenate([start, background_seeds(n, by_subject)])
    for _ in range(PASSES if len(terms) else 0):
        counts = em_pass(bag, _beta(counts, group))
        counts[: len(subjects)] += PRIOR * start
    return Model(terms, n, by_subject, counts, group, subjects), bag


def proportions(model: Model, bag: DataFrame) -> DataFrame:
    """(id, subject, share, words): of what a document's topic proportions give to subjects, the share of each, and the expected words on subjects."""
    shared = bag.sparkSession.sparkContext.broadcast((model.beta.astype(np.float32), model.subject_of))
    names = model.subjects

    def run(batches):
        beta, subject_of = shared.value
        for b in batches:
            for a, n, t, doc in _tokens(b.column(1)):
                t, doc = t[t >= 0], doc[t >= 0]
                r = _posterior(t, doc, n, beta)
                of = np.zeros((len(t), len(names)), np.float32)
                for k, s in enumerate(subject_of):
                    if s >= 0:
                        of[:, s] += r[:, k]
                own = of.argmax(1) if len(t) else np.zeros(0, np.int64)
                sure = np.flatnonzero(of[np.arange(len(t)), own] >= SURE)
                m = np.bincount(doc[sure] * len(names) + own[sure], minlength=n * len(names)).reshape(n, len(names))
                row, s = np.nonzero(m)
                all_ = m.sum(1)[row]
                cols = [b.column(0).slice(a, n).take(pa.array(row)), pa.array(names).take(pa.array(s)), pa.array(m[row, s] / all_), pa.array(all_.astype(np.float64))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "subject", "share", "words"])

    return bag.mapInArrow(run, "id long, subject string, share double, words double")


def assigned(shares: DataFrame) -> DataFrame:
    """(id, subject) of the subjects that a document is about."""
    return shares.filter((F.col("share") >= SHARE) & (F.col("words") >= LEAST_WORDS)).select("id", "subject").distinct()
