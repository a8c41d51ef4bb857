"""Queries of the training-data problems over the driver's tables, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, defects, history, labels, langid, leakage, mojibake, overlap, sample, splits, topics
from ..storage import fresh_path, small_enough


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_SIDES = {"source": ("src_lang", "source_text"), "target": ("tgt_lang", "target_text")}


def p1_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of each segment of each side: sample_id, side, begin (first word), words, lang, confidence."""
    rows = table(spark, sf, "corpus_rows")
    got = labels.written_in(rows, "sample_id", [t for _, t in _SIDES.values()], labels.fit(rows, "sample_id", _SIDES))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(t).alias("segments")) for s, (_, t) in _SIDES.items()])).alias("x")
    return got.select(F.col("id").alias("sample_id"), sides).select("sample_id", "x.side", F.inline("x.segments")).distinct()


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sides whose label is missing or wrong, or that mix languages, with each language they are written in."""
    rows = table(spark, sf, "corpus_rows")
    got = labels.written_in(rows, "sample_id", [t for _, t in _SIDES.values()], labels.fit(rows, "sample_id", _SIDES))
    langs = got.select("id", *[F.array_distinct(F.transform(t, lambda x: x["lang"])).alias(s) for s, (_, t) in _SIDES.items()])
    named = table(spark, sf, "samples").select("id", *[langid.primary(F.col(label)).alias(f"{s}_label") for s, (label, _) in _SIDES.items()])
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("langs"), F.col(f"{s}_label").alias("label")) for s in _SIDES])).alias("x")
    cases = langs.join(named, "id").select("id", sides).filter("size(x.langs) > 1 or (size(x.langs) = 1 and not (x.langs[0] <=> x.label))")
    return cases.select(F.col("id").alias("sample_id"), "x.side", F.explode("x.langs").alias("lang")).distinct()


def _documents_of_samples(spark: SparkSession, sf: str) -> DataFrame:
    piece = F.lower(F.trim("document_id")).alias("piece")
    rows = table(spark, sf, "corpus_rows").select("sample_id", "source_id", splits.document_name(F.col("document_id")).alias("doc_key"), piece).distinct()
    of = lambda name, mark: F.when(F.col("doc_key").isNotNull(), F.concat(F.lit(mark), F.concat_ws("/", F.col("source_id").cast("string"), name)))
    # The document, and the piece of it as it is written: two names of one entity.
    return splits.components(rows, "sample_id", [of("doc_key", ""), of("piece", "piece ")]).drop("piece").distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the existing evaluation splits tear apart."""
    split = F.lower(F.trim("evaluation_split"))
    members = table(spark, sf, "dataset_reservation_samples").select("sample_id", split.alias("split")).filter(F.col("split").isin("dev", "test")).distinct()
    joined = _documents_of_samples(spark, sf).filter("doc_key is not null").join(members, "sample_id")
    return splits.torn(joined, "split", ["source_id", "doc_key"]).select("source_id", "doc_key")


def p2_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every sample's document and its split, 0.8 / 0.1 / 0.1."""
    return _documents_of_samples(spark, sf).select("sample_id", "source_id", "doc_key", splits.assign(F.col("component")).alias("split"))


#: Sampling rate of p4: the inclusion probability of a record of weight 1.
P4_RATE = 0.1


def p4_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of samples.id weighted by quality (0.5 where unknown), of which reviews may raise the weight."""
    first = table(spark, sf, "samples").select("id", F.coalesce("quality", F.lit(0.5)).alias("weight"))
    reviewed = table(spark, sf, "annotations").join(first.select("id"), F.col("sample_id") == first["id"], "left_semi").select(F.col("sample_id").alias("id"), F.col("quality").alias("weight"))
    store = sample.WeightStore(spark, fresh_path(spark, "p4-weights"))
    store.observe(first)
    store.observe(reviewed)
    return sample.poisson_sample(store.weights(), P4_RATE).select(F.col("id").alias("sample_id"), "weight")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Failed question-answer and translation pairs with their defect."""
    kinds = table(spark, sf, "batches").select(F.col("id").alias("batch_id"), F.col("source_id").alias("of"))
    kinds = kinds.join(table(spark, sf, "sources").select(F.col("id").alias("of"), (F.col("kind") == "instruction").alias("instruct")), "of").select("batch_id", "instruct")
    rows = table(spark, sf, "corpus_rows")
    marked = rows.join(F.broadcast(kinds) if small_enough(kinds, 100_000) else kinds, "batch_id", "left")
    got = defects.judged(marked, "sample_id", "source_text", "target_text", "src_lang", "tgt_lang", "instruct", labels.fit(rows, "sample_id", _SIDES))
    return got.withColumnRenamed("id", "sample_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sides with text read in the wrong encoding."""
    return p6_restored(spark, sf).select("sample_id", "side")


def p6_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Garbled sides with the restored text, and whether characters are lost."""
    got = mojibake.repair(table(spark, sf, "corpus_rows"), "sample_id", {s: t for s, (_, t) in _SIDES.items()})
    return got.select(F.col("id").alias("sample_id"), "side", "lost", "restored").dropDuplicates(["sample_id", "side"])


def p8_ids(spark: SparkSession, sf: str, ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode_column(table(spark, sf, "documents"), "doc_id", "text", ranks)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the evaluation items that they hold."""
    return leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items"), "doc_id", "text", "item_id", "text")


def _topic_model(spark: SparkSession, sf: str):
    subjects = sorted(r.subject for r in table(spark, sf, "subject_areas").select("subject").distinct().collect())  # fixed, 8 rows
    return topics.fit(table(spark, sf, "documents"), table(spark, sf, "doc_labels"), subjects, "doc_id", "text", "lang", "doc_id", "subject")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Subject areas of each document."""
    return topics.assigned(topics.proportions(*_topic_model(spark, sf))).withColumnRenamed("id", "doc_id")


def p10_proportions(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each subject in the mentions of each document."""
    return topics.proportions(*_topic_model(spark, sf)).withColumnRenamed("id", "doc_id")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("sample_id_a"), F.greatest(a, b).alias("sample_id_b")).distinct()


def _split_sides(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "samples")
    return s.select("id", (F.col("allocation") == "RESERVED_EVALUATION").alias("in_a"), (F.col("allocation") == "TRAINABLE").alias("in_b"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Near-same pairs of a RESERVED_EVALUATION and a TRAINABLE sample."""
    _, pairs = overlap.near_same_between(table(spark, sf, "corpus_rows"), _split_sides(spark, sf), "sample_id", "source_text", "target_text")
    return _ordered(pairs, "id_a", "id_b")


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping reserved samples and their pairs by evaluation split and source."""
    exact, members, _ = overlap.links_between(table(spark, sf, "corpus_rows"), _split_sides(spark, sf), "sample_id", "source_text", "target_text")
    rows = overlap.partners(exact, members).withColumnRenamed("id", "id_a")
    split = table(spark, sf, "dataset_reservation_samples").select(F.col("sample_id").alias("id_a"), F.lower(F.trim("evaluation_split")).alias("evaluation_split")).distinct()
    source = table(spark, sf, "samples").select(F.col("id").alias("id_a"), "source_id")
    return rows.join(source, "id_a").join(split, "id_a", "left").groupBy("evaluation_split", "source_id").agg(F.countDistinct("id_a").alias("samples"), F.sum("partners").alias("pairs"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Near-same pairs of a sample of an importing batch with one of a ready batch."""
    status = table(spark, sf, "batches").select(F.col("id").alias("batch_id"), "status")
    state = table(spark, sf, "samples").select("id", "batch_id").join(F.broadcast(status) if small_enough(status, 100_000) else status, "batch_id")
    state = state.select("id", (F.col("status") == "importing").alias("arriving"), (F.col("status") == "ready").alias("accepted"))
    return _ordered(history.against_history(table(spark, sf, "corpus_rows"), state, "sample_id", "source_text", "target_text"), "id_new", "id_old")


QUERIES = {f.__name__: f for f in (p1_found, p1_segments, p2_found, p2_split, p3_found, p3_counts, p4_sample, p5_found, p6_found, p6_restored, p7_found, p8_ids, p9_found, p10_found, p10_proportions)}

_DOC_KEY = "nullif(regexp_replace(regexp_replace(regexp_replace(lower(document_id), '^\\s+|\\s+$', '', 'g'), '(\\s+part\\s+[0-9]+|[:#/|]\\s*(chunk|part|p\\.|c)?\\s*[0-9]+)$', ''), '\\s+$', ''), '')"
_DOCS = f"select distinct sample_id, source_id, {_DOC_KEY} as doc_key from corpus_rows"


def _split_score(name: str, weight: float, seed: int = 42) -> str:
    return f"(-{weight} / ln((('0x' || substr(md5(component || '-{seed}-{name}'), 1, 12))::BIGINT + 0.5) / {16.0**12!r}))"


SQL: dict[str, str] = {
    "p2_found": f"""select d.source_id, d.doc_key from ({_DOCS}) d join dataset_reservation_samples m on m.sample_id = d.sample_id
        where d.doc_key is not null and lower(trim(m.evaluation_split)) in ('dev', 'test')
        group by d.source_id, d.doc_key having count(distinct lower(trim(m.evaluation_split))) = 2""",
    "p2_split": f"""with d as ({_DOCS}), c as (select *, coalesce(source_id || '/' || doc_key, 'record ' || sample_id) as component from d),
        s as (select *, {", ".join(f"{_split_score(n, w)} as s_{n}" for n, w in splits.PROPORTIONS.items())} from c)
        select sample_id, source_id, doc_key, case when s_train >= s_validation and s_train >= s_test then 'train' when s_validation >= s_test then 'validation' else 'test' end as split from s""",
    "p4_sample": f"""with o as (select id, coalesce(quality, 0.5) as w from samples
            union all select sample_id, quality from annotations where sample_id in (select id from samples)),
        m as (select id, max(greatest(coalesce(w, 0.0), 0.0)) as weight from o where id is not null group by id)
        select id as sample_id, weight from m where {sample.sql_chosen("weight", "id", P4_RATE)}""",
}
