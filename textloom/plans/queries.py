"""Queries over the driver's tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import embedding as E, language as L
from ..hashing import portable_hash, sql_hash
from ..operators import allocation as A, contamination as C, dataset as D, evalset as V, ingest as I, pipeline as PL, quality as Q, selection as S
from ..schema import RESERVED
from ..sources import readers as R, writers as W
from ..storage import cut, fresh_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """The authority on allocations: (sample_id, allocation)."""
    return table(spark, sf, "samples").select(F.col("id").alias("sample_id"), "allocation")


META = ["sample_id", "batch_id", "source_id", "src_lang", "tgt_lang", "domain", "quality", "document_id"]


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus rows without texts; rows stored twice count once."""
    return table(spark, sf, "corpus_rows").select(*META).distinct()


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus rows with texts; rows stored twice count once."""
    return table(spark, sf, "corpus_rows").drop("allocation", "n_tokens", "meta").dropDuplicates(["sample_id"])


_META = f"(select distinct {', '.join(META)} from corpus_rows)"
_ROWS = f"(select distinct {', '.join(META)}, source_text, target_text from corpus_rows)"
_TAG = "coalesce(nullif(lower(regexp_extract(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '^[^-_]*')), ''), 'und')"
#: Unicode white space, which the SQL engine's \\s lacks.
_WS = "[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"


def _h(expr: str, seed: str = "42") -> str:
    return sql_hash(f"{expr} || '-{seed}'")


RULES = [D.BatchRule(1), D.BatchRule(4, "percent", 50), D.BatchRule(5, "percent", 12.5), D.BatchRule(6, "count", 17), D.BatchRule(11, "all"), D.BatchRule(13, "count", 40)]
FILTERS = D.Filters(min_quality=0.2)
_COMPOSED = f"""(select * from (
    select *, row_number() over (partition by batch_id order by {_h('sample_id')}, sample_id) as rank, count(*) over (partition by batch_id) as n
    from {_META} where quality >= 0.2)
  where batch_id in (1, 11) or (batch_id = 4 and rank <= ceil(n * 50.0 / 100)) or (batch_id = 5 and rank <= ceil(n * 12.5 / 100)) or (batch_id = 6 and rank <= 17) or (batch_id = 13 and rank <= 40))"""
_TRAINABLE = "sample_id not in (select id from samples where allocation <> 'TRAINABLE')"


@query(f"""select case when b < 0.9 then 'train' when b < 0.95 then 'validation' else 'test' end as split, src_lang, count(*) as n
  from (select *, ({_h('sample_id')} % 1000000) / 1e6 as b from {_COMPOSED} where {_TRAINABLE}) group by all""")
def composition_split_counts(spark, sf):
    """Compose by batch rules, take away what is not trainable, split, count."""
    rows = D.allocated(D.compose(metadata(spark, sf), FILTERS, RULES), registry(spark, sf))
    return rows.groupBy(D.split_of(F.col("sample_id")).alias("split"), "src_lang").agg(F.count("*").alias("n"))


@query(f"select batch_id, sample_id from {_COMPOSED}")
def composition_rows(spark, sf):
    """The composed rows themselves."""
    return D.compose(metadata(spark, sf), FILTERS, RULES).select("batch_id", "sample_id")


@query(f"select sample_id from {_META} where src_lang in ('en', 'de') and tgt_lang in ('de', 'en', 'fa') and domain in ('sport', 'law', 'finance') and source_id in (7, 29, 27, 4) and quality >= 0.3 and quality <= 0.9")
def filter_conjunction(spark, sf):
    f = D.Filters(src_lang=["en", "de"], tgt_lang=["de", "en", "fa"], domain=["sport", "law", "finance"], source_id=[7, 29, 27, 4], min_quality=0.3, max_quality=0.9)
    return metadata(spark, sf).filter(f.condition()).select("sample_id")


@query(f"select sample_id from {_ROWS} where source_text ilike '%blood pres_ure%' or target_text ilike '%blood pres_ure%'")
def text_contains(spark, sf):
    return table(spark, sf, "corpus_rows").filter(D.Filters(contains="blood pres_ure").condition()).select("sample_id").distinct()


@query("select distinct sample_id from dataset_reservation_samples where evaluation_split in ('dev') and human_verify is false")
def eval_filters(spark, sf):
    return table(spark, sf, "dataset_reservation_samples").filter(D.Filters(evaluation_split=["dev"], human_verify=False).condition()).select("sample_id").distinct()


@query(f"select sample_id from {_META} where {_TRAINABLE}")
def alloc_anti(spark, sf):
    return D.allocated(metadata(spark, sf), registry(spark, sf)).select("sample_id")


@query(f"select sample_id from {_META} where sample_id in (select id from samples where allocation = 'RESERVED_EVALUATION')")
def alloc_semi_reserved(spark, sf):
    return D.allocated(metadata(spark, sf), registry(spark, sf), RESERVED).select("sample_id")


@query(f"select coalesce(s.allocation, 'MISSING') as allocation, count(*) as n from {_META} c left join samples s on s.id = c.sample_id group by 1 union all select 'composed', count(*) from {_META}")
def allocation_counts(spark, sf):
    return D.allocation_counts(metadata(spark, sf), registry(spark, sf))


@query(f"select src_lang || '-' || tgt_lang as language_pair, count(*) as n from {_META} group by 1 order by n desc, language_pair nulls first limit 100")
def stats_language_pair(spark, sf):
    return D.statistics(metadata(spark, sf))["language_pair"]


@query(f"select coalesce(domain, 'unknown') as domain, count(*) as n from {_META} group by 1 order by n desc, 1 limit 100")
def stats_domain(spark, sf):
    return D.statistics(metadata(spark, sf))["domain"]


@query(f"select source_id, count(*) as n from {_META} group by 1 order by n desc, 1 limit 100")
def stats_source(spark, sf):
    return D.statistics(metadata(spark, sf))["source"]


@query(f"select batch_id, count(*) as n from {_META} group by 1 order by n desc, 1 limit 100")
def stats_batch(spark, sf):
    return D.statistics(metadata(spark, sf))["batch"]


@query(f"""with c as (select src_lang || '-' || tgt_lang as p, coalesce(domain, 'unknown') as d from {_META})
  select 'rows' as kind, 'all' as key, count(*) as n from c union all select 'language_pair', p, count(*) from c group by p union all select 'domain', d, count(*) from c group by d""")
def batch_stats_grouping(spark, sf):
    return I.batch_statistics(metadata(spark, sf))


@query("select o.kind, count(s.id) as samples, count(distinct o.id) as sources, round(avg(s.quality), 6) as quality from sources o left join samples s on s.source_id = o.id group by 1")
def sources_outer_join(spark, sf):
    o, s = table(spark, sf, "sources"), table(spark, sf, "samples").select(F.col("id").alias("s_id"), "source_id", "quality")
    per = s.groupBy("source_id").agg(F.count("s_id").alias("n"), F.sum("quality").alias("q"), F.count("quality").alias("c"))
    j = o.join(per, o["id"] == per["source_id"], "left")
    return j.groupBy("kind").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.countDistinct("id").alias("sources"), F.round(F.sum("q") / F.sum("c"), 6).alias("quality"))


@query("""select count(*) as samples, count(*) filter (allocation = 'TRAINABLE') as trainable, count(*) filter (allocation = 'RESERVED_EVALUATION') as reserved,
  count(*) filter (allocation = 'QUARANTINED') as quarantined, count(*) filter (allocation = 'IGNORED') as ignored, count(reserved_at) as stamped, count(distinct batch_id) as batches from samples""")
def overview_counts(spark, sf):
    s = table(spark, sf, "samples")
    of = lambda a: F.count_if(F.col("allocation") == a)
    return s.agg(F.count("*").alias("samples"), of("TRAINABLE").alias("trainable"), of("RESERVED_EVALUATION").alias("reserved"), of("QUARANTINED").alias("quarantined"), of("IGNORED").alias("ignored"), F.count("reserved_at").alias("stamped"), F.countDistinct("batch_id").alias("batches"))


@query("""select id, status, sample_count, (stats->>'$.rows')::BIGINT as stored_rows, (stats->>'$.attempt')::BIGINT as attempt from batches order by id desc limit 50""")
def latest_batches(spark, sf):
    b = table(spark, sf, "batches")
    js = lambda k: F.get_json_object("stats", f"$.{k}").cast("long")
    return D.listing(b).select("id", "status", "sample_count", js("rows").alias("stored_rows"), js("attempt").alias("attempt"))


@query("select id from batches where status = 'ready' and parquet_uri is not null")
def ready_batches(spark, sf):
    return D.ready_batches(table(spark, sf, "batches")).select("id")


@query(f"select {_TAG.format('src_lang')} || '-' || {_TAG.format('tgt_lang')} as pair, count(*) as n from samples group by 1")
def pair_key(spark, sf):
    return table(spark, sf, "samples").groupBy(L.pair_key(F.col("src_lang"), F.col("tgt_lang")).alias("pair")).agg(F.count("*").alias("n"))


@query(f"select sample_id, len({_TOKENS.format('source_text')}) as n, md5(array_to_string({_TOKENS.format('source_text')}, ' ')) as key from {_ROWS}")
def tokens_and_key(spark, sf):
    t = L.tokens(F.col("source_text"))
    return corpus(spark, sf).select("sample_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("key"))


@query(f"""select sample_id, case when len(w) >= 3 then len(list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] for i in range(1, len(w) - 1)])) when len(w) > 0 then 1 else 0 end as n
  from (select sample_id, {_TOKENS.format('source_text')} as w from {_ROWS})""")
def shingle_count(spark, sf):
    return corpus(spark, sf).select("sample_id", F.size(L.shingles(L.tokens(F.col("source_text")))).alias("n"))


_BUCKET = "case when {0} < 15 then 'len_0_15' when {0} < 40 then 'len_15_40' when {0} < 80 then 'len_40_80' else 'len_80_999999' end"


@query(f"""select {_BUCKET.format('l')} as length_bucket, count(*) as n from (select coalesce(len({_TOKENS.format('source_text')}), 0) as l from {_ROWS}) group by 1""")
def length_bucket(spark, sf):
    words = F.coalesce(F.size(L.tokens(F.col("source_text"))), F.lit(0))
    return corpus(spark, sf).groupBy(L.length_bucket(words).alias("length_bucket")).agg(F.count("*").alias("n"))


_DOC = "case when document_id is null or document_id = '' then 'sample:' || sample_id else 'src' || coalesce(source_id::varchar, 'None') || ':' || split_part(document_id, ':', 1) end"


@query(f"select {_DOC} as document, count(*) as n from {_META} group by 1 having count(*) > 1")
def document_sizes(spark, sf):
    key = L.document_key(F.col("document_id"), F.col("sample_id"), F.col("source_id"))
    return metadata(spark, sf).groupBy(key.alias("document")).agg(F.count("*").alias("n")).filter("n > 1")


@query()
def feature_flags(spark, sf):
    """Content flags by pair; the units and acronyms of other scripts need Unicode word borders that the SQL engine lacks."""
    f = S.features(corpus(spark, sf))
    return f.groupBy("pair").agg(*[F.count_if(c).alias(c) for c in ("has_math", "has_numbers_units", "has_acronyms", "has_mixed_script")], F.count("*").alias("n"))


_UNITS = "\\b\\d+(\\.\\d+)?\\s*(" + L.UNITS["en"] + ")\\b"


@query(f"""select sample_id, regexp_matches(source_text, '{L.MATH}') as has_math, regexp_matches(source_text, '(?i){_UNITS}') or regexp_matches(source_text, '{L.STATISTICS}') as has_numbers_units,
  regexp_matches(source_text, '{L.ACRONYM["en"]}') as has_acronyms, {_TAG.format("tgt_lang")} in ('ru', 'fa', 'ar') and (
    regexp_matches(source_text, case {_TAG.format("tgt_lang")} when 'ru' then '[\\x{{400}}-\\x{{4ff}}]' else '[\\x{{600}}-\\x{{6ff}}\\x{{750}}-\\x{{77f}}\\x{{fb50}}-\\x{{fdff}}\\x{{fe70}}-\\x{{feff}}]' end)
    or regexp_matches(target_text, '[A-Za-z\\x{{c0}}-\\x{{24f}}]')) as has_mixed_script
  from {_ROWS} where {_TAG.format("src_lang")} = 'en' and source_text is not null and target_text is not null""")
def feature_flags_en(spark, sf):
    """Content flags of the rows from English."""
    rows = corpus(spark, sf).filter((L.language_tag(F.col("src_lang")) == "en") & F.col("source_text").isNotNull() & F.col("target_text").isNotNull())
    return S.features(rows).select("sample_id", "has_math", "has_numbers_units", "has_acronyms", "has_mixed_script")


_FOLDED = f"case when lang in ('fa', 'ar') then regexp_replace(translate(text, '{L.ARABIC_FROM}', '{L.ARABIC_TO}'), '[\\x{{64b}}-\\x{{652}}\\x{{670}}\\x{{640}}\\x{{200c}}-\\x{{200f}}]', '', 'g') when lang = 'ru' then translate(text, 'ёЁ', 'еЕ') else text end"


@query(f"""with t as (select sample_id, {_TAG.format("src_lang")} as lang, source_text as text from {_ROWS} where source_text is not null)
  select sample_id, md5(array_to_string({_TOKENS.format(_FOLDED)}, ' ')) as key from t""")
def folded_keys(spark, sf):
    """Keys of the sources with the spellings of their language made one."""
    rows = corpus(spark, sf).filter("source_text is not null")
    return rows.select("sample_id", F.md5(L.text_key(L.folded(F.col("source_text"), L.language_tag(F.col("src_lang")))).cast("binary")).alias("key"))


_PAIRED = f"(select sample_id, {_TAG.format('src_lang')} || '-' || {_TAG.format('tgt_lang')} as pair, {_TOKENS.format('source_text')} as w from {_ROWS})"
_SCORES = f"""with r as {_PAIRED}, e as (select sample_id, pair, unnest(w) as token from r), d as (select pair, token from (select distinct sample_id, pair, token from e) group by all having count(*) <= 2),
  h as (select sample_id, count(*) as c from e join d using (pair, token) group by 1), s as (select r.sample_id, r.pair, case when len(w) > 0 then coalesce(c, 0) / len(w) else 0.0 end as score from r left join h using (sample_id))"""


def _rare(spark, sf):
    rows = corpus(spark, sf).select("sample_id", "source_text", L.pair_key(F.col("src_lang"), F.col("tgt_lang")).alias("pair"))
    return S.rare_scores(rows)


@query(_SCORES + " select sample_id, pair, round(score, 6) as rare_term_score from s")
def rare_terms(spark, sf):
    return _rare(spark, sf).withColumn("rare_term_score", F.round("rare_term_score", 6))


@query(_SCORES + """ select pair, round(max(score), 6) as threshold from (select pair, score, row_number() over (partition by pair order by score) as k, count(*) over (partition by pair) as n from s)
  where k = least(n - 1, floor(n * 0.9)) + 1 group by pair""")
def rare_threshold(spark, sf):
    return S.rare_thresholds(_rare(spark, sf)).withColumn("threshold", F.round("threshold", 6))


@query()
def dedup_language_aware(spark, sf):
    """First rows of equal language-aware keys; NFKC has no SQL counterpart."""
    return S.dedup_language_aware(corpus(spark, sf)).select("sample_id")


@query(f"""select min(sample_id) as sample_id from (select sample_id, {_TAG.format('src_lang')} || '-' || {_TAG.format('tgt_lang')} as pair, array_to_string({_TOKENS.format('source_text')}, ' ') as key from {_ROWS})
  where key <> '' group by pair, key""")
def dedup_exact(spark, sf):
    return S.dedup_exact(corpus(spark, sf)).select("sample_id")


@query()
def dedup_minhash(spark, sf):
    """Rows that survive greedy near-duplicate removal within their pair (five-word shingles, overlap 0.8)."""
    rows = corpus(spark, sf).select("sample_id", "source_text", L.pair_key(F.col("src_lang"), F.col("tgt_lang")).alias("pair"))
    links = S.minhash_links(rows, "sample_id", F.col("source_text"), F.col("pair"), threshold=0.8, n=5)
    return S.keep_unlinked(rows.select(F.col("sample_id").alias("id")), links).withColumnRenamed("id", "sample_id")


@query("""with w as {pairs}, s as (select sample_id, pair, list_sort(list_distinct(case when len(w) >= 5 then [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from w),
  c as (select min(sample_id) as rep, pair, s from s where len(s) > 0 group by pair, s), e as (select rep, pair, len(s) as n, unnest(s) as k from c),
  p as (select x.rep as a, y.rep as b, count(*) as i, any_value(x.n) as nx, any_value(y.n) as ny from e x join e y on x.pair = y.pair and x.k = y.k and x.rep < y.rep group by 1, 2)
  select a, b, round(i / (nx + ny - i), 6) as jaccard from p where i / (nx + ny - i) >= 0.8 union all select c.rep, s.sample_id, 1.0 from s join c using (pair, s) where s.sample_id <> c.rep""".format(pairs=f"(select sample_id, {_TAG.format('src_lang')} || '-' || {_TAG.format('tgt_lang')} as pair, {_TOKENS.format('source_text')} as w from {_ROWS})"))
def minhash_links(spark, sf):
    """Near-duplicate links within pairs: every row to its class's first, and between classes."""
    rows = corpus(spark, sf).select("sample_id", "source_text", L.pair_key(F.col("src_lang"), F.col("tgt_lang")).alias("pair"))
    return S.minhash_links(rows, "sample_id", F.col("source_text"), F.col("pair"), threshold=0.8, n=5).withColumn("jaccard", F.round("jaccard", 6))


_RATIO = "count(*) filter (a >= 20 and b > 0 and greatest(a / b, b / a) > {})"
_SIZES = f"(select *, length({_strip('source_text')}) as a, length({_strip('target_text')}) as b from {_ROWS})"
_SQUEEZE = "lower(regexp_replace(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))"


@query()
def quality_rules(spark, sf):
    """Rule hits by batch and pair; equality of the sides is judged after NFKC, which SQL lacks."""
    return Q.rule_counts(corpus(spark, sf).withColumn("pair", L.pair_key(F.col("src_lang"), F.col("tgt_lang"))), ["batch_id", "pair"])


_LETTERS = "length(regexp_replace(coalesce(target_text, ''), '[^{}]', '', 'g'))"


@query(f"""select batch_id, count(*) filter (l >= 8 and own < 0.2 * l and latin > 0.5 * l) as untranslated, count(*) as judged from (
    select batch_id, {_LETTERS.format("\\p{L}")} as l, {_LETTERS.format("\\p{Latin}")} as latin, case {_TAG.format("tgt_lang")} when 'ru' then {_LETTERS.format("\\x{400}-\\x{4ff}")} else {_LETTERS.format("\\x{600}-\\x{6ff}\\x{750}-\\x{77f}\\x{fb50}-\\x{fdff}\\x{fe70}-\\x{feff}")} end as own
    from {_ROWS} where {_TAG.format("tgt_lang")} in ('ru', 'fa', 'ar')) group by 1""")
def untranslated_targets(spark, sf):
    """Targets in Latin script where their language has another, by batch."""
    hit = Q.untranslated(F.coalesce("target_text", F.lit("")), L.language_tag(F.col("tgt_lang")))
    return corpus(spark, sf).withColumn("hit", hit).filter("hit is not null").groupBy("batch_id").agg(F.count_if("hit").alias("untranslated"), F.count("*").alias("judged"))


@query(f"select batch_id, {_RATIO.format(2.5)} as over_2_5, {_RATIO.format(3.0)} as over_3, {_RATIO.format(4.0)} as over_4 from {_SIZES} group by 1")
def length_ratio(spark, sf):
    s, t = F.col("source_text"), F.col("target_text")
    return corpus(spark, sf).groupBy("batch_id").agg(*[F.count_if(Q.length_ratio_over(s, t, x)).alias(n) for x, n in ((2.5, "over_2_5"), (3.0, "over_3"), (4.0, "over_4"))])


@query(f"""with d as (select doc_id, {_TOKENS.format('text')} as w from documents), g as (select doc_id, unnest([array_to_string(w[i:i+5], ' ') for i in range(1, len(w) - 4)]) as phrase from d where len(w) >= 8),
  c as (select doc_id, phrase, count(*) as times from g group by all having count(*) >= 3)
  select doc_id, times, phrase from (select *, row_number() over (partition by doc_id order by times desc, phrase) as k from c) where k = 1""")
def loop_documents(spark, sf):
    """Documents that repeat a six-word phrase at least three times."""
    return Q.loops(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query(f"select sample_id from {_ROWS} where source_text ilike '%surgery%' order by 1 limit 20")
def rule_examples(spark, sf):
    return Q.examples(corpus(spark, sf), F.col("source_text").ilike("%surgery%"), 20).select("sample_id")


_DUP = f"""select '{{0}}' as grouping, sum(copies - 1)::BIGINT as redundant, count(*) as groups, count(*) filter (batches > 1) as cross_batch_groups,
  coalesce(sum(copies - 1) filter (batches > 1), 0)::BIGINT as cross_batch_redundant, max(copies) as max_copies
  from (select count(*) as copies, count(distinct batch_id) as batches from (select *, {_TAG.format('src_lang')} || '-' || {_TAG.format('tgt_lang')} as pair, coalesce(source_text, '') as s, coalesce(target_text, '') as t from {_ROWS}) group by {{1}} having count(*) > 1)"""


@query(" union all ".join(_DUP.format(a, b) for a, b in (("source_in_pair", "pair, s"), ("source_any_pair", "s"), ("pair_in_pair", "pair, s, t"))))
def duplicate_report(spark, sf):
    return Q.duplicate_report(corpus(spark, sf))


@query(f"""with t as (select sample_id, {_strip("coalesce(source_text, '')")} as s, {_strip("coalesce(target_text, '')")} as t, quality from {_ROWS}),
  w as (select *, string_split(s, ' ') as w, greatest(length(s), 1) as z from t)
  select sample_id, round((0.22 * greatest(0, least(1, 1 - abs(length(s) - 90) / 200)) + 0.14 * (len(w) between 4 and 60)::int + 0.20 * case when length(t) > 0 then greatest(0, least(1, 1 - abs(log2(length(t) / z)))) else 0 end
    + 0.14 * length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) / z + 0.10 * least(1, len(list_distinct(string_split(lower(s), ' '))) / greatest(len(w), 1)) + 0.08 * regexp_matches(s, '[.!?۔؟]$')::int
    + 0.12 * greatest(0, least(1, coalesce(quality, 0.5)))) * case when regexp_matches(s, 'https?://|www\\.') or regexp_matches(t, 'https?://|www\\.') or regexp_matches(s, '[<>{{}}|\\\\]') then 0 else 1 end
    + ({_h("sample_id")} % 1000000) / 1e9, 6) as score from w""")
def heuristic_scores(spark, sf):
    """Fitness of every row as an evaluation row."""
    return corpus(spark, sf).select("sample_id", F.round(S.heuristic_score(), 6).alias("score"))


@query()
def heuristic_select(spark, sf):
    """The 200 best rows over strata; scores are compared as rounded integers, which the two engines round apart in a few rows."""
    return S.heuristic_select(corpus(spark, sf), 200)


@query(f"select id as sample_id from samples where allocation = 'TRAINABLE' order by {_h('id')}, id limit 200")
def random_select(spark, sf):
    s = table(spark, sf, "samples").filter("allocation = 'TRAINABLE'").select(F.col("id").alias("sample_id"))
    return S.random_select(s, 200)


@query(f"""select m.sample_id, s.batch_id, m.evaluation_split from samples s join dataset_reservation_samples m on m.sample_id = s.id where s.allocation = 'RESERVED_EVALUATION' order by {_h('m.sample_id', '7')}, m.sample_id, m.id limit 100""")
def eval_set_sample(spark, sf):
    """An evaluation set: reserved samples with their membership, 100 of them by hash."""
    s = table(spark, sf, "samples").filter(F.col("allocation") == RESERVED).select(F.col("id").alias("sample_id"), "batch_id")
    m = table(spark, sf, "dataset_reservation_samples").select("id", "sample_id", "evaluation_split")
    return s.join(m, "sample_id").withColumn("h", portable_hash(F.col("sample_id"), "7")).orderBy("h", "sample_id", "id").limit(100).select("sample_id", "batch_id", "evaluation_split")


@query(f"""select sample_id, batch_id, reservation_id, evaluation_split from (select c.sample_id, c.batch_id, m.reservation_id, m.evaluation_split, row_number() over (order by {_h('c.sample_id')}, c.sample_id, m.reservation_id) as k
  from {_META} c join dataset_reservation_samples m on m.sample_id = c.sample_id where c.sample_id in (select id from samples where allocation = 'RESERVED_EVALUATION') and m.evaluation_split in ('test') and c.quality >= 0.5) where k <= 60""")
def evaluation_set_rows(spark, sf):
    """Sixty reserved test rows of good quality with their memberships."""
    f = D.Filters(evaluation_split=["test"], min_quality=0.5)
    return V.rows(metadata(spark, sf), registry(spark, sf), table(spark, sf, "dataset_reservation_samples"), f, limit=60).select("sample_id", "batch_id", "reservation_id", "evaluation_split")


@query()
def eval_item_vectors(spark, sf):
    """Documents whose hashed n-gram vector is near an evaluation item's."""
    items = E.embedded(table(spark, sf, "eval_items"), "item_id", "text").select(F.col("item_id").alias("id"), "v")
    return C.similar(E.embedded(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", "v", items, 0.8)


_GATE = f"""with d as (select doc_id, {_TOKENS.format('text')} as w from documents), e as (select item_id, {_TOKENS.format('text')} as w from eval_items),
  ds as (select distinct doc_id, unnest(case when len(w) >= 3 then [w[i] || ' ' || w[i+1] || ' ' || w[i+2] for i in range(1, len(w) - 1)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
  es as (select distinct item_id, unnest(case when len(w) >= 3 then [w[i] || ' ' || w[i+1] || ' ' || w[i+2] for i in range(1, len(w) - 1)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from e)"""


@query(_GATE + " select doc_id, count(*) as shared from ds where s in (select s from es) group by 1 having count(*) >= 2")
def shingle_gate_union(spark, sf):
    return C.union_gate(table(spark, sf, "documents"), "doc_id", F.col("text"), table(spark, sf, "eval_items"), F.col("text"), 2)


@query(_GATE + " select doc_id, max(c) as best from (select doc_id, item_id, count(*) as c from ds join es using (s) group by all) group by 1 having max(c) >= 2")
def shingle_gate_same_row(spark, sf):
    return C.same_row_gate(table(spark, sf, "documents"), "doc_id", F.col("text"), table(spark, sf, "eval_items"), "item_id", F.col("text"), 2)


@query()
def scan_full_corpus(spark, sf):
    """All rows against the reserved ones, first reason; two three-word shingles of one reserved row admit to the cosine."""
    rows = corpus(spark, sf)
    reserved = D.allocated(rows, registry(spark, sf), RESERVED)
    return C.scan(rows, reserved, "pair")


_KEY = "array_to_string(" + _TOKENS + ", ' ')"


@query(f"""with r as (select *, {_TAG.format('src_lang')} || '-' || {_TAG.format('tgt_lang')} as g, {_KEY.format('source_text')} as s, {_KEY.format('target_text')} as t, {_DOC} as d from {_ROWS}),
  v as (select * from r where sample_id in (select id from samples where allocation = 'RESERVED_EVALUATION')), o as (select * from r where sample_id not in (select sample_id from v))
  select sample_id, case when t in (select t from v where t <> '') then 'exact_target' when (g, s) in (select g, s from v where s <> '') then 'exact_source' else 'held_document' end as reason from o
  where t in (select t from v where t <> '') or (g, s) in (select g, s from v where s <> '') or (g, d) in (select g, d from v)""")
def exact_and_document_hits(spark, sf):
    """The exact part of the scan."""
    rows = corpus(spark, sf)
    return C.scan(rows, D.allocated(rows, registry(spark, sf), RESERVED), "pair", None)


@query("""select a.vec_id as id, round(max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) as cosine from embeddings a join embeddings b on b.vec_id % 50 = 0 and a.vec_id <> b.vec_id
  group by 1 having max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) >= 0.3""")
def embedding_nearest(spark, sf):
    """Every vector with its nearest one of the stated query set (every id divisible by 50)."""
    e = table(spark, sf, "embeddings")
    ref = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return C.similar(e, "vec_id", "embedding", ref, 0.3).select("id", F.round("cosine", 4).alias("cosine"))


@query("""select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) as cosine
  from embeddings a join embeddings b on a.vec_id < b.vec_id where list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) >= 0.45""")
def embedding_links(spark, sf):
    """Pairs with a cosine of at least 0.45 that share a hyperplane code in some table (0.5 % of such pairs may not)."""
    return S.embedding_links(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.45).withColumn("cosine", F.round("cosine", 4))


@query()
def kcenter(spark, sf):
    """Five farthest-first vectors of each label."""
    return S.k_center(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 5)


@query("""with s as (select id, row_number() over (order by id) as k, count(*) over () as n from samples where reserved_at is not null and batch_id <= 12)
  select 'snapshot' as snapshot_id, max(n) as n, md5(string_agg(id::varchar, ',' order by id)) as digest from s where k <= 100""")
def historical_contamination(spark, sf):
    """How many rows of a snapshot are reserved now, and the first hundred of them: a report."""
    s = table(spark, sf, "samples")
    snap = s.filter("batch_id <= 12").select(F.lit("snapshot").alias("snapshot_id"), F.col("id").alias("sample_id"))
    got = A.historical_overlap(snap, s.filter("reserved_at is not null").select(F.col("id").alias("sample_id")), 100)
    return got.select("snapshot_id", "n", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")).alias("digest"))


@query("select r.batch_id, coalesce(s.allocation, 'MISSING') as allocation, r.allocation as stored, count(*) as n from (select distinct sample_id, batch_id, allocation from corpus_rows) r left join samples s on s.id = r.sample_id group by all")
def stale_allocation(spark, sf):
    """Allocation stored at import against the current one."""
    r = table(spark, sf, "corpus_rows").select("sample_id", "batch_id", "allocation").distinct().withColumn("stored", F.col("allocation"))
    return D.with_allocation(r, registry(spark, sf)).groupBy("batch_id", "allocation", "stored").agg(F.count("*").alias("n"))


@query("select distinct s.batch_id, m.reservation_id, r.dataset_id from dataset_reservation_samples m join samples s on s.id = m.sample_id join dataset_reservations r on r.id = m.reservation_id")
def purge_dependencies(spark, sf):
    return A.purge_blockers(table(spark, sf, "dataset_reservation_samples"), table(spark, sf, "samples"), table(spark, sf, "dataset_reservations"))


@query("select s.batch_id, count(*) as n from annotations a join samples s on s.id = a.sample_id group by 1")
def batch_annotations(spark, sf):
    return A.batch_annotations(table(spark, sf, "annotations"), table(spark, sf, "samples"))


_WANT = "case when m.evaluation_split is null then 'TRAINABLE' when m.human_verify then 'IGNORED' else 'RESERVED_EVALUATION' end"


@query(f"""with q as (select sample_id, max({_WANT}) as wanted from dataset_reservation_samples m group by 1), t as (select s.*, case when wanted is null then allocation
    when wanted = 'TRAINABLE' then case when quarantined_at is not null then 'QUARANTINED' when reserved_at is not null then 'RESERVED_EVALUATION' else 'TRAINABLE' end
    when wanted = 'RESERVED_EVALUATION' and quarantined_at is not null then 'QUARANTINED' else wanted end as state from samples s left join q on q.sample_id = s.id)
  select id, state as allocation, coalesce(reserved_at, case when state = 'RESERVED_EVALUATION' then timestamp '2026-01-01' end) as reserved_at,
    coalesce(quarantined_at, case when state = 'QUARANTINED' then timestamp '2026-01-01' end) as quarantined_at from t""")
def allocation_transition(spark, sf):
    """Next states under requests derived from the memberships."""
    m = table(spark, sf, "dataset_reservation_samples")
    wanted = F.when(F.col("evaluation_split").isNull(), "TRAINABLE").when(F.col("human_verify"), "IGNORED").otherwise(RESERVED)
    q = m.groupBy("sample_id").agg(F.max(wanted).alias("wanted")).withColumn("at", F.to_timestamp_ntz(F.lit("2026-01-01 00:00:00")))
    return A.transition(table(spark, sf, "samples"), q)


@query("""with a as (select sample_id, arg_max(ignored, (created_at, id)) filter (ignored is not null) as ignored, arg_max(quality, (created_at, id)) filter (quality is not null) as q from annotations where sample_id is not null group by 1)
  select s.id, case when a.ignored then 'IGNORED' when a.ignored = false and s.allocation = 'IGNORED' then case when quarantined_at is not null then 'QUARANTINED' when reserved_at is not null then 'RESERVED_EVALUATION' else 'TRAINABLE' end else s.allocation end as allocation,
    coalesce(a.q, s.quality) as quality from samples s left join a on a.sample_id = s.id""")
def annotation_effect(spark, sf):
    return A.annotated(table(spark, sf, "samples"), table(spark, sf, "annotations"))


@query("""with r as (select applied_at from dataset_reservations where id = 1), m as (select distinct sample_id from dataset_reservation_samples where reservation_id = 1)
  select s.id, case when (m.sample_id is not null and s.reserved_at = r.applied_at and s.allocation = 'RESERVED_EVALUATION') or (s.quarantined_at = r.applied_at and s.allocation = 'QUARANTINED') then 'TRAINABLE' else s.allocation end as allocation,
    case when m.sample_id is not null and s.reserved_at = r.applied_at then null else s.reserved_at end as reserved_at, case when s.quarantined_at = r.applied_at then null else s.quarantined_at end as quarantined_at
  from samples s cross join r left join m on m.sample_id = s.id""")
def revert_rows(spark, sf):
    """Samples after reservation run 1 is taken back."""
    at = table(spark, sf, "dataset_reservations").filter("id = 1").select("applied_at").first()[0]
    m = table(spark, sf, "dataset_reservation_samples").filter("reservation_id = 1")
    return A.reverted(table(spark, sf, "samples"), m, F.lit(at).cast("timestamp_ntz"))


@query(f"""select sample_id, case when k <= round_even(n * 0.5, 0) then 'dev' else 'test' end as evaluation_split from (
  select id as sample_id, row_number() over (partition by src_lang, tgt_lang, domain order by {_h('id', '42-split')}, id) as k, count(*) over (partition by src_lang, tgt_lang, domain) as n from samples where allocation = 'RESERVED_EVALUATION')""")
def dev_test_split(spark, sf):
    s = table(spark, sf, "samples").filter(F.col("allocation") == RESERVED).withColumnRenamed("id", "sample_id")
    return S.dev_test(s, ["src_lang", "tgt_lang", "domain"])


@query(f"""with s as (select * from samples where allocation = 'RESERVED_EVALUATION'), c as (select count(*) as n from (select distinct tgt_lang, domain from s))
  select id as sample_id from (select id, {_h('id', '42-gold')} as h, row_number() over (partition by tgt_lang, domain order by {_h('id', '42-gold')}, id) as k from s), c where k <= greatest(1, 120 // n) order by h, id limit 120""")
def gold_subset(spark, sf):
    s = table(spark, sf, "samples").filter(F.col("allocation") == RESERVED).withColumnRenamed("id", "sample_id")
    return S.gold(s, ["tgt_lang", "domain"])


@query("""with m as (select distinct reservation_id, sample_id from dataset_reservation_samples),
  r as (select reservation_id, sample_id // 1000 as r, sha256(string_agg(sample_id::varchar, ',' order by sample_id)) as d, count(*) as n from m group by 1, 2)
  select reservation_id, sha256(string_agg(d, ',' order by r)) as digest, sum(n)::BIGINT as n from r group by 1""")
def id_digest(spark, sf):
    """Digests of the members of each run, by ranges of a thousand ids."""
    return D.id_digest(table(spark, sf, "dataset_reservation_samples").select("reservation_id", "sample_id").distinct(), ["reservation_id"], span=1000)


@query("select evaluation_split, human_verify, count(*) as n from dataset_reservation_samples group by all")
def member_counts(spark, sf):
    return table(spark, sf, "dataset_reservation_samples").groupBy("evaluation_split", "human_verify").agg(F.count("*").alias("n"))


@query()
def quota_targets(spark, sf):
    """Quotas of 1,000 rows over (pair, domain, bucket); the arithmetic is on the driver, over counts of cells."""
    cells = S.cells_of(S.features(corpus(spark, sf)).select("pair", "domain", "length_bucket")).collect()  # one row a cell
    quotas = S.cell_quotas({(r.pair, r.domain, r.length_bucket): r.n for r in cells}, 1000)
    return spark.createDataFrame([(*k, v) for k, v in sorted(quotas.items())], "pair string, domain string, length_bucket string, quota long")


@query()
def candidate_documents(spark, sf):
    """Documents that a reservation may draw from: of 50,000 candidates those of most value per row, each pair within 1 % of its corpus rows."""
    rows = corpus(spark, sf)
    pool = cut(S.features(S.random_select(rows, PL.DEFAULT["candidates"]["limit"])).withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), F.lit("unknown"))), "documents")
    return PL.held_documents(pool, rows, PL.DEFAULT)[0]


def _reservation(spark, sf):
    return PL.reserve_dataset(corpus(spark, sf), registry(spark, sf), D.Filters(), None, {})


@query()
def reservation_members(spark, sf):
    """A reservation of 2 % of the trainable rows, 5,000 at most: members with split and review flag."""
    return _reservation(spark, sf).members


@query()
def reservation_states(spark, sf):
    """Allocations after that reservation, counted."""
    return PL.allocation_after(registry(spark, sf), _reservation(spark, sf)).groupBy("allocation").agg(F.count("*").alias("n"))


# Reads, writes, imports, states and pages.


def _round_trip(spark, sf, fmt: str):
    """Documents with text, written as an upload in *fmt* and read back by the reader of that format."""
    path = f"{fresh_path(spark, 'round-trip')}.{fmt}"
    rows = table(spark, sf, "documents").filter("text is not null and text <> '' and lang is not null")
    W.export(rows, path, fmt, ["doc_id", "text", "lang"])
    return R.read_any(spark, path, fmt).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text"), "lang")


_TRIP = "select doc_id, md5(text) as text, lang from documents where text is not null and text <> '' and lang is not null"


@query(_TRIP)
def jsonl_round_trip(spark, sf):
    return _round_trip(spark, sf, "jsonl")


@query(_TRIP)
def parquet_round_trip(spark, sf):
    return _round_trip(spark, sf, "parquet")


@query("select id, name, kind, description from sources")
def csv_round_trip(spark, sf):
    """Sources as CSV: all columns come back as text, empty ones as null."""
    path = f"{fresh_path(spark, 'round-trip')}.csv"
    W.export(table(spark, sf, "sources"), path, "csv", ["id", "name", "kind", "description"])
    return R.read_any(spark, path, "csv").withColumn("id", F.col("id").cast("int"))


@query("select id, sample_id, author from annotations")
def tsv_round_trip(spark, sf):
    path = f"{fresh_path(spark, 'round-trip')}.tsv"
    W.export(table(spark, sf, "annotations"), path, "tsv", ["id", "sample_id", "author"])
    return R.read_any(spark, path, "tsv").select(F.col("id").cast("long").alias("id"), F.col("sample_id").cast("long").alias("sample_id"), "author")


@query("select source, count(*) as n, count(distinct doc_id) as docs from documents group by 1")
def shards_round_trip(spark, sf):
    """Documents as shards of at most 2 MB, read back."""
    path = fresh_path(spark, "shards")
    W.write_shards(table(spark, sf, "documents"), path, 2_000_000)
    return R.read_parquet(spark, [path]).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"""select case when b < 0.9 then 'train' when b < 0.95 then 'validation' else 'test' end as split, count(*) as n from (select ({_h('id')} % 1000000) / 1e6 as b from samples where allocation = 'TRAINABLE') group by 1""")
def snapshot_counts(spark, sf):
    """Counts in the manifest of a snapshot of the trainable samples."""
    rows = table(spark, sf, "samples").filter("allocation = 'TRAINABLE'").select(F.col("id").alias("sample_id"), "batch_id")
    counts = W.write_snapshot(rows, fresh_path(spark, "snapshot"), {"name": "trainable"})["counts"]
    return spark.createDataFrame([(k, v) for k, v in counts.items() if v], "split string, n long")


@query(f"""select 9 as batch_id, source as document_id, lang as src_lang, 'en' as tgt_lang, {_strip('text')} as source_text, doc_type as target_text, n_chars::DOUBLE as quality
  from documents where length({_strip("coalesce(text, '')")}) > 0 and length(doc_type) > 0""")
def canonical_import(spark, sf):
    """Documents projected onto the canonical schema: mapped columns as they are, texts stripped, rows without text dropped."""
    m = I.Mapping("text", "doc_type", src_lang="lang", quality="n_chars", document_id="source", meta_columns=["batch_id", "no such column"])
    rows = I.normalize(table(spark, sf, "documents"), m, 9, 1, "xx", "en")
    return rows.select("batch_id", "document_id", "src_lang", "tgt_lang", "source_text", "target_text", "quality")


@query("""select id as sample_id, case when r then 'RESERVED_EVALUATION' when q then 'QUARANTINED' else 'TRAINABLE' end as allocation, case when r then case when d then 'dev' else 'test' end end as evaluation_split, r and g as human_verify
  from (select id, id in (select sample_id from dataset_reservation_samples) as r, quality < 0.2 and quality is not null as q, id in (select sample_id from dataset_reservation_samples where evaluation_split = 'dev') as d,
    id in (select sample_id from dataset_reservation_samples where human_verify) as g from samples)""")
def imported_states(spark, sf):
    """Allocation, split and review flag that an import gives, from the sets of ids that were reserved and quarantined."""
    m, s = table(spark, sf, "dataset_reservation_samples"), table(spark, sf, "samples").select(F.col("id").alias("sample_id"), "quality")
    return A.imported(s, m, s.filter("quality < 0.2"), m.filter("evaluation_split = 'dev'"), m.filter("human_verify")).drop("quality")


@query("""select id, case when hit then 'RESERVED_EVALUATION' else allocation end as allocation, case when hit then timestamp '2026-01-01' else reserved_at end as reserved_at, quarantined_at
  from (select *, allocation = 'TRAINABLE' and id in (select sample_id from annotations) as hit from samples)""")
def applied_states(spark, sf):
    """Samples after a run has reserved those with annotations: only trainable ones change, with a stamp."""
    chosen = table(spark, sf, "annotations").select("sample_id", F.lit(RESERVED).alias("to"), F.to_timestamp_ntz(F.lit("2026-01-01 00:00:00")).alias("at")).filter("sample_id is not null").distinct()
    return A.applied(table(spark, sf, "samples"), chosen)


@query("select id, case when status = 'ignored' then 'IGNORED' else 'TRAINABLE' end as allocation from batches")
def migrated_states(spark, sf):
    return table(spark, sf, "batches").select("id", A.migrated(F.col("status")).alias("allocation"))


@query("select id, case when id = 3 and status in ('ready', 'rejected') then 'rejected' else status end as status from batches")
def rejected_batch(spark, sf):
    """Batches after one of them is rejected."""
    return V.batch_status(table(spark, sf, "batches"), 3, "rejected").select("id", "status")


@query(f"select sample_id, batch_id from {_META} where quality >= 0.5 and {_TRAINABLE} order by sample_id limit 50 offset 100")
def search_page(spark, sf):
    """The third page of the trainable rows of good quality."""
    return D.search(metadata(spark, sf), registry(spark, sf), D.Filters(min_quality=0.5), limit=50, offset=100).select("sample_id", "batch_id")


@query("select id, allocation from samples where quality <= 0.4 order by id limit 20 offset 40")
def metadata_page(spark, sf):
    """A page of sample metadata."""
    return V.page(table(spark, sf, "samples"), D.Filters(max_quality=0.4), 20, 40)[1].select("id", "allocation")


@query(f"select sample_id, batch_id from {_META} where sample_id = (select min(sample_id) from corpus_rows)")
def point_lookup(spark, sf):
    first = table(spark, sf, "corpus_rows").agg(F.min("sample_id")).first()[0]
    return D.point(metadata(spark, sf), first).select("sample_id", "batch_id")


@query(f"""select pair, domain, length_bucket, count(*) as n from (select {_TAG.format('src_lang')} || '-' || {_TAG.format('tgt_lang')} as pair, coalesce(nullif(domain, ''), 'unknown') as domain,
  {_BUCKET.format("coalesce(len(" + _TOKENS.format('source_text') + "), 0)")} as length_bucket from {_ROWS}) group by all""")
def cell_counts(spark, sf):
    """Rows of each (pair, domain, bucket)."""
    return S.cells_of(S.features(corpus(spark, sf)))


# Scans and aggregates over the star schema.


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n
  from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark, sf):
    l = table(spark, sf, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""select n_name, count(distinct c_custkey) as customers, count(o_orderkey) as orders, round(sum(o_totalprice), 2) as total from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1""")
def orders_by_nation(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("t"))
    c = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    per = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("k").alias("orders"), F.sum("t").alias("total"))
    n = table(spark, sf, "nation").join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("orders", F.lit(0)).alias("orders"), F.round("total", 2).alias("total"))
