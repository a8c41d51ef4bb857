"""Measured text-quality rules and the duplicate report.

A rule that cannot judge a language pair gives null, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import language as L

RATIO_LIMITS = (2.5, 3.0, 4.0)
LOOP_WORDS, LOOP_TIMES = 6, 3


def length_ratio_over(source: Column, target: Column, limit: float) -> Column:
    """Texts of very different length; sources under 20 characters and empty targets are not judged."""
    a, b = F.length(L.strip(source)), F.length(L.strip(target))
    return F.coalesce((a >= 20) & (b > 0) & (F.greatest(F.try_divide(a, b), F.try_divide(b, a)) > limit), F.lit(False))


def copy_of_source(source: Column, target: Column, normalised: bool = True) -> Column:
    """Equal but for case and white space (and compatibility forms)."""
    def key(c: Column) -> Column:
        return F.lower(F.regexp_replace(L.strip(L.nfkc(c) if normalised else c), r"(?U)\s+", " "))

    return F.coalesce((key(source) == key(target)) & (F.length(source) > 0), F.lit(False))


def untranslated(target: Column, tgt: Column) -> Column:
    """Own-script share under 0.2 and Latin share over 0.5 of at least 8 letters; null for languages without a script of their own."""
    letters = F.regexp_count(target, F.lit(r"\p{L}"))
    latin = F.regexp_count(target, F.lit(r"\p{IsLatin}"))
    out = F.lit(None).cast("boolean")
    for tag, script in L.SCRIPTS.items():
        if script != "Latin":
            own = F.regexp_count(target, F.lit(L.SCRIPT_RANGE[script]))
            out = F.when(tgt == tag, (letters >= 8) & (own < 0.2 * letters) & (latin > 0.5 * letters)).otherwise(out)
    return out


def may_loop(words: Column) -> Column:
    """Cheap condition for a loop: enough words, some of them repeated."""
    return (F.size(words) >= LOOP_WORDS + LOOP_TIMES - 1) & (F.size(words) - F.size(F.array_distinct(words)) >= LOOP_TIMES - 1)


def loops(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, times, phrase): texts that say one LOOP_WORDS-word phrase at least LOOP_TIMES times; the most frequent, ties by phrase.

    Counting is within the row (arrays), so nothing is shuffled.
    """
    def order(a: Column, b: Column) -> Column:
        return F.when(a["times"] != b["times"], b["times"] - a["times"]).when(a["phrase"] < b["phrase"], -1).when(a["phrase"] > b["phrase"], 1).otherwise(0)

    def most(g: Column) -> Column:
        # In the sorted phrases a run of equal ones is a phrase's count: the distance between two first places.
        firsts = F.filter(F.sequence(F.lit(1), F.size(g)), lambda i: (i == 1) | (F.element_at(g, i) != F.element_at(g, F.greatest(i - 1, F.lit(1)))))

        def counts(s: Column) -> Column:
            end = lambda k: F.when(k < F.size(s), F.element_at(s, F.least(k + 1, F.size(s)))).otherwise(F.size(g) + 1)
            runs = F.transform(F.sequence(F.lit(1), F.size(s)), lambda k: F.struct((end(k) - F.element_at(s, k)).alias("times"), F.element_at(g, F.element_at(s, k)).alias("phrase")))
            return F.array_sort(F.filter(runs, lambda x: x["times"] >= LOOP_TIMES), order)

        return L.let(firsts, counts)

    looped = L.let(L.tokens(text), lambda w: F.when(may_loop(w), L.let(F.array_sort(L.grams(w, LOOP_WORDS)), most)))
    return rows.select(id_col, F.get(looped, F.lit(0)).alias("b")).filter("b is not null").select(id_col, "b.times", "b.phrase")


def rule_counts(rows: DataFrame, group: list[str]) -> DataFrame:
    """Hits of each rule by group, null where a rule judged no row."""
    src, tgt = F.col("source_text"), F.col("target_text")
    ruled = rows.withColumn("untranslated_target", untranslated(tgt, L.language_tag(F.col("tgt_lang")))).withColumn("copy_of_source", copy_of_source(src, tgt))
    aggs = [F.count("*").alias("n"), F.sum(F.col("untranslated_target").cast("long")).alias("untranslated_target"), F.count_if("copy_of_source").alias("copy_of_source")]
    for x in RATIO_LIMITS:
        aggs.append(F.count_if(length_ratio_over(src, tgt, x)).alias(f"length_ratio_{str(x).replace('.', '_')}"))
    return ruled.groupBy(*group).agg(*aggs)


def examples(rows: DataFrame, rule: Column, k: int, id_col: str = "sample_id") -> DataFrame:
    """The first k hits of a rule by id: a report."""
    return rows.filter(rule).orderBy(id_col).limit(k)


def duplicate_report(rows: DataFrame) -> DataFrame:
    """Redundant rows, groups, groups over batches, their redundant rows, most copies; for three groupings.

    Keys are hashed before the shuffle; groups are counted, never collected.
    """
    pair = L.pair_key(F.col("src_lang"), F.col("tgt_lang"))
    source, both = F.md5(F.coalesce("source_text", F.lit("")).cast("binary")), F.md5(F.concat_ws("\x1f", F.coalesce("source_text", F.lit("")), F.coalesce("target_text", F.lit(""))).cast("binary"))
    kinds = {"source_in_pair": F.concat_ws("|", pair, source), "source_any_pair": source, "pair_in_pair": F.concat_ws("|", pair, both)}
    keyed = rows.select("sample_id", "batch_id", F.explode(F.array(*[F.struct(F.lit(k).alias("grouping"), v.alias("key")) for k, v in kinds.items()])).alias("x")).select("batch_id", "x.*")
    groups = keyed.groupBy("grouping", "key", "batch_id").agg(F.count("*").alias("c")).groupBy("grouping", "key").agg(F.sum("c").alias("copies"), F.count("*").alias("batches")).filter("copies > 1")
    over = F.col("batches") > 1
    return groups.groupBy("grouping").agg(
        F.sum(F.col("copies") - 1).alias("redundant"), F.count("*").alias("groups"), F.count_if(over).alias("cross_batch_groups"),
        F.coalesce(F.sum(F.when(over, F.col("copies") - 1)), F.lit(0)).alias("cross_batch_redundant"), F.max("copies").alias("max_copies"),
    )
