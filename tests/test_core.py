"""Core operators on small rows, and the queries against their SQL."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from textloom import policy
from textloom.functions import language as L
from textloom.hashing import portable_hash
from textloom.operators import allocation as A, contamination as C, dataset as D, ingest as I, pipeline as PL, quality as Q, ranking as R, selection as S
from textloom.schema import CANONICAL, backfilled, empty
from textloom.sources import readers, writers

TEXTS = "sample_id long, src_lang string, tgt_lang string, source_text string, target_text string"


def ids(df, col="sample_id"):
    return sorted(r[col] for r in df.select(col).collect())


def test_empty_relation_and_backfill(spark):
    assert empty(spark).schema == CANONICAL and empty(spark).count() == 0
    df = backfilled(spark.createDataFrame([(1, "x")], "sample_id int, more string"))
    assert df.columns[: len(CANONICAL)] == CANONICAL.names and df.columns[-1] == "more"


def test_tags_and_keys(spark):
    df = spark.createDataFrame([(" EN-us", "fa_IR"), (None, " "), ("de", "")], "a string, b string")
    assert [r[0] for r in df.select(L.pair_key(F.col("a"), F.col("b"))).collect()] == ["en-fa", "und-und", "de-und"]


def test_persian_spellings_collapse(spark):
    rows = [(1, "en", "fa", "a book", "كتاب ١"), (2, "en", "fa", "A book", "کتاب ۱"), (3, "en", "fa", "a  book", "كِتاب ١"), (4, "en", "fa", "a book!", "کتاب １"), (5, "en", "ru", "a book", "ещё"), (6, "en", "ru", "a book", "еще")]
    assert ids(S.dedup_language_aware(spark.createDataFrame(rows, TEXTS))) == [1, 5]


def test_clashing_column_names_and_ties(spark):
    rows = spark.createDataFrame([(1, "en", "de", "a b", "c", 9), (2, "en", "de", "a b", "c", 9), (3, "en", "de", None, None, 9)], TEXTS + ", n int")
    assert ids(S.dedup_exact(rows)) == [1]


@pytest.mark.parametrize("parts", [1, 7])
def test_first_by_hash_is_exact(spark, parts):
    df = spark.range(3000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("g")).withColumn("h", portable_hash(F.col("sample_id"), "x")).repartition(parts)
    got = R.first_by_hash(df, ["g"], "h", ["sample_id"], F.ceil(F.col("n") * 0.1).cast("long"))
    rows = df.collect()
    want = set()
    for g in {r.g for r in rows}:
        own = sorted((r.h, r.sample_id) for r in rows if r.g == g)
        want |= {i for _, i in own[: -(-len(own) // 10)]}
    assert {r.sample_id for r in got.collect()} == want
    assert R.first_by_hash(df.limit(0), ["g"], "h", ["sample_id"], F.lit(3)).count() == 0


def test_reserved_rows_pull_no_replacements(spark):
    rows = spark.range(100).select(F.col("id").alias("sample_id"), F.lit(1).alias("batch_id"))
    all_ = D.compose(rows, D.Filters(), [D.BatchRule(1, "count", 20)])
    registry = spark.range(100).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 2 == 0, "RESERVED_EVALUATION").otherwise("TRAINABLE").alias("allocation"))
    assert set(ids(D.allocated(all_, registry))) == {i for i in ids(all_) if i % 2}


def test_rules_are_checked(spark):
    for bad in (("percent", 0), ("percent", 101), ("count", 1.5), ("count", 0), ("all", 3), ("some", 1)):
        with pytest.raises(ValueError):
            D.BatchRule(1, *bad)
    b = spark.createDataFrame([(1, "ready"), (2, "importing")], "id int, status string")
    D.check_rules([D.BatchRule(1)], b)
    with pytest.raises(ValueError):
        D.check_rules([D.BatchRule(2)], b)
    with pytest.raises(ValueError):
        D.check_rules([D.BatchRule(1), D.BatchRule(1)], b)


def test_budget_and_documents():
    assert S.holdout_budget(6_274_184, 0.01, None) == 62_741 and S.holdout_budget(6_274_184, 0.01, 1000) == 1000 and S.holdout_budget(None, 0.01, None) is None
    chosen, cost = S.choose_documents([("big", "x", 5), ("a", "x", 3), ("b", "x", 3)], {"big": 8051, "a": 40, "b": 40}, 1000)
    assert sorted(chosen) == ["a", "b"] and cost == 80
    assert S.choose_documents([("a", "x", 1), ("absent", "x", 1)], {"a": 40}, None)[1] == 41
    alone = [(f"sample:{i}", "x", 1) for i in range(50)]
    assert len(S.choose_documents(alone, {}, 10, 5)[0]) == 50
    many = [(f"d{d}{i:02}", d, 1.0, 10 if d == "x" else 1) for d in "xy" for i in range(30)]
    got = S.choose_documents(many, {k: 2 for k, *_ in many}, 60, 20)[0]
    assert len(got) == 20 and S.domain_slots({"x": 300, "y": 30}, {"x": 30, "y": 30}, 20) == {"x": 18, "y": 2} and sum(k.startswith("dy") for k in got) == 2
    assert PL.merged_reports({"a": {"budget_rows": 500, "corpus_rows": 5, "estimated_rows": 400, "documents_held": 3, "documents_available": 9, "applied": True}, "b": {"budget_rows": None, "corpus_rows": 5, "estimated_rows": 4, "documents_held": 3, "documents_available": 3, "applied": False}})["budget_rows"] is None


def test_quotas_are_rounded_and_shared():
    assert S.proportional({"p": 10, "q": 10}, 1000) == {"p": 10, "q": 10} and S.proportional({"a": 5, "b": 5, "c": 5}, 10) == {"a": 4, "b": 3, "c": 3}
    assert S.proportional({"a": 1, "b": 3}, 2) == {"a": 0, "b": 2} and S.proportional({}, 5) == {} and S.proportional({"a": 4}, 0) == {"a": 0}
    assert S.flattened({"a": 900, "b": 100}, 100, 0.5, 0) == {"a": 70, "b": 30} and sum(S.flattened({"a": 900, "b": 30, "c": 5}, 100).values()) == 100
    labels = ["len_0_15", "len_15_40", "len_40_80", "len_80_999999"]
    assert S.by_share({"len_0_15": 100, "len_15_40": 100, "len_40_80": 3, "len_80_999999": 0}, labels, [0.2, 0.35, 0.3, 0.15], 20) == {"len_0_15": 7, "len_15_40": 10, "len_40_80": 3, "len_80_999999": 0}
    cells = {("en-de", d, b): n for d, n in (("law", 400), ("sport", 100)) for b in labels}
    q = S.cell_quotas(cells, 100)
    assert sum(q.values()) == 100 and sum(v for (_, d, _), v in q.items() if d == "sport") == 43
    own = policy.validated({"pairs": {"en-de": {"quotas": {"domain_floor": 0, "domain_alpha": 0.0}}}})
    assert sum(v for (_, d, _), v in S.cell_quotas(cells, 100, own).items() if d == "sport") == 20


def test_document_key(spark):
    df = spark.createDataFrame([(3, "book7:chunk12", 1), (3, None, 42), (None, "x:1", 2), (1, "", 5)], "s int, d string, i long")
    got = [r[0] for r in df.select(L.document_key(F.col("d"), F.col("i"), F.col("s"))).collect()]
    assert got == ["src3:book7", "sample:42", "srcNone:x", "sample:5"]


@pytest.mark.parametrize("text, least, want", [("a b c x y z", 2, (True, False)), ("a b c d", 2, (True, True)), ("a b c", 2, (False, False)), ("", 1, (False, False)), (None, 1, (False, False))])
def test_shingle_gates(spark, text, least, want):
    rows = spark.createDataFrame([(1, text)], "id long, t string")
    ref = spark.createDataFrame([(7, "a b c d e" if text == "a b c d" else "a b c"), (8, "x y z")], "r long, t string")
    union = C.union_gate(rows, "id", F.col("t"), ref, F.col("t"), least).count() == 1
    same = C.same_row_gate(rows, "id", F.col("t"), ref, "r", F.col("t"), least).count() == 1
    assert (union, same) == want


def test_keep_unlinked_is_greedy_first(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (5, 7), (6, 7)], "a long, b long")
    assert ids(S.keep_unlinked(spark.range(1, 9), links), "id") == [1, 3, 5, 8]


def test_minhash_links_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank today".split()
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base, "again"])), (4, "something else entirely is written here for once only"), (5, ""), (6, None)]
    got = {(r.a, r.b) for r in S.minhash_links(spark.createDataFrame(rows, "i long, t string"), "i", F.col("t"), F.lit("g"), 0.8, 5).collect()}
    assert got == {(1, 2), (1, 3)}


def test_minhash_links_lose_no_pair(spark, monkeypatch):
    rows = []
    for i in range(4000):
        words = [f"w{i}x{k}" for k in range(10)]
        rows += [(2 * i, " ".join(words[:9])), (2 * i + 1, " ".join(words[1:]))]
    df = spark.createDataFrame(rows, "i long, t string").repartition(4)
    want = {(2 * i, 2 * i + 1) for i in range(4000)}
    assert {(r.a, r.b) for r in S.minhash_links(df, "i", F.col("t"), F.lit("g"), 0.8, 1).collect()} == want
    # Shingles that are all hot: pairs of few, some and many words.
    monkeypatch.setattr(S.P, "HOT_ROWS", 1)
    rng = random.Random(6)
    few = []
    for size in (1, 2, 3, 5, 12, 90, 110):
        words = [f"h{k}" for k in range(size + 3)]
        few += [set(rng.sample(words, size)) for _ in range(8)]
    got = {(r.a, r.b) for r in S.minhash_links(spark.createDataFrame([(i, " ".join(sorted(x))) for i, x in enumerate(few)], "i long, t string"), "i", F.col("t"), F.lit("g"), 0.8, 1).collect()}
    near = {(a, b) for b in range(len(few)) for a in range(b) if len(few[a] & few[b]) >= 0.8 * len(few[a] | few[b]) and few[a] != few[b] and few.index(few[a]) == a and few.index(few[b]) == b}
    same = {(few.index(x), i) for i, x in enumerate(few) if few.index(x) != i}
    assert got == near | same and len(near) > 20


def test_digest_is_of_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("sample_id"))
    a, b = (sorted(map(tuple, D.id_digest(df.repartition(n), ["g"], span=700).collect())) for n in (1, 9))
    assert a == b and [x[2] for x in a] == [2500, 2500] and a[0][1] != a[1][1]


def test_embedding_links_and_k_center(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "c"), (2, [0.999, 0.01], "c"), (3, [0.0, 1.0], "c"), (4, [0.0, 0.0], "c"), (5, None, "c")], "id long, v array<double>, cell string")
    assert {(r.a, r.b) for r in S.embedding_links(v, "id", "v", 0.95, tables=8, bits=4).collect()} == {(1, 2)}
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(60)]
    near = [(i, [x + rng.gauss(0, 0.12) for x in base[i % 60]], "g") for i in range(240)]
    unit = np.array([x for _, x, _ in near]) / np.linalg.norm([x for _, x, _ in near], axis=1, keepdims=True)
    want = {(a, b) for a in range(240) for b in range(a + 1, 240) if unit[a] @ unit[b] >= 0.95}
    found = {(r.a, r.b) for r in S.embedding_links(spark.createDataFrame(near, "id long, v array<double>, cell string"), "id", "v", 0.95).collect()}
    assert found <= want and len(found) >= 0.98 * len(want) > 100
    assert S.lsh_shape(10**9, 0.95)[1] == 20 and S.lsh_shape(100, 0.95)[1] == 8
    picked = [r.id for r in S.k_center(v.filter("id < 4"), "id", "v", "cell", 2).orderBy("step").collect()]
    assert len(set(picked)) == 2 and 3 in picked


def test_loops_and_ratios(spark):
    rows = spark.createDataFrame([(1, "a b c d e f " * 3), (2, "a b c d e f g h i"), (3, None), (4, "")], "i long, t string")
    assert [(r.i, r.times, r.phrase) for r in Q.loops(rows, "i", F.col("t")).collect()] == [(1, 3, "a b c d e f")]
    d = spark.createDataFrame([("x" * 20, "y" * 60), ("x" * 20, ""), (None, "y"), ("x", "y" * 9)], "s string, t string")
    assert [r[0] for r in d.select(Q.length_ratio_over(F.col("s"), F.col("t"), 2.5)).collect()] == [True, False, False, False]
    c = spark.createDataFrame([("Ａ b ", "a  B"), ("a", "b"), ("", "")], "s string, t string")
    assert [r[0] for r in c.select(Q.copy_of_source(F.col("s"), F.col("t"))).collect()] == [True, False, False]


def test_flags(spark):
    rows = [("en", "ru", "5 kg of CPUs", "5 кг"), ("fa", "en", "سلام", "5 kg CPU"), ("de", "xx", "CPU 5 kg", ""), ("en", "fa", "word سلام", "x^2"), ("ru", "en", "весит 3 кг, США", "x"), ("fr", "es", "p < 0.05 and x = 2", None), ("en", "de", None, None)]
    got = S.features(spark.createDataFrame([(i, 1, None, *r, "x") for i, r in enumerate(rows)], "sample_id long, source_id int, document_id string, src_lang string, tgt_lang string, source_text string, target_text string, domain string")).orderBy("sample_id").collect()
    assert [r.has_numbers_units for r in got] == [True, False, False, False, True, True, False]
    assert [r.has_acronyms for r in got] == [True, False, False, False, True, False, False]
    assert [r.has_mixed_script for r in got] == [False, False, False, True, False, False, False]
    assert [r.has_math for r in got] == [False, False, False, False, False, True, False] and {r.length_bucket for r in got} == {"len_0_15"}
    assert L.supported_features("en", "fa") >= {"has_mixed_script", "has_acronyms"} and L.supported_features("fr", "es") == L.supported_features("de", "en") == {"has_math", "is_rare_term"}


def test_arabic_letters_that_differ_stay_apart(spark):
    df = spark.createDataFrame([("كتابي ٣", "fa"), ("کتابی ۳", "ar"), ("آب", "fa"), ("اب", "fa"), ("أب", "fa"), ("مؤمن", "ar"), ("مومن", "ar")], "t string, l string")
    k = [r[0] for r in df.select(L.language_key(F.col("t"), F.col("l"))).collect()]
    assert k[0] == k[1] and k[2] != k[3] == k[4] and k[5] != k[6]


def test_allocation_permanence(spark):
    t = "timestamp '2026-01-01'"
    s = spark.sql(f"select 1L id, 'TRAINABLE' allocation, cast(null as timestamp) reserved_at, cast(null as timestamp) quarantined_at union all select 2L, 'QUARANTINED', null, {t} union all select 3L, 'IGNORED', {t}, null")
    q = spark.sql(f"select 1L sample_id, 'RESERVED_EVALUATION' wanted, {t} at union all select 2L, 'RESERVED_EVALUATION', {t} union all select 3L, 'TRAINABLE', {t}")
    assert {r.id: r.allocation for r in A.transition(s, q).collect()} == {1: "RESERVED_EVALUATION", 2: "QUARANTINED", 3: "RESERVED_EVALUATION"}
    assert A.uses_batch(3, None, None, None) and not A.uses_batch(3, [1], [3], None) and A.uses_batch(3, [], [3], [1])


def test_ingest(spark):
    raw = spark.createDataFrame([("  a ", "b", "0.5", "k"), ("a", "b", "bad", None), ("", "x", None, None), (None, "y", None, None), ("c", " d ", "1", "")], "source string, target string, q string, note string")
    m = I.Mapping(quality="q", meta_columns=["note"])
    got = I.ingest(raw.coalesce(1), m, 4, 2, "en", "de", 100).orderBy("sample_id").collect()
    assert [(r.sample_id, r.source_text, r.target_text, r.quality) for r in got] == [(100, "a", "b", 0.5), (102, "c", "d", 1.0)]
    assert json.loads(got[0].meta) == {"note": "k"}
    with pytest.raises(ValueError):
        I.normalize(raw, I.Mapping(source_text="nope"), 1, 1, "en", "de")


def test_reservation(spark):
    rows = [(i, i % 3, "en", "de", "law" if i % 2 else None, f"d{i % 20}:c{i}", f"text number {i} about {'x^2' if i % 25 == 0 else 'things'} and {i * 7} more words here", f"Text {i} mit {i * 7} Worten") for i in range(200)]
    rows += [(200, 0, "en", "de", None, None, rows[5][6], rows[5][7]), (201, 9, "en", "de", None, "", "something else", rows[7][7].upper()), (202, 9, "en", "de", None, "", None, None)]
    df = spark.createDataFrame(rows, "sample_id long, source_id int, src_lang string, tgt_lang string, domain string, document_id string, source_text string, target_text string")
    given = {"selection": {"share_percent": 10.0, "gold_size": 6}, "documents": {"budget_share": None}}
    run = PL.reserve(df, df.filter("sample_id < 200"), given, flag_targets={"has_math": 3})
    held = PL.reserve(df, df.filter("sample_id < 200"), given | {"documents": {"budget_share": None, "budget_rows": 30}})
    assert held.report["holdout"]["estimated_rows"] <= 30 and held.report["holdout"]["applied"] and 0 < held.report["selected"] <= 20
    assert sum(n for r, n in held.report["quarantined"].items() if r == "held_document") <= 30
    from textloom.functions.embedding import embedded

    far = PL.reserve(df, df.filter("sample_id < 200"), given | {"selection": {"share_percent": 10.0, "diversity": "kcenter"}}, embedded(df.filter("sample_id < 200"), "sample_id", "source_text"))
    assert far.report["selected"] == 20
    members = {r.sample_id: r for r in run.members.collect()}
    assert len(members) == run.report["selected"] == 20 and set(run.report["splits"]) == {"dev", "test"} and run.report["features"]["has_math"] >= 3
    reasons = {r.sample_id: r.reason for r in run.quarantined.collect()}
    assert not set(reasons) & set(members)
    held = {(i % 3, i % 20) for i in members}
    assert all(i in reasons for i in range(200) if i not in members and (i % 3, i % 20) in held)
    registry = df.select("sample_id", F.when(F.col("sample_id") == min(members), "IGNORED").otherwise("TRAINABLE").alias("allocation"))
    after = {r.sample_id: r.allocation for r in PL.allocation_after(registry, run).collect()}
    assert after[min(members)] == "IGNORED" and after[max(members)] == "RESERVED_EVALUATION"
    assert PL.reserve(df, df.limit(0)).members.count() == 0


def test_registered_reservation_keeps_the_default_sizes(spark, monkeypatch):
    from textloom.plans import queries

    given = []
    monkeypatch.setattr(queries.PL, "reserve_dataset", lambda corpus, registry, filters, rules, policy: given.append(policy))
    queries._reservation(spark, DATA)
    p = policy.validated(given[0])
    assert p["selection"] == policy.DEFAULT["selection"] and p["candidates"] == policy.DEFAULT["candidates"]
    target = S.target_size(318_560, p["selection"]["share_percent"], p["selection"]["max_rows"])
    assert target == 5_000 and S.candidate_limit(318_560, target, **p["candidates"]) == 50_000


def test_scan_decides_by_cosine(spark):
    held = "the committee agreed on a new harbour for the northern islands after a long debate in spring"
    rows = [(1, held), (2, held.replace("spring", "summer")), (3, "the committee agreed on a new road while nobody in the valley had asked for one at all"), (4, None), (5, "")]
    df = spark.createDataFrame([(i, 1, "en", "de", None, t, f"nur {i} eins") for i, t in rows], "sample_id long, source_id int, src_lang string, tgt_lang string, document_id string, source_text string, target_text string")
    got = lambda **k: {r.sample_id: r.reason for r in C.scan(df, df.filter("sample_id = 1"), **k).collect()}
    assert got() == {2: "near_source"} and got(cosine=False) == {2: "shingles_source", 3: "shingles_source"} and got(least=None) == {}


def test_scan_finds_the_best_row_in_blocks(spark):
    import random
    from collections import Counter

    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abc") for _ in range(rng.randrange(9)))
    shingles = lambda t: {t[i : i + 5] for i in range(0, len(t) - 4, 2)} if len(t) >= 5 else {t} - {""}
    rows, refs = ([(base + i, rng.choice("gh"), text()) for i in range(n)] for base, n in ((0, 60), (1000, 40)))
    want = {}
    for i, g, t in rows:
        shared = Counter({r: len(shingles(t) & shingles(u)) for r, h, u in refs if g == h})
        ref, n = min(shared.items(), key=lambda x: (-x[1], x[0]))
        if n >= 2:
            want[i] = (ref, n)
    x, r = (spark.createDataFrame(v, f"{i} long, g string, key string").filter("key <> ''") for i, v in (("sample_id", rows), ("ref", refs)))
    for blocks in ((20_000, 8_000), (7, 5)):
        assert {v.sample_id: (v.ref, v.n) for v in C.best_shared(x, r, 2, *blocks).collect()} == want and want


def test_cut_leaves_no_shuffle_files(spark):
    from textloom import storage

    key, seen = storage.CLEANUP, []
    made = spark.range(100).repartition(3)

    class Watch:
        def __getattr__(self, name):
            return getattr(made, name)

        @property
        def write(self):
            seen.append(spark.conf.get(key))
            return made.write

    before = spark.conf.get(key)
    assert storage.cut(Watch(), "t").count() == 100 and seen == ["true"] and spark.conf.get(key) == before


def test_vectors_are_kept_by_text(spark):
    from textloom.functions.embedding import cached

    a, b = (spark.createDataFrame([(1, t)], "id long, t string") for t in ("one text", "another"))
    assert cached(a, "id", "t", "n").first().v == cached(a, "id", "t", "n").first().v != cached(b, "id", "t", "n").first().v


def test_vectors_and_evaluation_sets(spark):
    from textloom.functions.embedding import embedded
    from textloom.operators import evalset as V

    df = spark.createDataFrame([(1, "the cat sat"), (2, "The cat  sat"), (3, "entirely different"), (4, None), (5, "")], "id long, t string")
    v = embedded(df, "id", "t")
    near = {(r.a, r.b) for r in S.embedding_links(v, "id", "v", 0.95).collect()}
    assert near == {(1, 2)}
    hit = C.similar(v, "id", "v", v.filter("id = 1").select("id", "v"), 0.9)
    assert [(r.id, r.ref_id) for r in hit.collect()] == [(2, 1)]
    rows = spark.createDataFrame([(1, 0.9, 7), (2, 0.2, 7), (3, None, 7)], "sample_id long, quality double, n int")
    reg = spark.createDataFrame([(1, "RESERVED_EVALUATION"), (2, "RESERVED_EVALUATION"), (3, "TRAINABLE")], "sample_id long, allocation string")
    members = V.members_of(reg.select("sample_id"), 4, 10)
    assert ids(V.rows(rows, reg, members, D.Filters(min_quality=0.5))) == [1] and V.rows(rows, reg, members, D.Filters(), limit=1).count() == 1
    b = spark.createDataFrame([(1, "ready"), (2, "importing")], "id int, status string")
    assert {r.id: r.status for r in V.batch_status(V.batch_status(b, 1, "rejected"), 2, "rejected").collect()} == {1: "rejected", 2: "importing"}


def test_policy():
    p = policy.validated({"selection": {"share_percent": 5}, "pairs": {"en-fa": {"quotas": {"domain_floor": 10}}}})
    assert p["selection"]["share_percent"] == 5 and p["selection"]["dev_share"] == 0.5 and policy.for_pair(p, "en-fa")["quotas"]["domain_floor"] == 10
    with pytest.raises(ValueError, match="share_percent.*length_edges.*comparison_scope"):
        policy.validated({"selection": {"share_percent": 0}, "quotas": {"length_edges": [5, 1]}, "contamination": {"comparison_scope": "x"}})


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('source,,source\n"x, ""y""",1,2\nshort\nlong,1,2,3\n')
    assert readers.read_any(spark, str(tmp_path / "a.csv")).columns == ["source", "column_2", "source_2"]
    assert [r[0] for r in readers.read_any(spark, str(tmp_path / "a.csv")).collect()] == ['x, "y"', "short", "long"]
    assert "column_4" in readers.read_delimited_lenient(spark, str(tmp_path / "a.csv")).columns
    (tmp_path / "b.json").write_text('{"data": [{"s": 1}, {"s": 2}]}')
    assert readers.read_any(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "e.json").write_text('{"n": 1, "second": [{"s": 1}], "also": [{"s": 2}, {"s": 3}]}')
    assert [r.s for r in readers.read_any(spark, str(tmp_path / "e.json")).collect()] == [1]
    (tmp_path / "c.tmx").write_text('<tmx><body><tu><tuv xml:lang="EN"><seg>Hi <b>you</b></seg></tuv><tuv xml:lang="de"><seg>Hallo</seg></tuv></tu></body></tmx>')
    assert [r.asDict() for r in readers.read_any(spark, str(tmp_path / "c.tmx")).collect()] == [{"de": "Hallo", "en": "Hi you"}]
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>s</t></si><si><t>hello</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in readers.read_any(spark, str(tmp_path / "d.xlsx")).collect()] == [("hello", "7")]
    assert readers.whole_lines(b"a\nb") == b"a\n" and readers.detect_format("X.NDJSON") == "jsonl"
    with pytest.raises(ValueError):
        readers.detect_format("x.doc")


def test_writers(spark, tmp_path):
    df = spark.range(2000).select(F.col("id").alias("sample_id"), F.md5(F.col("id").cast("string").cast("binary")).alias("t"))
    path = f"file://{tmp_path}/shards"
    written = writers.write_shards(df.coalesce(1), path, 30_000)
    assert all(s <= 30_000 for _, s in written) and spark.read.parquet(path).count() == 2000
    assert len(writers.checksums(spark, path)) == len(written)
    m = writers.write_snapshot(df, f"file://{tmp_path}/snap", {"name": "x"})
    assert m["total"] == 2000 and writers.read_manifest(spark, f"file://{tmp_path}/snap")["counts"] == m["counts"]
    names = writers.export_package({"test": df}, f"file://{tmp_path}/pkg", "t", ["sample_id"])
    assert names[0].endswith("data/test-00000-of-00001.parquet") and spark.read.parquet(names[0]).columns == ["sample_id"]
    os.makedirs(tmp_path / "raw/batch_1"), os.makedirs(tmp_path / "raw/batch_12")
    (tmp_path / "raw/batch_1/x").write_text("x"), (tmp_path / "raw/batch_12/y").write_text("y")
    assert writers.delete_prefix(spark, f"file://{tmp_path}", "raw/batch_1") == 1 and (tmp_path / "raw/batch_12/y").exists()
    for bad in ("", "/", "a/../b"):
        with pytest.raises(ValueError):
            writers.delete_prefix(spark, f"file://{tmp_path}", bad)
    assert writers.selected("t", ["sample_id", "t"], "column") == ["t"]
    with pytest.raises(ValueError):
        writers.selected("zz", ["t"], "column")


def test_import_stream(spark, tmp_path):
    from textloom.streaming.incremental import import_stream

    spark.createDataFrame([("a", "b"), ("", "c")], "source string, target string").write.parquet(f"{tmp_path}/in")
    q = import_stream(spark, f"{tmp_path}/in", "source string, target string", f"{tmp_path}/out", f"{tmp_path}/cp", I.Mapping(), 1, "en", "de")
    q.awaitTermination(60)
    assert [(r.source_text, r.epoch) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", 0)]


def test_queries_equal_their_sql(spark):
    import duckdb

    from textloom.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    for name in ("composition_split_counts", "filter_conjunction", "allocation_counts", "rare_threshold", "dedup_exact", "duplicate_report", "dev_test_split", "annotation_effect", "id_digest", "shingle_count"):
        got = QUERIES[name](spark, DATA)
        cols = sorted(got.columns)
        want = con.execute(f"select {', '.join(cols)} from ({SQL[name]})").fetchall()
        assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want)), name


def test_hot_keys_are_joined_in_blocks(spark):
    """The salted join gives what a plain one gives, with keys that are hot on either side, on both and on none."""
    from textloom.functions import postings as P

    rng = random.Random(8)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, i]), i) for i in range(60)], "k long, a long")
    right = spark.createDataFrame([(rng.choice([1, 2, 2, 2, i]), i) for i in range(60)], "k long, b long")
    want = sorted((x.a, y.b) for x in left.collect() for y in right.collect() if x.k == y.k and x.a != y.b)
    for block in (3, 1000):
        got = P.keyed_pairs(left, right, F.col("x.a") != F.col("y.b"), "t", block)
        assert sorted(tuple(r) for r in got.select("x.a", "y.b").collect()) == want
    own = P.keyed_pairs(left, left, F.col("x.a") < F.col("y.a"), "t", 3)
    assert sorted(tuple(r) for r in own.select("x.a", "y.a").collect()) == sorted((x.a, y.a) for x in left.collect() for y in left.collect() if x.k == y.k and x.a < y.a)
