"""Classifiers on held-out rows, the schedule against its windows, the pipeline against its parts."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import language as L
from framelake.llm import mixing as M
from framelake.llm import quality as Q
from framelake.llm import queries

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# --- language ---


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op6_language(spark, sf).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    none = spark.createDataFrame([], DOC)
    assert L.languages(spark, none).count() == 0
    rows = [(i, "le chat est la " * 5 if i % 2 else "the cat is on " * 5, "fr" if i % 2 else "en", "s", 1) for i in range(80)]
    odd = [(900, None, "fr", None, None), (901, "", "en", None, 0), (902, "12 -- !", None, None, 7), (903, "the cat " * 20_000, None, None, None), (None, "the cat", "en", None, 7), (903, "the cat " * 20_000, None, None, None)]
    df = spark.createDataFrame(rows + odd, DOC).withColumns({"score": F.lit(9), "lang_pred": F.lit("zz")})
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.languages(spark, df).collect()]
    by = {d: (p, s) for d, p, s in got}
    assert len(got) == 86 and by[900] == by[901] == by[902] == ("und", 0.0) and by[903][0] == "en" and by[None][0] == "en"
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.languages(spark, unlabelled).collect()} == {"und"}


def test_elastic_net_zeroes_weights():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 300)
    rows = [(np.unique(np.concatenate([[k], rng.integers(3, 400, 20)])), None) for k in y]
    rows = [(i, np.ones(len(i)) / np.sqrt(len(i))) for i, _ in rows]
    w = L.ftrl(rows, y, 400, 3, l1=0.2)
    assert (np.array([(v @ w[i] + w[-1]).argmax() for i, v in rows]) == y).mean() > 0.95
    assert (w[3:400] == 0).mean() > 0.2 and L.ftrl(rows, y, 400, 3, l1=0.0)[3:400].astype(bool).all()


def test_letters_beyond_the_first_plane():
    assert L.grams("\U0001f600 12 \ufffe") is None and L.grams(None) is None and L.grams("") is None
    assert len(L.grams("\U00010400")) == 3 + 2 + 1


def test_temperature_fits_the_loss():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert 2.5 < L.temperature(logits * 3, y) < 3.6
    assert L.temperature(logits[:0], y[:0]) == 1.0


# --- quality ---


def test_quality_held_out(spark, sf):
    got = {r.doc_id: r for r in queries.op8_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [d for d in labels if got[d].held_out]
    assert held and np.mean([got[d].predicted == labels[d] for d in held]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for d, r in got.items())


def test_rules_compile_to_the_same_score(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(400, 3))
    y = ((x[:, 0] > 0.6) | ((x[:, 1] < 0.3) & (x[:, 2] > 0.5))).astype(float)
    model = Q.RuleEnsemble.fit(x, y, ["a", "b", "c"])
    logit = model.intercept + sum(w * Q._holds(r, x, ["a", "b", "c"]) for r, w in model.rules)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double")
    got = [r.s for r in rows.select("i", model.score(F.struct("a", "b", "c")).alias("s")).orderBy("i").collect()]
    assert got == pytest.approx(list(1 / (1 + np.exp(-logit))))
    assert ((np.array(got) >= 0.5) == y).mean() > 0.97 and 1 < len(model.rules) < 250


def test_statistics_by_hand(spark):
    text = "AB c c!!\nab 1|2\nab 1|2"
    r = spark.range(1).select(Q.statistics(F.lit(text)).alias("s")).first().s
    assert r.capitals == 2 / len(text) and r.symbols == 4 / len(text) and r.digits == 4 / len(text) and r.distinct_lines == 2 / 3
    assert r.distinct_words == 4 / 7 and list(r.asDict()) == Q.NAMES


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (5, None)], "doc_id bigint, quality int")
    rows = [(1, "fine text", None, None, None), (1, "fine text", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (None, "x|" * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOC).withColumns({"score": F.lit(0), "s": F.lit(0), "quality": F.lit(0)})
    got = Q.quality_scores(spark, docs, labels).collect()
    assert len(got) == 5 and all(r.score > 0.9 for r in got)  # one class only
    assert {r.score for r in Q.quality_scores(spark, docs, labels.limit(0)).collect()} == {0.5}
    assert Q.quality_scores(spark, docs.limit(0), labels).count() == 0
    assert Q.keep_good(spark, docs, labels).columns == docs.columns


# --- mixing ---


def fluid(blocks, weights, slot):
    """What the ideal mix has given each source by the slot, in exact fractions, worked out phase by phase."""
    had, left = [Fraction(0)] * len(blocks), Fraction(slot)
    while left:
        own = [i for i in range(len(blocks)) if had[i] < blocks[i]]
        total = sum(weights[i] for i in own)
        step = min([left] + [(blocks[i] - had[i]) * total / weights[i] for i in own])
        for i in own:
            had[i] += step * weights[i] / total
        left -= step
    return had


MIXES = [
    ([40], [1.0]), ([100, 60, 40], [0.5, 0.3, 0.2]), ([9] * 7, [1.0] * 7), ([300, 5, 1], [0.999999, 1e-6, 3e-9]),
    ([90, 30, 200], [2**0.5, 3**0.5, 3.14159265358979]), ([1, 1, 1, 500], [1e-300, 7.0, 0.1, 1.0]), ([50, 3] + [1] * 50, [0.5, 0.03] + [0.01] * 50),
]


@pytest.mark.parametrize("blocks, weights", MIXES)
def test_no_source_is_a_block_off_its_target(blocks, weights):
    plan = M.plan_of(blocks, weights)
    assert [len(p) for p in plan] == blocks
    assert sorted(t for own in plan for _, _, t in own) == list(range(sum(blocks)))
    assert all(r <= t < d for own in plan for r, d, t in own)
    exact = [Fraction(w) for w in weights]
    for slot in range(0, sum(blocks) + 1, 1 + sum(blocks) // 60):
        for own, ideal in zip(plan, fluid(blocks, exact, slot)):
            assert abs(sum(t < slot for _, _, t in own) - ideal) < 1


def test_a_hundred_thousand_slots_of_a_thousand_sources():
    rng = np.random.default_rng(3)
    weights = (rng.pareto(0.8, 1000) + 1e-3).tolist()
    blocks = np.maximum(1, rng.multinomial(100_000, rng.dirichlet(np.full(1000, 0.3)))).tolist()
    plan = M.plan_of(blocks, weights)
    flat = np.array([(i, *p) for i, own in enumerate(plan) for p in own])
    assert np.array_equal(np.sort(flat[:, 3]), np.arange(sum(blocks)))
    assert (flat[:, 1] <= flat[:, 3]).all() and (flat[:, 3] < flat[:, 2]).all()
    exact = [Fraction(w) for w in weights]
    for slot in (17, 20_011, 90_001):
        had = np.bincount(flat[flat[:, 3] < slot, 0], minlength=1000)
        assert all(abs(int(h) - x) < 1 for h, x in zip(had, fluid(blocks, exact, slot)))


def test_earliest_deadline_goes_first():
    """Slot by slot against a search of all blocks."""
    for blocks, weights in MIXES[1:3] + MIXES[4:]:
        plan = M.plan_of(blocks, weights)
        open_blocks = {(i, j): plan[i][j] for i, n in enumerate(blocks) for j in range(n)}
        for slot in range(sum(blocks)):
            due, i, j = min((d, i, j) for (i, j), (r, d, _) in open_blocks.items() if r <= slot)
            assert open_blocks.pop((i, j))[2] == slot and due > slot


def test_weight_zero_comes_last():
    plan = M.plan_of([3, 4, 2], [0.0, 1.0, 0.0])
    assert [t for _, _, t in plan[1]] == [0, 1, 2, 3] and sorted(t for p in (plan[0], plan[2]) for _, _, t in p) == [4, 5, 6, 7, 8]


def mixed_rows(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 90), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(1500)]
    rows += [(1, "twice", "en", "b", 0), (1, "twice", "en", "b", 0), (None, None, None, "lonely", None), (77, "y" * 40_000, "en", "c", None)]
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit(c) for c in ("slot", "__slot", "chars", "start", "row", "hash", "range", "n")}), rows


@pytest.mark.parametrize("options", [{}, {"weights": {"a": 0.5, "b": 0.3, "c": 0.2}}, {"weights": {None: 1.0, "c": 0.25}, "block_chars": 50}, {"max_blocks": 9}])
def test_schedule_of_a_table(spark, options):
    docs, rows = mixed_rows(spark)
    size = options.get("block_chars", 300)
    got = M.mixed_schedule(spark, docs, **{"block_chars": size, "range_rows": 50} | options).collect()
    assert len(got) == len(rows)
    total = sum(len(r[1] or "") + 1 for r in rows)
    size = max(size, -(-total // options.get("max_blocks", 1 << 20)))
    owner, sources = {}, sorted({r.source for r in got}, key=str)
    for s in sources:
        at = 0
        for r in sorted((r for r in got if r.source == s), key=lambda r: r.start):
            assert r.start == at and r.block == at // size and r.release <= r.slot < r.deadline
            assert owner.setdefault(r.slot, (s, r.block)) == (s, r.block)
            at += r.chars
    assert len(set(owner.values())) == len(owner) and max(owner) < total / size + len(sources)


def test_mixed_keeps_rows_and_columns(spark):
    docs, rows = mixed_rows(spark)
    out = M.mixed(spark, docs, block_chars=300)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert M.mixed(spark, docs.limit(0)).count() == 0 and M.mixed_schedule(spark, docs.limit(0)).count() == 0


# --- pipeline ---


def test_stages_take_effect(spark, sf):
    from framelake.llm.common import written

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], sf), name))
    for df in kept[1:-1]:
        assert df.columns == docs.columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in kept[:-1]]
    score = {r.doc_id: r.predicted for r in queries.op8_quality(spark, sf).collect()}
    assert ids[1] == {d for d in ids[0] if score[d]}
    first = {}
    for r in sorted(kept[1].collect(), key=lambda r: r.doc_id):
        first.setdefault(" ".join(r.text.split()) if r.text == r.text.strip() else r.text, r.doc_id)
    assert ids[2] == set(first.values())
    assert ids[3] <= ids[2] and ids[4] == ids[3]
    assert {r.doc_id for r in kept[-1].collect()} == ids[4]
    run = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in run.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in kept[-1].collect())


def test_pipeline_on_empty_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_weights_of_the_mixing_reach_the_sequences(spark):
    from framelake.llm.common import written

    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randint(0, 900)}" for _ in range(rng.randint(50, 900))), "en", "ab"[i % 2], 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC)
    packed = {}
    for heavy in "ab":
        mixed = written(M.mixed(spark, docs, weights={"a": 0.1, "b": 0.1} | {heavy: 0.9}, block_chars=2000), "mixed")
        packed[heavy] = corpus_pipeline.packing(spark, mixed, "").collect()
    assert len(packed["a"]) == len(packed["b"])
    for heavy, own in packed.items():
        ids = sorted({r.sequence_id for r in own})
        early = [r for r in own if r.sequence_id in ids[: len(ids) // 3]]
        assert sum("ab"[r.doc_id % 2] == heavy for r in early) > 0.65 * len(early)
    where = lambda own: sorted((r.doc_id, r.piece, r.sequence_id) for r in own)
    assert where(packed["a"]) != where(packed["b"])
