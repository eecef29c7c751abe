"""Exact and near dedup against brute force; odd rows, empty tables, clashing columns."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framelake.llm import exact_dedup as E
from framelake.llm import near_dedup as N
from framelake.llm import simhash as S
from framelake.llm.common import attach

DOC = "doc_id bigint, text string"
ODD = [(1, "a b c d"), (2, "a  b\tc\n d"), (3, None), (4, ""), (5, " "), (6, "a b c d"), (6, "a b c d"), (7, "é" * 30_000), (8, "é" * 30_000), (None, "a b c d"), (None, "x"), (9, "A b c d")]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOC).withColumns({"label": F.lit("l"), "fp": F.lit(1), "text_sha256": F.lit("z"), "maybe": F.lit(0)})


def brute_classes(rows):
    key = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = {}
    for d, t in rows:
        groups.setdefault(key(t), []).append(d)
    out, used = [], set()
    for d, t in rows:
        k = key(t)
        ids = [x for x in groups[k] if x is not None]
        keep = min(ids) if ids else None
        first = d == keep and k not in used
        used |= {k} if first else set()
        out.append((str(d), str(keep), len(groups[k]), first, k))
    return sorted(out)


def test_exact_classes(spark):
    got = E.duplicate_classes(spark, docs(spark)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == brute_classes(ODD)


@pytest.mark.parametrize("max_bits", [1 << 14, 1 << 20])
def test_exact_with_filters_by_range_and_a_hot_group(spark, max_bits):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 2500}") for i in range(6000)]
    df = spark.createDataFrame(rows, DOC)
    got = E.duplicate_classes(spark, df, max_bits).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == brute_classes(rows)
    kept = {int(d) for d, _, _, first, _ in brute_classes(rows) if first}
    assert sorted(r.doc_id for r in E.exact_dedup(spark, df, max_bits).collect()) == sorted(kept)


def test_only_what_may_repeat_is_shuffled(spark):
    keys = E.written(spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text_sha256")), "keys")
    for max_bits, ranges in ((1 << 28, 1), (1 << 16, 8)):
        tables = E.tested_keys(keys, max_bits)
        assert len(tables) == ranges and sum(t.count() for t in tables) == 20_000
        assert sum(t.filter("maybe").count() for t in tables) < 400


def test_exact_dedup_keeps_whole_rows(spark):
    out = E.exact_dedup(spark, docs(spark))
    assert out.columns == ["doc_id", "text", "label", "fp", "text_sha256", "maybe"]
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "5", "7", "9", "None"]
    assert E.exact_dedup(spark, docs(spark, [])).count() == 0
    assert E.duplicate_classes(spark, docs(spark, [])).count() == 0


def test_filter_never_misses_a_repeat(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 63), 1 << 63, 3000)
    h[:500] = h[500:1000]
    df = spark.createDataFrame([(int(x),) for x in h], "h bigint").repartition(7)
    bits, ranges = E.filter_shape(3000, 1 << 28)
    assert (bits, ranges) == (1 << 16, 1) and E.filter_shape(3000, 1 << 13) == (1 << 13, 8)
    maybe = E.maybe_repeated(spark, E.repeated_filter(df, bits, 3))
    found = {r.h for r in df.filter(maybe("h")).collect()}
    twice = set(h[:500].tolist())
    assert twice <= found and len(found - twice) < 60


def test_attach_bears_hot_groups(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(900)], "id bigint, k bigint")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = {(r.id, r.low) for r in attach(rows, groups, "k", "n", 900).collect()}
    low = {}
    for i in range(900):
        low.setdefault(0 if i % 3 else i, i)
    assert got == {(i, low[0 if i % 3 else i]) for i in range(900)}


def plain_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_fingerprint_by_hand():
    for text in ("", None, "one", "One two", "a b c", "a b c d e f " * 50, "É ß x\x1cy z \x0b w", "x" * 5000 + " y z"):
        assert S.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)
    assert S.fingerprint(b"a b c d e f", 5) == plain_fingerprint("a b c d e f", 5)


def brute_components(fps, ids, radius=3):
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        low = np.array([label[near[i]].min() for i in range(len(fps))])
        if (low == label).all():
            break
        label = np.minimum(label, low)
    out = {}
    for i, c in enumerate(label):
        own = [ids[j] for j in range(len(fps)) if label[j] == c and ids[j] is not None]
        out[i] = min(own) if own else None
    return out


@pytest.mark.parametrize("shard_size", [1 << 16, 150])
def test_components_over_one_shard_and_many(spark, shard_size):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    # chains whose ends are far apart: each link flips two more bits
    chain = [base[0]]
    for k in range(0, 40, 2):
        chain.append(chain[-1] ^ np.uint64(3 << k))
    near = base[100:200] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    fps = np.concatenate([base, np.array(chain), near, near[:50], np.zeros(3, np.uint64)])
    ids = rng.permutation(len(fps)).tolist()
    df = spark.createDataFrame([(d, int(f)) for d, f in zip(ids, fps.view(np.int64))], "doc_id bigint, fp bigint")
    parts = {r.fp: r.component_id for r in S.near_components(spark, df, 3, shard_size, 2000).collect()}
    want = brute_components(fps, ids)
    assert {i: parts[int(f)] for i, f in enumerate(fps.view(np.int64))} == want


def test_large_shards_are_split_again(spark):
    rng = np.random.default_rng(6)
    # the first tree sees nothing of a crowd that then fills one shard
    base = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    crowd = np.unique(base[0] ^ (np.uint64(1) << rng.integers(0, 64, (3000, 9)).astype(np.uint64)).sum(axis=1, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, crowd, crowd[:200] ^ np.uint64(0b11)]))
    dealt = S.written(spark.createDataFrame([(0, int(f)) for f in fps.view(np.int64)], "shard bigint, fp bigint"), "dealt")
    out, shards = S.split_again(dealt, 1, 400, 3)
    sizes = {r["shard"]: r["count"] for r in out.groupBy("shard").count().collect()}
    assert len(sizes) == shards - len([k for k in range(shards) if k not in sizes]) > 3 and max(sizes.values()) < len(fps)
    near = lambda rows: {tuple(sorted((int(a), int(b)))) for own in rows.values() for a in own for b in own if a < b and (int(a) ^ int(b)).bit_count() <= 3}
    by = {}
    for r in out.collect():
        by.setdefault(r.shard, []).append(np.int64(r.fp).view(np.uint64))
    found = near({k: np.unique(v) for k, v in by.items()})
    d = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    assert found == {(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(d)) if i < j}


def test_local_search_equals_all_pairs():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, fps[:300] ^ np.uint64(0b10101), fps[:100] ^ np.uint64(0xFF)]))
    S_leaf, S.LEAF = S.LEAF, 64
    try:
        member, root = S.local_stars(fps, 3)
    finally:
        S.LEAF = S_leaf
    want = brute_components(fps, list(range(len(fps))))
    own = {int(f): int(r) for f, r in zip(member, root)}
    label = {}
    for i, f in enumerate(fps.tolist()):
        label.setdefault(want[i], set()).add(own.get(f, f))
    assert all(len(v) == 1 for v in label.values()) and len(label) == len({next(iter(v)) for v in label.values()})


def test_near_dedup_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(10, text), (11, text.replace("w7 ", "w8 ")), (11, text.replace("w7 ", "w8 ")), (3, "else entirely here"), (4, None), (5, ""), (None, "else entirely here"), (20, text.upper()), (21, "q " * 40_000)]
    out = N.near_dedup(spark, docs(spark, rows))
    assert out.columns[:2] == ["doc_id", "text"]
    assert sorted(str(r.doc_id) for r in out.collect()) == ["10", "21", "3", "4"]
    classes = S.near_duplicate_classes(spark, docs(spark, rows)).collect()
    assert len(classes) == len(rows) and {r.component_id for r in classes if r.doc_id in (4, 5)} == {4}
    assert N.near_dedup(spark, docs(spark, [])).count() == 0
    assert S.near_duplicate_classes(spark, docs(spark, [])).count() == 0


def test_near_dedup_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for k in range(60):
        words = [vocabulary[i] for i in rng.integers(0, 900, 150)]
        rows.append((len(rows), " ".join(words)))
        for edits in rng.integers(1, 12, rng.integers(0, 4)):
            own = list(words)
            for at in rng.integers(0, 150, edits):
                own[at] = vocabulary[rng.integers(0, 900)]
            rows.append((len(rows), " ".join(own)))
    n = len(rows)
    label = list(range(n))
    like = np.array([[N.likeness(a, b, 5) for _, b in rows] for _, a in rows])
    while True:
        low = [min(label[j] for j in range(n) if like[i][j] >= 0.8) for i in range(n)]
        if low == label:
            break
        label = low
    for options in ({}, {"block": 40}):
        got = {r.doc_id for r in N.near_dedup(spark, spark.createDataFrame(rows, DOC), **options).collect()}
        # nothing goes that all pairs would keep; of what they would drop, a table or other finds nearly all
        assert set(label) <= got and len(got - set(label)) <= 0.03 * (n - len(set(label)))


def test_many_copies_of_one_text_link_up(spark):
    words = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join(words[:k] + [f"x{i}"] + words[k + 1 :])) for i, k in enumerate(np.random.default_rng(1).integers(0, 300, 400).tolist())]
    assert [r.doc_id for r in N.near_dedup(spark, spark.createDataFrame(rows, DOC)).collect()] == [0]


def test_clusters_of_case_variants_link_across(spark):
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in rng.integers(0, 5000, 400)]
    other = [*base[:200], "x1", "x2", "x3", *base[203:]]
    assert 0.8 <= N.likeness(" ".join(base), " ".join(other), 5) < 1
    spelled = lambda words, n: [" ".join(w.upper() if k == i else w for i, w in enumerate(words)) for k in range(n)]
    rows = list(enumerate(spelled(base, 7) + spelled(other, 7)))
    assert [r.doc_id for r in N.near_dedup(spark, spark.createDataFrame(rows, DOC)).collect()] == [0]


def test_pairs_of_a_large_bucket_beyond_its_head(spark):
    # all share most shingles; the head is alike to none, the others in pairs
    common = [f"c{i}" for i in range(300)]
    rows = [(0, " ".join([*common, *(f"h{i}" for i in range(200))]))]
    for k in range(40):
        own = [f"k{k}x{i}" for i in range(120)]
        rows += [(2 * k + 1, " ".join([*common, *own])), (2 * k + 2, " ".join([*common, *own, "end"]))]
    for options in ({}, {"block": 7}):
        got = sorted(r.doc_id for r in N.near_dedup(spark, spark.createDataFrame(rows, DOC), **options).collect())
        assert got == [0, *range(1, 81, 2)]


def test_added_replaced_and_repeated_paragraphs_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 2000, n)]
    rows = []
    for k in range(40):
        base, n = words(300), int(rng.integers(5, 28))
        edited = [[*base, *words(2 * n)], [*base[:100], *words(n), *base[100 + n :]], [*base, *base[40:60] * 60]]
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate([base, edited[k % 3]])]
    n = len(rows)
    sets = [N.shingles(t, 5) for _, t in rows]
    lost = {j for j in range(n) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(lost) >= 35 and N.bands_for(0.8, 6, 1e-6) == 46
    assert {r.doc_id for r in N.near_dedup(spark, spark.createDataFrame(rows, DOC)).collect()} == set(range(n)) - lost


CLASH = ["__id", "__key", "__maybe", "__slot", "__chars", "__start", "id", "digest", "go", "row_id", "row_digest", "same", "label", "key", "first", "bits", "Phase"]


def clashing(spark, rows):
    """Rows with columns named like those that operators use inside; each has the row's own values."""
    named = spark.createDataFrame([(d, t, f"s{i % 3}", i) for i, (d, t) in enumerate(rows)], "doc_id bigint, text string, source string, n bigint")
    return named.select("doc_id", "text", "source", *(F.concat(F.lit(c), F.col("n")).alias(c) for c in CLASH))


@pytest.mark.parametrize("operator", [E.exact_dedup, N.near_dedup])
def test_clashing_columns_come_back_as_they_were(spark, operator):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, long), (2, long), (2, long), (3, long + " end"), (4, "other words"), (None, "other words"), (5, None)]
    given = clashing(spark, rows)
    out = operator(spark, given)
    assert out.columns == given.columns
    got, all_rows = [tuple(r) for r in out.collect()], {tuple(r) for r in given.collect()}
    assert set(got) <= all_rows and sorted(r[0] for r in got) == ([1, 3, 4, 5] if operator is E.exact_dedup else [1, 4, 5])


def test_unlike_rows_with_one_doc_id_both_stay(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(200)) for p in "ab")
    rows = [(5, a), (5, b), (5, b), (7, a + " end"), (None, b + " end"), (None, "alone"), (None, "alone")]
    got = sorted((str(r.doc_id), r.text) for r in N.near_dedup(spark, spark.createDataFrame(rows, DOC)).collect())
    assert got == sorted([("5", a), ("5", b), ("None", "alone")])


def test_near_dedup_equals_all_pairs_on_the_documents(spark, sf):
    """Recall and precision of the links at 0.8 over the test table's own documents."""
    rows = [tuple(r) for r in E.exact_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "text").collect()]
    sets = [N.hashes(t, 5) for _, t in rows]
    where = {}
    for i, h in enumerate(sets):
        for v in h.tolist():
            where.setdefault(v, []).append(i)
    pairs = {(i, j) for at in where.values() for i in at for j in at if i < j}
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in pairs:
        if N.alike(sets[i], sets[j], 0.8):
            label[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    got = {r.doc_id for r in N.near_dedup(spark, spark.createDataFrame(rows, DOC)).collect()}
    assert got == {min(g) for g in groups.values()}


def test_components_of_any_ordered_type(spark):
    stars = [(0, b"a", b"a"), (0, b"a", b"d"), (0, b"c", b"c"), (0, b"c", b"d"), (1, b"c", b"c"), (1, b"c", b"f"), (0, b"x", b"x"), (0, b"x", b"y")]
    out = S.joined_labels(spark.createDataFrame(stars, "shard int, root binary, fp binary")).collect()
    assert {(bytes(r.fp), bytes(r.label)) for r in out} == {(b"a", b"a"), (b"d", b"a"), (b"c", b"a"), (b"f", b"a"), (b"x", b"x"), (b"y", b"x")}
