"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

A text's fingerprint is the sum of wide vectors, one per element, modulo powers of two:

- core: each paragraph (between line feeds, byte for byte) adds 16 lanes hashed from its SHA-256, modulo
  2^32. Equal multisets of paragraphs have equal cores, in whatever order they come.
- sketch: each piece of a paragraph (up to 6 words, ending early where a sentence ends) adds a bit in
  each of 128 lanes, modulo 2^30; two lanes share a bigint, with a guard bit each. Twice a lane's sum
  less the number of pieces is a sum of random signs, so the cosine of two sketches estimates how much
  of the two multisets of pieces is the same (standard error about 0.09). No text that fits in a column
  has 2^29 pieces, so no lane wraps. Runs of up to 2^14 pieces are summed four lanes a bigint first.

Sums make both incremental: combine() adds the fingerprint of inserted paragraphs, remove() takes off that
of deleted ones. Nothing is exploded or grouped; a document's vector is summed within its row.

Nulls: a null text is an empty one (one empty paragraph, no piece); a null doc_id sorts first, as
successor too. Equal doc_ids follow each other in the order of their texts' SHA-256. An empty table gives
an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORE_LANES, SKETCH_WORDS = 16, 64
CORE_MASK = 0xFFFFFFFF
LANE_BITS, LANE_MOD = 31, 1 << 30
KEEP_EACH = (LANE_MOD - 1) | (LANE_MOD - 1) << LANE_BITS
#: Sums of up to RUN pieces: four lanes of RUN_BITS bits a bigint.
RUN, RUN_BITS = 1 << 14, 15
ONE_EACH = sum(1 << RUN_BITS * k for k in range(4))
#: A piece: words up to the end of a sentence, 6 at most.
PIECE = r"(?:[^\s.!?]++[ \t]++){0,5}\S++"
FIRST = -(1 << 63)


def _longs(n: int) -> Column:
    return F.array(*[F.lit(i).cast("bigint") for i in range(n)])


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("bigint"), n)


def core(text: Column) -> Column:
    """16 lanes modulo 2^32 over the paragraphs."""
    digests = F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))
    lane = lambda s: lambda a, i: (a + F.shiftrightunsigned(F.xxhash64(s, i), 32)).bitwiseAND(F.lit(CORE_MASK))
    return F.aggregate(digests, _zeros(CORE_LANES), lambda acc, s: F.zip_with(acc, _longs(CORE_LANES), lane(s)))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lane(v: Column, shift: int) -> Column:
    return F.call_function("shiftright", v, F.lit(shift)).bitwiseAND(F.lit((1 << RUN_BITS) - 1))


def _run_sums(digests: Column) -> Column:
    """The lanes of at most RUN pieces, two a bigint, then the number of pieces."""
    step = lambda h: lambda a, i: a + F.xxhash64(h, i).bitwiseAND(F.lit(ONE_EACH))
    sums = F.aggregate(digests, _zeros(SKETCH_WORDS // 2), lambda acc, h: F.zip_with(acc, _longs(SKETCH_WORDS // 2), step(h)))
    pair = lambda v, k: _lane(v, k) + F.call_function("shiftleft", _lane(v, k + RUN_BITS), F.lit(LANE_BITS))
    wide = F.flatten(F.transform(sums, lambda v: F.array(pair(v, 0), pair(v, 2 * RUN_BITS))))
    return F.concat(wide, F.array(F.size(digests).cast("bigint")))


def sketch(text: Column) -> Column:
    """64 bigints of two lanes each over the pieces, modulo 2^30, then the number of pieces."""
    digests = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p))
    last = lambda d: F.floor(F.greatest(F.size(d) - 1, F.lit(0)) / RUN).cast("int")
    runs = lambda d: F.transform(F.sequence(F.lit(0), last(d)), lambda k: F.slice(d, k * RUN + 1, F.lit(RUN)))
    return F.aggregate(_let(digests, runs), _zeros(SKETCH_WORDS + 1), lambda acc, d: combine(acc, _run_sums(d), KEEP_EACH))


def combine(a: Column, b: Column, mask: int) -> Column:
    """The lanes of both multisets together; mask is CORE_MASK or KEEP_EACH."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(mask)))


def remove(a: Column, b: Column, mask: int) -> Column:
    """The lanes of a without b's elements."""
    # no lane borrows of the next: each gets its modulus first
    modulus = F.lit(CORE_MASK + 1 if mask == CORE_MASK else KEEP_EACH + 1 + (1 << LANE_BITS))
    return F.zip_with(a, b, lambda x, y: (x + (modulus - y)).bitwiseAND(F.lit(mask)))


def _signs(s: Column) -> Column:
    """The 128 centred lanes of a sketch."""
    count, low = F.element_at(s, SKETCH_WORDS + 1), F.lit(LANE_MOD - 1)
    lanes = F.flatten(F.transform(F.slice(s, 1, SKETCH_WORDS), lambda v: F.array(v.bitwiseAND(low), F.call_function("shiftright", v, F.lit(LANE_BITS)).bitwiseAND(low))))
    return F.transform(lanes, lambda v: (v * 2 - count).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def likeness(signs_a: Column, signs_b: Column, equal: Column) -> Column:
    """1 if equal, else the cosine of the centred lanes, 0 if that is negative or a side has no piece."""
    norm = F.sqrt(_dot(signs_a, signs_a) * _dot(signs_b, signs_b))
    return F.when(equal, F.lit(1.0)).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(signs_a, signs_b) / norm))).otherwise(F.lit(0.0))


def as_text(core_lanes: Column, sketch_lanes: Column) -> Column:
    hexed = lambda a, n: F.array_join(F.transform(a, lambda v: F.lpad(F.lower(F.hex(v)), n, "0")), "")
    return F.concat(hexed(core_lanes, 8), hexed(sketch_lanes, 16))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """The number of bounds that are <= key; two levels, so 2 sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0).cast("bigint")
    fan = max(1, math.isqrt(len(bounds) - 1) + 1)
    rows = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    upto = lambda a: F.size(F.filter(a, lambda b: b <= key)).cast("bigint")
    heads = upto(longs([r[0] for r in rows]))
    return F.when(heads == 0, F.lit(0).cast("bigint")).otherwise((heads - 1) * fan + upto(F.element_at(F.array(*map(longs, rows)), heads.cast("int"))))


def with_next(docs: DataFrame, carried: list[str], rows_a_bucket: int = 4000, max_buckets: int = 1 << 14) -> DataFrame:
    """docs (with __key, the bigint that orders them, and __tie) and next_<c> of the row after, for each carried c.

    Buckets of neighbouring keys are windows of their own; the first row of the next bucket (after the
    last: of the first) is copied to the end of each. Bounds and first keys are the only things the driver
    sees, max_buckets each.
    """
    spark = docs.sparkSession
    total = docs.count()
    buckets = max(1, min(max_buckets, total // rows_a_bucket))
    shares = [k / buckets for k in range(1, buckets)]
    bounds = sorted(set(docs.agg(F.percentile_approx("__key", shares, 10 * buckets)).first()[0] or [])) if shares else []
    placed = docs.withColumn("__bucket", _bucket(F.col("__key"), bounds))
    firsts = sorted(tuple(r) for r in placed.groupBy("__bucket").agg(F.min("__key")).collect())
    ends = [(firsts[(k + 1) % len(firsts)][1], firsts[k][0]) for k in range(len(firsts))]
    copies = spark.createDataFrame(ends, "__key bigint, __to bigint")
    guards = placed.join(F.broadcast(copies), "__key").withColumn("__bucket", F.col("__to")).drop("__to").withColumn("__guard", F.lit(True))
    every = placed.withColumn("__guard", F.lit(False)).unionByName(guards)
    w = Window.partitionBy("__bucket").orderBy("__guard", "__key", "__tie")
    return every.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).filter(~F.col("__guard")).drop("__guard", "__bucket")


def fingerprint_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"__key": F.coalesce("doc_id", F.lit(FIRST)), "__tie": F.sha2("text", 256)})
    rows = rows.withColumns({"core": core(F.col("text")), "sketch": sketch(F.col("text"))})
    chained = with_next(rows, ["text", "core", "sketch"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    chained = chained.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    chained = chained.withColumns({"edited_core": core(F.col("edited")), "edited_sketch": sketch(F.col("edited"))})
    chained = chained.withColumns({f"{p}signs": _signs(F.col(f"{p}sketch")) for p in ("", "next_", "edited_")})
    same = lambda p: (F.col("core") == F.col(f"{p}core")) & (F.col("sketch") == F.col(f"{p}sketch"))
    return chained.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("core"), F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_core"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs"), same("edited_")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs"), same("next_")).alias("near_next"),
    )
