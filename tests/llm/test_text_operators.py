"""Fingerprints, chat formatting and secret scan against plain Python."""

import base64
import hashlib
import json
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from framelake.llm import chat as C
from framelake.llm import fingerprints as P
from framelake.llm import secrets as S

DOC = "doc_id bigint, text string"

# --- fingerprints ---


def finger(spark, rows):
    df = spark.createDataFrame(rows, DOC).withColumns({"core": F.lit(1), "sketch": F.lit("x"), "edited": F.lit(0)})
    return P.fingerprint_table(spark, df).collect()


def test_edits_follow_doc_id_and_wrap(spark):
    rng = random.Random(1)
    rows = [(i * 7, " ".join(rng.choice(["alpha", "béta", "gamma.", "delta\n", "漢字"]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows[5] = (35, None)
    got = {r.doc_id: r for r in finger(spark, rng.sample(rows, len(rows)))}
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert 0 <= got[d].near_next <= 1 and 0 <= got[d].near_edited <= 1


def test_buckets_of_neighbours(spark):
    rows = spark.range(1000).select((F.col("id") * 3).alias("__key"), F.lit("").alias("__tie"), (F.col("id") * 3).alias("v"))
    got = {r.v: r.next_v for r in P.with_next(rows, ["v"], rows_a_bucket=40).collect()}
    assert got == {3 * i: 3 * ((i + 1) % 1000) for i in range(1000)}


def test_odd_rows_and_empty_table(spark):
    got = finger(spark, [(1, None), (1, None), (2, ""), (None, "a b"), (3, "z" * 50_000)])
    assert len(got) == 5
    by = {str(r.doc_id): r for r in got}
    assert by["1"].fingerprint == by["2"].fingerprint != by["3"].fingerprint
    assert by["1"].near_edited == 1.0  # nothing to replace
    assert finger(spark, []) == []
    assert [r.near_next for r in finger(spark, [(1, "only one here")])] == [1.0]


def test_sums_are_homomorphic_and_ignore_order(spark):
    parts = ["first line here.", "second one", "", "third. with. many words that go on and on and on and on for long"]
    text = lambda own: F.lit("\n".join(own))
    one = spark.range(1).select(
        P.core(text(parts)).alias("all"), P.core(text(parts[::-1])).alias("turned"), P.core(text(parts[:2])).alias("a"), P.core(text(parts[2:])).alias("b"),
        P.sketch(text(parts)).alias("sall"), P.sketch(text(parts[:2])).alias("sa"), P.sketch(text(parts[2:])).alias("sb"),
    )
    c, s = F.lit(P.CORE_MASK), P.KEEP_EACH
    r = one.select(
        "all", "turned", "a", "b", "sall", "sa", P.combine(F.col("a"), F.col("b"), P.CORE_MASK).alias("sum"), P.remove(F.col("all"), F.col("b"), P.CORE_MASK).alias("less"),
        P.combine(F.col("sa"), F.col("sb"), s).alias("ssum"), P.remove(F.col("sall"), F.col("sb"), s).alias("sless"),
    ).first()
    assert r["all"] == r.turned == r["sum"] and r.less == r.a and r["all"] != r.a
    assert r.ssum == r.sall and r.sless == r.sa
    assert c is not None


def plain_lanes(text):
    """core lanes, sketch lanes and number of pieces, by hand."""
    one = lambda x, seed: xxhash.xxh64_intdigest(struct.pack("<q", x - (1 << 64) if x >> 63 else x), seed)
    core, sketch = [0] * 16, [0] * 128
    for p in text.split("\n"):
        h = xxhash.xxh64_intdigest(hashlib.sha256(p.encode()).hexdigest().encode(), 42)
        core = [(c + (one(i, h) >> 32)) % (1 << 32) for i, c in enumerate(core)]
    pieces = re.findall(r"(?:[^\s.!?]++[ \t]++){0,5}\S++", text, re.ASCII)
    for piece, n in Counter(pieces).items():
        seed = one(xxhash.xxh64_intdigest(piece.encode(), 42), 42)
        for i in range(32):
            x = one(i, seed)
            for k in range(4):
                sketch[4 * i + k] += n * (x >> 15 * k & 1)
    return core, sketch, len(pieces)


def plain_text(core, sketch, n):
    words = [a | b << 31 for a, b in zip(sketch[::2], sketch[1::2])] + [n]
    return "".join(f"{c:08x}" for c in core) + "".join(f"{w:016x}" for w in words)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * v - n for v in lanes] for _, lanes, n in (a, b))
    norm = (sum(v * v for v in x) * sum(v * v for v in y)) ** 0.5
    return max(0.0, min(1.0, sum(v * w for v, w in zip(x, y)) / norm)) if norm else 0.0


def test_fingerprints_and_likeness_by_hand(spark):
    rng = random.Random(4)
    words = ["alpha", "béta", "gamma.", "delta\n", "漢字", "\n", "no! ", "𝄞 "]
    texts = ["", "x", "a b c.\n\nd", "one two three. four\n" * 40] + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 200))) for _ in range(20)]
    texts += ["alpha beta gamma delta. " * 20_000, "ab " * 100_000]
    got = {r.doc_id: r for r in finger(spark, list(enumerate(texts)))}
    lanes = [plain_lanes(t) for t in texts]
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = plain_lanes(t[: len(t) - len(t) // 4] + after[: len(t) // 4])
        assert got[i].fingerprint == plain_text(*lanes[i]) and got[i].edited_fingerprint == plain_text(*edited)
        assert abs(got[i].near_edited - plain_likeness(lanes[i], edited)) < 1e-9
        assert abs(got[i].near_next - plain_likeness(lanes[i], lanes[(i + 1) % len(texts)])) < 1e-9


def test_repeats_of_any_number_stay_alike(spark):
    for n in (2000, 9000, 12_000, 20_000, 100_000):
        rows = [(1, "alpha beta gamma delta. " * n), (2, "something else. " * n)]
        assert min(r.near_edited for r in finger(spark, rows)) > 0.8


def test_likeness_tells_copies_from_others(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(40)]
    got = finger(spark, list(enumerate(texts)))
    assert min(r.near_edited for r in got) > 0.5 > 0.4 > max(r.near_next for r in got)


# --- chat ---


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"name": F.lit(1), "part": F.lit("x")})


def digests(rows):
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    out = {}
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "system", "be <<SYS>> brief <</SYS>>"), (1, 1, "user", "hi\\! \\ [INST] </s>"), (1, 2, "assistant", "</s>[/INST]<s>\\"), (1, 2, "assistant", "</s>[/INST]<s>\\"),
    (2, 5, "assistant", None), (2, 1, None, "no role"), (3, 0, "user", ""), (None, 0, "user", "x"), (None, 1, "assistant", "é漢 [" * 10), (4, None, "assistant", "y"),
    (5, 0, "assistant", "<" * 3000), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def test_conversations_read_back(spark):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.conversation_digests(spark, conversation(spark, ROWS)).collect()}
    assert got == digests(ROWS)
    assert C.conversation_digests(spark, conversation(spark, [])).count() == 0


def test_a_long_conversation_streams_in_parts(spark, monkeypatch):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} [INST] " + "x" * 2000) for k in range(900)]
    parts = C.formatted(conversation(spark, rows)).select("part", F.length("text").alias("n"), "last").collect()
    assert len(parts) == 2 and sum(p["last"] for p in parts) == 1
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.conversation_digests(spark, conversation(spark, rows)).collect()} == digests(rows)


def test_escape_round_trip():
    escape, unescape = C.escaper(C.CONTROL)
    rng = random.Random(0)
    some = [*C.CONTROL, "\\", "!", "\\!", "<", "s>", "[", "INST]", "a", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 12)))
        safe = escape(text)
        assert unescape(safe) == text and not any(c in safe for c in C.CONTROL)


def render(source, messages=(), **kw):
    return list(C.compiled(source, **kw)(iter(messages)))


def test_templates():
    says = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "Yo"}]
    source = "{% for m in messages %}{{ m.role | upper }}:{% if m.role == 'assistant' and not (m.text == '') %}{% generation %}{{ m.text }}{% endgeneration %}{% elif m.text != '' %}{{ m.text|trim }}{% else %}-{% endif %};{% endfor %}"
    assert "".join(t for t, _ in render(source, says)) == "USER:Hi;ASSISTANT:Yo;"
    assert [t for t, loss in render(source, says) if loss] == ["Yo"]
    assert "".join(t for t, _ in render("{{ missing.field }}{{ 'a\\n' + \"b\" | upper }}")) == "a\nB"


def test_folding():
    fold = lambda s: C.fold_body(C.parse(s), C._filters(C.CONTROL))
    assert fold("a{{ 'b' + 'c' | upper }}{% if 'x' == 'y' %}no{% elif not '' %}d{% else %}e{% endif %}") == [("out", ("text", "abCd"))]
    assert fold("{% if '' %}x{% endif %}") == []


@pytest.mark.parametrize("bad", ["{% if x %}", "{% endfor %}", "{{ x | eval }}", "{{ 1 + }}", "{% for x messages %}{% endfor %}", "{{ x.__class__() }}", "{% import os %}"])
def test_the_language_is_closed(bad):
    with pytest.raises(C.TemplateError):
        C.compiled(bad)


def test_fields_are_entries_only():
    assert "".join(t for t, _ in render("{% for m in messages %}{{ m.__class__ }}{{ m.text.upper }}{% endfor %}", [{"text": "q"}])) == ""


# --- secrets ---


def plain_base(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def b64(data):
    return base64.b64encode(data).decode()


def der(*numbers):
    body = b"".join(b"\x02" + bytes([len(n)]) + n for n in numbers)
    return b"\x30" + (bytes([len(body)]) if len(body) < 128 else b"\x82" + struct.pack(">H", len(body))) + body


RNG = random.Random(9)
KEY = der(b"\x00", RNG.randbytes(100), RNG.randbytes(90), RNG.randbytes(3))
WIRE = b"".join(struct.pack(">I", len(x)) + x for x in (b"ssh-ed25519", RNG.randbytes(32)))
JWT = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": "1"})) + ".c2lnbmF0dXJl"


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    some = ["password", "PassWd", "api_key", "apikey", "token", "=", ":", " ", '"', "'", "abcdef012345", "AKIA", "ABCDEFGH12", "0123456789abcdef", "ſecret", "toKen", "-", ".", "é", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 14)))
        assert S.base_spans(text) == plain_base(text), text


def kinds(text):
    return [(S.KINDS[k], text[a:b]) for a, k, b in S.confirmed_spans(text)]


def test_confirmed_structures():
    assert kinds(f"x {b64(KEY)} y") == [("der", b64(KEY))]
    assert kinds(f"key: {KEY.hex()},") == [("der", KEY.hex())]
    assert kinds(f"ssh-ed25519 {b64(WIRE)} me@host") == [("ssh", b64(WIRE))]
    assert kinds(f"({JWT}).") == [("jwt", JWT)]
    pem = f"-----BEGIN PRIVATE KEY-----\n{b64(KEY)}\n-----END PRIVATE KEY-----"
    assert ("pem", pem) in kinds(f"a\n{pem}\nb")


def test_what_has_no_structure_is_left_alone():
    rng = random.Random(4)
    for _ in range(500):
        assert kinds(b64(rng.randbytes(60))) == []
        assert kinds("".join(rng.choice("abcdefghijklmnop/._-") for _ in range(80))) == []
    assert kinds(b64(KEY[:-1])) == [] and kinds(JWT.replace("eyJ", "eyK")) == [] and kinds("é" * 100) == []


def test_scan_over_a_table(spark):
    rows = [(1, None), (2, ""), (3, f"token = abcdefghijkl {JWT}"), (3, f"token = abcdefghijkl {JWT}"), (None, "AKIA" + "Z" * 16), (4, "f" * 200_000)]
    df = spark.createDataFrame(rows, DOC).withColumns({"spans": F.lit(1), "base_sha256": F.lit(2)})
    got = S.scan(spark, df).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex) for r in got) == [("1", 0, 0, 0), ("2", 0, 0, 0), ("3", 1, 0, 0), ("3", 1, 0, 0), ("4", 0, 0, 1), ("None", 0, 1, 0)]
    three = next(r for r in got if r.doc_id == 3)
    assert three.spans == f"assign:0:20,jwt:21:{21 + len(JWT)}" and three.base_sha256 == hashlib.sha256(b"assign:0:20").hexdigest()
    assert S.scan(spark, spark.createDataFrame([], DOC)).count() == 0
    assert S.redacted(f"a token = abcdefghijkl b {JWT}") == "a [SECRET] b [SECRET]"


def test_tokens_inside_longer_runs():
    bare = JWT.rsplit(".", 1)[0] + "."
    assert kinds(f"it was {JWT}. Next") == [("jwt", JWT)] and kinds(f"{JWT}...") == [("jwt", JWT)]
    for before in ("jwt=", "/a/", "key-", "x.", "monkey/", "=."):
        assert kinds(f"{before}{JWT}") == [("jwt", JWT)], before
        assert kinds(f"see {before}{bare} so") == [("jwt", bare)], before
    assert kinds(f"{JWT}.{JWT}") == [("jwt", JWT)] * 2
    assert kinds("ey" * 5000 + "." + "ey" * 5000 + ".") == []


def ssh_strings(*parts):
    return b"".join(struct.pack(">I", len(x)) + x for x in parts)


def test_key_files_must_hold_what_they_say():
    whole = S.SSH_HEADER + ssh_strings(b"none", b"none", b"") + struct.pack(">I", 1) + ssh_strings(WIRE, RNG.randbytes(160))
    assert S.is_ssh(whole)
    body = "\n".join(b64(whole)[i : i + 70] for i in range(0, len(b64(whole)), 70))
    pem = f"-----BEGIN OPENSSH PRIVATE KEY-----\n{body}\n-----END OPENSSH PRIVATE KEY-----"
    assert ("pem", pem) in kinds(f"see\n{pem}\n")
    for broken in (whole[:-1], whole + b"\0", S.SSH_HEADER + RNG.randbytes(200), S.SSH_HEADER, S.SSH_HEADER + ssh_strings(b"none", b"none", b"")):
        assert not S.is_ssh(broken)


def test_enciphered_pem():
    cipher = b64(RNG.randbytes(96))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{'0A' * 16}\n\n{cipher}\n-----END RSA PRIVATE KEY-----"
    assert kinds(f"a {pem} b") == [("pem", pem)]
    assert kinds(pem.replace(cipher, b64(RNG.randbytes(95)))) == [] and kinds(pem.replace("0A" * 16, "0A" * 5)) == []
    plain = f"-----BEGIN RSA PRIVATE KEY-----\nComment: mine\n{b64(KEY)}\n-----END RSA PRIVATE KEY-----"
    assert ("pem", plain) in kinds(plain)
