"""The ten operators against brute force, and their defined edge cases."""

import base64
import hashlib
import itertools
import json
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from verbatlas.llm import bm25_decontam, byte_bpe, chat_tree, components, embed_neardup, line_dedup, ngram_jaccard, quality_qda, secret_scan, suffix_dedup, token_pack
from verbatlas.llm.common import tokenizer_file
from verbatlas.llm.shingles import shingle_set

DOCS = "doc_id long, text string, id string, ids string, rank string, extra array<int>"
RANKS = tokenizer_file("byte_bpe_multi_50k.tiktoken")


def docs(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", "y", "z", [1]) for i, t in rows], DOCS)


EDGES = [(1, None), (2, ""), (3, " \n\t"), (None, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "Ünïcode ﬀ 漢字 " * 3000)]


def groups(pairs, keys):
    up = {k: k for k in keys}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {k: top(k) for k in keys}


def copies(r, n, bases=6, words=120):
    vocabulary = [f"w{k}" for k in range(300)]
    out = []
    for _ in range(bases):
        group = [[r.choice(vocabulary) for _ in range(r.choice([3, 7, 30, words]))]]
        for _ in range(n):
            new = list(r.choice(group))
            for _ in range(r.randint(0, 1 + len(new) // 40)):
                new[r.randrange(len(new))] = r.choice(vocabulary)
            group.append(new)
        out += [" ".join(g) for g in group]
    r.shuffle(out)
    return list(enumerate(out))


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)]
    want = groups(pairs, {x for p in pairs for x in p})
    got = {x.node: x.component for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}


@pytest.mark.parametrize(("words", "num"), [(4, 85), (5, 80)])
def test_jaccard(spark, words, num, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TILE", 5)
    rows = copies(random.Random(num), 12)
    sets = [(i, shingle_set(t, words)) for i, t in rows]
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if (c := len(np.intersect1d(a, b))) and 100 * c >= num * (len(a) + len(b) - c)]
    want = groups(links, [i for i, _ in rows])
    got = ngram_jaccard.link(docs(spark, rows), words, num, 100).collect()
    assert {x.doc_id: x.component_id for x in got} == want
    assert {x.doc_id: x.n_shingles for x in got} == {i: len(s) for i, s in sets}
    kept = ngram_jaccard.keep_one(docs(spark, rows), words, num, 100).collect()
    assert sorted(x.doc_id for x in kept) == sorted(set(want.values()))


def test_jaccard_edges(spark):
    got = [(x.doc_id, x.n_shingles, x.component_id) for x in ngram_jaccard.link(docs(spark, EDGES), 4, 85, 100).collect()]
    assert sorted(got, key=str)[:3] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert sum(1 for x in got if x[1] == 3 and x[2] is None) == 3  # the null id is the smallest of its group
    assert ngram_jaccard.link(docs(spark, []), 4, 85, 100).count() == 0


def test_jaccard_links_every_text_of_an_id(spark):
    say = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [(None, say("a", 203)), (None, say("b", 53)), (9, say("b", 53) + " end"), (4, say("c", 203)), (4, say("d", 53)), (6, say("d", 53) + " end"), (7, say("f", 30))]
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in ngram_jaccard.link(docs(spark, rows), 4, 85, 100).collect()}
    assert got == {(None, 200, None), (None, 50, None), (9, 51, None), (4, 200, 4), (4, 50, 4), (6, 51, 4), (7, 27, 7)}


def test_jaccard_keeps_rows_of_repeated_ids(spark):
    say = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    near = say("b") + " end"
    rows = [(None, say("a")), (None, say("b")), (None, say("c")), (5, say("d")), (5, say("e")), (9, near), (7, say("e") + " end"), (5, say("d")), (6, ""), (6, ""), (8, "")]
    kept = sorted(((x.doc_id, x.text) for x in ngram_jaccard.keep_one(docs(spark, rows), 5, 80, 100).collect()), key=str)
    assert kept == sorted([(None, say("a")), (None, say("b")), (None, say("c")), (5, say("d")), (5, say("e")), (6, ""), (8, "")], key=str)
    one = [(3, say("e")), (5, say("d")), (5, say("e"))]  # the other text of id 5 has no copy
    assert sorted((x.doc_id, x.text) for x in ngram_jaccard.keep_one(docs(spark, one), 5, 80, 100).collect()) == [(3, say("e")), (5, say("d"))]


def test_repeated_strings(spark):
    r = random.Random(2)
    base = ["".join(r.choice("abcdefgh é") for _ in range(300)) for _ in range(3)]
    rows = []
    for _ in range(60):
        a = r.randrange(250)
        rows.append((r.randrange(50) if r.random() > 0.05 else None, "".join(r.choice("xyz") for _ in range(r.randint(0, 60))) + r.choice(base)[a : a + r.randint(20, 200)]))
    rows += [(70, "q" * 130), (71, "q" * 90), rows[0], (80, None), (81, "")]
    want = sorted(((i, *x) for (i, _), x in zip(rows, suffix_dedup.brute_force(rows), strict=True)), key=str)
    assert sorted((tuple(x) for x in suffix_dedup.digest(docs(spark, rows)).collect()), key=str) == want
    assert suffix_dedup.digest(docs(spark, [])).count() == 0


def test_lines(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny\nb\nc\nd"), (3, "a\nb"), (4, "k\nk\nk\nk"), (5, None), (6, ""), (None, "p\nq\nr"), (7, "p\nq\nr\ns")]
    got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup(docs(spark, rows)).collect()}
    assert got == {1: ("a\nb\nc\nd", 0), 2: ("x\ny", 6), 3: ("a\nb", 0), 4: ("k", 3), 5: (None, 0), 6: ("", 0), None: ("p\nq\nr", 0), 7: ("s", 3)}
    assert line_dedup.dedup(docs(spark, [])).count() == 0


def test_lines_of_hot_windows_and_clashing_columns(spark):
    r = random.Random(18)
    rows = [(i if i % 7 else None, "\n".join(["hot 1", "hot 2", "hot 3"] * (i % 3 == 0) + [f"{r.randrange(30)}" for _ in range(r.randint(0, 9))])) for i in range(300)] + [(11, None), (11, ""), (11, "long\n" * 5000)]
    df = spark.createDataFrame([(i, t, "a", "b", [3], 1, 2) for i, t in rows], "doc_id long, text string, _i string, starts string, lines array<int>, n_lines int, i int")
    want = {}
    seen = {}
    order = lambda i, t: (-(2**63) if i is None else i, xx(t))
    hashes = {x.text: x.h for x in df.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    xx = lambda t: hashes[t]
    for i, t in sorted(set(rows), key=lambda x: order(*x)):
        parts, gone = (t or "").split("\n"), set()
        for k in range(len(parts) - 2):
            if seen.setdefault(tuple(parts[k : k + 3]), (i, t, k)) != (i, t, k):
                gone |= {k, k + 1, k + 2}
        want[i, t] = "\n".join(p for k, p in enumerate(parts) if k not in gone) if t is not None else None
    got = line_dedup.dedup(df).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted(((i, want[i, t]) for i, t in rows), key=str)
    assert line_dedup.dedup(df).columns == ["doc_id", "text", "_i", "starts", "lines", "i", "n_lines", "n_removed"]
    kept = line_dedup.clean(df, size="n_lines")
    assert kept.columns == df.columns and kept.schema == df.schema
    assert all(x["_i"] == "a" and x.lines == [3] and x.i == 2 for x in kept.collect())


def test_spread_join(spark):
    from verbatlas.llm.common import spread_join

    rows = spark.range(200_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id DIV 10 END AS k")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", F.col("k") * 2)
    got = spread_join(rows, table, ["k"])
    assert got.count() == 200_000 and got.filter("v <> 2 * k").count() == 0
    assert got.agg(F.count_distinct("id")).first()[0] == 200_000


def test_vectors_of_many_dimensions():
    """Copies stay few, and linked pairs keep meeting, whatever the number of dimensions."""
    r = np.random.default_rng(19)
    for dim in (64, 768, 1536, 4096):
        x = r.standard_normal((2000, dim))
        noise = r.standard_normal((2000, dim))
        y = x + 0.4 * noise * np.linalg.norm(x, axis=1, keepdims=True) / np.linalg.norm(noise, axis=1, keepdims=True)
        both = np.concatenate([x, y])
        both /= np.linalg.norm(both, axis=1, keepdims=True)
        spill = embed_neardup.margin_of(0.9, dim, 0.36)
        cuts = embed_neardup.fit_cuts(both, 8, 128, spill)
        met, copies = np.zeros(2000, bool), 0
        for tree in range(8):
            out = []
            embed_neardup._descend(both, np.arange(4000), tree, 1, cuts, spill, out)
            copies += sum(len(rows) for _, rows in out)
            for _, rows in out:
                own = np.zeros(4000, bool)
                own[rows] = True
                met |= own[:2000] & own[2000:]
        assert copies <= 8 * 4000 * 2.5, (dim, copies)
        linked = (both[:2000] * both[2000:]).sum(1) >= 0.9
        assert linked.sum() > 1000 and met[linked].mean() >= 0.98, (dim, met[linked].mean())


def test_vectors_of_double_range_and_ragged_lengths(spark):
    rows = [(i, [1e300 * (1 + (i % 3)), 1e300]) for i in range(6)] + [(10 + n, [1.0] * n) for n in range(1, 40)] + [(60, [1.0] * 20), (None, [2.0, 2.0]), (None, [5.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((x.vec_id, x.n_links, x.component_id) for x in embed_neardup.link(df).collect()), key=str)
    want = []
    for k, (i, v) in enumerate(rows):
        near = lambda u: len(u) == len(v) and np.dot(np.array(u) / max(u), np.array(v) / max(v)) / np.linalg.norm(np.array(u) / max(u)) / np.linalg.norm(np.array(v) / max(v)) >= 0.9  # noqa: B023, E731
        want.append((i, sum(near(u) for m, (_, u) in enumerate(rows) if m != k)))
    assert sorted(((i, n) for i, n, _ in got), key=str) == sorted(want, key=str)


def test_vectors(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + r.standard_normal(16) * r.choice([0.05, 0.3])).tolist()) for i in range(400)]
    rows += [(900 + k, rows[0][1]) for k in range(5)] + [(950, None), (951, [0.0] * 16), (952, [float("nan")] + [1.0] * 15), (953, []), (954, [1.0, 2.0])]
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(good, 2) if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9]
    want = groups(links, [i for i, _ in rows])
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = embed_neardup.link(df, leaf_rows=40).collect()
    n = dict.fromkeys((i for i, _ in rows), 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert sum(x.n_links for x in got) >= 0.97 * sum(n.values())
    assert all(x.n_links <= n[x.vec_id] for x in got)
    assert sum(want[x.vec_id] == x.component_id for x in got) >= 0.97 * len(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)
    assert embed_neardup.link(df.limit(0)).count() == 0


def test_secrets(spark):
    integer = lambda n: b"\x02" + bytes([len(n)]) + n
    body = integer(b"\0") + b"".join(integer(bytes([3 + k] * 6)) for k in range(8))
    der = base64.b64encode(b"\x30" + bytes([len(body)]) + body).decode()
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    jwt = f"{head}.eyJhIjoxfQ.c2lnbmF0dXJl"
    texts = [
        'Token = "abcdefghijkl" AKIA' + "A1" * 8 + " é " + "0123456789abcdef",
        f"x {jwt} y",
        f"k {der} .",
        "token=secret :=abcdefghijklmnop",
        "A" * 60 + " " + "deadbeef" * 6,
        None,
        "",
    ]
    got = {x.doc_id: x for x in secret_scan.digest(docs(spark, list(enumerate(texts)))).collect()}
    spans = {i: [s.split(":")[0] for s in x.spans.split(",") if s] for i, x in got.items()}
    assert spans == {0: ["assign", "access", "hex"], 1: ["jwt"], 2: ["der"], 3: [], 4: ["hex"], 5: [], 6: []}
    assert got[0].base_sha256 == hashlib.sha256(got[0].spans.encode()).hexdigest()
    assert not secret_scan.is_der_key(base64.b64decode(der)[:-1]) and not secret_scan.is_token_header("abcd")
    assert secret_scan.digest(docs(spark, [])).count() == 0


def test_secrets_in_url_safe_runs():
    part = lambda tag, data: bytes([tag, len(data)]) + data
    r = random.Random(5)
    for k in range(200):
        octets = part(0x04, r.randbytes(60 + k % 3))
        data = part(0x30, part(0x02, b"\0") + part(0x30, part(0x06, b"\x2a\x86\x48")) + octets)
        for code in (base64.urlsafe_b64encode(data).decode(), base64.b64encode(data).decode()):
            for before, after in (("", ""), ("x ", " y"), ("key-", "")) + ((("a/", ""), ("", "_b"), ("", "/b")) if not code.endswith("=") else ()):
                assert secret_scan.confirmed_spans(before + code + after).get("der") == [(len(before), len(before + code))], (before, code, after)
    field = lambda data: len(data).to_bytes(4, "big") + data
    for k in range(50):
        code = base64.urlsafe_b64encode(field(b"ssh-ed25519") + field(r.randbytes(33))).decode()
        assert secret_scan.confirmed_spans("k_" + code + " z").get("ssh") == [(2, 2 + len(code))]
        code = base64.urlsafe_b64encode(b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + r.randbytes(90)).decode()
        assert secret_scan.confirmed_spans(code + " z").get("ssh") == [(0, len(code))]
    head = base64.urlsafe_b64encode(json.dumps({"alg": "none"}).encode()).decode().rstrip("=")
    token = f"{head}.e30.eyJhIjoxfQ"
    assert secret_scan.confirmed_spans(f"sessionid.{token} z")["jwt"] == [(10, 10 + len(token))]
    assert secret_scan.confirmed_spans(f"somehost1.sessionid.{token}")["jwt"] == [(20, 20 + len(token))]


def test_secrets_with_headers_lines_and_public_keys():
    part = lambda tag, data: bytes([tag]) + (bytes([len(data)]) if len(data) < 128 else b"\x82" + len(data).to_bytes(2, "big")) + data
    r = random.Random(15)
    algorithm = part(0x30, part(0x06, b"\x2a\x86\x48"))
    private = part(0x30, part(0x02, b"\0") + algorithm + part(0x04, r.randbytes(300)))
    public = part(0x30, algorithm + part(0x03, b"\0" + r.randbytes(80)))
    wrap = lambda data, n: "\n".join(base64.b64encode(data[k : k + n * 3 // 4]).decode() for k in range(0, len(data), n * 3 // 4))
    block = lambda name, head, body: f"-----BEGIN {name}-----\n{head}{body}\n-----END {name}-----"
    spans = lambda text: {k: v for k, v in secret_scan.confirmed_spans(text).items() if v}
    for n in (64, 76):
        assert spans("see\n" + wrap(private, n) + "\nend") == {"der": [(4, 4 + len(wrap(private, n)))]}
        text = block("PRIVATE KEY", "", wrap(private, n))
        assert spans("a " + text) == {"pem": [(2, 2 + len(text))]}  # and not its body once more
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0A" * 16 + "\n\n"
    text = block("RSA PRIVATE KEY", head, wrap(r.randbytes(320), 64))
    assert spans(text) == {"pem": [(0, len(text))]}
    assert spans(block("RSA PRIVATE KEY", head.replace("DEK-Info", "X-Info"), wrap(r.randbytes(320), 64))) == {}
    text = block("PUBLIC KEY", "", wrap(public, 64))
    assert spans(text) == {"pem": [(0, len(text))]} and secret_scan.public_span(text)
    assert spans("x " + base64.b64encode(public).decode())["der"][0][0] == 2 and secret_scan.is_public(public) and not secret_scan.is_public(private)
    assert secret_scan.public_span(public.hex()) and not secret_scan.public_span(private.hex())
    header = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    assert spans(f"{header}.AAAAAAAA.c2lnbmF0dXJl") == {}  # the payload is no JSON


def test_base_secrets_by_plain_scanning(spark):
    """Base spans against a scanner without regular expressions, over whole documents."""
    letters = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")

    def run_of(text, at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    def plain(text):
        out, low = [], "".join(c.lower() if c.isascii() else c for c in text)
        at = 0
        while at < len(text):
            name = next((n for n in names if low.startswith(n, at)), None)
            if name:
                # quotes and blanks are optional, so every way through them is tried, the longest first as a pattern does
                k = at + len(name)
                for q in ((k + 1, k) if text[k : k + 1] in ('"', "'") and k < len(text) else (k,)):
                    b = run_of(text, q, " ")
                    if b < len(text) and text[b] in ":=":
                        v = run_of(text, b + 1, " ")
                        opened = v + 1 if v < len(text) and text[v] in "\"'" else v
                        end = run_of(text, opened, letters)
                        if end > opened:
                            if end - opened >= 12:
                                out.append((at, "assign", end))
                            at = end - 1
                            break
            at += 1
        for kind, head, allowed, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), ("hex", "", set("0123456789abcdef"), 16)):
            at = 0
            while at < len(text):
                end = run_of(text, at + len(head), allowed) if text.startswith(head, at) else at
                if end > at + len(head):
                    if end - at >= least:
                        out.append((at, kind, end))
                    at = end
                else:
                    at += 1
        order = {"assign": 0, "access": 1, "hex": 2}
        return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(out, key=lambda x: (x[0], order[x[1]])))

    r = random.Random(16)
    bits = ["password", "API_KEY", "apikey", "Token", "secret", '"', "'", " ", ":", "=", "abcdef012345", "AKIA", "A1B2C3D4E5F6G7", "deadbeefdeadbeef", "é", "\n", "K", "\u212a", "zz", "."]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for k in range(3000)]
    rows += [(r_.doc_id + 10_000, r_.text) for r_ in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(9000, ("x " * 50_000) + 'token="abcdefghijklmno"'), (9001, None), (None, "secret=abcdefghijklm"), (9002, "secret=abcdefghijklm"), (9002, "secret=abcdefghijklm")]
    got = secret_scan.digest(docs(spark, rows)).collect()
    want = sorted((str(i), hashlib.sha256(plain(t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(x.doc_id), x.base_sha256) for x in got) == want
    assert all(x.n_assign + x.n_access + x.n_hex == len([s for s in x.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]) for x in got)


def test_encoder(spark):
    ranks = byte_bpe.read_ranks(RANKS)
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = byte_bpe.PrefixCoder(ranks, public_tokenizers.PATTERN)
    r = random.Random(4)
    for _ in range(500):
        text = "".join(r.choice(["a", "th", "e", " ", "\n", "é", "漢", "'s", "'", "r", "1", ".", "  ", "😀", "tion"]) for _ in range(r.randint(0, 40)))
        live = byte_bpe.LiveText(coder, text[:10])
        live.append(text[10:])
        at = r.randint(0, len(text))
        live.replace(at, min(len(text), at + 2), "'re")
        assert coder.encode(text) == theirs.encode_ordinary(text)
        assert live.ids() == theirs.encode_ordinary(text[:at] + "'re" + text[min(len(text), at + 2) :])
        assert coder.decode(coder.encode(text)).decode() == text
    got = byte_bpe.digest(docs(spark, EDGES), RANKS, public_tokenizers.PATTERN).collect()
    for (i, t), x in zip(sorted(EDGES, key=str), sorted(got, key=lambda x: str((x.doc_id,))), strict=True):
        ids = [theirs.encode_ordinary(u or "") for j, u in EDGES if j == x.doc_id]
        assert x.decoded_sha256 in {hashlib.sha256((u or "").encode()).hexdigest() for j, u in EDGES if j == x.doc_id}
        assert x.ids_sha256 in {hashlib.sha256(",".join(map(str, k)).encode()).hexdigest() for k in ids} and x.n_tokens in map(len, ids)
    coded = byte_bpe.encode(docs(spark, EDGES), RANKS, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "id", "rank", "extra", "ids"]
    assert all(bytes(x.decoded).decode() == (x.text or "") for x in byte_bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect())
    assert byte_bpe.digest(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing(spark):
    r = random.Random(5)
    for _ in range(50):
        sizes = [r.randint(0, 30) for _ in range(r.randint(0, 60))]
        rows = token_pack.best_fit_decreasing(sizes, 30)
        assert sorted(i for x in rows for i in x) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in x) <= 30 for x in rows)
        room: list[int] = []  # best fit by a plain search
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = [k for k in range(len(room)) if room[k] >= sizes[i]]
            if fit:
                room[min(fit, key=lambda k: room[k])] -= sizes[i]
            else:
                room.append(30 - sizes[i])
        assert sorted(30 - sum(sizes[i] for i in x) for x in rows) == sorted(room)
    packed = token_pack.pack(docs(spark, EDGES), RANKS, public_tokenizers.PATTERN, capacity=64)
    for x in packed.collect():
        places = np.frombuffer(x.positions, f"<u{x.width}")
        assert x.cu_seqlens[-1] == x.n_tokens <= 64 and all(places[a] == 0 for a, b in zip(x.cu_seqlens, x.cu_seqlens[1:]) if b > a)
    parts = token_pack.unpack(packed).orderBy("doc_id", "part").collect()
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    assert [t for x in parts if x.doc_id == 5 for t in x.ids] == theirs.encode_ordinary(EDGES[-1][1])
    assert {x.doc_id for x in parts} == {None, 1, 2, 3, 4, 5}
    assert token_pack.pack(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_decontamination(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    items = [(k, " ".join(word() for _ in range(r.randint(8, 30))) + ". " + " ".join(word() for _ in range(5)) + ".") for k in range(60)] + [(60, None), (61, "")]
    texts = [" ".join(word() for _ in range(r.randint(0, 300))) for _ in range(60)]
    held = {}
    for k in range(0, 60, 3):
        at = texts[k].find(" ") + 1
        texts[k] = texts[k][:at] + items[k][1].upper() + " " + texts[k][at:]
        held[k] = k
    rows = [*enumerate(texts), (97, None), (98, "")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in bm25_decontam.search(docs(spark, rows), table).collect()}
    assert got == set(held.items())
    assert {x.doc_id for x in bm25_decontam.clean(docs(spark, rows), table).collect()} == {i for i, _ in rows} - set(held)
    assert bm25_decontam.search(docs(spark, rows), table.limit(0)).count() == 0
    # every passage and item by a plain sum, against the pruned search
    kept = [x for x in items if bm25_decontam.words_of(x[1])]
    df = {}
    for _, t in kept:
        for w in set(bm25_decontam.words_of(t)):
            df[w] = df.get(w, 0) + 1
    index = bm25_decontam.build(items, df, len(kept), 20.0)
    assert len(index.parts) > 1 and sum(len(p.items) for p in index.parts) == len(kept)
    words = [bm25_decontam.words_of(t) for t in texts]
    for part in index.parts:
        found = {x[:3] for x in bm25_decontam.retrieve(index, part, words, 0.3)}
        impacts = {}  # by item and term, from the formula
        for j, (_, text) in enumerate(part.items):
            own = bm25_decontam.words_of(text)
            w = {x: np.log(1 + (len(kept) - df[x] + 0.5) / (df[x] + 0.5)) * own.count(x) * 2.2 / (own.count(x) + 1.2 * (0.25 + 0.75 * len(own) / 20)) for x in set(own)}
            impacts[j] = {x: v / sum(w.values()) for x, v in w.items()}
        want = set()
        for k, w in enumerate(words):
            for a in range(0, max(1, len(w)), part.span):
                own = set(w[a : a + 2 * part.span])
                want |= {(k, a, j) for j, of in impacts.items() if sum(v for x, v in of.items() if x in own) >= 0.3}
        assert found == want


def test_decontamination_of_many_items():
    """14,000 items fit a worker; a long item leaves the passages of short ones alone."""
    r = random.Random(60)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(30_000)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(20, 60)))) for k in range(14_000)] + [(-1, " ".join(vocabulary[:3000]))]
    df = {}
    for _, t in items:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    index = bm25_decontam.build(items, df, len(items), 40.0)
    assert sum(x.nbytes for p in index.parts for x in (p.cuts, p.item, p.impact, p.block_max, p.list_max)) < 64 << 20
    assert sorted(p.span for p in index.parts)[-2] <= 63
    held = r.sample(range(14_000), 40)
    texts = [" ".join(r.choice(vocabulary) for _ in range(50)) + " " + items[k][1] for k in held] + [items[-1][1]]
    got = [{index.parts[p].items[i][0] for p, i in hits} for hits in bm25_decontam.matches(index, texts, 0.8)]
    assert got == [{k} for k in held] + [{-1}]


def test_quality(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(1, 8)))
    rows, labels = [(1000, None), (1001, "")], []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, " ".join(word() + ("###" if bad else "") for _ in range(r.randint(20, 80)))))
        labels.append((i, 0 if bad else 1, 0))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality_qda.classify(docs(spark, rows), table).collect()}
    assert len(got) == 302 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    out = [got[i].predicted == q for i, q, _ in labels if got[i].held_out]
    assert sum(out) >= 0.98 * len(out)
    assert {x.doc_id for x in quality_qda.keep_good(docs(spark, rows), table).collect()} == {i for i, x in got.items() if x.predicted}
    assert quality_qda.classify(docs(spark, []), table.limit(0)).count() == 0


def test_quality_by_a_plain_discriminant(spark):
    """Scores against the formulas written out with numpy over all statistics at once."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(1, 8)))
    rows, labels = [], []
    for i in range(200):
        rows.append((i, " ".join(word() + ("#" if r.random() < (0.5 if i % 3 == 0 else 0.02) else "") for _ in range(r.randint(5, 60)))))
        labels += [(i, int(i % 3 != 0), 0)]
    rows += [(None, "one null id"), (None, "one null id"), (3, rows[3][1]), (500, "x " * 200_000)]
    labels += [(None, 1, 0), (5, None, 0), (6, 7, 0), (7, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_qda.classify(docs(spark, rows), table).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    least = {}
    for i, q, _ in labels:
        if i is not None and q in (0, 1) and not held(i):
            least[i] = min(q, least.get(i, q))
    x = np.array([quality_qda.statistics(t) for _, t in rows])
    y = np.array([least.get(i, -1) for i, _ in rows])
    both = x[y >= 0]
    z = (x - both.mean(0)) / np.maximum(both.std(0), 1e-4)
    d, logs, cov = x.shape[1], [], {c: np.cov(z[y == c].T, bias=True) for c in (0, 1)}
    n = {c: int((y == c).sum()) for c in (0, 1)}
    pooled = sum(n[c] * cov[c] for c in (0, 1)) / sum(n.values())
    for c in (0, 1):
        w = max(0.1, d / (d + n[c]))
        own = (1 - w) * cov[c] + w * (pooled + np.diag(np.diag(pooled))) / 2 + 1e-3 * np.eye(d)
        away = z - z[y == c].mean(0)
        logs.append(np.log(n[c] / sum(n.values())) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * (away @ np.linalg.inv(own) * away).sum(1))
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -40, 40)))
    key = lambda v: (str(v[0]), v[1])
    for (i, s), g in zip(sorted(zip([i for i, _ in rows], want, strict=True), key=key), sorted(got, key=lambda v: (str(v.doc_id), v.score)), strict=True):
        assert g.doc_id == i and abs(g.score - s) < 1e-6 and g.held_out == held(i) and g.predicted == int(g.score >= 0.3)
    one = quality_qda.classify(docs(spark, rows), table.filter("quality = 1")).collect()  # one class only: the smoothed share
    assert len({x.score for x in one}) == 1 and one[0].score > 0.9


def test_trees(spark):
    rows = [(1, 1, None, "user", "hi #1", 0.0), (1, 2, 1, "assistant", "a\\</turn>", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 3, "user", None, 0.0), (1, 5, 2, "user", "c", 2.0), (2, 7, 99, None, "### x", None), (3, 8, 9, "user", "", 0.0), (3, 9, 8, "user", "", 0.0)]
    df = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    read = {x.conv_id: x for x in chat_tree.read_back(chat_tree.format_paths(df)).collect()}
    assert [tuple(t) for t in read[1].turns] == [("user", "hi #1"), ("assistant", "b"), ("user", "")]
    assert read[1].loss == ["b"] and [tuple(t) for t in read[2].turns] == [("", "### x")] and 3 not in read
    both = chat_tree.read_back(chat_tree.format_paths(df.filter("conv_id = 1"), branches=2)).collect()
    assert sorted(len(x.turns) for x in both) == [3, 3]
    long = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(100)], "conv_id long, turn long, role string, text string")
    assert chat_tree.digest(chat_tree.chain(long)).first().n_turns == 100
    assert chat_tree.digest(chat_tree.chain(long.limit(0))).count() == 0


def test_chat_has_the_best_path_of_each_root(spark):
    rows = [(1, 1, None, 5.0), (1, 2, 1, 1.0), (1, 3, 1, 2.0), (1, 4, None, 0.0), (1, 5, 4, 1.0), (1, 6, 5, 1.0), (1, 7, 99, 0.5), (1, 8, None, 0.0), (2, 1, None, 0.0)]
    df = spark.createDataFrame([(c, i, up, "user", f"m{i}", s) for c, i, up, s in rows], "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    read = chat_tree.read_back(chat_tree.format_paths(df)).collect()
    got = sorted((x.conv_id, [t.text for t in x.turns]) for x in read)
    assert got == [(1, ["m1", "m3"]), (1, ["m4", "m5", "m6"]), (1, ["m7"]), (1, ["m8"]), (2, ["m1"])]
