"""Merkle manifest, exact top-k search and conversation repair against brute force, and their defined edge cases."""

import hashlib
import heapq
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from verbatlas.llm import merkle, queries, turn_repair, va_file

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_exact_topk", "op13_turn_repair"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(DIR):
        con.execute(f"CREATE VIEW {table[:-8]} AS SELECT * FROM read_parquet('{DIR}/{table}')")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr(list(r)) for r in found.fetchall())


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, fan):
    def leaf(doc, source, lang, n_chars, text, low=False):
        if low and text is not None:
            text = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            start = i // fan * fan
            yield i - start, level[start : start + fan]
            i //= fan

    trees = []
    for source in sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append((own, tree([leaf(*r) for r in own])))
    upper = tree([t[-1][0] for _, t in trees])
    out = []
    for k, (own, levels) in enumerate(trees):
        for i, r in enumerate(own):
            way = [*path(levels, i), *path(upper, k)]
            at = leaf(*r, low=r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for place, run in way:
                at = digest("".join([*run[:place], at, *run[place + 1 :]]))
            proof = digest("".join("".join(run[:place] + run[place + 1 :]) for place, run in way))
            out.append((r[0], leaf(*r), levels[-1][0], upper[-1][0], proof, at, at == upper[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fan", "levels"), [(2, 2), (3, 1), (16, 1), (16, 3)])
def test_manifest_of_odd_rows(spark, fan, levels):
    r = random.Random(fan)
    rows = [
        (r.choice([None, *range(60)]), r.choice(["a", "A", "é", "z", None, "b", *["hot"] * 5]), r.choice([None, "en"]), r.choice([None, 3]), r.choice([None, "", "ABC", "xyz", "Ü" * 500]))
        for _ in range(700)
    ]
    df = spark.createDataFrame([(*x, "p", 1) for x in rows], "doc_id long, source string, lang string, n_chars int, text string, leaf string, idx int")
    found = merkle.manifest(df, fan, levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, found.collect()), key=repr) == plain_manifest(rows, fan)
    assert merkle.manifest(df.limit(0)).collect() == []


def test_traversal_holds_two_runs_a_level():
    leaves = [digest(str(i)).encode() for i in range(75)]
    seen = 0
    for i, runs in merkle.traverse(leaves, merkle.height_of(75, 4), 4):
        assert len(runs) == 4 and all(1 <= len(run) <= 4 for run in runs)
        assert runs[0] == leaves[i // 4 * 4 : i // 4 * 4 + 4]
        assert merkle.join_digests(runs[0]) == runs[1][i // 4 % 4]
        seen += 1
    assert seen == 75


def plain_top(rows, k, every):
    top = 2**62
    cell = lambda x: (top if x > 0 else -top) if math.isinf(64 * x) else max(-top, min(top, math.floor(64 * x)))
    good = [(n, i, [cell(x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, limit = [], 2**63 - 1
    for n, i, v in good:
        if i is not None and i % every == 0:
            scores = [(-max(-limit, min(limit, sum(a * b for a, b in zip(v, w, strict=True)))), -(2**63) if j is None else j) for m, j, w in good if m != n and len(w) == len(v)]
            out += [(i, rank, None if j == -(2**63) else j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [{}, {"k": 3, "every": 5, "query_rows": 7, "block_rows": 50}, {"k": 5, "every": 7, "cells": 3}])
def test_top_of_odd_vectors(spark, settings):
    r = random.Random(3)
    base = [[r.gauss(0, 0.3) for _ in range(6)] for _ in range(40)]
    rows = []
    for n in range(600):
        v = list(r.choice(base[:3] if r.random() < 0.5 else base))  # groups of copies
        if r.random() < 0.3:
            v[r.randrange(6)] += r.gauss(0, 0.02)
        rows.append((r.choice([None, n, n, n, n % 50, -n]), v))
    rows += [(20, None), (40, [None, 1.0]), (60, [float("nan")] * 6), (80, [float("inf")] * 6), (100, []), (120, []), (140, [1e300] * 6), (160, [-1e300] * 6), (180, [1e12] * 6), (200, [3.0]), (0, [0.0] * 6)]
    rows += rows[:60]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "vec_id long, embedding array<double>, h string, dim int")
    found = sorted(map(tuple, va_file.search(df, **settings).collect()), key=repr)
    assert found == plain_top(rows, settings.get("k", 20), settings.get("every", 20))


def test_top_of_nothing(spark):
    assert va_file.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_cells_hold_their_vectors_and_bounds_their_scores():
    r = np.random.default_rng(1)
    x = r.integers(-90, 90, (400, 8))
    cells = va_file.Cells(va_file.cut_cells(list(x[:50]), 9)[8], 100)
    low, high = cells.spans(cells.codes(x))
    assert ((low <= x) & (x <= high)).all() and (high - low).mean() < 60
    scan = va_file.Scan(list(range(20)), x[:20], 5, 100)
    scan.add(np.arange(400), low, high)
    scan.shrink()
    q, c, bound = scan.held[0]
    assert (bound >= 2 * (x[q] * x[c]).sum(1)).all()
    exact = x[:20] @ x.T
    for k in range(20):
        assert set(np.flatnonzero(exact[k] >= np.sort(exact[k])[-5])) <= set(c[q == k])


def plain_repair(rows, damage=True):
    legal = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    convs = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        own = convs.setdefault(c, [])
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            own += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = []
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in own if r[0] is not None]
        faults, seen = [], set()
        for _, role, text in own:
            last = re.findall("[^\x20\x09-\x0d]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        # a shortest-path search over (rows done, state), in the order of (cost, audit)
        queue, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, at, state, lines = heapq.heappop(queue)
            if (at, state) in done:
                continue
            done.add((at, state))
            if at == len(own) and state in (0, 3):
                break
            moves = [(2, "I", 0, x, f"{y}:") for x, y in (("u", "user"), ("a", "assistant"))]
            if at < len(own):
                _, role, text = own[at]
                heapq.heappush(queue, (cost + 3, audit + "D", at + 1, state, lines))
                if faults[at] not in ("blank", "duplicate"):
                    extra = faults[at] == "truncated"
                    moves += [(extra, "K", 1, role[:1], f"{role}:{text}")] + [(2 + extra, "R", 1, x, f"{y}:{text}") for x, y in (("u", "user"), ("a", "assistant"))]
            for more, letter, step, initial, line in moves:
                if (initial, state) in legal:
                    heapq.heappush(queue, (cost + more, audit + letter, at + step, legal[initial, state], (*lines, line)))
        clash = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), clash, cost, audit, digest("\n".join(lines))))
    return sorted(out, key=repr)


def repaired(df, **settings):
    columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted(map(tuple, turn_repair.repair(df, **settings).select(*columns).collect()), key=repr)


@pytest.mark.parametrize("stretch", [2, 1024])
def test_repair_of_the_table(spark, stretch):
    df = spark.read.parquet(f"{DIR}/conversations.parquet")
    assert repaired(df, stretch=stretch) == plain_repair([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


@pytest.mark.parametrize(("damage", "stretch"), [(True, 1024), (True, 7), (False, 5)])
def test_repair_of_odd_rows(spark, damage, stretch):
    r = random.Random(stretch)
    texts = [None, "", " \t\n", "ok.", "ok", "yes! ", "no?", "Ünï。", "a" * 50]
    rows = [
        (r.choice([None, 1, 2, 3, 4, 5, *[7] * 6]), r.choice([None, *range(300)]), r.choice(["user", "assistant", "system", "tool", "", None, "unit"]), r.choice(texts) or f"{r.random()}{r.choice('.!?x')}")
        for _ in range(900)
    ]
    df = spark.createDataFrame([(*x, "z", 1) for x in rows], "conv_id long, turn long, role string, text string, seg string, c int")
    assert repaired(df, damage=damage, stretch=stretch) == plain_repair(rows, damage)
    assert repaired(df.limit(0)) == []
