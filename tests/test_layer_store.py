"""The stored topic layer: only changed keys are redone, and a state equals the whole join."""

import os
import random

from verbatlas.sources import layer_store


def sides(spark, docs, rows):
    return (
        spark.createDataFrame([(k, *v) for k, v in docs.items()], "key string, title string, day string"),
        spark.createDataFrame([(k, v) for k, v in rows.items()], "key string, themes array<string>"),
    )


def test_refreshes_equal_the_whole_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layer_store, "MOST_DELTAS", 2)
    draw, folder = random.Random(3), str(tmp_path / "layer")
    docs = {f"k{i}": (f"t{i}", None) for i in range(12)}
    rows = {f"k{i}": ["A"] if i % 3 else None for i in range(2, 15)}
    seen = {}
    for step in range(8):
        got = {r.key: r.change for r in layer_store.refresh(*sides(spark, docs, rows), folder).collect()}
        now = {k: (docs[k], rows[k]) for k in docs.keys() & rows.keys()}
        want = {k: "added" for k in now.keys() - seen.keys()} | {k: "removed" for k in seen.keys() - now.keys()}
        for k in now.keys() & seen.keys():
            a, b = now[k][0] != seen[k][0], now[k][1] != seen[k][1]
            if a or b:
                want[k] = "both" if a and b else "document" if a else "tags"
        assert got == want, step
        held = {r.key: ((r.doc.title, r.doc.day), r.row.themes) for r in layer_store.current(spark, folder).collect()}
        assert held == now, step
        seen = now
        k = f"k{draw.randrange(15)}"
        docs[k] = (f"new {step}", "2016") if draw.random() < 0.7 else docs.get(k, ("x", None))
        rows[f"k{draw.randrange(15)}"] = [f"T{step}"] if step % 2 else []
        docs.pop(f"k{draw.randrange(15)}", None)
    assert len(layer_store._tables(spark, folder)) <= 3  # bases were written
    assert "delta-0" not in os.listdir(folder) and sum(n.startswith("base") for n in os.listdir(folder)) == 2  # and what is before the last two deleted


def test_nulls_repeats_and_nothing(spark, tmp_path):
    folder = str(tmp_path / "layer")
    docs, rows = sides(spark, {"a": ("t", None), None: ("n", None)}, {"a": ["x"], None: ["y"]})
    first = layer_store.refresh(docs.unionByName(docs), rows, folder)
    assert [tuple(r) for r in first.collect()] == [("a", "added")]
    assert layer_store.refresh(docs, rows, folder).count() == 0 and layer_store.current(spark, folder).count() == 1
    assert [tuple(r) for r in layer_store.refresh(docs.limit(0), rows, folder).collect()] == [("a", "removed")]
    assert layer_store.current(spark, folder).count() == 0
    assert layer_store.refresh(docs, rows, folder).first().change == "added"
