"""The pipeline's stages against brute force on a small fixture, each on its own input."""

import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from verbatlas.llm import byte_bpe
from verbatlas.llm.common import tokenizer_file


def test_stages(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("etaoinshrd") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(120):
        bad = i % 5 == 0
        rows.append((i, "\n".join(" ".join(word() + ("%%%" if bad else "") for _ in range(12)) for _ in range(4))))
        labels.append((i, 0 if bad else 1, 0))
    item = " ".join(word() for _ in range(20)) + "."
    rows[3] = (3, rows[3][1] + "\n" + item)
    rows[7] = (7, rows[6][1].replace("\n", " ") + " extra")  # near copy of 6
    rows[6] = (6, rows[6][1].replace("\n", " "))
    rows[9] = (9, rows[9][1] + "\n" + rows[8][1])  # holds the lines of 8
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = dict(rows)
    good = {i for i, q, _ in labels if q}
    text[9] = "\n".join(text[9].split("\n")[:4])
    want = [good, good, good - {7}, good - {7, 3}]
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {x.doc_id for x in docs.collect()} == ids, name
    assert {x.doc_id: x.text for x in docs.collect()} == {i: text[i] for i in want[-1]}
    ranks = byte_bpe.read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda t: hashlib.sha256(",".join(map(str, theirs.encode_ordinary(t))).encode()).hexdigest()
    assert {x.doc_id: x.ids_sha256 for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i: digest(text[i]) for i in want[-1]}


def test_stages_keep_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and ids, empty tables and clashing names, stage by stage."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("etaoinshrd") for _ in range(r.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    plain = [(i, say(40)) for i in range(60)]
    item = say(25) + "."
    long = " ".join(word() for _ in range(60_000))
    odd = [(None, None), (None, ""), (70, None), (70, ""), (71, say(30)), (71, say(30)), (None, say(30)), (None, say(30)), (72, long), (73, item + " " + long), (74, plain[0][1]), (74, plain[0][1]), plain[1], (75, "\n" * 20), (76, " \t ")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key array<int>, id int, h string, kept string, x double, _key int, n_lines int"
    rows = [(i, t, None, "s", None if t is None else len(t), "r", [1], 2, "h", "k", 0.5, 3, 4) for i, t in plain + odd]
    labels = [(i, int(i % 6 != 0), None) for i in range(60)] + [(None, 1, 0), (3, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    every = sorted(((x.doc_id, x.text) for x in docs.collect()), key=str)
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        kept = out.collect()
        got[name] = sorted(((x.doc_id, x.text) for x in kept), key=str)
        assert all((x.row, x.key, x.id, x.h, x.kept, x.x, x["_key"], x.n_lines) == ("r", [1], 2, "h", "k", 0.5, 3, 4) for x in kept), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert set(got["quality"]) <= set(every)
    assert [t is None for _, t in got["lines"]].count(True) == 2 and len(got["lines"]) == len(every)
    assert (75, "") in got["lines"] and (75, "\n" * 20) not in got["lines"]
    assert got["decontaminate"] == sorted([x for x in every if x[0] != 73], key=str)
    want = sorted([*plain, (None, None), (None, ""), (70, None), (70, ""), *odd[4:9], (73, odd[9][1]), (75, "\n" * 20), (76, " \t ")], key=str)
    want.remove(odd[9])  # the item does not part it from the long text before it
    assert got["near_duplicates"] == want
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted((str(x.doc_id), x.n_tokens) for x in coded) == sorted((str(i), len(theirs.encode_ordinary(t or ""))) for i, t in every)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
