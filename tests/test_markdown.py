"""Markdown passages and post sections against worked-out values."""

from verbatlas.sources.markdown import blocks, split_passages, split_posts


def test_blocks():
    body = ["# Head", "one", "two", "- a", "  more", "2) b", "", "x", "---", "y", "***", "#no head", "=", " "]
    assert blocks(body) == [(1, 1, "# Head"), (2, 3, "one\ntwo"), (4, 5, "- a\n  more"), (6, 6, "2) b"), (8, 8, "x"), (10, 10, "y"), (12, 13, "#no head\n=")]
    assert blocks([]) == []


def test_files(spark):
    post = "intro\n## 2024-01-02T03:04:05Z — tweet 77 · kind: reply\n<!-- x -->\n~~~\nfirst\n\n## 2024 — tweet 1\n~~~\n## 2025-01-01 — tweet 78\nno fence\n"
    df = spark.createDataFrame([("a", "p\r\n\r\nq"), ("b", None), ("c", ""), ("d", post)], "path string, body string")
    assert [tuple(r) for r in split_passages(df.filter("path <> 'd'")).collect()] == [("a", 0, 1, 1, "p"), ("a", 1, 3, 3, "q")]
    assert [tuple(r) for r in split_posts(df).collect()] == [
        ("d#77", "77", "2024-01-02T03:04:05Z", "reply", 0, 5, 5, "first"),
        ("d#77", "77", "2024-01-02T03:04:05Z", "reply", 1, 7, 7, "## 2024 — tweet 1"),
        ("d#78", "78", "2025-01-01", "tweet", 0, None, None, None),
    ]
    assert split_posts(df.filter("false")).count() == 0
