"""Benchmark decontamination: BM25 over an inverted index of test items, pruned by block-max bounds.

The index holds the test items; every passage of every training text is a query.
Items fall into classes whose lengths lie within a factor of two.  For each class
passages are windows of twice its longest item's words at steps of that length, so
any stretch as long as an item lies whole in one of them.  A posting's impact is its
BM25 weight divided by the item's score for its own words, so a score is the share of
an item that the passage holds, and one threshold serves all items.

Items are ordered by length and cut into blocks; for each term and block the index
has the largest impact.  As in block-max WAND, a passage whose sum of list maxima
stays below the threshold is left at once, a block whose sum of block maxima stays
below it is skipped, and only what remains is scored, from the postings of the
passage's own terms in that block; every item that reaches the threshold is retrieved.  Retrieved items are verified: the passage must
hold most word shingles of the item, and parts of both its question (all but the
last sentence or line) and its answer (the last one).

The index is cut into shards of bounded size; each is broadcast and read by one pass
over the texts, which are never shuffled.

Defined results: null or empty texts and texts without words hold nothing; items
without words match nothing; repeated items are all reported; a null item id or doc
id is reported as null; an empty table on either side gives no matches; ``clean``
keeps all columns, whatever their names; repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import trim

WORD = re.compile(r"[^\W_]+")
#: Usual constants of BM25.
K1, B = 1.2, 0.75
#: Bytes of item text in one shard of the index; a shard is what is broadcast.
SHARD_BYTES = 8 << 20
#: Blocks of a shard, words whose passages are scored together, and passages whose scores in a block are held at once.
BLOCKS, CHUNK_WORDS, WINDOWS = 64, 50_000, 4096


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words of all but the last sentence or line, and of the last; of a single sentence the last third is the answer."""
    parts = [w for p in re.split(r"(?<=[.?!])\s+|\n", text or "") if (w := words_of(p))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    own = parts[0] if parts else []
    cut = len(own) - len(own) // 3
    return own[:cut], own[cut:]


def shingles(words: list[str], n: int = 5) -> set[tuple[str, ...]]:
    """Distinct runs of n words; the whole sequence if it is shorter."""
    if not words:
        return set()
    n = min(n, len(words))
    return set(zip(*(words[k:] for k in range(n)), strict=False))


@dataclass
class Part:
    """Items of one length class in order of length, with postings by block and term, and their maxima."""

    items: list[tuple]
    span: int
    step: int  # items a block
    cuts: np.ndarray  # of each (block, term): where its postings begin, and the end
    item: np.ndarray
    impact: np.ndarray
    block_max: np.ndarray  # block x term
    list_max: np.ndarray


@dataclass
class Index:
    """One shard: the numbers of its terms, which all parts share, and its items by length class."""

    terms: dict[str, int] = field(default_factory=dict)
    parts: list[Part] = field(default_factory=list)


def build(items: list[tuple], df: dict[str, int], n: int, mean: float) -> Index:
    """The index of (item_id, text) rows; df, n and mean (words an item) are those of all items."""
    words = [words_of(x[1]) for x in items]
    kept = sorted((k for k, w in enumerate(words) if w), key=lambda k: (len(words[k]), items[k][0] is not None, items[k][0] or 0, items[k][1]))
    index = Index()
    if not kept:
        return index
    counts = [Counter(words[k]) for k in kept]
    for c in counts:
        for t in c:
            index.terms.setdefault(t, len(index.terms))
    size = np.array([len(words[k]) for k in kept])
    row = np.repeat(np.arange(len(kept)), [len(c) for c in counts])
    term = np.array([index.terms[t] for c in counts for t in c])
    tf = np.array([f for c in counts for f in c.values()], np.float64)
    own_df = np.array([df[t] for t in index.terms], np.float64)[term]
    weight = np.log(1 + (n - own_df + 0.5) / (own_df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / mean))
    impact = (weight / np.bincount(row, weight)[row]).astype(np.float32)
    step, many = max(1, -(-len(kept) // BLOCKS)), len(index.terms)
    # a class holds lengths of one power of two, so one long item widens the passages of its own class only
    level = np.array([int(x).bit_length() for x in size])
    for k in np.unique(level):
        first, last = np.searchsorted(level, [k, k + 1])
        mine = (row >= first) & (row < last)
        r, t, v = row[mine] - first, term[mine], impact[mine]
        blocks = -(-(last - first) // step)
        cell = (r // step) * many + t
        order = np.lexsort((r, cell))
        r, v, cell = r[order], v[order], cell[order]
        top = np.zeros(blocks * many, np.float32)
        np.maximum.at(top, cell, v)
        top = top.reshape(blocks, many)
        cuts = np.searchsorted(cell, np.arange(blocks * many + 1)).astype(np.int32)
        index.parts.append(Part([items[kept[j]] for j in range(first, last)], int(size[last - 1]), step, cuts, r.astype(np.int32), v, top, top.max(0)))
    return index


def _scored(part: Part, k: int, many: int, term: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, score) of the postings of block k that the windows' terms have, added up by window and item."""
    at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])
    window = np.repeat(np.arange(len(starts)), ends - starts)
    first, last = part.cuts[k * many + term[at]], part.cuts[k * many + term[at] + 1]
    n = last - first
    place = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    cell = np.repeat(window, n) * part.step + (part.item[place] - k * part.step)
    score = np.bincount(cell, part.impact[place], minlength=len(starts) * part.step)
    hit = np.flatnonzero(score)
    return hit // part.step, hit % part.step + k * part.step, score[hit]


def retrieve(index: Index, part: Part, texts: list[list[str]], threshold: float, ids: np.ndarray | None = None) -> Iterator[tuple[int, int, int, float]]:
    """(text, first word of the passage, item, score) of every passage and item of the part that reach the threshold."""
    sizes = [len(t) for t in texts]
    if ids is None:
        ids = term_numbers(index, texts)
    if not len(ids):
        return
    span, many_terms = part.span, len(index.terms)
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(ids)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    known = ids >= 0
    known[known] = part.list_max[ids[known]] > 0
    ids, text, step = ids[known], text[known], place[known] // span
    # windows are numbered by text and step; a word is in the window of its step and the one before
    many = int(max(sizes)) // span + 2
    window = text * many + step
    both = np.concatenate([window * many_terms + ids, (window - 1)[step > 0] * many_terms + ids[step > 0]])
    window, term = np.divmod(np.unique(both), many_terms)
    if not len(window):
        return
    starts = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
    ends = np.append(starts[1:], len(window))
    slack = np.float32(threshold - 1e-4)  # single precision: bounds are tested a little low
    hopeful = np.flatnonzero(np.add.reduceat(part.list_max[term], starts) >= slack)
    if not len(hopeful):
        return
    live = np.concatenate([np.arange(a, b) for a, b in zip(starts[hopeful], ends[hopeful], strict=True)])
    cuts = np.concatenate([[0], np.cumsum(ends[hopeful] - starts[hopeful])[:-1]])
    for k in range(len(part.block_max)):
        rows = hopeful[np.add.reduceat(part.block_max[k][term[live]], cuts) >= slack]
        for a in range(0, len(rows), WINDOWS):
            own = rows[a : a + WINDOWS]
            which, item, score = _scored(part, k, many_terms, term, starts[own], ends[own])
            for i in np.flatnonzero(score >= slack):
                t, s = divmod(int(window[starts[own[which[i]]]]), many)
                yield t, s * span, int(item[i]), float(score[i])


def term_numbers(index: Index, texts: list[list[str]]) -> np.ndarray:
    get = index.terms.get
    return np.array([get(w, -1) for t in texts for w in t], np.int64)


def verify(words: list[str], item: str, n: int = 5, similar: float = 0.8, part: float = 0.5) -> tuple[float, float, float] | None:
    """(shingle share, question share, answer share) if the passage holds the item, else None."""
    question, answer = question_and_answer(item)
    have = shingles(words, n)
    want = shingles(question + answer, n)
    if len(question + answer) < n:
        have = shingles(words, len(question + answer))
    share = len(want & have) / len(want)
    own = set(words)
    q, a = (sum(w in own for w in x) / len(x) if x else 1.0 for x in (question, answer))
    return (share, q, a) if share >= similar and q >= part and a >= part else None


def matches(index: Index, texts: list[str | None], threshold: float) -> list[dict[tuple[int, int], tuple]]:
    """For each text, by (part, item), (start word, score, shingle share, question share, answer share) of the best passage."""
    out: list[dict[tuple[int, int], tuple]] = [{} for _ in texts]
    if not index.parts:
        return out
    todo: list[tuple[int, list[str], int]] = []
    size, span = 0, max(p.span for p in index.parts)

    def flush() -> None:
        stretches = [w for _, w, _ in todo]
        ids = term_numbers(index, stretches)
        for p, part in enumerate(index.parts):
            for t, start, item, score in retrieve(index, part, stretches, threshold, ids):
                at, words, first = todo[t]
                if found := verify(words[start : start + 2 * part.span], part.items[item][1]):
                    new = (start + first, score, *found)
                    old = out[at].get((p, item))
                    if old is None or (-new[2], -new[1], new[0]) < (-old[2], -old[1], old[0]):
                        out[at][p, item] = new

    for i, text in enumerate(texts):
        words = words_of(text)
        # very long texts come in stretches that overlap by a passage
        for a in range(0, max(1, len(words)), CHUNK_WORDS // span * span or span):
            stretch = words[a : a + CHUNK_WORDS + 2 * span]
            todo.append((i, stretch, a))
            size += len(stretch)
            if size >= CHUNK_WORDS:
                flush()
                todo.clear()
                size = 0
    flush()
    return out


def _indexes(items: DataFrame) -> Iterator[Index]:
    """The shards of the index, one after another; word counts are those of all items."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, -(-total[0] // SHARD_BYTES))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set(w)) for w in found], pa.list_(pa.string())), pa.array([len(w) for w in found], pa.int64())], names=["terms", "n"])

    counted = rows.select("text").mapInArrow(tokens, "terms array<string>, n long")
    n, mean = counted.filter("n > 0").agg(F.count(F.lit(1)), F.avg("n")).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
    for k in range(shards):
        own = [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).collect()]
        vocabulary = sorted({w for _, t in own for w in words_of(t)})
        if not vocabulary:
            continue
        if shards == 1:
            counts = {r[0]: r[1] for r in df.collect()}
        else:
            wanted = spark.createDataFrame([(w,) for w in vocabulary], "term string")
            counts = {r[0]: r[1] for r in df.join(wanted, "term").collect()}
        yield build(own, counts, n, mean)


def search(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row for each document and test item that it holds, with the best passage's scores."""
    found = None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, start_word long, score double, shingle_share double, question_share double, answer_share double"
    for index in _indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for d, hits in zip(batch.column(0).to_pylist(), matches(shared.value, batch.column(1).to_pylist(), threshold), strict=True):
                    rows += [(d, shared.value.parts[p].items[i][0], *hit) for (p, i), hit in sorted(hits.items())]
                kinds = [pa.int64()] * 3 + [pa.float64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "item_id", "start_word", "score", "shingle_share", "question_share", "answer_share"])

        own = texts.mapInArrow(run, schema)
        found = own if found is None else found.unionByName(own)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows that hold a test item; all columns stay."""
    at = docs.columns.index("text")
    for index in _indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not hits for hits in matches(shared.value, batch.column(at).to_pylist(), threshold)], pa.bool_()))
            trim()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
