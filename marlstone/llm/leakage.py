"""Evaluation passages inside a corpus: one Aho-Corasick automaton over all word windows of the test items.

Words are numbered, and the automaton runs over word numbers, so case, punctuation, spaces and line breaks do not
matter and no match begins or ends inside a word. Each text is scanned once and whole. Offsets are mapped back to
characters of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from marlstone.llm.wordscan import parts, scan

#: Words of test items in one automaton, some 300 MB; more items take further automata, one after another.
AUTOMATON_WORDS = 150_000
MATCHES = "doc_id long, item_id long, n_words int, start_char long, end_char long"
_built: dict[str, tuple] = {}


def _automaton(items: list[tuple[int, str]], width: int):
    """(vocabulary, automaton, windows): windows[k] lists (item, position) of the k-th distinct window."""
    import ahocorasick

    number, row, _, _ = scan(pa.array([t for _, t in items], pa.string()))
    vocabulary = np.unique(number)
    word = np.searchsorted(vocabulary, number) + 1
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    at: dict[tuple, int] = {}
    windows: list[list[tuple[int, int]]] = []
    for i, (item, _) in enumerate(items):
        w = word[row == i].tolist()
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            if key not in at:
                at[key] = len(windows)
                a.add_word(key, at[key])
                windows.append([])
            windows[at[key]].append((item, p))
    if windows:
        a.make_automaton()
    return vocabulary, a, windows


def _runs(hits: list[tuple[int, int]], windows, width: int) -> dict[int, tuple[int, int]]:
    """item -> (first word, words) of its longest run of matching windows; hits are (last word, window)."""
    runs: dict[tuple[int, int], tuple[int, int]] = {}  # (item, diagonal) -> open run
    best: dict[int, tuple[int, int]] = {}
    for end, k in hits:
        for item, p in windows[k]:
            d = (item, end - p)
            first, last = runs.get(d, (end, end - 1))
            runs[d] = (first, end) if last == end - 1 else (end, end)
            first = runs[d][0]
            n = end - first + width
            if n > best.get(item, (0, 0))[1]:
                best[item] = (first - width + 1, n)
    return best


def _search(batches: Iterator[pa.RecordBatch], held, key: str, width: int) -> Iterator[pa.RecordBatch]:
    if key not in _built:
        _built.clear()
        _built[key] = _automaton(held.value, width)
    vocabulary, automaton, windows = _built[key]
    for batch in batches:
        for first, texts in parts(batch.column(1)):
            number, row, start, end = scan(texts)
            if not len(number) or not windows:
                continue
            at = np.minimum(np.searchsorted(vocabulary, number), len(vocabulary) - 1)
            word = np.where(vocabulary[at] == number, at + 1, 0).tolist()
            cuts = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
            out: list[tuple] = []
            for i in range(len(texts)):
                s, e = cuts[i], cuts[i + 1]
                if e - s < width:
                    continue
                hits = list(automaton.iter(tuple(word[s:e])))
                if not hits:
                    continue
                low = pc.utf8_lower(texts[i]).as_py().encode()
                doc = batch.column(0)[first + i].as_py()
                for item, (w, n) in _runs(hits, windows, width).items():
                    a = len(low[: start[s + w]].decode())
                    out.append((doc, item, n, a, a + len(low[start[s + w] : end[s + w + n - 1]].decode())))
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "item_id", "n_words", "start_char", "end_char"])


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", width: int = 13) -> DataFrame:
    """(doc_id, item_id, n_words, start_char, end_char): each document with at least width consecutive words of an item.

    n_words and the offsets are those of the longest such run, the first if several are as long. Items are the held-out
    test set, which is read into the driver; sets of over AUTOMATON_WORDS words are searched in parts, so nothing sent
    out grows with them. Null texts, and texts or items of fewer words, match nothing. Repeated rows give one row.
    """
    spark = docs.sparkSession
    rows = sorted({(r[0], r[1]) for r in items.select(F.col(item_id).cast("long"), F.col(item_text)).where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).toLocalIterator()})
    groups: list[list[tuple[int, str]]] = [[]]
    held = 0
    for r in rows:
        n = len(r[1]) // 2 + 1  # words at most
        if groups[-1] and held + n > AUTOMATON_WORDS * 3:
            groups.append([])
            held = 0
        groups[-1].append(r)
        held += n
    found = None
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null")
    for g in groups:
        sent = spark.sparkContext.broadcast(g)
        key = f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}-{width}"  # noqa: SLF001
        got = source.mapInArrow(lambda it, sent=sent, key=key: _search(it, sent, key, width), MATCHES)
        found = got if found is None else found.unionByName(got)
    best = F.max(F.struct(F.col("n_words"), (-F.col("start_char")).alias("a"), F.col("end_char").alias("z")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_words", (-F.col("b.a")).alias("start_char"), F.col("b.z").alias("end_char"))
