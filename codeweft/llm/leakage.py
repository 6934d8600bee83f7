"""Evaluation passages inside training text, by an Aho-Corasick automaton over words.

Test items are normalised to lower-cased runs of ASCII letters and digits. A run of `words` words that a text shares with
an item holds a whole block of about half as many words that begins at a multiple of that number in the item. These
blocks are the automaton's patterns, so it has about one node a word of the items; a hit is extended on both sides
against the item's own words, which gives the maximal run, and is mapped back to offsets in the original text.

Items are split by hash into sets of bounded size, each with an automaton of its own. The corpus is read once for a group
of sets: a task holds a bounded piece of text and sends it through the automata of the group one after the other.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 13
#: Words of evaluation text in one automaton (some 250 bytes of memory a word), and automata in one scan of the corpus.
SET_WORDS, GROUP = 500_000, 8
#: A word is spelled in digits of this base, so that no node has more branches to search; each place has digits of its own.
BASE = 64
#: Bytes of text that a task holds while it runs several automata over them.
HELD_BYTES = 64 << 20

_word = re.compile(r"[A-Za-z0-9]+", re.ASCII)
_built: dict[str, Passages] = {}


class Passages:
    """The automaton over one set of items, with the items' words."""

    def __init__(self, items: list[tuple[str, str]], words: int) -> None:
        self.words = words
        self.step = max(1, (words + 1) // 2)
        self.number: dict[str, int] = {}
        self.items: list[tuple[str, array]] = []
        at: dict[tuple[int, ...], array] = defaultdict(lambda: array("L"))
        number = self.number.setdefault
        for item, text in items:
            seq = array("I", (number(w, len(self.number) + 1) for w in map(str.lower, _word.findall(text))))
            if len(seq) < words:
                continue
            for i in range(0, len(seq) - self.step + 1, self.step):
                at[tuple(seq[i : i + self.step])].extend((len(self.items), i))
            self.items.append((item, seq))
        self.places = next(d for d in range(1, 12) if len(self.number) < BASE**d)
        self.digits = [tuple(k * BASE + (w // BASE**k) % BASE for k in range(self.places)) for w in range(len(self.number) + 1)]
        self.auto = None
        if at:
            self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            while at:
                pattern, places = at.popitem()
                self.auto.add_word(self._spelled(pattern), places)
            self.auto.make_automaton()

    def _spelled(self, seq) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.digits.__getitem__, seq)))

    def spans(self, text: str) -> list[tuple[str, int, int, int]]:
        """(item, start, end, words) of the maximal runs that text shares with an item."""
        if self.auto is None:
            return []
        seq = [self.number.get(w, 0) for w in map(str.lower, _word.findall(text))]
        # item and diagonal -> end of the last run on it: hits inside a run say nothing new
        done: dict[tuple[int, int], int] = {}
        runs: set[tuple[str, int, int]] = set()
        n, at = len(seq), 0
        while at < n:
            # a stretch of words that the items know; only there can a run be
            end = at
            while end < n and seq[end]:
                end += 1
            if end - at >= self.words:
                for last, places in self.auto.iter(self._spelled(seq[at:end])):
                    self._extend(seq, at + last // self.places, places, done, runs)
            at = end + 1
        if not runs:
            return []
        spots = [m.span() for m in _word.finditer(text)]
        return sorted((item, spots[a][0], spots[b - 1][1], b - a) for item, a, b in runs)

    def _extend(self, seq: list[int], last: int, places: array, done: dict, runs: set) -> None:
        n, first = len(seq), last - self.step + 1
        for k in range(0, len(places), 2):
            item, i = places[k], places[k + 1]
            if done.get((item, first - i), -1) >= last:
                continue
            own = self.items[item][1]
            a, b, shift, m = first, last + 1, i - first, len(own)
            while a and a + shift and seq[a - 1] == own[a + shift - 1]:
                a -= 1
            while b < n and b + shift < m and seq[b] == own[b + shift]:
                b += 1
            done[item, first - i] = b - 1
            if b - a >= self.words:
                runs.add((self.items[item][0], a, b))


def _sets(items: DataFrame, set_words: int) -> tuple[DataFrame, int]:
    """items (item, text) with the number of their set, and how many sets there are: an even spread by hash, about set_words words each."""
    total = items.agg(F.coalesce(F.sum(F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)))), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / set_words))
    return items.withColumn("set", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int")), n


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, set_words: int = SET_WORDS) -> DataFrame:
    """(doc_id, item_id, start, end, words): maximal shared runs of at least `words` words, with offsets into the original text.

    Null texts and ids take no part; items shorter than `words` words and empty texts match nothing; repeated documents each
    give their rows, repeated items with one id count once, several texts of one id all count. The driver reads one set of
    items at a time to send it out; no set and no piece of text grows with the data.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()
    numbered, n = _sets(rows, set_words)
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id string, start int, end int, words int"
    out = None
    for g in range(0, n, GROUP):
        sent = [spark.sparkContext.broadcast(sorted((r["item"], r["text"]) for r in numbered.where(F.col("set") == k).collect())) for k in range(g, min(n, g + GROUP))]

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, token=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            def passages(k: int) -> Passages:
                if f"{token}-{k}" not in _built:  # one at a time; with a single set once per worker process
                    _built.clear()
                    _built[f"{token}-{k}"] = Passages(sent[k].value, words)
                return _built[f"{token}-{k}"]

            def matched(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for k in range(len(sent)):
                    p = passages(k)
                    for batch in held:
                        found = [(d, *s) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for s in p.spans(t)]
                        if found:
                            d, i, a, b, w = zip(*found)
                            yield pa.RecordBatch.from_arrays([pa.array(d, batch.schema.field(0).type), pa.array(i, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(w, pa.int32())], names=["doc_id", "item_id", "start", "end", "words"])

            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.nbytes
                if len(sent) == 1 or size >= HELD_BYTES:
                    yield from matched(held)
                    held, size = [], 0
            if held:
                yield from matched(held)

        one = docs.select(doc_id, text).where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).mapInArrow(scan, schema)
        out = one if out is None else out.unionByName(one)
    return out


def leaks(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """(doc_id, item_id) of every document that shares a run of words with an item."""
    return leaked_spans(docs, items, **kw).select("doc_id", "item_id").distinct()
