"""Mixing sources to target weights, by capped water-filling.

Sizes are tokens of a public tokenizer. Every source wants its share of the total; one that can't give it with its records
repeated at most its cap is clamped there, and the rest is shared out by weight among the others, until nothing is clamped
any more. A source's records are then taken a whole number of times, and a seeded part of them once more, so that the sizes
add up: records are ordered by a seeded hash, and the cut is found by two levels of histograms, never by sorting a source.
Sources and bins stay tables; nothing of them is gathered on the driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.session import small, staged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's way to cut text into pieces before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = 4096
#: Characters after which a text is cut for the tokenizer, at the next place that is a border in any case.
PIECE = 20_000

#: After the last letter, or the last digit, of a row, and between a sign and white space, the vocabulary's pattern always begins anew.
_border = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=\s)")
_encoders: dict[str, object] = {}


def _encoder(vocabulary: str):
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def pieces(text: str) -> Iterator[str]:
    """The text in parts of at least PIECE characters, cut only where the tokens stay as they are; a row without such a place stays whole."""
    i = 0
    while len(text) - i > PIECE and (border := _border.search(text, i + PIECE)):
        yield text[i : border.start()]
        i = border.start()
    yield text[i:]


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    encoder = _encoder(vocabulary)
    return sum(len(encoder.encode_ordinary(p)) for p in pieces(text))


def source_name(c: Column | str) -> Column:
    """One spelling per source: trimmed, lower case, words joined by underscores."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")


def token_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every record with a source; null texts count 0 tokens."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(t, vocabulary) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), source_name(source).alias("source"), F.col(text).alias("text")).where(F.col("source").isNotNull())
    return rows.mapInArrow(size, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, source string, tokens long")


def water_fill(sources: DataFrame, total: Column) -> DataFrame:
    """sources with give: the size each one gives, in proportion to its share, none above its capacity, together total if that is feasible.

    sources: source, share, capacity and further columns. In the order of capacity by share, the sources up to some place are
    clamped, and the level of the others is what is left by the shares left; the first source that lies above its level is that
    place. The window runs over one row a source.
    """
    w = Window.orderBy("__ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    taking = F.col("share") > 0
    s = sources.withColumn("__ratio", F.when(taking, F.col("capacity") / F.col("share"))).withColumn("__total", total.cast("double"))
    over = lambda c, frame: F.coalesce(F.sum(F.when(taking, F.col(c))).over(frame), F.lit(0.0))
    s = s.withColumn("__left", F.col("__total") - over("capacity", w)).withColumn("__shares", over("share", first) - over("share", w))
    s = s.withColumn("__level", F.when(taking & (F.col("__shares") > 0), F.greatest(F.col("__left"), F.lit(0.0)) / F.col("__shares")))
    open_ = F.when(taking & (F.col("__ratio") > F.col("__level")), F.struct("__ratio", "source", "__level"))
    s = s.withColumn("__first", F.min(open_).over(first))
    below = F.col("__first").isNull() | (F.struct("__ratio", "source") < F.struct("__first.__ratio", "__first.source"))
    give = F.when(~taking, 0.0).when(below, F.col("capacity")).otherwise(F.least(F.col("capacity"), F.col("__first.__level") * F.col("share")))
    return s.withColumn("give", give).drop("__ratio", "__total", "__left", "__shares", "__level", "__first")


def _place(seed: int) -> tuple[Column, Column]:
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return F.pmod(h, F.lit(BINS)).cast("int"), F.pmod(F.shiftrightunsigned(h, 20), F.lit(BINS)).cast("int")


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42, vocabulary: str = VOCABULARY, **columns) -> tuple[DataFrame, DataFrame]:
    """The mix as (doc_id, source, tokens, copies), copies > 0, and its report, one row per source of targets.

    targets: source, target_share, max_repeats; shares count as weights, rows with a null or negative share or cap give
    nothing, and of repeated sources the shares add up under the smallest cap. total: size wanted, by default all tokens of
    the targets' sources. Records of other sources or without one take no part; empty texts have no size and are left out.
    Every row is a record of its own, but rows of one doc_id are drawn together.
    """
    t = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where((F.col("source").isNotNull()) & (F.col("target_share") >= 0) & (F.col("max_repeats") >= 0))
    wanted = staged(t.groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").cast("int").alias("cap")))
    sizes = staged(token_sizes(docs, vocabulary=vocabulary, **columns).join(small(wanted.select("source")), "source", "left_semi").where(F.col("tokens") > 0).select("doc_id", "source", "tokens"))
    first, second = _place(seed)
    binned = sizes.withColumn("b1", first).withColumn("b2", second)
    # both histograms come from one; at most BINS rows a source
    bins = staged(binned.groupBy("source", "b1").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("n")))
    have = bins.groupBy("source").agg(F.sum("docs").alias("records_in"), F.sum("n").alias("tokens_in"))
    facts = wanted.join(have, "source", "left").select("source", "share", "cap", F.coalesce("records_in", F.lit(0)).alias("records_in"), F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"))
    facts = facts.withColumn("capacity", F.col("tokens_in") * F.col("cap").cast("double"))
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = water_fill(facts, F.sum("tokens_in").over(everyone) if total is None else F.lit(float(total)))
    whole = F.when(F.col("tokens_in") > 0, F.floor(F.col("give") / F.col("tokens_in"))).otherwise(0).cast("int")
    filled = staged(filled.withColumn("whole", whole).withColumn("part", F.col("give") - F.col("whole") * F.col("tokens_in")))

    # the bin that a source's part ends in, and what of the part is left for it
    upto = Window.partitionBy("source").orderBy("b1").rowsBetween(Window.unboundedPreceding, -1)
    ends = bins.join(small(filled.select("source", "part")), "source").withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    ends = ends.where((F.col("before") <= F.col("part")) & (F.col("part") < F.col("before") + F.col("n"))).select("source", F.col("b1").alias("at"), (F.col("part") - F.col("before")).alias("left"))
    edge = staged(ends)
    fine = binned.join(small(edge.select("source", F.col("at").alias("b1"), "left")), ["source", "b1"]).groupBy("source", "b2").agg(F.sum("tokens").alias("n"), F.first("left").alias("left"))
    upto = Window.partitionBy("source").orderBy("b2").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    # up to the nearer side of the last bin
    taken = fine.where(F.col("before") + F.col("n") / 2 < F.col("left")).groupBy("source").agg((F.max("b2") + 1).alias("upto"))
    plan = filled.select("source", "cap", "whole").join(edge, "source", "left").join(taken, "source", "left").select("source", "cap", "whole", "at", F.coalesce("upto", F.lit(0)).alias("upto"))
    more = F.coalesce((F.col("b1") < F.col("at")) | ((F.col("b1") == F.col("at")) & (F.col("b2") < F.col("upto"))), F.lit(False))
    # copies never pass the cap: where a part ends in no bin, the source gives its whole capacity
    mixed = binned.join(small(plan), "source").withColumn("copies", F.least(F.col("whole") + more.cast("int"), F.col("cap"))).where(F.col("copies") > 0).select("doc_id", "source", "tokens", "copies")
    out = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_out"), F.sum("copies").alias("records_out"), F.max("copies").alias("most_copies"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    whole_of = lambda c: F.sum(c).over(everyone)
    report = filled.join(out, "source", "left").select(
        "source", (F.col("share") / F.when(whole_of("share") > 0, whole_of("share"))).alias("target_share"), (F.coalesce("tokens_out", F.lit(0)) / F.when(whole_of("tokens_out") > 0, whole_of("tokens_out"))).alias("share"),
        F.col("cap").alias("max_repeats"), zero("most_copies"), "records_in", zero("records_out"), "tokens_in", F.col("give").alias("tokens_planned"), zero("tokens_out"), (F.col("give") >= F.col("capacity")).alias("clamped"),
    )
    return mixed, report
