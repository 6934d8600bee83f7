"""Queries of the training-data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import encoding, leakage, mixing, setjoin, source_kind
from codeweft.plans.base import Register
from codeweft.session import table

R = Register()

@R.add("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return source_kind.judged(table(spark, d, "file_node"), table(spark, d, "cached_entity")).where(~F.col("handwritten")).select("id")


@R.add("p1_judged")
def p1_judged(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its notice, the forest's probability and the verdict."""
    return source_kind.judged(table(spark, d, "file_node"), table(spark, d, "cached_entity"))


@R.add("p1_held_out")
def p1_held_out(spark: SparkSession, d: str) -> DataFrame:
    """How many labelled files of each kind the forest finds that it was not fitted on."""
    return source_kind.held_out(table(spark, d, "file_node"), table(spark, d, "cached_entity"))


SIMILARITY, MIN_SET = 0.7, 4
CACHED, SHARED = 0, 1

SETS = """
s AS (
  SELECT id, side, list_sort(list_distinct(list(h))) AS v FROM (
    SELECT id, 0 AS side, unnest(literalHashes) AS h FROM cached_entity UNION ALL SELECT id, 1, unnest(literalHashes) FROM shared_entity)
  WHERE id IS NOT NULL AND h IS NOT NULL GROUP BY id, side HAVING count(DISTINCT h) >= 4),
x AS (SELECT id, side, len(v) AS n, unnest(v) AS h FROM s),
f AS (SELECT h, count(*) AS f FROM x GROUP BY h),
r AS (SELECT x.*, row_number() OVER (PARTITION BY id, side ORDER BY f, x.h) AS rn FROM x JOIN f USING (h)),
p AS (SELECT * FROM r WHERE rn <= n - ceil(n * 0.7 - 1e-9) + 1),
c AS (
  SELECT DISTINCT a.id AS a, a.side AS sa, b.id AS b, b.side AS sb FROM p a JOIN p b ON a.h = b.h AND a.id < b.id
  WHERE least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) - 1e-9),
k AS (
  SELECT a, sa, b, sb, len(list_intersect(sx.v, sy.v)) AS i, len(sx.v) + len(sy.v) AS t
  FROM c JOIN s sx ON sx.id = a AND sx.side = sa JOIN s sy ON sy.id = b AND sy.side = sb),
ok AS (SELECT a, sa, b, sb FROM k WHERE i / (t - i) >= 0.7)"""


def _similar(spark: SparkSession, d: str) -> setjoin.SimilarSets:
    cached = setjoin.record_sets(table(spark, d, "cached_entity"), "id", "literalHashes", CACHED, MIN_SET)
    shared = setjoin.record_sets(table(spark, d, "shared_entity"), "id", "literalHashes", SHARED, MIN_SET)
    return setjoin.similar_sets(cached.unionByName(shared), SIMILARITY)


@R.add("p2_found", f"WITH {SETS} SELECT DISTINCT a AS id_a, b AS id_b FROM ok WHERE NOT (sa = 1 AND sb = 1)")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.expanded(_similar(spark, d), cross_only_side=SHARED)


@R.add(
    "p2_links",
    f"WITH {SETS}, l AS (SELECT a AS id, sa AS side FROM ok UNION ALL SELECT b, sb FROM ok), g AS (SELECT id, side, count(*) AS links FROM l GROUP BY ALL) SELECT s.id, s.side, coalesce(links, 0) AS links FROM s LEFT JOIN g ON g.id = s.id AND g.side = s.side",
)
def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Each record's number of similar records on either side, without expanding classes of equal sets."""
    return setjoin.link_counts(_similar(spark, d)).select("id", "side", "links")


P6 = """
WITH w AS (SELECT doc_id AS k, 0 AS side, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT NULL, 1, NULL WHERE false),
i AS (SELECT item_id AS k, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM eval_item WHERE text IS NOT NULL),
dw AS (SELECT k, unnest(list_transform(range(1, len(w) - 11), lambda j: array_to_string(w[j:j + 12], ' '))) AS g FROM w),
iw AS (SELECT DISTINCT k, unnest(list_transform(range(1, len(w) - 11), lambda j: array_to_string(w[j:j + 12], ' '))) AS g FROM i)
SELECT DISTINCT dw.k AS doc_id, iw.k AS item_id FROM dw JOIN iw ON dw.g = iw.g"""


@R.add("p6_found", P6)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


@R.add("p6_items", f"SELECT item_id, count(*) AS documents FROM ({P6}) GROUP BY item_id")
def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


@R.add("p6_spans")
def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    """Leaked runs with offsets into the original text; checked by brute force in the tests."""
    return leakage.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_item"))


@R.add("p7_mix")
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The combined corpus: every record used, with its source, size and number of copies."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


@R.add("p7_shares")
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached share of each source."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[1]


@R.add("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged_documents(table(spark, d, "documents"))[0].select("doc_id")


@R.add("p8_channels")
def p8_channels(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged_documents(table(spark, d, "documents"))[0]


@R.add("p8_restored")
def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored_documents(table(spark, d, "documents"))
