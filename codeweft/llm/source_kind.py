"""Generated, minified, vendored and data files told from hand-written source, by a random forest.

The forest sees numbers only. A first one knows a file by its content: compression ratio and entropy of the sub-words of its
entity names, identifier lengths, comment density, token counts and manifest sizes. A copied third-party file looks like any
other source, and a file without entities like nothing, so a second one knows a file by the company it keeps: over the
parts of its path (folders, parts of the name) how machine-made the first forest holds the other files with that part to be, and
over its folders how many of the others there have no entities and are in another language than their package. Only the statistics of
a part count, never its letters. A file is as machine-made or copied as the surer of the two says.

The labels are notices that the features don't contain: a path that says what a tool wrote, bundled, dumped or copied there is a
positive; negatives are tests and helper scripts kept by hand for the content, and for the company all files that neither a notice
nor their content speaks against. A notice teaches; the verdict on every file, noticed or not, is the forests'.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions import ids
from codeweft.operators import manifest
from codeweft.operators.skew import fragment_join
from codeweft.session import small, staged

#: Labelled rows the forest is fitted on, at most; the rest is judged all the same.
MAX_TRAIN = 100_000
TREES, DEPTH, SEED, THRESHOLD = 40, 8, 42, 0.5

# How places and names of files say where they come from.
VENDOR_NOTICE = r"(?i)(^|/)(vendor|_vendor|vendored|third[_-]?party|3rd[_-]?party|externals?|extern|deps|submodules|node_modules|bower_components|jspm_packages|site-packages|dist-packages)/"
VERSION_NOTICE = r"(^|/)[A-Za-z][\w.]*-v?\d+\.\d+(\.\d+)+/"
GENERATED_NOTICE = r"(^|/)(__generated__|[Gg]enerated|gen|autogen)/|(?i:[._-](generated|gen|g|designer|pb|tab)\.\w+$|_pb2(_grpc)?\.pyi?$|(^|/)(zz_generated[_.]|moc_|lex\.)[^/]*$|(^|/)ui_[^/]*_form\.py$)"
MINIFIED_NOTICE = r"(?i)(^|/)dist/|[._-](min|packed|bundle|prod)\.(js|css)$|(^|/)chunk-[0-9a-f]{6,}\.js$|[.-][0-9a-f]{8}\.js$"
DATA_NOTICE = r"(?i)\.(dat|data)\.\w+$|_(blob|data)\.(py|r)$"
HAND_NOTICE = r"(^|/)(tests?|tools|scripts)/"

#: How long a file is says nothing, so its plain size and lines are no features; of line length and tokens the order of magnitude counts.
CONTENT = ["line_length", "entities", "most_tokens", "mean_tokens", "comment_density", "name_length", "longest_name", "shortest_name", "compression", "entropy", "numbered", "token_entropy", "token_spread"]
CONTEXT = ["alike", "alike_name", "bare_folder", "foreign_folder"]
#: Files that a part's statistics are mixed with, as if they were average: a part that few others share says little.
ALIKE_PRIOR, BARE_PRIOR, FOREIGN_PRIOR = 1, 5, 10


def notice(path: Column | str) -> Column:
    """vendored, generated, minified or data where the path says so; null elsewhere."""
    p = F.col(path) if isinstance(path, str) else path
    return (
        F.when(p.rlike(VENDOR_NOTICE) | p.rlike(VERSION_NOTICE), "vendored").when(p.rlike(MINIFIED_NOTICE), "minified").when(p.rlike(DATA_NOTICE), "data").when(p.rlike(GENERATED_NOTICE), "generated")
    )


def file_features(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, path, *CONTENT): one row per file id; -1 where a number is unknown, as for files without entities or lines."""
    f = files.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("size").alias("size"), F.max("lines").alias("lines"))
    e = entities.where(F.col("id").isNotNull() & F.col("fileId").isNotNull()).groupBy(ids.normalised("fileId").alias("f"), F.col("id").alias("e")).agg(F.max("tokenCount").alias("t"))
    name = F.coalesce(ids.name_part("e"), ids.basename("e"))
    e = e.select("f", F.coalesce("t", F.lit(0)).alias("t"), name.alias("name"))
    per = e.groupBy("f").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("t").alias("tokens"), F.max("t").alias("most_tokens"), F.avg("t").alias("mean_tokens"), F.avg(F.length("name")).alias("name_length"),
        F.max(F.length("name")).alias("longest_name"), F.min(F.length("name")).alias("shortest_name"), F.avg(F.col("name").rlike(r"\d$").cast("int")).alias("numbered"),
        (F.stddev_pop("t") / F.when(F.avg("t") > 0, F.avg("t"))).alias("token_spread"),
    )
    words = e.select("f", F.explode(F.regexp_extract_all("name", F.lit("[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))).alias("w"))
    counts = words.groupBy("f", F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    # a dictionary coder writes each sub-word once and then refers to it
    coded = counts.groupBy("f").agg(
        ((F.sum(F.length("w")) + F.sum("n")) / F.sum((F.length("w") + 1) * F.col("n"))).alias("compression"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n")).alias("entropy")
    )
    # of the token counts, against as many entities that all differ
    n = F.col("n").cast("double")
    sizes = e.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("f").agg((F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("bits"), F.sum(n).alias("all"))
    sizes = sizes.select("f", F.when(F.col("all") > 1, F.col("bits") / F.log2("all")).alias("token_entropy"))
    size, lines, tokens = (F.col(c).cast("double") for c in ("size", "lines", "tokens"))
    return f.join(per, f["id"] == per["f"], "left").drop("f").join(coded, f["id"] == coded["f"], "left").drop("f").join(sizes, f["id"] == sizes["f"], "left").select(
        "id",
        ids.normalised("id").alias("path"),
        *(
            F.coalesce(x.cast("double"), F.lit(-1.0)).alias(n)
            for n, x in {
                "line_length": F.when(lines > 0, F.floor(F.log2(size / lines + 1))), "entities": F.coalesce("entities", F.lit(0)),
                "most_tokens": F.floor(F.log2(F.col("most_tokens") + 1.0)), "mean_tokens": F.floor(F.log2(F.col("mean_tokens") + 1.0)),
                # bytes that no token of an entity accounts for
                "comment_density": F.when(size > 0, 1 - F.least(F.lit(1.0), 4 * tokens / size)),
                "name_length": F.col("name_length"), "longest_name": F.col("longest_name"), "shortest_name": F.col("shortest_name"), "compression": F.col("compression"), "entropy": F.col("entropy"), "numbered": F.col("numbered"), "token_entropy": F.col("token_entropy"), "token_spread": F.col("token_spread"),
            }.items()
        ),
    )


def name_parts(path: Column) -> Column:
    """What files may share of a path: folders below the package, without version numbers, and of the name what is between dots and the ends of the stem."""
    steps = F.split(F.lower(path), "/")
    folders = F.slice(steps, 3, F.greatest(F.size(steps) - 3, F.lit(0)))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"-?v?\d+(\.\d+)+$", ""), "[^a-z]+$", "")
    dots = F.split(F.regexp_replace(F.element_at(steps, -1), r"\d+", "#"), r"\.")
    stem = F.split(dots[0], "[_-]")
    middle = F.filter(F.slice(dots, 2, F.greatest(F.size(dots) - 2, F.lit(0))), lambda x: x != "")
    ends = F.when(F.size(stem) > 1, F.array(F.concat(F.lit("f:"), stem[0]), F.concat(F.lit("l:"), F.element_at(stem, -1)))).otherwise(F.array(F.concat(F.lit("w:"), stem[0])))
    return F.array_distinct(F.concat(F.transform(folders, lambda x: F.concat(F.lit("d:"), bare(x))), F.transform(middle, lambda x: F.concat(F.lit("m:"), x)), ends))


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of table by key; a table too large to send out is joined with hot keys split."""
    return rows.join(F.broadcast(table), key, "left") if small(table) is not table else fragment_join(rows, table, key, "left")


def with_context(scored: DataFrame) -> DataFrame:
    """scored (id, path, content features, content: probability by content) with the CONTEXT features; a file's own numbers are left out of its parts'."""
    language = F.regexp_replace(manifest.language("path"), "^javascript$", "typescript")
    has = (F.col("entities") > 0).cast("double")
    rows = scored.select("id", F.substring_index("path", "/", 2).alias("pkg"), language.alias("lang"), has.alias("has"), (F.coalesce("content", F.lit(0.0)) * has).alias("p"), name_parts(F.col("path")).alias("parts"))
    main = staged(rows.groupBy("pkg", "lang").agg(F.count(F.lit(1)).alias("n")).groupBy("pkg").agg(F.max_by("lang", F.struct("n", "lang")).alias("main")))
    rows = staged(_looked_up(rows, main, "pkg").select("id", "has", "p", (F.col("lang") != F.col("main")).cast("double").alias("foreign"), "parts"))
    all_ = rows.agg(F.coalesce(F.try_divide(F.sum("p"), F.sum("has")), F.lit(0.0)), F.coalesce(1 - F.avg("has"), F.lit(0.0)), F.coalesce(F.avg("foreign"), F.lit(0.0))).first()
    each = rows.select("id", "has", "p", "foreign", F.explode("parts").alias("part"))
    stats = staged(each.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("has").alias("sh"), F.sum("foreign").alias("sf"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    at = _looked_up(each, stats, "part")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    others = F.when(F.col("n").isNotNull(), F.col("n") - 1).otherwise(0)
    mean = lambda whole, own, n, prior, k: (F.greatest(zero(whole - own), F.lit(0.0)) + k * prior) / (n + k)
    alike = mean(F.col("sp"), F.col("p"), F.greatest(zero(F.col("sh") - F.col("has")), F.lit(0.0)), all_[0], ALIKE_PRIOR)
    bare = mean((F.col("n") - F.col("sh")), 1 - F.col("has"), others, all_[1], BARE_PRIOR)
    foreign = mean(F.col("sf"), F.col("foreign"), others, all_[2], FOREIGN_PRIOR)
    folder = F.startswith("part", F.lit("d:"))
    ctx = at.groupBy("id").agg(F.max(F.when(folder, alike)).alias("alike"), F.max(F.when(~folder, alike)).alias("alike_name"), F.max(F.when(folder, bare)).alias("bare_folder"), F.max(F.when(folder, foreign)).alias("foreign_folder"))
    out = scored.join(ctx, "id", "left")
    return out.withColumns({"content": F.coalesce("content", F.lit(-1.0)), **{c: F.coalesce(c, F.lit(v)) for c, v in zip(CONTEXT, (all_[0], all_[0], all_[1], all_[2]))}})


def _label(kinds: tuple[str, ...]) -> Column:
    kind = notice("path")
    return F.when(kind.isin(*kinds), 1.0).when(kind.isNull() & F.col("path").rlike(HAND_NOTICE), 0.0)


def fit_forest(featured: DataFrame, features: list[str], label: Column, max_train: int = MAX_TRAIN) -> RandomForestClassificationModel | None:
    """The forest over rows with a label (1 machine-made or copied, 0 hand-written), weighted by a column weight; None unless both occur."""
    labelled = featured.withColumn("label", label).where(F.col("label").isNotNull())
    n = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    # a seeded part by hash of the path, the same at every run and partitioning
    keep = min(1.0, max_train / sum(n.values()))
    part = labelled.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1_000_000)) < keep * 1_000_000)
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(part).select("features", "label", "weight").coalesce(4)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight", minInstancesPerNode=5, maxBins=128, featureSubsetStrategy="0.5", maxMemoryInMB=64).fit(vectors)


def _scored(rows: DataFrame, model: RandomForestClassificationModel | None, features: list[str], name: str) -> DataFrame:
    if model is None:
        return rows.withColumn(name, F.lit(None).cast("double"))
    out = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(rows))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


#: Notices whose files look machine-made, and all.
MADE = ("generated", "minified", "data")
ALL = (*MADE, "vendored")


def _judged(files: DataFrame, entities: DataFrame, use: Column | None = None) -> DataFrame:
    """use: which files may teach."""
    use = F.lit(True) if use is None else use
    featured = staged(file_features(files, entities))
    kind = notice("path")
    # the content of tests and scripts stands for that of all files without a notice, most of which are hand-written
    n = featured.agg(F.count(F.when(kind.isNull(), 1)).alias("plain"), F.count(F.when(_label(MADE) == 0.0, 1)).alias("hand")).first()
    weighed = featured.withColumn("weight", F.when(kind.isNotNull(), 1.0).otherwise(max(1.0, n["plain"] / max(1, n["hand"]))))
    content = fit_forest(weighed, CONTENT, F.when(use, _label(MADE)))
    rich = staged(with_context(_scored(featured, content, CONTENT, "content")))
    # their places don't stand for those of others: here every file counts as hand-written that neither notice nor content speak against
    label = F.when(kind.isNotNull(), 1.0).when(F.col("content") < THRESHOLD, 0.0)
    both = _scored(rich, fit_forest(rich.withColumn("weight", F.lit(1.0)), CONTEXT, F.when(use, label)), CONTEXT, "company")
    return both.withColumn("probability", F.greatest(F.when(F.col("content") >= 0, F.col("content")), "company"))


def judged(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, notice, probability, handwritten) of every file id.

    A file is hand-written if the forest's probability for machine-made or copied is below THRESHOLD. Files with null ids are
    left out, repeated rows count once; files without entities, size or lines are judged by what is known. Without both
    kinds of noticed files there is no forest, and the notices alone decide (probability is null).
    """
    out = _judged(files, entities).select("id", notice("path").alias("notice"), "probability")
    return out.withColumn("handwritten", F.coalesce(F.col("probability") < THRESHOLD, F.col("notice").isNull()))


def held_out(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(kind, files, found): how many files of each notice, and of the tests and scripts (kind hand), the forest calls machine-made or copied, half of them judged by a forest that saw only the other half."""
    half = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(2))
    out = None
    for k in (0, 1):
        one = _judged(files, entities, use=half != k).where((half == k) & _label(ALL).isNotNull())
        one = one.groupBy(F.coalesce(notice("path"), F.lit("hand")).alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("probability") >= THRESHOLD, 1)).alias("found"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("kind").agg(F.sum("files").alias("files"), F.sum("found").alias("found"))
