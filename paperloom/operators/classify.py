"""Document types by signature phrases, by a text model, and features of documents."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import is_blank, token_count
from paperloom.functions.fixed_values import DOCUMENT_TYPES, FEATURE_AMOUNT, FEATURE_BLANKS, FEATURE_CHECKBOXES, FEATURE_DATE, OTHER_THRESHOLD, SIGNATURES, THRESHOLDS, TITLE_HINTS


def phrase_hits(text: Column, kind: str) -> Column:
    """How many of a type's phrases occur in the text, which is lower-cased here."""
    low = F.lower(text)
    return functools.reduce(lambda a, b: a + b, (low.contains(p).cast("int") for p in SIGNATURES[kind]))


def rule_classified(docs: DataFrame, text: str = "text", blank_check: bool = True) -> DataFrame:
    """Adds document_type, confidence, all_scores and features_used by the share of each type's phrases among all found.

    blank_check: blank texts have no features at all, as in classifying documents; without it as in classifying bare texts.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__hits", F.array(*(phrase_hits(t, k) for k in DOCUMENT_TYPES)))
    out = out.withColumn("__all", F.aggregate("__hits", F.lit(0), lambda a, x: a + x))
    best = F.array_position(F.col("__hits"), F.array_max("__hits")).cast("int")
    names, least = F.array(*map(F.lit, DOCUMENT_TYPES)), F.array(*(F.lit(THRESHOLDS.get(k, OTHER_THRESHOLD)) for k in DOCUMENT_TYPES))
    found = F.col("__all") > 0
    share = lambda h: F.when(found, h.cast("double") / F.col("__all")).otherwise(F.lit(0.0))
    confidence = share(F.array_max("__hits"))
    used = F.filter(
        F.array(
            F.lit("rule_based"),
            *(
                F.when(F.get("__hits", F.lit(i)) > 0, F.concat(F.lit(f"keyword:{k}:"), F.get("__hits", F.lit(i)).cast("string"))) for i,
                k in enumerate(DOCUMENT_TYPES)
            )
        ),
        lambda x: x.isNotNull()
    )
    return out.select(
        *docs.columns,
        F.when(found & (confidence >= F.element_at(least, best)), F.element_at(names, best)).otherwise("unknown").alias("document_type"),
        confidence.alias("confidence"),
        F.create_map(*(x for i, k in enumerate(DOCUMENT_TYPES) for x in (F.lit(k), share(F.get("__hits", F.lit(i)))))).alias("all_scores"),
        (F.when(is_blank(t), F.array().cast("array<string>")).otherwise(used) if blank_check else used).alias("features_used"),
    )


#: A type and the least share of all found phrases that it needs.
_TYPES = tuple((k, THRESHOLDS.get(k, OTHER_THRESHOLD), SIGNATURES[k]) for k in DOCUMENT_TYPES)


def rule_type(text: str | None) -> str:
    """The document_type of rule_classified, of one text."""
    low = (text or "").lower()
    hits = [[p in low for p in phrases].count(True) for _, _, phrases in _TYPES]
    best, all_ = max(hits), sum(hits)
    kind, least, _ = _TYPES[hits.index(best)]
    return kind if all_ and best / all_ >= least else "unknown"


def keyword_features(text: Column) -> list[Column]:
    words = F.greatest(token_count(text), F.lit(1))
    return [c for k in DOCUMENT_TYPES for c in (phrase_hits(text, k).cast("double").alias(f"keyword_{k}_hits"), (phrase_hits(text, k) / words).alias(f"keyword_{k}_density"))]


def text_features(text: Column) -> list[Column]:
    """The structural features that need only the text."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    flag = lambda p: text.rlike(p).cast("double")
    return [
        flag(FEATURE_AMOUNT).alias("struct_has_numbers"), count(FEATURE_AMOUNT).alias("struct_amount_count"), flag(FEATURE_DATE).alias("struct_has_dates"), count(FEATURE_DATE).alias("struct_date_count"),
        flag(FEATURE_BLANKS).alias("struct_has_blanks"), flag(FEATURE_CHECKBOXES).alias("struct_has_checkboxes"), token_count(text).cast("double").alias("struct_total_words"),
    ]


def block_features(blocks: DataFrame, pages: DataFrame, tables: DataFrame | None = None, doc_id: str = "doc_id") -> DataFrame:
    """The structural features that need pages, blocks and tables; one row per document that has pages."""
    kind = F.col("block_type")
    n = lambda cond: F.count_if(cond).cast("double")
    b = blocks.groupBy(doc_id).agg(
        n(kind.isin("header", "title")).alias("struct_header_count"), n(kind == "list_item").alias("struct_list_item_count"), n(kind == "paragraph").alias("struct_paragraph_count"),
        F.avg(token_count(F.col("text"))).alias("struct_avg_block_words"),
    )
    p = pages.groupBy(doc_id).agg(F.countDistinct("page_num").cast("double").alias("struct_page_count"))
    out = p.join(b, doc_id, "left")
    if tables is None:
        out = out.withColumn("struct_table_count", F.lit(0.0))
    else:
        out = out.join(tables.groupBy(doc_id).agg(F.count("*").cast("double").alias("struct_table_count")), doc_id, "left")
    zero = [c for c in out.columns if c != doc_id]
    out = out.fillna(0.0, zero)
    yes = lambda c: (F.col(c) > 0).cast("double")
    return out.withColumns({
        "struct_multi_page": (F.col("struct_page_count") > 1).cast("double"), "struct_single_page": (F.col("struct_page_count") == 1).cast("double"),
        "struct_has_tables": yes("struct_table_count"), "struct_has_headers": yes("struct_header_count"), "struct_has_bullet_lists": yes("struct_list_item_count"),
    })


def metadata_features(title: Column, keywords: Column) -> list[Column]:
    both = [F.lower(F.coalesce(c, F.lit(""))) for c in (title, keywords)]
    hit = lambda words: functools.reduce(lambda a, b: a | b, (c.contains(w) for w in words for c in both))
    return [hit(words).cast("double").alias(f"meta_{k}_title") for k, words in TITLE_HINTS.items()]


# --- the text model: TF-IDF of one and two words, multinomial logistic regression -------------------------------------


def training_texts(spark: SparkSession, per_type: int = 30) -> DataFrame:
    """kind, text: for each type its phrases three times over, begun at another phrase in each row."""
    kinds = spark.createDataFrame([(kind, list(phrases)) for kind, phrases in SIGNATURES.items()], "kind string, p array<string>")
    rows = kinds.select("kind", "p", F.explode(F.sequence(F.lit(0), F.lit(per_type - 1))).alias("i"))
    rows = rows.withColumn("at", F.col("i") % F.size("p"))
    turned = F.concat(F.slice("p", F.col("at") + 1, F.size("p")), F.slice("p", F.lit(1), F.col("at")))
    return rows.select("kind", F.array_join(F.flatten(F.array_repeat(turned, 3)), " ").alias("text"))


def grams(text: Column) -> Column:
    """Words of two letters or digits or more, and pairs of neighbouring ones."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def fit_text_model(spark: SparkSession, most_features: int = 5000) -> DataFrame:
    """gram, idf and a weight for each type, with the intercepts in the row of the empty gram: a small table.

    The training set is 180 short texts that are made here, so fitting is bounded.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, Normalizer, StringIndexer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = training_texts(spark).withColumn("grams", grams(F.col("text"))).persist()
    counted = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=most_features).fit(rows)
    n = rows.count()
    df = {r["g"]: r["n"] for r in rows.select(F.explode(F.array_distinct("grams")).alias("g")).groupBy("g").agg(F.count("*").alias("n")).collect()}
    idf = [math.log((1 + n) / (1 + df[g])) + 1 for g in counted.vocabulary]

    weigh = lambda n, w: F.when(n > 0, (1 + F.log(n)) * w).otherwise(0.0)
    x = array_to_vector(F.zip_with(vector_to_array("tf"), F.lit(idf), weigh))
    vectors = counted.transform(rows).withColumn("x", x)
    vectors = Normalizer(inputCol="x", outputCol="features").transform(vectors)
    labels = StringIndexer(inputCol="kind", outputCol="label", stringOrderType="alphabetAsc").fit(vectors)
    model = LogisticRegression(family="multinomial", regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=1000).fit(labels.transform(vectors))
    rows.unpersist()
    weights, kinds = model.coefficientMatrix.toArray(), labels.labels
    table = [("", 1.0, *map(float, model.interceptVector))] + [(g, idf[i], *map(float, weights[:, i])) for i, g in enumerate(counted.vocabulary)]
    return spark.createDataFrame(table, "gram string, idf double, " + ", ".join(f"w_{k} double" for k in kinds))


def model_classified(docs: DataFrame, model: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, document_type, confidence and a score for each type. The model has a bounded size and is broadcast."""
    kinds = sorted(DOCUMENT_TYPES)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    weights = F.broadcast(model.filter("gram <> ''"))
    intercepts = model.filter("gram = ''").select(*(F.col(f"w_{k}").alias(f"b_{k}") for k in kinds))
    counts = base.select("doc_id", F.explode(grams(F.col("text"))).alias("gram")).join(weights, "gram").groupBy("doc_id", "gram").agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("idf", *(f"w_{k}" for k in kinds)))
    )
    x = (1 + F.log("n")) * F.col("idf")
    sums = counts.groupBy("doc_id").agg(F.sqrt(F.sum(x * x)).alias("norm"), *(F.sum(x * F.col(f"w_{k}")).alias(f"s_{k}") for k in kinds))
    joined = base.select("doc_id", is_blank(F.col("text")).alias("blank")).join(sums, "doc_id", "left").join(F.broadcast(intercepts))
    z = {k: F.col(f"b_{k}") + F.coalesce(F.col(f"s_{k}") / F.col("norm"), F.lit(0.0)) for k in kinds}
    top = F.greatest(*z.values())
    total = functools.reduce(lambda a, b: a + b, (F.exp(v - top) for v in z.values()))
    scores = joined.select("doc_id", "blank", *((F.exp(v - top) / total).alias(k) for k, v in z.items()))
    best = F.greatest(*map(F.col, kinds))
    name = functools.reduce(
        lambda c, k: c.when((F.col(k) == best) & (best >= THRESHOLDS.get(k, OTHER_THRESHOLD)), k), kinds[1:],
        F.when((F.col(kinds[0]) == best) & (best >= THRESHOLDS.get(kinds[0], OTHER_THRESHOLD)), kinds[0])
    ).otherwise("unknown")
    zero = lambda c: F.when(F.col("blank"), F.lit(0.0)).otherwise(c)
    return scores.select("doc_id", F.when(F.col("blank"), "unknown").otherwise(name).alias("document_type"), zero(best).alias("confidence"), *(zero(F.col(k)).alias(f"score_{k}") for k in kinds))
