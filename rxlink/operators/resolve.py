"""Resolving names to medicines and salts: exact, TF-IDF and fuzzy tiers.

The TF-IDF analyser is this engine's own: character trigrams of the padded
normalised name, smooth idf ``ln((1 + n) / (1 + df)) + 1``, unit length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxlink.functions import similarity as S
from rxlink.functions import text as T

#: Default thresholds.
MEDICINE, SALT, FUZZY, TOP_K = 0.72, 0.70, 92, 5
PRIORITY = {"exact": 3, "fuzzy": 2, "tfidf": 1}


def grams(name: Column) -> Column:
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    return F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: padded.substr(i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def weights(names: DataFrame, key: str, idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """names: key, name_norm. Postings (key, gram, w) of unit length, and the idf used."""
    tf = names.select(key, F.explode(grams(F.col("name_norm"))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    if idf is None:
        total = names.filter(F.length("name_norm") > 0).agg(F.count("*").alias("n"))
        df = tf.groupBy("gram").agg(F.count("*").alias("df"))
        idf = df.crossJoin(F.broadcast(total)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # total: one row
    raw = tf.join(idf, "gram").select(key, "gram", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "gram", (F.col("w") / F.col("norm")).alias("w")), idf


def build_catalog(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: medicine, salts (array). Medicines (ord, name, name_norm, salts) and salts (ord, name, name_norm)."""
    base = rows.select(F.col("medicine").alias("name"), T.query_text("medicine").alias("name_norm"), "salts").filter("name_norm <> ''")
    medicine = base.groupBy("name").agg(F.first("name_norm").alias("name_norm"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("salts")))).alias("salts"))
    medicine = medicine.withColumn("ord", F.xxhash64("name"))
    salt = rows.select(F.explode("salts").alias("name")).distinct().select(F.xxhash64("name").alias("ord"), "name", T.query_text("name").alias("name_norm")).filter("name_norm <> ''")
    return medicine, salt


def exact_matches(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """queries: q, norm. Of names with one normal form the last in order wins."""
    build = catalog.groupBy("name_norm").agg(F.max_by("name", F.struct("ord", "name")).alias("name"), F.max("ord").alias("ord"))
    return queries.join(build, queries["norm"] == build["name_norm"]).select("q", "name", "name_norm", "ord", F.lit(1.0).alias("score"), F.lit("exact").alias("match_type"))


def top_by_weight(queries: DataFrame, catalog: DataFrame, top_k: int, threshold: float) -> DataFrame:
    """The k nearest names by cosine, then those at the threshold or above."""
    names = catalog.select("ord", "name", "name_norm")
    posting, idf = weights(names, "ord")
    asked, _ = weights(queries.select("q", F.col("norm").alias("name_norm")).distinct(), "q", idf)
    dot = asked.withColumnRenamed("w", "wq").join(posting, "gram").groupBy("q", "ord").agg(F.round(F.sum(F.col("w") * F.col("wq")), 6).alias("score"))
    named = dot.join(names, "ord")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("name"))
    kept = named.withColumn("n", F.row_number().over(w)).filter((F.col("n") <= top_k) & (F.col("score") >= threshold))
    return kept.select("q", "name", "name_norm", "ord", "score", F.lit("tfidf").alias("match_type"))


def fuzzy_matches(queries: DataFrame, catalog: DataFrame, top_k: int, cutoff: float) -> DataFrame:
    """The k best by weighted ratio among those at the cutoff or above.

    At a cutoff over 90 only lengths within a factor of 1.5 can reach it, which
    also makes length classes a join key.
    """
    names = catalog.select("ord", "name", "name_norm")
    if cutoff > 90:
        # log base 1.5 of the lengths differs by less than one: neighbouring classes
        band = lambda c: F.floor(F.log(F.length(c).cast("double")) / F.log(F.lit(1.5))).cast("int")
        asked = queries.filter(F.length("norm") > 0).withColumn("band", F.explode(F.array(*[band("norm") + d for d in (-1, 0, 1)])))
        pairs = asked.join(names.withColumn("band", band("name_norm")), "band")
        longer, shorter = F.greatest(F.length("norm"), F.length("name_norm")), F.least(F.length("norm"), F.length("name_norm"))
        pairs = pairs.filter(longer < 1.5 * shorter)
    else:
        pairs = queries.filter(F.length("norm") > 0).crossJoin(names)
    scored = pairs.withColumn("raw", S.weighted_ratio(F.col("norm"), F.col("name_norm"))).filter(F.col("raw") >= cutoff)
    w = Window.partitionBy("q").orderBy(F.desc("raw"), F.asc("name"))
    kept = scored.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top_k)
    return kept.select("q", "name", "name_norm", "ord", F.bround(F.col("raw") / 100, 6).alias("score"), F.lit("fuzzy").alias("match_type"))


def merge_tiers(matches: DataFrame, top_k: int = TOP_K, key: str = "q") -> DataFrame:
    """Per normalised name the best tier, then score; the first k by score, tier and name."""
    tier = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("match_type")]
    rows = matches.withColumn("tier", tier)
    one = Window.partitionBy(key, "name_norm").orderBy(F.desc("tier"), F.desc("score"), F.asc("name"))
    best = rows.withColumn("n", F.row_number().over(one)).filter("n = 1")
    top = Window.partitionBy(key).orderBy(F.desc("tier"), F.desc("score"), F.asc("name"))
    return best.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= top_k).drop("n")


def tiers(queries: DataFrame, catalog: DataFrame, threshold: float, top_k: int, cutoff: float, fuzzy: bool = True) -> DataFrame:
    """Exact and TF-IDF matches, fuzzy ones for the queries that have neither."""
    found = exact_matches(queries, catalog).unionByName(top_by_weight(queries, catalog, top_k, threshold))
    if not fuzzy:
        return found
    rest = queries.join(found.select("q").distinct(), "q", "left_anti")
    return found.unionByName(fuzzy_matches(rest, catalog, top_k, cutoff))


def resolve(
    asked: DataFrame, medicine: DataFrame, salt: DataFrame, medicine_threshold: float = MEDICINE, salt_threshold: float = SALT, fuzzy_threshold: float = FUZZY, top_k: int = TOP_K, fuzzy: bool = True
) -> DataFrame:
    """asked: input. One row per distinct input: input_type, output_salts, matched_medicines, matched_salts.

    A zero threshold means the default, as in the reference.
    """
    medicine_threshold, salt_threshold, fuzzy_threshold, top_k = medicine_threshold or MEDICINE, salt_threshold or SALT, fuzzy_threshold or FUZZY, top_k or TOP_K
    inputs = asked.select(F.trim(F.coalesce(F.col("input").cast("string"), F.lit(""))).alias("q")).distinct()
    queries = inputs.select("q", T.query_text("q").alias("norm")).filter("norm <> ''")
    meds = merge_tiers(tiers(queries, medicine, medicine_threshold, top_k, fuzzy_threshold, fuzzy), top_k)
    meds = meds.join(medicine.select("name", "salts"), "name")
    parts = queries.select("q", F.explode(F.array_distinct(F.concat(F.array("q"), T.salt_components("q")))).alias("part"))
    asked_parts = parts.select(F.col("part").alias("q")).distinct().select("q", T.query_text("q").alias("norm")).filter("norm <> ''")
    hits = tiers(asked_parts, salt, salt_threshold, top_k, fuzzy_threshold, fuzzy).withColumnRenamed("q", "part")
    salts = merge_tiers(parts.join(hits, "part"), top_k)
    m = meds.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("name").alias("medicine"), "score", "match_type", "salts"))).alias("m"))
    s = salts.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("name").alias("salt"), "score", "match_type"))).alias("s"))
    out = inputs.join(m, "q", "left").join(s, "q", "left")
    m, s = F.coalesce("m", F.array()), F.coalesce("s", F.array())

    def primary(xs: Column) -> Column:
        sure = F.filter(xs, lambda x: x["match_type"] == "exact")
        return F.when(F.size(sure) > 0, sure).otherwise(xs)

    pm, ps = primary(m), primary(s)
    kind = F.when(F.col("q") == "", "empty").when((F.size(pm) > 0) & (F.size(ps) > 0), "medicine_and_salt").when(F.size(pm) > 0, "medicine").when(F.size(ps) > 0, "salt").otherwise("unknown")
    names = F.concat(F.flatten(F.transform(pm, lambda x: x["salts"])), F.transform(ps, lambda x: x["salt"]))
    return out.select(
        F.col("q").alias("input"), kind.alias("input_type"), T.ordered_unique(names).alias("output_salts"),
        F.transform(m, lambda x: F.struct(x["medicine"].alias("medicine"), x["score"].alias("score"), x["match_type"].alias("match_type"), x["salts"].alias("salts"))).alias("matched_medicines"),
        F.transform(s, lambda x: F.struct(x["salt"].alias("salt"), x["score"].alias("score"), x["match_type"].alias("match_type"))).alias("matched_salts"),
    )


def predictions(df: DataFrame, resolved: DataFrame, column: str) -> DataFrame:
    """The input's columns with the six prediction columns."""
    flat = resolved.select(
        F.col("input").alias("__q"), "input_type", F.array_join("output_salts", "; ").alias("output_salts"), F.to_json("output_salts").alias("output_salts_json"),
        F.to_json("matched_medicines").alias("matched_medicines_json"), F.to_json("matched_salts").alias("matched_salts_json"),
    )
    asked = df.withColumn("input", F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))))
    return asked.join(flat, F.col("input") == F.col("__q"), "left").drop("__q")


def query_choice(df: DataFrame, column: str | None = None) -> Column:
    """The text to look up: a named column, or the first filled one of three."""
    if column is not None:
        if column not in df.columns:
            raise ValueError(f"missing column: {column}")
        return T.cell(column)
    have = [c for c in ("medicine_name_normalized", "medicine_name", "raw_medicine_text") if c in df.columns]
    return F.coalesce(*[F.when(~T.is_blank(c), T.cell(c)) for c in have], F.lit(""))


def first_salt(matched: Column) -> Column:
    """The first salt of the first medicine."""
    return F.coalesce(F.try_element_at(F.try_element_at(matched, F.lit(1))["salts"], F.lit(1)), F.lit(""))
