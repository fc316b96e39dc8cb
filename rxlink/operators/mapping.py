"""Candidate scoring, one-to-one assignment and the final mapping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxlink.functions import similarity as S
from rxlink.functions import text as T

#: Confidence cuts and the weights of the assignment score.
HIGH, MEDIUM, LOW = 85.0, 70.0, 50.0
UNMATCHED = "Unmatched - no unused medicine available"
MAX_BROADCAST_ROWS = 100_000
MAX_CELLS = 25_000_000
FINAL_COLUMNS = (
    "image_name", "extracted_text", "prescription_record_number", "prescription_medicine_name", "prescription_dosage_form_meaning", "prescription_strength", "prescription_dose_pattern",
    "prescription_dose_pattern_meaning", "prescription_dose_frequency", "prescription_dose_frequency_meaning", "prescription_duration", "prescription_instruction_meaning", "prescription_salt_name",
    "medicine_unique_key", "final_match_score", "match_confidence",
)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def confidence(score: Column) -> Column:
    return (
        F.when(score >= HIGH, "High confidence").when(score >= MEDIUM, "Medium confidence").when(score >= LOW, "Low confidence").otherwise("Very low confidence")
    )


def best_basis(medicine: Column, salt: Column, combined: Column) -> tuple[Column, Column]:
    """The largest of three scores and its name, the earlier one on ties."""
    top = F.greatest(medicine, salt, combined)
    return F.when(medicine == top, "medicine_name").when(salt == top, "salt_name").otherwise("medicine_name_plus_salt_name"), top


def assignment_score(final: Column, combined: Column, medicine: Column, salt: Column, row: Column) -> Column:
    return final * 1_000_000.0 + combined * 1_000.0 + medicine * 10.0 + salt * 0.1 - row * 0.0001


def prefixed(df: DataFrame, prefix: str = "prescription_", keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(c if c in keep else prefix + c) for c in df.columns])


def projected(df: DataFrame, columns: tuple[str, ...], blank: bool = False) -> DataFrame:
    """Exactly these columns, missing ones null (or empty)."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("" if blank else None).cast("string").alias(c) for c in columns])


def candidates(strips: DataFrame, records: DataFrame) -> DataFrame:
    """Every strip with every record, scored on name, salt and both.

    strips: image_name, extracted_text, strip_row; records: medicine_name,
    salt_name, record_row and what else there is. All pairs are what the
    operation is defined as; the record side is broadcast only while its
    counted rows are few, else Spark pairs partitions.
    """
    require_columns(strips, "image_name", "extracted_text", "strip_row")
    require_columns(records, "medicine_name", "salt_name", "record_row")
    right = prefixed(records, keep=("record_row",)).withColumns({
        "medicine_unique_key": T.unique_key("prescription_medicine_name", "record_row"),
        "medicine_clean": T.match_text("prescription_medicine_name"),
        "salt_clean": T.match_text("prescription_salt_name"),
        "combined_clean": T.match_text(T.join_non_empty("prescription_medicine_name", "prescription_salt_name")),
    })
    left = strips.withColumn("text_clean", T.match_text("extracted_text"))
    small = records.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    pairs = left.crossJoin(F.broadcast(right) if small else right)
    for name in ("medicine", "salt", "combined"):
        pairs = pairs.withColumn(f"{name}_scores", S.fuzzy_scores(F.col("text_clean"), F.col(f"{name}_clean")))
    m, s, c = (F.col(f"{n}_scores.score") for n in ("medicine", "salt", "combined"))
    basis, top = best_basis(m, s, c)
    out = pairs.withColumns({"medicine_score": m, "salt_score": s, "combined_score": c, "best_match_basis": basis, "final_match_score": top})
    return out.withColumns({
        "match_confidence": confidence(F.col("final_match_score")),
        "assignment_score": assignment_score(F.col("final_match_score"), F.col("combined_score"), F.col("medicine_score"), F.col("salt_score"), F.col("record_row")),
    })


def best_pairs(scored: DataFrame, *problem: str) -> DataFrame:
    """The best row of each image and key."""
    w = Window.partitionBy(*problem, "image_name", "medicine_unique_key").orderBy(F.desc("assignment_score"), F.desc("final_match_score"), F.asc("strip_row"), F.asc("record_row"))
    return scored.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def greedy(scored: DataFrame, *problem: str) -> DataFrame:
    """Pairs taken from the best down while both sides are free.

    Rounds take all pairs that are the best of their image and of their key at
    once, which is the same as taking them one after the other. Every round takes
    a pair of each problem that has any, so the rounds end by themselves; each is
    checkpointed, and the driver sees only whether pairs are left.
    """
    left = best_pairs(scored, *problem).select(*problem, "image_name", "medicine_unique_key", "assignment_score", "final_match_score", "strip_row", "record_row")
    order = [F.desc("assignment_score"), F.desc("final_match_score"), F.asc("strip_row"), F.asc("record_row"), F.asc("image_name"), F.asc("medicine_unique_key")]
    taken: DataFrame | None = None
    left = checkpointed(left)
    while not left.isEmpty():
        a, b = Window.partitionBy(*problem, "image_name").orderBy(*order), Window.partitionBy(*problem, "medicine_unique_key").orderBy(*order)
        now = checkpointed(left.withColumn("__a", F.row_number().over(a)).withColumn("__b", F.row_number().over(b)).filter("__a = 1 AND __b = 1").drop("__a", "__b"))
        taken = now if taken is None else taken.unionByName(now)
        left = checkpointed(left.join(now, [*problem, "image_name"], "left_anti").join(now, [*problem, "medicine_unique_key"], "left_anti"))
    taken = left.limit(0) if taken is None else taken
    return taken.select(*problem, "image_name", "medicine_unique_key", F.lit("greedy").alias("assignment_method"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared folder of ``spark.checkpoint.dir``."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="rxlink-"))
    return df.checkpoint()


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest full matching; needs rows <= columns.

    Shortest augmenting paths with potentials; the first column wins ties.
    """
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[j]:
            done[j] = True
            row = owner[j]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], j
            free = np.where(done[1:], np.inf, least[1:])
            nxt = int(free.argmin()) + 1
            step = free[nxt - 1]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            j = nxt
        while j:
            owner[j] = owner[came[j]]
            j = came[j]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def solve(group: pd.DataFrame) -> pd.DataFrame:
    """Optimal pairs of one problem: rows image_name, medicine_unique_key, assignment_score, strip_row, record_row."""
    images = group.groupby("image_name")["strip_row"].min().reset_index().sort_values(["strip_row", "image_name"])["image_name"].tolist()
    keys = group.groupby("medicine_unique_key")["record_row"].min().reset_index().sort_values(["record_row", "medicine_unique_key"])["medicine_unique_key"].tolist()
    if len(images) * len(keys) > MAX_CELLS:  # the matrix, and with its smaller side the time, are bounded
        raise ValueError(f"a problem of {len(images)} x {len(keys)} is too large to be solved in one task; split it or use greedy()")
    score = np.full((len(images), len(keys)), -1e18)
    i, k = group["image_name"].map({x: n for n, x in enumerate(images)}).to_numpy(), group["medicine_unique_key"].map({x: n for n, x in enumerate(keys)}).to_numpy()
    score[i, k] = group["assignment_score"].to_numpy()
    flip = len(images) > len(keys)
    cols = hungarian(-(score.T if flip else score))
    pairs = [(c, r) if flip else (r, c) for r, c in enumerate(cols.tolist())]
    pairs = [(r, c) for r, c in sorted(pairs) if score[r, c] > -1e17]
    return pd.DataFrame({"image_name": [images[r] for r, _ in pairs], "medicine_unique_key": [keys[c] for _, c in pairs]})


def optimal(scored: DataFrame, problem: str = "problem") -> DataFrame:
    """The one-to-one pairs with the largest sum of scores, solved for each problem by itself."""
    rows = best_pairs(scored, problem).select(problem, "image_name", "medicine_unique_key", "assignment_score", "strip_row", "record_row")
    sides = scored.groupBy(problem).agg(F.count_distinct("image_name").alias("a"), F.count_distinct("medicine_unique_key").alias("b"))
    large = sides.filter(F.col("a") * F.col("b") > MAX_CELLS).select(F.col(problem).cast("string"), "a", "b").first()
    if large:  # before any task gathers it
        raise ValueError(f"problem {large[0]} of {large[1]} x {large[2]} is too large to be solved in one task; split it or use greedy()")
    kind = rows.schema[problem].dataType.simpleString()

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return solve(group).assign(**{problem: key[0], "assignment_method": "optimal"})[[problem, "image_name", "medicine_unique_key", "assignment_method"]]

    return rows.groupBy(problem).applyInPandas(run, f"{problem} {kind}, image_name string, medicine_unique_key string, assignment_method string")


def with_unmatched(strips: DataFrame, matched: DataFrame) -> DataFrame:
    """Adds the strips that got no record, scores zero."""
    rest = strips.join(matched.select("image_name").distinct(), "image_name", "left_anti")
    rest = rest.withColumns({"final_match_score": F.lit(0.0), "match_confidence": F.lit(UNMATCHED), "assignment_method": F.lit("unmatched")})
    return matched.unionByName(rest, allowMissingColumns=True)


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Non-blank values that occur more than once."""
    return df.filter(~T.is_blank(column)).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def validate_unique(mapping: DataFrame) -> None:
    for column in ("image_name", "medicine_unique_key"):
        twice = [str(r[0]) for r in duplicates(mapping, column).limit(10).collect()]
        if twice:
            raise ValueError(f"{column} is not unique: {', '.join(twice)}")


def final_mapping(strips: DataFrame, records: DataFrame, keep_unmatched: bool = True, method: str = "optimal", check: bool = True, scored: DataFrame | None = None) -> DataFrame:
    """Each strip with at most one record, in 16 columns, by strip row.

    scored: the candidates, if the caller has them already.
    """
    scored = (candidates(strips, records) if scored is None else scored).withColumn("problem", F.lit(1))
    scored = checkpointed(best_pairs(scored, "problem"))  # the pairs are scored once, not again for each use
    pairs = (optimal(scored) if method == "optimal" else greedy(scored, "problem")).drop("problem")
    matched = scored.join(pairs, ["image_name", "medicine_unique_key"]).drop("problem")
    out = with_unmatched(strips, matched) if keep_unmatched else matched
    if check:
        validate_unique(out)
    return projected(out.orderBy("strip_row"), FINAL_COLUMNS)


def summary(mapping: DataFrame) -> DataFrame:
    """One row: rows, distinct images, distinct matched medicines, unmatched images (A4)."""
    key = F.when(~T.is_blank("medicine_unique_key"), F.col("medicine_unique_key"))
    return mapping.agg(
        F.count("*").alias("n_rows"), F.count_distinct("image_name").alias("n_images"), F.count_distinct(key).alias("n_medicines"), F.count_if(key.isNull()).alias("n_unmatched")
    )


def candidate_export(scored: DataFrame) -> DataFrame:
    """Scored pairs as a flat table: two ratios of each comparison beside the scores (K3)."""
    named = {"medicine": "medicine_name", "salt": "salt_name", "combined": "medicine_name_plus_salt_name"}
    ratios = [F.col(f"{k}_scores")[r].alias(f"{n}_{r}") for k, n in named.items() for r in ("partial_ratio", "token_set_ratio")]
    return scored.select("*", *ratios).drop(*[f"{k}_scores" for k in named])
