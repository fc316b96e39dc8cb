"""Registered queries: every operator over the driver's whole tables, with SQL.

The tables hold no prescriptions, so rows are derived from them by expressions
that mean the same in Spark SQL and in the checking SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxlink.functions import extract as E
from rxlink.functions import similarity as S
from rxlink.functions import text as T
from rxlink.operators import layout, mapping, merge, records, resolve
from rxlink.sources.lookups import FORMS, FREQUENCIES, dimension, merge_lookups, override

#: Shorthands of these queries alone, as a dictionary of the user's would bring them.
SHORTHANDS = (
    ("mt-lz", "Montelukast + Levocetirizine", "combination", "two names", "low"), ("azth", "Azithromycin", "medicine_name", "one name", "low"),
    ("cfx", "Cefixime | Cefuroxime", "medicine_name", "two meanings", "high"), ("pnt", "Pantoprazole", "medicine_name", "one name", "medium"), ("rehyd", "Rehydration Salts", "iv_fluid", "no alias", "low"),
)
LK = merge_lookups(medicines=SHORTHANDS)

#: A prescription-like line for each line item, the same text in both dialects.
LINE = (
    "concat(CAST(l_linenumber AS STRING), '. ', CASE l_partkey % 4 WHEN 0 THEN 'Tab ' WHEN 1 THEN 'Cap ' WHEN 2 THEN 'Syrup ' ELSE '' END, p_name, ' ', CAST(p_size AS STRING), ' mg ', "
    "CASE l_suppkey % 3 WHEN 0 THEN '1-0-1' WHEN 1 THEN 'O-I-l' ELSE 'BD' END, CASE l_orderkey % 4 WHEN 0 THEN ' for 5 days' WHEN 1 THEN ' x 2 weeks' WHEN 2 THEN ' 1 month' ELSE '' END, "
    "CASE l_linenumber % 4 WHEN 0 THEN ', After food' WHEN 1 THEN ' PC' WHEN 2 THEN ' at bedtime' ELSE ' once daily' END)"
)
KEYS = "l_orderkey AS doc, l_linenumber AS pos, l_partkey AS part"
RX = f"(SELECT {KEYS}, {LINE} AS line FROM lineitem JOIN part ON l_partkey = p_partkey)"
PART_TEXT = "concat(p_name, CASE p_partkey % 6 WHEN 0 THEN ' Mt-Lz' WHEN 1 THEN ' montelukast levocetirizine tab' WHEN 2 THEN ' azth/rehyd' WHEN 3 THEN ' Vitamin C 500' WHEN 4 THEN ' (cfx)' ELSE ' pnt plus' END)"

#: Tables of a few rows by definition.
SMALL = ("region", "nation")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; one that comes in fewer pieces than there are cores is dealt to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if name in SMALL or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def rx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(*KEYS.split(", "), f"{LINE} AS line")


def _sql_bounded(term: str) -> str:
    return "(?i)(^|[^A-Za-z0-9])" + "".join(c if c.isalnum() or c == " " else "\\" + c for c in term) + "([^A-Za-z0-9]|$)"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- text


@query("SELECT p_partkey, trim(regexp_replace(replace(translate(lower(concat(p_name, '-', p_brand, '/', p_type, ' + X')), '-_/', '   '), '+', ' plus '), '[^a-z0-9]+', ' ', 'g')) AS cleaned FROM part")
def clean_text(spark, d):
    return table(spark, d, "part").select("p_partkey", T.match_text(F.concat("p_name", F.lit("-"), "p_brand", F.lit("/"), "p_type", F.lit(" + X"))).alias("cleaned"))


@query("SELECT c_custkey, trim(regexp_replace(lower(concat('  ', c_name, '   ', c_mktsegment, ' ')), '\\s+', ' ', 'g')) AS norm FROM customer")
def resolver_normalize(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.query_text(F.concat(F.lit("  "), "c_name", F.lit("   "), "c_mktsegment", F.lit(" "))).alias("norm"))


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents), "
    "s AS (SELECT doc_id, pos, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS line FROM l), "
    "f AS (SELECT doc_id, pos, line FROM s WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) = 1) "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n, line FROM f"
)
def line_dedupe_first_seen(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.distinct_lines("text")).alias("n", "line")).select("doc_id", F.col("n").cast("long").alias("n"), "line")


@query("SELECT p_partkey, translate(concat('O', p_name, 'l|I'), 'OoIl|', '00111') AS token FROM part")
def count_token(spark, d):
    return table(spark, d, "part").select("p_partkey", T.count_token(F.concat(F.lit("O"), "p_name", F.lit("l|I"))).alias("token"))


@query("SELECT p_partkey, list_filter(list_transform(string_split_regex(concat(p_name, ' + ', p_type, ' and ', p_brand, ', '), '(?i)\\s*(?:\\+|,|;|/|&|\\band\\b)\\s*'), lambda x: trim(x)), lambda x: x <> '')[1] AS first_part, len(list_filter(string_split_regex(concat(p_name, ' + ', p_type, ' and ', p_brand, ', '), '(?i)\\s*(?:\\+|,|;|/|&|\\band\\b)\\s*'), lambda x: trim(x) <> '')) AS n FROM part")
def salt_components(spark, d):
    parts = T.salt_components(F.concat("p_name", F.lit(" + "), "p_type", F.lit(" and "), "p_brand", F.lit(", ")))
    return table(spark, d, "part").select("p_partkey", F.element_at(parts, 1).alias("first_part"), F.size(parts).cast("long").alias("n"))


@query("SELECT c_custkey, concat('part_', lpad(CAST(c_custkey AS VARCHAR), 20, '0'), '.png') AS natural_key FROM customer")
def natural_sort_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.natural_key(F.concat(F.lit("Part_"), F.col("c_custkey").cast("string"), F.lit(".PNG"))).alias("natural_key"))


@query("SELECT c_custkey, concat('strip_', printf('%03d', c_custkey), '_', trim(regexp_replace(concat(c_name, '#'), '[^A-Za-z0-9_-]', '_', 'g'), '_'), '.png') AS file_name FROM customer")
def upload_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.upload_name(F.concat("c_name", F.lit("#.PNG")), "c_custkey", "strip").alias("file_name"))


@query(
    "SELECT l_orderkey AS doc, l_linenumber AS pos, CASE l_partkey % 4 WHEN 0 THEN concat('a', chr(10), 'Tab ', l_partkey) WHEN 1 THEN concat('Cap ', l_partkey, chr(10), 'two') "
    "WHEN 2 THEN concat('no heading ', l_partkey) ELSE concat('Syrup ', l_partkey, ' advice: kept inside a line') END AS kept FROM lineitem"
)
def rx_section_cut(spark, d):
    n = F.col("l_partkey").cast("string")
    kinds = (("Clinic 12\nRx: one\nRx\na\nTab ", "\nAdvice: rest\nSignature"), ("Name\nMedicines:\nCap ", "\ntwo\n  this is sample text"), ("no heading ", "\nDo not use"), ("prescription (rx):  Syrup ", " advice: kept inside a line"))
    text = F.when(F.lit(False), "")
    for k, (before, after) in enumerate(kinds):
        text = text.when(F.col("l_partkey") % 4 == k, F.concat(F.lit(before), n, F.lit(after)))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), T.prescription_part(text).alias("kept"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN concat('blank_medicine_row_', CAST(p_partkey AS VARCHAR)) ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) END AS key FROM part")
def medicine_unique_key(spark, d):
    return table(spark, d, "part").select("p_partkey", T.unique_key(F.when(F.col("p_size") % 5 == 0, " -- ").otherwise(F.col("p_name")), "p_partkey").alias("key"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE '' END AS chosen FROM orders")
def coalesce_query_text(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(" nan ").alias("medicine_name_normalized"),
        F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderstatus")).alias("medicine_name"), F.lit("").alias("raw_medicine_text"),
    )
    return o.select("o_orderkey", resolve.query_choice(o).alias("chosen"))


# --- extractors

_STRENGTH = "'(?i)\\b\\d+(?:\\.\\d+)?\\s*(?:mg|mcg|g|gm|ml|iu|units?|%)\\b'"
_PATTERN = "'\\b([0-9OoIl|]{1,2})\\s*[-]\\s*([0-9OoIl|]{1,2})\\s*[-]\\s*([0-9OoIl|]{1,2})\\b'"
_DURATION = "'(?i)(?:\\b(?:x|for)\\s*)?(\\d+(?:\\.\\d+)?)\\s*(d|day|days|wk|wks|week|weeks|mo|mos|month|months)\\b'"


@query(f"SELECT doc, pos, part, regexp_extract(line, {_STRENGTH}) AS strength FROM {RX}")
def strength_extract(spark, d):
    return rx_lines(spark, d).select("doc", "pos", "part", E.strength(F.col("line")).alias("strength"))


@query(f"SELECT doc, pos, part, CASE WHEN regexp_matches(line, {_PATTERN}) THEN translate(replace(regexp_extract(line, {_PATTERN}), ' ', ''), 'OoIl|', '00111') ELSE '' END AS dose_pattern FROM {RX}")
def dose_pattern(spark, d):
    return rx_lines(spark, d).select("doc", "pos", "part", E.dose_pattern(F.col("line")).alias("dose_pattern"))


_DOSE = "concat(CAST(l_linenumber % 3 AS STRING), '-', CAST(l_partkey % 2 AS STRING), '-', CAST(l_suppkey % 3 AS STRING))"


@query(
    "SELECT doc, pos, CASE WHEN a + b + c = 0 THEN 'No dose indicated' ELSE concat_ws(', ', CASE WHEN a > 0 THEN concat(a, ' in the morning') END, CASE WHEN b > 0 THEN concat(b, ' in the afternoon') END, "
    "CASE WHEN c > 0 THEN concat(c, ' in the night') END) END AS readable, CAST(a + b + c AS INTEGER) AS times FROM (SELECT l_orderkey AS doc, l_linenumber AS pos, l_linenumber % 3 AS a, l_partkey % 2 AS b, l_suppkey % 3 AS c FROM lineitem)"
)
def dose_readable(spark, d):
    p = F.expr(_DOSE)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), E.readable_dose(p).alias("readable"), E.times_per_day(p).alias("times"))


_FREQ = " ".join(f"WHEN regexp_matches(line, {_quoted(_sql_bounded(t))}) THEN {_quoted(FREQUENCIES[t][0])}" for t in LK.longest(FREQUENCIES))


@query(f"SELECT doc, pos, part, CASE {_FREQ} ELSE '' END AS abbreviation FROM {RX}")
def frequency_longest_match(spark, d):
    return rx_lines(spark, d).select("doc", "pos", "part", E.frequency(F.col("line"), LK)["abbreviation"].alias("abbreviation"))


@query(
    f"SELECT doc, pos, part, CASE WHEN u = '' THEN '' ELSE concat(n, ' ', CASE u[1] WHEN 'd' THEN 'day' WHEN 'w' THEN 'week' ELSE 'month' END, CASE WHEN n = '1' THEN '' ELSE 's' END) END AS duration, "
    f"CASE WHEN u = '' THEN NULL ELSE CAST(n AS DOUBLE) * CASE u[1] WHEN 'd' THEN 1 WHEN 'w' THEN 7 ELSE 30 END END AS days FROM (SELECT doc, pos, part, regexp_extract(line, {_DURATION}, 1) AS n, lower(regexp_extract(line, {_DURATION}, 2)) AS u FROM {RX})"
)
def duration_days(spark, d):
    said, days = E.duration(F.col("line"))
    return rx_lines(spark, d).select("doc", "pos", "part", said.alias("duration"), days.alias("days"))


_HITS = ", ".join(f"CASE WHEN regexp_matches(line, {_quoted(_sql_bounded(t) if t.isalnum() else '(?i)' + t)}) THEN {_quoted(LK.instructions[t])} END" for t in LK.longest(LK.instructions))


@query(f"SELECT doc, pos, part, array_to_string(list_filter(h, lambda x, i: list_position(h, x) = i), '; ') AS meaning FROM (SELECT doc, pos, part, list_filter([{_HITS}], lambda x: x IS NOT NULL) AS h FROM {RX})")
def instruction_all_hits(spark, d):
    return rx_lines(spark, d).select("doc", "pos", "part", E.instructions(F.col("line"), LK)[1].alias("meaning"))


_MED = " ".join(f"WHEN regexp_matches(t, {_quoted(_sql_bounded(k))}) THEN {_quoted(LK.medicines[k][0])}" for k in LK.longest(LK.medicines))
_CLEANED = f"trim(regexp_replace(regexp_replace({PART_TEXT}, '[^A-Za-z0-9+\\-/ ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT p_partkey, CASE {_MED} ELSE t END AS normalized FROM (SELECT p_partkey, {_CLEANED} AS t FROM part)")
def medicine_longest_match(spark, d):
    return table(spark, d, "part").select("p_partkey", E.medicine_match(F.expr(PART_TEXT), LK)["normalized"].alias("normalized"))


_FORMS = "|".join(LK.longest(FORMS))
_FORM_CASE = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in FORMS.items())


@query(f"SELECT doc, pos, part, raw, CASE upper(raw) {_FORM_CASE} ELSE '' END AS meaning FROM (SELECT doc, pos, part, regexp_extract(line, '(?i)\\b({_FORMS})\\b', 1) AS raw FROM {RX})")
def dosage_form(spark, d):
    raw, meaning = E.dosage_form(F.col("line"), LK)
    return rx_lines(spark, d).select("doc", "pos", "part", raw.alias("raw"), meaning.alias("meaning"))


@query(f"SELECT doc, pos, part, regexp_extract(line, '^[0-9]+[.] (.* mg) ', 1) AS head, regexp_extract(line, ' mg (.*)$', 1) AS rest FROM {RX}")
def split_medicine_details(spark, d):
    s = E.split_parts(F.col("line"), LK)
    return rx_lines(spark, d).select("doc", "pos", "part", s.alias("s")).select("doc", "pos", "part", "s.head", "s.rest")


@query(f"SELECT p_partkey, regexp_extract({PART_TEXT}, '(Mt-Lz|montelukast levocetirizine tab|azth/rehyd|Vitamin C 500|cfx[)]|pnt plus)$', 1) AS trimmed FROM part")
def trim_to_anchor(spark, d):
    return table(spark, d, "part").select("p_partkey", E.from_medicine_start(F.expr(PART_TEXT), LK).alias("trimmed"))


@query(f"SELECT doc, pos, part, CASE WHEN regexp_matches(line, 'days|weeks|month') THEN regexp_extract(line, '(days|weeks|month),? (.+)$', 2) ELSE regexp_extract(line, ' (PC)$', 1) END AS tail FROM {RX}")
def trailing_instruction(spark, d):
    return rx_lines(spark, d).select("doc", "pos", "part", E.trailing_instruction(F.col("line")).alias("tail"))


@query("SELECT DISTINCT upper(p_type) AS term, max(p_brand) OVER (PARTITION BY p_type) AS meaning FROM part UNION ALL SELECT * FROM (VALUES ('TAB', 'Tablet'), ('CAP', 'Capsule'))")
def lookup_override(spark, d):
    small = dimension(spark, {"TAB": "Tablet", "CAP": "Capsule", "economy": "old"}).select("term", "meaning")
    return override(small, table(spark, d, "part").select(F.col("p_type").alias("term"), F.col("p_brand").alias("meaning")))


# --- records


def rx_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text an order: its lines in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "line")))
    joined = F.array_join(F.transform(rows, lambda r: r["line"]), "\n")
    return rx_lines(spark, sf_dir).groupBy(F.col("doc").cast("string").alias("source_image")).agg(joined.alias("text"))


@query()
def record_extraction(spark, d):
    return records.extract_records(rx_texts(spark, d), LK)


#: Medicine, dose and whole line of the derived lines, numbered in their order.
_PARTS = "regexp_extract(line, '^[0-9]+[.] (.* mg) ', 1) AS medicine_line, regexp_extract(line, ' mg (.*)$', 1) AS dose_line, '' AS instruction_line, regexp_replace(line, '^[0-9]+[.] ', '') AS raw"
_POS = "CAST(row_number() OVER (PARTITION BY doc ORDER BY pos, line) AS INT) AS pos"


@query(f"SELECT CAST(doc AS VARCHAR) AS source_image, 3 AS parser, {_POS}, {_PARTS} FROM {RX}")
def numbered_blocks(spark, d):
    return records.numbered_blocks(rx_texts(spark, d), LK)


@query(f"SELECT CAST(doc AS VARCHAR) AS source_image, 4 AS parser, n AS pos, {_PARTS} FROM (SELECT doc, line, {_POS.replace('AS pos', 'AS n')} FROM {RX}) WHERE regexp_matches(line, '^[0-9]+[.] (Tab|Cap|Syrup) ')")
def matrix_islands(spark, d):
    return records.table_rows(rx_texts(spark, d), LK)


@query(
    f"WITH l AS (SELECT CAST(doc AS VARCHAR) AS source_image, {_POS}, line, regexp_matches(line, '^[0-9]+[.] (Tab|Cap|Syrup) ') AS own FROM {RX}), "
    "t AS (SELECT source_image, pos - 1 AS pos, own, concat_ws(' ', line, lead(CASE WHEN NOT own THEN line END, 1) OVER w, lead(CASE WHEN NOT own THEN line END, 2) OVER w) AS raw FROM l WINDOW w AS (PARTITION BY source_image ORDER BY pos)) "
    "SELECT source_image, 5 AS parser, min(pos) AS pos, regexp_extract(raw, '^[0-9]+[.] (.*? mg) ', 1) AS medicine_line, regexp_extract(raw, '^.*? mg (.*)$', 1) AS dose_line, '' AS instruction_line, raw FROM t WHERE own GROUP BY source_image, raw"
)
def line_lookahead(spark, d):
    return records.line_rows(rx_texts(spark, d), LK)


@query(
    f"WITH l AS (SELECT CAST(doc AS VARCHAR) AS source_image, {_POS}, regexp_replace(line, '^[0-9]+[.] ', '') AS body, "
    f"lead(regexp_extract(line, '^[0-9]+', 0)) OVER (PARTITION BY doc ORDER BY pos, line) AS next FROM {RX}) "
    "SELECT source_image, 0 AS parser, pos, concat(body, ' ' || next) AS medicine_line, '' AS dose_line, '' AS instruction_line, concat('Medicine: ', body, ' ' || next || '.') AS raw FROM l "
    "UNION ALL SELECT source_image, 1, pos, body, '', '', body FROM l"
)
def labeled_blocks(spark, d):
    texts = rx_texts(spark, d).withColumn("text", F.regexp_replace("text", r"(^|\n)(\d+\. )", "$1$2Medicine: "))
    return records.anywhere_blocks(texts, LK).unionByName(records.line_start_blocks(texts, LK))


@query(
    f"WITH l AS (SELECT CAST(doc AS VARCHAR) AS source_image, {_POS}, regexp_extract(line, '^[0-9]+[.] ([A-Za-z]+) ', 1) AS first, regexp_extract(line, '^[0-9]+[.] [A-Za-z]+ (.*)$', 1) AS body FROM {RX}) "
    "SELECT source_image, 2 AS parser, pos, concat(CASE WHEN first IN ('Tab', 'Cap', 'Syrup') THEN '' ELSE 'Tab ' END, first, CASE WHEN contains(body, ',') THEN '' ELSE ' ' || body END) AS medicine_line, "
    "concat('Form: Tab Strength: ', body) AS dose_line, '' AS instruction_line, concat(first, ' Form: Tab Strength: ', body) AS raw FROM l"
)
def field_label_blocks(spark, d):
    texts = rx_texts(spark, d).withColumn("text", F.regexp_replace("text", r"(^|\n)(\d+\. )(\w+) ", "$1$2Medicine: $3 Form: Tab Strength: "))
    return records.field_blocks(texts, LK)


# --- layout

_WORDS = ("l_orderkey AS image", "l_linenumber AS block_num", "CAST(l_quantity AS DOUBLE) AS left", "CAST(l_suppkey AS DOUBLE) AS top", "10.0D AS width", "4.0D AS height", "concat('w', CAST(l_partkey AS STRING)) AS text")


@query(
    "SELECT image, block_num, string_agg(word, ' ' ORDER BY lft, word) AS text, min(lft) AS min_left, max(lft + 10.0) AS max_right, avg(tp + 2.0) AS cy FROM "
    "(SELECT l_orderkey AS image, l_linenumber AS block_num, CAST(l_quantity AS DOUBLE) AS lft, CAST(l_suppkey AS DOUBLE) AS tp, concat('w', CAST(l_partkey AS VARCHAR)) AS word FROM lineitem) GROUP BY image, block_num"
)
def word_to_line_group(spark, d):
    out = layout.word_lines(table(spark, d, "lineitem").selectExpr(*_WORDS))
    return out.select("image", "block_num", "text", F.col("left").alias("min_left"), F.col("right").alias("max_right"), "cy")


@query(
    "SELECT image, text, cy, lft FROM (SELECT l_orderkey AS image, l_returnflag AS text, CAST(l_suppkey AS DOUBLE) AS cy, CAST(l_quantity AS DOUBLE) AS lft FROM lineitem) "
    "QUALIFY row_number() OVER (PARTITION BY image, lower(text), round_even(cy / 8, 0) ORDER BY cy, lft, text) = 1"
)
def quantised_dedupe(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("text"), F.col("l_suppkey").cast("double").alias("cy"), F.col("l_quantity").cast("double").alias("left"))
    return layout.quantised_dedupe(lines).withColumnRenamed("left", "lft")


_CHAIN = ("l_orderkey AS image", "concat(l_returnflag, repeat('x', CAST(l_partkey % 4 AS INT))) AS text", "CAST(l_suppkey AS DOUBLE) AS cy", "l_quantity AS left")


@query(
    "WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY cy, \"left\", text) AS n FROM "
    f"(SELECT {', '.join(_CHAIN).replace('AS left', 'AS \"left\"')} FROM lineitem)), "
    "s AS (SELECT image, n, 1 AS row, cy, \"left\", text FROM o WHERE n = 1 UNION ALL "
    "SELECT o.image, o.n, CASE WHEN o.cy - s.cy < 16 THEN s.row ELSE s.row + 1 END, CASE WHEN o.cy - s.cy < 16 AND length(o.text) <= length(s.text) THEN s.cy ELSE o.cy END, "
    "CASE WHEN o.cy - s.cy < 16 AND length(o.text) <= length(s.text) THEN s.\"left\" ELSE o.\"left\" END, CASE WHEN o.cy - s.cy < 16 AND length(o.text) <= length(s.text) THEN s.text ELSE o.text END "
    "FROM s JOIN o ON o.image = s.image AND o.n = s.n + 1) "
    "SELECT image, row, cy, \"left\", text FROM s QUALIFY row_number() OVER (PARTITION BY image, row ORDER BY n DESC) = 1"
)
def chain_dedupe_gap(spark, d):
    return layout.chain_dedupe(table(spark, d, "lineitem").selectExpr(*_CHAIN))


_EVENTS = "SELECT event_id, user_id, event_type, epoch_us(ts) / 1000000.0 AS y FROM events"
_ANCHORS = f"(SELECT user_id, event_id, y, row_number() OVER (PARTITION BY user_id ORDER BY y, event_id) AS n, lag(y) OVER (PARTITION BY user_id ORDER BY y, event_id) AS b, lead(y) OVER (PARTITION BY user_id ORDER BY y, event_id) AS a FROM ({_EVENTS}) WHERE event_type = 'view')"
_BANDS = f"(SELECT user_id, event_id, n, y AS cy, greatest(0, coalesce((b + y) / 2, y - 45)) AS upper, coalesce((y + a) / 2, y + 95) AS lower FROM {_ANCHORS})"


def _bands(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / F.lit(1000000.0)).alias("y"))
    w = Window.partitionBy("user_id").orderBy("y", "event_id")
    anchors = e.filter("event_type = 'view'").select(F.col("user_id").alias("image"), "event_id", F.col("y").alias("cy"), F.row_number().over(w).alias("row"))
    points = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("image"), F.col("event_id").alias("point_id"), "y")
    return layout.midpoint_bands(anchors), points


@query(f"SELECT user_id, event_id, upper, lower FROM {_BANDS}")
def midpoint_bands(spark, d):
    return _bands(spark, d)[0].select(F.col("image").alias("user_id"), "event_id", "upper", "lower")


@query(f"SELECT b.user_id, b.event_id, p.event_id AS point_id FROM {_BANDS} b JOIN ({_EVENTS}) p ON p.user_id = b.user_id AND p.event_type = 'purchase' AND p.y BETWEEN b.upper AND b.lower")
def band_join(spark, d):
    bands, points = _bands(spark, d)
    return layout.band_join(bands, points).select(F.col("image").alias("user_id"), "event_id", "point_id")


@query(
    f"SELECT b.user_id, b.event_id, p.event_id AS point_id FROM {_BANDS} b JOIN ({_EVENTS}) p ON p.user_id = b.user_id AND p.event_type = 'purchase' AND p.y BETWEEN b.upper - 20 AND b.lower + 20 "
    "QUALIFY row_number() OVER (PARTITION BY b.user_id, b.event_id ORDER BY abs(p.y - b.cy), p.event_id) = 1"
)
def nearest_in_band(spark, d):
    bands, points = _bands(spark, d)
    return layout.nearest_in_band(bands, points, ties=("point_id",)).select(F.col("image").alias("user_id"), "event_id", "point_id")


@query(
    "SELECT image, part, w, h FROM (SELECT *, max(h) OVER (PARTITION BY image) AS m FROM (SELECT l_orderkey AS image, l_partkey AS part, CAST(round(l_extendedprice / 100) AS INTEGER) AS w, CAST(l_quantity AS INTEGER) AS h FROM lineitem) "
    "WHERE h < 0.8 * w AND h >= 10) WHERE h >= 0.6 * m"
)
def box_max_filter(spark, d):
    boxes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_partkey").alias("part"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.round(F.col("l_extendedprice") / 100).cast("int").alias("x2"), F.col("l_quantity").cast("int").alias("y2"))
    return layout.horizontal_boxes(boxes).select("image", "part", "w", "h")


@query("SELECT l_orderkey AS image, string_agg(concat('w', CAST(l_partkey AS VARCHAR)), ' ' ORDER BY l_linenumber, l_suppkey, concat('w', CAST(l_partkey AS VARCHAR))) AS extracted_text FROM lineitem GROUP BY l_orderkey")
def reading_order_concat(spark, d):
    boxes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("y1"), F.col("l_suppkey").alias("x1"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"))
    return layout.reading_order(boxes)


@query("SELECT c_custkey, CAST(least(greatest(trunc((c_acctbal / 10000) * 1000), 0), 1000) AS INTEGER) AS x FROM customer")
def pixel_scale_clip(spark, d):
    return table(spark, d, "customer").select("c_custkey", layout.scaled_box(F.col("c_acctbal") / 10000, F.lit(1000)).alias("x"))


@query()
def layout_records(spark, d):
    words = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("image"), F.col("l_linenumber").alias("line_num"), F.lit(50.0).alias("left"), (F.col("l_linenumber") * 100.0).alias("top"), F.lit(10.0).alias("width"), F.lit(4.0).alias("height"),
        F.concat(F.lit("NAME: Tab "), "p_name", F.lit(" 500 mg DOSE: 1-0-1 DURATION: 5 DAYS")).alias("text"),
    )
    return layout.layout_records(words, LK)


# --- merging


def _extractions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("source_image"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("record_number_in_image"),
        F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("medicine_name"), "o_orderkey", "o_orderpriority", "o_orderstatus",
    )
    keep = ("source_image", "record_number_in_image", "medicine_name")
    a = o.select(*keep, F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("strength"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("nan")).otherwise(F.col("o_orderstatus")).alias("duration"))
    b = o.filter("o_orderkey % 7 > 0").select(*keep, F.lit("b").alias("strength"), F.lit("3 days").alias("duration"))
    return a, b


@query(
    "SELECT source_image, count(*) AS usable, CAST(sum(1 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS score FROM (SELECT CAST(o_custkey AS VARCHAR) AS source_image, o_orderkey FROM orders) GROUP BY source_image"
)
def completeness_score(spark, d):
    return merge.stats(_extractions(spark, d)[0], "a", "source_image").select(F.col("__image").alias("source_image"), F.col("a_rows").alias("usable"), F.col("a_score").cast("long").alias("score"))


_AB = (
    "WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS img, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, concat('m', o_orderkey) AS name, o_orderpriority AS p, o_orderstatus AS s FROM orders), "
    "a AS (SELECT img, n, name, CASE WHEN k % 2 = 0 THEN p END AS strength, CASE WHEN k % 5 = 0 THEN 'nan' ELSE s END AS duration FROM o), "
    "b AS (SELECT img, row_number() OVER (PARTITION BY img ORDER BY n) AS n, name, 'b' AS strength, '3 days' AS duration FROM o WHERE k % 7 > 0), "
    "sa AS (SELECT img, count(*) AS r, sum(1 + CASE WHEN strength IS NULL THEN 0 ELSE 1 END + CASE WHEN duration = 'nan' THEN 0 ELSE 1 END) AS f FROM a GROUP BY img), sb AS (SELECT img, count(*) AS r, sum(3) AS f FROM b GROUP BY img), "
    "c AS (SELECT sa.img, CASE WHEN coalesce(sb.r, 0) > sa.r THEN 'b' WHEN coalesce(sb.r, 0) = sa.r THEN 'fill' WHEN coalesce(sb.f, 0) > sa.f THEN 'b' ELSE 'a' END AS pick FROM sa LEFT JOIN sb ON sa.img = sb.img) "
    "SELECT a.img AS source_image, a.n AS record_number_in_image, a.name AS medicine_name, CASE WHEN pick = 'fill' AND a.strength IS NULL THEN b.strength ELSE a.strength END AS strength, CASE WHEN pick = 'fill' AND a.duration = 'nan' THEN b.duration ELSE a.duration END AS duration "
    "FROM a JOIN c ON a.img = c.img LEFT JOIN b ON a.img = b.img AND a.n = b.n WHERE pick <> 'b' UNION ALL SELECT b.img, b.n, b.name, b.strength, b.duration FROM b JOIN c ON b.img = c.img WHERE pick = 'b'"
)


@query(_AB)
def extractor_merge(spark, d):
    out = merge.merge_extractions(*_extractions(spark, d))
    return out.select("source_image", F.col("record_number_in_image").cast("long").alias("record_number_in_image"), "medicine_name", "strength", "duration")


@query("SELECT CAST(c_custkey AS VARCHAR) AS source_image FROM customer UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders")
def image_set_union(spark, d):
    return merge.image_names(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("source_image")), table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("source_image")))


@query(
    "SELECT CAST(o_custkey AS VARCHAR) AS source_image, concat('m', o_orderkey) AS medicine_name, NULL::VARCHAR AS error FROM orders UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, 'no medicine record found' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"
)
def empty_error_rows(spark, d):
    images = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("source_image"))
    return merge.error_rows(images, _extractions(spark, d)[0]).select("source_image", "medicine_name", "error")


# --- projections and scoring


@query("SELECT n_nationkey AS prescription_n_nationkey, n_name AS prescription_n_name, n_regionkey AS prescription_n_regionkey FROM nation")
def prefix_projection(spark, d):
    return mapping.prefixed(table(spark, d, "nation"))


@query("SELECT r_name, '' AS strength, '' AS duration FROM region")
def missing_column_projection(spark, d):
    return mapping.projected(table(spark, d, "region"), ("r_name", "strength", "duration"), blank=True)


_LABEL = "CASE WHEN top >= 85 THEN 'High confidence' WHEN top >= 70 THEN 'Medium confidence' WHEN top >= 50 THEN 'Low confidence' ELSE 'Very low confidence' END"


@query(
    f"SELECT doc, pos, CASE WHEN m = top THEN 'medicine_name' WHEN s = top THEN 'salt_name' ELSE 'medicine_name_plus_salt_name' END AS basis, top, {_LABEL} AS label FROM "
    "(SELECT *, greatest(m, s, c) AS top FROM (SELECT l_orderkey AS doc, l_linenumber AS pos, CAST(l_quantity * 2 AS DOUBLE) AS m, CAST(l_suppkey % 90 AS DOUBLE) AS s, CAST(l_partkey % 80 AS DOUBLE) AS c FROM lineitem))"
)
def best_basis_confidence(spark, d):
    m, s, c = (F.col("l_quantity") * 2).cast("double"), (F.col("l_suppkey") % 90).cast("double"), (F.col("l_partkey") % 80).cast("double")
    basis, top = mapping.best_basis(m, s, c)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), basis.alias("basis"), top.alias("top"), mapping.confidence(top).alias("label"))


_SCORED = "(SELECT CAST(l_orderkey AS VARCHAR) AS image_name, CAST(l_suppkey AS VARCHAR) AS medicine_unique_key, l_extendedprice AS assignment_score, l_quantity AS final_match_score, l_linenumber AS strip_row, l_partkey AS record_row FROM lineitem)"


@query(f"SELECT image_name, medicine_unique_key, assignment_score, strip_row, record_row FROM {_SCORED} QUALIFY row_number() OVER (PARTITION BY image_name, medicine_unique_key ORDER BY assignment_score DESC, final_match_score DESC, strip_row, record_row) = 1")
def best_pair_topn(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("image_name"), F.col("l_suppkey").cast("string").alias("medicine_unique_key"), F.col("l_extendedprice").alias("assignment_score"), F.col("l_quantity").alias("final_match_score"), F.col("l_linenumber").alias("strip_row"), F.col("l_partkey").alias("record_row"))
    return mapping.best_pairs(rows).drop("final_match_score")


@query("SELECT c_name AS image_name, CASE WHEN k IS NULL THEN 0.0::DOUBLE ELSE k END AS final_match_score, CASE WHEN k IS NULL THEN 'unmatched' ELSE 'greedy' END AS assignment_method FROM customer LEFT JOIN (SELECT o_custkey, CAST(max(o_orderkey) AS DOUBLE) AS k FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey) ON c_custkey = o_custkey")
def unmatched_antijoin(spark, d):
    strips = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("image_name"))
    best = table(spark, d, "orders").filter("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").cast("double").alias("final_match_score"))
    matched = strips.join(best, "c_custkey").withColumn("assignment_method", F.lit("greedy"))
    return mapping.with_unmatched(strips, matched).select("image_name", "final_match_score", "assignment_method")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_check(spark, d):
    return mapping.duplicates(table(spark, d, "part"), "p_name")


@query("SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_images, count(DISTINCT CASE WHEN o_orderkey % 4 > 1 THEN o_custkey END) AS n_medicines, count(*) FILTER (WHERE o_orderkey % 4 < 2) AS n_unmatched FROM orders")
def mapping_summary(spark, d):
    key = F.when(F.col("o_orderkey") % 4 > 1, F.col("o_custkey").cast("string")).when(F.col("o_orderkey") % 4 == 1, F.lit(" "))
    return mapping.summary(table(spark, d, "orders").select(F.col("o_orderkey").alias("image_name"), key.alias("medicine_unique_key")))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderpriority, o_orderkey) AS rank FROM orders")
def multi_key_sort_rank(spark, d):
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderpriority", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rank"))


# --- similarity and retrieval

_LCS = (
    "WITH RECURSIVE p AS (SELECT s_suppkey, a.n_name AS x, concat(r_name, ' ', s_name) AS y FROM supplier JOIN nation a ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), "
    "r AS (SELECT s_suppkey, string_split(x, '') AS a, string_split(y, '') AS b, 0 AS i, list_transform(range(1, length(y) + 1), lambda k: 0) AS m FROM p "
    "UNION ALL SELECT s_suppkey, a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(m[k], CASE WHEN b[k] = a[i + 1] THEN coalesce(m[k - 1], 0) + 1 ELSE 0 END)))) FROM r WHERE i < len(a)) "
    "SELECT s_suppkey, round(200.0 * m[len(m)] / (len(a) + len(b)), 6) AS ratio FROM r WHERE i = len(a)"
)


@query(_LCS)
def indel_ratio(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    df = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by definition
    return df.select("s_suppkey", F.round(S.native_ratio(F.col("n_name"), F.concat_ws(" ", "r_name", "s_name")), 6).alias("ratio"))


def _strips(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    df = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return df.select(F.col("s_name").alias("image_name"), F.concat_ws(" ", "n_name", F.lit("batch"), F.col("s_suppkey").cast("string")).alias("extracted_text"), (F.col("s_suppkey") + 1).alias("strip_row"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("medicine_name"), F.col("r_name").alias("salt_name"), (F.col("n_nationkey") + 1).cast("long").alias("record_row"))


@query()
def candidate_scores(spark, d):
    keep = ("image_name", "medicine_unique_key", "medicine_score", "salt_score", "combined_score", "best_match_basis", "final_match_score", "match_confidence", "assignment_score")
    return mapping.candidates(_strips(spark, d), _records(spark, d)).select(*keep)


@query()
def final_mapping(spark, d):
    return mapping.final_mapping(_strips(spark, d), _records(spark, d))


@query()
def optimal_assignment(spark, d):
    return mapping.optimal(mapping.candidates(_strips(spark, d), _records(spark, d)).withColumn("problem", F.lit(1)))


@query()
def greedy_assignment(spark, d):
    return mapping.greedy(mapping.candidates(_strips(spark, d), _records(spark, d)))


def _catalog(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("medicine"), F.array("p_type").alias("salts"))
    return resolve.build_catalog(rows)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_name").alias("q")).distinct().withColumn("norm", T.query_text("q"))


@query("WITH c AS (SELECT DISTINCT concat(p_name, ' ', p_size) AS name FROM part), q AS (SELECT DISTINCT concat(upper(p_name), '  ', p_size) AS q FROM part) SELECT q, name FROM q JOIN c ON trim(regexp_replace(lower(q), '\\s+', ' ', 'g')) = lower(name)")
def exact_lookup(spark, d):
    asked = table(spark, d, "part").select(F.concat(F.upper("p_name"), F.lit("  "), F.col("p_size").cast("string")).alias("q")).distinct().withColumn("norm", T.query_text("q"))
    return resolve.exact_matches(asked, _catalog(spark, d)[0]).select("q", "name")


_GRAMS = "list_transform(range(1, length(n) + 1), lambda i: substr(concat(' ', n, ' '), i, 3))"


@query(
    f"WITH c AS (SELECT DISTINCT lower(concat(p_name, ' ', p_size)) AS n FROM part), q AS (SELECT DISTINCT lower(p_name) AS n FROM part), "
    f"ct AS (SELECT n, g, count(*) AS tf FROM (SELECT n, unnest({_GRAMS}) AS g FROM c) GROUP BY n, g), qt AS (SELECT n, g, count(*) AS tf FROM (SELECT n, unnest({_GRAMS}) AS g FROM q) GROUP BY n, g), "
    "idf AS (SELECT g, ln((1 + (SELECT count(*) FROM c)) / (1.0 + count(*))) + 1 AS v FROM ct GROUP BY g), "
    "cw AS (SELECT n, g, tf * v / sqrt(sum(tf * v * tf * v) OVER (PARTITION BY n)) AS w FROM ct JOIN idf USING (g)), qw AS (SELECT n, g, tf * v / sqrt(sum(tf * v * tf * v) OVER (PARTITION BY n)) AS w FROM qt JOIN idf USING (g)), "
    "s AS (SELECT qw.n AS q, cw.n AS name, round(sum(qw.w * cw.w), 6) AS score FROM qw JOIN cw USING (g) GROUP BY 1, 2) "
    "SELECT q, name, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, name) AS r FROM s) WHERE r <= 5 AND score >= 0.72"
)
def tfidf_topk(spark, d):
    out = resolve.top_by_weight(_asked(spark, d), _catalog(spark, d)[0], resolve.TOP_K, resolve.MEDICINE)
    return out.select("q", "name", "score")


@query(
    "WITH m AS (SELECT CAST(o_custkey AS VARCHAR) AS q, CASE o_orderkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' ELSE 'tfidf' END AS t, o_orderpriority AS name, lower(o_orderpriority) AS nn, o_totalprice AS score FROM orders), "
    "x AS (SELECT *, CASE t WHEN 'exact' THEN 3 WHEN 'fuzzy' THEN 2 ELSE 1 END AS tier FROM m), y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY q, nn ORDER BY tier DESC, score DESC, name) = 1) "
    "SELECT q, name, score, rank FROM (SELECT q, name, score, row_number() OVER (PARTITION BY q ORDER BY tier DESC, score DESC, name) AS rank FROM y) WHERE rank <= 3"
)
def tier_merge(spark, d):
    t = F.col("o_orderkey") % 3
    m = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("q"), F.col("o_orderpriority").alias("name"), F.lower("o_orderpriority").alias("name_norm"), F.col("o_totalprice").alias("score"), F.when(t == 0, "exact").when(t == 1, "fuzzy").otherwise("tfidf").alias("match_type"))
    return resolve.merge_tiers(m, 3).select("q", "name", "score", F.col("rank").cast("long").alias("rank"))


@query()
def resolve_batch(spark, d):
    medicine, salt = _catalog(spark, d)
    asked = table(spark, d, "part").select(F.col("p_name").alias("input")).distinct()
    return resolve.resolve(asked, medicine, salt)
