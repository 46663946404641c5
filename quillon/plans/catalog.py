"""The queries over the shared tables, each with DuckDB SQL where SQL can express it.

Numbers that depend on the order of summation are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORICAL, DENSE_FEATURES, MISSING, POLICIES, RAW_COLUMNS, DatasetConfig, FeatureConfig, TrainingConfig
from ..functions import columns as C
from ..operators import bands, calibration, dataset, draws, drift, metrics, monitoring, policy, profiling, quality, ranking, rolling, steps, training, weight_table
from ..sources import quoted, scratch, tables
from ..streaming import serving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DATASET = DatasetConfig(features=FeatureConfig(hash_dimension=1024), start="2026-01-01T00:00:00Z")
CONTIGUOUS = DatasetConfig(split_strategy="contiguous", train_ratio=0.5, validation_ratio=0.25, test_ratio=0.25)
#: A small published model, for queries that need fixed weights.
WEIGHTS = training.Model(-1.25, [0.11, 0.05, -0.02, -0.3, 0.07, 0.2, 0.4], dense_names=list(DENSE_FEATURES))


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


_SCORED = """scored AS (SELECT event_id, 'prediction_' || event_id AS prediction_id, ts, user_id, event_type,
  CASE user_id % 3 WHEN 0 THEN 'bank_marketing' WHEN 1 THEN 'fraud_policy' ELSE 'loan_policy' END AS task_context,
  (CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) + 0.5::DOUBLE) / 100 AS p,
  CAST(event_type = 'purchase' AS INTEGER) AS label, 1.0::DOUBLE + event_id % 3 AS w, value AS latency_ms FROM events)"""
_BANDS = "VALUES " + ", ".join(
    f"('{name}', {low}::DOUBLE, {band.below if band.below is not None else 1e9}::DOUBLE, '{band.action}', '{band.reason}', {band.threshold}::DOUBLE, {str(band.review).lower()}, '{p.positive_action}')"
    for name, p in POLICIES.items()
    for low, band in zip([-1e9, *(b.below for b in p.bands[:-1])], p.bands, strict=True)
)
_ROUTED = f"""{_SCORED}, bands(task_context, lo, hi, action, action_reason, threshold_value, review, positive) AS ({_BANDS}),
  routed AS (SELECT s.*, b.* EXCLUDE (task_context) FROM scored s JOIN bands b ON s.task_context = b.task_context AND s.p >= b.lo AND s.p < b.hi)"""
_DECIDED = f"""{_ROUTED}, decided AS (SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN 'lost_' || prediction_id ELSE prediction_id END AS prediction_id),
  CASE WHEN event_id % 7 <> 0 THEN label END AS realized_label, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 30 AS INTEGER) END AS outcome_delay_days,
  CASE WHEN event_id % 11 <> 0 THEN p END AS cal, CASE WHEN event_id % 13 <> 0 THEN p * 0.9::DOUBLE + 0.02::DOUBLE END AS raw FROM routed WHERE event_id % 10 <> 0)"""
_CONTACTS = """contacts AS (SELECT o.o_orderkey AS row_id, o.o_orderdate AS event_ts, CAST(o_orderstatus = 'F' AS INTEGER) AS label,
  18 + o_custkey % 60 AS age, c_mktsegment AS job, o_orderpriority AS marital, n_name AS education,
  CASE WHEN o.o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS "default", c_acctbal AS balance, CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS housing,
  CASE WHEN o_custkey % 3 = 0 THEN 'yes' ELSE 'no' END AS loan, r_name AS contact, day(o_orderdate) AS day, lower(strftime(o_orderdate, '%b')) AS month,
  o.o_orderkey % 600 AS duration, coalesce(l.n, 0) AS campaign,
  coalesce(date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER h, CAST(o_orderdate AS DATE)), -1) AS pdays, row_number() OVER h - 1 AS previous, lag(o_orderstatus) OVER h AS poutcome
  FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o.o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WINDOW h AS (PARTITION BY o_custkey ORDER BY o_orderdate, o.o_orderkey))"""
_DENSE = f"""{_CONTACTS}, dense AS (SELECT row_id, label, ln(1 + age::DOUBLE) AS age, sign(balance) * ln(1 + abs(balance)) AS balance, ln(1 + day::DOUBLE) AS day,
  ln(1 + campaign::DOUBLE) AS campaign, ln(1 + greatest(pdays, 0)::DOUBLE) AS pdays, ln(1 + previous::DOUBLE) AS previous, CASE WHEN pdays >= 0 THEN 1.0::DOUBLE ELSE 0.0 END AS prior_contact_flag FROM contacts)"""
_LOGIT = f"""{_DENSE}, logits AS (SELECT row_id, label, {WEIGHTS.bias}::DOUBLE + {" + ".join(f"{n} * {w}::DOUBLE" for n, w in zip(DENSE_FEATURES, WEIGHTS.dense, strict=True))} AS x FROM dense),
  probs AS (SELECT *, 1 / (1 + exp(-x)) AS prob FROM logits)"""
_GROUPS = f"{_SCORED}, g AS (SELECT task_context, p, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN label = 1 THEN 0 ELSE w END) AS neg FROM scored GROUP BY 1, 2)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scored_events(spark, sf_dir)


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_groups(_events(spark, sf_dir), ["task_context"])


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.with_identity(tables.contacts(spark, sf_dir), DATASET)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.contacts(spark, sf_dir).select("row_id", "label", *C.dense_columns(DATASET.features))


# Files
@query("""SELECT doc_id, source, length(text) AS chars, sha256(text) AS digest FROM documents""")
def quoted_csv(spark, sf_dir):
    """Documents, whose texts hold line breaks, quotes and separators, written as delimited files and read back by the scan of
    quoted breaks."""
    columns = ["doc_id", "text", "source"]
    path = scratch.new_path(spark, "documents")
    tables.table(spark, sf_dir, "documents").select(*columns).write.csv(path, sep=";", quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    options = {"sep": ";", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "emptyValue": "", "nullValue": "\\N"}
    rows = quoted.read_records(spark, path).select(F.from_csv("record", "doc_id long, text string, source string", options).alias("r")).select("r.*")
    return rows.select("doc_id", "source", F.char_length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest"))


# Decisions
@query(f"""WITH {_ROUTED} SELECT task_context, action, count(*) AS decision_count, round(avg(review::INT), 6) AS manual_review_rate, round(sum(label) / count(*), 6) AS positive_rate,
 round(avg(p), 6) AS mean_probability, round(avg((action = positive)::INT), 6) AS positive_action_rate FROM routed GROUP BY GROUPING SETS ((task_context, action), (task_context))""")
def policy_rollup(spark, sf_dir):
    rows = policy.summarise(policy.decide(_events(spark, sf_dir)), label="label")
    return rounded(rows.withColumnRenamed("mean_calibrated_probability", "mean_probability"), "manual_review_rate", "positive_rate", "mean_probability", "positive_action_rate").drop("all_actions")


@query(f"""WITH {_ROUTED} SELECT prediction_id, task_context, action, action_reason, threshold_value, review AS manual_review_required FROM routed""")
def decision_outcomes(spark, sf_dir):
    return policy.decide(_events(spark, sf_dir)).select("prediction_id", "task_context", "action", "action_reason", "threshold_value", "manual_review_required")


@query(f"""WITH {_SCORED}, bands(task_context, lo, hi, action, r, t, review, positive) AS ({_BANDS}) SELECT b.task_context, action, count(*) AS n, sum(label)::BIGINT AS positives
 FROM scored s JOIN bands b ON s.p >= b.lo AND s.p < b.hi GROUP BY 1, 2""")
def policy_simulation(spark, sf_dir):
    return policy.simulate(_events(spark, sf_dir)).groupBy("task_context", "action").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


_SHIFT, _FROM = 0.05, "2024-01-16 12:00:00"


@query(f"""WITH {_SCORED}, bands(task_context, lo, hi, action, reason, threshold_value, review, positive) AS ({_BANDS}),
 versions AS (SELECT *, 0.0::DOUBLE AS shift, '' AS suffix, TIMESTAMP '1970-01-01' AS since, TIMESTAMP '{_FROM}' AS until FROM bands UNION ALL SELECT *, {_SHIFT}, '_next', TIMESTAMP '{_FROM}', TIMESTAMP '9999-01-01' FROM bands WHERE task_context <> 'fraud_policy'
  UNION ALL SELECT *, 0.0::DOUBLE, '', TIMESTAMP '{_FROM}', TIMESTAMP '9999-01-01' FROM bands WHERE task_context = 'fraud_policy')
 SELECT prediction_id, s.task_context, b.action, reason AS action_reason, threshold_value, review AS manual_review_required, suffix AS version FROM scored s JOIN versions b ON s.task_context = b.task_context AND ts >= since AND ts < until AND p >= lo + shift AND p < hi + shift""")
def versioned_decisions(spark, sf_dir):
    """Decisions by the bands in force at their time; two of the contexts take other thresholds half-way."""
    first = bands.fixed_bands(spark)
    moved = {"lower": F.col("lower") + _SHIFT, "below": F.col("below") + _SHIFT, "valid_from": F.lit(_FROM).cast("timestamp"), "version": F.concat("version", F.lit("_next"))}
    table = first.unionByName(first.filter("task_context <> 'fraud_policy'").withColumns(moved))
    found = bands.decide_by_version(_events(spark, sf_dir), table, at="ts")
    suffix = F.when(F.col("decision_policy_version").endswith("_next"), "_next").otherwise("")
    return found.select("prediction_id", "task_context", "action", "action_reason", "threshold_value", "manual_review_required", suffix.alias("version"))


# Contacts, features, contracts, splits
@query(f"""WITH {_CONTACTS} SELECT row_id, label, age::BIGINT AS age, job, marital, education, "default", balance, housing, loan, contact, day::BIGINT AS day, month, campaign::BIGINT AS campaign, pdays::BIGINT AS pdays, previous::BIGINT AS previous, poutcome FROM contacts""")
def contacts_base(spark, sf_dir):
    number = {c: F.col(c).cast("long") for c in ("age", "day", "campaign", "pdays", "previous")} | {"balance": F.col("balance").cast("double")}
    return tables.contacts(spark, sf_dir).withColumns(number).drop("event_ts", "duration")


@query(f"""WITH {_DENSE} SELECT row_id, {", ".join(f"round({n}, 6) AS {n}" for n in DENSE_FEATURES)} FROM dense""")
def dense_features(spark, sf_dir):
    return rounded(_dense(spark, sf_dir), *DENSE_FEATURES).drop("label")


def _known_tokens() -> list[str]:
    values = {
        "job": ["MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"], "marital": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
        "education": [f"NATION_{i}" for i in range(25)], "contact": ["ASIA", "AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"], "poutcome": ["F", "O", "P", MISSING],
        "month": "jan feb mar apr may jun jul aug sep oct nov dec".split(), **{n: ["yes", "no"] for n in ("default", "housing", "loan")},
    }
    return [f"{name}={value}" for name, found in values.items() for value in found]


@query(
    f"""WITH {_CONTACTS}, ids(token, id) AS (VALUES {", ".join(f"('{t}', {C.hash_token(t, 1024)}::BIGINT)" for t in _known_tokens())}),
 slots AS (SELECT row_id, unnest([{", ".join(f"'{n}=' || coalesce({chr(34)}{n}{chr(34)}, '{MISSING}')" for n in CATEGORICAL)}]) AS token, unnest(range(9)) AS slot FROM contacts)
 SELECT row_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY slot) AS ids FROM slots JOIN ids USING (token) GROUP BY 1"""
)
def sparse_features(spark, sf_dir):
    ids = C.hashed_tokens(C.sparse_tokens(DATASET.features), 1024)
    return tables.contacts(spark, sf_dir).withColumn("i", ids).select("row_id", F.array_join(F.col("i").cast("array<string>"), ",").alias("ids"))


_FRACTION = "list_reduce(list_prepend(0, list_transform(string_split('evt_' || lpad(CAST(row_id AS VARCHAR), 12, '0'), ''), lambda c: ascii(c))), lambda h, c: (h * 131 + c) % 10000) / 10000.0::DOUBLE"


@query(f"""WITH {_CONTACTS}, s AS (SELECT label, CASE WHEN {_FRACTION} < 0.8::DOUBLE THEN 'train' WHEN {_FRACTION} < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM contacts)
 SELECT split, count(*) AS rows, sum(label)::BIGINT AS positives, round(avg(label), 6) AS positive_rate FROM s GROUP BY 1""")
def hash_split_stats(spark, sf_dir):
    return rounded(dataset.summary(dataset.with_split(_contacts(spark, sf_dir), DATASET)), "positive_rate")


@query(f"""WITH {_CONTACTS}, s AS (SELECT label, CASE WHEN (row_id + 1) / (count(*) OVER ())::DOUBLE < 0.5 THEN 'train' WHEN (row_id + 1) / (count(*) OVER ())::DOUBLE < 0.75 THEN 'validation' ELSE 'test' END AS split FROM contacts)
 SELECT split, count(*) AS rows, sum(label)::BIGINT AS positives, round(avg(label), 6) AS positive_rate FROM s GROUP BY 1""")
def contiguous_split_stats(spark, sf_dir):
    return rounded(dataset.summary(dataset.with_split(_contacts(spark, sf_dir), CONTIGUOUS)), "positive_rate")


@query(f"""WITH {_CONTACTS} SELECT 'evt_' || lpad(row_id::VARCHAR, 12, '0') AS event_id, strftime(event_ts, '%Y-%m-%d') AS event_date, 'req_' || lpad(row_id::VARCHAR, 12, '0') AS request_id,
 'campaign_' || lpad((row_id // 100)::VARCHAR, 6, '0') AS campaign_id, 16 - (poutcome IS NULL)::INT AS features, 'bank_full_csv' AS source_name FROM contacts""")
def raw_event_contract(spark, sf_dir):
    rows = dataset.contact_events(_contacts(spark, sf_dir), DATASET)
    return rows.select("event_id", F.col("event_date").cast("string").alias("event_date"), "request_id", "campaign_id", F.size("context_features").alias("features"), "source_name")


@query(f"""WITH {_CONTACTS} SELECT 'lbl_' || lpad(row_id::VARCHAR, 12, '0') AS label_event_id, 'evt_' || lpad(row_id::VARCHAR, 12, '0') AS parent_event_id, strftime(event_ts, '%Y-%m-%d') AS label_date, label AS subscribed, 24 AS attribution_window_hours FROM contacts""")
def label_contract(spark, sf_dir):
    rows = dataset.subscription_labels(_contacts(spark, sf_dir), DATASET)
    return rows.select("label_event_id", "parent_event_id", F.col("label_date").cast("string").alias("label_date"), "subscribed", "attribution_window_hours")


@query(f"""WITH {_DENSE} SELECT 'trn_' || lpad(row_id::VARCHAR, 12, '0') AS training_row_id, label, 7 AS dense_count, 9 AS sparse_count, round({" + ".join(DENSE_FEATURES)}, 5) AS dense_sum FROM dense""")
def training_rows(spark, sf_dir):
    rows = dataset.training_rows(_contacts(spark, sf_dir), DATASET)
    total = F.aggregate("dense_features", F.lit(0.0), lambda a, x: a + x)
    return rows.select("training_row_id", "label", F.size("dense_features").alias("dense_count"), F.size("sparse_feature_ids").alias("sparse_count"), F.round(total, 5).alias("dense_sum"))


@query(f"""WITH {_CONTACTS} SELECT label, count(*) AS matched, max(row_id % 50) AS longest_hours FROM contacts WHERE row_id % 7 <> 0 AND row_id % 50 <= 24 GROUP BY 1""")
def labels_within_window(spark, sf_dir):
    """Labels come up to 49 hours late and some never, so about half are inside the window of a day."""
    rows = _contacts(spark, sf_dir)
    late = (F.col("row_id") % 50).cast("int")
    labels = dataset.subscription_labels(rows.filter("row_id % 7 <> 0").withColumn("late", late), DATASET, delay=F.make_dt_interval(hours=F.col("late")))
    hours = (F.unix_timestamp("label_ts") - F.unix_timestamp("event_ts")) / 3600
    return dataset.labelled_events(dataset.contact_events(rows, DATASET), labels).groupBy(F.col("subscribed").alias("label")).agg(F.count("*").alias("matched"), F.max(hours).cast("long").alias("longest_hours"))


# Scores and metrics
@query(f"WITH {_LOGIT} SELECT row_id, round(x, 6) AS raw_score, round(prob, 6) AS probability FROM probs")
def linear_score(spark, sf_dir):
    rows = _dense(spark, sf_dir)
    x = training.score_column(WEIGHTS, DENSE_FEATURES)
    return rounded(rows.select("row_id", x.alias("raw_score"), C.sigmoid(x).alias("probability")), "raw_score", "probability")


@query(f"""WITH {_CONTACTS}, ids(token, weight) AS (VALUES {", ".join(f"('{t}', {(C.hash_token(t, 1024) % 17 - 8) / 10}::DOUBLE)" for t in _known_tokens())}),
 slots AS (SELECT row_id, unnest([{", ".join(f"'{n}=' || coalesce({chr(34)}{n}{chr(34)}, '{MISSING}')" for n in CATEGORICAL)}]) AS token FROM contacts)
 SELECT row_id, round(-0.5 + sum(weight), 6) + 0.0::DOUBLE AS raw_score FROM slots JOIN ids USING (token) GROUP BY 1""")
def sparse_score_join(spark, sf_dir):
    """Sparse weights as a table that is joined to the active ids."""
    model = training.Model(-0.5, [], {i: (i % 17 - 8) / 10 for i in range(1024)})
    ids = C.hashed_tokens(C.sparse_tokens(DATASET.features), 1024)
    rows = tables.contacts(spark, sf_dir).select("row_id", ids.alias("sparse_feature_ids"), F.array_repeat(F.lit(1.0), 9).alias("sparse_feature_values"), F.array().cast("array<double>").alias("dense_features"))
    scored = training.with_table_logit(rows, model.weights_table(spark), model.bias)
    return rounded(scored, "raw_score").select("row_id", (F.col("raw_score") + 0.0).alias("raw_score"))


@query(f"""WITH {_SCORED} SELECT task_context, count(*) AS example_count, round(sum(w * -(label * ln(p) + (1 - label) * ln(1 - p))) / sum(w), 6) AS log_loss, round(sum(w * (p - label) * (p - label)) / sum(w), 6) AS brier_score FROM scored GROUP BY 1""")
def losses(spark, sf_dir):
    return rounded(metrics.losses(_groups(spark, sf_dir), ["task_context"]).select("task_context", "example_count", "log_loss", "brier_score"), "log_loss", "brier_score")


@query(f"""WITH {_GROUPS}, c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY task_context ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
 SELECT task_context, round(sum(pos * (before + neg / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c GROUP BY 1""")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(_groups(spark, sf_dir), ["task_context"]), "roc_auc")


@query(f"""WITH {_GROUPS}, c AS (SELECT *, sum(pos) OVER h AS tp, sum(pos + neg) OVER h AS n, sum(pos) OVER (PARTITION BY task_context) AS total FROM g WINDOW h AS (PARTITION BY task_context ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
 SELECT task_context, round(sum(tp / n * pos / total), 6) AS pr_auc FROM c GROUP BY 1""")
def pr_auc(spark, sf_dir):
    return rounded(metrics.pr_auc(_groups(spark, sf_dir), ["task_context"]), "pr_auc")


_BINS = f"""{_GROUPS}, b AS (SELECT task_context, least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, sum(pos + neg) AS weight, sum((pos + neg) * p) / sum(pos + neg) AS mean_score, sum(pos) / sum(pos + neg) AS observed FROM g GROUP BY 1, 2)"""


@query(f"WITH {_BINS} SELECT task_context, bin, CAST(floor(weight) AS BIGINT) AS count, round(mean_score, 6) AS mean_score, round(observed, 6) AS observed, round(abs(mean_score - observed), 6) AS gap FROM b")
def calibration_bins(spark, sf_dir):
    return rounded(metrics.calibration_bins(_groups(spark, sf_dir), ["task_context"]).drop("weight"), "mean_score", "observed", "gap")


@query(f"WITH {_BINS} SELECT task_context, round(sum(abs(mean_score - observed) * weight) / sum(weight), 6) AS ece, round(max(abs(mean_score - observed)), 6) AS mce FROM b GROUP BY 1")
def ece_mce(spark, sf_dir):
    return rounded(metrics.calibration_errors(_groups(spark, sf_dir), ["task_context"]), "ece", "mce")


@query(f"WITH {_CONTACTS} SELECT round(count(*) / (2.0 * (count(*) - sum(label))), 6) AS weight_negative, round(count(*) / (2.0 * sum(label)), 6) AS weight_positive FROM contacts")
def class_weights(spark, sf_dir):
    return rounded(training.class_weights(tables.contacts(spark, sf_dir)), "weight_negative", "weight_positive")


# Calibration
_ISO = f"""{_SCORED}, g AS (SELECT p, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS pos, sum(w) AS n FROM scored GROUP BY 1),
 s AS (SELECT p, pos, n, row_number() OVER (ORDER BY p) AS i, sum(pos) OVER (ORDER BY p) AS cp, sum(n) OVER (ORDER BY p) AS cn FROM g),
 lows AS (SELECT a.i AS j, b.i AS k, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) AS v FROM s a JOIN s b ON b.i >= a.i),
 fit AS (SELECT s.i, any_value(s.p) AS p, max(m.v) AS value FROM s JOIN (SELECT l.j, s2.i AS i, min(l.v) AS v FROM lows l JOIN s s2 ON l.k >= s2.i AND l.j <= s2.i GROUP BY 1, 2) m ON m.i = s.i GROUP BY 1)"""


@query(f"WITH {_ISO} SELECT round(p, 6) AS score, round(value, 6) AS value FROM fit")
def isotonic_fit(spark, sf_dir):
    """The fitted step function at every distinct score; its blocks stay in a table that the scores are joined to."""
    groups = metrics.score_groups(_events(spark, sf_dir))
    found = steps.asof_join(groups.select("score"), calibration.isotonic_table(groups), name="value")
    return rounded(found, "score", "value")


_LENGTHS = """g AS (SELECT n_chars::DOUBLE AS p, sum(quality)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM documents JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1) USING (doc_id) WHERE n_chars IS NOT NULL GROUP BY 1)"""


@query(f"""WITH {_LENGTHS}, {_ISO.split("FROM scored GROUP BY 1),", 1)[1]} SELECT p AS n_chars, round(value, 6) AS quality FROM fit""")
def isotonic_by_length(spark, sf_dir):
    """The share of good documents as a rising function of their length, at every length."""
    docs, labels = (tables.table(spark, sf_dir, name) for name in ("documents", "labels"))
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    rows = docs.filter("n_chars is not null").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(marks, "doc_id").withColumn("weight", F.lit(1.0))
    groups = scratch.stage(metrics.score_groups(rows), "lengths")
    found = steps.asof_join(groups.select("score"), calibration.isotonic_table(groups), name="quality")
    return rounded(found.withColumnRenamed("score", "n_chars"), "quality")


@query("""WITH s AS (SELECT length(html)::DOUBLE / 2 AS upper, max(page_id) AS value FROM pages WHERE html IS NOT NULL GROUP BY 1), d AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN (n_chars // 4)::DOUBLE END AS score FROM documents)
 SELECT doc_id, CASE WHEN score IS NOT NULL THEN coalesce(s.value, (SELECT arg_max(value, upper) FROM s))::DOUBLE END AS value FROM d ASOF LEFT JOIN s ON d.score <= s.upper""")
def asof_step_join(spark, sf_dir):
    """Every document with the shortest page that is not below its size; ties, nulls and sizes above the last page among them."""
    ladder = tables.table(spark, sf_dir, "pages").filter("html is not null").groupBy((F.char_length("html") / 2).alias("upper")).agg(F.max("page_id").alias("value"))
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.floor(F.col("n_chars") / 4).cast("double")).alias("score"))
    return steps.asof_join(rows, ladder).drop("score")


@query(f"""WITH RECURSIVE {_SCORED}, g AS MATERIALIZED (SELECT ln(p) - ln(1 - p) AS s, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS pos, sum(w) AS n FROM scored GROUP BY 1),
 newton(i, a, b) AS (SELECT 0, 0.0::DOUBLE, ln((sum(pos) + 1) / (sum(n) + 2)) - ln(1 - (sum(pos) + 1) / (sum(n) + 2)) FROM g UNION ALL
  SELECT i + 1, a - ((1e-6 + h00) * ga - h01 * gb) / ((1e-6 + h11) * (1e-6 + h00) - h01 * h01), b - ((1e-6 + h11) * gb - h01 * ga) / ((1e-6 + h11) * (1e-6 + h00) - h01 * h01) FROM (
   SELECT i, a, b, sum(n * q * (1 - q) * s * s) AS h11, sum(n * q * (1 - q) * s) AS h01, sum(n * q * (1 - q)) AS h00, 1e-6 * a + sum((n * q - pos) * s) AS ga, 1e-6 * b + sum(n * q - pos) AS gb
   FROM (SELECT *, 1 / (1 + exp(-(a * s + b))) AS q FROM newton, g WHERE i < 12) GROUP BY i, a, b))
 SELECT round(a, 5) AS slope, round(b, 5) AS intercept FROM newton WHERE i = 12""")
def platt_fit(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("score", C.logit(F.col("probability")))
    fitted = calibration.fit_platt(metrics.score_groups(rows))
    return spark.range(1).select(F.round(F.lit(fitted.slope), 5).alias("slope"), F.round(F.lit(fitted.intercept), 5).alias("intercept"))


_NEWTON = """logits AS MATERIALIZED (SELECT ln(p) - ln(1 - p) AS x, p, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS pos, sum(w) AS n FROM scored GROUP BY p),
 newton(k, a, b) AS (SELECT 0, 0.0::DOUBLE, ln((sum(pos) + 1) / (sum(n) + 2)) - ln(1 - (sum(pos) + 1) / (sum(n) + 2)) FROM logits UNION ALL
  SELECT k + 1, a - ((1e-6 + h00) * ga - h01 * gb) / ((1e-6 + h11) * (1e-6 + h00) - h01 * h01), b - ((1e-6 + h11) * gb - h01 * ga) / ((1e-6 + h11) * (1e-6 + h00) - h01 * h01) FROM (
   SELECT k, a, b, sum(n * q * (1 - q) * x * x) AS h11, sum(n * q * (1 - q) * x) AS h01, sum(n * q * (1 - q)) AS h00, 1e-6 * a + sum((n * q - pos) * x) AS ga, 1e-6 * b + sum(n * q - pos) AS gb
   FROM (SELECT *, 1 / (1 + exp(-(a * x + b))) AS q FROM newton, logits WHERE k < 12) GROUP BY k, a, b))"""


@query(f"""WITH RECURSIVE {_ISO}, {_NEWTON}, chosen AS (SELECT 'isotonic' AS method, s.pos, s.n, fit.value AS q FROM s JOIN fit USING (i) UNION ALL SELECT 'platt', pos, n, 1 / (1 + exp(-(a * x + b))) FROM logits, newton WHERE k = 12),
 bins AS (SELECT method, least(CAST(floor(q * 10) AS INTEGER), 9) AS bin, sum(n) AS n, sum(n * q) / sum(n) AS mp, sum(pos) / sum(n) AS obs FROM chosen GROUP BY 1, 2), e AS (SELECT method, sum(abs(mp - obs) * n) / sum(n) AS ece FROM bins GROUP BY 1),
 c AS (SELECT *, greatest(least(q, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE) AS z FROM chosen)
 SELECT c.method, any_value(e.ece) < (SELECT max(ece) FROM e) AS selected, round(any_value(e.ece), 5) AS ece, round(sum(-(pos * ln(z) + (n - pos) * ln(1 - z))) / sum(n), 5) AS log_loss, round(sum(pos * (1 - q) * (1 - q) + (n - pos) * q * q) / sum(n), 5) AS brier_score FROM c JOIN e ON c.method = e.method GROUP BY 1""")
def calibrator_selection(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("score", C.logit(F.col("probability")))
    chosen = calibration.select(rows)
    found = [(m, m == chosen.method, r["ece"], r["log_loss"], r["brier_score"]) for m, r in chosen.reports.items()]
    table = spark.createDataFrame(found, "method string, selected boolean, ece double, log_loss double, brier_score double")
    return table.withColumns({c: F.round(c, 5) for c in ("ece", "log_loss", "brier_score")})


@query(f"""WITH RECURSIVE {_SCORED}, daily AS MATERIALIZED (SELECT task_context, ts::DATE AS day, ln(p) - ln(1 - p) AS s, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS pos, sum(w) AS n FROM scored GROUP BY 1, 2, 3),
 g AS MATERIALIZED (SELECT task_context, day + (3 + k)::INTEGER AS as_of, s, sum(pos) AS pos, sum(n) AS n FROM daily, range(14) r(k) WHERE day + (3 + k)::INTEGER <= (SELECT max(day) + 3 FROM daily) GROUP BY 1, 2, 3),
 t AS MATERIALIZED (SELECT task_context, as_of, sum(pos) AS pos, sum(n) AS n, ln((sum(pos) + 1) / (sum(n) + 2)) - ln(1 - (sum(pos) + 1) / (sum(n) + 2)) AS prior FROM g GROUP BY 1, 2),
 newton(i, task_context, as_of, a, b) AS (SELECT 0, task_context, as_of, 0.0::DOUBLE, prior FROM t WHERE pos > 20 AND n - pos > 20 UNION ALL
  SELECT i + 1, task_context, as_of, a - ((1e-6 + h00) * ga - h01 * gb) / ((1e-6 + h11) * (1e-6 + h00) - h01 * h01), b - ((1e-6 + h11) * gb - h01 * ga) / ((1e-6 + h11) * (1e-6 + h00) - h01 * h01) FROM (
   SELECT i, task_context, as_of, a, b, sum(n * q * (1 - q) * s * s) AS h11, sum(n * q * (1 - q) * s) AS h01, sum(n * q * (1 - q)) AS h00, 1e-6 * a + sum((n * q - pos) * s) AS ga, 1e-6 * b + sum(n * q - pos) AS gb
   FROM (SELECT *, 1 / (1 + exp(-(a * s + b))) AS q FROM newton JOIN g USING (task_context, as_of) WHERE i < 12) GROUP BY i, task_context, as_of, a, b))
 SELECT t.task_context, t.as_of::VARCHAR AS as_of, round(coalesce(a, 0), 4) AS slope, round(coalesce(b, prior), 4) AS intercept, pos, n - pos AS neg FROM t LEFT JOIN (SELECT * FROM newton WHERE i = 12) f ON f.task_context = t.task_context AND f.as_of = t.as_of""")
def rolling_platt(spark, sf_dir):
    """Platt's curve of every context as of every day, over the fourteen days before the last two; where either label
    weighs 20 at most, the smoothed share alone."""
    rows = _events(spark, sf_dir).withColumn("score", C.logit(F.col("probability")))
    fits = rolling.fit_rolling(rows, ["task_context"], at="ts", least=20.0)
    return fits.select("task_context", F.col("as_of").cast("string").alias("as_of"), F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), "pos", "neg")


# Monitoring
@query(f"WITH {_SCORED} SELECT task_context, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM scored GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    found = monitoring.prediction_summary(_events(spark, sf_dir), ["task_context"])
    return rounded(found.select("task_context", F.col("prediction_count").alias("n"), *(F.col(f"p{n}_latency_ms").alias(f"p{n}") for n in (50, 95, 99))), "p50", "p95", "p99")


@query(f"""WITH {_DECIDED} SELECT count(*) AS decision_count, round(avg(review::INT), 6) AS manual_review_rate, round(avg((action = positive)::INT), 6) AS positive_action_rate, round(avg(outcome_delay_days), 6) AS mean_label_delay_days,
 round(quantile_cont(outcome_delay_days, 0.95), 6) AS p95_label_delay_days, count(DISTINCT prediction_id) AS linked_predictions,
 (SELECT string_agg(action || '=' || n, ',' ORDER BY action) FROM (SELECT action, count(*) AS n FROM decided GROUP BY 1)) AS action_counts FROM decided""")
def decision_log_summary(spark, sf_dir):
    found = monitoring.decision_summary(tables.decisions(spark, sf_dir)).withColumn("action_counts", _listed("action_counts"))
    return rounded(found, "manual_review_rate", "positive_action_rate", "mean_label_delay_days", "p95_label_delay_days")


def _listed(counts: str):
    """A map of counts as text, in order of its keys."""
    return F.array_join(F.transform(F.map_entries(counts), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


def _drift_rows(spark, sf_dir):
    rows = tables.contacts(spark, sf_dir)
    ids = C.hashed_tokens(C.sparse_tokens(DATASET.features), 1024)
    return rows.select((F.col("row_id") % 4 == 0).alias("live"), ids.alias("sparse_feature_ids"), *C.dense_columns(DATASET.features))


_PSI = """lim AS (SELECT feature, min(v) AS lo, max(v) AS hi, count(*) FILTER (NOT live) AS ne, count(*) FILTER (live) AS na FROM long GROUP BY 1),
 binned AS (SELECT feature, len(list_filter(range(1, {bins}), lambda i: v > lo + (hi - lo) * i / {bins})) AS bin, count(*) FILTER (NOT live) AS e, count(*) FILTER (live) AS a, any_value(ne) AS ne, any_value(na) AS na, any_value(lo) AS lo, any_value(hi) AS hi FROM long JOIN lim USING (feature) GROUP BY 1, 2),
 psi AS (SELECT feature, sum(CASE WHEN lo = hi THEN 0 ELSE (greatest(a / na, 1e-6) - greatest(e / ne, 1e-6)) * ln(greatest(a / na, 1e-6) / greatest(e / ne, 1e-6)) END) AS psi FROM binned GROUP BY 1)"""


@query(f"""WITH {_DENSE}, long AS (SELECT row_id % 4 = 0 AS live, unnest([{", ".join(f"'{n}'" for n in DENSE_FEATURES)}]) AS feature, round(unnest([{", ".join(DENSE_FEATURES)}]), 9) AS v FROM dense), {_PSI.format(bins=10)}
 SELECT psi.feature, round(psi, 6) AS psi, round(avg((v = 0)::INT) FILTER (NOT live), 6) AS reference_zero_rate, round(avg((v = 0)::INT) FILTER (live), 6) AS live_zero_rate FROM psi JOIN long USING (feature) GROUP BY 1, 2""")
def psi_numeric(spark, sf_dir):
    rows = _drift_rows(spark, sf_dir).withColumns({n: F.round(n, 9) for n in DENSE_FEATURES})
    return rounded(drift.dense_drift(rows, DENSE_FEATURES), "psi", "reference_zero_rate", "live_zero_rate")


@query(f"""WITH {_SCORED}, long AS (SELECT event_id % 4 = 0 AS live, 'bucket' AS feature, CAST(user_id % 32 AS DOUBLE) AS v FROM scored), {_PSI.format(bins=32)} SELECT round(psi, 6) AS psi FROM psi""")
def psi_sparse_buckets(spark, sf_dir):
    rows = _events(spark, sf_dir).select((F.col("event_id") % 4 == 0).alias("live"), F.array("user_id").alias("sparse_feature_ids"))
    return rounded(drift.sparse_drift(rows), "psi")


_LINKS = f"""{_DECIDED}, l AS (SELECT count(*) AS linked FROM (SELECT DISTINCT prediction_id FROM scored INTERSECT SELECT DISTINCT prediction_id FROM decided)), n AS (SELECT (SELECT count(*) FROM scored) AS predictions, (SELECT count(*) FROM decided) AS decisions, (SELECT count(DISTINCT prediction_id) FROM scored) AS dp, (SELECT count(DISTINCT prediction_id) FROM decided) AS dd)"""


@query(f"""WITH {_LINKS} SELECT predictions, decisions, linked, round(linked / predictions, 6) AS prediction_link_rate, round(linked / decisions, 6) AS decision_link_rate, round(linked / dp, 6) AS distinct_prediction_link_rate,
 round(linked / dd, 6) AS distinct_decision_link_rate, greatest(0, decisions - linked) AS unlinked_decisions, 1.0::DOUBLE AS availability FROM l, n""")
def link_rates(spark, sf_dir):
    names = [f"{d}{k}_link_rate" for d in ("", "distinct_") for k in ("prediction", "decision")]
    return rounded(monitoring.links(_events(spark, sf_dir), tables.decisions(spark, sf_dir)), *names)


@query(f"WITH {_DECIDED} SELECT count(*) FILTER (prediction_id IN (SELECT prediction_id FROM scored)) AS covered, count(*) AS decisions, round(avg((prediction_id IN (SELECT prediction_id FROM scored))::INT), 6) AS audit_log_coverage FROM decided")
def audit_coverage(spark, sf_dir):
    """Of the decisions in all contexts."""
    return rounded(monitoring.audit_coverage(_events(spark, sf_dir), tables.decisions(spark, sf_dir)), "audit_log_coverage")


@query(f"WITH {_DECIDED} SELECT d.prediction_id, d.action FROM decided d ANTI JOIN scored s USING (prediction_id)")
def unlinked_decisions(spark, sf_dir):
    return tables.decisions(spark, sf_dir).join(_events(spark, sf_dir).select("prediction_id"), "prediction_id", "left_anti").select("prediction_id", "action")


_GOV = f"""{_DECIDED}, bins AS (SELECT task_context, least(CAST(floor(cal * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(cal) AS mp, avg(realized_label) AS obs FROM decided WHERE realized_label IS NOT NULL AND cal IS NOT NULL GROUP BY 1, 2),
 gov AS (SELECT d.task_context AS "group", count(*) AS decision_count, avg(review::INT) AS manual_review_rate, avg((action = positive)::INT) AS positive_action_rate, avg(cal) AS mean_probability, any_value(e.ece) AS ece
 FROM decided d JOIN (SELECT task_context, sum(abs(mp - obs) * n) / sum(n) AS ece FROM bins GROUP BY 1) e USING (task_context) GROUP BY 1)"""


@query(f"""WITH {_GOV} SELECT "group", decision_count, round(manual_review_rate, 6) AS manual_review_rate, round(positive_action_rate, 6) AS positive_action_rate, round(mean_probability, 6) AS mean_probability, round(ece, 6) AS ece,
 (SELECT string_agg(action || '=' || n, ',' ORDER BY action) FROM (SELECT task_context, action, count(*) AS n FROM decided GROUP BY 1, 2) c WHERE c.task_context = "group") AS action_counts FROM gov""")
def governance_by_group(spark, sf_dir):
    found = monitoring.governance(tables.decisions(spark, sf_dir)).withColumn("action_counts", _listed("action_counts"))
    return rounded(found, "manual_review_rate", "positive_action_rate", "mean_probability", "ece")


@query(f"WITH {_GOV} SELECT round(max(ece) - min(ece), 6) AS subgroup_calibration_gap, round(max(positive_action_rate) - min(positive_action_rate), 6) AS approval_rate_gap FROM gov")
def governance_gaps(spark, sf_dir):
    return rounded(monitoring.governance_gaps(monitoring.governance(tables.decisions(spark, sf_dir))), "subgroup_calibration_gap", "approval_rate_gap")


_LIVE = "live AS (SELECT cal, raw, realized_label AS y FROM decided WHERE realized_label IS NOT NULL AND cal IS NOT NULL)"


@query(f"""WITH {_DECIDED}, {_LIVE}, k AS (SELECT 'calibrated' AS kind, cal AS q, y FROM live UNION ALL SELECT 'raw', raw, y FROM live WHERE raw IS NOT NULL),
 b AS (SELECT kind, least(CAST(floor(q * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(q) AS mp, avg(y) AS obs FROM k GROUP BY 1, 2), e AS (SELECT kind, sum(abs(mp - obs) * n) / sum(n) AS ece FROM b GROUP BY 1)
 SELECT kind, count(*) AS example_count, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(any_value(ece), 6) AS ece, round(avg(y), 6) AS positive_rate, round(avg(q), 6) AS mean_prediction FROM k JOIN e USING (kind) GROUP BY 1""")
def live_metrics(spark, sf_dir):
    """Of the calibrated and of the raw probabilities that the decisions of all contexts carry."""
    found = monitoring.live_metrics(monitoring.live_rows(tables.decisions(spark, sf_dir)))
    return rounded(found.select("kind", "example_count", "log_loss", "ece", "positive_rate", "mean_prediction"), "log_loss", "ece", "positive_rate", "mean_prediction")


def _wide(spark, sf_dir):
    """One row of metrics.  The live population has the larger balances and other users, so both drift rules fire."""
    events, decided = _events(spark, sf_dir), tables.decisions(spark, sf_dir)
    gaps = monitoring.governance_gaps(monitoring.governance(decided))
    users = events.select((F.col("user_id") % 32 < 12).alias("live"), F.array("user_id").alias("sparse_feature_ids"))
    sparse = drift.sparse_drift(users).select(F.col("psi").alias("sparse_bucket_psi"))
    rows = _drift_rows(spark, sf_dir).withColumns({n: F.round(n, 9) for n in DENSE_FEATURES}).withColumn("live", F.col("balance") > 8)
    dense = drift.dense_drift(rows, DENSE_FEATURES).agg(F.max("psi").alias("max_dense_psi"))
    # The alert is about the primary context alone.
    primary = monitoring.live_metrics(monitoring.live_rows(decided, "bank_marketing"))
    live = rounded(primary, "ece").filter("kind = 'calibrated'").select(F.col("ece").alias("live_primary_calibrated_metrics_ece"))
    summary = monitoring.prediction_summary(events).select(F.col("p95_latency_ms").alias("prediction_p95_latency_ms"))
    for part in (monitoring.decision_summary(decided).select("manual_review_rate"), gaps, sparse, live, monitoring.links(events, decided).select("prediction_link_rate"), dense):
        summary = summary.crossJoin(part)
    return scratch.stage(summary, "wide")


_DRIFT = f"""{_DENSE}, dense_long AS (SELECT round(balance, 9) > 8 AS live, unnest([{", ".join(f"'{n}'" for n in DENSE_FEATURES)}]) AS feature, round(unnest([{", ".join(DENSE_FEATURES)}]), 9) AS v FROM dense),
 sparse_long AS (SELECT user_id % 32 < 12 AS live, 'bucket' AS feature, CAST(user_id % 32 AS DOUBLE) AS v FROM scored),
 {_PSI.format(bins=10).replace("lim AS", "d_lim AS").replace("FROM long", "FROM dense_long").replace("JOIN lim", "JOIN d_lim").replace("binned", "d_binned").replace("psi AS (", "d_psi AS (")},
 {_PSI.format(bins=32).replace("lim AS", "s_lim AS").replace("FROM long", "FROM sparse_long").replace("JOIN lim", "JOIN s_lim").replace("binned", "s_binned").replace("psi AS (", "s_psi AS (")}"""
_ALERTS = f"""vals AS (SELECT 0 AS place, 'prediction_p95_latency_ms' AS metric, quantile_cont(latency_ms, 0.95) AS value, 10.0::DOUBLE AS threshold FROM scored
 UNION ALL SELECT 1, 'max_dense_psi', (SELECT max(psi) FROM d_psi), 0.2 UNION ALL SELECT 2, 'sparse_bucket_psi', (SELECT psi FROM s_psi), 0.2
 UNION ALL SELECT 3, 'live_primary_calibrated_metrics.ece', (SELECT sum(abs(mp - obs) * n) / sum(n) FROM (SELECT least(CAST(floor(cal * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(cal) AS mp, avg(realized_label) AS obs FROM decided WHERE task_context = 'bank_marketing' AND realized_label IS NOT NULL AND cal IS NOT NULL GROUP BY 1)), 0.03
 UNION ALL SELECT 4, 'manual_review_rate', (SELECT avg(review::INT) FROM decided), 0.85 UNION ALL SELECT 5, 'subgroup_calibration_gap', (SELECT max(ece) - min(ece) FROM gov), 0.05
 UNION ALL SELECT 6, 'approval_rate_gap', (SELECT max(positive_action_rate) - min(positive_action_rate) FROM gov), 0.05),
 fired AS (SELECT * FROM vals WHERE value > threshold UNION ALL SELECT 7, 'audit_log_coverage', linked / predictions, 0.99 FROM l, n WHERE linked / predictions < 0.99)"""
_ALERT_SQL = f"WITH {_GOV}, {_DRIFT}, {_LINKS.split('FROM routed WHERE event_id % 10 <> 0), ')[1]}, {_ALERTS}"


@query(f"{_ALERT_SQL} SELECT metric, round(value, 6) AS value, threshold, 'critical' AS severity FROM fired")
def alerts(spark, sf_dir):
    """The rules that fire, both drift rules among them."""
    return rounded(monitoring.alerts(_wide(spark, sf_dir)).drop("place"), "value")


@query(f"{_ALERT_SQL} SELECT (SELECT count(*) FROM fired) = 0 AS ready, array_to_string(list_concat((SELECT list(metric ORDER BY metric) FROM fired), CASE WHEN linked / predictions < 0.99 THEN ['prediction_link_rate'] ELSE [] END), ',') AS reasons FROM l, n")
def rollout_readiness(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    return monitoring.readiness(monitoring.alerts(wide), wide).withColumn("reasons", F.array_join("reasons", ","))


# Ranking
def _candidates(spark, sf_dir):
    rows = dataset.with_split(_contacts(spark, sf_dir), CONTIGUOUS).select("row_id", "label", "split", *C.dense_columns(DATASET.features))
    x = training.score_column(WEIGHTS, DENSE_FEATURES)
    staged = rows.withColumns({"stage1_raw_score": F.round(x, 9), "stage1_probability": F.round(C.sigmoid(x), 9), "stage1_calibrated_probability": F.round(C.sigmoid(x) * 0.9 + 0.05, 9)})
    made = ranking.with_hybrid_features(staged)
    reranker = F.round(C.sigmoid(F.col("stage1_raw_score") * 0.8 - F.col("campaign") * 0.1 + F.col("age") * 0.05), 9)
    made = made.withColumns({"reranker_probability": reranker, "uncertainty_score": F.round("uncertainty_score", 9), "candidate_id": C.numbered("trn", F.col("row_id"))})
    # Several lists and sums read the candidates: compute them once.
    return scratch.stage(made, "candidates")


_CAND = f"""{_LOGIT}, cand AS (SELECT 'trn_' || lpad(row_id::VARCHAR, 12, '0') AS candidate_id, row_id, label, CASE WHEN (row_id + 1) / (count(*) OVER ())::DOUBLE < 0.5 THEN 'train' WHEN (row_id + 1) / (count(*) OVER ())::DOUBLE < 0.75 THEN 'validation' ELSE 'test' END AS split,
 round(x, 9) AS raw, round(prob * 0.9::DOUBLE + 0.05::DOUBLE, 9) AS cal, round(1 / (1 + exp(-(round(x, 9) * 0.8::DOUBLE - campaign * 0.1::DOUBLE + age * 0.05::DOUBLE))), 9) AS rr, dense.* EXCLUDE (row_id, label) FROM probs JOIN dense USING (row_id, label)),
 cand2 AS (SELECT *, round(1 - abs(2 * cal - 1), 9) AS unc FROM cand),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY cal DESC, raw DESC, candidate_id) AS stage1_rank, row_number() OVER (PARTITION BY split ORDER BY rr DESC, cal DESC, candidate_id) AS reranker_rank FROM cand2),
 pool AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY unc DESC, rr DESC, candidate_id) AS place FROM ranked WHERE reranker_rank > 21),
 chosen AS (SELECT * EXCLUDE (place), false AS was_explored, rr AS final_score FROM pool WHERE false UNION ALL SELECT *, false, rr FROM ranked WHERE reranker_rank <= 21 UNION ALL SELECT * EXCLUDE (place), true, rr + unc * 0.15::DOUBLE FROM pool WHERE place <= 4),
 final AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY final_score DESC, rr DESC, candidate_id) AS final_rank FROM chosen)"""


@query(f"WITH {_CAND} SELECT split, candidate_id, stage1_rank, reranker_rank FROM ranked WHERE stage1_rank <= 25")
def stage1_rank(spark, sf_dir):
    return ranking.first_by_stage1(_candidates(spark, sf_dir)).select("split", "candidate_id", "stage1_rank", "reranker_rank")


@query(f"WITH {_CAND} SELECT split, candidate_id, was_explored, final_rank, round(final_score, 6) AS final_score FROM final")
def topk_explore(spark, sf_dir):
    return rounded(ranking.shortlist(_candidates(spark, sf_dir)).select("split", "candidate_id", "was_explored", "final_rank", "final_score"), "final_score")


_RANK = f"""{_CAND}, m AS (SELECT split, avg(label) AS final_rate, count(*) FILTER (was_explored) AS explored, avg((stage1_rank <= 25)::INT) AS overlap_with_stage1, avg(stage1_rank - final_rank) AS mean_shift_from_stage1, avg(reranker_rank - final_rank) AS mean_shift_from_reranker, avg(final_score) AS mean_final_score FROM final GROUP BY 1),
 s1 AS (SELECT split, avg(label) FILTER (stage1_rank <= 25) AS stage1_rate, avg(label) FILTER (reranker_rank <= 25) AS rr_rate, count(*) AS n FROM ranked GROUP BY 1),
 nd AS (SELECT split, CASE WHEN sum(label) = 0 THEN 0 ELSE sum((pow(2, label) - 1) / log2(final_rank + 1)) / sum((pow(2, label) - 1) / log2(ideal + 1)) END AS ndcg FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY label DESC, candidate_id) AS ideal FROM final) GROUP BY 1),
 nd1 AS (SELECT split, CASE WHEN sum(label) = 0 THEN 0 ELSE sum((pow(2, label) - 1) / log2(stage1_rank + 1)) / sum((pow(2, label) - 1) / log2(ideal + 1)) END AS stage1_ndcg FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY label DESC, candidate_id) AS ideal FROM ranked WHERE stage1_rank <= 25) GROUP BY 1),
 nd2 AS (SELECT split, CASE WHEN sum(label) = 0 THEN 0 ELSE sum((pow(2, label) - 1) / log2(reranker_rank + 1)) / sum((pow(2, label) - 1) / log2(ideal + 1)) END AS reranker_ndcg FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY label DESC, candidate_id) AS ideal FROM ranked WHERE reranker_rank <= 25) GROUP BY 1)"""


@query(f"""WITH {_RANK} SELECT split, n AS candidate_count, explored, round(final_rate, 6) AS final_positive_rate, round(stage1_rate, 6) AS stage1_positive_rate, round(rr_rate, 6) AS reranker_positive_rate,
 round(final_rate - stage1_rate, 6) AS lift_vs_stage1, round(final_rate - rr_rate, 6) AS lift_vs_reranker, round(overlap_with_stage1, 6) AS overlap_with_stage1, round(mean_shift_from_stage1, 6) AS mean_shift_from_stage1,
 round(mean_shift_from_reranker, 6) AS mean_shift_from_reranker, round(mean_final_score, 6) AS mean_final_score, round(ndcg, 6) AS ndcg, round(stage1_ndcg, 6) AS stage1_ndcg, round(reranker_ndcg, 6) AS reranker_ndcg
 FROM m JOIN s1 USING (split) JOIN nd USING (split) JOIN nd1 USING (split) JOIN nd2 USING (split)""")
def ranking_metrics(spark, sf_dir):
    names = (
        "final_positive_rate", "stage1_positive_rate", "reranker_positive_rate", "lift_vs_stage1", "lift_vs_reranker", "overlap_with_stage1", "mean_shift_from_stage1", "mean_shift_from_reranker",
        "mean_final_score", "ndcg", "stage1_ndcg", "reranker_ndcg",
    )
    return rounded(ranking.ranking_metrics(_candidates(spark, sf_dir)).select("split", "candidate_count", "explored", *names), *names)


@query(f"""WITH {_RANK} SELECT round(sum(final_rate * n) / sum(n), 6) AS final_positive_rate, round(sum(ndcg * n) / sum(n), 6) AS ndcg, round(sum(stage1_ndcg * n) / sum(n), 6) AS stage1_ndcg,
 round(sum(reranker_ndcg * n) / sum(n), 6) AS reranker_ndcg, round(sum((final_rate - stage1_rate) * n) / sum(n), 6) AS lift_vs_stage1, round(sum((final_rate - rr_rate) * n) / sum(n), 6) AS lift_vs_reranker,
 round(sum(explored / 25.0::DOUBLE * n) / sum(n), 6) AS exploration_rate FROM m JOIN s1 USING (split) JOIN nd USING (split) JOIN nd1 USING (split) JOIN nd2 USING (split)""")
def overall_weighted(spark, sf_dir):
    names = ("final_positive_rate", "ndcg", "stage1_ndcg", "reranker_ndcg", "lift_vs_stage1", "lift_vs_reranker", "exploration_rate")
    return rounded(ranking.overall(ranking.ranking_metrics(_candidates(spark, sf_dir)), names), *names)


@query(f"""WITH {_RANK}, l AS (SELECT coalesce(max(CASE WHEN split = 'validation' THEN final_rate - stage1_rate END), 0) AS v, coalesce(max(CASE WHEN split = 'test' THEN final_rate - stage1_rate END), 0) AS t FROM m JOIN s1 USING (split))
 SELECT round(v, 6) AS validation_lift, round(t, 6) AS test_lift, array_to_string(list_filter([CASE WHEN v < 0 THEN 'validation_reranker_lift_vs_stage1' END, CASE WHEN t < -0.02 THEN 'test_reranker_lift_vs_stage1' END], lambda x: x IS NOT NULL), ',') AS reasons, v >= 0 AND t >= -0.02 AS ready FROM l""")
def ranking_readiness(spark, sf_dir):
    found = ranking.readiness(ranking.ranking_metrics(_candidates(spark, sf_dir)))
    return rounded(found.withColumn("reasons", F.array_join("reasons", ",")), "validation_lift", "test_lift")


_COMPRESS = {"raw_balance": "raw * balance", "calibrated_campaign": "cal * campaign", "uncertainty_previous": "(1 - abs(2 * cal - 1)) * previous", "age_balance": "age * balance"}


@query(f"WITH {_CAND} SELECT candidate_id, {', '.join(f'round(sign({e}) * ln(1 + abs({e})), 5) AS {n}' for n, e in _COMPRESS.items())} FROM cand2")
def hybrid_features(spark, sf_dir):
    return _candidates(spark, sf_dir).select("candidate_id", *(F.round(n, 5).alias(n) for n in _COMPRESS))


# Profiles and rules
@query(f"WITH {_CONTACTS}, long AS (SELECT unnest(['age', 'balance', 'campaign', 'previous']) AS feature, unnest([age::DOUBLE, balance, campaign::DOUBLE, previous::DOUBLE]) AS v FROM contacts) SELECT feature, count(v) AS count, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.95), 6) AS p95, min(v) AS min, max(v) AS max FROM long GROUP BY 1")
def profile_numeric(spark, sf_dir):
    return rounded(profiling.numeric_summary(tables.contacts(spark, sf_dir), ("age", "balance", "campaign", "previous")), "mean", "p05", "median", "p95")


@query("""SELECT doc_id, printf('%.4f', n_chars / 7.0::DOUBLE) AS float_text, format('{:,}', n_chars) AS int_text, printf('%.1f%%', 100 * (doc_id % 997) / 1000.0::DOUBLE) AS percent_text, coalesce(lang, '—') AS lang_text FROM documents""")
def display_texts(spark, sf_dir):
    """Numbers as they are shown; a null is a dash and text that is no number stands as it is."""
    docs = tables.table(spark, sf_dir, "documents")
    shown = {"float_text": C.show_float(F.col("n_chars") / 7.0), "int_text": C.show_int(F.col("n_chars")), "percent_text": C.show_percent((F.col("doc_id") % 997) / 1000.0), "lang_text": C.show_float(F.col("lang"))}
    return docs.select("doc_id", *(c.alias(name) for name, c in shown.items()))


@query("WITH l AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 12)), 11) AS INTEGER) AS bin, count(*) AS n FROM customer, l GROUP BY 1")
def histogram12(spark, sf_dir):
    return profiling.histogram(tables.table(spark, sf_dir, "customer"), "c_acctbal")


@query(f"WITH {_CONTACTS}, long AS (SELECT unnest(['job', 'month', 'education', 'poutcome']) AS feature, unnest([job, month, education, poutcome]) AS value FROM contacts), c AS (SELECT feature, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY 1, 2) SELECT * FROM (SELECT feature, value, n, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS place FROM c) WHERE place <= 10")
def profile_categorical(spark, sf_dir):
    return profiling.category_counts(tables.contacts(spark, sf_dir), ("job", "month", "education", "poutcome"))


@query(f"WITH {_CONTACTS} SELECT unnest(['job', 'poutcome', 'balance']) AS feature, unnest([count(*) - count(job), count(*) - count(poutcome), count(*) - count(balance)]) AS missing, count(*) AS rows FROM contacts")
def missing_counts(spark, sf_dir):
    return profiling.missing_counts(tables.contacts(spark, sf_dir), ("job", "poutcome", "balance"))


@query(f"""WITH {_DECIDED}, {_CONTACTS}, r AS (SELECT row_id AS i FROM contacts)
 SELECT 'raw_contact_event' AS "table", unnest(['event_id_unique', 'event_id_present', 'event_ts_present', 'request_id_present', 'contact_id_present']) AS rule,
  unnest([count(*) FILTER (i % 100 = 3 AND i % 17 <> 0) + (count(*) FILTER (i % 17 = 0) > 0)::BIGINT, (count(*) FILTER (i % 17 = 0)) + count(*) FILTER (i % 100 = 3 AND i % 17 = 0), count(*) FILTER (i % 19 = 0) + count(*) FILTER (i % 100 = 3 AND i % 19 = 0),
   count(*) FILTER (i % 23 = 0) + count(*) FILTER (i % 100 = 3 AND i % 23 = 0), count(*) FILTER (i % 29 = 0) + count(*) FILTER (i % 100 = 3 AND i % 29 = 0)]) AS broken FROM r
 UNION ALL SELECT 'raw_subscription_label', unnest(['parent_event_exists', 'subscribed_is_binary', 'delay_not_negative']), unnest([count(*) FILTER (i % 31 = 0 OR i % 17 = 0), count(*) FILTER (i % 37 = 0), count(*) FILTER (i % 41 = 0)]) FROM r
 UNION ALL SELECT 'training_row', unnest(['sparse_lengths_agree', 'weight_positive', 'version_present']), unnest([count(*) FILTER (i % 43 = 0), count(*) FILTER (i % 47 = 0), count(*) FILTER (i % 53 = 0)]) FROM r
 UNION ALL SELECT 'prediction_log', unnest(['score_is_probability', 'latency_not_negative', 'model_version_present']), unnest([count(*) FILTER (event_id % 13 = 0), count(*) FILTER (latency_ms < 0 OR event_id % 12 = 0), count(*) FILTER (event_id % 11 = 0)]) FROM scored
 UNION ALL SELECT 'decision_outcome', unnest(['action_known', 'review_present']), unnest([count(*) FILTER (event_id % 14 = 0), count(*) FILTER (event_id % 15 = 0)]) FROM decided""")
def dq_rules(spark, sf_dir):
    """Every rule is broken by some rows: repeated and missing ids, missing times, orphans, wrong values."""
    rows = scratch.stage(_contacts(spark, sf_dir), "contacts")
    lost = lambda c, n, key="row_id": F.when(F.col(key) % n != 0, F.col(c))
    events = dataset.contact_events(rows, DATASET)
    number = F.regexp_extract("request_id", r"(\d+)", 1).cast("long")
    marked = events.withColumn("n", number)
    marked = marked.unionByName(marked.filter("n % 100 = 3")).withColumns({"event_id": lost("event_id", 17, "n"), "event_ts": lost("event_ts", 19, "n"), "request_id": lost("request_id", 23, "n"), "contact_id": lost("contact_id", 29, "n")})
    labels = dataset.subscription_labels(rows, DATASET).withColumn("n", F.regexp_extract("label_event_id", r"(\d+)", 1).cast("long"))
    labels = labels.withColumns({
        "parent_event_id": F.when(F.col("n") % 31 == 0, "evt_of_nobody").otherwise(F.col("parent_event_id")), "subscribed": F.when(F.col("n") % 37 == 0, 2).otherwise(F.col("subscribed")),
        "label_delay_seconds": F.when(F.col("n") % 41 == 0, -1).otherwise(F.col("label_delay_seconds")),
    })
    trained = dataset.training_rows(rows, DATASET).withColumn("n", F.regexp_extract("training_row_id", r"(\d+)", 1).cast("long"))
    trained = trained.withColumns({
        "sparse_feature_values": F.when(F.col("n") % 43 == 0, F.array(F.lit(1.0))).otherwise(F.col("sparse_feature_values")), "sample_weight": F.when(F.col("n") % 47 == 0, 0.0).otherwise(F.col("sample_weight")),
        "feature_set_version": lost("feature_set_version", 53, "n"),
    })
    log = _events(spark, sf_dir).withColumns({
        "model_version": F.when(F.col("event_id") % 11 != 0, "v1"), "calibrated_score": F.when(F.col("event_id") % 13 == 0, 1.5).otherwise(F.col("calibrated_score")),
        "latency_ms": F.when(F.col("event_id") % 12 == 0, -1.0).otherwise(F.col("latency_ms")),
    })
    decided = tables.decisions(spark, sf_dir).withColumns({"action": F.when(F.col("event_id") % 14 == 0, "shrug").otherwise(F.col("action")), "manual_review_required": lost("manual_review_required", 15, "event_id")})
    parts = [quality.labels(labels, marked), quality.training_rows(trained), quality.predictions(log), quality.decisions(decided)]
    out = quality.contact_events(marked)
    for part in parts:
        out = out.unionByName(part)
    return out


@query("SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS labelled, count(*) AS documents, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS orphan_labels FROM documents")
def label_coverage(spark, sf_dir):
    docs, labels = tables.table(spark, sf_dir, "documents").select("doc_id"), tables.table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi").agg(F.count("*").alias("labelled")).crossJoin(docs.agg(F.count("*").alias("documents"))).crossJoin(labels.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("orphan_labels")))


@query("WITH w AS (SELECT list_transform(range(64), lambda i: ((i % 7) - 3) / 10.0::DOUBLE) AS w) SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * w[i])), 5) AS score FROM embeddings, w")
def embedding_dot(spark, sf_dir):
    weights = F.array(*(F.lit((i % 7 - 3) / 10) for i in range(64)))
    product = F.aggregate(F.zip_with("embedding", weights, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda a, x: a + x)
    return tables.table(spark, sf_dir, "embeddings").select("vec_id", F.round(product, 5).alias("score"))


# Fits
def _training_table(spark, sf_dir):
    return dataset.training_rows(_contacts(spark, sf_dir), DATASET)


_STEPS, _RATE, _L2 = 4, 0.3, 0.01
_X = " + ".join(f"w{j} * {n}" for j, n in enumerate(DENSE_FEATURES))


def _descent(name: str, error: str) -> str:
    return f"""{name}(i, b, {", ".join(f"w{j}" for j in range(7))}) AS (SELECT 0, {", ".join(["0.0::DOUBLE"] * 8)} UNION ALL
  SELECT i + 1, b - {_RATE} * avg(e), {", ".join(f"w{j} - {_RATE} * (avg(e * {n}) + {_L2} * w{j})" for j, n in enumerate(DENSE_FEATURES))}
  FROM (SELECT *, share * {error} AS e FROM (SELECT s.*, t.*, 1 / (1 + exp(-(b + {_X}))) AS q FROM {name} s, t WHERE i < {_STEPS})) GROUP BY i, b, {", ".join(f"w{j}" for j in range(7))})"""


def _weights_of(name: str) -> str:
    columns = ["b", *(f"w{j}" for j in range(7))]
    return f"SELECT '{name}' AS loss, unnest([{', '.join(repr(n) for n in ('bias', *DENSE_FEATURES))}]) AS feature, round(unnest([{', '.join(columns)}]), 6) AS weight FROM {name} WHERE i = {_STEPS}"


_STEPPED = f"""WITH RECURSIVE {_DENSE}, kept AS (SELECT * FROM dense WHERE {_FRACTION} < 0.8::DOUBLE),
 t AS MATERIALIZED (SELECT label, {", ".join(DENSE_FEATURES)}, CASE WHEN label = 1 THEN (SELECT count(*) / (2.0::DOUBLE * sum(label)) FROM kept) ELSE (SELECT count(*) / (2.0::DOUBLE * (count(*) - sum(label))) FROM kept) END AS share FROM kept),
 {_descent("cross_entropy", "(q - label)")}, {_descent("mse", "(q - label) * q * (1 - q)")}"""


def _stepped(spark, sf_dir):
    """The trainer as plain gradient descent (one batch a shard, plain rates): steps on all training rows."""
    none = {"sparse_feature_ids": F.array().cast("array<bigint>"), "sparse_feature_values": F.array().cast("array<double>")}
    rows = _training_table(spark, sf_dir).withColumns(none).filter("split = 'train'")
    config = TrainingConfig(max_epochs=_STEPS, learning_rate=_RATE, l2=_L2, optimizer="sgd", patience=0)
    return training.fit_all(rows, {"cross_entropy": config, "mse": replace(config, loss="mse")}, batch_rows=None)


@query(f"""{_STEPPED} {_weights_of("cross_entropy")} UNION ALL {_weights_of("mse")}""")
def lr_gradient_steps(spark, sf_dir):
    fits = _stepped(spark, sf_dir)
    found = [(loss, name, float(w)) for loss, fit in fits.items() for name, w in zip(("bias", *DENSE_FEATURES), (fit.model.bias, *fit.model.dense), strict=True)]
    return rounded(spark.createDataFrame(found, "loss string, feature string, weight double"), "weight")


@query(f"""{_STEPPED} SELECT feature, weight FROM ({_weights_of("cross_entropy")}) WHERE feature <> 'bias' ORDER BY abs(weight) DESC, feature LIMIT 5""")
def top_coefficients(spark, sf_dir):
    """The largest weights of a fitted model."""
    model = replace(_stepped(spark, sf_dir)["cross_entropy"].model, dense_names=list(DENSE_FEATURES))
    return rounded(spark.createDataFrame(model.top(5), "feature string, weight double"), "weight")


_TOKEN_IDS = 1 << 20


def _table_steps(steps: int) -> str:
    """Gradient descent on all features alike, as one long table of (row, feature, value)."""
    known = ", ".join(f"('{t}', 'sparse_{C.hash_token(t, _TOKEN_IDS)}')" for t in _known_tokens())
    out = f"""{_CONTACTS.replace("contacts AS (", "contacts AS MATERIALIZED (", 1)}, {_DENSE.split("FROM contacts)")[0].split(", dense AS")[1].join([" dense AS", "FROM contacts)"])}, kept AS (SELECT * FROM dense WHERE {_FRACTION} < 0.8::DOUBLE),
 t AS MATERIALIZED (SELECT row_id, label, CASE WHEN label = 1 THEN (SELECT count(*) / (2.0::DOUBLE * sum(label)) FROM kept) ELSE (SELECT count(*) / (2.0::DOUBLE * (count(*) - sum(label))) FROM kept) END AS share FROM kept),
 ids(token, feature) AS (VALUES {known}),
 slots AS (SELECT row_id, unnest([{", ".join(f"'{n}=' || coalesce({chr(34)}{n}{chr(34)}, '{MISSING}')" for n in CATEGORICAL)}]) AS token FROM contacts),
 feats AS MATERIALIZED (SELECT row_id, 'bias' AS feature, 1.0::DOUBLE AS x FROM kept UNION ALL SELECT row_id, unnest([{", ".join(f"'{n}'" for n in DENSE_FEATURES)}]), unnest([{", ".join(DENSE_FEATURES)}]) FROM kept
  UNION ALL SELECT row_id, feature, 1.0::DOUBLE FROM slots JOIN ids USING (token) JOIN kept USING (row_id)),
 w0 AS MATERIALIZED (SELECT DISTINCT feature, 0.0::DOUBLE AS w FROM feats)"""
    for k in range(steps):
        out += f""",
 e{k} AS MATERIALIZED (SELECT row_id, share * (1 / (1 + exp(-z)) - label) AS e FROM t JOIN (SELECT row_id, sum(w * x) AS z FROM feats JOIN w{k} USING (feature) GROUP BY 1) USING (row_id)),
 w{k + 1} AS MATERIALIZED (SELECT feature, any_value(w) - {_RATE} * sum(e * x) / (SELECT count(*) FROM t) AS w FROM feats JOIN e{k} USING (row_id) JOIN w{k} USING (feature) GROUP BY 1)"""
    return f"WITH {out} SELECT feature, round(w, 6) AS weight FROM w{steps}"


@query(_table_steps(3))
def lr_weights_table(spark, sf_dir):
    """Gradient descent on dense and hashed sparse features (of 2^20 ids) with the weights in a table."""
    data = replace(DATASET, features=replace(DATASET.features, hash_dimension=_TOKEN_IDS))
    rows = dataset.training_rows(_contacts(spark, sf_dir), data).filter("split = 'train'")
    config = TrainingConfig(max_epochs=3, learning_rate=_RATE, l2=0.0, optimizer="sgd", patience=0)
    fitted = weight_table.fit_table(rows, config, batch_rows=None)
    dense = F.array(*map(F.lit, DENSE_FEATURES))
    name = F.when(F.col("kind") == weight_table.BIAS, "bias").when(F.col("kind") == weight_table.DENSE, F.get(dense, F.col("id").cast("int"))).otherwise(F.concat(F.lit("sparse_"), F.col("id").cast("string")))
    return rounded(fitted.weights.select(name.alias("feature"), "weight"), "weight")


_ORIGINS = ("1996-08-01", "1998-04-01", "1999-12-01")


def _fold_steps() -> str:
    out = f"WITH RECURSIVE {_DENSE}, dated AS MATERIALIZED (SELECT dense.*, contacts.event_ts::DATE AS on_day FROM dense JOIN contacts USING (row_id))"
    weights = ", ".join(f"w{j}" for j in range(7))
    for k, origin in enumerate(_ORIGINS):
        until = f"DATE '{_ORIGINS[k + 1]}'" if k + 1 < len(_ORIGINS) else "DATE '9999-01-01'"
        step = _descent(f"fold{k}", "(q - label)").replace("t.*", f"t{k}.*").replace(" s, t WHERE", f" s, t{k} WHERE").replace(f" + {_L2} * w", " + 0.0 * w")
        out += f""",
 t{k} AS MATERIALIZED (SELECT label, {", ".join(DENSE_FEATURES)}, CASE WHEN label = 1 THEN count(*) OVER () / (2.0::DOUBLE * sum(label) OVER ()) ELSE count(*) OVER () / (2.0::DOUBLE * (count(*) OVER () - sum(label) OVER ())) END AS share FROM dated WHERE on_day < DATE '{origin}'),
 {step},
 v{k} AS (SELECT i, avg(-(label * ln(q) + (1 - label) * ln(1 - q))) AS loss FROM (SELECT i, label, 1 / (1 + exp(-(b + {_X}))) AS q FROM fold{k}, dated WHERE i > 0 AND on_day >= DATE '{origin}' AND on_day < {until}) GROUP BY 1),
 r{k} AS (SELECT {k + 1} AS fold, i AS best_epoch, round(loss, 6) AS validation_log_loss, unnest([{", ".join(repr(n) for n in ("bias", *DENSE_FEATURES))}]) AS feature, round(unnest([b, {weights}]), 6) + 0.0::DOUBLE AS weight FROM fold{k} JOIN v{k} USING (i) WHERE i = (SELECT arg_min(i, loss) FROM v{k}))"""
    return out + " UNION ALL ".join(f" SELECT * FROM r{k}" for k in range(len(_ORIGINS)))


@query(_fold_steps())
def rolling_origin_folds(spark, sf_dir):
    """Gradient descent on the contacts before each of three days, stopped by those up to the next day."""
    none = {"sparse_feature_ids": F.array().cast("array<bigint>"), "sparse_feature_values": F.array().cast("array<double>")}
    config = TrainingConfig(max_epochs=_STEPS, learning_rate=_RATE, l2=0.0, optimizer="sgd", patience=0)
    origins = [datetime.fromisoformat(day) for day in _ORIGINS]
    fits = training.fit_folds(_training_table(spark, sf_dir).withColumns(none), config, origins, batch_rows=None)
    found = [
        (fold, fit.model.best_epoch, min(h["validation_log_loss"] for h in fit.history), name, float(w))
        for fold, fit in fits.items() for name, w in zip(("bias", *DENSE_FEATURES), (fit.model.bias, *fit.model.dense), strict=True)
    ]
    table = rounded(spark.createDataFrame(found, "fold int, best_epoch int, validation_log_loss double, feature string, weight double"), "validation_log_loss", "weight")
    # The first step of the bias is 0 but for rounding, on either side of it.
    return table.withColumn("weight", F.col("weight") + 0.0)


@query("SELECT doc_id, source, count(*) OVER () AS all_rows, count(*) OVER () AS all_draws, true AS spread FROM documents")
def exact_draws(spark, sf_dir):
    """A bootstrap sample of the documents, a row for each: exactly as many draws as documents in all, about a third of which
    are not drawn."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "source")
    drawn = scratch.stage(draws.with_draws(docs, None, ["doc_id"], seed=3), "drawn")
    spread = F.avg((F.col("draws") == 0).cast("int")).between(0.3, 0.44) & (F.max("draws") < 20)
    totals = drawn.agg(F.count("*").alias("all_rows"), F.sum("draws").alias("all_draws"), spread.alias("spread"))
    return drawn.filter("draws >= 0").select("doc_id", "source").crossJoin(totals)


def _runs(runs: DataFrame) -> DataFrame:
    return runs.select("config", F.get_json_object("model", "$.bias").cast("double").alias("bias"), F.get_json_object("model", "$.best_epoch").cast("int").alias("best_epoch"), "history")


@query()
def lr_train_minibatch(spark, sf_dir):
    """The baseline with the default settings: mini-batches in shuffled order, so no SQL."""
    return _runs(training.train_all(_training_table(spark, sf_dir), {"baseline": TrainingConfig()}))


@query()
def ablation_suite(spark, sf_dir):
    return _runs(training.train_all(_training_table(spark, sf_dir), training.suite()))


@query()
def bootstrap_stability(spark, sf_dir):
    configs = {f"run{i}": TrainingConfig(seed=100 + i, patience=0) for i in range(4)}
    return training.stability(training.train_all(_training_table(spark, sf_dir), configs, bootstrap=list(configs)), DENSE_FEATURES)


@query()
def lr_train_distributed(spark, sf_dir):
    model = training.train_distributed(_training_table(spark, sf_dir))
    sparse = [(f"sparse_{i}", w) for i, w in sorted(model.sparse.items())]
    return spark.createDataFrame([("bias", model.bias), *zip(DENSE_FEATURES, model.dense, strict=True), *sparse], "feature string, weight double")


# Streams, run to the end of what is there
@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    stream = serving.as_stream(spark, sf_dir, tables.table(spark, sf_dir, "events").schema, "events.parquet")
    rows = serving.run_to_files(spark, serving.daily_counts(stream), "daily", "complete")
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_dedup(spark, sf_dir):
    stream = serving.as_stream(spark, sf_dir, tables.table(spark, sf_dir, "events").schema, "events.parquet")
    rows = serving.run_to_files(spark, serving.first_seen(stream.select("event_id", "ts")), "dedup")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query(f"WITH {_ROUTED} SELECT prediction_id, action, review AS manual_review_required FROM routed")
def stream_score_route(spark, sf_dir):
    """Routing on a stream of scored events."""
    stream = serving.as_stream(spark, sf_dir, tables.table(spark, sf_dir, "events").schema, "events.parquet")
    context = F.element_at(F.array(*map(F.lit, POLICIES)), (F.col("user_id") % 3 + 1).cast("int"))
    scored = stream.select(F.concat(F.lit("prediction_"), F.col("event_id").cast("string")).alias("prediction_id"), context.alias("task_context"), ((F.get_json_object("props", "$.k").cast("int") + 0.5) / 100).alias("probability"))
    return serving.run_to_files(spark, policy.decide(scored).select("prediction_id", "action", "manual_review_required"), "route")


@query("""WITH lab AS (SELECT event_id, ts, ts + to_hours((event_id % 40)::INTEGER) AS label_ts, (event_type = 'purchase')::INTEGER AS label FROM events WHERE event_id % 5 <> 0),
 mark AS (SELECT least((SELECT max(ts) FROM events), (SELECT max(label_ts) FROM lab)) - INTERVAL 1 HOUR AS at)
 SELECT e.event_id, coalesce(l.label, -1) AS label FROM events e LEFT JOIN lab l ON l.event_id = e.event_id AND l.label_ts <= e.ts + INTERVAL 24 HOUR, mark WHERE l.event_id IS NOT NULL OR e.ts + INTERVAL 24 HOUR < mark.at""")
def stream_label_maturity(spark, sf_dir):
    """Every event with its label, or with -1 once the attribution window of a day has passed without one; labels come up to
    39 hours late, and some never."""
    stream = lambda: serving.as_stream(spark, sf_dir, tables.table(spark, sf_dir, "events").schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events = stream().select("event_id", F.col("ts").alias("event_ts"))
    label_ts = F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 40).cast("int"))
    labels = stream().filter("event_id % 5 <> 0").select(F.col("event_id").alias("parent_event_id"), label_ts.alias("label_ts"), (F.col("event_type") == "purchase").cast("int").alias("label"), F.col("event_id").alias("label_event_id"))
    found = serving.matched_labels(events, labels, unlabelled=True).select("event_id", F.coalesce("label", F.lit(-1)).alias("label"))
    return serving.run_to_files(spark, found, "maturity")


@query(f"WITH {_CONTACTS} SELECT unnest([1, 2, 3, 4, 5]) AS place, unnest(['lookup', 'score', 'calibrate', 'route', 'log']) AS stage, count(*) AS requests, true AS timed FROM contacts")
def stream_stage_latency(spark, sf_dir):
    """A stream of requests, a contact each, scored and routed with every step timed."""
    rows = tables.contacts(spark, sf_dir)
    names = [n for n in RAW_COLUMNS if n != "y"]
    ids = {"request_id": F.concat(F.lit("req_"), F.col("row_id").cast("string")), "event_id": F.col("row_id").cast("string"), "event_ts": F.lit("2026-01-01T00:00:00Z")}
    folder, out = scratch.new_path(spark, "requests"), scratch.new_path(spark, "served")
    rows.select(F.to_json(F.struct(*(c.alias(n) for n, c in ids.items()), F.struct(*names).alias("features"))).alias("value")).write.text(folder, compression="gzip")
    serving.serve(spark, folder, out, f"{out}/checkpoint", replace(WEIGHTS, model_version="fixed"), calibration.Platt(1.0, 0.0), timed=True).awaitTermination()
    found = serving.stage_percentiles(serving.stage_latencies(spark, out))
    return found.select("place", "stage", "requests", ((F.col("p50_ms") > 0) & (F.col("p50_ms") <= F.col("p95_ms")) & (F.col("p95_ms") <= F.col("p99_ms"))).alias("timed"))
