"""Queries over the driver's tables, each with the SQL that gives the same rows.

Customers stand for patients, orders for scans, events for predictions, documents for a dataset index, embeddings for image
features, labels for a binary truth and pages for uploads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radquery.functions.dims import CLASSES, DEFAULT_FINDINGS, DEFAULT_PRECAUTIONS, DEMO, FINDINGS, PRECAUTIONS, told
from radquery.functions.numeric import pyfmt, pyround
from radquery import schemas
from radquery.operators import curation, curves, evaluate, keys, predict, records as upload, store, training, triage, views
from radquery.operators.report import SYSTEM, TEMPLATE, report
from radquery.operators.scoring import CentroidScorer, LogisticScorer, centroids
from radquery.sources.scratch import new_folder, stored
from radquery.sources.tables import batches, create_tables, read_table
from radquery.streaming.landing import triaged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- curation -------------------------------------------------------------------------------------------------------


@query("SELECT lang, source, CAST(count(*) AS BIGINT) AS n, CAST(printf('%.4f', 100.0 * count(*) / sum(count(*)) OVER ()) AS DOUBLE) AS share FROM documents GROUP BY lang, source")
def dataset_scan_distribution(spark, d):
    return curation.class_distribution(table(spark, d, "documents"), "lang", "source").withColumn("share", pyround(F.col("share"), 4))


@query(
    """SELECT CAST(count(*) AS BIGINT) AS "before", CAST(count(DISTINCT md5(text)) AS BIGINT) AS after_dedup,
    CAST(count(DISTINCT CASE WHEN n_chars > 1024 THEN md5(text) END) AS BIGINT) AS after_size FROM documents"""
)
def dataset_clean_stats(spark, d):
    return curation.cleaning_stats(table(spark, d, "documents"), F.md5("text"), "n_chars")


@query("SELECT CAST(count(DISTINCT lang) AS BIGINT) AS classes, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM documents")
def dataset_classes(spark, d):
    return table(spark, d, "documents").agg(F.countDistinct("lang").alias("classes"), F.countDistinct("source").alias("sources"))


@query("SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dataset_dedup_first(spark, d):
    return curation.first_by(table(spark, d, "documents"), F.md5("text"), "doc_id").select("doc_id", "lang", "n_chars")


@query("SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS label_idx FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def label_encode(spark, d):
    return curation.label_ids(table(spark, d, "orders"), "o_orderpriority")


@query("WITH d AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS i FROM (SELECT DISTINCT o_orderpriority FROM orders)) SELECT o_orderkey, CAST(i AS BIGINT) AS label_idx FROM orders JOIN d USING (o_orderpriority)")
def label_transform(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    dictionary = stored(curation.label_ids(orders, "o_orderpriority"), "labels")
    return curation.encoded(orders, "o_orderpriority", dictionary).select("o_orderkey", "label_idx")


@query(
    """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CAST((row_number() OVER (ORDER BY p + u * least(2000, n), p) - 1) // 32 AS BIGINT) AS batch FROM o"""
)
def minibatches(spark, d):
    """Documents through a shuffle buffer of 2000 rows, in batches of 32."""
    return batches(table(spark, d, "documents").select("doc_id"), "doc_id", 32, seed=42, buffer=2000)


def _quota_sql(name: str, counts: str, size: str) -> str:
    return f"""{name}_x AS (SELECT *, n / sum(n) OVER () * {size} AS x, {size} AS size FROM {counts}),
    {name} AS (SELECT label, n, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY floor(x) - x, label) <= size - sum(CAST(floor(x) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS quota FROM {name}_x)"""


def _split_sql(source: str) -> str:
    return f"""src AS ({source}), c0 AS (SELECT label, CAST(count(*) AS DOUBLE) AS n FROM src GROUP BY label),
    {_quota_sql('q1', 'c0', 'ceil(0.15 * sum(n) OVER ())')}, c1 AS (SELECT label, n - quota AS n FROM q1),
    {_quota_sql('q2', 'c1', f'ceil(CAST({0.15 / 0.85!r} AS DOUBLE) * sum(n) OVER ())')},
    sp AS (SELECT s.*, CASE WHEN r <= q1.quota THEN 'test' WHEN r <= q1.quota + q2.quota THEN 'val' ELSE 'train' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) AS r FROM src) s JOIN q1 USING (label) JOIN q2 USING (label))"""


EMB_SPLIT = _split_sql("SELECT vec_id AS id, label, embedding FROM embeddings")


@query(f"WITH {_split_sql('SELECT doc_id AS id, lang AS label FROM documents')} SELECT split, label AS lang, CAST(count(*) AS BIGINT) AS n, CAST(printf('%.4f', 100.0 * count(*) / sum(count(*)) OVER ()) AS DOUBLE) AS share FROM sp GROUP BY split, label")
def stratified_split_counts(spark, d):
    parts = curation.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang")
    return curation.class_distribution(parts, "split", "lang").withColumn("share", pyround(F.col("share"), 4))


@query(f"WITH {EMB_SPLIT} SELECT id AS vec_id, label, split FROM sp")
def stratified_split_rows(spark, d):
    return curation.stratified_split(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label").select("vec_id", "label", "split")


@query(
    f"""WITH src AS (SELECT vec_id AS id, label FROM embeddings), c0 AS (SELECT label, CAST(count(*) AS DOUBLE) AS n FROM src GROUP BY label),
    {_quota_sql('q', 'c0', 'least(300, sum(n) OVER ())')}
    SELECT s.id AS vec_id, s.label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) AS r FROM src) s JOIN q USING (label) WHERE r <= quota"""
)
def stratified_subsample(spark, d):
    return curation.stratified_subsample(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 300).select("vec_id", "label")


@query(
    """SELECT m AS mode, v AS variant, CAST(count(*) AS BIGINT) AS n FROM embeddings, (VALUES ('memory', 'original'), ('memory', 'flip'), ('stream', 'original'),
    ('stream', 'flip'), ('stream', 'rotate_left'), ('stream', 'rotate_right'), ('stream', 'brighten')) t(m, v) GROUP BY m, v"""
)
def augmentation_counts(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id")
    both = [curation.augmented(rows, m).withColumn("mode", F.lit(m)) for m in curation.VARIANTS]
    return both[0].unionByName(both[1]).groupBy("mode", "variant").agg(F.count("*").alias("n"))


@query("SELECT vec_id, CAST(printf('%.6f', list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) - 0.485) / 0.229))) AS DOUBLE) AS total FROM embeddings")
def vector_standardise(spark, d):
    scaled = F.transform("embedding", lambda x: (x.cast("double") - F.lit(0.485)) / F.lit(0.229))
    return table(spark, d, "embeddings").select("vec_id", pyround(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT vec_id, CAST(embedding[64] AS DOUBLE) AS first, CAST(embedding[1] AS DOUBLE) AS last FROM embeddings")
def vector_flip(spark, d):
    flipped = table(spark, d, "embeddings").withColumn("f", F.reverse("embedding"))
    return flipped.select("vec_id", F.element_at("f", 1).cast("double").alias("first"), F.element_at("f", -1).cast("double").alias("last"))


# ---- scoring and decisions ------------------------------------------------------------------------------------------

_CENTROIDS = "ct AS (SELECT label AS cls, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM sp, generate_series(1, 64) g(i) WHERE split = 'train' GROUP BY label, i)"


def _score_sql(name: str, dims: int) -> str:
    return f"""{name}_d AS (SELECT id, sp.label, cls, -8 * sum((CAST(embedding[i] AS DOUBLE) - m) ** 2) AS z FROM sp, ct WHERE split = 'test' AND i <= {dims} GROUP BY id, sp.label, cls),
    {name}_e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM {name}_d), {name} AS (SELECT id, label, cls, e / sum(e) OVER (PARTITION BY id) AS p FROM {name}_e)"""


SCORED = f"WITH {EMB_SPLIT}, {_CENTROIDS}, {_score_sql('full_s', 64)}, {_score_sql('half_s', 32)}"
_TOP = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, cls) AS r FROM {0}) WHERE r = 1)"


def scored(spark: SparkSession, d: str, dims: int = 64) -> DataFrame:
    """Test rows with the probabilities of a scorer that was fitted on training rows, stored, as several aggregations read them."""
    parts = curation.stratified_split(table(spark, d, "embeddings"), "vec_id", "label")
    rows = CentroidScorer(dims=dims).fit(parts.where("split = 'train'")).transform(parts.where("split = 'test'"))
    return stored(rows.select("vec_id", "label", "probs"), "scored")


def predicted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("predicted", triage.top(F.col("probs"))["cls"])


@query(f"WITH {EMB_SPLIT}, {_CENTROIDS} SELECT cls AS label, CAST(i - 1 AS INTEGER) AS dim, CAST(printf('%.6f', m) AS DOUBLE) AS mean FROM ct")
def class_centroids(spark, d):
    parts = curation.stratified_split(table(spark, d, "embeddings"), "vec_id", "label")
    return centroids(parts.where("split = 'train'"), "embedding", "label").withColumn("mean", pyround(F.col("mean"), 6))


def _probabilities(spark, d, dims):
    return scored(spark, d, dims).select("vec_id", F.explode("probs").alias("x")).select("vec_id", F.col("x.cls").alias("cls"), pyround(F.col("x.p") * 100, 4).alias("pct"))


@query(f"{SCORED} SELECT id AS vec_id, cls, CAST(printf('%.4f', p * 100) AS DOUBLE) AS pct FROM full_s")
def score_full_model(spark, d):
    return _probabilities(spark, d, 64)


@query(f"{SCORED} SELECT id AS vec_id, cls, CAST(printf('%.4f', p * 100) AS DOUBLE) AS pct FROM half_s")
def score_half_model(spark, d):
    return _probabilities(spark, d, 32)


@query()
def score_logistic(spark, d):
    parts = curation.stratified_split(table(spark, d, "embeddings"), "vec_id", "label")
    rows = LogisticScorer().fit(parts.where("split = 'train'")).transform(parts.where("split = 'test'"))
    return predicted(rows).select("vec_id", "label", "predicted")


@query(f"{SCORED} SELECT id AS vec_id, label, cls AS predicted, CAST(printf('%.2f', p * 100) AS DOUBLE) AS confidence FROM {_TOP.format('full_s')}")
def argmax_confidence(spark, d):
    rows = predicted(scored(spark, d))
    return rows.select("vec_id", "label", "predicted", pyround(triage.top(F.col("probs"))["p"] * 100, 2).alias("confidence"))


@query(
    f"""{SCORED}, t AS {_TOP.format('full_s')}, a AS (SELECT s.id, s.cls, CAST(printf('%.2f', s.p * 100) AS DOUBLE) AS pct FROM full_s s JOIN t ON s.id = t.id AND s.cls <> t.cls),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pct DESC, cls) AS rk FROM a)
    SELECT id AS vec_id, string_agg(cls || ' (' || printf('%.1f', pct) || '%)', ', ' ORDER BY rk) AS alternatives FROM r WHERE rk <= 2 GROUP BY id"""
)
def top2_alternatives(spark, d):
    rows = predicted(scored(spark, d))
    return rows.select("vec_id", F.array_join(triage.alternatives(F.col("probs"), F.col("predicted")), ", ").alias("alternatives"))


#: Events as predictions: a condition for each kind, and a confidence in percent.
CONDITION_OF = {"view": "Normal", "signup": "Pneumonia", "error": "Lung Cancer", "click": "Tuberculosis", "purchase": "COVID-19"}
_CONDITION = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONDITION_OF.items()) + " END"
_CONFIDENCE = "CAST(printf('%.2f', least(100, value / 5)) AS DOUBLE)"
_URGENCY = """CASE WHEN condition IN ('Lung Cancer', 'COVID-19') AND confidence > 70 THEN 'emergency'
    WHEN condition IN ('Tuberculosis', 'Pleural Effusion', 'Pneumonia') AND confidence > 60 THEN 'urgent' ELSE 'routine' END"""
PREDICTIONS = f"WITH p0 AS (SELECT *, {_CONDITION} AS condition, {_CONFIDENCE} AS confidence FROM events), p AS (SELECT *, {_URGENCY} AS urgency FROM p0)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in CONDITION_OF.items() for x in pair))
    rows = table(spark, d, "events").withColumns({"condition": names[F.col("event_type")], "confidence": pyround(F.least(F.lit(100.0), F.col("value") / 5), 2)})
    return rows.withColumn("urgency", triage.urgency(F.col("condition"), F.col("confidence")))


@query(f"{PREDICTIONS} SELECT event_id, condition, confidence, urgency FROM p")
def urgency_triage(spark, d):
    return predictions(spark, d).select("event_id", "condition", "confidence", "urgency")


@query(
    f"""{SCORED}, f AS {_TOP.format('full_s')}, h AS {_TOP.format('half_s')}, b AS (SELECT f.id, CASE WHEN f.id % 3 <> 0 THEN 'full' WHEN f.id % 2 <> 0 THEN 'half' ELSE 'demo' END AS model, f.cls AS fc, f.p AS fp, h.cls AS hc, h.p AS hp FROM f JOIN h USING (id))
    SELECT id AS vec_id, model, CASE model WHEN 'full' THEN CAST(fc AS VARCHAR) WHEN 'half' THEN CAST(hc AS VARCHAR) ELSE 'Pneumonia' END AS condition,
    CAST(printf('%.2f', CASE model WHEN 'full' THEN fp * 100 WHEN 'half' THEN hp * 100 ELSE 82.4 END) AS DOUBLE) AS confidence FROM b"""
)
def best_model_coalesce(spark, d):
    """Some rows have no full model, and some of these no half model either."""
    demo = max(DEMO, key=DEMO.get)
    best = lambda name, df: F.struct(F.lit(name).alias("model"), triage.top(F.col("probs"))["cls"].cast("string").alias("condition"), (triage.top(F.col("probs"))["p"] * 100).alias("pct"))
    full = scored(spark, d, 64).select("vec_id", F.when(F.col("vec_id") % 3 != 0, best("full", None)).alias("full"))
    half = scored(spark, d, 32).select("vec_id", F.when(F.col("vec_id") % 2 != 0, best("half", None)).alias("half"))
    stand_in = F.struct(F.lit("demo").alias("model"), F.lit(demo).alias("condition"), F.lit(DEMO[demo]).alias("pct"))
    chosen = full.join(half, "vec_id").select("vec_id", F.coalesce("full", "half", stand_in).alias("x"))
    return chosen.select("vec_id", "x.model", "x.condition", pyround(F.col("x.pct"), 2).alias("confidence"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _told_sql(condition: str, values: dict, otherwise: list, between: str) -> str:
    """The constants as SQL text, joined."""
    flat = lambda v: _quoted(between.join(": ".join(x) if isinstance(x, tuple) else x for x in v))
    return f"CASE {condition} " + " ".join(f"WHEN {_quoted(k)} THEN {flat(v)}" for k, v in values.items()) + f" ELSE {flat(otherwise)} END"


#: Events of every kind but views; a view has no known condition.
_KNOWN = "CASE WHEN event_type <> 'view' THEN condition END"


@query(f"{PREDICTIONS} SELECT event_id, {_told_sql(_KNOWN, FINDINGS, DEFAULT_FINDINGS, '; ')} AS findings FROM p")
def findings_lookup(spark, d):
    rows = predictions(spark, d).withColumn("known", F.when(F.col("event_type") != "view", F.col("condition")))
    each = F.transform(told(F.col("known"), FINDINGS, DEFAULT_FINDINGS), lambda x: F.concat_ws(": ", x["label"], x["value"]))
    return rows.select("event_id", F.array_join(each, "; ").alias("findings"))


@query(f"{PREDICTIONS} SELECT event_id, {_told_sql(_KNOWN, PRECAUTIONS, DEFAULT_PRECAUTIONS, ' | ')} AS precautions FROM p")
def precautions_lookup(spark, d):
    rows = predictions(spark, d).withColumn("known", F.when(F.col("event_type") != "view", F.col("condition")))
    return rows.select("event_id", F.array_join(told(F.col("known"), PRECAUTIONS, DEFAULT_PRECAUTIONS), " | ").alias("precautions"))


def _slot_sql(m: str, has: str, step: int) -> str:
    """Probabilities of a model for the seven classes, from numbers of the event."""
    w = f"list_transform(range(7), lambda i: CAST((event_id * (i + {step})) % 101 + 1 AS DOUBLE))"
    return f"CASE WHEN {has} THEN list_transform({w}, lambda x: x / list_sum({w})) END AS {m}_p"


_CLASS_LIST = "[" + ", ".join(map(_quoted, CLASSES)) + "]"
_DEMO_LIST = "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in DEMO.values()) + "]"
_RECORD = f"""WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 5 = 0 THEN 'CNN' ELSE 'ResNet' END AS selected_model,
      {_slot_sql('cnn', 'event_id % 3 <> 0', 3)}, {_slot_sql('resnet', 'event_id % 2 <> 0', 5)} FROM events),
    k AS (SELECT *, list_transform(cnn_p, lambda x: CAST(printf('%.2f', x * 100) AS DOUBLE)) AS cnn_c, list_transform(resnet_p, lambda x: CAST(printf('%.2f', x * 100) AS DOUBLE)) AS resnet_c,
      list_position(cnn_p, list_max(cnn_p)) AS cnn_k, list_position(resnet_p, list_max(resnet_p)) AS resnet_k FROM e),
    s AS (SELECT event_id, ts, selected_model, coalesce(cnn_c, CASE WHEN resnet_c IS NULL THEN {_DEMO_LIST} END) AS cnn_c, coalesce(resnet_c, CASE WHEN cnn_c IS NULL THEN {_DEMO_LIST} END) AS resnet_c,
      coalesce(cnn_k, CASE WHEN resnet_k IS NULL THEN 2 END) AS cnn_k, coalesce(resnet_k, CASE WHEN cnn_k IS NULL THEN 2 END) AS resnet_k FROM k),
    f AS (SELECT *, CASE WHEN selected_model = 'CNN' THEN coalesce(cnn_c, resnet_c) ELSE coalesce(resnet_c, cnn_c) END AS c, CASE WHEN selected_model = 'CNN' THEN coalesce(cnn_k, resnet_k) ELSE coalesce(resnet_k, cnn_k) END AS n FROM s),
    g AS (SELECT *, {_CLASS_LIST}[n] AS condition, c[n] AS confidence FROM f),
    a AS (SELECT event_id, string_agg({_CLASS_LIST}[i] || ' (' || printf('%.1f', c[i]) || '%)', ', ' ORDER BY r) AS alternatives
      FROM (SELECT event_id, c, i, row_number() OVER (PARTITION BY event_id ORDER BY c[i] DESC, i) AS r FROM g, generate_series(1, 7) t(i) WHERE i <> n) WHERE r <= 2 GROUP BY event_id),
    r AS (SELECT event_id, ts, selected_model, {_CLASS_LIST}[cnn_k] AS cnn_primary_condition, cnn_c[cnn_k] AS cnn_confidence, {_CLASS_LIST}[resnet_k] AS resnet_primary_condition, resnet_c[resnet_k] AS resnet_confidence,
      condition AS final_condition, confidence AS final_confidence, {_URGENCY} AS urgency_level, alternatives FROM g JOIN a USING (event_id))"""


def records(events: DataFrame) -> DataFrame:
    """Events as uploads that two models have scored; some lack a model, and some both."""

    def probs(has: str, step: int):
        weights = F.array(*(((F.col("event_id") * (i + step)) % 101 + 1).cast("double") for i in range(7)))
        total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
        each = F.transform(weights, lambda x, i: F.struct(F.element_at(F.array(*map(F.lit, CLASSES)), i + 1).alias("cls"), (x / total).alias("p")))
        return F.when(F.expr(has), each)

    rows = events.select("*", probs("event_id % 3 <> 0", 3).alias("cnn_probs"), probs("event_id % 2 <> 0", 5).alias("resnet_probs"))
    return predict.predictions(rows, F.when(F.col("event_id") % 5 == 0, "CNN").otherwise(predict.DEFAULT_MODEL))


_SLOTS = ("cnn_primary_condition", "cnn_confidence", "resnet_primary_condition", "resnet_confidence", "final_condition", "final_confidence", "urgency_level")


@query(f"""{_RECORD} SELECT event_id, selected_model, {', '.join(_SLOTS)}, alternatives, {_told_sql('final_condition', FINDINGS, DEFAULT_FINDINGS, '; ')} AS findings, {_told_sql('final_condition', PRECAUTIONS, DEFAULT_PRECAUTIONS, ' | ')} AS precautions FROM r""")
def prediction_record(spark, d):
    each = F.transform("key_findings", lambda x: F.concat_ws(": ", x["label"], x["value"]))
    return records(table(spark, d, "events").select("event_id", "ts")).select("event_id", "selected_model", *_SLOTS, F.array_join("alternative_conditions", ", ").alias("alternatives"), F.array_join(each, "; ").alias("findings"), F.array_join("precautions", " | ").alias("precautions"))


@query(f"{SCORED} SELECT id AS vec_id, abs(100 - sum(CAST(printf('%.2f', p * 100) AS DOUBLE))) < 0.1 AS about_100 FROM full_s GROUP BY id")
def probability_sums(spark, d):
    total = F.aggregate(triage.percents(F.col("probs")), F.lit(0.0), lambda s, x: s + x["pct"])
    return scored(spark, d).select("vec_id", (F.abs(100 - total) < 0.1).alias("about_100"))


# ---- evaluation -----------------------------------------------------------------------------------------------------

_CM = """cls AS (SELECT DISTINCT label AS c FROM {0} UNION SELECT DISTINCT predicted FROM {0}),
    cm AS (SELECT a.c AS actual, b.c AS predicted, CAST(count(x.label) AS BIGINT) AS n FROM cls a CROSS JOIN cls b LEFT JOIN {0} x ON x.label = a.c AND x.predicted = b.c GROUP BY a.c, b.c),
    pc AS (SELECT c AS cls, (SELECT sum(n) FROM cm WHERE actual = c AND predicted = c) AS tp, (SELECT sum(n) FROM cm WHERE actual = c) AS support, (SELECT sum(n) FROM cm WHERE predicted = c) AS chosen FROM cls),
    pr AS (SELECT cls, tp, support, CASE WHEN chosen = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / chosen END AS pre, CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / support END AS rec FROM pc),
    rep AS (SELECT *, CASE WHEN pre + rec = 0 THEN 0.0::DOUBLE ELSE 2 * pre * rec / (pre + rec) END AS f1 FROM pr)"""


def _prediction_sql(name: str) -> str:
    return f"{name}_p AS (SELECT id, label, cls AS predicted FROM {_TOP.format(name)})"


@query(f"{SCORED}, {_prediction_sql('full_s')}, {_CM.format('full_s_p')} SELECT actual, predicted, n FROM cm")
def confusion_matrix_dense(spark, d):
    return evaluate.confusion(predicted(scored(spark, d)), "label", "predicted")


@query(f"WITH x AS (SELECT quality AS label, toxic AS predicted FROM labels), {_CM.format('x')} SELECT actual, predicted, n FROM cm")
def confusion_matrix_labels(spark, d):
    return evaluate.confusion(table(spark, d, "labels"), "quality", "toxic")


_R4 = "CAST(printf('%.4f', {0}) AS DOUBLE)"


@query(
    f"""{SCORED}, {_prediction_sql('full_s')}, {_CM.format('full_s_p')} SELECT {_R4.format('sum(pre * support) / sum(support)')} AS "precision",
    {_R4.format('sum(rec * support) / sum(support)')} AS recall, {_R4.format('sum(f1 * support) / sum(support)')} AS f1_score FROM rep"""
)
def weighted_prf(spark, d):
    m = evaluate.weighted(evaluate.per_class(evaluate.confusion(predicted(scored(spark, d)), "label", "predicted")))
    return m.select(*(pyround(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1_score")))


@query(
    f"""{SCORED}, {_prediction_sql('full_s')}, {_CM.format('full_s_p')}, r AS (
    SELECT CAST(cls AS VARCHAR) AS cls, pre, rec, f1, support FROM rep UNION ALL SELECT 'macro avg', avg(pre), avg(rec), avg(f1), sum(support) FROM rep
    UNION ALL SELECT 'weighted avg', sum(pre * support) / sum(support), sum(rec * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM rep)
    SELECT cls, {_R4.format('pre')} AS "precision", {_R4.format('rec')} AS recall, {_R4.format('f1')} AS f1, CAST(support AS BIGINT) AS support FROM r"""
)
def per_class_report(spark, d):
    rep = evaluate.per_class(evaluate.confusion(predicted(scored(spark, d)), "label", "predicted"))
    macro = rep.agg(F.lit("macro avg").alias("cls"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    means = evaluate.weighted(rep).select(F.lit("weighted avg").alias("cls"), "precision", "recall", F.col("f1_score").alias("f1"))
    weighted = means.join(F.broadcast(rep.agg(F.sum("support").alias("support"))))  # one row
    rows = rep.select(F.col("cls").cast("string"), "precision", "recall", "f1", "support").unionByName(macro).unionByName(weighted)
    return rows.select("cls", *(pyround(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")), F.col("support").cast("long"))


@query(f"{SCORED}, {_prediction_sql('full_s')} SELECT {_R4.format('avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM full_s_p")
def accuracy(spark, d):
    return evaluate.weighted(evaluate.per_class(evaluate.confusion(predicted(scored(spark, d)), "label", "predicted"))).select(pyround(F.col("accuracy"), 4).alias("accuracy"))


def _auc_sql(name: str) -> str:
    return f"""{name}_r AS (SELECT cls, label = cls AS pos, p FROM {name}),
    {name}_k AS (SELECT cls, pos, rank() OVER (PARTITION BY cls ORDER BY p) + (count(*) OVER (PARTITION BY cls, p) - 1) / 2.0::DOUBLE AS k FROM {name}_r),
    {name}_c AS (SELECT cls, sum(CASE WHEN pos THEN k END) AS s, count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn FROM {name}_k GROUP BY cls),
    {name}_a AS (SELECT cls, CASE WHEN np * nn > 0 THEN (s - np * (np + 1) / 2.0::DOUBLE) / (np * nn) END AS auc FROM {name}_c),
    {name}_u AS (SELECT CASE WHEN count(auc) < count(*) THEN 0.0::DOUBLE ELSE avg(auc) END AS auc FROM {name}_a)"""


@query(f"{SCORED}, {_auc_sql('full_s')} SELECT {_R4.format('auc')} AS auc_roc FROM full_s_u")
def auc_ovr_macro(spark, d):
    return evaluate.macro_auc(scored(spark, d), "label").select(pyround(F.col("auc_roc"), 4).alias("auc_roc"))


@query(
    f"""WITH x AS (SELECT d.n_chars AS p, l.toxic = 1 AS pos FROM documents d JOIN labels l USING (doc_id)), k AS (SELECT pos, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS k FROM x)
    SELECT {_R4.format('(sum(CASE WHEN pos THEN k END) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos))')} AS auc FROM k"""
)
def auc_binary_toxic(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return evaluate.auc(rows.withColumn("_all", F.lit(1)), ["_all"], F.col("n_chars"), F.col("toxic") == 1).select(pyround(F.col("auc"), 4).alias("auc"))


def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A row of rounded metrics for each of both scorers."""
    out = []
    for name, dims in (("ResNet", 64), ("CNN", 32)):
        rows = scored(spark, d, dims)
        means = evaluate.weighted(evaluate.per_class(evaluate.confusion(predicted(rows), "label", "predicted")))
        both = means.join(F.broadcast(evaluate.macro_auc(rows, "label")))  # one row each
        out.append(evaluate.composite(evaluate.rounded(both)).select(F.lit(name).alias("model"), *METRICS, "composite"))
    return out[0].unionByName(out[1])


METRICS = ("accuracy", "precision", "recall", "f1_score", "auc_roc")


def _metrics_sql() -> str:
    parts, selects = [], []
    for model, s in (("ResNet", "full_s"), ("CNN", "half_s")):
        cm = _CM.format(f"{s}_p")
        for t in ("cls", "cm", "pc", "pr", "rep"):
            cm = cm.replace(f"{t} AS (", f"{s}_{t} AS (").replace(f"FROM {t} ", f"FROM {s}_{t} ").replace(f"FROM {t})", f"FROM {s}_{t})").replace(f"JOIN {t} ", f"JOIN {s}_{t} ")
        parts.append(f"{_prediction_sql(s)}, {cm}, {_auc_sql(s)}")
        w = lambda c: _R4.format(f"sum({c} * support) / sum(support)")
        selects.append(f"SELECT '{model}' AS model, {_R4.format('sum(tp)::DOUBLE / sum(support)')} AS accuracy, {w('pre')} AS \"precision\", {w('rec')} AS recall, {w('f1')} AS f1_score, (SELECT {_R4.format('auc')} FROM {s}_u) AS auc_roc FROM {s}_rep")
    comp = "CAST(printf('%.4f', 0.0 + f1_score * 0.4 + accuracy * 0.3 + auc_roc * 0.2 + recall * 0.1) AS DOUBLE)"
    return f"{SCORED}, {', '.join(parts)}, m0 AS ({' UNION ALL '.join(selects)}), m AS (SELECT *, {comp} AS composite FROM m0)"


METRICS_SQL = _metrics_sql()


@query(f"{METRICS_SQL} SELECT model, composite, model = (SELECT model FROM m ORDER BY composite DESC, model DESC LIMIT 1) AS winner FROM m")
def composite_winner(spark, d):
    both = model_metrics(spark, d).agg(F.collect_list(F.struct("composite", "model")).alias("m"))  # two rows
    each = both.select(F.array_max("m").alias("best"), F.explode("m").alias("x"))  # of equal ones ResNet, which is last by name
    return each.select("x.model", "x.composite", (F.col("x.model") == F.col("best.model")).alias("winner"))


@query(f"{METRICS_SQL}, u AS (UNPIVOT (SELECT model, accuracy, \"precision\", recall, f1_score, auc_roc FROM m) ON accuracy, \"precision\", recall, f1_score, auc_roc INTO NAME metric VALUE v) SELECT metric, max(v) FILTER (model = 'CNN') AS cnn, max(v) FILTER (model = 'ResNet') AS resnet FROM u GROUP BY metric")
def metric_pivot(spark, d):
    long = model_metrics(spark, d).unpivot(["model"], list(METRICS), "metric", "v")
    pivoted = long.groupBy("metric").pivot("model", ["CNN", "ResNet"]).agg(F.max("v"))
    return pivoted.select("metric", F.col("CNN").alias("cnn"), F.col("ResNet").alias("resnet"))


@query(f"{METRICS_SQL}, u AS (UNPIVOT (SELECT model, accuracy, \"precision\", recall, f1_score, auc_roc FROM m) ON accuracy, \"precision\", recall, f1_score, auc_roc INTO NAME metric VALUE v) SELECT metric, CASE WHEN max(v) FILTER (model = 'CNN') >= max(v) FILTER (model = 'ResNet') THEN 'CNN' ELSE 'ResNet50' END AS winner FROM u GROUP BY metric")
def metric_winner_per_metric(spark, d):
    return metric_pivot(spark, d).select("metric", F.when(F.col("cnn") >= F.col("resnet"), "CNN").otherwise("ResNet50").alias("winner"))


@query(f"{METRICS_SQL} SELECT model, upper(model) = upper((SELECT model FROM m ORDER BY composite DESC, model DESC LIMIT 1)) AS is_active, 'Both' AS model_used FROM m")
def is_active_flag(spark, d):
    return composite_winner(spark, d).select("model", F.col("winner").alias("is_active"), F.lit("Both").alias("model_used"))


@query(
    f"""{SCORED}, {_prediction_sql('full_s')}, {_CM.format('full_s_p')}, t AS {_TOP.format('full_s')}, c AS (SELECT cls, CAST(printf('%.4f', avg(p)) AS DOUBLE) AS mean_p FROM t GROUP BY cls)
    SELECT actual, predicted, n, mean_p FROM cm LEFT JOIN c ON c.cls = cm.predicted"""
)
def flagship(spark, d):
    """Splits, fits, scores, decides and evaluates: the confusion table, with the mean probability of each decision."""
    rows = predicted(scored(spark, d)).withColumn("p", triage.top(F.col("probs"))["p"])
    table = evaluate.dense(evaluate.pairs(rows, "label", "predicted", "p"))
    column = Window.partitionBy("predicted")  # of a table of a row for each pair of classes
    return table.select("actual", "predicted", "n", pyround(F.try_divide(F.sum("p").over(column), F.sum("n").over(column)), 4).alias("mean_p"))


@query(f"{METRICS_SQL} SELECT model, v AS version, v = '1.0.1' AND model = (SELECT model FROM m ORDER BY composite DESC, model DESC LIMIT 1) AS is_active, accuracy, auc_roc, i * 2 + CASE model WHEN 'CNN' THEN 1 ELSE 2 END AS id FROM m, (VALUES (0, '1.0.0'), (1, '1.0.1')) t(i, v)")
def training_versions(spark, d):
    """Both models are recorded by two trainings, the second of them twice; one row is active."""
    folder, rows = new_folder(spark, "metrics"), stored(model_metrics(spark, d), "model-metrics").withColumnRenamed("model", "model_name")
    create_tables(spark, folder)
    for batch in ("first", "second", "second"):
        found = training.record_training(rows.orderBy("model_name"), folder, batch, F.struct("composite", "model_name"))
    return found.select(F.col("model_name").alias("model"), "version", "is_active", "accuracy", "auc_roc", F.col("id").cast("int").alias("id"))


@query()
def score_network(spark, d):
    parts = curation.stratified_split(table(spark, d, "embeddings"), "vec_id", "label")
    rows = training.NetworkScorer(epochs=8).fit(parts.where("split = 'train'")).transform(parts.where("split = 'test'"))
    return predicted(rows).select("vec_id", "label", "predicted")


@query()
def two_phase_training(spark, d):
    """Curves of both phases by epoch."""
    parts = stored(curation.stratified_split(table(spark, d, "embeddings"), "vec_id", "label"), "split")
    classes = sorted(r[0] for r in parts.select("label").distinct().limit(training.MOST_CLASSES).collect())
    train, val = (training.examples(parts.where(F.col("split") == s), "embedding", "label", classes) for s in ("train", "val"))
    start = training.initial(classes, 64, (32,))
    _, found = training.two_phases(train, val, start, new_folder(spark, "models"), "resnet", epochs=6, steps=(0.02, 0.005))
    rows = [(k + 1, *(found[c][k] for c in found)) for k in range(len(found["phase"]))]
    return spark.createDataFrame(rows, "epoch int, " + ", ".join(f"{c} {'int' if c == 'phase' else 'double'}" for c in found))


# ---- curves ---------------------------------------------------------------------------------------------------------

_DAYS = "day AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(printf('%.4f', avg(value)) AS DOUBLE) AS v FROM events GROUP BY 1, 2)"


def _curve(spark: SparkSession, d: str, kind: str, name: str) -> DataFrame:
    """One row: daily means of the events of a kind, as an array in order of days."""
    days = table(spark, d, "events").where(F.col("event_type") == kind).groupBy(F.to_date("ts").alias("day")).agg(pyround(F.avg("value"), 4).alias("v"))
    return days.agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda s: s["v"]).alias(name))


@query(
    f"""WITH {_DAYS}, a AS (SELECT v, row_number() OVER (ORDER BY day) AS epoch FROM day WHERE event_type = 'view'), b AS (SELECT v, row_number() OVER (ORDER BY day) AS epoch FROM day WHERE event_type = 'error' AND day < DATE '2024-01-20')
    SELECT CAST(epoch AS INTEGER) AS epoch, a.v AS cnn, b.v AS resnet FROM a FULL JOIN b USING (epoch)"""
)
def ragged_curve_zip(spark, d):
    short = table(spark, d, "events").where((F.col("event_type") == "error") & (F.to_date("ts") < F.lit("2024-01-20").cast("date")))
    days = short.groupBy(F.to_date("ts").alias("day")).agg(pyround(F.avg("value"), 4).alias("v"))
    resnet = days.agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda s: s["v"]).alias("resnet"))
    return curves.zipped(_curve(spark, d, "view", "cnn").join(resnet), ["cnn", "resnet"], [])


@query(f"WITH {_DAYS} SELECT event_type, string_agg(CAST(v AS VARCHAR), ', ' ORDER BY day) AS losses FROM day GROUP BY event_type")
def history_concat(spark, d):
    """Daily means of each kind of event, first those before a day and then the others, as of two phases of training."""
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(pyround(F.avg("value"), 4).alias("v"))
    early = F.col("day") < F.lit("2024-01-15").cast("date")
    curve = lambda rows: rows.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda s: s["v"]).alias("losses"))
    both = curves.concatenated(curve(days.where(early)), curve(days.where(~early)), "event_type", ["losses"])
    return both.select("event_type", F.array_join(F.transform("losses", lambda x: x.cast("string")), ", ").alias("losses"))


@query("SELECT p_partkey, CAST(greatest(1, least(4, p_size // 3)) AS INTEGER) AS frozen, CAST(greatest(1, p_size - greatest(1, least(4, p_size // 3))) AS INTEGER) AS tuned FROM part")
def epoch_schedule(spark, d):
    return table(spark, d, "part").select("p_partkey", *curves.phases(F.col("p_size")))


@query(
    f"""WITH {_DAYS}, a AS (SELECT v, row_number() OVER (ORDER BY day) AS epoch FROM day WHERE event_type = 'click'),
    b AS (SELECT *, min(v) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low, coalesce(min(v) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e308) AS prev FROM a),
    c AS (SELECT *, max(CASE WHEN v < prev THEN epoch END) OVER (ORDER BY epoch) AS best FROM b)
    SELECT CAST(epoch AS INTEGER) AS stopped, CAST(best AS INTEGER) AS best FROM c WHERE epoch = coalesce((SELECT min(epoch) FROM c WHERE epoch - best >= 3), (SELECT max(epoch) FROM c))"""
)
def early_stop_epoch(spark, d):
    return _curve(spark, d, "click", "losses").select(curves.early_stop(F.col("losses")).alias("x")).select("x.stopped", "x.best")


_EPOCHS = f"{_DAYS}, c AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY day) AS epoch FROM day)"


def _event_curves(spark: SparkSession, d: str) -> DataFrame:
    """(event_type, losses): daily means in order of days."""
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(pyround(F.avg("value"), 4).alias("v"))
    return days.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda s: s["v"]).alias("losses"))


@query(
    f"""WITH RECURSIVE {_EPOCHS}, s AS (SELECT event_type, epoch, v, v AS least, 0 AS waited, CAST(1e-4 AS DOUBLE) AS rate, CAST(1e-4 AS DOUBLE) AS next FROM c WHERE epoch = 1
      UNION ALL SELECT c.event_type, c.epoch, c.v, CASE WHEN c.v < s.least - CAST(1e-4 AS DOUBLE) THEN c.v ELSE s.least END,
        CASE WHEN c.v < s.least - CAST(1e-4 AS DOUBLE) OR s.waited = 1 AND s.next > CAST(1e-7 AS DOUBLE) THEN 0 ELSE s.waited + 1 END, s.next,
        CASE WHEN NOT c.v < s.least - CAST(1e-4 AS DOUBLE) AND s.waited >= 1 AND s.next > CAST(1e-7 AS DOUBLE) THEN greatest(s.next * CAST(0.5 AS DOUBLE), CAST(1e-7 AS DOUBLE)) ELSE s.next END
      FROM s JOIN c ON c.event_type = s.event_type AND c.epoch = s.epoch + 1)
    SELECT event_type, CAST(epoch AS INTEGER) AS epoch, v AS loss, rate FROM s"""
)
def learning_rate_schedule(spark, d):
    rows = _event_curves(spark, d).withColumn("rates", curves.learning_rates(F.col("losses")))
    pairs = rows.select("event_type", F.posexplode(F.arrays_zip("losses", "rates")).alias("at", "x"))
    return pairs.select("event_type", (F.col("at") + 1).alias("epoch"), F.col("x.losses").alias("loss"), F.col("x.rates").alias("rate"))


@query(f"WITH {_EPOCHS} SELECT event_type, CAST(min(epoch) FILTER (v = m) AS INTEGER) AS epoch, max(v) AS accuracy FROM (SELECT *, max(v) OVER (PARTITION BY event_type) AS m FROM c) GROUP BY event_type")
def best_checkpoint(spark, d):
    return _event_curves(spark, d).select("event_type", curves.checkpoint_epoch(F.col("losses")).alias("epoch"), F.array_max("losses").alias("accuracy"))


# ---- stored records -------------------------------------------------------------------------------------------------


@query("SELECT event_id, ts, event_type, value, CAST((SELECT count(*) FROM events) AS BIGINT) AS total FROM events ORDER BY ts DESC, event_id OFFSET 20 LIMIT 20")
def prediction_page_desc(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    return views.page(rows, [F.desc("ts"), F.asc("event_id")], 20, 20)


@query("SELECT c_custkey, c_name, CAST((SELECT count(*) FROM customer) AS BIGINT) AS total FROM customer ORDER BY c_custkey LIMIT 20")
def patient_page(spark, d):
    return views.page(table(spark, d, "customer").select("c_custkey", "c_name"), [F.asc("c_custkey")])


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 20) WHERE contains(lower(event_type), 'i')")
def page_then_filter(spark, d):
    rows = views.page(table(spark, d, "events").select("event_id", "ts", "event_type"), [F.desc("ts"), F.asc("event_id")])
    return rows.where(views.contains_any("I", F.col("event_type")) & views.chosen("all", F.col("event_type"))).select("event_id", "event_type")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_name), '12') OR contains(lower(n_name), '12') OR contains(lower(c_mktsegment), '12')")
def patient_search(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.where(views.contains_any("12", *map(F.col, ("c_name", "n_name", "c_mktsegment")))).select("c_custkey", "c_name", "n_name")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 101")
def point_lookup(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    row = store.one_or_none(orders, "o_orderkey", 101)
    return spark.createDataFrame([row] if row else [], orders.schema)


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id")
def report_list(spark, d):
    return views.listed(table(spark, d, "events").select("event_id", "ts", "event_type"), [F.desc("ts"), F.asc("event_id")])


@query(
    """WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, count(*) AS scans, sum(coalesce(n, 0)) AS details, max(o_orderdate) AS last_scan FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT c_custkey, CAST(coalesce(scans, 0) AS BIGINT) AS scans, CAST(coalesce(details, 0) AS BIGINT) AS details, last_scan FROM customer LEFT JOIN o ON o_custkey = c_custkey"""
)
def patient_timeline(spark, d):
    customer, orders, lineitem = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    return views.timeline(customer, orders, lineitem, "c_custkey", "o_custkey", "o_orderkey", "l_orderkey", "o_orderdate")


@query("SELECT event_id, user_id FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_custkey % 10 <> 0)")
def fk_resolution_errors(spark, d):
    return store.missing_parents(table(spark, d, "events").select("event_id", "user_id"), "user_id", table(spark, d, "customer").where("c_custkey % 10 <> 0"), "c_custkey")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'DEFAULT' ELSE CAST(c_custkey AS VARCHAR) END AS resolved FROM events LEFT JOIN customer ON c_custkey = user_id AND event_id % 7 <> 0")
def default_patient_upsert(spark, d):
    events = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id"))
    return store.with_default(events, "user_id", table(spark, d, "customer"), "c_custkey").select("event_id", "resolved")


@query("SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_name AS name FROM customer UNION ALL SELECT 'DEFAULT', 'Unregistered Patient'")
def default_patient_row(spark, d):
    """The record of uploads without a patient is made once: the second call adds none."""
    patients = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("patient_id"), F.col("c_name").alias("name"))
    for _ in range(2):
        patients = patients.unionByName(store.missing_default(patients).select("patient_id", "name"))
    return patients


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey % 3, c_custkey) AS id FROM customer")
def surrogate_ids(spark, d):
    """Customers appended in three batches, the second one twice: ids are dense and go on."""
    folder, rows, schema = new_folder(spark, "ids"), table(spark, d, "customer").select("c_custkey", "c_name"), "id bigint, c_custkey bigint, c_name string"
    for k in (0, 1, 1, 2):
        keys.append_numbered(rows.where(F.col("c_custkey") % 3 == k), folder, "customers", f"b{k}", schema, [F.col("c_custkey")])
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/customers")


@query(
    f"""{_RECORD}, pt AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS id FROM customer WHERE c_custkey % 10 <> 0),
    u AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN (SELECT count(*) + 1 FROM pt) ELSE pt.id END AS patient FROM events LEFT JOIN pt ON c_custkey = user_id),
    n AS (SELECT *, row_number() OVER (ORDER BY event_id % 2, event_id) AS n FROM u WHERE patient IS NOT NULL)
    SELECT event_id, 200 AS code, patient, n AS scan, n AS prediction, n AS report, final_condition AS condition FROM n JOIN r USING (event_id)
    UNION ALL SELECT event_id, 404, 0, 0, 0, 0, '' FROM u WHERE patient IS NULL"""
)
def upload_records(spark, d):
    """Events as uploads of two batches, the first of which runs twice, to patients, scans, predictions, reports and rejections."""
    folder = new_folder(spark, "records")
    create_tables(spark, folder)
    patients = table(spark, d, "customer").where("c_custkey % 10 <> 0").select("c_custkey", F.col("c_custkey").cast("string").alias("patient_id"), F.col("c_name").alias("name"))
    keys.append_numbered(patients, folder, "patients", "customers", schemas.PATIENTS, [F.col("c_custkey")])
    rows = table(spark, d, "events").select("event_id", F.col("ts").alias("at"), F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("string")).alias("patient_id"))
    rows = rows.withColumns({"size_bytes": F.lit(0), "scan_type": F.lit(None).cast("string"), "notes": F.lit(None).cast("string"), "filename": F.col("event_id").cast("string")})
    for k in (0, 0, 1):
        batch = stored(upload.with_patients(rows.where(F.col("event_id") % 2 == k), folder, f"e{k}"), "resolved")
        refused = batch.where("patient is null").withColumn("code", F.lit(404))
        upload.write_rejections(refused.withColumn("reason", upload.reason(F.lit(404), F.col("patient_id"), F.lit(None).cast("string"))), folder, f"e{k}")
        upload.write_records(batch.where("patient is not null"), folder, f"e{k}", [F.col("event_id")], made=records)
    scans, made, reports = (read_table(spark, folder, t).alias(t) for t in ("lung_scans", "predictions", "reports"))
    full = scans.join(made, F.col("predictions.scan_id") == F.col("lung_scans.id"), "full").join(reports, F.col("reports.prediction_id") == F.col("predictions.id"), "full")
    number = lambda c, name: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(name)
    full = full.select(F.col("image_filename").cast("long").alias("event_id"), F.lit(200).alias("code"), number("lung_scans.patient_id", "patient"), number("lung_scans.id", "scan"), number("predictions.id", "prediction"), number("reports.id", "report"), F.coalesce("final_condition", F.lit("")).alias("condition"))
    none = (F.lit(0).cast("long").alias(c) for c in ("patient", "scan", "prediction", "report"))
    return full.unionByName(read_table(spark, folder, "rejections").select(F.col("filename").cast("long").alias("event_id"), "code", *none, F.lit("").alias("condition")))


@query("SELECT resolved, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'DEFAULT' ELSE CAST(user_id AS VARCHAR) END AS resolved FROM events) WHERE resolved <> 'DEFAULT' GROUP BY 1")
def selector_without_default(spark, d):
    events = table(spark, d, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("string")).otherwise(store.DEFAULT_PATIENT).alias("resolved"))
    return events.where(F.col("resolved") != store.DEFAULT_PATIENT).groupBy("resolved").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k double")["k"].alias("k"))


@query(
    r"""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN -5 ELSE c_custkey % 150 END AS age, CASE WHEN c_custkey % 7 = 0 THEN 'Unknown' ELSE 'Female' END AS gender,
    CASE WHEN c_custkey % 3 = 0 THEN 'not-an-email' WHEN c_custkey % 4 = 0 THEN NULL ELSE 'a@b.org' END AS email FROM customer)
    SELECT c_custkey, concat_ws('; ', CASE WHEN length(name) NOT BETWEEN 1 AND 100 THEN 'name: invalid' END, CASE WHEN age NOT BETWEEN 0 AND 150 THEN 'age: invalid' END,
    CASE WHEN gender NOT IN ('Male', 'Female', 'Other') THEN 'gender: invalid' END, CASE WHEN email IS NOT NULL AND NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email: invalid' END) AS errors FROM x"""
)
def validate_rows(spark, d):
    key = F.col("c_custkey")
    email = F.when(key % 3 == 0, "not-an-email").when(key % 4 == 0, " \t").otherwise("a@b.org")
    broken = store.patient_violations(F.when(key % 11 == 0, "").otherwise(F.col("c_name")), F.when(key % 5 == 0, -5).otherwise(key % 150), F.when(key % 7 == 0, "Unknown").otherwise("Female"), store.blank_to_null(email))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(broken, lambda f: F.concat(f, F.lit(": invalid"))), "; ").alias("errors"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def unique_key_check(spark, d):
    return store.duplicate_keys(table(spark, d, "orders"), "o_custkey")


@query(
    """WITH v AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price, o_orderkey % 2 = 0 AS has FROM orders)
    SELECT o_custkey, arg_max(status, (o_orderdate, o_orderkey)) AS status, arg_max(price, (o_orderdate, o_orderkey)) FILTER (has) AS price FROM v GROUP BY o_custkey"""
)
def latest_wins_update(spark, d):
    even = F.col("o_orderkey") % 2 == 0
    rows = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"), F.when(even, F.col("o_totalprice")).alias("price"), F.when(even, F.array(F.lit("status"), F.lit("price"))).otherwise(F.array(F.lit("status"))).alias("supplied"))
    return store.latest(rows, "o_custkey", ["o_orderdate", "o_orderkey"], ["status", "price"]).select("o_custkey", "status", "price")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (value IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (abs(100 - value) < 0.005) AS BIGINT) AS about_100 FROM events GROUP BY event_type")
def not_null_and_sum_checks(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.abs(100 - F.col("value")) < 0.005).alias("about_100"))


@query("SELECT page_id, CAST(CASE WHEN NOT (url LIKE '%.html' OR url LIKE '%7%') THEN 400 WHEN length(html) > 4000 THEN 413 ELSE 200 END AS INTEGER) AS code FROM pages")
def mime_and_size_reject_codes(spark, d):
    mime = F.when(F.col("url").like("%.html") | F.col("url").like("%7%"), "image/png").otherwise("text/plain")
    size = F.when(F.length("html") > 4000, store.MAX_UPLOAD + 1).otherwise(F.lit(0))
    return table(spark, d, "pages").select("page_id", store.upload_code(mime, size).alias("code"))


def _report_sql() -> str:
    values = {
        "number": "upper(md5(CAST(event_id AS VARCHAR)))", "generated": "strftime(ts, '%Y-%m-%d %H:%M')", "system": _quoted(SYSTEM), "condition": "final_condition", "confidence": "printf('%.1f', final_confidence)",
        "urgency": "upper(urgency_level)", "selected": "selected_model", "precautions": f"'• ' || {_told_sql('final_condition', PRECAUTIONS, DEFAULT_PRECAUTIONS, chr(10) + '• ')}",
    }
    for m in ("cnn", "resnet"):
        values |= {f"{m}_condition": f"coalesce({m}_primary_condition, 'N/A')", f"{m}_confidence": f"coalesce(CAST({m}_confidence AS VARCHAR), 'N/A')"}
    text = _quoted(TEMPLATE)
    for k, v in values.items():
        text = text.replace("{" + k + "}", f"' || ({v}) || '")
    return f"{_RECORD} SELECT event_id, {text} AS content FROM r"


@query(_report_sql())
def report_text(spark, d):
    return records(table(spark, d, "events").select("event_id", "ts")).select("event_id", report(F.md5(F.col("event_id").cast("string")), F.col("ts")).alias("content"))


@query("SELECT c_custkey, upper(substr(array_to_string(list_transform(string_split(replace(c_name, '#', ' '), ' '), lambda w: substr(w, 1, 1)), ''), 1, 2)) AS initials, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ResNet50' ELSE c_mktsegment END AS shown FROM customer")
def display_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", views.initials(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("initials"), F.when(F.col("c_mktsegment") == "BUILDING", "ResNet50").otherwise(F.col("c_mktsegment")).alias("shown"))


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '…' ELSE text END AS short, upper(substr(lang, 1, 1)) || substr(lang, 2) AS label FROM documents")
def display_strings(spark, d):
    return table(spark, d, "documents").select("doc_id", views.ellipsis(F.col("text")).alias("short"), F.initcap("lang").alias("label"))


@query("SELECT event_id, strftime(ts, '%b %-d, %Y') AS shown FROM events")
def display_dates(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "MMM d, yyyy").alias("shown"))


@query(
    f"""{SCORED}, t AS {_TOP.format('full_s')}, a AS (SELECT s.id, s.cls, CAST(printf('%.2f', s.p * 100) AS DOUBLE) AS pct FROM full_s s JOIN t ON s.id = t.id AND s.cls <> t.cls),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pct DESC, cls) AS rk FROM a), b AS (SELECT id, string_agg(cls || ' (' || printf('%.1f', pct) || '%)', ', ' ORDER BY rk) AS alternatives FROM r WHERE rk <= 2 GROUP BY id)
    SELECT id AS vec_id, CAST(cls AS VARCHAR) AS condition, CAST(printf('%.2f', p * 100) AS DOUBLE) AS confidence, 'routine' AS urgency, alternatives FROM t JOIN b USING (id)"""
)
def triaged_rows(spark, d):
    """What the landing stream makes of scored rows. Their classes are numbers, which are never urgent."""
    out = triaged(scored(spark, d))
    return out.select("vec_id", "condition", "confidence", "urgency", F.array_join("alternatives", ", ").alias("alternatives"))
