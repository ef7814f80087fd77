"""Queries: vectorizer, classifiers and their measures. All labelled documents train, all documents are scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import learners
from ..sources import models
from ..sources.shared import fresh_path
from ..sources.tables import spread, table
from . import sql as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


def _docs(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _labelled(spark, d) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("toxic").cast("string").alias("label")), "doc_id")


def _scored(spark, d) -> DataFrame:
    """All documents, with the label of those that have one as gold."""
    gold = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("string").alias("gold"))
    return _docs(spark, d).select("doc_id", "text").join(gold, "doc_id", "left")


_NB = f"""WITH k AS ({S.toks(key='doc_id')}), l AS (SELECT doc_id, toxic::VARCHAR AS label FROM labels), tr AS (SELECT k.*, label FROM k JOIN l ON l.doc_id = k.doc_id), te AS (SELECT k.*, label FROM k LEFT JOIN l ON l.doc_id = k.doc_id),
w AS (SELECT label, token, count(*)::DOUBLE AS n FROM (SELECT label, unnest(t) AS token FROM tr) GROUP BY ALL), v AS (SELECT DISTINCT token FROM w),
c AS (SELECT label, count(*)::DOUBLE AS docs, (SELECT sum(n) FROM w WHERE w.label = tr.label) AS tokens FROM tr GROUP BY label),
z AS (SELECT sum(docs) AS d, count(*)::DOUBLE AS l, (SELECT count(*)::DOUBLE FROM v) AS v FROM c),
p AS (SELECT doc_id, token, count(*)::DOUBLE AS k FROM (SELECT doc_id, unnest(t) AS token FROM te) WHERE token IN (SELECT token FROM v) GROUP BY ALL),
g AS (SELECT te.doc_id, c.label, ln((docs + 1) / (d + l)) AS prior, tokens, z.v AS v FROM te CROSS JOIN c CROSS JOIN z),
s AS (SELECT g.doc_id, g.label, any_value(prior) + coalesce(sum(p.k * ln((coalesce(w.n, 0) + 1) / (tokens + g.v))), 0) AS score FROM g LEFT JOIN p ON p.doc_id = g.doc_id LEFT JOIN w ON w.label = g.label AND w.token = p.token GROUP BY g.doc_id, g.label)"""

query(f"{_NB} SELECT doc_id, label, round(score, 4) AS log_score FROM s", "nb_scores")(lambda s, d: learners.NaiveBayes.train(_labelled(s, d)).scores(_scored(s, d)).withColumn("log_score", F.round("log_score", 4)))


@query(SQL["nb_scores"])
def nb_saved_scores(spark, d):
    """Scores of a model that was written to the shared folder and read again."""
    path = fresh_path(spark, "naive-bayes")
    models.save(spark, learners.NaiveBayes.train(_labelled(spark, d)), path)
    return models.load(spark, learners.NaiveBayes, path).scores(_scored(spark, d)).withColumn("log_score", F.round("log_score", 4))


_BEST = f"{_NB}, b AS (SELECT doc_id, arg_max(label, round(score, 9)) AS pred FROM s GROUP BY doc_id), y AS (SELECT te.label AS gold, b.pred FROM te JOIN b ON b.doc_id = te.doc_id WHERE te.label IS NOT NULL)"


def _nb(spark, d) -> DataFrame:
    """gold and pred of the labelled documents."""
    rows = _labelled(spark, d)
    pred = learners.NaiveBayes.train(rows).predict(rows.drop("label")).select("doc_id", F.col("label").alias("pred"))
    return rows.select("doc_id", F.col("label").alias("gold")).join(pred, "doc_id")


query(f"{_BEST} SELECT count(*) AS total, count(*) FILTER (WHERE gold = pred) AS correct, round(avg((gold = pred)::INT), 9) AS accuracy FROM y", "nb_accuracy")(lambda s, d: metrics.accuracy(_nb(s, d)).withColumn("accuracy", F.round("accuracy", 9)))
query(f"{_BEST}, l2 AS (SELECT gold AS x FROM y UNION SELECT pred FROM y) SELECT a.x AS gold, b.x AS pred, count(y.gold) AS n FROM l2 a CROSS JOIN l2 b LEFT JOIN y ON y.gold = a.x AND y.pred = b.x GROUP BY a.x, b.x", "confusion_matrix")(lambda s, d: metrics.confusion(_nb(s, d)))
query(f"{_NB} SELECT label, token, n::BIGINT AS n FROM w", "nb_train")(lambda s, d: learners.NaiveBayes.train(_labelled(s, d)).words)
query(f"{_NB}, e AS (SELECT doc_id, label, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM s) SELECT doc_id, label, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS prob FROM e", "nb_probabilities")(
    lambda s, d: learners.probabilities(learners.NaiveBayes.train(_labelled(s, d)).scores(_scored(s, d))).withColumn("prob", F.round("prob", 6))
)

#: The operators' default number of features.
_FEATURES = learners.Vectorizer().max_features
_VOC = f"WITH k AS ({S.toks()}), f AS (SELECT feature, count(*) AS n FROM (SELECT unnest(t) AS feature FROM k) GROUP BY feature ORDER BY n DESC, feature LIMIT {_FEATURES}), v AS (SELECT row_number() OVER (ORDER BY n DESC, feature) - 1 AS id, feature, n FROM f)"
query(f"{_VOC} SELECT id, feature, n FROM v", "vectorizer_vocab")(lambda s, d: learners.Vectorizer().table(_docs(s, d)))


@query(f"{_VOC} SELECT doc_id, v.id AS feature_id, count(*)::DOUBLE AS value FROM (SELECT doc_id, unnest(t) AS w FROM k) JOIN v ON v.feature = w GROUP BY doc_id, v.id")
def vectorizer_transform(spark, d):
    docs = _docs(spark, d)
    return learners.coordinates(docs, learners.Vectorizer().fit(docs))


_LIN = f"""{_VOC}, x AS (SELECT doc_id, v.id AS f, count(*)::DOUBLE AS value FROM (SELECT doc_id, unnest(t) AS w FROM k) JOIN v ON v.feature = w GROUP BY doc_id, v.id),
c AS (SELECT unnest([0, 1, 2]) AS class) SELECT doc_id, class, round(class * 0.5::DOUBLE + sum(value * (((f * 7 + class * 13) % 11) / 10.0::DOUBLE - 0.5::DOUBLE)), 6) + 0.0 AS score FROM x CROSS JOIN c GROUP BY doc_id, class"""


@query(_LIN)
def linear_scores(spark, d):
    docs = _docs(spark, d)
    rows = learners.coordinates(docs, learners.Vectorizer().fit(docs))
    classes = spark.range(3).select(F.col("id").cast("int").alias("class"))
    weights = spark.range(_FEATURES).select(F.col("id").cast("int").alias("feature_id")).crossJoin(classes)
    weights = weights.withColumn("w", ((F.col("feature_id") * 7 + F.col("class") * 13) % 11) / 10 - 0.5)
    return learners.linear_scores(rows, weights, classes.withColumn("bias", F.col("class") * 0.5)).withColumn("score", F.round("score", 6) + F.lit(0.0))


_PU = f"""WITH k AS ({S.toks()}), l AS (SELECT doc_id, toxic FROM labels), pos AS (SELECT list_distinct(t) AS t FROM k JOIN l ON l.doc_id = k.doc_id WHERE toxic = 1), un AS (SELECT list_distinct(t) AS t FROM k),
a AS (SELECT w, count(*) AS c FROM (SELECT unnest(t) AS w FROM pos) GROUP BY w), b AS (SELECT w, count(*) AS u FROM (SELECT unnest(t) AS w FROM un) GROUP BY w),
m AS (SELECT coalesce(a.w, b.w) AS w, coalesce(c, 0) AS c, coalesce(u, 0) AS u FROM a FULL JOIN b ON a.w = b.w), n AS (SELECT * FROM m ORDER BY c + u DESC, w LIMIT {_FEATURES}),
q AS (SELECT w, (c + 1) / ((SELECT count(*) FROM pos) + 2)::DOUBLE AS p, (u + 1) / ((SELECT count(*) FROM un) + 2)::DOUBLE AS g FROM n),
r AS (SELECT w, p, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, (g - 0.2::DOUBLE * p) / 0.8::DOUBLE)) AS g FROM q), h AS (SELECT w, ln(p / g) AS here, ln((1 - p) / (1 - g)) AS gone FROM r),
e AS (SELECT doc_id, unnest(list_distinct(t)) AS w FROM k), o AS (SELECT doc_id, sum(here - gone) AS s FROM e JOIN h ON h.w = e.w GROUP BY doc_id),
z AS (SELECT k.doc_id, coalesce(o.s, 0) + (SELECT sum(gone) FROM h) + ln(0.2::DOUBLE / 0.8::DOUBLE) AS z FROM k LEFT JOIN o ON o.doc_id = k.doc_id)
SELECT doc_id, round(z, 4) AS odds FROM z"""


@query(_PU)
def positive_nb_scores(spark, d):
    docs = _docs(spark, d)
    pos = _labelled(spark, d).filter("label = '1'")
    return learners.PositiveNaiveBayes.train(pos, docs, 0.2).odds(docs).withColumn("odds", F.round("odds", 4))


def _predicted(train, name: str) -> None:
    query(None, name)(lambda s, d: train(_labelled(s, d)).predict(_scored(s, d)).select("doc_id", "gold", "label"))


_predicted(learners.train_logistic, "logistic_predict")
_predicted(learners.train_svm, "svm_predict")
_predicted(learners.train_maxent, "maxent_predict")
_predicted(learners.train_conditional_exponential, "conditional_exponential_predict")
_predicted(learners.train_perceptron, "perceptron_predict")
_predicted(learners.DecisionTree.train, "decision_tree_predict")


_plain = lambda x: f"trim(regexp_replace(lower(coalesce(({x})::VARCHAR, 'null')), '[^a-z0-9'']+', ' ', 'g'))"
_PAIRS = ", ".join(f"CASE WHEN {_plain(x)} <> '' THEN 'feature {k} value ' || {_plain(x)} END" for k, x in (("lang", "lang"), ("long", "n_chars > 2000"), ("source", "source")))
_DICT = _NB.replace(S.toks(key="doc_id"), f"SELECT doc_id, regexp_extract_all(concat_ws(' ', {_PAIRS}), '[a-z0-9'']+') AS t FROM documents").replace("toxic::VARCHAR", "quality::VARCHAR")


@query(f"{_DICT}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, label) AS place FROM s) SELECT doc_id, label, round(log_score, 6) AS log_score FROM (SELECT doc_id, label, score AS log_score FROM o WHERE place = 1)")
def feature_dict_predict(spark, d):
    """Naive Bayes on dictionaries of features."""
    f = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("long"), (F.col("n_chars") > 2000).cast("string"))
    docs = table(spark, d, "documents").select("doc_id", learners.feature_text(f).alias("text"))
    rows = docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id")
    return learners.NaiveBayes.train(rows).predict(docs).withColumn("log_score", F.round("log_score", 6))
