"""Queries: collocations, probability distributions, concordances and contexts, edit distance, BLEU."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions import text as T
from ..functions.arrow import arrow_function
from ..operators import collocations as C
from ..operators import counts, explore, freqdist, probability
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


K = f"WITH k AS ({S.toks()})"
_BI = f"""{K}, g AS ({S.pairs(2)}), c AS (SELECT l, r, count(*)::DOUBLE AS n FROM g GROUP BY ALL), f AS (SELECT w, count(*)::DOUBLE AS n FROM (SELECT unnest(t) AS w FROM k) GROUP BY w),
m AS (SELECT l AS w1, r AS w2, c.n AS n, a.n AS x, b.n AS y, (SELECT sum(n) FROM f) AS z FROM c JOIN f a ON a.w = l JOIN f b ON b.w = r),
q AS (SELECT *, n AS ii, y - n AS oi, x - n AS io, z - n - (y - n) - (x - n) AS oo FROM m)"""
_E = "1e-20"
#: Added before rounding, so that no fraction lies on the border between two rounded values.
OFF = 1.234567e-6
_BI_SCORES = {
    "raw_freq": "n / z",
    "student_t": f"(n - x * y / z) / sqrt(n + {_E})",
    "mi_like": "n ** 3 / (x * y)",
    "pmi": "log2(n * z) - log2(x * y)",
    "likelihood_ratio": "2 * (" + " + ".join(f"{c} * ln({c} / ({e} + {_E}) + {_E})" for c, e in (("ii", "x * y / z"), ("oi", "(z - x) * y / z"), ("io", "x * (z - y) / z"), ("oo", "(z - x) * (z - y) / z"))) + ")",
    "poisson_stirling": "n * (log2(n / (x * y / z)) - 1)",
    "jaccard": "ii / (ii + oi + io)",
    "phi_sq": "(ii * oo - io * oi) ** 2 / ((ii + io) * (ii + oi) * (io + oo) * (oi + oo))",
    "chi_sq": "z * (ii * oo - io * oi) ** 2 / ((ii + io) * (ii + oi) * (io + oo) * (oi + oo))",
    "dice": "2 * ii / (x + y)",
}


def _excess(c: C.Cells):
    """A measure of the caller's own: what is seen beyond what is expected, by the size of its words."""
    return (c.n - c.product() / c.total) / F.sqrt(c.product())


def _signif(spark_col, digits: int = 6):
    return F.round(spark_col, digits)


query(f"{_BI} SELECT w1, w2, " + ", ".join(f"round({e} + {OFF}, 4) AS {n}" for n, e in _BI_SCORES.items()) + " FROM q", "bigram_measures")(
    lambda s, d: C.marginals(C.finder(_docs(s, d), 2)).select("w1", "w2", *(F.round(m(C.Cells(2)) + OFF, 4).alias(n) for n, m in C.MEASURES.items()))
)


def _patterns_sql(size: int, window: int) -> str:
    """CTEs f (words) and one for each pattern, with the finder's weights."""
    parts = [f"f AS (SELECT w, count(*)::DOUBLE * {C.comb(window - 1, size - 1)} AS n FROM (SELECT unnest(t) AS w FROM k) GROUP BY w)"]
    for pattern in C.PATTERNS[size]:
        name = "p" + "".join(map(str, pattern))
        rows = [
            f"SELECT {', '.join(f't[i + {g}] AS w{j + 1}' for j, g in enumerate(gaps))}, {weight} AS k FROM (SELECT t, unnest(range(1, len(t) - {gaps[-1]} + 1)) AS i FROM k)"
            for gaps, weight in C._weights(size, window, pattern).items()
        ]
        keys = ", ".join(f"w{j + 1}" for j in range(len(pattern)))
        parts.append(f"{name} AS (SELECT {keys}, sum(k)::DOUBLE AS n FROM ({' UNION ALL '.join(rows)}) GROUP BY {keys})")
    return ", ".join(parts)


def _marginals_sql(size: int) -> str:
    from itertools import combinations

    cols, joins = [], []
    for r in range(1, size):
        for place in combinations(range(size), r):
            name = "m_" + "".join(map(str, place))
            if r == 1:
                source, on = "f", f"{name}.w = c.w{place[0] + 1}"
            else:
                source = "p" + "".join(str(p - place[0]) for p in place)
                on = " AND ".join(f"{name}.w{j + 1} = c.w{p + 1}" for j, p in enumerate(place))
            cols.append(f"coalesce({name}.n, 0) AS {name}")
            joins.append(f"LEFT JOIN {source} {name} ON {on}")
    full = "p" + "".join(map(str, range(size)))
    return f"SELECT c.*, {', '.join(cols)}, (SELECT sum(n) FROM f) AS z FROM {full} c {' '.join(joins)}"


def _many_scores(size: int) -> str:
    singles = " * ".join(f"m_{i}" for i in range(size))
    zz = " * ".join(["z"] * (size - 1))
    scores = {
        "raw_freq": "n / z",
        "student_t": f"(n - {singles} / ({zz})) / sqrt(n + {_E})",
        "mi_like": f"n ** 3 / ({singles})",
        "pmi": f"log2(n * ({zz})) - log2({singles})",
        "poisson_stirling": f"n * (log2(n / ({singles} / ({zz}))) - 1)",
    }
    return ", ".join(f"round({e} + {OFF}, 4) AS {n}" for n, e in scores.items())


def _measures(size: int, window: int):
    def run(s, d):
        m = C.marginals(C.finder(_docs(s, d), size, window))
        names = ("raw_freq", "student_t", "mi_like", "pmi", "poisson_stirling")
        return m.select(*(f"w{i + 1}" for i in range(size)), *(F.round(C.MEASURES[n](C.Cells(size)) + OFF, 4).alias(n) for n in names))

    return run


for _size, _window, _name in ((3, 3, "trigram_measures"), (3, 4, "trigram_measures_w4"), (4, 4, "quadgram_measures")):
    query(f"{K}, {_patterns_sql(_size, _window)}, q AS ({_marginals_sql(_size)}) SELECT {', '.join(f'w{i + 1}' for i in range(_size))}, {_many_scores(_size)} FROM q", _name)(_measures(_size, _window))


def _cells_sql(size: int) -> tuple[str, str]:
    """likelihood_ratio and jaccard by inclusion and exclusion."""
    from itertools import combinations

    margin = lambda p: "n" if len(p) == size else "m_" + "".join(map(str, p)) if p else "z"
    total, near = [], ["n"]
    for r in range(size, -1, -1):
        for inside in combinations(range(size), r):
            rest = [i for i in range(size) if i not in inside]
            cell = margin(inside)
            for q in range(1, len(rest) + 1):
                for more in combinations(rest, q):
                    cell += (" - " if q % 2 else " + ") + margin(tuple(sorted((*inside, *more))))
            e = " * ".join(f"m_{i}" if i in inside else f"(z - m_{i})" for i in range(size)) + f" / ({' * '.join(['z'] * (size - 1))})"
            x = f"({cell}) / ({e} + {_E}) + {_E}"
            total.append(f"({cell}) * CASE WHEN {x} > 0 THEN ln({x}) END")
            if 0 < r < size:
                near.append(f"({cell})")
    return f"2 * ({' + '.join(total)})", f"n / ({' + '.join(near)})"


def _likelihood(size: int):
    def run(s, d):
        m = C.marginals(C.finder(_docs(s, d), size))
        return m.select(*(f"w{i + 1}" for i in range(size)), F.round(C.likelihood_ratio(C.Cells(size)) + OFF, 2).alias("likelihood_ratio"), F.round(C.jaccard(C.Cells(size)) + OFF, 4).alias("jaccard"))

    return run


# cells are negative where a document's end leaves a pattern without its last words; such an n-gram has no ratio
for _size, _name in ((3, "trigram_likelihood"), (4, "quadgram_likelihood")):
    _lr, _ja = _cells_sql(_size)
    query(f"{K}, {_patterns_sql(_size, _size)}, q AS MATERIALIZED ({_marginals_sql(_size)}) SELECT {', '.join(f'w{i + 1}' for i in range(_size))}, round({_lr} + {OFF}, 2) AS likelihood_ratio, round({_ja} + {OFF}, 4) AS jaccard FROM q", _name)(_likelihood(_size))

for _size in (3, 4):
    _lr = _cells_sql(_size)[0]
    _keys = ", ".join(f"w{i + 1}" for i in range(_size))
    query(
        f"{K}, {_patterns_sql(_size, _size)}, q AS MATERIALIZED ({_marginals_sql(_size)}), s AS (SELECT {_keys}, round({_lr}, 4) AS score FROM q WHERE n >= 3) SELECT {_keys}, score FROM s WHERE score IS NOT NULL ORDER BY score DESC, {_keys} LIMIT 50",
        f"{'tri' if _size == 3 else 'quad'}gram_nbest",
    )(lambda s, d, size=_size: C.nbest(C.finder(_docs(s, d), size).with_freq(3), "likelihood_ratio", 50, 4))

_RANK = "ORDER BY score DESC, w1, w2"
query(f"{_BI}, s AS (SELECT w1, w2, round({_BI_SCORES['likelihood_ratio']}, 6) AS score FROM q WHERE n >= 3) SELECT w1, w2, score FROM s {_RANK} LIMIT 100", "bigram_nbest")(
    lambda s, d: C.nbest(C.finder(_docs(s, d), 2).with_freq(3), "likelihood_ratio", 100, 6)
)
query(f"{_BI}, s AS (SELECT w1, w2, round({_BI_SCORES['pmi']}, 6) AS score FROM q WHERE n >= 2) SELECT w1, w2, score FROM s WHERE score > 8", "bigram_above_score")(
    lambda s, d: C.above(C.finder(_docs(s, d), 2).with_freq(2), "pmi", 8.0, 6)
)
query(f"{_BI}, s AS (SELECT w1, w2, round({_BI_SCORES['dice']}, 6) AS score FROM q WHERE NOT (length(w1) < 3 OR length(w2) < 3) AND NOT (w1 = w2)) SELECT w1, w2, score FROM s", "bigram_filtered")(
    lambda s, d: C.score(C.finder(_docs(s, d), 2).without_words(lambda w: F.length(w) < 3).without_ngrams(lambda a, b: a == b), "dice", 6)
)
query(f"{_BI}, s AS (SELECT w1, w2, round((n - x * y / z) / sqrt(x * y), 9) AS score FROM q WHERE n >= 2) SELECT w1, w2, score FROM s", "bigram_own_measure")(
    lambda s, d: C.score(C.finder(_docs(s, d), 2).with_freq(2), _excess, 9)
)
_CSTOP = ", ".join(f"'{w}'" for w in C.COLLOCATION_STOP)
query(
    f"{_BI}, s AS (SELECT w1, w2, round({_BI_SCORES['likelihood_ratio']}, 9) AS score FROM q WHERE n >= 2 AND length(w1) > 2 AND length(w2) > 2 AND w1 NOT IN ({_CSTOP}) AND w2 NOT IN ({_CSTOP})) SELECT w1, w2, round(score, 6) AS score FROM s {_RANK} LIMIT 20",
    "text_collocations",
)(lambda s, d: C.text_collocations(_docs(s, d)).withColumn("score", F.round("score", 6)))
_W3 = f"""{K}, g AS ({S.pairs(3)}), c AS (SELECT l, r, count(*)::DOUBLE / 2 AS n FROM g GROUP BY ALL), f AS (SELECT w, count(*)::DOUBLE AS n FROM (SELECT unnest(t) AS w FROM k) GROUP BY w)
SELECT l AS w1, r AS w2, round(log2(c.n * (SELECT sum(n) FROM f)) - log2(a.n * b.n), 6) AS score FROM c JOIN f a ON a.w = l JOIN f b ON b.w = r"""
query(_W3, "bigram_pmi_window3")(lambda s, d: C.score(C.finder(_docs(s, d), 2, 3), "pmi", 6))

# probability distributions by language

_L = f"WITH k AS ({S.toks(key='lang')}), f AS (SELECT lang AS condition, sample, count(*) AS n FROM (SELECT lang, unnest(t) AS sample FROM k) GROUP BY ALL), s AS (SELECT *, sum(n) OVER w AS nn, count(*) OVER w AS b FROM f WINDOW w AS (PARTITION BY condition))"


def _by_lang(spark, d) -> DataFrame:
    rows = _docs(spark, d).select(F.col("lang").alias("condition"), F.explode(T.ascii_tokens("text")).alias("sample"))
    return freqdist.build(rows, ["condition", "sample"])


def _prob(make, expr: str, name: str) -> None:
    query(f"{_L} SELECT condition, sample, round({expr}, 9) AS prob, round(log2({expr}), 6) AS logprob FROM s", name)(
        lambda s, d: make(_by_lang(s, d)).select("condition", "sample", F.round("prob", 9).alias("prob"), F.round("logprob", 6).alias("logprob"))
    )


_BY = ["condition"]
_prob(lambda f: probability.mle(f, _BY), "n / nn::DOUBLE", "prob_mle")
_prob(lambda f: probability.lidstone(f, 0.1, 1_000_000, _BY, strict=False), "(n + 0.1::DOUBLE) / (nn::DOUBLE + 1000000 * 0.1::DOUBLE)", "prob_lidstone")
_prob(lambda f: probability.laplace(f, None, _BY), "(n + 1) / (nn + b)::DOUBLE", "prob_laplace")
_prob(lambda f: probability.ele(f, None, _BY), "(n + 0.5::DOUBLE) / (nn::DOUBLE + b * 0.5::DOUBLE)", "prob_ele")
_prob(lambda f: probability.witten_bell(f, None, _BY), "n / (nn + b)::DOUBLE", "prob_witten_bell")
query(f"{_L} SELECT condition, round(-sum(n / nn::DOUBLE * log2(n / nn::DOUBLE)), 6) AS entropy FROM s GROUP BY condition", "entropy_by_lang")(
    lambda s, d: probability.entropy(probability.mle(_by_lang(s, d), _BY), _BY).withColumn("entropy", F.round("entropy", 6))
)


def _one(spark, d, lang: str) -> DataFrame:
    return probability.mle(_by_lang(spark, d).filter(F.col("condition") == lang).drop("condition"))


query(
    f"{_L}, a AS (SELECT * FROM s WHERE condition = 'en'), b AS (SELECT * FROM s WHERE condition = 'fr') SELECT round(sum(a.n / a.nn::DOUBLE * log2(greatest(coalesce(b.n / b.nn::DOUBLE, 0), 5e-324::DOUBLE))), 4) AS log_likelihood FROM a LEFT JOIN b ON a.sample = b.sample",
    "cross_entropy",
)(lambda s, d: probability.log_likelihood(_one(s, d, "en"), _one(s, d, "fr")).withColumn("log_likelihood", F.round("log_likelihood", 4)))
query(f"{K}, f AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM k) GROUP BY w), q AS (SELECT sum(n)::DOUBLE AS nn, count(*)::DOUBLE AS t FROM f) SELECT round(t / ((1000000 - t) * (nn + t)), 15) AS prob FROM q", "prob_witten_bell_unseen")(
    lambda s, d: probability.witten_bell_unseen(counts.token_freq(_docs(s, d)), 1_000_000).withColumn("prob", F.round("prob", 15))
)
_GT = f"""{K}, f AS (SELECT sample, count(*) AS n FROM (SELECT unnest(t) AS sample FROM k) GROUP BY sample), c AS (SELECT n::DOUBLE AS r, count(*)::DOUBLE AS nr FROM f GROUP BY n),
z AS (SELECT r, nr, lead(r) OVER o AS later, 2 * nr / (coalesce(lead(r) OVER o, 2 * r - lag(r, 1, 0) OVER o) - lag(r, 1, 0) OVER o) AS z FROM c WINDOW o AS (ORDER BY r)),
l AS (SELECT coalesce(regr_slope(ln(z), ln(r)), 0) AS b, avg(ln(z)) - coalesce(regr_slope(ln(z), ln(r)), 0) * avg(ln(r)) AS a, sum(r * nr) AS total FROM z),
y AS (SELECT z.*, a, b, total, exp(a + b * ln(z.r)) AS here, exp(a + b * ln(z.r + 1)) AS up, n1.nr AS up_nr FROM z CROSS JOIN l LEFT JOIN c n1 ON n1.r = z.r + 1),
w AS (SELECT min(r) AS switch FROM y WHERE later IS NULL OR later <> r + 1 OR abs((r + 1) * up_nr / nr - (r + 1) * up / here) <= 1.96::DOUBLE * sqrt((r + 1) ** 2 * (up_nr / nr ** 2) * (1 + up_nr / nr))),
x AS (SELECT r, nr, total, (r + 1) * (CASE WHEN r + 1 < switch AND up_nr IS NOT NULL THEN up_nr ELSE up END) / (CASE WHEN r < switch THEN nr ELSE here END) / total AS star FROM y CROSS JOIN w),
p AS (SELECT r, star * (1 - coalesce((SELECT nr FROM c WHERE r = 1), 0) / total) / (SELECT sum(nr * star) FROM x) AS prob FROM x)
SELECT sample, f.n, round(prob, 12) AS prob, round(log2(prob), 6) AS logprob FROM f JOIN p ON p.r = f.n"""
query(_GT, "prob_good_turing")(
    lambda s, d: probability.good_turing_seen(counts.token_freq(_docs(s, d)).withColumnRenamed("token", "sample")).withColumns({"prob": F.round("prob", 12), "logprob": F.round("logprob", 6)})
)
query(f"{_L}, p AS (SELECT DISTINCT sample FROM s) SELECT sample, 1 / (SELECT count(*) FROM p)::DOUBLE AS prob FROM p", "prob_uniform")(lambda s, d: probability.uniform(_by_lang(s, d).select("sample")))

query(f"{_L} SELECT condition, sample, round((n + 0.25::DOUBLE) / (nn::DOUBLE + b * 0.25::DOUBLE), 9) AS prob FROM s", "prob_own_factory")(
    lambda s, d: probability.conditional(_by_lang(s, d), lambda fd, by: probability.lidstone(fd, 0.25, None, by)).select("condition", "sample", F.round("prob", 9).alias("prob"))
)
_SHARE = f"{K}, f AS (SELECT sample, count(*) AS n FROM (SELECT unnest(t) AS sample FROM k) GROUP BY sample)"
query(f"{_SHARE} SELECT sample, round(n / (SELECT sum(n) FROM f)::DOUBLE, 12) AS prob, round(log2(n / (SELECT sum(n) FROM f)::DOUBLE), 6) AS logprob FROM f", "prob_dictionary")(
    lambda s, d: probability.from_dictionary(counts.token_freq(_docs(s, d)).select(F.col("token").alias("sample"), F.col("n").alias("p")), normalize=True).select("sample", F.round("prob", 12).alias("prob"), F.round("logprob", 6).alias("logprob"))
)
query(
    f"{_L}, a AS (SELECT * FROM s WHERE condition = 'en'), b AS (SELECT * FROM s WHERE condition = 'fr') SELECT coalesce(b.sample, a.sample) AS sample, round(coalesce(b.n / b.nn::DOUBLE, a.n / a.nn::DOUBLE), 12) AS prob FROM a FULL JOIN b ON a.sample = b.sample",
    "prob_mutable",
)(lambda s, d: probability.mutable(_one(s, d, "en"), _one(s, d, "fr")).withColumn("prob", F.round("prob", 12)))
query(f"{_SHARE} SELECT round(0.1::DOUBLE * 1000000 / (sum(n)::DOUBLE + 0.1::DOUBLE * 1000000), 12) AS discount FROM f", "prob_lidstone_discount")(
    lambda s, d: probability.lidstone_discount(counts.token_freq(_docs(s, d)), 0.1, 1_000_000).withColumn("discount", F.round("discount", 12))
)
query(f"{K} SELECT doc_id, round(log2(list_sum(list_transform(t, lambda x: pow(2::DOUBLE, -length(x))))), 6) AS log_sum FROM k WHERE len(t) > 0", "log_sum")(
    lambda s, d: _docs(s, d).select("doc_id", T.ascii_tokens("text").alias("t")).filter(F.size("t") > 0).select("doc_id", F.round(probability.log_sum(F.transform("t", lambda x: -F.length(x).cast("double"))), 6).alias("log_sum"))
)

# concordances and contexts

_CTX = f"{K}, x AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM k), c AS (SELECT t[i] AS word, CASE WHEN i = 1 THEN '*START*' ELSE t[i - 1] END AS l, CASE WHEN i = len(t) THEN '*END*' ELSE t[i + 1] END AS r, count(*) AS n FROM x GROUP BY ALL)"
query(f'{_CTX} SELECT word, l AS "left", r AS "right", n FROM c', "contexts")(lambda s, d: explore.contexts(_docs(s, d)))
query(f"{_CTX} SELECT b.word, sum(a.n * b.n)::BIGINT AS score FROM c a JOIN c b ON a.l = b.l AND a.r = b.r WHERE a.word = 'the' AND b.word <> 'the' GROUP BY b.word ORDER BY score DESC, b.word LIMIT 20", "similar_words")(
    lambda s, d: explore.similar_words(_docs(s, d), "the", 20)
)
query(f"""{_CTX} SELECT l AS "left", r AS "right", sum(n)::BIGINT AS n FROM c WHERE word IN ('the', 'of') GROUP BY l, r HAVING count(DISTINCT word) = 2""", "common_contexts")(
    lambda s, d: explore.common_contexts(_docs(s, d), ["the", "of"])
)
_CONC = f"""WITH k AS ({S.regex_tokens("[A-Za-z]+")}), p AS (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM k),
h AS (SELECT doc_id, i - 1 AS pos, t[greatest(1, i - 20):i - 1] AS a, t[i:i + 1] AS q, t[i + 2:i + 21] AS b FROM p WHERE lower(t[i]) = 'of' AND lower(t[i + 1]) = 'the'),
s AS (SELECT doc_id, pos, coalesce(array_to_string(a, ' '), '') AS a, array_to_string(q, ' ') AS query, coalesce(array_to_string(b, ' '), '') AS b, ((80 - length(array_to_string(q, ' ')) - 2) // 2)::BIGINT AS half FROM h),
u AS (SELECT doc_id, pos, right(a, half) AS l, query, left(b, half) AS r, half FROM s)
SELECT doc_id, pos, rtrim(repeat(' ', half - length(l)) || l || ' ' || query || ' ' || r) AS line FROM u"""
query(_CONC, "concordance")(lambda s, d: explore.concordance(_docs(s, d), ["of", "the"], 80, tokens=lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))).select("doc_id", "pos", "line"))

query(f"{_CONC} ORDER BY doc_id, pos LIMIT 25", "concordance_lines")(
    lambda s, d: explore.concordance(_docs(s, d), ["of", "the"], 80, 25, lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))).select("doc_id", "pos", "line")
)
query(f"{K}, x AS (SELECT t, unnest(range(1, len(t))) AS i FROM k) SELECT upper(t[i]) AS word, t[i + 1] AS context, count(*) AS n FROM x WHERE length(t[i]) > 3 GROUP BY ALL", "contexts_own")(
    lambda s, d: explore.contexts_by(_docs(s, d), lambda t, i: F.try_element_at(t, i + 1), keep=lambda w: F.length(w) > 3, key=F.upper)
)

# metrics

@query(None)
def edit_distance(spark, d):
    """Code points to change from each turn of a conversation to the next one."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("x"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", metrics.distance("x", "y").cast("long").alias("distance"))


def _bleu_sql() -> str:
    grams = lambda side, n: f"SELECT id, t[i:i + {n - 1}] AS g, count(*) AS c FROM (SELECT id, {side} AS t, unnest(range(1, len({side}) - {n - 2})) AS i FROM x) GROUP BY ALL"
    parts = [f"SELECT {n} AS n, (SELECT sum(greatest(0, len(h) - {n - 1})) FROM x) AS total, (SELECT coalesce(sum(least(a.c, b.c)), 0) FROM ({grams('h', n)}) a JOIN ({grams('r', n)}) b ON a.id = b.id AND a.g = b.g) AS clipped" for n in range(1, 5)]
    return f"""WITH c AS ({S.toks('conversations', 'conv_id, turn, role')}), x AS (SELECT row_number() OVER () AS id, a.t AS h, b.t AS r FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn WHERE a.role = 'assistant'),
o AS ({' UNION ALL '.join(parts)}), l AS (SELECT sum(len(h))::DOUBLE AS h, sum(len(r))::DOUBLE AS r FROM x)
SELECT round(CASE WHEN coalesce(h, 0) = 0 THEN 0 ELSE CASE WHEN h > r THEN 1 ELSE exp(1 - r / h) END * exp((SELECT sum(0.25::DOUBLE * ln((clipped + 1) / (total + 1)::DOUBLE)) FROM o)) END, 9) AS bleu FROM l"""


def _sentence_bleu_sql() -> str:
    """Scores of each pair, from clipped and total counts by order."""
    base = _bleu_sql()
    x = base[: base.index("\no AS (")].replace("row_number() OVER () AS id", "a.conv_id, a.turn, row_number() OVER () AS id")
    grams = lambda side, n: f"SELECT id, t[i:i + {n - 1}] AS g, count(*) AS c FROM (SELECT id, {side} AS t, unnest(range(1, len({side}) - {n - 2})) AS i FROM x) GROUP BY ALL"
    hits = [f"SELECT {n} AS n, a.id, sum(least(a.c, b.c)) AS c FROM ({grams('h', n)}) a JOIN ({grams('r', n)}) b ON a.id = b.id AND a.g = b.g GROUP BY a.id" for n in range(1, 5)]
    logs = " + ".join(f"0.25::DOUBLE * ln((coalesce(c{n}, 0) + 1) / (greatest(0, len(h) - {n - 1}) + 1)::DOUBLE)" for n in range(1, 5))
    wide = ", ".join(f"max(c) FILTER (WHERE n = {n}) AS c{n}" for n in range(1, 5))
    return f"""{x} y AS ({' UNION ALL '.join(hits)}), w AS (SELECT id, {wide} FROM y GROUP BY id)
SELECT conv_id, turn, round(CASE WHEN len(h) = 0 THEN 0 ELSE CASE WHEN len(h) > len(r) THEN 1 ELSE exp(1 - len(r) / len(h)::DOUBLE) END * exp({logs}) END, 9) AS bleu FROM x LEFT JOIN w ON w.id = x.id"""


@query(_sentence_bleu_sql())
def bleu_sentences(spark, d):
    """Each assistant turn against the turn before it, by itself."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", T.ascii_tokens("text").alias("t"))
    ref = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.array("t").alias("refs"))
    pairs = c.filter("role = 'assistant'").join(ref, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(arrow_function(metrics.sentence_bleu, "double")("refs", "t"), 9).alias("bleu"))


@query(_bleu_sql())
def bleu_corpus(spark, d):
    """Each assistant turn against the user turn before it."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", T.ascii_tokens("text").alias("t"))
    ref = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.array("t").alias("refs"))
    return metrics.corpus_bleu(c.filter("role = 'assistant'").join(ref, ["conv_id", "turn"]).select("refs", F.col("t").alias("hyp"))).withColumn("bleu", F.round("bleu", 9))
