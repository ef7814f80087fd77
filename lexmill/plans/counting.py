"""Queries: tokens, n-grams, frequency distributions, tokenizers, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stem, words
from ..functions import text as T
from ..operators import counts, freqdist
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


@query(f"""{K}, w AS (SELECT unnest(t) AS w FROM k), g AS ({S.pairs(2)})
SELECT (SELECT count(*) FROM w) AS token_count, (SELECT count(DISTINCT w) FROM w) AS unique_token_count,
(SELECT count(*) FROM g) AS ngram_count, (SELECT count(*) FROM (SELECT DISTINCT l, r FROM g)) AS unique_ngram_count""")
def token_metrics(spark, d):
    return counts.metrics(_docs(spark, d), 2)


@query(f"{K} SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM k) GROUP BY token")
def token_freq(spark, d):
    return counts.token_freq(_docs(spark, d))


@query(f"{K}, f AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM k) GROUP BY token) SELECT lpad(upper(to_hex(({S.fnv('token')})::UBIGINT)), 16, '0') AS hash, n FROM f")
def token_freq_hash(spark, d):
    return counts.hashed_freq(counts.token_freq(_docs(spark, d)))


@query(f"{K} SELECT array_to_string(t[i:i + 2], ' ') AS gram, count(*) AS n FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM k) GROUP BY 1")
def ngram_freq_3(spark, d):
    return counts.ngram_freq(_docs(spark, d), 3)


@query(
    f"{K}, f AS (SELECT l, r, count(*) AS n FROM ({S.pairs(2)}) GROUP BY ALL), h AS (SELECT l, ({S.fnv('l')}) AS h FROM (SELECT DISTINCT l FROM (SELECT l FROM f UNION SELECT r FROM f))) "
    f"SELECT lpad(upper(to_hex((list_reduce([14695981039346656037::HUGEINT, 2::HUGEINT, a.h, b.h], lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT))::UBIGINT)), 16, '0') AS hash, n "
    "FROM f JOIN h a ON a.l = f.l JOIN h b ON b.l = f.r"
)
def ngram_freq_hash(spark, d):
    return counts.hashed_ngram_freq(_docs(spark, d), 2)


@query(f"""{K}, e AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM k), f AS (SELECT t, i, unnest(range(1, least(3, len(t) - i + 1) + 1)) AS s FROM e)
SELECT array_to_string(t[i:i + s - 1], ' ') AS gram, count(*) AS n FROM f GROUP BY 1""")
def everygram_counts(spark, d):
    return counts.gram_freq(_docs(spark, d), [range(n) for n in range(1, 4)])


@query(f"{K}, g AS ({S.pairs(4)}) SELECT l || ' ' || r AS gram, count(*) AS n FROM g GROUP BY 1")
def skipgram_counts(spark, d):
    return counts.gram_freq(_docs(spark, d), [(0, k) for k in range(1, 4)])


@query(f"""{K}, p AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM k), f AS (SELECT token, count(*) AS n, min((doc_id, i)) AS first FROM p GROUP BY token)
SELECT row_number() OVER (ORDER BY first) - 1 AS id, token, n FROM f""")
def token_ids(spark, d):
    return counts.token_ids(_docs(spark, d))


def _stats_sql(w: int) -> str:
    return f"""{K}, g AS ({S.pairs(w)}), c AS (SELECT l, r, count(*) AS n FROM g GROUP BY ALL), f AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM k) GROUP BY w)
SELECT l, r, c.n AS n, round(log2(c.n::DOUBLE * (SELECT sum(n) FROM f) / (a.n::DOUBLE * b.n * {w - 1})), 6) AS pmi FROM c JOIN f a ON a.w = l JOIN f b ON b.w = r"""


for _w in (2, 3, 5):
    query(_stats_sql(_w), f"bigram_window_stats_w{_w}")(lambda spark, d, w=_w: counts.window_stats(_docs(spark, d), w).withColumn("pmi", F.round("pmi", 6)))


@query(
    f"""{K}, g AS ({S.pairs(2)}), c AS (SELECT l, r, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 5), f AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM k) GROUP BY w),
s AS (SELECT l, r, c.n AS n, round(log2(c.n::DOUBLE * (SELECT sum(n) FROM f) / (a.n::DOUBLE * b.n)), 9) AS pmi FROM c JOIN f a ON a.w = l JOIN f b ON b.w = r)
SELECT l, r, n, pmi FROM s ORDER BY pmi DESC, {S.fnv('l')}, {S.fnv('r')} LIMIT 50"""
)
def top_pmi_bigrams(spark, d):
    return counts.top_pmi(_docs(spark, d), 50, 2, 5)


# frequency distributions: English against French


def _fd(spark, d, lang: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("lang") == lang)
    return counts.token_freq(spread(docs)).withColumnRenamed("token", "sample")


_AB = f"WITH x AS ({S.toks(where="WHERE lang = 'en'")}), y AS ({S.toks(where="WHERE lang = 'fr'")}), a AS (SELECT sample, count(*) AS n FROM (SELECT unnest(t) AS sample FROM x) GROUP BY 1), b AS (SELECT sample, count(*) AS n FROM (SELECT unnest(t) AS sample FROM y) GROUP BY 1)"
_BOTH = "coalesce(a.sample, b.sample) AS sample"
query(f"{_AB} SELECT {_BOTH}, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM a FULL JOIN b ON a.sample = b.sample", "fd_add")(lambda s, d: freqdist.add(_fd(s, d, "en"), _fd(s, d, "fr")))
query(f"{_AB} SELECT a.sample, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b ON a.sample = b.sample WHERE a.n > coalesce(b.n, 0)", "fd_subtract")(lambda s, d: freqdist.subtract(_fd(s, d, "en"), _fd(s, d, "fr")))
query(f"{_AB} SELECT {_BOTH}, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM a FULL JOIN b ON a.sample = b.sample", "fd_union")(lambda s, d: freqdist.union(_fd(s, d, "en"), _fd(s, d, "fr")))
query(f"{_AB} SELECT a.sample, least(a.n, b.n) AS n FROM a JOIN b ON a.sample = b.sample", "fd_intersection")(lambda s, d: freqdist.intersection(_fd(s, d, "en"), _fd(s, d, "fr")))


_ODD = "b.n % 2 * b.n"
query(f"{_AB} SELECT {_BOTH}, coalesce({_ODD}, a.n) AS n FROM a FULL JOIN b ON a.sample = b.sample WHERE coalesce({_ODD}, a.n) > 0", "fd_put")(
    lambda s, d: freqdist.put(_fd(s, d, "en"), _fd(s, d, "fr").withColumn("n", F.col("n") % 2 * F.col("n")))
)
query(f"{_AB} SELECT sample, n FROM a WHERE sample NOT IN (SELECT sample FROM b)", "fd_delete")(lambda s, d: freqdist.delete(_fd(s, d, "en"), _fd(s, d, "fr")))


@query(f"{_AB} SELECT bool_and(a.n <= coalesce(b.n, 0)) AS is_subset FROM a LEFT JOIN b ON a.sample = b.sample")
def fd_subset_check(spark, d):
    return freqdist.is_subset(_fd(spark, d, "en"), _fd(spark, d, "fr"))


@query(f"{_AB} SELECT count(*) FILTER (WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)) = 0 AS equal FROM a FULL JOIN b ON a.sample = b.sample")
def fd_equals(spark, d):
    return freqdist.equals(_fd(spark, d, "en"), _fd(spark, d, "fr"))


@query(f"{K}, f AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM k) GROUP BY w) SELECT n AS r, count(*) AS nr FROM f GROUP BY 1 UNION ALL SELECT 0, greatest(0, 1000000 - count(*)) FROM f")
def freq_of_freq(spark, d):
    return freqdist.of_frequencies(counts.token_freq(_docs(spark, d)), 1_000_000)


@query(f"{K} SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM k) GROUP BY token HAVING count(*) = 1")
def hapaxes(spark, d):
    return freqdist.hapaxes(counts.token_freq(_docs(spark, d)))


def _first_seen(spark, d) -> DataFrame:
    return freqdist.build(counts.tokens(_docs(spark, d)).withColumnRenamed("token", "sample"), ["sample"], ["doc_id", "pos"])


_MOST = f"{K}, p AS (SELECT doc_id, unnest(t) AS sample, generate_subscripts(t, 1) AS i FROM k), f AS (SELECT sample, count(*) AS n, min((doc_id, i)) AS first FROM p GROUP BY 1)"


@query(f"{_MOST} SELECT sample, n FROM f ORDER BY n DESC, first LIMIT 100")
def most_common(spark, d):
    return freqdist.most_common(_first_seen(spark, d), 100).select("sample", "n")


@query(f"{_MOST} SELECT sample FROM f ORDER BY n DESC, first LIMIT 1")
def fd_max(spark, d):
    return freqdist.maximum(_first_seen(spark, d))


@query(f"""{_MOST} SELECT 'FreqDist({{' || string_agg('"' || sample || '": ' || n, ', ' ORDER BY n DESC, first) || ', ...}})' AS text FROM (SELECT * FROM f ORDER BY n DESC, first LIMIT 10)""")
def fd_rendered(spark, d):
    return freqdist.rendered(_first_seen(spark, d))


@query(f"{K}, f AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM k) GROUP BY token) SELECT token, n, round(n / (SELECT sum(n) FROM f)::DOUBLE, 12) AS freq FROM f")
def relative_frequencies(spark, d):
    return freqdist.frequencies(counts.token_freq(_docs(spark, d))).withColumn("freq", F.round("freq", 12))


_COND = f"WITH k AS ({S.toks(key='lang, source')}), c AS (SELECT lang AS condition, sample, source, count(*) AS n FROM (SELECT lang, source, unnest(t) AS sample FROM k) GROUP BY ALL)"


def _cond(spark, d, *sources: str) -> DataFrame:
    docs = table(spark, d, "documents")
    docs = docs.filter(F.col("source").isin(*sources)) if sources else docs
    rows = spread(docs).select(F.col("lang").alias("condition"), F.explode(T.ascii_tokens("text")).alias("sample"))
    return freqdist.build(rows, ["condition", "sample"])


query(f"{_COND} SELECT condition, sample, sum(n)::BIGINT AS n FROM c GROUP BY ALL", "cond_fd_by_lang")(lambda s, d: _cond(s, d))
query(f'{_COND} SELECT condition, sum(n)::BIGINT AS "N", count(DISTINCT sample) AS "B" FROM c GROUP BY ALL', "cond_fd_totals")(lambda s, d: freqdist.totals(_cond(s, d), ["condition"]))
_TWO = f"{_COND}, a AS (SELECT * FROM c WHERE source = 'src1'), b AS (SELECT * FROM c WHERE source = 'src2')"
_ON = "ON a.condition = b.condition AND a.sample = b.sample"
_KEYS = "coalesce(a.condition, b.condition) AS condition, coalesce(a.sample, b.sample) AS sample"
_CS = ("condition", "sample")
query(f"{_TWO} SELECT {_KEYS}, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM a FULL JOIN b {_ON}", "cond_fd_add")(lambda s, d: freqdist.add(_cond(s, d, "src1"), _cond(s, d, "src2"), _CS))
query(f"{_TWO} SELECT a.condition, a.sample, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b {_ON} WHERE a.n > coalesce(b.n, 0)", "cond_fd_subtract")(lambda s, d: freqdist.subtract(_cond(s, d, "src1"), _cond(s, d, "src2"), _CS))
query(f"{_TWO} SELECT {_KEYS}, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM a FULL JOIN b {_ON}", "cond_fd_union")(lambda s, d: freqdist.union(_cond(s, d, "src1"), _cond(s, d, "src2"), _CS))
query(f"{_TWO} SELECT a.condition, a.sample, least(a.n, b.n) AS n FROM a JOIN b {_ON}", "cond_fd_intersection")(lambda s, d: freqdist.intersection(_cond(s, d, "src1"), _cond(s, d, "src2"), _CS))


@query(f"""WITH k AS (SELECT regexp_extract_all(text, '[A-Za-z0-9'']+') AS t FROM documents), w AS (SELECT unnest(t) AS w FROM k)
SELECT {S.tag('w')} AS tag, translate(w, '{S.UP}', '{S.LOW}') AS token, count(*) AS n FROM w GROUP BY 1, 2""")
def cond_fd_by_tag(spark, d):
    w = _docs(spark, d).select(F.explode(T.raw_ascii_tokens("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return w.groupBy(T.rule_tag("w").alias("tag"), T.ascii_lower("w").alias("token")).agg(F.sum("n").alias("n"))


@query(f"""WITH k AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9'']+') AS t FROM documents), w AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM k)
SELECT doc_id, pos, token, {S.tag('token')} AS tag FROM w""")
def rule_pos_tags(spark, d):
    toks = counts.tokens(_docs(spark, d), make=T.raw_ascii_tokens)
    return toks.withColumn("tag", T.rule_tag("token"))


# tokenizers


def _token_counts(make):
    return lambda spark, d: _docs(spark, d).select(F.explode(make(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _clitic_sql(pattern: str) -> str:
    return f"""WITH k AS ({S.regex_tokens(pattern)}), w AS (SELECT unnest(t) AS w FROM k),
s AS (SELECT CASE WHEN regexp_full_match(w, '(?is).+n''t') THEN [left(w, length(w) - 3), 'n''t']
    WHEN regexp_extract(w, '(?is)^(.+)''(s|m|d|re|ve|ll)$', 1) <> '' THEN [regexp_extract(w, '(?is)^(.+)''(s|m|d|re|ve|ll)$', 1), lower(regexp_extract(w, '(?is)(''(s|m|d|re|ve|ll))$', 1))]
    ELSE [w] END AS p FROM w)
SELECT token, count(*) AS n FROM (SELECT unnest(p) AS token FROM s) GROUP BY token"""


def _plain_sql(pattern: str) -> str:
    return f"WITH k AS ({S.regex_tokens(pattern)}) SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM k) GROUP BY token"


query(_clitic_sql(T.WORD), "word_tokens")(_token_counts(T.word_tokens))
query(_clitic_sql(T.TREEBANK), "treebank_tokens")(_token_counts(T.treebank_tokens))
query(_plain_sql(T.WORD_PUNCT), "wordpunct_tokens")(_token_counts(T.wordpunct_tokens))
query(_plain_sql(T.TOKTOK), "toktok_tokens")(_token_counts(T.toktok_tokens))
query(None, "tweet_tokens")(lambda s, d: words.tweet_counts(_docs(s, d), preserve_case=False, reduce_len=True))
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
query(f"{K} SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM k) WHERE token NOT IN ({_STOP}) GROUP BY token", "normalized_ascii")(_token_counts(T.normalized_ascii))
query(None, "normalized_tokens")(_token_counts(words.normalized))


@query(f"{K} SELECT doc_id, len(t) AS tokens, len(list_filter(t, lambda x: x NOT IN ({_STOP}))) AS normalized FROM k")
def normalized_counts(spark, d):
    t = _docs(spark, d).select("doc_id", T.ascii_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(T.without_stopwords("t")).cast("long").alias("normalized"))


# words with two blanks between, so that phrases in a row share none
@query(
    f"{K}, s AS (SELECT ' ' || array_to_string(t, '  ') || ' ' AS s FROM k), p AS (SELECT replace(replace(replace(s, ' that  is  the ', ' that_is_the '), ' of  the ', ' of_the '), ' in  the ', ' in_the ') AS s FROM s) "
    "SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(trim(s), ' +')) AS token FROM p) WHERE token <> '' GROUP BY token"
)
def mwe_tokens(spark, d):
    toks = words.mwe_tokens(T.ascii_tokens("text"), [["of", "the"], ["in", "the"], ["that", "is", "the"]])
    return _docs(spark, d).select(F.explode(toks).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# stems: of the distinct words


def _vocab(spark, d) -> DataFrame:
    return counts.token_freq(_docs(spark, d)).withColumnRenamed("token", "word")


_V = f"{K}, v AS (SELECT DISTINCT word FROM (SELECT unnest(t) AS word FROM k))"


def _lancaster_sql() -> str:
    cases = " ".join(f"WHEN word LIKE '%{a}' AND length(word) >= {n} THEN left(word, length(word) - {len(a)}) || '{b}'" for a, b, n in T.LANCASTER)
    undouble = "CASE WHEN hit AND length(s) > 1 AND right(s, 1) = left(right(s, 2), 1) AND regexp_matches(s, '[bdfgmnprst]$') THEN left(s, length(s) - 1) ELSE s END"
    return f"{_V}, c AS (SELECT word, CASE {cases} END AS s0 FROM v), e AS (SELECT word, s0 IS NOT NULL AS hit, coalesce(s0, word) AS s FROM c), u AS (SELECT word, {undouble} AS s FROM e) SELECT word, CASE WHEN s = '' THEN word ELSE s END AS stem FROM u"


query(_lancaster_sql(), "lancaster_stems")(lambda s, d: _vocab(s, d).select("word", T.lancaster_stem("word").alias("stem")))
query(f"{_V} SELECT word, CASE WHEN length(word) > 4 THEN regexp_replace(word, '(ing|ed|s)$', '') ELSE word END AS stem FROM v", "regexp_stems")(lambda s, d: _vocab(s, d).select("word", T.regexp_stem("word", "(?:ing|ed|s)$", 4).alias("stem")))


def _porter_sql() -> str:
    """The steps one after another, each a CTE; forms() has Y for a y that is a consonant."""
    forms = lambda x: f"regexp_replace(regexp_replace({x}, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g')"
    vc = "[aeiouy]+[^aeiouy]"
    some = lambda x: f"regexp_matches({forms(x)}, '{vc}')"
    many = lambda x: f"regexp_matches({forms(x)}, '{vc}.*{vc}')"
    vowel = lambda x: f"regexp_matches({forms(x)}, '[aeiouy]')"
    cvc = lambda x: f"regexp_matches({forms(x)}, '[^aeiouy][aeiouy][^aeiouywxY]$')"
    cut = lambda n, x="w": f"left({x}, length({x}) - {n})"
    same = "(length(x) > 1 AND right(x, 1) = left(right(x, 2), 1) AND regexp_matches({f}, '[^aeiouy]$'))".format(f=forms("x"))

    def longest(rules, test, to=lambda end: "") -> str:
        return "CASE " + " ".join(f"WHEN w LIKE '%{end}' THEN CASE WHEN {test(cut(len(end)))} THEN {cut(len(end))} || '{to(end)}' ELSE w END" for end in rules)

    two, three = dict(stem._STEP2), dict(stem._STEP3)
    ion = f"WHEN w LIKE '%sion' OR w LIKE '%tion' THEN CASE WHEN {many(cut(3))} THEN {cut(3)} ELSE w END"
    steps = [
        f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {cut(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {cut(1)} ELSE w END AS w, NULL AS x",
        f"w, CASE WHEN w LIKE '%eed' THEN NULL WHEN w LIKE '%ed' AND {vowel(cut(2))} THEN {cut(2)} WHEN w LIKE '%ed' THEN NULL WHEN w LIKE '%ing' AND {vowel(cut(3))} THEN {cut(3)} END AS x",
        f"CASE WHEN x IS NULL THEN CASE WHEN w LIKE '%eed' AND {some(cut(3))} THEN {cut(1)} ELSE w END WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e' WHEN {same} THEN CASE WHEN regexp_matches(x, '[lsz]$') THEN x ELSE {cut(1, 'x')} END WHEN {some('x')} AND NOT {many('x')} AND {cvc('x')} THEN x || 'e' ELSE x END AS w",
        f"CASE WHEN w LIKE '%y' AND {vowel(cut(1))} THEN {cut(1)} || 'i' ELSE w END AS w",
        f"{longest(two, some, two.get)} ELSE w END AS w",
        f"{longest(three, some, three.get)} ELSE w END AS w",
        f"{longest(stem._STEP4, many)} {ion} ELSE w END AS w",
        f"CASE WHEN w LIKE '%e' AND ({many(cut(1))} OR {some(cut(1))} AND NOT {cvc(cut(1))}) THEN {cut(1)} ELSE w END AS w",
        f"CASE WHEN w LIKE '%ll' AND {many('w')} THEN {cut(1)} ELSE w END AS w",
    ]
    chain = ", ".join(f"p{i + 1} AS (SELECT word, {x} FROM p{i})" for i, x in enumerate(steps))
    return f"{_V}, p0 AS (SELECT word, word AS w FROM v WHERE length(word) > 2), {chain} SELECT v.word, coalesce(w, v.word) AS stem FROM v LEFT JOIN p{len(steps)} p ON p.word = v.word"


query(_porter_sql(), "porter_stems")(lambda s, d: _vocab(s, d).select("word", stem.porter_stem("word").alias("stem")))
query(_porter_sql(), "snowball_stems")(lambda s, d: _vocab(s, d).select("word", stem.snowball_stem("word").alias("stem")))
query(
    f"""{_V} SELECT word, CASE WHEN word LIKE '%ies' AND length(word) > 3 THEN left(word, length(word) - 3) || 'y' WHEN word LIKE '%ing' AND length(word) > 4 THEN left(word, length(word) - 3)
WHEN word LIKE '%ed' AND length(word) > 3 THEN left(word, length(word) - 2) WHEN word LIKE '%s' AND length(word) > 1 THEN left(word, length(word) - 1) ELSE word END AS lemma FROM v""",
    "morphy_rules",
)(lambda s, d: _vocab(s, d).select("word", T.morphy_rule("word", "v").alias("lemma")))


@query(r"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n\r?\n') AS p FROM documents), q AS (SELECT doc_id, unnest(p) AS p FROM p),
r AS (SELECT doc_id, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p FROM q) SELECT doc_id, count(*) AS n, sum(length(p))::BIGINT AS chars FROM r WHERE p <> '' GROUP BY doc_id""")
def paragraphs(spark, d):
    p = _docs(spark, d).select("doc_id", F.explode(T.paragraphs("text")).alias("p"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("chars"))
