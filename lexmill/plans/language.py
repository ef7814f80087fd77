"""Queries: sentences, sentiment, language models, parsing, lexical graphs, corpora, streams."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batches, chunk, grammar, sentences, sentiment, tagger, trees
from ..functions import text as T
from ..operators import counts, lexicon, lm
from ..sources import corpus, synsets
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


def _turns(spark, d) -> DataFrame:
    return spread(table(spark, d, "conversations"))


query(None, "sentences_heuristic")(lambda s, d: _docs(s, d).select("doc_id", F.posexplode(sentences.heuristic(F.col("text"))).alias("pos", "sentence")))
query(None, "sentence_counts")(lambda s, d: _docs(s, d).select("doc_id", F.size(sentences.rules(F.col("text"))).alias("n")))
query(None, "sentences_rules")(lambda s, d: _docs(s, d).select("doc_id", F.posexplode(sentences.rules(F.col("text"))).alias("pos", "sentence")))


@query(None)
def sentences_trained(spark, d):
    docs = _docs(spark, d)
    return docs.select("doc_id", F.posexplode(sentences.with_model(sentences.train_punkt(docs))("text")).alias("pos", "sentence"))


@query(None)
def punkt_model(spark, d):
    m = sentences.train_punkt(_docs(spark, d))
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(m.scores.items())], "word string, score double")


query(None, "sentiment")(lambda s, d: _docs(s, d).select("doc_id", sentiment.sentiment("text").alias("s")).select("doc_id", "s.*"))

# language models: trained on the user turns, asked for the words of the assistants' turns

_ORDER = 3


def _model(spark, d, kind: str) -> lm.NgramModel:
    users = _turns(spark, d).filter("role = 'user'").select(T.ascii_tokens("text").alias("tokens"))
    return lm.train(users, _ORDER, kind)


def _probes(spark, d) -> DataFrame:
    t = _turns(spark, d).filter("role = 'assistant'").select(T.ascii_tokens("text").alias("t"))
    rows = t.select("t", F.posexplode("t").alias("i", "word"))
    context = F.when(F.col("i") >= 2, F.slice("t", F.col("i") - 1, 2)).when(F.col("i") == 1, F.slice("t", 1, 1)).otherwise(F.array().cast("array<string>"))
    return rows.select("word", context.alias("context")).distinct()


_LM = f"""WITH u AS ({S.toks('conversations', 'conv_id', where="WHERE role = 'user'")}), p AS (SELECT list_concat(['<s>', '<s>'], t, ['</s>']) AS t FROM u),
c1 AS (SELECT w, count(*)::DOUBLE AS n FROM (SELECT unnest(t) AS w FROM p) GROUP BY w),
c2 AS (SELECT c, w, count(*)::DOUBLE AS n FROM (SELECT t[i] AS c, t[i + 1] AS w FROM (SELECT t, unnest(range(1, len(t))) AS i FROM p)) GROUP BY ALL),
c3 AS (SELECT c, w, count(*)::DOUBLE AS n FROM (SELECT t[i] || ' ' || t[i + 1] AS c, t[i + 2] AS w FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM p)) GROUP BY ALL),
s AS (SELECT count(*)::DOUBLE AS v, sum(n) AS uni, (SELECT count(*)::DOUBLE FROM c2) AS types FROM c1), k1 AS (SELECT w, count(*)::DOUBLE AS k FROM c2 GROUP BY w),
f1 AS (SELECT c, count(*)::DOUBLE AS f FROM c2 GROUP BY c), f2 AS (SELECT c, count(*)::DOUBLE AS f FROM c3 GROUP BY c), t2 AS (SELECT c || ' ' || w AS c, n FROM c2),
a AS ({S.toks('conversations', 'conv_id', where="WHERE role = 'assistant'")}), e AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM a),
r AS (SELECT DISTINCT t[i] AS word, CASE WHEN i > 2 THEN t[i - 2:i - 1] WHEN i = 2 THEN t[1:1] ELSE [] END AS context FROM e),
x AS (SELECT word, context, CASE WHEN len(context) >= 1 THEN context[len(context)] END AS c1_, CASE WHEN len(context) = 2 THEN context[1] || ' ' || context[2] END AS c2_ FROM r),
j AS (SELECT x.word, x.context, coalesce(c1.n, 0) AS n1, coalesce(c2.n, 0) AS n2, coalesce(c3.n, 0) AS n3, b1.n AS m1, t2.n AS m2, coalesce(f1.f, 0) AS f1, coalesce(f2.f, 0) AS f2, coalesce(k1.k, 0) AS k1, s.*
 FROM x CROSS JOIN s LEFT JOIN c1 ON c1.w = x.word LEFT JOIN c2 ON c2.c = c1_ AND c2.w = x.word LEFT JOIN c3 ON c3.c = c2_ AND c3.w = x.word
 LEFT JOIN c1 b1 ON b1.w = c1_ LEFT JOIN t2 ON t2.c = c2_ LEFT JOIN f1 ON f1.c = c1_ LEFT JOIN f2 ON f2.c = c2_ LEFT JOIN k1 ON k1.w = x.word)"""
_MLE = "CASE WHEN m2 IS NOT NULL THEN n3 / m2 WHEN m1 IS NOT NULL THEN n2 / m1 ELSE n1 / uni END"
_LID = "CASE WHEN m2 IS NOT NULL THEN (n3 + 0.1::DOUBLE) / (m2 + 0.1::DOUBLE * v) WHEN m1 IS NOT NULL THEN (n2 + 0.1::DOUBLE) / (m1 + 0.1::DOUBLE * v) ELSE (n1 + 0.1::DOUBLE) / (uni + 0.1::DOUBLE * v) END"
_KN1 = "CASE WHEN k1 = 0 THEN 1 / (types * 10) ELSE k1 / types END"
_KN2 = f"CASE WHEN m1 IS NULL THEN {_KN1} ELSE greatest(n2 - 0.75::DOUBLE, 0) / m1 + 0.75::DOUBLE * f1 / m1 * ({_KN1}) END"
_KN3 = f"CASE WHEN m2 IS NULL THEN {_KN2} ELSE greatest(n3 - 0.75::DOUBLE, 0) / m2 + 0.75::DOUBLE * f2 / m2 * ({_KN2}) END"
for _kind, _name, _expr in (("mle", "lm_mle_scores", _MLE), ("lidstone", "lm_lidstone_scores", _LID), ("kneser_ney_interpolated", "lm_kneser_ney_scores", _KN3)):
    query(f"{_LM} SELECT word, array_to_string(context, ' ') AS context, round({_expr}, 9) AS prob FROM j", _name)(
        lambda s, d, kind=_kind: lm.score(_model(s, d, kind), _probes(s, d)).select("word", F.array_join("context", " ").alias("context"), F.round("prob", 9).alias("prob"))
    )

query(
    f"""WITH u AS ({S.toks('conversations', 'conv_id', where="WHERE role = 'user'")}), p AS (SELECT list_concat(['<s>', '<s>'], t, ['</s>']) AS t FROM u)
SELECT 1 AS "order", '' AS context, w AS word, count(*) AS n FROM (SELECT unnest(t) AS w FROM p) GROUP BY w
UNION ALL SELECT 2, c, w, count(*) FROM (SELECT t[i] AS c, t[i + 1] AS w FROM (SELECT t, unnest(range(1, len(t))) AS i FROM p)) GROUP BY c, w
UNION ALL SELECT 3, c, w, count(*) FROM (SELECT t[i] || ' ' || t[i + 1] AS c, t[i + 2] AS w FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM p)) GROUP BY c, w""",
    "lm_counts",
)(lambda s, d: _model(s, d, "mle").counts)
_PERPLEXITY = _LM[: _LM.index("a AS (SELECT")] + f"""a AS ({S.toks('conversations', 'conv_id * 1000 + turn AS sent_id', where="WHERE role = 'assistant'")}), w AS (SELECT sent_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM a),
m AS (SELECT sent_id, list(coalesce(c1.w, '</s>') ORDER BY i) AS t FROM w LEFT JOIN c1 ON c1.w = w.w GROUP BY sent_id), b AS (SELECT a.sent_id, list_concat(['<s>', '<s>'], coalesce(m.t, []), ['</s>']) AS t FROM a LEFT JOIN m ON m.sent_id = a.sent_id),
x AS (SELECT sent_id, t[i] AS word, t[i - 1] AS c1_, t[i - 2] || ' ' || t[i - 1] AS c2_ FROM (SELECT sent_id, t, unnest(range(3, len(t) + 1)) AS i FROM b)),
j AS (SELECT x.sent_id,""" + _LM[_LM.index(" coalesce(c1.n, 0) AS n1"):]
query(f"{_PERPLEXITY} SELECT sent_id, round(pow(2, -avg(log2(greatest({_KN3}, 1e-12::DOUBLE)))), 3) AS perplexity FROM j GROUP BY sent_id", "lm_perplexity")(
    lambda s, d: lm.perplexity(_model(s, d, "kneser_ney_interpolated"), _turns(s, d).filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sent_id"), T.ascii_tokens("text").alias("tokens"))).withColumn("perplexity", F.round("perplexity", 3))
)

# tags, chunks, parses

CHUNKS = "NP: {<DT>?<NN.*>+}\nVP: {<VB.*><RB>?}"
GRAMMAR = """S -> NP VP | NP
NP -> D N | N | N N | D N N
VP -> V NP | V
D -> 'the' | 'a' | 'this' | 'that'
V -> 'is' | 'was' | 'are'
N -> 'of' | 'in' | 'on' | 'it' | 'for' | 'and' | 'to' | 'with' | 'by'"""
WEIGHTED = GRAMMAR.replace("VP -> V NP | V", "VP -> V NP [0.7] | V [0.3]")
FEATURES = """S -> NP[num=?n] VP[num=?n] | NP[num=?n]
NP[num=sg] -> 'it' | 'the' N | 'this' N
NP[num=pl] -> 'of' | 'the' N N
VP[num=sg] -> 'is' | 'was'
VP[num=pl] -> 'are'
N -> 'of' | 'in' | 'on' | 'it' | 'for' | 'and' | 'to' | 'with' | 'by'"""


def _runs(spark, d) -> DataFrame:
    """All runs of words between full stops, each once."""
    return _docs(spark, d).select(F.explode(F.split(F.lower("text"), r"[.\n]+")).alias("p")).select(F.trim("p").alias("sentence")).filter("sentence <> ''").distinct()


_CHUNKED = f"""WITH k AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9'']+') AS t FROM documents), w AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM k),
g AS (SELECT *, {S.tag('token')} AS tag FROM w), b AS (SELECT *, lag(tag) OVER o AS before, lead(tag) OVER o AS after FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, token, tag, CASE WHEN tag LIKE 'NN%' THEN CASE WHEN before LIKE 'NN%' OR before = 'DT' THEN 'I-NP' ELSE 'B-NP' END WHEN tag = 'DT' AND after LIKE 'NN%' THEN 'B-NP'
    WHEN tag LIKE 'VB%' THEN 'B-VP' WHEN tag = 'RB' AND before LIKE 'VB%' THEN 'I-VP' ELSE 'O' END AS iob FROM b"""
query(_CHUNKED, "chunk_iob")(lambda s, d: chunk.chunked(_docs(s, d), CHUNKS))
query(None, "perceptron_tags")(lambda s, d: _turns(s, d).select("conv_id", "turn", T.raw_ascii_tokens("text").alias("token")).withColumn("tag", tagger.default_model().column("token")).select("conv_id", "turn", F.posexplode(F.arrays_zip("token", "tag")).alias("pos", "x")).select("conv_id", "turn", "pos", "x.*"))
_D, _V, _N = "the|a|this|that", "is|was|are", "of|in|on|it|for|and|to|with|by"
_NP = f"(?:(?:{_D}) )?(?:{_N})(?: (?:{_N}))?"
#: Sentences, their words, and whether the grammar, whose language is finite, has them.
_SENTENCES = f"""WITH s AS (SELECT DISTINCT trim(p) AS sentence FROM (SELECT unnest(string_split_regex(lower(text), '[.\\n]+')) AS p FROM documents) WHERE trim(p) <> ''),
g AS (SELECT sentence, array_to_string(list_filter(regexp_extract_all(sentence, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?|[^{S.SPACES}]'), lambda x: regexp_matches(x, '[A-Za-z0-9_]')), ' ') AS w FROM s),
r AS (SELECT sentence, w, regexp_full_match(w, '{_NP}(?: (?:{_V})(?: {_NP})?)?') AS accepted FROM g)"""


def _phrase(words: str, helper: str = "") -> str:
    """The noun phrase of some words, as a bracket string; helper is the symbol for the last two parts of a rule of three,
    where the parser shows it."""
    out = f"'(NP ' || regexp_replace(regexp_replace({words}, '\\b({_D})\\b', '(D \\1)', 'g'), '\\b({_N})\\b', '(N \\1)', 'g') || ')'"
    return f"regexp_replace({out}, '(\\(D \\w+\\)) (\\(N \\w+\\) \\(N \\w+\\))', '\\1 ({helper} \\2)')" if helper else out


def _trees(helper: str = "") -> str:
    return f"""{_SENTENCES}, c AS (SELECT sentence, w, regexp_extract(w, '^({_NP})', 1) AS np, regexp_extract(w, '\\b({_V})\\b', 1) AS v, regexp_extract(w, '\\b(?:{_V}) (.*)$', 1) AS o FROM r WHERE accepted),
t AS (SELECT sentence, w, np, v, o, '(S ' || {_phrase('np', helper)} || CASE WHEN v <> '' THEN ' (VP (V ' || v || ')' || CASE WHEN o <> '' THEN ' ' || {_phrase('o', helper)} ELSE '' END || ')' ELSE '' END || ')' AS tree FROM c)"""


for _method in ("chart", "earley", "recursive_descent", "left_corner"):
    query(f"{_trees('__BIN_0' if _method in ('chart', 'earley') else '')} SELECT sentence, tree FROM t", f"cfg_{_method}")(lambda s, d, m=_method: _runs(s, d).select("sentence", F.explode(grammar.parse_text(grammar.cfg(GRAMMAR), m)("sentence")).alias("tree")))
query(f"{_SENTENCES} SELECT sentence, accepted FROM r", "cfg_recognize")(lambda s, d: _runs(s, d).select("sentence", grammar.recognize_text(grammar.cfg(GRAMMAR))("sentence").alias("accepted")))
_PROB = f"""p AS (SELECT sentence, tree, ln(0.5::DOUBLE) + (CASE WHEN o <> '' THEN 2 ELSE 1 END) * ln(0.25::DOUBLE) + len(regexp_extract_all(w, '\\b(?:{_N})\\b')) * ln(1 / 9::DOUBLE)
    + len(regexp_extract_all(w, '\\b(?:{_D})\\b')) * ln(0.25::DOUBLE) + CASE WHEN v = '' THEN 0 WHEN o = '' THEN ln(0.3::DOUBLE / 3) ELSE ln(0.7::DOUBLE / 3) END AS log_prob FROM t)"""
query(f"{_trees('__PBIN_0')}, {_PROB} SELECT sentence, tree, round(log_prob, 6) AS log_prob, round(exp(log_prob), 12) AS prob FROM p", "pcfg_viterbi")(
    lambda s, d: _runs(s, d).select("sentence", grammar.parse_text_weighted(grammar.pcfg(WEIGHTED))("sentence").alias("p")).filter("p is not null").select("sentence", "p.tree", F.round("p.log_prob", 6).alias("log_prob"), F.round("p.prob", 12).alias("prob"))
)
_FEATURED = f"""{_SENTENCES}, f AS (SELECT sentence, regexp_full_match(w, '(?:it|(?:the|this) (?:{_N}))(?: (?:is|was))?') AS sg, regexp_full_match(w, '(?:of|the (?:{_N}) (?:{_N}))(?: are)?') AS pl,
    regexp_extract(w, '^(.*?)(?: (?:{_V}))?$', 1) AS np, regexp_extract(w, ' ({_V})$', 1) AS v FROM g),
n AS (SELECT sentence, CASE WHEN sg THEN 'sg' ELSE 'pl' END AS num, CASE WHEN np IN ('it', 'of') THEN np ELSE regexp_replace(np, ' ({_N})', ' (N \\1)', 'g') END AS np, v FROM f WHERE sg OR pl)
SELECT sentence, '(S (NP[num=' || num || '] ' || np || ')' || CASE WHEN v <> '' THEN ' (VP[num=' || num || '] ' || v || ')' ELSE '' END || ')' AS tree FROM n"""
query(_FEATURED, "feature_parse")(lambda s, d: _runs(s, d).select("sentence", F.explode(grammar.parse_text_features(grammar.feature_cfg(FEATURES))("sentence")).alias("tree")))
query(None, "dependency_arcs")(lambda s, d: _turns(s, d).select("conv_id", "turn", chunk.dependency_text("text").alias("p")).select("conv_id", "turn", F.explode("p.arcs").alias("a")).select("conv_id", "turn", "a.*"))
_COLLAPSED = "regexp_replace(regexp_replace(tree, '\\(NP \\(N (\\w+)\\)\\)', '(NP+N \\1)', 'g'), '\\(VP \\(V (\\w+)\\)\\)', '(VP+V \\1)', 'g')"
_THREE = f"regexp_full_match({{}}, '(?:{_D}) (?:{_N}) (?:{_N})')::INT"
query(f"{_trees('__BIN_0')} SELECT sentence, tree, greatest(3 + {_THREE.format('np')}, CASE WHEN o <> '' THEN 4 + {_THREE.format('o')} ELSE 0 END)::INT AS depth, w AS leaves, CASE WHEN v = '' THEN regexp_replace({_COLLAPSED}, '^\\(S \\(NP(.*)\\)\\)$', '(S+NP\\1)') ELSE {_COLLAPSED} END AS collapsed FROM t", "tree_transforms")(lambda s, d: QUERIES["cfg_chart"](s, d).select("sentence", "tree", trees.tree_depth("tree").alias("depth"), F.array_join(trees.tree_leaves("tree"), " ").alias("leaves"), trees.tree_collapsed("tree").alias("collapsed")))

# lexical graph: the packaged example

_PATH = Path(__file__).resolve().parent.parent / "data" / "synsets.json"
_ROWS = json.loads(_PATH.read_text(encoding="utf-8"))["synsets"]


def _lex(spark) -> lexicon.Lexicon:
    return lexicon.Lexicon(synsets.from_rows(spark, _ROWS))


_SYN = "WITH RECURSIVE s(id, pos, ord) AS (VALUES " + ", ".join(f"('{r['id']}', '{r['pos']}', {i})" for i, r in enumerate(_ROWS)) + "), lem(lemma, pos, id, ord) AS (VALUES " + ", ".join(f"('{w}', '{r['pos']}', '{r['id']}', {i})" for i, r in enumerate(_ROWS) for w in r["lemmas"]) + ")"
_edges = lambda *kinds: [(r["id"], t, k) for r in _ROWS for k in kinds for t in r[k]]
_REL = ("hypernyms", "hyponyms", "similarTo", "antonyms")
_EDGE = ", e0(src, dst, kind) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{k}')" for a, b, k in _edges(*_REL)) + "), e AS (SELECT DISTINCT e0.* FROM e0 JOIN s ON s.id = e0.dst)"
_UP = ", up AS (SELECT id AS start, id, 0 AS depth, [id] AS path FROM s UNION ALL SELECT up.start, e.dst, depth + 1, list_append(path, e.dst) FROM up JOIN e ON e.src = up.id AND e.kind = 'hypernyms' WHERE NOT list_contains(path, e.dst))"
query(f"{_SYN}{_EDGE} SELECT src, dst, kind FROM e", "synset_relations")(lambda s, d: _lex(s).edges(*_REL))
query(f"{_SYN}{_EDGE}{_UP} SELECT start AS id, array_to_string(path, '>') AS path FROM up WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = up.id AND e.kind = 'hypernyms')", "hypernym_paths")(
    lambda s, d: _lex(s).hypernym_paths().select("id", F.array_join("path", ">").alias("path"))
)
query(
    f"{_SYN}{_EDGE}, b AS (SELECT DISTINCT src, dst FROM e WHERE kind IN ('hypernyms', 'hyponyms')), w AS (SELECT id AS a, id AS b, 0 AS depth FROM s UNION SELECT w.a, b.dst, depth + 1 FROM w JOIN b ON b.src = w.b WHERE depth < 12) SELECT a, b, min(depth)::BIGINT AS distance, round(1 / (min(depth) + 1)::DOUBLE, 9) AS similarity FROM w GROUP BY a, b",
    "shortest_paths",
)(lambda s, d: _lex(s).distances().select("a", "b", F.col("distance").cast("long").alias("distance"), F.round("similarity", 9).alias("similarity")))
_PAIRS = [("parrot.n.01", "horse.n.01"), ("parrot.n.01", "leaf.n.01"), ("saw.n.01", "pet.n.01"), ("run.v.01", "carry.v.01"), ("bird.n.01", "pet.n.01"), ("bird.n.01", "run.v.01")]
query(
    f"{_SYN}{_EDGE}{_UP}, m AS (SELECT start, id, min(depth) AS depth FROM up GROUP BY start, id), q(a, b) AS (VALUES {', '.join(str(p) for p in _PAIRS)}), c AS (SELECT q.a, q.b, x.id, rank() OVER (PARTITION BY q.a, q.b ORDER BY x.depth + y.depth) AS r FROM q JOIN m x ON x.start = q.a JOIN m y ON y.start = q.b AND y.id = x.id) SELECT a, b, id FROM c WHERE r = 1",
    "lowest_common_hypernyms",
)(lambda s, d: _lex(s).lowest_common_hypernyms(s.createDataFrame(_PAIRS, "a string, b string")))
query(f"{_SYN}, k AS (SELECT lemma || '%' || CASE pos WHEN 'n' THEN '1' WHEN 'v' THEN '2' WHEN 'a' THEN '3' ELSE '4' END || ':00:00::' AS sense_key, id, ord FROM lem) SELECT sense_key, arg_min(id, ord) AS id FROM k GROUP BY sense_key", "sense_keys")(lambda s, d: _lex(s).sense_keys())
query(f"{_SYN} SELECT pos, left(id, 8)::BIGINT AS \"offset\", id FROM s WHERE regexp_full_match(id, '[0-9]{{8}}\\.[nvar]')", "synsets_by_offset")(lambda s, d: _lex(s).by_offset())
query(f"{_SYN} SELECT DISTINCT lemma FROM lem WHERE pos = 'n'", "lemmas")(lambda s, d: _lex(s).lemmas("n"))
query(f"{_SYN} SELECT id, pos FROM s", "all_synsets")(lambda s, d: _lex(s).all_synsets().select("id", "pos"))


def _vocab(spark, d) -> DataFrame:
    return counts.token_freq(_docs(spark, d)).select(F.col("token").alias("word"))


def _base_sql(pos: str | None) -> str:
    """CTEs v (words), known (lemmas) and base (word, lemma)."""
    forms = []
    for p, rules in ((None, lexicon.RULES[pos or "n"]), *((p, lexicon.ENDINGS[p]) for p in ([pos] if pos else ["n", "v", "a"]))):
        here = []
        for end, least, to in rules:
            stem = f"left(word, length(word) - {len(end)})"
            form = f"CASE WHEN length(word) > {len(end) + 1} AND right({stem}, 1) = left(right({stem}, 2), 1) THEN left(word, length(word) - {len(end) + 1}) ELSE {stem} END" if to == "2" else f"{stem} || '{to}'"
            here.append((f"word LIKE '%{end}' AND length(word) >= {least}", form))
        if p is None:
            forms += [f"CASE {' '.join(f'WHEN {test} THEN {form}' for test, form in here)} ELSE word END", "word"]
        else:
            forms += [f"CASE WHEN {test} THEN {form} END" for test, form in here]
    only = f"WHERE pos = '{pos}'" if pos else ""
    return f"""{_SYN}, v AS (SELECT DISTINCT word FROM (SELECT unnest(t) AS word FROM ({S.toks()}))), known AS (SELECT DISTINCT lemma FROM lem {only}),
base AS (SELECT word, arg_min(lemma, o) AS lemma FROM (SELECT word, unnest([{', '.join(forms)}]) AS lemma, generate_subscripts([{', '.join(str(i) for i in range(len(forms)))}], 1) AS o FROM v) WHERE lemma IN (SELECT lemma FROM known) GROUP BY word)"""


query(f"{_base_sql(None)} SELECT word, lemma FROM base", "morphy")(lambda s, d: _lex(s).morphy(_vocab(s, d)))
query(f"{_base_sql('v')} SELECT v.word, coalesce(lemma, v.word) AS lemma FROM v LEFT JOIN base ON base.word = v.word", "lemmatize")(lambda s, d: _lex(s).lemmatize(_vocab(s, d), "v"))
query(f"{_base_sql(None)}, n AS (SELECT v.word, coalesce(lemma, v.word) AS lemma FROM v LEFT JOIN base ON base.word = v.word) SELECT DISTINCT word, id, ord FROM n JOIN lem ON lem.lemma = n.lemma", "synset_lookup")(
    lambda s, d: _lex(s).lookup(_vocab(s, d))
)

# corpora: each document a text of its own, its source and language its categories


def _corpus(spark, d) -> DataFrame:
    return _docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), "text", F.array_sort(F.array_distinct(F.transform(F.array("source", "lang"), F.lower))).alias("categories"))


query("SELECT doc_id::VARCHAR AS id FROM documents WHERE lower(source) IN ('src1', 'fr') OR lower(lang) IN ('src1', 'fr')", "corpus_select")(lambda s, d: corpus.select(_corpus(s, d), categories=["SRC1", "Fr"]).select("id"))
query("SELECT DISTINCT category FROM (SELECT unnest([lower(source), lower(lang)]) AS category FROM documents) WHERE category IS NOT NULL", "corpus_categories")(lambda s, d: corpus.categories(_corpus(s, d)).filter("category is not null"))
_PARAS = r"""WITH p AS (SELECT doc_id::VARCHAR AS id, regexp_split_to_array(text, '\r?\n\r?\n') AS p FROM documents), q AS (SELECT id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM p)
SELECT id, unnest(p) AS paragraph, generate_subscripts(p, 1) - 1 AS pos FROM q"""
query(_PARAS, "corpus_paras")(lambda s, d: corpus.paras(_corpus(s, d)))
_TAGGED = f"""WITH l AS (SELECT doc_id::VARCHAR AS id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_extract_all(x, '[A-Za-z0-9'']+')), lambda x: len(x) > 0)) AS t,
    generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_extract_all(x, '[A-Za-z0-9'']+')), lambda x: len(x) > 0), 1) - 1 AS sentence FROM documents),
w AS (SELECT id, sentence, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM l), g AS (SELECT id, sentence, pos, token, {S.tag('token')} AS tag FROM w) SELECT id, sentence, pos, token, tag"""


def _tagged(spark, d, item: str, token: str, sentence: str) -> DataFrame:
    """The documents as tagged texts: a line's words with their tags, written as item says."""
    return _corpus(spark, d).select("id", batches.tagged_text("text", item, token, sentence).alias("text"))


query(f"{_TAGGED} FROM g", "corpus_brown")(lambda s, d: corpus.brown_tagged(_tagged(s, d, "{0}/{1}", " ", "\n")))
query(f"{_TAGGED} FROM g", "corpus_conll_tagged")(lambda s, d: corpus.conll_tagged(_tagged(s, d, "{0}\t{1}", "\n", "\n\n")))
query(f"{_TAGGED}, 'B-' || tag AS chunk FROM g", "corpus_conll_chunked")(lambda s, d: corpus.conll_chunked(_tagged(s, d, "{0} {1} B-{1}", "\n", "\n\n")))


# streams: each conversation is a stream of its turns; a turn ends its last word

_ST = "WITH c AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9'']+') AS t FROM conversations), w AS (SELECT conv_id, turn, i, word, lag(word) OVER (PARTITION BY conv_id ORDER BY turn, i) AS before FROM (SELECT conv_id, turn, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM c))"
_low = lambda c: f"translate({c}, '{S.UP}', '{S.LOW}')"


@query(
    f"{_ST} SELECT 'token' AS kind, '' AS a, {_low('word')} AS b, count(*) AS n FROM w GROUP BY ALL UNION ALL SELECT 'bigram', {_low('before')}, {_low('word')}, count(*) FROM w WHERE before IS NOT NULL GROUP BY ALL UNION ALL SELECT 'tag', {S.tag('word')}, {_low('word')}, count(*) FROM w GROUP BY ALL"
)
def stream_freqdist(spark, d):
    from ..streaming.freqdist import FreqDistStream

    out = FreqDistStream(spark, fresh_path(spark, "stream"))
    schema = table(spark, d, "conversations").schema
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{d}/conversations.parquet*")
    parts = F.array(F.struct((F.col("turn") * 2).alias("seq"), F.col("text").alias("chunk")), F.struct((F.col("turn") * 2 + 1).alias("seq"), F.lit(None).cast("string").alias("chunk")))
    chunks = source.select(F.col("conv_id").alias("stream_id"), F.explode(parts).alias("p")).select("stream_id", "p.*")
    out.start(chunks, available_now=True).awaitTermination()
    rows = [out.tokens().select(F.lit("token").alias("kind"), F.lit("").alias("a"), F.col("token").alias("b"), "n"), out.bigrams().select(F.lit("bigram"), "l", "r", "n"), out.conditional().select(F.lit("tag"), "tag", "token", "n")]
    return rows[0].union(rows[1]).union(rows[2])
