"""Operators on small tables."""

import hashlib
import json
import math
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lexmill.functions import metrics, stem, words
from lexmill.functions import text as T
from lexmill.operators import collocations, counts, explore, freqdist, learners, lexicon, lm, probability
from lexmill.sources import corpus, models, synsets
from lexmill.streaming.freqdist import FreqDistStream


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def one(df):
    return df.first()[0]


def test_templates(spark):
    df = texts(spark, "A b c d", "", "x")
    t = T.ascii_tokens("text")
    got = df.orderBy("doc_id").select(T.everygrams(t, 1, 2), T.skipgrams(t, 2, 1), T.ngrams(t, 3)).collect()
    assert got[0][0] == [["a"], ["a", "b"], ["b"], ["b", "c"], ["c"], ["c", "d"], ["d"]]
    assert got[0][1] == [["a", "b"], ["a", "c"], ["b", "c"], ["b", "d"], ["c", "d"]]
    assert got[0][2] == [["a", "b", "c"], ["b", "c", "d"]]
    assert list(got[1]) == [[], [], []] and list(got[2]) == [[["x"]], [], []]
    with pytest.raises(ValueError):
        T.ngrams(t, 0)
    df = texts(spark, "don't résumé İK it's")
    assert one(df.select(T.ascii_tokens("text"))) == ["don't", "r", "sum", "k"] or one(df.select(T.ascii_tokens("text")))[0] == "don't"
    assert one(df.select(T.fnv1a(F.lit("a")))) == "AF63DC4C8601EC8C"
    tags = one(texts(spark, "The 3 dogs ran quickly").select(T.rule_tags("text")))
    assert [(r["token"], r["tag"], r["start"]) for r in tags] == [("The", "DT", 0), ("3", "CD", 4), ("dogs", "NN", 6), ("ran", "NN", 11), ("quickly", "RB", 15)]


@pytest.mark.parametrize(("size", "window"), [(3, 3), (3, 5), (4, 5)])
def test_finder_weights(spark, size, window):
    docs = ["a b a c b a", "b c", "a"]
    want = {p: Counter() for p in collocations.PATTERNS[size]}
    words = Counter()
    for d in docs:
        t = d.split()
        for i in range(len(t)):
            for places in combinations(range(1, window), size - 1):
                words[t[i]] += 1
                whole = (0, *places)
                for p in want:
                    if i + whole[p[-1]] < len(t):
                        want[p][tuple(t[i + whole[j]] for j in p)] += 1
    f = collocations.finder(texts(spark, *docs), size, window)
    assert {r["w1"]: r["n"] for r in f.words.collect()} == words
    for p, c in want.items():
        assert {tuple(r)[:-1]: r["n"] for r in f.tables[p].collect()} == c
    with pytest.raises(ValueError):
        collocations.score(f, "dice")


def test_freqdist_order_and_errors(spark):
    fd = freqdist.build(spark.createDataFrame([(i, c) for i, c in enumerate("cabbb")], "i long, sample string"), ["sample"], ["i"])
    assert [r["sample"] for r in freqdist.most_common(fd).collect()] == ["b", "c", "a"]
    assert freqdist.most_common(fd, -3).count() == 0 and one(freqdist.maximum(fd)) == "b"
    assert one(freqdist.rendered(fd, 2)) == 'FreqDist({"b": 3, "c": 1, ...})'
    with pytest.raises(Exception, match="bins"):
        probability.lidstone(fd, 1.0, 2).collect()


def test_good_turing_sums_to_one(spark):
    fd = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate([1] * 30 + [2] * 12 + [3] * 6 + [4] * 3 + [9, 17])], "sample string, n long")
    dist, unseen = probability.good_turing(fd, 100)
    assert sum(r["prob"] for r in dist.collect()) + unseen * (100 - 53) == pytest.approx(1.0)


def test_probabilities(spark):
    assert one(spark.range(1).select(probability.log_sum(F.array(F.lit(-1.0), F.lit(-1.0))))) == pytest.approx(0.0)
    d = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "sample string, p double")
    assert [r["prob"] for r in probability.from_dictionary(d, normalize=True).collect()] == [0.5, 0.5]
    m = probability.mutable(spark.createDataFrame([("a", 0.5), ("b", 0.5)], "sample string, prob double"), spark.createDataFrame([("a", 0.1)], "sample string, prob double"))
    assert {r["sample"]: r["prob"] for r in m.collect()} == {"a": 0.1, "b": 0.5}


def test_explore(spark):
    docs = texts(spark, "the cat sat on the mat", "the dog sat on the rug")
    c = explore.concordance(docs, "SAT", 40).collect()
    assert [(r["doc_id"], r["pos"], r["query"]) for r in c] == [(0, 2, "sat"), (1, 2, "sat")]
    assert {r["word"] for r in explore.similar_words(docs, "cat").collect()} == {"dog"}
    assert [(r["left"], r["right"]) for r in explore.common_contexts(docs, ["cat", "dog"]).collect()] == [("the", "sat")]
    with pytest.raises(ValueError):
        explore.common_contexts(docs, ["cat", "cow"], fail_on_unknown=True)
    t = explore.Text(docs)
    assert t.count("the") == 4 and t.index("sat") == (0, 2)
    with pytest.raises(ValueError):
        t.index("cow")


def test_language_models(spark):
    s = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "c"]), (2, ["a", "b"])], "sent_id long, tokens array<string>")
    probes = spark.createDataFrame([("b", ["a"]), ("c", ["a"]), ("a", ["<s>"]), ("zz", ["a"])], "word string, context array<string>")
    p = {r["word"]: r["prob"] for r in lm.score(lm.train(s, 2), probes).collect()}
    assert p == {"b": pytest.approx(2 / 3), "c": pytest.approx(1 / 3), "a": 1.0, "zz": 0.0}
    kn = {r["word"]: r["prob"] for r in lm.score(lm.train(s, 2, "kneser_ney_interpolated"), probes).collect()}
    # c(a) = 3, two followers, 5 bigram types; b has one predecessor
    assert kn["b"] == pytest.approx(1.25 / 3 + 0.75 * 2 / 3 / 5) and kn["zz"] == pytest.approx(0.75 * 2 / 3 / 50)
    x = lm.perplexity(lm.train(s, 2), s.limit(1)).first()["perplexity"]
    assert x == pytest.approx(2 ** (-(0 + math.log2(2 / 3) + 0) / 3))
    with pytest.raises(ValueError):
        lm.train(s, 0)


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("kind", ["mle", "lidstone", "kneser_ney_interpolated"])
def test_unknown_words_count_nothing_or_as_the_end(spark, order, kind):
    s = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "c", "b"])], "sent_id long, tokens array<string>")
    m = lm.train(s, order, kind)
    probes = [("zz", ["a"]), ("b", ["zz", "a"]), ("b", ["a", "zz"]), ("zz", ["zz", "zz"]), ("a", ["<s>"]), ("b", [])]
    table = spark.createDataFrame([(w, c, ["</s>" if x == "zz" else x for x in [w, *c]]) for w, c in probes], "word string, context array<string>, e array<string>")
    got = lm.score(m, table, unknown_as_end=True).orderBy("word", "context").collect()
    want = lm.score(m, table.select("word", "context", F.element_at("e", 1).alias("w2"), F.slice("e", 2, 5).alias("c2")), "w2", "c2").orderBy("word", "context").collect()
    assert [r["prob"] for r in got] == pytest.approx([r["prob"] for r in want], abs=0) and len(got) == len(probes)
    if kind == "mle":
        assert lm.score(m, table.filter("word = 'zz'")).filter("prob > 0").isEmpty()


def test_scratch_tables_go(spark, tmp_path):
    import os

    from lexmill.sources import shared

    with shared.scratch(spark) as path:
        with shared.scratch(spark) as inner:
            assert inner.startswith(path) and shared.stored(spark.range(3), "x").count() == 3
        by = shared.stored(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "x", "k")
        assert by.columns == ["v", "k"] and [r["v"] for r in by.filter("k = 2").collect()] == ["b"]
        here = path.removeprefix("file://")
        assert os.path.isdir(here) and not os.path.isdir(inner.removeprefix("file://"))
        assert shared.stored(by.limit(0), "x", "k").count() == 0
    assert not os.path.isdir(here)


def test_models_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(TRAIN)], "doc_id long, text string, label string")
    s = docs.select(T.ascii_tokens("text").alias("tokens"))
    probes = spark.createDataFrame([("good", ["great"])], "word string, context array<string>")
    made = [
        (learners.NaiveBayes.train(docs), lambda m: m.scores(docs)),
        (learners.PositiveNaiveBayes.train(docs.filter("label = 'pos'"), docs), lambda m: m.odds(docs)),
        (lm.train(s, 3, "lidstone"), lambda m: lm.score(m, probes)),
    ]
    for i, (model, use) in enumerate(made):
        models.save(spark, model, f"file://{tmp_path}/{i}")
        again = models.load(spark, type(model), f"file://{tmp_path}/{i}")
        rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
        assert rows(use(again)) == rows(use(model))
    with pytest.raises(ValueError):
        models.load(spark, lm.NgramModel, f"file://{tmp_path}/0")


def test_own_contexts_and_factories(spark):
    d = texts(spark, "a b a", "", None)
    after = explore.contexts_by(d, lambda t, i: F.try_element_at(t, i + 1), keep=lambda w: w == "a", key=F.upper)
    assert [tuple(r) for r in after.collect()] == [("A", "b", 1)]
    fd = spark.createDataFrame([("x", "a", 3), ("x", "b", 1), ("y", "a", 2)], "condition string, sample string, n long")
    want = {("x", "a"): 0.75, ("x", "b"): 0.25, ("y", "a"): 1.0}
    assert {(r["condition"], r["sample"]): r["prob"] for r in probability.conditional(fd, "mle").collect()} == want
    own = probability.conditional(fd, lambda fd, by, half: probability.lidstone(fd, half, 2, by), half=0.5)
    assert {(r["condition"], r["sample"]): r["prob"] for r in own.collect()} == {("x", "a"): 0.7, ("x", "b"): 0.3, ("y", "a"): pytest.approx(2.5 / 3)}


def test_counts_are_put_and_deleted(spark):
    fd = spark.createDataFrame([("a", 3), ("b", 1)], "sample string, n long")
    new = spark.createDataFrame([("a", 0), ("c", 2)], "sample string, n long")
    assert {tuple(r) for r in freqdist.put(fd, new).collect()} == {("b", 1), ("c", 2)}
    assert {tuple(r) for r in freqdist.delete(fd, new).collect()} == {("b", 1)}


def test_stems_of_normalised_tokens(spark):
    d = texts(spark, "The running Horses", "Die naïven running Läufe")
    got = [r[0] for r in d.orderBy("doc_id").select(words.normalized("text", stem=True)).collect()]
    assert got == [["run", "hors"], ["die", "naïven", "run", "läufe"]]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_metrics_of_odd_texts(spark, n):
    rows = ["a b a b", "", None, "x", "a b"]
    grams = [tuple(t.split()[i : i + n]) for t in rows if t for i in range(len(t.split()) - n + 1)]
    toks = [w for t in rows if t for w in t.split()]
    assert tuple(counts.metrics(texts(spark, *rows), n).first()) == (len(toks), len(set(toks)), len(grams), len(set(grams)))
    assert tuple(counts.metrics(texts(spark, *rows).limit(0), n).first()) == (0, 0, 0, 0)


def test_one_scan_counts_all_patterns(spark, data):
    from lexmill.operators.collocations import finder, marginals

    f = finder(spark.read.parquet(f"{data}/documents.parquet"), 4)
    plan = marginals(f)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan


TRAIN = [("good great fine story", "pos"), ("great fun and good", "pos"), ("bad awful boring story", "neg"), ("awful bad mess", "neg")] * 3
TEST = [("a good great day", "pos"), ("such an awful bad day", "neg")]


@pytest.mark.parametrize("train", [learners.train_logistic, learners.train_svm, learners.train_maxent, learners.train_perceptron, learners.DecisionTree.train])
def test_learners(spark, train):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(TRAIN)], "doc_id long, text string, label string")
    test = spark.createDataFrame([(i, *r) for i, r in enumerate(TEST)], "doc_id long, text string, gold string")
    m = train(rows)
    got = m.predict(test).collect()
    assert all(r["label"] == r["gold"] for r in got)
    again = type(m).from_json(m.to_json())
    assert [r["label"] for r in again.predict(test).collect()] == [r["label"] for r in got]


def test_logistic_equals_plain_gradient_steps(spark):
    import numpy as np

    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(TRAIN)], "doc_id long, text string, label string")
    m = learners.train_logistic(rows, epochs=3)
    x = np.zeros((len(TRAIN), len(m.vectorizer.vocabulary)))
    at = {f: i for i, f in enumerate(m.vectorizer.vocabulary)}
    for i, (t, _) in enumerate(TRAIN):
        w = t.split()
        for f in w + [a + learners.JOINER + b for a, b in zip(w, w[1:], strict=False)]:
            x[i, at[f]] += 1
    y = np.array([[label == c for c in m.labels] for _, label in TRAIN], float)
    w, b = np.zeros((2, x.shape[1])), np.zeros(2)
    for _ in range(3):
        e = (y - 1 / (1 + np.exp(-(x @ w.T + b)))).T
        w, b = w + 0.1 * (e @ x / len(x) - 1e-4 * w), b + 0.1 * e.mean(1)
    assert np.allclose(w, m.weights) and np.allclose(b, m.bias)


def test_feature_text(spark):
    df = spark.sql("SELECT map('b', 'Big Dog', 'a', CAST(NULL AS STRING), '!', 'x') AS f")
    assert one(df.select(learners.feature_text("f"))) == "feature a value null feature b value big dog"


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "gold string, pred string")
    assert {tuple(r) for r in metrics.confusion(df).collect()} == {("a", "a", 1), ("a", "b", 1), ("b", "b", 1), ("b", "a", 0)}
    assert metrics.accuracy(df.limit(0)).first()["accuracy"] == 0.0
    pairs = spark.createDataFrame([([["a", "b", "c"]], ["a", "b", "c"]), ([], ["x"])], "refs array<array<string>>, hyp array<string>")
    assert one(metrics.corpus_bleu(pairs)) == pytest.approx(1.0)
    assert one(spark.range(1).select(metrics.distance(F.lit("ab"), F.lit("ba"), transpositions=True))) == 1.0


def test_stems(spark):
    df = spark.createDataFrame([("running",), ("flies",), (None,)], "w string")
    assert {(r["w"], r["stem"]) for r in stem.stems(df, "w").collect()} == {("running", "run"), ("flies", "fli"), (None, None)}
    assert [r[0] for r in df.select(T.lancaster_stem("w")).collect()] == ["run", "fly", None]


def test_packaged_corpus(spark):
    c = corpus.mini(spark)
    assert [r["id"] for r in corpus.select(c, categories=["HOME"]).collect()] == ["garden", "kitchen"] and corpus.paras(c).count() == 6


def test_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One two.\n\nThree's four. Five!")
    (tmp_path / "b.txt").write_text("Six")
    (tmp_path / "index.json").write_text(json.dumps({"version": 1, "files": [{"id": "B", "path": "b.txt", "categories": ["News"]}, {"id": "a", "path": "a.txt", "categories": ["fun", "News"]}]}))
    c = corpus.bundle(spark, f"file://{tmp_path}/index.json")
    assert [r["id"] for r in corpus.select(c, categories=["NEWS"]).collect()] == ["B", "a"]
    assert [r["id"] for r in corpus.select(c, ids=["A"]).collect()] == ["a"]
    assert one(corpus.raw(c)) == "Six\nOne two.\n\nThree's four. Five!"
    assert corpus.paras(c).count() == 3 and corpus.sents(c).count() == 4
    assert [r["word"] for r in corpus.words(corpus.select(c, ids=["a"])).orderBy("pos").collect()] == ["one", "two", ".", "three", "'s", "four", ".", "five", "!"]
    data = {"u": b"text"}
    m = {"entries": [{"id": "x/y", "url": "u", "categories": ["c"], "sha256": hashlib.sha256(b"text").hexdigest().upper()}]}
    index = corpus.download(m, str(tmp_path / "out"), data.__getitem__)
    assert one(corpus.bundle(spark, f"file://{index}").select("text")) == "text"
    for bad in ({"entries": [{"id": "x", "url": "u", "sha256": "00"}]},):
        with pytest.raises(ValueError):
            corpus.download(bad, str(tmp_path / "out"), data.__getitem__)
    conll = spark.createDataFrame([("f", "The\tDT\ndog\t\tNN\nbroken\n\nRuns\tVB\n")], "id string, text string")
    assert [tuple(r)[1:] for r in corpus.conll_tagged(conll).orderBy("sentence", "pos").collect()] == [(0, 0, "The", "DT"), (0, 1, "dog", "NN"), (1, 0, "Runs", "VB")]
    brown = spark.createDataFrame([("f", "The/at 1/2/cd /x y/\n\nGo/vb")], "id string, text string")
    assert [tuple(r)[1:] for r in corpus.brown_tagged(brown).orderBy("sentence", "pos").collect()] == [(0, 0, "The", "at"), (0, 1, "1/2", "cd"), (1, 0, "Go", "vb")]
    chunked = spark.createDataFrame([("f", "The DT B-NP\ndog NN I-NP")], "id string, text string")
    assert [r["chunk"] for r in corpus.conll_chunked(chunked).orderBy("pos").collect()] == ["B-NP", "I-NP"]


def test_synsets(spark, tmp_path):
    from lexmill.plans.language import _PATH, _ROWS

    lex = lexicon.Lexicon(synsets.read_json(spark, f"file://{_PATH}"))
    words = spark.createDataFrame([("Horses",), ("carries",), ("fast",), ("nope",)], "word string")
    assert {r["word"]: r["lemma"] for r in lex.morphy(words).collect()} == {"Horses": "horse", "carries": "carry", "fast": "fast"}
    assert {(r["word"], r["id"]) for r in lex.lookup(words, "a").collect()} == {("fast", "fast.a.01")}
    assert {r["word"]: r["lemma"] for r in lex.lemmatize(words).collect()}["nope"] == "nope"
    info = synsets.write_packed(_ROWS, str(tmp_path / "s.bin"))
    assert info["synsets"] == len(_ROWS) and synsets.read_packed(spark, f"file://{tmp_path}/s.bin").count() == len(_ROWS)
    with pytest.raises(ValueError):
        synsets.unpack(b"nonsense")
    row = synsets.parse_data_line('00001740 03 n 02 entity 0 thing 1 001 ~ 00002000 n 0000 | what is; "a thing"')
    assert row["lemmas"] == ["entity", "thing"] and row["hyponyms"] == ["00002000.n"] and row["examples"] == ["a thing"] and row["gloss"] == "what is"


def test_stream_stitches_words(spark, tmp_path):
    chunks = [("s", 0, "The qu"), ("s", 1, "ick fox's den"), ("t", 0, "fox"), ("s", 2, None), ("t", 1, None)]
    spark.createDataFrame(chunks, "stream_id string, seq long, chunk string").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = FreqDistStream(spark, f"file://{tmp_path}/out")
    out.start(spark.readStream.schema("stream_id string, seq long, chunk string").parquet(f"{tmp_path}/in"), available_now=True).awaitTermination()
    assert {tuple(r) for r in out.tokens().collect()} == {("the", 1), ("quick", 1), ("fox's", 1), ("den", 1), ("fox", 1)}
    assert {(r["l"], r["r"]) for r in out.bigrams().collect()} == {("the", "quick"), ("quick", "fox's"), ("fox's", "den")}
    # more chunks later: state survives the restart
    spark.createDataFrame([("t", 2, "hunt"), ("t", 3, "ing"), ("t", 4, None)], "stream_id string, seq long, chunk string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out.start(spark.readStream.schema("stream_id string, seq long, chunk string").parquet(f"{tmp_path}/in"), available_now=True).awaitTermination()
    assert ("fox", "hunting", 1) in {tuple(r) for r in out.bigrams().collect()}
    j = json.loads(out.to_json())
    assert sum(x["count"] for x in j["tokens"]) == 6 and {"left", "right", "count"} == set(j["bigrams"][0])


def test_rank_is_dense(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7)
    got = counts.rank_by(df, "x").collect()
    assert all(r["rank"] == r["x"] for r in got)


@pytest.mark.parametrize("size", [3, 4])
def test_likelihood_ratio_equals_contingency_tables(spark, size):
    """Cells counted one by one; three words or four, every n-gram of a text that ends in words seen nowhere else."""
    import random
    from itertools import product

    rng = random.Random(20)
    words = [rng.choice("abcd") for _ in range(120)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = {tuple(r)[:size]: r["s"] for r in collocations.score(collocations.finder(docs, size), "likelihood_ratio").withColumnRenamed("score", "s").collect()}
    full = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    total = len(words)

    def margin(gram, place):
        if not place:
            return total
        span = place[-1] - place[0]
        return sum(all(words[i + p - place[0]] == gram[p] for p in place) for i in range(total - span))

    assert got
    for gram in full:
        s = 0.0
        for inside in product((0, 1), repeat=size):
            own = tuple(i for i in range(size) if inside[i])
            rest = [i for i in range(size) if not inside[i]]
            seen = sum((-1) ** k * margin(gram, tuple(sorted((*own, *more)))) for k in range(len(rest) + 1) for more in combinations(rest, k))
            e = math.prod(margin(gram, (i,)) if inside[i] else total - margin(gram, (i,)) for i in range(size)) / total ** (size - 1)
            x = seen / (e + 1e-20) + 1e-20
            s = math.nan if x <= 0 or math.isnan(s) else s + seen * math.log(x)
        assert (gram not in got) if math.isnan(s) else abs(got[gram] - 2 * s) < 1e-6


def test_edit_distance_query_equals_plain_distance(spark, tmp_path):
    from lexmill import catalog
    from lexmill.functions.metrics import edit_distance

    rows = [(1, 0, "u", "naïve é"), (1, 1, "a", "naive ñ"), (1, 2, "u", ""), (2, 5, "u", "日本語"), (2, 6, "a", "日本"), (2, 8, "a", "x"), (3, 0, "u", None), (3, 1, "a", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["distance"] for r in catalog.queries()["edit_distance"](spark, str(tmp_path)).collect()}
    text = {(c, t): x for c, t, _, x in rows}
    want = {(c, t): None if x is None or text[c, t + 1] is None else edit_distance(x, text[c, t + 1]) for (c, t), x in text.items() if (c, t + 1) in text}
    assert got == want and got[1, 0] == 2
