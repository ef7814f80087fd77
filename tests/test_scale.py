"""Queries on tables of a shape that only larger data has, against their SQL."""

import duckdb
import pytest

from lexmill import catalog


def same(spark, name, folder, at):
    """Rows of a query over a folder that its SQL hasn't, and the other way round."""
    catalog.queries()[name](spark, folder).write.parquet(f"file://{at}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    con.execute(f"CREATE TABLE want AS {catalog.oracle_sql()[name]}")
    cols = ", ".join(f'"{r[0]}"' for r in con.execute("SELECT column_name FROM (DESCRIBE want)").fetchall())
    con.execute(f"CREATE TABLE got AS SELECT {cols} FROM '{at}/*.parquet'")
    return con.execute(f"SELECT (SELECT count(*) FROM got), (SELECT count(*) FROM (FROM got EXCEPT ALL FROM want)), (SELECT count(*) FROM (FROM want EXCEPT ALL FROM got))").fetchone()


@pytest.fixture(scope="module")
def many_words(spark, tmp_path_factory):
    """More different words of one language than the 1,000,000 bins of the queries."""
    at = tmp_path_factory.mktemp("words")
    words = spark.range(1_100_000, numPartitions=4).selectExpr("id % 1100 AS doc_id", "concat('w', hex(id), if(id % 7 = 0, ' again', '')) AS w")
    docs = words.groupBy("doc_id").agg({"w": "collect_list"}).selectExpr("doc_id", "array_join(array_sort(`collect_list(w)`), ' ') AS text", "'en' AS lang")
    docs.write.parquet(f"file://{at}/documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["prob_lidstone", "prob_good_turing"])
def test_more_samples_than_bins(spark, many_words, tmp_path, name):
    rows, more, less = same(spark, name, many_words, tmp_path / "out")
    assert (rows, more, less) == (1_100_001, 0, 0)


@pytest.mark.parametrize(("size", "joins"), [(2, 1), (3, 2), (4, 3)])
def test_marginals_take_one_join_a_size(spark, size, joins):
    """Joins move the table of all n-grams: what it takes on disk is their number."""
    from lexmill.operators.collocations import finder, marginals

    plan = marginals(finder(spark.createDataFrame([(1, "a b a b c d")], "doc_id long, text string"), size))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, (") + plan.count("Join LeftOuter") == joins


def test_counts_move_a_row_for_each_word(spark):
    """Not one for each pattern: the shuffle that counts n-grams has as many rows as the documents have words."""
    from lexmill.operators import collocations

    docs = spark.createDataFrame([(i, "a b c d e f g h") for i in range(5)], "doc_id long, text string")
    store, seen = collocations.stored, []
    collocations.stored = lambda df, *a, **k: seen.append(df) or store(df, *a, **k)
    try:
        collocations.finder(docs, 4)
        collocations.finder(docs, 3, 4)
    finally:
        collocations.stored = store
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") > plan.index("HashAggregate") and "partial_count" in plan[: plan.index("Exchange hashpartitioning")]


def _ordered(folder, seed, n, d, k):
    """Examples of a random kind, some without features, as lists and as what the learners take."""
    import numpy as np
    import pyarrow as pa

    from lexmill.operators import learners

    rng = np.random.default_rng(seed)
    rows = [(sorted(rng.choice(d, rng.integers(0, 6), replace=False).tolist()), int(rng.integers(k))) for _ in range(n)]
    rows = [(ids, [float(rng.integers(1, 4)) for _ in ids], y) for ids, y in rows] + [([], [], 0)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([np.array(r[0], np.uint16).tobytes() for r in part]), pa.array([np.array(r[1], np.float32).tobytes() for r in part]), pa.array([r[2] for r in part], pa.int32())], names=["ids", "values", "label"])
        for part in (rows[:7], rows[7:])
    ]
    return rows, learners.Ordered.read(iter(batches), np.uint16, str(folder))


@pytest.mark.parametrize("k", [2, 3])
def test_steps_equal_plain_ones(tmp_path, k):
    """Softmax and perceptron steps over mapped examples, against one numpy call after another."""
    import numpy as np

    from lexmill.operators import learners

    rows, data = _ordered(tmp_path, k, 600, 12, k)
    w, b = np.zeros((k, 12)), np.zeros(k)
    for _ in range(4):
        for ids, values, y in rows:
            x = np.array(values)
            z = b + (w[:, ids] @ x if ids else 0.0)
            p = np.exp(z - z.max())
            e = -p / p.sum()
            e[y] += 1
            b += 0.15 * e
            w[:, ids] = w[:, ids] + 0.15 * (e[:, None] * x - 1e-4 * w[:, ids])
    got = learners._softmax_steps(data, k, 12, 4, 0.15, 1e-4)
    assert np.array_equal(got[0], w) and np.array_equal(got[1], b)
    w, b = np.zeros((k, 12)), np.zeros(k)
    sw, sb = np.zeros((k, 12)), np.zeros(k)
    for _ in range(5):
        for ids, _values, y in rows:
            guess = int(np.argmax(b + w[:, ids].sum(1)))
            if guess != y:
                b[y] += 1
                b[guess] -= 1
                w[y, ids] += 1
                w[guess, ids] -= 1
            sw, sb = sw + w, sb + b
    got = learners._perceptron_steps(data, k, 12, 5, 1.0)
    assert np.allclose(got[0], sw / (5 * len(rows))) and np.allclose(got[1], sb / (5 * len(rows)))


def test_examples_are_bytes(spark):
    """Texts that are null or have no words are examples too."""
    import numpy as np

    from lexmill.operators import learners

    rows = spark.createDataFrame([(1, "a b a", "x"), (2, None, "y"), (3, "", "x"), (4, "c b", "y"), (5, "a", None)], "doc_id long, text string, label string").repartition(1)
    v = learners.Vectorizer(vocabulary=["a", "b", "c"])
    got = learners._examples(rows, v, ["x", "y"], "doc_id").orderBy("doc_id").collect()
    assert [(r["doc_id"], np.frombuffer(r["ids"], np.uint16).tolist(), np.frombuffer(r["values"], np.float32).tolist(), r["label"]) for r in got] == [(1, [0, 1], [2.0, 1.0], 0), (2, [], [], 1), (3, [], [], 0), (4, [1, 2], [1.0, 1.0], 1)]


def test_batches_to_python_are_bounded(spark, tmp_path):
    """By bytes, for every query: 10,000 long texts at once are gigabytes of a worker's memory."""
    from lexmill.functions.arrow import arrow_function
    from lexmill.sources.shared import BATCH_BYTES
    from lexmill.sources.tables import table

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        spark.range(4000, numPartitions=1).selectExpr("id AS doc_id", "repeat('some words ', 1000) AS text").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
        docs = table(spark, f"file://{tmp_path}", "documents")
        assert int(spark.conf.get(name)) == BATCH_BYTES
        # the cache of a batch's inputs begins anew with each: the same text is seen once a batch
        seen = []
        counted = arrow_function(lambda t: (seen.append(1), len(seen))[1], "int")
        assert docs.select(counted("text").alias("n")).distinct().count() > 5
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("name", ["ngram_freq_3", "ngram_freq_hash", "everygram_counts", "skipgram_counts"])
def test_grams_are_strings_made_without_lambdas(spark, tmp_path, name):
    """Texts that are null, empty or shorter than a gram; no lambda a token, no grouping by arrays."""
    texts = ["a b c a b", "", None, "x", "it's a b", "a b"]
    at = tmp_path / "in"
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"file://{at}/documents.parquet")
    plan = catalog.queries()[name](spark, str(at))._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "transform(" not in plan
    rows, more, less = same(spark, name, str(at), tmp_path / "out")
    assert rows and (more, less) == (0, 0)


def test_window_statistics_take_one_join(spark):
    from lexmill.operators import counts

    plan = counts.window_stats(spark.createDataFrame([(1, "a b a b c d")], "doc_id long, text string"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, (") == 1


@pytest.mark.parametrize("cells", [1 << 23, 1])
def test_tree_levels_take_the_same_plan(spark, monkeypatch, cells):
    """A level's job is as large as that before it, splits don't pile up in a column's expression; and the tree is that of
    counts made one by one, also where nodes are counted in turns."""
    from lexmill.operators import learners

    monkeypatch.setattr(learners, "CELLS", cells)
    rows = [(i, " ".join(w for j, w in enumerate("a b c d e f".split()) if i >> j & 1) or None, "xyz"[(i * i + i // 7) % 3]) for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3)
    plans = []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or collect(df))
    tree = learners.DecisionTree.train(docs)
    levels = [len(plan) for cols, plan in plans if "by" in cols]
    assert len(levels) >= 3 and max(levels) < min(levels) + 50
    bags = [({*text.split(), *map(learners.JOINER.join, zip(text.split(), text.split()[1:], strict=False))} if text else set(), y) for _, text, y in rows]

    def check(node, some):
        counts = {y: sum(y == k for _, k in some) for y in {k for _, k in some}}
        if "feature" not in node:
            assert node["counts"] == counts and node["label"] == min(counts, key=lambda y: (-counts[y], y))
            return
        f = tree.vectorizer.vocabulary[node["feature"]]
        check(node["absent"], [x for x in some if f not in x[0]])
        check(node["present"], [x for x in some if f in x[0]])

    check(tree.tree, bags)
    got = {r["doc_id"]: r["label"] for r in tree.predict(docs.drop("label")).collect()}

    def walk(bag):
        at = tree.tree
        while "feature" in at:
            at = at["present" if tree.vectorizer.vocabulary[at["feature"]] in bag else "absent"]
        return at["label"]

    assert got == {i: walk(bag) if text is not None else None for (i, text, _), (bag, _) in zip(rows, bags, strict=True)}


def test_encoder_equals_plain_lookup(spark):
    """n-grams of one to three words; beginnings that are no features themselves, unknown words, texts null and empty."""
    from lexmill.operators import learners

    J = learners.JOINER
    v = learners.Vectorizer(1, 3, False, vocabulary=[f"b{J}c", "a", f"a{J}b{J}c", f"c{J}c", "d"])
    texts = ["A b c a B c", None, "", "c c c", "x b", "c d, a' b", "b"]
    got = {r["i"]: r["x"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1).select("i", v.encode("text").alias("x")).collect()}
    assert {i: x and (x["ids"], x["values"]) for i, x in got.items()} == {0: ([0, 1, 2], [2.0, 2.0, 2.0]), 1: None, 2: ([], []), 3: ([3], [2.0]), 4: ([], []), 5: ([4], [1.0]), 6: ([], [])}


@pytest.mark.parametrize("rules", ["NP: {<DT>?<NN.*>+}\nVP: {<VB.*><RB>?}", "A: {<NN>*<NNP>?<NN>}\nB: {<XX>*<CD>+<DT|CC>*}\nC: {<.*>}", "A: {<XX>}\nB: {<RB>?}", ""])
def test_chunks_of_whole_batches(spark, rules):
    """Labels of all texts at once equal those of one text after another; no lambda and no Python call a token."""
    import re

    from lexmill.functions import chunk
    from lexmill.functions import text as T

    words = "the a 12 running walked quickly and is Paris house It's x ' B".split()
    texts = [" ".join(words[(i * i + j * (i + 3)) % len(words)] for j in range(i % 9)) for i in range(80)] + [None, "", "é the\nhouse", "…"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = chunk.chunked(docs, rules)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    tagged = docs.selectExpr("doc_id", "regexp_extract_all(text, \"[A-Za-z0-9']+\", 0) AS t").selectExpr("doc_id", "posexplode(t) AS (pos, token)").withColumn("tag", T.rule_tag("token"))
    want, by = [], {}
    for r in tagged.orderBy("doc_id", "pos").collect():
        by.setdefault(r["doc_id"], []).append((r["token"], r["tag"]))
    for i, rows in by.items():
        assert [t for t, _ in rows] == re.findall("[A-Za-z0-9']+", texts[i])
        want += [(i, p, t, g, x) for p, ((t, g), x) in enumerate(zip(rows, chunk.iob([g for _, g in rows], chunk.rules(rules)), strict=True))]
    assert sorted(map(tuple, out.collect())) == want


_TAGGED = ["a b c\nd e f\n\n  \ng h i j\nk l", None, "", "\n\n", "x\ty\tz\r\n\r\n a  b\tc \n\t\n1 2 3\n", "\ta b\n   b c\nonly", "q\t\tr\n \t \nx \t y\n\tt\tu\n", "the/DT a/b/c /x y/ z\n \n//q w/   v/NN é/NN", "p/q\r\n\r\nr/s t/u\n"]


def _texts(spark):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(_TAGGED)], "id string, text string").coalesce(1)


@pytest.mark.parametrize("kind", ["conll_chunked", "conll_tagged"])
def test_lines_of_tagged_texts_are_not_moved(spark, kind):
    """Sentences and places are counted where the text lies, as plain Python counts them; no shuffle, no sort."""
    import re

    from lexmill.sources import corpus

    out = getattr(corpus, kind)(_texts(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    want = []
    for i, text in enumerate(_TAGGED):
        sentence, pos, before = -1, 0, True
        for line in re.split(r"\r?\n", text) if text is not None else []:
            if not line.strip(" "):
                before = True
                continue
            if before:
                sentence, pos, before = sentence + 1, 0, False
            if kind == "conll_chunked":
                p = re.split(r"[ \t\n\v\f\r]+", line.strip(" "))[:3]
                good = len(p) == 3
            else:
                p = [x.strip(" ") for x in re.split(r"\t+", line)[:2]]
                good = len(p) == 2 and all(p)
            if good:
                want.append((str(i), sentence, pos, *p))
                pos += 1
    assert [tuple(r) for r in out.collect()] == want


@pytest.mark.parametrize("name", ["corpus_brown", "corpus_conll_tagged", "corpus_conll_chunked"])
def test_documents_as_tagged_texts(spark, tmp_path, name):
    """Texts that are null, empty, without words, with empty lines, and several lines in a batch of many texts."""
    texts = ["The house is 12\n\nit's walking quickly", None, "", "\n", "é…\n!\nA b", "x", "one\ntwo\n", "\nNNP Paris"]
    at = tmp_path / "in"
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"file://{at}/documents.parquet")
    assert "lambda" not in catalog.queries()[name](spark, str(at))._jdf.queryExecution().optimizedPlan().toString()
    rows, more, less = same(spark, name, str(at), tmp_path / "out")
    assert rows and (more, less) == (0, 0)


def test_brown_items_without_lambdas(spark):
    import re

    from lexmill.sources import corpus

    out = corpus.brown_tagged(_texts(spark))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for i, text in enumerate(_TAGGED):
        full = [x.strip(" ") for x in re.split(r"\r?\n", text or "") if x.strip(" ")]
        for s, line in enumerate(full):
            items = [m for x in re.split(r"[ \t\n\v\f\r]+", line) if (m := re.fullmatch(r"([^\n\r\u0085\u2028\u2029]+)/([^/]+)", x))]
            want += [(str(i), s, p, m[1], m[2]) for p, m in enumerate(items)]
    assert [tuple(r) for r in out.collect()] == want


def test_tweets_go_to_python_once(spark, monkeypatch):
    """Tokens equal those of whole texts, also where telephone numbers have white space within; equal pieces are one call."""
    from collections import Counter

    from lexmill.functions import words

    parts = ["call", "(555)", "123", "-", "4567", "12-", "-34", "12", "it's", "#tag", "@you", ":-)", "soooooo", "https://x.y/z?1", "(12)", "5)", "é", "٣", "👍🏽", "8)", "x-1", "", "漢字", "NO"]
    blanks = [" ", "  ", "\n", "\u00a0", "\u2028 ", "\t", "\x1c", "\u3000", "\x85"]
    texts = ["".join(parts[(i * 7 + j * j * (i % 11 + 1) + j) % len(parts)] + blanks[(i + j * (i % 5)) % len(blanks)] for j in range(12)) for i in range(300)] + [None, "", " ", "1 - 2", "(123)  4 -5"]
    want = Counter(w for t in texts if t is not None for w in words.tweet_words(t, preserve_case=False, reduce_len=True))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["token"]: r["n"] for r in words.tweet_counts(docs, preserve_case=False, reduce_len=True).collect()}
    assert got == want
    plan = words.tweet_counts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Aggregate [piece")


def test_neighbours_are_counted_before_they_move(spark, tmp_path, monkeypatch):
    """Pairs with short and stop words are no rows of their own; texts null, empty, of one word, pairs at batches' ends."""
    from lexmill.operators import collocations

    texts = ["new york is in the state of new york", "", None, "york", "New York's new york", "it's odd", "red tape red tape the red tape and tape"] * 5
    at = tmp_path / "in"
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"file://{at}/documents.parquet")
    store, seen = collocations.stored, []
    monkeypatch.setattr(collocations, "stored", lambda df, *a, **k: seen.append(df) or store(df, *a, **k))
    rows, more, less = same(spark, "text_collocations", str(at), tmp_path / "out")
    assert rows and (more, less) == (0, 0)
    pairs = [(r["w1"], r["w2"]) for r in seen[0].collect()]
    assert len(pairs) == len(set(pairs)) and all(w2 is None or min(len(w1), len(w2)) > 2 and not {w1, w2} & set(collocations.COLLOCATION_STOP) for w1, w2 in pairs)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(w1") == 1 and "partial_sum" in plan[plan.index("Exchange hashpartitioning(w1") :]


def test_scores_are_rounded_once(spark):
    from lexmill.operators import collocations

    f = collocations.finder(spark.createDataFrame([(1, "a b a b c d")], "doc_id long, text string"), 2)
    plan = collocations.score(f, "likelihood_ratio", 9)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("round(") == 1
