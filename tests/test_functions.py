"""Functions of single values: goldens from the definitions."""

import math
import tempfile

import pytest

from lexmill.functions import chunk, grammar, metrics, sentences, sentiment, stem, tagger, trees, words


@pytest.mark.parametrize(
    ("word", "want"),
    [p.split(">") for p in "caresses>caress ponies>poni ties>ti cats>cat feed>feed agreed>agre plastered>plaster motoring>motor conflated>conflat troubled>troubl sized>size hopping>hop falling>fall hissing>hiss failing>fail filing>file happy>happi sky>sky relational>relat conditional>condit rational>ration digitizer>digit triplicate>triplic formative>form hopefulness>hope revival>reviv adoption>adopt rate>rate controll>control roll>roll by>by".split()],
)
def test_porter(word, want):
    assert stem.porter(word) == want and stem.porter(word.upper()) == want


def test_words():
    assert words.words("I don't think it's John's, you'll see.") == ["I", "do", "n't", "think", "it", "'s", "John", "'s", ",", "you", "'ll", "see", "."]
    assert words.tweet_words("@bob call 555-123-4567 :-) soooo COOL http://x.y/z #now 👩‍💻!", preserve_case=False, strip_handles=True, reduce_len=True) == ["call", "555-123-4567", ":-)", "sooo", "cool", "http://x.y/z", "#now", "👩‍💻", "!"]
    assert words.merge_phrases("in spite of the rain in spite".split(), [["in", "spite", "of"], ["in", "spite"], ["rain"]]) == ["in_spite_of", "the", "rain", "in_spite"]


def test_sentences():
    assert sentences.heuristic_sentences("Dr. Smith came at 3.5 p.m. today. He left!") == ["Dr. Smith came at 3.5 p.m. today.", "He left!"]
    assert sentences.rule_sentences('He said "Stop." Then he ran. Version 3.2 is out... really?') == ['He said "Stop."', "Then he ran.", "Version 3.2 is out... really?"]
    assert sentences.rule_sentences("") == [] and sentences.heuristic_sentences("no end") == ["no end"]
    m = sentences.PunktModel(abbreviations=frozenset({"abt"}), scores={"abt": 1.0})
    assert sentences.model_sentences("It was abt. five. Next.", m) == ["It was abt. five.", "Next."]
    assert sentences.PunktModel.loads(m.dumps()) == m
    with pytest.raises(ValueError):
        sentences.PunktModel.loads('{"version": 2}')


def test_sentiment():
    assert sentiment.polarity("") == {"neg": 0.0, "neu": 1.0, "pos": 0.0, "compound": 0.0}
    good, very, not_ = (sentiment.polarity(t)["compound"] for t in ("This is good", "This is very good", "This is not good"))
    assert very > good > 0 > not_
    assert sentiment.polarity("good")["compound"] == round(1.9 / math.sqrt(1.9**2 + 15), 4)
    assert sentiment.polarity("This is GOOD")["compound"] > good and sentiment.polarity("This is good!!!")["compound"] > good
    assert sentiment.polarity("zork", {"zork": -3.0})["neg"] == 1.0


def test_metrics():
    assert metrics.edit_distance("kitten", "sitting") == 3
    assert metrics.edit_distance("ab", "ba") == 2 and metrics.edit_distance("ab", "ba", transpositions=True) == 1
    assert metrics.edit_distance("a", "b", substitution=2) == 2
    same = "the cat sat on the mat".split()
    assert metrics.sentence_bleu([same], same) == pytest.approx(1.0)
    assert metrics.sentence_bleu([same], same[:3]) < 0.6 and metrics.sentence_bleu([], same) == 0.0
    assert metrics.bleu_counts([["a"] * 3, ["a"] * 5], ["a"] * 4)[3] == 3  # closest lengths tie: the shorter


CFG = """
# a comment
S -> NP VP
NP -> 'the' N | 'the' N PP
VP -> V NP | V NP PP
PP -> P NP
N -> 'dog' | 'man' | 'park'
V -> 'saw'
P -> 'in'
"""


def test_parsers_agree():
    g = grammar.cfg(CFG)
    s = "the dog saw the man in the park".split()
    plain = {trees.to_bracket(t) for t in grammar.descent_parse(s, g)}
    assert plain == {trees.to_bracket(t) for t in grammar.descent_parse(s, g, left_corner=True)} and len(plain) == 2
    assert len(grammar.chart_parse(s, g)) == len(grammar.earley_parse(s, g)) == 2
    for bad in (["the"], ["the", "dog", "saw"], ["cat"], []):
        assert not grammar.recognize(bad, g) and not grammar.earley_recognize(bad, g) and not grammar.descent_parse(bad, g) and not grammar.chart_parse(bad, g)
    with pytest.raises(ValueError):
        grammar.cfg("# nothing")


def test_long_runs_are_parsed(spark):
    """Runs of more than four words get trees and a verdict, very long ones too."""
    from lexmill.plans import language

    runs = ["the on in is this of by", "it is the of", "it is the of and to", "a of in are the in of", "the " * 30_000, "word " * 30_000]
    df = spark.createDataFrame([(i, r.strip(), "en", "a", len(r)) for i, r in enumerate(runs)], "doc_id long, text string, lang string, source string, n_chars long")
    with tempfile.TemporaryDirectory() as d:
        df.write.parquet(f"{d}/documents.parquet")
        verdict = {r["sentence"]: r["accepted"] for r in language.QUERIES["cfg_recognize"](spark, d).collect()}
        g, f = grammar.cfg(language.GRAMMAR), grammar.feature_cfg(language.FEATURES)
        assert verdict == {r.strip(): len(r) < 100 and grammar.recognize(r.split(), g) for r in runs} and verdict[runs[0]]
        for name, parse in (("cfg_chart", lambda t: grammar.chart_parse(t, g)), ("cfg_earley", lambda t: grammar.earley_parse(t, g)), ("cfg_recursive_descent", lambda t: grammar.descent_parse(t, g)), ("cfg_left_corner", lambda t: grammar.descent_parse(t, g, left_corner=True)), ("feature_parse", lambda t: grammar.feature_parse(t, f))):
            got = {(r["sentence"], r["tree"]) for r in language.QUERIES[name](spark, d).collect()}
            assert got == {(r, trees.to_bracket(t)) for r in runs[:4] for t in parse(r.split())}
        assert {r["sentence"] for r in language.QUERIES["pcfg_viterbi"](spark, d).collect()} == {r for r in runs[:4] if verdict[r]}


def test_derivable_lengths():
    assert grammar._reach(grammar.cfg("S -> A B\nA -> 'x' 'y' | 'x'\nB -> A | A A")) == ({"x", "y"}, 6)
    assert grammar._reach(grammar.cfg(CFG))[1] == math.inf
    assert not grammar.possible(["x"] * 7, grammar.cfg("S -> A B\nA -> 'x' 'y' | 'x'\nB -> A | A A"))


def test_weights():
    g = grammar.pcfg("S -> A S [0.4] | A [0.6]\nA -> 'a' | 'b'")
    assert {r[1]: pytest.approx(math.exp(r[2])) for r in g.rules} == {("A", "S"): 0.4, ("A",): 0.6, ("a",): 0.5, ("b",): 0.5}
    tree, p = grammar.viterbi_parse(["a", "b"], g)
    assert trees.to_bracket(tree) == "(S (A a) (S (A b)))" and math.exp(p) == pytest.approx(0.4 * 0.6 * 0.25)
    assert grammar.viterbi_parse(["c"], g) is None


def test_features_unify():
    g = grammar.feature_cfg("S -> NP[num=?n] VP[num=?n]\nNP[num=sg] -> 'dog'\nNP[num=pl] -> 'dogs'\nVP[num=sg] -> 'runs'\nVP[num=pl] -> 'run'")
    assert [trees.to_bracket(t) for t in grammar.feature_parse(["dogs", "run"], g)] == ["(S (NP[num=pl] dogs) (VP[num=pl] run))"]
    assert grammar.feature_parse(["dog", "run"], g) == []


def test_trees():
    t = trees.from_bracket("(S (NP (N dog)) (VP (V runs)))")
    assert trees.to_bracket(t) == "(S (NP (N dog)) (VP (V runs)))" and trees.leaves(t) == ["dog", "runs"] and trees.depth(t) == 3
    assert trees.to_bracket(trees.collapse_unary(t)) == "(S (NP+N dog) (VP+V runs))"
    assert trees.to_bracket(trees.map_labels(t, str.lower)) == "(s (np (n dog)) (vp (v runs)))"
    for bad in ("dog", "(S", "(S a) b", "()"):
        with pytest.raises(ValueError):
            trees.from_bracket(bad)


def test_chunks_and_dependencies():
    g = chunk.rules("NP: {<DT>?<JJ>*<NN.*>+}\nVP: {<VB.*>}")
    assert chunk.iob("DT JJ NN VBD DT NN NN IN".split(), g) == "B-NP I-NP I-NP B-VP B-NP I-NP I-NP O".split()
    d = chunk.dependencies(["The", "dog", "saw", "old", "cats", "."], ["DT", "NN", "VBD", "JJ", "NNS", "."])
    assert d["root"] == 2 and [(a["head"], a["dep"], a["relation"]) for a in d["arcs"]] == [(2, 0, "dep"), (2, 1, "nsubj"), (4, 3, "amod"), (2, 4, "obj"), (2, 5, "punct")]
    assert chunk.dependencies([], []) == {"tokens": [], "tags": [], "root": -1, "arcs": []}


def test_tagger_learns_and_round_trips():
    held = tagger.invented_corpus(100, seed=99)
    m = tagger.default_model()
    right = sum(a == t for s in held for a, (_, t) in zip(m.tag([w for w, _ in s]), s, strict=True))
    assert right / sum(map(len, held)) > 0.95
    again = tagger.TaggerModel.loads(m.dumps())
    assert again.tag(["the", "dog", "jumped"]) == m.tag(["the", "dog", "jumped"])
    with pytest.raises(ValueError):
        tagger.TaggerModel.loads('{"tags": ["A"], "feature_count": 2, "feature_index": {}, "weights": [1]}')
