"""Looking around in texts: concordances, words in like contexts, contexts in common.

Tables of tokens are (doc_id, pos, token). Contexts never reach over a document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def concordance(docs: DataFrame, phrase: str | Sequence[str], width: int = 80, lines: int | None = None, tokens: Callable = T.word_tokens, key: Callable[[Column], Column] = F.lower) -> DataFrame:
    """doc_id, pos, left, query, right, line of each place of a word or phrase, by place; the first lines of them if given."""
    words = [phrase] if isinstance(phrase, str) else list(phrase)
    if not words:
        raise ValueError("the phrase is empty")
    n = len(words)
    toks = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    want = F.array(*(key(F.lit(w)) for w in words))
    keyed = toks.withColumn("k", F.transform("t", key)).filter(F.arrays_overlap("k", F.slice(want, 1, 1)))
    places = F.sequence(F.lit(1), F.size("k") - (n - 1))
    hits = F.when(F.size("k") >= n, F.filter(places, lambda i: F.slice("k", i, n) == want)).otherwise(F.array().cast("array<int>"))
    rows = keyed.select("doc_id", "t", F.explode(hits).alias("i"))
    around = max(1, width // 4)
    query = F.array_join(F.slice("t", F.col("i"), F.lit(n)), " ")
    half = F.floor((F.lit(width) - F.length("query") - 2) / 2).cast("int")
    first = F.greatest(F.lit(1), F.col("i") - around)
    rows = rows.withColumn("query", query)
    before = F.array_join(F.slice("t", first, F.col("i") - first), " ")
    after = F.array_join(F.slice("t", F.col("i") + n, F.greatest(F.lit(0), F.least(F.lit(around), F.size("t") - (F.col("i") + n - 1)))), " ")
    rows = rows.select("doc_id", (F.col("i") - 1).alias("pos"), F.right(before, half).alias("left"), "query", F.left(after, half).alias("right"), half.alias("half"))
    line = F.rtrim(F.concat(F.lpad("left", F.col("half"), F.lit(" ")), F.lit(" "), F.col("query"), F.lit(" "), F.col("right")))
    out = rows.select("doc_id", "pos", "left", "query", "right", line.alias("line"))
    return out.orderBy("doc_id", "pos").limit(lines) if lines is not None else out


def contexts(docs: DataFrame, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(word, left, right, n): a word between its neighbours; a document's ends are *START* and *END*."""
    toks = docs.select(T.ascii_tokens("text").alias("t"))
    left = F.concat(F.array(F.lit("*START*")), F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))))
    right = F.concat(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), F.array(F.lit("*END*")))
    rows = toks.filter(F.size("t") > 0).select(F.explode(F.arrays_zip(F.col("t").alias("word"), left.alias("left"), right.alias("right")).cast("array<struct<word:string,left:string,right:string>>")).alias("x")).select("x.*")
    if keep is not None:
        rows = rows.filter(keep(F.col("word")))
    return rows.groupBy("word", "left", "right").agg(F.count("*").alias("n"))


def contexts_by(docs: DataFrame, context: Callable[[Column, Column], Column], keep: Callable[[Column], Column] | None = None, key: Callable[[Column], Column] | None = None, tokens: Callable = T.ascii_tokens) -> DataFrame:
    """(word, context, n) with a context of the caller's own: context(tokens, i) of the token at place i, from 1. key maps
    words before they are counted, keep says which words count; null contexts are left out."""
    rows = docs.select(tokens(F.col("text")).alias("t")).select("t", F.posexplode("t").alias("i", "word"))
    rows = rows.select(F.col("word"), context(F.col("t"), F.col("i") + 1).alias("context")).filter("context is not null")
    rows = rows if keep is None else rows.filter(keep(F.col("word")))
    rows = rows if key is None else rows.withColumn("word", key(F.col("word")))
    return rows.groupBy("word", "context").agg(F.count("*").alias("n"))


def similar_words(docs: DataFrame, word: str, k: int = 20, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """The words in the contexts of a word: (word, score), score the sum of products of counts.

    Only the one word's contexts are joined, so that frequent contexts don't square.
    """
    ctx = contexts(docs, keep)
    own = ctx.filter(F.col("word") == word.lower()).select("left", "right", F.col("n").alias("m"))
    out = ctx.filter(F.col("word") != word.lower()).join(own, ["left", "right"]).groupBy("word").agg(F.sum(F.col("n") * F.col("m")).alias("score"))
    return out.orderBy(F.desc("score"), "word").limit(k)


def common_contexts(docs: DataFrame, words: Sequence[str], k: int | None = None, fail_on_unknown: bool = False) -> DataFrame:
    """(left, right, n) of contexts in which all the words occur; n counts each listed word's uses."""
    low = [w.lower() for w in words]
    listed = docs.sparkSession.createDataFrame([(w, low.count(w)) for w in sorted(set(low))], "word string, times int")
    ctx = contexts(docs).join(F.broadcast(listed), "word")
    if fail_on_unknown:
        known = {r["word"] for r in ctx.select("word").distinct().collect()}
        if missing := sorted(set(low) - known):
            raise ValueError(f"not in the text: {', '.join(missing)}")
    out = ctx.groupBy("left", "right").agg(F.sum(F.col("n") * F.col("times")).alias("n"), F.count_distinct("word").alias("w")).filter(F.col("w") == len(set(low))).drop("w")
    return out.orderBy(F.desc("n"), "left", "right").limit(k) if k is not None else out


class Text:
    """One collection of documents to look around in."""

    def __init__(self, docs: DataFrame, name: str | None = None):
        self.docs = docs
        self.name = name

    def _tokens(self) -> DataFrame:
        return self.docs.select("doc_id", F.posexplode(T.word_tokens("text")).alias("pos", "token"))

    def count(self, word: str) -> int:
        return self._tokens().filter(F.col("token") == word).count()

    def index(self, word: str) -> tuple[int, int]:
        """Document and place of the first use."""
        first = self._tokens().filter(F.col("token") == word).agg(F.min(F.struct("doc_id", "pos"))).first()[0]
        if first is None:
            raise ValueError(f"{word} is not in the text")
        return first[0], first[1]

    def vocab(self) -> DataFrame:
        return self._tokens().groupBy(F.col("token").alias("sample")).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))

    def concordance(self, word: str | Sequence[str], width: int = 79, lines: int = 25) -> DataFrame:
        return concordance(self.docs, word, width, lines)

    def collocations(self, k: int = 20, window: int = 2) -> DataFrame:
        from .collocations import text_collocations

        return text_collocations(self.docs, k, window).select(F.concat_ws(" ", "w1", "w2").alias("collocation"), "score")

    def similar(self, word: str, k: int = 20) -> DataFrame:
        return similar_words(self.docs, word, k, lambda w: w.rlike("^[a-z]"))

    def common_contexts(self, words: Sequence[str], k: int = 20) -> DataFrame:
        return common_contexts(self.docs, words, k)
