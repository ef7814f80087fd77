"""n-gram language models as count tables, scored by joins.

Counts of all orders lie in one table (order, context, word, n); a context is its words with blanks between. Sentences are
lower-cased and padded with <s> and </s>.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

START, END = "<s>", "</s>"


@dataclass(frozen=True)
class NgramModel:
    """counts (order, context, word, n); contexts (context, n, followers); words (word, continuations); V, types, unigrams
    are in stats, one row."""

    order: int
    model: str
    gamma: float
    discount: float
    counts: DataFrame
    contexts: DataFrame
    words: DataFrame
    stats: DataFrame


def padded(tokens: Column, order: int, left: bool = True, right: bool = True) -> Column:
    parts = [F.array_repeat(F.lit(START), order - 1)] if left and order > 1 else []
    parts.append(F.transform(tokens, ascii_lower))
    if right:
        parts.append(F.array(F.lit(END)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def train(sentences: DataFrame, order: int = 3, model: str = "mle", tokens: str = "tokens", gamma: float = 0.1, discount: float = 0.75, left: bool = True, right: bool = True) -> NgramModel:
    """Of a table with an array of tokens a sentence."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    if model not in ("mle", "lidstone", "kneser_ney_interpolated"):
        raise ValueError(f"no such model: {model}")
    padded_ = sentences.select(padded(F.col(tokens), order, left, right).alias("t"))

    def runs(n: int) -> Column:
        at = F.sequence(F.lit(1), F.size("t") - (n - 1))
        one = F.transform(at, lambda i: F.struct(F.lit(n).alias("order"), F.array_join(F.slice("t", i, n - 1), " ").alias("context"), F.element_at("t", i + n - 1).alias("word")))
        return F.when(F.size("t") >= n, one).otherwise(F.array().cast("array<struct<order:int,context:string,word:string>>"))

    grams = [runs(n) for n in range(1, order + 1)]
    counts = padded_.select(F.explode(F.concat(*grams)).alias("g")).groupBy("g.order", "g.context", "g.word").agg(F.count("*").alias("n"))
    whole = counts.select(F.concat_ws(" ", F.when(F.col("context") != "", F.col("context")), "word").alias("context"), "n")
    followers = counts.filter("order > 1").groupBy("context").agg(F.count("*").alias("followers"))
    contexts = whole.join(followers, "context", "left").select("context", "n", F.coalesce("followers", F.lit(0)).alias("followers"))
    words = counts.filter("order = 2").groupBy("word").agg(F.count("*").alias("continuations"))
    stats = counts.filter("order = 1").agg(F.count("*").alias("V"), F.sum("n").alias("unigrams")).crossJoin(words.agg(F.coalesce(F.sum("continuations"), F.lit(0)).alias("types")))
    return NgramModel(order, model, gamma, discount, counts, contexts, words, stats)


def _known(m: NgramModel, df: DataFrame, column: str) -> DataFrame:
    """df with END in place of words that training never saw."""
    seen = m.counts.filter("order = 1").select(F.col("word").alias(column), F.lit(True).alias("__known"))
    here = F.col(column)
    return df.join(seen, column, "left").withColumn(column, F.when(here.isNull() | F.col("__known") | (here == START), here).otherwise(END)).drop("__known")


def score(m: NgramModel, probes: DataFrame, word: str = "word", context: str = "context", unknown_as_end: bool = False) -> DataFrame:
    """probes with prob. context is an array of words, of which the last order - 1 count.

    A word that training never saw counts 0, in the word's place and in the context; or, as in batch evaluation, it is taken
    for the end of a sentence in both.
    """
    keep = F.least(F.size(context), F.lit(m.order - 1))
    ctx = F.transform(F.when(keep > 0, F.slice(context, F.size(context) - keep + 1, keep)).otherwise(F.array().cast("array<string>")), ascii_lower)
    df = probes.withColumns({"__w": ascii_lower(word), "__c": ctx})
    if unknown_as_end:
        places = [f"__u{i}" for i in range(m.order - 1)]
        df = df.withColumns({c: F.try_element_at("__c", F.lit(-i - 1)) for i, c in enumerate(places)})
        for c in ["__w", *places]:
            df = _known(m, df, c)
        df = df.withColumn("__c", F.filter(F.array(*reversed(places)).cast("array<string>"), lambda x: x.isNotNull()))
    df = df.crossJoin(F.broadcast(m.stats))
    for n in range(m.order):
        # the context's last n words; null where it is shorter
        part = F.when(F.size("__c") >= n, F.array_join(F.slice("__c", F.size("__c") - n + 1, n), " ") if n else F.lit(""))
        df = df.withColumn(f"__p{n}", part)
        hit = m.counts.filter(F.col("order") == n + 1).select(F.col("context").alias(f"__p{n}"), F.col("word").alias("__w"), F.col("n").alias(f"__n{n}"))
        df = df.join(hit, [f"__p{n}", "__w"], "left")
        if n:
            own = m.contexts.select(F.col("context").alias(f"__p{n}"), F.col("n").alias(f"__t{n}"), F.col("followers").alias(f"__f{n}"))
            df = df.join(own, f"__p{n}", "left")
        else:
            df = df.withColumn("__t0", F.col("unigrams"))
    num = lambda n: F.coalesce(F.col(f"__n{n}"), F.lit(0)).cast("double")
    if m.model == "kneser_ney_interpolated":
        df = df.join(m.words.select(F.col("word").alias("__w"), "continuations"), "__w", "left")
        base = F.coalesce("continuations", F.lit(0)) / F.col("types")
        p = F.when(F.col("types") == 0, 1 / F.col("V")).when(base == 0, 1 / (F.col("types") * 10)).otherwise(base)
        for n in range(1, m.order):
            t = F.col(f"__t{n}")
            p = F.when(t.isNull(), p).otherwise(F.greatest(num(n) - m.discount, F.lit(0.0)) / t + m.discount * F.col(f"__f{n}") / t * p)
    else:
        gamma = m.gamma if m.model == "lidstone" else 0.0
        at = lambda n: (num(n) + gamma) / (F.col(f"__t{n}") + gamma * F.col("V"))
        p = at(0)
        for n in range(1, m.order):
            p = F.when(F.col(f"__t{n}").isNotNull(), at(n)).otherwise(p)
    names = [F.col(c) for c in probes.columns]
    return df.select(*names, p.alias("prob"))


def log_score(prob: Column) -> Column:
    return F.log2(F.greatest(prob, F.lit(1e-12)))


def perplexity(m: NgramModel, sentences: DataFrame, tokens: str = "tokens", key: str = "sent_id") -> DataFrame:
    """(key, perplexity) of each sentence, its end included; words that training never saw are taken for the end up to order 3."""
    t = padded(F.col(tokens), m.order)
    rows = sentences.select(key, t.alias("t")).select(key, "t", F.posexplode("t").alias("pos", "word")).filter(F.col("pos") >= m.order - 1)
    context = F.slice("t", F.col("pos") - (m.order - 2), F.lit(m.order - 1)) if m.order > 1 else F.array().cast("array<string>")
    scored = score(m, rows.select(key, "word", context.alias("context")), unknown_as_end=m.order <= 3)
    return scored.groupBy(key).agg(F.pow(F.lit(2.0), -F.avg(F.log2(F.greatest("prob", F.lit(1e-12))))).alias("perplexity"))
