"""Lexical graphs: synsets (id, pos, lemmas, gloss, examples, hypernyms, hyponyms, similarTo, antonyms) and walks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import MORPHY as RULES
from ..functions.text import morphy_rule
from ..sources.shared import stored

#: Endings by part of speech: what is cut, the least length of the word, what takes its place. "2" undoubles the last letter.
ENDINGS = {
    "n": (("ies", 4, "y"), ("ves", 4, "f"), ("es", 3, ""), ("s", 2, "")),
    "v": (("ies", 4, "y"), ("ing", 5, ""), ("ing", 5, "e"), ("ing", 5, "2"), ("ed", 4, ""), ("ed", 4, "e"), ("ed", 4, "2"), ("s", 2, "")),
    "a": (("er", 3, ""), ("est", 4, "")),
    "r": (),
}
SENSE_POS = {"n": 1, "v": 2, "a": 3, "r": 4}


def normal(word: Column | str) -> Column:
    w = F.col(word) if isinstance(word, str) else word
    return F.regexp_replace(F.lower(F.trim(w)), r"\s+", "_")


class Lexicon:
    """ord is a synset's place in its file."""

    def __init__(self, synsets: DataFrame):
        self.synsets = synsets
        self.index = synsets.select(F.posexplode("lemmas").alias("__at", "word"), "id", "pos", "ord").select(normal("word").alias("lemma"), "pos", "id", "ord").distinct()

    def edges(self, *kinds: str) -> DataFrame:
        """(src, dst, kind) of relations to synsets that there are."""
        parts = [self.synsets.select(F.col("id").alias("src"), F.explode(k).alias("dst"), F.lit(k).alias("kind")) for k in kinds]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.join(self.synsets.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "kind").distinct()

    def related(self, kind: str) -> DataFrame:
        return self.edges(kind)

    def all_synsets(self, pos: str | None = None) -> DataFrame:
        return self.synsets if pos is None else self.synsets.filter(F.col("pos") == pos)

    def lemmas(self, pos: str | None = None) -> DataFrame:
        rows = self.index if pos is None else self.index.filter(F.col("pos") == pos)
        return rows.select("lemma").distinct()

    def morphy(self, words: DataFrame, pos: str | None = None) -> DataFrame:
        """(word, lemma): the first candidate base form that is a lemma of that part of speech. words has a column word.

        The rule form comes first, then the word itself, then what is left of it without an ending.
        """
        rows = words.select("word").distinct().withColumn("w", normal("word"))
        forms = [morphy_rule("w", pos), F.col("w")]
        for p in [pos] if pos else ["n", "v", "a"]:
            for end, least, to in ENDINGS[p]:
                stem = F.substring("w", F.lit(1), F.length("w") - len(end))
                form = F.when(stem.rlike(r"(.)\1$"), F.substring(stem, F.lit(1), F.length(stem) - 1)) if to == "2" else F.concat(stem, F.lit(to))
                forms.append(F.when(F.col("w").endswith(end) & (F.length("w") >= least), form))
        out = rows.select("word", F.posexplode(F.array(*forms)).alias("__o", "lemma")).filter("lemma is not null")
        known = self.index if pos is None else self.index.filter(F.col("pos") == pos)
        hit = out.join(known.select("lemma").distinct(), "lemma")
        return hit.groupBy("word").agg(F.min_by("lemma", "__o").alias("lemma"))

    def lookup(self, words: DataFrame, pos: str | None = None) -> DataFrame:
        """(word, id, ord) of the synsets of each word's base form, or of the word itself."""
        base = self.morphy(words, pos)
        named = words.select("word").distinct().join(base, "word", "left").withColumn("lemma", F.coalesce("lemma", normal("word")))
        rows = self.index if pos is None else self.index.filter(F.col("pos") == pos)
        return named.join(rows, "lemma").select("word", "id", "ord").distinct()

    def lemmatize(self, words: DataFrame, pos: str = "n") -> DataFrame:
        """(word, lemma), the word itself where there is no base form."""
        kind = {"noun": "n", "verb": "v", "adj": "a", "adjective": "a", "s": "a", "adv": "r", "adverb": "r"}.get(pos.lower(), pos.lower())
        base = self.morphy(words, kind)
        return words.select("word").distinct().join(base, "word", "left").select("word", F.coalesce("lemma", F.lower(F.trim("word"))).alias("lemma"))

    def by_offset(self) -> DataFrame:
        """(pos, offset, id) of ids of eight digits and a part of speech."""
        ids = self.synsets.filter(F.col("id").rlike(r"^[0-9]{8}\.[nvar]$"))
        return ids.select("pos", F.substring("id", 1, 8).cast("long").alias("offset"), "id")

    def sense_keys(self) -> DataFrame:
        """(sense_key, id): the first synset of a lemma and part of speech."""
        number = F.element_at(F.create_map(*(F.lit(x) for kv in SENSE_POS.items() for x in kv)), F.col("pos"))
        key = F.concat("lemma", F.lit("%"), number.cast("string"), F.lit(":00:00::"))
        return self.index.withColumn("sense_key", key).groupBy("sense_key").agg(F.min_by("id", "ord").alias("id"))

    def _climb(self, most: int | None, both: bool = False) -> DataFrame:
        """(start, id, depth, path): simple paths up, or shortest walks over both directions; grown edge by edge, to the
        end unless most says how many edges. Each round is written, so that none is walked again."""
        e = self.edges("hypernyms", "hyponyms") if both else self.edges("hypernyms")
        e = stored(e.select("src", "dst").distinct(), "edges")
        now = self.synsets.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), F.array("id").alias("path"))
        layers = [now]
        known = now.select("start", "id")
        while most is None or len(layers) <= most:
            now = now.join(e, now["id"] == e["src"]).filter(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
            if both:
                now = now.dropDuplicates(["start", "id"]).join(known, ["start", "id"], "left_anti").select("start", "id", "depth", "path")
            now = stored(now, "walks")
            if now.isEmpty():
                break
            layers.append(now)
            known = known.union(now.select("start", "id"))
        out = layers[0]
        for x in layers[1:]:
            out = out.union(x)
        return out

    def hypernym_paths(self, most: int | None = None) -> DataFrame:
        """(id, path): every simple path from a synset to a root, itself first."""
        roots = self.synsets.select("id").join(self.edges("hypernyms").select(F.col("src").alias("id")), "id", "left_anti")
        up = self._climb(most)
        return up.join(roots.withColumnRenamed("id", "__root"), up["id"] == F.col("__root")).select(F.col("start").alias("id"), "path")

    def distances(self, most: int | None = None) -> DataFrame:
        """(a, b, distance, similarity): shortest paths over hypernyms and hyponyms; similarity is 1 / (distance + 1)."""
        d = self._climb(most, both=True)
        return d.select(F.col("start").alias("a"), F.col("id").alias("b"), F.col("depth").alias("distance"), (1 / (F.col("depth") + 1)).alias("similarity"))

    def lowest_common_hypernyms(self, pairs: DataFrame, most: int | None = None) -> DataFrame:
        """(a, b, id) of the common ancestors of least summed depth."""
        up = self._climb(most).groupBy("start", "id").agg(F.min("depth").alias("depth"))
        x = pairs.select("a", "b").join(up.select(F.col("start").alias("a"), "id", F.col("depth").alias("da")), "a")
        x = x.join(up.select(F.col("start").alias("b"), "id", F.col("depth").alias("db")), ["b", "id"])
        best = x.withColumn("__r", F.rank().over(W.partitionBy("a", "b").orderBy(F.col("da") + F.col("db"))))
        return best.filter("__r = 1").select("a", "b", "id")
