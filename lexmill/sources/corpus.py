"""Corpora of text files: bundles with an index, registries, tagged formats, and what is read off them."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches, sentences
from ..functions import text as T


def bundle(spark: SparkSession, index: str) -> DataFrame:
    """(id, text, categories) of the files that an index.json names, relative to it."""
    listed = spark.read.option("multiLine", True).json(index).select(F.explode("files").alias("f"))
    has = "categories" in listed.schema["f"].dataType.names
    cats = F.coalesce(F.col("f.categories"), F.array().cast("array<string>")) if has else F.array().cast("array<string>")
    files = listed.select(F.col("f.id").alias("id"), F.col("f.path").alias("path"), F.array_sort(F.array_distinct(F.transform(cats, F.lower))).alias("categories"))
    root = index.rsplit("/", 1)[0]
    paths = [f"{root}/{r['path']}" for r in files.select("path").collect()]
    if not paths:
        return files.select("id", F.lit("").alias("text"), "categories")
    texts = spark.read.text(paths, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("file"))
    return files.join(texts, F.col("file").endswith(F.concat(F.lit("/"), F.col("path")))).select("id", "text", "categories")


def mini(spark: SparkSession) -> DataFrame:
    """A packaged corpus of three short texts, to try things out: the columns of bundle()."""
    found = json.loads((Path(__file__).resolve().parent.parent / "data" / "mini.json").read_text(encoding="utf-8"))
    rows = [(f["id"], f["text"], sorted({c.lower() for c in f["categories"]})) for f in found["files"]]
    return spark.createDataFrame(rows, "id string, text string, categories array<string>")


def select(corpus: DataFrame, ids: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """By id and by any of the categories, whatever the case, in the order of ids."""
    if ids:
        corpus = corpus.filter(F.lower("id").isin([i.lower() for i in ids]))
    if categories:
        corpus = corpus.filter(F.arrays_overlap("categories", F.array(*(F.lit(c.lower()) for c in categories))))
    return corpus.orderBy("id")


def raw(corpus: DataFrame) -> DataFrame:
    """One row: the texts in the order of ids, a line end between."""
    rows = corpus.agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("r"))
    return rows.select(F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("raw"))


def words(corpus: DataFrame, key: str = "id") -> DataFrame:
    return corpus.select(key, F.posexplode(F.transform(T.word_tokens("text"), F.lower)).alias("pos", "word"))


def sents(corpus: DataFrame, key: str = "id") -> DataFrame:
    return corpus.select(key, F.posexplode(sentences.rules(F.col("text"))).alias("pos", "sentence"))


def paras(corpus: DataFrame, key: str = "id") -> DataFrame:
    return corpus.select(key, F.posexplode(T.paragraphs("text")).alias("pos", "paragraph"))


def categories(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.explode("categories").alias("category")).distinct().orderBy("category")


def manifest(path: str) -> dict:
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found.get("entries"), list):
        raise ValueError("a manifest has a list of entries")
    return found


def download(found: dict, folder: str, fetch: Callable[[str], bytes]) -> str:
    """Fetch a manifest's entries into a folder and write its index.json; sizes and digests are checked."""
    out, files = Path(folder), []
    out.mkdir(parents=True, exist_ok=True)
    for e in found["entries"]:
        data = fetch(e["url"])
        if not data:
            raise ValueError(f"{e['id']}: nothing was fetched")
        if e.get("sha256") and hashlib.sha256(data).hexdigest() != e["sha256"].lower():
            raise ValueError(f"{e['id']}: the digest differs")
        name = re.sub(r"[^a-zA-Z0-9._-]", "_", e.get("fileName") or f"{e['id']}.txt")
        (out / name).write_bytes(data)
        files.append({"id": e["id"], "path": name, "categories": e.get("categories", [])})
    index = out / "index.json"
    index.write_text(json.dumps({"version": 1, "files": files}, indent=1), encoding="utf-8")
    return str(index)


def _sentences(first: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Sentences of lines, which blank lines part and which count from 0 in each text; texts begin at the places of first."""
    before = np.concatenate([[False], full[:-1]])
    before[first[:-1][np.diff(first) > 0]] = False
    return batches.running(full & ~before, first) + (full & ~before) - 1


def _rows(first: np.ndarray, sentence: np.ndarray, keep: np.ndarray, cols: list[pa.Array]) -> tuple[np.ndarray, list[pa.Array]]:
    """Texts, sentences, places and columns of the kept lines; places count the kept lines of a sentence."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))[keep]
    sentence = sentence[keep]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (sentence[1:] != sentence[:-1])])) if len(of) else np.zeros(0, np.int64)
    return of, [pa.array(sentence, pa.int64()), pa.array(batches.numbered(np.append(new, len(of))), pa.int32()), *cols]


def conll_tagged(texts: DataFrame, key: str = "id") -> DataFrame:
    """(key, sentence, pos, token, tag) of lines "token TAB tag"; others are skipped."""

    def run(column: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        lines, first, full = batches.lines(column)
        parts, at = batches.split(lines, r"\t+", "\t", rb"\t\t")
        two = full & (np.diff(at) >= 2)
        token, tag = (pc.utf8_trim(parts.take(pa.array(at[:-1][two] + i)), " ") for i in (0, 1))
        there = pc.and_(pc.not_equal(token, ""), pc.not_equal(tag, ""))
        keep = two.copy()
        keep[two] = there.to_numpy(zero_copy_only=False)
        return _rows(first, _sentences(first, full), keep, [token.filter(there), tag.filter(there)])

    return batches.mapped(texts, key, "text", "sentence long, pos int, token string, tag string", run)


def conll_chunked(texts: DataFrame, key: str = "id") -> DataFrame:
    """(key, sentence, pos, token, tag, chunk) of lines of three fields."""

    def run(column: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        lines, first, full = batches.lines(column)
        parts, at = batches.fields(lines)
        keep = full & (np.diff(at) >= 3)
        return _rows(first, _sentences(first, full), keep, [parts.take(pa.array(at[:-1][keep] + i)) for i in (0, 1, 2)])

    return batches.mapped(texts, key, "text", "sentence long, pos int, token string, tag string, chunk string", run)


#: What the pattern of an item's token has no place for.
_ENDS = "[\\n\\r\\x{85}\\x{2028}\\x{2029}]"


def brown_tagged(texts: DataFrame, key: str = "id") -> DataFrame:
    """(key, sentence, pos, token, tag): a line is a sentence of items token/tag, parted at the last slash."""

    def run(column: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        lines, first, full = batches.lines(column)
        items, at = batches.fields(lines.filter(pa.array(full)))
        line = np.repeat(np.arange(len(at) - 1), np.diff(at))
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))[full]
        sentence = batches.running(full, first)[full]
        parts = pc.split_pattern(items, "/", max_splits=1, reverse=True)
        two = pc.equal(pc.list_value_length(parts), 2)
        flat = parts.filter(two).flatten()
        token, tag = (flat.take(pa.array(np.arange(i, len(flat), 2))) for i in (0, 1))
        good = pc.and_(pc.not_equal(token, ""), pc.not_equal(tag, ""))
        if not pc.all(pc.string_is_ascii(token)).as_py():
            good = pc.and_(good, pc.invert(pc.match_substring_regex(token, _ENDS)))
        line = line[two.to_numpy(zero_copy_only=False)][good.to_numpy(zero_copy_only=False)]
        pos = batches.numbered(np.searchsorted(line, np.arange(len(at))))
        return text[line], [pa.array(sentence[line], pa.int32()), pa.array(pos, pa.int32()), token.filter(good), tag.filter(good)]

    return batches.mapped(texts, key, "text", "sentence int, pos int, token string, tag string", run)
