"""Lexical graphs from files: JSON, packed JSON, and the four data files of a lexical database."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"BNWN1"
SCHEMA = "id string, pos string, lemmas array<string>, gloss string, examples array<string>, hypernyms array<string>, hyponyms array<string>, similarTo array<string>, antonyms array<string>"


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    data = [(*(r.get(n) if n in ("id", "pos", "gloss") else r.get(n) or [] for n in names), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"{SCHEMA}, ord int")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.schema(f"version int, synsets array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    return found.select(F.posexplode("synsets").alias("ord", "s")).select("s.*", "ord")


def unpack(data: bytes) -> list[dict]:
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a packed lexical graph")
    (size,) = struct.unpack_from("<I", data, len(MAGIC))
    body = data[len(MAGIC) + 4 :]
    if len(body) < size:
        raise ValueError("the packed graph is cut off")
    return json.loads(body[:size])["synsets"]


def pack(rows: list[dict]) -> bytes:
    body = json.dumps({"version": 1, "synsets": sorted(rows, key=lambda r: r["id"])}, ensure_ascii=False, separators=(",", ":")).encode()
    return MAGIC + struct.pack("<I", len(body)) + body


def write_packed(rows: list[dict], path: str) -> dict:
    """Writes the file; returns its manifest."""
    data = pack(rows)
    Path(path).write_bytes(data)
    return {"path": path, "synsets": len(rows), "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return from_rows(spark, unpack(bytes(data)))


def load(spark: SparkSession, path: str | None = None, variable: str = "LEXMILL_SYNSETS") -> DataFrame:
    """From a path or the path that an environment variable names; .bin files are packed."""
    path = path or os.environ.get(variable)
    if not path:
        raise ValueError(f"give a path or set {variable}")
    return read_packed(spark, path) if path.endswith(".bin") else read_json(spark, path)


_POINTERS = {"@": "hypernyms", "@i": "hypernyms", "~": "hyponyms", "~i": "hyponyms", "&": "similarTo", "!": "antonyms"}


def parse_data_line(line: str) -> dict | None:
    """A record of a data file: offset, lexicographer file, type, words, pointers, and the gloss after the bar."""
    if not re.match(r"\d{8} ", line):
        return None
    head, _, gloss = line.partition("|")
    f = head.split()
    pos = {"s": "a"}.get(f[2], f[2])
    n = int(f[3], 16)
    row: dict = {"id": f"{f[0]}.{pos}", "pos": pos, "lemmas": [f[4 + 2 * i].lower() for i in range(n)], "hypernyms": [], "hyponyms": [], "similarTo": [], "antonyms": []}
    at = 4 + 2 * n
    for i in range(int(f[at])):
        kind, offset, other = f[at + 1 + 4 * i : at + 4 + 4 * i]
        target = f"{offset}.{'a' if other == 's' else other}"
        if kind in _POINTERS and target not in row[_POINTERS[kind]]:
            row[_POINTERS[kind]].append(target)
    row["examples"] = re.findall(r'"([^"]+)"', gloss)
    row["gloss"] = re.sub(r';?\s*"[^"]*"', "", gloss).strip().rstrip(";")
    return row


def read_database(spark: SparkSession, folder: str) -> DataFrame:
    """data.noun, data.verb, data.adj and data.adv of a folder."""
    rows = []
    for name in ("noun", "verb", "adj", "adv"):
        p = Path(folder) / f"data.{name}"
        if p.exists():
            rows += [r for line in p.read_text(encoding="utf-8").splitlines() if (r := parse_data_line(line))]
    return from_rows(spark, sorted(rows, key=lambda r: r["id"]))
