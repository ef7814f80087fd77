"""Pieces of the SQL that the queries are compared with."""

from __future__ import annotations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def toks(table: str = "documents", key: str = "doc_id", text: str = "text", where: str = "") -> str:
    """CTE body: (key, t) with the ASCII tokens of each row."""
    return f"SELECT {key}, regexp_extract_all(translate({text}, '{UP}', '{LOW}'), '[a-z0-9'']+') AS t FROM {table} {where}"


def regex_tokens(pattern: str, table: str = "documents") -> str:
    p = pattern.replace("'", "''")
    return f"SELECT doc_id, regexp_extract_all(text, '{p}') AS t FROM {table}"


def fnv(token: str) -> str:
    """64-bit FNV-1a of an ASCII token, as a number."""
    codes = f"list_transform(range(1, length({token}) + 1), lambda i: ascii(substr({token}, i::INT, 1))::HUGEINT)"
    return f"list_reduce(list_concat([14695981039346656037::HUGEINT], {codes}), lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


def pairs(window: int, source: str = "k") -> str:
    """SELECT of (l, r) pairs fewer than window places apart."""
    parts = [f"SELECT t[i] AS l, t[i + {d}] AS r FROM (SELECT t, unnest(range(1, len(t) - {d} + 1)) AS i FROM {source})" for d in range(1, window)]
    return " UNION ALL ".join(parts)


def tag(token: str) -> str:
    low = f"lower({token})"
    words = lambda s: ", ".join(f"'{w}'" for w in s.split())
    return f"""CASE WHEN regexp_full_match({token}, '[0-9]+') THEN 'CD'
    WHEN {low} IN ({words('he her him i it me she them they us we you')}) THEN 'PRP'
    WHEN {low} IN ({words('a an that the these this those')}) THEN 'DT'
    WHEN {low} IN ({words('and but nor or yet')}) THEN 'CC'
    WHEN {low} IN ({words('am are be been being did do does had has have is was were')}) THEN 'VB'
    WHEN {low} LIKE '%ing' THEN 'VBG' WHEN {low} LIKE '%ed' THEN 'VBD' WHEN {low} LIKE '%ly' THEN 'RB'
    WHEN regexp_matches({token}, '^[A-Z]') AND length({token}) > 1 THEN 'NNP' ELSE 'NN' END"""
