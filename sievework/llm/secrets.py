"""Secret scan: an Aho-Corasick keyword prefilter, anchored expressions at its hits, then checksums.

One automaton pass over a text finds every keyword. Expressions are tried only there, anchored at
the hit, from left to right and never inside an earlier match of the same kind, which gives the
leftmost non-overlapping matches without scanning the text once per expression. Every match of an
expression starts with one of its keywords: for plain hexadecimal runs those are all blocks of four
hexadecimal digits. Tokens that embed a checksum count only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_texts

# The kinds in order, their anchored expressions and keywords.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "xprv")
EXPRESSIONS = {
    "assign": re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "xprv": re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"),
}
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "hex": tuple(map("".join, product("0123456789abcdef", repeat=4))),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc_holds(token: str) -> bool:
    """Whether the last six letters after the prefix are the base-62 CRC-32 of the thirty before them."""
    body = token.partition("_")[2]
    value = 0
    for c in body[30:]:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body[:30].encode())


def base58_holds(token: str) -> bool:
    """Whether the last four bytes are the start of the double SHA-256 of the others."""
    value = 0
    for c in token:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
    return len(raw) == 82 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


VALID = {
    "assign": lambda m: len(m[2]) >= 8,
    "access": lambda m: len(m[0]) >= 16,
    "hex": lambda m: len(m[0]) >= 32,
    "github": lambda m: crc_holds(m[0]),
    "npm": lambda m: crc_holds(m[0]),
    "xprv": lambda m: base58_holds(m[0]),
}


@cache
def _automaton():
    found = ahocorasick.Automaton()
    by_word: dict[str, list[str]] = {}
    for kind, words in KEYWORDS.items():
        for word in words:
            by_word.setdefault(word, []).append(kind)
    for word, kinds in by_word.items():
        found.add_word(word, (len(word), tuple(kinds)))
    found.make_automaton()
    return found


_ASCII = {i: i + 32 for i in range(65, 91)}


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each secret of a text, in code points, by start and then kind."""
    text = text or ""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter that lower-cases to two
        lowered = text.translate(_ASCII)
    past, spans = dict.fromkeys(KINDS, 0), []
    hits = [(end - n + 1, kinds) for end, (n, kinds) in _automaton().iter(lowered)]
    for start, kinds in sorted(hits):
        for kind in kinds:
            if start >= past[kind] and (m := EXPRESSIONS[kind].match(text, start)):
                past[kind] = m.end()
                if VALID[kind](m):
                    spans.append((start, m.end(), kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind>>) for each row; texts are scanned whole.

    Null and empty texts have no spans; repeated rows and null ids stay as they are. An empty table gives an empty one.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def batches(parts):
        for batch in parts:
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t)] for t in column_texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(batches, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, spans array<struct<start: long, end: long, kind: string>>")
