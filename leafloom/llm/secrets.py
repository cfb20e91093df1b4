"""Secret scan: Aho-Corasick prefilter, anchored expressions near hits, embedded checksums.

The automaton holds key names, token prefixes and, for bare hexadecimal
keys, all four-digit hexadecimal strings (built from a rule). Expressions
are only tried at a hit. Formats that embed a checksum (CRC-32 in the last
six base-62 digits) or a structure (a token of three base64 parts with a
JSON header) are reported with whether it holds.

Defined results: a null text counts as empty; a null id is passed on; rows
are independent; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import textops
from leafloom.llm.shared import documents

BASE_KINDS = ("assign", "access", "hex")
#: Kinds with a checksum or structure of their own; n_* and base_sha256 leave them out.
ADDED_KINDS = ("crc_token", "jwt", "private_key")
KINDS = BASE_KINDS + ADDED_KINDS
ORDER = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CRC_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT_HEADER = re.compile(r"eyJ[A-Za-z0-9_-]+")
_JWT_REST = re.compile(r"\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
#: Fixed keywords in lower case and the kind that each may start.
_KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "crc_token", "gho_": "crc_token", "ghu_": "crc_token", "ghs_": "crc_token", "ghr_": "crc_token", "npm_": "crc_token",
    "eyj": "jwt", "-----begin": "private_key",
}
_FOLD = {c: c + 32 for c in range(65, 91)}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX_GRAM, _HEX_LEAST = 4, 24


def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Keywords, for the folded text, and hexadecimal strings, for the text itself."""
    words, grams = ahocorasick.Automaton(), ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        words.add_word(word, (kind, len(word)))
    for gram in product("0123456789abcdef", repeat=_HEX_GRAM):
        grams.add_word("".join(gram), True)
    words.make_automaton()
    grams.make_automaton()
    return words, grams


def crc62(payload: str) -> str:
    """Six base-62 digits of the CRC-32 of a token's payload."""
    value, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        out = _BASE62[rest] + out
    return out


def _json_header(part: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError, binascii.Error, RecursionError):  # the last for brackets nested without end
        return False


def scan(text: str, automata: tuple) -> list[tuple[int, int, str, bool | None]]:
    """(start, end, kind, whether an embedded check holds) by start and then by the order of kinds."""
    words, grams = automata
    out: list[tuple[int, int, str, bool | None]] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, width) in words.iter(text.translate(_FOLD)):
        at = last - width + 1
        if at < done[kind]:
            continue
        if kind == "assign":
            m = _ASSIGN.match(text, at)
            if m:
                done[kind] = m.end()
                if len(m[1]) >= 6:
                    out.append((at, m.end(), kind, None))
        elif kind == "access":
            m = _ACCESS.match(text, at)
            if m:
                done[kind] = m.end()
                if m.end() - at >= 20:
                    out.append((at, m.end(), kind, None))
        elif kind == "crc_token":
            m = _CRC_TOKEN.match(text, at)
            if m:
                done[kind] = m.end()
                out.append((at, m.end(), kind, crc62(m[1]) == m[2]))
        elif kind == "jwt":
            # the first hit of a run of base64 characters starts its header; what follows the run is the same for all its hits
            m = _JWT_HEADER.match(text, at)
            if m:
                done[kind] = m.end()
                rest = _JWT_REST.match(text, m.end())
                if rest and _json_header(m[0]):
                    done[kind] = rest.end()
                    out.append((at, rest.end(), kind, True))
        else:
            m = _PRIVATE.match(text, at)
            if m:
                done[kind] = m.end()
                out.append((at, m.end(), kind, None))
    upto = 0
    for last, _ in grams.iter(text):
        at = last - _HEX_GRAM + 1
        if at >= upto:  # the first hit of a run is where the run starts
            upto = _HEX.match(text, at).end()
            if upto - at >= _HEX_LEAST:
                out.append((at, upto, "hex", None))
    out.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return out


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans array<struct<start, end, kind, checked>>; checked is null for kinds without a check."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, spans array<struct<start: int, end: int, kind: string, checked: boolean>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("checked", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata()
        for batch in batches:
            for part in textops.slices(batch, 1):
                found = [[{"start": s, "end": e, "kind": k, "checked": c} for s, e, k, c in scan(t or "", automata)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, type=kind)], [id_col, "spans"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the secrets in every text of ``documents``."""
    spans = find_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s.checked)).cast("long").alias("n_checked"),
    )


QUERIES = {"op2_secrets": op2_secrets}
