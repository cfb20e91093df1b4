"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus
signs, digits, URL schemes and identifier cues. Around each anchor a local
parser expands to the boundaries of a candidate and validates it (octets,
Luhn, digit counts, IBAN remainder). Text without anchors is never parsed
and a text costs time linear in its length.

Defined results: a null text counts as empty; a null id is passed on; rows
are independent, so repeated rows give repeated results; columns other than
the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import textops
from leafloom.llm.shared import documents

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the cues add; n_* and base_sha256 leave them out.
ADDED_KINDS = ("url", "iban", "ssn", "account")
KINDS = BASE_KINDS + ADDED_KINDS
ORDER = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_TAIL = re.compile(r"\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
#: What may stand between a cue and its number: "number", then a verb, then a mark.
_BETWEEN = r"(?:[ ]?(?:[Nn]umbers?|[Nn]o\.?|[Nn]r\.?|#))?(?:[ ]{1,3}(?:is|was|are|ist|est|es))?[ ]?[:=#]?[ ]{0,3}"
_IBAN = re.compile(_BETWEEN + r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_SSN = re.compile(_BETWEEN + r"(?<![A-Za-z0-9])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(_BETWEEN + r"(?<![A-Za-z0-9])([0-9]{6,17})(?![0-9A-Za-z])")
#: Fixed lengths of account numbers by country.
_IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Fixed cues, in lower case, and the parser that each starts.
_CUES = {"http://": "url", "https://": "url", "ftp://": "url", "iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account"}
_FOLD = {c: c + 32 for c in range(65, 91)}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, ("digit" if sign.isdigit() else sign, 1))
    for cue, kind in _CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    bare = text.replace(" ", "")
    if not 15 <= len(bare) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where the account number that begins text[start:end] ends: after its country's length, or the longest valid one of another country."""
    places = [i for i in range(start, end) if text[i] != " "]
    own = _IBAN_LENGTH.get(text[start : start + 2])
    for n in [own] if own else range(len(places), 14, -1):
        if n > len(places):
            continue
        stop = places[n - 1] + 1
        if not text[stop : stop + 1].isalnum() and iban_ok(text[start:stop]):
            return stop
    return None


def scan(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start and then by the order of kinds."""
    out: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)  # where each kind's scan goes on
    for last, (what, width) in automaton.iter(text.translate(_FOLD)):
        at = last - width + 1
        if what == "digit":
            if at >= done["ip"]:
                run = _DIGITS.match(text, at).end()
                done["ip"] = run
                tail = _IP_TAIL.match(text, run)
                if tail:
                    done["ip"] = tail.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in (text[at:run], *tail.groups())):
                        out.append((at, tail.end(), "ip"))
            if at >= done["card"]:
                m = _CARD.match(text, at)
                done["card"] = m.end() if m else at + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, m.end(), "card"))
        elif what == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                out.append((start, domain.end(), "email"))
            done["email"] = domain.end() if domain else at + 1
        elif what == "+":
            if at >= done["phone"]:
                m = _PHONE.match(text, at)
                if m:
                    done["phone"] = m.end()
                    if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                        out.append((at, m.end(), "phone"))
        elif at >= done[what]:
            _expand(text, at, last + 1, what, out, done)
    out.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return out


def _expand(text: str, at: int, end: int, what: str, out: list, done: dict) -> None:
    """Spans that a scheme or a cue of text[at:end] starts."""
    if what != "url" and at and text[at - 1].isalnum():
        return
    if what == "url":
        m = _URL.match(text, end)
        if m:
            stop = end + len(m[0].rstrip(".,;:!?)]"))
            if stop > end:
                out.append((at, stop, what))
                done[what] = stop
    elif what == "iban":
        m = _IBAN.match(text, end)
        stop = iban_end(text, m.start(1), m.end(1)) if m else None
        if stop:
            out.append((m.start(1), stop, what))
            done[what] = stop
    elif what == "ssn":
        m = _SSN.match(text, end)
        if m and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            out.append((m.start(1), m.end(3), what))
            done[what] = m.end()
    else:
        m = _ACCOUNT.match(text, end)
        if m:
            out.append((m.start(1), m.end(1), what))
            done[what] = m.end()


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, overlapping ones together, replaced by its first kind in capitals."""
    parts, at = [], 0
    merged: list[list] = []
    for start, end, kind in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans array<struct<start, end, kind>>, offsets in code points, end exclusive."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, spans array<struct<start: int, end: int, kind: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            for part in textops.slices(batch, 1):
                found = [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t or "", automaton)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, type=pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))], [id_col, "spans"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def redact_pii(df: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """The rows with personal data replaced by ``[KIND]``; null texts stay null, other columns as they are.

    ``n_chars_col``, where the rows have it, follows the new length.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            for part in textops.slices(batch, at):
                kind = part.column(at).type
                new = pa.array([t if t is None else redacted(t, scan(t, automaton)) for t in part.column(at).to_pylist()], type=kind)
                yield part.set_column(at, part.schema.field(at), new)

    out = df.mapInArrow(run, df.schema)
    if n_chars_col in df.columns:
        out = out.withColumn(n_chars_col, F.when(F.col(text_col).isNull(), F.col(n_chars_col)).otherwise(F.char_length(text_col)).cast(df.schema[n_chars_col].dataType))
    return out


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the personal data in every text of ``documents``."""
    spans = find_pii(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def digest(spans: list[tuple[int, int, str]]) -> str:
    """base_sha256 of one text's spans."""
    return hashlib.sha256(joined([s for s in spans if s[2] in BASE_KINDS]).encode()).hexdigest()


QUERIES = {"op1_pii": op1_pii}
