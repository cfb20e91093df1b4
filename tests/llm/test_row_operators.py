"""Personal data, secrets and quality rules against plain versions of their contracts."""

import base64
import hashlib
import os
import random
import re
import string
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from leafloom.llm import minhash, pii, quality, secrets, textops, tokens

SF = "/root/testdata/sf0.001"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_pii(t):
    out = []
    out += [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.ORDER[s[2]]))


def plain_secrets(t):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    out = [(m.start(), m.end(), "assign") for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], secrets.ORDER[s[2]]))


def plain_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    marked = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(marked), len(words) < 10 or 100 * len(marked) > 20 * len(words)


PIECES = ["a@b.co", "a@b", "x.y@", "@", "@@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "1.2.3", "00.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "378282246310005", "+1 (916) 555-6549", "+1", "+12--", "+1 2 3 4 5 6 7 8 9 0", "é", "İ", "\n", " ", ".", "-", "7", "%", "iban DE89370400440532013000", "SSN: 123-45-6789", "account number 12345678", "https://ex.org/a?b=1.", "K"]
SECRETS = ["token = \"abcdef\"", "TOKEN:'abc'", "api_key==", "apikey=aaaaaaaaa", "ſecret=aaaaaaa", "password", " = ", "passwd:xxxxxx", "secret", "AKIA", "AKIA" + "A" * 16, "a" * 23, "0f" * 12, "g", "İ", "F", "=", "é", "\n", "ghp_" + "a" * 30 + secrets.crc62("a" * 30), "tokentoken=abcdefg"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_pii_matches_regular_expressions(parts):
    text = "".join(parts)
    assert [s for s in pii.scan(text, pii._automaton()) if s[2] in pii.BASE_KINDS] == plain_pii(text)


AUTOMATA = secrets._automata()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SECRETS), max_size=14))
def test_secrets_match_regular_expressions(parts):
    text = "".join(parts)
    assert [s[:3] for s in secrets.scan(text, AUTOMATA) if s[2] in secrets.BASE_KINDS] == plain_secrets(text)


def test_pii_added_kinds_and_redaction():
    text = "mail a@b.co iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789 account no. 12345678 see https://u@ex.org/x."
    kinds = [s[2] for s in pii.scan(text, pii._automaton())]
    assert kinds == ["email", "iban", "ssn", "account", "url", "email"] or set(kinds) == {"email", "iban", "ssn", "account", "url"}
    assert "iban" not in [s[2] for s in pii.scan("iban DE88 3704 0044 0532 0130 00", pii._automaton())]
    assert pii.redacted("x a@b.co y", pii.scan("x a@b.co y", pii._automaton())) == "x [EMAIL] y"


def test_secret_checks():
    good, bad = "ghp_" + "y" * 30 + secrets.crc62("y" * 30), "ghp_" + "y" * 30 + "zzzzzz"
    assert [s[3] for s in secrets.scan(f"{good} {bad}", AUTOMATA)] == [True, False]
    assert [s[2] for s in secrets.scan("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abc", AUTOMATA)] == ["jwt"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start string, spans string, n_words string")


EDGES = [(1, None, "a", "b", "c"), (2, "", "a", "b", "c"), (None, "a@b.co token = abcdefgh", None, None, None), (3, "dup a@b.co", "", "", ""), (3, "dup a@b.co", "", "", ""), (4, "word " * 100_000 + "z@y.xx", "", "", "")]


def test_edges(spark):
    df = frame(spark, EDGES)
    rows = {(r.doc_id, len(r.spans)) for r in pii.find_pii(df).collect()}
    assert rows == {(1, 0), (2, 0), (None, 1), (3, 1), (4, 1)}
    assert pii.find_pii(df).count() == 6
    assert {(r.doc_id, len(r.spans)) for r in secrets.find_secrets(df).collect()} == {(1, 0), (2, 0), (None, 1), (3, 0), (4, 0)}
    q = {r.doc_id: r for r in quality.judge_quality(df).collect()}
    assert q[1].base_failed and q[2].n_words == 0 and q[4].n_words == 100_001 and not q[4].kept
    assert pii.redact_pii(df).filter("doc_id = 3").first().text == "dup [EMAIL]"
    assert quality.keep_good(df).count() == 0
    empty = frame(spark, [])
    assert pii.find_pii(empty).count() == secrets.find_secrets(empty).count() == quality.judge_quality(empty).count() == 0
    assert pii.redact_pii(empty).columns == df.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_queries_on_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pii.op1_pii(spark, SF).collect():
        want = plain_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest() == pii.digest(want)
        assert r.n_email == sum(s[2] == "email" for s in want) and r.n_phone == sum(s[2] == "phone" for s in want)
    for r in secrets.op2_secrets(spark, SF).collect():
        want = plain_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest() and r.n_hex == sum(s[2] == "hex" for s in want)
    for r in quality.op3_quality(spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(texts[r.doc_id])


def test_quality_measures_match_plain(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a ", "b ", "ä\t", "c\n", "\n", "#", "a b c d e ", "\r\n", "\x0b"]) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.judge_quality(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(texts[r.doc_id])


def test_quality_bands(spark):
    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(6)) for _ in range(400))
    varied = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(400))
    stutter = " ".join(f"x{i % 7}{'ab' * (i % 90)}" for i in range(2000))
    df = spark.createDataFrame([(1, noise), (2, varied), (3, stutter)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge_quality(df).collect()}
    assert got[1].reason == "incompressible" and got[2].kept and not got[3].kept


@pytest.mark.skipif(not os.path.isdir(SF.replace("0.001", "0.1")), reason="no driver tables")
@pytest.mark.parametrize("lang", ["de", "en", "es", "fr"])
def test_quality_keeps_long_clean_texts(lang):
    folder = SF.replace("0.001", "0.1")
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    seen = Counter(line for r in docs for line in set((r["text"] or "").split("\n")))
    clean = [r["text"] for r in docs if r["lang"] == lang and r["text"] and labels.get(r["doc_id"]) == 1 and all(seen[x] == 1 for x in r["text"].split("\n"))]
    data, press = "\n".join(clean).encode(), zstandard.ZstdCompressor(level=quality.DEFAULT.level)
    assert len(data) > 300_000
    for n in (20_000, 60_000, 130_000, 200_000, 300_000, len(data)):
        assert quality.verdict(data[:n], quality.DEFAULT, press)[3] is None, n
    # a text that stands twice over is still repetitive
    assert quality.verdict(data[:150_000] * 2, quality.DEFAULT, press)[3] == "repetitive"


@pytest.mark.parametrize("n", [200, 300, 400, 500, 800, 1000, 1500, 2000])
def test_quality_rejects_short_random_texts(n):
    rng, press = random.Random(n), zstandard.ZstdCompressor(level=quality.DEFAULT.level)
    for letters in (string.ascii_letters + string.digits + "+/", "".join(map(chr, range(33, 127)))):
        for size in (8, 40):
            data = " ".join("".join(rng.choices(letters, k=size)) for _ in range(n // size + 1))[:n].encode()
            assert quality.verdict(data, quality.DEFAULT, press)[3] == "incompressible"


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


_WORD = thue_morse(2048)
_OTHER = _WORD.translate(str.maketrans("ab", "ba"))
_NESTED = base64.urlsafe_b64encode(b'{"alg":' + b"[" * 100_000 + b"]" * 100_000 + b"}").decode().rstrip("=")
#: Texts that once crashed, stalled or deceived an operator.
HOSTILE = ["eyJ" * 400_000, "eyJ" * 400_000 + ".eyJa.b", _NESTED + ".eyJabc.def", " " * 2_000_000, "\n" * 2_000_000 + "x", f"{_WORD} {_OTHER}", f"{_WORD}\n{_OTHER}\n{_WORD}", "1" * 200_000, "a@" * 200_000, "+1 " * 200_000, "token = " * 50_000, "iban " * 50_000]


@pytest.mark.parametrize("text", HOSTILE, ids=range(len(HOSTILE)))
def test_hostile_texts(text):
    began = time.perf_counter()
    pii.scan(text, pii._automaton())
    found = secrets.scan(text, secrets._automata())
    assert not any(s[2] == "jwt" for s in found)
    offsets, raw = textops.strings(pa.array([text]))
    assert quality.measures(offsets, raw)["n_dup_lines"][0] == (text.count("\n") == 2)
    minhash.shingle_sets(offsets, raw, 4)
    ranks, words = tokens.rank_ids(), tokens.word_ids()
    assert ranks.decode(ranks.encode(text)) == text.encode()
    if len(text) < 10_000:
        whole = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.pack([text])[0], dtype="<u4").tolist() == whole
    else:
        words.pack([text])
    assert time.perf_counter() - began < 30


def test_words_that_collide_modulo_a_power_of_two_differ():
    offsets, raw = textops.strings(pa.array([_WORD, _OTHER]))
    assert len(set(textops.Words(offsets, raw).hashes().tolist())) == 2


@pytest.mark.parametrize("text,kind,number", [("IBAN: DE89 3704 0044 0532 0130 00 AND", "iban", "DE89 3704 0044 0532 0130 00"), ("My IBAN is DE89370400440532013000.", "iban", "DE89370400440532013000"), ("account number is 12345678 then", "account", "12345678"), ("iban GB82 WEST 1234 5698 7654 32", "iban", "GB82 WEST 1234 5698 7654 32")])
def test_numbers_after_cues(text, kind, number):
    assert [text[s:e] for s, e, k in pii.scan(text, pii._automaton()) if k == kind] == [number]


def test_the_end_of_a_long_text_is_judged():
    rng = random.Random(1)
    clean = " ".join("".join(rng.choices(string.ascii_lowercase[:9], k=rng.randrange(2, 8))) for _ in range(900))[:4097]
    press = zstandard.ZstdCompressor(level=3)
    plain = quality.verdict(clean.encode(), quality.DEFAULT, press)
    # the second chunk is the last 4096 bytes
    assert len(clean) == 4097 and plain[1] <= plain[2] and quality.verdict((clean[:4096] + " " * 4000).encode(), quality.DEFAULT, press)[1] < 0.1
