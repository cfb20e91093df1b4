"""Encoding, shard files and packing against the libraries and plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafloom.llm import bpe, packing, sstable
from leafloom.llm.shared import Workspace
from leafloom.llm.tokens import RankIds, WordIds

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
WORDS = WordIds(cache=50)
RANKS = RankIds(cut=5)
BITS = ["'", "'re", "'LL", "'v", "don't's", ".'s", "7'd8", "ÿ÷×", "µª", "The ", "it's", "'s ", "été", "é", " ́", " ", "　", "\x1c", "\x85", "\n", "\r\n", "\t", " ", "  ", "İ", "ΑΣ", "ΑΣ ", "12", ".", "...", "<|endoftext|>", "<|", "日本", "😀", "x" * 40, "don'T"]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def whole(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=12).map("".join), max_size=4))
def test_word_ids_equal_the_library(texts):
    got = WORDS.pack(texts)
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=20).map("".join))
def test_rank_ids_equal_the_library_and_decode(text):
    ids = RANKS.encode(text)
    assert ids == RANKS.encoding.encode_ordinary(text)
    assert RANKS.decode(ids) == text.encode()


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start string, piece string, length string")


EDGES = [(5, None, "", "", "", ""), (-3, "", "", "", "", ""), (None, "null id", None, None, None, None), (7, "tie", "", "", "", ""), (7, "tie", "", "", "", ""), (7, "other", "", "", "", ""), (2**62, "long text " * 20_000, "", "", "", "")]


def test_bpe_edges(spark):
    got = bpe.encode(frame(spark, EDGES)).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got)[:3] == [(-3, 0), (0, len(RANKS.encode("null id"))), (5, 0)]
    back = bpe.decode(bpe.encode(frame(spark, EDGES))).collect()
    assert Counter(bytes(r.bytes) for r in back) == Counter((r[1] or "").encode() for r in EDGES)
    assert bpe.encode(frame(spark, [])).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "a int, ids array<int>")).first().bytes == b""


def test_bpe_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op8_bpe(spark, SF).collect():
        ids = RANKS.encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_shard_lookup():
    writer = sstable.ShardWriter(2)
    rng = random.Random(2)
    keys = sorted(rng.sample(range(-(10**6), 10**6), 3000)) + [2**40, 2**40]
    want = defaultdict(list)
    for k in [None, *keys]:
        ids = [rng.randrange(60_000) for _ in range(rng.randrange(200))]
        want[k].append(ids)
        writer.add(sstable.key_of(k), np.array(ids, dtype="<u2").tobytes())
    shard = sstable.Shard(writer.finish())
    assert len(shard.index) > 5 and shard.n_docs == 3003 and shard.n_ids == sum(len(x) for v in want.values() for x in v)
    for k in [None, 2**40, *rng.sample(keys, 100)]:
        shard.blocks_read = 0
        assert [x.tolist() for x in shard.get(k)] == want[k]
        assert shard.blocks_read <= 2
    misses = [k for k in range(10**7, 10**7 + 1000) if shard.get(k)]
    assert not misses
    flat, before = list(shard.scan()), 0
    assert [f[0] for f in flat] == [None, *keys]
    for _, at, ids in flat:
        assert at == before
        before += len(ids)


def test_shard_damage():
    writer = sstable.ShardWriter(4)
    writer.add(sstable.key_of(1), b"\1\0\0\0")
    data = bytearray(writer.finish())
    data[10] ^= 255
    with pytest.raises(ValueError):
        list(sstable.Shard(bytes(data)).scan())
    with pytest.raises(ValueError):
        sstable.Shard(bytes(data[:-3]))


def test_sstable_edges(spark):
    space = Workspace(spark, "test")
    done = sstable.write_shards(frame(spark, EDGES), space.at("s"), shard_bytes=100).collect()
    assert sum(r.n_docs for r in done) == 7 and sum(r.n_ids for r in done) == sum(len(whole(r[1])) for r in EDGES)
    rows = sstable.read_shards(spark, space.at("s")).orderBy("shard", "before").collect()
    assert [r.doc_id for r in rows] == [None, -3, 5, 7, 7, 7, 2**62]
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((r[0], tuple(whole(r[1]))) for r in EDGES)
    assert sstable.write_shards(frame(spark, []), space.at("e")).count() == 0


def test_sstable_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in sstable.op9_sstable(spark, SF).collect()}
    assert got.keys() == texts.keys()
    at = 0
    for d in sorted(texts):
        ids = whole(texts[d])
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def check_packed(rows, texts, capacity):
    """Every piece once, cut only where it must be, and no gap in any sequence; returns the number of sequences."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for d, want in texts.items():
        ids = [whole(t) for t in want]
        pieces = Counter((k, i, len(x[i : i + capacity]), crc(x[i : i + capacity])) for x in ids for k, i in enumerate(range(0, len(x), capacity)))
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d]) == pieces
    assert by_doc.keys() == texts.keys()
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_packing_edges(spark):
    texts = defaultdict(list)
    for r in EDGES:
        texts[r[0]].append(r[1])
    space = Workspace(spark, "test")
    rows = packing.pack(packing.pieces(frame(spark, EDGES), capacity=64), space, capacity=64).collect()
    assert check_packed(rows, texts, 64) <= -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack(packing.pieces(frame(spark, [])), Workspace(spark, "test")).count() == 0
    with_ids = packing.pack(packing.pieces(frame(spark, EDGES), capacity=64, with_ids=True), Workspace(spark, "test"), capacity=64)
    made = packing.sequences(with_ids).collect()
    assert sum(len(r.ids) for r in made) == 4 * sum(r.length for r in rows) and max(len(r.ids) for r in made) <= 256


def test_packing_query(spark):
    texts = {r.doc_id: [r.text] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.op10_packing(spark, SF).collect()
    n = check_packed(rows, texts, 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([10, 50, 4096])
        lengths = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(1, max(2, capacity // 8)) for _ in range(rng.randrange(1, 300))]
        free: list[int] = []
        for length in sorted(lengths, reverse=True):
            fits = [b for b in range(len(free)) if free[b] >= length]
            if fits:
                free[min(fits, key=free.__getitem__)] -= length
            else:
                free.append(capacity - length)
        moved, opened = packing.plan(Counter(lengths), capacity)
        assert opened <= len(free) + max(1, len(free) // 20) and len(moved) <= len(lengths)
