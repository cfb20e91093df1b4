"""Tokenizers for whole texts, with bounded memory.

``WordIds`` runs the ``tokenizers`` library on the pre-tokens of a text
rather than on the text: the vocabulary file encodes each pre-token by
itself, pre-tokens recur, and a bounded cache of packed ids spares most of
the work. ``RankIds`` runs ``tiktoken``, a long text being cut where no
match can span the cut. A worker keeps one of each for all its tasks.
"""

from __future__ import annotations

import base64
import os
import re
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers

from leafloom.llm.textops import same_spans, span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: Default vocabulary files; every operator takes another path as a parameter.
WORD_FILE = "word_bpe_49k.json"
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
END_ID = 1

#: Texts of ASCII and Latin-1 letters: folding and composition change no other character and no length.
_SIMPLE = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: Classes of folded Latin-1 bytes: space 0, letter 1, digit 2, other 3.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[np.r_[97:123, 0xDF:0xF7, 0xF8:0x100]] = 1
_CLASS[48:58] = 2


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the pre-tokens of folded Latin-1 text, as the file's pattern finds them.

    They are contractions, runs of letters, single digits and runs of other marks. An
    apostrophe that starts a run of marks may begin a contraction, which then takes the
    next one or two letters from the run after it.
    """
    kind = _CLASS[data]
    start = kind != 0
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    mark = np.flatnonzero(start & (data == 39))
    if len(mark):
        after = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
        x, y = after[mark + 1], after[mark + 2]
        one = np.isin(x, np.frombuffer(b"stmd", dtype=np.uint8))
        two = ((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)
        mark, taken = mark[one | two], np.where(one, 1, 2)[one | two]
        start[mark + 1] = False
        rest = mark + 1 + taken
        rest = rest[rest < len(data)]
        start[rest] |= kind[rest] != 0
    edge = np.append(np.flatnonzero(start | (kind == 0)), len(data))
    begin = np.flatnonzero(start)
    return begin, edge[np.searchsorted(edge, begin) + 1]


class _Recent(dict):
    """A map of bounded size: a full one becomes the older half, from which hits come back."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.older = limit // 2, {}

    def unknown(self, keys: set) -> set:
        """Those of the keys that are nowhere; when they are added, all the keys are in the newer half."""
        missing = keys - self.keys()
        if len(self) + len(missing) > self.limit:
            self.older = dict(self)
            self.clear()
            missing = keys
        back = missing & self.older.keys()
        self.update((key, self.older[key]) for key in back)
        return missing - back


class WordIds:
    """Token ids, as little-endian unsigned 32-bit integers, of texts.

    Pre-tokens of many texts are found and told apart together, by 64-bit hashes and then,
    against each other and against those in the cache, by their bytes; texts with two that
    only share a hash go through the whole file instead. Those that the cache lacks go to the library a thousand at a time, parted by
    spaces, through the file's model without the normalising steps that they have been
    through; the ids are cut after each word-end token. Texts with other characters than
    ``_SIMPLE`` go through the whole file, word by word.
    """

    def __init__(self, path: str | None = None, cache: int = 1_000_000) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path or public_tokenizers.path(WORD_FILE)
        self.model = Tokenizer.from_file(self.path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.model.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit, self.words = cache, _Recent(max(2, cache // 50))
        self._forget()

    def _forget(self) -> None:
        """An empty cache, all of it in arrays: sorted hashes, the place of each, and the ids of all places after one another."""
        self.keys, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.begin, self.count, self.flat = (np.zeros(1 << 12, dtype=np.int32) for _ in range(3))
        self.used = 0
        #: bytes of all pre-tokens after one another, and where each place's end
        self.text, self.text_end = np.zeros(1 << 12, dtype=np.uint8), np.zeros(1, dtype=np.int64)

    @cached_property
    def tokenizer(self):
        """The file as it is; most texts never need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encoded(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of ids of each) of some pre-tokens."""
        ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.int64)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(part) and cuts[-1] == len(ids):
            return ids, np.diff(cuts, prepend=0)
        each = [np.frombuffer(self._whole(run), dtype="<u4") for run in part]  # the file marks no word ends
        return np.concatenate(each).astype(np.int64), np.array([len(e) for e in each])

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Adds pre-tokens, whose hashes are new and sorted."""
        first = len(self.keys)
        raw, ends = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8), self.text_end[-1] + np.cumsum([len(w) for w in words])
        while ends[-1] > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.text_end[-1] : ends[-1]] = raw
        self.text_end = np.concatenate([self.text_end, ends])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, where, keys), np.insert(self.place, where, np.arange(first, first + len(keys), dtype=np.int32))
        while len(self.keys) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        for i in range(0, len(words), 1000):
            ids, count = self._encoded(words[i : i + 1000])
            at = slice(first + i, first + i + len(count))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.begin[at], self.count[at] = self.used + np.cumsum(count) - count, count
            self.used += len(ids)

    def _together(self, texts: list[str]) -> list[bytes]:
        """The ids of simple texts."""
        raw = "\n".join(texts).lower().encode("latin-1")
        data = np.frombuffer(raw, dtype=np.uint8)
        begin, end = runs(data)
        unique, first, inverse = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > self.limit:
            self._forget()
        rep = first[inverse]
        if not same_spans(data, begin, end, data, begin[rep], end[rep]).all():
            return [self._other(t) for t in texts]
        where = np.searchsorted(self.keys, unique)
        new = np.flatnonzero((where == len(self.keys)) | (self.keys[np.minimum(where, len(self.keys) - 1)] != unique) if len(self.keys) else np.ones(len(unique), dtype=bool))
        if len(new):
            places = first[new]
            self._learn(unique[new], [raw[b:e].decode("latin-1") for b, e in zip(begin[places].tolist(), end[places].tolist(), strict=True)])
            where = np.searchsorted(self.keys, unique)
        at = self.place[where].astype(np.int64)
        if not same_spans(data, begin[first], end[first], self.text[: self.text_end[-1]], self.text_end[at], self.text_end[at + 1]).all():
            return [self._other(t) for t in texts]
        run = self.place[where][inverse]
        count = self.count[run].astype(np.int64)
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.flat[np.repeat(self.begin[run] - upto + count, count) + np.arange(total)].astype("<u4").tobytes()
        ends = np.cumsum([len(t) + 1 for t in texts])
        cut = np.concatenate([[0], upto])[np.searchsorted(begin, ends)] * 4
        return [ids[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]

    def _other(self, text: str) -> bytes:
        """Any text; ASCII white space parts words in every step of the file."""
        words = text.encode().split()
        for word in self.words.unknown(set(words)):
            self.words[word] = self._whole(word.decode())
        return b"".join(map(self.words.__getitem__, words))

    def pack(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        simple = [bool(_SIMPLE.fullmatch(t)) and "<|" not in t for t in texts]
        together = iter(self._together([t for t, s in zip(texts, simple, strict=True) if s]) if any(simple) else ())
        return [next(together) if s else self._other(t) for t, s in zip(texts, simple, strict=True)]


@lru_cache(maxsize=1)
def word_ids(path: str | None = None) -> WordIds:
    return WordIds(path)


#: A printable ASCII character and then a space or line feed: no match of the pattern has white space after anything else.
_SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")
#: Long runs of the pattern's white space, on which the library's matcher runs out of stack.
_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


class RankIds:
    """Byte-pair ids by a file of ranks, without special tokens.

    In a long run of white space all but the last character are one match of the
    pattern, or all of it at the text's end, so that match is encoded by itself.
    """

    def __init__(self, path: str | None = None, pattern: str | None = None, cut: int = 50_000) -> None:
        import tiktoken

        with open(path or public_tokenizers.path(RANK_FILE), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("leafloom", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = cut

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.cut:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        at = 0
        for gap in _GAP.finditer(text):
            self._add(out, text, at, gap.start())
            at = gap.end() if gap.end() == len(text) else gap.end() - 1
            out += self.encoding._core_bpe.encode_single_piece(text[gap.start() : at].encode())
        self._add(out, text, at, len(text))
        return out

    def _add(self, out: list[int], text: str, at: int, end: int) -> None:
        """The ids of text[at:end], cut where no match can span the cut."""
        while at < end:
            safe = _SAFE.search(text, min(end, at + self.cut), end)
            to = safe.start() if safe else end
            out += self.encoding.encode_ordinary(text[at:to])
            at = to

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=1)
def rank_ids(path: str | None = None, pattern: str | None = None) -> RankIds:
    return RankIds(path, pattern)
