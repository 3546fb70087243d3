"""BPE encoding and decoding by dynamic programming over prefixes.

``last[i]`` is the one token that ends the encoding of the first ``i`` symbols of a word. It is found
among the vocabulary entries that end there (all of them come from one automaton scan, longest first):
the encoding of prefix ``i - len(t)`` ends in a known token ``p``, and ``t`` is right exactly when the
pair ``(p, t)`` is what merging its text would leave. Back-pointers then give the ids.

The vocabulary is one of whole words with an end-of-word suffix (white space is dropped, letters are
lower-cased). A word's ids do not depend on its neighbours, so a bounded per-worker memo spares
repeated words.

Nulls count as empty texts; an empty text has no ids and decodes to the empty string; texts are never
cut; repeated rows give repeated rows; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.common import arrow_schema, lean, per_text, resolved

#: The words of the vocabulary's cutter, over lower-cased Latin text (all below U+0250).
LATIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"|[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+"
    r"|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    r"|[^\t-\r \x85\xa0A-Za-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\u024f]+"
)
STRANGE = re.compile("[^\0-\u024f]")
LAST, MEMO = 1024, 400_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Table:
    """A map from non-negative 64-bit numbers to numbers, asked and filled by whole arrays (open addressing)."""

    def __init__(self, size: int = 1 << 12):
        self.keys, self.values, self.n = np.full(size, -1, np.int64), np.zeros(size, np.int32), 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place where it would go."""
        mask = np.uint64(len(self.keys) - 1)
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = ((h ^ (h >> np.uint64(29))) >> np.uint64(7) & mask).astype(np.int64)
        held = self.keys[at]
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(mask)
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held != -1)]
        return at

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots(keys)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in yet."""
        while (self.n + len(keys)) * 3 > len(self.keys):
            old, kept = self.keys[self.keys != -1], self.values[self.keys != -1]
            size = 4 * len(self.keys)
            self.keys, self.values, self.n = np.full(size, -1, np.int64), np.zeros(size, np.int32), 0
            self.put(old, kept)
        todo, vals = keys, values
        while len(todo):
            at = self.slots(todo)
            self.keys[at] = todo  # of several that want one place, the last stays
            won = self.keys[at] == todo
            self.values[at[won]] = vals[won]
            todo, vals = todo[~won], vals[~won]
        self.n += len(keys)


class Fits(dict):
    """Whether a pair of tokens, as one number, is compatible; worked out when first asked for."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe

    def __missing__(self, pair: int) -> bool:
        if len(self) >= 3 * MEMO:
            self.clear()
        ok = self[pair] = self.bpe.compatible(pair >> 32, pair & 0xFFFFFFFF)
        return ok


class WordBpe:
    """Encoder and decoder for a vocabulary file of the ``tokenizers`` library (model BPE with a word end)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        library = Tokenizer.from_file(path)
        self.normal, self.cutter = library.normalizer, library.pre_tokenizer
        self.marks = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.letters = byte_letters()
        self.last_letter = {c: chr(ord(c) + LAST) for c in self.letters}  # a word's last symbol is its own letter
        self.ids = {self.inner(t): i for t, i in vocab.items()}
        self.size = [0] * (max(self.names) + 1)
        self.rank, self.parts, self.joined = {}, {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.joined.setdefault((left, right), r)
            if both not in self.rank:
                self.rank[both], self.parts[both] = r, (left, right)
        self.fits, self.words, self.pairs = Fits(self), {}, Table()
        self.found = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.size[i] = len(t)
            if len(t) == 1 or self._whole(i):
                self.found.add_word(t, i)
        self.found.make_automaton()
        self._automaton()
        self.lengths = np.array(self.size, np.int64)
        self.spaced = {i: " " + t for i, t in self.names.items()}

    def _automaton(self) -> None:
        """The vocabulary as numbered states: ``step`` goes from state and symbol to the next, ``ends`` tells the token."""
        states, ends = {"": 0}, [-1]
        for t in self.found:
            for n in range(1, len(t) + 1):
                if states.setdefault(t[:n], len(ends)) == len(ends):
                    ends.append(-1)
            ends[states[t]] = self.ids[t]
        self.step = Table()
        keys = np.array([states[t[:-1]] << 12 | ord(t[-1]) for t in states if t], np.int64)
        self.step.put(keys, np.array([n for t, n in states.items() if t], np.int32))
        self.ends = np.array(ends, np.int64)
        self.longest = max(map(len, self.found))

    def inner(self, token: str) -> str:
        """The token as the automaton knows it: a word end belongs to the letter before it."""
        bare = token.removesuffix(self.end)
        return token if bare in ("", token) else bare[:-1] + self.last_letter[bare[-1]]

    def _whole(self, token: int) -> bool:
        """Whether merging the token's own text gives the token again."""
        return token in self.parts and self.compatible(*self.parts[token], self.rank[token])

    def compatible(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether no merge that would come before ``limit`` crosses the border of two finished tokens.

        The tokens are undone from the youngest merge on. While both sides stand as they did at some
        moment of merging, the border would have closed if they form a pair older than what undid them.
        """
        rank, parts, joined = self.rank, self.parts, self.joined
        while True:
            r = joined.get((left, right))
            if r is not None and r < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # equal merges go from left to right, so of the same ones the right one is younger
                limit, left = min(limit, a), parts[left][1]
            else:
                limit, right = min(limit, b + 1), parts[right][0]

    def word(self, text: str) -> list[int]:
        """Ids of one word of letters for bytes, the last one being a word end."""
        last = [-1] * len(text)
        size, fits, done = self.size, self.fits, -1
        for end, token in self.found.iter(text):
            if end != done:
                start = end - size[token]
                if start < 0 or fits[last[start] << 32 | token]:
                    last[end], done = token, end
        out, i = [], len(text) - 1
        while i >= 0:
            out.append(last[i])
            i -= size[last[i]]
        return out[::-1]

    def packed(self, ids: list[int]) -> tuple[bytes, str]:
        return array("I", ids).tobytes(), "".join([" " + self.names[i] for i in ids])

    def fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        pairs = before << 32 | token
        got = self.pairs.get(pairs)
        if (got < 0).any():
            new = np.unique(pairs[got < 0])
            if self.pairs.n > 4 * MEMO:
                self.pairs = Table()
                new = np.unique(pairs)
            self.pairs.put(new, np.array([self.compatible(p >> 32, p & 0xFFFFFFFF) for p in new.tolist()], np.int32))
            got = self.pairs.get(pairs)
        return got > 0

    def many(self, spelt: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``word`` for words of ``n`` symbols each: all ids in a row, and how many each has."""
        codes = np.frombuffer("".join(spelt).encode("utf-32-le"), "<u4").astype(np.int64).reshape(-1, n).T
        rows = codes.shape[1]
        matches: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for start in range(n):
            who, state = np.arange(rows), np.zeros(rows, np.int64)
            for end in range(start, min(n, start + self.longest)):
                state = self.step.get(state << 12 | codes[end, who])
                who, state = who[state >= 0], state[state >= 0].astype(np.int64)
                if not len(who):
                    break
                token = self.ends[state]
                hit = token >= 0
                if hit.any():
                    matches[start, end] = who[hit], token[hit]
        last = np.full((n, rows), -1, np.int64)
        for end in range(n):
            for start in range(end + 1):  # longest first
                if (start, end) in matches:
                    who, token = matches[start, end]
                    free = last[end, who] < 0
                    who, token = who[free], token[free]
                    if start and len(who):
                        ok = self.fit(last[start - 1, who], token)
                        who, token = who[ok], token[ok]
                    last[end, who] = token
        out = np.full((n, rows), -1, np.int64)
        at, who = np.full(rows, n - 1), np.arange(rows)
        for k in range(n - 1, -1, -1):
            token = last[at[who], who]
            out[k, who] = token
            at[who] -= self.lengths[token]
            who = who[at[who] >= 0]
            if not len(who):
                break
        return out.T[out.T >= 0], (out >= 0).sum(0)

    def learn(self, words: set[str]) -> None:
        """Puts words into the memo; those of one length go together."""
        by: dict[int, list[tuple[str, str]]] = {}
        for w in words:
            spelt = w if w.isascii() else "".join([self.letters[b] for b in w.encode("utf-8")])
            by.setdefault(len(spelt), []).append((w, spelt[:-1] + self.last_letter[spelt[-1]]))
        for n, group in by.items():
            if len(group) < 4 * n:
                self.words.update((w, self.packed(self.word(spelt))) for w, spelt in group)
                continue
            ids, counts = self.many([spelt for _, spelt in group], n)
            packed, names = ids.astype("<u4").tobytes(), list(map(self.spaced.__getitem__, ids.tolist()))
            at = 0
            for (w, _), k in zip(group, counts.tolist(), strict=True):
                self.words[w] = packed[4 * at : 4 * (at + k)], "".join(names[at : at + k])
                at += k

    def plain(self, text: str) -> list[str] | list[tuple[bytes, str]]:
        """A text without special tokens as words still to be looked up, or its words' ids.

        Beyond Latin letters the library's own normaliser and word cutter are asked, as their Unicode
        tables may be of another version than Python's.
        """
        if text.isascii() or not STRANGE.search(text):
            return LATIN.findall(unicodedata.normalize("NFC", text).lower())
        spelt = [w for w, _ in self.cutter.pre_tokenize_str(self.normal.normalize_str(text))]
        return [self.packed(self.word(w[:-1] + self.last_letter[w[-1]])) for w in spelt]

    def parts_of(self, text: str) -> list[str | tuple[bytes, str]]:
        at, out = 0, []
        for mark in self.marks.finditer(text) if self.marks and "<" in text else ():
            out += self.plain(text[at : mark.start()])
            out.append(self.packed([self.special[mark[0]]]))
            at = mark.end()
        return out + self.plain(text[at:]) if at else self.plain(text)

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Of each text its ids as little-endian unsigned 32-bit integers, and the decoded text (tokens joined by a space)."""
        parts = list(map(self.parts_of, texts))
        new: set = set().union(*parts)
        new = {w for w in new if w not in self.words and isinstance(w, str)}
        if len(self.words) + len(new) > MEMO:
            self.words = {}
            new = {w for w in set().union(*parts) if isinstance(w, str)}
        self.learn(new)
        known, out = self.words, []
        for words in parts:
            got = [known[w] if w.__class__ is str else w for w in words]
            out.append((b"".join([p[0] for p in got]), "".join([p[1] for p in got])[1:]))
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids if i in self.names])


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """One encoder a worker, kept from task to task."""
    return WordBpe(path)


def bpe_round_trip(docs: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its number of ids, the SHA-256 of the ids and that of the decoded text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    def make():
        bpe = loaded(resolved(path))

        def work(texts: list[str]) -> dict[str, list]:
            both = bpe.encode_all(texts)
            return {
                "n_tokens": [len(ids) // 4 for ids, _ in both],
                "ids_sha256": [hashlib.sha256(ids).hexdigest() for ids, _ in both],
                "decoded_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for _, t in both],
            }

        return work

    arrow: pa.Schema = arrow_schema(T._parse_datatype_string(schema))
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(per_text(make, arrow)), schema)
