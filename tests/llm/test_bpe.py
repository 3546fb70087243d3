import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.bpe import WordBpe, bpe_round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(PATH)


def same(bpe, library, texts):
    for text, (ids, decoded) in zip(texts, bpe.encode_all(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded == bpe.decode(want) == library.decode(want, skip_special_tokens=False)


def test_odd_texts(bpe, library):
    same(bpe, library, ["", " ", "Hello World's I'VE <|endoftext|>x<|startoftext|>", "ΑΣ ΟΔΟΣ", "İstanbul", "é a ́ ½²३", "\x1c\x1d\x85 　", "日本語 🎉🎉", "'S 'LL ''' 12345", "a" * 5000, "<|EndOfText|> <|endoftext"])


def test_joined_vocabulary_entries(bpe, library):
    rng, entries = random.Random(1), list(bpe.ids)
    plain = [e for e in bpe.names.values() if e.isascii()]
    same(bpe, library, ["".join(rng.choice(plain).replace("</w>", rng.choice(["", " "])) for _ in range(rng.randint(1, 6))) for _ in range(1500)])
    assert entries


def test_random_letters_and_scripts(bpe, library):
    rng = random.Random(2)
    same(bpe, library, ["".join(rng.choice("abcdehinorst'e tnoa") for _ in range(rng.randint(1, 60))) for _ in range(800)])
    ranges = ((0, 0x2FF), (0x370, 0x3FF), (0x400, 0xD7FF), (0x1F300, 0x1F6FF))
    same(bpe, library, ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(20)) for _ in range(500)])


def test_whole_arrays_and_single_words_agree(bpe):
    words = random.Random(3).sample([w for w in bpe.words if len(w) < 30], 300)
    other = WordBpe(PATH)
    other.learn(set(words))
    for w in words:
        s = "".join(other.letters[b] for b in w.encode())
        assert other.words[w] == other.packed(other.word(s[:-1] + other.last_letter[s[-1]]))


def test_documents(spark, library):
    rows = [(1, "Some Text here.", "x"), (2, None, "y"), (3, "", "z"), (1, "Some Text here.", "x"), (None, "long " * 20000, "w")]
    got = bpe_round_trip(spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string"), PATH).collect()
    assert len(got) == 5
    for r, (i, text, _) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0])), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.doc_id, r.n_tokens) == (i, len(ids)) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in got if r.doc_id in (2, 3)] == [(2, 0, nothing, nothing), (3, 0, nothing, nothing)]
    assert [r.n_tokens for r in got if r.doc_id is None] == [20000]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe_round_trip(empty, PATH).count() == 0
