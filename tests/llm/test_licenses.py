import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tidemark.llm import licenses
from tidemark.llm.licenses import TEMPLATES, Templates


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def shingles(w):
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def test_every_template_is_found_in_any_place():
    rng, known = random.Random(1), Templates(TEMPLATES)
    texts = []
    for name in known.names:
        before = " ".join("".join(rng.choice("etaoin") for _ in range(4)) for _ in range(rng.randint(0, 70)))
        texts.append(f"{before} {TEMPLATES[name]} {before}")
    for name, found in zip(known.names, known.matches(pa.array(texts)), strict=True):
        assert name in {known.names[t] for _, _, t in found}


def test_matches_hold_three_quarters_and_none_is_missed():
    rng, known = random.Random(2), Templates(TEMPLATES)
    texts = []
    for _ in range(150):
        w = []
        for _ in range(rng.randint(1, 4)):
            t = words(rng.choice(list(TEMPLATES.values())))
            for _ in range(rng.randint(0, max(1, len(t) // 15))):
                t[rng.randrange(len(t))] = "changed"
            w += [f"x{rng.randint(0, 99)}" for _ in range(rng.randint(0, 40))] + t[rng.randint(0, 2) :]
        texts.append(" ".join(w))
    for text, found in zip(texts, known.matches(pa.array(texts)), strict=True):
        s = shingles(words(text))
        for t, name in enumerate(known.names):
            whole = set(shingles(words(TEMPLATES[name])))
            n = len(words(TEMPLATES[name]))
            best = max((len(whole & set(s[k : k + max(1, n - 4)])) for k in range(len(s))), default=0)
            if best >= licenses.SHARE * len(whole):  # a passage as long as the template holds enough
                assert t in {m[2] for m in found}, (name, text)
        for lo, hi, t in found:
            whole = set(shingles(words(TEMPLATES[known.names[t]])))
            assert len(whole & set(shingles(words(text)[lo:hi]))) >= licenses.SHARE * len(whole)


def test_notices_of_the_given_documents_are_found():
    notices = {
        "mit-notice": "Released under the MIT License.", "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
        "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    }
    column = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).combine_chunks()
    known, seen = Templates(TEMPLATES), set()
    for text, found in zip(column.to_pylist(), known.matches(column), strict=True):
        want = {name for name, notice in notices.items() if notice in (text or "")}
        assert want <= {known.names[t] for _, _, t in found}
        assert want or not re.search("(?i)licensed under|released under", text or "")  # there are no others
        seen |= want
    assert seen == set(notices)


def test_common_short_notices_are_told_apart():
    known = Templates(TEMPLATES)
    texts = {f"cc-{k}-{v}": f"Licensed under CC {k.upper()} {v}." for k in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("4.0", "3.0")}
    texts |= {"lgpl-3-notice": "This work is licensed under the GNU Lesser General Public License, version 3.", "cc0-1.0": "Licensed under CC0 1.0."}
    for name, found in zip(texts, known.matches(pa.array(texts.values())), strict=True):
        assert {known.names[t] for _, _, t in found} == {name}


def test_a_text_has_the_same_matches_in_any_company():
    rng, known = random.Random(5), Templates(TEMPLATES)
    texts = []
    for _ in range(120):
        w = words(rng.choice(list(TEMPLATES.values())))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at:at] = [f"x{rng.randint(0, 99)}" for _ in range(rng.randint(1, 6))]
        texts.append(" ".join(f"y{k}" for k in range(rng.randint(0, 30))) + " " + " ".join(w))
    alone = [known.matches(pa.array([t]))[0] for t in texts]
    assert known.matches(pa.array(texts)) == alone
    assert known.matches(pa.array(["one two three", *texts]))[1:] == alone


def test_whole_license_texts_are_found():
    whole = licenses.whole_texts()
    assert len(whole) >= 12 and all(len(t) > 500 for t in whole.values())
    known = Templates(TEMPLATES | whole)
    rng = random.Random(6)
    for name, text in whole.items():
        w = text.split()
        for _ in range(len(w) // 100):
            w[rng.randrange(len(w))] = "changed"
        found = known.matches(pa.array(["before " * 37 + " ".join(w) + " after" * 50]))[0]
        assert name in {known.names[t] for _, _, t in found}
        assert not any(known.names[t].endswith("-text") for _, _, t in known.matches(pa.array([" ".join(w[: len(w) // 2])]))[0])


def test_bands_make_a_miss_unlikely():
    assert 1 - (1 - 0.17) ** licenses.BANDS > 0.9999


def test_documents(spark):
    notice = TEMPLATES["mit-notice"]
    rows = [(1, f"a {notice} b", "x"), (2, None, "x"), (3, "", "x"), (4, notice.upper().replace(" ", "\n"), "x"), (1, f"a {notice} b", "x"), (None, "w " * 50000 + notice, "x"), (5, "Released under the", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, matches string")
    got = sorted(map(tuple, licenses.scan(docs).collect()), key=repr)
    hit = (1, 1, "mit-notice:1:6")
    assert got == sorted([hit, hit, (2, 0, ""), (3, 0, ""), (4, 1, "mit-notice:0:5"), (None, 1, "mit-notice:50000:50005"), (5, 0, "")], key=repr)
    assert licenses.scan(docs.limit(0)).count() == 0
    assert np.uint64(0) != licenses.NEVER
