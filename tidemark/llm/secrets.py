"""Secret scans: fixed patterns, then strings that are news to their surroundings.

Base spans, per kind leftmost and non-overlapping: assignments to a secret-like name, access key ids,
hexadecimal runs. The method adds spans of kind ``novel``: a candidate is a run of key-like characters
near a sensitive word. A zstandard compressor is primed with a dictionary of common identifiers and the
text around the candidate, and fed letters as they are frequent in identifiers, so that literals are
entropy-coded by them; what the candidate adds to that is its marginal size. Repeats and known identifiers
cost next to nothing, other words and names some 0.5 to 0.8 bytes a character, random material a byte and
more, so the marginal size alone tells a secret, whatever characters it is made of. Keys of 16 to 20 small
letters and digits may pass for names. Repeats of a candidate, and of its parts between equals signs, are cut out
of the surroundings, so a key that is set and used again is judged in each place as if it stood alone; only what
stands once more within ``NEAR`` characters of itself is no news there.

Offsets are code points, ends exclusive. A null text is an empty one and has no spans; repeated rows
give repeated rows; texts of any length are scanned whole; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import random
import re
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_schema, lean, per_text, slices

#: The base patterns, with the least length of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEXADECIMAL = re.compile(r"[0-9a-f]{16,}")
ASSIGNED = 12
KINDS = ("assign", "access", "hex", "novel")
#: Words beside which a random string is likely a secret, and identifiers that are not news.
SENSITIVE = re.compile(r"api|auth|bearer|cert|cred|key|login|pass|private|pwd|secret|session|sign|token", re.I | re.A)
IDENTIFIERS = (
    b"password passwd secret token api_key apikey access_key secret_key private_key public_key session_id client_id "
    b"client_secret authorization bearer credentials username user_name login signature certificate config settings "
    b"environment variable default example localhost production development application service request response "
    b"header content-type application/json text/html https://www. .com .org .net /api/v1/ /usr/local/ import export "
    b"return function const string number boolean object array index length value result error message 0123456789 "
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ \n"
)
SHORTEST, AROUND, NEAR = 16, 1024, 48
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
FRAME = 3  # bytes by which a size may be off
LETTERS = "".join(random.Random(5).choices(IDENTIFIERS.decode().split("0123456789")[0], k=1024)).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEXADECIMAL.finditer(text)]
    return sorted(found)


def marginal_bytes(candidate: str, around: str) -> int:
    """Compressed bytes that the candidate adds to the letters, given its surroundings and the identifiers."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    zip_ = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(zip_.compress(LETTERS + candidate.encode("utf-8"))) - len(zip_.compress(LETTERS))


def surroundings(text: str, start: int, end: int) -> str:
    """The text around a candidate, without it and without its repeats that are not right beside it."""
    low, high = max(0, start - AROUND), min(len(text), end + AROUND)
    word, cuts = text[start:end], [(start, end)]
    for part in {word, *(p for p in word.split("=") if len(p) >= SHORTEST)}:
        at = text.find(part, max(0, low - len(part) + 1), high + len(part) - 1)
        while at >= 0:
            if at + len(part) + NEAR <= start or at >= end + NEAR:
                cuts.append((at, at + len(part)))
            at = text.find(part, at + 1, high + len(part) - 1)
    out, done = [], low
    for a, b in sorted(cuts):
        out.append(text[done:a] if a > done else "")
        done = max(done, b)
    return "".join([*out, text[done:high] if done < high else ""])


def novel_spans(text: str, taken: list[tuple[int, int, int]], least: float = 0.8) -> list[tuple[int, int, int]]:
    """Strings near a sensitive word whose marginal size is ``least`` of their length and a few bytes, or more.

    What base spans cover whole isn't looked at again.
    """
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(taken) and taken[k][2] <= start:
            k += 1
        at = start
        for low, _, high in islice(taken, k, None):
            if low > at or at >= end:
                break
            at = max(at, high)
        if at >= end:
            continue
        word = m[0]
        if SENSITIVE.search(text, max(0, start - NEAR), min(len(text), end + NEAR)):
            if marginal_bytes(word, surroundings(text, start, end)) >= least * len(word) + FRAME:
                out.append((start, 3, end))
    return out


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base))


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of spans of each base kind, SHA-256 of the base spans, and all spans as text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string"

    def make():
        def work(texts: list[str]) -> dict[str, list]:
            both = [all_spans(t) for t in texts]
            out = {f"n_{k}": [sum(s[1] == i for s in spans) for _, spans in both] for i, k in enumerate(KINDS)}
            out["base_sha256"] = [hashlib.sha256(told(base).encode()).hexdigest() for base, _ in both]
            out["spans"] = [told(spans) for _, spans in both]
            return out

        return work

    arrow = arrow_schema(T._parse_datatype_string(schema))
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(per_text(make, arrow)), schema)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mask`` in the text; overlapping spans become one. Null stays null."""
    arrow = arrow_schema(docs.schema)
    at = docs.columns.index(text_col)

    def hidden(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for start, _, end in all_spans(text)[1]:
            if start >= done:
                out += [text[done:start], mask]
            done = max(done, end)
        return "".join([*out, text[done:]]) if out else text

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1024, 4 << 20, at):
                text = pa.array([hidden(t) for t in part.column(at).to_pylist()], arrow.field(at).type)
                yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(part.columns)], schema=arrow)

    return docs.mapInArrow(lean(run), docs.schema)
