"""Secret scanning: fixed patterns, and token efficiency for what they miss.

*Base kinds*, leftmost and not overlapping within a kind:

- ``assign``: a password, secret, token or API key with an assigned value of 6 or more characters,
- ``access``: ``AKIA`` and capitals or digits, 20 or more characters,
- ``hex``: 24 or more lower-case hexadecimal digits.

*Token efficiency* (``token``): a maximal run of 20 or more ``[A-Za-z0-9+/_=-]`` that has letters and
digits and fewer than ``ratio`` characters a token under a byte-level BPE vocabulary, as
random strings have.  UUIDs and identifiers (words joined by underscores, hyphens, slashes or capitals, with at
most a number at the end of each) are excluded first.  Random capitals and digits can be cut into such pieces too, so
the pieces of an identifier, and of each long part of it, must also have the characters a token of words.
Hexadecimal keys look like digests, so neither is excluded.  Spans that overlap a base span are not added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.tokens import default_vocabulary, encoder

KINDS = ("assign", "access", "hex", "token")
# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
NAME_PART = re.compile(r"[A-Z]*[a-z]{2,}\d{0,4}|[A-Z]{2,}\d{0,4}|\d{1,4}")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Letters a token, in lower case, from which pieces are words: random ones have about 1.5, those of identifiers 4.
WORD_RATIO = 2.2
LONG_PART = 12


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order; offsets are code points."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def like_words(text: str, encode) -> bool:
    words = WORD.findall(text)
    return sum(map(len, words)) >= WORD_RATIO * sum(len(encode(f" {w.lower()}")) for w in words)


def is_known(run: str, encode) -> bool:
    """A UUID or an identifier."""
    if UUID.fullmatch(run):
        return True
    parts = [p for p in re.split(r"[+/_=-]+", run) if p]
    named = all("".join(NAME_PART.findall(p)) == p and len(NAME_PART.findall(p)) <= 1 + len(p) // 4 for p in parts)
    return named and like_words(run, encode) and all(like_words(p, encode) for p in parts if len(p) >= LONG_PART)


def token_spans(text: str, taken: list[tuple[int, int, int]], encode, ratio: float) -> list[tuple[int, int, int]]:
    out = []
    for m in RUN.finditer(text):
        run = m.group()
        if run.isalpha() or run.isdigit() or not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
            continue
        if any(s < m.end() and m.start() < e for s, _, e in taken) or is_known(run, encode):
            continue
        if len(run) < ratio * len(encode(run)):
            out.append((m.start(), 3, m.end()))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(vocabulary: str, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = []
            for text in batch.column(0).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans.append(sorted(base + token_spans(text, base, encode, ratio)))
            rest = batch.schema.names[1:]
            made = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(made, kind)], names=[*rest, "__spans"])

    return run


def find_secrets(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, ratio: float = 2.0) -> DataFrame:
    """(*carry, spans array<struct<kind, start, end>>) for every input row.

    Spans are in order of start, then of kind as listed in ``KINDS``; offsets are code points, ends
    exclusive.  Null and empty texts have none.  Whole texts are scanned, however long; repeated rows each have their
    spans, and spans of two base kinds may overlap.  Columns in ``carry`` pass through; others are ignored.
    """
    src = docs.select(F.col(text_col).cast("string").alias("__text"), *(F.col(c).alias(f"__c_{c}") for c in carry))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[1:])
    out = src.mapInArrow(_scan(vocabulary or default_vocabulary(), ratio), f"{kinds}__spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.select(*(F.col(f"__c_{c}").alias(c) for c in carry), F.col("__spans").alias("spans"))


def secret_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and the listed spans, from :func:`find_secrets`."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "token")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with each span, overlapping ones merged, replaced by ``mark``."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])
