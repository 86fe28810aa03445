"""Secret scan: fixed patterns, and the novelty of strings in sensitive context.

Patterns (kinds ``assign``, ``access``, ``hex``) give the base spans. Beyond them, strings in sensitive context are candidates (kind
``novel``). Zstandard, primed with identifiers, compresses the text around a candidate with and without it: the extra
bytes for each of its characters are its novelty. Prose, identifiers and whatever the surroundings repeat cost little, random material almost a
byte a character. The dictionary holds a fixed list of identifiers and the commonest of all texts of the table (``learn``).

A candidate is a maximal string of LEAST_LENGTH or more letters, digits and ``+/_~!@#$%^&*-`` (with up to two ``=`` behind), under these conditions:
it holds, or lies within REACH characters of, a sensitive word; and it mixes two kinds of characters among small letters, digits and capitals other than a
first one. Strings of one kind only are words as a rule and never candidates. It is measured against AROUND characters on either side. REACH and AROUND are
parameters.

Defined cases: a null text counts as empty and has no spans. Positions are code points, the end exclusive. A candidate that
overlaps a base span is not reported again. Whole texts are scanned, in time linear in their length. Repeated rows are each reported; ``scan`` ignores
other columns, ``redact`` passes them on. An empty table gives an empty result, and a dictionary of the fixed list alone.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import Batches, map_batches

# Patterns and least lengths of the base kinds, in the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = (*ASSIGN_WORDS, "pwd", "passphrase", "credential", "private", "bearer", "authorization", "signature", "session", "client_id", "access_key", "license key", "ssh-rsa", "jwt")
IDENTIFIERS = """
import from return class def function const let var static public private protected void string int bool float double
true false null none self this new try except catch finally raise throw async await lambda yield while for if else
config settings environment production staging development localhost database host port username user email url path
request response header authorization bearer basic token session cookie client server secret password passwd
api_key apikey access_key secret_key private_key public_key certificate signature encrypt decrypt base64 sha256 md5
https http www com org net example index main test value name type data list dict array object json yaml xml
print open read write close get set put post delete update insert select where group order limit
"""

_NEAR = re.compile("|".join(map(re.escape, SENSITIVE)))
LEAST_LENGTH = 12
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_~!@#$%^&*-]{{{LEAST_LENGTH},}}={{0,2}}")
_MIXED = (re.compile(r"[a-z]"), re.compile(r"[0-9]"), re.compile(r"(?<=.)[A-Z]", re.DOTALL))
_IDENTIFIER = "[A-Za-z_]{4,40}"
#: Texts that a learned identifier occurs in at least, and bytes of them kept.
LEAST_TEXTS, LEARNED_BYTES = 3, 1 << 15
#: Defaults of ``scan`` and ``redact``: characters between a candidate and a sensitive word; characters of surroundings on
#: either side against which its novelty is measured; the least novelty reported.
REACH, AROUND, LEAST_NOVELTY = 80, 256, 0.7


def _novelty(c: zstandard.ZstdCompressor, text: str, start: int, end: int, around: int) -> float:
    before, after = text[max(0, start - around) : start].encode(), text[end : end + around].encode()
    found = text[start:end].encode()
    return (len(c.compress(before + found + after)) - len(c.compress(before + after))) / len(found)


def learn(docs: DataFrame, text_col: str = "text", rows: int | None = None) -> str:
    """Identifiers (letters and underscores) of all texts, or of about ``rows`` where a caller asks for so few; the commonest last, where Zstandard reaches them at least cost.

    Each text counts once and a word has to occur in LEAST_TEXTS, so that a secret that one text repeats is no identifier. The driver gets
    LEARNED_BYTES of words at most.
    """
    if rows is not None and (n := docs.count()) > rows:
        docs = docs.where(F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(11)), F.lit(1_000_000)) < 1_000_000 * rows // n)
    words = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(_IDENTIFIER), F.lit(0)))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS)
    # a word and its blank take five bytes at least
    best = counted.orderBy(F.desc("n"), "word").limit(LEARNED_BYTES // 5).collect()
    kept, size = [], 0
    for r in best:
        size += len(r["word"]) + 1
        if size > LEARNED_BYTES:
            break
        kept.append(r["word"])
    return " ".join(reversed(kept))


def compressor(learned: str = "") -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(f"{learned}\n{IDENTIFIERS}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, leftmost and non-overlapping in each kind."""
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str, reach: int = REACH) -> Iterator[tuple[int, int]]:
    """Spans of maximal strings of mixed characters that hold a sensitive word or lie within ``reach`` of one."""
    # the only letter whose lower case has two code points; so positions in the lowered text are those in the text
    near = [m.span() for m in _NEAR.finditer(text.replace("\u0130", "i").lower())]
    if not near:
        return
    ends = [b for _, b in near]
    for m in _CANDIDATE.finditer(text):
        k = bisect_left(ends, m.start() - reach)
        if k < len(near) and near[k][0] <= m.end() + reach and sum(bool(x.search(m[0])) for x in _MIXED) > 1:
            yield m.span()


def scan_text(text: str, c: zstandard.ZstdCompressor, reach: int = REACH, around: int = AROUND) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]:
    """Base spans, all spans, and the greatest novelty among them (0 without any)."""
    base = base_spans(text)
    starts, ends = [a for a, _, _ in base], list(itertools.accumulate((b for _, _, b in base), max))
    more, most = [], 0.0
    for a, b in candidates(text, reach):
        ahead = bisect_left(starts, b)  # base spans that begin before the candidate ends
        if ahead and ends[ahead - 1] > a:
            continue
        if (x := _novelty(c, text, a, b, around)) >= LEAST_NOVELTY:
            more.append((a, 3, b))
            most = max(most, x)
    for a, _, b in base:
        most = max(most, _novelty(c, text, a, b, around))
    return base, sorted(base + more), most


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, learned: str = "", id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, around: int = AROUND) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, n_novel, base_sha256, spans (kind:start:end by start), max_novelty. ``learned`` is what ``learn`` gave."""

    def run(batches: Batches) -> Batches:
        c = compressor(learned)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans, most = scan_text(text.as_py() or "", c, reach, around)
                kinds = [k for _, k, _ in spans]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), most))
            types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names)

    names = [id_col, "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "max_novelty"]
    ids = docs.select(F.col(id_col), F.col(text_col))
    kinds = (*[T.LongType()] * 4, T.StringType(), T.StringType(), T.DoubleType())
    return map_batches(ids, run, T.StructType([ids.schema.fields[0], *(T.StructField(n, t) for n, t in zip(names[1:], kinds, strict=True))]))


def redact(docs: DataFrame, learned: str = "", text_col: str = "text", mark: str = "[SECRET]", reach: int = REACH, around: int = AROUND) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; all rows stay, null texts stay null."""

    def clean(text: str | None, c: zstandard.ZstdCompressor) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for a, _, b in scan_text(text, c, reach, around)[1]:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Batches) -> Batches:
        c = compressor(learned)
        for batch in batches:
            new = pa.array([clean(x.as_py(), c) for x in batch.column(at_text)], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at_text else x for k, x in enumerate(batch.columns)], batch.schema.names)

    at_text = docs.columns.index(text_col)
    return map_batches(docs, run, docs.schema)
