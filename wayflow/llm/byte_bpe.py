"""Byte-level BPE with the tokenizers library: encoding to ids with offsets in characters, and decoding.

A rank file lists byte strings and their ids. The library's model wants pairs to merge instead: the last merge of each byte string is what
the merges before it leave of that string alone. Bytes are written as printable characters for the model, as its byte-level step does.

The split pattern never matches across the border from a non-blank to a blank. So texts whose only blanks are space, tab and line ends are cut there
into units (blanks with the word behind them); a worker keeps the ids of units it has seen and encodes new ones many at a time,
told apart again by the lengths of their tokens in bytes. Other texts go to the library in stretches cut at such borders.

Offsets come from the tokens' byte lengths and the bytes at which characters start: a token that ends inside a character covers it, as
does the next. Decoding gathers the bytes of the ids; bytes that are no UTF-8, as where a piece of a text was cut inside a
character, become U+FFFD in the text, and ``decode_pieces`` carries such a rest over to the next piece.

Defined cases: a null or empty text has no ids. Strings of special tokens are ordinary text. Very long texts are read whole, in bounded stretches (a word
without blanks is one stretch). Repeated rows are each encoded; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import Batches, map_batches

#: Units whose ids a worker keeps, and their greatest length in characters.
KEPT_UNITS, KEPT_LENGTH = 400_000, 48
#: Characters of a stretch that the library sees at once, at least.
STRETCH = 1 << 16
#: Blanks besides space, tab and line ends; texts with one of them aren't cut into units.
_ODD = re.compile("[" + "".join(map(chr, (0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
_UNIT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_BORDER = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable in Latin-1, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    later = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(later)) for b in range(256)]


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that the merges of lower rank leave of a token that stands alone."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], len(ranks)), i) for i in range(len(parts) - 1))
        if rank >= ranks[token]:
            raise ValueError(f"no merges lead to {token!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class Codec:
    """Encoder and decoder of one rank file, given as its bytes."""

    def __init__(self, rank_file: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker is one core's, and forked
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
        shown = byte_characters()
        show = lambda token: "".join(shown[b] for b in token)
        merges = [tuple(map(show, last_merge(token, ranks))) for token in sorted(ranks, key=ranks.get) if len(token) > 1]
        self._model = Tokenizer(models.BPE(vocab={show(token): rank for token, rank in ranks.items()}, merges=merges))
        steps = [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self._model.pre_tokenizer = pre_tokenizers.Sequence(steps)
        back = {c: b for b, c in enumerate(shown)}
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in self._model.get_vocab().items():
            tokens[rank] = bytes(back[c] for c in token)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self._starts = np.cumsum(self.lengths) - self.lengths
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimals = [str(k) for k in range(len(tokens))]
        self._known: dict[str, bytes] = {}

    def _library(self, text: str) -> np.ndarray:
        return np.array(self._model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _stretched(self, text: str) -> bytes:
        """Ids of any text, in stretches that end at borders; like all ids held here as the bytes of 32-bit numbers, which join faster than arrays."""
        cuts = [0]
        while len(text) - cuts[-1] > STRETCH and (m := _BORDER.search(text, cuts[-1] + STRETCH)):
            cuts.append(m.start())
        return b"".join(self._library(text[a:b]).tobytes() for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True))

    def _new_units(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units that begin with a blank and end with none, many of them in one text; of the others one by one."""
        joined = [u for u in units if u[0] in " \t\n\r" and u[-1] not in " \t\n\r" and len(u) < STRETCH]
        found = {u: self._stretched(u) for u in set(units).difference(joined)}
        at = 0
        while at < len(joined):
            size, part = 0, []
            while at < len(joined) and size < STRETCH:
                part.append(joined[at])
                size += len(joined[at])
                at += 1
            ids = self._library("".join(part))
            ends = np.cumsum([len(u.encode()) for u in part])
            cuts = [0, *(4 * np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 4).tolist()]
            held = ids.tobytes()
            found.update((u, held[a:b]) for u, a, b in zip(part, cuts, cuts[1:]))
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        units = [_UNIT.findall(x) if not _ODD.search(x) else None for x in texts]
        known = self._known
        found = self._new_units(list(set().union(*filter(None, units)).difference(known)))
        if len(known) < KEPT_UNITS:
            known.update((u, ids) for u, ids in found.items() if len(u) <= KEPT_LENGTH)
        look = lambda u: known[u] if u in known else found[u]
        joined = [b"".join(map(look, us)) if us is not None else self._stretched(x) for us, x in zip(units, texts, strict=True)]
        return [np.frombuffer(x, np.int32) for x in joined]

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last, in code points of ``text``."""
        starting = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        of_byte = np.cumsum(starting) - 1  # the character that each byte belongs to
        ends = np.cumsum(self.lengths[ids])
        return of_byte[ends - self.lengths[ids]], of_byte[ends - 1] + 1

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        ids = np.asarray(ids, np.int64)
        size = self.lengths[ids]
        shift = np.repeat(self._starts[ids] - (np.cumsum(size) - size), size)
        return self._bytes[np.arange(len(shift)) + shift].tobytes()

    def decode_pieces(self, pieces: Iterable[np.ndarray]) -> Iterator[str]:
        """Texts of a document's consecutive pieces of ids. A character that a cut splits belongs to the piece that has its last byte."""
        import codecs

        utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        held = None
        for ids in pieces:
            if held is not None:
                yield utf8.decode(held)
            held = self.decode(ids)
        if held is not None:
            yield utf8.decode(held, final=True)


@functools.cache
def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec a Python worker, for all its tasks."""
    return Codec(rank_file, pattern)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _parts(batches: Batches, rows: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def _schema(df: DataFrame, id_col: str, **more: T.DataType) -> T.StructType:
    return T.StructType([df.schema[id_col], *(T.StructField(k, v) for k, v in more.items())])


def encode(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids, starts, ends (of each token, in code points)."""
    given = docs.sparkSession.sparkContext.broadcast((rank_file, pattern))

    def run(batches: Batches) -> Batches:
        c = codec(*given.value)
        for part in _parts(batches):
            texts = [x or "" for x in part.column(1).to_pylist()]
            ids = c.encode(texts)
            at = [c.offsets(x, y) for x, y in zip(texts, ids, strict=True)]
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (ids, [a for a, _ in at], [b for _, b in at])]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["id", "ids", "starts", "ends"])

    many = T.ArrayType(T.IntegerType())
    return map_batches(docs.select(id_col, text_col), run, _schema(docs, id_col, ids=many, starts=many, ends=many))


def decode(rows: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ids: id, bytes, text (U+FFFD for what is no UTF-8). Null ids count as none."""
    given = rows.sparkSession.sparkContext.broadcast((rank_file, pattern))

    def run(batches: Batches) -> Batches:
        c = codec(*given.value)
        for part in _parts(batches):
            data = [c.decode(np.array(x or [], np.int64)) for x in part.column(1).to_pylist()]
            texts = pa.array([x.decode("utf-8", "replace") for x in data], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary()), texts], ["id", "bytes", "text"])

    return map_batches(rows.select(id_col, ids_col), run, _schema(rows, id_col, bytes=T.BinaryType(), text=T.StringType()))


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256 (of the bytes that the ids decode to).

    One pass: ids are encoded, hashed and decoded in the task and never leave it.
    """
    given = docs.sparkSession.sparkContext.broadcast((rank_file, pattern))

    def run(batches: Batches) -> Batches:
        c = codec(*given.value)
        say = c.decimals.__getitem__
        for part in _parts(batches):
            ids = c.encode([x or "" for x in part.column(1).to_pylist()])
            said = [hashlib.sha256(" ".join(map(say, x.tolist())).encode()).hexdigest() for x in ids]
            back = [hashlib.sha256(c.decode(x)).hexdigest() for x in ids]
            columns = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kinds = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, _schema(docs, id_col, **kinds))
