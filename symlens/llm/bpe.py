"""Byte-level BPE by the tokenizers library, over Arrow batches.

The library works on characters, so each byte is shown as a printable character
(the usual byte table) and a rank file becomes a vocabulary and merges: every
way to cut a token into two tokens of lower rank is a merge of that token's rank.
The text is cut by the pattern first; a worker remembers the ids of the words it
has met, as most repeat, and gives only the others to the library's model.
Decoding maps the characters of each token back through the reversed byte table
and joins the bytes, so a character whose bytes are split over tokens comes back
whole. Offsets follow from the same table: each token's bytes give the
characters that they touch.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlens.llm.work import id_value, rows_of

#: Bytes of text handled at a time; bounds a worker's memory.
BATCH_BYTES = 1 << 20
#: Pieces, and words with what stands around them, that a worker remembers before the older half goes.
MEMO_PIECES = 200_000
#: The usual cut of byte-level BPE (fixed value), for which words between spaces can be encoded apart.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_table() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Merges in order of rank; of one token's cuts the one with lower parts first."""
    out = []
    for token, rank in ranks.items():
        cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
        cuts = [(a, b) for a, b in cuts if a in ranks and b in ranks]
        out += [(rank, ranks[a], ranks[b], a, b) for a, b in cuts]
    return [(a, b) for *_, a, b in sorted(out)]


def unicode_space(pattern: str) -> str:
    r"""``pattern`` for the regex library, with \s and \S read as Unicode's White_Space, as the rank files' own library does."""
    return re.sub(r"\\(.)", lambda m: {"s": r"\p{White_Space}", "S": r"\P{White_Space}"}.get(m[1], m[0]), pattern, flags=re.DOTALL)


class _Kept(dict):
    """Remembers what ``made`` gives, at most the last ``MEMO_PIECES`` twice; long keys aren't kept."""

    def __init__(self):
        super().__init__()
        self.last: dict = {}

    def __missing__(self, key: str):
        found = self.last[key] if key in self.last else self.made(key)
        if len(key) < 64:
            if len(self) >= MEMO_PIECES:
                self.last = dict(self)
                self.clear()
            self[key] = found
        return found


class _Memo(_Kept):
    """Piece to packed ids, by the library's model."""

    def __init__(self, model, shown: dict[int, str]):
        super().__init__()
        self.model, self.shown = model, shown

    def made(self, piece: str) -> bytes:
        return self.ids_of(piece)

    def ids_of(self, piece: str) -> bytes:
        return array("i", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]).tobytes()


class _Words(_Kept):
    """What stands between two single spaces, with the space before it, to packed ids.

    A piece holds a space only as its first character or among white space, so
    a text may be cut before each space between two other characters. None where
    a space has white space or an end of the text beside it. A word of letters
    alone is one piece.
    """

    def __init__(self, piece, text):
        super().__init__()
        self.piece, self.text = piece, text

    def made(self, word: str) -> bytes | None:
        if word.isalpha():
            return self.piece(" " + word)
        return None if not word or word[0].isspace() or word[-1].isspace() else self.text(" " + word)


class _Strings:
    """Byte strings in one array, to be joined in any order without a loop."""

    def __init__(self, strings: list[bytes]):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the strings ``at``, one after another, and where each ends."""
        size = self.size[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


class ByteBPE:
    """Encoder and decoder for one rank file; ``pattern`` cuts texts, the usual one where it is None."""

    def __init__(self, path: str, pattern: str | None = None):
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, table = read_ranks(path), byte_table()
        shown = {t: "".join(map(table.__getitem__, t)) for t in ranks}
        usual = pattern is None or pattern == USUAL
        self.tokenizer = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, [(shown[a], shown[b]) for a, b in merges_of(ranks)], ignore_merges=True))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=usual)
        if not usual:
            level = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), level])
        self.tokenizer.pre_tokenizer = level
        self.pieces = regex.compile(unicode_space(pattern or USUAL)).findall
        self.memo = _Memo(self.tokenizer.model, dict(enumerate(table)))
        self.words = _Words(self.memo.ids_of, self._packed) if usual else None
        back = {c: b for b, c in enumerate(table)}
        of = {rank: bytes(map(back.__getitem__, shown[t])) for t, rank in ranks.items()}
        n = max(of, default=-1) + 1
        self.tokens = _Strings([of.get(i, b"") for i in range(n)])
        self.decimals = _Strings([b"%d," % i for i in range(n)])

    def _packed(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def packed(self, text: str) -> bytes:
        """The ids of ``text``, four bytes each, without special tokens."""
        if self.words is None:
            return self._packed(text)
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return self._packed(text)
        found = list(map(self.words.__getitem__, rest))
        return self._packed(text) if None in found else self._packed(first) + b"".join(found)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, without special tokens."""
        return [np.frombuffer(self.packed(t), np.int32).tolist() for t in texts]

    def encode_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and character offsets [start, end) of each token; parts of one character share its offsets."""
        out = []
        for t in texts:
            ids = np.frombuffer(self.packed(t), np.int32)
            starts, ends = self.offsets(ids)
            out.append((ids.tolist(), list(zip(starts.tolist(), ends.tolist(), strict=True))))
        return out

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last."""
        data, ends = self.tokens.join(ids)
        char = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to each byte
        return (char[ends - self.tokens.size[ids]] - 1).astype(np.int32), char[ends - 1].astype(np.int32)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ``ids`` stand for; ValueError for an id that the vocabulary doesn't have, None among them."""
        if None in ids:
            raise ValueError("an id is null")
        at = np.asarray(ids, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= len(self.tokens.size) or not self.tokens.size[at].all()):
            raise ValueError("an id is outside the vocabulary")
        return self.tokens.join(at)[0].tobytes()

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str, np.ndarray]]:
        """For each text the number of its ids, the SHA-256 of their decimals and of the bytes they decode to, and the ids."""
        packed = list(map(self.packed, texts))
        cuts = np.cumsum([0, *map(len, packed)]) // 4
        ids = np.frombuffer(b"".join(packed), np.int32)
        (data, data_ends), (text, text_ends) = self.tokens.join(ids), self.decimals.join(ids)
        at_data, at_text = (np.concatenate([[0], e])[cuts].tolist() for e in (data_ends, text_ends))
        data, text = memoryview(data), memoryview(text)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for k in range(len(texts)):
            i, j = int(cuts[k]), int(cuts[k + 1])
            yield j - i, sha(text[at_text[k] : max(at_text[k], at_text[k + 1] - 1)]), sha(data[at_data[k] : at_data[k + 1]]), ids[i:j]


@cache
def codec(path: str, pattern: str | None = None) -> ByteBPE:
    """One codec a worker and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return ByteBPE(path, pattern)


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        body = t.as_py()
        held.append(body.decode("utf-8", "replace"))
        size += len(body)
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def bpe_digests(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode each whole text and decode it again.

    ``vocab`` is a rank file that every executor can read. A null text counts as
    empty: no tokens. Null ids stay null, repeated rows give repeated rows, an
    empty table none. Other columns are ignored, whatever their names. With
    ``ids`` a column of the token ids follows.
    """
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab, pattern)
        for b in batches:
            done = 0
            for group in _groups(b.column(1)):
                n, *columns, rows = zip(*c.digests(group), strict=True)
                arrays = [b.column(0).slice(done, len(group)), *map(pa.array, (n, *columns))]
                if ids:
                    cuts = pa.array(np.cumsum([0, *n]), pa.int32())
                    arrays.append(pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(rows))))
                done += len(group)
                yield pa.RecordBatch.from_arrays([x.cast(k) for x, k in zip(arrays, kinds, strict=False)], names[: len(arrays)])

    out = rows_of(docs, id_col, text_col).mapInArrow(run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else ""))
    return out.select(id_value(F.col("key")).alias("doc_id"), *names[1 : 5 if ids else 4])


def bpe_encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None, offsets: bool = True) -> DataFrame:
    """(doc_id, ids, starts, ends): token ids and character offsets, null with ``offsets`` off.

    A null text counts as empty: no ids. Null ids stay null, repeated rows give
    repeated rows, an empty table none. Other columns are ignored, whatever
    their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab, pattern)
        for b in batches:
            done = 0
            for group in _groups(b.column(1)):
                ids = [np.frombuffer(c.packed(t), np.int32) for t in group]
                places = list(zip(*map(c.offsets, ids), strict=True)) if offsets else [[None] * len(ids)] * 2
                columns = [pa.array(x, pa.list_(pa.int32())) for x in (ids, *places)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(ids)), *columns], ["key", "ids", "starts", "ends"])
                done += len(ids)

    out = rows_of(docs, id_col, text_col).mapInArrow(run, "key long, ids array<int>, starts array<int>, ends array<int>")
    return out.select(id_value(F.col("key")).alias("doc_id"), "ids", "starts", "ends")


def bpe_decode(tokens: DataFrame, vocab: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes, text): what ``ids`` stand for. ``text`` replaces bytes that aren't whole characters.

    An array that is null gives empty bytes; a null or negative id, or one that
    the vocabulary doesn't have, is an error. Null document ids stay null,
    repeated rows give repeated rows, an empty table none. Other columns are
    ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        for b in batches:
            got = [c.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary()), pa.array([g.decode("utf-8", "replace") for g in got], pa.string())], ["doc_id", "bytes", "text"])

    picked = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return picked.mapInArrow(run, "doc_id long, bytes binary, text string")
