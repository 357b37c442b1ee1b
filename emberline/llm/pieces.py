"""SentencePiece encoding with spans, and decoding, of byte-pair models read from their files.

A model file holds pieces with scores and the rules of its normaliser: flags, and a compiled character map, which is a
double-array trie over UTF-8 keys with replacement texts behind it. `normalise` takes the longest key at each place and
records for every character that it writes where in the source it came from; spaces become the mark U+2581 there. Pieces
are found on the normalised text and projected through that record to byte spans of the source.

Where no piece has the mark after another character, no merge crosses the place before a mark that follows one, so a text
is encoded chunk by chunk (words with the marks before them) and chunks repeat: each worker keeps those it has seen, a
bounded number. `encode` and `decode` on tables work on a row's own text only, with no shuffle; memory is bounded by a
batch and one text's pieces.

Defined results: null and empty texts have no pieces and decode to an empty text; repeated rows give equal results; an
empty table gives an empty result; other columns, whatever their names, are not carried. Ties between merges of equal
score go to the leftmost pair.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CACHED_CHUNKS, CACHED_LENGTH = 250_000, 48
#: Characters of a chunk up to which all its pairs are looked through for each merge; beyond, a heap holds them.
SCANNED = 64
#: Pieces of the rows that a batch of results holds, if more than one row.
BATCH_PIECES = 400_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BYTE_PAIR = 2


class ModelError(ValueError):
    """A model file that breaks the format or is of a kind that is not supported."""


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            raise ModelError(f"field of kind {kind}")
        yield key >> 3, value


class CharacterMap:
    """A compiled character map: a trie of 32-bit units, then the replacement texts, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]
        self.starts = {c for c in range(256) if self._step(self._first(), c) is not None}

    def _first(self) -> int:
        return self._offset(self.units[0])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _step(self, at: int, byte: int) -> int | None:
        """The place of a node's child for a byte; a unit's label is its low byte, with the top bit clear."""
        place = at ^ byte
        if place < len(self.units) and self.units[place] & (1 << 31 | 255) == byte:
            return place
        return None

    def longest(self, data: bytes, at: int) -> tuple[str, int] | None:
        """(replacement, bytes of the key) for the longest key that stands at a place."""
        found, node = None, self._first()
        for k in range(at, len(data)):
            place = self._step(node, data[k])
            if place is None:
                break
            unit = self.units[place]
            node = place ^ self._offset(unit)
            if unit >> 8 & 1:
                found = self.units[node] & ~(1 << 31), k + 1 - at
        if found is None:
            return None
        begin = found[0]
        return self.texts[begin : self.texts.index(b"\0", begin)].decode(), found[1]


def _widths(text: str) -> np.ndarray:
    """UTF-8 bytes of each character."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int64)


def _packed(ids: list[int], widths: list[int]) -> bytes:
    """Pairs of an id and how many characters it covers (0 for all but the last byte of a character), as 32-bit numbers."""
    return array("i", [v for pair in zip(ids, widths, strict=True) for v in pair]).tobytes()


class Symbols(dict):
    """Maps a symbol to its packed id, or to those of its bytes where it is an unknown character."""

    def __init__(self, ids: dict[str, int], unknown: int, bytes_of: dict[int, int] | None):
        super().__init__((s, _packed([k], [len(s)])) for s, k in ids.items())
        self.unknown, self.bytes_of = unknown, bytes_of

    def __missing__(self, symbol: str) -> bytes:
        if self.bytes_of is None:
            return _packed([self.unknown], [len(symbol)])
        data = symbol.encode()
        return _packed([self.bytes_of[b] for b in data], [0] * (len(data) - 1) + [len(symbol)])


class PieceModel(dict):
    """A model; as a dictionary, the chunks that this process has encoded. When it is full its chunks are `older`, and those that come again stay."""

    def __init__(self, data: bytes):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, rules = {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        if trainer.get(3, 1) != BYTE_PAIR or trainer.get(24, 0):
            raise ModelError("only byte-pair models with the mark before words are supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.map = CharacterMap(rules[2]) if rules.get(2) else None
        self.prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.ids = {p: k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)) if kind in (NORMAL, USER, UNUSED)}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else -1
        self.bytes = {int(p[1:-1], 16): k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)) if kind == BYTE}
        own = sorted((p for p, k in self.ids.items() if self.kinds[k] == USER), key=len, reverse=True)
        self.user = re.compile("|".join(map(re.escape, own))) if own else None
        apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p, k in self.ids.items() if self.kinds[k] != USER) and MARK in self.ids
        self.parts = UNUSED in self.kinds
        self.plain = [p.replace(MARK, " ") if kind in (NORMAL, USER, UNUSED) else None for p, kind in zip(self.pieces, self.kinds, strict=True)]
        for byte, k in self.bytes.items():
            if byte < 0x80:
                self.plain[k] = chr(byte)
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if apart else r"[\s\S]+")

    @cached_property
    def symbols(self) -> Symbols:
        return Symbols(self.ids, self.unknown, self.bytes if self.byte_fallback else None)

    @cached_property
    def ranks(self) -> dict[str, int]:
        """Each piece's place by falling score; equal scores share one."""
        order = {v: r for r, v in enumerate(sorted({self.scores[k] for k in self.ids.values()}, reverse=True))}
        return {p: order[self.scores[k]] for p, k in self.ids.items()}

    # normalising

    def _units(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(normalised, first byte, bytes) from left to right: unchanged stretches have 0 bytes, replaced keys theirs.

        A user-defined piece stands for itself and is one unit.
        """
        if not self.map and not self.user:
            yield text, 0, 0
            return
        data = text.encode()
        high = bool(self.map) and any(b >= 0x80 for b in self.map.starts)
        at = byte = begun = begun_byte = 0
        while at < len(text):
            c, unit = text[at], None
            if own := self.user.match(text, at) if self.user else None:
                unit = own.group(), len(own.group().encode())
            elif self.map and (ord(c) in self.map.starts if c < "\x80" else high):
                unit = self.map.longest(data, byte)
            if unit is None:
                at, byte = at + 1, byte + len(c.encode())
                continue
            if begun < at:
                yield text[begun:at], begun_byte, 0
            yield unit[0], byte, unit[1]
            at, byte = at + len(data[byte : byte + unit[1]].decode()), byte + unit[1]
            begun, begun_byte = at, byte
        if begun < len(text):
            yield text[begun:], begun_byte, 0

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, source byte where each of its characters begins, and at last the end).

        All characters that one key's replacement writes begin where the key does.
        """
        space = MARK if self.escape else " "
        out: list[str] = []
        begins: list[np.ndarray] = []
        end, leading = 0, self.squeeze
        after_space, first = self.squeeze, 0
        for new, byte, n in self._units(text):
            if n:
                starts, end = np.full(len(new), byte, np.int64), byte + n
                if leading and new == " ":
                    first = end
                    continue
                leading = False
                if after_space:
                    new = new.lstrip(" ")
                    starts = starts[: len(new)]
            else:
                widths = _widths(new)
                starts = byte + np.cumsum(widths) - widths
                end = byte + int(widths.sum())
                if leading:
                    cut = len(new) - len(new.lstrip(" "))
                    first += cut
                    new, starts = new[cut:], starts[cut:]
                    leading = not new
                if self.squeeze:
                    spaces = np.array([c == " " for c in new], bool)
                    held = ~(spaces & np.concatenate([[after_space], spaces[:-1]])) if len(new) else spaces
                    new, starts = "".join(c for c, h in zip(new, held, strict=True) if h), starts[held]
            if new:
                after_space = self.squeeze and new.endswith(" ")
            out.append(new.replace(" ", space))
            begins.append(starts)
        if not text or leading:
            return "", np.zeros(1, np.int64)
        whole, places = "".join(out), np.concatenate([*begins, [end]])
        if self.prefix:
            whole, places = space + whole, np.concatenate([[first], places])
        if self.squeeze and whole.endswith(space):
            whole = whole.rstrip(space)
            places = places[: len(whole) + 1]
        return whole, places

    # encoding

    def _scanned(self, symbols: list[str]) -> list[str]:
        """Adjacent symbols joined by falling score, ties from the left."""
        rank, never = self.ranks.get, len(self.ranks)
        ranks = [rank(a + b, never) for a, b in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < never:
            k = ranks.index(best)
            joined = symbols[k] + symbols[k + 1]
            symbols[k : k + 2] = [joined]
            del ranks[k]
            if k:
                ranks[k - 1] = rank(symbols[k - 1] + joined, never)
            if k < len(ranks):
                ranks[k] = rank(joined + symbols[k + 1], never)
        return symbols

    def _merged(self, symbols: list[str]) -> list[tuple[str, tuple | None]]:
        """The same with a heap; (symbol, the two it was made of)."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made: list[tuple | None] = [None] * n
        queue: list[tuple[int, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n and (rank := self.ranks.get(joined := symbols[left] + symbols[right])) is not None:
                heapq.heappush(queue, (rank, left, right, joined))

        for k in range(n - 1):
            offer(k, k + 1)
        while queue:
            _, left, right, joined = heapq.heappop(queue)
            if not symbols[left] or after[left] != right or symbols[left] + symbols[right] != joined:
                continue
            made[left] = ((symbols[left], made[left]), (symbols[right], made[right]))
            symbols[left], symbols[right] = joined, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [(s, m) for s, m in zip(symbols, made, strict=True) if s]

    def _spread(self, symbol: str, made: tuple | None) -> bytes:
        """A symbol's ids; an unused piece falls back into its parts."""
        if made and self.kinds[self.ids[symbol]] == UNUSED:
            return b"".join(self._spread(*part) for part in made)
        return self.symbols[symbol]

    def __missing__(self, chunk: str) -> bytes:
        if (known := self.older.get(chunk)) is not None:
            out = known
        elif len(chunk) <= SCANNED and not self.parts:
            out = b"".join(map(self.symbols.__getitem__, self._scanned(list(chunk))))
        else:
            out = b"".join(self._spread(s, m) for s, m in self._merged(list(chunk)))
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= CACHED_CHUNKS:
                self.older = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def chunks(self, text: str) -> Iterator[bytes]:
        """The chunks of a normalised text; a user-defined piece stands for itself and nothing joins it."""
        at = 0
        for own in self.user.finditer(text) if self.user else ():
            yield from map(self.__getitem__, self.cut.findall(text, at, own.start()))
            yield _packed([self.ids[own.group()]], [len(own.group())])
            at = own.end()
        yield from map(self.__getitem__, self.cut.findall(text, at))

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first byte, byte after the last one) of a text's pieces, in bytes of the text."""
        whole, places = self.normalise(text or "")
        pairs = np.frombuffer(b"".join(self.chunks(whole)), np.int32).reshape(-1, 2)
        pieces, ends = pairs[:, 0], np.cumsum(pairs[:, 1], dtype=np.int64)
        if not self.byte_fallback and len(pieces):
            last = np.append((pieces[1:] != self.unknown) | (pieces[:-1] != self.unknown), True)  # a run of unknown characters is one piece
            pieces, ends = pieces[last], ends[last]
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return pieces, places[begins].astype(np.int32), places[ends].astype(np.int32)

    # decoding

    def decode(self, ids) -> str:
        """The text that a sequence of ids stands for; bytes that make no character become U+FFFD, each."""
        texts = [self.plain[k] for k in ids]
        if None not in texts and not self.squeeze:
            if texts and self.prefix and self.pieces[ids[0]].startswith(MARK):
                texts[0] = texts[0][1:]
            return "".join(texts)
        out: list[str] = []
        held = bytearray()
        empty = opening = True

        def flush() -> None:
            nonlocal held, empty
            at = 0
            while at < len(held):
                n = next((n for n in (1, 2, 3, 4) if _character(held[at : at + n])), 0)
                out.append(held[at : at + n].decode() if n else "�")
                at += n or 1
                empty = False
            held = bytearray()

        for k in ids:
            kind = self.kinds[k]
            if kind == BYTE:
                held.append(int(self.pieces[k][1:-1], 16))
                continue
            if held:
                flush()
            piece = "" if kind == CONTROL else self.unknown_text if kind == UNKNOWN else self.pieces[k]
            if kind not in (CONTROL, UNKNOWN):
                if empty and opening and (self.prefix or self.squeeze) and piece.startswith(MARK):
                    piece = piece[1:]
                    opening = self.squeeze  # one mark goes, or all that lead where extra spaces go
                piece = piece.replace(MARK, " ")
            if piece:
                empty = False
            out.append(piece)
        flush()
        return "".join(out)


def _character(data: bytearray) -> bool:
    """Whether bytes are one UTF-8 character."""
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


_models: dict[str, PieceModel] = {}


def model(name: str) -> PieceModel:
    """One model for each file and worker process; a bare name is one of the public vocabularies, looked up there."""
    if name not in _models:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _models[name] = PieceModel(Path(path).read_bytes())
    return _models[name]


ENCODED = StructType([StructField("doc_id", LongType()), *(StructField(c, ArrayType(IntegerType())) for c in ("ids", "begins", "ends"))])


def encode(docs: DataFrame, tokenizer: str = MODEL, id_column: str = "doc_id", text_column: str = "text", decoded: str | None = None) -> DataFrame:
    """(doc_id, ids, begins, ends): the pieces of each whole text and the bytes of it that each stands for.

    decoded: a column for the text that the ids stand for, as `decode` gives it, made in the same worker; with `decode` after it, a task
    has two workers with a model each, and all ids go from one to the other.
    """
    names, lists = ["doc_id", "ids", "begins", "ends"], pa.list_(pa.int32())

    def made(ids: list, rows: list[tuple], texts: list[str]) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32))
        columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[c] for r in rows]), pa.int32())) for c in range(3)]
        again = [pa.array(texts, pa.string())] if decoded else []
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(c.cast(lists) for c in columns), *again], [*names, decoded][: 4 + len(again)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(tokenizer)
        for batch in batches:
            ids, rows, texts, held = [], [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = pieces.encode(text.as_py())
                if rows and held + len(found[0]) > BATCH_PIECES:
                    yield made(ids, rows, texts)
                    ids, rows, texts, held = [], [], [], 0
                ids.append(doc_id.as_py())
                rows.append(found)
                if decoded:
                    texts.append(pieces.decode(found[0].tolist()))
                held += len(found[0])
            if rows:
                yield made(ids, rows, texts)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, StructType([*ENCODED, StructField(decoded, StringType())]) if decoded else ENCODED)


def decode(encoded: DataFrame, tokenizer: str = MODEL, ids_column: str = "ids", out: str = "decoded") -> DataFrame:
    """The input's columns with the text that each row's ids stand for; null ids count as none."""
    kept = [c for c in encoded.columns if c != out]
    at = kept.index(ids_column)
    schema = encoded.select(*kept).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(tokenizer)
        for batch in batches:
            texts = [pieces.decode(batch.column(at)[k].values.to_numpy(zero_copy_only=False).tolist() if batch.column(at)[k].is_valid else []) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, out])

    return encoded.select(*kept).mapInArrow(run, schema)


def digest(decoded: DataFrame) -> DataFrame:
    """Counts and checksums of each row's ids and decoded text; `n_bytes` is where the last piece's span ends."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("n_bytes"),
    )
