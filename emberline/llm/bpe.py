"""Token ids of a public byte-level BPE tokenizer, encoded chunk by chunk with a bounded cache.

The tokenizer's pre-tokenisation never joins a non-space character to a space after it, so a text may be cut before every
space that follows a non-space character: the ids of the chunks, joined, are the ids of the whole text. Chunks (mostly
words) repeat, so each worker keeps the ids of those it has seen.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa

CACHED_CHUNKS = 250_000
CACHED_LENGTH = 48
_SPACE_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


def default_tokenizer() -> str:
    """The name of the default vocabulary; workers look its path up, as it may differ from the driver's."""
    return "byte_bpe_50k.json"


class ChunkEncoder(dict):
    """Maps a chunk to its ids, as bytes of little-endian unsigned 32-bit numbers.

    A vocabulary is a file of the tokenizers library. If the same vocabulary lies beside it as ranks, chunks without a
    special token are encoded from those, which takes a tenth of the time and gives the same ids (tests compare them).
    """

    def __init__(self, tokenizer: str):
        super().__init__()
        if "/" not in tokenizer:
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.path, self._model, self.fast = tokenizer, None, None
        ranks = Path(tokenizer).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
            self.fast = tiktoken.Encoding(ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    @property
    def model(self):
        """The vocabulary in the tokenizers library, loaded when first needed."""
        if self._model is None:
            from tokenizers import Tokenizer

            self._model = Tokenizer.from_file(self.path)
        return self._model

    def __missing__(self, chunk: str) -> bytes:
        ids = self.fast(chunk) if self.fast and "<|" not in chunk else self.model.encode(chunk, add_special_tokens=False).ids
        packed = array("I", ids).tobytes()
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= CACHED_CHUNKS:
                self.clear()
            self[chunk] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; null counts as empty."""
        if not text:
            return b""
        parts = _CUT.split(text) if _SPACE_AFTER_SPACE.search(text) else text.split(" ")
        first = self[parts[0]] if parts[0] else b""
        return first + b"".join(map(self.__getitem__, [" " + p for p in parts[1:]]))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(tokenizer: str) -> ChunkEncoder:
    """One encoder for each vocabulary and worker process."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = ChunkEncoder(tokenizer)
    return _encoders[tokenizer]


def count_batches(tokenizer: str, text: str, out: str):
    """For mapInArrow: the input batches with a column of token counts added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            counts = pa.array([len(model.encode(t.as_py())) // 4 for t in batch.column(at)], pa.int64())
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), counts], [*(batch.schema.names[i] for i in keep), out])

    return run
