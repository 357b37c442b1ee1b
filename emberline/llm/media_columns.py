"""Media columns: texts kept as FLAC streams, and streams decoded to PCM blocks with seekable sample offsets.

`encode_texts` turns each row's payload into a stream; `pcm_blocks` decodes streams, verifies every checksum and makes rows
of (stream, first sample, samples, PCM bytes); `write_blocks` keeps them as a table and `seek` takes a range of samples out of
it by the offsets, so no other block is read; `digest` puts the blocks of each stream together again and reports. The query
is the chain of all: texts, streams, table of blocks, digest. Each runs on its own partition only, with no shuffle; memory is
bounded by an Arrow batch, by the frames coded at once, by one stream's samples and, while writing, by a task's packed blocks.

`write_blocks` writes each task's blocks in order, as one group of rows a file, which no reader divides, so `digest` finds
the blocks of a stream one after the other. Blocks in another order, or of other files, are dealt out by stream and sorted first
(`ordered=False`).

Defined results: null and empty texts are 192 spaces; repeated rows give equal streams, each with its own blocks; an empty
table gives an empty result; other columns, whatever their names, are not carried; equal texts give equal values, so there
are no ties. A stream that fails a checksum fails the job in `digest`; in `pcm_blocks` it gives one row without samples
and with the reason in `error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac

PAD = 32
GROUP_BYTES = 2_000_000
#: What a stream that breaks the format raises.
BROKEN = (flac.FlacError, struct.error, IndexError, AttributeError)
STREAMS = "doc_id long, n_bytes long, media binary"
BLOCKS = (
    "stream long, doc_id long, n_bytes long, block int, first_sample long, n_samples long, samples long, channels int, bits int, rate int, pcm binary, "
    "media_bytes long, media_sha256 string, error string"
)
PER_BLOCK = 4096
#: More than any task's packed blocks: a file of the table has one group of rows.
ROW_GROUP_BYTES = 1 << 30
#: Streams of a task, in the low bits of a stream's number.
STREAM_BITS = 33
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, UTF-8 bytes with spaces appended up to a positive multiple of a frame)."""
    data = (text or "").encode("utf-8", "replace")
    return len(data), data + bytes([PAD]) * (-len(data) % flac.BLOCK if data else flac.BLOCK)


def _groups(sizes: list[int]) -> Iterator[slice]:
    """Consecutive rows of about GROUP_BYTES together; a larger row alone."""
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > GROUP_BYTES:
            yield slice(start, k)
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _groups(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                ids = batch.column(0)[rows.start : rows.stop]
                counts, data = zip(*(payload(t.as_py()) for t in batch.column(1)[rows.start : rows.stop]), strict=True)
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(flac.encode_many(list(data)), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STREAMS)


def features(samples: np.ndarray) -> str:
    """Level, crossings of the middle and the share of large steps, of unsigned 8-bit samples."""
    x = samples.astype(np.int64) - 128
    rms = float(np.sqrt((x * x).mean()))
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={len(x)};mean={x.mean():.3f};rms={rms:.3f};min={x.min()};max={x.max()};zc={crossings};steps={int((np.abs(np.diff(x)) > 32).sum())}"


def _pcm(streams: list[bytes]) -> list[tuple[flac.Info | None, bytes, str | None]]:
    """What each stream says of itself, its interleaved little-endian PCM, or why it can't be decoded. Streams of the
    encoder's own kind are decoded together; if one of them is broken, each by itself."""
    infos: list[flac.Info | str] = []
    for stream in streams:
        try:
            infos.append(flac.Info(stream))
        except BROKEN as e:
            infos.append(f"{e}")
    out: list = [(None, b"", i) if isinstance(i, str) else None for i in infos]
    own = [k for k, i in enumerate(infos) if not isinstance(i, str) and (getattr(i, "bits", 0), i.channels, i.block) == (8, 1, flac.BLOCK)]
    try:
        for k, data in zip(own, flac.decode_many([streams[k] for k in own]), strict=True):
            out[k] = (infos[k], (np.frombuffer(data, np.uint8) ^ 0x80).tobytes(), None)
    except BROKEN:
        pass
    for k, stream in enumerate(streams):
        if out[k] is None:
            try:
                info, samples = flac.decode(stream)
                out[k] = (info, samples.astype("<i8").view(np.uint8).reshape(*samples.shape, 8)[:, :, : (info.bits + 7) // 8].tobytes(), None)
            except BROKEN as e:
                out[k] = (None, b"", f"{e}")
    return out


def pcm_blocks(media: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """A row for each block of samples of each stream, of any FLAC kind, one after the other."""
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, BLOCKS.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << STREAM_BITS
        for batch in batches:
            for part in _groups(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()):
                ids, sizes, streams = (batch.column(c)[part.start : part.stop].to_pylist() for c in range(3))
                rows: list[tuple] = []
                for doc_id, n_bytes, stream, (info, pcm, error) in zip(ids, sizes, streams, _pcm([x or b"" for x in streams]), strict=True):
                    about = (len(stream or b""), hashlib.sha256(stream or b"").hexdigest())
                    number += 1
                    if info is None:
                        rows.append((number, doc_id, n_bytes, 0, 0, 0, 0, None, None, None, None, *about, error))
                        continue
                    width = info.channels * ((info.bits + 7) // 8)
                    total = len(pcm) // width
                    for k, at in enumerate(range(0, total, per_block)):
                        n = min(per_block, total - at)
                        rows.append((number, doc_id, n_bytes, k, at, n, total, info.channels, info.bits, info.rate, pcm[at * width : (at + n) * width], *about, None))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    known = F.col("n_bytes").cast("long") if "n_bytes" in media.columns else F.lit(None).cast("long")
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), known.alias("n_bytes"), "media").mapInArrow(run, BLOCKS)


def write_blocks(media: DataFrame, path: str, per_block: int = PER_BLOCK) -> DataFrame:
    """Write the blocks as a table, each task's in one group of rows, and read it back."""
    pcm_blocks(media, per_block).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return media.sparkSession.read.schema(BLOCKS).parquet(path)


def seek(blocks: DataFrame, first: int, count: int) -> DataFrame:
    """(doc_id, first_sample, n_samples, pcm): the samples [first, first + count) of each stream, a row for each block that
    has some of them. Other blocks are filtered out by their offsets, which the scan does where it can."""
    inside = blocks.filter((F.col("first_sample") < first + count) & (F.col("first_sample") + F.col("n_samples") > first) & F.col("error").isNull())
    low = F.greatest(F.lit(first) - F.col("first_sample"), F.lit(0))
    many = F.least(F.lit(first + count) - F.col("first_sample"), F.col("n_samples")) - low
    width = F.col("channels") * F.floor((F.col("bits") + 7) / 8)
    cut = F.substring(F.col("pcm"), (low * width + 1).cast("int"), (many * width).cast("int"))
    return inside.select("doc_id", (F.col("first_sample") + low).cast("long").alias("first_sample"), many.cast("long").alias("n_samples"), cut.alias("pcm"))


def digest(blocks: DataFrame, ordered: bool = True) -> DataFrame:
    """A row for each stream of mono 8-bit samples, from its blocks. ordered: they come as `pcm_blocks` or `write_blocks` gives
    them; else they are dealt out by stream and sorted. A block that is missing, or out of order, fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        reached, current = 0, None
        for batch in batches:
            rows: list[tuple] = []
            for stream, doc_id, n_bytes, first, n, total, pcm, size, sha, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if error or first != reached or reached and stream != current:
                    raise flac.FlacError(error or "a block does not begin where the one before it ends")
                current = stream
                held.append(pcm)
                reached += n
                if reached == total:
                    data = (np.frombuffer(b"".join(held), np.uint8) ^ 0x80).tobytes()
                    held, reached = [], 0
                    rows.append((doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), size, sha, features(np.frombuffer(data, np.uint8))))
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in DIGEST.split(", ")])
        if held:
            raise flac.FlacError("the last blocks of a stream are missing")

    rows = blocks if ordered else blocks.repartition("stream").sortWithinPartitions("stream", "first_sample")
    return rows.select("stream", "doc_id", "n_bytes", "first_sample", "n_samples", "samples", "pcm", "media_bytes", "media_sha256", "error").mapInArrow(run, DIGEST)
