"""Token counts as a rollup kept by deltas: additive totals by source, language and tokenizer version.

A change is a row (op, doc, source, lang, tokenizer, tokens, seq), op being insert, revise or delete and doc the key of a
document. A batch of changes is committed under an id:

1. If the id is committed already, nothing happens: a batch may be delivered any number of times.
2. The newest version of the store is read. For each (doc, tokenizer) that the batch names, and only for those, its state is
   looked up in the ledger. An insert or revision takes the old count away, if there is one, and adds the new one; a delete
   takes the old count away. Each is a signed row.
3. The signed rows are added up to a delta of totals; rows and delta are written under a name of the attempt's own.
4. The record of the next version, which names batch and attempt, is moved into place, which fails if that version exists:
   then another batch came first, its changes may touch the same documents, and step 2 starts again. A writer that dies
   before leaves files that nobody reads. (A distributed file system moves in one step; a local one looks first.)

Every COMPACT_EVERY versions a snapshot of ledger, totals and batch ids becomes a version of its own, so a reader opens
no more records and tables than that. Totals are the sum of the snapshot's and of the deltas since, a few rows each.
Deltas are partial sums, so a source with a third of all rows is no hot group; ledger joins are on the document.

`maintained_totals` keys documents by doc_id and text, so null and repeated doc_ids with different texts count each.

Defined results: null and empty texts count 0 tokens; a null source or language is a group of its own; a null key is a
key like any other; of several changes to one key in a batch the one with the highest `seq` counts, of equal ones that
with the largest op, tokens, source and lang in this order; deletes of unknown keys change nothing; repeated rows are the
same key once; an empty batch is committed with no delta; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import count_batches
from .common import shared_folder, stored

#: Tokenizers that SQL can express, by version: the pattern of a token.
PATTERNS = {"words-1": r"[^ \t\n\r\f]+", "pieces-1": r"\p{L}+|[0-9]+|[^ \t\n\r\f\p{L}0-9]"}
#: A later definition of `words-1`, by which every text that it counts otherwise is revised: numbers and marks alone are no words.
LETTERED = {"words-1": r"[^ \t\n\r\f]*\p{L}[^ \t\n\r\f]*"}
#: A public byte-level BPE vocabulary, by version.
VOCABULARIES = {"byte_bpe_50k": "byte_bpe_50k.json"}
CHANGE = "op string, doc string, source string, lang string, tokenizer string, tokens long, seq long"
LEDGER = "doc string, source string, lang string, tokenizer string, tokens long, docs long"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
COMPACT_EVERY = 32


def pattern_count(text: str, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(pattern)).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, digest, source, lang, text): doc names a document by its doc_id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("digest"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    return rows.withColumn("doc", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("digest")))


def count_patterns(rows: DataFrame, versions: dict[str, str] = PATTERNS) -> DataFrame:
    """(doc, source, lang, tokenizer, tokens) for each version, in one pass over the texts of `keyed` rows."""
    each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), pattern_count("text", pattern).alias("tokens")) for name, pattern in versions.items()])
    return rows.select("doc", "source", "lang", F.explode(each).alias("_t")).select("doc", "source", "lang", "_t.tokenizer", "_t.tokens")


def count_bpe(rows: DataFrame, versions: dict[str, str] = VOCABULARIES) -> DataFrame:
    """The same for public byte-level BPE vocabularies, in Arrow batches."""
    out = None
    for version, tokenizer in versions.items():
        counted = rows.select("doc", "source", "lang", "text").mapInArrow(count_batches(tokenizer, "text", "tokens"), "doc string, source string, lang string, tokens long")
        one = counted.select("doc", "source", "lang", F.lit(version).alias("tokenizer"), "tokens")
        out = one if out is None else out.unionByName(one)
    return out


def changes(counts: DataFrame, op: str, seq: int = 0) -> DataFrame:
    return counts.select(F.lit(op).alias("op"), "doc", "source", "lang", "tokenizer", F.col("tokens").cast("long").alias("tokens"), F.lit(seq).cast("long").alias("seq"))


@dataclass
class State:
    """A version of the store: the last snapshot and the (batch, attempt) pairs since."""

    version: int = 0
    snapshot: str | None = None
    attempts: list[tuple[str, str]] = field(default_factory=list)


class Rollup:
    """The store of one rollup, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, compact_every: int = COMPACT_EVERY):
        self.spark, self.compact_every = spark, compact_every
        self.folder = folder or f"{shared_folder(spark)}/emberline/rollup-{uuid.uuid4().hex}"
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self._hadoop.Path(self.folder)
        self._fs = path.getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.makeQualified(path).toUri(), conf)

    def _path(self, *parts: str):
        return self._fs.makeQualified(self._hadoop.Path("/".join([self.folder, *parts])))

    # --- versions

    def _record(self, version: int) -> dict:
        stream = self._fs.open(self._path("versions", f"{version:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self) -> State:
        """The newest version. Records are read back to the last snapshot only."""
        folder = self._path("versions")
        if not self._fs.exists(folder):
            return State()
        newest = max((int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)
        attempts = []
        for version in range(newest, 0, -1):
            record = self._record(version)
            if "snapshot" in record:
                return State(newest, record["snapshot"], attempts[::-1])
            attempts.append((record["batch"], record["attempt"]))
        return State(newest, None, attempts[::-1])

    def publish(self, version: int, record: dict) -> bool:
        """Make a record the given version, whole or not at all; false if there is such a version."""
        draft, place = self._path("drafts", uuid.uuid4().hex), self._path("versions", f"{version:012d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(record), "utf-8"))
        out.close()
        self._fs.mkdirs(place.getParent())
        kind = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self._context.rename(draft, place, options)  # fails where the target exists
        except Exception:
            if self._fs.exists(place):
                self._fs.delete(draft, False)
                return False
            raise
        return True

    def committed(self, batch: str, state: State | None = None) -> bool:
        state = state or self.state()
        if any(b == batch for b, _ in state.attempts):
            return True
        return bool(state.snapshot) and not self.spark.read.parquet(f"{self.folder}/snapshots/{state.snapshot}/batches").filter(F.col("batch") == batch).isEmpty()

    # --- tables

    def _read(self, kind: str, ddl: str, state: State) -> DataFrame:
        paths = [f"{self.folder}/attempts/{a}/{kind}" for _, a in state.attempts]
        if state.snapshot:
            paths.append(f"{self.folder}/snapshots/{state.snapshot}/{kind}")
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def ledger(self, state: State | None = None) -> DataFrame:
        """Signed rows since the last snapshot, and its live rows."""
        return self._read("ledger", LEDGER, state or self.state())

    def _signed(self, new: DataFrame, state: State) -> DataFrame:
        """What a batch adds to the ledger in a given state. new: (doc, tokenizer, op, new), a row for each key."""
        keys = new.select(F.col("doc").alias("_d"), F.col("tokenizer").alias("_t"))
        same = F.col("doc").eqNullSafe(F.col("_d")) & F.col("tokenizer").eqNullSafe(F.col("_t"))
        named = self.ledger(state).join(keys, same, "left_semi")
        held = named.groupBy("doc", "tokenizer", "source", "lang").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).filter("docs > 0")
        old = held.select(F.col("doc").alias("_d"), F.col("tokenizer").alias("_t"), F.struct("source", "lang", "tokens").alias("old"))
        joined = new.join(old, same, "left")
        row = lambda x, sign: F.struct(x["source"].alias("source"), x["lang"].alias("lang"), (x["tokens"] * sign).cast("long").alias("tokens"), F.lit(sign).cast("long").alias("docs"))
        minus, plus = F.when(F.col("old").isNotNull(), row(F.col("old"), -1)), F.when(F.col("op") != "delete", row(F.col("new"), 1))
        signed = joined.select("doc", "tokenizer", F.explode(F.filter(F.array(minus, plus), lambda x: x.isNotNull())).alias("_s"))
        return signed.select("doc", "_s.source", "_s.lang", "tokenizer", "_s.tokens", "_s.docs")

    def prepare(self, rows: DataFrame) -> DataFrame:
        """The change that counts for each key of a batch, written once for all tries."""
        last = F.max_by(F.struct("op", "source", "lang", "tokens"), F.struct("seq", "op", "tokens", "source", "lang"))
        new = rows.groupBy("doc", "tokenizer").agg(last.alias("_new"))
        return stored(new.select("doc", "tokenizer", "_new.op", F.struct("_new.source", "_new.lang", "_new.tokens").alias("new")), "changes")

    def attempt(self, new: DataFrame, state: State) -> str:
        """Write the signed rows and the delta of a prepared batch in a given state; nobody reads them before `publish`."""
        name = uuid.uuid4().hex
        path = f"{self.folder}/attempts/{name}"
        self._signed(new, state).write.parquet(f"{path}/ledger")
        written = self.spark.read.schema(LEDGER).parquet(f"{path}/ledger")
        written.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{path}/totals")
        return name

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Apply a batch of changes once; false if it was committed before."""
        if self.committed(batch):
            return False
        new = self.prepare(rows)
        while True:
            state = self.state()
            if self.committed(batch, state):
                return False
            if self.publish(state.version + 1, {"batch": batch, "attempt": self.attempt(new, state)}):
                if len(state.attempts) + 1 >= self.compact_every:
                    self.compact()
                return True

    def compact(self) -> bool:
        """Make a snapshot the next version; false if another batch came first, and nothing has changed then."""
        state, name = self.state(), uuid.uuid4().hex
        path = f"{self.folder}/snapshots/{name}"
        live = self.ledger(state).groupBy("doc", "source", "lang", "tokenizer").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).filter("docs > 0")
        live.select(*(c.split()[0] for c in LEDGER.split(", "))).write.parquet(f"{path}/ledger")
        self.totals(state).write.parquet(f"{path}/totals")
        batches = self.spark.createDataFrame([(b,) for b, _ in state.attempts], "batch string")  # COMPACT_EVERY rows
        if state.snapshot:
            batches = batches.unionByName(self.spark.read.parquet(f"{self.folder}/snapshots/{state.snapshot}/batches"))
        batches.write.parquet(f"{path}/batches")
        return self.publish(state.version + 1, {"snapshot": name})

    def totals(self, state: State | None = None) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens): groups with a live document."""
        summed = self._read("totals", DELTA, state or self.state()).groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.filter(F.col("docs") > 0)


def repeated(rows: DataFrame) -> DataFrame:
    """(doc): documents whose text a document with a smaller doc_id (null last) has too. Sums are partial."""
    order = F.struct(F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_id"))
    first = rows.groupBy("digest").agg(F.min_by("doc", order).alias("_first")).select("_first")
    return rows.select("doc").distinct().join(first, F.col("doc") == F.col("_first"), "left_anti")


def maintained_totals(docs: DataFrame, vocabularies: dict[str, str] = VOCABULARIES) -> DataFrame:
    """A rollup over all documents after five batches: counts by every tokenizer version are inserted, counts by `words-1` are
    revised wherever the later definition gives another count, documents that repeat an earlier text are deleted, and a batch comes twice."""
    store, rows = Rollup(docs.sparkSession), keyed(docs)
    inserted = changes(count_patterns(rows), "insert")
    store.commit("insert", inserted)
    if vocabularies:
        store.commit("insert-bpe", changes(count_bpe(rows, vocabularies), "insert"))
    differs = [pattern_count("text", PATTERNS[name]) != pattern_count("text", pattern) for name, pattern in LETTERED.items()]
    store.commit("revise", changes(count_patterns(rows.filter(F.exists(F.array(*differs), lambda x: x)), LETTERED), "revise"))
    gone = repeated(rows).withColumn("tokenizer", F.explode(F.array(*map(F.lit, [*PATTERNS, *vocabularies]))))
    none = F.lit(None).cast("string")
    store.commit("delete", changes(gone.select("doc", none.alias("source"), none.alias("lang"), "tokenizer", F.lit(0).alias("tokens")), "delete"))
    store.commit("insert", inserted)  # delivered again: no effect
    return store.totals()


def oracle() -> str:
    """The totals by patterns from the documents as they stand, in DuckDB SQL."""
    pieces, lettered = PATTERNS["pieces-1"], LETTERED["words-1"]
    n = lambda p: f"len(regexp_extract_all(text, '{p}'))"
    return f"""with d as (select doc_id, source, lang, coalesce(text, '') as text from documents),
        live as (select * from (select *, row_number() over (partition by text order by doc_id nulls last, source desc nulls last, lang desc nulls last) as r from d) where r = 1),
        c as (select source, lang, 'words-1' as tokenizer, {n(lettered)} as tokens from live
            union all select source, lang, 'pieces-1', {n(pieces)} from live)
        select source, lang, tokenizer, count(*) as docs, cast(sum(tokens) as bigint) as tokens from c group by source, lang, tokenizer"""
