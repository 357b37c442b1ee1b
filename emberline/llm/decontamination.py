"""Benchmark decontamination by template windows, in built-in DataFrame functions only.

A text is cut into numbers and words. Its literal form has the lower-cased words, with `#` for a number and `~` for a unit
after a number; its template form also has `@` for every word with a capital, a name or the first word of a sentence.
All windows of WINDOW tokens of the items are searched, in a form if at least half of the window is not a placeholder
there; a window of which more is numbers and units is searched by its exact tokens, so that none is left out. An item
with fewer tokens than a window is one window. One with under LEAST tokens would be in most documents, so it leaks only as
a whole text, and such a leak is of its own kind, `whole`.

Documents' windows are first held against a Bloom filter of the items' hashes inside the row, so that only about a hundredth
leaves it, then joined by hash. The filter has BITS_EACH bits for a window, in MOST_BYTES at most as it is held in the
expression itself; beyond a million windows it gradually lets more through, and never loses one. For a document, an item and an alignment, the values that fill the item's slots are
paired with the document's: one value of the item must stand for one value of the document throughout. A document has
leaked an item if COVERAGE of the item's different windows occur in consistent alignments, however often each does; it is `verbatim` if all values
are equal, else `reparameterised`.

Item windows are broadcast up to BROADCAST_WINDOWS; beyond, both sides are shuffled by hash. Nothing groups by a key that
many documents share. `stride` may be raised to search fewer windows of long items; the default searches all.

Defined results: null and empty texts have no tokens and leak nothing; rows are judged by their texts, so rows with the
same doc_id (or none) and different texts are each judged and reported, and repeated rows give one result; repeated items
with other ids are each reported; of alignments with equal cover all count; an empty table on either side gives an empty
result; other columns, whatever their names, are not read by `leaks` and kept by `clean`.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 8
STRIDE = 1
LEAST = 4
COVERAGE = 0.3
BITS_EACH, LEAST_BYTES, MOST_BYTES = 24, 1 << 10, 1 << 20
BROADCAST_WINDOWS = 200_000
TOKEN = r"([0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+)([^\p{L}\p{M}0-9]*)"
#: Units that count as one after a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "inches", "feet", "yards", "miles", "meters", "metres", "mg", "g", "kg", "t", "oz", "lb", "lbs", "grams", "pounds", "tons",
    "ml", "cl", "l", "liters", "litres", "gallons", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "percent", "dollars", "euros", "cents", "degrees",
)


def _digit(word: Column) -> Column:
    return (word >= "0") & (word < ":")


def _capital(word: Column) -> Column:
    """Whether a word begins with a capital; most words are told by their first byte."""
    first = F.substring(word, 1, 1)
    return ((word >= "A") & (word < "[")) | ((word >= "\u0080") & (first != F.lower(first)))


def with_forms(rows: DataFrame, text: str) -> DataFrame:
    """Adds `n`, the number of tokens, and `forms`, for each: low (lower-cased), mark (# or ~ or null), slot (the same, or @
    for a capital), and lit and tpl, the hashes of its two forms.

    Lambdas see only elements of zipped arrays: an outer array in a lambda may be inlined by the optimiser, and is then
    computed anew for each element.
    """
    words = rows.withColumn("_words", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(1)))
    before = F.slice(F.concat(F.array(F.lit("")), F.col("_words")), F.lit(1), F.size("_words"))
    zipped = words.select(*rows.columns, F.arrays_zip(F.col("_words").alias("w"), before.alias("b")).alias("_zip"))

    def read(x: Column) -> Column:
        low = F.lower(x["w"])
        mark = F.when(_digit(x["w"]), "#").when(_digit(x["b"]) & low.isin(*UNITS), "~")
        return F.struct(low.alias("low"), mark.alias("mark"), _capital(x["w"]).alias("name"))

    def form(x: Column) -> Column:
        slot, key = F.coalesce(x["mark"], F.when(x["name"], "@")), F.xxhash64(F.coalesce(x["mark"], x["low"]))
        return F.struct(x["low"].alias("low"), slot.alias("slot"), x["mark"].alias("mark"), key.alias("lit"), F.when(slot == "@", F.xxhash64(F.lit("@"))).otherwise(key).alias("tpl"))

    return zipped.withColumn("forms", F.transform(F.transform("_zip", read), form)).drop("_zip").withColumn("n", F.size("forms"))


def _window(array: Column, at: Column, size: Column | int) -> Column:
    return F.slice(array, at + 1, size)


def item_windows(items: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(size, hash, exact, item_id, at, windows, slots, value): the searched windows of the items, in both forms or exact.

    A whole text of under LEAST tokens has their number below zero as its size.
    """
    formed = with_forms(items.select("item_id", F.col("text").cast("string").alias("text")), "text").drop("text").filter(F.col("n") > 0)
    size = F.least(F.col("n"), F.lit(WINDOW))
    last = F.col("n") - F.col("size")
    placed = formed.withColumn("size", size).withColumn("starts", F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))))
    placed = placed.withColumn("windows", F.size("starts")).withColumn("at", F.explode("starts")).withColumn("own", _window(F.col("forms"), F.col("at"), F.col("size")))
    slots = F.filter(F.transform("own", lambda x, p: F.when(x["slot"].isNotNull(), p)), lambda p: p.isNotNull())
    solid = lambda mark: F.size(F.filter("own", lambda x: x[mark].isNull())).alias("_solid")
    whole = F.col("n") < LEAST
    common = [F.when(whole, -F.col("size")).otherwise(F.col("size")).alias("size"), "item_id", "at", "windows", slots.alias("slots"), F.col("own.low").alias("value")]
    hashed = lambda form, mark: placed.select(*common, F.xxhash64(F.col(f"own.{form}")).alias("hash"), F.lit(form == "low").alias("exact"), solid(mark), whole.alias("_whole"))
    half = ~F.col("_whole") & (F.col("_solid") * 2 >= F.col("size"))
    forms = hashed("lit", "mark").unionByName(hashed("tpl", "slot")).filter(half).unionByName(hashed("low", "mark").filter(~half))
    return forms.drop("_solid", "_whole").distinct()


def _probes(h: Column, size: int) -> list[tuple[Column, Column]]:
    """(byte, bit) of the two bits of a hash in a table of `size` bytes with 7 bits each."""
    part = lambda shift, mask: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(mask).cast("long"))
    return [(part(0, size - 1), (part(24, 0xFFF) % 7).cast("int")), (part(36, size - 1), (part(12, 0xFFF) % 7).cast("int"))]


def _bits(windows: DataFrame, many: int) -> bytearray:
    """A Bloom filter of the item windows' hashes, with BITS_EACH bits for a window within bounds."""
    size = min(MOST_BYTES, max(LEAST_BYTES, 1 << (BITS_EACH * many // 7).bit_length()))
    shift = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), by)
    words = F.array(*(F.struct(F.shiftright(at, 3).alias("word"), shift((at % 8 * 8).cast("int") + bit).alias("bit")) for at, bit in _probes(F.col("hash"), size)))
    table = [0] * (size // 8)
    held = windows.select(F.explode(words).alias("w")).groupBy("w.word").agg(F.bit_or("w.bit").alias("bits"))
    for word, bits in held.collect():  # MOST_BYTES / 8 rows at most
        table[word] = bits
    return bytearray(struct.pack(f"<{len(table)}q", *table))


def document_windows(docs: DataFrame, sizes: list[int], bits: bytearray, exact: list[int] = ()) -> DataFrame:
    """(doc_id, digest, size, hash, at, value): the documents' windows whose bits item windows have, and whole texts of
    under LEAST tokens. exact: sizes of exact windows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    formed = with_forms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("digest"), text.alias("text")), "text")
    named = F.filter(F.transform("forms", lambda x, i: F.when(x["slot"] == "@", i)), lambda i: i.isNotNull())
    marked = F.filter(F.transform("forms", lambda x, i: F.when(x["mark"].isNotNull(), i)), lambda i: i.isNotNull())
    own = [F.col("forms.low").alias("low"), marked.alias("marked")] if exact else []
    hashed = formed.select("doc_id", "digest", "n", "forms", F.col("forms.lit").alias("lit"), F.col("forms.tpl").alias("tpl"), named.alias("named"), *own)
    held = F.lit(bits)

    def known(h: Column) -> Column:
        tests = [F.call_function("shiftright", F.ascii(F.substring(held, (at + 1).cast("int"), F.lit(1)).cast("string")), bit).bitwiseAND(F.lit(1)) == 1 for at, bit in _probes(h, len(bits))]
        return tests[0] & tests[1]

    def kept(form: str, size: int) -> Column:
        last = F.size(form) - size  # a second use of the array: one that is used once may be inlined into the lambda
        # a window without a name has the same hash in both forms; an exact one has a number
        around = F.array_distinct(F.flatten(F.transform("marked" if form == "low" else "named", lambda p: F.sequence(F.greatest(F.lit(0), F.least(p - (size - 1), last)), F.least(p, last)))))
        starts = F.when(last >= 0, F.sequence(F.lit(0), last) if form == "lit" else around).otherwise(F.array().cast("array<int>"))
        placed = F.filter(F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(_window(F.col(form), i, size)).alias("hash"))), lambda x: known(x["hash"]))
        return F.transform(placed, lambda x: F.struct(F.lit(size).alias("size"), x["hash"].alias("hash"), x["at"].alias("at"), _window(F.col("forms"), x["at"], size)["low"].alias("value")))

    low = F.col("forms.low")
    whole = F.when(F.col("n").between(1, LEAST - 1), F.array(F.struct((-F.col("n")).alias("size"), F.xxhash64(low).alias("hash"), F.lit(0).alias("at"), low.alias("value"))))
    parts = [kept(form, size) for size in sizes for form in ("lit", "tpl")] + [kept("low", size) for size in exact]
    parts.append(F.coalesce(whole, F.array().cast("array<struct<size:int,hash:bigint,at:int,value:array<string>>>")))
    return hashed.select("doc_id", "digest", F.explode(F.array_distinct(F.concat(*parts))).alias("w")).select("doc_id", "digest", "w.*")


def leaks_by_text(docs: DataFrame, items: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(doc_id, digest, item_id, windows, coverage, kind): the items that each document has leaked; digest: MD5 of its text."""
    index = stored(item_windows(items, stride), "items")
    many = index.count()
    sizes = sorted(r["size"] for r in index.filter("not exact").select("size").distinct().collect())  # WINDOW numbers at most
    exact = sorted(r["size"] for r in index.filter("exact and size > 0").select("size").distinct().collect())  # likewise
    found = document_windows(docs, sizes, _bits(index, many), exact)
    mine = index.select(F.col("size").alias("_size"), F.col("hash").alias("_hash"), "item_id", F.col("at").alias("item_at"), "windows", "slots", F.col("value").alias("item_value"))
    matched = found.join(F.broadcast(mine) if many <= BROADCAST_WINDOWS else mine, (F.col("hash") == F.col("_hash")) & (F.col("size") == F.col("_size")))
    pairs = F.transform("slots", lambda p: F.struct(F.get(F.col("item_value"), p).alias("item"), F.get(F.col("value"), p).alias("doc")))
    key = ["doc_id", "digest", "item_id"]
    aligned = (
        matched.select(*key, (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "windows", "size", pairs.alias("pairs"))
        .groupBy(*key, "shift")
        .agg(F.sort_array(F.collect_set("item_at")).alias("hits"), F.max("windows").alias("of"), F.max("size").alias("size"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    )
    # lists above are bounded by an item's length; below, alignments with the same windows are one list
    one_to_one = F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"]))) == F.size("pairs")
    equal = F.forall("pairs", lambda p: p["item"] == p["doc"])
    judged = aligned.filter(one_to_one).groupBy(*key).agg(F.size(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("windows"), F.max("of").alias("of"), F.max("size").alias("size"), F.min(equal.cast("int")).alias("same"))
    share = F.least(F.lit(1.0), F.col("windows") / F.col("of"))
    return judged.filter(share >= COVERAGE).select(
        *key, F.col("windows").cast("long").alias("windows"), F.round(share, 4).alias("coverage"), F.when(F.col("size") < 0, "whole").when(F.col("same") == 1, "verbatim").otherwise("reparameterised").alias("kind")
    )


def leaks(docs: DataFrame, items: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(doc_id, item_id, windows, coverage, kind): a row for each document, each different text of it, and each item."""
    return leaks_by_text(docs, items, stride).drop("digest")


def clean(docs: DataFrame, items: DataFrame, stride: int = STRIDE) -> DataFrame:
    """The rows of documents whose text has no leak, with all their columns."""
    # read back: its size is known then, and a small one is broadcast instead of shuffling the documents
    bad = stored(leaks_by_text(docs, items, stride).select("digest").distinct(), "leaked")
    return docs.join(bad, F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))) == bad["digest"], "left_anti")


def oracle() -> str:
    """The same rows in DuckDB SQL, joining windows as texts."""
    units = ", ".join(f"'{u}'" for u in UNITS)

    def forms(source: str, key: str) -> str:
        return f"""select {key}, p - 1 as p, lower(w) as low, case when w[1] between '0' and '9' then '#'
                when b between '0' and '9' and lower(w) in ({units}) then '~' else lower(w) end as lit,
                case when w[1] between '0' and '9' then '#' when b between '0' and '9' and lower(w) in ({units}) then '~'
                when w[1] <> lower(w[1]) then '@' else lower(w) end as tpl
            from (select {key}, p, ws[p] as w, ws[p - 1][1] as b from
                (select {key}, regexp_extract_all(text, '{TOKEN}', 1) as ws from {source} where text is not null), range(1, len(ws) + 1) r(p))"""

    def lists(name: str, key: str) -> str:
        return f"select {key}, list(low order by p) as low, list(lit order by p) as lit, list(tpl order by p) as tpl, count(*) as n from {name} group by {key}"

    def solid(x: str) -> str:
        return f"len(list_filter({x}, lambda y: y not in ('#', '@', '~'))) * 2 >= size"

    return f"""with it as materialized ({forms("benchmark", "item_id")}), il as materialized ({lists("it", "item_id")}),
        iw as (select *, least(n, {WINDOW}) as size from il),
        ia as (select *, unnest(range(0, n - size + 1)) as o, n - size + 1 as of from iw),
        ib as (select item_id, o, of, size, n, low[o + 1 : o + size] as v, lit[o + 1 : o + size] as lw, tpl[o + 1 : o + size] as tw from ia),
        ic as (select *, lw as key, 'form' as kind from ib where n >= {LEAST} and {solid("lw")} union all select *, tw, 'form' from ib where n >= {LEAST} and {solid("tw")}
            union all select *, v, 'exact' from ib where n >= {LEAST} and not ({solid("lw")}) union all select *, v, 'whole' from ib where n < {LEAST}),
        ix as materialized (select distinct item_id, o, of, size, v, tw, kind, array_to_string(key, ' ') as key from ic),
        dt as materialized ({forms("documents", "doc_id")}), dl as materialized ({lists("dt", "doc_id")}),
        dw as (select doc_id, n, s.size, unnest(range(0, n - s.size + 1)) as o, low, lit, tpl from dl, (select distinct size from ix) s where n >= s.size),
        dx as (select doc_id, n, size, o, low[o + 1 : o + size] as v, unnest([lit[o + 1 : o + size], tpl[o + 1 : o + size], low[o + 1 : o + size]]) as key, unnest(['form', 'form', 'exact']) as kind from dw
            union all select doc_id, n, size, o, low, low, 'whole' from dw where n = size),
        m as materialized (select distinct doc_id, item_id, dx.o - ix.o as shift, ix.o as o, of, ix.v as iv, dx.v as dv, tw, ix.kind as kind from dx join ix on ix.size = dx.size and ix.kind = dx.kind and ix.key = array_to_string(dx.key, ' ')),
        s as (select distinct doc_id, item_id, shift, iv[k] as i, dv[k] as d from m, range(1, len(tw) + 1) r(k) where tw[k] in ('#', '@', '~')),
        c as (select doc_id, item_id, shift, count(distinct i) = count(*) as ok, bool_and(i = d) as same from s group by all),
        j as (select m.doc_id, m.item_id, count(distinct o) as hits, max(of) as of, bool_and(coalesce(same, true)) as same, bool_and(kind = 'whole') as whole from m left join c using (doc_id, item_id, shift) where coalesce(ok, true) group by all)
        select doc_id, item_id, cast(hits as bigint) as windows, round(least(1.0, hits / of), 4) as coverage, case when whole then 'whole' when same then 'verbatim' else 'reparameterised' end as kind
        from j where least(1.0, hits / of) >= {COVERAGE}"""
