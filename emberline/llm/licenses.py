"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor folder.

Templates are one-line notices, paragraphs of file headers and whole licences. A text's units are its lines, its
paragraphs (lines between lines without a word, so comment marks don't matter) and the whole text. A unit is its
lower-cased words; its weight for a word is (1 + ln count) * idf, idf from how many templates have the word (smoothed; a
word in none has the highest). The licence of a file is that of its best unit with a cosine of at least THRESHOLD. A file
is a licence file, which speaks for its folder, if units of one kind that reach the threshold hold half of all its words
or more, or if its name says so (LICENSE, COPYING) and a unit reaches it.

Units are dropped inside the row, before anything is exploded, where no cosine of THRESHOLD is possible, by two bounds that
lose none. First: for each template some words (everyday and light ones) together stay below the threshold; of the others
a unit needs at least so many that the heaviest ones could make it up. Second: words that no template has only add
to a unit's norm. The cosine itself needs only the words that a unit and a template share, and the unit's norm.

Folders: a path's ancestors are the prefixes that end before a `/`. Each different folder looks for a licence file among
itself and its ancestors, nearest first, by joins on the path; a folder with several takes the one with the highest cosine, then the
smallest licence id. Files without a notice of their own take their folder's. Folders are made distinct before any join and
found by partial sums, so a folder with a third of all files is no hot group until the last join, which adaptive execution splits.

Templates are a parameter of fixed size, held in the expression itself.

Defined results: null and empty texts have no units; a null path has no folder and inherits nothing; ties take the smallest
licence id; repeated rows are judged each, and files that share a path share their notices; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .licence_texts import EVERYDAY, TEMPLATES

Templates = dict[str, tuple[str, ...]]
THRESHOLD = 0.7
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Between paragraphs: an end of line and one or more lines without a word.
GAP = r"\n(?:[^a-z0-9\n]*\n)+"
NAMED = r"(?i)(^|/)(un)?licen[cs]e([.-][^/]*)?$|(?i)(^|/)copying([.-][^/]*)?$"
WEIGHTS = "_word string, template int, licence string, weight double, template_norm double"


def weights(templates: Templates) -> tuple[list[tuple], float]:
    """(word, number of the template, licence, weight, idf, norm of the template) rows, and the idf of words that no template has."""
    listed = [(k, v) for k, texts in sorted(templates.items()) for v in texts]
    counts = [Counter(re.findall(WORD, v.lower())) for _, v in listed]
    frequency = Counter(w for c in counts for w in c)
    idf = lambda w: round(math.log((1 + len(counts)) / (1 + frequency[w])) + 1, 9)
    rows = []
    for t, (c, (licence, _)) in enumerate(zip(counts, listed, strict=True)):
        own = {w: round((1 + math.log(n)) * idf(w), 9) for w, n in sorted(c.items())}
        norm = round(math.sqrt(sum(x * x for x in own.values())), 9)
        rows += [(w, t, licence, x, idf(w), norm) for w, x in own.items()]
    return rows, idf("")


def needs(templates: Templates, threshold: float = THRESHOLD) -> list[tuple[list[str], int]]:
    """For each template (words, how many of them a unit needs at least for a cosine of the threshold)."""
    rows, _ = weights(templates)
    by: dict[int, list[tuple[float, str]]] = {}
    for word, t, _, weight, _, norm in rows:
        by.setdefault(t, []).append((weight / norm, word))
    most = (threshold - 1e-6) ** 2
    out = []
    for own in by.values():
        total, rest = 0.0, []
        for share, word in sorted(own):  # everyday words are left out up to half of it
            if word in EVERYDAY and total + share**2 < most / 2:
                total += share**2
            else:
                rest.append((share, word))
        reached, least = total, 0
        while reached < most:
            reached, least = reached + rest[-1 - least][0] ** 2, least + 1
        if least == 1:  # then light words are left out too, so that fewer words do
            while total + rest[0][0] ** 2 < most:
                total += rest.pop(0)[0] ** 2
        out.append((sorted(w for _, w in rest), least))
    return out


def _words(texts: list[str]) -> Column:
    return F.array(*map(F.lit, texts))


def _enough(words: Column, templates: Templates, threshold: float) -> Column:
    """The first bound, for an array of words."""
    need = needs(templates, threshold)
    several = [(own, least) for own, least in need if least > 1]
    single = sorted({w for own, least in need if least == 1 for w in own})
    return F.arrays_overlap(words, _words(single)) | F.exists(F.array(F.array_distinct(words)), lambda d: _any([F.size(F.array_intersect(d, _words(own))) >= least for own, least in several]))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _can_reach(own: Column, idf: Column, known: Column, other: float, threshold: float) -> Column:
    """The second bound: no cosine exceeds the share of the norm that known words have, and each different unknown word
    adds at least its idf squared to the norm."""
    held = F.array_intersect(own, known)
    part = F.aggregate(held, F.lit(0.0), lambda a, k: a + F.pow((F.lit(1.0) + F.log(F.size(F.filter(own, lambda x: x == k)).cast("double"))) * F.element_at(idf, k), F.lit(2.0)))
    unknown = F.size(F.array_except(own, known))
    return part + F.lit(1e-6) >= threshold**2 * (part + unknown * other**2)


def folder_of(path: Column) -> Column:
    """What stands before the last `/`; empty for a path without one."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).when(path.isNotNull(), "")


def units_of(text: Column) -> Column:
    """An array of (kind, text): lines, paragraphs of several lines, and the whole text if it has several paragraphs."""
    kind = lambda name: lambda x: F.struct(F.lit(name).alias("kind"), x.alias("text"))
    lines, paragraphs = F.split(text, "\n"), F.split(text, GAP)
    several = F.filter(paragraphs, lambda x: x.contains("\n"))
    whole = F.when(F.size(paragraphs) > 1, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(lines, kind("line")), F.transform(several, kind("paragraph")), F.transform(whole, kind("whole")))


def notices(files: DataFrame, templates: Templates = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, licence, cosine, is_file): files with a notice of their own. files: (path, text)."""
    rows, other = weights(templates)
    names = sorted({(r[0], r[4]) for r in rows})
    known, idf = _words([w for w, _ in names]), F.create_map(*(x for w, i in names for x in (F.lit(w), F.lit(i))))
    find = lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    read = files.filter(F.col("path").isNotNull()).select("path", text.alias("text"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("version")).withColumn("words", find(F.col("text")))
    # a text that fails the first bound has no unit that meets it
    likely = read.filter(_enough(F.col("words"), templates, threshold)).select("path", "version", F.size("words").cast("long").alias("total"), F.transform(units_of(F.col("text")), lambda u: F.struct(u["kind"].alias("kind"), find(u["text"]).alias("own"))).alias("units"))
    kept = F.filter("units", lambda u: _enough(u["own"], templates, threshold) & _can_reach(u["own"], idf, known, other, threshold))
    # a file that is there more than once is one file: its units would else be counted as often
    each = likely.select("path", "total", "version", F.posexplode(kept).alias("at", "unit")).dropDuplicates(["path", "version", "at"])
    key = ["path", "total", "version", "at", "kind"]
    listed = each.select("path", "total", "version", "at", "unit.kind", F.explode("unit.own").alias("word"))
    counted = stored(listed.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n")), "words")  # read twice below
    table = F.broadcast(files.sparkSession.createDataFrame([(w, t, k, x, n) for w, t, k, x, _, n in rows], WEIGHTS))  # the words of the templates
    idfs = F.broadcast(files.sparkSession.createDataFrame(names, "_known string, idf double"))
    weighed = counted.join(idfs, F.col("word") == F.col("_known"), "left").withColumn("w", (F.lit(1.0) + F.log(F.col("n").cast("double"))) * F.coalesce("idf", F.lit(other))).drop("idf", "_known")
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("n").alias("words"))
    dots = weighed.join(table, F.col("word") == F.col("_word")).groupBy(*key, "template", "licence", "template_norm").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 6)
    scored = dots.join(norms, key).withColumn("cosine", cosine).filter(F.col("cosine") >= threshold)
    order = F.struct((-F.col("cosine")).alias("c"), F.col("licence").alias("licence"))
    best = scored.groupBy(*key, "words").agg(F.min(order).alias("best"))
    by_kind = best.groupBy("path", "version", "kind").agg(F.min("best").alias("top"), (F.sum("words") * 2 >= F.max("total")).alias("is_file"))
    found = by_kind.groupBy("path").agg(F.min("top").alias("top"), F.max("is_file").alias("is_file"))
    return found.select("path", "top.licence", (-F.col("top.c")).alias("cosine"), (F.col("is_file") | F.col("path").rlike(NAMED)).alias("is_file"))


def scan(files: DataFrame, templates: Templates = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of `files` (doc_id, path, text) with its licence: (doc_id, path, licence, cosine, via, from_folder)."""
    found = stored(notices(files, templates, threshold), "notices")
    speaking = found.filter("is_file").groupBy(folder_of(F.col("path")).alias("_at")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("licence").alias("licence"))).alias("f"))
    speaking = speaking.select("_at", F.col("f.licence").alias("folder_licence"), (-F.col("f.c")).alias("folder_cosine"))
    folders = files.select(folder_of(F.col("path")).alias("folder")).filter(F.col("folder").isNotNull()).distinct()
    parts = F.split("folder", "/")
    ancestors = F.concat(F.array(F.lit("")), F.when(F.col("folder") != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>")))
    above = folders.select("folder", F.posexplode(ancestors).alias("depth", "ancestor"))
    nearest = above.join(speaking, F.col("ancestor") == F.col("_at")).groupBy("folder").agg(F.max_by(F.struct("ancestor", "folder_licence", "folder_cosine"), "depth").alias("near"))
    inherited = nearest.select(F.col("folder").alias("_folder"), F.col("near.ancestor").alias("ancestor"), F.col("near.folder_licence").alias("folder_licence"), F.col("near.folder_cosine").alias("folder_cosine"))
    # read back, so that the join below is dealt out anew on both sides and a folder with most files can be split
    inherited = stored(inherited, "inherited")
    own = found.select(F.col("path").alias("_path"), F.col("licence").alias("own"), F.col("cosine").alias("own_cosine"))
    joined = files.select("doc_id", "path").withColumn("folder", folder_of(F.col("path"))).join(own, F.col("path") == F.col("_path"), "left").join(inherited, F.col("folder") == F.col("_folder"), "left")
    has = F.col("own").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("own", "folder_licence").alias("licence"),
        F.coalesce("own_cosine", "folder_cosine").alias("cosine"),
        F.when(has, "own").when(F.col("folder_licence").isNotNull(), "inherited").alias("via"),
        F.when(~has, F.col("ancestor")).alias("from_folder"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/doc_id, without the parts that are null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat_ws("/", F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("string").alias("text"))


def oracle(templates: Templates = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows for documents as files, in DuckDB SQL: the cosine of every unit to every template, without bounds."""
    rows, other = weights(templates)
    values = ", ".join(f"('{w}', {t}, '{k}', {x!r}, {i!r}, {n!r})" for w, t, k, x, i, n in rows)
    folder = "case when contains({0}, '/') then regexp_extract({0}, '^(.*)/[^/]*$', 1, 's') else '' end"
    return f"""with w(word, template, licence, weight, idf, tn) as (values {values}), known as (select distinct word, idf from w),
        f as materialized (select doc_id, concat_ws('/', source, lang, cast(doc_id as varchar)) as path, coalesce(text, '') as text, row_number() over () as r from documents),
        low as materialized (select r, path, lower(text) as text, len(regexp_extract_all(lower(text), '{WORD}')) as total from f),
        un as (select r, path, total, 'line' as kind, unnest(string_split(text, chr(10))) as unit from low union all select r, path, total, 'whole', text from low where len(string_split_regex(text, '{GAP}')) > 1
            union all select r, path, total, 'paragraph', unit from (select r, path, total, unnest(string_split_regex(text, '{GAP}')) as unit from low) where contains(unit, chr(10))),
        u as materialized (select *, row_number() over () as n from un),
        t as (select n, unnest(regexp_extract_all(unit, '{WORD}')) as word from u), c as (select n, word, count(*) as k from t group by all),
        g as materialized (select n, c.word, k, (1 + ln(k)) * coalesce(idf, {other!r}) as x from c left join known using (word)),
        nm as (select n, sqrt(sum(x * x)) as norm, sum(k) as words from g group by n),
        d as (select n, template, licence, tn, sum(x * weight) as dot from g join w using (word) group by all),
        s as (select n, words, licence, round(dot / (norm * tn), 6) as cosine from d join nm using (n)),
        b as (select n, words, max(cosine) as cosine, min_by(licence, (-cosine, licence)) as licence from s where cosine >= {threshold!r} group by all),
        k as (select path, r, kind, max(cosine) as cosine, min_by(licence, (-cosine, licence)) as licence, sum(words) * 2 >= max(total) as is_file from b join u using (n) group by all),
        own as materialized (select path, max(cosine) as cosine, min_by(licence, (-cosine, licence)) as licence, bool_or(is_file) or regexp_matches(path, '{NAMED}') as is_file from k group by path),
        sp as (select {folder.format("path")} as folder, max(cosine) as cosine, min_by(licence, (-cosine, licence)) as licence from own where is_file group by 1),
        ff as (select distinct {folder.format("path")} as folder from f),
        an as (select folder, unnest(range(0, len(string_split(folder, '/')) + 1)) as depth from ff),
        nr as (select an.folder, max_by(sp.folder, depth) as ancestor, max_by(sp.licence, depth) as licence, max_by(sp.cosine, depth) as cosine
            from an join sp on sp.folder = array_to_string(string_split(an.folder, '/')[1:depth], '/') group by an.folder)
        select f.doc_id, f.path, coalesce(own.licence, nr.licence) as licence, coalesce(own.cosine, nr.cosine) as cosine,
            case when own.licence is not null then 'own' when nr.licence is not null then 'inherited' end as via, case when own.licence is null then nr.ancestor end as from_folder
        from f left join own on own.path = f.path left join nr on nr.folder = {folder.format("f.path")}"""
