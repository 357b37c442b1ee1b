"""Licence scans against loops over all units and templates."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from emberline.llm import licenses
from emberline.llm.licence_texts import EVERYDAY, TEMPLATES
from tests.helpers import oracle_rows, rows_of
from tests.llm.test_operators import DOCS, WORDS, docs, prose  # noqa: F401

ALL = [(k, re.findall(licenses.WORD, t.lower())) for k, texts in sorted(TEMPLATES.items()) for t in texts]
IDF = {w: math.log((1 + len(ALL)) / (1 + sum(w in t for _, t in ALL))) + 1 for w in {w for _, t in ALL for w in t}}
OTHER = math.log(1 + len(ALL)) + 1


def vector(words):
    return {w: (1 + math.log(n)) * IDF.get(w, OTHER) for w, n in Counter(words).items()}


def best(text):
    """(-cosine, licence) of the nearest template."""
    mine = vector(re.findall(licenses.WORD, text.lower()))
    norm = math.sqrt(sum(x * x for x in mine.values()))
    out = (0.0, "")
    for k, words in ALL:
        other = vector(words)
        dot = sum(x * other.get(w, 0.0) for w, x in mine.items())
        if norm:
            out = min(out, (-round(dot / norm / math.sqrt(sum(x * x for x in other.values())), 6), k))
    return out


def units(text):
    lines, paragraphs, held = text.split("\n"), [], []
    for line in [*lines, ""]:
        if re.search("[a-z0-9]", line.lower()):
            held.append(line)
        elif held:
            paragraphs.append("\n".join(held))
            held = []
    return lines + paragraphs + [text]


def notice(text):
    c, k = min((best(u) for u in units(text)), default=(0.0, ""))
    return (k, -c) if -c >= licenses.THRESHOLD else (None, None)


def comment(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


CASES = {
    "mit file": ("Copyright (c) 2020 Jo Doe\n\n" + TEMPLATES["MIT"][3], "MIT"),
    "mit title and body": ("MIT License\n\nCopyright 2011 X\n\n" + TEMPLATES["MIT"][3], "MIT"),
    "bsd-3 file": ("Copyright 2019, The Authors\nAll rights kept.\n\n" + TEMPLATES["BSD-3-Clause"][3], "BSD-3-Clause"),
    "apache header": ("# Copyright 2018 Some Firm\n#\n" + comment(TEMPLATES["Apache-2.0"][3] + "\n\n" + TEMPLATES["Apache-2.0"][4], "#") + "\n\nimport os\n", "Apache-2.0"),
    "gpl header": ("/*\n" + comment(TEMPLATES["GPL-3.0"][3], " *") + "\n */\nint main() {}\n", "GPL-3.0"),
    "gpl-2 header": ("// a tool\n//\n" + comment(TEMPLATES["GPL-2.0"][2], "//") + "\n\ncode\n", "GPL-2.0"),
    "spdx": ("// SPDX-License-Identifier: BSD-3-Clause\nint x;\n", "BSD-3-Clause"),
    "spdx mit": ("/* SPDX-License-Identifier: MIT */\nint x;\n", "MIT"),
    "line": (f"{prose(1, 60)}\n# Released under the MIT License.\n{prose(2, 60)}", "MIT"),
    "isc file": ("Copyright 2001 Y\n\n" + TEMPLATES["ISC"][1], "ISC"),
    "windows line ends": (TEMPLATES["MIT"][3].replace("\n", "\r\n"), "MIT"),
    "prose": (prose(3, 300), None),
    "talk of licences": ("we read the licence of the software with care and then went on to use the work in public", None),
}


def test_headers_and_licence_files_are_found(spark):
    rows = [(k, f"d{k}/x", text) for k, (text, _) in enumerate(CASES.values())]
    got = {r["doc_id"]: (r["licence"], r["cosine"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for k, (name, (text, want)) in enumerate(CASES.items()):
        assert got[k][0] == want == notice(text)[0], (name, got[k], notice(text))
        assert want is None or abs(got[k][1] - notice(text)[1]) < 2e-6


def test_the_bounds_lose_no_unit():
    rng = random.Random(3)
    need = licenses.needs(TEMPLATES)
    near = 0
    for _ in range(4000):
        _, words = rng.choice(ALL)
        own = [w for w in words if rng.random() < rng.choice([0.4, 0.7, 1.0])] + rng.choices([*WORDS, *EVERYDAY, *words], k=rng.randrange(6))
        if not own or -best(" ".join(own))[0] < licenses.THRESHOLD:
            continue
        near += 1
        assert any(len(set(own) & set(words)) >= least for words, least in need)
        part = sum(x * x for w, x in vector(own).items() if w in IDF)
        assert part + 1e-6 >= licenses.THRESHOLD**2 * (part + len(set(own) - set(IDF)) * OTHER**2)
    assert near > 500


def test_licences_inherit_from_the_nearest_folder(spark):
    mit, apache = TEMPLATES["MIT"][3], TEMPLATES["Apache-2.0"][2] + "\n\n" + prose(5, 300)
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/x.py", "code"), (3, "a/b/c/LICENSE.txt", apache), (4, "a/b/c/y.py", None), (5, "a/b/c/d/z.py", f"{prose(1, 60)}\n# Released under the MIT License.\n{prose(2, 60)}"), (6, "other/q", "text"), (7, None, mit),
        (8, "a/b/x2.py", ""), (8, "a/b/x2.py", ""), (9, "top", "text"), (10, "a/b/c/d/w.py", "code"), (11, "e/both", "All rights reserved.\nReleased under the MIT License."), (12, "e/f", "x"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    for name in ("licence", "cosine", "total", "words", "units", "version", "kind", "at", "_word", "n", "folder", "own", "_path"):
        files = files.withColumn(name, F.lit("clash"))
    got = {r["doc_id"]: (r["licence"], r["via"], r["from_folder"]) for r in licenses.scan(files).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "own", None), 4: ("Apache-2.0", "inherited", "a/b/c"), 5: ("MIT", "own", None), 6: (None, None, None), 7: (None, None, None), 8: ("MIT", "inherited", "a"), 9: (None, None, None),
        10: ("Apache-2.0", "inherited", "a/b/c"), 11: ("MIT", "own", None), 12: ("MIT", "inherited", "e"),
    }
    assert licenses.scan(files).count() == len(rows) and licenses.scan(files.limit(0)).count() == 0


def test_repeated_rows_are_one_file(spark, tmp_path):
    """A file with one licence paragraph among many others is no licence file, however often it is given."""
    paragraph = TEMPLATES["Apache-2.0"][5]
    text = "\n\n".join([*(prose(40 + k, 30) for k in range(45)), paragraph, *(prose(90 + k, 30) for k in range(45))])
    rows = [(1, "a/notes", text), (2, "a/other", "code")]
    for copies in (1, 2, 5):
        files = spark.createDataFrame(rows[:1] * copies + rows[1:], "doc_id long, path string, text string")
        got = {(r["doc_id"], r["licence"], r["cosine"], r["via"]) for r in licenses.scan(files).collect()}
        assert got == {(1, "Apache-2.0", -round(best(paragraph)[0], 6), "own"), (2, None, None, None)}, copies
        assert licenses.scan(files).count() == copies + 1
    # two texts under one path stay two versions of it, and the SQL says the same
    docs = [(1, text, "en", "s", 0)] * 3 + [(1, TEMPLATES["MIT"][3], "en", "s", 0), (2, "code", "en", "s", 0)]
    own = spark.createDataFrame(docs, DOCS)
    own.write.parquet(str(tmp_path / "documents.parquet"))
    expected, _ = oracle_rows(licenses.oracle(), str(tmp_path))
    assert rows_of(licenses.scan(licenses.document_files(own))) == expected


def test_licence_oracle(spark, docs, tmp_path):  # noqa: F811
    lines = [(50, "Released under the MIT License.", "en", "s", 1), (51, "text\nLICENSED under the apache license, version 2.0\nmore", "de", "s", 1), (52, "All rights reserved.\nAll rights reserved.", None, None, 1)]
    lines += [(100 + k, text, "en", f"t{k % 3}", 0) for k, (text, _) in enumerate(CASES.values())]
    own = docs.select(*[c.split()[0] for c in DOCS.split(", ")]).filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(lines, DOCS))
    own.write.parquet(str(tmp_path / "documents.parquet"))
    expected, _ = oracle_rows(licenses.oracle(), str(tmp_path))
    assert rows_of(licenses.scan(licenses.document_files(own))) == expected
