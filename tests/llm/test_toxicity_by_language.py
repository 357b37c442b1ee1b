"""Held-out recall of the toxicity classifier in each language of the test tables."""

import os
from collections import Counter

import pytest

from emberline.llm import queries as Q

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table with enough labels here")
def test_toxic_texts_are_found_in_each_language(spark):
    labels = {r["doc_id"]: r["toxic"] for r in Q.table(spark, FOLDER, "labels").collect()}
    langs = {r["doc_id"]: r["lang"] for r in Q.table(spark, FOLDER, "documents").select("doc_id", "lang").collect()}
    seen, right, false_alarms, clean = Counter(), Counter(), 0, 0
    for r in Q.op7_toxicity_nb_ngrams(spark, FOLDER).filter("held_out").collect():
        toxic = labels.get(r["doc_id"])
        if toxic == 1:
            seen[langs[r["doc_id"]]] += 1
            right[langs[r["doc_id"]]] += r["predicted"]
        elif toxic == 0:
            clean += 1
            false_alarms += r["predicted"]
    assert sum(right.values()) >= 0.9 * sum(seen.values()) and false_alarms <= 0.01 * clean
    assert all(right[k] >= 0.85 * n for k, n in seen.items()), (right, seen)
