"""Operators that must read whole texts, not samples of them."""

import pytest

from emberline.llm import decontamination, quality


@pytest.mark.parametrize("other", [50, 2000])
def test_top_word_is_counted_over_all_words(other):
    words = [f"w{k}" for k in range(other)]
    words[1 : other : 3] = ["again"] * len(words[1 : other : 3])
    words[:: max(1, len(words) // 20)] = [f"s{k}" for k in range(len(words[:: max(1, len(words) // 20)]))]
    top = quality.features(" ".join(words))[quality.FEATURES.index("top_word")]
    assert top == words.count("again") / len(words) > 0.1


def test_items_made_of_numbers_are_found_verbatim(spark):
    sums, series = "Compute 12 + 34 * 5 - 6", "3, 7, 11, 15, 19, 23, 27, 31, what comes next?"
    items = spark.createDataFrame([(1, sums), (2, series)], "item_id long, text string")
    other = "so compute 12 + 34 * 5 - 7 and 3, 7, 11, 15, 19, 23, 27, 30, then stop here"
    docs = spark.createDataFrame([(1, f"some words. {sums}. and more"), (2, f"{series} more words"), (3, other), (4, "plain words without any number at all")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["windows"], r["coverage"], r["kind"]) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(1, 1): (1, 1.0, "verbatim"), (2, 2): (4, 1.0, "verbatim")}
    assert [r["doc_id"] for r in decontamination.clean(docs, items).orderBy("doc_id").collect()] == [3, 4]
