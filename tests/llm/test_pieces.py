"""Encoding with spans and decoding against the public library, character maps of its own rules included."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import pieces
from emberline.llm import queries as Q

PATH = public_tokenizers.path(pieces.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
LETTERS = [*" ▁abcde\n\t\x00ﬁÅ①漢𓀀é́ü", "  ", "▁▁", "the ", "<0x0A>", "</s>", "<unk>", "�", "​", "a" * 9, "¨", "　", "ＡＢ", "…", "½", "\xa0", "ﬃ", "가", "ำ", "ﷺ"]


def own(data=None):
    return pieces.PieceModel(data or open(PATH, "rb").read())


MODEL = own()


def spans(library, text):
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def encoded(model, text):
    return [tuple(map(int, row)) for row in zip(*model.encode(text), strict=True)]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(LETTERS), max_size=14).map("".join)))
def test_ids_spans_and_texts_are_the_librarys(text):
    assert encoded(MODEL, text) == spans(LIBRARY, text)
    ids = [k for k, _, _ in encoded(MODEL, text)]
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0, 1, 2, 259, 28705, 264]), st.integers(3, 258), st.integers(0, 31999)), max_size=9))
def test_any_ids_decode_as_in_the_library(ids):
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


def message(number, kind, value):
    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return varint(number << 3 | kind) + (varint(len(value)) + value if kind == 2 else varint(value))


def with_rules(rules):
    """The public model with another normaliser."""
    return b"".join(message(n, 2, v) for n, v in pieces.fields(open(PATH, "rb").read()) if n != 3) + message(3, 2, rules)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_maps_keep_the_alignment(rule, prefix, squeeze):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    rules = dict(pieces.fields(library.serialized_model_proto()))[3]
    data = with_rules(rules)
    model, whole = own(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(len(rule) + 2 * prefix + squeeze)
    for _ in range(400):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(9)))
        want, places = library.normalize(text, with_offsets=True)
        at = [0]
        for c in text:
            at.append(at[-1] + len(c.encode()))
        got, begins = model.normalise(text)
        assert (got, begins.tolist()) == (want, [at[p] for p in places])  # the library counts characters, the operator bytes
        assert encoded(model, text) == spans(whole, text)
        ids = [k for k, _, _ in encoded(model, text)]
        assert model.decode(ids) == whole.decode(ids)


def with_kinds(kinds, fallback=True):
    """The public model with other kinds for some pieces (user-defined 4, unused 5), or without byte pieces."""
    out = b""
    for n, v in pieces.fields(open(PATH, "rb").read()):
        if n == 1:
            parts = dict(pieces.fields(v))
            name = parts[1].decode()
            kind = kinds.get(name, parts.get(3, 1))
            if not fallback and kind == pieces.BYTE:
                kind, parts[1] = pieces.NORMAL, b"\xee\x80\x80" + parts[1]
            v = message(1, 2, parts[1]) + b"\x15" + parts.get(2, bytes(4)) + message(3, 0, kind)
        elif n == 2 and not fallback:
            v = v.replace(b"\x98\x02\x01", b"\x98\x02\x00")
        out += message(n, 2, v)
    return out


@pytest.mark.parametrize("kinds,fallback", [({"▁the": 5, "he": 5, "th": 5, "er": 5}, True), ({"ab": 4, "▁▁": 4, "the": 4}, True), ({}, False)])
def test_unused_user_defined_and_unknown_pieces(kinds, fallback):
    data = with_kinds(kinds, fallback)
    model, whole = own(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(9)
    words = ["the", "there", " ", "  ", "ab", "cab", "her", "漢", "字", "𓀀", "x", "other", "\n"]
    for _ in range(500):
        text = "".join(rng.choice(words) for _ in range(rng.randrange(9)))
        assert encoded(model, text) == spans(whole, text)


def test_both_ways_of_merging_agree():
    rng = random.Random(4)
    for n in (1, 2, 40, 63, 64, 65, 300):
        for _ in range(20):
            chunk = "".join(rng.choice("abcdeéstnr漢aaa") for _ in range(n))
            assert MODEL._scanned(list(chunk)) == [s for s, _ in MODEL._merged(list(chunk))]


def test_tables_of_odd_texts(spark):
    texts = [None, "", " ", "one", "one", "ünï ßtraße 漢字\n\n x", "A" * 70_000, "wörd 漢 " * 9000, "tab\tand\r\nlines  "]
    rows = [(k, t, "clash", "clash") for k, t in enumerate(texts)] + [(4, "again", "", ""), (None, "no id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    got = pieces.decode(pieces.encode(df))
    assert got.columns == ["doc_id", "ids", "begins", "ends", "decoded"]

    def row(doc_id, text):
        columns = [list(c) for c in zip(*spans(LIBRARY, text), strict=True)] or [[], [], []]
        return repr((doc_id, *columns, text))

    want = sorted(row(i, t or "") for i, t, *_ in rows)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert pieces.digest(pieces.decode(pieces.encode(df.limit(0)))).count() == 0
    for r in got.collect():
        data = (next(t for i, t, *_ in rows if i == r["doc_id"] and (t or "") == r["decoded"]) or "").encode()
        assert b"".join(data[b:e] for b, e in zip(r["begins"], r["ends"], strict=True)) == data


def test_digest_of_the_test_table(spark, small):
    for r in Q.op13_sentencepiece_spans(spark, small).join(Q.table(spark, small, "documents").select("doc_id", "text"), "doc_id").collect():
        ids = LIBRARY.encode(r["text"] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
        assert r["n_bytes"] == len((r["text"] or "").encode())
