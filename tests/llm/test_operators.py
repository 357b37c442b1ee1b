"""Each operator against a brute-force version on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emberline.llm import bpe, decontamination, flac, licenses, media_columns, packing, quality, sharding, simhash, token_counts, toxicity, url_filters
from tests.helpers import oracle_rows, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "sun rain wind stone river cloud meadow forest island harbour lantern copper violet ember quartz".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) * (rng.random() < 0.1) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows of every kind, with columns whose names operators use themselves."""
    texts = [None, "", "  ", "one", prose(1, 40), prose(1, 40), prose(2, 900), "ünï ßtraße 漢字\n\n x", "A" * 5000, prose(3, 12000), "tab\tand\r\nlines"]
    rows = [(k, t, "en", "s" if k % 3 else None, len(t or "")) for k, t in enumerate(texts)] + [(4, prose(1, 40), "en", "s", 0), (None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("shard", "slot", "_bucket", "length", "fp", "score", "host", "hash", "component"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 10863919174838991] + list(range(2, 300))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 16, 17, 600):
        got = {r["k"]: r["s"] for r in df.select("k", sharding.jump_hash(F.col("k"), shards).alias("s")).collect()}
        assert got == {k: jump(k, shards) for k in keys}
    # a value that other implementations publish for this key
    assert jump(10863919174838991, 11) == 6


def test_sharding(docs, no_docs):
    rows = sharding.shard_documents(docs, 5).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5) and r["shard"] == jump(r["doc_id"] or 0, 5)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    assert sharding.shard_documents(no_docs, 5).count() == 0


def test_tokens_by_chunks_are_those_of_the_whole_text(docs):
    model = bpe.ChunkEncoder(bpe.default_tokenizer())
    odd = ["a  b \n c", " lead", "trail ", "x <|endoftext|> y", "don't  we'll\t\tgo", "   x", "1 000,5 km", "a \x1c b"]
    for text in [*odd, *(r["text"] for r in docs.collect() if r["text"])]:
        assert np.frombuffer(model.encode(text), "<u4").tolist() == model.model.encode(text, add_special_tokens=False).ids
    assert model.encode(None) == model.encode("") == b""


def best_fit(histogram, size):
    rooms = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is None:
                rooms.append(size - n)
            else:
                rooms.remove(fit)
                rooms.append(fit - n)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.choice([7, 30, 64])
        histogram = {rng.randint(1, size): rng.randint(1, 25) for _ in range(rng.randint(1, 12))}
        held, seen = defaultdict(list), Counter()
        for length, first, last, sequence, each, offset in packing.plan(histogram, size):
            for rank in range(first, last + 1):
                k = rank - first
                held[sequence + k // each].append((offset + k % each * length, length))
                seen[length] += 1
        assert seen == histogram and len(held) == best_fit(histogram, size)
        for places in held.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= size


def test_packing(docs, no_docs):
    size = 64
    rows = packing.pack(docs, size).collect()
    model = bpe.ChunkEncoder(bpe.default_tokenizer())
    want = Counter()
    for r in docs.collect():
        ids = np.append(np.frombuffer(model.encode(r["text"]), "<u4"), np.uint32(0)).astype("<u4")
        first = len(ids) % size or size
        for k, (a, n) in enumerate([(0, first), *((s, size) for s in range(first, len(ids), size))]):
            want[(r["doc_id"], k, a, n, zlib.crc32(ids[a : a + n].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(held) == best_fit(Counter(r["length"] for r in rows), size)
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert packing.pack(no_docs).count() == 0


def test_flac_round_trips():
    rng = np.random.default_rng(0)
    payloads = [bytes(192), bytes(range(192)), rng.integers(0, 256, 192 * 150).astype(np.uint8).tobytes(), (prose(1, 3000) + " " * 192).encode()[: 192 * 20], b"\xff" * 384]
    for as_lpc in (False, True):
        streams = flac.encode_many(payloads, as_lpc)
        assert flac.decode_many(streams) == payloads
        assert [(flac.decode(s)[1][:, 0] + 128).astype(np.uint8).tobytes() for s in streams] == payloads
    tail = flac.read_at(streams[2], 192 * 150 - 20, 20)
    assert (tail[:, 0] + 128).astype(np.uint8).tobytes() == payloads[2][-20:]
    assert flac.decode_many([]) == []


@pytest.mark.parametrize("at", [-1, -40, 90])
def test_flac_checksums(at):
    stream = bytearray(flac.encode_many([prose(4, 600).encode()[: 192 * 10]])[0])
    stream[at] ^= 0x10
    with pytest.raises(flac.FlacError):
        flac.decode_many([bytes(stream)])


class Bits:
    def __init__(self):
        self.out = []

    def put(self, value, n):
        self.out += [(value >> (n - 1 - k)) & 1 for k in range(n)]
        return self

    def signed(self, value, n):
        return self.put(value & ((1 << n) - 1), n)

    def rice(self, value, k):
        u = value << 1 if value >= 0 else -value * 2 - 1
        self.out += [0] * (u >> k) + [1]
        return self.put(u & ((1 << k) - 1), k)

    def bytes(self):
        return np.packbits(np.array(self.out, np.uint8)).tobytes()


def scalar_crc(data, polynomial, bits):
    crc = 0
    for byte in data:
        crc ^= byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ polynomial if crc >> (bits - 1) & 1 else crc << 1) & ((1 << bits) - 1)
    return crc


def foreign_stream(channel_code, left, right):
    """A 16-bit stereo frame as another encoder may write it: LPC with shift, partitions with an escape, wasted bits, short block."""
    n = len(left)
    head = bytes([0xFF, 0xF8, 0x60, channel_code << 4 | 4 << 1, 0, n - 1])
    head += bytes([scalar_crc(head, 0x07, 8)])
    side = [a - b for a, b in zip(left, right, strict=True)]
    mid = [(a + b) >> 1 for a, b in zip(left, right, strict=True)]
    one, two = {8: (left, side), 9: (side, right), 10: (mid, side), 1: (left, right)}[channel_code]
    widths = {8: (16, 17), 9: (17, 16), 10: (16, 17), 1: (16, 16)}[channel_code]
    bits = Bits()
    # LPC of order 2, precision 6, shift 3, coefficients 12 and -4; two partitions, the second with raw residuals
    bits.put(0, 1).put(32 + 1, 6).put(0, 1)
    for x in one[:2]:
        bits.signed(x, widths[0])
    bits.put(5, 4).signed(3, 5).signed(12, 6).signed(-4, 6).put(0, 2).put(1, 4)
    residual = [one[i] - ((12 * one[i - 1] - 4 * one[i - 2]) >> 3) for i in range(2, n)]
    bits.put(4, 4)
    for r in residual[: n // 2 - 2]:
        bits.rice(r, 4)
    bits.put(15, 4).put(20, 5)
    for r in residual[n // 2 - 2 :]:
        bits.signed(r, 20)
    # fixed order 1 with the wider parameter
    bits.put(0, 1).put(8 + 1, 6).put(0, 1).signed(two[0], widths[1]).put(1, 2).put(0, 4).put(6, 5)
    for i in range(1, n):
        bits.rice(two[i] - two[i - 1], 6)
    body = head + bits.bytes()
    frame = body + scalar_crc(body, 0x8005, 16).to_bytes(2, "big")
    info = (n).to_bytes(2, "big") * 2 + bytes(6) + ((44100 << 44) | (1 << 41) | (15 << 36) | n).to_bytes(8, "big")
    pcm = b"".join(a.to_bytes(2, "little", signed=True) + b.to_bytes(2, "little", signed=True) for a, b in zip(left, right, strict=True))
    return b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + info + hashlib.md5(pcm).digest() + frame


@pytest.mark.parametrize("channel_code", [1, 8, 9, 10])
def test_flac_decodes_foreign_frames(channel_code):
    rng = random.Random(channel_code)
    left = [int(2000 * math.sin(k / 5)) + rng.randrange(-20, 20) for k in range(64)]
    right = [int(1500 * math.sin(k / 6)) + rng.randrange(-20, 20) for k in range(64)]
    info, samples = flac.decode(foreign_stream(channel_code, left, right))
    assert (info.channels, info.bits, info.rate) == (2, 16, 44100)
    assert samples[:, 0].tolist() == left and samples[:, 1].tolist() == right


def test_media_columns(spark, docs, no_docs, tmp_path):
    media = media_columns.encode_texts(docs)
    got = Counter(tuple(r)[:-1] for r in media_columns.digest(media_columns.pcm_blocks(media)).drop("media_bytes", "media_sha256").collect())
    want, payloads = Counter(), {}
    for r in docs.collect():
        data = (r["text"] or "").encode()
        padded = data + b" " * (-len(data) % 192 if data else 192)
        payloads[r["doc_id"]] = padded
        want[(r["doc_id"], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))] += 1
    assert got == want
    stored = {r["doc_id"]: (r["media_bytes"], r["media_sha256"]) for r in media_columns.digest(media_columns.pcm_blocks(media)).collect()}
    assert all(stored[r["doc_id"]] == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest()) for r in media.collect())
    blocks = media_columns.write_blocks(media.withColumn("pcm", F.lit("clash")), str(tmp_path / "blocks"), 1000)
    one = blocks.filter("doc_id = 9").orderBy("first_sample").collect()
    assert [b["first_sample"] for b in one] == [1000 * k for k in range(len(one))] and b"".join(b["pcm"] for b in one) == bytes(x ^ 0x80 for x in payloads[9])
    for first, count in ((0, 5), (999, 2), (1500, 4000), (len(payloads[9]) - 3, 100)):
        cut = media_columns.seek(blocks, first, count).filter("doc_id = 9").orderBy("first_sample").collect()
        assert b"".join(c["pcm"] for c in cut) == bytes(x ^ 0x80 for x in payloads[9][first : first + count]) and cut[0]["first_sample"] == first
    assert media_columns.digest(media_columns.pcm_blocks(media_columns.encode_texts(no_docs))).count() == 0
    # from the table: in its order, and dealt out anew after another order; in another order, and with a block missing, it fails
    whole = Counter(map(tuple, media_columns.digest(media_columns.pcm_blocks(media)).collect()))
    assert Counter(map(tuple, media_columns.digest(blocks).collect())) == whole
    mixed = blocks.repartition(5, "first_sample").sortWithinPartitions(F.desc("first_sample"))
    assert Counter(map(tuple, media_columns.digest(mixed, ordered=False).collect())) == whole
    for wrong, ordered in ((mixed, True), (blocks.filter("not (doc_id = 9 and block = 3)"), False)):
        with pytest.raises(Exception, match="does not begin|missing"):
            media_columns.digest(wrong, ordered).collect()


def test_broken_and_foreign_streams(spark):
    whole = flac.encode_many([prose(4, 600).encode()[: 192 * 10]])[0]
    left = [int(900 * math.sin(k / 5)) for k in range(64)]
    cut, flipped = whole[:-7], whole[:-40] + bytes([whole[-40] ^ 16]) + whole[-39:]
    streams = [(1, whole), (2, b"nonsense"), (3, None), (4, cut), (5, flipped), (6, foreign_stream(10, left, left[::-1])), (7, b"fLaC\x80\0\0\1\0")]
    rows = {r["doc_id"]: r for r in media_columns.pcm_blocks(spark.createDataFrame(streams, "doc_id long, media binary")).collect()}
    assert {k for k, r in rows.items() if r["error"]} == {2, 3, 4, 5, 7}
    assert rows[1]["n_samples"] == 1920 and rows[6]["pcm"] == b"".join(a.to_bytes(2, "little", signed=True) + b.to_bytes(2, "little", signed=True) for a, b in zip(left, left[::-1], strict=True))
    with pytest.raises(Exception, match="checksum|MD5|marker|missing|cut off"):
        media_columns.digest(media_columns.pcm_blocks(spark.createDataFrame([(5, flipped)], "doc_id long, media binary"))).collect()


def test_frames_of_all_predictors_are_written_and_read():
    """Slow waves take linear predictors, noise plain samples, steps fixed ones; what comes back is what went in."""
    rng = np.random.default_rng(2)
    t = np.arange(192 * 40)
    waves = [(128 + 100 * np.sin(t / p)).astype(np.uint8) for p in (1.1, 2.3, 5.0, 30.0)] + [rng.integers(0, 256, 192 * 9).astype(np.uint8), np.repeat(np.arange(16, dtype=np.uint8), 192), (t % 251).astype(np.uint8)]
    streams = flac.encode_many([w.tobytes() for w in waves])
    assert flac.decode_many(streams) == [w.tobytes() for w in waves]
    kinds = Counter()
    for stream in streams:
        info, buf = flac.Info(stream), np.frombuffer(stream, np.uint8)
        at = flac.find_frames(buf, np.array([info.first]), np.array([len(buf)]), np.array([info.samples // 192]))
        for a, n in zip(at, flac.headers(buf, at)["length"], strict=True):
            kind = int(buf[a + n]) >> 1
            kinds["linear" if kind >= 32 else "fixed" if kind >= 8 else "plain" if kind == 1 else "constant"] += 1
    assert set(kinds) == {"linear", "fixed", "plain", "constant"}


def reference_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(ids, prints):
    names = sorted(set(prints))
    parent = {p: p for p in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for i, p in zip(ids, prints, strict=True):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [least.get(find(p)) for p in prints]


def test_simhash(spark, docs, no_docs):
    rng = random.Random(8)
    near = []
    for k in range(60):
        words = prose(50 + k % 6, 400).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        near.append((100 + k, " ".join(words)))
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = simhash.near_duplicates(rows).collect()
    texts = rows.collect()
    want = components([r["doc_id"] for r in texts], [reference_fingerprint(r["text"]) for r in texts])
    expected = Counter((r["doc_id"], f"{reference_fingerprint(r['text']):016x}", c) for r, c in zip(texts, want, strict=True))
    assert Counter(tuple(r) for r in got) == expected
    assert simhash.near_duplicates(no_docs).count() == 0


def test_golay_keys_lose_no_pair():
    rng = np.random.default_rng(4)
    table = simhash.decoder()
    assert (np.bincount(table.astype(int) & 4095, minlength=4096) == 2048).all()
    x = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for bits in (1, 2, 3, 4):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[i] ^= np.uint64(1 << int(b))
        index, probe = defaultdict(set), defaultdict(set)
        for r, k in zip(*simhash.pair_keys(x, False), strict=True):
            index[r].add(k)
        for r, k in zip(*simhash.pair_keys(y, True), strict=True):
            probe[r].add(k)
        for i in range(len(x)):
            same = any(int(x[i]) >> s & ((1 << n) - 1) == int(y[i]) >> s & ((1 << n) - 1) for s, n in simhash.SEGMENTS)
            assert same or index[i] & probe[i]


def test_simhash_links_between_components(spark):
    """A chain whose ends are far apart, and fingerprints that share no whole segment."""
    base = 0x123456789ABCDEF0
    chain = [base]
    for k in range(6):
        chain.append(chain[-1] ^ (1 << (63 - k)) ^ (1 << (42 - k)) ^ (1 << (20 - k)))
    signed = [x - (1 << 64) if x >> 63 else x for x in chain] + [7]
    got = {r["fp"]: r["component"] for r in simhash.link_components(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {p: min(signed[:-1]) for p in signed[:-1]} | {7: 7}


PAGES = "page_id long, url string, html string, host string"


def test_url_filters(spark, tmp_path):
    link = lambda h: f'<p><a class="x" href="https://{h}/a?b">x</a> <a href=\'/rel\'>y</a></p>'
    rows = [
        (1, "http://Bad.net/x", link("spam.com")), (2, "http://spam.com/p", link("bad.net") * 3), (3, "https://ok.org/fr/1", link("good.com")), (4, "https://good.com/x#y", None), (5, "https://a.example.net/en/q?z", ""),
        (6, "https://a.example.net/de/q", ""), (7, "no scheme", link("ok.org")), (8, None, link("ok.org")), (9, "https://example.com/de/x", link("only-linked.com")), (9, "https://example.com/de/x", link("only-linked.com")),
        (10, "ftp://notexample.com/de/", ""), (11, "https://farm.com/z", link("bad.net") + link("spam.com")),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    pages.drop("host").write.parquet(str(tmp_path / "pages.parquet"))
    got = url_filters.judge(pages)
    expected, columns = oracle_rows(url_filters.oracle(), str(tmp_path))
    assert sorted(got.columns) == columns and rows_of(got) == expected
    by = {r["page_id"]: r for r in got.collect()}
    assert by[1]["host"] == "bad.net" and by[1]["rule"] == "net/" and by[1]["verdict"] == "block"
    assert by[5]["rule"] == "example.net/en/" and by[5]["verdict"] == "allow" and by[6]["verdict"] == "block"
    assert by[10]["rule"] is None and by[7]["host"] == by[8]["path"] == "" and by[7]["verdict"] == by[8]["verdict"] == "allow"
    assert by[2]["verdict"] == "block" and by[11]["verdict"] == "block" and by[4]["verdict"] == "allow"
    assert url_filters.judge(pages.limit(0)).count() == 0


def spread(seeds, edges, rounds=400, d=0.85):
    total = Counter()
    for (a, _), w in edges.items():
        total[a] += w
    score = {h: (1 - d) * s for h, s in seeds.items()}
    for _ in range(rounds):
        flow = Counter()
        for (a, b), w in edges.items():
            flow[b] += score[a] * w / total[a]
        score = {h: (1 - d) * s + d * flow[h] for h, s in seeds.items()}
    return score


def test_propagation_matches_a_loop(spark):
    rng = random.Random(6)
    hosts = [f"h{k}" for k in range(30)]
    seeds = {h: rng.random() if rng.random() < 0.3 else 0.0 for h in hosts}
    edges = {(a, b): rng.randint(1, 9) for a in hosts for b in rng.sample(hosts, 3) if a != b}
    got = url_filters.propagate(spark.createDataFrame(list(seeds.items()), "host string, seed double"), spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "source string, target string, weight long"))
    want = spread(seeds, edges)
    assert all(abs(r["score"] - want[r["host"]]) < 1e-7 for r in got.collect())


def test_propagation_goes_all_the_way_round_a_ring(spark):
    n = 24
    seeds = [(f"h{k}", 1.0 if k == 0 else 0.0) for k in range(n)]
    ring = [(f"h{k}", f"h{(k + 1) % n}", 1) for k in range(n)]
    frames = spark.createDataFrame(seeds, "host string, seed double"), spark.createDataFrame(ring, "source string, target string, weight long")
    got = {r["host"]: r["score"] for r in url_filters.propagate(*frames).collect()}
    assert all(abs(got[f"h{k}"] - 0.15 * 0.85**k / (1 - 0.85**n)) < 1e-7 for k in range(n))
    with pytest.raises(RuntimeError):
        url_filters.propagate(*frames, most_rounds=8)


def test_ties_of_trust_and_of_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", '<a href="http://good.org/fr/">'), (2, "http://b.com/", ""), (3, "http://x.y.com/p/q", "")], "page_id long, url string, html string")
    by = {r["page_id"]: r for r in url_filters.judge(pages, [("y.com", "/p/q", "block"), ("x.y.com", "/p/", "allow"), ("y.com", "/p", "block")]).collect()}
    assert by[3]["rule"] == "x.y.com/p/" and by[1]["trust"] == by[1]["distrust"] == 0 and by[1]["verdict"] == by[2]["verdict"] == "allow"
    equal = [("y.com", "/p/q", "block"), ("x.y.com", "/p", "allow"), ("com", "/p/q", "block")]
    assert url_filters.judge(pages, equal).filter("page_id = 3").first()["rule"] == "x.y.com/p"


ITEM = "Anna buys 12 kg of copper wire in Lisbon and sells 5 kg of copper wire in Lisbon before the long winter storm begins."


def test_decontamination(spark, tmp_path):
    changed = "Maria buys 30 lb of copper wire in Madrid and sells 7 lb of copper wire in Madrid before the long winter storm begins."
    uneven = "Maria buys 30 lb of copper wire in Madrid and sells 7 lb of copper wire in Paris before the rain"
    filler = prose(9, 300)
    rows = [
        (1, f"{filler} {ITEM} {filler}"), (2, f"{filler}. {changed} {filler}"), (3, uneven), (4, filler), (5, ITEM.upper()), (6, None), (7, ""), (8, "4 of 9 is"), (1, f"{filler} {ITEM} {filler}"), (9, prose(3, 8000) + " " + ITEM), (None, ITEM), (10, "! ".join(w.upper() for w in prose(2, 400).split())),
    ]
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, "seven little words make this whole question"), (6, "Zed Yan Wim Vic Uli Tom Sam Rob Quy Pia")], "item_id long, text string")
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, hash string").union(spark.createDataFrame([(11, "so: seven little words make this whole question?", "x")], "doc_id long, text string, hash string"))
    docs.distinct().write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    found = decontamination.leaks(docs, items)
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in found.collect()}
    assert got == {(1, 1): "verbatim", (2, 1): "reparameterised", (5, 1): "verbatim", (9, 1): "verbatim", (None, 1): "verbatim", (11, 5): "verbatim"}
    expected, columns = oracle_rows(decontamination.oracle(), str(tmp_path))
    assert sorted(found.columns) == columns and rows_of(found) == expected
    kept = decontamination.clean(docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7, 8, 10] and kept.columns == docs.columns
    assert decontamination.leaks(docs.limit(0), items).count() == 0 and decontamination.leaks(docs, items.limit(0)).count() == 0


def test_a_repeated_window_counts_once(spark, tmp_path):
    """Eight words of an item of forty, a dozen times over, are no leak; a whole item given twice is one leak."""
    item = " ".join(f"{a}{b}" for a in ("storm", "quiet", "north", "amber", "field") for b in ("fall", "ward", "light", "stone", "brook", "mark", "gate", "wood"))
    part, filler = " ".join(item.split()[8:16]), prose(77, 40)
    rows = [(1, f" {filler} ".join([part] * 12)), (2, part), (3, f"{item} {filler} {item}"), (4, " ".join(item.split()[4:26]) + f" {filler} " + " ".join(item.split()[4:26]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    found = decontamination.leaks(docs, items)
    assert {r["doc_id"]: (r["windows"], r["coverage"], r["kind"]) for r in found.collect()} == {3: (33, 1.0, "verbatim"), 4: (15, round(15 / 33, 4), "verbatim")}
    expected, _ = oracle_rows(decontamination.oracle(), str(tmp_path))
    assert rows_of(found) == expected
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, items).collect()) == [1, 2]


def test_items_of_a_few_tokens_are_a_kind_of_their_own(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Too short!"), (2, "this is too short to tell"), (3, "5 apples"), (4, "what is 2 plus 2"), (5, "So: what is 2 plus 2, then?")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "too short"), (2, "5 apples"), (3, "What is 2 plus 2?")], "item_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    found = decontamination.leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]): r["kind"] for r in found.collect()} == {(1, 1): "whole", (3, 2): "whole", (4, 3): "verbatim", (5, 3): "verbatim"}
    expected, _ = oracle_rows(decontamination.oracle(), str(tmp_path))
    assert rows_of(found) == expected


def test_rows_that_are_alike_are_numbered_in_many_tasks(spark):
    """Nine of ten rows have no doc_id, half of them the same text."""
    rows = spark.range(40_000).repartition(16).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    found = sharding.shard_documents(rows, 4)
    for r in found.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect():
        assert (r["n"], 0, r["n"] - 1) == (r["d"], r["a"], r["b"])
    held = sharding.stored(rows.select(F.lit(0).alias("g"), "doc_id", F.crc32(F.col("text")).alias("c")), "rows")
    buckets = held.withColumn("b", F.pmod(F.xxhash64(F.struct("doc_id", "c"), F.spark_partition_id()), F.lit(64)))
    assert buckets.groupBy("b").count().agg(F.max("count")).first()[0] < 0.3 * 40_000


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows, marks = [], []
    for k in range(240):
        words = prose(1000 + k, rng.randrange(5, 120)).split()
        toxic, poor = k % 4 == 0, k % 4 == 1
        if toxic:
            for _ in range(1 + len(words) // 30):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["grunk", "blarth", "zonkish"]))
        text = " ".join(w.upper() + "!!" for w in words[:10] * 4) if poor else " ".join(words).capitalize() + "."
        rows.append((k, text, "en", "s", len(text)))
        marks.append((k, 0 if poor else 1, 1 if toxic else 0))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, prose(5, 20000), "en", "s", 0), (None, "x", "en", "s", 1)]
    marks += [(5000, 1, 1), (3, 1, 0), (None, 1, 1), (900, None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label,folds,held,good", [(toxicity, "toxic", 5, 0, 1), (quality, "quality", 3, 1, 1)])
def test_classifiers(corpus, no_docs, module, label, folds, held, good):
    docs, marks = corpus
    rows = module.classify(docs.withColumn("score", F.lit("clash")), marks).collect()
    truth = {r["doc_id"]: r[label] for r in marks.collect() if r["doc_id"] is not None and r["doc_id"] < 240}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % folds == held) for r in rows)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in tested]) >= 0.95
    again = {r["doc_id"]: r["score"] for r in module.classify(docs.repartition(7), marks).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)
    assert module.classify(no_docs, marks).count() == 0
    assert module.classify(docs, marks.limit(0)).count() == docs.count()


def test_toxicity_does_not_use_labels_of_the_held_out_fold(corpus):
    docs, marks = corpus
    flipped = marks.withColumn("toxic", F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, marks).collect()}
    assert a == {r["doc_id"]: r["score"] for r in toxicity.classify(docs, flipped).collect()}


def cells_of(text):
    """The cells of a text by loops over its runs of letters, with a boundary on either side: n-grams that reach at most one of them."""
    mask = (1 << 32) - 1
    runs, run = [], ""
    for c in (text or "").lower() + "\n":
        if "a" <= c <= "z" or (ord(c) >= 0xC0 and c not in "×÷"):
            run += c
        elif run:
            runs.append([1, *map(ord, run), 1])
            run = ""
    out = set()
    for codes in runs:
        for n in toxicity.ORDERS:
            for at in range(len(codes) - n + 1):
                if codes[at] == codes[at + n - 1] == 1:
                    continue
                h = sum(c * int(m) for c, m in zip(codes[at : at + n], toxicity._MULTIPLIERS, strict=False)) & mask
                out.add(((h ^ h >> 15) * (0x2C1B3C6D + 2 * n) & mask) >> (32 - toxicity.HASH_BITS))
    return out - {0}


def test_toxicity_training_matches_brute_force(corpus):
    docs, marks = corpus
    cells, weights, bias = toxicity.train(docs, marks)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in marks.filter("doc_id < 240").collect()}
    rows = [(cells_of(texts[k]), y) for k, y in sorted(toxic.items()) if zlib.crc32(str(k).encode()) % 5]
    sizes = Counter(y for _, y in rows)
    count = {c: Counter(y for own, y in rows if c in own) for c in set().union(*(own for own, _ in rows))}
    ratio = {c: math.log((n[1] + 1) / (sizes[1] + 2)) - math.log((n[0] + 1) / (sizes[0] + 2)) for c, n in count.items()}
    z = {c: round(abs(ratio[c]) / math.sqrt(1 / (n[0] + 1) + 1 / (n[1] + 1)), 9) for c, n in count.items() if sum(n.values()) >= toxicity.LEAST_TEXTS}
    chosen = sorted(sorted((c for c in z if z[c] > 0), key=lambda c: (-z[c], c))[: toxicity.CELLS])
    x = np.array([[ratio[c] * (c in own) for c in chosen] for own, _ in rows])
    y = np.array([y for _, y in rows])
    balance = np.where(y == 1, len(y) / (2 * sizes[1]), len(y) / (2 * sizes[0])) / len(y)
    w, b, m, v = np.zeros(len(chosen)), 0.0, 0.0, 0.0
    for step in range(1, toxicity.STEPS + 1):
        error = balance * (1 / (1 + np.exp(-(x @ w + b))) - y)
        g = np.append(x.T @ error + toxicity.L2 * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    want = {c: k * ratio[c] for c, k in zip(chosen, w, strict=True) if abs(k * ratio[c]) > 1e-3}
    got = dict(zip(cells.tolist(), weights.tolist(), strict=True))
    assert all(abs(got.get(c, 0.0) - want.get(c, 0.0)) < 2e-3 for c in got.keys() | want.keys()) and abs(bias - b) < 1e-3
    # whole texts are scored by the sum over their different cells, one by one or many at once
    scorer = toxicity.Scorer((cells, weights, bias))
    some = [t for t in list(texts.values())[:40]] + ["GRUNK", prose(6, 9000), "×÷ß漢"]
    plain = [bias + sum(got.get(c, 0.0) for c in cells_of(t)) for t in some]
    assert np.allclose(scorer.margins(some), plain, atol=1e-3) and np.allclose([scorer.margins([t])[0] for t in some], plain, atol=1e-3)


def test_descent_does_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 12)).astype(np.uint16) for _ in range(60)]
    y, r = np.arange(60) % 2, rng.normal(size=50)
    whole = toxicity.descend(rows, y, r)
    monkeypatch.setattr(toxicity, "BLOCK_CELLS", 25)
    parts = toxicity.descend(rows, y, r)
    assert np.allclose(whole[0], parts[0]) and abs(whole[1] - parts[1]) < 1e-9


def test_quality_training_is_the_optimum_of_the_pair_loss():
    rng = np.random.default_rng(3)
    y = (rng.random(90) < 0.6).astype(int)
    x = rng.normal(size=(90, len(quality.FEATURES))) + y[:, None] * 0.4
    model = quality.fit(x, y, 0.7)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(quality.SEED)
    lucky, unlucky = draw.choice(good, len(poor) * quality.PAIRS_EACH), draw.choice(poor, len(good) * quality.PAIRS_EACH)
    pairs = [(g, unlucky[k * quality.PAIRS_EACH + j]) for k, g in enumerate(good) for j in range(quality.PAIRS_EACH)]
    pairs += [(lucky[k * quality.PAIRS_EACH + j], p) for k, p in enumerate(poor) for j in range(quality.PAIRS_EACH)]

    def loss(w):
        return np.mean([math.log1p(math.exp(-(z[a] - z[b]) @ w)) for a, b in pairs]) + quality.L2 / 2 * (w @ w)

    at = loss(model["w"])
    assert all(loss(model["w"] + d) > at for d in (s * e for e in np.eye(len(model["w"])) for s in (0.02, -0.02)))
    s = z @ model["w"]
    weight = np.where(y == 1, 0.7 / len(good), 0.3 / len(poor))
    below = weight[s < model["threshold"]].sum()
    assert below <= 0.3 + 1e-9 and below + weight.max() >= 0.3 - 1e-9
    assert np.array_equal(quality.apply(model, x) >= 0.5, s >= model["threshold"])


def test_quality_features_by_loops():
    text = "One two, two! THREE|3\n\nOne two ünï\nOne two ünï"
    got = dict(zip(quality.FEATURES, quality.features(text), strict=True))
    words = text.split()
    assert got["repeated_words"] == 1 - len(set(words)) / len(words) and got["top_word"] == 3 / len(words)
    assert got["repeated_lines"] == 1 - 2 / 3 and got["commas"] == 1 / len(words) and got["bars"] == got["exclamations"] == 1 / len(words)
    assert got["digits"] == 1 / len(text) and got["capitals"] == sum(c.isupper() for c in text) / sum(c.isalpha() for c in text)
    assert got["mixed_words"] == sum(not w.isalpha() for w in words) / len(words)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_repeated_rows_train_once(corpus, module):
    docs, marks = corpus
    many = docs.unionByName(docs.filter("doc_id < 50")).unionByName(docs.filter("doc_id = 4").withColumn("text", F.lit("zz later text")))
    again = marks.unionByName(marks.filter("doc_id < 20"))
    a = {(r["doc_id"], r["score"]) for r in module.classify(docs, marks).collect()}
    b = {(r["doc_id"], r["score"]) for r in module.classify(many, again).collect()}
    assert a <= b and {k for k, _ in b - a} <= {4}


