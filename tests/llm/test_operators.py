"""Each operator of the subpackage against brute force, and on odd tables."""

import base64
import hashlib
import itertools
import json
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillcheck.llm import bpe, license_scan, mixing, ppm, probminhash, simhash, toxicity, transport, url_filter, warc_fixity
from quillcheck.llm.common import flat
from quillcheck.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n int, key string, block int, label string, id string"
EN = "the cat sat on the mat and looked at the moon while it was quiet in the house of the old man "
DE = "der hund lief durch den wald und suchte nach dem ball den er gestern dort verloren hatte "


def rows():
    rng = random.Random(3)
    out = []
    for i in range(60):
        words = (EN if i % 2 else DE).split()
        text = " ".join(rng.choice(words) for _ in range(40))
        if i % 10 == 3:
            text += " you idiot scum"
        out.append([i, text, "en" if i % 2 else "de", f"src{i % 3}"])
    out += [[60, out[1][1], "en", "src0"], [61, None, None, None], [62, "", "en", None], [63, "12 34 !!", "en", "src1"], [None, "no id here at all", None, None], [64, "é" * 3, "de", "src2"], [65, "word " * 60_000, "en", "src0"]]
    out += [list(out[2]), list(out[2])]  # repeated rows
    return [(*r, len(r[1] or ""), 0.5, 1, "k", 2, "x", "y") for r in out]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(i % 10 == 3)) for i in range(50)] + [(3, 1, 0), (7, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    pages = [(1, "http://Www.Example.com/en/a?x#y", "<p>a</p>"), (2, "https://a.net/es/x", None), (3, None, "x"), (4, "no scheme", ""), (4, "no scheme", ""), (None, "http://b.com", "z"), (5, "http://example.com/en", "q")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def test_one_id_with_and_without_text(spark):
    docs = [(1, EN), (1, None), (2, EN), (3, "other words are here and not there"), (3, DE), (4, DE), (5, ""), (5, None), (None, EN)]
    got = {r["id"]: r["class_id"] for r in probminhash.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == 1 and got[5] == 5 and {*got} == {1, 2, 3, 4, 5} and got[3] in (3,) and got[4] in (3, 4)


def test_columns_are_not_overwritten(spark):
    for name, call in (("coded", lambda d: bpe.encode_documents(d, *bpe.tokenizer())), ("stored", transport.text_media), ("facts", transport.text_media)):
        with pytest.raises(ValueError):
            call(spark.createDataFrame([("x", 1)], f"text string, {name} int"))


EXPECTED = {"op1_warc_fixity": 7, "op8_url_filter": 7, "op6_near_duplicates": 66}


@pytest.mark.parametrize("name", QUERIES)
def test_odd_tables(spark, odd, name):
    assert QUERIES[name](spark, odd).count() == EXPECTED.get(name, len(rows()))


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_pipeline(spark, odd, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, odd)
        docs.write.parquet(f"{odd}/{name}")
        docs = spark.read.parquet(f"{odd}/{name}")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert {61, 62, 63}.isdisjoint(kept["language_id"]) and len(kept["language_id"]) == len(rows()) - 3
    assert [n for n, c in Counter(i for i in kept["near_dedup"] if i is not None).items() if c > 1] == []
    assert kept["near_dedup"].count(2) <= 1 and not {1, 60} <= {*kept["near_dedup"]}
    assert all(r["exact"] for r in docs.collect())


def test_bpe_is_tiktoken():
    import public_tokenizers
    import tiktoken

    path, pattern = bpe.tokenizer()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Bpe.load(path, pattern)
    rng = random.Random(1)
    bits = ["'s", "'ll", "'re", "''ve", " 'd", "don't", " ", "  ", "\n", "\t", "é", "ß", "中文", "🎉", "abc", "12", "==", "\x85", "\x1c", "<|endoftext|>", "'"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(600)] + [None, "", "a" * 3000, "=" * 700 + " " * 300]
    ids, ends = ours.encode(texts)
    assert all(ids[a:b].tolist() == theirs.encode_ordinary(t or "") for t, a, b in zip(texts, ends, ends[1:]))
    body, starts = ours.decode(ids, ends)
    assert all(body[a:b].tobytes() == (t or "").encode() for t, a, b in zip(texts, starts, starts[1:]))
    general = bpe.Bpe(ranks, pattern + "|never")  # through the regex library
    assert general.encode(texts)[0].tolist() == ids.tolist()


def test_transport_stream():
    rng = random.Random(2)
    for size in (0, 1, 161, 162, 163, 164, 184, 345, 346, 347, 18431, 18432, 18433, 50000):
        payload = rng.randbytes(size)
        media = transport.mux(payload)
        s = transport.demux(media)
        assert len(media) % 188 == 0 and s.payload[transport.DATA_PID] == payload
        assert (s.programs, s.discontinuities, s.bad_crc, s.lost_sync) == ({1: transport.PMT_PID}, 0, 0, 0)
        assert s.pts[transport.DATA_PID] == [k * transport.TICKS for k in range(-(-size // transport.UNIT))]
        assert len(s.random_access[transport.DATA_PID]) == len(s.pts[transport.DATA_PID])
    packets = transport.mux(rng.randbytes(5000)).reshape(-1, 188)
    assert transport.demux(np.delete(packets, 7, axis=0).reshape(-1)).discontinuities == 1
    assert transport.demux(np.insert(packets, 7, packets[7], axis=0).reshape(-1)).discontinuities == 0
    broken = packets.copy()
    broken[1, 20] ^= 1
    assert transport.demux(broken.reshape(-1)).bad_crc == 1


def test_damaged_streams():
    rng = random.Random(15)
    for _ in range(400):
        media = bytearray(transport.mux(rng.randbytes(rng.choice((0, 10, 600, 20000)))).tobytes())
        for _ in range(rng.randint(1, 6)):
            kind, at = rng.randrange(5), rng.randrange(len(media) + 1)
            packet = at // 188 * 188
            if kind == 0:
                media[at : at + 1] = rng.randbytes(1)
            elif kind == 1:
                media[packet + rng.randrange(20) : packet + 20] = rng.randbytes(3)
            elif kind == 2:
                del media[at:]
            elif kind == 3:
                del media[packet : packet + 188]
            else:
                media[at:at] = rng.randbytes(rng.randrange(5))
        transport.demux(bytes(media))
    packets = transport.mux(rng.randbytes(5000)).reshape(-1, 188)
    pointer = packets.copy()
    pointer[0, 4] = 255  # the pointer field leads out of the packet
    found = transport.demux(pointer.reshape(-1))
    assert found.programs == {} and found.faults == 1
    marked, long = packets.copy(), packets.copy()
    marked[5, 1] |= 0x80
    long[5, 3:5] = long[5, 3] | 0x20, 200
    for broken in (marked, long):
        found = transport.demux(broken.reshape(-1))
        assert found.faults >= 1 and found.discontinuities == 1
    jump = packets[np.r_[: len(packets) - 4, len(packets) - 2 : len(packets)]].copy()
    assert transport.demux(jump.reshape(-1)).discontinuities == 1
    body = b"".join(n.to_bytes(2, "big") + (0xE000 | 0x1000 + n).to_bytes(2, "big") for n in range(1, 60))
    section = transport._section(0, 1, body)
    first = (bytes([0x47, 0x40, 0, 0x10, 0]) + section[:183]).ljust(188, b"\xff")
    second = (bytes([0x47, 0, 0, 0x11]) + section[183:]).ljust(188, b"\xff")
    assert len(transport.demux(first + second).programs) == 59  # a table over two packets


def test_transport_query(spark, odd):
    got = {r["doc_id"]: r for r in QUERIES["op5_transport_stream"](spark, odd).where("doc_id is not null").collect()}
    for r in rows():
        if r[0] is not None:
            data = (r[1] or "").encode()
            payload = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
            g = got[r[0]]
            assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_url_trie():
    assert url_filter.split_url("x://AbÉ.com?p#q") == ("abÉ.com", "")
    rng = random.Random(4)
    many = [("allow", "a.com", f"/x/y{rng.randrange(10**9)}") for _ in range(20_000)]
    began = time.time()
    trie = url_filter.Trie(many)
    assert all(trie.match("a.com", p + "~")[0] in ("a.com" + p[:n] for n in range(len(p), 3, -1)) for _, _, p in many) and time.time() - began < 10
    deep = url_filter.Trie([("block", "a.com", "/" + "x" * n) for n in range(1, 3000)])
    assert deep.match("b.a.com", "/" + "x" * 5000)[0] == "a.com/" + "x" * 2999
    hosts, paths = ["com", "a.com", "b.a.com", "net", "xa.com"], ["/", "/en", "/en/", "/en/x", "/e"]
    for _ in range(60):
        rules = {(h, p): rng.choice(("allow", "block")) for h in hosts for p in paths if rng.random() < 0.3}
        trie = url_filter.Trie([(k, h, p) for (h, p), k in rules.items()])
        for host in (*hosts, "c.b.a.com", "org", ""):
            for path in ("", "/", "/e", "/en", "/en/", "/en/x", "/en/xy/z", "/english"):
                fit = [(h, p) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
                best = max(fit, key=lambda r: (len(r[0]), len(r[1])), default=None)
                assert trie.match(host, path) == (best and (best[0] + best[1], rules[best]))


def test_ppm_code_lengths():
    texts = [EN * 3, "aab", "a", ""]
    body, offsets = flat(pa.array(texts))
    codes = ppm.windows(body, offsets[:-1])
    grams, counts = np.unique(codes, return_counts=True)
    model = ppm.Model({"x": ppm.Tree.of(grams, counts)})
    seen = [Counter() for _ in range(ppm.ORDER + 1)]
    padded = [b"\0" * ppm.ORDER + t.encode() for t in texts]
    for t in padded:
        for i in range(ppm.ORDER, len(t)):
            for k in range(ppm.ORDER + 1):
                seen[k][t[i - k : i + 1]] += 1

    def bits(before, byte):
        out = 8.0
        for k in range(ppm.ORDER + 1):
            context = before[len(before) - k :]
            follow = {g: n for g, n in seen[k].items() if g[:-1] == context}
            if follow:
                total, distinct = sum(follow.values()), len(follow)
                n = follow.get(context + byte)
                out = np.log2((total + distinct) / n) if n else np.log2((total + distinct) / distinct) + out
        return out

    probe = "the dog aab zzq"
    body, offsets = flat(pa.array([probe]))
    t = b"\0" * ppm.ORDER + probe.encode()
    want = sum(bits(t[i - ppm.ORDER : i], t[i : i + 1]) for i in range(ppm.ORDER, len(t)))
    assert abs(model.lengths(body, offsets)[0, 0] / ppm.UNIT - want) < 0.01
    long = "the cat sat " * 100_000  # in blocks as in one
    body, offsets = flat(pa.array([long]))
    assert model.lengths(body, offsets)[0, 0] == model._sums(body, offsets[:-1], offsets)[0, 0]


def test_license_scan():
    sought = license_scan.notices()
    n, spans = license_scan.scan("Released under the MIT Licence, (mit  license). xmit license; Apache-License GNU general public license".encode(), sought)
    assert n == 15
    assert ("mit", "mit license", 5, 6, 0) in spans and ("apache", "apache license", 9, 10, 0) in spans
    assert ("mit", "released under the mit license", 0, 4, 1) in spans
    assert [s for s in spans if s[1] == "mit license"] == [("mit", "mit license", 5, 6, 0)]
    assert license_scan.scan(b"", sought) == (0, [])


def test_license_edits_at_the_ends():
    def least(words, phrase):
        """Fewest edits between the phrase and any run of words."""
        best = 99
        for i in range(len(words)):
            row = list(range(len(phrase) + 1))
            text = " ".join(words[i:])
            for n, c in enumerate(text, 1):
                new = [n]
                for k, p in enumerate(phrase, 1):
                    new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (c != p)))
                row = new
                if n == len(text) or text[n] == " ":
                    best = min(best, row[-1])
                if n > 2 * len(phrase):
                    break
        return best

    sought = license_scan.notices()
    names = lambda text: {s[1]: s[4] for s in license_scan.scan(text.encode(), sought)[1]}
    assert names("It is licensed under the Apache Licenses today")["licensed under the apache license"] == 1
    assert names("all rights reservedd")["all rights reserved"] == 1 and names("xall rights reserved")["all rights reserved"] == 1
    rng = random.Random(6)
    for _ in range(300):
        notice = rng.choice([x for x in sought if x.edits])
        text = list(notice.words)
        for _ in range(rng.randint(0, notice.edits + 1)):
            at = rng.choice((0, len(text), rng.randint(0, len(text)), rng.randint(0, len(text))))
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "s", " "])
        words = f"we say {''.join(text)} and go on".split()
        want = least(words, notice.words)
        assert names(" ".join(words)).get(notice.words, 99) == (want if want <= notice.edits else 99), (notice.words, words)


def test_probability_jaccard_and_sketches():
    def counted(t):
        w = t.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    def brute(a, b):
        return sum(1 / sum(max(a[z] / a[x], b[z] / b[x]) for z in {*a, *b}) for x in a if x in b)

    rng = random.Random(7)
    for _ in range(30):
        words = [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
        other = [w if rng.random() < 0.9 else "z" for w in words]
        a, b = " ".join(words), " ".join(other)
        sides = [probminhash.shingles(*flat(pa.array([t])))[:2] for t in (a, b)]
        assert abs(probminhash.probability_jaccard(*sides[0], *sides[1]) - brute(counted(a), counted(b))) < 1e-9
    base = [f"w{i}" for i in range(300)]
    agree = []
    for seed in range(20):
        edit = list(base)
        for k in random.Random(seed).sample(range(300), 6):
            edit[k] = "x"
        texts = [" ".join(f"{seed}{w}" for w in side) for side in (base, edit)]
        code, weight, owner, _ = probminhash.shingles(*flat(pa.array(texts)))
        kept = probminhash.registers(code, weight, owner, 2)
        agree.append((kept[0] == kept[1]).mean() - brute(counted(texts[0]), counted(texts[1])))
    assert abs(np.mean(agree)) < 0.03


def test_near_classes(spark, monkeypatch):
    rng = random.Random(9)
    docs, words = [], [f"w{i}" for i in range(3000)]
    for g in range(12):
        base = rng.choices(words, k=120)
        docs.append(base)
        for _ in range(8):
            copy = list(base)
            for k in rng.sample(range(120), rng.choice((0, 1, 2, 3))):
                copy[k] = rng.choice(words)
            docs.append(copy)
    texts = [" ".join(d) for d in docs]
    monkeypatch.setattr(probminhash, "CHUNK", 4)  # blocks of large buckets too
    got = {r["id"]: r["class_id"] for r in probminhash.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs]
    label = list(range(len(docs)))
    changed = True
    links = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    assert [got[i] for i in range(len(docs))] == label


def test_pairs_at_the_threshold(spark):
    pairs, below = [], []
    for m in range(1, 400):  # 4m of 5m shingles in common: the first text is the second's beginning
        words = [f"{m}w{i}" for i in range(5 * m + 4)]
        pairs.append((" ".join(words[: 4 * m + 4]), " ".join(words)))
        below.append((" ".join(words[: 4 * m + 3]), " ".join(words)))
    def kept(pairs):
        texts = spark.createDataFrame([(2 * k + s, t) for k, p in enumerate(pairs) for s, t in enumerate(p)], "id long, text string")
        found = probminhash.verified(spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(len(pairs))], "a long, b long"), texts, 0.8)
        return found.count()
    assert (kept(pairs), kept(below)) == (399, 0)
    for m in (3, 12, 13, 15, 20, 7):  # each shingle twice, and in a block
        x = np.sort(probminhash.mix64(np.arange(5 * m, dtype=np.uint64)))
        two = np.full(5 * m, 2)
        assert probminhash.probability_jaccard(x[: 4 * m], two[: 4 * m], x, two) >= 0.8 - probminhash.ROUNDING
        doubled = [" ".join([t, *(f"gap{m}x{s}{i}" for i in range(0)), t]) for s, t in enumerate(pairs[m - 1])]
        for texts in (pairs[m - 1], doubled):
            sides = [probminhash.shingles(*flat(pa.array([t])))[:2] for t in texts]
            want = probminhash.probability_jaccard(*sides[0], *sides[1]) >= 0.8 - probminhash.ROUNDING
            yes = np.ones(2, bool)
            got = probminhash.block_links(np.arange(2), np.arange(2), yes, yes, np.zeros((2, 1)), 0, pa.array(texts), 0.8)
            assert bool(got) == want


def test_simhash(spark, odd):
    texts = [EN * 50, "", None, "one", DE, EN * 50]
    whole = simhash.fingerprints(pa.array(texts))
    assert (whole[0] == whole[5]).all() and not whole[1].any() and not whole[2].any()
    limit = simhash.BLOCK_BYTES
    try:
        simhash.BLOCK_BYTES = 4 * 500  # a long text in pieces
        assert (simhash.fingerprints(pa.array(texts)) == whole).all()
    finally:
        simhash.BLOCK_BYTES = limit
    rng = random.Random(1)
    fps = [rng.getrandbits(128) for _ in range(40)]
    fps += [f ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)) for f in fps for _ in range(4)]
    frame = spark.createDataFrame([(f"{f:032x}", i % 3 == 0) for i, f in enumerate(fps)], "fp string, asks boolean")
    got = {r["fp"]: r["n"] for r in simhash.neighbours(frame, chunk=3).collect()}
    for i, f in enumerate(fps):
        if i % 3 == 0:
            assert got.get(f"{f:032x}", 0) == sum(1 for x in {*fps} if 0 < (x ^ f).bit_count() <= 3)


def test_simhash_matches(spark, tmp_path):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    bases = [" ".join(rng.choices(words, k=300)) for _ in range(12)]
    texts = [b if k == 0 else b.upper().replace(" ", ", ") if k == 1 else b + " tail" * (k // 2) for b in bases for k in range(5)] + [bases[0]] * 45
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    fps = [int(x.tobytes().hex(), 16) for x in simhash.fingerprints(pa.array(texts))]
    least = {}
    for i, f in enumerate(fps):
        least.setdefault(f, i)
    asking = {f for i, f in enumerate(fps) if i % simhash.ASK == 0}
    for r in simhash.op4_simhash(spark, str(tmp_path)).collect():
        i, f = r["doc_id"], fps[r["doc_id"]]
        near = sorted(((x ^ f).bit_count(), k) for x, k in least.items() if 0 < (x ^ f).bit_count() <= simhash.RADIUS)
        assert r["representative"] == least[f]
        assert r["n_near"] == (sum((x ^ f).bit_count() <= simhash.RADIUS for x in fps) - 1 if i % simhash.ASK == 0 else None)
        assert (r["near"] and [(p["distance"], p["representative"]) for p in json.loads(r["near"])]) == (near if i == least[f] and f in asking else None)
    assert fps.count(fps[0]) > 45 and any(0 < (x ^ fps[0]).bit_count() <= simhash.RADIUS for x in fps)


def test_simhash_recall(spark, tmp_path):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for k in range(150):  # a copy of 100 words with one replaced, and one of shingle likeness 0.8
        base = rng.choices(words, k=100 if k < 75 else 135)
        copy = list(base)
        for i in rng.sample(range(len(base)), 1 if k < 75 else 3):
            copy[i] = rng.choice(words)
        texts += [" ".join(base), " ".join(copy)]
    docs = [(20 * (i // 2) + i % 2, t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    near = {r["doc_id"]: r["n_near"] for r in simhash.op4_simhash(spark, str(tmp_path)).where(f"doc_id % {simhash.ASK} = 0").collect()}
    found = [near[20 * k] >= 1 for k in range(150)]
    assert sum(found[:75]) >= 0.97 * 75 and sum(found[75:]) >= 0.9 * 75


def test_with_next(spark):
    rng = random.Random(5)
    data = [(rng.randrange(1000), f"t{i}") for i in range(200)] + [(7, "a"), (7, "b"), (7, "b"), (None, "n")]
    got = sorted(tuple(r) for r in simhash.with_next(spark.createDataFrame(data, "k long, v string"), "k", "v", "x").where("k is not null").collect())
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted((k, v, order[(i + 1) % len(order)][1]) for i, (k, v) in enumerate(order) if k is not None)
    assert got == want


def test_toxicity():
    words = ("idiot moron stupid loser trash " * 40 + EN * 40 + DE * 20).encode()
    counts = toxicity.trigram_counts(np.frombuffer(words, np.uint8), np.array([0, len(words)]))
    costs = toxicity.letter_costs(counts)
    restorer = toxicity.Restorer(costs)
    for noisy, plain in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("m0r0n", "moron"), ("$tupid", "stupid"), ("l.o.s.e.r", "loser"), ("idiooot", "idiot"), ("tr4sh", "trash")):
        assert plain in restorer.words(f"the {noisy} is")[0], noisy
    assert restorer.words("the cat, (sat) on 12 mats!")[0] == {"the", "cat", "sat", "on", "mats"}


def _restorer(words):
    body = words.encode()
    return toxicity.Restorer(toxicity.letter_costs(toxicity.trigram_counts(np.frombuffer(body, np.uint8), np.array([0, len(body)]))))


def test_toxicity_lattice_against_all_paths():
    costs = _restorer("idiot moron stupid loser trash ass " * 40 + EN * 40).costs
    rng = random.Random(13)
    for _ in range(300):
        noisy = "".join(rng.choice("aos01$!.* -ée") for _ in range(rng.randint(0, 6)))
        letters, best = any(c.isalpha() for c in noisy), None
        may = [toxicity.options(noisy, i, letters, costs) or [(-1, "", 0.0)] for i in range(len(noisy))]
        for path in itertools.product(*may):
            a, b, total, out = 0, 0, 0.0, ""
            for k, c, extra in path:
                total += extra
                if k > 0 or k == 0 and b:
                    total, out, a, b = total + costs[a][b][k], out + c, b, k
            total += costs[a][b][0] if b else 0.0
            if best is None or total < best[0]:
                best = (total, out)
        got = toxicity.decode(noisy, costs)
        assert abs(got[0] - best[0]) < 1e-9, noisy
        assert restored_cost(got[1], noisy, may, costs) < best[0] + 1e-9


def restored_cost(text, noisy, may, costs):
    """The least cost of a path that puts out ``text``."""
    states = {(0, 0, 0): 0.0}  # characters put out, and the last two classes
    for own in may:
        new = {}
        for (n, a, b), cost in states.items():
            for k, c, extra in own:
                if k < 0 or k == 0 and not b:
                    key, total = (n, a, b), cost + extra
                elif text[n : n + 1] == c:
                    key, total = (n + 1, b, k), cost + extra + costs[a][b][k]
                else:
                    continue
                new[key] = min(total, new.get(key, 1e9))
        states = new
    return min(cost + (costs[a][b][0] if b else 0.0) for (n, a, b), cost in states.items() if n == len(text))


def test_toxicity_takes_long_tokens():
    restorer, rng = _restorer("idiot chapter moron " * 40 + EN * 40), random.Random(14)
    soup = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    cases = {"chapter" + "." * 1_000_000 + "12": "chapter", "i d i o t " * 30_000: None, soup("!@#$%^&*1234", 300_000): None, soup("abcdefgh0123+/", 200_000): None, "a" + "****a" * 50_000: None, "o" * 300_000: None, "1d10t" + "-" * 1_000_000: "idiot", "!?" * 500_000 + "moron": "moron"}
    for text, word in cases.items():
        began = time.time()
        found = restorer.words(text)[0]
        assert time.time() - began < 20 and (word is None or word in found), text[:20]


def test_toxicity_signs_and_doubles():
    words = ("idiot moron stupid loser trash ass cunt shit letter " * 40 + EN * 40 + DE * 20).encode()
    restorer = toxicity.Restorer(toxicity.letter_costs(toxicity.trigram_counts(np.frombuffer(words, np.uint8), np.array([0, len(words)]))))
    for noisy, plain in (("a$$", "ass"), ("@$$", "ass"), ("(unt", "cunt"), ("5#!7", "suit"), ("$7#p!d", "stupid"), ("stuupid", "stupid"), ("$$tupid", "stupid"), ("1d10t!!!", "idiot")):
        found = restorer.words(f"the {noisy} is")
        assert plain in found[0] and plain in found[1], noisy
    for written, plain in (("letter", {"letter"}), ("mat!", {"mat"}), ("(the", {"the"}), ("!!", set()), ("12", set()), ("2024", set()), ("***mat***", {"mat"}), ("door.", {"door"})):
        assert restorer.words(written) == (plain, set())


def test_mixing(spark, odd):
    docs = [(i, " ".join(["w"] * (1 + i % 9)), f"s{i % 4}" if i % 7 else None) for i in range(800)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame(docs)).collect()
    again = mixing.mix(frame(docs[::-1])).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    sizes, taken, target = Counter(), Counter(), {}
    source = {i: s for i, _, s in docs}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"] and len(r["shards"]) == len(r["positions"]) == r["copies"]
    # water filling by hand
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda x: (x is None, x or "")))}
    want, left, total = {}, {*sizes}, 1.5 * sum(sizes.values())
    while left:
        rest = total - sum(want.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
        full = {s for s in left if share[s] > 2 * sizes[s]}
        want |= {s: 2.0 * sizes[s] for s in full} if full else share
        left = left - full if full else set()
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 9
    loads = Counter(x for r in got for x in r["shards"])
    assert len(loads) == 2**mixing.LEVELS
    # the mix as it is written: by shard and, within it, by position; copies and neighbours are apart
    mixed = mixing.mix(frame(docs), keep=("doc_id", "text"))
    places = {r["row"]["doc_id"]: [*zip(r["shards"], r["positions"])] for r in mixed.collect()}
    order = [r["doc_id"] for r in mixing.shuffled(mixed).collect()]
    want = [i for _, i in sorted((at, i) for i, own in places.items() for at in own)]
    assert order == want and sum(abs(a - b) < 5 for a, b in zip(order, order[1:])) < 0.1 * len(order)


def test_mixing_takes_rows_one_by_one(spark):
    docs = [(None, f"only text {i} " + "w " * (i % 5), "a") for i in range(300)] + [(i, "w w w", "b") for i in range(300)] + [(7, "another text", "b")] * 2
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), keep=("doc_id", "text", "source")).collect()
    assert len(got) == len(docs)
    for s in "ab":
        assert abs(sum(r["taken"] for r in got if r["row"]["source"] == s) - next(r["target"] for r in got if r["row"]["source"] == s)) <= 9
    assert len({r["copies"] for r in got if r["row"]["source"] == "b"}) == 2


def test_fixity(spark, tmp_path):
    """Damage of all kinds against an alignment by plain Python."""
    rng = random.Random(8)
    frame = lambda x: spark.createDataFrame(x, "k long, u string, h string")
    leaves = lambda x: warc_fixity.leaves(frame(x), "k", "u", "h")
    pages = [(i, f"http://a/{i}", f"<p>{i}</p>") for i in range(5000)] + [(77, "http://a/77", "<p>twice</p>")] * 3 + [(None, f"n{i}", "x") for i in range(9)]
    bad = []
    for k, u, h in pages:
        at = rng.random()
        if k is not None and 2100 < k and at < 0.004:  # files of few changes; the first has none
            continue
        if k is not None and 2100 < k and at < 0.008:
            h = h.replace("<p>", "<q>" if at < 0.006 else "<em>")
        bad.append((k, u, h))
    bad += [(4500, "http://new", "n"), (9000, "http://new", "n")]

    def manifest(rows):
        out, files = [], {}
        for k, u, h in rows:
            record = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {u}\r\nContent-Type: text/html\r\nContent-Length: {len(h)}\r\n\r\n{h}\r\n\r\n".encode()
            file = k // 2048 if k is not None else -1 - int(hashlib.md5(u.encode()).hexdigest()[:3], 16)
            files.setdefault(file, []).append((-1 if k is None else k, hashlib.sha256(record).hexdigest(), len(record)))
        for file, own in files.items():
            at = 0
            for n, (k, digest, size) in enumerate(sorted(own)):
                out.append((file, k, digest, at, size, n))
                at += size
        return out

    ours, theirs = manifest(pages), manifest(bad)
    there = {(f, n): (d, at) for f, _, d, at, _, n in theirs}
    here = {(f, n): (d, at) for f, _, d, at, _, n in ours}
    mine = [r for r in ours if there.get((r[0], r[5])) != (r[2], r[3])]
    other = [r for r in theirs if here.get((r[0], r[5])) != (r[2], r[3])]
    want, rest = Counter(), []
    for r in mine:
        twin = next((x for x in other if x[:3] == r[:3]), None)
        if twin:
            other.remove(twin)
            want[r[0], r[1], "moved", twin[3]] += 1
        else:
            rest.append(r)
    for r in rest:
        twin = next((x for x in other if x[:2] == r[:2]), None)
        if twin:
            other.remove(twin)
        want[r[0], r[1], "corrupt" if twin else "missing", twin and twin[3]] += 1
    for r in other:
        want[r[0], r[1], "added", r[3]] += 1
    got = Counter((r["file"], -1 if r["key"] is None else r["key"], r["finding"], r["their_start"]) for r in warc_fixity.audit(leaves(pages), leaves(bad)).collect())
    assert got == want and {k[2] for k in want} == {"moved", "corrupt", "missing", "added"}
    assert warc_fixity.audit(leaves(pages), leaves(pages)).isEmpty()
    record = "".join(r["r"] for r in frame(pages[:3]).select(warc_fixity.record_bytes(F.col("u"), F.col("h")).alias("r")).collect())
    (tmp_path / "a.warc").write_bytes(record.encode())
    rows = warc_fixity.read_warc(spark, str(tmp_path / "a.warc")).orderBy("place").collect()
    assert [(r["uri"], bytes(r["content"])) for r in rows] == [(u, h.encode()) for _, u, h in pages[:3]]
    assert sum(r["length"] for r in rows) == len(record)


SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
def test_near_classes_on_documents(spark):
    """Every link of 0.8 or more between documents is within a class, and classes are no larger than their links."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("text is not null")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    sides = []
    for i in ids:
        code, weight, _, _ = probminhash.shingles(*flat(pa.array([texts[i]])))
        sides.append((code, weight))
    label = list(range(len(ids)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for j in range(len(ids)):
        for i in range(j):
            if find(i) != find(j) and probminhash.probability_jaccard(*sides[i], *sides[j]) >= 0.8 - probminhash.ROUNDING:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    want = {ids[k]: ids[find(k)] for k in range(len(ids))}
    got = {r["id"]: r["class_id"] for r in probminhash.near_classes(docs).collect()}
    assert got == want and len({*want.values()}) < len(want)


@needs_tables
def test_language_of_held_out_documents(spark):
    text = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    right = []
    for r in QUERIES["op2_ppm_language"](spark, SF).collect():
        d = text[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in d["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["held_out"] and d["lang"] is not None:
            right.append(r["lang_pred"] == d["lang"])
    assert len(right) > 40 and np.mean(right) > 0.95


@needs_tables
def test_toxicity_of_documents(spark):
    larger = SF.replace("0.001", "0.01")  # with enough labels
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = QUERIES["op9_toxicity"](spark, larger).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    known = [(r["score"], marks[r["doc_id"]]) for r in rows if marks.get(r["doc_id"]) is not None]
    toxic, clean = ([s for s, m in known if m == k] for k in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.75 and np.mean([s >= 0.5 for s in clean]) < 0.05


def test_toxicity_finds_disguised_words(spark):
    """Held-out texts whose bad words are written in signs are scored like those that write them out."""
    rng = random.Random(21)
    bad, good = ["idiot", "moron", "scumbag", "loser"], EN.split()
    disguise = lambda w: rng.choice((w.replace("i", "1").replace("o", "0"), w.replace("s", "$").replace("o", "0"), " ".join(w), ".".join(w), w[:2] + w[1] * 2 + w[2:]))
    docs, marks = [], []
    for i in range(400):
        words = rng.choices(good, k=30)
        if i % 2:
            for w in rng.choices(bad, k=3):
                words.insert(rng.randrange(30), w if i < 200 else disguise(w))
        docs.append((i, " ".join(words)))
        marks.append((i, i % 2))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(frame.where("doc_id < 200"), spark.createDataFrame(marks[:200], "doc_id long, toxic int"), toxicity.letter_costs(toxicity.count_letters(frame)))
    late = frame.where("doc_id >= 200").select("doc_id", toxicity.toxicity(spark, F.col("text"), model)["score"].alias("s")).collect()
    assert np.mean([r["s"] >= 0.5 for r in late if r["doc_id"] % 2]) > 0.9 and not any(r["s"] >= 0.5 for r in late if r["doc_id"] % 2 == 0)


def test_simhash_query(spark, odd):
    """Edited texts, counts and likenesses by plain Python."""
    docs = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    fps = [int(x.tobytes().hex(), 16) for x in simhash.fingerprints(pa.array([t for _, t in docs]))]
    for k, (i, t) in enumerate(docs):
        n = (k + 1) % len(docs)
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[n][1][:half]
        own = int(simhash.fingerprints(pa.array([edited]))[0].tobytes().hex(), 16)
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{fps[k]:032x}", f"{own:032x}", 1 - (fps[k] ^ own).bit_count() / 128, 1 - (fps[k] ^ fps[n]).bit_count() / 128] += 1
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in QUERIES["op4_simhash"](spark, odd).collect())
    assert got == want


def test_license_query(spark, tmp_path):
    rng = random.Random(22)
    bits = ["mit", "license", "MIT", "License", "apache", "general", "public", "the", "é", "x", "gnu", "-", "general public license", "mit  license,"]
    docs = [(i, " ".join(rng.choices(bits, k=rng.randrange(30)))) for i in range(120)] + [(120, None), (121, ""), (121, "mit license")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for phrase, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        want[i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))] += 1
    rows_ = QUERIES["op7_license_scan"](spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows_) == want
    assert all({*filter(None, r["base_labels"].split(","))} <= {*r["labels"].split(",")} and 0 <= r["score"] <= 1 for r in rows_)


def test_bpe_on_code_points():
    import public_tokenizers
    import tiktoken

    path, pattern = bpe.tokenizer()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    # whether a character makes one piece with a letter, a digit, a sign or white space, by ranks that join last bytes and these
    joined = {bytes([b]): b for b in range(256)} | {bytes([b, t]): 256 * (k + 1) + b for k, t in enumerate(b"a1!\n ") for b in range(256)}
    pieces = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=joined, special_tokens={})
    ours = bpe.Bpe(joined, pattern)
    edges = {c + k for first, last in bpe.LETTERS_16 + bpe.DIGITS_16 for c in (first, last) for k in (-1, 0, 1)}
    some = sorted(edges | {*range(0x400), *range(0x2000, 0x2070), 0x3000, *random.Random(3).sample(range(0x20000), 3000)})
    for after in "a1!\n ":
        texts = [chr(c) + after for c in some if not 0xD800 <= c < 0xE000]
        ids, ends = ours.encode(texts)
        theirs_ = pieces.encode_ordinary_batch(texts)
        assert [len(x) for x in theirs_] == np.diff(ends).tolist()
    texts = ["".join(chr(c) + " a"[c % 2] for c in range(low, low + 256) if not 0xD800 <= c < 0xE000) for low in range(0, 0x20000, 1024)]
    ids, ends = bpe.Bpe.load(path, pattern).encode(texts)
    assert all(ids[a:b].tolist() == theirs.encode_ordinary(t) for t, a, b in zip(texts, ends, ends[1:]))


def test_training_is_bounded(spark):
    docs = [(i, "word " * 100, f"l{i % 3}") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        ppm.train(frame, max_langs=2)
    model = ppm.train(frame, max_docs=10, max_bytes=1200)
    assert [int(t.totals[0].sum()) for t in model.trees] == [1500] * 3  # whole texts, until there are 1,200 bytes


def test_no_import_outside():
    import pathlib

    home = pathlib.Path(corpus_pipeline.__file__).parent / "quillcheck"
    for path in home.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", path.read_text())
