"""Ball hashing, periodic runs and fill-in-middle against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillcheck.llm import ball_dedup, fill_middle, periodic_runs
from quillcheck.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "".join(f"w{k * k % 911} " for k in range(90_000))


def plain_fingerprint(text):
    words = [m.group() for m in WORD.finditer(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def plain_runs(w, least, times):
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            a = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            length = i + p - a
            if i > a and length >= max(least, times * p) and not any(w[a : a + length - q] == w[a + q : a + length] for q in range(1, p)):
                out.append((a, length, p))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        words = [rng.choice("a b c Dd é 中 x1 -".split()) for _ in range(rng.randint(0, 60))]
        sep = rng.choice([" ", "\n", "\t ", " \x0b"])
        rows.append((i, sep.join(words) + rng.choice(["", " ", "\r\n"])))
    rows += [(200, "go go " * 40), (201, None), (202, ""), (203, " \n "), (204, "one"), (205, "two words"), (206, "a<P>b c d"), (207, "x y z q" * 30), (208, LONG), (208, "other text of the same id here"), (None, "no id at all"), (None, None), (209, "😀é" * 600 + "end"), (210, "a" * 1024), (211, "<" * 40 + "S>")]
    base = [f"v{rng.randrange(2000)}" for _ in range(3000)]
    for i in range(300, 330):
        base[rng.randrange(3000)] = f"new{i}"
        rows.append((i, " ".join(base)))
    rows += [rows[5], rows[5], rows[-1], rows[129]]
    d = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame([(*r, "k", 1, 2, "x", "f") for r in rows], "doc_id bigint, text string, identity string, n_units int, label int, fp string, name string").repartition(3).write.parquet(f"{d}/documents.parquet")
    return d, rows


def test_fingerprints(spark):
    texts = ["", None, "one", "Two words", "a b c", "a  b\tc\n", "É E é e", "x " * 1000, LONG]
    got = ball_dedup.fingerprints(pa.array(texts)).tolist()
    assert got == [plain_fingerprint(t) for t in texts]
    try:
        ball_dedup.PIECE, before = 7, ball_dedup.PIECE
        assert ball_dedup.fingerprints(pa.array(texts[:-1])).tolist() == got[:-1]
    finally:
        ball_dedup.PIECE = before
    hashed = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).head().h  # the same function in the JVM
    assert hashed % 2**64 == got[4]


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_ball_links(spark, radius):
    rng = random.Random(radius)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(8):
            fps.add(centre)
            centre ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 5)))
            centre %= 1 << 64
    fps |= {0, 1 << 63, 2**64 - 1}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = ball_dedup.ball_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), "fp", radius).collect()
    at = {f: i for i, f in enumerate(signed)}
    assert all((fps[at[r.a]] ^ fps[at[r.b]]).bit_count() <= radius for r in links)
    label = list(range(len(fps)))
    for _ in fps:
        for r in links:
            label[at[r.a]] = label[at[r.b]] = min(label[at[r.a]], label[at[r.b]])
    assert label == plain_components(fps, radius)
    with pytest.raises(ValueError):
        ball_dedup.ball(3)


def test_ball_query(spark, table):
    d, rows = table
    got = QUERIES["op11_ball_dedup"](spark, d).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    labels = plain_components(fps, 2)
    least = {}
    for (i, _), k in zip(rows, labels):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    want = sorted((repr(i), f"{f:016x}", repr(least.get(k))) for (i, _), f, k in zip(rows, fps, labels))
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == want
    assert len({*labels}) < len({*fps})  # some distinct fingerprints are linked


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        least, times = rng.choice([(2, 2), (4, 2), (6, 3), (9, 3), (24, 3), (5, 2)])
        sequences = []
        for _ in range(rng.randint(1, 4)):
            n, k, kind = rng.randint(0, 60), rng.randint(1, 4), rng.random()
            if kind < 0.4:
                w = [rng.randrange(k) for _ in range(n)]
            elif kind < 0.8:
                part, w = [rng.randrange(k) for _ in range(rng.randint(1, 8))], []
                while len(w) < n:
                    w += part * rng.randint(1, 5) + [rng.randrange(k) for _ in range(rng.randint(0, 3))]
            else:  # Fibonacci words are full of runs
                a, w = [0], [1]
                while len(w) < n:
                    a, w = w, w + a
            sequences.append(w[:n])
        got = periodic_runs.solve([np.array(w, np.int64) for w in sequences], least, times)
        assert got == [plain_runs(w, least, times) for w in sequences]
    with pytest.raises(ValueError):
        periodic_runs.solve([], 24, 1)


def test_runs_in_blocks(monkeypatch):
    rng = random.Random(6)
    part = [rng.randrange(9) for _ in range(40)]
    w = part * 5 + [rng.randrange(9) for _ in range(300)] + part * 4 + [1, 2] * 70 + part * 5 + [1, 2] * 70 + [3] * 100
    want = plain_runs(w, 24, 3)
    assert len(want) > 4
    monkeypatch.setattr(periodic_runs, "PAIRS", 100)
    assert periodic_runs.solve([np.array(w)])[0] == want


def plain_op12(i, text):
    words = [m.group() for m in WORD.finditer(text or "")]
    n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(words, 24, 3)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("a b c d é".split()) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    for i in range(300, 360):
        part = [rng.choice("a b c d".split()) for _ in range(rng.randint(1, 12))]
        rows.append((i, " ".join(["x"] * rng.randint(0, 9) + part * rng.randint(2, 30) + ["y"] * rng.randint(0, 40) + part * 9)))
    rows += [(500, None), (501, ""), (502, "\n\t"), (None, "z " * 50), (503, "q " * 20_000), rows[310], rows[310]]
    spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id bigint, text string, runs string, start int").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    want = [plain_op12(*r) for r in rows if r[0] != 503]
    assert sum(w[1] > 1 for w in want) > 5 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)
    assert sorted(map(repr, (tuple(r) for r in got if r.doc_id != 503))) == sorted(map(repr, want))
    (one,) = [r for r in got if r.doc_id == 503]
    assert (one.n_runs, one.start, one.length, one.period, one.exponent_milli) == (1, 0, 20_000, 1, 20_000_000)


def test_fill_middle_query(spark, table):
    d, rows = table
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    want = con.sql(fill_middle.OP13_SQL).fetchall()
    got = QUERIES["op13_fill_middle"](spark, d).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    texts = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert sorted(r.restored_sha256 for r in got) == texts


@pytest.mark.parametrize("units, pattern", [(fill_middle.WORDS, r"\S+\s*|(?s:.)"), (fill_middle.LINES, r"[^\n]*\n|(?s:.)")])
def test_fill_middle_of_other_units(spark, units, pattern):
    texts = [" a b  c\nd e", "x\ny\n\nz", "one", " ", "", None, "w " * 300]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts * 5)], "id int, body string, note string")
    for r in fill_middle.fill_in_middle(docs, "id", "body", units, rate=101).collect():
        text = r.body or ""
        each = re.findall(pattern, text, re.ASCII)
        h = hashlib.sha256(f"1:{r.id}".encode()).hexdigest()
        cut = sorted(int(h[k : k + 8], 16) % (len(each) + 1) for k in (0, 8))
        parts = ["".join(each[a:b]) for a, b in ((0, cut[0]), cut, (cut[1], len(each)))]
        assert (r.n, r.note) == (len(each), "extra")
        if text:
            assert (r.prefix_chars, r.middle_chars) == (len(parts[0]), len(parts[1]))
            assert r.output == (f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}" if r.form == "psm" else f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}")
        else:
            assert (r.form, r.output, r.prefix_chars) == ("plain", "", None)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs.withColumn("form", F.lit(1)), "id", "body")
