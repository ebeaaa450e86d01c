"""Targets of tied sources, the pipeline's stages row by row, and tokens of any length and shape in the toxicity lattice."""

import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillcheck.llm import mixing, probminhash, toxicity
from quillcheck.llm.common import flat

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def water_fill(sizes):
    """Targets by exact arithmetic: sources over their limit are filled, the rest shared anew, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        left = [s for s in order if s not in full]
        rest = total - sum(2 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            return {s: float(share.get(s, 2 * sizes[s])) for s in order}
        full |= over


CASES = {
    "equal": {f"s{k:02}": 25 for k in range(30)},
    "one": {"a": 7},
    "empty": {"a": 0, "b": 0},
    "some empty": {"a": 0, "b": 9, "c": 0, None: 4, "": 9, "d": 9},
    "tied ratios": {"a": 50, "b": 20, "c": 10, "d": 100, "e": 40, "f": 20, "g": 50, "h": 20, "i": 10},
    "many": {f"s{k:04}": 1 + k % 3 for k in range(700)},
}


@pytest.mark.parametrize("case", CASES)
def test_targets_of_tied_sources(spark, case):
    sizes = CASES[case]
    frame = spark.createDataFrame([*sizes.items()], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_of_tied_sources_is_its_sql(spark, tmp_path):
    rows = [(k, "w " * 5, f"s{k % 30:02}") for k in range(150)] + [(k, "w " * 4, "t") for k in range(150, 160)] + [(900, None, None), (901, "x", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cols = "doc_id, size, source_size, taken, shards, positions, round(target, 6)"
    want = con.sql(f"SELECT {cols} FROM ({mixing.OP10_SQL})").fetchall()
    got = mixing.op10_mix_sources(spark, str(tmp_path)).selectExpr(*[c.strip() for c in cols.replace("round(target, 6)", "").split(",") if c.strip()], "round(target, 6)").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    assert sum({s: t for s, t in water_fill(sizes).items()}.values()) == pytest.approx(1.5 * sum(sizes.values()))


def text_of(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def classes_of(texts):
    """Classes by all pairs of similarity 0.8 or more."""
    body, offsets = flat(pa.array(texts))
    code, weight, owner, _ = probminhash.shingles(body, offsets)
    own = [(code[owner == k], weight[owner == k]) for k in range(len(texts))]
    label = [*range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            if len(own[i][0]) and len(own[j][0]) and probminhash.probability_jaccard(*own[i], *own[j]) >= 0.8 - 1e-9:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_near_dedup_row_by_row(spark, tmp_path):
    a, b, c, x = (text_of(k) for k in range(4))
    near = b.rsplit(" ", 3)[0] + " other last words"
    rows = [(1, a), (2, a), (2, b), (3, c), (4, x), (5, x), (5, c), (6, near), (None, a), (None, text_of(9)), (7, near), (7, near), (8, ""), (9, None), (8, "")]
    rng = random.Random(2)
    for k in range(40):
        words = text_of(100 + k % 12, 80).split()
        words[rng.randrange(80)] = f"n{k}"
        rows.append((rng.randrange(10, 30), " ".join(words)))
    full = [(i, t, "en", f"s{k % 3}", len(t or ""), k) for k, (i, t) in enumerate(rows)]
    frame = spark.createDataFrame(full, DOCS + ", _order int").repartition(4)
    got = corpus_pipeline.drop_near_duplicates(spark, frame, str(tmp_path))
    assert got.columns == corpus_pipeline.COLUMNS
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    want, label = Counter(), classes_of([t or "" for _, t in rows])
    for k in {*label}:
        own = [r for r, own_label in zip(rows, label) if own_label == k]
        least = min(own, key=lambda r: (r[0] is None, r[0] or 0))[0]
        held = [r for r in own if r in kept]
        assert len(held) == 1 and held[0][0] == least, own  # one of each class stays, of the least id
        want[held[0]] += 1
    assert kept == want and kept[(2, b)] == 1 and (2, a) not in kept and kept[(8, "")] == 2


ODD_ROWS = [
    *((k, text_of(k) + " the and of", "en", f"s{k % 2}", 1) for k in range(12)), (3, text_of(77) + " the and of", "en", "s0", 1), (3, text_of(3) + " the and of", "en", "s1", 1), (3, text_of(3) + " the and of", "en", "s1", 1),
    (None, text_of(50), "en", None, 1), (None, text_of(50), "en", None, 1), (30, None, None, None, None), (31, "", "en", "s0", 0), (32, "word " * 30_000, "en", "s1", 1),
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, tmp_path, name, stage):
    """Rows of one id with different texts, repeated rows, nulls, and columns of clashing names."""
    extra = "size int, shard int, id int, label string, bands string, fp string, coded string, score double, row string, t string, k int, y int"
    rows = [(*r, 1, 2, 3, "l", "b", "f", "c", 0.5, "r", "t", 4, 5) for r in ODD_ROWS]
    spark.createDataFrame([(k, 0, int(k == 1)) for k in range(12)] + [(3, 0, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.createDataFrame(rows, f"{DOCS}, {extra}")
    got = stage(spark, frame, str(tmp_path)).collect()
    plain = stage(spark, frame.select(*corpus_pipeline.COLUMNS), str(tmp_path)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, plain)) and got
    if name == "byte_bpe":
        assert len(got) == len(ODD_ROWS) and all(r.exact for r in got)
        return
    assert {(r.doc_id, r.text) for r in got} <= {(r[0], r[1]) for r in ODD_ROWS}
    if name == "near_dedup":
        assert Counter(r.doc_id for r in got)[3] == 2
    if name == "mixing":
        assert max(Counter((r.doc_id, r.text) for r in got if r.text).values()) <= 2 * 3


def restorer(words):
    body = words.encode()
    return toxicity.Restorer(toxicity.letter_costs(toxicity.trigram_counts(np.frombuffer(body, np.uint8), np.array([0, len(body)]))))


def test_tokens_without_letters():
    r = restorer("idiot moron stupid loser trash ass cunt shit letter " * 40 + "the cat sat on the mat and looked " * 40)
    for noisy in ("@$$-@$$", "@$$,@$$", "@$$.@$$", "@$$-" * 20 + "@$$", "@$$------------@$$"):
        assert any(w.startswith("ass") for w in r.words(f"the {noisy} is")[0]), noisy
    assert all("ass" in r.words(noisy)[0] for noisy in ("@$$-@$$", "@$$,@$$", "@$$.@$$"))
    assert all(r.words("@$$" * k)[0] for k in (1, 13, 14, 200))  # no length at which a token is left out
    for noisy in ("1d10t" + "-" * 30 + "m0r0n", "1d10t" + "=*=" * 10 + "m0r0n"):
        assert {"idiot", "moron"} <= r.words(noisy)[0], noisy
    for plain in ("12", "2024", "2023-05-06", "12:30", "10,000.00", "---", "!!!", "+1-555-0100"):
        assert r.words(plain)[0] == set(), plain


def test_scores_by_hand(spark):
    """Scores are the logistic function of the model's weights over the restored words and their beginnings."""
    rng = random.Random(31)
    good, bad = "the cat sat on mat and looked at moon while it was quiet".split(), ["idiot", "moronic", "scumbag"]
    docs = [(k, " ".join(rng.choices(good, k=20) + (rng.choices(bad, k=2) if k % 2 else []))) for k in range(160)] + [(200, "the 1d10t sat"), (201, "m.o.r.o.n.i.c mat"), (202, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(160)], "doc_id long, toxic int")
    model = toxicity.train(frame, labels, toxicity.letter_costs(toxicity.count_letters(frame)))
    got = {r.doc_id: r.s for r in frame.select("doc_id", toxicity.toxicity(spark, F.col("text"), model)["score"].alias("s")).collect()}
    said = {200: {"the", "idiot", "sat"}, 201: {"moronic", "mat"}, 202: set()}
    for k, text in docs:
        words = said.get(k, {*(text or "").split()})
        names = {f"w:{w}" for w in words} | {f"{n}:{w[:n]}" for w in words for n in (4, 5) if len(w) > n}
        z = model.base + sum(model.weights.get(n, 0.0) for n in names)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9), k


def test_sample_is_bounded_in_rows(spark, monkeypatch):
    docs = [(1, f"bad idiot {k}") for k in range(300)] + [(k, "good words here") for k in range(2, 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] + [(k, k % 2) for k in range(2, 40)], "doc_id long, toxic int")
    fitted = []
    monkeypatch.setattr(toxicity, "_fit", lambda x, y: fitted.append(len(y)) or np.zeros(x.shape[1] + 1))
    monkeypatch.setattr(toxicity, "FEATURES", 5)
    toxicity.train(frame, labels, toxicity.letter_costs(toxicity.count_letters(frame)), max_docs=10)
    assert all(n <= 20 for n in fitted)
