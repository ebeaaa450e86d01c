"""Title similarity, similarity joins and free-text search against brute force."""

import math
import random
import re
import time
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillcheck.functions import text as T
from quillcheck.operators import lookup, ranking, references, similarity
from quillcheck.plans.queries import QUERIES


def test_folding_of_all_characters(spark):
    def plain(s):
        s = unicodedata.normalize("NFKD", s).replace("ı", "i")
        return "".join(x for x in s if not unicodedata.combining(x)).lower()

    rng = random.Random(3)
    every = [chr(k) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000]
    pool = [c for c in every[:0x2FA20] if unicodedata.normalize("NFKD", c) != c] + list("abc ΣΟΣ ıİß 가각힣 ½ﬁ ")
    rows = every + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    import pandas as pd

    frame = spark.createDataFrame(pd.DataFrame({"k": range(len(rows)), "s": rows}))
    got = dict(frame.select("k", T.fold_accents(F.col("s")).alias("f")).toPandas().itertuples(index=False))
    assert [(s, got[k]) for k, s in enumerate(rows) if got[k] != plain(s)] == []
    plan = frame.select(T.fold_accents(F.col("s")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
    return row[-1]


def plain_ratio(a, b):
    """By the distance of whole texts: what is shared, and what is shared followed by the rest of each."""
    x, y = {*a.split()}, {*b.split()}
    if not x or not y:
        return 0.0
    if x & y and (x <= y or y <= x):
        return 1.0
    both, rest_x, rest_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    join = lambda *parts: " ".join(p for p in parts if p)
    p, q = join(both, rest_x), join(both, rest_y)
    ratio = lambda m, n, common: 1 - (m + n - 2 * common) / (m + n)
    lead = len(both) + bool(both)
    scores = [ratio(len(p), len(q), lead + subsequence(rest_x, rest_y))]
    if both:
        scores += [ratio(len(both), len(p), len(both)), ratio(len(both), len(q), len(both))]
    return max(scores)


def test_token_set_ratio(spark):
    rng = random.Random(6)
    words = "deep learning of the graph net A b paper éa graphs networks x".split()
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 9))), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for _ in range(500)]
    pairs += [("", "a"), ("same words here", "here words same"), ("fuzzy was a bear", "fuzzy fuzzy was a bear"), ("abc", "xyz"), ("x" * 300 + " y", "y " + "xz" * 150)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.x for r in rows.select("i", T.title_similarity(F.col("a"), F.col("b"), fuzzy=True).alias("x")).collect()}
    assert all(got[i] == pytest.approx(plain_ratio(*p), abs=1e-12) for i, p in enumerate(pairs))
    assert got[501] == 1.0 and got[502] == 1.0 and got[503] == 0.0


def test_title_ratio_query(spark):
    d = "/root/testdata/sf0.001"
    entries, got = {r.id: r for r in QUERIES["title_ratio"](spark, d).collect()}, 0
    from quillcheck.plans.inputs import load

    rec = load(spark, d, "catalog").where("source = 's2'").select(F.col("pos").alias("id"), F.col("title").alias("found"))
    for r in load(spark, d, "entries").join(rec, "id").collect():
        other = " ".join(r.found.split(" ")[::-1]) if r.id % 2 == 0 else r.found[2:62] + " xyz"
        plain = lambda s: " ".join(re.sub(r"[{}$]", "", s).split())
        if "\\" not in r.title + other:
            got += 1
            assert entries[r.id].ratio == pytest.approx(plain_ratio(plain(r.title), plain(other)), abs=1e-12)
    assert got > 50


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.85, 1.0])
def test_similar_sets(spark, threshold, monkeypatch):
    monkeypatch.setattr(similarity, "PART", 7)
    monkeypatch.setattr(similarity, "FREQUENT", 3)
    rng = random.Random(int(100 * threshold))
    words = [f"t{k}" for k in range(25)]
    make = lambda n: {frozenset(["every", *rng.sample(words, rng.randint(0, 12))]) for _ in range(n)}
    left, right = make(150), make(150)
    for s in [*left][:60]:
        right.add(frozenset([*s][1:] + ["more"]))
    frame = lambda sets: spark.createDataFrame([(" ".join(sorted(s)), sorted(s)) for s in sets], "set string, tokens array<string>")
    share = lambda x, y: len(x & y) / len(x | y)
    key = lambda s: " ".join(sorted(s))
    got = similarity.similar_sets(frame(left), frame(right), threshold).collect()
    want = {(key(x), key(y)): share(x, y) for x in left for y in right if share(x, y) >= threshold}
    assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want)
    got = similarity.similar_sets(frame(left | right), None, threshold).collect()
    want = {(key(x), key(y)): share(x, y) for x in left | right for y in left | right if key(x) < key(y) and share(x, y) >= threshold}
    assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want)


def test_one_token_in_every_title(spark):
    """A token that all sets have stands last in the order of all, so sets do not meet under it unless they have nothing else in common."""
    rows = [(f"every w{k} v{k % 997} u{k % 499}", ["every", f"w{k}", f"v{k % 997}", f"u{k % 499}"]) for k in range(6000)]
    frame = spark.createDataFrame(rows, "set string, tokens array<string>").repartition(4)
    counts = similarity.token_counts(frame)
    first = similarity._prefixes(frame, counts, 0.6)
    keys = first.select(F.explode("prefix").alias("token")).groupBy("token").count().agg(F.max("count").alias("n"), F.max(F.when(F.col("token") == "every", F.col("count"))).alias("every")).head()
    assert keys.every is None and keys.n <= 30


def test_frequent_tokens_meet_in_combinations(spark):
    """Where every token is in many sets, no key of sets is large: several tokens make a key, and pairs are those of all against all."""
    rng = random.Random(4)
    words = [f"t{k}" for k in range(60)]
    sets = [*{tuple(sorted(rng.sample(words, rng.randint(1, 14)))) for _ in range(4000)}]
    sets += [*{tuple(sorted({*s[1:], "t0"})) for s in sets[:400] if len(s) > 1} - {*sets}]
    frame = spark.createDataFrame([(" ".join(s), list(s)) for s in sets], "set string, tokens array<string>")
    rows = frame.select(F.monotonically_increasing_id().alias("at"), "tokens")
    first = similarity._prefixes(rows, similarity.token_counts(rows), 0.6, 3)
    keys = similarity._keys(first, len(sets), 0.6, ("own", "other"))
    asked = similarity._keys(first, len(sets), 0.6, ("other", "own"))
    pairs = keys.groupBy("key").count().join(asked.groupBy("key").agg(F.count("*").alias("n")), "key").agg(F.sum(F.col("count") * F.col("n"))).head()[0]
    single = sum(n * n for n in Counter(t for s in sets for t in s[: len(s) - math.ceil(0.6 * len(s)) + 1]).values())
    assert pairs < single / 10
    got = similarity.similar_sets(frame, None, 0.6).collect()
    own = [(" ".join(s), {*s}) for s in sets]
    want = {(min(a, b), max(a, b)) for k, (a, x) in enumerate(own) for b, y in own[:k] if 5 * len(x & y) >= 3 * len(x | y)}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 300


def plain_bm25(records, query, least):
    docs = [re.findall("[a-z0-9]+", t.lower()) for _, t in records]
    n, mean = sum(map(bool, docs)), sum(map(len, docs)) / max(1, sum(map(bool, docs)))
    df = Counter(t for d in docs for t in {*d})
    best = None
    for (place, _), d in zip(records, docs):
        tf, score = Counter(d), 0
        for t in {*re.findall("[a-z0-9]+", (query or "").lower())} & {*d}:
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            share = tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean))
            score += int(1e6 * idf * share + 0.5)
        if d and score >= least * 1e6 and (best is None or (-score, place) < best):
            best = (-score, place)
    return best and (best[1], -best[0] / 1e6)


def test_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ranking, "PART", 20)
    rng = random.Random(9)
    common, rare = [f"c{k}" for k in range(8)], [f"r{k}" for k in range(300)]
    records = [(k, " ".join(rng.choices(common, k=rng.randint(0, 6)) + rng.choices(rare, k=rng.randint(0, 6)))) for k in range(400)]
    records += [(400 + k, records[k][1]) for k in range(40)] + [(500, ""), (501, None)]
    queries = [(k, " ".join(rng.choices(common, k=rng.randint(0, 8)) + rng.choices(rare, k=rng.randint(0, 5)))) for k in range(150)]
    queries += [(200 + k, records[k][1] + " c1 extra unknown") for k in range(40)] + [(300, None), (301, "unknown words"), (302, "c0 c1 c2 c3 c4 c5 c6 c7"), (303, queries[0][1])]
    index = ranking.build(spark.createDataFrame(records, "place int, text string"))
    for least, seeds in ((0.5, 2000), (6.0, 2000), (6.0, 0), (0.5, 0)):
        monkeypatch.setattr(ranking, "FIRST", seeds)
        got = {r.id: (r.place, r.score) for r in ranking.search(index, spark.createDataFrame(queries, "id int, text string"), least).collect()}
        want = {i: w for i, q in queries if (w := plain_bm25([(p, t or "") for p, t in records], q, least))}
        assert got.keys() == want.keys()
        for i, (place, score) in want.items():
            assert got[i][0] == place and got[i][1] == pytest.approx(score, abs=1e-5), (i, got[i], want[i])
    assert index.postings.where("token = 'c1'").select("part").distinct().count() > 1  # frequent tokens are cut


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "place int, text string")
    index = ranking.build(none)
    assert ranking.search(index, spark.createDataFrame([(1, "a b")], "id int, text string"), 1.0).count() == 0


def test_raw_references_resolve(spark):
    titles = ["Attention is all you need", "Deep residual learning for image recognition", "Language models are few shot learners"]
    rows = [("crossref", f"r{k}", k, t, ["A. Vaswani" if k == 0 else "B. Other"], "2017", "Venue", "10.1/x", None, None, False) for k, t in enumerate(titles)]
    rows += [("s2", "s9", 9, "A survey of quiet gardens", ["C. Green"], "2001", "W", None, None, 1, False)]
    catalog = spark.createDataFrame(rows, "source string, rec_id string, pos bigint, title string, authors array<string>, year string, venue string, doi string, arxiv_id string, citation_count bigint, is_retracted boolean")
    refs = [(1, "[1] Vaswani, A., Shazeer, N.: Attention is all you need (2017)", "", ""), (2, "He, K. Deep residual learning for image recogition. CVPR 2016", "He", "He"), (3, "Green, C. A survey of quiet gardens. W, 2001.", "A survey of quiet gardens", "Green, C."), (4, "nothing like it", "nothing like it", "")]
    got = {r.id: (r.resolved_by, r.rec and r.rec.rec_id) for r in lookup.resolve(spark.createDataFrame(refs, "id int, raw string, title string, author string"), catalog, least=1.5).collect()}
    assert got == {1: ("crossref", "r0"), 2: ("crossref", "r1"), 3: ("s2", "s9"), 4: (None, None)}


def _moved(spark):
    """Rows that the stages so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    jvm = spark.sparkContext._jvm
    empty = jvm.java.util.ArrayList
    stages = sc.statusStore().stageList(empty(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), empty())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_search_moves_no_pairs(spark):
    """Queries that share frequent words with every record, and have no good one among them."""
    n = 700
    records = spark.createDataFrame([(k, f"alpha{k % 3} beta{k % 4} gamma{k % 5} own{k}") for k in range(n)], "place int, text string")
    queries = spark.createDataFrame([(k, f"alpha{k % 3} beta{k % 4} gamma{k % 5} alpha{(k + 1) % 3} beta{(k + 1) % 4} x{k}") for k in range(n)], "id int, text string")
    index = ranking.build(records)
    before = _moved(spark)
    got = ranking.search(index, queries, 0.5).collect()
    assert len(got) == n
    assert _moved(spark) - before < 100 * n


def _cell(bags, queries, tokens, seed):
    """Lists and queries of a cell whose tokens are as uneven as words are: places in lists are numbers of bags, spread out."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    draw = lambda n: np.minimum((tokens ** rng.random(n)).astype(int), tokens) - 1
    length = rng.integers(1, 28, bags)
    bag, token = np.repeat(np.arange(bags), length), draw(length.sum())
    (bag, token), tf = np.unique(np.stack([bag, token]), axis=1, return_counts=True)
    df = np.bincount(token, minlength=tokens)
    weight = np.round(1e6 * np.log(1 + bags / df[token]) * tf * 2.2 / (tf + 0.3 + 0.9 * length[bag] / 14)).astype(np.int32)
    order = np.lexsort((bag, token))
    token, bag, weight = token[order], bag[order], weight[order]
    at = np.flatnonzero(np.append(True, np.diff(token) != 0))
    offsets = pa.array(np.append(at, len(token)), pa.int32())
    lists = pa.table({"t": token[at] + (1 << 33), "ats": pa.ListArray.from_arrays(offsets, pa.array(bag * 5 + (1 << 40))), "weights": pa.ListArray.from_arrays(offsets, pa.array(weight))})
    ts = [sorted({*(draw(rng.integers(1, 24)) + (1 << 33)).tolist()}) for _ in range(queries)]
    return lists.take(rng.permutation(len(at))), pa.table({"set": pa.array(range(queries), pa.int64()), "ts": pa.array(ts, pa.list_(pa.int64()))}), (token, bag, weight)


def _plain_best(bags, sets, postings, floor):
    import numpy as np

    token, bag, weight = postings
    at, weight = np.append(0, np.cumsum(np.bincount(token))), weight.astype(float)
    out = {}
    for name, ts in zip(sets["set"].to_pylist(), sets["ts"].to_pylist()):
        own = [t - (1 << 33) for t in ts if t - (1 << 33) < len(at) - 1]
        total = sum(np.bincount(bag[at[t] : at[t + 1]], weight[at[t] : at[t + 1]], bags) for t in own) if own else np.zeros(bags)
        if total.max() >= floor:
            out[name] = (int(total.argmax()) * 5 + (1 << 40), int(total.max()))
    return out


@pytest.mark.parametrize("dense,together,few,first", [(64, 64, 16, 32), (1, 7, 16, 0), (3, 64, 0, 5), (1000, 1, 3, 1000)])
def test_cells_are_exact(monkeypatch, dense, together, few, first):
    """whichever lists are added up and whichever are looked up."""
    for name, value in (("DENSE", dense), ("TOGETHER", together), ("FEW", few)):
        monkeypatch.setattr(ranking, name, value)
    for seed, floor in ((1, 1), (2, 8_000_000), (3, 25_000_000)):
        lists, sets, postings = _cell(600, 150, 300, seed)
        got = ranking._best_of(floor, first)(sets, lists)
        assert {n: (at, score) for n, at, score in zip(*(got[c].to_pylist() for c in ("set", "at", "score")))} == _plain_best(600, sets, postings, floor)
    lists = lists.set_column(2, "weights", [[[min(w * 300, (1 << 31) - 1) for w in ws] for ws in lists["weights"].to_pylist()]])  # sums beyond 32 bits
    token, bag, weight = postings
    got = ranking._best_of(1, first)(sets, lists)
    want = _plain_best(600, sets, (token, bag, (weight.astype("int64") * 300).clip(max=(1 << 31) - 1)), 1)
    assert {n: (at, score) for n, at, score in zip(*(got[c].to_pylist() for c in ("set", "at", "score")))} == want and max(s for _, s in want.values()) > 1 << 31


def test_a_search_is_faster_than_all_scores():
    """in large cells, finding the best bag takes less than adding up all lists of the query; it took several times that."""
    bags = 60_000
    lists, sets, postings = _cell(bags, 1_000, 30_000, 4)
    start = time.process_time()
    want = _plain_best(bags, sets, postings, 12_000_000)
    plain, start = time.process_time() - start, time.process_time()
    got = ranking._best_of(12_000_000, ranking.FIRST)(sets, lists)
    took = time.process_time() - start
    assert {n: (at, score) for n, at, score in zip(*(got[c].to_pylist() for c in ("set", "at", "score")))} == want
    assert took < plain


def test_raw_references_are_not_parsed(spark):
    """the search of raw references needs their strings alone."""
    docs = spark.createDataFrame([(1, "Body\nReferences\n[1] A. One. A first title, 2001.\n[2] B. Two. A second title, 2002.\n[3] C. Three. A third title, 2003.\n")], "doc long, text string")
    refs = references.references(docs)
    assert [tuple(r) for r in refs.where("index = 2").collect()] == [(1, 2, "B. Two. A second title, 2002.", "A second title, 2002.", "B. Two. A second title", "2002")]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "sentences" in plan(refs) and "sentences" not in plan(refs.select("doc", "raw"))


def test_references_are_parsed_once(spark, monkeypatch):
    """the search of raw references and the join of what it finds read the same parsed rows."""
    titles = ["Attention is all you need", "Deep residual learning"]
    catalog = spark.createDataFrame([("crossref", f"r{k}", k, t, ["A. Lee"], "2017", "V", "10.1/x", None, None, False) for k, t in enumerate(titles)], "source string, rec_id string, pos bigint, title string, authors array<string>, year string, venue string, doi string, arxiv_id string, citation_count bigint, is_retracted boolean")
    parsed = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(1, "Lee: Attention is all you need"), (2, "Lee: Deep residual learning")], 1)
    refs = rows.map(lambda r: (parsed.add(1), (*r, r[1], "Lee"))[1]).toDF("id int, raw string, title string, author string")
    got = {r.id: r.rec.rec_id for r in lookup.resolve(refs, catalog, least=0.1).collect()}
    assert got == {1: "r0", 2: "r1"} and parsed.value == 2


def test_token_sets_are_worked_out_once(spark, monkeypatch):
    """F6 to F9, F13: no filter on a title's tokens, or on the similarity of two sets, is pushed down to work them out once more."""
    titles = ["Deep graph nets", "Deep graph nets 2", "{\\'E}t\\'e du   graph", "...", "", None, "Deep nets\tof graph"]
    entries = spark.createDataFrame([(k, 1, k, f"k{k}", t, "A. Lee") for k, t in enumerate(titles)], "id long, file long, ord int, key string, title string, author string")
    catalog = spark.createDataFrame([(s, f"r{k}", k, t, ["A. Lee"], "2017", "V", "10.1/x", None, None, False) for k, t in enumerate(titles) for s in ("dblp", "s2")], "source string, rec_id string, pos bigint, title string, authors array<string>, year string, venue string, doi string, arxiv_id string, citation_count bigint, is_retracted boolean")
    for module in (lookup, similarity):
        plans = []
        cut = module.cut
        monkeypatch.setattr(module, "cut", lambda df, plans=plans, cut=cut: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
        if module is lookup:
            got = {(r.id, r.source): r.rec.rec_id for r in lookup.search_titles(entries, catalog, ("dblp", "s2")).collect()}
            assert got == {(k, s): f"r{k}" for k in (0, 1, 2, 6) for s in ("dblp", "s2")}
        else:
            similarity.duplicate_issues(entries).collect()
            assert {(r.key_a, r.key_b) for r in similarity.duplicate_classes(entries, "id", "title", 0.75).collect()} == {(0, 1), (0, 6)}
        found = [p.count("[a-z0-9]+") for p in plans if "[a-z0-9]+" in p]
        assert found and set(found) == {1}
    sets = spark.createDataFrame([("a b", ["a", "b"]), ("a b c", ["a", "b", "c"])], "set string, tokens array<string>")
    near = similarity.similar_sets(sets, None, 0.6)
    assert near._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1
    assert [(r.a, r.b, r.similarity) for r in near.collect()] == [("a b", "a b c", 2 / 3)]


def test_keys_are_shuffled_once(spark):
    """F6 to F9, F13: the keys of sets are shuffled to meet, and not for the sizes of keys before."""
    sets = [(f"a{k} b{k} c{k % 50}", [f"a{k}", f"b{k}", f"c{k % 50}"]) for k in range(3000)]
    frame = spark.createDataFrame(sets, "set string, tokens array<string>")
    plan = similarity.similar_sets(frame, None, 0.6)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(key#\d+L?, \d+\)", plan)) <= 2  # both for the counts of the keys
