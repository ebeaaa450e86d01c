"""Exact token-similarity join by rare-first prefixes.

Rows with the same token set are one side's group, so copies never multiply. Tokens stand in one order for all sets: by the number of sets
that have them, then by name. Two sets of Jaccard similarity t or more differ in size by a factor of t at most; size classes are in the key: the
ratio of two classes is t, so similar sets are in the same class or in neighbouring ones. If they must share o tokens, the k-th token that
they share (k up to o) is among the first n - o + k of each. A rare token is a key; a frequent one is a key together with the next token that is shared, and so on
until few sets are expected to have all tokens of the key (``_keys``), so that what meets under the keys grows with the input and not with its square. What
is left of both sets behind the key must be as long as the overlap that t asks for (positional filter). Pairs that met are made distinct and verified.

Counts of tokens are joined, those of the most frequent ones by broadcast (a bounded list), so that no token gathers its sets in one
task. A key with more than ``PART`` sets of the right side is dealt in parts, with the left side's rows in each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import cut


def set_key(tokens):
    """A token set as one string."""
    return F.array_join(F.sort_array(tokens), " ")


#: Tokens whose counts are sent to all tasks, and the longest of them: the size of what is broadcast.
FREQUENT, LONGEST = 20_000, 64
#: Sets of a key that meet the left side's rows at once.
PART = 2_000


#: A token in so many sets at most is a key of its own; of several tokens, if so many sets are expected to have them all.
FEW, EXPECTED = 32, 8
#: Tokens of a key at most, by the size of sets: (from so many tokens, so many tokens in a key). Long sets have too many combinations.
DEPTHS = ((0, 4), (25, 3), (60, 2), (300, 1))


def token_counts(sets: DataFrame) -> DataFrame:
    """In how many sets each token is: token, df."""
    return sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def _prefixes(sets: DataFrame, counts: DataFrame, threshold: float, more: int = 0) -> DataFrame:
    """For each set, its first tokens in the order of all (``more`` than any two similar sets need to share one) and their counts: the columns
    of ``sets`` but tokens, n, prefix, df."""
    own = [c for c in sets.columns if c != "tokens"]
    often = counts.where((F.length("token") <= LONGEST) & (F.col("df") > 1)).orderBy(F.desc("df"), "token").limit(FREQUENT)
    each = sets.select(*own, F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(F.broadcast(often), "token", "left")
    # tokens whose count is known have keys of their own, which nothing meets
    key = F.when(F.col("df").isNull(), F.concat(F.lit("="), "token")).otherwise(F.concat(F.lit("-"), F.xxhash64(own[0], "token").cast("string")))
    rest = counts.select(F.concat(F.lit("="), "token").alias("_key"), F.col("df").alias("_df"))
    each = each.withColumn("_key", key).join(rest, "_key", "left").select(*own, "n", F.coalesce("df", "_df").alias("df"), "token")
    keep = F.col("n") - F.ceil(F.lit(threshold).cast("decimal(6,4)") * F.col("n")).cast("int") + 1 + more
    ranked = each.groupBy(*own, "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("order"))
    ranked = ranked.select(*own, "n", F.slice("order", F.lit(1), keep).alias("order"))
    return ranked.select(*own, "n", F.col("order.token").alias("prefix"), F.col("order.df").alias("df"))


def _size_class(n, threshold: float):
    """Sizes whose ratio is the threshold at least are in one class or in neighbouring ones."""
    if threshold >= 1:
        return n.cast("int")
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")


def _least_size(size_class, threshold: float):
    """No set of the class has fewer tokens."""
    if threshold >= 1:
        return size_class
    return F.ceil(F.exp(size_class * F.lit(-math.log(threshold))) * F.lit(1 - 1e-8)).cast("int")


def _keys(sets: DataFrame, total: int, threshold: float, classes: tuple[str, str]) -> DataFrame:
    """The keys under which sets (at, n, prefix, df) meet: at, n, key, m (its tokens), i (the place of the last). ``classes`` are the size classes in
    the key: own, and other (that of the sets to meet), in the order that both sides have them in."""
    up = lambda x: F.ceil(x - 1e-9).cast("int")
    t, share, n = F.lit(threshold), F.lit(threshold / (1 + threshold)), F.col("n")
    size_class = _size_class(n, threshold)
    rows = sets.select("at", "n", "prefix", "df", size_class.alias("own"), F.explode(F.sequence(size_class - 1, size_class + 1)).alias("other")).where("other >= 0")
    ours, theirs = _least_size(F.col("own"), threshold), _least_size(F.col("other"), threshold)
    # both sides know the classes, hence how many tokens a key may have; need is the least overlap for a set of this very size
    depth = F.lit(0)
    for size, tokens in sorted(DEPTHS):
        depth = F.when(F.greatest(ours, theirs) >= size, tokens).otherwise(depth)
    depth = F.greatest(F.lit(1), F.least(depth, up(share * (ours + theirs))))
    fewest = F.greatest(theirs, up(t * n))
    need = F.greatest(up(share * (n + fewest)), up(t * fewest))
    start = {"key": F.xxhash64(*classes), "m": F.lit(0), "i": F.lit(-1), "expected": F.lit(float(total)), "done": F.lit(False)}
    rows = rows.select("at", "n", "prefix", "df", depth.alias("depth"), need.alias("need"), *(c.alias(k) for k, c in start.items())).where("need <= n")
    done = F.col("done")
    grown = lambda k, c: F.when(done, F.col(k)).otherwise(c).alias(k)
    for m in range(1, max(tokens for _, tokens in DEPTHS) + 1):
        # the m-th token that similar sets share is among the first n - need + m; a finished key stays as it is
        following = F.slice("prefix", F.col("i") + 2, F.greatest(F.lit(0), n - F.col("need") + m - 1 - F.col("i")))
        rows = rows.select(*rows.columns, F.posexplode(F.when(done, F.array(F.lit(""))).otherwise(following)).alias("j", "token"))
        rows = rows.select("at", "n", "prefix", "df", "depth", "need", grown("key", F.xxhash64("key", "token")), grown("m", F.lit(m)), grown("i", F.col("i") + 1 + F.col("j")), "expected", "done")
        rows = rows.withColumn("expected", F.when(done, 0.0).otherwise(F.col("expected") * F.get("df", F.col("i")) / F.lit(float(total))))
        rows = rows.withColumn("done", done | (F.col("depth") <= m) | (F.col("expected") <= (FEW if m == 1 else EXPECTED)))
        rows = rows.withColumn("prefix", F.when(~done, F.col("prefix"))).withColumn("df", F.when(~done, F.col("df")))
    return rows.select("at", "n", "key", "m", "i")


def similar_sets(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """Pairs (a, b, similarity) of distinct token sets; ``left`` and ``right`` have ``set`` and ``tokens``.

    Without ``right``: pairs within ``left``, a < b.
    """
    side = lambda df, on_left, on_right: df.where("size(tokens) > 0").select("set", F.lit(on_left).alias("on_left"), F.lit(on_right).alias("on_right"))
    every = side(left, True, True) if right is None else side(left, True, False).unionByName(side(right, False, True))
    every = every.groupBy("set").agg(F.max("on_left").alias("on_left"), F.max("on_right").alias("on_right"))
    sets = cut(every.withColumn("at", F.monotonically_increasing_id()))
    split = lambda c: F.split(c, " ")
    rows = sets.select("at", "on_left", "on_right", split("set").alias("tokens"))
    # keys have more tokens than the one that similar sets share in any case
    first = cut(_prefixes(rows, cut(token_counts(rows)), threshold, max(tokens for _, tokens in DEPTHS) - 1))
    total = sets.count()
    a = _keys(first.where("on_left"), total, threshold, ("own", "other")).select(F.col("at").alias("x"), F.col("n").alias("na"), "key", "m", F.col("i").alias("ia"))
    b = cut(_keys(first.where("on_right"), total, threshold, ("other", "own")).select(F.col("at").alias("y"), F.col("n").alias("nb"), "key", F.col("i").alias("ib")))
    large = b.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    large = F.broadcast(large)  # one row for PART or more rows, so that the keys themselves are shuffled once
    b = b.join(large, "key", "left").withColumn("part", F.pmod(F.xxhash64("y"), parts).cast("int")).drop("parts")
    a = a.join(large, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    t = F.lit(threshold).cast("decimal(6,4)")
    fits = (F.col("na") >= t * F.col("nb")) & (F.col("nb") >= t * F.col("na"))
    overlap = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9)
    reach = F.col("m") - 1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= overlap
    met = a.join(b, ["key", "part"]).where(fits & reach & (F.col("x") < F.col("y")) if right is None else fits & reach).select("x", "y").distinct()
    name = lambda at, c: sets.select(F.col("at").alias(at), F.col("set").alias(c))
    met = met.join(name("x", "a"), "x").join(name("y", "b"), "y")
    met = met.select("a", "b") if right is not None else met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    both = F.size(F.array_intersect(split("a"), split("b")))
    share = T.let({"both": both, "all": F.size(split("a")) + F.size(split("b"))}, lambda n: n["both"] / (n["all"] - n["both"]))
    # exploded, as a filter on the similarity would be pushed down and work it out twice
    return met.select("a", "b", F.explode(F.filter(F.array(share), lambda s: s >= threshold)).alias("similarity"))


def duplicate_classes(entries: DataFrame, key: str, title: str, threshold: float = 0.85) -> DataFrame:
    """Similar titles as pairs of classes: key_a, key_b (the least keys of two token sets), similarity, n_a, n_b (their members).

    A set with several members is a pair with itself. Titles without tokens are similar to nothing.
    """
    rows = entries.select(F.col(key).alias("key"), set_key(T.title_tokens(F.col(title))).alias("set"))
    sets = cut(rows.groupBy("set").agg(F.min("key").alias("key"), F.count("*").alias("n"))).where("set <> ''").withColumn("tokens", F.split("set", " "))
    pairs = similar_sets(sets, None, threshold)
    a = sets.select(F.col("set").alias("a"), F.col("key").alias("x"), F.col("n").alias("nx"))
    b = sets.select(F.col("set").alias("b"), F.col("key").alias("y"), F.col("n").alias("ny"))
    out = pairs.join(a, "a").join(b, "b")
    swap = F.col("x") > F.col("y")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    out = out.select(pick("x", "y").alias("key_a"), pick("y", "x").alias("key_b"), "similarity", pick("nx", "ny").alias("n_a"), pick("ny", "nx").alias("n_b"))
    own = sets.where("n > 1").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(1.0).alias("similarity"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    return out.unionByName(own)


def duplicate_issues(entries: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Issues within each bibliography file: every pair of entries (file, ord, key, title) with similar titles, in file order."""
    # tokens carry their file, so that only titles of one file meet, and their order is that of the file
    own = F.concat(F.hex(F.xxhash64(F.col("file"))), F.lit(":"))
    rows = entries.select("file", "ord", "key", F.transform(T.title_tokens(F.col("title")), lambda t: F.concat(own, t)).alias("tokens"))
    rows = cut(rows.withColumn("set", set_key(F.col("tokens")))).where("size(tokens) > 0")
    near = similar_sets(rows, None, threshold)
    sym = near.select("a", "b", "similarity").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    x = rows.select("file", F.col("ord").alias("i"), F.col("key").alias("kx"), F.col("set").alias("a"))
    y = rows.select("file", F.col("ord").alias("j"), F.col("key").alias("ky"), F.col("set").alias("b"))
    same = x.join(y.withColumnRenamed("b", "a"), ["file", "a"]).where("i < j").withColumn("similarity", F.lit(1.0)).drop("a")
    other = x.join(sym, "a").join(y, ["file", "b"]).where("i < j").select(*same.columns)
    pairs = same.unionByName(other)
    message = F.concat(F.lit("Possible duplicate: '"), "kx", F.lit("' and '"), "ky", F.lit("' (title similarity "), T.two_digits(F.col("similarity")), F.lit(")"))
    return pairs.select("file", "i", "j", F.lit("WARN").alias("type"), F.lit("duplicate").alias("category"), F.concat("kx", F.lit(" / "), "ky").alias("key"), message.alias("message"))
