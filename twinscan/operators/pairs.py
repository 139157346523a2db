"""Candidate pairs of units without a nested loop over all of them.

Every scorer here can only reach a threshold if something is shared, and that is made an equality Spark can
shuffle on: a size ratio becomes neighbouring logarithmic bands, a least overlap of tokens becomes a shared
token among each unit's rarest ones. The exact predicate stays as a residual, so no pair is lost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscan.functions.likeness import property_name_likeness
from twinscan.plans.scratch import cut, release

SCOPES = ("all", "same_file", "cross_file")


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows over enough tasks for work that costs far more than moving them.

    Adaptive execution sizes partitions by bytes and would score a million id pairs in one task.
    """
    spark = df.sparkSession
    return df.repartition(tasks or max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


MOST_HOT = 10_000
BUCKETS = 1 << 16


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", rows_per_salt: int = 5_000) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, with the keys that fill much of ``left`` split.

    A key with more than ``rows_per_salt`` rows on the left is hot: its left rows get a salt from their hash, its right
    rows are repeated for every salt, and each salt is a join key of its own. Rows are first counted by BUCKETS hashes of
    the keys, which shuffles next to nothing, and only keys in full buckets (more than ``rows_per_salt`` rows and twice
    the mean) one by one. The list of the MOST_HOT heaviest is broadcast; what it leaves out has less than 2 / BUCKETS or
    1 / MOST_HOT of all rows, and none has more than MOST_HOT salts, so the list and the repeats are bounded whatever
    the data. ``left`` is read three times. ``how`` is inner or left.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("__bucket")
    full = left.groupBy(bucket).agg(F.count(F.lit(1)).alias("__c")).withColumn("__mean", F.sum("__c").over(Window.partitionBy()) / BUCKETS)  # at most BUCKETS rows
    full = F.broadcast(full.where((F.col("__c") > rows_per_salt) & (F.col("__c") > 2 * F.col("__mean"))).select("__bucket"))
    counts = left.select(*keys, bucket).join(full, "__bucket", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_salt)
    most = F.least(F.ceil(F.col("__n") / rows_per_salt), F.lit(MOST_HOT)).cast("int").alias("__salts")
    hot = F.broadcast(counts.orderBy(F.desc("__n"), *keys).limit(MOST_HOT).select(*keys, most))
    salts = F.coalesce("__salts", F.lit(1))
    a = left.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("__salts")
    b = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return a.join(b, [*keys, "__salt"], how).drop("__salt")


def scope_condition(scope: str, left: Column, right: Column) -> Column:
    """Whether a pair of files is in scope."""
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}, not {scope!r}")
    return {"all": F.lit(True), "same_file": left == right, "cross_file": left != right}[scope]


def band_pairs(units: DataFrame, uid: str, size: str, ratio: float, extra: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """Pairs (l, r) of ``units`` rows as structs with l.uid < r.uid and least size >= ratio * greatest size.

    If the ratio holds, the sizes' logarithms differ by at most ln(1 / ratio), so with bands of that width
    the band numbers differ by at most one: one side is repeated for three bands and the join is an
    equality. Sizes of 0 pair with each other only. ``keys`` are further equalities, for example the file;
    ``extra`` is a residual over columns l.* and r.*. Null sizes never pair.
    """
    if not 0 <= ratio <= 1:
        raise ValueError("the ratio must lie between 0 and 1")
    width = max(math.log(1 / ratio) if ratio > 0 else 0.0, 1e-6) * (1 + 1e-9)
    whole = F.struct(*units.columns)
    n = F.col(size)
    rows = units.where(n.isNotNull()).select(whole.alias("u"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys or [])), F.when(n > 0, F.floor(F.log(n) / width)).otherwise(-1_000_000).alias("__b"))
    names = [f"__k{i}" for i in range(len(keys or []))]
    l = rows.select(F.col("u").alias("l"), "__b", *names)
    if ratio > 0:
        near = F.when(F.col("__b") == -1_000_000, F.array(F.col("__b"))).otherwise(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1))
        r = rows.select(F.col("u").alias("r"), F.explode(near).alias("__b"), *names)
    else:  # every size pairs with every other: only the further equalities remain
        l = l.withColumn("__b", F.lit(0))
        r = rows.select(F.col("u").alias("r"), F.lit(0).alias("__b"), *names)
    a, b = F.col(f"l.{size}"), F.col(f"r.{size}")
    cond = (F.col(f"l.{uid}") < F.col(f"r.{uid}")) & (F.least(a, b) >= F.lit(ratio) * F.greatest(a, b))
    return salted_join(l, r, ["__b", *names]).where(cond & extra if extra is not None else cond).select("l", "r")


def overlap_pairs(tokens: DataFrame, sizes: DataFrame, least_share: float, least_ratio: float | None = None, residual: Column | None = None) -> DataFrame:
    """Pairs (l, r) of unit ids, l < r, that may share ``least_share`` of their mean token count.

    ``tokens``(uid, token) holds each unit's distinct tokens, ``sizes``(uid, n, other columns) their number. If two
    units share at least k tokens, each has one of them among its n - k + 1 rarest; the bound on k uses the smallest
    partner the share allows, or ``least_ratio`` of sizes where the caller knows a better one. Rare tokens are the
    join keys, so frequent ones rarely meet, and hot ones are split. ``residual`` is a condition over l.* and r.* (uid and
    the columns of ``sizes``).
    """
    ratio = max(least_share / (2 - least_share), least_ratio or 0.0)
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    need = F.ceil(least_share * (F.col("n") + F.col("n") * ratio) / 2 - 1e-9)
    ranked = tokens.join(frequency, "token").join(sizes, "uid").withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy("df", "token")))
    prefix = cut(ranked.where(F.col("rank") <= F.col("n") - F.greatest(need, F.lit(1)) + 1).select("token", F.struct("uid", *(c for c in sizes.columns if c != "uid")).alias("u")), "prefix")
    met = salted_join(prefix.withColumnRenamed("u", "l"), prefix.withColumnRenamed("u", "r"), ["token"])
    met = met.where((F.col("l.uid") < F.col("r.uid")) & (F.least("l.n", "r.n") >= ratio * F.greatest("l.n", "r.n") - 1e-9))
    met = met.where(residual) if residual is not None else met
    return met.select(F.col("l.uid").alias("l"), F.col("r.uid").alias("r")).distinct()


def edit_pairs(names: DataFrame, name: str, least: float) -> DataFrame:
    """Pairs (l, r) of distinct ``names`` rows as structs, l.name < r.name, whose edit ratio over characters may reach ``least``.

    One edit changes two of a padded name's pairs of neighbouring letters. Two names of at most m letters that differ
    in (1 - least) * m edits therefore share m + 1 - 2 * edits of them, so each has a shared one among its rarest:
    names meet by rare pairs of letters instead of by length. A residual checks the lengths; the caller checks the ratio.
    """
    whole = F.struct(*names.columns)
    padded = F.concat(F.lit("\x01"), F.col(name), F.lit("\x01"))
    n = F.char_length(F.col(name))
    grams = names.select(whole.alias("u"), n.alias("n"), F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.substring(padded, i, F.lit(2))).alias("g"))
    numbered = F.transform(F.sequence(F.lit(1), F.size("g")), lambda i: F.concat(F.element_at("g", i), F.size(F.filter(F.slice("g", F.lit(1), i), lambda x: x == F.element_at("g", i))).cast("string")))
    held = grams.select("u", "n", F.explode(numbered).alias("token"))
    frequency = held.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    need = F.greatest(F.lit(1), 1 + F.ceil(F.col("n") * max(0.0, 2 * least - 1) - 1e-9))
    place = F.row_number().over(Window.partitionBy(F.col(f"u.{name}")).orderBy("df", "token"))
    prefix = cut(held.join(frequency, "token").withColumn("place", place).where(F.col("place") <= F.col("n") + 2 - need).select("token", "u"), "grams")
    met = salted_join(prefix.withColumnRenamed("u", "l"), prefix.withColumnRenamed("u", "r"), ["token"])
    a, b = F.char_length(F.col(f"l.{name}")), F.char_length(F.col(f"r.{name}"))
    return met.where((F.col(f"l.{name}") < F.col(f"r.{name}")) & (F.least(a, b) >= least * F.greatest(a, b) - 1e-9)).select("l", "r").distinct()


MOST_BYTES = 64


def close_names(names: DataFrame, least: float) -> DataFrame:
    """Pairs (l, r) of distinct non-null ``name`` values, l < r, whose ``property_name_likeness`` is at least ``least``.

    Names equal but for case and outer blanks meet as such. Of two others the one of more bytes, b, allows d =
    (1 - least) * b edits; cut into d + 1 segments, one segment at least stands unchanged in the other name, moved by
    no more than the edits left and right of it allow (Li et al., Pass-Join). So names meet by segments and places, not
    by length. ``least`` must exceed 0.75: then no name has fewer characters than segments. Names of more than
    MOST_BYTES would have too many places: they meet all names of near length.
    """
    if not 0.75 < least <= 1:
        raise ValueError("the least likeness must lie above 0.75 and not above 1")
    spelled = names.select("name", F.trim(F.lower("name")).alias("x"))
    a, b = spelled.toDF("l", "x"), spelled.toDF("r", "x")
    alike = property_name_likeness(F.col("l"), F.col("r")) >= least
    pairs = salted_join(a, b, ["x"]).where((F.col("l") < F.col("r")) & alike).select("l", "r")
    edits = F.floor((1 - least) * F.octet_length("x") + 1e-6).cast("int")
    forms = cut(spelled.select("x").distinct().where("x <> ''").select("x", F.char_length("x").alias("n"), F.octet_length("x").alias("b"), edits.alias("d")), "forms")
    short = forms.where(F.col("b") <= MOST_BYTES)

    groups = short.select("n", "d").distinct()  # few: both are bounded by MOST_BYTES
    k, base = F.col("d") + 1, F.floor(F.col("n") / (F.col("d") + 1)).cast("int")
    i, spare = F.col("i"), F.col("d") + 1 - (F.col("n") - base * k)  # the segments after the first ``spare`` ones are longer by one
    segments = groups.where("d > 0").withColumn("i", F.explode(F.sequence(F.lit(1), k))).withColumn("size", (base + (i > spare).cast("int"))).withColumn("at", (i - 1) * base + F.greatest(F.lit(0), i - 1 - spare) + 1)
    moved = F.col("m") - F.col("n")
    low = F.greatest(F.lit(1), F.col("at") - (i - 1), F.col("at") + moved - (k - i))
    high = F.least(F.col("m") - F.col("size") + 1, F.col("at") + (i - 1), F.col("at") + moved + (k - i))
    places = segments.crossJoin(F.broadcast(groups.toDF("m", "e"))).where((F.abs(moved) <= F.col("d")) & (F.col("e") <= F.col("d")) & (low <= high)).withColumn("p", F.explode(F.sequence(low, high)))
    index = short.join(F.broadcast(segments), ["n", "d"]).select("n", "d", "i", F.expr("substring(x, at, size)").alias("segment"), F.struct("x", "b").alias("y"))
    probes = short.select("x", "b", F.col("n").alias("m"), F.col("d").alias("e")).join(F.broadcast(places), ["m", "e"]).select("n", "d", "i", F.expr("substring(x, p, size)").alias("segment"), F.struct("x", "b").alias("z"))
    smaller = F.struct("z.b", "z.x") < F.struct("y.b", "y.x")
    met = salted_join(index, probes, ["n", "d", "i", "segment"]).where(smaller).select(F.col("z.x").alias("x"), F.col("y.x").alias("y"))

    width = math.log(1 / (4 * least - 3)) * (1 + 1e-9) + 1e-6  # an edit takes four bytes at most
    band = F.floor(F.log("b") / width)
    longer = forms.where(F.col("b") > MOST_BYTES).select(F.explode(F.array(band - 1, band)).alias("band"), F.struct("x", "b", "n", "d").alias("y"))
    far = salted_join(longer, forms.select(band.alias("band"), F.struct("x", "b", "n").alias("z")), ["band"])
    far = far.where(smaller & (F.abs(F.col("y.n") - F.col("z.n")) <= F.col("y.d"))).select(F.col("z.x").alias("x"), F.col("y.x").alias("y"))

    near = met.unionByName(far).where(property_name_likeness(F.col("x"), F.col("y")) >= least).distinct()
    both = near.join(a, "x").drop("x").join(b.withColumnRenamed("x", "y"), "y")
    return pairs.unionByName(both.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")))


def exact_classes(units: DataFrame, uid: str, key: Column) -> DataFrame:
    """(uid, class_id): units of equal key get the smallest uid among them; a null key is its own class."""
    rows = units.select(F.col(uid).alias("uid"), F.xxhash64(key).alias("__h"), key.alias("__key"))
    least = rows.where("__key is not null").groupBy("__h", "__key").agg(F.min("uid").alias("class_id"))
    return rows.join(least, ["__h", "__key"], "left").select("uid", F.coalesce("class_id", "uid").alias("class_id"))


def without_contained(ranges: DataFrame, group: list[str], rank: str) -> DataFrame:
    """Ranked range pairs that lie in no better-ranked range pair of their group.

    Columns s1, e1, s2, e2 and ``rank`` (1 is best). Containment is transitive, so keeping a row unless any
    earlier row contains it equals the greedy pass that compares with kept rows only.
    """
    a, b = ranges.alias("a"), ranges.alias("b")
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    inside = (F.col("b.s1") <= F.col("a.s1")) & (F.col("a.e1") <= F.col("b.e1")) & (F.col("b.s2") <= F.col("a.s2")) & (F.col("a.e2") <= F.col("b.e2"))
    cond = inside & (F.col(f"b.{rank}") < F.col(f"a.{rank}"))
    for c in same:
        cond &= c
    return a.join(b, cond, "left_anti")


def subset_pairs(sets: DataFrame, keys: list[str], size: str | None = None, ratio: float = 0.0) -> DataFrame:
    """Pairs (l, r) of ids, l < r, of which one's tokens all belong to the other's.

    ``sets``(uid, tokens array, keys..., other columns); ``keys`` must agree. If A is within B, B holds A's rarest
    token, so each set joins by that one token with the sets that hold it; sets without tokens join with all sets of
    their keys. With ``size``, pairs of sizes below ``ratio`` drop out, and bands of the size's logarithm are a
    further key, so that sets without tokens meet those of about their size only. Hot keys are split.
    """
    tokens = sets.select("uid", F.explode(F.array_distinct("tokens")).alias("token"))
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rarest = tokens.join(frequency, "token").groupBy("uid").agg(F.min(F.struct("df", "token")).alias("m")).select("uid", F.col("m.token").alias("__token"))
    everything, band, near = F.lit("\0"), F.lit(0), F.array(F.lit(0))
    if size is not None and ratio > 0:
        width = max(math.log(1 / ratio), 1e-6) * (1 + 1e-9)
        band = F.when(F.col(size) > 0, F.floor(F.log(size) / width)).otherwise(-1_000_000).cast("int")
        near = F.array(band - 1, band, band + 1)
    slim = F.struct("uid", "tokens", *([size] if size else []))
    small = sets.join(rarest, "uid", "left").select(slim.alias("a"), F.coalesce("__token", everything).alias("__token"), F.explode(near).alias("__band"), *keys)
    large = sets.select(slim.alias("b"), F.explode(F.concat(F.array_distinct("tokens"), F.array(everything))).alias("__token"), band.alias("__band"), *keys)
    met = salted_join(large, small, ["__token", "__band", *keys]).where((F.col("a.uid") != F.col("b.uid")) & (F.size(F.array_except("a.tokens", "b.tokens")) == 0))
    if size is not None:
        met = met.where(F.least(f"a.{size}", f"b.{size}") >= ratio * F.greatest(f"a.{size}", f"b.{size}"))
    return met.select(F.least("a.uid", "b.uid").alias("l"), F.greatest("a.uid", "b.uid").alias("r")).distinct()


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """Pairs taken best first, each unit at most once: a matching, not a clustering.

    ``pairs``(l, r, score, other columns), ids of one type; ties in order of l, then r. A pair that is the best of both its units is
    what the sequential pass would take too, so each round takes all such pairs and drops those that touch a taken
    unit. Every round takes at least the best pair left, and in expectation a constant share of all.
    """
    left = cut(pairs, "matching")
    taken: DataFrame | None = None
    while not left.isEmpty():
        place = F.struct((-F.col("score")).alias("s"), F.col("l").alias("l"), F.col("r").alias("r"))
        ends = left.select(F.explode(F.array("l", "r")).alias("unit"), place.alias("place"))
        best = ends.groupBy("unit").agg(F.min("place").alias("best"))
        mutual = best.groupBy("best").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.col("best.l").alias("l"), F.col("best.r").alias("r"))
        new = cut(left.join(mutual, ["l", "r"], "left_semi"), "taken")
        used = new.select(F.explode(F.array("l", "r")).alias("unit"))
        rest = cut(left.join(used.withColumnRenamed("unit", "l"), "l", "left_anti").join(used.withColumnRenamed("unit", "r"), "r", "left_anti").select(pairs.columns), "matching")
        release(left)
        taken, left = new if taken is None else taken.unionByName(new), rest
    return taken if taken is not None else left
