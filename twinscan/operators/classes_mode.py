"""Similar classes: fields and methods matched by name, then by type or signature."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.functions import likeness as S
from twinscan.functions.type_text import class_type, loose_signature, overlap_of_words, placeholders, plain_likeness
from twinscan.operators.pairs import salted_join, scope_condition, spread
from twinscan.plans.scratch import cut

PACKED = "uid {id}, n_fields int, n_methods int, bare int, of_fields array<string>, of_methods array<string>, held array<string>, kinds array<string>, packed binary"
CREDIT = "l {id}, r {id}, credit double, members int"
MOST_SUBSETS = 64


def fields(properties) -> dict[str, tuple[str, bool]]:
    """Type and static flag by field name; a repeated name keeps the last."""
    return {p["name"] or "": (p["type_annotation"] or "", bool(p["is_static"])) for p in (properties if properties is not None else [])}


def methods(rows) -> dict[str, tuple]:
    """(signature, loose signature, static, kind, fingerprint) by method name; a repeated name keeps the last."""
    out = {}
    for m in rows if rows is not None else []:
        params = [class_type(p or "") for p in (m["parameters"] if m["parameters"] is not None else [])]
        result = class_type(m["return_type"] or "")
        print_ = m["body_fingerprint"]
        out[m["name"] or ""] = (f"({', '.join(params)}) => {result}", loose_signature(params, result), bool(m["is_static"]), m["kind"], None if print_ is None or print_ != print_ else print_)
    return out


def length_bound(a: str, b: str) -> float:
    """What the likeness of two names cannot exceed, by their lengths."""
    longest = max(len(a), len(b))
    return min(len(a), len(b)) / longest if longest else 1.0


def field_credit(a: dict, b: dict, renamed: list | None = None) -> float:
    """Credit of matched fields, 2 for a full match; ``renamed`` takes the pairs of names matched beyond equal names.

    By name: 2 for equal types (class names aside), else 1.4, times 0.4 if only one is static. Leftovers in
    order of name take the best free partner by 0.8 type + 0.2 name (times 0.4 likewise) from 0.7 on.
    """
    credit, free = 0.0, {n: b[n] for n in sorted(b) if n not in a}
    for n in sorted(a):
        t, static = a[n]
        if n in b:
            same = t == b[n][0] or placeholders(t) == placeholders(b[n][0])
            credit += (2.0 if same else 1.4) * (1.0 if static == b[n][1] else 0.4)
    for n in sorted(set(a) - set(b)):
        t, static = a[n]
        best, top = None, -1.0
        for m, (u, other) in free.items():
            # Only equal types can reach 0.7: another type gives 0.6 of 0.8 at most, and 0.2 for the name.
            scale = 1.0 if static == other else 0.4
            if t != u or (0.8 + 0.2 * length_bound(n, m)) * scale <= max(top, 0.7 - 1e-9):
                continue
            score = (0.8 + 0.2 * plain_likeness(n, m)) * scale
            if score > top:
                best, top = m, score
        if best is not None and top >= 0.7:
            credit += 2.0 * top
            del free[best]
            if renamed is not None:
                renamed.append((n, best))
    return credit


def _agreement(a: tuple, b: tuple) -> float:
    bodies = 0.55 if a[4] is not None and b[4] is not None and a[4] != b[4] else 1.0
    return bodies * (1.0 if a[2] == b[2] else 0.4) * (1.0 if a[3] == b[3] else 0.5)


def method_credit(a: dict, b: dict, renamed: list | None = None) -> float:
    """Credit of matched methods, 2 for a full match, times how far bodies, static and kind agree; ``renamed`` as above.

    By name: 2 for equal signatures, exact or loose, else 1.4. Leftovers in order of name take the best free
    partner by 0.6 signature + 0.4 name from 0.65 on; equal bodies under agreeing signatures count 0.95.
    """
    credit, free = 0.0, {n: b[n] for n in sorted(b) if n not in a}
    for n in sorted(set(a) & set(b)):
        credit += (2.0 if a[n][0] == b[n][0] or a[n][1] == b[n][1] else 1.4) * _agreement(a[n], b[n])
    for n in sorted(set(a) - set(b)):
        best, top = None, -1.0
        for m, other in free.items():
            sign = 1.0 if a[n][0] == other[0] else 0.85 if a[n][1] == other[1] else 0.4 + 0.4 * overlap_of_words(a[n][1], other[1])
            twin = sign >= 0.85 and a[n][4] is not None and a[n][4] == other[4]
            if not twin and 0.6 * sign + 0.4 * length_bound(n, m) <= max(top, 0.65 - 1e-9):
                continue
            score = 0.6 * sign + 0.4 * plain_likeness(n, m)
            if twin:
                score = max(score, 0.95)
            if score > top:
                best, top = m, score
        if best is not None and top >= 0.65:
            credit += 2.0 * top * _agreement(a[n], free[best])
            del free[best]
            if renamed is not None:
                renamed.append((n, best))
    return credit


def class_differences(a: tuple, b: tuple) -> dict[str, list]:
    """What separates two classes, each given as (fields, methods): missing, extra and unequal members.

    Unequal are fields and methods of one name that differ in type or signature, and methods of equal signatures
    that differ in body, static or kind.
    """
    (f, m), (g, n) = a, b
    moved: tuple[list, list] = ([], [])
    field_credit(f, g, moved[0])
    method_credit(m, n, moved[1])
    alike = lambda x, y: x == y or placeholders(x) == placeholders(y)
    same = lambda x, y: (x[0] == y[0] or x[1] == y[1]) and _agreement(x, y) == 1.0
    out = {}
    for what, x, y, renamed in (("properties", f, g, moved[0]), ("methods", m, n, moved[1])):
        out[f"missing_{what}"] = sorted(set(x) - set(y) - {p for p, _ in renamed})
        out[f"extra_{what}"] = sorted(set(y) - set(x) - {q for _, q in renamed})
    out["property_types"] = [(k, f[k][0], g[k][0]) for k in sorted(f) if k in g and not alike(f[k][0], g[k][0])]
    out["method_signatures"] = [(k, m[k][0], n[k][0]) for k in sorted(m) if k in n and not same(m[k], n[k])]
    return out


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for uid, f, m in zip(batch["uid"], batch["properties"], batch["methods"]):
            f, m = fields(f), methods(m)
            prints = {x[4] for x in m.values()} - {None}
            held = [f"f\0{n}" for n in f] + [f"m\0{n}" for n in m] + [f"b\0{x}" for x in prints]
            bare = sum(x[4] is None for x in m.values())
            of_fields = list(f) + _numbered("t", (t for t, _ in f.values()))
            rows.append((uid, len(f), len(m), bare, of_fields, list(m) + _numbered("s", (x[1] for x in m.values())), held, _numbered("k", (f"{t}\0{s}" for t, s in f.values())), pickle.dumps((f, m))))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])


def _numbered(mark: str, values: Iterator[str]) -> list[str]:
    """The values with the number of their occurrence: what two multisets share is what these share."""
    seen: dict[str, int] = {}
    out = []
    for v in values:
        seen[v] = seen.get(v, 0) + 1
        out.append(f"{mark}\0{v}\0{seen[v]}")
    return out


def _credits(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, known = [], {}
        for l, r, a, b in zip(batch["l"], batch["r"], batch["a"], batch["b"]):
            for uid, data in ((l, a), (r, b)):
                if uid not in known:
                    known[uid] = pickle.loads(data)
            (f, m), (g, n) = known[l], known[r]
            members = len(f) + len(g) + len(m) + len(n)
            credit = field_credit(f, g)
            if credit + 2 * min(len(m), len(n)) < least * members - 1e-9:
                continue
            rows.append((l, r, credit + method_credit(m, n), members))
        yield pd.DataFrame(rows, columns=["l", "r", "credit", "members"])


def _may_reach(credit: Column, total: Column, l: str, r: str, threshold: float) -> Column:
    """Whether the score can reach the threshold with at most ``credit`` of ``total`` members, given the classes' names."""
    naming = S.name_likeness(F.col(f"{l}.name"), F.col(f"{r}.name"))
    return (credit >= F.least(F.lit(1.0), (threshold - 0.15 * naming) / 0.85) * total - 1e-9) | (total == 0)


def _strange(a: str, b: str) -> Column:
    """The most that the methods of two classes can count if they share no name and no body.

    Two methods that both have a body then have different ones, which takes the match to 0.55.
    """
    most = F.least(f"{a}.m", f"{b}.m")
    free = F.least(most, F.col(f"{a}.bare") + F.col(f"{b}.bare"))
    return 2.0 * free + 1.1 * (most - free)


def _candidates(sized: DataFrame, threshold: float, least: float, scope: str) -> DataFrame:
    """Pairs (l, r) of class ids, l < r, that may reach the threshold.

    Classes that have a field name, a method name or a method body in common meet by it. For two without, a field
    match needs equal types and static flags, and methods count little if they have bodies. So the numbers of fields,
    methods and methods without body of both say how many typed fields k they share at least, and how many of the
    rarest hold the first j of these: n - k + j of n. They meet by each set of j among those, j being as large as
    MOST_SUBSETS allows; where k is 0, all classes of such numbers meet.
    """
    size = F.struct(F.col("n_fields").alias("f"), F.col("n_methods").alias("m"), "bare").alias("g")
    slim = F.struct("uid", "file_path", "name", size).alias("u")
    in_scope = scope_condition(scope, F.col("l.file_path"), F.col("r.file_path"))
    total = F.col("l.g.f") + F.col("l.g.m") + F.col("r.g.f") + F.col("r.g.m")

    held = cut(sized.select(F.explode("held").alias("key"), slim), "held")
    known = salted_join(held.withColumnRenamed("u", "l"), held.withColumnRenamed("u", "r"), ["key"]).where((F.col("l.uid") < F.col("r.uid")) & in_scope)
    known = known.where(_may_reach(2 * (F.least("l.g.f", "r.g.f") + F.least("l.g.m", "r.g.m")), total, "l", "r", threshold))

    tokens = sized.select("uid", F.explode("kinds").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rarest = tokens.join(frequency, "token").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    none = F.array().cast("array<bigint>")
    classes = cut(sized.select(slim, size, "uid").join(rarest.select("uid", F.col("t.token").alias("kinds")), "uid", "left").select("u", "g", F.coalesce("kinds", none).alias("kinds")), "kinds")

    groups = classes.select("g").distinct()
    plans = groups.crossJoin(groups.withColumnRenamed("g", "h")).where("g <= h")
    members = F.col("g.f") + F.col("g.m") + F.col("h.f") + F.col("h.m")
    k = F.greatest(F.lit(0), F.ceil((least * members - _strange("g", "h")) / 2 - 1e-9)).cast("int")
    plans = plans.withColumn("k", k).where(F.col("k") <= F.least("g.f", "h.f"))
    spare, ways = F.greatest("g.f", "h.f") - F.col("k"), F.lit(1)
    j = F.least(F.col("k"), F.lit(1))
    for i in range(1, 5):
        ways = ways * (spare + i) / i  # sets of i among the spare + i rarest
        j = F.when((F.col("k") >= i) & (ways <= MOST_SUBSETS), i).otherwise(j)
    plans = cut(plans.withColumn("j", j), "plans")

    def side(group: str, name: str) -> DataFrame:
        rows = classes.withColumnRenamed("g", "of").join(plans.withColumn("of", F.col(group)), "of")
        among = F.slice("kinds", F.lit(1), F.col("of.f") - F.col("k") + F.col("j"))
        grown = F.aggregate(among, F.array(none), lambda acc, x: F.concat(acc, F.transform(F.filter(acc, lambda s: F.size(s) < F.col("j")), lambda s: F.concat(s, F.array(x)))))
        subsets = F.filter(grown, lambda s: F.size(s) == F.col("j"))
        return cut(rows.select(F.explode(subsets).alias("subset"), F.xxhash64("g", "h").alias("plan"), F.col("u").alias(name)).select(F.xxhash64("plan", "subset").alias("key"), name), "sides")

    once = (F.col("l.g") != F.col("r.g")) | (F.col("l.uid") < F.col("r.uid"))
    other = salted_join(side("g", "l"), side("h", "r"), ["key"]).where(once & in_scope)
    other = other.where(_may_reach(2 * F.least("l.g.f", "r.g.f") + _strange("l.g", "r.g"), total, "l", "r", threshold))
    met = known.unionByName(other.select("key", "l", "r"))
    return met.select(F.least("l.uid", "r.uid").alias("l"), F.greatest("l.uid", "r.uid").alias("r")).distinct()


def similar_classes(units: DataFrame, threshold: float = 0.8, scope: str = "all") -> DataFrame:
    """Pairs of classes at or above ``threshold``: l, r (uid), score, structural_score, naming_score.

    ``units``: uid, file_path, name, extends_name, implements_names, properties, methods. The structure is the
    credit over all members, at most 1; two classes without members get 0.85 if their heritage agrees, else
    0.3. The ignore directive has no effect on classes. A null name is empty, null members are none.

    A score needs a structure of (threshold - 0.15) / 0.85, or more where the classes' names differ; how candidates
    are found without meeting every class of near size is told at ``_candidates``.
    """
    least = min(1.0, max(0.0, (threshold - 0.15) / 0.85))
    id_type = units.schema["uid"].dataType.simpleString()
    rows = units.select("uid", "file_path", F.coalesce("name", F.lit("")).alias("name"), "extends_name", F.coalesce("implements_names", F.array().cast("array<string>")).alias("implements_names"), "properties", "methods")
    # Normalised and packed once a class: a pair then moves two byte strings, and a task unpacks each class once a batch.
    packed = cut(rows.select("uid", "properties", "methods").mapInPandas(_packed, PACKED.format(id=id_type)), "classes")
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x)).alias(c)
    sized = packed.select("uid", "n_fields", "n_methods", "bare", hashed("of_fields"), hashed("of_methods"), hashed("held"), hashed("kinds")).join(rows.select("uid", "file_path", "name"), "uid")
    sized = cut(sized, "sized")
    whole = sized.select("uid", F.struct("n_fields", "n_methods", "of_fields", "of_methods", "name").alias("u"))
    pairs = _candidates(sized, threshold, least, scope).join(whole.toDF("l", "a"), "l").join(whole.toDF("r", "b"), "r")
    # A field match shares its name or its type; so does a method match its name or signature, or it is worth 0.88 at
    # most. Both are told by hashes before the packed members are moved.
    few, most = F.least("a.n_fields", "b.n_fields"), F.least("a.n_methods", "b.n_methods")
    sure = F.least(most, F.size(F.array_intersect("a.of_methods", "b.of_methods")))
    bound = 2 * F.least(few, F.size(F.array_intersect("a.of_fields", "b.of_fields"))) + 2 * sure + 1.76 * (most - sure)
    total = F.col("a.n_fields") + F.col("b.n_fields") + F.col("a.n_methods") + F.col("b.n_methods")
    pairs = spread(pairs.where(_may_reach(bound, total, "a", "b", threshold)).select("l", "r"))
    a, b = packed.select(F.col("uid").alias("l"), F.col("packed").alias("a")), packed.select(F.col("uid").alias("r"), F.col("packed").alias("b"))
    slim = pairs.join(a, "l").join(b, "r").select("l", "r", "a", "b")
    credit = slim.mapInPandas(lambda it: _credits(it, least), CREDIT.format(id=id_type))
    info = rows.select("uid", "name", "extends_name", "implements_names")
    out = credit.join(info.toDF("l", "lname", "lext", "limp"), "l").join(info.toDF("r", "rname", "rext", "rimp"), "r")
    heritage = F.col("lext").eqNullSafe(F.col("rext")) & (F.col("limp") == F.col("rimp"))
    structure = F.when(F.col("members") > 0, F.least(F.lit(1.0), F.col("credit") / F.col("members"))).when(heritage, 0.85).otherwise(0.3)
    out = out.withColumns({"structural_score": structure, "naming_score": S.name_likeness(F.col("lname"), F.col("rname"))})
    return out.withColumn("score", S.weighted(F.col("structural_score"), F.col("naming_score"))).where(F.col("score") >= threshold).select("l", "r", "score", "structural_score", "naming_score")
