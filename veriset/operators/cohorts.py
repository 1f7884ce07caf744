"""Cohorts from components: sanitising, a class-matched control, and a split that keeps components whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriset.operators.shipping import prepare


def _touched(comps: DataFrame) -> DataFrame:
    return comps.where("split = 'test'").select("component").distinct()


def sanitized(comps: DataFrame) -> DataFrame:
    """Training and validation members of components of two or more that hold a test item."""
    large = comps.groupBy("component").count().where("count > 1").select("component")
    return comps.where("split <> 'test'").join(_touched(comps), "component", "left_semi").join(large, "component", "left_semi").select("id", "label", "split")


def size_control(comps: DataFrame) -> DataFrame:
    """As many untouched items per split as sanitising removes, by class as far as they go: the first ones by id.

    Picking from the class that lacks most takes its item of rank rn at a deficit of
    ``k - rn + 1``, k being its quota.  While every class has enough, that ends in the
    first k of each.  A class that runs out leaves a shortage in its split: the others,
    also those without a quota, make it up at deficit 0, then -1 and so on, and classes at
    one deficit follow a hash (the reference draws lots there).  Fewer are taken only
    where a split has no untouched items left.  Orders of a split hold deficits, or the
    classes at the last one; never items.
    """
    quota = sanitized(comps).groupBy("split", F.col("label").alias("c")).agg(F.count(F.lit(1)).alias("k"))
    pool = comps.where("split <> 'test'").join(_touched(comps), "component", "left_anti").select("id", "label", "split")
    rank = F.row_number().over(Window.partitionBy("split", "label").orderBy("id"))
    near = quota.withColumnRenamed("split", "s")
    ranked = pool.withColumn("rn", rank).join(F.broadcast(near), (F.col("split") == F.col("s")) & F.col("label").eqNullSafe(F.col("c")), "left")
    ranked = ranked.select("id", "label", "split", (F.coalesce("k", F.lit(0)) - F.col("rn") + 1).alias("deficit"))
    levels = ranked.groupBy("split", "deficit").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("split").orderBy(F.desc("deficit")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = levels.withColumn("before", before).join(quota.groupBy("split").agg(F.sum("k").alias("k")), "split").select("split", "deficit", "n", (F.col("k") - F.col("before")).alias("room")).where("room > 0")
    whole = ranked.join(room.where("n <= room"), ["split", "deficit"], "left_semi").select("id", "label", "split")
    last = ranked.join(room.where("n > room"), ["split", "deficit"])
    lot = F.row_number().over(Window.partitionBy("split").orderBy(F.md5(F.concat_ws(":", "split", F.col("deficit").cast("string"), F.col("label").cast("string"))), "label"))
    return whole.unionByName(last.withColumn("lot", lot).where("lot <= room").select("id", "label", "split"))


SHARES = {"train": 0.7, "val": 0.1, "test": 0.2}


def assign(groups: pd.DataFrame, shares: dict[str, float] | None = None, trace: list | None = None) -> pd.DataFrame:
    """Groups (``component, size, classes``) to splits: large and rare first, each where the balance suffers least.

    The balance is the mean over classes of the distance of each split's share from its
    target, plus that of all items.  Then, as long as a class of three or more groups
    misses a split, the first such class gets the group whose move costs least, unless
    that would take a class's last group from another split.  At last the best swap of two groups of different
    splits is made, as long as one lowers the balance by more than 1e-12 and leaves no such
    class without a split; equal ones in the order of their components.  Groups of one
    size and the same classes are alike, so only kinds of groups are compared.  ``trace``
    gets a row ``stage, component, other, to, balance`` for every step.
    """
    from bisect import insort

    import numpy as np

    shares = shares or SHARES
    names = list(shares)
    frequency: dict[int, int] = {}
    for cs in groups["classes"]:
        for c in cs:
            frequency[c] = frequency.get(c, 0) + 1
    order = sorted(range(len(groups)), key=lambda g: (-groups["size"].iat[g], min((frequency[c] for c in groups["classes"].iat[g]), default=10**9), groups["component"].iat[g]))
    total = int(groups["size"].sum())
    goal = {c: sum(int(n) for n, cs in zip(groups["size"], groups["classes"], strict=True) if c in cs) for c in frequency}
    held = {s: {c: 0 for c in frequency} for s in names}
    sizes, counts = dict.fromkeys(names, 0), {c: dict.fromkeys(names, 0) for c in frequency}
    place: dict[int, str] = {}

    def cost(g: int, s: str, sign: int) -> float:
        """Change of the balance if group g enters (1) or leaves (-1) split s."""
        n, cs = int(groups["size"].iat[g]), groups["classes"].iat[g]
        out = abs((sizes[s] + sign * n) / total - shares[s]) - abs(sizes[s] / total - shares[s])
        return out + sum(abs((held[s][c] + sign * n) / goal[c] - shares[s]) - abs(held[s][c] / goal[c] - shares[s]) for c in sorted(cs)) / max(1, len(frequency))

    def put(g: int, s: str, sign: int) -> None:
        n = int(groups["size"].iat[g])
        sizes[s] += sign * n
        for c in groups["classes"].iat[g]:
            held[s][c] += sign * n
            counts[c][s] += sign

    now = sum(shares.values()) * (1 + bool(frequency))  # nothing is placed yet

    def note(stage: str, g: int, other: int | None, to: str) -> None:
        if trace is not None:
            trace.append((stage, groups["component"].iat[g], None if other is None else groups["component"].iat[other], to, now))

    for g in order:
        place[g] = min(names, key=lambda s: (round(cost(g, s, 1), 12), names.index(s)))
        now += cost(g, place[g], 1)
        put(g, place[g], 1)
        note("greedy", g, None, place[g])

    def may_leave(g: int) -> bool:
        return all(counts[c][place[g]] > 1 or frequency[c] < 3 for c in groups["classes"].iat[g])

    def move(g: int, s: str) -> None:
        put(g, place[g], -1)
        place[g] = s
        put(g, s, 1)

    def moved(g: int, s: str) -> float:
        """Change of the balance if group g moves to split s."""
        old = place[g]
        gain = cost(g, old, -1)
        put(g, old, -1)
        gain += cost(g, s, 1)
        put(g, old, 1)
        return gain

    for _ in range(3 * len(order)):
        lacks = next(((c, s) for c in sorted(frequency) if frequency[c] >= 3 for s in names if not counts[c][s]), None)
        able = [] if lacks is None else [g for g in order if lacks[0] in groups["classes"].iat[g] and place[g] != lacks[1] and may_leave(g)]
        if not able:
            break
        g = min(able, key=lambda g: (round(moved(g, lacks[1]), 12), groups["component"].iat[g]))
        now += moved(g, lacks[1])
        move(g, lacks[1])
        note("coverage", g, None, lacks[1])
    kinds: dict[tuple, int] = {}
    kind = [kinds.setdefault((int(n), tuple(sorted(set(cs)))), len(kinds)) for n, cs in zip(groups["size"], groups["classes"], strict=True)]
    weight = np.array([n for n, _ in kinds], float)
    has = {c: np.array([c in cs for _, cs in kinds]) for c in frequency}
    key = groups["component"].tolist()
    members: dict[tuple[int, str], list] = {}
    for g in range(len(groups)):
        members.setdefault((kind[g], place[g]), []).append((key[g], g))
    for some in members.values():
        some.sort()

    def balance() -> float:
        out = sum(abs(sizes[s] / total - shares[s]) for s in names)
        for c in sorted(frequency):
            out += sum(abs(held[s][c] / goal[c] - shares[s]) for s in names) / len(frequency)
        return out

    def missed(c: int, a: int = 0, b: int = 0, left: str = "", right: str = "") -> int:
        """Whether a class lacks a split, with a and b groups more in two of them."""
        return int(frequency[c] >= 3 and any(counts[c][s] + (a if s == left else b if s == right else 0) <= 0 for s in names))

    def swaps(left: str, right: str):
        """Kinds in two splits and, in blocks of rows, the change of the balance by each swap; infinite where a class would lack a split."""
        here, there = (np.array(sorted(k for (k, s), some in members.items() if s == x and some), int) for x in (left, right))
        n, m = weight[here], weight[there]
        off = lambda now, of, share, change: np.abs((now + change) / of - share)
        both = lambda now_l, now_r, of, change: off(now_l, of, shares[left], change) + off(now_r, of, shares[right], -change) - abs(now_l / of - shares[left]) - abs(now_r / of - shares[right])
        lacking = sum(missed(c) for c in frequency)
        step = max(1, 2_000_000 // max(1, len(there)))
        for at in range(0, len(here), step):
            part = n[at : at + step]
            delta = both(sizes[left], sizes[right], total, m[None, :] - part[:, None])
            lacks = np.full(delta.shape, lacking)
            for c in sorted(frequency):
                l, r = np.flatnonzero(has[c][here[at : at + step]]), np.flatnonzero(has[c][there])  # noqa: E741
                change = lambda x: both(held[left][c], held[right][c], goal[c], x) / len(frequency)  # noqa: B023, E731
                gone, come = change(-part[l]), change(m[r])
                no, yes = missed(c, -1, 1, left, right) - missed(c), missed(c, 1, -1, left, right) - missed(c)
                delta[l] += gone[:, None]
                delta[:, r] += come
                delta[np.ix_(l, r)] += change(m[r][None, :] - part[l][:, None]) - gone[:, None] - come
                lacks[l] += no
                lacks[:, r] += yes
                lacks[np.ix_(l, r)] -= no + yes
            yield here[at : at + step], there, np.where(lacks == 0, delta, np.inf)

    def swap(g: int, h: int) -> None:
        s, t = place[g], place[h]
        move(g, t)
        move(h, s)

    while True:
        near, least = [], -1e-12
        for i, left in enumerate(names):
            for right in names[i + 1 :]:
                for here, there, delta in swaps(left, right):
                    low = delta.min() if delta.size else np.inf
                    if low < -1e-12:
                        least = min(least, low)
                        x, y = np.nonzero((delta < -1e-12) & (delta <= least + 1e-9))
                        near += [(d, members[k, left][0][1], members[l, right][0][1]) for d, k, l in zip(delta[x, y].tolist(), here[x].tolist(), there[y].tolist(), strict=True)]
        near = [(g, h) for d, g, h in near if d <= least + 1e-9]
        if not near:
            break
        ranked = []
        for g, h in near:
            swap(g, h)
            ranked.append((balance(), *sorted((key[g], key[h])), g, h))
            swap(g, h)
        *_, g, h = min(ranked)
        for x, other in ((g, place[h]), (h, place[g])):
            members[kind[x], place[x]].remove((key[x], x))
            insort(members.setdefault((kind[x], other), []), (key[x], x))
        swap(g, h)
        now = balance()
        note("swap", g, h, place[g])
    return pd.DataFrame({"component": groups["component"].to_numpy(), "new_split": [place[g] for g in range(len(groups))]})


def _groups(comps: DataFrame) -> DataFrame:
    return comps.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_set("label")).alias("classes"))


def resplit(comps: DataFrame) -> DataFrame:
    """``id, component, split, new_split``: every component in one split.

    The sequential search needs all groups of one benchmark in a single task; the
    table of groups (not of items) is what must fit there.
    """
    prepare(comps.sparkSession)
    placed = _groups(comps).coalesce(1).mapInPandas(_solve, "component long, new_split string")
    return comps.join(placed, "component").select("id", "component", "split", "new_split")


def _solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [p for p in parts if len(p)]
    if frames:
        yield assign(pd.concat(frames, ignore_index=True))


def _steps(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [p for p in parts if len(p)]
    if frames:
        trace: list = []
        assign(pd.concat(frames, ignore_index=True), trace=trace)
        out = pd.DataFrame(trace, columns=["stage", "component", "other", "to", "balance"]).astype({"other": "Int64"})
        out.insert(0, "step", range(len(out)))
        yield out


def resplit_trace(comps: DataFrame) -> DataFrame:
    """``step, stage, component, other, to, balance``: every step of the search and the balance after it."""
    prepare(comps.sparkSession)
    return _groups(comps).coalesce(1).mapInPandas(_steps, "step long, stage string, component long, other long, to string, balance double")


def balance(comps: DataFrame, split: str = "split", shares: dict[str, float] | None = None) -> DataFrame:
    """One row ``size_term, class_term, balance``: distances of the splits' shares from their targets, of all items and on average over classes."""
    shares = shares or SHARES
    names = list(shares)
    away = lambda n: sum((F.abs(F.sum((F.col(split) == s).cast("int")) / n - shares[s]) for s in names[1:]), F.abs(F.sum((F.col(split) == names[0]).cast("int")) / n - shares[names[0]]))
    size = comps.agg(away(F.count(F.lit(1))).alias("size_term"))
    # An item counts for every class of its component, as its group moves as a whole.
    held = comps.select("component", "label").distinct().withColumnRenamed("label", "class_id")
    by_class = comps.join(held, "component").groupBy("class_id").agg(away(F.count(F.lit(1))).alias("away"))
    terms = size.join(by_class.agg(F.avg("away").alias("class_term")))  # one row each
    return terms.select(F.round("size_term", 6).alias("size_term"), F.round("class_term", 6).alias("class_term"), F.round(F.col("size_term") + F.col("class_term"), 6).alias("balance"))


def uncovered(comps: DataFrame, split: str = "split", names: tuple[str, ...] = tuple(SHARES), class_col: str = "label", least: int = 3) -> DataFrame:
    """Classes of at least ``least`` components that miss a split: ``class_id, n_groups, splits_present``."""
    found = comps.groupBy(F.col(class_col).alias("class_id")).agg(F.count_distinct("component").alias("n_groups"), F.sort_array(F.collect_set(split)).alias("present"))
    return found.where((F.col("n_groups") >= least) & (F.size("present") < len(names))).select("class_id", "n_groups", F.array_join("present", ",").alias("splits_present"))


def resplit_summary(comps: DataFrame) -> DataFrame:
    """Per split of the corrected benchmark its items and components."""
    return resplit(comps).groupBy("new_split").agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("component").alias("n_groups"))
