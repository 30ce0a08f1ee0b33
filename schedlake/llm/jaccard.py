"""N-gram Jaccard join: families of sets that share rare shingles, split by pivots into Voronoi regions, joined exactly.

Unrelated texts all lie at distance 1 from each other and from any pivot, where the triangle inequality prunes nothing.
So sets that can have no partner are told apart first, and the others fall into families, by a prefix argument that
loses no link. Within a family distances differ, and it is joined as a metric space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from schedlake.llm.graph import components
from schedlake.llm.shared import Scratch, bind, lower_ascii, split_words, written

SHINGLE, PERCENT = 4, 85
PIVOTS = 16
#: Members this close to their nearest pivot live in its region. With the distance of a link added it stays below 1,
#: where unrelated sets lie. ``SLACK`` covers rounding.
CORE, SLACK = 0.5, 1e-9
#: Regions up to this size are compared member by member, where members share a rare shingle.
LEAF = 192
#: Members and shingles of a family that one task joins; larger ones are split by tables first.
TASK_MEMBERS, TASK_SHINGLES = 32_768, 4_000_000
#: Holders of a shingle up to which shared shingles are counted for pairs.
FEW = 48
#: Levels of splitting, in a task and as tables; what is then still too large is probed, or compared in pairs of blocks.
LEVELS = 3
#: Shingles of a level's pivots that are sent to all tasks; beyond, members are joined to them by region.
MOST_PIVOT_SHINGLES = 1_000_000
#: Sets of candidates whose keys are sent to the scans instead of shuffling the texts.
BROADCAST_ROWS = 500_000


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """The sorted distinct 64-bit hashes of ``n`` consecutive words; of all words, if there are fewer."""
    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(n))))
        return F.when(F.size(w) >= n, F.sort_array(F.array_distinct(each))).when(
            F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return bind(split_words(lower_ascii(F.coalesce(text, F.lit("")))), of)


def spare(n: Column, percent: int) -> Column:
    """Shingles of a set of ``n`` that a linked set may lack."""
    return n - F.floor((n * percent + 99) / 100).cast("int")


def spread(n: Column) -> Column:
    """Shingles in a prefix beyond the spare ones: more for small sets, which cost little; never falling in ``n``."""
    return F.greatest(F.lit(1), F.floor(n / 20), F.least(F.floor(n / 4), F.lit(50))).cast("int")


def needed(n: Column, percent: int) -> Column:
    """Shingles that linked sets share within their prefixes, see ``prefix``; for the smallest partner of ``n``."""
    return spread(F.floor((n * percent + 99) / 100))


def prefix(shingle_set: Column, percent: int) -> Column:
    """The first ``spare + spread`` shingles by hash: linked sets share at least ``needed`` of them."""
    n = F.size(shingle_set)
    length = spare(n, percent) + spread(n)
    return F.transform(F.slice(shingle_set, F.lit(1), length), lambda x: F.shiftrightunsigned(x, 16))


def _families(rows: DataFrame, percent: int) -> DataFrame:
    """``rid, family`` of the sets that may be linked to another one; every link lies within a family.

    ``rows`` has one row per distinct set: ``rid, n, p`` (its prefix). Shingles that no other prefix has come first in
    the order, then rarer before more frequent ones. A set keeps the first ``len(p) - needed + 1``; by the prefix
    argument linked sets have one of these in common. A set all of whose kept shingles are its own is linked to nothing.
    The holders of a kept shingle with more than ``FEW`` of them are one family, if they hold enough frequent ones.
    Otherwise shared shingles are counted for pairs, of which a set has at most ``FEW`` for each shingle, and pairs that
    share too few are no links.
    """
    each = rows.select("rid", F.explode("p").alias("x"))
    shared = each.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = written(each.join(shared, "x"), "shared-shingles")
    counts = held.groupBy("rid").agg(F.count(F.lit(1)).alias("held"), F.count(F.when(F.col("df") > FEW, 1)).alias("often"))
    least = needed(F.col("n"), percent)
    able = rows.select("rid", least.alias("needed"), (F.size("p") - least + 1).alias("keep"), F.size("p").alias("len")).join(
        counts, "rid").select("rid", "needed", "often", (F.col("keep") - (F.col("len") - F.col("held"))).alias("room"))
    able = written(able.where("room > 0"), "possible-members")
    ranked = held.join(able, "rid").withColumn("k", F.row_number().over(W.partitionBy("rid").orderBy("df", "x")))
    # a pair without a counted shingle shares frequent ones only, so both sets hold enough of them
    many = ranked.where((F.col("k") <= F.col("room")) & (F.col("df") > FEW) & (F.col("often") >= F.col("needed")))
    often = written(many.select("rid", "x"), "frequent-shingles")
    leaders = often.groupBy("x").agg(F.min("rid").alias("leader"))
    edges = often.join(leaders, "x").select(F.col("rid").alias("a"), F.col("leader").alias("b"))
    holders = held.where(F.col("df") <= FEW).join(able, "rid").groupBy("x").agg(
        F.sort_array(F.collect_list(F.struct("rid", "needed", "often"))).alias("h")).where(F.size("h") > 1)
    one = holders.select("h", F.posexplode("h").alias("i", "a"))
    pairs = one.select("a", F.explode(F.slice("h", F.col("i") + 2, FEW)).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    enough = F.col("c") + F.least("a.often", "b.often") >= F.greatest("a.needed", "b.needed")
    edges = edges.union(pairs.where(enough).select("a.rid", "b.rid"))
    return components(edges).select(F.col("node").alias("rid"), F.col("component").alias("family"))


class Space:
    """Shingle sets of one region in memory, with distances to any member."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        _, self.tokens = np.unique(np.concatenate(sets), return_inverse=True)
        self.flags = np.zeros(int(self.tokens.max()) + 1, np.int32)
        self.root = np.arange(len(sets))

    def shared(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of a member with others."""
        own = self.tokens[self.starts[pivot]:self.starts[pivot + 1]]
        self.flags[own] = 1
        if len(members) == len(self.sizes):
            out = np.add.reduceat(self.flags[self.tokens], self.starts[:-1])
        else:
            sizes = self.sizes[members]
            ends = np.cumsum(sizes)
            at = np.repeat(self.starts[members] - (ends - sizes), sizes) + np.arange(ends[-1])
            out = np.add.reduceat(self.flags[self.tokens[at]], ends - sizes)
        self.flags[own] = 0
        return out

    def compare(self, pivot: int, members: np.ndarray, percent: int) -> np.ndarray:
        """Distances to a member; links that are found are kept."""
        both = self.shared(pivot, members)
        union = self.sizes[members] + self.sizes[pivot] - both
        linked = members[100 * both >= percent * union].astype(np.int64)
        roots = np.unique(self.root[np.append(linked, pivot)])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]
        return 1 - both / union

    def join(self, members: np.ndarray, percent: int, level: int = 0) -> None:
        """Finds the links among ``members``, up to known connections."""
        if (self.root[members] == self.root[members[0]]).all():
            return
        if len(members) <= LEAF or level > LEVELS:
            self.probe(members, percent)
            return
        pivots = np.random.default_rng(level).choice(members, PIVOTS, replace=False)
        far = np.stack([self.compare(p, members, percent) for p in pivots])
        regions = list(voronoi(far, 1 - percent / 100))
        if sum(inside.sum() for inside in regions) > 2 * len(members):  # these pivots tell too little apart
            self.probe(members, percent)
            return
        for inside in regions:
            self.join(members[inside], percent, level + 1)


    def probe(self, members: np.ndarray, percent: int) -> None:
        """Compares members that share one of their rarest shingles here, of which a link needs one."""
        sizes = self.sizes[members]
        owner = np.repeat(np.arange(len(members)), sizes)
        ends = np.cumsum(sizes)
        token = self.tokens[np.repeat(self.starts[members] - (ends - sizes), sizes) + np.arange(ends[-1])]
        times = np.bincount(token)
        order = np.lexsort((token, times[token], owner))
        rank = np.arange(len(order)) - np.repeat(ends - sizes, sizes)
        kept = (rank <= np.repeat(sizes - -(-sizes * percent // 100), sizes)) & (times[token[order]] > 1)
        token, owner = token[order][kept], owner[order][kept]
        by_token = np.lexsort((owner, token))
        held = owner[by_token]
        begin, end = np.searchsorted(token[by_token], token, "left"), np.searchsorted(token[by_token], token, "right")
        first = np.searchsorted(owner, np.arange(len(members) + 1))
        for i in range(len(members)):
            lists = [held[a:b] for a, b in zip(begin[first[i]:first[i + 1]], end[first[i]:first[i + 1]]) if b - a > 1]
            if not lists:
                continue
            found = np.unique(np.concatenate(lists))
            found = found[found > i]
            alike = (100 * sizes[found] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[found])
            others = members[found[alike]]
            others = others[self.root[others] != self.root[members[i]]]
            if len(others):
                self.compare(members[i], others, percent)


def voronoi(far: np.ndarray, reach: float) -> Iterator[np.ndarray]:
    """Members of each region, from distances ``[pivot, member]``; every link lies within one region at least.

    A member within ``CORE`` of its nearest pivot lives in that pivot's region, others in the outer one. A link from a
    member x of region p to y means d(y, p) <= CORE + reach, and d(y, p) <= d(y, own pivot of y) + 2 reach if y has
    a region, so y is a guest of p in these cases only. Links between two outer members are found in the outer region.
    """
    near, nearest = far.min(axis=0), far.argmin(axis=0)
    lives = np.where(near <= CORE, nearest, -1)
    window = np.where(lives >= 0, np.minimum(CORE + reach, near + 2 * reach), CORE + reach) + SLACK
    for p in range(len(far)):
        if (lives == p).any():
            yield (lives == p) | (far[p] <= window)
    if (lives == -1).any():
        yield lives == -1


def _joined(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Links of the regions of a bucket as edges to the smallest connected member."""
    for frame in frames:
        for _, region in frame.groupby("region", sort=False):
            rids = region["rid"].to_numpy()
            order = np.argsort(rids)
            rids = rids[order]
            space = Space([np.asarray(region["s"].iloc[i], np.int64) for i in order])
            space.join(np.arange(len(rids)), percent)
            first = pd.Series(rids).groupby(space.root).transform("min").to_numpy()
            yield pd.DataFrame({"a": rids, "b": first})[first != rids]


def _local_links(regions: DataFrame, percent: int) -> DataFrame:
    """Joins regions that fit a task, several regions to a group."""
    total = regions.agg(F.sum(F.size("s"))).first()[0] or 0
    groups = int(max(64, 4 * total // TASK_SHINGLES))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = list(_joined(iter([frame]), percent))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return regions.select("region", "rid", "s", F.pmod(F.xxhash64("region"), F.lit(groups)).alias("group")).groupBy(
        "group").applyInPandas(lambda f: run(f), "a long, b long")


def _sizes(regions: DataFrame) -> DataFrame:
    return regions.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.sum(F.size("s")).alias("held"))


def _split(regions: DataFrame, sizes: DataFrame, percent: int, level: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """One level of Voronoi regions as tables: links to the pivots, and the members of the new regions.

    About four times ``pivots`` members of a region, whatever its size, are drawn by hash, and the first of them are its
    pivots: one row per region meets all members. Adaptive execution spreads the members of a large region.
    """
    reach = 1 - percent / 100
    drawn = regions.select("region", "rid", "s").join(sizes.select("region", "members"), "region").where(
        F.pmod(F.xxhash64("rid", F.lit(level)), F.col("members")) < 4 * pivots)
    chosen = written(drawn.groupBy("region").agg(F.slice(F.sort_array(F.collect_list(
        F.struct(F.col("rid").alias("p"), F.col("s").alias("ps")))), 1, pivots).alias("pivots")), "pivots")

    def distance(p: Column) -> Column:
        return bind(F.size(F.array_intersect("s", p["ps"])), lambda both: F.struct(
            (1 - both / (F.size("s") + F.size(p["ps"]) - both)).alias("d"), p["p"].alias("p"),
            (100 * both >= percent * (F.size("s") + F.size(p["ps"]) - both)).alias("linked")))

    tasks = int(max(16, (sizes.agg(F.sum("held")).first()[0] or 0) // 50_000))  # the work lies in the comparisons
    spread = regions.repartition(tasks, "rid")
    size = F.aggregate("pivots", F.lit(0).cast("long"), lambda a, p: a + F.size(p["ps"]))
    small = (chosen.agg(F.sum(size)).first()[0] or 0) <= MOST_PIVOT_SHINGLES
    far = written(spread.join(F.broadcast(chosen) if small else chosen, "region", "left").select("region", "rid", "s", F.sort_array(F.transform(
        F.coalesce("pivots", F.array().cast(chosen.schema["pivots"].dataType)), distance)).alias("far")), "distances")
    links = far.select(F.col("rid").alias("a"), F.explode("far").alias("f")).where("f.linked").select("a", F.col("f.p").alias("b"))
    near = F.get("far", F.lit(0))
    inside = F.coalesce(near["d"] <= CORE, F.lit(False))
    limit = F.when(inside, F.least(F.lit(CORE + reach), near["d"] + 2 * reach)).otherwise(CORE + reach) + SLACK
    visits = F.filter("far", lambda f: (f["d"] <= limit) & ~(inside & (f["p"] == near["p"])))
    places = F.concat(F.array(F.when(inside, near["p"]).otherwise(F.lit(-1))), F.transform(visits, lambda f: f["p"]))
    out = far.select("region", "rid", "s", F.explode(places).alias("to")).select(
        F.xxhash64("region", "to", F.lit(level)).alias("region"), "rid", "s")
    return links, out


def _blocks(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs of blocks of regions that no pivots split: every two members meet in one of them."""
    n = F.greatest(F.ceil(2 * F.col("members") / TASK_MEMBERS), F.ceil(2 * F.col("held") / TASK_SHINGLES)).cast("int")
    rows = regions.join(sizes.select("region", n.alias("n")), "region").withColumn(
        "own", F.pmod(F.xxhash64("rid"), F.col("n")).cast("int"))
    return rows.select("region", "rid", "s", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select(
        F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "rid", "s")


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b``: edges that connect exactly the sets that links connect, from ``family, rid, s``."""
    regions = sets.select(F.col("family").alias("region"), "rid", "s")
    found = []
    small = (F.col("members") <= TASK_MEMBERS) & (F.col("held") <= TASK_SHINGLES)
    for level in range(LEVELS + 1):
        sizes = written(_sizes(regions), "region-sizes")
        large = sizes.where(~small)
        if large.isEmpty():
            found.append(_local_links(regions, percent))
            break
        found.append(_local_links(regions.join(large, "region", "left_anti"), percent))
        rest = regions.join(large.select("region"), "region")
        if level == LEVELS:
            found.append(_local_links(_blocks(rest, large), percent))
            break
        stars, split = _split(rest, large, percent, level)
        found.append(stars)
        regions = written(split, "regions")
        if regions.count() > 2 * (large.agg(F.sum("members")).first()[0] or 0):  # these pivots tell too little apart
            found.append(_local_links(_blocks(rest, large), percent))
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of docs.

    Two texts link when ``100 * |A and B| >= percent * |A or B|`` of their sets of shingles; ``component_id`` is the
    smallest ``doc_id`` that links reach, nulls aside, so it is null only where all reached ids are. Rows with the same
    set are one member of the join and share the result. Null, empty and blank texts have an empty set and are linked
    with nothing, not even each other. Only two columns are read. An empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        seen, found = _grouped(docs, doc_id, text, n, percent)
        joined = seen.select("id", "h1", "h2", "n").join(found, ["h1", "h2", "n"], "left")
        return scratch.outlive(joined.select(
            F.col("id").alias(doc_id), F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")), "similar")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without those that links reach from another one: the smallest id of each group stays.

    Of rows with equal ids one stays, and ids come before nulls. Rows without words all stay. The join carries ids and
    hashes only; rows are looked at again at the end, and only those that repeat as a whole are shuffled then, or all
    of them where too many go to be sent to the tasks.
    """
    spark, key = docs.sparkSession, ["__id", "__none", "__t1", "__t2"]
    with Scratch(spark) as scratch:
        seen, found = _grouped(docs, doc_id, text, n, percent)
        groups = seen.where("n > 0").select("rid", "id", "t1", "t2", "h1", "h2", "n").join(found, ["h1", "h2", "n"])
        order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("rid").alias("rid"))
        stay = groups.groupBy("group").agg(F.min(order).alias("stay")).select("group", F.col("stay.rid").alias("stay"))
        marked = groups.join(stay, "group").select(
            *_key(F.col("id"), F.col("t1"), F.col("t2")), (F.col("rid") == F.col("stay")).alias("stays"))
        marked = marked.groupBy(*key).agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times"))
        marked = scratch.outlive(marked.where("NOT stays OR times > 1").select(*key, "stays"), "repeated-rows")
    small = marked.count() <= BROADCAST_ROWS
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), *_key(F.col(doc_id), F.xxhash64(whole), F.xxhash64(F.lit(1), whole)))
    rows = rows.join(F.broadcast(marked) if small else marked, key, "left")
    alone = rows.where("stays IS NULL").select("row")
    one = rows.where("stays").groupBy(*key).agg(F.first("row").alias("row")).select("row")
    return alone.union(one).select("row.*")


def _key(doc_id: Column, t1: Column, t2: Column) -> list[Column]:
    """An id that may be null, and a text, as columns that can be joined."""
    return [F.coalesce(doc_id.cast("string"), F.lit("")).alias("__id"), doc_id.isNull().alias("__none"), t1.alias("__t1"), t2.alias("__t2")]


def _grouped(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``rid, id, t1, t2, h1, h2, n`` as a table, and ``h1, h2, n, group, component_id`` of their distinct sets."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("id"), F.xxhash64(whole).alias("t1"),
                        F.xxhash64(F.lit(1), whole).alias("t2"), whole.alias("text"))
    sets = keyed.select("id", "t1", "t2", bind(shingles(F.col("text"), n), lambda s: F.struct(
        F.size(s).alias("n"), F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2"), prefix(s, percent).alias("p"))).alias("s"))
    with Scratch(spark) as prefixes:
        seen = written(sets.select("id", "t1", "t2", "s.*").withColumn("rid", F.monotonically_increasing_id()), "shingle-prefixes")
        rows = seen.where("n > 0").groupBy("h1", "h2", "n").agg(
            F.min("rid").alias("first"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
        classes = prefixes.outlive(rows, "set-classes")
        extra = seen.select("rid", "h1", "h2", "n").join(classes.where("copies > 1"), ["h1", "h2", "n"]).where("rid <> first")
        rows = seen.where("n > 0").select("rid", "n", "p").join(extra.select("rid"), "rid", "left_anti")
        families = prefixes.outlive(_families(rows, percent), "families")
        seen = prefixes.outlive(seen.drop("p"), "shingle-sets")
    wanted = written(seen.select("rid", "t1", "t2").join(families, "rid"), "wanted-texts")
    small = wanted.count() <= BROADCAST_ROWS  # beyond, the texts are shuffled once
    texts = keyed.select("t1", "t2", "text").join(F.broadcast(wanted) if small else wanted, ["t1", "t2"])
    texts = texts.groupBy("rid", "family").agg(F.first("text").alias("text"))  # one of each group of copies
    with Scratch(spark) as regions:
        members = written(texts.select("rid", "family", shingles(F.col("text"), n).alias("s")), "members")
        linked = regions.outlive(components(links(members, percent)), "linked")
    named = classes.join(linked, F.col("first") == F.col("node"), "left").select(
        "h1", "h2", "n", "least", F.coalesce("component", "first").alias("group"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    return seen, written(named.join(least, "group").select("h1", "h2", "n", "group", "component_id"), "class-components")
