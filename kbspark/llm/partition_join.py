"""N-gram Jaccard join by pigeonhole over partitions of the shingle universe."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import saved, unused
from kbspark.llm.components import components
from kbspark.llm.shingles import WIDTH, key_of, mixed, shingle_sets

#: Two sets are linked if 100 * shared >= PERCENT * union.
PERCENT = 80
#: A size band reaches from its least size to this many times it.
BAND = 1.6
#: Segments without deletions per unit of difference that must be covered; the excess is left out, hottest first.
SLACK = 1.3
#: Pairs of one leader that are verified in one task.
TOGETHER = 1024
#: Sets of one leader that are compared with as many others by their sketches in one task.
BLOCK = 2048
#: Bytes of a sketch, per unit of difference that linked sets may have.
FINER = 4
#: Candidates of other components that a set offers in the first round, and times as many in each further one.
FIRST_OFFERED, MORE_OFFERED = 4, 8
#: Bits of an index entry that name its band.
BAND_BITS = 7

_U = np.uint64


class Bands:
    """Size bands, and for each how its universe is divided.

    Linked sets of sizes a <= b differ in at most (a + b) * (100 - p) / (100 + p)
    shingles, and b is at most 100 * a / p. A pair is sought in the band of its
    smaller set; a set also joins the band below where a smaller partner may lie."""

    def __init__(self, percent: int = PERCENT, largest: int = 1 << 40):
        self.percent = percent
        self.first = -(-percent // (100 - percent)) if percent < 100 else 1  # smaller sets link with equal ones only
        edges = [max(self.first, 1)]
        while edges[-1] <= largest:
            edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
        self.edges = np.array(edges, np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1

    def differ(self, sizes: np.ndarray) -> np.ndarray:
        """Most shingles by which a set differs from any linked one: from the largest possible."""
        return (sizes + sizes * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def also_below(self, sizes: np.ndarray) -> np.ndarray:
        band = self.of(sizes)
        return (band > 0) & (-(-sizes * self.percent // 100) < self.edges[np.maximum(band, 0)])


def allocation(size: float, differ: int, sets: int) -> tuple[int, int]:
    """(segments with deletions, segments without) of least cost for a band.

    A segment matched as a whole covers one difference, one matched up to one
    deletion covers two; together they must cover ``differ + 1``. The cost is the
    entries a set makes plus the partners it meets by segments so empty that unlike sets agree in them."""
    best = None
    for d in range((differ + 1) // 2 + 1 + (differ + 1) % 2):
        due = max(differ + 1 - 2 * d, 0)
        e = math.ceil(due * SLACK)
        if d + e == 0:
            continue
        mean = size / (d + e)
        none, few = math.exp(-mean), math.exp(-mean) * (1 + mean)
        kept_none = max(none - (e - due) / e, 0.0) + none * 0.05 if e else 0.0
        cost = d * (1 + mean) + due + sets * (d * few * few + due * kept_none * kept_none)
        if best is None or cost < best[0]:
            best = (cost, d, e)
    return best[1], best[2]


class Plan:
    """The allocation of every band, small and sent to the tasks."""

    def __init__(self, percent: int, counts: dict[int, int]):
        self.bands = Bands(percent)
        self.percent, self.counts = percent, counts
        n = len(self.bands.edges) - 1
        self.deleting, self.plain = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in range(n):
            low, high = int(self.bands.edges[b]), int(self.bands.edges[b + 1]) - 1
            sets = counts.get(b, 0) + counts.get(b + 1, 0)
            if not sets:
                continue
            differ = int(self.bands.differ(np.array([high]))[0])
            self.deleting[b], self.plain[b] = allocation((low + high) / 2, differ, sets)

    def __reduce__(self):
        return Plan, (self.percent, self.counts)

    def entries(self, members: np.ndarray) -> np.ndarray:
        """Index entries of a set: hashes of (band, segment, content), whose last
        BAND_BITS bits are the band."""
        size = len(members)
        if size < self.bands.first:
            return np.zeros(0, _U)
        band = int(self.bands.of(np.array([size]))[0])
        out = [self._in_band(members, band)]
        if self.bands.also_below(np.array([size]))[0]:
            out.append(self._in_band(members, band - 1))
        return np.concatenate(out)

    def _in_band(self, members: np.ndarray, band: int) -> np.ndarray:
        d, e = int(self.deleting[band]), int(self.plain[band])
        scrambled = mixed(members + _U((band + 1) * 0xD1342543DE82EF95 % 2**64))
        segment = ((scrambled >> _U(32)) * _U(d + e) >> _U(32)).astype(np.int64)
        content = mixed(scrambled ^ _U(0x5851F42D4C957F2D))
        total = np.zeros(d + e, _U)
        np.add.at(total, segment, content)
        count = np.bincount(segment, minlength=d + e)
        tag = mixed(np.arange(d + e, dtype=_U) + _U((band + 1) << 32))
        out = []
        if d:
            out.append(total[:d] + tag[:d])
            some = segment < d
            out.append(total[segment[some]] - content[some] + tag[segment[some]])
        # What a set may leave out: it differs from a linked one in at most ``differ`` places,
        # so more segments than it leaves out agree, and all sets leave out the emptiest first.
        differ = int(self.bands.differ(np.array([len(members)]))[0])
        left_out = min(max(e + 2 * d - differ - 1, 0), e)
        if left_out < e:
            order = np.argsort(count[d:], kind="stable")[left_out:] + d
            out.append(total[order] + tag[order])
        return mixed(np.concatenate(out)) >> _U(BAND_BITS) << _U(BAND_BITS) | _U(band)

    def sketches(self, members: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(band, a byte for each segment of a finer division) for the set's bands.

        Sets of a band that differ in k members differ in k bytes at most."""
        size = np.array([len(members)])
        if size[0] < self.bands.first:
            return
        own = int(self.bands.of(size)[0])
        for band in (own, own - 1)[:1 + int(self.bands.also_below(size)[0])]:
            high = int(self.bands.edges[band + 1]) - 1
            n = FINER * (int(self.bands.differ(np.array([high]))[0]) + 1)
            scrambled = mixed(members ^ _U(0x2545F4914F6CDD1D))
            total = np.zeros(n, _U)
            np.add.at(total, ((scrambled >> _U(32)) * _U(n) >> _U(32)).astype(np.int64), mixed(scrambled))
            yield band, (total >> _U(56)).astype(np.uint8).tobytes()


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _keys(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), key_of(s) if len(s) else None) for s in shingle_sets(_column(batch, "text"), width)]
            yield pa.RecordBatch.from_arrays(
                [_column(batch, "id"), _column(batch, "text_hash"), pa.array([n for n, _ in sets], pa.int64()),
                 pa.array([k for _, k in sets], pa.int64())], names=["id", "text_hash", "n", "key"])

    return run


def _entries(plan: Plan, width: int, remember: int = 1_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a set that recurs within a task is entered once
        entries, keys, held = [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(entries).view(np.int64)), pa.array(np.concatenate(keys))], names=["entry", "key"])

        for batch in batches:
            for members in shingle_sets(_column(batch, "text"), width):
                if not len(members):
                    continue
                key = key_of(members)
                if key in seen:
                    continue
                if len(seen) < remember:
                    seen.add(key)
                own = plan.entries(members)
                if len(own):
                    entries.append(own)
                    keys.append(np.full(len(own), key, np.int64))
                    held += len(own)
                if held >= 100_000:
                    yield flush()
                    entries, keys, held = [], [], 0
        if held:
            yield flush()

    return run


def _sketches(plan: Plan, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, band, len(members), sketch)
                    for key, members in zip(_column(batch, "key").to_pylist(), shingle_sets(_column(batch, "text"), width))
                    for band, sketch in plan.sketches(members)]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["key", "band", "n", "sketch"])

    return run


def _close(percent: int, most: int):
    """Of the sets of one block and another, or of one block alone, pairs of
    different components that sizes and sketches allow to be linked: for each
    set the first ``most``, and whether there are more."""
    def run(table: pa.Table) -> pa.Table:
        key, n, component, side = (table.column(c).to_numpy() for c in ("key", "n", "component", "side"))
        leaders, leader = table.column("leaders").to_pylist(), table.column("leader")[0].as_py()
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(key), -1)
        one = bool(table.column("i")[0].as_py() == table.column("j")[0].as_py())
        left = np.arange(len(key)) if one else np.flatnonzero(side == 0)
        right = left if one else np.flatnonzero(side == 1)
        right = right[np.argsort(key[right], kind="stable")]
        found = []
        for a in left:
            b = right[np.searchsorted(key[right], key[a], side="right"):] if one else right
            b = b[(component[b] != component[a]) & (n[b] >= -(-n[a] * percent // 100)) & (n[b] <= n[a] * 100 // percent)]
            if len(b):
                apart = (n[b] + n[a]) * (100 - percent) // (100 + percent)
                b = b[(bits[b] != bits[a]).sum(1) <= apart]
                own = set(leaders[a])  # a pair that has several leaders in common is left to the least of them
                mine = [k for k in b if min(own.intersection(leaders[k])) == leader]
                found.extend((min(key[a], key[k]), max(key[a], key[k]), len(mine) > most) for k in mine[:most])
        band, n_found = table.column("band")[0].as_py(), len(found)
        return pa.table({"leader": pa.array([x for x, _, _ in found], pa.int64()), "key": pa.array([y for _, y, _ in found], pa.int64()),
                         "more": pa.array([z for _, _, z in found], pa.bool_()),
                         "of": pa.array([leader] * n_found, pa.int64()), "band": pa.array([band] * n_found, pa.int64())})

    return run


def _members(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Sets in the groups of their leaders, with their sketches and all their leaders."""
    leaders = pairs.groupBy("key", "band").agg(F.collect_list("leader").alias("leaders"))  # fewer than a set's entries
    return saved(pairs.join(sketches, ["key", "band"]).join(leaders, ["key", "band"]), "leader-members")


def _open_pairs(members: DataFrame, joined: DataFrame, percent: int, most: int) -> DataFrame:
    """(leader, key, more, of, band) for sets that share an entry, hence its leader, lie in
    different components and may be linked, ``most`` per set and pair of blocks. Large groups of a leader are cut
    into blocks, and each pair of blocks is a task's work; tasks return what passes."""
    members = (members.join(joined.withColumnRenamed("id", "key"), "key", "left")
               .withColumn("component", F.coalesce("component", "key")))
    mixed_groups = members.groupBy("leader", "band").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("rows")).where("a < b")
    cut = members.join(mixed_groups.select("leader", "band", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")),
                       ["leader", "band"])
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("leader", "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                     F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"),
                     "key", "n", "component", "sketch", "leaders")
    return cut.groupBy("leader", "band", "i", "j").applyInArrow(
        _close(percent, most), "leader long, key long, more boolean, of long, band long")


def merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links (leader, key): only the components that the links touch are joined anew."""
    ends = links.select(F.col("leader").alias("id")).union(links.select("key")).distinct()
    names = joined.unionByName(ends.join(joined, "id", "left_anti").withColumn("component", F.col("id")))
    names = saved(names, "names")
    a, b = names.toDF("leader", "a"), names.toDF("key", "b")
    touched = components(links.join(a, "leader").join(b, "key"), "a", "b").toDF("component", "new")
    return saved(names.join(touched, "component", "left").select("id", F.coalesce("new", "component").alias("component")), "joined")


def _link_open(members: DataFrame, texts: DataFrame, joined: DataFrame, done: DataFrame, percent: int, width: int) -> DataFrame:
    """The components after all links within the groups of leaders.

    In each round every set offers its first candidates of other components for
    verification, so a round's pairs are linear in the sets; what they link leaves together.
    Where links are dense one or two rounds join a group. Where candidates fail, each round
    takes more of them, until every candidate left has been verified. A group none of whose sets has more leaves."""
    most = FIRST_OFFERED
    while True:
        met = saved(_open_pairs(members, joined, percent, most), "open-pairs")
        late = _verified(met.select("leader", "key").distinct().join(done, ["leader", "key"], "left_anti"), texts, percent, width)
        linked = late.where("linked").select("leader", "key")
        if not linked.isEmpty():
            joined = merged(joined, linked)
        again = met.where("more").select(F.col("of").alias("leader"), "band").distinct()
        if again.isEmpty():
            return joined
        members = saved(members.join(again, ["leader", "band"], "left_semi"), "members-left")
        done, most = done.unionByName(late), most * MORE_OFFERED


def _verify(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, against = None, None
        for batch in batches:
            rows = zip(_column(batch, "leader").to_pylist(), _column(batch, "key").to_pylist(),
                       _column(batch, "leads").to_pylist(), shingle_sets(_column(batch, "text"), width))
            found: list[tuple[int, int, int, int, int]] = []
            for of, key, leads, members in rows:
                if leads:
                    leader, against = of, members
                elif of == leader:
                    place = np.searchsorted(against, members)
                    place[place == len(against)] = 0
                    shared = int((against[place] == members).sum())
                    found.append((of, key, len(against), len(members), shared))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 5)],
                names=["leader", "key", "size", "n", "shared"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs, and whether their sets are linked.

    A leader's pairs are cut into parts; each part gets the leader's text once,
    and rows stream past it in sorted order, so a task holds one set."""
    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    cut = pairs.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    cut = saved(cut.select("leader", "key", "part"), "pairs")
    asked = cut.select("leader", "part", "key", F.lit(False).alias("leads")).unionByName(
        cut.select("leader", "part", F.col("leader").alias("key"), F.lit(True).alias("leads")).distinct())
    rows = asked.join(texts, "key")
    n = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(n, "leader", "part").sortWithinPartitions("leader", "part", F.desc("leads"))
    counted = rows.select("leader", "key", "leads", "text").mapInArrow(
        _verify(width), "leader long, key long, size long, n long, shared long")
    union = F.col("size") + F.col("n") - F.col("shared")
    return saved(counted.select("leader", "key", (100 * F.col("shared") >= percent * union).alias("linked")), "verified")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
                       width: int = WIDTH) -> DataFrame:
    """(key, n_shingles, component_id) of every row.

    Equal sets form a class that is indexed once. Each class enters the hashed
    content of segments of its universe, which linked classes are bound to
    share (see ``Plan``). Classes that share an entry meet a leader of that entry and are
    verified exactly. Other classes that share an entry have its leader in common;
    those that no chain of links has joined yet are compared within that leader's group by
    sketches, which bound their difference from below, and verified where these allow a link, round by round.

    Missing, empty and wordless texts have no shingles and link with nothing.
    Rows without a key are components of their own with a null component_id.
    Rows of one key count as one document in one component, whatever their texts: each
    text's set is indexed, and what links with one of them links with all. An empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))  # tells apart the texts of one id
    sets = saved(rows.mapInArrow(_keys(width), "id long, text_hash long, n long, key long"), "shingle-keys")
    bands = Bands(percent)
    edge = [int(e) for e in bands.edges]
    classes = sets.where("key is not null and id is not null").groupBy("key").agg(
        F.min("id").alias("rep"), F.min_by("text_hash", "id").alias("text_hash"), F.max("n").alias("n"), F.count("*").alias("copies"))
    classes = saved(classes, "shingle-classes")
    level = F.size(F.filter(F.array(*map(F.lit, edge)), lambda e: e <= F.col("n"))) - 1
    counts = {r["band"]: r["count"] for r in classes.where(F.col("n") >= bands.first)
              .groupBy(level.alias("band")).count().collect()}  # a row for each band
    plan = Plan(percent, counts)

    entries = rows.where("id is not null").select("text").mapInArrow(_entries(plan, width), "entry long, key long")
    by_entry = Window.partitionBy("entry")
    pairs = (entries.withColumn("leader", F.min("key").over(by_entry)).where("key <> leader")
             .select("leader", "key", F.col("entry").bitwiseAND(2**BAND_BITS - 1).alias("band")).distinct())
    pairs = saved(pairs, "leader-pairs")

    wanted = pairs.select("key").union(pairs.select(F.col("leader").alias("key"))).distinct()
    wanted = wanted.join(classes, "key").select("key", F.col("rep").alias("id"), "text_hash")
    texts = saved(rows.join(wanted, ["id", "text_hash"]).groupBy("key").agg(F.min("text").alias("text")), "candidate-texts")

    # Ids whose rows have several sets, or a set and none.
    several = saved(sets.where("id is not null").groupBy("id").agg(
        F.min("key").alias("leader"), F.max("key").alias("last"), F.count("key").alias("keyed"), F.count("*").alias("rows"))
        .where("leader <> last or keyed > 0 and keyed < rows").select("id", "leader"), "several-sets")
    of_one_id = sets.where("key is not null").join(several, "id").where("key <> leader").select("leader", "key").distinct()

    done = _verified(pairs.select("leader", "key").distinct(), texts, percent, width)
    linked = done.where("linked").select("leader", "key").unionByName(of_one_id)
    joined = saved(components(linked, "leader", "key"), "joined")
    sketches = texts.mapInArrow(_sketches(plan, width), "key long, band long, n long, sketch binary")
    joined = _link_open(_members(pairs, sketches), texts, joined, done, percent, width)

    named = classes.join(joined.withColumnRenamed("id", "key"), "key", "left").select(
        "key", "rep", F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_key = named.join(least, "component").select("key", "component_id")
    out = sets.join(several, "id", "left").withColumn("key", F.coalesce("key", "leader")).join(by_key, "key", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
                width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without those that are linked to a document of a
    smaller key, and one row of each key. Rows without a key stay."""
    found = jaccard_components(docs, key, text, percent, width)
    linked, turn = unused(docs, "linked"), unused(docs, "turn")
    dropped = saved(found.where(F.col("component_id") < F.col(key)).select(F.col(key).alias(linked)).distinct(), "linked")
    keyed = docs.where(F.col(key).isNotNull()).join(dropped, F.col(key) == F.col(linked), "left_anti")
    keyed = keyed.withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(text), text)))
    return keyed.where(F.col(turn) == 1).drop(turn).unionByName(docs.where(F.col(key).isNull()))
