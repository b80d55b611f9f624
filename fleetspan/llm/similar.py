"""Groups of records whose word shingles overlap: an exact set join that skips by set relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import pack, steps, unpack, unsteps
from .shingles import mix, window_hashes, word_hashes
from .store import components, stored

ENTRIES = 2_000_000  # shingles that one task sorts
BATCH = 1_000_000  # shingles gathered before they are dealt out
ANCHORS = 6  # least hashes by which sets find a first set to be compared with
MAP = 8  # longs in a set's bit map
FEW = 16  # members outside a list's main part that are held against all others at once; grows eightfold each round


def signature(words: int):
    """Set size and two 64-bit fingerprints of a text's shingle set; equal sets have equal fingerprints."""

    @F.pandas_udf("n long, f1 long, f2 long")
    def of(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            h = np.unique(window_hashes(word_hashes(t), words))
            rows.append((len(h), int(h.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(h)).view(np.int64)) if len(h) else 0))
        return pd.DataFrame(rows, columns=["n", "f1", "f2"])

    return of


def _deal(words: int, buckets: int):
    """Texts to (bucket, block): the shingles of a batch of texts by hash, each with its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        count = 0

        def flush():
            sets = list(held.values())
            ids, lens = np.array(list(held), np.uint64), np.array([len(s) for s in sets], np.uint32)
            all_h = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint32), lens)
            bucket = all_h % np.uint64(buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))
            for b in range(buckets):
                part = order[ends[b - 1] if b else 0 : ends[b]]
                if not len(part):
                    continue
                key = all_h[part] // np.uint64(buckets)
                o = np.argsort(key)
                own, at = np.unique(doc[part], return_inverse=True)
                yield b, pack(ids[own], lens[own], steps(key[o]), at[o].astype(np.uint32))

        def rows(got):
            for b, block in got:
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block], pa.binary())], names=["bucket", "block"])

        for batch in batches:
            for text in batch.column(0):
                h = np.unique(window_hashes(word_hashes(text.as_py()), words))
                cls = int(h.sum(dtype=np.uint64))  # as in signature()
                if len(h) and cls not in held:
                    held[cls] = h
                    count += len(h)
                if count >= BATCH:
                    yield from rows(flush())
                    held, count = {}, 0
        if held:
            yield from rows(flush())

    return run


def _shared(buckets: int, owners: int):
    """A bucket's blocks to (owner, block): shingles of two sets or more, numbered by frequency, sent to their sets."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["bucket"].iloc[0])
        ids, sizes, keys, at, base = [], [], [], [], 0
        for block in group["block"]:
            i, n, d, a = unpack(block)
            ids.append(i), sizes.append(n), keys.append(unsteps(d)), at.append(a.astype(np.int64) + base)
            base += len(i)
        ids, sizes, keys, at = map(np.concatenate, (ids, sizes, keys, at))
        order = np.argsort(keys)
        keys, at = keys[order], at[order]
        same = keys[1:] == keys[:-1]
        more = np.r_[same, False] | np.r_[False, same]
        keys, at = keys[more], at[more]
        # a set dealt out by several tasks counts once
        own, at_of = np.unique(ids, return_inverse=True)
        size_of = np.zeros(len(own), np.uint32)
        size_of[at_of] = sizes
        at = at_of[at]
        order = np.lexsort((at, keys))
        keys, at = keys[order], at[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])] if len(keys) else np.zeros(0, bool)
        keys, at = keys[new], at[new]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        df = np.diff(np.r_[start, len(keys)])
        keep = np.repeat(df > 1, df)
        at, df = at[keep], df[df > 1]
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(df))
        sid, often = np.repeat(rank, df), np.repeat(df, df)
        owner = (own[at] % np.uint64(owners)).astype(np.int64)
        out = []
        order = np.lexsort((at, owner))
        ends = np.searchsorted(owner[order], np.arange(owners), side="right")
        for o in range(owners):
            part = order[ends[o - 1] if o else 0 : ends[o]]
            if len(part):
                who, a = np.unique(at[part], return_inverse=True)
                out.append((o, bucket, pack(own[who], size_of[who], steps(a.astype(np.uint32)), sid[part].astype(np.uint32), often[part].astype(np.uint32))))
        return pd.DataFrame(out, columns=["owner", "bucket", "block"])

    return run


def _prefixes(buckets: int, percent: int):
    """An owner's blocks to its sets that can have a partner: shared shingles, and the rarest of them as index prefix."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, at, sids, often, base = [], [], [], [], [], 0
        for bucket, block in zip(group["bucket"], group["block"]):
            i, n, a, s, f = unpack(block)
            ids.append(i), sizes.append(n), at.append(unsteps(a).astype(np.int64) + base)
            sids.append(s.astype(np.int64) * buckets + bucket), often.append(f)
            base += len(i)
        ids, sizes, at, sids, often = map(np.concatenate, (ids, sizes, at, sids, often))
        own, at_of = np.unique(ids, return_inverse=True)
        size_of = np.zeros(len(own), np.int64)
        size_of[at_of] = sizes
        at = at_of[at]
        shared = np.bincount(at, minlength=len(own))
        least = -(-percent * size_of // 100)  # a partner holds that many of the set's shingles
        fine = shared >= least
        pick = fine[at]
        at, sids, often = at[pick], sids[pick], often[pick]
        order = np.lexsort((sids, often, at))
        at, sids = at[order], sids[order]
        ends = np.searchsorted(at, np.flatnonzero(fine), side="right")
        rows, first = [], 0
        for k, end in zip(np.flatnonzero(fine), ends):
            s = sids[first:end]
            lone = size_of[k] - len(s)
            anchors = [int(s[np.argmin(mix(s.view(np.uint64) * np.uint64(2 * r + 1) + np.uint64(r)))]) * ANCHORS + r for r in range(ANCHORS)]
            # each shingle turns one bit: two sets differ by at least the bits in which their maps differ
            place = mix(s.view(np.uint64)) % np.uint64(64 * MAP)
            turned = np.bincount(place.astype(np.int64), minlength=64 * MAP) & 1
            bits = np.packbits(turned.astype(np.uint8), bitorder="little").view(np.int64)
            rows.append((int(own[k].view(np.int64)), int(size_of[k]), np.sort(s).tobytes(), s[: size_of[k] - least[k] + 1 - lone], anchors, bits))
            first = end
        return pd.DataFrame(rows, columns=["cls", "n", "sids", "prefix", "anchors", "bits"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, inter) of pairs with both sets."""
    for batch in batches:
        a, b, na, nb, sa, sb = (batch.column(i) for i in range(6))
        inter = []
        last, held = None, None
        for x, p, q in zip(a.to_pylist(), sa, sb):
            if x != last:
                last, held = x, np.frombuffer(p.as_buffer(), np.int64)
            inter.append(len(np.intersect1d(held, np.frombuffer(q.as_buffer(), np.int64), assume_unique=True)))
        yield pa.RecordBatch.from_arrays([a, b, na, nb, pa.array(inter, pa.int64())], names=["a", "b", "na", "nb", "inter"])


def shared_sets(texts: DataFrame, total: int, words: int, percent: int) -> DataFrame:
    """(cls, n, sids, prefix, anchors, bits) for the sets that may have a partner, from rows of one text; a set may occur in many rows."""
    spark = texts.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ENTRIES))
    dealt = texts.mapInArrow(_deal(words, buckets), "bucket int, block binary").repartition(buckets, "bucket")
    sent = dealt.groupBy("bucket").applyInPandas(_shared(buckets, buckets), "owner int, bucket int, block binary").repartition(buckets, "owner")
    return stored(sent.groupBy("owner").applyInPandas(_prefixes(buckets, percent), "cls long, n long, sids binary, prefix array<long>, anchors array<long>, bits array<long>"), "sets")


def _answers(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Overlaps of (a, b, na, nb) pairs; only their sets are moved."""
    pairs = stored(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.withColumn("inter", F.lit(0).cast("long"))
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "pair-ids")  # small ones are broadcast by their size
    mine = sets.select("cls", "sids").join(ids, "cls", "left_semi")
    with_sets = pairs.join(mine.select(F.col("cls").alias("b"), F.col("sids").alias("sb")), "b").join(mine.select(F.col("cls").alias("a"), F.col("sids").alias("sa")), "a")
    return stored(with_sets.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_overlaps, "a long, b long, na long, nb long, inter long"), "overlaps")


def linked(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets that are linked.

    First, sets with an equal least hash meet the first of them, which settles most groups of near copies in a row per set
    and hash. Then index lists hold the sets whose prefix has a shingle, cut into blocks by set size: sizes of linked sets
    differ by the threshold at most, so only neighbouring blocks meet. A list whose members are in one component is skipped,
    and lists with the same members are one. In the others, members outside the main part are compared with all, or, if they
    are many, one of them is, until none is left. Answers are derived where they can be: such a set is compared with the
    heads of the list's components, one each, and its overlap with a head and theirs bound its overlap with each member; bit maps bound how much two sets differ; pairs below the threshold by such a bound are not read. So every pair that may link is compared, derived, or already joined by others.
    """
    need = percent * (F.col("na") + F.col("nb"))  # of (100 + percent) times the overlap
    close = lambda known: known.where((100 + percent) * F.col("inter") >= need).select("a", "b")
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    turned = [F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))]

    rows = sets.select("cls", "n", F.explode("anchors").alias("anchor"))
    heads = rows.groupBy("anchor").agg(F.min(F.struct("cls", "n")).alias("h"), F.count("*").alias("m")).where("m > 1").select("anchor", F.col("h.cls").alias("a"), F.col("h.n").alias("na"))
    known = _answers(rows.select("anchor", F.col("cls").alias("b"), F.col("n").alias("nb")).join(heads, "anchor").where((F.col("a") != F.col("b")) & near).select("a", "b", "na", "nb").distinct(), sets)
    comp = stored(components(close(known)), "components")

    # one head a component, the set with most links so far, and each member's overlap with it
    links = close(known).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    head = comp.join(links, "node").groupBy("component").agg(F.max(F.struct("d", "node")).alias("h")).select("component", F.col("h.node").alias("r"))
    sizes = sets.select("cls", "n")
    to_head = comp.join(head, "component").select(F.col("node").alias("cls"), "r").join(sizes, "cls").join(sizes.select(F.col("cls").alias("r"), F.col("n").alias("nr")), "r")
    to_head = stored(to_head, "heads")
    asked = to_head.where("cls <> r").select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("r").alias("b"), F.col("nr").alias("nb")).select(*turned)
    known = known.unionByName(_answers(asked.join(known.select("a", "b"), ["a", "b"], "left_anti"), sets))
    shared = known.select("inter", F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("b").alias("r")), F.struct(F.col("b").alias("cls"), F.col("a").alias("r")))).alias("t")).select("t.*", "inter")
    told = to_head.join(shared, ["cls", "r"], "left").select("cls", F.when(F.col("cls") == F.col("r"), F.col("n")).otherwise(F.col("inter")).alias("inter"), "r", "nr")

    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("long")
    label = lambda df: df.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("component", "cls")).drop("component")
    members = label(sets.select("cls", "n", "prefix")).select("cls", "n", "label", F.explode("prefix").alias("sid"), block.alias("own")).withColumn("block", F.explode(F.array("own", F.col("own") - 1)))
    prints = members.groupBy("sid", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.col("cls"), F.lit(1))).alias("x")).where("low <> high")
    one = prints.groupBy("m", "s", "x").agg(F.min(F.struct("sid", "block")).alias("k")).select("k.sid", "k.block")
    lists = stored(members.join(one, ["sid", "block"]).select(F.xxhash64("sid", "block").alias("list"), "cls"), "lists")
    traits = sets.select("cls", "n", (F.octet_length("sids") / 8).cast("long").alias("shared"), "bits").join(told, "cls", "left")
    side = lambda x: [F.col(c).alias(f"{d}{x}") for c, d in (("cls", ""), ("n", "n"), ("label", "l"), ("inter", "i"), ("shared", "s"), ("bits", "m"))]
    # what two sets share within the head and beside it, at most; and the least by which the maps say that they differ
    bound = F.least("ia", "ib") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    differ = sum(F.bit_count(F.col("ma")[i].bitwiseXOR(F.col("mb")[i])) for i in range(MAP))
    far = F.coalesce((100 + percent) * bound < need, F.lit(False)) | ((100 + percent) * (F.col("sa") + F.col("sb") - differ) < 2 * need)
    like = lambda x: (100 + percent) * F.col(f"i{x}") >= percent * (F.col(f"n{x}") + F.col("nr"))
    by_head = F.coalesce(like("a") & like("b"), F.lit(False))  # both link to the head, so they are joined already
    like_head = (100 + percent) * F.col("inter") >= percent * (F.col("n") + F.col("nr"))
    few = FEW
    while True:
        labelled = label(lists)
        parts = labelled.groupBy("list", "label").agg(F.count("*").alias("k"), F.max("cls").alias("c")).groupBy("list")
        # the part with most members is the main one; the pivot is of the smallest
        main = parts.agg(F.max(F.struct("k", "label")).alias("top"), F.min(F.struct("k", "label", "c")).alias("p"), F.sum("k").alias("m")).where("top.k < m").select("list", F.col("top.label").alias("low"), F.col("p.c").alias("pivot"), (F.col("m") - F.col("top.k")).alias("outside"))
        rest = stored(labelled.join(main, "list"), "open-lists")
        if rest.isEmpty():
            return comp
        # outsiders of a list, or one of many, and the list's members that they may still overlap enough
        full = rest.join(traits, "cls")
        left = full.where((F.col("outside") <= few) & (F.col("label") != F.col("low")) | (F.col("outside") > few) & (F.col("cls") == F.col("pivot"))).drop("r", "inter", "nr")
        # they meet the heads of the members first: one answer for all members that are like a head
        met = stored(left.join(full.select("list", "r", "nr").distinct(), "list"), "met-heads")
        heads = met.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("r").alias("b"), F.col("nr").alias("nb")).where("a <> b").select(*turned).distinct()
        told_now = _answers(heads.join(known.select("a", "b"), ["a", "b"], "left_anti"), sets)
        known = known.unionByName(told_now)
        both = known.select("inter", F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("b").alias("r")), F.struct(F.col("b").alias("cls"), F.col("a").alias("r")))).alias("t")).select("t.*", "inter")
        left = met.join(both, ["cls", "r"], "left").withColumn("inter", F.when(F.col("cls") == F.col("r"), F.col("n")).otherwise(F.col("inter")))
        # a set that links to a head in the main part need not meet the main part
        head_label = comp.select(F.col("node").alias("r"), F.col("component").alias("lr"))
        into_main = like_head & (F.coalesce("lr", "r") == F.col("low"))
        left = left.join(head_label, "r", "left").withColumn("in_main", F.coalesce(F.max(into_main).over(Window.partitionBy("list", "cls")), F.lit(False)))
        # two sets that share many lists meet in the first of them only
        asks = met.groupBy("cls").agg(F.collect_set("list").alias("asked"))
        stands = rest.groupBy("cls").agg(F.collect_set("list").alias("stands"))
        first_met = F.array_min(F.array_intersect("asked", "stands")) == F.col("list")
        sides = left.join(asks, "cls").select("list", "low", "in_main", "asked", F.col("r").alias("ra"), "nr", *side("a")).join(full.join(stands, "cls").select(F.col("list").alias("other"), "stands", F.col("r").alias("rb"), *side("b")), (F.col("list") == F.col("other")) & F.col("ra").eqNullSafe(F.col("rb")) & (F.col("la") != F.col("lb")) & ~(F.col("in_main") & (F.col("lb") == F.col("low"))) & near & ~far & ~by_head & first_met)
        pairs = sides.select(*turned).distinct()
        answers = _answers(pairs.join(known.select("a", "b"), ["a", "b"], "left_anti"), sets)
        known = known.unionByName(answers)
        if not close(told_now.unionByName(answers)).isEmpty():
            comp = stored(components(close(known)), "components")
        # lists whose outsiders met all others are done; a pivot leaves its list
        lists = rest.where((F.col("outside") > few) & (F.col("cls") != F.col("pivot"))).select("list", "cls")
        few *= 8


def similar_records(customers: DataFrame, customer_id: str = "customer_id", address: str = "address", words: int = 5, percent: int = 75) -> DataFrame:
    """Group records whose ``address`` texts share shingles: one row per record with the group it belongs to.

    A set has the distinct runs of ``words`` words (A-Z lower-cased); a shorter text is one run, and a text without words, or
    null, has none and no links. Sets link when 100 x intersection >= ``percent`` x union. Returns customer_id, n_shingles,
    class_id (equal sets share it; null without words), component (null without words) and component_id, the smallest id
    reachable by links, itself included; null ids are passed over, so it is null only where a whole group has none. Repeated
    rows come back as often as they occur. Shingles are compared by 64-bit hashes.
    """
    signed = stored(customers.select(F.col(customer_id).alias("customer_id"), signature(words)(F.col(address)).alias("s")).select("customer_id", F.col("s.n").alias("n"), F.when(F.col("s.n") > 0, F.col("s.f1")).alias("cls"), F.col("s.f2").alias("f2")), "signatures")
    total = signed.agg(F.sum("n")).first()[0] or 0
    comp = None
    if total:
        sets = shared_sets(customers.select(F.col(address)), total, words, percent)
        comp = linked(sets, percent)
    out = signed.withColumn("component", F.col("cls"))
    if comp is not None:
        out = signed.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = out.where("component is not null").groupBy("component").agg(F.min("customer_id").alias("component_id"))
    out = out.join(lowest, "component", "left")
    return out.select("customer_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), "component", F.when(F.col("cls").isNull(), F.col("customer_id")).otherwise(F.col("component_id")).alias("component_id"))
