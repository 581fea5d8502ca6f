"""Set-similarity join of documents on word shingles: a grouped prefix join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickertide.llm.components import connected_components
from tickertide.llm.tables import discard, small, stage
from tickertide.llm.words import NON_SPACE, as_signed, gram_hashes, mix, slices, split_words

SKETCH_BITS = 18  # counters of the frequency sketch, whatever the corpus
BROADCAST_IDS = 500_000  # longs
PROFILE = 256  # counters of a set's profile: shingles by the low bits of their hash
TOP = 15  # what a counter of a profile can hold, in units of a power of two
BLOCK = 4096  # members of a list that are held against each other at once
CROWD = 4  # pairs a member that two blocks may leave to be verified at once


def _shingles(words, text: int, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text of a batch."""
    run = words.hash[words.first[text] : words.first[text + 1]]
    if not len(run):
        return run
    grams = np.sort(gram_hashes(run, min(k, len(run))))
    return grams[np.concatenate(([True], grams[1:] != grams[:-1]))]


def _frequency_levels(docs: DataFrame, k: int) -> np.ndarray:
    """How often the shingles of each sketch bucket occur, in steps of a twelfth of an octave."""

    def count(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches):
            words = split_words(batch["text"], NON_SPACE)
            for text in range(batch.num_rows):
                bucket = (_shingles(words, text, k) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                at, n = np.unique(bucket, return_counts=True)
                counts[at] += n
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    sums = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # one row per bucket of the sketch at most
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    n = found["n"].to_numpy().astype(np.float64)
    levels[found["bucket"].to_numpy()] = np.minimum(255, np.log2(n + 1) * 6)
    return levels


def _packed(counts: np.ndarray) -> bytes:
    """Counters of four bits, rounded up to units of a power of two, and that power."""
    power = max(0, -(-int(counts.max(initial=0)) // TOP) - 1).bit_length()
    units = ((counts + (1 << power) - 1) >> power).astype(np.uint8)
    return ((units[::2] << 4) | units[1::2]).tobytes() + bytes([power])


def _unpacked(column: pa.Array) -> np.ndarray:
    """Of each row of a batch the counters, none below what was counted."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), PROFILE // 2 + 1)
    units = np.stack((raw[:, :-1] >> 4, raw[:, :-1] & 15), axis=2).reshape(len(column), PROFILE)
    return units.astype(np.int32) << raw[:, -1:].astype(np.int32)


def _counters(grams: np.ndarray) -> bytes:
    """Packed counters of a whole set, about as many as it has shingles: a bound close to the overlap."""
    size = 1 << max(8, (len(grams) - 1).bit_length())
    return _packed(np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size))


def _bound(a: bytes, b: bytes) -> int:
    """What the overlap of two sets is at most, by their counters; the longer ones are folded."""
    found = []
    for packed in (a, b):
        raw = np.frombuffer(packed, np.uint8)
        units = np.stack((raw[:-1] >> 4, raw[:-1] & 15), axis=1).reshape(-1)
        found.append(units.astype(np.int32) << np.int32(raw[-1]))
    size = min(map(len, found))
    one, two = (x.reshape(-1, size).sum(0) for x in found)
    return int(np.minimum(one, two).sum())


def _signatures(docs: DataFrame, levels: np.ndarray, k: int, percent: int) -> DataFrame:
    """Per document: set size, digest and profile of the set, prefix in order of frequency."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            words = split_words(batch["text"], NON_SPACE)
            n, sig, prefix, profile = [], [], [], []
            for text in range(batch.num_rows):
                grams = _shingles(words, text, k)
                size = len(grams)
                rank = levels[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                # Below the sign bit: tokens are compared as signed numbers later.
                ordered = np.sort((rank << np.uint64(55)) | (grams & np.uint64((1 << 55) - 1)))
                n.append(size)
                filled = np.bincount((grams & np.uint64(PROFILE - 1)).astype(np.int64), minlength=PROFILE)
                profile.append(_packed(filled))
                sig.append((int(mix(grams).sum(dtype=np.uint64)), int(mix(~grams).sum(dtype=np.uint64))))
                prefix.append(as_signed(ordered[: size - -(-percent * size // 100) + 1] if size else ordered))
            one, two = (np.array([s[i] for s in sig], np.uint64) for i in (0, 1))
            ends = np.cumsum([0, *map(len, prefix)])
            lists = pa.ListArray.from_arrays(
                pa.array(ends.astype(np.int32)), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.array(n, np.int64)), pa.array(as_signed(one)), pa.array(as_signed(two)), lists, pa.array(profile, pa.binary())],
                ["doc_id", "n", "sig1", "sig2", "prefix", "profile"],
            )

    doc = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc}, n long, sig1 long, sig2 long, prefix array<long>, profile binary"
    )


def _may_link(percent: int, a: str, b: str) -> Column:
    """Length filter, and position filter for the place of a shared prefix token."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    need = F.ceil((na + nb) * percent / F.lit(100 + percent))
    left = F.least(na - F.col(f"{a}pos"), nb - F.col(f"{b}pos"))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (left >= need)


def _within_bound(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose profiles leave room for enough overlap; slim rows, before any set moves."""
    numbers = ["n", "profile"]
    both = pairs
    for side in ("v", "u"):
        both = both.join(profiles.withColumnsRenamed({"id": side} | {c: f"{c}_{side}" for c in numbers}), side)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            n_u, n_v = (batch[f"n_{side}"].to_numpy() for side in "uv")
            shared = np.minimum(_unpacked(batch["profile_u"]), _unpacked(batch["profile_v"])).sum(1)
            mask = pa.array((100 + percent) * shared >= percent * (n_u + n_v))
            yield pa.RecordBatch.from_arrays([batch["u"].filter(mask), batch["v"].filter(mask)], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of document ids whose full sets are similar enough."""

    def sets(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            words = split_words(batch["text"], NON_SPACE)
            grams = [_shingles(words, i, k) for i in range(batch.num_rows)]
            columns = [
                batch["id"],
                pa.array([len(g) for g in grams], pa.int64()),
                pa.array([_counters(g) for g in grams], pa.binary()),
                pa.array([g.tobytes() for g in grams], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "counters", "grams"])

    def bound(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n = zip(batch["n_u"].to_pylist(), batch["n_v"].to_pylist())
            counters = zip(batch["counters_u"], batch["counters_v"])
            may = [
                (100 + percent) * _bound(a.as_buffer(), b.as_buffer()) >= percent * (x + y)
                for (a, b), (x, y) in zip(counters, n)
            ]
            mask = pa.array(may, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["u"].filter(mask), batch["v"].filter(mask)], ["u", "v"])

    def compare(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = []
            for a, b in zip(batch["grams_u"], batch["grams_v"]):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["u"].filter(mask), batch["v"].filter(mask)], ["u", "v"])

    ids = stage(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "jaccard-ids")
    asked = (
        docs.select(F.col("doc_id").alias("id"), "text")
        .join(small(ids, BROADCAST_IDS), "id")
        .mapInArrow(sets, "id long, n long, counters binary, grams binary")
    )
    asked = stage(asked, "jaccard-sets")

    def beside(pairs: DataFrame, held: DataFrame, *columns: str) -> DataFrame:
        """The pairs with columns of both sides. The hub of a star is v: it is attached while the rows are slim."""
        for side in ("v", "u"):
            own = held.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
            pairs = pairs.join(own, side)
        return pairs.select("u", "v", *(f"{c}_{side}" for c in columns for side in "uv"))

    # Counters move first, at most a byte for each shingle; whole sets of the pairs only that these leave.
    near = beside(small(pairs, BROADCAST_IDS), asked, "n", "counters").mapInArrow(bound, "u long, v long").distinct()
    near = stage(near, "jaccard-near")
    count = near.count()
    if not count:
        discard(ids, asked)
        return near
    left = near.select(F.explode(F.array("u", "v")).alias("id"))
    held = asked.join(F.broadcast(left) if 2 * count <= BROADCAST_IDS else left, "id", "left_semi")
    links = beside(near, held, "grams").mapInArrow(compare, "u long, v long")
    links = stage(links, "jaccard-links")
    discard(ids, asked, near)
    return links


def _shared_ids(read: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of a doc_id whose rows have different texts."""
    rows = read.where("n > 0 and doc_id is not null").select("doc_id", "n", "sig1", "sig2")
    several = (
        rows.groupBy("doc_id")
        .agg(F.min("sig1").alias("low"), F.max("sig1").alias("high"))
        .where("low < high")
        .select("doc_id")
    )
    return (
        rows.join(several, "doc_id")
        .join(classes.select("n", "sig1", "sig2", "id"), ["n", "sig1", "sig2"])
        .select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    )


def _unit(column: str) -> Column:
    """A fixed pseudo-random number in [0, 1) for an id."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _across(lists: DataFrame, profiles: DataFrame, percent: int, everything: bool = False) -> DataFrame:
    """Pairs (u, v, score, open) of members of different components in a list that may be similar enough.

    Where two blocks leave more than ``CROWD`` pairs for each member, only the best partner of
    each member of the left side is returned, and ``open`` names the list; else it is null, and the
    pairs are all there are. ``everything`` returns all pairs.

    The members of the largest component of a list (the rest of it) are never held against each
    other. The others are cut into blocks, and each block meets each block of its list; two ``second``
    members of a list never meet. A list of at most a block of members meets in one place.
    The overlap of two sets is at most the sum over the counters of the lesser count.
    A profile takes 129 bytes on its way to the blocks.
    """
    parts = lists.groupBy("token", "part").agg(F.count("*").alias("size"))
    shape = parts.groupBy("token").agg(
        F.max(F.struct("size", "part")).alias("largest"), F.sum("size").alias("whole")
    )
    shape = shape.select(
        "token",
        F.col("largest.part").alias("main"),
        (F.col("whole") <= BLOCK).alias("short"),
        F.ceil((F.col("whole") - F.col("largest.size")) / BLOCK).cast("int").alias("o_blocks"),
        F.ceil(F.col("largest.size") / BLOCK).cast("int").alias("m_blocks"),
    )
    other = F.col("part") != F.col("main")
    own = F.pmod(F.xxhash64("id"), F.when(other, F.col("o_blocks")).otherwise(F.col("m_blocks"))).cast("int")
    rows = lists.join(shape, "token").select("*", other.alias("other"), own.alias("own"))
    # Meetings (i, j): block i of the others with block j of the others, i <= j, or of the main part.
    upto = F.transform(
        F.sequence(F.lit(0), F.col("o_blocks") - 1),
        lambda x: F.struct(
            F.least(x, "own").alias("i"),
            F.greatest(x, "own").alias("j"),
            (F.col("own") <= x).alias("left"),
            (F.col("own") >= x).alias("right"),
            F.lit(False).alias("with_main"),
        ),
    )
    to_main = F.transform(
        F.sequence(F.lit(0), F.col("m_blocks") - 1),
        lambda x: F.struct(F.col("own").alias("i"), x.alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"), F.lit(True).alias("with_main")),
    )
    from_main = F.transform(
        F.sequence(F.lit(0), F.col("o_blocks") - 1),
        lambda x: F.struct(x.alias("i"), F.col("own").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"), F.lit(True).alias("with_main")),
    )
    # A short list meets once, the main part on the right only.
    once = F.array(
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("other").alias("left"), F.lit(True).alias("right"), F.lit(True).alias("with_main"))
    )
    meetings = F.when(F.col("short"), once).when(F.col("other"), F.concat(upto, to_main)).otherwise(from_main)
    key = ["token", "with_main", "i", "j"]
    dealt = (
        rows.select("token", "id", "n", "pos", "part", "second", F.explode(meetings).alias("m"))
        .select("token", "id", "n", "pos", "part", "second", "m.*")
        .join(profiles.select("id", "profile"), "id")
        .repartition(*key)
        .sortWithinPartitions(*key)
    )
    whole, need = 100 + percent, percent

    numbers = ["id", "n", "pos", "part", "second", "left", "right"]

    def hold(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        ids, n, pos, part, second = (rows[c] for c in numbers[:5])
        left, right = np.flatnonzero(rows["left"]), np.flatnonzero(rows["right"])
        profile, out = rows["profile"], []
        step = max(1, 50_000 // max(1, len(right)))
        for low in range(0, len(left), step):
            a, b = left[low : low + step, None], right
            least = -(-(n[a] + n[b]) * need // whole)
            ok = (part[a] != part[b]) & ~(second[a] & second[b]) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least)
            x, y = np.nonzero(ok)
            if not len(x):
                continue
            one, two = left[low + x], right[y]
            shared = np.concatenate(
                [np.minimum(profile[one[k : k + 4096]], profile[two[k : k + 4096]]).sum(1) for k in range(0, len(one), 4096)]
            )
            may = shared >= least[x, y]
            one, two = one[may], two[may]
            out.append((one, two, shared[may] / (n[one] + n[two])))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        one, two, score = (np.concatenate(c) for c in zip(none, *out))
        crowded = not everything and len(one) > CROWD * len(ids)
        if crowded:
            order = np.lexsort((ids[two], -score, one))
            first = order[np.concatenate(([True], one[order][1:] != one[order][:-1]))]
            one, two, score = one[first], two[first], score[first]
        return ids[one], ids[two], score, np.full(len(one), crowded), rows["token"][one]

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        found = {c: batch[c].to_numpy(zero_copy_only=False) for c in key + numbers}
        return found | {"profile": _unpacked(batch["profile"])}

    def run(batches: Iterator[pa.RecordBatch]):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = columns(batch)
            if kept:
                now = {c: np.concatenate((kept[c], now[c])) for c in now}
            change = np.zeros(len(now["id"]), bool)
            for c in key:
                change[1:] |= now[c][1:] != now[c][:-1]
            edges = [0, *np.flatnonzero(change).tolist()]
            found = []
            for a, b in zip(edges, edges[1:]):
                found.append(hold({c: v[a:b] for c, v in now.items()}))
            kept = {c: v[edges[-1] :] for c, v in now.items()}
            if found:
                yield pairs_of(found)
        if kept:
            yield pairs_of([hold(kept)])

    def pairs_of(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        u, v, score, crowded, token = (np.concatenate(c) for c in zip(*found))
        columns = [pa.array(u), pa.array(v), pa.array(score), pa.array(token, mask=~crowded)]
        return pa.RecordBatch.from_arrays(columns, ["u", "v", "score", "open"])

    return dealt.mapInArrow(run, "u long, v long, score double, open long")


def _token_lists(groups: DataFrame) -> DataFrame:
    """The groups of each prefix shingle that several have, beside the pivot of its list."""
    # Dealt by token once: the lists are summed where their rows lie, and joined back without another exchange.
    tokens = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    # The join would filter its side alone otherwise, and that would make two exchanges.
    tokens = tokens.where("token is not null").repartition("token")
    lists = tokens.groupBy("token").agg(
        F.count("*").alias("size"),
        F.min(F.struct(_unit("gid").alias("unit"), "gid", "n", "pos")).alias("pivot"),
        F.bit_xor(F.xxhash64("gid")).alias("mark"),
        F.max("gid").alias("last"),
    )
    # Of lists with the same members one is enough: that of the least token, since tokens are
    # in order and it has the foremost place in all of them.
    same = lists.where("size > 1").groupBy("size", "mark", "last", "pivot.gid")
    lists = same.agg(F.min_by(F.struct("token", "size", "pivot"), "token").alias("l")).select("l.*")
    return tokens.join(lists, "token").select(
        "token", "gid", "n", "pos", F.col("pivot.gid").alias("p_gid"), F.col("pivot.n").alias("p_n"),
        F.col("pivot.pos").alias("p_pos"),
    )


def _by_length(lists: DataFrame, percent: int) -> DataFrame:
    """Lists cut by set size, with a new token for each part.

    The sizes of two sets that may link are in the same step of ``100 / percent`` or in neighbouring
    ones. The part of a step has the sets of the step, and as ``second`` those of the step above it.
    """
    step = F.floor(F.log("n") / (math.log(100 / percent) + 1e-9))  # wider than the ratio by more than rounding
    own = F.explode(F.array(F.struct(step.alias("step"), F.lit(False).alias("second")), F.struct((step - 1).alias("step"), F.lit(True).alias("second"))))
    columns = [c for c in lists.columns if c != "token"]
    return lists.select("token", *columns, own.alias("cell")).select(
        F.xxhash64("token", "cell.step").alias("token"), *columns, "cell.second"
    )


def jaccard_components(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """Groups of documents linked by shingle sets with a Jaccard similarity of ``percent``.

    Texts are split at ASCII white space with A-Z in lower case; a text of fewer than
    ``shingle`` words is one shingle, and one without words links with nothing. All
    arithmetic on the threshold is in whole numbers.

    The join is grouped. Equal sets are one class. The shingles of a class are ordered by
    how often their sketch bucket occurs in all documents, then by hash; classes of the same
    size and prefix form a group. Groups that share a prefix shingle and pass the length and
    position filters are candidates; members are verified on their full sets. In each list
    of a shingle, all groups are first held against one pivot. Lists that then still hold
    members of two or more components besides the pivot are cut by set size and into blocks; blocks
    meet in a task each, where an upper bound on the overlap of two sets leaves few pairs to verify.
    Before whole sets move, finer counters bound the overlap again. Where it leaves many, in
    rounds each member proposes its best partner; once no proposal holds, all that the bound leaves are
    verified. No block of a list meets another outside a task of its own, no pair inside a component is
    verified, and no pair between components is left out.

    Rows that share a doc_id are one document: it links where any of its texts does. Rows
    without a doc_id get no component. Other columns are ignored; every input row gives one.

    Returns doc_id, n_shingles, component_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = _frequency_levels(docs, shingle)
    read = stage(_signatures(docs, levels, shingle, percent), "jaccard-signatures")
    classes = stage(
        read.where("n > 0 and doc_id is not null")
        .groupBy("n", "sig1", "sig2")
        .agg(F.min("doc_id").alias("id"), F.first("prefix").alias("prefix"), F.first("profile").alias("profile"))
        .withColumn("group_key", F.xxhash64("n", "prefix")),
        "jaccard-classes",
    )
    grouped = classes.groupBy("n", "group_key", "prefix").agg(F.min("id").alias("gid"), F.count("*").alias("members"))
    groups = stage(grouped, "jaccard-groups")
    many = groups.where("members > 1").select("n", "group_key", "prefix", "gid")
    met = stage(_token_lists(groups), "jaccard-lists")
    # Most groups have one class: the prefixes of the others only are dealt again, where their keys are few.
    keys = stage(many.select("group_key"), "jaccard-many")
    held = classes
    if keys.count() <= BROADCAST_IDS:
        held = classes.join(F.broadcast(keys), "group_key", "left_semi")
    same_prefix = held.join(many, ["n", "group_key", "prefix"]).select("id", "gid", "n")
    inside = stage(same_prefix, "jaccard-members")
    discard(keys)
    pairs = (
        met.where("gid <> p_gid")
        .where(_may_link(percent, "", "p_"))
        .select(F.col("gid").alias("u"), F.col("p_gid").alias("v"))
        .union(inside.where("id <> gid").select(F.col("id").alias("u"), F.col("gid").alias("v")))
        .distinct()
    )

    def verified(candidates: DataFrame) -> DataFrame:
        asked = stage(candidates, "jaccard-pairs")
        links = _verified(docs, asked, shingle, percent)
        discard(asked)
        return links

    def joined(links: DataFrame) -> DataFrame:
        """The components so far, with more links between them."""
        return connected_components(components.select(F.col("id").alias("u"), F.col("component").alias("v")).union(links))

    profiles = classes.select("id", "n", "profile")
    first = verified(_within_bound(pairs, profiles, percent))
    components = connected_components(first.union(_shared_ids(read, classes)))
    discard(first)

    # Lists of classes by shingle, and by group. All but those of ``apart`` were held against the pivot.
    others = inside.where("id <> gid").select("id", "gid")
    pivot = "gid = p_gid and n = p_n and pos = p_pos"
    entries = (
        met.selectExpr("token", "gid as id", "n", "pos", "false as apart", f"{pivot} as pivot")
        .union(met.join(others, "gid").selectExpr("token", "id", "n", "pos", "true", "false"))
        .union(inside.selectExpr("xxhash64('group', gid)", "id", "n", "0", "false", "id = gid"))
    )

    def open_lists(rows: DataFrame) -> DataFrame:
        """What is left of the lists that hold members of two components which no pivot has met."""
        rest = F.when(~F.col("pivot"), F.col("part"))
        lists = rows.groupBy("token").agg(
            F.bool_or("apart").alias("all"),
            F.bool_and("second").alias("second"),
            *(f(c).alias(f"{name}_{of}") for f, name in ((F.min, "low"), (F.max, "high")) for c, of in (("part", "all"), (rest, "rest"))),
        )
        unsettled = lists.where("not second and if(all, low_all < high_all, low_rest < high_rest)").select("token", "all")
        return stage(rows.join(unsettled, "token").where("all or not pivot").drop("all"), "jaccard-open")

    def with_parts(rows: DataFrame) -> DataFrame:
        parts = components.withColumnsRenamed({"id": "c_id"})
        return rows.join(parts, F.col("id") == F.col("c_id"), "left").select(
            *rows.columns, F.coalesce("component", "id").alias("part")
        )

    left = open_lists(_by_length(with_parts(entries), percent))
    discard(met, inside, groups)
    everything = False
    while not left.isEmpty():
        may = stage(_across(left, profiles, percent, everything), "jaccard-may")
        # Where the bound leaves many, each member proposes the most similar one of another component.
        crowded = may.where("open is not null")
        best = crowded.groupBy("u").agg(F.max(F.struct("score", "v")).alias("b")).select("u", "b.v")
        asked = may.where("open is null").select("u", "v").union(best)
        found = verified(asked.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        # Of the other lists nothing is left. Once no proposal holds, all pairs of these are verified.
        everything = found.isEmpty()
        before, components = components, joined(found)
        discard(before, found)
        before = left
        rest = left.drop("part").join(crowded.select(F.col("open").alias("token")).distinct(), "token", "left_semi")
        left = open_lists(with_parts(rest))
        discard(before, may)
    discard(left)
    labels = classes.join(components.withColumnRenamed("id", "c_id"), F.col("id") == F.col("c_id"), "left").select(
        "n", "sig1", "sig2", F.coalesce("component", "id").alias("component_id")
    )
    labelled = read.join(labels, ["n", "sig1", "sig2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
    result = stage(labelled, "jaccard-components")
    discard(read, classes, components)
    return result
