"""Near duplicates by a chosen-path set similarity join.

Every document is a set of word shingles with a minwise signature. In each of
several independent trees a node holds the documents that agree on the minwise
tokens chosen along its path, and branches them by a few more coordinates, which
the path itself chooses. Nodes that are small enough are compared exhaustively on
signatures; a large node most of whose documents are like one of a few of them, as
one of thousands of copies, passes on whole, and so do nodes that stay large to the
last level. Documents that this puts together, directly or in a chain,
form a candidate group, and within groups links are confirmed on full sets.

With BRANCHES = 2 and a similarity of 0.75 a pair stays together in a tree of any
depth with a chance of 8/9 or more (the fixed point of the branching process),
so six trees miss a pair with a chance of about 2e-6. The signature comparison
in small nodes admits pairs from five standard deviations below the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import blocks
from fathom.llm.base import bounded_batches, connected, written

SHINGLE, SIMILARITY = 5, 75
COORDINATES, TREES, BRANCHES, LEVELS = 128, 6, 2, 4
#: Documents of a node that is compared exhaustively.
LEAF = 256
#: Documents of a larger node that all its documents are compared with. One alone may
#: be an outlier of its group, which would then be branched at every level.
PIVOTS = 8
#: Share of a larger node's documents like one of its pivots from which it is one group of
#: copies: it passes on whole, with the others too, so that confirmation decides.
PURE = 0.75
#: Documents of a candidate group, or block of one, that a task confirms at once.
GROUP = 1000
#: Documents of a node for each of the salts that it is dealt out over.
SALTED = 2000
_FACTORS = blocks.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_TERMS = blocks.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(20))


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lower-cased, words split
    at ASCII white space, all words as one shingle if they are fewer than `size`."""
    for _, _, data, offsets in blocks.text_slices(column):
        data = blocks.LOWER[data]
        start, end, text = blocks.words(data, offsets, blocks.SOLID)
        hashes = blocks.span_hashes(data, start, end)
        n = len(offsets) - 1
        per = np.bincount(text, minlength=n)
        base = np.append(0, np.cumsum(per))
        grams, _ = blocks.runs(hashes, text, size)
        short = {m: blocks.runs(hashes, text, m)[0] for m in range(1, size) if (per == m).any()}
        for d in range(n):
            m = int(per[d])
            if m >= size:
                yield np.unique(grams[base[d] : base[d + 1] - size + 1])
            else:
                yield short[m][base[d] : base[d] + 1] if m else np.zeros(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """COORDINATES minwise hashes of a set, 64 bits each."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 256):
        np.minimum(least, (found[at : at + 256, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return least


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, ids, least = [], [], []
        for found in shingle_sets(batch.column("text")):
            n.append(len(found))
            ids.append(hashlib.md5(found.tobytes()).digest() if len(found) else None)
            least.append(signature(found))
        signs = np.stack(least) if least else np.zeros((0, COORDINATES), np.uint64)
        roots = np.concatenate([_children(np.full(len(signs), t + 1, np.uint64), signs) for t in range(TREES)], axis=1)
        planes = (signs >> np.uint64(32)).astype("<u2")
        empty = np.array(n, np.int64) == 0
        nodes = pa.array(list(roots.view(np.int64)), pa.list_(pa.int64()), mask=empty)
        low, high = (pa.array([x.tobytes() for x in plane], pa.binary(), mask=empty) for plane in (planes.astype(np.uint8), (planes >> 8).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), nodes, low, high], ["doc_id", "n_shingles", "set_id", "roots", "low", "high"])


def _plane(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _coordinates(batch: pa.RecordBatch) -> np.ndarray:
    return _plane(batch.column("low")) | _plane(batch.column("high")).astype(np.uint16) << 8


def _children(node: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The nodes that each document goes to from its node: one for each of the
    coordinates that the node chooses."""
    out, row = [], np.arange(len(node))
    for k in range(BRANCHES):
        chosen = blocks.mix(node + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at = (chosen % np.uint64(COORDINATES // BRANCHES)).astype(np.int64) + k * (COORDINATES // BRANCHES)
        out.append(blocks.mix(chosen ^ blocks.mix(signs[row, at].astype(np.uint64))))
    return np.stack(out, axis=1)


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            nodes = _children(np.array(batch.column("node")).view(np.uint64), _coordinates(batch))
            rest = batch.select(["rep", "low", "high"]).take(np.repeat(np.arange(batch.num_rows), BRANCHES))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), *rest.columns], ["node", *rest.schema.names])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by keys, several at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last, strict=True):
            same &= np.array(batch.column(k)) == v
        cut = batch.num_rows - int(same.sum())
        if cut or (held and [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys] != last):
            ready = [*held, batch.slice(0, cut)]
            yield pa.Table.from_batches([b for b in ready if b.num_rows])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare(least: int):
    """Links every document of a node to the first one of those it is like."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["node"]):
            node, rep = np.array(rows.column("node")), np.array(rows.column("rep"))
            signs = _plane(rows.column("low"))
            a, b = [], []
            for lag in range(1, LEAF):
                at = np.flatnonzero(node[:-lag] == node[lag:])
                if not len(at):
                    break
                for some in np.array_split(at, max(1, len(at) // 4096)):
                    alike = some[(signs[some] == signs[some + lag]).sum(axis=1) >= least]
                    a.append(alike)
                    b.append(alike + lag)
            if a:
                label = _settle(len(node), np.concatenate(a), np.concatenate(b))
                at = np.flatnonzero(label != np.arange(len(label)))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[label[at]])], ["a", "b"])

    return compare


def _alike(least: int):
    """Which of its node's pivots each document is like, one bit for each."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pivots = _plane(batch.column("pivots").flatten()).reshape(batch.num_rows, -1, COORDINATES)
                same = (_plane(batch.column("low"))[:, None] == pivots).sum(axis=2) >= least
                bits = (same << np.arange(same.shape[1])).sum(axis=1)
                kept = ["node", "salt", "salts", "rep", "low", "high", "first"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bits)], [*kept, "alike"])

    return alike


def least_matches(similarity: int) -> int:
    """Equal coordinates of two signatures from which on sets are compared: five standard
    deviations below what the similarity leads to expect."""
    p = similarity / 100
    return int(np.floor(COORDINATES * p - 5 * np.sqrt(COORDINATES * p * (1 - p))))


def candidates(reps: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(a, b): pairs that connect the candidate groups of reps (rep, roots, low, high):
    the nodes of level 0, which take whole hashes, so that unlike documents don't
    meet by chance, and two bytes of each coordinate. Documents are compared on the low bytes alone, which
    can only let more pairs through. Signatures join the nodes of more than one
    document once, at the root, and stay with them from there."""
    least = least_matches(similarity)
    nodes, pairs = written(reps.select(F.explode("roots").alias("node"), "rep"), "nodes"), None
    for level in range(LEVELS):
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("first")).where("n > 1")
        members = nodes.join(sizes, "node").withColumn("first", F.when(F.col("n") > LEAF, F.col("first"))).withColumn("salts", F.ceil(F.col("n") / SALTED)).drop("n")
        members = written(members if level else members.join(reps.drop("roots"), "rep"), "members")
        small = members.where("first is null").select("node", "rep", "low").repartition("node").sortWithinPartitions("node", "rep").mapInArrow(_compare(least), "a long, b long")
        large = members.where("first is not null")
        last = level == LEVELS - 1 or large.isEmpty()
        if not last:
            # a node of very many documents is dealt out over salts, and what joins it is repeated for each
            each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
            salted = large.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")))
            part = F.pmod(F.xxhash64("rep"), F.lit(PIVOTS)).alias("part")
            pivots = large.groupBy("node", "salts", part).agg(F.min_by("low", "rep").alias("low")).groupBy("node", "salts").agg(F.sort_array(F.collect_list("low")).alias("low"))
            pivots = pivots.select("node", each, F.slice(F.concat("low", F.array_repeat(F.col("low")[0], PIVOTS)), 1, PIVOTS).alias("pivots"))
            alike = salted.join(pivots, ["node", "salt"]).select("node", "salt", "salts", "rep", "low", "high", "first", "pivots")
            alike = written(alike.mapInArrow(_alike(least), "node long, salt long, salts long, rep long, low binary, high binary, first long, alike long"), "alike")
            share = F.greatest(*(F.avg(F.getbit("alike", F.lit(k)).cast("int")) for k in range(PIVOTS)))
            mixed = alike.groupBy("node", "salts").agg(share.alias("share")).where(F.col("share") < PURE).select("node", each)
            onward, large = alike.join(mixed, ["node", "salt"], "left_semi"), alike.join(mixed, ["node", "salt"], "left_anti")
        found = small.union(large.where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")))
        pairs = found if pairs is None else pairs.union(found)
        if last or mixed.isEmpty():
            break
        nodes = written(onward.mapInArrow(_branch, "node long, rep long, low binary, high binary").dropDuplicates(["node", "rep"]), "nodes")
    return pairs


def _links(sets: list[np.ndarray], similarity: int, fixed: np.ndarray | None = None) -> np.ndarray:
    """The component of each set: breadth-first over the links, comparing a set only
    with those that no component has yet. With `fixed`, sets of one label are
    already connected, and only those of other labels are compared."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, 0 if 100 * both >= similarity * (size.sum() - both) else 1])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.append(0, np.cumsum(size))
    mark = np.zeros(int(codes.max()) + 1, bool)
    label, open_ = np.full(n, -1), np.arange(n)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        queue = [seed] if fixed is None else np.flatnonzero(fixed == fixed[seed]).tolist()
        label[queue] = seed
        open_ = open_[label[open_] < 0]
        while queue and len(open_):
            one = queue.pop()
            near = open_[(100 * size[open_] >= similarity * size[one]) & (similarity * size[open_] <= 100 * size[one])]
            if not len(near):
                continue
            mark[codes[at[one] : at[one + 1]]] = True
            length = size[near]
            begin = np.cumsum(length) - length
            inside = mark[codes[np.arange(int(length.sum())) + np.repeat(at[near] - begin, length)]]
            both = np.add.reduceat(inside.astype(np.int64), begin)
            mark[codes[at[one] : at[one + 1]]] = False
            new = near[100 * both >= similarity * (length + size[one] - both)]
            if len(new):
                if fixed is not None:
                    new = np.flatnonzero(np.isin(fixed, np.unique(fixed[new])) & (label < 0))
                label[new] = seed
                queue += new.tolist()
                open_ = open_[label[open_] < 0]
    return label


def _confirm(similarity: int):
    """Rows (part, block, rep, label, set_id, text): (rep, low), the smallest document
    of its component in the block. A row whose text is not that of its set_id is one
    of another row with the same doc_id and is passed over."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["part", "block"]):
            part, block = np.array(rows.column("part")), np.array(rows.column("block"))
            rep, label, ids = np.array(rows.column("rep")), np.array(rows.column("label")), rows.column("set_id").to_pylist()
            cut = np.flatnonzero((part[1:] != part[:-1]) | (block[1:] != block[:-1])) + 1
            texts = rows.column("text")
            out_a, out_b = [], []
            for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(part)).tolist(), strict=True):
                found = list(shingle_sets(texts.slice(a, b - a)))
                seen: dict[bytes, int] = {}
                for k, s in enumerate(found):
                    if hashlib.md5(s.tobytes()).digest() == ids[a + k]:
                        seen.setdefault(ids[a + k], k)
                own = list(seen.values())
                if len(own) < 2:
                    continue
                who, tag = rep[a:b][own], label[a:b][own]
                got = _links([found[k] for k in own], similarity, None if (tag == who).all() else tag)
                low = np.full(len(own), np.iinfo(np.int64).max)
                np.minimum.at(low, got, who)
                out_a.append(who)
                out_b.append(low[got])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["rep", "low"])

    return confirm


def _likely(least: int):
    """Of rows (part, block, rep, label, set_id, low) those whose signature is like that of a
    row of their block with another label; repeats go."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["part", "block"]):
            rows = rows.combine_chunks()
            part, block, rep, label = (np.array(rows.column(c)) for c in ("part", "block", "rep", "label"))
            cut = np.flatnonzero((part[1:] != part[:-1]) | (block[1:] != block[:-1])) + 1
            signs = _plane(rows.column("low"))
            for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(part)).tolist(), strict=True):
                own = a + np.unique(rep[a:b], return_index=True)[1]
                kept = np.zeros(len(own), bool)
                for at in range(0, len(own), 16):
                    some = own[at : at + 16]
                    alike = (signs[some][:, None] == signs[own][None]).sum(axis=2) >= least
                    kept[at : at + 16] = (alike & (label[some][:, None] != label[own][None])).any(axis=1)
                if kept.any():
                    yield from rows.take(pa.array(own[kept])).select(["part", "block", "rep", "label", "set_id"]).to_batches()

    return likely


def _confirmed(rows: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """rows (part, block, rep, label, set_id) with texts: links of the confirmed components."""
    full = rows.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep").select("part", "block", "rep", "label", "set_id", "text")
    return full.repartition("part", "block").sortWithinPartitions("part", "block", "rep").mapInArrow(_confirm(similarity), "rep long, low long")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, group: int = GROUP) -> DataFrame:
    """Groups documents (doc_id, text) whose shingle sets have a Jaccard similarity
    of `similarity` percent or more, directly or in a chain.

    Returns for each row doc_id, n_shingles, component_id (the smallest doc_id
    that its links reach) and kept (doc_id = component_id). Texts without words,
    null or empty, are linked with nothing; a row without doc_id has a null
    component_id and is kept. Rows with one doc_id are one document, linked where
    any of its texts is. Exact copies are one set throughout and cost one
    comparison. A candidate group of over `group` documents is confirmed in
    blocks, each with the group's first document; what is not connected to that
    one is dealt into sides of `group` documents, and each side is compared with each
    block, so no link between components is lost and a task holds two blocks at most.
    Sides and blocks meet with signatures of 128 bytes a document; only documents whose
    signatures are like one of another component go on with their texts.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(texts.mapInArrow(_signed, "doc_id long, n_shingles long, set_id binary, roots array<long>, low binary, high binary"), "signed")
    reps = written(signed.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("roots", "low", "high"))), "reps")
    pairs = written(candidates(reps.drop("set_id"), similarity), "pairs")
    parts = written(connected(pairs, "a", "b"), "parts")
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    members = parts.join(sizes, "component").join(reps.select(F.col("rep").alias("node"), "set_id"), "node")
    members = members.select(F.col("component").alias("part"), F.when(F.col("n") > group, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / group))).otherwise(0).cast("long").alias("block"), F.col("node").alias("rep"), F.col("node").alias("label"), "set_id", F.ceil(F.col("n") / group).alias("blocks"))
    members = written(members, "members")
    texts = written(texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    shape = ["part", "block", "rep", "label", "set_id"]
    first = members.where("rep = part and blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    links = written(_confirmed(members.select(shape).union(first.select(shape)).distinct(), texts, similarity), "links")
    big = members.where("blocks > 1")
    if not big.isEmpty():
        known = connected(links.join(big.select("rep"), "rep", "left_semi"), "rep", "low")
        now = big.join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
        now = written(now.join(reps.select("rep", "low"), "rep"), "labelled")
        # what holds for a whole group is repeated for its blocks, so that no join deals a group to one task
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        main = now.where("rep = part").select("part", F.col("label").alias("main"), upto("blocks").alias("block"))
        apart = now.join(main, ["part", "block"]).where("label <> main")
        sides = apart.groupBy("part", "blocks").agg(F.ceil(F.count("*") / group).alias("sides")).select("part", "sides", upto("blocks").alias("block"))
        apart = apart.join(sides, ["part", "block"])
        pair = (F.col("block") * F.col("sides") + F.col("side")).alias("block")
        one = apart.withColumn("side", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("sides"))).withColumn("block", upto("blocks"))
        two = now.join(sides, ["part", "block"]).withColumn("side", upto("sides"))
        both = [x.select("part", pair, "rep", "label", "set_id", "low") for x in (one, two)]
        both = both[0].union(both[1]).repartition("part", "block").sortWithinPartitions("part", "block", "rep")
        some = written(both.mapInArrow(_likely(least_matches(similarity)), "part long, block long, rep long, label long, set_id binary"), "likely")
        links = links.union(written(_confirmed(some, texts, similarity), "links"))
    # texts that share an id are one document
    owned = signed.where("set_id is not null and doc_id is not null").select("doc_id", "set_id").distinct().join(reps.select("set_id", "rep"), "set_id")
    shared = owned.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id", "low")
    links = links.union(owned.join(shared, "doc_id").select("rep", "low"))
    final = connected(links.where("rep <> low"), "rep", "low").select(F.col("node").alias("rep"), "component")
    of = reps.select("set_id", "rep").join(final, "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component_id"))
    whole = signed.select("doc_id", "n_shingles", "set_id").join(of, "set_id", "left")
    return whole.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
