"""Exact Jaccard join of documents on word n-grams, by vertical partitions of the n-gram order.

The order of all n-grams is that of their 64-bit numbers, cut into fragments. What is known of a fragment's
n-grams is counted in its task alone and summed over the fragments: first how many n-grams of a document no
other document has, which leaves only documents that can have a partner, then the overlap of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluentrail.llm.common import steps, stored
from fluentrail.llm.components import components
from fluentrail.llm.shingles import mix, sets, signature

#: Documents are linked when 100 * common >= PERCENT * all of their n-grams.
PERCENT = 80
#: Part of the order in which n-grams of one document alone are counted. Documents of which enough are found
#: there are done; any part gives the same result.
COUNTED = 0.4
#: N-grams of a fragment and pairs of a block, about.
FRAGMENT, BLOCK = 1 << 21, 10_000
#: Fragments in which the overlap of pairs is counted.
PAIR_FRAGMENTS = 4
#: Keys by which a document meets others that are probably like it.
KEYS = 4
#: Columns of a document's bitmap, 64 places each.
PARITY = [f"parity{i}" for i in range(8)]
_SALTS = np.random.default_rng(8).integers(1, 1 << 63, KEYS, dtype=np.uint64)
HEAD = "key long, sig long, n long"
SET = "key long, sig long, n long, grams binary"


def _signatures(with_grams: bool):
    names = ["key", "sig", "n"] + ["grams"] * with_grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                found = list(sets(part.column(1)))
                columns = [part.column(0), pa.array([signature(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64())]
                if with_grams:
                    columns.append(pa.array([s.tobytes() for s in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _by_fragment(ids: np.ndarray, labels: np.ndarray, grams: list[np.ndarray], fragments: int, share: float) -> pa.RecordBatch:
    """A row per fragment: its documents, their labels, how many n-grams each has there, and the n-grams' low halves."""
    counts = np.array([len(g) for g in grams], np.int64)
    every = np.concatenate(grams) if len(grams) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(grams), dtype=np.int32), counts)
    place = (every >> np.uint64(32)).astype(np.int64)
    top = int(share * (1 << 32))
    if share < 1:
        inside = place < top
        every, owner, place = every[inside], owner[inside], place[inside]
    place = place * fragments // top
    order = np.argsort(place, kind="stable")
    every, owner, place = every[order].astype(np.uint32), owner[order], place[order]
    cuts = np.searchsorted(place, np.arange(fragments + 1))
    rows = []
    for f in range(fragments):
        low, high = cuts[f], cuts[f + 1]
        if low < high:
            who, n = np.unique(owner[low:high], return_counts=True)
            rows.append((f, ids[who].tobytes(), labels[who].tobytes(), n.astype(np.uint32).tobytes(), every[low:high].tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["fragment", "ids", "labels", "counts", "grams"])


FRAGMENTS = "fragment int, ids binary, labels binary, counts binary, grams binary"


def _own_grams(table: pa.Table) -> pa.Table:
    """How many n-grams of each document in a fragment occur under its own label only, and which of them in order."""

    def joined(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    ids, labels, counts, grams = joined("ids", np.int64), joined("labels", np.int64), joined("counts", np.uint32), joined("grams", np.uint32)
    _, first, place = np.unique(ids, return_index=True, return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), counts)
    once = (first[place] == np.arange(len(ids)))[owner]  # equal sets count as one
    owner, grams = owner[once], grams[once]
    order = np.argsort(grams, kind="stable")
    owner, grams = owner[order], grams[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
    if not len(starts):
        return pa.table({"sig": pa.array([], pa.int64()), "own": pa.array([], pa.int64()), "fragment": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())})
    label = labels[owner]
    alone = np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts)
    flags = np.zeros(len(grams), bool)
    flags[order] = np.repeat(alone, np.diff(np.append(starts, len(grams))))  # back in the documents' order
    cuts = np.cumsum([0, *np.where(first[place] == np.arange(len(ids)), counts, 0).tolist()], dtype=np.int64)
    some = [i for i in range(len(ids)) if flags[cuts[i] : cuts[i + 1]].any()]
    own = np.array([flags[cuts[i] : cuts[i + 1]].sum() for i in some], np.int64)
    bits = [np.packbits(flags[cuts[i] : cuts[i + 1]]).tobytes() for i in some]
    number = [table.column("fragment")[0].as_py()] * len(some)
    return pa.table({"sig": pa.array(ids[some], pa.int64()), "own": own, "fragment": pa.array(number, pa.int32()), "bits": pa.array(bits, pa.binary())})


def own_counts(fragments: DataFrame, marks: bool = False) -> DataFrame:
    """``sig, own``: summed over the fragments, the n-grams that no document of another label has; with ``marks`` also which."""
    found = fragments.groupBy("fragment").applyInArrow(_own_grams, "sig long, own long, fragment int, bits binary")
    which = [F.collect_list(F.struct("fragment", "bits")).alias("marks")] * marks
    return found.groupBy("sig").agg(F.sum("own").alias("own"), *which)


def _cut_texts(fragments: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, found, held = [], [], 0
            for part in steps(batch, 0):
                for every in sets(part.column(0)):
                    if len(every):
                        sigs.append(signature(every))
                        found.append(every[: np.searchsorted(every, np.uint64(int(share * (1 << 32)) << 32))])
                        held += len(found[-1])
                if held >= FRAGMENT:
                    ids = np.array(sigs, np.int64)
                    yield _by_fragment(ids, ids, found, fragments, share)
                    sigs, found, held = [], [], 0
            ids = np.array(sigs, np.int64)
            yield _by_fragment(ids, ids, found, fragments, share)

    return run


def _cut_sets(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(g, np.uint64) for g in batch.column(2).to_pylist()]
            yield _by_fragment(batch.column(0).to_numpy(), batch.column(1).to_numpy(), grams, fragments, 1.0)

    return run


def _possible(own: Column, n: Column) -> Column:
    """Whether the n-grams that others have too suffice for a partner."""
    return 100 * (n - F.coalesce(own, F.lit(0))) >= PERCENT * n


def overlaps(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """``a, b, common`` of the pairs ``a, b`` of signatures in ``known``.

    A pair goes to the block of both documents' hashes, of which there are enough for about ``BLOCK`` pairs each,
    so that neither a document with very many pairs nor a dense group weighs on one block. A block counts its
    pairs fragment by fragment, and the counts are summed per pair.
    """
    side = max(2, math.ceil(math.sqrt(pairs.count() / BLOCK)))
    block = F.pmod(F.xxhash64("a"), F.lit(side)) * side + F.pmod(F.xxhash64("b", F.lit(1)), F.lit(side))
    dealt = pairs.select("a", "b", block.cast("int").alias("block"))
    wanted = dealt.select("block", F.col("a").alias("sig")).union(dealt.select("block", F.col("b").alias("sig"))).distinct()
    fragment = F.explode(F.sequence(F.lit(0), F.lit(PAIR_FRAGMENTS - 1)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([i * (1 << 64) // PAIR_FRAGMENTS for i in range(1, PAIR_FRAGMENTS)], np.uint64)
        for batch in batches:
            out = []
            for b, sig, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                every = np.frombuffer(grams, np.uint64)
                out += [(b, f, sig, part.tobytes()) for f, part in enumerate(np.split(every, np.searchsorted(every, edges))) if len(part)]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["block", "fragment", "sig", "grams"])

    def count(segments: pa.Table, asked: pa.Table) -> pa.Table:
        grams = {s: np.frombuffer(g, np.uint64) for s, g in zip(segments.column("sig").to_pylist(), segments.column("grams").to_pylist(), strict=True)}
        none = np.empty(0, np.uint64)
        a, b = asked.column("a").to_pylist(), asked.column("b").to_pylist()
        common = []
        for x, y in zip(a, b, strict=True):
            one, other = grams.get(x, none), grams.get(y, none)
            if len(one) > len(other):
                one, other = other, one
            at = np.searchsorted(other, one)
            common.append(int((other[np.minimum(at, len(other) - 1)] == one).sum()) if len(one) else 0)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "common": pa.array(common, pa.int64())})

    segments = known.select("sig", "grams").join(wanted.hint("merge"), "sig").select("block", "sig", "grams").mapInArrow(cut, "block int, fragment int, sig long, grams binary")
    asked = dealt.withColumn("fragment", fragment)
    counted = segments.groupBy("block", "fragment").cogroup(asked.groupBy("block", "fragment")).applyInArrow(count, "a long, b long, common long")
    return counted.groupBy("a", "b").agg(F.sum("common").alias("common"))


def _linked(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b, n_a, n_b`` that are links."""
    sizes = pairs.select("a", "b", "n_a", "n_b")
    common = overlaps(pairs.select("a", "b"), known).join(sizes, ["a", "b"])
    return common.filter(100 * F.col("common") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _alike(n_a: Column, n_b: Column) -> Column:
    return 100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Under each of some permutations the smallest n-gram of each document."""
    for batch in batches:
        sigs, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = []
        for sig, n, grams in zip(sigs, sizes, batch.column(2).to_pylist(), strict=True):
            every = np.frombuffer(grams, np.uint64)
            rows += [(i, int(mix(every ^ salt).min().view(np.int64)), sig, n) for i, salt in enumerate(_SALTS)]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["i", "gram", "sig", "n"])


PREFIX = "gram long, sig long, n long, label long, most long, left long"


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document, for each place of a bitmap, whether an odd number of its n-grams falls there."""
    for batch in batches:
        bits = np.zeros((batch.num_rows, 64 * len(PARITY)), np.uint8)
        for row, grams in zip(bits, batch.column(1).to_pylist(), strict=True):
            at = np.frombuffer(grams, np.uint64) % np.uint64(len(row))
            row[:] = np.bincount(at.astype(np.int64), minlength=len(row)) & 1
        longs = np.packbits(bits, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(longs[:, i]) for i in range(len(PARITY)))], ["sig", *PARITY])


def _least_difference(other: str) -> Column:
    """N-grams that only one of two documents has are at least as many as the places in which their bitmaps differ."""
    differ = [F.bit_count(F.col(p).bitwiseXOR(F.col(p + other))).cast("long") for p in PARITY]
    return reduce(Column.__add__, differ)


def _size_class(n: Column) -> Column:
    """Numbers of classes of sizes that differ by a sixteenth."""
    return F.floor(F.log(n.cast("double")) * 16).cast("int")


def _prefixes(fragments: int):
    """The first n-grams in the order that other labels have too; documents of two labels that are linked share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *of_set, grams, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                every = np.frombuffer(grams, np.uint64)
                place = (every >> np.uint64(32)).astype(np.int64) * fragments >> 32
                other = np.ones(len(every), bool)
                for mark in marks or []:
                    low, high = np.searchsorted(place, [mark["fragment"], mark["fragment"] + 1])
                    other[low:high] = ~np.unpackbits(np.frombuffer(mark["bits"], np.uint8), count=high - low).astype(bool)
                first = every[other].view(np.int64)
                # what is common lies behind the first one met, and is four fifths of the document at least
                first, left = first[: max(0, len(first) + (-PERCENT * of_set[1]) // 100 + 1)], len(first)
                out.append((first, *(np.full(len(first), value) for value in of_set), left - np.arange(len(first))))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["gram", "sig", "n", "label", "most", "left"])

    return run


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose sets of five-word shingles are alike, as ``key, n_shingles, component_id``, a row per row.

    Two documents are linked when their intersection is at least 80 % of their union, exactly; the component is
    the smallest key that links reach. Words are runs of bytes other than white space, A-Z in lower case;
    fewer than five words are one shingle. A null or empty text, or one without words, has none and is linked
    with nothing: its component is its own key. A row without key has no component and links nothing.
    Repeated rows, and keys that several rows share, are linked as the one key they name. Other columns are left
    out; an empty table gives no rows.

    Shingles and sets are told apart by 64-bit numbers. Documents with equal sets count as one. Those of which
    over a fifth is found in no other document have no partner; the others are linked with the smallest one
    that has the same smallest shingle under some permutation, if the sets are alike, which joins groups of
    any size with few pairs. Only documents that share at least four fifths with documents of other groups are
    then compared across groups by prefixes, so no link between groups is lost. Bitmaps of the sets rule out most
    pairs of a large group of copies that are not alike enough before they become rows: the places in which two
    differ bound from below what only one of the sets has.
    """
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    heads = stored(source.mapInArrow(_signatures(False), HEAD), "jaccard-heads")
    classes = heads.filter("key is not null and n > 0").groupBy("sig", "n").agg(F.min("key").alias("first"))

    # n-grams that one set alone has, fragment by fragment
    total = classes.agg(F.sum("n")).first()[0] or 0
    fragments = max(8, math.ceil(COUNTED * total / FRAGMENT))
    signed = source.filter("key is not null").select("text").mapInArrow(_cut_texts(fragments, COUNTED), FRAGMENTS)
    own = own_counts(signed)
    open_classes = stored(classes.join(own, "sig", "left").filter(_possible(F.col("own"), F.col("n"))).select("sig", "n", "first"), "jaccard-open")

    # the sets that may have a partner
    wanted = open_classes.select(F.col("first").alias("key"), "sig").hint("merge")
    texts = source.join(wanted, "key").select("sig", "text")
    known = texts.mapInArrow(_signatures(True), SET).filter("key = sig")
    known = stored(known.select("sig", "n", "grams"), "jaccard-sets")

    # groups around the smallest document with the same key
    keyed = stored(known.mapInArrow(_keys, "i int, gram long, sig long, n long").join(open_classes.select("sig", "first"), "sig"), "jaccard-keys")
    top = keyed.groupBy("i", "gram").agg(F.min(F.struct("first", "sig", "n")).alias("head"), F.count("*").alias("size")).filter("size > 1").select("i", "gram", "head.sig", "head.n")
    top = top.withColumnsRenamed({"sig": "b", "n": "n_b"})
    near = keyed.join(top, ["i", "gram"]).filter("sig <> b").select(F.col("sig").alias("a"), "b", F.col("n").alias("n_a"), "n_b")
    pairs = stored(near.filter(_alike(F.col("n_a"), F.col("n_b"))).distinct(), "jaccard-near")
    links = stored(_linked(pairs, known), "jaccard-links")
    labels = components(links)

    # what may still be linked across groups
    label = F.coalesce("label", "sig").alias("label")
    labelled = known.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("sig", label, "grams", "n")
    size = max(8, math.ceil((known.agg(F.sum("n")).first()[0] or 0) / FRAGMENT))
    outside = own_counts(labelled.select("sig", "label", "grams").mapInArrow(_cut_sets(size), FRAGMENTS), marks=True)
    rest = labelled.join(outside, "sig", "left").filter(_possible(F.col("own"), F.col("n")))
    # common <= shared(x) and 9 * common >= 4 * (n(x) + n(y)), so a partner has at most 9/4 * shared(x) - n(x) n-grams
    rest = rest.withColumn("most", F.expr(f"({100 + PERCENT} * (n - coalesce(own, 0))) div {PERCENT} - n"))
    first = stored(rest.select("sig", "n", "label", "most", "grams", "marks").mapInArrow(_prefixes(size), PREFIX), "jaccard-prefixes")
    shared = first.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("gram")
    parities = known.select("sig", "grams").mapInArrow(_parities, ", ".join(["sig long", *(f"{p} long" for p in PARITY)])).distinct()
    first = stored(first.join(shared, "gram", "left_semi").distinct().join(parities, "sig"), "jaccard-shared")
    # the smaller of two linked sets must allow for the larger, so it allows for its own size; sizes meet in narrow classes
    small = first.filter("most >= n").withColumn("class", _size_class(F.col("n"))).withColumnsRenamed({"sig": "b", "n": "n_b", "label": "label_b", "most": "most_b", "left": "left_b"} | {p: f"{p}_b" for p in PARITY})
    least, up_to = -F.floor(-F.col("n") * PERCENT / 100), F.least("n", "most")
    large = first.filter(least <= up_to).withColumn("class", F.explode(F.sequence(_size_class(least), _size_class(up_to))))
    met = (F.col("label") != F.col("label_b")) & (F.col("n_b") <= up_to) & (F.col("n_b") >= least) & (F.col("n") <= F.col("most_b"))
    met &= (F.col("n") > F.col("n_b")) | (F.col("sig") < F.col("b")) | (F.col("most") < F.col("n"))
    # at the first n-gram that both have, what is left of either holds all that is common
    met &= (100 + PERCENT) * F.least("left", "left_b") >= PERCENT * (F.col("n") + F.col("n_b"))
    # in a group of copies that are nearly alike enough, most pairs end here and are never rows
    met &= (100 + PERCENT) * _least_difference("_b") <= (100 - PERCENT) * (F.col("n") + F.col("n_b"))
    across = large.join(small, ["gram", "class"]).filter(met)
    across = stored(across.select(F.col("sig").alias("a"), "b", F.col("n").alias("n_a"), "n_b").distinct(), "jaccard-across")
    if not across.isEmpty():
        links = stored(links.union(_linked(across, known)), "jaccard-links")
        labels = components(links)

    # components by the documents' own keys; rows that share a key join their sets' groups
    grouped = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("sig", label)
    members = heads.filter("key is not null and n > 0").join(grouped, "sig").select("key", "label").distinct()
    smallest = members.groupBy("label").agg(F.min("key").alias("smallest"))
    named = members.join(smallest, "label").select("key", "smallest")
    twice = named.groupBy("key").agg(F.countDistinct("smallest").alias("several")).filter("several > 1")
    if not twice.isEmpty():
        joined = components(named.select(F.col("key").alias("a"), F.col("smallest").alias("b")))
        named = joined.select(F.col("node").alias("key"), F.col("label").alias("smallest"))
    named = named.distinct()
    out = heads.join(named, "key", "left")
    alone = F.when(F.col("n") > 0, F.coalesce("smallest", "key")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), alone.alias("component_id"))
