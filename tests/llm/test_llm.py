"""The operators of the subpackage against brute force, on small tables with odd rows."""

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluentrail.llm import jaccard, mtree, packing, passages, pieces, projections, repeats, toxicity
from fluentrail.llm.fixity import audit, merkle_tree
from fluentrail.llm.preference import format_preferences

public_tokenizers = pytest.importorskip("public_tokenizers")
BASE = " ".join(f"w{i * 7919 % 997}x" for i in range(160))
ODD = [
    (1, BASE),
    (2, BASE),
    (3, BASE.replace("w5x", "other")),
    (4, BASE.upper() + " " + "tail words " * 3),
    (5, ""),
    (6, None),
    (7, "  \t\n "),
    (8, "one two"),
    (9, "ONE two"),
    (10, " ".join(f"z{i}" for i in range(90)) + " " + BASE[:420]),
    (11, "ñandú übergröße 日本 \U0001d11e " * 40),
    (12, "x" * 3000),
    (12, "x" * 3000),
    (None, BASE),
    (13, "\n\n a  b\x00c <s> ▁ <|endoftext|>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "a", "b", k) for k, t in ODD]
    # columns with names that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, id string, key string, label long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_pieces_as_the_library(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = pieces.load(path).library
    got = [(r.doc_id, list(r.ids), r.decoded) for r in pieces.encode_pieces(docs, path).collect()]
    wanted = [(k, library.encode(t or ""), library.decode(library.encode(t or ""))) for k, t in ODD]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert pieces.encode_pieces(empty, path).count() == 0


def test_both_agendas_join_alike():
    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    text = " " + "thereforeunbelievablyinternational" * 3
    long_way = model.merge(text)
    assert len(text) > pieces.SHORT
    at = [model.symbols.get(c, pieces.NO_SYMBOL) for c in text]
    assert long_way == model._ids(text, model._merge_listed(at))


def test_packing_keeps_each_id_once(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = packing.load(path).tokenizer
    rows = packing.pack(docs, path, capacity=64, group=4).collect()
    wanted = collections.Counter((k, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for k, t in ODD)
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.tokens].append((r.start, r.ids))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= 64
    for (key, ids), times in wanted.items():
        found = sorted((s, list(i)) for s, i in by_doc[key, len(ids)])
        if times == 1:
            assert [x for _, i in found for x in i] == list(ids)
        else:
            assert sum(len(i) for _, i in found) == times * len(ids)
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_names_are_sorted_without_a_copy_of_them_all(kind):
    name = np.random.default_rng(1).integers(0, 1 << 21, 1 << 20).astype(kind)
    tracemalloc.start()
    again = repeats._again(name)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (again == (np.bincount(name.astype(np.int64))[name.astype(np.int64)] > 1)).all()
    assert peak < 5.5 * len(name)


def test_only_new_parts_of_words_are_merged():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = packing.WordIds(path)
    signs = [chr(code) for code in range(1, 0x180) if chr(code) not in " \n"]
    texts = [a + b + c for a in signs for b in signs for c in ("", "'s")]
    texts += ["Haon, haon. HAON", "a<|startoftext|>b <|endoftext|>", "'LL've ''s x", "e\u0301 E\u0301x \u03a3\u03a3 \u4e2d", "", " ", "\n\na", None, "z" * 100]
    found, counts = ids.encode(pa.array(texts), 2)
    whole = [[*ids.tokenizer.encode(text or "", add_special_tokens=False).ids, 2] for text in texts]
    assert counts.tolist() == [len(own) for own in whole]
    assert found.tolist() == [i for own in whole for i in own]
    again = packing.WordIds(path)
    again.encode(pa.array(["Haon, haon. HAON haon"]), 2)
    assert set(again.parts) == {"haon", ",", "."}


def test_differencing_is_even():
    sizes = np.random.default_rng(1).integers(1, 2000, 300)
    window = packing.differencing(sizes, 12)
    sums = np.bincount(window, sizes, 12)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 5
    window, count = packing.windows_of(np.array([60, 60, 60]), 2, 100)
    assert count == 3 and sorted(window) == [0, 1, 2]
    lengths = np.random.default_rng(2).integers(1, 9000, 900)
    plan = packing.plan_windows(lengths, 4096)
    totals = collections.Counter()
    for _, _, length, sequence, _ in plan.pieces:
        totals[sequence] += length
    assert sum(totals.values()) == lengths.sum()
    assert not any(n & (n - 1) for n in totals.values())


def brute_groups(rows):
    sets = {}
    for key, text in rows:
        if key is not None:
            w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
            sets[key] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    return {k: (len(sets[k]), label[k]) for k in sets}


def test_jaccard_join(docs, empty):
    rows = jaccard.link_documents(docs).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == brute_groups(ODD)
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert jaccard.link_documents(empty).count() == 0


def test_jaccard_join_of_a_loose_group(spark):
    """Copies that are linked only through others, far from the one with the smallest id."""
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(60)]
    rows = []
    for key in range(60):
        own = list(words)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            own[at] = f"n{rng.integers(0, 30)}"
        rows.append((key, " ".join(own[: rng.integers(45, 60)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(df).collect()} == brute_groups(rows)


def test_bitmaps_never_differ_in_more_places_than_sets():
    rng = np.random.default_rng(6)
    base = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.append(rng.choice(base, n, replace=False), rng.integers(1, 1 << 63, 20, dtype=np.uint64))) for n in (0, 5, 200, 380, 390, 400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sig", "grams"])
    (out,) = jaccard._parities(iter([batch]))
    maps = np.array([out.column(p).to_numpy() for p in jaccard.PARITY]).T
    for a, one in zip(sets, maps, strict=True):
        for b, other in zip(sets, maps, strict=True):
            differ = np.unpackbits((one ^ other).view(np.uint8)).sum()
            assert differ <= len(np.setxor1d(a, b)) and (differ == 0 or len(np.setxor1d(a, b)))
    (none,) = jaccard._parities(iter([batch.slice(0, 0)]))
    assert none.num_rows == 0


def brute_repeats(texts, length=200):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cover[i : i + length] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~cover]))
    return out


def test_repeats(docs, empty):
    texts = [(t or "").encode() for _, t in ODD]
    rows = repeats.remove_repeats(docs).collect()
    wanted = [(k, len(t), kept) for (k, _), t, kept in zip(ODD, texts, brute_repeats(texts), strict=True)]
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in rows), key=repr) == sorted(wanted, key=repr)
    assert all(r.n_bytes - r.n_removed == len(r.kept) for r in rows)
    digests = {r.digest: r.kept_digest for r in repeats.repeated_spans(docs).collect()}
    assert digests == {hashlib.sha256(t).hexdigest(): hashlib.sha256(kept).hexdigest() for t, (_, _, kept) in zip(texts, wanted, strict=True)}
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_over_many_fragments(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "FRAGMENT", 50)
    texts = [(t or "").encode() for _, t in ODD]
    rows = repeats.remove_repeats(docs).collect()
    wanted = [(k, kept) for (k, _), kept in zip(ODD, brute_repeats(texts), strict=True)]
    assert sorted(((r.doc_id, bytes(r.kept)) for r in rows), key=repr) == sorted(wanted, key=repr)


def test_names_meet_in_little_memory():
    name = np.random.default_rng(5).permutation(np.repeat(np.arange(1 << 19, dtype=np.uint64) * np.uint64(12345), 2))
    name[:7] = np.arange(1, 8)
    row = {"fragment": [3], "ids": [np.array([9]).tobytes()], "counts": [np.array([len(name)], np.uint32).tobytes()], "names": [name.tobytes()]}
    table = pa.table({k: pa.array(v, pa.int32() if k == "fragment" else pa.binary()) for k, v in row.items()})
    tracemalloc.start()
    out = repeats._meet(np.uint64)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    again = np.unpackbits(np.frombuffer(out.column("bits")[0].as_py(), np.uint8), count=len(name))
    known, count = np.unique(name, return_counts=True)
    assert again.tolist() == (count[np.searchsorted(known, name)] > 1).astype(int).tolist()
    assert peak < 3 * name.nbytes


def test_names_of_many_rows_meet_where_they_came():
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 1 << 19, 1 << 16).astype(np.uint64) * np.uint64(12345) for _ in range(14)]
    ids = [*range(14), 5, 5]  # a text that three rows have counts once
    rows = [*parts, parts[5], parts[5]]
    columns = {"ids": [np.array([i]).tobytes() for i in ids], "counts": [np.array([len(r)], np.uint32).tobytes() for r in rows], "names": [r.tobytes() for r in rows]}
    table = pa.table({"fragment": pa.array([3] * 16, pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in columns.items()}})
    table = pa.concat_tables([table.slice(0, 6), table.slice(6)])
    tracemalloc.start()
    out = repeats._meet(np.uint64)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    known, count = np.unique(np.concatenate(parts), return_counts=True)
    for i, bits in zip(out.column("id").to_pylist(), out.column("bits").to_pylist(), strict=True):
        again = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(parts[i]))
        assert again.tolist() == (count[np.searchsorted(known, parts[i])] > 1).astype(int).tolist()
    assert out.column("id").to_pylist() == list(range(14))
    assert peak < 0.8 * sum(r.nbytes for r in rows)


@pytest.mark.parametrize("places", [[], [4], [0, 1, 2], [3, 5, 6, 7, 9, 30]])
def test_places_as_runs(places):
    runs = repeats._runs(np.array(places, np.int64))
    assert repeats._places(runs.tobytes()).tolist() == places


def test_cover_has_all_differences():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


def test_passages(docs, empty, spark):
    found = passages.near_passages(docs)
    rows = {(r.doc_id, r.other) for r in found.collect()}
    assert (2, 1) in rows and not {r for r in rows if r[0] in (5, 6, 7, 8, 9, None) or r[0] == 11 != r[1]}
    linked = {k for pair in rows for k in pair}
    assert {1, 3, 4, 10} <= linked
    left = passages.without_passages(docs, found)
    assert left.columns == docs.columns and left.count() == len(ODD)
    # one text keeps the passage
    assert sum(BASE[:300].lower() in (r.text or "").lower() for r in left.collect() if r.doc_id in (1, 2, 4, 10)) == 1
    assert passages.near_passages(empty).count() == 0


def brute_alike(a, b):
    """Places of ``a`` in a window alike one of ``b``, over all pairs of windows of which one has the least width."""
    out, least, reach = set(), passages.WIDTH, passages.REACH
    for x, y, swapped in ((a, b, False), (b, a, True)):
        for i in range(len(x) - least + 1):
            own = set(x[i : i + least])
            for j in range(len(y) - least + 1):
                for width in range(least, min(reach, len(y) - j) + 1):
                    other = set(y[j : j + width])
                    if 100 * len(own & other) >= passages.PERCENT * len(own | other):
                        out |= set(range(j, j + width)) if swapped else set(range(i, i + least))
    return out


@pytest.mark.parametrize("edit", ["insert", "delete", "replace", "two", "several", "repeat", "far", "periodic"])
def test_like_passages_as_by_all_windows(edit):
    core = [f"p{i}" for i in range(60)]
    changed = {
        "insert": core[:30] + ["new"] + core[30:],
        "delete": core[:25] + core[26:],
        "replace": [*core[:40], "new", *core[41:]],
        "two": core[:30] + ["new", "newer"] + core[30:54],
        "several": [w for i, w in enumerate(core) for w in ([w, "new"] if i % 6 == 5 else [w])],
        "repeat": core[:20] + ["again"] * 12 + core[20:],
        "far": core[25:50] + core[:25],
        "periodic": core[:5] * 5 + core[5:],
    }[edit]
    text = [*(f"a{i}" for i in range(9)), *core, *(f"b{i}" for i in range(7))], [*(f"c{i}" for i in range(4)), *changed, *(f"d{i}" for i in range(11))]
    a, b = passages._grams(pa.array([" ".join(t) for t in text]))
    wanted = brute_alike(a.tolist(), b.tolist())
    runs = passages.alike(a, b, 5, 20, 20)
    got = {i for start, end in runs for i in range(start, end)}
    assert wanted <= got and bool(wanted) == bool(got) == (edit not in ("several", "repeat"))
    # beyond the windows only shingles that the other text has
    assert set(a[sorted(got - wanted)].tolist()) <= set(b.tolist())


def test_passages_with_inserted_words(spark):
    short, long = [f"p{i}" for i in range(60)], [f"q{i}" for i in range(300)]
    spread = [w for i, w in enumerate(long) for w in (["new", w] if i and i % 40 == 0 else [w])]
    texts = [short, short[:30] + ["new"] + short[30:], long, spread]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = [(*sorted((r.doc_id, r.other)), r.start, r.end) for r in passages.near_passages(docs).collect()]
    assert {f[:2] for f in found} == {(0, 1), (2, 3)}
    assert sum(end - start for a, _, start, end in found if a == 2) > 0.8 * len(" ".join(long))


def test_passages_that_the_head_of_a_signature_lacks(spark):
    line = [f"line{i}" for i in range(44)]

    def doc(tag, shared):
        return " ".join([*(f"{tag}a{i}" for i in range(30)), *shared, *(f"{tag}b{i}" for i in range(30))])

    texts = {n: doc(f"single{n}", line) for n in range(60)}
    wanted = set()
    for n in range(40):
        shared = [*(f"s{n}x{i}" for i in range(3)), *line, *(f"s{n}y{i}" for i in range(3))]
        texts |= {100 + 2 * n: doc(f"one{n}", shared), 101 + 2 * n: doc(f"two{n}", shared)}
        wanted.add((100 + 2 * n, 101 + 2 * n))
    found = passages.near_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    pairs = {tuple(sorted((r.doc_id, r.other))) for r in found.collect()}
    assert pairs <= wanted and len(pairs) == len(wanted)


def test_compact_windows_are_the_wide_nodes():
    values = np.random.default_rng(6).permutation(400).astype(np.uint64)
    left, centre, right = passages.compact_windows(values, 20)
    wanted = []
    for c in range(400):
        a, b = c, c
        while a and values[a - 1] > values[c]:
            a -= 1
        while b < 399 and values[b + 1] > values[c]:
            b += 1
        if b - a + 1 >= 20:
            wanted.append((a, c, b))
    assert list(zip(left.tolist(), centre.tolist(), right.tolist(), strict=True)) == wanted


def vectors(spark, count=300):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(count, 8))
    v[5:40] = v[5]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(1000, None), (1020, [1.0, None] + [0.0] * 6), (1040, [math.nan] * 8), (1060, [0.0] * 8), (None, [1.0] * 8)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), v


def brute_best(v, queries, k, ids=None):
    out = set()
    ids = np.arange(len(v)) if ids is None else ids
    for q in queries:
        scores = v @ v[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
        out |= {(int(ids[q]), rank, int(ids[i])) for rank, i in enumerate(order, 1)}
    return out


def test_exact_search(spark):
    table, v = vectors(spark)
    whole = np.concatenate([np.floor(64 * v), np.zeros((1, 8))])
    ids = np.append(np.arange(len(v)), 1060)
    got = mtree.top_k(table, table.filter("vec_id % 20 = 0"), k=10, scale=64.0, tree_rows=100)
    queries = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert {(r.query_id, r.rank, r.vec_id) for r in got.collect()} == brute_best(whole, queries, 10, ids)
    assert mtree.top_k(table.filter("false"), table, k=3).count() == 0


def test_tree_leaves_distances_out():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(c, 0.05, (300, 4)) for c in rng.normal(0, 20, (10, 1))])
    tree = mtree.MTree(np.arange(len(v)), v)
    best = tree.search(v[17], 5)
    assert best.ids.tolist() == np.lexsort((np.arange(len(v)), -(v @ v[17])))[:5].tolist()
    assert tree.computed < len(v) / 2


def test_approximate_search(spark):
    table, v = vectors(spark)
    got = projections.nearest(table, table.filter("vec_id % 20 = 0"), k=10, tree_rows=100).collect()
    wanted = {(q, i) for q, _, i in brute_best(v, range(0, 300, 20), 10)}
    assert len({(r.query_id, r.vec_id) for r in got} & wanted) >= 0.9 * len(wanted)
    assert all(r.score == math.sumprod(v[r.query_id].tolist(), v[r.vec_id].tolist()) for r in got)
    assert {r.query_id for r in got} == set(range(0, 300, 20))
    assert abs(projections.chi_square_quantile(0.95, 8) - 15.507) < 0.01


def test_fold():
    assert toxicity.fold("Ｉdі0t! sc​um 1300").split() == ["idiot", "scum"]
    assert toxicity.fold(None) == toxicity.fold("") == "  "


def test_toxicity(spark, docs, empty):
    plain = " ".join(f"word{i % 37}" for i in range(60))
    rows = [(i, plain.replace("word5 ", f"{'scumbag' if i % 3 == 0 else 'word5'} "), int(i % 3 == 0)) for i in range(90)]
    rows += [(200 + i, plain + " blue scumbag fish", 0) for i in range(6)] + [(300, None, 1), (301, plain, None), (302, plain, 5)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert any("scumb" in term for term, _ in lexicon.terms)
    assert " scumbag fish " in lexicon.exceptions or " blue scumbag " in lexicon.exceptions
    tests = [(1, plain + " 5cumb@g"), (2, plain), (3, ""), (4, None), (5, plain + " blue scumbag fish")]
    scored = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), lexicon).collect()}
    assert scored[1] > 0.3 > max(scored[2], scored[3], scored[4], scored[5]) and scored[3] == scored[4]
    assert toxicity.score(docs, lexicon).count() == len(ODD) and toxicity.score(empty, lexicon).count() == 0
    nothing = toxicity.learn(spark.createDataFrame(rows[:1], "doc_id long, text string, label int").filter("false"))
    assert nothing.terms == () and toxicity.score(docs, nothing).filter("score >= 0.3").count() == 0


def test_held_out_accuracy(spark, sf):
    folder = sf.replace("sf0.001", "sf0.1")
    read = spark.read.parquet
    documents, labels = read(f"{folder}/documents.parquet"), read(f"{folder}/labels.parquet")
    scored = toxicity.score(documents, toxicity.learn_labels(documents, labels)).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    right = scored.select(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.97


def test_fixity(spark):
    rows = [("a", i, f"record {i}") for i in range(300)] + [("b", 0, "only"), ("b", 0, "only"), (None, 1, "x"), ("c", None, "x"), ("d", 1, None)]
    schema = "archive string, position long, record string"
    one = spark.createDataFrame(rows, schema)
    other = [(a, p, "record X7" if (a, p) == ("a", 170) else r) for a, p, r in rows if (a, p) != ("a", 299)][:-4] + [("b", 0, "only"), ("d", 1, None), ("e", 0, "new")]
    found = {(r.archive, r.position, r.kind) for r in audit(merkle_tree(one), merkle_tree(spark.createDataFrame(other, schema))).collect()}
    kinds = {(a, p): k for a, p, k in found}
    assert kinds[("a", 170)] == "changed" and kinds[("a", 299)] == "lost" and kinds[("e", 0)] == "added"
    assert audit(merkle_tree(one), merkle_tree(one.orderBy(F.rand(1)))).count() == 0
    assert audit(merkle_tree(one.filter("false")), merkle_tree(one.filter("false"))).count() == 0


def test_fixity_of_long_archives(spark):
    one = spark.range(-20, 6000).selectExpr("'a' as archive", "id as position", "cast(id as string) as record")
    other = one.filter("position <> 4096").withColumn("record", F.expr("if(position in (-7, 5000), 'damaged', record)"))
    other = other.union(spark.createDataFrame([("a", 70000, "new")], other.schema))
    found = {(r.position, r.kind) for r in audit(merkle_tree(one), merkle_tree(other)).collect() if r.kind != "moved"}
    assert found == {(-7, "changed"), (4096, "lost"), (5000, "changed"), (70000, "added")}
    nothing = one.filter("false")
    assert audit(merkle_tree(one), merkle_tree(nothing)).count() == 6020 == audit(merkle_tree(nothing), merkle_tree(one)).count()


def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string"
    same = [(0, "user", "hi"), (1, "assistant", "yes?")]
    one = [(1, *t) for t in [*same, (2, "user", "why"), (3, "assistant", "so")]] + [(2, *t) for t in same] + [(3, 0, "user", None), (None, 0, "user", "x"), (1, 3, "assistant", "so")]
    two = [(1, *t) for t in [*same, (2, "user", "why"), (3, "assistant", "no")]] + [(2, *t) for t in same] + [(4, 0, None, "y")]
    rows = format_preferences(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)).collect()
    parts = collections.Counter((r.pair_id, r.part) for r in rows)
    assert parts == {(1, "prompt"): 3, (1, "chosen"): 1, (1, "rejected"): 1, (2, "prompt"): 2, (3, "chosen"): 1, (4, "rejected"): 1}
    learned = {(r.part, r.rendered[r.mask_start : r.mask_end]) for r in rows if r.pair_id == 1 and r.mask_end > r.mask_start}
    assert learned == {("chosen", "so"), ("rejected", "no")}
    none = spark.createDataFrame([], schema)
    assert format_preferences(none, none).count() == 0


def test_texts_are_signed_together_as_one_by_one():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, spread, size)) for size in (0, 3, 5, 49, 50, 51, 300, 2000) for spread in (1, 4, 1000)]
    texts = pa.array([None, *texts, texts[-1], "", *texts[::-1]])
    *found, counts = passages._signed(texts)
    single = [passages.signatures(grams) for grams in passages._grams(texts)]
    assert counts.tolist() == [len(one[0]) for one in single]
    for together, alone in zip(found, zip(*single, strict=True), strict=True):
        assert together.tolist() == np.concatenate(alone).tolist()
    # every passage has one signature of each kind
    starts = [(end - begin + 1).sum() for _, begin, end, _ in single]
    assert starts == [max(0, len(grams) - passages.WIDTH + 1) * passages.SIGNATURES for grams in passages._grams(texts)]
