"""Repair of conversations, best-fit packing and ranked search against brute force."""

import bisect
import collections
import hashlib
import math
import random
import re
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluentrail.llm import bestfit, fixity, mtree, preference, projections, queries, ranked, repair, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")


# Repair


def cheapest(rows):
    """Cost and audit by plain recursion over ``(initial, goes, truncated)``."""

    @lru_cache(maxsize=None)
    def best(i, state, inserted=0):
        found = []
        if i == len(rows) and state in (repair.START, repair.ASSISTANT):
            found.append((0, ""))
        role, after = repair.NEXT[state]
        if inserted < 2:
            rest = best(i, after, inserted + 1)
            found.append((rest[0] + 2, "I" + rest[1]))
        if i < len(rows):
            initial, goes, truncated = rows[i]
            rest = best(i + 1, state)
            found.append((rest[0] + 3, "D" + rest[1]))
            if not goes:
                rest = best(i + 1, after)
                found.append((rest[0] + truncated + (0 if initial == role else 2), ("K" if initial == role else "R") + rest[1]))
                if initial == "s" and state == repair.START:
                    rest = best(i + 1, repair.SYSTEM)
                    found.append((rest[0] + truncated, "K" + rest[1]))
        return min(found, default=(10**9, ""))

    return best(0, repair.START)


def as_steps(rows):
    return [repair.deleted_step(1) if goes else repair.kept_step(initial, truncated) for initial, goes, truncated in rows]


def test_lightest_derivations_are_the_cheapest_repairs(monkeypatch):
    draw = random.Random(1)
    for block in (256, 3):
        monkeypatch.setattr(repair, "BLOCK", block)
        for _ in range(400):
            rows = tuple((draw.choice("suatx"), draw.random() < 0.25, draw.random() < 0.3) for _ in range(draw.randrange(12)))
            assert repair.repair_steps(as_steps(rows)) == cheapest(rows)


def plainly_repaired(conversation):
    """Report and lines of one conversation of ``(turn, role, text)``."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in conversation), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, marked, counts = set(), [], collections.Counter()
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+", "", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        marked.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = cheapest(tuple(marked))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[0] + b[0] not in repair.LEGAL for a, b in zip(marked, marked[1:]))
    state, at, lines = repair.START, 0, []
    for letter in audit:
        role, after = repair.NEXT[state]
        name, text = repair.NAMES[role], ""
        if letter != "I":
            text = rows[at][2]
            if letter == "K":
                name = rows[at][1]
                after = repair.SYSTEM if name[:1] == "s" else after
            at += 1
        if letter != "D":
            lines.append(f"{name}:{text}")
            state = after
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit), "\n".join(lines)


@pytest.fixture(scope="module")
def turns():
    draw = random.Random(2)
    rows = []
    for conv in [None, *range(12)]:
        for turn in range(draw.randrange(1, 9)):
            for _ in range(draw.choice((1, 1, 1, 2))):
                rows.append((conv, draw.choice((None, turn, turn, turn + 3)), draw.choice(("user", "assistant", "system", "tool", "", None)), draw.choice(("Yes.", "no", " ", "", None, "A line\nmore! ", "ü?", "x" * 5000))))
    rows += [(50, 1, "user", "Same.")] * 120 + [(50, 2, "assistant", "Other.")] + [(51, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(700)]
    return rows


@pytest.mark.parametrize("range_rows", [1 << 15, 40])
def test_repairs_cut_into_ranges(spark, turns, monkeypatch, range_rows):
    monkeypatch.setattr(repair, "RANGE_ROWS", range_rows)
    df = spark.createDataFrame([(*r, "a", 1, "b") for r in turns], "conv_id long, turn long, role string, text string, place string, part int, key string")
    repaired = repair.repair_conversations(df)
    reports = {r.conv_id: tuple(r)[1:] for r in repaired.reports.collect()}
    lines = collections.defaultdict(list)
    for r in repaired.turns.orderBy("place").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    said = {r.conv_id: r.sha256 for r in repair.digests(repaired.turns).collect()}
    grouped = collections.defaultdict(list)
    for conv, *row in turns:
        grouped[conv].append(row)
    assert set(reports) == set(grouped)
    for conv, rows in grouped.items():
        if len(rows) > 600:
            assert reports[conv] == (0, 0, 0, 0, 0, 0, "K" * 700)
            continue
        report, text = plainly_repaired(rows)
        assert reports[conv] == report and "\n".join(lines[conv]) == text
        assert said.get(conv, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest()


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    repaired = repair.repair_conversations(df)
    assert repaired.reports.count() == 0 and repaired.turns.count() == 0


def test_damaged_conversations_equal_sql(spark, turns, tmp_path):
    df = spark.createDataFrame([(c, t, r, x) for c, t, r, x in turns if c != 51], "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    answer = connection.execute(queries.OP11_SQL)
    names = [d[0] for d in answer.description]
    got = queries.op11_structure_repair(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(answer.fetchall(), key=repr)


# Best fit


def plain_best_fit(sizes, capacity):
    gaps, opened = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, size)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        opened += gap == capacity
        if gap > size:
            bisect.insort(gaps, gap - size)
    return opened


@pytest.mark.parametrize("kind", ["mixed", "hot", "small", "large"])
@pytest.mark.parametrize("range_rows", [1 << 15, 100, 8])
def test_supersteps_fit_as_well_as_one_by_one(spark, monkeypatch, kind, range_rows):
    monkeypatch.setattr(bestfit, "RANGE_ROWS", range_rows)
    draw = random.Random(3)
    sizes = [{"mixed": lambda: min(999, int(draw.lognormvariate(5, 1.3)) + 1), "hot": lambda: draw.choice((350, 350, draw.randrange(1, 1000))), "small": lambda: draw.randrange(1, 9), "large": lambda: draw.randrange(400, 700)}[kind]() for _ in range(2000)]
    placed = bestfit.place_pieces(spark.createDataFrame(list(enumerate(sizes)), "id long, size long"), 1000).collect()
    by_sequence = collections.defaultdict(list)
    for r in placed:
        by_sequence[r.sequence].append((r.offset, sizes[r.id]))
    assert sorted(r.id for r in placed) == list(range(2000))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= 1000
    assert len(by_sequence) <= (1.03 if range_rows > 8 else 1.1) * plain_best_fit(sizes, 1000) + 1


ODD = [(1, "Some words, and more " * 60), (2, ""), (3, None), (4, "ñandú 日本 \U0001d11e <|endoftext|> x"), (5, "a\n\n  b\x00"), (5, "a\n\n  b\x00"), (None, "no id"), (6, " " * 3000 + "x")]


def test_pieces_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(k, t, 1, 2, "a", "b") for k, t in ODD], "doc_id long, text string, piece int, size int, id string, sequence string")
    rows = bestfit.pack_best_fit(docs, path, capacity=64, end_id=0).collect()
    wanted = collections.Counter((k, tuple(library.encode(t or "", add_special_tokens=False).ids + [0])) for k, t in ODD)
    by_doc = collections.defaultdict(list)
    for r in rows:
        assert r.crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length and (r.length == 64 or r.piece == 0)
        by_doc[r.doc_id].append((r.piece, r.start, tuple(r.ids)))
    for (key, ids), times in wanted.items():
        parts = sorted(set(by_doc[key]))
        assert len(by_doc[key]) == times * len(parts)
        assert tuple(x for _, _, own in parts for x in own) == ids and [s for _, s, _ in parts] == list(np.cumsum([0] + [len(own) for _, _, own in parts])[:-1])
    filled = collections.Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 64
    assert bestfit.pack_best_fit(docs.filter("false"), path).count() == 0
    with pytest.raises(ValueError):
        bestfit.pack_best_fit(docs, path, capacity=0)


def test_signs_the_fast_encoder_cannot_split():
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    text = " " * 1_500_000 + "b"
    assert bestfit.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    held = [(key, collections.Counter(plain_terms(text))) for key, text in docs]
    held = [(key, counts) for key, counts in held if counts]
    count, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, counts in held:
            m = 50 + 50 * sum(counts.values()) * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 20 * m)) for t in set(plain_terms(text)) if t in counts)
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ñu", "ñu", "日本", "A1", "a1", "é"]
    docs = [(draw.choice((i, i, i - 1)), " ".join(draw.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=draw.randrange(1, 80)))) for i in range(300)]
    docs += [(400 + i, "same words w3 w4") for i in range(40)] + [(None, "w3 w3 w9"), (900, None), (901, ""), (902, " .,\x00;"), (903, "w5-w5_W5/w5 " * 3000)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randrange(1, 30)))) for i in range(25)] + [(25, None), (26, ""), (27, "unknown"), (28, "SAME words"), (28, "w3"), (None, "w1 w2")]
    return docs, items


@pytest.mark.parametrize("block", [8192, 20])
def test_ranked_search_finds_the_best(spark, texts, monkeypatch, block):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", block)
    monkeypatch.setattr(ranked, "CHUNK_QUERIES", 9)
    docs = spark.createDataFrame([(*r, 1, "a", 2) for r in texts[0]], "doc_id long, text string, block int, terms string, score int")
    items = spark.createDataFrame([(*r, 1, "a") for r in texts[1]], "item_id int, text string, no int, key string")
    got = ranked.search_documents(docs, items, k=7).collect()
    assert sorted(map(tuple, got), key=repr) == plain_search(*texts, 7)
    assert ranked.search_documents(docs.filter("false"), items).count() == 0
    assert ranked.search_documents(docs, items.filter("false")).count() == 0
    assert ranked.search_documents(docs, items.filter("item_id = 25")).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("whole", [0, 3, 50])
def test_intervals_bound_their_documents(texts, monkeypatch, whole):
    monkeypatch.setattr(ranked, "WHOLE", whole)
    docs = [(i, collections.Counter(ranked.words((t or "").encode()))) for i, (_, t) in enumerate(texts[0])]
    docs = [(i, c) for i, c in docs if c]
    table = pa.table({"key": [i for i, _ in docs], "m": pa.array([60 + i % 5 for i, _ in docs], pa.int64()), "terms": pa.array([list(c) for _, c in docs], pa.list_(pa.binary())), "tfs": pa.array([list(c.values()) for _, c in docs], pa.list_(pa.int64()))})
    block = ranked.Block(table)
    for _, text in texts[1]:
        terms = sorted(set(ranked.words((text or "").encode())))
        weights = [len(t) * 7 % 5 for t in terms]
        scores = [(sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (60 + i % 5))) for t, w in zip(terms, weights, strict=True) if t in c), -at) for at, (i, c) in enumerate(docs)]
        for floor in (0, sorted(scores)[-5][0]):
            wanted = sorted((s for s in scores if s[0] >= max(1, floor)), reverse=True)[:6]
            assert sorted(((s, -d) for s, d in block.search(terms, weights, 6, floor)), reverse=True) == wanted


def test_filter_keeps_every_term(spark):
    terms = spark.range(500).select(F.concat(F.lit("ü"), F.col("id").cast("string")).cast("binary").alias("term"))
    bits = ranked._filter_bits(terms)
    docs = spark.createDataFrame([(1, " ".join(f"ü{i}" for i in range(500)))], "doc_id int, text string")
    assert len(ranked._scan(docs, "doc_id", bits).first().terms) == 500


# Preferences and labels


def test_preference_records(spark):
    schema = "pair_id long, turn long, role string, text string"
    one = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Yes."), (1, 2, "user", "More"), (1, 3, "assistant", ""), (2, 0, "user", "Same")]
    two = [(1, 0, "user", "Hi"), (1, 1, "assistant", "No way."), (2, 0, "user", "Same")]
    rows = preference.format_preferences(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema))
    got = {r.pair_id: r for r in preference.preference_records(rows).collect()}
    assert got[1].prompt == "<|user|>\nHi\n"
    assert got[1].chosen == "<|assistant|>\nYes.\n<|user|>\nMore\n<|assistant|>\n\n" and got[1].rejected == "<|assistant|>\nNo way.\n"
    assert [got[1].chosen[s.start : s.end] for s in got[1].chosen_mask] == ["Yes."]
    assert [got[1].rejected[s.start : s.end] for s in got[1].rejected_mask] == ["No way."]
    assert (got[2].prompt, got[2].chosen, got[2].rejected, got[2].chosen_mask) == ("<|user|>\nSame\n", "", "", [])


def test_preferences_of_repeated_rows_and_without_answers_equal_sql(spark, turns, tmp_path):
    rows = [r for r in turns if r[0] != 51] * 2 + [(60, 0, "user", "alone"), (60, None, "user", "x"), (61, 1, "assistant", "b"), (61, 1, "assistant", "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    answer = connection.execute(queries.OP7_SQL)
    names = [d[0] for d in answer.description]
    got = sorted(map(tuple, queries.op7_preference(spark, str(tmp_path)).select(*names).collect()), key=repr)
    assert got == sorted(answer.fetchall(), key=repr) and any(r[0] == 60 for r in got)


def test_rows_learned_from_are_bounded(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(toxicity, "_learn", lambda train: learned.append(train.collect()))
    docs = spark.range(4000).select((F.col("id") % 4).alias("doc_id"), F.concat(F.lit("text "), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text"))
    toxicity.learn_labels(docs, spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int"))
    assert sorted(r.text for r in learned[0]) == [f"text {i:05d}" for i in range(4) if zlib.crc32(str(i).encode()) % 4 != 2]


# Projections


def test_projections_verify_less_than_half():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(12000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tree = projections.ProjectionTree(np.arange(len(v)), v)
    found = 0
    for i in range(0, len(v), 400):
        scores = v @ v[i]
        scores[i] = -np.inf
        found += len({*np.argsort(-scores)[:20].tolist()} & {*tree.search(v[i], 20, i).ids.tolist()})
    assert found >= 0.9 * 20 * 30 and tree.verified < 0.6 * 30 * len(v)


def test_projections_of_repeated_ids(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 6))
    rows = [(i % 20, [float(x) for x in v[i]]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id, r.score) for r in projections.nearest(table, table.filter("vec_id = 0").limit(1), k=57).collect())
    asked = [i for i in range(0, 60, 20) if any(math.sumprod(v[i].tolist(), v[j].tolist()) == got[0][2] for j in range(60) if j % 20)]
    wanted = sorted(((math.sumprod(v[asked[0]].tolist(), v[j].tolist()), j % 20) for j in range(60) if j % 20), key=lambda s: (-s[0], s[1]))
    assert [(s, i) for _, i, s in got] == wanted


# Fixity


def test_one_lost_record_moves_one_range(spark):
    schema = "archive string, position long, record string"
    rows = [("a", i, "x" * (i % 7 + 1)) for i in range(200)]
    sizes = [i % 7 + 1 for i in range(200)]
    one = fixity.merkle_tree(spark.createDataFrame(rows, schema))

    def told(changed):
        found = fixity.audit(one, fixity.merkle_tree(spark.createDataFrame(changed, schema))).collect()
        return sorted((r.position, r.kind, r.start, r.end, r.shift) for r in found)

    at = [sum(sizes[:i]) for i in range(201)]
    assert told([r for r in rows if r[1] != 50]) == [(50, "lost", at[50], at[51], None), (51, "moved", at[51], at[200], -sizes[50])]
    longer = [(a, p, r + "yy" if p == 30 else "q" * len(r) if p == 90 else r) for a, p, r in rows if p != 121]
    wanted = [(30, "changed", at[30], at[31], None), (31, "moved", at[31], at[121], 2), (90, "changed", at[90], at[91], None), (121, "lost", at[121], at[122], None)]
    assert told(longer) == [*wanted, (122, "moved", at[122], at[200], 2 - sizes[121])]
    # the sizes of both cancel out: what lies behind is in its place
    assert [t for t in told([(a, p, r[:-1] if p == 20 else r + "z" if p == 40 else r) for a, p, r in rows]) if t[1] == "moved"] == [(21, "moved", at[21], at[40], -1)]
    gap = [r for r in rows if r[1] != 100]
    two = fixity.merkle_tree(spark.createDataFrame(gap, schema))
    added = sorted((r.position, r.kind, r.start, r.end, r.shift) for r in fixity.audit(two, one).collect())
    assert added == [(100, "added", at[100], at[101], None), (101, "moved", at[100], at[200] - sizes[100], sizes[100])]
    assert fixity.audit(one, fixity.merkle_tree(spark.createDataFrame([(a, p, None if r == "" else r) for a, p, r in rows], schema))).count() == 0
    null, empty = (fixity.merkle_tree(spark.createDataFrame([("a", 0, r)], schema)) for r in (None, ""))
    assert [r.kind for r in fixity.audit(null, empty).collect()] == ["changed"]


# Whole scores


@pytest.mark.parametrize("scale", [3e4, 2e5])
def test_whole_scores_beyond_53_bits(spark, scale):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 64)) * scale
    v[150:] = v[:150]
    v[150:, 0] += rng.integers(-2, 3, 150) / 1024  # near ties
    table = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in mtree.top_k(table, table.filter("vec_id % 30 = 0"), k=10, scale=1024.0, tree_rows=100).collect())
    whole = [[math.floor(x * 1024) for x in row] for row in v.tolist()]
    wanted = []
    for q in range(0, 300, 30):
        scores = sorted((-math.sumprod(whole[q], whole[b]), b) for b in range(300) if b != q)[:10]
        wanted += [(q, rank, b, -s) for rank, (s, b) in enumerate(scores, 1)]
    assert got == wanted and max(abs(w[3]) for w in wanted) > 1 << 53
