"""The registered queries of the operators in this subpackage, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluentrail.llm.bestfit import pack_best_fit
from fluentrail.llm.fixity import audit, merkle_tree, warc_record
from fluentrail.llm.jaccard import link_documents
from fluentrail.llm.mtree import top_k
from fluentrail.llm.packing import pack
from fluentrail.llm.passages import near_passages
from fluentrail.llm.pieces import encode_pieces
from fluentrail.llm.preference import format_preferences
from fluentrail.llm.projections import nearest
from fluentrail.llm.ranked import search_documents
from fluentrail.llm.repair import digests, repair_conversations
from fluentrail.llm.repeats import removed_bytes, repeated_spans
from fluentrail.llm.toxicity import held_out, learn_labels, score


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text and the text they decode to, as counts and digests."""
    coded = encode_pieces(_read(spark, folder, "documents"), _vocabulary("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_mtree(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector with all others, in whole numbers."""
    vectors = _read(spark, folder, "embeddings")
    found = top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10, scale=1024.0)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


OP2_SQL = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(q.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM vectors q JOIN vectors b ON q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that occur again."""
    documents = _read(spark, folder, "documents")
    known = repeated_spans(documents).select("digest", "size", "spans", "kept_digest")
    own = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return own.join(known, "digest").select(
        "doc_id",
        F.col("size").alias("n_bytes"),
        removed_bytes(F.col("spans")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.col("kept_digest").alias("kept_sha256"),
    )


def op9_projections(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty near vectors of every twentieth vector."""
    vectors = _read(spark, folder, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    pieces = pack(_read(spark, folder, "documents"), _vocabulary("word_bpe_49k.json"), with_ids=False)
    return pieces.select("doc_id", "start", "length", F.col("crc32").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words or more that nearly repeat a passage elsewhere."""
    found = near_passages(_read(spark, folder, "documents"))
    return found.select("doc_id", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), F.col("other").alias("other_doc_id"))


def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose five-word shingles are alike by 80 %."""
    return link_documents(_read(spark, folder, "documents"))


def op6_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged records of a replica of all pages, found by the trees of both copies.

    1,000 pages make an archive. The replica has a changed byte in one page of fifty, one archive of
    thirteen ends at its 900th record, and from one of three a record near the front is lost.
    """
    pages = _read(spark, folder, "pages").select(
        F.expr("(page_id - pmod(page_id, 1000)) div 1000").alias("archive"),
        F.pmod("page_id", F.lit(1000)).alias("position"),
        warc_record(F.col("url"), F.col("html")).alias("record"),
    )
    damaged = F.when(F.col("position") % 50 == 7, F.overlay("record", F.lit("?"), 1)).otherwise(F.col("record"))
    lost = (F.col("archive") % 13 == 3) & (F.col("position") >= 900) | (F.col("archive") % 3 == 0) & (F.col("position") == 60)
    replica = pages.filter(~lost).withColumn("record", damaged)
    found = audit(merkle_tree(pages), merkle_tree(replica))
    return found.select("archive", "position", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), "kind", "shift")


OP6_SQL = """
WITH records AS (
    SELECT CAST(floor(page_id / 1000) AS BIGINT) AS archive, page_id - 1000 * CAST(floor(page_id / 1000) AS BIGINT) AS position,
           strlen('WARC/1.1WARC-Type: resourceWARC-Target-URI: Content-Length: ') + 14 + strlen(coalesce(url, ''))
           + strlen(coalesce(html, '')) + length(strlen(coalesce(html, ''))::VARCHAR) AS size
    FROM pages WHERE page_id IS NOT NULL),
placed AS (
    SELECT archive, position, sum(size) OVER (PARTITION BY archive ORDER BY position) AS last, size FROM records),
told AS (
    SELECT *, archive % 13 = 3 AND position >= 900 OR archive % 3 = 0 AND position = 60 AS lost, sum(size) OVER (PARTITION BY archive) AS whole FROM placed),
shifts AS (
    SELECT archive, position, last, whole, -sum(size) OVER (PARTITION BY archive ORDER BY position) AS shift,
           lead(last - size) OVER (PARTITION BY archive ORDER BY position) AS next FROM told WHERE lost)
SELECT archive, position, CAST(last - size AS BIGINT) AS start_offset, CAST(last AS BIGINT) AS end_offset,
       CASE WHEN lost THEN 'lost' ELSE 'changed' END AS kind, NULL::BIGINT AS shift
FROM told WHERE position % 50 = 7 OR lost
UNION ALL
SELECT archive, position + 1, CAST(last AS BIGINT), CAST(coalesce(next, whole) AS BIGINT), 'moved', CAST(shift AS BIGINT)
FROM shifts WHERE last < coalesce(next, whole)
"""


def op7_preference(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation against itself with its last answer taken from the next conversation.

    One without an answer is the same on both sides. Of several rows at one turn the smallest role and text counts.
    """
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _read(spark, folder, "conversations").filter("conv_id is not null and turn is not null")
    turns = rows.groupBy(F.col("conv_id").alias("pair_id"), "turn").agg(F.min(said).alias("said")).select("pair_id", "turn", "said.*")
    answers = turns.filter("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last")).select("pair_id", F.col("last.turn").alias("last_turn"), F.col("last.text").alias("last_text"))
    before = turns.join(answers, "pair_id", "left").filter("last_turn is null or turn < last_turn").select(turns.columns)
    other = answers.select((F.col("pair_id") - 1).alias("pair_id"), F.col("last_text").alias("text"))
    swapped = answers.join(other, "pair_id", "left").select("pair_id", F.col("last_turn").alias("turn"), F.lit("assistant").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return format_preferences(turns, before.unionByName(swapped))


OP7_SQL = """
WITH numbered AS (
    SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(role, ''), coalesce(text, '')) AS n FROM conversations
    WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
turns AS (SELECT * EXCLUDE (n) FROM numbered WHERE n = 1),
answers AS (
    SELECT pair_id, max(turn) AS last_turn, arg_max(text, turn) AS last_text FROM turns WHERE role = 'assistant' GROUP BY pair_id),
chosen AS (SELECT * FROM turns),
rejected AS (
    SELECT t.* FROM turns t LEFT JOIN answers a USING (pair_id) WHERE a.last_turn IS NULL OR t.turn < a.last_turn
    UNION ALL
    SELECT a.pair_id, a.last_turn, 'assistant', coalesce(b.last_text, '') FROM answers a LEFT JOIN answers b ON b.pair_id = a.pair_id + 1),
both_sides AS (
    SELECT pair_id, turn, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text
    FROM chosen c FULL JOIN rejected r USING (pair_id, turn)),
parting AS (
    SELECT pair_id, min(CASE WHEN c_role IS DISTINCT FROM r_role OR c_text IS DISTINCT FROM r_text THEN turn END) AS parting
    FROM both_sides GROUP BY pair_id),
parts AS (
    SELECT pair_id, 'prompt' AS part, turn, c_role AS role, c_text AS text FROM both_sides JOIN parting USING (pair_id) WHERE turn < coalesce(parting, turn + 1)
    UNION ALL
    SELECT pair_id, 'chosen', turn, c_role, c_text FROM both_sides JOIN parting USING (pair_id) WHERE turn >= parting AND c_role IS NOT NULL
    UNION ALL
    SELECT pair_id, 'rejected', turn, r_role, r_text FROM both_sides JOIN parting USING (pair_id) WHERE turn >= parting AND r_role IS NOT NULL)
SELECT pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || chr(10) AS rendered, length(role) + 5 AS mask_start,
       length(role) + 5 + CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(text) ELSE 0 END AS mask_end
FROM parts
"""


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by the lexicon of the labels that are not held out."""
    documents = _read(spark, folder, "documents")
    scored = score(documents, learn_labels(documents, _read(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "weight", "words")


def op11_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, damaged by a checksum of their rows, and their cheapest repairs."""
    conversations = _read(spark, folder, "conversations")
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    damage = F.crc32(named) % 20
    text = F.coalesce("text", F.lit(" "))
    damaged = conversations.filter(damage != 0).select(
        "conv_id",
        "turn",
        F.when(damage == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(damage == 1, "").when(damage == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(damage == 3, 2).otherwise(1))).alias("copy"),
    )
    repaired = repair_conversations(damaged)
    said = digests(repaired.turns)
    every = conversations.select("conv_id").distinct()
    report = every.join(repaired.reports.withColumnRenamed("conv_id", "own_id"), F.col("conv_id").eqNullSafe(F.col("own_id")), "left")
    report = report.join(said.withColumnRenamed("conv_id", "said_id"), F.col("conv_id").eqNullSafe(F.col("said_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return report.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _plus(value: str, letter: str, cost: str) -> str:
    """SQL for a cost of twelve digits with an audit behind it, after one more edit."""
    return f"lpad(CAST(CAST(left({value}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || {letter} || substr({value}, 13)"


def _edit(value: str, initial: str) -> str:
    return f"CASE WHEN stays THEN {_plus(value, f"CASE WHEN x = '{initial}' THEN 'K' ELSE 'R' END", f"CASE WHEN x = '{initial}' THEN t ELSE t + 2 END")} END"


OP11_SQL = rf"""
WITH RECURSIVE keyed AS (
    SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS signs
    FROM conversations),
bits AS (
    SELECT *, list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(signs, lambda s: [CAST(ascii(s) + 1 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))) AS steps FROM keyed),
summed AS (
    SELECT *, xor(list_reduce(steps, lambda a, v: CASE WHEN (xor(a, CASE WHEN v > 0 THEN v - 1 ELSE 0 END) & 1) = 1
        THEN xor(xor(a, CASE WHEN v > 0 THEN v - 1 ELSE 0 END) >> 1, 3988292384) ELSE xor(a, CASE WHEN v > 0 THEN v - 1 ELSE 0 END) >> 1 END), 4294967295) % 20 AS damage
    FROM bits),
damaged AS (
    SELECT c, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
           CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN damage = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM summed WHERE damage <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last,
                lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair FROM numbered),
faults AS (
    SELECT c, i, turn, role, text, left(role, 1) AS x, pair, last = '' AS blank, last <> '' AND again AS duplicate,
           last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS truncated FROM seen),
rows AS (SELECT *, NOT (blank OR duplicate) AS stays, CASE WHEN truncated THEN 1 ELSE 0 END AS t FROM faults),
counted AS (
    SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
           count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM rows GROUP BY c),
best AS (
    SELECT c, n + 1 AS i, '000000000000' AS v0, '000000000004II' AS v1, '000000000002I' AS v2, '000000000000' AS v3 FROM counted
    UNION ALL
    SELECT c, i, least(w0, {_plus('w2', "'I'", '2')}, {_plus('w3', "'II'", '4')}), least(w1, {_plus('w2', "'I'", '2')}, {_plus('w3', "'II'", '4')}),
           least(w2, {_plus('w3', "'I'", '2')}), least(w3, {_plus('w2', "'I'", '2')})
    FROM (
        SELECT c, r.i,
               least({_plus('v0', "'D'", '3')}, CASE WHEN stays AND x = 's' THEN {_plus('v1', "'K'", 't')} END, {_edit('v2', 'u')}) AS w0,
               least({_plus('v1', "'D'", '3')}, {_edit('v2', 'u')}) AS w1,
               least({_plus('v2', "'D'", '3')}, {_edit('v3', 'a')}) AS w2,
               least({_plus('v3', "'D'", '3')}, {_edit('v2', 'u')}) AS w3
        FROM best b JOIN rows r USING (c) WHERE r.i = b.i - 1)),
audits AS (SELECT c, CAST(left(v0, 12) AS BIGINT) AS cost, substr(v0, 13) AS audit FROM best WHERE i = 1),
letters AS (SELECT c, unnest(range(1, length(audit) + 1)) AS p, audit FROM audits),
placed AS (
    SELECT c, p, audit[p] AS letter, p - length(replace(audit[1:p], 'I', '')) AS inserted, length(replace(audit[1:p], 'D', '')) AS place FROM letters),
taken AS (SELECT l.c, p, letter, place, r.role, r.x, CASE WHEN letter <> 'I' THEN r.text END AS text FROM placed l LEFT JOIN rows r ON r.c = l.c AND r.i = p - inserted),
led AS (SELECT *, max(CASE WHEN place = 1 AND letter = 'K' AND x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c) AS led FROM taken WHERE letter <> 'D'),
said AS (
    SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS said
    FROM led GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM keyed) LEFT JOIN counted USING (c) LEFT JOIN audits USING (c) LEFT JOIN said USING (c)
"""


def op12_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in few sequences of at most 2048 tokens."""
    pieces = pack_best_fit(_read(spark, folder, "documents"), _vocabulary("byte_bpe_50k.json"), with_ids=False)
    return pieces.withColumnRenamed("crc32", "ids_crc32")


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty best documents for every benchmark item."""
    return search_documents(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"), k=50)


OP13_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL),
items AS (
    SELECT row_number() OVER () AS q, item_id,
           list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
    FROM benchmark WHERE text IS NOT NULL),
sizes AS (SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM docs WHERE len(terms) > 0),
measured AS (SELECT d, doc_id, terms, 50 + CAST((50 * len(terms) * n_docs) // n_terms AS BIGINT) AS m FROM docs, sizes WHERE len(terms) > 0),
postings AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM measured) GROUP BY d, term),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), sizes),
scored AS (
    SELECT q, item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM (SELECT q, item_id, unnest(terms) AS term FROM items) JOIN weights USING (term) JOIN postings USING (term) JOIN measured USING (d)
    GROUP BY q, item_id, d, doc_id),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mtree": op2_mtree,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_merkle_fixity": op6_merkle_fixity,
    "op7_preference": op7_preference,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_projections": op9_projections,
    "op10_toxicity": op10_toxicity,
    "op11_structure_repair": op11_structure_repair,
    "op12_best_fit": op12_best_fit,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE: dict[str, str] = {"op2_mtree": OP2_SQL, "op6_merkle_fixity": OP6_SQL, "op7_preference": OP7_SQL, "op11_structure_repair": OP11_SQL, "op13_ranked_search": OP13_SQL}
