"""The registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislens.llm import chat_format, contamination, content_dedup, fill_middle, lexical_search, license_scan, packing, simhash, token_counts, toxicity, unit_dedup, vector_dedup, warc
from vislens.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Bytes of a packed sequence.
CAPACITY = 8192


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learnt from."""
    return read(spark, sf_dir, "labels").filter(fold() != 0)


def packing_rows(docs: DataFrame) -> DataFrame:
    """Length in bytes and a cluster for texts that differ in case and white space only."""
    plain = F.regexp_replace(F.lower("text"), r"\s+", " ")
    return docs.select("doc_id", "source", F.octet_length("text").alias("n_bytes"), F.xxhash64(plain).alias("cluster"))


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence text of the built-in templates in every document, at a coverage of 0.8."""
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


@query(
    "op2_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
    FROM m
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    pages = read(spark, sf_dir, "pages")
    folder = warc.new_folder(spark)
    n = warc.write_warc(pages, folder).agg(F.sum("n_records")).first()[0]
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    if not n:  # an empty table leaves no file to read
        return warc.record_types(pages).select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), "refers_to")
    return warc.read_warc(spark, folder, pages.schema["page_id"].dataType.simpleString()).select(columns)


WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(
    "op3_benchmark_decontamination",
    rf"""
    WITH i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
    s AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS s
          FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM (SELECT item_id, w, least(len(w), 5) AS k FROM i WHERE len(w) > 0))),
    n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
    d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    t AS (SELECT DISTINCT doc_id, array_to_string(w[j:j + k - 1], ' ') AS s
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM s))),
    c AS (SELECT doc_id, item_id, count(*) AS f FROM t JOIN s USING (s) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, n::INT AS n_shingles, f::INT AS n_found, f / n AS containment
    FROM c JOIN n USING (item_id) WHERE f >= ceil(round(n * 0.8, 6))
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items, by five-word shingles and a containment of 0.8."""
    return contamination.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score, decision and offending spans of every document, learnt from four folds of the labels."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, training_labels(spark, sf_dir))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_tokens", "spans"
    )


NO_BLANKS = r"[\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}\x{20000}-\x{3ffff}]"
SPLIT = r"list_filter(regexp_split_to_array(lower({}), '[ \t\r\n\f\v]+'), lambda w: w <> '')"

#: Relation h (doc_id, s, e, t): sentences, and shortest runs of sentences with a short one at an end.
PASSAGES = rf"""
    p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]["'')\]*#%&$]*[ \t\r]+|\n|[。！？]+[」』）]*[ \t\r]*)', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE text <> ''),
    u AS (SELECT doc_id, k, p[k] AS unit FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k FROM p)),
    o AS (SELECT doc_id, k, length(unit) AS l, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY k) AS e,
                 length(regexp_replace(unit, '{NO_BLANKS}', '', 'g')) AS plain, {SPLIT.format("unit")} AS w FROM u),
    f AS (SELECT doc_id, e - l AS s, e, array_to_string(w, ' ') AS t, len(w) + (l - plain) // 2 AS n, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k FROM o WHERE len(w) > 0),
    c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS c FROM f),
    a AS (SELECT doc_id, list(t ORDER BY k) AS ts FROM c GROUP BY doc_id),
    r AS (SELECT x.doc_id, x.s::INT AS s, y.e::INT AS e, x.k AS i, y.k AS j FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.k BETWEEN x.k AND x.k + 5
          WHERE y.c - x.c + x.n >= 6 AND (y.c - y.n - x.c + x.n < 6 OR y.c - x.c < 6)),
    h AS (SELECT r.doc_id, s, e, array_to_string(ts[i:j], ' ') AS t FROM r JOIN a ON r.doc_id = a.doc_id)"""


@query(
    "op5_repeated_units",
    rf"""
    WITH {PASSAGES},
    q AS (SELECT doc_id, length(text) AS size, string_split(text, chr(10)) AS p FROM documents WHERE text <> ''),
    v AS (SELECT doc_id, size, k, p[k] AS line FROM (SELECT doc_id, size, p, unnest(range(1, len(p) + 1)) AS k FROM q)),
    z AS (SELECT doc_id, size, length(line) AS l, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS e,
                 length(regexp_replace(line, '{NO_BLANKS}', '', 'g')) AS plain, {SPLIT.format("line")} AS w FROM v),
    y AS (SELECT doc_id, (e - l - 1)::INT AS s, least(e, size)::INT AS e, array_to_string(w, ' ') AS t FROM z WHERE len(w) > 0 AND len(w) + (l - plain) // 2 >= 6),
    m AS (SELECT *, true AS whole FROM y UNION ALL SELECT *, false FROM h ANTI JOIN y USING (doc_id, s, e)),
    g AS (SELECT *, first_value(doc_id) OVER x AS kept_id, first_value(s) OVER x AS kept_start FROM m WINDOW x AS (PARTITION BY t ORDER BY doc_id, s)),
    b AS (SELECT *, max(CASE WHEN whole THEN e END) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach
          FROM g WHERE doc_id <> kept_id OR s <> kept_start)
    SELECT doc_id, s AS "start", e AS "end", kept_id, kept_start FROM b WHERE whole OR reach IS NULL OR reach < e
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated line of six words and more, and every repeated passage outside such lines, with offsets and the place that is kept."""
    return unit_dedup.repeated_units(read(spark, sf_dir, "documents"))


@query(
    "repeated_passages",
    f"""
    WITH {PASSAGES},
    g AS (SELECT doc_id, s, e, first_value(doc_id) OVER x AS kept_id, first_value(s) OVER x AS kept_start FROM h WINDOW x AS (PARTITION BY t ORDER BY doc_id, s))
    SELECT doc_id, s AS "start", e AS "end", kept_id, kept_start FROM g WHERE doc_id <> kept_id OR s <> kept_start
    """,
)
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of whole sentences or lines, in repeated lines too."""
    return unit_dedup.repeated_passages(read(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 8192 bytes without two of a source or of a group of equal texts in one."""
    return packing.pack(packing_rows(read(spark, sf_dir, "documents")), "n_bytes", CAPACITY)


def vocabulary() -> str:
    """The tokenizer file of this installation."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from encodings of whole documents."""
    return token_counts.section_tokens(read(spark, sf_dir, "documents"), vocabulary())


CONTROL = r"(\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]|\[/TURN\]|<s>|</s>)"


@query(
    "op8_chat_format",
    rf"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (SELECT *, length(regexp_replace(text, '{CONTROL}', '\\\1', 'g')) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                 ELSE length(regexp_replace(role, '{CONTROL}', '\\\1', 'g')) + 20 END AS n,
                 lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(n)::BIGINT AS formatted_chars,
           bool_and((before || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AND (NOT last OR role IN ('user', 'assistant'))) AS valid
    FROM e GROUP BY conv_id
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted, written, and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    segments = cut_lineage(chat_format.format_conversations(rows.unionByName(more)))
    return chat_format.read_conversations(chat_format.sorted_segments(segments))


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near copies of every document."""
    groups = simhash.simhash_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


@query(
    "op10_vector_dedup",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    m AS (SELECT a, least(a, min(b)) AS low FROM r GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(low, vec_id) AS component_id, vec_id = coalesce(low, vec_id) AS kept
    FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at a cosine of 0.95."""
    return vector_dedup.vector_groups(read(spark, sf_dir, "embeddings"))


TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@query(
    "op11_fill_middle",
    rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    n AS (SELECT *, len(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
    p AS (SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:n], '') AS suffix FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and the way back from the output."""
    made = fill_middle.restore_middle(fill_middle.fill_middle(read(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


@query(
    "op12_content_sort",
    """
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents, and the one that stays."""
    return content_dedup.exact_groups(read(spark, sf_dir, "documents"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query(
    "op13_lexical_search",
    rf"""
    WITH low AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS t FROM documents),
    d AS (SELECT row_number() OVER () AS r, doc_id, t, len(t) AS n FROM low WHERE len(t) > 0),
    c AS (SELECT count(*) AS docs, sum(n)::HUGEINT AS terms FROM d),
    q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS t FROM benchmark),
    f AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
    w AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM f GROUP BY t), c),
    g AS (SELECT r, doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)) AS f FROM f, c),
    s AS (SELECT item_id, r, doc_id, sum(w * f)::BIGINT AS score FROM q JOIN w USING (t) JOIN g USING (t) GROUP BY item_id, r, doc_id),
    k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 20
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
