"""The corpus queries with their SQL twins, by the names the driver calls."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from netobs.llm import anchors, chosen_path, fp_search, interpolated_lm, langid, licences, naming, packing, quality, sp_codec, topk, warc, whitening
from netobs.llm.common import Scratch, fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


@cache
def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def held_out(folds: int) -> Column:
    return (fold("doc_id", folds) == 2).alias("held_out")


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rules and weights from labelled rows outside the held-out fold.

    Null and empty texts have all statistics 0 and are scored like any other.
    """
    docs = table(spark, sf_dir, "documents")
    stats = Scratch(spark, "op1").save(quality.with_statistics(docs, "doc_id", "text"), "statistics")
    labels = quality.labels_of(table(spark, sf_dir, "labels")).where(fold("k", 4) != 2)
    model = quality.learn(stats.join(labels, "k"))
    scored = stats.select(F.col("k").alias("doc_id"), model.score().alias("score"))
    return scored.select(
        "doc_id", held_out(4), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted")
    )


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(fold("doc_id", 4) != 2), vocabulary("piece_bpe_32k.model"))
    return langid.identify(docs, model).select("doc_id", held_out(4), "lang_pred", "score")


NORMAL = "translate(coalesce(text, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')"


@query(
    "op7_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cp, sha256({NORMAL}) AS text_sha256 FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are the same text but for white space, and which one stays."""
    return naming.exact_dedup(table(spark, sf_dir, "documents")).drop("cp")


SHINGLES = """
    w AS (SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    g AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
            ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS grams FROM w)
"""


@query(
    "op10_near_dedup",
    f"""
    WITH RECURSIVE {SHINGLES},
    s AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
               FROM s AS a JOIN s AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
    low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT g.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, least(g.doc_id, coalesce(low.b, g.doc_id)) AS component_id,
           g.doc_id <= coalesce(low.b, g.doc_id) AS kept
    FROM g LEFT JOIN low ON low.a = g.doc_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on four-word shingles."""
    return chosen_path.near_components(table(spark, sf_dir, "documents"), 4).drop("print")


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces, packed into sequences of 2048."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query(
    "op4_exact_top_k",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
          FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 5
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector among all vectors."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op5_warc")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    number = F.expr("try_cast(nullif(substring(record_id, 10), '') AS BIGINT)")
    return read.select(
        number.alias("page_id"), "payload_bytes",
        F.coalesce(warc.base32_sha1(F.col("payload")), "digest").alias("payload_digest"), "record_type",
        F.expr("try_cast(nullif(substring(refers_to, 10), '') AS BIGINT)").alias("refers_to"),
    )


@query("op8_lm_score")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold.

    The weights of the interpolation are learned on a further fold of the
    training documents; the counts of both make the model.
    """
    docs = table(spark, sf_dir, "documents")
    part = fold("doc_id", 7)
    role = F.when(part == 2, interpolated_lm.OTHER).when(part == 5, interpolated_lm.HELD).otherwise(interpolated_lm.MAIN)
    scored = interpolated_lm.score(docs, role)
    return scored.select(
        "doc_id", (F.col("role") == interpolated_lm.OTHER).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


def licence_sql() -> str:
    """The scan in SQL, over the same templates."""
    rows = ", ".join(
        "('{}', {}, {})".format(name, len(g), "[" + ", ".join("'" + x + "'" for x in g) + "]")
        for name, g in ((n, licences.grams_of(t)) for n, t in licences.TEMPLATES.items())
    )
    return f"""
    WITH t(licence, size, grams) AS (VALUES {rows}),
    d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    parts AS (
      SELECT doc_id, 0 AS kind, string_split(text, chr(10)) AS p FROM d
      UNION ALL SELECT doc_id, 1, regexp_split_to_array(text, '\\n\\s*\\n') FROM d
      UNION ALL SELECT doc_id, 2, [text] FROM d),
    u AS (SELECT doc_id, kind, len(p) AS n, unnest(range(len(p))) AS unit_no, unnest(p) AS unit FROM parts),
    w AS (SELECT doc_id, kind, unit_no, list_filter(string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS words
          FROM u WHERE kind = 0 OR (contains(unit, chr(10)) AND (kind = 2 OR n > 1))),
    g AS (SELECT doc_id, kind, unit_no, list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS grams FROM w WHERE len(words) > 1),
    s AS (SELECT doc_id, kind, unit_no, licence, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + t.size) AS dice
          FROM g JOIN t ON len(g.grams) BETWEEN {licences.DICE} / (2 - {licences.DICE}) * t.size - 1e-6 AND (2 - {licences.DICE}) / {licences.DICE} * t.size + 1e-6),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, licence ORDER BY dice DESC, kind, unit_no) AS k FROM s WHERE dice >= {licences.DICE})
    SELECT doc_id, licence, dice, ['line', 'paragraph', 'text'][kind + 1] AS unit, CAST(unit_no AS INTEGER) AS unit_no FROM r WHERE k = 1
    """


@query("op3_licence_scan", licence_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and texts found in all documents, also inside lines and comment blocks.

    The SQL twin has lines, paragraphs and whole texts only.
    """
    return licences.scan(table(spark, sf_dir, "documents"), inside=True)


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, with digests of both."""
    docs = table(spark, sf_dir, "documents")
    path = vocabulary("piece_bpe_32k.model")
    back = sp_codec.decode(sp_codec.encode(docs, path), path)
    return back.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


@query(
    "op11_substring_dedup",
    """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    w AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word,
                 unnest([CASE WHEN k + 34 <= len(words) THEN array_to_string(words[k:k + 34], ' ') END FOR k IN range(1, len(words) + 1)]) AS run FROM d),
    r AS (SELECT run FROM w WHERE run IS NOT NULL GROUP BY run HAVING count(*) > 1),
    m AS (SELECT doc_id, i, word, r.run IS NOT NULL AS hit FROM w LEFT JOIN r USING (run)),
    c AS (SELECT doc_id, i, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
    o AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN o USING (doc_id)
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the runs of 35 words that stand in two places."""
    found = anchors.remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query(
    "op12_ranked_search",
    f"""
    WITH t AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
    g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
          FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
    m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // total) AS m FROM n, g),
    q AS (SELECT item_id, unnest({TERMS}) AS term FROM benchmark),
    s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
          FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return fp_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened by sixteen components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 16)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)
