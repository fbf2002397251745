"""The named queries of this folder; each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import decontam, licences, linededup, merkle, passages, phrases, pieces, simhash, suffixdedup, supermin, tokencounts, topk, toxicity
from engram.llm.common import table
from engram.session import new_dir


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, toxicity.label_grades(table(spark, sf, "labels")), top=2)
    scored = toxicity.score(docs, model)
    return scored.withColumn("rejected", F.col("severity") >= toxicity.REJECT_FROM)


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = linededup.dedup_lines(table(spark, sf, "documents"))
    size = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    return cut.select("doc_id", "_cut.n_lines", "_cut.n_removed", size.cast("long").alias("n_bytes_kept"), F.sha2("text", 256).alias("kept_sha256"))


def op3_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return passages.passage_classes(table(spark, sf, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = licences.scan(docs, licences.fit(docs))
    sure = F.filter("hits", lambda h: h["confirmed"])
    families = F.array_join(F.array_sort(F.array_distinct(sure["family"])), ",")
    return found.select(
        "doc_id", "n_paragraphs", F.size("hits").alias("n_notices"), F.size(sure).alias("n_confirmed"),
        F.when(F.size(sure) > 0, families).alias("families"), F.array_max(sure["probability"]).alias("probability"),
        F.exists("hits", lambda h: h["family"] == licences.UNKNOWN).alias("has_unknown"),
    )


def op7_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffixdedup.dedup_strings(table(spark, sf, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.find_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    drawn = pieces.encode(table(spark, sf, "documents"))
    return drawn.select(
        "doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        "log_prob", "perturbed", "log_inclusion", "round_trip",
    )


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Four batches: every document; those of low quality deleted; the toxic ones
    recounted with white space collapsed; the Spanish ones under another version.
    The second batch is delivered twice."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    store = new_dir(spark, "token-counts")

    def events(counted: DataFrame, op: str, seq: int) -> DataFrame:
        return counted.withColumn("op", F.lit(op)).withColumn("seq", F.lit(seq))

    tokencounts.commit(spark, store, 0, events(tokencounts.count_tokens(docs), "insert", 0))
    poor = labels.where("quality = 0").select("doc_id", F.lit(tokencounts.VERSION).alias("version"))
    gone = events(poor.withColumns({"source": F.lit(None), "lang": F.lit(None), "tokens": F.lit(0)}), "delete", 1)
    tokencounts.commit(spark, store, 1, gone)
    # counted before the join, so that no text is shuffled
    short = tokencounts.count_tokens(docs.withColumn("text", F.regexp_replace("text", r"\s+", " ")))
    toxic = short.join(labels.where("toxic = 1 and quality = 1").select("doc_id"), "doc_id", "left_semi")
    tokencounts.commit(spark, store, 2, events(toxic, "revise", 2))
    tokencounts.commit(spark, store, 1, gone)
    other = tokencounts.count_tokens(docs.where("lang = 'es'"), "byte_bpe_multi_50k")
    tokencounts.commit(spark, store, 3, events(other, "insert", 3))
    return tokencounts.totals(spark, store)


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(table(spark, sf, "documents"), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op12_supermin_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return supermin.near_duplicates(table(spark, sf, "documents")).drop("key")


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_topk": op3_exact_topk,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_licence_scan": op6_licence_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_supermin_dedup": op12_supermin_dedup,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_merkle_manifest": r"""
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                        lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
            FROM (SELECT unnest(range(256)) AS i)
        ), d AS (
            SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 2 = 0
                      THEN replace(text, chr(10), '') ELSE text END AS got
            FROM documents, crc
        ), f AS (
            SELECT doc_id, source,
                   coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
                   coalesce(strlen(text) || ':' || text, '-') AS t, coalesce(strlen(got) || ':' || got, '-') AS g
            FROM d
        ), leaves AS (
            SELECT row_number() OVER (ORDER BY source, doc_id, l, r) AS rid, doc_id, source, l, r,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, l, r) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
            FROM (SELECT doc_id, source, sha256(head || t) AS l, sha256(head || g) AS r FROM f)
        ), up AS (
            SELECT coalesce('s' || source, '') AS tree, 0 AS lvl, pos, n, l AS h FROM leaves
            UNION ALL
            SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 3, n
        ), subs AS (
            SELECT tree, lvl AS height, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
        ), top AS (
            SELECT 0 AS lvl, pos, n, h FROM subs
            UNION ALL
            SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n
        ), nodes AS (
            SELECT tree, lvl, pos, h FROM up WHERE n > 1
            UNION ALL
            SELECT s.tree, s.height + t.lvl, t.pos, t.h FROM subs s, top t WHERE t.n > 1
        ), steps AS (
            SELECT a.rid, a.lvl,
                   coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before,
                   coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
            FROM (
                SELECT rid, tree, lvl, CASE WHEN lvl < height THEN pos // CAST(3 ** lvl AS BIGINT) ELSE spos // CAST(3 ** (lvl - height) AS BIGINT) END AS pos
                FROM (
                    SELECT e.rid, s.tree, s.height, e.pos, s.pos AS spos, unnest(range(s.height + (SELECT max(lvl) FROM top))) AS lvl
                    FROM leaves e JOIN subs s ON coalesce('s' || e.source, '') = s.tree
                )
            ) a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
            GROUP BY a.rid, a.lvl, a.pos
        ), folded AS (
            SELECT rid, 0 AS lvl, r AS h FROM leaves
            UNION ALL
            SELECT f.rid, f.lvl + 1, sha256(s.before || f.h || s.after) FROM folded f JOIN steps s ON f.rid = s.rid AND f.lvl = s.lvl
        ), ends AS (
            SELECT rid, arg_max(h, lvl) AS h FROM folded GROUP BY rid
        ), proofs AS (
            SELECT rid, string_agg(before || after, '' ORDER BY lvl) AS p FROM steps GROUP BY rid
        )
        SELECT e.doc_id, e.l AS leaf, s.h AS subroot, t.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256,
               x.h AS folded_root, x.h = t.h AS verified
        FROM leaves e JOIN subs s ON coalesce('s' || e.source, '') = s.tree JOIN ends x ON e.rid = x.rid
             JOIN top t ON t.n = 1 LEFT JOIN proofs p ON e.rid = p.rid""",
    "op12_supermin_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
            FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), pairs AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
        ), links AS (
            SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
        ), near AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION
            SELECT r.doc_id, l.b FROM reach r JOIN near l ON r.other = l.a
        ), least AS (
            SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT l.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, l.doc_id = component_id AS kept
        FROM least l LEFT JOIN n ON l.doc_id = n.doc_id""",
    "op13_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), w AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
        ), t AS (
            SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
        ), g AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
            FROM w, range(1, 6) AS s(k)
        ), f AS (
            SELECT lang, k, g, string_split(g, ' ') AS w, count(*) AS a FROM g GROUP BY lang, k, g HAVING count(*) >= 100
        ), cuts AS (
            SELECT c.lang, c.k, c.g, c.a, j, l.a AS l, r.a AS r, t.n,
                   CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
            FROM f c JOIN range(1, 5) AS s(j) ON j < c.k
                 JOIN f l ON l.lang = c.lang AND l.g = array_to_string(c.w[1:j], ' ')
                 JOIN f r ON r.lang = c.lang AND r.g = array_to_string(c.w[j + 1:c.k], ' ')
                 JOIN t ON t.lang = c.lang
        ), worst AS (
            SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS place FROM cuts
        ), alive AS (
            SELECT * FROM worst c
            WHERE place = 1 AND NOT EXISTS (
                SELECT 1 FROM f d WHERE d.lang = c.lang AND d.k > c.k AND contains(' ' || d.g || ' ', ' ' || c.g || ' ') AND 100 * d.a >= 100 * c.a)
        ), ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score FROM alive
        )
        SELECT * FROM ranked WHERE rank <= 2000""",
}
