"""The registered queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.shared import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents")).drop("keep_copies")


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.multi_index import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.bpe import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.suffix_repeats import find_repeats

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return find_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.rules import fit_rules, score_quality

    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_rules(docs, table(spark, sf_dir, "labels")), threshold=0.3)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.sstable import read_shards, write_shards

    return read_shards(write_shards(table(spark, sf_dir, "documents"))).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.languages import fit_languages, identify_languages, learned_from

    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, fit_languages(docs))
    return found.select("doc_id", (~learned_from(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_multi_index": op3_multi_index,
    "op4_near_dedup": op4_near_dedup,
    "op5_bpe": op5_bpe,
    "op6_packing": op6_packing,
    "op7_suffix_repeats": op7_suffix_repeats,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_shards": op9_token_shards,
    "op10_sharding": op10_sharding,
    "op11_languages": op11_languages,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d
    """,
    # every pair that shares a shingle, not only those that meet in a bucket
    "op4_near_dedup": """
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle FROM places),
        sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        meets AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM meets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(doc_id, met) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.met),
        least AS (SELECT doc_id, min(met) AS component_id FROM reach GROUP BY 1)
        SELECT l.doc_id, coalesce(n, 0) AS n_shingles, component_id, l.doc_id = component_id AS kept FROM least l LEFT JOIN sizes USING (doc_id)
    """,
    "op7_suffix_repeats": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 400) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM d)),
        twice AS (SELECT x FROM w GROUP BY x HAVING count(*) > 1),
        hit AS (SELECT doc_id, p FROM w SEMI JOIN twice USING (x)),
        starts AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM hit),
        runs AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM starts),
        spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY 1, 2),
        gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), any_value(len(h) // 2) FROM d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id),
        kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * g.a + 1 AS BIGINT), CAST(2 * (g.b - g.a) AS BIGINT)), '' ORDER BY g.a) AS h FROM gaps g JOIN d USING (doc_id) GROUP BY 1),
        counts AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
        SELECT doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
        FROM d JOIN kept k USING (doc_id) LEFT JOIN counts USING (doc_id)
    """,
    # crc32 by its table, a byte at a time; the middle of a row decides its shard
    "op10_sharding": """
        WITH table_ AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, CAST(len(h) // 2 + 1 AS BIGINT) AS size, list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))) AS bytes FROM d),
        c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS text_crc32 FROM b, table_),
        o AS (SELECT *, row_number() OVER w AS spot, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)),
        s AS (SELECT *, CAST(least(7, (2 * before + size) * 8 // (2 * total)) AS INTEGER) AS shard FROM o)
        SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(spot - min(spot) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
    """,
    "op12_collocations": """
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
        w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM places, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
        f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
        c AS (SELECT lang, phrase, k AS size, f AS a FROM f WHERE k >= 2 AND f >= 100),
        cuts AS (SELECT *, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS s FROM c),
        parts AS (SELECT lang, phrase, size, a, k, array_to_string(s[: k], ' ') AS x, array_to_string(s[k + 1 :], ' ') AS y FROM cuts),
        scored AS (SELECT p.lang, p.phrase, p.size, p.a, p.k, x.f AS l, y.f AS r, n, (CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
            FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.x JOIN f y ON y.lang = p.lang AND y.phrase = p.y JOIN n ON n.lang = p.lang),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS turn FROM scored) WHERE turn = 1),
        kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.lang = b.lang AND y.size > b.size AND y.a >= b.a AND contains(' ' || y.phrase || ' ', ' ' || b.phrase || ' '))),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
    """,
}
