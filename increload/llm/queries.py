"""The corpus operators as queries over the whole of their tables, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from increload.llm.bsi_topk import bit_sliced_top_k
from increload.llm.common import table
from increload.llm.fill_in_middle import fill_in_middle, restored
from increload.llm.hilbert import shard_documents
from increload.llm.licences import scan_licences
from increload.llm.line_dedup import remove_boilerplate
from increload.llm.mixing import mix_decisions
from increload.llm.packing import pack
from increload.llm.pii import KINDS, count_kind, find_personal_data, span_text
from increload.llm.quality import fit_quality, score_quality
from increload.llm.simhash import simhash_components
from increload.llm.simplex_clusters import cluster_vectors, components_sha256
from increload.llm.suffix_dedup import remove_repeats
from increload.llm.vector_graph import near_duplicate_vectors

TOKENIZER = "word_bpe_49k.json"


def op1_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced_top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = span_text(F.col("base"))
    counts = [count_kind("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op3_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's calibrated view scores and whether it is kept."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs, fit_quality(docs, labels))
    p = [F.round(f"__llm_{c}", 6).alias(c) for c in ("p_content", "p_meta", "p")]
    return scored.select("doc_id", *p, (F.col("__llm_p") >= 0.5).alias("keep"))


def op4_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_components(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), window=2048)


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_decisions(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_rate=3.0)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, how many of them go, and the hash of what stays."""
    rows = remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=5, stats=True)
    return rows.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op9_pruned_graph_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, then the digits of the
    id, so that document 123 lies in the directory .../1/2 beside document 124
    and below document 12."""
    docs = table(spark, sf_dir, "documents")
    digits = F.regexp_replace(F.col("doc_id").cast("string"), r"(?<=[0-9])(?=[0-9])", "/")
    parts = [F.coalesce(c, F.lit("unknown")) for c in (F.col("source"), F.col("lang"), digits)]
    return scan_licences(docs, F.concat_ws("/", *parts), carry=("doc_id",))


def op11_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed="1", dims=64)
    rows = [(r["cluster"], r["cluster_inertia"], components_sha256(r["components"])) for r in found.centroids.collect()]  # k rows
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(per), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia",
        F.lit(found.inertia).cast("long").alias("inertia"), "centroid_sha256",
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"), seed="42", rate=50, spm_rate=80)
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {f.__name__: f for f in (
    op1_bit_sliced_top_k, op2_personal_data, op3_cotrained_quality, op4_simhash_blocks, op5_hilbert_shards,
    op6_best_fit_packing, op7_pivotal_mix, op8_boilerplate_lines, op9_pruned_graph_duplicates, op10_licence_scan,
    op11_simplex_clusters, op12_fill_in_middle, op13_suffix_repeats,
)}

def _clusters_sql(k: int, rounds: int, dims: int) -> str:
    """The clustering without bounds: every vector against every centroid in each round."""
    steps = [f"""
        v AS (
            SELECT vec_id, row_number() OVER () AS r, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
            FROM embeddings
            WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), c0 AS (
            SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS j, e AS c FROM v QUALIFY j < {k}
        )"""]
    assign = """a{i} AS (
            SELECT vec_id, r, e, j, d FROM (
                SELECT v.*, j, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(e, c)]) AS BIGINT) AS d FROM v, c{i}
            ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1
        )"""
    for i in range(rounds):
        steps.append(assign.format(i=i))
        steps.append(f"""s{i} AS (
            SELECT j, p, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(e) AS x, unnest(range({dims})) AS p FROM a{i}) GROUP BY j, p
        ), m{i} AS (
            SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS c FROM s{i} GROUP BY j
        ), c{i + 1} AS (
            SELECT o.j, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m ON m.j = o.j
        )""")
    steps.append(assign.format(i=rounds))
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, d AS distance,
               CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j
    """


ORACLE_SQL = {
    "op1_bit_sliced_top_k": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
    """,
    "op8_boilerplate_lines": """
        WITH raw AS (
            SELECT doc_id, coalesce('s' || source, '') AS site, string_split(text, chr(10)) AS ls
            FROM documents WHERE text IS NOT NULL
        ), lines AS (
            SELECT doc_id, site, line, ls[line] AS l,
                   trim(translate(ls[line], chr(9) || chr(13) || chr(11) || chr(12), '    ')) AS bare
            FROM (SELECT doc_id, site, ls, unnest(range(1, len(ls) + 1)) AS line FROM raw)
        ), spread AS (
            SELECT bare FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= 5
        ), marked AS (
            SELECT l.*, s.bare IS NOT NULL
                   AND row_number() OVER (PARTITION BY l.bare ORDER BY doc_id, line) > 1 AS gone
            FROM lines l LEFT JOIN spread s ON l.bare = s.bare
        )
        SELECT d.doc_id, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0) AS n_removed,
               md5(CASE WHEN m.n_removed > 0 THEN coalesce(m.kept, '') ELSE d.text END) AS text_md5
        FROM documents d LEFT JOIN (
            SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_removed,
                   string_agg(l, chr(10) ORDER BY line) FILTER (WHERE NOT gone) AS kept
            FROM marked GROUP BY doc_id
        ) m ON d.doc_id = m.doc_id
    """,
    "op11_simplex_clusters": _clusters_sql(k=16, rounds=3, dims=64),
    "op12_fill_in_middle": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', doc_id)) AS h,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
            FROM documents
        ), n AS (
            SELECT *, len(u) AS n, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN range(4)] AS x FROM t
        ), c AS (
            SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 50
                        THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM n
        ), p AS (
            SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf
            FROM c
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_suffix_repeats": """
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents
        ), w AS (
            SELECT r, p, sha256(b[p + 1:p + 400]) AS h FROM (SELECT r, b, unnest(range(0, octet_length(b) - 399)) AS p FROM d)
        ), hit AS (
            SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1
        ), run AS (
            SELECT r, p, sum(CASE WHEN p <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS g
            FROM (SELECT r, p, lag(p, 1, -401) OVER (PARTITION BY r ORDER BY p) AS before FROM hit)
        ), span AS (
            SELECT r, g, min(p) AS s, max(p) + 400 AS e FROM run GROUP BY r, g
        ), gap AS (
            SELECT r, s AS z, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a FROM span
            UNION ALL
            SELECT span.r, max(octet_length(b)) AS z, max(e) AS a FROM span JOIN d ON d.r = span.r GROUP BY span.r
        ), kept AS (
            SELECT d.r, unhex(string_agg(hex(b[a + 1:z]), '' ORDER BY a)) AS k FROM gap JOIN d ON d.r = gap.r GROUP BY d.r
        ), removed AS (
            SELECT r, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY r
        )
        SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
               coalesce(n_spans, 0) AS n_spans, sha256(coalesce(k, b)) AS kept_sha256
        FROM d LEFT JOIN removed ON removed.r = d.r LEFT JOIN kept ON kept.r = d.r
    """,
}
