"""The operators over the given tables, by query name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwatch.llm.tables import crc_mod, table

RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
GLOBS = ["**spam**", "*casino*/**", "*/**/wp-admin/**", "*/ads/**", "**.exe"]


def op1_pii_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    from panelwatch.llm.pii import find_pii

    return find_pii(table(spark, folder, "documents")).drop("all_spans", "row")


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from panelwatch.llm.ngram_join import ngram_join

    return ngram_join(table(spark, folder, "documents"))


def op3_toxicity_ftrl(spark: SparkSession, folder: str) -> DataFrame:
    from panelwatch.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, folder, "labels"), train=crc_mod(F.col("key"), 5) != 0)
    return score_toxicity(docs, model).select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from panelwatch.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"))


def domains(labels: DataFrame) -> DataFrame:
    """The domain of each labelled document, by its quality."""
    domain = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    return labels.select(F.col("doc_id").alias("key"), domain.alias("domain"))


TARGETS = {"good": 0.95, "plain": 0.05}


def op5_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from panelwatch.llm.mixing import mix

    return mix(table(spark, folder, "documents"), domains(table(spark, folder, "labels")), TARGETS).drop("row")


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from panelwatch.llm.url_filter import filter_urls

    return filter_urls(table(spark, folder, "pages"), "url", RULES, GLOBS, ["page_id"])


def op7_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    from panelwatch.llm.nn_descent import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    from panelwatch.llm.lm_scoring import score_texts

    return score_texts(table(spark, folder, "documents"), crc_mod(F.col("doc_id"), 7) == 2)


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from panelwatch.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, folder, "documents"), phrases=True)


def op10_top_k_search(spark: SparkSession, folder: str) -> DataFrame:
    from panelwatch.llm.topk import top_k_search

    return top_k_search(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0)


def op11_superkmer_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from panelwatch.llm.superkmers import remove_repeated_windows

    return remove_repeated_windows(table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from panelwatch.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, label)


def op13_block_max_search(spark: SparkSession, folder: str) -> DataFrame:
    from panelwatch.llm.block_max import ranked_search

    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def queries() -> dict:
    ours = (
        op1_pii_bootstrap, op2_ngram_jaccard_join, op3_toxicity_ftrl, op4_best_fit_packing, op5_soft_mixing, op6_url_filter,
        op7_nn_descent, op8_lm_scoring, op9_suffix_dedup, op10_top_k_search, op11_superkmer_dedup, op12_hard_negatives,
        op13_block_max_search,
    )
    return {f.__name__: f for f in ours}


_RULE_HITS = " ".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
    for r in sorted(RULES, key=lambda r: (-len(r), r))
)
_BLOCKED = (
    r"contains(host || path, 'spam') OR regexp_matches(host || path, '^[^/]*casino[^/]*/', 's') "
    r"OR regexp_matches(host || path, '^[^/]*/(.*)/wp-admin/', 's') OR regexp_matches(host || path, '^[^/]*/ads/', 's') "
    r"OR ends_with(host || path, '.exe')"
)


def oracle_sql() -> dict[str, str]:
    verdicts = ", ".join(f"'{r}': '{v}'" for r, v in RULES.items())
    return {
        "op6_url_filter": f"""
            WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
                 cut AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS raw FROM rest),
                 parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                                  regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM cut),
                 ruled AS (SELECT *, CASE {_RULE_HITS} END AS rule FROM parts)
            SELECT page_id, host, path, rule,
                   coalesce(map_extract(MAP {{{verdicts}}}, rule)[1], CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict
            FROM ruled""",
        "op10_top_k_search": """
            WITH whole AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS DOUBLE)) AS x
                           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                             AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
                 scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
                            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
                 ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
            SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
        "op11_superkmer_dedup": r"""
            WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
                 windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS name
                             FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM docs)),
                 firsts AS (SELECT name, min(doc_id) AS first FROM windows GROUP BY name),
                 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place
                          FROM windows JOIN firsts USING (name) WHERE first < doc_id),
                 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n
                          FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM docs)
                               ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
            SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM docs LEFT JOIN kept USING (doc_id)""",
        "op12_hard_negatives": """
            WITH whole AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                                  list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS DOUBLE)) AS x
                           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                             AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
                 scored AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
                                   CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
                            FROM whole a JOIN whole c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
                 positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
                               QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
            SELECT anchor_id, positive_id,
                   CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
                   other_id AS negative_id, positive_score, score AS negative_score
            FROM positives JOIN scored USING (anchor_id)
            WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
            QUALIFY rank <= 5""",
        "op13_block_max_search": r"""
            WITH terms AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                                  lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS found FROM documents),
                 corpus AS (SELECT count(*) FILTER (WHERE len(found) > 0) AS docs, sum(len(found))::BIGINT AS total FROM terms),
                 postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(found) AS term FROM terms) GROUP BY ALL),
                 measures AS (SELECT doc_id, 100 - 90 + (90 * len(found) * docs) // total AS m FROM terms, corpus WHERE total > 0),
                 weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
                             FROM postings, corpus GROUP BY term, docs),
                 asked AS (SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                                  lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM benchmark),
                 scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
                            FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN measures USING (doc_id) GROUP BY ALL)
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM scored WHERE score > 0 QUALIFY rank <= 10""",
    }
