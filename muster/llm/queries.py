"""The queries of this subpackage's operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import block_ann, disclosure, jaccard, label_shards, line_spread, mixture_lang, packing, perplexity, prefix_trie, recompression, sentencepieces, token_alignment, url_filter
from muster.llm.common import table


def sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.verify(table(spark, sf_dir, "documents"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = line_spread.remove_spread_lines(docs)
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), digest.alias("kept_sha256"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def mixture_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixture_lang.learn(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = mixture_lang.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.rate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_ppl", "lower", "upper"
    )


def block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return block_ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def disclosure_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda i: F.size(F.filter("base_spans", lambda s: s.kind == i)).cast("long")
    count = {f"n_{k}": of(i) for i, k in enumerate(disclosure.KINDS)}
    base = F.sha2(F.encode(disclosure.spans_text(F.col("base_spans")), "UTF-8"), 256).alias("base_sha256")
    return found.select("doc_id", *[c.alias(n) for n, c in count.items()], base, disclosure.spans_text(F.col("all_spans")).alias("spans"))


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = label_shards.balanced_shards(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompression.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


# The rules the contract states.
URL_RULES = [
    url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"),
]


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: addresses of pages that were reached by a tracking link; it blocks the page in every spelling."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, pages.where(url_filter.tracked(F.col("url")))).drop("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": sentencepiece_round_trip,
    "op2_line_spread": line_dedup,
    "op3_mixture_language": mixture_language,
    "op4_mixture_packing": mixture_packing,
    "op5_ngram_perplexity": ngram_perplexity,
    "op6_block_matrix_ann": block_matrix_ann,
    "op7_balanced_shards": balanced_shards,
    "op8_disclosure": disclosure_control,
    "op9_jaccard_join": jaccard_join,
    "op10_recompression": recompression_dedup,
    "op11_prefix_trie": conversation_trie,
    "op12_url_bloom": url_verdicts,
    "op13_token_alignment": alignment,
}

SQL: dict[str, str] = {
    "op2_line_spread": f"""
        WITH lines AS (
          SELECT rowid AS r, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos
          FROM (SELECT row_number() OVER () AS rowid, text FROM documents)
        ), docs AS (SELECT row_number() OVER () AS r, * FROM documents),
        keyed AS (
          SELECT l.r, d.doc_id, coalesce(d.source, chr(1)) AS site, l.pos, l.line, trim(l.line, ' ' || chr(9) || chr(13)) AS bare
          FROM lines l JOIN docs d USING (r)
        ), spread AS (
          SELECT bare, min((doc_id, pos)) AS first FROM keyed WHERE bare <> ''
          GROUP BY bare HAVING count(DISTINCT site) >= {line_spread.MIN_SITES}
        ), judged AS (
          SELECT k.r, k.pos, k.line, s.bare IS NULL OR (k.doc_id, k.pos) = s.first AS kept
          FROM keyed k LEFT JOIN spread s USING (bare)
        )
        SELECT any_value(d.doc_id) AS doc_id, count(j.r) AS n_lines, count(*) FILTER (NOT j.kept) AS n_removed,
               sha256(coalesce(string_agg(j.line, chr(10) ORDER BY j.pos) FILTER (j.kept), '')) AS kept_sha256
        FROM docs d LEFT JOIN judged j USING (r) GROUP BY d.r""",
    "op6_block_matrix_ann": """
        WITH ok AS (
          SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
          WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id,
                 list_reduce(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]), lambda a, b: a + b) AS score
          FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        ), numbered AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        ) SELECT * FROM numbered WHERE rank <= 20""",
    # Every prefix is a list of turns; a node's subtree is the nodes whose list begins with its own.
    "op11_prefix_trie": """
        WITH turns AS (
          SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
          FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (SELECT conv_id, list(t ORDER BY i) AS ts FROM turns GROUP BY conv_id),
        checked AS (
          SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda r, c: list_reduce(list_prepend(xor(r, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
              lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 6 AS h FROM own
        ), rebuilt AS (
          SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts
          FROM checked c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
        ), members AS (
          SELECT conv_id, len(ts) AS n, d AS depth, ts[1:d] AS path FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)
        ), nodes AS (
          SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = depth AS leaf,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
          FROM members GROUP BY path, depth
        ), below AS (
          SELECT a.path, count(*) FILTER (x.leaf) AS n_leaves, count(*) FILTER (x.depth = len(a.path) + 1) AS n_children,
                 sum(CASE WHEN x.depth > 0 THEN (x.n_convs - 1) * length(x.path[-1].text) ELSE 0 END) AS saved
          FROM (SELECT path AS whole, leaf, depth, n_convs, path, unnest(range(0, depth + 1)) AS d FROM nodes) x
          JOIN nodes a ON a.path = x.whole[1:x.d] AND a.depth = x.d GROUP BY a.path
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN nodes p ON p.path = n.path[1:n.depth - 1] AND n.depth > 0""",
    "op12_url_bloom": r"""
        WITH cut AS (
          SELECT page_id, url, instr(url, '://') AS place, substr(url, instr(url, '://') + 3) AS rest FROM pages
        ), parts AS (
          SELECT page_id, url,
                 CASE WHEN place > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                 CASE WHEN place > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
                 string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&') AS asked FROM cut
        ), formed AS (
          SELECT page_id, host, path, len(list_filter(asked, lambda p: regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) > 0 AS tracked,
                 regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '')
                 || regexp_replace(regexp_replace(path, '(/index)?\.html$', ''), '/$', '') AS page,
                 list_sort(list_filter(asked, lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS kept FROM parts
        ), keyed AS (
          SELECT *, CASE WHEN host <> '' THEN page || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS key FROM formed
        ), rules(action, rh, rp) AS (
          VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
        ), named AS (
          SELECT k.*, (SELECT arg_max({'rule': rh || rp, 'action': action}, length(rh || rp)) FROM rules
                       WHERE (k.host = rh OR ends_with(k.host, '.' || rh)) AND starts_with(k.path, rp)) AS best FROM keyed k
        ), listed AS (SELECT DISTINCT key AS l FROM keyed WHERE tracked AND key IS NOT NULL)
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule,
               coalesce(best.action, CASE WHEN l IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM named LEFT JOIN listed ON key = l""",
}
