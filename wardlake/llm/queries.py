"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import (
    contamination, filter_audit, language, license_scan, neighbours, packing, pii, secret_scan, simhash, spelling, suffix_tree_lm,
    token_counts, urls,
)
from wardlake.llm.common import in_fold, joined_spans, sha256_hex, small_batches, stored, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learned(docs)
    guessed = language.with_language(docs.select("doc_id", "text"), model)
    return guessed.select(
        "doc_id",
        in_fold(F.col("doc_id"), *language.HELD_OUT).alias("held_out"),
        F.col("guess.lang").alias("lang_pred"),
        F.col("guess.score").alias("score"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, tokenizer(token_counts.TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.with_secrets(docs, secret_scan.learned(docs))

    def n_of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "tagged")
    return found.select(
        "doc_id",
        *[n_of(k) for k in ("assign", "access", "hex")],
        sha256_hex(joined_spans(base)).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.grouped(docs).select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found_data(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def n_of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[n_of(kind) for kind in pii.KINDS],
        sha256_hex(joined_spans(F.col("base"))).alias("base_sha256"),
        joined_spans(F.concat("base", "added")).alias("spans"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = contamination.with_hits(docs, table(spark, sf_dir, "benchmark"))
    report = F.col("report")
    names = F.array_sort(F.transform(report["items"], lambda i: i.cast("string")))
    return read.select(
        "doc_id",
        report["n_words"].alias("n_words"),
        contamination.n_hit(report).alias("n_hit"),
        F.size(report["items"]).cast("bigint").alias("n_items"),
        sha256_hex(F.array_join(names, ",")).alias("items_sha256"),
        contamination.is_contaminated(report).alias("contaminated"),
    )


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


# The rules of the contract, in order: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged_urls(pages, urls.rules_table(spark, URL_RULES))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 100 == 0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(docs, tokenizer(packing.TOKENIZER))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("licenses")
    base = license_scan.base_places(found)
    starts = F.transform(base, lambda p: p["start"])
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"])))
    return license_scan.with_licenses(docs).select(
        "doc_id",
        found["n_words"].alias("n_words"),
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(license_scan.labels_of(found), ",").alias("labels"),
        license_scan.evidence(found).alias("score"),
        license_scan.freedom(found).alias("freedom"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped_words(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audited(docs, table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_token_counts, op3_secret_scan, op4_simhash, op5_personal_data, op6_decontamination, op7_suffix_tree, op8_url_filter, op9_nearest, op10_packing,
    op11_license_scan, op12_spelling_variants, op13_filter_audit,
)}
LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = f"coalesce(regexp_extract_all(translate(text, {LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)

# SQL with the same result, where SQL can express the method's outcome.
ORACLES: dict[str, str] = {
    "op6_decontamination": f"""
      WITH items AS (SELECT DISTINCT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
      windows AS (
        SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS run
        FROM (SELECT item_id, w, least({contamination.WINDOW}, len(w)) AS n,
                unnest(generate_series(1, greatest(len(w) - {contamination.WINDOW - 1}, 1))) AS i FROM items WHERE len(w) > 0)),
      sizes AS (SELECT DISTINCT n FROM windows),
      docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
      runs AS (
        SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS run
        FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n)),
      found AS (SELECT DISTINCT r, n, i, item_id FROM runs JOIN windows USING (n, run)),
      hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (
        SELECT r, unnest(generate_series(i, i + n - 1)) AS place FROM found) GROUP BY r),
      named AS (SELECT r, count(*) AS n_items, string_agg(item_id::varchar, ',' ORDER BY item_id::varchar) AS names
        FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
      SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
        sha256(coalesce(names, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND {contamination.ONE_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated
      FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "op8_url_filter": f"""
      WITH parts AS (
        SELECT row_number() OVER () AS r, page_id,
          coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {LETTERS}), '') AS host,
          coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
      rules(rule_host, rule_path, verdict) AS (VALUES {RULES}),
      fits AS (
        SELECT r, rule_host || rule_path AS rule, verdict,
          row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
        FROM parts JOIN rules
          ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
      SELECT page_id, host, path, rule, coalesce(verdict, '{urls.DEFAULT_VERDICT}') AS verdict
      FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (r)""",
    "op12_spelling_variants": f"""
      WITH RECURSIVE polynomial(i, c, k) AS (
        SELECT i, i, 0 FROM generate_series(0, 255) t(i)
        UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM polynomial WHERE k < 8),
      crc AS (SELECT list(c ORDER BY i) AS t FROM polynomial WHERE k = 8),
      runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, {LETTERS}), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
        FROM documents),
      counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY ALL),
      bytes AS (
        SELECT run, n, list_prepend(4294967295, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
          lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::bigint] ELSE [195, unicode(c)::bigint - 64] END))) AS b FROM counted),
      hashed AS (
        SELECT run, n, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295) AS h FROM bytes, crc),
      spelled AS (
        SELECT n, CASE WHEN h % {spelling.FAULT_ONE_IN} = 0
          THEN run[:h % length(run)] || run[2 + h % length(run):] ELSE run END AS word FROM hashed),
      words AS (
        SELECT word, sum(n)::bigint AS n FROM spelled WHERE length(word) >= {spelling.LEAST_LENGTH}
        GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
      without AS (
        SELECT word, n, i, word[:i - 1] || word[i + 1:] AS less FROM words, unnest(range(1, length(word) + 1)) u(i)),
      near AS (
        SELECT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b USING (less, i) WHERE a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON b.word = a.less
        UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON b.word = a.less),
      best AS (
        SELECT word, count(*) AS n_near, max(other_n) AS top, min(other) FILTER (other_n = most) AS first
        FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS most FROM near) GROUP BY word),
      forms AS (
        SELECT word, n, coalesce(n_near, 0)::bigint AS n_near, CASE WHEN top >= {spelling.TIMES} * n THEN first END AS form,
          CASE WHEN top >= {spelling.TIMES} * n THEN top END AS form_n
        FROM words LEFT JOIN best USING (word)),
      chains(word, root, depth) AS (
        SELECT word, word, 0 FROM forms
        UNION ALL SELECT c.word, f.form, depth + 1 FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
      SELECT word, form, max_by(root, depth) AS root, n, n_near, form_n
      FROM forms JOIN chains USING (word) GROUP BY word, form, n, n_near, form_n""",
    "op13_filter_audit": """
      WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
      measured AS (
        SELECT doc_id, part, t, string_split(trim(regexp_replace(t, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM texts),
      sized AS (
        SELECT *, CASE WHEN w = [''] THEN 0 ELSE len(w) END AS n_words, CASE WHEN w = [''] THEN 0 ELSE len(list_distinct(w)) END AS n_distinct,
          min(doc_id) OVER (PARTITION BY t) AS least FROM measured),
      failed AS (
        SELECT doc_id, part, (n_words < 200)::int + 2 * (100 * n_distinct < 50 * n_words)::int
          + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int
          + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int AS mask FROM sized),
      known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
      masks AS (
        SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
        FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, mask),
      letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
      orders AS (
        SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
      steps AS (
        SELECT filter_order, step::int AS step, l.letter, l.bit,
          (SELECT coalesce(sum(p.bit), 0)::int FROM letters p WHERE strpos(filter_order, p.letter) < step) AS before
        FROM orders, range(1, 6) s(step), letters l WHERE l.letter = filter_order[step]),
      report AS (
        SELECT part, filter_order, step, letter,
          sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::bigint AS kept,
          sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::bigint AS removed,
          sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::bigint AS redundant,
          sum(CASE WHEN mask = bit THEN n ELSE 0 END)::bigint AS unique_fails,
          sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::bigint AS good_lost,
          sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::bigint AS toxic_lost
        FROM masks, steps GROUP BY part, filter_order, step, letter)
      SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        sum(removed) OVER (PARTITION BY part, letter)::bigint AS shapley FROM report""",
}
