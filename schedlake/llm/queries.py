"""The registered queries of this package, each next to the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from schedlake.llm import alignment, decontamination, jaccard, licenses, ngram_lm, packing, pii, quality, runs, suffix_dedup, token_files, url_filter, warc
from schedlake.llm.shared import bind, documents, split_words, written
from schedlake.session import run_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn
    return register


ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all({LOWER}, '{ITEM_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
item_windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id,
    unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS pattern
  FROM item_words WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(string_split(pattern, ' ')) AS n FROM item_windows),
doc_words AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ITEM_WORD}') AS w FROM documents),
grams AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2),
    lambda k: array_to_string(w[k:k + n - 1], ' '))) AS pattern FROM doc_words, sizes WHERE len(w) >= n),
found AS (SELECT doc_id, i, n, item_id FROM grams JOIN item_windows USING (pattern)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op1_decontamination(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    scanned = decontamination.decontaminate(documents(spark, sf_dir, "doc_id", "text"), benchmark)
    return scanned.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontamination.contaminated().alias("contaminated"))


#: The rule list of the registered query.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


@query(r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM parts),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host) * 10000 + length(rule_path)) AS rule,
    arg_max(verdict, length(rule_host) * 10000 + length(rule_path)) AS verdict
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (page_id)
""")
def op2_url_filter(spark, sf_dir):
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES)


def _prior_sql(rule: str) -> str:
    """``a_<rule>``, ``b_<rule>``: the beta prior of a rule from the totals, as ``quality.beta_prior``."""
    mean = f"least(greatest(f_{rule} / total, 0.5 / (total + 1)), 1 - 0.5 / (total + 1))"
    spread = f"(q_{rule} - total * (f_{rule} / total) ** 2 - (hosts - 1) * {mean} * (1 - {mean})) / greatest(total - hosts, 1)"
    strength = (f"CASE WHEN hosts < 2 OR {spread} <= 0 THEN 1000.0 "
                f"ELSE least(greatest({mean} * (1 - {mean}) / ({spread}) - 1, 1.0), 1000.0) END")
    return f"{mean} * ({strength}) AS a_{rule}, (1 - {mean}) * ({strength}) AS b_{rule}"


HOST_RULES = list(quality.RULES)


@query(rf"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i,
    unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS g FROM words WHERE len(w) >= 8),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM repeats) GROUP BY doc_id),
signals AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeats, 100 * n_symbols > 25 * word_chars AS symbols,
    word_chars < 2 * n_words OR word_chars > 20 * n_words AS odd_words FROM signals),
hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(sum(CAST({r} AS INT)) AS DOUBLE) AS f_{r}" for r in HOST_RULES)}
  FROM judged GROUP BY source),
totals AS (
  SELECT sum(n) AS total, CAST(count(*) AS DOUBLE) AS hosts,
    {", ".join(f"sum(f_{r}) AS f_{r}, sum(f_{r} * f_{r} / n) AS q_{r}" for r in HOST_RULES)} FROM hosts),
priors AS (SELECT {", ".join(_prior_sql(r) for r in HOST_RULES)} FROM totals),
bad AS (
  SELECT source FROM hosts, priors
  WHERE greatest({", ".join(f"(f_{r} + a_{r}) / (n + a_{r} + b_{r})" for r in HOST_RULES)}) >= {quality.HOST_FAILURE_RATE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM judged.source) AS host_failed,
  NOT (short OR repeats) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM judged.source) AS kept
FROM judged
""")
def op3_quality_rules(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir, "doc_id", "text", "source"))


@query()
def op9_best_fit_packing(spark, sf_dir):
    cut = packing.written_pieces(documents(spark, sf_dir, "doc_id", "text"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query()
def op10_token_files(spark, sf_dir):
    path = run_folder(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir, "doc_id", "text"), path)
    return token_files.checksums(token_files.read_tokens(spark, path))


@query()
def op6_personal_data(spark, sf_dir):
    found = pii.find_in(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [pii.number_of(base, kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written_out(base), 256).alias("base_sha256"),
                        pii.written_out(F.col("spans")).alias("spans"))


def _templates_sql() -> str:
    rows = sorted({(name, tuple(licenses.template_bigrams(text))) for name, text in licenses.NOTICES})
    return ", ".join(f"({i}, '{name}', [{', '.join(repr(b) for b in bigrams)}])" for i, (name, bigrams) in enumerate(rows))


@query(rf"""
WITH templates(t, name, b) AS (VALUES {_templates_sql()}),
template_bigrams AS (SELECT t, unnest(b) AS g FROM templates),
cut AS (
  SELECT doc_id, unnest(list_distinct(list_transform(
    list_concat([x], string_split(x, chr(10)), string_split(regexp_replace(x, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))),
    lambda p: trim(regexp_replace(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))))) AS part
  FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)),
words AS (SELECT doc_id, part, string_split(part, ' ') AS w FROM cut),
bigrams AS (
  SELECT doc_id, part, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words),
each AS (SELECT doc_id, part, len(g) AS n, unnest(g) AS g FROM bigrams),
shared AS (SELECT doc_id, part, t, any_value(n) AS n, count(*) AS c FROM each JOIN template_bigrams USING (g) GROUP BY doc_id, part, t),
found AS (
  SELECT doc_id, name, 2.0 * c / (n + len(b))::DOUBLE AS dice FROM shared JOIN templates USING (t)
  WHERE 2.0 * c / (n + len(b))::DOUBLE >= {licenses.LEAST}),
best AS (
  SELECT doc_id, count(*) AS n_matches, arg_min(name, (-dice, name)) AS license, max(dice) AS dice,
    array_to_string(list_sort(list(DISTINCT name)), ',') AS licenses FROM found GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, license, CAST(dice AS DOUBLE) AS dice, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN best USING (doc_id)
""")
def op4_license_scan(spark, sf_dir):
    return licenses.licenses(documents(spark, sf_dir, "doc_id", "text"))


@query()
def op5_jaccard_join(spark, sf_dir):
    return jaccard.similar(documents(spark, sf_dir, "doc_id", "text"))


@query()
def op8_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir, "doc_id", "text"), carry=("doc_id",))
    return found.select("row.doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op7_language_model(spark, sf_dir):
    return ngram_lm.score(documents(spark, sf_dir, "doc_id", "text"))


def made_periodic(doc_id, text):
    """The contract's texts of ``op12``: where a document's number says so, the words from a place on repeat the first few
    of them. A null id changes nothing."""
    h = F.crc32(doc_id.cast("string"))

    def repeated(words):
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(
            words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), bind(split_words(text), repeated)).otherwise(text)


@query()
def op12_periodic_runs(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = runs.collapse(docs.withColumn("text", made_periodic(F.col("doc_id"), F.col("text"))), carry=("doc_id",))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shortness"), r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("top", top).select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"),
        (-F.col("top.shortness")).alias("length"), F.col("top.period").alias("period"),
        F.expr("(-1000 * top.shortness) div top.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query(f"""
WITH known AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (
  SELECT payload_digest, max(page_id) AS last FROM known WHERE payload_bytes >= {warc.LEAST_REVISIT} GROUP BY payload_digest HAVING count(*) > 1),
marked AS (
  SELECT known.*, CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} AND page_id IS DISTINCT FROM last THEN last END AS refers_to
  FROM known LEFT JOIN last USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM marked
""")
def op13_warc_normaliser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = warc.write_archives(warc.with_revisits(pages), run_folder(spark, "warc-streams"))
    folder = run_folder(spark, "warc")
    warc.normalise(archives, folder)
    index = warc.read_index(spark, folder).where(F.col("record_type").isin("response", "revisit"))
    number = [F.nullif(F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1), F.lit("")).cast("long").alias(name)
              for c, name in (("record_id", "page_id"), ("refers_to", "refers_to"))]
    return warc.read_records(index, payload=False).select(number[0], "payload_bytes", "payload_digest", "record_type", number[1])


@query()
def op11_token_alignment(spark, sf_dir):
    aligned = alignment.align(documents(spark, sf_dir, "doc_id", "text"), carry=("doc_id",))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = written(aligned.select("row.doc_id", "n_a", "n_b", "n_groups", digest, "links"), "aligned")
    return alignment.with_counts(aligned, alignment.link_counts(aligned))
