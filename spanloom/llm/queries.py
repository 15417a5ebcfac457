"""The queries opN_<name> and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, divergence, langid, mixing, pii, quality, simhash, substring_dedup, suffix_dedup, toxicity, url_filter, vector_codes, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The production rules of the URL filter.
URL_RULES = [url_filter.rule(t, a) for t, a in (("com/en/", False), ("example.com/en/7", True), ("net/de/", True), ("example.net/de/8", False), ("org/es/", False))]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), 35, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("n"))
    # quality labels weigh the draw: good documents come twice as early as unlabelled ones, poor ones half as early
    labels = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = docs.join(labels, "doc_id", "left")
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return mixing.mix(docs, F.col("n"), weight).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"), digest=True).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), 3, 2).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(toxicity.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), 200, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_read(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_warc_salvage, op3_url_filter, op4_substring_dedup, op5_source_mixing, op6_quality_cascade, op7_simhash_near_dedup, op8_toxicity, op9_pii, op10_language_id, op11_suffix_dedup, op12_vector_codes, op13_source_divergence)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _url_sql() -> str:
    """Rules, exact n-gram counts of ruled URLs, the interpolated ratio and the calibrated threshold."""
    o = range(url_filter.ORDER + 1)
    rules = sorted(URL_RULES, key=lambda r: (len(r.text), r.text), reverse=True)
    fits = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in rules)
    allowed = ", ".join(f"'{r.text}'" for r in rules if r.allow)
    pad = url_filter.ORDER
    p = {"a": "1 / 256.0::DOUBLE", "r": "1 / 256.0::DOUBLE"}
    for k in o:
        p = {x: f"((coalesce(g{k}.{x}, 0) + {url_filter.ESCAPE} * {p[x]}) / (coalesce(c{k}.{x}, 0) + {url_filter.ESCAPE}))" for x in p}
    joins = " ".join(f"LEFT JOIN gram g{k} ON g{k}.o = {k} AND g{k}.k = substr(s, i + {pad - k}, {k + 1}) LEFT JOIN ctx c{k} ON c{k}.o = {k} AND c{k}.k = substr(s, i + {pad - k}, {k})" for k in o)
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
h AS (SELECT *, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS rest FROM u),
hp AS (SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM h),
p AS (SELECT *, CASE {fits} END AS rule, coalesce(('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 5, 0) = 0 AS held, row_number() OVER () AS n, repeat(chr(2), {pad}) || u || chr(1) AS s FROM hp),
pos AS (SELECT n, s, rule, held, unnest(range(1, length(s) - {pad - 1})) AS i FROM p),
n AS (SELECT rule IN ({allowed}) AS ok, o, substr(s, i + {pad} - o, o + 1) AS gram, substr(s, i + {pad} - o, o) AS ctx FROM pos, range({len(o)}) t(o) WHERE rule IS NOT NULL AND NOT held),
gram AS (SELECT o, gram AS k, count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS r FROM n GROUP BY ALL),
ctx AS (SELECT o, ctx AS k, count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS r FROM n GROUP BY ALL),
score AS (SELECT n, avg(ln({p["a"]}) - ln({p["r"]})) AS ratio FROM pos {joins} GROUP BY n),
b AS (SELECT rule IN ({allowed}) AS ok, least({url_filter.BINS - 1}, greatest(0, floor((ratio + 4) * {url_filter.BINS} / 8))) AS bin FROM p JOIN score USING (n) WHERE rule IS NOT NULL AND held),
e AS (SELECT x, count(*) FILTER (ok AND bin < x) / (count(*) FILTER (ok))::DOUBLE + 1 - count(*) FILTER (NOT ok AND bin < x) / (count(*) FILTER (NOT ok))::DOUBLE AS error FROM b, range({url_filter.BINS + 1}) t(x) GROUP BY x HAVING count(*) FILTER (ok) > 0 AND count(*) FILTER (NOT ok) > 0),
cut AS (SELECT coalesce(list_sort(list(x))[len(list(x)) // 2 + 1] * 8.0 / {url_filter.BINS} - 4, 0.0) AS cut FROM e WHERE error <= (SELECT min(error) FROM e) + 1e-12)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({allowed}) OR (rule IS NULL AND ratio >= cut) THEN 'allow' ELSE 'block' END AS verdict FROM p JOIN score USING (n), cut"""


def _codes_sql() -> str:
    """The Lloyd rounds one after another; a part meets every entry of its codebook."""
    steps = []
    for r in range(vector_codes.ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT n, p, arg_min(e, (d * 256 + e)::BIGINT) AS e, min(d)::BIGINT AS d FROM (SELECT n, x.p, e, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d FROM x JOIN b{r} USING (p)) GROUP BY n, p)""")
        if r < vector_codes.ROUNDS:
            steps.append(f"""
s{r} AS (SELECT p, e, list(floor(s / n) ORDER BY j) AS c FROM (SELECT p, e, j, sum(v[j]) AS s, count(*) AS n FROM x JOIN a{r} USING (n, p), range(1, len(v) + 1) t(j) GROUP BY ALL) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(s{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN s{r} USING (p, e))""")
    last = vector_codes.ROUNDS
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT n, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM k, range(4) t(p)),
b0 AS MATERIALIZED (SELECT p, n - 1 AS e, v AS c FROM x WHERE n <= 256),{",".join(steps)},
o AS (SELECT n, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY n),
h AS (SELECT sha256(string_agg(c[j]::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM b{last}, range(1, len(c) + 1) t(j))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN o USING (n), h"""


ORACLE_SQL = {
    "op2_warc_salvage": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM d""",
    "op3_url_filter": _url_sql(),
    "op5_source_mixing": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS z FROM documents),
q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
k AS (SELECT d.*, -ln((('0x' || substr(md5(doc_id::VARCHAR || ':42'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE) / CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(z)::BIGINT AS z, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, (sum(z) OVER ())::DOUBLE - coalesce(sum(3.0::DOUBLE * z) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS free FROM s WHERE z > 0
  WINDOW b AS (ORDER BY 3.0::DOUBLE * z / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, s.z AS source_size, CASE WHEN s.z > 0 THEN least(3.0::DOUBLE * s.z, s.w * (SELECT max(rest / free) FROM o)) ELSE 0.0 END AS target FROM s),
e AS (SELECT *, CASE WHEN source_size > 0 THEN trunc(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, source_size, target, epochs, floor(target - epochs * source_size + 1e-6)::BIGINT AS rest, coalesce(sum(z) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, z AS size, source_size, target, (epochs * z + least(z, greatest(0, rest - before), 3 * z - epochs * z))::BIGINT AS taken FROM r""",
    "op4_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(len(ws) - 34)) AS i, ws FROM d WHERE len(ws) >= 35),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(ws[i + 1 : i + 35], ' ')) AS n FROM w),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM k WHERE n > 1) GROUP BY doc_id),
r AS (SELECT d.doc_id, ws, coalesce(len(gone), 0) AS n_removed,
       CASE WHEN gone IS NULL THEN ws ELSE list_select(ws, list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(gone, p - 1))) END AS kept
  FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM r""",
    "op6_quality_cascade": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 5], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM w) WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 2 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 2 * n_upper > word_chars) AS kept FROM b""",
    "op11_suffix_dedup": """
WITH b AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT n, j, len(h) // 2 - 199 - 500 * j AS m, substr(h, 1000 * j + 1, 1398) AS piece FROM (SELECT n, h, unnest(range((len(h) // 2 - 200) // 500 + 1)) AS j FROM b WHERE len(h) >= 400)),
w AS (SELECT n, 500 * j + k AS i, count(*) OVER (PARTITION BY substr(piece, 2 * k + 1, 400)) AS c FROM (SELECT *, unnest(range(least(500, m))) AS k FROM c)),
r AS (SELECT n, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY n ORDER BY i) AS run FROM (SELECT n, i, lag(i) OVER (PARTITION BY n ORDER BY i) AS before FROM w WHERE c > 1)),
s AS (SELECT n, min(i) AS a, max(i) + 200 AS z FROM r GROUP BY n, run),
e AS (SELECT n, a, z, coalesce(lag(z) OVER (PARTITION BY n ORDER BY a), 0) AS p FROM s),
k AS (SELECT n, sum(z - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM e JOIN b USING (n) GROUP BY n)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN k USING (n)""",
    "op12_vector_codes": _codes_sql(),
    "op13_source_divergence": r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT id, lang, source, unnest(ws) AS w FROM d),
t AS MATERIALIZED (SELECT lang, w FROM w GROUP BY lang, w HAVING count(DISTINCT id) >= 10),
c AS MATERIALIZED (SELECT lang, source, w, count(*) AS n FROM w JOIN t USING (lang, w) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM t GROUP BY lang) USING (lang)),
p AS MATERIALIZED (SELECT g.lang, source, w, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS p FROM g JOIN t USING (lang) LEFT JOIN c USING (lang, source, w)),
q AS (SELECT lang, w, 1 + 1000000000::HUGEINT * (sum(n) + 2)::HUGEINT // (any_value(whole)::HUGEINT + 2 * any_value(v)) AS q FROM p JOIN (SELECT lang, sum(total) AS whole, max(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, w),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', w, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, w) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM o) WHERE part = 'pair' OR rank <= 10""",
}
