"""One query for each operator, with production parameters, over its whole table; and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact, licenses, lines, lm, mixing, simhash, toxicity, urls
from .common import read_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: The URL rules (host, path, verdict).
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: The list that stands beside the rules.
LISTED_URLS = (resources.files(__package__) / "listed_urls.txt").read_text("ascii").splitlines()


def remainder(id_col: str, by: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % by


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    t = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return t.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.near_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = urls.entries(spark, [(h, p, v, True) for h, p, v in URL_RULES]).union(urls.listed_entries(spark, LISTED_URLS))
    return urls.url_filter(read_table(spark, sf_dir, "pages").select("page_id", "url"), listed)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.lm_scores(docs, remainder("doc_id", 10) == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder("doc_id", 4) == 2
    model = toxicity.fit(*toxicity.labelled_sample(docs, read_table(spark, sf_dir, "labels"), held))
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {"position": F.get("positions", F.lit(0)), "last_position": F.get("positions", F.size("positions") - 1)}
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", *[x.alias(c) for c, x in at.items()])


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_simhash_near_dedup, op3_url_filter, op4_exact_dedup, op5_lm_scoring,
        op6_line_dedup, op7_nearest_neighbours, op8_toxicity, op9_mixing, op10_license_scan,
    )
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
_HOST = "translate(regexp_extract({}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({}, '^[^/?#]*([^?#]*)', 1)"
_CANONICAL = "regexp_replace(regexp_replace(regexp_replace({}, '^.*@', '', 's'), ':[0-9]*$', ''), '\\.+$', '')"

_OP3 = f"""
WITH cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, {_HOST.format("rest")} AS host, {_PATH.format("rest")} AS path FROM cut),
canonical AS (SELECT *, {_CANONICAL.format("host")} AS chost FROM split),
list AS (SELECT unnest([{", ".join(f"'{x}'" for x in LISTED_URLS if x.strip() and not x.startswith("#"))}]) AS url),
entry AS (
  SELECT DISTINCT {_CANONICAL.format(_HOST.format("rest"))} AS lhost, CASE WHEN {_PATH.format("rest")} = '/' THEN '' ELSE {_PATH.format("rest")} END AS lpath
  FROM (SELECT substr(url, strpos(url, '://') + 3) AS rest FROM list)),
hit AS (
  SELECT page_id, arg_max(lhost || lpath, [length(lhost || lpath), length(lhost)]) AS listed
  FROM canonical JOIN entry ON (chost = lhost OR ends_with(chost, '.' || lhost)) AND starts_with(path, lpath) GROUP BY page_id),
ruled AS (
  SELECT split.*, listed, CASE {" ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for h, p, _ in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1])))} END AS rule
  FROM split LEFT JOIN hit USING (page_id))
SELECT page_id, host, path, rule, listed,
       CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in URL_RULES)} WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_OP4 = f"""
WITH norm AS (SELECT doc_id, {_LOWER.format("text")} AS t FROM documents),
best AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM norm JOIN best USING (t)
"""

_OP6 = r"""
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM doc),
keyed AS (SELECT *, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
due AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, due.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN due ON keyed.k = due.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Exact, as op7 is on tables of one list.
_OP7 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
w AS (SELECT * FROM v WHERE len(e) = (SELECT len(e) FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
d AS (SELECT q.vec_id AS query_id, w.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, w.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score FROM w AS q JOIN w ON w.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score FROM d QUALIFY rank <= 10
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_value(3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE)[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
k AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM w),
l AS (SELECT *, (budget - capped) / open AS level FROM k),
m AS (SELECT *, (SELECT arg_min(level, [cap / weight, -open]) FROM l WHERE level * weight <= cap) AS lv FROM l),
t AS (SELECT source, source_size, 0.5::DOUBLE - weight / 3.0::DOUBLE AS ramp, CASE WHEN lv IS NULL THEN cap ELSE least(cap, lv * weight) END AS target FROM m),
o AS (SELECT d.*, t.source_size, t.target, t.ramp,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS mid
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * times AS taken,
       CASE WHEN times > 0 THEN (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * (mid / target)) - (1 - ramp)) / (2 * ramp) END AS position,
       CASE WHEN times > 0 THEN (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * ((mid + source_size * (times - 1)) / target)) - (1 - ramp)) / (2 * ramp) END AS last_position
FROM (SELECT *, (mid < target)::BIGINT + (mid + source_size < target)::BIGINT + (mid + 2 * source_size < target)::BIGINT AS times FROM o)
"""

_TEMPLATES = ", ".join(f"({n}, '{t.label}', {t.base}, {t.k}, {t.needed}::DOUBLE, string_split('{' '.join(t.words)}', ' '))" for n, t in enumerate(licenses.templates()))

_OP10 = rf"""
WITH t AS (SELECT *, len(ws) AS length FROM (VALUES {_TEMPLATES}) AS v(template, label, is_base, k, needed, ws)),
g AS (SELECT template, k, q, array_to_string(ws[q + 1 : q + k], ' ') AS gram FROM (SELECT *, unnest(range(length - k + 1)) AS q FROM t)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, p, 2 AS k, ws[p + 1] || ' ' || ws[p + 2] AS gram FROM (SELECT r, ws, unnest(range(len(ws) - 1)) AS p FROM d)
      UNION ALL SELECT r, p, 3, ws[p + 1] || ' ' || ws[p + 2] || ' ' || ws[p + 3] FROM (SELECT r, ws, unnest(range(len(ws) - 2)) AS p FROM d)),
hits AS (SELECT r, template, p - q AS diagonal, p, p + k - 1 AS until, unnest(range(q, q + k)) AS word FROM w JOIN g USING (k, gram)),
votes AS (SELECT r, template, diagonal, count(DISTINCT word) AS own FROM hits GROUP BY r, template, diagonal),
steps AS (SELECT votes.*, is_base OR diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {licenses.DRIFT} AS apart FROM votes JOIN t USING (template)),
islands AS (SELECT *, count(*) FILTER (WHERE apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS island FROM steps),
spans AS (
  SELECT r, template, island, max(own) AS own, count(DISTINCT word) AS merged, max(until) - min(p) + 1 AS span, min(diagonal) AS diagonal
  FROM hits JOIN islands USING (r, template, diagonal) GROUP BY r, template, island),
found AS (SELECT *, CASE WHEN span <= {licenses.STRETCH} * length THEN greatest(own, merged) ELSE own END::DOUBLE / length AS share FROM spans JOIN t USING (template)),
seen AS (SELECT *, share >= needed AS label_seen, is_base AND share >= needed AS place FROM found)
SELECT doc_id, len(any_value(d.ws))::BIGINT AS n_words, count(*) FILTER (WHERE place) AS n_base,
       min(diagonal) FILTER (WHERE place) AS first_word, max(diagonal) FILTER (WHERE place) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE label_seen), '') AS labels,
       coalesce(max(share), 0) AS score
FROM d LEFT JOIN seen USING (r) GROUP BY r, doc_id
"""

ORACLE_SQL = {"op3_url_filter": _OP3, "op4_exact_dedup": _OP4, "op6_line_dedup": _OP6, "op7_nearest_neighbours": _OP7, "op9_mixing": _OP9, "op10_license_scan": _OP10}
