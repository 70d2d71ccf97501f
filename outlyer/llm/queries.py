"""The corpus queries with production parameters, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlyer.llm import collocations, decontamination, exact_dedup, fingerprints, importance, lm_scoring, mixing, near_dedup, quality, resharding, substring_dedup, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Raking: sources are flattened, languages a little; the topic's shares stay.
MIX_POWERS = {"source": 0.7, "lang": 0.9, "topic": 1.0}


def mix_dims() -> dict:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.form_topic()}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.calibrated(docs, mix_dims(), MIX_POWERS).select("doc_id", "source", "lang", "topic", "tokens", "weight", "prob", "sampled")


def _op2_sql() -> str:
    token = r"[^ \x09-\x0D]+"
    steps, last = [], "start"
    for k in range(mixing.SWEEPS):
        for dim in MIX_POWERS:
            name = f"s{k}_{dim}"
            steps.append(f"{name} AS (SELECT source, lang, topic, mass, t_source, t_lang, t_topic, CASE WHEN sum(weight) OVER (PARTITION BY {dim}) > 0 THEN weight * t_{dim} / sum(weight) OVER (PARTITION BY {dim}) ELSE 0 END AS weight FROM {last})")
            last = name
    targets = ", ".join(
        f"t_{d} AS (SELECT {d}, CASE WHEN m > 0 THEN pow(m, {p}) ELSE 0 END / sum(CASE WHEN m > 0 THEN pow(m, {p}) ELSE 0 END) OVER () AS t_{d} FROM (SELECT {d}, CAST(sum(mass) AS DOUBLE) AS m FROM cells GROUP BY {d}))"
        for d, p in MIX_POWERS.items()
    )
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
    CASE WHEN contains(x, ' | ') THEN 'table' WHEN contains(x, '&&&') OR contains(x, '###') THEN 'symbols'
      WHEN contains(x, '!! ') THEN 'shouting' WHEN length(x) < 600 THEN 'note' WHEN length(x) < 6000 THEN 'article' ELSE 'book' END AS topic,
    CAST(len(regexp_extract_all(x, '{token}')) AS BIGINT) AS tokens
  FROM (SELECT *, coalesce(text, '') AS x FROM documents)),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS mass FROM docs GROUP BY ALL),
{targets},
start AS (SELECT *, CAST(mass AS DOUBLE) AS weight FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
{", ".join(steps)},
ratios AS (SELECT source, lang, topic, weight, CASE WHEN mass > 0 THEN weight / mass ELSE 0 END AS ratio FROM {last}),
probs AS (SELECT source, lang, topic, round(weight, 6) AS weight, CASE WHEN max(ratio) OVER () > 0 THEN ratio / max(ratio) OVER () ELSE 1 END AS p FROM ratios)
SELECT doc_id, source, lang, topic, tokens, weight, round(p, 6) AS prob,
  CAST('0x' || substr(md5(doc_id || '-mix'), 1, 8) AS BIGINT) / 4294967296::DOUBLE < p AS sampled
FROM docs JOIN probs USING (source, lang, topic)"""


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The corpus lies in 32 shards dealt by hash and is to lie in 40 of equal bytes.
OLD_SHARDS, NEW_SHARDS = 32, 40


def op4_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = resharding.reshard(docs, resharding.hash_layout(OLD_SHARDS), shards=NEW_SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = lm_scoring.fit(docs, table(spark, sf_dir, "labels"))
    return lm_scoring.score(docs, models).select("doc_id", "tokens", "target_loss", "background_loss", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM d"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
said AS (SELECT lang, len, unnest(list_transform(range(1, len(w) - len + 2), lambda i: array_to_string(w[i:i + len - 1], ' '))) AS phrase FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS len)),
f AS (SELECT lang, len, phrase, count(*) AS a FROM said GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE len > 1),
parts AS (SELECT lang, len, phrase, a, w, unnest(range(1, len)) AS k FROM c),
scores AS (
  SELECT p.lang, p.phrase, p.a, p.k, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * p.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = array_to_string(p.w[1:k], ' ') JOIN f y ON y.lang = p.lang AND y.phrase = array_to_string(p.w[k + 1:p.len], ' ') JOIN totals t ON t.lang = p.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, len AS long, a AS longer, w, unnest(generate_series(2, len - 1)) AS m FROM c WHERE len > 2),
dropped AS (
  SELECT DISTINCT i.lang, i.phrase FROM (SELECT lang, longer, unnest(list_transform(range(1, long - m + 2), lambda s: array_to_string(w[s:s + m - 1], ' '))) AS phrase FROM inside) i
  JOIN c ON c.lang = i.lang AND c.phrase = i.phrase WHERE 100 * i.longer >= 100 * c.a),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b ANTI JOIN dropped d ON d.lang = b.lang AND d.phrase = b.phrase)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score, CAST(k AS INTEGER) AS cut
FROM ranked WHERE rank <= 2000"""


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "benchmark").select("text"))


#: Fixed value: the reversed polynomial of crc32.
_CRC = 0xEDB88320


def _crc_table() -> str:
    """crc32 of each byte, as SQL."""
    rows = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (_CRC if c & 1 else 0)
        rows.append(str(c))
    return f"crc AS (SELECT [{', '.join(rows)}]::UBIGINT[] AS t)"


#: crc32 of the bytes whose hex is h, with the table t.
_CRC_SQL = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::BIGINT])), 4294967295::UBIGINT)"


def _op12_sql() -> str:
    return rf"""
WITH {_crc_table()},
docs AS (SELECT 0 AS goal, doc_id AS id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') FROM benchmark),
words AS (SELECT goal, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
said AS (SELECT goal, id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS f FROM words, (SELECT unnest([1, 2, 3]) AS k)),
held AS (SELECT goal, id, f, count(*) AS c FROM said GROUP BY ALL),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM held)),
hashed AS (
  SELECT f, {_CRC_SQL} % 10000 AS bucket
  FROM bytes, crc),
used AS (SELECT goal, id, bucket, sum(c) AS c FROM held JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT b.bucket, CAST(coalesce(sum(c) FILTER (goal = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(c) FILTER (goal = 1), 0) AS DOUBLE) AS t FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN used u ON u.bucket = b.bucket GROUP BY b.bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS g FROM sums),
weighed AS (SELECT id, sum(c) AS n, sum(c * g) AS weight FROM used JOIN gain USING (bucket) WHERE goal = 0 GROUP BY id),
scored AS (
  SELECT w.id, len(w.w) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_features, CAST(coalesce(x.weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(x.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words w LEFT JOIN weighed x ON x.id = w.id WHERE w.goal = 0),
ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, count(*) OVER () AS m FROM scored WHERE n_words >= 20)
SELECT s.id AS doc_id, n_features, weight, score, CASE WHEN rank <= 5 * m // 100 THEN rank END AS rank FROM scored s LEFT JOIN ranked r ON r.id = s.id"""


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _op13_sql() -> str:
    fp = fingerprints
    p, wide, a, b, c, places, k, most = fp._P, fp._WIDE, fp._A, fp._B, fp._C, fp._PLACES, fp.K, fp.SKETCH

    def like(x: str, y: str, name: str) -> str:
        least = f"list_sort(list_distinct(list_transform(list_concat({x}, {y}), lambda v: v // {places})))[1:{most}]"
        return f"""
{name}_z AS (SELECT id, {least} AS least, list_sort(list_concat(list_transform({x}, lambda v: v * 2), list_transform({y}, lambda v: v * 2 + 1))) AS z FROM marked),
{name}_s AS (SELECT id, len(least) AS n, list_sort(list_filter(list_transform(range(2, len(z) + 1), lambda j: CASE WHEN z[j] // {2 * places} = z[j - 1] // {2 * places} AND z[j] // {2 * places} <= least[len(least)]
  THEN (z[j] // 2 % {places} - z[j - 1] // 2 % {places}) * (z[j] % 2 - z[j - 1] % 2) END), lambda v: v IS NOT NULL)) AS s FROM {name}_z),
{name} AS (SELECT id, CASE WHEN n = 0 THEN 1 ELSE len(list_filter(range(1, len(s) + 1), lambda j: s[j] = 0 OR (j > 1 AND s[j] = s[j - 1]) OR (j < len(s) AND s[j] = s[j + 1]))) / n::DOUBLE END AS v FROM {name}_s)"""

    text = lambda x: f"array_to_string(list_transform({x}, lambda v: lower(lpad(hex(v // {places}), 10, '0')) || ':' || (v % {places})), ' ')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id AS id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nx, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d),
e AS (SELECT id, next_id, n, t, left(t, n - n // 4) || left(nx, n // 4) AS et FROM o),
texts AS (SELECT id, 0 AS edited, t FROM e UNION ALL SELECT id, 1, et FROM e),
{_crc_table()},
said AS (SELECT id, edited, unnest(list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda w: w <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda w: w <> ''), 1) AS k FROM texts),
known AS (SELECT w, {_CRC_SQL}::BIGINT % {p} AS c FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM said)), crc),
spoken AS (SELECT id, edited, list(c ORDER BY k) AS w FROM said JOIN known USING (w) GROUP BY id, edited),
hashes AS (SELECT x.id, x.edited, coalesce(s.w, []) AS w FROM texts x LEFT JOIN spoken s ON s.id = x.id AND s.edited = x.edited),
pairs AS (SELECT *, list_transform(range(1, len(w)), lambda i: (w[i] * {a} + w[i + 1] * {b}) % {p}) AS p FROM hashes),
closed AS (SELECT *, list_filter(range(1, len(w) - {k} + 2), lambda i: least(p[i], p[i + {k - 2}]) <= least({", ".join(f"p[i + {j}]" for j in range(1, k - 2))})) AS places FROM pairs),
found AS (SELECT id, edited, w, list_sort(list_transform(places, lambda i: (p[i] * {a} + p[i + 2] * {b} + w[i + 4] * {c}) % {wide} * {places} + (i - 1) % {places})) AS f FROM closed),
kept AS (SELECT id, edited, CASE WHEN len(f) > 0 THEN list_transform(list_filter(range(1, len(f) + 1), lambda j: j = 1 OR f[j] // {places} <> f[j - 1] // {places})[1:{most}], lambda j: f[j])
  WHEN len(w) > 0 THEN [list_reduce(list_prepend(0::BIGINT, w), lambda s, x: (s * {a} + x * {b} + 1) % {p}) * {places}] ELSE [] END AS f FROM found),
marked AS (SELECT e.id, e.n, sha256(e.et) AS sha, x.f AS own, y.f AS other, z.f AS next FROM e JOIN kept x ON x.id = e.id AND x.edited = 0 JOIN kept y ON y.id = e.id AND y.edited = 1 JOIN kept z ON z.id = e.next_id AND z.edited = 0),
{like("own", "other", "n_e")}, {like("own", "next", "n_n")}
SELECT m.id AS doc_id, m.n AS n_chars, m.sha AS edited_sha256, {text("own")} AS fingerprint, {text("other")} AS edited_fingerprint, n_e.v AS near_edited, n_n.v AS near_next FROM marked m JOIN n_e ON n_e.id = m.id JOIN n_n ON n_n.id = m.id"""


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_near_dedup": op3_near_dedup,
    "op4_resharding": op4_resharding,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_decontamination": op7_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_importance": op12_importance,
    "op13_fingerprints": op13_fingerprints,
}

ORACLES = {
    "op2_mixing": _op2_sql(), "op6_url_filter": OP6_SQL, "op9_exact_dedup": OP9_SQL,
    "op11_collocations": OP11_SQL, "op12_importance": _op12_sql(), "op13_fingerprints": _op13_sql(),
}
