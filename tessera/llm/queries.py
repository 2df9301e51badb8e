"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import decode, encode
from tessera.llm.decontamination import contaminated
from tessera.llm.html_text import extract
from tessera.llm.language import identify, training_rows
from tessera.llm.mixing import mix
from tessera.llm.ngram_join import jaccard_components
from tessera.llm.quality_classifier import classify, line_quality_model
from tessera.llm.quality_rules import line_model, quality_rules
from tessera.llm.ranked_search import ranked
from tessera.llm.secrets import RULES, scan
from tessera.llm.spelling import variants
from tessera.llm.tables import table, written
from tessera.llm.token_counts import token_counts
from tessera.llm.warc import SEGMENT_RECORDS, SPAN, audit, damaged, hashed, placed, records, segment_count

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op1_ngram_jaccard(spark, sf_dir):
    """Near-duplicate components: 4-word shingles, Jaccard of 0.85 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, numerator=85, denominator=100)


ORACLE["op1_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c WHERE 100 * k >= 85 * (nx + ny - k)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m.y, doc_id)) AS component_id
FROM s LEFT JOIN m ON m.x = s.doc_id
"""


@query
def op2_language_id(spark, sf_dir):
    """Language of every document by compression; a third of the ids is held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return identify(docs, training_rows(docs, 3, 1), held)


@query
def op3_decontamination(spark, sf_dir):
    """Documents that hold test items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_token_counts(spark, sf_dir):
    """Tokens of every document under word_bpe_49k."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


@query
def op5_html_text(spark, sf_dir):
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


@query
def op6_secret_scan(spark, sf_dir):
    """Secrets of every document."""
    return scan(table(spark, sf_dir, "documents"))


def _sql_any_case(pattern: str) -> str:
    out, escaped, inside = [], False, False
    for ch in pattern:
        if ch.isalpha() and not escaped and not inside:
            out.append(f"[{ch.lower()}{ch.upper()}]")
        else:
            out.append(ch)
        inside = (inside or ch == "[") and ch != "]"
        escaped = ch == "\\" and not escaped
    return "".join(out)


def _secret_sql() -> str:
    parts = []
    for k, r in enumerate(RULES):
        pat = (_sql_any_case(r.pattern).replace(r"[xX]20", "x20") if r.any_case else r.pattern).replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS k, '{r.kind}' AS kind, regexp_extract_all(text, '{pat}') AS ms,
      regexp_split_to_array(text, '{pat}') AS ps, {r.least} AS least, '{pat}' AS pat, {r.group} AS grp FROM t""")
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(RULES) if r.base)
    base = sum(r.base for r in RULES)
    extract = " ".join(f"WHEN {k} THEN length(regexp_extract(m, '{(_sql_any_case(r.pattern).replace('[xX]20', 'x20') if r.any_case else r.pattern).replace(chr(39), chr(39) * 2)}', {r.group}))"
                       for k, r in enumerate(RULES) if r.group)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(parts)}),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 0),
s AS (SELECT doc_id, k, kind, least, ms[i] AS m,
      CAST(list_sum(list_transform(ps[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM i),
g AS (SELECT doc_id, k, a, kind || ':' || a || ':' || (a + length(m)) AS span FROM s
      WHERE CASE k {extract} ELSE length(m) END >= least),
c AS (SELECT doc_id, {counts}, coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (k < {base}), '') AS b,
      string_agg(span, ',' ORDER BY a, k) AS spans FROM g GROUP BY doc_id)
SELECT t.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)},
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN c USING (doc_id)
"""


ORACLE["op6_secret_scan"] = _secret_sql()


@query
def op7_quality_rules(spark, sf_dir):
    """Base counts and line labels of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, line_model(docs, table(spark, sf_dir, "labels")))


@query
def op8_quality_classifier(spark, sf_dir):
    """Quality score of every document; a fifth of the ids is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    return classify(docs, line_quality_model(docs, labels.where(remainder != 0)), remainder == 0)


@query
def op9_merkle_fixity(spark, sf_dir):
    """All pages as an archive, audited against a replica with damage in one of 40 records.

    The replica's records lie where the archive's index has them, with lengths and hashes
    of their own."""
    pages = table(spark, sf_dir, "pages")
    rows = records(pages)
    index = written(placed(hashed(rows), segment_count(pages)), "index")
    found = hashed(damaged(rows, 40)).groupBy("record_id").agg(F.min("length").alias("length"), F.min("hash").alias("hash"))
    replica = written(index.select("record_id", "segment", "offset").join(found, "record_id"), "replica")
    return audit(index, replica).join(index.select("segment", "offset", "page_id", "copies"), ["segment", "offset"], "left")


ORACLE["op9_merkle_fixity"] = rf"""
WITH p AS (SELECT *, sha256(concat_ws(E'\n', coalesce('=' || page_id, '-'), coalesce('=' || url, '-'), coalesce('=' || html, '-'))) AS id FROM pages),
r AS (SELECT id, page_id, hex(encode(E'WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:sha256:' || id
  || E'>\r\nWARC-Target-URI: ' || coalesce(url, '') || E'\r\nWARC-Block-Digest: sha256:' || sha256(encode(coalesce(html, '')))
  || E'\r\nContent-Type: text/html\r\nContent-Length: ' || octet_length(encode(coalesce(html, ''))) || E'\r\n\r\n'
  || coalesce(html, '') || E'\r\n\r\n')) AS h FROM p),
g AS (SELECT id, min(page_id) AS page_id, min(h) AS h, count(*) AS copies FROM r GROUP BY id),
i AS (SELECT *, CAST(CAST('0x' || substr(id, 1, 8) AS BIGINT) % (SELECT greatest(1, ceil(count(*) / {SEGMENT_RECORDS})::BIGINT) FROM pages) AS BIGINT) AS segment,
  length(h) // 2 AS n, CAST('0x' || substr(id, 9, 8) AS BIGINT) % 120 AS draw FROM g),
o AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY segment ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CASE draw WHEN 0 THEN NULL WHEN 1 THEN substr(h, 1, 2 * (n // 2)) || '00' || substr(h, 2 * (n // 2) + 3) WHEN 2 THEN substr(h, 1, 2 * (n // 2)) END AS d
  FROM i)
SELECT segment, "offset", CASE draw WHEN 0 THEN 'missing' ELSE 'changed' END AS status, CAST("offset" // {SPAN} * {SPAN} AS BIGINT) AS range_start,
  CAST("offset" // {SPAN} * {SPAN} + {SPAN} AS BIGINT) AS range_end, CAST(n AS BIGINT) AS primary_length, CAST(length(d) // 2 AS BIGINT) AS replica_length,
  sha256(unhex(h)) AS primary_hash, sha256(unhex(d)) AS replica_hash, page_id, copies FROM o WHERE draw < 3
"""


#: target weights of the domains that the labels make
TARGETS = {"good": 0.9, "good_toxic": 0.02, "poor": 0.07, "poor_toxic": 0.01}


def label_domains(labels):
    """Domains of the labelled table: good or poor, toxic or not."""
    return labels.select("doc_id", F.concat(F.when(F.col("quality") == 1, "good").otherwise("poor"),
                                            F.when(F.col("toxic") == 1, "_toxic").otherwise("")).alias("domain"))


@query
def op10_soft_mixing(spark, sf_dir):
    """Rates of all documents by which half of the words meet the target weights."""
    return mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGETS)


@query
def op11_spelling_variants(spark, sf_dir):
    """Words of 7 letters or more with their near words and the form that each goes back to."""
    return variants(table(spark, sf_dir, "documents"))


# checksums byte by byte; near words by the variants with one code point less
ORACLE["op11_spelling_variants"] = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
       lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab),
a AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM a WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(c) - 64] END)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM g, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM x),
l AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b USING (i, s) WHERE a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.s = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.s = v.word),
m AS (SELECT word, count(*) AS n_near, max(n) AS top FROM l GROUP BY word),
f AS (SELECT word, v.n, m.n_near, CASE WHEN top >= 10 * v.n THEN top END AS form_n,
      CASE WHEN top >= 10 * v.n THEN (SELECT min(near) FROM l WHERE l.word = v.word AND l.n = m.top) END AS form
      FROM v LEFT JOIN m USING (word)),
r AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.next = f.word)
SELECT f.word, f.form, r.at AS root, f.n, CAST(coalesce(f.n_near, 0) AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN r ON r.word = f.word AND r.next IS NULL
"""


@query
def op12_ranked_search(spark, sf_dir):
    """The 20 best documents of each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


_TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE["op12_ranked_search"] = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS_SQL} AS ws FROM documents),
c AS (SELECT count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM t WHERE len(ws) > 0),
e AS (SELECT r, unnest(ws) AS term FROM t),
p AS (SELECT r, term, count(*) AS tf FROM e GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
q AS (SELECT item_id, row_number() OVER () AS i, {_TERMS_SQL} AS ws FROM benchmark),
u AS (SELECT item_id, i, unnest(ws) AS term FROM q),
s AS (SELECT item_id, i, doc_id, r, CAST(sum(CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT)
             * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(ws) * n) // l)))) AS BIGINT) AS score
      FROM u JOIN d USING (term) JOIN p USING (term) JOIN t USING (r), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""


@query
def op13_byte_bpe(spark, sf_dir):
    """Every document encoded and decoded under byte_bpe_50k; digests of both."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = decode(encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
