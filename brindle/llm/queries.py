"""The registered queries of the training-data operators: whole tables, whole texts, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import stash
from brindle.llm.licenses import COMMON, TEMPLATES, scan_licenses
from brindle.llm.lines import dedup_lines
from brindle.llm.lmscore import cross_entropy_difference, flag_target
from brindle.llm.mixing import mix_sources
from brindle.llm.multiset_hash import neighbour_fingerprints
from brindle.llm.packing import pack_documents
from brindle.llm.pii import BASE_KINDS, find_pii
from brindle.llm.quality import fit_bands, good_ids, quality_bands
from brindle.llm.simhash import simhash_components
from brindle.llm.warc import archive_folder, assemble, read_records, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and compression-band verdict of every document, by bands fitted to the documents labelled as good."""
    docs = _table(spark, sf_dir, "documents")
    return quality_bands(docs, bands=fit_bands(docs, good_ids(_table(spark, sf_dir, "labels"))))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: targets of the sources, words taken from each document."""
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(length(translate(text, '#*$%&|<>', '')) / nullif(CAST(length(text) AS DOUBLE), 0), 1.0) AS plain
  FROM documents),
k AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
            / greatest(CAST(0.05 AS DOUBLE), plain * plain) AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight, 3 * source_size AS cap,
             row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
l AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
             (CAST(sum(source_size) OVER () AS DOUBLE)
              - CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
             / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
      FROM r),
f AS (SELECT level AS final FROM l WHERE cap >= level * weight ORDER BY ratio, rank LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), (SELECT final FROM f) * weight), CAST(cap AS DOUBLE)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
q AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         CAST(coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST((epochs + CASE WHEN before + size / CAST(2 AS DOUBLE) <= rest AND size > 0 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM q
"""


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, read back, and assembled to one row for each capture."""
    path = archive_folder(spark)
    write_warc(_table(spark, sf_dir, "pages"), path)
    captures = assemble(stash(read_records(spark, path, with_payload=False)))
    fields = F.col("metadata.fields")
    return captures.select(
        fields["page-id"].cast("long").alias("page_id"),
        fields["payload-bytes"].cast("long").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        fields["original-page-id"].cast("long").alias("refers_to"),
        *(F.struct(*(F.col(f"{kind}.{c}") for c in ("record_id", "type", "target_uri", "date", "payload_bytes"))).alias(kind) for kind in ("request", "response", "metadata")),
    )


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; the target are the documents labelled as of good quality, the background all others."""
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    docs = flag_target(_table(spark, sf_dir, "documents").select("doc_id", "text"), good)
    return cross_entropy_difference(docs, "_target")


def op5_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of every document, and the component of its near copies."""
    return simhash_components(_table(spark, sf_dir, "documents"))


def op6_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces, packed into sequences of 4096."""
    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, of its edited text, and how alike those and the next document's are."""
    return neighbour_fingerprints(_table(spark, sf_dir, "documents"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat an earlier one, alike or nearly."""
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digests derived from the operator's spans."""
    found = find_pii(_table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.filter("spans", lambda s: s.kind == k)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select(
        "doc_id",
        *(F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s.base)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.transform("spans", lambda s: F.round(s.score, 3)).alias("scores"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document, own or inherited. Documents have no paths, so they get some: /source/lang/LICENSE-id for every
    tenth, /source/lang/sixteenth/id for the others."""
    docs = _table(spark, sf_dir, "documents")
    leaf = F.when(F.col("doc_id") % 10 == 0, F.lit("/LICENSE-")).otherwise(F.concat(F.lit("/d"), (F.col("doc_id") % 16).cast("string"), F.lit("/")))
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), leaf, F.col("doc_id").cast("string"))
    return scan_licenses(docs.select("doc_id", "text", path.alias("path")), keys=("doc_id",))


def _license_sql() -> str:
    """All lines, blocks and texts scored, with weights that SQL makes of the templates' texts."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(name)}, {str(full).lower()}, {quoted(text)})" for i, (name, full, text) in enumerate(TEMPLATES))
    return f"""
WITH templates(template, license, is_full, body) AS (VALUES {values}),
tt AS (SELECT template, license, is_full, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM templates),
tc AS (SELECT template, license, is_full, term, count(*) AS n FROM tt GROUP BY ALL),
size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM templates),
i AS (SELECT term, 1.0::DOUBLE + ln((1 + (SELECT n FROM size)) / (1 + count(*))) AS idf FROM tc GROUP BY term),
tn AS (SELECT template, sqrt(sum((1 + ln(tc.n)) * idf * (1 + ln(tc.n)) * idf)) AS norm FROM tc JOIN i USING (term) GROUP BY template),
w AS (SELECT tc.template, license, is_full, tc.term, (1 + ln(tc.n)) * idf / norm AS weight FROM tc JOIN i USING (term) JOIN tn ON tc.template = tn.template),
t AS (SELECT doc_id, text, '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none')
             || CASE WHEN doc_id % 10 = 0 THEN '/LICENSE-' ELSE '/d' || CAST(doc_id % 16 AS VARCHAR) || '/' END || CAST(doc_id AS VARCHAR) AS path FROM documents),
m AS (SELECT DISTINCT text FROM t WHERE text IS NOT NULL),
l AS (SELECT text, unnest(string_split(text, chr(10))) AS s FROM m UNION ALL SELECT text, unnest(string_split_regex(text, '\n(?:[^A-Za-z0-9\n]*\n)+')) FROM m),
u AS (SELECT DISTINCT text, s, false AS whole FROM l UNION ALL SELECT text, text, true FROM m),
d AS (SELECT DISTINCT s FROM u),
e AS (SELECT s, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS term FROM d),
n AS (SELECT s, e.term, (1 + ln(count(*))) * coalesce(any_value(idf), 1.0::DOUBLE + ln(1 + (SELECT n FROM size))) AS w FROM e LEFT JOIN i ON e.term = i.term GROUP BY s, e.term),
norms AS (SELECT s, sqrt(sum(w * w)) AS norm FROM n GROUP BY s HAVING count(*) > 1),
dots AS (SELECT s, template, license, is_full, sum(n.w * weight) AS dot FROM n JOIN w ON n.term = w.term GROUP BY s, template, license, is_full
         HAVING count(CASE WHEN n.term NOT IN ({', '.join(map(quoted, COMMON))}) THEN 1 END) > 0),
c AS (SELECT dots.s, license, is_full, round(dot / norm, 9) AS score FROM dots JOIN norms ON dots.s = norms.s),
o AS (SELECT text, license, score FROM u JOIN c ON u.s = c.s WHERE NOT whole AND score >= 0.6 QUALIFY row_number() OVER (PARTITION BY text ORDER BY starts_with(license, 'LicenseRef-'), score DESC, license) = 1),
x AS (SELECT text, license, score FROM u JOIN c ON u.s = c.s WHERE whole AND is_full AND score >= 0.75 QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, license) = 1),
r AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, o.license AS own_license, o.score AS own_score,
             coalesce(x.license, CASE WHEN regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying|unlicense)([-._][^/]*)?$') THEN o.license END) AS file_license,
             CASE WHEN x.license IS NOT NULL THEN x.score ELSE o.score END AS file_score
      FROM t LEFT JOIN o ON t.text = o.text LEFT JOIN x ON t.text = x.text),
g AS (SELECT dir, file_license FROM r WHERE file_license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY file_score DESC, path, file_license) = 1),
q AS (SELECT DISTINCT dir FROM r),
y AS (SELECT q.dir, g.dir AS source_dir, g.file_license FROM q JOIN g ON q.dir = g.dir OR starts_with(q.dir, g.dir || '/')
      QUALIFY row_number() OVER (PARTITION BY q.dir ORDER BY length(g.dir) DESC) = 1)
SELECT doc_id, path, own_license, own_score, r.file_license IS NOT NULL AS licence_file,
       coalesce(own_license, y.file_license) AS license, CASE WHEN own_license IS NULL THEN y.source_dir END AS inherited_from
FROM r LEFT JOIN y ON r.dir = y.dir
"""


QUERIES = {f.__name__: f for f in (op1_compression_bands, op2_source_mix, op3_warc_transactions, op4_cross_entropy_difference, op5_simhash_anchors, op6_genetic_packing, op7_multiset_hash, op8_fuzzy_lines, op9_pii_spans, op10_license_scan)}
ORACLES: dict[str, str] = {"op2_source_mix": OP2_SQL, "op10_license_scan": _license_sql()}
