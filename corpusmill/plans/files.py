"""Queries of documents in containers, and of joins and searches of many at once."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.operators import ranges
from corpusmill.operators import vectors as V
from corpusmill.plans.registry import query
from corpusmill.plans.tables import table, vectors
from corpusmill.sources import documents

_SPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _docx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, lines) to (path, content): a Word document with a paragraph for each line."""
    for batch in batches:
        files = []
        for lines in batch.column(1).to_pylist():
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
                z.writestr("word/document.xml", f'<w:document xmlns:w="{_SPACE}"><w:body>{body}</w:body></w:document>')
            files.append(out.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["path", "content"])


@query("s14_documents", "SELECT conv_id || '.docx' AS path, 'docx' AS language, 'verbatim' AS node_type, 1 AS start_line, count(*)::INTEGER AS end_line, md5(string_agg(role || ': ' || regexp_replace(text, '\\s+', ' ', 'g'), chr(10) ORDER BY turn)) AS content FROM conversations GROUP BY conv_id")
def s14(spark, sf):
    """Each conversation as a Word document with a paragraph for each turn, read into one window."""
    turns = table(spark, sf, "conversations").select("conv_id", F.struct("turn", F.concat("role", F.lit(": "), F.regexp_replace("text", r"\s+", " ")).alias("line")).alias("t"))
    lines = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"))["line"].alias("lines")).select(F.concat(F.col("conv_id").cast("string"), F.lit(".docx")).alias("path"), "lines")
    found = documents.chunk_documents(lines.mapInArrow(_docx, "path string, content binary"), tokens=1 << 20)
    return found.select("path", "language", "node_type", "start_line", "end_line", F.md5("content").alias("content"))


@query("j18_binned_overlap", "WITH s AS (SELECT l_suppkey % 5 AS file, l_orderkey * 10 + l_linenumber AS id, l_orderkey * 3 AS s, l_orderkey * 3 + CASE WHEN l_orderkey % 500 = 0 THEN 900 ELSE l_linenumber END AS e FROM lineitem), w AS (SELECT * FROM s WHERE id % 10 < 3) SELECT a.id, count(*) AS n, sum(b.id)::BIGINT AS others FROM s a JOIN w b ON a.file = b.file AND a.s <= b.e AND b.s <= a.e GROUP BY 1")
def j18(spark, sf):
    """Spans of five files, some of them long, against those of the first lines."""
    s = table(spark, sf, "lineitem").selectExpr("l_suppkey % 5 AS file", "l_orderkey * 10 + l_linenumber AS id", "l_orderkey * 3 AS start_line", "l_orderkey * 3 + CASE WHEN l_orderkey % 500 = 0 THEN 900 ELSE l_linenumber END AS end_line")
    return ranges.overlapping(s, s.filter("id % 10 < 3"), ["file"]).groupBy("a.id").agg(F.count("*").alias("n"), F.sum("b.id").alias("others"))


@query("v3_v5_many", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(-127, least(127, round(x::DOUBLE * 127)))::BIGINT) AS v FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS sq FROM v a JOIN v b ON a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sq, vec_id)::INTEGER AS rank FROM d) SELECT query_id, rank, vec_id, round(sqrt(sq::DOUBLE) / 127, 6) AS distance FROM r WHERE rank <= 10""")
def v3_many(spark, sf):
    """The nearest ten by int8 distance for every twentieth vector, however many these are."""
    v = vectors(spark, sf)
    return V.knn_table(v, v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10, "vec_id", int8=True).withColumn("distance", F.round("distance", 6))
