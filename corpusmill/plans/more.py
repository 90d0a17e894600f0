"""Queries of reads, readers, sinks, search results with their places, code and streams' batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import scan
from corpusmill.functions import text as X
from corpusmill.lineage import shared_folder
from corpusmill.operators import chunks as C
from corpusmill.operators import code, fusion, graph, packing, reads
from corpusmill.operators import notes as N
from corpusmill.operators import text_search as B
from corpusmill.operators import vectors as V
from corpusmill.operators.places import placed
from corpusmill.plans import queries as Q
from corpusmill.plans.registry import query
from corpusmill.plans.tables import CHUNKS_SQL, EDGES_SQL, NOTES_SQL, chunks, edges, notes, query_vector, table, vectors
from corpusmill.sources import readers


def folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def files(spark, sf):
    return chunks(spark, sf).select(F.col("file_id").alias("id"), "path", "language")


def placed_chunks(spark, sf):
    return chunks(spark, sf).select("chunk_id", "file_id", "node_type", "name", "start_line", "end_line")


# scans, readers, sinks

@query("s1_walk", """SELECT page_id, sha256(html || chr(10)) AS hash, 'text' AS language FROM pages WHERE (page_id % 5 <> 1 AND page_id % 7 <> 2) OR page_id % 14 = 2""")
def s1(spark, sf):
    """Pages written as a tree of text files with ignore files at two levels, walked."""
    root = folder(spark)
    p = table(spark, sf, "pages").filter("page_id is not null").select("html", F.concat(F.lit("r"), F.col("page_id") % 5).alias("a"), F.concat(F.lit("s"), F.col("page_id") % 7).alias("b"), "page_id")
    if readers.local_folder(spark, root):
        line = F.concat(F.coalesce("html", F.lit("")), F.lit("\n"))
        readers.write_tree(p.select(F.format_string("a=%s/b=%s/page_id=%d/%s.txt", "a", "b", "page_id", F.md5(line)).alias("path"), line.alias("text")), f"{root}/tree")
    else:
        p.write.partitionBy("a", "b", "page_id").text(f"{root}/tree")
    ignore = spark.createDataFrame([("", "a=r1/", 0), ("", "**/b=s2/**", 1), ("", "# none", 2), ("a=r1", "b=s9/", 3)], "dir string, line string, at long")
    again = table(spark, sf, "pages").filter("page_id % 14 = 2").select(F.lit("").alias("dir"), F.concat(F.lit("!**/page_id="), F.col("page_id"), F.lit("/**")).alias("line"), F.lit(9).cast("long").alias("at"))
    walked = readers.read_tree(spark, f"{root}/tree", rules=ignore.union(again))
    return walked.select(F.regexp_extract("path", "page_id=([0-9]+)", 1).cast("long").alias("page_id"), "hash", "language")


@query("s4_s5_s6_content_filters", r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '// Code generated by x. DO NOT EDIT.' || chr(10) || text WHEN doc_id % 5 = 1 THEN 'a' || chr(10) || '# @generated' || chr(10) || text ELSE text END AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Code generated ... DO NOT EDIT.' WHEN doc_id % 5 = 1 THEN '@generated' END AS marker, octet_length(encode(t)) <= 4000 AS small, doc_id % 3 = 0 AS binary FROM d""")
def s4_s5_s6(spark, sf):
    """A NUL within the first 512 bytes makes a file binary, one after them doesn't."""
    t = F.expr("CASE WHEN doc_id % 5 = 0 THEN concat('// Code generated by x. DO NOT EDIT.\\n', text) WHEN doc_id % 5 = 1 THEN concat('a\\n# @generated\\n', text) ELSE text END")
    nul = F.unhex(F.lit("00"))
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.encode(F.lit("ab"), "utf-8"), nul, F.encode("text", "utf-8"))).when(F.col("doc_id") % 3 == 1, F.concat(F.encode(F.repeat(F.lit("x"), 512), "utf-8"), nul)).otherwise(F.encode("text", "utf-8"))
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"), content.alias("content"))
    return d.select("doc_id", scan.generated_marker(F.col("t")).alias("marker"), scan.within_size(F.octet_length("t"), 4000).alias("small"), scan.is_binary(F.col("content")).alias("binary"))


@query("s10_notebook", """SELECT page_id, 'verbatim' AS node_type, 'python' AS name, 1 AS start_line, 1 AS end_line, url AS content FROM pages UNION ALL SELECT page_id, 'section', NULL, 2, 3, '# T' || chr(10) || page_id FROM pages""")
def s10(spark, sf):
    cell = lambda kind, source: F.struct(F.lit(kind).alias("cell_type"), source.alias("source"))
    book = F.to_json(F.struct(F.array(cell("code", F.array("url")), cell("code", F.array(F.lit(" "))), cell("markdown", F.array(F.lit("# T\n"), F.col("page_id").cast("string")))).alias("cells")))
    c = C.chunk(table(spark, sf, "pages").select("page_id", book.alias("text"), F.lit("notebook").alias("language")), "text", "language")
    # the blank cell has a line and no chunk
    return c.select("page_id", "node_type", "name", F.when(F.col("node_type") == "section", F.col("start_line") - 1).otherwise(F.col("start_line")).alias("start_line"), F.when(F.col("node_type") == "section", F.col("end_line") - 1).otherwise(F.col("end_line")).alias("end_line"), "content")


PYTHON = "concat('import os\\n\\nclass C', doc_id, ':\\n    def m(self):\\n        return helper(1)\\n\\ndef f', doc_id, '():\\n    \"\"\"Doc.\"\"\"\\n    return print(C', doc_id, '())\\n')"


@query("s12_python_chunks", """SELECT doc_id, t.node_type, CASE t.k WHEN 1 THEN 'C' || doc_id WHEN 2 THEN 'm' ELSE 'f' || doc_id END AS name, t.s AS start_line, t.e AS end_line, t.doc AS docstring FROM documents, (VALUES (1, 'class', 3, 5, NULL), (2, 'method', 4, 5, NULL), (3, 'function', 7, 9, 'Doc.')) t(k, node_type, s, e, doc)""")
def s12(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr(PYTHON).alias("text"), F.lit("python").alias("language"))
    return C.chunk(d, "text", "language").select("doc_id", "node_type", "name", "start_line", "end_line", "docstring")


@query("p4_python_edges", """SELECT doc_id::VARCHAR AS source_file, t.s || CASE WHEN t.s = 'f' THEN doc_id::VARCHAR ELSE '' END AS source_name, t.t || CASE WHEN t.t = 'C' THEN doc_id::VARCHAR ELSE '' END AS target_name, t.kind, t.line FROM documents, (VALUES (NULL, 'os', 'imports', 1), ('m', 'helper', 'calls', 5), ('f', 'C', 'calls', 9)) t(s, t, kind, line)""")
def p4_python(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.expr(PYTHON).alias("text"))
    return graph.python_edges(d, "path", "text").select("source_file", "source_name", "target_name", "kind", "line")


#: A file of each language: text, its definitions (kind, name, first line, last line) and its edges (scope, target, kind, line), written by hand from the rules of each language.
SOURCES = {
    "rust": (
        "use std::fmt::Debug;\n// call(1)\npub struct Item { a: u8 }\nimpl Debug for Item {\n    fn show(&self) -> u8 {\n        let s = \"no(1) {\";\n        helper(self.a)\n    }\n}\nfn main() {\n    Item::new().run();\n}\n",
        [("struct", "Item", 3, 3), ("impl", "Item", 4, 9), ("method", "show", 5, 8), ("function", "main", 10, 12)],
        [(None, "std::fmt::Debug", "imports", 1), ("show", "helper", "calls", 7), ("main", "Item::new", "calls", 11), ("main", "new", "calls", 11), ("main", "Item", "calls", 11), ("main", "run", "calls", 11)],
    ),
    "typescript": (
        "import { a } from './mod';\nexport class Shop extends Base implements Open, Shut {\n  async open(n: number): Promise<void> {\n    if (n) { this.load(n); }\n  }\n}\ninterface Wide extends Open {}\nexport function sum(x: number) {\n  return add(x);\n}\n",
        [("class", "Shop", 2, 6), ("method", "open", 3, 5), ("interface", "Wide", 7, 7), ("function", "sum", 8, 10)],
        [(None, "./mod", "imports", 1), ("Shop", "load", "calls", 4), ("sum", "add", "calls", 9)],
    ),
    "go": (
        "package main\nimport (\n\t\"fmt\"\n\tx \"net/http\"\n)\ntype Shop struct {\n\tn int\n}\nfunc (s *Shop) Open(n int) error {\n\treturn load(n)\n}\nfunc main() {\n\tfmt.Println(len(\"a\"))\n}\n",
        [("struct", "Shop", 6, 8), ("method", "Open", 9, 11), ("function", "main", 12, 14)],
        [(None, "fmt", "imports", 3), (None, "net/http", "imports", 4), ("Open", "load", "calls", 10), ("main", "fmt.Println", "calls", 13)],
    ),
    "java": (
        "import java.util.List;\npublic class Shop extends Base implements Open, Shut {\n    /* call(2) { */\n    public int open(int n) {\n        while (n > 0) { n = step(n); }\n        return new Door(n).width();\n    }\n}\ninterface Wide extends Open {}\n",
        [("class", "Shop", 2, 8), ("method", "open", 4, 7), ("interface", "Wide", 9, 9)],
        [(None, "java.util.List", "imports", 1), ("Shop", "Base", "extends", 2), ("Shop", "Open", "implements", 2), ("Shop", "Shut", "implements", 2), ("open", "step", "calls", 5), ("open", "width", "calls", 6)],
    ),
    "javascript": (
        "import a from './a';\nexport function main(s) {\n  const r = /[\"(]/.test(s);\n  go(`v ${inner(1)}`);\n  const k = (y) => arrow(y);\n}\nclass Shop {\n  open(n) { if (n) { this.close(); } }\n}\nconsole.log(new Door(1));\n",
        [("function", "main", 2, 6), ("class", "Shop", 7, 9), ("method", "open", 8, 8)],
        [(None, "./a", "imports", 1), ("main", "test", "calls", 3), ("main", "go", "calls", 4), ("main", "inner", "calls", 4), ("main", "arrow", "calls", 5), ("Shop", "close", "calls", 8), (None, "log", "calls", 10)],
    ),
    "php": (
        "<p>no(1)</p><?php\nuse App\\User;\nrequire 'lib.php';\nclass C extends Base implements I {\n  function run($n) { foo($n); $this->bar(); self::qux(); strlen(new D(1)); }\n}\n?>\nno(2)\n",
        [("class", "C", 4, 6), ("method", "run", 5, 5)],
        [(None, "App\\User", "imports", 2), (None, "lib.php", "imports", 3), ("C", "Base", "extends", 4), ("C", "I", "implements", 4), ("run", "foo", "calls", 5), ("run", "bar", "calls", 5), ("run", "qux", "calls", 5)],
    ),
    "ruby": (
        "require 'json'\nclass Service < Base\n  include Mod\n  def run(a)\n    helper a\n    puts \"a #{deep(1)}\" if a\n    @items.each do |i|\n      i.save!\n    end\n  end\nend\nlast(1)\n",
        [("class", "Service", 2, 11), ("method", "run", 4, 10)],
        [(None, "json", "imports", 1), ("Service", "Base", "extends", 2), ("Service", "Mod", "implements", 3), ("run", "helper", "calls", 5), ("run", "deep", "calls", 6), ("run", "each", "calls", 7), ("run", "save!", "calls", 8), (None, "last", "calls", 12)],
    ),
    "csharp": (
        "using System;\nclass Shop : Base<int>, IOpen {\n  public Shop(int n) : base(n) { Setup(); }\n  int Open(int n) { Console.WriteLine($\"a {Inner(n)}\"); return this.Do(n); }\n  int F() => Arrow();\n}\n",
        [("class", "Shop", 2, 6), ("method", "Shop", 3, 3), ("method", "Open", 4, 4), ("method", "F", 5, 5)],
        [(None, "System", "imports", 1), ("Shop", "Base<int>", "extends", 2), ("Shop", "IOpen", "extends", 2), ("Shop", "Setup", "calls", 3), ("Open", "Inner", "calls", 4), ("Open", "Do", "calls", 4), ("F", "Arrow", "calls", 5)],
    ),
    "kotlin": (
        "import com.demo.Helper\nclass Service(val n: Int) : Base(n), Greeter {\n  fun run(x: Int): Int {\n    obj.method(x)\n    println(\"a ${inner(x)}\")\n    custom { nested() }\n    return other(x)\n  }\n  fun short() = quick(1)\n}\n",
        [("class", "Service", 2, 10), ("function", "run", 3, 8), ("function", "short", 9, 9)],
        [(None, "com.demo.Helper", "imports", 1), ("Service", "Base", "extends", 2), ("Service", "Greeter", "extends", 2), ("run", "inner", "calls", 5), ("run", "custom", "calls", 6), ("run", "nested", "calls", 6), ("run", "other", "calls", 7), ("short", "quick", "calls", 9)],
    ),
    "swift": (
        "import Foundation\nclass Service: Base, Greeter {\n  init(n: Int) { setup(n) }\n  func run(x: Int) -> Int {\n    self.go(x)\n    print(\"a \\(inner(x))\")\n    return helper(x)\n  }\n}\n",
        [("class", "Service", 2, 9), ("method", "init", 3, 3), ("function", "run", 4, 8)],
        [(None, "Foundation", "imports", 1), ("Service", "Base", "extends", 2), ("Service", "Greeter", "extends", 2), ("Service", "setup", "calls", 3), ("run", "go", "calls", 5), ("run", "inner", "calls", 6), ("run", "helper", "calls", 7)],
    ),
    "c": (
        "#include <stdio.h>\n#include \"a.h\"\nstruct S { int n; };\nint decl(int);\nstatic int add(int a) {\n  printf(\"x\"); p->run(1);\n  return helper(a);\n}\n",
        [("struct", "S", 3, 3), ("function", "add", 5, 8)],
        [(None, "stdio.h", "imports", 1), (None, "a.h", "imports", 2), (None, "helper", "calls", 7)],
    ),
    "cpp": (
        "#include <vector>\nclass A {\n  int run() const { Foo y(1); return go(2) + ns::f(1); }\n};\nauto s = R\"x(no(1) \" )x\";\n",
        [("class", "A", 2, 4), ("function", "run", 3, 3)],
        [(None, "vector", "imports", 1), (None, "go", "calls", 3)],
    ),
    "css": (
        "@import url(\"a.css\");\n@import 'b.css' screen;\n/* { */ .a, .b:hover { color: red; }\n@media (max-width: 1px) {\n  .c { x: y }\n}\n",
        [("rule", ".a, .b:hover", 3, 3), ("mod", "@media", 4, 6), ("rule", ".c", 5, 5)],
        [(None, "a.css", "imports", 1), (None, "b.css", "imports", 2)],
    ),
}
LANGUAGES = sorted(SOURCES)


def _text(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)


def sources(spark, sf):
    """One file for each document, in turn of the languages above."""
    texts = spark.createDataFrame([(i, x, SOURCES[x][0]) for i, x in enumerate(LANGUAGES)], "k long, language string, text string")
    return table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % len(LANGUAGES)).alias("k")).join(F.broadcast(texts), "k").select("doc_id", F.col("doc_id").cast("string").alias("path"), "language", "text")


@query("s12_code_chunks", f"SELECT doc_id, node_type, name, start_line, end_line FROM documents JOIN (VALUES {_rows((i, *d) for i, x in enumerate(LANGUAGES) for d in SOURCES[x][1])}) t(k, node_type, name, start_line, end_line) ON doc_id % {len(LANGUAGES)} = k")
def s12_code(spark, sf):
    return C.chunk(sources(spark, sf), "text", "language").select("doc_id", "node_type", "name", "start_line", "end_line")


@query("p4_code_edges", f"SELECT doc_id::VARCHAR AS source_file, source_name, target_name, kind, line FROM documents JOIN (VALUES {_rows((i, *d) for i, x in enumerate(LANGUAGES) for d in SOURCES[x][2])}) t(k, source_name, target_name, kind, line) ON doc_id % {len(LANGUAGES)} = k")
def p4_code(spark, sf):
    return code.code_edges(sources(spark, sf), "path", "text", "language").select("source_file", "source_name", "target_name", "kind", "line")


def _dump(spark, sf):
    """Nations as entities, two for each of 20 keys, and a relationship to the nation's region, as a dump file."""
    rows = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    entities = [{"type": "note", "ref": f"n{r.n_nationkey:02d}", "entity_id": f"e{r.n_nationkey % 20}", "created_at": 100 - r.n_nationkey, "kind": "note", "title": r.n_name, "body": "b", "status": "active", "tags": []} for r in rows]
    links = [{"type": "relates_to", "from_ref": f"n{r.n_nationkey:02d}", "to_ref": f"n{r.n_regionkey:02d}", "created_at": r.n_nationkey} for r in rows]
    path = folder(spark)
    spark.createDataFrame([(x,) for x in readers.dump_lines(entities, links).splitlines()], "value string").coalesce(1).write.text(path)
    return path


DUMP_SQL = """n AS (SELECT n_nationkey AS k, 'n' || lpad(n_nationkey::VARCHAR, 2, '0') AS ref, 'e' || (n_nationkey % 20) AS entity_id, 100 - n_nationkey AS created_at, n_name, 'n' || lpad(n_regionkey::VARCHAR, 2, '0') AS region FROM nation),
s AS (SELECT entity_id, arg_min(ref, (created_at, ref)) AS survivor FROM n GROUP BY 1)"""


@query("s15_dump", f"WITH {DUMP_SQL} SELECT ref, entity_id, created_at::BIGINT AS created_at, n_name AS title, region AS to_ref FROM n")
def s15(spark, sf):
    entities, links = readers.read_dump(spark, _dump(spark, sf))
    return entities.join(links.select(F.col("from_ref").alias("ref"), "to_ref"), "ref").select("ref", "entity_id", "created_at", "title", "to_ref")


@query("s16_import", f"WITH {DUMP_SQL} SELECT ref, NULL AS to_ref FROM n JOIN s ON ref = survivor UNION ALL SELECT DISTINCT a.survivor, b.survivor FROM n JOIN s a USING (entity_id) JOIN n m ON m.ref = n.region JOIN s b ON b.entity_id = m.entity_id WHERE a.survivor <> b.survivor")
def s16(spark, sf):
    target = folder(spark)
    readers.import_dump(spark, _dump(spark, sf), target)
    entities, links = spark.read.parquet(f"{target}/entities"), spark.read.parquet(f"{target}/relationships")
    return entities.select("ref", F.lit(None).cast("string").alias("to_ref")).union(links.select("from_ref", "to_ref"))


@query("s17_note_log", f"WITH {NOTES_SQL} SELECT entity_id, min((created_at, conv_id * 1000 + turn))[2] AS id, CASE WHEN bool_or(status = 'archived') THEN 'archived' ELSE 'active' END AS status FROM notes GROUP BY 1".replace("min((created_at, conv_id * 1000 + turn))[2]", "arg_min(conv_id * 1000 + turn, (created_at, conv_id * 1000 + turn))"))
def s17(spark, sf):
    path = folder(spark)
    n = notes(spark, sf).selectExpr("1 AS schema_version", "conv_id * 1000 + turn AS id", "kind", "title", "body", "tags", "linked_files", "created_at", "status", "source_ref", "valid_at", "invalid_at", "entity_id", "remote_id")
    lines = n.select(F.to_json(F.struct("*")).alias("value"))
    lines.union(spark.createDataFrame([("no record",), ("{}",)], "value string")).write.text(path)
    return N.fold(readers.read_note_log(spark, path)).select("entity_id", "id", "status")


@query("s18_commits", f"WITH {NOTES_SQL} SELECT md5(uuid) AS sha, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS subject, conv_id || chr(10) || turn AS body FROM notes")
def s18(spark, sf):
    subject = F.trim(F.regexp_replace("title", r"\s+", " "))
    commits = notes(spark, sf).withColumn("commit", F.concat(F.md5("uuid"), F.lit("\n"), subject, F.lit("\n"), F.col("conv_id").cast("string"), F.lit("\n"), F.col("turn").cast("string"), F.lit("\n")))
    text = commits.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("commit")), "\0").alias("value"))
    return readers.read_commits(text).select("sha", "subject", "body")


@query("s19_s20_sinks", f"WITH {CHUNKS_SQL} SELECT chunk_id, path, name, start_line::BIGINT AS start_line, true AS fits FROM chunks UNION ALL SELECT chunk_id, path || ':' || start_line, NULL, NULL, true FROM chunks")
def s19(spark, sf):
    """Rows written as JSON lines and as text and read again; the JSON has just the fields and types of the contract."""
    c, lines, text = chunks(spark, sf).select("chunk_id", "path", "name", "start_line"), folder(spark), folder(spark)
    readers.write_jsonl(c, lines)
    readers.write_text(c, F.concat_ws("\t", "chunk_id", F.concat("path", F.lit(":"), "start_line")), text)
    again = spark.read.json(lines)
    fits = readers.has_schema(again, {"chunk_id": "bigint", "path": "string", "name": "string", "start_line": "bigint"})
    part = F.split("value", "\t")
    plain = spark.read.text(text).select(part[0].cast("long").alias("chunk_id"), part[1].alias("path"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("start_line"))
    return again.select("chunk_id", "path", "name", "start_line").union(plain).withColumn("fits", F.lit(fits))


@query("s22_sample", "SELECT doc_id, source FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 50")
def s22(spark, sf):
    return readers.sample(table(spark, sf, "documents").select("doc_id", "source"), 50, "doc_id")


# search results

PLACE_SQL = "SELECT chunk_id, path, language, name, start_line, end_line"


@query("j1_v3_knn_int8", f"""
WITH {CHUNKS_SQL}, q AS (SELECT list_transform(embedding, lambda x: greatest(-127, least(127, round(x::DOUBLE * 127)))::BIGINT) AS v FROM embeddings WHERE vec_id = 0),
c AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(-127, least(127, round(x::DOUBLE * 127)))::BIGINT) AS v FROM embeddings),
s AS (SELECT vec_id, list_sum(list_transform(list_zip(c.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS sq_dist FROM c, q), k AS (SELECT * FROM s ORDER BY sq_dist, vec_id LIMIT 25)
{PLACE_SQL}, sq_dist, round(sqrt(sq_dist::DOUBLE) / 127, 6) AS distance FROM k JOIN chunks ON chunk_id = vec_id""")
def j1(spark, sf):
    v = vectors(spark, sf).select(F.col("vec_id").alias("chunk_id"), V.quantise(F.col("embedding")).alias("embedding"))
    hits = V.knn_int8(v, query_vector(spark, sf), 25, ["chunk_id"]).select("chunk_id", "sq_dist", F.round("distance", 6).alias("distance"))
    return reads.with_places(hits, placed_chunks(spark, sf), files(spark, sf)).select("chunk_id", "path", "language", "name", "start_line", "end_line", "sq_dist", "distance")


@query("j2_text_places", f"WITH {CHUNKS_SQL}, {Q.TERM_SQL}, k AS (SELECT doc_id, score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 50) {PLACE_SQL}, round(score, 6) AS score FROM k JOIN chunks ON chunk_id = doc_id")
def j2(spark, sf):
    docs, index = Q.texts(spark, sf)
    hits = B.search_terms(docs, "benchmark thonon of-ea", ["text"], 50, ["doc_id"], index).select(F.col("doc_id").alias("chunk_id"), F.round("score", 6).alias("score"))
    return reads.with_places(hits, placed_chunks(spark, sf), files(spark, sf)).select("chunk_id", "path", "language", "name", "start_line", "end_line", "score")


@query("b1_indexed_terms", f"WITH {Q.TERM_SQL} SELECT doc_id, round(score, 6) AS score FROM bm")
def b1_indexed(spark, sf):
    """The search over postings and lengths that are kept as tables."""
    d, path = table(spark, sf, "documents").select("doc_id", "text"), folder(spark)
    B.postings(d, "doc_id", ["text"]).write.parquet(f"{path}/postings")
    B.lengths(d, "doc_id", ["text"]).write.parquet(f"{path}/lengths")
    phrases = [B.query_tokens(t) for t in "benchmark thonon of-ea".split()]
    return B.bm25_indexed(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), phrases, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


def note_vectors(spark, sf):
    """Notes with one of the vectors each, as many notes as there are vectors at most for a conversation."""
    n = notes(spark, sf).withColumn("vec_id", (F.col("conv_id") * 31 + F.col("turn") * 7) % 500)
    return n.join(vectors(spark, sf).select("vec_id", "embedding", "label"), "vec_id")


NOTE_VECTORS_SQL = f"{NOTES_SQL}, nv AS (SELECT notes.*, label, sqrt(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d FROM notes JOIN embeddings ON vec_id = (conv_id * 31 + turn * 7) % 500)"
ACTIVE_SQL = "coalesce(valid_at, created_at) <= 1700030000 AND (invalid_at IS NULL OR invalid_at > 1700030000)"


@query("r2_hybrid_notes", f"""WITH {NOTE_VECTORS_SQL}, k AS (SELECT * FROM nv ORDER BY d, uuid LIMIT 60), near AS (SELECT uuid, row_number() OVER (ORDER BY d, uuid) AS rank FROM k WHERE {ACTIVE_SQL}),
t AS (SELECT uuid, regexp_extract_all(strip_accents(lower(body)), '[\\pL\\pN]+') AS w FROM notes), size AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM t JOIN nv USING (uuid)),
c AS (SELECT uuid, len(w) AS l, len(list_filter(range(1, len(w)), lambda k: w[k] = 'of' AND w[k + 1] = 'the')) AS f FROM t JOIN nv USING (uuid)), df AS (SELECT count(*) AS df FROM c WHERE f > 0),
bm AS (SELECT uuid, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * l / avg_len)) AS score FROM c, df, size WHERE f > 0),
said AS (SELECT uuid, row_number() OVER (ORDER BY score DESC, uuid) AS rank FROM bm JOIN notes USING (uuid) WHERE {ACTIVE_SQL} QUALIFY rank <= 60), u AS (SELECT * FROM near UNION ALL SELECT * FROM said), rrf AS (SELECT uuid, sum(1.0::DOUBLE / (60 + rank)) AS s FROM u GROUP BY 1)
SELECT uuid, round(s, 8) AS score, round(1 / s, 6) AS distance FROM rrf ORDER BY s DESC, uuid LIMIT 20""")
def r2(spark, sf):
    n = note_vectors(spark, sf)
    index = Q.kept_index(spark, sf, "notes with vectors", n, "uuid", ["body"])
    got = reads.hybrid_notes(n, query_vector(spark, sf), "of the", 20, 1700030000, ("body",), index)
    return got.select("uuid", F.round("score", 8).alias("score"), F.round("distance", 6).alias("distance"))


@query("v5_project_knn", f"WITH {NOTE_VECTORS_SQL}, a AS (SELECT uuid, d FROM nv WHERE label = 3 ORDER BY d, uuid LIMIT 30), b AS (SELECT * FROM nv ORDER BY d, uuid LIMIT 30) SELECT uuid, round(d, 6) AS distance, 'before' AS filtered FROM a UNION ALL SELECT uuid, round(d, 6), 'after' FROM b WHERE label = 3")
def v5(spark, sf):
    """Nearest notes of one project, with the project judged before the limit and after it."""
    n, q = note_vectors(spark, sf), query_vector(spark, sf)
    sides = [V.knn(n, q, 30, ["uuid"], F.col("label") == 3, before).select("uuid", F.round("distance", 6).alias("distance"), F.lit(name).alias("filtered")) for before, name in ((True, "before"), (False, "after"))]
    return sides[0].union(sides[1])


@query("r8_similarity", f"WITH {Q.L2_SQL}, k AS (SELECT * FROM s ORDER BY d, vec_id LIMIT 60) SELECT vec_id, round(1 - (d - min(d) OVER ()) / greatest(max(d) OVER () - min(d) OVER (), 1e-6), 6) AS similarity FROM k")
def r8(spark, sf):
    k = V.knn(vectors(spark, sf), query_vector(spark, sf), 60, ["vec_id"])
    return k.select("vec_id", F.round(fusion.similarity(F.col("distance"), Window.partitionBy()), 6).alias("similarity"))


@query("o5_caps", f"WITH {NOTES_SQL}, {Q.PHRASE_SQL} SELECT 'knn' AS list, least(100, count(*)) AS n FROM embeddings UNION ALL SELECT 'chunks', least(1000, count(*)) FROM embeddings UNION ALL SELECT 'listed', least(500, count(*)) FROM notes UNION ALL SELECT 'timeline', least(200, count(*)) FROM bm UNION ALL SELECT 'phrase', least(1000, count(*)) FROM bm")
def o5(spark, sf):
    """Lists asked for with a limit beyond their caps."""
    v, q, many = vectors(spark, sf), query_vector(spark, sf), 1_000_000
    d, index = Q.texts(spark, sf)
    lists = {
        "knn": V.knn(v, q, many, ["vec_id"]), "chunks": V.knn_int8(v.withColumn("embedding", V.quantise(F.col("embedding"))), q, many, ["vec_id"]), "listed": N.listed(notes(spark, sf), limit=many, archived=True),
        "timeline": B.timeline(d, "of the", ["text"], many, F.col("doc_id"), ["doc_id"], index), "phrase": B.search_phrase(d, "of the", ["text"], many, ["doc_id"], index=index),
    }
    counts = [x.agg(F.count("*").alias("n")).select(F.lit(name).alias("list"), "n") for name, x in lists.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


# probes, lookups, listings

@query("f15_probes", f"WITH {EDGES_SQL}, {NOTES_SQL} SELECT (SELECT count(*) > 0 FROM edges) AS any_edge, (SELECT count(*) > 0 FROM documents WHERE doc_id = 17) AS has_chunks, (SELECT count(*) > 0 FROM notes WHERE source_ref = 'git:none') AS harvested")
def f15(spark, sf):
    any_edge = reads.found(edges(spark, sf), name="any_edge")
    has_chunks = reads.found(chunks(spark, sf), F.col("file_id") == 17).scalar()
    harvested = reads.found(notes(spark, sf), F.col("source_ref") == "git:none").scalar()
    return any_edge.withColumn("has_chunks", has_chunks).withColumn("harvested", harvested)


@query("f16_lookups", f"WITH {NOTES_SQL}, {CHUNKS_SQL} SELECT uuid AS key, title AS value FROM notes WHERE uuid = '00000003-0000' UNION ALL SELECT path, language FROM chunks WHERE path = (SELECT path FROM chunks WHERE chunk_id = 5)")
def f16(spark, sf):
    note = reads.by_key(notes(spark, sf), "uuid", "00000003-0000").select(F.col("uuid").alias("key"), F.col("title").alias("value"))
    path = chunks(spark, sf).filter("chunk_id = 5").select("path").first()[0]
    return note.union(reads.by_key(files(spark, sf), "path", path).select("path", "language"))


@query("j7_symbol_chunks", f"WITH {EDGES_SQL}, c AS (SELECT o_orderkey AS chunk_id, 's' || (o_custkey % 61) AS name, 'f' || (o_orderkey % 97) AS path FROM orders) SELECT DISTINCT target_name AS symbol, chunk_id FROM c JOIN edges e ON c.name = e.source_name AND c.path = e.source_file WHERE e.kind IN ('mentions', 'calls') AND target_name IN ('s1', 's7')")
def j7(spark, sf):
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit("s"), F.col("o_custkey") % 61).alias("name"), F.concat(F.lit("f"), F.col("o_orderkey") % 97).alias("path"))
    return reads.symbol_chunks(c, edges(spark, sf), ["s1", "s7"])


SPECS_SQL = """specs AS (SELECT n_nationkey AS id, 'spec/' || n_name AS path, n_name AS title, n_nationkey % 2 = 0 AS is_auto FROM nation),
links AS (SELECT n_nationkey AS spec_id, 'src' || n_nationkey || '/' AS linked FROM nation WHERE n_nationkey > 3 UNION SELECT n_regionkey, 'src' || n_nationkey || '/1' FROM nation)"""


def specs(spark, sf):
    n = table(spark, sf, "nation")
    links = n.filter("n_nationkey > 3").selectExpr("n_nationkey AS spec_id", "concat('src', n_nationkey, '/') AS linked").union(n.selectExpr("n_regionkey", "concat('src', n_nationkey, '/1')")).distinct()
    return n.selectExpr("n_nationkey AS id", "concat('spec/', n_name) AS path", "n_name AS title", "n_nationkey % 2 = 0 AS is_auto"), links


@query("j10_specs_of_files", f"WITH {SPECS_SQL}, {CHUNKS_SQL} SELECT path, title FROM specs WHERE id IN (SELECT spec_id FROM links JOIN chunks ON starts_with(chunks.path, linked))")
def j10(spark, sf):
    return reads.specs_of_files(*specs(spark, sf), files(spark, sf))


@query("q13_specs", f"WITH {SPECS_SQL} SELECT id, path, title, is_auto, coalesce(string_agg(linked, ',' ORDER BY linked), '') AS linked FROM specs LEFT JOIN links ON spec_id = id GROUP BY ALL")
def q13(spark, sf):
    return reads.specs_listed(*specs(spark, sf)).withColumn("linked", F.array_join("linked", ","))


@query("j12_project_links", "WITH d AS (SELECT n_nationkey AS p, n_regionkey AS o FROM nation UNION SELECT n_nationkey, (n_nationkey + 3) % 25 FROM nation), x AS (SELECT a.n_name AS a, b.n_name AS b FROM d JOIN nation a ON a.n_nationkey = p JOIN nation b ON b.n_nationkey = o) SELECT DISTINCT a AS project, b AS other, 'depends on' AS direction FROM x UNION SELECT b, a, 'needed by' FROM x")
def j12(spark, sf):
    n = table(spark, sf, "nation")
    deps = n.selectExpr("n_nationkey AS project_id", "n_regionkey AS dep_id").union(n.selectExpr("n_nationkey", "(n_nationkey + 3) % 25")).distinct()
    return reads.project_links(n.selectExpr("n_nationkey AS id", "n_name AS name"), deps)


@query("u5_dependency_notes", f"""WITH {NOTES_SQL}, own AS (SELECT 'p' || (conv_id % 3) AS root, uuid, kind FROM notes WHERE conv_id % 4 = 0),
more AS (SELECT DISTINCT 'p' || (conv_id % 3) AS root, uuid, kind FROM notes WHERE 'locked' IN (SELECT unnest(tags)) AND kind IN ('decision', 'requirement'))
SELECT * FROM own UNION ALL SELECT * FROM more WHERE (root, uuid) NOT IN (SELECT (root, uuid) FROM own)""")
def u5(spark, sf):
    n = notes(spark, sf).withColumn("root", F.concat(F.lit("p"), F.col("conv_id") % 3))
    own = n.filter("conv_id % 4 = 0").select("root", "uuid", "kind")
    twice = n.select("root", "uuid", "kind", "tags", F.explode(F.array(F.lit(1), F.lit(2))).alias("place"))
    return reads.with_dependencies(own, twice, "place")


@query("q1_chunks_by_id", f"WITH {CHUNKS_SQL} SELECT chunk_id, path, start_line, row_number() OVER (ORDER BY path, start_line, end_line, chunk_id)::INTEGER AS place FROM chunks WHERE chunk_id IN (SELECT doc_id + 1 FROM labels)")
def q1(spark, sf):
    """The place is that of the rows as they come."""
    ids = table(spark, sf, "labels").select((F.col("doc_id") + 1).alias("chunk_id"))
    return placed(reads.by_ids(chunks(spark, sf), ids).select("chunk_id", "path", "start_line")).withColumn("place", F.col("place").cast("int"))


@query("q4_callees", f"WITH {EDGES_SQL} SELECT DISTINCT source_name, target_name FROM edges WHERE kind = 'calls' AND source_name IS NOT NULL")
def q4(spark, sf):
    return reads.callees(edges(spark, sf))


@query("q6_named_chunks", f"WITH {CHUNKS_SQL}, r AS (SELECT DISTINCT name AS node, length(name) / 10.0::DOUBLE AS rank FROM chunks WHERE name IS NOT NULL AND length(name) % 2 = 0) SELECT chunk_id, name, coalesce(rank, 0)::DOUBLE AS graph_rank FROM chunks LEFT JOIN r ON node = name")
def q6(spark, sf):
    c = chunks(spark, sf).select("chunk_id", "name")
    ranks = c.filter("name is not null and length(name) % 2 = 0").select(F.col("name").alias("node"), (F.length("name") / 10.0).cast("double").alias("rank")).distinct()
    return graph.name_ranks(c, ranks).select("chunk_id", "name", "graph_rank")


@query("q7_edges_either_end", f"WITH {EDGES_SQL} SELECT 'symbol' AS asked, e.* FROM edges e WHERE source_name = 's7' OR target_name = 's7' UNION ALL SELECT 'file', e.* FROM edges e WHERE source_file = 'f3'")
def q7(spark, sf):
    e = edges(spark, sf)
    return reads.edges_of_symbol(e, "s7").select(F.lit("symbol").alias("asked"), *e.columns).union(reads.edges_of_file(e, "f3").select(F.lit("file"), *e.columns))


@query("q8_q10_notes_in_order", f"WITH {NOTES_SQL} SELECT uuid, status = 'archived' AS archived, row_number() OVER (ORDER BY created_at, uuid)::INTEGER AS place, 'all' AS list FROM notes UNION ALL SELECT uuid, false, row_number() OVER (ORDER BY created_at, uuid)::INTEGER, 'sync' FROM notes WHERE status <> 'archived'")
def q8(spark, sf):
    n, place = notes(spark, sf), F.col("place").cast("int").alias("place")
    every = placed(reads.for_dedup(n).select("uuid", (F.col("status") == "archived").alias("archived"))).select("uuid", "archived", place, F.lit("all").alias("list"))
    return every.union(placed(reads.for_sync(n).select("uuid", "archived")).select("uuid", "archived", place, F.lit("sync")))


@query("q9_reembed", f"WITH {NOTES_SQL} SELECT uuid, title, md5(body) AS body, 'active' AS list FROM notes WHERE status = 'active' UNION ALL SELECT uuid, title, md5(body), 'all' FROM notes")
def q9(spark, sf):
    sides = [reads.for_embedding(notes(spark, sf), archived).select("uuid", "title", F.md5("body").alias("body"), F.lit(name).alias("list")) for archived, name in ((False, "active"), (True, "all"))]
    return sides[0].union(sides[1])


@query("q11_folded_list", f"""WITH {NOTES_SQL}, f AS (SELECT entity_id, arg_min(uuid, (created_at, uuid)) AS base, min(created_at) AS created_at, bool_or(status = 'archived') AS archived, min(valid_at) AS valid_at, min(invalid_at) AS invalid_at, arg_min(kind, (created_at, uuid)) AS kind FROM notes GROUP BY 1)
SELECT * FROM (SELECT entity_id, created_at, 'now' AS list FROM f WHERE NOT archived AND kind = 'decision' AND starts_with(base, '000000') ORDER BY created_at DESC, entity_id LIMIT 30) UNION ALL SELECT * FROM (SELECT entity_id, created_at, 'then' FROM f WHERE {ACTIVE_SQL} ORDER BY created_at DESC, entity_id LIMIT 30)""")
def q11(spark, sf):
    r = notes(spark, sf).selectExpr("entity_id", "uuid AS id", "uuid AS commit", "kind", "created_at", "status", "1 AS schema_version", "valid_at", "invalid_at", "tags", "linked_files", "source_ref", "remote_id", "superseded_by", "superseded_by AS superseded_by_entity_id")
    now = reads.folded_list(r, "000000", "decision", limit=30).select("entity_id", "created_at", F.lit("now").alias("list"))
    return now.union(reads.folded_list(r, at=1700030000, limit=30).select("entity_id", "created_at", F.lit("then")))


@query("q12_q14_conventions", f"WITH {CHUNKS_SQL} SELECT 'rust' AS language, c.category, c.confidence::DOUBLE AS confidence, 0::BIGINT AS chunks FROM (VALUES ('b', 0.9), ('a', 0.9), ('c', 0.95)) c(category, confidence) UNION ALL SELECT coalesce(CASE WHEN chunk_id % 3 > 0 THEN language END, 'unknown'), '', 0, count(*) FROM chunks GROUP BY 1")
def q12(spark, sf):
    stored = spark.createDataFrame([("rust", "b", 0.9), ("rust", "a", 0.9), ("go", "x", 1.0), ("rust", "c", 0.95)], "language string, category string, confidence double")
    listed = reads.conventions_listed(stored, "rust").select("language", "category", "confidence", F.lit(0).cast("long").alias("chunks"))
    read = reads.for_conventions(chunks(spark, sf).withColumn("language", F.expr("case when chunk_id % 3 > 0 then language end"))).groupBy("language").agg(F.count("*").alias("chunks"))
    return listed.union(read.select("language", F.lit(""), F.lit(0.0), "chunks"))


# text

@query("a6_callee_words", r"""WITH w AS (SELECT p_partkey, unnest(string_split(lower(replace(p_name, '_', ' ')) || ' get item ' || lower(p_name), ' ')) AS w, generate_subscripts(string_split(lower(replace(p_name, '_', ' ')) || ' get item ' || lower(p_name), ' '), 1) AS k FROM part),
f AS (SELECT p_partkey, w, min(k) AS k FROM w WHERE w <> '' GROUP BY 1, 2) SELECT p_partkey, string_agg(w, ' ' ORDER BY k) AS words FROM f GROUP BY 1""")
def a6(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.split_callees(F.array(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("getItem"), F.replace("p_name", F.lit(" "), F.lit("::")))).alias("words"))


@query("a7_a8_summary", rf"""WITH {CHUNKS_SQL}, t AS (SELECT chunk_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS t, trim(lower(regexp_replace(regexp_replace(coalesce(name, 'x'), '([\p{{Ll}}0-9])(\p{{Lu}})', '\1 \2', 'g'), '[_\-:.\s]+', ' ', 'g'))) AS nm FROM chunks),
a AS (SELECT chunk_id, nm, CASE WHEN regexp_matches(t, '[.!?](\s|$)') THEN regexp_extract(t, '^(.*?[.!?])(\s|$)', 1) ELSE t END AS a FROM t), b AS (SELECT *, concat_ws(' ', nullif(a, ''), nullif(nm, '')) AS b FROM a), c AS (SELECT *, concat_ws(' ', nullif(b, ''), 'load table save') AS c FROM b), d AS (SELECT *, c || ' cannot open file' AS d FROM c)
SELECT chunk_id, md5(CASE WHEN length(a) // 4 > 96 THEN '' WHEN length(b) // 4 > 96 THEN a WHEN length(c) // 4 > 96 THEN b WHEN length(d) // 4 > 96 THEN c ELSE d END) AS summary FROM d""")
def a7(spark, sf):
    parts = [F.coalesce("name", F.lit("x")), F.col("content"), F.array(F.lit("loadTable"), F.lit("save_table")), F.lit('log("cannot open file") + "ab c"'[:25])]
    return chunks(spark, sf).select("chunk_id", F.md5(X.structural_summary(*parts)).alias("summary"))


@query("a10_stripped_code", f"WITH {Q.CODE_SQL} SELECT id, content || CASE language WHEN 'python' THEN ' x =   ' ELSE '   x =  ; ' END AS code FROM code")
def a10(spark, sf):
    c = Q.code(spark, sf)
    more = F.when(F.col("language") == "python", F.concat(F.lit(' x = "lit '), F.col("id"), F.lit('" # tail'))).otherwise(F.concat(F.lit(" /* note "), F.col("id"), F.lit(' */ x = "lit '), F.col("id"), F.lit('"; // tail')))
    return c.select("id", C.stripped_code(F.concat("content", more), F.col("language")).alias("code"))


@query("a12_case_styles", "SELECT n_nationkey, t.name, t.style FROM nation, (VALUES ('get_order', 'snake'), ('getOrder', 'camel'), ('GetOrder', 'pascal'), ('GET_ORDER', 'screaming'), ('ab', 'unknown'), ('order', 'snake'), ('é', 'unknown'), ('HTTP', 'pascal'), ('_a_b', 'snake'), ('Get_Order', 'unknown')) t(name, style)")
def a12(spark, sf):
    names = ["get_order", "getOrder", "GetOrder", "GET_ORDER", "ab", "order", "é", "HTTP", "_a_b", "Get_Order"]
    n = table(spark, sf, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, names))).alias("name"))
    return n.withColumn("style", X.case_style(F.col("name")))


@query("a19_headings", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'T ' || doc_id WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN '' ELSE NULL END AS heading FROM documents")
def a19(spark, sf):
    line = F.expr("CASE doc_id % 5 WHEN 0 THEN concat('###  T ', doc_id, ' ') WHEN 1 THEN '##x' WHEN 2 THEN '####### seven' WHEN 3 THEN '##' ELSE text END")
    return table(spark, sf, "documents").select("doc_id", X.atx_heading(line).alias("heading"))


@query("a22_escape_xml", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped FROM pages")
def a22(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.escape_xml(F.col("html"))).alias("escaped"))


@query("a23_a24_cap_percent", r"""WITH c AS (SELECT doc_id, text, coalesce(list_max(list_filter(range(1, least(length(text), 600) + 1), lambda k: octet_length(encode(substr(text, 1, k))) <= 600)), 0) AS k FROM documents)
SELECT doc_id, md5(CASE WHEN octet_length(encode(text)) <= 600 THEN text ELSE substr(text, 1, k) || chr(10) || chr(10) || '[...truncated]' END) AS capped, (doc_id * 100 // 1000)::BIGINT AS percent FROM c""")
def a23(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.cap_text(F.col("text"), 600)).alias("capped"), X.percent(F.col("doc_id"), F.lit(1000)).alias("percent"))


# merges

@query("m3_dedupe", f"""WITH {NOTES_SQL}, s AS (SELECT *, arg_min(uuid, (created_at, uuid)) OVER (PARTITION BY entity_id) AS survivor FROM notes), t AS (SELECT s.*, CASE WHEN o.survivor <> s.survivor THEN o.survivor END AS successor FROM s LEFT JOIN s o ON o.uuid = s.superseded_by),
g AS (SELECT survivor, tag, min((created_at, uuid, k)) AS seen FROM (SELECT survivor, created_at, uuid, unnest(tags) AS tag, generate_subscripts(tags, 1) AS k FROM s) GROUP BY 1, 2), l AS (SELECT survivor, string_agg(tag, ',' ORDER BY seen) AS tags FROM g GROUP BY 1),
h AS (SELECT survivor, f, min((created_at, uuid)) AS seen FROM (SELECT survivor, created_at, uuid, unnest(linked_files) AS f FROM s) GROUP BY 1, 2), m AS (SELECT survivor, string_agg(f, ',' ORDER BY seen) AS linked_files FROM h GROUP BY 1),
r AS (SELECT survivor, CASE WHEN bool_or(status = 'archived') THEN 'archived' ELSE 'active' END AS status, arg_min(successor, (created_at, uuid)) FILTER (WHERE successor IS NOT NULL) AS superseded_by, count(*) AS copies FROM t GROUP BY survivor)
SELECT survivor AS uuid, status, superseded_by, copies, tags, linked_files FROM r JOIN l USING (survivor) JOIN m USING (survivor)""")
def m3(spark, sf):
    return N.dedupe(notes(spark, sf)).select("uuid", "status", "superseded_by", "copies", F.array_join("tags", ",").alias("tags"), F.array_join("linked_files", ",").alias("linked_files"))


@query("m4_collapse", f"""WITH {NOTES_SQL}, g AS (SELECT entity_id, tag, min((created_at, uuid, k)) AS seen FROM (SELECT entity_id, created_at, uuid, unnest(tags) AS tag, generate_subscripts(tags, 1) AS k FROM notes) GROUP BY 1, 2), l AS (SELECT entity_id, string_agg(tag, ',' ORDER BY seen) AS tags FROM g GROUP BY 1)
SELECT entity_id, min(created_at) AS created_at, arg_min(uuid, (created_at, uuid)) AS uuid, count(*) AS n, any_value(l.tags) AS tags FROM notes JOIN l USING (entity_id) GROUP BY 1""")
def m4(spark, sf):
    return N.collapse(notes(spark, sf)).select("entity_id", "created_at", "uuid", "n", F.array_join("tags", ",").alias("tags"))


@query("m10_add_edges", f"WITH {NOTES_SQL}, {Q.NOTE_EDGES_SQL}, more AS (SELECT to_id AS from_id, from_id AS to_id, 'relates_to' AS kind, 5 AS created_at FROM note_edges UNION ALL SELECT from_id, to_id, kind, 1 FROM note_edges) SELECT from_id, to_id, kind, created_at FROM note_edges UNION ALL SELECT from_id, to_id, kind, min(created_at) FROM more WHERE (from_id, to_id, kind) NOT IN (SELECT (from_id, to_id, kind) FROM note_edges) GROUP BY 1, 2, 3")
def m10(spark, sf):
    e = Q.note_edges(spark, sf)
    more = e.selectExpr("to_id AS from_id", "from_id AS to_id", "kind", "5L AS created_at").union(e.selectExpr("from_id", "to_id", "kind", "1L"))
    return N.add_edges(e, more.unionAll(more))


@query("m13_split_batch", f"WITH {NOTES_SQL} SELECT remote_id AS external_id, 'new' AS side, NULL::BOOLEAN AS has_embedding FROM notes WHERE remote_id IS NOT NULL AND turn % 3 = 0 UNION ALL SELECT remote_id, 'known', turn % 2 = 0 FROM notes WHERE remote_id IS NOT NULL AND turn % 3 <> 0")
def m13(spark, sf):
    n = notes(spark, sf).filter("remote_id is not null").withColumn("external_id", F.col("remote_id"))
    new, known = N.split_batch(n.select("external_id"), n.filter("turn % 3 != 0"), n.filter("turn % 2 = 0").select("uuid"))
    return new.select("external_id", F.lit("new").alias("side"), F.lit(None).cast("boolean").alias("has_embedding")).union(known.select("external_id", F.lit("known"), "has_embedding"))


@query("m2_supersede_edges", f"WITH {NOTES_SQL}, {Q.NOTE_EDGES_SQL}, p AS (SELECT a.uuid AS old, b.uuid AS new FROM notes a JOIN notes b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2 WHERE a.turn = 0 AND a.status = 'active') SELECT from_id, to_id, kind, created_at FROM note_edges UNION ALL SELECT new, old, 'supersedes', 99 FROM p")
def m2_edges(spark, sf):
    n = notes(spark, sf)
    pairs = n.filter("turn = 0").selectExpr("uuid AS old", "concat(lpad(cast(conv_id as string), 8, '0'), '-0002') AS new", "99L AS at")
    return N.supersede(n, Q.note_edges(spark, sf), pairs)[1]


@query("u4_merge_edges", f"WITH {EDGES_SQL}, b AS (SELECT *, 0 AS n FROM edges WHERE line < 250 UNION ALL SELECT *, 1 FROM edges WHERE line >= 200), r AS (SELECT *, row_number() OVER (PARTITION BY source_file, target_name, kind, line ORDER BY n, source_name NULLS FIRST) AS k FROM b) SELECT source_file, source_name, target_name, kind, line FROM r WHERE k = 1")
def u4(spark, sf):
    e = edges(spark, sf)
    return graph.merge_edges(e.filter("line < 250"), e.filter("line >= 200"))


@query("t7_moved_refs", "SELECT 'b' || n_nationkey AS ref, CASE WHEN n_nationkey % 5 < 4 THEN md5(n_name || CASE WHEN n_nationkey % 3 = 0 THEN '!' ELSE '' END) END AS oid, CASE WHEN n_nationkey % 7 > 0 THEN md5(n_name) END AS last FROM nation WHERE (n_nationkey % 5 < 4 OR n_nationkey % 7 > 0) AND NOT (n_nationkey % 5 < 4 AND n_nationkey % 7 > 0 AND n_nationkey % 3 > 0)")
def t7(spark, sf):
    n = table(spark, sf, "nation")
    refs = n.filter("n_nationkey % 5 < 4").selectExpr("concat('b', n_nationkey) AS ref", "md5(concat(n_name, CASE WHEN n_nationkey % 3 = 0 THEN '!' ELSE '' END)) AS oid")
    return reads.moved_refs(refs, n.filter("n_nationkey % 7 > 0").selectExpr("concat('b', n_nationkey) AS ref", "md5(n_name) AS oid"))


@query("o6_context_sections", f"WITH {NOTES_SQL} SELECT kind, CASE kind WHEN 'decision' THEN 1 WHEN 'requirement' THEN 2 WHEN 'handoff' THEN 3 WHEN 'question' THEN 4 WHEN 'intent' THEN 5 ELSE 7 END AS priority, CASE kind WHEN 'intent' THEN 20 WHEN 'handoff' THEN 3 WHEN 'question' THEN 10 WHEN 'decision' THEN 10 WHEN 'requirement' THEN 10 ELSE 20 END AS most, count(*) AS n FROM notes GROUP BY 1")
def o6_sections(spark, sf):
    return notes(spark, sf).groupBy("kind").agg(F.count("*").alias("n")).select("kind", packing.section_priority(F.col("kind")).cast("int").alias("priority"), packing.section_limit(F.col("kind")).alias("most"), "n")
