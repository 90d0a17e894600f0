"""The symbol graph: edges, one hop, PageRank and personalised PageRank."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.lineage import cut

EDGE = "source_file string, source_name string, target_name string, kind string, line int"


def html_edges(pages: DataFrame, file_col: str, html_col: str) -> DataFrame:
    """src and href of a page as imports, without empty ones, fragments and data; the source name is null, for a page has no scopes."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)\b(?:src|href)\s*=\s*["']([^"']*)["']"""), F.lit(1))
    targets = pages.select(F.col(file_col).alias("source_file"), F.posexplode(found).alias("at", "target_name"))
    good = targets.filter("target_name != '' and not startswith(target_name, '#') and not startswith(target_name, 'data:')")
    first = good.groupBy("source_file", "target_name").agg(F.min("at").alias("at"))
    return first.select("source_file", F.lit(None).cast("string").alias("source_name"), "target_name", F.lit("imports").alias("kind"), (F.col("at") + 1).cast("int").alias("line"))


#: Calls of what every Python program has.
PYTHON_BUILTIN = set("print len range enumerate zip map filter sorted reversed list dict set tuple str int float bool type isinstance hasattr getattr setattr super open input repr abs max min sum any all iter next id hash".split())


def _python_edges(text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    stack = [(tree, None)]
    while stack:
        node, scope = stack.pop()
        if isinstance(node, ast.Import):
            yield from ((scope, a.name, "imports", node.lineno) for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
            yield scope, "." * node.level + (node.module or ""), "imports", node.lineno
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name and name not in PYTHON_BUILTIN:
                yield scope, name, "calls", node.lineno
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            outer = node.decorator_list  # stand before what they decorate
            stack += [(c, scope) for c in outer] + [(c, node.name) for c in ast.iter_child_nodes(node) if not any(c is d for d in outer)]
        else:
            stack += [(c, scope) for c in ast.iter_child_nodes(node)]


def python_edges(files: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """Imports and calls of Python files in their innermost scope, builtin calls left out; the first of (scope, target, kind) in each file."""

    def run(frames):
        for frame in frames:
            rows = [(f, *e) for f, t in zip(frame[file_col], frame[text_col], strict=True) if t for e in _python_edges(t)]
            yield pd.DataFrame(rows, columns=["source_file", "source_name", "target_name", "kind", "line"])

    return first_edges(files.select(file_col, text_col).mapInPandas(run, EDGE))


def first_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (file, scope, target, kind), by line."""
    return edges.groupBy("source_file", "source_name", "target_name", "kind").agg(F.min("line").alias("line"))


def replace_by_file(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges where all of a file that is in new are new's."""
    return edges.join(new.select("source_file").distinct(), "source_file", "left_anti").unionByName(new)


def merge_edges(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sets, one edge for each (file, target, kind, line); the first set's wins."""
    both = first.withColumn("_n", F.lit(0)).unionByName(second.withColumn("_n", F.lit(1)))
    best = both.groupBy("source_file", "target_name", "kind", "line").agg(F.min_by("source_name", F.struct("_n", "source_name")).alias("source_name"))
    return best.select("source_file", "source_name", "target_name", "kind", "line")


def neighbour_names(edges: DataFrame, names: list[str]) -> DataFrame:
    """Names one call away from the given ones, either way, distinct."""
    calls = edges.filter("kind = 'calls' and source_name is not null")
    return calls.filter(F.col("source_name").isin(names)).select(F.col("target_name").alias("name")).union(calls.filter(F.col("target_name").isin(names)).select(F.col("source_name").alias("name"))).distinct()


def _uses(edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(source_name, source_file, symbol, kind), each once however many lines have it."""
    return edges.filter(F.col("kind").isin(*kinds) & F.col("source_name").isNotNull()).select("source_name", "source_file", F.col("target_name").alias("symbol"), "kind").distinct()


def chunk_symbols(chunks: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("mentions", "calls")) -> DataFrame:
    """(chunk_id, symbol, kind) of named chunks whose name and file are an edge's source; a symbol called and mentioned gives two rows."""
    used = _uses(edges, kinds)
    return chunks.join(used, (chunks["name"] == used["source_name"]) & (chunks["path"] == used["source_file"])).select("chunk_id", "symbol", "kind").distinct()


def symbol_chunks(chunks: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("mentions", "calls")) -> DataFrame:
    """(symbol, kind, n): how many different chunks chunk_symbols() has for each, without a row for each chunk and symbol.

    Chunks with the same names and files use the same symbols: these classes are joined, with their numbers of chunks. A null chunk_id is no chunk.
    """
    sources = F.array_sort(F.collect_set(F.struct("name", "path"))).alias("of")
    classes = chunks.filter("name is not null and path is not null").groupBy("chunk_id").agg(sources).groupBy("of").agg(F.count("chunk_id").alias("n"))
    each = classes.select("of", "n", F.explode("of").alias("source")).select("of", "n", "source.*")
    used = _uses(edges, kinds)
    found = each.join(used, (each["name"] == used["source_name"]) & (each["path"] == used["source_file"]))
    # a class of one source has no symbol twice, since uses are distinct
    more = F.size("of") > 1
    once = found.filter(~more).select("symbol", "kind", "n").union(found.filter(more).select("of", "symbol", "kind", "n").distinct().select("symbol", "kind", "n"))
    return once.groupBy("symbol", "kind").agg(F.sum("n").alias("n"))


def rank_edges(edges: DataFrame) -> DataFrame:
    """Edges for PageRank: a source and no mentions."""
    return edges.filter("source_name is not null and kind != 'mentions'").select(F.col("source_name").alias("src"), F.col("target_name").alias("dst"))


#: Different links up to which one task holds the graph: 24 bytes a link and 60 a node.
SMALL_LINKS = 2_000_000


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85, every: int = 5, small_links: int = SMALL_LINKS) -> DataFrame:
    """(node, rank) of (src, dst): a fixed number of rounds, loops left out but their nodes counted, multiple edges kept, what nodes without edges hold spread evenly.

    Doubles. Edges are counted by pair once. Up to ``small_links`` different pairs one task runs all rounds over arrays; larger graphs take a join a round, with the links dealt by source once and the lineage
    cut after every few rounds. Both give the same ranks but for rounding.
    """
    pairs = cut(edges.groupBy("src", "dst").count())
    n_links = pairs.count()
    if n_links <= small_links:
        return _small_pagerank(pairs, iterations, damping)
    nodes = cut(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    n = nodes.count()
    links = pairs.filter("src != dst")
    out = links.groupBy("src").agg(F.sum("count").alias("out"))
    links = cut(links.join(out, "src").select("src", "dst", (F.col("count") / F.col("out")).alias("share")))
    bound = links.select("src").distinct()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(iterations):
        loose = ranks.join(bound, ranks["node"] == bound["src"], "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("m")).scalar()
        flow = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = nodes.join(flow, nodes["node"] == flow["dst"], "left").select("node", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)).alias("rank"))
        if i % every == every - 1 and i < iterations - 1:
            ranks = cut(ranks)
    return ranks


def _small_pagerank(pairs: DataFrame, iterations: int, damping: float) -> DataFrame:
    kind = pairs.schema["src"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([frame["src"].to_numpy(), frame["dst"].to_numpy()]), return_inverse=True)
        src, dst, count = at[: len(frame)], at[len(frame) :], frame["count"].to_numpy(dtype=float)
        order = np.lexsort((dst, src))  # sums are the same for every order of links
        src, dst, count = (x[order][(src != dst)[order]] for x in (src, dst, count))
        out, n = np.bincount(src, count, len(names)), len(names)
        share, rank = count / out[src], np.full(n, 1 / n)
        for _ in range(iterations):
            rank = (1 - damping) / n + damping * (np.bincount(dst, rank[src] * share, n) + rank[out == 0].sum() / n)
        return pd.DataFrame({"node": names, "rank": rank})

    return pairs.groupBy(F.lit(0).alias("_all")).applyInPandas(run, f"node {kind}, rank double")


def personalised_pagerank(edges: list[tuple[str, str]], start: dict[str, float], iterations: int = 20, damping: float = 0.85) -> dict[str, float]:
    """Of a request's small graph, undirected edges given both ways by the caller: jumps and what dead ends hold go to the start weights; nodes by name, so that sums are the same for every order of edges. Without edges the start itself, as it is."""
    if not edges:
        return dict(start)
    names = sorted({x for e in edges for x in e} | set(start))
    at = {x: i for i, x in enumerate(names)}
    p = np.array([start.get(x, 0.0) for x in names])
    p = p / p.sum() if p.sum() > 0 else np.full(len(names), 1 / len(names))
    pairs = sorted((at[a], at[b]) for a, b in edges if a != b)
    src, dst = (np.array([e[i] for e in pairs], dtype=np.int64) for i in (0, 1))
    out = np.bincount(src, minlength=len(names)).astype(float)
    r = p.copy()
    for _ in range(iterations):
        flow = np.bincount(dst, r[src] / out[src], len(names)) if len(src) else np.zeros(len(names))
        r = (1 - damping) * p + damping * (flow + r[out == 0].sum() * p)
    return dict(zip(names, r.tolist(), strict=True))


def name_ranks(chunks: DataFrame, ranks: DataFrame) -> DataFrame:
    """chunks with graph_rank by name; all chunks of a name share it, others have 0."""
    return chunks.join(ranks.withColumnRenamed("rank", "graph_rank"), chunks["name"] == ranks["node"], "left").drop("node").withColumn("graph_rank", F.coalesce("graph_rank", F.lit(0.0)))


def related_notes(edges: DataFrame, notes: DataFrame, seen: DataFrame, id_col: str = "uuid") -> DataFrame:
    """Notes one relates_to away from the seen ones, either way, that are not seen."""
    rel = edges.filter("kind = 'relates_to'")
    ids = rel.join(seen.select(F.col(id_col).alias("from_id")), "from_id").select(F.col("to_id").alias(id_col)).union(rel.join(seen.select(F.col(id_col).alias("to_id")), "to_id").select(F.col("from_id").alias(id_col)))
    return notes.join(ids.distinct(), id_col, "left_semi").join(seen.select(id_col), id_col, "left_anti")


def ordered_edges(edges: DataFrame, per: list[str]) -> DataFrame:
    """A place for each edge of a symbol or file by kind, target and line."""
    return edges.withColumn("at", F.row_number().over(Window.partitionBy(*per).orderBy("kind", "target_name", "line")))
