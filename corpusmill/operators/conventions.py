"""Conventions of a code base, from counts over its chunks: one aggregation by language, then records by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import case_style

LEAST_CONFIDENCE, LEAST_EVIDENCE, ASYNC_SHARE = 0.5, 5, 0.2
STYLES = ["snake", "camel", "pascal", "screaming"]
STYLE_NAMES = {"snake": "snake_case", "camel": "camelCase", "pascal": "PascalCase", "screaming": "SCREAMING_SNAKE_CASE"}
FUNCTIONS, TYPES = ["function", "method"], ["struct", "class", "enum", "trait", "interface", "type"]


def dominant(counts: dict[str, Column]) -> Column:
    """struct(style, n): the most frequent; ties go to the style named first."""
    best = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("style"))
    for style, n in counts.items():
        best = F.when(n > best["n"], F.struct(n.alias("n"), F.lit(style).alias("style"))).otherwise(best)
    return best


def coverage(share: Column) -> Column:
    """struct(level, confidence) of a share of documented functions."""
    return F.when(share > 0.7, F.struct(F.lit("high").alias("level"), share.alias("confidence"))).when(share >= 0.3, F.struct(F.lit("medium").alias("level"), F.greatest(share, F.lit(0.5)).alias("confidence"))).otherwise(F.struct(F.lit("low").alias("level"), F.greatest(1 - share, F.lit(0.5)).alias("confidence")))


def _record(category: str, ok: Column, description: Column, confidence: Column, evidence: Column, source: int) -> Column:
    kind = "struct<category:string,description:string,confidence:double,evidence_count:bigint,source:int>"
    row = F.struct(F.lit(category).alias("category"), description.alias("description"), confidence.cast("double").alias("confidence"), evidence.cast("long").alias("evidence_count"), F.lit(source).alias("source"))
    return F.when(ok, row.cast(kind))


def extract(chunks: DataFrame, thresholds: bool = True) -> DataFrame:
    """(language, category, description, confidence, evidence_count) from chunks (language, path, node_type, name, content, has_doc).

    tsx counts as typescript. Rules of a language win over the generic ones for a category; records below the thresholds are left out.
    """
    lang = F.coalesce("language", F.lit("unknown"))
    rows = chunks.withColumn("language", F.when(lang == "tsx", "typescript").otherwise(lang)).withColumn("style", case_style(F.col("name")))
    is_fn, is_type = F.col("node_type").isin(FUNCTIONS), F.col("node_type").isin(TYPES)
    has = lambda pattern: F.coalesce(F.rlike("content", F.lit(pattern)), F.lit(False))
    in_tests = {
        "rust": F.endswith("path", F.lit("_test.rs")) | F.contains("path", F.lit("tests/")),
        "typescript": F.rlike("path", F.lit(r"\.(test|spec)\.tsx?$|__tests__/")),
    }
    n = lambda cond: F.count_if(cond)
    sums = {f"fn_{s}": n(is_fn & (F.col("style") == s)) for s in STYLES} | {f"ty_{s}": n(is_type & (F.col("style") == s)) for s in STYLES}
    sums |= {
        "fns": n(is_fn), "docs": n(is_fn & F.col("has_doc")), "anyhow": n(has(r"\banyhow\b")), "thiserror": n(has(r"\bthiserror\b")), "app_error": n(has(r"\bAppError\b")),
        "async_rust": n(is_fn & has(r"\basync\s+fn\b")), "tokio": n(has(r"\btokio::")), "cfg_test": n(has(r"#\s*\[cfg\s*\(\s*test\s*\)\]")), "tests_rust": n(in_tests["rust"]),
        "async_ts": n(is_fn & has(r"\basync\b")), "tests_ts": n(in_tests["typescript"]), "jest": n(has(r"\b(describe|it|test)\s*\(")),
    }
    g = rows.groupBy("language").agg(*[v.alias(k) for k, v in sums.items()])
    c = F.col
    rust, ts = c("language") == "rust", c("language") == "typescript"

    def naming(prefix: str, category: str, text: str, source: int, ok: Column) -> Column:
        total = sum((c(f"{prefix}_{s}") for s in STYLES[1:]), c(f"{prefix}_{STYLES[0]}"))
        best = dominant({s: c(f"{prefix}_{s}") for s in STYLES})
        name = F.element_at(F.create_map(*[F.lit(x) for kv in STYLE_NAMES.items() for x in kv]), best["style"])
        return _record(category, ok & (total > 0), F.concat(F.lit(text), name), best["n"] / F.nullif(total, F.lit(0)), best["n"], source)

    errors = c("anyhow") + c("thiserror") + c("app_error")
    error = F.when((c("anyhow") >= c("thiserror")) & (c("anyhow") >= c("app_error")), F.struct(c("anyhow").alias("n"), F.lit("Error handling via anyhow::Result").alias("d"))).when(c("thiserror") >= c("app_error"), F.struct(c("thiserror").alias("n"), F.lit("Error types defined with thiserror").alias("d"))).otherwise(F.struct(c("app_error").alias("n"), F.lit("Custom AppError type for error handling").alias("d")))
    tests = c("tests_rust") + c("cfg_test")
    test = F.when(c("tests_rust") >= c("cfg_test"), F.struct(c("tests_rust").alias("n"), F.lit("Tests in separate *_test.rs / tests/ files").alias("d"))).otherwise(F.struct(c("cfg_test").alias("n"), F.lit("Tests in #[cfg(test)] inline modules").alias("d")))
    share = c("docs") / F.nullif(c("fns"), F.lit(0))
    level = coverage(share)
    specific = rust | ts
    none = F.nullif(c("fns"), F.lit(0))
    records = [
        naming("fn", "naming.functions", "Functions use ", 0, F.lit(True)),
        naming("ty", "naming.types", "Types use ", 0, specific),
        _record("error_handling", rust & (errors > 0), error["d"], error["n"] / F.nullif(errors, F.lit(0)), error["n"], 0),
        _record("async", rust & (c("async_rust") / none > ASYNC_SHARE), F.concat(F.lit("Async runtime: "), F.when(c("tokio") > 0, "tokio").otherwise("async-std")), c("async_rust") / none, c("async_rust"), 0),
        _record("async", ts & (c("async_ts") / none > ASYNC_SHARE), F.lit("Uses async/await"), c("async_ts") / none, c("async_ts"), 0),
        _record("testing", rust & (tests > 0), test["d"], test["n"] / F.nullif(tests, F.lit(0)), test["n"], 0),
        _record("testing", ts & (c("tests_ts") > 0), F.lit("Tests in *.test / *.spec files"), F.lit(1.0), c("tests_ts"), 0),
        _record("docs", c("fns") > 0, F.concat(F.lit("Doc comment coverage: "), level["level"]), level["confidence"], c("fns"), 0),
    ]
    out = g.select("language", F.explode(F.filter(F.array(*records), lambda r: r.isNotNull())).alias("r")).select("language", "r.*")
    best = out.withColumn("_n", F.row_number().over(Window.partitionBy("language", "category").orderBy("source"))).filter("_n = 1").drop("_n", "source")
    return best.filter((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("evidence_count") >= LEAST_EVIDENCE)) if thresholds else best
