"""Quality rules: base counts of a text, and its distance from language references, in DataFrame operations only.

A document has two histograms: character classes and common words. Both are compared with those of
each reference language by Jensen-Shannon distance (square root of the base-2 divergence). The references
are the pooled counts of all documents labelled with that language which pass the base rules, from
one pass over the whole table; the comparison then reads the counts, not the texts. A document is kept
if some language is near in both histograms. Short texts have noisy histograms, so a minimum length guards each comparison.

Defined results: a null or empty text has no words, all counts 0 and fails the base rules; a null or unknown
language gives nothing to the references but is judged like any other document; without any reference (an empty
table, no known language) the base rules decide alone; equal rows are judged alike; other columns are
not read. Arrays and hashes inside a row keep the work linear (sorting aside) in a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
import xxhash

from corpusmill.lineage import cut

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

#: Frequent function words of each language; fixed values.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "werden", "aus", "er", "hat", "dass", "sie", "nach"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are", "or", "his", "from", "at", "which", "but", "have", "an", "had", "they"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "más", "o", "pero", "sus", "le", "ha", "me", "si"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au", "sur", "ne", "se", "ce", "il", "sont", "la", "avec", "son", "elle"],
}
LANGUAGES = sorted(COMMON)
VOCABULARY = sorted({w for words in COMMON.values() for w in words})
MEMBERS = [[int(w in COMMON[lang]) for w in VOCABULARY] for lang in LANGUAGES]

#: Character classes as patterns; white space and the rest complete them.
CLASSES = [r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]"]


def _numbers(values) -> Column:
    """A constant array, as one literal after constant folding."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _common_ids(words: Column) -> Column:
    """Ids in VOCABULARY of the words that are in it: one hash look-up a word, then a comparison."""
    slots = 4096
    while len({xxhash.xxh64_intdigest(w.encode(), 42) % slots for w in VOCABULARY}) < len(VOCABULARY):
        slots += 1
    table = [-1] * slots
    for i, w in enumerate(VOCABULARY):  # xxhash64() is signed in Spark
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        table[(h - (1 << 64) if h >> 63 else h) % slots] = i
    at, known = _numbers(table), F.split(F.lit(" ".join(VOCABULARY)), " ")
    short = F.filter(words, lambda w: F.length(w) <= max(map(len, VOCABULARY)) + 2)
    plain = F.transform(short, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
    of = lambda w: F.get(at, F.pmod(F.xxhash64(w), F.lit(slots)))
    return F.filter(F.transform(plain, lambda w: F.when(F.get(known, of(w)) == w, of(w)).otherwise(F.lit(-1))), lambda i: i >= 0)


def _window(words: str, at: str) -> str:
    return f"{words}[{at}], {words}[{at} + 1], {words}[{at} + 2]"


def repeated_words(df: DataFrame, words: str, out: str, hashed: str = "xxhash64({})") -> DataFrame:
    """Adds the number of words that lie in a 3-word window found twice or more in array column ``words``.

    Windows are hashed, the low bits of a hash give way to the window's position, and equal hashes meet
    by sorting numbers; the words under the repeated windows follow from gaps between their positions. The words of windows
    that meet are compared, and if some differ the text's windows are sorted as the strings they are.
    """
    df = df.withColumn("_k", F.length(F.bin(F.size(words))).cast("int"))
    hash_of = hashed.format(_window(words, "i"))
    df = df.withColumn("_h", F.expr(f"case when size({words}) < 3 then cast(array() as array<bigint>) else transform(sequence(0, size({words}) - 3), i -> shiftleft(shiftright({hash_of}, _k), _k) | i) end"))
    df = df.withColumn("_s", F.sort_array("_h")).drop("_h")
    df = df.withColumn("_d", F.expr("filter(_s, (v, j) -> coalesce(shiftright(get(_s, j - 1), _k) = shiftright(v, _k), false) or coalesce(shiftright(get(_s, j + 1), _k) = shiftright(v, _k), false))")).drop("_s")
    df = df.withColumn("_q", F.expr("transform(_d, v -> cast(v & (shiftleft(1L, _k) - 1) as int))"))
    differ = f"{words}[_q[j - 1]] != {words}[_q[j]] or {words}[_q[j - 1] + 1] != {words}[_q[j] + 1] or {words}[_q[j - 1] + 2] != {words}[_q[j] + 2]"
    false_hit = f"exists(transform(_d, (v, j) -> j > 0 and shiftright(_d[j - 1], _k) = shiftright(v, _k) and ({differ})), x -> x)"
    plain = f"sort_array(transform(sequence(0, size({words}) - 3), i -> named_struct('w', concat_ws(' ', {_window(words, 'i')}), 'i', i)))"
    twice = "(z, j) -> coalesce(get(s, j - 1).w = z.w, false) or coalesce(get(s, j + 1).w = z.w, false)"
    exact = f"flatten(transform(array({plain}), s -> transform(filter(s, {twice}), z -> z.i)))"
    df = df.withColumn("_p", F.sort_array(F.expr(f"case when {false_hit} then {exact} else _q end"))).drop("_d", "_q")
    covered = "aggregate(zip_with(slice(_p, 1, size(_p) - 1), slice(_p, 2, size(_p) - 1), (a, b) -> least(b - a, 3)), 3L, (s, v) -> s + v)"
    return df.withColumn(out, F.expr(f"case when size(_p) < 1 then 0L when size(_p) = 1 then 3L else {covered} end")).drop("_p", "_k")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: id, lang, the base counts, ``classes`` (counts) and ``common`` (id and count of each common word)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("text"))
    df = df.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    df = df.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(WORD))))
    df = df.withColumn("spaces", F.regexp_count("text", F.lit(SPACE)))
    df = df.withColumn("ids", F.sort_array(_common_ids(F.col("words"))))
    df = df.withColumn("starts", F.expr("case when size(ids) = 0 then cast(array() as array<int>) else filter(sequence(0, size(ids) - 1), j -> j = 0 or get(ids, j) != get(ids, j - 1)) end"))
    counts = [F.regexp_count("text", F.lit(p)).cast("long") for p in CLASSES]
    df = df.select("id", "lang", "words", "ids", "starts", "spaces",
        F.size("words").cast("long").alias("n_words"), F.length("text").cast("long").alias("n_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.array(*counts).alias("counts"))
    df = repeated_words(df, "words", "n_repeat_words")
    common = F.expr("transform(starts, (p, t) -> named_struct('i', get(ids, p), 'n', coalesce(get(starts, t + 1), size(ids)) - p))")
    rest = F.col("n_chars") - F.col("spaces") - F.aggregate("counts", F.lit(0).cast("long"), lambda s, v: s + v)
    df = df.select("id", "lang", "n_words", (F.col("n_chars") - F.col("spaces")).alias("word_chars"), F.get("counts", F.lit(4)).alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.concat("counts", F.array(F.col("spaces").cast("long"), rest)).alias("classes"), common.alias("common"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def references(measured: DataFrame) -> DataFrame:
    """One row with array ``refs``: for each language of COMMON with a document, class shares and common-word shares."""
    sound = measured.filter(~F.col("base_failed") & F.col("lang").isin(LANGUAGES))
    shares = [F.sum(F.get("classes", F.lit(i))).cast("double").alias(f"c{i}") for i in range(len(CLASSES) + 2)]
    by_class = sound.groupBy("lang").agg(F.sum("n_words").alias("words"), *shares)
    total = sum((F.col(f"c{i}") for i in range(1, len(shares))), F.col("c0"))
    by_class = by_class.select("lang", "words", F.array(*[F.col(f"c{i}") / total for i in range(len(shares))]).alias("classes"))
    words = sound.select("lang", F.explode("common").alias("e")).groupBy("lang", F.col("e.i").alias("i")).agg(F.sum("e.n").alias("n"))
    by_word = words.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("found"))
    member = F.element_at(F.create_map(*[x for lang, row in zip(LANGUAGES, MEMBERS, strict=True) for x in (F.lit(lang), _numbers(row))]), F.col("lang"))
    both = by_class.join(by_word, "lang", "left").withColumn("member", member).withColumn("found", F.map_from_entries(F.coalesce("found", F.expr("cast(array() as array<struct<i:int,n:bigint>>)"))))
    both = both.select("lang", "classes", "member", F.expr(f"transform(sequence(0, {len(VOCABULARY) - 1}), i -> case when member[i] = 1 then coalesce(element_at(found, i), 0) / greatest(words, 1) else 0D end)").alias("common"))
    return both.agg(F.array_sort(F.collect_list(F.struct("lang", "classes", "member", "common"))).alias("refs"))


def _term(p: str, q: str) -> str:
    return f"((case when {p} > 0 then {p} * log2(2 * {p} / ({p} + {q})) else 0D end) + (case when {q} > 0 then {q} * log2(2 * {q} / ({p} + {q})) else 0D end)) / 2"


def judge(measured: DataFrame, refs: DataFrame, max_class: float = 0.26, max_common: float = 0.29, min_class_words: int = 50, min_common_words: int = 100) -> DataFrame:
    """measured with ``class_distance``, ``common_distance`` (of the language nearest in common words) and ``kept``."""
    df = measured.withColumn("refs", refs.select("refs").scalar())
    df = df.withColumn("n_chars", F.expr("greatest(aggregate(classes, 0L, (s, v) -> s + v), 1L)"))
    js_class = f"aggregate(zip_with(transform(classes, c -> c / n_chars), r.classes, (p, q) -> {_term('p', 'q')}), 0D, (s, v) -> s + v)"
    mine = "filter(common, e -> r.member[e.i] = 1)"
    acc = "aggregate(" + mine + ", named_struct('d', 0D, 'p', 0D, 'q', 0D), (s, e) -> named_struct('d', s.d + " + _term("(e.n / greatest(n_words, 1))", "r.common[e.i]") + ", 'p', s.p + e.n / greatest(n_words, 1), 'q', s.q + r.common[e.i]))"
    own = "aggregate(r.common, 0D, (s, v) -> s + v)"
    df = df.withColumn("by", F.expr(f"transform(refs, r -> named_struct('a', {acc}, 'own', {own}, 'c', {js_class}, 'lang', r.lang))"))
    js_common = "x.a.d + greatest(x.own - x.a.q, 0D) / 2 + " + _term("greatest(1 - x.a.p, 0D)", "greatest(1 - x.own, 0D)")
    df = df.withColumn("by", F.expr(f"transform(by, x -> named_struct('w', sqrt(greatest({js_common}, 0D)), 'c', sqrt(greatest(x.c, 0D)), 'lang', x.lang))"))
    near = f"(n_words < {min_class_words} or x.c <= {max_class}) and (n_words < {min_common_words} or x.w <= {max_common})"
    sound = F.expr(f"size(by) = 0 or exists(by, x -> {near})")
    best = F.array_min("by")
    return df.select(*measured.columns, best["c"].alias("class_distance"), best["w"].alias("common_distance"), best["lang"].alias("nearest"), (~F.col("base_failed") & sound).alias("kept"))


def quality(docs: DataFrame, **limits) -> DataFrame:
    """measure() of the whole table, cut once, and judged against references() of the same."""
    measured = cut(measure(docs))
    return judge(measured, references(measured), **limits)


def op7(spark, sf_dir: str) -> DataFrame:
    judged = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """op7 in SQL: the base counts, the references and both distances."""
    member = ", ".join(f"('{lang}', '{w}')" for lang in LANGUAGES for w in dict.fromkeys(COMMON[lang]))
    classes = ", ".join(f"len(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}'))" for p in CLASSES)
    widest = max(map(len, VOCABULARY)) + 2
    term = lambda p, q: f"((CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END) + (CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END)) / 2"
    return rf"""
WITH member(lang, word) AS (VALUES {member}),
docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines, len(regexp_extract_all(t, '{SPACE}')) AS spaces, [{classes}] AS counts FROM docs),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM split),
triples AS (SELECT r, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS n FROM triples WHERE z IS NOT NULL),
covered AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM windows WHERE n > 1) GROUP BY 1),
base AS (SELECT split.r, doc_id, lang, len(w)::BIGINT AS n_words, (length(t) - spaces)::BIGINT AS word_chars, counts[5]::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
  list_concat(counts, [spaces, length(t) - spaces - list_sum(counts)])::BIGINT[] AS classes, greatest(length(t), 1)::DOUBLE AS n_chars FROM split LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
said AS (SELECT r, lower(rtrim(x, '.,;:!?')) AS word, count(*) AS n FROM words WHERE length(x) <= {widest} GROUP BY 1, 2),
sound AS (SELECT * FROM judged WHERE NOT base_failed AND lang IN (SELECT lang FROM member)),
totals AS (SELECT lang, sum(n_words) AS n FROM sound GROUP BY 1),
class_refs AS (SELECT lang, i, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM (SELECT lang, unnest(classes) AS c, generate_subscripts(classes, 1) AS i FROM sound) GROUP BY 1, 2),
word_refs AS (SELECT m.lang, m.word, coalesce(f.n, 0) / totals.n AS q FROM member m JOIN totals USING (lang) LEFT JOIN (SELECT lang, word, sum(n) AS n FROM sound JOIN said USING (r) GROUP BY 1, 2) f ON f.lang = m.lang AND f.word = m.word),
own AS (SELECT lang, sum(q)::DOUBLE AS own FROM word_refs GROUP BY 1),
by_class AS (SELECT j.r, c.lang, sqrt(greatest(sum({term('(classes[i] / n_chars)', 'q')}), 0)) AS c FROM judged j, class_refs c GROUP BY 1, 2),
by_word AS (SELECT s.r, f.lang, sum({term('(s.n / j.n_words)', 'f.q')}) AS d, sum(s.n / j.n_words) AS p, sum(f.q) AS q FROM said s JOIN judged j USING (r) JOIN word_refs f USING (word) GROUP BY 1, 2),
near AS (SELECT j.r, b.lang, b.c, coalesce(d, 0) + greatest(own - coalesce(q, 0), 0) / 2 + {term('greatest(1 - coalesce(p, 0), 0)', 'greatest(1 - own, 0)')} AS w FROM judged j JOIN by_class b USING (r) JOIN own ON own.lang = b.lang LEFT JOIN by_word v ON v.r = j.r AND v.lang = b.lang),
fits AS (SELECT DISTINCT near.r FROM near JOIN judged USING (r) WHERE (n_words < 50 OR c <= 0.26) AND (n_words < 100 OR sqrt(greatest(w, 0)) <= 0.29))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (r IN (SELECT r FROM fits) OR NOT EXISTS (SELECT 1 FROM totals)) AS kept FROM judged
"""


SQL = _sql()
