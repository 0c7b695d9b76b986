"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets integer features from its whole text; each rule's metric
is a ratio scaled to an integer. A sketch per (language, source, metric) is a
set of counters over logarithmic bins with 32 steps per doubling (a relative
error of at most 1/32): counters add up, so sketches of parts merge exactly,
in any order, and repeated runs give the same thresholds. The upper fence
``q75 + spread * (q75 - q25)``, but at least the rule's floor, replaces a fixed
cutoff. A source with few documents takes the merged sketch of its language,
a language with few documents that of the corpus.

Defined cases: null text is the empty text (no words, fails the base rules);
null language or source is a group of its own; repeated rows are judged each;
an empty table gives an empty result; columns named like a feature are replaced
by the feature, all other columns but the text are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewatt.llm.common import materialize, pipeline_stage

SYMBOLS = r"[#*$%&|<>]"
SPACES = r"[ \t-\r]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
POS_BITS = 27
STEP_BITS = 5
MIN_GROUP = 200
SPREAD = 3
#: Metric -> floor of its fence: a rule never rejects below it.
RULES = {
    "symbol_rate": 500,        # symbols per 10,000 characters of words
    "dup_line_rate": 3000,     # repeated lines per 10,000 lines with a word
    "repeat_rate": 3000,       # words in repeated 3-word windows per 10,000 words
    "word_length": 1500,       # characters per 100 words
}


def _repeat_words(words: str) -> list[tuple[str, str]]:
    """SQL steps: packed (hash, position) of each 3-word window, sorted; the
    repeated ones' positions; words that they cover.

    Neighbours of equal hash bits are compared by their words, so a hash
    collision never counts (packed values are below 2**62: no overflow).
    """
    m = (1 << POS_BITS) - 1
    close = f"(x - get(__packed, i - 1) <= {m} or get(__packed, i + 1) - x <= {m})"
    same = " or ".join("(" + " and ".join(
        f"get({words}, cast(x & {m} as int) + {j}) = get({words}, cast(get(__packed, i + {d}) & {m} as int) + {j})"
        for j in range(3)) + ")" for d in (-1, 1, -2, 2))
    return [
        ("__packed", f"""sort_array(slice(transform({words}, (one, i) -> shiftleft(
            xxhash64(one, get({words}, i + 1), get({words}, i + 2)) & {(1 << 62 - POS_BITS) - 1}, {POS_BITS}) | i),
            1, greatest(size({words}) - 2, 0)))"""),
        ("__starts", f"sort_array(transform(filter(__packed, (x, i) -> {close} and ({same})), x -> x & {m}))"),
        ("n_repeat_words", """aggregate(__starts, named_struct('last', -3L, 'n', 0L),
            (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last)), a -> a.n)"""),
    ]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of the whole text, beside the columns of ``docs``."""
    t = F.coalesce(F.col("__text"), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    carried = [c for c in docs.columns if c.lower() not in names and c.lower() != text.lower()]
    df = docs.select(*carried, F.col(text).alias("__text"))
    df = df.withColumns({
        "__words": F.array_remove(F.split(t, SPACES), ""),
        "__lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
        "n_symbols": (F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
    })
    for name, sql in _repeat_words("__words"):
        df = df.withColumn(name, F.expr(sql))
    return df.select(
        *carried, F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"), "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words")


def _ratio(a: str, b: str, scale: int) -> Column:
    return F.when(F.col(b) > 0, F.expr(f"({a} * {scale}L) div {b}")).otherwise(F.lit(0)).cast("long")


def metrics() -> dict[str, Column]:
    return {"symbol_rate": _ratio("n_symbols", "word_chars", 10_000),
            "dup_line_rate": _ratio("n_dup_lines", "n_lines", 10_000),
            "repeat_rate": _ratio("n_repeat_words", "n_words", 10_000),
            "word_length": _ratio("word_chars", "n_words", 100)}


def _bin(v: str) -> Column:
    """Bin of a value: exact below 2**STEP_BITS, then 2**STEP_BITS bins per doubling."""
    s = STEP_BITS
    return F.expr(f"""case when {v} < {1 << s} then {v} else (length(bin({v})) - {s}) * {1 << s}
        + shiftright({v}, length(bin({v})) - {s + 1}) - {1 << s} end""").cast("long")


def _bin_value(b: str) -> Column:
    s = STEP_BITS
    return F.expr(f"""case when {b} < {1 << s} then {b}
        else shiftleft({1 << s}L + {b} % {1 << s}, cast({b} div {1 << s} as int) - 1) end""").cast("long")


def sketches(feats: DataFrame, by: list[str]) -> DataFrame:
    """One counter per group, metric and occupied bin (a few hundred bins at most)."""
    kv = F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in RULES]), F.array(*[F.col(m) for m in RULES])))
    return (feats.select(*by, kv.alias("metric", "value")).withColumn("bin", _bin("value"))
            .groupBy(*by, "metric", "bin").agg(F.count("*").alias("n")))


def merge(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Per group: documents seen and one upper fence per metric (columns ``fence_*``)."""
    g = Window.partitionBy(*by, "metric")
    run = sketch.withColumns({"total": F.sum("n").over(g),
                              "below": F.sum("n").over(g.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))})
    at = lambda q: F.min(F.when(F.col("below") * 4 >= F.col("total") * q, F.col("bin")))
    q = run.groupBy(*by, "metric").agg(at(1).alias("b25"), at(3).alias("b75"), F.max("total").alias("total"))
    q = q.withColumns({"q25": _bin_value("b25"), "q75": _bin_value("b75")})
    fence = F.col("q75") + SPREAD * (F.col("q75") - F.col("q25"))
    return q.groupBy(*by).agg(F.max("total").alias("total"), *[
        F.greatest(F.max(F.when(F.col("metric") == m, fence)), F.lit(floor).cast("long")).alias(f"fence_{m}")
        for m, floor in RULES.items()])


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                  min_group: int = MIN_GROUP) -> DataFrame:
    """Judge every row of ``docs``; adds features, ``base_failed`` and ``kept``.

    Sketches learn from the documents that pass the base rules. Features are
    written once; the fences (one row per group) are joined by language and
    source, which the planner broadcasts only below its own size limit and
    otherwise joins by shuffling with skew splitting.
    """
    own = ["__lang", "__source"]
    base = features(docs.withColumns({"__lang": F.coalesce(F.concat(F.lit("="), lang), F.lit("")),
                                      "__source": F.coalesce(F.concat(F.lit("="), source), F.lit(""))}), text)
    base = base.withColumns(metrics()).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    table = materialize(base, "quality")
    fine = materialize(sketches(table.filter(~F.col("base_failed")), own), "sketch")
    by_lang = merge(fine, ["__lang"])
    rules = [f"fence_{m}" for m in RULES]
    whole = fences(merge(by_lang, []), [])
    mid = fences(by_lang, ["__lang"])
    f = (fences(fine, own).alias("f").join(mid.alias("m"), "__lang")
         .select(*own, *[F.when(F.col("f.total") >= min_group, F.col(f"f.{r}")).when(
             F.col("m.total") >= min_group, F.col(f"m.{r}")).alias(r) for r in rules]))
    top = whole.agg(F.to_json(F.max(F.struct(*rules))).alias("j")).first()["j"]  # four numbers
    f = f.withColumn("__top", F.from_json(F.lit(top or "{}"), ", ".join(f"{r} long" for r in rules)))
    f = f.select(*own, *[F.coalesce(F.col(r), F.col(f"__top.{r}")).alias(r) for r in rules])
    judged = table.join(f, own, "left")
    passes = ~F.col("base_failed")
    for m in RULES:
        passes = passes & F.coalesce(F.col(m) <= F.col(f"fence_{m}"), F.lit(True))
    return judged.withColumn("kept", passes).drop(*own)


def op1(spark, sf_dir: str) -> DataFrame:
    from sitewatt.llm.common import documents
    out = quality_rules(documents(spark, sf_dir).select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@pipeline_stage
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go."""
    out = quality_rules(docs.withColumn("__text_kept", F.col("text")))
    return out.filter("kept").select(*[F.col("__text_kept").alias(c) if c == "text" else F.col(c) for c in docs.columns])


_BINS = f"""CASE WHEN v < {1 << STEP_BITS} THEN v ELSE (length(bin(v)) - {STEP_BITS}) * {1 << STEP_BITS}
    + (v >> (length(bin(v)) - {STEP_BITS + 1})) - {1 << STEP_BITS} END"""
_VALUE = f"""CASE WHEN {{b}} < {1 << STEP_BITS} THEN {{b}} ELSE ({1 << STEP_BITS} + {{b}} % {1 << STEP_BITS}) << CAST({{b}} // {1 << STEP_BITS} - 1 AS INT) END"""

#: The judged documents as a chain of DuckDB CTEs; the last is ``judged``.
JUDGED_SQL = f"""
toks AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {{docs}}),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM toks WHERE len(w) >= 3)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM toks)
    WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
feat AS (SELECT k.doc_id, k.lang, k.source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM toks k LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
met AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols * 10000 // word_chars ELSE 0 END AS symbol_rate,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines ELSE 0 END AS dup_line_rate,
    CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words ELSE 0 END AS repeat_rate,
    CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS word_length FROM feat),
long AS (SELECT lang, source, m, v FROM met UNPIVOT (v FOR m IN ({', '.join(RULES)})) WHERE NOT base_failed),
bins AS (SELECT lang, source, m, {_BINS} AS b FROM long),
lev AS (SELECT 1 AS level, lang, source, m, b FROM bins UNION ALL SELECT 2, lang, NULL, m, b FROM bins
    UNION ALL SELECT 3, NULL, NULL, m, b FROM bins),
cnt AS (SELECT level, lang, source, m, b, count(*) AS c FROM lev GROUP BY level, lang, source, m, b),
cum AS (SELECT level, lang, source, m, b, sum(c) OVER (PARTITION BY level, lang, source, m ORDER BY b) AS below,
    sum(c) OVER (PARTITION BY level, lang, source, m) AS total FROM cnt),
quart AS (SELECT level, lang, source, m, max(total) AS total, min(CASE WHEN below * 4 >= total THEN b END) AS b25,
    min(CASE WHEN below * 4 >= total * 3 THEN b END) AS b75 FROM cum GROUP BY level, lang, source, m),
fence AS (SELECT level, lang, source, m, total, greatest(q75 + {SPREAD} * (q75 - q25),
    CASE m {' '.join(f"WHEN '{m}' THEN {v}" for m, v in RULES.items())} END) AS f
    FROM (SELECT *, {_VALUE.format(b='b25')} AS q25, {_VALUE.format(b='b75')} AS q75 FROM quart)),
judged AS (SELECT t.*, NOT base_failed AND {' AND '.join(
    f'''coalesce({m} <= coalesce((SELECT f FROM fence x WHERE x.level = 1 AND x.m = '{m}' AND x.total >= {MIN_GROUP}
        AND x.lang IS NOT DISTINCT FROM t.lang AND x.source IS NOT DISTINCT FROM t.source),
      (SELECT f FROM fence x WHERE x.level = 2 AND x.m = '{m}' AND x.total >= {MIN_GROUP} AND x.lang IS NOT DISTINCT FROM t.lang),
      (SELECT f FROM fence x WHERE x.level = 3 AND x.m = '{m}')), true)''' for m in RULES)} AS kept FROM met t)
"""
SQL = ("WITH " + JUDGED_SQL.format(docs="documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged""")
