"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule is a Boolean expression over a text's statistics, true where the text is rejected.  On a
sample of at most SAMPLE_ROWS documents every rule is run by itself: its time over that of a constant
is its cost, the share that it rejects its selectivity.  Rules run in the order of rejection per cost,
as branches of one CASE, so a document meets no rule behind the one that rejects it.  The verdict
doesn't depend on the order.

Defined cases: a null text has no words and is rejected for that; repeated rows give repeated rows;
an empty table gives no rows (and the rules stay in their given order); columns of the input with the
names of statistics are hidden by an own struct and come back unharmed.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACE, saved, table

#: Rows on which costs and selectivities are estimated; verdicts don't depend on them.
SAMPLE_ROWS = 2_000
SYMBOLS = "#*$%&|<>"

_SPLIT = "[\\x20\\x09-\\x0D]+"


def _size(c: Column) -> Column:
    return F.size(c).cast("long")


def with_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Two columns: row, the input's row as a struct, and s, a struct of its text's statistics.

    s has words, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_chars.
    Each step is used more than once by the next, which keeps Spark from computing it twice.
    """
    spaces = F.lit(SPACE)
    a = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    trimmed = F.btrim("t", spaces)
    a = a.withColumn("w", F.split(trimmed, _SPLIT))
    a = a.withColumns(
        {
            "n": F.when((F.size("w") == 1) & (F.element_at("w", 1) == ""), 0).otherwise(F.size("w")),
            "lines": F.filter(F.split("t", "\n"), lambda x: F.btrim(x, spaces) != ""),
        }
    )
    # Hashes of 3-word windows; the two at the end lack words and are cut off.
    pairs = F.zip_with("w", F.slice("w", 2, F.size("w")), lambda x, y: F.xxhash64(x, y))
    triples = F.zip_with(pairs, F.slice("w", 3, F.size("w")), lambda x, y: F.xxhash64(x, y))
    a = a.withColumn("g", F.when(F.col("n") >= 3, F.slice(triples, 1, F.col("n") - 2)))
    # Windows in the order of their hashes, for texts that repeat any; neighbours that agree are repeats.
    a = a.withColumn("o", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.filter(F.zip_with("o", F.slice("o", 2, F.size("o")), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda p: p.isNotNull())
    a = a.withColumn("p", F.array_sort(F.array_distinct(F.flatten(same))))
    # Each window covers three words, or as many as come before the next repeated window.
    steps = F.zip_with("p", F.slice("p", 2, F.size("p")), lambda x, y: F.coalesce(F.least(F.lit(3), y - x), F.lit(3)))
    repeats = F.coalesce(F.aggregate(steps, F.lit(0), lambda total, x: total + x), F.lit(0))
    stats = F.struct(
        F.col("w").alias("words"),
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _size(F.col("lines")).alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.col("t").alias("text"),
    )
    return a.select("row", stats.alias("s"))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once, and only where the whole is."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeat_words(w: Column, n: Column) -> Column:
    """n_repeat_words as an expression of its own, for a branch that most rows may not reach."""
    pairs = F.zip_with(w, F.slice(w, 2, F.size(w)), lambda x, y: F.xxhash64(x, y))
    grams = F.slice(F.zip_with(pairs, F.slice(w, 3, F.size(w)), lambda x, y: F.xxhash64(x, y)), 1, F.greatest(n - 2, F.lit(0)))

    def covered(o: Column) -> Column:
        same = F.filter(F.zip_with(o, F.slice(o, 2, F.size(o)), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda p: p.isNotNull())
        steps = lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.coalesce(F.least(F.lit(3), y - x), F.lit(3)))
        return _let(F.array_sort(F.array_distinct(F.flatten(same))), lambda p: F.aggregate(steps(p), F.lit(0), lambda total, x: total + x))

    in_order = lambda g: F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _let(in_order(g), covered)).otherwise(F.lit(0)))


def lazy_rules(t: Column, w: Column, n: Column) -> dict[str, Column]:
    """The base rule's count and the method's rules on a text, its words and their number, each with its own statistics.

    The base rule on repeated windows is weaker than the method's, so it needs no branch.
    """
    text = F.length(t)
    letters = F.length(F.array_join(w, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return {
        "few_words": n < 50,
        "symbols": 10 * (text - F.length(F.translate(t, SYMBOLS, ""))) > n,
        "duplicate_lines": _let(lines, lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > 40 * F.size(x)),
        "word_length": _let(letters, lambda c: (c < 3 * n) | (c > 10 * n)),
        "repeated_windows": 100 * _repeat_words(w, n) > 35 * n,
        "wordless": 100 * F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))) < 70 * n,
        "capitals": 100 * (text - F.length(F.regexp_replace(t, "\\p{Lu}", ""))) > 30 * text,
        "few_distinct": 100 * F.size(F.array_distinct(w)) < 15 * n,
    }


def base_failed(s: str = "s") -> Column:
    n = F.col(f"{s}.n_words")
    return (n < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * n)


def rules(s: str = "s") -> dict[str, Column]:
    """The method's rules: true rejects."""
    c = lambda x: F.col(f"{s}.{x}")
    n, chars = c("n_words"), F.length(c("text"))
    return {
        "symbols": 10 * c("n_symbols") > n,
        "duplicate_lines": 100 * c("n_dup_lines") > 40 * c("n_lines"),
        "word_length": (c("word_chars") < 3 * n) | (c("word_chars") > 10 * n),
        "repeated_windows": 100 * c("n_repeat_words") > 35 * n,
        "wordless": 100 * F.size(F.filter(c("words"), lambda w: w.rlike("\\p{L}"))) < 70 * n,
        "capitals": 100 * (chars - F.length(F.regexp_replace(c("text"), "\\p{Lu}", ""))) > 30 * chars,
        "few_distinct": 100 * F.size(F.array_distinct(c("words"))) < 15 * n,
    }


def estimate(stats: DataFrame, checks: dict[str, Column], rows: int = SAMPLE_ROWS, seed: int = 1) -> list[dict]:
    """name, cost (seconds over a constant's), rejects (share of the sample), best first."""
    total = stats.count()
    if not total:
        return [{"name": k, "cost": 0.0, "rejects": 0.0} for k in checks]
    sample = saved(stats.sample(min(1.0, 1.2 * rows / total), seed).limit(rows))

    def run(c: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = sample.agg(F.avg(F.coalesce(c, F.lit(False)).cast("int"))).first()[0]
        return time.perf_counter() - began, share or 0.0

    run(F.lit(True))
    least = run(F.lit(True))[0]
    found = []
    for k, c in checks.items():
        seconds, share = run(c)
        found.append({"name": k, "cost": max(seconds - least, 1e-3), "rejects": share})
    return sorted(found, key=lambda x: -x["rejects"] / x["cost"])


def verdict(checks: dict[str, Column], order: list[str]) -> Column:
    """False at the first rule that rejects, true behind all."""
    out = F.when(base_failed(), False)
    for k in order:
        out = out.when(checks[k], False)
    return out.otherwise(True)


def judged(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """row, s (see with_stats) and kept."""
    checks = rules()
    stats = with_stats(df, text_col)
    total = df.count()
    sample = with_stats(saved(df.select(F.col(f"`{text_col}`").alias("text")).sample(min(1.0, 1.2 * sample_rows / max(1, total)), 1).limit(sample_rows)))
    order = [x["name"] for x in estimate(sample, checks, sample_rows)]
    return stats.withColumn("kept", verdict(checks, order))


def kept_only(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that no rule rejects, with its own columns: the verdicts of judged().

    Only the words are split for all; each rule's statistics are computed in its own branch, so a text that a cheap
    rule rejects has no windows made or sorted.  The condition on a row's number, which always holds, keeps Spark
    from moving the filter below the split, where each rule would split the words again.
    """

    def split(df: DataFrame, text: Column) -> DataFrame:
        a = df.withColumn("t", F.coalesce(text.cast("string"), F.lit(""))).withColumn("w", F.split(F.btrim("t", F.lit(SPACE)), _SPLIT))
        return a.withColumn("n", F.when((F.size("w") == 1) & (F.element_at("w", 1) == ""), 0).otherwise(F.size("w")))

    checks = lazy_rules(F.col("t"), F.col("w"), F.col("n"))
    total = df.count()
    sample = saved(df.select(F.col(f"`{text_col}`").alias("x")).sample(min(1.0, 1.2 * SAMPLE_ROWS / max(1, total)), 1).limit(SAMPLE_ROWS))
    order = [x["name"] for x in estimate(split(sample, F.col("x")), checks)]
    rows = split(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").alias("x")), F.col("x"))
    kept = F.lit(True)
    for k in reversed(order):
        kept = F.when(checks[k], False).otherwise(kept)
    return rows.select("row", F.when(F.monotonically_increasing_id() >= 0, kept).alias("kept")).where("kept").select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", *[f"s.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed().alias("base_failed"), "kept")


OP7_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
spots as (select rid, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3),
windows as (select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as times from spots),
steps as (select rid, least(3, coalesce(lead(i) over (partition by rid order by i) - i, 3)) as covered from windows where times > 1),
reps as (select rid, sum(covered)::bigint as n_repeat_words from steps group by rid),
s as (
  select doc_id, t, w, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
         coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join reps using (rid)),
f as (select *, len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
             n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > n_words or 100 * n_dup_lines > 40 * n_lines
            or word_chars < 3 * n_words or word_chars > 10 * n_words or 100 * n_repeat_words > 35 * n_words
            or 100 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 70 * n_words
            or 100 * (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g'))) > 30 * length(t)
            or 100 * len(list_distinct(w)) < 15 * n_words) as kept
from f
"""
