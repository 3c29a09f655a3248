"""Line-first quality cleaning, in DataFrame expressions only.

Every line is judged by rules first; failing lines are removed; a document is rejected when too much of its text went
with them, or when its word statistics fail.

Defined results: a null text counts as empty (no words, so rejected); an empty text likewise; lines without a word are
neither judged nor counted as loss; repeated rows are judged alike, each on its own; tables without rows give no rows; a
very long text is one row of its task; of a line's failed rules the first counts. judge reads the id and text columns
alone; keep_clean passes on all others, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import SPACE, column, fresh, let

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Fixed phrases of navigation and legal boilerplate; a line that is short and holds one fails.
BOILERPLATE = (
    "cookie policy|privacy policy|terms of use|terms of service|all rights reserved|enable javascript|"
    "sign in|log in|subscribe to our newsletter|skip to content|click here|read more|copyright \\(c\\)|©"
)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document is rejected when failing lines hold more than this share of its word characters.
MAX_LOST_PERCENT = 50


def count_of(text: Column, chars: str) -> Column:
    """Characters of text in the class chars (a Java character class without brackets)."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def word_chars(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more in the list. Windows are compared by 64-bit hash."""

    def covered(windows: Column) -> Column:
        n = F.size(windows)

        def of_sorted(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            at = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(s, i)["p"]))
            start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
            step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n"))
            return F.aggregate(at, start, step, lambda acc: acc["n"])

        placed = F.sort_array(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0).cast("long")).otherwise(let(placed, of_sorted))

    def of_hashes(h: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])
        return let(F.transform(F.sequence(F.lit(0), F.size(h) - 5), window), covered)

    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def line_verdict(line: Column) -> Column:
    """The rule that a line with words fails, or null: symbols, shouting, navigation, boilerplate or punctuation."""
    n_words = F.size(words_of(line))
    bare = F.regexp_replace(line, rf"[{SPACE}]+$", "")
    few = F.length(line) < 120
    letters = count_of(line, r"\p{L}")
    return (
        F.when(count_of(line, SYMBOLS) * 100 > 15 * word_chars(line), "symbols")
        .when(F.regexp_count(line, F.lit(r"\|")) * 3 >= n_words, "navigation")
        .when((letters >= 8) & (count_of(line, r"\p{Lu}") * 10 > 7 * letters) & (F.regexp_count(line, F.lit("!!")) > 0), "shouting")
        .when(few & F.lower(line).rlike(BOILERPLATE), "boilerplate")
        .when(~bare.rlike(r"[.!?:;,\"'”’»)\]…。！？]$"), "punctuation")
    )


def quality(text: Column) -> Column:
    """A struct of the word statistics, the cleaned text and the verdict of one text."""

    def of_text(t: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            judged = F.transform(lines, lambda x: F.struct(x.alias("line"), line_verdict(x).alias("rule"), word_chars(x).alias("size")))
            return let(judged, lambda j: of_judged(lines, j))

        def of_judged(lines: Column, j: Column) -> Column:
            total = F.aggregate(j, F.lit(0).cast("long"), lambda a, x: a + x["size"])
            lost = F.aggregate(F.filter(j, lambda x: x["rule"].isNotNull()), F.lit(0).cast("long"), lambda a, x: a + x["size"])
            kept = F.filter(j, lambda x: x["rule"].isNull())
            return F.struct(
                total.alias("word_chars"),
                lost.alias("lost_chars"),
                F.size(F.filter(j, lambda x: x["rule"].isNotNull())).cast("long").alias("n_lines_removed"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("cleaned_text"),
            )

        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
        words = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
        return F.struct(words.alias("w"), let(lines, of_lines).alias("l"), count_of(t, SYMBOLS).alias("n_symbols"))

    return let(F.coalesce(text, F.lit("")), of_text)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: word statistics, base_failed, kept, what the lines lost and the cleaned text."""
    q = docs.select(F.col(id_col).alias("doc_id"), quality(F.col(text_col)).alias("q"))
    q = q.select("doc_id", "q.w.n_words", "q.l.word_chars", "q.n_symbols", "q.l.n_dup_lines", "q.w.n_repeat_words", "q.l.n_lines_removed", "q.l.lost_chars", "q.l.cleaned_text")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return q.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST_PERCENT))


def keep_clean(docs: DataFrame) -> DataFrame:
    """documents without the rejected ones; the others carry their cleaned text. Columns stay as they are."""
    names = docs.columns
    (q,) = fresh(docs, "quality")
    d = docs.withColumn(q, F.explode(F.array(quality(F.col("text")))))  # a generator keeps the filter from evaluating it again
    w, c, lost = F.col(f"{q}.w.n_words"), F.col(f"{q}.l.word_chars"), F.col(f"{q}.l.lost_chars")
    ok = (w >= MIN_WORDS) & (F.col(f"{q}.w.n_repeat_words") * 100 <= w * MAX_REPEAT_PERCENT) & (lost * 100 <= c * MAX_LOST_PERCENT)
    text = F.when(F.col(f"{q}.l.n_lines_removed") > 0, F.col(f"{q}.l.cleaned_text")).otherwise(F.col("text"))
    new = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in names else {})
    return d.filter(ok).select(*[new[n].alias(n) if n in new else column(n) for n in names])
