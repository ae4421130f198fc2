"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every measure is an expression over one row, so the plan is scan -> project with no shuffle and no Python. Windows of
five words are compared by 64-bit hash inside one text; two different windows of a text of n words share a hash with
probability below n*n / 2**65.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD, let, texts

# Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was be as with by this are at from or an not have he she they we you "
    "der die das und von zu den mit sich ist ein eine nicht auf im des dem für auch "
    "de la le les et des en un une que qui dans pour pas sur du au est ce avec elle "
    "el los las y se del por con no es su una lo para como más"
).split()
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; a bound of None is open."""

    measure: str
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        m = F.col(self.measure)
        tests = [m < F.lit(self.low)] * (self.low is not None) + [m > F.lit(self.high)] * (self.high is not None)
        return tests[0] | tests[1] if len(tests) == 2 else tests[0]

    def sql(self) -> str:
        return " OR ".join([f"{self.measure} < {self.low}"] * (self.low is not None) + [f"{self.measure} > {self.high}"] * (self.high is not None))


#: The production table; measures are those of :func:`measures`.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=2, high=16),
    Rule("symbol_ratio", high=0.3),
    Rule("stop_word_ratio", low=0.01),
    Rule("dup_line_ratio", high=0.4),
    Rule("repeat_word_ratio", high=0.2),
)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of width words that occur twice or more in the array, first occurrences included."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        def of(windows: Column) -> Column:
            ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
            again = let(ordered, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
            # each position covers width words, less what the next one covers again
            count = let(
                F.sort_array(F.transform(again, lambda x: x["p"])),
                lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x),
            )
            return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(count)

        return let(F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, width))), of)

    return F.when(n <= width, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), covered))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the ratios of each text; ratios of a text without words are 0."""
    t = texts(docs).withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD))
    counted = t.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("different"))).alias("lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.col("lines.all") - F.col("lines.different")).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "n_stop_words",
        share(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        share(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        share(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_ratio"),
        share(F.col("lines.all") - F.col("lines.different"), F.col("lines.all")).alias("dup_line_ratio"),
        share(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_word_ratio"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measures() with failed (the measures whose rule failed, in the table's order) and kept (none failed).

    A null or empty text has no words and fails the first rule; repeated rows get equal verdicts.
    """
    failed = F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.measure)) for r in rules])) if rules else F.array().cast("array<string>")
    return measures(docs).withColumn("failed", failed).withColumn("kept", F.size("failed") == 0)


# DuckDB for the same; the thresholds come from the table.
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, list_slice(words, i, i + {WINDOW - 1}) AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) > {WINDOW})),
rep AS (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM
        (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM rep GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
  length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
r AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
  CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
  CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_word_ratio,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
  CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_word_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR {" OR ".join(r.sql() for r in RULES)}) AS kept FROM r
"""
