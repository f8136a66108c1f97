"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression of the text and every rule a bound on a measure, so a document is judged where it
is read: no exchange, no join, no Python.

Defined results:
* null text, empty text, white space only: no words, every count 0, every ratio 0; such a document fails ``min_words``;
* repeated rows are judged one by one, each like the other; an empty table gives an empty table;
* very long texts are one row of work in proportion to their length;
* columns of the input are kept, whatever their names: the measures are one struct column with a free name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import fresh, let, quoted, words_of

#: Function words of the languages the rules know. A text without any of them is a list, a menu or noise.
STOP_WORDS = (
    "the of and a to in for is that it with was on by as this be at are from or an not which but have had "
    "de la le et les des en un du une que est pour qui dans au par sur pas avec "
    "der die und den von zu das sich mit auf für nicht im ist dem ein eine als "
    "el los las y se del por con no una su para es al lo"
).split()

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= measure <= high``; a missing bound does not bind."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are per word or per line with a word.
RULES = (
    Rule("min_words", "n_words", low=20),
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("exclamations", "exclamation_ratio", high=0.3),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("stutter", "stutter_ratio", high=0.25),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("line_length", "words_per_line", low=1.5),
    Rule("repeated_windows", "repeat_ratio", high=0.3),
)

WINDOW = 8


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more in the array of window hashes."""
    marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        def repeats(x: Column, j: Column) -> Column:
            near = lambda k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return near(j - 1) | near(j + 1)

        return F.sort_array(F.transform(F.filter(s, repeats), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        let(marked, twice), start,
        lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"), (p + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text. Windows are compared by 64-bit hashes,
    made by doubling: of one word, of two, of four, of eight."""

    def of_windows(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w))

    def doubled(step: int, body: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda h: let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))), body)

    def complete(h: Column) -> Column:
        return let(F.slice(h, F.lit(1), F.size(h) - (WINDOW - 1)), of_windows)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, doubled(1, doubled(2, doubled(4, complete)))))


def measures(text: Column) -> Column:
    """One struct with every count and ratio of a text. Each count is made once, the ratios from the counts."""
    text = F.coalesce(text, F.lit(""))
    stops = list(dict.fromkeys(STOP_WORDS))

    def counted(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(F.filter(words, lambda w: F.lower(w).isin(stops))).alias("n_stop"),
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(lines).alias("n_lines"),
            (F.length(text) - F.length(_without(text, "!"))).alias("n_exclaimed"),
            F.size(F.filter(words, lambda w, i: F.coalesce(w == F.get(words, i - 1), F.lit(False)))).alias("n_stutter"),
        )

    def with_ratios(c: Column) -> Column:
        ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        n = c["n_words"]
        return F.struct(
            *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            ratio(c["word_chars"], n).alias("mean_word_chars"), ratio(c["n_symbols"], n).alias("symbol_ratio"),
            ratio(c["n_exclaimed"], n).alias("exclamation_ratio"), ratio(c["n_stop"], n).alias("stop_ratio"),
            ratio(c["n_stutter"], n).alias("stutter_ratio"), ratio(c["n_dup_lines"], c["n_lines"]).alias("dup_line_ratio"),
            ratio(n, c["n_lines"]).alias("words_per_line"), ratio(c["n_repeat_words"], n).alias("repeat_ratio"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    split = F.struct(words_of(text).alias("w"), lines.alias("l"))
    return let(let(split, lambda x: counted(x["w"], x["l"])), with_ratios)


def verdict(measured: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules a document breaks; empty if it passes."""
    broken = []
    for r in rules:
        value = measured[r.measure]
        fails = F.lit(False)
        if r.low is not None:
            fails = fails | (value < F.lit(r.low))
        if r.high is not None:
            fails = fails | (value > F.lit(r.high))
        broken.append(F.when(fails, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with a struct of measures and an array of broken rules; also the names of these two columns."""
    m = fresh(docs.columns, "quality")
    b = fresh([*docs.columns, m], "broken_rules")
    measured = docs.withColumn(m, measures(quoted(text_col)))
    return measured.withColumn(b, verdict(F.col(m), rules)), m, b


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that break no rule, with the columns they came with."""
    # One expression: as columns, the measures would be made anew for every rule when the filter moves below them.
    broken = let(measures(quoted(text_col)), lambda m: verdict(m, rules))
    return docs.where(F.size(broken) == 0)
