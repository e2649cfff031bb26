"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how often each
is right on good and on bad documents, and the posterior probability of good decides, not all-must-pass.

Everything runs as DataFrame functions. The only thing brought to the driver is the count of each vote pattern,
at most 3 ** len(RULES) rows whatever the input.

Defined results: a null or empty text has no words, all counts 0 and fails the base; a doc_id may be null or repeat,
each row is judged by itself; an empty table gives an empty result; extra columns are kept by filter_documents()
and ignored by score(); very long texts are judged whole (work grows as words times their logarithm); a posterior of exactly
KEEP_AT keeps, ten words and a fifth of repeated words pass the base.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut

SPACES = "[\\x20\\x09-\\x0D]+"
LETTERS_AND_MARKS = "\\p{L}"
WINDOW = 5
#: P(good) at which a document is kept.
KEEP_AT = 0.5
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_bars", "n_lettered"]


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text."""

    def covered(grams: Column) -> Column:
        def spans(pairs: Column) -> Column:
            twice = F.filter(
                pairs,
                lambda x, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == x["h"])) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)),
            )
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return let(
                places,
                lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(
                    F.aggregate(
                        F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(a - b, F.lit(WINDOW))),
                        F.lit(WINDOW),
                        lambda s, x: s + x,
                    )
                ),
            )

        pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(pairs, spans))

    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(grams, covered))


def with_stats(docs: DataFrame) -> DataFrame:
    """docs with COLUMNS; columns of these names, or of their helpers', must not be there before."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = words_of(text)

    def all_of(w: Column) -> Column:
        letters = F.size(F.filter(w, lambda x: x.rlike(LETTERS_AND_MARKS)))
        return F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"), letters.alias("n_lettered"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    packed, by_line = "packed_stats", "line_stats"
    out = docs.withColumns(
        {
            packed: let(words, all_of),
            by_line: let(lines, of_lines),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_shouts": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long"),
            "n_bars": (F.length(text) - F.length(F.translate(text, "|", ""))).cast("long"),
        }
    )
    return out.withColumns(
        {
            "n_words": F.col(packed)["n_words"].cast("long"),
            "n_repeat_words": F.col(packed)["n_repeat_words"].cast("long"),
            "n_lettered": F.col(packed)["n_lettered"].cast("long"),
            "n_lines": F.col(by_line)["n_lines"].cast("long"),
            "n_dup_lines": F.col(by_line)["n_dup_lines"].cast("long"),
        }
    ).drop(packed, by_line)


def base_failed() -> Column:
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return (n < 10) | (100 * r > 20 * n)


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 for good, -1 for bad, 0 where it abstains."""
    c = {k: F.col(k) for k in COLUMNS}

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    n = c["n_words"]
    return {
        "length": vote(n >= 50, n < 15),
        "word_size": vote((c["word_chars"] >= 3 * n) & (c["word_chars"] <= 8 * n), (c["word_chars"] < 2 * n) | (c["word_chars"] > 14 * n)),
        "symbols": vote(50 * c["n_symbols"] <= n, 10 * c["n_symbols"] > n),
        "bars": vote(c["n_bars"] == 0, 5 * c["n_bars"] > n),
        "shouting": vote(50 * c["n_shouts"] <= n, 4 * c["n_shouts"] > n),
        "dup_lines": vote(c["n_dup_lines"] == 0, 10 * c["n_dup_lines"] > 3 * c["n_lines"]),
        "repeats": vote(100 * c["n_repeat_words"] <= 5 * n, 100 * c["n_repeat_words"] > 15 * n),
        "letters": vote(100 * c["n_lettered"] >= 90 * n, 100 * c["n_lettered"] < 70 * n),
    }


RULES = ("length", "word_size", "symbols", "bars", "shouting", "dup_lines", "repeats", "letters")


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> dict:
    """Expectation-maximisation over vote patterns and their counts.

    A rule that votes is right with probability good[r] on good documents and bad[r] on bad ones; both stay within
    0.55 and 0.995, so that a rule keeps its meaning. Abstaining tells nothing.
    """
    k = len(RULES)
    good, bad, prior = [0.9] * k, [0.7] * k, 0.85
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        right_g, votes_g, right_b, votes_b, mass = [1.8] * k, [2.0] * k, [1.4] * k, [2.0] * k, 0.0
        for pattern, n in patterns:
            p = posterior(pattern, good, bad, prior)
            mass += n * p
            for r, v in enumerate(pattern):
                if v:
                    votes_g[r] += n * p
                    votes_b[r] += n * (1 - p)
                    right_g[r] += n * p * (v > 0)
                    right_b[r] += n * (1 - p) * (v < 0)
        new_good = [min(0.995, max(0.55, a / b)) for a, b in zip(right_g, votes_g)]
        new_bad = [min(0.995, max(0.55, a / b)) for a, b in zip(right_b, votes_b)]
        new_prior = min(0.98, max(0.5, mass / total))
        moved = max(abs(x - y) for x, y in zip([*good, *bad, prior], [*new_good, *new_bad, new_prior]))
        good, bad, prior = new_good, new_bad, new_prior
        if moved < 1e-6:
            break
    return {"good": good, "bad": bad, "prior": prior}


def posterior(pattern: tuple[int, ...], good: list[float], bad: list[float], prior: float) -> float:
    s = math.log(prior / (1 - prior))
    for v, g, b in zip(pattern, good, bad):
        s += math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) if v < 0 else 0.0
    return 1 / (1 + math.exp(-s))


def fit_on(voted: DataFrame) -> dict:
    """The model for all rows of a frame with a column of votes for each rule."""
    names = [f"vote_{r}" for r in RULES]
    counted = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows")).collect()  # at most 3 ** len(RULES) rows
    return fit([(tuple(row[x] for x in names), row["n_rows"]) for row in counted])


def probability(model: dict) -> Column:
    """The posterior as an expression over the vote columns."""
    s = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r, g, b in zip(RULES, model["good"], model["bad"]):
        v = F.col(f"vote_{r}")
        s = s + F.when(v > 0, F.lit(math.log(g / (1 - b)))).when(v < 0, F.lit(math.log((1 - g) / b))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-s))


def with_votes(df: DataFrame) -> DataFrame:
    return df.withColumns({f"vote_{r}": v for r, v in votes().items()})


def score(docs: DataFrame) -> DataFrame:
    """doc_id, COLUMNS, votes, base_failed, p_good and kept for every row of docs(doc_id, text)."""
    voted = cut(with_votes(with_stats(docs.select("doc_id", "text")).drop("text")), "votes")
    model = fit_on(voted)
    return voted.withColumn("base_failed", base_failed()).withColumn("p_good", probability(model)).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_AT))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns and no others; nothing is shuffled but vote counts.

    Rows are written once with their votes, so that statistics are worked out once, not for the model and again for the
    verdict. Other columns travel in one struct, so that no name of theirs can clash.
    """
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("others"))
    scored = with_votes(with_stats(packed))
    voted = cut(scored.select("text", "others", base_failed().alias("failed"), *[f"vote_{r}" for r in RULES]), "votes")
    kept = voted.filter(~F.col("failed") & (probability(fit_on(voted)) >= KEEP_AT))
    return kept.select(*[F.col("text") if c == "text" else F.col("others").getField(c).alias(c) for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
