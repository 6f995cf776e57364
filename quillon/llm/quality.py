"""Quality rules under weak supervision, with DataFrame functions only.

Rules vote keep (+1), drop (-1) or abstain (0). Documents are counted by their pattern of votes (at most 3^8 rows for
any corpus), expectation-maximisation over that table estimates how each rule votes on good and on bad documents, and
a document's posterior probability of being good replaces passing every rule.

Defined results: a null or empty text has no words and fails the base rule; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACES, let, stash, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "symbol_chars", "capitals", "exclaims", "dup_lines", "repeats", "word_length", "line_ends")
#: After so many rounds no log parameter moves by 1e-3 any more on any table measured, and no verdict changes.
ROUNDS = 40
#: Prior belief, worth PRIOR_WEIGHT of the documents: how a rule votes (drop, abstain, keep) on bad and on good ones.
#: It says which of the two classes is the good one and keeps rare votes from zero; the rest is estimated.
PRIOR_BAD, PRIOR_GOOD, PRIOR_WEIGHT, PRIOR_GOOD_SHARE = (0.3, 0.1, 0.6), (0.004, 0.096, 0.9), 0.03, 0.8


def _covered(words: Column, n: Column) -> Column:
    """Words in a 3-word window found twice or more. Equal hashes only choose the path; the count compares words."""

    def marked(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["k"] == x["k"])) | (F.get(s, i + 1)["k"] == x["k"]))
        at = F.array_sort(F.transform(twice, lambda x: x["p"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).cast("long").alias("n"), (p + 3).alias("end")), lambda a: a["n"])

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        slow = let(F.array_sort(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("p")))), marked)
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(slow))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(words, of))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The counts that the rules read, for each document; keep: columns of docs to carry, as a struct named carried."""
    carried = [F.struct(*keep).alias("carried")] if keep else []
    keep = ["carried"] if keep else []
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), *carried)
    text = F.col("text")

    def without(chars: str) -> Column:
        return F.length(F.translate(text, chars, ""))

    def each(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _covered(w, F.size(w)).alias("n_repeat_words"))

    def lines(a: Column) -> Column:
        return F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"))

    rows = rows.select("doc_id", *keep, "text", let(words_of(text), each).alias("_w"), let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lines).alias("_l"))
    return rows.select(
        "doc_id",
        *keep,
        F.col("_w.n_words").alias("n_words"),
        without(SPACES).cast("long").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        F.col("_l.n_dup_lines").alias("n_dup_lines"),
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        F.col("_l.n_lines").alias("n_lines"),
        (F.length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"),
        (F.length(text) - without("!")).cast("long").alias("n_exclaims"),
        F.regexp_count(text, F.lit(r"[.!?;:][\"')]*(\n|$)")).cast("long").alias("n_line_ends"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def votes() -> list[Column]:
    """The eight votes from the measures, in integers only. A document without words gets drop votes or none."""

    def vote(bad: str, good: str) -> Column:
        return F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end")

    return [
        vote("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
        vote("25 * n_symbols > word_chars", "100 * n_symbols <= word_chars"),
        vote("2 * n_capitals > word_chars", "4 * n_capitals <= word_chars"),
        vote("5 * n_exclaims > n_words", "20 * n_exclaims <= n_words"),
        vote("2 * n_dup_lines > n_lines", "20 * n_dup_lines <= n_lines"),
        vote("10 * n_repeat_words > 4 * n_words", "10 * n_repeat_words <= n_words"),
        vote("word_chars < 2 * n_words or word_chars > 20 * n_words or n_words = 0", "word_chars >= 3 * n_words and word_chars <= 12 * n_words"),
        vote("10 * n_line_ends < n_lines", "2 * n_line_ends >= n_lines"),
    ]


def pattern(columns: list[Column]) -> Column:
    """The votes as one number in base 3."""
    out = F.lit(0)
    for v in columns:
        out = out * 3 + v + 1
    return out.cast("int")


def posterior(counts: DataFrame, n_rules: int = len(RULES), rounds: int = ROUNDS) -> DataFrame:
    """(pattern, p_good) from (pattern, n), a table of at most 3^n_rules rows, by expectation-maximisation.

    The prior weighs a fixed share of the documents, so the estimate behaves alike at every size.
    """
    table = counts.agg(F.array_sort(F.collect_list(F.struct("pattern", F.col("n").cast("double").alias("n")))).alias("t"), F.sum("n").cast("double").alias("total"))
    digits = [(3 ** (n_rules - 1 - j)) for j in range(n_rules)]
    table = table.select("total", F.transform("t", lambda x: F.struct(x["pattern"].alias("pattern"), x["n"].alias("n"), F.array(*[(F.floor(x["pattern"] / d) % 3).cast("int") for d in digits]).alias("v"))).alias("t"))

    def log_odds(params: Column, x: Column) -> Column:
        """params: the log odds of the share of good documents, then for each rule and vote the log of good over bad."""
        out = params[0]
        for j in range(n_rules):
            out = out + F.get(params, x["v"][j] + (1 + 3 * j))
        return out

    def p_good(params: Column, x: Column) -> Column:
        return 1 / (1 + F.exp(-log_odds(params, x)))

    first = [F.lit(PRIOR_GOOD_SHARE / (1 - PRIOR_GOOD_SHARE))] + [F.lit(g / b) for _ in range(n_rules) for b, g in zip(PRIOR_BAD, PRIOR_GOOD)]
    total = F.col("total")

    def step(params: Column, _: Column) -> Column:
        def sums(weighed: Column) -> Column:
            """All documents' weight as good and as bad, and that of each vote of each rule."""

            def add(acc: Column, x: Column) -> Column:
                return F.zip_with(acc, F.flatten(F.array(F.array(x["g"], x["b"]), F.flatten(F.transform(x["v"], lambda v: F.flatten(F.transform(F.array(*[F.lit(k) for k in range(3)]), lambda k: F.array(F.when(v == k, x["g"]).otherwise(0.0), F.when(v == k, x["b"]).otherwise(0.0)))))))), lambda a, b: a + b)

            return F.aggregate(weighed, F.array_repeat(F.lit(0.0), 2 + 6 * n_rules), add)

        weighed = F.transform("t", lambda x: let(p_good(params, x), lambda p: F.struct((x["n"] * p).alias("g"), (x["n"] * (1 - p)).alias("b"), x["v"].alias("v"))))

        def new(s: Column) -> Column:
            w = total * PRIOR_WEIGHT
            out = [F.ln((s[0] + w * PRIOR_GOOD_SHARE) / (s[1] + w * (1 - PRIOR_GOOD_SHARE)))]
            for j in range(n_rules):
                for k in range(3):
                    at = 2 + 6 * j + 2 * k
                    good = (s[at] + w * PRIOR_GOOD[k]) / (s[0] + w)
                    bad = (s[at + 1] + w * PRIOR_BAD[k]) / (s[1] + w)
                    out.append(F.ln(good / bad))
            return F.array(*out)

        return let(sums(weighed), new)

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(*[F.ln(x) for x in first]), step)
    table = table.select("t", fitted.alias("params"))
    return table.select(F.explode(F.transform("t", lambda x: F.struct(x["pattern"].alias("pattern"), p_good(F.col("params"), x).alias("p_good")))).alias("x")).select("x.*")


def judged(measured: DataFrame) -> DataFrame:
    """Adds the pattern of votes, p_good and kept. measured is read twice: give it a stored table."""
    rows = measured.withColumn("pattern", pattern(votes()))
    table = posterior(rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    # At most 3^8 rows, whatever the corpus: small enough to broadcast.
    return rows.join(F.broadcast(table), "pattern").withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def op3_query(spark, sf_dir: str) -> DataFrame:
    out = judged(stash(measures(spark.read.parquet(f"{sf_dir}/documents.parquet")), "measures"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", (F.round("p_good", 6) + 0.0).alias("p_good"), "pattern")
