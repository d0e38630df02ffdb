"""Quality rules by weak supervision.

Every rule votes for a document (1), against it (-1) or abstains (0). The
votes of all documents that pass the base rule are summed into counts by pattern (at most 3 to the
number of rules), expectation-maximisation over these counts estimates how
accurate each rule's votes are and the share of good documents, and a document is kept if its
posterior of being good is at least one half and it does not fail the base rule.

Null text: no words. All counts are over the whole text. Repeated rows are
judged each by itself, extra columns are ignored, ties (posterior one half) are
kept, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import GAP, stored

#: Rule: (vote for, vote against) as SQL conditions over the feature columns.
#: Most rules know junk only, and abstain where they see none.
RULES = {
    "word_length": ("word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    "symbols": ("false", "n_symbols * 5 > n_words"),
    "symbol_words": ("false", "n_symbol_words * 5 > n_words"),
    "letters": ("false", "n_letter_words * 4 < 3 * n_words OR n_words = 0"),
    "shouting": ("false", "n_upper * 2 > word_chars"),
    "exclaiming": ("false", "n_exclaimed * 5 > n_words"),
    "repeats": ("false", "n_repeat_words * 10 > 3 * n_words"),
    "stutter": ("false", "n_stutter * 5 > n_words"),
    "lines": ("false", "n_dup_lines * 10 > 3 * n_lines"),
}

#: Words in three-word windows found twice or more; h: word hashes of one text.
REPEATS = """
CASE WHEN size(h) < 4 THEN 0L ELSE
transform(array(transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2]))), t ->
  CASE WHEN size(array_distinct(t)) = size(t) THEN 0L ELSE
  transform(array(sort_array(transform(t, (x, i) -> named_struct('x', x, 'i', i)))), s ->
    aggregate(
      sort_array(filter(transform(s, (e, j) -> IF(e.x <=> get(s, j - 1).x OR e.x <=> get(s, j + 1).x, e.i, -1)), i -> i >= 0)),
      named_struct('prev', -3, 'n', 0L),
      (a, i) -> named_struct('prev', i, 'n', a.n + least(3, i - a.prev)),
      a -> a.n))[0] END)[0] END
"""

#: EM over the pattern counts. State: pi, the share of good documents, and lr,
#: for each rule and vote the log ratio of the vote's rates among good and bad
#: documents. A vote against never speaks for a document, nor the reverse.
EM = """
aggregate(sequence(1, {steps}), named_struct('pi', 0.9D, 'lr', array_repeat(array(-1.4D, 0D, 1.4D), {rules})), (state, step) ->
  transform(array(transform(patterns, p -> named_struct('v', p.v, 'n', p.n, 'g',
      1D / (1D + exp(-aggregate(sequence(0, {rules} - 1), ln(state.pi / (1D - state.pi)), (s, r) -> s + state.lr[r][p.v[r] + 1])))))), e ->
    transform(array(named_struct('g', aggregate(e, 0D, (s, p) -> s + p.n * p.g), 'b', aggregate(e, 0D, (s, p) -> s + p.n * (1D - p.g)))), m ->
      named_struct(
        'pi', least(0.99D, greatest(0.01D, m.g / (m.g + m.b))),
        'lr', transform(sequence(0, {rules} - 1), r -> transform(sequence(-1, 1), k ->
          transform(array(
            ln((aggregate(e, 0D, (s, p) -> s + IF(p.v[r] = k, p.n * p.g, 0D)) + 0.5D) / (m.g + 1.5D)) -
            ln((aggregate(e, 0D, (s, p) -> s + IF(p.v[r] = k, p.n * (1D - p.g), 0D)) + 0.5D) / (m.b + 1.5D))), x ->
            CASE WHEN k < 0 THEN least(0D, x) WHEN k > 0 THEN greatest(0D, x) ELSE x END)[0]))))[0])[0])
"""


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"))
    df = df.withColumn("w", F.filter(F.split("text", GAP), lambda w: w != ""))
    df = df.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return df.select(
        "doc_id",
        F.size("h").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))[0].alias("l"),
        F.expr(REPEATS).cast("long").alias("n_repeat_words"),
        F.size(F.filter("w", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.regexp_count("text", F.lit(r"\p{L}[.,;]?[#*$%&|<>]")).cast("long").alias("n_symbol_words"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", "[^!]+", "")).cast("long").alias("n_exclaimed"),
        F.size(F.filter(F.zip_with("h", F.slice("h", 2, F.greatest(F.size("h"), F.lit(1))), lambda a, b: a == b), lambda x: x)).cast("long").alias("n_stutter"),
    ).select("n_symbol_words", "n_upper", "n_exclaimed", "n_stutter", "doc_id", "n_words", "word_chars", "n_symbols", F.col("l.n").cast("long").alias("n_lines"), (F.col("l.n") - F.col("l.d")).cast("long").alias("n_dup_lines"), "n_repeat_words", "n_letter_words")


def judge(docs: DataFrame, *, rules: dict[str, tuple[str, str]] = RULES, steps: int = 25) -> DataFrame:
    """doc_id, the features, base_failed, each rule's vote, posterior, kept."""
    votes = F.array(*(F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for good, bad in rules.values()))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = stored(features(docs).withColumn("votes", votes).withColumn("base_failed", failed))
    counts = df.filter("NOT base_failed").groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = counts.agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), "n"))).alias("patterns"))
    em = one.select(F.expr(EM.format(steps=steps, rules=len(rules))).alias("em")).first().em if df.filter("NOT base_failed").limit(1).count() else None
    logit = F.log(F.lit(em.pi / (1 - em.pi))) if em else F.lit(0.0)
    for r, by_vote in enumerate(em.lr if em else []):
        logit = logit + F.when(F.col("votes")[r] < 0, by_vote[0]).when(F.col("votes")[r] > 0, by_vote[2]).otherwise(by_vote[1])
    df = df.withColumn("posterior", 1 / (1 + F.exp(-logit)))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
