"""Quality rules as a bitmask ledger: every rule once, policies as masks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, let, refuse_clash

#: The rules in bit order: name and failure test on the measurements.
RULES = [
    ("too_short", lambda: F.col("n_words") < 20),
    ("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    ("symbols", lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    ("repeated_lines", lambda: (F.col("n_dup_lines") > 2) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))),
    ("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    ("long_words", lambda: F.col("word_chars") > 25 * F.col("n_words")),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Policies by version: the rules that reject.
POLICIES = {
    "base": BIT["too_short"] | BIT["repeated_windows"],
    "v1": BIT["too_short"] | BIT["repeated_windows"] | BIT["symbols"] | BIT["repeated_lines"],
    "v2": sum(BIT.values()),
}


def covered_by_repeats(words: Column, window: int) -> Column:
    """Number of words in ``window``-word runs that occur twice or more in the array.

    Windows are compared by 64-bit hashes.  Only documents in which a hash comes
    back are sorted: positions of repeated hashes, in order, each cover the words
    since the last one, ``window`` at most.
    """

    def repeats(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twin = lambda s, k: (F.get(s, k - 1)["h"] == s[k]["h"]) | (F.get(s, k + 1)["h"] == s[k]["h"])
        at = lambda s: F.array_sort(F.filter(F.transform(s, lambda x, k: F.when(F.coalesce(twin(s, k), F.lit(False)), x["i"])), lambda i: i.isNotNull()))
        cover = lambda p: F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, window).otherwise(F.least(F.lit(window), x - F.get(p, k - 1)))), F.lit(0), lambda a, b: a + b)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(let(pairs, at), cover))

    starts = F.sequence(F.lit(1), F.size(words) - window + 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window, 0).otherwise(let(hashes, repeats))


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep=(), window: int = 8) -> DataFrame:
    """Measurements of every text in one pass without a shuffle.

    Null texts are as empty ones: all measurements 0.  Repeated rows and rows of one id
    get a row each, equal texts equal measurements; there is no order, so no ties.  An
    empty table gives no rows.  Columns of ``keep`` must not have one of the result's
    names (an error).
    """
    refuse_clash(list(keep), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "failed", "kept", "_text")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *keep)

    def long(c):
        return F.coalesce(c, F.lit(0)).cast("long")

    # a space in front leaves exactly one empty piece there, and one behind
    words = F.filter(F.split(F.col("_text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.split(F.col("_text"), "\n")
    worded = F.filter(lines, lambda x: x.rlike(WORD))
    measured = let(words, lambda w: F.struct(F.size(w).alias("n_words"), covered_by_repeats(w, window).alias("n_repeat_words"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("word_chars")))
    dups = let(worded, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"), F.size(x).alias("n_lines")))
    out = base.select("doc_id", *keep, measured.alias("w"), dups.alias("l"), F.regexp_count(F.col("_text"), F.lit("[#*$%&|<>]")).alias("n_symbols"))
    return out.select("doc_id", *keep, long(F.col("w.n_words")).alias("n_words"), long(F.col("w.word_chars")).alias("word_chars"), long(F.col("n_symbols")).alias("n_symbols"), long(F.col("l.n_dup_lines")).alias("n_dup_lines"), long(F.col("l.n_lines")).alias("n_lines"), long(F.col("w.n_repeat_words")).alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep=()) -> DataFrame:
    """Measurements and ``failed``, in which bit k is set if rule k fails.

    Nulls, repeated rows, empty tables and clashing names: as ``measure``; a null or
    empty text fails the rule on length.
    """
    bits = [F.when(test(), F.lit(BIT[name])).otherwise(0) for name, test in RULES]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measure(docs, text, doc_id, keep).withColumn("failed", mask.cast("long"))


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """``kept`` under a policy; another version needs no new measurement."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents it rejects, and those that only it rejects; an empty table: all 0.

    Documents are summed up by their failure bits under the policy first, 2^rules rows
    at most, and all counts are sums over those.
    """
    mask = POLICIES[version]
    used = [(n, b) for n, b in BIT.items() if b & mask]
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    sums = patterns.agg(count(F.lit(True)).alias("n"), *[count(F.col("bits").bitwiseAND(F.lit(b)) != 0).alias(f"{n}__all") for n, b in used], *[count(F.col("bits") == b).alias(f"{n}__only") for n, b in used])
    parts = [F.struct(F.lit(n).alias("rule"), F.col(f"{n}__all").alias("rejected"), F.col(f"{n}__only").alias("rejected_alone"), F.col("n").alias("documents")) for n, _ in used]
    return sums.select(F.inline(F.array(*parts)))
