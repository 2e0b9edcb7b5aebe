"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Every text is measured once. The labelled documents are the holdout. For each stratum (language)
fixed paths of rejections are tested, each from the loosest cutoff to the strictest: for every set
of rules the path "any rule of the set is over its i-th cutoff", tested against ``RISK``, and for
each rule its own path, tested against ``RISK / rules``. A step is admitted if the exact binomial
test rejects "more good documents than that fall to it": with k of n good holdout documents
rejected, P(Binomial(n, risk) <= k) must be at most the path's part of ``LEVEL``. A stricter step
rejects whatever a looser one does, so the steps of a path are a fixed sequence and cost no part
of the level; the paths (``SHARES``) and the strata share it. So, except with probability
``LEVEL``, good documents of a stratum are rejected by all rules together with probability
``RISK`` at most whichever admitted step is used. Of the last admitted steps, and the rules' own
steps taken together, the one that rejects most labelled bad documents is used; ties go to the
larger set of rules. A stratum without one keeps everything: ``least_good`` says how many good
documents a stratum needs.

Everything is DataFrame functions; repeats are found inside a row, so nothing is exchanged but
narrow rows of measures.

Defined cases: null texts have no words and fail the base rule; a null language is a stratum of
its own, and languages without labels keep everything that passes the base rule; labels that are
null or contradict each other do not count; repeated rows are judged one by one; empty tables
give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side

#: Limit on good documents that the method rejects in a stratum, and the chance to exceed it.
RISK, LEVEL = 0.02, 0.05
#: The rules: a measure that is large for bad documents, and its grid of cutoffs, strictest first.
RULES = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", [i / 100 for i in range(1, 33)]),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", [i / 32 for i in range(1, 33)]),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", [i / 64 for i in range(1, 33)]),
    "word_length": ("word_chars / greatest(n_words, 1)", [5 + i / 2 for i in range(32)]),
}
#: Sets of rules that are tested together, the largest first; then each rule by itself.
SETS = [names for n in range(len(RULES), 0, -1) for names in combinations(RULES, n)]
#: Parts of ``LEVEL``: all rules together, the other sets, and the rules by themselves.
SHARES = (1 / 2, 15 / 32, 1 / 32)
_SPACE = " \t\n\x0b\x0c\r"


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The kept columns, the base measures and ``n_lines`` (lines with a word)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    read = docs.select(
        *keep,
        (F.length(F.translate(text, _SPACE, ""))).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
        words.alias("_words"),
    )
    counted = read.select(
        *keep, "word_chars", "n_symbols",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_words").cast("bigint").alias("n_words"),
        _windows(F.col("_words")).alias("_grams"),
    )
    # a text without equal windows needs no search for them
    repeated = F.size("_grams") > F.size(F.array_distinct("_grams"))
    ordered = F.when(repeated, F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    found = counted.select("*", ordered.alias("_ordered")).drop("_grams")
    starts = found.select("*", F.sort_array(_repeated_starts(F.col("_ordered"))).alias("_starts")).drop("_ordered")
    return starts.select("*", F.coalesce(_covered(F.col("_starts")), F.lit(0)).cast("bigint").alias("n_repeat_words")).drop("_starts")


def _windows(words: Column) -> Column:
    """A 64-bit hash of every three neighbouring words."""
    n = F.size(words)
    return F.when(
        n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated_starts(ordered: Column) -> Column:
    """Starts of windows that have an equal neighbour in the sorted list."""

    def equal(x: Column, j: Column) -> Column:
        return F.coalesce(F.get(ordered, j)["g"] == x["g"], F.lit(False))

    indexed = F.transform(ordered, lambda x, j: F.when(equal(x, j + 1) | ((j > 0) & equal(x, j - 1)), x["i"]))
    return F.filter(indexed, lambda i: i.isNotNull())


def _covered(starts: Column) -> Column:
    """Words in the union of windows of three that begin at the sorted ``starts``."""
    step = lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(s - acc["last"], F.lit(3))).alias("n"))
    return F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _log_binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """log P(Binomial(n, p) <= k), summed from the k-th term downwards."""
    odds = math.log(p / (1 - p))
    ns, ks = n.cast("double"), k.cast("int")
    climb = F.aggregate(
        F.when(ks > 0, F.sequence(F.lit(1), ks)).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda acc, i: acc + F.log((ns - i + 1) / i) + F.lit(odds),
    )
    # each lower term over the one above it: i / (n - i + 1) * (1 - p) / p
    tail = F.aggregate(
        F.when(ks > 0, F.reverse(F.sequence(F.lit(1), ks))).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, i: F.struct(
            (acc["sum"] + acc["term"] * i / (ns - i + 1) * F.lit((1 - p) / p)).alias("sum"),
            (acc["term"] * i / (ns - i + 1) * F.lit((1 - p) / p)).alias("term"),
        ),
        lambda acc: acc["sum"],
    )
    return ns * F.lit(math.log(1 - p)) + climb + F.log(tail)


def _paths(risk: float, level: float) -> list[tuple[tuple[str, ...], float, float]]:
    """(rules, risk, level) of each path: the sets, then each rule by itself."""
    alone = [((rule,), risk / len(RULES), level * SHARES[2] / len(RULES)) for rule in RULES]
    return [(names, risk, level * (SHARES[0] if i == 0 else SHARES[1] / (len(SETS) - 1))) for i, names in enumerate(SETS)] + alone


def least_good(strata: int, risk: float = RISK, level: float = LEVEL) -> int:
    """Good holdout documents from which a stratum can have cutoffs of all rules together."""
    return math.ceil(math.log(level * SHARES[0] / max(strata, 1)) / math.log(1 - risk))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``lang, rule, cutoff``: the chosen admitted cutoffs of each stratum."""
    agreed = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high and low in (0, 1)")
        .select("doc_id", F.col("low").cast("bigint").alias("good"))
    )
    # how many of the grid's cutoffs a value exceeds: 0 to 32, so equal rows are many
    above = lambda value, grid: F.size(F.filter(F.lit(grid), lambda c: c < F.expr(value)))
    judged = measured.where(~base_failed()).select("doc_id", "lang", *[above(*RULES[rule]).alias(rule) for rule in RULES]).join(agreed, "doc_id")
    held = cut(judged.groupBy("lang", *RULES).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))

    paths = _paths(risk, level)
    steps = [F.struct(F.lit(i).alias("path"), F.array_max(F.array(*names)).alias("above")) for i, (names, _, _) in enumerate(paths)]
    levels = held.select("lang", "good", F.explode(F.array(*steps)).alias("s")).groupBy("lang", "s.path", "s.above").agg(F.sum("good").alias("count"))
    by_path = (
        levels.groupBy("lang", "path")
        .agg(F.sum("count").alias("n"), F.collect_list(F.struct("above", "count")).alias("hist"))  # at most 33 entries
        .where("n > 0")
    )
    most = max(len(grid) for _, grid in RULES.values())
    none = F.lit(0).cast("bigint")
    tried = by_path.select("lang", "path", "n", "hist", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("at")).select(
        "lang", "path", "n", "at",
        F.aggregate("hist", none, lambda acc, h: acc + F.when(h["above"] > F.col("at"), h["count"]).otherwise(none)).alias("k"),
    )
    strata = by_path.agg(F.count_distinct(F.struct("lang")).alias("strata"))  # one row
    bound = F.log(F.get(F.lit([part for _, _, part in paths]), F.col("path")) / F.greatest("strata", F.lit(1)))
    own = F.col("path") >= len(SETS)
    limit = F.when(own, F.lit(risk / len(RULES))).otherwise(F.lit(risk))
    tail = F.when(own, _log_binomial_cdf(F.col("n"), F.col("k"), risk / len(RULES))).otherwise(_log_binomial_cdf(F.col("n"), F.col("k"), risk))
    admitted = tried.crossJoin(F.broadcast(strata)).where((F.col("k") <= F.col("n") * limit) & (tail <= bound))
    last = admitted.groupBy("lang", "path").agg(F.min("at").alias("at"))

    # a plan is the last step of a set, or those of all rules by themselves: per rule a step, 32 is none
    plan = F.least(F.col("path"), F.lit(len(SETS)))
    reach = F.create_map(*[x for i, (names, _, _) in enumerate(paths) for x in (F.lit(i), F.lit(list(names)))])
    at = [F.min(F.when(F.array_contains(F.element_at(reach, F.col("path")), rule), F.col("at"))).alias(f"_{rule}") for rule in RULES]
    plans = cut(last.groupBy(F.col("lang").alias("_lang"), plan.alias("plan")).agg(*at).fillna(most, [f"_{rule}" for rule in RULES]))
    rejected = F.array_max(F.array(*[(F.col(rule) > F.col(f"_{rule}")).cast("int") for rule in RULES]))
    gain = held.join(small_side(plans), F.col("lang").eqNullSafe(F.col("_lang"))).groupBy("_lang", "plan", *[f"_{rule}" for rule in RULES])
    gained = gain.agg(F.sum(rejected * F.col("bad")).alias("bad"))
    best = gained.groupBy("_lang").agg(F.max_by(F.struct(*[F.col(f"_{rule}").alias(rule) for rule in RULES]), F.struct("bad", -F.col("plan"))).alias("at"))
    chosen = [F.struct(F.lit(rule).alias("rule"), F.get(F.lit(grid), F.col(f"at.{rule}")).cast("double").alias("cutoff")) for rule, (_, grid) in RULES.items()]
    return best.select(F.col("_lang").alias("lang"), F.explode(F.array(*chosen)).alias("c")).select("lang", "c.*").where("cutoff is not null")


def judge(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """``measured`` plus ``base_failed``, ``failed_rules`` and ``kept``."""
    by_lang = cut(chosen.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut")))
    limits = small_side(by_lang.withColumnRenamed("lang", "_lang"))
    failed = F.array_compact(
        F.array(*[F.when(F.expr(value) > F.try_element_at("_cut", F.lit(rule)), F.lit(rule)) for rule, (value, _) in RULES.items()])
    )
    return (
        measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("failed_rules", F.array_join(failed, ","))
        .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
        .drop("_cut", "_lang")
    )


def assess(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per document with the measures, the base rule and the verdict."""
    measured = cut(measure(docs))
    verdict = judge(measured, cutoffs(measured, labels, risk, level))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")
