"""Secret scan: fixed patterns, and character Markov models compared by likelihood ratio.

Base patterns name assignments, access keys and long hexadecimal runs. Two first-order Markov
models over characters are then trained: one on random strings (the values that the base
patterns labelled), one on ordinary identifiers (the words of the same texts that no base match
touches). A long token whose log-likelihood ratio a character exceeds a threshold is reported
as ``markov``. Training reads a bounded sample of labelled texts (``SAMPLE_ROWS``, by hash);
scanning reads every text whole. Where a base match covers a part of a token, the rest of it is
judged as a token of its own.

The model is one array of 128 x 128 ratios, a constant of the scoring projection, so a token is
scored by array lookups in the engine. No Python code runs on the executors.

Defined cases: null texts count as empty and have no spans; empty tables give an empty result;
without labelled values the ratios are 0 and nothing is added; characters beyond ASCII
never belong to a candidate token; repeated rows are scanned one by one; a very long text is read
by one task in time near linear in its matches; other columns pass through ``scan`` unchanged, and
columns named like the added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, cut_out, disjoint, matches, matches_if

# The base patterns of the contract. Runs are possessive and begin where a run
# begins, which finds the same matches without retrying inside a run.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]++)"
ASSIGN_VALUE = "[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = "AKIA[A-Z0-9]++"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "markov")

#: A token that the models judge: characters of encoded values, this many at least.
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WORD = "[A-Za-z0-9+/_=-]{4,}+"
#: Texts of the training sample, and of these the random values and ordinary words used.
SAMPLE_ROWS = 4_000
#: Log-likelihood ratio a character from which a token is reported; 20 characters make 5 nats.
THRESHOLD = 0.25
#: Pairs of characters for which a model's frequency of single characters stands.
BACKOFF = 30.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _sieve(text: Column) -> Column:
    return text.rlike("(?i)(?:passw|secret|token|api_?key)")


def base_spans(text: Column) -> dict[str, Column]:
    """The matches of each base kind that meet its length rule."""
    assign = F.filter(matches_if(text, _sieve(text), ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 1)) >= 6)
    access = F.filter(matches_if(text, F.contains(text, F.lit("AKIA")), ACCESS), lambda m: F.length(m["hit"]) >= 20)
    return {"assign": assign, "access": access, "hex": matches_if(text, text.rlike("[0-9a-f]{24}"), HEX)}


def _pairs(token: Column) -> Column:
    """Cells of the 128 x 128 table, one for each pair of neighbouring characters."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * 128 + b)


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[float]:
    """Log-ratios random / ordinary of each pair of characters, from labelled samples.

    The sample holds the ``sample_rows`` texts with base matches that come first by hash; its
    size does not grow with the corpus. The counts come back as at most 2 * 128 * 128 rows.
    """
    text = F.col(text_col)
    labelled = (
        docs.select(text.alias("t"))
        .where(_sieve(text) | F.contains(text, F.lit("AKIA")) | text.rlike("[0-9a-f]{24}"))
        .select("t", F.xxhash64("t").alias("h"))
    )
    # the hashes alone are ordered; the texts under the last of them stay where they are
    last = labelled.select("h").distinct().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    labelled = labelled.where(F.col("h") <= F.lit(last).cast("bigint")).dropDuplicates(["h"])
    found = base_spans(F.col("t"))
    value = lambda m: F.coalesce(F.nullif(F.regexp_extract(m["hit"], ASSIGN_VALUE, 1), F.lit("")), m["hit"])
    hits = F.concat(found["assign"], found["access"], found["hex"])
    read = labelled.withColumn("hits", F.array_sort(hits))
    bare = cut_out(F.col("t"), disjoint(F.col("hits"), lambda start, end, first: F.when(first, F.lit(" ")).otherwise(F.lit(""))))
    tokens = read.select(
        F.lit(True).alias("random"), F.explode(F.array_distinct(F.transform("hits", value))).alias("token")
    ).unionAll(read.select(F.lit(False), F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(WORD), F.lit(0))))))
    tokens = tokens.where(F.length("token") >= 4).distinct()
    counts = tokens.select("random", F.explode(_pairs(F.col("token"))).alias("cell")).groupBy("random", "cell").count()
    return _ratios({(r["random"], r["cell"]): r["count"] for r in counts.collect()})  # at most 32,768 rows


def _ratios(counts: dict[tuple[bool, int], int]) -> list[float]:
    codes = [ord(c) for c in ALPHABET]
    table = [0.0] * (128 * 128)
    if not any(random for random, _ in counts):
        return table
    models = {}
    for random in (True, False):
        seen = {b: sum(counts.get((random, a * 128 + b), 0) for a in codes) for b in codes}
        single = {b: (n + 0.5) / (sum(seen.values()) + 0.5 * len(codes)) for b, n in seen.items()}
        for a in codes:
            after = sum(counts.get((random, a * 128 + b), 0) for b in codes)
            for b in codes:
                models[random, a, b] = (counts.get((random, a * 128 + b), 0) + BACKOFF * single[b]) / (after + BACKOFF)
    for a in codes:
        for b in codes:
            table[a * 128 + b] = round(math.log(models[True, a, b] / models[False, a, b]), 6)
    return table


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio over the token's pairs of characters."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to one constant
    pairs = _pairs(token)
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, cell: acc + F.coalesce(F.get(table, cell), F.lit(0.0)))
    return total / F.greatest(F.length(token) - 1, F.lit(1))


def _blanked(text: Column, found: Column) -> Column:
    """``text`` with blanks in the place of the spans ``found``; every other character keeps its place."""
    spaces = lambda start, end, _: F.repeat(F.lit(" "), end - start)
    return cut_out(text, disjoint(F.array_sort(found), spaces))


def scan(docs: DataFrame, model: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus ``assign, access, hex, markov``: arrays of (start, end, hit)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumns(base_spans(text))
    # blanked texts hold the parts of tokens that no base match covers, in their own places
    bare = F.when(F.size("assign") + F.size("access") + F.size("hex") > 0, _blanked(text, F.concat("assign", "access", "hex"))).otherwise(text)
    # the sieve looks at the text as it is, so that the others are blanked and searched no further
    tokens = F.when(text.rlike("[A-Za-z0-9+/_=-]{20}"), bound(bare, lambda t: matches(t, TOKEN))).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))
    return base.withColumn("markov", F.filter(tokens, lambda m: ratio(m["hit"], model) >= threshold))


def report(scanned: DataFrame) -> DataFrame:
    """The digest of ``scan``: counts, the hash of the base spans, and all spans."""
    order = {kind: i for i, kind in enumerate(KINDS)}

    def listed(kinds: tuple[str, ...]) -> Column:
        return F.array_join(F.transform(F.array_sort(F.concat(*map(keyed, kinds))), lambda x: x["s"]), ",")

    def keyed(kind: str) -> Column:
        shown = lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string"))
        return F.transform(kind, lambda m: F.struct(m["start"], F.lit(order[kind]).alias("o"), m["end"], shown(m).alias("s")))

    return scanned.select(
        "doc_id",
        *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
        F.size("markov").cast("bigint").alias("n_markov"),
    )


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> Column:
    """The text with every reported span replaced; overlapping spans are joined first."""
    plain = F.array_sort(F.transform(F.concat(*KINDS), lambda m: F.struct(m["start"], m["end"])))
    marked = lambda start, end, first: F.when(first, F.lit(mark)).otherwise(F.lit(""))
    return cut_out(F.col(text_col), disjoint(plain, marked))
