"""Personal data: fixed patterns, and terms that give protected entities away.

Protected entities are the matches of four patterns (e-mail, IP, card, phone). Around each of
them lies a window of words. For a term t and a kind c the corpus gives

    PMI(t; c) = log2( p(t, c) / (p(t) p(c)) ),      IC(c) = -log2 p(c),

with p(c) the share of all words that lie in windows of kind c, p(t) the term's share of all
words, and p(t, c) its share inside those windows. PMI / IC is the part of the entity's
information that the term discloses: 1 if the term occurs nowhere else. The same is scored with
a single entity e, a value of its kind, in the place of c, so a name that goes with one address
is found too. A term counts for a kind from ``SUPPORT`` different entities on, and for an entity
from ``SUPPORT`` different texts on; copies of a text add no support.
From ``GENERALISE`` on a term is replaced by a general form (its first letters, or its number of
digits), and from ``REMOVE`` on it is removed. All counts cover the whole corpus.

Everything is DataFrame functions. Term counts are partial before they are shuffled, so frequent
words are no hot keys. The table of disclosing terms is broadcast only after it was counted.

Defined cases: null texts count as empty; with no entity or no disclosing term only base spans
come out; empty tables give an empty result; repeated rows are scanned one by one; very long
digit or letter runs are read in one pass; further columns pass through ``scan``, and columns
named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, cut, cut_out, disjoint, matches, matches_if, running, small_side, spans_text

# The base patterns of the contract. ``\G`` is the end of the match before; a run
# is entered only at its begin or there, and is possessive, so no text is read twice.
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
IP_PARTS = "^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?+(?:\\.|$)){4}"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Words before and after an entity that make its window, and the characters searched for them.
WINDOW_WORDS, WINDOW_CHARS = 8, 200
#: Different entities that a term must accompany before it can disclose their kind, and different
#: texts in which it must accompany one entity before it can disclose that.
SUPPORT = 5
#: Parts of the entity's information from which a term is generalised or removed.
GENERALISE, REMOVE = 0.75, 0.9
#: A term: a run of letters, digits or marks, as lower-cased.
TERM = "[\\p{L}\\p{N}]{3,}+"


def base_spans(text: Column) -> dict[str, Column]:
    """The matches of each base kind that pass its check."""
    digit = text.rlike("[0-9]")
    digits = lambda m: F.regexp_replace(m["hit"], "[^0-9]", "")
    ip = F.filter(matches_if(text, digit & text.rlike("[0-9]\\.[0-9]"), IP), lambda m: m["hit"].rlike(IP_PARTS))
    card = F.filter(
        matches_if(text, text.rlike("[0-9][\\x20-]?[0-9][\\x20-]?[0-9][\\x20-]?[0-9]"), CARD),
        lambda m: F.length(digits(m)).between(13, 19) & F.call_function("luhn_check", digits(m)),
    )
    phone = F.filter(matches_if(text, F.contains(text, F.lit("+")), PHONE), lambda m: F.length(digits(m)).between(9, 15))
    return {"email": matches_if(text, F.contains(text, F.lit("@")), EMAIL), "ip": ip, "card": card, "phone": phone}


def _lowered(text: Column) -> Column:
    """Lower case with as many characters: the capital dotted I is the only one that becomes two."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(_lowered(text), F.lit(TERM), F.lit(0))


def _windows(found: DataFrame) -> DataFrame:
    """One row per entity: kind, hashes of its value and its text, and the terms around it."""
    named = lambda kind: F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("m")))
    each = F.concat(*map(named, KINDS))
    rows = found.where(F.size(F.concat(*KINDS)) > 0).select(F.explode(each).alias("e"), "_text").select("e.*", "_text")
    hashes = [F.xxhash64("m.hit").alias("entity"), F.xxhash64("_text").alias("of")]
    before = F.substring(F.col("_text"), F.greatest(F.col("m.start") - WINDOW_CHARS, F.lit(0)) + 1, F.least(F.col("m.start"), F.lit(WINDOW_CHARS)))
    after = F.substring(F.col("_text"), F.col("m.end") + 1, F.lit(WINDOW_CHARS))
    left = F.reverse(F.slice(F.reverse(_terms(before)), 1, WINDOW_WORDS))
    return rows.select("kind", *hashes, F.concat(left, F.slice(_terms(after), 1, WINDOW_WORDS)).alias("terms"))


def disclosing_terms(found: DataFrame) -> DataFrame:
    """``term, kind, disclosure``: the terms of the corpus that reveal protected entities or their kind.

    ``found`` has ``_text`` and the base matches. Two passes: the windows, then the frequency of
    the candidate terms among all words of all texts.
    """
    windows = cut(_windows(found))
    near = windows.select("kind", "entity", "of", F.explode("terms").alias("term"))
    # one row for an entity, term and text first, so that a hot term or a copied text is small
    by_text = near.groupBy("term", "kind", "entity", "of").agg(F.count("*").alias("n"))
    pairs = cut(by_text.groupBy("term", "kind", "entity").agg(F.sum("n").alias("n"), F.count("*").alias("texts")))
    counts = pairs.groupBy("term", "kind").agg(F.sum("n").alias("n_tc"), F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
    window_words = windows.groupBy("kind").agg(F.sum(F.size("terms")).alias("n_c"))  # four rows
    of_kinds = counts.join(F.broadcast(window_words), "kind").select("term", "kind", "n_tc", "n_c")
    often = pairs.where(F.col("texts") >= SUPPORT)
    entities = cut(often.select("kind", "entity").distinct())
    entity_words = windows.join(small_side(entities), ["kind", "entity"], "left_semi").groupBy("kind", "entity").agg(F.sum(F.size("terms")).alias("n_c"))
    of_entities = often.join(small_side(cut(entity_words)), ["kind", "entity"]).select("term", "kind", F.col("n").alias("n_tc"), "n_c")
    candidates = cut(of_kinds.unionAll(of_entities))
    names = cut(candidates.select("term").distinct())
    words = found.select(F.explode(_terms(F.col("_text"))).alias("term"))
    all_words = found.select(F.sum(F.size(_terms(F.col("_text")))).alias("n_all"))
    # counted in the map tasks before the join; Spark filters first where the names are broadcast
    totals = words.groupBy("term").agg(F.count("*").alias("n_t")).join(small_side(names), "term", "left_semi")
    scored = candidates.join(totals, "term").join(F.broadcast(all_words))
    share = F.col("n_c") / F.col("n_all")
    pmi = F.log2(F.col("n_tc") * F.col("n_all") / (F.col("n_t") * F.col("n_c")))
    part = F.when(share < 1, F.least(pmi / -F.log2(share), F.lit(1.0)))
    strong = scored.select("term", "kind", part.alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    return cut(strong.groupBy("term", "kind").agg(F.max("disclosure").alias("disclosure")))


def _general(term: Column) -> Column:
    """A wider form: the number of digits of a number, else the first letters."""
    return F.when(term.rlike("^\\p{N}+$"), F.concat(F.lit("<"), F.length(term).cast("string"), F.lit(" digits>"))).otherwise(F.concat(F.substring(term, 1, 2), F.lit("*")))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``email, ip, card, phone`` and ``term``: arrays of matches.

    A ``term`` match has the text to put instead: a general form, or nothing. Terms inside a
    base match are left to it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn("_text", text).withColumns(base_spans(text))
    terms = disclosing_terms(found)
    strongest = cut(terms.groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    if strongest.isEmpty():
        none = F.array().cast("array<struct<start:int,end:int,hit:string,instead:string>>")
        return found.withColumn("term", none).drop("_text")
    # The texts that hold such a term, each named by two hashes of itself: equal texts have equal spans.
    keyed = found.withColumns({"_k1": F.xxhash64("_text"), "_k2": F.xxhash64(F.lit(1), F.col("_text"))})
    distinct = keyed.select("_k1", "_k2", F.explode(F.array_distinct(_terms(F.col("_text")))).alias("term"))
    held = (
        distinct.join(small_side(strongest), "term")
        .groupBy("_k1", "_k2")
        .agg(F.collect_set(F.struct("term", "disclosure")).alias("_terms"))  # terms of one text
    )
    held = cut(held)
    joined = keyed.join(small_side(held), ["_k1", "_k2"], "left")
    return joined.withColumn("term", F.when(F.col("_terms").isNull(), F.array()).otherwise(_term_matches())).drop("_k1", "_k2", "_text", "_terms")


def _term_matches() -> Column:
    """Places of a text's own disclosing terms, outside of its base matches."""
    own = F.array_sort(F.transform("_terms", lambda t: t["term"]))
    pattern = F.concat(F.lit("(?<![\\p{L}\\p{N}])(?:"), F.array_join(own, "|"), F.lit(")(?![\\p{L}\\p{N}])"))
    lowered = _lowered(F.col("_text"))
    # blanks in the place of base matches keep all other places, and no term runs across one
    spaces = lambda start, end, _: F.repeat(F.lit(" "), end - start)
    part = lambda m: F.filter("_terms", lambda t: t["term"] == m["hit"])[0]["disclosure"]
    # only a text of invalid bytes can still change its number of characters; it is searched as it is
    where = F.when(F.length(lowered) == F.length("_text"), lowered).otherwise(F.col("_text"))
    base = F.array_sort(F.transform(F.concat(*KINDS), lambda m: F.struct(m["start"], m["end"])))
    free = bound(cut_out(where, disjoint(base, spaces)), lambda t: matches(t, pattern))
    return F.transform(
        free,
        lambda m: F.struct(m["start"], m["end"], m["hit"], F.when(part(m) >= REMOVE, F.lit("")).otherwise(_general(m["hit"])).alias("instead")),
    )


def report(scanned: DataFrame) -> DataFrame:
    """The digest of ``scan``: counts, the hash of the base spans, and all spans."""
    base = F.array_join(F.concat(*[spans_text(kind, F.col(kind)) for kind in KINDS]), ",")
    every = F.array_join(F.concat(*[spans_text(kind, F.col(kind)) for kind in (*KINDS, "term")]), ",")
    return scanned.select(
        "doc_id", *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), F.size("term").cast("bigint").alias("n_term"),
    )


def sanitised(scanned: DataFrame, text_col: str = "text") -> Column:
    """The text with entities replaced by their kind and terms generalised or removed.

    Base matches of different kinds may overlap; of such a group the first is replaced.
    """
    named = lambda kind: F.transform(kind, lambda m: F.struct(m["start"], m["end"], F.lit(f"<{kind}>").alias("instead")))
    entity = map(named, KINDS)
    term = F.transform("term", lambda m: F.struct(m["start"], m["end"], m["instead"]))
    every = F.array_sort(F.concat(*entity, term))

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        free = m["start"] >= at
        none = F.array().cast("array<struct<start:int,end:int,instead:string>>")
        return F.when(free, m["end"]).otherwise(at), F.when(free, F.array(m)).otherwise(none)

    return cut_out(F.col(text_col), running(every, "struct<start:int,end:int,instead:string>", step))
