"""Text to tuples with column expressions only: sentences, tokens, n-grams, grammatical slots."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "~"
SENTENCE_END = r"[.!?\n]+"
TOKEN = r"[\p{L}\p{N}]+"


def usable_texts(df: DataFrame, text: str = "text", longest: int | None = None) -> DataFrame:
    """Rows whose text has 1 character or more, and at most ``longest`` where that is given."""
    size = F.length(text)
    return df.filter(size >= 1 if longest is None else size.between(1, longest))


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", ends: str = SENTENCE_END) -> DataFrame:
    """(key, sent_pos, sentence): numbered in the text; blank ones keep their number but give no row.

    (key, sent_pos) identifies a sentence without a global counter, so no sort crosses documents.
    """
    parts = df.select(key, F.posexplode(F.split(text, ends)).alias("sent_pos", "sentence"))
    return parts.filter(F.trim("sentence") != "")


def tokens_of(sentence: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(sentence), F.lit(pattern), F.lit(0))


def tokens(df: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Adds the lower-cased tokens of ``sentence``. lemmas (word, lemma): replaces known words, one by one."""
    out = df.withColumn("tokens", tokens_of(F.col("sentence")))
    if lemmas is None:
        return out
    keys = [c for c in df.columns if c != "sentence"]
    long = out.select(*keys, "sentence", F.posexplode("tokens").alias("_at", "word"))
    known = long.join(lemmas, "word", "left").withColumn("word", F.coalesce("lemma", "word"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"])
    return known.groupBy(*keys, "sentence").agg(ordered.alias("tokens"))


def ngrams(df: DataFrame, n: int, keep: list[str] | None = None, tokens: str = "tokens") -> DataFrame:
    """Every window of n tokens of a row as columns w1..wn; rows with fewer give none."""
    keep = [c for c in df.columns if c != tokens] if keep is None else keep
    # a descending sequence would be made for short rows: they get an empty array instead
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    windows = df.select(*keep, tokens, F.explode(starts).alias("_at"))
    return windows.select(*keep, *[F.element_at(tokens, F.col("_at") + j).alias(f"w{j + 1}") for j in range(n)])


def multi_ngrams(df: DataFrame, orders: list[int], tokens: str = "tokens") -> dict[int, DataFrame]:
    """One n-gram table for each order over the same tokens."""
    return {n: ngrams(df, n, tokens=tokens) for n in dict.fromkeys(orders)}


def stretches(df: DataFrame, n: int, more: int = 0, tokens: str = "tokens") -> DataFrame:
    """(part, words, many): sentences cut where the longest word of the n-gram changes, each stretch with many n-grams.

    Equal n-grams have equal parts, so a shuffle by part brings them together; inside a stretch a word travels
    once for all n-grams that it is in. words: the stretch with ``more`` words that follow it, if there are any.
    """
    weight = F.transform(tokens, lambda x: F.shiftleft(F.octet_length(x).cast("long"), 32) + F.hash(x))
    last = F.size(tokens) - (n - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    longest = F.transform(starts, lambda i: F.greatest(*[F.element_at("_w", i + j) for j in range(n)]) if n > 1 else F.element_at("_w", i))
    cuts = F.filter(starts, lambda i: (i == 1) | (F.element_at("_p", i) != F.get("_p", i - 2)))
    cut = df.select(tokens, weight.alias("_w")).select(tokens, longest.alias("_p")).select(tokens, "_p", cuts.alias("_c"))
    # Spark would ask first whether a plain column to explode is empty, and make the tokens again for that
    spans = F.transform("_c", lambda i, k: F.struct(F.element_at("_p", i).alias("part"), i.alias("at"), (F.coalesce(F.get("_c", k + 1), last + 1) - i).alias("many")))
    cut = cut.select(tokens, F.explode(spans).alias("_s"))
    return cut.select("_s.part", F.array_join(F.slice(tokens, F.col("_s.at"), F.col("_s.many") + (n - 1 + more)), " ").alias("words"), "_s.many")


def core_words(text: Column, stop_words: list[str]) -> Column:
    """Tokens without stop words, or all tokens if nothing is left; missing marks pass through."""
    words = tokens_of(text)
    kept = F.filter(words, lambda w: ~w.isin(stop_words)) if stop_words else words
    joined = F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")
    special = text.isNull() | text.isin("", MISSING, "UNKNOWN_TARGET")
    return F.when(special, text).otherwise(F.when(joined == "", F.lit(MISSING)).otherwise(joined))


@dataclass(frozen=True)
class Labels:
    """Dependency labels of a treebank; ``indirect`` is empty where a language has no such label."""

    subject: str = "nsubj"
    object: str = "dobj"
    indirect: str = "dative"
    oblique: str = "obl"
    adjective: str = "amod"
    verb: str = "VERB"


LABELS = {"en": Labels(), "fr": Labels(object="obj", indirect=""), "es": Labels(object="obj", indirect=""), "de": Labels(object="obj", indirect="iobj")}
SLOTS = ("root", "nsubj", "obj", "obj2", "obl", "adj_nsubj", "adj_obj")


WORD = ("i", "lemma", "pos", "dep", "head")


def slots(parsed: DataFrame, keys: list[str], labels: Labels = Labels()) -> DataFrame:
    """The slots of sentences that come as a row for each token (keys..., i, lemma, pos, dep, head)."""
    at_root = F.col("i") == F.col("head")
    used = at_root | F.col("dep").isin(labels.subject, labels.object, labels.indirect, labels.oblique, labels.adjective)
    # a null key joins no tokens: each is a sentence of its own, so that they don't meet in one task
    alone = F.when(~_known(keys), F.monotonically_increasing_id())
    words = parsed.filter(used).select(*keys, F.struct(*WORD).alias("_word"), alone.alias("_alone"))
    return sentence_slots(words.groupBy(*keys, "_alone").agg(F.collect_list("_word").alias("words")), keys, labels)


def sentence_slots(sentences: DataFrame, keys: list[str], labels: Labels = Labels()) -> DataFrame:
    """One row a sentence with a verb at its root: root, nsubj, obj, obj2, obl and the adjectives.

    sentences: (keys..., words), a sentence's tokens as structs (i, lemma, pos, dep, head; a root is its own
    head); nothing is shuffled. The first of the root's children with a label fills its slot; a second object,
    or an indirect one if it comes earlier, is obj2; an adjective is the first of the slot's own children.
    Where a key is null only the root is known.
    """
    placed = lambda words: F.transform(words, lambda x: F.struct(x["i"].alias("i"), x["lemma"].alias("lemma")))
    labelled = lambda label: placed(F.filter("_own", lambda x: x["dep"] == label))
    near = lambda side: F.array_min(placed(F.filter("_adjectives", lambda x: x["head"] == F.col(side)["i"])))["lemma"]
    below = lambda x: (x["i"] != x["head"]) & F.exists("_roots", lambda r: r["i"] == x["head"])
    roots = placed(F.filter("words", lambda x: (x["i"] == x["head"]) & (x["pos"] == labels.verb)))
    out = sentences.select(*keys, "words", roots.alias("_roots"))
    # Spark would ask first whether a plain column to explode is empty, and make the words again for that
    out = out.select(*keys, "words", "_roots", F.explode(F.transform("_roots", lambda x: x["lemma"])).alias("root"))
    adjectives = F.filter("words", lambda x: (x["i"] != x["head"]) & (x["dep"] == labels.adjective))
    out = out.select(*keys, "root", F.when(_known(keys), F.filter("words", below)).alias("_own"), adjectives.alias("_adjectives"))
    out = out.select(*keys, "root", "_adjectives", F.array_min(labelled(labels.subject)).alias("s"), F.array_sort(labelled(labels.object)).alias("_o"), F.array_min(labelled(labels.indirect)).alias("d"), F.array_min(labelled(labels.oblique)).alias("b"))
    out = out.select(*keys, "root", "_adjectives", "s", F.get("_o", 0).alias("o"), F.least(F.get("_o", 1), "d").alias("o2"), "b")
    missing = lambda c: F.coalesce(c, F.lit(MISSING))
    return out.select(*keys, "root", missing(F.col("s.lemma")).alias("nsubj"), missing(F.col("o.lemma")).alias("obj"), missing(F.col("o2.lemma")).alias("obj2"), missing(F.col("b.lemma")).alias("obl"), missing(near("s")).alias("adj_nsubj"), missing(near("o")).alias("adj_obj"))


def _known(keys: list[str]) -> Column:
    return reduce(and_, [F.col(k).isNotNull() for k in keys])
