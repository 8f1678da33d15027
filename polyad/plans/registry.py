"""Registered queries: each operator over the driver's tables, with SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import LABELS, Labels, core_words, sentence_slots, tokens, usable_texts
from ..functions.text import sentences as sentences_of
from ..operators import assoc, evaluate, extend, frames, grams, model, tensor, tucker, vocab
from ..operators.nearest import nearest
from ..sources import corpus
from ..sources.store import is_folder, scratch_path
from ..streaming.ingest import ngram_rows as stream_ngrams
from ..streaming.ingest import running_counts, write_counts
from ..ship import ship
from . import fixtures as X
from . import oracles as O

K = 100
W3 = X.ngram_roles(3)
STOP_WORDS = ["the", "of", "and", "a", "in", "to", "is", "de", "la", "que", "el", "der", "die", "und", "le", "et", "les"]
TENSOR_COLUMNS = ("sii", "sc", "siiSoftPlus", "scSoftPlus", "siiShifted", "scShifted")
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def populated(df: DataFrame, roles: list[str], k: int, top_ks: tuple[int, ...] = (), tokens: bool = True, counts: DataFrame | None = None) -> DataFrame:
    p = assoc.populate(df, roles, top_ks or (k,), counts=counts)
    cells = assoc.with_tokens(p.cells, p.vocab, roles, k) if tokens else p.cells
    words = roles if tokens else []
    return rounded(cells, *TENSOR_COLUMNS).select("top_k", *[f"i{j}" for j in range(len(roles))], *words, "counting", *TENSOR_COLUMNS)


def populated_ngrams(spark: SparkSession, sf_dir: str, n: int, k: int, top_ks: tuple[int, ...] = (), tokens: bool = True) -> DataFrame:
    return populated(X.ngram_rows(spark, sf_dir, n), X.ngram_roles(n), k, top_ks, tokens, X.ngram_counts(spark, sf_dir, n))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word triples of documents with the strongest association."""
    return populated_ngrams(spark, sf_dir, 3, K).orderBy(F.desc("sc"), *W3)


# --- text ------------------------------------------------------------------------------------------------


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sentence_rows(spark, sf_dir)


def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.token_rows(spark, sf_dir).select("doc_id", "sent_pos", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("words"))


def trigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.ngram_counts(X.token_rows(spark, sf_dir), 3, X.stored_bytes(spark, sf_dir, "documents"))


def ngram_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several orders over one token table: rows and distinct rows of each."""
    return grams.order_counts(X.token_rows(spark, sf_dir), [3, 4, 5], X.stored_bytes(spark, sf_dir, "documents"))


def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.usable_texts(X.table(spark, sf_dir, "documents"), longest=2000)
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest"))


def core_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sentence_rows(spark, sf_dir).select("doc_id", "sent_pos", core_words(F.col("sentence"), STOP_WORDS).alias("core"))


def grammar_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_slots(X.parsed_sentences(spark, sf_dir), ["doc_id", "sent_pos"], LABELS["en"])


def grammar_slots_without_indirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A treebank without indirect objects: obj2 is the second object only."""
    found = sentence_slots(X.parsed_sentences(spark, sf_dir), ["doc_id", "sent_pos"], Labels(indirect=""))
    return found.groupBy("obj", "obj2").agg(F.count(F.lit(1)).alias("n"))


def legacy_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed tuples, one element with an apostrophe, parsed back."""
    part = X.table(spark, sf_dir, "part")
    printed = F.concat(F.lit("('"), F.col("p_brand"), F.lit("', \"it's "), F.col("p_type"), F.lit("\", '"), F.col("p_size").cast("string"), F.lit("')"))
    e = corpus.tuple_elements(printed, 3)
    plain = corpus.naive_elements(F.concat(F.lit("('"), F.col("p_brand"), F.lit("', '"), F.col("p_type"), F.lit("')")))
    return part.select("p_partkey", e[0].alias("brand"), e[1].alias("type"), e[2].alias("size"), plain[1].alias("naive_type"))


def stream_trigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming plan (sentences, tokens, n-grams, running counts) run to the end of the available data.

    The counts of every micro-batch are written to a table of its own; the last is the result.
    """
    source = f"{sf_dir}/documents.parquet"
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    # a stream watches folders; a single file is found in its own
    texts = reader.parquet(source) if is_folder(spark, source) else reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    return spark.read.parquet(write_counts(running_counts(stream_ngrams(texts, 3), ["w1", "w2"]), scratch_path(spark, "stream-counts")))


# --- vocabularies and association ------------------------------------------------------------------------


def vocabulary_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.vocabulary(X.ngram_counts(spark, sf_dir, 3), W3, K)


def vocabulary_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.vocabulary(X.ngram_counts(spark, sf_dir, 3), W3, K, shared=[(0, 1), (1, 2)])


def vocabulary_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent tokens of each language, one scan for all."""
    docs = X.table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    # texts go with their own language; only an id on more than one row has the languages of all of them
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    some = repeated.count()
    near = F.broadcast(repeated) if some <= vocab.MOST_BROADCAST else repeated
    rows = docs.join(near, "doc_id", "left_anti") if some else docs
    words = lambda x, *keep: tokens(sentences_of(usable_texts(x), *keep)).select(*keep, F.explode_outer("tokens").alias("token")).filter("token IS NOT NULL")
    counted = words(rows, "lang").groupBy("lang", "token").agg(F.count(F.lit(1)).alias("cnt"))
    if some:
        twice = docs.join(near, "doc_id", "left_semi")
        more = words(twice, "doc_id").groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("c")).join(twice.select("doc_id", "lang"), "doc_id").groupBy("lang", "token").agg(F.sum("c").alias("cnt"))
        counted = counted.union(more).groupBy("lang", "token").agg(F.sum("cnt").alias("cnt"))
    order = Window.partitionBy("lang").orderBy(F.desc("cnt"), F.asc("token"))
    return counted.withColumn("rank", F.row_number().over(order)).filter("rank <= 50")


def subset_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vocab.normalised(X.ngram_rows(spark, sf_dir, 3), W3)
    words = vocab.vocabulary(X.ngram_counts(spark, sf_dir, 3), W3, K).persist()  # read once for each role
    found = assoc.lattice(assoc.joint_counts(rows, words, W3, K), 3)
    return found.select("subset", "i0", "i1", "i2", "cnt")


def populate_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return populated_ngrams(spark, sf_dir, 3, K)


def populate_fourgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return populated_ngrams(spark, sf_dir, 4, 40)


def populate_fivegrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return populated_ngrams(spark, sf_dir, 5, 20)


def populate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return populated(X.order_rows(spark, sf_dir), X.ORDER_ROLES, 1000)


def populate_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return populated(X.market_rows(spark, sf_dir), X.MARKET_ROLES, 15)


def populate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return populated(X.event_rows(spark, sf_dir), X.EVENT_ROLES, 50)


def populate_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vocabulary sizes from one pass; shifts are each size's own."""
    return populated_ngrams(spark, sf_dir, 3, K, (10, 50, K), tokens=False)


def unknown_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vocab.normalised(X.order_rows(spark, sf_dir), X.ORDER_ROLES)
    words = vocab.vocabulary(vocab.marginals(rows, X.ORDER_ROLES), X.ORDER_ROLES, 4).persist()
    return vocab.replace_unknown(rows, words, X.ORDER_ROLES, 4).groupBy(*X.ORDER_ROLES).agg(F.count(F.lit(1)).alias("n"))


def known_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vocab.normalised(X.order_rows(spark, sf_dir), X.ORDER_ROLES)
    words = vocab.vocabulary(vocab.marginals(rows, X.ORDER_ROLES), X.ORDER_ROLES, 4).persist()
    flags = [f"known_{r}" for r in X.ORDER_ROLES]
    return vocab.in_vocabulary(rows, words, X.ORDER_ROLES, 4).groupBy(*flags, "known").agg(F.count(F.lit(1)).alias("n"))


def distinct_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.distinct_tuples(X.market_rows(spark, sf_dir), X.MARKET_ROLES)


def tuple_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sample(X.ngram_rows(spark, sf_dir, 3), W3, 500)


# --- frames ----------------------------------------------------------------------------------------------


def _blueprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, exemplars = X.frame_elements(spark, sf_dir)
    return frames.blueprint(elements, frames.element_frequency(exemplars))


def frame_blueprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blueprint(spark, sf_dir)


def frame_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.canonical_orders(_blueprint(spark, sf_dir))


def frame_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected frames (here: each part's brand, with its type as the element that was found)."""
    part = X.table(spark, sf_dir, "part")
    target = frames.target_word(F.concat(F.lit("say \""), F.col("p_name"), F.lit("\"")), F.lit(4))
    seen = part.select(F.col("p_partkey").alias("sent_id"), F.col("p_brand").alias("frame_name"), target.alias("target"), F.create_map("p_type", "p_name").alias("elements"))
    return frames.frame_rows(seen, frames.canonical_orders(_blueprint(spark, sf_dir)))


# --- tensors ---------------------------------------------------------------------------------------------


def tensor_unfolding(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = tensor.unfold(X.order_cells(spark, sf_dir), 3, 1)
    return flat.select(F.col("row").alias("i1"), F.col("column")[0].alias("i0"), F.col("column")[1].alias("i2"), F.col("value").cast("long").alias("value"))


def tensor_mode_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = X.order_model(spark, sf_dir)
    matrices = {j: tensor.matrix_table(spark, m.factors[j]) for j in (0, 2)}
    return rounded(tensor.multi_mode_product(X.order_cells(spark, sf_dir), 3, matrices), "value")


def tensor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = X.order_model(spark, sf_dir)
    shape = tuple(map(len, m.vocab))
    return rounded(tensor.inspect(X.order_cells(spark, sf_dir), shape), "density").withColumn("cost", F.lit(round(tensor.training_cost("kl", 5000, 10**6, 50), 6)))


def tensor_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.subsample(X.order_cells(spark, sf_dir), 3, 0.3, 7, exact=True)


def _kernel(spark: SparkSession, sf_dir: str) -> tuple[tucker.Cells, model.Tucker]:
    m, _ = X.order_model(spark, sf_dir)
    return tucker.Cells(X.order_cells(spark, sf_dir), tuple(map(len, m.vocab))), m


def _factor(spark: SparkSession, sf_dir: str, divergence: str) -> DataFrame:
    cells, m = _kernel(spark, sf_dir)
    out = tucker.update_factor(cells, m.core, m.factors, 0, divergence)
    return rounded(tensor.matrix_table(spark, out).withColumnRenamed("v", "value"), "value")


def kl_factor_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factor(spark, sf_dir, "kl")


def fr_factor_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factor(spark, sf_dir, "fr")


def _core(spark: SparkSession, sf_dir: str, divergence: str) -> DataFrame:
    cells, m = _kernel(spark, sf_dir)
    out = tucker.update_core(cells, m.core, m.factors, divergence)
    return rounded(model.Tucker(out, m.factors, m.vocab, m.roles).core_table(spark), "value")


def kl_core_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _core(spark, sf_dir, "kl")


def fr_core_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _core(spark, sf_dir, "fr")


def relative_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, m = _kernel(spark, sf_dir)
    found = [round(tucker.relative_error(cells, m.core, m.factors, d), 6) for d in ("kl", "fr")]
    return spark.createDataFrame([tuple(found)], "kl_error double, fr_error double")


def train_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short KL run over the softplus weights of trigrams: the error after each sweep."""
    p = assoc.populate(X.ngram_rows(spark, sf_dir, 3), W3, (K,), counts=X.ngram_counts(spark, sf_dir, 3))
    sizes = {r["role"]: r["n"] for r in p.vocab.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    # at most K ** 3 cells
    cells = tucker.Cells(p.tensor("siiSoftPlus"), tuple(sizes[r] for r in W3), on_driver=True)
    out = tucker.train(cells, tucker.Training(rank=(5, 5, 5), iterations=5))
    return spark.createDataFrame(out.errors, "iteration int, error double")


# --- model queries ---------------------------------------------------------------------------------------


def _tuples(m: model.Tucker, rows: DataFrame) -> DataFrame:
    return rows.select(*m.roles).distinct()


def tuple_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, rows = X.order_model(spark, sf_dir)
    return rounded(m.scores(_tuples(m, rows)), "score")


def _vectors(df: DataFrame, roles: list[str]) -> DataFrame:
    return df.select(*roles, F.round(F.col("vector")[0], 6).alias("x0"), F.round(F.col("vector")[1], 6).alias("x1"))


def predicted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, rows = X.order_model(spark, sf_dir)
    return _vectors(m.predictions(_tuples(m, rows), "brand"), m.roles)


def context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, rows = X.order_model(spark, sf_dir)
    return _vectors(m.contributions(_tuples(m, rows), "priority"), m.roles)


def _probe(m: model.Tucker) -> tuple[str, str, str]:
    return ("R", "1-URGENT", m.vocab[2][0])


def expected_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = X.order_model(spark, sf_dir)
    return spark.createDataFrame([(x["token"], round(x["score"], 6), round(x["activation_cosine"], 6)) for x in m.expected(_probe(m), "brand")], "token string, score double, activation_cosine double")


def similar_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = X.order_model(spark, sf_dir)
    return spark.createDataFrame([(t, round(c, 6)) for t, c in m.similar(m.vocab[2][0], "brand")], "token string, cosine double")


def top_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = X.order_model(spark, sf_dir)
    return rounded(m.combinations(spark, "R", "returnflag"), "score")


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = X.order_model(spark, sf_dir)
    return spark.createDataFrame([(t, round(v, 6)) for t, v in m.top_words("brand", 1)], "token string, score double")


def _cells(spark: SparkSession, array: np.ndarray) -> DataFrame:
    at = np.indices(array.shape).reshape(array.ndim, -1).T.tolist()
    return spark.createDataFrame([(*a, round(float(v), 6)) for a, v in zip(at, array.ravel())], ", ".join(f"r{j} int" for j in range(array.ndim)) + ", value double")


def role_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = X.order_model(spark, sf_dir)
    return _cells(spark, m.role_slice("brand"))


def tuple_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = X.order_model(spark, sf_dir)
    both = [_cells(spark, m.tuple_slice(_probe(m), "priority", w)).withColumn("weighted", F.lit(w)) for w in (False, True)]
    return both[0].union(both[1])


def contribution_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = X.order_model(spark, sf_dir)
    return _cells(spark, m.contribution(_probe(m)))


def top_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = X.order_model(spark, sf_dir)
    return spark.createDataFrame([(*at, round(v, 6)) for at, v in m.activations(_probe(m), "priority", "tuple", 3)], "r0 int, r2 int, value double")


def top_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = X.order_model(spark, sf_dir)
    return spark.createDataFrame([(d, round(v, 6)) for d, v in m.top_dimensions("R", "returnflag", 2)], "dimension int, value double")


def slot_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, rows = X.order_model(spark, sf_dir)
    return rounded(evaluate.metrics(m, _tuples(m, rows)), *[k for k in evaluate.KEYS if k != "OOV"])


def extension_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the brands outside the ten most frequent."""
    m, rows = X.order_model(spark, sf_dir, k=10)
    found = extend.extend(m, rows, "brand")
    return found.select("role", "token", "cnt", F.round(F.col("vec")[0], 6).alias("x0"), F.round(F.col("vec")[1], 6).alias("x1"))


def extension_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, rows = X.order_model(spark, sf_dir, k=10)
    found = extend.extend(m, rows, "brand", normalise="minmax", min_count=10, top_k=8)
    return found.select("role", "token", "cnt", F.round(F.col("vec")[0], 6).alias("x0"), F.round(F.col("vec")[1], 6).alias("x1"))


def extension_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, rows = X.order_model(spark, sf_dir, k=10)
    return extend.contexts(m, rows, "brand").groupBy("brand").agg(F.sum("times").alias("n"))


def extended_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor table of a model with its extensions integrated."""
    m, rows = X.order_model(spark, sf_dir, k=10)
    out = extend.integrate(m, extend.extend(m, rows, "brand"))
    return out.factor_table(spark).filter("role = 'brand'").select("idx", "token", F.round(F.col("vec")[0], 6).alias("x0"), F.round(F.col("vec")[1], 6).alias("x1"))


def extended_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All brands that can be looked up: the ten of the vocabulary, then the extensions."""
    m, rows = X.order_model(spark, sf_dir, k=10)
    found = extend.look_up(m, extend.extend(m, rows, "brand"), "brand")
    return found.select("token", "extended", F.round(F.col("vec")[0], 6).alias("x0"), F.round(F.col("vec")[1], 6).alias("x1"))


def sampled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 distinct tuples of a stored table, from as few of its blocks as it takes."""
    return evaluate.sampled_scan(spark, f"{sf_dir}/orders.parquet", ["o_orderstatus", "o_orderpriority", "o_custkey"], 300)


def unrestricted_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.unrestricted_joints(vocab.normalised(X.order_rows(spark, sf_dir), X.ORDER_ROLES), X.ORDER_ROLES)


def fr_core_with_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The updated core, each cell with the error before the update."""
    cells, m = _kernel(spark, sf_dir)
    core, error = tucker.fr_core_and_error(cells, m.core, m.factors)
    return rounded(model.Tucker(core, m.factors, m.vocab, m.roles).core_table(spark), "value").withColumn("error", F.lit(round(error, 6)))


def tensor_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfolded along each mode and folded back: three times every cell, added."""
    cells = X.order_cells(spark, sf_dir)
    both = None
    for mode in range(3):
        one = tensor.fold(tensor.unfold(cells, 3, mode), 3, mode)
        both = one if both is None else both.union(one)
    return tensor.coalesce_cells(both, 3).select("i0", "i1", "i2", F.col("value").cast("long").alias("value"))


def linear_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by one linear index, and the coordinates it gives back."""
    m, _ = X.order_model(spark, sf_dir)
    shape = tuple(map(len, m.vocab))
    at = X.order_cells(spark, sf_dir).withColumn("at", tensor.ravel(shape, [F.col(f"i{j}") for j in range(3)]))
    return at.select(F.col("at").cast("long").alias("at"), *[c.alias(f"j{j}") for j, c in enumerate(tensor.unravel(shape, F.col("at")))])


def dense_times_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first factor, transposed, times the tensor unfolded along its mode."""
    m, _ = X.order_model(spark, sf_dir)
    left = tensor.matrix_table(spark, m.factors[0].T)
    out = tensor.dense_times_sparse(left, tensor.unfold(X.order_cells(spark, sf_dir), 3, 0))
    return rounded(out.select("i", F.col("column")[0].alias("i1"), F.col("column")[1].alias("i2"), "value"), "value")


def linked_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two roles that share their tokens: brands as extensions of one, every second also of the other."""
    part = X.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("token")).agg(F.count(F.lit(1)).alias("cnt"), F.sum("p_size").alias("s"))
    vec = F.array(F.col("s").cast("double"), F.col("cnt").cast("double"))
    a = part.select(F.lit("a").alias("role"), "token", "cnt", vec.alias("vec"))
    b = part.filter("s % 2 = 0").select(F.lit("b").alias("role"), "token", (F.col("cnt") * 2).alias("cnt"), F.transform(vec, lambda x: x / 2).alias("vec"))
    out = extend.merge_linked(a.union(b), "a", "b")
    return out.select("role", "token", "cnt", F.round(F.col("vec")[0], 6).alias("x0"), F.round(F.col("vec")[1], 6).alias("x1"))


def best_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, rows = X.order_model(spark, sf_dir, k=10)
    return extend.best(extend.extend(m, rows, "brand"), "brand", 5).select("role", "token", "cnt")


def checked_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows are known with and without the extension."""
    m, rows = X.order_model(spark, sf_dir, k=10)
    extension = extend.extend(m, rows, "brand", top_k=8)
    return extend.check_tuples(m, rows, extension).groupBy("known").agg(F.count(F.lit(1)).alias("n"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows by cosine for every hundredth vector."""
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return rounded(nearest(e.filter("vec_id % 100 = 0"), e, 5), "cosine").withColumnRenamed("id", "vec_id")


QUERIES: list[Query] = [
    sentences, sentence_tokens, trigram_counts, ngram_orders, text_filter, core_phrases, grammar_slots, grammar_slots_without_indirect, legacy_tuples, stream_trigram_counts,
    vocabulary_top_k, vocabulary_linked, vocabulary_by_language, subset_lattice, populate_trigrams, populate_fourgrams, populate_fivegrams, populate_orders, populate_markets, populate_events, populate_nested,
    unknown_replaced, known_tuples, distinct_tuples, tuple_sample, frame_blueprints, frame_orders, frame_arguments,
    tensor_unfolding, tensor_mode_product, tensor_summary, tensor_subsample, kl_factor_update, fr_factor_update, kl_core_update, fr_core_update, relative_errors, train_trigrams,
    tuple_scores, predicted_vectors, context_vectors, expected_elements, similar_elements, top_combinations, top_words, role_slices, tuple_slices, contribution_cells, top_activations, top_dimensions,
    slot_prediction, extension_vectors, extension_minmax, extension_contexts, extended_model, extended_lookup, linked_extensions, best_extensions, checked_tuples, nearest_vectors,
    sampled_scan, unrestricted_joints, fr_core_with_error, tensor_fold, linear_index, dense_times_sparse,
]


def shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {q.__name__: shipped(q) for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    tri, text = f"{O.SENT}, {O.ngram_cte(3)}", O.SENT
    counted = " UNION ALL ".join(f"SELECT {n}::INT AS n, (SELECT count(*) FROM g{n})::BIGINT AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(X.ngram_roles(n))} FROM g{n}))::BIGINT AS n_distinct" for n in (3, 4, 5))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    known = f"{O.ORDERS}, {O.vocab_cte(X.ORDER_ROLES, 4)}"
    has = lambda r: f"{r} IN (SELECT token FROM voc WHERE role = '{r}')"
    obj2 = O.SLOTS.replace("(dep = 'dobj' AND k = 2) OR (dep = 'dative' AND k = 1)", "dep = 'dobj' AND k = 2")
    probe = "JOIN f0 a ON a.token = 'R' AND a.r = p JOIN f1 b ON b.token = '1-URGENT' AND b.r = q JOIN f2 c ON c.i = 0 AND c.r = s"
    sliced = f"SELECT p::INT AS r0, s::INT AS r1, round(sum(core.v * a.v * c.v), 6) AS value, false AS weighted FROM core {probe} GROUP BY p, s UNION ALL SELECT p::INT, s::INT, round(sum(core.v * a.v * b.v * c.v), 6), true FROM core {probe} GROUP BY p, s"
    extended = O.EXTENDED.replace("SELECT 'brand' AS role, token, cnt::BIGINT AS cnt, round(v0 * f, 6) AS x0, round(v1 * f, 6) AS x1 FROM", "SELECT i::INT AS idx, token, round(max(v) FILTER (r = 0), 6) AS x0, round(max(v) FILTER (r = 1), 6) AS x1 FROM f2 GROUP BY i, token UNION ALL SELECT (9 + row_number() OVER (ORDER BY cnt DESC, token))::INT, token, round(v0 * f, 6), round(v1 * f, 6) FROM")
    arguments = ", ".join(f"coalesce(max(CASE WHEN slot = {j} AND element = p_type THEN p_name END), '~') AS arg{j + 1}" for j in range(5))
    return {
        "sentences": f"WITH {text} SELECT doc_id, sent_pos::INT AS sent_pos, sentence FROM sent WHERE trim(sentence) <> ''",
        "sentence_tokens": f"WITH {text} SELECT doc_id, sent_pos::INT AS sent_pos, len(t)::INT AS n, array_to_string(t, ' ') AS words FROM tok",
        "trigram_counts": f"WITH {tri} SELECT w1, w2, w3, count(*)::BIGINT AS cnt FROM rows GROUP BY 1, 2, 3",
        "ngram_orders": f"WITH {text}, {', '.join(O.ngram_cte(n, f'g{n}') for n in (3, 4, 5))} {counted}",
        "text_filter": "SELECT lang, count(*)::BIGINT AS n, max(length(text))::INT AS longest FROM documents WHERE length(text) BETWEEN 1 AND 2000 GROUP BY lang",
        "core_phrases": f"WITH {text} SELECT doc_id, sent_pos::INT AS sent_pos, CASE WHEN len(t) = 0 THEN '~' WHEN len(list_filter(t, lambda x: x NOT IN ({stop}))) > 0 THEN array_to_string(list_filter(t, lambda x: x NOT IN ({stop})), ' ') ELSE array_to_string(t, ' ') END AS core FROM tok",
        "grammar_slots": O.SLOTS,
        "grammar_slots_without_indirect": f"SELECT obj, obj2, count(*)::BIGINT AS n FROM ({obj2}) GROUP BY 1, 2",
        "legacy_tuples": "SELECT p_partkey, p_brand AS brand, 'it''s ' || p_type AS type, p_size::VARCHAR AS size, p_type AS naive_type FROM part",
        "stream_trigram_counts": f"WITH {tri} SELECT role, token, cnt::BIGINT AS cnt FROM (SELECT 'w1' AS role, w1 AS token, count(*) AS cnt FROM rows GROUP BY 2 UNION ALL SELECT 'w2', w2, count(*) FROM rows GROUP BY 2)",
        "vocabulary_top_k": O.vocab_sql(tri, W3, K),
        "vocabulary_linked": O.linked_sql(tri, W3, K),
        "vocabulary_by_language": f"WITH {text} SELECT lang, token, cnt::BIGINT AS cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, token)::INT AS rank FROM (SELECT lang, token, count(*) AS cnt FROM (SELECT doc_id, unnest(t) AS token FROM tok) JOIN documents USING (doc_id) GROUP BY 1, 2) QUALIFY rank <= 50",
        "subset_lattice": O.lattice_sql(tri, W3, K),
        "populate_trigrams": O.populate_sql(tri, W3, K),
        "populate_fourgrams": O.populate_sql(f"{text}, {O.ngram_cte(4)}", X.ngram_roles(4), 40),
        "populate_fivegrams": O.populate_sql(f"{text}, {O.ngram_cte(5)}", X.ngram_roles(5), 20),
        "populate_orders": O.populate_sql(O.ORDERS, X.ORDER_ROLES, 1000),
        "populate_markets": O.populate_sql(O.MARKET, X.MARKET_ROLES, 15),
        "populate_events": O.populate_sql(O.EVENTS, X.EVENT_ROLES, 50),
        "populate_nested": O.populate_sql(tri, W3, K, (10, 50, K), tokens=False),
        "unknown_replaced": f"WITH {known} SELECT {', '.join(f'''CASE WHEN {has(r)} THEN {r} ELSE '~' END AS {r}''' for r in X.ORDER_ROLES)}, count(*)::BIGINT AS n FROM rows GROUP BY 1, 2, 3",
        "known_tuples": f"WITH {known} SELECT {', '.join(f'{has(r)} AS known_{r}' for r in X.ORDER_ROLES)}, {' AND '.join(has(r) for r in X.ORDER_ROLES)} AS known, count(*)::BIGINT AS n FROM rows GROUP BY 1, 2, 3, 4",
        "distinct_tuples": f"WITH {O.MARKET} SELECT DISTINCT * FROM rows",
        "frame_blueprints": O.BLUEPRINT,
        "frame_orders": O.CANONICAL,
        "frame_arguments": f"WITH canon AS ({O.CANONICAL}) SELECT p_partkey AS sent_id, p_brand AS frame_name, regexp_replace(string_split_regex(trim(p_name || '\"'), '\\s+')[1], '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS target, {arguments} FROM part LEFT JOIN canon ON frame = p_brand GROUP BY 1, 2, 3",
        "tensor_unfolding": O.with_model("SELECT i1::INT AS i1, i0::INT AS i0, i2::INT AS i2, x::BIGINT AS value FROM nz"),
        "tensor_mode_product": O.with_model("SELECT f0.r::INT AS i0, i1::INT AS i1, f2.r::INT AS i2, round(sum(x * f0.v * f2.v), 6) AS value FROM nz JOIN f0 ON f0.i = i0 JOIN f2 ON f2.i = i2 GROUP BY f0.r, i1, f2.r"),
        "tensor_summary": O.with_model("SELECT 3::INT AS \"order\", count(*)::BIGINT AS nnz, n::DOUBLE AS cells, round(count(*) / n, 6) AS density, (count(*) * 28)::BIGINT AS coo_bytes, min(x)::BIGINT AS least, max(x)::BIGINT AS most, sum(x)::BIGINT AS total, round(pow(50, 1.76) * pow(5000, 0.16) * pow(1e6, 0.78) * 1e-9 + pow(50, 2.6) * 1e6 * 1e-10, 6) AS cost FROM nz, (SELECT product(c) AS n FROM (SELECT count(*)::DOUBLE AS c FROM voc GROUP BY role)) GROUP BY n"),
        "kl_factor_update": O.KL_FACTOR,
        "fr_factor_update": O.FR_FACTOR,
        "kl_core_update": O.KL_CORE,
        "fr_core_update": O.FR_CORE,
        "relative_errors": O.ERRORS,
        "tuple_scores": O.SCORES,
        "predicted_vectors": O.vectors_sql(2, False),
        "context_vectors": O.vectors_sql(1, True),
        "expected_elements": O.EXPECTED,
        "similar_elements": O.SIMILAR,
        "top_combinations": O.COMBINATIONS,
        "top_words": O.TOP_WORDS,
        "role_slices": O.with_model("SELECT i::INT AS r0, p::INT AS r1, q::INT AS r2, round(sum(core.v * f2.v), 6) AS value FROM f2 JOIN core ON s = r GROUP BY i, p, q"),
        "tuple_slices": O.with_model(sliced),
        "contribution_cells": O.with_model(f"SELECT p::INT AS r0, q::INT AS r1, s::INT AS r2, round(core.v * a.v * b.v * c.v, 6) AS value FROM core {probe}"),
        "top_activations": O.with_model(f"SELECT p::INT AS r0, s::INT AS r2, round(sum(core.v * a.v * c.v), 6) AS value FROM core {probe} GROUP BY p, s ORDER BY sum(core.v * a.v * c.v) DESC, p, s LIMIT 3"),
        "top_dimensions": O.with_model("SELECT r::INT AS dimension, round(v, 6) AS value FROM f0 WHERE token = 'R'"),
        "slot_prediction": O.METRICS,
        "extension_vectors": O.EXTENDED,
        "extension_contexts": O.with_model("SELECT brand, count(*)::BIGINT AS n FROM rows WHERE brand NOT IN (SELECT token FROM voc WHERE role = 'brand') GROUP BY brand", k=10),
        "extended_model": extended,
        "extended_lookup": f"SELECT token, idx >= 10 AS extended, x0, x1 FROM ({extended})",
        "linked_extensions": O.LINKED_EXTENSIONS,
        "best_extensions": f"SELECT role, token, cnt FROM ({O.EXTENDED}) ORDER BY cnt DESC, token LIMIT 5",
        "checked_tuples": O.with_model(f"SELECT returnflag IN (SELECT token FROM voc WHERE role = 'returnflag') AND priority IN (SELECT token FROM voc WHERE role = 'priority') AND (brand IN (SELECT token FROM voc WHERE role = 'brand') OR brand IN (SELECT brand FROM rows WHERE brand NOT IN (SELECT token FROM voc WHERE role = 'brand') AND returnflag IN (SELECT token FROM voc WHERE role = 'returnflag') AND priority IN (SELECT token FROM voc WHERE role = 'priority') GROUP BY brand ORDER BY count(*) DESC, brand LIMIT 8)) AS known, count(*)::BIGINT AS n FROM rows GROUP BY 1", k=10),
        "unrestricted_joints": f"WITH {O.ORDERS} SELECT returnflag, priority, brand, grouping(returnflag, priority, brand)::INT AS subset, count(*)::BIGINT AS cnt FROM rows GROUP BY GROUPING SETS ((returnflag), (priority), (brand), (returnflag, priority), (returnflag, brand), (priority, brand), (returnflag, priority, brand))",
        "fr_core_with_error": f"SELECT c.*, e.fr_error AS error FROM ({O.FR_CORE}) c, ({O.ERRORS}) e",
        "tensor_fold": O.with_model("SELECT i0::INT AS i0, i1::INT AS i1, i2::INT AS i2, (3 * x)::BIGINT AS value FROM nz"),
        "linear_index": O.with_model("SELECT ((i0 * (SELECT count(*) FROM voc WHERE role = 'priority') + i1) * (SELECT count(*) FROM voc WHERE role = 'brand') + i2)::BIGINT AS at, i0::BIGINT AS j0, i1::BIGINT AS j1, i2::BIGINT AS j2 FROM nz"),
        "dense_times_sparse": O.with_model("SELECT f0.r::INT AS i, i1::INT AS i1, i2::INT AS i2, round(sum(x * f0.v), 6) AS value FROM nz JOIN f0 ON f0.i = i0 GROUP BY f0.r, i1, i2"),
        "nearest_vectors": O.NEAREST,
    }
