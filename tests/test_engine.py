import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyad import config
from polyad.functions import text as T
from polyad.functions.scores import softplus
from polyad.operators import assoc, evaluate, extend, frames, tensor, tucker, vocab
from polyad.operators.model import Tucker, UnknownToken
from polyad.plans import registry
from polyad.sources import corpus, store
from polyad.streaming import ingest

ROLES = ["x", "y", "z"]


def rows(spark, data, roles=ROLES):
    return spark.createDataFrame(data, ", ".join(f"{r} string" for r in roles))


def test_missing_slots_count(spark):
    df = rows(spark, [(None, "", "~"), ("a", None, "c")])
    got = {(r.role, r.token): r.cnt for r in vocab.marginals(vocab.normalised(df, ROLES), ROLES).collect()}
    assert got == {("x", "~"): 1, ("x", "a"): 1, ("y", "~"): 2, ("z", "~"): 1, ("z", "c"): 1}


def test_vocabulary_ties(spark):
    df = rows(spark, [("b",), ("b",), ("a",), ("a",), ("c",)], ["x"])
    got = vocab.vocabulary(vocab.marginals(df, ["x"]), ["x"], 2).orderBy("idx").collect()
    assert [(r.idx, r.token, r.cnt) for r in got] == [(0, "a", 2), (1, "b", 2)]


def test_linked_vocabulary(spark):
    df = rows(spark, [("a", "b"), ("b", "a"), ("z", "b"), ("b", "a"), ("a", "b"), ("z", "a")], ["x", "y"])
    got = vocab.vocabulary(vocab.marginals(df, ["x", "y"]), ["x", "y"], 3, shared=[(0, 1)])
    assert [[r.token for r in got.filter(f"role = '{r}'").orderBy("idx").collect()] for r in ("x", "y")] == [["b", "a", "z"]] * 2
    assert got.filter("role = 'y' AND token = 'z'").first().cnt == 0


def test_groups():
    assert vocab.groups(4, [(0, 1), (1, 2)]) == [[0, 1, 2], [3]]
    assert vocab.shared_suffix([[1, 2], [0], [3, 4]]) == "_shared12_shared34"
    assert tucker.partners(3, ((0, 1), (1, 2)), False) == {0: [1], 1: [0, 2], 2: [1]}
    assert tucker.partners(3, ((0, 1), (1, 2)), True)[0] == [1, 2]
    with pytest.raises(ValueError, match="linked"):
        vocab.groups(2, [(0, 2)])


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_populate_by_hand(spark, n):
    data = [("x", "y", "z", "q"), ("x", "y", "z", "q"), ("x", "y", "w", "q"), ("u", "v", "w", "p")]
    roles = ["a", "b", "c", "d"][:n]
    p = assoc.populate(rows(spark, [d[:n] for d in data], roles), roles, (10,))
    cells = assoc.with_tokens(p.cells, p.vocab, roles, 10).collect()
    tuples = {d[:n] for d in data}
    assert len(cells) == len(tuples)
    for c in cells:
        t = tuple(c[r] for r in roles)
        share = lambda s: sum(all(d[j] == t[j] for j in s) for d in data) / len(data)  # noqa: B023, E731
        sii = sum((1 if len(s) % 2 == 0 else -1) * math.log(share(s)) for k in range(1, n + 1) for s in combinations(range(n), k))
        sc = math.log(share(range(n))) - sum(math.log(share([j])) for j in range(n)) if n > 1 else 0
        assert c.counting == share(range(n)) * 4 and c.sii == pytest.approx(sii) and c.sc == pytest.approx(sc)
        assert c.siiShifted == pytest.approx(c.sii - min(x.sii for x in cells) + 1e-8) and c.scSoftPlus == pytest.approx(math.log1p(math.exp(c.sc)))


def test_pairs_count_rows_with_an_unknown_third(spark):
    df = rows(spark, [("a", "b", "c"), ("a", "b", "d"), ("a", "b", "c")])
    words = vocab.vocabulary(vocab.marginals(df, ROLES), ROLES, 1)
    got = {r.subset: r.cnt for r in assoc.lattice(assoc.joint_counts(df, words, ROLES, 1), 3).collect()}
    assert got[assoc.subset_id((0, 1), 3)] == 3 and got[assoc.subset_id((0, 1, 2), 3)] == 2


def test_nothing_to_populate(spark):
    p = assoc.populate(rows(spark, []), ROLES, (5,))
    assert p.total == 0 and p.cells.count() == 0
    with pytest.raises(ValueError, match="method"):
        p.tensor("other")


def test_softplus(spark):
    got = spark.createDataFrame([(-3.0,), (0.0,), (25.0,)], "v double").select(softplus(registry.F.col("v")).alias("s")).collect()
    assert [round(r.s, 6) for r in got] == [0.048587, 0.693147, 25.0]


def test_ngrams_of_short_rows(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c", "d"]), (4, [])], "id int, tokens array<string>")
    assert sorted(map(tuple, T.ngrams(df, 3).collect())) == [(3, "a", "b", "c"), (3, "b", "c", "d")]


def test_text_rules(spark):
    df = spark.createDataFrame([(1, "The cat. A dog!  \n\nEnd"), (2, ""), (3, None), (4, "x" * 60)], "doc_id int, text string")
    kept = T.usable_texts(df, longest=50)
    assert [r.doc_id for r in kept.collect()] == [1]
    got = T.tokens(T.sentences(kept)).orderBy("sent_pos").collect()
    assert [(r.sent_pos, r.tokens) for r in got] == [(0, ["the", "cat"]), (1, ["a", "dog"]), (2, ["end"])] or [r.tokens for r in got] == [["the", "cat"], ["a", "dog"], ["end"]]
    lemmas = spark.createDataFrame([("cat", "feline")], "word string, lemma string")
    assert T.tokens(T.sentences(kept), lemmas).orderBy("sent_pos").first().tokens == ["the", "feline"]
    core = spark.createDataFrame([("The cat",), ("the",), ("~",), (None,), ("",), ("!",)], "s string").select(T.core_words(registry.F.col("s"), ["the"]).alias("c"))
    assert [r.c for r in core.collect()] == ["cat", "the", "~", None, "", "~"]


def test_slots(spark):
    def tok(i, lemma, pos, dep, head, sid=1):
        return (sid, i, lemma, pos, dep, head)

    data = [tok(0, "old", "ADJ", "amod", 1), tok(1, "man", "NOUN", "nsubj", 2), tok(2, "give", "VERB", "root", 2), tok(3, "boy", "NOUN", "dative", 2), tok(4, "red", "ADJ", "amod", 5), tok(5, "ball", "NOUN", "dobj", 2), tok(6, "toy", "NOUN", "dobj", 2), tok(7, "man2", "NOUN", "nsubj", 2)]
    data += [tok(0, "nice", "ADJ", "root", 0, 2), tok(0, "run", "VERB", "root", 0, 3)]
    got = {r.sid: r for r in T.slots(spark.createDataFrame(data, "sid int, i int, lemma string, pos string, dep string, head int"), ["sid"]).collect()}
    assert tuple(got[1])[1:] == ("give", "man", "ball", "boy", "~", "old", "red") and 2 not in got and tuple(got[3])[1:] == ("run", *["~"] * 6)


def test_printed_tuples(spark, tmp_path):
    (tmp_path / "v.csv").write_text("sent_id,vector,sentence_text\n1,\"('a', \"\"b's\"\", 'c')\",\"x, \"\"y\"\"\"\n2,\"('~', 'q', 'r', 's')\",z\n3,bad,z\n")
    got = corpus.read_legacy(spark, f"{tmp_path}/v.csv", ROLES).orderBy("sent_id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "b's", "c", 'x, "y"'), (2, "~", "q", "r", "z")]


def small(seed=0, shape=(7, 6, 5), rank=(2, 3, 2)):
    r = np.random.default_rng(seed)
    return r.random(rank) + 0.1, [r.random((s, k)) + 0.1 for s, k in zip(shape, rank)]


def dense(core, factors):
    return np.einsum("pqr,ip,jq,kr->ijk", core, *factors)


@pytest.mark.parametrize("local", [False, True])
@pytest.mark.parametrize("divergence", ["kl", "fr"])
def test_updates_match_dense_algebra(spark, local, divergence):
    core, factors = small()
    x = np.random.default_rng(1).random((7, 6, 5)) * (np.random.default_rng(2).random((7, 6, 5)) < 0.4)
    cells = tucker.Cells(tensor.from_dense(spark, x).repartition(3), x.shape, on_driver=local)
    z = np.einsum("pqr,jq,kr->pjk", core, *factors[1:]).reshape(2, -1)
    flat, hat = x.reshape(7, -1), factors[0] @ z
    if divergence == "kl":
        want = factors[0] * ((flat / hat) @ z.T) / z.sum(1)
    else:
        want = factors[0] * (flat @ z.T) / (hat @ z.T)
    assert np.allclose(tucker.update_factor(cells, core, factors, 0, divergence), np.maximum(want, 1e-12))
    ones = np.ones_like(x) if divergence == "kl" else dense(core, factors)
    top = np.einsum("ijk,ip,jq,kr->pqr", x / dense(core, factors) if divergence == "kl" else x, *factors)
    assert np.allclose(tucker.update_core(cells, core, factors, divergence), core * top / np.einsum("ijk,ip,jq,kr->pqr", ones, *factors))
    r = dense(core, factors)
    kl = (np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / r), 0) - x + r).sum() / x.sum()
    fr = np.linalg.norm(x - r) / np.linalg.norm(x)
    assert tucker.relative_error(cells, core, factors, divergence) == pytest.approx(kl if divergence == "kl" else fr)


@pytest.mark.parametrize("divergence", ["kl", "fr"])
def test_training_lowers_the_error(spark, divergence):
    core, factors = small(3)
    x = dense(core, factors) * (np.random.default_rng(4).random((7, 6, 5)) < 0.6)
    cells = tucker.Cells(tensor.from_dense(spark, x), x.shape)
    out = tucker.train(cells, tucker.Training((2, 2, 2), divergence, iterations=12, tol=0))
    errors = [e for _, e in out.errors]
    assert len(errors) == 12 and all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))
    again = tucker.train(cells, tucker.Training((2, 2, 2), divergence, iterations=12, tol=0), start=tucker.train(cells, tucker.Training((2, 2, 2), divergence, iterations=5, tol=0)))
    assert np.allclose(again.core, out.core)
    stopped = tucker.train(cells, tucker.Training((2, 2, 2), divergence, iterations=50, tol=10.0, patience=3))
    assert stopped.stopped == "reconstruction" and stopped.iterations == 4
    part = tucker.train(cells, tucker.Training((2, 2, 2), divergence, iterations=3, share=0.5, normalise=True))
    assert all(np.allclose(np.linalg.norm(f, axis=0), 1) for f in part.factors)


def test_sharing_and_semantic_stop(spark):
    x = np.random.default_rng(5).random((5, 5, 5))
    cells = tucker.Cells(tensor.from_dense(spark, x), x.shape)
    out = tucker.train(cells, tucker.Training((2, 2, 2), iterations=2, shared=((0, 1), (1, 2))))
    assert np.array_equal(out.factors[0], out.factors[2])
    direct = tucker.train(cells, tucker.Training((2, 2, 2), iterations=2, shared=((0, 1), (1, 2)), transitive=False))
    assert np.array_equal(direct.factors[1], direct.factors[2]) and not np.array_equal(direct.factors[0], direct.factors[1])
    values = iter([0.5, 0.9, 0.2, 0.1, 0.1])
    best = tucker.train(cells, tucker.Training((2, 2, 2), iterations=9, semantic_every=1, patience=2), evaluate=lambda c, f: {"average_rank_score": next(values)})
    assert best.stopped == "semantics" and best.iterations == 2


def model():
    core, factors = small(6, (4, 3, 3))
    return Tucker(core, factors, [["a", "b", "c", "~"], ["d", "e", "f"], ["g", "h", "~"]], ROLES)


def test_model_queries(spark):
    m = model()
    v = m.latents(t := ("b", "d", "h"))
    assert m.score(t) == pytest.approx(np.einsum("pqr,p,q,r->", m.core, *v))
    assert np.allclose(m.excluded(("?", "d", "h"), "x"), np.einsum("pqr,q,r->p", m.core, *v[1:]))
    assert np.allclose(m.included(t, "y"), np.einsum("pqr,p,q,r->q", m.core, *v))
    assert np.allclose(m.role_slice("y"), np.einsum("Zq,pqr->Zpr", m.factors[1], m.core))
    assert np.allclose(m.slice(t, "y", "tuple"), np.einsum("pqr,p,r->pr", m.core, v[0], v[2]))
    assert np.allclose(m.slice(t, "y", "weighted_tuple"), np.einsum("pqr,p,q,r->pr", m.core, *v))
    assert m.check(("a", "zz", "g")) == (True, False, True) and m.similar("b", "x")[0][0] == "b"
    assert {x["token"] for x in m.expected(t, "z", metric="cosine")} == {"g", "h", "~"}
    with pytest.raises(UnknownToken):
        m.latent("nope", "x")
    got = m.combinations(spark, "d", "y", k=50, only={"x": ["b", "a", "nope"]}).collect()
    assert len(got) == 4 and all(r.score == pytest.approx(m.score((r.x, "d", r.z))) for r in got)
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    table = rows(spark, [t, ("zz", "d", "h"), ("a", "e", "g")])
    scored = {r.x: r.score for r in m.scores(table).collect()}
    assert scored["b"] == pytest.approx(m.score(t)) and scored["zz"] is None
    assert np.allclose({r.x: r.vector for r in m.predictions(table, "x").collect()}["zz"], m.excluded(t, "x"))


def test_metrics(spark):
    m = model()
    data = [("b", "d", "h"), ("~", "e", "g"), ("zz", "d", "h")]
    got = evaluate.evaluate(m, rows(spark, data))
    ranks, probs, shown = [], [], []
    for t in data[:2]:
        for j, r in enumerate(ROLES):
            w, f = m.excluded(t, r), m.factors[j]
            cos = f @ w / np.linalg.norm(w) / np.linalg.norm(f, axis=1)
            i = m.index[j][t[j]]
            ranks.append(1 / (cos >= cos[i]).sum())
            probs.append(np.exp(cos[i] / 0.1) / np.exp(cos / 0.1).sum())
            shown.append(probs[-1] * (t[j] != "~"))
    want = (sum(ranks) / 9, sum(probs) / 9, sum(ranks) / 6, sum(probs) / 6, 1, 1 / 3, sum(shown) / 6, 1 / 6)
    assert [got[k] for k in evaluate.KEYS] == pytest.approx(list(want))
    none = evaluate.evaluate(m, rows(spark, [("zz", "d", "h")]))
    assert none["OOV_rate"] == 1 and none["absolute_rank_score"] == 0
    with pytest.raises(ValueError, match="no such"):
        evaluate.evaluate(m, rows(spark, data), keys="other")


def test_extension(spark, tmp_path):
    m = model()
    data = [("n1", "d", "h"), ("n1", "e", "g"), ("n1", "e", "g"), ("n2", "d", "h"), ("n3", "zz", "h"), ("a", "d", "h")]
    got = {r.token: r for r in extend.extend(m, rows(spark, data), "x", normalise=None).collect()}
    assert set(got) == {"n1", "n2"} and got["n1"].cnt == 3
    assert np.allclose(got["n1"].vec, (m.excluded(data[0], "x") + 2 * m.excluded(data[1], "x")) / 3)
    found = extend.extend(m, rows(spark, data), "x")
    target = np.median(np.linalg.norm(m.factors[0], axis=1))
    assert all(np.linalg.norm(r.vec) == pytest.approx(target) for r in found.collect())
    assert [r.token for r in extend.extend(m, rows(spark, data), "x", top_k=1).collect()] == ["n1"]
    bigger = extend.integrate(m, found)
    assert bigger.vocab[0] == [*m.vocab[0], "n1", "n2"] and bigger.check(("n2", "d", "h")) == (True,) * 3
    with pytest.raises(ValueError, match="asked for"):
        extend.integrate(m, found, top_k=3)
    store.write_extension(found, f"{tmp_path}/e")
    assert store.read_extension(spark, f"{tmp_path}/e", m, found.limit(0)).count() == 2
    assert {r.x for r in extend.check_tuples(m, rows(spark, data), found).filter("known").collect()} == {"n1", "n2", "a"}
    flat = extend.minmax_normalised(spark.createDataFrame([("t", 1, [1.0, 2.0])], "token string, cnt int, vec array<double>"), m.factors[0])
    low, high = np.percentile(m.factors[0], [1, 99], axis=0)
    assert np.allclose(flat.first().vec, (low + high) / 2)


def test_linked_extensions(spark):
    table = spark.createDataFrame([("x", "t", 3, [1.0, 0.0]), ("y", "t", 1, [0.0, 1.0]), ("y", "u", 2, [5.0, 5.0])], extend.EXTENSION)
    got = {(r.role, r.token): (r.cnt, r.vec) for r in extend.merge_linked(table, "x", "y").collect()}
    assert got["x", "t"] == got["y", "t"] == (4, [0.75, 0.25]) and got["x", "u"] == (2, [5.0, 5.0])


def test_store(spark, tmp_path):
    m = model()
    store.write_model(spark, m, f"{tmp_path}/m")
    back = store.read_model(spark, f"{tmp_path}/m")
    assert back.vocab == m.vocab and np.array_equal(back.core, m.core) and all(map(np.array_equal, back.factors, m.factors))
    p = assoc.populate(rows(spark, [("a", "b", "c"), ("a", "d", "c")]), ROLES, (1, 2))
    store.write_populated(p, f"{tmp_path}/p")
    assert store.read_tensor(spark, f"{tmp_path}/p", "counting", 2).count() == 2
    with pytest.raises(ValueError, match="top_k"):
        store.read_tensor(spark, f"{tmp_path}/p", "sii", 7)
    result = tucker.Result(m.core, m.factors, [(0, 0.5)], [], 3)
    settings = config.Decomposition(rank=(2, 3, 2)).structure()
    store.write_checkpoint(spark, f"{tmp_path}/c", 3, result, m.vocab, ROLES, settings)
    found, _ = store.latest_checkpoint(spark, f"{tmp_path}/c", settings)
    assert found.iterations == 3 and found.errors == [(0, 0.5)]
    assert store.latest_checkpoint(spark, f"{tmp_path}/c", settings | {"seed": 1}) is None
    store.log_run(spark, f"{tmp_path}/log", run="a")
    store.log_run(spark, f"{tmp_path}/log", run="b")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    assert store.cached_json(spark, f"{tmp_path}/j.json", lambda: {"a": 1}) == store.cached_json(spark, f"{tmp_path}/j.json", lambda: {"a": 2}) == {"a": 1}
    store.write_rows(rows(spark, [("a", "b", "c")] * 10), f"{tmp_path}/r", rows_per_file=4)
    assert corpus.read_shards(spark, f"{tmp_path}/r", ["x"]).count() == 10


def test_streamed_ngrams(spark, tmp_path):
    schema = "doc_id long, text string"
    for i in range(3):
        spark.createDataFrame([(i, "one two three four. five")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: ingest.start_ingest(ingest.text_stream(spark, f"{tmp_path}/in", schema, 1), (2, 3), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    run()
    assert spark.read.parquet(f"{tmp_path}/out/2-gram").count() == 9 and spark.read.parquet(f"{tmp_path}/out/3-gram").count() == 6
    spark.createDataFrame([(9, "new text here")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()  # only the new file
    assert spark.read.parquet(f"{tmp_path}/out/2-gram").count() == 11


def test_frames(spark):
    elements = spark.createDataFrame([("F", "Agent", "Core"), ("F", "Theme", "Core"), ("F", "Time", "Peripheral"), ("G", "Theme", "core"), ("G", "Odd", None)], "frame string, element string, kind string")
    seen = spark.createDataFrame([("F", "Theme", [1]), ("F", "Agent", []), ("F", "Theme", [2])], "frame string, element string, spans array<int>")
    blue = frames.blueprint(elements, frames.element_frequency(seen), slots=3)
    assert [(r.frame, r.element) for r in blue.orderBy("frame", "pos").collect()] == [("F", "Theme"), ("F", "Agent"), ("F", "Time"), ("G", "Theme"), ("G", "Odd")]
    orders = frames.canonical_orders(blue, slots=4)
    detected = spark.createDataFrame([(1, "F", "go", {"Agent": "x"}), (2, "H", None, {"Agent": "y"})], "sent_id int, frame_name string, target string, elements map<string,string>")
    got = {r.sent_id: tuple(r)[2:] for r in frames.frame_rows(detected, orders).collect()}
    assert got == {1: ("go", "~", "x", "~", "~", "~"), 2: ("~",) * 6}


def test_tensor_operators(spark):
    x = np.random.default_rng(9).random((4, 3, 2)) * (np.random.default_rng(8).random((4, 3, 2)) < 0.7)
    cells, a = tensor.from_dense(spark, x), np.random.default_rng(7).random((3, 2))
    assert np.allclose(tensor.to_dense(tensor.fold(tensor.unfold(cells, 3, 1), 3, 1), x.shape), x)
    assert np.allclose(tensor.to_dense(tensor.mode_product(cells, 3, 1, tensor.matrix_table(spark, a)), (4, 2, 2)), np.einsum("ijk,jr->irk", x, a))
    back = tensor.mode_product(tensor.from_dense(spark, np.einsum("ijk,jr->irk", x, a)), 3, 1, tensor.matrix_table(spark, a), transpose=True)
    assert np.allclose(tensor.to_dense(back, x.shape), np.einsum("ijk,jr,lr->ilk", x, a, a))
    part = tensor.subsample(cells, 3, 0.5, 1, exact=True)
    assert part.count() == round((x > 0).sum() * 0.5) and part.exceptAll(tensor.subsample(cells.repartition(5), 3, 0.5, 1, exact=True)).count() == 0
    with pytest.raises(ValueError, match="more than"):
        tensor.to_dense(cells, (10**4,) * 5)


def test_settings():
    assert config.parse_links("1-2, 2:0") == ((0, 2), (1, 2)) and config.parse_links("none") is None and config.parse_links("all", 3) == ((0, 1), (0, 2), (1, 2))
    assert config.parse_rank("5", 3) == (5, 5, 5) and config.ngram_orders("3-gram,4gram,3-gram") == (3, 4)
    assert config.resolve_dataset("path/x:conf") == ("path/x", "conf") and config.resolve_dataset("k", {"k": "s3://b/p"}) == ("s3://b/p", None)
    p = config.parsed(config.Population, ["--top-ks", "10,20", "--roles", "a,b,c", "--shared", "all"])
    assert p.top_ks == (10, 20) and p.shared == ((0, 1), (0, 2), (1, 2))
    d = config.parsed(config.Decomposition, ["--rank", "7", "--shared", "1-2", "--data-dir", "q"])
    assert d.rank == (7, 7, 7) and "_shared12" in d.stem() and d.run_id() == config.Decomposition(rank=(7, 7, 7), shared=((1, 2),)).run_id()
    for bad in ("1-1", "x", "1"):
        with pytest.raises(config.argparse.ArgumentTypeError):
            config.parse_links(bad)
    with pytest.raises(ValueError, match="n-gram"):
        config.ngram_orders("trigram")
    with pytest.raises(config.argparse.ArgumentTypeError):
        config.parse_bool("perhaps")


def test_long_texts_are_kept(spark, tmp_path):
    texts = ["a b c. " * 10_000, "a b c", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in T.usable_texts(df).orderBy("doc_id").collect()] == [0, 1]
    counts = {name: registry.queries()[name](spark, str(tmp_path)).agg({"cnt": "sum"}).first()[0] for name in ("trigram_counts", "stream_trigram_counts")}
    assert counts == {"trigram_counts": 10_001, "stream_trigram_counts": 20_002}


def test_stages_of_a_run(spark, tmp_path):
    from polyad import run

    rng = np.random.default_rng(3)
    texts = [(i, ". ".join(" ".join(rng.choice(["a", "b", "c", "d", "e"], 6)) for _ in range(5))) for i in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/texts")
    folder = run.main(["vectors", "--type", "3-gram,4-gram", "--dataset", f"{tmp_path}/texts", "--output-dir", f"{tmp_path}/out"], spark)
    assert store.read_json(spark, f"{folder}/meta.json")["rows"] == {"3": 30 * 5 * 4, "4": 30 * 5 * 3}
    data = ["--data-dir", f"{tmp_path}/data"]
    p = run.main(["population", "--dataset", f"{folder}/3-gram", "--roles", "w1,w2,w3", "--top-ks", "3,5", *data], spark)
    assert p.top_ks == (3, 5) and p.total == 600
    flags = ["decomposition", "--dim", "5", "--rank", "2", "--check-every", "1", "--checkpoint-every", "2", "--semantic-every", "2", "--evaluation-path", f"{folder}/3-gram", "--evaluation-rows", "50", *data]
    first = run.main([*flags, "--iterations", "4"], spark)
    again = run.main([*flags, "--iterations", "4"], spark)  # it is there already
    assert np.allclose(first.core, again.core)
    run.main([*flags, "--iterations", "6", "--resume", "true", "--overwrite", "true"], spark)
    whole = run.main([*flags, "--iterations", "6", "--overwrite", "true"], spark)
    c = config.parsed(config.Decomposition, [*flags[1:], "--iterations", "6"])
    state = store.read_json(spark, f"{c.paths()['model']}/state.json")
    assert [i for i, _ in state["errors"]] == list(range(6)) and state["fitness"]
    assert store.read_trained(spark, c.paths()["model"].rpartition("/")[0]).roles == ["w1", "w2", "w3"]
    assert store.read_trained(spark, c.paths()["model"].rpartition("/")[0], 4).core.shape == whole.core.shape
    assert store.missing(spark, {"a": c.paths()["best"], "b": f"{tmp_path}/none"}) == ["b"]


def test_sampled_scan(spark, tmp_path):
    rows_ = [(f"a{i % 7}", f"b{i}", None if i % 50 == 0 else "c") for i in range(4000)]
    rows(spark, rows_).repartition(8).write.parquet(f"{tmp_path}/t")
    got = [evaluate.sampled_scan(spark, f"{tmp_path}/t", ROLES, 100, cache=f"{tmp_path}/cache").collect() for _ in range(2)]
    assert got[0] == got[1] and len(set(got[0])) == 100 and {tuple(r) for r in got[0]} <= set(rows_)
    assert len(evaluate.sampled_scan(spark, f"{tmp_path}/t", ROLES, 3900).collect()) == 3900
    with pytest.raises(ValueError, match="fewer"):
        evaluate.sampled_scan(spark, f"{tmp_path}/t", ROLES, 4000)


def test_extended_look_ups(spark):
    m = Tucker(np.ones((1, 1)), [np.array([[1.0]]), np.array([[2.0]])], [["a"], ["b"]], ["x", "y"])
    e = extend.Extended.of(m, spark.createDataFrame([("x", "a", 3, [9.0]), ("x", "new", 2, [4.0])], extend.EXTENSION))
    assert e.latent("a", "x") == [1.0] and e.latent("new", "x") == [4.0] and e.model.factors is m.factors
    assert (e.extended("a", "x"), e.extended("new", "x"), e.check(("new", "b")), e.score(("new", "b"))) == (False, True, (True, True), 8.0)
    with pytest.raises(UnknownToken):
        e.latent("new", "y")
    kept = extend.only(spark.createDataFrame([("x", "n", 1, [1.0]), ("y", "n", 1, [1.0])], extend.EXTENSION), spark.createDataFrame([("x", "n")], "role string, token string"))
    assert [r.role for r in kept.collect()] == ["x"]


def test_reconstruction():
    core, factors = np.arange(1.0, 5).reshape(2, 2), [np.eye(2) * 2, np.array([[1.0, 1.0]])]
    assert np.allclose(tucker.reconstructed(core, factors), [[6.0], [14.0]])
    assert tucker.reconstructed(core, factors, skip=1).shape == (2, 2)
    with pytest.raises(ValueError, match="more than"):
        tucker.reconstructed(core, factors, most=1)


def test_samples_follow_their_law(spark):
    """Whether a seeded sample is what sorting by the hash in numpy's order gives."""
    df = rows(spark, [(f"a{i}", f"b{i % 9}", "c") for i in range(500)])
    import pyspark.sql.functions as F

    hashed = sorted((r.h, *r[:3]) for r in df.select(*ROLES, F.xxhash64(*ROLES, F.lit(42)).alias("h")).collect())
    assert [tuple(r) for r in evaluate.sample(df, ROLES, 40).collect()] == [h[1:] for h in hashed[:40]]
    cells = spark.createDataFrame([(i, i % 3, float(i)) for i in range(200)], "i0 int, i1 int, value double")
    order = sorted((r.h, r.i0) for r in cells.select("i0", F.xxhash64("i0", "i1", F.lit(7), F.lit(0)).alias("h")).collect())
    got = {r.i0: r.value for r in tensor.subsample(cells, 2, 0.3, 7, exact=True).collect()}
    assert got == {i: pytest.approx(i / 0.3) for _, i in order[:60]}


@pytest.mark.parametrize("held", [2_000_000, 5])
def test_orders_from_one_shuffle_of_stretches(spark, monkeypatch, held):
    """every order by itself moved each n-gram with all its words; now stretches travel once for all orders."""
    import random

    from polyad.operators import grams

    monkeypatch.setattr(grams, "MOST_HELD", held)
    draw = random.Random(3)
    rows = [[draw.choice(["a", "bb", "ccc", "dé", "x" * 40]) for _ in range(draw.randrange(12))] for _ in range(300)] + [[], ["a"] * 500]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "doc_id int, tokens array<string>").repartition(3)
    out = grams.order_counts(df, [3, 4, 5], 1000)
    every = {n: [tuple(r[i : i + n]) for r in rows for i in range(len(r) - n + 1)] for n in (3, 4, 5)}
    assert {r["n"]: (r["n_rows"], r["n_distinct"]) for r in out.collect()} == {n: (len(x), len(set(x))) for n, x in every.items()}
    assert {r["n"]: r["n_rows"] for r in grams.order_counts(df.limit(0), [3, 4, 5], 1000).collect()} == {3: 0, 4: 0, 5: 0}
    plan = registry.queries()["ngram_orders"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "w3" not in plan


@pytest.mark.parametrize("pilot", [200_000, 40, 3])
def test_sample_makes_only_few_rows_distinct(spark, monkeypatch, pilot):
    """all rows were made distinct for a sample of a few."""
    monkeypatch.setattr(evaluate, "PILOT", pilot)
    df = rows(spark, [(str(i % 37), str(i % 11) if i % 5 else None, "c") for i in range(1000)]).repartition(5)
    every = df.dropna().distinct().orderBy(F.xxhash64(*ROLES, F.lit(42)), *ROLES).collect()
    for n in (0, 1, 20, 10_000):
        out = evaluate.sample(df, ROLES, n)
        assert out.collect() == every[:n]
        bounded = "xxhash64" in out._jdf.queryExecution().optimizedPlan().toString().rpartition("Aggregate")[2]
        assert bounded == (0 < n <= pilot and n < 100)


def test_languages_without_a_join_of_words(spark, tmp_path):
    """counts of each document and word were joined with the languages; ids on several rows still are."""
    texts = [(1, "a b. a", "en"), (2, "b c", "de"), (2, "c", "fr"), (None, "z", "en"), (3, "a c", None), (4, None, "en"), (5, "", "en")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.lang), r["rank"], r.token, r.cnt) for r in registry.queries()["vocabulary_by_language"](spark, str(tmp_path)).collect())
    assert got == [("None", 1, "a", 1), ("None", 2, "c", 1), ("de", 1, "c", 2), ("de", 2, "b", 1), ("en", 1, "a", 2), ("en", 2, "b", 1), ("fr", 1, "c", 2), ("fr", 2, "b", 1)]
    once = registry.queries()["vocabulary_by_language"](spark, "/root/testdata/sf0.001")
    assert "Join" not in once._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [1, 3, 4])
def test_marginals_of_ngrams_from_tokens(spark, n):
    """F4, F5, F8, F10: every token was counted once for each n-gram and role that it is in."""
    token_rows = [(0, ["a", "b", "a", "c", "a"]), (1, ["a", "b", "c"]), (2, ["b"]), (3, []), (4, ["c", "c", "c", "c"])]
    df = spark.createDataFrame(token_rows, "doc_id int, tokens array<string>")
    roles = [f"w{j + 1}" for j in range(n)]
    got = vocab.ngram_marginals(df, roles).collect()
    assert sorted(got) == sorted(vocab.marginals(T.ngrams(df, n), roles).collect())


def test_lattice_counts_its_vocabulary_once(spark):
    """the vocabulary was counted anew for each role."""
    plan = registry.queries()["subset_lattice"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation") == 3


def test_slots_are_found_where_the_text_is(spark, tmp_path):
    """every token travelled for each of four joins; an id on several rows had its first object as second."""
    import duckdb

    rows = [(7, "aa bb"), (7, "cc d e f ggg. hh"), (8, "cc dd e gggg. ii jjj"), (None, "aa bb"), (None, "aa bb"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["grammar_slots"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == sorted(con.sql(registry.oracle_sql()["grammar_slots"]).fetchall(), key=str)
    assert (7, 0, "aa", "f", "bb", "ggg", *["~"] * 3) in found and found.count((None, 0, "aa", *["~"] * 6)) == 2
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(registry.queries()["grammar_slots"](spark, "/root/testdata/sf0.001"))
    parsed = spark.createDataFrame([(None, 0, "run", "VERB", "root", 0)] * 2 + [(1, 0, "run", "VERB", "root", 0), (1, 1, "man", "NOUN", "nsubj", 0)], "sid int, i int, lemma string, pos string, dep string, head int")
    out = T.slots(parsed, ["sid"])
    assert plan(out).count("Exchange") == 1
    assert sorted(((r.sid, r.nsubj) for r in out.collect()), key=str) == [(1, "man"), (None, "~"), (None, "~")]


def test_trigrams_travel_in_stretches(spark, tmp_path):
    """every trigram travelled with its three words."""
    from polyad.operators import grams

    token_rows = [(0, ["a", "b", "a", "c", "a", "b", "a"]), (1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, ["c"] * 9), (5, ["dé", "x" * 40, "dé", "x" * 40, "dé", "a"])]
    df = spark.createDataFrame(token_rows, "doc_id int, tokens array<string>").repartition(3)
    for n in (1, 3, 4):
        words = [f"w{j + 1}" for j in range(n)]
        assert sorted(grams.ngram_counts(df, n, 1000).collect()) == sorted(T.ngrams(df, n, keep=[]).groupBy(*words).count().collect())
    plan = registry.queries()["trigram_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "Exchange" in x]
    assert len(exchanges) == 1 and "part" in exchanges[0] and "w3" not in exchanges[0]
