import zlib

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
from fleetlens.llm import toxicity

SMALL, DATA = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = toxicity.Network()
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    n = 3 * toxicity.HIDDEN
    x, mask, y = rng.standard_normal((5, 3, 2 * n)), np.arange(5)[:, None] < np.array([5, 3, 1]), np.array([1, 0, 1])

    def loss():
        logit = net.forward(x, mask)
        return np.sum(np.log1p(np.exp(logit)) - y * logit)

    kept = {}
    logit = net.forward(x, mask, kept)
    grads, dx = net.backward(kept, toxicity.sigmoid(logit) - y)
    for name in ("wo", "bo", "va", "Wa", "Uf", "Ub"):
        at = tuple(0 if s == 1 else s - 2 for s in net.p[name].shape)
        before, eps = net.p[name][at], 1e-4
        net.p[name][at] = before + eps
        up = loss()
        net.p[name][at] = before - eps
        down = loss()
        net.p[name][at] = before
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-3 * max(1, abs(grads[name][at])), name
    for at in ((0, 0, 3), (2, 1, n + 4), (4, 0, 2 * n - 1)):
        before = x[at]
        x[at] = before + 1e-4
        up = loss()
        x[at] = before - 1e-4
        down = loss()
        x[at] = before
        assert abs((up - down) / 2e-4 - dx[at]) < 2e-3


def test_windows_overlap_and_cover():
    for n in (0, 1, 47, 48, 49, 84, 85, 500):
        spans = toxicity.windows(n)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False))


def test_held_out_accuracy(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select("doc_id", "text", "toxic")
    got = {r["doc_id"]: r for r in entry.queries()["op7_toxicity"](spark, DATA).collect()}
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in rows.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    hits, said, there = (sum(f(t, p) for t, p in held) for f in (lambda t, p: t and p, lambda t, p: p, lambda t, p: t))
    assert hits >= 0.9 * there and hits >= 0.9 * said
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you stupid fool", 1), (2, "kind words", 2), (3, None, 3), (4, "", 4), (None, "you stupid fool", 5), (6, "word " * 50_000, 6), (1, "you stupid fool", 7)],
                                 "doc_id long, text string, score long")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (9, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fitted(spark, docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 7 and len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1 and len({r["score"] for r in rows if r["doc_id"] in (1, None)}) == 1
    assert toxicity.score(docs, toxicity.fitted(spark, docs, labels.limit(0))).agg({"score": "max"}).first()[0] == 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0
    kept = toxicity.passing(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r["predicted"] == 0 for r in rows)


def test_texts_without_words_train(spark):
    assert "slope" in toxicity.train([("", 0), ("!", 1), ("", 1)])


def test_toxic_passages_behind_a_long_beginning_count():
    rng = np.random.default_rng(3)
    plain, rude = ["river", "stone", "garden", "window", "letter", "summer"], ["stupidfool", "worthlessidiot"]
    some = lambda n: [plain[i] for i in rng.integers(0, len(plain), n)]
    documents = [(" ".join(some(20) + [rude[i % 2]] + some(20)), 1) for i in range(60)] + [(" ".join(some(41)), 0) for _ in range(120)]
    start = "_".join(some(12))[:48]
    runs = [f"{start}_stupidfool", f"{start}_garden", "_".join(some(8) + ["worthlessidiot"] + some(8)), "_".join(some(17))]
    assert all(len(x) > 48 for x in runs)
    got = toxicity.Scorer(toxicity.train(documents)).scores(runs)
    assert got[0] > got[1] + 0.3 and got[2] > got[3] + 0.3, got


def test_pieces_of_long_runs_hold_all_their_grams():
    for n in (1, 40, 41, 48, 49, 72, 73, 1000):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = toxicity.words_of(f"a {run} b")[1:-1]
        assert {g for p in pieces for g in toxicity.grams(p)} >= set(toxicity.grams(run)) and max(map(len, pieces)) <= 40 and (n > 40 or pieces == [run])


def test_words_looked_up_together_have_the_inputs_of_single_words():
    rng = np.random.default_rng(5)
    words = ["a", "ab", "abc", "日本", "é\U0001f600x", "stupidfool", *("".join(chr(c) for c in rng.integers(97, 105, n)) for n in rng.integers(1, 40, 200))]
    odds = {g: float(rng.standard_normal()) for w in words for g in toxicity.grams(w) if rng.random() < 0.5}
    evidence = toxicity.Evidence({"ab": 1.5}, odds)
    for word, got in zip(words, evidence.inputs(words), strict=True):
        g = [odds.get(x, 0.0) for x in toxicity.grams(word)]
        opening = max(x for x, s in zip(g, toxicity.grams(word), strict=True) if s[0] == "<")
        assert np.allclose(got, [1.5 if word == "ab" else 0, max(g), sum(g) / len(g), opening, min(g), min(len(word), 20) / 10 - 1], atol=1e-6)
    rows, sizes = toxicity.trigram_table(words)
    assert rows.tolist() == [x for w in words for x in toxicity.trigram_rows(w)] and sizes.tolist() == [len(toxicity.trigram_rows(w)) for w in words]


def test_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "ROWS", 3)
    texts = ["you stupid fool", None, "", "kind words", "word " * 500, "kind", "fool"]
    assert list(toxicity.texts_of(pa.array(texts))) == [t or "" for t in texts] and list(toxicity.texts_of(pa.array([], pa.string()))) == []
    scorer = toxicity.Scorer(toxicity.train([("you stupid fool", 1), ("kind words", 0)]))
    assert (scorer.scores(toxicity.texts_of(pa.array(texts)), len(texts)) == scorer.scores([t or "" for t in texts])).all()


def test_the_sample_does_not_reach_the_driver(spark, monkeypatch):
    """A task trains; what it returns scores as a model that is trained here."""
    texts = [(i, f"plain words of number {i} and more") for i in range(40)] + [(100 + i, f"you horrid fool number {i} and worse") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in texts], "doc_id long, toxic int")
    here = toxicity.train(toxicity.labelled_sample(docs, labels))
    monkeypatch.setattr(toxicity, "labelled_sample", None)
    there = toxicity.fitted(spark, docs, labels)
    want, got = (toxicity.Scorer(model).scores([t for _, t in texts]) for model in (here, there))
    assert abs(want - got).max() < 1e-3
    assert toxicity.fitted(spark, docs.limit(0), labels) == toxicity.train([])
