from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import language, toxicity as tox
from quern.llm.queries import queries

from ..conftest import SF
from .cases import empty, odd, prose

TEN = "/root/testdata/sf0.01"


def marked(spark):
    rude = ["zorgblat", "vexnarg", "qwuzzle"]
    rows = [(i, prose(i, 60) + (f" {rude[i % 3]}{'xyz'[i % 3]} " + prose(i + 500, 10)) * (2 if i % 5 == 0 else 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    return docs, labels


def test_toxic_documents_are_told_and_others_left_alone(spark):
    docs, labels = marked(spark)
    model = tox.learn(docs, labels.where("doc_id < 200"))
    scored = {r.doc_id: r.score for r in tox.toxicity(docs, model).collect()}
    held = range(200, 300)
    assert all(scored[i] >= 0.7 for i in held if i % 5 == 0) and all(scored[i] < 0.7 for i in held if i % 5)


def test_toxicity_of_odd_rows(spark):
    docs, labels = marked(spark)
    model = tox.learn(docs, labels)
    df = odd(spark)
    out = tox.toxicity(df, model, score_col="tox")
    assert out.columns == [*df.columns, "tox"]
    rows = out.collect()
    assert len(rows) == df.count() and all(0 <= r.tox <= 1 for r in rows)
    blank = {r.tox for r in rows if not (r.text or "").strip()}
    assert len(blank) == 1
    over = tox.toxicity(df, model)
    assert over.columns.count("score") == 1 and isinstance(over.first().score, float)
    assert tox.toxicity(empty(spark), model).collect() == []


def test_no_model_without_both_classes(spark):
    docs, labels = marked(spark)
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert tox.learn(docs, some) is None
    assert {r.score for r in tox.toxicity(docs, None).collect()} == {0.0}
    unread = tox.learn(docs.limit(0), labels)  # labels of documents that aren't there
    assert unread is None


def plain_ratio(word: bytes, toxic: list[bytes], ordinary: list[bytes]) -> float:
    """Interpolated Kneser-Ney by its definition, with dictionaries: log-likelihood of toxic less that of ordinary."""
    n, low = tox.ORDER, tox.SHARED

    def grams(words):
        out = Counter()
        for w in words:
            padded = bytes(n - 1) + w + b"\x01"
            for i in range(n - 1, len(padded)):
                out[padded[i - n + 1 : i + 1]] += 1
        return out

    classes = [grams(toxic), grams(ordinary)]
    every = classes[0] + classes[1]

    def counts(of: Counter, k: int) -> Counter:
        return of if k == n else Counter(g[1:] for g in {g[n - k - 1 :] for g in of})

    def probability(c: int, context: bytes, byte: bytes) -> float:
        k = len(context) + 1
        own = counts(every if k <= low else classes[c], k)
        shorter = probability(c, context[1:], byte) if k > 1 else 1 / 256
        kinds = [x for g, x in own.items() if g[:-1] == context]
        # the discount of a class is estimated over all grams of the length, with those it lacks
        d = tox.discount(np.array(list(own.values())))
        if not kinds:
            return shorter
        return (max(own[context + byte] - d, 0) + d * len(kinds) * shorter) / sum(kinds)

    padded = bytes(n - 1) + word + b"\x01"
    steps = [(padded[i - n + 1 : i], padded[i : i + 1]) for i in range(n - 1, len(padded))]
    return sum(np.log(probability(0, h, b)) - np.log(probability(1, h, b)) for h, b in steps)


@pytest.mark.parametrize("orders", [(8, 7), (5, 2), (8, 4)])
@pytest.mark.parametrize("seed", range(3))
def test_ratios_against_plain_kneser_ney(seed, orders, monkeypatch):
    monkeypatch.setattr(tox, "ORDER", orders[0])
    monkeypatch.setattr(tox, "SHARED", orders[1])
    r = np.random.default_rng(seed)
    make = lambda n, letters: [bytes(r.choice(list(letters), r.integers(1, 9)).tolist()) for _ in range(n)]
    toxic, ordinary, unseen = make(25, b"abcx"), make(40, b"abcd"), make(15, b"abcdxyz")

    def packed(words):
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        return data, ends - [len(w) for w in words], ends

    keys, counts = [], []
    for words, c in ((toxic, (1, 0)), (ordinary, (0, 1))):
        g, _ = tox.word_grams(*packed(words))
        keys.append(g)
        counts.append(np.tile(c, (len(g), 1)))
    counts = np.concatenate(counts)
    model = tox.fit_ratios(*tox._sum_by(np.concatenate(keys), counts[:, 0], counts[:, 1]))
    asked = toxic[:5] + ordinary[:5] + unseen
    got = model.words(*packed(asked))
    assert np.allclose(got, [plain_ratio(w, toxic, ordinary) for w in asked], atol=1e-4)
    hashes = np.arange(len(asked), dtype=np.uint64)
    words = tox.Words(model)
    for _ in range(2):
        assert np.allclose(words.ratio(hashes, *packed(asked)), got)
    even = tox.fit_ratios(keys[0], np.ones(len(keys[0])), np.ones(len(keys[0]))) if len(np.unique(keys[0])) == len(keys[0]) else None
    assert even is None or all(np.allclose(x.ratio, 0) for x in even.levels)


def test_held_out_toxicity(spark):
    rows = {r.doc_id: r for r in queries()["op5_toxicity"](spark, TEN).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{TEN}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{TEN}/documents.parquet").count()
    clean = [rows[i].predicted for i, t in labels.items() if t == 0]
    assert sum(clean) <= 0.01 * len(clean)
    held = [rows[i].predicted for i, t in labels.items() if t == 1 and rows[i].held_out]
    assert len(held) > 10 and sum(held) >= 0.75 * len(held)  # some labels are chance


def test_held_out_languages(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{TEN}/documents.parquet").collect()}
    rows = [r for r in queries()["op4_language_id"](spark, TEN).collect() if r.held_out]
    assert sum(docs[r.doc_id] == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_language_of_odd_rows(spark):
    model = language.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    df = odd(spark)
    rows = language.identify(df, model).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letter) and (letter or (r.score == 0 and r.rejected))
    assert language.identify(empty(spark), model).collect() == []
    assert language.learn(empty(spark)) is None
    assert {r.lang_pred for r in language.identify(df, None).collect()} == {"und"}
    noise = spark.createDataFrame([(1, "ꙮꙮꙮꙮ ꙮꙮꙮ" * 50)], "doc_id long, text string")
    assert language.identify(noise, model).first().rejected


def test_grams_are_counted_by_text():
    one, _ = language.gram_counts(["ab c"])
    two, has = language.gram_counts(["zz", "ab c", "", "1 2"])
    assert (one[0] == two[1]).all() and has.tolist() == [True, True, False, False]
    assert (language.gram_counts(["AB, C"])[0][0] == one[0]).all()


@pytest.mark.parametrize("k", [1, 3])
def test_clusters_are_unit_vectors(k):
    x = np.abs(np.random.default_rng(0).normal(size=(20, 8)))
    c = language.cluster(x / np.linalg.norm(x, axis=1, keepdims=True), k)
    assert len(c) <= k and np.allclose(np.linalg.norm(c, axis=1), 1)


def plain_grams(text: str) -> Counter:
    """Character n-grams of 1 to 3, over letters in lower case with one blank for each run of anything else."""
    folded = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    marked = f" {folded} " if text and not text.lower()[-1].isalpha() else f" {folded}"
    return Counter(g for n in (1, 2, 3) for i in range(len(marked) - n + 1) if (g := marked[i : i + n]).strip() and (g[0] != " " or g[-1] != " "))


def test_prediction_is_the_nearest_centroid_by_plain_cosine(spark):
    """Held against TF-IDF and cosine by their definitions, over dictionaries of the grams' components."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    model = language.learn(docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + ["Äpfel, über; 12 alles!", "a", "  the  End.", "x1y"]
    component = {}

    def weights(text):
        out = Counter()
        for g, n in plain_grams(text).items():
            if g not in component:
                component[g] = int(language.gram_components(g))
            out[component[g]] += n
        x = {c: np.log1p(n) * model.idf[c] for c, n in out.items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        return {c: v / norm for c, v in x.items()}

    names, scores, _ = model.predict(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        x = weights(text)
        cosines = [sum(v * c[k] for k, v in x.items()) for c in model.centroids]
        assert abs(max(cosines) - score) < 1e-4
        assert name in {model.languages[model.owner[j]] for j, c in enumerate(cosines) if c > max(cosines) - 1e-5}


def test_copies_leave_a_language_its_other_texts(spark):
    rows = [(f"{prose(1, 40)}", "aa")] * 3000 + [(prose(10 + i, 40), "aa") for i in range(30)] + [(f"ößü {prose(50 + i, 30)} ßä", "bb") for i in range(20)]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"), most_rows=20)
    assert model.languages == ["aa", "bb"] and (model.owner == 0).sum() > 1
