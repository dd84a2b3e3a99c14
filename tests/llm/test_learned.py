import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from strata.llm import language, quality, queries, toxicity
from strata.llm.common import WordHash

P = "/root/testdata/sf0.01"
ODD = [(1, None, None), (2, "", "en"), (3, "123 !!", "en"), (4, "the cat and the dog", "en"), (4, "the cat and the dog", "en"), (5, "word " * 50_000, "en"), (None, "le chat et le chien", "fr")]


def test_language_held_out(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{P}/documents.parquet").collect()}
    got = queries.op9_language_id(spark, P).collect()
    assert len(got) == len(docs)
    out = [r for r in got if r.held_out]
    assert np.mean([docs[r.doc_id] == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(frame, spark):
    filters = language.fit(spark.read.parquet(f"{P}/documents.parquet"))
    docs = frame([(*r, 1) for r in ODD], "doc_id long, text string, lang string, score int")
    got = language.predict(docs, filters).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[3] == got[4] and got[3].lang_pred == "en"
    assert language.keep_known(docs, filters).columns == docs.columns
    assert language.predict(docs, language.Filters({})).where("lang_pred <> 'und'").count() == 0
    assert language.predict(frame([], "doc_id long, text string"), filters).count() == 0


FOREIGN = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura. Il governo ha annunciato ieri nuove misure per sostenere le famiglie e le imprese colpite dalla crisi economica.",
    "De regering heeft gisteren nieuwe maatregelen aangekondigd om gezinnen en bedrijven te ondersteunen die getroffen zijn door de economische crisis. Het weer wordt morgen bewolkt.",
    "Hallitus ilmoitti eilen uusista toimenpiteistä perheiden ja yritysten tukemiseksi, joihin viime vuosien talouskriisi on vaikuttanut. Huomenna on pilvistä.",
    "Rząd ogłosił wczoraj nowe środki mające na celu wsparcie rodzin i przedsiębiorstw dotkniętych kryzysem gospodarczym ostatnich lat.",
]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_foreign_texts_go_and_clean_ones_stay(frame, spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text", "lang")
    planted = frame([(-1 - i, t, None) for i, t in enumerate(FOREIGN)], docs.schema)
    both = docs.union(planted)
    kept = {r.doc_id for r in language.keep_known(both, language.fit(both)).collect()}
    clean = {r.doc_id for r in docs.where("length(text) > 0").collect()}
    assert not any(i < 0 for i in kept) and kept <= clean and len(kept) >= 0.998 * len(clean)


def gram_hash(gram):
    """The hash of one n-gram, in Python's integers."""
    most = 2**64 - 1
    h = ord(gram[0])
    for c in gram[1:]:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) & most
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & most
        h ^= h >> 32
    return h >> 2


def grams(word):
    w = f"^{word}$"
    return [w[i : i + n] for n in language.ORDERS for i in range(len(w) - n + 1)]


def letters(text):
    """Runs of letters, by Unicode category."""
    return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()


def test_language_against_plain_python(spark):
    """Filters from counts in dictionaries; each n-gram of each text looked up on its own."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    seen = {}
    for r in rows:
        if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            seen.setdefault(r.lang, Counter()).update(gram_hash(g) for w in letters(r.text) for g in grams(w))
    top = {name: [h for h, n in sorted(c.items(), key=lambda x: (-x[1], x[0])) if n > 1][: language.KEEP] for name, c in seen.items()}
    f = language.fit(docs, calibrated=False)
    assert np.array_equal(f.masks, language.Filters(top).masks)
    bits = [int(x) for x in f.masks[0]]
    for r in queries.op9_language_id(spark, "/root/testdata/sf0.001").collect():
        own = [gram_hash(g) for w in letters(next(x.text for x in rows if x.doc_id == r.doc_id)) for g in grams(w)]
        if len(own) > 3_000:
            continue
        hits = [0] * len(f.languages)
        for h in own:
            a, b, mask = h & 0x7FFFFFFF, (h >> 31) | 1, -1
            for i in range(language.HASHES):
                mask &= bits[(a + i * b) % f.size]
            hits = [n + (mask >> k & 1) for k, n in enumerate(hits)]
        share = [min(1, max(0, (n - len(own) * p) / (len(own) * (1 - p)))) for n, p in zip(hits, f.false)] if own else []
        assert r.lang_pred == (f.languages[share.index(max(share))] if own else "und") and abs(r.score - max(share, default=0)) < 1e-9


def test_filters_return_every_language_that_has_a_gram():
    words = {"a": ["eins", "zwei"], "b": ["one", "two", "zwei"]}
    f = language.Filters({k: [gram_hash(g) for w in v for g in grams(w)] for k, v in words.items()})
    n = f.counts(["zwei", "one"])
    assert n[0, 0] == n[0, 1] == n[0, 2] == len(grams("zwei")) and n[1, 1] == n[1, 2] > n[1, 0]
    many = language.Filters({f"l{i:03d}": [gram_hash(g) for g in grams(f"word{i}x")] for i in range(70)})
    assert many.decide(language.counted(many, ["wordx", "WORD x", None]))[2] == ("und", 0.0)
    assert len(many.masks) == 2


def test_numbers_are_no_letters(frame, spark):
    filters = language.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), calibrated=False)
    odd = ["\u00bd \u00b2", "\u2167 \u2460", "\u0663 12 _", "\u4e00", "\u00aa"]
    got = {r.doc_id: r.lang_pred for r in language.predict(frame(list(enumerate(odd)), "doc_id long, text string"), filters).collect()}
    assert [got[i] == "und" for i in range(5)] == [True, True, True, False, False]


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in queries.op4_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    assert all((r.score >= 0.5) == bool(r.predicted) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in got]) > 0.95
    clean = [r.predicted for r in got if not labels[r.doc_id]]
    assert np.mean(clean) < 0.01


def test_toxicity_odd_rows(frame):
    docs = frame(ODD, "doc_id long, text string, lang string")
    labels = frame([(1, 0), (4, 1), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    for marked in (labels, frame([], "doc_id long, toxic int")):
        w = toxicity.fit(docs, marked)
        got = toxicity.score(docs, w).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got} == {0.5}
    assert toxicity.score(frame([], "doc_id long, text string"), w).count() == 0


def test_toxicity_against_plain_python(spark):
    """Features in sets, weights in dictionaries, one coordinate at a time."""
    d = "/root/testdata/sf0.001"
    docs, most = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}, 2**64 - 1

    def mix(x):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & most
        return x ^ x >> 32

    def features(text):
        h = [xxhash.xxh64_intdigest(w.encode()) for w in toxicity.WORD.findall(text.lower())]
        pairs = {(h[i] * 0x9E3779B97F4A7C15 + h[i + gap] * (2 * gap + 1)) & most for gap in (1, 2, 3) for i in range(len(h) - gap)}
        return [0] + sorted((mix(x) >> (64 - toxicity.BITS)) + 1 for x in set(h) | pairs)

    marked = spark.read.parquet(f"{d}/labels.parquet").selectExpr("doc_id", "toxic", "xxhash64(doc_id) h").orderBy("h").collect()
    rows = [(sorted(set(features(docs[r.doc_id]))), r.toxic) for r in marked if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in docs]
    z, n, model = Counter(), Counter(), toxicity.Ftrl(1)

    def weight(i):
        l1 = model.l1 if i else 0
        return 0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)

    for _ in range(8):
        for own, y in rows:
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.alpha * w[i]
                n[i] += g * g
    for r in queries.op4_toxicity(spark, d).collect():
        want = 1 / (1 + math.exp(-sum(weight(i) for i in set(features(docs[r.doc_id])))))
        assert abs(r.score - want) < 1e-6


def test_toxicity_learns_from_what_fits(frame):
    docs = frame([(i, f"bad{i % 2} " * 3 + " ".join(f"w{i}x{k}" for k in range(5_000 if i == 3 else 4))) for i in range(40)], "doc_id long, text string")
    labels = frame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    all_rows, few = toxicity.fit(docs, labels), toxicity.fit(docs, labels, max_features=2_000)
    assert few and all_rows and toxicity.fit(docs, labels, max_features=0) == []
    assert {r.doc_id: r.score for r in toxicity.score(docs, few).collect()}[1] > {r.doc_id: r.score for r in toxicity.score(docs, few).collect()}[0]


def test_ftrl_is_sparse():
    m = toxicity.Ftrl(100)
    r = np.random.default_rng(0)
    for _ in range(3000):
        y = int(r.random() < 0.3)
        m.learn(np.unique([0, *([7] if y else []), *r.integers(10, 100, 5)]), y)
    w = m.weights(np.arange(100))
    assert w[7] > 2 and (w[10:] != 0).mean() < 0.2


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_kth_largest(frame, n):
    x = np.round(np.random.default_rng(n).normal(size=n) * 50, 1).tolist()
    df = frame([(v,) for v in [*x, None]], "x double")
    for k in {1, 2, n // 2, n} - {0}:
        want = sorted(x, reverse=True)[k - 1] if k <= n else None
        assert quality.kth_largest(df, "x", k) == want
    assert quality.kth_largest(df, "x", n + 1) is None


def test_resampling_against_plain_counts(spark):
    """Weights by counting in dictionaries; the sample by sorting."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = {r.doc_id: r for r in queries.op6_importance_resampling(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    marked = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    good = {r.doc_id for r in marked if r.quality == 1}
    grams = {i: quality.ngrams([t], WordHash())[0].tolist() for i, t in texts.items()}
    raw, target = np.ones(1 << quality.BITS), np.ones(1 << quality.BITS)
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if i in good:
            np.add.at(target, g, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for i, g in grams.items():
        assert abs(ratio[g].sum() - got[i].log_weight) < 1e-6 * (1 + len(g))
    noisy = sorted((r.perturbed for r in got.values()), reverse=True)
    k = int(np.ceil(len(texts) * min(1, len(good) / len(marked) + quality.SLACK)))
    assert {i for i, r in got.items() if r.kept} == {i for i, r in got.items() if r.perturbed >= noisy[k - 1]}


def test_resampling_keeps_good_texts(spark):
    got = {r.doc_id: r.kept for r in queries.op6_importance_resampling(spark, P).collect()}
    labels = [r for r in spark.read.parquet(f"{P}/labels.parquet").collect() if r.doc_id in got]
    assert np.mean([got[r.doc_id] for r in labels if r.quality == 1]) > 0.98
    assert np.mean([got[r.doc_id] for r in labels if r.quality == 0]) < 0.4


def test_resampling_odd_rows(frame):
    docs = frame(ODD, "doc_id long, text string, kept string")
    none = frame([], "doc_id long, quality int")
    assert quality.keep_sampled(docs, none).count() == len(ODD)
    got = quality.sample(docs, frame([(4, 1), (5, 0), (None, 1), (1, None)], "doc_id long, quality int")).collect()
    assert len(got) == len(ODD) and all(r.log_weight == 0 for r in got if r.doc_id in (1, 2))
    assert quality.sample(frame([], "doc_id long, text string"), none).count() == 0
