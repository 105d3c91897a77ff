"""Odd tables for all operators, and the learnt ones and the pipeline against plain Python."""
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.llm import byte_bpe, common, html_extract, near_dedup, nearest, packing, quality_classifier, quality_rules, substring_dedup, toxicity, warc

tokenizers = pytest.importorskip("public_tokenizers")
SYMBOLS = "#*$%&|<>"


def words_of(t):
    return [w.decode() for w in (t or "").encode().split()]


@pytest.fixture(scope="module")
def corpus(spark):
    """Good and bad texts, copies, near copies, shared passages, toxic ones, with labels."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    texts = [prose(r.randint(60, 120)) for _ in range(80)]
    texts += [("BUY NOW ### $$$ %%% !!! " * r.randint(6, 12)).strip() for _ in range(25)]
    texts += [prose(40) + " you horrible scumbucket and dirtywretch " + prose(30) for _ in range(40)]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    texts += [prose(50) + " " + passage + " " + prose(50) for _ in range(6)]
    texts += [texts[0], texts[1]]
    for i in (2, 3, 4):
        w = texts[i].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += ["", None, "\n \t", "word " * 3]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(80 <= i < 105) ^ 1, int(105 <= i < 145)) for i in range(150)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def statistics(t):
    """The labellers' statistics, one by one."""
    w, raw = words_of(t), (t or "").encode()
    if not w:
        return [0.0] * quality_classifier.N
    letter = lambda b: 65 <= b < 91 or 97 <= b < 123 or b >= 128
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [tuple(words_of(x)) for x in (t or "").split("\n") if words_of(x)]
    return [
        sum(chr(b) in SYMBOLS for b in raw) / max(len(raw), 1),
        sum(65 <= b < 91 for b in raw) / max(sum(map(letter, raw)), 1),
        len(covered) / len(w),
        sum(x[-1] in "!" + SYMBOLS for x in w) / len(w),
        (len(lines) - len(set(lines))) / len(lines),
        sum(not any(map(letter, x.encode())) for x in w) / len(w),
        1 - len(set(w)) / max(min(len(w), 2.5 * len(w) ** 0.75), 1),
    ]


def bucket_of(word):
    _, _, h, _ = common.words(*common.packed([word.encode()]))
    return int(h[0]) >> (64 - quality_classifier.BITS)


def level_bucket(i, level):
    name = np.array([i * 16 + 1 + level], np.uint64) + np.uint64(0xABCDEF) * np.uint64(1 << 20)
    return int(common.mix(name)[0]) >> (64 - quality_classifier.BITS)


def goodness(t, model):
    """The score of one text by the model's weights, summed word by word."""
    w, s = words_of(t), statistics(t)
    z = model.constant + sum(float(model.weights[bucket_of(x)]) for x in w) / max(len(w), 1)
    z += sum(float(model.weights[level_bucket(i, max(0, min(int(x * 10), 9)))]) for i, x in enumerate(s))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_quality_classifier_against_plain_python(corpus):
    rows, docs, labels = corpus
    model = quality_classifier.learn(docs)
    got = {r["doc_id"]: r for r in quality_classifier.score(docs.withColumn("good", F.lit("x")), model).collect()}
    counts = Counter()
    for _, t, *_ in rows:
        s, n = statistics(t), len(words_of(t))
        counts[tuple(0 if n < 8 else -1 if x >= bad else int(x < good) for x, (_, good, bad) in zip(s, quality_classifier.LABELLERS, strict=True))] += 1
    # expectation-maximisation, vote by vote
    post = {v: 0.2 if -1 in v else min(0.95, max(0.05, 0.8 + 0.1 * sum(v))) for v in counts}
    for _ in range(100):
        mass = [sum(c * (1 - post[v]) for v, c in counts.items()), sum(c * post[v] for v, c in counts.items())]
        like = {}
        for v in counts:
            side = []
            for k in (0, 1):
                z = math.log((mass[k] + 1) / (sum(mass) + 2))
                for i, x in enumerate(v):
                    if x:
                        of = {y: sum(c * (post[u] if k else 1 - post[u]) for u, c in counts.items() if u[i] == y) for y in (-1, 0, 1)}
                        prior = {-1: 1.0 if k else 2.0, 0: 1.0, 1: 2.0 if k else 1.0}
                        z += math.log((of[x] + prior[x]) / (sum(of.values()) + 4))
                side.append(z)
            like[v] = 1 / (1 + math.exp(max(-40, min(40, side[0] - side[1]))))
        done = max(abs(like[v] - post[v]) for v in post) < 1e-9
        if done:
            break
        post = like
    code = lambda v: sum((x + 1) * 3**i for i, x in enumerate(v))
    assert {code(v): pytest.approx(p, abs=1e-6) for v, p in post.items()} == model.patterns
    for i, t, *_ in rows:
        assert got[i]["quality_score"] == pytest.approx(goodness(t, model), abs=1e-5)
        assert got[i]["good"] == (got[i]["quality_score"] >= 0.5)
    assert sum(not got[i]["good"] for i in range(80, 105)) >= 24 and sum(got[i]["good"] for i in range(80)) >= 79


def test_quality_verdict_against_plain_python(corpus, spark):
    rows, docs, labels = corpus
    got = {r["doc_id"]: r for r in quality_rules.score(docs.withColumn("kept", F.lit("x")), labels.where("quality = 1")).collect()}
    grams = {i: [(w,) for w in words_of(t)] + list(itertools.pairwise(words_of(t))) for i, t, *_ in rows}
    every = sorted({g for some in grams.values() for g in some})
    table = spark.createDataFrame([(i, g[0], g[1] if len(g) > 1 else None) for i, g in enumerate(every)], "i int, a string, b string")
    place = F.pmod(F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64("a", "b")), F.lit(quality_rules.BUCKETS))
    bucket = {every[r["i"]]: r["p"] for r in table.select("i", place.alias("p")).collect()}
    raw, target = Counter(), Counter()
    for i, some in grams.items():
        raw.update(bucket[g] for g in some)
        if i < 150 and not 80 <= i < 105:
            target.update(bucket[g] for g in some)
    share = lambda c, b: (c[b] + 0.5) / (sum(c.values()) + 0.5 * quality_rules.BUCKETS)
    for i, t, *_ in rows:
        w = words_of(t)
        llr = sum(math.log(share(target, bucket[g])) - math.log(share(raw, bucket[g])) for g in grams[i]) / len(grams[i]) if w else None
        three = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k + j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert (got[i]["base_failed"], got[i]["n_repeat_words"]) == (failed, len(again))
        assert got[i]["llr"] == (None if llr is None else pytest.approx(llr, abs=1e-8))
        assert got[i]["kept"] == (not failed and round(llr, 9) >= quality_rules.THRESHOLD)


def test_toxicity_against_plain_python(corpus):
    rows, docs, labels = corpus
    model = toxicity.learn(docs, labels)
    assert "scumbucket" in model.terms or any("scumbucket".startswith(b) for b in model.begins)
    got = {r["doc_id"]: r for r in toxicity.score(docs.withColumn("score", F.lit("x")), model).collect()}

    def near(word, term):  # one edit at most
        if word == term:
            return True
        edits = {word[:i] + word[i + 1 :] for i in range(len(word))}
        longer = {term[:i] + term[i + 1 :] for i in range(len(term))}
        swapped = len(word) == len(term) and sum(a != b for a, b in zip(word, term, strict=True)) == 1
        return term in edits or word in longer or swapped

    automaton = toxicity.Automaton(model.terms, model.begins)
    for w in {w.lower().strip(".") for _, t, *_ in rows for w in words_of(t)} | {"scumbuckett", "dirtywretc"}:
        want = 1 if w in model.terms or any(w.startswith(b) for b in model.begins) else 0
        if not want and any(len(t) >= toxicity.FUZZY and near(w, t) for t in model.terms + model.begins):
            want = 2
        if not want and any(len(b) > toxicity.FUZZY and any(near(w[:k], b) for k in range(len(w) + 1)) for b in model.begins):
            want = 2
        if w.isalpha():
            assert automaton.match(w) == want, w
    for i, t, *_ in rows:
        z = np.dot(toxicity.features(t or "", automaton), model.weights[:-1]) + model.weights[-1]
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-12)
        assert got[i]["predicted"] == int(105 <= i < 145)


def test_automaton_forgets():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(5, 9)))
    terms = sorted({word() for _ in range(60)})
    asked = [word() for _ in range(3000)]
    want = [toxicity.Automaton(terms, []).match(w) for w in asked[:300]]
    try:
        toxicity.STATES, most = 40, toxicity.STATES
        toxicity.REMEMBERED, words = 10, toxicity.REMEMBERED
        a = toxicity.Automaton(terms, [])
        assert [a.match(w) for w in asked[:300]] == want
        for w in asked:
            a.match(w)
        assert len(a.sets) <= 41 and len(a.seen) <= 10
    finally:
        toxicity.STATES, toxicity.REMEMBERED = most, words


def test_template_takes_out_what_no_name_tells(spark):
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        own = [prose(20), prose(30)]
        notice = "<div class=c7>Read this on our <b>site</b></div>"
        rows.append((i, f"http://h{i % 2}.example/{i}", f"<html><body><article><p>{own[0]}</p>{notice}<p>{own[1]}</p></article></body></html>", "x"))
        want[i] = " ".join(own)
    rows += [(100 + i, "http://copies.example/", "<article><p>the same page</p></article>", "x") for i in range(8)]
    rows += [(200, None, None, "x"), (201, "odd", "", "x"), (202, "http://h0.example/z", "<div class=c7>Read this on our <b>site</b></div>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert {i: got[i] for i in want} == want
    assert all(got[100 + i] == "the same page" for i in range(8)) and got[200] == got[201] == ""
    try:
        html_extract.SENT, most = 0, html_extract.SENT
        assert {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()} == got
    finally:
        html_extract.SENT = most
    assert html_extract.text_of("<div class=abc>" * 20_000 + "x <b>y", None) == "x y"


def test_near_duplicates_of_many_kinds(spark):
    """Short sets with common values, two large groups in the same lists, and groups of near copies, by brute force."""
    r = random.Random(7)
    common_words = [f"w{i}" for i in range(12)]
    texts = [" ".join(r.choice(common_words) for _ in range(r.randint(3, 14))) for _ in range(220)]
    for _ in range(2):
        base = [f"{r.randrange(10**6):x}" for _ in range(150)]
        for _ in range(25):
            w = base.copy()
            for _ in range(r.randint(1, 6)):
                w[r.randrange(150)] = f"{r.randrange(10**6):x}"
            texts.append(" ".join(w))
        texts += [" ".join(base[:110] + [f"{r.randrange(10**6):x}" for _ in range(40)]) for _ in range(5)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, kept long")
    sets = {i: near_dedup.shingle_set(t.encode(), 2) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if 100 * (both := len(sets[a] & sets[b])) >= 80 * len(sets[a] | sets[b]) and both:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    try:
        near_dedup.HOT, hot = 4, near_dedup.HOT
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, shingle=2).collect()}
    finally:
        near_dedup.HOT = hot
    assert got == {i: find(i) for i in sets}


def test_near_duplicates_of_a_large_group_that_is_not_linked(spark, monkeypatch):
    """A dense group and many documents just beyond the limit: right links, and no table of all their pairs."""
    r = random.Random(23)
    base, texts = [f"{r.randrange(10**6):x}" for _ in range(150)], []
    for changes in [1] * 200 + [13] * 200 + [5] * 60:
        w = base.copy()
        for i in r.sample(range(150), changes):
            w[i] = f"z{r.randrange(40)}"
        texts.append(" ".join(w))
    sets = [near_dedup.shingle_set(t.encode(), 2) for t in texts]
    root = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = [x if k == y else k for k in root]
    assert len(set(root)) > 20 and root.count(0) > 200
    made, stored = [], near_dedup.stored

    def counted(df, name, *more):
        made.append((name, (out := stored(df, name, *more)).count()))
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(df, shingle=2).collect()}
    assert got == dict(enumerate(root))
    assert max(n for name, n in made if name in ("pairs", "likely", "near")) < 40 * len(texts)


def test_lists_and_values_are_dealt_once(spark, monkeypatch):
    """Counting a list's classes, or a value's sets, takes one exchange of them and no join."""
    store, plans = near_dedup.stored, {}
    monkeypatch.setattr(near_dedup, "stored", lambda df, name, *more: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and store(df, name, *more))
    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abcdefgh") for _ in range(20))) for i in range(60)], "doc_id long, text string")
    near_dedup.near_duplicates(docs, shingle=2).collect()
    for name, by in (("lists", "key"), ("prefixes", "value")):
        plan = plans[name].split("== Initial Plan ==")[0]
        assert "Join" not in plan and plan.count(f"Exchange hashpartitioning({by}#") == 1


def test_cells_link_what_brute_force_links():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 40, r.integers(1, 60))).astype(np.uint64) for _ in range(80)]
    one, doc = r.integers(0, 9, 80), r.permutation(80)
    for second in (np.zeros(80, bool), r.random(80) < 0.4):
        want = set()
        for i, j in itertools.combinations(range(80), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if one[i] != one[j] and (not second.any() or second[i] != second[j]) and 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both):
                want.add((min(doc[i], doc[j]), max(doc[i], doc[j])))
        assert set(near_dedup.linked_across(doc, one, second, sets, 60)) == want and len(want) > 9


def test_empty_tables(spark, corpus):
    _, docs, labels = corpus
    none, pages = docs.limit(0), spark.createDataFrame([], "page_id long, url string, html string")
    assert quality_classifier.score(none, quality_classifier.learn(none)).count() == 0
    assert quality_rules.score(none, labels.where("quality = 1")).count() == 0
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0 and substring_dedup.deduplicate(none).count() == 0
    assert packing.pack(none, tokenizers.path("word_bpe_49k.json")).count() == 0
    assert byte_bpe.encode(none, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).count() == 0
    assert html_extract.extract(pages).count() == 0
    folder = warc.fresh_path(spark, "none")
    assert warc.read(warc.write(pages, folder), folder).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(vectors, F.col("vec_id") % 20 == 0).count() == 0


def test_repeats_long_texts_and_clashes(spark):
    long = " ".join(f"t{i % 7001}" for i in range(150_000))
    rows = [(1, long), (1, long), (2, long + " end"), (None, "a b c " * 20), (3, "a b c " * 20), (3, "x"), (4, None)]
    df = spark.createDataFrame([(i, t, 7, "k", 0.5, True) for i, t in rows], "doc_id long, text string, n_words int, kept_text string, quality_score double, good boolean")
    cut = substring_dedup.deduplicate(df).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in cut) == [(-1, 60, 60), (1, 150_000, 0), (1, 150_000, 0), (2, 150_001, 150_000), (3, 1, 0), (3, 60, 0), (4, 0, 0)]
    near = near_dedup.near_duplicates(df).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in near) == [(-1, -1), (1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 4)]
    assert quality_classifier.score(df, quality_classifier.learn(df)).count() == 7
    assert packing.pack(df, tokenizers.path("word_bpe_49k.json")).agg(F.sum("length")).first()[0] > 450_000
    with pytest.raises(ValueError, match="has the name of a result"):
        toxicity.score(df.withColumnRenamed("text", "score"), toxicity.Model([], [], np.zeros(toxicity.FEATURES + 1)), text="score")


def test_pipeline_against_brute_force(corpus, spark, tmp_path):
    import corpus_pipeline as pipeline
    from tokenizers import Tokenizer

    rows, docs, labels = corpus
    extra = docs.withColumn("good", F.lit("x")).withColumn("predicted", F.lit("x")).withColumn("n_words", F.lit("x"))
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()

    good = quality_classifier.learn(docs)
    left = [(i, t) for i, t, *_ in rows if goodness(t, good) >= 0.5]
    kept = docs.where(F.col("doc_id").isin([i for i, _ in left]))
    model = toxicity.learn(kept, labels)
    automaton = toxicity.Automaton(model.terms, model.begins)
    left = [(i, t) for i, t in left if np.dot(toxicity.features(t or "", automaton), model.weights[:-1]) + model.weights[-1] < 0]
    sets = {i: near_dedup.shingle_set((t or "").encode(), 5) for i, t in left}
    gone, root = set(), {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root = {k: min(root[a], root[b]) if v in (root[a], root[b]) else v for k, v in root.items()}
    gone = {i for i in root if root[i] != i}
    assert len(gone) >= 5
    left = [(i, t) for i, t in left if i not in gone]
    least = {}
    for i, t in left:
        w = words_of(t)
        for k in range(len(w) - 12):
            least.setdefault(tuple(w[k : k + 13]), i)
    library, want, cut = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json")), {}, 0
    for i, t in left:
        w = words_of(t)
        out = {k + j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for j in range(13)}
        cut += len(out)
        text = " ".join(x for k, x in enumerate(w) if k not in out) if out else t or ""
        want[i] = len(library.encode(text, add_special_tokens=False).ids) + 1
    assert cut >= 5 * 40
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == want
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert total == want
