"""The training-data operators against brute force, on small tables with nulls, empties, repeats and clashing columns."""
import base64
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.llm import byte_bpe, common, html_extract, near_dedup, nearest, packing, quality_rules, substring_dedup, toxicity, warc

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(60)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice((0, 1, 2, 14, 40, 90)))) for _ in range(60)]
    for i in range(20):  # near copies
        w = texts[r.randrange(60)].split()
        for _ in range(len(w) // 30):
            w[r.randrange(len(w))] = "changed"
        texts.append("\n".join([" ".join(w[:9]), "  ".join(w[9:])]))
    passage = " ".join(vocabulary[:30])
    texts += [passage, f"x {passage} y", passage, "É " + passage.upper(), "", None, None, " \n ", "one", "tail  \n  of blanks   ", "it's é 日本\x1c x"]
    rows = [(i, t, i % 3) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n int")


def words(t):
    return (t or "").encode().split()


def test_byte_bpe(docs):
    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows, df = docs
    got = {r["doc_id"]: r for r in byte_bpe.encode(df, path, tokenizers.PATTERN).collect()}
    for i, t, _ in rows:
        want = library.encode_ordinary(t or "")
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want)
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode(df.limit(0), path, tokenizers.PATTERN).count() == 0


def test_packing(docs):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows, df = docs
    got = packing.pack(df, path, with_ids=True).collect()
    of, sequences = {}, {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t, _ in rows:
        want = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert [x for r in sorted(of[i], key=lambda r: r["start"]) for x in r["ids"]] == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 4096


def test_packing_of_literal_special_tokens():
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "a <|startoftext|> b", "ab<|endoftext|>cd", "x<|startoftext|><|endoftext|>, y", "<|EndOfText|> <|endoftext"]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.Words(path).encode([t.encode() for t in texts])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [49407] and 49406 in got[1] and 49407 in got[2]


def test_workers_drop_the_words_of_packing(docs):
    """A worker that packed and then does other work gives the vocabulary and the words back; packing again, it keeps them."""
    path, (_, df) = tokenizers.path("word_bpe_49k.json"), docs

    def held(batches):
        for batch in batches:
            from skirmish.llm import common

            yield batch.from_pydict({"n": [len(common._remembered)] * batch.num_rows})

    packing.pack(df, path).count()
    assert {r["n"] for r in common.mapped(df.coalesce(1), held, "n long", remembers=True).collect()} <= {0, 1}
    assert {r["n"] for r in common.mapped(df, held, "n long").collect()} == {0}
    made = []
    for _ in range(2):
        common.remembered("a", lambda: made.append(1) or made)
    assert made == [1] and common.remembered("b", list) == [] and list(common._remembered) == ["b"]
    common.forget()
    assert not common._remembered


def test_packing_gives_new_words_of_letters_to_the_merges(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    library, r = Tokenizer.from_file(path), random.Random(3)
    word = lambda: "".join(r.choice("abcdeÀéïZÿß") for _ in range(r.randint(1, 12))) + r.choice(["", "", ".", ",!", "$$$", "?:"])
    texts = [" ".join(word() for _ in range(200)) for _ in range(20)]
    texts += ["K\u212a \u212bb \u0130i \u03a3\u03a3 e\u0301a x\u00a0y a'll 12 \u00aa.", "", " ", "a\x1cb.\u2028c"]
    w, direct = packing.Words(path), []
    ids = w._direct
    monkeypatch.setattr(w, "_direct", lambda t: direct.append(t) or ids(t))
    got = [np.frombuffer(x, "<u4").tolist() for x in w.encode([t.encode() for t in texts])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [len(x) // 4 for x in w.encode([t.encode() for t in texts])] == [len(g) for g in got]  # nothing is new
    assert len(direct) < 25 and max(map(len, direct)) < 20  # kinds of marks, and words that aren't letters and marks


def test_packing_merges_letters_once_in_any_case_and_with_any_tail(monkeypatch):
    path = tokenizers.path("word_bpe_49k.json")
    w, merged = packing.Words(path), []
    merge = w._merged
    monkeypatch.setattr(w, "_merged", lambda runs: merged.extend(runs) or merge(runs))
    texts = ["Über über, ÜBER!! den\tDEN. den, x-y X-Y", "den über,", "", "  "] * 50
    got = [np.frombuffer(x, "<u4").tolist() for x in w.encode([t.encode() for t in texts])]
    assert got == [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(merged) == 2  # über, den


def test_packing_of_any_characters_in_any_segments(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    library, r = Tokenizer.from_file(path), random.Random(5)
    some = "aZéÀ×÷ßÿÞ.,!?'s-12<|> \t\n\r\x0b\x0c\x00\x1c\x85\u00a0\u2028\u0301\u0338\u0130\u03a3ªµ\u212a漢д\U0001f600"
    texts = ["".join(r.choices(some, k=r.randint(0, 60))) for _ in range(1500)]
    texts += ["Ab.é " * 700, "é" * 900, "a" * 900 + "1", "." * 900, " " * 900, "x" * 511 + " y", "x" * 512 + " y", "漢" * 300 + "  " + "Bé, " * 300, "", "<|endoftext|>"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    raw = [t.encode() for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Words(path).encode(raw)] == want
    monkeypatch.setattr(packing, "CHUNK", 256)  # texts longer than this go in several segments
    monkeypatch.setattr(packing, "chunks", lambda texts: common.chunks(texts, 256))
    w = packing.Words(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in w.encode(raw)] == want
    segments = list(packing.segments(common.packed([b"ab " * 200 + b"c" * 2000 + b" d"])[0]))
    assert len(segments) == 4 and all(x[-1] == 0x20 for x in segments) and max(map(len, segments)) > 2000
    monkeypatch.setattr(packing, "CACHE", 0)  # nothing is remembered
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Words(path).encode(raw[::-1])] == want[::-1]


def test_substring_dedup(docs):
    rows, df = docs
    least = {}
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - 12):
            least.setdefault(tuple(w[k : k + 13]), i)
    got = {r["doc_id"]: r for r in substring_dedup.deduplicate(df).collect()}
    assert got[0]["n"] == 0
    for i, t, _ in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for j in range(13)}
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), len(gone))
        assert got[i]["kept_text"].encode() == b" ".join(x for k, x in enumerate(w) if k not in gone)


def test_near_duplicates(docs):
    rows, df = docs
    sets = {i: near_dedup.shingle_set((t or "").encode(), 2) for i, t, _ in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(df, shingle=2).collect()}
    assert {i: got[i]["component_id"] for i in got} == root
    assert {i: got[i]["n_shingles"] for i in got} == {i: len(s) for i, s in sets.items()}


def test_near_duplicates_with_long_inserted_words(spark):
    r = random.Random(10)
    rows = []
    for i in range(30):
        base = [f"{r.randrange(2000):x}" for _ in range(200)]
        footer = [f"https://example.org/{i}/{j}/{'x' * 30}" for j in range(24 + i % 24)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + footer))]
    sets = {i: near_dedup.shingle_set(t.encode(), 2) for i, t in rows}
    assert all(0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) <= 0.9 for i in range(0, 60, 2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, shingle=2).collect()}
    assert got == {i: i - i % 2 for i in sets}


def test_warc(spark):
    rows = [(1, "http://a.example/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b.example", None), (4, "u", ""), (9, "u", "<p>é</p>"), (None, "u", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.fresh_path(spark, "test")
    index = warc.write(df, folder)
    got = {r["id"]: r for r in warc.read(index, folder).collect()}
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 9)] == [("revisit", 9), ("revisit", 9), ("response", None)]
    assert got[9]["payload"].decode() == "<p>é</p>"
    assert [(got[i]["payload_bytes"], got[i]["record_type"], got[i]["refers_to"]) for i in (3, 4)] == [(0, "revisit", 4), (0, "response", None)]
    assert warc.read(index.where("id = 4"), folder).count() == 1
    try:  # more groups than are broadcast: the same by joins
        warc.NAMED, most = 0, warc.NAMED
        folder = warc.fresh_path(spark, "test")
        joined = {r["id"]: r for r in warc.read(warc.write(df, folder), folder).collect()}
        assert joined == got
    finally:
        warc.NAMED = most
    assert list(warc.ranges([0, 10, 200_000], [10, 5, 7])) == [(0, 15, [0, 1]), (200_000, 200_007, [2])]


def test_quality_rules(spark):
    rows = [(1, "a b c a b c x"), (2, None), (3, "#x\n#x\n y |\n\n"), (4, "w " * 60), (5, "")]
    got = {r["doc_id"]: r for r in quality_rules.base_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[1][c] for c in ("n_words", "word_chars", "n_repeat_words", "n_dup_lines")] == [7, 7, 6, 0]
    assert [got[3][c] for c in ("n_words", "n_symbols", "n_dup_lines")] == [4, 3, 1]
    assert got[4]["n_repeat_words"] == 60 and got[4]["base_failed"] and got[2]["n_words"] == 0 and got[5]["base_failed"]


def test_quality_target_counts_every_trusted_row(spark):
    df = spark.range(41_000).selectExpr("id AS doc_id", "concat('w', id % 97) AS text")
    trusted = df.where("doc_id < 30000").select("doc_id").union(df.select("doc_id").limit(5))
    w = quality_rules.weights(df, trusted, buckets=64, smoothing=0.5).first()["w"]
    bucket = {r["text"]: r["b"] for r in df.limit(97).selectExpr("text", "pmod(xxhash64(text), 64) AS b").collect()}
    raw, target = np.zeros(64), np.zeros(64)
    for i in range(41_000):
        raw[bucket[f"w{i % 97}"]] += 1
        target[bucket[f"w{i % 97}"]] += i < 30_000
    want = np.log((target + 0.5) / (30_000 + 32)) - np.log((raw + 0.5) / (41_000 + 32))
    assert np.allclose(w, want, rtol=0, atol=1e-12)


def test_quality_rules_split_texts_once_and_join_alike_on_any_size(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcd") + r.choice("xy") * r.randrange(3) for _ in range(r.randrange(90))).replace("a", "a\n", r.randrange(4)) for _ in range(60)] + ["a b c a b c a b c", "x\n\n\nx\n \n \ny"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in quality_rules.base_columns(df).collect():
        w, lines = texts[x["doc_id"]].split(), [t for t in texts[x["doc_id"]].split("\n") if t.split()]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + j for i, t in enumerate(windows) if windows.count(t) > 1 for j in range(3)}
        assert (x["n_words"], x["word_chars"], x["n_repeat_words"], x["n_dup_lines"]) == (len(w), len("".join(w)), len(covered), len(lines) - len(set(lines)))
    plan = quality_rules.weights(df, df.where("doc_id < 5"))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert quality_rules.score(df, df).columns[-1] == "kept" and quality_rules.WORDS not in quality_rules.score(df, df).columns


def test_nearest(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((300, 16)).astype("float32")
    x[100:140] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    hit = 0
    got = nearest.nearest(df, F.col("vec_id") % 20 == 0, 5).collect()
    for i in range(0, 300, 20):
        s = (x.astype(float) * x[i].astype(float)).sum(1)
        s[i] = -np.inf
        best = sorted((-round(v, 9), j) for j, v in enumerate(s))[:5]
        mine = sorted((q for q in got if q["query_id"] == i), key=lambda q: q["rank"])
        assert len(mine) == 5
        hit += len({j for _, j in best} & {q["vec_id"] for q in mine})
    assert hit >= 0.9 * 75


def test_html():
    page = '<html><body><div id="header"><h1>S</h1></div><nav><a href=x>Home</a></nav><article><h1>T &amp; t</h1><p><b>one<br><p>two\n three<div class="comments"><p>no</p></div></article><form>f</form><footer>x'
    assert html_extract.text_of(page, None) == "T & t one two three"
    assert html_extract.text_of("", None) == "" and html_extract.text_of("a < b", None) == "a < b"


def test_automaton():
    a = toxicity.Automaton(["scoundrel", "fool"], ["wretch"])
    one = {"scoundrel": 1, "scoundre": 2, "scuondrel": 0, "scoondrel": 2, "scouundrel": 2, "foul": 0, "fool": 1, "wretchedly": 1, "wratchedly": 2, "clean": 0}
    assert {w: a.match(w) for w in one} == one


def test_toxicity_without_labels(docs, spark):
    _, df = docs
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.learn(df, none)).collect()
    assert all(r["predicted"] == 0 for r in got) and len(got) == df.count()


def test_bundles_open_to_what_went_in():
    r = np.random.default_rng(1)
    n = 5000
    spread = r.integers(0, 1 << 63, n).astype(np.uint64)
    columns = [r.integers(-9, 9, n).astype(kind) for _, kind in substring_dedup.NUMBERS]
    columns[1][:2] = substring_dedup.LAST, -5
    blobs = [b"w%d x" % i for i in r.integers(0, 99, n)]
    for strings in (blobs, None):
        sent = substring_dedup.bundles(7, spread, columns, strings)
        assert max(sent.column("many").to_pylist()) <= substring_dedup.BUNDLE
        got = [row for b in substring_dedup.opened(iter([sent])) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        key = lambda row: (row[:-1], row[-1] or b"")
        assert sorted(got, key=key) == sorted(zip(*(c.tolist() for c in columns), strings or [None] * n, strict=True), key=key)


def test_vectors_with_odd_components():
    import pyarrow as pa

    inf = float("inf")
    rows = [(1, [1.0, -0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (8, [3.0, 4.0])]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.list_(pa.float32()))], ["id", "v"])
    got = next(nearest._vectors(iter([batch])))
    assert got.column("id").to_pylist() == [1, 8] and got.column("length").to_pylist() == [1.0, 5.0]
    assert [np.frombuffer(v).tolist() for v in got.column("v").to_pylist()] == [[1.0, 0.0], [3.0, 4.0]]
