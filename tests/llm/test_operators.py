"""The operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import html
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import additive, components, decontaminate, html_text, mixing, passages, pii, similar, simhash, token_counts, token_store, toxicity
from quadrat.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 30_000 + "end"
TEXTS = [None, "", "   \n", "one", "Two words", "It's a test.\nNext  line, é😀", "<|endoftext|> x", LONG, "a\tb\x0bc", "same same same same", "same same same same"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a repeated row, a null id, and columns named like the operators' own."""
    rows = [(i, t, f"src{i % 3}" if i % 4 else None, i, "x", 1.0) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id here", "src1", 0, "x", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fp long, key string, size double")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def real(spark, sf_dir, name="documents", n=150):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").orderBy(F.col(spark.read.parquet(f"{sf_dir}/{name}.parquet").columns[0])).limit(n)


# ---- 1 -------------------------------------------------------------------------------
def test_token_store(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    store = token_store.TokenStore(spark, str(tmp_path / "s")).write(docs, path)
    store.verify()
    ids = {}
    model = Tokenizer.from_file(path)
    for i, t in [(r["doc_id"], r["text"] or "") for r in docs.collect()]:
        ids.setdefault(i, []).append([*model.encode(t, add_special_tokens=False).ids, 2])
    read = [(r["doc_id"], list(r["ids"])) for r in store.read().collect()]
    assert sorted(map(repr, read)) == sorted(repr((i, x)) for i, many in ids.items() for x in many)
    rows = sorted(store.digests().collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at and r["ids_crc32"] in [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[r["doc_id"]]]
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == [None, *sorted(i for i in ids for _ in ids[i] if i is not None)]
    assert store.chunks().count() == store.chunks().select("key").distinct().count()
    assert token_store.TokenStore(spark, str(tmp_path / "e")).write(none, path).digests().count() == 0


def test_store_finds_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    store = token_store.TokenStore(spark, str(tmp_path / "d")).write(df, vocabulary("byte_bpe_50k.json"))
    bad = spark.read.parquet(str(tmp_path / "d/first/kind=chunk")).withColumn("key", F.lit(b"0" * 16))
    bad.write.parquet(str(tmp_path / "d2/first/kind=chunk"))
    spark.read.parquet(str(tmp_path / "d/about")).write.parquet(str(tmp_path / "d2/about"))
    with pytest.raises(Exception, match="does not match its key"):
        token_store.TokenStore(spark, str(tmp_path / "d2")).chunks().collect()
    assert store.manifest().count() == 1


@pytest.mark.parametrize("what", ["recipe", "chunk", "manifest", "order"])
def test_store_finds_what_is_missing(spark, tmp_path, what):
    """A recipe, a chunk or a part of the manifest taken away, or two documents exchanged."""
    rng = random.Random(4)
    df = spark.createDataFrame([(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))) for k in range(50)], "doc_id long, text string")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    whole = token_store.TokenStore(spark, a).write(df, vocabulary("byte_bpe_50k.json"))
    assert whole.digests().count() == 50 and whole.read().count() == 50
    for folder in ("about", "root", "first", "recipes"):
        rows = spark.read.parquet(f"{a}/{folder}")
        if folder == "first" and what == "chunk":
            gone = rows.where("kind = 'chunk'").agg(F.min("key")).first()[0]
            rows = rows.where((F.col("kind") != "chunk") | (F.col("key") != F.lit(gone)))
        if folder == "recipes" and what == "recipe":
            rows = rows.where("kind != 'recipe' or i != 17")
        if folder == "recipes" and what == "manifest":
            part = rows.where("i = 17").first()["part"]
            rows = rows.where(f"part != {part}")
        if folder == "recipes" and what == "order":
            two = rows.where("kind = 'recipe'").groupBy("part").agg(F.min("pos").alias("p"), F.max("pos").alias("q")).where("p < q").first()
            swap = F.when(F.col("pos") == two["p"], two["q"]).when(F.col("pos") == two["q"], two["p"]).otherwise(F.col("pos"))
            rows = rows.withColumn("pos", F.when((F.col("kind") == "recipe") & (F.col("part") == two["part"]), swap).otherwise(F.col("pos")))
        rows = rows.coalesce(1)
        (rows.write.partitionBy("kind") if "kind" in rows.columns else rows.write).parquet(f"{b}/{folder}")
    for ask in (lambda s: s.digests(), lambda s: s.read()):
        with pytest.raises(Exception, match="manifest|recipe says"):
            ask(token_store.TokenStore(spark, b)).collect()


def test_encoder_equals_library():
    path = vocabulary("byte_bpe_50k.json")
    encoder = token_store.Encoder(open(path, encoding="utf-8").read(), most_words=50)
    rng = random.Random(3)
    parts = ["the", "Ünï", "don't", "x1", "\n", "\n\n", " ", "  ", "\t", ".", ", ", "?!", "日", "²", "'s", " ", " ", "<|endoftext|>", "\x1c", "é.", "A,b"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(1500)]
    assert encoder.encode(texts) == encoder.whole(texts)


def test_chunks_and_crc():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 20_000).astype("<u4")
    ends = token_store.cut_points(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= token_store.MOST and (sizes[:-1] >= token_store.LEAST).all()
    moved = token_store.cut_points(np.concatenate([ids[:777], ids]))
    assert len({tuple(ids[a:z]) for a, z in zip([0, *ends], ends)} & {tuple(np.concatenate([ids[:777], ids])[a:z]) for a, z in zip([0, *moved], moved)}) > len(ends) * 0.8
    a, b = b"hello ", b"world!" * 50
    got = token_store.shift(np.array([zlib.crc32(a)], np.uint64), np.array([len(b)], np.uint64))[0] ^ np.uint64(zlib.crc32(b))
    assert int(got) == zlib.crc32(a + b)


# ---- 2 -------------------------------------------------------------------------------
def test_decontamination(spark, docs, none):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(14, 60)))) for k in range(30)] + [(90, None), (91, ""), (92, "tiny item"), (93, " ".join(words[:20])), (94, " ".join(words[:20]))]
    rows = []
    for n in range(60):
        k, t = items[rng.randrange(30)]
        w = t.split()
        for _ in range(n % 3):
            w[rng.randrange(len(w))] = "zzz"
        rows.append((n, " ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(40))] + w + [f"u{rng.randrange(10**6)}" for _ in range(9)])))
    rows += [(100, " ".join(words[:20]).upper() + "!"), (101, "a tiny item here"), (102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(df, bench).collect()}
    index = next(decontaminate.indexes(bench, "item_id", "text"))
    want = {}
    from collections import Counter

    for i, t in rows:
        found = decontaminate.words(t or "")
        for k, x in enumerate(index.texts):
            best = max((decontaminate.similarity(Counter(decontaminate.shingles(found[s : s + len(x)])), index.bags[k], index.weight) for s in range(max(1, len(found) - len(x) + 1)) if found), default=0)
            if best >= decontaminate.LEAST - 1e-12:
                want[i, index.ids[k]] = best
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    assert (100, 93) in got and (101, 92) in got
    clean = {r[0] for r in decontaminate.without_items(df, bench).select("doc_id").collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.contaminated(docs, bench.where("item_id < 90")).count() == 0 and decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.without_items(docs, bench.limit(0)).count() == docs.count() and decontaminate.without_items(none, bench).count() == 0
    twice = df.where("doc_id = 100").union(df.where("doc_id = 100")).union(df.where("doc_id = 102")).withColumn("item_id", F.lit("x"))
    assert decontaminate.contaminated(twice, bench).count() == 2 and [r["doc_id"] for r in decontaminate.without_items(twice, bench).collect()] == [102]


def test_index_of_fingerprints():
    """The multi-index finds all fingerprints in the radius and looks at few others; similar texts lie in the radius."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(5000)]
    texts = [[words[k] for k in rng.integers(0, 5000, rng.integers(20, 120))] for _ in range(1500)]
    index = decontaminate.Index(list(range(1500)), texts, {}, 1.0)
    seen = 0
    for k in range(300):
        fp = index.prints[rng.integers(1500)].copy()
        flips = rng.choice(decontaminate.BITS, rng.integers(0, 90), replace=False)
        np.bitwise_xor.at(fp, flips // 8, np.left_shift(1, flips % 8).astype(np.uint8))
        apart = np.bitwise_count(index.prints ^ fp).sum(axis=1)
        assert index.within(fp) == [(int(i), int(apart[i])) for i in np.flatnonzero(apart <= decontaminate.RADIUS)]
        seen += len(index.candidates(fp))
    assert seen < 0.02 * 300 * 1500
    lost = total = 0
    for k, t in enumerate(texts):
        w = list(t)
        for at in rng.choice(len(w), max(1, len(w) // 45), replace=False):
            w[at] = "zzz"
        if decontaminate.similarity(decontaminate.Counter(decontaminate.shingles(w)), index.bags[k], lambda s: 1.0) >= 0.8:
            found = decontaminate.shingles(w)
            total += 1
            lost += k not in [i for i, _ in index.within(decontaminate.fingerprint(decontaminate._hashes(found), np.ones(len(found))))]
    assert total > 500 and lost <= 0.005 * total


def test_decontamination_in_blocks(spark, monkeypatch):
    """Several blocks give what one gives: weights and equal items are those of the whole benchmark."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    common = [rng.sample(words, 12) for _ in range(3)]
    items, rows = [], []
    for k in range(40):
        body = rng.sample(words, 30)
        for c in rng.sample(common, k % 3):
            body += c
        items.append((k, " ".join(body)))
    items += [(100 + k, t.upper().replace(" ", ", ") + "!") for k, t in items[:10]]
    for n in range(120):
        w = items[n % 40][1].split()
        for at in rng.sample(range(len(w)), n // 40):
            w[at] = "zzz"
        if n % 2:  # a shingle of the benchmark that this item has not
            w[5:10] = common[n % 3][:5]
        rows.append((n, " ".join(rng.sample(words, 10) + w + common[n % 3])))
    df, bench = spark.createDataFrame(rows + [(500, None)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.contaminated(df, bench).collect()))
    clean = sorted(r["doc_id"] for r in decontaminate.without_items(df, bench).collect())
    monkeypatch.setattr(decontaminate, "MOST_ITEMS", 10)
    assert len(list(decontaminate.indexes(bench, "item_id", "text"))) > 1
    many = sorted(map(tuple, decontaminate.contaminated(df, bench).collect()))
    assert [x[:5] for x in many] == [x[:5] for x in one] and [x[5] for x in many] == pytest.approx([x[5] for x in one])
    assert 0 < len(clean) < len(rows) and {x[1] for x in one} <= set(range(40))
    assert sorted(r["doc_id"] for r in decontaminate.without_items(df, bench).collect()) == clean


# ---- 3 -------------------------------------------------------------------------------
def test_toxicity(spark, docs, none):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(800):
        w = [f"w{rng.randrange(60)}" for _ in range(30)]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        w += ["insultword"] * insult + ["groupword"] * group
        rows.append((i, " ".join(w)))
        labels.append((i, int(insult and group), 1))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, lab).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in got)
    # neither word decides alone: only the pair does
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) / len(held) > 0.97
    assert toxicity.accepted(df, lab).count() == sum(r["predicted"] == 0 for r in got.values())
    odd = toxicity.toxicity(docs, lab).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.toxicity(none, lab).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.toxicity(docs, lab.limit(0)).collect())


def test_machine_against_all_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.Machine(np.arange(12), 0.3, rng.normal(size=12), rng.normal(size=(12, toxicity.FACTORS)))
    rows = [np.sort(rng.choice(12, n, replace=False)) for n in (0, 1, 2, 5, 12)]
    want = [0.3 + m.weights[r].sum() + sum(m.vectors[a] @ m.vectors[b] for k, a in enumerate(r) for b in r[:k]) for r in rows]
    assert m.logits(rows) == pytest.approx(want)
    texts = ["", None, "some Insults here", "insults " * 3000]
    scorer = toxicity.Scorer(toxicity.Machine(np.array(sorted(toxicity.terms("some insults words"))), -1.0, rng.normal(size=10)[: len(toxicity.terms("some insults words"))], rng.normal(size=(len(toxicity.terms("some insults words")), 8))))
    place = scorer.place
    for t, got in zip(texts, scorer(texts)):
        r = [place[x] for x in toxicity.terms(t or "") if x in place]
        z = -1.0 + scorer.model.weights[r].sum() + sum(scorer.model.vectors[a] @ scorer.model.vectors[b] for k, a in enumerate(r) for b in r[:k])
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_of_odd_labels(spark):
    """Null and conflicting labels, repeated ids: the bound holds for the rows learned from."""
    docs = spark.createDataFrame([(k % 40, f"good text {k}" if k % 2 else f"vile text {k}", "x") for k in range(400)] + [(None, "vile", "x"), (7, None, "x")], "doc_id long, text string, toxic string")
    lab = spark.createDataFrame([(k, 1 - k % 2) for k in range(40)] + [(3, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in toxicity.toxicity(docs, lab.where("toxic is null")).collect()}) == 1
    kept = toxicity.accepted(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got)


# ---- 4 -------------------------------------------------------------------------------
def test_mixing(spark, docs, none, duck, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(df).collect()
    want = duck.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.MIX_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    by = {}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    for (size, target), many in by.items():
        assert target <= 2 * size + 1e-9
        assert abs(sum(r["taken"] for r in many) - target) <= max(r["size"] for r in many) / 2 + 1e-6
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    # longer documents are likelier, in proportion to their bit length
    chosen = mixing.plan(mixing.keep(mixing._keyed(df, "doc_id", "text", "source"), "test")).where("p > 0 and p < 1").collect()
    assert len({(r["s"], r["p"]) for r in chosen}) > len({r["s"] for r in chosen})
    slopes = {}
    for r in chosen:
        slopes.setdefault((r["none"], r["s"]), []).append(r["p"] / r["bits"])
    assert all(max(x) == pytest.approx(min(x)) for x in slopes.values())
    odd = mixing.mix(docs).collect()
    assert len(odd) == docs.count() and all(r["taken"] == 0 for r in odd if r["size"] == 0)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["taken"] // r["size"] for r in odd if r["size"]) + out.where("coalesce(trim(text), '') = '' or trim(replace(text, '\n', '')) = ''").count()


# ---- 5 -------------------------------------------------------------------------------
def test_passages(spark, docs, none, sf_dir):
    assert passages.chains([(0, 10, 5), (5, 15, 5), (60, 71, 5), (70, 5, 5)])[0][0][0] == 0
    rng = random.Random(8)
    junk = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for n in range(20):
        p = junk(55 + n)
        for c in range(2 + n % 3):
            q = list(p)
            if c and n % 2:
                q[25] = "edit"
            rows.append((n * 10 + c, " ".join(junk(rng.randrange(60)) + q + junk(rng.randrange(60)))))
    rows += [(1000 + k, " ".join(junk(300))) for k in range(20)] + [(2000, " ".join(["la"] * 500)), (2001, None), (2002, "")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows if i < 1000}
    assert all(r["n_words"] >= 50 and r["similarity"] >= 0.8 for r in got)
    same = [r for r in passages.repeated_passages(docs).collect()]
    assert same == [] and passages.repeated_passages(none).count() == 0  # a repeated row is no partner of itself
    df = real(spark, sf_dir, n=200)
    index = {}
    for r in df.collect():
        w = passages.words(r["text"])
        for k in range(len(w) - 49):
            index.setdefault(tuple(w[k : k + 50]), set()).add(r["doc_id"])
    exact = {i for v in index.values() if len(v) > 1 for i in v}
    assert exact <= {r["doc_id"] for r in passages.repeated_passages(df).collect()}


def test_passages_of_the_least_length_with_an_edit(spark):
    """50 words with one changed (similarity 41/51) keep a chain wherever the change is."""
    rng = random.Random(15)
    junk = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for n in range(720):
        p = junk(50)
        q = list(p)
        q[7 + n % 36] = "edit"
        rows += [(2 * n + c, " ".join(junk(30) + x + junk(30))) for c, x in enumerate((p, q))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}


def test_passages_of_frequent_lines(spark):
    """Two documents share stock lines that ten others hold one of each: only they share the passage."""
    rng = random.Random(16)
    junk = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for g in range(30):
        a, b = junk(30), junk(20 + g % 11)
        for k in range(24):
            line = a + b if k in (11, 12) else (a if k % 2 else b)
            rows.append((g * 100 + k, " ".join(junk(20) + line + junk(20))))
        want |= {g * 100 + 11, g * 100 + 12}
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == want
    assert all(abs(r["doc_id"] - r["other_id"]) == 1 and r["n_words"] >= 50 for r in got)


def test_passages_edited_among_frequent_lines(spark):
    """Texts of a passage that share common lines alone, with words changed between them, are compared with each other."""
    rng = random.Random(18)
    junk = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for g in range(30):
        a, b = junk(25 + g % 7), junk(25 + g % 5)
        for k in range(24):
            line = a + junk(1) + b if k in (11, 12) else (a if k % 2 else b)
            rows.append((g * 100 + k, " ".join(junk(20) + line + junk(20))))
        want |= {g * 100 + 11, g * 100 + 12}
    rows += [(5000 + k, " ".join(junk(20) + ["la"] * (26 + k % 20) + junk(20))) for k in range(30)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == want
    assert all(abs(r["doc_id"] - r["other_id"]) == 1 and r["n_words"] >= 50 for r in got)


def test_passages_of_many_holders(spark):
    """Frequent passages: exact ones are never lost, edited ones hardly, copies are one row each."""
    rng = random.Random(17)
    junk = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, exact, fuzzy, clean = [], set(), set(), set()

    def add(i, *parts):
        rows.append((i, " ".join(w for p in parts for w in p)))
        return i

    # two of 132 documents share 80 words, the others 16 of them each
    p = junk(80)
    for k in range(130):
        at = rng.randrange(64)
        clean.add(add(k, junk(20), p[at : at + 16], junk(20)))
    exact |= {add(60_000, junk(9), p, junk(9)), add(60_001, junk(9), p, junk(9))}
    # 24 holders of a passage, half with a word changed; ids in random order
    for g in range(20):
        p = junk(rng.randrange(60, 110))
        for k in rng.sample(range(24), 24):
            q = list(p)
            if k >= 12:
                q[rng.randrange(8, len(q) - 8)] = f"e{rng.randrange(10**9)}"
            (fuzzy if k >= 12 else exact).add(add(1000 + g * 100 + rng.randrange(4) * 24 + k, junk(rng.randrange(30)), q, junk(rng.randrange(30))))
    # near copies of a long text, exact copies, a long insertion, and one id with two texts
    p = junk(400)
    for k in range(60):
        q = list(p)
        for _ in range(4):
            q[rng.randrange(len(q))] = "edit"
        exact.add(add(5000 + k, q))
    copies = [add(6000 + k, p[:120]) for k in range(9)]
    p = junk(200)
    exact |= {add(7000, p), add(7001, p[:100], junk(500), p[100:])}
    q = junk(60)
    exact |= {add(7002, q), add(7003, q), add(7003, junk(70))}
    clean |= {add(8000 + k, junk(100)) for k in range(30)} | {add(8100 + k, ["short", "copy"]) for k in range(9)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(df).collect()
    got = {r["doc_id"] for r in found}
    assert exact <= got and len(fuzzy & got) >= 0.9 * len(fuzzy) and not clean & got
    assert sum(r["n_words"] for r in found if r["doc_id"] == 7001) >= 198
    assert sorted((r["doc_id"], r["start_word"], r["n_words"], r["other_id"]) for r in found if r["doc_id"] in copies) == [(i, 0, 120, 6000 if i > 6000 else 6001) for i in copies]
    text = {}
    for i, t in sorted(rows):
        text[i] = f"{text[i]} \0 {t}" if i in text else t
    for r in found:  # what is reported is there
        a, b = passages.words(text[r["doc_id"]]), passages.words(text[r["other_id"]])
        assert a[r["start_word"] : r["start_word"] + 4] == b[r["other_start"] : r["other_start"] + 4] and r["doc_id"] != r["other_id"]


def test_passages_of_near_copies_grow_with_the_rows(spark, monkeypatch):
    """Of texts with edits all over, the longer run of every core is found, by links that grow with the texts and not with their pairs."""
    rng = random.Random(19)
    junk = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    base = junk(150)
    texts = [[w if rng.random() > 0.07 else junk(1)[0] for w in base] for _ in range(160)]
    before = [rng.randrange(30) for _ in texts]
    rows = [(k, " ".join(junk(x) + t + junk(9))) for k, (t, x) in enumerate(zip(texts, before))]
    # what one run of 150 "la" has in common with one of 60 is found in whole
    rows += [(1000, " ".join(junk(9) + ["la"] * 150 + junk(9))), (1001, " ".join(junk(9) + ["la"] * 60 + junk(9)))]
    want = [set() for _ in texts]
    for a in range(len(texts)):
        for b in range(len(texts)):
            runs, at = [], 0
            for same, g in itertools.groupby(x == y for x, y in zip(texts[a], texts[b])):
                n = len(list(g))
                runs += [(at, n)] if same else []
                at += n
            for (p, n), (q, m) in zip(runs, runs[1:]):
                gap = q - p - n
                if a != b and n + m >= 40 + 8 * gap and n + gap + m >= 50 and min(n, m) >= 5 * gap and max(n, m) >= 25:
                    want[a] |= set(range(p, p + n) if n >= m else range(q, q + m))
    chains, keep = [], passages.keep
    monkeypatch.setattr(passages, "keep", lambda df, what: (kept := keep(df, what), chains.append(kept.count()) if what == "passage-chains" else None)[0])
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {}
    for r in got:
        assert r["n_words"] >= 50 and r["similarity"] >= 0.8
        found.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
    assert sum(map(len, want)) > 5000
    assert [k for k, w in enumerate(want) if not w <= {x - before[k] for x in found.get(k, ())}] == []
    assert found[1000] >= set(range(9, 159)) and found[1001] == set(range(9, 69))
    assert sum(chains) <= 8 * len(rows)


def test_alignment_keeps_what_lies_between_edits():
    """Two runs that make a passage are kept though cuts at the widest gaps of their neighbours would part them."""
    a, b, at = [], [], None
    for k, n in enumerate((13, 13, 25, 11, 37, 26, 13, 5, 43)):
        at = (len(a), 64) if n == 37 else at
        run = [f"w{k}.{x}" for x in range(n)]
        a += [*run, f"a{k}"]
        b += [*run, f"b{k}"]
    found = passages.align(a, b, [(at[0], at[0], 37), (at[0] + 38, at[0] + 38, 26)])
    assert any(s <= at[0] and e >= at[0] + 64 and alike >= 0.8 for s, e, _, _, alike in found)


def test_fenwick():
    rng = random.Random(1)
    tree, plain = [(0.0, -1)] * 33, {}
    for n in range(200):
        at, value = rng.randrange(1, 33), rng.random()
        passages.raise_prefix(tree, at, (value, n))
        plain[at] = max(plain.get(at, (-1.0, -1)), (value, n))
        ask = rng.randrange(0, 33)
        assert passages.max_prefix(tree, ask) == max([v for k, v in plain.items() if k <= ask], default=(-1.0, -1))


# ---- 6 -------------------------------------------------------------------------------
def test_neighbours(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in additive.search(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        cos = unit @ unit[k]
        cos[k] = -2
        near = ids[np.lexsort((ids, -cos))[:5]]
        found = got[ids[k]]
        assert sorted(found) == [1, 2, 3, 4, 5]
        hits, total = hits + len({v for v, _ in found.values()} & set(near.tolist())), total + 5
        assert all(s == pytest.approx(cos[ids == v][0], rel=1e-9) for v, s in found.values())
    assert hits / total >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1)] + [(k, [1.0, 0.0], 1) for k in range(1, 9)] + [(20, None, 1), (21, [0.0, 0.0], 1), (22, [None, 1.0], 1), (23, [float("nan"), 1.0], 1), (24, [float("inf"), 1.0], 1), (50, [0.0, 2.0], 1), (100, [1.0], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in additive.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4]}
    assert additive.search(df.limit(0)).count() == 0
    assert additive.search(df.where("vec_id in (0, 1)")).count() == 1


@pytest.mark.parametrize("noise", [0.1, 0.01, 0.0])
def test_neighbours_in_a_large_group(spark, noise):
    """A full Arrow batch, a third of it near copies of one vector: nothing is lost to the short list."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(10_000, 64))
    group = rng.permutation(10_000) < 3400
    x[group] = x[0] + noise * rng.normal(size=(group.sum(), 64))
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    got = {}
    for r in additive.search(df, every=100, most_fit=1024).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    size = np.sqrt((x * x).sum(-1))
    for k in range(0, 10_000, 100):
        cos = (x * x[k]).sum(-1) / (size * size[k])
        cos[k] = -2
        assert got[k] == np.lexsort((np.arange(10_000), -cos))[:5].tolist()


# ---- 7 -------------------------------------------------------------------------------
def test_html(spark, sf_dir):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site name</h2></header><nav><ul><li><a href=x>Home</a></ul></nav>
    <main><article><h1>Big &amp; bold</h1><script>var t="</p>"</script><p>First paragraph of a story,<br>with   two lines. It goes on.</p><p>Short.</p>
    <div class="share">Share this</div><aside>Related things</aside><section id="comments"><article class="comment"><p>Nice post, I liked it a lot. Really.</p></article></section></article></main>
    <form><p>Subscribe to our newsletter today, it is free.</p><button>Go</button></form><div class="cookie-notice">We use cookies.</div><footer>&copy; 2020</footer></body></html>"""
    assert html_text.main_text(page) == "Big & bold\nFirst paragraph of a story, with two lines. It goes on.\nShort."
    for odd in (None, "", "<p>", "<", "<!-- x", "<script>x", "<a" * 50_000, "<div>" * 3000, "</div></p>"):
        assert isinstance(html_text.main_text(odd), str)
    df = real(spark, sf_dir, "pages", 100).withColumn("t", F.lit(1))
    for r in html_text.extract(df).join(df.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        body = re.sub(r"<[^>]*$", "", re.sub(r"</?b>", "", re.sub(r"</?(p|h1)>", "\n", body.replace("<br>", " "))))
        want = "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in body.split("\n")) if x)
        assert r["text"] == want and r["n_chars"] == len(want)
    odd = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>A text, of some length. It has sentences.</p>")], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in html_text.extract(odd).collect()) == [0, 0, 41]
    assert html_text.extract(odd.limit(0)).count() == 0


def test_html_where_names_mislead():
    """Names of what stands beside, parts of the content, and pages without an article element."""
    a = "A paragraph of some length about the harbour, its boats and the people who work there. It has two sentences, as paragraphs do, and some more words."
    b = "Another one follows it. The boats leave before light, and come back when the market opens; what they bring is sold within the hour, as a rule."
    body, want = f"<p>{a}</p><p>{b}</p>", f"{a}\n{b}"
    legal = "<div><p>Copyright 2020 The Harbour Post. All rights reserved. No part of this page may be reproduced in any form without permission.</p></div>"
    menu = "<div>" + "".join(f"<div><a href=x>{m}</a></div>" for m in ("Home", "News", "Boats")) + "</div>"
    for page in (f'<main class="content has-sidebar">{body}</main>', f'<div class="layout-with-nav">{body}</div>', f'<div class="post-header-image content">{body}</div>', f"<article>{body}</article>{legal}", f"{menu}<div>{body}</div>{legal}", f"{menu}<table><tr><td>{body}</td></tr></table><div>© 2020 The Post</div>"):
        assert html_text.main_text(page) == want, page
    assert html_text.main_text(f'<article><header class="entry-header"><h1>My title</h1></header>{body}</article>') == f"My title\n{want}"
    assert html_text.main_text(f"<article>{body}<p>So.</p></article><div class=comments><article>{body}</article></div>") == f"{want}\nSo."


def test_cut_overturns_the_classifier():
    """A short line between paragraphs, which alone would be left out, goes with its neighbours."""
    text = "A sentence of a fair length which is part of the article here. And one more, to be sure that it is taken for one of them."
    page = html_text.Page(f"<div><div>{text}</div><div>by <a>hand</a> and by eye</div><div>{text}</div></div>")
    odds = [html_text.log_odds(page, b) for b in page.blocks]
    assert odds[0] > 0 > odds[1] and odds[2] > 0
    assert html_text.minimum_cut(odds, html_text.ties(page)) == [True, True, True]


def test_minimum_cut_against_all_labellings():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(2, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        arcs = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda lab: sum(max(z, 0) if not x else max(-z, 0) for z, x in zip(odds, lab)) + sum(c for a, b, c in arcs if lab[a] != lab[b])
        best = min(cost([m >> k & 1 for k in range(n)]) for m in range(1 << n))
        assert cost(html_text.minimum_cut(odds, arcs)) == pytest.approx(best)


# ---- 8 -------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(spark, docs, none, name, sf_dir):
    counter = token_counts.Counter(name, open(vocabulary(name), "rb").read())
    rows = docs.select("doc_id", "text").union(real(spark, sf_dir, n=60).select("doc_id", "text"))
    got = token_counts.token_counts(rows.withColumn("n", F.lit(1)), vocabulary(name), piece_chars=500, batch_bytes=3000).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), counter.encode([r["text"] or ""])[0]) for r in rows.collect()]
    assert sorted(map(repr, [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got])) == sorted(map(repr, want))
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert token_counts.token_counts(none, vocabulary(name)).count() == 0


# ---- 9 -------------------------------------------------------------------------------
def plain_fingerprint(text):
    import xxhash

    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h)) if h else 0


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                root[find(a)] = find(b)
    return [find(x) for x in range(len(prints))]


def test_simhash(spark, docs, none, sf_dir):
    df = docs.select("doc_id", "text", "fp").where("doc_id is not null").union(real(spark, sf_dir).select(F.col("doc_id") + 1000, "text", F.lit(0)))
    rows = df.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    group = brute_components(prints)
    least = {}
    for g, r in zip(group, rows):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = sorted((r["doc_id"], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group))
    assert sorted(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_duplicates(docs).count() == docs.count()


def plain_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return out


def similar_groups(texts):
    """Components of five-word Jaccard similarity 0.8 by brute force."""
    sets = plain_sets(texts)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                root[find(a)] = find(b)
    return [find(x) for x in range(len(sets))]


def test_one_of_each(spark, docs, none, sf_dir):
    rng = random.Random(21)
    junk = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, line = [], junk(12)

    def add(words):
        rows.append((len(rows) * 7 % 1009, " ".join(words), "x", len(rows)))

    for size in (8, 20, 60, 300):  # near copies with more and more edits, in groups small and large
        for n in (2, 5, 40):
            base = junk(size)
            for k in range(n):
                w = list(base)
                for _ in range(min(k % 4, size // 50 + k % 2)):
                    w[rng.randrange(size)] = f"e{rng.randrange(9**9)}"
                add(w + line * (k % 2))
    for _ in range(60):  # a common line, unlike texts
        add(line + junk(40))
    add(["two", "Words"]), add(["two", "words"]), add(["two", "other"])
    df = spark.createDataFrame([*rows, (None, "  ", "x", 1), (None, None, "x", 1), (5000, "", "x", 1), (5001, rows[0][1], "x", 1), (5001, rows[0][1], "x", 1)], "doc_id long, text string, fp string, tag long")
    given = df.collect()
    groups = similar_groups([r["text"] for r in given])
    least = {}
    for g, r in zip(groups, given):
        least[g] = min(least.get(g, 10**9), 10**8 if r["doc_id"] is None else r["doc_id"])
    kept = similar.one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert similar.one_of_each(none).count() == 0 and similar.one_of_each(docs).columns == docs.columns
    real_rows = real(spark, sf_dir, n=300)
    texts = [(r["doc_id"], r["text"]) for r in real_rows.collect()]
    least = {}
    for g, (i, _) in zip(similar_groups([t for _, t in texts]), texts):
        least[g] = min(least.get(g, i), i)
    assert sorted(r["doc_id"] for r in similar.one_of_each(real_rows).collect()) == sorted(least.values())


def test_all_that_share_a_band_are_compared(spark):
    """Pairs of similar texts among many unlike ones that share a band with both are linked."""
    rng = random.Random(22)
    junk = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(3):  # 250 texts similar to 0.77, some in pairs similar to 0.802
        base = junk(91)
        for k in range(250):
            w = base + junk(13)
            texts.append(w)
            if k % 10 == 0:
                texts.append([*w[:-11], *junk(11)])
    texts = [" ".join(w) for w in texts]
    rng.shuffle(texts)
    least = {}
    for i, g in enumerate(similar_groups(texts)):
        least.setdefault(g, i)
    kept = similar.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_links_in_crowded_cells(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(300):  # a cloud of near fingerprints, and chains away from it
        x = rng.choice(list(prints))
        prints.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * (rng.random() < 0.7))
    prints |= {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    signed = [p - (1 << 64) * (p >> 63) for p in prints]
    got = components.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")))
    root = {r["node"]: r["root"] for r in got.collect()}
    group = brute_components(prints)
    assert len({root.get(p, p) for p in signed}) == len(set(group))
    pairs = {(root.get(p, p), g) for p, g in zip(signed, group)}
    assert len(pairs) == len(set(group))


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(51)} == {0} and {got[k] for k in range(100, 140)} == {100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 10 ------------------------------------------------------------------------------
FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def luhn(d):
        return sum((2 * x - 9 if x > 4 else 2 * x) if k % 2 else x for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for k, (kind, p) in enumerate(FORMS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, docs, none):
    rng = random.Random(9)
    bits = ["a@b.c", "x.y@z.com_d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1.1", "4111 1111 1111 1111", "4111-1111--1111-1111", "+1 (555) 123-4567", "555-123-4567", "+12", "call ", " é😀 ", "joe [at] ex [dot] com", "0 " * 30, "@", "..", "a.b@c", "+", "-", " ", "card: 4222222222222"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(8))) for _ in range(400)] + ["1." * 5000, "a." * 4000 + "@x", "x@" + "a." * 4000 + "b", "1 " * 20_000]
    df = docs.select("doc_id", "text", "key").union(spark.createDataFrame([(1000 + k, t, "y") for k, t in enumerate(texts)], "doc_id long, text string, key string"))
    rows = {}
    for r in df.collect():
        rows.setdefault(r["doc_id"], r["text"])
    for r in pii.report(df).collect():
        want = base_spans(rows[r["doc_id"]])
        said = ",".join(f"{list(FORMS)[k]}:{s}:{e}" for s, k, e in want)
        assert [r[f"n_{k}"] for k in FORMS] == [sum(x[1] == k for x in want) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        found = r["spans"].split(",") if r["spans"] else []
        assert set(said.split(",")) - {""} <= set(found)
    assert pii.report(none).count() == 0


def test_learned_labelers():
    shape = (1, 0, 0, 0)
    w = pii.learn([(1, 1, 1, 1, 1, *shape, 50), (1, 0, 0, 1, 1, *shape, 400), (0, 0, 0, 1, -1, *shape, 30), (0, -1, -1, -1, -1, *shape, 500), (0, 0, 0, -1, 0, *shape, 300)])
    score = lambda v: w[0] + sum(a * b for a, b in zip(w[1:], v))
    assert score((1, 0, 0, 1, 1, *shape)) > 0 > score((0, -1, -1, -1, -1, *shape)) and pii.learn([])[0] < 0
    # shapes speak where votes are silent: those that go with the sure votes
    w = pii.learn([(1, 1, 1, 1, 1, 1, 1, 0, 0, 300), (0, -1, -1, -1, -1, 0, 0, 1, 0, 300), (0, 0, 0, 1, 0, 1, 1, 0, 0, 20), (0, 0, 0, 1, 0, 0, 0, 1, 0, 20)])
    assert score((0, 0, 0, 0, 0, 1, 1, 0, 0)) > score((0, 0, 0, 0, 0, 0, 0, 1, 0))


def test_added_spans(spark):
    """What the method adds: written-out addresses, national numbers and cards with cues; not what is listed as other."""
    rng = random.Random(3)
    good = ["write to joe [at] example [dot] com today", "call 555-234-4567 now", "phone (212) 555-0187 please", "mail: ann(at)post.org"]
    bad = ["order no 123-456-7890x", "ratio 111-111-1111/2 key=000-100-0000-5", "see x [at] home", "hash 0101-0101-0101-0101-01"]
    base = ["mail a.b@example.com", "phone +1 212 555 0187", "card 4111 1111 1111 1111", "host 10.2.33.4"]
    rows = [(n, " ".join(f"w{rng.randrange(99)}" for _ in range(4)) + " " + (good + bad + base)[n % 12] + " end") for n in range(600)] + [(600, None), (601, "")]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, t in rows:
        found = got[n]["spans"].split(",") if got[n]["spans"] else []
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in found)]
        assert spans == sorted(spans, key=lambda x: (x[1], pii.KINDS.index(x[0]))) and all(x[2] <= y[1] for x, y in zip(spans, spans[1:]))
        if n < 600:
            assert len(spans) == (n % 12 < 4 or n % 12 >= 8), (t, found)
            want = ["joe [at] example [dot] com", "555-234-4567", "(212) 555-0187", "ann(at)post.org"]
            assert n % 12 >= 4 or t[spans[0][1] : spans[0][2]] == want[n % 12]


# ---- pipeline -------------------------------------------------------------------------
def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = pipeline.keep(out, "test")
        kept[name] = [r["doc_id"] for r in docs.collect()]
    assert len(kept["near_duplicates"]) == len(set(kept["near_duplicates"])) <= len(kept["toxicity"]) < len(given)
    assert len(kept["near_duplicates"]) == len(set(similar_groups([given[i] for i in kept["toxicity"]])))
    rows = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(rows) == len(kept["mixing"])
    assert pipeline.run(spark, sf_dir).count() == len(rows)
