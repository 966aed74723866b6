"""The corpus operators against brute force, round trips and held-out labels, and on awkward tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import bpe, chat_format, common, embedding_dedup, fingerprints, license_scan, packing, quality, sharding, simhash, toxicity
from tallyweave.llm.common import components, gapless, table
from tallyweave.llm.labels import held_out
from tallyweave.llm.tokens import WordEncoder, load, tokenizer_path

ODD = [
    None, "", " ", "\n\n", "a", "The MIT License. the mit license", "General Public License, Apache License", "x\x1cy \x1d z", "a \n\nb  c d", "<|endoftext|> and <|endoftext|>x  <|endoftext|>",
    "İstanbul Σίσυφος straße é ﬁ", "don't we've 'S 123 ½ ² ٣ 漢字かな 🙂🙂 a.b,,c. d!!. e", "w " * 30000, "same text here", "same text here", "Kelvin mit　license", "\t lead and trail \r\n", "tail\x85next",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "src0", "en", 7, "clash", 1) for i, t in enumerate(ODD)] + [(None, "no id", "s", None, None, "c", 2), (3, ODD[3], "s", "x", 1, "c", 3), (4, "another text under id four", "s", "x", 1, "c", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, h string, shard int").repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


# ---- shared


def test_components(spark):
    random.seed(1)
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = path + star + [(5000, 5001), (5001, 5002), (7, 7)] + [(9000 + random.randrange(60), 9000 + random.randrange(60)) for _ in range(40)]
    ids = sorted({x for e in edges for x in e} | {77777})
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        r, s = root(a), root(b)
        up[max(r, s)] = min(r, s)
    got = components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component_id"] for r in got} == {i: root(i) for i in ids} and len(got) == len(ids)


@pytest.mark.parametrize("most", [10_000, 3])
def test_lookup_of_hot_keys(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST", most)
    keys = [1] * 300 + [None] * 100 + list(range(400, 1000))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    found = spark.createDataFrame([(1, "x", 1), (500, "y", None), (501, None, 3), (None, "n", 4)], "k long, v string, w int")
    want = {1: ("x", 1), 500: ("y", None), 501: (None, 3)}
    got = common.lookup(rows, ["k"], found, F.xxhash64("i")).collect()
    assert sorted((r["i"], r["k"], r["v"], r["w"]) for r in got) == [(i, k, *want.get(k, (None, None))) for i, k in enumerate(keys)]


def test_gapless(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").when(F.col("id") < 950, None).otherwise("cold").alias("g"), "id")
    by = defaultdict(list)
    for r in gapless(df, ["g"], F.xxhash64("id"), [F.col("id")], "n", 16).collect():
        by[r["g"]].append(r["n"])
    assert {g: sorted(v) for g, v in by.items()} == {"hot": list(range(900)), None: list(range(50)), "cold": list(range(50))}


# ---- 1 packing


def test_shortest_pack_first_keeps_all_pieces():
    random.seed(2)
    for _ in range(50):
        histogram = {random.randint(1, 64): random.randint(1, 40) for _ in range(random.randint(0, 30))}
        patterns = packing.shortest_pack_first(histogram, 64)
        count = defaultdict(int)
        for pattern, n in patterns:
            assert 0 < sum(pattern) <= 64 and n > 0
            for k in pattern:
                count[k] += n
        assert dict(count) == histogram
    assert packing.shortest_pack_first({5: 1, 3: 1, 2: 1}, 8) == [((5, 3), 1), ((2,), 1)]


def check_packing(spark, docs, out):
    tokenizer = load(tokenizer_path("word_bpe_49k.json"))
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.setdefault(r["doc_id"], []).append(ids)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out.collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert set(pieces) == set(want)
    for doc, texts in want.items():
        expected = sorted((s, min(2048, len(ids) - s), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for ids in texts for s in range(0, len(ids), 2048))
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[doc]) == expected
    return sum(n for s in sequences.values() for _, n in s), len(sequences)


def test_packing(spark, data, odd, none):
    check_packing(spark, odd, packing.pack_documents(odd))
    tokens, n = check_packing(spark, table(spark, data, "documents"), packing.op1_shortest_pack_first(spark, data))
    assert 2048 * n < 1.02 * tokens
    assert packing.pack_documents(none).count() == 0


def test_packing_of_any_columns(spark):
    rows = [(n, f"p{i}", i) for i, n in enumerate([2048] * 40 + [1000] * 30 + [7] * 300 + [0])]
    out = packing.pack(spark.createDataFrame(rows, "length long, __rank string, offset int"), part_pieces=10)
    assert out.columns == ["length", "__rank", "sequence_id", "offset"] and out.count() == len(rows) - 1
    at = defaultdict(list)
    for r in out.collect():
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in s) <= 2048 and [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] for s in at.values())


def test_word_encoder_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        WordEncoder(tokenizer_path("byte_bpe_50k.json"))


def test_word_encoder_forgets_without_harm():
    tokenizer, encoder = load(tokenizer_path("word_bpe_49k.json")), WordEncoder(tokenizer_path("word_bpe_49k.json"), kept=20)
    texts = [t for t in ODD if t] + ["Some more words, and MORE words. And others!"] * 3
    for _ in range(2):
        for t in texts:
            assert encoder.encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:50]


# ---- 2 license scan


def brute_license(text):
    words = license_scan.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


@pytest.mark.parametrize("which", ["odd", "data"])
def test_license_scan(spark, data, odd, which):
    docs = odd if which == "odd" else table(spark, data, "documents")
    want = {(r["doc_id"], brute_license(r["text"])) for r in docs.select("doc_id", "text").collect()}
    got = [(r["doc_id"], (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in license_scan.license_scan(docs).collect()]
    assert set(got) == want and len(got) == len({(r["doc_id"], r["text"] or "") for r in docs.collect()})


def test_license_notices_with_gaps(spark, none):
    notice = next(iter(n for n, label in license_scan.NOTICES.items() if label == "bsd"))
    words = notice.split()
    texts = [notice, " ".join([*words[:8], "EXTRA", *words[8:]]), " ".join(words[:5]), "Licensed under CC BY-NC 4.0."]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(4)] == ["bsd", "bsd", "", "cc-by-nc"]
    assert got[0]["score"] == 1.0 and 0.6 <= got[1]["score"] < 1 and got[2]["score"] == 0
    assert license_scan.license_scan(none).count() == 0


def brute_notices(text):
    """Labels and score of a text by plain loops over diagonals."""
    words = license_scan.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    labels, score = set(), 0.0
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        if any(words[i : i + len(p)] == p for i in range(len(words))):
            labels, score = labels | {label}, 1.0
    for notice, label in license_scan.NOTICES.items():
        p = license_scan.WORD.findall(notice)
        k = license_scan.notice_k(len(p))
        places = defaultdict(set)
        for i in range(len(words) - k + 1):
            for j in range(len(p) - k + 1):
                if words[i : i + k] == p[j : j + k]:
                    places[i - j].add(j)
        run, last = set(), None
        for d in [*sorted(places), None]:
            if last is not None and (d is None or d - last > license_scan.DIAGONAL_GAP):
                cover = len(run) / (len(p) - k + 1)
                if cover >= license_scan.MIN_COVER:
                    labels, score = labels | {label}, max(score, cover)
                run = set()
            if d is not None:
                run, last = run | places[d], d
    return ",".join(sorted(labels)), score


def test_license_labels_against_brute_force(spark, data, odd):
    random.seed(11)
    texts = []
    for notice in [*license_scan.NOTICES, *license_scan.PHRASES]:
        words = license_scan.WORD.findall(notice)
        for at in range(len(words)):
            texts.append(" ".join([*words[:at], "changed", *words[at + 1 :]]))
            texts.append(" ".join(["lead", *words[:at], "put", "in", *words[at:], "tail"]))
        texts.append(f"{notice.upper()}. {notice}; and {notice}")
    more = spark.createDataFrame(list(enumerate(texts, 10_000)), "doc_id long, text string")
    docs = table(spark, data, "documents").select("doc_id", "text").unionByName(more).unionByName(odd.select("doc_id", "text"))
    want = {(r["doc_id"], *brute_notices(r["text"])) for r in docs.collect()}
    assert {(r["doc_id"], r["labels"], r["score"]) for r in license_scan.license_scan(docs).collect()} == want


def test_license_notices_of_a_few_words(spark):
    short = "this work is licensed under the gnu general public license version 3".split()
    texts = ["All rights reserved.", "Copyright 2020. ALL RIGHTS RESERVED", "all rights are reserved", " ".join([*short[:5], "some", *short[6:]])]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(4)] == ["proprietary", "proprietary", "", "gpl"] and got[0]["n_base"] == 0


# ---- 3 embeddings


@pytest.mark.parametrize("block, rare", [(8192, 256), (64, 10_000)])
def test_embedding_classes_against_brute_force(spark, monkeypatch, block, rare):
    monkeypatch.setattr(embedding_dedup, "RARE", rare)
    rng = np.random.default_rng(3)
    center = rng.normal(size=(40, 16))
    x = [center[i % 40] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.5]) for i in range(600)] + [center[0]] * 30 + [-center[0]]
    x = np.array(x, np.float32)
    # Rows that repeat an id, rows without one, and vectors of which one or two components are strange.
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (None, x[1].tolist()), (None, x[1].tolist())]
    strange = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0] * 15 + [None]), (9005, [float("inf")] + [0.0] * 15), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (None, None)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + strange], "vec_id long, embedding array<float>, node int")
    got = embedding_dedup.embedding_classes(df, block=block).collect()
    assert sorted((r["vec_id"] for r in got), key=repr) == sorted((i for i, _ in rows + strange), key=repr)
    u = np.array([v for _, v in rows], np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    true = ((u @ u.T) >= 0.9).sum(1) - 1
    want, found = defaultdict(list), defaultdict(list)
    for (i, _), n in zip(rows, true, strict=True):
        want[i].append(int(n))
    for r in got:
        found[r["vec_id"]].append(r["n_links"])
    pairs = [(a, b) for i in want for a, b in zip(sorted(found[i], reverse=True), sorted(want[i], reverse=True), strict=False)]
    assert all(a <= b for a, b in pairs) and sum(a for a, _ in pairs) >= 0.95 * true.sum()
    if rare > 1000:
        assert all(a == b for a, b in pairs)
    by = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in range(9000, 9006))
    assert by[9006]["n_links"] == 1 and by[9007]["component_id"] == 9006 and not by[9007]["kept"]
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in got)
    assert embedding_dedup.embedding_classes(df.limit(0)).count() == 0


def test_embeddings_of_odd_width_and_size(spark):
    """One vector of another width changes no list, and neither very small nor very large components lose a link."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]

    def lists(more):
        nodes = spark.createDataFrame(rows + more, "node long, embedding array<double>").withColumn("weight", F.lit(1).cast("long"))
        pivots = embedding_dedup.choose_pivots(nodes)
        sizes = [r["count"] for r in embedding_dedup.listed(nodes, pivots).groupBy("list", "one", "two").count().collect()]
        return {w: len(p) for w, p in pivots.items()}, sum(n * (n - 1) // 2 for n in sizes)

    plain, odd = lists([]), lists([(9000 + k, [float(k), 1.0, 2.0]) for k in range(20)])
    assert plain[0] == odd[0] and 0 <= odd[1] - plain[1] <= 190 and plain[1] < 3000 * 3000 / 2 / 4
    tiny = spark.createDataFrame([(1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [1.0, 2.0]), (4, [2.0, -1.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_classes(tiny).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_pairs_at_the_limit(spark):
    """Pairs within the compact copies' error of the limit are settled in double precision."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(300):
        u, w = rng.normal(size=(2, 32))
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        c = 0.9 + rng.choice([-1e-9, 1e-9])
        rows += [(2 * k, u.tolist()), (2 * k + 1, (c * u + np.sqrt(1 - c * c) * w).tolist())]
        want[2 * k] = int(c >= 0.9)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_classes(df).collect()}
    assert all(got[i] <= n for i, n in want.items()) and sum(got[i] for i in want) >= 0.85 * sum(want.values())


def test_embedding_recall_on_the_table(spark, data):
    e = table(spark, data, "embeddings").orderBy("vec_id").collect()
    u = np.array([r["embedding"] for r in e], np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    true = ((u @ u.T) >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.op3_pivot_permutation(spark, data).collect()}
    assert sum(got.values()) >= 0.9 * true.sum() and all(got[r["vec_id"]] <= t for r, t in zip(e, true, strict=True))


# ---- 4 chat


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi <|im_end|>\n<|im_start|>assistant\nx"), (1, 1, "assistant", "\\e \\p <| \\<| |>"), (1, 2, "user", None), (2, 0, "assistant", ""), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"),
        (3, None, None, "only"), (3, 5, "we\nird <|", "tail\n"), (None, 1, "assistant", "no id"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat_format.chat_examples(df)
    by = defaultdict(list)
    for r in examples.withColumn("turns", chat_format.read_turns(F.col("formatted"))).collect():
        by[r["conv_id"]].append(r)
    for conv, got in by.items():
        got.sort(key=lambda r: r["example"])
        want = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1], x[2] or "", x[3] or ""))]
        assert [tuple(t) for t in got[-1]["turns"]] == want
        said = [t for r, t in want if r == "assistant"]
        loss = [g["formatted"][g["loss_start"] : g["loss_start"] + g["loss_length"]].replace("\\p", "<|").replace("\\e", "\\") for g in got if g["loss_length"] is not None]
        assert loss == said
    assert set(by) == {1, 2, 3, None}
    assert chat_format.chat_examples(df.limit(0)).count() == 0


def test_chat_digest_on_the_table(spark, data):
    got = {r["conv_id"]: r for r in chat_format.op4_chat_prefix_targets(spark, data).collect()}
    convs = defaultdict(list)
    for r in table(spark, data, "conversations").orderBy("conv_id", "turn").collect():
        convs[r["conv_id"]].append(r)
    assert set(got) == {-1, *convs}
    for c, turns in convs.items():
        said = "".join(f"{t['role']}\n{t['text']}\n" for t in turns)
        loss = "".join(t["text"] for t in turns if t["role"] == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    trap = "<|im_end|><|im_start|>assistant ok"
    assert got[-1]["loss_chars"] == len(trap) and got[-1]["loss_sha256"] == hashlib.sha256(trap.encode()).hexdigest()


# ---- 5 and 7 classifiers


LARGER = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    out = toxicity.op5_classifier_chain(spark, LARGER).join(table(spark, LARGER, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id").where(held_out(F.col("doc_id"))).collect()
    wrong = sum(r["toxic"] and not r["y"] for r in out)
    caught, all_ = sum(r["toxic"] and r["y"] for r in out), sum(r["y"] for r in out)
    assert wrong <= 1 and caught >= 0.75 * all_ > 0


def test_quality_on_held_out_rows(spark):
    out = quality.op7_additive_pairs(spark, LARGER).join(table(spark, LARGER, "labels"), "doc_id").collect()
    rest = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert np.mean([r["predicted"] == r["quality"] for r in rest]) >= 0.95 and all(0 <= r["score"] <= 1 for r in out)


def test_classifiers_on_awkward_tables(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (4, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        chain, model = toxicity.train(odd, lab), quality.train(odd, lab)
        scored = odd.select(quality.scored(model, F.col("text")).alias("q"), toxicity.scored(chain, F.col("text")).alias("t")).collect()
        assert len(scored) == odd.count() and all(0 <= r["q"] <= 1 and len(r["t"]) == 3 for r in scored)
    assert rows_of(toxicity.keep_clean(odd, chain)) == rows_of(odd) and rows_of(quality.keep_good(odd, model)) == rows_of(odd)
    assert toxicity.keep_clean(odd, chain).columns == odd.columns
    assert quality.keep_good(none, model).count() == 0 and toxicity.keep_clean(none, chain).count() == 0


def test_scores_against_plain_python(spark, data):
    """Both classifiers' scores, by loops over the learnt weights and tables."""
    import math

    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    chain, model = toxicity.train(docs, labels), quality.train(docs, labels)
    rows = docs.select("text", toxicity.scored(chain, F.col("text")).alias("t"), quality.scored(model, F.col("text")).alias("q")).collect()
    for r in rows[:60]:
        words = set(__import__("re").findall(r"\w+", r["text"].lower()))
        x = [math.log1p(sum(w == n[2:] if n[0] == "0" else len(w) > int(n[0]) and w[: int(n[0])] == n[2:] for w in words)) for n in chain.vocabulary.names]
        for k, w in enumerate(chain.weights):
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, w, strict=False)) + w[-1]))))
            assert abs(p - r["t"][k]) < 1e-6 and len(w) == len(x) + 1
            x.append(p)
        f = quality.features(r["text"])
        total = model.base
        for v, edges, values in zip(f, model.edges, model.tables, strict=True):
            total += values[sum(v >= e for e in edges)]
        for (i, j), grid in zip(model.pairs, model.grids, strict=True):
            total += grid[sum(f[i] >= e for e in model.coarse[i]), sum(f[j] >= e for e in model.coarse[j])]
        assert abs(1 / (1 + math.exp(-max(-30, min(30, total)))) - r["q"]) < 1e-9


def test_additive_model_learns_tables_and_a_pair():
    """A step of one feature needs a table alone; the sign of a product of two needs their grid."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 4))
    train, rest = slice(0, 4000), slice(4000, None)
    right = lambda m, y: np.mean((m.score(x[rest]) >= 0.5) == (y[rest] > 0))
    step, product = (x[:, 0] > 0.5).astype(float), (x[:, 1] * x[:, 2] > 0).astype(float)
    assert right(quality.fit(x[train], step[train], pairs=0), step) > 0.97
    alone, model = (quality.fit(x[train], product[train], pairs=k) for k in (0, 3))
    assert model.pairs[0] == (1, 2) and right(model, product) > 0.85 > 0.6 > right(alone, product)


def test_folds_do_not_see_their_labels(spark):
    """Features and marks for a fold's rows stay the same whatever labels those rows have."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(300)}"
    rows = [(" ".join([word() for _ in range(20)] + (["vile", "nasty"] if i % 3 == 0 else [])), int(i % 3 == 0), rng.randrange(toxicity.FOLDS)) for i in range(600)]
    choose = lambda r: toxicity.choose_features(spark.createDataFrame(r, "text string, y int, fold int"), 40)
    plain = choose(rows)
    for f in range(toxicity.FOLDS):
        flipped = choose([(t, 1 - y if g == f else y, g) for t, y, g in rows])
        for was, now in ((plain.chosen, flipped.chosen), (plain.marks, flipped.marks)):
            assert [plain.names[i] for i in was[f]] == [flipped.names[i] for i in now[f]]
        assert [plain.names[i] for i in plain.chosen[-1]] != [flipped.names[i] for i in flipped.chosen[-1]]
    assert {"0:vile", "0:nasty"} <= {plain.names[i] for i in plain.marks[-1]}


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = np.stack([x[:, 0] > 0, (x[:, 0] > 0) & (x[:, 1] > 0)], 1).astype(float)
    w = toxicity.fit_chain(x, y, np.arange(400) % 3)
    assert [len(v) for v in w] == [4, 5] and w[1][3] > 0
    assert np.mean((toxicity.predict(np.c_[x, toxicity.predict(x, w[0])], w[1]) >= 0.5) == y[:, 1]) > 0.95


# ---- 6 sketches


def in_order(docs):
    """Ids and texts by descending id, null ids last; equal ids by the hash that the operator goes by."""
    keys = {(r["doc_id"], r["text"] or "", r["hash"]) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).collect()}
    return [(i, t) for i, t, _ in sorted(keys, key=lambda x: (x[0] is not None, x[0] or 0, x[2]), reverse=True)]


def brute_sketch(spark, texts):
    """The retained hashes of each text, by plain slicing of its words and a plain comparison."""
    grams = {}
    for t in texts:
        w = [x for x in __import__("re").split(r"[ \t\n\x0B\f\r]+", t.lower()) if x]
        grams[t] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({(" ".join(w),)} if w else set())
    all_ = sorted(set().union(*grams.values()))
    by_size = {}
    for size in {len(g) for g in all_}:
        rows = spark.createDataFrame([g for g in all_ if len(g) == size], ", ".join(f"c{k} string" for k in range(size)))
        by_size |= {tuple(r[:-1]): r[-1] % (1 << 64) for r in rows.select("*", F.xxhash64(*rows.columns)).collect()}
    keep = 1 << (64 - fingerprints.SCALE_BITS)
    return {t: sorted({by_size[g] >> (32 - fingerprints.SCALE_BITS) & 0xFFFFFFFF for g in s if by_size[g] < keep}) for t, s in grams.items()}


@pytest.mark.parametrize("which", ["odd", "data"])
def test_sketches_against_brute_force(spark, data, odd, which):
    """Edited texts, fingerprints and both likeness columns, each by plain Python."""
    docs = odd.where("text is null or length(text) < 1000") if which == "odd" else table(spark, data, "documents")
    keys = in_order(docs)
    after = {k: keys[(i + 1) % len(keys)][1] for i, k in enumerate(keys)}
    edited = {(i, t): t[: len(t) - len(t) // 3] + after[i, t][: len(t) // 3] for i, t in keys}
    sketches = brute_sketch(spark, {t for _, t in keys} | set(edited.values()))

    def like(x, y):
        a, b = sorted((set(sketches[x]), set(sketches[y])), key=len)
        return len(a & b) / len(a) if a else float(x == y)

    said = lambda t: "".join(f"{h:08x}" for h in sketches[t])
    want = sorted(((i, len(t), hashlib.sha256(edited[i, t].encode()).hexdigest(), said(t), said(edited[i, t]), like(t, edited[i, t]), like(t, after[i, t])) for i, t in ((r["doc_id"], r["text"] or "") for r in docs.collect())), key=repr)
    assert sorted((tuple(r) for r in fingerprints.compared(docs).collect()), key=repr) == want


def test_sketch_query(spark, data, none):
    got = fingerprints.op6_scaled_sketch(spark, data).collect()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    long = [r for r in got if r["n_chars"] > 2000]
    assert np.mean([r["near_edited"] for r in long]) > 0.5 > 0.2 > np.mean([r["near_next"] for r in long])
    assert fingerprints.compare_edited(none).count() == 0


def test_next_in_order_over_many_ranges(spark, monkeypatch):
    """Also where ranges are many, ids repeat and one id has a third of the keys."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 20)
    ids = [None] * 30 + [7] * 100 + list(range(170))
    keys = spark.createDataFrame([(i, k * 7919 % 301 - 150, 1) for k, i in enumerate(ids)], "doc_id long, h long, n int")
    want = sorted({(r["doc_id"], r["h"]) for r in keys.collect()}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    got = {(r["doc_id"], r["h"]): (r["next_id"], r["next_h"]) for r in fingerprints.next_in_order(keys.dropDuplicates(["doc_id", "h"])).collect()}
    assert got == {k: want[(i + 1) % len(want)] for i, k in enumerate(want)}


def test_sketch_estimates_containment(spark):
    words = [f"w{i}" for i in range(4000)]
    rows = spark.createDataFrame([(" ".join(words), " ".join(words[:800]), " ".join(words[2000:]))], "a string, b string, c string")
    for n in "abc":
        rows = fingerprints.with_sketch(rows, F.col(n), f"s{n}")
    r = rows.select(fingerprints.contained(F.col("sb"), F.col("sa")).alias("ba"), fingerprints.contained(F.col("sa"), F.col("sb")).alias("ab"), fingerprints.likeness(F.col("sb"), F.col("sc")).alias("bc"), fingerprints.merge(F.col("sb"), F.col("sa")).alias("m"), "sa").first()
    assert r["ba"] == 1.0 and abs(r["ab"] - 0.2) < 0.06 and r["bc"] == 0 and r["m"] == r["sa"]


# ---- 8 BPE


def test_bpe_against_the_library(spark, odd, none):
    tokenizer = load(tokenizer_path("byte_bpe_50k.json"))
    got = bpe.encoded(odd).cache()
    want = sorted(((r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect()), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in got.collect()), key=repr) == want
    assert rows_of(bpe.decoded(got)) == sorted(((r["doc_id"], tokenizer.decode(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in odd.collect()), key=repr)
    assert bpe.encoded(none).count() == 0


def test_bpe_of_shuffled_rows(spark, data):
    """Rows out of a shuffle have no order of their own, and session settings stay as they are."""
    docs = table(spark, data, "documents")
    settings = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert bpe._steady(docs.select("doc_id", "text")) and not bpe._steady(docs.repartition(7))
    a, b = bpe.encoded(docs), bpe.encoded(docs.repartition(7, F.rand()))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert settings == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))


def test_decoding_of_strange_ids(spark):
    rows = spark.createDataFrame([(1, [464, None, -5, 10**9, 464]), (2, None), (None, []), (2, [50256])], "doc_id long, ids array<long>")
    tokenizer = load(tokenizer_path("byte_bpe_50k.json"))
    one, end = tokenizer.decode([464], skip_special_tokens=False), tokenizer.decode([50256], skip_special_tokens=False)
    assert sorted(((r["doc_id"], r["text"]) for r in bpe.decoded(rows).collect()), key=repr) == sorted([(1, one + one), (2, ""), (None, ""), (2, end)], key=repr)


@pytest.mark.parametrize("ahead", [1 << 16, 100, 0])
def test_bpe_in_small_blocks(spark, data, monkeypatch, ahead):
    monkeypatch.setattr(bpe, "PIECE_WORDS", 50)
    monkeypatch.setattr(bpe.words_ahead, "__defaults__", (ahead,))
    tokenizer = load(tokenizer_path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: tokenizer.encode(r["text"], add_special_tokens=False).ids for r in table(spark, data, "documents").collect()}
    for r in bpe.op8_distinct_word_bpe(spark, data).collect():
        ids = docs[r["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bytes_that_are_no_text():
    pieces, tokenizer = bpe.piece_bytes(tokenizer_path("byte_bpe_50k.json")), load(tokenizer_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(4)
    for _ in range(50):
        ids = rng.integers(0, len(pieces), 12)
        assert bpe.decode(ids, pieces) == tokenizer.decode(ids.tolist(), skip_special_tokens=False)


# ---- 9 shards


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(5).integers(0, 1 << 63, 3000, dtype=np.uint64)
    assert sharding.jump_hash(keys, 16).tolist() == [slow_jump(int(k), 16) for k in keys]
    a, b = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert ((a == b) | (b == 16)).all() and 0.03 < (a != b).mean() < 0.09


@pytest.mark.parametrize("which", ["odd", "data"])
def test_sharding(spark, data, odd, none, which):
    docs = odd if which == "odd" else table(spark, data, "documents")
    got = sharding.assign_shards(docs).collect()
    assert len(got) == docs.count()
    slots, where = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        where[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in where.values())
    assert sharding.assign_shards(none).count() == 0


def test_shard_query_and_files(spark, data, tmp_path):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, data, "documents").collect()}
    for r in sharding.op9_jump_hash_sharding(spark, data).collect():
        assert (r["size"], r["text_crc32"], r["law"]) == (len(docs[r["doc_id"]]) + 1, zlib.crc32(docs[r["doc_id"]]), "key")
    sharding.write_shards(table(spark, data, "documents"), f"{tmp_path}/shards", tasks_per_shard=2)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(docs)


# ---- 10 SimHash


def brute_classes(rows):
    prints = [(i, simhash.fingerprint(t)) for i, t in rows]
    distinct = np.array(sorted({f for _, f in prints}), np.uint64)
    up = list(range(len(distinct)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct ^ distinct[i]) <= 2):
            r, s = root(i), root(int(j))
            up[max(r, s)] = min(r, s)
    at = {int(f): root(k) for k, f in enumerate(distinct)}
    least = defaultdict(list)
    for i, f in prints:
        least[at[f]] += [i] * (i is not None)
    return sorted(((i, f, min(least[at[f]], default=None)) for i, f in prints), key=repr)


def near_texts(n):
    random.seed(6)
    base = [f"word{k}" for k in range(400)]
    out = []
    for i in range(n):
        w = list(base) if i % 2 else [f"x{random.random()}" for _ in range(30)]
        w[random.randrange(30)] = f"v{i}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("wide", [4096, 3])
def test_simhash_classes(spark, odd, wide, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE", wide)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(i + 100, t) for i, t in near_texts(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted(((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == brute_classes(rows)


def test_fingerprint_by_definition():
    import xxhash

    for text in [t for t in ODD if t and len(t) < 500]:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", folded) if w]
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_one_of_each_class_stays(spark, odd, none):
    odd = odd.where("text is null or text not like 'another%'")  # else one id names two classes
    docs = odd.unionByName(odd.where("doc_id = 5"))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == odd.columns
    classes = {(r["id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    got = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in kept.collect()]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    assert len(got) == len(set(classes.values())) and {classes[i, signed(f)] for i, f in got} == set(classes.values())
    assert simhash.drop_near_duplicates(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 20, dtype=np.uint64)
    x = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(40)]]))
    x = x[np.argsort(simhash.gray_rank(x))]
    got = {(int(a), int(b)) for i, j in simhash.GrayIndex(x).pairs(2) for a, b in zip(i, j, strict=True)}
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    assert got == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}


@pytest.mark.parametrize("top", [0, 21, 35])
def test_gray_index_prunes(top):
    """Few of the pairs are ever looked at, also among fingerprints that agree in their top bits."""
    rng = np.random.default_rng(8)
    x = np.unique(rng.integers(0, 1 << 63, 8000, dtype=np.uint64) >> np.uint64(top))
    x = x[np.argsort(simhash.gray_rank(x))]
    index = simhash.GrayIndex(x)
    found = sum(len(i) for i, _ in index.pairs(2))
    assert found == sum(int((np.bitwise_count(x[i + 1 :] ^ x[i]) <= 2).sum()) for i in range(len(x)))
    assert index.visited < len(x) ** 2 / 2 / 5


@pytest.mark.parametrize("n", [2, 3, 5])
def test_refiling_turns_bits(spark, n):
    """Every band comes to the top once, below the bits already used, and no bit is lost."""
    rng = np.random.default_rng(9)
    rows = [(int(k), int(v)) for k, v in enumerate(rng.integers(-(1 << 63), 1 << 63, 20))]
    filed = simhash._refiled(spark.createDataFrame(rows, "node long, turned long").selectExpr("node", "turned", "0 AS used", "0L AS pattern"), n)
    for _ in range(2):
        filed = simhash._refiled(filed, n)
    got = filed.collect()
    assert len(got) == len(rows) * n**3
    for r in got:
        assert (r["turned"] % (1 << 64)).bit_count() == (rows[r["node"]][1] % (1 << 64)).bit_count()
    first = simhash._refiled(spark.createDataFrame(rows, "node long, turned long").selectExpr("node", "turned", "0 AS used", "0L AS pattern"), n).collect()
    for r in first:
        v = rows[r["node"]][1] % (1 << 64)
        assert r["turned"] % (1 << 64) in {((v >> k) | (v << (64 - k))) % (1 << 64) for k in range(64)}
