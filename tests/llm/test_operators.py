import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import distinctive, language, mixing, neighbours, packing, sketch, split, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{tokens.FOLDER}/{tokens.VOCABULARY}"), reason="no tokenizer file")

# -- neighbours


def vectors(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, dim)) * rng.uniform(0, 0.3, (n - n // 2, 1))
    return x


CHUNKS = "id long, embedding array<float>, rep long, vec string"


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame([(*r, 0, "clash") for r in rows], CHUNKS)


BAD = [(9001, None), (9002, [1.0] * 5), (9003, [0.0] * 16), (9004, [float("nan")] + [1.0] * 15), (9005, [])]


SMALL = {"shard": 120, "per_shard": 8, "leaf": 20}  #: several shards, and trees in them


def test_trees_split(spark):
    shards = neighbours.Shards(frame(spark, vectors(600)), dim=16, **SMALL)
    assert shards.tree.leaves >= 4
    x = vectors(600).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree, rows = neighbours._leaves(x, 20)
    assert tree.leaves > 20 and sorted(np.concatenate(rows)) == list(range(600))
    assert neighbours._leaves(np.tile(x[:1], (50, 1)), 20)[0].leaves == 1  # what can't be told apart stays together
    near = sum(len(r) for _, r, _ in tree.route(x, np.full(600, 0.01, np.float32)))
    assert 600 <= near < 0.2 * 600 * tree.leaves and sum(len(r) for _, r, _ in tree.route(x, np.full(600, 2.0, np.float32))) == 600 * tree.leaves


def test_pairs_with_copies_and_bad_rows(spark):
    x = vectors(600)
    copies = [(5000 + i, [float(v) for v in x[3] * (i + 1)]) for i in range(6)]
    df = frame(spark, x, BAD + copies)
    unit = np.concatenate([x, [c[1] for c in copies]])
    ids = [*range(600), *[c[0] for c in copies]]
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    s = unit @ unit.T
    exact = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(i + 1, len(ids)) if s[i, j] >= 0.95}
    unsure = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(i + 1, len(ids)) if abs(s[i, j] - 0.95) < 1e-3}
    got = [(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, 0.95, factor=1.0, dim=16, **SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) - unsure == exact - unsure
    some = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, 0.95, dim=16, **SMALL).collect()}
    assert len(some & exact) >= 0.97 * len(exact) and some - unsure <= exact


def test_classes_and_links(spark):
    x = np.tile(vectors(1), (30, 1))
    x = np.concatenate([x, x[:1] + 0.01 * vectors(1, seed=5), -x[:1]])
    members, links = neighbours.similar_classes(frame(spark, x, BAD), 0.95, dim=16)
    assert {(r.id, r.rep, r.copies) for r in members.collect()} == {*((i, 0, 30) for i in range(30)), (30, 30, 1), (31, 31, 1)}
    assert [(r.rep_a, r.rep_b) for r in links.collect()] == [(0, 30)]
    assert {(r.id, r.links) for r in neighbours.linked(members, links).collect()} == {*((i, 1) for i in range(31)), (31, 0)}
    assert {(r.id_a, r.id_b) for r in neighbours.expand(members, links).collect()} == {(i, j) for j in range(31) for i in range(j)}


@pytest.mark.parametrize(("dim", "options"), [(64, {"factor": 5.0}), (16, {"factor": 4.0}), (16, {"factor": 1.0, "kind": neighbours.FULL})])
def test_nearest_recall(spark, dim, options):
    x = vectors(800, dim)
    rows = neighbours.knn(frame(spark, x, BAD), 5, dim=dim, **SMALL, **options).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :5]
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append(r.neighbour)
    assert set(got) == set(range(800)) and all(len(v) == 5 for v in got.values())
    recall = np.mean([len(set(best[i]) & set(got[i])) / 5 for i in range(800)])
    assert recall == 1.0 if options.get("factor") == 1.0 else recall >= 0.9
    if dim != 64:
        return
    df, few = frame(spark, x, BAD), F.expr("id % 20 = 0")
    asked = neighbours.knn(df, 5, dim=dim, asked=few, **SMALL, **options)
    assert {(r.id, r.rank, r.neighbour) for r in asked.collect()} == {(r.id, r.rank, r.neighbour) for r in rows if r.id % 20 == 0}
    exact = neighbours.brute_force(df, df.filter(few), 5, dim=dim, block=16)
    assert {(r["query"], r.neighbour) for r in exact.collect()} == {(i, int(j)) for i in range(0, 800, 20) for j in best[i]}
    row = neighbours.recall(asked, exact).first()
    assert row.queries == 40 and row.neighbours == 200 and abs(row.recall - np.mean([len(set(best[i]) & set(got[i])) / 5 for i in range(0, 800, 20)])) < 0.02


def test_nearest_exact_with_copies(spark):
    x = np.concatenate([np.tile(vectors(1, seed=9), (8, 1)), vectors(40)])
    rows = neighbours.knn(frame(spark, x), 4, factor=1.0, kind=neighbours.FULL, dim=16).collect()
    for i in range(8):
        mine = sorted((r.rank, r.neighbour) for r in rows if r.id == i)
        assert [n for _, n in mine] == [j for j in range(8) if j != i][:4]


def test_neighbours_of_nothing(spark):
    for rows in ([], BAD, [(1, [1.0] * 16)]):
        df = spark.createDataFrame([(*r, 0, "") for r in rows], CHUNKS)
        assert neighbours.similar_pairs(df, 0.9, dim=16).count() == 0
        assert neighbours.knn(df, 3, dim=16).count() == 0


# -- distinctive terms


def test_distinctive_by_hand(spark):
    import math

    rows = [("chunk", 1, "cache cache token"), ("chunk", 2, "token token words"), ("chunk", 3, None), ("chunk", 4, ""), ("symbol", 1, "cacheToken"), ("chunk", 2, "token token words")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "record_type string, record_id long, text string, term string, tf int")
    got = {(r.record_type, r.record_id, r.term): r for r in distinctive.distinctiveness(df).collect()}
    smooth = 3 * 3**0.75
    assert math.isclose(got["chunk", 1, "cache"].ppmi, math.log2(2 * smooth / (2 * 3**0.75)))
    assert got["chunk", 1, "token"].ppmi == max(0, math.log2(1 * smooth / (5 * 3**0.75))) and got["chunk", 1, "token"].df == 3
    assert got["symbol", 1, "cache"].tf == 1 and len(got) == 6
    few = distinctive.distinctiveness(df, min_tf={"chunk": 2, "symbol": 1}, max_df=2, pattern="^[a-z]{5,}$").collect()
    assert {(r.record_type, r.record_id, r.term) for r in few} == {("chunk", 1, "cache"), ("symbol", 1, "cache"), ("symbol", 1, "token")}
    assert distinctive.distinctiveness(df.limit(0)).count() == 0


# -- percentiles


def test_sketch_error_and_merging(spark):
    rng = random.Random(4)
    values = [rng.lognormvariate(5, 3) for _ in range(3000)] + [-rng.lognormvariate(2, 2) for _ in range(500)] + [0.0] * 20 + [5e-324, 1e308]
    rows = [("k", i % 7, v) for i, v in enumerate(values)] + [(None, 1, 1.0), ("k", 1, None), ("k", 1, float("nan")), ("k", 1, float("inf"))]
    df = spark.createDataFrame(rows, "k string, day int, v double")
    percents = [0.0, 1.0, 10.0, 14.0, 50.0, 95.0, 100.0]
    merged = sketch.merge(sketch.sketch(df, ["k", "day"], "v"), ["k"])
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in sketch.sketch(df, ["k"], "v").collect()}
    ordered = sorted(values)
    for r in sketch.percentiles(merged.filter("k = 'k'"), ["k"], percents).collect():
        exact = ordered[max(0, -(-int(r.percent * len(ordered)) // 100) - 1)]
        assert abs(r.value - exact) <= 0.0101 * abs(exact)
    exact = sketch.exact_percentiles(df, "v", sketch.percentile_buckets(merged.filter("k = 'k'"), ["k"], [50.0, 95.0]), ["k"])
    assert {r.percent: r.value for r in exact.collect()} == {p: ordered[-(-int(p * len(ordered)) // 100) - 1] for p in (50.0, 95.0)}


def test_heavy_tailed_at_the_limit(spark):
    rows = [("at", v) for v in [10] * 90 + [200] * 10] + [("below", v) for v in [10] * 90 + [199] * 10] + [("far", v) for v in [1] * 90 + [500] * 10] + [("zero", 0)] * 5 + [(None, 1)]
    found = sketch.heavy_tailed(spark.createDataFrame(rows, "k string, v long"), "k", "v")
    assert {r.k for r in found.collect()} == {"at", "far", "zero"}
    assert sketch.heavy_tailed(spark.createDataFrame([], "k string, v long"), "k", "v").count() == 0


# -- splitting

TEXTS = ["", "a", "x" * 5000, "é" * 3000, "word " * 900, "# A\n" + "para graph. " * 100 + "\n\n## B\n" + "line\n" * 500, "日本語。" * 900, " " * 2500, "\n" * 2500, "a" * 999 + " " + "b" * 1001, "\r\n".join(["some line here"] * 300), "🙂" * 700]


@pytest.mark.parametrize("limit", [40, 1000])
def test_pieces(limit):
    for text in TEXTS:
        data = text.encode()
        found = split.pieces(data, limit)
        at = 0
        for k, (s, e) in enumerate(found):
            assert e - s <= limit and data[s:e].decode() and s <= at < e
            assert k == 0 or found[k - 1][0] < s
            at = e
        assert at == len(data)


def test_overlap_is_about_15_percent():
    data = ("word another token " * 3000).encode()
    found = split.pieces(data)
    overlaps = [(a[1] - b[0]) / (a[1] - a[0]) for a, b in zip(found, found[1:])]
    assert 0.12 < np.median(overlaps) < 0.17 and min(overlaps) > 0.05


def test_headings_come_first():
    data = ("# A\n" + "text and more. " * 50 + "\n# B\n" + "other words. " * 50).encode()
    assert data[split.pieces(data)[0][1] :].startswith(b"# B")


def test_very_long_text_in_linear_time():
    data = (b"y" * 100 + b" ") * 100_000
    assert len(split.pieces(data)) > 10_000


def test_split_and_defects(spark):
    rows = [(i, t, 7, 8) for i, t in enumerate([*TEXTS, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, size int")
    cut = split.split_texts(docs, ["doc_id"], "text")
    assert {r.doc_id for r in cut.collect()} == set(range(1, len(TEXTS)))
    good = cut.select(F.monotonically_increasing_id().alias("id"), "doc_id", "content", "start_offset")
    # fully blank pieces are trimmed to nothing and have no defect
    assert split.defects(good, docs).count() == 0
    text = "0123456789 abc"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = [(1, 1, "0123", 0), (2, 1, "0123  \n", 0), (3, 1, "89 a", 8), (4, 1, "zz", 2), (5, 1, None, 0), (6, 2, "x", 0), (7, 3, "x", 0), (8, 1, "x" * 1001, 0), (9, 1, "abc", -1), (10, 1, "abc", None), (11, 1, "abc", 2**40)]
    chunks = spark.createDataFrame([(*r, "clash") for r in rows], "id long, doc_id long, content string, start_offset long, bytes string")
    got = {tuple(r) for r in split.defects(chunks.filter("id <> 8 and id <> 11"), docs).collect()}
    assert got == {(3, "gap"), (4, "misplaced"), (6, "misplaced"), (7, "misplaced"), (9, "misplaced"), (10, "misplaced")}
    assert {(8, "oversized"), (8, "misplaced"), (11, "misplaced")} <= {tuple(r) for r in split.defects(chunks, docs).collect()}
    assert split.defects(chunks.limit(0), docs).count() == 0


# -- packing


def test_fill_limits():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 400, 700)
    sizes = np.stack([n, np.ones(700), np.maximum(n - rng.integers(0, 30, 700), 0)], 1).astype(float)
    limits = np.array([512.0, 6, 480])
    window = packing.fill(sizes, limits)
    assert (window >= 0).all()
    totals = np.array([sizes[window == w].sum(0) for w in range(window.max() + 1)])
    alone = np.array([(window == w).sum() == 1 for w in range(window.max() + 1)])
    assert ((totals <= limits + 1e-6).all(1) | alone).all()
    assert len(totals) <= 1.05 * np.ceil((sizes.sum(0) / limits).max())


@needs_vocabulary
def test_pack(spark):
    texts = [None, "", *["word " * n for n in (3, 50, 90, 100, 101, 350, 1000)], "word " * 90]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, tokens int, window int")
    limits = spark.createDataFrame([("small", 100), ("large", 512)], "pack_id string, capacity_tokens long")
    rows = packing.pack(docs, limits).collect()
    for pack_id, capacity in (("small", 100), ("large", 512)):
        mine = [r for r in rows if r.pack_id == pack_id]
        totals, covered = {}, {}
        for r in mine:
            totals[r.window] = totals.get(r.window, 0) + r.tokens
            covered.setdefault(r.doc_id, []).append((r.start_token, r.tokens))
        assert max(totals.values()) <= capacity and set(covered) == set(range(2, len(texts)))
        for doc, parts in covered.items():
            n = tokens.count(texts[doc])
            assert sum(t for _, t in parts) == n and (len(parts) == 1) == (n <= capacity)
    assert packing.pack(docs.limit(0), limits).count() == 0
    assert packing.usage(packing.pack(docs, limits), limits).count() == 2
    tight = {"loss_part": 0.8, "per_segment": 256, "least_segments": 2}
    rows = packing.pack(docs, limits, **tight).collect()
    windows = {}
    for r in rows:
        windows.setdefault((r.pack_id, r.window), []).append(r)
    for (pack_id, _), own in windows.items():
        most = packing.limits_of({"small": 100, "large": 512}[pack_id], **tight)
        assert len(own) == 1 or all(x <= y for x, y in zip((sum(r.tokens for r in own), len(own), sum(r.loss_tokens for r in own)), most))
    assert all(r.over == 0 for r in packing.binding(packing.pack(docs, limits, **tight), limits, **tight).collect())


@needs_vocabulary
def test_token_count_of_long_text():
    encode = tokens.encoder().encode_ordinary
    draw = random.Random(4)
    mixed = "".join(draw.choice(["word", " ", "  ", "\n", "\n\n", "\t", "'s", "12", "é", "。", "x" * 30, " a", ". "]) for _ in range(60_000))
    for text in ("some words here " * 9000, mixed, " " * 200_000, "a\n" * 80_000, mixed.replace(" ", "").replace("\n", "") + " end"):
        assert len(text) > tokens.BLOCK and tokens.count(text) == len(encode(text))
    assert tokens.count(None) == tokens.count("") == 0 and tokens.count("q" * 300_000) > 0


# -- mixing


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    for sizes in (rng.lognormal(5, 1, 500), np.full(500, 7.0)):
        p = mixing.flight(np.full(500, 0.3), sizes, rng)
        left = (p > 0) & (p < 1)
        assert left.sum() <= 2 and (sizes[left] <= np.median(sizes)).all()  # what is left to land is small
        assert abs(p.sum() - 150) < 1e-6 and abs(p @ sizes - 0.3 * sizes.sum()) < 1e-4 * sizes.sum()
        assert set(mixing.land(p, rng)) <= {0.0, 1.0}
    assert len(mixing.flight(np.zeros(0), np.zeros(0), rng)) == 0
    assert list(mixing.flight(np.array([0.0, 1.0, 0.5]), np.ones(3), rng)) == [0.0, 1.0, 0.5]


def test_flight_is_fair():
    hits = np.zeros(12)
    for seed in range(1500):
        rng = np.random.default_rng(seed)
        hits += mixing.land(mixing.flight(np.full(12, 0.25), np.arange(1.0, 13), rng), rng)
    assert np.abs(hits / 1500 - 0.25).max() < 0.05


@needs_vocabulary
def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big", " BIG", "big"]), "word " * rng.randint(5, 60), 1) for i in range(600)]
    rows += [(1000 + i, "small", "word " * 20, 1) for i in range(40)] + [(2000, "other", "word", 1), (2001, None, "word", 1), (2002, "big", None, 1), (2003, "big", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies int")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.Mix(docs, targets).report().collect()}
    assert report["none"].capped and report["small"].capped and not report["big"].capped
    assert report["small"].max_copies == 3 and abs(report["big"].share_of_budget - 0.6) < 0.005
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-4
    chosen = mixing.Mix(docs, targets).chosen().collect()
    assert all(1 <= r.copies <= 3 for r in chosen) and not {r.doc_id for r in chosen} & {2000, 2001, 2002, 2003}
    empty = mixing.Mix(docs.limit(0), targets).report().collect()
    assert len(empty) == 3 and all(r.chosen_tokens == 0 for r in empty)


# -- languages

SAY = {
    "en": "The token budget replaces the heading structure before the next run starts and the file scanner returns the limit.",
    "pt": "O orçamento de tokens confere o resultado anterior e o filtro de saída publica os módulos antes da próxima execução.",
    "de": "Das Tokenbudget vergleicht die Karte des Quelltextes, obwohl es mehr Speicher braucht und nichts verloren geht.",
    "ru": "Поэтому слой кэша измеряет самые большие файлы проекта, потому что содержание изменилось вчера.",
    "ja": "索引は設定された上限を読み込みます。その結果、古い行はすべて新しい表にまとめられます。",
}


@pytest.fixture(scope="module")
def profiles():
    sample = [(lang, "\n".join(words.split(" ")[i] + " " + words for i in range(len(words.split(" "))))) for lang, words in SAY.items()]
    return language.fit([(lang, language.sentences(text)) for lang, text in [*sample, ("en", SAY["de"])]], sorted(SAY), 1024)


def test_segments(profiles):
    text = f"# {SAY['en']}\n\n```py\ndef x(): return 'o que não'\n```\n{SAY['pt']} {SAY['de']}\n\n- 1.2.3\n{SAY['ru']}\r\n{SAY['ja']}"
    found = language.identify([None, "", text, "``` \nonly code", "1234 5678"], profiles)
    assert found[0] == found[1] == found[3] == []
    assert [s[2] for s in found[2]] == ["en", "pt", "de", "ru", "ja"]
    assert all(0 <= s[4] <= 1 and text[s[0] : s[1]].strip() for s in found[2]) and len(found[4]) == 1


def test_unknown_scripts(profiles):
    arabic, greek, korean = "يقارن الملخص خريطة الملفات قبل التشغيل التالي", "Ο χάρτης συγκρίνει τα αρχεία πριν από την εκτέλεση", "색인은 설정된 상한을 읽고 새 표로 합칩니다"
    found = language.identify([arabic, greek, korean, f"{SAY['en']}\n{greek}\n{SAY['en']}", "1234", f"{greek}\n42\n"], profiles)
    assert [[s[2] for s in own] for own in found] == [["und"], ["und"], ["und"], ["en", "und", "en"], ["und"], ["und"]]
    assert found[0][0][4] == 0.0


def test_sentences_cover_the_whole_text():
    text = "\n".join(f"line number {i} of the text" for i in range(1000))
    some = language.sentences(text, 50)
    assert len(some) == 50 and "980" in some[-1] and language.sentences(None) == []


def test_scores_are_cosines_up_to_length(profiles):
    text = SAY["de"].lower()
    grams, _ = language.trigrams([text])
    vector = profiles.bundle(grams)
    unit = profiles.prototypes / np.linalg.norm(profiles.prototypes, axis=1, keepdims=True)
    assert np.isfinite(unit).all()
    direct = unit @ vector / np.sqrt(profiles.dimensions)
    assert np.allclose(direct, profiles.score([text])[0][0], rtol=1e-3, atol=1e-2)


def test_long_line_without_blanks(profiles):
    found = language.identify(["a_b/" * 200_000 + "`", SAY["ja"].replace("。", "") * 5000], profiles)
    assert len(found[0]) == 1 and found[1][0][2] == "ja"


def test_unlabelled(spark, profiles):
    long = {k: v * 3 for k, v in SAY.items()}
    rows = [(1, "a.md", long["en"], "EN "), (2, "b.md", long["de"], "en"), (3, "c.md", long["en"] + "\n" + long["pt"], "en"), (4, "d.py", long["de"], "en"), (5, "e.md", None, "en"), (6, "f.md", long["ru"], None), (7, "g.md", "", "??"), (8, None, long["de"], "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, lang string, labelled string")
    names = spark.createDataFrame([(k, k) for k in SAY], "label string, lang string")
    got = {tuple(r) for r in language.unlabelled(docs, names, profiles).collect()}
    assert got == {(2, "de"), (3, "pt"), (6, "ru")}
    model = language.train(docs.limit(0), names, dimensions=256)
    assert language.unlabelled(docs.limit(0), names, model).count() == 0
    assert language.segments(docs, model).count() >= 0
