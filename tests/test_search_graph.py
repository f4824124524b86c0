import math

from pyspark.sql import functions as F

from lodestone.operators import extract, fusion, graph, indexing, lexical, repomap, search, vectors
from lodestone.sources import scan, tables


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "cache cache token"), (2, "token other words here"), (3, ""), (4, None), (5, "nothing")], "id long, text string")
    got = {r.id: r.score for r in lexical.bm25(docs, "id", {"q": "the Cache token"}, include_zero=True).collect()}
    n, avgdl = 4, (3 + 4 + 0 + 1) / 4

    def part(tf, df, dl):
        return math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))

    assert math.isclose(got[1], part(2, 1, 3) + part(1, 2, 3)) and math.isclose(got[2], part(1, 2, 4)) and got[3] == got[5] == 0 and 4 not in got
    assert lexical.bm25(docs, "id", {"q": "a b"}).count() == 0


def test_fusion(spark):
    lists = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 3.0), ("a", 3, 1.0), ("b", 3, 9.0)], "list_id string, id long, score double")
    ranked = fusion.positions(lists, "id")
    assert {(r.list_id, r.id): r.pos for r in ranked.collect()} == {("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("b", 3): 0}
    scores = {r.id: r.score for r in fusion.rrf(ranked, "id").collect()}
    assert math.isclose(scores[1], 1 / 61 + 0.05) and math.isclose(scores[3], 1 / 63 + 0.02 + 1 / 61 + 0.05)
    assert {r.score for r in fusion.min_max(lists.filter("score = 3")).collect()} == {1.0}
    assert lists.limit(0).count() == fusion.positions(lists.limit(0), "id").count() == 0


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0]), ([], [])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>").select(vectors.cosine(F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in df.collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_search_modes(spark):
    assert search.parse(" Exact: FOO ") == ("exact", "foo") and search.parse("Foo: Bar") == ("auto", "Foo: Bar")
    documents = spark.createDataFrame([(1, "c", "a.md"), (2, "c", "b.md")], "doc_id long, collection string, path string")
    chunks = spark.createDataFrame([(1, 1, "cache layer", 0, [1.0, 0.0], "other"), (2, 1, "cache cache", 9, None, "other"), (3, 2, "token", 0, [0.0, 1.0], "other")], "id long, doc_id long, content string, start_offset long, embedding array<float>, path string")
    s = search.Searcher(documents, chunks, embed=lambda q: [1.0, 0.0], judge=search.lexical_judge)
    assert [r.doc_path for r in s.search("exact: cache", 5).collect()][0] == "a.md"
    assert s.search("conceptual: anything", 1).collect()[0].chunk_id == 1
    assert [r.doc_path for r in s.search("cache", 5).collect()] == ["a.md"]
    shown = [r.text for r in search.preview(s.search("exact: cache")).orderBy("n").collect()]
    assert len(shown) == 2 and shown[0].startswith("[1] ") and shown[0].endswith(" — a.md\n    cache cache")
    long = spark.createDataFrame([("p", 1, "é\n" * 150, 7, 0.5, "about")], "doc_path string, chunk_id long, chunk_text string, chunk_offset long, score double, context string")
    assert search.preview(long).first().text == "[1] 0.5000 — p\n    Contexto: about\n    " + "é " * 100 + "…"
    assert search.preview(long, full=True).first().text.startswith("[1] 0.5000 — p\n    Contexto: about\n    Fragmento (offset 7):\n    é\n    é")


def test_graph(spark):
    symbols = spark.createDataFrame([(1, "foo", "a.py::foo", "function", "a.py", 1, "python"), (2, "bar", "b.py::bar", "class", "b.py", 2, "python"), (3, "bar", "a.py::bar", "method", "a.py", 9, "python")], "id long, name string, qualified string, kind string, file string, line int, language string")
    calls = spark.createDataFrame([(1, "a.py::bar", "foo", "a.py", 10), (2, "a.py::bar", "foo", "a.py", 11), (3, "c.py::<top>", "foo", "c.py", 1), (4, "d.py::baz", "bar", "d.py", 1), (5, None, "foo", None, None), (6, "a.py::foo", "bar", "a.py", 2)], "id long, caller_qualified string, callee_name string, file string, line int")
    nodes = {r.key: r for r in graph.callers(calls, symbols, "foo").collect()}
    assert nodes["a.py::bar"].kind == "method" and nodes["a.py::bar"].score == 2.0 and nodes["c.py::<top>"].kind == "function"
    assert graph.callers(calls, symbols, "foo", budget=1).count() == 0
    kept = graph.with_sites(graph.callers(calls, symbols, "foo", budget=100), calls.filter("callee_name = 'foo'"), "caller_qualified")
    assert {r.key: r.site_list for r in kept.collect()}["a.py::bar"] == ["a.py:10", "a.py:11"]
    levels = {(r.level, r.target, r.key) for r in graph.trace(calls, "foo", 3).collect()}
    assert levels == {(1, "foo", "a.py::bar"), (1, "foo", "c.py::<top>"), (2, "bar", "d.py::baz"), (2, "bar", "a.py::foo")}
    assert graph.trace(calls, "missing").count() == 0


def test_pagerank(spark):
    nodes = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 10.0)], "node string, p double")
    edges = spark.createDataFrame([("a", "b", 2), ("b", "a", 1)], "src string, dst string, weight long")
    ranks = {r.node: r.rank for r in graph.pagerank(nodes, edges).collect()}
    assert math.isclose(sum(ranks.values()), 1, abs_tol=1e-9) and ranks["c"] > ranks["a"]
    refs = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("c", "x"), ("c", "z")], "file string, name string")
    defs = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", "z"), ("c", "x")], "file string, name string")
    one = {r.node: round(r.rank, 9) for r in graph.file_rank(nodes, refs, defs, 6, 3, None).collect()}
    two = {r.node: round(r.rank, 9) for r in graph.pagerank(nodes, graph.file_edges(refs, defs), 6, 3, None).collect()}
    assert one == two


def test_extraction(spark):
    files = [("a.py", "import os.path\nclass A:\n    def m(self, x):\n        return g(x)\ndef f(a, b=1):\n    pass\n"), ("b.ts", "export interface I {\n}\nexport class C extends D {\n  run(x: number): void {\n    go(x);\n  }\n}\n"), ("c.rb", "class U < Base\n  has_many :posts\n  def self.find(id)\n  end\nend\n"), ("bad.py", "def ("), ("x.txt", "def f()"), ("n.py", None), ("r.rs", "pub fn go(x: i32) -> u8 {\nstruct S;\n"), ("J.java", "public class J {\n  public int size(List<T> a) {\n")]
    df = spark.createDataFrame(files, "path string, text string")
    sigs = {r.path: r for r in extract.signatures(df).collect()}
    assert sigs["a.py"].sigs == ["class A", "    def m(self, x)", "  def f(a, b=1)"] and sigs["a.py"].refs == ["path"]
    assert sigs["b.ts"].sigs == ["interface I", "class C", "function run(x: number)"] and "x.txt" not in sigs and sigs["bad.py"].sigs == []
    assert sigs["c.rb"].sigs == ["class U", "has_many :posts", "def self.find(id)"] and sigs["r.rs"].sigs == ["pub fn go(x: i32) -> u8", "struct S"]
    assert sigs["J.java"].sigs == ["class J", "public int size(List<T> a)"]
    assert ("a.py", "a.py::m", "g", 4) in {tuple(r) for r in extract.calls(df).collect()}
    assert {r.qualified for r in extract.definitions(df).collect()} >= {"a.py::A", "b.ts::run", "r.rs::go", "J.java::size"}
    assert ("a.py", "os.path", 1) in {tuple(r) for r in extract.imports(df).collect()}


def test_routes():
    assert len(extract.rails_routes("resources :users\n")) == 8
    assert extract.rails_routes("namespace :admin do\n get 'x', to: 'a#b'\nend\nget 'y' => 'c#d'\n") == [("GET", "/admin/x", "a_controller::b", 2), ("GET", "/y", "c_controller::d", 4)]
    assert {h for _, _, h, _ in extract.rails_routes("resources :users, only: [:index]\n")} == {f"users_controller::{a}" for a in "index new create show edit update destroy".split()}
    assert extract.rails_routes("delete :logout, to: 'sessions#destroy'\n") == [("DELETE", "/sessions#destroy", "sessions_controller::destroy", 1)]  # the first quoted text is the path
    assert len(extract.grails_routes('"/books"(resources: "book")')) == 5
    assert extract.nest_routes("@Controller('c')\nclass C {\n@All()\nx() {}\n") == [("ANY", "/c", "C::x", 3)]


def test_repo_map(spark):
    files = spark.createDataFrame([("a.py", 2.0, ["def f"]), ("b.py", 1.0, ["class B", "def g"]), ("c.py", 0.5, [])], "path string, score double, sigs array<string>")
    whole = repomap.text_map(repomap.fit(files, 1000)).first().repo_map
    for budget in range(0, 60):
        text = repomap.text_map(repomap.fit(files, budget)).first().repo_map if budget % 20 == 7 else None
        assert text is None or len(text.encode()) // 4 <= max(budget, len(whole.encode())) and text.startswith("<repo_map>")
    assert repomap.fit(files, 0).count() == 1
    assert '"path" : "a.py"' in repomap.json_map(repomap.fit(files, 1000)).first().repo_map


def test_indexing(spark):
    rows = spark.createDataFrame([("c", "docs/a/x"), ("c", "src/y"), ("d", "docs/a/x")], "collection string, path string")
    contexts = spark.createDataFrame([("c", "docs/", "d", 1), ("c", "docs/a", "da", 0), ("c", "docs/a", "dz", 5), (None, None, "n", 1)], "collection string, path_prefix string, description string, priority long")
    assert {(r.collection, r.path): r.context for r in indexing.path_context(rows, contexts).collect()} == {("c", "docs/a/x"): "dz", ("c", "src/y"): None, ("d", "docs/a/x"): None}
    for text in ("", "a" * 2701, "é" * 1500, " x " * 700):
        found = indexing.byte_pieces(text.encode())
        assert all(len(c) <= 1000 and c.decode() for _, c in found) and [s for s, _ in found] == sorted({s for s, _ in found})
    assert [s for s, _ in indexing.byte_pieces(b"a" * 2701)] == [0, 850, 1700, 2550][: 1 + math.ceil(1701 / 850)]


def test_scan_and_tables(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    for name in ("src/a.py", "src/b.md", "src/node_modules/c.py", "README.md"):
        (tmp_path / name).write_text("x = 1\n")
    assert {r.path for r in scan.read_texts(spark, [str(tmp_path)], extensions=["py"]).collect()} == {"src/a.py"}
    assert {r.path for r in scan.read_documents(spark, str(tmp_path)).collect()} == {"src/b.md", "README.md"}
    assert scan.glob_regex("a[") is None
    paths = spark.createDataFrame([("Cargo.toml",), ("docs/x.md",)], "path string")
    assert scan.stack(paths).first().rust and scan.stack(paths).first().has_docs
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert {tuple(r) for r in tables.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    path = str(tmp_path / "t")
    tables.append(old, path)
    tables.replace(tables.upsert(spark.read.parquet(path), new, ["k"]), path)
    assert spark.read.parquet(path).count() == 3
    assert tables.read_or_empty(spark, str(tmp_path / "none"), "k long").count() == 0


def test_streaming(spark, tmp_path):
    import datetime as dt

    from lodestone.streaming import pipelines

    schema = "id long, timestamp timestamp, command_name string, input_tokens long, output_tokens long"
    at = dt.datetime(2025, 1, 1, 10)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    # a clock that is far ahead in the first batch drops nothing of the second
    for rows in ([(1, at, "git", 5, 1), (2, at, "git", 5, 1), (3, at + dt.timedelta(days=900), "ls", 1, 1)], [(4, at, "git", 7, 1), (5, at, "git", 5, 1), (6, None, "ls", 2, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = pipelines.daily_usage(pipelines.read(spark, source, spark.read.parquet(source).schema))
        pipelines.write_whole(stream, out, check).awaitTermination()
    found = {(r.day, r.command_name): (r.executions, r.input_tokens) for r in spark.read.parquet(out).collect()}
    assert found == {(at.date(), "git"): (2, 12), ((at + dt.timedelta(days=900)).date(), "ls"): (1, 1), (None, "ls"): (1, 2)}


def test_replace_survives_failure(spark, tmp_path):
    import shutil

    path = str(tmp_path / "t")
    one, two = spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([(2,)], "k long")
    read = lambda: [r.k for r in tables.read_or_empty(spark, path, "k long").collect()]
    tables.replace(one, path)
    two.write.parquet(path + ".next")  # died before anything was renamed
    assert read() == [1]
    two.write.parquet(path + ".next")  # died between both renames
    shutil.move(path, path + ".old")
    assert read() == [2]
    shutil.move(path, path + ".old")  # the new version isn't complete
    (tmp_path / "t.next").mkdir()
    assert read() == [2] and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_cache(spark, tmp_path):
    cache = tables.Cache(spark, str(tmp_path / "cache"), "k long, v string")
    asked, computed = spark.createDataFrame([(1, "a"), (2, "b")], "k long, text string"), []

    def compute(missing):
        computed.append(sorted(r.k for r in missing.collect()))
        return missing.select("k", F.upper("text").alias("v"))

    assert {tuple(r) for r in cache.get(asked.filter("k = 1"), compute, ["k"]).collect()} == {(1, "A")}
    assert {tuple(r) for r in cache.get(asked, compute, ["k"]).collect()} == {(1, "A"), (2, "B")} and computed == [[1], [2]]


def test_top_fused_equals_ranking_everything(spark):
    import random

    draw = random.Random(5)
    for n in (0, 7, 400):
        rows = [(i, draw.choice([None, 0.0, 0.0, 0.0, 1.0, round(draw.random(), 1)]), draw.choice([None, round(draw.random(), 2), 0.5])) for i in range(n)]
        wide = spark.createDataFrame(rows, "id long, a double, b double")
        lists = wide.selectExpr("id", "stack(2, 'a', a, 'b', b) as (list_id, score)").filter("score is not null")
        weights = {"a": 2.0, "b": 1.0}
        every = fusion.rrf(fusion.positions(lists, "id"), "id", weights).withColumn("score", F.round("score", 12))
        for k in (5,):
            assert [tuple(r) for r in fusion.top(every.select("id", "score"), "id", k).collect()] == [tuple(r) for r in fusion.top_fused(wide, "id", weights, k).collect()]
    assert fusion.depth_of([2, 1, 1, 2, 1, 1], 30) == 8 * 90 - 60


def test_enclosing_over_many_partitions(spark):
    import random

    draw = random.Random(3)
    defs = [(draw.choice("abc"), draw.randint(1, 60), i, f"d{i}") for i in range(40)] + [("hot", 5, 100, "h5"), ("hot", 900, 101, "h900")]
    sites = [(i, draw.choice("abcd"), draw.randint(1, 80)) for i in range(200)] + [(1000 + i, "hot", draw.choice([1, 7, 7, 7, 950])) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found = graph.enclosing(spark.createDataFrame(defs, "file string, line int, ord long, qualified string"), spark.createDataFrame(sites, "id long, file string, line int"))
        got = {r.id: r.caller_qualified for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {i: max(((line, o, q) for f, line, o, q in defs if f == file and line <= at), default=(0, 0, f"{file}::<top>"))[2] for i, file, at in sites}
    assert got == want
    assert graph.enclosing(spark.createDataFrame([], "file string, line int, ord long, qualified string"), spark.createDataFrame([], "id long, file string, line int")).count() == 0


def test_path_context_few_and_many(spark):
    rows = spark.createDataFrame([(1, "c", "docs/a/x.md"), (2, "c", "docs/b"), (3, "c", "src/x"), (4, "d", "docs/a/x.md"), (5, None, None), (6, "c", None)], "doc_id long, collection string, path string")
    contexts = spark.createDataFrame([("c", "docs/", "all", 1), ("c", "docs/a/", "low", 1), ("c", "docs/a/", "high", 2), (None, "docs/", "none", 1), ("c", None, "none", 1)], "collection string, path_prefix string, description string, priority long")
    for few in (100, 1):
        assert {r.doc_id: r.context for r in indexing.path_context(rows, contexts, few).collect()} == {1: "high", 2: "all", 3: None, 4: None, 5: None, 6: None}


def test_stack(spark):
    files = spark.createDataFrame([("package.json", '"workspaces"'), ("apps/a/x", ""), (None, None)], "path string, text string")
    row = scan.stack(files).first()
    assert row.node and row.monorepo and row.subprojects == ["apps/a"] and not row.react
