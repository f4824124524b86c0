"""Cases where an operator once did less than its whole job."""

from lodestone.operators import extract

PYTHON = '''import os.path, sys as s
from ..a import (b as c,
   d)
@deco(1)
class A(Base):
    """doc call(x)"""
    def m(self, x: int = (1, 2), *, k="a)b"):  # note(x)
        return g(x) + f"{h(1)}" + "i(2)"
    async def n(self):
        class B:
            def w(self): pass
def f(a,
      b=1) -> int:
    return super().foo(re.match("x", a))
'''


def by_line(found):
    return [sorted(rows, key=lambda r: (r[-1], r)) if rows and isinstance(rows[0], tuple) else rows for rows in found]


def test_python_that_does_not_parse():
    whole = extract.parse("python", PYTHON)
    assert by_line(extract._python_lines(PYTHON)) == by_line(whole) and len(whole[2]) == 6
    assert extract.parse("python", "\ufeff" + PYTHON) == whole
    assert extract.parse("python", "".join("    " + line for line in PYTHON.splitlines(True))) == whole
    for broken in ("x = = 1\n", "\0", "print 'y'\n", "def (\n"):
        for code, moved in ((PYTHON + broken, 0), (broken + PYTHON, broken.count("\n"))):
            found = extract.parse("python", code)
            assert found[0] == whole[0] and found[1] == whole[1]
            assert by_line(found)[2:] == by_line([[(*r[:-1], r[-1] + moved) for r in rows] for rows in whole[2:]])
    inside = extract.parse("python", "class A:\n    def m(self):\n        x = = 1\n    def n(self, a=1): g(a)\n")
    assert inside[0] == ["class A", "    def m(self)", "    def n(self, a=1)"] and inside[2][1:] == [("m", "method", 2), ("n", "method", 4)] and inside[3] == [("g", 4)]


def test_python_with_deep_expressions():
    assert extract.parse("python", "x = " + "+".join(["1"] * 3000) + "\ndef f(): g()\n")[2:4] == ([("f", "function", 2)], [("g", 2)])


def test_long_lines():
    code = 'import{a as b}from"m1";var z=' + "x" * 30_000 + ";class A extends B{run(x={},y=1){go(x);run(1)}static stop(){}};export function f(a,b){return f(a-1)}!function(){function inner(q){k(q)}}();if(x){y(1)}"
    sigs, refs, defs, calls, imports = extract.parse("typescript", code)
    assert sigs == ["class A", "function run(x={},y=1)", "function stop()", "function f(a,b)", "function inner(q)"] and refs == ["a", "b", "B"]
    assert defs == [("A", "class", 1), ("run", "method", 1), ("stop", "method", 1), ("f", "function", 1), ("inner", "function", 1)]
    assert [c for c, _ in calls] == ["go", "run", "f", "k", "y"] and imports == [("m1", 1)]
    java = "package x;import java.util.List;" + "int z;" * 500 + "public class J{public int size(List<T> a)throws X{return f(a);}}"
    assert extract.parse("java", java) == (["class J", "public int size(List<T> a)"], ["f"], [("J", "class", 1), ("size", "method", 1)], [("f", 1)], [("java.util.List", 1)])


def test_repo_map_of_signatures(spark):
    import math

    from lodestone.operators import repomap

    texts = {
        "src/cache.py": "from b import token_store\n\ndef cache(token, budget):\n    pass\nclass Cache:\n    pass\n",
        "src/b.py": "import Cache\n\nclass token_store:\n    def get(self): pass\n",
        "lib/c.ts": "export class Budget {\n}\nimport { Cache } from './cache';\n",
        "lib/c.test.ts": "export class CacheBudget {\n}\n",
        "lib/d.go": "func Other(a int) {\n",
        "e.py": "# token budget cache\nx = 1\n",
        "f.md": "token budget cache",
    }
    files = repomap.corpus(spark.createDataFrame(list(texts.items()), "path string, text string"))
    corpus = {r.path: r for r in files.collect()}
    assert set(corpus) == set(texts) - {"e.py", "f.md"} and corpus["src/cache.py"].sigs == ["  def cache(token, budget)", "class Cache"]

    def brute_words():
        import re

        docs = {p: [t.lower() for t in re.findall("[0-9]+|[A-Z]{2,}|[A-Z][a-z0-9]*|[a-z][a-z0-9]*", p + " " + " ".join(r.sigs)) if len(t) > 2] for p, r in corpus.items()}
        mean = sum(map(len, docs.values())) / len(docs)
        out = {}
        for p, words in docs.items():
            out[p] = 0.0
            for t in ("token", "budget", "cache"):
                df, tf = sum(t in w for w in docs.values()), words.count(t)
                out[p] += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
            out[p] *= 0.3 if p.endswith(".test.ts") else 1
        return out

    def brute_graph(words):
        last = lambda s: re.sub(r"[^0-9A-Za-z]+$", "", s.split()[-1])
        import re

        defined = [(last(s), p) for p, r in corpus.items() for s in r.sigs]
        edges = [(p, q) for p, r in corpus.items() for name in r.refs for n, q in defined if n == name and p != q]
        p = {f: 1.0 for f in corpus} | {f: 10.0 for f in sorted(corpus, key=lambda f: (-words[f], f))[:5]}
        p |= {f: 50.0 for f in corpus if f.startswith("src/")}
        p = {f: v / sum(p.values()) for f, v in p.items()}
        out = {f: sum(a == f for a, _ in edges) for f in corpus}
        x = {f: 1 / len(p) for f in p}
        for _ in range(500):
            loose = sum(v for f, v in x.items() if not out[f])
            x = {f: 0.85 * (sum(x[a] / out[a] for a, b in edges if b == f) + loose * p[f]) + 0.15 * p[f] for f in p}
        assert edges
        return x

    words = brute_words()
    for ranked, brute in ((repomap.by_words(files, "token budget cache"), words), (repomap.by_graph(files, "token budget cache", ["src/"]), brute_graph(words))):
        got = {r.path: r.score for r in ranked.collect()}
        assert set(got) == set(brute) and all(math.isclose(got[f], brute[f], abs_tol=1e-5) for f in brute)
        order = sorted(brute, key=lambda f: (-brute[f], f))
        for budget in (1, 30, 60, 1000):
            render = lambda k: "\n".join(["<repo_map>", *[x for f in order[:k] for x in ("\n" + f + ":", "⋮", *["│" + s for s in corpus[f].sigs], "⋮")], "\n</repo_map>"])
            k = max([1, *[k for k in range(1, len(order) + 1) if len(render(k).encode()) // 4 <= budget]])
            assert repomap.text_map(repomap.fit(ranked, budget)).first().repo_map == render(k)


def test_converged_personalized_pagerank(spark, tmp_path):
    import math

    import __spark_entry__

    calls = [("src/a", "x"), ("src/a", "y"), ("src/a", "y"), ("b", "z"), ("c", "x"), ("d/token", "w"), ("e", "v"), ("f", "x")] + [(f"n{i}", "x" if i % 2 else "z") for i in range(6)]
    symbols = [("b", "x"), ("c", "y"), ("d/token", "z"), ("src/a", "w"), ("c", "v")]
    spark.createDataFrame(calls, "file string, callee_name string").write.parquet(str(tmp_path / "calls.parquet"))
    spark.createDataFrame(symbols, "file string, name string").write.parquet(str(tmp_path / "symbols.parquet"))
    edges = [(f, g) for f, name in calls for g, n in symbols if n == name and f != g]
    p = {f: 50.0 if f == "src/a" else 10.0 if f == "d/token" else 1.0 for f, _ in calls + symbols}
    p = {f: v / sum(p.values()) for f, v in p.items()}
    out = {f: sum(a == f for a, _ in edges) for f in p}
    x, error = {f: 1 / len(p) for f in p}, 1.0
    done = 0
    while error >= len(p) * 1e-6 or done % 3:  # convergence is looked at after each third
        loose = sum(v for f, v in x.items() if not out[f])
        new = {f: 0.85 * (sum(x[a] / out[a] for a, b in edges if b == f) + loose * p[f]) + 0.15 * p[f] for f in p}
        error, x, done = sum(abs(new[f] - x[f]) for f in p), new, done + 1
    assert done > 3
    got = {r.file: r["rank"] for r in __spark_entry__.queries()["pagerank"](spark, str(tmp_path)).collect()}
    assert set(got) == set(x) and all(math.isclose(got[f], x[f], abs_tol=2e-8) for f in x)


ROUTE_FILES = [
    ("config/routes.rb", "Rails.application.routes.draw do\n  resources :users\n  namespace :admin do\n    get 'stats', to: 'stats#show'\n  end\nend\n"),
    ("grails-app/conf/UrlMappings.groovy", 'class UrlMappings {\n  "/books"(resources: "book")\n  "/x/$id?"(controller: "thing")\n}\n'),
    ("src/cats.controller.ts", "@Controller('cats')\nexport class CatsController {\n  @Get()\n  findAll() {}\n  @Get(':id')\n  async findOne(id: string) {}\n  @All('any')\n  any() {}\n}\n"),
]


def test_routes_of_documents(spark, tmp_path):
    import __spark_entry__

    spark.createDataFrame([*ROUTE_FILES, ("a.md", "resources :users"), ("b.rb", None)], "path string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.path, r.method, r.route, r.handler) for r in __spark_entry__.queries()["routes"](spark, str(tmp_path)).collect()}
    assert len(found) == 8 + 1 + 5 + 1 + 3
    assert {("config/routes.rb", "GET", "/admin/stats", "stats_controller::show"), ("grails-app/conf/UrlMappings.groovy", "ANY", "/x/:id", "ThingController::index"), ("src/cats.controller.ts", "GET", "/cats/:id", "CatsController::findOne")} <= found
    symbols = {(r.qualified, r.callee_name) for r in __spark_entry__.queries()["route_symbols"](spark, str(tmp_path)).collect()}
    assert len(symbols) == 18 and ("route::ANY /cats/any", "any") in symbols


def test_compress_output_by_command(spark, tmp_path):
    import __spark_entry__

    from lodestone.operators import lines
    from lodestone.operators.filters import FILTERS

    texts = ["$ git push origin\nTo x\n  1..2 main -> main", "To x\n  1..2 main -> main", "running the test suite\ntest a ... ok\nFAILED b", "hello\n\nhello", None]
    paths = ["a/1.log", "git/push-1.log", "docs/x/3.log", "docs/x/4.log", "docs/x/5.log"]
    rows = [(i, p, t) for i, (p, t) in enumerate(zip(paths, texts))]
    documents = spark.createDataFrame(rows, "doc_id long, path string, text string")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in __spark_entry__.queries()["compress_output"](spark, str(tmp_path)).collect()}
    assert [got[i].filter for i in range(4)] == ["git::push", "git::push", "cargo::test", None] and got[3].filtered == texts[3]
    for i in range(3):
        assert got[i].filtered == documents.filter(f"doc_id = {i}").select(lines.apply(FILTERS[got[i].filter], documents.text).alias("x")).first().x != texts[i]


def test_catalog(spark, tmp_path):
    import pytest

    from lodestone.catalog import Catalog

    folder = tmp_path / "guides"
    (folder / "build").mkdir(parents=True)
    (folder / "drafts").mkdir()
    for name, text in {"a.md": "cache layer " * 200, "b.txt": "token budget", "c.rs": "fn reader() {}", "build/d.md": "skipped", "drafts/e.md": "ignored", ".gitignore": "# own\ndrafts/\n*.tmp.md\n!keep.tmp.md\n", "x.tmp.md": "no", "keep.tmp.md": "cache kept"}.items():
        (folder / name).write_text(text)
    catalog = Catalog(spark, str(tmp_path / "store"))
    with pytest.raises(KeyError):
        catalog.index("guides")
    assert catalog.bootstrap(str(folder)).asDict() == {"scanned": 3, "errors": 0, "skipped": 0, "indexed": 3} and catalog.names() == ["guides"]
    assert {r.path for r in catalog.documents("guides").collect()} == {"a.md", "b.txt", "keep.tmp.md"} and catalog.chunks("guides").count() == 5
    catalog.add("other", [str(folder)], ["*.rs"], contexts=[("", "code", 1)])
    assert catalog.index("other").indexed == 1 and catalog.names() == ["guides", "other"]
    model = lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert (catalog.embed("guides", 2, model), catalog.embed("guides", 9, model), catalog.embed("guides", 9, model)) == (2, 3, 0)
    assert catalog.health("guides").consistent and not catalog.health("other").consistent
    (folder / "b.txt").write_text("token budget changed")
    (folder / "keep.tmp.md").unlink()
    assert catalog.index("guides").asDict() == {"scanned": 2, "errors": 0, "skipped": 1, "indexed": 1}
    assert {r.path for r in catalog.documents("guides").collect()} == {"a.md", "b.txt"} and catalog.health("guides").pending_embeddings == 1
    assert [r.doc_path for r in catalog.search("guides", "exact: token").collect()][0] == "b.txt"
    assert catalog.search("other", "exact: reader").first().context == "code"
    catalog.compact("guides")
    assert catalog.chunks("guides").count() == 4 and catalog.chunks("other").count() == 1


def test_declarations_over_several_lines():
    code = "import {\n  A,\n  B as C,\n} from './m';\nexport async function load(\n  path: string,\n  more = call(1),\n): Promise<void> {\n  run(\n    path,\n  );\n}\nexport class K {\n  public find(\n    id: number,\n  ): string {\n    return go(id);\n  }\n}\n"
    sigs, refs, defs, calls, imports = extract.parse("typescript", code)
    assert sigs == ["function load( path: string, more = call(1), )", "class K", "function find( id: number, )"] and refs == ["A", "B", "C"]
    assert defs == [("load", "function", 5), ("K", "class", 13), ("find", "method", 14)] and imports == [("./m", 1)]
    assert [c for c in calls] == [("call", 7), ("run", 9), ("go", 17)]
    assert extract.parse("rust", "pub fn add<T>(\n    a: T,\n    b: T,\n) -> T {\n    f(a)\n}\n")[0] == ["pub fn add<T>( a: T, b: T, ) -> T"]
    assert extract.parse("java", "class J {\n    public int size(\n            List<T> a,\n            int b) throws X {\n        return f(a);\n    }\n}\n")[2] == [("J", "class", 1), ("size", "method", 2)]
    assert extract.parse("go", "func (s *S) Run(\n\tctx C,\n) error {\n\tgo1(ctx)\n}\n")[0] == ["func Run( ctx C, )"]
    broken = "function a(\n" * 3000
    assert len(extract.parse("javascript", broken)[3]) <= 3000  # every line is joined once, whatever is never closed
