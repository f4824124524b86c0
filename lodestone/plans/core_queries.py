"""Named queries of the engine's own operators, each with the SQL that it must equal."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.common import load
from lodestone.functions import text as T
from lodestone.operators import extract, fusion, graph, indexing, lexical, lines, repomap, search, usage, vectors
from lodestone.sources import scan, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

QUERY = "token budget cache"
TERMS = ["token", "budget", "cache"]
FIXED = "2025-05-29"
SEEDS = ["src"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _tokens(column: str) -> str:
    return rf"""list_filter(list_transform(regexp_extract_all(regexp_replace({column}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[0-9]+|[A-Z]{{2,}}|[A-Z][a-z0-9]*|[a-z][a-z0-9]*'), lambda x: lower(x)), lambda x: strlen(x) > 2)"""


DOCS = f"docs AS (SELECT doc_id, path, {_tokens('text')} AS tokens FROM documents WHERE text IS NOT NULL)"
_TERM_LIST = "(VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") q(term)"


def _bm25_sql(key: str = "doc_id", table: str = "docs", extra: str = "") -> str:
    return f"""
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM {table}),
tf AS (SELECT {key}, len(tokens) AS dl, term, count(*) AS tf FROM (SELECT {key}, tokens, unnest(tokens) AS term FROM {table}) JOIN {_TERM_LIST} USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT {key}, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term), stats GROUP BY 1),
everything AS (SELECT {key}{extra}, coalesce(score, 0.0) AS score FROM {table} LEFT JOIN scored USING ({key}))"""


# -- text ---------------------------------------------------------------------------------


@query("tokenize_docs", f"WITH {DOCS} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM docs")
def tokenize_docs(s, d):
    return load(s, d, "documents").filter("text is not null").select("doc_id", F.array_join(T.tokenize("text"), " ").alias("tokens"))


@query("term_freq", f"WITH {DOCS} SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM docs) GROUP BY ALL")
def term_freq(s, d):
    return lexical.term_frequencies(load(s, d, "documents"), "doc_id")


@query("doc_freq", f"WITH {DOCS} SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM docs) GROUP BY ALL")
def doc_freq(s, d):
    return lexical.document_frequencies(load(s, d, "documents"), "doc_id")


@query("corpus_stats", f"WITH {DOCS} SELECT count(*) AS n, round(avg(len(tokens)), 6) AS avgdl FROM docs")
def corpus_stats(s, d):
    return lexical.corpus_stats(load(s, d, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash, left(sha256(text), 32) AS short FROM documents")
def content_hash(s, d):
    return load(s, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"), T.short_hash(F.col("text")).alias("short"))


@query("exact_dup_groups", "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(s, d):
    rows = load(s, d, "documents").filter("text is not null").select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    return rows.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query("doc_title", r"""SELECT doc_id, translate(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1'), '-_', '  ') AS title FROM documents""")
def doc_title(s, d):
    return load(s, d, "documents").select("doc_id", T.doc_title(F.col("path")).alias("title"))


@query("embed_input", r"""SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN text ELSE source || chr(10) || chr(10) || text END AS input FROM documents""")
def embed_input(s, d):
    return load(s, d, "documents").select("doc_id", T.embed_input(F.col("source"), F.col("text")).alias("input"))


_MODE_ROWS = "(VALUES (1, 'exact: Foo Bar'), (2, 'Conceptual:How Many'), (3, ' EXPANDED: x Y '), (4, 'Plain Query'), (5, 'other: Z'), (6, '')) m(id, query)"


@query("search_mode_parse", f"""SELECT id, CASE WHEN m = '' THEN 'auto' ELSE lower(m) END AS mode, CASE WHEN m = '' THEN trim(query) ELSE lower(trim(regexp_replace(trim(query), '(?i)^(exact|conceptual|expanded):', ''))) END AS text
    FROM (SELECT *, regexp_extract(trim(query), '(?i)^(exact|conceptual|expanded):', 1) AS m FROM {_MODE_ROWS})""")
def search_mode_parse(s, d):
    rows = s.sql(f"SELECT * FROM {_MODE_ROWS}")
    return rows.select("id", T.search_mode(F.col("query")).alias("mode"), T.search_text(F.col("query")).alias("text"))


@query("clean_query", r"SELECT doc_id, trim(regexp_replace('[T-' || doc_id || '] ' || coalesce(source, ''), '^\[[^\]]+\]\s*', '')) AS query FROM documents")
def clean_query(s, d):
    return load(s, d, "documents").select("doc_id", T.clean_query(F.concat(F.lit("[T-"), F.col("doc_id"), F.lit("] "), F.coalesce("source", F.lit("")))).alias("query"))


@query("approx_tokens", "SELECT doc_id, strlen(text) // 4 AS tokens FROM documents")
def approx_tokens(s, d):
    return load(s, d, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


@query("savings_percent", "SELECT id, round(CASE WHEN input_tokens > 0 THEN greatest(input_tokens - output_tokens, 0) / input_tokens::DOUBLE * 100 ELSE 0 END, 6) AS percent FROM execution_metrics WHERE input_tokens IS NOT NULL AND output_tokens IS NOT NULL")
def savings_percent(s, d):
    rows = load(s, d, "execution_metrics").filter("input_tokens is not null and output_tokens is not null")
    return rows.select("id", F.round(T.savings_percent(F.col("input_tokens"), F.col("output_tokens")), 6).alias("percent"))


@query("relative_path", "SELECT id, CASE WHEN starts_with(file, 'src/') THEN substr(file, 5) WHEN starts_with(file, 'lib/') THEN substr(file, 5) ELSE file END AS rel FROM symbols")
def relative_path(s, d):
    return load(s, d, "symbols").select("id", T.relative_path(F.col("file"), ["src", "lib/"]).alias("rel"))


@query("simple_name", "SELECT id, string_split(qualified, '::')[-1] AS name FROM symbols")
def simple_name(s, d):
    return load(s, d, "symbols").select("id", T.last_segment(F.col("qualified")).alias("name"))


@query("setting_coalesce", "SELECT doc_id, coalesce(nullif(source, ''), nullif(lang, ''), 'default') AS setting FROM documents")
def setting_coalesce(s, d):
    return load(s, d, "documents").select("doc_id", T.setting(F.col("source"), F.col("lang"), F.lit("default")).alias("setting"))


#: Texts by hand with what is rare in the documents: syslog times, a bell, codes, merges, reports of commits.
CASES = [
    (-1, "Jan 15 12:34:56 host up\nFeb  1 02:03:04 host up\nMar 16 01:02:03 host up\nother\n"),
    (-2, "1/Jan/2024:10:00:00 +0000 GET /a/b/c.txt 10.0.0.1:80\n15/Feb/2024:11:01:02 GET /x/y/z 10.0.0.2\n2024-01-15T12:00:00Z pid 123456\n2024-01-15 12:00:01.5+02:00 pid 654321"),
    (-3, "id 0a1b2c3d-0000-1111-2222-0123456789ab done\nid ffffffff-0000-1111-2222-0123456789ab done\nsha 0123abcd\nsha 89abcdef01"),
    (-4, "\x1b[31mred\x1b[0m \x07bell \x1b]0;title\x07end \x1b(B\x1b=x \x1b[2Kline"),
    (-5, "commit a1\nAuthor: x\n\n    Merge branch 'y' is what this message quotes\ncommit b2\nMerge: 1 2\n\n    m\ncommit c3\nMerge branch z\ncommit d4\n\n    last"),
    (-6, "noise\n   abc1234..def5678  main -> main\n * [new branch] x -> x"),
    (-7, " * [new tag] v1 -> v1\n"),
    (-8, "[main abc1234d] feat: more [x]\n 3 files changed"),
    (-9, "[main abc12] short hash\n[main (root-commit) abc1234] first"),
    (-10, '{"a": {"S" : "v \\"q\\""}, "b": {"N": "-3.5"}, "c": { "NULL" : true }, "d": {"BOOL": false}, "e": {"N": "x"}}'),
    (-11, ""),
]


def _literal(text: str) -> str:
    parts = []
    for c in re.split(r"([\n\x1b\x07])", text):
        parts.append(f"chr({ord(c)})" if c in ("\n", "\x1b", "\x07") else "'" + c.replace("'", "''") + "'")
    return " || ".join(parts)


_CASES = "cases AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, {_literal(t)})" for i, t in CASES) + ") v(doc_id, text))"


def _cases(s, d):
    own = s.createDataFrame(CASES, "doc_id long, text string")
    return load(s, d, "documents").filter("text is not null").select("doc_id", "text").unionByName(own)


#: What SQL replaces, written for itself.
_NORMAL = "{0}"
for _pattern, _by in (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?", "<ts>"),
    (r"\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}(\s[+-]\d{4})?", "<ts>"),
    (r"[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", "<ts>"),
    (r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"\b\d{1,3}(\.\d{1,3}){3}(:\d+)?\b", "<ip>"),
    (r"\b[0-9a-fA-F]{8,40}\b", "<hex>"),
    (r"/[A-Za-z0-9_./-]+/[A-Za-z0-9_.-]+", "<path>"),
    (r"\b\d{5,}\b", "<n>"),
):
    _NORMAL = f"regexp_replace({_NORMAL}, '{_pattern}', '{_by}', 'g')"
_normal = lambda column: _NORMAL.replace("{0}", column)
_ROWS = "rows AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM cases))"


@query("log_normalize", f"WITH {_CASES}, {_ROWS} SELECT doc_id, array_to_string(list_transform(l, lambda x: {_normal('x')}), chr(10)) AS out FROM rows")
def log_normalize(s, d):
    return _cases(s, d).select("doc_id", F.array_join(F.transform(T.lines(F.col("text")), T.normalize_log), "\n").alias("out"))


@query("ansi_strip", rf"WITH {_CASES} SELECT doc_id, regexp_replace(chr(27) || '[1;36m' || text || chr(7), '\x1b\[[0-9;]*[A-Za-z]|\x1b[()][AB012]|\x1b[=>]|\x07|\x1b\].*?\x07', '', 'g') AS out FROM cases")
def ansi_strip(s, d):
    return _cases(s, d).select("doc_id", T.strip_ansi(F.concat(F.lit("\x1b[1;36m"), F.col("text"), F.lit("\x07"))).alias("out"))


@query("git_log_blocks", rf"""WITH {_CASES} SELECT doc_id, coalesce(array_to_string(list_filter(string_split(regexp_replace(text, '(?m)^commit ', chr(1) || 'commit ', 'g'), chr(1)), lambda b: b <> '' AND NOT regexp_matches(b, '(?m)^Merge(:| branch)'))[1:50], ''), '') AS out FROM cases""")
def git_log_blocks(s, d):
    return _cases(s, d).select("doc_id", lines.git_log(F.col("text")).alias("out"))


_TRIMMED = r"list_transform(l, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"


@query("push_reports", rf"""WITH {_CASES}, {_ROWS}, hits AS (SELECT doc_id, list_filter({_TRIMMED}, lambda x: contains(x, '->') AND NOT starts_with(x, '*'))[1] AS hit FROM rows)
    SELECT doc_id, coalesce('ok ' || hit, text) AS out FROM cases JOIN hits USING (doc_id)""")
def push_reports(s, d):
    return _cases(s, d).select("doc_id", lines.push_to_ok(F.col("text")).alias("out"))


@query("commit_reports", rf"""WITH {_CASES}, {_ROWS}, hits AS (SELECT doc_id, list_filter({_TRIMMED}, lambda x: regexp_matches(x, '^\[[^\s\]]+\s+[0-9a-f]{{7,}}\]\s+.+$'))[1] AS hit FROM rows)
    SELECT doc_id, coalesce(regexp_replace(hit, '^\[([^\s\]]+)\s+([0-9a-f]{{7,}})\]\s+(.+)$', 'ok \2 \1: \3'), text) AS out FROM cases JOIN hits USING (doc_id)""")
def commit_reports(s, d):
    return _cases(s, d).select("doc_id", lines.commit_to_ok(F.col("text")).alias("out"))


@query("typed_values", r"""WITH CASES SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\{\s*"S"\s*:\s*("([^"\\]|\\.)*")\s*\}', '\1', 'g'), '\{\s*"N"\s*:\s*"(-?[0-9.]+)"\s*\}', '\1', 'g'),
    '\{\s*"BOOL"\s*:\s*(true|false)\s*\}', '\1', 'g'), '\{\s*"NULL"\s*:\s*true\s*\}', 'null', 'g') AS out FROM cases""".replace("CASES", _CASES, 1))
def typed_values(s, d):
    return _cases(s, d).select("doc_id", lines.unwrap_types(F.col("text")).alias("out"))


# -- lexical ------------------------------------------------------------------------------


def _bm25(s, d, **options):
    return lexical.bm25(load(s, d, "documents"), "doc_id", {"q": QUERY}, **options)


@query("bm25_topk", f"WITH {DOCS}, {_bm25_sql()} SELECT doc_id, round(score, 6) AS score FROM everything WHERE score > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT 10")
def bm25_topk(s, d):
    return fusion.top(_bm25(s, d).select("doc_id", F.round("score", 6).alias("score")), "doc_id", 10)


@query("bm25_all", f"WITH {DOCS}, {_bm25_sql()} SELECT doc_id, round(score, 6) AS score FROM everything")
def bm25_all(s, d):
    return _bm25(s, d, include_zero=True).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_penalized", rf"""WITH {DOCS}, {_bm25_sql(extra=", path")}
    SELECT doc_id, round(score * CASE WHEN regexp_matches(path, '\.(stories\.(tsx|ts|js|jsx)|spec\.(ts|tsx)|test\.(ts|tsx))$') THEN 0.3 ELSE 1 END, 6) AS score FROM everything WHERE score > 0""")
def bm25_penalized(s, d):
    return _bm25(s, d, weight=T.penalty(F.col("path"))).select("doc_id", F.round("score", 6).alias("score"))


_CONFIG = r"regexp_matches(regexp_extract(path, '[^/]*$'), 'Config|Bootstrap|Application\.|\.config\.(ts|js|mjs)|\.module\.ts|build\.gradle|pom\.xml|(webpack|vite|jest)\.config\.|application\.(rb|properties|yml)')"


@query("boilerplate_hint", f"""WITH {DOCS}, {_bm25_sql(extra=", path")}, best AS (SELECT * FROM everything WHERE score > 0 ORDER BY round(score, 6) DESC, path LIMIT 10)
    SELECT coalesce(avg(CASE WHEN {_CONFIG} THEN 1.0 ELSE 0.0 END), 0.0) AS share, coalesce(avg(CASE WHEN {_CONFIG} THEN 1.0 ELSE 0.0 END), 0.0) > 0.6 AS boilerplate FROM best""")
def boilerplate_hint(s, d):
    docs = load(s, d, "documents")
    rows = lexical.bm25(docs, "doc_id", {"q": QUERY}).join(docs.select("doc_id", "path"), "doc_id").withColumn("score", F.round("score", 6))
    return lexical.boilerplate(rows, "path", scan.config_file(F.col("path")))


@query("low_variance_hint", f"""WITH {DOCS}, {_bm25_sql()}, best AS (SELECT round(score, 6) AS score FROM everything WHERE score > 0 ORDER BY 1 DESC LIMIT 10)
    SELECT count(*) AS n, max(score) AS best, round(var_samp(score), 6) AS variance, count(*) >= 3 AND max(score) > 0.05 AND var_samp(score) < 0.001 AS low_variance FROM best""")
def low_variance_hint(s, d):
    rows = lexical.low_variance(_bm25(s, d).withColumn("score", F.round("score", 6)), "doc_id")
    return rows.withColumn("variance", F.round("variance", 6))


@query("config_files", f"""SELECT id, {_CONFIG} AS config FROM (SELECT id, path FROM (SELECT id, file AS path FROM symbols) UNION ALL SELECT -row_number() OVER (), path FROM (SELECT unnest(['src/AppConfig.ts', 'vite.config.js', 'a/application.yml', 'pom.xml', 'x.json', 'config.py', 'app.module.ts', 'build.gradle.kts', 'Application.java', 'Bootstrap.groovy']) AS path))""")
def config_files(s, d):
    names = ["src/AppConfig.ts", "vite.config.js", "a/application.yml", "pom.xml", "x.json", "config.py", "app.module.ts", "build.gradle.kts", "Application.java", "Bootstrap.groovy"]
    own = s.createDataFrame([(-1 - i, n) for i, n in enumerate(names)], "id long, path string")
    return load(s, d, "symbols").select("id", F.col("file").alias("path")).unionByName(own).select("id", scan.config_file(F.col("path")).alias("config"))


# -- vectors ------------------------------------------------------------------------------

UNIT = [round(((i * 37) % 64) / 64 - 0.5, 6) for i in range(64)]
_VECTOR = "[" + ", ".join(map(str, UNIT)) + "]::DOUBLE[]"


@query("cosine_all", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}), 6) AS score FROM embeddings")
def cosine_all(s, d):
    return vectors.score_all(load(s, d, "embeddings"), "vec_id", "embedding", {"q": UNIT}).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_topk", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}), 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10")
def knn_topk(s, d):
    return fusion.top(cosine_all(s, d), "vec_id", 10)


# -- fusion and search --------------------------------------------------------------------

CHUNK_DOCS = f"cdocs AS (SELECT id, {_tokens('content')} AS tokens FROM chunks WHERE content IS NOT NULL)"


def embed(text: str) -> list[float]:
    """Stand-in for a model: a vector that depends on the text's length."""
    return [round(((i * 37 + len(text)) % 64) / 64 - 0.5, 6) for i in range(64)]


def _cos(vector: list[float]) -> str:
    return f"CASE WHEN len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0 THEN list_cosine_similarity(embedding::DOUBLE[], {vector}::DOUBLE[]) ELSE 0.0 END"


_COS = _cos(UNIT)
_USABLE = "embedding IS NOT NULL AND NOT list_has_any(list_transform(embedding, lambda x: isnan(x)), [true])"
_LISTS = f"""{CHUNK_DOCS}, {_bm25_sql("id", "cdocs")},
lists AS (SELECT 'b_q' AS list_id, id, round(score, 6) AS score FROM everything
          UNION ALL SELECT 'e_q', id, round({_COS}, 6) FROM chunks WHERE {_USABLE}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, id) - 1 AS pos FROM lists)"""


def _lists(s, d):
    chunks = load(s, d, "chunks")
    usable = chunks.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: F.isnan(x)))
    both = lexical.bm25(chunks, "id", {"b_q": QUERY}, "content", include_zero=True).unionByName(vectors.score_all(usable, "id", "embedding", {"e_q": UNIT}))
    return fusion.positions(both.withColumn("score", F.round("score", 6)), "id")


_CREDIT = "1.0 / (61 + pos) + CASE WHEN pos = 0 THEN 0.05 WHEN pos <= 2 THEN 0.02 ELSE 0 END"


@query("rank_positions", f"WITH {_LISTS} SELECT list_id, id, score, CAST(pos AS INT) AS pos FROM ranked")
def rank_positions(s, d):
    return _lists(s, d)


@query("rrf_fuse", f"WITH {_LISTS} SELECT id, round(sum({_CREDIT}), 6) AS score FROM ranked GROUP BY 1")
def rrf_fuse(s, d):
    return fusion.rrf(_lists(s, d), "id").withColumn("score", F.round("score", 6))


@query("rrf_weighted", f"WITH {_LISTS} SELECT id, round(sum(2 * ({_CREDIT})), 6) AS score FROM ranked GROUP BY 1")
def rrf_weighted(s, d):
    return fusion.rrf(_lists(s, d), "id", {"b_q": 2.0, "e_q": 2.0}).withColumn("score", F.round("score", 6))


_TOP30 = f"WITH {_LISTS}, fused AS (SELECT id, round(sum({_CREDIT}), 9) AS score FROM ranked GROUP BY 1), best AS (SELECT * FROM fused ORDER BY score DESC, id LIMIT 30)"


def _top30(s, d):
    chunks = load(s, d, "chunks")
    usable = F.when(~F.exists("embedding", lambda x: F.isnan(x)), F.col("embedding"))
    wide = lexical.bm25_wide(chunks, "id", {"b_q": QUERY}, "content", keep={"e_q": vectors.cosine_to(usable, UNIT)})
    return fusion.top_fused(wide.select("id", *[F.round(n, 6).alias(n) for n in ("b_q", "e_q")]), "id", {"b_q": 1.0, "e_q": 1.0}, 30).withColumn("score", F.round("score", 9))


@query("top30", f"{_TOP30} SELECT id, round(score, 6) AS score FROM best")
def top30(s, d):
    return _top30(s, d).withColumn("score", F.round("score", 6))


@query("minmax_norm", f"{_TOP30} SELECT id, round((score - (SELECT min(score) FROM best)) / ((SELECT max(score) FROM best) - (SELECT min(score) FROM best)), 4) AS score FROM best")
def minmax_norm(s, d):
    return fusion.min_max(_top30(s, d)).withColumn("score", F.round("score", 4))


@query("best_per_doc", f"""WITH {CHUNK_DOCS}, {_bm25_sql("id", "cdocs")}, r AS (SELECT doc_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, id) AS r FROM everything JOIN chunks USING (id) WHERE score > 0)
    SELECT doc_id, id, score FROM r WHERE r = 1""")
def best_per_doc(s, d):
    chunks = load(s, d, "chunks")
    scored = lexical.bm25(chunks, "id", {"q": QUERY}, "content").withColumn("score", F.round("score", 6))
    return fusion.best_per(scored.join(chunks.select("id", "doc_id"), "id"), "doc_id", "id").select("doc_id", "id", "score")


def _searcher(s, d, **options):
    chunks = load(s, d, "chunks")
    usable = F.when(~F.exists("embedding", lambda x: F.isnan(x)), F.col("embedding"))
    return search.Searcher(load(s, d, "documents"), chunks.withColumn("embedding", usable), embed=embed, **options)


def _result(scored: str, limit: int = 10) -> str:
    return f"""hits AS (SELECT path AS doc_path, id AS chunk_id, round(score, 4) AS score, score AS raw, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS r
        FROM {scored} JOIN chunks USING (id) JOIN documents USING (doc_id))
    SELECT doc_path, chunk_id, score FROM hits WHERE r = 1 ORDER BY raw DESC, chunk_id LIMIT {limit}"""


def _short(df):
    return df.select("doc_path", "chunk_id", F.round("score", 4).alias("score"))


@query("search_exact", f"WITH {CHUNK_DOCS}, {_bm25_sql('id', 'cdocs')}, few AS (SELECT * FROM everything ORDER BY score DESC, id LIMIT 20), {_result('few')}")
def search_exact(s, d):
    return _short(_searcher(s, d).search(f"exact: {QUERY}"))


@query("search_conceptual", f"WITH few AS (SELECT id, {_cos(embed(QUERY))} AS score FROM chunks WHERE {_USABLE} ORDER BY 2 DESC, 1 LIMIT 20), {_result('few')}")
def search_conceptual(s, d):
    return _short(_searcher(s, d).search(f"conceptual: {QUERY}"))


_HEAD = "list_has_any(string_split_regex(lower(left(content, 500)), '[^a-z0-9]+'), ['token', 'budget', 'cache'])"
VARIANTS = ["cache layer", "embedding model"]
HYPOTHESIS = "the cache layer merges old rows"


def _hybrid_sql(text: str, variants: list[str], judged: bool) -> str:
    wordings = [text, *variants]
    weights = [2, *[1] * len(variants)]
    terms = ", ".join(f"({i}, '{t}')" for i, w in enumerate(wordings) for t in lexical.query_terms(w))
    near = " UNION ALL ".join(f"SELECT 'e{i}' AS list_id, id, round({_cos(embed(w))}, 9) AS score, {weights[i]} AS weight FROM chunks WHERE {_USABLE}" for i, w in enumerate(wordings))
    return f"""WITH {CHUNK_DOCS}, q(list, term) AS (VALUES {terms}), w(list, weight) AS (VALUES {", ".join(f"({i}, {x})" for i, x in enumerate(weights))}),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM cdocs),
tf AS (SELECT id, len(tokens) AS dl, term, count(*) AS tf FROM (SELECT id, tokens, unnest(tokens) AS term FROM cdocs) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
hit AS (SELECT list, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), stats GROUP BY ALL),
lists AS (SELECT 'b' || list AS list_id, id, round(coalesce(score, 0), 9) AS score, weight FROM (SELECT id, list, weight FROM cdocs, w) LEFT JOIN hit USING (id, list) UNION ALL {near}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, id) - 1 AS pos FROM lists),
fused AS (SELECT id, round(sum(weight * ({_CREDIT})), 12) AS score FROM ranked GROUP BY 1 ORDER BY score DESC, id LIMIT 30),
judged AS (SELECT id, {"score * 1.5 AS score FROM fused JOIN chunks USING (id) WHERE " + _HEAD if judged else "score FROM fused"}),
few AS (SELECT id, CASE WHEN max(score) OVER () - min(score) OVER () < 1e-12 THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score FROM judged), {_result("few")}"""


@query("hybrid_search", _hybrid_sql(QUERY, VARIANTS, True))
def hybrid_search(s, d):
    return _short(_searcher(s, d, judge=search.lexical_judge, variants=lambda q: VARIANTS).search(QUERY))


@query("search_expanded", _hybrid_sql(f"{QUERY} {HYPOTHESIS}", [], False))
def search_expanded(s, d):
    return _short(_searcher(s, d, hypothesis=lambda q: HYPOTHESIS).search(f"expanded: {QUERY}"))


@query("rerank_boost", f"{_TOP30} SELECT id, round(score * 1.5, 6) AS score FROM best JOIN chunks USING (id) WHERE {_HEAD}")
def rerank_boost(s, d):
    return search.rerank(_top30(s, d), load(s, d, "chunks"), search.lexical_judge(QUERY)).withColumn("score", F.round("score", 6))


# -- indexing -----------------------------------------------------------------------------


@query("chunk_ascii", """SELECT doc_id, unnest(CASE WHEN strlen(text) <= 1000 THEN [0] ELSE list_transform(range(1 + CAST(ceil((strlen(text) - 1000) / 850.0) AS BIGINT)), lambda i: i * 850) END) AS start_offset
    FROM documents WHERE strlen(text) = length(text) AND strlen(text) > 0""")
def chunk_ascii(s, d):
    rows = load(s, d, "documents").filter("octet_length(text) = length(text) and octet_length(text) > 0")
    return rows.select("doc_id", F.explode(indexing.ascii_offsets(F.col("text"))).alias("start_offset"))


def _whole_character(at: str) -> str:
    inside = lambda x: f"hex(b[{x} + 1:{x} + 1]) BETWEEN '80' AND 'BF'"
    tries = " ".join(f"WHEN NOT {inside(f'({at} - {i})')} THEN {at} - {i}" for i in range(3))
    return f"(CASE WHEN {at} <= 0 OR {at} >= n THEN {at} {tries} ELSE {at} - 3 END)"


@query("chunk_all", rf"""WITH RECURSIVE t AS (SELECT doc_id, encode(text) AS b, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE text <> ''),
    spans(doc_id, s, e) AS (SELECT doc_id, CAST(0 AS BIGINT), {_whole_character("least(1000, n)")} FROM t
        UNION ALL SELECT doc_id, s, {_whole_character("least(s + 1000, n)")} FROM (SELECT doc_id, b, n, CASE WHEN back > s THEN back ELSE e END AS s
            FROM (SELECT doc_id, b, n, s, e, {_whole_character("(e - CAST(floor((e - s) * 0.15) AS BIGINT))")} AS back FROM spans JOIN t USING (doc_id) WHERE e < n)))
    SELECT doc_id, s AS start_offset, content FROM (SELECT doc_id, s, regexp_replace(decode(b[s + 1:e]), '^\s+|\s+$', '', 'g') AS content FROM spans JOIN t USING (doc_id)) WHERE content <> ''""")
def chunk_all(s, d):
    return indexing.byte_chunks(load(s, d, "documents"))


_OLD = "old AS (SELECT collection, path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY collection, path ORDER BY run_id DESC, indexed_at DESC NULLS LAST, content_hash) AS r FROM snapshots) WHERE r = 1)"


def _old(s, d):
    rows = load(s, d, "snapshots")
    w = Window.partitionBy("collection", "path").orderBy(F.desc("run_id"), F.desc_nulls_last("indexed_at"), "content_hash")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("collection", "path", "content_hash")


@query("index_diff", f"""WITH {_OLD} SELECT coalesce(n.collection, o.collection) AS collection, coalesce(n.path, o.path) AS path,
    CASE WHEN o.b IS NULL THEN 'new' WHEN n.a IS NULL THEN 'deleted' WHEN n.content_hash IS NOT DISTINCT FROM o.content_hash THEN 'same' ELSE 'changed' END AS status
    FROM (SELECT *, true AS a FROM documents) n FULL JOIN (SELECT *, true AS b FROM old) o ON n.collection = o.collection AND n.path = o.path""")
def index_diff(s, d):
    return indexing.diff(load(s, d, "documents"), _old(s, d))


@query("orphan_gc", f"WITH {_OLD} SELECT collection, path FROM old ANTI JOIN documents USING (collection, path)")
def orphan_gc(s, d):
    return indexing.orphans(_old(s, d), load(s, d, "documents")).select("collection", "path")


@query("compact_semi", "SELECT id FROM chunks WHERE doc_id IN (SELECT doc_id FROM documents WHERE path LIKE '%.md')")
def compact_semi(s, d):
    return indexing.without_orphans(load(s, d, "chunks"), load(s, d, "documents").filter("path like '%.md'")).select("id")


@query("health_report", """SELECT collection, count(*) AS total_documents, CAST(coalesce(sum(p), 0) AS BIGINT) AS pending_embeddings, max(indexed_at) AS last_indexed, coalesce(sum(p), 0) = 0 AS consistent
    FROM documents LEFT JOIN (SELECT doc_id, count(*) FILTER (status IS DISTINCT FROM 'done') AS p FROM chunks GROUP BY 1) USING (doc_id) GROUP BY 1""")
def health_report(s, d):
    return indexing.health(load(s, d, "documents"), load(s, d, "chunks"))


@query("pending_queue", """SELECT id, doc_id FROM chunks JOIN documents USING (doc_id) WHERE status IS DISTINCT FROM 'done' AND collection = 'billing-adr' ORDER BY id LIMIT 100""")
def pending_queue(s, d):
    return indexing.pending(load(s, d, "chunks"), load(s, d, "documents"), "billing-adr", 100).select("id", "doc_id")


@query("embed_pending", r"""SELECT id, strlen(input)::BIGINT AS size, len(input) - len(replace(input, 'e', ''))::BIGINT AS e FROM (SELECT id, CASE WHEN title = '' THEN coalesce(content, '') ELSE title || chr(10) || chr(10) || coalesce(content, '') END AS input
    FROM (SELECT id, content, translate(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1'), '-_', '  ') AS title FROM chunks JOIN documents USING (doc_id) WHERE status IS DISTINCT FROM 'done' AND collection = 'billing-adr' ORDER BY id LIMIT 100))""")
def embed_pending(s, d):
    """A stand-in for a model gives each text its bytes and its letters e."""
    model = lambda texts: [[float(len(t.encode())), float(t.count("e"))] for t in texts]
    done = indexing.embed_pending(load(s, d, "chunks"), load(s, d, "documents"), "billing-adr", 100, model)
    return done.select("id", F.col("embedding")[0].cast("long").alias("size"), F.col("embedding")[1].cast("long").alias("e"))


@query("index_stats", f"""WITH {_OLD} SELECT count(*) AS scanned, count(*) FILTER (text IS NULL) AS errors, count(*) FILTER (text IS NOT NULL AND o.b IS NOT NULL AND n.content_hash IS NOT DISTINCT FROM o.content_hash) AS skipped,
    count(*) FILTER (text IS NOT NULL AND (o.b IS NULL OR n.content_hash IS DISTINCT FROM o.content_hash)) AS indexed FROM documents n LEFT JOIN (SELECT *, true AS b FROM old) o ON n.collection = o.collection AND n.path = o.path""")
def index_stats(s, d):
    docs = load(s, d, "documents")
    return indexing.stats(docs, _old(s, d))


@query("done_chunks", "SELECT id, path FROM chunks JOIN documents USING (doc_id) WHERE status = 'done' AND embedding IS NOT NULL")
def done_chunks(s, d):
    chunks = load(s, d, "chunks").filter("status = 'done' and embedding is not null")
    return chunks.select("id", "doc_id").join(load(s, d, "documents").select("doc_id", "path"), "doc_id").select("id", "path")


_CONTEXTS = "SELECT DISTINCT collection, prefix AS path_prefix, 'about ' || prefix AS description, CAST(length(prefix) AS BIGINT) AS priority FROM (SELECT collection, 'docs/' AS prefix FROM documents UNION ALL SELECT collection, 'docs/cache/' FROM documents UNION ALL SELECT collection, 'docs/index/build' FROM documents)"


@query("path_context", f"""WITH contexts AS ({_CONTEXTS}) SELECT doc_id, (SELECT arg_max(description, length(path_prefix)) FROM contexts c WHERE c.collection = documents.collection AND starts_with(path, path_prefix)) AS context FROM documents""")
def path_context(s, d):
    docs = load(s, d, "documents")
    prefixes = F.explode(F.array(*[F.lit(p) for p in ("docs/", "docs/cache/", "docs/index/build")]))
    contexts = docs.select("collection").dropDuplicates().select("collection", prefixes.alias("path_prefix"))
    contexts = contexts.select("*", F.concat(F.lit("about "), F.col("path_prefix")).alias("description"), F.length("path_prefix").cast("long").alias("priority"))
    return indexing.path_context(docs.select("doc_id", "collection", "path"), contexts).select("doc_id", "context")


# -- scans --------------------------------------------------------------------------------


@query("glob_filter", r"""SELECT doc_id FROM documents WHERE (regexp_full_match(path, 'docs/.*\.md') OR regexp_matches(regexp_extract(path, '[^/]*$'), '^load.*$')) AND NOT regexp_full_match(path, '.*cache.*')""")
def glob_filter(s, d):
    return load(s, d, "documents").filter(scan.included(F.col("path"), ["docs/*.md", "load*"], ["*cache*"])).select("doc_id")


_SKIP_SQL = "[" + ", ".join(f"'{x}'" for x in scan.SKIP) + "]"


@query("path_predicates", rf"""SELECT id, list_has_any(string_split(file, '/'), {_SKIP_SQL}) AS skipped, regexp_matches(string_split(file, '/')[1], '^.+-\d+\.\d+') AS plugin, len(string_split(file, '/')) AS depth,
    lower(regexp_extract(file, '\.([^./]+)$', 1)) AS ext FROM symbols""")
def path_predicates(s, d):
    p = F.col("file")
    return load(s, d, "symbols").select("id", scan.skipped(p).alias("skipped"), scan.plugin(p).alias("plugin"), scan.depth(p).alias("depth"), scan.extension(p).alias("ext"))


@query("ext_language", r"""SELECT doc_id, CASE regexp_extract(path, '\.([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'rb' THEN 'ruby' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' WHEN 'groovy' THEN 'groovy' END AS language FROM documents""")
def ext_language(s, d):
    return load(s, d, "documents").select("doc_id", scan.language(F.col("path")).alias("language"))


_ROOTS = "SELECT collection, path, text FROM documents UNION ALL SELECT * FROM (VALUES ('made', 'package.json', '{\"workspaces\": [], \"react\": 1}'), ('made', 'apps/web/index.ts', ''), ('made', 'packages/ui/a.ts', ''), ('made', 'README.md', NULL), ('made', 'Cargo.toml', ''), ('plain', 'apps/web/x', 'Gemfile'), ('plain', 'a/pom.xml', ''), (NULL, 'requirements.txt', ''))"


@query("stack_detect", f"""SELECT collection, coalesce(bool_or(path = 'Cargo.toml'), false) AS rust, coalesce(bool_or(path = 'package.json'), false) AS node, coalesce(bool_or(path = 'package.json' AND contains(text, '"react"')), false) AS react,
    coalesce(bool_or(path = 'Gemfile'), false) AS rails, coalesce(bool_or(path IN ('build.gradle', 'build.gradle.kts', 'pom.xml')), false) AS jvm, coalesce(bool_or(path IN ('requirements.txt', 'pyproject.toml')), false) AS python,
    coalesce(bool_or(path IN ('turbo.json', 'nx.json') OR (path = 'package.json' AND contains(text, '"workspaces"'))), false) AS monorepo, coalesce(bool_or(starts_with(path, 'docs/')), false) AS has_docs, coalesce(bool_or(path IN ('README.md', 'README.rst')), false) AS has_readme,
    CASE WHEN coalesce(bool_or(path IN ('turbo.json', 'nx.json') OR (path = 'package.json' AND contains(text, '"workspaces"'))), false) THEN coalesce(string_agg(DISTINCT nullif(regexp_extract(path, '^((apps|packages)/[^/]+)/', 1), ''), ' ' ORDER BY nullif(regexp_extract(path, '^((apps|packages)/[^/]+)/', 1), '')), '') ELSE '' END AS subprojects FROM (SELECT * FROM ({_ROOTS}) r(collection, path, text)) GROUP BY 1""")
def stack_detect(s, d):
    made = [("made", "package.json", '{"workspaces": [], "react": 1}'), ("made", "apps/web/index.ts", ""), ("made", "packages/ui/a.ts", ""), ("made", "README.md", None), ("made", "Cargo.toml", ""), ("plain", "apps/web/x", "Gemfile"), ("plain", "a/pom.xml", ""), (None, "requirements.txt", "")]
    files = load(s, d, "documents").select("collection", "path", "text").unionByName(s.createDataFrame(made, "collection string, path string, text string"))
    return scan.stack(files, by=["collection"]).withColumn("subprojects", F.array_join("subprojects", " "))


# -- lines --------------------------------------------------------------------------------

_LINES = "CASE WHEN len(l) > 0 AND l[-1] = '' THEN l[1:len(l) - 1] ELSE l END"
_LOGS = f"logs AS (SELECT doc_id, {_LINES} AS rows FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM documents WHERE text IS NOT NULL AND text <> ''))"


def _logs(s, d):
    return load(s, d, "documents").filter("octet_length(text) > 0")


def _filtered(spec):
    return lambda s, d: _logs(s, d).select("doc_id", lines.apply(spec, F.col("text")).alias("out"))


query("line_filter_strip", rf"WITH {_LOGS} SELECT doc_id, array_to_string(list_filter(rows, lambda x: NOT regexp_matches(x, '^\s*$|^#')), chr(10)) AS out FROM logs")(_filtered(lines.Filter(strip_ansi=False, strip=(r"^\s*$", "^#"))))
query("line_filter_keep", rf"WITH {_LOGS} SELECT doc_id, array_to_string(list_filter(rows, lambda x: regexp_matches(x, 'error|FAILED|cache')), chr(10)) AS out FROM logs")(_filtered(lines.Filter(strip_ansi=False, keep=("error", "FAILED|cache"))))
query("line_filter_head_tail", f"WITH {_LOGS} SELECT doc_id, array_to_string(list_concat(rows[1:3], rows[greatest(len(rows) - 1, 1):]), chr(10)) AS out FROM logs")(_filtered(lines.Filter(strip_ansi=False, head=3, tail=2)))
query("line_filter_max", f"WITH {_LOGS} SELECT doc_id, CASE WHEN len(rows) > 5 THEN array_to_string(rows[1:5], chr(10)) || chr(10) || '[... truncado: mostrando 5 de ' || len(rows) || ' linhas]' ELSE array_to_string(rows, chr(10)) END AS out FROM logs")(_filtered(lines.Filter(strip_ansi=False, most=5)))
query("line_filter_width", f"WITH {_LOGS} SELECT doc_id, array_to_string(list_transform(rows, lambda x: left(x, 20)), chr(10)) AS out FROM logs")(_filtered(lines.Filter(strip_ansi=False, width=20)))
query("line_filter_on_empty", f"WITH {_LOGS} SELECT doc_id, CASE WHEN o = '' THEN '(nothing)' ELSE o END AS out FROM (SELECT doc_id, array_to_string(list_filter(rows, lambda x: contains(x, 'panic')), chr(10)) AS o FROM logs)")(_filtered(lines.Filter(strip_ansi=False, keep=("panic",), on_empty="(nothing)")))
query("line_filter_short_circuit", f"WITH {_LOGS} SELECT doc_id, CASE WHEN contains(text, 'cache') THEN 'has cache' ELSE array_to_string(rows, chr(10)) END AS out FROM logs JOIN documents USING (doc_id)")(_filtered(lines.Filter(strip_ansi=False, match=(("cache", "has cache"),))))


_FOLD = f"""list_reduce(list_transform(l, lambda x: {{'done': []::VARCHAR[], 'last': [{{'raw': x, 'norm': {_normal('x')}, 'n': 1}}]}}), lambda a, b: CASE
    WHEN list_contains(list_transform(a.last, lambda e: e.norm), b.last[1].norm) THEN {{'done': a.done, 'last': list_transform(a.last, lambda e, i: CASE WHEN i = len(a.last) + 1 - list_position(list_reverse(list_transform(a.last, lambda f: f.norm)), b.last[1].norm) THEN {{'raw': e.raw, 'norm': e.norm, 'n': e.n + 1}} ELSE e END)}}
    WHEN len(a.last) = 4 THEN {{'done': list_append(a.done, TEXT(a.last[1])), 'last': list_append(a.last[2:4], b.last[1])}} ELSE {{'done': a.done, 'last': list_append(a.last, b.last[1])}} END)"""
_shown = lambda e: f"({e}.raw || CASE WHEN {e}.n > 1 THEN ' (×' || {e}.n || ')' ELSE '' END)"


@query("group_repeated", f"""WITH {_CASES}, {_ROWS}, folded AS (SELECT doc_id, {_FOLD.replace("TEXT(a.last[1])", _shown("a.last[1]"))} AS f FROM rows WHERE len(l) > 0)
    SELECT doc_id, coalesce(array_to_string(list_concat(f.done, list_transform(f.last, lambda e: {_shown("e")})), chr(10)), '') AS out FROM cases LEFT JOIN folded USING (doc_id)""")
def group_repeated(s, d):
    return _cases(s, d).select("doc_id", F.array_join(lines.group_repeated(T.lines(F.col("text"))), "\n").alias("out"))


@query("compress_output")
def compress_output(s, d):
    """Texts by the built-in filter of the command that they are output of; others are kept as they are."""
    logs = _logs(s, d).withColumn("command", lines.command_of(F.col("path"), F.col("text")))
    return lines.compress(logs, "command", "text").select("doc_id", "command", "filter", "filtered")


def _registry_sql() -> str:
    from lodestone.operators.filters import GENERIC, KEYS

    values = lambda t: ", ".join("('{}', '{}')".format(*x) for x in t.items())
    return rf"""WITH k(key, filter) AS (VALUES {values(KEYS)}), g(key, filter) AS (VALUES {values(GENERIC)}),
        w AS (SELECT id, string_split_regex(trim(raw_command, ' '), '\s+') AS words FROM execution_metrics)
        SELECT id, coalesce(k.filter, g.filter) AS filter FROM w LEFT JOIN k ON k.key = words[1] || ' ' || coalesce(words[2], '') LEFT JOIN g ON g.key = words[1]"""


@query("registry_lookup", _registry_sql())
def registry_lookup(s, d):
    from lodestone.operators.filters import GENERIC, KEYS

    return load(s, d, "execution_metrics").select("id", lines.filter_key(F.col("raw_command"), KEYS, GENERIC).alias("filter"))


# -- usage --------------------------------------------------------------------------------


@query("savings_summary", """SELECT count(*) AS executions, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, greatest(sum(input_tokens) - sum(output_tokens), 0)::BIGINT AS saved_tokens,
    round(greatest(sum(input_tokens) - sum(output_tokens), 0) / sum(input_tokens)::DOUBLE * 100, 6) AS savings_percent, sum(execution_time_ms)::BIGINT AS execution_time_ms, (sum(execution_time_ms) // count(*))::BIGINT AS avg_time_ms FROM execution_metrics""")
def savings_summary(s, d):
    return usage.summary(load(s, d, "execution_metrics")).withColumn("savings_percent", F.round("savings_percent", 6))


_BY_COMMAND = """SELECT command_name, count(*) AS executions, sum(coalesce(input_tokens, 0) - coalesce(output_tokens, 0))::BIGINT AS saved_tokens,
    round(avg(CASE WHEN input_tokens > 0 THEN (input_tokens - coalesce(output_tokens, 0)) * 100.0 / input_tokens::DOUBLE ELSE 0 END), 6) AS avg_percent, coalesce(sum(execution_time_ms), 0)::BIGINT AS execution_time_ms FROM execution_metrics {0} GROUP BY 1"""


@query("savings_by_command", _BY_COMMAND.format(""))
def savings_by_command(s, d):
    return usage.by_command(load(s, d, "execution_metrics")).withColumn("avg_percent", F.round("avg_percent", 6))


@query("savings_by_day", "SELECT CAST(timestamp AS DATE) AS day, count(*) AS executions, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(input_tokens, 0) - coalesce(output_tokens, 0))::BIGINT AS saved_tokens FROM execution_metrics GROUP BY 1")
def savings_by_day(s, d):
    return usage.by_day(load(s, d, "execution_metrics"))


@query("savings_project", _BY_COMMAND.format("WHERE project_path = '/work/repos/platform-mono'"))
def savings_project(s, d):
    return usage.by_command(usage.executions(load(s, d, "execution_metrics"), "/work/repos/platform-mono")).withColumn("avg_percent", F.round("avg_percent", 6))


@query("savings_last_days", _BY_COMMAND.format(f"WHERE CAST(timestamp AS DATE) >= DATE '{FIXED}' - 30"))
def savings_last_days(s, d):
    return usage.by_command(usage.executions(load(s, d, "execution_metrics"), days=30, today=FIXED)).withColumn("avg_percent", F.round("avg_percent", 6))


@query("savings_report", """WITH t AS (SELECT count(*) AS n, coalesce(sum(input_tokens), 0)::BIGINT AS i, coalesce(sum(output_tokens), 0)::BIGINT AS o FROM execution_metrics),
    c AS (SELECT command_name, count(*) AS n, sum(coalesce(input_tokens, 0) - coalesce(output_tokens, 0))::BIGINT AS saved, avg(CASE WHEN input_tokens > 0 THEN (input_tokens - coalesce(output_tokens, 0)) * 100.0 / input_tokens::DOUBLE ELSE 0 END) AS percent FROM execution_metrics GROUP BY 1)
    SELECT 0 AS n, 'Commands run: ' || n AS line FROM t UNION ALL SELECT 1, 'Tokens before: ' || i FROM t UNION ALL SELECT 2, 'Tokens after: ' || o FROM t UNION ALL SELECT 3, 'Tokens saved: ' || greatest(i - o, 0) FROM t
    UNION ALL SELECT 4, 'Mean saving: ' || printf('%.1f', greatest(i - o, 0) / i::DOUBLE * 100) || '%' FROM t
    UNION ALL SELECT 4 + row_number() OVER (ORDER BY saved DESC, command_name NULLS FIRST), '  ' || rpad(coalesce(command_name, '-'), 30, ' ') || ' ' || printf('%5d', n) || 'x  -' || saved || ' tokens (' || printf('%.0f', percent) || '%)' FROM c""")
def savings_report(s, d):
    metrics = load(s, d, "execution_metrics")
    return usage.report(usage.summary(metrics), usage.by_command(metrics))


@query("recorded_usage", """SELECT id, raw_output_size // 4 AS input_tokens, filtered_output_size // 4 AS output_tokens, CASE WHEN raw_output_size // 4 > filtered_output_size // 4 THEN raw_output_size // 4 - filtered_output_size // 4 WHEN raw_output_size IS NULL OR filtered_output_size IS NULL THEN NULL ELSE 0 END AS saved_tokens FROM execution_metrics""")
def recorded_usage(s, d):
    return usage.record(load(s, d, "execution_metrics")).select("id", "input_tokens", "output_tokens", "saved_tokens")


# -- graph --------------------------------------------------------------------------------

_SITE = "concat_ws(':', file, CAST(line AS VARCHAR))"
_KIND = "CASE WHEN kind IN ('function', 'method') THEN 1.0 WHEN kind IN ('class', 'struct', 'trait', 'interface', 'enum') THEN 0.95 ELSE 0.85 END"


def _nodes_sql(condition: str, by: str, simple: bool) -> str:
    name = "string_split(key, '::')[-1]" if simple else "key"
    return f"""g AS (SELECT {by} AS key, count(*) AS sites, sum(strlen({_SITE})) AS site_bytes FROM calls WHERE {condition} AND {by} IS NOT NULL GROUP BY 1),
    a AS (SELECT *, {name} AS name FROM g),
    first AS (SELECT name, arg_min({{'qualified': qualified, 'kind': kind}}, id) AS f FROM symbols GROUP BY 1),
    own AS (SELECT qualified, name, arg_min({{'qualified': qualified, 'kind': kind}}, id) AS o FROM symbols GROUP BY ALL),
    r AS (SELECT key, sites, site_bytes, a.name, coalesce(o.qualified, f.qualified, key) AS qualified, coalesce(o.kind, f.kind, 'function') AS kind FROM a LEFT JOIN first ON first.name = a.name LEFT JOIN own ON own.qualified = a.key AND own.name = a.name),
    n AS (SELECT key, qualified, kind, sites, (1 + greatest(log2(sites), 0) + CASE WHEN contains(lower(name), 'build') THEN 5 WHEN contains(lower(qualified), 'build') THEN 2 ELSE 0 END) * {_KIND} AS score, (strlen(qualified) + site_bytes + 32) // 4 AS cost FROM r)"""


def _nodes(df):
    return df.select("key", "qualified", "kind", "sites", F.round("score", 6).alias("score"))


@query("graph_callers", f"WITH {_nodes_sql("callee_name = 'get'", 'caller_qualified', True)} SELECT key, qualified, kind, sites, round(score, 6) AS score FROM n")
def graph_callers(s, d):
    return _nodes(graph.callers(load(s, d, "calls"), load(s, d, "symbols"), "get", ["build"]))


@query("graph_callees", f"WITH {_nodes_sql("caller_qualified = 'dist/bundle.generated.js::<top>'", 'callee_name', False)} SELECT key, qualified, kind, sites, round(score, 6) AS score FROM n")
def graph_callees(s, d):
    return _nodes(graph.callees(load(s, d, "calls"), load(s, d, "symbols"), "dist/bundle.generated.js::<top>", ["build"]))


@query("graph_budget", f"""WITH {_nodes_sql("callee_name = 'get'", 'caller_qualified', True)}, c AS (SELECT *, sum(cost) OVER (ORDER BY score DESC, key) AS used FROM (SELECT * REPLACE (round(score, 9) AS score) FROM n))
    SELECT key, qualified, kind, sites, round(score, 6) AS score FROM c WHERE used <= 4000""")
def graph_budget(s, d):
    return _nodes(graph.callers(load(s, d, "calls"), load(s, d, "symbols"), "get", ["build"], 4000))


@query("graph_result", f"""WITH {_nodes_sql("callee_name = 'get'", 'caller_qualified', True)}, c AS (SELECT *, sum(cost) OVER (ORDER BY score DESC, key) AS used FROM (SELECT * REPLACE (round(score, 9) AS score) FROM n))
    SELECT (SELECT count(*) FROM calls WHERE callee_name = 'get' AND caller_qualified IS NOT NULL) AS total_found, count(*) AS nodes, count(*) < (SELECT count(*) FROM calls WHERE callee_name = 'get' AND caller_qualified IS NOT NULL) AS truncated FROM c WHERE used <= 4000""")
def graph_result(s, d):
    """Total and truncation of graph_budget."""
    calls = load(s, d, "calls")
    kept = graph.callers(calls, load(s, d, "symbols"), "get", ["build"], 4000)
    return graph.totals(calls, F.col("callee_name") == "get", "caller_qualified", kept)


@query("graph_node", "SELECT id, qualified, kind, file, line FROM symbols WHERE name = 'decode_target'")
def graph_node(s, d):
    return graph.node(load(s, d, "symbols"), "decode_target").select("id", "qualified", "kind", "file", "line")


@query("graph_call_scan", "SELECT id, caller_qualified, file, line FROM calls WHERE callee_name = 'get'")
def graph_call_scan(s, d):
    return load(s, d, "calls").filter("callee_name = 'get'").select("id", "caller_qualified", "file", "line")


@query("graph_stats", "SELECT count(DISTINCT file) AS files, count(*) AS symbols FROM symbols")
def graph_stats(s, d):
    return load(s, d, "symbols").agg(F.count_distinct("file").alias("files"), F.count("*").alias("symbols"))


_LEVEL = "SELECT {0} AS level, target, caller_qualified AS key, count(*) AS sites FROM calls JOIN {1} f ON callee_name = f.target WHERE caller_qualified IS NOT NULL GROUP BY ALL"
_TRACE = f"""f1 AS (SELECT 'read_chunk' AS target), l1 AS ({_LEVEL.format(1, 'f1')}),
    f2 AS (SELECT DISTINCT string_split(key, '::')[-1] AS target FROM l1 EXCEPT SELECT target FROM f1), l2 AS ({_LEVEL.format(2, 'f2')}),
    f3 AS (SELECT DISTINCT string_split(key, '::')[-1] AS target FROM l2 EXCEPT (SELECT target FROM f1 UNION SELECT target FROM f2)), l3 AS ({_LEVEL.format(3, 'f3')})"""


@query("graph_trace", f"WITH {_TRACE} SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3")
def graph_trace(s, d):
    return graph.trace(load(s, d, "calls"), "read_chunk", 3).select("level", "target", "key", "sites")


@query("graph_impact", f"WITH {_TRACE} SELECT * FROM l1 UNION ALL SELECT * FROM l2")
def graph_impact(s, d):
    return graph.impact(load(s, d, "calls"), "read_chunk").select("level", "target", "key", "sites")


@query("asof_enclosing", """WITH d AS (SELECT file, line, arg_max(qualified, id) AS qualified FROM symbols WHERE file IS NOT NULL AND line IS NOT NULL GROUP BY ALL)
    SELECT c.id, coalesce(d.qualified, c.file || '::<top>') AS caller FROM (SELECT * FROM calls WHERE file IS NOT NULL AND line IS NOT NULL) c ASOF LEFT JOIN d ON c.file = d.file AND c.line >= d.line""")
def asof_enclosing(s, d):
    defs = load(s, d, "symbols").filter("file is not null and line is not null").select("file", "line", F.col("id").alias("ord"), "qualified")
    sites = load(s, d, "calls").filter("file is not null and line is not null").select("id", "file", "line")
    return graph.enclosing(defs, sites).select("id", F.col("caller_qualified").alias("caller"))


_EDGES = """edges AS (SELECT r.file AS src, s.file AS dst, sum(r.n * s.n) AS w FROM (SELECT file, callee_name AS name, count(*) AS n FROM calls WHERE file IS NOT NULL AND callee_name IS NOT NULL GROUP BY ALL) r
    JOIN (SELECT file, name, count(*) AS n FROM symbols WHERE file IS NOT NULL AND name IS NOT NULL GROUP BY ALL) s USING (name) WHERE r.file <> s.file GROUP BY ALL),
    files AS (SELECT DISTINCT file FROM (SELECT file FROM calls UNION ALL SELECT file FROM symbols) WHERE file IS NOT NULL)"""


def _file_parts(s, d):
    refs = load(s, d, "calls").filter("file is not null and callee_name is not null").select("file", F.col("callee_name").alias("name"))
    defs = load(s, d, "symbols").filter("file is not null and name is not null").select("file", "name")
    nodes = refs.select("file").unionByName(defs.select("file")).dropDuplicates()
    return graph.personalization(nodes, "file"), refs, defs


def _rank_sql(k: int) -> str:
    steps = ["out AS (SELECT src, sum(w) AS o FROM edges GROUP BY 1)", "size AS (SELECT count(*)::DOUBLE AS n FROM files)", "x0 AS (SELECT file, 1 / n AS x FROM files, size)"]
    for i in range(1, k + 1):
        steps.append(f"""x{i} AS (SELECT f.file, 0.85 * coalesce(y, 0) + 0.85 * (SELECT coalesce(sum(x), 0) FROM x{i - 1} WHERE file NOT IN (SELECT src FROM out)) / n + 0.15 / n AS x
            FROM files f CROSS JOIN size LEFT JOIN (SELECT dst, sum(x * w / o) AS y FROM edges JOIN out USING (src) JOIN x{i - 1} ON x{i - 1}.file = src GROUP BY 1) ON dst = f.file)""")
    return f"WITH {_EDGES}, {', '.join(steps)} SELECT file, round(x, 8) AS rank FROM x{k}"


@query("pagerank_3", _rank_sql(3))
def pagerank_3(s, d):
    nodes, refs, defs = _file_parts(s, d)
    ranks = graph.file_rank(nodes, refs, defs, iterations=3, tolerance=None)
    return ranks.select(F.col("node").alias("file"), F.round("rank", 8).alias("rank"))


@query("pagerank")
def pagerank(s, d):
    """Converged, personalized by the five best files for the fixed query (by path and symbols) and the seed folders."""
    nodes, refs, defs = _file_parts(s, d)
    names = defs.dropDuplicates().groupBy("file").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("names"))
    texts = nodes.select(F.col("node").alias("file")).join(names, "file", "left").select("file", F.concat_ws(" ", "file", "names").alias("text"))
    best = [r.file for r in lexical.bm25(texts, "file", {"q": QUERY}).orderBy(F.desc(F.round("score", 9)), "file").limit(5).collect()]
    ranks = graph.file_rank(graph.personalization(nodes, "node", best, SEEDS), refs, defs)
    return ranks.select(F.col("node").alias("file"), "rank")


# -- extraction and maps ------------------------------------------------------------------


@query("source_signatures")
def source_signatures(s, d):
    return extract.signatures(load(s, d, "documents")).select("path", F.array_join("sigs", "\n").alias("sigs"), F.array_join("refs", " ").alias("refs"))


@query("source_definitions")
def source_definitions(s, d):
    return extract.definitions(load(s, d, "documents"))


@query("source_calls")
def source_calls(s, d):
    return extract.calls(load(s, d, "documents"))


@query("source_imports")
def source_imports(s, d):
    return extract.imports(load(s, d, "documents"))


@query("routes")
def routes(s, d):
    return extract.routes(load(s, d, "documents"))


@query("route_symbols")
def route_symbols(s, d):
    return extract.route_symbols(routes(s, d))


@query("repo_map_budget", f"""WITH {DOCS}, {_bm25_sql(extra=", path")},
    f AS (SELECT e.doc_id, e.path, round(score, 6) AS score, strlen(e.path) + 11 + strlen(string_split(text, chr(10))[1]) + 4 AS bytes FROM everything e JOIN documents USING (doc_id) WHERE score > 0 AND text <> ''),
    c AS (SELECT *, sum(bytes) OVER (ORDER BY score DESC, path, doc_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (ORDER BY score DESC, path, doc_id) AS r FROM f)
    SELECT path, score, used::BIGINT AS used FROM c WHERE (23 + used) // 4 <= 2000 OR r = 1""")
def repo_map_budget(s, d):
    """The budget alone, over first lines, so that SQL can check it."""
    return repomap.fit(_map_files(s, d), 2000).select("path", "score", "used")


def _map_files(s, d):
    docs = load(s, d, "documents")
    scored = lexical.bm25(docs, "doc_id", {"q": QUERY})
    files = docs.filter("octet_length(text) > 0").select("doc_id", "path", F.array(F.substring_index("text", "\n", 1)).alias("sigs"))
    return files.join(scored, "doc_id").select("path", "sigs", F.round("score", 6).alias("score"))


@query("repo_map_files")
def repo_map_files(s, d):
    ranked = repomap.by_words(repomap.corpus(load(s, d, "documents")), QUERY)
    return repomap.fit(ranked, 2000).select("path", "score", "used")


@query("repo_map_ranked")
def repo_map_ranked(s, d):
    ranked = repomap.by_graph(repomap.corpus(load(s, d, "documents")), QUERY, SEEDS)
    return repomap.fit(ranked, 2000).select("path", "score", "used")


@query("repo_map_text")
def repo_map_text(s, d):
    return repomap.text_map(repomap.fit(repomap.by_words(repomap.corpus(load(s, d, "documents")), QUERY), 500))


@query("repo_map_json")
def repo_map_json(s, d):
    return repomap.json_map(repomap.fit(repomap.by_words(repomap.corpus(load(s, d, "documents")), QUERY), 500))


# -- tables -------------------------------------------------------------------------------


@query("upsert_merge", f"""WITH {_OLD} SELECT collection, path, content_hash FROM documents UNION ALL SELECT collection, path, content_hash FROM old ANTI JOIN documents USING (collection, path)""")
def upsert_merge(s, d):
    new = load(s, d, "documents").select("collection", "path", "content_hash")
    return tables.upsert(_old(s, d), new, ["collection", "path"])


@query("first_wins", "SELECT id, qualified FROM symbols WHERE qualified IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qualified ORDER BY id) = 1")
def first_wins(s, d):
    return tables.first_wins(load(s, d, "symbols").filter("qualified is not null").select("id", "qualified"), "qualified", "id")


@query("refresh_files", "SELECT id, file FROM calls WHERE file IS NOT NULL AND file NOT IN (SELECT file FROM symbols WHERE file LIKE 'src/%') UNION ALL SELECT id, file FROM symbols WHERE file LIKE 'src/%'")
def refresh_files(s, d):
    new = load(s, d, "symbols").filter("file like 'src/%'").select("id", "file")
    return tables.refresh(load(s, d, "calls").filter("file is not null").select("id", "file"), new, "file")


@query("retention", f"SELECT id FROM execution_metrics WHERE CAST(timestamp AS DATE) >= DATE '{FIXED}' - 30")
def retention(s, d):
    return tables.recent(load(s, d, "execution_metrics"), "timestamp", 30, FIXED).select("id")


@query("cache_misses", "SELECT DISTINCT sha256(concat_ws('|', collection, path)) AS key FROM documents WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.collection = documents.collection AND s.path = documents.path)")
def cache_misses(s, d):
    key = tables.cache_key(F.col("collection"), F.col("path")).alias("key")
    asked, cache = load(s, d, "documents").select(key).dropDuplicates(), load(s, d, "snapshots").select(key).dropDuplicates()
    return tables.lookup(asked, cache, ["key"])[1]
