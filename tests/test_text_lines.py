import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import lines
from lodestone.operators.filters import FILTERS, GENERIC, KEYS


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_tokens(spark):
    rows = {"getUserName": ["get", "user", "name"], "HTTPServer2 ok": ["http", "server2"], "snake_case_Name": ["snake", "case", "name"], "": [], "über 1234": ["ber", "1234"]}
    got = spark.createDataFrame(list(rows.items()), "x string, y array<string>").select("x", T.tokenize("x").alias("t"), T.sorted_tokens("x").alias("s")).collect()
    for r in got:
        assert r.t == rows[r.x] and r.s == sorted(rows[r.x])
    assert one(spark, T.tokenize(F.col("x"))) is None


def python_groups(rows):
    out = []
    for line in rows:
        norm = line
        for p, by in T.LOG_TOKENS:
            norm = re.sub(p, by, norm)
        for e in reversed(out[-4:]):
            if e[1] == norm:
                e[2] += 1
                break
        else:
            out.append([line, norm, 1])
    return [raw if n == 1 else f"{raw} (×{n})" for raw, _, n in out]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["a 2024-01-01 10:00:00", "a 2024-01-02 11:00:01", "b 123456", "b 654321", "c", "d", "e", "f"]), max_size=40))
def test_group_repeated(spark, rows):
    assert one(spark, lines.group_repeated(F.col("x")), rows, "array<string>") == python_groups(rows)


def test_repeated_by_five(spark):
    rows = [f"2024-01-01 10:00:0{i} tick" for i in range(5)]
    assert one(spark, lines.group_repeated(F.col("x")), rows, "array<string>") == [rows[0] + " (×5)"]


def test_all_filters_run(spark):
    text = "commit abc\nMerge: 1 2\n\ncommit def\nAuthor: x\n   To x\n  a -> b\n\x1b[31mFAILED\x1b[0m test\n" + "z" * 5000
    for value in (text, "", None):
        df = spark.createDataFrame([(value,)], "x string").select(*[lines.apply(s, F.col("x")).alias(n.replace("::", "_")) for n, s in FILTERS.items()])
        row = df.first().asDict()
        assert all(v is None for v in row.values()) if value is None else all(isinstance(v, str) and "\x1b" not in v for v in row.values())
    assert set(KEYS.values()) | set(GENERIC.values()) <= set(FILTERS)


def test_preprocess(spark):
    assert one(spark, lines.git_log(F.col("x")), "commit a\nx\ncommit b\nMerge: 1 2\ncommit c\ny") == "commit a\nx\ncommit c\ny"
    assert one(spark, lines.push_to_ok(F.col("x")), "To x\n  1..2 main -> main") == "ok 1..2 main -> main"
    assert one(spark, lines.commit_to_ok(F.col("x")), "[main abc1234] Fix it\n 1 file") == "ok abc1234 main: Fix it"
    assert one(spark, lines.commit_to_ok(F.col("x")), "[main abc123] six digits") == "[main abc123] six digits"
    quoted = "commit a\n\n    Merge branch 'x'\ncommit b\nMerge branch x\n"
    assert one(spark, lines.git_log(F.col("x")), quoted) == "commit a\n\n    Merge branch 'x'\n"
    assert one(spark, lines.unwrap_types(F.col("x")), '{"S" : "a"} {"N": "x"}') == '"a" {"N": "x"}'
    assert one(spark, lines.unwrap_types(F.col("x")), '{"a": {"S": "v"}, "b": {"N": "3"}, "c": {"NULL": true}}') == '{"a": "v", "b": 3, "c": null}'
    policy = '{\n"PolicyDocument": {\n"a": {\n}\n},\n"b": 1\n}'
    inline = 'x\n  "PolicyDocument": {"a": {}},\ny "PolicyDocument": {\n'
    assert one(spark, lines.strip_policies(F.col("x")), inline) == 'x\n  "PolicyDocument": "<policy>",\ny "PolicyDocument": {'
    assert one(spark, lines.strip_policies(F.col("x")), policy) == '{\n"PolicyDocument": "<policy>",\n"b": 1\n}'


def test_stages(spark):
    f = lambda spec, text: one(spark, lines.apply(spec, F.col("x")), text)
    assert f(lines.Filter(head=2, tail=2), "a\nb\nc\n") == "a\nb\nb\nc"
    assert f(lines.Filter(most=2), "a\nb\nc") == "a\nb\n[... truncado: mostrando 2 de 3 linhas]"
    assert f(lines.Filter(match=(("up-to-date", "ok"),)), "all up-to-date") == "ok"
    excepted = lines.Filter(match=(("ok", "fine", "WARNING"), ("WARN", "warned")))
    assert f(excepted, "ok") == "fine" and f(excepted, "ok WARNING") == "warned" and f(lines.Filter(match=(("ok", "fine", "no"),)), "ok no") == "ok no"
    assert f(lines.Filter(), "a\x07b\x1b]0;t\x07") == "ab"
    assert f(lines.Filter(keep=("x",), on_empty="(none)"), "a\nb") == "(none)"
    assert f(lines.Filter(replacements=(("a+", "b"),)), "caat") == "cbt"


def test_registry(spark):
    rows = spark.createDataFrame([("git push origin",), ("git frob",), ("nope x",), ("",), (None,)], "c string")
    assert [r.f for r in rows.select(lines.filter_key(F.col("c"), KEYS, GENERIC).alias("f")).collect()] == ["git::push", "git::generic", None, None, None]
    out = lines.compress(spark.createDataFrame([("git add x", ""), ("nope", "kept")], "command string, text string"), "command", "text").collect()
    assert [r.filtered for r in out] == ["ok", "kept"]
