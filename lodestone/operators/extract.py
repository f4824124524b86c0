"""Signatures, references, definitions, calls and routes from source texts.

Source code needs a parser, so these run as Python over Arrow batches: the ``ast`` module
for Python, line patterns for the other languages. Malformed code gives what was
recognised (Python that doesn't parse is read by statements, the broken ones by lines);
null and empty texts give nothing.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from keyword import iskeyword

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scan import language

# -- signatures ---------------------------------------------------------------------------


Found = tuple[list[str], list[str], list[tuple], list[tuple], list[tuple]]
_BROKEN = (SyntaxError, ValueError, RecursionError, MemoryError)


def _params(node: ast.FunctionDef | ast.AsyncFunctionDef, code: str) -> str:
    try:
        return f"({ast.unparse(node.args)})"
    except RecursionError:
        rest = "\n".join(code.split("\n")[node.lineno - 1 :])
        m = _PY_DEF.search(rest)
        return _bracket(rest, _quiet(rest), m.end() - 1) if m else "()"


def _tree(code: str) -> tuple[ast.AST, int] | None:
    """Tree and the lines put before the code; code that is indented as a whole is read as a block."""
    for before in ("", "if 1:\n"):
        try:
            return ast.parse(before + code), bool(before)
        except _BROKEN:
            pass
    return None


def _python(code: str) -> Found:
    """By Python's parser; if it rejects the file, each statement of the top level for itself,
    and by lines only those that it rejects."""
    code = code.removeprefix("\ufeff").replace("\0", "").replace("\r\n", "\n").replace("\r", "\n")
    if (whole := _tree(code)) is not None:
        return _by_tree(code, *whole)
    found: Found = [], [], [], [], []
    for first, block in _blocks(code):
        tree = _tree(block)
        part = _by_tree(block, *tree) if tree else _python_lines(block)
        for all_rows, rows in zip(found, part):
            all_rows.extend(rows if rows and isinstance(rows[0], str) else [(*r[:-1], r[-1] + first) for r in rows])
    return found


def _by_tree(code: str, tree: ast.AST, before: int) -> Found:
    sigs, refs, defs, calls, imports = [], [], [], [], []
    stack = [(ast.iter_child_nodes(tree), 0, False)]  # no recursion: long expressions are deep trees
    while stack:
        children, depth, inside = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            continue
        line = getattr(child, "lineno", 0) - before
        below = depth, inside and isinstance(child, (ast.If, ast.Try, ast.With))
        if isinstance(child, ast.ClassDef):
            sigs.append("  " * depth + f"class {child.name}")
            defs.append((child.name, "class", line))
            below = depth + 1, True
        elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
            sigs.append("  " * depth + f"  def {child.name}{_params(child, 'if 1:' + chr(10) + code if before else code)}")
            defs.append((child.name, "method" if inside else "function", line))
            below = depth, False
        elif isinstance(child, ast.Import):
            names = [a.name for a in child.names]
            refs.extend(n.rsplit(".", 1)[-1] for n in names)
            imports.extend((n, line) for n in names)
        elif isinstance(child, ast.ImportFrom):
            refs.extend(a.name for a in child.names)
            imports.append((child.module or "." * child.level, line))
        elif isinstance(child, ast.Call):
            name = child.func.attr if isinstance(child.func, ast.Attribute) else getattr(child.func, "id", None)
            if name:
                calls.append((name, line))
        stack.append((ast.iter_child_nodes(child), *below))
    return sigs, refs, defs, calls, imports


#: Strings and comments; f-strings are kept, as they may hold calls.
_PY_QUIET = re.compile(r"""#[^\n]*|(?<!\w)([A-Za-z]{0,2})(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')""")
_PY_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*(?:\[[^\]\n]*\])?[ \t]*\(", re.M)
_PY_CLASS = re.compile(r"^([ \t]*)class[ \t]+(\w+)", re.M)
_PY_IMPORT = re.compile(r"(?:^|;)[ \t]*(?:from[ \t]+(\.*)[ \t]*([\w.]*)[ \t]+import[ \t]*(\([^)]*\)?|[^;\n]+)|import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*))", re.M)
_PY_CALL = re.compile(r"(?<!\w)(?:(def|class|function)\s+)?([^\W\d]\w*)[ \t]*(?:\[[^\]\n]*\][ \t]*)?\(")
#: A line that goes on with the statement before it.
_PY_ON = re.compile(r"[ \t#)\]}]|(?:else|elif|except|finally)\b|$")


def _blocks(code: str) -> Iterator[tuple[int, str]]:
    """Statements of the top level with the number of lines before each; decorators stay with what follows."""
    lines, start = code.split("\n"), 0
    decorated = False
    for i, line in enumerate(lines):
        if _PY_ON.match(line):
            continue
        if i > start and not decorated:
            yield start, "\n".join(lines[start:i])
            start = i
        decorated = line.startswith("@")
    yield start, "\n".join(lines[start:])


def _quiet(code: str) -> str:
    """Blanks for strings, comments and line continuations; every character keeps its place."""
    return _PY_QUIET.sub(lambda m: m[0] if "f" in (m[1] or "").lower() else re.sub(r"[^\n]", " ", m[0]), code).replace("\\\n", "  ")


def _bracket(code: str, quiet: str, at: int) -> str:
    """The bracket that opens at ``at``, in one line, up to its end or that of the line where it is never closed."""
    depth = 0
    for m in re.compile(r"[()]").finditer(quiet, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return re.sub(r"\s*\n\s*", " ", code[at : m.end()])
    return code[at:].split("\n", 1)[0].rstrip(" \t:")


def _python_lines(code: str) -> Found:
    """What line patterns recognise in Python that doesn't parse; columns tell what is inside a class."""
    sigs, refs, defs, calls, imports = [], [], [], [], []
    quiet = _quiet(code)
    starts = [0, *[m.end() for m in re.finditer("\n", code)]]
    number = lambda at: bisect_right(starts, at)
    outer: list[tuple[int, bool]] = []
    for at, m in sorted((m.start(2), m) for p in (_PY_DEF, _PY_CLASS) for m in p.finditer(quiet)):
        column, is_class = len(m[1].expandtabs()), m.re is _PY_CLASS
        while outer and outer[-1][0] >= column:
            outer.pop()
        depth, inside = sum(c for _, c in outer), bool(outer) and outer[-1][1]
        if is_class:
            sigs.append("  " * depth + f"class {m[2]}")
        else:
            params = _bracket(code, quiet, m.end() - 1)
            try:
                params = f"({ast.unparse(ast.parse(f'def _{params}: pass').body[0].args)})"
            except _BROKEN:
                pass
            sigs.append("  " * depth + f"  def {m[2]}{params}")
        defs.append((m[2], "class" if is_class else "method" if inside else "function", number(at)))
        outer.append((column, is_class))
    for m in _PY_IMPORT.finditer(quiet):
        line = number(m.end(0) - len(m[0].lstrip("; \t")))
        if m[4]:
            names = [n.split()[0] for n in m[4].split(",")]
            refs.extend(n.rsplit(".", 1)[-1] for n in names)
            imports.extend((n, line) for n in names)
        elif m[1] or m[2]:
            refs.extend(re.findall(r"(?:^|,)\s*(\w+|\*)", m[3].strip("()")))
            imports.append((m[2] or m[1], line))
    calls.extend((m[2], number(m.start(2))) for m in _PY_CALL.finditer(quiet) if not m[1] and not iskeyword(m[2]))
    return sigs, refs, defs, calls, imports


_WORD = r"[A-Za-z_$][\w$]*"
#: Brackets with up to two levels of brackets in them, else what is between the first two.
_ARGS = r"(?:\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)|\([^)]*\))"
#: Per language: (pattern over a line, kind, signature). Groups are inserted by number; trailing braces are cut.
_RULES: dict[str, list[tuple[re.Pattern, str, str]]] = {
    lang: [(re.compile(p.replace(r"\([^)]*\)", _ARGS)), kind, sig) for p, kind, sig in rules]
    for lang, rules in {
        "typescript": [
            (rf"^\s*(?:export\s+)?(?:declare\s+)?interface\s+({_WORD})", "interface", "interface {1}"),
            (rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_WORD})", "class", "class {1}"),
            (rf"^\s*(?:export\s+)?type\s+({_WORD})[^=]*=", "type", "type {1}"),
            (rf"^\s*(?:export\s+)?enum\s+({_WORD})", "enum", "enum {1}"),
            (rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_WORD})\s*(?:<[^>]*>)?(\([^)]*\))", "function", "function {1}{2}"),
            (rf"^\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?!(?:if|for|while|switch|catch|return|function|new)\b)({_WORD})\s*(?:<[^>]*>)?(\([^)]*\))\s*(?::\s*[^{{;=]+)?\s*\{{", "method", "function {1}{2}"),
        ],
        "javascript": [
            (rf"^\s*(?:export\s+)?(?:default\s+)?class\s+({_WORD})", "class", "class {1}"),
            (rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_WORD})\s*(\([^)]*\))", "function", "function {1}{2}"),
            (rf"^\s*(?:export\s+)?(?:const|let|var)\s+({_WORD})\s*=\s*(?:async\s+)?(?:\([^)]*\)|{_WORD})\s*=>", "function", "const {1} = ..."),
            (rf"^\s*(?:export\s+)?(?:const|let|var)\s+({_WORD})\s*=\s*(?:async\s+)?function", "function", "const {1} = ..."),
            (rf"^\s+(?:(?:static|async|get|set)\s+)*(?!(?:if|for|while|switch|catch|return|function|new)\b)({_WORD})\s*(\([^)]*\))\s*\{{", "method", "{1}{2}"),
        ],
        "ruby": [
            (r"^\s*class\s+([A-Z][\w:]*)", "class", "class {1}"),
            (r"^\s*module\s+([A-Z][\w:]*)", "function", "module {1}"),
            (r"^\s*def\s+self\.([\w?!=]+)\s*(\([^)]*\))?", "method", "def self.{1}{2}"),
            (r"^\s*def\s+([\w?!=\[\]+*<>-]+)\s*(\([^)]*\))?", "method", "def {1}{2}"),
            (r"^\s*((?:has_many|has_one|belongs_to|has_and_belongs_to_many|validates|validate|scope|before_action|after_action|delegate|attr_accessor)\b.*)$", "", "{1}"),
        ],
        "groovy": [
            (rf"^\s*(?:(?:abstract|final|public|private|protected|static)\s+)*class\s+({_WORD})", "class", "class {1}"),
            (rf"^\s*(?:public\s+)?interface\s+({_WORD})", "interface", "interface {1}"),
            (rf"^\s*enum\s+({_WORD})", "enum", "enum {1}"),
            (rf"^\s*(?:(?:public|private|protected|static|final)\s+)*(?:def|void|[A-Z]\w*(?:<[^>]*>)?|int|long|boolean)\s+({_WORD})\s*(\([^)]*\))\s*\{{", "method", "def {1}{2}"),
            (rf"^\s+(?:static\s+|final\s+)*(def|[A-Z]\w*(?:<[^>]*>)?|int|long|boolean)\s+({_WORD})\s*(?:=.*)?$", "", "{1} {2}"),
        ],
        "rust": [
            (r"^\s*((?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern\s+\"C\")\s+)*fn\s+)(\w+)(\s*(?:<[^>]*>)?\([^)]*\)(?:\s*->\s*[^{;]+)?)", "function", "{1}{2}{3}"),
            (r"^\s*((?:pub(?:\([^)]*\))?\s+)?struct\s+)(\w+)", "struct", "{1}{2}"),
            (r"^\s*((?:pub(?:\([^)]*\))?\s+)?enum\s+)(\w+)", "enum", "{1}{2}"),
            (r"^\s*((?:pub(?:\([^)]*\))?\s+)?trait\s+)(\w+)", "trait", "{1}{2}"),
            (r"^\s*(impl\b[^{]*)\{", "", "{1}"),
            (r"^\s*((?:pub(?:\([^)]*\))?\s+)?mod\s+)(\w+)", "module", "{1}{2}"),
        ],
        "java": [
            (r"^\s*(?:(?:public|private|protected|static|abstract|final|sealed)\s+)*class\s+(\w+)", "class", "class {1}"),
            (r"^\s*(?:(?:public|private|protected|static)\s+)*interface\s+(\w+)", "interface", "interface {1}"),
            (r"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+(\w+)", "enum", "enum {1}"),
            (r"^\s+((?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*)(?!\s*(?:return|new|throw|else|if|for|while|switch)\b)([\w<>\[\]][\w<>\[\],.? ]*?)\s+(\w+)(\([^)]*\))\s*(?:throws [\w, .]+)?[{;]", "method", "{1}{2} {3}{4}"),
            (r"^\s+(?:public|private|protected)\s+([A-Z]\w*)(\([^)]*\))\s*(?:throws [\w, .]+)?\{", "method", "{1}{2}"),
        ],
        "go": [
            (r"^func\s+\([^)]*\)\s*(\w+)\s*(\([^)]*\))", "method", "func {1}{2}"),
            (r"^func\s+(\w+)\s*(\([^)]*\))", "function", "func {1}{2}"),
            (r"^type\s+(\w+)\s+struct", "struct", "type {1} struct"),
            (r"^type\s+(\w+)\s+interface", "interface", "type {1} interface"),
        ],
    }.items()
}
_RULES["tsx"] = _RULES["typescript"]
_NAME_GROUP = {"rust": 2}
_CALL = re.compile(r"(?<![\w$])(?:new\s+)?([A-Za-z_$][\w$]*)\s*\(")
_NOT_CALLED = set("if for while switch catch return function def class fn match elsif unless and or not new super func typeof sizeof await".split())
_IMPORT = {
    "typescript": re.compile(r"^\s*import\b.*?from\s+['\"]([^'\"]+)['\"]"),
    "javascript": re.compile(r"(?:^\s*import\b.*?from\s+|require\()['\"]([^'\"]+)['\"]"),
    "ruby": re.compile(r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"),
    "groovy": re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)"),
    "rust": re.compile(r"^\s*(?:pub\s+)?use\s+([^;]+);"),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.*]+);"),
    "go": re.compile(r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$"),
}
_IMPORT["tsx"] = _IMPORT["typescript"]
_REF = {
    "typescript": re.compile(r"^\s*import\s+(?:type\s+)?(.+?)\s+from|(?:extends|implements)\s+([\w$, .]+)"),
    "ruby": re.compile(r"^\s*class\s+\S+\s*<\s*([\w:]+)|^\s*(?:include|extend|prepend)\s+([\w:]+)"),
    "groovy": re.compile(r"^\s*import\s+(?:static\s+)?[\w.]*?(\w+)\s*;?\s*$|\bextends\s+(\w+)"),
}
_REF["tsx"] = _REF["typescript"]


#: Longer lines are read by statements, as bundlers put whole programs into one line.
LONG = 2000
_MARK = re.compile(r"[({;})]")
#: The same patterns for a statement within a line: at a position instead of the line's start.
_WITHIN = {lang: [(re.compile(re.sub(r"^\^(?:\\s[*+])?", r"\\s*", p.pattern)), kind, sig) for p, kind, sig in rules] for lang, rules in _RULES.items()}
_FROM = r"(?:^|(?<=[;{}]))\s*"
_IMPORTS_WITHIN = {
    "typescript": re.compile(_FROM + r"import\b[^;'\"]*?from\s*['\"]([^'\"]+)['\"]"),
    "javascript": re.compile(r"(?:" + _FROM + r"import\b[^;'\"]*?from\s*|require\()['\"]([^'\"]+)['\"]"),
    "ruby": re.compile(_FROM + r"require(?:_relative)?\s+['\"]([^'\"]+)['\"]"),
    "groovy": re.compile(_FROM + r"import\s+(?:static\s+)?([\w.]+)"),
    "rust": re.compile(_FROM + r"(?:pub\s+)?use\s+([^;]+)(?=;)"),
    "java": re.compile(_FROM + r"import\s+(?:static\s+)?([\w.*]+)(?=;)"),
    "go": re.compile(_FROM + r"import\s+(?:\w+\s+)?\"([^\"]+)\""),
}
_IMPORTS_WITHIN["tsx"] = _IMPORTS_WITHIN["typescript"]
_REFS_WITHIN = {
    "typescript": re.compile(_FROM + r"import\b\s*(?:type\s+)?([^;'\"]+?)\s*from\b|\b(?:extends|implements)\s+([\w$, .]+)"),
    "ruby": re.compile(_FROM + r"class\s+[^\s;]+\s*<\s*([\w:]+)|" + _FROM + r"(?:include|extend|prepend)\s+([\w:]+)"),
    "groovy": re.compile(_FROM + r"import\s+(?:static\s+)?[\w.]*?(\w+)\s*(?=;|$)|\bextends\s+(\w+)"),
}
_REFS_WITHIN["tsx"] = _REFS_WITHIN["typescript"]


def _statements(line: str) -> Iterator[tuple[int, int]]:
    """Start and end of every statement's head in the line, nested ones too: up to the first
    brace or semicolon that is not in a bracket which opens after the start. Heads overlap."""
    marks = [(m.start(), m[0]) for m in _MARK.finditer(line)]
    after: list[int] = [0] * len(marks)  # of an opening bracket: the mark behind its end
    opened: list[int] = []
    for i, (_, c) in enumerate(marks):
        if c == "(":
            opened.append(i)
            after[i] = i + 1
        elif c == ")" and opened:
            after[opened.pop()] = i + 1
    # From the last mark to the first: where a head that comes to this mark ends.
    ends = [len(line)] * (len(marks) + 1)
    for i in range(len(marks) - 1, -1, -1):
        at, c = marks[i]
        ends[i] = ends[after[i]] if c == "(" else at if c == ")" else at + 1
    yield 0, ends[0]
    for i, (at, c) in enumerate(marks):
        if c in "{;}":
            yield at + 1, ends[i + 1]


def _define(m: re.Match, lang: str, kind: str, shape: str) -> tuple[str, int, str]:
    """Signature, the name's group and the name."""
    groups = [g or "" for g in m.groups()]
    at = 2 if lang == "java" and len(groups) == 4 else min(_NAME_GROUP.get(lang, 1) - 1, len(groups) - 1)
    return shape.format("", *groups).strip(), at + 1, groups[at]


def _long_line(line: str, lang: str, number: int, sigs: list, refs: list, defs: list, calls: list, imports: list) -> None:
    """What :func:`_by_lines` finds, of every statement of the line."""
    line, named = re.sub(r"\s+", " ", line), set()
    for start, end in _statements(line):
        if lang != "java" and line[end - 1 : end] in (";", "}"):
            end -= 1
        for pattern, kind, shape in _WITHIN.get(lang, ()):
            m = pattern.match(line, start, end)
            if m:
                sig, group, name = _define(m, lang, kind, shape)
                sigs.append(sig)
                if kind:
                    defs.append((name, kind, number))
                    named.add(m.start(group))
                break
    if p := _IMPORTS_WITHIN.get(lang):
        imports.extend((m[1].strip(), number) for m in p.finditer(line))
    if p := _REFS_WITHIN.get(lang):
        refs.extend(w for m in p.finditer(line) for g in m.groups() if g for w in re.findall(r"[\w$:]+", g) if w not in ("as", "type"))
    found = [m[1] for m in _CALL.finditer(line) if m[1] not in _NOT_CALLED and m.start(1) not in named]
    calls.extend((c, number) for c in found)
    if lang in ("javascript", "rust", "java"):
        refs.extend(found)


#: A line that may begin a declaration or an import whose bracket closes on a later one.
_HEAD = re.compile(r"\s*(?:(?:pub(?:\([^)]*\))?|export|default|async|static|public|private|protected|abstract|final|override|synchronized|get|set|unsafe|const)\s+)*(?:(?:function|func|fn|def|import|from|use)\b|[\w$<>\[\],.?]+(?:\s+[\w$]+)?\s*(?:<[^>]*>)?\()")
_OPENS = re.compile(r"[({]")
_CLOSES = re.compile(r"[)}]")


def _joined(lines: list[str], at: int) -> str:
    """The line, or the declaration or import that begins in it, in one line: up to the line that
    closes its round bracket or, of an import, its brace. What is never closed ends before the
    next line that begins another one, so each line is joined at most once."""
    line = lines[at]
    imports = line.lstrip().startswith("import")
    depth = lambda s: len((_OPENS if imports else _ROUND_OPENS).findall(s)) - len((_CLOSES if imports else _ROUND_CLOSES).findall(s))
    open_ = depth(line)
    if open_ <= 0 or not _HEAD.match(line):
        return line
    parts = [line.rstrip()]
    for more in lines[at + 1 :]:
        if len(more) > LONG or _DECLARES.match(more):
            return line
        parts.append(more.strip())
        open_ += depth(more)
        if open_ <= 0:
            return " ".join(parts)
    return line


_ROUND_OPENS, _ROUND_CLOSES = re.compile(r"\("), re.compile(r"\)")
_DECLARES = re.compile(r"\s*(?:(?:pub|export|default|async|static|public|private|protected|abstract)\s+)*(?:function|func|fn|def|class|struct|interface|enum|trait|impl|import|use|module)\b")


def _by_lines(code: str, lang: str) -> Found:
    sigs, refs, defs, calls, imports = [], [], [], [], []
    lines = [line.rstrip("\r") for line in code.split("\n")]
    for number, line in enumerate(lines, 1):
        if len(line) > LONG:
            _long_line(line, lang, number, sigs, refs, defs, calls, imports)
            continue
        name, whole = None, _joined(lines, number - 1) if lang != "ruby" else line
        for pattern, kind, shape in _RULES.get(lang, ()):
            m = pattern.match(whole)
            if m:
                sig, _, name = _define(m, lang, kind, shape)
                sigs.append(sig)
                if kind:
                    defs.append((name, kind, number))
                else:
                    name = None
                break
        if (p := _IMPORT.get(lang)) and (m := p.search(whole)):
            imports.append((m[1].strip(), number))
        if (p := _REF.get(lang)) and (m := p.search(whole)):
            refs.extend(w for g in m.groups() if g for w in re.findall(r"[\w$:]+", g) if w not in ("as", "type"))
        found = [c for c in _CALL.findall(line) if c not in _NOT_CALLED and c != name]
        calls.extend((c, number) for c in found)
        if lang in ("javascript", "rust", "java"):
            refs.extend(found)
    return sigs, refs, defs, calls, imports


def parse(path_language: str | None, code: str | None) -> Found:
    """signatures, references, definitions (name, kind, line), calls (name, line), imports (module, line)."""
    if not code or not path_language:
        return [], [], [], [], []
    return _python(code) if path_language == "python" else _by_lines(code, path_language)


def _table(df: DataFrame, path: str, text: str, fields: str, rows_of: Callable[[str, str | None, str], list[tuple]]) -> DataFrame:
    """Rows (path, ...) made by ``rows_of`` (path, language, text) in Arrow batches."""
    chosen = df.select(F.col(path).alias("path"), language(F.col(path)).alias("lang"), F.col(text).alias("text")).filter(F.octet_length("text") > 0)
    names = ["path", *[f.strip().split(" ")[0] for f in re.sub(r"<[^>]*>", "", fields).split(",")]]
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    types = [pa.string(), *[kinds[f.strip().split(" ")[1]] for f in fields.split(",")]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *r) for p, lang, t in zip(*[b.column(i).to_pylist() for i in range(3)]) for r in rows_of(p or "", lang, t)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return chosen.mapInArrow(work, "path string, " + fields)


def signatures(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, sigs, refs of every file in a known language."""

    def rows(p, lang, t):
        sigs, refs, *_ = parse(lang, t)
        return [(sigs, refs)] if lang else []

    return _table(df, path, text, "sigs array<string>, refs array<string>", rows)


def definitions(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, name, kind, line, qualified, language."""
    return _table(df, path, text, "name string, kind string, line int, qualified string, language string", lambda p, lang, t: [(n, k, i, f"{p}::{n}", lang) for n, k, i in parse(lang, t)[2]])


def calls(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, caller_qualified, callee_name, line: each call with the last definition at or above its line."""

    def rows(p, lang, t):
        _, _, defs, found, _ = parse(lang, t)
        starts = sorted((line, i, name) for i, (name, _, line) in enumerate(defs))
        out, at, current = [], 0, f"{p}::<top>"
        for name, line in sorted(found, key=lambda c: c[1]):
            while at < len(starts) and starts[at][0] <= line:
                current, at = f"{p}::{starts[at][2]}", at + 1
            out.append((current, name, line))
        return out

    return _table(df, path, text, "caller_qualified string, callee_name string, line int", rows)


def imports(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, module, line."""
    return _table(df, path, text, "module string, line int", lambda p, lang, t: parse(lang, t)[4])


# -- routes -------------------------------------------------------------------------------

_VERBS = ("get", "post", "put", "patch", "delete")
#: Routes of a resource: method, path, action.
_RESOURCE = [("GET", "", "index"), ("GET", "/new", "new"), ("POST", "", "create"), ("GET", "/:id", "show"), ("GET", "/:id/edit", "edit"), ("PATCH", "/:id", "update"), ("PUT", "/:id", "update"), ("DELETE", "/:id", "destroy")]
_GRAILS = [("GET", "", "index"), ("POST", "", "save"), ("GET", "/:id", "show"), ("PUT", "/:id", "update"), ("DELETE", "/:id", "delete")]


def rails_routes(text: str) -> list[tuple[str, str, str, int]]:
    """method, path, handler, line of a routes file.

    Namespaces nest until their end and prefix paths only; an ``end`` closes the innermost
    namespace, whatever it ends. A resource keeps its name in path and handler.
    """
    out, spaces = [], []
    for n, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        base = "".join(f"/{x}" for x in spaces)
        if m := re.match(r"namespace\s*:([^\s,]+)", s):
            spaces.append(m[1])
        elif s == "end":
            spaces and spaces.pop()
        elif m := re.match(r"resources?\s*:([^ ,]+)", s):
            out += [(v, f"{base}/{m[1]}{p}", f"{m[1]}_controller::{a}", n) for v, p, a in _RESOURCE]
        elif m := re.match(r"(get|post|put|patch|delete|match)[\s(]", s):
            rest = s[len(m[1]) :]
            url = re.search(r"'([^']*)'", rest) or re.search(r'"([^"]*)"', rest) or re.search(r":(\w*)", rest)
            to = re.search(r"(?:to:|=>).*?(['\"])([^'\"#]*)#([^'\"]*)\1", rest)
            if url and to:
                out.append((m[1].upper(), f"{base}/{url[1].lstrip('/')}", f"{to[2]}_controller::{to[3]}", n))
    return out


def grails_routes(text: str) -> list[tuple[str, str, str, int]]:
    """Explicit mappings (any method, action index unless given) and resources."""
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        m = re.match(r"\s*(?:(get|post|put|patch|delete)\s+)?['\"](/[^'\"]*)['\"]\s*\(\s*(.*)\)", line)
        if not m:
            continue
        path = re.sub(r"(?<=/)\$([^/]*?)\?*(?=/|$)", r":\1", m[2])
        if c := re.search(r"controller\s*:\s*['\"](\w+)['\"]", m[3]):
            action = re.search(r"action\s*:\s*['\"](\w+)['\"]", m[3])
            verb = re.search(r"method\s*:\s*['\"](\w+)['\"]", m[3])
            method = (verb[1] if verb else m[1] or "ANY").upper()
            out.append((method, path, f"{c[1][:1].upper()}{c[1][1:]}Controller::{action[1] if action else 'index'}", n))
        elif r := re.search(r"resources?\s*:\s*['\"](\w+)['\"]", m[3]):
            name = r[1][:1].upper() + r[1][1:] + "Controller"
            out += [(v, path.rstrip("/") + p, f"{name}::{a}", n) for v, p, a in _GRAILS]
    return out


def nest_routes(text: str) -> list[tuple[str, str, str, int]]:
    """Controller prefix, verb decorator, and the method that follows."""
    out, prefix, owner, waiting = [], "", "", None
    for n, line in enumerate(text.split("\n"), 1):
        if m := re.search(r"@Controller\(\s*(?:['\"]([^'\"]*)['\"])?", line):
            prefix = m[1] or ""
        elif m := re.search(r"\bclass\s+(\w+)", line):
            owner = m[1]
        elif m := re.search(r"@(Get|Post|Put|Patch|Delete|All|Head|Options)\(\s*(?:['\"]([^'\"]*)['\"])?", line):
            waiting = ("ANY" if m[1] == "All" else m[1].upper(), m[2] or "", n)
        elif waiting and (m := re.match(r"\s*(?:(?:public|private|protected|async)\s+)*(\w+)\s*\(", line)):
            path = "/" + "/".join(p for p in (prefix.strip("/"), waiting[1].strip("/")) if p)
            out.append((waiting[0], path, f"{owner}::{m[1]}", waiting[2]))
            waiting = None
    return out


_ROUTES_DSL = re.compile(r"routes\.draw|resources|resource |^[ \t]*(?:get|post|put|patch|delete|match) ", re.M)


def _is_rails(path: str, text: str) -> bool:
    return path.endswith(".rb") and (path.endswith("routes.rb") or "/config/routes/" in path) and bool(_ROUTES_DSL.search(text))


ROUTERS: list[tuple[Callable[[str, str], bool], Callable[[str], list[tuple[str, str, str, int]]]]] = [
    (_is_rails, rails_routes),
    (lambda p, t: p.endswith(".groovy") and (p.endswith("UrlMappings.groovy") or "class UrlMappings" in t or "static mappings = {" in t), grails_routes),
    (lambda p, t: p.endswith((".ts", ".tsx")) and ("@nestjs/common" in t or "@Controller" in t), nest_routes),
]


def routes(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, method, route, handler, line from every router that recognises the file."""
    return _table(df, path, text, "method string, route string, handler string, line int", lambda p, lang, t: [r for detects, read in ROUTERS if detects(p, t) for r in read(t)])


def route_symbols(found: DataFrame) -> DataFrame:
    """Routes as symbols and calls: qualified ``route::METHOD path`` calls the handler's last part."""
    name = F.concat_ws(" ", "method", "route")
    return found.select(name.alias("name"), F.concat(F.lit("route::"), name).alias("qualified"), F.lit("function").alias("kind"), F.col("path").alias("file"), "line", F.element_at(F.split("handler", "::"), -1).alias("callee_name"))
