"""Extractors: the text of files into nodes, contains edges and unresolved references.

A file is one row and its result depends on that row alone, so extraction is a mapInArrow without a
shuffle; Python source goes through the standard parser, other languages through their line rules on
text whose comments and strings are blanked with offsets kept.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.functions.languages import LANGUAGES, NOT_CALLS, Language

#: One wide row for all three tables, told apart by `row`.
SCHEMA = (
    "row string, id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, signature string, docstring string, "
    "is_exported boolean, source string, target string, reference_name string, reference_kind string, line int"
)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
#: Above these, the line rules take the place of a parser.
MAX_BYTES, MAX_LINES = 128 * 1024, 5000


def node_id(path: str, kind: str, name: str, line: int) -> str:
    """kind, and 32 hex digits of the SHA-256 of where a symbol is declared."""
    return f"{kind}:{hashlib.sha256(f'{path}:{kind}:{name}:{line}'.encode()).hexdigest()[:32]}"


def blank(text: str, rules: Language, strings: bool = True) -> str:
    """The text with comments, and the insides of strings, as spaces; line breaks stay."""
    parts = [re.escape(rules.line_comment) + r"[^\n]*"]
    if rules.block_comment:
        a, b = map(re.escape, rules.block_comment)
        parts.insert(0, f"{a}.*?(?:{b}|\\Z)")
    quoted = r'"(?:\\.|[^"\\\n])*"' + r"|'(?:\\.|[^'\\\n])*'"
    spaces = lambda s: re.sub(r"[^\n]", " ", s)

    def swap(m: re.Match) -> str:
        s = m.group()
        if m.lastgroup == "q":
            return s if not strings else s[0] + spaces(s[1:-1]) + s[-1]
        return spaces(s)

    return re.sub(f"(?P<q>{quoted})|(?P<c>{'|'.join(parts)})", swap, text, flags=re.S)


class _Rows:
    def __init__(self, path: str, language: str):
        self.path, self.language, self.out = path, language, []

    def add(self, **kv) -> None:
        self.out.append({"file_path": self.path, "language": self.language, **kv})

    def node(self, kind: str, name: str, scope: list[tuple[str, str]], line: int, end: int, signature: str | None = None, exported: bool = False, doc: str | None = None) -> str:
        nid = node_id(self.path, kind, name, line) if kind != "file" else f"file:{self.path}"
        qualified = "::".join([n for _, n in scope if n] + [name])
        self.add(row="node", id=nid, kind=kind, name=name, qualified_name=qualified, start_line=line, end_line=end, signature=signature, is_exported=exported, docstring=doc)
        if scope:
            self.add(row="edge", source=scope[-1][0], target=nid, kind="contains", line=line)
        return nid

    def ref(self, source: str, name: str, kind: str, line: int) -> None:
        self.add(row="ref", source=source, reference_name=name, reference_kind=kind, line=line)


def _bases(rows: _Rows, nid: str, kind: str, text: str, line: int) -> None:
    implements = re.split(r"\b(?:implements|with)\b", text)
    for i, part in enumerate(implements):
        part = re.sub(r"<[^<>]*>|\([^()]*\)", "", re.sub(r"\b(extends|public|private|protected|virtual)\b|:", " ", part))
        for name in re.findall(r"[A-Za-z_][\w.]*", part):
            rows.ref(nid, name, "implements" if i else "extends", line)


def _python(rows: _Rows, text: str, root: tuple[str, str]) -> None:
    tree = ast.parse(text)

    def name_of(e: ast.AST) -> str | None:
        if isinstance(e, ast.Name):
            return e.id
        if isinstance(e, ast.Attribute) and (base := name_of(e.value)):
            return f"{base}.{e.attr}"
        return None

    def walk(body: list, scope: list[tuple[str, str]], inside: str) -> None:
        for e in body:
            if isinstance(e, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(e, ast.ClassDef) else "method" if inside == "class" else "function"
                head = text.splitlines()[e.lineno - 1].strip()
                nid = rows.node(kind, e.name, scope, e.lineno, e.end_lineno or e.lineno, head, not e.name.startswith("_"), ast.get_docstring(e))
                for d in e.decorator_list:
                    if n := name_of(d.func if isinstance(d, ast.Call) else d):
                        rows.ref(nid, n, "decorates", d.lineno)
                if isinstance(e, ast.ClassDef):
                    for b in e.bases:
                        if n := name_of(b):
                            rows.ref(nid, n, "extends", e.lineno)
                else:
                    for a in [*e.args.posonlyargs, *e.args.args, *e.args.kwonlyargs]:
                        if a.annotation is not None and (n := name_of(a.annotation)):
                            rows.ref(nid, n, "type_of", a.lineno)
                    if e.returns is not None and (n := name_of(e.returns)):
                        rows.ref(nid, n, "returns", e.lineno)
                walk(e.body, [*scope, (nid, e.name)], kind)
            else:
                if isinstance(e, (ast.Import, ast.ImportFrom)):
                    sources = [a.name for a in e.names] if isinstance(e, ast.Import) else ["." * e.level + (e.module or "")]
                    for s in sources:
                        rows.ref(scope[0][0], s, "imports", e.lineno)
                elif isinstance(e, ast.Assign) and inside in ("file", "class"):
                    for t in e.targets:
                        if isinstance(t, ast.Name):
                            kind = "constant" if t.id.isupper() else "variable" if inside == "file" else "property"
                            rows.node(kind, t.id, scope, e.lineno, e.end_lineno or e.lineno, None, not t.id.startswith("_"))
                inner = [x for f in ("body", "orelse", "finalbody") for x in getattr(e, f, []) or []] + [x for h in getattr(e, "handlers", []) for x in h.body]
                own = {id(x) for x in inner}
                stack = [e]
                while stack:
                    x = stack.pop()
                    if isinstance(x, ast.Call) and (n := name_of(x.func)):
                        rows.ref(scope[-1][0], n, "instantiates" if n.rsplit(".", 1)[-1][:1].isupper() else "calls", x.lineno)
                    stack += [c for c in ast.iter_child_nodes(x) if id(c) not in own and not isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
                walk(inner, scope, inside)

    walk(tree.body, [root], "file")


CALL = re.compile(r"(?P<new>\bnew\s+)?(?P<name>[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)\s*(?:<[\w, ]+>)?\(")


def _by_lines(rows: _Rows, text: str, rules: Language, root: tuple[str, str]) -> None:
    lines, code, bare = text.split("\n"), blank(text, rules, strings=False).split("\n"), blank(text, rules).split("\n")
    declares, imports = rules.compiled(), [re.compile(p) for p in rules.imports]
    # scope entries: (id, name, kind, depth or indent at which the body was opened)
    scope: list[tuple[str, str, str, int]] = [(*root, "file", -1)]
    depth, owners = 0, {}
    for i, (line, plain) in enumerate(zip(code, bare, strict=True), 1):
        if rules.scope == "indent" and plain.strip():
            indent = len(plain) - len(plain.lstrip())
            while len(scope) > 1 and indent <= scope[-1][3] and not re.match(r"\s*(?:(?:else|elsif|rescue|ensure)\b|[)\]}])", plain):
                scope.pop()
        for p in imports:
            if m := p.search(line):
                rows.ref(root[0], m["source"].strip(), "imports", i)
        found = None
        for kind, p in declares:
            if m := p.search(plain):
                found = (kind, m)
                break
        if found:
            kind, m = found
            name, groups = m["name"], m.groupdict()
            chain = [(s[0], s[1]) for s in scope]
            if kind == "function" and scope[-1][2] in (*rules.method_in, "impl"):
                kind = "method"
            if kind == "impl":  # methods of a type declared elsewhere in the file
                nid = owners.get(name, root[0])
                if groups.get("bases"):
                    rows.ref(nid, groups["bases"], "implements", i)
            else:
                if groups.get("owner"):
                    chain = [*chain[:1], (owners.get(groups["owner"], root[0]), groups["owner"])]
                nid = rows.node(kind, name, chain, i, _end(bare, i, rules), line.strip()[:200], bool(re.search(rules.exported, name if rules.exported.startswith(("^", r"\b[")) else plain)), _doc(lines, i))
                owners.setdefault(name, nid)
                if groups.get("bases"):
                    _bases(rows, nid, kind, groups["bases"], i)
                if groups.get("result") and groups["result"].strip() not in ("void", ""):
                    rows.ref(nid, re.sub(r"[<\[].*", "", groups["result"].strip()), "returns", i)
            if kind in (*rules.method_in, "function", "method", "namespace", "module", "impl"):
                opened = depth if rules.scope == "brace" else len(plain) - len(plain.lstrip())
                if rules.scope != "brace" or "{" in plain or not plain.rstrip().endswith(";"):
                    scope.append((nid, name, kind, opened))
        caller = scope[-1][0]
        for m in CALL.finditer(plain):
            n = m["name"].replace("->", ".")
            if n.split(".")[0] in NOT_CALLS and "." not in n or found and m.start() < found[1].end():  # the declaration itself
                continue
            rows.ref(caller, n, "instantiates" if m["new"] else "calls", i)
        if rules.scope == "brace":
            for c in plain:
                if c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                    while len(scope) > 1 and depth <= scope[-1][3]:
                        scope.pop()


def _end(lines: list[str], start: int, rules: Language) -> int:
    """The last line of a declaration's body."""
    if rules.scope == "brace":
        depth, opened = 0, False
        for i in range(start - 1, len(lines)):
            depth += lines[i].count("{") - lines[i].count("}")
            opened = opened or "{" in lines[i]
            if opened and depth <= 0 or not opened and lines[i].rstrip().endswith(";"):
                return i + 1
        return start
    indent = len(lines[start - 1]) - len(lines[start - 1].lstrip())
    last = start
    for i in range(start, len(lines)):
        if lines[i].strip():
            if len(lines[i]) - len(lines[i].lstrip()) <= indent:
                return i + 1 if lines[i].strip() == "end" else last
            last = i + 1
    return last


def _doc(lines: list[str], line: int) -> str | None:
    """The comment block that ends right above a line."""
    out = []
    for s in reversed(lines[max(0, line - 30) : line - 1]):
        s = s.strip()
        if not s.startswith(("//", "#", "*", "/*", "--", "///")):
            break
        out.append(re.sub(r"^(///?|#|/\*\*?|\*/|\*|--)\s?|\*/$", "", s).strip())
    return "\n".join(x for x in reversed(out) if x) or None


def extract_file(path: str, language: str, text: str) -> list[dict]:
    """Rows of one file: always its file node, and what its language's rules find; broken or oversized
    Python falls back from the parser to line rules."""
    rows = _Rows(path, language)
    name = path.rsplit("/", 1)[-1]
    root = (rows.node("file", name, [], 1, text.count("\n") + 1, exported=False), "")
    rules = LANGUAGES.get(language)
    if rules is None:
        return rows.out
    n_lines = text.count("\n") + (text[-1:] not in ("", "\n"))
    if language == "python" and len(text.encode()) <= MAX_BYTES and n_lines <= MAX_LINES:
        mark = len(rows.out)
        try:
            _python(rows, text, root)
            return rows.out
        except (SyntaxError, ValueError, RecursionError):
            del rows.out[mark:]
    if language in ("vue", "svelte", "astro"):
        # scripts only, on their own lines
        inside = "|".join([r"<script[^>]*>(.*?)</script>", r"\A---\n(.*?)\n---"])
        kept = [m.span(1) if m.group(1) is not None else m.span(2) for m in re.finditer(inside, text, re.S)]
        text = "".join(c if c == "\n" or any(a <= i < b for a, b in kept) else " " for i, c in enumerate(text))
        rows.node("component", name.rsplit(".", 1)[0], [root], 1, 1, exported=True)
    _by_lines(rows, text, rules, root)
    return rows.out


def extract(files: DataFrame) -> DataFrame:
    """files(path, language, content) into rows of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")])
        for b in batches:
            for path, language, text in zip(*(b.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                out = extract_file(path, language, text or "")
                yield pa.RecordBatch.from_pydict({f: [r.get(f) for r in out] for f in FIELDS}, schema=schema)

    from skein.functions.ship import ship

    ship(files.sparkSession)
    return files.select("path", "language", "content").mapInArrow(run, SCHEMA)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, refs) of extract()'s rows."""
    nodes = rows.filter("row = 'node'").select("id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "signature", "docstring", "is_exported")
    edges = rows.filter("row = 'edge'").select("source", "target", "kind", "line")
    refs = rows.filter("row = 'ref'").selectExpr("xxhash64(source, reference_name, reference_kind, line) AS ref_id", "source AS from_node_id", "reference_name", "reference_kind", "line", "file_path", "language")
    return nodes, edges, refs.dropDuplicates(["ref_id"])
