"""Routes of web frameworks: one pattern table, read with offsets for line numbers.

Each match is a route node `route:<file>:<line>:<METHOD>:<path>` named `METHOD path`, and a reference to its handler.
register() adds a framework.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.functions.extract import blank
from skein.functions.languages import LANGUAGES

SCHEMA = "id string, name string, method string, path string, framework string, handler string, handler_kind string, file_path string, line int"
VERBS = "get|post|put|patch|delete|head|options|any|all"
_STR = r"['\"`](?P<path>[^'\"`]*)['\"`]"
#: framework: languages, pattern with path, optional verb and handler.
PATTERNS: dict[str, list[tuple[tuple[str, ...], str]]] = {
    "express": [(("javascript", "typescript", "jsx", "tsx"), rf"\b(?:app|router|\w*[Rr]outer)\.(?P<verb>{VERBS}|use)\(\s*{_STR}\s*,(?P<handler>[^;]*?)\)\s*;?\s*$")],
    "nestjs": [(("typescript",), rf"@(?P<verb>Get|Post|Put|Patch|Delete|All)\(\s*(?:{_STR})?\s*\)\s*(?:@[^\n]*\n\s*)*(?:async\s+)?(?P<handler>\w+)")],
    "react": [(("jsx", "tsx"), r"<Route\b[^>]*\bpath=\{?['\"](?P<path>[^'\"]+)['\"][^>]*(?:element=\{<\s*(?P<handler>\w+)|component=\{(?P<handler2>\w+))")],
    "go": [(("go",), r"\.(?P<verb>GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Get|Post|Put|Patch|Delete|Any|Handle|HandleFunc)\(\s*\"(?P<path>[^\"]*)\"\s*,\s*(?P<handler>[^)\n]+)\)")],
    "laravel": [(("php",), rf"Route::(?P<verb>{VERBS})\(\s*{_STR}\s*,\s*(?P<handler>\[[^\]]*\]|['\"][^'\"]*['\"]|[\w:]+)"), (("php",), rf"Route::(?P<verb>resource|apiResource)\(\s*{_STR}\s*,\s*(?P<handler>['\"\w:\\]+)")],
    "django": [(("python",), rf"\b(?:path|re_path|url)\(\s*r?{_STR}\s*,\s*(?P<handler>[\w.]+(?:\([^)]*\))?)"), (("python",), rf"\.(?P<verb>register)\(\s*r?{_STR}\s*,\s*(?P<handler>\w+)")],
    "flask": [(("python",), rf"@\w+\.route\(\s*{_STR}(?:[^)]*methods\s*=\s*\[\s*['\"](?P<verb>\w+))?[^)]*\)\s*(?:\n\s*@[^\n]*)*\n\s*(?:async\s+)?def\s+(?P<handler>\w+)")],
    "fastapi": [(("python",), rf"@\w+\.(?P<verb>{VERBS})\(\s*{_STR}[^)]*\)\s*(?:\n\s*@[^\n]*)*\n\s*(?:async\s+)?def\s+(?P<handler>\w+)")],
    "rails": [(("ruby",), rf"^\s*(?P<verb>{VERBS})\s+{_STR}\s*(?:=>|,\s*to:)\s*['\"](?P<handler>[\w/#]+)['\"]"), (("ruby",), r"^\s*(?P<verb>resources)\s+:(?P<path>\w+)(?P<handler>[^\n]*)")],
    "spring": [(("java", "kotlin"), r"@(?P<verb>Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*\"(?P<path>[^\"]*)\"[^)]*\)\s*(?:@[^\n]*\n\s*)*[^\n{;=]*?\b(?P<handler>\w+)\s*\(")],
    "play": [(("unknown", "properties"), rf"^(?P<verb>GET|POST|PUT|PATCH|DELETE|HEAD)\s+(?P<path>/\S*)\s+(?P<handler>[\w.]+)")],
    "axum": [(("rust",), r"\.route\(\s*\"(?P<path>[^\"]*)\"\s*,\s*(?:\w+::)*(?P<verb>get|post|put|patch|delete)\(\s*(?P<handler>[\w:]+)"), (("rust",), r"#\[(?P<verb>get|post|put|patch|delete)\(\"(?P<path>[^\"]*)\"[^\]]*\)\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(?P<handler>\w+)")],
    "aspnet": [(("csharp",), r"\[Http(?P<verb>Get|Post|Put|Patch|Delete)(?:\(\s*\"(?P<path>[^\"]*)\"[^)]*\))?\]\s*(?:\[[^\n]*\n\s*)*[^\n{;=]*?\b(?P<handler>\w+)\s*\("), (("csharp",), r"\.Map(?P<verb>Get|Post|Put|Patch|Delete)\(\s*\"(?P<path>[^\"]*)\"\s*,\s*(?P<handler>[\w.]+)")],
    "vapor": [(("swift",), r"\b(?:app|routes?|\w+)\.(?P<verb>get|post|put|patch|delete)\(\s*\"(?P<path>[^\"]*)\"[^)]*?use:\s*(?P<handler>[\w.]+)")],
}
#: The actions that a resource expands to.
REST = (("index", "GET", ""), ("create", "POST", ""), ("new", "GET", "/new"), ("edit", "GET", "/:id/edit"), ("show", "GET", "/:id"), ("update", "PATCH", "/:id"), ("destroy", "DELETE", "/:id"))


def register(framework: str, languages: tuple[str, ...], pattern: str) -> None:
    PATTERNS.setdefault(framework, []).append((languages, pattern))


def _tail(handler: str) -> str:
    words = re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"['\"\\]", " ", handler))
    return words[-1] if words else ""


def routes_in(path: str, language: str, text: str) -> list[dict]:
    rules = LANGUAGES.get(language)
    code = blank(text, rules, strings=False) if rules else text
    out = []

    def add(framework: str, method: str, at: str, handler: str, kind: str, line: int) -> None:
        out.append({"id": f"route:{path}:{line}:{method}:{at}", "name": f"{method} {at}", "method": method, "path": at, "framework": framework, "handler": handler, "handler_kind": kind, "file_path": path, "line": line})

    for framework, patterns in PATTERNS.items():
        for languages, pattern in patterns:
            if language not in languages:
                continue
            for m in re.finditer(pattern, code, re.M):
                g = m.groupdict()
                line = code.count("\n", 0, m.start()) + 1
                at, handler, verb = g.get("path") or "", g.get("handler") or g.get("handler2") or "", (g.get("verb") or "GET").upper()
                if framework == "rails" and verb == "RESOURCES":
                    some = re.search(r"only:\s*\[([^\]]*)\]", handler)
                    less = re.search(r"except:\s*\[([^\]]*)\]", handler)
                    for action, method, end in REST:
                        if (not some or action in re.findall(r"\w+", some[1])) and not (less and action in re.findall(r"\w+", less[1])):
                            add(framework, method, f"/{at}{end}", f"{at}#{action}", "references", line)
                elif framework == "laravel" and verb in ("RESOURCE", "APIRESOURCE"):
                    add(framework, "resource", at, re.sub(r"::class$|['\"]", "", handler).split("\\")[-1], "imports", line)
                elif framework == "laravel":
                    ctrl = re.findall(r"[\w\\]+", handler.replace("::class", ""))
                    add(framework, verb, at, "@".join(x.split("\\")[-1] for x in ctrl[:2]) if ctrl else "", "references", line)
                elif framework == "django":
                    if verb == "REGISTER":
                        add(framework, "VIEWSET", f"/{at.strip('/')}", handler, "references", line)
                    elif handler.startswith("include("):
                        add(framework, "ANY", at, handler[8:-1].strip("'\""), "imports", line)
                    else:
                        add(framework, "ANY", at, _tail(re.sub(r"\.as_view\(.*", "", handler)), "references", line)
                elif framework == "express":
                    if verb == "USE" and not at.startswith("/"):
                        continue
                    last = handler.split(",")[-1] if "=>" not in handler else ""
                    calls = [] if last else sorted(set(re.findall(r"\b([A-Za-z_$][\w$]*)\s*\(", handler.split("=>", 1)[1])))
                    for h, kind in [(_tail(last), "references")] if last else [(c, "calls") for c in calls] or [("", "references")]:
                        add(framework, verb, at, h, kind, line)
                else:
                    method = {"HANDLE": "ANY", "HANDLEFUNC": "ANY", "REQUEST": "ANY", "ALL": "ANY"}.get(verb, verb)
                    at = at or ("/" if framework in ("fastapi", "nestjs", "aspnet") else at)
                    add(framework, method, at, ".".join(handler.split(".")[-2:]) if framework == "play" else handler if framework == "rails" else _tail(handler), "references", line)
    return out


def routes(files: DataFrame) -> DataFrame:
    """files(path, language, content) into route rows."""
    from skein.functions.ship import ship

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], pa.int32() if f.endswith(" int") else pa.string()) for f in SCHEMA.split(", ")])
        for b in batches:
            for p, lang, text in zip(*(b.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                out = routes_in(p, lang, text or "")
                yield pa.RecordBatch.from_pydict({f.name: [r[f.name] for r in out] for f in schema}, schema=schema)

    ship(files.sparkSession)
    return files.select("path", "language", "content").mapInArrow(run, SCHEMA)
