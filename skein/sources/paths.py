"""Path predicates as columns: language, tests, generated and ignored files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by language.
EXTENSIONS = {
    "typescript": "ts mts cts", "tsx": "tsx", "javascript": "js mjs cjs xsjs xsjslib", "jsx": "jsx", "python": "py pyw", "go": "go", "rust": "rs", "java": "java",
    "c": "c h", "cpp": "cpp cc cxx hpp hxx", "csharp": "cs", "razor": "cshtml razor", "php": "php module install theme inc", "yaml": "yml yaml", "twig": "twig",
    "ruby": "rb rake", "swift": "swift", "kotlin": "kt kts", "dart": "dart", "liquid": "liquid", "svelte": "svelte", "vue": "vue", "astro": "astro", "r": "r",
    "pascal": "pas dpr dpk lpr dfm fmx", "scala": "scala sc", "lua": "lua", "luau": "luau", "objc": "m mm", "xml": "xml", "properties": "properties",
}
LANGUAGE_OF = {e: lang for lang, es in EXTENSIONS.items() for e in es.split()}

#: Endings of generated files.
GENERATED = (
    ".pb.go .pulsar.go _grpc.pb.go _mock.go _mocks.go .generated.ts .generated.tsx .generated.js .generated.jsx .gen.ts .gen.tsx .gen.js .gen.jsx .pb.ts .pb.js _pb.ts _pb.js "
    "_grpc_pb.ts _grpc_pb.js .min.js .min.mjs _pb2.py _pb2_grpc.py _pb2.pyi .pb.cc .pb.h .g.cs Grpc.cs OuterClass.java Grpc.java .pb.swift .g.dart .freezed.dart .pb.dart "
    ".pbgrpc.dart .chopper.dart .generated.rs"
).split()

#: Directories and patterns that a scan leaves out.
IGNORED_DIRS = (
    "node_modules bower_components jspm_packages web_modules .git .yarn .pnpm-store .next .nuxt .svelte-kit .turbo .vite .parcel-cache .angular .docusaurus storybook-static "
    ".vinxi .nitro out-tsc .vercel .netlify .wrangler dist build out .output coverage .nyc_output __pycache__ __pypackages__ .venv venv .pixi .pdm-build .mypy_cache "
    ".pytest_cache .ruff_cache .tox .nox .hypothesis .ipynb_checkpoints .eggs target .gradle obj vendor .build Pods Carthage DerivedData .swiftpm .dart_tool .pub-cache .cxx "
    ".externalNativeBuild vcpkg_installed .bloop .metals lua_modules .luarocks __history __recovery .cache"
).split()
IGNORED_GLOBS = ("*.egg-info/", "cmake-build-*/", "bazel-*/")
MAX_FILE_BYTES = 1024 * 1024

TEST_DIRS = "tests test __tests__ spec specs testlib testing".split()
ROOT_TEST_DIRS = "test tests spec specs".split()
SIDE_DIRS = "integration sample samples example examples fixture fixtures benchmark benchmarks demo demos".split()
#: The test-file rule as one pattern over a path, part by part.
TEST_PATTERN = "|".join([
    r"(?i:(^|/)test[_.][^/]*$)",
    r"(?i:(^|[/._-])(test|tests|spec|specs)\.[a-z0-9]+$)",
    r"(Test|Tests|TestCase|Tester|Spec|Specs)\.[A-Za-z0-9]+$",
    rf"(?i:/({'|'.join(TEST_DIRS)})/)",
    rf"(?i:^({'|'.join(ROOT_TEST_DIRS)})/)",
    r"(Test|Tests|Spec)/",
    rf"(?i:(^|/)({'|'.join(SIDE_DIRS)})/)",
])


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def language(path: Column, content: Column | None = None) -> Column:
    """By extension; a header that speaks C++ or Objective-C is taken at its word."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGE_OF.items() for x in kv))
    by_name = F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))
    if content is None:
        return by_name
    head = extension(path) == "h"
    return F.when(head & content.rlike(r"@(interface|protocol|implementation)\b"), "objc").when(head & content.rlike(r"\b(class|namespace|template)\b[^;]*[{<]"), "cpp").otherwise(by_name)


def is_test(path: Column) -> Column:
    return slashes(path).rlike(TEST_PATTERN)


def is_generated(path: Column) -> Column:
    ends = "|".join(re.escape(e) for e in GENERATED)
    return path.rlike(f"({ends})$") | path.rlike(r"(^|/)mock_[^/]*\.go$")


def glob_rule(glob: str) -> str:
    """One line of an ignore file as a regular expression over paths: a trailing slash means a directory,
    an inner or leading slash anchors, ** crosses directories."""
    body, only_dir = glob.rstrip("/"), glob.endswith("/")
    anchored = "/" in body
    out = ""
    for token in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]*\]|.", body.lstrip("/")):
        out += {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or (token if token[0] == "[" and len(token) > 1 else re.escape(token))
    return ("^" if anchored else "(^|/)") + out + ("/" if only_dir else "(/|$)")


def is_ignored(path: Column, rules: tuple[str, ...] = ()) -> Column:
    """The default directories and patterns, and lines of an ignore file; later lines win, ! takes back."""
    dirs = "|".join(re.escape(d) for d in IGNORED_DIRS)
    verdict = path.rlike(f"(^|/)({dirs})/") | path.rlike("|".join(glob_rule(g) for g in IGNORED_GLOBS))
    for line in rules:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        verdict = (verdict & ~path.rlike(glob_rule(line[1:]))) if line.startswith("!") else (verdict | path.rlike(glob_rule(line)))
    return verdict
