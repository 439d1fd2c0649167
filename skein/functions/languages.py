"""Rules of languages: how declarations, imports and comments look, line by line.

A new language is one entry; register() takes it from outside the library.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Language:
    """declares: (kind, pattern with group `name`, optionally `bases` and `result`); imports: patterns
    with group `source`. scope: how bodies end: by `brace`, `indent` or the word `end`."""

    declares: tuple[tuple[str, str], ...]
    imports: tuple[str, ...] = ()
    scope: str = "brace"
    line_comment: str = "//"
    block_comment: tuple[str, str] | None = ("/*", "*/")
    exported: str = r"\b(export|public|pub)\b"
    method_in: tuple[str, ...] = ("class", "struct", "interface", "trait", "protocol", "enum")
    words: frozenset[str] = field(default_factory=frozenset)

    def compiled(self) -> list[tuple[str, re.Pattern]]:
        return [(k, re.compile(p)) for k, p in self.declares]


_ID = r"(?P<name>[A-Za-z_$][\w$]*)"
_TS = (
    ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_ID}(?:<[^>]*>)?(?P<bases>[^{{]*)"),
    ("interface", rf"^\s*(?:export\s+)?interface\s+{_ID}(?:<[^>]*>)?(?P<bases>[^{{]*)"),
    ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_ID}"),
    ("type_alias", rf"^\s*(?:export\s+)?type\s+{_ID}\s*(?:<[^>]*>)?\s*="),
    ("namespace", rf"^\s*(?:export\s+)?(?:namespace|module)\s+{_ID}"),
    ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_ID}"),
    ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_ID}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"),
    ("constant", rf"^(?:export\s+)?const\s+{_ID}\s*[:=]"),
    ("variable", rf"^(?:export\s+)?(?:let|var)\s+{_ID}\s*[:=;]"),
    ("method", rf"^\s+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|return\b|catch\b|function\b|new\b|super\b){_ID}\s*(?:<[^>]*>)?\([^;]*\)\s*(?::\s*(?P<result>[^{{;]+))?\{{"),
)
_TS_IMPORTS = (r"^\s*import\s+(?:[^'\"]*?\sfrom\s+)?['\"](?P<source>[^'\"]+)['\"]", r"\brequire\(\s*['\"](?P<source>[^'\"]+)['\"]\s*\)")
_C_FUNCTION = rf"^(?:[A-Za-z_][\w\s\*&:<>,~]*?[\s\*&])(?P<name>[A-Za-z_~]\w*(?:::~?\w+)*)\s*\([^;]*\)\s*(?:const|noexcept|override|\s)*\{{"
_JVM_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|data|inner|override|suspend|inline|expect|actual|synchronized|native|virtual|async|partial|readonly|unsafe|extern|new|default|implicit|lazy|case)\s+)*"

LANGUAGES: dict[str, Language] = {
    "typescript": Language(_TS, _TS_IMPORTS),
    "python": Language((("class", rf"^\s*class\s+{_ID}(?:\((?P<bases>[^)]*)\))?"), ("function", rf"^\s*(?:async\s+)?def\s+{_ID}"), ("constant", r"^(?P<name>[A-Z][A-Z0-9_]+)\s*(?::[^=]+)?=")), (r"^\s*from\s+(?P<source>[\w.]+)\s+import", r"^\s*import\s+(?P<source>[\w.]+)"), "indent", "#", None, r"^(?!_)"),
    "go": Language((("struct", rf"^type\s+{_ID}(?:\[[^\]]*\])?\s+struct"), ("interface", rf"^type\s+{_ID}(?:\[[^\]]*\])?\s+interface"), ("type_alias", rf"^type\s+{_ID}\s"), ("method", rf"^func\s+\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*{_ID}"), ("function", rf"^func\s+{_ID}"), ("constant", rf"^const\s+{_ID}"), ("variable", rf"^var\s+{_ID}")), (r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<source>[\w./-]+)\"\s*$",), exported=r"\b[A-Z]"),
    "rust": Language((("struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_ID}"), ("enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_ID}"), ("trait", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_ID}(?P<bases>[^{{]*)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:(?P<bases>[\w:<>]+)\s+for\s+)?(?P<name>\w+)"), ("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+{_ID}"), ("module", rf"^\s*(?:pub\s+)?mod\s+{_ID}"), ("constant", rf"^\s*(?:pub\s+)?(?:const|static)\s+{_ID}\s*:"), ("type_alias", rf"^\s*(?:pub\s+)?type\s+{_ID}")), (r"^\s*(?:pub\s+)?use\s+(?P<source>[\w:]+)",)),
    "java": Language((("class", rf"^\s*{_JVM_MODS}(?:class|record)\s+{_ID}(?:<[^>]*>)?(?P<bases>[^{{]*)"), ("interface", rf"^\s*{_JVM_MODS}@?interface\s+{_ID}(?:<[^>]*>)?(?P<bases>[^{{]*)"), ("enum", rf"^\s*{_JVM_MODS}enum\s+{_ID}"), ("method", rf"^\s+{_JVM_MODS}(?:<[^>]+>\s*)?(?P<result>(?!return\b|new\b|else\b|throw\b)[\w<>\[\],.?]+)\s+{_ID}\s*\([^;]*\)\s*(?:throws\s+[\w.,\s]+)?\{{"), ("field", rf"^\s+{_JVM_MODS}[\w<>\[\],.?]+\s+{_ID}\s*(?:=|;)")), (r"^\s*import\s+(?:static\s+)?(?P<source>[\w.*]+)",)),
    "kotlin": Language((("class", rf"^\s*{_JVM_MODS}(?:enum\s+|annotation\s+|value\s+)?class\s+{_ID}(?P<bases>[^{{]*)"), ("interface", rf"^\s*{_JVM_MODS}(?:fun\s+)?interface\s+{_ID}(?P<bases>[^{{]*)"), ("class", rf"^\s*{_JVM_MODS}object\s+{_ID}(?P<bases>[^{{]*)"), ("function", rf"^\s*{_JVM_MODS}fun\s+(?:<[^>]+>\s*)?(?:[\w<>?]+\.)?{_ID}"), ("property", rf"^\s*{_JVM_MODS}va[lr]\s+{_ID}")), (r"^\s*import\s+(?P<source>[\w.*]+)",)),
    "scala": Language((("class", rf"^\s*{_JVM_MODS}class\s+{_ID}(?P<bases>[^{{]*)"), ("trait", rf"^\s*{_JVM_MODS}trait\s+{_ID}(?P<bases>[^{{]*)"), ("module", rf"^\s*{_JVM_MODS}object\s+{_ID}"), ("function", rf"^\s*{_JVM_MODS}def\s+{_ID}"), ("constant", rf"^\s*{_JVM_MODS}val\s+{_ID}"), ("variable", rf"^\s*{_JVM_MODS}var\s+{_ID}")), (r"^\s*import\s+(?P<source>[\w.{}, ]+)",)),
    "c": Language((("struct", rf"^\s*(?:typedef\s+)?struct\s+{_ID}\s*\{{"), ("enum", rf"^\s*(?:typedef\s+)?enum\s+{_ID}\s*\{{"), ("function", _C_FUNCTION), ("constant", rf"^#define\s+{_ID}")), (r"^\s*#\s*include\s*[<\"](?P<source>[^>\"]+)[>\"]",)),
    "cpp": Language((("class", rf"^\s*class\s+(?:\w+\s+)?{_ID}\s*(?:final\s*)?(?P<bases>:[^{{;]*)?\{{?\s*$"), ("struct", rf"^\s*struct\s+{_ID}\s*(?P<bases>:[^{{;]*)?\{{"), ("namespace", rf"^\s*namespace\s+{_ID}"), ("enum", rf"^\s*enum\s+(?:class\s+)?{_ID}"), ("function", _C_FUNCTION)), (r"^\s*#\s*include\s*[<\"](?P<source>[^>\"]+)[>\"]",)),
    "csharp": Language((("namespace", r"^\s*namespace\s+(?P<name>[\w.]+)"), ("class", rf"^\s*{_JVM_MODS}(?:class|record)\s+{_ID}(?:<[^>]*>)?(?P<bases>[^{{]*)"), ("interface", rf"^\s*{_JVM_MODS}interface\s+{_ID}(?P<bases>[^{{]*)"), ("struct", rf"^\s*{_JVM_MODS}struct\s+{_ID}"), ("enum", rf"^\s*{_JVM_MODS}enum\s+{_ID}"), ("property", rf"^\s+{_JVM_MODS}[\w<>\[\],.?]+\s+{_ID}\s*\{{\s*(?:get|set)"), ("method", rf"^\s+{_JVM_MODS}(?P<result>(?!return\b|new\b|else\b|throw\b|await\b)[\w<>\[\],.?]+)\s+{_ID}\s*(?:<[^>]*>)?\([^;]*\)\s*(?:\{{|=>|$)")), (r"^\s*using\s+(?:static\s+)?(?P<source>[\w.]+)\s*;",)),
    "php": Language((("namespace", r"^\s*namespace\s+(?P<name>[\w\\]+)"), ("class", rf"^\s*(?:abstract\s+|final\s+)*class\s+{_ID}(?P<bases>[^{{]*)"), ("interface", rf"^\s*interface\s+{_ID}(?P<bases>[^{{]*)"), ("trait", rf"^\s*trait\s+{_ID}"), ("enum", rf"^\s*enum\s+{_ID}"), ("function", rf"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?{_ID}")), (r"^\s*use\s+(?P<source>[\w\\]+)", r"\b(?:include|require)(?:_once)?\s*\(?\s*['\"](?P<source>[^'\"]+)['\"]")),
    "ruby": Language((("module", r"^\s*module\s+(?P<name>[\w:]+)"), ("class", r"^\s*class\s+(?P<name>[\w:]+)(?:\s*<\s*(?P<bases>[\w:]+))?"), ("function", r"^\s*def\s+(?:self\.)?(?P<name>[\w?!=]+)"), ("constant", r"^\s*(?P<name>[A-Z][A-Z0-9_]+)\s*=")), (r"^\s*require(?:_relative)?\s+['\"](?P<source>[^'\"]+)['\"]",), "indent", "#", None),
    "swift": Language((("class", rf"^\s*(?:\w+\s+)*?(?:class|actor|extension)\s+{_ID}(?P<bases>[^{{]*)"), ("struct", rf"^\s*(?:\w+\s+)*?struct\s+{_ID}(?P<bases>[^{{]*)"), ("protocol", rf"^\s*(?:\w+\s+)*?protocol\s+{_ID}(?P<bases>[^{{]*)"), ("enum", rf"^\s*(?:\w+\s+)*?enum\s+{_ID}"), ("function", rf"^\s*(?:@\w+\s+)?(?:\w+\s+)*?func\s+{_ID}"), ("property", rf"^\s+(?:@\w+\s+)?(?:\w+\s+)*?(?:let|var)\s+{_ID}\s*[:=]")), (r"^\s*import\s+(?P<source>[\w.]+)",)),
    "dart": Language((("class", rf"^\s*(?:abstract\s+)?(?:class|mixin)\s+{_ID}(?P<bases>[^{{]*)"), ("enum", rf"^\s*enum\s+{_ID}"), ("function", rf"^\s*(?:static\s+)?(?:[\w<>?,]+\s+)(?!if\b|for\b|while\b|switch\b|return\b){_ID}\s*\([^;]*\)\s*(?:async\s*)?\{{")), (r"^\s*(?:import|export)\s+['\"](?P<source>[^'\"]+)['\"]",)),
    "lua": Language((("method", r"^\s*function\s+(?P<owner>\w+)[.:](?P<name>\w+)"), ("function", rf"^\s*(?:local\s+)?function\s+{_ID}"), ("function", rf"^\s*(?:local\s+)?{_ID}\s*=\s*function\b"), ("variable", rf"^local\s+{_ID}\s*=")), (r"\brequire\s*\(?\s*['\"](?P<source>[^'\"]+)['\"]",), "indent", "--", ("--[[", "]]")),
    "r": Language((("function", r"^\s*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\b"), ("variable", r"^(?P<name>[\w.]+)\s*<-")), (r"\b(?:library|require)\(\s*['\"]?(?P<source>\w+)", r"\bsource\(\s*['\"](?P<source>[^'\"]+)"), "brace", "#", None),
    "objc": Language((("class", rf"^\s*@(?:interface|implementation)\s+{_ID}\s*(?P<bases>:\s*\w+)?"), ("protocol", rf"^\s*@protocol\s+{_ID}"), ("method", r"^\s*[-+]\s*\((?P<result>[^)]*)\)\s*(?P<name>\w+)"), ("function", _C_FUNCTION)), (r"^\s*#\s*import\s*[<\"](?P<source>[^>\"]+)[>\"]",)),
    "pascal": Language((("module", r"(?i)^\s*(?:unit|program)\s+(?P<name>[\w.]+)"), ("class", r"(?i)^\s*(?P<name>\w+)\s*=\s*class\s*(?:\((?P<bases>[^)]*)\))?"), ("interface", r"(?i)^\s*(?P<name>\w+)\s*=\s*interface"), ("method", r"(?i)^\s*(?:class\s+)?(?:procedure|function|constructor|destructor)\s+(?P<owner>\w+)\.(?P<name>\w+)"), ("function", r"(?i)^\s*(?:procedure|function)\s+(?P<name>\w+)")), (r"(?i)^\s*uses\s+(?P<source>[\w., ]+)",), "indent", "//", ("{", "}")),
}
for _alias, _of in (("tsx", "typescript"), ("javascript", "typescript"), ("jsx", "typescript"), ("vue", "typescript"), ("svelte", "typescript"), ("astro", "typescript"), ("luau", "lua")):
    LANGUAGES[_alias] = LANGUAGES[_of]

#: Words before a parenthesis that are no calls.
NOT_CALLS = frozenset(
    "if for while switch catch return function def class new else elif except with and or not in is lambda yield await async assert del print_ sizeof typeof instanceof super this self fn func match when "
    "do try throw throws case default foreach using lock fixed unless until begin end then repeat local pub impl trait struct enum interface where let var const val".split()
)


def register(name: str, rules: Language) -> None:
    LANGUAGES[name] = rules
