"""Words of a question: identifiers, parts of identifiers and their stems."""

from __future__ import annotations

import re

#: Words that say nothing about code.
STOP_WORDS = frozenset(
    "the a an and or but in on at to for of with by from is it that this are was be has had have do does did will would could should may might can shall not no all each every how what where when who "
    "which why i me my we our you your he she they show give tell been done made used using work works found also into then than just more some such over only out its so up as if look need needs want "
    "happen happens affect affected break breaks failing implemented implement code file files function method class type fix bug called".split()
)

#: Fixed values: (ending, least length of the word, what is cut, what is put back); a doubled letter is halved where marked.
STEMS = (
    ("ing", 6, 3, ("", "e"), True), ("tion", 6, 3, ("",), False), ("sion", 6, 3, ("",), False), ("ment", 7, 4, ("",), False), ("ies", 5, 3, ("y",), False), ("es", 5, 2, ("",), False),
    ("s", 5, 1, ("",), False), ("ied", 6, 3, ("y",), False), ("ed", 5, 2, ("e", ""), False), ("er", 5, 2, ("", "e"), True),
)
#: An ending does not count where a longer one with its own rule, or one of these, applies.
UNLESS = {"es": ("ies",), "s": ("ss", "es"), "ed": ("eed",)}


def stems(word: str) -> list[str]:
    word, out = word.lower(), []
    for ending, least, n, back, halve in STEMS:
        if not word.endswith(ending) or len(word) < least or word.endswith(UNLESS.get(ending, ())):
            continue
        base = word[:-n]
        out += [base + b for b in back]
        if halve and len(base) > 1 and base[-1] == base[-2]:
            out.append(base[:-1])
    return [s for s in dict.fromkeys(out) if len(s) >= 3 and s != word]


def camel_parts(name: str) -> list[str]:
    """Parts of an identifier of more than one letter: at underscores, from lower to upper, and before the last of several capitals."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", re.sub(r"[^A-Za-z0-9]+", " ", name))
    return [p for p in spaced.split() if len(p) > 1]


def search_terms(query: str, with_stems: bool = True) -> list[str]:
    """Compound identifiers whole, then their parts and all other words that are no stop words, then stems."""
    runs = re.findall(r"[A-Za-z0-9_]+", query)
    whole = [r.lower() for r in runs if len(r) >= 3 and (re.search(r"[a-z][A-Z]|[A-Z]{2}[a-z]", r) or ("_" in r and r[0].isalpha()))]
    parts = [p.lower() for r in runs for p in camel_parts(r)]
    out = dict.fromkeys([*whole, *(p for p in parts if len(p) >= 3 and p not in STOP_WORDS)])
    if with_stems:
        out |= dict.fromkeys(s for t in list(out) for s in stems(t) if s not in STOP_WORDS)
    return list(out)


def symbols(text: str) -> list[str]:
    """What looks like a symbol: dotted names and their parts, camel, snake and screaming names, acronyms."""
    out: dict[str, None] = {}
    for m in re.finditer(r"[A-Za-z_][A-Za-z0-9_]*(?:(?:\.|::)[A-Za-z_][A-Za-z0-9_]*)*", text):
        name = m.group()
        pieces = re.split(r"\.|::", name)
        odd = any(re.search(r"[a-z][A-Z]|_|[A-Z]{2,}|\d", p) for p in pieces) or len(pieces) > 1 or (name[0].isupper() and m.start() and name[1:2].islower())
        if odd and name.lower() not in STOP_WORDS:
            out |= dict.fromkeys([name, *pieces])
    return list(out)


def term_groups(terms: list[str]) -> list[list[str]]:
    """Terms of which one contains the other, together; the longest first."""
    groups: list[list[str]] = []
    for t in sorted(terms, key=lambda t: (-len(t), t)):
        home = next((g for g in groups if any(t in u or u in t for u in g)), None)
        home.append(t) if home else groups.append([t])
    return groups


def is_distinctive(word: str) -> bool:
    return bool(re.search(r"_|\d|[a-z][A-Z]", word))
