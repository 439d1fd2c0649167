"""The property multigraph: schemas, enumerations and the option records of the API."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The kinds of nodes and edges, and what several operators group them into.
NODE_KINDS = (
    "file module class struct interface trait protocol function method property field variable constant enum "
    "enum_member type_alias namespace parameter import export route component"
).split()
EDGE_KINDS = "contains calls imports exports extends implements references type_of returns instantiates overrides decorates".split()
REFERENCE_KINDS = [*EDGE_KINDS, "function_ref"]
CONTAINERS = ("class", "interface", "struct", "trait", "protocol", "module", "enum")
CALLER_EDGES = ("calls", "references", "imports", "instantiates")
HIERARCHY_EDGES = ("extends", "implements")
CALLABLES = ("function", "method")
KIND_BONUS = {
    "function": 10, "method": 10, "interface": 9, "trait": 9, "route": 9, "protocol": 9, "class": 8, "component": 8, "type_alias": 6, "struct": 6, "enum": 5,
    "module": 4, "namespace": 4, "property": 3, "field": 3, "constant": 3, "enum_member": 3, "variable": 2, "import": 1, "export": 1, "parameter": 0, "file": 0,
}
LANGUAGE_FAMILIES = {
    "java": "jvm", "kotlin": "jvm", "scala": "jvm", "swift": "apple", "objc": "apple", "typescript": "web", "tsx": "web", "javascript": "web", "jsx": "web",
    "vue": "web", "svelte": "web", "astro": "web", "c": "c", "cpp": "c", "csharp": "dotnet", "razor": "dotnet",
}

NODE_SCHEMA = (
    "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, start_column int, end_column int, "
    "docstring string, signature string, visibility string, is_exported boolean, is_async boolean, is_static boolean, is_abstract boolean, "
    "decorators array<string>, type_parameters array<string>, return_type string, updated_at long"
)
EDGE_SCHEMA = "source string, target string, kind string, metadata map<string,string>, line int, col int, provenance string"
REF_SCHEMA = "from_node_id string, reference_name string, reference_kind string, line int, col int, candidates array<string>, file_path string, language string"
FILE_SCHEMA = "path string, content_hash string, language string, size long, modified_at long, indexed_at long, node_count int"


@dataclass(frozen=True)
class TraversalOptions:
    max_depth: int | None = None
    edge_kinds: tuple[str, ...] = ()
    node_kinds: tuple[str, ...] = ()
    direction: str = "outgoing"
    limit: int = 1000
    include_start: bool = True


@dataclass(frozen=True)
class SearchOptions:
    kinds: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    limit: int = 100
    offset: int = 0
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    case_sensitive: bool = False


@dataclass(frozen=True)
class ContextOptions:
    max_nodes: int = 20
    max_code_blocks: int = 5
    max_block_size: int = 1500
    search_limit: int = 3
    depth: int = 1
    min_score: float = 0.3
    formats: tuple[str, ...] = field(default=("markdown", "json"))
