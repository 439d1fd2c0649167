"""Markup, bridges, path routes and the typed strategies of resolution."""

from __future__ import annotations

from skein.functions import templates
from skein.operators import resolve
from skein.sources.files import nested_repositories

REF = "ref_id long, from_node_id string, reference_name string, reference_kind string, line int, file_path string, language string"
NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, is_exported boolean"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_templates(spark):
    f = files(spark, ("f.dfm", "object Form1: TForm1\n  object Ok: TButton\n    OnClick = OkClick\n  end\nend\n"), ("v.cshtml", "@model Shop.Item\n@inject IFoo Foo\n"), ("m.xml", '<mapper namespace="a.b.UserMapper"><select id="find">x</select></mapper>'))
    assert pairs(templates.delphi_forms(f), "name", "type") == [("Form1", "TForm1"), ("Ok", "TButton")]
    assert pairs(templates.delphi_handlers(f), "handler") == [("OkClick",)]
    assert pairs(templates.razor(f), "directive", "name") == [("inject", "IFoo"), ("model", "Shop.Item")]
    assert pairs(templates.mybatis(f), "name") == [("UserMapper::find",)]


def test_bridges_and_manifests(spark):
    f = files(spark, ("a.m", "RCT_EXPORT_METHOD(open:(id)x)"), ("b.kt", "@ReactMethod\nfun shut() {}\nFunction(\"go\") {}"), ("c/Cargo.toml", "[package]\nname = \"core\"\n"), ("go.mod", "module x.org/y\n"), ("v.swift", "struct Home: View {"))
    assert pairs(templates.bridges(f), "framework", "name") == [("expo", "go"), ("react-native", "open"), ("react-native", "shut"), ("swiftui", "Home")]
    assert pairs(templates.cargo_members(f), "crate", "directory") == [("core", "c")]
    assert pairs(templates.go_module(f), "module", "directory") == [("x.org/y", "")]


def test_path_routes(spark):
    f = files(spark, ("src/routes/blog/[id]/+page.svelte", ""), ("app/(shop)/cart/page.tsx", ""), ("pages/index.vue", ""), ("pages/u/[name].vue", ""), ("src/pages/about.astro", ""), ("lib/x.ts", ""))
    assert pairs(templates.path_routes(f), "framework", "route") == [("astro", "/about"), ("next", "/cart"), ("nuxt", "/"), ("nuxt", "/u/:name"), ("sveltekit", "/blog/:id")]


def test_typed_strategies(spark):
    nodes = spark.createDataFrame([
        ("T", "class", "App", "App", "a.ts", "typescript", 1, True), ("m", "method", "run", "App::run", "a.ts", "typescript", 2, True), ("h", "method", "help", "App::help", "a.ts", "typescript", 5, True),
        ("B", "class", "Base", "Base", "b.ts", "typescript", 1, True), ("s", "method", "stop", "Base::stop", "b.ts", "typescript", 2, True), ("f", "function", "make", "make", "c.ts", "typescript", 1, True),
        ("j", "class", "Sym", "a.b::Sym", "x/J.java", "java", 1, True),
    ], NODE)
    refs = spark.createDataFrame([
        (1, "m", "this.help", "calls", 3, "a.ts", "typescript"), (2, "m", "this.stop", "calls", 3, "a.ts", "typescript"), (3, "m", "make().stop", "calls", 3, "a.ts", "typescript"), (4, "j", "a.b.Sym", "imports", 1, "x/K.java", "java"),
    ], REF)
    supers = spark.createDataFrame([("App", "Base")], "sub string, super string")
    returns = spark.createDataFrame([("f", "Base")], "id string, type string")
    assert pairs(resolve.own_member(refs, nodes), "ref_id", "target_id") == [(1, "h")]
    assert pairs(resolve.inherited_member(refs, nodes, supers), "ref_id", "target_id") == [(2, "s")]
    assert pairs(resolve.chained_call(refs, nodes, returns), "ref_id", "target_id") == [(3, "s")]
    assert pairs(resolve.jvm_import(refs, nodes), "ref_id", "target_id", "confidence") == [(4, "j", 0.95)]
    every = resolve.resolve(refs, nodes, supertypes=supers, returns=returns)
    assert pairs(every, "ref_id", "target_id") == [(1, "h"), (2, "s"), (3, "s"), (4, "j")]


def test_word_overlap_and_keys(spark):
    nodes = spark.createDataFrame([("a", "method", "send", "MailQueueWorker::send", "a.ts", "typescript", 1, True), ("b", "method", "send", "Socket::send", "b.ts", "typescript", 1, True), ("k", "constant", "max-size", "max-size", "app.properties", "properties", 1, False)], NODE)
    refs = spark.createDataFrame([(1, "x", "mailQueue.send", "calls", 1, "c.ts", "typescript"), (2, "x", "maxSize", "references", 1, "c.ts", "typescript")], REF)
    assert pairs(resolve.word_overlap(refs, nodes), "ref_id", "target_id") == [(1, "a")]
    assert pairs(resolve.config_key(refs, nodes), "ref_id", "target_id") == [(2, "k")]


def test_nested_repositories(tmp_path):
    (tmp_path / "a/b/.git").mkdir(parents=True)
    (tmp_path / "node_modules/c/.git").mkdir(parents=True)
    assert nested_repositories(str(tmp_path)) == ["a/b"]


def test_pending_takes_the_closest(spark):
    from skein.operators.pending import pending_edges, resolve_pending

    nodes = spark.createDataFrame([("far", "function", "go", "x::go", "lib/z/a.ts", "typescript", 1, True), ("near", "function", "go", "y::go", "src/a/b.ts", "typescript", 1, True), ("type", "interface", "go", "z::go", "src/a/c.ts", "typescript", 1, True), ("whole", "function", "q", "m.q", "z.ts", "typescript", 1, True)], NODE)
    refs = spark.createDataFrame([(1, "x", "go", "calls", 1, "src/a/m.ts", "typescript"), (2, "x", "go", "calls", 9, "src/a/m.ts", "typescript"), (3, "x", "m.q", "calls", 1, "src/a/m.ts", "typescript"), (4, "x", "none", "calls", 1, "src/a/m.ts", "typescript")], REF)
    assert pairs(resolve_pending(refs, nodes), "ref_id", "target_id") == [(1, "near"), (2, "near"), (3, "whole")]
    assert pairs(pending_edges(refs, nodes), "source", "target") == [("x", "near"), ("x", "whole")]
