"""Python source to code elements: two rule sets over the standard library's syntax tree.

`tree` gives top-level functions and classes with resolved calls; `ast` gives classes and functions, nested ones too, with
types, decorators and assignments. Parsing runs in Arrow batches, one file a row; a file that cannot be parsed gives one
row with an error and no element. Lists that are sets (dependencies, calls, assignments) come sorted and distinct.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Calls that say nothing about a program.
TRIVIAL = (
    "int", "str", "float", "bool", "list", "dict", "set", "tuple", "len", "print", "sum", "min", "max", "any", "all", "map", "filter", "sorted",
    "reversed", "abs", "round", "hex", "bin", "ord", "chr", "getattr", "setattr", "hasattr", "delattr", "isinstance", "issubclass",
    "logger.info", "logger.debug", "logger.exception", "logger.warning",
)

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
LISTS = ("decorators", "dependencies", "base_classes", "methods", "calls", "assignments")


def module_of(path: str) -> str:
    """`a/b.py` and `a\\b.py` are the module a.b."""
    return path.replace("\\", "/").replace("/", ".").removesuffix(".py")


def _dotted(node: ast.expr) -> tuple[list[str], bool]:
    """The names of an attribute chain, and whether it starts at a plain name."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.insert(0, node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return [node.id, *names], True
    return names, False


def _before_children(node: ast.AST) -> Iterator[ast.AST]:
    yield node
    for child in ast.iter_child_nodes(node):
        yield from _before_children(child)


def _element(kind: str, name: str, path: str, code: str, **more) -> dict:
    row = {"type": kind, "name": name, "docstring": "", "code": code, "file_path": path, "parameters": [], "return_type": None, "explanation": None, "is_async": False}
    row |= {c: [] for c in LISTS}
    return row | more


def _params(names: list[tuple[str, str]]) -> list[dict]:
    return [{"name": n, "type": t, "default": None} for n, t in names]


class Scope:
    """What a file's top level imports and defines, for resolving calls."""

    def __init__(self, tree: ast.Module, path: str):
        module = module_of(path)
        self.imports: dict[str, str] = {}
        for node in tree.body:
            if isinstance(node, ast.Import):
                self.imports |= {a.name: a.name for a in node.names if a.asname is None}
            elif isinstance(node, ast.ImportFrom):
                names = plain_names(node)
                self.imports |= {n: f"{names[0]}.{n}" for n in names[1:]}
        self.local = {n.name: f"{module}.{n.name}" for n in tree.body if isinstance(n, (*FUNCTIONS, ast.ClassDef))}

    def knows(self, name: str) -> bool:
        return name in self.imports or name in self.local

    def resolve(self, call: str) -> str:
        """Local names come before imports, whole names before their first part; Class.method is the class."""
        for known in (self.local, self.imports):
            if call in known:
                return known[call]
        first, _, rest = call.partition(".")
        for known in (self.local, self.imports):
            if rest and first in known:
                method = "." not in rest and first[0].isupper() and not first.isupper()
                return known[first] if method else f"{known[first]}.{rest}"
        return call

    def calls(self, body: list[ast.stmt]) -> list[str]:
        """Resolved calls of statements; trivial ones, those on self and those on unknown lower-case names are left out."""
        out = []
        for node in (n for s in body for n in _before_children(s)):
            if not isinstance(node, ast.Call) or not isinstance(node.func, (ast.Name, ast.Attribute)):
                continue
            names, _ = _dotted(node.func)
            call = ".".join(names)
            instance = len(names) > 1 and names[0][0].islower() and not self.knows(names[0])
            if call not in TRIVIAL and not call.startswith("self.") and not instance:
                out.append(self.resolve(call))
        return out


def plain_names(node: ast.ImportFrom) -> list[str]:
    """The module of a from-import and its names without alias; a relative import has no module of its own."""
    names = [a.name for a in node.names if a.asname is None and a.name != "*"]
    return names if node.level else [node.module or "", *names]


def _import_targets(node: ast.stmt) -> list[str]:
    if isinstance(node, ast.Import):
        return [a.name for a in node.names if a.asname is None]
    if isinstance(node, ast.ImportFrom):
        names = plain_names(node)
        return [f"{names[0]}.{n}" for n in names[1:]] if len(names) > 1 else names
    return []


def _quoted(source: str, body: list[ast.stmt]) -> str:
    """The first statement's text without quote signs, if it is one string."""
    first = body[0]
    if not isinstance(first, ast.Expr) or not isinstance(first.value, (ast.Constant, ast.JoinedStr)):
        return ""
    told = ast.get_source_segment(source, first.value) or ""
    if isinstance(first.value, ast.Constant):
        if not isinstance(first.value.value, (str, bytes)):
            return ""
        strings = [t for t in tokenize.generate_tokens(io.StringIO(told).readline) if t.type == tokenize.STRING]
        if len(strings) != 1:  # several strings side by side are another kind of node
            return ""
    return told.strip("'\"")


def parse_tree(source: str, path: str, project: str = "") -> list[dict]:
    """Top-level definitions, decorated ones too, each with all the file's imports from the project."""
    tree = ast.parse(source)
    scope, module = Scope(tree, path), module_of(path)
    shared = [t for n in tree.body if any(x.startswith(project) for x in _import_targets(n)) for t in _import_targets(n)]
    out = []
    for node in tree.body:
        if not isinstance(node, (*FUNCTIONS, ast.ClassDef)):
            continue
        row = _element("class", f"{module}.{node.name}", path, ast.get_source_segment(source, node) or "", docstring=_quoted(source, node.body), calls=scope.calls(node.body), dependencies=shared)
        if isinstance(node, ast.ClassDef):
            row["base_classes"] = [".".join(_dotted(b)[0]) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
            row["methods"] = [m.name for m in node.body if isinstance(m, FUNCTIONS) and not m.decorator_list]
        else:
            a = node.args
            bare = [x.arg for x in (a.posonlyargs + a.args)[: len(a.posonlyargs + a.args) - len(a.defaults)] if x.annotation is None]
            bare += [x.arg for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is None and x.annotation is None]
            row |= {"type": "function", "parameters": _params([(n, "Any") for n in bare]), "is_async": isinstance(node, ast.AsyncFunctionDef)}
        out.append(row)
    return out


def annotation(node: ast.expr | None) -> str:
    """Names, attributes, constants and subscripts of these; anything else is Any."""
    match node:
        case ast.Name():
            return node.id
        case ast.Constant():
            return str(node.value)
        case ast.Attribute():
            return f"{annotation(node.value)}.{node.attr}"
        case ast.Subscript():
            return f"{annotation(node.value)}[{annotation(node.slice)}]"
    return "Any"


class _Walk:
    """One pass over a file in the order of the syntax tree's fields."""

    def __init__(self, source: str, path: str, project: str):
        self.source, self.path, self.project, self.module = source, path, project, module_of(path)
        self.imports: dict[str, str] = {}
        self.found: list[dict] = []
        self.owner: str | None = None
        self.open: dict | None = None  # the function that calls and assignments belong to

    def below(self, node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            self.see(child)

    def see(self, node: ast.AST) -> None:
        match node:
            case ast.Import():
                self.imports |= {a.asname or a.name: a.name for a in node.names}
            case ast.ImportFrom():
                self.imports |= {a.asname or a.name: f"{node.module}.{a.name}" if node.module else a.name for a in node.names}
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                return self.function(node)
            case ast.ClassDef():
                return self.klass(node)
            case ast.Call() if self.open is not None:
                names, whole = _dotted(node.func)
                if whole:
                    self.open["calls"].append(".".join(names))
            case ast.Assign() if self.open is not None:
                self.open["assignments"] += [t.id for t in node.targets if isinstance(t, ast.Name)]
        self.below(node)

    def row(self, kind: str, name: str, node) -> dict:
        decorators = [d.func if isinstance(d, ast.Call) else d for d in node.decorator_list]
        return _element(
            kind, name, self.path, ast.get_source_segment(self.source, node) or "", docstring=ast.get_docstring(node) or "",
            decorators=[d.id for d in decorators if isinstance(d, ast.Name)], dependencies=[d for d in self.imports.values() if d.startswith(self.project)],
        )

    def function(self, node) -> None:
        owner = self.owner
        name = ".".join(x for x in (self.module, owner, node.name) if x)
        row = self.row("method" if owner else "function", name, node)
        row |= {"parameters": _params([(a.arg, annotation(a.annotation) if a.annotation else "Any") for a in node.args.args]),
                "return_type": annotation(node.returns) if node.returns else None, "is_async": isinstance(node, ast.AsyncFunctionDef)}
        self.open = row
        self.below(node)
        self.open = None  # so what follows a nested function belongs to none
        if owner is None:
            self.found.append(row)
        for e in self.found if owner else ():
            if e["type"] == "class" and e["name"].endswith(f".{owner}"):
                e["methods"].append(name)

    def klass(self, node: ast.ClassDef) -> None:
        before, self.owner = self.owner, node.name
        row = self.row("class", f"{self.module}.{node.name}", node)
        row["base_classes"] = [".".join(_dotted(b)[0]) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute)) and _dotted(b)[1]]
        self.found.append(row)
        self.below(node)
        self.owner = before


def parse_ast(source: str, path: str, project: str = "") -> list[dict]:
    """Classes and functions, nested ones included; methods are names in their class."""
    walk = _Walk(source, path, project)
    walk.see(ast.parse(source))
    return walk.found


Parser = Callable[[str, str, str], list[dict]]
PARSERS: dict[str, Parser] = {"tree-sitter": parse_tree, "ast": parse_ast}


def get_parser(kind: str) -> Parser:
    if kind not in PARSERS:
        raise ValueError(f"unknown parser {kind!r}; known: {', '.join(sorted(PARSERS))}")
    return PARSERS[kind]


_KINDS = {
    "type": pa.string(), "name": pa.string(), "docstring": pa.string(), "code": pa.string(), "file_path": pa.string(),
    "parameters": pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("default", pa.string())])), "return_type": pa.string(),
    **{c: pa.list_(pa.string()) for c in LISTS}, "explanation": pa.string(), "is_async": pa.bool_(), "error": pa.string(),
}
DDL = (
    "type string, name string, docstring string, code string, file_path string, parameters array<struct<name: string, type: string, default: string>>, "
    "return_type string, decorators array<string>, dependencies array<string>, base_classes array<string>, methods array<string>, calls array<string>, "
    "assignments array<string>, explanation string, is_async boolean, error string"
)


def parse_files(files: DataFrame, parser: str = "tree-sitter", project: str = "") -> DataFrame:
    """Elements of files (file_path, source) with their id; a file that fails has one row with an error instead.

    A null source counts as empty; an empty file has no rows.
    """
    parse, schema = get_parser(parser), pa.schema(list(_KINDS.items()))

    def run(batches):
        for b in batches:
            rows: list[dict] = []
            for path, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    found = parse(source or "", path or "", project)
                    for e in found:
                        e |= {c: sorted(set(e[c])) for c in ("dependencies", "calls", "assignments")}
                    rows += [e | {"error": None} for e in found]
                except (SyntaxError, ValueError, RecursionError, tokenize.TokenError) as e:
                    rows.append(dict.fromkeys(_KINDS) | {"file_path": path, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema)

    made = files.select("file_path", "source").mapInArrow(run, DDL)
    key = F.when(F.col("error").isNull(), X.element_id(F.col("type"), F.col("name"), F.col("file_path")))
    return made.select(key.alias("id"), "*")
