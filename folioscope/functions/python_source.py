"""Symbols of one Python file, as flat records. The only per-row Python of the package."""

from __future__ import annotations

import ast

EMPTY = {
    "record": None, "name": None, "parent": None, "kind": None, "docstring": None, "line_number": None,
    "signature": None, "is_async": None, "is_static": None, "is_class": None, "is_private": None,
    "parameters": None, "parameter_types": None, "return_type": None, "decorators": None,
    "base_classes": None, "variables": None, "constants": None, "import_name": None,
    "imported_names": None, "error": None,
}


def _annotation(node) -> str:
    return "" if node is None else ast.unparse(node).strip("'\"")


def _called(node) -> str:
    return ast.unparse(node.func if isinstance(node, ast.Call) else node)


def _literal_type(value) -> str:
    if isinstance(value, ast.Constant):
        known = {bool: "bool", str: "str", int: "int", float: "float", type(None): "None"}
        return known.get(type(value.value), "Any")
    if isinstance(value, ast.Name):
        return value.id
    if isinstance(value, ast.Call):
        return ast.unparse(value.func)
    if isinstance(value, (ast.List, ast.Dict, ast.Tuple, ast.Set)):
        return type(value).__name__.lower()
    return "Any"


def _arguments(args) -> list:
    """(mark, argument): positional, *args, **kwargs, then keyword-only."""
    listed = [("", a) for a in args.args]
    listed += [("*", args.vararg)] if args.vararg else []
    listed += [("**", args.kwarg)] if args.kwarg else []
    return listed + [("", a) for a in args.kwonlyargs]


def _signature(node) -> str:
    shown = [
        mark + a.arg + (f": {_annotation(a.annotation)}" if a.annotation else "")
        for mark, a in _arguments(node.args)
    ]
    tail = f" -> {_annotation(node.returns)}" if node.returns else ""
    return f"{node.name}({', '.join(shown)}){tail}"


def _assigned(body) -> dict:
    """Names assigned directly in a body, with annotated or inferred type."""
    found = {}
    for item in body:
        if isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name):
            found[item.target.id] = _annotation(item.annotation)
        elif isinstance(item, ast.Assign):
            for target in item.targets:
                if isinstance(target, ast.Name):
                    found[target.id] = _literal_type(item.value)
    return found


def _definitions(node, parent, in_class):
    """(definition, enclosing name, directly in a class?) of everything below a node."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield child, parent, in_class
            yield from _definitions(child, child.name, isinstance(child, ast.ClassDef))
        else:
            yield from _definitions(child, parent, in_class)


def _symbol(node, parent, in_class) -> dict:
    decorators = [_called(d) for d in node.decorator_list]
    common = {
        "record": "symbol", "name": node.name, "parent": parent, "docstring": ast.get_docstring(node),
        "line_number": node.lineno, "is_private": node.name.startswith("_"), "decorators": decorators,
    }
    if isinstance(node, ast.ClassDef):
        return common | {
            "kind": "class",
            "base_classes": [ast.unparse(b) for b in node.bases],
            "variables": _assigned(node.body),
        }
    kind = ("property" if "property" in decorators else "method") if in_class else "function"
    return common | {
        "kind": kind,
        "signature": _signature(node),
        "is_async": isinstance(node, ast.AsyncFunctionDef),
        "is_static": "staticmethod" in decorators,
        "is_class": "classmethod" in decorators,
        "parameters": [a.arg for a in node.args.args],
        "parameter_types": {
            a.arg: _annotation(a.annotation) for _, a in _arguments(node.args) if a.annotation
        },
        "return_type": _annotation(node.returns),
    }


def records(source: str) -> list[dict]:
    """Module, symbol and import records of a file, or one error record."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        return [EMPTY | {"record": "error", "error": str(e)}]
    names = _assigned(tree.body)
    out = [
        {
            "record": "module",
            "docstring": ast.get_docstring(tree),
            "constants": {k: v for k, v in names.items() if k.isupper()},
            "variables": {k: v for k, v in names.items() if not k.isupper()},
        }
    ]
    out += [_symbol(*found) for found in _definitions(tree, None, False)]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [{"record": "import", "import_name": a.name, "line_number": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            out.append(
                {
                    "record": "import",
                    "import_name": node.module,
                    "imported_names": [a.name for a in node.names],
                    "line_number": node.lineno,
                }
            )
    return [EMPTY | r for r in out]
