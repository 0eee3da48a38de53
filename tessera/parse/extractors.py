"""The extractors: one parse of a file, rows of observations and diagnostics."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from .. import __version__
from ..schema import PARSED
from . import css, tsx
from .resolve import js_text, property_name, resolve

#: The packages whose tagged templates hold CSS, and the class combiners.
CSS_IN_JS = ("styled-components", "@emotion/styled", "@emotion/react", "@emotion/core")
COMBINERS = ("cn", "clsx", "classnames", "classNames", "twMerge", "cx", "tw")
PLACEHOLDER = "INTERPOLATION_"
_HOLE = re.compile(PLACEHOLDER + r"\d+")
_CLASS_LIKE = re.compile(r"[-:/\[]")
_EMPTY = dict.fromkeys(PARSED.names)


@dataclass(frozen=True)
class Options:
    css_source: str = "plain-css"
    sources: tuple[str, ...] = ()
    combiners: tuple[str, ...] = ()
    extractors: tuple[str, ...] = ("jsx", "css", "inline-style", "styled", "tailwind")


@dataclass
class Context:
    """What an extractor sees of a file, and where its rows go."""

    file: str
    code: str
    options: Options
    producer: str = ""
    rows: list[dict] = field(default_factory=list)
    imports: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.lines = css.Lines(self.code)

    def loc(self, node) -> dict:
        return self.lines.span(node.start, node.end)

    def text(self, node) -> str:
        return self.code[node.start : node.end]

    def emit(self, kind: str, source: str, loc: dict, **values) -> None:
        self.rows.append({**_EMPTY, "rec": "obs", "file": self.file, "producer": self.producer, "kind": kind, "source": source, "loc": loc, **values})

    def diagnostic(self, reason: str, loc: dict | None = None, kind: str | None = None, message: str | None = None) -> None:
        self.rows.append({**_EMPTY, "rec": "diag", "file": self.file, "producer": self.producer, "kind": kind, "loc": loc, "reason": reason, "message": message})

    def tokenize(self, text: str) -> list[str]:
        """The class tokens of a text."""
        return [t for t in re.split(r"[\s\ufeff]+", text) if t]

    def resolve(self, node: tsx.Node, scope=None, hops: int = 1):
        """The static value of an expression (see parse.resolve)."""
        return resolve(node, scope if scope is not None else getattr(node, "scope", None), hops)

    def parse_css(self, text: str) -> list[css.Declaration]:
        """The declarations of a stylesheet's text; raises css.CssError."""
        return css.parse(text)

    def element(self, node: tsx.Node) -> dict:
        """What identifies a JSX element: every row that hangs on it carries this."""
        source = None if node.dom else self.imports.get(node.base)
        return {"name": node.name, "imported_from": source, "is_dom": node.dom, "loc": self.loc(node)}


def _sheet(root: list[css.Declaration], ctx: Context) -> None:
    for d in root:
        ctx.emit("css.declaration", ctx.options.css_source, ctx.loc(d), property=d.prop, selector=d.selector, media=d.media, raw=d.value, typed_as="sheet")


def _opening(program: tsx.Parser) -> Iterator[tsx.Node]:
    return (n for n in program.found if n.type == "JSXOpeningElement")


def _jsx(program: tsx.Parser, ctx: Context) -> None:
    for node in program.imports:
        if not node.specifiers:
            ctx.emit("import", "babel-jsx", ctx.loc(node), specifier=node.source, local="", import_kind="side-effect", raw=node.source, typed_as="module")
        for local, _, kind, start, end in node.specifiers:
            ctx.emit("import", "babel-jsx", ctx.lines.span(start, end), specifier=node.source, local=local, import_kind=kind, raw=node.source, typed_as="module")
    for node in _opening(program):
        element = ctx.element(node)
        ctx.emit("jsx.element", "babel-jsx", element["loc"], name=node.name, imported_from=element["imported_from"], is_dom=node.dom)
        kind = "jsx.attribute" if node.dom else "jsx.prop"
        for a in node.attributes:
            if a.type != "JSXAttribute":
                ctx.diagnostic("spread-attribute", ctx.loc(a), kind)
                continue
            names = {"owner": node.name, "attribute": a.name} if node.dom else {"component": node.name, "prop": a.name}
            ctx.emit(kind, "babel-jsx", ctx.loc(a), element=element, **names, **_attribute_value(a, ctx))


def _attribute_value(a: tsx.Node, ctx: Context) -> dict:
    v = a.value
    if v is None:
        return {"raw": "true", "typed_as": "keyword"}
    if v.type == "StringLiteral":
        return {"raw": v.value, "typed_as": "string"}
    if v.type != "JSXExpressionContainer" or v.expression is None:
        return {"raw": "", "typed_as": "dynamic", "reason": "empty-expression"}
    return _observed(v.expression, a.scope, ctx, "string", lambda x: {float: "number", bool: "keyword"}.get(type(x), "string"))


def _observed(node: tsx.Node, scope, ctx: Context, unknown_as: str, kind_of: Callable) -> dict:
    found = resolve(node, scope)
    if found.status == "literal":
        return {"raw": js_text(found.value), "typed_as": kind_of(found.value)}
    if found.status == "static-union":
        return {"raw": ctx.text(node), "typed_as": "union"}
    if found.status == "dynamic":
        return {"raw": ctx.text(node), "typed_as": "dynamic", "reason": found.reason}
    return {"raw": ctx.text(node), "typed_as": unknown_as, "hint": "unknown", "reason": found.reason}


def _inline(program: tsx.Parser, ctx: Context) -> None:
    for node in _opening(program):
        element = ctx.element(node)
        for a in node.attributes:
            if a.type != "JSXAttribute" or a.name != "style" or a.value is None or a.value.type != "JSXExpressionContainer":
                continue
            body = a.value.expression
            if body is None or body.type != "ObjectExpression":
                ctx.diagnostic("dynamic-style-object", ctx.loc(a), "css.declaration")
                continue
            for p in body.properties:
                if p.type != "ObjectProperty":
                    ctx.diagnostic("non-property-in-style", ctx.loc(p), "css.declaration")
                elif p.computed:
                    ctx.diagnostic("computed-style-key", ctx.loc(p), "css.declaration")
                elif p.key.type in ("Identifier", "StringLiteral"):
                    kind_of = lambda x: "inline-number" if isinstance(x, float) else "inline"
                    ctx.emit(
                        "css.declaration", "inline", ctx.loc(p), property=p.key.value, owner_component=node.name, element=element,
                        **_observed(p.value, a.scope, ctx, "keyword", kind_of),
                    )


def _styled(program: tsx.Parser, ctx: Context) -> None:
    sources = {*CSS_IN_JS, *ctx.options.sources}
    for node in program.found:
        if node.type != "TaggedTemplateExpression":
            continue
        tag = node.tag
        while tag.type == "CallExpression":
            tag = tag.callee
        if tag.type == "MemberExpression":
            tag = tag.object
        found = node.scope.find(tag.name) if tag.type == "Identifier" else None
        if found is None or found.kind != "module" or found.source not in sources:
            continue
        loc = ctx.loc(node)
        text = node.quasi.quasis[0] + "".join(f"{PLACEHOLDER}{i}{q}" for i, q in enumerate(node.quasi.quasis[1:]))
        try:
            root = css.parse(text)
        except css.CssError as e:
            ctx.diagnostic("styled-parse-error", loc, "css.declaration", str(e))
            continue
        for d in root:
            if _HOLE.search(d.prop):
                ctx.diagnostic("dynamic-styled-property", loc, "css.declaration")
                continue
            hole = bool(_HOLE.search(d.value))
            ctx.emit(
                "css.declaration", "css-in-js", loc, property=d.prop, selector=d.selector, media=d.media, owner_component=node.owner,
                raw=d.value, typed_as="dynamic" if hole else "css-in-js", reason="styled-interpolation" if hole else None,
            )


def _tailwind(program: tsx.Parser, ctx: Context) -> None:
    combiners = {*COMBINERS, *ctx.options.combiners}
    for node in program.found:
        if node.type == "JSXOpeningElement":
            for a in node.attributes:
                if a.type != "JSXAttribute" or a.name not in ("className", "class") or a.value is None:
                    continue
                tokens: list[tuple[str, bool]] = []
                if a.value.type == "StringLiteral":
                    _push(tokens, a.value.value, False)
                elif a.value.type == "JSXExpressionContainer" and a.value.expression is not None:
                    _collect(a.value.expression, False, a.scope, combiners, ctx, tokens)
                _classes(tokens, ctx.loc(a.value), ctx.element(node), ctx)
        elif node.type == "CallExpression" and node.callee.type == "Identifier" and node.callee.name == "cva":
            tokens = []
            for arg in node.arguments:
                if arg.type != "SpreadElement":
                    _collect(arg, True, node.scope, combiners, ctx, tokens)
            _classes(tokens, ctx.loc(node), None, ctx)


def _push(tokens: list, text: str, union: bool) -> None:
    tokens += [(t, union) for t in re.split(r"[\s\ufeff]+", text) if t]


def _classes(tokens: list[tuple[str, bool]], loc: dict, element: dict | None, ctx: Context) -> None:
    """One row for each token; a sure one beats a conditional one."""
    strongest: dict[str, bool] = {}
    for t, union in tokens:
        strongest[t] = strongest.get(t, True) and union
    for t, union in strongest.items():
        ctx.emit("css.class", "tailwind", loc, token=t, element=element, raw=t, typed_as="class", hint="static-union" if union else None)


def _collect(node: tsx.Node, union: bool, scope, combiners: set[str], ctx: Context, out: list) -> None:
    kind = node.type
    again = lambda n, u: _collect(n, u, scope, combiners, ctx, out)
    if kind == "StringLiteral":
        _push(out, node.value, union)
    elif kind == "TemplateLiteral":
        for q in node.quasis:
            _push(out, q, union)
        if node.expressions:
            ctx.diagnostic("dynamic-classname-segment", ctx.loc(node), "css.class")
    elif kind == "ConditionalExpression":
        again(node.yes, True)
        again(node.no, True)
    elif kind == "LogicalExpression":
        again(node.left, True)
        again(node.right, True)
    elif kind == "ArrayExpression":
        for e in node.elements:
            if e is not None and e.type != "SpreadElement":
                again(e, union)
    elif kind == "ObjectExpression":
        for p in node.properties:
            if p.type == "ObjectProperty":
                key = property_name(p)
                if key is not None and _CLASS_LIKE.search(key):
                    _push(out, key, True)
                again(p.value, True)
    elif kind == "CallExpression":
        if node.callee.type == "Identifier" and node.callee.name in combiners:
            for arg in node.arguments:
                if arg.type != "SpreadElement":
                    again(arg, union)
        else:
            ctx.diagnostic("dynamic-classname-call", ctx.loc(node), "css.class")
    elif kind == "Identifier":
        found = resolve(node, scope)
        if found.status == "literal" and isinstance(found.value, str):
            _push(out, found.value, union)
        elif found.status == "static-union":
            for v in found.values:
                if isinstance(v, str):
                    _push(out, v, True)
        else:
            ctx.diagnostic("dynamic-classname" if found.status == "dynamic" else "unknown-classname", ctx.loc(node), "css.class")
    else:
        ctx.diagnostic("dynamic-classname", ctx.loc(node), "css.class")


#: Name -> (language, function). register() adds more.
REGISTRY: dict[str, tuple[str, Callable]] = {
    "jsx": ("program", _jsx),
    "css": ("sheet", _sheet),
    "inline-style": ("program", _inline),
    "styled": ("program", _styled),
    "tailwind": ("program", _tailwind),
}


def register(name: str, language: str, function: Callable) -> None:
    """Add an extractor: function(parsed file, context) for language sheet or program."""
    if language not in ("sheet", "program"):
        raise ValueError("language is sheet or program")
    REGISTRY[name] = (language, function)


def producer(name: str) -> str:
    return f"tessera-{name}@{__version__}"


def chosen_extractors(options: Options) -> dict[str, tuple[str, Callable]]:
    """The registered extractors that the options name, to be sent along to where files are parsed."""
    if missing := [n for n in options.extractors if n not in REGISTRY]:
        raise ValueError(f"no such extractors: {missing}")
    return {n: REGISTRY[n] for n in options.extractors}


def extract_file(file: str, code: str, options: Options = Options(), registry: dict[str, tuple[str, Callable]] | None = None) -> list[dict]:
    """All rows of one file; a file of another kind has none, and no error escapes."""
    low = file.lower()
    language = "sheet" if low.endswith(".css") else "program" if low.endswith((".tsx", ".ts")) else None
    chosen = [(n, f) for n, (kind, f) in (registry or chosen_extractors(options)).items() if kind == language]
    if not chosen:
        return []
    code = code.removeprefix("\ufeff")
    ctx = Context(file, code, options, "core")
    try:
        parsed = css.parse(code) if language == "sheet" else tsx.parse(code)
    except (css.CssError, tsx.TsxError) as e:
        ctx.diagnostic("parse-error", message=str(e))
        return ctx.rows
    if language == "program":
        for node in parsed.imports:
            for local, *_ in node.specifiers:
                ctx.imports[local] = node.source
    for name, function in chosen:
        ctx.producer = producer(name)
        try:
            function(parsed, ctx)
        except Exception as e:  # an extractor must not stop the file
            ctx.diagnostic("plugin-error", message=str(e))
    return ctx.rows
