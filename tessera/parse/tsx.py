"""A recursive-descent parser for the parts of TypeScript and JSX that facts come from.

Types are skipped, statements are read for their scopes, and expressions become
nodes under the names of the ESTree/Babel family, since those names show in
diagnostics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_BLANK = re.compile(r"(?:\s|\ufeff|//[^\n\r\u2028\u2029]*|/\*.*?\*/)*", re.S)
_NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]*", re.U)
_JSX_NAME = re.compile(r"[^\W\d$][\w$-]*|\$[\w$-]*")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_STRING = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\(?:\r\n|.))*){q}", re.S) for q in "'\""}
_SURROGATE = re.compile("[\ud800-\udfff]")
_ESCAPE = re.compile(r"\\(u\{[\da-fA-F]+\}|u[\da-fA-F]{4}|x[\da-fA-F]{2}|\r\n|.)", re.S)
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
#: What decides by one character, at most places of a text: no blank begins with it, no other sign does, no sign at all does, no name does.
_SOLID = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$!\"#%&'()*+,-.:;<=>?@[\\]^`{|}~") | {""}
_SINGLE = frozenset("{}()[];,~:@#")
_NO_SIGN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$\"'`\\") | {""}
_NO_NAME = frozenset("0123456789!\"#%&'()*+,-./:;<=>?@[\\]^`{|}~") | {""}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r": ""}
_PRECEDENCE = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8,
    ">=": 8, "instanceof": 8, "in": 8, "as": 8, "satisfies": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11,
    "/": 11, "%": 11, "**": 12,
}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}


class TsxError(ValueError):
    pass


class Node:
    def __init__(self, type: str, start: int, end: int, **parts):
        self.type, self.start, self.end = type, start, end
        self.__dict__.update(parts)


class Scope:
    def __init__(self, parent: Scope | None, function: bool = False):
        self.parent, self.function, self.names = parent, function or parent is None, {}

    def find(self, name: str):
        scope = self
        while scope is not None:
            if name in scope.names:
                return scope.names[name]
            scope = scope.parent
        return None


class Binding:
    def __init__(self, kind: str, init: Node | None, scope: Scope, source: str | None = None):
        self.kind, self.init, self.scope, self.source = kind, init, scope, source


def unescape(body: str) -> str:
    if "\\" not in body and not _SURROGATE.search(body):
        return body

    def one(m: re.Match) -> str:
        e = m.group(1)
        if e[0] == "u":
            return chr(int(e[2:-1] if e[1] == "{" else e[1:], 16))
        if e[0] == "x":
            return chr(int(e[1:], 16))
        return _ESCAPES.get(e, "" if e == "\r\n" else e)

    out = _ESCAPE.sub(one, body)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if _SURROGATE.search(out) else out


class Parser:
    def __init__(self, code: str):
        self.code, self.at, self.scope = code, 0, Scope(None)
        self.imports: list[Node] = []
        self.found: list[Node] = []  # JSX elements, calls and tagged templates in source order
        self.owners: list[str | None] = []
        self.read_at, self.read = -1, ""  # the last name read, and where

    # -- tokens ----------------------------------------------------------
    def blank(self) -> bool:
        """Skip blanks and comments; whether a line ended."""
        if self.code[self.at : self.at + 1] in _SOLID:
            return False
        m = _BLANK.match(self.code, self.at)
        self.at = m.end()
        return "\n" in m.group()

    def peek(self) -> str:
        if (c := self.code[self.at : self.at + 1]) not in _SOLID:
            self.blank()
            c = self.code[self.at : self.at + 1]
        if c in _SINGLE:
            return c
        if c in _NO_SIGN:
            return ""
        m = _PUNCT.match(self.code, self.at)
        return m.group() if m else ""

    def word(self) -> str:
        if (c := self.code[self.at : self.at + 1]) not in _SOLID:
            self.blank()
            c = self.code[self.at : self.at + 1]
        if c in _NO_NAME:
            return ""
        if self.read_at != self.at:
            m = _NAME.match(self.code, self.at)
            self.read_at, self.read = self.at, m.group() if m else ""
        return self.read

    def take(self, text: str) -> bool:
        if self.code[self.at : self.at + 1] not in _SOLID:
            self.blank()
        if self.code.startswith(text, self.at) and (not text[0].isalpha() or self.word() == text):
            self.at += len(text)
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise self.error(f"expected {text}")

    def error(self, what: str) -> TsxError:
        return TsxError(f"{what} at offset {self.at}")

    def name(self) -> str:
        w = self.word()
        if not w:
            raise self.error("expected a name")
        self.at += len(w)
        return w

    def string(self) -> Node:
        start, quote = self.at, self.code[self.at]
        m = _STRING[quote].match(self.code, start) if quote in _STRING else None
        if not m:
            raise self.error("unterminated string")
        self.at = m.end()
        return Node("StringLiteral", start, self.at, value=unescape(m.group(1)))

    def template(self) -> Node:
        start = self.at
        self.at += 1
        quasis, expressions, begin = [], [], self.at
        while True:
            if self.at >= len(self.code):
                raise self.error("unterminated template")
            c = self.code[self.at]
            if c == "\\":
                self.at += 2
            elif c == "`":
                quasis.append(unescape(self.code[begin : self.at].replace("\r\n", "\n")))
                self.at += 1
                return Node("TemplateLiteral", start, self.at, quasis=quasis, expressions=expressions)
            elif self.code.startswith("${", self.at):
                quasis.append(unescape(self.code[begin : self.at].replace("\r\n", "\n")))
                self.at += 2
                expressions.append(self.expression())
                self.need("}")
                begin = self.at
            else:
                self.at += 1

    def attempt(self, read):
        """What ``read`` returns, or None with the place restored."""
        at, scope, found, owners = self.at, self.scope, len(self.found), len(self.owners)
        try:
            return read()
        except TsxError:
            self.at, self.scope = at, scope
            del self.found[found:], self.owners[owners:]
            return None

    # -- types (skipped) -------------------------------------------------
    def type(self) -> None:
        self.take("|") or self.take("&")
        self.type_unary()
        while True:
            if self.take("|") or self.take("&"):
                self.type_unary()
            elif self.word() == "extends":
                self.take("extends")
                self.type_unary()
                if self.take("?"):
                    self.type()
                    self.need(":")
                    self.type()
            elif self.word() == "is":
                self.take("is")
                self.type()
            else:
                return

    def type_unary(self) -> None:
        w = self.word()
        if w in ("keyof", "readonly", "unique", "infer", "asserts", "abstract") and not re.match(rf"{w}\s*[,;)>\]}}=|&]", self.code[self.at :]):
            self.take(w)
            return self.type_unary()
        self.type_primary()
        while True:
            if self.code[self.at : self.at + 1] == "[" or self.peek() == "[":
                if "\n" in _BLANK.match(self.code, self.at).group():
                    return
                self.balanced("[", "]")
            elif self.peek() == "." and self.take("."):
                self.name()
            elif self.peek() == "<":
                self.type_arguments()
            else:
                return

    def type_primary(self) -> None:
        p, w = self.peek(), self.word()
        if w == "new":
            self.take("new")
            return self.type_primary()
        if w in ("typeof", "import"):
            self.at += len(w)
            if self.peek() == "(":
                self.balanced("(", ")")
            elif w == "typeof":
                self.type_primary()
            return
        if w:
            self.at += len(w)
            return
        if p == "<":
            self.type_arguments()
            return self.type_primary()
        if p == "(":
            self.balanced("(", ")")
            if self.take("=>"):
                self.type()
            return
        if p in ("{", "["):
            return self.balanced(p, "}" if p == "{" else "]")
        if p == "-":
            self.at += 1
            self.blank()
        c = self.code[self.at : self.at + 1]
        if c in ("'", '"') and c:
            self.string()
        elif c == "`":
            self.template()
        elif m := _NUMBER.match(self.code, self.at):
            self.at = m.end()
        else:
            raise self.error("expected a type")

    def balanced(self, left: str, right: str) -> None:
        self.need(left)
        depth = 1
        while depth:
            self.blank()
            c = self.code[self.at : self.at + 1]
            if not c:
                raise self.error(f"missing {right}")
            if c in "'\"":
                self.string()
            elif c == "`":
                self.template()
            else:
                depth += (c in "([{") - (c in ")]}")
                self.at += 1

    def type_arguments(self) -> None:
        self.need("<")
        while not self.take(">"):
            if self.word() in ("const", "in", "out") and re.match(r"\w+\s+\w", self.code[self.at :]):
                self.name()
            self.type()
            if self.take("="):
                self.type()
            if not self.take(","):
                self.need(">")
                return

    # -- statements ------------------------------------------------------
    def program(self) -> Parser:
        if self.code.startswith("#!"):
            self.at = self.code.find("\n") + 1 or len(self.code)
        while True:
            self.blank()
            if self.at >= len(self.code):
                return self
            self.statement()

    def end(self) -> None:
        """A semicolon, or a place where one may be left out."""
        line = self.blank()
        if self.take(";") or line or self.at >= len(self.code) or self.code[self.at] == "}":
            return
        raise self.error("unexpected token")

    def block(self, scope: Scope | None = None) -> None:
        self.need("{")
        outer, self.scope = self.scope, scope or Scope(self.scope)
        while not self.take("}"):
            if self.at >= len(self.code):
                raise self.error("missing }")
            self.statement()
        self.scope = outer

    def statement(self) -> None:
        p, w = self.peek(), self.word()
        if p == "{":
            return self.block()
        if p == ";":
            self.at += 1
            return None
        if p == "@":
            self.at += 1
            self.unary()
            return None
        rest = self.code[self.at + len(w) :]
        if w == "import" and not re.match(r"\s*[(.]", rest):
            return self.import_declaration()
        if w == "export":
            return self.export()
        if w in ("const", "let", "var") or (w == "using" and re.match(r"\s+[\w$]+\s*=", rest)):
            if w == "const" and re.match(r"\s+enum\b", rest):
                self.take("const")
                return self.statement()
            self.declarations()
            return self.end()
        if w == "function" or (w == "async" and re.match(r"[ \t]+function\b", rest)):
            self.function(True)
            return None
        if w == "class" or (w == "abstract" and re.match(r"\s+class\b", rest)):
            self.take("abstract")
            self.class_(True)
            return None
        if w == "type" and re.match(r"[ \t]+[\w$]+\s*[=<]", rest):
            self.take("type")
            self.bind(self.name(), "type", None)
            if self.peek() == "<":
                self.type_arguments()
            self.need("=")
            self.type()
            return self.end()
        if w == "interface" and re.match(r"\s+[\w$]+", rest):
            self.take("interface")
            self.bind(self.name(), "type", None)
            while self.peek() != "{":
                if self.peek() == "<":
                    self.type_arguments()
                elif not (self.take("extends") or self.take(",")):
                    self.type()
            self.balanced("{", "}")
            return None
        if w == "enum" and re.match(r"\s+[\w$]+\s*\{", rest):
            self.take("enum")
            self.bind(self.name(), "let", None)
            return self.balanced("{", "}")
        if w in ("namespace", "module") and re.match(r"\s+['\"\w$.]+\s*\{", rest):
            self.take(w)
            self.at = self.code.index("{", self.at)
            return self.block()
        if w == "declare" and re.match(r"[ \t]+\w", rest):
            self.take("declare")
            if self.take("global"):
                return self.block()
            if self.word() in ("function",):
                self.attempt(lambda: self.function(True)) or self.skip_line()
                return None
            if self.word() in ("const", "let", "var", "module", "namespace") and self.word() in ("module", "namespace"):
                self.name()
                self.unary()
                return self.balanced("{", "}") if self.peek() == "{" else None
            return self.statement()
        if w == "if" or w == "while" or w == "with":
            self.take(w)
            self.need("(")
            self.expression()
            self.need(")")
            self.statement()
            if w == "if" and self.word() == "else":
                self.take("else")
                self.statement()
            return None
        if w == "for":
            return self.for_()
        if w == "do":
            self.take("do")
            self.statement()
            self.need("while")
            self.need("(")
            self.expression()
            self.need(")")
            self.take(";")
            return None
        if w == "switch":
            return self.switch()
        if w == "try":
            return self.try_()
        if w in ("return", "throw", "break", "continue", "debugger"):
            self.take(w)
            line = self.blank()
            if not line and self.peek() not in (";", "}") and self.at < len(self.code):
                self.expression()
            return self.end()
        if w and re.match(r"\s*:(?!:)", rest) and w not in ("default", "case"):
            self.take(w)
            self.need(":")
            return self.statement()
        self.expression()
        return self.end()

    def skip_line(self) -> None:
        end = self.code.find(";", self.at)
        self.at = end + 1 if end >= 0 else len(self.code)

    def for_(self) -> None:
        self.take("for")
        self.take("await")
        self.need("(")
        outer, self.scope = self.scope, Scope(self.scope)
        if self.word() in ("const", "let", "var"):
            self.declarations(loop=True)
        elif self.peek() != ";":
            self.expression(no_in=True)
        if self.word() in ("of", "in"):
            self.name()
            self.expression()
        else:
            self.need(";")
            if self.peek() != ";":
                self.expression()
            self.need(";")
            if self.peek() != ")":
                self.expression()
        self.need(")")
        self.statement()
        self.scope = outer

    def switch(self) -> None:
        self.take("switch")
        self.need("(")
        self.expression()
        self.need(")")
        self.need("{")
        outer, self.scope = self.scope, Scope(self.scope)
        while not self.take("}"):
            if self.take("case"):
                self.expression()
                self.need(":")
            elif self.take("default"):
                self.need(":")
            elif self.at >= len(self.code):
                raise self.error("missing }")
            else:
                self.statement()
        self.scope = outer

    def try_(self) -> None:
        self.take("try")
        self.block()
        if self.take("catch"):
            scope = Scope(self.scope)
            if self.take("("):
                outer, self.scope = self.scope, scope
                self.pattern("let", None)
                if self.take(":"):
                    self.type()
                self.scope = outer
                self.need(")")
            self.block(scope)
        if self.take("finally"):
            self.block()

    def import_declaration(self) -> None:
        self.blank()
        start = self.at
        self.need("import")
        specifiers, types = [], False
        self.blank()
        if self.code[self.at] in "'\"":
            source = self.string()
        elif re.match(r"(?:type\s+)?[\w$]+\s*=\s*", self.code[self.at :]) and not re.match(r"type\s*=", self.code[self.at :]):
            self.at = self.code.index("=", self.at) + 1
            self.expression()
            return self.end()
        else:
            if self.word() == "type" and re.match(r"type\s+(?!from\b|,)[\w${*]", self.code[self.at :]):
                self.take("type")
                types = True
            while self.word() != "from":
                p = self.peek()
                if p == "{":
                    self.at += 1
                    while not self.take("}"):
                        self.blank()
                        at = self.at
                        if self.word() == "type" and re.match(r"type\s+(?!as\b)[\w$'\"]|type\s+as\s+as\b", self.code[self.at :]):
                            self.take("type")
                        imported = self.string().value if self.code[self.at] in "'\"" else self.name() if self.word() else self.string().value
                        local, end = imported, self.at
                        if self.take("as"):
                            local = self.name()
                            end = self.at
                        specifiers.append((local, imported, "named", at, end))
                        if not self.take(","):
                            self.need("}")
                            break
                elif p == "*":
                    at = self.at
                    self.at += 1
                    self.need("as")
                    specifiers.append((self.name(), "*", "namespace", at, self.at))
                elif self.word():
                    at = self.at
                    specifiers.append((self.name(), "default", "default", at, self.at))
                else:
                    raise self.error("unexpected token in import")
                if not self.take(","):
                    break
            self.need("from")
            self.blank()
            source = self.string()
        if self.word() in ("with", "assert") and re.match(r"\w+\s*\{", self.code[self.at :]):
            self.name()
            self.balanced("{", "}")
        end = self.at
        self.end()
        if self.code[end : self.at].strip().startswith(";"):
            end = self.code.index(";", end) + 1
        self.imports.append(Node("ImportDeclaration", start, end, source=source.value, specifiers=specifiers, types=types))
        for local, *_ in specifiers:
            self.scope.names[local] = Binding("module", None, self.scope, source.value)

    def export(self) -> None:
        self.need("export")
        w, p = self.word(), self.peek()
        if p == "{" or (w == "type" and re.match(r"type\s*[{*]", self.code[self.at :])):
            self.take("type")
            if self.take("*"):
                return self.export_from()
            self.balanced("{", "}")
            if self.word() == "from":
                return self.export_from()
            return self.end()
        if p == "*":
            self.at += 1
            return self.export_from()
        if p == "=":
            self.at += 1
            self.expression()
            return self.end()
        if w == "as":
            self.take("as")
            self.take("namespace")
            self.name()
            return self.end()
        if w == "default":
            self.take("default")
            w = self.word()
            if w == "function" or (w == "async" and re.match(r"async[ \t]+function\b", self.code[self.at :])):
                self.function(True)
            elif w in ("class", "abstract"):
                self.take("abstract")
                self.class_(True)
            elif w == "interface":
                self.statement()
            else:
                self.assignment()
                self.end()
            return None
        return self.statement()

    def export_from(self) -> None:
        if self.take("as"):
            self.name()
        self.need("from")
        self.blank()
        self.string()
        if self.take("with"):
            self.balanced("{", "}")
        self.end()

    # -- bindings --------------------------------------------------------
    def bind(self, name: str, kind: str, init: Node | None) -> None:
        scope = self.scope
        if kind == "var":
            while not scope.function:
                scope = scope.parent
        if not (kind == "type" and name in scope.names):
            scope.names[name] = Binding(kind, init, scope)

    def pattern(self, kind: str, init: Node | None) -> list[str]:
        """Read a binding pattern; its names are bound, and returned."""
        names = []
        if self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    names += self.pattern(kind, init)
                else:
                    key = self.property_key()
                    if self.take(":"):
                        names += self.pattern(kind, init)
                    else:
                        names.append(key.value)
                        self.bind(key.value, kind, init)
                    if self.take("="):
                        self.assignment()
                if not self.take(","):
                    self.need("}")
                    break
        elif self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                names += self.pattern(kind, init)
                if not self.take(","):
                    self.need("]")
                    break
        else:
            name = self.name()
            names.append(name)
            self.bind(name, kind, init)
        if kind == "param" or not init:
            if self.peek() == "=" and kind == "param":
                self.take("=")
                self.assignment()
        elif self.peek() == "=" and kind not in ("const", "let", "var"):
            self.take("=")
            self.assignment()
        return names

    def declarations(self, loop: bool = False) -> None:
        kind = self.name()
        kind = "const" if kind == "using" else kind
        while True:
            self.blank()
            simple = bool(self.word())
            names = self.pattern(kind, None)
            self.take("!")
            if self.take(":"):
                self.type()
            if self.peek() == "=":
                self.take("=")
                self.owners.append(names[0] if simple else None)
                init = self.assignment(no_in=loop)
                self.owners.pop()
                for n in names:
                    if (b := self.scope.find(n)) is not None and b.kind == kind:
                        b.init = init
            if not self.take(","):
                return

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            while self.take("@"):
                self.unary()
            while self.word() in ("public", "private", "protected", "readonly", "override") and re.match(r"\w+\s+[\w${\[]", self.code[self.at :]):
                self.name()
            self.take("...")
            self.binding_element()
            if not self.take(","):
                self.need(")")
                return

    def binding_element(self) -> None:
        names = self.pattern("param", None)
        del names
        self.take("?")
        if self.take(":"):
            self.type()
        if self.peek() == "=":
            self.take("=")
            self.assignment()

    def function(self, declared: bool) -> Node:
        self.blank()
        start = self.at
        self.take("async")
        self.need("function")
        self.take("*")
        name = self.name() if self.word() else None
        if name and declared:
            self.bind(name, "hoisted", None)
        outer = self.scope
        self.scope = Scope(outer, True)
        if name and not declared:
            self.bind(name, "local", None)
        self.function_rest()
        self.scope = outer
        return Node("FunctionExpression", start, self.at)

    def function_rest(self) -> None:
        if self.peek() == "<":
            self.type_arguments()
        self.parameters()
        if self.take(":"):
            self.type()
        if self.peek() == "{":
            self.block(self.scope)
        else:
            self.end()

    def class_(self, declared: bool) -> Node:
        self.blank()
        start = self.at
        self.need("class")
        if self.word() and self.word() not in ("extends", "implements"):
            name = self.name()
            if declared:
                self.bind(name, "let", None)
        if self.peek() == "<":
            self.type_arguments()
        if self.take("extends"):
            self.unary()
            if self.peek() == "<":
                self.type_arguments()
        if self.take("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        while not self.take("}"):
            if self.at >= len(self.code):
                raise self.error("missing }")
            self.member()
        return Node("ClassExpression", start, self.at)

    def member(self) -> None:
        if self.take(";"):
            return
        while self.take("@"):
            self.unary()
        modifiers = ("static", "public", "private", "protected", "readonly", "override", "abstract", "declare", "async", "get", "set", "accessor")
        while self.word() in modifiers and not re.match(r"\w+\s*[(=:;?!<,}]", self.code[self.at :]):
            self.name()
            if self.peek() == "{":
                return self.block(Scope(self.scope, True))
        self.take("*")
        if self.peek() == "[" and re.match(r"\[\s*[\w$]+\s*:", self.code[self.at :]):
            self.balanced("[", "]")
        else:
            self.property_key()
        self.take("?") or self.take("!")
        outer = self.scope
        self.scope = Scope(outer, True)
        if self.peek() in ("(", "<"):
            self.function_rest()
            self.scope = outer
            return
        if self.take(":"):
            self.type()
        if self.take("="):
            self.assignment()
        self.scope = outer
        self.end()

    # -- expressions -----------------------------------------------------
    def expression(self, no_in: bool = False) -> Node:
        first = self.assignment(no_in)
        if self.peek() != ",":
            return first
        while self.take(","):
            last = self.assignment(no_in)
        return Node("SequenceExpression", first.start, last.end)

    def arrow(self) -> Node | None:
        """An arrow function, if one begins here."""
        self.blank()
        at, code = self.at, self.code
        w = self.word()
        if w and re.match(r"(?:async\s+)?[\w$]+\s*=>", code[at:]):
            if w == "async" and not re.match(r"async\s*=>", code[at:]):
                self.take("async")
            outer, self.scope = self.scope, Scope(self.scope, True)
            self.bind(self.name(), "param", None)
            return self.arrow_rest(at, outer)
        if not re.match(r"(?:async\s*)?(?:<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b|=)|\()", code[at:]):
            return None

        def read():
            outer = self.scope
            if self.word() == "async":
                self.take("async")
            self.scope = Scope(outer, True)
            if self.peek() == "<":
                self.type_arguments()
            self.parameters()
            if self.take(":"):
                self.type()
            if "\n" in _BLANK.match(code, self.at).group() or self.peek() != "=>":
                raise self.error("no arrow")
            return outer

        outer = self.attempt(read)
        return self.arrow_rest(at, outer) if outer is not None else None

    def arrow_rest(self, start: int, outer: Scope) -> Node:
        self.need("=>")
        if self.peek() == "{":
            self.block(self.scope)
        else:
            self.assignment()
        self.scope = outer
        return Node("ArrowFunctionExpression", start, self.at)

    def assignment(self, no_in: bool = False) -> Node:
        if arrow := self.arrow():
            return arrow
        self.blank()
        start = self.at
        if self.word() == "yield":
            self.take("yield")
            line = self.blank()
            self.take("*")
            if not line and self.peek() not in (")", "]", "}", ",", ";", ":"):
                self.assignment(no_in)
            return Node("YieldExpression", start, self.at)
        left = self.binary(0, no_in)
        if self.peek() == "?":
            self.at += 1
            yes = self.assignment()
            self.need(":")
            no = self.assignment(no_in)
            return Node("ConditionalExpression", start, no.end, yes=yes, no=no)
        p = self.peek()
        if p in _ASSIGN:
            self.at += len(p)
            right = self.assignment(no_in)
            return Node("AssignmentExpression", start, right.end)
        return left

    def binary(self, least: int, no_in: bool) -> Node:
        left = self.unary()
        while True:
            line = self.blank()
            op = self.word() if self.word() in ("in", "instanceof", "as", "satisfies") else self.peek()
            if op not in _PRECEDENCE or _PRECEDENCE[op] <= least or (op == "in" and no_in) or (op in ("as", "satisfies") and line):
                return left
            self.at += len(op)
            if op in ("as", "satisfies"):
                if not self.take("const"):
                    self.type()
                kind = "TSAsExpression" if op == "as" else "TSSatisfiesExpression"
                left = Node(kind, left.start, self.at, inner=left)
                continue
            right = self.binary(_PRECEDENCE[op] - (op == "**"), no_in)
            kind = "LogicalExpression" if op in ("&&", "||", "??") else "BinaryExpression"
            left = Node(kind, left.start, right.end, left=left, right=right, operator=op)

    def unary(self) -> Node:
        self.blank()
        start, p, w = self.at, self.peek(), self.word()
        if p in ("!", "~", "+", "-"):
            self.at += 1
            arg = self.unary()
            return Node("UnaryExpression", start, arg.end, operator=p, argument=arg)
        if p in ("++", "--"):
            self.at += 2
            return Node("UpdateExpression", start, self.unary().end)
        if w in ("typeof", "void", "delete") or (w == "await" and re.match(r"await\s*[\w$(\[{`'\"<]", self.code[start:])):
            self.at += len(w)
            arg = self.unary()
            return Node("AwaitExpression" if w == "await" else "UnaryExpression", start, arg.end, operator=w, argument=arg)
        node = self.postfix(self.primary())
        if self.peek() in ("++", "--") and "\n" not in _BLANK.match(self.code, node.end).group():
            self.at += 2
            return Node("UpdateExpression", start, self.at)
        return node

    def postfix(self, node: Node, calls: bool = True) -> Node:
        optional = False
        while True:
            end = self.at
            line = self.blank()
            p = self.peek()
            if p in (".", "?."):
                self.at += len(p)
                optional = optional or p == "?."
                self.blank()
                c = self.code[self.at : self.at + 1]
                if p == "?." and c == "(":
                    node = self.call(node, True)
                    continue
                if p == "?." and c == "[":
                    node = self.index(node, optional)
                    continue
                self.take("#")
                at = self.at
                key = Node("Identifier", at, at, name=self.name())
                key.end = self.at
                node = Node("OptionalMemberExpression" if optional else "MemberExpression", node.start, self.at, object=node, property=key, computed=False)
            elif p == "[":
                node = self.index(node, optional)
            elif p == "(" and calls:
                node = self.call(node, optional)
            elif self.code.startswith("`", self.at):
                quasi = self.template()
                node = Node("TaggedTemplateExpression", node.start, self.at, tag=node, quasi=quasi, scope=self.scope, owner=self.owner())
                self.found.append(node)
            elif p == "!" and not line and self.code[self.at + 1 : self.at + 2] != "=":
                self.at += 1
                node = Node("TSNonNullExpression", node.start, self.at, inner=node)
            elif p in ("<", "<<") and self.attempt(self.call_types):
                continue
            else:
                self.at = end
                return node

    def call_types(self) -> bool:
        self.type_arguments()
        if self.code[self.at : self.at + 1] not in ("(", "`"):
            raise self.error("no call")
        return True

    def index(self, node: Node, optional: bool) -> Node:
        self.need("[")
        key = self.expression()
        self.need("]")
        return Node("OptionalMemberExpression" if optional else "MemberExpression", node.start, self.at, object=node, property=key, computed=True)

    def call(self, node: Node, optional: bool = False) -> Node:
        made = Node("OptionalCallExpression" if optional else "CallExpression", node.start, 0, callee=node, scope=self.scope)
        place = len(self.found)
        made.arguments = self.arguments()
        made.end = self.at
        self.found.insert(place, made)
        return made

    def arguments(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.spread() if self.peek() == "..." else self.assignment())
            if not self.take(","):
                self.need(")")
                break
        return out

    def spread(self) -> Node:
        self.blank()
        start = self.at
        self.need("...")
        inner = self.assignment()
        return Node("SpreadElement", start, inner.end, argument=inner)

    def owner(self) -> str | None:
        return self.owners[-1] if self.owners else None

    def primary(self) -> Node:
        self.blank()
        start, code = self.at, self.code
        c = code[start : start + 1]
        if c in ("'", '"') and c:
            return self.string()
        if c == "`":
            return self.template()
        if c.isdigit() or (c == "." and code[start + 1 : start + 2].isdigit()):
            m = _NUMBER.match(code, start)
            self.at = m.end()
            text = m.group().replace("_", "")
            if text.endswith("n"):
                return Node("BigIntLiteral", start, self.at)
            value = float(int(text, 0)) if text[:2].lower() in ("0x", "0o", "0b") else float(text)
            return Node("NumericLiteral", start, self.at, value=value)
        if c == "(":
            self.at += 1
            inner = self.expression()
            self.need(")")
            return inner  # parentheses leave no node
        if c == "[":
            self.at += 1
            items = []
            while not self.take("]"):
                if self.take(","):
                    items.append(None)
                    continue
                items.append(self.spread() if self.peek() == "..." else self.assignment())
                if not self.take(","):
                    self.need("]")
                    break
            return Node("ArrayExpression", start, self.at, elements=items)
        if c == "{":
            return self.object()
        if c == "<":
            return self.jsx()
        if c == "/":
            m = _REGEX.match(code, start)
            if not m:
                raise self.error("unexpected /")
            self.at = m.end()
            return Node("RegExpLiteral", start, self.at)
        if c == "#":
            self.at += 1
            self.name()
            return Node("PrivateName", start, self.at)
        if c == "@":
            self.at += 1
            self.unary()
            return self.primary()
        w = self.word()
        if w == "function" or (w == "async" and re.match(r"async[ \t]+function\b", code[start:])):
            return self.function(False)
        if w == "class":
            return self.class_(False)
        if w == "new":
            self.at += 3
            if self.take("."):
                self.name()
                return Node("MetaProperty", start, self.at)
            self.postfix(self.primary(), calls=False)
            if self.peek() == "<":
                self.attempt(self.call_types)
            if self.peek() == "(":
                self.arguments()
            return Node("NewExpression", start, self.at)
        if not w:
            raise self.error("unexpected token")
        self.at += len(w)
        if w in ("true", "false"):
            return Node("BooleanLiteral", start, self.at, value=w == "true")
        kind = {"null": "NullLiteral", "this": "ThisExpression", "super": "Super", "import": "Import"}.get(w, "Identifier")
        return Node(kind, start, self.at, name=w)

    def property_key(self) -> Node:
        self.blank()
        start = self.at
        c = self.code[start : start + 1]
        if c in ("'", '"') and c:
            return self.string()
        if c == "[":
            self.at += 1
            key = self.assignment()
            self.need("]")
            return Node("Computed", start, self.at, value=None, inner=key)
        if m := _NUMBER.match(self.code, start):
            self.at = m.end()
            return Node("NumericLiteral", start, self.at, value=m.group())
        self.take("#")
        return Node("Identifier", start, self.at, value=self.name())

    def object(self) -> Node:
        start = self.at
        self.need("{")
        props = []
        while not self.take("}"):
            props.append(self.spread() if self.peek() == "..." else self.property())
            if not self.take(","):
                self.need("}")
                break
        return Node("ObjectExpression", start, self.at, properties=props)

    def property(self) -> Node:
        self.blank()
        start = self.at
        method = False
        while self.word() in ("get", "set", "async") and not re.match(r"\w+\s*[,:(}=<]", self.code[self.at :]):
            self.name()
            method = True
        method = self.take("*") or method
        key = self.property_key()
        computed = key.type == "Computed"
        if method or self.peek() in ("(", "<"):
            outer, self.scope = self.scope, Scope(self.scope, True)
            self.function_rest()
            self.scope = outer
            return Node("ObjectMethod", start, self.at, key=key, computed=computed)
        if self.take(":"):
            value = self.assignment()
        else:
            value = Node("Identifier", key.start, self.at, name=key.value)
            if self.peek() == "=":
                self.take("=")
                self.assignment()
        return Node("ObjectProperty", start, value.end, key=key, computed=computed, value=value)

    # -- JSX -------------------------------------------------------------
    def jsx_name(self) -> tuple[str, str, bool]:
        """Full name, leftmost identifier and whether it is an intrinsic element."""
        self.blank()
        m = _JSX_NAME.match(self.code, self.at)
        if not m:
            raise self.error("expected an element name")
        self.at = m.end()
        full = base = m.group()
        if self.take(":"):
            m = _JSX_NAME.match(self.code, self.at)
            self.at = m.end()
            return f"{full}:{m.group()}", base, True
        member = False
        while self.take("."):
            full += "." + self.name()
            member = True
        return full, base, not member and bool(re.match("[a-z]", full))

    def jsx(self) -> Node:
        start = self.at
        self.need("<")
        if self.peek() == ">":
            self.at += 1
            self.children("")
            return Node("JSXFragment", start, self.at)
        name, base, dom = self.jsx_name()
        if self.peek() == "<":
            self.type_arguments()
        opening = Node("JSXOpeningElement", start, 0, name=name, base=base, dom=dom, attributes=[], scope=self.scope)
        self.found.append(opening)
        while True:
            self.blank()
            if self.take("/"):
                self.need(">")
                opening.end = self.at
                return Node("JSXElement", start, self.at)
            if self.take(">"):
                opening.end = self.at
                break
            opening.attributes.append(self.jsx_attribute())
        self.children(name)
        return Node("JSXElement", start, self.at)

    def jsx_attribute(self) -> Node:
        start = self.at
        if self.take("{"):
            self.need("...")
            self.assignment()
            self.need("}")
            return Node("JSXSpreadAttribute", start, self.at)
        m = _JSX_NAME.match(self.code, self.at)
        if not m:
            raise self.error("unexpected token in element")
        self.at = m.end()
        name, end, value = m.group(), m.end(), None
        if self.take(":"):
            m = _JSX_NAME.match(self.code, self.at)
            self.at = m.end()
            name, end = f"{name}:{m.group()}", m.end()
        if self.take("="):
            self.blank()
            at, c = self.at, self.code[self.at : self.at + 1]
            if c in ("'", '"') and c:
                close = self.code.find(c, at + 1)
                if close < 0:
                    raise self.error("unterminated string")
                self.at = close + 1
                value = Node("StringLiteral", at, self.at, value=_entities(self.code[at + 1 : close]))
            elif c == "{":
                self.at += 1
                if self.peek() == "}":
                    self.at += 1
                    value = Node("JSXExpressionContainer", at, self.at, expression=None)
                else:
                    inner = self.expression()
                    self.need("}")
                    value = Node("JSXExpressionContainer", at, self.at, expression=inner)
            else:
                value = self.jsx()
            end = self.at
        self.at = end
        return Node("JSXAttribute", start, end, name=name, value=value, scope=self.scope)

    def children(self, name: str) -> None:
        while True:
            m = re.compile("[<{]").search(self.code, self.at)
            if not m:
                raise self.error("missing closing tag")
            self.at = m.start()
            if m.group() == "{":
                self.at += 1
                if self.take("..."):
                    pass
                if self.peek() != "}":
                    self.expression()
                self.need("}")
            elif re.match(r"<\s*/", self.code[self.at : self.at + 40]):
                self.need("<")
                self.need("/")
                closing = "" if self.peek() == ">" else self.jsx_name()[0]
                self.need(">")
                if closing != name:
                    raise self.error(f"expected closing tag of {name}")
                return
            else:
                self.jsx()


def _entities(text: str) -> str:
    def one(m: re.Match) -> str:
        e = m.group(1)
        if e[0] == "#":
            return chr(int(e[2:], 16) if e[1] in "xX" else int(e[1:]))
        return _ENTITIES.get(e, m.group())

    return re.sub(r"&(#\d+|#[xX][\da-fA-F]+|\w+);", one, text)


def parse(code: str) -> Parser:
    try:
        return Parser(code).program()
    except (IndexError, AttributeError, RecursionError) as e:
        raise TsxError(f"cannot parse: {e}") from e


def walk(nodes: list[Node]) -> Iterator[Node]:
    yield from nodes
