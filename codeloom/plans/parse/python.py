"""Python files, by the syntax tree; a file with an error falls back to a scan of its lines."""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings

from codeloom.plans.parse.model import Found, register


class _Text:
    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.raw = [x.encode() for x in self.lines]

    def of(self, node) -> str:
        return self.between(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)

    def between(self, l0, c0, l1, c1) -> str:
        if l0 == l1:
            return self.raw[l0 - 1][c0:c1].decode("utf-8", "replace")
        return b"\n".join([self.raw[l0 - 1][c0:], *self.raw[l0 : l1 - 1], self.raw[l1 - 1][:c1]]).decode("utf-8", "replace")

    def header(self, node) -> str:
        """A definition's text up to the colon that ends its header."""
        body = node.body[0]
        text = self.between(node.lineno, node.col_offset, body.lineno, body.col_offset)
        plain = text.rstrip()
        if plain.endswith(":") and "#" not in text:  # nothing but blanks between the header and the body
            return plain[:-1].rstrip()
        depth, starts = 0, None
        try:
            for t in tokenize.generate_tokens(io.StringIO(text + "pass\n").readline):
                depth += (t.string in "([{") - (t.string in ")]}") if t.type == tokenize.OP else 0
                if t.type == tokenize.OP and t.string == ":" and depth == 0:
                    starts = t.start
                    break
        except (tokenize.TokenError, IndentationError, SyntaxError):
            pass
        if starts is None:
            return text.split("\n")[0].rstrip().rstrip(":")
        lines = text.split("\n")[: starts[0]]
        lines[-1] = lines[-1][: starts[1]]
        return "\n".join(lines).rstrip()


class _Walk(ast.NodeVisitor):
    def __init__(self, text: str):
        self.text, self.found = _Text(text), Found()
        self.classes: list[str] = []
        self.scopes: list[tuple] = []

    def edge(self, kind, node, text):
        self.found.edge(kind, node.lineno, node.end_lineno, node.col_offset, text, self.scopes[-1] if self.scopes else None)

    def define(self, node, kind):
        doc = ast.get_docstring(node, clean=False)
        self.found.symbol(node.name, kind, node.lineno, node.end_lineno, self.text.header(node), self.classes[-1] if self.classes else None, doc and doc.strip())

    def visit_ClassDef(self, node):
        self.define(node, "class")
        for d in node.decorator_list:
            self.visit(d)
        self.scopes.append((node.name, "class", node.lineno))
        for base in node.bases:
            if isinstance(base, (ast.Name, ast.Attribute)):
                self.edge("inherits", base, self.text.of(base))
            else:
                self.visit(base)
        for k in node.keywords:
            self.visit(k)
        self.classes.append(node.name)
        for x in node.body:
            self.visit(x)
        self.classes.pop()
        self.scopes.pop()

    def visit_FunctionDef(self, node):
        kind = "method" if self.classes else "function"
        self.define(node, kind)
        for d in node.decorator_list:
            self.visit(d)
        self.scopes.append((node.name, kind, node.lineno))
        self.visit(node.args)
        if node.returns:
            self.visit(node.returns)
        for x in node.body:
            self.visit(x)
        self.scopes.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node):
        self.edge("imports", node, self.text.of(node))

    def visit_ImportFrom(self, node):
        if len(node.names) == 1:
            return self.edge("imports", node, self.text.of(node))
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.edge("imports", node, f"from {module} import {a.name}" + (f" as {a.asname}" if a.asname else ""))

    def visit_Call(self, node):
        self.edge("calls", node, self.text.of(node))
        self.generic_visit(node)

    def visit_Attribute(self, node):
        self.visit(node.value)

    def visit_Name(self, node):
        """Names and constants hold nothing that is looked for."""

    visit_Constant = visit_Name


DEF = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)")
IMPORT = re.compile(r"^\s*(?:import\s+\S|from\s+\S+\s+import\b)")


def _scan(text: str, found: Found) -> None:
    """Definitions by indentation, imports by line."""
    lines = text.split("\n")
    open_: list[tuple[int, str, str]] = []
    for n, line in enumerate(lines, 1):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and indent <= open_[-1][0]:
            open_.pop()
        if m := DEF.match(line):
            end = n
            for k in range(n, len(lines)):
                if lines[k].strip():
                    if len(lines[k]) - len(lines[k].lstrip()) <= indent:
                        break
                    end = k + 1
            classes = [x[2] for x in open_ if x[1] == "class"]
            kind = "class" if m[2] == "class" else "method" if classes else "function"
            found.symbol(m[3], kind, n, end, line.strip().rstrip(":").rstrip(), classes[-1] if classes else None)
            open_.append((indent, m[2], m[3]))
        elif IMPORT.match(line):
            found.edge("imports", n, n, indent, line.strip(), None)


@register("python")
def parse(text: str, language: str) -> Found:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
        walk = _Walk(text)
        walk.visit(tree)
        return walk.found
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        found = Found()
        line, column = getattr(e, "lineno", None) or 1, max(0, (getattr(e, "offset", None) or 1) - 1)
        found.error(line, column, getattr(e, "end_lineno", None) or line, max(column, (getattr(e, "end_offset", None) or 1) - 1))
        _scan(text, found)
        return found
