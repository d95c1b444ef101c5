"""Languages with braces: a tolerant tokenizer, and one walk over its tokens driven by a table per language."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, replace

from codeloom.plans.parse.model import Found, register

TOKEN = re.compile(
    r"""(?P<word>[A-Za-z_$][\w$]*[!?]?)|(?P<number>\d[\w.]*)|(?P<doc>/\*\*.*?\*/)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<pre>^[ \t]*\#[^\n]*)
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<arrow>=>|->|::)|(?P<op>[^\s])""",
    re.S | re.M | re.X,
)
PAIRS = {"(": ")", "[": "]", "{": "}"}
#: A lifetime or a loop's label, not a character.
LIFETIME = re.compile(r"'[A-Za-z_]\w*(?!')\b")
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.S)
#: What follows the sign that opens an element of markup, and what does where it opens type parameters.
ELEMENT, GENERIC = re.compile(r"<\s*(?:[A-Za-z_$]|>)"), re.compile(r"<\s*[A-Za-z_$][\w$]*\s*(?:,|extends\b)")
IN_TAG = re.compile(r"""[^"'{/>]+|"[^"]*"|'[^']*'|/\s*>|[\s\S]""")
IN_ELEMENT = re.compile(r"[^<{]+|</[^>]*>|[\s\S]")
#: Words after which a slash begins a regular expression, and a less-than sign markup.
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new do else await yield instanceof".split())


@dataclass(slots=True)
class Tok:
    kind: str
    text: str
    at: int
    end: int


class Source:
    """Tokens of a text, with line and column lookups, matched brackets, and unmatched ones as errors."""

    def __init__(self, text: str, hash_comments: bool = False, script: bool = False, markup: bool = False, lifetimes: bool = False):
        self.text, self.lifetimes = text, lifetimes
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        self.tokens: list[Tok] = []
        self.docs: dict[int, str] = {}
        doc = None
        for kind, value, at, to in self.lexed(script, markup):
            if kind == "doc":
                doc = value
            elif kind == "comment" or (kind == "pre" and hash_comments):
                doc = None if kind == "comment" else doc
            else:
                if kind == "word" and value[-1] in "!?":  # an operator unless a macro or method mark stands before a bracket
                    value = value[:-1]
                    to -= 1
                if doc is not None:
                    self.docs[len(self.tokens)] = doc
                    doc = None
                self.tokens.append(Tok(kind, value, at, to))
        self.match: dict[int, int] = {}
        self.unmatched: list[int] = []
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "op" or t.text not in "()[]{}":
                continue
            if t.text in PAIRS:
                stack.append(i)
            else:
                while stack and PAIRS[self.tokens[stack[-1]].text] != t.text:
                    self.unmatched.append(stack.pop())
                if stack:
                    self.match[stack[-1]] = i
                    self.match[i] = stack.pop()
                else:
                    self.unmatched.append(i)
        self.unmatched += stack
        self.texts = [t.text for t in self.tokens]

    def lexed(self, script: bool, markup: bool):
        """Kind, text, begin and end of each token.

        In scripts a template is strings with the tokens of its substitutions between them, and so is markup with those of
        its expressions.
        """
        text, at, depth = self.text, 0, 0
        open_: list[tuple] = []  # what goes on after a closing brace: its depth, and the elements open in markup or None in a template
        search = TOKEN.search
        while m := search(text, at):
            kind = m.lastgroup
            begin, at = m.span()
            if self.lifetimes and text[begin] == "'" and (lifetime := LIFETIME.match(text, begin)):
                kind, at = "lifetime", lifetime.end()
            if script:
                first = text[begin]
                if kind == "word" or kind == "number" or (kind == "op" and first not in "/`<{}"):  # nothing below is about these
                    yield kind, m[0], begin, at
                    continue
                resumed = open_.pop()[1] if first == "}" and open_ and open_[-1][0] == depth else 0
                if kind == "pre":  # a private member's mark
                    begin = text.index("#", begin)
                    kind, at = "op", begin + 1
                elif first == "/" and kind == "op" and self.fresh() and (r := REGEX.match(text, begin)):
                    kind, at = "string", r.end()
                elif first == "`" or resumed is None:
                    chunk = TEMPLATE.match(text, begin + 1)
                    kind, at = "string", chunk.end()
                    if chunk[1] == "${":
                        open_.append((depth, None))
                elif resumed or (first == "<" and markup and self.fresh() and ELEMENT.match(text, begin) and not GENERIC.match(text, begin)):
                    at, left = self.marked_up(begin + 1, resumed or (1, True))
                    kind = "string"
                    if left:
                        open_.append((depth, left))
                elif kind == "op":
                    depth += (first == "{") - (first == "}")
            yield kind, text[begin:at], begin, at

    def fresh(self) -> bool:
        """Whether an operand may come next, not an operator."""
        last = self.tokens[-1] if self.tokens else None
        return last is None or last.kind == "arrow" or (last.kind == "op" and last.text not in ")]}") or last.text in BEFORE_REGEX

    def marked_up(self, at: int, state: tuple[int, bool]) -> tuple[int, tuple[int, bool] | None]:
        """Where markup ends or an expression in it begins, and for an expression how it goes on: the elements open, and whether in a tag."""
        count, tag = state
        while count and at < len(self.text):
            m = (IN_TAG if tag else IN_ELEMENT).match(self.text, at)
            at, found = m.end(), m[0]
            if found == "{":
                return at, (count, tag)
            if tag:
                closed = found[0] == "/" and found[-1] == ">"
                count, tag = count - closed, not (closed or found == ">")
            elif found == "<":
                count, tag = count + 1, True
            elif found.startswith("</"):
                count -= 1
        return at, None

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def column(self, at: int) -> int:
        return len(self.text[self.starts[self.line(at) - 1] : at].encode())

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.texts) and self.texts[i] in texts

    def span(self, i: int, j: int) -> str:
        return self.text[self.tokens[i].at : self.tokens[j].end]


#: Words that no call or member is named by: in every language, and in the ones that use them so.
COMMON = frozenset("if for while switch catch return throw else do try new typeof class interface enum in super case import break continue default".split())
SCRIPTED = COMMON | frozenset("delete function instanceof void await yield of with var let const".split())
CONTROL = {
    "typescript": SCRIPTED,
    "javascript": SCRIPTED,
    "go": COMMON | frozenset("func struct package defer go select range chan map var const fallthrough goto type".split()),
    "rust": COMMON | frozenset("fn struct match loop use impl trait where let mut as unsafe move await mod".split()),
    "java": COMMON | frozenset("instanceof assert synchronized package throws extends implements yield".split()),
    "c": COMMON | frozenset("sizeof struct typedef union goto".split()),
    "cpp": COMMON | frozenset("sizeof struct typedef union goto delete using namespace template operator not and or".split()),
    "c_sharp": COMMON | frozenset("struct using lock foreach namespace when where is as sizeof await yield out ref".split()),
    "php": COMMON | frozenset("function use foreach match echo print isset unset empty array list and or xor instanceof elseif fn namespace".split()),
    "swift": COMMON | frozenset("func struct guard where defer repeat let var as is await fallthrough".split()),
    "kotlin": COMMON | frozenset("fun when object typealias is as val var package".split()),
}


@dataclass(frozen=True)
class Rules:
    """Keywords that define symbols in a language, and what else the walk needs to know."""

    kinds: dict  # keyword to symbol kind
    containers: frozenset = frozenset()  # keywords whose body makes functions methods
    functions: frozenset = frozenset()  # keywords of functions; without any, a name with parameters and a body is one
    imports: frozenset = frozenset()
    c_like: bool = False  # functions are written type name(parameters) {
    script: bool = False  # TypeScript or JavaScript
    typed: bool = False  # TypeScript
    lifetimes: bool = False  # a quote before a name may be no string
    arrows: bool = False  # members are reached by -> too
    templates: bool = False  # template<...> stands before a declaration
    control: frozenset = COMMON  # words that are no names


MODIFIERS = frozenset("public private protected internal static final abstract virtual override async export default declare readonly get set sealed open inline extern pub mut unsafe const suspend partial synchronized native".split())

SCRIPT = Rules({"class": "class", "function": "function"}, frozenset({"class"}), frozenset({"function"}), frozenset({"import"}), script=True)
RULES = {
    "typescript": Rules(SCRIPT.kinds | {"interface": "interface", "type": "type_alias", "enum": "enum"}, SCRIPT.containers, SCRIPT.functions, SCRIPT.imports, script=True, typed=True),
    "javascript": SCRIPT,
    "go": Rules({"func": "function", "type": "type"}, frozenset(), frozenset({"func"}), frozenset({"import"})),
    "rust": Rules({"fn": "function", "struct": "class", "enum": "class", "type": "type"}, frozenset({"struct", "impl", "trait"}), frozenset({"fn"}), frozenset({"use"}), lifetimes=True),
    "java": Rules({"class": "class", "interface": "interface", "enum": "class"}, frozenset({"class", "interface"}), imports=frozenset({"import"}), c_like=True),
    "c": Rules({"struct": "class", "enum": "class", "typedef": "type"}, frozenset({"struct"}), c_like=True, arrows=True),
    "cpp": Rules({"class": "class", "struct": "class", "enum": "class", "typedef": "type"}, frozenset({"class", "struct"}), c_like=True, arrows=True, templates=True),
    "c_sharp": Rules({"class": "class", "interface": "interface", "enum": "class", "struct": "class"}, frozenset({"class", "interface", "struct"}), imports=frozenset({"using"}), c_like=True),
    "php": Rules({"class": "class", "interface": "interface", "enum": "class", "function": "function"}, frozenset({"class", "interface"}), frozenset({"function"}), frozenset({"use"}), arrows=True),
    "swift": Rules({"class": "class", "struct": "class", "enum": "class", "func": "function", "typealias": "type"}, frozenset({"class", "struct"}), frozenset({"func"}), frozenset({"import"})),
    "kotlin": Rules({"class": "class", "interface": "interface", "object": "class", "fun": "function", "typealias": "type"}, frozenset({"class", "interface", "object"}), frozenset({"fun"}), frozenset({"import"})),
}


class Walk:
    def __init__(self, text: str, rules: Rules, markup: bool = False):
        self.rules, self.s = rules, Source(text, hash_comments=not (rules.c_like or rules.script), script=rules.script, markup=markup, lifetimes=rules.lifetimes)
        self.joins = (".", "::", "->") if rules.arrows else (".", "::")
        self.found = Found()

    def scope(self, scopes):
        return scopes[-1] if scopes else None

    def edge(self, kind, i, j, text, scopes):
        s = self.s
        at, end = s.tokens[i].at, s.tokens[j].end
        self.found.edge(kind, s.line(at), s.line(end - 1), s.column(at), text, self.scope(scopes))

    def body_of(self, i: int, limit: int) -> int | None:
        """The opening brace of the definition that begins at token i, unless a statement ends before."""
        s = self.s
        while i < limit:
            if s.is_(i, "{"):
                return i
            if s.is_(i, ";", "}", "="):
                return None
            i = s.match.get(i, i) + 1 if s.is_(i, "(", "[") else i + 1
        return None

    def signature(self, i: int, end: int, brace: int | None) -> str:
        s = self.s
        if self.rules.script:
            return s.span(i, (brace if brace is not None else end + 1) - 1).strip().rstrip(";").rstrip()
        text = s.text[s.tokens[i].at :].split("\n")[0].split("{")[0].strip()
        return text.split(";")[0].rstrip(":").strip()

    def add(self, name, kind, i, end, brace, containers, doc_at):
        s = self.s
        doc = s.docs.get(doc_at) if self.rules.script and kind not in ("type_alias",) else None
        if doc:
            lines = [re.sub(r"^\s*\*\s?", "", x).strip() for x in doc[3:-2].split("\n")]
            doc = "\n".join(lines).strip()
        at = s.tokens[i].at
        self.found.symbol(name, kind, s.line(at), s.line(s.tokens[end].end - 1), self.signature(i, end, brace), containers[-1] if containers else None, doc)
        return (name, kind, s.line(at))

    def run(self):
        s = self.s
        for i in sorted(s.unmatched):
            at = s.tokens[i].at
            self.found.error(s.line(at), s.column(at), s.line(at), s.column(at) + 1)
        self.walk(0, len(s.tokens), [], [], None)
        return self.found

    def walk(self, i, limit, containers, scopes, direct):
        """Tokens i to limit. direct: the container whose body this is, for members."""
        s, r = self.s, self.rules
        start = i  # of the current declaration, with its modifiers
        while i < limit:
            t = s.tokens[i]
            if not r.c_like and i > start and s.line(t.at) > s.line(s.tokens[i - 1].at) and s.tokens[i - 1].text not in MODIFIERS and not s.is_(i - 1, ",", "=", ".", "]"):
                start = i  # a line begins a declaration where no semicolon is needed
            if t.kind == "pre":
                if m := re.match(r"\s*#\s*include\s+\S+", t.text):
                    self.edge("imports", i, i, t.text.strip(), scopes)
                del m
                i += 1
                start = i
                continue
            if t.text in ("{", "}", ";"):
                if t.text == "{" and i in s.match:
                    self.walk(i + 1, s.match[i], containers, scopes, None)
                    i = s.match[i]
                i += 1
                start = i
                continue
            if t.kind != "word":
                i += 1
                continue
            if r.templates and t.text == "template" and s.is_(i + 1, "<"):  # what it declares begins after its parameters
                i = start = self.after_angles(i + 1, limit)
                continue
            if t.text in r.imports and (i == start or s.is_(i - 1, "export", "pub", "static")) and not (r.script and s.is_(i + 1, "(")):
                i = self.imports(i, limit, scopes)
                start = i
                continue
            if t.text in MODIFIERS and not (r.script and t.text == "const") and not s.is_(i + 1, "("):
                i += 1
                continue
            done = self.definition(i, start, limit, containers, scopes)
            if done is None and r.script:
                done = self.binding(i, start, limit, containers, scopes)
            if done is None and (r.c_like or (r.script and direct)):
                done = self.member(i, start, limit, containers, scopes, direct)
            if done is not None:
                i = start = done
                continue
            i = self.expression(i, limit, containers, scopes)

    def definition(self, i, start, limit, containers, scopes):
        s, r = self.s, self.rules
        word = s.tokens[i].text
        if word == "impl" and "impl" in r.containers:
            brace = self.body_of(i + 1, limit)
            if brace is None or brace not in s.match:
                return None
            begin = self.after_angles(i + 1, brace) if s.is_(i + 1, "<") else i + 1  # type parameters
            names = [s.tokens[k].text for k in range(begin, brace) if s.tokens[k].kind == "word"]
            name = names[names.index("for") + 1] if "for" in names[:-1] else names[0] if names else ""
            self.walk(brace + 1, s.match[brace], [*containers, name], [*scopes, (name, "impl", s.line(s.tokens[i].at))], name)
            return s.match[brace] + 1
        if word not in r.kinds:
            return None
        if r.script and word == "class" and "abstract" in (s.tokens[x].text for x in range(start, i)):
            brace = self.body_of(i + 1, limit)
            if brace is None or brace not in s.match:
                return None
            self.bodies(brace + 1, s.match[brace], containers, scopes)
            return s.match[brace] + 1
        kind, n = r.kinds[word], i + 1
        if word == "typedef":
            end = i
            while end < limit and not s.is_(end, ";"):
                end = s.match.get(end, end) + 1 if s.is_(end, "{", "(") else end + 1
            names = [k for k in range(i, min(end, limit)) if s.tokens[k].kind == "word"]
            if len(names) > 1:
                self.add(s.tokens[names[-1]].text, kind, i, min(end, limit - 1), None, containers, start)
            return end + 1
        if s.is_(n, "*"):
            n += 1
        if r.functions and word == "func" and s.is_(n, "(") and n in s.match:  # a receiver
            n = s.match[n] + 1
        if s.is_(n, "class", "struct") and word == "enum":
            n += 1
        if n >= limit or s.tokens[n].kind != "word":
            return None
        name = s.tokens[n].text
        if kind == "function":
            after = n + 1
            brace = self.body_of(after, limit)
            if containers:
                kind = "method"
        elif word == "type" or kind == "type":
            after, brace = n + 1, None
        else:
            after = n + 1
            brace = self.body_of(after, limit)
            if brace is None and not r.script and word not in ("class", "object"):
                return None
        if brace is not None and brace in s.match:
            end = s.match[brace]
        else:
            brace, end = None, self.statement_end(n, limit)
        first = i if r.script else start
        if r.script and ((kind in ("function", "method") and s.is_(i - 1, "async")) or (kind == "enum" and s.is_(i - 1, "const"))):
            first = i - 1
        me = self.add(name, kind, first, end, brace, containers, start)
        inner = [*scopes, me]
        if kind == "enum" and r.script:
            self.found.symbols[-1]["signature"] = s.span(first, end).split("\n")[0].rstrip()
        if word in ("class", "interface") and r.script:
            clause = next((k for k in range(after, brace if brace is not None else after) if s.is_(k, "extends", "implements") and not self.inside(k, after)), None)
            self.found.symbols[-1]["signature"] = f"{word} {name}" + (f" {s.span(clause, brace - 1)}" if clause is not None else "")
        if word in ("class", "interface") and r.script:
            self.heritage(word, after, brace if brace is not None else limit, inner)
        if brace is not None:
            inside = [*containers, name] if word in r.containers else containers
            if kind not in ("enum", "interface") or not r.script:
                self.walk(brace + 1, end, inside, inner, name if word in r.containers else None)
        return end + 1

    def bodies(self, i, limit, containers, scopes):
        """The calls in the bodies and values of members that are no symbols."""
        s = self.s
        while i < limit:
            if s.is_(i, "{") and i in s.match:
                self.walk(i + 1, s.match[i], containers, scopes, None)
                i = s.match[i]
            elif s.is_(i, "("):
                i = s.match.get(i, i)
            i += 1

    def statement_end(self, i, limit):
        s = self.s
        line = s.line(s.tokens[i].at)
        while i < limit:
            if s.is_(i, "{", "(", "["):
                i = s.match.get(i, i)
                line = s.line(s.tokens[i].at)
            if s.is_(i, ";"):
                return i
            if i + 1 >= limit or (s.line(s.tokens[i + 1].at) > line and not s.is_(i, "=", "|", "&", ",") and not s.is_(i + 1, "|", "&", "=")):
                return i
            i += 1
            line = max(line, s.line(s.tokens[i].at)) if s.is_(i - 1, "=", "|", "&", ",") or s.is_(i, "|", "&", "=") else line
        return limit - 1

    def after_angles(self, i, limit):
        """The token after the angle brackets that open at token i."""
        depth = 0
        while i < limit:
            depth += self.s.is_(i, "<") - self.s.is_(i, ">")
            i = self.s.match.get(i, i) + 1 if self.s.is_(i, "(", "[", "{") else i + 1
            if depth == 0:
                break
        return i

    def type_arguments(self, i, limit):
        """The token after type arguments that open at token i, if they are followed by a call's parenthesis."""
        s = self.s
        end = self.after_angles(i, limit)
        plain = all(t.kind in ("word", "string", "number", "arrow") or t.text in "<>,.|&[](){}:;?" for t in s.tokens[i:end])
        plain = plain and not any(s.is_(k, "&", "|") and s.is_(k + 1, "&", "|") for k in range(i, end))  # these join conditions, not types
        return end if end > i + 2 and plain and s.is_(end - 1, ">") and s.is_(end, "(") else None

    def inside(self, k, since):
        """Whether token k is inside angle brackets that open at ``since`` or later."""
        return sum(self.s.is_(x, "<") - self.s.is_(x, ">") for x in range(since, k)) > 0

    def heritage(self, word, i, stop, scopes):
        """extends and implements lists up to the body."""
        s, kind = self.s, None
        while i < stop:
            if s.is_(i, "extends"):
                kind = "inherits"
            elif s.is_(i, "implements"):
                kind = "implements"
            elif s.is_(i, "<"):
                depth = 0
                while i < stop:
                    depth += s.is_(i, "<") - s.is_(i, ">")
                    if depth == 0:
                        break
                    i += 1
            elif kind and word == "class" and s.tokens[i].kind == "word":
                j = i
                while s.is_(j + 1, ".") and j + 2 < stop:
                    j += 2
                self.edge(kind, i, j, s.span(i, j), scopes)
                i = j
            i += 1

    def binding(self, i, start, limit, containers, scopes):
        """const name = (parameters): T => ..., or a function expression."""
        s = self.s
        if not s.is_(i, "const", "let", "var") or i + 2 >= limit or s.tokens[i + 1].kind != "word":
            return None
        name, k = s.tokens[i + 1].text, i + 2
        while k < limit and not s.is_(k, "=", ";"):
            k = s.match.get(k, k) + 1 if s.is_(k, "(", "[", "{") else k + 1
        if not s.is_(k, "="):
            return None
        k += 1
        if s.is_(k, "async"):
            k += 1
        if s.is_(k, "<"):  # type parameters
            k = next((x + 1 for x in range(k, limit) if s.is_(x, ">") and not self.inside(x + 1, k)), k)
        begin = k
        if s.is_(k, "function"):
            while k < limit and not s.is_(k, "("):
                k += 1
            if k not in s.match:
                return None
            params, after = s.span(k, s.match[k]), s.match[k] + 1
        elif s.is_(k, "(") and k in s.match:
            params, after = s.span(k, s.match[k]), s.match[k] + 1
        elif k < limit and s.tokens[k].kind == "word" and s.is_(k + 1, "=>"):
            params, after = "", k + 1
        else:
            return None
        arrow = after
        while arrow < limit and not s.is_(arrow, "=>", ";", "{"):
            arrow += 1
        if not s.is_(begin, "function") and not s.is_(arrow, "=>"):
            return None
        returns = s.span(after, arrow - 1) if s.is_(after, ":") and arrow > after else ""
        body = arrow + 1 if s.is_(arrow, "=>") else arrow
        if s.is_(body, "{") and body in s.match:
            end, inner = s.match[body], (body + 1, s.match[body])
        else:
            end = self.statement_end(body, limit) if body < limit else limit - 1
            inner = (body, end + 1)
        if s.is_(end + 1, ";"):
            end += 1
        at = s.tokens[i].at
        doc_at = start
        me = self.add(name, "function", i, end, None, containers, doc_at)
        self.found.symbols[-1]["signature"] = f"const {name} = {params}{returns}"
        del at
        self.walk(inner[0], min(inner[1], limit), containers, [*scopes, me], None)
        return end + 1

    def member(self, i, start, limit, containers, scopes, direct):
        """name(parameters) ... { in a class body, or type name(parameters) { in languages written so."""
        s, r = self.s, self.rules
        n = i
        if r.c_like:  # skip the type: the name is the word before the first parenthesis
            while n < limit and not s.is_(n, "(", ";", "{", "}", "=") and s.tokens[n].kind != "string":
                n += 1
            n -= 1
            if n <= start or n >= limit - 1 or s.tokens[n].kind != "word" or s.is_(n - 1, ".", "new", "return") or not s.is_(n + 1, "("):
                return None
            if s.tokens[start].text in r.control - {"struct", "class", "enum"}:
                return None
        elif not s.is_(n + 1, "(", "<"):
            return None
        if s.tokens[n].text in r.control or s.tokens[n].kind != "word":
            return None
        p = n + 1
        while p < limit and not s.is_(p, "(", ";", "{"):
            p += 1
        if p not in s.match or not s.is_(p, "("):
            return None
        brace = self.body_of(s.match[p] + 1, limit)
        between = range(s.match[p] + 1, brace if brace is not None else s.match[p] + 1)
        if brace is None or brace not in s.match or any(s.is_(k, "=", ".", "?") for k in between):
            if not (r.c_like and direct and s.is_(s.match[p] + 1, ";")):
                return None
            brace, end = None, s.match[p] + 1
        else:
            end = s.match[brace]
        if r.c_like and "interface" in r.kinds and s.tokens[n].text == direct and all(s.tokens[x].text in MODIFIERS for x in range(start, n)):
            # a constructor is no symbol in these languages, but calls are made in it
            if brace is not None:
                self.walk(brace + 1, end, containers, scopes, None)
            return end + 1
        kind = "method" if containers else "function"
        first = start if r.c_like or all(s.tokens[x].text in MODIFIERS or s.is_(x, "*") for x in range(start, i)) else i
        me = self.add(s.tokens[n].text, kind, first, end, brace, containers, start)
        if brace is not None:
            self.walk(brace + 1, end, containers, [*scopes, me], None)
        return end + 1

    def imports(self, i, limit, scopes):
        s = self.s
        k = i + 1
        if s.is_(k, "(") and k in s.match:  # a group of quoted paths
            end = s.match[k]
        else:
            end = self.statement_end(i, limit)
            while s.is_(i, "import") and self.rules.script and end + 1 < limit and not any(s.tokens[x].kind == "string" for x in range(i, end + 1)) and not s.is_(end, ";"):
                end += 1
        text = s.span(i, end)
        if not self.rules.script:
            self.edge("imports", i, end, text.strip(), scopes)
            return end + 1
        module = next((s.tokens[x].text for x in range(end, i, -1) if s.tokens[x].kind == "string"), None)
        names = []
        stop = next((x for x in range(i, end + 1) if s.is_(x, "from")), None)
        x = i + 1
        if s.is_(x, "type") and not s.is_(x + 1, "from", ","):
            x += 1
        while stop is not None and x < stop:
            if s.is_(x, "{") and x in s.match:
                part: list[str] = []
                for y in range(x + 1, s.match[x] + 1):
                    if s.is_(y, ",") or y == s.match[x]:
                        if part:
                            names.append(" ".join(part[1:] if part[0] == "type" and len(part) > 1 and part[1] != "as" else part))
                        part = []
                    else:
                        part.append(s.tokens[y].text)
                x = s.match[x]
            elif s.is_(x, "*"):
                names.append(s.span(x, x + 2))
                x += 2
            elif s.tokens[x].kind == "word":
                names.append(s.tokens[x].text)
            x += 1
        if names and module:
            for name in names:
                self.edge("imports", i, end, f"import {name} from {module}", scopes)
        else:
            self.edge("imports", i, end, text.strip(), scopes)
        return end + 1

    def expression(self, i, limit, containers, scopes):
        """A dotted name, and if it is called, its calls with their arguments."""
        s = self.s
        if s.tokens[i].text in self.rules.control and s.tokens[i].text != "super":
            return i + 1
        made = s.is_(i - 1, "new")
        j = i
        while s.is_(j + 1, *self.joins) and j + 2 < limit and s.tokens[j + 2].kind == "word":
            j += 2
        while True:
            if self.rules.typed and s.is_(j + 1, "<") and (called := self.type_arguments(j + 1, limit)):
                j = called - 1
            if not (s.is_(j + 1, "(") and j + 1 in s.match and s.match[j + 1] < limit + 1):
                break
            close = s.match[j + 1]
            if not made:
                if self.rules.script and not self.rules.typed and j == i and s.is_(i, "require"):
                    self.edge("imports", i, close, s.span(i, close), scopes)
                else:
                    self.edge("calls", i, close, s.span(i, close), scopes)
            made = False
            self.walk(j + 2, close, containers, scopes, None)
            j = close
            while s.is_(j + 1, *self.joins) and j + 2 < limit and s.tokens[j + 2].kind == "word":
                j += 2
        return j + 1


@register("typescript", "tsx", "javascript", "jsx", "go", "rust", "java", "c", "cpp", "c_sharp", "php", "swift", "kotlin")
def parse(text: str, language: str) -> Found:
    own = {"tsx": "typescript", "jsx": "javascript"}.get(language, language)
    rules = replace(RULES[own], control=CONTROL[own])
    return Walk(text, rules, markup=language in ("tsx", "jsx", "javascript")).run()


#: A method that is one expression, without an end.
ENDLESS = re.compile(r"^\s*def\s+(?:self\.)?\w+[?!]?(?:\([^)]*\)\s*|\s+)=(?![=~>])")
RUBY = re.compile(r"^(\s*)(def|class|module)\s+((?:self\.)?[A-Za-z_][\w:]*[?!=]?)")


@register("ruby")
def parse_ruby(text: str, language: str) -> Found:
    """Definitions by their lines and the end that stands at the same indent."""
    found, lines, open_ = Found(), text.split("\n"), []
    for n, line in enumerate(lines, 1):
        indent = len(line) - len(line.lstrip())
        if line.strip() == "end":
            while open_ and open_[-1][0] >= indent:
                open_.pop()
        elif m := RUBY.match(line):
            endless = bool(ENDLESS.match(line))
            end = n if endless else next((k + 1 for k in range(n, len(lines)) if lines[k].strip() == "end" and len(lines[k]) - len(lines[k].lstrip()) <= indent), len(lines))
            classes = [x[2] for x in open_ if x[1] == "class"]
            if m[2] != "module":
                found.symbol(m[3].removeprefix("self."), "class" if m[2] == "class" else "method" if classes else "function", n, end, line.strip(), classes[-1] if classes else None)
            if not endless:
                open_.append((indent, m[2], m[3]))
        elif m := re.match(r"\s*(require(?:_relative)?)\s*\(?\s*['\"]", line):
            found.edge("imports", n, n, indent, line.strip(), None)
    return found
