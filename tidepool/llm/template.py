"""A compiler for a small sandboxed template language.

Source -> tokens -> syntax tree -> folded tree -> Python closures. The language has text, {{ expression }},
{# comment #} and the statements if / elif / else, for, set and generation (whose text is marked), with
trimming by `-` inside the braces. Expressions have strings, whole numbers, true, false, none, names,
x.key and x['key'] on mappings, filters (x | trim), + - ~ % comparisons, in, and, or, not and
`a if c else b`. There are no calls, no other attributes and no loops but those over lists that are
passed in, so a template can only read what it is given.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

# The control strings that bound turns.
START, END = "<|im_start|>", "<|im_end|>"
CHAT = f"{{% for m in messages %}}{START}{{{{ m.role | line }}}}\n{{% if m.role == 'assistant' %}}{{% generation %}}{{{{ m.text | guard }}}}{{% endgeneration %}}{{% else %}}{{{{ m.text | guard }}}}{{% endif %}}{END}\n{{% endfor %}}"


class TemplateError(ValueError):
    pass


def guard(text: str) -> str:
    """Put one more backslash between every `<` and `|` that only backslashes part, so that no control
    string is left; unguard takes it out again."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unguard(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def line(text: str) -> str:
    """guard, and keep a role on its line."""
    return guard(text).replace("\\", "\\\\").replace("\n", "\\n")


def unline(text: str) -> str:
    return unguard(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text))


FILTERS: dict[str, Callable] = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "guard": guard, "line": line, "string": str}


@dataclass(frozen=True)
class Node:
    kind: str
    args: tuple = ()


_EXPR = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~%<>|.()\[\]]))""")


def _remainder(a, b):
    """Of numbers only: on a string `%` would format, to any width."""
    if not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError("% is for numbers")
    return a % b


_BINARY = {"+": operator.add, "-": operator.sub, "%": _remainder, "~": lambda a, b: f"{a}{b}", "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b}
_LEVELS = (("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "-", "~"), ("%",))
_CONSTANTS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t"}


class Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _EXPR.match(source, at)
            if not m:
                raise TemplateError(f"bad expression: {source[at:].strip()!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        if len(self.tokens) > 200:
            raise TemplateError("expression too long")
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *texts: str) -> bool:
        if self.peek()[0] in ("op", "name") and self.peek()[1] in texts:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"expected {text!r}, found {self.peek()[1]!r}")

    def whole(self) -> Node:
        out = self.choice()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def choice(self) -> Node:
        out = self.logic("or", lambda: self.logic("and", self.negation))
        if self.take("if"):
            test = self.logic("or", lambda: self.logic("and", self.negation))
            self.need("else")
            return Node("choice", (test, out, self.choice()))
        return out

    def logic(self, word: str, below: Callable[[], Node]) -> Node:
        out = below()
        while self.take(word):
            out = Node(word, (out, below()))
        return out

    def negation(self) -> Node:
        return Node("not", (self.negation(),)) if self.take("not") else self.binary(0)

    def binary(self, level: int) -> Node:
        if level == len(_LEVELS):
            return self.filtered()
        out = self.binary(level + 1)
        while self.take(*_LEVELS[level]):
            op = self.tokens[self.at - 1][1]
            out = Node("binary", (op, out, self.binary(level + 1)))
        return out

    def filtered(self) -> Node:
        out = self.atom()
        while self.take("|"):
            name = self.peek()[1]
            if name not in FILTERS:
                raise TemplateError(f"no such filter: {name!r}")
            self.at += 1
            out = Node("filter", (name, out))
        return out

    def atom(self) -> Node:
        kind, text = self.peek()
        self.at += 1
        if kind == "num":
            out = Node("const", (int(text),))
        elif kind == "str":
            out = Node("const", (re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S),))
        elif kind == "name":
            out = Node("const", (_CONSTANTS[text.lower()],)) if text.lower() in _CONSTANTS else Node("name", (text,))
        elif text == "(":
            out = self.choice()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {text!r}")
        while True:
            if self.take("."):
                out = Node("item", (out, Node("const", (self.peek()[1],))))
                self.at += 1
            elif self.take("["):
                out = Node("item", (out, self.choice()))
                self.need("]")
            else:
                return out


#: A tag ends at the first `}}` or `%}` that doesn't stand in a string.
_INSIDE = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"])*?"""
_TAG = re.compile(rf"(\{{\{{-?{_INSIDE}-?\}}\}}|\{{%-?{_INSIDE}-?%\}}|\{{#.*?#\}})", re.S)


def parse(source: str) -> tuple[Node, ...]:
    pieces = _TAG.split(source)
    if any(x in text for text in pieces[::2] for x in ("{{", "{%", "{#")):
        raise TemplateError("a tag isn't closed")
    tokens: list[tuple[str, str]] = []
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            if i and pieces[i - 1][-3:-2] == "-":
                piece = piece.lstrip()
            if i + 1 < len(pieces) and pieces[i + 1][2:3] == "-":
                piece = piece.rstrip()
            if piece:
                tokens.append(("text", piece))
        elif not piece.startswith("{#"):
            tokens.append(("out" if piece.startswith("{{") else "tag", piece[2:-2].strip("-").strip()))
    nodes, rest, end = _body(tokens, 0, (), 0)
    if end:
        raise TemplateError(f"{end!r} without a beginning")
    return nodes


def _body(tokens: list[tuple[str, str]], at: int, ends: tuple[str, ...], deep: int) -> tuple[tuple[Node, ...], int, str]:
    """Nodes up to a tag in `ends`; the place of that tag and its text."""
    if deep > 50:
        raise TemplateError("nested too deeply")
    out: list[Node] = []
    while at < len(tokens):
        kind, text = tokens[at]
        word = text.split(None, 1)[0] if text.split() else ""
        if kind == "text":
            out.append(Node("text", (text,)))
        elif kind == "out":
            out.append(Node("out", (Expression(text).whole(),)))
        elif word in ends or word in ("elif", "else", "endif", "endfor", "endgeneration"):
            if word not in ends:
                raise TemplateError(f"unexpected {word!r}")
            return tuple(out), at, text
        elif word == "if":
            node, at = _if(tokens, at, text[2:], deep)
            out.append(node)
        elif word == "for":
            m = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", text, re.S)
            if not m:
                raise TemplateError(f"bad loop: {text!r}")
            body, at, _ = _body(tokens, at + 1, ("endfor",), deep + 1)
            out.append(Node("for", (m[1], Expression(m[2]).whole(), body)))
        elif word == "set":
            m = re.fullmatch(r"set\s+(\w+)\s*=\s*(.+)", text, re.S)
            if not m:
                raise TemplateError(f"bad assignment: {text!r}")
            out.append(Node("set", (m[1], Expression(m[2]).whole())))
        elif word == "generation":
            body, at, _ = _body(tokens, at + 1, ("endgeneration",), deep + 1)
            out.append(Node("generation", (body,)))
        else:
            raise TemplateError(f"no such statement: {text!r}")
        at += 1
    if ends:
        raise TemplateError(f"expected {' or '.join(ends)}")
    return tuple(out), at, ""


def _if(tokens, at, test, deep) -> tuple[Node, int]:
    body, at, end = _body(tokens, at + 1, ("elif", "else", "endif"), deep + 1)
    other: tuple[Node, ...] = ()
    if end.startswith("elif"):
        node, at = _if(tokens, at, end[4:], deep + 1)
        other = (node,)
    elif end.startswith("else"):
        other, at, _ = _body(tokens, at + 1, ("endif",), deep + 1)
    return Node("if", (Expression(test).whole(), body, other)), at


def fold(nodes: tuple[Node, ...]) -> tuple[Node, ...]:
    """Compute what is constant: expressions, branches, and neighbouring texts."""
    out: list[Node] = []
    for n in nodes:
        if n.kind == "out":
            e = fold_expression(n.args[0])
            n = Node("text", (_shown(e.args[0]),)) if e.kind == "const" else Node("out", (e,))
        elif n.kind == "if":
            test = fold_expression(n.args[0])
            if test.kind == "const":
                for x in fold(n.args[1] if test.args[0] else n.args[2]):
                    _append(out, x)
                continue
            n = Node("if", (test, fold(n.args[1]), fold(n.args[2])))
        elif n.kind == "for":
            n = Node("for", (n.args[0], fold_expression(n.args[1]), fold(n.args[2])))
        elif n.kind == "set":
            n = Node("set", (n.args[0], fold_expression(n.args[1])))
        elif n.kind == "generation":
            n = Node("generation", (fold(n.args[0]),))
        _append(out, n)
    return tuple(out)


def _append(out: list[Node], n: Node) -> None:
    if n.kind == "text" and out and out[-1].kind == "text":
        out[-1] = Node("text", (out[-1].args[0] + n.args[0],))
    elif n.kind != "text" or n.args[0]:
        out.append(n)


def fold_expression(n: Node) -> Node:
    if n.kind in ("const", "name"):
        return n
    args = tuple(fold_expression(a) if isinstance(a, Node) else a for a in n.args)
    n = Node(n.kind, args)
    if n.kind in ("choice", "and", "or") and args[0].kind == "const":
        first = args[0].args[0]
        if n.kind == "choice":
            return args[1] if first else args[2]
        return args[1] if bool(first) == (n.kind == "and") else args[0]
    if all(a.kind == "const" for a in args if isinstance(a, Node)):
        try:
            return Node("const", (_closure(n)({}),))
        except Exception:  # left for the time when it is rendered
            return n
    return n


def _shown(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _closure(n: Node) -> Callable[[dict], object]:
    kind, a = n.kind, n.args
    if kind == "const":
        return lambda env, v=a[0]: v
    if kind == "name":
        return lambda env, k=a[0]: env.get(k)
    if kind == "binary":
        return lambda env, f=_BINARY[a[0]], x=_closure(a[1]), y=_closure(a[2]): f(x(env), y(env))
    if kind == "filter":
        return lambda env, f=FILTERS[a[0]], x=_closure(a[1]): f(x(env))
    if kind == "item":
        return lambda env, x=_closure(a[0]), k=_closure(a[1]): _item(x(env), k(env))
    if kind == "not":
        return lambda env, x=_closure(a[0]): not x(env)
    if kind == "and":
        return lambda env, x=_closure(a[0]), y=_closure(a[1]): x(env) and y(env)
    if kind == "or":
        return lambda env, x=_closure(a[0]), y=_closure(a[1]): x(env) or y(env)
    return lambda env, c=_closure(a[0]), x=_closure(a[1]), y=_closure(a[2]): x(env) if c(env) else y(env)


def _item(x, key):
    if isinstance(x, Mapping):
        return x.get(key)
    if isinstance(x, (list, tuple)) and isinstance(key, int) and not isinstance(key, bool):
        return x[key]
    raise TemplateError("only mappings and lists have items")


class Output:
    """Rendered text, and the spans of it (in code points) that are generated."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


Writer = Callable[[dict, Output], None]


def _writers(nodes: tuple[Node, ...]) -> Writer:
    steps = [_writer(n) for n in nodes]

    def run(env: dict, out: Output) -> None:
        for s in steps:
            s(env, out)

    return steps[0] if len(steps) == 1 else run


def _writer(n: Node) -> Writer:
    a = n.args
    if n.kind == "text":
        return lambda env, out, t=a[0]: out.write(t)
    if n.kind == "out":
        return lambda env, out, x=_closure(a[0]): out.write(_shown(x(env)))
    if n.kind == "if":
        return lambda env, out, c=_closure(a[0]), x=_writers(a[1]), y=_writers(a[2]): (x if c(env) else y)(env, out)
    if n.kind == "set":
        return lambda env, out, k=a[0], x=_closure(a[1]): env.__setitem__(k, x(env))
    if n.kind == "generation":
        inner = _writers(a[0])

        def mark(env: dict, out: Output) -> None:
            start = out.size
            inner(env, out)
            out.spans.append((start, out.size))

        return mark
    name, over, body = a[0], _closure(a[1]), _writers(a[2])

    def loop(env: dict, out: Output) -> None:
        items = list(over(env) or ())
        for i, x in enumerate(items):
            body({**env, name: x, "loop": {"first": i == 0, "last": i + 1 == len(items), "index": i + 1, "length": len(items)}}, out)

    return loop


class Template:
    """A compiled template. render() takes a whole conversation. turn() renders one turn of a template that
    is one loop over `messages` with what stands before and after it, so that a conversation of any length
    can be rendered in parts, by many tasks."""

    def __init__(self, source: str = CHAT):
        self.source = source
        self.tree = fold(parse(source))
        self.run = _writers(self.tree)
        loops = [i for i, n in enumerate(self.tree) if n.kind == "for" and n.args[1] == Node("name", ("messages",))]
        self.in_turns = len(loops) == 1 and "loop.index" not in source and "loop.length" not in source and self._reads(self.tree) == 1
        if self.in_turns:
            i = loops[0]
            self.name, self.head, self.body, self.tail = self.tree[i].args[0], _writers(self.tree[:i]), _writers(self.tree[i].args[2]), _writers(self.tree[i + 1 :])
        self.uses_place = self.in_turns and (len(self.tree) > 1 or "loop" in source)

    @staticmethod
    def _reads(x) -> int:
        if isinstance(x, Node):
            return int(x == Node("name", ("messages",))) + sum(map(Template._reads, x.args))
        return sum(map(Template._reads, x)) if isinstance(x, tuple) else 0

    def __reduce__(self):
        return Template, (self.source,)

    def render(self, messages: Iterable[Mapping], **given) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        self.run({**given, "messages": list(messages)}, out)
        return out.text, out.spans

    def turn(self, message: Mapping, first: bool, last: bool, out: Output, **given) -> None:
        env = dict(given)
        self.head(env, out if first else Output())
        self.body({**env, self.name: message, "loop": {"first": first, "last": last}}, out)
        if last:
            self.tail(env, out)
