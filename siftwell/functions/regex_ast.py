"""Parser for the search dialect: linear-time regular expressions, Unicode by default.

Look-around and back-references are refused.  The tree is what the translator and the
trigram planner work on.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


class PatternError(ValueError):
    """The pattern is not of the dialect."""


@dataclass(frozen=True)
class Flags:
    i: bool = False
    m: bool = False
    s: bool = False
    swap: bool = False
    u: bool = True
    x: bool = False


@dataclass(frozen=True)
class Lit:
    char: str
    ci: bool = False


@dataclass(frozen=True)
class Dot:
    newline: bool


@dataclass(frozen=True)
class Assert:
    kind: str  # ^ $ m^ m$ A z b B start end start-half end-half
    unicode: bool = True


@dataclass(frozen=True)
class Class:
    """A set of characters: ranges, named sets and sets of sets."""

    items: tuple = ()  # (lo, hi) | ("named", name, negated, unicode) | Class
    negated: bool = False
    ci: bool = False
    op: str = ""  # "" union of items, "&&" "--" "~~" of the two items


@dataclass(frozen=True)
class Group:
    node: object


@dataclass(frozen=True)
class Concat:
    nodes: tuple = ()


@dataclass(frozen=True)
class Alt:
    nodes: tuple = ()


@dataclass(frozen=True)
class Repeat:
    node: object
    low: int
    high: int | None
    lazy: bool = False


# POSIX class names and their ASCII members as ranges.
POSIX = {
    "alnum": (("0", "9"), ("A", "Z"), ("a", "z")),
    "alpha": (("A", "Z"), ("a", "z")),
    "ascii": (("\0", "\x7f"),),
    "blank": (("\t", "\t"), (" ", " ")),
    "cntrl": (("\0", "\x1f"), ("\x7f", "\x7f")),
    "digit": (("0", "9"),),
    "graph": (("!", "~"),),
    "lower": (("a", "z"),),
    "print": ((" ", "~"),),
    "punct": (("!", "/"), (":", "@"), ("[", "`"), ("{", "~")),
    "space": (("\t", "\r"), (" ", " ")),
    "upper": (("A", "Z"),),
    "word": (("0", "9"), ("A", "Z"), ("_", "_"), ("a", "z")),
    "xdigit": (("0", "9"), ("A", "F"), ("a", "f")),
}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\x0b", "a": "\x07"}
_WORD_EDGES = ("start-half", "end-half", "start", "end")


@dataclass
class Parser:
    text: str
    pos: int = 0
    depth: int = 0
    flags: Flags = field(default_factory=Flags)

    def fail(self, why: str):
        raise PatternError(f"{why} at {self.pos} in {self.text!r}")

    def peek(self, n: int = 1) -> str:
        return self.text[self.pos : self.pos + n]

    def take(self, n: int = 1) -> str:
        out = self.peek(n)
        if len(out) < n:
            self.fail("unexpected end")
        self.pos += n
        return out

    def skip(self) -> None:
        """White space and comments, under the x flag."""
        while self.flags.x and self.pos < len(self.text):
            if self.peek().isspace():
                self.pos += 1
            elif self.peek() == "#":
                end = self.text.find("\n", self.pos)
                self.pos = len(self.text) if end < 0 else end + 1
            else:
                return

    def parse(self):
        out = self.alternation()
        if self.pos < len(self.text):
            self.fail("unopened group")
        return out

    def alternation(self):
        branches, nodes = [], []
        while True:
            self.skip()
            c = self.peek()
            if c in ("", ")"):
                break
            if c == "|":
                self.pos += 1
                branches.append(Concat(tuple(nodes)))
                nodes = []
                continue
            node = self.atom()
            if node is not None:
                nodes.append(self.repeats(node))
        branches.append(Concat(tuple(nodes)))
        return branches[0] if len(branches) == 1 else Alt(tuple(branches))

    def repeats(self, node):
        while True:
            self.skip()
            c = self.peek()
            if not c or c not in "*+?{":
                return node
            if c == "{":
                low, high = self.counts()
            else:
                self.pos += 1
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            lazy = self.flags.swap
            if self.peek() == "?":
                self.pos += 1
                lazy = not lazy
            node = Repeat(node, low, high, lazy)

    def counts(self) -> tuple[int, int | None]:
        end = self.text.find("}", self.pos)
        body = self.text[self.pos + 1 : end].replace(" ", "") if end >= 0 else ""
        low, comma, high = body.partition(",")
        if not low.isdecimal() or high and not high.isdecimal():
            self.fail("bad repetition")
        self.pos = end + 1
        bounds = int(low), int(high) if high else None if comma else int(low)
        if bounds[1] is not None and bounds[1] < bounds[0] or int(low) > 1000:
            self.fail("bad repetition")
        return bounds

    def atom(self):
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.char_class()
        if c == ".":
            return Dot(self.flags.s)
        if c in "^$":
            return Assert(("m" if self.flags.m else "") + c)
        if c == "\\":
            return self.escape()
        if c in "*+?{":
            self.pos -= 1
            self.fail("nothing to repeat")
        return Lit(c, self.flags.i)

    def group(self):
        self.depth += 1
        if self.depth > 200:
            self.fail("nesting is too deep")
        before = self.flags
        if self.peek() == "?":
            if self.peek(2) in ("?=", "?!") or self.peek(3) in ("?<=", "?<!"):
                self.fail("look-around is not supported")
            if self.peek(3) == "?P<" or self.peek(2) == "?<":
                end = self.text.find(">", self.pos)
                name = self.text[self.text.find("<", self.pos) + 1 : end]
                if end < 0 or not name or not (name[0].isalpha() or name[0] == "_"):
                    self.fail("bad group name")
                self.pos = end + 1
            else:
                self.pos += 1
                self.flags = self.new_flags()
                if self.take() == ")":  # for the rest of the enclosing group
                    self.depth -= 1
                    return None
        node = self.alternation()
        if self.peek() != ")":
            self.fail("unclosed group")
        self.pos += 1
        self.flags = before
        self.depth -= 1
        return Group(node)

    def new_flags(self) -> Flags:
        flags, on, names = self.flags, True, {"i": "i", "m": "m", "s": "s", "U": "swap", "u": "u", "x": "x"}
        while (c := self.peek()) not in (":", ")"):
            self.take()
            if c == "-":
                on = False
            elif c in names:
                flags = replace(flags, **{names[c]: on})
            else:
                self.fail(f"flag {c!r} is not supported")
        return flags

    def escape(self):
        c = self.take()
        if c.isdigit():
            self.fail("back-references are not supported")
        if c in "wWdDsS":
            return Class((("named", c.lower(), c.isupper(), self.flags.u),))
        if c in "pP":
            return Class((self.prop(c == "P"),), ci=self.flags.i)
        if c in "Az":
            return Assert(c)
        if c in "bB":
            if c == "b" and self.peek() == "{":
                for kind in _WORD_EDGES:
                    if self.text.startswith("{" + kind + "}", self.pos):
                        self.pos += len(kind) + 2
                        return Assert(kind, self.flags.u)
            return Assert(c, self.flags.u)
        if c in "<>":
            return Assert("start" if c == "<" else "end", self.flags.u)
        return Lit(self.char_of(c), self.flags.i)

    def char_of(self, c: str) -> str:
        """The character that an escape stands for."""
        if c in _ESCAPES:
            return _ESCAPES[c]
        if c in "xuU":
            if self.peek() == "{":
                end = self.text.find("}", self.pos)
                digits = self.text[self.pos + 1 : end]
                self.pos = end + 1
            else:
                digits = self.take({"x": 2, "u": 4, "U": 8}[c])
            try:
                value = chr(int(digits, 16))
            except (ValueError, OverflowError):
                self.fail("bad code point")
            if c == "x" and not self.flags.u and len(digits) <= 2 and value > "\x7f":
                self.fail("bytes that are not ASCII are not supported")
            return value
        if c.isalnum() and c.isascii():
            self.fail(f"unknown escape \\{c}")
        return c

    def prop(self, negated: bool) -> tuple:
        if self.peek() == "{":
            end = self.text.find("}", self.pos)
            if end < 0:
                self.fail("unclosed property")
            name = self.text[self.pos + 1 : end]
            self.pos = end + 1
        else:
            name = self.take()
        if name.startswith("^"):
            name, negated = name[1:], not negated
        if "!=" in name:
            name, negated = name.replace("!=", "="), not negated
        return ("named", "p:" + name.strip(), negated, True)

    def char_class(self) -> Class:
        negated = self.peek() == "^"
        self.pos += negated
        items: list = []
        left, op = None, ""

        def union() -> Class:
            return Class(tuple(items), ci=self.flags.i)

        first = True
        while True:
            self.skip()
            c = self.take()
            if c == "]" and not first:
                break
            first = False
            if c == "[":
                if self.peek() == ":":
                    item = self.posix()
                else:
                    item = self.char_class()
                items.append(item)
                continue
            if c in "&-~" and self.peek() == c and (items or left is not None):
                self.pos += 1
                left = union() if left is None else Class((left, union()), op=op)
                items, op = [], c * 2
                continue
            low = self.class_char(c)
            if not isinstance(low, str):
                items.append(low)
                continue
            if self.peek() == "-" and self.peek(2) not in ("-]", "--", "-"):
                self.pos += 1
                high = self.class_char(self.take())
                if not isinstance(high, str) or high < low:
                    self.fail("bad range")
                items.append((low, high))
            else:
                items.append((low, low))
        if left is not None:
            return Class((left, union()), negated, self.flags.i, op)
        return replace(union(), negated=negated)

    def class_char(self, c: str):
        if c != "\\":
            return c
        c = self.take()
        if c in "wWdDsS":
            return ("named", c.lower(), c.isupper(), self.flags.u)
        if c in "pP":
            return self.prop(c == "P")
        return "\x08" if c == "b" else self.char_of(c)

    def posix(self) -> Class:
        end = self.text.find(":]", self.pos)
        name = self.text[self.pos + 1 : end] if end >= 0 else ""
        negated = name.startswith("^")
        name = name[negated:]
        if name not in POSIX:
            self.fail("unknown POSIX class")
        self.pos = end + 2
        return Class(POSIX[name], negated, self.flags.i)


def parse(pattern: str, ignore_case: bool = False, unicode: bool = True):
    return Parser(pattern, flags=Flags(i=ignore_case, u=unicode)).parse()


def walk(node):
    """The node and all below it."""
    yield node
    for child in getattr(node, "nodes", ()) or ():
        yield from walk(child)
    if hasattr(node, "node"):
        yield from walk(node.node)


def ignores_case(node) -> bool:
    return any(getattr(x, "ci", False) for x in walk(node))


def literal_text(node) -> str | None:
    """The text that the pattern is, if it is nothing but literals."""
    while isinstance(node, Group):
        node = node.node
    if isinstance(node, Lit):
        return None if node.ci else node.char
    if not isinstance(node, Concat):
        return None
    parts = [literal_text(x) for x in node.nodes]
    return None if None in parts or not parts else "".join(parts)


def literal_alternatives(node) -> list[str] | None:
    """The texts that the pattern chooses from, if it is an alternation of literals."""
    while isinstance(node, Group) or isinstance(node, Concat) and len(node.nodes) == 1:
        node = node.node if isinstance(node, Group) else node.nodes[0]
    if not isinstance(node, Alt):
        return None
    parts = [literal_text(x) for x in node.nodes]
    return None if None in parts else parts
