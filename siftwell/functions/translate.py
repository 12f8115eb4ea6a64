"""Pattern trees to Java patterns that mean the same.

Everything that the two dialects read differently is spelled out: classes, word edges,
anchors, the dot, and case folding (always by Unicode).
"""

from __future__ import annotations

from dataclasses import replace

from .linear import is_single, unwrapped
from .regex_ast import Alt, Assert, Class, Concat, Dot, Group, Lit, PatternError, Repeat

# What \w, \d and \s hold, by Unicode and in ASCII, inside a class.
_UNICODE = {"w": r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}", "d": r"\p{Nd}", "s": r"\p{IsWhite_Space}"}
_ASCII = {"w": "A-Za-z0-9_", "d": "0-9", "s": r"\t\n\x0B\f\r\x20"}

# Long names of general categories.
_CATEGORIES = {
    "letter": "L", "uppercase_letter": "Lu", "lowercase_letter": "Ll", "titlecase_letter": "Lt", "modifier_letter": "Lm", "other_letter": "Lo",
    "mark": "M", "nonspacing_mark": "Mn", "spacing_mark": "Mc", "enclosing_mark": "Me", "number": "N", "decimal_number": "Nd", "letter_number": "Nl",
    "other_number": "No", "punctuation": "P", "connector_punctuation": "Pc", "dash_punctuation": "Pd", "open_punctuation": "Ps", "close_punctuation": "Pe",
    "initial_punctuation": "Pi", "final_punctuation": "Pf", "other_punctuation": "Po", "symbol": "S", "math_symbol": "Sm", "currency_symbol": "Sc",
    "modifier_symbol": "Sk", "other_symbol": "So", "separator": "Z", "space_separator": "Zs", "line_separator": "Zl", "paragraph_separator": "Zp",
    "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "private_use": "Co", "unassigned": "Cn",
}
# Binary properties that Java knows by name.
_BINARY = ("alphabetic", "ideographic", "letter", "lowercase", "uppercase", "titlecase", "punctuation", "control", "white_space", "digit", "hex_digit", "join_control", "noncharacter_code_point", "assigned", "emoji")


def char(c: str) -> str:
    return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):X}}}"


def prop(name: str) -> str:
    key, _, value = name.replace("-", "_").replace(" ", "_").partition("=" if "=" in name else ":")
    low = key.lower()
    if value:
        if low in ("sc", "script", "scx", "script_extensions"):
            return rf"\p{{Is{value}}}"
        if low not in ("gc", "general_category"):
            raise PatternError(f"property {name!r} is not supported")
        key, low = value, value.lower()
    if low in _CATEGORIES:
        return rf"\p{{{_CATEGORIES[low]}}}"
    if len(key) <= 2 and low[:1] in "lmnpszc" and (len(key) == 1 or key.capitalize() in _CATEGORIES.values()):
        return rf"\p{{{key.capitalize()}}}"
    if low in ("any", "ascii"):
        return r"\x{0}-\x{10FFFF}" if low == "any" else r"\x00-\x7F"
    return rf"\p{{Is{key.capitalize() if low in _BINARY else key}}}"


def class_body(node: Class) -> str:
    """A Java class, with its brackets."""
    if node.op:
        a, b = (class_body(x) for x in node.items)
        out = {"&&": f"[{a}&&{b}]", "--": f"[{a}&&[^{b}]]", "~~": f"[[{a}{b}]&&[^[{a}&&{b}]]]"}[node.op]
    else:
        parts = []
        for item in node.items:
            if isinstance(item, Class):
                parts.append(class_body(item))
            elif item[0] == "named":
                _, name, negated, unicode = item
                inner = prop(name[2:]) if name.startswith("p:") else (_UNICODE if unicode else _ASCII)[name]
                parts.append(f"[^{inner}]" if negated else inner)
            else:
                parts.append(char(item[0]) if item[0] == item[1] else f"{char(item[0])}-{char(item[1])}")
        out = f"[{''.join(parts)}]" if parts else r"[^\x{0}-\x{10FFFF}]"
    return f"[^{out}]" if node.negated else out


def assertion(node: Assert) -> str:
    w = f"[{(_UNICODE if node.unicode else _ASCII)['w']}]"
    before, after, not_before, not_after = f"(?<={w})", f"(?={w})", f"(?<!{w})", f"(?!{w})"
    return {
        "^": r"\A", "A": r"\A", "$": r"\z", "z": r"\z", "m^": r"(?:\A|(?<=\n))", "m$": r"(?=\n|\z)",
        "b": f"(?:{before}{not_after}|{not_before}{after})", "B": f"(?:{before}{after}|{not_before}{not_after})",
        "start": not_before + after, "end": before + not_after, "start-half": not_before, "end-half": not_after,
    }[node.kind]


def simplified(node):
    """The node with alternations of single characters as classes, which need no recursion."""
    if isinstance(node, Alt):
        nodes = tuple(map(simplified, node.nodes))
        flat = [unwrapped(x) for x in nodes]
        if all(isinstance(x, (Lit, Class)) and not x.ci for x in flat):
            return Class(tuple((x.char, x.char) if isinstance(x, Lit) else x for x in flat))
        return Alt(nodes)
    if isinstance(node, Concat):
        return Concat(tuple(map(simplified, node.nodes)))
    if isinstance(node, (Group, Repeat)):
        return replace(node, node=simplified(node.node))
    return node


def to_java(node) -> str:
    return _java(simplified(node))


def _java(node) -> str:
    if isinstance(node, Lit):
        return f"(?iu:{char(node.char)})" if node.ci else char(node.char)
    if isinstance(node, Dot):
        return r"[\x{0}-\x{10FFFF}]" if node.newline else r"[^\n]"
    if isinstance(node, Assert):
        return assertion(node)
    if isinstance(node, Class):
        return f"(?iu:{class_body(node)})" if node.ci else class_body(node)
    if isinstance(node, Group):
        return f"(?:{_java(node.node)})"
    if isinstance(node, Alt):
        return "|".join(map(to_java, node.nodes))
    if isinstance(node, Repeat):
        count = "*" if (node.low, node.high) == (0, None) else f"{{{node.low},{'' if node.high is None else node.high}}}"
        count += "?" * node.lazy
        inner = unwrapped(node.node)
        if is_single(inner):  # without a group, so that the repetition is a plain loop
            bare = _java(replace(inner, ci=False) if getattr(inner, "ci", False) else inner)
            return f"(?iu:{bare}{count})" if getattr(inner, "ci", False) else f"{bare}{count}"
        return f"(?:{_java(node.node)}){count}"
    if isinstance(node, Concat):
        out, run = [], ""
        for x in node.nodes:  # case-insensitive literals in one group
            if isinstance(x, Lit) and x.ci:
                run += char(x.char)
                continue
            if run:
                out.append(f"(?iu:{run})")
                run = ""
            out.append(_java(x))
        return "".join(out) + (f"(?iu:{run})" if run else "")
    raise TypeError(node)
